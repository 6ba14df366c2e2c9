"""A Spark-first engine for map-shaped data: cells, tags, styles and tiles."""
