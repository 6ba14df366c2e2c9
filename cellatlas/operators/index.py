"""The inverted index (lat_cell, lon_cell, object_type, tag_key) -> ids, and queries by bounds and tags over it.

The index is an exploded table, one row per entry, so that building it is an explode and a distinct with map-side
aggregation, a lookup in a written index is a range predicate on cells that reaches the scan, and no list of ids is ever
gathered for a hot cell or key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellatlas.functions.grid import Bounds, cell, in_cells
from cellatlas.operators.ingest import spread, way_points
from cellatlas.sources.osm import NODE, RELATION, WAY, Dataset, flat_tags
from cellatlas.sources.scratch import written

COLUMNS = ["lat_cell", "lon_cell", "object_type", "tag_key", "id"]


def node_cells(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", cell(F.col("lat")).alias("lat_cell"), cell(F.col("lon")).alias("lon_cell"))


def node_index(ds: Dataset) -> DataFrame:
    cells = ds.nodes.select("id", cell(F.col("lat")).alias("lat_cell"), cell(F.col("lon")).alias("lon_cell"), F.explode("tags").alias("t"))
    return cells.select("lat_cell", "lon_cell", F.lit(NODE).alias("object_type"), F.col("t.key").alias("tag_key"), "id").distinct()


def way_segments(points: DataFrame) -> DataFrame:
    """Each point of a way with the one before it; the first point is a segment of its own."""
    w = Window.partitionBy("way_id").orderBy("seq")
    before = {c: F.coalesce(F.lag(c).over(w), F.col(c)) for c in ("lat", "lon")}
    return points.select("way_id", "seq", before["lat"].alias("lat0"), before["lon"].alias("lon0"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))


def way_cells(points: DataFrame) -> DataFrame:
    """Distinct cells in the rectangles that a way's segments span.

    A segment's fan-out is (rows + 1) * (columns + 1) of its rectangle; the cells of one way are made distinct where
    they arise, since the window before has its points in one task.
    """
    s = way_segments(points)

    def span(c: str):
        a, b = cell(F.col(f"{c}0")), cell(F.col(f"{c}1"))
        return F.sequence(F.least(a, b), F.greatest(a, b))

    lat = s.select("way_id", F.explode(span("lat")).alias("lat_cell"), span("lon").alias("lons"))
    return lat.select("way_id", "lat_cell", F.explode("lons").alias("lon_cell")).distinct()


def way_index(ds: Dataset) -> DataFrame:
    keys = ds.ways.select(F.col("id").alias("way_id"), F.explode(F.array_distinct(F.transform("tags", lambda t: t["key"]))).alias("tag_key"))
    cells = way_cells(way_points(ds.way_nodes, ds.nodes))
    return cells.join(keys, "way_id").select("lat_cell", "lon_cell", F.lit(WAY).alias("object_type"), "tag_key", F.col("way_id").alias("id"))


def relation_index(ds: Dataset) -> DataFrame:
    """A relation under its own tags in the cells of everything below it: cells spread from members to parents."""
    leaves = ds.relation_members.where(F.col("member_type") != RELATION).select(F.col("parent_id").alias("id"), "member_type", "member_id")
    direct = node_cells(ds.nodes).select(F.lit(NODE).alias("member_type"), F.col("id").alias("member_id"), "lat_cell", "lon_cell")
    ways = way_cells(way_points(ds.way_nodes, ds.nodes)).select(F.lit(WAY).alias("member_type"), F.col("way_id").alias("member_id"), "lat_cell", "lon_cell")
    own = leaves.join(direct.union(ways), ["member_type", "member_id"]).select("id", "lat_cell", "lon_cell")
    up = ds.relation_members.where(F.col("member_type") == RELATION).select(F.col("member_id").alias("id"), F.col("parent_id").alias("to"))
    keys = ds.relations.select("id", F.explode(F.array_distinct(F.transform("tags", lambda t: t["key"]))).alias("tag_key"))
    return spread(own, up).join(keys, "id").select("lat_cell", "lon_cell", F.lit(RELATION).alias("object_type"), "tag_key", "id")


def tag_index(ds: Dataset) -> DataFrame:
    return reduce(DataFrame.union, (node_index(ds), way_index(ds), relation_index(ds)))


def write_index(index: DataFrame, path: str, partitions: int) -> None:
    """Sorted by cell, so that a query by bounds reads only the row groups of its cells."""
    index.repartitionByRange(partitions, *COLUMNS[:4]).sortWithinPartitions(*COLUMNS).write.parquet(path)


def wanted(spark: SparkSession, pairs: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(pairs, "object_type int, tag_key string")


def lookup(index: DataFrame, b: Bounds, pairs: DataFrame) -> DataFrame:
    """(object_type, tag_key, id) of index entries in the cells of the bounds; the wanted pairs are a style's few."""
    near = index.where(in_cells(F.col("lat_cell"), F.col("lon_cell"), b))
    return near.join(F.broadcast(pairs.distinct()), ["object_type", "tag_key"], "left_semi").select("object_type", "tag_key", "id").distinct()


def get_in_bounds(ds: Dataset, index: DataFrame, b: Bounds, pairs: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """(object_type, tag_key, id): the objects found by the bounds and tags, grouped by key.

    Objects that are fetched only because a found relation needs them, at any depth, come out under each of their own
    wanted keys too, wherever they lie. An object with several wanted keys comes out once for each. ``tags``: the flat tags,
    if they are at hand. Only members of the relations that were found are followed.
    """
    hits = written(lookup(index, b, pairs), "hits")
    down = ds.relation_members.where(F.col("member_type") == RELATION).select(F.col("parent_id").alias("id"), F.col("member_id").alias("to"))
    fetched = spread(hits.where(F.col("object_type") == RELATION).select("id"), down)
    needed = ds.relation_members.join(fetched.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select(F.col("member_type").alias("object_type"), F.col("member_id").alias("id"))
    ids = hits.select("object_type", "id").union(needed).union(fetched.select(F.lit(RELATION), "id")).distinct()
    keyed = (flat_tags(ds) if tags is None else tags).select("object_type", F.col("object_id").alias("id"), F.col("key").alias("tag_key"))
    keyed = keyed.join(F.broadcast(pairs.distinct()), ["object_type", "tag_key"], "left_semi").distinct()
    return keyed.join(ids, ["object_type", "id"], "left_semi").select("object_type", "tag_key", "id")


def members_resolved(ds: Dataset) -> DataFrame:
    """Members with the first key of the object they name; null where it is missing."""
    keys = flat_tags(ds).where("pos = 0").select(F.col("object_type").alias("member_type"), F.col("object_id").alias("member_id"), F.col("key").alias("member_key"))
    return ds.relation_members.join(keys, ["member_type", "member_id"], "left").select("parent_id", "seq", "member_type", "member_id", "role", "member_key")


def relations_assembled(ds: Dataset, points: DataFrame, ids: DataFrame) -> DataFrame:
    """(parent_id, seq, member_type, member_id, role, tags, points): the whole members of the relations in ``ids``.

    points: array<struct<seq, lat, lon>> in a way's own order, one point for a node, null for a relation. Members that are
    missing are left out. One row for each member: a relation of any size is never gathered in one place.
    """
    members = ds.relation_members.join(ids.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi")
    wanted_ways = members.where(F.col("member_type") == WAY).select(F.col("member_id").alias("way_id")).distinct()
    lines = points.join(wanted_ways, "way_id", "left_semi").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("points"))
    none = F.lit(None).cast("array<struct<seq:int,lat:double,lon:double>>")
    objects = ds.nodes.select(F.lit(NODE).alias("member_type"), F.col("id").alias("member_id"), "tags", F.array(F.struct(F.lit(0).alias("seq"), "lat", "lon")).alias("points"))
    ways = ds.ways.join(lines, F.col("id") == F.col("way_id")).select(F.lit(WAY), "id", "tags", "points")
    relations = ds.relations.select(F.lit(RELATION), "id", "tags", none)
    return members.join(objects.union(ways).union(relations), ["member_type", "member_id"]).select("parent_id", "seq", "member_type", "member_id", "role", "tags", "points")


def datasets_for_bounds(info: DataFrame, b: Bounds) -> DataFrame:
    """Dataset descriptions with match level none, partial or full."""
    from cellatlas.functions.grid import covers, overlaps

    edges = [F.col(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")]
    level = F.when(covers(*edges, b), "full").when(overlaps(*edges, b), "partial").otherwise("none")
    return info.select("name", level.alias("match_level"))


def blocks(ids: DataFrame, first: int = 8192, later: int = 8191) -> DataFrame:
    """(block, items, last_id, offset): the sparse index of a section of sorted ids, of one dataset's bounded size.

    Ranks come from counts per range of ids, so that no task sorts everything: a running sum over ranges and a row
    number inside each.
    """
    width = 1 << 12
    part = F.floor(F.col("id") / width)
    counts = ids.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    ranked = ids.select("id", part.alias("part")).join(before, "part")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    block = F.when(rank < first, F.lit(0)).otherwise(F.floor((rank - first) / later) + 1).cast("long")
    grouped = ranked.select("id", block.alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("items"), F.max("id").alias("last_id"))
    return grouped.withColumn("offset", F.coalesce(F.sum("items").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def union_of(results: dict[str, DataFrame]) -> DataFrame:
    """The rows of several datasets' results, each with its dataset's name; objects in two datasets come twice."""
    named = [df.select(F.lit(name).alias("dataset"), "*") for name, df in results.items()]
    return reduce(DataFrame.unionByName, named)
