"""Style rules over tags: which objects a style wants, how ways and places look, and the ordered draw list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellatlas.sources.osm import NODE, RELATION, WAY, Dataset

# The lowest zoom at which a kind of place is shown.
PLACE_ZOOM = {
    "hamlet": 15, "village": 13, "town": 11, "city": 10, "country": 3, "state": 4, "region": 4, "province": 5, "district": 5, "county": 7, "municipality": 8,
}
OTHER_PLACE_ZOOM = 16

# Z-index, line width, fill and line colours of the built-in style.
AREAS = {
    ("natural", "wood"): (1, "#acc8a0"),
    ("landuse", "forest"): (1, "#acc8a0"),
    ("landuse", "residential"): (2, "#dfdfdf"),
}
RAILWAY = (3, 3.0, "#bebebe")
HIGHWAY_Z, PLACE_Z = 4, 5
HIGHWAYS = {
    "#f38d9e": ("motorway", "tertiary"),
    "#ffae9b": ("trunk",),
    "#ffd4a5": ("primary", "primary_link"),
    "#f6f9bf": ("secondary",),
    "#bcaca5": ("unclassified", "residential", "service", "track", "living_street", "pedestrian"),
    "#00ff00": ("footway", "path", "steps", "bridleway", "cycleway"),
}
DASHES = {"1,2,3": ("footway", "path", "steps"), "20,5": ("bridleway", "cycleway")}
WAY_KEYS = ("highway", "waterway", "water", "landuse", "natural", "railway")

WANTED = [(NODE, "place"), *[(kind, key) for kind in (WAY, RELATION) for key in WAY_KEYS]]


def first_tag(tags: Column, key: str) -> Column:
    return F.get(F.filter(tags, lambda t: t["key"] == key), F.lit(0))["value"]


def _deciding(t: Column) -> Column:
    area = F.lit(False)
    for k, v in AREAS:
        area = area | ((t["key"] == k) & (t["value"] == v))
    return (t["key"] == "highway") | (t["key"] == "railway") | area


def _chosen(value: Column, table: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(None).cast("string")
    for result, values in table.items():
        out = F.when(value.isin(*values), result).otherwise(out)
    return out


def way_styles(objects: DataFrame) -> DataFrame:
    """(id, z_index, line_width, line_colour, dash, fill_colour) by the first tag in order that the style knows.

    Objects without such a tag, and highways of an unknown kind, are left out.
    """
    d = objects.select("id", F.get(F.filter("tags", _deciding), F.lit(0)).alias("t")).where("t IS NOT NULL").select("id", "t.key", "t.value")
    key, value = F.col("key"), F.col("value")
    z, fill = F.lit(None).cast("int"), F.lit(None).cast("string")
    for (k, v), (index, colour) in AREAS.items():
        z = F.when((key == k) & (value == v), index).otherwise(z)
        fill = F.when((key == k) & (value == v), colour).otherwise(fill)
    line = F.when(key == "railway", RAILWAY[2]).when(key == "highway", _chosen(value, HIGHWAYS))
    z = F.when(key == "railway", RAILWAY[0]).when(key == "highway", HIGHWAY_Z).otherwise(z)
    out = d.select(
        "id", z.cast("int").alias("z_index"), F.when(key == "railway", F.lit(RAILWAY[1])).alias("line_width"), line.alias("line_colour"),
        F.when(key == "highway", _chosen(value, DASHES)).alias("dash"), fill.alias("fill_colour"),
    )
    return out.where("line_colour IS NOT NULL OR fill_colour IS NOT NULL")


def place_zoom(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in PLACE_ZOOM.items() for x in pair])
    return F.coalesce(F.try_element_at(known, kind), F.lit(OTHER_PLACE_ZOOM))


def visible_places(nodes: DataFrame, zoom: int) -> DataFrame:
    """(id, place, name, min_zoom) of named places shown at a zoom."""
    p = nodes.select("id", first_tag(F.col("tags"), "place").alias("place"), first_tag(F.col("tags"), "name").alias("name"))
    return p.where("place IS NOT NULL AND name <> ''").withColumn("min_zoom", place_zoom(F.col("place"))).where(F.col("min_zoom") <= zoom)


def draw_list(ds: Dataset, zoom: int) -> DataFrame:
    """(z_index, object_type, id) of everything drawn, ties broken by type and id."""
    places = visible_places(ds.nodes, zoom).select(F.lit(PLACE_Z).alias("z_index"), F.lit(NODE).alias("object_type"), "id")
    ways = way_styles(ds.ways).select("z_index", F.lit(WAY).alias("object_type"), "id")
    relations = way_styles(ds.relations).select("z_index", F.lit(RELATION).alias("object_type"), "id")
    return places.union(ways).union(relations).dropDuplicates(["object_type", "id"]).orderBy("z_index", "object_type", "id")


def matches(tags: Column, operator: str, key: str, *values: str) -> Column:
    """A comparison of a style filter: == and in look for a tag, != and !in for none; unknown operators match nothing."""
    hit = F.exists(tags, lambda t: (t["key"] == key) & (F.lit("*" in values) | t["value"].isin(*values)))
    if operator in ("==", "in"):
        return hit
    if operator in ("!=", "!in"):
        return ~hit
    return F.lit(False)


def all_of(*parts: Column) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out
