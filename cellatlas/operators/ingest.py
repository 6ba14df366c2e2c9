"""Import: clip nodes, resolve way points and relation members, close over relations of relations.

All resolution is by joins on ids; the one loop spreads rows along relation members, whose rounds grow with the depth of nesting
and are cut off with a written table, of which only the result stays. Missing nodes drop out of a way; a relation stays if at least one member
resolves, or in the strict variant if no way or relation member is missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellatlas.functions.grid import Bounds, contains, overlaps
from cellatlas.sources.osm import NODE, RELATION, WAY, Dataset
from cellatlas.sources.scratch import release, written


def import_nodes(ds: Dataset, b: Bounds) -> DataFrame:
    return ds.nodes.where(contains(F.col("lat"), F.col("lon"), b)).dropDuplicates(["id"])


def way_points(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, seq, node_id, lat, lon): points whose node is there, in the way's own order."""
    return way_nodes.join(nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id").select("way_id", "seq", "node_id", "lat", "lon")


def way_bbox(points: DataFrame) -> DataFrame:
    return points.groupBy("way_id").agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.count(F.lit(1)).alias("points")
    )


def import_ways(ds: Dataset, b: Bounds) -> DataFrame:
    """Boxes of the ways that have a point and touch the bounds."""
    box = way_bbox(way_points(ds.way_nodes, import_nodes(ds, b)))
    return box.where(overlaps(F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon"), b)).join(ds.ways.select(F.col("id").alias("way_id")), "way_id", "left_semi")


def member_resolution(members: DataFrame, nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Each relation member with whether its object is there. One equi-join on (type, id)."""
    there = nodes.select(F.lit(NODE).alias("member_type"), F.col("id").alias("member_id")).union(ways.select(F.lit(WAY), "id")).union(relations.select(F.lit(RELATION), "id"))
    return members.join(there.distinct().withColumn("resolved", F.lit(True)), ["member_type", "member_id"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def import_relations(ds: Dataset, b: Bounds, strict: bool = False) -> DataFrame:
    """(id, members, resolved_members) of the relations kept for the bounds.

    A nested relation counts as there when some node or way below it is: what is there spreads to the parents.
    """
    nodes = import_nodes(ds, b)
    ways = import_ways(ds, b).select(F.col("way_id").alias("id"))
    direct = member_resolution(ds.relation_members.where(F.col("member_type") != RELATION), nodes, ways, ds.relations.limit(0))
    fed = direct.where("resolved").select(F.col("parent_id").alias("id")).distinct()
    up = ds.relation_members.where(F.col("member_type") == RELATION).select(F.col("member_id").alias("id"), F.col("parent_id").alias("to"))
    kept = spread(fed, up).join(ds.relations.select("id"), "id", "left_semi")
    seen = member_resolution(ds.relation_members, nodes, ways, kept)
    lost = F.max((~F.col("resolved") & (F.col("member_type") != NODE)).cast("int"))
    summed = seen.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("resolved").cast("long")).alias("resolved_members"), lost.alias("lost"))
    summed = summed.join(ds.relations.select("id"), "id", "left_semi").where("resolved_members > 0")
    return (summed.where("lost = 0") if strict else summed).drop("lost")


def spread(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """Distinct ``rows`` (id, ...) and what ``steps`` (id, to) lead to from them, with the rows' other columns; cycles end.

    Each round moves only what the round before has found anew."""
    steps, columns = written(steps.distinct(), "steps"), rows.columns
    found = [written(rows.distinct(), "spread")]
    while found[-1].limit(1).count():
        moved = found[-1].join(steps, "id").drop("id").withColumnRenamed("to", "id").select(*columns).distinct()
        found.append(written(moved.join(reduce(DataFrame.union, found), columns, "left_anti"), "spread"))
    out = written(reduce(DataFrame.union, found), "spread")
    release(steps, *found)
    return out


def closure(members: DataFrame) -> DataFrame:
    """(root, id): every other relation that can be reached from a relation through members."""
    edges = members.where(F.col("member_type") == RELATION).select(F.col("parent_id").alias("id"), F.col("member_id").alias("to"))
    direct = edges.select(F.col("id").alias("root"), F.col("to").alias("id"))
    return spread(direct, edges).where("root <> id")


def dangling(members: DataFrame, nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    return member_resolution(members, nodes, ways, relations).where("NOT resolved").drop("resolved")


def last_write_wins(writes: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one written last. The maximum is taken in the map side of the aggregation."""
    rest = [c for c in writes.columns if c != key]
    return writes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(key, "last.*")
