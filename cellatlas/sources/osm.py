"""Datasets of nodes, ways, relations and tags, and their storage as sorted Parquet.

A dataset is a handful of DataFrames in normal form: way points and relation members are flat tables with a sequence
number, tags are an ordered array on each object.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellatlas.functions.grid import cell

NODE, WAY, RELATION = 1, 2, 3
TABLES = ("nodes", "ways", "way_nodes", "relations", "relation_members")
TAGS = "array<struct<key:string,value:string>>"


@dataclass(frozen=True)
class Dataset:
    """nodes(id, lat, lon, tags), ways(id, tags), way_nodes(way_id, seq, node_id), relations(id, tags),
    relation_members(parent_id, seq, member_id, member_type, role)."""

    nodes: DataFrame
    ways: DataFrame
    way_nodes: DataFrame
    relations: DataFrame
    relation_members: DataFrame


def tag(key: str, value: Column | str) -> Column:
    return F.struct(F.lit(key).alias("key"), (F.lit(value) if isinstance(value, str) else value).cast("string").alias("value"))


def _lookup(index: Column, values: list[Column]) -> Column:
    return F.element_at(F.array(*values), index.cast("int"))


# The tags that stand for column values of the tables below, in the order of the index they are looked up by.
PLACES = ("hamlet", "village", "town", "city", "suburb", "other")
WAY_TAGS = (("highway", "motorway"), ("highway", "residential"), ("railway", "rail"), ("natural", "wood"), ("landuse", "forest"))
STATUS_TAGS = {"F": ("landuse", "residential"), "O": ("surface", "paved"), "P": ("water", "lake")}
SEGMENT_TAGS = {"AUTOMOBILE": ("landuse", "forest"), "BUILDING": ("landuse", "residential"), "FURNITURE": ("natural", "wood"), "HOUSEHOLD": ("railway", "rail"), "MACHINERY": ("highway", "motorway")}
ROLES = {"O": "outer", "F": "inner", "P": ""}
NATIONS, REGIONS = 1_000_000, 2_000_000


def _by_value(column: str, table: dict[str, tuple[str, str]]) -> Column:
    out = None
    for value, (k, v) in table.items():
        out = F.when(F.col(column) == value, tag(k, v)) if out is None else out.when(F.col(column) == value, tag(k, v))
    return out


def from_orders(spark: SparkSession, sf_dir: str) -> Dataset:
    """A map-shaped dataset derived arithmetically from the part, orders, lineitem, customer, nation and region tables."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    key = F.col("p_partkey").cast("long")
    place = _lookup(F.length("p_type") % len(PLACES) + 1, [F.lit(p) for p in PLACES])
    nodes = read("part").select(
        key.alias("id"), (F.lit(51.0) + (key % 50) * F.lit(0.002)).alias("lat"), (F.lit(-1.0) + ((key * 7) % 53) * F.lit(0.002)).alias("lon"),
        F.array(tag("place", place), tag("name", F.col("p_name"))).alias("tags"),
    )
    orders = read("orders")
    first = _lookup(F.substring("o_orderpriority", 1, 1).cast("int"), [tag(k, v) for k, v in WAY_TAGS])
    ways = orders.select(F.col("o_orderkey").cast("long").alias("id"), F.array(first, _by_value("o_orderstatus", STATUS_TAGS)).alias("tags"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    way_nodes = read("lineitem").select(F.col("l_orderkey").cast("long").alias("way_id"), F.row_number().over(order).alias("seq"), F.col("l_partkey").cast("long").alias("node_id"))
    customers = read("customer").select(F.col("c_custkey").cast("long").alias("id"), F.array(_by_value("c_mktsegment", SEGMENT_TAGS)).alias("tags"))
    nations = read("nation").select((F.col("n_nationkey").cast("long") + NATIONS).alias("id"), F.array(tag("landuse", "forest")).alias("tags"))
    regions = read("region").select((F.col("r_regionkey").cast("long") + REGIONS).alias("id"), F.array(tag("natural", "wood")).alias("tags"))

    def members(df: DataFrame, parent: Column, member: Column, kind: int, role: Column) -> DataFrame:
        rows = df.select(parent.cast("long").alias("parent_id"), member.cast("long").alias("member_id"), F.lit(kind).alias("member_type"), role.alias("role"))
        seq = F.row_number().over(Window.partitionBy("parent_id").orderBy("member_id"))
        return rows.select("parent_id", seq.alias("seq"), "member_id", "member_type", "role")

    role = F.when(F.col("o_orderstatus") == "O", "outer").when(F.col("o_orderstatus") == "F", "inner").otherwise("")
    way_members = members(orders, F.col("o_custkey"), F.col("o_orderkey"), WAY, role)
    in_nation = members(read("customer"), F.col("c_nationkey") + NATIONS, F.col("c_custkey"), RELATION, F.lit(""))
    in_region = members(read("nation"), F.col("n_regionkey") + REGIONS, F.col("n_nationkey") + NATIONS, RELATION, F.lit(""))
    odd = spark.createDataFrame(
        [(REGIONS, 900, REGIONS, RELATION, ""), (1, 901, 999_999_999, WAY, "outer"), (2, 902, 999_999_998, RELATION, ""), (NATIONS, 903, REGIONS, RELATION, ""), (3, 904, 5, NODE, "label")],
        "parent_id long, seq int, member_id long, member_type int, role string",
    )
    return Dataset(nodes, ways, way_nodes, customers.union(nations).union(regions), way_members.union(in_nation).union(in_region).union(odd))


#: The same dataset for DuckDB: flat tables as common table expressions.
ORACLE = f"""
nodes AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(51.0 AS DOUBLE) + (p_partkey % 50) * CAST(0.002 AS DOUBLE) AS lat, CAST(-1.0 AS DOUBLE) + ((p_partkey * 7) % 53) * CAST(0.002 AS DOUBLE) AS lon, ['{"', '".join(PLACES)}'][length(p_type) % {len(PLACES)} + 1] AS place, p_name AS name FROM part),
ways AS (SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderpriority, o_orderstatus, o_custkey FROM orders),
way_nodes AS (SELECT CAST(l_orderkey AS BIGINT) AS way_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS seq, CAST(l_partkey AS BIGINT) AS node_id FROM lineitem),
relations AS (SELECT CAST(c_custkey AS BIGINT) AS id FROM customer UNION ALL SELECT n_nationkey + {NATIONS} FROM nation UNION ALL SELECT r_regionkey + {REGIONS} FROM region),
relation_members AS (
  SELECT CAST(o_custkey AS BIGINT) AS parent_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS seq, CAST(o_orderkey AS BIGINT) AS member_id, 2 AS member_type, CASE o_orderstatus WHEN 'O' THEN 'outer' WHEN 'F' THEN 'inner' ELSE '' END AS role FROM orders
  UNION ALL SELECT c_nationkey + {NATIONS}, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT), c_custkey, 3, '' FROM customer
  UNION ALL SELECT n_regionkey + {REGIONS}, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT), n_nationkey + {NATIONS}, 3, '' FROM nation
  UNION ALL VALUES ({REGIONS}, 900, {REGIONS}, 3, ''), (1, 901, 999999999, 2, 'outer'), (2, 902, 999999998, 3, ''), ({NATIONS}, 903, {REGIONS}, 3, ''), (3, 904, 5, 1, 'label')),
tags AS (
  SELECT id AS object_id, 1 AS object_type, 0 AS pos, 'place' AS key, place AS value FROM nodes UNION ALL SELECT id, 1, 1, 'name', name FROM nodes
  UNION ALL SELECT id, 2, 0, ['{"', '".join(k for k, _ in WAY_TAGS)}'][CAST(left(o_orderpriority, 1) AS INT)], ['{"', '".join(v for _, v in WAY_TAGS)}'][CAST(left(o_orderpriority, 1) AS INT)] FROM ways
  UNION ALL SELECT id, 2, 1, CASE o_orderstatus {" ".join(f"WHEN '{s}' THEN '{k}'" for s, (k, _) in STATUS_TAGS.items())} END, CASE o_orderstatus {" ".join(f"WHEN '{s}' THEN '{v}'" for s, (_, v) in STATUS_TAGS.items())} END FROM ways
  UNION ALL SELECT c_custkey, 3, 0, CASE c_mktsegment {" ".join(f"WHEN '{s}' THEN '{k}'" for s, (k, _) in SEGMENT_TAGS.items())} END, CASE c_mktsegment {" ".join(f"WHEN '{s}' THEN '{v}'" for s, (_, v) in SEGMENT_TAGS.items())} END FROM customer
  UNION ALL SELECT n_nationkey + {NATIONS}, 3, 0, 'landuse', 'forest' FROM nation UNION ALL SELECT r_regionkey + {REGIONS}, 3, 0, 'natural', 'wood' FROM region),
way_points AS (SELECT way_id, seq, node_id, lat, lon FROM way_nodes JOIN nodes ON id = node_id)
"""


def flat_tags(ds: Dataset) -> DataFrame:
    """(object_id, object_type, pos, key, value) of all objects."""
    parts = []
    for kind, df in ((NODE, ds.nodes), (WAY, ds.ways), (RELATION, ds.relations)):
        parts.append(df.select(F.col("id").alias("object_id"), F.lit(kind).alias("object_type"), F.posexplode("tags").alias("pos", "t")).select("object_id", "object_type", "pos", "t.key", "t.value"))
    return parts[0].union(parts[1]).union(parts[2])


def info(ds: Dataset, name: str) -> DataFrame:
    """One row: the dataset's name, its extent and how many nodes it has."""
    lat, lon = F.col("lat"), F.col("lon")
    return ds.nodes.agg(F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"), F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"), F.count(F.lit(1)).alias("nodes")).select(F.lit(name).alias("name"), "*")


def write(ds: Dataset, path: str, partitions: int) -> None:
    """Writes a dataset as Parquet, each table ranged and sorted by id, nodes by cell, so that row groups can be skipped."""
    by = {"ways": ["id"], "way_nodes": ["way_id", "seq"], "relations": ["id"], "relation_members": ["parent_id", "seq"]}
    nodes = ds.nodes.withColumn("lat_cell", cell(F.col("lat"))).withColumn("lon_cell", cell(F.col("lon")))
    nodes.repartitionByRange(partitions, "lat_cell", "lon_cell").sortWithinPartitions("lat_cell", "lon_cell", "id").write.mode("overwrite").parquet(f"{path}/nodes")
    for name, keys in by.items():
        getattr(ds, name).repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> Dataset:
    return Dataset(*[spark.read.parquet(f"{path}/{name}") for name in TABLES])


def open_dataset(spark: SparkSession, address: str) -> Dataset:
    """A dataset by its address: ``parquet://folder``, or ``jdbc:`` with the five tables."""
    if address.startswith("parquet://"):
        return read(spark, address.removeprefix("parquet://"))
    if address.startswith("jdbc:"):
        return Dataset(*[spark.read.format("jdbc").option("url", address).option("dbtable", name).load() for name in TABLES])
    raise ValueError(f"unknown address {address}")
