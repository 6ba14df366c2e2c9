"""Registered queries over the map-shaped dataset and the DuckDB SQL that checks them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellatlas.functions import grid, parse, stops
from cellatlas.functions.grid import Bounds, cell_of
from cellatlas.operators import index, ingest, raster, store
from cellatlas.operators.store import Store
from cellatlas.plans import layers, style
from cellatlas.sources import osm, scratch
from cellatlas.sources.osm import Dataset

BOUNDS = Bounds(51.020, 51.050, -0.980, -0.950)
ZOOM = 14
REPLICATED = "2024-05-06 07:08:09.010"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_B = f"lat BETWEEN {BOUNDS.min_lat}::DOUBLE AND {BOUNDS.max_lat}::DOUBLE AND lon BETWEEN {BOUNDS.min_lon}::DOUBLE AND {BOUNDS.max_lon}::DOUBLE"
_IN_CELLS = f"lat_cell BETWEEN {cell_of(BOUNDS.min_lat)} AND {cell_of(BOUNDS.max_lat)} AND lon_cell BETWEEN {cell_of(BOUNDS.min_lon)} AND {cell_of(BOUNDS.max_lon)}"
_WANTED = "(VALUES " + ", ".join(f"({t}, '{k}')" for t, k in style.WANTED) + ") w(object_type, tag_key)"

_CTE = f"""
WITH RECURSIVE {osm.ORACLE},
node_cells AS (SELECT id, CAST(floor(lat * 100) AS INT) AS lat_cell, CAST(floor(lon * 100) AS INT) AS lon_cell FROM nodes),
segs AS (SELECT way_id, seq, coalesce(lag(lat) OVER w, lat) AS lat0, coalesce(lag(lon) OVER w, lon) AS lon0, lat AS lat1, lon AS lon1 FROM way_points WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
sc AS (SELECT way_id, CAST(floor(least(lat0, lat1) * 100) AS INT) AS a, CAST(floor(greatest(lat0, lat1) * 100) AS INT) AS b, CAST(floor(least(lon0, lon1) * 100) AS INT) AS c, CAST(floor(greatest(lon0, lon1) * 100) AS INT) AS d FROM segs),
way_cells AS (SELECT DISTINCT way_id, CAST(lat_cell AS INT) AS lat_cell, CAST(unnest(range(c, d + 1)) AS INT) AS lon_cell FROM (SELECT way_id, unnest(range(a, b + 1)) AS lat_cell, c, d FROM sc)),
reach AS (SELECT parent_id AS root, member_id AS id FROM relation_members WHERE member_type = 3 UNION SELECT r.root, m.member_id FROM reach r JOIN relation_members m ON m.parent_id = r.id AND m.member_type = 3),
closure AS (SELECT root, id FROM reach WHERE root <> id),
leaf_cells AS (SELECT DISTINCT m.parent_id AS id, c.lat_cell, c.lon_cell FROM relation_members m JOIN (SELECT 1 AS t, id, lat_cell, lon_cell FROM node_cells UNION ALL SELECT 2, way_id, lat_cell, lon_cell FROM way_cells) c ON m.member_type = c.t AND m.member_id = c.id),
rel_cells AS (SELECT DISTINCT root AS id, lat_cell, lon_cell FROM (SELECT root, id FROM closure UNION SELECT id, id FROM relations) JOIN leaf_cells USING (id)),
tag_index AS (SELECT DISTINCT lat_cell, lon_cell, object_type, key AS tag_key, object_id AS id FROM tags JOIN (SELECT 1 AS t, id, lat_cell, lon_cell FROM node_cells UNION ALL SELECT 2, way_id, lat_cell, lon_cell FROM way_cells UNION ALL SELECT 3, id, lat_cell, lon_cell FROM rel_cells) ON t = object_type AND id = object_id),
hits AS (SELECT DISTINCT object_type, tag_key, id FROM tag_index JOIN {_WANTED} USING (object_type, tag_key) WHERE {_IN_CELLS}),
fetched AS (SELECT id FROM hits WHERE object_type = 3 UNION SELECT c.id FROM closure c JOIN hits h ON h.object_type = 3 AND h.id = c.root),
ids AS (SELECT object_type, id FROM hits UNION SELECT 3, id FROM fetched UNION SELECT m.member_type, m.member_id FROM relation_members m JOIN fetched f ON m.parent_id = f.id),
in_bounds AS (SELECT DISTINCT t.object_type, t.key AS tag_key, t.object_id AS id FROM tags t JOIN {_WANTED} ON w.object_type = t.object_type AND w.tag_key = t.key JOIN ids i ON i.object_type = t.object_type AND i.id = t.object_id),
imported AS (SELECT * FROM nodes WHERE {_B}),
boxes AS (SELECT way_id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, count(*) AS points FROM way_nodes JOIN imported ON id = node_id GROUP BY way_id),
present AS (SELECT 1 AS t, id FROM nodes UNION ALL SELECT 2, id FROM ways UNION ALL SELECT 3, id FROM relations),
resolution AS (SELECT m.*, p.id IS NOT NULL AS resolved FROM relation_members m LEFT JOIN present p ON p.t = m.member_type AND p.id = m.member_id)
"""


def query(sql: str | None, name: str | None = None):
    """Registers a function of a dataset, with SQL over the common table expressions above."""

    def register(f: Callable[[Dataset], DataFrame]) -> Callable:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(osm.from_orders(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = f"{_CTE} {sql}"
        return f

    return register


def stored(spark: SparkSession, sf_dir: str) -> Store:
    """The dataset as a store, imported once for each application and folder."""
    mark = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    path = f"{scratch.folder(spark)}/cellatlas-store-{spark.sparkContext.applicationId}-{mark}"
    if store.exists(spark, path):
        return Store(spark, path)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return store.import_dataset(osm.from_orders(spark, sf_dir), path, name="orders", replicated=REPLICATED, partitions=partitions)


def store_query(sql: str | None):
    """Registers a function of the stored dataset, with SQL over the common table expressions above."""

    def register(f: Callable[[Store], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(stored(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = f"{_CTE} {sql}"
        return f

    return register


def values(sql: str):
    """Registers a function of the session alone."""

    def register(f: Callable[[SparkSession], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, _: f(spark)
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _index(ds: Dataset) -> DataFrame:
    return index.tag_index(ds)


def _wanted(ds: Dataset) -> DataFrame:
    return index.wanted(ds.nodes.sparkSession, style.WANTED)


# Scans and lookups


@query("SELECT id, lat, lon FROM nodes")
def scan_nodes(ds):
    return ds.nodes.select("id", "lat", "lon")


@query("SELECT object_id AS id, CAST(count(*) AS BIGINT) AS tags FROM tags WHERE object_type = 2 GROUP BY 1")
def scan_ways(ds):
    return ds.ways.select("id", F.size("tags").cast("long").alias("tags"))


@query("SELECT id FROM relations")
def scan_relations(ds):
    return ds.relations.select("id")


@query("SELECT object_id, object_type, pos, key, value FROM tags")
def flatten_tags(ds):
    return osm.flat_tags(ds)


@query("SELECT id, lat, lon FROM nodes WHERE id IN (1, 7, 77, 777)")
def lookup_nodes_by_id(ds):
    return ds.nodes.where(F.col("id").isin(1, 7, 77, 777)).select("id", "lat", "lon")


@query("SELECT way_id, seq, node_id, lat, lon FROM way_points WHERE way_id IN (1, 2, 3)")
def lookup_way_by_id(ds):
    return ingest.way_points(ds.way_nodes.where(F.col("way_id").isin(1, 2, 3)), ds.nodes)


@query("SELECT node_id AS id, max(way_id * 1000 + seq) AS written FROM way_nodes GROUP BY 1")
def upsert_last_wins(ds):
    writes = ds.way_nodes.select(F.col("node_id").alias("id"), (F.col("way_id") * 1000 + F.col("seq")).alias("written"))
    return ingest.last_write_wins(writes, "id", "written")


@query("SELECT id // 1024 AS bucket, count(*) AS items FROM ways GROUP BY 1")
def id_buckets(ds):
    return ds.ways.groupBy(F.floor(F.col("id") / 1024).alias("bucket")).agg(F.count(F.lit(1)).alias("items"))


@query("SELECT block, count(*) AS items, max(id) AS last_id, CAST(coalesce(sum(count(*)) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT id, CAST(CASE WHEN r < 8192 THEN 0 ELSE (r - 8192) // 8191 + 1 END AS BIGINT) AS block FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM ways)) GROUP BY block")
def block_metadata(ds):
    return index.blocks(ds.ways.select("id"))


# Grid and index


@query("SELECT * FROM node_cells")
def node_cells(ds):
    return index.node_cells(ds.nodes)


@query("SELECT * FROM tag_index WHERE object_type = 1")
def node_tag_index(ds):
    return index.node_index(ds)


@query("SELECT way_id, seq, node_id, lat, lon FROM way_points")
def way_points(ds):
    return ingest.way_points(ds.way_nodes, ds.nodes)


@query("SELECT way_id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, count(*) AS points FROM way_points GROUP BY way_id")
def way_bbox(ds):
    return ingest.way_bbox(ingest.way_points(ds.way_nodes, ds.nodes))


@query("SELECT way_id, seq, lat0, lon0, lat1, lon1 FROM segs")
def way_segments(ds):
    return index.way_segments(ingest.way_points(ds.way_nodes, ds.nodes))


@query("SELECT * FROM way_cells")
def way_cells(ds):
    return index.way_cells(ingest.way_points(ds.way_nodes, ds.nodes))


@query("SELECT * FROM tag_index WHERE object_type = 2")
def way_tag_index(ds):
    return index.way_index(ds)


@query("SELECT * FROM tag_index WHERE object_type = 3")
def relation_tag_index(ds):
    return index.relation_index(ds)


@query("SELECT lat_cell, lon_cell, object_type, tag_key, count(*) AS ids FROM tag_index GROUP BY ALL")
def tag_index_counts(ds):
    return _index(ds).groupBy("lat_cell", "lon_cell", "object_type", "tag_key").agg(F.count(F.lit(1)).alias("ids"))


@query("SELECT DISTINCT concat_ws('|', lat_cell, lon_cell, object_type, tag_key) AS key FROM tag_index")
def key_display(ds):
    return _index(ds).select(F.concat_ws("|", "lat_cell", "lon_cell", "object_type", "tag_key").alias("key")).distinct()


# Import


@query("SELECT id, lat, lon FROM imported")
def import_nodes(ds):
    return ingest.import_nodes(ds, BOUNDS).select("id", "lat", "lon")


@query("SELECT * FROM boxes")
def import_ways(ds):
    return ingest.import_ways(ds, BOUNDS)


_IMPORT = """, fed AS (SELECT DISTINCT parent_id AS id FROM relation_members WHERE (member_type = 1 AND member_id IN (SELECT id FROM imported)) OR (member_type = 2 AND member_id IN (SELECT way_id FROM boxes))),
kept AS (SELECT id FROM (SELECT id FROM fed UNION SELECT c.root FROM closure c JOIN fed f ON f.id = c.id) WHERE id IN (SELECT id FROM relations)),
seen AS (SELECT parent_id AS id, member_type, (member_type = 1 AND member_id IN (SELECT id FROM imported)) OR (member_type = 2 AND member_id IN (SELECT way_id FROM boxes)) OR (member_type = 3 AND member_id IN (SELECT id FROM kept)) AS resolved FROM relation_members)
SELECT id, count(*) AS members, CAST(sum(CAST(resolved AS INT)) AS BIGINT) AS resolved_members FROM seen WHERE id IN (SELECT id FROM relations) GROUP BY id HAVING bool_or(resolved)"""


@query(_IMPORT)
def import_relations(ds):
    return ingest.import_relations(ds, BOUNDS)


@query(_IMPORT + " AND NOT bool_or(NOT resolved AND member_type <> 1)")
def import_relations_strict(ds):
    return ingest.import_relations(ds, BOUNDS, strict=True)


@query("SELECT member_type, role, count(*) AS members FROM relation_members GROUP BY ALL")
def member_types(ds):
    return ds.relation_members.groupBy("member_type", "role").agg(F.count(F.lit(1)).alias("members"))


@query("SELECT member_type, member_id, parent_id, seq, role, resolved FROM resolution")
def member_resolution(ds):
    return ingest.member_resolution(ds.relation_members, ds.nodes, ds.ways, ds.relations)


@query("SELECT member_type, member_id, parent_id, seq, role FROM resolution WHERE NOT resolved")
def dangling_members(ds):
    return ingest.dangling(ds.relation_members, ds.nodes, ds.ways, ds.relations)


@query("SELECT DISTINCT node_id AS id FROM way_nodes")
def import_dedupe(ds):
    return ds.way_nodes.select(F.col("node_id").alias("id")).dropDuplicates(["id"])


@query("SELECT DISTINCT node_id AS id FROM way_nodes WHERE node_id NOT IN (SELECT id FROM imported)")
def import_outstanding(ds):
    asked = ds.way_nodes.select(F.col("node_id").alias("id")).dropDuplicates(["id"])
    return asked.join(ingest.import_nodes(ds, BOUNDS).select("id"), "id", "left_anti")


# Queries by bounds and tags


@store_query("SELECT object_type, tag_key, id FROM hits")
def tag_index_lookup(st):
    return st.lookup(BOUNDS, index.wanted(st.spark, style.WANTED))


@query("SELECT root, id FROM closure")
def relation_closure(ds):
    return ingest.closure(ds.relation_members).select("root", "id")


@query("SELECT m.parent_id, m.seq, m.member_type, m.member_id, m.role, t.key AS member_key FROM relation_members m LEFT JOIN tags t ON t.object_type = m.member_type AND t.object_id = m.member_id AND t.pos = 0")
def relation_members_resolved(ds):
    return index.members_resolved(ds)


@store_query("SELECT * FROM in_bounds")
def get_in_bounds(st):
    return st.get_in_bounds(BOUNDS, index.wanted(st.spark, style.WANTED))


@store_query("SELECT object_type, tag_key, count(*) AS objects FROM in_bounds GROUP BY ALL")
def get_in_bounds_counts(st):
    return get_in_bounds(st).groupBy("object_type", "tag_key").agg(F.count(F.lit(1)).alias("objects"))


_STRIPS = store.strips(BOUNDS, 0.01)
_IN_STRIPS = " OR ".join(f"(lat_cell BETWEEN {cell_of(b.min_lat)} AND {cell_of(b.max_lat)} AND lon_cell BETWEEN {cell_of(b.min_lon)} AND {cell_of(b.max_lon)})" for b in _STRIPS)


@store_query(f"SELECT DISTINCT object_type, tag_key, id FROM tag_index WHERE object_type = 1 AND tag_key = 'place' AND ({_IN_STRIPS})")
def nearby_strips(st):
    known = store.Registry(st.spark)
    known.add(st)
    return known.nearby(BOUNDS, index.wanted(st.spark, [(osm.NODE, "place")])).drop("dataset")


@store_query("SELECT 'orders' AS dataset, object_type, tag_key, id FROM in_bounds")
def registry_get_in_bounds(st):
    known = store.Registry(st.spark)
    known.add(st)
    return known.get_in_bounds(BOUNDS, index.wanted(st.spark, style.WANTED))


@store_query(
    f"SELECT 'orders' AS name, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, count(*) AS nodes, epoch_ms(TIMESTAMP '{REPLICATED}') AS replicated_ms, "
    "(SELECT count(*) FROM ways) AS ways, (SELECT count(*) FROM relations) AS relations, (SELECT count(*) FROM tag_index) AS index_rows FROM nodes"
)
def import_dataset(st):
    return st.info


_ASSEMBLED = "SELECT m.parent_id, m.seq, m.member_type, m.member_id, m.role, CAST((SELECT count(*) FROM tags t WHERE t.object_type = m.member_type AND t.object_id = m.member_id) AS INT) AS tags"


@store_query(
    f"""{_ASSEMBLED}, CAST(coalesce(p.n, CASE m.member_type WHEN 1 THEN 1 END) AS INT) AS points FROM relation_members m JOIN present o ON o.t = m.member_type AND o.id = m.member_id
    LEFT JOIN (SELECT way_id, count(*) AS n FROM way_points GROUP BY way_id) p ON m.member_type = 2 AND p.way_id = m.member_id WHERE (m.parent_id <= 50 OR m.parent_id >= 1000000) AND (m.member_type <> 2 OR p.n > 0)"""
)
def relations_with_members(st):
    ids = st.dataset.relations.where("id <= 50 OR id >= 1000000").select("id")
    found = index.relations_assembled(st.dataset, st.points, ids)
    return found.select("parent_id", "seq", "member_type", "member_id", "role", F.size("tags").alias("tags"), F.when(F.col("points").isNotNull(), F.size("points")).alias("points"))


@store_query("SELECT object_id, object_type, key, value FROM tags WHERE object_type = 2 AND object_id IN (SELECT member_id FROM relation_members WHERE parent_id = 3 AND member_type = 2)")
def tags_for_ids(st):
    ids = st.dataset.relation_members.where("parent_id = 3 AND member_type = 2").select(F.col("member_id").alias("object_id"))
    return st.tags.where("object_type = 2").join(ids, "object_id", "left_semi").select("object_id", "object_type", "key", "value")


_TILES = [*((x, y) for x in (8147, 8148) for y in (5481, 5482, 5483)), (8000, 5400)]  # the last is empty
_TILE_SQL = "(VALUES " + ", ".join(f"({x}, {y}, {cell_of(b.min_lat)}, {cell_of(b.max_lat)}, {cell_of(b.min_lon)}, {cell_of(b.max_lon)})" for x, y in _TILES for b in [grid.tile_bounds(x, y, ZOOM)]) + ") g(x, y, a, b, c, d)"


def _tiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TILES, "x int, y int")


@query(f"SELECT id FROM nodes WHERE lat > {BOUNDS.min_lat}::DOUBLE AND lat < {BOUNDS.max_lat}::DOUBLE AND lon > {BOUNDS.min_lon}::DOUBLE AND lon < {BOUNDS.max_lon}::DOUBLE")
def nodes_in_bounds_strict(ds):
    return ds.nodes.where(grid.strictly_inside(F.col("lat"), F.col("lon"), BOUNDS)).select("id")


@query("SELECT n.id, t.key, t.value FROM nodes n JOIN tags t ON t.object_type = 1 AND t.object_id = n.id WHERE t.key = 'place'")
def nodes_with_tags(ds):
    return ds.nodes.select("id", F.explode("tags").alias("t")).select("id", "t.key", "t.value").where("key = 'place'")


@query("SELECT object_id, key, value FROM tags WHERE object_type = 2")
def tags_for_ways(ds):
    return osm.flat_tags(ds).where("object_type = 2").select("object_id", "key", "value")


@query(f"SELECT DISTINCT t.object_type, t.key AS tag_key, t.object_id AS id FROM tags t JOIN {_WANTED} ON w.object_type = t.object_type AND w.tag_key = t.key")
def tags_by_type_key(ds):
    keyed = osm.flat_tags(ds).select("object_type", F.col("key").alias("tag_key"), F.col("object_id").alias("id"))
    return keyed.join(F.broadcast(_wanted(ds)), ["object_type", "tag_key"], "left_semi").distinct()


_STRIP = Bounds(BOUNDS.min_lat - 0.01, BOUNDS.max_lat + 0.01, BOUNDS.min_lon - 0.01, BOUNDS.max_lon + 0.01)


@query(f"SELECT id FROM node_cells WHERE lat_cell BETWEEN {cell_of(_STRIP.min_lat)} AND {cell_of(_STRIP.max_lat)} AND lon_cell BETWEEN {cell_of(_STRIP.min_lon)} AND {cell_of(_STRIP.max_lon)}")
def places_with_margin(ds):
    return index.node_cells(ds.nodes).where(grid.in_cells(F.col("lat_cell"), F.col("lon_cell"), _STRIP)).select("id").distinct()


@query(f"SELECT id, place, name FROM nodes JOIN node_cells USING (id) WHERE {_IN_CELLS}")
def nearby_places(ds):
    near = ds.nodes.where(grid.in_cells(grid.cell(F.col("lat")), grid.cell(F.col("lon")), BOUNDS))
    return near.select("id", style.first_tag(F.col("tags"), "place").alias("place"), style.first_tag(F.col("tags"), "name").alias("name"))


_INFO = [("all", 50.0, 52.0, -2.0, 0.0), ("east", 51.0, 51.1, -0.96, -0.5), ("far", 10.0, 11.0, 10.0, 11.0)]
_INFO_SQL = "(VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for n, a, b, c, d in _INFO) + ") i(name, min_lat, max_lat, min_lon, max_lon)"


@values(f"SELECT name, CASE WHEN min_lat <= {BOUNDS.min_lat} AND max_lat >= {BOUNDS.max_lat} AND min_lon <= {BOUNDS.min_lon} AND max_lon >= {BOUNDS.max_lon} THEN 'full' WHEN min_lat <= {BOUNDS.max_lat} AND max_lat >= {BOUNDS.min_lat} AND min_lon <= {BOUNDS.max_lon} AND max_lon >= {BOUNDS.min_lon} THEN 'partial' ELSE 'none' END AS match_level FROM {_INFO_SQL}")
def datasets_for_bounds(spark):
    return index.datasets_for_bounds(spark.createDataFrame(_INFO, "name string, min_lat double, max_lat double, min_lon double, max_lon double"), BOUNDS)


# Scalars


@query(f"SELECT id, CAST(floor((lon + 180.0::DOUBLE) / 360.0::DOUBLE * {float(2**ZOOM)}::DOUBLE) AS INT) AS x, CAST(floor((1.0::DOUBLE - ln(tan(radians(lat)) + 1.0::DOUBLE / cos(radians(lat))) / pi()) / 2.0::DOUBLE * {float(2**ZOOM)}::DOUBLE) AS INT) AS y FROM nodes")
def node_tiles(ds):
    return ds.nodes.select("id", grid.tile_x(F.col("lon"), ZOOM).alias("x"), grid.tile_y(F.col("lat"), ZOOM).alias("y"))


@values("SELECT CAST(z AS INT) AS z, CAST(k AS INT) AS k, round(k / power(2.0::DOUBLE, z) * 360 - 180, 9) AS lon, round(degrees(atan(sinh(pi() * (1 - 2.0::DOUBLE * k / power(2.0::DOUBLE, z))))), 9) AS lat FROM range(0, 13) a(z), range(0, 9) b(k) WHERE k <= power(2, z)")
def tile_corner(spark):
    t = spark.range(13).select(F.col("id").cast("int").alias("z"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k")).where("k <= pow(2, z)")
    return t.select("z", "k", F.round(grid.corner_lon(F.col("k"), F.col("z")), 9).alias("lon"), F.round(grid.corner_lat(F.col("k"), F.col("z")), 9).alias("lat"))


_STOPS = [("width", 1.2, 14.0, 1.0), ("width", 1.2, 20.0, 10.0), ("fall", 1.0, 5.0, 8.0), ("fall", 1.0, 9.0, 2.0)]


@values(
    f"WITH s AS (SELECT *, lead(zoom) OVER w AS nz, lead(value) OVER w AS nv FROM (VALUES {', '.join(f'({chr(39)}{f}{chr(39)}, {b}::DOUBLE, {z}::DOUBLE, {v}::DOUBLE)' for f, b, z, v in _STOPS)}) t(fn, base, zoom, value) WINDOW w AS (PARTITION BY fn ORDER BY zoom)), "
    "q AS (SELECT DISTINCT fn, zz FROM s, (SELECT CAST(i AS DOUBLE) / 2 AS zz FROM range(0, 50) r(i))) "
    "SELECT q.fn, q.zz AS zoom, round(CASE WHEN s.zoom IS NULL THEN 0 WHEN nz IS NULL THEN value ELSE value + abs(nv - value) * CASE WHEN base = 1 THEN (zz - s.zoom) / (nz - s.zoom) ELSE (power(base, zz - s.zoom) - 1) / (power(base, nz - s.zoom) - 1) END END, 9) AS value "
    "FROM q LEFT JOIN s ON s.fn = q.fn AND s.zoom <= zz AND (nz IS NULL OR zz < nz)"
)
def numeric_stop_values(spark):
    zooms = spark.range(50).select((F.col("id").cast("double") / 2).alias("zoom"))
    return stops.numeric_values(spark.createDataFrame(_STOPS, "fn string, base double, zoom double, value double"), zooms)


_COLOURS = {"#0369CF": (3, 105, 207, 255), "#3CF": (51, 204, 255, 255), "rgb(100, 200, 150)": (100, 200, 150, 255), "rgba(1,2,3,1)": (1, 2, 3, 255), "rgba(1,2,3,0)": (1, 2, 3, 255), "hsl(120,100%,50%)": (0, 255, 0, 255), "hsla(0, 0%, 100%, 0.5)": (255, 255, 255, 127), "red": None}


@values("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {', '.join(map(str, v)) if v else 'NULL, NULL, NULL, NULL'})" for k, v in _COLOURS.items()) + ") t(text, r, g, b, a)")
def parse_colors(spark):
    return spark.createDataFrame([(k,) for k in _COLOURS], "text string").withColumn("c", parse.colour(F.col("text"))).select("text", "c.r", "c.g", "c.b", "c.a")


@values("SELECT * FROM (VALUES ('(51.0,-1.0,52.0,0.5)', 51.0::DOUBLE, 52.0::DOUBLE, -1.0::DOUBLE, 0.5::DOUBLE), ('', -90.0, 90.0, -180.0, 180.0), ('a,b', NULL, NULL, NULL, NULL)) t(text, min_lat, max_lat, min_lon, max_lon)")
def parse_bounds(spark):
    return spark.createDataFrame([("(51.0,-1.0,52.0,0.5)",), ("",), ("a,b",)], "text string").withColumn("b", parse.bounds(F.col("text"), "SWNE")).select("text", "b.*")


@values("SELECT * FROM (VALUES ('postgresql://localhost', 'postgresql', 'localhost'), ('parquet:///data', 'parquet', '/data'), ('plain', NULL, NULL)) t(text, scheme, rest)")
def parse_conn_url(spark):
    return spark.createDataFrame([("postgresql://localhost",), ("parquet:///data",), ("plain",)], "text string").withColumn("c", parse.connection(F.col("text"))).select("text", "c.scheme", "c.rest")


# Styles and drawing

_PLACE_SQL = "CASE place " + " ".join(f"WHEN '{k}' THEN {z}" for k, z in style.PLACE_ZOOM.items()) + f" ELSE {style.OTHER_PLACE_ZOOM} END"
_HIGHWAY_SQL = "CASE " + " ".join(f"WHEN value IN ({', '.join(repr(v) for v in vs)}) THEN '{c}'" for c, vs in style.HIGHWAYS.items()) + " END"
_STYLED = f"""(SELECT id, object_type, CASE key WHEN 'highway' THEN 4 WHEN 'railway' THEN 3 ELSE CASE WHEN value IN ('wood', 'forest') THEN 1 ELSE 2 END END AS z_index,
 CASE key WHEN 'railway' THEN 3.0::DOUBLE END AS line_width, CASE key WHEN 'railway' THEN '#bebebe' WHEN 'highway' THEN {_HIGHWAY_SQL} END AS line_colour,
 CASE WHEN key IN ('natural', 'landuse') THEN CASE WHEN value = 'residential' THEN '#dfdfdf' ELSE '#acc8a0' END END AS fill_colour
 FROM (SELECT object_id AS id, object_type, first(key ORDER BY pos) AS key, first(value ORDER BY pos) AS value FROM tags
       WHERE object_type IN (2, 3) AND (key IN ('highway', 'railway') OR (key, value) IN (('natural', 'wood'), ('landuse', 'forest'), ('landuse', 'residential'))) GROUP BY ALL))"""


@query(f"SELECT id, place, name, CAST({_PLACE_SQL} AS INT) AS min_zoom FROM nodes WHERE name <> '' AND {_PLACE_SQL} <= {ZOOM}")
def visible_places(ds):
    return style.visible_places(ds.nodes, ZOOM)


@query(f"SELECT id, z_index, line_width, line_colour, fill_colour FROM {_STYLED} WHERE object_type = 2")
def way_styles(ds):
    return style.way_styles(ds.ways).drop("dash")


@query(f"SELECT id, z_index FROM {_STYLED} WHERE object_type = 3")
def relation_styles(ds):
    return style.way_styles(ds.relations).select("id", "z_index")


@query(f"SELECT object_type, tag_key FROM {_WANTED}")
def wanted_objects(ds):
    return _wanted(ds)


@query(f"SELECT z_index, object_type, id FROM {_STYLED} UNION ALL SELECT 5, 1, id FROM nodes WHERE name <> '' AND {_PLACE_SQL} <= {ZOOM}")
def draw_list(ds):
    return style.draw_list(ds, ZOOM)


_DRAWN = f"""(SELECT DISTINCT x, y, z_index, object_type, id FROM tag_index JOIN {_WANTED} USING (object_type, tag_key) JOIN {_TILE_SQL} ON lat_cell BETWEEN a AND b AND lon_cell BETWEEN c AND d
 JOIN (SELECT z_index, object_type, id FROM {_STYLED} UNION ALL SELECT 5, 1, id FROM nodes WHERE name <> '' AND {_PLACE_SQL} <= {ZOOM}) USING (object_type, id))"""
_SHAPED = "(SELECT 1 AS object_type, id FROM nodes UNION SELECT 2, way_id FROM way_points UNION SELECT 3, m.parent_id FROM relation_members m JOIN way_points p ON p.way_id = m.member_id WHERE m.member_type = 2 AND m.role IN ('outer', 'inner'))"


@store_query(f"SELECT x, y, z_index, object_type, id FROM {_DRAWN}")
def tile_draw_list(st):
    return raster.draw_list(st, _tiles(st.spark), ZOOM).select("x", "y", "z_index", "object_type", "id")


@store_query(f"SELECT g.x, g.y, count(DISTINCT (s.object_type, s.id)) FILTER (s.id IS NOT NULL) AS objects, true AS is_png FROM {_TILE_SQL} LEFT JOIN (SELECT x, y, object_type, id FROM {_DRAWN} JOIN {_SHAPED} USING (object_type, id)) s USING (x, y) GROUP BY ALL")
def render_tile(st):
    pictures = raster.render_tiles(st, _tiles(st.spark), ZOOM)
    return pictures.select("x", "y", "objects", (F.substring("png", 1, 8) == F.unhex(F.lit("89504E470D0A1A0A"))).alias("is_png"))


def _filter(op: str, values: tuple[str, ...], sql: str) -> None:
    def run(ds: Dataset) -> DataFrame:
        return ds.ways.where(style.matches(F.col("tags"), op, "landuse", *values)).select("id")

    name = {"==": "eq", "!=": "ne", "in": "in", "!in": "not_in"}[op]
    found = f"(SELECT object_id FROM tags WHERE object_type = 2 AND key = 'landuse' AND value IN ({', '.join(map(repr, values))}))"
    query(f"SELECT id FROM ways WHERE id {sql} {found}", f"style_filter_{name}")(run)


_filter("==", ("forest",), "IN")
_filter("!=", ("forest",), "NOT IN")
_filter("in", ("forest", "residential"), "IN")
_filter("!in", ("forest", "residential"), "NOT IN")


@query("SELECT DISTINCT object_id AS id FROM tags WHERE object_type = 2 AND key IN ('highway', 'railway')")
def ways_in_source_layer(ds):
    return ds.ways.where(F.exists("tags", lambda t: t["key"].isin("highway", "railway"))).select("id")


@query(f"SELECT id, CAST(floor((lon - {BOUNDS.min_lon}::DOUBLE) / {BOUNDS.max_lon - BOUNDS.min_lon}::DOUBLE * 256) AS INT) AS px, CAST(floor((1 - (lat - {BOUNDS.min_lat}::DOUBLE) / {BOUNDS.max_lat - BOUNDS.min_lat}::DOUBLE) * 256) AS INT) AS py FROM nodes WHERE {_B}")
def place_pixels(ds):
    x = (F.col("lon") - BOUNDS.min_lon) / (BOUNDS.max_lon - BOUNDS.min_lon)
    y = 1 - (F.col("lat") - BOUNDS.min_lat) / (BOUNDS.max_lat - BOUNDS.min_lat)
    return ingest.import_nodes(ds, BOUNDS).select("id", F.floor(x * 256).cast("int").alias("px"), F.floor(y * 256).cast("int").alias("py"))


@query("SELECT id, name, CAST(length(name) * 16 AS INT) AS width FROM nodes WHERE name <> ''")
def place_labels(ds):
    name = style.first_tag(F.col("tags"), "name")
    return ds.nodes.select("id", name.alias("name"), (F.char_length(name) * 16).cast("int").alias("width")).where("name <> ''")


@query("SELECT m.parent_id AS id, m.role, CAST(m.seq AS INT) AS member_seq, p.seq, p.lat, p.lon FROM relation_members m JOIN way_points p ON m.member_type = 2 AND m.member_id = p.way_id WHERE m.role IN ('outer', 'inner')")
def relation_rings(ds):
    rings = ds.relation_members.where("member_type = 2 AND role IN ('outer', 'inner')")
    points = ingest.way_points(ds.way_nodes, ds.nodes).select(F.col("way_id").alias("member_id"), F.col("seq").alias("point"), "lat", "lon")
    return rings.join(points, "member_id").select(F.col("parent_id").alias("id"), "role", F.col("seq").alias("member_seq"), F.col("point").alias("seq"), "lat", "lon")


@query("SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY member_seq, seq) AS INT) AS position, lat, lon FROM (SELECT m.parent_id AS id, m.seq AS member_seq, p.seq, p.lat, p.lon FROM relation_members m JOIN way_points p ON m.member_type = 2 AND m.member_id = p.way_id WHERE m.role = 'outer')")
def relation_outlines(ds):
    place = F.row_number().over(Window.partitionBy("id").orderBy("member_seq", "seq"))
    return relation_rings(ds).where("role = 'outer'").select("id", place.alias("position"), "lat", "lon")


# JSON styles

STYLE = """{"layers": [
 {"id": "background", "type": "background", "paint": {"background-color": "#ffffff"}},
 {"id": "wood", "type": "line", "source-layer": "landcover", "minzoom": 8, "filter": ["==", "class", "wood"], "paint": {"line-color": "#0369CF", "line-width": 2}},
 {"id": "roads", "type": "line", "source-layer": "transportation", "filter": ["all", ["==", "$type", "LineString"], ["in", "class", "motorway", "minor"], ["!=", "class", "rail"]],
  "paint": {"line-color": {"stops": [[10, "rgb(0, 255, 0)"], [18, "rgb(255, 0, 0)"]]}, "line-width": {"base": 1, "stops": [[10, 1], [18, 5]]}}},
 {"id": "rails", "type": "symbol", "source-layer": "transportation", "maxzoom": 13, "filter": ["==", "class", "rail"], "paint": {"line-color": "#bebebe", "line-width": 1}},
 {"id": "late", "type": "line", "source-layer": "transportation", "minzoom": 16, "paint": {"line-color": "#000000", "line-width": 1}},
 {"id": "places", "type": "symbol", "source-layer": "place", "filter": ["in", "class", "town", "city"], "paint": {"text-color": "#333333"}, "layout": {"text-size": {"stops": [[10, 8], [18, 15]]}}}
]}"""
_LAYERS = layers.read_style(STYLE)
_TAGGED = "SELECT object_id FROM tags WHERE object_type = 2 AND"
_WOOD = "((key = 'natural' AND value = 'wood') OR (key = 'landuse' AND value = 'forest') OR (key = 'landcover' AND value = 'trees'))"
_ROAD = "key = 'highway' AND value IN ('motorway', 'residential', 'unclassified')"


def _shown(ds: Dataset, rule: list, source: str) -> DataFrame:
    return ds.ways.where(layers.condition(rule, source, osm.WAY, F.col("tags"))).select("id")


@query(f"SELECT id FROM ways WHERE id IN ({_TAGGED} {_WOOD})")
def style_class_match(ds):
    return _shown(ds, ["==", "class", "wood"], "landcover")


def _with_ice(ds: Dataset) -> DataFrame:
    """The ways, every seventh a glacier and every eleventh a shelf of ice."""
    ice = F.array(*[F.when(F.col("id") % n == 0, osm.tag(k, v)) for n, k, v in ((7, "natural", "glacier"), (11, "glacier:type", "shelf"))])
    return ds.ways.withColumn("tags", F.concat("tags", F.array_compact(ice)))


@query("SELECT id FROM ways WHERE id % 7 <> 0 AND id % 11 <> 0")
def style_subclass_match(ds):
    return _with_ice(ds).where(layers.condition(["!in", "subclass", "ice_shelf", "glacier"], "landcover", osm.WAY, F.col("tags"))).select("id")


@query("SELECT id FROM ways WHERE id % 7 = 0")
def style_subclass_equals(ds):
    return _with_ice(ds).where(layers.condition(["==", "subclass", "glacier"], "landcover", osm.WAY, F.col("tags"))).select("id")


@values("SELECT object_type, tag_key FROM (VALUES ('natural'), ('landuse'), ('landcover'), ('highway'), ('railway'), ('place')) k(tag_key), (VALUES (1), (2), (3)) t(object_type)")
def style_wanted_objects(spark):
    return index.wanted(spark, layers.wanted_objects(_LAYERS, 8))


@values("SELECT 255 AS r, 255 AS g, 255 AS b, 255 AS a")
def style_background(spark):
    return spark.range(1).select(layers.background(_LAYERS).alias("c")).select("c.*")


@query("SELECT 2 AS object_type, id FROM ways")
def style_type_match(ds):
    objects = [df.select(F.lit(kind).alias("object_type"), "id", "tags") for kind, df in ((osm.NODE, ds.nodes), (osm.WAY, ds.ways), (osm.RELATION, ds.relations))]
    rule = layers.condition(["in", "$type", "LineString", "Polygon"], "transportation", F.col("object_type"), F.col("tags"))
    return objects[0].union(objects[1]).union(objects[2]).where(rule).select("object_type", "id")


@query(f"SELECT id FROM ways WHERE id IN ({_TAGGED} {_ROAD}) AND id NOT IN ({_TAGGED} key = 'railway' AND value = 'rail')")
def style_filter_all(ds):
    return _shown(ds, _LAYERS[2].filter, "transportation")


@values(
    "SELECT CAST(z AS INT) AS zoom, layer FROM range(0, 21) r(z), (VALUES ('wood', 8, 99), ('roads', 0, 99), ('rails', 0, 13), ('late', 16, 99), ('places', 0, 99)) l(layer, lo, hi) WHERE z BETWEEN lo AND hi"
)
def layers_at_zoom(spark):
    return spark.createDataFrame([(z, x.id) for z in range(21) for x in _LAYERS if x.visible(z)], "zoom int, layer string")


@query(
    f"""SELECT id, CAST(CASE WHEN wood THEN 1 ELSE 2 END AS INT) AS z_index, CASE WHEN wood THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS line_width,
 CASE WHEN wood THEN 3 ELSE 127 END AS r, CASE WHEN wood THEN 105 ELSE 127 END AS g, CASE WHEN wood THEN 207 ELSE 0 END AS b
 FROM (SELECT id, id IN ({_TAGGED} {_WOOD}) AND id IN ({_TAGGED} key IN ('landcover', 'landuse')) AS wood,
 id IN ({_TAGGED} {_ROAD}) AND id NOT IN ({_TAGGED} key = 'railway' AND value = 'rail') AS road FROM ways) WHERE wood OR road"""
)
def style_first_layer(ds):
    return layers.way_layers(ds.ways, _LAYERS, ZOOM).select("id", "z_index", "line_width", "line_colour.r", "line_colour.g", "line_colour.b")


@query("SELECT id, 5 AS z_index, 11 AS text_size FROM nodes WHERE place IN ('town', 'city')")
def style_place_labels(ds):
    return layers.node_layers(ds.nodes, _LAYERS, ZOOM).select("id", "z_index", "text_size")


# Datasets, order and geometry


@query("SELECT 'orders' AS name, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, count(*) AS nodes FROM nodes")
def dataset_info(ds):
    return osm.info(ds, "orders")


@query(f"SELECT 'north' AS dataset, id FROM nodes WHERE {_B} AND lat >= 51.03::DOUBLE UNION ALL SELECT 'south', id FROM nodes WHERE {_B} AND lat < 51.04::DOUBLE")
def multi_dataset_union(ds):
    parts = {"north": ds.nodes.where(F.col("lat") >= 51.03), "south": ds.nodes.where(F.col("lat") < 51.04)}
    return index.union_of({name: df.where(grid.contains(F.col("lat"), F.col("lon"), BOUNDS)).select("id") for name, df in parts.items()})


@query("SELECT * FROM tag_index")
def tag_index_sorted(ds):
    return _index(ds).orderBy("lat_cell", "lon_cell", "object_type", "tag_key", "id")


@values(
    "SELECT CAST(z AS INT) AS z, CAST(x AS INT) AS x, CAST(y AS INT) AS y, round(x / power(2.0::DOUBLE, z) * 360 - 180, 9) AS min_lon, round((x + 1) / power(2.0::DOUBLE, z) * 360 - 180, 9) AS max_lon, "
    "round(degrees(atan(sinh(pi() * (1 - 2.0::DOUBLE * (y + 1) / power(2.0::DOUBLE, z))))), 9) AS min_lat, round(degrees(atan(sinh(pi() * (1 - 2.0::DOUBLE * y / power(2.0::DOUBLE, z))))), 9) AS max_lat "
    "FROM range(0, 6) a(z), range(0, 32) b(x), range(0, 32) c(y) WHERE x < power(2, z) AND y < power(2, z)"
)
def tile_bounds(spark):
    side = F.sequence(F.lit(0), F.shiftleft(F.lit(1), 5) - 1)
    t = spark.range(6).select(F.col("id").cast("int").alias("z"), F.explode(side).alias("x")).select("z", "x", F.explode(side).alias("y")).where("x < pow(2, z) AND y < pow(2, z)")
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    edges = {"min_lon": grid.corner_lon(x, z), "max_lon": grid.corner_lon(x + 1, z), "min_lat": grid.corner_lat(y + 1, z), "max_lat": grid.corner_lat(y, z)}
    return t.select("z", "x", "y", *[F.round(c, 9).alias(n) for n, c in edges.items()])


@values(
    "SELECT base, zoom, round(CASE WHEN base = 1 THEN (zoom - 5) / 10 ELSE (power(base, zoom - 5) - 1) / (power(base, 10.0::DOUBLE) - 1) END, 9) AS share "
    "FROM (SELECT CAST(i AS DOUBLE) / 4 + 5 AS zoom FROM range(0, 41) r(i)), (VALUES (1.0::DOUBLE), (1.2::DOUBLE), (2.0::DOUBLE)) b(base)"
)
def exp_interpolation(spark):
    t = spark.range(41).select((F.col("id").cast("double") / 4 + 5).alias("zoom"), F.explode(F.array(F.lit(1.0), F.lit(1.2), F.lit(2.0))).alias("base"))
    return t.select("base", "zoom", F.round(stops.share(F.col("zoom"), F.lit(5.0), F.lit(15.0), F.col("base")), 9).alias("share"))


@values(
    "SELECT 'c' AS fn, z AS zoom, CASE WHEN z < 2 THEN NULL WHEN z >= 6 THEN 255 ELSE CAST(floor(255 * (z - 2) / 4) AS INT) END AS r, CASE WHEN z < 2 THEN NULL WHEN z >= 6 THEN 0 ELSE CAST(floor(-255 * (z - 2) / 4) AS INT) + 255 END AS g, "
    "CASE WHEN z >= 2 THEN 7 END AS b, CASE WHEN z >= 2 THEN 255 END AS a FROM (SELECT CAST(i AS DOUBLE) / 2 AS z FROM range(0, 17) t(i))"
)
def color_stop_values(spark):
    s = spark.createDataFrame([("c", 1.0, 2.0, 0, 255, 7, 255), ("c", 1.0, 6.0, 255, 0, 7, 255)], "fn string, base double, zoom double, r int, g int, b int, a int")
    return stops.colour_values(s, spark.range(17).select((F.col("id").cast("double") / 2).alias("zoom")))


_ENDS = [(1, 0.5, 0.5, 1.5, 0.5), (2, 0.5, 0.5, -0.5, 1.0), (3, 0.25, 0.5, 0.25, 3.0), (4, 0.75, 0.25, 1.25, -0.75)]


@values("SELECT * FROM (VALUES (1, 1.0::DOUBLE, 0.5::DOUBLE), (2, 0.0, 0.75), (3, 0.25, 1.0), (4, 0.875, 0.0)) t(id, x, y)")
def clip_segment(spark):
    t = spark.createDataFrame(_ENDS, "id int, ix double, iy double, ox double, oy double")
    part = F.least(grid.clip_share(F.col("ix"), F.col("ox")), grid.clip_share(F.col("iy"), F.col("oy")))
    return t.select("id", (F.col("ix") + (F.col("ox") - F.col("ix")) * part).alias("x"), (F.col("iy") + (F.col("oy") - F.col("iy")) * part).alias("y"))


@query(
    f"SELECT way_id, seq, round((lon - {BOUNDS.min_lon}::DOUBLE) / {BOUNDS.max_lon - BOUNDS.min_lon}::DOUBLE * 256, 6) AS px, round((1 - (lat - {BOUNDS.min_lat}::DOUBLE) / {BOUNDS.max_lat - BOUNDS.min_lat}::DOUBLE) * 256, 6) AS py FROM way_points"
)
def way_pixels(ds):
    points = ingest.way_points(ds.way_nodes, ds.nodes)
    x = (F.col("lon") - BOUNDS.min_lon) / (BOUNDS.max_lon - BOUNDS.min_lon)
    y = 1 - (F.col("lat") - BOUNDS.min_lat) / (BOUNDS.max_lat - BOUNDS.min_lat)
    return points.select("way_id", "seq", F.round(x * 256, 6).alias("px"), F.round(y * 256, 6).alias("py"))
