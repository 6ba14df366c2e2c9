from pyspark.sql import functions as F

from cellatlas.functions import grid, parse, stops
from cellatlas.operators import index, ingest
from cellatlas.plans import layers, style


def cells(spark, *points):
    rows = [(1, i, lat, lon) for i, (lat, lon) in enumerate(points)]
    return {(r.lat_cell, r.lon_cell) for r in index.way_cells(spark.createDataFrame(rows, "way_id long, seq int, lat double, lon double")).collect()}


def test_cell_rounds_down(spark):
    df = spark.createDataFrame([(0.005,), (0.01,), (-0.005,), (-0.77,)], "v double")
    assert [r[0] for r in df.select(grid.cell(F.col("v"))).collect()] == [0, 1, -1, -77]


def test_way_cells(spark):
    assert cells(spark, (0.0, 0.0), (1e-10, 1e-10)) == {(0, 0)}
    assert cells(spark, (0.0, 0.0), (0.01, 0.0), (0.03, 0.0)) == {(i, 0) for i in range(4)}
    assert cells(spark, (0.0, 0.01), (-0.03, -0.01)) == {(i, j) for i in range(-3, 1) for j in range(-1, 2)}
    diagonal = {(0, 300), (0, 301)} | {(1, j) for j in range(300, 304)} | {(i, j) for i in (2, 3) for j in (301, 302, 303)}
    assert cells(spark, (0.0, 3.0), (0.01, 3.01), (0.03, 3.03)) == diagonal


def test_numeric_stops(spark):
    s = spark.createDataFrame([("w", 1.2, 14.0, 1.0), ("w", 1.2, 20.0, 10.0)], "fn string, base double, zoom double, value double")
    z = spark.createDataFrame([(13.9,), (14.16,), (22.0,)], "zoom double")
    got = {r.zoom: r.value for r in stops.numeric_values(s, z).collect()}
    assert got == {13.9: 0.0, 14.16: round(1.134145054348234, 9), 22.0: 10.0}


def test_colour_stops_round_down(spark):
    s = spark.createDataFrame([("c", 1.0, 0.0, 0, 255, 0, 0), ("c", 1.0, 4.0, 255, 0, 0, 0)], "fn string, base double, zoom double, r int, g int, b int, a int")
    got = {r.zoom: (r.r, r.g) for r in stops.colour_values(s, spark.createDataFrame([(1.0,), (2.0,)], "zoom double")).collect()}
    assert got == {1.0: (63, 191), 2.0: (127, 127)}


def test_colours(spark):
    df = spark.createDataFrame([("#0369CF",), ("#3CF",), ("rgba(100,100,100,0)",), ("hsla(20, 10%, 60%, 0.5)",), ("teal",)], "t string")
    rows = [r[0] for r in df.select(parse.colour(F.col("t"))).collect()]
    assert tuple(rows[0]) == (3, 105, 207, 255) and tuple(rows[1]) == (51, 204, 255, 255)
    assert rows[2].a == 255 and rows[3].a == 127 and rows[4] is None


def test_closure_ends_on_cycles(spark):
    m = spark.createDataFrame([(1, 1, 2, 3, ""), (2, 1, 3, 3, ""), (3, 1, 1, 3, ""), (4, 1, 4, 3, "")], "parent_id long, seq int, member_id long, member_type int, role string")
    assert {(r.root, r.id) for r in ingest.closure(m).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}


def test_last_write_wins(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id long, v string, t int")
    assert [r.v for r in ingest.last_write_wins(df, "id", "t").collect()] == ["b"]


def test_first_known_tag_decides(spark):
    df = spark.createDataFrame([(1, [("surface", "x"), ("landuse", "forest"), ("highway", "path")]), (2, [("highway", "odd")]), (3, [])], "id long, tags array<struct<key:string,value:string>>")
    assert [(r.id, r.z_index) for r in style.way_styles(df).collect()] == [(1, 1)]


def test_layer_filters(spark):
    tags = "id long, tags array<struct<key:string,value:string>>"
    df = spark.createDataFrame([(1, [("highway", "footway")]), (2, [("railway", "tram"), ("landuse", "x")]), (3, []), (4, None)], tags)

    def shown(rule, source="transportation", kind=2):
        return [r.id for r in df.where(layers.condition(rule, source, kind, F.col("tags"))).orderBy("id").collect()]

    assert shown(["==", "class", "path"]) == [1] and shown(["in", "class", "path", "transit"]) == [1, 2]
    assert shown(["!=", "class", "path"]) == [2, 3, 4] and shown(["!in", "class", "path", "transit"]) == [3, 4]
    assert shown(None) == shown(["all"]) == shown(["!=", "odd", "x"]) == shown(["==", "$type", "Polygon"]) == [1, 2, 3, 4]
    assert shown(["==", "odd", "x"]) == shown(["~", "class", "path"]) == shown(["==", "$type", "Point"]) == []
    assert shown(["all", ["==", "$type", "LineString"], ["in", "class", "transit"]]) == [2]
    assert [r.id for r in df.where(layers.in_source("landcover", F.col("tags"))).collect()] == [2]


def test_values_at_zoom():
    assert layers.number_at({"base": 1.2, "stops": [[14, 1], [20, 10]]}, 13) == 0 and layers.number_at(None, 3) == 0
    assert layers.number_at({"stops": [[10, 8], [18, 2]]}, 14) == 11 and layers.number_at({"stops": [[10, 8], [18, 2]]}, 30) == 2
