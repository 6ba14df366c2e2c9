import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellatlas.functions.grid import Bounds
from cellatlas.operators import index, ingest, raster, store
from cellatlas.plans import layers
from cellatlas.sources import osm, pbf, scratch
from cellatlas.sources.osm import NODE, RELATION, WAY

OBJECTS = [
    (NODE, 1, 0.8, 0.8, [("place", "town"), ("name", "A")], None, None), (NODE, 2, 0.8, -0.8, [], None, None), (NODE, 3, -0.8, -0.8, [], None, None), (NODE, 4, -0.8, 0.8, [], None, None),
    (NODE, 5, 0.6, 0.6, [], None, None), (NODE, 6, 0.6, 0.0, [], None, None), (NODE, 7, 0.0, 0.0, [], None, None), (NODE, 8, 0.0, 0.6, [], None, None), (NODE, 9, 40.0, 40.0, [("place", "city"), ("name", "Far")], None, None),
    (WAY, 10, None, None, [], [1, 2, 3, 4, 1], None), (WAY, 11, None, None, [], [5, 6, 7, 8, 5], None), (WAY, 12, None, None, [("highway", "motorway")], [9, 99], None),
    (RELATION, 20, None, None, [("landuse", "forest")], None, [(10, WAY, "outer"), (11, WAY, "inner"), (77, WAY, "inner")]), (RELATION, 21, None, None, [("natural", "wood")], None, [(20, RELATION, ""), (21, RELATION, "")]),
]


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    """A dump of three blobs that the tests write."""
    path = tmp_path_factory.mktemp("dump") / "small.pbf"
    kinds = [[o for o in OBJECTS if o[0] == k] for k in (NODE, WAY, RELATION)]
    path.write_bytes(pbf.framed(b"OSMHeader", pbf._field(1, b"")) + b"".join(pbf.framed(b"OSMData", pbf.encode(k)) for k in kinds))
    return str(path)


@pytest.fixture(scope="module")
def small(spark, dump, tmp_path_factory):
    return store.import_dataset(pbf.read(spark, dump), str(tmp_path_factory.mktemp("store") / "small"), name="small", replicated="2024-01-01 00:00:01", partitions=2)


def test_dump_holds_what_was_written(spark, dump):
    rows = pbf.scan(spark, dump)
    assert rows.rdd.getNumPartitions() == 3
    got = {(r.kind, r.id): r for r in rows.collect()}
    for kind, i, lat, lon, tags, refs, members in OBJECTS:
        r = got.pop((kind, i))
        assert (r.lat, r.lon, [tuple(t) for t in r.tags], r.refs) == (lat, lon, tags, refs)
        assert (r.members and [tuple(m) for m in r.members]) == members
    assert not got


def test_single_nodes_and_plain_blobs():
    strings = pbf._field(1, b"".join(pbf._field(1, s) for s in (b"", b"k", b"v")))
    zigzag = lambda v: (v << 1) ^ (v >> 63)
    node = pbf._field(1, zigzag(-5)) + pbf._field(2, b"\x01") + pbf._field(3, b"\x02") + pbf._field(8, zigzag(515000000)) + pbf._field(9, zigzag(-2500000))
    block = strings + pbf._field(2, pbf._field(1, node)) + pbf._field(17, 100) + pbf._field(19, 1000)
    assert list(pbf.decode(pbf._field(1, block))) == [(NODE, -5, 51.500001, -0.25, [("k", "v")], None, None)]


def test_store_holds_the_dataset_and_its_index(spark, small):
    info = small.info.first()
    assert (info["name"], info["nodes"], info["ways"], info["relations"], info["replicated_ms"]) == ("small", 9, 3, 2, 1_704_067_201_000)
    assert small.points.where("way_id = 12").count() == 1
    pairs = index.wanted(spark, [(RELATION, "landuse"), (RELATION, "natural"), (NODE, "place")])
    got = {tuple(r) for r in small.get_in_bounds(Bounds(0.79, 0.81, 0.79, 0.81), pairs).collect()}
    assert got == {(NODE, "place", 1), (RELATION, "landuse", 20), (RELATION, "natural", 21)}


def test_bounds_reach_the_scan_of_the_index(spark, small):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = small.lookup(Bounds(0.0, 0.1, 0.2, 0.3), index.wanted(spark, [(NODE, "place")]))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(lat_cell,0)" in plan and "LessThanOrEqual(lon_cell,30)" in plan


def test_failed_import_leaves_what_was_there(spark, small, tmp_path, monkeypatch):
    path = str(tmp_path / "one")
    store.import_dataset(small.dataset, path, name="first", partitions=1)
    monkeypatch.setattr(index, "write_index", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.import_dataset(small.dataset, path, name="second", partitions=1)
    monkeypatch.undo()
    assert store.Store(spark, path).info.first()["name"] == "first"
    assert [p.name for p in tmp_path.iterdir()] == ["one"]
    store.import_dataset(small.dataset, path, name="third", bounds=Bounds(0.5, 1.0, 0.5, 1.0), partitions=1)
    clipped = store.Store(spark, path)
    assert clipped.info.first()["name"] == "third" and [p.name for p in tmp_path.iterdir()] == ["one"]
    assert {r.id for r in clipped.dataset.nodes.collect()} == {1, 5} and {r.id for r in clipped.dataset.relations.collect()} == {20, 21}


def test_registry_chooses_and_joins_datasets(spark, small, tmp_path):
    store.import_dataset(small.dataset, str(tmp_path / "corner"), name="corner", bounds=Bounds(0.5, 1.0, 0.5, 1.0), partitions=1)
    (tmp_path / "broken.importing-1").mkdir()
    known = store.Registry(spark)
    known.add_folder(str(tmp_path))
    known.add(small)
    assert [r.name for r in known.info().collect()] == ["small", "corner"]
    assert known.for_bounds(Bounds(0.6, 0.7, 0.6, 0.7)) == [("small", "full"), ("corner", "full")]
    assert known.for_bounds(Bounds(-0.5, 0.7, 0.6, 0.7)) == [("small", "full"), ("corner", "partial")] and known.for_bounds(Bounds(80, 81, 0, 1)) == []
    pairs = index.wanted(spark, [(NODE, "place")])
    assert {tuple(r) for r in known.get_in_bounds(Bounds(0.6, 0.9, 0.6, 0.9), pairs).collect()} == {("small", NODE, "place", 1), ("corner", NODE, "place", 1)}
    assert {r.id for r in known.nearby(Bounds(0.7, 0.795, 0.7, 0.795), pairs).collect()} == {1}
    assert '"replicated_ms":1704067201000' in known.info_json().first()["json"]


def test_relations_with_their_members(spark, small):
    ids = spark.createDataFrame([(20,), (21,)], "id long")
    got = {(r.parent_id, r.seq): (r.role, r.points and [(p.lat, p.lon) for p in r.points]) for r in index.relations_assembled(small.dataset, small.points, ids).collect()}
    assert set(got) == {(20, 1), (20, 2), (21, 1), (21, 2)} and got[21, 1] == ("", None)
    assert got[20, 2] == ("inner", [(0.6, 0.6), (0.6, 0.0), (0.0, 0.0), (0.0, 0.6), (0.6, 0.6)])


def test_spread_leaves_one_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "folder", lambda spark: str(tmp_path))
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (5, "b")], "id long, c string")
    steps = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 5)], "id long, to long")
    assert {tuple(r) for r in ingest.spread(rows, steps).collect()} == {(1, "a"), (2, "a"), (3, "a"), (5, "b")}
    assert len(list(tmp_path.iterdir())) == 1


def pixels(png):
    """The RGB rows of a picture as the renderer writes it."""
    at, data = 8, b""
    while at < len(png):
        size = int.from_bytes(png[at : at + 4], "big")
        if png[at + 4 : at + 8] == b"IDAT":
            data += png[at + 8 : at + 8 + size]
        assert zlib.crc32(png[at + 4 : at + 8 + size]) == int.from_bytes(png[at + 8 + size : at + 12 + size], "big")
        at += 12 + size
    return np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(256, -1)[:, 1:].reshape(256, 256, 3)


def test_a_multipolygon_has_its_hole():
    # The outline and hole of a forest within one degree of the origin.
    look = {"z_index": 1, "object_type": RELATION, "id": 20, "line_width": None, "line": None, "dash": None, "fill": (0xAC, 0xC8, 0xA0, 255)}
    outer = {"role": "outer", "seq": 1, "lats": [0.8, 0.8, -0.8, -0.8, 0.8], "lons": [0.8, -0.8, -0.8, 0.8, 0.8]}
    inner = {"role": "inner", "seq": 2, "lats": [0.6, 0.6, 0.0, 0.0, 0.6], "lons": [0.6, 0.0, 0.0, 0.6, 0.6]}
    p = pixels(raster.png(raster.picture_of([look | inner, look | outer], (-1, 1, -1, 1), (255, 255, 255, 255))))
    at = lambda lat, lon: tuple(p[int((1 - lat) * 128), int((1 + lon) * 128)].tolist())
    assert at(0.5, -0.5) == at(-0.5, 0.5) == at(0.7, 0.7) == (0xAC, 0xC8, 0xA0)
    assert at(0.3, 0.3) == at(0.9, 0.0) == at(0.0, -0.9) == (255, 255, 255)
    assert abs(int((p[:, :, 0] == 0xAC).sum()) - (0.8**2 * 4 - 0.36) * 128 * 128) < 4 * 256


def test_lines_dashes_and_mixing():
    xs, ys = np.array([10.0, 200.0]), np.array([50.0, 50.0])
    line = raster.near_line(xs, ys, 4)
    assert line[48:52, 10:200].all() and not line[46].any() and not line[54].any()
    parts = list(raster.dashes(xs, ys, [20, 5]))
    assert [(a[0], a[-1]) for a, _ in parts][:2] == [(10, 30), (35, 55)] and len(list(raster.dashes(xs, ys, [0, 0]))) == 1
    picture = np.full((256, 256, 3), 200, dtype=np.uint8)
    raster.paint(picture, line, (0, 100, 255, 127))
    assert tuple(picture[50, 50].tolist()) == (100, 150, 227) and tuple(picture[0, 0].tolist()) == (200, 200, 200)


def test_tiles_of_a_store(spark, small, tmp_path):
    tiles = spark.createDataFrame([(127, 127), (0, 0)], "x int, y int")  # zoom 8: north-west of the origin, and an empty one
    got = {(r.x, r.y): r for r in raster.render_tiles(small, tiles, 8).collect()}
    assert {k: r.objects for k, r in got.items()} == {(127, 127): 1, (0, 0): 0}
    assert (pixels(got[0, 0].png) == 255).all() and (pixels(got[127, 127].png)[:, :, 0] == 0xAC).any()
    raster.write_tiles(raster.render_tiles(small, tiles, 8), 8, f"file://{tmp_path}/tiles")
    assert (tmp_path / "tiles/8/127/127.png").read_bytes() == got[127, 127].png


def test_what_a_style_wants():
    style = layers.read_style('{"layers": [{"id": "background", "paint": {"background-color": "#102030"}}, {"id": "a", "source-layer": "landcover", "maxzoom": 9, "filter": ["==", "class", "wood"]}, {"id": "b", "source-layer": "poi", "filter": ["all", ["!=", "subclass", "station"], ["==", "$type", "Point"]]}, {"id": "c", "source-layer": "building"}]}')
    assert [k for t, k in layers.wanted_objects(style, 5) if t == WAY] == ["natural", "landuse", "landcover", "building"] and len(layers.wanted_objects(style, 12)) == 3
    known = layers.Styles([("built-in", None), ("mine", style)], "mine")
    assert known.ids() == ["built-in", "mine"] and known.get() is style and known.get("built-in") is None
    for bad in ([("a", None), ("a", None)], [("b", None)]):
        with pytest.raises(ValueError):
            layers.Styles(bad, "a")


def test_background_and_dashes_of_a_style(spark):
    style = layers.read_style('{"layers": [{"id": "background", "paint": {"background-color": "#102030"}}, {"id": "r", "type": "line", "source-layer": "transportation", "paint": {"line-color": "#000", "line-width": 2, "line-dasharray": [3, 1.5]}}]}')
    assert tuple(spark.range(1).select(layers.background(style).alias("c")).first().c) == (16, 32, 48, 255)
    assert tuple(spark.range(1).select(layers.background(style[1:]).alias("c")).first().c) == (255, 255, 255, 255)
    ways = spark.createDataFrame([(1, [("highway", "path")])], f"id long, tags {osm.TAGS}")
    assert layers.way_layers(ways, style, 10).first()["dash"] == [3.0, 1.5]


def test_stored_dataset_by_address(spark, small):
    assert osm.open_dataset(spark, f"parquet://{small.path}").ways.count() == 3
    with pytest.raises(ValueError):
        osm.open_dataset(spark, "what:ever")
    assert {r.id for r in small.dataset.nodes.where(F.col("lat_cell").between(75, 85)).collect()} == {1, 2}


def test_no_task_gathers_a_tile(spark, small):
    """Shapes come to the painter as a sorted stream, and an object between two layers of a relation is painted too."""
    plan = raster.render_tiles(small, spark.createDataFrame([(127, 127)], "x int, y int"), 8)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan
    base = {"role": "outer", "seq": 0, "line_width": 1.0, "line": None, "dash": None, "lats": [-1.0, 1.0, 1.0, -1.0], "lons": [-1.0, -1.0, 1.0, 1.0]}
    red, blue = (255, 0, 0, 255), (0, 0, 255, 255)
    relation = [base | {"z_index": z, "object_type": 3, "id": 1, "fill": c} for z, c in ((0, red), (9, red))]
    way = base | {"z_index": 10, "object_type": 2, "id": 2, "role": "", "fill": blue}
    assert tuple(raster.picture_of([*relation, way], (-1, 1, -1, 1), (9, 9, 9, 255))[100, 100].tolist()) == blue[:3]
    assert tuple(raster.picture_of(relation, (-1, 1, -1, 1), (9, 9, 9, 255))[100, 100].tolist()) == red[:3]


def plainly_painted(shapes, edges, background, size=256):
    """Every object in turn over the whole picture, from the lowest up."""
    min_lat, max_lat, min_lon, max_lon = edges
    picture = np.empty((size, size, 3), dtype=np.uint8)
    picture[:] = background[:3]
    y, x = np.mgrid[:size, :size] + 0.5

    def line(xs, ys, width):
        out, r = np.zeros((size, size), dtype=bool), max(width, 1.0) / 2
        for ax, ay, bx, by in zip(xs[:-1], ys[:-1], xs[1:], ys[1:]):
            length = (bx - ax) ** 2 + (by - ay) ** 2
            t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length, 0, 1) if length else 0.0
            out |= (x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2 <= r * r
        return out

    def way(xs, ys, width, colour, dash, fill):
        if fill is not None and len(xs) > 2:
            raster.paint(picture, raster.inside(xs, ys), fill)
        for dx, dy in [] if colour is None else raster.dashes(xs, ys, dash) if dash else [(xs, ys)]:
            raster.paint(picture, line(dx, dy, width), colour)

    for group in raster._objects(sorted(shapes, key=raster._drawing_order)):
        s = group[0]
        lines = [((np.asarray(g["lons"]) - min_lon) / (max_lon - min_lon) * size, (1 - (np.asarray(g["lats"]) - min_lat) / (max_lat - min_lat)) * size) for g in group]
        if s["object_type"] == NODE:
            raster.paint(picture, (abs(x - 0.5 - np.floor(lines[0][0][0])) <= 2) & (abs(y - 0.5 - np.floor(lines[0][1][0])) <= 2), s["line"])
        elif s["object_type"] == WAY:
            way(*lines[0], s["line_width"], s["line"], s["dash"], s["fill"])
        else:
            outer = [p for p, g in zip(lines, group) if g["role"] == "outer"]
            if outer:
                way(*map(np.concatenate, zip(*outer)), s["line_width"], s["line"], s["dash"], s["fill"])
                for p, g in zip(lines, group):
                    if g["role"] == "inner":
                        way(*p, 1.0, background, None, background)
    return picture


@pytest.mark.parametrize("shares", [(255,), (255, 127, 0, 30), (90,)])
def test_painting_from_the_top_down_gives_the_same_picture(shares):
    r = np.random.default_rng(len(shares))
    shapes = []
    for i in range(150):
        colours = [(*(int(c) for c in r.integers(0, 256, 3)), int(r.choice(shares))) if r.random() < 0.6 else None for _ in range(2)]
        kind = int(r.choice([NODE, WAY, RELATION]))
        look = {"z_index": int(r.integers(1, 4)), "object_type": kind, "id": i, "line_width": float(r.choice([0.5, 1.0, 3.0, 7.5])), "line": colours[0] or (1, 2, 3, 255), "dash": [20.0, 5.0] if r.random() < 0.2 else None, "fill": colours[1]}
        for seq in range(int(r.integers(1, 5)) if kind == RELATION else 1):
            n = 1 if kind == NODE else int(r.integers(1, 6))
            scale = r.choice([0.2, 1.0, 4.0])
            lats, lons = (r.normal(size=(2, n)) * scale).round(2).tolist()
            shapes.append(look | {"role": ["outer", "inner"][int(r.integers(2))] if kind == RELATION else "", "seq": seq, "lats": lats, "lons": lons})
    edges, ground = (-1, 1, -1, 1), (200, 220, 240, shares[-1])
    assert (raster.picture_of(shapes, edges, ground) == plainly_painted(shapes, edges, ground)).all()


def test_what_is_covered_is_not_painted(monkeypatch):
    """Objects under an opaque one cost no painting, however many they are."""
    made, inside = [], raster.inside
    monkeypatch.setattr(raster, "inside", lambda *a: made.append(1) or inside(*a))
    base = {"object_type": WAY, "role": "", "seq": 0, "line_width": 1.0, "line": None, "dash": None, "fill": (9, 8, 7, 255), "lats": [-2.0, 2.0, 2.0, -2.0], "lons": [-2.0, -2.0, 2.0, 2.0]}
    picture = raster.picture_of([base | {"z_index": 1, "id": i} for i in range(500)] + [base | {"z_index": 2, "id": 1, "fill": (1, 2, 3, 255)}], (-1, 1, -1, 1), (0, 0, 0, 255))
    assert (picture == (1, 2, 3)).all() and len(made) == 1
