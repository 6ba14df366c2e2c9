"""JSON map styles: layers whose filters ask for classes of tags, and the first layer that shows an object.

A style is small and read on the driver; its filters become Column expressions, so that one pass over the objects without
a shuffle decides their layers. A null filter shows everything, unknown categories and classes match nothing, and
unknown operators show nothing.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellatlas.functions import parse, stops
from cellatlas.sources.osm import NODE, RELATION, WAY

# The tags that a class stands for in a source layer; * is any value.
CLASSES = {
    "landcover": {
        "agriculture": [("landuse", "farmland"), ("landuse", "meadow"), ("landuse", "orchard"), ("landuse", "agriculture")],
        "grass": [("landuse", "grass")],
        "wood": [("natural", "wood"), ("landuse", "forest"), ("landcover", "trees")],
        "sand": [("natural", "sand")],
        "national_park": [("boundary", "national_park")],
    },
    "transportation": {
        "pier": [("man_made", "pier")],
        "path": [("highway", "path"), ("highway", "footway")],
        "track": [("highway", "track"), ("leisure", "track"), ("cycleway", "track")],
        "minor": [("highway", "unclassified"), ("highway", "residential")],
        "minor_road": [("highway", "unclassified"), ("highway", "residential")],
        "aeroway": [("aeroway", "*")],
        "rail": [("railway", "rail")],
        "transit": [("railway", "*"), ("landuse", "railway")],
        "ferry": [("route", "ferry")],
        "cable_car": [("aerialway", "cable_car")],
    },
}
# Classes of transportation that are values of the highway tag.
HIGHWAY_CLASSES = (
    "motorway_link", "primary_link", "secondary_link", "tertiary_link", "trunk_link", "trunk", "primary", "service", "secondary", "tertiary", "motorway",
)
# Source layers whose classes are values of the tag of the same name, and the tags of subclasses.
KEYED = ("aeroway", "airport_label", "housenum_label", "place", "waterway")
SUBCLASSES = {
    "landcover": {"ice_shelf": [("glacier:type", "shelf")], "glacier": [("natural", "glacier")]},
    "poi": {"station": [("building", "train_station")]},
}
# The keys that place an object in a source layer; other layers go by the key of their own name.
LAYER_KEYS = {"transportation": ("highway", "railway"), "landcover": ("landcover", "landuse")}
TYPES = {"Point": NODE, "LineString": WAY, "Polygon": WAY}
BACKGROUND = "background"


class Layer(NamedTuple):
    index: int
    id: str
    kind: str
    source: str
    filter: list | None
    min_zoom: float | None
    max_zoom: float | None
    paint: dict[str, Any]
    layout: dict[str, Any]

    def visible(self, zoom: float) -> bool:
        """Both ends count; the background is no layer of objects."""
        low, high = self.min_zoom, self.max_zoom
        return self.id != BACKGROUND and (low is None or low <= zoom) and (high is None or zoom <= high)


def read_style(text: str) -> list[Layer]:
    return [
        Layer(i, x["id"], x.get("type", ""), x.get("source-layer", ""), x.get("filter"), x.get("minzoom"), x.get("maxzoom"), x.get("paint", {}), x.get("layout", {}))
        for i, x in enumerate(json.loads(text)["layers"])
    ]


def tags_of_class(name: str, source: str) -> list[tuple[str, str]]:
    if source in KEYED:
        return [(source, name)]
    if source == "park":
        return [("leisure", "park")]
    if source == "transportation" and name in HIGHWAY_CLASSES:
        return [("highway", name)]
    return CLASSES.get("landcover" if source == "landuse" else source, {}).get(name, [])


def _any(parts: list[Column]) -> Column:
    return reduce(Column.__or__, parts, F.lit(False))


def _every(parts: list[Column]) -> Column:
    return reduce(Column.__and__, parts, F.lit(True))


def has_tag(tags: Column, wanted: list[tuple[str, str]]) -> Column:
    if not wanted:
        return F.lit(False)
    found = F.exists(tags, lambda t: _any([(t["key"] == k) if v == "*" else (t["key"] == k) & (t["value"] == v) for k, v in wanted]))
    return F.coalesce(found, F.lit(False))


def _matches(category: str, operand: str, source: str, kind: int | Column, tags: Column) -> Column:
    if category == "class":
        return has_tag(tags, tags_of_class(operand, source))
    if category == "subclass":
        return has_tag(tags, SUBCLASSES.get(source, {}).get(operand, []))
    if category == "$type":
        return (F.lit(kind) if isinstance(kind, int) else kind) == TYPES[operand]
    return F.lit(False)


def condition(rule: list | None, source: str, kind: int | Column, tags: Column) -> Column:
    """Whether a filter shows an object of a kind with such tags. ``any`` over filters is an extension."""
    if rule is None:
        return F.lit(True)
    operator, *rest = rule
    if operator in ("all", "any") and all(isinstance(x, list) for x in rest):
        parts = [condition(x, source, kind, tags) for x in rest]
        return _every(parts) if operator == "all" else _any(parts)
    category, *operands = rest
    hits = [_matches(category, x, source, kind, tags) for x in operands] if category in ("class", "subclass", "$type") else []
    if operator in ("==", "!="):
        hits = hits[:1]
    if operator in ("==", "in"):
        return _any(hits)
    if operator in ("!=", "!in"):
        return ~_any(hits)
    return _every(hits) if operator == "all" else F.lit(False)


def in_source(source: str, tags: Column) -> Column:
    keys = LAYER_KEYS.get(source, (source,))
    return F.coalesce(F.exists(tags, lambda t: t["key"].isin(*keys)), F.lit(False))


def _between(value: Any, zoom: float) -> tuple[Any, Any, float] | None:
    """The values of the stops around a zoom and the share of the way between them; None below the first stop."""
    points, base = value["stops"], value.get("base", 1.0)
    below = [i for i, (z, _) in enumerate(points) if z <= zoom]
    if not below:
        return None
    (low, this), (high, following) = points[below[-1]], points[min(below[-1] + 1, len(points) - 1)]
    if high == low:
        return this, this, 0.0
    return this, following, (zoom - low) / (high - low) if base == 1 else (base ** (zoom - low) - 1) / (base ** (high - low) - 1)


def number_at(value: Any, zoom: float) -> float:
    """A number or a function of the zoom; nothing, and zooms below the first stop, are 0. Falling stops rise."""
    if not isinstance(value, dict):
        return float(value or 0)
    found = _between(value, zoom)
    return found[0] + abs(found[1] - found[0]) * found[2] if found else 0.0


def colour_at(value: Any, zoom: float) -> Column | None:
    """struct<r,g,b,a> of a colour or a function of the zoom; None where nothing is shown."""
    if not value:
        return None
    if not isinstance(value, dict):
        return parse.colour(F.lit(value))
    found = _between(value, zoom)
    if found is None:
        return None
    this, following = parse.colour(F.lit(found[0])), parse.colour(F.lit(found[1]))
    return F.struct(*[stops.step(this[c], following[c], F.lit(found[2])).alias(c) for c in "rgba"])


_NO_COLOUR = "struct<r:int,g:int,b:int,a:int>"


def _first(choices: list[tuple[Column, Column]], schema: str) -> Column:
    out = F.lit(None).cast(schema)
    for shown, look in reversed(choices):
        out = F.when(shown, look).otherwise(out)
    return out


def way_layers(objects: DataFrame, layers: list[Layer], zoom: float) -> DataFrame:
    """(id, z_index, line_width, line_colour, dash, fill_colour) from the first line or symbol layer that shows a way.

    A layer without a fill, and without a line colour or width, shows nothing. Objects that no layer shows are left out.
    """
    choices = []
    for x in layers:
        if x.kind not in ("line", "symbol") or not x.visible(zoom):
            continue
        fill, line, width = colour_at(x.paint.get("fill-color"), zoom), colour_at(x.paint.get("line-color"), zoom), number_at(x.paint.get("line-width"), zoom)
        if fill is None and (line is None or width == 0):
            continue
        empty = F.lit(None).cast(_NO_COLOUR)
        look = F.struct(
            F.lit(x.index).alias("z_index"), F.lit(width).alias("line_width"), (empty if line is None else line).alias("line_colour"),
            F.array(*[F.lit(float(d)) for d in x.paint.get("line-dasharray", [])]).cast("array<double>").alias("dash"), (empty if fill is None else fill).alias("fill_colour"),
        )
        choices.append((in_source(x.source, F.col("tags")) & condition(x.filter, x.source, WAY, F.col("tags")), look))
    schema = f"struct<z_index:int,line_width:double,line_colour:{_NO_COLOUR},dash:array<double>,fill_colour:{_NO_COLOUR}>"
    return objects.select("id", _first(choices, schema).alias("s")).where("s IS NOT NULL").select("id", "s.*")


def node_layers(nodes: DataFrame, layers: list[Layer], zoom: float) -> DataFrame:
    """(id, z_index, text_size, text_colour) from the first symbol layer of places that shows a node; sizes are cut."""
    choices = []
    for x in layers:
        if x.kind == "symbol" and x.source == "place" and x.visible(zoom):
            colour = colour_at(x.paint.get("text-color"), zoom)
            look = F.struct(
                F.lit(x.index).alias("z_index"), F.lit(int(number_at(x.layout.get("text-size"), zoom))).alias("text_size"),
                (F.lit(None).cast(_NO_COLOUR) if colour is None else colour).alias("text_colour"),
            )
            choices.append((condition(x.filter, x.source, NODE, F.col("tags")), look))
    return nodes.select("id", _first(choices, f"struct<z_index:int,text_size:int,text_colour:{_NO_COLOUR}>").alias("s")).where("s IS NOT NULL").select("id", "s.*")


def _keys(rule: list | None, source: str) -> list[str]:
    """Tag keys of the classes and subclasses that a filter names, whatever its operators; a null filter names none."""
    if rule is None:
        return []
    rest = rule[1:]
    if all(isinstance(x, list) for x in rest):
        return [k for x in rest for k in _keys(x, source)]
    category, *operands = rest
    if category == "class":
        return [k for x in operands for k, _ in tags_of_class(x, source)]
    if category == "subclass":
        return [k for x in operands for k, _ in SUBCLASSES.get(source, {}).get(x, [])]
    return []


def wanted_objects(layers: list[Layer], zoom: float) -> list[tuple[int, str]]:
    """(object type, tag key) of everything that the layers at a zoom may show, in order and without repeats."""
    keys = dict.fromkeys(k for x in layers if x.visible(zoom) for k in _keys(x.filter, x.source))
    return [(kind, key) for key in keys for kind in (NODE, WAY, RELATION)]


def background(layers: list[Layer]) -> Column:
    """struct<r,g,b,a> of the first layer if it is the background, and white else."""
    first = layers[0] if layers and layers[0].id == BACKGROUND else None
    found = colour_at(first.paint.get("background-color"), 0) if first else None
    return parse.colour(F.lit("#ffffff")) if found is None else found


class Styles:
    """Styles by id; one of them is the default."""

    def __init__(self, styles: list[tuple[str, list[Layer] | None]], default: str):
        self.by_id: dict[str, list[Layer] | None] = {}
        for name, layers in styles:
            if name in self.by_id:
                raise ValueError(f"two styles are called {name!r}")
            self.by_id[name] = layers
        if default not in self.by_id:
            raise ValueError(f"no style is called {default!r}")
        self.default = default

    def get(self, name: str | None = None) -> list[Layer] | None:
        """The layers of a style, None for the built-in one; without a name, of the default."""
        return self.by_id[self.default if name is None else name]

    def ids(self) -> list[str]:
        return sorted(self.by_id)

    @classmethod
    def of_files(cls, files: DataFrame, built_in: str, default: str) -> Styles:
        """Styles from a frame of (id, text) of JSON files, few and small, beside the built-in one."""
        rows = files.select("id", "text").orderBy("id").collect()
        return cls([(built_in, None), *[(r["id"], read_style(r["text"])) for r in rows]], default)
