"""Column functions that shape documents: labels, captions, maps, nested JSON, guards on uploads and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What made an attribute, by the first part of its key.
SOURCES = {"style": "Semantic Tagger · VLM", "cognitive": "Cognitive Analyzer · VLM", "color": "Color Analyzer · CIELAB", "texture": "Texture Analyzer · GLCM", "fractal": "Fractal Dimension Analyzer", "symmetry": "Symmetry Analyzer", "naturalness": "Naturalness Analyzer", "fluency": "Fluency Analyzer", "spatial": "Depth / Spatial Analyzer", "material": "Material Analyzer", "materials": "Material Analyzer", "segmentation": "Segmentation · OneFormer", "science": "Complexity Analyzer · Canny"}
ROOM_SOURCE, OTHER_SOURCE = "Room Classifier · VLM", "Science Pipeline"
#: Limits of an upload.
MAX_BYTES, MAX_FILES, EXTENSIONS = 10 << 20, 200, ["jpg", "jpeg", "png", "webp"]


def source_label(key: Column) -> Column:
    """Which analyzer made an attribute, in words."""
    named = F.create_map(*(F.lit(x) for kv in SOURCES.items() for x in kv))
    return F.when(F.contains(key, F.lit("room_function")), ROOM_SOURCE).otherwise(F.coalesce(F.try_element_at(named, F.substring_index(key, ".", 1)), F.lit(OTHER_SOURCE)))


def family(key: Column) -> Column:
    """The second of more than two dotted parts, else the last."""
    parts = F.split(key, r"\.")
    return F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise(F.element_at(parts, -1))


def split_last(key: Column, sep: str) -> tuple[Column, Column]:
    """What's before the last separator and what's after it; without one, the key and null."""
    there = F.contains(key, F.lit(sep))
    last = F.substring_index(key, sep, -1)
    return F.when(there, F.left(key, F.length(key) - F.length(last) - len(sep))).otherwise(key), F.when(there, last)


def caption(*parts: Column) -> Column:
    """The parts that aren't blank, trimmed, with spaces between."""
    return F.concat_ws(" ", *(F.when(F.trim(p) != "", F.trim(p)) for p in parts))


def iso(ts: Column) -> Column:
    """A timestamp without a zone as ISO text in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_iso(s: Column) -> Column:
    """The timestamp without a zone of ISO text, with or without a fraction and Z; null for other text."""
    return F.try_to_timestamp(F.regexp_replace(s, "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")).cast("timestamp_ntz")


def slug_chain(s: Column) -> Column:
    return F.replace(F.replace(F.replace(F.lower(s), F.lit(" / "), F.lit("_")), F.lit(" & "), F.lit("_")), F.lit(" "), F.lit("_"))


def scores_of(scores: Column, ids: list[str]) -> Column:
    """(id, score) of the ids that the map has, in the order of ids; null if any of its values is outside 1..7."""
    bad = F.exists(F.map_values(scores), lambda v: v.isNull() | (v < 1) | (v > 7))
    found = F.transform(F.filter(F.array(*map(F.lit, ids)), lambda i: F.map_contains_key(scores, i)), lambda i: F.struct(i.alias("id"), F.element_at(scores, i).alias("score")))
    return F.when(~bad, found)


def allowed_few(values: Column, vocabulary: list[str], n: int = 3) -> Column:
    """The first n of the values that the vocabulary holds."""
    return F.slice(F.filter(values, lambda x: x.isin(vocabulary)), 1, n)


def later_wins(*maps: Column) -> Column:
    """Union of maps; of equal keys the last map's value. Null maps are empty."""
    none = F.create_map().cast("map<string,double>")

    def over(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    return reduce(over, (F.coalesce(m, none) for m in maps))


def deep_merge(base: Column, update: Column, depth: int = 2) -> Column:
    """JSON objects merged: objects in both are merged in turn, down to `depth` levels; anything else of the update replaces. Keys sort."""
    a, b = (F.from_json(F.coalesce(x, F.lit("{}")), "map<string,string>") for x in (base, update))
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))

    def quoted(v: Column) -> Column:
        # from_json gives strings without their quotes; what parses as JSON is left alone
        return F.when(v.isNull(), F.lit("null")).when(v.rlike(r'^\s*(\{.*\}|\[.*\]|-?[0-9][0-9.eE+-]*|true|false)\s*$'), v).otherwise(F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))

    def one(k: Column) -> Column:
        x, y, there = F.try_element_at(a, k), F.try_element_at(b, k), F.map_contains_key(b, k)
        objects = x.startswith("{") & y.startswith("{")
        merged = deep_merge(x, y, depth - 1) if depth > 1 else y
        return F.concat(F.lit('"'), k, F.lit('":'), F.when(F.coalesce(objects, F.lit(False)), merged).when(there, quoted(y)).otherwise(quoted(x)))

    return F.concat(F.lit("{"), F.array_join(F.transform(keys, one), ","), F.lit("}"))


def json_or_text(value: Column) -> Column:
    """A value for a JSON document: as it is where it parses as JSON, else as a string."""
    return F.when(F.try_parse_json(value).isNotNull(), value).otherwise(F.to_json(F.struct(value.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(value.alias("v")))) - 6))


def upload_fault(name: Column, size: Column, place: Column) -> Column:
    """Why a file of an upload isn't taken (extension, size, count), or null; place: its number in the upload, from 1."""
    extension = F.lower(F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(F.lit("")))
    return F.when(place > MAX_FILES, "too many files").when(~extension.isin(EXTENSIONS), "extension").when(size > MAX_BYTES, "too large")


def mapped_label(label: Column, aliases: dict[str, str]) -> Column:
    """The alias of a label, else that of the first known label which holds it or is held by it; null without any."""
    low = F.lower(label)
    exact = F.try_element_at(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)), low)
    part = F.element_at(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in aliases.items())), lambda p: F.contains(low, p["k"]) | F.contains(p["k"], low)), 1)["v"]
    near = F.exists(F.array(*map(F.lit, aliases)), lambda k: F.contains(low, k) | F.contains(k, low))
    return F.coalesce(exact, F.when(near, part))
