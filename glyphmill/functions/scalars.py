"""Column functions: text, dates, binning, arrays and lenient JSON. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- text


def title_label(key: Column) -> Column:
    """Last dotted segment, underscores to spaces, words capitalised."""
    return F.initcap(F.replace(F.substring_index(key, ".", -1), F.lit("_"), F.lit(" ")))


def namespace(key: Column) -> Column:
    return F.substring_index(key, ".", 1)


def slug(s: Column, limit: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.translate(s, " -/", "___")), "[^a-z0-9_]", "_"), 1, limit)


def strip_html(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(s, "<.*?>", ""), r"\s+", " "))


def without_digits(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\d+", ""))


def path_template(path: Column) -> Column:
    """Numeric path segments to {id}, then UUIDs to {uuid}."""
    return F.regexp_replace(F.regexp_replace(path, r"/\d+", "/{id}"), "/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "/{uuid}")


def is_tag_id(s: Column) -> Column:
    return s.rlike(r"(?i)^[a-z][a-z0-9_]*(\.[a-z0-9_/()+-]+){1,5}$")


def starts_with_article(s: Column) -> Column:
    return s.rlike(r"^(The|A|An)\s")


def ends_sentence(s: Column) -> Column:
    return F.rtrim(s).rlike(r"[.?!]$")


def fingerprint(s: Column, size: int = 16) -> Column:
    return F.substring(F.sha2(s, 256), 1, size)


def cache_key(s: Column) -> Column:
    return F.md5(s)


def glob_like(s: Column, pattern: str) -> Column:
    """Shell-style match: * any run, ? any character."""
    out = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c for c in pattern)
    return s.rlike(f"(?s)^{out}$")


def ids_in(s: Column) -> Column:
    """Comma-separated ids; what isn't a number is dropped."""
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x).try_cast("bigint")), lambda x: x.isNotNull())


def sanitised(s: Column, limit: int = 10000) -> Column:
    """Cut to a length (the reference's sanitize_string has this limit too), NULs out, HTML characters escaped."""
    out = F.replace(F.substring(s, 1, limit), F.lit("\0"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def image_url(path: Column, base: str = "/static/thumbs/") -> Column:
    return F.when(path.startswith("http"), path).otherwise(F.concat(F.lit(base), path))


# --- numbers


def clamp01(x: Column) -> Column:
    """Between 0 and 1; not a number is 0, null stays null (least and greatest would skip it)."""
    return F.when(F.isnan(x), F.lit(0.0)).when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def index_bin(x: Column) -> Column:
    return F.when(x < 0.33, "low").when(x < 0.66, "mid").otherwise("high")


def agreement_bin(x: Column) -> Column:
    return F.when(x < 0.4, "low").when(x < 0.7, "medium").otherwise("high")


def node_bin(x: Column) -> Column:
    """Upper-case bins of a text column; what isn't a number is MID, NaN is HIGH."""
    n = x.try_cast("double")
    return F.when(n.isNull(), "MID").when(n < 0.33, "LOW").when(n < 0.66, "MID").otherwise("HIGH")


def bin_label(code: Column) -> Column:
    return F.when(code == 0, "low").when(code == 1, "mid").when(code == 2, "high")


def likert_share(x: Column) -> Column:
    return F.bround((x - 1) / 6, 3)


def inverted_u(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), 1 - 2 * F.abs(x - 0.5)))


def squash(x: Column, mid: float, scale: float) -> Column:
    return 1 / (1 + F.exp(-(x - mid) / scale))


def db_sum(a: Column, b: Column) -> Column:
    return 10 * F.log10(F.pow(F.lit(10.0), a / 10) + F.pow(F.lit(10.0), b / 10))


def surface_weight(depth: Column) -> Column:
    return 1 + 1.5 * F.pow(depth, 1.35)


def restorativeness(nat: Column, entropy: Column, clutter: Column, load: Column) -> Column:
    """Weighted mean of what's there of four cues; null with fewer than two."""
    terms = [(0.4, nat, clamp01(nat)), (0.3, entropy, inverted_u(clamp01(entropy))), (0.15, clutter, 1 - clamp01(clutter)), (0.15, load, 1 - clamp01(load))]
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for w, x, _ in terms), F.lit(0.0))
    total = sum((F.when(x.isNotNull(), w * t).otherwise(0.0) for w, x, t in terms), F.lit(0.0))
    there = sum((x.isNotNull().cast("int") for _, x, _ in terms), F.lit(0))
    return F.when(there >= 2, total / weight)


# --- arrays and JSON


def merge_ignoring_case(a: Column, b: Column) -> Column:
    """a, then what of b isn't in it, whatever the case."""
    low = F.transform(a, lambda x: F.lower(x))
    return F.concat(a, F.filter(b, lambda x: ~F.array_contains(low, F.lower(x))))


def lenient_json(s: Column) -> Column:
    """The text of the JSON object in a model's answer: fences off, else from the first { to the last }; null if none parses."""
    plain = F.trim(s)
    fenced = F.regexp_extract(plain, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    return F.coalesce(*(F.when(F.try_parse_json(c).isNotNull() & (c != ""), c) for c in (plain, fenced, braces)))


def last_json_line(s: Column) -> Column:
    return F.try_element_at(F.filter(F.split(s, "\n"), lambda x: F.trim(x).startswith("{")), F.lit(-1))
