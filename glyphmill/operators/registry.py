"""Governance of a tag registry: lint, quality, integrity, diff, search, duplicates, proposals.

A registry is a DataFrame of tags: tag_id, canonical_name, definition, domain, category, value_type, status, replaced_by,
version, aliases (array), parents (array), from_2d. Rules are structs that are exploded, so each check is one scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

#: How much a tag can be seen in 2-d, in order.
EXTRACT_ORDER = {"yes": 3, "partial": 2, "no": 1}


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _issues(df: DataFrame, rules: list[tuple[Column, str, str]]) -> DataFrame:
    found = F.filter(F.array(*(F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for when, level, code in rules)), lambda x: x.isNotNull())
    return df.select("tag_id", F.explode(found).alias("i")).select("tag_id", "i.level", "i.code")


def lint(tags: DataFrame, strict: bool = False) -> DataFrame:
    """(tag_id, level, code) of each style rule a tag breaks."""
    name, text = F.col("canonical_name"), F.col("definition")
    there = ~_blank("definition")
    rules = [
        (~S.is_tag_id(F.col("tag_id")), "warning", "TID001"), (F.col("tag_id") != F.lower("tag_id"), "info", "TID002"),
        (_blank("canonical_name"), "error", "NAM001"), (name.rlike(r"^\p{Ll}"), "warning", "NAM002"), (~_blank("canonical_name") & (F.length(name) < 3), "info", "NAM003"),
        (~there, "warning", "DEF001"), (there & (F.length(text) < 20), "warning", "DEF002"), (there & ~S.ends_sentence(text), "info", "DEF003"), (S.starts_with_article(text), "info", "DEF004"), (F.contains(F.lower(text), F.lit("operational tag")), "warning", "DEF005"),
        (_blank("domain"), "warning", "DOM001"), (F.size("aliases") > F.size(F.array_distinct(F.transform("aliases", lambda x: F.lower(x)))), "warning", "ALI001"), (F.array_contains(F.transform("aliases", lambda x: F.lower(x)), F.lower(name)), "info", "ALI002"),
        (~F.lower("from_2d").isin("yes", "no", "partial", "n/a", "na", ""), "warning", "EXT002"), *((_blank(c), "error", f"REQ001:{c}") for c in ("canonical_name", "value_type", "status")),
    ]
    if strict:
        rules += [(~_blank("domain") & ~F.col("domain").rlike(r"^[A-Z]\.\s"), "info", "DOM002"), (F.col("from_2d").isNull(), "info", "EXT001"), *((_blank(c), "info", f"REQ002:{c}") for c in ("definition", "domain", "category"))]
    return _issues(tags, [(F.coalesce(w, F.lit(False)), lv, c) for w, lv, c in rules])


def quality(tags: DataFrame) -> DataFrame:
    """Score out of the points that definition, required fields, domain, extractability and aliases can give here (75), and a percentage of 100."""
    text = F.coalesce("definition", F.lit(""))
    d = F.when(text == "", 0).otherwise(F.when(F.length(text) >= 50, 10).when(F.length(text) >= 20, 5).otherwise(0) + F.when(F.contains(F.lower(text), F.lit("operational tag")), 0).otherwise(10) + F.when(F.trim(text).rlike(r"[.?!]$"), 5).otherwise(0) + F.when(S.starts_with_article(text), 0).otherwise(5))
    required = sum((F.when(_blank(c), 0).otherwise(5) for c in ("canonical_name", "value_type", "status", "category")), F.lit(0))
    score = d + required + F.when(_blank("domain"), 0).otherwise(10) + F.when(_blank("from_2d"), 0).otherwise(5) + F.least(F.coalesce(F.size("aliases"), F.lit(0)) * 2, F.lit(10))
    band = F.when(F.col("percentage") >= 80, "excellent").when(F.col("percentage") >= 60, "good").when(F.col("percentage") >= 40, "fair").otherwise("poor")
    return tags.select("tag_id", "domain", d.alias("definition_score"), score.alias("score")).withColumn("percentage", F.bround(F.col("score").cast("double"), 1)).withColumn("band", band)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(tag_id, severity, change) between two versions of a registry."""
    cols = ["value_type", "status", "from_2d", "definition", "aliases"]
    a = old.select("tag_id", F.struct(*cols).alias("a"))
    b = new.select("tag_id", F.struct(*cols).alias("b"))
    j = a.join(b, "tag_id", "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    order = F.create_map(*(x for k, v in EXTRACT_ORDER.items() for x in (F.lit(k), F.lit(v))))

    def rank(c: Column) -> Column:
        return F.coalesce(F.try_element_at(order, F.coalesce(c, F.lit("?"))), F.lit(0))

    rules = [
        (F.col("b").isNull(), "BREAKING", "TAG_REMOVED"), (F.col("a").isNull(), "INFO", "TAG_ADDED"), (both & ~F.col("a.value_type").eqNullSafe(F.col("b.value_type")), "BREAKING", "VALUE_TYPE_CHANGED"),
        (both & ~F.col("a.status").eqNullSafe(F.lit("deprecated")) & (F.col("b.status") == "deprecated"), "WARNING", "TAG_DEPRECATED"), (both & (rank(F.col("a.from_2d")) > rank(F.col("b.from_2d"))), "WARNING", "EXTRACTABILITY_DOWNGRADE"),
        (both & (F.col("a.definition") != F.col("b.definition")) & (F.col("a.definition") != "") & (F.col("b.definition") != ""), "INFO", "DEFINITION_CHANGED"), (both & (F.size(F.array_except("b.aliases", "a.aliases")) > 0), "INFO", "ALIASES_ADDED"),
    ]
    return _issues(j, [(F.coalesce(w, F.lit(False)), s, c) for w, s, c in rules]).withColumnsRenamed({"level": "severity", "code": "change"})


def shared_aliases(tags: DataFrame) -> DataFrame:
    """Aliases, whatever their case, of more than one tag."""
    a = tags.select("tag_id", F.explode("aliases").alias("alias")).select("tag_id", F.lower("alias").alias("alias")).distinct()
    return a.groupBy("alias").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("tag_id")).alias("tag_ids")).where("n > 1")


def dangling(tags: DataFrame, refs: str = "parents") -> DataFrame:
    """References to tags that don't exist."""
    r = tags.select("tag_id", F.explode(refs).alias("ref"))
    return r.join(tags.select(F.col("tag_id").alias("ref")), "ref", "left_anti").select("tag_id", "ref")


def replacement_cycles(tags: DataFrame) -> DataFrame:
    """Tags whose chain of replacements comes back to them, however long it is. Ids are unique.

    Pointer doubling: each round joins the jumps so far with themselves, so they're twice as long. After as many steps as there are
    links, a chain that hasn't ended is on a cycle, and all tags of cycles are where such chains then are.
    """
    jump = tags.where("replaced_by is not null").select("tag_id", F.col("replaced_by").alias("next")).checkpoint()
    for _ in range(jump.count().bit_length()):
        jump = jump.join(jump.select(F.col("tag_id").alias("next"), F.col("next").alias("then")), "next").select("tag_id", F.col("then").alias("next")).checkpoint()
    return jump.select(F.col("next").alias("tag_id")).distinct()


def validity(wanted: DataFrame, tags: DataFrame) -> DataFrame:
    """Per wanted tag_id: whether it exists, is active or deprecated, and what replaces it."""
    j = wanted.select("tag_id").distinct().join(tags.select("tag_id", "status", "replaced_by"), "tag_id", "left")
    return j.select("tag_id", F.col("status").isNotNull().alias("exists"), F.coalesce(F.col("status") == "active", F.lit(False)).alias("active"), F.coalesce(F.col("status") == "deprecated", F.lit(False)).alias("deprecated"), "replaced_by")


def coverage(tags: DataFrame, fields: list[str]) -> DataFrame:
    """Per field the share of tags that have it."""
    counts = tags.agg(F.count("*").alias("n"), *(F.count_if(~_blank(f)).alias(f) for f in fields))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("filled"), F.col("n").alias("total")) for f in fields))).alias("x")).select("x.*").withColumn("percent", F.bround(F.try_divide(100 * F.col("filled"), F.col("total")), 1))


def frequency(tags: DataFrame, column: str) -> DataFrame:
    return tags.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count("*").alias("n"))


def autocomplete(tags: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Tags whose id, name, or a word of whose name starts with the prefix, in this order."""
    p = F.lit(prefix.lower())
    rank = F.when(F.startswith(F.lower("tag_id"), p), 0).when(F.startswith(F.lower("canonical_name"), p), 1).when(F.exists(F.split(F.lower("canonical_name"), " "), lambda w: F.startswith(w, p)), 2)
    return tags.select("tag_id", "canonical_name", rank.alias("rank")).where("rank is not null").orderBy("rank", "tag_id").limit(limit)


def resolve(tags: DataFrame, term: str, limit: int = 10) -> DataFrame:
    return tags.where(F.contains(F.lower(F.concat_ws(" | ", "tag_id", F.array_join("aliases", " | "))), F.lit(term.lower()))).orderBy("tag_id").limit(limit)


def fuzzy_search(tags: DataFrame, term: str, cutoff: float = 0.6, limit: int = 20) -> DataFrame:
    """Tags by their best match of id, name or alias: 1.0 for a substring, 0.9 for a shared word part, else the stdlib's sequence ratio."""
    q = term.lower()

    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from difflib import SequenceMatcher

        for s in batches:
            yield s.map(lambda x: SequenceMatcher(None, q, x).ratio() if x is not None else 0.0).astype("float64")

    slow = F.pandas_udf(ratio, "double")
    t = F.col("t")
    each = tags.select("tag_id", F.explode(F.array_compact(F.concat(F.array("tag_id", "canonical_name"), F.coalesce("aliases", F.array())))).alias("t")).select("tag_id", F.lower("t").alias("t"))
    part = F.exists(F.split(F.lit(q), " "), lambda w: (w != "") & F.contains(t, w))
    score = F.when(F.contains(t, F.lit(q)), 1.0).when(part, 0.9).otherwise(slow(t))
    # only what shares enough characters is compared
    shared = sum((F.least(F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))), F.lit(q.count(c))) for c in sorted(set(q))), F.lit(0))
    may = F.contains(t, F.lit(q)) | part | (F.try_divide(2.0 * shared, F.length(t) + len(q)) >= cutoff - 1e-9)
    return each.where(may).withColumn("score", score).groupBy("tag_id").agg(F.max("score").alias("score")).where(F.col("score") >= cutoff).orderBy(F.desc("score"), "tag_id").limit(limit)


def review(proposals: DataFrame, reviews: DataFrame) -> DataFrame:
    """A proposal's status after its reviews: the first that decides wins; later ones are refused."""
    decisive = reviews.where(F.col("action").isin("approve", "reject"))
    first = decisive.groupBy("proposal_id").agg(F.min_by("action", F.struct("reviewed_at", "review_id")).alias("action"), F.count("*").alias("n"))
    j = proposals.where("status = 'pending'").join(first, "proposal_id", "left")
    changed = j.select("proposal_id", F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected").otherwise("pending").alias("status"), F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0)).alias("refused"))
    return changed.unionByName(proposals.where("status <> 'pending'").select("proposal_id", "status", F.lit(0).cast("long").alias("refused")))


def merge_approved(tags: DataFrame, proposals: DataFrame) -> DataFrame:
    """Registry after approved proposals (kind new, modify or deprecate; definition null keeps the old one), with an error where one can't apply."""
    p = proposals.where("status = 'approved'").select("tag_id", "kind", F.col("definition").alias("new_definition"))
    j = tags.select("tag_id", "definition", "status").withColumn("there", F.lit(True)).join(p, "tag_id", "full")
    there = F.coalesce("there", F.lit(False))
    error = F.when((F.col("kind") == "new") & there, "already exists").when(F.col("kind").isin("modify", "deprecate") & ~there, "not found")
    out = j.withColumn("error", error)
    return out.select("tag_id", F.when(F.col("error").isNull(), F.coalesce("new_definition", "definition")).otherwise(F.col("definition")).alias("definition"), F.when((F.col("kind") == "deprecate") & there, "deprecated").when(there, F.col("status")).when(F.col("error").isNull(), "active").alias("status"), "error")


def bulk_update(tags: DataFrame, where: Column, updates: dict[str, Column], version: str) -> DataFrame:
    """Update matching tags, and stamp the version only on those that change."""
    new = {c: F.when(where, v).otherwise(F.col(c)) for c, v in updates.items()}
    changed = F.lit(False)
    for c, v in new.items():
        changed = changed | ~v.eqNullSafe(F.col(c))
    return tags.withColumns({**new, "version": F.when(changed, F.lit(version)).otherwise(F.col("version")), "changed": changed})
