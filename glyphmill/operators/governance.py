"""Governance around a registry: keys, proposals, releases, contracts for consumers, reports and generated definitions.

Registries have the columns that operators/registry.py names; proposals are rows (id, kind, tag_id, status, submitter,
created_at), keys rows (id, role, created_at, last_used_at, revoked_at, expires_at). Nothing here reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Kinds of proposals.
KINDS = {"new_tag": "tags_added", "modify_tag": "tags_modified", "deprecate_tag": "tags_removed"}
#: What a batch row has where the file leaves it out.
IMPORT_DEFAULTS = {"canonical_name": "", "status": "active", "value_type": "ordinal", "domain": "", "definition": "", "category": "environmental"}
#: The sentence that a generated definition begins with, by a word in the id (or the domain), the first that fits.
SUBJECTS = [
    ("lighting", "luminous", "Quantifies {} characteristics of the lighting environment"),
    ("color", None, "Measures {} properties of color in the space"),
    ("spatial", "geometry", "Characterizes {} aspects of spatial configuration"),
    ("biophil", None, "Assesses {} presence of biophilic design elements"),
    ("social", None, "Evaluates {} social and privacy characteristics"),
    ("affect", None, "Captures the perceived {} quality of the environment"),
    (None, None, "Measures {} attributes of the built environment"),
]
#: How a type of value is put in words.
SCALES = {"binary": "Expressed as presence or absence", "ordinal": "Rated on an ordered scale", "continuous": "Measured as a continuous value"}


def _given(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


# --- keys


def active_keys(keys: DataFrame, now: Column) -> DataFrame:
    """Keys neither revoked nor expired; one that expires at this moment still counts."""
    return keys.where(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") >= now)))


def expire_keys(keys: DataFrame, now: Column, days: int) -> DataFrame:
    """Keys after those unused for `days` (or never used, and as old) are revoked; `expired` marks them."""
    cutoff = now - F.make_interval(days=F.lit(days))
    idle = F.col("revoked_at").isNull() & (F.col("last_used_at").isNull() | (F.col("last_used_at") < cutoff)) & (F.col("created_at") < cutoff)
    idle = F.coalesce(idle, F.lit(False))
    return keys.withColumns({"expired": idle, "revoked_at": F.when(idle, now).otherwise(F.col("revoked_at"))})


def revoke(keys: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Revoke the given ids; a key that's revoked already keeps its time."""
    j = keys.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return j.withColumn("revoked_at", F.when(F.col("__hit") & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at"))).drop("__hit")


# --- proposals and releases


def batch_proposals(rows: DataFrame, pending: DataFrame, order: list[str]) -> DataFrame:
    """Rows of an import with `outcome` (created, no id, or pending) and, where created, the payload as JSON.

    A row is skipped if a proposal of its tag is pending, or an earlier row of the batch (in `order`) has made one.
    """
    filled = {c: F.when(_given(c), F.col(c)).otherwise(F.lit(v)) if c in rows.columns else F.lit(v) for c, v in IMPORT_DEFAULTS.items()}
    seen = {k: F.when(_given(c), F.col(c)) for c, k in (("extractability_2d", "from_2d"), ("extractability_3d", "from_3d_vr")) if c in rows.columns}
    payload = F.to_json(F.struct(*(e.alias(c) for c, e in filled.items()), *([F.when(F.coalesce(*seen.values()).isNotNull(), F.struct(*(e.alias(k) for k, e in seen.items()))).alias("extractability")] if seen else [])))
    known = pending.select("tag_id").distinct().withColumn("__open", F.lit(True))
    first = F.row_number().over(W.partitionBy("tag_id").orderBy(*order)) == 1
    j = rows.withColumn("__first", first).join(known, "tag_id", "left")
    outcome = F.when(~_given("tag_id"), "no id").when(F.col("__open").isNotNull() | ~F.col("__first"), "pending").otherwise("created")
    return j.withColumn("outcome", outcome).withColumn("payload", F.when(F.col("outcome") == "created", payload)).drop("__first", "__open")


def release_summary(proposals: DataFrame) -> DataFrame:
    """One row: pending proposals, whether a release may be made, and what it would merge by kind."""
    counts = proposals.agg(F.count_if(F.col("status") == "pending").alias("pending"), *(F.count_if((F.col("status") == "approved") & (F.col("kind") == k)).alias(n) for k, n in KINDS.items()))
    return counts.withColumn("allowed", F.col("pending") == 0)


def release(proposals: DataFrame) -> DataFrame:
    """Proposals after a release: approved ones are merged, unless any is pending: then nothing changes."""
    gate = proposals.agg((F.count_if(F.col("status") == "pending") == 0).alias("__allowed"))
    j = proposals.join(F.broadcast(gate))  # one row
    return j.withColumn("status", F.when(F.col("__allowed") & (F.col("status") == "approved"), "merged").otherwise(F.col("status"))).drop("__allowed")


def list_proposals(proposals: DataFrame, status: str | None = None, submitter: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, of equal times the greatest id; only of a status and submitter where given."""
    out = proposals
    for c, v in (("status", status), ("submitter", submitter)):
        out = out.where(F.col(c) == v) if v else out
    return out.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def audit_rows(changes: DataFrame, action: str, user: Column, kind: str, target: Column, at: Column, details: list[str]) -> DataFrame:
    """A row of the audit log for each change; details as JSON."""
    return changes.select(F.lit(action).alias("action"), user.alias("user_id"), F.lit(kind).alias("target_type"), target.cast("string").alias("target_id"), F.to_json(F.struct(*details)).alias("details"), at.alias("created_at"))


# --- contracts


def contract(tags: DataFrame, consumer: str) -> DataFrame:
    """The columns of the registry that a consumer is promised."""
    if consumer == "annotator":
        return tags.select("tag_id", "value_type", F.struct("from_2d").alias("extractability"))
    if consumer == "article_eater":
        # without search terms the name is searched for
        own = F.filter(F.coalesce("search_terms", F.array()), lambda x: x != "") if "search_terms" in tags.columns else F.array().cast("array<string>")
        return tags.select("tag_id", "status", F.when(F.size(own) > 0, own).when(_given("canonical_name"), F.array("canonical_name")).otherwise(F.array().cast("array<string>")).alias("search_terms"), F.coalesce("aliases", F.array()).alias("aliases"))
    if consumer == "bn":
        named = [c for c in ("demand_state", "evidence_role", "consumable") if c in tags.columns]
        return tags.select("tag_id", F.struct(*named, F.col("parents").alias("parent_tags")).alias("bn"))
    if consumer == "preference_testing":
        return tags.select("tag_id", "value_type", "definition")
    raise ValueError(f"no contract for {consumer}")


def latest_contract(files: DataFrame, consumer: str) -> DataFrame:
    """files: name. The last in order of name whose name holds the consumer's, whatever the case; no row if none does."""
    return files.where(F.contains(F.lower("name"), F.lit(consumer.lower()))).agg(F.max("name").alias("name")).where("name is not null")


def compliance(used: DataFrame, allowed: DataFrame, coverage: bool = False) -> DataFrame:
    """Violations of a contract (tag_id, violation, severity, message): used tags that it lacks or deprecates; with coverage also those unused."""
    j = used.select("tag_id").distinct().withColumn("__used", F.lit(True)).join(allowed.select("tag_id", "status", "replaced_by").withColumn("__in", F.lit(True)), "tag_id", "full")
    unknown, old, unused = F.col("__in").isNull(), F.col("__used").isNotNull() & (F.col("status") == "deprecated"), F.col("__used").isNull()
    kind = F.when(unknown, "not_in_contract").when(old, "deprecated").when(unused & F.lit(coverage), "unused")
    text = (
        F.when(unknown, F.concat(F.lit("Tag '"), "tag_id", F.lit("' is not in the contract")))
        .when(old, F.concat(F.lit("Tag '"), "tag_id", F.lit("' is deprecated"), F.when(_given("replaced_by"), F.concat(F.lit(". Use '"), "replaced_by", F.lit("'"))).otherwise(F.lit(""))))
        .otherwise(F.concat(F.lit("Contract tag '"), "tag_id", F.lit("' is not being used")))
    )
    severity = F.when(kind == "not_in_contract", "error").when(kind == "deprecated", "warning").otherwise("info")
    return j.select("tag_id", kind.alias("violation"), severity.alias("severity"), text.alias("message")).where("violation is not null")


# --- reports


def validation_report(tags: DataFrame) -> DataFrame:
    """(section, key, n): completeness, quality, consistency and distribution of a registry, from one pass and its alias counts."""
    fields = ["canonical_name", "value_type", "status", "definition", "domain", "category"]
    text = F.col("definition")
    flags = {
        **{("completeness", f): _given(f) for f in fields},
        ("completeness", "missing_required"): ~(_given("canonical_name") & _given("value_type") & _given("status") & _given("definition")),
        ("quality", "too_short"): _given("definition") & (F.length(text) < 20), ("quality", "placeholder"): _given("definition") & F.contains(F.lower(text), F.lit("operational tag")), ("quality", "no_punctuation"): _given("definition") & ~F.trim(text).rlike(r"[.?!]$"),
        ("distribution", "from_2d_yes"): F.coalesce(F.col("from_2d") == "yes", F.lit(False)),
    }
    one = tags.agg(*(F.count_if(v).alias(f"f{i}") for i, v in enumerate(flags.values())), F.count("*").alias("n"))
    cells = [F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), F.col(f"f{i}").alias("n")) for i, (s, k) in enumerate(flags)] + [F.struct(F.lit("metadata").alias("section"), F.lit("total_tags").alias("key"), F.col("n"))]
    out = one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    for c in ("domain", "value_type", "status"):
        out = out.union(tags.groupBy(F.coalesce(c, F.lit("NONE")).alias("key")).agg(F.count("*").alias("n")).select(F.lit(c).alias("section"), "key", "n"))
    shared = tags.select("tag_id", F.explode("aliases").alias("a")).groupBy(F.lower("a").alias("a")).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("n"))
    return out.union(shared.select(F.lit("consistency"), F.lit("duplicate_aliases"), "n"))


def report_issues(report: DataFrame) -> DataFrame:
    """(severity, category, message) of the counts of a validation report that call for attention."""
    rules = [("missing_required", "error", "completeness", "tags missing required fields"), ("placeholder", "warning", "quality", "tags have placeholder definitions"), ("duplicate_aliases", "warning", "consistency", "duplicate aliases found")]
    out = None
    for key, severity, section, text in rules:
        r = report.where((F.col("section") == section) & (F.col("key") == key) & (F.col("n") > 0)).select(F.lit(severity).alias("severity"), F.lit(section).alias("category"), F.concat(F.col("n").cast("string"), F.lit(f" {text}")).alias("message"))
        out = r if out is None else out.union(r)
    return out


def documentation_stats(tags: DataFrame, by: list[str]) -> DataFrame:
    """(field, value, n, extractable): per value of each field the number of tags, and of those that can be seen in 2-d."""
    out = None
    for c in by:
        r = tags.groupBy(F.coalesce(F.col(c), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"), F.count_if(F.col("from_2d") == "yes").alias("extractable")).select(F.lit(c).alias("field"), "value", "n", "extractable")
        out = r if out is None else out.union(r)
    return out


def generated_definitions(tags: DataFrame) -> DataFrame:
    """(tag_id, old_definition, new_definition) of tags whose definition is missing, short or a placeholder."""
    text, low = F.coalesce("definition", F.lit("")), F.lower("tag_id")
    poor = (text == "") | F.contains(F.lower(text), F.lit("operational tag")) | (F.length(text) < 20)
    name = F.lower(F.coalesce("canonical_name", "tag_id"))
    first = None
    for word, domain, sentence in SUBJECTS:
        fits = F.lit(True) if word is None else F.contains(low, F.lit(word))
        fits = fits | F.contains(F.lower(F.coalesce("domain", F.lit(""))), F.lit(domain)) if domain else fits
        said = F.concat(F.lit(sentence.split("{}")[0]), name, F.lit(sentence.split("{}")[1]))
        first = F.when(fits, said) if first is None else first.when(fits, said)
    scale = None
    for kind, said in SCALES.items():
        scale = F.when(F.col("value_type") == kind, said) if scale is None else scale.when(F.col("value_type") == kind, said)
    return tags.where(poor).select("tag_id", F.col("definition").alias("old_definition"), F.concat(F.concat_ws(". ", first, scale), F.lit(".")).alias("new_definition"))


def filter_tags(tags: DataFrame, text: str | None = None, domains: list[str] | None = None, statuses: list[str] | None = None) -> DataFrame:
    """Tags whose id, name or definition holds a text (whatever the case), of the given domains and statuses."""
    out = tags
    if text:
        t = F.lit(text.lower())
        out = out.where(F.contains(F.lower("tag_id"), t) | F.contains(F.lower(F.coalesce("canonical_name", F.lit(""))), t) | F.contains(F.lower(F.coalesce("definition", F.lit(""))), t))
    for c, v in (("domain", domains), ("status", statuses)):
        out = out.where(F.col(c).isin(v)) if v else out
    return out


def markdown_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(line_no, line): rows as lines of a Markdown table after its two head lines."""
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "line_no long, line string")
    body = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in columns)), F.lit(" |"))
    # reports are short, so one task may number them
    return head.unionByName(rows.select((F.row_number().over(W.orderBy(*order)) + 1).cast("long").alias("line_no"), body.alias("line")))
