"""Readers and writers of the formats that collections come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_IMAGE = "filename string, name string, url string, path string, storage_path string, tags array<string>, meta_data struct<width:int,height:int,source:string>"


def read_image_json(spark: SparkSession, path: str) -> DataFrame:
    """A file holding a list of images or {"images": [...]}; name and place by whichever key is there."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    rows = whole.select(F.explode(F.when(F.col("v").startswith("["), F.from_json("v", f"array<struct<{_colons(_IMAGE)}>>")).otherwise(F.from_json("v", f"images array<struct<{_colons(_IMAGE)}>>").images)).alias("i")).select("i.*")
    name, place = F.coalesce("filename", "name"), F.coalesce("url", "path", "storage_path")
    return rows.select(F.coalesce(name, F.element_at(F.split(place, "/"), -1)).alias("filename"), place.alias("storage_path"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "meta_data")


def _colons(ddl: str) -> str:
    return ",".join(x if "<" in x.split(" ")[0] else x.replace(" ", ":", 1) for x in ddl.split(", "))


def new_rows(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't there yet, one for each key."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def read_record_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, fields map) of line-oriented lists: `- id: x` starts a record, `key: value` lines follow; anything before is left out.

    Records are numbered in their file. Of a key that a record has twice the last value counts.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    pair = lines.select("file", "pos", F.col("line").rlike(r"^\s*-\s+\w+\s*:").alias("start"), F.regexp_extract("line", r"^\s*-?\s*(\w+)\s*:", 1).alias("k"), F.trim(F.regexp_replace(F.regexp_extract("line", r"^\s*-?\s*\w+\s*:\s*(.*)$", 1), r"""^["']|["']$""", "")).alias("v"))
    numbered = pair.withColumn("record", F.sum(F.col("start").cast("int")).over(W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    last = numbered.where((F.col("record") > 0) & (F.col("k") != "")).groupBy("file", "record", "k").agg(F.max_by("v", "pos").alias("v"))
    return last.groupBy("file", "record").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("fields"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that don't parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV with a header; all columns text. Fails if a required column is missing."""
    df = spark.read.option("header", True).csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_images(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png}", recursive: bool = True) -> DataFrame:
    """Images decoded by the JVM (bytes in BGR order), with their path as id; what isn't an image is left out."""
    return spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path).select(F.col("image.origin").alias("id"), "image.height", "image.width", "image.nChannels", "image.data")


def read_registry_yaml(spark: SparkSession, path: str) -> DataFrame:
    """A nested YAML registry (one document, read through Spark) as rows of tags."""
    import yaml

    doc = yaml.safe_load(spark.read.text(path, wholetext=True).orderBy(F.input_file_name()).first()[0]) or {}
    rows = [(k, t.get("canonical_name"), t.get("definition"), t.get("domain"), t.get("category"), t.get("value_type"), t.get("status"), t.get("replaced_by"), str(doc.get("version") or ""), (t.get("semantics") or {}).get("aliases") or [], t.get("parents") or [], (t.get("extractability") or {}).get("from_2d")) for k, t in (doc.get("tags") or {}).items() if isinstance(t, dict)]
    text, texts = T.StringType(), T.ArrayType(T.StringType())
    names = ["tag_id", "canonical_name", "definition", "domain", "category", "value_type", "status", "replaced_by", "version", "aliases", "parents", "from_2d"]
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, texts if n in ("aliases", "parents") else text) for n in names]))


def manifest(spark: SparkSession, path: str, exclude: str | None = None) -> DataFrame:
    """(path, size, sha256) of the files under a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return f.where(~F.col("path").rlike(exclude)) if exclude else f


def compare_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state): changed, missing or new."""
    j = old.select("path", F.col("sha256").alias("a")).join(new.select("path", F.col("sha256").alias("b")), "path", "full")
    return j.select("path", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "changed").alias("state")).where("state is not null")


def recent(events: DataFrame, order: str, n: int) -> DataFrame:
    return events.orderBy(F.desc(order)).limit(n)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        c = df.agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        out = c if out is None else out.union(c)
    return out


# --- writers


def write_attributes(rows: DataFrame, known: DataFrame, path: str) -> None:
    """Append attribute rows whose key is registered; what isn't a number is 0."""
    rows.join(known.select("attribute_key"), "attribute_key", "left_semi").withColumn("value", F.nanvl("value", F.lit(0.0))).write.mode("append").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Nested fields are flattened to dotted names."""
    flat = []
    for f in df.schema:
        flat += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}.{g.name}") for g in f.dataType] if isinstance(f.dataType, T.StructType) else [F.array_join(F.col(f"`{f.name}`").cast("array<string>"), ";").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`")]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def prometheus(df: DataFrame, metric: str, labels: list[str], value: str) -> DataFrame:
    """Lines of the text exposition format."""
    inner = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels))
    return df.select(F.concat(F.lit(metric + "{"), inner, F.lit("} "), F.col(value).cast("string")).alias("line"))


def ragged_union(parts: list[DataFrame]) -> DataFrame:
    """All rows with all columns of any part, in order of first appearance; null where a part lacks one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def health_runs(files: DataFrame, root: str) -> DataFrame:
    """files: path, modificationTime (as a binaryFile listing has them). Per run folder under root the latest time and which results are there, newest first."""
    inside = F.regexp_extract("path", f"{root}/([^/]+)/(.*)$", 1)
    name = F.regexp_extract("path", f"{root}/([^/]+)/(.*)$", 2)
    r = files.select(inside.alias("run_id"), name.alias("name"), "modificationTime").where("run_id <> ''").groupBy("run_id")
    return r.agg(F.max("modificationTime").alias("created_at"), *(F.bool_or(F.col("name") == f).alias(k) for k, f in (("has_variance_audit", "derived/vlm_variance_audit.csv"), ("has_turing_summary", "derived/vlm_turing_summary.txt")))).orderBy(F.desc("created_at"), F.desc("run_id"))


def log_rows(lines: DataFrame, context: str) -> DataFrame:
    """lines: value (a JSON object a line). Level, time, message and the request's context of structured log lines; others are left out."""
    kind = f"level string, timestamp string, logger string, message string, context struct<{_colons(context)}>"
    return lines.select(F.from_json("value", kind).alias("r")).select("r.*").where("level is not null")
