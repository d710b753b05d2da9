"""Keyed tables, logs, prediction bundles and sinks with contracts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from functools import reduce

import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortloom.functions.scalar import clip_probability, json_map
from cohortloom.operators.folds import cohort_hash
from cohortloom.operators.joins import require, unique_by
from cohortloom.operators.windows import drop_duplicates_keep


def read_keyed_table(spark: SparkSession, path: str, key: str, schema: str | StructType | None = None, sep: str = ",") -> DataFrame:
    """CSV with the record key as text; other columns follow the schema (inferred once when none is given)."""
    reader = spark.read.option("header", "true").option("sep", sep)
    if schema is None:
        inferred = reader.option("inferSchema", "true").csv(path).schema
        schema = StructType([StructField(f.name, StringType() if f.name == key else f.dataType) for f in inferred.fields])
    elif isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    fields = [StructField(f.name, StringType() if f.name == key else f.dataType) for f in schema.fields]
    return reader.schema(StructType(fields)).csv(path)


def discover_runs(spark: SparkSession, root: str, run_pattern: str, store_pattern: str = r"\.(parquet|db|sqlite)$") -> DataFrame:
    """(run, files, has_store, latest): catalog from file metadata only, newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime")
    files = files.withColumn("run", F.url_decode(F.regexp_extract("path", run_pattern, 1))).where(F.col("run") != "")
    return (
        files.groupBy("run")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.max(F.col("path").rlike(store_pattern)).alias("has_store"),
            F.max("modificationTime").alias("latest"),
        )
        .orderBy(F.col("latest").desc(), "run")
    )


def read_history_logs(spark: SparkSession, root: str, schema: str, parts: dict[str, str]) -> DataFrame:
    """Per-epoch CSV logs under a folder tree; each column of ``parts`` is a pattern group on the file path."""
    logs = spark.read.option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").schema(schema)
    path = F.col("_metadata.file_path")
    return logs.csv(root).select("*", *[F.url_decode(F.regexp_extract(path, p, 1)).alias(c) for c, p in parts.items()])


# The names older and newer trial exports use for the same field.
TRIAL_ALIASES = {
    "number": ("number", "trial", "trial_number"),
    "params_json": ("params_json", "parameters", "parameters_json"),
    "value": ("value", "objective_log_loss"),
    "state": ("state",),
    "study": ("study", "study_name"),
}


def normalize_trials(logs: Sequence[DataFrame]) -> DataFrame:
    """Trial rows of several schemas as one: aliases merged, state in capitals, parameters also as a map."""
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)
    cols = []
    for name, aliases in TRIAL_ALIASES.items():
        found = [F.col(a).cast("string") for a in aliases if a in raw.columns]
        merged = F.coalesce(*found) if found else F.lit(None).cast("string")
        kind = {"number": "bigint", "value": "double"}.get(name)
        cols.append((merged.try_cast(kind) if kind else F.upper(merged) if name == "state" else merged).alias(name))
    out = raw.select(*cols)
    value = F.when(~F.isnan("value") & (F.abs("value") != F.lit(float("inf"))), F.col("value"))
    return out.withColumn("value", value).withColumn("params", json_map(F.col("params_json")))


def read_trial_log(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return normalize_trials([spark.read.json(p) for p in paths])


def below(file: Column, root: str) -> Column:
    """Path of a file below ``root`` (its own name where ``root`` is the file), so that equal names in two folders differ."""
    folder = re.escape(re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", root).rstrip("/"))
    inner = F.regexp_extract(file, folder + r"/(.+)$", 1)
    return F.when(inner != "", inner).otherwise(F.regexp_extract(file, r"([^/]+)$", 1))


def read_tolerant(spark: SparkSession, path: str, schema: str, fmt: str = "csv", **options: str) -> tuple[DataFrame, DataFrame]:
    """(rows, warnings): corrupt files and lines are skipped; warnings name the files without a row and the bad lines."""
    corrupt = "_corrupt"
    typed = StructType.fromDDL(schema)
    text = fmt in ("csv", "json")
    full = StructType([*typed.fields, StructField(corrupt, StringType())]) if text else typed
    reader = spark.read.schema(full).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if text:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
    for k, v in options.items():
        reader = reader.option(k, v)
    raw = reader.format(fmt).load(path)
    if "pathGlobFilter" not in options:
        options = {**options, "pathGlobFilter": "*"}
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", options["pathGlobFilter"])
    named = raw.withColumn("_file", below(F.url_decode(F.col("_metadata.file_path")), path))
    seen = named.select("_file").distinct()
    files = listed.load(path).select(below(F.col("path"), path).alias("_file"))
    warnings = files.join(seen, "_file", "left_anti").select(F.col("_file").alias("file"), F.lit("no readable row").alias("warning"))
    if text:
        # Spark refuses a scan of the corrupt column alone, so the count also touches the data columns
        one = F.lit(1) + F.pmod(F.xxhash64(*typed.names), F.lit(1))
        bad = named.where(F.col(corrupt).isNotNull()).groupBy("_file").agg(F.sum(one).alias("n"))
        bad = bad.select(F.col("_file").alias("file"), F.concat(F.col("n").cast("string"), F.lit(" malformed lines")).alias("warning"))
        return raw.where(F.col(corrupt).isNull()).drop(corrupt), warnings.unionByName(bad)
    return raw, warnings


# --- versioned tables --------------------------------------------------------------------------------------------------

# A table is a folder with ``data/<name>`` for the rows of every commit and ``log/<name>`` for one row that tells what it is.
# Names are unique, so writers never write to one place; a commit counts once its log file is there, which appears at once.
COMMIT = "name string, data string, kind string, number bigint, merged array<string>"


def commits(spark: SparkSession, path: str) -> list:
    """The log of a table: versions (kind ``table`` or ``compact``) and deltas."""
    try:
        log = spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(f"{path}/log")
    except AnalysisException:
        return []
    return sorted(log.collect(), key=lambda e: (e["number"], e["name"]))


def _newest(log: list):
    """The version that readers take: the highest number, of several the largest name."""
    done = [e for e in log if e["kind"] != "delta"]
    return done[-1] if done else None


def _on_top(log: list) -> list:
    """Deltas that the newest version doesn't hold, whoever wrote them and whatever version they were written on."""
    newest = _newest(log)
    merged = set(newest["merged"]) if newest is not None else set()
    return [e for e in log if e["kind"] == "delta" and e["name"] not in merged]


def _enter(spark: SparkSession, path: str, name: str, data: str, kind: str, number: int, merged: Sequence[str]) -> None:
    row = spark.createDataFrame([(name, data, kind, number, list(merged))], COMMIT)
    row.coalesce(1).write.parquet(f"{path}/log/{name}")


def _commit(df: DataFrame, path: str, kind: str, log: list, partition_by: Sequence[str] = ()) -> str:
    """Write rows and enter them in the log, after what the log held."""
    spark, name = df.sparkSession, f"{kind}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{path}/data/{name}")
    newest = _newest(log)
    number = newest["number"] if newest is not None else -1
    merged = [] if kind == "delta" else [e["name"] for e in log if e["kind"] == "delta"]
    _enter(spark, path, name, name, kind, number + (kind != "delta"), merged)
    return name


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions of a table."""
    return [e["number"] for e in commits(spark, path) if e["kind"] != "delta"]


def _deltas(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """(number of the newest version or -1, names of the deltas on top of it)."""
    log = commits(spark, path)
    newest = _newest(log)
    return newest["number"] if newest is not None else -1, [e["name"] for e in _on_top(log)]


def overwrite_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """All-or-nothing replacement by a new version; it replaces the deltas that were there before.

    Of two writers of one number the order is that of the names. Where another writer has meanwhile compacted the version
    before, which would bring its rows back, the replacement is entered once more behind it.
    """
    spark = df.sparkSession
    log = commits(spark, path)
    name = _commit(df, path, "table", log, partition_by)
    merged = [e["name"] for e in log if e["kind"] == "delta"]
    while (newest := _newest(commits(spark, path)))["kind"] == "compact" and newest["data"] != name:
        _enter(spark, path, f"table-{uuid.uuid4().hex}", name, "table", newest["number"] + 1, merged)


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    """Latest finished version, or None."""
    newest = _newest(commits(spark, path))
    return spark.read.parquet(f"{path}/data/{newest['data']}") if newest is not None else None


def append_delta(df: DataFrame, path: str) -> int:
    """Add rows without rewriting the table; returns how many deltas lie on the current version. Any number of writers may
    do so at the same time, also while another one compacts."""
    log = commits(df.sparkSession, path)
    _commit(df, path, "delta", log)
    return len(_on_top(log)) + 1


def _rows_of(spark: SparkSession, path: str, log: list, keys: Sequence[str], order: Sequence[str]) -> DataFrame | None:
    newest = _newest(log)
    parts = [e for e in [newest, *_on_top(log)] if e is not None]
    if not parts:
        return None
    tables = [spark.read.parquet(f"{path}/data/{e['data']}") for e in parts]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables)
    return drop_duplicates_keep(rows, keys, order, "last").select(*rows.columns)


def read_latest(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame | None:
    """Current version and its deltas, last row per key (one map-side aggregate)."""
    return _rows_of(spark, path, commits(spark, path), keys, order)


def compact(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Merge the current version and its deltas into a new version. Deltas that come meanwhile stay on top of it."""
    log = commits(spark, path)
    rows = _rows_of(spark, path, log, keys, order)
    if rows is not None:
        _commit(rows, path, "compact", log)


def drop_old(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` versions and the deltas that the oldest kept one holds; returns the number of
    commits dropped. Readers of dropped versions must have ended. For stores that pyarrow reaches."""
    log = commits(spark, path)
    kept = [e for e in log if e["kind"] != "delta"][-keep:]
    if not kept:
        return 0
    held = set(kept[0]["merged"])
    old = [e for e in log if (e["kind"] != "delta" and e not in kept) or (e["kind"] == "delta" and e["name"] in held)]
    store, root = pyarrow.fs.FileSystem.from_uri(path)
    for e in old:
        store.delete_dir(f"{root}/log/{e['name']}")
    for data in {e["data"] for e in old} - {e["data"] for e in kept}:
        store.delete_dir(f"{root}/data/{data}")
    return len(old)


def export_snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Every named table under ``path`` and a manifest (table, rows), also written."""
    manifest = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        row = df.sparkSession.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return manifest


# --- predictions -------------------------------------------------------------------------------------------------------


def contract_predictions(df: DataFrame, template: DataFrame, key: str, prob: str, order: str) -> DataFrame:
    """(key, prob) in template order: one finite probability per requested key, clipped; breaches raise at run time."""
    p = F.when(~F.isnan(prob) & (F.abs(F.col(prob)) != F.lit(float("inf"))), F.col(prob))
    rows = unique_by(df.select(key, p.alias(prob)), [key], "predictions")
    joined = unique_by(template.select(key, order), [key], "template").join(rows, key, "left")
    checked = require(joined, F.col(prob).isNotNull(), "a requested key has no finite probability")
    return checked.select(key, clip_probability(F.col(prob)).alias(prob), order)


def write_predictions(df: DataFrame, template: DataFrame, path: str, key: str, prob: str, order: str) -> None:
    """CSV in template order with exactly the columns (key, prob)."""
    contract_predictions(df, template, key, prob, order).orderBy(order).select(key, prob).write.mode("overwrite").option(
        "header", "true"
    ).csv(path)


def bundle_predictions(named: dict[str, DataFrame], key: str, label: str, prob: str) -> DataFrame:
    """(model, key, label, prob) of several prediction tables; repeated keys and bad probabilities raise at run time."""
    parts = [df.select(F.lit(name).alias("model"), F.col(key).cast("string").alias(key), label, prob) for name, df in named.items()]
    long = unique_by(reduce(DataFrame.unionByName, parts), ["model", key], "prediction bundle")
    ok = F.col(prob).isNotNull() & ~F.isnan(prob) & F.col(prob).between(0.0, 1.0)
    return require(long, F.coalesce(ok, F.lit(False)), "probabilities must be finite and in [0, 1]")


def read_oof_bundle(spark: SparkSession, paths: dict[str, str], key: str, label: str, prob: str) -> DataFrame:
    return bundle_predictions({n: spark.read.parquet(p) for n, p in paths.items()}, key, label, prob)


def fingerprint_inputs(spark: SparkSession, path: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """One order-free fingerprint of a file set from names, sizes and times, or from the bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = below(F.col("path"), path)
    proof = F.sha2("content", 256) if content else F.concat_ws("#", F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    lines = files.select(name.alias("name"), proof.alias("proof"))
    return cohort_hash(lines, ["name", "proof"]).withColumnRenamed("cohort_hash", "fingerprint")
