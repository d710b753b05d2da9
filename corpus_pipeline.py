"""A training-data pipeline: STAGES are applied in order, each to the table that its predecessor wrote.

Each stage takes (spark, docs, sf_dir) and calls one operator; all but the last return the columns of ``docs``. Rows that
agree in doc_id and text are one document; rows that share a doc_id (or have none) but differ in text are judged each by
its own text. An empty table passes all stages. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.decontaminate import decontaminate
from cohortloom.llm.exact import exact_dedup
from cohortloom.llm.jaccard import jaccard_components
from cohortloom.llm.mixing import mix_sources
from cohortloom.llm.quality import score_quality
from cohortloom.session import cut


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, text): row tells documents apart by doc_id and text. It sorts by doc_id, those without one last."""
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.xxhash64("text").alias("text_hash"))
    return docs.select(row.alias("row"), "text")


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose doc_id and text aren't in ``dropped`` (row); Spark broadcasts these where it has measured them to be few."""
    gone = dropped.select(F.col("row.doc_id").alias("__id"), F.col("row.text_hash").alias("__hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    return docs.join(gone, same, "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects (score below one half)."""
    kept = [c for c in docs.columns if c != "quality_score"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs.select(*[F.col(f"`{c}`") for c in kept]), labels, keep=kept)
    return scored.filter(F.col("quality_score") >= 0.5).drop("quality_score")


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the row with the largest doc_id stays."""
    return exact_dedup(docs, carry=True)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays; of several with it, one text."""
    return _without(docs, jaccard_components(_keyed(docs), key="row").filter(F.col("row") != F.col("component_id")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of whose words one in twenty or more lies in a benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate(_keyed(docs), benchmark, key="row").filter("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row per draw with the document's columns, and mix_weight, mix_epoch, mix_block and mix_position."""
    rows = docs.withColumn("__row", F.struct("doc_id", F.xxhash64("text")))
    draws = mix_sources(rows, key="__row").select(
        F.col("__row").alias("__draw"),
        F.col("weight").alias("mix_weight"),
        F.col("epoch").alias("mix_epoch"),
        F.col("block").alias("mix_block"),
        F.col("position").alias("mix_position"),
    )
    return rows.join(draws, F.col("__row") == F.col("__draw")).drop("__row", "__draw")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_one_copy),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix),
]

#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
