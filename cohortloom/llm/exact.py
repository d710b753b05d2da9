"""Exact dedup by a heavy-hitter split.

A Misra-Gries summary (Spark's ``approx_top_k``, the DataSketches frequent-items sketch) finds the digests that may be
frequent. Their exact count and winner are verified by one map-side combined aggregate of at most ``heavy`` groups and
broadcast, so copies of a frequent text are settled where they are read. All other digests take one ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.text import ascii_lower
from cohortloom.session import cut

HEAVY = 256
TRACKED = 4096


def with_digest(docs: DataFrame, text: str, digest: str) -> DataFrame:
    return docs.withColumn(digest, F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("binary"), 256)))


def frequent_digests(digests: DataFrame, digest: str, key: str, heavy: int, tracked: int) -> DataFrame:
    """At most ``heavy`` digests with their verified size and largest key (``winner_digest``, ``winner_size``, ``winner_key``).

    The summary misses no digest with more than a fraction of about 1 / ``tracked`` of the rows among the largest
    ``heavy``; one it misses is only slower, since the shuffle path is exact for every digest.
    """
    # A short hash keeps the summary small; the winners are verified by their whole digest.
    short = digests.select(F.xxhash64(digest).alias("h"))
    found = short.agg(F.expr(f"approx_top_k(h, {heavy}, {tracked})").alias("top")).collect()[0]["top"] or []
    hashes = [r["item"] for r in found if r["count"] > 1]
    return (
        digests.filter(F.xxhash64(digest).isin(hashes) if hashes else F.lit(False))
        .groupBy(F.col(digest).alias("winner_digest"))
        .agg(F.count(F.lit(1)).alias("winner_size"), F.max(key).alias("winner_key"))
    )


def exact_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False, heavy: int = HEAVY, tracked: int = TRACKED
) -> DataFrame:
    """One row per input row: ``key``, keep_id, group_size, kept, text_sha256 (hex of the normalised text).

    Texts are equal when identical after lower-casing A-Z; the row with the largest key stays. Null text is empty text;
    a null key loses to every other; of rows repeated with the same key exactly one is kept. An empty table gives no rows.
    With ``carry`` the result holds the kept rows with their own columns instead; names that clash with the columns
    above cause no harm, as only internal names are added. The text is read twice and, without ``carry``, never shuffled.
    """
    rows = with_digest(docs, text, "__digest")
    digests = cut(rows.select(F.col(key).alias("__key"), "__digest"))
    winners = frequent_digests(digests, "__digest", "__key", heavy, tracked)
    source = rows.withColumn("__key", F.col(key)) if carry else digests
    # At most ``heavy`` rows by construction, so the broadcast is bounded whatever the input.
    joined = source.join(F.broadcast(winners), F.col("__digest") == F.col("winner_digest"), "left")
    is_copy = F.col("winner_digest").isNotNull() & ~F.col("__key").eqNullSafe(F.col("winner_key"))
    group = Window.partitionBy("__digest")
    order = group.orderBy(F.col("__key").desc_nulls_last())
    rest = joined.filter(~is_copy).withColumn("__rank", F.row_number().over(order))
    if carry:
        return rest.filter(F.col("__rank") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    rest = rest.withColumn("__size", F.coalesce("winner_size", F.count(F.lit(1)).over(group))).withColumn(
        "__keep", F.coalesce("winner_key", F.max("__key").over(group))
    )
    copies = joined.filter(is_copy).select("*", F.lit(0).alias("__rank"), F.col("winner_size").alias("__size"), F.col("winner_key").alias("__keep"))
    return rest.unionByName(copies).select(
        F.col("__key").alias(key),
        F.col("__keep").alias("keep_id"),
        F.col("__size").cast("bigint").alias("group_size"),
        (F.col("__rank") == 1).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )
