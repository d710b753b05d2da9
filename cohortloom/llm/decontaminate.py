"""Benchmark decontamination by winnowing.

Every text keeps, of each run of ``WINDOW`` consecutive word k-grams, those with the smallest hash. Two texts that share
``SPAN`` = ``K`` + ``WINDOW`` - 1 words share a kept fingerprint, so the join of training and benchmark fingerprints
misses no shared span of that length. Each hit is extended word by word (by 64-bit word hashes) in both
directions, which also verifies it.
Benchmark items shorter than a span are looked up whole by a fingerprint of their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.text import ALNUM_WORD, ANY_CASE_WORD, ascii_lower
from cohortloom.session import cut

SPAN = 13
K = 7
WINDOW = SPAN - K + 1
REACH = SPAN - K
#: Benchmark fingerprints are broadcast up to this many rows (counted first); beyond it both sides are shuffled.
BROADCAST_FINGERPRINTS = 100_000

POSTINGS = "array<struct<size:int,hash:bigint,at:int,near:array<bigint>>>"


def word_hashes(text: Column) -> Column:
    """64-bit hash of each word. Words are compared by it: a shared span needs 13 equal hashes in a row."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(ALNUM_WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def around(words: str, at: Column) -> Column:
    """The words from REACH before ``at`` (fewer at the start of the text) to SPAN from it on."""
    lead = F.least(at, F.lit(REACH))
    return F.slice(words, at - lead + 1, lead + SPAN)


def fingerprints(df: DataFrame, words: str, short: list[int], out: str, context: bool) -> DataFrame:
    """Add ``out``: array of (size, hash, at, near), the winnowed k-grams, and all n-grams for each n in ``short``; at
    counts words from 0, near holds the words around it if ``context``. Of equal hashes in a window all are kept, so that
    repeats stay aligned in both texts."""
    n = F.size(words)
    none = F.array().cast("array<bigint>")

    def posting(size: int, gram_hash: Column, at: Column) -> Column:
        near = around(words, at) if context else none
        return F.struct(F.lit(size).alias("size"), gram_hash.alias("hash"), at.alias("at"), near.alias("near"))

    grams = F.when(n >= K, F.transform(F.sequence(F.lit(1), n - K + 1), lambda i: F.xxhash64(F.slice(words, i, K))))
    df = df.withColumn("__h", F.coalesce(grams, none))
    m = F.size("__h") - WINDOW + 1
    lows = F.when(m >= 1, F.transform(F.sequence(F.lit(1), m), lambda i: F.array_min(F.slice("__h", i, WINDOW))))
    df = df.withColumn("__low", F.coalesce(lows, none))
    # A k-gram is the least of some window around it when it is no larger than the largest of their minima.
    minima = lambda i: F.slice("__low", F.greatest(i - WINDOW + 2, F.lit(1)), F.least(i + 1, F.lit(WINDOW)))
    kept = F.filter(F.transform("__h", lambda h, i: F.when(h <= F.array_max(minima(i)), posting(K, h, i))), lambda s: s.isNotNull())
    # The size test makes the optimiser see two uses of the minima; with one it would move them into the lambda.
    parts = [F.when(F.size("__low") > 0, kept).otherwise(F.array().cast(POSTINGS))]

    def whole(size: int) -> Column:
        """All n-grams of ``size`` words; their size is negative, to tell them from winnowed k-grams."""
        some = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: posting(-size, F.xxhash64(F.slice(words, i, size)), i - 1))
        return F.when(n >= size, some).otherwise(F.array().cast(POSTINGS))

    parts += [whole(size) for size in short]
    return df.withColumn(out, F.concat(*parts) if len(parts) > 1 else parts[0]).drop("__h", "__low")


def benchmark_index(benchmark: DataFrame, key: str, text: str) -> tuple[DataFrame, list[int]]:
    """Fingerprint rows (size, hash, item, item_at, item_near) of the benchmark, and the lengths of its short items."""
    items = cut(benchmark.select(F.col(key).alias("item"), word_hashes(F.col(text)).alias("words")).filter(F.size("words") > 0))
    # At most SPAN - 1 values.
    short = sorted(r["n"] for r in items.filter(F.size("words") < SPAN).select(F.size("words").alias("n")).distinct().collect())
    long = fingerprints(items.filter(F.size("words") >= SPAN), "words", [], "f", True).select("item", F.explode_outer("f").alias("f"))
    first = F.struct(
        (-F.size("words")).alias("size"), F.xxhash64("words").alias("hash"), F.lit(0).alias("at"), F.col("words").alias("near")
    )
    whole = items.filter(F.size("words") < SPAN).select("item", first.alias("f"))
    rows = long.unionByName(whole)
    return cut(rows.select("item", "f.size", "f.hash", F.col("f.at").alias("item_at"), F.col("f.near").alias("item_near"))), short


def _run(start: int, step: int, most: int) -> Column:
    """How many words agree in one direction, ``most`` at most, from ``start`` words after the fingerprint's first on."""
    lead, item_lead = F.least("at", F.lit(REACH)), F.least("item_at", F.lit(REACH))

    def differs(j: Column) -> Column:
        equal = F.get("near", lead + start + j * step) == F.get("item_near", item_lead + start + j * step)
        return ~F.coalesce(equal, F.lit(False))

    first = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), differs), True)
    return F.when(first == 0, F.lit(most)).otherwise(first - 1).cast("int")


def extended(hits: DataFrame) -> DataFrame:
    """Verify and extend hits (columns size, at, near, item_at, item_near): adds first and last (exclusive) word.

    A hit of size -n is a whole short item. A fingerprint lies within REACH words of the ends of a shared span it
    belongs to, so the extension needs to look no further; the spans of neighbouring hits overlap and unite."""
    winnowed = F.col("size") > 0
    hits = hits.withColumn("__right", _run(0, 1, SPAN)).withColumn("__left", F.when(winnowed, _run(-1, -1, REACH)).otherwise(F.lit(0)))
    is_span = F.when(winnowed, (F.col("__right") >= K) & (F.col("__left") + F.col("__right") >= SPAN)).otherwise(F.col("__right") >= -F.col("size"))
    last = F.col("at") + F.when(winnowed, F.col("__right")).otherwise(-F.col("size"))
    return hits.filter(is_span).withColumn("first", F.col("at") - F.col("__left")).withColumn("last", last)


def contaminated_spans(docs: DataFrame, index: DataFrame, short: list[int]) -> DataFrame:
    """Rows (key, text_hash, item, first, last) of verified shared spans. ``docs`` holds key, text_hash and words."""
    small = index.count() <= BROADCAST_FINGERPRINTS
    # explode_outer: for explode the optimiser adds a test of the array's size, and moves its making into that filter.
    marked = fingerprints(docs, "words", short, "f", context=small).select("key", "text_hash", F.explode_outer("f").alias("f"))
    if small:
        # The words around a fingerprint go with it to the join in the same stage; nothing is shuffled but hits.
        hits = marked.select("key", "text_hash", "f.size", "f.hash", "f.at", "f.near").join(F.broadcast(index), ["size", "hash"])
    else:
        narrow = marked.select("key", "text_hash", "f.size", "f.hash", "f.at").join(index, ["size", "hash"])
        texts = docs.dropDuplicates(["key", "text_hash"]).select(F.col("key").alias("k"), F.col("text_hash").alias("t"), "words")
        hits = narrow.join(texts, F.col("k").eqNullSafe(F.col("key")) & (F.col("t") == F.col("text_hash")))
        hits = hits.withColumn("near", around("words", F.col("at")))
    return extended(hits).select("key", "text_hash", "item", "first", "last")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per input row: key, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit when it lies in an occurrence of ``SPAN`` consecutive words of one item (of the whole item, where that
    is shorter). Null and empty texts have no words and no hits; items without words occur nowhere; items with equal
    words are counted each. Repeated rows get equal results, also when one key has different texts. A row is
    contaminated from one hit word in twenty. An empty table gives no rows; an empty benchmark hits nothing.
    """
    index, short = benchmark_index(benchmark, item_key, item_text)
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("body")).withColumn("text_hash", F.xxhash64("body"))
    # Written once: two groupings read it, and it holds hits only.
    spans = cut(contaminated_spans(source.withColumn("words", word_hashes(F.col("body"))).drop("body"), index, short))
    # Words are counted once however many items and fingerprints cover them; both groupings combine on the map side.
    covered = spans.select("key", "text_hash", F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("w")).distinct()
    hit = covered.groupBy("key", "text_hash").agg(F.count(F.lit(1)).alias("n_hit"))
    items = spans.groupBy("key", "text_hash").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    same = F.col("k").eqNullSafe(F.col("key")) & (F.col("t") == F.col("text_hash"))
    found = hit.join(items.select(F.col("key").alias("k"), F.col("text_hash").alias("t"), "items"), same).drop("k", "t")
    counted = source.select(F.col("key").alias("k"), F.col("text_hash").alias("t"), F.regexp_count(F.coalesce("body", F.lit("")), F.lit(ANY_CASE_WORD)).cast("bigint").alias("n_words"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("bigint")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return counted.join(found, same, "left").select(
        F.col("k").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
