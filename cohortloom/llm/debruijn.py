"""Substring dedup on a De Bruijn graph of words: each word in a SPAN-word window that also starts in a smaller document goes.

Edges are the windows (SPAN words), nodes the overlaps of neighbouring windows. Steps:

1. Tasks tell the minimizers of their windows (the gram of MARK words with the smallest hash; equal windows have equal
   ones), then the windows whose minimizer a second document has. Bounded bit maps of what several documents have keep all
   else from being exchanged; they decide nothing.
2. Runs of such windows with one minimizer are cut out as super-edges with their coordinates (document, first word). Equal ones
   are merged, then their windows are counted as edges: smallest and largest document, the edges before and behind.
3. Edges of several documents that have one follower, which has one predecessor, lie on a nonbranching path. Inside a
   super-edge paths are cut by a window function, across super-edges they are compacted by joins that double the known
   length each round. A text's start or end counts as a branch, so all edges of a path stand in the same documents.
4. The coordinates of all super-edges on a path must add up to the whole path in a document; it is removed there if the
   path also stands in a smaller one. Texts that equal a smaller one go as a whole.

Edges are told apart by 96 bits of hashes. Texts without a removed word are finished where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.bitmap import bit_map, has_bit
from cohortloom.llm.text import NONBLANK_BYTES, Chunk, _powers, chunks, find_words, mix64, word_hashes
from cohortloom.session import cut

SPAN, MARK = 50, 16
PIECE = 1 << 20
#: Windows whose minimizers a task gathers before it tells them; bits of the maps.
GATHERED, MAP_BITS, DOC_BITS = 1 << 22, 27, 25
#: Rounds of doubling: a path has less than 2 ** ROUNDS super-edges.
ROUNDS = 60
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Windows:
    """Windows of the texts of a chunk: ``first`` word of each inside the chunk, its text, its minimizer."""

    def __init__(self, chunk: Chunk):
        words = find_words(chunk, NONBLANK_BYTES)
        hashes = word_hashes(chunk, words, fold=False)
        n = len(hashes)
        self.row_first = words.row_first
        self.at = np.zeros(0, np.int64)
        if n < SPAN:
            return
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=self.sums[1:])
        grams = mix64((self.sums[MARK:] - self.sums[:-MARK]) * self.down[: n + 1 - MARK])
        least = least_of(grams, SPAN - MARK + 1)
        row = words.row_of()
        self.at = np.flatnonzero(row[: n - SPAN + 1] == row[SPAN - 1 :])
        self.row, self.mark = row[self.at], least[self.at]

    def span_hash(self, first: np.ndarray, size) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of ``size`` words from each ``first``."""
        value = (self.sums[first + size] - self.sums[first]) * self.down[first]
        return mix64(value + np.asarray(size).astype(np.uint64)), mix64(value ^ np.uint64(0xA0761D6478BD642F))


def fresh(batch: pa.RecordBatch, seen: dict) -> pa.RecordBatch:
    """Without rows whose text a task has met under the same or a smaller key, null keys and texts too short for a window."""
    keep = []
    for key, h, size in zip(batch.column("key").to_pylist(), batch.column("hash").to_pylist(), batch.column("size").to_pylist(), strict=True):
        have = seen.get((h, size))
        new = key is not None and size >= 2 * SPAN - 1 and (have is None or key < have)
        if new:
            seen[h, size] = key
        keep.append(new)
    return batch.filter(pa.array(keep, pa.bool_()))


def told(batches: Iterator[pa.RecordBatch], bits: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Minimizers of a task's windows or, with the bit map of shared ones, the windows that have one of these, each with the
    smallest and the largest hash of the texts in which it was met: copies of a text don't make it shared."""
    seen: dict = {}
    marks, texts, n = [], [], 0

    def tell() -> pa.RecordBatch:
        m, t = np.concatenate(marks), np.concatenate(texts)
        order = np.lexsort((t, m))
        m, t = m[order], t[order]
        new = np.ones(len(m), dtype=bool)
        new[1:] = m[1:] != m[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(m)) - 1
        return pa.RecordBatch.from_arrays([pa.array(m[first].view(np.int64)), pa.array(t[first]), pa.array(t[last])], names=["mark", "lo", "hi"])

    for batch in batches:
        some = fresh(batch, seen)
        hashes = np.asarray(some.column("hash"))
        for chunk in chunks(some.column("text"), PIECE):
            windows = Windows(chunk)
            if not len(windows.at):
                continue
            of = run_starts(windows) if bits is None else np.flatnonzero(has_bit(bits, windows.mark, MAP_BITS))
            marks.append(windows.mark[of] if bits is None else windows.span_hash(windows.at[of], SPAN)[0])
            texts.append(hashes[chunk.first + windows.row[of]])
            n += len(of)
            if n >= GATHERED:
                yield tell()
                marks, texts, n = [], [], 0
    if n:
        yield tell()


def run_starts(windows: Windows, wanted: np.ndarray | None = None) -> np.ndarray:
    """Where runs of neighbouring windows with one minimizer begin; unwanted windows part them."""
    new = np.ones(len(windows.at), dtype=bool)
    new[1:] = (windows.mark[1:] != windows.mark[:-1]) | (windows.row[1:] != windows.row[:-1])
    if wanted is not None:
        new[1:] |= wanted[1:] != wanted[:-1]
    return np.flatnonzero(new)


SUPER = "tag bigint, at bigint, s1 bigint, s2 bigint, prev int, next int, w array<bigint>, v array<int>"


def super_edges(batches: Iterator[pa.RecordBatch], marks: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Super-edges of windows that may repeat (by their minimizers' bits and their own), one row per place: key, tag (of the text), at (first word in the text), their
    hash, the edges around them, and where the task hasn't given them before the hashes of their windows."""
    seen: dict = {}
    given: set[int] = set()
    for batch in batches:
        some = fresh(batch, seen)
        tags = np.asarray(some.column("hash"))
        for chunk in chunks(some.column("text"), PIECE):
            windows = Windows(chunk)
            if not len(windows.at):
                continue
            w, v = windows.span_hash(windows.at, SPAN)
            wanted = has_bit(marks, windows.mark, MAP_BITS) & has_bit(bits, w, MAP_BITS)
            starts = run_starts(windows, wanted)
            ends = np.append(starts[1:], len(windows.at))
            starts, ends = starts[wanted[starts]], ends[wanted[starts]]
            if not len(starts):
                continue
            v = (v >> np.uint64(32)).astype(np.uint32).view(np.int32)
            # Zero stands for no edge.
            v[v == 0] = 1
            joined = np.zeros(len(v) + 1, dtype=bool)
            joined[1:-1] = windows.row[1:] == windows.row[:-1]
            before = np.where(joined[starts], v[starts - 1], 0).astype(np.int32)
            behind = np.where(joined[ends], v[np.minimum(ends, len(v) - 1)], 0).astype(np.int32)
            row, first = windows.row[starts], windows.at[starts]
            s1, s2 = windows.span_hash(first, ends - starts + SPAN - 1)
            new = []
            for h in s1.tolist():
                new.append(h not in given)
                given.add(h)
            new = np.array(new)
            lengths = np.where(new, ends - starts, 0)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            take = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
            none = pa.array(~new)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[take]), mask=none) for x in (w.view(np.int64), v)]
            keys = some.column("key").slice(chunk.first, chunk.rows).take(pa.array(row))
            plain = [tags[chunk.first + row], first - windows.row_first[row], s1.view(np.int64), s2.view(np.int64), before, behind]
            yield pa.RecordBatch.from_arrays([keys, *map(pa.array, plain), *lists], names=["key", "tag", "at", "s1", "s2", "prev", "next", "w", "v"])


def repeated_edges(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(windows of distinct super-edges, edges of several documents with their smallest one and their neighbours)."""
    merged = places.groupBy("s1", "s2").agg(
        F.min("key").alias("low"), F.max("key").alias("high"),
        *[f(c).alias(f"{c}_{n}") for c in ("prev", "next") for n, f in (("lo", F.min), ("hi", F.max))],
        F.max("w").alias("w"), F.max("v").alias("v"),
    )
    every = merged.select("*", F.posexplode(F.arrays_zip("w", "v")).alias("i", "e"), F.size("w").alias("n")).select(
        "s1", "s2", "i", F.col("e.w").alias("edge"), F.col("e.v").alias("mark"), "low", "high",
        *[F.when(F.col("i") == 0, F.col(f"prev_{x}")).otherwise(F.col("v")[F.col("i") - 1]).alias(f"prev_{x}") for x in ("lo", "hi")],
        *[F.when(F.col("i") == F.col("n") - 1, F.col(f"next_{x}")).otherwise(F.try_element_at("v", F.col("i") + 2)).alias(f"next_{x}") for x in ("lo", "hi")],
    )
    every = cut(every)
    ends = [f(f"{c}_{x}").alias(f"{c}_{x}") for c in ("prev", "next") for x, f in (("lo", F.min), ("hi", F.max))]
    edges = every.groupBy("edge", "mark").agg(F.min("low").alias("low"), F.max("high").alias("high"), *ends).filter("low < high")
    single = [F.when((F.col(f"{c}_lo") == F.col(f"{c}_hi")) & (F.col(f"{c}_lo") != 0), F.col(f"{c}_lo")).alias(c) for c in ("prev", "next")]
    return every.select("s1", "s2", "i", "edge", "mark"), edges.select("edge", "mark", "low", *single)


def local_paths(every: DataFrame, edges: DataFrame) -> DataFrame:
    """Nonbranching paths inside super-edges: (s1, s2, first, n) with the path's first edge, its mark, the mark of its last
    edge and the single edges around it."""
    along = Window.partitionBy("s1", "s2").orderBy("i")
    known = every.join(edges, ["edge", "mark"])
    goes_on = (F.lag("i").over(along) == F.col("i") - 1) & (F.lag("next").over(along) == F.col("mark")) & (F.col("prev") == F.lag("mark").over(along))
    numbered = known.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("path", F.sum("new").over(along))
    first, last = (lambda c: F.min_by(c, "i")), (lambda c: F.max_by(c, "i"))
    return numbered.groupBy("s1", "s2", "path").agg(
        F.min("i").alias("first"), F.count(F.lit(1)).alias("n"), first("edge").alias("edge"), first("mark").alias("mark"), first("low").alias("low"),
        first("prev").alias("prev"), last("mark").alias("tail"), last("next").alias("next"),
    ).drop("path")


def compact(paths: DataFrame) -> DataFrame:
    """(edge, mark, root, root_mark, offset): the first edge of the whole path that each local path lies on, and its windows
    before this one. Each round doubles the number of local paths that are known to lie together."""
    own = paths.groupBy("edge", "mark").agg(F.max("n").alias("n"), F.max("prev").alias("prev"), F.max("tail").alias("tail"), F.max("next").alias("next"))
    own = cut(own)
    before = own.filter("next IS NOT NULL").select(F.col("edge").alias("up"), F.col("mark").alias("up_mark"), F.col("n").alias("step"), F.col("tail").alias("t"), F.col("next").alias("x"))
    linked = own.join(before, (F.col("prev") == F.col("t")) & (F.col("mark") == F.col("x")), "left")
    at = cut(linked.select("edge", "mark", F.coalesce("up", "edge").alias("root"), F.coalesce("up_mark", "mark").alias("root_mark"), F.coalesce("step", F.lit(0)).alias("offset"), F.col("up").isNull().alias("done")))
    for _ in range(ROUNDS):
        if at.filter("NOT done").isEmpty():
            return at.drop("done")
        hop = at.select(F.col("edge").alias("e"), F.col("mark").alias("m"), F.col("root").alias("far"), F.col("root_mark").alias("far_mark"), F.col("offset").alias("more"), F.col("done").alias("far_done"))
        moved = at.filter("NOT done").join(hop, (F.col("root") == F.col("e")) & (F.col("root_mark") == F.col("m")))
        moved = moved.select("edge", "mark", F.col("far").alias("root"), F.col("far_mark").alias("root_mark"), (F.col("offset") + F.col("more")).alias("offset"), F.col("far_done").alias("done"))
        at = cut(at.filter("done").unionByName(moved))
    raise RuntimeError("paths that don't end: the hashes of two edges agree")


def repeated_paths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(places, paths): super-edges by coordinates, and for each super-edge the pieces of whole paths that lie on it
    (s1, s2, first, n, root, root_mark, offset, total, low)."""
    rows = _rows(docs, key, text).drop("words")
    spark = docs.sparkSession

    def several(values: DataFrame) -> np.ndarray:
        """Bits of the values that more than one text has."""
        counted = values.groupBy("mark").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        return bit_map(counted.filter("lo < hi"), "mark", MAP_BITS)

    types = "mark bigint, lo bigint, hi bigint"
    marks = spark.sparkContext.broadcast(several(rows.mapInArrow(told, types)))
    bits = spark.sparkContext.broadcast(several(rows.mapInArrow(lambda batches: told(batches, marks.value), types)))
    kind = rows.schema["key"].dataType.simpleString()
    places = cut(rows.mapInArrow(lambda batches: super_edges(batches, marks.value, bits.value), f"key {kind}, {SUPER}"))
    every, edges = repeated_edges(places)
    local = cut(local_paths(every, edges))
    roots = compact(local)
    placed = local.join(roots, ["edge", "mark"])
    totals = placed.groupBy("edge", "mark", "root", "root_mark").agg(F.max("n").alias("n")).groupBy(F.col("root").alias("r"), F.col("root_mark").alias("rm")).agg(F.sum("n").alias("total"))
    whole = placed.join(totals, (F.col("root") == F.col("r")) & (F.col("root_mark") == F.col("rm")))
    return places, whole.select("s1", "s2", "first", "n", "root", "root_mark", "offset", "total", "low")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, tag, first, last) of words to remove (last exclusive); they may overlap. tag tells texts of a key apart."""
    places, paths = repeated_paths(docs, key, text)
    here = places.select("key", "tag", "at", "s1", "s2").join(paths, ["s1", "s2"]).filter(F.col("key") > F.col("low"))
    start = (F.col("at") + F.col("first") - F.col("offset")).alias("start")
    # A path is a repeat of the text where its pieces add up to the whole of it (rows of equal key and text tell each piece
    # as often as they are read).
    times = F.sum(F.when(F.col("offset") == 0, 1).otherwise(0)).alias("times")
    whole = here.groupBy("key", "tag", "root", "root_mark", start).agg(F.sum("n").alias("n"), F.max("total").alias("total"), times).filter("n = times * total")
    spans = whole.select("key", "tag", F.col("start").alias("first"), (F.col("start") + F.col("total") + SPAN - 1).alias("last"))
    return spans.unionByName(_copies(_rows(docs, key, text)))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), body.alias("text"))
    return rows.select("key", "text", F.xxhash64("text").alias("hash"), F.octet_length("text").cast("bigint").alias("size"), F.lit(0).alias("words"))


def _copies(rows: DataFrame) -> DataFrame:
    """Whole texts that a smaller key also has."""
    digests = cut(rows.filter((F.col("size") >= 2 * SPAN - 1) & F.col("key").isNotNull()).select("key", F.col("hash").alias("tag"), "size", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")))
    several = digests.groupBy("digest").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least < most").drop("most")
    found = digests.join(several, "digest").filter("key > least")
    # As many words as bytes at most: the rest of the span lies behind the text.
    return found.select("key", "tag", F.lit(0).cast("bigint").alias("first"), F.col("size").alias("last"))


RESULT = "n_words bigint, n_removed bigint, kept binary"


def _left(words: list[bytes], spans: list) -> tuple[int, bytes]:
    """(removed words, remaining words joined by a space); a text of fewer words than a window stays."""
    if not spans or len(words) < SPAN:
        return 0, b" ".join(words)
    parts, at = [], 0
    for first, last in sorted((s["first"], min(s["last"], len(words))) for s in spans):
        if first > at:
            parts += words[at:first]
        at = max(at, last)
    parts += words[at:]
    return len(words) - len(parts), b" ".join(parts)


def _finish(batches: Iterator[pa.RecordBatch], digest: bool, bits: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Results of texts; with ``bits`` only of those that have no span, the others pass through with their text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        waits = has_bit(bits, np.asarray(batch.column("mix")).view(np.uint64), DOC_BITS) if bits is not None else np.zeros(n, bool)
        spans = batch.column("spans").to_pylist() if bits is None else [None] * n
        out: list[tuple] = []
        texts = batch.column("text").cast(pa.binary())
        for i in range(n):
            data = texts[i].as_py()
            if waits[i] or data is None:
                out.append((None, None, None) if bits is not None else tuple(batch.column(c)[i].as_py() for c in ("n_words", "n_removed", "kept")))
                continue
            words = data.split()
            gone, kept = _left(words, spans[i])
            out.append((len(words), gone, hashlib.sha256(kept).hexdigest().encode() if digest else kept))
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)]
        named = ["n_words", "n_removed", "kept"]
        if bits is None:
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names=["key", *named])
        else:
            rest = batch.column("text").filter(pa.array(waits)) if waits.all() else pa.array([t if w else None for t, w in zip(batch.column("text").to_pylist(), waits.tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("tag"), rest, *columns], names=["key", "tag", "text", *named])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: key, n_words, n_removed, kept (remaining words joined by a space, as bytes; their SHA-256 in hex
    with ``digest``).

    Words are runs of anything but blanks, unchanged. Null is empty; keys are of any type with an order. Of texts repeated
    under one key none counts as the smaller document; a text under a null key is left whole and removes nothing. Texts
    below SPAN words stay, texts of any length are read whole. An empty table gives no rows, extra columns are left out.
    """
    spans = cut(repeated_spans(docs, key, text))
    mixed = spans.select(F.xxhash64("key", "tag").alias("mix"))
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(mixed, "mix", DOC_BITS))
    rows = _rows(docs, key, text).select("key", F.col("hash").alias("tag"), "text", F.xxhash64("key", "hash").alias("mix"))
    kind = rows.schema["key"].dataType.simpleString()
    first = rows.mapInArrow(lambda batches: _finish(batches, digest, bits.value), f"key {kind}, tag bigint, text string, {RESULT}")
    lists = spans.groupBy(F.col("key").alias("k"), F.col("tag").alias("t")).agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    joined = first.join(lists, (F.col("key") == F.col("k")) & (F.col("tag") == F.col("t")), "left").select("key", "text", "n_words", "n_removed", "kept", "spans")
    return joined.mapInArrow(lambda batches: _finish(batches, digest), f"key {kind}, {RESULT}").withColumnRenamed("key", key)


def repeat_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of :func:`remove_repeats` with kept_sha256 instead of the text."""
    return remove_repeats(docs, key, text, digest=True).withColumn("kept_sha256", F.col("kept").cast("string")).drop("kept")
