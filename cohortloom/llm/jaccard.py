"""N-gram Jaccard join by partitioning the universe of shingles.

Two sets of sizes a and b with a Jaccard similarity of 0.75 or more differ in (a + b) / 7 shingles at most. Shingles are
hashed into segments by size band; where two sets differ in at most H shingles, they agree on the rest of the segments.
A set is indexed by the subsets that it has in the segments:

* Small bands take (H + 1) / 2 segments; each is indexed with its one-deletion neighbourhood, so that one differing
  shingle does no harm, and some segment has no more than one.
* Other bands take more than H + 1 segments and each set leaves out the costliest until h + 1 are kept, where h is the
  most that a set of its own size can differ in (H at most). Cost is a fixed order of subsets: few shingles that aren't
  frequent in the corpus, then few shingles at all. Two similar sets agree on at least as many segments as either leaves
  out plus one, and the cheapest of these is left out by neither.

Equal sets are one class from the start. Classes that share an indexed subset are compared along chains first; what the
links join needs no further comparison, and members of different components are then compared with each other. Every
comparison is exact. No pair of classes that are already joined is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.bitmap import bit_map, has_bit
from cohortloom.llm.components import components
from cohortloom.llm.text import NONBLANK_BYTES, Chunk, chunks, find_words, gram_hashes, mix64, word_hashes
from cohortloom.session import cut

SHINGLE = 5
#: Bands up to this size (a power of two) are indexed with deletions.
SMALL_SET = 16
#: Segments beyond those kept, as a share of them.
SPARE = 0.5
#: Frequent shingles that the cost order knows, at most; least repeats among GATHERED shingles of a task to be considered.
FREQUENT, REPEATS, GATHERED = 1 << 17, 5, 1 << 20
#: Members of a subset that are paired by a join, at most; members of a block of a larger one, and shingles of these.
SMALL_GROUP, TILE, TILE_SHINGLES = 6, 2048, 1 << 20
#: A signature is a scheme above so many bits of a hash; equal hashes of other subsets are told apart by the comparison.
SIGNATURE_BITS = 42
#: Bits of the map that keeps sets of unpaired classes from being shuffled. It saves work and decides nothing.
MAP_BITS = 22


def shingle_sets(chunk: Chunk, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a text with fewer words has its whole sequence as one."""
    words = find_words(chunk, NONBLANK_BYTES)
    hashes = word_hashes(chunk, words)
    grams = gram_hashes(hashes, size)
    out = []
    for a, b in zip(words.row_first[:-1].tolist(), words.row_first[1:].tolist(), strict=True):
        n = b - a
        out.append(np.unique(grams[a : b - size + 1]) if n >= size else gram_hashes(hashes[a:b], n) if n else grams[:0])
    return out


def class_of(values: np.ndarray) -> int:
    """Id of a set: equal for equal sets."""
    total = mix64(values).sum(dtype=np.uint64, keepdims=True) + np.array([len(values)], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix64(total).view(np.int64)[0])


def schemes(n: int) -> list[tuple[int, int, int]]:
    """(scheme, H, h) in which a set of ``n`` shingles takes part: its band (u/2, u], and where it is near an edge u, the
    scheme of pairs across that edge. H bounds the differences of all pairs of the scheme, h those of sets of this size."""
    band = max(n - 1, 0).bit_length()
    most = 4 * n // 3
    found = [(2 * band, 2 * (1 << band) // 7, (n + min(most, 1 << band)) // 7)]
    for edge in (band - 1, band):
        u = 1 << edge if edge >= 0 else 0
        if u and 4 * n >= 3 * u and 3 * n <= 4 * u:
            found.append((2 * edge + 1, (u + 4 * u // 3) // 7, (n + (most if n <= u else u)) // 7))
    # Sets that differ in nothing are one class already.
    return [(s, most, own) for s, most, own in found if most > 0]


def signatures(values: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Hashes of the indexed subsets of a set in all its schemes."""
    n = len(values)
    rare = None
    out = []
    for scheme, differ, own in schemes(n):
        small = scheme <= 2 * (SMALL_SET.bit_length() - 1)
        kept = (differ + 2) // 2 if small else differ + 1
        m = kept if small else kept + max(2, int(kept * SPARE))
        segment = (mix64(values + np.uint64(scheme)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        counts = np.bincount(segment, minlength=m)
        mixed = mix64(values[order] ^ np.uint64(0xA0761D6478BD642F))
        ends = np.cumsum(counts)
        running = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
        sums = running[ends] - running[ends - counts]
        salt = mix64(np.arange(m, dtype=np.uint64) + (np.uint64(scheme + 1) << np.uint64(32)))
        found = mix64(sums + salt)
        name = np.uint64(scheme << SIGNATURE_BITS)
        if small:
            out += [name | x >> np.uint64(64 - SIGNATURE_BITS) for x in (found, mix64(sums[segment[order]] - mixed + salt[segment[order]]))]
            continue
        if rare is None:
            at = np.minimum(np.searchsorted(frequent, values), max(len(frequent) - 1, 0))
            rare = frequent[at] != values if len(frequent) else np.ones(n, dtype=bool)
        rich = np.bincount(segment[rare], minlength=m) if rare.any() else np.zeros(m, dtype=np.int64)
        rank = (np.minimum(rich, 255) << 8 | np.minimum(counts, 255)).astype(np.uint64) << np.uint64(48) | found >> np.uint64(16)
        left_out = m - own - 1
        out.append(name | found[np.argpartition(rank, left_out)[left_out:]] >> np.uint64(64 - SIGNATURE_BITS))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def occupancy(values: np.ndarray) -> bytes:
    """Which of a power of two of buckets, four to eight times the shingles, hold a shingle; a bit each."""
    bits = max(len(values) - 1, 1).bit_length() + 2
    flags = np.zeros(1 << bits, dtype=bool)
    flags[(values >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def folded(shape: bytes, width: int) -> np.ndarray:
    """An occupancy in ``width`` bytes: neighbouring buckets become one."""
    packed = np.frombuffer(shape, np.uint8)
    if len(packed) == width:
        return packed
    return np.packbits(np.unpackbits(packed).reshape(8 * width, -1).any(axis=1))


def plausible(x: bytes, y: bytes, n: int, m: int) -> bool:
    """Whether sets of ``n`` and ``m`` shingles with these occupancies can be similar enough: a bucket that one set alone
    occupies holds a shingle that it alone has, so the occupancies differ in no more places than the sets do."""
    width = min(len(x), len(y))
    return 7 * int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum(dtype=np.int64)) <= n + m


def describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, n, class, occupancy) of all texts, the occupancy once per class and task, and rows (frequent, times) of
    shingles that repeat within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        gathered: list[np.ndarray] = []
        n_gathered = 0

        def often(keys: pa.DataType) -> pa.RecordBatch:
            shingle, times = np.unique(np.concatenate(gathered), return_counts=True)
            shingle, times = shingle[times >= REPEATS], times[times >= REPEATS]
            k = len(shingle)
            none = pa.nulls(k, pa.int64())
            columns = [pa.nulls(k, keys), none, none, pa.nulls(k, pa.binary()), pa.array(shingle.view(np.int64)), pa.array(times)]
            return pa.RecordBatch.from_arrays(columns, names=NAMES)

        kind = None
        for batch in batches:
            keys = batch.column("key")
            kind = keys.type
            for chunk in chunks(batch.column("text")):
                sets = shingle_sets(chunk)
                ids = [class_of(v) for v in sets]
                fresh = [len(v) > 0 and not (c in seen or seen.add(c)) for v, c in zip(sets, ids, strict=True)]
                n = chunk.rows
                none = pa.nulls(n, pa.int64())
                shapes = pa.array([occupancy(v) if f else None for v, f in zip(sets, fresh, strict=True)], pa.binary())
                columns = [keys.slice(chunk.first, n), pa.array([len(v) for v in sets], pa.int64()), pa.array(ids, pa.int64()), shapes, none, none]
                yield pa.RecordBatch.from_arrays(columns, names=NAMES)
                gathered += [v for v, f in zip(sets, fresh, strict=True) if f]
                n_gathered += sum(len(v) for v, f in zip(sets, fresh, strict=True) if f)
                if n_gathered >= GATHERED:
                    yield often(kind)
                    gathered, n_gathered = [], 0
        if gathered:
            yield often(kind)

    kind = docs.schema[key].dataType.simpleString()
    return _texts(docs, key, text).mapInArrow(run, f"key {kind}, n long, class long, occupancy binary, frequent long, times long")


NAMES = ["key", "n", "class", "occupancy", "frequent", "times"]


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))


def index_rows(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(signature, class) of every class; a task tells a class once, so copies add no more rows than there are tasks."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for chunk in chunks(batch.column("text"), 1 << 20):
                found, ids = [], []
                for values in shingle_sets(chunk):
                    c = class_of(values) if len(values) else None
                    if c is None or c in seen:
                        continue
                    seen.add(c)
                    found.append(signatures(values, shared.value))
                    ids.append(c)
                if ids:
                    owner = np.repeat(np.array(ids, dtype=np.int64), [len(f) for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(owner)], names=["signature", "class"])

    return texts.select("text").mapInArrow(run, "signature long, class long")


def sets_of(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(class, shingles as bytes) of the classes in ``members``, read from the texts once more."""
    bits = bit_map(members, "class", MAP_BITS)
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                ids, found = [], []
                some = [(class_of(values), values) for values in shingle_sets(chunk) if len(values)]
                wanted = has_bit(shared.value, np.array([c for c, _ in some], dtype=np.int64).view(np.uint64), MAP_BITS)
                for (c, values), ok in zip(some, wanted, strict=True):
                    if ok and c not in seen:
                        seen.add(c)
                        ids.append(c)
                        found.append(values.tobytes())
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["class", "shingles"])

    rows = texts.select("text").mapInArrow(run, "class long, shingles binary")
    return rows.groupBy("class").agg(F.first("shingles").alias("shingles"))


def filtered(pairs: DataFrame, sides: DataFrame, columns: list[str], test) -> DataFrame:
    """The pairs (a, b) whose ``columns`` of ``sides`` (one row per class) pass ``test``(values of a, values of b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = zip(*[batch.column(f"x_{c}").to_pylist() for c in columns], strict=True)
            right = zip(*[batch.column(f"y_{c}").to_pylist() for c in columns], strict=True)
            ok = pa.array([test(x, y) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(ok)

    x = sides.select(F.col("class").alias("a"), *[F.col(c).alias(f"x_{c}") for c in columns])
    y = sides.select(F.col("class").alias("b"), *[F.col(c).alias(f"y_{c}") for c in columns])
    names = [f"{side}_{c}" for side in "xy" for c in columns]
    return pairs.join(x, "a").join(y, "b").select("a", "b", *names).mapInArrow(run, "a long, b long")


def _similar(x: tuple, y: tuple) -> bool:
    few, many = sorted((np.frombuffer(x[0], np.uint64), np.frombuffer(y[0], np.uint64)), key=len)
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    both = int((many[at] == few).sum())
    return 100 * both >= 75 * (len(few) + len(many) - both)


def likely_pairs(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    return filtered(pairs, shapes, ["occupancy", "n"], lambda x, y: plausible(x[0], y[0], x[1], y[1]))


def verified(texts: DataFrame, likely: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; only sets of these pairs are read."""
    likely = cut(likely.distinct())
    members = likely.select(F.col("a").alias("class")).unionAll(likely.select("b"))
    return cut(filtered(likely, sets_of(texts, members), ["shingles"], _similar))


def similar_to(values: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of ``others`` are similar enough to ``values``; sorted sets of shingles, none empty."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
    both = np.add.reduceat((values[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= 75 * (sizes + len(values) - both)


class _Tile:
    """Members of one tile; a pair counts where the two are in different components, and across the tile's blocks."""

    def __init__(self, blocks: list[int], parts: list[int], n: list[int], shapes: list[bytes], across: bool):
        width = min(map(len, shapes))
        self.table = np.array([folded(h, width) for h in shapes])
        self.block, self.part, self.n, self.across = np.array(blocks), np.unique(parts, return_inverse=True)[1], np.array(n), across

    def plausible(self, i: int) -> np.ndarray:
        """Later members that can be similar to member ``i`` by their occupancies."""
        other = self.part[i + 1 :] != self.part[i]
        if self.across:
            other &= self.block[i + 1 :] != self.block[i]
        at = np.flatnonzero(other) + i + 1
        return at[7 * np.bitwise_count(self.table[at] ^ self.table[i]).sum(axis=1, dtype=np.int64) <= self.n[at] + self.n[i]]

    def met(self) -> list[tuple[int, int]]:
        """Plausible pairs that join all members which the plausible pairs join: fewer than members."""
        out = []
        group = np.arange(len(self.n))
        for i in range(len(self.n) - 1):
            at = self.plausible(i)
            names, first = np.unique(group[at], return_index=True)
            at, names = at[first[names != group[i]]], names[names != group[i]]
            group[np.isin(group, names)] = group[i]
            out += [(i, k) for k in at.tolist()]
        return out

    def links(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Similar pairs that join all members which the similar pairs of the tile join: fewer than members."""
        out = []
        for i in range(len(sets) - 1):
            at = self.plausible(i)
            if not len(at):
                continue
            for k in at[similar_to(sets[i], [sets[k] for k in at])].tolist():
                if self.part[k] != self.part[i]:
                    self.part[self.part == self.part[k]] = self.part[i]
                    out.append((i, k))
        return out


def tiles(rows: DataFrame, blocks: Column) -> DataFrame:
    """Members of every subset, cut into ``blocks`` by their class: a tile (subset, low, high) holds two of them."""
    own = F.pmod(F.xxhash64("class"), blocks).cast("long")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))


def tile_links(rows: DataFrame, columns: list[str], of_tile) -> DataFrame:
    """Pairs (a, b) of classes: ``of_tile``(whether across, own, part, ``columns``) gives pairs of members of a tile."""
    tile = ["subset", "low", "high"]
    rows = rows.select(*tile, "class", "own", "part", *columns).repartition(*tile).sortWithinPartitions(*tile, "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        held, key = [], None

        def told() -> pa.RecordBatch:
            pairs = np.array(sorted(found), dtype=np.int64)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        def finish() -> None:
            if len(held) > 1:
                ids, *values = zip(*held, strict=True)
                found.update((min(ids[i], ids[k]), max(ids[i], ids[k])) for i, k in of_tile(key[1] != key[2], *values))

        for batch in batches:
            for subset, low, high, *member in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (subset, low, high) != key:
                    finish()
                    held, key = [], (subset, low, high)
                held.append(member)
            if len(found) > 1 << 18:
                yield told()
        finish()
        if found:
            yield told()

    return rows.mapInArrow(run, "a long, b long")


def tiled_groups(apart: DataFrame, shapes: DataFrame) -> DataFrame:
    """(class, subset) of members of large subsets that can be similar to another one by their occupancies; what can be
    similar is in one of the new subsets. A subset of more than ``TILE`` members, or of more than ``TILE_SHINGLES`` shingles,
    is cut into blocks."""
    # Sets of a scheme have no more shingles than this power of two.
    shingles = F.col("size") * F.pow(F.lit(2.0), F.ceil(F.shiftright("signature", SIGNATURE_BITS) / F.lit(2)))
    blocks = F.ceil(F.greatest(F.col("size") / F.lit(TILE), shingles / F.lit(TILE_SHINGLES)))
    rows = tiles(apart.withColumn("blocks", blocks).withColumnRenamed("signature", "subset"), F.col("blocks")).join(shapes, "class")

    def met(across: bool, own: list[int], parts: list[int], n: list[int], shapes: list[bytes]) -> list[tuple[int, int]]:
        return _Tile(own, parts, n, shapes, across).met()

    return components(tile_links(rows, ["n", "occupancy"], met)).select(F.col("node").alias("class"), F.col("label").alias("subset"))


def tiled_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join all members (class, subset, part, n) of a subset which are similar. Each set goes once to every
    other block of its subset and meets the others there, so that pairs which are not similar, or joined already, never
    become rows."""
    sizes = members.groupBy("subset").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(TILE), F.sum("n") / F.lit(TILE_SHINGLES))).alias("blocks"))
    rows = tiles(members.join(sizes, "subset"), F.col("blocks")).join(sets, "class")

    def links(across: bool, own: list[int], parts: list[int], shingles: list[bytes]) -> list[tuple[int, int]]:
        values = [np.frombuffer(x, np.uint64) for x in shingles]
        return _Tile(own, parts, [len(v) for v in values], [occupancy(v) for v in values], across).links(values)

    return tile_links(rows, ["shingles"], links)


def still_apart(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members (signature, class, part, size) of the subsets whose classes aren't all in one component yet."""
    group = Window.partitionBy("signature")
    named = members.select("signature", "class").join(label, F.col("class") == F.col("node"), "left")
    named = named.select("signature", "class", F.coalesce("label", "class").alias("part"))
    wide = named.withColumn("low", F.min("part").over(group)).withColumn("high", F.max("part").over(group)).withColumn("size", F.count(F.lit(1)).over(group))
    return cut(wide.filter("low < high").drop("low", "high"))


def class_links(texts: DataFrame, shapes: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Links (a, b) between classes: with them the components are those of all links.

    The members of a subset are compared along a chain, in one order for all subsets, which gives few distinct pairs. What
    is still apart then is compared in full, component against component: small subsets by a join, large ones in tiles.
    """
    group = Window.partitionBy("signature")
    rows = index_rows(texts, frequent)
    shared = rows.withColumn("low", F.min("class").over(group)).withColumn("high", F.max("class").over(group))
    before = F.lag("class").over(group.orderBy("class"))
    shared = shared.withColumn("before", before).filter("low < high and (before is null or before <> class)")
    members = cut(shared.select("signature", "class", "before"))
    shapes = cut(shapes.join(members.select("class").distinct(), "class", "left_semi"))
    chain = members.filter("before is not null").select(F.col("before").alias("a"), F.col("class").alias("b")).distinct()
    links = verified(texts, likely_pairs(chain, shapes))
    label = components(links)
    apart = still_apart(members, label)
    few = apart.filter(F.col("size") <= SMALL_GROUP)
    left = few.select("signature", F.col("class").alias("a"), F.col("part").alias("p"))
    right = few.select("signature", F.col("class").alias("b"), F.col("part").alias("q"))
    pairs = left.join(right, "signature").filter("p < q").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    likely = cut(likely_pairs(pairs, shapes).distinct())
    groups = tiled_groups(apart.filter(F.col("size") > SMALL_GROUP), shapes).join(shapes.select("class", "n"), "class")
    named = groups.join(label, F.col("class") == F.col("node"), "left")
    many = cut(named.select("class", "subset", F.coalesce("label", "class").alias("part"), "n"))
    sets = sets_of(texts, likely.select(F.col("a").alias("class")).unionAll(likely.select("b")).unionAll(many.select("class")))
    return links.unionAll(cut(filtered(likely, sets, ["shingles"], _similar).unionAll(tiled_links(many, sets))))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_shingles, component_id (the smallest key reachable by links, its own included).

    Null and empty texts have no shingles and are linked with nothing; texts of fewer words than a shingle are equal or
    not linked. Repeated rows get equal results; a null key is larger than every other and is told only where a
    component has no other. An empty table gives no rows. Only key and text are read, so other columns may clash.
    """
    texts = _texts(docs, key, text)
    described = cut(describe(docs, key, text))
    base = described.filter("frequent is null").select("key", "n", "class")
    top = described.filter("frequent is not null").groupBy("frequent").agg(F.sum("times").alias("times"))
    # At most FREQUENT numbers.
    frequent = np.array([r["frequent"] for r in top.orderBy(F.desc("times"), "frequent").limit(FREQUENT).collect()], dtype=np.int64)
    shapes = described.filter("occupancy is not null").groupBy("class").agg(F.first("n").alias("n"), F.first("occupancy").alias("occupancy"))
    label = components(class_links(texts, shapes, np.sort(frequent.view(np.uint64))))
    classes = base.filter("n > 0").groupBy("class").agg(F.min("key").alias("first"))
    rooted = classes.join(label, F.col("class") == F.col("node"), "left").select("class", "first", F.coalesce("label", "class").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(roots, "root").select(F.col("class").alias("c"), "component_id")
    joined = base.join(named, (F.col("class") == F.col("c")) & (F.col("n") > 0), "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return joined.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))
