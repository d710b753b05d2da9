"""Prefix trie of conversations, from double-array tries of prefix shards.

Conversations are sequences of turns, a turn is a 128-bit hash of its role and text. Equal sequences are merged, the rest is
dealt out by ranges of the sequences and sorted, so that a shard holds neighbours. A shard numbers its turns densely,
packs BASE and CHECK arrays, walks its sequences through them and adds up the nodes. Only the nodes on the way to a shard's
first and last sequence can also lie in another shard: those upper nodes are merged by a scan in order with a stack, all
others are final where they are made. A node is known everywhere by two polynomial hashes of its turns.

Longer sequences are cut at fixed depths; the tries of deeper segments hang on nodes of the segment above and are built
first, so that their sums enter the tries above. Memory is bounded by shards and segments, not by conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.pieces import BYTES, MOST_KEYS, ROWS, in_order, large_pieces, scan, sizes
from cohortloom.session import cut

#: Turns of a shard, about; cells that are tried for a node with several children before it goes behind the used part.
SHARD, TRIES = 1 << 17, 32
#: The turns that a rebuilt conversation takes from another one, at most, and the distance of those others.
HEAD, DONORS = 5, 100
#: Turns that deal sequences out (these are sampled on the driver).
DEALT = 64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, np.ndarray] = {}
LATE = np.iinfo(np.int64).max


def power(which: int, n: int) -> np.uint64:
    return np.uint64(pow(_BASES[which], n, 1 << 64))


def powers(which: int, n: int) -> np.ndarray:
    if len(_POWERS.get(which, ())) < n:
        steps = np.full(max(n, 4096), _BASES[which], dtype=np.uint64)
        steps[0] = 1
        _POWERS[which] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[which][:n]


class DoubleArray:
    """A trie in two arrays: the child of state s by code c is t = BASE[s] + c where CHECK[t] = s. State 0 is the root."""

    def __init__(self):
        self.base, self.check, self.free, self.used = [0], [0], [1, 1], 1

    def _grow(self, size: int) -> None:
        more = size - len(self.check)
        if more > 0:
            more = max(more, len(self.check))
            self.base += [0] * more
            self.check += [-1] * more
            self.free += range(len(self.free), len(self.check) + 1)

    def _next(self, cell: int) -> int:
        """The first free cell from ``cell`` on."""
        self._grow(cell + 1)
        free = self.free
        while free[cell] != cell:
            free[cell] = free[free[cell]]
            cell = free[cell]
            self._grow(cell + 1)
        return cell

    def add(self, state: int, codes: list[int]) -> int:
        """Gives ``state`` children by ascending ``codes``; returns its base."""
        low, high = codes[0], codes[-1]
        cell = self._next(low + 1)
        for _ in range(TRIES):
            base = cell - low
            self._grow(base + high + 1)
            check = self.check
            if all(check[base + c] < 0 for c in codes):
                break
            cell = self._next(cell + 1)
        else:
            base = max(self.used - low, 1)
            self._grow(base + high + 1)
        for c in codes:
            self.check[base + c] = state
            self.free[base + c] = base + c + 1
        self.base[state] = base
        self.used = max(self.used, base + high + 1)
        return base


def dense(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers 0 .. of distinct pairs."""
    if not len(a):
        return np.zeros(0, np.int64), 0
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.zeros(len(a), dtype=np.int64)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    out = np.empty(len(a), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out, int(out[order[-1]]) + 1


class Shard:
    """Sorted distinct sequences: where they start (s1, s2), turns (a, b, chars) by offsets, members, smallest member,
    and sums of tries that hang on their ends (children, leaves, saved)."""

    def __init__(self, s1, s2, offsets, a, b, chars, n, conv, below):
        self.s1, self.s2, self.offsets, self.chars, self.n, self.conv, self.below = s1, s2, offsets, chars, n, conv, below
        self.a, self.b = a, b
        turn, turns = dense(a, b)
        start, starts = dense(s1, s2)
        self.turn, self.start, self.width = turn + 1, start + turns + 1, turns + starts + 1
        self.lengths = np.diff(offsets)

    def codes(self, step: int, alive: np.ndarray) -> np.ndarray:
        return self.start[alive] if step == 0 else self.turn[self.offsets[alive] + step - 1]

    def pack(self) -> DoubleArray:
        trie, state = DoubleArray(), np.zeros(len(self.n), np.int64)
        for step in range(int(self.lengths.max()) + 1):
            alive = np.flatnonzero(self.lengths >= step)
            arcs, where = np.unique(state[alive] * self.width + self.codes(step, alive), return_inverse=True)
            parents, codes = arcs // self.width, arcs % self.width
            firsts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
            lasts = np.append(firsts[1:], len(parents))
            listed = codes.tolist()
            bases = [trie.add(p, listed[i:j]) for p, i, j in zip(parents[firsts].tolist(), firsts.tolist(), lasts.tolist(), strict=True)]
            state[alive] = (np.repeat(np.array(bases, np.int64), lasts - firsts) + codes)[where]
        return trie

    def nodes(self, depth: int) -> dict[str, np.ndarray]:
        """Walks the sequences and adds up the nodes. Those that other shards may share are not ``closed``: they hold
        what closed children give them; ``pos`` orders them as they are met."""
        trie = self.pack()
        base, check = np.array(trie.base, np.int64), np.array(trie.check, np.int64)
        size = len(check)
        n, conv, chars, level = np.zeros(size, np.int64), np.full(size, LATE), np.zeros(size, np.int64), np.full(size, -1)
        k1, k2 = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        kids, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        pos, member = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        state, h1, h2 = np.zeros(len(self.n), np.int64), self.s1.copy(), self.s2.copy()
        levels = []
        for step in range(int(self.lengths.max()) + 1):
            alive = np.flatnonzero(self.lengths >= step)
            before = state[alive]
            now = base[before] + self.codes(step, alive)
            if not (check[now] == before).all():
                raise AssertionError("a sequence left its trie")
            if step:
                at = self.offsets[alive] + step - 1
                h1[alive] += self.a[at] * power(0, depth + step - 1)
                h2[alive] += self.b[at] * power(1, depth + step - 1)
                chars[now] = self.chars[at]
            k1[now], k2[now], level[now], member[now] = h1[alive], h2[alive], step, alive
            np.add.at(n, now, self.n[alive])
            np.minimum.at(conv, now, self.conv[alive])
            ends = self.lengths[alive] == step
            for sums, more in zip((kids, leaves, saved), self.below, strict=True):
                np.add.at(sums, now[ends], more[alive[ends]])
            for i, order in ((0, 0), (len(self.n) - 1, 1 << 32)):
                here = now[alive == i]
                pos[here[pos[here] < 0]] = order + step
            if step == 0:
                pos[now[pos[now] < 0]] = 1 << 33
            state[alive] = now
            levels.append(np.unique(now))
        closed = pos < 0
        for some in reversed(levels):
            done = some[closed[some]]
            leaves[done] = np.where(kids[done] == 0, 1, leaves[done])
            saved[done] += (n[done] - 1) * chars[done]
            up = check[done]
            np.add.at(kids, up, 1)
            np.add.at(leaves, up, leaves[done])
            np.add.at(saved, up, saved[done])
        found = np.concatenate(levels)
        up = check[found]
        known = closed[up]
        return {
            "closed": closed[found], "start": level[found] == 0, "depth": depth + level[found].astype(np.int64), "p1": k1[found].view(np.int64), "p2": k2[found].view(np.int64),
            "q1": k1[up].view(np.int64), "q2": k2[up].view(np.int64), "conv": conv[found], "parent_conv": np.ma.array(conv[up], mask=~known), "n": n[found], "kids": kids[found],
            "leaves": leaves[found], "saved": saved[found], "chars": chars[found], "pos": pos[found],
            "s1": self.s1[member[found]].view(np.int64), "s2": self.s2[member[found]].view(np.int64),
        }


NODE = "closed boolean, start boolean, depth bigint, p1 bigint, p2 bigint, q1 bigint, q2 bigint, conv bigint, parent_conv bigint, n bigint, kids bigint, leaves bigint, saved bigint, chars bigint, s1 bigint, s2 bigint, part bigint, shard bigint, pos bigint"
NODES = [t.split(" ")[0] for t in NODE.split(", ")]


def flat(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets from zero and the fields of a list of structs."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = column.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    return offsets - offsets[0], [np.asarray(values.field(f)) for f in ("a", "b", "chars")]


def unsigned(column) -> np.ndarray:
    return np.asarray(column).astype(np.int64).view(np.uint64)


def shard_nodes(batches: Iterator[pa.RecordBatch], depth: int, turns: int) -> Iterator[pa.RecordBatch]:
    """Nodes of the shards of a partition of sorted sequences."""
    held: list[pa.RecordBatch] = []
    count = shard = 0

    def told() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        offsets, (a, b, chars) = flat(table.column("seq").chunk(0))
        below = [np.asarray(table.column(c)) for c in ("kids", "leaves", "saved")]
        sequences = Shard(unsigned(table.column("s1")), unsigned(table.column("s2")), offsets, a.astype(np.int64).view(np.uint64), b.astype(np.int64).view(np.uint64), chars, np.asarray(table.column("n")), np.asarray(table.column("conv")), below)
        found = sequences.nodes(depth)
        found["part"] = np.full(len(found["n"]), table.column("part")[0].as_py(), np.int64)
        found["shard"] = np.full(len(found["n"]), shard, np.int64)
        arrays = [pa.array(found[c].data, mask=found[c].mask) if isinstance(found[c], np.ma.MaskedArray) else pa.array(found[c]) for c in NODES]
        return pa.RecordBatch.from_arrays(arrays, names=NODES)

    for batch in batches:
        lengths = np.diff(np.asarray(batch.column("seq").offsets)) + 1
        start = 0
        while start < batch.num_rows:
            fits = int(np.searchsorted(np.cumsum(lengths[start:]), turns - count, side="right"))
            take = max(fits, 0 if count else 1)
            if take:
                held.append(batch.slice(start, take))
                count += int(lengths[start : start + take].sum())
                start += take
            if start < batch.num_rows:
                yield told()
                held, count, shard = [], 0, shard + 1
    if held:
        yield told()


UPPER = "start boolean, depth bigint, p1 bigint, p2 bigint, q1 bigint, q2 bigint, conv bigint, n bigint, kids bigint, leaves bigint, saved bigint"
UPPERS = [t.split(" ")[0] for t in UPPER.split(", ")]


def merge_upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the upper nodes of shards, which come in order: the stack holds the way to the node at hand. A start keeps
    the sums of its children alone (its own members belong to the segment above)."""
    stack: list[dict] = []
    out: list[dict] = []

    def pop() -> None:
        e = stack.pop()
        if not e["start"] or e["depth"] == 0:
            e["leaves"] = e["leaves"] if e["kids"] else 1
            e["saved"] += (e["n"] - 1) * e["chars"]
        out.append(e)
        if stack:
            up = stack[-1]
            up["kids"], up["leaves"], up["saved"] = up["kids"] + 1, up["leaves"] + e["leaves"], up["saved"] + e["saved"]

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[c] for e in out], pa.bool_() if c == "start" else pa.int64()) for c in UPPERS], names=UPPERS)

    for batch in batches:
        for r in batch.to_pylist():
            if r["start"] and stack and (stack[0]["p1"], stack[0]["p2"]) != (r["p1"], r["p2"]):
                while stack:
                    pop()
            at = r["depth"] - stack[0]["depth"] if stack else 0
            if at < len(stack) and (stack[at]["p1"], stack[at]["p2"]) == (r["p1"], r["p2"]):
                same = stack[at]
                for c in ("n", "kids", "leaves", "saved"):
                    same[c] += r[c]
                same["conv"] = min(same["conv"], r["conv"])
                continue
            while len(stack) > at:
                pop()
            stack.append(r)
        if len(out) >= 1000:
            yield told()
            out.clear()
    while stack:
        pop()
    if out:
        yield told()


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds (e1, e2), the node at which a sequence that starts at (s1, s2) and depth0 ends."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, (a, b, _) = flat(batch.column("seq"))
        lengths = np.diff(offsets)
        inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
        most, ends = int(lengths.max()), []
        for which, turns, start in ((0, a, "s1"), (1, b, "s2")):
            sums = np.zeros(offsets[-1] + 1, np.uint64)
            np.cumsum(turns.astype(np.int64).view(np.uint64) * powers(which, most)[inside], out=sums[1:])
            lift = np.array([power(which, d) for d in batch.column("depth0").to_pylist()], np.uint64)
            ends.append(pa.array((unsigned(batch.column(start)) + (sums[offsets[1:]] - sums[offsets[:-1]]) * lift).view(np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns, *ends], names=[*batch.schema.names, "e1", "e2"])


TURN = "struct<a:bigint,b:bigint,chars:bigint>"
SEGMENT = f"key bigint, depth0 bigint, s1 bigint, s2 bigint, seq array<{TURN}>, last boolean"


def with_ends(segments: DataFrame) -> DataFrame:
    return segments.mapInArrow(_ended, f"{SEGMENT}, e1 bigint, e2 bigint")


def _turn() -> Column:
    return F.struct("a", "b", "chars")


def _start(state, row: dict):
    """Where the segments of a conversation start, from what each adds (its end when it starts at nothing)."""
    a, b = state
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    return (wrap(a + row["e1"]), wrap(b + row["e2"])), {"depth0": row["depth0"], "s1": a, "s2": b}


def _offset(state: int, row: dict):
    return state + row["size"], {"piece": row["piece"], "before": state}


def rebuilt(conversations: DataFrame, key: str, turn: str, role: str, text: str, most: int, size: int) -> DataFrame:
    """Segments (see SEGMENT) with their end nodes, of the rebuilt conversations: the first h turns of conversation
    key - key % 100, then the own turns after the first h; h is crc32 of the key modulo 6."""
    said, told = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.select(F.col(key).cast("bigint").alias("key"), F.col(turn).cast("bigint").alias("turn"), said.alias("role"), told.alias("text")).filter("key IS NOT NULL")
    rows = rows.select("key", "turn", "role", F.substring("text", 1, 64).alias("head"), F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(17), "text", "role").alias("b"), F.char_length("text").cast("bigint").alias("chars"))
    large = cut(sizes(rows, "key", F.lit(128), most, size).filter("large").select("group"))
    n_large = large.count()
    some = F.broadcast(large) if n_large <= MOST_KEYS else large
    small = rows.join(some, F.col("key") == F.col("group"), "left_anti") if n_large else rows
    item = F.struct("turn", "role", "head", "a", "b", "chars")
    ordered = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["chars"].alias("chars")))
    whole = cut(small.groupBy("key").agg(ordered.alias("rows")))
    is_donor = F.col("key") == F.col("key") - F.col("key") % DONORS
    heads = whole.filter(is_donor).select(F.col("key").alias("donor"), F.slice("rows", 1, HEAD).alias("head"))
    if n_large:
        order = [F.col("turn"), F.col("role"), F.col("head"), F.col("a"), F.col("b")]
        pieces = cut(large_pieces(rows.join(some, F.col("key") == F.col("group"), "left_semi"), "key", order, F.struct("turn", "a", "b", "chars"), F.lit(32), most, size))
        sized = in_order(pieces.select("key", "piece", F.size("rows").cast("bigint").alias("size")), "piece")
        before = sized.mapInArrow(scan("piece bigint, before bigint", 0, _offset), "key bigint, piece bigint, before bigint")
        placed = pieces.join(before.select(F.col("piece").alias("p"), "before"), F.col("piece") == F.col("p"))
        numbered = placed.select("key", "before", F.posexplode("rows").alias("i", "x")).select("key", (F.col("before") + F.col("i")).alias("at"), "x.a", "x.b", "x.chars")
        firsts = numbered.filter(F.col("at") < HEAD).filter(is_donor).groupBy(F.col("key").alias("donor")).agg(F.sort_array(F.collect_list(F.struct("at", "a", "b", "chars"))).alias("head"))
        bare = F.transform("head", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["chars"].alias("chars")))
        heads = heads.unionByName(firsts.select("donor", bare.alias("head")))
    h = (F.crc32(F.col("key").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    taken = F.slice(F.coalesce("head", F.array().cast(f"array<{TURN}>")), F.lit(1), h)

    def headed(df: DataFrame) -> DataFrame:
        return df.join(heads, F.col("key") - F.col("key") % DONORS == F.col("donor"), "left")

    zero = [F.lit(0).cast("bigint").alias(c) for c in ("depth0", "s1", "s2")]
    own = F.slice("rows", h + 1, F.greatest(F.size("rows"), F.lit(1)))
    segments = with_ends(headed(whole).select("key", *zero, F.concat(taken, own).alias("seq"), F.lit(True).alias("last")))
    if not n_large:
        return segments
    deep = most + HEAD
    lead = headed(large.select(F.col("group").alias("key"))).select("key", F.size(taken).alias("n_head"), taken.alias("taken"))
    in_head = lead.select("key", F.posexplode("taken").alias("at", "x")).select("key", F.col("at").cast("bigint").alias("depth"), "x.a", "x.b", "x.chars")
    after = numbered.filter(F.col("at") >= h).join(lead.select(F.col("key").alias("k"), "n_head"), F.col("key") == F.col("k"))
    every = in_head.unionByName(after.select("key", (F.col("at") - h + F.col("n_head")).alias("depth"), "a", "b", "chars"))
    cells = every.groupBy("key", F.floor(F.col("depth") / deep).alias("cell")).agg(F.sort_array(F.collect_list(F.struct("depth", "a", "b", "chars"))).alias("rows"))
    turns = F.transform("rows", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["chars"].alias("chars")))
    ends = cells.groupBy(F.col("key").alias("k")).agg(F.max("cell").alias("end"))
    cells = cells.join(ends, F.col("key") == F.col("k")).select("key", (F.col("cell") * deep).alias("depth0"), *zero[1:], turns.alias("seq"), (F.col("cell") == F.col("end")).alias("last"))
    cells = cut(cells)
    moved = in_order(with_ends(cells).select("key", "depth0", "e1", "e2"), "depth0").mapInArrow(scan("depth0 bigint, s1 bigint, s2 bigint", (0, 0), _start), "key bigint, depth0 bigint, s1 bigint, s2 bigint")
    moved = moved.select(F.col("key").alias("k"), F.col("depth0").alias("d"), "s1", "s2")
    cells = cells.drop("s1", "s2").join(moved, (F.col("key") == F.col("k")) & (F.col("depth0") == F.col("d"))).select("key", "depth0", "s1", "s2", "seq", "last")
    # A conversation that keeps no turn still is a member of the root.
    none = large.join(cells.select("key").distinct(), F.col("group") == F.col("key"), "left_anti")
    none = none.select(F.col("group").alias("key"), *zero, F.array().cast(f"array<{TURN}>").alias("seq"), F.lit(True).alias("last"))
    return segments.unionByName(with_ends(cells.unionByName(none)))


def _level(segments: DataFrame, depth: int, below: DataFrame | None, turns: int) -> DataFrame:
    """Nodes of the segments that start at a depth, those closed and those merged, and their starts."""
    merged = segments.filter(F.col("depth0") == depth).groupBy("s1", "s2", "seq", "e1", "e2").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("conv"))
    sums = ("kids", "leaves", "saved")
    if below is None:
        merged = merged.withColumns({c: F.lit(0).cast("bigint") for c in sums})
    else:
        merged = merged.join(below, (F.col("e1") == F.col("p1")) & (F.col("e2") == F.col("p2")), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in sums})
    by = ["s1", "s2", "seq"]
    dealt = merged.withColumn("dealt", F.slice("seq", 1, DEALT)).repartitionByRange("s1", "s2", "dealt").sortWithinPartitions(*by)
    named = dealt.select("s1", "s2", "seq", "n", "conv", *sums, F.spark_partition_id().cast("bigint").alias("part"))
    found = cut(named.mapInArrow(lambda batches: shard_nodes(batches, depth, turns), NODE))
    upper = found.filter("NOT closed").repartition("s1", "s2").sortWithinPartitions("s1", "s2", "part", "shard", "pos")
    shared = upper.mapInArrow(merge_upper, UPPER).withColumn("parent_conv", F.lit(None).cast("bigint")).withColumn("closed", F.lit(False))
    names = ["closed", *UPPERS, "parent_conv"]
    return cut(found.filter("closed").select(names).unionByName(shared.select(names)))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(e1, e2, sha): hash of the keys that end at a node; rows come sorted by node and key."""
    out: list[tuple] = []
    node, sha = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in out], pa.int64()), pa.array([r[0][1] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names=["e1", "e2", "sha"])

    for batch in batches:
        for a, b, k in zip(*(batch.column(c).to_pylist() for c in ("e1", "e2", "key")), strict=True):
            if (a, b) == node:
                sha.update(b",%d" % k)
                continue
            if node is not None:
                out.append((node, sha.hexdigest()))
            node, sha = (a, b), hashlib.sha256(b"%d" % k)
        if len(out) >= 10_000:
            yield told()
            out.clear()
    if node is not None:
        out.append((node, sha.hexdigest()))
    if out:
        yield told()


def prefix_trie(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = ROWS, size: int = BYTES, shard: int = SHARD) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are taken by number, nulls first, ties by role, the first 64 characters of the text and its hash. A null role or
    text is empty; rows without a key belong to no conversation; rows that are repeated are turns of their own. Texts of
    any length; an empty table has no nodes. Keys are integers; extra columns are left out.
    """
    segments = cut(rebuilt(conversations, key, turn, role, text, most, size))
    deepest = segments.agg(F.max("depth0").alias("d")).collect()[0]["d"]
    levels, below = [], None
    for depth in range(0 if deepest is None else deepest, -1, -(most + HEAD)):
        found = _level(segments, depth, below, shard)
        below = found.filter("start").select("p1", "p2", "kids", "leaves", "saved")
        levels.append(found.filter("NOT start") if depth else found)
    if not levels:
        levels = [_level(segments, 0, None, shard)]
    nodes = levels[0]
    for other in levels[1:]:
        nodes = nodes.unionByName(other)
    # Parents that were final in the node's own shard are known. Others are upper nodes or starts, a small part of all.
    open_ = F.col("parent_conv").isNull() & (F.col("depth") > 0)
    parents = nodes.filter((~F.col("closed")) | (F.col("depth") % (most + HEAD) == 0)).select(F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("conv").alias("up"))
    asked = nodes.filter(open_).join(parents, (F.col("q1") == F.col("u1")) & (F.col("q2") == F.col("u2"))).withColumn("parent_conv", F.col("up")).drop("u1", "u2", "up")
    nodes = nodes.filter(~open_).unionByName(asked)
    ends = segments.filter("last").select("e1", "e2", "key").repartition("e1", "e2").sortWithinPartitions("e1", "e2", "key").mapInArrow(_ends, "e1 bigint, e2 bigint, sha string")
    joined = nodes.join(ends, (F.col("p1") == F.col("e1")) & (F.col("p2") == F.col("e2")), "left")
    return joined.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent_conv").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
