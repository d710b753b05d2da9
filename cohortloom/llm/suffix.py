"""Suffix-array dedup of passages: each byte covered by a SPAN-byte string that also starts in a smaller document goes.

Only sampled suffixes are sorted. Of every SPAN-byte window the K-byte gram with the smallest hash is its anchor, so equal
windows have equal anchors at equal places, and one suffix in about 14 is an anchor. Steps:

1. Tasks tell which anchor grams they have; grams of one document alone leave the race (a bounded bit map of the others
   only saves work: a gram let through in error finds no partner).
2. The suffixes at the remaining anchors are sorted in runs, front-coded (length of the prefix shared with the suffix
   before, then the rest) with the bytes before the anchor that its windows need, and exchanged by the anchor's gram.
3. A loser tree merges the runs by the first suffixes of their blocks. It carries for every head the length of the prefix
   shared with the last winner: unequal lengths decide without a look at the bytes, equal ones compare behind the known
   prefix only. All suffixes below the next head are there; NumPy puts them in order.
4. Suffixes that share K bytes are neighbours now. The shared lengths to both sides of the anchor, between each and the one
   of the smallest document, tell their common windows; what some rounds leave open is settled by hashes of the windows.

Windows that a smaller document of the same sorted lot holds are settled before the exchange, copies of whole texts before
everything else, and windows of very frequent grams are exchanged each by its own hash, so that no group is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.bitmap import bit_map, has_bit
from cohortloom.llm.text import _BYTE_VALUE, Chunk, _powers, chunks, mix64, prefix_hash, range_hash
from cohortloom.session import cut

SPAN, K = 50, 24
REACH = SPAN - K
PIECE = 1 << 19
#: Anchors that a task gathers before it tells their grams.
GATHERED = 1 << 20
#: Bits of the map of shared grams, documents from which a gram counts as frequent, and frequent grams at most.
MAP_BITS, FREQUENT_FROM, FREQUENT = 27, 512, 1 << 16
#: Suffixes that a task sorts into runs at once; suffixes of a merge, about; of a block; that a merge puts in order at once.
SORTED, MERGED, BLOCK, ORDERED = 200_000, 200_000, 256, 50_000
#: Comparisons with the smallest document of a group before windows are hashed; rows of windows that are hashed at once.
ROUNDS, COMPARED = 4, 8_000
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``width`` consecutive values, by doubling."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


class Anchors:
    """Grams, windows and anchors of a chunk. ``low[q]`` is the smallest gram hash of the window that starts at q."""

    def __init__(self, chunk: Chunk):
        self.sums = prefix_hash(chunk, fold=False)
        self.at = np.zeros(0, dtype=np.int64)
        self.grams = np.zeros(0, dtype=np.uint64)
        if len(chunk.data) < SPAN:
            return
        # As range_hash of every K bytes, but in place and with a shorter finish: this is the hottest loop.
        grams = self.sums[K:] - self.sums[:-K]
        grams *= _powers(len(grams))[1]
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0x94D049BB133111EB)
        grams ^= grams >> np.uint64(29)
        self.grams = grams
        ends = chunk.offsets[1:-1]
        across = (ends[:, None] - np.arange(1, K)).ravel()
        self.grams[across[(across >= 0) & (across < len(self.grams))]] = NEVER
        self.low = _sliding(self.grams, REACH + 1, np.minimum)
        self.valid = np.ones(len(self.low), dtype=bool)
        across = (ends[:, None] - np.arange(1, SPAN)).ravel()
        self.valid[across[(across >= 0) & (across < len(self.low))]] = False
        none = np.zeros(REACH, np.uint64)
        covering = _sliding(np.concatenate([none, np.where(self.valid, self.low, np.uint64(0)), none]), REACH + 1, np.maximum)
        self.at = np.flatnonzero(covering == self.grams)

    def rows(self, chunk: Chunk) -> np.ndarray:
        return np.searchsorted(chunk.offsets, self.at, side="right") - 1


def _fresh(batch: pa.RecordBatch, seen: dict) -> pa.RecordBatch:
    """Without rows whose text a task has met under the same or a smaller key, short texts, and null keys."""
    keep = []
    for key, tag, size in zip(batch.column("key").to_pylist(), batch.column("hash").to_pylist(), batch.column("size").to_pylist(), strict=True):
        have = seen.get((tag, size))
        ok = key is not None and size >= SPAN and (have is None or key < have)
        if ok:
            seen[tag, size] = key
        keep.append(ok)
    return batch.filter(pa.array(keep, pa.bool_()))


def gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor grams of a partition: 56 bits of the hash, and the number of documents that have it (255 at most)."""
    seen: dict = {}
    grams, rows, base, n = [], [], 0, 0

    def told() -> pa.RecordBatch:
        g, r = np.concatenate(grams) >> np.uint64(8), np.concatenate(rows)
        order = np.argsort(g, kind="stable")
        g, r = g[order], r[order]
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        g, times = np.unique(g[new], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array((g << np.uint64(8) | np.minimum(times, 255).astype(np.uint64)).view(np.int64))], names=["gram"])

    for batch in batches:
        for chunk in chunks(_fresh(batch, seen).column("text"), PIECE):
            anchors = Anchors(chunk)
            grams.append(anchors.grams[anchors.at])
            rows.append(anchors.rows(chunk) + base)
            base, n = base + chunk.rows, n + len(anchors.at)
            if n >= GATHERED:
                yield told()
                grams, rows, n = [], [], 0
    if n:
        yield told()


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known to agree."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - 1 - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() - 1) // 8


def alike(differ: np.ndarray) -> np.ndarray:
    """Length of the prefix without a difference, for every row of flags."""
    n = differ.argmax(axis=1)
    n[~differ[np.arange(len(n)), n]] = differ.shape[1]
    return n


def high_bit(mask: np.ndarray) -> np.ndarray:
    return np.frexp(mask.astype(np.float64))[1].astype(np.int64) - 1


def low_bit(mask: np.ndarray) -> np.ndarray:
    return high_bit(mask & (~mask + np.uint32(1)))


@dataclass
class Rows:
    """Suffixes. ``wide`` has the REACH bytes before the anchor and SPAN bytes from it on, zeros where a row has fewer
    (``before``, ``size``). Bit b of ``mask`` stands for the window that starts b bytes before the anchor, ``at``."""

    wide: np.ndarray
    size: np.ndarray
    before: np.ndarray
    mask: np.ndarray
    key: np.ndarray
    tag: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, wide, size, before, mask, key, tag, at) -> Rows:
        column = np.arange(REACH + SPAN)
        size, before = np.asarray(size, np.uint8), np.asarray(before, np.uint8)
        inside = (column >= REACH - before[:, None].astype(np.int64)) & (column < REACH + size[:, None].astype(np.int64))
        return cls(wide * inside, size, before, mask.astype(np.uint32), key.astype(np.int64), tag.astype(np.int32), at.astype(np.int32))

    @classmethod
    def concat(cls, some: list[Rows]) -> Rows:
        return cls(*(np.concatenate([getattr(r, f.name) for r in some]) for f in fields(cls)))

    def __len__(self) -> int:
        return len(self.size)

    def take(self, index) -> Rows:
        return Rows(*(getattr(self, f.name)[index] for f in fields(self)))

    def order(self, part: np.ndarray) -> np.ndarray:
        """Order by part, suffix and key."""
        text = np.empty((len(self), SPAN + 13), np.uint8)
        text[:, :4] = part.astype(">u4").view(np.uint8).reshape(-1, 4)
        text[:, 4 : SPAN + 4] = self.wide[:, REACH:]
        text[:, SPAN + 4] = self.size
        text[:, SPAN + 5 :] = (self.key.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
        return np.argsort(text.view(f"S{SPAN + 13}").ravel(), kind="stable")

    def shared(self) -> np.ndarray:
        """Length of the prefix that each suffix shares with the one before."""
        out = np.zeros(len(self), dtype=np.int64)
        suffix = self.wide[:, REACH:]
        if len(self) > 1:
            out[1:] = np.minimum(alike(suffix[1:] != suffix[:-1]), np.minimum(self.size[1:], self.size[:-1]))
        return out


def spans_of(gone: np.ndarray, key: np.ndarray, tag: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A span for the windows of each mask ``gone``, which isn't 0: windows of one anchor overlap."""
    out = np.zeros(len(gone), dtype=SPAN_RECORD)
    out["key"], out["tag"] = key, tag
    out["first"], out["last"] = at - high_bit(gone), at - low_bit(gone) + SPAN
    return out


SPAN_RECORD = np.dtype([("key", "<i8"), ("tag", "<i4"), ("first", "<i4"), ("last", "<i4")])
#: Columns of a run besides its bytes.
COLUMNS = [("shared", "u1"), ("size", "u1"), ("before", "u1"), ("mask", "<u4"), ("key", "<i8"), ("tag", "<i4"), ("at", "<i4")]


def packed(parts: list[bytes], n: int) -> bytes:
    body = b"".join(parts)
    return n.to_bytes(4, "little") + len(body).to_bytes(4, "little") + pa.compress(body, "zstd", asbytes=True)


def unpacked(blob: bytes) -> tuple[int, bytes]:
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    return n, pa.decompress(blob[8:], size, "zstd", asbytes=True)


def encode_runs(rows: Rows, shared: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """Front-code sorted rows: a run for each two neighbouring ``cuts``, where ``shared`` is 0."""
    column = np.arange(SPAN)
    has = (column >= shared[:, None]) & (column < rows.size[:, None])
    rest, rest_at = rows.wide[:, REACH:][has], np.concatenate([[0], np.cumsum(rows.size - shared)])
    has = column[:REACH] >= REACH - rows.before[:, None].astype(np.int64)
    left, left_at = rows.wide[:, :REACH][has], np.concatenate([[0], np.cumsum(rows.before, dtype=np.int64)])
    columns = [(shared if name == "shared" else getattr(rows, name)).astype(kind) for name, kind in COLUMNS]
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        body = [c[a:b].tobytes() for c in columns]
        out.append(packed([*body, rest[rest_at[a] : rest_at[b]].tobytes(), left[left_at[a] : left_at[b]].tobytes()], b - a))
    return out


def encode_run(suffixes: list[bytes], befores: list[bytes], mask: np.ndarray, key: np.ndarray, tag: np.ndarray, at: np.ndarray) -> bytes:
    """Sort suffixes (ties by key) and front-code them."""
    text = b"".join(b.rjust(REACH, b"\0") + s.ljust(SPAN, b"\0") for s, b in zip(suffixes, befores, strict=True))
    wide = np.frombuffer(text, np.uint8).reshape(-1, REACH + SPAN)
    rows = Rows.of(wide, [len(s) for s in suffixes], [len(b) for b in befores], mask, key, tag, at)
    rows = rows.take(rows.order(np.zeros(len(rows), np.int64)))
    return encode_runs(rows, rows.shared(), np.array([0, len(rows)]))[0]


def decode_runs(blobs: list[bytes]) -> tuple[Rows, np.ndarray]:
    """The suffixes of some runs, one run after the other, and where each run starts (and the last ends)."""
    columns: list[list[np.ndarray]] = [[] for _ in COLUMNS]
    rests, lefts, ends = [], [], [0]
    for blob in blobs:
        n, body = unpacked(blob)
        at = 0
        for (_, kind), values in zip(COLUMNS, columns, strict=True):
            values.append(np.frombuffer(body, kind, n, at))
            at += values[-1].nbytes
        size = int(columns[1][-1].sum(dtype=np.int64) - columns[0][-1].sum(dtype=np.int64))
        rests.append(np.frombuffer(body, np.uint8, size, at))
        lefts.append(np.frombuffer(body, np.uint8, offset=at + size) if at + size < len(body) else np.zeros(0, np.uint8))
        ends.append(ends[-1] + n)
    shared, size, before, mask, key, tag, at = (np.concatenate(c) for c in columns)
    n = len(shared)
    wide = np.zeros((REACH + SPAN, n), dtype=np.uint8)
    rest = np.concatenate([*rests, np.zeros(1, np.uint8)])
    # A byte comes from the last suffix that doesn't share it; runs start with 0 shared bytes, so none reaches into another.
    begin = np.cumsum(size.astype(np.int64) - shared) - size
    number = np.arange(n)
    for j in range(SPAN):
        source = np.maximum.accumulate(np.where(shared <= j, number, 0))
        has = j < size
        wide[REACH + j][has] = rest[begin[source[has]] + j]
    left = np.concatenate(lefts)
    begin = np.cumsum(before, dtype=np.int64) - REACH
    for j in range(REACH):
        has = j >= REACH - before.astype(np.int64)
        wide[j][has] = left[begin[has] + j]
    return Rows(np.ascontiguousarray(wide.T), size, before, mask, key, tag, at), np.array(ends)


class Run:
    """A run that is read from its start by blocks of ``step`` suffixes; ``suffix`` is the first of the block."""

    def __init__(self, blob: bytes | None = None, rows: Rows | None = None, first: int = 0, end: int = 0, step: int = 1):
        self.rows, self.next, self.end, self.step = rows, first, end, step
        if blob is not None:
            self.rows, ends = decode_runs([blob])
            self.end = int(ends[-1])
        self.suffix: bytes | None = b""
        self.key = self.first = 0

    def advance(self) -> int:
        """Go to the next block (its suffix is None at the end); returns the length its suffix shares with the one before."""
        i, last = self.next, self.suffix
        if i >= self.end:
            self.suffix = None
            return 0
        self.suffix = self.rows.wide[i, REACH : REACH + int(self.rows.size[i])].tobytes()
        self.key, self.first, self.next = int(self.rows.key[i]), i, min(i + self.step, self.end)
        return common(last, self.suffix, 0)


def merge(runs: list[Run]) -> Iterator[tuple[int, int]]:
    """(run, shared) of every suffix in sorted order; its bytes stand in the run until the next step. ``shared`` is the
    length of the prefix it shares with the suffix before. Inner nodes of the tree hold losers."""
    if not runs:
        return
    n = 1 << (len(runs) - 1).bit_length()
    shared = [run.advance() * 0 for run in runs]
    loser = [-1] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs; -1 and ended runs lose."""
        if a < 0 or runs[a].suffix is None:
            return b, a
        if b < 0 or runs[b].suffix is None:
            return a, b
        x, y = shared[a], shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        s, t = runs[a].suffix, runs[b].suffix
        both = common(s, t, x)
        if both == len(s) == len(t):
            first = (runs[a].key, a) < (runs[b].key, b)
        else:
            first = both == len(s) or (both < len(t) and s[both] < t[both])
        if first:
            shared[b] = both
            return a, b
        shared[a] = both
        return b, a

    winners = [*[-1] * n, *range(len(runs)), *[-1] * (n - len(runs))]
    for node in range(n - 1, 0, -1):
        winners[node], loser[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if n > 1 else 0
    while best >= 0 and runs[best].suffix is not None:
        yield best, shared[best]
        shared[best] = runs[best].advance()
        node = (best + n) // 2
        while node:
            best, loser[node] = play(best, loser[node])
            node //= 2


def removed_windows(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which windows also stand in a document with a smaller key."""
    order = np.lexsort((keys, hashes))
    h, k = hashes[order], keys[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    least = k[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    out = np.zeros(len(h), dtype=bool)
    out[order] = k > least
    return out


def hashed_windows(rows: Rows, mask: np.ndarray) -> np.ndarray:
    """Which windows of ``mask`` also stand in a document with a smaller key, by hashes of all of them."""
    up, down = _powers(REACH + SPAN + 1)
    sums = np.zeros((len(rows), REACH + SPAN + 1), np.uint64)
    np.cumsum(_BYTE_VALUE[rows.wide] * up[:-1], axis=1, out=sums[:, 1:])
    row, back = np.nonzero(mask[:, None] >> np.arange(REACH + 1, dtype=np.uint32) & np.uint32(1))
    begin = REACH - back
    hashes = mix64((sums[row, begin + SPAN] - sums[row, begin]) * down[begin] + np.uint64(SPAN))
    gone = removed_windows(hashes, rows.key[row])
    out = np.zeros(len(rows), dtype=np.uint32)
    np.bitwise_or.at(out, row[gone], np.uint32(1) << back[gone].astype(np.uint32))
    return out


def settle(rows: Rows, new: np.ndarray) -> np.ndarray:
    """Masks of the windows that also stand in a document with a smaller key of the group. ``new`` marks the first row of
    each group.

    A round compares each row with one of the smallest key. Windows that both have are settled, for all rows that have
    them, so the rest can be told without the windows that were settled before.
    """
    gone, left = np.zeros(len(rows), dtype=np.uint32), rows.mask.copy()
    group = np.cumsum(new)
    live = np.arange(len(rows))
    one = np.uint64(1)

    def several() -> tuple[np.ndarray, np.ndarray]:
        """Rows with open windows in groups of two and more, and where their groups start."""
        some = live[left[live] > 0]
        g = group[some]
        start = np.ones(len(some), dtype=bool)
        start[1:] = g[1:] != g[:-1]
        alone = start.copy()
        alone[:-1] &= start[1:]
        return some[~alone], np.flatnonzero(start[~alone])

    for _ in range(ROUNDS):
        live, start = several()
        if not len(live):
            return gone
        key = rows.key[live]
        number = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(live))))
        least = np.minimum.reduceat(key, start)[number]
        found = np.flatnonzero(key == least)
        lead = live[found[np.searchsorted(found, start)]][number]
        for a in range(0, len(live), ORDERED):
            i, m = live[a : a + ORDERED], lead[a : a + ORDERED]
            differ = rows.wide[i] != rows.wide[m]
            right = np.minimum(alike(differ[:, REACH:]), np.minimum(rows.size[i], rows.size[m]))
            before = np.minimum(alike(differ[:, REACH - 1 :: -1]), np.minimum(rows.before[i], rows.before[m]))
            same = ((one << (before + 1).astype(np.uint64)) - one) & ~((one << (SPAN - right).astype(np.uint64)) - one)
            same = same.astype(np.uint32) & left[i]
            gone[i] |= np.where(key[a : a + ORDERED] > least[a : a + ORDERED], same, np.uint32(0))
            left[i] &= ~same
    live, start = several()
    while len(live):
        end = np.searchsorted(start, COMPARED)
        end = int(start[end]) if end < len(start) else len(live)
        i = live[:end]
        gone[i] |= hashed_windows(rows.take(i), left[i])
        live, start = live[end:], start[start >= end] - end
    return gone


ROWS = pa.schema([("part", pa.int32()), ("run", pa.binary()), ("settled", pa.binary())])
ROW_TYPES = "part int, run binary, settled binary"


class Suffixes:
    """Suffixes of one or more chunks that wait to be sorted into runs, and spans that are settled."""

    def __init__(self):
        self.rows: list[Rows] = []
        self.parts: list[np.ndarray] = []
        self.settled: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, rows: Rows, part: np.ndarray) -> None:
        self.rows.append(rows)
        self.parts.append(part)
        self.waiting += len(rows)

    def runs(self) -> pa.RecordBatch:
        """One front-coded run and the settled spans for each part, and nothing waits any more."""
        rows, part = Rows.concat(self.rows), np.concatenate(self.parts)
        order = rows.order(part)
        rows, part = rows.take(order), part[order]
        new = rows.shared() < K
        new[1:] |= part[1:] != part[:-1]
        gone = settle(rows, new)
        some = np.flatnonzero(gone)
        self.settled.append((part[some], spans_of(gone[some], rows.key[some], rows.tag[some], rows.at[some])))
        rows.mask &= ~gone
        keep = rows.mask > 0
        rows, part = rows.take(keep), part[keep]
        spans_part = np.concatenate([p for p, _ in self.settled])
        order = np.argsort(spans_part, kind="stable")
        spans, spans_part = np.concatenate([s for _, s in self.settled])[order], spans_part[order]
        self.__init__()
        shared = rows.shared()
        new = np.ones(len(rows), dtype=bool)
        new[1:] = part[1:] != part[:-1]
        shared[new] = 0
        cuts = np.append(np.flatnonzero(new), len(rows))
        runs = dict(zip(part[cuts[:-1]].tolist(), encode_runs(rows, shared, cuts), strict=True))
        told = np.flatnonzero(np.diff(spans_part, prepend=-1))
        ends = np.append(told, len(spans))[1:]
        settled = {int(spans_part[a]): packed([np.ascontiguousarray(spans[f][a:b]).tobytes() for f in SPAN_RECORD.names], b - a) for a, b in zip(told.tolist(), ends.tolist(), strict=True)}
        parts = sorted(runs.keys() | settled.keys())
        arrays = [pa.array(parts, pa.int32()), pa.array([runs.get(p) for p in parts], pa.binary()), pa.array([settled.get(p) for p in parts], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, schema=ROWS)


def gather(chunk: Chunk, key: np.ndarray, tag: np.ndarray, bits: np.ndarray, frequent: np.ndarray, parts: int, into: Suffixes) -> None:
    """Hands on the suffixes that others must be compared with."""
    anchors = Anchors(chunk)
    a = anchors.at
    a = a[has_bit(bits, anchors.grams[a] >> np.uint64(8), MAP_BITS)]
    if not len(a):
        return
    row = np.searchsorted(chunk.offsets, a, side="right") - 1
    gram = anchors.grams[a]
    never = np.full(REACH, NEVER)
    low = np.concatenate([never, np.where(anchors.valid, anchors.low, NEVER), never])
    mask = np.zeros(len(a), dtype=np.uint32)
    for back in range(REACH + 1):
        mask |= (low[a + (REACH - back)] == gram).astype(np.uint32) << np.uint32(back)
    text = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(REACH, np.uint8), chunk.data, np.zeros(SPAN, np.uint8)]), REACH + SPAN)

    def add(at: np.ndarray, size: np.ndarray, before: np.ndarray, mask: np.ndarray, owner: np.ndarray, by: np.ndarray) -> None:
        part = ((by >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        into.add(Rows.of(text[at], size, before, mask, key[owner], tag[owner], at - chunk.offsets[owner]), part)

    hot = np.zeros(len(a), dtype=bool)
    if len(frequent):
        short = gram >> np.uint64(8)
        hot = frequent[np.minimum(np.searchsorted(frequent, short), len(frequent) - 1)] == short
    kept = np.flatnonzero((mask > 0) & ~hot)
    add(a[kept], SPAN - low_bit(mask[kept]), high_bit(mask[kept]), mask[kept], row[kept], gram[kept])
    if hot.any():
        i, back = np.nonzero(np.where(hot, mask, np.uint32(0))[:, None] >> np.arange(REACH + 1, dtype=np.uint32) & np.uint32(1))
        q, owner = a[i] - back, row[i]
        hashes = range_hash(anchors.sums, q, q + SPAN)
        gone = removed_windows(hashes, key[owner])
        whole = np.zeros(len(a), dtype=np.uint32)
        np.bitwise_or.at(whole, i[gone], np.uint32(1) << back[gone].astype(np.uint32))
        some = np.flatnonzero(whole)
        into.settled.append((row[some] % parts, spans_of(whole[some], key[row[some]], tag[row[some]], a[some] - chunk.offsets[row[some]])))
        q, owner, hashes = q[~gone], owner[~gone], hashes[~gone]
        add(q, np.full(len(q), SPAN), np.zeros(len(q), np.int64), np.ones(len(q), np.uint32), owner, hashes)


SPANS = pa.schema([("key", pa.int64()), ("tag", pa.int32()), ("first", pa.int64()), ("last", pa.int64())])


def _span_table(spans: np.ndarray) -> pa.Table:
    columns = [np.ascontiguousarray(spans[f.name]).astype(f.type.to_pandas_dtype()) for f in SPANS]
    return pa.table(columns, schema=SPANS)


def merge_part(table: pa.Table) -> pa.Table:
    """Spans to remove from the runs of one part; spans that were settled before pass through."""
    out = [np.zeros(0, dtype=SPAN_RECORD)]
    for blob in table.column("settled").drop_null().to_pylist():
        n, body = unpacked(blob)
        spans, at = np.zeros(n, dtype=SPAN_RECORD), 0
        for name in SPAN_RECORD.names:
            spans[name] = np.frombuffer(body, SPAN_RECORD[name], n, at)
            at += n * SPAN_RECORD[name].itemsize
        out.append(spans)
    blobs = table.column("run").drop_null().to_pylist()
    if not blobs:
        return _span_table(np.concatenate(out))
    rows, ends = decode_runs(blobs)
    runs = [Run(None, rows, a, b, BLOCK) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def compare(some: np.ndarray) -> None:
        these = rows.take(some)
        these = these.take(these.order(np.zeros(len(these), np.int64)))
        gone = settle(these, these.shared() < K)
        i = np.flatnonzero(gone)
        out.append(spans_of(gone[i], these.key[i], these.tag[i], these.at[i]))

    waiting: list[np.ndarray] = []
    held = 0
    most = ORDERED
    for number, _ in merge(runs):
        if held >= most:
            # Suffixes still to come are not below this head; groups below its gram are whole.
            some = np.concatenate(waiting)
            whole = np.ascontiguousarray(rows.wide[some, REACH : REACH + K]).view(f"S{K}").ravel() < runs[number].suffix[:K]
            if whole.any():
                compare(some[whole])
            waiting, held = [some[~whole]], int((~whole).sum())
            most = max(ORDERED, 2 * held)
        waiting.append(np.arange(runs[number].first, runs[number].next))
        held += len(waiting[-1])
    compare(np.concatenate(waiting))
    return _span_table(np.concatenate(out))


def _copies(rows: DataFrame) -> DataFrame:
    """Whole texts that a smaller key also has."""
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    digests = cut(rows.filter(F.col("size") >= SPAN).select("key", "tag", "size", digest.alias("digest")))
    several = digests.groupBy("digest").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    return digests.join(several, "digest").filter("key > least").select("key", "tag", F.lit(0).cast("bigint").alias("first"), F.col("size").alias("last"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, tag, first, last) of byte spans to remove; they may overlap. tag tells texts of one key apart."""
    spark = docs.sparkSession
    rows = _rows(docs, key, text)
    numbers = rows.select(F.col("key").cast("bigint").alias("key"), "tag", "hash", "size", "text")
    told = numbers.select("key", "hash", "size", "text").mapInArrow(gram_batches, "gram long")
    shared = cut(told.groupBy(F.expr("shiftrightunsigned(gram, 8)").alias("gram")).agg(F.sum(F.expr("gram & 255")).alias("times")).filter("times > 1"))
    total = shared.agg(F.sum("times").alias("n")).collect()[0]["n"] or 0
    bits = bit_map(shared, "gram", MAP_BITS)
    # At most FREQUENT rows.
    often = shared.filter(F.col("times") >= FREQUENT_FROM).orderBy(F.desc("times"), "gram").limit(FREQUENT).select("gram").collect()
    frequent = np.sort(np.array([r["gram"] for r in often], dtype=np.int64).astype(np.uint64))
    parts = max(16, total // MERGED)
    given = spark.sparkContext.broadcast((bits, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        bits, frequent = given.value
        waiting = Suffixes()
        for batch in batches:
            fresh = _fresh(batch, seen)
            keys, tags = np.asarray(fresh.column("key")), np.asarray(fresh.column("tag"))
            for chunk in chunks(fresh.column("text"), PIECE):
                part = slice(chunk.first, chunk.first + chunk.rows)
                gather(chunk, keys[part], tags[part], bits, frequent, parts, waiting)
                if waiting.waiting >= SORTED:
                    yield waiting.runs()
        if waiting.waiting or waiting.settled:
            yield waiting.runs()

    spans = numbers.mapInArrow(run, ROW_TYPES).groupBy("part").applyInArrow(merge_part, "key long, tag int, first long, last long")
    return spans.unionByName(_copies(numbers))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), body.alias("text")).withColumn("hash", F.xxhash64("text"))
    return rows.select("key", F.expr("cast(hash & 2147483647 AS int)").alias("tag"), "hash", F.octet_length("text").cast("bigint").alias("size"), "text")


def kept_bytes(chunk: Chunk, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(removed bytes, maximal removed runs, remaining bytes) of every row, from spans of the rows' bytes."""
    begin = chunk.offsets[row]
    size = len(chunk.data) + 1
    # Rows have a step each where a span begins or ends; all spans of a row end inside it.
    steps = np.bincount(begin + first, minlength=size) - np.bincount(begin + last, minlength=size)
    gone = np.cumsum(steps[:-1]) > 0
    rise = gone.copy()
    rise[1:] &= ~gone[:-1]
    starts = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
    rise[starts] = gone[starts]
    number = np.searchsorted(chunk.offsets, np.flatnonzero(rise), side="right") - 1
    removed = np.concatenate([[0], np.cumsum(gone)])[chunk.offsets]
    rest, ends = chunk.data[~gone].tobytes(), (chunk.offsets - removed).tolist()
    return np.diff(removed), np.bincount(number, minlength=chunk.rows), [rest[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans (maximal removed runs), kept (remaining bytes).

    Null is empty; keys are integers. Of texts repeated under one key none counts as the smaller document; a text under a
    null key is left whole and removes nothing. Texts below SPAN bytes stay. An empty table gives no rows.
    """
    rows = _rows(docs, key, text)
    spans = repeated_spans(docs, key, text).groupBy("key", "tag").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = spans.select(F.col("key").alias("k"), F.col("tag").alias("t"), "spans")
    joined = rows.join(spans, (F.col("key") == F.col("k")) & (F.col("tag") == F.col("t")), "left").select("key", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            counts = pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False)
            row, flat = np.repeat(np.arange(batch.num_rows), counts), spans.flatten()
            first, last = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            for chunk in chunks(batch.column("text")):
                a, b = np.searchsorted(row, [chunk.first, chunk.first + chunk.rows])
                gone, n, rest = kept_bytes(chunk, row[a:b] - chunk.first, first[a:b], last[a:b])
                arrays = [pa.array(c, k) for c, k in zip((np.diff(chunk.offsets), gone, n, rest), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                keys = batch.column("key").slice(chunk.first, chunk.rows)
                yield pa.RecordBatch.from_arrays([keys, *arrays], names=["key", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = joined.schema["key"].dataType.simpleString()
    done = joined.mapInArrow(run, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumnRenamed("key", key)


def repeat_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return remove_repeats(docs, key, text).select(key, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
