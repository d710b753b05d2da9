import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from cohortloom.llm import suffix as s
from cohortloom.llm.text import chunks


def plain(rows):
    data = [(k, (t or "").encode()) for k, t in rows]
    least = {}
    for k, b in data:
        if k is not None:
            for i in range(len(b) - 49):
                w = b[i : i + 50]
                least[w] = min(least.get(w, k), k)
    out = []
    for k, b in data:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 49):
            if k is not None and least[b[i : i + 50]] < k:
                gone[i : i + 50] = True
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((k, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 60, 120, 400)]
    rows = [(i, text(rng.randrange(0, 300))) for i in range(30)]
    for i in range(30, 150):
        rows.append((i * 7 % 1000, text(rng.randrange(0, 80)) + rng.choice(passages) + text(rng.randrange(0, 80)) + rng.choice(["", rng.choice(passages)])))
    whole = rows[40][1]
    rows += [(2000, None), (2001, ""), (2002, "x" * 500), (2003, "x" * 51), (2004, "ab" * 100), (2005, "ba" * 100), (2006, whole), (1, whole), (2007, whole)]
    rows += [(2008, "y" * 49), (2009, "y" * 49), (2010, passages[5]), (2010, passages[5]), (2010, "other " + passages[4]), (None, whole), (-3, passages[3] * 2)]
    rows += [(2011, "é" * 60), (2012, "Zé" * 26), (2013, text(30) * 9), (2014, whole[:-1]), (3000, text(20_000) + passages[4])]
    return rows


@pytest.mark.parametrize("frequent_from, piece", [(512, 1 << 22), (20, 1 << 22), (512, 2000)])
def test_matches_plain_version(spark, monkeypatch, frequent_from, piece):
    monkeypatch.setattr(s, "FREQUENT_FROM", frequent_from)
    monkeypatch.setattr(s, "PIECE", piece)
    rows = corpus()
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_spans int").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.repeat_digest(df).collect()), key=str)
    assert got == plain(rows)


def test_empty_table(spark):
    assert s.repeat_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merge_is_sorted_and_knows_shared_prefixes():
    rng = random.Random(1)
    for n_runs in (1, 2, 3, 7):
        pools = [[bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 40))] for _ in range(n_runs)]
        runs = []
        for pool in pools:
            z = np.zeros(len(pool), dtype=np.int64)
            runs.append(s.Run(s.encode_run(pool, [b"c"] * len(pool), z.astype(np.uint64), z, z, z)))
        got, last = [], b""
        for number, shared in s.merge(runs):
            suffix = runs[number].suffix
            assert shared == s.common(last, suffix, 0)
            got.append(suffix)
            last = suffix
        assert got == sorted(x for pool in pools for x in pool)


def test_every_window_has_an_anchor_inside():
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab c") for _ in range(n)) for n in (0, 10, 49, 50, 51, 300, 7)]
    chunk = next(chunks(pa.array(texts)))
    found = s.Anchors(chunk)
    anchors = set(found.at.tolist())
    for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True):
        for q in range(a, b - 49):
            assert any(q + i in anchors and found.grams[q + i] == found.low[q] for i in range(s.REACH + 1))


def in_process(rows, lots, frequent):
    """Removed bytes of each row by the steps that run in tasks, without Spark; every gram counts as shared."""
    out = []
    keys, tags = np.array([k for k, _ in rows]), np.arange(len(rows), dtype=np.int32)
    bits = np.full((1 << s.MAP_BITS) // 8, 255, np.uint8)
    for lot in np.array_split(np.arange(len(rows)), lots):
        waiting = s.Suffixes()
        for chunk in chunks(pa.array([rows[i][1] for i in lot]), 3000):
            part = lot[chunk.first : chunk.first + chunk.rows]
            s.gather(chunk, keys[part], tags[part], bits, frequent, 3, waiting)
        out.append(waiting.runs())
    table = pa.Table.from_batches(out)
    gone = [np.zeros(len(t.encode()), dtype=bool) for _, t in rows]
    for p in set(table.column("part").to_pylist()):
        for r in s.merge_part(table.filter(pa.array([x == p for x in table.column("part").to_pylist()]))).to_pylist():
            assert keys[r["tag"]] == r["key"]
            gone[r["tag"]][r["first"] : r["last"]] = True
    return gone


def covered(rows):
    least = {}
    data = [(k, t.encode()) for k, t in rows]
    for k, b in data:
        for i in range(len(b) - 49):
            least[b[i : i + 50]] = min(least.get(b[i : i + 50], k), k)
    out = []
    for k, b in data:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < k:
                gone[i : i + 50] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("ordered, block, rounds, lots, hot", [(50_000, 256, 4, 3, False), (40, 5, 0, 4, False), (7, 1, 2, 1, False), (40, 5, 1, 4, True)])
def test_tasks_remove_what_a_plain_version_removes(monkeypatch, ordered, block, rounds, lots, hot):
    for name, value in (("ORDERED", ordered), ("BLOCK", block), ("ROUNDS", rounds), ("COMPARED", 10)):
        monkeypatch.setattr(s, name, value)
    rng = random.Random(17)
    text = lambda n: "".join(rng.choice("ab\0é") for _ in range(n))
    # Twenty passages with one core: groups in which each suffix has other windows.
    core = text(40)
    passages = [core, *(text(30) + core + text(30) for _ in range(20)), "z" * 70]
    rows = [(rng.randrange(60), text(rng.randrange(60)) + rng.choice(passages) + text(rng.randrange(60)) + rng.choice(passages)) for _ in range(120)]
    grams = np.unique(s.Anchors(next(chunks(pa.array([t for _, t in rows])))).grams >> np.uint64(8))
    for got, want, row in zip(in_process(rows, lots, grams[:: 3 if hot else len(grams)]), covered(rows), rows, strict=True):
        assert np.array_equal(got, want), row


def test_lots_without_a_settled_span_tell_their_runs():
    """What repeats stands in other lots, in each lot each text is new: nothing is settled before the merge."""
    rng = random.Random(23)
    text = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    some = [text(90) for _ in range(6)]
    rows = [*enumerate(some), *((i + 10, t + text(20)) for i, t in enumerate(some)), (30, "short")]
    for lots in (2, 3, 6):
        for got, want, row in zip(in_process(rows, lots, np.zeros(0, np.uint64)), covered(rows), rows, strict=True):
            assert np.array_equal(got, want), row
    assert sum(want.sum() for want in covered(rows)) == 6 * 90


def test_suffixes_are_not_compared_one_by_one(monkeypatch):
    """Runs are coded and merged by blocks: single comparisons of suffixes grow with the blocks, not with the suffixes."""
    calls = []
    plain_common = s.common
    monkeypatch.setattr(s, "common", lambda a, b, known: calls.append(1) or plain_common(a, b, known))
    rng = random.Random(3)
    pool = [bytes(rng.choice(b"abcd") for _ in range(50)) for _ in range(5000)]
    z = np.zeros(len(pool), dtype=np.int64)
    blob = s.encode_run(pool, [b""] * len(pool), z.astype(np.uint64) + 1, np.arange(len(pool)), z, z)
    assert len(calls) == 0
    s.merge_part(pa.table({"part": pa.array([0, 0], pa.int32()), "run": pa.array([blob, blob], pa.binary()), "settled": pa.array([None, None], pa.binary())}))
    assert len(calls) < len(pool) / 20


def test_kept_bytes_join_spans_that_touch():
    chunk = next(chunks(pa.array(["abcdef", "", "ghij", "kl"])))
    gone, runs, rest = s.kept_bytes(chunk, np.array([0, 0, 0, 2, 3]), np.array([4, 0, 2, 0, 0]), np.array([6, 2, 4, 1, 2]))
    assert (gone.tolist(), runs.tolist(), rest) == ([6, 0, 1, 2], [1, 0, 1, 1], [b"", b"", b"hij", b""])
    gone, runs, rest = s.kept_bytes(chunk, np.array([0, 0, 2]), np.array([0, 3, 2]), np.array([1, 5, 4]))
    assert (gone.tolist(), runs.tolist(), rest) == ([3, 0, 2, 0], [2, 0, 1, 0], [b"bcf", b"", b"gh", b"kl"])
