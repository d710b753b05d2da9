import random
import zlib

import numpy as np
import pytest

from cohortloom.llm.toxicity import best_segment, maximal_segments, score_toxicity


def plain_segments(scores):
    """Take the best segment, then the same to its left and right."""
    best, spot = 0.0, None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > best + 1e-12:
                best, spot = total, (a, b + 1)
    if spot is None:
        return []
    a, b = spot
    right = [(x + b, y + b, s) for x, y, s in plain_segments(scores[b:])]
    return [*plain_segments(scores[:a]), (a, b, best), *right]


def test_maximal_segments():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 5, 20, 60):
        for _ in range(20):
            scores = rng.normal(-0.2, 1, n)
            got, want = maximal_segments(scores), plain_segments(list(scores))
            assert [x[:2] for x in got] == [x[:2] for x in want]
            assert np.allclose([x[2] for x in got], [x[2] for x in want])
            best = best_segment(scores, np.array([0, n, n]))
            assert best[0] == pytest.approx(max((x[2] for x in want), default=0.0)) and best[1] == 0


def tables(spark):
    rng = random.Random(8)
    common = [f"w{i}" for i in range(80)]
    bad = ["vilest", "scummy", "wretchedly", "wretched", "wretches"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(common) for _ in range(rng.randrange(3, 150))]
        toxic = i % 6 == 0
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad))
        rows.append((i, " ".join(words), f"s{i % 3}", "x"))
        if i < 700:
            labels.append((i, int(toxic)))
    labels += [(0, 1), (None, 1), (5, None)]
    rows += [(2000, None, None, None), (2001, "", "s", "x"), (3, rows[3][1], "s", "x"), (None, "vilest scummy", "s", "x"), (2002, "w1 " * 30_000 + "VILEST scummy", "s", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score string")
    return df, spark.createDataFrame(labels, "doc_id long, toxic int"), rows


def test_held_out_accuracy_and_passages(spark):
    df, labels, rows = tables(spark)
    got = score_toxicity(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    unseen = [i for i in range(900) if i >= 700 or zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((by_id[i].score >= 0.3) == (i % 6 == 0) for i in unseen)
    assert right / len(unseen) > 0.97
    assert by_id[2000].score == by_id[2001].score < 0.3
    assert by_id[None].score >= 0.3
    last = by_id[2002].passages
    assert last and last[-1].first == 30_000 and last[-1].last == 30_002
    for r in got:
        assert all(a.last <= b.first for a, b in zip(r.passages, r.passages[1:], strict=False))


def test_without_labels_or_rows(spark):
    df, labels, rows = tables(spark)
    assert {round(r.score, 6) for r in score_toxicity(df, labels.limit(0)).collect()} == {0.5}
    assert score_toxicity(df.limit(0), labels).count() == 0
