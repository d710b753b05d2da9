import random

import pytest
from brute import contamination, sha

from cohortloom.llm import decontaminate as d


def tables():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, text(40)), (2, text(13)), (10, text(5)), (3, None), (4, ""), (5, "Un " * 20), (6, "a"), (None, text(14))]
    items.append((7, items[0][1]))
    first = items[0][1].split()
    docs = [(i, text(rng.randint(0, 60))) for i in range(20)]
    docs += [
        (100, text(30) + " " + " ".join(first[3:16]).upper() + "! " + text(9)),
        (101, text(30) + " " + " ".join(first[3:15]) + " zz"),
        (102, items[1][1] + ", " + items[1][1]),
        (103, text(200) + " " + items[2][1] + " " + text(3)),
        (104, "un " * 50),
        (105, None),
        (106, ""),
        (107, "é A b"),
        (108, text(3000) + " " + items[7][1]),
        (None, items[0][1]),
        (102, items[1][1] + ", " + items[1][1]),
        (100, "other text"),
    ]
    return docs, items


@pytest.mark.parametrize("bound", [d.BROADCAST_FINGERPRINTS, 0])
def test_matches_plain_version(spark, monkeypatch, bound):
    monkeypatch.setattr(d, "BROADCAST_FINGERPRINTS", bound)
    docs, items = tables()
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in d.decontaminate(df, bench).collect()), key=str)
    plain = contamination(docs, [x for x in items if x[0] is not None])
    extra = contamination(docs, items)
    want = sorted(((i, n, e[2], sha(s), e[2] > 0 and 20 * e[2] >= n) for (i, n, _, s), e in zip(plain, extra, strict=True)), key=str)
    assert got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_hit, r.n_items) for r in d.decontaminate(docs, none).collect()] == [(0, 0)]
    assert d.decontaminate(docs.limit(0), none).count() == 0
