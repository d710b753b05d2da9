import random

import numpy as np
import pytest
from brute import fold

from cohortloom.llm import jaccard as j
from cohortloom.llm.components import components


def shingles(text):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", fold(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    smallest = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        smallest[r] = min(x for x in (smallest.get(r), k) if x is not None) if (smallest.get(r), k) != (None, None) else None
    return sorted(((k, len(s), smallest[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage = text(60)
    rows = []
    for n in (1, 4, 5, 6, 8, 9, 11, 12, 14, 18, 19, 20, 21, 25, 36, 37, 40, 69, 70, 100, 132, 133, 260, 700):
        base = text(n)
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, 13, 21):
            w = list(base)
            for _ in range(min(edits, n // 4 + 1)):
                kind, at = rng.randrange(3), rng.randrange(len(w))
                if kind == 0:
                    w[at] = rng.choice(words)
                elif kind == 1 and len(w) > 1:
                    del w[at]
                else:
                    w.insert(at, rng.choice(words))
            rows.append((len(rows), " ".join(w)))
    for _ in range(60):
        rows.append((len(rows), " ".join(passage + text(rng.choice([3, 10, 15, 20, 40])))))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, rows[5][1].upper()), (903, rows[5][1].upper()), (None, rows[70][1]), (None, "lonely words"), (904, "un " * 5000)]
    return rows


@pytest.mark.parametrize("spare, small, tile", [(0.5, 6, 2048), (0.1, 2, 3)])
def test_matches_plain_version(spark, monkeypatch, spare, small, tile):
    monkeypatch.setattr(j, "SPARE", spare)
    monkeypatch.setattr(j, "SMALL_GROUP", small)
    monkeypatch.setattr(j, "TILE", tile)
    rows = corpus()
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, component_id int").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.jaccard_components(df).collect()), key=str)
    assert got == plain(rows)
    assert j.jaccard_components(df.limit(0)).count() == 0


def test_every_similar_pair_shares_a_signature():
    rng = np.random.default_rng(4)
    frequent = np.sort(rng.integers(0, 2**63, 50).astype(np.uint64))
    for _ in range(1500):
        n = int(rng.integers(4, 200))
        x = np.concatenate([rng.integers(0, 2**63, n).astype(np.uint64), rng.choice(frequent, rng.integers(0, 10), replace=False)])
        y = x[rng.random(len(x)) > rng.uniform(0, 0.3)]
        y = np.unique(np.concatenate([y, rng.integers(0, 2**63, int(rng.integers(0, n // 5 + 1))).astype(np.uint64)]))
        x = np.unique(x)
        both = len(np.intersect1d(x, y))
        if 100 * both >= 75 * (len(x) + len(y) - both) and not np.array_equal(x, y):
            assert len(np.intersect1d(j.signatures(x, frequent), j.signatures(y, frequent))), (len(x), len(y))
            assert j.plausible(j.occupancy(x), j.occupancy(y), len(x), len(y))


def test_tiles_give_fewer_links_than_members(spark):
    rng = np.random.default_rng(9)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    core, loose = draw(90), draw(75)
    # 80 sets of which any two are similar, and 80 that are 0.6 similar and only share buckets with each other.
    sets = [np.unique(np.concatenate([core, draw(8)])) for _ in range(80)] + [np.unique(np.concatenate([loose, draw(25)])) for _ in range(80)]
    rows = [(7, i, i, 160) for i in range(160)]
    apart = spark.createDataFrame(rows, "signature long, class long, part long, size long")
    shapes = spark.createDataFrame([(i, len(v), j.occupancy(v)) for i, v in enumerate(sets)], "class long, n long, occupancy binary")
    groups = j.tiled_groups(apart, shapes)
    assert {r["class"] for r in groups.collect()} >= set(range(80))
    members = groups.join(shapes, "class").withColumn("part", groups["class"])
    links = j.tiled_links(members, spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(sets)], "class long, shingles binary")).collect()
    assert len(links) == 79 and all(r.a < r.b < 80 for r in links)
    assert j.components(spark.createDataFrame(links)).select("label").distinct().count() == 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(-5, 7000), (3, 3)]
    label = {}
    for a, b in edges:
        for x in (a, b):
            label.setdefault(x, {x})
        if label[a] is not label[b]:
            label[a] |= label[b]
            for x in label[b]:
                label[x] = label[a]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: min(label[x]) for x in linked}
