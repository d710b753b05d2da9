import random
from collections import defaultdict

import pytest
from brute import contamination, fold
from test_jaccard import plain as near_copies

import corpus_pipeline as p


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    words = ["the", "of", "and", "to"] + [f"{a}{b}" for a in ("th", "er", "on", "in", "st") for b in ("an", "ed", "ing", "ly")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    rows = []
    for i in range(240):
        t = text(rng.randrange(20, 80))
        if i % 6 == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        rows.append((i, t, f"s{i % 4}"))
    rows += [(300 + i, rows[i * 7 + 1][1].upper().lower(), "s0") for i in range(15)]
    rows += [(400 + i, rows[i * 7 + 2][1] + " the end", "s1") for i in range(15)]
    rows += [(500 + i, text(12) + " " + items[i % 5][1], "s2") for i in range(10)]
    rows += [(600, None, "s0"), (601, "", None), (700, rows[1][1], "s3"), (700, rows[1][1], "s3"), (None, text(40), "s1")]
    out = tmp_path_factory.mktemp("pipeline")
    columns = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "extra") for i, t, s in rows], columns)
    docs.write.parquet(f"{out}/documents.parquet")
    labels = [(i, int(i % 6 != 0), 0) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), items


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_do_what_they_say(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = rows_of(docs)

    kept = p.keep_quality(spark, docs, path)
    assert kept.columns == docs.columns
    ids = {i for i, _ in rows_of(kept)}
    assert not ids & {i for i in range(0, 240, 6)} and len({i for i in range(240) if i % 6} - ids) <= 2

    kept = p.keep_one_copy(spark, docs, path)
    assert kept.columns == docs.columns
    largest = {}
    for i, t in before:
        largest[fold(t)] = max(largest.get(fold(t), -1), -1 if i is None else i)
    assert rows_of(kept) == sorted(((None if i == -1 else i, t) for t0, i in largest.items() for t in [next(t for j, t in before if fold(t) == t0 and (j if j is not None else -1) == i)]), key=str)

    kept = p.keep_one_of_near_copies(spark, docs, path)
    assert kept.columns == docs.columns
    firsts = {i for i, _, c in near_copies(before) if i == c} | {None}
    assert rows_of(kept) == [x for x in before if x[0] in firsts]

    kept = p.drop_contaminated(spark, docs, path)
    assert kept.columns == docs.columns
    bad = {i for i, n, hit, _ in contamination(before, items) if hit and 20 * hit >= n}
    assert len(bad) == 10 and rows_of(kept) == [x for x in before if x[0] not in bad]


def test_mixture_rows(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").filter("doc_id < 240")
    rows = p.mix(spark, docs, path).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    epochs = defaultdict(list)
    for r in rows:
        assert texts[r.doc_id] == r.text
        epochs[r.source, r.mix_epoch].append(r.doc_id)
    assert all(len(v) == len(set(v)) for v in epochs.values())
    assert len({s for s, _ in epochs}) == 4


def test_run_and_empty_table(spark, folder):
    path, _ = folder
    assert [name for name, _ in p.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]
    rows = p.run(spark, path).collect()
    ids = {r.doc_id for r in rows}
    assert rows and not ids & set(range(0, 240, 6)) and not ids & set(range(500, 510))
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        empty = stage(spark, empty, path)
    assert empty.count() == 0
