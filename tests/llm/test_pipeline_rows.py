"""Rows without a doc_id, or that share one, are kept or dropped by their own text."""

import random

import corpus_pipeline as p

WORDS = [f"{a}{b}{c}" for a in "klmn" for b in "aeiou" for c in "rst"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_copies_by_their_own_text(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (None, a + " end"), (None, b), (None, c), (7, d), (7, b + " end"), (8, d + " end"), (7, None), (None, None), (7, a + " stop")]
    kept = rows_of(p.keep_one_of_near_copies(spark, table(spark, rows), ""))
    # Of the copies of b the one with an id stays, of those of a the smallest id, and d under the repeated id 7.
    assert kept == sorted([(1, a), (None, c), (7, d), (7, b + " end"), (7, None), (None, None)], key=str)
    alone = rows_of(p.keep_one_of_near_copies(spark, table(spark, [(None, c), (None, c + " end"), (5, d), (5, d + " end")]), ""))
    assert len(alone) == 2 and {i for i, _ in alone} == {None, 5}


def test_contamination_by_their_own_text(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n=40: " ".join(rng.choice(WORDS) for _ in range(n))
    item = text(30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(None, text()), (3, text()), (3, text()), (4, text()), (None, None), (3, "")]
    bad = [(None, text(9) + " " + item), (3, item + " " + text(9)), (5, item)]
    kept = rows_of(p.drop_contaminated(spark, table(spark, clean + bad), str(tmp_path)))
    assert kept == sorted(clean, key=str)
