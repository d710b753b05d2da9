import random
import zlib

import numpy as np
import pyarrow as pa

from cohortloom.llm import quality as q
from cohortloom.llm.text import chunks


def tables(spark):
    rng = random.Random(3)
    words = ["the", "of", "and", "a", "in"] + [f"{a}{b}" for a in ("th", "er", "on", "in", "st") for b in ("an", "ed", "ing", "ly", "es")]
    rows, labels = [], []
    for i in range(1200):
        text = [rng.choice(words) for _ in range(rng.randrange(8, 120))]
        kind = i % 8
        if kind == 0:
            text = [w.upper() + "!!" for w in text]
        elif kind == 1:
            text = [w for w in text[:12] for _ in range(9)]
        rows.append((i, " ".join(text), "en", 0.0))
        if i < 900:
            labels.append((i, int(kind > 1)))
    labels += [(None, 1), (2, None)]
    rows += [(5000, None, None, 0.0), (5001, "", None, 0.0), (7, rows[7][1], "en", 0.0), (None, "THE!! OF!!", "en", 0.0), (5002, rows[10][1] + " the of" * 20_000, "en", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality_score double")
    return df, spark.createDataFrame(labels, "doc_id long, quality int"), rows


def test_held_out_accuracy(spark):
    df, labels, rows = tables(spark)
    got = q.score_quality(df, labels, keep=["doc_id", "lang"]).collect()
    assert len(got) == len(rows) and all(0 <= r.quality_score <= 1 for r in got)
    by_id = {r.doc_id: r.quality_score for r in got}
    unseen = [i for i in range(1200) if i >= 900 or zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((by_id[i] >= 0.5) == (i % 8 > 1) for i in unseen)
    assert right / len(unseen) > 0.97
    assert by_id[5000] == by_id[5001]
    # Calibrated: the mean score is near the share of good texts.
    assert abs(np.mean([by_id[i] for i in unseen]) - 0.75) < 0.05
    assert q.score_quality(df.limit(0), labels).count() == 0


def test_no_labels(spark):
    df, labels, rows = tables(spark)
    scores = [r.quality_score for r in q.score_quality(df.limit(50), labels.limit(0)).collect()]
    assert len(scores) == 50 and all(0 <= s <= 1 for s in scores)


def test_tokens_and_features():
    chunk = next(chunks(pa.array(["ab ab!! c", "", " \t", "ab"])))
    bucket, first = q.tokens(chunk)
    assert first.tolist() == [0, 4, 4, 4, 5]
    assert bucket[0] == bucket[1] == bucket[4] and bucket[2] != bucket[3]
    x = q.pooled(chunk, np.eye(q.BUCKETS, q.DIMENSIONS, dtype=np.float32))
    assert x.shape == (4, q.FEATURES) and not x[1].any() and not x[2].any() and x[0, -3] > 0
