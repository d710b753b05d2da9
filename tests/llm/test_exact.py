from brute import fold, sha

from cohortloom.llm.exact import exact_dedup

ROWS = [(1, "Abc"), (2, "aBC"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 100_000), (None, "abc"), (8, "once"), (8, "once"), (None, "n")]
ROWS += [(100 + i, "Hot") for i in range(400)]


def frame(spark):
    return spark.createDataFrame([(i, t, "k") for i, t in ROWS], "doc_id long, text string, keep_id string")


def test_matches_plain_version(spark):
    got = exact_dedup(frame(spark), heavy=4, tracked=8).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(sha(fold(t)), []).append(i)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)


def test_carried_rows_and_empty_table(spark):
    kept = exact_dedup(frame(spark), carry=True, heavy=4, tracked=8)
    assert kept.columns == ["doc_id", "text", "keep_id"]
    assert kept.count() == len({fold(t) for _, t in ROWS})
    assert exact_dedup(frame(spark).limit(0)).count() == 0
