import random

import pytest

from cohortloom.operators import metrics as e


def plain_auc(rows):
    wins = [(a > b) + (a == b) / 2 for a, y in rows if y for b, z in rows if not z]
    return sum(wins) / len(wins) if wins else None


@pytest.mark.parametrize("large", [1 << 18, 40])
def test_ranks_of_small_and_large_groups(spark, monkeypatch, large):
    monkeypatch.setattr(e, "LARGE_GROUP", large)
    rng = random.Random(5)
    rows = []
    for g, n in (("a", 300), (None, 90), ("b", 30), ("c", 4)):
        rows += [(g, int(rng.random() < 0.4) if g != "c" else 1, rng.choice([rng.random(), 0.25, 0.250001, 0.1, 1.0, 0.0])) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, y int, p double").repartition(4)
    got = {r["g"]: r for r in e.binary_metrics(df, ["g"], "y", "p").collect()}
    assert set(got) == {"a", None, "b", "c"}
    for g, r in got.items():
        mine = [(p, y) for k, y, p in rows if k == g]
        assert (r["n"], r["pos"]) == (len(mine), sum(y for _, y in mine))
        expected = plain_auc(mine)
        assert r["auc"] is None if expected is None else abs(r["auc"] - expected) < 1e-9
    one = e.binary_metrics(df, [], "y", "p").collect()[0]
    assert abs(one["auc"] - plain_auc([(p, y) for _, y, p in rows])) < 1e-9
    # One exchange of the predictions and one of the merged table; no join of the running counts with it.
    plan = e.binary_metrics(df, ["g"], "y", "p")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
