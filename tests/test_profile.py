import math
import random
import statistics

from cohortloom.operators import profile as p


def quantile(values, q):
    at = q * (len(values) - 1)
    lo, hi = values[math.floor(at)], values[math.ceil(at)]
    return lo + (hi - lo) * (at - math.floor(at))


def test_percentile_profile_of_merged_values(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([1.5, 2.0, rng.gauss(0, 9)])) for g, n in (("a", 900), (None, 200), ("b", 3)) for _ in range(n)] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    out = p.percentile_profile(df, ["g"], "v", [0.1, 0.9])
    got = {r["g"]: r for r in out.collect()}
    for g in ("a", None, "b"):
        values = sorted(v for k, v in rows if k == g and v is not None)
        med = statistics.median(values)
        dev = sorted(abs(v - med) for v in values)
        expected = (quantile(dev, 0.5), quantile(values, 0.1), quantile(values, 0.9), sum(values) / len(values))
        assert all(abs(x - y) < 1e-9 for x, y in zip((got[g]["mad"], got[g]["p0"], got[g]["p1"], got[g]["mean"]), expected, strict=True))


def test_medians_meet_their_values_in_parts_of_a_group(spark, monkeypatch):
    """The table that gives the deviations is no longer joined by the group alone."""
    joined = []
    before = p.null_safe
    monkeypatch.setattr(p, "null_safe", lambda left, right, keys, *how: joined.append((tuple(keys), left.count())) or before(left, right, keys, *how))
    df = spark.range(2000).selectExpr("'a' AS g", "CAST(id AS DOUBLE) AS v")
    p.percentile_profile(df, ["g"], "v", [0.5])
    assert max(n for keys, n in joined if keys == ("g",)) <= p.MEDIAN_PARTS
