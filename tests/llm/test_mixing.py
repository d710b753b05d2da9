import math
from collections import defaultdict

import pytest

from cohortloom.llm.mixing import Mix, mix_sources


def frame(spark):
    rows = [(i, "w " * (1 + i % 7), "big") for i in range(9000)] + [(i, "w " * 5, "mid") for i in range(300)]
    rows += [(i, "w w", "small") for i in range(30)] + [(1, "w " * 10, None), (2, None, "big"), (3, "", "none"), (3, "", "none"), (4, "w " * 5000, "mid")]
    return spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, epoch int")


@pytest.mark.parametrize("mix", [Mix(max_repeats=1e9), Mix(max_repeats=3.0), Mix(budget=500, max_repeats=2.0), Mix(budget=10**6)])
def test_weights_and_budgets(spark, mix):
    df = frame(spark)
    tokens = {r.source: r.n for r in df.selectExpr("source", "regexp_count(coalesce(text, ''), '\\\\S+') n").groupBy("source").agg({"n": "sum"}).toDF("source", "n").collect() if r.n}
    total = sum(tokens.values())
    budget = mix.budget or total
    rows = mix_sources(df, mix).collect()
    weight = {r.source: r.weight for r in rows}
    exponents = {s: None for s in weight}
    assert None in weight and "none" not in weight
    assert sum(weight.values()) == pytest.approx(1) or mix.budget == 500
    entropy = -sum(w * math.log(w) for w in weight.values())
    # The exponent is the same for every pair of sources.
    a = {s: (math.log(weight[s]) - math.log(weight["big"])) / (math.log(tokens[s]) - math.log(tokens["big"])) for s in exponents if s != "big"}
    assert max(a.values()) - min(a.values()) < 1e-6
    repeats = max(budget * weight[s] / tokens[s] for s in weight)
    if mix.max_repeats > 1e6:
        assert entropy == pytest.approx(0.95 * math.log(len(tokens)), abs=1e-6)
    elif budget / total <= mix.max_repeats:
        assert repeats <= mix.max_repeats * (1 + 1e-6)
    drawn = defaultdict(list)
    for r in rows:
        drawn[r.source].append(r)
    longest = 5000
    for s, part in drawn.items():
        used = sum(r.n_tokens for r in part)
        target = budget * weight[s]
        assert used <= target * (1 + 1e-8) and used > target - longest - 1
        # Whole epochs hold every row once; positions are the running totals in order.
        epochs = defaultdict(list)
        for r in part:
            epochs[r.epoch].append(r)
        whole = int(target / tokens[s] + 1e-9)
        for e in range(1, whole + 1):
            assert sum(r.n_tokens for r in epochs[e]) == tokens[s]
        ordered = sorted((r.position, r.n_tokens) for r in part)
        at = 0
        for position, n in ordered:
            assert position == at
            at += n


def test_blocks_hold_every_source_at_its_weight(spark):
    rows = mix_sources(frame(spark), Mix(blocks=4)).collect()
    share = defaultdict(lambda: [0, 0, 0, 0])
    for r in rows:
        share[r.source][r.block] += r.n_tokens
    assert max(share["big"]) - min(share["big"]) < 50


def test_empty_table(spark):
    assert mix_sources(frame(spark).limit(0)).count() == 0
