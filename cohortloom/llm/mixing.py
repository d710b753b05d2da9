"""Temperature mixing of sources.

Source token shares q are raised to an exponent and normalised. The exponent is found by bisection: the one nearest to
natural sampling (1) that reaches a target entropy, and then nearer to 1 still if a source would repeat too often. Each
source's weight becomes a token budget, realised as whole epochs and one partial epoch; an epoch is a keyed permutation
of the source's rows, cut into cells so that running totals need no window over a whole source. Draws are laid into
blocks that each hold every source at its weight.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import cut

#: Rows of a cell, the unit of the running totals.
CELL_ROWS = 4096
#: Halvings of the exponent that one aggregate over the sources settles, and the number of such rounds.
BITS, ROUNDS = 5, 8
#: Relative slack of a budget, so that a whole number of epochs isn't missed by a rounding error.
SLACK = 1e-9


@dataclass(frozen=True)
class Mix:
    """``entropy_share``: of the entropy of equal weights. ``max_repeats``: epochs of a source at most, where the budget
    allows. ``budget``: tokens of the mixture (all tokens of the input if None). ``blocks``: parts of equal composition."""

    entropy_share: float = 0.95
    max_repeats: float = 4.0
    budget: int | None = None
    blocks: int = 256
    seed: int = 17


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _measure(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float, float]]:
    """For each exponent: sum of q^a, entropy of the weights, and largest weight / share, in one aggregate."""
    a, ln = F.col("a"), F.ln("q")
    grid = shares.filter("q > 0").select("q", F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("a"))
    rows = grid.groupBy("a").agg(F.sum(F.exp(a * ln)).alias("z"), F.sum(F.exp(a * ln) * ln).alias("m"), F.max(F.exp((a - 1) * ln)).alias("top"))
    return {r["a"]: (r["z"], math.log(r["z"]) - r["a"] * r["m"] / r["z"], r["top"] / r["z"]) for r in rows.collect()}


def find_exponent(shares: DataFrame, mix: Mix, sources: int, budget_ratio: float) -> float:
    """Bisect on [0, 1]. Entropy and repeats both fall as the exponent grows; several halvings share one aggregate."""

    def bisect(holds_below) -> float:
        """Largest exponent for which ``holds_below`` is true (it is true at 0 and turns false once)."""
        low, width = 0.0, 1.0
        for _ in range(ROUNDS):
            steps = [low + width * i / 2**BITS for i in range(1, 2**BITS + 1)]
            measured = _measure(shares, steps)
            below = 0
            while below < len(steps) and holds_below(measured[steps[below]]):
                below += 1
            if below == len(steps):
                return low + width
            low, width = low + width * below / 2**BITS, width / 2**BITS
        return low

    target = mix.entropy_share * math.log(sources) if sources > 1 else 0.0
    exponent = bisect(lambda m: m[1] >= target - 1e-12)
    if budget_ratio * _measure(shares, [exponent])[exponent][2] > mix.max_repeats:
        # The limit is met by raising the exponent; natural shares repeat least of all.
        exponent = max(exponent, bisect(lambda m: budget_ratio * m[2] > mix.max_repeats))
        exponent = min(1.0, exponent + 2.0 ** -(BITS * ROUNDS))
    return exponent


def mix_sources(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per draw: key, source, n_tokens, weight, epoch (from 1), block (from 0), position (tokens of the source
    drawn before this row).

    The rows of a source share one budget; a null source is a source of its own. Rows without tokens cost nothing and
    are drawn once with each whole or partial epoch that reaches them. The last, partial epoch stops before the budget
    would be passed. Equal keys and repeated rows count as separate rows. An empty table, or one without tokens, gives
    no rows.
    """
    rows = cut(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), token_count(F.col(text)).alias("n_tokens")))
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    grand = totals.filter("tokens > 0").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()[0]
    total = grand["t"] or 1
    budget = total if mix.budget is None else mix.budget
    # One row per source; written once, since every round of the bisection reads it.
    shares = cut(totals.filter("tokens > 0").withColumn("q", F.col("tokens") / F.lit(float(total))))
    exponent = find_exponent(shares, mix, grand["n"], budget / total) if grand["n"] else 1.0
    z = _measure(shares, [exponent])[exponent][0] if grand["n"] else 1.0
    weight = F.exp(F.lit(exponent) * F.ln("q")) / F.lit(z)
    plan = shares.withColumn("weight", weight).withColumn("target", F.lit(float(budget) * (1 + SLACK)) * F.col("weight"))
    plan = plan.select(F.col("source").alias("s"), "tokens", "rows", "weight", "target")

    drawn = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    epochs = F.ceil(F.col("target") / F.col("tokens")).cast("int")
    drawn = drawn.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.greatest(epochs, F.lit(1)))))
    drawn = drawn.withColumn("h", F.xxhash64(F.lit(mix.seed), "epoch", "key"))
    cells = F.ceil(F.col("rows") / F.lit(CELL_ROWS))
    drawn = drawn.withColumn("cell", F.floor((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) * cells).cast("bigint"))

    per_cell = drawn.groupBy("source", "epoch", "cell").agg(F.sum("n_tokens").alias("inside"))
    before_cell = F.sum("inside").over(Window.partitionBy("source", "epoch").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_cell.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("cell").alias("c"), F.coalesce(before_cell, F.lit(0)).alias("cell_start"))
    inside = Window.partitionBy("source", "epoch", "cell").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("cell") == F.col("c"))
    position = (F.col("epoch") - 1) * F.col("tokens") + F.col("cell_start") + F.col("before")
    drawn = drawn.join(starts, same).withColumn("position", position)
    drawn = drawn.filter(F.col("position") + F.col("n_tokens") <= F.col("target"))
    block = F.least(F.floor(F.col("position") / F.col("target") * F.lit(mix.blocks)), F.lit(mix.blocks - 1)).cast("int")
    return drawn.select(F.col("key").alias(key), F.col("source").alias(source), "n_tokens", "weight", "epoch", block.alias("block"), "position")
