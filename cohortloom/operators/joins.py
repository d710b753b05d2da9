"""Key-checked joins.

Uniqueness and completeness are enforced inside the plan: a side is grouped by its key (duplicates collapse on the map
side) and a repeated key raises. The grouping leaves the rows hash-partitioned on the key, so the join that follows
adds no shuffle. Small sides are not hinted; AQE turns a join into a broadcast once it has measured the side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.scalar import state_rank


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Raise ``message`` on the first row that breaks ``condition``; otherwise the rows pass unchanged."""
    return df.where(F.assert_true(condition, F.lit(message)).isNull())


def one_row(*tables: DataFrame) -> DataFrame:
    """Single-row tables side by side, as a union and one aggregation instead of a cross join."""
    stacked = tables[0]
    for t in tables[1:]:
        stacked = stacked.unionByName(t, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def unique_by(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """The same rows, failing at run time when a key repeats."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.any_value(F.struct(*rest)).alias("_row") if rest else F.lit(None).alias("_row")
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), packed)
    checked = require(grouped, F.col("_n") == 1, f"repeated key {list(keys)} in {what}")
    return checked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def join_one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join that fails when either side repeats the key."""
    return unique_by(left, on, "left").join(unique_by(right, on, "right"), list(on), how)


def join_complete(left: DataFrame, right: DataFrame, on: Sequence[str], label: str) -> DataFrame:
    """One-to-one join that must keep every row of both sides with equal labels."""
    a = unique_by(left, on, "left").withColumn("_in_left", F.lit(True))
    b = unique_by(right, on, "right").withColumnRenamed(label, "_label").withColumn("_in_right", F.lit(True))
    both = a.join(b, list(on), "full_outer")
    both = require(both, F.col("_in_left").isNotNull() & F.col("_in_right").isNotNull(), "key sets differ")
    both = require(both, F.col(label).eqNullSafe(F.col("_label")), "labels differ")
    return both.drop("_in_left", "_in_right", "_label")


def join_many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on a right side with unique keys."""
    return left.join(unique_by(right, on, "right"), list(on), "left")


def reconcile(expected: DataFrame, observed: DataFrame, on: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Full outer comparison: ``side`` is both/left/right and ``same_<c>`` tells whether values agree."""
    a = expected.select(*on, *[F.col(c).alias(f"_e_{c}") for c in compare], F.lit(True).alias("_l"))
    b = observed.select(*on, *[F.col(c).alias(f"_o_{c}") for c in compare], F.lit(True).alias("_r"))
    both = a.join(b, list(on), "full_outer")
    side = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both")
    same = [F.col(f"_e_{c}").eqNullSafe(F.col(f"_o_{c}")).alias(f"same_{c}") for c in compare]
    return both.select(*on, side.alias("side"), *same)


def pending(cohort: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``done`` yet."""
    return cohort.join(done.select(*on), list(on), "left_anti")


def present(cohort: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    return cohort.join(done.select(*on), list(on), "left_semi")


def lookup_best_state(
    histories: DataFrame, trials: DataFrame, on: Sequence[str], state: str, number: str, take: Sequence[str]
) -> DataFrame:
    """Left join of logs to one trial per key: best state first, then the smallest number."""
    best = trials.groupBy(*on).agg(
        F.min_by(F.struct(state, number, *take), F.struct(state_rank(F.col(state)), F.col(number))).alias("_t")
    )
    joined = histories.join(best, list(on), "left")
    return joined.select(
        *histories.columns,
        F.coalesce(F.col("_t")[state], F.lit("UNMAPPED_OR_ACTIVE")).alias(state),
        *[F.col("_t")[c].alias(c) for c in [number, *take]],
    )


def coalesce_join(df: DataFrame, override: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Values of ``override`` win; rows without an override keep theirs."""
    o = override.select(*on, *[F.col(c).alias(f"_o_{c}") for c in cols])
    joined = df.join(o, list(on), "left")
    return joined.select(
        *[F.coalesce(F.col(f"_o_{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def pairs_self_join(df: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    """Unordered pairs of models per record: (keys, a, b, pa, pb).

    A record holds one row per model, so its list is as short as the list of models; pairs come from that list in one
    shuffle instead of a self join.
    """
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(name, value))).alias("_m"))
    grouped = require(
        grouped, F.size(F.array_distinct(F.transform("_m", lambda e: e[name]))) == F.size("_m"), "repeated model in a record"
    )
    first = grouped.select(*keys, "_m", F.posexplode("_m").alias("_i", "_a"))
    second = first.select(*keys, "_a", F.explode(F.slice("_m", F.col("_i") + 2, F.size("_m"))).alias("_b"))
    return second.select(
        *keys,
        F.col("_a")[name].alias("a"),
        F.col("_b")[name].alias("b"),
        F.col("_a")[value].alias("pa"),
        F.col("_b")[value].alias("pb"),
    )


def best_trial_folds(trials: DataFrame, scores: DataFrame, keys: Sequence[str], number: str, value: str) -> DataFrame:
    """Fold scores of the best trial per study (smallest value, then smallest number)."""
    best = (
        trials.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.min(F.struct(value, number)).alias("_b"))
        .select(*keys, F.col("_b")[number].alias(number), F.col("_b")[value].alias(value))
    )
    return scores.join(best, [*keys, number])


def cross_grid(df: DataFrame, name: str, steps: int, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Every row against a fixed grid of ``steps`` numbers; aggregate right after, on the map side."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    return df.select("*", grid.alias("_step")).select(
        *df.columns, (F.lit(lo) + F.col("_step") * F.lit((hi - lo) / max(steps - 1, 1))).alias(name)
    )


def assert_aligned(df: DataFrame, key: str, model: str, label: str, models: int) -> DataFrame:
    """One row of violations: keys without all models, repeated (key, model) rows and keys with two labels."""
    per_model = df.groupBy(key, model).agg(
        F.count(F.lit(1)).alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi")
    )
    per_key = per_model.groupBy(key).agg(
        F.count(F.lit(1)).alias("models"), F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )

    def bad(c):
        return F.coalesce(F.sum(c.cast("int")), F.lit(0))

    return per_key.agg(
        F.count(F.lit(1)).alias("n_keys"),
        bad(F.col("models") != models).alias("incomplete"),
        bad(F.col("n") > 1).alias("repeated"),
        bad(~F.col("lo").eqNullSafe(F.col("hi"))).alias("label_conflicts"),
    )
