"""Tabular models on Spark ML, out-of-fold prediction with resume, seeded search, isolation trees, diffusion map."""

from __future__ import annotations

import hashlib
import io
import json
import math
import time
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.keyed import uniform
from cohortloom.functions.scalar import clip_probability, logit, row_log_loss
from cohortloom.operators.prep import class_weights
from cohortloom.session import cut, partitions


def assemble(cols: Sequence[str]) -> list:
    """Median imputation fitted with the model, then one vector column."""
    filled = [f"_i_{c}" for c in cols]
    return [
        Imputer(inputCols=list(cols), outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep"),
    ]


def train_logistic(cols, label: str, c: float = 1.0, l1_ratio: float = 0.0, rows: int = 1, weight: str | None = None,
                   max_iter: int = 100) -> Pipeline:
    """Elastic-net logistic regression; ``c`` is the inverse penalty over ``rows`` training rows."""
    lr = LogisticRegression(
        featuresCol="features", labelCol=label, regParam=1.0 / (c * max(rows, 1)), elasticNetParam=l1_ratio, maxIter=max_iter
    )
    return Pipeline(stages=[*assemble(cols), lr.setWeightCol(weight) if weight else lr])


def train_random_forest(cols, label: str, trees: int = 100, depth: int = 8, min_leaf: int = 1, weight: str | None = None,
                        seed: int = 0) -> Pipeline:
    rf = RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed
    )
    return Pipeline(stages=[*assemble(cols), rf.setWeightCol(weight) if weight else rf])


def train_gbt(cols, label: str, iterations: int = 50, depth: int = 3, step: float = 0.1, subsample: float = 1.0, bins: int = 64,
              seed: int = 0) -> Pipeline:
    gbt = GBTClassifier(
        featuresCol="features", labelCol=label, maxIter=iterations, maxDepth=depth, stepSize=step, subsamplingRate=subsample,
        maxBins=bins, seed=seed,
    )
    return Pipeline(stages=[*assemble(cols), gbt])


def train_mlp(cols, label: str, hidden: Sequence[int] = (16,), max_iter: int = 100, seed: int = 0) -> Pipeline:
    mlp = MultilayerPerceptronClassifier(
        featuresCol="features", labelCol=label, layers=[len(cols), *hidden, 2], maxIter=max_iter, seed=seed
    )
    return Pipeline(stages=[*assemble(cols), mlp])


def positive_probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("prob", clip_probability(F.element_at(vector_to_array("probability"), 2)))


def train_gbt_early_stop(train: DataFrame, cols, label: str, key: str, max_iter: int = 60, holdout: float = 0.2, depth: int = 3,
                         step: float = 0.1, seed: int = 0):
    """(model, best iteration): the iteration is chosen on a keyed split of the training rows, then refit on all of them."""
    held = uniform(F.concat(F.lit(f"{seed}|stop|"), F.col(key).cast("string"))) < holdout
    probe = train_gbt(cols, label, max_iter, depth, step, seed=seed).fit(train.where(~held))
    valid = train.where(held)
    for stage in probe.stages[:-1]:
        valid = stage.transform(valid)
    losses = probe.stages[-1].evaluateEachIteration(valid)
    best = int(np.argmin(losses)) + 1
    return train_gbt(cols, label, best, depth, step, seed=seed).fit(train), best


Builder = Callable[[int], Pipeline]


def oof_predict(
    df: DataFrame, model: str, builder: Builder, key: str, label: str, fold: str, folds: Sequence[int], path: str | None = None
) -> DataFrame:
    """Out-of-fold probabilities (key, label, fold, model, prob): each fold is predicted by a fit on the other folds.

    With ``path`` every finished (model, fold) is written and skipped when the job is run again.
    """
    spark = df.sparkSession
    done: set[int] = set()
    if path:
        try:
            done = {
                r[fold] for r in spark.read.parquet(path).where(F.col("model") == model).select(fold).distinct().collect()
            }
        except AnalysisException:
            done = set()
    parts = []
    for k in folds:
        if k in done:
            continue
        train = df.where(F.col(fold) != k)
        fitted = builder(train.count()).fit(train)
        scored = positive_probability(fitted.transform(df.where(F.col(fold) == k)))
        part = scored.select(key, F.col(label).cast("int").alias(label), F.lit(model).alias("model"), F.col(fold).alias(fold), "prob")
        if path:
            part.write.mode("append").partitionBy("model", fold).parquet(path)
        else:
            parts.append(part)
    if path:
        out = spark.read.parquet(path).where(F.col("model") == model)
        return out.select(key, label, "model", F.col(fold).cast("int").alias(fold), "prob")
    return reduce(DataFrame.unionByName, parts)


def draw_parameters(space: dict[str, Sequence | tuple], trial: int, seed: int) -> dict:
    """One point of a space from the hash of (seed, trial, name): lists are choices, (lo, hi, 'log'|'lin') ranges."""
    point = {}
    for name in sorted(space):
        u = int(hashlib.md5(f"{seed}|{trial}|{name}".encode()).hexdigest()[:8], 16) / 2**32
        spec = space[name]
        if isinstance(spec, tuple):
            lo, hi, kind = spec
            point[name] = float(lo * (hi / lo) ** u) if kind == "log" else float(lo + u * (hi - lo))
        else:
            point[name] = spec[int(u * len(spec))]
    return point


#: Errors of parameters that an estimator can't be fitted with.
FIT_ERRORS = (IllegalArgumentException, ValueError, ArithmeticError, np.linalg.LinAlgError)


def random_search(
    df: DataFrame, study: str, space: dict, build: Callable[[dict, int], Pipeline], trials: int, key: str, label: str, fold: str,
    folds: Sequence[int], seed: int = 0,
) -> DataFrame:
    """Trial table: number, state, mean fold loss, fold losses, duration and parameters of a seeded random search."""
    rows = []
    for number in range(trials):
        params = draw_parameters(space, number, seed)
        start = time.time()
        state, scores = "COMPLETE", []
        try:
            oof = oof_predict(df, study, lambda n, p=params: build(p, n), key, label, fold, folds)
            losses = oof.groupBy(fold).agg(F.avg(row_log_loss(F.col(label), F.col("prob"))).alias("l")).orderBy(fold)
            scores = [r["l"] for r in losses.collect()]
        except FIT_ERRORS as error:  # a failed trial is recorded, the search goes on; a lost cluster or a bug ends it
            state, params = "FAIL", {**params, "error": f"{type(error).__name__}: {str(error)[:300]}"}
        value = float(np.mean(scores)) if scores else None
        rows.append((study, number, state, value, json.dumps(scores), time.time() - start, json.dumps(params, sort_keys=True)))
    schema = "study string, number int, state string, value double, fold_scores_json string, duration double, params_json string"
    return df.sparkSession.createDataFrame(rows, schema)


def stack_logits(wide: DataFrame, models: Sequence[str], key: str, label: str, fold: str, folds: Sequence[int], c: float = 1.0,
                 l1_ratio: float = 0.5) -> DataFrame:
    """Cross-fitted elastic net on the logits of the base models."""
    logits = wide.select(key, label, fold, *[logit(F.col(m)).alias(f"z_{m}") for m in models])
    cols = [f"z_{m}" for m in models]
    return oof_predict(
        logits, "stack", lambda n: train_logistic(cols, label, c, l1_ratio, n), key, label, fold, folds
    )


def fixed_blend(wide: DataFrame, key: str, label: str, fold: str, a: str, b: str, weight: float = 0.5, method: str = "temperature") -> DataFrame:
    """Pre-set weight on two experts, then one cross-fitted calibration."""
    from cohortloom.operators.calibrate import crossfit_calibrate

    p = F.lit(weight) * F.col(a) + F.lit(1.0 - weight) * F.col(b)
    blend = wide.select(key, label, fold, clip_probability(p).alias("blend"))
    return crossfit_calibrate(blend, [], label, "blend", fold, method)


def balanced(df: DataFrame, label: str) -> DataFrame:
    return class_weights(df, label, "weight")


# --- isolation trees -------------------------------------------------------------------------------------------------


def _tree_rows(df: DataFrame, key: str, cols: Sequence[str], trees: int, sub: int, seed: int) -> DataFrame:
    """(tree, features): ``sub`` rows per tree in the mean (all rows, if there are fewer), drawn by one rule at every size.

    A row enters ``trees * sub / n`` trees, rounded up or down by its hash: evenly spaced ones from a hashed first tree,
    so they are distinct and every tree has the same chance. What is shuffled is ``trees * sub`` rows whatever the table.
    """
    n = df.count()
    rows = df.select(key, F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    share = float(trees) * min(1.0, sub / max(n, 1))
    text = F.col(key).cast("string")
    draws = F.floor(uniform(F.concat(F.lit(f"{seed}|draws|"), text)) + share).cast("int")
    first = F.floor(uniform(F.concat(F.lit(f"{seed}|first|"), text)) * trees).cast("int")
    rows = rows.withColumn("_first", first).withColumn("_draws", draws).where("_draws > 0")
    rows = rows.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.col("_draws") - 1)))
    tree = F.pmod(F.col("_first") + F.floor(F.col("_draw") * F.lit(trees / share)), F.lit(trees)).cast("int")
    return rows.select(key, "x", tree.alias("tree"))


def _path_constant(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, depth value) of one random tree; leaves have feature -1."""
    nodes: list[tuple] = []
    queue = [(np.arange(len(x)), 0, -1, False)]
    while queue:
        index, depth, parent, is_right = queue.pop()
        me = len(nodes)
        if parent >= 0:
            f, t, left, right, v = nodes[parent]
            nodes[parent] = (f, t, left, me, v) if is_right else (f, t, me, right, v)
        part = x[index]
        lo, hi = part.min(axis=0), part.max(axis=0)
        open_cols = np.flatnonzero(hi > lo)
        if depth >= limit or len(index) <= 1 or not len(open_cols):
            nodes.append((-1, 0.0, -1, -1, depth + _path_constant(len(index))))
            continue
        f = int(rng.choice(open_cols))
        t = float(rng.uniform(lo[f], hi[f]))
        nodes.append((f, t, -1, -1, 0.0))
        below = part[:, f] < t
        queue.append((index[~below], depth + 1, me, True))
        queue.append((index[below], depth + 1, me, False))
    return nodes


def isolation_forest(df: DataFrame, key: str, cols: Sequence[str], trees: int = 500, sub: int = 512, seed: int = 0,
                     out: str = "isolation_score") -> DataFrame:
    """Anomaly score 2^(-mean path / c): trees grow in parallel from bounded samples, then every row is scored once.

    The forest is at most ``2 * trees * sub`` nodes whatever the table size, so it is shipped to the tasks.
    """
    spark = df.sparkSession
    sample = _tree_rows(df, key, cols, trees, sub, seed)

    def build(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values(key)["x"].tolist())
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        nodes = _grow(x, np.random.default_rng([seed, int(group[0])]), limit)
        frame = pd.DataFrame(nodes, columns=["f", "t", "l", "r", "v"])
        frame.insert(0, "tree", int(group[0]))
        frame.insert(1, "node", np.arange(len(nodes)))
        frame["rows"] = len(x)
        return frame

    schema = "tree int, node int, f int, t double, l int, r int, v double, rows int"
    forest = sample.groupBy("tree").applyInPandas(build, schema).toPandas().sort_values(["tree", "node"])
    packed = [g[["f", "t", "l", "r", "v"]].to_numpy() for _, g in forest.groupby("tree")]
    norm = float(np.mean([_path_constant(g["rows"].iloc[0]) for _, g in forest.groupby("tree")]))
    shipped = spark.sparkContext.broadcast((packed, norm))

    def score(batches):
        forest_nodes, c = shipped.value
        for pdf in batches:
            x = np.array(pdf["_x"].tolist()) if len(pdf) else np.zeros((0, 1))
            total = np.zeros(len(x))
            for nodes in forest_nodes:
                at = np.zeros(len(x), dtype=int)
                active = np.flatnonzero(nodes[at, 0] >= 0)
                while len(active):
                    here = nodes[at[active]]
                    below = x[active, here[:, 0].astype(int)] < here[:, 1]
                    at[active] = np.where(below, here[:, 2], here[:, 3]).astype(int)
                    active = active[nodes[at[active], 0] >= 0]
                total += nodes[at, 4]
            pdf[out] = np.power(2.0, -(total / max(len(forest_nodes), 1)) / max(c, 1e-12))
            yield pdf[[key, out]]

    rows = df.select(key, F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"))
    key_type = df.schema[key].dataType.simpleString()
    return rows.mapInPandas(score, f"{key} {key_type}, {out} double")


# --- diffusion map ---------------------------------------------------------------------------------------------------


#: Modes carried along for a faster separation, and degree of the filter.
SPARE_MODES, DEGREE = 4, 12
#: Rows of a part of the graph, rows a leaf of the sample that cuts parts, and rows of that sample at most.
PART_ROWS, LEAF_SAMPLE, MOST_SAMPLED = 32_768, 128, 65_536
OWN = -1
MESSAGE = "part int, peer int, data binary, sums binary"


def _kernel(distance, width: float):
    ratio = distance / F.lit(width)
    return F.exp(-ratio * ratio)


def _halves(x: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Cuts (column, value, below, above) of a sample at the median of its widest column; a leaf is its number as ~leaf."""
    cuts: list = []
    count = 0

    def grow(rows: np.ndarray, n: int) -> int:
        nonlocal count
        if n <= 1 or len(rows) < 2 or not np.ptp(x[rows], axis=0).max() > 0:
            count += 1
            return ~(count - 1)
        j = int(np.ptp(x[rows], axis=0).argmax()) if len(rows) < 8 else int(x[rows].std(axis=0).argmax())
        value = float(np.median(x[rows, j]))
        under = x[rows, j] < value
        if not under.any():
            value = float(x[rows, j][x[rows, j] > value].min())
            under = x[rows, j] < value
        place = len(cuts)
        cuts.append(None)
        low = grow(rows[under], n // 2)
        cuts[place] = (j, value, low, grow(rows[~under], n - n // 2))
        return place

    grow(np.arange(len(x)), leaves)
    return cuts


def _leaf(x: np.ndarray, cuts: list) -> np.ndarray:
    node = np.full(len(x), 0 if cuts else ~0)
    while (inner := np.flatnonzero(node >= 0)).size:
        j, value, low, high = (np.array(c) for c in zip(*[cuts[i] for i in node[inner]]))
        node[inner] = np.where(x[inner, j.astype(int)] < value, low, high)
    return (~node).astype(np.int32)


def _parts(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(node, part): rows that lie together share a part of about PART_ROWS rows. A bounded sample draws the borders; a leaf that
    turns out larger is dealt out by a hash, so no part is large. Parts decide what is sent, never a result."""
    n = rows.count()
    leaves = math.ceil(n / PART_ROWS)
    some = rows.select(vector).orderBy(F.md5(F.col(key).cast("string").cast("binary"))).limit(min(LEAF_SAMPLE * leaves, MOST_SAMPLED)).collect()
    cuts = _halves(np.nan_to_num(np.array([r[0] for r in some], dtype=float)), leaves) if leaves > 1 else []

    def place(batches):
        for pdf in batches:
            x = np.array(pdf[vector].tolist(), dtype=float)
            yield pd.DataFrame({"node": pdf[key], "leaf": _leaf(np.nan_to_num(x), cuts) if len(pdf) else []})

    kind = rows.schema[key].dataType.simpleString()
    placed = rows.where(F.col(key).isNotNull()).select(key, vector).mapInPandas(place, f"node {kind}, leaf int")
    placed = cut(placed.groupBy("node").agg(F.min("leaf").alias("leaf")))
    sizes = {r["leaf"]: math.ceil(r["count"] / (2 * PART_ROWS)) for r in placed.groupBy("leaf").count().collect()}
    order = sorted(sizes)
    base = dict(zip(order, np.cumsum([0, *[sizes[i] for i in order]]).tolist()))
    known = placed.sparkSession.createDataFrame([(i, base[i], sizes[i]) for i in order], "leaf int, base int, pieces int")
    return cut(placed.join(F.broadcast(known), "leaf").select("node", (F.col("base") + F.pmod(F.xxhash64("node"), F.col("pieces"))).cast("int").alias("part")))


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


class _Part:
    """The edges that rows of one part own. Peers are parts that own one end of an edge; ``need`` are their nodes (by peer, then
    key), ``give`` the own nodes they need, in the order of their ``need``."""

    def __init__(self, data: bytes):
        f = np.load(io.BytesIO(data), allow_pickle=False)
        self.source, self.target, self.weight = f["source"], f["target"], f["weight"]
        self.need_peer, self.give, self.give_peer, self.root = f["need_peer"], f["give"], f["give_peer"], f["root"]
        self.n = len(self.root)
        self.peers = np.union1d(self.need_peer, self.give_peer).tolist()

    def _sum(self, at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(at, v, minlength=n) for v in values.T], axis=1) if n else np.zeros((0, values.shape[1]))

    def told(self, y: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """What each peer must know: values it needs, and sums over edges owned here that end at its nodes."""
        if not self.peers:
            return []
        far = self.target >= self.n
        sums = self._sum(self.target[far] - self.n, y[self.source[far]] * self.weight[far, None], len(self.need_peer))
        return [(q, np.concatenate([y[self.give[self.give_peer == q]], sums[self.need_peer == q]])) for q in self.peers]

    def sent(self, y: np.ndarray, heard: dict[int, np.ndarray]) -> np.ndarray:
        """Each row's values summed along its edges."""
        needed = np.zeros((len(self.need_peer), y.shape[1]))
        out = np.zeros_like(y)
        for q, values in heard.items():
            mine = self.need_peer == q
            needed[mine] = values[: mine.sum()]
            out[self.give[self.give_peer == q]] += values[mine.sum() :]
        near = self.target < self.n
        out += self._sum(self.source, np.concatenate([y, needed])[self.target] * self.weight[:, None], self.n)
        out += self._sum(self.target[near], y[self.source[near]] * self.weight[near, None], self.n)
        return out


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    """The packed graph of a part from its nodes (kind 0), owned edges (1) and nodes needed elsewhere (2)."""
    part, kind = key[0].as_py(), rows.column("kind").to_numpy()
    # Ranks of the keys: peers order the nodes they share alike.
    keys, rank = np.unique(np.concatenate([rows.column("a").to_numpy(), rows.column("b").to_numpy()]), return_inverse=True)
    a, b = np.split(rank, 2)
    peer, w = rows.column("peer").to_numpy(), rows.column("w").to_numpy()
    nodes = np.sort(a[kind == 0])
    edge, away = kind == 1, (kind == 1) & (peer != part)
    order = np.lexsort((b[away], peer[away]))
    far_peer, far = peer[away][order], b[away][order]
    new = np.ones(len(far), dtype=bool)
    new[1:] = (far[1:] != far[:-1]) | (far_peer[1:] != far_peer[:-1])
    target = np.zeros(len(a), dtype=np.int64)
    at_home = edge & (peer == part)
    target[at_home] = np.searchsorted(nodes, b[at_home])
    target[np.flatnonzero(away)[order]] = len(nodes) + np.cumsum(new) - 1
    give = kind == 2
    given = np.lexsort((a[give], peer[give]))
    data = _packed(source=np.searchsorted(nodes, a[edge]).astype(np.int32), target=target[edge].astype(np.int32), weight=w[edge],
                   need_peer=far_peer[new].astype(np.int32), give=np.searchsorted(nodes, a[give][given]).astype(np.int32),
                   give_peer=peer[give][given].astype(np.int32), root=np.ones(len(nodes)))
    return pa.table({"part": pa.array([part], pa.int32()), "graph": pa.array([data], pa.binary()), "nodes": pa.array([keys[nodes].tolist()], pa.list_(rows.schema.field("a").type))})


def _neighbour_graph(rows: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, float]:
    """(part, graph, nodes) of the symmetric neighbour graph and the kernel's width: a Gaussian of the distance over the median
    neighbour distance. An edge is owned by an end that lists it, so a row owns at most ``k`` and one that all others list no more."""
    from cohortloom.operators.neighbors import knn
    from cohortloom.operators.order import exact_quantiles

    near = cut(knn(rows, key, vector, k).select(F.col(key).alias("a"), F.col("neighbor").alias("b"), "distance"))
    scale = exact_quantiles(near, [], ["distance"], [0.5]).collect()
    width = max(float(scale[0]["q0"] or 0.0), 1e-12) if scale else 1.0
    parts = _parts(rows, key, vector)
    pairs = near.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a"), F.min("distance").alias("distance"))
    owned = pairs.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"), _kernel(F.col("distance"), width).alias("w"))
    owned = owned.join(parts.withColumnRenamed("node", "a"), "a").join(parts.select(F.col("node").alias("b"), F.col("part").alias("peer")), "b")
    edges = cut(owned.select("part", F.lit(1).alias("kind"), "a", "b", "peer", "w"))
    given = edges.where("part <> peer").select(F.col("peer").alias("part"), F.lit(2).alias("kind"), F.col("b").alias("a"), "b", F.col("part").alias("peer")).distinct()
    nodes = parts.select("part", F.lit(0).alias("kind"), F.col("node").alias("a"), F.col("node").alias("b"), F.lit(OWN).alias("peer"))
    both = edges.unionByName(nodes.unionByName(given).withColumn("w", F.lit(0.0)))
    kind = rows.schema[key].dataType.simpleString()
    return cut(both.groupBy("part").applyInArrow(_build, f"part int, graph binary, nodes array<{kind}>")), width


def _rows_of(part: int, graph: _Part, state: np.ndarray, y: np.ndarray | None = None, sums: np.ndarray | None = None) -> pa.Table:
    """A part's own state and what it tells its peers about ``y``, if there is another step."""
    told = [] if y is None else graph.told(y * graph.root[:, None])
    data = [np.ascontiguousarray(state).tobytes(), *[np.ascontiguousarray(v).tobytes() for _, v in told]]
    sums = [None if sums is None else sums.tobytes(), *[None] * len(told)]
    return pa.table({"part": pa.array([part, *[q for q, _ in told]], pa.int32()), "peer": pa.array([OWN, *[part] * len(told)], pa.int32()),
                     "data": pa.array(data, pa.binary()), "sums": pa.array(sums, pa.binary())})


NOTHING = pa.table({"part": pa.array([], pa.int32()), "peer": pa.array([], pa.int32()), "data": pa.array([], pa.binary()), "sums": pa.array([], pa.binary())})


def _step(graph: DataFrame, messages: DataFrame, width: int, work: Callable) -> DataFrame:
    """``work(part, graph, state, send)`` for every part; ``send(y)`` gives what ``width`` columns receive of the walk, of which
    the peers' share came with ``messages``."""

    def run(g: pa.Table, m: pa.Table) -> pa.Table:
        if not g.num_rows or not m.num_rows:
            return NOTHING
        part, own = g.column("part")[0].as_py(), _Part(g.column("graph")[0].as_py())
        state, heard = None, {}
        for peer, data in zip(m.column("peer").to_pylist(), m.column("data").to_pylist(), strict=True):
            if peer == OWN:
                state = np.frombuffer(data).reshape(own.n, -1)
            else:
                heard[peer] = np.frombuffer(data).reshape(-1, width)
        send = lambda y: own.sent(y * own.root[:, None], heard) * own.root[:, None]
        return work(part, own, state, send)

    sent = messages.select("part", "peer", "data")
    return graph.select("part", "graph").groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(run, MESSAGE)


def _total(messages: DataFrame, size: int) -> np.ndarray:
    """The sums that parts have written beside their rows, added up: ``size`` squared numbers on the driver."""

    def numbers(batches):
        total = np.zeros(size * size)
        for batch in batches:
            for data in batch.column("sums").drop_null().to_pylist():
                total += np.frombuffer(data)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total)], names=["i", "v"])

    found = messages.select("sums").where("sums IS NOT NULL").mapInArrow(numbers, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size * size)
    for r in found:
        out[r["i"]] = r["v"]
    return out.reshape(size, size)


class DiffusionMap:
    """Leading modes of the random walk on the exact neighbour graph of all rows, and their extension to other rows.

    The modes come from Chebyshev-filtered subspace iteration: a round takes out the constant mode, orthonormalises with
    sums of products, rotates to the best approximations and measures their residuals; then a polynomial of the walk
    damps everything below the weakest carried mode. It ends when every residual ||S y - value y|| is below ``tolerance`` and
    raises an error when ``most_rounds`` don't suffice.

    The graph lies in parts of rows that are near each other. A step of the walk is one exchange, of a part's own values and
    of what its edges share with other parts; the edges stay where they are.
    """

    def __init__(self, key: str, cols: Sequence[str], components: int = 4, k: int = 15, tolerance: float = 1e-5, most_rounds: int = 100, seed: int = 0):
        self.key, self.cols, self.k, self.tolerance, self.most_rounds, self.seed = key, list(cols), k, tolerance, most_rounds, seed
        self.names = [f"d{i + 1}" for i in range(components)]
        self.values = self.residuals = np.zeros(components)
        self.rounds, self.width = 0, 1.0
        self.modes: DataFrame | None = None

    def _vectors(self, df: DataFrame) -> DataFrame:
        return df.select(self.key, F.array(*[F.col(c).cast("double") for c in self.cols]).alias("_x"))

    def _weighed(self, packed: DataFrame) -> DataFrame:
        """The graph with the inverse root of every row's degree: what a row of ones receives."""

        def ones(batches):
            for batch in batches:
                for part, data in zip(batch.column("part").to_pylist(), batch.column("graph").to_pylist(), strict=True):
                    own = _Part(data)
                    y = np.ones((own.n, 1))
                    yield from _rows_of(part, own, y, y).to_batches()

        def degree(part, own, state, send):
            return _rows_of(part, own, send(state), np.zeros((own.n, 1)))

        degrees = _step(packed, packed.select("part", "graph").mapInArrow(ones, MESSAGE), 1, degree).where(F.col("peer") == OWN)

        def weigh(g: pa.Table, m: pa.Table) -> pa.Table:
            arrays = dict(np.load(io.BytesIO(g.column("graph")[0].as_py()), allow_pickle=False))
            d = np.frombuffer(m.column("data")[0].as_py())
            arrays["root"] = np.where(d > 0, 1.0 / np.sqrt(np.where(d > 0, d, 1.0)), 0.0)
            return g.set_column(1, "graph", pa.array([_packed(**arrays)], pa.binary())).append_column("degree", pa.array([d.sum()])).append_column("n", pa.array([int((d > 0).sum())]))

        kind = packed.schema["nodes"].dataType.simpleString()
        degrees = degrees.select("part", "data")
        return packed.groupBy("part").cogroup(degrees.groupBy("part")).applyInArrow(weigh, f"part int, graph binary, nodes {kind}, degree double, n long")

    def fit(self, df: DataFrame) -> DiffusionMap:
        rows = cut(self._vectors(df))
        packed, self.width = _neighbour_graph(rows, self.key, "_x", self.k)
        weighed = cut(self._weighed(packed))
        total = weighed.agg(F.sum("degree").alias("d"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).collect()[0]
        # Every step meets the edges where they lie: with fewer partitions than a shuffle has they would move.
        graph = weighed.select("part", "graph").repartition(max(total["parts"], partitions(df.sparkSession)), "part").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            psi, cubes = self._modes(graph, weighed, float(total["d"] or 1.0), int(total["n"] or 0))
            self.modes = cut(self._signed(psi, cubes).join(rows, self.key))
        finally:
            graph.unpersist()
        return self

    def _modes(self, graph: DataFrame, weighed: DataFrame, weight: float, n: int) -> tuple[DataFrame, np.ndarray]:
        """(node, values) of the modes, and the sums of their cubes."""
        # No more modes than rows besides the constant one.
        b = min(len(self.names) + SPARE_MODES, max(n - 1, 1))
        wanted, seed = min(len(self.names), b), self.seed
        # Sqrt of the degree over the whole degree: the constant mode.
        flat = lambda own: np.where(own.root > 0, 1.0 / np.where(own.root > 0, own.root, 1.0), 0.0) / math.sqrt(weight)

        def products(own, y):
            both = np.column_stack([flat(own), y])
            return both.T @ both

        def start(batches):
            for batch in batches:
                for part, data in zip(batch.column("part").to_pylist(), batch.column("graph").to_pylist(), strict=True):
                    own = _Part(data)
                    y = (np.random.default_rng((seed, part)).random((own.n, b)) - 0.5) * (own.root > 0)[:, None]
                    yield from _rows_of(part, own, y, y, products(own, y)).to_batches()

        def turned(turn, level):
            """Columns of a state and what they receive, without the constant mode and orthonormal."""
            return lambda own, y: (y - np.outer(flat(own), level)) @ turn

        def basis(sums):
            level = sums[0, 1:]
            power, turn = np.linalg.eigh(sums[1:, 1:] - np.outer(level, level))
            return turn / np.sqrt(np.maximum(power, 1e-300)), level

        def rotated(by):
            def work(part, own, state, send):
                y = by(own, state[:, -b:])
                return _rows_of(part, own, y, y, products(own, y))

            return work

        def measured(by):
            # The walk is linear and keeps the constant mode, so what the turned columns receive is what was received, turned.
            def work(part, own, state, send):
                y, moved = by(own, state[:, -b:]), by(own, send(state[:, -b:]))
                both = np.column_stack([y, moved])
                return _rows_of(part, own, both, sums=both.T @ both)

            return work

        y = cut(graph.mapInArrow(start, MESSAGE))
        for self.rounds in range(1, self.most_rounds + 1):
            y = cut(_step(graph, y, b, rotated(turned(*basis(_total(y, b + 1))))))
            moved = cut(_step(graph, y, b, measured(turned(*basis(_total(y, b + 1))))).where(F.col("peer") == OWN))
            sums = _total(moved, 2 * b)
            between, sent = sums[:b, b:], sums[b:, b:]
            found, turn = np.linalg.eigh((between + between.T) / 2)
            found, turn = found[::-1], turn[:, ::-1]
            # ||S y - value y||^2 = ||S y||^2 - value^2 for orthonormal columns.
            residuals = np.sqrt(np.maximum(np.diag(turn.T @ sent @ turn) - found**2, 0.0))
            if residuals[:wanted].max() < self.tolerance:
                break
            y = cut(self._filtered(graph, moved, b, turn, max(float(found[-1]), 0.0), products))
        else:
            raise RuntimeError(f"modes haven't converged in {self.most_rounds} rounds: residuals {residuals[:wanted]}")
        self.values, self.residuals = found[:wanted], residuals[:wanted]

        def shown(g: pa.Table, m: pa.Table) -> pa.Table:
            own = _Part(g.column("graph")[0].as_py())
            alive, nodes = own.root > 0, pa.concat_arrays(g.column("nodes").chunks).flatten()
            psi = (np.frombuffer(m.column("data")[0].as_py()).reshape(own.n, -1)[:, :b] @ turn[:, :wanted])[alive] / flat(own)[alive, None]
            return pa.table({"node": nodes.filter(pa.array(alive)), **{f"p{i}": psi[:, i] for i in range(wanted)}})

        kind = weighed.schema["nodes"].dataType.elementType.simpleString()
        out = f"node {kind}" + "".join(f", p{i} double" for i in range(wanted))
        psi = cut(weighed.select("part", "graph", "nodes").groupBy("part").cogroup(moved.select("part", "data").groupBy("part")).applyInArrow(shown, out))
        # Signs are free; the cubes of a component sum to something positive.
        cubes = psi.agg(*[F.sum(F.pow(F.col(f"p{i}"), F.lit(3.0))) for i in range(wanted)]).collect()[0]
        return psi, np.array([c or 0.0 for c in cubes])

    def _filtered(self, graph: DataFrame, moved: DataFrame, b: int, turn: np.ndarray, low: float, products: Callable) -> DataFrame:
        """A Chebyshev polynomial of the walk applied to the turned columns of ``moved`` (which come with what they receive): modes
        below ``low`` stay small, those above grow fast."""
        half, middle = (low + 1.0) / 2.0, (low - 1.0) / 2.0

        def first(part, own, state, send):
            old, sent = state[:, :b] @ turn, state[:, b:] @ turn
            y = (sent - middle * old) / half
            return _rows_of(part, own, np.column_stack([old, y]), y)

        def more(last):
            def work(part, own, state, send):
                old, y = state[:, :b], state[:, b:]
                new = 2.0 * (send(y) - middle * y) / half - old
                return _rows_of(part, own, new, new, products(own, new)) if last else _rows_of(part, own, np.column_stack([y, new]), new)

            return work

        y = _step(graph, moved, b, first)
        for i in range(1, DEGREE):
            y = _step(graph, y, b, more(i == DEGREE - 1))
        return y

    def _signed(self, psi: DataFrame, cubes: np.ndarray) -> DataFrame:
        wanted = len(cubes)
        lacking = [F.lit(0.0).alias(n) for n in self.names[wanted:]]
        self.values = np.concatenate([self.values, np.zeros(len(lacking))])
        signs = [-1.0 if c < 0 else 1.0 for c in cubes]
        return psi.select(F.col("node").alias(self.key), *[(F.col(f"p{i}") * F.lit(s)).alias(n) for i, (n, s) in enumerate(zip(self.names, signs))], *lacking)

    def _scale(self, power: float) -> list[float]:
        return [float(max(v, 1e-8) ** power) for v in self.values]

    def coordinates(self, steps: float = 1.0) -> DataFrame:
        """Diffusion coordinates of the fitted rows after ``steps`` of the walk."""
        return self.modes.select(self.key, *[(F.col(n) * F.lit(f)).alias(n) for n, f in zip(self.names, self._scale(steps))])

    def transform(self, df: DataFrame, steps: float = 1.0) -> DataFrame:
        """Coordinates of other rows by the Nystrom extension: a step of the walk from the row to its nearest fitted rows."""
        from cohortloom.operators.neighbors import nearest_of

        near = nearest_of(self._vectors(df), self.modes, self.key, "_x", self.k)
        weighted = near.select(F.col(self.key).alias("to"), F.col("neighbor").alias(self.key), _kernel(F.col("distance"), self.width).alias("w"))
        joined = weighted.join(self.modes.drop("_x"), self.key)
        total = F.greatest(F.sum("w"), F.lit(1e-12))
        means = [(F.sum(F.col("w") * F.col(n)) / total * F.lit(f)).alias(n) for n, f in zip(self.names, self._scale(steps - 1.0))]
        return joined.groupBy(F.col("to").alias(self.key)).agg(*means)


def diffusion_map(df: DataFrame, key: str, cols: Sequence[str], components: int = 4, k: int = 15, steps: float = 1.0, **fit) -> DataFrame:
    """Diffusion coordinates d1.. of every row (see :class:`DiffusionMap`)."""
    return DiffusionMap(key, cols, components, k, **fit).fit(df).coordinates(steps)
