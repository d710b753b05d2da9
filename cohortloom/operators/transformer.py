"""One fitted transformer for hundreds of feature columns: fill, scale, drop constants, prune, select, rotate.

Everything is learned from the rows given to ``fit`` (the training rows of a fold): medians and quartiles, which columns
vary, which correlate, which tell about the label, and the principal components. The fitted state is a few numbers per
column; applying it is one projection in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.gram import correlations, covariance
from cohortloom.operators.order import exact_quantiles
from cohortloom.operators.prep import TINY_SCALE, finite, mutual_information


class FoldTransformer:
    """``top_k`` columns by mutual information with the label among those that vary and correlate with no earlier kept one
    at ``correlation`` or more; with ``variance`` the principal components that hold more than this share of theirs."""

    def __init__(self, top_k: int = 128, variance: float | None = None, correlation: float = 0.98, bins: int = 10):
        self.top_k, self.variance, self.correlation, self.bins = top_k, variance, correlation, bins
        self.names: list[str] = []
        self.median: dict[str, float] = {}
        self.center: dict[str, float] = {}
        self.scale: dict[str, float] = {}
        self.mean: np.ndarray | None = None
        self.components: np.ndarray | None = None

    def fit(self, train: DataFrame, cols: Sequence[str], label: str) -> FoldTransformer:
        cols = list(cols)
        known = {r["feature"]: r["q0"] for r in exact_quantiles(train.select(*[finite(c).alias(c) for c in cols]), [], cols, [0.5]).collect()}
        self.median = {c: float(known.get(c) or 0.0) for c in cols}
        filled = train.select(label, *[F.coalesce(finite(c), F.lit(self.median[c])).alias(c) for c in cols])
        quartiles = {r["feature"]: r for r in exact_quantiles(filled, [], cols, [0.25, 0.5, 0.75]).collect()}
        self.center = {c: float(quartiles[c]["q1"]) for c in cols}
        spread = {c: float(quartiles[c]["q2"] - quartiles[c]["q0"]) for c in cols}
        self.scale = {c: s if s > TINY_SCALE else 1.0 for c, s in spread.items()}
        deviation = filled.agg(*[F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(cols)]).first()
        varying = [c for c, d in zip(cols, deviation, strict=True) if (d or 0.0) / self.scale[c] > TINY_SCALE]
        kept = self._uncorrelated(filled, varying)
        told = {r["feature"]: r["mi"] for r in mutual_information(filled, kept, label, self.bins).collect()} if kept else {}
        self.names = sorted(kept, key=lambda c: (-(told.get(c) or 0.0), cols.index(c)))[: self.top_k]
        if self.variance is not None and len(self.names) > 1:
            mean, cov = covariance(self._scaled(filled), self.names)
            values, vectors = np.linalg.eigh(cov)
            values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
            share = np.cumsum(values) / max(values.sum(), 1e-300)
            count = min(int(np.searchsorted(share, self.variance, side="right")) + 1, len(self.names))
            # The largest loading of a component is positive.
            signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
            self.mean, self.components = np.array(mean), (vectors * signs).T[:count]
        return self

    def _uncorrelated(self, filled: DataFrame, cols: list[str]) -> list[str]:
        close: dict[str, set[str]] = {}
        over = correlations(filled, cols).where(F.abs("corr") >= self.correlation) if len(cols) > 1 else None
        for r in over.collect() if over is not None else []:
            close.setdefault(r["b"], set()).add(r["a"])
        kept: list[str] = []
        for c in cols:
            if not close.get(c, set()) & set(kept):
                kept.append(c)
        return kept

    def _scaled(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        values = [((F.coalesce(finite(c), F.lit(self.median[c])) - F.lit(self.center[c])) / F.lit(self.scale[c])).alias(c) for c in self.names]
        return df.select(*keep, *values)

    @property
    def width(self) -> int:
        return len(self.components) if self.components is not None else len(self.names)

    def transform(self, df: DataFrame, key: str, out: str = "features") -> DataFrame:
        """(key, out): the transformed columns of every row as an array."""
        rows = self._scaled(df, [F.col(key).alias("_key")]).select("_key", F.array(*self.names).alias("_x"))
        mean, components, width = self.mean, self.components, len(self.names)

        def project(batches):
            for pdf in batches:
                if len(pdf):
                    x = np.array(pdf["_x"].tolist(), dtype=float).reshape(len(pdf), width)
                    yield pd.DataFrame({"_key": pdf["_key"], out: list((x - mean) @ components.T)})

        if components is not None:
            rows = rows.mapInPandas(project, f"_key {rows.schema['_key'].dataType.simpleString()}, {out} array<double>")
        return rows.select(F.col("_key").alias(key), F.col(rows.columns[1]).alias(out))

    def to_state(self) -> dict:
        """The fitted numbers as plain values, for JSON."""
        plain = lambda a: None if a is None else a.tolist()
        return {
            "top_k": self.top_k, "variance": self.variance, "correlation": self.correlation, "bins": self.bins, "names": self.names, "median": self.median,
            "center": self.center, "scale": self.scale, "mean": plain(self.mean), "components": plain(self.components),
        }

    @classmethod
    def from_state(cls, state: dict) -> FoldTransformer:
        made = cls(state["top_k"], state["variance"], state["correlation"], state["bins"])
        made.names, made.median, made.center, made.scale = list(state["names"]), dict(state["median"]), dict(state["center"]), dict(state["scale"])
        made.mean, made.components = (None if state[k] is None else np.array(state[k]) for k in ("mean", "components"))
        return made
