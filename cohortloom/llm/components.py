"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import cut


LINKS_PER_TASK = 100_000


def _largest_first(edges: DataFrame) -> DataFrame:
    """Every link as (larger, smaller), once."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and hash sums of the links, to see whether a round changed any."""
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.pmod(h, F.lit(1 << 31))), F.min("b")).collect()[0]
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): label is the smallest node of its component.

    Each round hangs the larger neighbours of a node on its smallest neighbour, then the node and its smaller
    neighbours; the number of rounds grows with the logarithm of the longest path. A round is written, so that lineage
    stays short and a lost executor costs one round. Self links and repeats do no harm; no links give no rows.
    """
    edges = cut(_largest_first(links))
    mark = _mark(edges)
    while True:
        # The table only shrinks from here; few links go on in few tasks.
        tasks = max(1, mark[0] // LINKS_PER_TASK)
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        down = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        lower = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(lower.select("a", F.col("m").alias("b")))
        edges = cut(_largest_first(small).coalesce(tasks))
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
