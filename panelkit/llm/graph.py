"""Connected components by label spreading, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelkit.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b): label is the smallest node reachable.

    Large-star and small-star rounds alternate: neighbours are hung on the smallest
    node known to each, which keeps at most as many edges as before and halves the
    depth. Minima are pre-aggregated, so a node with a third of all edges sends one
    row per task; the join back on it is split by adaptive execution.
    """
    cur = materialize(_clean(edges.select("a", "b")), "edges")
    while True:
        after = materialize(_small_star(_large_star(cur)), "edges")
        moved = after.select("a", "b").exceptAll(cur).limit(1).count() + cur.exceptAll(after).limit(1).count()
        cur = after
        if not moved:
            break
    # A star: every edge leads from a node to its component's smallest.
    return cur.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("label"))
    ).distinct()


def _clean(e: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller end, once each."""
    return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's smallest neighbour (or itself)."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _clean(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are hung on the smallest of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    hung = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _clean(hung.unionByName(least.select("a", F.col("m").alias("b"))))
