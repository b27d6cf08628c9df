"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a slope: its momentary weight at time t in [0, 1] is
w (1 + s (2t - 1)), which integrates to w over the run, with the cumulative demand

    D(t) = target * ((1 - s) t + s t^2)

in tokens. A source's documents stand in a fixed pseudo-random order and are read
again from the start when it is through, at most `repeats` times. The occurrence
whose middle lies at cumulative token x of its source is taken if x <= target, and
its training position is the t with D(t) = x: the root of a quadratic. Sorting all
occurrences by position gives the order of training.

The running sum inside a source is made in two levels, so that a source with a
third of all rows isn't one task: sizes are summed per (source, slice of the order),
slices are summed up per source (at most `SLICES` rows each), and rows only within
their slice.

Defined results: null text has size 0; a null source is a source of its own, the
last; source weights follow the code point order of names, repeating `weights`.
If all sizes are 0 nothing is taken (targets 0). Rows that repeat id and text are
separate rows in the same place. An empty table gives an empty result. Extra
columns are ignored by `mix` and kept by `mixed_documents`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelkit.llm.frames import WORD, fresh, text_or_empty

SLICES = 4096


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _order(doc_id: Column, text: Column) -> Column:
    """The place of a row in its source: 32 hex digits of id and text."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(text.cast("binary"))).cast("binary"))


def targets(sizes: DataFrame, weights: Sequence[int], repeats: int) -> DataFrame:
    """`sizes`, one row per source with columns source and source_size, plus rank and target.

    Filling sources up to a common level, in order of the level at which they are
    full, is the fixed point of resharing the excess. One row per source enters.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ordered = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ordered = ordered.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size").cast("double") * repeats)
    upto = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    everything = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = upto.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = (
        ordered.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("ws", F.sum("w").over(rest))
        # The first source that isn't full sets the share of all that follow.
        .withColumn("open", F.col("w") * F.col("left") / F.col("ws") <= F.col("cap"))
    )
    first = F.first(F.when(F.col("open"), F.struct("left", "ws")), ignorenulls=True).over(
        upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return filled.withColumn("level", first).select(
        *sizes.columns, "rank",
        F.when(F.col("level").isNull(), F.col("cap"))
        .otherwise(F.col("w") * F.col("level.left") / F.col("level.ws")).alias("target"),
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    *,
    weights: Sequence[int] = (1, 2, 3),
    slopes: Sequence[float] = (-0.5, 0.0, 0.5),
    repeats: int = 3,
    carry: str | None = None,
) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken, times, positions (one per time taken), ord.

    `carry` names a column of `docs` to take along.
    """
    t = text_or_empty(text)
    name = F.col(source).cast("string")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), name.alias("source"), n_words(t).alias("size"), _order(F.col(doc_id), t).alias("ord"),
        # A key that is never null, so that joins and windows share one partitioning.
        F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("key"),
        *([F.col(carry).alias("carried")] if carry else []),
    ).withColumn("slice", F.conv(F.substring("ord", 1, 3), 16, 10).cast("int"))
    slices = rows.groupBy("key", "slice").agg(F.first("source").alias("source"), F.sum("size").alias("slice_size"))
    goal = targets(
        slices.groupBy("key").agg(F.first("source").alias("source"), F.sum("slice_size").alias("source_size")), weights, repeats
    ).drop("source")
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        slices.select("key", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("start"))
        .join(goal, "key")
    )
    inside = Window.partitionBy("key", "slice").orderBy("ord", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(plan, ["key", "slice"])
        .withColumn("mid", F.col("start") + F.col("within") + F.col("size") / 2)
    )
    at = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda k: F.col("mid") + k * F.col("source_size")),
        lambda x: (x <= F.col("target")) & (F.col("target") > 0),
    )
    slope = F.element_at(F.array(*[F.lit(float(x)) for x in slopes]), (F.col("rank") % len(slopes) + 1).cast("int"))
    return placed.withColumn("at", at).withColumn("slope", slope).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * F.size("at")).alias("taken"), F.size("at").alias("times"),
        F.transform("at", lambda x: _position(x / F.col("target"), F.col("slope"))).alias("positions"), "ord",
        *(["carried"] if carry else []),
    )


def _position(u: Column, s: Column) -> Column:
    """t in [0, 1] with (1 - s) t + s t^2 = u, for |s| <= 1; the stable root."""
    b = F.lit(1.0) - s
    root = F.sqrt(F.greatest(b * b + s * u * 4, F.lit(0.0)))
    return F.when(u <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), u * 2 / (b + root)))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """`docs` in training order: each row as often as it is taken, range-sorted by position across partitions."""
    whole = docs.select("*", F.struct(*[docs[c] for c in docs.columns]).alias(fresh(docs, "_row")))
    taken = mix(whole, doc_id, text, source, carry=whole.columns[-1], **how)
    return (
        taken.select(F.explode("positions").alias("position"), "ord", "carried")
        .orderBy("position", "ord")
        .select("carried.*")
    )
