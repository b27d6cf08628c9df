"""Exact duplicates by 128-bit content hash, with a byte comparison inside groups.

Documents are grouped by the MD5 of their text (16 bytes). Only groups of two or
more carry their texts through a shuffle, where equal hash and equal bytes make a
class; a hash shared by different texts is thus split again. Partial aggregation
collapses the copies of one map task before they travel, so a text that holds a
third of all rows arrives as one row per task.

Defined results: a null text is the empty text. Ids may repeat and be null; nulls
are lowest, a group of null ids has a null `keep_id`. Every row is returned. Rows
that repeat both id and text count in `group_size` and are all marked kept;
`keep_one` returns just one of them. An empty table gives an empty result. Other
columns are ignored by `exact_groups` and kept by `keep_one`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from panelkit.llm.frames import fresh, text_or_empty
from panelkit.operators.rows import small_side
from panelkit.session import materialize


def content_hash(text: Column) -> Column:
    """16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def shared_hashes(rows: DataFrame, name: str) -> DataFrame:
    """The values of column `name` on two rows or more, a written table."""
    return materialize(rows.groupBy(name).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(name), "dedup-shared")


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, hasher: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256. The largest id of equal texts stays.

    `hasher` is the grouping hash; a weak one changes the work, not the result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).withColumn("h", hasher(F.col("text")))
    ids = rows.select("doc_id", "h", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    groups = ids.groupBy("h").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    shared = groups.filter("group_size > 1").select("h")
    # Equal bytes inside the groups of one hash; written without the texts, which thus travel once.
    classes = materialize(
        rows.join(shared, "h")
        .groupBy("h", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"),
        "dedup-classes",
    )
    collided = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    clean = ids.join(groups.join(collided, "h", "left_anti"), "h").select("doc_id", "keep_id", "group_size", "text_sha256")
    # A hash shared by different texts: its classes, told apart by bytes above, are found again by their SHA-256.
    apart = classes.join(collided, "h", "left_semi")
    mixed = ids.join(apart, ["h", "text_sha256"]).select("doc_id", "keep_id", "group_size", "text_sha256")
    return clean.unionByName(mixed).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, all columns: one per distinct text.

    Rows whose hash nobody shares stay where they are; only the others are grouped. Among these one key of id and
    text serves the join and the removal of repeated rows.
    """
    def key(identity: Column, sha: Column) -> Column:
        return F.concat(F.coalesce(identity.cast("string"), F.lit("-")), F.lit(":"), sha)

    name = fresh(docs, "_key")
    rows = docs.withColumn(name, content_hash(text_or_empty(text)))
    side = small_side(shared_hashes(rows.select(name), name))
    among = rows.join(side, name, "left_semi").drop(name)
    kept = exact_groups(among, doc_id, text).filter("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias(name)).distinct()
    keyed = among.withColumn(name, key(among[doc_id], F.sha2(text_or_empty(text).cast("binary"), 256)))
    once = keyed.join(kept, name, "left_semi").dropDuplicates([name])
    return rows.join(side, name, "left_anti").unionByName(once).drop(name)
