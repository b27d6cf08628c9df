"""Small helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The white space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(name: str, m: int) -> Column:
    """crc32 of a key's text, modulo `m`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def parts(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a key-wise shuffle of rows that Spark can't size itself (packed arrays)."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let batches to Python hold at most `rows` rows: whole texts of any length stay within an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
