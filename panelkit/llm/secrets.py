r"""Secret scans over an incremental blob ledger.

Every version of a path is content-addressed (SHA-256 of its text). A ledger, a
Parquet table in a folder all executors see, holds one row per (blob, rule version)
that has been scanned, with its findings, empty ones too. A scan reads the ledger,
takes one text for each blob that the current rule version hasn't seen, scans it,
appends the results, and joins findings back to every path by blob. A text that a
third of all paths share is scanned once and its row joined to all of them (adaptive
execution splits that join). A run that is lost before its append has written
nothing; one that is repeated appends pairs that readers take once.

Base rules are leftmost non-overlapping matches per kind, kept if long enough:
assign (a keyword in either case, `:` or `=`, a value of 6+), access (`AKIA..`, 20+),
hex (24+). Further kinds only add spans. Offsets count code points.

Defined results: null is the empty text, which has no findings. Ids may repeat and be
null; every row is returned. Empty tables give empty results and an empty ledger
entry set. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelkit.llm.frames import text_or_empty

RULES = "3"
BASE = ("assign", "access", "hex")
# The base patterns. ASCII letters only fold case where the kind says so.
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Added kinds: a literal that must occur, and a pattern. A match may start only where no character of its own
# class stands before it, so that no part of a text is walked from more than one start.
ADDED = {
    "private_key": ("-----BEGIN", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")),
    "jwt": ("eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "forge_token": ("gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    "chat_token": ("xox", re.compile(r"(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]{10,}")),
    "url_password": ("://", re.compile(r"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@")),
}
KINDS = (*BASE, *ADDED)
FINDING = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
]))


def find(text: str) -> list[tuple[str, int, int]]:
    """All findings of a text, by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    for kind, (literal, pattern) in ADDED.items():
        if literal in text:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


@F.pandas_udf(FINDING)
def _scan(text: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in text])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(blob, rules, findings), one row per pair; empty if there is no ledger yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = T.StructType([
        T.StructField("blob", T.BinaryType()), T.StructField("rules", T.StringType()), T.StructField("findings", FINDING),
    ])
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scan_versions(
    versions: DataFrame, ledger: str, doc_id: str = "doc_id", text: str = "text", rules: str = RULES
) -> DataFrame:
    """Scans what the ledger lacks, appends it, and returns per row: doc_id, blob, findings."""
    spark = versions.sparkSession
    rows = versions.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    rows = rows.withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    known = read_ledger(spark, ledger).filter(F.col("rules") == rules).select("blob")
    # One text per unseen blob: copies collapse before they travel.
    unseen = rows.select("blob", "text").join(known, "blob", "left_anti").dropDuplicates(["blob"])
    unseen.select("blob", F.lit(rules).alias("rules"), _scan("text").alias("findings")).write.mode("append").parquet(ledger)
    seen = read_ledger(spark, ledger).filter(F.col("rules") == rules).dropDuplicates(["blob"])
    # Only blobs with findings need to meet the paths again.
    found = seen.filter(F.size("findings") > 0).select("blob", "findings")
    return rows.select("doc_id", "blob").join(found, "blob", "left").select(
        "doc_id", "blob", F.coalesce("findings", F.array().cast(FINDING)).alias("findings")
    )


def _joined(kinds: tuple[str, ...]) -> Callable:
    def join(findings: Iterable) -> str:
        return ",".join(f"{f['kind']}:{f['start']}:{f['end']}" for f in findings if f["kind"] in kinds)
    return join


def digest(text: str) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, base_sha256 and spans of one text: what the query derives from findings."""
    found = [dict(zip(("kind", "start", "end"), f)) for f in find(text)]
    counts = [sum(f["kind"] == k for f in found) for k in BASE]
    base = _joined(BASE)(found)
    return (*counts, hashlib.sha256(base.encode()).hexdigest(), _joined(KINDS)(found))
