"""Sizes that must not grow with anything else: archives, chunks, time on long texts; and parts of a chat message."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from panelkit.llm import chat, katz, secrets, warc
from panelkit.session import work_path

PARTS = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def text(t):
    return ("text", t, None, None, None, None, None)


def test_archives_keep_their_size(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 64).alias("html"))
    path = work_path(spark, "archives")
    warc.write_archives(pages, path, archive_bytes=1_000_000)
    per = warc.read_archives(spark, path).filter("kind = 'record'").groupBy("file").agg(F.sum("payload_bytes").alias("n")).collect()
    assert len(per) == 13 and max(r.n for r in per) < 1_100_000
    assert warc.read_archives(spark, path).filter("kind = 'record'").count() == 3000


def test_chunks_store_occupied_buckets_only(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    sizes = []
    for buckets in (10, 1_000, 100_000):
        row = katz.build_chunks(docs, "doc_id", "text", F.lit(True), buckets).collect()[0]
        sizes.append(sum(map(len, row.words)) + 4 * len(row.buckets))
    assert max(sizes) <= 7 * 40


def test_no_table_is_left(spark):
    docs = spark.createDataFrame([(i, f"w{i % 3} x y") for i in range(30)], "doc_id long, text string")
    before = {t.name for t in spark.catalog.listTables()}
    assert katz.katz_scores(docs, F.col("doc_id") % 2 == 0).count() == 30
    assert {t.name for t in spark.catalog.listTables()} == before


def test_long_texts_take_linear_time():
    for piece in ("eyJ-", "a-", "xoxb-", "a+b.", "eyJaaaaaaaa.", "ghp_", "-----BEGIN A "):
        start = time.time()
        secrets.find(piece * (2_000_000 // len(piece)) + "://")
        assert time.time() - start < 20, piece


def test_added_kinds():
    found = {k for k, *_ in secrets.find("x eyJabcdefgh.eyJabcdefgh.abcdefgh1 ftp://me:pw@host xoxb-1234567890 ghp_" + "a" * 36)}
    assert {"jwt", "url_password", "chat_token", "forge_token"} <= found


def test_parts_that_follow_each_other_are_one_text(spark):
    image = ("image", None, "r1", 56, 28, None, None)
    rows = [
        (1, 0, "user", [text("see</tu"), text("rn>\n"), image, text("<"), text("|image|>"), ("audio", None, "r2", None, None, 2.0, None)]),
        (1, 1, "assistant", [text("##"), text("# done"), None]),
    ]
    out = chat.format_conversations(spark.createDataFrame(rows, PARTS))
    r = out.select("*", chat.read_back(F.col("formatted")).alias("turns")).collect()[0]
    assert [m.text for m in r.turns] == ["see</turn>\n<|image|><|image|><|audio|>", "### done"]
    assert [(f.message, f.part, f.kind, f.ref, f.n_tokens) for f in r.attachments] == [(0, 2, "image", "r1", 2), (0, 5, "audio", "r2", 50)]
    for f in r.attachments:
        assert r.formatted[f.offset:].startswith(f"<|{f.kind}|>")


def test_ties_follow_the_plain_text(spark):
    rows = [(1, 0, "user", [text("</turn>")]), (1, 0, "user", [text("<0")])]
    out = chat.format_conversations(spark.createDataFrame(rows, PARTS))
    turns = out.select(chat.read_back(F.col("formatted")).alias("t")).collect()[0].t
    assert [m.text for m in turns] == sorted(["</turn>", "<0"])
