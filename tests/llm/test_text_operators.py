"""Chat formatting, exact dedup, mixing and SimHash against plain versions and on odd rows."""

from __future__ import annotations

import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from panelkit.llm import chat, dedup, mixing, simhash
from panelkit.llm.graph import components
from panelkit.session import materialize

MESSAGES = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, source string"


# ---- chat --------------------------------------------------------------------------------


def test_chat_reads_back_exactly(spark):
    texts = ["", None, "\\### Assistant: </turn> ok", "</turn>\n", "\\\\", "<|image|> \\<", "a: b ### c", "é🙂\n", "x" * 300_000, "\\"]
    roles = ["user", "assistant", None, "as: sis\\tant", ""]
    rows = [(i % 4 if i % 4 else None, i if i % 5 else None, roles[i % 5], t) for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, MESSAGES).withColumn("parts", chat.text_parts(F.col("text"))).withColumn("formatted", F.lit(1))
    got = chat.format_conversations(df).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn(
        "learned", chat.learned_text(F.col("formatted"), F.col("spans"))).collect()
    assert len(got) == 4
    for r in got:
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", chat_text(x[3])))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.learned == "".join(x[3] or "" for x in own if x[2] == "assistant")


def chat_text(text):
    for plain, safe in (("\\", "\\\\"), ("</turn>", "<\\/turn>"), ("### ", "##\\# "), ("<|", "<\\|")):
        text = (text or "").replace(plain, safe)
    return text


def test_chat_parts_become_placeholders(spark):
    parts = [
        ("text", "look <|image|>", None, None, None, None, None), ("image", None, "i.png", 56, 29, None, None),
        ("audio", None, "a.wav", None, None, 1.5, None), ("document", None, "d.pdf", None, None, None, 3), (None, "end", None, None, None, None, None),
    ]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(df).first()
    assert r.formatted == "### user: look <\\|image|><|image|><|audio|><|document|>end</turn>\n### assistant: </turn>\n"
    assert [(a.message, a.part, a.kind, a.ref, a.n_tokens) for a in r.attachments] == [
        (0, 1, "image", "i.png", 4), (0, 2, "audio", "a.wav", 38), (0, 3, "document", "d.pdf", 1536)]
    assert r.expanded_tokens == 4 + 38 + 1536


def test_chat_of_nothing(spark):
    df = spark.createDataFrame([], MESSAGES).withColumn("parts", chat.text_parts(F.col("text")))
    assert chat.format_conversations(df).count() == 0


# ---- exact dedup -----------------------------------------------------------------------------


def docs_with_copies(spark):
    rows = [(i, f"text {i % 7}", "s") for i in range(40)] + [(40, None, "s"), (41, "", None), (None, "text 1", "s"), (5, "text 5", "s")]
    rows += [(50, "long " * 200_000, "s"), (51, "long " * 200_000, "s")]
    return rows, spark.createDataFrame(rows, DOCS).withColumns({"h": F.lit(1), "kept": F.lit("x"), "_sha": F.lit(0)})


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    rows, df = docs_with_copies(spark)
    hasher = (lambda t: F.substring(F.md5(t.cast("binary")), 1, 1)) if weak else dedup.content_hash
    got = dedup.exact_groups(df, hasher=hasher).collect()
    want = []
    for i, t, _ in rows:
        same = [j for j, u, _ in rows if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] is not None, r[0] or 0, r[4])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_keep_one_of_each_text(spark):
    rows, df = docs_with_copies(spark)
    got = dedup.keep_one(df)
    assert got.columns == df.columns
    assert sorted(r.text or "" for r in got.collect()) == sorted({t or "" for _, t, _ in rows})
    assert dedup.keep_one(df.limit(0)).count() == dedup.exact_groups(df.limit(0)).count() == 0


def test_texts_of_their_own_stay_in_place(spark):
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.least("id", F.lit(50))).alias("text")).repartition(3)
    placed = materialize(df, "placed").withColumn("at", F.spark_partition_id())
    assert placed.select("at").distinct().count() > 1
    got = dedup.keep_one(placed).withColumn("now", F.spark_partition_id()).collect()
    assert sorted(r.doc_id for r in got) == [*range(50), 59]
    assert all(r.now == r.at for r in got if r.doc_id < 50)


# ---- mixing -------------------------------------------------------------------------------


def mixing_rows():
    rnd = random.Random(3)
    rows = [(i, " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.randint(0, 30))), rnd.choice("aaaaaaabbcdeé")) for i in range(400)]
    return rows + [(400, None, "a"), (401, "x y", None), (3, rows[3][1], rows[3][2]), (None, "p q r", "tiny")]


def test_mix_matches_plain_version(spark):
    rows = mixing_rows()
    df = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("no"), "taken": F.lit(1), "key": F.lit(2)})
    got = [(r.doc_id, r.times, r.size, r.source_size, pytest.approx(r.target)) for r in mixing.mix(df).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[3])
    assert sorted(brute.mix(rows), key=key) == sorted(got, key=key)
    taken = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("goal"), F.max("size").alias("m"))
    assert all(abs(r.t - r.goal) <= r.m for r in taken.collect())
    assert mixing.mix(df).filter("taken > 3 * size").count() == 0


def test_mixed_documents_in_order_of_position(spark):
    rows = mixing_rows()
    df = spark.createDataFrame(rows, DOCS).withColumn("position", F.lit(0))
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    want = sum(r[1] for r in brute.mix(rows))
    assert got.count() == want
    first, again = [[r.doc_id for r in got.collect()] for _ in range(2)]
    assert first == again


def test_position_inverts_demand(spark):
    u = spark.range(0, 101).select((F.col("id") / 100).alias("u"))
    for s in (-1.0, -0.5, 0.0, 0.5, 1.0):
        t = mixing._position(F.col("u"), F.lit(s))
        err = u.select(F.max(F.abs((1 - s) * t + s * t * t - F.col("u")))).first()[0]
        assert err < 1e-9


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.mix(df).count() == 0 and mixing.mixed_documents(df).count() == 0
    empty = spark.createDataFrame([(1, "", "a"), (2, None, "b")], DOCS)
    assert [(r.taken, r.target) for r in mixing.mix(empty).collect()] == [(0, 0.0)] * 2


# ---- SimHash --------------------------------------------------------------------------------


def test_fingerprint_by_definition():
    rnd = random.Random(1)
    texts = ["", None, " \n", "one", "one two", "ONE Two three", "é ß Ä", " ".join(rnd.choice("abcdefg") for _ in range(70_000))]
    assert [simhash.fingerprint(t) for t in texts] == [brute.xx_fingerprint(t) for t in texts]


@pytest.mark.parametrize("block", [4096, 8])
def test_links_connect_what_is_near(spark, block):
    rnd = random.Random(block)
    centers = [rnd.getrandbits(64) for _ in range(12)]
    prints = set()
    for c in centers:
        for _ in range(60):
            p = c
            for _ in range(rnd.randint(0, 5)):
                p ^= 1 << rnd.randrange(64)
            prints.add(p)
    prints |= {rnd.getrandbits(64) for _ in range(300)} | {0, 1, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    classes = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r.node: r.label for r in components(simhash.links(classes, block=block)).collect()}
    want = brute.components({p: p & (1 << 64) - 1 for p in signed})
    assert {p: got.get(p, p) for p in signed} == want


def test_thresholds_are_complete():
    import numpy as np

    rnd = np.random.default_rng(0)
    costs = [rnd.random((50, 4)) for _ in range(3)]
    for c in costs:
        c[:, 0] = 0
    t = simhash.thresholds(costs, 3)
    assert (t.sum(axis=1) == 1).all() and t.min() >= -1
    cost = sum(c[np.arange(50), t[:, i] + 1] for i, c in enumerate(costs))
    best = [min(costs[0][r, a + 1] + costs[1][r, b + 1] + costs[2][r, 1 - a - b + 1] for a in range(-1, 3) for b in range(-1, 3) if -1 <= 1 - a - b <= 2) for r in range(50)]
    assert np.allclose(cost, best)


def test_simhash_of_documents(spark):
    rnd = random.Random(7)
    base = [" ".join(rnd.choice("abcdefghij") * 3 for _ in range(200)) for _ in range(6)]
    rows = [(i, base[i % 6] if i % 3 else base[i % 6] + " tail", "s") for i in range(60)]
    rows += [(60, None, "s"), (61, "  ", "s"), (62, "", "s"), (7, rows[7][1], "s"), (None, rows[2][1], "s")]
    df = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("clash"))
    got = simhash.simhash_components(df).collect()
    assert len(got) == len(rows)
    known = {i: brute.xx_fingerprint(t) for i, t, _ in rows if i is not None}
    want = brute.components(known)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(200, 260)] + [(300, 300), (7, 3), (3, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in (100, *range(200, 260))}}
