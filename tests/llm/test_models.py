"""Toxicity, Katz, BPE and nearest neighbours."""

from __future__ import annotations

import math
import random

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from panelkit.llm import ann, bpe, katz, toxicity
from panelkit.llm.frames import crc_mod

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# ---- BPE -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    e = bpe.Encoder(bpe.read_ranks(PATH))
    return [(e, data, e.encode(data, cuts)) for data, cuts in bpe.slices(texts)]


def test_bpe_like_the_library(reference):
    rnd = random.Random(1)
    letters = "ab'srtvelmd  \n\t 　 é1٣½!?.-'​́🙂中Ⅷ\x85\x1c\0"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(4000)]
    texts += ["", "'", " '", "'s", "it'll'lly 's", " \n ", "a" * 20_000, "ab" * 9000, "\n" * 5000, "<|endoftext|>"]
    for t, (e, data, ids) in zip(texts, encoded(texts)):
        assert ids.tolist() == reference.encode_ordinary(t)
        assert e.decode(ids) == data
        assert [data[a:b] for a, b in zip(e.offsets(ids), e.offsets(ids)[1:])] == [reference.decode_single_token_bytes(i) for i in ids]


def test_every_code_point_has_the_patterns_class(reference):
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(s, s + 64) if not 0xD800 <= c <= 0xDFFF) for s in range(0, 0x110000, 64)]
    bad = [t for t, (_, _, ids) in zip(texts, encoded(texts)) if ids.tolist() != reference.encode_ordinary(t)]
    assert not bad


def test_small_scan_windows(reference, monkeypatch):
    monkeypatch.setattr(bpe, "SCAN_CHARS", 50)
    texts = ["don't stop 's", "", "x" * 700, " 12 a"] * 20
    assert [ids.tolist() for _, _, ids in encoded(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_encode_documents(spark, reference):
    rows = [(1, "Hello 'll wörld", 0), (None, None, 0), (1, "", 1), (2, "y" * 100_000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = {(r.doc_id, r.n_tokens): r for r in bpe.encode_documents(df, PATH, keep_ids=True).collect()}
    for i, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        assert got[i, len(ids)].ids == ids and got[i, len(ids)].round_trip
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0


# ---- Katz ---------------------------------------------------------------------------------------


def corpus():
    rnd = random.Random(5)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60)))) for i in range(300)]
    return rows + [(300, None), (301, " \n"), (302, "hot " * 20_000), (303, "Hot hOT new"), (None, "w1 w2")]


@pytest.mark.parametrize("bucket_bytes,chunk", [(24_000_000, 1_200_000), (20_000, 3000)])
def test_katz_matches_plain_version(spark, monkeypatch, bucket_bytes, chunk):
    monkeypatch.setattr(katz, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(katz, "CHUNK_TOKENS", chunk)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit(0))
    got = {r.doc_id: r for r in katz.katz_scores(df, crc_mod("doc_id", 5) != 1).collect()}
    want, _, _, _ = brute.katz(rows)
    assert len(got) == len(rows)
    for i, w in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert math.isclose(r.base_score, w[3], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, w[4], rel_tol=1e-9, abs_tol=1e-9)


def test_katz_probabilities_add_up():
    _, p2, uni, context = brute.katz(corpus())
    for v in ["<", b"w1", b"hot", b"w2", b"never seen"]:
        total = sum(p2(v, w) for w in uni) + p2(v, b"an unknown word")
        assert total == pytest.approx(1, abs=1e-9)


def test_katz_without_training_rows_or_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in katz.katz_scores(df, F.lit(False)).collect()}
    assert got[1].score == got[1].base_score == 0 and got[1].n_known == 0 and got[2].n_tokens == 1
    assert katz.katz_scores(df.limit(0), F.lit(True)).count() == 0


def test_pack_round_trip():
    for v in ([], [0], [5, 5, 5], [0, 255, 256, 70_000, 1 << 40]):
        assert katz.unpack(katz.pack(np.array(v, np.int64))).tolist() == v
        assert katz.unpack(katz.pack(np.array(v, np.int64), True), True).tolist() == v


def test_discounts_fall_back():
    d = katz.Discounts.good_turing([0, 0, 0, 0, 0, 0])
    assert d.small == (1.0, 0.5, 0.75, 2.5 / 3, 0.875, 0.9)
    d = katz.Discounts.good_turing([1000, 400, 220, 150, 110, 90])
    assert all(0 < x < 1 for x in d.small[1:])


# ---- nearest neighbours ------------------------------------------------------------------------


def exact(ids, v, k):
    s = v @ v.T
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        order = [j for j in np.lexsort((ids, -s[i])) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(30, 24))
    v = (centers[rng.integers(30, size=3000)] + 0.7 * rng.normal(size=(3000, 24))) * rng.uniform(0.5, 2, size=(3000, 1))
    v[100:1100] = v[100] + 1e-3 * rng.normal(size=(1000, 24))  # one common vector
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>")
    got = ann.search(df.withColumn("id", F.lit(0)).withColumn("key", F.lit(0)), F.col("id") % 20 == 0).toPandas()
    want = exact(ids, v, 20)
    found = got.groupby("query_id")["vec_id"].agg(set)
    assert sum(len(found[q] & set(w)) for q, w in want.items()) >= 0.9 * 20 * len(want)
    assert (got.groupby("query_id").size() == 20).all()
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and (np.diff(g["score"]) <= 0).all() and q not in set(g["vec_id"])
        assert np.allclose(g["score"], v[g["vec_id"]] @ v[q], rtol=0, atol=1e-9)


def test_odd_vectors(spark):
    good = [(i, [float(i % 3), 1.0]) for i in range(0, 60, 10)]
    bad = [(61, None), (62, [0.0, 0.0]), (63, [1.0, None]), (64, [float("nan"), 1.0]), (65, [float("inf"), 1.0]), (66, [1.0]), (None, [1.0, 1.0]), (80, [0.0, 0.0])]
    df = spark.createDataFrame(good + bad + [(10, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("id") % 20 == 0).collect()
    assert {r.query_id for r in got} == {0, 20, 40}
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 20, 40)}
    # all candidates, ties to smaller ids: inner products with [0, 1] are all 1
    assert by[0] == [10, 20, 30, 40, 50]
    assert all(len(x) == 5 for x in by.values())
    assert ann.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_two_folds_and_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 6))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    h = ann.Hashing(6, 2, 2)
    near = ann._best(ann.search_buckets(rows, rows.filter("id % 20 = 0"), h, h.buckets, 5, block=16), 5).collect()
    want = exact(np.arange(400), v, 5)
    assert {r.query_id: [n.id for n in r.near] for r in near} == want


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(2).normal(size=(5, 16))
    y = ann.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(ann.hadamard(y), x)


# ---- toxicity --------------------------------------------------------------------------------------


def labelled(spark, n=900):
    rnd = random.Random(9)
    plain = [f"{a}{b}" for a in "bcdfg" for b in ("an", "ir", "olo", "um", "est")]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(10, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(["idiot", "scum", "blorgh", "you", "m0r0n"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = labelled(spark)
    odd = [(9000, None), (9001, ""), (None, "an idiot"), (9002, "ban " * 200_000), (5, rows[5][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumns({"score": F.lit(0), "features": F.lit(1), "_raw": F.lit(2)})
    marks = spark.createDataFrame(labels + [(None, 1), (7, None), (8, 5), (123456, 1), (4, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks, config=toxicity.Config(trees=8))
    assert "blorgh" in model.lexicon and len(model.lexicon) <= 1000 + len(toxicity.SEED)
    got = toxicity.score(docs, model, out="value").toPandas()
    assert len(got) == len(rows) + len(odd) and got["value"].between(0, 1).all()
    held = got.merge(spark.createDataFrame(labels, "doc_id long, toxic int").toPandas(), on="doc_id")
    import zlib

    held = held[[zlib.crc32(str(int(i)).encode()) % 3 == 1 for i in held["doc_id"]]]
    flagged = held["value"] >= 0.7
    assert held["toxic"][flagged].mean() > 0.9 and flagged[held["toxic"] == 1].mean() > 0.8
    kept = toxicity.keep_clean(docs, marks, toxicity.Config(trees=8))
    assert kept.columns == docs.columns and kept.filter("doc_id in (9000, 9001, 9002)").count() == 3


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "fine"), (3, None)], "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs, marks)).collect()}
    assert got == {1: pytest.approx(1 / 3), 2: 0, 3: 0}
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0), marks)).count() == 0


def test_obfuscated_and_second_person():
    words = toxicity.Words({"moron": 3.0, "idiot": 4.0})
    names = toxicity.FEATURES
    f = dict(zip(names, toxicity.features("you are a m0r0n, really", words)))
    assert f["obfuscated"] > 0 and f["near_second"] > 0 and f["max_weight"] == 3.0
    assert toxicity.features("", words) == [0.0] * len(names)
