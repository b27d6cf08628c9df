"""The pipeline against plain versions of its stages, and the queries on their tables."""

from __future__ import annotations

import hashlib

import brute
import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_similarity import kept as similar_kept

from panelkit.llm import bpe, toxicity
from panelkit.llm.frames import table
from panelkit.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def result(spark):
    return corpus_pipeline.run(spark, SF).collect()


def test_pipeline_matches_plain_stages(spark, result):
    docs = table(spark, SF, "documents")
    model = toxicity.learn(docs, table(spark, SF, "labels"))
    scored = toxicity.score(docs, model).collect()
    clean = [(r.doc_id, r.text, r.source) for r in scored if r.score < 0.7]
    assert 0 < len(clean) < len(scored)
    last = {}
    for i, t, s in sorted(clean):
        last[t or ""] = (i, t, s)
    once = sorted(last.values())
    stay = set(similar_kept([(i, t) for i, t, _ in once]))
    kept = [r for r in once if r[0] in stay]
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY)))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {i: t or "" for i, t, _ in kept}
    want = []
    for i, times, *_ in brute.mix(kept):
        ids = enc.encode_ordinary(text[i])
        digest = hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        want += [(i, len(ids), digest, hashlib.sha256(text[i].encode()).hexdigest())] * times
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in result) == sorted(want)


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents").withColumns({"score": F.lit(1), "position": F.lit("p")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_queries_return_every_row(spark):
    n = {t: table(spark, SF, t).count() for t in ("documents", "pages")}
    for name, rows in (("op2_warc", "pages"), ("op4_toxicity", "documents"), ("op5_secret_scan", "documents"), ("op8_bpe", "documents"), ("op9_katz", "documents"), ("op10_simhash", "documents")):
        assert QUERIES[name](spark, SF).count() == n[rows], name
