"""Near copies by five-word Jaccard similarity, against all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F

from panelkit.llm import chosenpath, simhash
from panelkit.llm.frames import table
from panelkit.llm.graph import components
from panelkit.session import materialize

SF = "/root/testdata/sf0.001"


def kept(rows, width=5):
    """Rows (id, text) that stay, by comparing all pairs."""
    def sets(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    s, parent = [sets(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] == s[j] or 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]) > 0:
                parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups.values()), key=str)


def corpus():
    rnd = random.Random(3)
    word = lambda: f"w{int(rnd.paretovariate(0.6)) % 3000}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rnd.randint(3, 150))]
        texts.append(base)
        for _ in range(rnd.randint(0, 3)):  # scattered edits or an added tail, around the threshold
            t = list(base)
            if rnd.random() < 0.5:
                for _ in range(rnd.randint(0, max(1, len(t) // 30))):
                    t[rnd.randrange(len(t))] = word()
            else:
                t += [word() for _ in range(rnd.randint(0, max(1, len(t) // 3)))]
            texts.append(t)
    for _ in range(30):  # one common passage, mostly too little of the text to link
        texts.append(passage + [word() for _ in range(rnd.randint(0, 60))])
    group = [word() for _ in range(100)]
    for _ in range(60):  # a dense group, and chains out of it
        group = list(group)
        group[rnd.randrange(100)] = word()
        texts.append(group)
    out = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rnd.shuffle(out)
    return out + [(900, None), (901, " \n"), (902, ""), (None, out[0][1].upper()), (None, "alone")]


def test_all_similar_pairs_link(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = chosenpath.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == kept(rows)


def test_stage_finds_pairs_far_apart_in_bits(spark):
    docs = materialize(table(spark, SF, "documents").dropDuplicates(["text"]).select("doc_id", "text", "source"), "once")
    want = kept([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted((r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()), key=str)
    assert len(want) < docs.count() and got == want


def test_repeated_ids(spark):
    a, b = " ".join("abcdefghij"), " ".join("qrstuvwxyz")
    rows = [(3, a), (5, a + " k"), (5, b), (7, b), (5, b)]
    got = chosenpath.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(3, a), (5, b)]


def near_copies():
    """A long text, three copies with a word more or less, and another text."""
    rnd = random.Random(8)
    words = [f"w{rnd.randrange(4000)}" for _ in range(3000)]
    texts = [words, [*words, "tail"], ["head", *words], words[:-1], [f"v{rnd.randrange(4000)}" for _ in range(3000)]]
    return [(i + 1, " ".join(t)) for i, t in enumerate(texts)]


def test_simhash_proposes_the_pairs_within_its_radius(spark):
    rows = near_copies() + [(11, "one two"), (12, "ONE  two"), (13, ""), (14, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    prints = {i: simhash.fingerprint(t, 5) for i, t in rows}
    group = {i: {j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3} for i in prints}
    label = {i: min(g) for i, g in group.items()}
    assert sum(len(g) > 1 for g in group.values()) > 4
    pairs = simhash.near_pairs(df, width=5)
    assert {r.node: r.label for r in components(pairs).collect()} == {i: label[i] for i, g in group.items() if len(g) > 1}
    assert all((prints[r.a] ^ prints[r.b]).bit_count() <= 3 for r in pairs.collect())


def test_stage_runs_simhash_over_five_words(spark, monkeypatch):
    asked, near = [], simhash.near_pairs
    monkeypatch.setattr(simhash, "near_pairs", lambda *a, **options: asked.append(options) or near(*a, **options))
    # Without the trees' nodes the pairs that SimHash proposes are all there is.
    monkeypatch.setattr(chosenpath, "_first_level", lambda classes: classes.select(F.lit(0).cast("long").alias("key"), "node", "n").limit(0))
    rows = near_copies()
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert asked == [{"width": 5}]
    assert sorted(r.doc_id for r in got) == kept(rows) == [1, 5]


def test_proposals_are_confirmed_on_whole_sets(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    every = lambda r: r.select(F.col("row").alias("a")).crossJoin(r.select(F.col("row").alias("b"))).filter("a > b")
    assert sorted(r.doc_id for r in chosenpath.keep_one(df, propose=every).collect()) == [1, 5]
