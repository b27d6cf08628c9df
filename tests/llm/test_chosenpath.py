"""The chosen-path join against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from panelkit.llm import bitmaps, chosenpath
from panelkit.llm.frames import table

SCHEMA = "doc_id long, text string, row string"


def sets(t, width=3):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain(rows, num=85, den=100):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    s, parent = [sets(t) for _, t, *_ in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and min(len(s[i]), len(s[j])) * den >= num * max(len(s[i]), len(s[j])) and den * len(s[i] & s[j]) >= num * len(s[i] | s[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s[i]), least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in chosenpath.near_groups(df).collect()), key=str)


def corpus(seed=3):
    rnd = random.Random(seed)
    word = lambda: f"w{int(rnd.paretovariate(0.6)) % 3000}"
    passage, texts = [word() for _ in range(60)], []
    for _ in range(60):
        base = [word() for _ in range(rnd.randint(1, 200))]
        texts.append(base)
        for _ in range(rnd.randint(0, 4)):  # edits around the threshold
            t = list(base)
            for _ in range(rnd.randint(0, max(1, len(t) // 25))):
                t[rnd.randrange(len(t))] = word()
            texts.append(t)
    for _ in range(150):  # one common passage, too little of the text to link
        texts.append(passage + [word() for _ in range(rnd.randint(20, 90))])
    group = [word() for _ in range(120)]
    for _ in range(100):  # a dense group, and chains out of it
        group = list(group)
        group[rnd.randrange(120)] = word()
        texts.append(group)
    out = [(i, " ".join(t), "x") for i, t in enumerate(texts)]
    rnd.shuffle(out)
    return out + [(900, None, "x"), (901, " \n", "x"), (902, "", None), (None, out[0][1].upper(), "x"), (None, "alone here", "x"), (7, "repeated id of another text", "x")]


@pytest.mark.parametrize("small,depth,block", [(chosenpath.SMALL, chosenpath.DEPTH, chosenpath.BLOCK), (64, 8, 1024), (4, 1, 16)])
def test_equals_all_pairs(spark, monkeypatch, small, depth, block):
    monkeypatch.setattr(chosenpath, "SMALL", small)
    monkeypatch.setattr(chosenpath, "DEPTH", depth)
    monkeypatch.setattr(chosenpath, "BLOCK", block)
    rows = corpus()
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)


def test_whole_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    assert got(df) == plain([tuple(r) for r in df.collect()])


def test_empty_and_long(spark):
    assert chosenpath.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"t{i}" for i in range(200_000))
    rows = [(1, long, None), (2, long + " tail of a few words", None), (3, "x", None), (4, "X", None)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_tiles_find_the_pairs_that_one_by_one_comparing_finds(monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(0, 0, 0, bitmaps.bitmap(np.zeros(0, np.int64)))]
    for i in range(1, 260):  # sizes over several widths, ties among them, near copies in labels of their own and shared ones
        size = int(rng.choice([1, 2, 60, 64, 65, 120, 128, 130, 500, 2000]))
        s = np.unique(np.concatenate((np.arange(size - size // 10), rng.integers(1 << 40, 1 << 50, size // 10))))
        rows.append((i, len(s), i if i % 3 else 0, bitmaps.bitmap(s)))
    for tile in ((64, 512), (7, 5)):
        monkeypatch.setattr(chosenpath, "TILE", tile)
        for num, den in ((85, 100), (1, 2)):
            fit = {frozenset((a, b)) for a, na, la, x in rows for b, nb, lb, y in rows if la != lb and na * den >= nb * num
                   and nb * den >= na * num and bitmaps.may_be_similar(na, x, nb, y, num, den)}
            a, b = chosenpath._near_pairs(rows, num, den)
            assert len(a) == len(fit) and {frozenset(p) for p in zip(a, b)} == fit and fit
    assert chosenpath._near_pairs([], 85, 100) == ([], [])


def test_forest_connects_what_all_pairs_connect(monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):  # three dense groups with edits around the threshold, labels shared by some
        s = np.arange(150) + (i % 3 << 20)
        k = rng.integers(0, 25)
        s = np.unique(np.concatenate((np.delete(s, rng.choice(150, k, replace=False)), rng.integers(1 << 40, 1 << 50, k // 3))))
        rows.append((i, len(s), i if i % 7 else i % 3 + 10_000, bitmaps.bitmap(s)))

    def groups(pairs):
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for i, _, label, _ in rows:
            parent[find(-1 - i)] = find(label)
        for a, b in pairs:
            parent[find(-1 - a)] = find(-1 - b)
        return [frozenset(j for j, *_ in rows if find(-1 - j) == find(-1 - i)) for i, *_ in rows], len({find(r[2]) for r in rows})

    every = list(zip(*chosenpath._near_pairs(rows, 85, 100)))
    for edges in (chosenpath.EDGES, 700):
        monkeypatch.setattr(chosenpath, "EDGES", edges)
        forest = list(zip(*chosenpath._near_pairs(rows, 85, 100, True)))
        assert groups(forest) == groups(every) and set(forest) <= set(every)
        assert len(forest) == len({r[2] for r in rows}) - groups(every)[1] < len(every) / 50


def test_dense_groups_hand_on_fewer_pairs_than_rows(spark, monkeypatch):
    rnd = random.Random(4)
    passage, rows = [f"p{i}" for i in range(60)], []
    for g in range(8):  # groups that share a passage, so that places hold several of them
        base = passage + [f"g{g}w{i}" for i in range(200)]
        for i in range(50):
            t = list(base)
            t[rnd.randrange(60, 260)] = f"e{i}"
            rows.append((100 * g + i, " ".join(t), "x"))
    # Stars that miss a group leave all of it to the exhaustive step.
    monkeypatch.setattr(chosenpath, "_filtered", lambda pairs, *a: pairs.limit(0))
    made, across = [], chosenpath._across
    monkeypatch.setattr(chosenpath, "_across", lambda df, *a: made.append((across(df, *a).count(), df.count())) or across(df, *a))
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert made and all(pairs < n for pairs, n in made if n), made


def test_large_nodes_of_many_sizes_are_compared_without_branching(spark, monkeypatch):
    rnd = random.Random(6)
    passage, rows = [f"p{i}" for i in range(60)], []
    for i in range(150):
        t = passage + [f"t{i}w{rnd.randrange(10**6)}" for _ in range(int(68 * 1.02**i) - 58)]
        rows += [(i, " ".join(t), "x"), (1000 + i, " ".join([*t, "tail"]), "x")]
    monkeypatch.setattr(chosenpath, "SMALL", 48)
    monkeypatch.setattr(chosenpath, "_next_level", lambda *a: pytest.fail("branched"))
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_bitmaps_turn_no_similar_pair_away():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randint(1, 400)
        base = [rnd.getrandbits(30) for _ in range(n)]
        other = [x if rnd.random() > 0.1 else rnd.getrandbits(30) for x in base] + [rnd.getrandbits(30) for _ in range(rnd.randint(0, n // 8))]
        a, b = (bitmaps.shingle_set([str(w).encode() for w in t], 1) for t in (base, other))
        if bitmaps.similar(a, b, 85, 100):
            assert bitmaps.may_be_similar(len(a), bitmaps.bitmap(a), len(b), bitmaps.bitmap(b), 85, 100)


def test_shingle_sets():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 100) for _ in range(rnd.randint(1, 40))) for _ in range(60)] + ["", "one", "one one", "one one one one"]
    members = {}
    for t in texts:
        for width in (1, 3, 5):
            s = bitmaps.shingle_set(bitmaps.words_of(t), width)
            assert len(s) == len(sets(t, width)) and (s[1:] > s[:-1]).all()
            for h in s.tolist():
                members.setdefault(h, set()).add((width, t))
    whole = set().union(*(sets(t, w) for t in texts for w in (1, 3, 5)))
    assert len(members) == len(whole)
    assert bitmaps.shingle_set([b"a", b"b"], 2).tolist() != bitmaps.shingle_set([b"b", b"a"], 2).tolist()
