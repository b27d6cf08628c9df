"""Near-duplicates by a chosen-path set similarity join on word shingles.

A text's set holds its distinct word shingles. Rows link when the Jaccard similarity of
their whole sets is at least `num / den`; a component is what links reach.

1. Equal sets collapse to one class. A class has a signature of `SLOTS` minwise tokens: two
   sets agree in a slot with a probability near their similarity.
2. Each of `TREES` independent trees branches the classes: a node chooses each slot with
   probability 1 / (BRANCH * SLOTS), by a hash of its own path, and hands every class it
   holds to the child named by the class's token in that slot. A class is handed on 1 / BRANCH
   times on average, a pair of similarity s stays together in s / BRANCH children: above
   one for wanted pairs, so they survive, and below for others, which fall apart.
3. Small nodes (`SMALL` classes) are one place, others are cut in places of two adjoining size bands: sizes that
   allow a link lie in one place. Small places are compared exhaustively, across components only, and hand on
   a spanning forest of their candidates: a dense group of g classes costs less than g of them. A place
   part of whose forest the whole sets refute may hide other links; it is compared again and hands on all.
4. In large places all classes are compared with the smallest class of their size band in the node (a star),
   which joins a dense group in as many comparisons as it has members. The classes of those that still hold
   several components branch again.
5. Where branching no longer thins large nodes out (texts that are alike, but not enough), or after
   `DEPTH` levels, they are cut in blocks and compared pair of blocks by pair of blocks, so no node is dropped.

Candidates pass an exact bound from parity bitmaps (`bitmaps`) and are then confirmed on
the whole sets. Recall: at similarity s the chance that no tree keeps a pair together is
(1 - r)^TREES, with r the chance in one tree. For a node compared at the first level
r = 1 - exp(-s / BRANCH): 3e-11 missed at s = 0.85, 1e-10 at 0.8; at the second level 4e-8 and 1e-7. In
nodes that branch on and on r falls to the survival of the branching process, 0.33 and 0.24: 4e-4 and
4e-3. Links that others of a component replace don't count. The tests compare with all pairs.

Defined results: null and blank texts have the empty set (n_shingles 0) and link with
nothing. Ids may repeat or be null: rows are told apart by a number of their own; a
component is named by its smallest id that isn't null. Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelkit.llm.bitmaps import bitmap, may_be_similar, shingle_set, similar, words_of
from panelkit.llm.frames import fresh, parts, small_batches, text_or_empty
from panelkit.llm.graph import components
from panelkit.operators.rows import small_side
from panelkit.session import materialize

TREES, SLOTS, BRANCH, DEPTH, SEED = 20, 64, 0.7, 8, 20
# Large nodes branch again only while that leaves fewer than this share of their rows in large nodes.
SHRINK = 0.75
# Classes of a place that are compared exhaustively, and of one block.
SMALL, BLOCK = 2048, 1024
# Pairs in a batch from Python, and of a place's pairs held before they are thinned to a forest.
PAIRS, EDGES = 1 << 14, 1 << 17
# Rows of nodes whose masks are made at a time; rows and partners of a tile of bitmaps.
STEP, TILE = 1 << 13, (64, 512)
# Rows (row, text) to pairs (a, b) of rows that may link.
Proposer = Callable[[DataFrame], DataFrame]


# --- signatures ----------------------------------------------------------------


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, SLOTS, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, SLOTS, np.uint32)


FACTORS, SHIFTS = (x[:, None] for x in _multipliers())


def signature(members: np.ndarray) -> np.ndarray:
    """The minwise token of each slot, from a set of 64-bit hashes."""
    low = (members ^ (members >> 32)).astype(np.uint32)
    out = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):  # a table that stays in the processor's cache
        out = np.minimum(out, (low[None, i:i + 512] * FACTORS + SHIFTS).min(axis=1))
    return out


def _sketched(rows: DataFrame, width: int) -> DataFrame:
    """(row, n, digest, bits, slots) of rows (row, text)."""
    def sketch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            n, digest, bits, slots = [], [], [], []
            for t in f.column(1):
                s = shingle_set(words_of(t.as_py()), width)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                bits.append(bitmap(s))
                slots.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [f.column(0), pa.array(n, pa.int32()), *(pa.array(c, pa.binary()) for c in (digest, bits, slots))], ["row", "n", "digest", "bits", "slots"])

    return rows.select("row", "text").mapInArrow(sketch, "row long, n int, digest binary, bits binary, slots binary")


# --- trees ---------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers: the finaliser of splitmix."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chosen(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node at, slot): the slots that each node chooses; a root chooses one at least."""
    tags = _mixed(np.arange(1, SLOTS + 1, dtype=np.uint64))
    return np.nonzero(_mixed(keys[:, None] ^ tags[None, :]) < np.uint64(2**64 / (BRANCH * SLOTS)))


def _children(keys: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row at, child): where the nodes `keys` hand the rows with these signatures."""
    at, slot = _chosen(keys)
    return at, _mixed(_mixed(keys[at] + slot.astype(np.uint64)) ^ slots[at, slot])


def _roots() -> list[tuple[np.uint64, int]]:
    """(root, slot) of all trees."""
    keys = _mixed(np.arange(SEED, SEED + TREES, dtype=np.uint64))
    at, slot = _chosen(keys)
    rest = np.setdiff1d(np.arange(TREES), at)
    return list(zip(np.concatenate([keys[at], keys[rest]]), np.concatenate([slot, rest % SLOTS]).tolist()))


def _first_level(classes: DataFrame) -> DataFrame:
    """(key, node, n): the classes in the children of all roots."""
    def branch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = _roots()
        for f in frames:
            if not f.num_rows:
                continue
            slots = _slots(f.column(2))
            keys = [_mixed(_mixed(np.full(1, k) + np.uint64(i)) ^ slots[:, i].astype(np.uint64)) for k, i in roots]
            for k in keys:
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), f.column(0), f.column(1)], ["key", "node", "n"])

    return classes.select("node", "n", "slots").mapInArrow(branch, "key long, node long, n int")


def _next_level(open_: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, node, n): the rows (key, node) in the children of their nodes."""
    def branch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for i in range(0, f.num_rows, STEP):
                g = f.slice(i, STEP)
                at, child = _children(g.column(0).to_numpy().view(np.uint64), _slots(g.column(3)))
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), g.column(1).take(at), g.column(2).take(at)], ["key", "node", "n"])

    return open_.select("key", "node").join(classes.select("node", "n", "slots"), "node").select("key", "node", "n", "slots").mapInArrow(
        branch, "key long, node long, n int")


def _slots(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SLOTS)


# --- comparing -------------------------------------------------------------------


def _sizes_allow(num: int, den: int, a: str, b: str):
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    return (x * den >= y * num) & (y * den >= x * num)


def _filtered(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes that the bitmaps don't rule out."""
    def keep(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            ok = [may_be_similar(*r, num, den) for r in zip(*(f.column(i).to_pylist() for i in (2, 3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([f.column(0), f.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = (classes.select(F.col("node").alias(t), F.col("n").alias(f"n_{t}"), F.col("bits").alias(f"bits_{t}")) for t in "ab")
    both = pairs.join(x, "a").join(y, "b").filter(_sizes_allow(num, den, "n_a", "n_b"))
    return both.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(keep, "a long, b long")


def _confirmed(pairs: DataFrame, rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are similar on their whole sets, a written table."""
    pairs = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "path-pairs")
    if pairs.limit(1).count() == 0:
        return pairs
    used = materialize(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct(), "path-used")
    texts = rows.select("row", "text").join(small_side(used), "row", "left_semi")

    def check(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # pairs come sorted by b
        for f in frames:
            ok = []
            for b, ta, tb in zip(f.column(1).to_pylist(), f.column(2), f.column(3)):
                if last != b:
                    last, held = b, shingle_set(words_of(tb.as_py()), width)
                ok.append(similar(shingle_set(words_of(ta.as_py()), width), held, num, den))
            yield pa.RecordBatch.from_arrays([f.column(0), f.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = (texts.select(F.col("row").alias(t), F.col("text").alias(f"text_{t}")) for t in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b")
    return materialize(both.mapInArrow(check, "a long, b long"), "path-links")


def _near_pairs(rows: list[tuple], num: int, den: int, forest: bool = False) -> tuple[list, list]:
    """(a, b): pairs of rows (node, n, label, bits) with different labels whose sizes and bitmaps allow a link.

    With `forest` only so many of them as connect, labels taken as connected, what all of them connect: the nearest.
    """
    found = list(_candidates(rows, num, den, forest))
    return tuple([x for f in found for x in f[i].tolist()] for i in (0, 1))


def _candidates(rows: list[tuple], num: int, den: int, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of `_near_pairs` in parts."""
    rows = sorted(rows, key=lambda r: (len(r[3]), r[1], r[0]))
    node, n, label = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    tree = np.unique(label, return_inverse=True)[1]
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    for p, q, far in _tiles([r[3] for r in rows], n, tree, num, den):
        if not forest:
            yield node[p], node[q]
            continue
        held = [np.append(x, y) for x, y in zip(held, (p, q, far / (n[p] + n[q])))]
        if len(held[0]) > EDGES:
            held = _spanning(tree, *held)
    if len(held[0]):
        p, q, _ = _spanning(tree, *held)
        yield node[p], node[q]


def _tiles(bits: list[bytes], n: np.ndarray, tree: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(p, q, differing bits): the pairs of rows in different trees that sizes and bitmaps allow, tile by tile.

    Rows come by bitmap width and size, so a tile of them meets one range of others; a tile is
    left as soon as the words of its bitmaps compared so far rule out all its pairs.
    """
    widths, first = np.unique([len(x) for x in bits], return_index=True)
    ends = np.append(first[1:], len(bits))
    held = [np.frombuffer(b"".join(bits[s:e]), np.uint64).reshape(e - s, -1) for s, e in zip(first, ends)]
    for wide in range(len(widths)):
        for narrow in range(wide + 1):
            mine, across, start = held[wide], np.ascontiguousarray(held[narrow].T), first[narrow]
            while mine.shape[1] * 8 > widths[narrow]:
                mine = mine[:, :mine.shape[1] // 2] ^ mine[:, mine.shape[1] // 2:]
            n_b = n[start:ends[narrow]]
            for i in range(first[wide], ends[wide], TILE[0]):
                x = slice(i, min(i + TILE[0], ends[wide]))
                lo = start + np.searchsorted(n_b * den, n[i] * num, "left")
                hi = start + np.searchsorted(n_b * num, n[x.stop - 1] * den, "right")
                for j in range(lo, min(hi, x.stop), TILE[1]):
                    y = slice(j, min(j + TILE[1], hi, x.stop))
                    fit = (n[x, None] * den >= n[y] * num) & (n[y] * den >= n[x, None] * num) & (tree[x, None] != tree[y])
                    if wide == narrow:
                        fit &= np.arange(i, x.stop)[:, None] > np.arange(j, y.stop)
                    if not fit.any():
                        continue
                    most = np.where(fit, (n[x, None] + n[y]) * (den - num) // (den + num), -1)
                    differ = np.zeros(fit.shape, np.int64)
                    for k in range(mine.shape[1]):
                        differ += np.bitwise_count(mine[i - first[wide]:x.stop - first[wide], k, None] ^ across[k, j - start:y.stop - start])
                        if k % 4 == 3 and (differ > most).all():
                            break
                    p, q = np.nonzero(differ <= most)
                    if len(p):
                        yield p + i, q + j, differ[p, q]


def _spanning(tree: np.ndarray, p: np.ndarray, q: np.ndarray, far: np.ndarray) -> list[np.ndarray]:
    """Of the edges (p, q, far) a minimum spanning forest of the trees: each tree takes its nearest edge until none is left."""
    order = np.argsort(far, kind="stable")
    u, v, left, kept = tree[p[order]], tree[q[order]], np.arange(len(order)), []
    while True:
        apart = u != v
        u, v, left = u[apart], v[apart], left[apart]
        if not len(left):
            kept = order[np.sort(np.concatenate(kept))] if kept else order[:0]
            return [p[kept], q[kept], far[kept]]
        ends, others = np.append(u, v), np.append(v, u)
        at, nearest = np.unique(ends[by := np.argsort(np.append(left, left), kind="stable")], return_index=True)
        nearest = by[nearest]
        kept.append(np.unique(left[nearest % len(left)]))
        over = np.arange(tree.max() + 1)
        over[at] = others[nearest]
        mutual = over[over] == np.arange(len(over))
        over[mutual] = np.minimum(over, np.arange(len(over)))[mutual]
        while (over != over[over]).any():
            over = over[over]
        u, v = over[u], over[v]


def _across(rows: DataFrame, key: list[str], num: int, den: int, forest: bool) -> DataFrame:
    """Pairs (a, b, *key) as by `_near_pairs` within each place `key` of rows (*key, node, n, label, bits)."""
    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []

        def found() -> Iterator[pa.RecordBatch]:
            pairs, size = [], 0
            for x in _candidates(held, num, den, forest):
                pairs.append(x)
                size += len(x[0])
                if size >= PAIRS:
                    yield batch(pairs, size)
                    pairs, size = [], 0
            if size:
                yield batch(pairs, size)

        def batch(pairs: list[tuple], size: int) -> pa.RecordBatch:
            ends = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*pairs)]
            return pa.RecordBatch.from_arrays([*ends, *(pa.array(np.full(size, v, np.int64)) for v in place)], ["a", "b", *key])

        for f in frames:
            columns = [c.to_pylist() for c in f.columns]
            for at, row in zip(zip(*columns[4:]), zip(*columns[:4])):
                if at != place:
                    if len(held) > 1:
                        yield from found()
                    place, held = at, []
                held.append(row)
        if len(held) > 1:
            yield from found()

    spread = rows.repartition(parts(rows.sparkSession), *key).sortWithinPartitions(*key)
    return spread.select("node", "n", "label", "bits", *key).mapInArrow(compare, ", ".join(f"{c} long" for c in ("a", "b", *key)))


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (key, lo, hi, node, n) for nodes of any size: blocks of about BLOCK rows meet pairwise, each pair of blocks in its own place."""
    size = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_k"))
    cut = rows.join(size, "key").withColumn("_i", F.pmod(F.xxhash64("node"), F.col("_k")).cast("int"))
    met = cut.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    lo, hi = (f("_i", "_j").cast("long") for f in (F.least, F.greatest))
    return met.select("key", lo.alias("lo"), hi.alias("hi"), "node", "n")


def _banded(rows: DataFrame, num: int, den: int) -> DataFrame:
    """`rows` with their size band: sizes that allow a link lie in one band or in adjoining ones."""
    return rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)))


def _placed(node: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (key, place, node, n, m) of rows (key, node, n, c): m rows are in the place."""
    whole = node.filter(F.col("c") <= SMALL).select("key", F.lit(-2).cast("long").alias("place"), "node", "n", F.col("c").alias("m"))
    wide = _banded(node.filter(F.col("c") > SMALL), num, den)
    both = [wide.select("key", place.alias("place"), "node", "n") for place in (F.col("band"), F.col("band") - 1)]
    cut = both[0].unionByName(both[1])
    several = cut.groupBy("key", "place").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    return whole.unionByName(materialize(cut.join(several, ["key", "place"]), "path-places"))


# --- the join ----------------------------------------------------------------------


def links(
    rows: DataFrame, classes: DataFrame, width: int, num: int, den: int, candidates: DataFrame | None = None
) -> DataFrame | None:
    """(node, label) of the classes that link with others: label is the smallest node reachable.

    `candidates` (a, b) are pairs of nodes that another method proposes; they are confirmed like all others, first.
    """
    label, open_, large = None, None, 0

    def join(new: DataFrame) -> None:
        """Take in new links: the components of their ends' labels rename those labels."""
        nonlocal label
        if new.limit(1).count() == 0:
            return
        if label is None:
            label = materialize(components(new), "path-labels")
            return
        ends = new.select(F.col("a").alias("node")).unionByName(new.select(F.col("b").alias("node"))).distinct()
        known = materialize(label.unionByName(ends.join(label, "node", "left_anti").withColumn("label", F.col("node"))), "path-known")
        x, y = (known.select(F.col("node").alias(t), F.col("label").alias(f"label_{t}")) for t in "ab")
        between = new.join(x, "a").join(y, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
        renamed = components(between).select(F.col("node").alias("label"), F.col("label").alias("_new"))
        label = materialize(known.join(renamed, "label", "left").select("node", F.coalesce("_new", "label").alias("label")), "path-labels")

    def labelled(df: DataFrame) -> DataFrame:
        return df.withColumn("label", F.col("node")) if label is None else df.join(
            label, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def mixed(df: DataFrame, key: list[str]) -> DataFrame:
        """Rows of places that hold several components."""
        named = labelled(df)
        keys = named.groupBy(*key).agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo <> _hi").select(*key)
        return named.join(keys, key, "left_semi")

    def told_apart(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose ends are not known to be linked."""
        if label is None:
            return pairs
        x, y = (label.select(F.col("node").alias(t), F.col("label").alias(f"label_{t}")) for t in "ab")
        return pairs.join(x, "a", "left").join(y, "b", "left").filter("NOT label_a <=> label_b OR label_a IS NULL").select(*pairs.columns)

    def exhaust(placed: DataFrame, key: list[str]) -> None:
        """Take in all links within the places `key` of rows (*key, node, n)."""
        forest = materialize(_across(mixed(placed, key).join(bits, "node"), key, num, den, True), "path-forest")
        if forest.limit(1).count() == 0:
            return
        join(_confirmed(forest.select("a", "b"), rows, width, num, den))
        doubtful = materialize(told_apart(forest).select(*key).distinct(), "path-doubtful")
        if doubtful.limit(1).count() == 0:
            return
        again = mixed(placed.join(small_side(doubtful), key, "left_semi"), key).join(bits, "node")
        every = _across(again, key, num, den, False).select("a", "b").distinct()
        join(_confirmed(every.join(forest.select("a", "b"), ["a", "b"], "left_anti"), rows, width, num, den))

    if candidates is not None:
        join(_confirmed(_filtered(candidates, classes, num, den), rows, width, num, den))
    bits = classes.select("node", "bits")
    for level in range(DEPTH + 1):
        keys = materialize(_first_level(classes) if open_ is None else _next_level(open_, classes), "path-nodes")
        shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        placed = _placed(materialize(keys.join(shared, "key"), "path-open"), num, den)
        exhaust(placed.filter(F.col("m") <= SMALL).drop("m"), ["key", "place"])
        wide = placed.filter(F.col("m") > SMALL).drop("m")
        if wide.limit(1).count() == 0:
            return label
        banded = _banded(wide.select("key", "node", "n").distinct(), num, den)
        lead = banded.groupBy("key", "band").agg(F.min("node").alias("b"))
        stars = banded.join(lead, ["key", "band"]).filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
        join(_confirmed(_filtered(told_apart(stars), classes, num, den), rows, width, num, den))
        open_ = materialize(mixed(wide, ["key", "place"]).select("key", "node", "n").distinct(), "path-large")
        large, before = open_.count(), large
        if not large:
            return label
        if level and large > SHRINK * before:
            break
    met = materialize(_in_blocks(open_), "path-blocks")
    for within in ("lo = hi", "lo < hi"):  # links within blocks first: across them a forest then has few to hand on
        exhaust(met.filter(within), ["key", "lo", "hi"])
    return label


def _labels(rows: DataFrame, width: int, num: int, den: int, propose: Proposer | None = None) -> DataFrame:
    """(row, n, label) of rows (row, text): the same label for all rows of a component, blank texts share one."""
    small_batches(rows.sparkSession)
    sketches = materialize(_sketched(rows, width), "path-sketches")
    first = materialize(sketches.groupBy("digest").agg(F.min("row").alias("node"), F.max("n").alias("n")), "path-classes")
    again = sketches.select("row", "digest").join(first.select("node", "digest"), "digest").filter("row <> node").select("row")
    rest = small_side(materialize(again, "path-repeats"))
    classes = sketches.filter("n > 0").join(rest, "row", "left_anti").select(F.col("row").alias("node"), "n", "bits", "slots")
    candidates = propose(rows.join(rest, "row", "left_anti")) if propose else None
    label = links(rows, classes, width, num, den, candidates)
    if label is None:
        label = first.select("node", F.col("node").alias("label"))
    known = first.join(label, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    return materialize(sketches.select("row", "n", "digest").join(known, "digest").select("row", "n", "label"), "path-named")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, width: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept (the row's id names its component)."""
    rows = materialize(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")), "path-rows")
    named = materialize(rows.select("row", "doc_id").join(_labels(rows, width, num, den), "row"), "path-ids")
    least = named.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return named.join(least, "label", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, width: int = 5, num: int = 4, den: int = 5,
    propose: Proposer | None = None,
) -> DataFrame:
    """Of each component the row smallest by (id, text), null ids last; all columns. Blank texts are one group.

    `propose` gets rows (row, text), one of each set, and returns pairs (a, b) of rows to confirm before the trees' own.
    """
    row = fresh(docs, "_row")
    held = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "path-rows")
    rows = held.select(F.col(row).alias("row"), text_or_empty(text).alias("text"))
    group = _labels(rows, width, num, den, propose).select(F.col("row").alias(row), F.col("label").alias("_label"))
    several = group.groupBy("_label").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_label")
    group = materialize(group.join(several, "_label"), "path-groups")
    order = F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.sha2(text_or_empty(text).cast("binary"), 256), F.col(row))
    ranked = held.select(row, order.alias("_order")).join(small_side(group), row)
    best = ranked.groupBy("_label").agg(F.min_by(row, "_order").alias(row))
    gone = materialize(group.join(best, row, "left_anti").select(row), "path-gone")
    return held.join(small_side(gone), row, "left_anti").drop(row)
