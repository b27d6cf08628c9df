"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: 64 bits over the 3-word shingles of a text (lower case A-Z, words
between ASCII white space). Bit i is 1 if it is set in over half of the shingles'
XXH64 hashes.

Linking finds every pair of distinct fingerprints at most `tau` bits apart:

1. Equal fingerprints collapse to one class with the smallest id.
2. The 64 bits are grouped into `m` parts, correlated bits together, from the bit
   covariance over all classes (a 64 x 64 sum).
3. If the thresholds t_1..t_m of the parts sum to tau - m + 1, two fingerprints
   within tau agree within t_i on some part i (t_i = -1 asks nothing of a part). For
   each fingerprint the thresholds are chosen by dynamic programming on the number
   of candidates that each part would bring at each threshold. The estimates come
   from histograms of parts folded to 16 bits, which bound their size.
4. Every class is indexed by its m part values; it probes the values within its
   thresholds, and candidates are verified on all 64 bits.

A part value shared by many classes is split into blocks that meet pairwise, each
pair of blocks in a place of its own. Within such a place a search from member to
member yields a spanning forest of the links, so that a dense group of g classes
costs at most g links instead of g^2; connectivity is exactly that of all links.

Components: each class takes the smallest label among itself and its neighbours and
then its label's label, until nothing changes; each round is a written table.

Defined results: null, empty and blank texts have fingerprint zero and link like any
other. Ids may repeat. A null id is returned with its fingerprint's class; labels are
the smallest non-null id. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from panelkit.llm.frames import parts as partitions, text_or_empty
from panelkit.llm.graph import components
from panelkit.operators.rows import small_side
from panelkit.session import materialize

TAU, BITS, SEED = 3, 64, 42
# Classes of one part value that are compared in one place.
BLOCK = 4096
# Leading bits of a part that its histogram tells apart.
FOLD = 16
# Comparisons that cost as much as sending one probe.
COMPARISONS_PER_PROBE = 50.0
# Up to this many comparisons, small places are verified together; larger ones one by one.
SMALL = 1024


# --- fingerprints ----------------------------------------------------------------


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of one text over `width`-word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[width - 1:] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist())), np.uint64, len(last)
    )
    set_bits = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):  # bounds the unpacked bits of a long text
        part = hashes[i:i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""
    @F.pandas_udf(T.LongType())
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts)).view(np.int64))

    return docs.select(F.col(doc_id).alias("doc_id"), prints(text_or_empty(text)).alias("fp"))


# --- parts and thresholds -----------------------------------------------------------


def bit_matrix(fp: np.ndarray) -> np.ndarray:
    """(n, 64) of 0/1, bit 63 first."""
    return np.unpackbits(fp.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def co_occurrence(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of classes and the 64 x 64 matrix of how often two bits are both 1."""
    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for f in frames:
            x = bit_matrix(f.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            total += x.T @ x
            n += len(x)
        at = np.arange(BITS * BITS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["at", "n"])

    rows = classes.select("fp").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["at"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits (0 = highest) in m parts of nearly equal size, correlated bits together.

    Greedy: a part starts with the free bit of least entropy and takes the free bit
    most correlated with what it holds.
    """
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    corr = np.abs(cov / np.outer(sd, sd))
    free, out = list(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        part = [min(free, key=lambda b: (sd[b], b))]
        free.remove(part[0])
        while len(part) < size:
            best = max(free, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            free.remove(best)
        out.append(sorted(part))
    return out


def part_values(fp: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    """(n, m) part values as numbers."""
    x = bit_matrix(fp).astype(np.int64)
    return np.stack([x[:, p] @ (1 << np.arange(len(p) - 1, -1, -1, dtype=np.int64)) for p in parts], axis=1)


def folded_histograms(classes: DataFrame, parts: list[list[int]]) -> np.ndarray:
    """(m, 2^FOLD) counts of each part's first FOLD bits: size bounded whatever the data."""
    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = np.zeros((len(parts), 1 << FOLD), np.int64)
        for f in frames:
            v = part_values(f.column(0).to_numpy(zero_copy_only=False), parts)
            for k, p in enumerate(parts):
                hist[k] += np.bincount(v[:, k] >> max(0, len(p) - FOLD), minlength=1 << FOLD)
        at = np.flatnonzero(hist.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(hist.ravel()[at])], ["at", "n"])

    sums = classes.select("fp").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    got = sums.toPandas()
    flat = np.zeros(len(parts) << FOLD, np.int64)
    flat[got["at"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return flat.reshape(len(parts), -1)


def ball_counts(hist: np.ndarray, radius: int) -> np.ndarray:
    """(radius + 1, 2^FOLD): how many lie within 0..radius flipped bits of each value."""
    shells = [hist.astype(np.float64)] + [np.zeros(hist.shape) for _ in range(radius)]
    index = np.arange(hist.size)
    for b in range(FOLD):  # each bit is flipped once or not
        flipped = index ^ (1 << b)
        for r in range(radius, 0, -1):
            shells[r] = shells[r] + shells[r - 1][flipped]
    return np.cumsum(np.stack(shells), axis=0)


def thresholds(estimates: list[np.ndarray], tau: int = TAU) -> np.ndarray:
    """(n, m) thresholds of least estimated candidates that sum to tau - m + 1.

    `estimates[i]` is (n, top + 2): cost of part i at thresholds -1..top. Dynamic
    programming over the parts, for all rows at once.
    """
    m, n = len(estimates), len(estimates[0])
    budget = tau - m + 1 + m  # each threshold counted from -1
    best = np.full((n, budget + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((m, n, budget + 1), np.int8)
    for i, cost in enumerate(estimates):
        nxt = np.full_like(best, np.inf)
        for t in range(min(cost.shape[1], budget + 1)):
            with_t = np.full_like(best, np.inf)
            with_t[:, t:] = best[:, :budget + 1 - t] + cost[:, t:t + 1]
            better = with_t < nxt
            nxt[better] = with_t[better]
            choice[i][better] = t
        best = nxt
    out, left = np.zeros((n, m), np.int64), np.full(n, budget)
    for i in range(m - 1, -1, -1):
        out[:, i] = choice[i, np.arange(n), left]
        left -= out[:, i]
    return out - 1


def estimates(values: np.ndarray, parts: list[list[int]], balls: np.ndarray, top: int) -> list[np.ndarray]:
    """Per part (rows, top + 2): probes plus weighted expected candidates at thresholds -1..top.

    Bits beyond the histogram are taken to halve the candidates at half their number.
    """
    out = []
    for k, p in enumerate(parts):
        rest = max(0, len(p) - FOLD)
        cost = np.zeros((len(values), top + 2))
        probes = 0
        for t in range(top + 1):
            probes += math.comb(len(p), t)
            cost[:, t + 1] = balls[k, t, values[:, k] >> rest] / 2.0 ** (rest / 2) / COMPARISONS_PER_PROBE + probes
        out.append(cost)
    return out


def expected_cost(hist: np.ndarray, balls: np.ndarray, parts: list[list[int]], tau: int) -> float:
    """Mean cost per class if every class took the allocation that is best on average."""
    top = tau - len(parts) + 1
    mean = []
    for k, p in enumerate(parts):
        weight = hist[k] / max(1, hist[k].sum())
        rest = max(0, len(p) - FOLD)
        probes = np.cumsum([math.comb(len(p), t) for t in range(top + 1)])
        mean.append(np.concatenate(([0.0], balls[k] @ weight / 2.0 ** rest / COMPARISONS_PER_PROBE + probes))[None, :])
    best = thresholds(mean, tau)[0]
    return float(sum(c[0, t + 1] for c, t in zip(mean, best)))


def flips(width: int, radius: int) -> list[np.ndarray]:
    """Masks of exactly 0, 1, .. radius set bits."""
    out, last = [np.zeros(1, np.int64)], [(0, -1)]
    for _ in range(radius):
        last = [(mask | 1 << b, b) for mask, top in last for b in range(top + 1, width)]
        out.append(np.array([mask for mask, _ in last], np.int64))
    return out


class Plan:
    """Parts of the bits and what the choice of thresholds needs: a few MB, whatever the data."""

    def __init__(self, classes: DataFrame, tau: int = TAU):
        n, both = co_occurrence(classes)
        self.tau, options = tau, []
        # Fewer, wider parts need more probes and bring fewer candidates.
        for m in range(2, min(3, tau) + 1) if tau >= 2 else (1 + tau,):
            parts = group_bits(n, both, m)
            hist = folded_histograms(classes, parts)
            balls = np.stack([ball_counts(h, tau - m + 1) for h in hist])
            options.append((expected_cost(hist, balls, parts, tau), m, parts, balls))
        self.cost, self.m, self.parts, self.balls = min(options, key=lambda o: o[:2])
        self.top = tau - self.m + 1
        self.masks = [flips(len(p), self.top) for p in self.parts]

    def keys(self, fp: np.ndarray) -> np.ndarray:
        """(n, m): part number and value in one number."""
        return part_values(fp, self.parts) | (np.arange(self.m, dtype=np.int64) << 48)

    def probes(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, row) of everything that each fingerprint looks up."""
        values = part_values(fp, self.parts)
        allowed = thresholds(estimates(values, self.parts, self.balls, self.top), self.tau)
        keys, rows = [], []
        for k in range(self.m):
            for t in range(self.top + 1):
                who = np.flatnonzero(allowed[:, k] >= t)
                mask = self.masks[k][t]
                keys.append(((values[who, k][:, None] ^ mask) | (k << 48)).ravel())
                rows.append(np.repeat(who, len(mask)))
        return np.concatenate(keys), np.concatenate(rows)


# --- links ----------------------------------------------------------------------------


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def links(classes: DataFrame, tau: int = TAU, block: int = BLOCK) -> DataFrame:
    """(a, b): links between fingerprints of `classes` (fp, distinct) that connect all that are within `tau`."""
    plan = Plan(classes, tau)

    def index(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            yield pa.RecordBatch.from_arrays([pa.array(plan.keys(_numbers(f, "fp")).ravel())], ["key"])

    def lookups(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            fp = _numbers(f, "fp")
            own = plan.keys(fp)
            keys, rows = plan.probes(fp)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(own.ravel(), keys)), pa.array(np.append(np.repeat(fp, plan.m), fp[rows])),
                 pa.array(np.repeat(np.array([0, 1], np.int8), [own.size, len(keys)]))],
                ["key", "fp", "probe"],
            )

    one = classes.select("fp")
    hot = materialize(
        one.mapInArrow(index, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
        .select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")),
        "simhash-hot",
    )
    rows = one.mapInArrow(lookups, "key long, fp long, probe byte").join(small_side(hot), "key", "left")
    # An indexed fingerprint lies in one block of its value; a probe looks into each.
    own = F.pmod(F.xxhash64("fp"), F.coalesce(F.col("blocks"), F.lit(1))).cast("int")
    places = rows.withColumn(
        "block",
        F.explode(F.when(F.col("probe") == 0, F.array(own)).otherwise(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))),
    ).select("key", "block", "probe", "fp")
    spread = places.repartition(partitions(classes.sparkSession), "key", "block").sortWithinPartitions("key", "block", "probe")
    return spread.mapInArrow(lambda frames: _verify(frames, tau), "a long, b long")


def _verify(frames: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    """Links of each place (key, block): its indexed rows come first, then its probes.

    Only the indexed rows of the place at a batch's end are carried over, so a place
    with any number of probes is read in batches.
    """
    place, kept = None, np.zeros(0, np.int64)
    for f in frames:
        key, block = _numbers(f, "key"), _numbers(f, "block").astype(np.int64)
        fp, probe = _numbers(f, "fp"), _numbers(f, "probe").astype(bool)
        if not len(key):
            continue
        if len(kept):
            key = np.append(np.full(len(kept), place[0]), key)
            block = np.append(np.full(len(kept), place[1]), block)
            fp, probe = np.append(kept, fp), np.append(np.zeros(len(kept), bool), probe)
        cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
        first, last = np.append(0, cut), np.append(cut, len(key))
        indexed = np.add.reduceat((~probe).astype(np.int64), first)
        probes = last - first - indexed
        place, kept = (key[-1], block[-1]), fp[first[-1]:first[-1] + indexed[-1]]
        work = indexed * probes
        few = np.flatnonzero((work > 0) & (work <= SMALL))
        found = [_all_links(fp, first[few], indexed[few], probes[few], tau)]
        found += [
            _forest(fp[first[i]:first[i] + indexed[i]], fp[first[i] + indexed[i]:last[i]], tau)
            for i in np.flatnonzero(work > SMALL)
        ]
        a, b = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _near(a: np.ndarray, b: np.ndarray, tau: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= tau


def _all_links(fp, first, indexed, probes, tau) -> tuple[np.ndarray, np.ndarray]:
    """Links of many small places at once, each from the larger fingerprint to the smaller."""
    pairs = indexed * probes
    of = np.repeat(np.arange(len(pairs)), pairs)
    within = np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    left = fp[first[of] + indexed[of] + within // np.maximum(indexed[of], 1)]
    right = fp[first[of] + within % np.maximum(indexed[of], 1)]
    hit = (left > right) & _near(left, right, tau)
    return left[hit], right[hit]


def _forest(index: np.ndarray, probes: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one place that connect what all its links connect: at most one per probe and indexed row."""
    a, b = [], []
    label = np.arange(len(index))
    step = max(1, (1 << 21) // len(index))
    for i in range(0, len(probes), step):
        some = probes[i:i + step]
        near = _near(some[:, None], index[None, :], tau)
        some, near = some[near.any(axis=1)], near[near.any(axis=1)]
        if not len(some):
            continue
        lead = near.argmax(axis=1)
        a.append(some)
        b.append(index[lead])
        while True:  # a probe that sees several trees of the index joins two
            low = np.where(near, label, len(index)).min(axis=1)
            high = np.where(near, label, -1).max(axis=1)
            r = int(np.argmax(low < high))
            if low[r] >= high[r]:
                break
            trees = np.unique(label[near[r]])
            for tree in trees[trees != label[lead[r]]]:
                a.append(some[r:r + 1])
                b.append(index[np.flatnonzero(near[r] & (label == tree))[:1]])
            label[np.isin(label, trees)] = low[r]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    return a[a != b], b[a != b]


# --- the operator -------------------------------------------------------------------------


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tau: int = TAU) -> DataFrame:
    """Per row: doc_id, fp, component_id (the smallest id reachable over links of `tau` bits or fewer)."""
    prints = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    label = components(links(classes, tau))
    linked = materialize(
        label.withColumnRenamed("node", "fp").join(classes, "fp").select("fp", "label", "least"), "simhash-linked"
    )
    whole = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    groups = linked.join(whole, "label").select("fp", "component_id")
    by_class = classes.join(groups, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(by_class, "fp").select("doc_id", "fp", "component_id")


def near_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, width: int = 3, tau: int = TAU) -> DataFrame:
    """(a, b): pairs of ids, unique and not null, that connect all rows whose fingerprints lie within `tau` bits."""
    prints = materialize(fingerprints(docs, doc_id, text, width), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    equal = prints.join(classes, "fp").filter("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    x, y = (classes.select(F.col("fp").alias(t), F.col("least").alias(f"least_{t}")) for t in "ab")
    near = links(classes, tau).distinct().join(x, "a").join(y, "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    return materialize(equal.unionByName(near), "simhash-pairs")
