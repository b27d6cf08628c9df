"""Nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A vector's direction is turned by a pseudo-random rotation (three rounds of random
signs and a fast Hadamard transform, padded to a power of two); its hash is the
nearest signed axis: the coordinate of largest absolute value, and its sign. `tables`
independent rotations (pairs of them, joined, where one axis would hold more than
`ROWS_PER_BUCKET` rows on average) index every row. A query probes, per table, the
signed axes on which its own rotated coordinates are largest.

The number of probes is measured, not guessed: the true neighbours of a bounded
sample of queries, found against all rows in blocks, tell how far down the probing
order each lies, and the least number of probes that finds `recall` of them is used.

Rows and probes meet by (table, bucket). A bucket of more than `BLOCK` rows, such as
one common vector's, is split into blocks, each of which its probes visit. There the
inner products of all candidates are compared; the best `k` of each place travel,
and the best of those stay. Queries left with fewer than `k` results although more
rows exist probe every bucket.

Defined results: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part, nor do null ids. A query never finds its
own id. Scores add products in order of components in double precision, so equal
vectors tie exactly, and ties go to smaller ids. Rows that repeat an id count once,
with their largest score. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelkit.llm.frames import parts
from panelkit.operators.rows import small_side
from panelkit.session import materialize

TABLES, RECALL, SAMPLE = 2, 0.96, 256
ROWS_PER_BUCKET, BLOCK = 65_536, 4096
SEED = 20


# --- hashing ---------------------------------------------------------------------------


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        a, b = y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]
        x = np.stack([a, b], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class Hashing:
    """Rotations of `tables` tables with `folds` axes each, from a seed."""

    def __init__(self, dim: int, tables: int, folds: int, seed: int = SEED) -> None:
        self.dim, self.tables, self.folds = dim, tables, folds
        self.size = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, folds, 3, self.size))
        self.buckets = (2 * self.size) ** folds

    def scores(self, vectors: np.ndarray, table: int) -> list[np.ndarray]:
        """Per fold (n, 2 size): how near each signed axis is; axis a is column 2a, its opposite 2a + 1."""
        x = np.zeros((len(vectors), self.size))
        x[:, :self.dim] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        out = []
        for fold in range(self.folds):
            y = x
            for signs in self.signs[table, fold]:
                y = hadamard(y * signs)
            out.append(np.stack([y, -y], axis=2).reshape(len(x), -1))
        return out

    def bucket(self, vectors: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(vectors), np.int64)
        for s in self.scores(vectors, table):
            out = out * s.shape[1] + s.argmax(axis=1)
        return out

    def order(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """(n, buckets) of nearness, for probing: the sum over folds."""
        first, *rest = self.scores(vectors, table)
        for s in rest:
            first = (first[:, :, None] + s[:, None, :]).reshape(len(first), -1)
        return first

    def probes(self, vectors: np.ndarray, table: int, n: int) -> np.ndarray:
        """(rows, n) nearest buckets."""
        near = self.order(vectors, table)
        if n >= near.shape[1]:
            return np.tile(np.arange(near.shape[1]), (len(vectors), 1))
        return np.argpartition(-near, n - 1, axis=1)[:, :n]


# --- exact comparison ----------------------------------------------------------------------


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added in order of components."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def nearest(ids: np.ndarray, q: np.ndarray, cand_ids: np.ndarray, cand: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of cand, score) of each query's `k` best, by query, best first, ties to smaller ids."""
    s = q @ cand.T
    s[ids[:, None] == cand_ids[None, :]] = -np.inf
    if s.shape[1] > k:
        # Matrix products round by position: keep whatever could tie with the k-th.
        least = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
        slack = 1e-12 * (1 + np.linalg.norm(q, axis=1) * np.linalg.norm(cand, axis=1).max(initial=0.0))
        keep = (s >= (least - slack)[:, None]) & (s > -np.inf)
    else:
        keep = s > -np.inf
    row, col = np.nonzero(keep)
    exact = products(q[row], cand[col])
    order = np.lexsort((cand_ids[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    first = np.searchsorted(row, row)
    best = np.arange(len(row)) - first < k
    return row[best], col[best], exact[best]


def _vectors(f: pa.RecordBatch, name: str = "vector") -> np.ndarray:
    column = f.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _ids(f: pa.RecordBatch, name: str = "id") -> np.ndarray:
    return f.column(name).to_numpy(zero_copy_only=False)


# --- the operator --------------------------------------------------------------------------


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector")).filter(
        F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", fine) & F.exists("vector", lambda x: x != 0)
    )
    usual = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return rows.filter(F.size("vector") == (usual["n"] if usual else -1))


def measured_probes(rows: DataFrame, hashing: Hashing, query: Column, n_queries: int, k: int, recall: float, sample: int) -> int:
    """Least number of probes per table that finds `recall` of the sampled queries' true neighbours."""
    share = min(1.0, 2.0 * sample / max(1, n_queries))
    hashed = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    got = rows.filter(query & (hashed < share)).limit(sample).collect()
    if not got:
        return 1
    ids = np.array([r["id"] for r in got])
    q = np.array([r["vector"] for r in got], np.float64)

    def best(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_ids, keep = np.zeros(0, np.int64), np.zeros((0, q.shape[1]))
        found = None
        for f in frames:
            cand_ids, cand = _ids(f), _vectors(f)
            row, col, score = nearest(ids, q, cand_ids, cand, k)
            mine = (row, cand_ids[col], score, cand[col])
            if found is not None:
                mine = tuple(np.concatenate([a, b]) for a, b in zip(found, mine))
            order = np.lexsort((mine[1], -mine[2], mine[0]))
            mine = tuple(m[order] for m in mine)
            top = np.arange(len(mine[0])) - np.searchsorted(mine[0], mine[0]) < k
            found = tuple(m[top] for m in mine)
        if found is None:
            return
        need = np.full(len(found[0]), hashing.buckets)
        for t in range(hashing.tables):
            near = hashing.order(q, t)[found[0]]
            own = near[np.arange(len(need)), hashing.bucket(found[3], t)]
            need = np.minimum(need, (near > own[:, None]).sum(axis=1) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(found[2]), pa.array(need)], ["q", "id", "score", "need"])

    near = rows.mapInArrow(best, "q long, id long, score double, need long").toPandas()
    near = near.sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q").head(k)
    return int(np.quantile(near["need"], recall, method="higher")) if len(near) else 1


def search_buckets(rows: DataFrame, queries: DataFrame, hashing: Hashing, probes: int, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, near): each query's best candidates of each place, as arrays of (loss, id)."""
    def index(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            v = _vectors(f)
            for t in range(hashing.tables):
                key = t * hashing.buckets + hashing.bucket(v, t)
                yield pa.RecordBatch.from_arrays([pa.array(key), f.column("id"), f.column("vector")], ["key", "id", "vector"])

    def probe(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for i in range(0, len(f), 1024):
                part = f.slice(i, 1024)
                v = _vectors(part)
                for t in range(hashing.tables):
                    keys = t * hashing.buckets + hashing.probes(v, t, probes)
                    at = pa.array(np.repeat(np.arange(len(v)), keys.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), part.column("id").take(at), part.column("vector").take(at)], ["key", "id", "vector"])

    schema = f"key long, id long, vector {rows.schema['vector'].dataType.simpleString()}"
    hot = materialize(
        rows.mapInArrow(index, schema).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
        .select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")),
        "ann-hot",
    )
    both = rows.mapInArrow(index, schema).withColumn("probe", F.lit(0).cast("byte")).unionByName(
        queries.mapInArrow(probe, schema).withColumn("probe", F.lit(1).cast("byte"))
    )
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    places = both.join(small_side(hot), "key", "left").withColumn(
        "block", F.explode(F.when(F.col("probe") == 0, F.array(own)).otherwise(F.sequence(F.lit(0), blocks - 1)))
    ).drop("blocks")
    spread = places.repartition(parts(rows.sparkSession), "key", "block").sortWithinPartitions("key", "block", "probe")
    return spread.mapInArrow(lambda frames: _compare(frames, k), "query_id long, near array<struct<loss:double,id:bigint>>")


def _compare(frames: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each place's probes against its rows; rows of a place come first and are all that is carried over."""
    place, kept_ids, kept = None, np.zeros(0, np.int64), None
    for f in frames:
        key, block, probe = _ids(f, "key"), _ids(f, "block").astype(np.int64), _ids(f, "probe").astype(bool)
        ids, v = _ids(f), _vectors(f)
        if not len(key):
            continue
        if len(kept_ids):
            key = np.append(np.full(len(kept_ids), place[0]), key)
            block = np.append(np.full(len(kept_ids), place[1]), block)
            probe, ids, v = np.append(np.zeros(len(kept_ids), bool), probe), np.append(kept_ids, ids), np.concatenate([kept, v])
        cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
        found: list[tuple] = []
        for a, b in zip(np.append(0, cut), np.append(cut, len(key))):
            m = a + int((~probe[a:b]).sum())
            place, kept_ids, kept = (key[a], block[a]), ids[a:m], v[a:m]
            for i in range(m, b if m > a else m, 512):
                some = slice(i, min(i + 512, b))
                row, col, score = nearest(ids[some], v[some], kept_ids, kept, k)
                found.append((ids[some][row], score, kept_ids[col], row + i))
        if found:
            query, score, near, group = (np.concatenate(x) for x in zip(*found))
            starts = np.append(0, np.flatnonzero(np.diff(group) != 0) + 1) if len(group) else np.zeros(0, np.int64)
            values = pa.StructArray.from_arrays([pa.array(-score), pa.array(near)], ["loss", "id"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(group)), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([pa.array(query[starts]), lists], ["query_id", "near"])


def _best(found: DataFrame, k: int) -> DataFrame:
    """The `k` best of each query over all places; an id that several places found counts once."""
    by_id = F.array_sort(F.transform(F.flatten(F.collect_list("near")), lambda x: F.struct(x["id"].alias("id"), x["loss"].alias("loss"))))
    every = found.groupBy("query_id").agg(by_id.alias("all"))
    once = F.filter("all", lambda x, i: (i == 0) | (x["id"] != F.get(F.col("all"), i - 1)["id"]))
    ranked = F.array_sort(F.transform(once, lambda x: F.struct(x["loss"].alias("loss"), x["id"].alias("id"))))
    return every.select("query_id", F.slice(ranked, 1, k).alias("near"))


def search(
    vectors: DataFrame, query: Column, vec_id: str = "vec_id", vector: str = "embedding", *, k: int = 20, tables: int = TABLES,
    recall: float = RECALL, sample: int = SAMPLE,
) -> DataFrame:
    """Per query (rows where `query`, a condition on id, holds) its `k` nearest found: query_id, rank, vec_id, score."""
    rows = materialize(usable(vectors, vec_id, vector), "ann-vectors")
    size = rows.agg(F.count_distinct("id").alias("n"), F.count_if(query).alias("q"), F.max(F.size("vector")).alias("dim")).first()
    dim = size["dim"] or 1
    folds = 1 if size["n"] <= ROWS_PER_BUCKET * 2 * dim else 2
    hashing = Hashing(dim, tables, folds)
    probes = measured_probes(rows, hashing, query, size["q"], k, recall, sample)
    queries = rows.filter(query)
    near = materialize(_best(search_buckets(rows, queries, hashing, probes, k), k), "ann-near")
    expected = min(k, max(0, size["n"] - 1))
    whole = near.filter(F.size("near") >= expected)
    # Queries short of results look everywhere.
    short = queries.join(whole.select(F.col("query_id").alias("id")), "id", "left_anti")
    if probes < hashing.buckets and expected and not short.isEmpty():
        near = whole.unionByName(_best(search_buckets(rows, short, hashing, hashing.buckets, k), k))
    return near.select("query_id", F.posexplode("near").alias("at", "n")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), (-F.col("n.loss")).alias("score")
    )
