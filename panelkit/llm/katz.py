"""Katz backoff bigram model with Good-Turing discounts.

For a word w after a context v (the previous word, or the begin of the text):

    P(w | v) = d(c(vw)) c(vw) / c(v)            if vw was seen
             = alpha(v) P(w)                    if only v was seen
             = P(w)                             otherwise
    P(w)     = d'(c(w)) c(w) / N, and the rest for the unknown word

d and d' are Good-Turing discounts for counts up to `K`; larger counts lose `DELTA`,
so that every context keeps some mass. alpha(v) is that mass over the unigram mass of
what v hasn't seen: probabilities after each context add up to one exactly.

How it runs. Counting n-grams word by word would send each token several times.
Instead tasks turn their documents into chunks of a million tokens or so, and a chunk
sends each of its distinct words and bigrams once, packed per bucket:

1. Chunks (documents, word ids) are written as a table bucketed by chunk, so that
   later joins on the chunk move the answers only.
2. Word buckets add up the training counts of all chunks, write the unigram table and
   answer each chunk with its words' numbers and counts.
3. Bigram buckets (the bucket of the first word) do the same for bigrams, and sum what
   alpha needs per context. A context with more tokens than an average bucket is
   spread over as many pieces as it holds buckets' worth; there are at most as many
   such contexts as buckets, and their sums are joined apart.
4. Chunks look up every token and add up scores per document.

Buckets follow the size of the corpus, so neither a bucket nor a chunk grows with it.

Defined results: null and blank texts have one token, the end. Ids may repeat and be
null (a null id counts as the empty text in the hash). Without training rows every
token is unknown and has probability one. Empty tables give empty results. Other
columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from panelkit.llm.frames import parts
from panelkit.session import materialize, work_path

K, DELTA = 5, 0.05
# No word holds white space: names of the end and the begin of a text.
END, BEGIN = b" ", b"\t"
CHUNK_TOKENS = 800_000
BUCKET_BYTES = 12_000_000
MOST_TASKS = 20_000
LOW = 40  # bits of a word number in a bigram key


# --- packing ---------------------------------------------------------------------------


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Non-negative whole numbers in the least width, bytes by place, compressed."""
    v = np.asarray(values, np.uint64)
    if ascending and len(v):
        v = np.append(v[:1], np.diff(v))
    top = int(v.max()) if len(v) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    planes = np.ascontiguousarray(v.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes, ascending: bool = False) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    v = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)
    return np.cumsum(v) if ascending else v


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    text = zstandard.ZstdDecompressor().decompress(data)
    return text.split(b"\n") if text else []


# --- discounts -------------------------------------------------------------------------


@dataclass(frozen=True)
class Discounts:
    """d(r) for r = 0..K and the loss of larger counts."""

    small: tuple[float, ...]

    @staticmethod
    def good_turing(counts_of: list[int]) -> Discounts:
        """From n_1 .. n_{K+1}. The largest cut-off up to K with discounts inside (0, 1)
        is used; where there is none, counts up to K lose a half each."""
        n = [0, *counts_of]
        for k in range(K, 0, -1):
            if min(n[1:k + 2]) <= 0:
                continue
            a = (k + 1) * n[k + 1] / n[1]
            d = [((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if a != 1 else 0.0 for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return Discounts((1.0, *d, *(1 - DELTA / r for r in range(k + 1, K + 1))))
        return Discounts((1.0, *((r - 0.5) / r for r in range(1, K + 1))))

    def of(self, c: np.ndarray) -> np.ndarray:
        c = np.asarray(c)
        small = np.asarray(self.small)[np.minimum(c, K)]
        return np.where(c <= K, small, 1 - DELTA / np.maximum(c, 1))

    def lost(self, types: np.ndarray) -> np.ndarray:
        """Count mass taken from types: columns n_1..n_K and the number of larger ones."""
        r = np.arange(1, K + 1)
        return types[..., :K] @ (r * (1 - np.asarray(self.small[1:]))) + types[..., K] * DELTA


@dataclass(frozen=True)
class Unigrams:
    """N, V, the words' discounts and the count mass that they lose to the unknown word."""

    total: int
    distinct: int
    discounts: Discounts
    lost: float

    def probability(self, c: np.ndarray) -> np.ndarray:
        """P(w) by training count; count 0 is the unknown word."""
        if not self.total:
            return np.ones(len(c))
        return np.where(c > 0, self.discounts.of(c) * c, self.lost) / self.total

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def type_counts(c: np.ndarray) -> list[int]:
    """n_1 .. n_{K+1} and the number of types with more than K."""
    n = np.bincount(np.minimum(c, K + 2), minlength=K + 3).tolist()
    return [*n[1:K + 2], n[K + 1] + n[K + 2]]


# --- chunks ------------------------------------------------------------------------------


class Ids(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Building:
    ids: Ids = field(default_factory=lambda: Ids({END: 0, BEGIN: 1}))
    docs: list = field(default_factory=list)
    train: list[bool] = field(default_factory=list)
    tokens: list[np.ndarray] = field(default_factory=list)
    size: int = 0

    def add(self, doc, train: bool, text: bytes) -> None:
        words = text.lower().split()
        words.append(END)
        self.tokens.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.docs.append(doc)
        self.train.append(train)
        self.size += len(words)


def build_chunks(docs: DataFrame, doc_id: str, text: str, train: Column, buckets: int) -> DataFrame:
    """(chunk, doc_ids, train, sizes, buckets it has words of, those words, tokens): local words are numbered by bucket, then by bytes."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), train.alias("train"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text")
    )
    kind = rows.schema["doc_id"].dataType
    arrow_kind = pa.string() if kind.simpleString() == "string" else pa.int64()

    def finish(b: Building, number: int) -> pa.RecordBatch:
        words = list(b.ids)
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = sorted(range(len(words)), key=lambda i: (bucket[i], words[i]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        home, cut = np.unique(bucket[order], return_index=True)
        in_order = [words[i] for i in order]
        blobs = [pack_words(in_order[a:b]) for a, b in zip(cut, [*cut[1:], len(order)])]
        row = {
            "chunk": [TaskContext.get().partitionId() << 32 | number], "doc_ids": pa.array([b.docs], pa.list_(arrow_kind)),
            "train": [b.train], "sizes": [list(map(len, b.tokens))], "buckets": [home.tolist()], "words": [blobs], "tokens": [pack(place[np.concatenate(b.tokens)])],
        }
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([
            ("chunk", pa.int64()), ("doc_ids", pa.list_(arrow_kind)), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())),
            ("buckets", pa.list_(pa.int32())), ("words", pa.list_(pa.binary())), ("tokens", pa.binary())]))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, number = Building(), 0
        for f in frames:
            for doc, flag, body in zip(*(f.column(i).to_pylist() for i in range(3))):
                b.add(doc, flag, body)
                if b.size >= CHUNK_TOKENS:
                    yield finish(b, number)
                    b, number = Building(), number + 1
        if b.docs:
            yield finish(b, number)

    schema = (
        f"chunk long, doc_ids array<{'string' if arrow_kind == pa.string() else 'long'}>, train array<boolean>, "
        "sizes array<int>, buckets array<int>, words array<binary>, tokens binary"
    )
    return rows.mapInArrow(run, schema)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """`df` as files bucketed by `key` below the shared folder: joins on it move the other side only.

    The catalog entry that bucketing needs goes at once; the files go with the other intermediate tables.
    """
    spark = df.sparkSession
    name = f"panelkit_{uuid.uuid4().hex}"
    df.write.bucketBy(parts(spark), key).format("parquet").option("path", work_path(spark, "bucketed")).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _rows(f: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one in memory at a time."""
    for i in range(len(f)):
        yield f.slice(i, 1).to_pylist()[0]


class Chunk:
    """A chunk's tokens with what its documents need."""

    def __init__(self, row: dict) -> None:
        self.tokens = unpack(row["tokens"])
        self.sizes = np.asarray(row["sizes"], np.int64)
        self.train = np.repeat(np.asarray(row["train"], bool), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def bigrams(self, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (local context, local word), each token's place among them, training counts."""
        before = np.roll(self.tokens, 1)
        before[self.starts] = begin
        distinct, place = np.unique(before << 32 | self.tokens, return_inverse=True)
        counts = np.bincount(place, weights=self.train, minlength=len(distinct)).astype(np.int64)
        return distinct >> 32, distinct & 0xFFFFFFFF, place, counts


# --- words -----------------------------------------------------------------------------


def spread_out(requests: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """Tasks follow the number of buckets, not a session setting."""
    return requests.repartition(max(parts(requests.sparkSession), min(buckets, MOST_TASKS)), *keys)


def word_requests(chunks: DataFrame) -> DataFrame:
    """(bucket, chunk, words, counts): each chunk's words with their training counts."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for row in _rows(f):
                c = Chunk(row)
                counts = np.bincount(c.tokens[c.train], minlength=1)
                at, out = 0, []
                begins = int(sum(row["train"]))
                for bucket, blob in zip(row["buckets"], row["words"]):
                    words = unpack_words(blob)
                    own = np.zeros(len(words), np.int64)
                    have = counts[at:at + len(words)]
                    own[:len(have)] = have
                    if BEGIN in words:
                        own[words.index(BEGIN)] = begins
                    at += len(words)
                    if words:
                        out.append((bucket, row["chunk"], blob, pack(own)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                    ["bucket", "chunk", "words", "counts"])

    return chunks.select("chunk", "train", "sizes", "buckets", "words", "tokens").mapInArrow(run, "bucket int, chunk long, words binary, counts binary")


def merge_words(requests: DataFrame, buckets: int) -> DataFrame:
    """Per bucket the unigram table (kind 'table') and an answer per chunk (kind 'answer'): numbers and counts."""
    def run(key, table):
        bucket, total = key[0].as_py(), {}
        asked = [(unpack_words(w), unpack(c)) for w, c in zip(table["words"].to_pylist(), table["counts"].to_pylist())]
        for words, counts in asked:
            for w, c in zip(words, counts.tolist()):
                total[w] = total.get(w, 0) + c
        order = sorted(total, key=lambda w: (-total[w], w))
        number = {w: i for i, w in enumerate(order)}
        real = np.array([total[w] for w in order if w != BEGIN], np.int64)
        seen = real[real > 0]
        rows = [(
            "table", bucket, None, pack_words(order), pack(np.array([total[w] for w in order])),
            [int(seen.sum()), len(seen), total.get(BEGIN, 0), *type_counts(seen)],
        )]
        for chunk, (words, _) in zip(table["chunk"].to_pylist(), asked):
            ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            counts = np.fromiter(map(total.__getitem__, words), np.int64, len(words))
            rows.append(("answer", bucket, chunk, pack(ids * buckets + bucket), pack(counts), None))
        return _table(rows)

    return spread_out(requests, buckets, "bucket").groupBy("bucket").applyInArrow(run, ANSWER)


ANSWER = "kind string, bucket int, chunk long, a binary, b binary, sizes array<long>"


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.Table.from_arrays(
        [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], ["kind", "bucket", "chunk", "a", "b", "sizes"])


def summed(answers: DataFrame, n: int) -> list[int]:
    row = answers.filter("kind = 'table'").agg(*[F.sum(F.col("sizes")[i]).alias(f"s{i}") for i in range(n)]).first()
    return [int(x or 0) for x in row]


def by_chunk(answers: DataFrame, *order: str) -> DataFrame:
    """(chunk, answers): a chunk's answers, as many as it asked for, in `order`."""
    return (
        answers.groupBy("chunk")
        .agg(F.sort_array(F.collect_list(F.struct(*order, "a", "b"))).alias("answers"))
    )


# --- bigrams -----------------------------------------------------------------------------


def _word_answers(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Number and count of each local word, in local order."""
    got = row["answers"]
    return np.concatenate([unpack(x["a"]) for x in got]), np.concatenate([unpack(x["b"]) for x in got])


def _begin(row: dict, buckets: int) -> int:
    """Local number of the begin: words are in order of bucket, then bytes."""
    home, at = zlib.crc32(BEGIN) % buckets, 0
    for bucket, blob in zip(row["buckets"], row["words"]):
        words = unpack_words(blob)
        if bucket == home:
            return at + words.index(BEGIN)
        at += len(words)
    raise ValueError("a chunk without a begin")


class Lookup:
    """A chunk's distinct bigrams in the order in which they are asked: bucket, piece, key.

    Piece -1 holds the contexts that fit one bucket; larger ones are spread over pieces
    of their own by the second word.
    """

    def __init__(self, row: dict, uni: Unigrams, buckets: int) -> None:
        self.chunk = Chunk(row)
        numbers, self.counts = _word_answers(row)
        left, right, self.place, trained = self.chunk.bigrams(_begin(row, buckets))
        spread = self.counts[left] * buckets // max(1, uni.total)
        piece = np.where(spread > 0, (numbers[right] * 0x9E3779B1 & 0x7FFFFFFF) % (spread + 1), -1)
        bucket, key = numbers[left] % buckets, numbers[left] // buckets << LOW | numbers[right]
        self.order = np.lexsort((key, piece, bucket))
        self.left, self.right, self.trained = left[self.order], right[self.order], trained[self.order]
        self.bucket, self.piece, self.key = bucket[self.order], piece[self.order], key[self.order]
        self.number = numbers[self.left]
        change = (np.diff(self.bucket) != 0) | (np.diff(self.piece) != 0)
        self.cut = np.append(np.flatnonzero(change) + 1, len(self.key))
        self.first = np.append(0, self.cut[:-1])


def bigram_requests(chunks: DataFrame, uni: Unigrams, buckets: int) -> DataFrame:
    """(bucket, piece, chunk, keys, counts, seconds): distinct bigrams, their training counts, the counts of the second words."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for row in _rows(f):
                x = Lookup(row, uni, buckets)
                second = x.counts[x.right]
                out = [
                    (int(x.bucket[a]), int(x.piece[a]), row["chunk"], pack(x.key[a:b], True), pack(x.trained[a:b]), pack(second[a:b]))
                    for a, b in zip(x.first, x.cut)
                ]
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(zip(*out), kinds)], ["bucket", "piece", "chunk", "keys", "counts", "seconds"])

    return chunks.mapInArrow(run, "bucket int, piece int, chunk long, keys binary, counts binary, seconds binary")


# Per context: n_1..n_K, larger types, the unigram mass of what it has seen.
CONTEXT = K + 2


def context_sums(count: np.ndarray, second: np.ndarray, of: np.ndarray, n: int, uni: Unigrams) -> np.ndarray:
    """(n, CONTEXT), over the seen bigrams of each context."""
    seen = count > 0
    c, of = count[seen], of[seen]
    types = [np.bincount(of[c == r], minlength=n) for r in range(1, K + 1)]
    mass = np.bincount(of, weights=uni.probability(second[seen]), minlength=n)
    return np.stack([*types, np.bincount(of[c > K], minlength=n), mass], axis=1).astype(np.float64)


def merge_bigrams(requests: DataFrame, uni: Unigrams, buckets: int) -> DataFrame:
    """Per bucket and piece: 'table' (keys, counts), an 'answer' per chunk, and 'spread' (contexts, sums) of spread contexts.

    An answer has the chunk's counts and the sums (of spread contexts: the numbers) of the contexts of its unseen
    bigrams, in order of key.
    """
    def run(key, table):
        bucket, piece = key[0].as_py(), key[1].as_py()
        keys = [unpack(x, True) for x in table["keys"].to_pylist()]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        trained = np.concatenate([unpack(x) for x in table["counts"].to_pylist()])
        count = np.bincount(place, weights=trained, minlength=len(distinct)).astype(np.int64)
        second = np.zeros(len(distinct), np.int64)
        second[place] = np.concatenate([unpack(x) for x in table["seconds"].to_pylist()])
        context, of = np.unique(distinct >> LOW, return_inverse=True)
        sums = context_sums(count, second, of, len(context), uni)
        seen = count > 0
        rows = [("table", bucket, piece, None, pack(distinct[seen], True), pack(count[seen]), type_counts(count[seen]))]
        if piece >= 0:
            rows.append(("spread", bucket, piece, None, (context * buckets + bucket).tobytes(), sums.tobytes(), None))
        ends = np.cumsum(list(map(len, keys)))
        for chunk, a, b in zip(table["chunk"].to_pylist(), np.append(0, ends[:-1]), ends):
            own = place[a:b]
            missing = np.unique(of[own[count[own] == 0]])
            # The sums of a spread context are known when its pieces are added up; until then its number stands for them.
            about = sums[missing] if piece < 0 else context[missing] * buckets + bucket
            rows.append(("answer", bucket, piece, chunk, pack(count[own]), about.tobytes(), None))
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.Table.from_arrays(
            [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], ["kind", "bucket", "piece", "chunk", "a", "b", "sizes"])

    return spread_out(requests, buckets, "bucket", "piece").groupBy("bucket", "piece").applyInArrow(
        run, "kind string, bucket int, piece int, chunk long, a binary, b binary, sizes array<long>")


def with_spread_sums(pairs: DataFrame) -> DataFrame:
    """The answers, those about spread contexts with the sums over all pieces in place of the contexts' numbers."""
    names = [f"s{i}" for i in range(CONTEXT)]

    def sums(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for a, b in zip(f.column(0).to_pylist(), f.column(1).to_pylist()):
                part = np.frombuffer(b).reshape(-1, CONTEXT)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(a, np.int64)), *(pa.array(part[:, i]) for i in range(CONTEXT))], ["number", *names])

    def asked(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for chunk, bucket, piece, b in zip(*(c.to_pylist() for c in f.columns)):
                number = np.frombuffer(b, np.int64)
                same = [np.full(len(number), x) for x in (chunk, bucket, piece)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(same[0], pa.int64()), pa.array(same[1], pa.int32()), pa.array(same[2], pa.int32()), pa.array(number)],
                    ["chunk", "bucket", "piece", "number"])

    def packed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            flat = [np.asarray(x or [], np.float64).ravel().tobytes() for x in f.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*f.columns[:4], pa.array(flat, pa.binary())], ["chunk", "bucket", "piece", "a", "b"])

    total = (
        pairs.filter("kind = 'spread'").select("a", "b").mapInArrow(sums, ", ".join(["number long", *(f"{n} double" for n in names)]))
        .groupBy("number").agg(*[F.sum(n).alias(n) for n in names]).select("number", F.array(*names).alias("sums"))
    )
    answers = pairs.filter("kind = 'answer'").select("chunk", "bucket", "piece", "a", "b")
    spread, place = answers.filter("piece >= 0"), ["chunk", "bucket", "piece"]
    found = (
        spread.select(*place, "b").mapInArrow(asked, "chunk long, bucket int, piece int, number long").join(total, "number").groupBy(*place)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "sums"))), lambda r: r["sums"]).alias("rows"))
    )
    filled = spread.drop("b").join(found, place, "left").select(*place, "a", "rows")
    return answers.filter("piece < 0").unionByName(filled.mapInArrow(packed, "chunk long, bucket int, piece int, a binary, b binary"))


# --- scores ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    uni: Unigrams
    bi: Discounts
    buckets: int

    def alpha(self, sums: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Backoff weight per context: its lost mass over the unigram mass of what it hasn't seen."""
        return self.bi.lost(sums[:, :K + 1]) / np.maximum(context, 1) / (1 - sums[:, K + 1])

    def probability(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray, alpha: np.ndarray) -> np.ndarray:
        """Katz recursion by counts: the bigram if seen, else what the context leaves to the unigram."""
        lower = self.uni.probability(word)
        backed = np.where(context > 0, alpha, 1.0) * lower
        return np.where(pair > 0, self.bi.of(pair) * pair / np.maximum(context, 1), backed)


def score_chunks(chunks: DataFrame, model: Model, schema: str) -> DataFrame:
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for row in _rows(f):
                x = Lookup(row, model.uni, model.buckets)
                got = row["pairs"]
                pair = np.concatenate([unpack(y["a"]) for y in got])
                context, word = x.counts[x.left], x.counts[x.right]
                alpha = np.ones(len(pair))
                for y, a, b in zip(got, x.first, x.cut):
                    unseen = np.flatnonzero(pair[a:b] == 0) + a
                    if not len(unseen):
                        continue
                    of = np.unique(x.number[unseen], return_inverse=True)[1]
                    sums = np.frombuffer(y["b"]).reshape(-1, CONTEXT)
                    alpha[unseen] = model.alpha(sums, context[unseen][np.unique(of, return_index=True)[1]])[of]
                logs = np.empty(len(pair))
                logs[x.order] = np.log10(model.probability(pair, context, word, alpha))
                c = x.chunk
                of_token = x.counts[c.tokens]
                out = [
                    np.add.reduceat(v, c.starts)
                    for v in ((of_token > 0).astype(np.int64), model.uni.base(of_token), logs[x.place])
                ]
                ids = pa.array(row["doc_ids"], f.schema.field("doc_ids").type.value_type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(c.sizes), *map(pa.array, out)], names)

    return chunks.mapInArrow(run, schema)


def katz_scores(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score; learned where `train` holds."""
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    buckets = 1 + size // BUCKET_BYTES
    chunks = bucketed(build_chunks(docs, doc_id, text, train, buckets), "chunk")
    words = materialize(merge_words(word_requests(chunks), buckets), "katz-words")
    total, distinct, begins, *types = summed(words, 3 + K + 2)
    d = Discounts.good_turing(types[:K + 1])
    # n_1..n_K and all larger ones.
    larger = types[K + 1]
    uni = Unigrams(total, distinct, d, float(d.lost(np.array([*types[:K], larger]))))
    asked = chunks.join(by_chunk(words.filter("kind = 'answer'"), "bucket"), "chunk")
    pairs = materialize(merge_bigrams(bigram_requests(asked, uni, buckets), uni, buckets), "katz-bigrams")
    model = Model(uni, Discounts.good_turing(summed(pairs, K + 1)), buckets)
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    scored = score_chunks(
        asked.join(by_chunk(with_spread_sums(pairs), "bucket", "piece").withColumnRenamed("answers", "pairs"), "chunk"), model,
        f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
