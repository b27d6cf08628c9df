"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

1. A bounded, reproducible sample of labelled rows (`sample_rows`, smallest hashes
   first) is cut in three folds by a hash of the id: lexicon, trees, calibration.
2. Lexicon: words and word beginnings whose document frequency among toxic rows of
   its fold is far above that among clean ones, with their smoothed log odds; at most
   `lexicon_terms`. A seed list of common insults always belongs to it.
3. Features of a whole text: lexicon densities and counts, hits close to a second-person
   word, capitals, punctuation, obfuscated hits and symbols inside words.
4. Spark's boosted trees learn on the second fold, isotonic regression maps their
   probability to a calibrated score on the third; a small share of the raw
   probability keeps apart what the steps of the regression tie.

Every row is scored from its text alone, in one pass: ids, languages, sources and
labels are no inputs. Sizes sent to tasks: the lexicon and the trees, both bounded.

Defined results: null and empty texts have all features 0 and are scored like any
other. Labels that are null, not 0 or 1, or without document are ignored; a label
given twice counts as its largest. If a fold lacks one of the classes, the score is
h / (h + 2) with h the number of lexicon hits. Empty tables give empty results.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelkit.llm.frames import crc_mod, fresh, text_or_empty
from panelkit.session import materialize

# Fixed value: common insults, so that the lexicon isn't empty where labels are few.
SEED = (
    "idiot", "moron", "stupid", "dumb", "trash", "scum", "loser", "clown", "pathetic", "worthless", "disgusting",
    "fool", "imbecile", "idiota", "dummkopf", "connard", "abruti",
)
# Fixed value: second-person words of English, German, French and Spanish.
SECOND = {
    "you", "your", "yours", "you're", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "te",
    "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros",
}
# Fixed value: characters that stand for letters in disguised words.
LEET = str.maketrans("013457@$!|", "oieastasil"[:10])
PREFIXES = (4, 5, 6)
NEAR = 5
CACHE_WORDS = 300_000
FEATURES = (
    "seed_density", "term_density", "weight_density", "max_weight", "log_hits", "log_distinct", "near_second",
    "obfuscated", "symbols", "capitals", "exclamations", "punctuation", "digits", "log_words",
)


@dataclass(frozen=True)
class Config:
    sample_rows: int = 20_000
    lexicon_terms: int = 1_000
    least_rows: int = 4
    threshold: float = 0.7
    trees: int = 20
    depth: int = 4
    raw_share: float = 0.02


# --- words and features -----------------------------------------------------------------


def _core(word: str) -> str:
    return word.strip(string.punctuation)


def terms(word: str) -> list[str]:
    """The word itself and its beginnings, marked as such."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


class Words(dict):
    """Lower-case token -> weight, plus 100 if obfuscated, 1000 if a seed word, 10000 if second person. Bounded."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def _weight(self, word: str) -> float:
        return max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0)

    def __missing__(self, token: str) -> float:
        word = _core(token)
        value = 10_000.0 if word in SECOND else self._weight(word) + 1000 * (word in SEED)
        if not value and len(word) >= 4 and not word.isalpha():
            plain = "".join(filter(str.isalpha, word.translate(LEET)))
            if plain != word and (w := self.lexicon.get(plain, 0.0)):
                value = w + 100 + 1000 * (plain in SEED)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[token] = value
        return value


_PUNCT = np.frombuffer(string.punctuation.encode(), np.uint8)


def features(text: str, words: Words) -> list[float]:
    """The values named in FEATURES."""
    raw = text.encode("utf-8", "surrogatepass")
    tokens = text.lower().split()
    n = max(1, len(tokens))
    codes = np.fromiter(map(words.__getitem__, tokens), np.float64, len(tokens))
    at = np.flatnonzero(codes)
    some = codes[at]
    second = at[some >= 10_000]
    hit = (some > 0) & (some < 10_000)
    where, value = at[hit], some[hit]
    seed = value >= 1000
    value = np.where(seed, value - 1000, value)
    hidden = value >= 100
    weight = np.where(hidden, value - 100, value)
    close = 0
    if len(second) and len(where):
        i = np.searchsorted(second, where)
        left = np.abs(where - second[np.maximum(i - 1, 0)])
        right = np.abs(second[np.minimum(i, len(second) - 1)] - where)
        close = int((np.minimum(left, right) <= NEAR).sum())
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = max(1, len(text))
    punct = int(bytes_[_PUNCT].sum())
    distinct = len({tokens[i] for i in where.tolist()}) if len(where) < 1000 else 1000
    return [
        100 * float(seed.sum()) / n, 100 * len(where) / n, 100 * float(weight.sum()) / n, float(weight.max(initial=0.0)),
        float(np.log1p(len(where))), float(np.log1p(distinct)), 100 * close / n, 100 * float(hidden.sum()) / n,
        (punct - int(bytes_[[0x2C, 0x2E]].sum())) / n, int(bytes_[65:91].sum()) / chars, int(bytes_[0x21]) / n, punct / chars,
        int(bytes_[48:58].sum()) / chars, float(np.log1p(len(tokens))),
    ]


def feature_column(text: Column, lexicon: dict[str, float]) -> Column:
    memo: dict[int, Words] = {}

    def compute(texts: pd.Series) -> pd.Series:
        words = memo.setdefault(0, Words(lexicon))
        return pd.Series([features(t, words) for t in texts])

    return F.pandas_udf(compute, T.ArrayType(T.DoubleType()))(text)


# --- learning -----------------------------------------------------------------------------


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    config: Config


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, config: Config) -> DataFrame:
    """(label, fold, text) of at most about `sample_rows` training rows, chosen by hash."""
    usable = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc_mod("doc_id", 3) != 1))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    total = usable.count()
    share = min(1.0, config.sample_rows / max(1, total))
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(10))
    picked = usable.filter(place < share).withColumn("fold", fold).select(F.col("doc_id").alias("_id"), "label", "fold")
    rows = docs.select(F.col(doc_id).alias("_doc"), text_or_empty(text).alias("text"))
    # `picked` is bounded by the sample size.
    return rows.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select("label", "fold", "text")


def learn_lexicon(rows: DataFrame, config: Config) -> dict[str, float]:
    """Terms with their log odds, from (label, text)."""
    def counted(label: int, wanted: frozenset[str] | None = None) -> DataFrame:
        """(term, n): rows of a label that hold each term; counts of a task's rows travel together."""
        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for f in frames:
                for text in f.column(0).to_pylist():
                    words = {_core(t) for t in text.lower().split()}
                    seen.update({t for w in words if w for t in terms(w) if wanted is None or t in wanted})
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["term", "n"])

        own = rows.filter(F.col("label") == label).select("text")
        return own.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    # The sample bounds these tables; candidates are terms of several toxic rows.
    bad = counted(1).filter(F.col("n") >= config.least_rows).toPandas().rename(columns={"n": "bad"})
    good = counted(0, frozenset(bad["term"])).toPandas().rename(columns={"n": "good"})
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = bad.merge(good, on="term", how="left").fillna({"good": 0})
    odds = np.log((found["bad"] + 0.5) / (sizes.get(1, 0) + 1)) - np.log((found["good"] + 0.5) / (sizes.get(0, 0) + 1))
    found = found.assign(odds=odds)
    found = found[found["odds"] > 2.5].sort_values(["odds", "term"], ascending=[False, True]).head(config.lexicon_terms)
    learned = dict(zip(found["term"], found["odds"].astype(float)))
    return {**{w: 5.0 for w in SEED}, **learned}


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", config: Config = Config()) -> Model:
    rows = materialize(labelled_sample(docs, labels, doc_id, text, config), "toxicity-sample")
    counts = {(r["part"], r["label"]): r["n"] for r in rows.groupBy(_fold("fold").alias("part"), "label")
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    lexicon = learn_lexicon(rows.filter(_fold("fold") == 0), config)
    if any(not counts.get((part, label)) for part in (1, 2) for label in (0, 1)):
        return Model(lexicon, None, None, config)
    table = materialize(
        rows.filter(_fold("fold") > 0).select(
            F.col("label").cast("double").alias("label"), _fold("fold").alias("part"),
            feature_column(F.col("text"), lexicon).alias("values")),
        "toxicity-features",
    ).select("label", "part", array_to_vector("values").alias("features"))
    trees = GBTClassifier(
        maxIter=config.trees, maxDepth=config.depth, stepSize=0.2, subsamplingRate=1.0, minInstancesPerNode=5, seed=7,
        featuresCol="features", labelCol="label",
    ).fit(table.filter("part = 1").coalesce(4).cache())
    held = trees.transform(table.filter("part = 2")).select("label", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(held)
    return Model(lexicon, trees, calibration, config)


def _fold(name: str) -> Column:
    """0: lexicon, 1: trees, 2: calibration."""
    return F.when(F.col(name) < 4, 0).when(F.col(name) < 8, 1).otherwise(2)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a column `out` in [0, 1]."""
    values, vec, p, cal = (fresh(docs, c) for c in ("_values", "_features", "_raw", "_calibrated"))
    with_values = docs.withColumn(values, feature_column(text_or_empty(text), model.lexicon))
    if model.trees is None:
        hits = F.expm1(F.col(values)[FEATURES.index("log_hits")])
        return with_values.select(*[docs[c] for c in docs.columns], (hits / (hits + 2)).alias(out))
    trees = model.trees.copy().setFeaturesCol(vec).setPredictionCol("").setRawPredictionCol("").setProbabilityCol(fresh(docs, "_prob"))
    found = trees.transform(with_values.withColumn(vec, array_to_vector(values)))
    found = found.withColumn(p, vector_to_array(fresh(docs, "_prob"))[1])
    found = model.calibration.copy().setFeaturesCol(p).setPredictionCol(cal).transform(found)
    share = model.config.raw_share
    mixed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(cal) * (1 - share) + F.col(p) * share))
    return found.select(*docs.columns, mixed.alias(out))


def keep_clean(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> DataFrame:
    """The rows of `docs` whose score is below the threshold, all columns."""
    name = fresh(docs, "_score")
    scored = score(docs, learn(docs, labels, config=config), out=name)
    return scored.filter(F.col(name) < config.threshold).select(*docs.columns)
