"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.llm.common import batches_of, cut, fresh
from quillsift.plans.lineage import forget
from quillsift.session import plain_unions

#: Most trusted positives and most unlabelled texts that a model is fitted on; the rows with the smallest hashes.
POSITIVES, UNLABELLED = 6_000, 12_000
#: Documents of this fold of crc32(id) mod FOLDS are held out: their labels and texts are not learnt from.
FOLDS, HELD_OUT = 5, 0
#: From this score on a document counts as good.
THRESHOLD = 0.3
#: Full gradient steps (Adam), step size, L2 penalty.
STEPS, RATE, PENALTY = 1_200, 0.05, 1e-4
#: Class of each byte: letters by case, digits, blanks, line ends, bytes of other scripts, and each sign that marks
#: kinds of junk by itself.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "'\"()[]{}", "|", "#$%&*+=~^", "-_/\\:;@", "<>`"]
OTHER = len(CLASSES)
KINDS = OTHER + 1
TABLE = np.full(256, OTHER, np.uint16)
for _k, _signs in enumerate(CLASSES):
    TABLE[np.frombuffer(_signs.encode(), np.uint8)] = _k
#: Pairs of byte classes, then measures of the words and lines.
SIZE = KINDS * KINDS + 8


def measures(text: str | None) -> np.ndarray:
    """What the classifier sees of a text, whole: shares of byte-class pairs, and how its words and lines repeat."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(SIZE, np.float32)
    kinds = TABLE[np.frombuffer(raw, np.uint8)]
    if len(kinds) > 1:
        out[: KINDS * KINDS] = np.sqrt(np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS) / (len(kinds) - 1))
    words = raw.split()
    n = len(words)
    if n:
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out[KINDS * KINDS :] = (
            np.sqrt(sum(map(operator.eq, words, words[1:])) / n),
            len(set(words)) / n,
            np.log1p(n) / 10,
            np.log1p(len(raw) / n) / 3,
            len(set(lines)) / len(lines),
            np.log1p(n / len(lines)) / 5,
            sum(map(bytes.isupper, words)) / n,
            sum(map(bytes.isalpha, words)) / n,
        )
    return out


@dataclass
class Model:
    """Linear on standardised measures; a constant if there was nothing to learn from."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    offset: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(gradient, size: int) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, STEPS + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from how both are scored by a model that tells them apart.

    Above a threshold stand shares p of the positives and u of the unlabelled; were all unlabelled there positive, the
    share would be u / p. The smallest such ratio is taken, with bounds for the sampling error of either share.
    """
    top = np.unique(np.concatenate([positive, unlabelled]))
    p = 1 - np.searchsorted(np.sort(positive), top) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), top) / len(unlabelled)
    slack = 0.5 * (np.sqrt(1 / len(positive)) + np.sqrt(1 / len(unlabelled)))
    ok = p > 10 * slack if (p > 10 * slack).any() else p > 0
    ratio = (u[ok] + slack) / p[ok]
    best = int(ratio.argmin())
    return float(np.clip(u[ok][best] / p[ok][best], 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """Minimises prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]) for the logistic loss l.

    Where the bracket, the risk on negatives, falls below zero its gradient is followed backwards, so the model stops
    explaining away single unlabelled texts. Without positives or unlabelled texts the score is 0.5 everywhere.
    """
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(SIZE), np.ones(SIZE), np.zeros(SIZE), 0.0, 0.5)
    mean, scale = unlabelled.mean(0, dtype=np.float64), unlabelled.std(0, dtype=np.float64) + 1e-3
    ones = lambda x: np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    p, u = ones(positive), ones(unlabelled)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    decay = np.append(np.full(SIZE, PENALTY), 0.0)
    if prior is None:
        apart = descend(lambda w: -p.T @ (1 - sigmoid(p @ w)) / len(p) + u.T @ sigmoid(u @ w) / len(u) + decay * w, SIZE + 1)
        prior = estimated_prior(p @ apart, u @ apart)

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        good = -p.T @ (1 - sigmoid(zp)) / len(p) * prior
        bad = u.T @ sigmoid(zu) / len(u) - prior * (p.T @ sigmoid(zp)) / len(p)
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        return (good + bad if risk >= 0 else -bad) + decay * w

    w = descend(gradient, SIZE + 1)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def fold(row_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(row_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """A model from texts labelled 1 outside the held-out fold and from unlabelled texts outside it.

    The class prior is estimated from positives and unlabelled texts, unless one is given; texts labelled otherwise are
    not learnt from.
    At most `positives` and `unlabelled` texts are read, those with the smallest hashes of their ids, so the same every
    time; only their measures reach the driver. Ids with contradicting labels and null ids are not learnt from; the ids
    of the sample are broadcast, and their number is bounded by the two limits.
    """
    spark = docs.sparkSession
    batches_of(spark)
    plain_unions(spark)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    ids = cut(docs.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull() & (fold(F.col("id")) != HELD_OUT)).distinct().join(known, "id", "left"))  # read twice
    pick = lambda rows, n: rows.select("id").orderBy(F.xxhash64("id"), "id").limit(n)
    some = pick(ids.where("low = 1"), positives).withColumn("y", F.lit(1)).union(pick(ids.where("low is null"), unlabelled).withColumn("y", F.lit(0)))
    rows = [(r["id"], r["y"]) for r in some.collect()]
    forget(spark, ids)
    if not rows:
        return fit(np.empty((0, SIZE)), np.empty((0, SIZE)))
    sample = spark.createDataFrame(rows, T.StructType([T.StructField("sample_id", docs.schema[id_col].dataType), T.StructField("y", T.IntegerType())]))
    texts = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "sample_id")

    @F.pandas_udf(T.BinaryType())
    def measured(text: pd.Series) -> pd.Series:
        return text.map(lambda x: measures(x).astype(np.float16).tobytes())

    # rows that repeat an id count once: that with the smallest measures
    found = texts.select("sample_id", "y", measured("text").alias("x")).groupBy("sample_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("sample_id").toPandas()
    x = np.frombuffer(b"".join(found["x"]), np.float16).reshape(-1, SIZE).astype(np.float32)
    y = found["y"].to_numpy()
    return fit(x[y == 1], x[y == 0], prior)


def scores(model: Model):
    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([measures(x) for x in text])) if len(text) else [], dtype="float64")

    return score


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score, predicted: one row for each row of docs.

    The score depends on the text alone; null and empty texts have one too, the same. A null id is in the fold of the
    empty text. Rows that share an id are scored each by itself. Without labels every score is 0.5. An empty table gives
    no rows; other columns are not read.
    """
    model = train(docs, labels, id_col, text_col)
    batches_of(docs.sparkSession)
    scored = docs.select(F.col(id_col).alias("id"), (fold(F.col(id_col)) == HELD_OUT).alias("held_out"), scores(model)(F.col(text_col)).alias("score"))
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that classify() rejects; the columns are those of docs."""
    model = train(docs, labels, id_col, text_col)
    batches_of(docs.sparkSession)
    (mark,) = fresh(docs, "quality_score")
    return docs.withColumn(mark, scores(model)(F.col(text_col))).where(F.col(mark) >= threshold).drop(mark)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold, score and prediction of every document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
