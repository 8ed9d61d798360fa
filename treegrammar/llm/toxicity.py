"""Toxicity by a chain of classifiers.

Categories are predicted in a fixed order.  Each has a linear (logistic) model over hashed words, a word counted once a
document, and over the probabilities of all earlier categories.  The earlier categories' inputs are out-of-fold predictions
while a later model is trained, so that it meets them as wrong as they will be; in prediction they come from the models
fitted on all training rows.  The categories here are the label columns of the labels table: low quality, then toxic.

Training takes a bounded sample: at most about ``train_rows`` labelled documents, those with the least hash of their id; the sample alone
is sent to the tasks that read documents.

Defined results: null and empty texts have no words and get the models' bias; labels that are null in any category or have
no document are not learned from, repeated ones of a document count once (different ones each), of documents with one id the least text; without labels all probabilities are 0.5 and nothing is
flagged; repeated documents are judged each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treegrammar.llm.common import batch, read

DIMS = 1 << 19
MEMO = 400_000
MARKS = ".,;:!?|\"'()[]{}<>*#%&$-_"
TRAIN_ROWS, FOLDS, LEAST_DOCS = 8000, 5, 3
STEPS, RATE, MOMENTUM, L2, THRESHOLD = 200, 0.02, 0.9, 1e-3, 0.6


class Words:
    """Buckets of words, remembered; one for each task."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def buckets(self, text: str | None) -> np.ndarray:
        """The distinct buckets of a text's words."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        out = set()
        for w in set((text or "").lower().split()):
            b = memo.get(w)
            if b is None:
                core = w.strip(MARKS)
                b = memo[w] = zlib.crc32(core.encode("utf-8", "surrogatepass")) % DIMS if core else -1
            out.add(b)
        out.discard(-1)
        return np.fromiter(out, np.int64, len(out))


class Linear(NamedTuple):
    words: np.ndarray
    earlier: np.ndarray
    bias: float

    def odds(self, rows: np.ndarray, cols: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        return np.bincount(rows, self.words[cols], n) + earlier @ self.earlier + self.bias


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: np.ndarray, cols: np.ndarray, n: int, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Logistic regression by gradient descent with momentum; words are scaled by their smoothed log ratio between the classes (zero in fewer than LEAST_DOCS rows), and both classes weigh the same."""
    df, of_pos, pos = np.bincount(cols, minlength=DIMS), np.bincount(cols, y[rows], DIMS), y.sum()
    ratio = np.log((of_pos + 1) / (pos + 2)) - np.log((df - of_pos + 1) / (n - pos + 2))
    ratio[df < LEAST_DOCS] = 0
    keep = ratio[cols] != 0
    rows, cols = rows[keep], cols[keep]
    used, cols = np.unique(cols, return_inverse=True)
    m = len(used)
    x, weight = ratio[used][cols], np.where(y == 1, 0.5 / max(pos, 1), 0.5 / max(n - pos, 1))
    w, e, b = np.zeros(m), np.zeros(earlier.shape[1]), 0.0
    vw, ve, vb = w.copy(), e.copy(), 0.0
    for _ in range(STEPS):
        r = (sigmoid(np.bincount(rows, w[cols] * x, n) + earlier @ e + b) - y) * weight
        vw = MOMENTUM * vw - RATE * (np.bincount(cols, r[rows] * x, m) + L2 * w)
        ve = MOMENTUM * ve - RATE * (earlier.T @ r + L2 * e)
        vb = MOMENTUM * vb - RATE * r.sum()
        w, e, b = w + vw, e + ve, b + vb
    words = np.zeros(DIMS)
    words[used] = w * ratio[used]
    return Linear(words, e, float(b))


def chain(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> list[Linear]:
    """One model a category (column of labels), each trained with the out-of-fold probabilities of those before it."""
    n = len(labels)
    earlier = np.zeros((n, 0))
    models = []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        models.append(fit(rows, cols, n, earlier, y))
        out = np.zeros(n)
        for k in range(FOLDS if c + 1 < labels.shape[1] else 0):
            train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            at = np.full(n, -1)
            at[train] = np.arange(len(train))
            use = at[rows] >= 0
            m = fit(at[rows[use]], cols[use], len(train), earlier[train], y[train])
            out[test] = sigmoid(m.odds(rows, cols, n, earlier))[test]
        earlier = np.column_stack([earlier, out])
    return models


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> list[Linear]:
    """Fits the chain; categories: name -> column of labels, true for members."""
    one = labels.select(F.col(id_col).alias("i"), *(c.cast("int").alias(f"c{k}") for k, c in enumerate(categories.values())))
    one = one.dropna().distinct().withColumn("h", F.xxhash64(F.col("i").cast("string")))
    n = one.count()
    if n > train_rows:
        one = one.where(F.col("h") < int((train_rows / n - 0.5) * 2**64))
    names = [f"c{k}" for k in range(len(categories))]
    rows = docs.select(F.col(id_col).alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(one), F.col("d") == F.col("i"))
    rows = rows.groupBy("d", "h", *names).agg(F.min("text").alias("text")).select("text", "h", *names)
    schema = pa.schema([("b", pa.list_(pa.int32())), ("h", pa.int64()), *((c, pa.int32()) for c in names)])

    def run(batches):
        words = Words()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([words.buckets(t).astype(np.int32) for t in b.column(0).to_pylist()], schema.field("b").type), *b.columns[1:]], schema=schema)

    got = rows.mapInArrow(run, "b array<int>, h long, " + ", ".join(f"{c} int" for c in names)).toArrow().to_pydict()
    n = len(got["h"])
    if not n:
        return [Linear(np.zeros(DIMS), np.zeros(c), 0.0) for c in range(len(names))]
    order = sorted(range(n), key=lambda i: (got["h"][i], got["b"][i]))  # the same sums in the same order each time
    cols = [np.sort(np.array(got["b"][i], np.int64)) for i in order]
    flat = np.repeat(np.arange(n), [len(c) for c in cols])
    fold = np.array([got["h"][i] // 1024 % FOLDS for i in order])
    return chain(flat, np.concatenate(cols), np.array([[got[c][i] for c in names] for i in order]), fold)


def predict(docs: DataFrame, models: list[Linear], names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<name> for each category)."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"p_{c}", pa.float64()) for c in names)])
    weights = np.stack([m.words for m in models]).astype(np.float32)

    def run(batches):
        words = Words()
        for b in batches:
            sums = np.array([weights[:, words.buckets(t)].sum(axis=1, dtype=np.float64) for t in b.column(1).to_pylist()]).reshape(-1, len(models))
            chance = np.zeros((b.num_rows, 0))
            for k, m in enumerate(models):
                chance = np.column_stack([chance, sigmoid(sums[:, k] + chance @ m.earlier + m.bias)])
            yield batch(schema, doc_id=b.column(0), **{f"p_{c}": chance[:, k] for k, c in enumerate(names)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double" for c in names))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, toxic)."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    categories = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    models = train(docs, labels, categories)
    return predict(docs, models, list(categories)).withColumn("toxic", F.col("p_toxic") > THRESHOLD)
