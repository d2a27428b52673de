"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text in lower case, everything but letters taken as one space, has the set of its character n-grams of 3 to 6
characters, hashed to ``BUCKETS``. Of a labelled sample, each bucket's document counts per class give the ratio
r = log((p + 1) / sum p) - log((q + 1) / sum q). The buckets that set the classes apart most are features of value r
where present, on which a logistic regression is fitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.llm._spark import cut
from ticklake.llm.labelled import labelled_sample

BITS = 20
BUCKETS = 1 << BITS
LENGTHS = (3, 4, 5, 6)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Characters of texts taken at a time.
MOST = 500_000


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def characters(text: str) -> np.ndarray:
    """Code points of the text in lower case, with one space for each run of non-letters and one at either end."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[np.minimum(code, 0xFFFF)]
    far = np.flatnonzero(code > 0xFFFF)
    letter[far] = [chr(c).isalpha() for c in code[far]]
    code = np.concatenate([[32], np.where(letter, code, 32), [32]]).astype(np.uint32)
    return code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each n-gram of the texts, with repeats."""
    each = [characters(t) for t in texts]
    code = np.concatenate(each).astype(np.uint64) if each else np.zeros(0, np.uint64)
    length = np.array([len(x) for x in each], np.int64)
    row = np.repeat(np.arange(len(texts)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(code))  # characters from here to the row's end
    h = np.zeros(len(code), np.uint64)
    rows, found = [], []
    for n in range(1, max(LENGTHS) + 1):
        h = h[: len(code) - n + 1] * _STEP + code[n - 1 :] if len(code) >= n else h[:0]
        if n in LENGTHS:
            ok = left[: len(h)] >= n
            rows.append(row[: len(h)][ok])
            found.append(((h[ok] ^ (h[ok] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(found)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about ``MOST`` characters, with the place of each run's first."""
    held, size, first = [], 0, 0
    for k, value in enumerate(batch.column(column)):
        text = value.as_py() or ""
        if held and size + len(text) > MOST:
            yield first, held
            held, size, first = [], 0, k
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        y = batch.column(0).to_numpy()
        for first, texts in _texts(batch, 1):
            row, found = buckets(texts)
            pair = np.unique(row * BUCKETS + found)
            for k in (0, 1):
                own = y[first + pair // BUCKETS] == k
                total[k] += np.bincount(pair[own] % BUCKETS, minlength=BUCKETS)
    seen = np.flatnonzero(total.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0, seen]), pa.array(total[1, seen])], ["bucket", "q", "p"])


def _present(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature = shared.value
        for batch in batches:
            for first, texts in _texts(batch, 1):
                row, found = buckets(texts)
                own = feature[found]
                pair = np.unique(row[own >= 0] * BUCKETS + own[own >= 0])
                n = np.bincount(pair // BUCKETS, minlength=len(texts))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array((pair % BUCKETS).astype(str).tolist(), pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), lists], ["y", "features"])

    return run


class Linear:
    """A weight per bucket, 0 for those that are no features, and the intercept."""

    def __init__(self, weight: np.ndarray, intercept: float):
        self.weight, self.intercept = weight, intercept


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 20_000, features: int = 3_000, least_documents: int = 5, doc_id: str = "doc_id", text: str = "text") -> Linear:
    """The classifier, fitted on a sample of about ``sample`` labelled documents.

    Features are the ``features`` buckets of at least ``least_documents`` sampled documents with the greatest chi-square
    between class and presence. Without labelled rows of both classes every text scores the share of label 1 (0 if none).
    """
    rows = cut(labelled_sample(docs, labels, label, sample, doc_id, text).select("y", "text"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    negative, positive = sizes.get(0, 0), sizes.get(1, 0)
    if not negative or not positive:
        return Linear(np.zeros(BUCKETS, np.float32), 30.0 if positive else -30.0)
    counts = rows.mapInArrow(_class_counts, "bucket bigint, q bigint, p bigint").groupBy("bucket").agg(F.sum("q").alias("q"), F.sum("p").alias("p"))
    counts = counts.where(F.col("p") + F.col("q") >= least_documents).toArrow()
    if not counts.num_rows:
        return Linear(np.zeros(BUCKETS, np.float32), float(np.log(positive / negative)))
    bucket, q, p = (counts[c].to_numpy().astype(float) for c in ("bucket", "q", "p"))
    expected = (p + q) * positive / (positive + negative)
    gap = (p - expected) ** 2 / (expected * np.maximum(1e-9, 1 - (p + q) / (positive + negative)) + 1e-9)
    best = np.lexsort((bucket, -gap))[:features]
    bucket, q, p = bucket[best].astype(np.int64), q[best], p[best]
    ratio = np.log((p + 1) / (p + 1).sum()) - np.log((q + 1) / (q + 1).sum())
    feature = np.full(BUCKETS, -1, np.int64)
    feature[bucket] = np.arange(len(bucket))
    shared = docs.sparkSession.sparkContext.broadcast(feature)
    present = cut(rows.mapInArrow(_present(shared), "y int, features array<string>"))
    vectors = CountVectorizerModel.from_vocabulary([str(k) for k in range(len(bucket))], "features", "present").setBinary(True).transform(present)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(ratio.tolist()), inputCol="present", outputCol="scaled").transform(vectors)
    fitted = LogisticRegression(featuresCol="scaled", labelCol="y", regParam=0.0001, elasticNetParam=0.0, standardization=False, maxIter=100).fit(scaled)
    weight = np.zeros(BUCKETS, np.float32)
    weight[bucket] = fitted.coefficients.toArray() * ratio
    return Linear(weight, float(fitted.intercept))


def _score(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Linear = shared.value
        for batch in batches:
            for first, texts in _texts(batch, 1):
                row, found = buckets(texts)
                own = model.weight[found] != 0
                pair = np.unique(row[own] * BUCKETS + found[own])
                total = model.intercept + np.bincount(pair // BUCKETS, weights=model.weight[pair % BUCKETS], minlength=len(texts))
                score = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(score)], names)

    return run


def score(docs: DataFrame, model: Linear, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id and ``score``, the probability of label 1 for the whole text.

    Null and empty texts score as a text without features. Rows are scored each for itself; equal texts get equal
    scores; an empty table gives none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, score double"
    return docs.select(doc_id, F.col(text).cast("string")).mapInArrow(_score(shared, [doc_id, "score"]), schema)
