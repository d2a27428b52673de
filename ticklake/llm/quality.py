"""Quality by attention-based multiple-instance learning: a document is a bag of passages.

Each passage of ``PASSAGE`` words is described by measures of its bytes and words and a histogram of its byte trigrams,
and encoded as h = tanh(E x + e). Gated attention gives it the weight softmax(w . (tanh(V h) * sigmoid(U h))) among its
document's passages; the weighted sum of encodings gives the document's score. Only documents are labelled; what a
passage counts for is learned. Training averages models over shards of a bounded sample, round by round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.llm._spark import cut
from ticklake.llm._text import Words, blocks, byte_class
from ticklake.llm.labelled import labelled_sample

PASSAGE, HISTOGRAM = 64, 48
_SPACE = byte_class("space")
_CODE = np.arange(256)
#: Classes of bytes whose shares are measured: small and capital letters, digits, white space, sentence marks, other ASCII, newlines, beyond ASCII.
CLASSES = np.stack(
    [
        (_CODE >= 97) & (_CODE <= 122),
        (_CODE >= 65) & (_CODE <= 90),
        (_CODE >= 48) & (_CODE <= 57),
        ~_SPACE,
        np.isin(_CODE, [33, 39, 44, 45, 46, 58, 59, 63]),
        (_CODE > 32) & (_CODE < 127) & ~np.isin(_CODE, [33, 39, 44, 45, 46, 58, 59, 63]) & ~((_CODE >= 97) & (_CODE <= 122)) & ~((_CODE >= 65) & (_CODE <= 90)) & ~((_CODE >= 48) & (_CODE <= 57)),
        _CODE == 10,
        _CODE >= 128,
    ]
)
FEATURES = len(CLASSES) + 6 + HISTOGRAM


def passages(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and description of each passage; rows without words have none."""
    words = Words(raw, at, _SPACE)
    if not len(words.hash):
        return np.zeros(0, np.int64), np.zeros((0, FEATURES), np.float32)
    n = words.counts(len(at) - 1)
    place = np.arange(len(words.hash)) - (np.cumsum(n) - n)[words.row]
    opens = np.flatnonzero(place % PASSAGE == 0)
    count = np.diff(np.append(opens, len(words.hash)))
    of_word = np.repeat(np.arange(len(opens)), count)
    lo, hi = words.start[opens], words.end[np.append(opens[1:], len(words.hash)) - 1]
    size = np.maximum(1, hi - lo)
    out = np.zeros((len(opens), FEATURES), np.float32)
    for k, own in enumerate(CLASSES):
        upto = np.concatenate([[0], np.cumsum(own[raw], dtype=np.int32)])
        out[:, k] = (upto[hi] - upto[lo]) / size
    length = (words.end - words.start).astype(float)
    mean = np.bincount(of_word, length) / count
    spread = np.sqrt(np.maximum(0, np.bincount(of_word, length**2) / count - mean**2))
    order = np.lexsort((words.hash, of_word))
    h, p = words.hash[order], of_word[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (p[1:] != p[:-1])])
    distinct = np.bincount(p[fresh], minlength=len(opens))
    runs = np.diff(np.append(np.flatnonzero(fresh), len(h)))
    most = np.zeros(len(opens))
    np.maximum.at(most, p[fresh], runs)
    again = np.concatenate([[False], (words.hash[1:] == words.hash[:-1]) & (of_word[1:] == of_word[:-1])])
    k = len(CLASSES)
    out[:, k : k + 6] = np.stack([np.log1p(mean), np.log1p(spread), distinct / count, most / count, np.bincount(of_word, again) / count, np.log1p(count)], 1)
    if len(raw) > 2:
        owner = np.searchsorted(lo, np.arange(len(raw) - 2), "right") - 1
        inside = (owner >= 0) & (np.arange(2, len(raw)) < hi[np.maximum(owner, 0)])
        tri = (raw[:-2].astype(np.uint32) * 65536 + raw[1:-1].astype(np.uint32) * 256 + raw[2:]) * np.uint32(2654435761) >> np.uint32(16)
        cell = owner[inside] * HISTOGRAM + (tri[inside] % HISTOGRAM).astype(np.int64)
        out[:, k + 6 :] = np.sqrt(np.bincount(cell, minlength=len(opens) * HISTOGRAM).reshape(-1, HISTOGRAM) / size[:, None])
    return words.row[opens], out


class Attention:
    """The network over bags; ``shapes`` lists its parameters, kept in one flat vector."""

    HIDDEN, GATE = 24, 12
    shapes = {"E": (FEATURES, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "b": (1,)}

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.shapes.values())

    @classmethod
    def start(cls) -> np.ndarray:
        rng = np.random.default_rng(5)
        return np.concatenate([(rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else rng.normal(0, 0.1, s)).ravel() for s in cls.shapes.values()])

    @classmethod
    def split(cls, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, s in cls.shapes.items():
            out[k] = flat[at : at + int(np.prod(s))].reshape(s)
            at += int(np.prod(s))
        return out

    @classmethod
    def forward(cls, flat: np.ndarray, x: np.ndarray, first: np.ndarray) -> tuple:
        """Scores of bags before the sigmoid; ``first`` holds each bag's first passage, no bag is empty."""
        p = cls.split(flat)
        n = np.diff(np.append(first, len(x)))
        bag = np.repeat(np.arange(len(first)), n)
        h = np.tanh(x @ p["E"] + p["e"])
        tv, su = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (tv * su) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, 0)
        return z @ p["c"] + p["b"][0], p, bag, h, tv, su, a, z

    @classmethod
    def gradient(cls, flat: np.ndarray, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the mean log loss."""
        s, p, bag, h, tv, su, a, z = cls.forward(flat, x, first)
        ds = (1 / (1 + np.exp(-s)) - y) / len(y)
        dz = ds[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        da = a * (da - np.add.reduceat(a * da, first)[bag])
        dg = da[:, None] * p["w"]
        dv, du = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
        dh = (a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        grads = {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (tv * su).T @ da, "c": z.T @ ds, "b": np.array([ds.sum()])}
        return np.concatenate([grads[k].ravel() for k in cls.shapes])


class Model:
    """Centre and spread of the descriptions, and the network's parameters."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, flat: np.ndarray):
        self.centre, self.spread, self.flat = centre, spread, flat

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        row, x = passages(raw, at)
        out = np.zeros(len(at) - 1)
        if len(row):
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            s = Attention.forward(self.flat, np.clip((x - self.centre) / self.spread, -8, 8), first)[0]
            out[row[first]] = 1 / (1 + np.exp(-np.clip(s, -50, 50)))
        return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, at in blocks(batch, 2):
            row, x = passages(raw, at)
            n = np.bincount(row, minlength=part.num_rows) * FEATURES
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["id", "y", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, FEATURES))
    n = 0
    for batch in batches:
        x = batch.column(0).flatten().to_numpy().reshape(-1, FEATURES).astype(float)
        total += np.stack([x.sum(0), (x**2).sum(0)])
        n += len(x)
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total[0].tolist()]), pa.array([total[1].tolist()])], ["n", "one", "two"])


def _trainer(model: Model, epochs: int, rate: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        bags = [np.clip((np.asarray(x, float).reshape(-1, FEATURES) - model.centre) / model.spread, -8, 8) for x in rows["x"]]
        y, flat = rows["y"].to_numpy(float), model.flat.copy()
        m, v, t, rng = np.zeros_like(flat), np.zeros_like(flat), 0, np.random.default_rng(11)
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for lo in range(0, len(order), 32):
                own = order[lo : lo + 32]
                n = np.array([len(bags[k]) for k in own])
                g = Attention.gradient(flat, np.concatenate([bags[k] for k in own]), np.cumsum(n) - n, y[own]) + 1e-4 * flat
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
                flat = flat - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return pd.DataFrame({"n": [len(bags)], "flat": [flat.tolist()]})

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 6_000, rounds: int = 4, shards: int = 6, epochs: int = 3, rate: float = 0.01, doc_id: str = "doc_id", text: str = "text") -> Model | None:
    """The model, fitted on a sample of about ``sample`` labelled documents; None if none has words.

    The sample is dealt into ``shards`` by a hash of the id. Each of ``rounds`` trains a copy on every shard and takes the
    mean of the copies, weighted by their documents, so the result doesn't depend on the cluster.
    """
    rows = labelled_sample(docs, labels, label, sample, doc_id, text).select("id", "y", "text")
    bags = cut(rows.mapInArrow(_described, f"id {rows.schema['id'].dataType.simpleString()}, y int, x array<float>").where(F.size("x") > 0))
    sums = bags.select("x").mapInArrow(_moments, "n bigint, one array<double>, two array<double>").collect()
    n = sum(r["n"] for r in sums)
    if not n:
        return None
    centre = sum(np.array(r["one"]) for r in sums) / n
    spread = np.sqrt(np.maximum(sum(np.array(r["two"]) for r in sums) / n - centre**2, 1e-8)) + 1e-3
    model = Model(centre, spread, Attention.start())
    dealt = bags.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    for _ in range(rounds):
        copies = dealt.groupBy("shard").applyInPandas(_trainer(model, epochs, rate), "n bigint, flat array<double>").collect()
        model.flat = sum(r["n"] * np.array(r["flat"]) for r in copies) / sum(r["n"] for r in copies)
    return model


def _score(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in blocks(batch, 1, 2_000_000):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(raw, at))], names)

    return run


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id and ``score``, the probability of label 1 for the whole text.

    Null, empty and blank texts have no passages and score 0, as do all without a model. Rows are scored each for
    itself; equal texts get equal scores; an empty table gives none; other columns are ignored.
    """
    if model is None:
        return docs.select(doc_id, F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, score double"
    return docs.select(doc_id, F.col(text).cast("string")).mapInArrow(_score(shared, [doc_id, "score"]), schema)
