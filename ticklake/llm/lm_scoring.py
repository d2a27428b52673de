"""Cross-entropy difference of two matched n-gram models (Moore and Lewis).

The target model knows the documents of the wanted kind, the background model all documents. Both predict a text's
bytes, so both share the whole vocabulary of 256, have the same order and the same smoothing, and the background's
counts are scaled to the target's total, so that neither loss is lower for mere size. A context c seen n(c) times gives
byte s the probability (n(c, s) + m p(s | c shortened)) / (n(c) + m), down to 1/256. A document's score is its mean
target loss less its mean background loss, in bits per byte: the lower, the closer to the target.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklake.llm._spark import cut, small_side
from ticklake.llm._text import blocks, grams_counted
from ticklake.llm.language_id import place

#: Bytes of text that share one copy of the losses of their grams.
BLOCK_BYTES = 4_000_000


@dataclass
class NgramPair:
    """How often each gram occurs in the target and in the background: a table of gram, target and background."""

    counts: DataFrame
    order: int
    strength: float

    def losses(self, gram: DataFrame) -> DataFrame:
        """Losses in bits under both models, of the grams counted and of those of ``gram``, which may be new.

        One level per context length, the shortest first. A gram has at most 256 longer ones and a context at most 256
        grams, so no key of these joins and windows is hot, whatever the text.
        """
        sums = [F.sum(c).alias(c) for c in ("target", "background")]
        new = gram.select("gram", F.lit(0).cast("bigint").alias("target"), F.lit(0).cast("bigint").alias("background"))
        levels = [self.counts.unionByName(new).groupBy("gram").agg(*sums)]
        for j in range(self.order - 1, -1, -1):
            levels.append(levels[-1].groupBy(_last(j + 1).alias("gram")).agg(*sums))
        target, background = self.counts.agg(*sums).first()
        weight = {"target": 1.0, "background": (target or 0) / max(1, background or 0)}
        context, lower = Window.partitionBy(F.shiftrightunsigned("gram", 8)), None
        for j, level in enumerate(reversed(levels)):
            rows = level.select("gram", *[(F.col(c) * w).alias(c) for c, w in weight.items()], *[(F.sum(c).over(context) * w).alias(f"all_{c}") for c, w in weight.items()])
            if lower is None:
                rows = rows.select("*", *[F.lit(1 / 256).alias(f"p_{c}") for c in weight])
            else:
                rows = rows.withColumn("last", _last(j)).join(lower.withColumnRenamed("gram", "last"), "last")
            lower = rows.select("gram", *[((F.col(c) + self.strength * F.col(f"p_{c}")) / (F.col(f"all_{c}") + self.strength)).alias(f"p_{c}") for c in weight])
        return lower.select("gram", *[(-F.log2(f"p_{c}")).cast("float").alias(c) for c in weight])


def _last(n: int) -> Column:
    """The last ``n`` bytes of the gram."""
    return F.col("gram").bitwiseAND(F.lit((1 << (8 * n)) - 1))


def _pieces(raw: np.ndarray, at: np.ndarray, order: int, step: int = 8_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each byte's place among the distinct grams, those, and each byte's row, over ``step`` bytes at a time."""
    for lo in range(0, len(raw), step):
        back = min(lo, order)
        piece = raw[lo - back : lo + step]
        borders = np.clip(at - (lo - back), 0, len(piece))
        code, gram, _ = grams_counted(piece, borders, order)
        yield code[back:], gram, np.repeat(np.arange(len(at) - 1), np.diff(borders))[back:]


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in blocks(batch, 0, 8_000_000):
                wanted = part.column(1).to_numpy(zero_copy_only=False)
                for code, gram, row in _pieces(raw, at, order):
                    n = np.bincount(code, minlength=len(gram))
                    target = np.bincount(code[wanted[row]], minlength=len(gram))
                    sort = np.argsort(gram)
                    sort = sort[n[sort] > 0]
                    yield pa.RecordBatch.from_arrays([pa.array(gram[sort].view(np.int64)), pa.array(target[sort]), pa.array(n[sort])], ["gram", "target", "background"])

    return run


def train(docs: DataFrame, wanted: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = 4, strength: float = 8.0) -> NgramPair:
    """The model pair from all of ``docs`` and its rows whose id is in ``wanted`` (column ``doc_id``).

    How often each byte follows each context is counted per batch and summed by a shuffle on the gram; the counts stay
    a table, at the same order for any size.
    """
    ids = small_side(cut(wanted.select(doc_id).where(F.col(doc_id).isNotNull()).distinct().withColumn("__wanted", F.lit(True))))
    rows = docs.select(doc_id, F.col(text).cast("string").alias("__text")).join(ids, doc_id, "left")
    grams = rows.select("__text", F.coalesce("__wanted", F.lit(False))).mapInArrow(_count(order), "gram bigint, target bigint, background bigint")
    return NgramPair(cut(grams.groupBy("gram").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))), order, strength)


def _numbered(most: int):
    """Adds the number of the block that a row's first byte lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, before = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            end = before + np.cumsum(size)
            block = first + (end - size) // most
            before = int(end[-1]) if len(end) else before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], ["id", "text", "block"])

    return run


def _grams(order: int):
    """The distinct grams of each block; a block that lies in several batches may name one again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            borders = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]]) if len(number) else np.zeros(1, np.int64)
            for lo, hi in zip(borders[:-1], borders[1:], strict=True):
                for _, raw, at in blocks(batch.slice(lo, hi - lo), 1, 8_000_000):
                    for _, gram, _ in _pieces(raw, at, order):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), number[lo])), pa.array(np.sort(gram).view(np.int64))], ["block", "gram"])

    return run


def _score(order: int, names: list[str]):
    def run(docs: pa.Table, losses: pa.Table) -> pa.Table:
        gram = losses["gram"].to_numpy().view(np.uint64)
        sort = np.argsort(gram)
        gram, known = gram[sort], [losses[c].to_numpy()[sort].astype(float) for c in ("target", "background")]
        out = []
        for batch in docs.select(["id", "text"]).combine_chunks().to_batches():
            for part, raw, at in blocks(batch, 1):  # a very long row stands alone; its bytes are taken in pieces
                total = np.zeros((part.num_rows, 2))
                for code, own, row in _pieces(raw, at, order):
                    i, found = place(gram, own)
                    if not found[code].all():
                        raise ValueError("a gram of the block has no loss")
                    for k in range(2):
                        total[:, k] += np.bincount(row, weights=known[k][i][code], minlength=part.num_rows)
                n = np.diff(at)
                mean = total / np.maximum(1, n)[:, None]
                out.append(pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(mean[:, 0]), pa.array(mean[:, 1]), pa.array(mean[:, 0] - mean[:, 1])], names))
        return pa.Table.from_batches(out)

    return run


def score(docs: DataFrame, pair: NgramPair, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``n_tokens`` (bytes), ``target_loss``, ``background_loss`` and ``score``, in bits per byte.

    Null and empty texts have no tokens and losses of 0. If nothing is wanted, or the corpus is empty, both models are
    uniform there and scores need not be small. Rows are scored each for itself, whole; equal texts get equal scores;
    other columns are ignored.

    Rows are kept in numbered blocks of about ``BLOCK_BYTES``. Each block names its distinct grams once, gets their
    losses by a join, and meets its rows again: a task holds a block and its losses, never the model.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    rows = cut(rows.mapInArrow(_numbered(BLOCK_BYTES), f"id {kind}, text string, block bigint"))
    grams = cut(rows.select("block", "text").mapInArrow(_grams(pair.order), "block bigint, gram bigint"))
    losses = grams.join(pair.losses(grams.select("gram")), "gram")
    names = [doc_id, "n_tokens", "target_loss", "background_loss", "score"]
    schema = f"`{doc_id}` {kind}, n_tokens bigint, target_loss double, background_loss double, score double"
    return rows.groupBy("block").cogroup(losses.groupBy("block")).applyInArrow(_score(pair.order, names), schema)
