"""Language identification by prediction by partial matching (PPM).

Per language, a tree of byte contexts up to ``order`` bytes. In a context seen T times with D distinct following bytes,
a byte that followed n times has probability n / (T + D); any other escapes with D / (T + D) to the context shorter by
one byte, below the empty context to 1/256 (method C, no exclusions). Statistics are frozen after training, so a text's
code length under a language is an exact sum over its bytes, and rows are scored independently.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, StringType

from ticklake.llm._spark import map_arrow
from ticklake.llm._text import blocks, grams_counted

#: Label of texts without any letter.
UNKNOWN = "und"


class ContextTrees:
    """Frozen context statistics of all languages; ``bits`` gives code lengths."""

    def __init__(self, languages: list[str], priors: list[float], grams: list[tuple[np.ndarray, np.ndarray]], order: int):
        self.languages, self.order = languages, order
        self.prior_bits = -np.log2(np.array(priors, float))
        self.trees = [self._tree(g, n) for g, n in grams]
        self.known = np.unique(np.concatenate([g for g, _ in grams])) if grams else np.zeros(0, np.uint64)
        self.known_bits = self._code(self.known).astype(np.float32)

    def _tree(self, gram: np.ndarray, count: np.ndarray) -> list[tuple]:
        levels = []
        for j in range(self.order + 1):
            seen, place = np.unique(gram & np.uint64(2 ** (8 * (j + 1)) - 1), return_inverse=True)
            n = np.bincount(place, weights=count, minlength=len(seen))
            context, at = np.unique(seen >> np.uint64(8), return_inverse=True)
            levels.append((seen, n, context, np.bincount(at, weights=n, minlength=len(context)), np.bincount(at, minlength=len(context))))
        return levels

    def _code(self, gram: np.ndarray) -> np.ndarray:
        out = np.zeros((len(gram), len(self.trees)))
        for k, tree in enumerate(self.trees):
            p = np.full(len(gram), 1 / 256)
            for j, (seen, n, context, total, distinct) in enumerate(tree):
                key = gram & np.uint64(2 ** (8 * (j + 1)) - 1)
                i, found = place(seen, key)
                c, open_ = place(context, key >> np.uint64(8))
                under = total[c] + distinct[c]
                p = np.where(open_, np.where(found, n[i] / under, distinct[c] / under * p), p)
            out[:, k] = -np.log2(p)
        return out

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte after its others, one column per language."""
        i, found = place(self.known, gram)
        out = self.known_bits[i] if len(self.known) else np.zeros((len(gram), len(self.trees)), np.float32)
        if not found.all():
            out[~found] = self._code(gram[~found])
        return out


def place(values: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in sorted ``values`` (0 if nowhere), and whether it does."""
    if not len(values):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    i = np.minimum(np.searchsorted(values, key), len(values) - 1)
    found = values[i] == key
    return np.where(found, i, 0), found


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            for label in sorted(set(labels)):
                own = batch.filter(pa.array(labels == label))
                for part, raw, at in blocks(own, 1):
                    _, gram, n = grams_counted(raw, at, order)
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n)], ["label", "gram", "n"])

    return run


def train(labelled: DataFrame, label: str = "lang", text: str = "text", order: int = 4, sample_bytes: int = 4_000_000) -> ContextTrees:
    """Context trees from ``labelled``; rows without label or text are left out.

    Fitted on a sample bounded by ``sample_bytes`` of text in all, dealt evenly among labels, and by one row more for
    each: whole rows are drawn by a hash of all their columns, so copies are drawn each for itself, with the rate that
    meets a label's share. The row of the least hash is always drawn. Priors are the labels' shares of all rows.
    """
    plain = [F.col(f"`{f.name}`") for f in labelled.schema.fields if isinstance(f.dataType, AtomicType)]
    draw = F.pmod(F.xxhash64(*plain), F.lit(1 << 40)).alias("draw")
    rows = labelled.select(F.col(label).alias("label"), F.col(text).alias("text"), draw).where("label is not null and text is not null")
    found = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"), F.min("draw").alias("least")).collect()
    sizes, least = {r["label"]: (r["n"], r["size"]) for r in found}, {r["label"]: r["least"] for r in found}
    if not sizes:
        return ContextTrees([], [], [], order)
    share = sample_bytes / len(sizes)
    most = {k: max(least[k], int(min(1.0, share / max(1, size)) * (1 << 40))) for k, (_, size) in sizes.items()}
    drawn = rows.where(F.col("draw") <= F.coalesce(*[F.when(F.col("label") == k, F.lit(m)) for k, m in most.items()], F.lit(-1)))
    counts = drawn.select("label", "text").mapInArrow(_count(order), "label string, gram bigint, n bigint").groupBy("label", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(sizes)
    found, gram, n = counts["label"].to_numpy(), counts["gram"].to_numpy().view(np.uint64), counts["n"].to_numpy()
    total = sum(n for n, _ in sizes.values())
    return ContextTrees(names, [sizes[k][0] / total for k in names], [(gram[found == k], n[found == k]) for k in names], order)


def _score(shared, order: int, text: int, keep: int, names: list[str]):
    """Adds three columns to the first ``keep`` ones; column ``text`` is the text, the last one says whether it has letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: ContextTrees = shared.value
        for batch in batches:
            for part, raw, at in blocks(batch, text, 1_000_000):
                total = np.tile(trees.prior_bits, (part.num_rows, 1))
                step = 4_000_000
                for lo in range(0, len(raw), step):  # a very long row stands alone; its bytes are taken in pieces
                    back = min(lo, order)
                    piece = raw[lo - back : lo + step]
                    borders = np.array([0, len(piece)]) if part.num_rows == 1 else at
                    code, gram, _ = grams_counted(piece, borders, order)
                    code, bits = code[back:], trees.bits(gram)
                    row = np.zeros(len(code), np.int64) if part.num_rows == 1 else np.repeat(np.arange(part.num_rows), np.diff(at))
                    for k in range(len(trees.languages)):
                        total[:, k] += np.bincount(row, weights=bits[code, k], minlength=part.num_rows)
                best = total.argmin(1)
                some = (np.diff(at) > 0) & part.column(part.num_columns - 1).to_numpy(zero_copy_only=False)
                score = np.where(some, 1 / np.exp2(total.min(1)[:, None] - total).sum(1), 0.0)
                found = [trees.languages[i] if ok else UNKNOWN for i, ok in zip(best, some, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], pa.array(found, pa.string()), pa.array(score), pa.array(np.where(some, total.min(1), 0.0))], names)

    return run


def identify(docs: DataFrame, trees: ContextTrees, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "bits")) -> DataFrame:
    """Per row: the columns ``keep`` (the id, if not given), ``lang_pred``, ``score`` (the language's share of the
    posterior, 0 to 1) and ``bits`` (its code length), the last three as ``names``, which must not be in ``keep``.

    Null or empty texts and texts without a letter are ``und`` with score 0; so are all if nothing was learned. Rows
    are scored each for itself, whole; equal texts get equal results; other columns are ignored.
    """
    keep = keep or [doc_id]
    kept = [F.col(f"`{c}`") for c in keep]
    if not trees.languages:
        return docs.select(*kept, *[F.lit(x).alias(n) for x, n in zip((UNKNOWN, 0.0, 0.0), names, strict=True)])
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    schema = docs.select(*kept, F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(0.0).alias(names[2])).schema
    for field in schema.fields:
        field.nullable = True
    own = F.col(f"`{text}`").cast("string")
    inside = text in keep and isinstance(docs.schema[text].dataType, StringType)  # then the text isn't sent twice
    rows = docs.select(*kept, *([] if inside else [own]), F.coalesce(own.rlike(r"\p{L}"), F.lit(False)))
    return map_arrow(rows, _score(shared, trees.order, keep.index(text) if inside else len(keep), len(keep), [*keep, *names]), schema)
