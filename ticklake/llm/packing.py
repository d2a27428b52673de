"""Packing by power-of-two decomposition: every document is cut into pieces of binary lengths, each a sequence of its own."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name of the ranks file of the vocabulary ``byte_bpe_50k.json``.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The added tokens of ``byte_bpe_50k.json``.
ADDED = {"<|endoftext|>": 50256}


@cache
def _fast(path: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


@cache
def _reference():
    import public_tokenizers
    import tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def token_ids(text: str, path: str | None = None) -> np.ndarray:
    """Ids of the text as ``tokenizers`` gives them: split at added tokens, which are their own ids, no special tokens added.

    The ranks file's encoder gives the same ids four times as fast, but can't split some texts, such as a million spaces
    in a row; those go to ``tokenizers`` itself.
    """
    try:
        return _fast(path).encode_to_numpy(text, allowed_special=set(ADDED), disallowed_special=())
    except ValueError:
        return np.array(_reference().encode(text, add_special_tokens=False).ids, np.uint32)


def binary_lengths(n: int, longest: int) -> list[int]:
    """Whole pieces of ``longest``, then the rest as powers of two in falling order."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pieces(path: str | None, longest: int, end_id: int, names: list[str], flush: int = 2_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")

        def out(row, start, length, total, ids, ids_type):
            borders = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
            data = np.concatenate(ids).astype("<u4")
            body = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(data)])
            return pa.RecordBatch.from_arrays([pa.array(row, ids_type), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), body], names)

        for batch in batches:
            row, start, length, total, ids, held = [], [], [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.concatenate([token_ids(text.as_py() or "", path), end])
                cuts, at = binary_lengths(len(tokens), longest), 0
                for n in cuts:
                    row.append(doc_id)
                    start.append(at)
                    length.append(n)
                    total.append(len(tokens))
                    at += n
                ids.append(tokens)
                held += len(tokens)
                if held >= flush:
                    yield out(row, start, length, total, ids, batch.schema.field(0).type)
                    row, start, length, total, ids, held = [], [], [], [], [], 0
            if row:
                yield out(row, start, length, total, ids, batch.schema.field(0).type)

    return run


def pack(docs: DataFrame, longest: int = 2048, end_id: int = 1, ranks_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents; each is one sequence, so no sequence crosses documents and none needs padding.

    Per piece: the document's id, ``start`` (ids of the document before it), ``length`` (a power of two, ``longest``
    at most), ``doc_tokens``, ``ids`` (binary, little-endian unsigned 32-bit), ``bucket`` (log2 of the length: batches
    are drawn from one bucket), ``sequence_id`` and ``offset`` (0). ``longest`` must be a power of two.
    Ids are those of ``tokenizers`` by default, with strings of added tokens in a text as their ids.

    A null or empty text is the end id alone: one piece of length 1. Rows with the same or no id are packed each for
    itself. An empty table gives no rows. Other columns are ignored. Nothing is shuffled; long texts, of any characters,
    are held one at a time.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    names = [doc_id, "start", "length", "doc_tokens", "ids"]
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, start bigint, length bigint, doc_tokens bigint, ids binary"
    pieces = docs.select(doc_id, F.col(text).cast("string")).mapInArrow(_pieces(ranks_path, longest, end_id, names), schema)
    return pieces.withColumns({"bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})


def bucket_sizes(pieces: DataFrame) -> DataFrame:
    """Sequences and tokens per bucket of equal length."""
    return pieces.groupBy("bucket").agg(F.count("*").alias("n_sequences"), F.sum("length").alias("n_tokens"))
