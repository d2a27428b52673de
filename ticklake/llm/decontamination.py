"""Benchmark decontamination with one FM-index per shard of training texts.

A shard is a few MB of one partition's texts as word symbols; a word that no phrase has is a separator, as is the border
of two documents. Its index is a suffix array's last column as a wavelet matrix, symbol counts and sampled suffix
positions. All benchmark phrases are searched backwards at once; the places
found become spans of words, merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.llm._spark import columns, cut, free_names, map_arrow
from ticklake.llm._text import Words, blocks, byte_class

#: Bytes of benchmark text in one block of phrases, and blocks that a task searches in one pass.
BLOCK_BYTES, BLOCKS_A_PASS = 2_000_000, 8


class Phrases:
    """Distinct windows of some benchmark items as symbol rows, and the items that hold each."""

    def __init__(self, items: list[str], words: list[np.ndarray], width: int):
        self.items = items
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        rows, owner = [], []
        for k, own in enumerate(words):
            symbols = (np.searchsorted(self.vocabulary, own) + 1).astype(np.int32)
            if len(symbols) >= width:
                windows = np.lib.stride_tricks.sliding_window_view(symbols, width)
            else:
                windows = np.pad(symbols, (0, width - len(symbols)))[None, :] if len(symbols) else np.zeros((0, width), np.int32)
            rows.append(windows)
            owner.append(np.full(len(windows), k))
        every = np.concatenate(rows) if rows else np.zeros((0, width), np.int32)
        self.symbols, phrase = np.unique(every, axis=0, return_inverse=True)
        self.length = (self.symbols > 0).sum(1)
        pairs = np.unique(np.stack([phrase.ravel(), np.concatenate(owner) if owner else phrase.ravel()], 1), axis=0)
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.symbols) + 1))
        self.owner = pairs[:, 1]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling. Every 0 is a separator that differs from all others; the last symbol must be one."""
    zero = text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + int(zero.sum()))
    sa = np.argsort(rank, kind="stable")
    group = _groups(rank[sa][1:] != rank[sa][:-1])
    rank[sa] = group
    k = 1
    while True:
        tied = np.zeros(len(sa), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            return sa
        old, after = group[at], rank[sa[at] + k]
        order = np.lexsort((after, old))
        sa[at], after, old = sa[at][order], after[order], old[order]
        fresh = _groups((old[1:] != old[:-1]) | (after[1:] != after[:-1]))
        group[at] = at[fresh]
        rank[sa[at]] = group[at]
        k *= 2


def _groups(differs: np.ndarray) -> np.ndarray:
    """For each row the first row of its group, from where neighbours differ."""
    first = np.concatenate([[True], differs])
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))


class WaveletMatrix:
    """Ranks of symbols in a sequence: ``rank(c, i)`` occurrences of c before place i, for arrays of both."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (sequence >> b) & 1
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)])
            self.levels.append((b, ones, len(sequence) - int(ones[-1])))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        start = np.zeros(len(symbol), np.int64)
        for b, ones, zeros in self.levels:
            up = ((symbol >> b) & 1).astype(bool)
            place = np.where(up, zeros + ones[place], place - ones[place])
            start = np.where(up, zeros + ones[start], start - ones[start])
        return place - start


class FMIndex:
    """Finds symbol phrases in a text in which each 0 separates; the text ends with one."""

    def __init__(self, text: np.ndarray, symbols: int, step: int = 8):
        sa = suffix_array(text)
        self.last = text[sa - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.ranks = WaveletMatrix(self.last, max(1, int(symbols).bit_length()))
        sampled = (sa % step == 0) | (self.last == 0)
        self.sample_rank = np.cumsum(sampled) - 1
        self.sampled, self.sample = sampled, sa[sampled]

    def search(self, phrase: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that start with each phrase."""
        lo, hi = np.zeros(len(phrase), np.int64), np.zeros(len(phrase), np.int64)
        open_ = np.flatnonzero(length > 0)
        c = phrase[open_, length[open_] - 1]
        lo[open_], hi[open_] = self.below[c], self.below[c + 1]
        for back in range(2, int(length.max(initial=0)) + 1):
            open_ = open_[(length[open_] >= back) & (lo[open_] < hi[open_])]
            if not len(open_):
                break
            c = phrase[open_, length[open_] - back]
            lo[open_] = self.below[c] + self.ranks.rank(c, lo[open_])
            hi[open_] = self.below[c] + self.ranks.rank(c, hi[open_])
        return lo, np.maximum(lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text places of suffix rows: steps back to a sampled one."""
        row, out, back = row.copy(), np.zeros(len(row), np.int64), 0
        open_ = np.arange(len(row))
        while len(open_):
            here = row[open_]
            done = self.sampled[here]
            out[open_[done]] = self.sample[self.sample_rank[here[done]]] + back
            open_, here = open_[~done], here[~done]
            c = self.last[here]
            row[open_] = self.below[c] + self.ranks.rank(c, here)
            back += 1
        return out


def _found(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in a shard: first word, word behind, phrase."""
    none = np.zeros(0, np.int64)
    if not len(phrases.symbols) or not len(words.hash):
        return none, none, none
    at = np.minimum(np.searchsorted(phrases.vocabulary, words.hash), len(phrases.vocabulary) - 1)
    place = np.arange(len(words.hash)) + words.row
    text, word_of = np.zeros(place[-1] + 2, np.int32), np.zeros(place[-1] + 2, np.int64)
    text[place], word_of[place] = np.where(phrases.vocabulary[at] == words.hash, at + 1, 0), np.arange(len(place))
    index = FMIndex(text, len(phrases.vocabulary))
    lo, hi = index.search(phrases.symbols, phrases.length)
    n = hi - lo
    phrase = np.repeat(np.arange(len(n)), n)
    row = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[phrase]
    first = word_of[index.locate(row)]
    return first, first + phrases.length[phrase], phrase


def _lists(row: np.ndarray, values: pa.Array, rows: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)), values)


def _search(shared: list[Broadcast], text: int, texts: str, names: list[str], inside: np.ndarray):
    """Adds to each row its words, merged spans and items; the last four columns hold what earlier passes found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in blocks(batch, text):
                words, rows, before = Words(raw, at, inside), part.num_rows, part.num_columns - 4
                words_of = words.counts(rows)
                base = np.cumsum(words_of) - words_of
                edge = np.zeros(len(words.hash) + 1, np.int64)
                for k, sign in ((1, 1), (2, -1)):
                    earlier = part.column(before + k)
                    np.add.at(edge, earlier.flatten().to_numpy() + np.repeat(base, earlier.value_lengths().to_numpy()), sign)
                own = part.column(before + 3)
                held = [(np.repeat(np.arange(rows), own.value_lengths().to_numpy()), own.flatten().to_numpy(zero_copy_only=False))]
                for phrases in (b.value for b in shared):
                    first, behind, phrase = _found(words, phrases)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, behind, -1)
                    n = phrases.first[phrase + 1] - phrases.first[phrase]
                    owner = phrases.owner[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(phrases.first[phrase], n)]
                    pairs = np.unique(np.stack([np.repeat(words.row[first], n), owner], 1), axis=0)
                    item = np.array(phrases.items, object)[pairs[:, 1]]
                    named = np.not_equal(item, None).astype(bool)
                    held.append((pairs[named, 0], item[named]))
                hit = np.cumsum(edge[:-1]) > 0
                begins, ends = hit.copy(), hit.copy()
                new_row = words.row[1:] != words.row[:-1]
                begins[1:] &= ~hit[:-1] | new_row
                ends[:-1] &= ~hit[1:] | new_row
                a, b = np.flatnonzero(begins), np.flatnonzero(ends)
                row = words.row[a]
                item_row = np.concatenate([r for r, _ in held])
                order = np.argsort(item_row, kind="stable")
                items = pa.array(np.concatenate([v for _, v in held])[order].tolist(), pa.string())
                own = list(part.columns[:before])
                if texts == "clean":
                    own[text] = _without(part.column(text), raw, at, row, words.start[a], words.end[b])
                elif texts == "drop":
                    own[text] = pa.nulls(rows, pa.string())
                own += [pa.array(words_of), _lists(row, pa.array(a - base[row]), rows), _lists(row, pa.array(b + 1 - base[row]), rows), _lists(item_row, items, rows)]
                yield pa.RecordBatch.from_arrays(own, names)

    return run


def _without(column: pa.Array, raw: np.ndarray, at: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts with a space in place of each byte span."""
    if not len(row):
        return column.cast(pa.string())
    texts = column.to_pylist()
    for r in np.unique(row):
        own, pieces, here = row == r, [], at[r]
        for s, e in zip(start[own], end[own], strict=True):
            pieces.append(raw[here:s].tobytes())
            here = e
        texts[r] = b" ".join([*pieces, raw[here : at[r + 1]].tobytes()]).decode()
    return pa.array(texts, pa.string())


def _item_words(inside: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in blocks(batch, 1):
                words = Words(raw, at, inside)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(words.row, pa.array(words.hash.view(np.int64)), part.num_rows)], ["item", "words"])

    return run


def phrase_blocks(benchmark: DataFrame, width: int, item_id: str = "item_id", text: str = "text") -> Iterator[Broadcast]:
    """The benchmark's windows as broadcast blocks, each of about ``BLOCK_BYTES`` of text, made as they are drawn from one table dealt by block."""
    inside = byte_class("alnum")
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size // BLOCK_BYTES)
    if n > 1:  # read again by block, from files that hold one block's rows or few
        rows = cut(rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))).repartition("block").sortWithinPartitions("block"))
    for k in range(n):
        block = rows.where(F.col("block") == k) if n > 1 else rows
        own = block.select("item", "text").mapInArrow(_item_words(inside), "item string, words array<bigint>").toArrow()
        words = [np.array(w, np.int64).view(np.uint64) for w in own["words"].to_pylist()]
        yield benchmark.sparkSession.sparkContext.broadcast(Phrases(own["item"].to_pylist(), words, width))


def spans(docs: DataFrame, benchmark: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text", clean: bool = False, item_id: str = "item_id", benchmark_text: str = "text", found: tuple[str, ...] = ("n_words", "span_starts", "span_ends", "span_items")) -> DataFrame:
    """``docs`` with what benchmark windows cover in each text.

    Words are runs of ASCII letters (A-Z as a-z), digits and characters beyond ASCII; a window is ``width`` consecutive
    words of an item, or the whole item if it has fewer. Adds ``n_words``, ``span_starts`` and ``span_ends`` (words,
    end excluded, merged where they meet) and ``span_items`` (each item with an occurring window once; unordered), as
    named by ``found``; these names must not be among ``docs``'s columns. ``text`` comes back with one space for each span if ``clean``,
    else null.

    Null or empty texts, and all texts if the benchmark is empty, have no spans; items without words match nothing.
    Items without an id cover words like others, but aren't in ``span_items``; rows with one id are one item there.
    Equal rows get equal results; an empty table gives none. No row is shuffled; a task holds one shard's index and
    ``BLOCKS_A_PASS`` blocks of phrases; more blocks take more passes over the rows, each
    kept in the checkpoint folder before the next.
    """
    names = [*docs.columns, *found]
    at, inside = docs.columns.index(text), byte_class("alnum")
    kept = [F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    out = docs.select(*kept, F.lit(0).cast("bigint").alias(found[0]), *[F.array().cast(f"array<{kind}>").alias(c) for kind, c in zip(("bigint", "bigint", "string"), found[1:], strict=True)])
    schema = out.schema
    for f in schema.fields:
        f.nullable = True
    shared = phrase_blocks(benchmark, width, item_id, benchmark_text)
    own = list(islice(shared, BLOCKS_A_PASS))
    while True:
        later = list(islice(shared, BLOCKS_A_PASS))
        texts = "keep" if later else "clean" if clean else "drop"
        out = map_arrow(out, _search(own, at, texts, names, inside), schema)
        if not later:
            break
        out = cut(out)
        for broadcast in own:
            broadcast.destroy()
        own = later
    return out.withColumn(found[3], F.array_distinct(found[3]))


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its id, n_words, n_hit (words in spans), n_items, items_sha256 (of the sorted ids joined by commas) and contaminated."""
    rows = spans(docs.select(doc_id, text), benchmark, width, doc_id, text)
    hit = F.aggregate(F.zip_with("span_starts", "span_ends", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return rows.select(
        doc_id,
        "n_words",
        hit.alias("n_hit"),
        F.size("span_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("span_items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each merged span of benchmark words replaced by one space; every row and all other columns stay, whatever their names."""
    found = tuple(free_names(docs.columns, "n_words", "span_starts", "span_ends", "span_items"))
    return spans(docs, benchmark, width, doc_id, text, clean=True, found=found).select(*columns(docs))
