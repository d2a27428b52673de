"""Phrases whose words keep company, counted with a bidirectional FM-index per shard of the corpus.

A shard is a few MB of one partition's texts as word ids; 0 stands where a phrase can't go on: at a piece's end, at words
that are too rare and between phrases that are. Its index is the Burrows-Wheeler transform, as a
wavelet matrix, of the ids and of the ids backwards. A phrase is one interval in each; one step gives all words that stand
right (or left) of all phrases, with their counts. Suffixes are ordered no deeper than phrases are long. Shards' counts
are summed by Spark.

A phrase is frequent only if all phrases in it are, so shards learn which words, then pairs, then phrases of one word
more are frequent over the whole corpus, and are cut down to these before they go on: by broadcast while these are few,
else each shard its own by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklake.llm._spark import cut, cut_at, kept_folder, map_arrow, remove
from ticklake.llm._text import LOWER, Words, blocks, mix
from ticklake.llm.merkle import ranked

SHARD_BYTES = 4_000_000
#: Positions of a shard whose extensions are looked up at once.
SPAN = 400_000
#: Frequent words, and phrases of one length, up to which they are broadcast; words take some 20 bytes each, phrases 8.
BROADCAST_WORDS, BROADCAST_PHRASES = 1_000_000, 2_000_000

ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
INSIDE = ~ENDS
INSIDE[[0x20, 0x09]] = False


LOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A bit vector with the number of ones before any place: 64 bits and a count to a word."""

    def __init__(self, bit: np.ndarray):
        packed = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
        packed[: -(-len(bit) // 8)] = np.packbits(bit, bitorder="little")
        self.words = packed.view(np.uint64)
        count = np.bitwise_count(self.words).astype(np.int64)
        self.total = int(count.sum())
        self.before = (np.cumsum(count) - count).astype(np.int32)

    def ones(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & LOW[place & 63])


class Wavelet:
    """A wavelet matrix that lists the symbols of intervals."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (sequence >> b & 1).astype(bool)
            ones = Bits(bit)
            self.levels.append((ones, len(sequence) - ones.total))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])
        first = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1]]))
        self.start = np.zeros(1 << bits, np.int32)  # of each symbol's run below the last level
        self.start[sequence[first]] = first

    def symbols(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """Interval, symbol, and the symbol's occurrences before lo and before hi, by interval, symbols ascending."""
        of, symbol = np.arange(len(lo), dtype=np.int32), np.zeros(len(lo), np.int32)
        for ones, zeros in self.levels:
            a, b = ones.ones(lo), ones.ones(hi)
            both = lambda x, y: np.stack([x, y], 1).ravel()
            lo, hi = both(lo - a, zeros + a), both(hi - b, zeros + b)
            of, symbol = np.repeat(of, 2), both(2 * symbol, 2 * symbol + 1)
            there = lo < hi
            of, symbol, lo, hi = of[there], symbol[there], lo[there], hi[there]
        return of, symbol, lo - self.start[symbol], hi - self.start[symbol]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """An order of the suffixes by their first ``depth`` symbols, by doubling; those alike so far stand in any order."""
    rank, known = text.astype(np.int64), 1
    order = np.argsort(rank)
    while known < depth:
        step = min(known, depth - known)
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key)
        held = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], held[1:] != held[:-1]]))
        known += step
    return order


class Side:
    """The index of one direction: what stands before each suffix, and where each symbol's suffixes begin."""

    def __init__(self, text: np.ndarray, depth: int, symbols: int):
        self.wave = Wavelet(text[suffix_order(text, depth) - 1], max(1, symbols.bit_length()))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))]).astype(np.int32)


class Index:
    """A bidirectional index of symbols 1 to ``symbols`` in a text that begins and ends with 0; it extends phrases of up to ``depth`` words."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        self.symbols, side = symbols, [Side(text[::-1], depth, symbols), Side(text, depth, symbols)]
        self.right, self.left = side  # extending right reads the text backwards

    def single(self) -> Phrases:
        words = np.arange(1, self.symbols + 1, dtype=np.int32)
        return Phrases(words[:, None], *[s.below[words + k] for s in (self.left, self.right) for k in (0, 1)])

    def extend(self, of: Phrases, right: bool) -> Phrases:
        """All phrases of one word more on that side."""
        side, own, other = (self.right, of.back, of.ahead) if right else (self.left, of.ahead, of.back)
        found = [side.wave.symbols(own[0][s], own[1][s]) for s in of.parts()]
        base = [s.start for s in of.parts()]
        if not found:
            none = np.zeros(0, np.int32)
            return Phrases(np.zeros((0, of.words.shape[1] + 1), np.int32), none, none, none, none)
        which = np.concatenate([f[0] + np.int32(b) for f, b in zip(found, base, strict=True)])
        symbol, a, b = (np.concatenate([f[k] for f in found]) for k in (1, 2, 3))
        width = b - a
        before = np.cumsum(width, dtype=np.int32) - width
        first = np.searchsorted(which, np.arange(len(of.words)))  # every interval holds a symbol
        lo = other[0][which] + before - before[first][which]  # suffixes after the phrase, by the next symbol
        on = symbol > 0
        which, symbol, a, b, lo, width = (x[on] for x in (which, symbol, a, b, lo, width))
        mine, theirs = (side.below[symbol] + a, side.below[symbol] + b), (lo, lo + width)
        words = np.column_stack([of.words[which], symbol] if right else [symbol, of.words[which]])
        return Phrases(words, *(theirs + mine if right else mine + theirs))


class Phrases:
    """Phrases, a row of symbols each, with their intervals among the suffixes (``ahead``) and among those of the text backwards (``back``)."""

    def __init__(self, words: np.ndarray, lo: np.ndarray, hi: np.ndarray, back_lo: np.ndarray, back_hi: np.ndarray):
        self.words, self.ahead, self.back = words, (lo, hi), (back_lo, back_hi)

    @property
    def n(self) -> np.ndarray:
        return self.ahead[1] - self.ahead[0]

    def where(self, kept: np.ndarray) -> Phrases:
        return Phrases(self.words[kept], *(x[kept] for x in (*self.ahead, *self.back)))

    def parts(self) -> list[slice]:
        """Slices of phrases with about ``SPAN`` occurrences each."""
        edges = np.flatnonzero(np.diff(np.cumsum(self.n) // SPAN)) + 1
        return [slice(a, b) for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(self.words)], strict=True) if a < b]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part, raw, at in blocks(batch, 0, SHARD_BYTES):
            words = Words(raw, at, INSIDE)
            if not len(words.start):
                continue
            lang = part.column(1).fill_null("und").dictionary_encode()
            row_lang = lang.indices.to_numpy()[words.row]
            code, found = pd.factorize(mix(words.hash + row_lang.astype(np.uint64)))
            first = np.zeros(len(found), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            piece = np.cumsum(ENDS[raw])[words.start]
            fresh = np.concatenate([[True], (piece[1:] != piece[:-1]) | (words.row[1:] != words.row[:-1])])
            text = np.zeros(len(code) + int(fresh.sum()) + 1, np.int32)
            text[np.arange(len(code)) + np.cumsum(fresh)] = code + 1
            lowered = LOWER[raw]
            names = [lowered[s:e].tobytes() for s, e in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]
            counted = pa.StructArray.from_arrays([lang.dictionary.take(pa.array(row_lang[first])), pa.array(names, pa.binary()).cast(pa.string()), pa.array(np.bincount(code))], ["lang", "word", "n"])
            n_of = np.bincount(row_lang, minlength=len(lang.dictionary))
            totals = pa.StructArray.from_arrays([lang.dictionary, pa.array(n_of)], ["lang", "n"])
            one = lambda items: pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + k]), _packed(text), pa.array([len(text)]), one(counted), one(totals)], ["shard", "text", "size", "words", "totals"])
            k += 1


SHARD = "shard bigint, text binary, size bigint, words array<struct<lang: string, word: string, n: bigint>>, totals array<struct<lang: string, n: bigint>>"


def _packed(text: np.ndarray) -> pa.Array:
    """The words' lowest bytes, then their next ones, and so on, compressed."""
    planes = np.ascontiguousarray(text.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return pa.array([pa.compress(planes.tobytes(), "zstd", asbytes=True)], pa.binary())


def _text(held: pa.Scalar, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(held.as_buffer(), 4 * size, "zstd"), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _single_zeros(text: np.ndarray) -> np.ndarray:
    """The text, which begins with 0, without zeros after zeros, and with one at its end."""
    text = text[np.concatenate([[True], (text[1:] != 0) | (text[:-1] != 0)])]
    return text if text[-1] == 0 else np.append(text, text.dtype.type(0))


def _renamed(text: np.ndarray, code: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The text in the words of its codes, 0 for codes without."""
    name = np.zeros(int(max(text.max(initial=0), code.max(initial=0))) + 1, np.int32)
    name[code] = word
    return _single_zeros(name[text])


SHARD_OF_WORDS = "shard bigint, text binary, size bigint"


def _keys(lang: pa.Array, word: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(lang, word, "\x01")


def _rename_by(words: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = words.value
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column(3)[k].values
                place = pc.index_in(_keys(own.field("lang"), own.field("word")), known)
                code = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
                text = _renamed(_text(batch.column(1)[k], batch.column(2)[k].as_py()), code + 1, ids[place.drop_null().to_numpy()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), _packed(text), pa.array([len(text)])], ["shard", "text", "size"])

    return run


def _rename_own(shard: pa.Table, known: pa.Table) -> pa.Table:
    """The same with the shard's own frequent words (code, id)."""
    text = _renamed(_text(shard["text"][0], shard["size"][0].as_py()), known["code"].to_numpy(), known["id"].to_numpy()) if shard.num_rows else np.zeros(1, np.int32)
    return pa.table([shard["shard"], _packed(text).slice(0, shard.num_rows), pa.array([len(text)] * shard.num_rows, pa.int64())], ["shard", "text", "size"])


def _symbols(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text in symbols from 1 on, and the word of each symbol (of 0: 0)."""
    words = np.unique(np.append(text, text.dtype.type(0)))
    name = np.zeros(int(words[-1]) + 1, np.int32)
    name[words] = np.arange(len(words))
    return name[text], words.astype(np.int64)


def _columns(words: list[np.ndarray]) -> list[np.ndarray]:
    """The words of phrases, place by place, two to a whole number of 64 bits."""
    return [words[k].astype(np.int64) << 32 | (words[k + 1] if k + 1 < len(words) else 0) for k in range(0, len(words), 2)]


def _named(columns: list[np.ndarray]) -> np.ndarray:
    """64 bits for each phrase. Two that share them are both looked at further; counts are of the phrases themselves."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = mix(out + c.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _keep(text: np.ndarray, length: int, known: np.ndarray) -> np.ndarray:
    """The text's runs of words in which each phrase of ``length`` words is among the sorted ``known``, parted by 0."""
    n = len(text) - length + 1
    if n < 1 or not len(known):
        return np.zeros(1, np.int32)
    words = [text[k : k + n] for k in range(length)]
    whole = np.logical_and.reduce([w > 0 for w in words])
    name = _named(_columns(words))
    found = whole & (known[np.minimum(np.searchsorted(known, name), len(known) - 1)] == name)
    edge = np.diff(np.concatenate([[False], found, [False]]).astype(np.int8))
    first, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1) + length - 1
    run = np.repeat(np.arange(len(first)), size)
    at = np.arange(len(run)) - (np.cumsum(size) - size)[run] + first[run]
    out = np.zeros(len(run) + len(first) + 1, np.int32)
    out[np.arange(len(run)) + run + 1] = text[at]
    return out


def _count(length: int):
    names = ["shard", *[f"k{k}" for k in range((length + 1) // 2)], "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard's phrases of ``length`` words with their counts."""
        for batch in batches:
            for k in range(batch.num_rows):
                text, words = _symbols(_text(batch.column(1)[k], batch.column(2)[k].as_py()))
                if len(words) == 1:
                    continue
                index, right = Index(text, len(words) - 1, length - 1), True
                found = index.single()
                for _ in range(length - 1):
                    found, right = index.extend(found, right), not right  # either side gives all phrases
                columns = _columns(list(words[found.words].T))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(found.words), batch.column(0)[k].as_py()), *columns, found.n.astype(np.int64))], names)

    return run, ", ".join(f"{c} bigint" for c in names)


def _keep_by(known: Broadcast, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = _keep(_text(batch.column(1)[k], batch.column(2)[k].as_py()), length, known.value)
                if len(text) > 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), _packed(text), pa.array([len(text)])], ["shard", "text", "size"])

    return run


def _keep_own(length: int):
    def run(shard: pa.Table, known: pa.Table) -> pa.Table:
        text = np.zeros(1, np.int32)
        if shard.num_rows and known.num_rows:
            columns = [known[c].to_numpy() for c in known.column_names if c != "of"]
            text = _keep(_text(shard["text"][0], shard["size"][0].as_py()), length, np.sort(_named(columns)))
        n = int(len(text) > 1)
        return pa.table([shard["shard"].slice(0, n), _packed(text).slice(0, n), pa.array([len(text)] * n, pa.int64())], ["shard", "text", "size"])

    return run


def phrases(docs: DataFrame, least: int = 100, most: int = 5, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: frequent words (id, lang, word, n), frequent phrases (ids, n) and word counts by lang (lang, n).

    Texts in lower case (A-Z only) are cut at ``[.,;:!?]`` and line ends into pieces, those at spaces and tabs into words;
    a null lang is ``und``. A phrase is two to ``most`` consecutive words of a piece; n counts all its occurrences in texts
    of its lang, and it is frequent from ``least`` on. What extends a phrase left or right are the phrases of one word more.

    Null and empty texts hold nothing; a text of any length is read whole, as a shard of its own where it is longer than
    one; repeated rows count each. Word ids are the tables' own. A word is told from others of its shard by 64 bits.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    folder = kept_folder(spark, "shards")
    shards = cut_at(map_arrow(rows, _shards, SHARD), folder)
    totals = cut(shards.select(F.explode("totals").alias("t")).groupBy("t.lang").agg(F.sum("t.n").alias("n")))
    held = shards.select("shard", F.posexplode("words").alias("code", "w")).select("shard", (F.col("code") + 1).cast("bigint").alias("code"), "w.*")
    words = held.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = ranked(words.withColumn("all", F.lit(0)), "all", ["lang", "word"])
    words = cut(words.select((F.col("rank") + 1).alias("id"), "lang", "word", "n"))
    if words.count() <= BROADCAST_WORDS:
        own = words.select("id", "lang", "word").toArrow().combine_chunks()
        known = _keys(own["lang"], own["word"]).combine_chunks() if own.num_rows else pa.array([], pa.string())
        named = shards.select("shard", "text", "size", "words").mapInArrow(_rename_by(sc.broadcast((known, own["id"].to_numpy()))), SHARD_OF_WORDS)
    else:
        known = held.join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("shard").alias("of"), "code", "id")
        named = shards.select("shard", "text", "size").groupBy("shard").cogroup(known.groupBy("of")).applyInArrow(_rename_own, SHARD_OF_WORDS)
    last, folder, out = folder, kept_folder(spark, "shards"), None
    named = cut_at(named, folder)
    remove(spark, last)  # all that is made of them so far is kept
    for length in range(2, most + 1):
        run, schema = _count(length)
        found, keys = named.mapInArrow(run, schema), [f"k{k}" for k in range((length + 1) // 2)]
        frequent = cut(found.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") >= least))
        halves = [x for k in keys for x in (F.shiftright(k, 32), F.col(k).bitwiseAND(0xFFFFFFFF))][:length]
        own = frequent.select(F.array(*halves).alias("ids"), "n")
        out = own if out is None else out.unionByName(own)
        if length == most:
            break
        if frequent.count() <= BROADCAST_PHRASES:
            held = frequent.select(*keys).toArrow()
            known = np.sort(_named([held[k].to_numpy() for k in keys]))
            named = named.mapInArrow(_keep_by(sc.broadcast(known), length), SHARD_OF_WORDS)
        else:
            known = found.select(F.col("shard").alias("of"), *keys).join(frequent.select(*keys), keys).select("of", *keys)
            named = named.groupBy("shard").cogroup(known.groupBy("of")).applyInArrow(_keep_own(length), SHARD_OF_WORDS)
        last, folder = folder, kept_folder(spark, "shards")
        named = cut_at(named, folder)
        remove(spark, last)
    return words, cut(out), totals


def mine(docs: DataFrame, least: int = 100, most: int = 5, percent: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """Collocations: lang, phrase, n_words, a (its occurrences), l, r, n, score, cut; unordered.

    Of the cuts of a phrase in two parts with l and r occurrences, that of the least score floor(1000 a n / (l r)) counts, the
    first of equal ones; n are all words of the lang. A phrase that lies in a longer frequent one with ``percent`` of its
    occurrences or more is left out: if there is any such, one word more is enough, as counts only fall with length.
    Products are decimals of 38 digits. See ``phrases`` for words, nulls and counts; no texts give no rows.
    """
    words, found, totals = phrases(docs, least, most, text, lang)
    counts = found.select("ids", "n").unionByName(words.select(F.array("id").alias("ids"), "n"))
    part = lambda name, at: counts.select(F.col("ids").alias(f"{name}_ids"), F.col("n").alias(at))
    size = F.size("ids")
    longer = found.where(size > 2).select(F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), "n")
    longer = longer.groupBy("ids").agg(F.max("n").alias("longer"))
    alone = found.join(longer, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(38,0)") < percent * F.col("n").cast("decimal(38,0)"))).drop("longer")
    of_lang = words.select(F.col("id").alias("first_id"), "lang").join(totals.withColumnRenamed("n", "total"), "lang")
    rows = alone.withColumn("first_id", F.col("ids")[0]).join(of_lang, "first_id").drop("first_id")
    cuts = rows.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.withColumns({"left_ids": F.slice("ids", F.lit(1), F.col("cut")), "right_ids": F.slice("ids", F.col("cut") + 1, size - F.col("cut"))})
    cuts = cuts.join(part("left", "l"), "left_ids").join(part("right", "r"), "right_ids")
    cuts = cuts.withColumn("score", F.expr("(cast(n as decimal(38,0)) * total * 1000) div (cast(l as decimal(38,0)) * r)"))
    least_cut = F.min(F.struct("score", "cut", "l", "r")).alias("best")
    scored = cuts.groupBy("ids", "lang", F.col("n").alias("a"), F.col("total").alias("n")).agg(least_cut)
    return cut(scored.select("ids", "lang", "a", "n", "best.*")).transform(_with_phrase, words)


def _with_phrase(scored: DataFrame, words: DataFrame) -> DataFrame:
    names = scored.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    texts = names.groupBy("ids").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    return scored.join(texts, "ids").select("lang", "phrase", F.size("ids").alias("n_words"), "a", "l", "r", "n", "score", "cut")


def top(found: DataFrame, k: int = 2000) -> DataFrame:
    """``mine``'s first ``k`` rows of each lang, by score and occurrences descending, then by phrase, bytewise, with their ``rank`` from 1."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
