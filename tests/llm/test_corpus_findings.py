"""What a review of the first round found missing."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ticklake.llm import decontamination, lm_scoring, queries


def test_lm_scoring_keeps_its_order_beyond_four_million_grams(spark):
    rng = np.random.default_rng(3)
    own = "the wanted words" * 40
    texts = [own, *["".join(map(chr, rng.integers(33, 127, 1_500_000))) for _ in range(3)]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    pair = lm_scoring.train(d, spark.createDataFrame([(0,)], "doc_id bigint"))
    assert pair.order == 4 and pair.counts.count() > 4_000_000
    probe = "the wanted noise"
    got = lm_scoring.score(spark.createDataFrame([(7, probe)], "doc_id bigint, text string"), pair).first()

    def loss(model, scale):
        model, total = ["\0" * 4 + t for t in model], 0.0
        data = "\0" * 4 + probe
        for k in range(4, len(data)):
            p = 1 / 256
            for j in range(5):
                context = data[k - j : k]
                after = scale * sum(_starts(t, context + data[k], 4 - j) for t in model)
                p = (after + 8 * p) / (scale * sum(_starts(t, context, 4 - j, 1) for t in model) + 8)
            total -= np.log2(p)
        return total / len(probe)

    assert abs(got["target_loss"] - loss([own], 1)) < 1e-5
    assert abs(got["background_loss"] - loss(texts, len(own) / sum(map(len, texts)))) < 1e-5


def test_packing_splits_at_added_tokens_as_tokenizers_does(spark, tmp_path):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    reference = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["one <|endoftext|> two", "<|endoftext|>", "<|endoftext|><|endoftext|>\n a", "x<|endoftext|", "  a  <|endoftext|>  b", "", None, "it's 12'345 日本語"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    whole = lambda d: {r["doc_id"]: r["doc_tokens"] for r in d.select("doc_id", "doc_tokens").distinct().collect()}
    want = {k: [*reference.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    assert 50256 in want[0]
    rows = corpus_pipeline.sequences(spark, docs, str(tmp_path)).orderBy("doc_id", "start").collect()
    assert {k: np.frombuffer(b"".join(r["ids"] for r in rows if r["doc_id"] == k), "<u4").tolist() for k in want} == want
    crcs = lambda d: sorted(map(tuple, d.collect()))
    op4 = queries.op4_packing(spark, str(tmp_path))
    assert whole(op4) == {k: len(v) for k, v in want.items()}
    assert crcs(op4.select("doc_id", "start", "ids_crc32")) == crcs(corpus_pipeline.sequences(spark, docs, str(tmp_path)).select("doc_id", "start", F.crc32("ids")))


def test_benchmark_rows_without_id_and_with_one_id(spark, monkeypatch):
    bench = spark.createDataFrame([(None, "alpha beta gamma"), (5, "delta epsilon"), (5, "zeta eta"), (5, "zeta eta")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x alpha beta gamma y"), (2, "delta epsilon and zeta eta")], "doc_id bigint, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for block, a_pass in ((2_000_000, 8), (10, 1)):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
        monkeypatch.setattr(decontamination, "BLOCKS_A_PASS", a_pass)
        got = {r["doc_id"]: tuple(r[1:]) for r in decontamination.report(docs, bench).collect()}
        assert got == {1: (5, 3, 0, sha(""), True), 2: (5, 4, 1, sha("5"), True)}
    clean = {r["doc_id"]: r["text"].split() for r in decontamination.decontaminate(docs, bench).collect()}
    assert clean == {1: ["x", "y"], 2: ["and"]}


def _starts(text: str, part: str, first: int, left: int = 0) -> int:
    """Places of ``part`` from ``first`` on, with ``left`` characters after it."""
    n, at = 0, text.find(part, first)
    while 0 <= at <= len(text) - len(part) - left:
        n, at = n + 1, text.find(part, at + 1)
    return n
