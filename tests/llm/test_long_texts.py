"""One text of ten megabytes beside short ones, for the operators that read whole texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ticklake.llm import collocations, jaccard_join, lm_scoring, merkle, quality, toxicity

WORDS = [f"{a}{b}{c}" for a in "bdgkl" for b in "aeio" for c in ("n", "r", "st", "")]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    long = text(2_600_000)
    rows = [(0, long), (1, long[: len(long) - 4] + " zzz"), *((k, text(40) + (" bad awful" if k % 2 else " fine good")) for k in range(2, 60)), (60, ""), (61, None)]
    assert len(long) > 10_000_000
    return spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(2, 50)], "doc_id bigint, quality int, toxic int")


def test_long_near_copies_are_linked(docs):
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link(docs, 4, 85).collect()}
    assert got == {k: 0 if k == 1 else k for k in range(62)}


def test_long_texts_are_scored(docs, labels):
    for scored in (toxicity.score(docs, toxicity.train(docs, labels)), quality.score(docs, quality.train(docs, labels))):
        assert sorted(r["doc_id"] for r in scored.where(F.col("score").between(0, 1)).collect()) == list(range(62))


def test_long_texts_are_weighed_by_language_models(docs, labels):
    got = lm_scoring.score(docs, lm_scoring.train(docs, labels.where("quality = 1")))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(62))


def test_long_texts_are_counted_and_labelled(docs):
    n = {r["lang"]: r["n"] for r in collocations.phrases(docs)[2].collect()}
    assert n == {"en": 2_600_000 * 2 + 58 * 42}
    assert merkle.verify(docs, F.lit(False)).where("verified").count() == 62
