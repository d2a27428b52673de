"""The pipeline's stages on a small corpus, each on what the one before kept."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ticklake.llm import queries

LANGS = {"aa": ["tak", "mol", "sen", "vip", "kor"], "bb": ["oui", "eau", "ment", "tion", "elle"]}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    root = tmp_path_factory.mktemp("sf")
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(1, 3))) for _ in range(150)] for k, v in LANGS.items()}
    line = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    leaked = line("aa", 30)
    rows = []
    for k in range(40):
        lang = "aa" if k % 2 else "bb"
        rows.append((k, "\n".join(line(lang, 25) for _ in range(4)), lang))
    rows.append((40, rows[0][1], "bb"))  # an exact copy: no line is left
    near = rows[1][1].split()
    near[10], near[30] = "neu", "alt"
    one = " ".join(near)
    rows.append((41, one, "aa"))  # one line, near document 42
    near[50] = "neu"
    rows.append((42, " ".join(near[:-1]) + " x y", "aa"))
    rows.append((43, f"{line('aa', 20)} {leaked.upper()} {line('aa', 20)}", "aa"))
    rows += [(44, "12345 !!", "aa"), (45, None, "aa"), (46, "", None)]
    docs = spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, leaked), (2, None)], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
    ids = {k: {r["doc_id"] for r in d.select("doc_id").collect()} for k, d in kept.items()}
    assert set(range(46)) - ids["language_id"] == {44, 45} and 46 not in ids["language_id"]
    assert ids["language_id"] - ids["line_dedup"] == {40}
    assert ids["line_dedup"] - ids["ngram_jaccard_join"] <= {41, 42} and ids["benchmark_decontamination"] == ids["ngram_jaccard_join"] == ids["packing"]
    clean = kept["benchmark_decontamination"].where("doc_id = 43").first()
    assert len(clean["text"].split()) == 40 and clean["n_chars"] == len(clean["text"])
    sizes = kept["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert sizes.where("n <> t").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == kept["packing"].count()


def test_stages_on_no_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_ten_operators_and_the_pipeline_are_registered():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [*(f"op{k}" for k in range(1, 14)), "pipeline"] and set(queries.ORACLES) <= set(names)
