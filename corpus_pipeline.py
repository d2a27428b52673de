"""The training corpus from ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``docs``, whatever their names, with ``n_chars`` as the text then has.

Null, empty and letterless texts have no known language and go in the first stage. Later stages keep a null or empty
text that reaches them, and a row without an id, which is compared with nothing. Rows that repeat an id count as one
document for what is compared; among equal lines or documents the least id stays. Texts are read whole, however long.
No documents give no rows.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.llm import decontamination, jaccard_join, language_id, line_dedup, packing
from ticklake.llm._spark import checkpoint_folder, columns, cut, free_names, small_side

#: Least share of the posterior with which a document's language counts as known.
LEAST_SCORE = 0.5


def _sized(docs: DataFrame, like: DataFrame) -> DataFrame:
    if "n_chars" not in like.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(like.schema["n_chars"].dataType))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a known language; texts without a letter and uncertain ones go."""
    trees = language_id.train(docs)
    names = free_names(docs.columns, "lang_pred", "score", "bits")
    known = language_id.identify(docs, trees, keep=docs.columns, names=tuple(names))
    return known.where((F.col(names[0]) != language_id.UNKNOWN) & (F.col(names[1]) >= LEAST_SCORE)).select(*columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; a document of which no line is left goes."""
    before, after = free_names(docs.columns, "lines_before", "lines_after")
    left = line_dedup.dedup(docs, counts=(before, after))
    return _sized(left.where((F.col(after) > 0) | (F.col(before) == 0)).select(*columns(docs)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by five-word shingles at a similarity of 0.8."""
    linked = jaccard_join.link(docs, size=5, percent=80)
    copies = small_side(cut(linked.where("doc_id <> component_id").select("doc_id").distinct()))
    return docs.join(copies, "doc_id", "left_anti").select(*columns(docs))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share with benchmark items."""
    return _sized(decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, one per piece of a document."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmarks),
    ("packing", sequences),
]
#: SQL can state neither the language model nor the tokens; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is kept in the shared checkpoint folder."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_folder(spark)}/{spark.sparkContext.applicationId}/corpus-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
