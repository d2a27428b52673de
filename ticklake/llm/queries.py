"""Registered queries of this subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ticklake.llm import collocations, decontamination, html_extraction, jaccard_join, language_id, line_dedup, lm_scoring, merkle, oracles, packing, quality, toxicity, vector_dedup, warc
from ticklake.llm._spark import fold, kept_folder, table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"), size=4, percent=85)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_kept"))
    return kept.select("doc_id", "n_lines", "n_kept", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


OP3_SQL = r"""
with raw as (
  select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as line from documents where text is not null
), lines as (
  select doc_id, line, raw, trim(regexp_replace(lower(raw), '[\x20\x09-\x0D]+', ' ', 'g')) as norm from raw
), firsts as (
  select norm, min((doc_id, line)) as pos from lines where norm <> '' group by norm
), long as (
  select pos, string_split(norm, ' ') as w from firsts where len(string_split(norm, ' ')) >= 5
), cut as (
  select pos, len(w) as n, i, list_concat(w[1:i - 1], w[i + 1:]) as rest from (select pos, w, unnest(range(1, len(w) + 1)) as i from long)
), replaced as (
  select pos, min(pos) over (partition by n, i, rest) as least from cut
), shorter as (
  select c.pos as longer, l.pos as shorter from cut c join long l on l.w = c.rest
), near as (
  select pos from replaced where least < pos union select longer from shorter where shorter < longer union select shorter from shorter where longer < shorter
), kept as (
  select pos from firsts where pos not in (select pos from near)
), marked as (
  select l.doc_id, l.line, l.raw, l.norm, l.norm <> '' and k.pos is not null as stays from lines l left join kept k on k.pos = (l.doc_id, l.line)
), rebuilt as (
  select doc_id, count(*) filter (norm <> '') as n_lines, count(*) filter (stays) as n_kept, coalesce(string_agg(raw, chr(10) order by line) filter (stays or norm = ''), '') as text from marked group by doc_id
)
select d.doc_id, coalesce(r.n_lines, 0) as n_lines, coalesce(r.n_kept, 0) as n_kept, sha256(case when d.text is not null then coalesce(r.text, '') end) as text_sha256
from documents d left join rebuilt r using (doc_id)
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = language_id.train(docs.where(fold("doc_id", 5) != 0))
    return language_id.identify(docs, trees).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scoring.score(docs, lm_scoring.train(docs, table(spark, sf_dir, "labels").where("quality = 1")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold("doc_id", 3) != 1))
    return toxicity.score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(fold("doc_id", 4) != 2))
    return quality.score(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.link(table(spark, sf_dir, "embeddings"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top(collocations.mine(table(spark, sf_dir, "documents"))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"), merkle.tampered())


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = kept_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), f"{folder}/written")
    warc.deduplicate(spark, f"{folder}/written", f"{folder}/deduplicated")
    found = warc.with_originals(warc.read(spark, f"{folder}/deduplicated", payloads=False))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_html_extraction": op5_html_extraction,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_decontamination": op10_decontamination,
    "op11_collocations": op11_collocations,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_warc": op13_warc,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op11_collocations": oracles.OP11_SQL, "op12_merkle_manifest": oracles.OP12_SQL, "op13_warc": oracles.OP13_SQL}
