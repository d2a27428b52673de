"""A bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.llm._spark import cut


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``text`` and ``y`` (0 or 1) of about ``most`` labelled documents, drawn by a hash of the id.

    A document labelled more than once has its greatest label. Rows without id, text or label are left out. The drawn
    labels are broadcast, as ``most`` bounds them.
    """
    own = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg((F.max(label) > 0).cast("int").alias("y"))
    own = cut(own)
    rate = min(1.0, most / max(1, own.count()))
    drawn = own.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_003)) < rate * 1_000_003)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    return rows.join(F.broadcast(drawn), "id")
