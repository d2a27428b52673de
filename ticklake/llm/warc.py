"""WARC archives as tables, and revisit resolution over them.

Records are written by Spark's text writer: a row is a whole record, and the line end that the writer adds is the
record's last character, so each part file is a gzipped WARC file wherever Spark can write. They are read as lines of
one file in order by one task, which joins them again and cuts records by their Content-Length, so that a payload may
hold anything, also what looks like a record. Only headers are shuffled; payloads are read where they lie.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.llm._spark import cut, small_side

# fixed values: names and the profile of the WARC format
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"
#: Rows of revisits, or of digests, up to which they are broadcast.
BROADCAST_ROWS = 200_000
#: How hard archives are compressed, by Hadoop's name for it.
LEVEL = "BEST_SPEED"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32, by four groups of 40 bits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), F.coalesce(F.concat(F.lit("i"), F.url_encode(page_id.cast("string"))), F.lit("n")), F.lit(">"))


def _uri(url: Column) -> Column:
    """The address without what would end its header line."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"\r", "%0D"), r"\n", "%0A"), r"\x00", "%00")


def _record(kind: Column, page_id: Column, url: Column, digest: Column, size: Column, payload: Column, refers_to: Column, refers_to_url: Column) -> Column:
    """A record's text but for its last line end. A revisit holds the HTTP header alone."""
    revisit = kind == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    length = F.octet_length(http) + F.when(revisit, F.lit(0).cast("bigint")).otherwise(size)
    head = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        field("WARC-Type", kind),
        field("WARC-Record-ID", _urn(page_id)),
        field("WARC-Target-URI", _uri(url)),  # none without an address
        field("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, field("WARC-Refers-To", _urn(refers_to))),
        F.when(revisit, field("WARC-Refers-To-Target-URI", _uri(refers_to_url))),
        F.lit("Content-Type: application/http; msgtype=response"),
        field("Content-Length", length.cast("string")),
    )
    return F.concat(head, F.lit("\r\n\r\n"), http, F.when(revisit, F.lit("")).otherwise(payload), F.lit("\r\n\r")).alias("value")


def _save(records: DataFrame, path: str, level: str) -> None:
    records.write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", level).text(path)


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", level: str = LEVEL) -> None:
    """A response record per row in gzipped WARC files under ``path``; a null html has an empty payload, a null address no header."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    none = F.lit(None).cast("string")
    _save(pages.select(_record(F.lit("response"), F.col(page_id), F.col(url).cast("string"), base32_sha1(payload), F.octet_length(payload).cast("bigint"), payload, none, none)), path, level)


class Archive:
    """Records of one file cut from its text as it comes; a record that isn't whole yet waits."""

    def __init__(self, path: str):
        self.path, self.held, self.wanted, self.number = path, bytearray(), 0, 0

    def add(self, text: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
        self.held += text
        at = 0
        while len(self.held) >= self.wanted:
            head = self.held.find(b"\r\n\r\n", at)
            if head < 0:
                self.wanted = len(self.held) + 1 - at
                break
            lines = self.held[at:head].decode("utf-8", "replace").split("\r\n")
            fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"{self.path} holds no record where one should start: {lines[0][:60]!r}")
            begin = head + 4
            end = begin + int(fields["content-length"])
            if len(self.held) < end + 4:
                self.wanted = end + 4 - at
                break
            yield self.number, fields, bytes(self.held[begin:end])
            self.number += 1
            at, self.wanted = end + 4, 0
        del self.held[:at]

    def close(self) -> None:
        if self.held:
            raise ValueError(f"{self.path} ends inside a record")


def _id(urn: str | None) -> str | None:
    """The page of a record's or reference's name, as it was encoded."""
    return urn[len(URN) + 2 : -1] if urn and urn.startswith(f"<{URN}i") else None


def _rows(path: str, found: Iterator[tuple[int, dict[str, str], bytes]], payloads: bool) -> Iterator[tuple]:
    for number, fields, block in found:
        kind = fields["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        payload = block[block.find(b"\r\n\r\n") + 4 :]
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        size = None
        if kind == "response":
            own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest and digest != own:
                raise ValueError(f"record {number} of {path} has payload digest {own}, not {digest}")
            digest, size = own, len(payload)
        yield path, number, kind, _id(fields.get("warc-record-id")), fields.get("warc-target-uri"), digest, size, _id(fields.get("warc-refers-to")), payload if payloads and kind == "response" else None


COLUMNS = {"file": pa.string(), "number": pa.int64(), "record_type": pa.string(), "page": pa.string(), "url": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers": pa.string(), "payload": pa.binary()}


def _parse(payloads: bool):
    schema = pa.schema([(c, kind) for c, kind in COLUMNS.items() if payloads or c != "payload"])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, rows, held = None, [], 0
        for batch in batches:
            paths, starts = batch.column(1), batch.column(2)
            code = paths.dictionary_encode().indices.to_numpy()
            edges = [0, *((code[1:] != code[:-1]).nonzero()[0] + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                path = paths[lo].as_py()
                if starts[lo].as_py():
                    raise ValueError(f"{path} was split; only gzipped archives can be read")
                if open_ is None or open_.path != path:
                    if open_ is not None:
                        open_.close()
                    open_ = Archive(path)
                text = b"\n".join(batch.column(0).slice(lo, hi - lo).to_pylist()) + b"\n"
                for row in _rows(path, open_.add(text), payloads):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) >= 5_000 or held >= 8_000_000:
                        yield batch_of(rows)
                        rows, held = [], 0
        if open_ is not None:
            open_.close()
        if rows:
            yield batch_of(rows)

    return run


def read(spark: SparkSession, path: str, id_type: str = "bigint", payloads: bool = True) -> DataFrame:
    """Response and revisit records of the gzipped archives under ``path``.

    Columns: file, number (place in it, from 0), record_type, page_id and url (null where the record has none),
    payload_digest, payload_bytes, refers_to (of a revisit) and, if asked for, payload (bytes). Digest and size of a
    response are those of the payload read; a stated digest that differs raises, as does an archive that ends inside a
    record. A revisit has the digest that it states and no size. Other record types are passed over. A task holds one
    record and one batch of lines; records of any size and payloads of any bytes are read whole.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    schema = "file string, number bigint, record_type string, page string, url string, payload_digest string, payload_bytes bigint, refers string" + ", payload binary" * payloads
    page = lambda c: F.url_decode(c).cast(id_type)
    return lines.mapInArrow(_parse(payloads), schema).select("file", "number", "record_type", page("page").alias("page_id"), "url", "payload_digest", "payload_bytes", page("refers").alias("refers_to"), *["payload"] * payloads)


def resolve(headers: DataFrame, least: int = 0) -> DataFrame:
    """Which record each record of ``headers`` (of ``read``) repeats: file, number, refers_to, refers_to_url and full_bytes (the payload's size), for those that repeat one.

    Of the responses with one payload of at least ``least`` bytes, the one of the smallest page_id is the original (null
    ids last; of equal ids the first record); all other records of its digest repeat it. A revisit whose digest no
    response has, or only smaller ones, isn't among the result. Headers meet at their digest: partial minima go there,
    so a digest with most records sends a row a task, and only digests with more than one record are joined back.
    """
    order = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("file"), F.col("number"))
    first = F.min(F.when(F.col("record_type") == "response", F.struct(order.alias("place"), F.struct("page_id", "url", "payload_bytes").alias("page"))))
    known = headers.where("payload_digest <> ''")
    originals = known.groupBy("payload_digest").agg(first.alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("first.page.payload_bytes") >= least))
    originals = cut(originals.select("payload_digest", F.col("first.place.file").alias("of_file"), F.col("first.place.number").alias("of_number"), F.col("first.page.page_id").alias("refers_to"), F.col("first.page.url").alias("refers_to_url"), F.col("first.page.payload_bytes").alias("full_bytes")))
    repeats = known.drop("refers_to").join(small_side(originals, BROADCAST_ROWS), "payload_digest")
    return repeats.where("file <> of_file or number <> of_number").select("file", "number", "refers_to", "refers_to_url", "full_bytes")


def deduplicate(spark: SparkSession, source: str, target: str, least: int = 0, id_type: str = "bigint", level: str = LEVEL) -> None:
    """The archives under ``source`` written to ``target`` with fresh headers: each payload once, its other records as revisits of it.

    Revisits that ``source`` already has are resolved too: they refer to the original of their digest, or keep what they
    refer to if ``source`` lacks it. Payloads don't move but where revisits are too many to broadcast.
    """
    found = cut(resolve(cut(read(spark, source, id_type, payloads=False)), least))
    marks = small_side(found.withColumnRenamed("refers_to", "original").withColumn("repeats", F.lit(True)), BROADCAST_ROWS)
    records = read(spark, source, id_type).join(marks, ["file", "number"], "left")
    repeats = F.coalesce(F.col("repeats"), F.lit(False)) | (F.col("record_type") == "revisit")
    payload = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    refers = F.when(F.col("repeats"), F.col("original")).otherwise(F.col("refers_to"))
    _save(records.select(_record(F.when(repeats, "revisit").otherwise("response"), F.col("page_id"), F.col("url"), F.col("payload_digest"), F.coalesce("payload_bytes", "full_bytes", F.lit(0).cast("bigint")), payload, refers, F.col("refers_to_url"))), target, level)


def with_originals(records: DataFrame) -> DataFrame:
    """``read``'s records, without payloads, a revisit's payload_bytes taken from the response of its digest (null if there is none)."""
    records = cut(records.drop("payload"))
    wanted = records.where("record_type = 'revisit'").select("payload_digest").distinct()
    sizes = cut(records.where("record_type = 'response'").join(wanted, "payload_digest", "left_semi").groupBy("payload_digest").agg(F.max("payload_bytes").alias("full_bytes")))
    joined = records.join(small_side(sizes, BROADCAST_ROWS), "payload_digest", "left")
    return joined.select("page_id", "url", F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
