"""Archives: exact round trips, revisits against brute force, and what can't be read."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest

from ticklake.llm import warc

PAGES = "page_id bigint, url string, html string, payload string, number int"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


HTML = ["", None, "<p>Ä €</p>", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "\n", "\r\n", "x\r", "zero \x00 byte", "line\n" * 50_000, "y" * 3_000_000, "tail\n\n"]


@pytest.fixture
def pages(spark):
    rng = random.Random(3)
    rows = [(k, None if k % 9 == 4 else f"http://h/{k}\r\nX: 1", rng.choice(HTML) if k % 3 else f"own {k}", "clash", 1) for k in range(60)]
    rows += [(None, "http://h/none", "own 3", "clash", 1), (7, "http://h/7", rows[7][2], "clash", 1), (None, None, "alone", "clash", 1)]
    return rows, spark.createDataFrame(rows, PAGES).repartition(4)


def expected(rows, least=0):
    """(page_id, bytes, digest, type, refers_to); of rows with one smallest id the first one found is the response."""
    first, out = {}, []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = r[2] or ""
        repeats = len(body.encode()) >= least and body in first
        out.append((r[0], len(body.encode()), digest(body), "revisit" if repeats else "response", first[body] if repeats else None))
        first.setdefault(body, r[0])
    return sorted(out, key=repr)


def test_round_trip_of_any_payload(spark, pages, tmp_path):
    rows, df = pages
    warc.write(df, f"{tmp_path}/a")
    back = warc.read(spark, f"{tmp_path}/a").collect()
    clean = lambda u: None if u is None else u.replace("\r", "%0D").replace("\n", "%0A")
    assert sorted(((r["page_id"], r["url"], bytes(r["payload"])) for r in back), key=repr) == sorted(((p, clean(u), (t or "").encode()) for p, u, t, *_ in rows), key=repr)
    assert all(r["record_type"] == "response" and r["payload_digest"] == digest(bytes(r["payload"]).decode()) for r in back)


def test_files_are_gzipped_archives(spark, pages, tmp_path):
    rows, df = pages
    warc.write(df, f"{tmp_path}/a")
    held = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(tmp_path, "a").glob("part-*.gz")))
    at = n = 0
    while at < len(held):
        end = held.index(b"\r\n\r\n", at) + 4
        size = next(int(line.split(b":")[1]) for line in held[at:end].split(b"\r\n") if line.startswith(b"Content-Length:"))
        assert held[at:].startswith(b"WARC/1.1\r\n") and held[end + size : end + size + 4] == b"\r\n\r\n"
        at, n = end + size + 4, n + 1
    assert n == len(rows)


@pytest.mark.parametrize("least", [0, 3])
def test_revisits_equal_brute_force(spark, pages, tmp_path, least):
    rows, df = pages
    warc.write(df, f"{tmp_path}/a")
    warc.deduplicate(spark, f"{tmp_path}/a", f"{tmp_path}/b", least)
    got = warc.with_originals(warc.read(spark, f"{tmp_path}/b", payloads=False))
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == expected(rows, least)
    held = [r for r in warc.read(spark, f"{tmp_path}/b").collect() if r["record_type"] == "response"]
    assert sorted({bytes(r["payload"]) for r in held}) == sorted({(r[2] or "").encode() for r in rows})


def test_revisits_of_an_archive_are_resolved_again(spark, pages, tmp_path):
    rows, df = pages
    warc.write(df, f"{tmp_path}/a")
    warc.deduplicate(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    warc.deduplicate(spark, f"{tmp_path}/b", f"{tmp_path}/c")
    read = lambda d: sorted((tuple(r) for r in warc.with_originals(warc.read(spark, f"{tmp_path}/{d}")).collect()), key=repr)
    assert read("b") == read("c")


def test_broken_archives_raise(spark, tmp_path):
    whole = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n\r\n\r\nx\r\n\r\n"
    for name, held, why in (("cut", whole[:-6], "inside a record"), ("junk", b"junk\r\n\r\n" + whole, "no record"), ("wrong", whole.replace(b"\r\nContent", b"\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent"), "payload digest")):
        Path(tmp_path, f"{name}.warc.gz").write_bytes(gzip.compress(held))
        with pytest.raises(Exception, match=why):
            warc.read(spark, f"{tmp_path}/{name}.warc.gz").collect()
    Path(tmp_path, "fine.warc.gz").write_bytes(gzip.compress(whole) + gzip.compress(whole.replace(b"response", b"metadata")))  # a member a record
    assert [(r["page_id"], r["payload_bytes"]) for r in warc.read(spark, f"{tmp_path}/fine.warc.gz").collect()] == [(None, 1)]


def test_no_pages(spark, tmp_path):
    warc.write(spark.createDataFrame([], PAGES), f"{tmp_path}/a")
    warc.deduplicate(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    assert warc.with_originals(warc.read(spark, f"{tmp_path}/b")).collect() == []
