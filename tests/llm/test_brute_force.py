"""The learned operators and the page reader against plain Python versions, and columns of clashing names."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ticklake.llm import decontamination, html_extraction, language_id, line_dedup, lm_scoring, packing, quality, toxicity, vector_dedup

WORDS = "kata lovi mizo nupe requ sóß Gato it's 12 ### a.b, end.".split()


def grams(text: str) -> set[int]:
    """Buckets of a text's character n-grams, one at a time."""
    shown = re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
    out = set()
    for n in toxicity.LENGTHS:
        for k in range(len(shown) - n + 1):
            h = 0
            for c in shown[k : k + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
            out.add(((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64) >> (64 - toxicity.BITS))
    return out


def test_toxicity_equals_plain_python(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 30))) + (" idiot scum" if k % 3 == 0 else "") for k in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (60, ""), (61, None), (3, texts[3])], "doc_id bigint, text string").withColumns({"score": F.lit(0.5), "y": F.lit(1), "features": F.lit("x")})
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id bigint, toxic int")
    model = toxicity.train(docs.dropDuplicates(["doc_id"]), labels, features=200)
    held = [grams(t) for t in texts]
    p, q = Counter(g for k, s in enumerate(held) if k % 3 == 0 for g in s), Counter(g for k, s in enumerate(held) if k % 3 for g in s)
    share = 20 / 60

    def gap(g):
        expected = (p[g] + q[g]) * share
        return (p[g] - expected) ** 2 / (expected * max(1e-9, 1 - (p[g] + q[g]) / 60) + 1e-9)

    best = sorted((g for g in p | q if p[g] + q[g] >= 5), key=lambda g: (-gap(g), g))[:200]
    assert set(np.flatnonzero(model.weight).tolist()) <= set(best) and len(best) == 200
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 63 and len({r["score"] for r in rows if r["doc_id"] == 3}) == 1
    for r in rows:
        own = grams(texts[r["doc_id"]]) if r["doc_id"] < 60 else grams("")
        total = model.intercept + sum(float(model.weight[g]) for g in own)
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-6


def passage(words: list[bytes], own: bytes) -> list[float]:
    """A passage's description, measure by measure; ``own`` are its bytes from the first word's start to the last one's end."""
    marks = b"!',-.:;?"
    kinds = [
        lambda b: 97 <= b <= 122, lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57, lambda b: b == 32 or 9 <= b <= 13, lambda b: b in marks,
        lambda b: 32 < b < 127 and b not in marks and not chr(b).isalnum(), lambda b: b == 10, lambda b: b >= 128,
    ]
    out = [sum(map(kind, own)) / len(own) for kind in kinds]
    n, sizes, low = len(words), [len(w) for w in words], [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    mean = sum(sizes) / n
    spread = math.sqrt(max(0, sum(s * s for s in sizes) / n - mean**2))
    out += [math.log1p(mean), math.log1p(spread), len(set(low)) / n, max(Counter(low).values()) / n, sum(a == b for a, b in zip(low, low[1:], strict=False)) / n, math.log1p(n)]
    cells = Counter(((own[k] * 65536 + own[k + 1] * 256 + own[k + 2]) * 2654435761 % 2**32 >> 16) % quality.HISTOGRAM for k in range(len(own) - 2))
    return out + [math.sqrt(cells[k] / len(own)) for k in range(quality.HISTOGRAM)]


def test_quality_equals_plain_python(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=n)) for n in (1, 2, 63, 64, 65, 200)] + ["a  b\n\nc\t" * 50, "", None, "  \n", "w" * 5000]
    net = np.random.default_rng(4)
    model = quality.Model(net.normal(size=quality.FEATURES), net.uniform(0.5, 2, quality.FEATURES), net.normal(0, 0.4, quality.Attention.size()))
    w = quality.Attention.split(model.flat)
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id bigint, text string").withColumns({"score": F.lit(0.5), "x": F.lit(1)})
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        found = list(re.finditer(rb"[^\x20\x09-\x0D]+", raw))
        if not found:
            assert r["score"] == 0
            continue
        hidden, weight = [], []
        for k in range(0, len(found), quality.PASSAGE):
            part = found[k : k + quality.PASSAGE]
            x = [max(-8, min(8, (v - c) / s)) for v, c, s in zip(passage([m[0] for m in part], raw[part[0].start() : part[-1].end()]), model.centre, model.spread, strict=True)]
            h = [math.tanh(sum(a * b for a, b in zip(x, w["E"][:, j], strict=True)) + w["e"][j]) for j in range(len(w["e"]))]
            gate = [math.tanh(sum(a * b for a, b in zip(h, w["V"][:, j], strict=True))) / (1 + math.exp(-sum(a * b for a, b in zip(h, w["U"][:, j], strict=True)))) for j in range(len(w["w"]))]
            hidden.append(h)
            weight.append(math.exp(sum(a * b for a, b in zip(gate, w["w"], strict=True))))
        z = [sum(a * h[j] for a, h in zip(weight, hidden, strict=True)) / sum(weight) for j in range(len(w["c"]))]
        assert abs(r["score"] - 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, w["c"], strict=True)) + w["b"][0])))) < 1e-3


class Tree(HTMLParser):
    """Text of the element whose id is ``main``, without navigation, adverts, forms and scripts, by a stack of tags."""

    INLINE = frozenset("b i a span em".split())

    def __init__(self):
        super().__init__()
        self.stack, self.parts = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE:
            self.parts.append(" ")
        if tag not in ("br", "img", "input"):
            attrs = dict(attrs)
            out = tag in ("nav", "footer", "form", "script", "aside") or attrs.get("class") == "ad"
            self.stack.append((tag, attrs.get("id") == "main", out))

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.parts.append(" ")
        self.stack.pop()

    def handle_data(self, data):
        inside = [m for _, m, _ in self.stack]
        if True in inside and not any(o for _, _, o in self.stack[inside.index(True) :]):
            self.parts.append(data)


def test_extraction_equals_a_tree_of_generated_pages(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["alpha", "be&amp;ta", "gamma", "d&eacute;lta", "<b>bold</b>", "<i>it</i><b>s</b>", "<a href='x>y'>link</a>"]) for _ in range(n))
    frames = {"a.example": '<div class="c-{k} wrap"><div id="main" class="x">{m}</div></div>', "b.example": '<div class="content-sidebar-wrap"><article id="main">{m}</article></div>', "c.example": '<table><tr><td><div id="main" class="story s{k}">{m}</div></td></tr></table>', "d.example": '<section class="has-sidebar"><div id="main">{m}</div></section>'}
    rows = []
    for k in range(80):
        host = rng.choice(list(frames))
        blocks = "".join(rng.choice([f"<p>{say(30)}</p>", f"<h2>{say(4)}</h2>", f"<ul><li>{say(9)}</li><li>{say(8)}</li></ul>", f'<div class="ad">{say(3)}</div>', f"<form><input>{say(2)}</form>", "<script>if (a < b) {}</script>", f"<blockquote>{say(12)}</blockquote>"]) for _ in range(rng.randint(4, 9)))
        body = frames[host].replace("{k}", str(k)).replace("{m}", f"<p>{say(40)}</p>{blocks}")
        rows.append((k, f"https://{host}/{k}", f"<html><body><nav>{say(6)}</nav><div class='sidebar'>{say(10)}</div>{body}<footer>{say(5)}</footer></body></html>"))
    rows.append((80, "https://a.example/other", f"<html><body><center><p>{'another place ' * 40}</p></center></body></html>"))
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"host": F.lit("x"), "path": F.lit("y")})).collect()}
    for k, _, html in rows[:-1]:
        tree = Tree()
        tree.feed(html)
        assert got[k] == " ".join("".join(tree.parts).split())
    assert got[80] == ("another place " * 40).strip()


def test_pages_are_read_in_linear_time():
    hostile = {
        "<a " * 300_000: ("<a " * 300_000).strip(),
        "<div>x" * 100_000: None,
        '<a ">"' * 60_000: None,
        "<div>" * 50_000 + "</p>" * 50_000 + "</b>" * 50_000: "",
        "<ul>" + "<div>" * 30_000 + "<li>" * 30_000: "",
        "<script>" + "</script " * 60_000: "",
        "<u><div>" + "<i>" * 50_000 + "</u>" * 50_000: "",
    }
    for html, want in hostile.items():
        began = time.perf_counter()
        text = html_extraction.read(html, None)
        assert time.perf_counter() - began < 20 and (want is None or text == want)


CLASH = ("score", "Lang_Pred", "bits", "n_words", "span_starts", "span_ends", "span_items", "__doc", "__kept", "__lines", "lines_before", "__text", "a.b")


def test_stages_with_columns_of_clashing_names(spark, tmp_path):
    rng = random.Random(6)
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    leaked = text(WORDS, 20)
    rows = [(k, "\n".join(text(["tak", "mol", "sen", "vip"] if k % 2 else ["oui", "eau", "mer"], 12) for _ in range(3)), "aa" if k % 2 else "bb") for k in range(20)]
    rows += [(20, f"tak mol sen {leaked} vip tak", "aa"), (21, None, "aa"), (22, "", "bb"), (23, "12 !", "aa"), (None, "tak mol sen vip tak", "aa"), (5, rows[5][1], "aa")]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))
    clash = plain.withColumns({c: F.lit(7) for c in CLASH})
    spark.createDataFrame([(1, leaked)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (corpus_pipeline.language, corpus_pipeline.lines, corpus_pipeline.benchmarks):
        out = stage(spark, clash, str(tmp_path))
        assert out.columns == clash.columns
        own = lambda d: sorted((tuple(r) for r in d.select(*plain.columns).collect()), key=repr)
        assert own(out) == own(stage(spark, plain, str(tmp_path)))
        assert out.where(" or ".join(f"`{c}` <> 7" for c in CLASH)).count() == 0
    assert corpus_pipeline.sequences(spark, clash, str(tmp_path)).columns == corpus_pipeline.sequences(spark, plain, str(tmp_path)).columns
    assert language_id.identify(clash, language_id.train(clash), keep=["doc_id", "score"], names=("l", "s", "b")).columns == ["doc_id", "score", "l", "s", "b"]
    twice = clash.where("doc_id = 20").unionByName(clash.where("doc_id = 20"))
    assert [r["n_hit"] for r in decontamination.report(twice, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()] in ([n] * 2 for n in range(1, 40))
    assert line_dedup.dedup(clash).columns == clash.columns


def test_language_with_one_long_document_is_learned(spark):
    rows = [(k, "tak mol sen " * 20, "aa") for k in range(30)] + [(30, "oui eau mer " * 4000, "bb")]
    trees = language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample_bytes=2000)
    assert all(len(g[0][0]) for g in trees.trees)
    got = language_id.identify(spark.createDataFrame([(1, "oui mer eau")], "doc_id bigint, text string"), trees).first()
    assert got["lang_pred"] == "bb"


def test_token_ids_of_a_million_spaces():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    reference = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for text in (" " * 1_000_000, "a" + "\n\t" * 400_000 + "b", "<|endoftext|> a"):
        assert packing.token_ids(text).tolist() == reference.encode(text, add_special_tokens=False).ids


def test_vectors_of_extreme_sizes_repeated_ids_and_many_lists(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "PER_LIST", 30)
    monkeypatch.setattr(vector_dedup, "BLOCK", 64)
    monkeypatch.setattr(vector_dedup, "DEALT", 500)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(400, 16))
    x = np.concatenate([c + rng.normal(size=(rng.integers(1, 6), 16)) * 0.08 for c in centre])
    rows = [(int(k), v.tolist()) for k, v in enumerate(x)]
    n = len(rows)
    odd = [(n, [1e200, 1e200]), (n + 1, [2e200, 2e200]), (n + 2, [1e-200, 0.0]), (n + 3, [3e-200, 0.0]), (n + 4, rng.normal(size=5000).tolist()), (n + 5, [1.0] * 3), (n + 5, [1.0, 1.0, 1.01])]
    got = {}
    for r in vector_dedup.link(spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumns({"list": F.lit(1), "vector": F.lit(2)})).collect():
        got.setdefault(r["vec_id"], r)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    true = u @ u.T >= 0.9
    np.fill_diagonal(true, False)
    assert all(got[k]["n_links"] <= true[k].sum() for k in range(n)) and sum(got[k]["n_links"] for k in range(n)) >= 0.9 * true.sum()
    assert [got[n + k]["component_id"] - n for k in range(6)] == [0, 0, 2, 2, 4, 5] and got[n + 4]["n_links"] == 0


def test_scores_of_repeated_and_empty_rows(spark):
    texts = ["tak mol sen", "oui eau", "tak mol sen", "", None]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[1])], "doc_id bigint, text string").withColumns({"score": F.lit(1), "gram": F.lit(2), "block": F.lit(3), "__text": F.lit("x")})
    pair = lm_scoring.train(docs, spark.createDataFrame([(0,)], "doc_id bigint"), order=2)
    rows = lm_scoring.score(docs, pair).collect()
    assert len(rows) == 7 and len({r["score"] for r in rows if r["doc_id"] in (0, 2)}) == 1 and {r["score"] for r in rows if r["doc_id"] in (3, 4)} == {0.0}
    assert len({r["score"] for r in rows if r["doc_id"] in (1, None)}) == 1
