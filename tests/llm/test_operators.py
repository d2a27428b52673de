"""Operators against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklake.llm import components, decontamination, html_extraction, jaccard_join, labelled, language_id, line_dedup, lm_scoring, packing, quality, toxicity, vector_dedup

DOCS = "doc_id bigint, text string, lang string, score double, n_words int"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "só") for b in ("ta", "vi", "zo", "pe", "qu", "ß", "")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, texts):
    """Documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(k, t, None, 0.5, 1) for k, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    base = [text(rng, rng.randint(20, 120)) for _ in range(30)]
    near = []
    for b in base[:12]:
        w = b.split()
        for _ in range(4):
            c = list(w)
            c[rng.randrange(len(c))] = "neu"
            near.append(" ".join(c))
    return [*base, *near, *base[:5], "", None, " \n ", "one two", "One TWO", "x" * 50_000, "lo " * 20_000]


def test_jaccard_components_equal_brute_force(spark, corpus):
    for size, percent in ((4, 85), (5, 80), (2, 60)):
        sets = []
        for t in corpus:
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
        up = list(range(len(sets)))

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    i_, j_ = find(i), find(j)
                    up[max(i_, j_)] = min(i_, j_)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(docs(spark, corpus), size, percent).collect()}
        assert got == {k: (len(s), find(k)) for k, s in enumerate(sets)}
    assert jaccard_join.link(docs(spark, [])).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (None, "g h i j k l")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard_join.link(twice).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1)]


def test_jaccard_pairs_of_a_large_group_of_near_copies_stay_few(spark, monkeypatch):
    rng, base, texts = random.Random(12), [f"w{k}" for k in range(110)], []
    for k in range(3000):  # 0 to 5 changes each: few at 0.85 of each other, all with most of the same shingles
        own = list(base)
        for at in rng.sample(range(110), rng.randint(2, 5) if k else 0):
            own[at] = f"x{k}_{at}"
        texts.append(" ".join(own))
    made, crossing = [], jaccard_join._crossing

    def counted(postings, percent):
        pairs = crossing(postings, percent)
        made.append((pairs.count(), postings.count()))
        return pairs

    monkeypatch.setattr(jaccard_join, "_crossing", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link(docs(spark, texts), 4, 85).collect()}
    assert all(pairs <= 4 * postings for pairs, postings in made)
    sets = [frozenset(zip(*(t.split()[j:] for j in range(4)))) for t in texts]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in rng.sample(range(3000), 40):  # no link of these with any other is lost
        for j, other in enumerate(sets):
            if 100 * len(sets[i] & other) >= 85 * len(sets[i] | other):
                assert got[i] == got[j]
    for i, j in {(0, j) for j in range(1, 3000) if 100 * len(sets[0] & sets[j]) >= 85 * len(sets[0] | sets[j])}:
        up[max(find(i), find(j))] = min(find(i), find(j))
    assert all(got[j] == 0 for j in range(3000) if find(j) == 0)


def test_components_of_chains_and_stars(spark, monkeypatch):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3)]
    for most in (500_000, 10):
        monkeypatch.setattr(components, "LINKS", most)
        got = {r["id"]: r["component_id"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(5)).collect()}
        assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 130), 100)}


def test_packing_round_trip(spark, corpus):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    reference = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = [*corpus, " " * 1_000_000, f"a{chr(10) * 600_000}b<|endoftext|>", "<|endoftext|> a", "  two  spaces\t\r\n\nlines ", "naïve café 日本語 \U0001f600", "it's 12'345,67 don't"]
    rows = packing.pack(docs(spark, texts), longest=256).collect()
    for k, t in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist()
        assert ids == [*reference.encode(t or "", add_special_tokens=False).ids, 1]
        assert all(r["length"] == len(r["ids"]) // 4 == 1 << r["bucket"] and r["length"] <= 256 and r["offset"] == 0 for r in own)
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:n]) for n in range(len(own))]
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert packing.pack(docs(spark, [])).count() == 0
    assert packing.bucket_sizes(packing.pack(docs(spark, ["a"]))).count() >= 1
    with pytest.raises(ValueError, match="power"):
        packing.pack(docs(spark, []), longest=1000)


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    items = [text(rng, n) for n in (3, 10, 25, 40)] + ["", None, "?!", "kata, KAVI."]
    texts = [f"{text(rng, 15)} {items[3].upper()} {text(rng, 5)}", items[2], f"{items[1]}\n{items[1]}", text(rng, 300), "", None, " ".join(items[2].split()[3:16]), items[0] * 2, "kata...kavi " * 3000]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for k, t in enumerate(items):
        w = words(t)
        for at in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[at : at + 10]), set()).add(str(k))
    want = {}
    for k, t in enumerate(texts):
        w, found = words(t), set()
        hit = [False] * len(w)
        for win, who in windows.items():
            for at in range(len(w) - len(win) + 1):
                if tuple(w[at : at + len(win)]) == win:
                    hit[at : at + len(win)] = [True] * len(win)
                    found |= who
        want[k] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit))
    for block, a_pass in ((2_000_000, 8), (60, 2)):  # the second in several blocks and passes
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
        monkeypatch.setattr(decontamination, "BLOCKS_A_PASS", a_pass)
        got = {r["doc_id"]: tuple(r[1:]) for r in decontamination.report(docs(spark, texts).select("doc_id", "text"), bench).collect()}
        assert got == want
    clean = decontamination.decontaminate(docs(spark, texts).drop("n_words"), bench)
    assert [c for c in clean.columns] == ["doc_id", "text", "lang", "score"]
    assert not decontamination.report(clean.select("doc_id", "text"), bench).where("contaminated").count()
    assert decontamination.report(docs(spark, texts).select("doc_id", "text"), bench.where("false")).where("contaminated").count() == 0
    assert decontamination.report(docs(spark, []).select("doc_id", "text"), bench).count() == 0


def test_lines_keep_the_earliest(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away"
    w = long.split()
    changed, longer, shorter, far = " ".join([*w[:5], "now", *w[6:]]), " ".join([*w[:3], "old", *w[3:]]), " ".join(w[:-1]), " ".join([*w[:2], "x", *w[3:9], "y", *w[10:]])
    texts = ["a b\n\nA  B\tc", f"{long}\nshort line", f"{changed}\n{longer}\n{shorter}\n{far}\nshort lime", long.upper(), "", None, " \n", "same words " * 9000, "a b"]
    got = [(r["doc_id"], r["text"]) for r in line_dedup.dedup(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [(0, "a b\n\nA  B\tc"), (1, f"{long}\nshort line"), (2, f"{far}\nshort lime"), (3, ""), (4, ""), (5, None), (6, " \n"), (7, "same words " * 9000), (8, "")]
    rows = line_dedup.dedup(docs(spark, texts), counts=("before", "after")).orderBy("doc_id").collect()
    assert [(r["before"], r["after"]) for r in rows][:3] == [(2, 2), (2, 2), (5, 2)]
    assert line_dedup.dedup(docs(spark, [])).count() == 0
    nulls = spark.createDataFrame([(None, "a\na"), (1, "a\na"), (1, "a\na")], "doc_id bigint, text string")
    assert sorted(r["text"] for r in line_dedup.dedup(nulls).collect()) == ["a", "a", "a\na"]


def test_lines_equal_brute_force(spark):
    rng = random.Random(6)
    lines = []
    for _ in range(25):
        w = text(rng, rng.choice([4, 5, 6, 9, 10, 14])).split()
        for _ in range(rng.randint(1, 5)):
            c = list(w)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(c))
                c = rng.choice([c[:k] + c[k + 1 :], [*c[:k], "neu", *c[k:]], [*c[:k], "alt", *c[k + 1 :]]])
            lines.append(" ".join(c))
    rng.shuffle(lines)

    def edits(a, b):
        if abs(len(a) - len(b)) > 1:
            return 2
        head = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        tail = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
        return 0 if a == b else 1 if head + tail >= max(len(a), len(b)) - 1 else 2

    firsts = list(dict.fromkeys(lines))
    kept = [x for k, x in enumerate(firsts) if len(x.split()) < 5 or not any(len(y.split()) >= 5 and edits(x.split(), y.split()) <= 1 for y in firsts[:k])]
    got = line_dedup.dedup(docs(spark, ["\n".join(lines)])).first()["text"]
    assert got.split("\n") == kept


PAGE = """<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><div class="sidebar">side</div>
<div class="post-{n} content"><h1>A &amp; B</h1><p>First <b>bold</b>text&nbsp;here, long enough to count for much.</p><script>var a = "</p>";</script>
<ul><li>one<li>two</ul><form><input>send</form><div class="ad">buy</div><!-- note --><p>Last<br>line</div><div id="comments"><p>I disagree</p></div><footer>&copy;</footer></body></html>"""


def test_extraction(spark):
    want = "A & B First boldtext here, long enough to count for much. one two Last line"
    rows = [(k, f"http://h.example/{k}", PAGE.replace("{n}", str(k))) for k in range(4)]
    rows += [(4, "http://h.example/4", ""), (5, None, None), (6, "bad url", "<p>plain &lt;b&gt; text"), (7, "http://h.example/7", "<div><nav>menu</nav></div>"), (8, "http://h.example/8", "<article><p>other place</article>" + "<br>" * 20_000), (8, "http://h.example/8", "a < b <unclosed")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {}
    for r in html_extraction.extract(pages).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert [got[k] for k in range(8)] == [[want]] * 4 + [[""], [""], ["plain <b> text"], [""]]
    assert sorted(got[8]) == ["a < b <unclosed", "other place"]
    paths = {r["host"]: r["path"] for r in html_extraction.host_paths(pages).collect()}
    assert paths["h.example"].endswith("div.post-#.content")
    assert html_extraction.extract(pages.where("false")).count() == 0


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "PER_LIST", 60)
    monkeypatch.setattr(vector_dedup, "BLOCK", 40)
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(60, 12))
    x = np.concatenate([c + rng.normal(size=(rng.integers(1, 9), 12)) * 0.12 for c in centre] + [np.tile(rng.normal(size=12), (30, 1))])
    rows = [(int(k), [float(np.float32(v)) for v in r]) for k, r in enumerate(x)]
    n = len(rows)
    bad = [(n, None), (n + 1, []), (n + 2, [0.0] * 12), (n + 3, [float("nan")] * 12), (n + 4, [None] * 12), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0]), (n + 7, [float("inf")] * 12)]
    got = {r["vec_id"]: r for r in vector_dedup.link(spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>")).collect()}
    u = np.array([r for _, r in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    true = u @ u.T >= 0.9
    np.fill_diagonal(true, False)
    found = sum(got[k]["n_links"] for k in range(n))
    assert all(got[k]["n_links"] <= true[k].sum() for k in range(n)) and found >= 0.9 * true.sum()
    assert {k for k in range(n, n + 8) if got[k]["n_links"]} == {n + 5, n + 6} and got[n + 6]["component_id"] == n + 5
    assert all(got[k]["kept"] == (got[k]["component_id"] == k) for k in got)
    assert vector_dedup.link(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_language_codes_are_exact(spark):
    train = spark.createDataFrame([("ab ab ab", "x"), ("ba ba bc", "y"), (None, "x"), ("q", None)], "text string, lang string")
    trees = language_id.train(train, order=2)

    def bits(t, own, order=2):
        pad = b"\0" * order
        data, total = pad + t.encode(), 0.0
        source = pad + own.encode()
        for k in range(order, len(data)):
            p = 1 / 256
            for j in range(order + 1):
                context, byte = data[k - j : k], data[k : k + 1]
                after = [source[m : m + 1] for m in range(order, len(source)) if source[m - j : m] == context]
                if after:
                    under = len(after) + len(set(after))
                    p = after.count(byte) / under if byte in after else len(set(after)) / under * p
            total -= np.log2(p)
        return total

    texts = ["ab", "bcz", "", None, "12 34", "ba " * 5000]
    got = {r["doc_id"]: r for r in language_id.identify(docs(spark, texts).drop("score"), trees).collect()}
    for k in (0, 1, 5):
        codes = {"x": 1 + bits(texts[k], "ab ab ab"), "y": 1 + bits(texts[k], "ba ba bc")} if k != 5 else {"x": 9e9, "y": got[5]["bits"]}
        assert got[k]["lang_pred"] == min(codes, key=codes.get) and abs(got[k]["bits"] - min(codes.values())) < 1e-3
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (2, 3, 4))
    assert language_id.identify(docs(spark, ["a"]).drop("score"), language_id.train(train.where("false"))).first()["lang_pred"] == "und"
    assert language_id.identify(docs(spark, []), trees, keep=["doc_id", "lang"]).columns == ["doc_id", "lang", "lang_pred", "score", "bits"]


def test_cross_entropy_difference(spark):
    texts = ["abc abc abc", "xyz xyz", "abc", "", None, "abc " * 3000]
    d = docs(spark, texts)
    pair = lm_scoring.train(d, spark.createDataFrame([(0,), (5,), (None,)], "doc_id bigint"), order=2)
    got = {r["doc_id"]: r for r in lm_scoring.score(d, pair).collect()}
    assert got[2]["score"] < got[1]["score"] and got[1]["score"] > 1 and got[3]["score"] == got[4]["score"] == 0 and got[5]["n_tokens"] == 12_000
    pad, t_all, t_own = b"\0\0", [t for t in texts if t], [texts[0], texts[5]]

    def loss(t, model, scale):
        data, total = pad + t.encode(), 0.0
        for k in range(2, len(data)):
            p = 1 / 256
            for j in range(3):
                context, byte = data[k - j : k], data[k]
                after = [x[m] for x in model for m in range(2, len(x)) if x[m - j : m] == context]
                p = (scale * after.count(byte) + 8 * p) / (scale * len(after) + 8)
            total -= np.log2(p)
        return total / len(t)

    model = lambda ts: [pad + t.encode() for t in ts]
    scale = sum(map(len, t_own)) / sum(map(len, t_all))
    assert abs(got[1]["target_loss"] - loss("xyz xyz", model(t_own), 1)) < 1e-3 and abs(got[1]["background_loss"] - loss("xyz xyz", model(t_all), scale)) < 1e-3
    empty = lm_scoring.train(d.where("false"), spark.createDataFrame([], "doc_id bigint"))
    assert lm_scoring.score(d, empty).count() == 6


def test_gradient_of_attention():
    rng = np.random.default_rng(1)
    flat = quality.Attention.start()
    x, first, y = rng.normal(size=(9, quality.FEATURES)), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0])

    def loss(w):
        s = quality.Attention.forward(w, x, first)[0]
        return np.mean(np.logaddexp(0, s) - y * s)

    g = quality.Attention.gradient(flat, x, first, y)
    for k in rng.choice(len(flat), 40, replace=False):
        e = np.zeros_like(flat)
        e[k] = 1e-5
        assert abs((loss(flat + e) - loss(flat - e)) / 2e-5 - g[k]) < 1e-6


def test_classifiers_on_held_out_documents(spark):
    rng = random.Random(8)
    rows = []
    for k in range(500):
        bad = k % 3 == 0
        w = text(rng, rng.randint(40, 150)).split()
        if bad:
            at = rng.randrange(len(w))
            w[at : at + 1] = ["idiot", "scum"]
        rows.append((k, " ".join(w) if k % 4 else " ".join(x + "###" for x in w), int(bad), int(k % 4 > 0)))
    d = spark.createDataFrame([r[:2] for r in rows] + [(900, ""), (901, None), (902, "###"), (903, "w" * 60_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[0] < 350] + [(None, 1, 1), (3, None, None)], "doc_id bigint, toxic int, quality int")
    toxic = {r["doc_id"]: r["score"] for r in toxicity.score(d, toxicity.train(d, labels)).collect()}
    good = {r["doc_id"]: r["score"] for r in quality.score(d, quality.train(d, labels, rounds=2)).collect()}
    held = rows[350:]
    assert np.mean([(toxic[k] >= 0.7) == bool(t) for k, _, t, _ in held]) > 0.9
    assert np.mean([(good[k] >= 0.7) == bool(q) for k, _, _, q in held]) > 0.95
    assert len(toxic) == len(good) == 504 and good[900] == good[901] == 0 and all(0 <= s <= 1 for s in [*toxic.values(), *good.values()])
    none = labels.where("false")
    assert toxicity.score(d, toxicity.train(d, none)).agg(F.max("score")).first()[0] < 0.01 and quality.train(d, none) is None
    assert quality.score(d, None).agg(F.max("score")).first()[0] == 0
    assert labelled.labelled_sample(d, labels, "toxic", 50).count() < 100
