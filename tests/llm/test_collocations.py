"""The bidirectional index and the collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from ticklake.llm import collocations

DOCS = "text string, lang string, doc_id bigint, phrase string, n int"


def occurrences(text, length):
    return Counter(tuple(text[i : i + length].tolist()) for i in range(len(text) - length + 1) if (text[i : i + length] > 0).all())


@pytest.mark.parametrize("symbols", [1, 2, 5])
def test_extensions_both_ways(symbols):
    rng = random.Random(symbols)
    for _ in range(10):
        text = np.array([0, *(rng.randint(0, symbols) for _ in range(rng.randint(1, 200))), 0])
        index = collocations.Index(text, symbols, 5)
        for ways in ((True,) * 4, (False,) * 4, (True, False) * 2, (False, True, True, False)):
            found = index.single()
            found = found.where(found.n > 0)
            for right in (None, *ways):
                found = found if right is None else index.extend(found, right)
                length = found.words.shape[1]
                assert dict(zip(map(tuple, found.words.tolist()), found.n.tolist(), strict=True)) == occurrences(text, length)


def brute_force(rows, least, most, percent):
    f, n = Counter(), Counter()
    for text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = []
    for (lang, g), a in found.items():
        inside = any(o == lang and len(h) > len(g) and 100 * b >= percent * a and any(h[i : i + len(g)] == g for i in range(len(h))) for (o, h), b in found.items())
        if not inside:
            score, k, left, right = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            out.append((lang, " ".join(g), a, left, right, n[lang], score, k))
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    words = ["Aa", "b", "c\x00", "ä", "É", "d-d", "rare"]
    sets = ["new york city", "of the of the", "a a a a a a"]
    line = lambda: " ".join(rng.choice(sets) if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 30)))
    rows = [(rng.choice(["\n", ". ", "\t", "?!"]).join(line() for _ in range(4)), rng.choice(["en", "de", None]), k, "clash", 1) for k in range(60)]
    return [*rows, (None, "en", 1, None, None), ("", None, 1, None, None), (" .,\r\x0b ", "fr", 1, None, None), rows[0], rows[0], ("b ä " * 20_000, "und", 5, None, None), ("x" * 400_000, "de", None, None, None)]


@pytest.mark.parametrize("least, most, percent, few", [(5, 5, 100, True), (20, 3, 60, False), (1, 5, 100, False), (20, 2, 100, True)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, most, percent, few):
    if not few:  # shards learn of words and pairs by shuffles
        monkeypatch.setattr(collocations, "BROADCAST_WORDS", 0)
        monkeypatch.setattr(collocations, "BROADCAST_PHRASES", 0)
    rows = rows_of(least)
    rows = rows if least > 1 else rows[:4]
    found = collocations.mine(spark.createDataFrame(rows, DOCS).repartition(9), least, most, percent)
    got = [tuple(r) for r in found.select("lang", "phrase", "a", "l", "r", "n", "score", "cut").collect()]
    assert sorted(got) == brute_force(rows, least, most, percent)
    ranks = collocations.top(found, 3).collect()
    for lang in {r[0] for r in got}:
        first = sorted((r for r in got if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:3]
        assert [r["phrase"] for r in sorted(ranks, key=lambda r: r["rank"]) if r["lang"] == lang] == [r[1] for r in first]


def test_products_beyond_64_bits(spark):
    table = spark.createDataFrame([(5_000_000_000_000, 9_000_000_000_000_000)], "n bigint, total bigint").selectExpr("n", "total", "6000000000000 as l", "7000000000000 as r")
    score = table.selectExpr("(cast(n as decimal(38,0)) * total * 1000) div (cast(l as decimal(38,0)) * r) as s").first()["s"]
    assert score == 1000 * 5_000_000_000_000 * 9_000_000_000_000_000 // (6_000_000_000_000 * 7_000_000_000_000)


def test_no_texts(spark):
    empty = spark.createDataFrame([], DOCS)
    assert collocations.mine(empty).collect() == [] and collocations.mine(spark.createDataFrame([(None, None, 1, None, 1)], DOCS)).collect() == []
