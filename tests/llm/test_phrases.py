"""Phrase counts and collocations against plain Python."""

import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import phrases, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    found, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            found.update((lang, *words[i : i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))
    return found, total


def collocations(rows, least=30, top=2000, share=80):
    f, total = counts(rows)
    long = {k: v for k, v in f.items() if len(k) > 2 and v >= least}
    dropped = {(k[0], *k[i:j]) for k, v in long.items() for i in range(1, len(k)) for j in range(i + 2, len(k) + 1) if j - i < len(k) - 1 and 100 * v >= share * f[(k[0], *k[i:j])]}
    out = collections.defaultdict(list)
    for k, a in long.items():
        if k not in dropped:
            score, cut = min((2_000_000 * a // (f[k[: i + 1]] + f[(k[0], *k[i + 1 :])]), i) for i in range(1, len(k) - 1))
            out[k[0]].append((-score, -a, " ".join(k[1:]).encode(), f[k[: cut + 1]], f[(k[0], *k[cut + 1 :])]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top]))


def found(df, **kw):
    return sorted(tuple(r) for r in phrases.collocations(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(seed, texts=400):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "été", "x y", "a-b", "U.S", *(f"w{i}" for i in range(30))]
    rows = []
    for _ in range(texts):
        parts = [rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r"]) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.3:
            parts.insert(rng.randint(0, len(parts)), "once upon a time there was ")
        rows.append((rng.choice(["en", "en", "de", None, "und"]), "".join(parts)))
    return rows + rows[:100]


def test_made_texts(spark):
    rows = made(1)
    table = spark.createDataFrame(rows, "lang string, text string")
    for name in ("n", "phrase", "chunk", "own", "freq", "hash", "words", "rank"):
        table = table.withColumn(name, F.lit("clash"))
    got = found(table, least_count=12, top=60)
    assert got == collocations(rows, least=12, top=60)
    assert any(r[2] == "once upon a time" for r in got)
    assert found(table, least_count=12, share=40) == collocations(rows, least=12, share=40)


def test_chunks_count_each_phrase_once(spark):
    """Every count of one to four words, also where nearly every word begins a chunk."""
    rows = made(2, 150)
    want, total = counts(rows)
    for size in (1, 3, 24):
        got, sizes = phrases.phrase_counts(spark.createDataFrame(rows, "lang string, text string"), 1, chunk=size)
        assert {(r.lang, *r.phrase.split(" ")): r.f for r in got.collect()} == dict(want)
        assert {r.lang: r.n for r in sizes.collect()} == dict(total)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert found(empty) == []
    rows = [("en", None), (None, ""), ("en", " \t"), ("en", ".,;:!?"), ("fr", "seul"), ("en", "ja " * 50_000), ("en", "x" * 100_000 + " y"), ("", "a b c " * 40), ("de", "a b"), *[("de", "A  B\tc")] * 31]
    assert found(spark.createDataFrame(rows, "lang string, text string")) == collocations(rows)
    same = [("en", "alpha beta. beta gamma. gamma delta")] * 40  # equal scores and counts: the phrase decides
    assert [r[2] for r in found(spark.createDataFrame(same, "lang string, text string"), top=2)] == [r[2] for r in collocations(same, top=2)]


def test_full_sieves(spark, monkeypatch):
    """Sieves in which nearly every bit is set let rare phrases through; exact counts end them."""
    rows = made(3, 200)
    monkeypatch.setattr(phrases, "_sieve", lambda hashes: np.full(phrases.SIEVE_BITS // 8, 255, np.uint8))
    assert found(spark.createDataFrame(rows, "lang string, text string"), least_count=10) == collocations(rows, least=10)


def test_query_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.lang, r.text) for r in queries.table(spark, sf_dir, "documents").select("lang", "text").collect()]
    got = queries.QUERIES["op13_collocations"](spark, sf_dir).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == collocations(rows)
