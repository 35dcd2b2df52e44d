"""Word counts, neighbours, forms and roots against plain Python."""

import collections
import random
import re
import zlib

from pyspark.sql import functions as F

from tidemark.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows, least_length=6, least_count=5, typo_every=199):
    found = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if typo_every and h % typo_every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least_length:
                found[word] += 1
    return {w: n for w, n in found.items() if n >= least_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(n, factor=5):
    forms, sizes = {}, {}
    for w in n:
        others = [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)]
        sizes[w] = len(others)
        if others and n[best := min(others, key=lambda x: (-n[x], x.encode()))] >= factor * n[w]:
            forms[w] = best
    out = []
    for w in n:
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, n[w], sizes[w], forms.get(w), n[forms[w]] if w in forms else None, root))
    return sorted(out)


def found(counted, factor=5):
    columns = ("word", "n", "n_near", "form", "form_n", "root")
    return sorted(tuple(r[c] for c in columns) for r in spelling.spelling_variants(counted, factor=factor).collect())


def test_random_words(spark):
    rng = random.Random(11)
    n = {"".join(rng.choices("abé", k=rng.randint(1, 6))): int(5 ** rng.uniform(0, 6)) for _ in range(500)}
    table = spark.createDataFrame(list(n.items()), "word string, n long").withColumn("id", F.lit("clash")).withColumn("near", F.lit(1)).withColumn("up", F.lit(2))
    got = found(table)
    assert got == variants(n)
    assert sum(r[3] is not None for r in got) > 100
    assert any(dict((w, f) for w, _, _, f, _, _ in got).get(r[3]) for r in got)  # ways of two steps or more
    assert found(table, factor=2) == variants(n, factor=2)


def test_long_words_and_odd_tables(spark):
    long_word = "x" * 20_000
    n = {long_word: 100, long_word + "y": 5, long_word[1:]: 600, "a": 3, "": 9, "\U0001f600b": 50, "b": 1}
    assert found(spark.createDataFrame([*n.items(), (None, 7)], "word string, n long")) == variants(n)
    assert found(spark.createDataFrame([], "word string, n long")) == []
    twice = spark.createDataFrame([("word", 2), ("word", 3), ("ward", 1)], "word string, n long")
    assert found(twice) == variants({"word": 5, "ward": 1})


def test_hot_family(spark):
    """All one-letter variants of a word: pairs of nodes with as many words as there are letters."""
    n = {"stem" + a + b: 1 for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"} | {"stem": 1000, "stema": 30}
    got = found(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert got == variants(n)


def test_word_counts(spark):
    rows = [
        (1, "Banana banana BANANA bÀnana"), (1, "Banana banana BANANA bÀnana"), (2, None), (3, ""), (None, "banana banana×÷x kiwi-kiwis kiwisākiwisx"),
        (4, "banana" * 400 + " " + "kiwisa " * 30), (5, " 1banana2banana_banana\U0001f600banana　banana"), *((i, "banana kiwisa orange lemons") for i in range(10, 400)),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(0))
    for every in (0, 7, 199):
        got = {r.word: r.n for r in spelling.word_counts(table, least_count=2, typo_every=every).collect()}
        assert got == counts(rows, least_count=2, typo_every=every)
    assert spelling.word_counts(table.where("false")).count() == 0


def test_query_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_spelling_variants"](spark, sf_dir).collect()
    assert sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got) == variants(counts(rows))
