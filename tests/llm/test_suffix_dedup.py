"""Repeated byte strings against a table of all windows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, suffix_dedup


def brute(rows, length):
    """{(doc_id, text): (bytes, removed, runs, kept digest)}; rows of equal doc_id and text are one document."""
    documents = {}
    for doc_id, text in rows:
        documents[(doc_id, text or "")] = None
    ordered = sorted(documents, key=lambda d: -(2**63) if d[0] is None else d[0])
    first = {}
    for n, (_, text) in enumerate(ordered):
        data = text.encode()
        for i in range(len(data) - length + 1):
            first.setdefault(data[i : i + length], (n, i))
    out = {}
    for n, key in enumerate(ordered):
        data = key[1].encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] != (n, i):
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[key] = len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()
    return out


def found(df, length):
    cut = suffix_dedup.suffix_dedup(df, length=length)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("removed"), F.size("spans").alias("runs"), F.sha2("kept", 256).alias("kept")).collect()


def check(spark, rows, length):
    want = brute(rows, length)
    got = sorted((tuple(r) for r in found(spark.createDataFrame(rows, "doc_id long, text string"), length)), key=str)
    assert got == sorted(((d, *want[(d, t or "")]) for d, t in rows), key=str)


@pytest.fixture
def small_buckets(monkeypatch):
    """Many buckets, so that passages cross their boundaries."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_STRETCHES", 40)
    monkeypatch.setattr(suffix_dedup, "WHOLE_GRAM", 10)


@pytest.mark.parametrize("seed", range(3))
def test_edited_copies_in_small_buckets(spark, small_buckets, seed):
    rng = random.Random(seed)
    words = [("".join(rng.choices("abcdeé", k=rng.randint(1, 6)))) for _ in range(60)]
    bases = [" ".join(rng.choices(words, k=rng.randint(5, 150))) for _ in range(6)]
    rows = []
    for i in range(60):
        text = list(rng.choice(bases))
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 3)] = rng.choice(["", "q", "zz", " "])
        rows.append((rng.choice([i, i, i - 300]), "".join(text) * rng.choice([1, 1, 2])))
    check(spark, rows, rng.choice([32, 40, 100]))


def test_one_line_in_all_documents(spark, small_buckets):
    line = "this line of more than a hundred bytes stands in every single document of the table, between other words that differ. "
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abcdefgh ", k=rng.randint(0, 150))) + line + "".join(rng.choices("abcdefgh ", k=80))) for i in range(200)]
    check(spark, rows, 100)


def test_edge_cases(spark):
    long_text = "monotone " * 3_000 + "x" * 5_000 + " ".join(f"w{i}" for i in range(4_000))
    rows = [
        (1, None), (2, ""), (3, "short"), (4, "é" * 60), (5, "é" * 60), (6, long_text), (7, long_text[500:]), (None, "é" * 55), (None, None),
        (8, "a" * 100), (8, "a" * 100), (8, "b" * 101), (9, "b" * 101 + "a" * 99), (10, "a" * 99), (11, "\n" * 300),
    ]
    check(spark, rows, 100)
    assert found(spark.createDataFrame([], "doc_id long, text string"), 100) == []
    clash = spark.createDataFrame([(1, "c" * 150)], "doc_id long, text string")
    for name in ("d", "tie", "at", "spans", "kept", "gram", "start", "n_bytes"):
        clash = clash.withColumn(name, F.lit("clash"))
    (row,) = suffix_dedup.suffix_dedup(clash).collect()
    assert row.kept == b"c" * 100 or row.spans == [(1, 150)]
    with pytest.raises(ValueError, match="length"):
        suffix_dedup.suffix_dedup(clash, length=200)


def test_many_rows_of_one_id(spark):
    rows = [(7, "the same words again and again, " * 8)] * 2_000 + [(8, "the same words again and again, " * 4)]
    want = brute(rows, 100)
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), 100)
    assert len(got) == 2_001
    assert {tuple(r) for r in got} == {(d, *w) for (d, _), w in want.items()}


def test_multikey_order():
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, 4, 500) for _ in range(4)]
    order, same = suffix_dedup.multikey_order([keys[0], lambda i: keys[1][i], *keys[2:]], 2, 500)
    assert (order == np.lexsort(keys[::-1])).all()
    pairs = keys[0][order] * 4 + keys[1][order]
    assert (same == (pairs[1:] == pairs[:-1])).all()


def test_query_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want = {d: w for (d, _), w in brute(rows, 100).items()}
    got = queries.QUERIES["op11_suffix_dedup"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    assert all(want[r.doc_id] == (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert sum(r.n_removed for r in got) > 0
