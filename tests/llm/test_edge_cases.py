"""Every operator on nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, chat, chunk_dedup, embed_dedup, fingerprints, mixing, ngram_join, queries, token_counts, toxicity, warc
from tidemark.llm._common import components, shared_folder

LONG = "monotone " * 30_000 + "x" * 50_000 + " " + " ".join(f"w{i}" for i in range(20_000))
DOCS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "src1", 35, "k"),
    (1, "alpha beta gamma delta epsilon zeta", "en", "src1", 35, "k"),  # a repeated row
    (2, "Alpha BETA gamma delta epsilon zeta", None, "src1", None, None),
    (3, None, "en", None, 0, "k"),
    (4, "", "fr", "src2", 0, "k"),
    (5, " \t\n", "fr", "src2", 3, "k"),
    (6, LONG, "de", "odd", len(LONG), "k"),
    (None, "alpha beta gamma delta epsilon zeta", None, None, None, None),
    (7, "one two", "en", "src1", 7, "k"),
    (8, "one two", "en", "src1", 7, "k"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def docs(spark):
    """The cases, with extra columns named like those the operators add."""
    df = spark.createDataFrame(DOCS, SCHEMA)
    for name in ("n_tokens", "component_id", "fingerprint", "mix_epoch", "n_removed", "p_toxic", "words", "h1", "id", "n_bytes", "__text"[2:]):
        if name != "text":
            df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_token_counts(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = token_counts.token_counts(docs.select("doc_id", "text", "extra", "n_tokens"), path).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    want = sorted(((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in DOCS), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=str) == want
    assert token_counts.token_counts(empty, path).count() == 0


def test_bpe(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.encode_decode(docs, path).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    assert len(rows) == len(DOCS) and rows[0].extra == "k"
    by = {(r.doc_id, r.n_tokens): r for r in rows}
    for d, t, *_ in DOCS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = by[d, len(ids)]
        assert r.ids == " ".join(map(str, ids)) and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty, path, digests=True).count() == 0


def test_fingerprints(docs, empty):
    rows = fingerprints.document_fingerprints(docs).collect()
    marks = {r.doc_id: r.fingerprint for r in rows}
    assert marks[1] == marks[2] == marks[None] and marks[3] == marks[4] == marks[5] == "" and len(marks[6]) == 512
    assert fingerprints.document_fingerprints(empty).count() == 0
    pairs = fingerprints.edited_pairs(docs).collect()
    assert len(pairs) == len(DOCS)
    order = sorted(DOCS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    for (i, r), (doc, *_) in zip(enumerate(order), order, strict=True):
        t, u = texts[i], texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        found = [p for p in pairs if p.doc_id == doc and p.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()]
        assert found and found[0].n_chars == len(t) and 0 <= found[0].near_next <= 1 and 0 <= found[0].near_edited <= 1, r
    assert fingerprints.edited_pairs(empty).count() == 0
    single = fingerprints.edited_pairs(docs.where("doc_id = 7")).collect()
    assert [(p.doc_id, p.near_next) for p in single] == [(7, 1.0)]


def test_mixing(docs, empty):
    rows = mixing.mix(docs, seed=3).collect()
    assert {r.extra for r in rows} <= {"k", None} and all(r.mix_epoch in range(4) for r in rows)
    copies = [r for r in rows if r.doc_id == 1]
    assert len(copies) % 2 == 0  # equal ids enter together
    assert mixing.mix(empty).count() == 0


def test_ngram_join(docs, empty):
    rows = ngram_join.ngram_jaccard(docs, size=3, num=9, den=10).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == len(DOCS)
    assert got[1] == got[2] == (4, 1) and got[None] == (4, 1)
    assert got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (0, 5)
    assert got[7] == got[8] == (1, 7) and got[6][1] == 6 and got[6][0] > 19_000
    assert ngram_join.ngram_jaccard(empty).count() == 0


def test_substring_dedup(docs, empty):
    rows = chunk_dedup.substring_dedup(docs, least_run=1).collect()
    assert len(rows) == len(DOCS)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert {r.text for r in got[1]} == {DOCS[0][1]} and got[2][0].text.startswith("Alpha BETA gamma")  # equal ids don't give way; case differs
    assert got[3][0].text is None and got[4][0].text == "" and got[None][0].text == DOCS[0][1]
    assert got[7][0].text == "one two" and got[8][0].text == "" and got[8][0].removed_chars == 7
    assert got[6][0].n_removed > 0 and len(got[6][0].text) + got[6][0].removed_chars == len(LONG)
    assert chunk_dedup.substring_dedup(empty).count() == 0


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (2, None, 1), (7, 1, 0), (8, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    rows = toxicity.score(docs, chain).collect()
    assert len(rows) == len(DOCS) and all(0 < r.p_toxic < 1 and 0 < r.p_junk < 1 for r in rows)
    none = toxicity.train(docs, labels.where("false"))
    assert {round(r.p_toxic, 6) for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(empty, chain).count() == 0 and len(toxicity.train(empty, labels)) == 2


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, None, None, None), (2, None, "tool [x]", "</s>\\[<")]
    turns = chat.turn_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)))
    got = {r.conv_id: r for r in chat.read_back(chat.format_records(turns)).collect()}
    digest = lambda pairs: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in pairs).encode()).hexdigest()
    assert got[1].turns_sha256 == digest([("user", ""), ("", "b"), ("assistant", "a"), ("assistant", "a")]) and got[1].loss_chars == 2
    assert got[None].turns_sha256 == digest([("", "")]) and got[2].turns_sha256 == digest([("tool [x]", "</s>\\[<")])
    assert chat.read_back(chat.format_records(turns.where("false"))).count() == 0


def test_warc(spark):
    rows = [(1, "http://a b", "x" * 500), (2, None, "x" * 500), (3, "u", None), (4, "u", ""), (None, "u", "x" * 500), (5, "u", LONG), (5, "u", LONG), (6, "é", "ü")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))
    folder = shared_folder(spark, "warc")
    warc.write_archives(pages, folder).collect()
    got = sorted(warc.read_archives(spark, folder).collect(), key=str)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert len(got) == len(rows)
    assert kinds == {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (None, "revisit", 2), (5, "response", None), (6, "response", None)}
    folder = shared_folder(spark, "warc")
    assert warc.write_archives(pages.where("false"), folder).count() == 0
    folder = shared_folder(spark, "warc")
    warc.write_archives(pages, folder, revisit_bytes=501).collect()
    assert [r.record_type for r in warc.read_archives(spark, folder).where("payload_bytes <= 500").collect()] == ["response"] * 6


def test_embeddings(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [1e30, 1e-30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.embedding_duplicates(df).collect()}
    assert got[1] == (4, 1, True) and got[2] == (4, 1, False) and got[3] == (4, 1, False) and got[12] == (4, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)) and got[None] == (0, None, True)
    assert embed_dedup.embedding_duplicates(df.where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("labels", [[], [(99, 1, 1)], [(1, None, None), (7, None, None)], [(7, 1, 0)], [(1, 0, 1), (7, 0, 1)]])
def test_labels_that_teach_nothing_reject_nothing(spark, tmp_path, labels):
    df = spark.createDataFrame(DOCS, SCHEMA)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert dict(corpus_pipeline.STAGES)["toxicity"](spark, df, str(tmp_path)).count() == len(DOCS)
    assert {r.rejected for r in queries.op1_toxicity(spark, str(tmp_path)).collect()} == {False}


def test_ngram_join_repeated_ids(spark):
    """Ids with several texts are one node: no text is left out, whichever set the id's classes are known by."""
    one, two, three = ("alpha beta gamma delta", "one two three four", "red green blue black")
    rows = [(5, one), (5, two), (6, two), (7, two), (8, one), (9, three), (9, ""), (10, three), (3, "lone words stay here"), (11, None), (12, "a b c d"), (13, "a b c d"), (13, "e f g h"), (14, "e f g h"), (None, two)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in ngram_join.ngram_jaccard(df, size=3, num=9, den=10).collect()}
    assert got == {(i, 5) for i in (5, 6, 7, 8, None)} | {(9, 9), (10, 9), (3, 3), (11, 11), (12, 12), (13, 12), (14, 12)}
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df.where("doc_id < 9"), "").collect()}
    assert kept == {3, 5}
