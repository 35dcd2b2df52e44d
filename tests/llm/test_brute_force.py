"""Operators and pipeline stages that SQL can't express against plain Python or the libraries, over whole tables."""

import itertools
import random
import re
import struct

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import _text, bpe, chat, chunk_dedup, embed_dedup, fingerprints, mixing, ngram_join, queries, toxicity, warc

SF = "/root/testdata/sf0.001"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def join(sets, num, den):
    """Smallest id reachable, by comparing all pairs."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and common * den >= num * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB é日 \t\n.\x0b", max_size=40), max_size=8), st.integers(1, 5), st.integers(1, 60))
def test_shingles(texts, size, limit):
    column = pa.array(texts, pa.large_string())
    got = []
    for first, end, data, offsets in _text.slices(column, limit):
        grams, bounds = _text.shingles(data, offsets, size)
        got += [frozenset(grams[bounds[i] : bounds[i + 1]].tolist()) for i in range(end - first)]
    want = [shingle_set(t, size) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for (g, w), (h, v) in itertools.combinations(zip(got, want, strict=True), 2):
        assert len(g & h) == len(w & v)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdefg '1.É!", max_size=30), max_size=6), st.randoms(use_true_random=False))
def test_merges_equal_one_by_one(texts, rng):
    """Random merge tables, also with later ranks that bring up earlier ones."""
    symbols, pairs = list(range(7)), []
    for made in range(7, 30):
        pairs.append((rng.choice(symbols), rng.choice(symbols), made))
        symbols.append(made)
    rng.shuffle(pairs)
    pairs = list({p[:2]: p for p in pairs}.values())
    rank = {p[:2]: (i, p[2]) for i, p in enumerate(pairs)}
    lists = [[ord(c) % 7 for c in t] for t in texts]

    def alone(ids):
        ids = list(ids)
        while True:
            best = min(((rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank), default=None)
            if best is None:
                return ids
            i = best[1]
            ids[i : i + 2] = [rank[tuple(ids[i : i + 2])][1]]

    assert bpe.merge_words(lists, bpe.Merges(pairs)) == [alone(x) for x in lists]


def test_tokenizers_whole_table(spark, documents):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    by_bytes, by_words = (Tokenizer.from_file(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    for r in queries.QUERIES["op5_token_counts"](spark, SF).collect():
        assert r.n_tokens == len(by_bytes.encode(texts[r.doc_id], add_special_tokens=False)) and r.over_limit == (r.n_tokens > 512)
    for r in bpe.encode_decode(documents, public_tokenizers.path("word_bpe_49k.json")).collect():
        ids = by_words.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == " ".join(map(str, ids)) and r.decoded == by_words.decode(ids, skip_special_tokens=False)


def test_odd_characters():
    from tidemark.llm import token_counts

    rng = random.Random(5)
    odd = ["x" + chr(c) + "y 1" + chr(c) + "." + chr(c) + " " + chr(c) for c in range(1, 0x3100)]
    odd += ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(1, 128), 32, rng.randrange(0x250, 0x3000)])) for _ in range(50)) for _ in range(500)]
    odd += ["<|endoftext|> a <|endoftext|>b", "<|startoftext|>HI<|endoftext|> ΟΔΟΣ é", "a,b.c 3,000 it's,. we'll!"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    assert token_counts.count_batch(odd, path) == [len(e) for e in library.encode_batch(odd, add_special_tokens=False)]
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = [ids for _, ids, _ in bpe.encode_texts(odd, path)]
    assert got == [" ".join(map(str, e.ids)) for e in library.encode_batch(odd, add_special_tokens=False)]


def test_fingerprint_accuracy(documents):
    texts = [r.text or "" for r in documents.collect()]
    edited = [t[: len(t) - len(t) // k] + u[: len(t) // k] for (t, u), k in zip(zip(texts, texts[1:], strict=False), itertools.cycle((2, 4, 10, 30)), strict=False)]
    marks = fingerprints.fingerprints(pa.array([*texts[:-1], *edited], pa.large_string()))
    got = fingerprints.likeness(marks[: len(edited)], marks[len(edited) :])
    want = np.array([len(a & b) / max(1, len(a | b)) for a, b in ((shingle_set(t, 5), shingle_set(e, 5)) for t, e in zip(texts, edited, strict=False))])
    assert np.abs(got - want).mean() < 0.03 and np.abs(got - want).max() < 0.15 and abs((got - want).mean()) < 0.01


def test_embedding_recall():
    """Made pairs at a cosine of exactly the threshold: at least 99 % share two pivots (0.9 is asked for)."""
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(4000, 64)) + 1.5 * rng.normal(size=(10, 64))[rng.integers(0, 10, 4000)]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    side = rng.normal(size=rows.shape)
    side -= (side * rows).sum(1, keepdims=True) * rows
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.95 * rows + np.sqrt(1 - 0.95**2) * side
    pivots = rows[: embed_dedup.PIVOTS]
    a, b = embed_dedup.nearest(rows, pivots, embed_dedup.PREFIX), embed_dedup.nearest(near, pivots, embed_dedup.PREFIX)
    shared = np.array([len(set(x) & set(y)) for x, y in zip(a, b, strict=True)])
    assert (shared >= 2).mean() >= 0.99


def test_embedding_blocks(spark):
    """Near copies over many small blocks: counts and components as by brute force."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = np.repeat(base, 25, axis=0) + 0.05 * rng.normal(size=(300, 16))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embed_dedup.embedding_duplicates(df, block=7).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    assert [got[i].n_links for i in range(300)] == (linked.sum(axis=1) - 1).tolist()
    assert {got[i].component_id for i in range(300)} == {25 * k for k in range(12)}


def near_copies(rng, n):
    vocabulary = [f"t{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    for _ in range(n // 12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(2, 120))] + passage * rng.randrange(0, 2)
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("size", "num", "den"), [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_ngram_join(spark, monkeypatch, size, num, den):
    monkeypatch.setattr(ngram_join, "FREQUENT", 20)
    if size == 3:  # all rounds, and long masks for most pairs
        for name, value in (("DENSE", -1), ("SAMPLE", 2), ("ROUNDS", 2), ("LONG_SET", 40)):
            monkeypatch.setattr(ngram_join, name, value)
    texts = near_copies(random.Random(size), 480)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = join({i: shingle_set(t, size) for i, t in enumerate(texts)}, num, den)
    rows = ngram_join.ngram_jaccard(df, size=size, num=num, den=den).collect()
    assert {r.doc_id: r.component_id for r in rows} == want and len(set(want.values())) < len(want)


def test_chunks_resist_insertions():
    rng = random.Random(3)
    body = "".join(rng.choice("abcdefghij klmnopqrst") for _ in range(20_000)).encode()
    moved = body[:7000] + b"INSERTED" + body[7000:]

    def chunks(text):
        data = np.frombuffer(text, np.uint8)
        ends = chunk_dedup.chunk_ends(data, np.array([0, len(data)]))[0]
        return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    a, b = chunks(body), chunks(moved)
    assert b"".join(a) == body and b"".join(b) == moved and len(set(a) ^ set(b)) <= 8


def reference_chunks(text):
    """The chunk rule written out byte by byte."""
    data = text.encode()
    h = []
    for i in range(len(data)):
        value = sum(int(chunk_dedup._GEAR[data[i - k]]) << k for k in range(chunk_dedup.WINDOW) if i >= k) & 0xFFFFFFFF
        h.append(value if i + 1 == len(data) or (data[i + 1] & 0xC0) != 0x80 else 2**32 - 1)
    r = chunk_dedup.REACH
    ends = [i + 1 for i in range(len(h)) if h[i] < 2**32 - 1 and all(h[i] < x for x in h[max(0, i - r) : i]) and all(h[i] <= x for x in h[i + 1 : i + 1 + r])]
    ends = ends if not h or ends[-1:] == [len(h)] else [*ends, len(h)]
    out, last = [], 0
    for end in ends:
        while end - last > chunk_dedup.LONGEST:
            last += chunk_dedup.LONGEST
            while (data[last] & 0xC0) == 0x80:
                last -= 1
            out.append(last)
        out.append(end)
        last = end
    return [data[a:b] for a, b in zip([0, *out], out, strict=False)]


def cut(texts):
    """Texts by id without chunks that a smaller id, or the text itself before, has; runs under the least length stay."""
    parts = {i: reference_chunks(t) for i, t in texts.items()}
    first = {}
    for i in sorted(parts):
        for c in parts[i]:
            first.setdefault(c, i)
    out = {}
    for i, chunks in parts.items():
        seen, kept, run = set(), b"", b""
        for c in [*chunks, None]:
            if c is not None and (c in seen or first[c] < i):
                run += c
                continue
            kept += b"" if len(run) >= chunk_dedup.LEAST_RUN else run
            run = b""
            if c is not None:
                seen.add(c)
                kept += c
        out[i] = kept.decode()
    return out


def test_pipeline_stages(spark, documents):
    """Each stage on its predecessor's rows, as plain Python, a library or SQL gives them."""
    at = documents.where("n_chars < 6000").limit(120)
    at = spark.createDataFrame(at.collect(), at.schema)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, at, SF)
    assert kept.columns == at.columns
    chain = toxicity.train(at, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = at.collect()
    hashes = [toxicity.text_words(np.frombuffer(r.text.lower().encode(), np.uint8), np.array([0, len(r.text.lower().encode())]))[0] for r in rows]
    p = [toxicity.predict(chain, h, np.zeros(len(h), np.int64), 1)[0, 1] for h in hashes]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r, x in zip(rows, p, strict=True) if x < toxicity.THRESHOLD}

    texts = {r.doc_id: r.text for r in kept.collect()}
    unique = stages["near_duplicates"](spark, kept, SF)
    roots = join({i: shingle_set(t, 5) for i, t in texts.items()}, 4, 5)
    assert {r.doc_id for r in unique.collect()} == {i for i, root in roots.items() if i == root}

    texts = {r.doc_id: r.text for r in unique.collect()}
    clean = stages["substrings"](spark, unique, SF)
    got = {r.doc_id: r.text for r in clean.collect()}
    assert got == cut(texts) and all(r.n_chars == len(r.text) for r in clean.collect())

    mixed = stages["mixture"](spark, clean, SF)
    con = duckdb.connect()
    con.register("documents", clean.toArrow())
    want = sorted(r[0] for r in con.execute(mixing.mix_sql()).fetchall())
    assert sorted(r.doc_id for r in mixed.collect()) == want

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in stages["bpe"](spark, mixed, SF).collect():
        assert r.ids == " ".join(map(str, library.encode(got[r.doc_id], add_special_tokens=False).ids))


def test_toxicity_held_out(spark):
    """Trained on one part of the labelled rows, right on the other."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    rows = toxicity.score(docs.join(labels.where("doc_id % 3 = 0").select("doc_id", "toxic"), "doc_id"), chain).select("toxic", "p_toxic").toPandas()
    said = rows["p_toxic"] >= toxicity.THRESHOLD
    assert said[rows["toxic"] == 1].mean() > 0.85 and said[rows["toxic"] == 0].mean() < 0.01
    assert [link.name for link in chain] == ["junk", "toxic"] and len(chain[1].earlier) == 1


LAYOUTS = [
    ("messages", {"id": 3, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}),
    ("message parts", {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "model", "content": [{"type": "text", "text": "a"}]}]}),
    ("from and value", {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}),
    ("prompt and response", {"prompt": "q", "response": "a"}),
    ("prompt and completion", {"prompt": "q", "completion": "a", "meta": {"x": 1}}),
    ("instruction", {"instruction": "q", "output": "a"}),
    ("question and answer", {"question": "q", "answer": "a"}),
    ("turn rows", {"rows": [{"turn": 1, "role": "assistant", "text": "a"}, {"turn": 0, "role": "user", "text": "q"}]}),
]


@pytest.mark.parametrize(("layout", "record"), LAYOUTS)
def test_layouts(layout, record):
    import json

    by_hash, roots = chat.registry()
    assert chat.canonical(json.dumps(record), by_hash, roots)[1:] == (layout, [("user", "q"), ("assistant", "a")])


def test_unknown_layouts():
    by_hash, roots = chat.registry()
    for bad in (None, "", "[1]", "{", '{"prompt": "x"}', '{"prompt": "x", "messages": []}'):
        assert chat.canonical(bad, by_hash, roots)[1:] == ("", [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a]b", "[x"]), st.text(alphabet="<>[]/\\sINST \n", max_size=30)), max_size=6))
def test_template_round_trip(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert formatted.count("</s>") == sum(r == "assistant" for r, _ in turns)


def test_archive_faults():
    payloads = [(f"page {i} " * 50).encode() for i in range(40)]
    raw = [warc.record(i, "http://x", p, warc.payload_digest(p), None) for i, p in enumerate(payloads)]
    good = warc.archive(raw)
    assert list(warc.records(good)) == raw and struct.unpack_from("<II", good)[1] > 0
    with pytest.raises(warc.ArchiveError):
        list(warc.records(good[:-3]))
    with pytest.raises(warc.ArchiveError):
        list(warc.records(good[8:]))
    flipped = bytearray(good)
    flipped[-20] ^= 1
    with pytest.raises((warc.ArchiveError, zstandard.ZstdError)):
        list(warc.records(bytes(flipped)))
    for broken in (raw[0].replace(b"page 0", b"page 1"), raw[0].replace(b"WARC/1.1", b"WARC/9"), raw[0].replace(b"WARC-Date", b"X-Date"), raw[0][:-2]):
        with pytest.raises(warc.ArchiveError):
            warc.parse(broken)


def test_links_inside_isolated_groups(spark):
    """Triples of equal size and prefix that share no word with other triples: A-B is no link, B-C is one, A-C in every second triple."""
    rng, texts = random.Random(11), []
    for number in range(30):
        names = [f"x{number}w{i}" for i in range(60)]
        text = " ".join(names).encode()
        code = {w: _text.shingles(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), 1)[0][0] for w in names}
        assert set(code.values()) == set(_text.shingles(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 1)[0])
        ordered = sorted(names, key=code.get)
        for shift in (0, 8, 4 if number % 2 else 9):  # sets of 50 words, 11 of them the prefix; links have 45 in common
            chosen = ordered[:11] + ordered[11 + shift : 50 + shift]
            rng.shuffle(chosen)
            texts.append(" ".join(chosen))
    want = join({i: shingle_set(t, 1) for i, t in enumerate(texts)}, 4, 5)
    assert [want[i] for i in range(6)] == [0, 1, 1, 3, 3, 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = ngram_join.ngram_jaccard(df, size=1, num=4, den=5).collect()
    assert {r.doc_id: r.component_id for r in rows} == want


def test_embedding_hot_cluster(spark):
    """A third of the vectors in one cluster of different near copies: nearly all pairs are found, each counted once."""
    rng = np.random.default_rng(4)
    n, hot, size = 3000, 1000, 64
    rows = rng.normal(size=(n, size))
    rows[:hot] = rows[0] + 0.18 * rng.normal(size=(hot, size))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embed_dedup.embedding_duplicates(df, block=400).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert links[:hot].sum() > 0.9 * hot * (hot - 1)
    found = np.array([got[i].n_links for i in range(n)])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
