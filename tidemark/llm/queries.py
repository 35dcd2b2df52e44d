"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, chunk_dedup, embed_dedup, fingerprints, mixing, ngram_join, phrases, spelling, suffix_dedup, token_counts, toxicity, warc
from tidemark.llm._common import shared_folder

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; the files are not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, tokenizer("word_bpe_49k.json"), digests=True)


@query
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return mixed.select("doc_id", "mix_domain", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "mix_tokens", "mix_epoch")


ORACLES["op8_mixing"] = mixing.mix_sql()


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = chat.read_back(chat.format_records(chat.turn_records(rows)))
    return read.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


ORACLES["op3_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 19 WHEN 'assistant' THEN 12
    ELSE 17 + 2 * length(role) - length(translate(role, '<[]\', '')) END
  + 2 * length(text) - length(translate(text, '<[\', '')) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    written = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    n = written.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    if not n:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return warc.read_archives(spark, folder)


_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((concat('0x', substr(s, {5 * (k // 4) + 1}, 5))::BIGINT >> {15 - 5 * (k % 4)}) & 31)::BIGINT + 1, 1)" for k in range(32)
)
ORACLES["op6_warc"] = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS last_id FROM p)
SELECT page_id, payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last_id THEN last_id END AS refers_to FROM g
"""


@query
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op4_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id
"""


@query
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard(table(spark, sf_dir, "documents"), size=3, num=9, den=10)


ORACLES["op7_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n + b.n) AS total FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p WHERE 100 * common >= 90 * (total - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id FROM s JOIN c ON c.a = s.doc_id
"""


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).select("doc_id", "p_junk", "p_toxic", toxicity.rejected(F.col("p_toxic"), chain).alias("rejected"))


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op11_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, 100 * j AS o, substr(x, 200 * j + 1, 398) AS y FROM (SELECT doc_id, x, unnest(range(0, (len(x) // 2 - 99) // 100 + 1)) AS j FROM d)),
p AS (SELECT doc_id, o, y, unnest(range(0, least(100, len(y) // 2 - 99))) AS i FROM c),
h AS MATERIALIZED (SELECT doc_id, o + i AS s, md5_number(substr(y, 2 * i + 1, 200)) AS h FROM p),
f AS (SELECT h, min({'d': doc_id, 's': s}) AS first FROM h GROUP BY h HAVING count(*) > 1),
w AS (SELECT doc_id, s, first FROM h JOIN f USING (h)),
r AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM w WHERE first <> {'d': doc_id, 's': s}),
q AS (SELECT doc_id, s, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM r),
k AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM q GROUP BY 1, 2),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM k),
t AS (SELECT d.doc_id, any_value(d.x) AS x, coalesce(sum(b - a), 0)::BIGINT AS n_removed, count(a) AS n_spans, coalesce(max(b), 0) AS e,
  coalesce(string_agg(substr(x, 2 * e + 1, 2 * (a - e)), '' ORDER BY a), '') AS kept FROM d LEFT JOIN g USING (doc_id) GROUP BY 1)
SELECT doc_id, len(x) // 2 AS n_bytes, n_removed, n_spans, sha256(unhex(kept || substr(x, 2 * e + 1))) AS kept_sha256 FROM t
"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.word_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), least_length=6, least_count=5, typo_every=199)
    return spelling.spelling_variants(counts, factor=5).select("word", "form", "root", "n", "n_near", "form_n")


ORACLES["op12_spelling_variants"] = f"""
WITH RECURSIVE a AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
b AS (SELECT run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM a WHERE length(run) >= 6 GROUP BY doc_id, run),
c AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda i: concat('0x', substr(x, i, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, {spelling.crc_table().tolist()}[(xor(c, b) & 255) + 1]))) AS h FROM b),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM c
  GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
s AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT x.word AS p, y.word AS q FROM s x JOIN s y ON x.v = y.v AND x.i = y.i AND x.word <> y.word
  UNION SELECT s.word, w.word FROM s JOIN w ON s.v = w.word UNION SELECT w.word, s.word FROM s JOIN w ON s.v = w.word),
r AS (SELECT p, q, w.n AS m, count(*) OVER (PARTITION BY p) AS n_near, row_number() OVER (PARTITION BY p ORDER BY w.n DESC, q) AS k FROM e JOIN w ON w.word = q),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN q END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM w LEFT JOIN r ON r.p = w.word AND k = 1),
t AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, t.root FROM f JOIN t ON f.form = t.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN t USING (word)
"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"), least_count=30, top=2000, share=80)


ORACLES["op13_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w[i:i + k] AS v FROM s, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE i + k <= len(w)),
f AS (SELECT lang, array_to_string(v, ' ') AS phrase, any_value(v) AS v, count(*) AS f FROM g GROUP BY 1, 2),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(v) = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE len(v) > 1 AND f >= 30),
i AS (SELECT lang, array_to_string(v[a:b], ' ') AS phrase, max(f) AS outer_f FROM c, (SELECT a, b FROM range(1, 5) x(a), range(1, 5) y(b)) WHERE a < b AND b <= len(v) AND b - a + 1 < len(v) GROUP BY 1, 2),
k AS (SELECT c.* FROM c LEFT JOIN i USING (lang, phrase) WHERE outer_f IS NULL OR 100::HUGEINT * outer_f < 80::HUGEINT * f),
t AS (SELECT lang, phrase, f AS a, k, array_to_string(v[1:k], ' ') AS head, array_to_string(v[k + 1:], ' ') AS tail FROM k, range(1, 4) x(k) WHERE k < len(v)),
q AS (SELECT t.lang, t.phrase, a, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score, k FROM t JOIN f x ON x.lang = t.lang AND x.phrase = head JOIN f y ON y.lang = t.lang AND y.phrase = tail),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
