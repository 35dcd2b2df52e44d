"""Phrase collocations by prefix-free parsing (operator 13).

A text is cut where its content says so: a word begins a chunk if the hash of it and the word before is a multiple of
``CHUNK``. A chunk also holds the first words of the next one, so each phrase lies whole in some chunk; it is counted where
its first word is the chunk's own, so overlaps count once. Equal chunks make one entry of a dictionary, with the number of
their places in the parse; all counting is done inside the entries, times that number.

Words are counted first. Pairs are counted for words that are frequent, phrases where all their pairs are frequent: what
occurs often has parts that do. Which hashes are frequent is told by bit sieves of fixed size, so workers get the same
8 MB whatever the table; a sieve may let rare ones pass, and their exact counts end them. Counting itself is by the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import written
from tidemark.llm._text import BASE, cut_out, mix, runs, slices, string_column, words

MOST = 4  # words of a phrase
CHUNK = 24  # words of a chunk, about
SIEVE_BITS = 1 << 26
GATHER = 8 << 20  # bytes of dictionary entries counted at a time
BLANK, END = 0x20, 0x0A  # between words; between pieces
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[0x09] = BLANK
_NORMAL[[*b".,;:!?", *range(0x0A, 0x0E)]] = END
_GAPS = np.zeros(256, bool)
_GAPS[[BLANK, END]] = True


def _parse(length: int):
    """Chunks of the texts: language, number of own words, bytes from the first word to the last one of the overlap."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(batch.schema.get_field_index("lang")).cast(pa.string()).fill_null("und")
            for row, _, raw, offsets in slices(string_column(batch, "text"), 4 << 20):
                data = _NORMAL[raw]
                first, size = runs(~_GAPS[data], offsets)
                if not len(first):
                    continue
                value, owner = words(data, offsets, _GAPS)
                with np.errstate(over="ignore"):
                    cut = mix(value[1:] + BASE * value[:-1]) % np.uint64(length) == 0
                start = np.flatnonzero(np.append(True, cut | (owner[1:] != owner[:-1])))
                stop = np.append(start[1:], len(first))
                last = np.searchsorted(owner, owner[start], side="right") - 1  # of the text
                last = np.minimum(stop + MOST - 2, last)
                chunk = cut_out(data, first[start], first[last] + size[last] - first[start], pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(row + owner[start])), pa.array((stop - start).astype(np.int32)), chunk], names=["lang", "own", "chunk"])

    return work


class _Entries:
    """Dictionary entries of a batch: their words with hashes, weights and whether a phrase may start or go on there."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        column = batch.column("chunk").combine_chunks().cast(pa.large_string())
        n = len(column)
        self.offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        self.data = np.frombuffer(column.buffers()[2], np.uint8)[self.offsets[0] : self.offsets[-1]]
        self.offsets = self.offsets - self.offsets[0]
        self.first, self.size = runs(~_GAPS[self.data], self.offsets)
        value, owner = words(self.data, self.offsets, _GAPS)
        names = batch.column("lang").combine_chunks().dictionary_encode()
        self.langs = names.dictionary
        self.lang = names.indices.to_numpy().astype(np.int64)[owner]
        salt = np.array([zlib.crc32(x.encode()) for x in self.langs.to_pylist()], np.uint64)
        with np.errstate(over="ignore"):
            self.hash = mix(value + mix(salt)[self.lang] * BASE)
            self.pair = mix(self.hash[:-1] * BASE + self.hash[1:])
        begin = np.searchsorted(owner, np.arange(n))
        self.own = np.arange(len(owner)) - begin[owner] < batch.column("own").to_numpy()[owner]
        piece = np.cumsum(self.data == END)[self.first]
        self.next = (owner[1:] == owner[:-1]) & (piece[1:] == piece[:-1])  # a phrase may go on from a word to the next
        self.weight = batch.column("freq").to_numpy()[owner]

    def spelled(self, where: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """(code of each word at ``where``, distinct words)."""
        coded = cut_out(self.data, self.first[where], self.size[where], pa.large_string()).dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[_Entries]:
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.get_total_buffer_size()
        if size > GATHER:
            yield _Entries(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield _Entries(pa.Table.from_batches(held))


def _summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, a place of each, sum of its weights)."""
    key, where, back = np.unique(key, return_index=True, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, back, weight)
    return key, where, total


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, hash, n), and a row without word for all words of a language."""
    for e in _entries(batches):
        at = np.flatnonzero(e.own)
        code, spelled = e.spelled(at)
        _, where, n = _summed(code * len(e.langs) + e.lang[at], e.weight[at])
        yield pa.RecordBatch.from_arrays(
            [e.langs.take(pa.array(e.lang[at][where])), spelled.take(pa.array(code[where])).cast(pa.string()), pa.array(e.hash[at][where].view(np.int64)), pa.array(n)],
            names=["lang", "phrase", "hash", "n"],
        )
        lang, _, n = _summed(e.lang[at], e.weight[at])
        yield pa.RecordBatch.from_arrays([e.langs.take(pa.array(lang)), pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.int64()), pa.array(n)], names=["lang", "phrase", "hash", "n"])


def _in(sieve: np.ndarray, value: np.ndarray) -> np.ndarray:
    bit = (value & np.uint64(SIEVE_BITS - 1)).astype(np.int64)
    return (sieve[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _count_pairs(frequent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in _entries(batches):
            known = _in(frequent.value, e.hash)
            at = np.flatnonzero(e.own[:-1] & e.next & known[:-1] & known[1:])
            key, _, n = _summed(e.pair[at], e.weight[at])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["hash", "n"])

    return work


def _count_phrases(frequent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in _entries(batches):
            good = e.next & _in(frequent.value, e.pair)
            used = np.flatnonzero(np.append(good, False) | np.append(False, good))
            if not len(used):
                continue
            code, spelled = e.spelled(used)
            codes = np.zeros(len(e.first), np.int64)
            codes[used] = code
            start = np.flatnonzero(e.own[:-1] & good)
            key = codes[start] * len(e.langs) + e.lang[start]
            for size in range(2, MOST + 1):
                if size > 2:  # one word more
                    on = start + size - 2 < len(good)
                    on[on] = good[start[on] + size - 2]
                    start, key = start[on], key[on]
                key = np.unique(key, return_inverse=True)[1] * len(spelled) + codes[start + size - 1]
                _, where, n = _summed(key, e.weight[start])
                parts = [spelled.take(pa.array(codes[start[where] + k])) for k in range(size)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([e.langs.take(pa.array(e.lang[start[where]])), phrase, pa.array(n)], names=["lang", "phrase", "n"])

    return work


def _sieve(hashes: DataFrame) -> np.ndarray:
    """SIEVE_BITS bits, set where a hash of ``hashes`` falls; made by Spark in blocks of 4 KB, so the driver gets 8 MB at most."""
    bit = F.col("hash").bitwiseAND(F.lit(SIEVE_BITS - 1)) + 1
    blocks = hashes.select(F.bitmap_bucket_number(bit).alias("block"), F.bitmap_bit_position(bit).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    sieve = np.zeros(SIEVE_BITS // 8, np.uint8)
    for block, bits in blocks.toLocalIterator():
        part = np.frombuffer(bytes(bits), np.uint8)
        sieve[(block - 1) * 4096 : (block - 1) * 4096 + len(part)] = part
    return sieve


def phrase_counts(df: DataFrame, least_count: int = 30, *, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of phrases of 1 to ``MOST`` words with f of at least ``least_count``, and (lang, n) of all words."""
    context = df.sparkSession.sparkContext
    chunks = df.select("lang", "text").mapInArrow(_parse(chunk), "lang string, own int, chunk string")
    entries = written(chunks.groupBy("lang", "own", "chunk").agg(F.count("*").alias("freq")), "phrases")
    counted = entries.mapInArrow(_count_words, "lang string, phrase string, hash long, n long").groupBy("lang", "phrase").agg(F.min("hash").alias("hash"), F.sum("n").alias("n"))
    single = written(counted.where(F.col("phrase").isNull() | (F.col("n") >= least_count)), "phrases")
    common = context.broadcast(_sieve(single.where("phrase is not null")))
    pairs = entries.mapInArrow(_count_pairs(common), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    paired = context.broadcast(_sieve(pairs))
    longer = entries.mapInArrow(_count_phrases(paired), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    found = longer.unionByName(single.where("phrase is not null").drop("hash")).select("lang", "phrase", F.col("n").alias("f"))
    return written(found, "phrases"), single.where("phrase is null").select("lang", "n")


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(30,0)")


def collocations(df: DataFrame, *, least_count: int = 30, top: int = 2000, share: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to 4 words of each language of ``df`` (lang, text).

    A-Z are lower-cased; [.,;:!?] and \\x0A to \\x0D end a piece; words are runs of other than blank and tab; phrases lie in one
    piece. n counts all words of the language, f all places of a phrase, overlapping ones too; null text is empty, null lang
    is ``und``, repeated rows count again. a = f(phrase) is at least ``least_count``. Cut after its first words, a phrase has l
    and r, the f of its parts, and the score floor(2000000 a / (l + r)); the cut of lowest score counts, of several the first.
    Phrases inside a longer one with at least ``share`` % of their f are dropped. Ties in score: larger a, then the
    phrase in byte order. Sums are whole numbers, quotients decimals of 38 digits. Extra columns are left out.
    """
    found, sizes = phrase_counts(df, least_count)
    parts = F.split("phrase", " ")
    phrases = found.withColumn("words", parts).where(F.size("words") > 1)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.array_join(F.slice("words", i, k), " "))))
    inside = phrases.where(F.size("words") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("outer"))
    kept = phrases.join(inside, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (_exact("outer") * 100 < _exact("f") * share))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("tail"))
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    cuts = cuts.withColumn("score", F.expr("cast(a as decimal(30,0)) * 2000000 div (cast(l as decimal(30,0)) + cast(r as decimal(30,0)))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.score", "best.l", "best.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
