"""Groups of spelling variants by a dictionary of trie-node pairs (operator 12).

All words are read into two tries, forwards and from the end. Trie nodes are numbered; a word is then, at each place, a pair
of numbers: the node of what is before and the node of what is behind. Two words differ by one replaced code point where
both have a pair that skips the place, and by one inserted code point where a pair that skips a place of the longer word is
a pair without skip of the shorter one. So exact neighbours come from equal integer pairs; nothing is compared with all words.

A node is found by the hash of its path, never by the path itself: a word of m code points costs m rows, not m strings. The
words of each pair found are compared in the end, so a hash cannot make neighbours.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import written
from tidemark.llm._text import BASE, cut_out, mix, runs, slices, string_column

SLICE = 4 << 20  # bytes of text counted at a time
LONG_RUN = 48  # bytes; the checksums of longer runs are taken one by one
_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def crc_table() -> np.ndarray:
    """What each low byte adds to a crc32."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value


_CRC = crc_table()


def _checksums(data: np.ndarray, first: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """crc32 of each run of bytes, going on from the checksum ``seed``."""
    out = np.zeros(len(first), np.uint32)
    for i in np.flatnonzero(size > LONG_RUN):
        out[i] = zlib.crc32(data[first[i] : first[i] + size[i]].tobytes(), int(seed[i]))
    short = np.flatnonzero(size <= LONG_RUN)
    short = short[np.argsort(-size[short], kind="stable")]
    count = np.searchsorted(-size[short], -np.arange(LONG_RUN), side="left")  # runs that reach so far
    state = ~seed[short]
    for k in range(LONG_RUN):
        n = count[k]
        if not n:
            break
        state[:n] = _CRC[(state[:n] ^ data[first[short[:n]] + k]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    out[short] = ~state
    return out


def _counts(least: int, typo_every: int):
    """Distinct words of each slice of texts with their number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for row, _, raw, offsets in slices(string_column(batch, "text"), SLICE):
                latin = raw == 0xC3  # leads U+00C0 to U+00FF
                letter = _ASCII_LETTER[raw] | latin
                letter[1:] |= latin[:-1]
                first, size = runs(letter, offsets)
                heads = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
                points = heads[first + size] - heads[first]
                take = points >= least
                first, size, points = first[take], size[take], points[take]
                data = _LOWER[raw]
                if typo_every:
                    owner = row + np.searchsorted(offsets, first, side="right") - 1
                    named = np.unique(owner)
                    seeds = np.array([zlib.crc32(f"{'' if ids[i] is None else ids[i]}:".encode()) for i in named], np.uint32)
                    check = _checksums(data, first, size, seeds[np.searchsorted(named, owner)])
                    typo = check % np.uint32(typo_every) == 0
                else:
                    check = typo = np.zeros(len(first), bool)
                changed = []
                for i in np.flatnonzero(typo & (points > least)):
                    word = data[first[i] : first[i] + size[i]].tobytes().decode()
                    cut = int(check[i]) % len(word)
                    changed.append(word[:cut] + word[cut + 1 :])
                first, size = first[~typo], size[~typo]
                words = cut_out(data, first, size, pa.large_string())
                for column in (words, pa.array(changed, pa.large_string())):
                    found = pc.value_counts(column)
                    yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], names=["word", "n"])

    return work


def word_counts(df: DataFrame, *, least_length: int = 6, least_count: int = 5, typo_every: int = 0) -> DataFrame:
    """(word, n): maximal runs of ASCII letters and U+00C0 to U+00FF in ``text``, A-Z lower-cased, of ``least_length`` code points and ``least_count`` occurrences.

    ``typo_every``: made misspellings, for measuring. With h the crc32 of ``<doc_id>:<run>``, a run whose h is a multiple of it
    loses its code point h % length. Null text has no words; null doc_id is written as nothing. Repeated rows count again.
    """
    pieces = df.select("doc_id", "text").mapInArrow(_counts(least_length, typo_every), "word string, n long")
    return pieces.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At each place of each word the hashes of the paths before and behind it, with and without the code point there."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
        for row, end, data, offsets in slices(string_column(batch, "word")):
            at = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
            points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            with np.errstate(over="ignore"):
                code = mix(points.astype(np.uint64) + np.uint64(1))
                power, inverse = (np.append(np.uint64(1), np.cumprod(np.full(len(points), b, np.uint64))) for b in (BASE, _INVERSE))
                ahead, back = (np.append(np.uint64(0), np.cumsum(code * p[:-1])) for p in (power, inverse))
                size = np.diff(at)
                word = np.repeat(np.arange(end - row), size + 1)
                place = np.arange(len(word)) - np.repeat(at[:-1] + np.arange(end - row), size + 1)
                here, start, stop = at[word] + place, at[word], at[word + 1]
                before = mix((ahead[here] - ahead[start]) * inverse[start] + place.astype(np.uint64))
                behind = mix((back[stop] - back[here]) * power[stop] + (stop - here).astype(np.uint64))
            skips = np.flatnonzero(here < stop)
            for kind, left, right in ((False, np.arange(len(word)), np.arange(len(word))), (True, skips, skips + 1)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row + word[left]]), pa.array(place[left].astype(np.int32)), pa.array(np.full(len(left), kind)), pa.array(before[left].view(np.int64)), pa.array(behind[right].view(np.int64))],
                    names=["id", "place", "skip", "before", "behind"],
                )


def neighbours(words: DataFrame) -> DataFrame:
    """(id, near): ordered pairs of different words of ``words`` (id, word: both unique) with exactly one inserted, deleted or replaced code point.

    A pair of nodes holds at most one word for each letter of the alphabet, so no list of words grows with the table.
    """
    places = written(words.select("id", "word").mapInArrow(_pairs, "id long, place int, skip boolean, before long, behind long"), "spelling")

    def numbered(side: str) -> DataFrame:
        return written(places.select(side).distinct().withColumn(f"{side}_node", F.monotonically_increasing_id()), "spelling")

    held = places.join(numbered("before"), "before").join(numbered("behind"), "behind")
    held = written(held.select("id", "place", "skip", "before_node", "behind_node"), "spelling")
    node = ["before_node", "behind_node"]
    skip = held.where("skip").select("id", "place", *node)
    plain = held.where("not skip").select(F.col("id").alias("near"), *node)
    replaced = skip.join(skip.select(F.col("id").alias("near"), *node), node).where("id < near").select("id", "near", "place", F.lit(True).alias("replaced"))
    inserted = skip.join(plain, node).select("id", "near", "place", F.lit(False).alias("replaced"))
    found = replaced.unionByName(inserted).groupBy("id", "near").agg(F.min(F.struct("place", "replaced")).alias("at"))
    both = found.join(words.select("id", F.col("word").alias("a")), "id").join(words.select(F.col("id").alias("near"), F.col("word").alias("b")), "near")

    def without(word: str):
        return F.concat(F.substring(word, F.lit(1), F.col("at.place")), F.substring(word, F.col("at.place") + 2, F.length(word)))

    true = both.where(F.when(F.col("at.replaced"), without("b")).otherwise(F.col("b")) == without("a")).select("id", "near")
    true = written(true, "spelling")
    return true.unionByName(true.select(F.col("near").alias("id"), F.col("id").alias("near")))


def spelling_variants(counts: DataFrame, *, factor: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) per word of ``counts`` (word, n).

    form: the near word of largest n (ties: the smallest in code-point order) if its n is ``factor`` (2 or more) times the word's, else
    null; root: the last word on the way from form to form, the word itself if it has none. Near: see ``neighbours``. Words
    that are null are left out; the n of a word that is given twice is summed. Extra columns are left out.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more")
    words = counts.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = written(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling")
    near = neighbours(words).join(words.select(F.col("id").alias("near"), F.col("word").alias("w"), F.col("n").alias("m")), "near")
    best = near.groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "w", "near")).alias("best"))
    large = -F.col("best.minus") >= factor * F.col("n")
    whole = words.join(best, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(large, F.col("best.w")).alias("form"),
        F.when(large, -F.col("best.minus")).alias("form_n"), F.when(large, F.col("best.near")).alias("up"),
    )
    whole = written(whole, "spelling")
    ups, most = whole.where("up is not null").select("id", "up"), whole.agg(F.max("n")).first()[0] or 1
    steps = 1  # n grows by the factor at each step, so a way has log(most) steps; each turn doubles what is known of it
    while factor**steps < most:
        steps += 1
    for _ in range(steps.bit_length()):
        further = ups.select(F.col("id").alias("up"), F.col("up").alias("next"))
        ups = written(ups.join(further, "up", "left").select("id", F.coalesce("next", "up").alias("up")), "spelling")
    roots = ups.join(words.select(F.col("id").alias("up"), F.col("word").alias("root")), "up").select("id", "root")
    return whole.drop("up").join(roots, "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
