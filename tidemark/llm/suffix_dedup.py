"""Removal of byte strings that also start earlier, by a suffix order (operator 11).

Each window of ``length`` bytes is led by an anchor: the leftmost of its least hashed grams of ``GRAM`` bytes. What leads
a window depends on its bytes alone, so equal windows hang on equal anchors. A suffix here starts at an anchor; its leading
tokens are the anchor's gram and the stretch of text that its windows cover.

1. Suffixes are range-partitioned by these tokens; Spark samples the splitters, and document and place break ties, so the
   suffixes of a hot passage are dealt to many buckets. A bucket sorts by multikey quicksort. In a run of equal tokens all
   but the first are repeats; firsts that share a gram with another stretch, or lie at a bucket's edge, go on.
2. Their stretches are range-partitioned by the gram's bytes. A bucket sorts the windows by multikey quicksort, words of
   eight bytes at a time; of equal windows all but the first are repeats.
3. A gram with more than ``WHOLE_GRAM`` stretches is dealt to several buckets. Where it lies at a bucket's edge, the first
   window of each kind is compared across buckets.

Only tokens and places of all suffixes are shuffled, and bytes only for step 2, so most text moves once, for the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import written
from tidemark.llm._text import BASE, cut_out, mix, runs, slices, string_column

GRAM = 24  # bytes of an anchor
BUCKET_BYTES = 32 << 20  # of text whose suffixes make a bucket of step 1
BUCKET_STRETCHES = 100_000  # of a bucket of step 2
WHOLE_GRAM = 50_000  # stretches of a gram that stay in one bucket
NULL_ID = -(2**63)  # a null doc_id goes first
_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_CODES = np.random.default_rng(20251101).integers(1, 2**63, 256, dtype=np.uint64)


def multikey_order(keys: Sequence[np.ndarray | Callable[[np.ndarray], np.ndarray]], runs: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): the rows by several keys, each key sorting only what the keys before left equal.

    A key is an array, or a function from row numbers to values, which is asked for tied rows alone. same[i]: rows i and
    i + 1 of the order agree in the first ``runs`` keys.
    """
    order, tied = np.arange(rows), np.ones(max(rows - 1, 0), bool)
    same = tied
    for turn, key in enumerate(keys):
        at = np.flatnonzero(np.append(tied, False) | np.append(False, tied)) if rows > 1 else np.zeros(0, np.int64)
        if len(at):
            run = np.cumsum(np.append(True, ~tied))[at]
            value = key(order[at]) if callable(key) else key[order[at]]
            inner = np.argsort(value, kind="stable") if run[0] == run[-1] else np.lexsort((value, run))
            order[at] = order[at][inner]
            value = value[inner]
            tied = np.zeros(rows - 1, bool)
            tied[at[:-1][(value[1:] == value[:-1]) & (run[1:] == run[:-1])]] = True
        if turn + 1 == runs:
            same = tied
    return order, same


def _rolled(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each place on, by doubling."""
    value, have = _CODES[data], 1
    with np.errstate(over="ignore"):
        while have < size:
            step = min(have, size - have)
            value = value[:-step] * BASE + value[step:]
            value ^= value >> np.uint64(31)
            have += step
    return mix(value)


def _least(value: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive values."""
    have = 1
    while have < size:
        step = min(have, size - have)
        value = np.minimum(value[:-step], value[step:])
        have += step
    return value


def _suffixes(length: int):
    """Anchors of the windows inside each text: gram hash, hash of the stretch, document, and start, windows and anchor packed."""
    grams = length - GRAM + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("d", "tie"))
            for row, _, data, offsets in slices(string_column(batch, "text")):
                if len(data) < length:
                    continue
                hashed = _rolled(data, GRAM)
                low = np.uint64(0xFFFFFFFF)
                led = (_least((hashed & ~low) | np.arange(len(hashed), dtype=np.uint64), grams) & low).astype(np.int64)
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(led)]
                whole = np.arange(length, length + len(led)) <= offsets[owner + 1]
                new = led[1:] != led[:-1]
                first = np.flatnonzero(whole & np.append(True, new | ~whole[:-1]))
                last = np.flatnonzero(whole & np.append(new | ~whole[1:], True))
                with np.errstate(over="ignore"):
                    powers = np.cumprod(np.full(len(data), BASE, np.uint64))
                    total = np.append(np.uint64(0), np.cumsum(_CODES[data] * powers))
                    back = np.cumprod(np.full(len(data), _INVERSE, np.uint64))[first]
                    stretch = mix(mix((total[last + length] - total[first]) * back) + (last - first).astype(np.uint64) * BASE)
                start = first - offsets[owner[first]]
                at = (start << 14) | ((last - first + 1) << 7) | (led[first] - first)
                of = row + owner[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashed[led[first]].view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(ids[of]), pa.array(ties[of]), pa.array(at)],
                    names=["gram", "stretch", "d", "tie", "at"],
                )

    return work


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    """The named number columns of a whole bucket; splitters bound its rows."""
    held = [[b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*held, strict=True)] if held else []


def _token_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = _columns(batches, ["gram", "stretch", "d", "tie", "at"])
    if not columns:
        return
    order, same = multikey_order(columns, 2, len(columns[0]))
    gram, stretch, d, tie, at = (c[order] for c in columns)
    fresh = np.append(True, ~same)
    group = np.cumsum(np.append(True, gram[1:] != gram[:-1])) - 1
    open_ = np.bincount(group, weights=fresh) > 1
    open_[[0, -1]] = True
    take = ~fresh | open_[group]
    yield pa.RecordBatch.from_arrays([*(pa.array(c[take]) for c in (d, tie, at)), pa.array(gram[take], mask=~fresh[take])], names=["d", "tie", "at", "gram"])


def _words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one big-endian number; the bytes behind the end are 0."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray(len(data) + 1, ">u8", padded.tobytes(), strides=(1,))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of each entry of a list column."""
    lists = lists.cast(pa.large_list(pa.int64()))
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False)


def _stretches(length: int):
    """The bytes of the stretches named by ``ats``, with the anchor's gram as three words; ``wide`` tells whose gram is dealt to several buckets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("d", "tie"))
            for row, end, data, offsets in slices(string_column(batch, "text")):
                of, at = _flat(batch.column(batch.schema.get_field_index("ats")).slice(row, end - row))
                wide, at = at < 0, np.abs(at)
                start, size = offsets[of] + (at >> 14), ((at >> 7) & 127) + length - 1
                word, lead = _words(data), start + (at & 127)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(word[lead + 8 * i].astype(np.uint64).view(np.int64)) for i in range(GRAM // 8)), pa.array(ids[row + of]), pa.array(ties[row + of]), pa.array(at), pa.array(wide), cut_out(data, start, size, pa.large_binary()).cast(pa.binary())],
                    names=["t0", "t1", "t2", "d", "tie", "at", "wide", "bytes"],
                )

    return work


def _byte_bucket(length: int):
    """One span (start, end) of the repeated windows of each stretch; and, for wide grams at the bucket's edges, each first window with a 128-bit mark."""
    places = sorted({*range(0, length - 7, 8), length - 8}, key=lambda p: (p != length - 8, p))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        columns = _columns(iter(held), ["t0", "t1", "t2", "d", "tie", "at", "wide"])
        if not columns:
            return
        order, same = multikey_order(columns[:3], 3, len(columns[0]))
        d, tie, at, wide = (c[order] for c in columns[3:])
        text = pa.concat_arrays([b.column(b.schema.get_field_index("bytes")).cast(pa.large_binary()) for b in held])
        base = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text)][order]
        word = _words(np.frombuffer(text.buffers()[2], np.uint8))
        group = np.cumsum(np.append(True, ~same)) - 1
        edge = wide & ((group == 0) | (group == group[-1]))
        start, windows, lead = at >> 14, (at >> 7) & 127, at & 127
        low, high = np.full(len(at), length, np.int64), np.full(len(at), -1, np.int64)
        for before in range(int(lead.max()) + 1):  # windows whose anchor is so many bytes behind their start
            rows = np.flatnonzero((before <= lead) & (before > lead - windows))
            if not len(rows):
                continue
            shift = lead[rows] - before
            place = base[rows] + shift
            keys = [group[rows], *(lambda i, p=p: word[place[i] + p].astype(np.uint64) for p in places if p < before or p + 8 > before + GRAM)]
            inner, equal = multikey_order([*keys, d[rows], tie[rows], start[rows] + shift], len(keys), len(rows))
            first = np.append(True, ~equal)
            again = inner[~first]
            np.minimum.at(low, rows[again], shift[again])
            np.maximum.at(high, rows[again], shift[again])
            open_ = inner[first & edge[rows[inner]]]
            if len(open_):
                marks = []
                with np.errstate(over="ignore"):
                    for salt in (1, 2):
                        mark = np.full(len(open_), salt, np.uint64)
                        for p in places:
                            mark = mix(mark * BASE + word[place[open_] + p].astype(np.uint64))
                        marks.append(mark.view(np.int64))
                r, s = rows[open_], start[rows[open_]] + shift[open_]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[r], tie[r], s, s + length, *marks)], names=["d", "tie", "start", "end", "m1", "m2"])
        r = np.flatnonzero(high >= 0)
        none = pa.nulls(len(r), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(d[r]), pa.array(tie[r]), pa.array(start[r] + low[r]), pa.array(start[r] + high[r] + length), none, none], names=["d", "tie", "start", "end", "m1", "m2"])

    return work


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal runs of the spans of each text, and its bytes outside them."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        ids, spans = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "spans"))
        for row, end, data, offsets in slices(string_column(batch, "text")):
            lists = spans.slice(row, end - row)
            of = np.repeat(np.arange(end - row), lists.value_lengths().fill_null(0).to_numpy())
            pairs = lists.flatten()
            first, last = (offsets[of] + pairs.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, first, 1)
            np.add.at(change, last, -1)
            gone = np.cumsum(change)[:-1] > 0
            begin, size = runs(gone, offsets)
            owner = np.searchsorted(offsets, begin, side="right") - 1
            parts = pa.StructArray.from_arrays([pa.array(begin - offsets[owner]), pa.array(begin + size - offsets[owner])], names=["start", "end"])
            bounds = np.append(0, np.cumsum(np.bincount(owner, minlength=end - row))).astype(np.int32)
            left = np.append(0, np.cumsum(~gone))
            kept = pa.Array.from_buffers(pa.large_binary(), end - row, [None, pa.py_buffer(left[offsets].astype(np.int64)), pa.py_buffer(data[~gone].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(row, end - row), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(bounds), parts).cast(kind), kept.cast(pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )


def suffix_dedup(df: DataFrame, *, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) per row of ``df`` (doc_id, text): its maximal repeated runs of bytes and the bytes outside.

    A byte goes if it is covered by a string of ``length`` bytes (GRAM + 8 to 127) of its text that also starts earlier: in a
    document of smaller doc_id, or before it in the same one. Strings overlap freely, are judged on the input and never cross
    texts. Null text is empty; null doc_id is the smallest. Rows of equal doc_id and text are one document and get the same
    result; different texts of one doc_id are ordered by their hash. ``kept`` is binary, as a cut may part a character.
    Extra columns are left out.
    """
    if not GRAM + 8 <= length <= 127:
        raise ValueError(f"length must be from {GRAM + 8} to 127")
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"), "text")
    most, size = docs.groupBy("d").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).agg(F.max("n"), F.sum("b")).first()
    repeated = (most or 0) > 1
    docs = docs.select("doc_id", "d", (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("tie"), "text")
    base = docs.dropDuplicates(["d", "tie"]) if repeated else docs
    buckets = max(1, -(-(size or 0) // BUCKET_BYTES))
    suffixes = base.select("d", "tie", "text").mapInArrow(_suffixes(length), "gram long, stretch long, d long, tie long, at long")
    dealt = suffixes.repartitionByRange(buckets, "gram", "stretch", "d", "tie", "at")
    sorted_ = written(dealt.mapInArrow(_token_bucket, "d long, tie long, at long, gram long"), "suffix")

    fresh = sorted_.where("gram is not null")
    wide = fresh.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE_GRAM).select("gram", F.lit(-1).alias("sign"))
    marked = fresh.join(wide, "gram", "left").select("d", "tie", (F.col("at") * F.coalesce("sign", F.lit(1))).alias("at"))  # at is over 0
    wanted = marked.groupBy("d", "tie").agg(F.collect_list("at").alias("ats"))  # at most one for each byte of a document
    stretches = base.join(wanted, ["d", "tie"]).mapInArrow(_stretches(length), "t0 long, t1 long, t2 long, d long, tie long, at long, wide boolean, bytes binary")
    deal = F.when(F.col("wide"), F.xxhash64("d", "tie", "at")).otherwise(F.lit(0))
    dealt = stretches.withColumn("deal", deal).repartitionByRange(fresh.count() // BUCKET_STRETCHES + 1, "t0", "t1", "t2", "deal")
    found = written(dealt.mapInArrow(_byte_bucket(length), "d long, tie long, start long, end long, m1 long, m2 long"), "suffix")

    place = F.struct("d", "tie", "start")
    edges = found.where("m1 is not null")
    firsts = edges.groupBy("m1", "m2").agg(F.min(place).alias("first"))
    across = edges.join(firsts, ["m1", "m2"]).where(place > F.col("first"))
    start = F.shiftright("at", 14)
    whole = sorted_.where("gram is null").select("d", "tie", start.alias("start"), (start + F.shiftright("at", 7).bitwiseAND(F.lit(127).cast("long")) + (length - 1)).alias("end"))
    spans = whole.unionByName(found.where("m1 is null").drop("m1", "m2")).unionByName(across.select("d", "tie", "start", "end"))
    per_text = spans.groupBy("d", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = docs.join(per_text, ["d", "tie"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
