"""Document fingerprints by one-permutation MinHash (operator 9).

The 5-word shingles of a text are hashed once. A hash's top part names its bin, the smallest hash of a bin is its value;
empty bins take the value of the first non-empty bin in a fixed random order of their own (optimal densification). Of each
value the low ``BITS`` bits are stored, packed into a hex string; likeness corrects for chance agreement of so few bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import mix, shingles, slices, string_column

BINS, BITS, WORDS = 512, 4, 5
PROBES = 24
_EMPTY = np.uint64(2**64 - 1)
#: _ORDER[j, i]: the bin that bin j asks i-th; _RANK[j, b]: when bin j asks bin b. The same for all texts.
_ORDER = np.argsort(mix(np.arange(1, BINS * BINS + 1, dtype=np.uint64)).reshape(BINS, BINS), axis=1).astype(np.int64)
_RANK = np.argsort(_ORDER, axis=1)


def sketch(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, BINS) matrix of densified bin values; rows of texts without shingles stay empty."""
    texts = len(bounds) - 1
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    cell = owner * BINS + (grams >> np.uint64(55)).astype(np.int64)  # ascending: hashes ascend within a text
    values = np.full(texts * BINS, _EMPTY)
    if len(cell):
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        values[cell[first]] = mix(grams[first])  # the smallest hash of its bin, made independent of the bin
    values = values.reshape(texts, BINS)
    filled = values.copy()
    some = np.diff(bounds) > 0
    row, column = np.nonzero((values == _EMPTY) & some[:, None])
    for i in range(PROBES):
        if not len(row):
            break
        found = values[row, _ORDER[column, i]]
        hit = found != _EMPTY
        filled[row[hit], column[hit]] = found[hit]
        row, column = row[~hit], column[~hit]
    for text in np.unique(row):  # texts with few full bins: the first of them in each bin's order
        full = np.flatnonzero(values[text] != _EMPTY)
        bins = column[row == text]
        filled[text, bins] = values[text, full[np.argmin(_RANK[bins][:, full], axis=1)]]
    return filled


def pack(filled: np.ndarray, some: np.ndarray) -> list[str]:
    """Hex of the packed low-order bits; the empty string for a text without shingles."""
    low = (filled & np.uint64(2**BITS - 1)).astype(np.uint8)
    bits = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - BITS :].reshape(len(low), -1)
    packed = np.packbits(bits, axis=1)
    return [p.tobytes().hex() if s else "" for p, s in zip(packed, some, strict=True)]


def fingerprints(column: pa.LargeStringArray) -> list[str]:
    """Fingerprint of each whole text."""
    out: list[str] = []
    for _, _, data, offsets in slices(column):
        grams, bounds = shingles(data, offsets, WORDS)
        out += pack(sketch(grams, bounds), np.diff(bounds) > 0)
    return out


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Estimated Jaccard likeness, 0 to 1: share of equal values less the 2**-BITS that agree by chance.

    Two texts without shingles are alike (1.0); one with and one without are not (0.0).
    """
    out = np.array([float(x == y) for x, y in zip(a, b, strict=True)])
    both = np.array([i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x and y and x != y], dtype=np.int64)
    if len(both):
        bits = [np.unpackbits(np.frombuffer(bytes.fromhex("".join(s[i] for i in both)), np.uint8).reshape(len(both), -1), axis=1).reshape(len(both), BINS, BITS) for s in (a, b)]
        share = (bits[0] == bits[1]).all(axis=2).mean(axis=1)
        out[both] = np.clip((share - 2.0**-BITS) / (1 - 2.0**-BITS), 0, 1)
    return out


def document_fingerprints(df: DataFrame, *, text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """``df`` without its text column, plus ``fingerprint`` (string).

    Null text is empty; texts without words get "". Equal texts have equal fingerprints, so repeated rows do too. A
    column with the new name is replaced. One narrow Arrow pass over whole texts.
    """
    kept = [c for c in df.columns if c not in (text, fingerprint)]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    schema = source.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias(fingerprint)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = fingerprints(string_column(batch, "__text"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks, pa.string())], names=[*kept, fingerprint])

    return source.mapInArrow(work, schema)


def _long(value: int):
    return F.lit(value).cast("long")


def _runs(df: DataFrame, runs: int) -> DataFrame:
    """``df`` (doc_id, text) in consecutive ranges of descending id, each with the first row of the next range (ghost) behind it.

    Range bounds are quantiles of the ids, so equal ids share a range. Only the bounds and the ranges' first ids, at most
    ``runs`` of each, reach the driver; texts are shuffled once.
    """
    bounds = sorted(set(df.where("doc_id is not null").approxQuantile("doc_id", [i / runs for i in range(1, runs)], 0.2 / runs))) if runs > 1 else []
    bounds = [int(b) for b in bounds]
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    # descending ids: range 0 holds the largest, nulls are last
    place = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.size(F.filter(cuts, lambda b: b >= F.col("doc_id"))))
    heads = dict(df.select(place.alias("run"), "doc_id").groupBy("run").agg(F.max("doc_id").alias("head")).collect())
    used = sorted(heads)
    before = {run: used[i - 1] for i, run in enumerate(used)}  # the first range follows the last one
    named = {head: before[run] for run, head in heads.items() if head is not None}
    ghost_of = F.try_element_at(F.map_from_arrays(F.array(*map(_long, named)), F.array(*map(_long, named.values()))), F.col("doc_id")) if named else F.lit(None)
    if None in heads.values():
        ghost_of = F.when(F.col("doc_id").isNull(), F.lit(before[len(bounds) + 1])).otherwise(ghost_of)
    ghost_of = ghost_of.cast("int")
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), place.cast("int").alias("run"))
    return rows.select("doc_id", "text", F.explode(F.array_compact(F.array(F.struct("run", F.lit(False).alias("ghost")), F.when(ghost_of.isNotNull(), F.struct(ghost_of.alias("run"), F.lit(True).alias("ghost")))))).alias("to")).select(
        "doc_id", "text", "to.run", "to.ghost"
    )


RANGE_BYTES = 32 << 20  # of text in a range of ids, which one task handles
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_pairs(df: DataFrame, runs: int | None = None) -> DataFrame:
    """Fingerprints of each document, of its edited text and of the document that follows in descending id order.

    Edited text: the last floor(n/2) of a text's n code points are replaced by the first as many (or all) of the next
    document; after the smallest id comes the largest. Rows with equal ids are ordered by text; null ids come last. Null
    text is empty. A single document is followed by itself. Extra columns are left out.
    """
    named = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    runs = runs or (named.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES + 1
    rows = _runs(named, runs)
    rows = rows.repartitionById(runs + 1, "run").sortWithinPartitions("run", "ghost", F.col("doc_id").desc_nulls_last(), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []  # at most one slice of rows, and the one that waits for its next
        size, run, ghosts = 0, None, False

        def flush(last: tuple[int | None, str] | None) -> pa.RecordBatch | None:
            rows = held if last is None else [*held, last]
            if len(rows) < 2:
                return None
            ids, texts = zip(*rows, strict=True)
            n = [len(t) for t in texts[:-1]]
            edited = [t[: k - k // 2] + u[: k // 2] for t, u, k in zip(texts, texts[1:], n, strict=False)]
            marks = fingerprints(pa.array(texts, pa.large_string()))
            altered = fingerprints(pa.array(edited, pa.large_string()))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                 pa.array(marks[:-1], pa.string()), pa.array(altered, pa.string()), pa.array(likeness(marks[:-1], altered)), pa.array(likeness(marks[:-1], marks[1:]))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            for doc, text, part, ghost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != run:
                    held, size, run, ghosts = [], 0, part, False
                if ghost:
                    if not ghosts:  # rows that share the next range's first id: only the first of them follows
                        if (out := flush((doc, text))) is not None:
                            yield out
                        held, size, ghosts = [], 0, True
                    continue
                held.append((doc, text))
                size += len(text)
                if size > 1 << 20 and len(held) > 1:
                    if (out := flush(None)) is not None:
                        yield out
                    held, size = held[-1:], len(text)

    return rows.mapInArrow(work, SCHEMA)
