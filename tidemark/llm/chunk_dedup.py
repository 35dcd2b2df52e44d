"""Substring deduplication by content-defined chunks (operator 2).

A gear hash rolls over the last ``WINDOW`` bytes; a chunk ends where the hash is smaller than at the ``REACH`` places
around it. Boundaries thus depend on nearby bytes alone, and an insertion only changes the chunks it touches. Chunks are
compared by a 128-bit digest over all documents; every chunk but that of the smallest doc_id goes, if the run of such
chunks is long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import mix, slices, string_column

WINDOW, REACH, LONGEST = 16, 24, 256
LEAST_RUN = 64  # bytes; shorter runs of repeated chunks stay
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_NEVER = np.uint32(2**32 - 1)


def gear(codes: np.ndarray) -> np.ndarray:
    """The gear hash at each place: h = (h << 1) + code of the byte, over the last ``WINDOW`` bytes (by doubling)."""
    out, step = codes.copy(), 1
    while step < WINDOW:
        out[step:] += out[:-step] << np.uint32(step)
        step *= 2
    return out


def _least_ahead(h: np.ndarray, reach: int) -> np.ndarray:
    """min(h[i + 1 : i + 1 + reach]) for each i; beyond the end there is nothing smaller."""
    padded = np.concatenate([h[1:], np.full(reach + 1, _NEVER)])
    width = 1
    while width * 2 <= reach:
        padded = np.minimum(padded[:-width], padded[width:])
        width *= 2
    return np.minimum(padded[: len(h)], padded[reach - width : reach - width + len(h)])


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Chunk ends of each text, relative to its start; the last is the text's length. Characters are never cut."""
    texts, gap = len(offsets) - 1, max(WINDOW, REACH)
    starts = offsets[:-1] + gap * np.arange(1, texts + 1)
    at = np.arange(len(data)) + np.repeat(gap * np.arange(1, texts + 1), np.diff(offsets))
    codes = np.zeros(len(data) + gap * (texts + 1), np.uint32)
    codes[at] = _GEAR[data]
    h = np.full(len(codes), _NEVER)
    inside = np.ones(len(data), bool)
    inside[:-1] = (data[1:] & 0xC0) != 0x80  # the next byte begins a character
    if len(data):
        rolled = gear(codes)
        h[at[inside]] = rolled[at[inside]]
    cut = (h != _NEVER) & (h <= _least_ahead(h, REACH)) & (h < _least_ahead(h[::-1], REACH)[::-1])
    places = np.flatnonzero(cut)
    first = np.searchsorted(places, starts)
    out = []
    for t in range(texts):
        size, start = int(offsets[t + 1] - offsets[t]), int(starts[t])
        upto = first[t + 1] if t + 1 < texts else len(places)
        ends = (places[first[t] : upto] - start + 1).tolist()
        if size and (not ends or ends[-1] != size):
            ends.append(size)
        if len(ends) and max(np.diff([0, *ends])) > LONGEST:
            ends = _split(data[offsets[t] : offsets[t + 1]], ends)
        out.append(ends)
    return out


def _split(text: np.ndarray, ends: list[int]) -> list[int]:
    """Cut chunks over ``LONGEST`` bytes (monotonous text) at character starts."""
    out, last = [], 0
    for end in ends:
        while end - last > LONGEST:
            last += LONGEST
            while (text[last] & 0xC0) == 0x80:
                last -= 1
            out.append(last)
        out.append(end)
        last = end
    return out


def _digests(text: bytes, ends: list[int]) -> list[bytes]:
    start, out = 0, []
    for end in ends:
        out.append(xxhash.xxh3_128_digest(text[start:end]))
        start = end
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc_id) once per document and distinct chunk."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy()
        for first, end, data, offsets in slices(string_column(batch, "text")):
            found, counts = [], []
            for t, ends in enumerate(chunk_ends(data, offsets)):
                own = list(dict.fromkeys(_digests(data[offsets[t] : offsets[t + 1]].tobytes(), ends)))
                found += own
                counts.append(len(own))
            pairs = np.frombuffer(b"".join(found), dtype=">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(np.repeat(ids[first:end], counts))], names=["h1", "h2", "doc_id"]
            )


def _removed_spans(text: bytes, ends: list[int], elsewhere: set[int], least: int) -> tuple[list[tuple[int, int]], int]:
    """(spans to cut, number of chunks in them)."""
    seen: set[bytes] = set()
    runs: list[list[int]] = []
    start = 0
    for end, digest in zip(ends, _digests(text, ends), strict=True):
        if digest in seen or int.from_bytes(digest[:8], "big", signed=True) in elsewhere:
            if runs and runs[-1][1] == start:
                runs[-1][1:] = end, runs[-1][2] + 1
            else:
                runs.append([start, end, 1])
        seen.add(digest)
        start = end
    runs = [r for r in runs if r[1] - r[0] >= least]
    return [(a, b) for a, b, _ in runs], sum(n for _, _, n in runs)


def substring_dedup(df: DataFrame, *, least_run: int = LEAST_RUN) -> DataFrame:
    """``df`` (doc_id, text and more) with repeated passages cut out of ``text``; adds ``n_chunks``, ``n_removed``, ``removed_chars``.

    Of equal chunks the document of smallest doc_id keeps its first one. Rows with equal doc_id count as one document: none of
    them gives way to another, but chunks that repeat within a row go. Rows with null doc_id are neither compared nor changed. Null text stays
    null (0 chunks). A text that repeats wholly becomes empty; no row is dropped. Other columns pass through; columns with
    the new names are replaced. What an id loses is a set of chunks, so rows that repeat do not lengthen it; rows of one id
    with different texts each carry the set of all of them. The join meets all 128 bits of a digest; inside a document its first
    64 are looked up.

    Only (digest, doc_id) rows are compared; a passage that many documents share is summed before the shuffle, and its
    join is split where hot. Texts are shuffled once, to meet what goes from them.
    """
    added = ["n_chunks", "n_removed", "removed_chars"]
    plain = df.drop(*added)
    chunks = plain.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_chunks, "h1 long, h2 long, doc_id long")
    firsts = chunks.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("h1", "h2", "first")
    late = chunks.join(firsts, ["h1", "h2"]).where("doc_id <> first").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("h1").alias("__gone"))
    joined = plain.join(late, plain["doc_id"].cast("long") == late["__id"], "left").drop("__id")
    kept = plain.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = string_column(batch, "text")
            missing = batch.column(at).is_null().to_pylist()
            named = batch.column(batch.schema.get_field_index("doc_id")).is_valid().to_pylist()
            gone = batch.column(batch.schema.get_field_index("__gone"))
            for first, end, data, offsets in slices(texts):
                new, n, removed, chars = [], [], [], []
                for t, ends in enumerate(chunk_ends(data, offsets)):
                    row = first + t
                    text = data[offsets[t] : offsets[t + 1]].tobytes()
                    spans, cut = _removed_spans(text, ends, set(gone[row].as_py() or ()), least_run) if named[row] else ([], 0)
                    out, last, lost = [], 0, 0
                    for a, b in spans:
                        out.append(text[last:a])
                        lost += len(text[a:b].decode())
                        last = b
                    new.append(None if missing[row] else b"".join([*out, text[last:]]).decode())
                    n.append(len(ends))
                    removed.append(cut)
                    chars.append(lost)
                part = batch.slice(first, end - first)
                columns = [pa.array(new, pa.string()) if c == "text" else part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (n, removed, chars))], names=[*kept, *added])

    return joined.mapInArrow(work, f"{fields}, n_chunks long, n_removed long, removed_chars long")
