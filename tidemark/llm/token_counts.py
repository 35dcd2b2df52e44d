"""Token counts of whole texts (operator 5): Arrow functions that return lengths only.

Texts are split at safe boundaries: before a white-space run that follows a non-space character, and between a word of
letters and digits and a stop mark. The byte-level pre-tokenizer never builds a token across such a place, so the counts of
the pieces add up to the count of the whole text (files whose special strings hold such a place are counted on whole texts). Pieces repeat a lot; each task asks the
library once per distinct piece, in batches balanced by bytes, and keeps a bounded table of counts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import Memo, slices, string_column

#: The characters with the Unicode property White_Space (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_PIECE = re.compile(rf"[{WHITE}]*[^\W_]+(?=[.,;:!?])|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_UNSAFE = re.compile(rf"[{WHITE}.,;:!?]")
BATCH_BYTES = 1 << 18
MEMO_PIECES = 300_000
_loaded: dict[str, tuple] = {}


def _library(path: str):
    """(count function, memo, whether pieces may be counted alone) of a tokenizer file, loaded once per Python worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task owns one core
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            split = False  # sentencepiece normalises across white space
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            count = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            spec = json.loads(model.to_str())
            split = spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["pre_tokenizer"]["use_regex"]
            split = split and not spec["pre_tokenizer"]["add_prefix_space"] and not any(_UNSAFE.search(x["content"]) or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"])
        _loaded[path] = count, Memo(MEMO_PIECES), split
    return _loaded[path]


def _balanced(pieces: list[str], limit: int) -> Iterator[list[str]]:
    """Batches of about equal bytes: longest first, so that lengths within a batch are alike."""
    pieces.sort(key=len, reverse=True)
    batch, held = [], 0
    for piece in pieces:
        batch.append(piece)
        held += len(piece)
        if held >= limit:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def count_batch(texts: list[str], path: str) -> list[int]:
    """Token counts of whole texts; pieces only where the library's pre-tokenizer allows it (.json byte-level files)."""
    count, memo, may_split = _library(path)
    if not may_split:
        return [n for batch in _in_order(texts) for n in count(batch)]
    split = [_PIECE.findall(text) for text in texts]
    for batch in _balanced(list(memo.missing(set().union(*split))), BATCH_BYTES):
        memo.young.update(zip(batch, count(batch), strict=True))
    known = memo.young.__getitem__
    return [sum(map(known, pieces)) for pieces in split]


def _in_order(texts: list[str]) -> Iterator[list[str]]:
    batch, held = [], 0
    for text in texts:
        batch.append(text)
        held += len(text)
        if held >= BATCH_BYTES:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def token_counts(df: DataFrame, path: str, *, text: str = "text", tokens: str = "n_tokens") -> DataFrame:
    """``df`` without its text column, plus ``n_bytes`` (UTF-8) and ``tokens`` (long) per row.

    Null text counts as empty (0 bytes, 0 tokens). Rows, repeated ones too, keep their other columns; a column that
    already has one of the new names is replaced. No shuffle: one narrow Arrow pass over the texts.
    """
    kept = [c for c in df.columns if c not in (text, "n_bytes", tokens)]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    schema = source.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias(tokens)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = string_column(batch, "__text")
            sizes, counts = [], []
            for first, end, _, offsets in slices(column):
                sizes += (offsets[1:] - offsets[:-1]).tolist()
                counts += count_batch(column.slice(first, end - first).to_pylist(), path)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[*kept, "n_bytes", tokens]
            )

    return source.mapInArrow(work, schema)
