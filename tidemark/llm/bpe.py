"""BPE encoding and decoding with a pair occurrence index (operator 10).

The words that a slice of a partition has not met before are laid out as linked lists of symbols in arrays. An index maps
each mergeable pair, by its rank, to all its positions; a heap holds the active ranks, the lowest is applied next at all its
positions at once, and only the lists of the pairs beside the merges are updated. Words already encoded come from a bounded table per worker.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import Memo, slices, string_column
from tidemark.llm.token_counts import WHITE

MEMO_WORDS = 60_000
_LIMIT = 0x250  # below: Latin; texts with other characters are normalised by the library itself
_loaded: dict[str, Model] = {}


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _class(test) -> str:
    return "".join(re.escape(chr(c)) for c in range(_LIMIT) if test(chr(c)))


class Model:
    """Vocabulary, merges and text rules of a tokenizer file of the word-end BPE kind."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges([(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs])
        self.library = Tokenizer.from_file(path)
        self.alphabet = byte_alphabet()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letter, number = _class(lambda c: unicodedata.category(c)[0] == "L"), _class(lambda c: unicodedata.category(c)[0] == "N")
        space = re.escape(WHITE)
        self.latin_words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")
        low = {c: chr(c).lower() for c in range(_LIMIT) if chr(c) not in WHITE}
        odd = [c for c, small in low.items() if self.library.normalizer.normalize_str(chr(c)) != small or max(small) >= chr(_LIMIT)]
        self.other = re.compile(f"[^\x00-{chr(_LIMIT - 1)}]" + (f"|[{''.join(re.escape(chr(c)) for c in odd)}]" if odd else ""))
        self.memo = Memo(MEMO_WORDS)  # word: token count, ids as text, tokens as text

    def words(self, text: str) -> list[str]:
        """Pre-tokens in order; special strings stay whole."""
        if not text:
            return []
        if self.split_special is None or "<|" not in text:
            return self._plain(text)
        return [w for part in self.split_special.split(text) if part for w in ([part] if part in self.special else self._plain(part))]

    def _plain(self, text: str) -> list[str]:
        if self.other.search(text) is None:
            return self.latin_words.findall(unicodedata.normalize("NFC", text).lower()) if not text.isascii() else self.latin_words.findall(text.lower())
        text = self.library.normalizer.normalize_str(text)
        raw = {c: b for b, c in self.alphabet.items()}
        return [bytes(raw[c] for c in piece).decode("utf-8", "surrogateescape") for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def symbols(self, word: str) -> list[int]:
        """Byte symbols of a word, the last with the word-end mark; a symbol the vocabulary lacks is left out, as the library does."""
        out = [self.alphabet[b] for b in word.encode("utf-8", "surrogateescape")]
        out[-1] += self.end
        return [self.ids[s] for s in out if s in self.ids]

    def learn(self, new: list[str]) -> None:
        """Encode unseen words together."""
        special = [w for w in new if w in self.special]
        for w in special:
            self.memo.young[w] = 1, str(self.special[w]), w
        plain = [w for w in new if w not in self.special]
        tokens = self.tokens
        for word, ids in zip(plain, merge_words([self.symbols(w) for w in plain], self.merges), strict=True):
            self.memo.young[word] = len(ids), " ".join(map(str, ids)), " ".join([tokens[i] for i in ids])


class Merges:
    """The merge table as sorted arrays: pair of symbols to rank, and per rank the two symbols and what they make."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        self.left, self.right, self.made = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        keys = self.left << 32 | self.right
        order = np.argsort(keys, kind="stable")
        first = np.append(True, np.diff(keys[order]) > 0)[: len(keys)]
        self.keys, self.ranks = keys[order][first], order[first]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the table has none."""
        if not len(self.keys):
            return np.full(len(left), -1)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def merge_words(words: list[list[int]], merges: Merges) -> list[list[int]]:
    """Apply ``merges`` to symbol lists by one pair occurrence index over all of them.

    Equal to encoding each word alone, where the lowest rank goes first and its leftmost place before others: a step takes
    the lowest active rank and, of its places, the leftmost of each word; the word's other places wait in the index, so a
    lower rank that the merge brings up is applied before them.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    total = int(sizes.sum())
    symbol = np.fromiter((s for ids in words for s in ids), np.int64, total)
    owner = np.repeat(np.arange(len(words)), sizes)
    following, previous = np.arange(1, total + 1), np.arange(-1, total - 1)
    ends = np.cumsum(sizes)[sizes > 0]
    following[ends - 1] = -1
    previous[ends - sizes[sizes > 0]] = -1
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(ranks: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, group in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
            if (lists := index.get(rank)) is None:
                index[rank] = [group]
                heapq.heappush(active, rank)
            else:
                lists.append(group)

    here = np.flatnonzero(following >= 0)
    ranks = merges.rank(symbol[here], symbol[here + 1])
    if (known := ranks >= 0).any():
        add(ranks[known], here[known])
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        places = np.sort(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        places = places[(symbol[places] == merges.left[rank]) & (following[places] >= 0)]
        after = following[places]
        places = places[symbol[after] == merges.right[rank]]
        if not len(places):
            continue
        of = owner[places]
        leftmost = np.append(True, of[1:] != of[:-1])
        if not leftmost.all():
            index[rank] = [places[~leftmost]]
            heapq.heappush(active, rank)
            places = places[leftmost]
        after = following[places]
        beyond = following[after]
        symbol[places] = merges.made[rank]
        symbol[after] = -1
        following[places] = beyond
        inner = beyond >= 0
        previous[beyond[inner]] = places[inner]
        before = previous[places]
        lefts = np.concatenate([before[before >= 0], places[inner]])
        if len(lefts):
            ranks = merges.rank(symbol[lefts], symbol[following[lefts]])
            if (known := ranks >= 0).any():
                add(ranks[known], lefts[known])
    left = symbol >= 0
    kept = symbol[left].tolist()
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner[left], minlength=len(words)))]).tolist()
    return [kept[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def _model(path: str) -> Model:
    if path not in _loaded:
        _loaded[path] = Model(path)
    return _loaded[path]


def encode_texts(texts: list[str], path: str) -> Iterator[tuple[int, str, str]]:
    """(token count, ids joined by spaces, decoded text) of each whole text."""
    model = _model(path)
    split = [model.words(text) for text in texts]
    model.learn(sorted(model.memo.missing(set().union(*split))))
    for words in split:
        entries = [e for e in map(model.memo.young.__getitem__, words) if e[0]]
        if entries:
            counts, ids, tokens = zip(*entries, strict=True)
            yield sum(counts), " ".join(ids), " ".join(tokens)
        else:
            yield 0, "", ""


def encode_decode(df: DataFrame, path: str, *, text: str = "text", digests: bool = False) -> DataFrame:
    """``df`` without its text column, plus ``n_tokens`` (long) and ``ids`` and ``decoded`` (string), or their SHA-256 digests.

    ``ids`` are decimal ids joined by one space; ``decoded`` is what the library's decoder makes of them (this file kind
    has none: tokens joined by one space). Null text is empty: no ids, empty decoded text. Repeated rows each keep
    theirs; columns with the new names are replaced. One narrow Arrow pass; whole texts, in slices of bounded bytes.
    """
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    kept = [c for c in df.columns if c not in (text, *added)]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    schema = source.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias(added[0]), *[F.lit("").alias(c) for c in added[1:]]).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = string_column(batch, "__text")
            for first, end, _, _ in slices(column, 1 << 21):
                n, ids, decoded = [], [], []
                for count, a, b in encode_texts(column.slice(first, end - first).to_pylist(), path):
                    n.append(count)
                    ids.append(hashlib.sha256(a.encode()).hexdigest() if digests else a)
                    decoded.append(hashlib.sha256(b.encode()).hexdigest() if digests else b)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, end - first) for c in batch.columns[:-1]), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=[*kept, *added],
                )

    return source.mapInArrow(work, schema)
