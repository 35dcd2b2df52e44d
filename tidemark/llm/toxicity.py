"""Toxicity by a classifier chain (operator 1).

Categories are predicted one after the other: the linear model of a category sees the words of a text and the
probabilities of the categories before it. Models later in the chain are trained on out-of-fold probabilities, so they meet
probabilities as uncertain as those they get on new texts. Fitted on a bounded sample of labelled rows, applied to all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import written
from tidemark.llm._text import marked_words, mix, slices, string_column

TRAIN_ROWS, TRAIN_BYTES = 12_000, 48 << 20  # bound of the sample of labelled rows: those of least id hash
FOLDS, LEAST_DOCS, LEAST_Z, MOST_WORDS = 5, 3, 4.5, 20_000  # words: in so many sampled texts, with so strong a relation to the label
RIDGE, STEPS = 0.05, 300
THRESHOLD = 0.2  # of 8,000 held-out labelled rows this finds 99.9 % of the toxic ones and rejects no other (tests/llm)


@dataclass(frozen=True)
class Category:
    """A category: its name, the label column and the value that means "yes"."""

    name: str
    column: str
    value: int = 1


CATEGORIES = (Category("junk", "quality", 0), Category("toxic", "toxic", 1))


@dataclass
class Link:
    """One model of the chain: word hashes (ascending) with weights, weights of earlier log-odds, intercept."""

    name: str
    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float


def lowered(batch: pa.RecordBatch) -> pa.LargeStringArray:
    return pc.utf8_lower(string_column(batch, "text"))


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes per text: (hashes, text numbers), sorted by text, then hash."""
    word, text = marked_words(data, offsets)
    order = np.lexsort((word, text))
    word, text = word[order], text[order]
    new = np.append(True, (word[1:] != word[:-1]) | (text[1:] != text[:-1]))[: len(word)]
    return word[new], text[new]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_link(name: str, words: np.ndarray, code: np.ndarray, row: np.ndarray, y: np.ndarray, earlier: np.ndarray) -> Link:
    """Ridge logistic regression on the words that relate to the label, and on earlier log-odds.

    words: hashes, ascending; code, row: pairs of place in ``words`` and row number; y: 0/1; earlier: (rows, k). Rows without the label are left out
    before.
    """
    n, yes = len(y), float(y.sum())
    if not n or yes in (0, n):  # nothing to learn: the observed share, smoothed
        return Link(name, np.zeros(0, np.uint64), np.zeros(0), np.zeros(earlier.shape[1]), float(_log_odds(np.array((yes + 0.5) / (n + 1)))))
    df, hits = np.bincount(code, minlength=len(words)), np.bincount(code, weights=y[row], minlength=len(words))
    share = yes / n
    z = (hits - df * share) / np.sqrt(df * share * (1 - share) * (1 - df / (n + 1)) + 1e-9)
    good = np.flatnonzero((df >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z))
    good = np.sort(good[np.argsort(-np.abs(z[good]), kind="stable")[:MOST_WORDS]])
    place = np.full(len(words), -1, np.int32)
    place[good] = np.arange(len(good))
    at = place[code]
    kept = at >= 0
    row, at = row[kept], at[kept]
    k, m = earlier.shape[1], len(good)
    held = np.bincount(row, minlength=n) + 1 + (np.abs(earlier).sum(axis=1) if k else 0)  # bounds the curvature, one step size per weight
    scale = 0.25 * np.concatenate([np.bincount(at, weights=held[row], minlength=m), (np.abs(earlier) * held[:, None]).sum(axis=0), [held.sum()]]) + RIDGE
    w = np.zeros(m + k + 1)
    w[-1] = np.log(share / (1 - share))
    ahead, momentum = w.copy(), 1.0
    penalty = np.full(m + k + 1, RIDGE)
    penalty[-1] = 0
    for _ in range(STEPS):
        margin = np.bincount(row, weights=ahead[at], minlength=n) + earlier @ ahead[m : m + k] + ahead[-1]
        error = _sigmoid(margin) - y
        slope = np.concatenate([np.bincount(at, weights=error[row], minlength=m), earlier.T @ error, [error.sum()]]) + penalty * ahead
        step = ahead - slope / scale
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = step + (momentum - 1) / following * (step - w)
        w, momentum = step, following
    return Link(name, words[good], w[:m], w[m : m + k], float(w[-1]))


def margins(link: Link, word: np.ndarray, row: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
    """Log-odds of rows 0..n-1."""
    out = earlier @ link.earlier + link.intercept
    if len(link.words) and len(word):
        at = np.minimum(np.searchsorted(link.words, word), len(link.words) - 1)
        hit = link.words[at] == word
        out = out + np.bincount(row[hit], weights=link.weights[at[hit]], minlength=n)
    return out


def fit_chain(word: np.ndarray, row: np.ndarray, fold: np.ndarray, labels: list[tuple[str, np.ndarray]], folds: int = FOLDS) -> list[Link]:
    """Models in order; ``labels``: (name, values 0/1, NaN where unknown), ``fold``: fold of each row."""
    n, chain = len(fold), []
    words, code = np.unique(word, return_inverse=True)
    code, row = code.astype(np.int32), row.astype(np.int32)
    earlier = np.zeros((n, 0))
    for number, (name, y) in enumerate(labels):
        known = ~np.isnan(y)

        def fit(rows: np.ndarray, name=name, y=y, earlier=earlier) -> Link:
            place = np.full(n, -1, np.int32)
            place[rows] = np.arange(len(rows))
            at = place[row]
            use = at >= 0
            return fit_link(name, words, code[use], at[use], y[rows], earlier[rows])

        chain.append(fit(np.flatnonzero(known)))
        if number + 1 < len(labels):
            out = np.zeros(n)
            for f in range(folds):
                held = fold == f
                link = fit(np.flatnonzero(known & ~held))
                use = held[row]
                place = np.cumsum(held) - 1
                out[held] = margins(link, words[code[use]], place[row[use]], int(held.sum()), earlier[held])
            earlier = np.column_stack([earlier, _log_odds(_sigmoid(out))])
    return chain


def predict(chain: list[Link], word: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(n, categories) probabilities; each model gets those before it."""
    earlier = np.zeros((n, 0))
    out = []
    for link in chain:
        out.append(_sigmoid(margins(link, word, row, n, earlier)))
        earlier = np.column_stack([earlier, _log_odds(out[-1])])
    return np.column_stack(out) if out else np.zeros((n, 0))


def learned(chain: list[Link], name: str) -> bool:
    """Whether the model of ``name`` tells texts apart: by words, or by an earlier model that does."""
    link = next(link for link in chain if link.name == name)
    return len(link.words) > 0 or any(w != 0 and learned(chain, before.name) for w, before in zip(link.earlier, chain, strict=False))


def rejected(probability: Column, chain: list[Link], name: str = "toxic") -> Column:
    """Whether a text is rejected; a model that gives every text the same probability rejects none."""
    return probability >= THRESHOLD if learned(chain, name) else F.lit(False)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [c for c in batch.schema.names if c != "text"]
        for first, end, data, offsets in slices(lowered(batch)):
            word, text = text_words(data, offsets)
            bounds = np.searchsorted(text, np.arange(end - first + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(word.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).slice(first, end - first) for c in kept), lists], names=[*kept, "words"])


def train(docs: DataFrame, labels: DataFrame, categories: tuple[Category, ...] = CATEGORIES, *, rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> list[Link]:
    """Fit the chain on at most ``rows`` labelled documents and ``max_bytes`` of their text: those of least hash of doc_id.

    Rows without doc_id or without any label are not used; of repeated ids the smallest text is taken. Without labelled documents every
    probability is the smoothed share of nothing, 0.5; ``rejected`` then rejects nothing.
    """
    named = [F.max(F.when(F.col(c.column).isNotNull(), (F.col(c.column) == c.value).cast("double"))).alias(f"y{i}") for i, c in enumerate(categories)]
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(*named).where(F.coalesce(*[f"y{i}" for i in range(len(categories))]).isNotNull())
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most ``rows`` rows of a few numbers
    values = [f"y{i}" for i in range(len(categories))]
    texts = texts.groupBy("doc_id", *values).agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))  # repeated ids, before anything is written or sent
    texts = texts.withColumn("size", F.octet_length("text").cast("long"))
    schema = "doc_id long, " + ", ".join(f"y{i} double" for i in range(len(categories))) + ", size long, words array<long>"
    found = texts.select(F.col("doc_id").cast("long"), *[f"y{i}" for i in range(len(categories))], "size", "text").where(F.col("size") <= max_bytes).mapInArrow(_features, schema)
    found = written(found, "toxicity")
    sizes = found.select("size", F.xxhash64("doc_id").alias("h")).toArrow()  # at most ``rows`` rows
    h, size = sizes.column("h").to_numpy(), sizes.column("size").to_numpy()
    order = np.argsort(h, kind="stable")
    taken = h[order][np.cumsum(size[order]) <= max_bytes]
    table = found.where(F.xxhash64("doc_id") <= int(taken[-1])).toArrow() if len(taken) else found.limit(0).toArrow()
    table = table.take(np.argsort(table.column("doc_id").to_numpy(), kind="stable")) if len(table) else table
    lists = table.column("words").combine_chunks()
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    word = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    ids = table.column("doc_id").to_numpy().astype(np.int64)
    fold = (mix(ids.view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    rows_of = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
    values = [(c.name, table.column(f"y{i}").to_numpy(zero_copy_only=False).astype(np.float64)) for i, c in enumerate(categories)]
    del table, lists
    return fit_chain(word, rows_of, fold, values)


def score(df: DataFrame, chain: list[Link], *, prefix: str = "p_") -> DataFrame:
    """``df`` with a probability column per category (``p_toxic``); null text is empty, repeated rows score alike.

    Columns with the new names are replaced, others stay in the JVM: one Arrow function takes the whole text and returns the
    probabilities. The chain, at most ``MOST_WORDS`` words a category, goes to the executors once.
    """
    added = [prefix + link.name for link in chain]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in added]
    sent = df.sparkSession.sparkContext.broadcast(chain)
    names = [f"p{i}" for i in range(len(added))]

    def work(texts: pa.Array) -> pa.Array:
        column = texts.cast(pa.large_string()).fill_null("")
        parts = [np.zeros((0, len(names)))]
        for first, end, _, _ in slices(column):  # lower-cased a slice at a time
            for _, n, data, offsets in slices(pc.utf8_lower(column.slice(first, end - first)), 1 << 40):
                word, text = text_words(data, offsets)
                parts.append(predict(sent.value, word, text, n))
        p = np.concatenate(parts)
        return pa.StructArray.from_arrays([pa.array(p[:, i]) for i in range(len(names))], names=names)

    found = F.arrow_udf(work, "struct<" + ", ".join(f"{n}: double" for n in names) + ">")
    scored = df.select(*kept, found(F.col("text")).alias("__p"))
    return scored.select(*kept, *[F.col(f"__p.{n}").alias(a) for n, a in zip(names, added, strict=True)])
