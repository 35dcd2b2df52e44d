"""Rank metrics and sums under many shared entity weights: sort once, reweight every draw.

Rows are laid out by (group, score) and cut into blocks of a bounded number of rows; the rows of one score that is larger
than a block are summed in salted parts first. A row carries its entity's slot (``splits.Slots``), and a block counts the slots'
multiplicities anew, a few draws at a time; or it carries one byte per draw, where weights are given as a table.
Statistics are exact for any number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.ordered import value_block
from tidemark.operators.rank_draws import Block, Form, ValueBlock, combined, unit
from tidemark.operators.splits import Slots, multiplicities, slot_multiplicities
from tidemark.session import materialize

SCOPES = ("total", "post", "pre", "cross")
BLOCK_ROWS = 4096  # with a byte per draw in each row
SLOT_ROWS = 1 << 22  # with slots, whose multiplicities a block counts anew
_TASKS = 24  # blocks are smaller where there would be fewer
_SENT_ROWS = 1 << 20  # a table of block counts up to this length is sent to every task
_CELLS = 1 << 18  # rows x draws at a time, as doubles; slots x draws are bytes


class _Draws:
    """Multiplicities of a table's rows for draws 0 (unit weights) to ``draws``, a slab of draws at a time."""

    def __init__(self, table: pa.Table, draws: int, strata: tuple | None):
        self.draws, self.strata = draws, strata
        self.counts = table.column("c").to_numpy().astype(np.float64)
        self.summed = {i: np.frombuffer(x, np.float64) for i, x in enumerate(table.column("sums").to_pylist()) if x is not None}
        if strata is None:
            packed = table.column("w").to_pylist()
            self.bytes = np.zeros((draws + 1, len(packed)), np.uint8)
            self.bytes[0] = 1
            some = [i for i, w in enumerate(packed) if w is not None]
            if some:
                self.bytes[1:, some] = np.frombuffer(b"".join(packed[i][:draws] for i in some), np.uint8).reshape(len(some), draws).T
            self.index = np.arange(len(packed))
            size = 1
        else:
            size = sum(n for _, n in strata) + 1
            self.index = pa.compute.fill_null(table.column("slot"), size - 1).to_numpy()
        self.width = max(1, min(128, _CELLS // max(1, len(self.index)), (_CELLS << 6) // size))

    def slabs(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(lo, hi, multiplicities of draws lo..hi-1 by ``index``)"""
        for lo in range(0, self.draws + 1, self.width):
            hi = min(lo + self.width, self.draws + 1)
            yield lo, hi, self.bytes[lo:hi] if self.strata is None else multiplicities(self.strata, lo, hi)

    def rows(self, at: np.ndarray) -> _Rows:
        return _Rows(self, at)


class _Rows:
    """Some rows of a table, in an order."""

    def __init__(self, held: _Draws, at: np.ndarray):
        self.index, self.counts = held.index[at], held.counts[at]
        if (self.counts == 1).all():
            self.counts = None
        self.summed = [(k, held.summed[i]) for k, i in enumerate(at.tolist()) if i in held.summed] if held.summed else []

    def cells(self, lo: int, hi: int, m: np.ndarray) -> np.ndarray:
        """(draws lo..hi-1, rows)"""
        out = m.take(self.index, axis=1).astype(np.float64)
        if self.counts is not None:
            out *= self.counts
        for k, x in self.summed:
            out[:, k] = x[lo:hi]
        return out


def _keys(key: tuple, names: Sequence[str], schema: pa.Schema, rows: int) -> list[pa.Array]:
    return [pa.array([k] * rows, schema.field(n).type) for k, n in zip(key, names, strict=True)]


def _groups(table: pa.Table, group: Sequence[str]) -> list[tuple[tuple, np.ndarray]]:
    """(group, its rows) of a block."""
    code = np.zeros(table.num_rows, np.int64)
    for g in group:
        own = table.column(g).combine_chunks().dictionary_encode(null_encoding="encode")
        code = np.unique(code * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.diff(code[order])) + 1
    return [(tuple(table.column(g)[int(at[0])].as_py() for g in group), at) for at in np.split(order, cuts) if len(at)]


def _held(weights: DataFrame | Slots) -> tuple[DataFrame, str, tuple | None]:
    return (weights.places, "slot", weights.strata) if isinstance(weights, Slots) else (weights, "w", None)


def _block_rows(weights: DataFrame | Slots, rows: int, given: int | None, plain: int) -> int:
    if given or not isinstance(weights, Slots):
        return given or plain
    return max(BLOCK_ROWS, min(rows // _TASKS + 1, SLOT_ROWS))


def _laid_out(sizes: DataFrame, group: list[str]) -> DataFrame:
    """Adds what lies ``before`` each group, from (group, total); one row per group."""
    return sizes.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _blocks(rows: DataFrame, weights: DataFrame | Slots, group: list[str], *, draws: int, entity: str, block_rows: int | None, units: Sequence[str] = ("c",)) -> tuple[DataFrame, int]:
    """(rows (entity, group, s, y, post, c) with what weighs them, dealt to blocks; their partitions). A block is a run of groups and scores and holds about ``block_rows`` rows."""
    table, held, strata = _held(weights)
    rows = rows.withColumn("fine", value_block("s"))
    counts = materialize(rows.groupBy(*group, "fine").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    block_rows = _block_rows(weights, total, block_rows, BLOCK_ROWS)
    partitions = min(3 * (total // block_rows + 1), 4096)
    upto = Window.partitionBy(*group).orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)  # one row per fine block
    before = _laid_out(counts.groupBy(*group).agg(F.sum("n").alias("total")), group).select(*group, "before")
    counts = counts.withColumn("upto", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(before, group)
    counts = counts.select(*group, "fine", F.ceil(F.col("n") / block_rows).cast("int").alias("parts"), F.floor((F.col("before") + F.col("upto")) / block_rows).alias("block"))
    counts = materialize(counts)
    # a row is shuffled once, to its block: the places move to rows that are dealt by entity, and the counts (a few thousand per group) to every task
    placed = rows.join(F.broadcast(counts) if counts.count() <= _SENT_ROWS else counts, [*group, "fine"]).drop("fine")
    if table is not None:
        places = table.select(entity, held)
        placed = placed.join(places.hint("shuffle_hash") if strata is not None else places, entity, "left")
    placed = placed.select(*group, "block", "s", "y", "post", *units, held, F.lit(None).cast("binary").alias("sums"), "parts", F.col(entity).alias("__entity"))
    # a block is a run of small fine blocks; a fine block over the limit is summed per score first, in salted parts
    small = placed.where("parts = 1").drop("parts", "__entity")
    merge = [*group, "block", "s", "y", "post"]
    schema = small.schema
    arrow = to_arrow_schema(schema)

    def total_(key: tuple, table: pa.Table) -> pa.Table:
        own, times = _Draws(table, draws, strata), [table.column(u).to_numpy().astype(np.float64) for u in units]
        sums = np.zeros((len(units), draws + 1))
        for lo, hi, m in own.slabs():
            cells = m.take(own.index, axis=1).astype(np.float64)
            for x, w in zip(sums, times, strict=True):
                x[lo:hi] = cells @ w
        head = _keys([k.as_py() for k in key[: len(merge)]], merge, arrow, 1)
        return pa.Table.from_arrays([*head, *[pa.array([1], arrow.field(u).type) for u in units], pa.array([None], arrow.field(held).type), pa.array([sums.tobytes()], pa.binary())], schema=arrow)

    salt = F.pmod(F.xxhash64("__entity"), F.col("parts")).alias("salt")
    large = placed.where("parts > 1").select(*merge, *units, held, "sums", salt).groupBy(*merge, "salt").applyInArrow(total_, schema)
    return small.unionByName(large).repartition(partitions, "block"), partitions


def _offsets(per_block: DataFrame, group: list[str]) -> DataFrame:
    """(group, block, slab, before, whole) from block totals (group, block, slab, t): what lies before a block, and the whole group."""
    schema = T.StructType([*per_block.schema.fields[:-1], T.StructField("before", T.BinaryType()), T.StructField("last", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Running totals over the blocks of a (group, slab); its last row holds the whole."""
        mark, run, head = None, None, None
        for batch in batches:
            found = []
            for *here, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value, now = np.frombuffer(t, np.float64), (*here[: len(group)], here[-1])
                if now != mark:
                    if mark is not None:
                        found.append([*head, run.tobytes(), True])
                    mark, run = now, np.zeros(len(value))
                found.append([*here, run.tobytes(), False])
                run, head = run + value, here
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)
        if mark is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip([*head, run.tobytes(), True], arrow, strict=True)], schema=arrow)

    ordered = per_block.repartition(*group, "slab").sortWithinPartitions(*group, "slab", "block")
    sums = ordered.mapInArrow(prefix, schema)
    whole = sums.where("last").select(*group, "slab", F.col("before").alias("whole"))
    return sums.where("not last").drop("last").join(whole, [*group, "slab"]).select(*group, "block", "slab", "before", "whole")


def resampled_metrics(
    df: DataFrame, weights: DataFrame | Slots, group: Sequence[str], *, draws: int, entity: str = "stay", score: str = "probability",
    y: str = "y", scopes: Sequence[str] = SCOPES, block_rows: int | None = None, unit: str | None = None, stats: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """(draw, group, scope, n_pos, n_neg, auc, ap, brier) for draws 1..``draws`` and draw 0 with unit weights.

    ``weights``: ``splits.bootstrap_slots``, or (entity, w) with one byte per draw (``splits.bootstrap_weights``); entities without a row count in draw 0 only.
    ``unit``: a column with what a row weighs in each draw, times its entity's multiplicity (1 without it); it may be a fraction.
    ``stats``: the statistics wanted of each scope, instead of all of ``scopes``; others are NULL. With AUC alone every block is read once.
    """
    form = Form("", stats or {s: ("auc", "ap", "brier") for s in scopes})
    return resampled_forms(df, weights, group, [(form, unit)], draws=draws, entity=entity, score=score, y=y, block_rows=block_rows).drop("form")


def resampled_forms(
    df: DataFrame, weights: DataFrame | Slots, group: Sequence[str], forms: Sequence[tuple[Form, str | None]], *, draws: int, entity: str = "stay",
    score: str = "probability", y: str = "y", block_rows: int | None = None,
) -> DataFrame:
    """``resampled_metrics`` for several weights of the same rows, each a form with its unit column, from one reading: a column ``form`` names them."""
    group, strata = list(group), _held(weights)[2]
    wanted = [f for f, _ in forms]
    phased = "pod" in df.columns and {s for f in wanted for s in f.scopes} != {"total"}
    post = (F.col("pod") >= 0).cast("int") if phased else F.lit(0)
    units = [(F.sum(u) if u else F.count("*")).cast("double").alias(unit(i)) for i, (_, u) in enumerate(forms)]
    head = [F.col(score).alias("s"), F.col(y).cast("int").alias("y"), post.alias("post")]
    if _held(weights)[0] is None:  # slots of their own: a row is shuffled to its block alone
        rows = df.select(entity, *group, *head, *[(F.col(u).cast("double") if u else F.lit(1.0)).alias(unit(i)) for i, (_, u) in enumerate(forms)])
    else:
        rows = df.groupBy(entity, *group, *head).agg(*units)
    merged, partitions = _blocks(rows, weights, group, draws=draws, entity=entity, block_rows=block_rows, units=[unit(i) for i in range(len(forms))])
    key = [merged.schema[k] for k in (*group, "block")]
    stats_schema = T.StructType([*key, T.StructField("__t", T.BinaryType())])
    shape = (len(wanted), -1, draws + 1)

    def stats(block: pa.Scalar, found: list[tuple[tuple, np.ndarray]], values: np.ndarray) -> pa.Table:
        arrow = to_arrow_schema(stats_schema)
        names = [pa.array([n[i] for n, _ in found], arrow.field(g).type) for i, g in enumerate(group)]
        return pa.Table.from_arrays([*names, pa.array([block.as_py()] * len(found), arrow.field("block").type), pa.array([x.tobytes() for x in values], pa.binary())], schema=arrow)

    def totals(key: tuple, table: pa.Table) -> pa.Table:
        found = _groups(table, group)
        return stats(key[0], found, Block(table, found, wanted, draws, strata).totals())

    def ranks(key: tuple, table: pa.Table) -> pa.Table:
        found = _groups(table, group)
        return stats(key[0], found, Block(table, found, wanted, draws, strata).ranks(None, None))

    def placed_ranks(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return to_arrow_schema(stats_schema).empty_table()
        found = _groups(left, group)
        at = {tuple(right.column(g)[i].as_py() for g in group): i for i in range(right.num_rows)}
        lies = [np.stack([np.frombuffer(right.column(c)[at[name]].as_py(), np.float64).reshape(shape) for name, _ in found]) for c in ("before", "whole")]
        return stats(key[0], found, Block(left, found, wanted, draws, strata).ranks(*lies))

    once = not any(f.ap or f.brier for f in wanted)
    if once:
        blocks = merged.groupBy("block").applyInArrow(ranks, stats_schema).withColumn("whole", F.lit(None).cast("binary"))
    else:
        per_block = merged.groupBy("block").applyInArrow(totals, stats_schema)
        offsets = materialize(_offsets(per_block.select(*group, "block", F.lit(0).alias("slab"), "__t"), group)).drop("slab")
        placed = merged.groupBy("block").cogroup(offsets.repartition(partitions, "block").groupBy("block")).applyInArrow(placed_ranks, stats_schema)
        # a group's totals come with its first block
        first = offsets.groupBy(*group).agg(F.min("block").alias("block"), F.any_value("whole").alias("whole"))
        blocks = placed.join(first, [*group, "block"], "left")
    out_schema = T.StructType([T.StructField("draw", T.IntegerType()), *key[:-1], T.StructField("form", T.StringType()), T.StructField("scope", T.StringType()),
                               *[T.StructField(c, T.DoubleType()) for c in ("n_pos", "n_neg", "auc", "ap", "brier")]])

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        """A group's blocks, one row each, in order of score."""
        arrow = to_arrow_schema(out_schema)
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        held = [np.frombuffer(table.column("__t")[int(i)].as_py(), np.float64).reshape(shape) for i in order]
        whole = table.column("whole")[int(order[0])].as_py()
        found = list(combined(held, None if whole is None else np.frombuffer(whole, np.float64).reshape(shape), wanted))
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        for form, scope, (p, n, u, a, b) in found:
            has = {"auc": (u, p * n), "ap": (a, p), "brier": (b, p + n)}
            out[0].append(p)
            out[1].append(n)
            for i, (name, (top, bottom)) in enumerate(has.items()):
                ok = (p > 0) & (n > 0) if name == "auc" else bottom > 0
                ok = ok & (name in form.stats[scope])
                out[2 + i].append(np.where(ok, np.divide(top, bottom, out=np.zeros(draws + 1), where=ok), np.nan))
        rows = len(found) * (draws + 1)
        values = [np.concatenate(c) for c in out]
        heads = [pa.array([k.as_py()] * rows, arrow.field(g).type) for k, g in zip(key, group, strict=True)]
        named = [pa.array(np.repeat(np.array(x, object), draws + 1), pa.string()) for x in ([f.name for f, *_ in found], [s for _, s, _ in found])]
        return pa.Table.from_arrays([pa.array(np.tile(np.arange(draws + 1, dtype=np.int32), len(found))), *heads, *named, *[pa.array(c, pa.float64(), from_pandas=True) for c in values]], schema=arrow)

    return blocks.groupBy(*group).applyInArrow(finish, out_schema)


def resampled_quantiles(
    df: DataFrame, weights: DataFrame | Slots, group: Sequence[str], value: str, *, draws: int, level: float = 0.5, entity: str = "stay",
    part: str | None = None, factors: DataFrame | None = None, block_rows: int | None = None,
) -> DataFrame:
    """(draw, group, quantile): inverse weighted empirical CDF of ``value`` for draws 0 (unit weights) to ``draws``.

    The smallest value whose running weight reaches ``level`` of the total (with a relative slack of 1e-9). A row weighs its
    entity's multiplicity, times ``factors`` (group, part, f: one double for each draw from 0 on, as bytes) where there is one for
    its group and ``part``. Sorted once for all draws: a block of values gives its totals, and a draw's quantile is looked up in the
    block where its running weight reaches the level. Groups and draws without weight have no row; null values are left out.
    """
    group, strata = list(group), _held(weights)[2]
    post = F.col(part).cast("int") if part else F.lit(0)
    named = df.where(F.col(value).isNotNull()).groupBy(entity, *group, F.col(value).cast("double").alias("s"), F.lit(0).alias("y"), post.alias("post")).agg(F.count("*").cast("int").alias("c"))
    merged, partitions = _blocks(named, weights, group, draws=draws, entity=entity, block_rows=block_rows)
    keys, schema = [*group, "block"], merged.schema
    blocks = materialize(merged.select(*keys).distinct()).select(*[F.col(k).alias(k) for k in keys])
    if factors is None:
        held = blocks.where("false").select(*keys, F.lit(0).alias("post"), F.lit(None).cast("binary").alias("f"))
    else:
        held = blocks.join(factors.select(*group, F.col(part).cast("int").alias("post"), "f"), group).select(*keys, "post", "f")
    held = held.repartition(partitions, "block")

    def opened(left: pa.Table, right: pa.Table) -> tuple[list[tuple[tuple, np.ndarray]], ValueBlock]:
        times: dict[tuple, list] = {}
        for *name, p, f in zip(*(right.column(c).to_pylist() for c in (*group, "post", "f")), strict=True):
            times.setdefault(tuple(name), []).append((p, np.frombuffer(f, np.float64)))
        found = _groups(left, group)
        return found, ValueBlock(left, found, times, draws, strata)

    totals_schema = T.StructType([*[schema[k] for k in keys], T.StructField("slab", T.IntegerType()), T.StructField("__t", T.BinaryType())])

    def totals(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        arrow = to_arrow_schema(totals_schema)
        if not left.num_rows:
            return arrow.empty_table()
        found, block = opened(left, right)
        names = [pa.array([n[i] for n, _ in found], arrow.field(g).type) for i, g in enumerate(group)]
        return pa.Table.from_arrays([*names, pa.array([key[0].as_py()] * len(found), arrow.field("block").type), pa.array([0] * len(found), pa.int32()), pa.array([x.tobytes() for x in block.totals()], pa.binary())], schema=arrow)

    per_block = materialize(merged.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(totals, totals_schema))
    at = _offsets(per_block, group).select(*[F.col(k).alias(k) for k in keys], "before", "whole").join(per_block.select(*[F.col(k).alias(k) for k in keys], "__t"), keys)
    ends = ("before", "whole", "__t")
    none = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    both = held.select(*keys, "post", "f", *none(*ends)).unionByName(at.select(*keys, F.lit(None).cast("int").alias("post"), *none("f"), *ends)).repartition(partitions, "block")
    out_schema = T.StructType([*[schema[k] for k in group], T.StructField("draw", T.IntegerType()), T.StructField("quantile", T.DoubleType())])

    def local(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        arrow = to_arrow_schema(out_schema)
        if not left.num_rows:
            return arrow.empty_table()
        offset = right.filter(pa.compute.is_valid(right.column("before")))
        bounds = {tuple(offset.column(g)[i].as_py() for g in group): [np.frombuffer(offset.column(c)[i].as_py(), np.float64) for c in ends] for i in range(offset.num_rows)}
        names, block = opened(left, right.filter(pa.compute.is_valid(right.column("f"))))
        before, whole, total = (np.stack([bounds[name][i] for name, _ in names]) for i in range(3))
        out = block.find(before, total, np.where(whole > 0, (level - 1e-9) * whole, np.nan))
        if not out:
            return arrow.empty_table()
        heads = [pa.array([names[k][0][i] for k, d, _ in out for _ in range(len(d))], arrow.field(g).type) for i, g in enumerate(group)]
        return pa.Table.from_arrays([*heads, pa.array(np.concatenate([d for _, d, _ in out]).astype(np.int32)), pa.array(np.concatenate([q for *_, q in out]))], schema=arrow)

    found = merged.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(local, out_schema)
    return found.groupBy("draw", *group).agg(F.min("quantile").alias("quantile"))


SUM_ROWS = 20_000  # with a byte per draw in each cell
SUM_SLOTS, SUM_CELLS = 1 << 14, 1 << 20  # entities, and about as many cells, weighed together


def _slot_sums(cells: DataFrame, weights: Slots, group: list[str], values: list[str], schema: T.StructType, *, draws: int, entity: str) -> DataFrame:
    """Sums per task from cells (entity, group, values): cells stay with their entities, and a task counts the multiplicities of its own entities' slots."""
    strata = weights.strata
    arrow = to_arrow_schema(schema)
    # the places move to the cells: cells that are already dealt by entity are not shuffled
    placed = cells.join(weights.places.select(entity, "slot").hint("shuffle_hash"), entity, "left").drop(entity).sortWithinPartitions("slot")
    dense = 16  # a table of entities x groups is multiplied as a whole if one in so many places is filled

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def weigh(table: pa.Table) -> None:
            slot = pa.compute.fill_null(table.column("slot"), -1).to_numpy()
            used, at = np.unique(slot, return_inverse=True)
            lone = int(used[0] == -1)  # without a slot: draw 0 only
            m = slot_multiplicities(strata, used[lone:], draws)
            if lone:
                m = np.hstack([np.eye(draws + 1, 1, dtype=np.uint8), m])
            found = _groups(table, group)
            x = [table.column(v).to_numpy() for v in values]
            width = len(values) + 1
            if len(at) * dense >= len(used) * len(found):
                flat = np.zeros((len(used), len(found), width))
                for k, (_, rows) in enumerate(found):
                    for i, v in enumerate(x):
                        flat[:, k, i] = np.bincount(at[rows], v[rows], len(used))
                    flat[:, k, -1] = np.bincount(at[rows], minlength=len(used))
                out = np.empty((draws + 1, len(found) * width))
                for lo in range(0, draws + 1, 64):
                    np.matmul(m[lo : lo + 64].astype(np.float64), flat.reshape(len(used), -1), out=out[lo : lo + 64])
                out = out.reshape(draws + 1, len(found), width)
            else:
                order = np.concatenate([rows for _, rows in found])
                starts = np.cumsum([0, *[len(rows) for _, rows in found]])[:-1]
                out = np.empty((draws + 1, len(found), width))
                step = max(1, _CELLS // len(order))
                for lo in range(0, draws + 1, step):
                    w = m[lo : lo + step].take(at[order], axis=1).astype(np.float64)
                    for i, v in enumerate(x):
                        out[lo : lo + step, :, i] = np.add.reduceat(w * v[order], starts, axis=1)
                    out[lo : lo + step, :, -1] = np.add.reduceat(w, starts, axis=1)
            for k, (name, _) in enumerate(found):
                if name in sums:
                    sums[name] += out[:, k]
                else:
                    sums[name] = out[:, k].copy()

        held: list[pa.RecordBatch] = []
        rows, first = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < SUM_CELLS:
                continue
            table = pa.Table.from_batches(held)
            slot = pa.compute.fill_null(table.column("slot"), -1).to_numpy()
            cut = int(np.searchsorted(slot, slot[-1]))  # an entity's cells stay together where they fit
            cut = cut or len(slot)
            for lo, hi in _runs(slot[:cut], SUM_SLOTS):
                weigh(table.slice(lo, hi - lo))
            held = table.slice(cut).combine_chunks().to_batches()
            rows = len(slot) - cut
        if rows:
            table = pa.Table.from_batches(held)
            slot = pa.compute.fill_null(table.column("slot"), -1).to_numpy()
            for lo, hi in _runs(slot, SUM_SLOTS):
                weigh(table.slice(lo, hi - lo))
        draw = pa.array(np.arange(draws + 1, dtype=np.int32))
        for name, x in sums.items():
            yield pa.RecordBatch.from_arrays([*_keys(name, group, arrow, draws + 1), draw, *[pa.array(c) for c in np.ascontiguousarray(x.T)]], schema=arrow)

    return placed.mapInArrow(reduce, schema)


def _runs(slot: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Bounds of runs of a sorted array that hold about ``size`` distinct values each."""
    news = np.flatnonzero(np.diff(slot)) + 1
    cuts = [0, *news[size - 1 :: size].tolist(), len(slot)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def resampled_sums(
    df: DataFrame, weights: DataFrame | Slots, group: Sequence[str], values: Sequence[str], *, draws: int, entity: str = "stay"
) -> DataFrame:
    """(draw, group, sums, weight): multiplicity-weighted sums of linear statistics; draw 0 has unit weights.

    ``df`` holds per-entity cells. With slots they stay with their entity, and each task adds up its entities. With a byte per draw they are
    laid out by group and entity hash and cut into blocks of a bounded number by the groups' own counts. Either gives one row per task or
    block, group and draw, so the copies per draw never reach a shuffle. NULL values count as 0.
    """
    group, values = list(group), list(values)
    table, held, strata = _held(weights)
    cells = df.select(entity, *group, *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])
    if isinstance(weights, Slots):
        schema = T.StructType([*[cells.schema[g] for g in group], T.StructField("draw", T.IntegerType()),
                               *[T.StructField(v, T.DoubleType()) for v in values], T.StructField("weight", T.DoubleType())])
        parts = _slot_sums(cells, weights, group, values, schema, draws=draws, entity=entity)
        return parts.groupBy("draw", *group).agg(*[F.sum(v).alias(v) for v in [*values, "weight"]])
    sizes = materialize(_laid_out(cells.groupBy(*group).agg(F.count("*").alias("total")), group))
    total = sizes.agg(F.sum("total")).first()[0] or 0
    block_rows = _block_rows(weights, total, None, SUM_ROWS)
    partitions = min(3 * (total // block_rows + 1), 4096)
    within = F.col("total") * F.pmod(F.xxhash64(entity), F.lit(1 << 20)) / (1 << 20)
    placed = cells.join(sizes, group).withColumn("block", F.floor((F.col("before") + within) / block_rows))
    placed = placed.join(table.select(entity, held), entity, "left").select(*group, "block", *values, held, F.lit(1.0).alias("c"), F.lit(None).cast("binary").alias("sums"))
    schema = T.StructType([*[placed.schema[g] for g in group], T.StructField("draw", T.IntegerType()),
                           *[T.StructField(v, T.DoubleType()) for v in values], T.StructField("weight", T.DoubleType())])

    def reduce(key: tuple, table: pa.Table) -> pa.Table:
        arrow, own = to_arrow_schema(schema), _Draws(table, draws, strata)
        found = _groups(table, group)
        order = np.concatenate([at for _, at in found])
        starts = np.cumsum([0, *[len(at) for _, at in found]])[:-1]
        rows, x = own.rows(order), [table.column(v).to_numpy()[order] for v in values]
        sums = np.zeros((len(values) + 1, len(found), draws + 1))
        for lo, hi, m in own.slabs():
            w = rows.cells(lo, hi, m)
            for i, v in enumerate(x):
                sums[i, :, lo:hi] = np.add.reduceat(w * v, starts, axis=1).T
            sums[-1, :, lo:hi] = np.add.reduceat(w, starts, axis=1).T
        heads = [pa.array([n[i] for n, _ in found for _ in range(draws + 1)], arrow.field(g).type) for i, g in enumerate(group)]
        return pa.Table.from_arrays([*heads, pa.array(np.tile(np.arange(draws + 1, dtype=np.int32), len(found))), *[pa.array(c.reshape(-1)) for c in sums]], schema=arrow)

    parts = placed.repartition(partitions, "block").groupBy("block").applyInArrow(reduce, schema)
    return parts.groupBy("draw", *group).agg(*[F.sum(v).alias(v) for v in [*values, "weight"]])
