"""Scores in packs: sorted runs of distinct values that stand for thousands of rows, for rank sums, quantiles and fits over large groups.

A task sorts its rows in memory and hands on one binary array of values per group, channel and value block, so the engine sorts,
shuffles and hashes packs, not rows. A block depends on the value alone (``RESOLUTION`` equal steps inside every power of two). What
lies before a block comes from the blocks' totals; inside it, values of all tasks are merged, some ``CHUNK`` at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

RESOLUTION = 512
PACK_ROWS = 1 << 21  # rows that a task sorts at once
CHUNK = 1 << 20  # values merged at once; a block is never cut
_NULL, _LOW, _HIGH = -(2**62), -(2**61), 2**61  # blocks of null, and of values without a magnitude


def _block(v: np.ndarray) -> np.ndarray:
    """Order-preserving block of each double."""
    m, e = np.frexp(np.abs(v))
    with np.errstate(invalid="ignore"):
        step = (e.astype(np.int64) + 1100) * RESOLUTION + np.where(np.isfinite(m), (2 * m - 1) * RESOLUTION, 0).astype(np.int64)
    step = np.where(v == 0, 0, np.where(v < 0, -step, step))
    return np.where(np.isfinite(v), step, np.where(v < 0, _LOW, _HIGH + np.isnan(v)))


class _Codes:
    """Numbers for the groups that a task meets."""

    def __init__(self, group: Sequence[str], schema: pa.Schema):
        self.group, self.schema, self.known, self.names = list(group), schema, {}, []

    def of(self, table: pa.Table | pa.RecordBatch) -> np.ndarray:
        code = np.zeros(table.num_rows, np.int64)
        for g in self.group:
            column = table.column(g)
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            own = column.dictionary_encode(null_encoding="encode")
            code = code * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False)
        _, first, at = np.unique(code, return_index=True, return_inverse=True)
        numbers = []
        for i in first.tolist():
            name = tuple(table.column(g)[i].as_py() for g in self.group)
            if name not in self.known:
                self.known[name] = len(self.names)
                self.names.append(name)
            numbers.append(self.known[name])
        return np.array(numbers, np.int64)[at]

    def columns(self, codes: Sequence[int]) -> list[pa.Array]:
        return [pa.array([self.names[c][i] for c in codes], self.schema.field(g).type) for i, g in enumerate(self.group)]


def pack(df: DataFrame, group: Sequence[str], value: Column | str, channel: Column, *, weight: Column | None = None, blocks: bool = True) -> DataFrame:
    """(group, block, ch, n, s, c): the rows of ``df`` as packs, without a shuffle.

    s: ascending distinct doubles; c: what each weighs, null where all weigh one; n: their sum. A row with a null ``channel`` weighs nothing.
    Null values have a block of their own, as minus infinity. Without ``blocks`` a
    task's values of a group and channel make two packs at a time, those of one row and those of several.
    """
    group = list(group)
    rows = df.select(*group, (F.col(value) if isinstance(value, str) else value).cast("double").alias("__s"), F.coalesce(channel.cast("int"), F.lit(-1)).alias("__ch"),
                     *([] if weight is None else [weight.cast("double").alias("__w")]))
    schema = T.StructType([*[rows.schema[g] for g in group], T.StructField("block", T.LongType()), T.StructField("ch", T.IntegerType()),
                           T.StructField("n", T.DoubleType()), T.StructField("s", T.BinaryType()), T.StructField("c", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def packs(codes: _Codes, held: list[tuple]) -> pa.RecordBatch:
        code, ch, s, null, w = (np.concatenate(x) if x[0] is not None else None for x in zip(*held, strict=True))
        idle = ch < 0
        if idle.any():
            w = np.where(idle, 0.0, 1.0 if w is None else w)
            ch = np.where(idle, 0, ch)
        s = s + 0.0
        s[null] = -np.inf
        part = (code << 17) | (ch.astype(np.int64) << 1) | ~null
        names, part = np.unique(part, return_inverse=True)
        order = np.argsort(part.astype(np.int16) if len(names) < 2**15 else part, kind="stable")
        out: list[list] = [[], [], [], [], [], [], []]  # code, block, ch, n, size, values, weights
        for name, at in zip(names.tolist(), np.split(order, np.cumsum(np.bincount(part))[:-1]), strict=True):
            v = s[at]
            if w is None:
                v.sort()
            else:
                by = np.argsort(v, kind="stable")
                v, own = v[by], w[at][by]
            new = np.concatenate([[True], (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))])
            first = np.flatnonzero(new)
            c = np.diff(np.append(first, len(v))).astype(np.float64) if w is None else np.add.reduceat(own, first)
            v = v[first]
            block = np.full(len(v), _NULL) if not name & 1 else _block(v) if blocks else np.zeros(len(v), np.int64)
            if not blocks and name & 1:  # values of one row apart from others: they need no weights
                more = c != 1
                by, block = np.argsort(more, kind="stable"), np.sort(more).astype(np.int64)
                v, c = v[by], c[by]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1])
            for to, x in zip(out, (np.full(len(cuts), name >> 17), block[cuts], np.full(len(cuts), (name >> 1) & 0xFFFF), np.add.reduceat(c, cuts), np.diff(np.append(cuts, len(v))), v, c), strict=True):
                to.append(x)
        code, block, ch, n, size, v, c = (np.concatenate(x) for x in out)
        starts = np.cumsum(size) - size
        odd = np.add.reduceat(c != 1, starts) > 0

        def binary(x: np.ndarray, sizes: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
            ends = np.append(0, np.cumsum(sizes * 8)).astype(np.int32)
            bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
            return pa.Array.from_buffers(pa.binary(), len(sizes), [bits, pa.py_buffer(ends), pa.py_buffer(x.tobytes())])

        return pa.RecordBatch.from_arrays([*codes.columns(code.tolist()), pa.array(block.astype(np.int64)), pa.array(ch.astype(np.int32)), pa.array(n),
                                           binary(v, size), binary(c[np.repeat(odd, size)], np.where(odd, size, 0), odd)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, count = _Codes(group, arrow), [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index("__s"))
            null = column.is_null().to_numpy(zero_copy_only=False)
            w = None if weight is None else pc.fill_null(batch.column(batch.schema.get_field_index("__w")), 0.0).to_numpy()
            held.append((codes.of(batch), batch.column(batch.schema.get_field_index("__ch")).to_numpy().astype(np.int32), pc.fill_null(column, 0.0).to_numpy(), null, w))
            count += batch.num_rows
            if count >= PACK_ROWS:
                yield packs(codes, held)
                held, count = [], 0
        if held:
            yield packs(codes, held)

    return rows.mapInArrow(run, schema)


def values(s: pa.ChunkedArray | pa.Array, c: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, weights, size of each pack)."""
    packs = s.to_pylist()
    size = np.array([len(x) // 8 for x in packs], np.int64)
    v, w = np.frombuffer(b"".join(packs), np.float64), np.ones(size.sum())
    starts = np.cumsum(size) - size
    given = c.to_pylist()
    for i in np.flatnonzero(c.is_valid().to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.is_valid().to_numpy()).tolist():
        w[starts[i] : starts[i] + size[i]] = np.frombuffer(given[i], np.float64)
    return v, w, size


def _dealt(packs: DataFrame, group: list[str], channels: int) -> DataFrame:
    """Packs by (group, block) with what each channel weighs before the block (o0, o1, ..), in the whole group (t0, t1, ..) and in the block (__n); sorted.

    The packs go through one exchange, which both sides read (same columns on both sides, so Spark reuses it).
    """
    known = " AND ".join(f"`{c}` IS NOT NULL" for c in (*group, "block"))  # what the join asks for, said before the exchange: both sides stay equal
    keyed = packs.where(known).repartition(*group, "block")
    own = [F.sum(F.when(F.col("ch") == k, F.col("n")).otherwise(0.0)).alias(f"n{k}") for k in range(channels)]
    per_block = keyed.groupBy(*group, "block").agg(F.sum("n").alias("__n"), (F.sum(F.octet_length("s")) + F.sum(F.coalesce(F.octet_length("c"), F.lit(0)))).alias("__used"), *own)
    upto, whole = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*group)
    offsets = per_block.select(*group, "block", "__n", "__used", *[F.coalesce(F.sum(f"n{k}").over(upto), F.lit(0.0)).alias(f"o{k}") for k in range(channels)],
                               *[F.sum(f"n{k}").over(whole).alias(f"t{k}") for k in range(channels)])
    return keyed.join(offsets, [*group, "block"]).where("__used > 0").drop("__used").sortWithinPartitions(*group, "block")


def _chunks(batches: Iterator[pa.RecordBatch], group: list[str], codes: _Codes) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(packs of whole blocks, their groups' numbers, the first pack of each block)."""
    held, count = [], 0

    def cut(last: bool) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        nonlocal held, count
        table = pa.Table.from_batches(held)
        code, block = codes.of(table), table.column("block").to_numpy()
        first = np.concatenate([[0], np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1])
        end = table.num_rows if last else int(first[-1])
        if end:
            done, own = table.slice(0, end), first[first < end]
            if not np.array_equal(np.add.reduceat(done.column("n").to_numpy(), own), done.column("__n").to_numpy()[own]):
                if not np.allclose(np.add.reduceat(done.column("n").to_numpy(), own), done.column("__n").to_numpy()[own], rtol=1e-9):
                    raise ValueError("a block was dealt to several tasks")
            yield done, code[:end], own
        held = table.slice(end).to_batches()
        count = sum(b.column(b.schema.get_field_index("s")).nbytes // 8 for b in held)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.column(batch.schema.get_field_index("s")).nbytes // 8
        if count >= CHUNK:
            before = len(held)
            yield from cut(False)
            if len(held) == before and count >= CHUNK:  # one block that goes on: look again when it has doubled
                count = count // 2
    if held:
        yield from cut(True)


def _merged(table: pa.Table, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(values in ascending order by group and block, their channels, weights, blocks' numbers)."""
    v, w, size = values(table.column("s"), table.column("c"))
    number = np.zeros(table.num_rows, np.int64)
    number[first[1:]] = 1
    number = np.repeat(np.cumsum(number), size)
    ch = np.repeat(table.column("ch").to_numpy(), size)
    ends = np.cumsum(size)
    cuts = [0, *(ends[np.flatnonzero(np.diff(code))]).tolist(), len(v)]
    order = np.concatenate([a + np.argsort(v[a:b], kind="stable") for a, b in zip(cuts, cuts[1:], strict=False)])
    return v[order], ch[order], w[order], number[order]


def rank_sums(
    df: DataFrame, group: Sequence[str], scopes: Mapping[str, tuple[Sequence[int], Sequence[int]]], channel: Column, *, channels: int = 4,
    score: str = "probability", weight: Column | None = None,
) -> DataFrame:
    """(group, and for each scope <scope>_p, _n, _u, _a, _b): sums over one score order.

    A scope names the channels of its positives and of its negatives. p, n: their weights; u: positives times the negatives below them, half of
    those at the same score; a: positives times the precision at their score; b: squared distances from the outcome. Nulls rank lowest.
    """
    group, names = list(group), [f"{s}_{c}" for s in scopes for c in "pnuab"]
    dealt = _dealt(pack(df, group, score, channel, weight=weight), group, channels)
    schema = T.StructType([*[dealt.schema[g] for g in group], *[T.StructField(n, T.DoubleType()) for n in names]])
    arrow = to_arrow_schema(schema)
    wanted = [(list(p), list(n)) for p, n in scopes.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums = _Codes(group, arrow), {}
        for table, code, first in _chunks(batches, group, codes):
            v, ch, w, number = _merged(table, code, first)
            equal = (v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1]))
            starts = np.flatnonzero(np.concatenate([[True], ~equal | (number[1:] != number[:-1])]))
            s, number = v[starts], number[starts]
            x = np.stack([np.add.reduceat(np.where(ch == k, w, 0.0), starts) for k in range(channels)])
            cum = np.cumsum(x, axis=1)
            begin = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            before, whole = (np.stack([table.column(f"{c}{k}").to_numpy()[first] for k in range(channels)]) for c in "ot")
            cum += (before - cum[:, begin] + x[:, begin])[:, number]
            whole = whole[:, number]
            null = table.column("block").to_numpy()[first] == _NULL
            known = ~null[number]
            owner = code[first]
            edges = np.flatnonzero(np.concatenate([[True], owner[number][1:] != owner[number][:-1]]))
            stats = []
            with np.errstate(invalid="ignore", over="ignore"):
                far, near = np.where(known, (s - 1) ** 2, 0.0), np.where(known, s**2, 0.0)
                for pos, neg in wanted:
                    p, n, cn = x[pos].sum(0), x[neg].sum(0), cum[neg].sum(0)
                    above_p = whole[pos].sum(0) - cum[pos].sum(0) + p
                    above = above_p + whole[neg].sum(0) - cn + n
                    stats += [p, n, p * (cn - n / 2), np.divide(p * above_p, above, out=np.zeros_like(p), where=above > 0), p * far + n * near]
            for g, t in zip(owner[number[edges]].tolist(), np.add.reduceat(np.stack(stats), edges, axis=1).T, strict=True):
                sums[g] = sums[g] + t if g in sums else t
        if sums:
            yield pa.RecordBatch.from_arrays([*codes.columns(list(sums)), *[pa.array(c) for c in np.stack(list(sums.values())).T.copy()]], schema=arrow)

    return dealt.mapInArrow(run, schema).groupBy(*group).agg(*[F.sum(n).alias(n) for n in names])


def quantiles(df: DataFrame, group: Sequence[str], value: str, levels: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group over non-null doubles, plus ``n``: ``ordered.exact_quantiles`` for groups of very many rows."""
    group, names = list(group), [f"__{side}_{n}" for n in levels for side in ("lo", "hi")]
    dealt = _dealt(pack(df.where(F.col(value).isNotNull()), group, value, F.lit(0)), group, 1)
    schema = T.StructType([*[dealt.schema[g] for g in group], T.StructField("n", T.DoubleType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(group, arrow)
        for table, code, first in _chunks(batches, group, codes):
            v, _, w, number = _merged(table, code, first)
            before, whole, own = (table.column(c).to_numpy()[first] for c in ("o0", "t0", "__n"))
            found = []
            for b in range(len(first)):
                here = [[f(q * (whole[b] - 1)) - before[b] for f in (np.floor, np.ceil)] for q in levels.values()]
                places = [p for pair in here for p in pair]
                if any(0 <= p < own[b] for p in places):
                    lo, hi = np.searchsorted(number, (b, b + 1))
                    run_ = np.cumsum(w[lo:hi])
                    found.append((int(code[first[b]]), whole[b], *[float(v[lo + np.searchsorted(run_, p, side="right")]) if 0 <= p < own[b] else None for p in places]))
            if found:
                g, *rest = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*codes.columns(g), *[pa.array(c, pa.float64()) for c in rest]], schema=arrow)

    found = dealt.mapInArrow(run, schema).groupBy(*group).agg(F.max("n").alias("n"), *[F.max(c).alias(c) for c in names])
    out = []
    for name, q in levels.items():
        pos, lo, hi = (F.col("n") - 1) * F.lit(float(q)), F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return found.select(*group, F.col("n").cast("long").alias("n"), *out)


def sums(packs: DataFrame, group: Sequence[str], names: Sequence[str], of: Callable[[tuple, np.ndarray, np.ndarray, int], Sequence[float] | None]) -> DataFrame:
    """(group, ch, names): what ``of`` (group, values, weights, channel) makes of each pack, one row per pack; packs stay where they are."""
    group = list(group)
    schema = T.StructType([*[packs.schema[g] for g in group], T.StructField("ch", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (*group, "ch", "s", "c")}
            found = []
            for *name, ch, s, c in zip(*(at[n] for n in (*group, "ch", "s", "c")), strict=True):
                v = np.frombuffer(s, np.float64)
                made = of(tuple(name), v, np.ones(len(v)) if c is None else np.frombuffer(c, np.float64), ch)
                if made is not None:
                    found.append((*name, ch, *(None if m is None else float(m) for m in made)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    return packs.mapInArrow(run, schema)
