"""Distributed ordered operations: running totals, ranks and exact quantiles.

A window ordered over a whole group runs in one task. These helpers cut each group into
order-preserving blocks, work inside the blocks in parallel and carry one small total per
block. The block of a row depends only on its own value, so a recomputed or retried task
always lands on the same answer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import as_col

_BLOCK = "__block"
_RESOLUTION = 4096


def value_block(c: Column | str, resolution: int = _RESOLUTION) -> Column:
    """Order-preserving block of a double: ``resolution`` equal steps inside every power of two.

    Follows the values' own magnitude, so scores crowded near zero still spread out.
    """
    x = as_col(c).cast("double")
    a = F.abs(x)
    e = F.floor(F.log2(a))
    step = (e + 1100) * resolution + F.floor((a / F.pow(F.lit(2.0), e.cast("double")) - 1) * resolution)
    return F.when(x == 0, F.lit(0).cast("long")).otherwise((F.signum(x) * step).cast("long"))


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    *,
    block: Column,
    sums: Mapping[str, Column | str] | None = None,
    maxes: Mapping[str, Column | str] | None = None,
    before: bool = False,
    totals: bool = False,
    merge: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Add running sums and maxima per group.

    ``order`` must be unique inside a group and ``block`` non-decreasing in it. With
    ``before`` the current row is left out. With ``totals`` each running sum ``x`` also gets
    the group total ``x_total``. ``group`` columns must be non-null. With ``merge`` (not with ``before``) ``order`` may hold
    equal values: one row of each is kept, with all of them in its sums and maxima. ``tasks``: number of partitions of the
    exchange; the session's, where none is given.
    """
    sums = {k: as_col(v) for k, v in (sums or {}).items()}
    maxes = {k: as_col(v) for k, v in (maxes or {}).items()}
    group = list(group)
    end = -1 if before else Window.currentRow
    lane = [_BLOCK, *group]  # the block first: sorts compare it before the few groups, and the join below needs no other order
    # both branches below read this one exchange (same columns on both sides, so Spark reuses it)
    keyed = df.withColumn(_BLOCK, F.coalesce(block.cast("long"), F.lit(-(2**62)))).repartition(*([tasks] if tasks else []), *lane)
    used = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])

    inner = Window.partitionBy(*lane).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = keyed.select(
        "*",
        *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"__l_{k}") for k, c in sums.items()],
        *[F.max(c).over(inner).alias(f"__l_{k}") for k, c in maxes.items()],
    )

    if merge:
        if before:
            raise ValueError("merge and before exclude each other")
        ahead = Window.partitionBy(*lane).orderBy(*order)
        same = F.lead(F.lit(True)).over(ahead).isNotNull()
        for c in map(as_col, order):
            same = same & F.lead(c).over(ahead).eqNullSafe(c)
        local = local.withColumn("__same", same).where("not __same")

    per_block = keyed.groupBy(*lane).agg(
        *[F.sum(c).alias(k) for k, c in sums.items()], *[F.max(c).alias(k) for k, c in maxes.items()],
        F.max(used).alias("__used"),
    )
    outer = Window.partitionBy(*group).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = per_block.select(
        *group,
        _BLOCK,
        "__used",
        *[F.coalesce(F.sum(k).over(outer), F.lit(0)).alias(f"__o_{k}") for k in sums],
        *[F.max(k).over(outer).alias(f"__o_{k}") for k in maxes],
        *([F.coalesce(F.sum(k).over(whole), F.lit(0)).alias(f"{k}_total") for k in sums] if totals else []),
    )
    keep = [c for c in df.columns if c not in sums and c not in maxes]
    return local.join(offsets, lane).where(F.col("__used").isNotNull()).select(
        *keep,
        *[(F.col(f"__l_{k}") + F.col(f"__o_{k}")).alias(k) for k in sums],
        *[F.greatest(f"__l_{k}", f"__o_{k}").alias(k) for k in maxes],
        *([f"{k}_total" for k in sums] if totals else []),
    )


def hash_rank(df: DataFrame, group: Sequence[str], hashed: str, tie: str, name: str = "rank", tasks: int | None = None) -> DataFrame:
    """1-based position inside each group, ordered by a 32-bit hash column and a unique tie column.

    Blocks are the leading 12 hash bits, hence evenly filled. Adds ``<name>`` and ``<name>_total``.
    """
    block = F.shiftright(F.col(hashed), 20)
    return running(
        df, group, [hashed, tie], block=block, sums={name: F.lit(1).cast("long")}, totals=True, tasks=tasks
    )


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, levels: Mapping[str, float], minimum: int = 1
) -> DataFrame:
    """Linear-interpolated quantiles per group over non-null values, plus ``n``.

    Equal values are merged before the shuffle; positions come from blocked running counts.
    Groups with fewer than ``minimum`` values keep NULL quantiles.
    """
    group = list(group)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__c"))
    cum = running(counts, group, [value], block=value_block(value), sums={"__cum": "__c"}, totals=True)
    aggs = []
    for name, q in levels.items():
        pos = (F.col("__cum_total") - 1) * F.lit(float(q))
        aggs += [
            F.min(F.when(F.col("__cum") > F.floor(pos), F.col(value))).alias(f"__lo_{name}"),
            F.min(F.when(F.col("__cum") > F.ceil(pos), F.col(value))).alias(f"__hi_{name}"),
        ]
    found = cum.groupBy(*group).agg(F.max("__cum_total").alias("n"), *aggs)
    out = []
    for name, q in levels.items():
        pos = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        x = lo + (hi - lo) * (pos - F.floor(pos))
        out.append(F.when(F.col("n") >= minimum, x).alias(name))
    return found.select(*group, "n", *out)


def weighted_quantiles(
    df: DataFrame, group: Sequence[str], value: str, weight: str, levels: Mapping[str, float]
) -> DataFrame:
    """Inverse weighted empirical CDF: smallest value whose cumulative weight reaches q times the total.

    A relative slack of 1e-9 absorbs the rounding of fractional running weights.
    """
    group = list(group)
    merged = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.sum(weight).alias("__w"))
    cum = running(merged, group, [value], block=value_block(value), sums={"__cum": "__w"}, totals=True)
    reach = {n: F.col("__cum") >= F.lit(float(q) - 1e-9) * F.col("__cum_total") for n, q in levels.items()}
    return cum.where(F.col("__cum_total") > 0).groupBy(*group).agg(
        *[F.min(F.when(c, F.col(value))).alias(n) for n, c in reach.items()],
        F.max("__cum_total").alias("total_weight"),
    )
