"""Counting, quantile, share, selection and set operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.contract import SELECTION_TIE_TOLERANCE
from tidemark.functions.ordered import exact_quantiles


def stage_counts(rows: DataFrame, *, by: Sequence[str] = (), entity: str = "stay") -> DataFrame:
    """Row and entity counts for total, pre and post, with the pre share of negatives.

    One pass: an entity's rows are summed by phase first, then it counts once in each phase it has and once in the total.
    """
    by = list(by)
    pos, neg = F.col("y") == 1, F.col("y") == 0
    phases = {"pre": ~F.coalesce(F.col("pod") >= 0, F.lit(False)), "post": F.col("pod") >= 0, "total": F.lit(True)}
    per = rows.groupBy(*by, entity).agg(*[
        e.alias(f"__{p}_{c}") for p, here in phases.items()
        for c, e in (("n", F.count_if(here)), ("p", F.count_if(here & pos)), ("q", F.count_if(here & neg)), ("case", F.max(F.when(here, F.col("case")))))])
    cells = [
        F.struct(F.lit(p).alias("phase"), *[F.col(f"__{p}_{c}").alias(c) for c in ("n", "p", "q", "case")],
                 (F.col("__pre_q") if p == "total" else F.lit(None).cast("long")).alias("pre_q"))
        for p in phases]
    stacked = per.select(*by, F.explode(F.array(*cells)).alias("__c")).select(*by, "__c.*").where("n > 0")
    out = stacked.groupBy(*by, "phase").agg(
        F.sum("n").alias("rows"),
        F.sum("p").alias("positive_rows"),
        F.sum("q").alias("negative_rows"),
        F.count("*").alias("entities"),
        F.count_if(F.col("case") == 1).alias("case_entities"),
        F.count_if(F.col("case") == 0).alias("control_entities"),
        F.count_if(F.col("p") > 0).alias("positive_entities"),
        F.count_if(F.col("q") > 0).alias("negative_entities"),
        F.sum("pre_q").alias("__pre_q"),
    )
    share = F.when(F.col("negative_rows") > 0, F.col("__pre_q") / F.col("negative_rows"))
    return out.withColumn("pre_negative_fraction", share).drop("__pre_q")


def first_value(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Static value per group: the first non-null one of columns that are constant in the group."""
    return df.groupBy(group).agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])


def inconsistent_groups(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Groups in which a column takes more than one value (min and max differ: no value set is kept)."""
    agg = df.groupBy(group).agg(
        *[(F.min(c) != F.max(c)).alias(c) for c in columns]
    )
    counts = agg.agg(*[F.count_if(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def frequency(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """Count per value with the denominator of the whole group."""
    counts = df.groupBy(*by, value.alias("value")).agg(F.count("*").alias("n"))
    if not by:  # one number, not a window over all values
        return counts.withColumn("denominator", df.agg(F.count("*").alias("n")).select("n").scalar())
    return counts.withColumn("denominator", F.sum("n").over(Window.partitionBy(*by)))


def count_with_denominator(df: DataFrame, hits: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(metric, n, denominator) for ``name -> (in denominator, hit)``; a hit outside it is not counted."""
    aggs = []
    for name, (den, hit) in hits.items():
        d, h = F.coalesce(den, F.lit(False)), F.coalesce(hit, F.lit(False))
        aggs += [F.count_if(d & h).alias(f"{name}__n"), F.count_if(d).alias(f"{name}__d")]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}__n").alias("n"), F.col(f"{m}__d").alias("denominator"))
                     for m in hits])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def suppressed_quartiles(df: DataFrame, group: Sequence[str], value: str, minimum: int = 20) -> DataFrame:
    """Quartiles per group, NULL below ``minimum`` observations."""
    return exact_quantiles(df, group, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, minimum=minimum)


def cross_tab(df: DataFrame, a: str, b: str, values: Sequence[object]) -> DataFrame:
    return df.groupBy(a).agg(*[F.count_if(F.col(b) == v).alias(f"{b}_{v}") for v in values],
                             F.count("*").alias("total"))


def equal_repeat_mean(df: DataFrame, group: Sequence[str], columns: Sequence[str], skip_null: bool = False) -> DataFrame:
    """Mean over repeats. One undefined repeat makes the mean undefined unless ``skip_null``."""

    def mean(c: str) -> Column:
        return F.avg(c) if skip_null else F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))

    return df.groupBy(*group).agg(*[mean(c).alias(c) for c in columns])


def normalised_share(df: DataFrame, group: Sequence[str], value: str, out: str = "share") -> DataFrame:
    """Value over the group total; NULL for a zero total. For metadata-sized groups (features, sources)."""
    total = F.sum(value).over(Window.partitionBy(*group))
    return df.withColumn(out, F.when(total > 0, F.col(value) / total))


def top_k(df: DataFrame, value: str, name: str, k: int) -> DataFrame:
    """Largest ``k`` by value, ties by name (a top-k report; runs as take-ordered, not a full sort)."""
    return df.orderBy(F.desc(value), F.col(name)).limit(k)


def first_interval(df: DataFrame, *, entity: str, start: str, carry: Sequence[str]) -> DataFrame:
    """Earliest record per entity with the number of records sharing that start; a tie is reported, not broken."""
    per = df.groupBy(entity, start).agg(
        F.count("*").alias("n_tied"), *[F.min(c).alias(c) for c in carry]
    )
    best = per.groupBy(entity).agg(F.min(F.struct(start, "n_tied", *carry)).alias("s"))
    return best.select(entity, "s.*")


def choose_arm(
    scores: DataFrame, *, score: str, tie_break: Sequence[str], tolerance: float = SELECTION_TIE_TOLERANCE
) -> DataFrame:
    """Arms within ``tolerance`` of the best, then the ordered tie-break."""
    best = scores.agg(F.max(score).alias("b")).select("b").scalar()
    near = scores.where(best - F.col(score) <= tolerance)
    return near.orderBy(*tie_break).limit(1)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def missing_keys(required: DataFrame, done: DataFrame) -> DataFrame:
    """Required keys that are not completed."""
    return required.join(done.distinct(), required.columns, "left_anti").distinct()


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row counts that differ between two tables as multisets (0 and 0 when equal)."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("__s")).unionAll(b.select(*cols, F.lit(-1).alias("__s")))
    d = both.groupBy(*cols).agg(F.sum("__s").alias("d"))
    return d.agg(
        F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("only_right"),
    )
