"""Interval algebra on (entity, start, end) records.

No record is expanded to its days and no pair of records is enumerated: every quantity is
rebuilt from per-day or per-time change counts, so the work is linear in records plus days.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import running
from tidemark.operators.panel import DAY, ENTITY, calendar_only, stack_days, to_day, up_to_day


def valid_records(df: DataFrame, start: str, end: str) -> DataFrame:
    """Records with a start and no reversed end (a missing end stays open)."""
    return df.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start))))


def day_changes(
    records: DataFrame, start: str, end: str, groups: Mapping[str, Column], *, entity: str = ENTITY, day: str = DAY
) -> DataFrame:
    """(entity, day) counts of starts ``<g>__s`` and of ends ``<g>__e`` by day, per named group."""
    valid = valid_records(records, start, end)
    moves = F.array_compact(
        F.array(
            F.struct(to_day(start).alias("d"), F.lit(1).alias("s"), F.lit(0).alias("e")),
            F.when(F.col(end).isNotNull(), F.struct(to_day(end).alias("d"), F.lit(0).alias("s"), F.lit(1).alias("e"))),
        )
    )
    flat = valid.select("*", F.explode(moves).alias("__m"))
    aggs = []
    for g, cond in groups.items():
        aggs += [
            F.sum(F.when(cond, F.col("__m.s")).otherwise(0)).alias(f"{g}__s"),
            F.sum(F.when(cond, F.col("__m.e")).otherwise(0)).alias(f"{g}__e"),
        ]
    return flat.groupBy(F.col(entity).alias(entity), F.col("__m.d").alias(day)).agg(*aggs)


def running_counts(cal: DataFrame, changes: DataFrame, groups: Sequence[str], entity: str, day: str) -> DataFrame:
    """Running starts (through d), ends through d and through d-1 per group, on the calendar rows."""
    w = up_to_day(entity, day)
    prev = Window.partitionBy(entity).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(entity).orderBy(day).rangeBetween(0, 0)
    cols = []
    for g in groups:
        cols += [
            F.coalesce(F.sum(f"{g}__s").over(w), F.lit(0)).alias(f"{g}__cs"),
            F.coalesce(F.sum(f"{g}__e").over(w), F.lit(0)).alias(f"{g}__ce"),
            F.coalesce(F.sum(f"{g}__e").over(prev), F.lit(0)).alias(f"{g}__cp"),
            F.coalesce(F.sum(f"{g}__s").over(same), F.lit(0)).alias(f"{g}__ct"),
        ]
    return calendar_only(stack_days(cal, changes).select("*", *cols))


def active_flags(
    cal: DataFrame, records: DataFrame, groups: Mapping[str, Column], *, start: str, end: str, entity: str = ENTITY,
    day: str = DAY,
) -> DataFrame:
    """0/1 per group: some record has floor(start) <= day <= floor(end); an open end stays active."""
    out = running_counts(cal, day_changes(records, start, end, groups, entity=entity, day=day), list(groups), entity, day)
    return out.select(*cal.columns, *[(F.col(f"{g}__cs") - F.col(f"{g}__cp") > 0).cast("int").alias(g) for g in groups])


def record_counts(
    cal: DataFrame, records: DataFrame, *, start: str, end: str, entity: str = ENTITY, day: str = DAY
) -> DataFrame:
    """Records starting today, and per-entity totals of records, missing starts and missing ends."""
    daily = records.groupBy(F.col(entity), to_day(start).alias(day)).agg(F.count("*").alias("starting_today"))
    totals = records.groupBy(entity).agg(
        F.count("*").alias("source_records"),
        F.count_if(F.col(start).isNull()).alias("missing_start"),
        F.count_if(F.col(end).isNull()).alias("missing_end"),
    )
    out = cal.join(daily, [entity, day], "left").join(totals, entity, "left")
    names = ("starting_today", "source_records", "missing_start", "missing_end")
    return out.select(*cal.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def line_burden(
    cal: DataFrame, records: DataFrame, *, start: str, end: str, entity: str = ENTITY, day: str = DAY
) -> DataFrame:
    """In place at day end, placed today, ever placed, inclusive record-days since the first calendar day."""
    g = {"all": F.lit(True)}
    out = running_counts(cal, day_changes(records, start, end, g, entity=entity, day=day), ["all"], entity, day)
    inclusive = F.col("all__cs") - F.col("all__cp")
    return out.select(
        *cal.columns,
        (F.col("all__cs") - F.col("all__ce")).alias("in_place_eod"),
        F.col("all__ct").alias("placed_today"),
        F.col("all__cs").alias("ever_placed"),
        F.sum(inclusive).over(up_to_day(entity, day)).alias("line_days"),
    )


def union_day_totals(
    cal: DataFrame, records: DataFrame, *, start: str, end: str, eod: bool = False, entity: str = ENTITY,
    day: str = DAY, rel: str = "rel",
) -> DataFrame:
    """Active flag of the union and its running post / off / pre day counts.

    Any-time-in-day counts a day the union touches. End-of-day looks at the next midnight: the
    record must have started before it and not ended before it.
    """
    g = {"u": F.lit(True)}
    if eod:
        # open at midnight d+1 <=> start < d+1 and end >= d+1: an end counts from the day it falls in
        out = running_counts(cal, day_changes(records, start, end, g, entity=entity, day=day), ["u"], entity, day)
        active = (F.col("u__cs") - F.col("u__ce") > 0).cast("int")
    else:
        out = running_counts(cal, day_changes(records, start, end, g, entity=entity, day=day), ["u"], entity, day)
        active = (F.col("u__cs") - F.col("u__cp") > 0).cast("int")
    w = up_to_day(entity, day)
    out = out.withColumn("active", active)
    post = F.col(rel) >= 0
    return out.select(
        *cal.columns,
        "active",
        F.sum(F.when(post, F.col("active")).otherwise(0)).over(w).alias("post_days"),
        F.sum(F.when(post, 1 - F.col("active")).otherwise(0)).over(w).alias("off_days"),
        F.sum(F.when(~post, F.col("active")).otherwise(0)).over(w).alias("pre_days"),
    )


STATE_COLUMNS = ("in_use_eod", "restarts", "run_days", "days_since_end")


def union_state(
    cal: DataFrame, records: DataFrame, kinds: Sequence[str], *, start: str, end: str, date_only: str,
    kind: str = "kind", entity: str = ENTITY, day: str = DAY, pairs: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """State of the union of intervals as known at the end of each day, per kind.

    Known at day d: records starting before d+1; a timed end before d+1; a date-only end on or
    before d (it closes at the end of its day). Unknown, missing and reversed ends are open.
    Columns per kind: in_use_eod, restarts (gaps of at least one full calendar day between merged
    runs), run_days, days_since_end (of the latest finished run); per pair the product of in_use.

    Two runs are separated only by ends that lie before the later start, and those are always
    known once that start is known. So the runs are merged once over the final records and every
    day reads its state from running totals, instead of merging again for each day.
    """
    s, e = F.col(start), F.col(end)
    boundary = e + F.when(F.col(date_only), F.lit(1.0)).otherwise(F.lit(0.0))
    usable = e.isNotNull() & (boundary >= s)
    far = F.lit(float("inf"))
    merged = (
        records.where(s.isNotNull())
        .groupBy(entity, kind, s.alias("__s"))
        .agg(
            F.max(F.when(usable, boundary).otherwise(far)).alias("__b"),
            # day on which the end becomes known; an open end never does
            F.max(F.when(usable, F.floor(e)).otherwise(F.lit(2**31 - 2))).cast("int").alias("__known"),
        )
    )
    runs = running(
        merged.withColumn("__prev", F.col("__b")), [entity, kind], ["__s"], block=to_day("__s"),
        maxes={"__prev": "__prev"}, before=True,
    )
    opens = F.col("__prev").isNull() | (F.col("__s") > F.col("__prev"))
    gap = opens & F.col("__prev").isNotNull() & (F.floor("__s") - F.ceil("__prev") >= 1)
    by_day = runs.groupBy(entity, kind, to_day("__s").alias(day)).agg(
        F.max(F.when(opens, F.floor("__s"))).cast("int").alias("__run"),
        F.count_if(gap).alias("__gap"),
        F.max("__known").alias("__known"),
        # end known before a new run opens on this day: it belongs to a finished run
        F.max(F.when(opens & F.col("__prev").isNotNull(), F.col("__s"))).alias("__reopen"),
    )
    aggs = []
    for k in kinds:
        hit = F.col(kind) == k
        aggs += [
            F.max(F.when(hit, F.col("__run"))).alias(f"{k}__run"),
            F.sum(F.when(hit, F.col("__gap"))).alias(f"{k}__gap"),
            F.max(F.when(hit, F.col("__known"))).alias(f"{k}__known"),
        ]
    daily = by_day.groupBy(entity, day).agg(*aggs)
    # latest end day of the run that finished before the run in use: the largest known end among
    # records that started before the current run opened
    prior = _finished_runs(runs, opens, kind, entity, day)
    daily = daily.unionByName(
        prior.groupBy(entity, day).agg(
            *[F.max(F.when(F.col(kind) == k, F.col("__done"))).alias(f"{k}__done") for k in kinds]
        ),
        allowMissingColumns=True,
    )
    w = up_to_day(entity, day)
    cols = []
    for k in kinds:
        known = F.max(f"{k}__known").over(w)
        run = F.max(f"{k}__run").over(w)
        active = F.coalesce(known > F.col(day), F.lit(False))
        done = F.max(f"{k}__done").over(w)
        last_end = F.when(active, done).otherwise(known)
        cols += [
            active.cast("int").alias(f"{k}_in_use_eod"),
            F.coalesce(F.sum(f"{k}__gap").over(w), F.lit(0)).alias(f"{k}_restarts"),
            F.when(active, F.col(day) - run + 1).otherwise(0).alias(f"{k}_run_days"),
            (F.col(day) - last_end).alias(f"{k}_days_since_end"),
        ]
    out = calendar_only(stack_days(cal, daily).select("*", *cols))
    names = [f"{k}_{c}" for k in kinds for c in STATE_COLUMNS]
    both = [(F.col(f"{a}_in_use_eod") * F.col(f"{b}_in_use_eod")).alias(f"{a}_{b}_eod") for a, b in pairs]
    return out.select(*cal.columns, *names, *both)


def _finished_runs(runs: DataFrame, opens: Column, kind: str, entity: str, day: str) -> DataFrame:
    """(entity, kind, day, __done): on the day a run opens, the end day of the run before it.

    The earlier run's boundary is the running maximum before the opening start; its end day is
    that boundary for a timed end (floor) and the day before it for a date-only end.
    """
    opened = runs.where(opens & F.col("__prev").isNotNull())
    done = runs.groupBy(entity, kind, F.col("__b").alias("__prev")).agg(F.max("__known").alias("__done"))
    return opened.join(done, [entity, kind, "__prev"]).select(entity, kind, to_day("__s").alias(day), "__done")


# --- times of one entity: boundary counts ---


def boundary_counts(records: DataFrame, start: str, end: str, *, entity: str = ENTITY, by: Sequence[str] = ()) -> DataFrame:
    """Per (entity, time): starts, ends, zero-length records, and the same accumulated over time.

    ``cum_s`` counts starts at or before t, ``cum_e`` ends at or before t.
    """
    s, e = F.col(start).cast("double"), F.col(end).cast("double")
    moves = F.array(
        F.struct(s.alias("t"), F.lit(1).alias("s"), F.lit(0).alias("e"), (s == e).cast("int").alias("z")),
        F.struct(e.alias("t"), F.lit(0).alias("s"), F.lit(1).alias("e"), F.lit(0).alias("z")),
    )
    keys = [entity, *by]
    at = records.select(*keys, F.explode(moves).alias("m")).groupBy(*keys, F.col("m.t").alias("t")).agg(
        F.sum("m.s").alias("n_s"), F.sum("m.e").alias("n_e"), F.sum("m.z").alias("n_z")
    )
    return running(at, keys, ["t"], block=to_day("t"), sums={"cum_s": "n_s", "cum_e": "n_e"})


PAIR_CLASSES = ("identical_interval", "strict_overlap", "equal_boundary", "zero_length_inside", "disjoint")


def pair_relations(records: DataFrame, start: str, end: str, *, entity: str = ENTITY) -> DataFrame:
    """Unordered pairs of valid records within an entity, counted by relation without forming pairs.

    One row per class: pairs and entities. ``disjoint`` counts ends before a start, boundaries and
    zero-length records come from the counts at one time, ``strict_overlap`` is the remainder.
    """
    valid = records.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
    same = valid.groupBy(entity, start, end).agg(F.count("*").alias("c")).groupBy(entity).agg(
        F.sum("c").alias("n"), F.sum(F.expr("c * (c - 1) div 2")).alias("identical_interval")
    )
    at = boundary_counts(valid, start, end, entity=entity)
    per = at.groupBy(entity).agg(
        F.sum(F.col("n_e") * F.col("n_s") - F.col("n_z") * F.col("n_z")).alias("equal_boundary"),
        # started before t, minus those that ended at or before t (zero-length ones at t did not start before)
        F.sum(
            F.col("n_z") * ((F.col("cum_s") - F.col("n_s")) - (F.col("cum_e") - F.col("n_z")))
        ).alias("zero_length_inside"),
        F.sum(F.col("n_s") * (F.col("cum_e") - F.col("n_e"))).alias("disjoint"),
    )
    all_ = same.join(per, entity).withColumn(
        "strict_overlap",
        F.expr("n * (n - 1) div 2 - identical_interval - equal_boundary - zero_length_inside - disjoint"),
    )
    totals = all_.agg(
        *[F.sum(c).alias(c) for c in PAIR_CLASSES],
        *[F.count_if(F.col(c) > 0).alias(f"{c}__e") for c in PAIR_CLASSES],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("relation"), F.col(c).alias("pairs"), F.col(f"{c}__e").alias("entities"))
                     for c in PAIR_CLASSES])
    return totals.select(F.explode(rows).alias("r")).select("r.*")


def excluded_records(records: DataFrame, start: str, end: str) -> DataFrame:
    """Why records do not enter the pair audit; first failing rule wins."""
    reason = (
        F.when(F.col(start).isNull(), "missing_or_invalid_start")
        .when(F.col(end).isNull(), "missing_or_invalid_end")
        .when(F.col(end) < F.col(start), "reverse_interval")
        .otherwise("valid")
    )
    return records.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def end_neighbours(records: DataFrame, start: str, end: str, *, entity: str = ENTITY) -> DataFrame:
    """Per (entity, end time): next strictly later start, records open across it, starts exactly at it.

    ``n_end`` ends fall on the time; ``n_zero`` of them are zero-length records.
    """
    at = boundary_counts(records, start, end, entity=entity)
    back = at.withColumn("__neg", -F.col("t"))
    nxt = running(
        back.withColumn("__nx", F.when(F.col("n_s") > 0, -F.col("t"))), [entity], ["__neg"],
        block=-to_day("t"), maxes={"__nx": "__nx"}, before=True,
    )
    return nxt.where(F.col("n_e") > 0).select(
        entity,
        F.col("t").alias("end_time"),
        F.col("n_e").alias("n_end"),
        F.col("n_z").alias("n_zero"),
        F.col("n_s").alias("starts_at_end"),
        ((F.col("cum_s") - F.col("n_s")) - (F.col("cum_e") - F.col("n_z"))).alias("open_across"),
        (-F.col("__nx")).alias("next_start"),
    )
