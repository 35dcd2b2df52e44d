"""Entity-day panel building: calendar, pulses, histories, as-of values, labels and gates.

Raw records are merged to one row per (entity, day) before any per-entity window, so a window
partition never holds more rows than the entity has days, however many records the entity has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import as_col, event_group

ENTITY, DAY = "entity", "day"


def calendar(anchors: DataFrame, *, start: str = "adm", end: str = "dis", day: str = DAY) -> DataFrame:
    """One row per entity and day from start to end inclusive; a missing or reversed anchor is an error."""
    ok = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start))
    last = F.when(ok, F.col(end)).otherwise(F.raise_error(F.lit("calendar anchors must be present, end >= start")))
    return anchors.withColumn(day, F.explode(F.sequence(F.col(start), last)))


def anchors(
    master: DataFrame, events: DataFrame, flagged: DataFrame, *, entity: str = ENTITY, event_day: str = DAY
) -> DataFrame:
    """Anchor table: first event over the event table, event class and membership flag.

    ``master`` has one row per entity with ``adm``, ``idx``; ``flagged`` lists entities to mark.
    """
    first = events.groupBy(entity).agg(F.min(event_day).alias("event"))
    mark = flagged.select(entity).distinct().withColumn("flagged", F.lit(1))
    out = master.join(first, entity, "left").join(mark, entity, "left")
    rel, since = F.col("event") - F.col("idx"), F.col("event") - F.col("adm")
    return out.select(
        *[F.col(c) for c in master.columns],
        "event",
        rel.alias("event_rel"),
        since.alias("event_since_start"),
        F.coalesce("flagged", F.lit(0)).alias("flagged"),
        event_group(rel, since).alias("event_group"),
    )


def risk_set(cal: DataFrame, *, day: str = DAY, end: str = "dis", event: str = "event") -> DataFrame:
    """Days strictly before the end and strictly before the first event (no event keeps all)."""
    return cal.where((F.col(day) < F.col(end)) & (F.col(event).isNull() | (F.col(day) < F.col(event))))


def row_set(in_scope: Column, group: Column, day: Column, index: Column, limit: int = 31) -> Column:
    """Ordered assignment of a row to formal, c_aux, d_window, late_aux or drop."""
    rel = day - index
    return (
        F.when(in_scope & group.isin("a", "b", "none") & (rel <= limit), "formal")
        .when(in_scope & (group == "c") & (day < index), "c_aux")
        .when(in_scope & (group == "d") & (rel <= limit), "d_window")
        .when(in_scope & group.isin("d", "none") & (rel > limit), "late_aux")
        .otherwise("drop")
    )


def labels(df: DataFrame, *, day: str = DAY, event: str = "event") -> DataFrame:
    """y3 / y30: event within 1..3 / 1..30 days; lead on the y3 rows only."""
    ahead = F.col(event) - F.col(day)
    y3 = F.coalesce(ahead.between(1, 3), F.lit(False))
    return df.select(
        "*",
        y3.cast("int").alias("y3"),
        F.coalesce(ahead.between(1, 30), F.lit(False)).cast("int").alias("y30"),
        F.when(y3, ahead).alias("lead"),
    )


def landmark(df: DataFrame, kind: str, offset: int) -> DataFrame:
    """One row per entity at start-day or rel-day ``offset``, with the landmark labels yB and yB30."""
    at = (F.col("day") - F.col("adm") == offset) if kind == "doa" else (F.col("rel") == offset)
    after = F.col("event") > F.col("day")
    return df.where(at).select(
        "*",
        F.coalesce(after & (F.col("event") - F.col("idx") <= 31), F.lit(False)).cast("int").alias("yB"),
        F.coalesce(after & (F.col("event") - F.col("day") <= 30), F.lit(False)).cast("int").alias("yB30"),
    )


# --- stacking calendar and daily facts ---


def stack_days(cal: DataFrame, daily: DataFrame) -> DataFrame:
    """Calendar rows and daily fact rows in one frame; ``is_cal`` marks the calendar rows.

    Windows use ``up_to_day`` (a RANGE frame), so facts of the same day are peers and facts
    before the calendar start still count.
    """
    return cal.withColumn("is_cal", F.lit(True)).unionByName(daily, allowMissingColumns=True)


def up_to_day(entity: str = ENTITY, day: str = DAY, keys: Sequence[str] = ()) -> Window:
    return Window.partitionBy(entity, *keys).orderBy(day).rangeBetween(Window.unboundedPreceding, 0)


def trailing_days(n: int, entity: str = ENTITY, day: str = DAY) -> Window:
    return Window.partitionBy(entity).orderBy(day).rangeBetween(-(n - 1), 0)


def calendar_only(df: DataFrame) -> DataFrame:
    return df.where("is_cal").drop("is_cal")


def to_day(serial: Column | str) -> Column:
    return F.floor(as_col(serial)).cast("int")


# --- pulses and numeric attributes ---


def daily_facts(
    points: DataFrame, aggs: Mapping[str, Column], *, entity: str = ENTITY, serial: str = "serial", day: str = DAY
) -> DataFrame:
    """Merge dated records to (entity, day); undated records are ignored."""
    dated = points.where(F.col(serial).isNotNull()).withColumn(day, to_day(serial))
    return dated.groupBy(entity, day).agg(*[c.alias(n) for n, c in aggs.items()])


def attach_daily(
    cal: DataFrame, daily: DataFrame, *, entity: str = ENTITY, day: str = DAY, fill: Mapping[str, object] | None = None
) -> DataFrame:
    """Left join daily facts onto the calendar; columns in ``fill`` get a default."""
    out = cal.join(daily, [entity, day], "left")
    for name, value in (fill or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def pulse(cal: DataFrame, points: DataFrame, name: str = "pulse", **keys) -> DataFrame:
    """1 on days with at least one dated record, else 0."""
    return attach_daily(cal, daily_facts(points, {name: F.max(F.lit(1))}, **keys),
                        fill={name: 0})


def code_pulses(cal: DataFrame, points: DataFrame, code: str, codes: Sequence[str], prefix: str, **keys) -> DataFrame:
    """Multi-hot pulses: one 0/1 column per listed code."""
    names = {f"{prefix}{c}": F.max((F.col(code) == c).cast("int")) for c in codes}
    return attach_daily(cal, daily_facts(points, names, **keys), fill=dict.fromkeys(names, 0))


def daily_max(cal: DataFrame, points: DataFrame, value: str, name: str, unknown: float | None = None, **keys) -> DataFrame:
    """Daily maximum (0 without a record); the unknown code counts as 0 and sets ``<name>_unknown``."""
    is_unknown = (F.col(value) == unknown) if unknown is not None else F.lit(False)
    aggs = {
        name: F.max(F.when(is_unknown, 0).otherwise(F.greatest(F.col(value), F.lit(0)))),
        f"{name}_unknown": F.max(is_unknown.cast("int")),
    }
    return attach_daily(cal, daily_facts(points, aggs, **keys), fill={name: 0, f"{name}_unknown": 0})


def daily_mean(cal: DataFrame, points: DataFrame, value: str, name: str, **keys) -> DataFrame:
    """Daily mean of samples, number of samples, has-sample flag; no sample stays NULL."""
    aggs = {name: F.avg(value), f"{name}_n": F.count(F.lit(1))}
    out = attach_daily(cal, daily_facts(points, aggs, **keys), fill={f"{name}_n": 0})
    return out.withColumn(f"{name}_has", (F.col(f"{name}_n") > 0).cast("int"))


# --- histories and running counts ---


def history_flags(
    df: DataFrame, base: str, *, rel: str = "rel", post_values: str | None = None, inclusive: bool = True,
    entity: str = ENTITY, day: str = DAY,
) -> DataFrame:
    """``<base>_pre`` / ``<base>_post``: ever positive so far on pre days / on post days.

    Post days include the index day for pulses and leave it out for states. While nothing was
    positive yet, an unknown (NULL) value in scope makes the history unknown.
    """
    w = up_to_day(entity, day)
    known = F.col(base).isNotNull()
    scopes = {
        "pre": (F.col(rel) < 0, F.col(base)),
        "post": (F.col(rel) >= 0 if inclusive else F.col(rel) > 0, F.col(post_values or base)),
    }
    for name, (scope, value) in scopes.items():
        hit = F.max(F.when(scope & known & (value == 1), 1).otherwise(0)).over(w)
        unsure = F.max(F.when(scope & ~known, 1).otherwise(0)).over(w)
        df = df.withColumn(f"{base}_{name}", F.when((hit == 0) & (unsure == 1), F.lit(None).cast("int")).otherwise(hit))
    return df


def running_days(
    df: DataFrame, base: str, *, rel: str = "rel", entity: str = ENTITY, day: str = DAY
) -> DataFrame:
    """Cumulative positive days before / since the index and cumulative off days since the index.

    Each total turns NULL from the first unknown day of its scope on.
    """
    w = up_to_day(entity, day)
    known = F.col(base).isNotNull()
    pre, post = F.col(rel) < 0, F.col(rel) >= 0

    def total(scope: Column, value: Column) -> Column:
        unsure = F.max(F.when(scope & ~known, 1).otherwise(0)).over(w)
        s = F.sum(F.when(scope & known, value).otherwise(0)).over(w)
        return F.when(unsure == 0, s)

    return df.select(
        "*",
        total(pre, F.col(base)).alias(f"{base}_pre_days"),
        total(post, F.col(base)).alias(f"{base}_post_days"),
        total(post, 1 - F.col(base)).alias(f"{base}_off_days"),
    )


def status_streams(
    cal: DataFrame, points: DataFrame, *, positive: Column, unknown: Column, name: str, entity: str = ENTITY,
    day: str = DAY, **keys,
) -> DataFrame:
    """Known-positive and unknown pulses, each with its running history."""
    aggs = {name: F.max(positive.cast("int")), f"{name}_unknown": F.max(unknown.cast("int"))}
    out = attach_daily(cal, daily_facts(points, aggs, entity=entity, day=day, **keys), entity=entity, day=day,
                       fill={name: 0, f"{name}_unknown": 0})
    w = up_to_day(entity, day)
    return out.select(
        "*",
        F.max(name).over(w).alias(f"{name}_history"),
        F.max(f"{name}_unknown").over(w).alias(f"{name}_history_unknown"),
    )


def last_observed(
    cal: DataFrame, points: DataFrame, values: Sequence[str], *, serial: str = "serial", tie: str | None = None,
    entity: str = ENTITY, day: str = DAY,
) -> DataFrame:
    """Backward as-of: last non-null value strictly before the end of the day, and its age then.

    Per value column: (time, value) is merged to the latest of each day, then carried forward.
    ``tie`` orders records with the same time; the smallest wins.
    """
    order = [F.col(serial)] + ([-F.col(tie)] if tie else [])
    aggs = {
        f"__{v}": F.max(F.when(F.col(v).isNotNull(), F.struct(*[c.alias(f"t{i}") for i, c in enumerate(order)],
                                                              F.col(v).alias("v"))))
        for v in values
    }
    daily = daily_facts(points, aggs, entity=entity, serial=serial, day=day)
    w = up_to_day(entity, day)
    out = stack_days(cal, daily).select("*", *[F.last(f"__{v}", ignorenulls=True).over(w).alias(f"__last_{v}")
                                               for v in values])
    return calendar_only(out).select(
        *cal.columns,
        *[F.col(f"__last_{v}.v").alias(f"{v}_last") for v in values],
        *[(F.col(day) + 1 - F.col(f"__last_{v}.t0")).alias(f"{v}_age") for v in values],
    )


def event_recency(
    cal: DataFrame, points: DataFrame, *, name: str = "", start: str = "adm", entity: str = ENTITY, day: str = DAY,
    serial: str = "serial", window: int = 7,
) -> DataFrame:
    """Days since the most recent event, events in the trailing window, ever; events before start are dropped.

    Several events on one day count separately.
    """
    prefix = f"{name}_" if name else ""
    daily = daily_facts(points, {"__n": F.count(F.lit(1))}, entity=entity, day=day, serial=serial)
    bounds = cal.select(*cal.columns, F.lit(0).alias("__n"))
    out = attach_daily(bounds.drop("__n"), daily, entity=entity, day=day, fill={"__n": 0})
    w, recent = up_to_day(entity, day), trailing_days(window, entity, day)
    last = F.max(F.when(F.col("__n") > 0, F.col(day))).over(w)
    return out.select(
        *cal.columns,
        (F.col(day) - last).alias(f"{prefix}days_since"),
        F.sum("__n").over(recent).alias(f"{prefix}count_{window}d"),
        last.isNotNull().cast("int").alias(f"{prefix}ever"),
    )


def family_recency(
    cal: DataFrame, points: DataFrame, families: Mapping[str, Column], *, entity: str = ENTITY, day: str = DAY,
    serial: str = "serial", window: int = 7,
) -> DataFrame:
    """Recency of several event streams in one pass; a stream may pool several sources."""
    aggs = {f"__{f}": F.sum(cond.cast("long")) for f, cond in families.items()}
    daily = daily_facts(points, aggs, entity=entity, day=day, serial=serial)
    out = attach_daily(cal, daily, entity=entity, day=day, fill={k: 0 for k in aggs})
    w, recent = up_to_day(entity, day), trailing_days(window, entity, day)
    cols = []
    for f in families:
        last = F.max(F.when(F.col(f"__{f}") > 0, F.col(day))).over(w)
        cols += [
            (F.col(day) - last).alias(f"{f}_days_since"),
            F.sum(f"__{f}").over(recent).alias(f"{f}_count_{window}d"),
            last.isNotNull().cast("int").alias(f"{f}_ever"),
        ]
    return out.select(*cal.columns, *cols)


def days_since_first(df: DataFrame, flag: str, name: str, *, entity: str = ENTITY, day: str = DAY) -> DataFrame:
    """Days since the flag was first on, on the days it is on."""
    on = F.col(flag) == 1
    first = F.min(F.when(on, F.col(day))).over(Window.partitionBy(entity))
    return df.withColumn(name, F.when(on, F.col(day) - first))


def clocks(
    df: DataFrame, states: Sequence[str] = (), *, age: str | None = None, entity: str = ENTITY, day: str = DAY
) -> DataFrame:
    """Age, days since start, post flag, rel day (NULL before the index) and previous-row state changes."""
    rel = F.col(day) - F.col("idx")
    w = Window.partitionBy(entity).orderBy(day)
    cols = [
        (F.col(day) - F.col("adm")).alias("z_since_start"),
        (rel >= 0).cast("int").alias("z_post"),
        F.when(rel >= 0, rel).alias("z_rel"),
    ]
    if age:
        cols.append((F.col(age) + rel).alias("z_age"))
    cols += [(F.col(s) - F.lag(s).over(w)).alias(f"z_d1_{s}") for s in states]
    return df.select("*", *cols)


# --- availability gates ---


def availability_gates(
    df: DataFrame, *, day: str = DAY, index: str = "idx", arrival: str = "icu", strict: bool = True
) -> DataFrame:
    """post_open, surgery_open, two_hour_open at the end of the day.

    An arrival is plausible 0..2 days after the index. ``strict`` needs it before midnight; the
    older inclusive form also accepts midnight itself.
    """
    d, s, t = F.col(day), F.col(index), F.col(arrival)
    plausible = F.coalesce((t - s).between(0, 2), F.lit(False))
    done = (t < d + 1) if strict else (t <= d + 1)
    two = t + F.lit(2 / 24)
    two_done = (two < d + 1) if strict else (two <= d + 1)
    post = d >= s
    return df.select(
        "*",
        post.alias("post_open"),
        (post & ((d > s) | (plausible & F.coalesce(done, F.lit(False))))).alias("surgery_open"),
        (post & plausible & F.coalesce(two_done, F.lit(False))).alias("two_hour_open"),
    )


def apply_gates(df: DataFrame, gates: Mapping[str, Sequence[str]]) -> DataFrame:
    """NULL every column while one of its gates is closed. ``gates`` maps column -> gate columns."""

    def masked(c: str) -> Column:
        open_ = None
        for g in gates.get(c, ()):
            open_ = F.col(g) if open_ is None else open_ & F.col(g)
        return F.col(c) if open_ is None else F.when(open_, F.col(c)).alias(c)

    return df.select(*[masked(c) for c in df.columns])


def derive(
    df: DataFrame, derived: Mapping[str, tuple[Column, Sequence[str]]], gates: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Add derived columns that stay NULL unless the gates of all their parents are open."""
    cols = []
    for name, (expr, parents) in derived.items():
        need = sorted({g for p in parents for g in gates.get(p, ())})
        open_ = None
        for g in need:
            open_ = F.col(g) if open_ is None else open_ & F.col(g)
        cols.append((expr if open_ is None else F.when(open_, expr)).alias(name))
    return df.select("*", *cols)


# --- code sets ---


def visible_codes(codes: Column | str, gate: Column | str) -> Column:
    """Codes while the gate is open, else an empty set."""
    c = as_col(codes)
    return F.when(as_col(gate), c).otherwise(F.array().cast("array<string>"))


def index_code_book(
    master: DataFrame, records: DataFrame, *, entity: str, op: str, code: str, primary: Column,
    forbidden: Sequence[str] = (),
) -> DataFrame:
    """Code sets of the index record only: all codes, and the primary code when exactly one is flagged."""
    c = F.col(code)
    ok = (c.isNotNull()) & (c != "") & ~c.isin(list(forbidden)) if forbidden else c.isNotNull() & (c != "")
    linked = records.where(ok).join(master.select(entity, F.col(op).alias("__op")), entity).where(
        F.col(op) == F.col("__op")
    )
    sets = linked.groupBy(entity).agg(
        F.sort_array(F.collect_set(c)).alias("codes"),
        F.sort_array(F.collect_set(F.when(primary, c))).alias("__p"),
    )
    empty = F.array().cast("array<string>")
    return master.select(entity).join(sets, entity, "left").select(
        entity,
        F.coalesce("codes", empty).alias("codes"),
        F.when(F.size("__p") == 1, F.col("__p")).otherwise(empty).alias("primary_code"),
    )


def flag_code_crosswalk(
    flags: DataFrame, codes: DataFrame, *, entity: str, flag: str, code: str
) -> DataFrame:
    """Codes whose entities all carry the flag, with cover counts and whether the code is essential.

    A code is essential when it is the only candidate code of some flagged entity.
    """
    pairs = codes.select(entity, code).distinct().join(flags.select(entity, flag), entity)
    stats = pairs.groupBy(code).agg(
        F.count("*").alias("entities"), F.sum((F.col(flag) == 1).cast("long")).alias("flagged_entities")
    )
    candidates = stats.where(F.col("entities") == F.col("flagged_entities")).select(code, "entities")
    covered = pairs.join(candidates.select(code), code)
    sole = covered.groupBy(entity).agg(F.count("*").alias("__n"), F.min(code).alias(code)).where("__n = 1")
    essential = sole.groupBy(code).agg(F.count("*").alias("sole_cover"))
    return candidates.join(essential, code, "left").select(
        code,
        "entities",
        F.coalesce("sole_cover", F.lit(0)).alias("sole_cover"),
        (F.coalesce("sole_cover", F.lit(0)) > 0).cast("int").alias("essential"),
    )


def member_flags(codes: Column | str, groups: Mapping[str, Sequence[str]]) -> list[Column]:
    """One 0/1 column per code group; NULL when the entity has no code at all."""
    c = as_col(codes)
    return [
        F.when(F.size(c) > 0, F.arrays_overlap(c, F.array(*[F.lit(m) for m in members])).cast("int")).alias(name)
        for name, members in groups.items()
    ]


def family_counts(
    entities: DataFrame, codes: DataFrame, tag_map: DataFrame, families: Sequence[str], *, entity: str, code: str,
    prefix: str = "dxg_",
) -> DataFrame:
    """Distinct codes per family and in total; all NULL when the entity has no code."""
    pairs = codes.where(F.col(code).isNotNull() & (F.col(code) != "")).select(entity, code).distinct()
    tagged = pairs.join(tag_map.select(code, "families"), code, "left")
    agg = tagged.groupBy(entity).agg(
        *[F.sum(F.array_contains("families", f).cast("long")).alias(f"{prefix}{f}") for f in families],
        F.count("*").alias(f"{prefix}n_codes"),
    )
    return entities.select(entity).join(agg, entity, "left")


def cohort_context(
    master: DataFrame, events: DataFrame, *, entity: str, event_day: str, site: str
) -> DataFrame:
    """Entities with a unique master row, first event, undated-event flag and anonymous site label."""
    unique = master.groupBy(entity).agg(F.count("*").alias("__n"), F.first(site).alias(site)).where("__n = 1")
    ev = events.groupBy(entity).agg(
        F.min(event_day).alias("first_event"), F.max(F.col(event_day).isNull().cast("int")).alias("undated_event")
    )
    # one row per site before ranking
    labels_ = unique.select(site).distinct().withColumn(
        "site_label", F.format_string("C%02d", F.row_number().over(Window.orderBy(site)))
    )
    return (
        unique.drop("__n")
        .join(ev, entity, "left")
        .join(labels_, site, "left")
        .select(entity, "site_label", "first_event", F.coalesce("undated_event", F.lit(0)).alias("undated_event"))
    )
