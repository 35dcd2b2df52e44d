"""Panel building (PAN) and risk-set (FLT-01/02) queries with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import intervals, panel
from tidemark.plans.catalog import query
from tidemark.plans.common import longs, r6, sr6

K = ["entity", "day"]
CAL = "f_calendar c"
BY_DAY = "FROM f_point GROUP BY entity, day"


@query(
    "flagship",
    """
SELECT c.entity, c.day, c.y3,
  CASE WHEN EXISTS (SELECT 1 FROM f_interval_daily i WHERE i.entity = c.entity
        AND (i.end_ts IS NULL OR i.end_ts >= i.start_ts) AND floor(i.start_ts) <= c.day
        AND (i.end_ts IS NULL OR floor(i.end_ts) >= c.day)) THEN 1 ELSE 0 END AS active,
  CAST(c.day - (SELECT max(p.day) FROM f_point p WHERE p.entity = c.entity AND p.day <= c.day) AS BIGINT) AS days_since,
  CAST((SELECT count(*) FROM f_point p WHERE p.entity = c.entity AND p.day BETWEEN c.day - 6 AND c.day) AS BIGINT)
    AS count_7d
FROM f_risk c""",
)
def flagship(x):
    """Calendar, open intervals, event recency, 3-day label and risk set in one plan."""
    cal = panel.calendar(x.anchors)
    out = intervals.active_flags(
        cal, x.interval_daily, {"active": F.lit(True)}, start="start_ts", end="end_ts"
    )
    out = panel.event_recency(out, x.point)
    return longs(panel.labels(panel.risk_set(out)).select(*K, "y3", "active", "days_since", "count_7d"),
                 "days_since", "count_7d")


@query("pan_01", "SELECT entity, day, rel, CAST(post AS INTEGER) AS post FROM f_calendar")
def pan_01(x):
    return x.calendar.select(*K, "rel", F.col("post").cast("int").alias("post"))


@query(
    "pan_02",
    """
SELECT m.entity, m.adm, m.idx, e.event, e.event - m.idx AS event_rel, e.event - m.adm AS event_since_start,
  CASE WHEN p.entity IS NULL THEN 0 ELSE 1 END AS flagged,
  CASE WHEN e.event IS NULL THEN 'none' WHEN e.event - m.adm < 0 THEN 'err' WHEN e.event - m.idx < 0 THEN 'c'
       WHEN e.event - m.idx <= 3 THEN 'b' WHEN e.event - m.idx <= 31 THEN 'a' ELSE 'd' END AS event_group
FROM f_anchors m
LEFT JOIN (SELECT entity, min(day) AS event FROM f_point WHERE kind = 'error' AND value >= 150 GROUP BY entity) e
  ON e.entity = m.entity
LEFT JOIN (SELECT DISTINCT entity FROM f_point WHERE kind = 'purchase' AND value > 200) p ON p.entity = m.entity""",
)
def pan_02(x):
    events = x.point.where((F.col("kind") == "error") & (F.col("value") >= 150))
    flagged = x.point.where((F.col("kind") == "purchase") & (F.col("value") > 200))
    return panel.anchors(x.anchors.select("entity", "adm", "idx"), events, flagged)


@query(
    "pan_03",
    """
SELECT c.entity, c.day, CASE WHEN p.day IS NULL THEN 0 ELSE 1 END AS pulse
FROM f_calendar c LEFT JOIN (SELECT DISTINCT entity, day FROM f_point WHERE kind = 'click') p USING (entity, day)""",
)
def pan_03(x):
    return panel.pulse(x.calendar, x.point.where("kind = 'click'")).select(*K, "pulse")


_ACTIVE = """CASE WHEN EXISTS (SELECT 1 FROM f_interval_daily i WHERE i.entity = c.entity {extra}
   AND (i.end_ts IS NULL OR i.end_ts >= i.start_ts) AND floor(i.start_ts) <= c.day
   AND (i.end_ts IS NULL OR floor(i.end_ts) >= c.day)) THEN 1 ELSE 0 END"""


@query("pan_04", f"SELECT c.entity, c.day, {_ACTIVE.format(extra='')} AS active FROM f_calendar c")
def pan_04(x):
    out = intervals.active_flags(x.calendar, x.interval_daily, {"active": F.lit(True)}, start="start_ts", end="end_ts")
    return out.select(*K, "active")


@query(
    "pan_05",
    "SELECT c.entity, c.day, "
    + ", ".join(
        f"CASE WHEN EXISTS (SELECT 1 FROM f_point p WHERE p.entity = c.entity AND p.day = c.day AND p.kind = '{k}')"
        f" THEN 1 ELSE 0 END AS kind_{k}"
        for k in ("click", "error", "purchase", "signup", "view")
    )
    + f", {_ACTIVE.format(extra="AND i.kind = 'x'")} AS iv_x, {_ACTIVE.format(extra="AND i.kind = 'z'")} AS iv_z"
    + " FROM f_calendar c",
)
def pan_05(x):
    kinds = ("click", "error", "purchase", "signup", "view")
    out = panel.code_pulses(x.calendar, x.point, "kind", kinds, "kind_")
    groups = {"iv_x": F.col("kind") == "x", "iv_z": F.col("kind") == "z"}
    out = intervals.active_flags(out, x.interval_daily, groups, start="start_ts", end="end_ts")
    return out.select(*K, *[f"kind_{k}" for k in kinds], "iv_x", "iv_z")


# a daily status with unknown days: value over 150 is unknown, over 60 positive
_STATUS = """
WITH s AS (SELECT c.entity, c.day, c.rel, CASE WHEN m > 150 THEN NULL WHEN m > 60 THEN 1 ELSE 0 END AS b
  FROM f_calendar c LEFT JOIN (SELECT entity, day, max(value) AS m FROM f_point WHERE kind = 'click'
                               GROUP BY entity, day) p USING (entity, day))
"""


def _status(x):
    m = x.point.where("kind = 'click'")
    out = panel.attach_daily(x.calendar, panel.daily_facts(m, {"m": F.max("value")}))
    b = F.when(F.col("m") > 150, F.lit(None).cast("int")).when(F.col("m") > 60, 1).otherwise(0)
    return out.withColumn("b", b)


def _hist(scope: str) -> str:
    return f"""CASE WHEN max(CASE WHEN {scope} AND b = 1 THEN 1 ELSE 0 END) OVER w = 0
      AND max(CASE WHEN {scope} AND b IS NULL THEN 1 ELSE 0 END) OVER w = 1 THEN NULL
      ELSE max(CASE WHEN {scope} AND b = 1 THEN 1 ELSE 0 END) OVER w END"""


_W = "WINDOW w AS (PARTITION BY entity ORDER BY day ROWS UNBOUNDED PRECEDING)"


@query(
    "pan_06",
    f"""{_STATUS} SELECT entity, day, {_hist('rel < 0')} AS b_pre, {_hist('rel >= 0')} AS b_post,
 {_hist('rel > 0')} AS b_post_state FROM s {_W}""",
)
def pan_06(x):
    s = _status(x).withColumn("b2", F.col("b"))
    out = panel.history_flags(s, "b")
    out = panel.history_flags(out, "b2", inclusive=False)
    return out.select(*K, "b_pre", "b_post", F.col("b2_post").alias("b_post_state"))


def _tot(scope: str, v: str) -> str:
    return f"""CASE WHEN max(CASE WHEN {scope} AND b IS NULL THEN 1 ELSE 0 END) OVER w = 0
      THEN CAST(sum(CASE WHEN {scope} AND b IS NOT NULL THEN {v} ELSE 0 END) OVER w AS BIGINT) END"""


@query(
    "pan_07",
    f"""{_STATUS} SELECT entity, day, {_tot('rel < 0', 'b')} AS b_pre_days, {_tot('rel >= 0', 'b')} AS b_post_days,
 {_tot('rel >= 0', '1 - b')} AS b_off_days FROM s {_W}""",
)
def pan_07(x):
    return panel.running_days(_status(x), "b").select(*K, "b_pre_days", "b_post_days", "b_off_days")


@query(
    "pan_08",
    """
SELECT c.entity, c.day, coalesce(p.m, 0e0) AS dose, coalesce(p.u, 0) AS dose_unknown
FROM f_calendar c LEFT JOIN (
  SELECT entity, day, max(CASE WHEN k = 9 THEN 0e0 ELSE greatest(k, 0) END) AS m,
         max(CASE WHEN k = 9 THEN 1 ELSE 0 END) AS u FROM f_point GROUP BY entity, day) p USING (entity, day)""",
)
def pan_08(x):
    pts = x.point.withColumn("kd", F.col("k").cast("double"))
    return panel.daily_max(x.calendar, pts, "kd", "dose", unknown=9.0).select(
        *K, F.col("dose").cast("double").alias("dose"), "dose_unknown")


@query(
    "pan_09",
    """
SELECT c.entity, c.day, coalesce(p.a, 0) AS st, coalesce(p.u, 0) AS st_unknown,
  max(coalesce(p.a, 0)) OVER w AS st_history, max(coalesce(p.u, 0)) OVER w AS st_history_unknown
FROM f_calendar c LEFT JOIN (
  SELECT entity, day, max(CASE WHEN k < 10 AND k <> 9 THEN 1 ELSE 0 END) AS a,
         max(CASE WHEN k = 9 THEN 1 ELSE 0 END) AS u FROM f_point GROUP BY entity, day) p USING (entity, day)
WINDOW w AS (PARTITION BY c.entity ORDER BY c.day)""",
)
def pan_09(x):
    out = panel.status_streams(
        x.calendar, x.point, positive=(F.col("k") < 10) & (F.col("k") != 9), unknown=F.col("k") == 9, name="st"
    )
    return out.select(*K, "st", "st_unknown", "st_history", "st_history_unknown")


@query(
    "pan_10",
    f"""
SELECT c.entity, c.day, {sr6('p.m', 'dose')}, coalesce(p.n, 0) AS dose_n,
  CASE WHEN coalesce(p.n, 0) > 0 THEN 1 ELSE 0 END AS dose_has
FROM f_calendar c LEFT JOIN (SELECT entity, day, avg(value) AS m, count(*) AS n FROM f_point
  WHERE kind = 'view' GROUP BY entity, day) p USING (entity, day)""",
)
def pan_10(x):
    out = panel.daily_mean(x.calendar, x.point.where("kind = 'view'"), "value", "dose")
    return r6(out.select(*K, "dose", "dose_n", "dose_has"), "dose")


_LAST = """
SELECT c.entity, c.day, {v}, {a} FROM f_calendar c
ASOF LEFT JOIN (SELECT entity, serial, value FROM f_point WHERE {cond}) p
  ON p.entity = c.entity AND p.serial < c.day + 1"""


@query(
    "pan_11",
    f"""
SELECT x.entity, x.day, x.value_last, x.value_age, y.k_last, y.k_age FROM
 (SELECT c.entity, c.day, p.value AS value_last, {sr6('c.day + 1 - p.serial', 'value_age')} FROM f_calendar c
  ASOF LEFT JOIN (SELECT entity, serial, value FROM f_point WHERE kind = 'view') p
  ON p.entity = c.entity AND p.serial < c.day + 1) x
JOIN (SELECT c.entity, c.day, p.k AS k_last, {sr6('c.day + 1 - p.serial', 'k_age')} FROM f_calendar c
  ASOF LEFT JOIN (SELECT entity, serial, k FROM f_point WHERE kind = 'view' AND k >= 20) p
  ON p.entity = c.entity AND p.serial < c.day + 1) y USING (entity, day)""",
)
def pan_11(x):
    pts = x.point.where("kind = 'view'").withColumn("k", F.when(F.col("k") >= 20, F.col("k")))
    out = panel.last_observed(x.calendar, pts, ["value", "k"], tie="event_id")
    return r6(out.select(*K, "value_last", "value_age", "k_last", "k_age"), "value_age", "k_age")


@query(
    "pan_12",
    """
SELECT c.entity, c.day, coalesce(s.n, 0) AS starting_today, coalesce(t.n, 0) AS source_records,
  coalesce(t.ms, 0) AS missing_start, coalesce(t.me, 0) AS missing_end
FROM f_calendar c
LEFT JOIN (SELECT entity, CAST(floor(start_ts) AS INTEGER) AS day, count(*) AS n FROM f_interval_daily GROUP BY 1, 2) s
  USING (entity, day)
LEFT JOIN (SELECT entity, count(*) AS n, count(*) FILTER (start_ts IS NULL) AS ms,
           count(*) FILTER (end_ts IS NULL) AS me FROM f_interval_daily GROUP BY entity) t USING (entity)""",
)
def pan_12(x):
    out = intervals.record_counts(x.calendar, x.interval_daily, start="start_ts", end="end_ts")
    return out.select(*K, "starting_today", "source_records", "missing_start", "missing_end")


_BURDEN_JOIN = """FROM f_calendar c LEFT JOIN f_interval_daily i ON i.entity = c.entity
  AND (i.end_ts IS NULL OR i.end_ts >= i.start_ts) GROUP BY c.entity, c.day"""


@query(
    "pan_13",
    f"""
SELECT c.entity, c.day,
  count(*) FILTER (floor(start_ts) <= c.day AND (end_ts IS NULL OR c.day < floor(end_ts))) AS in_place_eod,
  count(*) FILTER (floor(start_ts) = c.day) AS placed_today,
  count(*) FILTER (floor(start_ts) <= c.day) AS ever_placed,
  CAST(coalesce(sum(greatest(0, least(c.day, coalesce(floor(end_ts), c.day)) - greatest(floor(start_ts), min_adm) + 1)), 0)
       AS BIGINT) AS line_days
FROM (SELECT *, adm AS min_adm FROM f_calendar) c LEFT JOIN f_interval_daily i ON i.entity = c.entity
  AND (i.end_ts IS NULL OR i.end_ts >= i.start_ts) GROUP BY c.entity, c.day""",
)
def pan_13(x):
    out = intervals.line_burden(x.calendar, x.interval_daily, start="start_ts", end="end_ts")
    return longs(out.select(*K, "in_place_eod", "placed_today", "ever_placed", "line_days"),
                 "in_place_eod", "placed_today", "ever_placed", "line_days")


def _recency(name: str, cond: str) -> str:
    src = f"f_point p WHERE p.entity = c.entity AND p.day >= c.adm AND ({cond}) AND p.day <= c.day"
    return f"""c.day - (SELECT max(p.day) FROM {src}) AS {name}_days_since,
  (SELECT count(*) FROM {src} AND p.day >= c.day - 6) AS {name}_count_7d,
  CASE WHEN EXISTS (SELECT 1 FROM {src}) THEN 1 ELSE 0 END AS {name}_ever"""


@query("pan_14", f"SELECT c.entity, c.day, {_recency('err', "kind = 'error' AND value > 80")} FROM f_calendar c")
def pan_14(x):
    pts = x.point.where("kind = 'error' AND value > 80")
    return panel.event_recency(x.calendar, pts, name="err").select(
        *K, "err_days_since", "err_count_7d", "err_ever")


_FAM = {"inf": "kind IN ('error', 'signup') AND value > 90", "inf_unknown": "kind IN ('error', 'signup') AND k = 9",
        "view": "kind = 'view' AND value > 50"}


@query("pan_15", "SELECT c.entity, c.day, " + ", ".join(_recency(n, c) for n, c in _FAM.items()) + " FROM f_calendar c")
def pan_15(x):
    out = panel.family_recency(x.calendar, x.point, {n: F.expr(c) for n, c in _FAM.items()})
    return out.select(*K, *[f"{n}_{s}" for n in _FAM for s in ("days_since", "count_7d", "ever")])


_TAGS = {"metal": "bolt|nut|gear|ring", "tool": "widget|gadget|tool", "warm": "red|orange|yellow"}


@query(
    "pan_16",
    """
WITH tags AS (SELECT p_name AS code, """
    + ", ".join(f"CASE WHEN regexp_matches(p_name, '(?i){p}') THEN 1 ELSE 0 END AS f_{n}" for n, p in _TAGS.items())
    + """ FROM (SELECT DISTINCT p_name FROM part)),
pairs AS (SELECT DISTINCT l_orderkey AS entity, p_name AS code FROM lineitem JOIN part ON l_partkey = p_partkey
          WHERE l_returnflag = 'R')
SELECT o_orderkey AS entity, """
    + ", ".join(f"CAST(sum(f_{n}) AS BIGINT) AS dxg_{n}" for n in _TAGS)
    + ", CAST(sum(CASE WHEN " + " + ".join(f"f_{n}" for n in _TAGS) + " = 0 THEN 1 ELSE 0 END) * max(CASE WHEN p.code"
    " IS NULL THEN NULL ELSE 1 END) AS BIGINT) AS dxg_other,"
    """ CASE WHEN count(p.code) > 0 THEN count(p.code) END AS dxg_n_codes
FROM orders LEFT JOIN pairs p ON p.entity = o_orderkey LEFT JOIN tags t ON t.code = p.code GROUP BY o_orderkey""",
)
def pan_16(x):
    from tidemark.functions.scalars import tag_families

    part, line = x.table("part"), x.table("lineitem")
    tag_map = part.select(F.col("p_name").alias("code")).distinct().withColumn("families", tag_families("code", _TAGS))
    codes = line.where("l_returnflag = 'R'").join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("entity"), F.col("p_name").alias("code"))
    entities = x.table("orders").select(F.col("o_orderkey").alias("entity"))
    return panel.family_counts(entities, codes, tag_map, [*_TAGS, "other"], entity="entity", code="code")


# as-of union state, by brute force: islands are rebuilt for every (entity, kind, day)
def _union_sql(kind: str) -> str:
    return f"""
SELECT entity, day,
  CAST(coalesce(max(CASE WHEN isl = last_isl AND b = 1e300 THEN 1 END), 0) AS INTEGER) AS in_use,
  CAST(count(DISTINCT CASE WHEN gap >= 1 THEN isl END) AS BIGINT) AS restarts,
  CAST(coalesce(max(CASE WHEN isl = last_isl AND b = 1e300 THEN day - floor(isl_start) + 1 END), 0) AS BIGINT) AS run_days,
  CAST(day - max(CASE WHEN NOT isl_open AND b = isl_end THEN end_day END) AS BIGINT) AS since_end
FROM (
  SELECT *, max(isl) OVER (PARTITION BY entity, day) AS last_isl,
    min(s) OVER (PARTITION BY entity, day, isl) AS isl_start,
    max(b) OVER (PARTITION BY entity, day, isl) AS isl_end,
    max(b) OVER (PARTITION BY entity, day, isl) = 1e300 AS isl_open
  FROM (
    SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END)
        OVER (PARTITION BY entity, day ORDER BY s, b, rec ROWS UNBOUNDED PRECEDING) AS isl,
      CASE WHEN prev IS NOT NULL AND s > prev THEN floor(s) - ceil(prev) END AS gap
    FROM (
      SELECT *, max(b) OVER (PARTITION BY entity, day ORDER BY s, b, rec
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM (
        SELECT c.entity, c.day, i.rec, i.start_ts AS s,
          CASE WHEN i.start_ts IS NULL THEN NULL
               WHEN i.end_ts IS NULL OR i.end_ts + date_only::INT < i.start_ts THEN 1e300
               WHEN date_only AND floor(i.end_ts) <= c.day THEN i.end_ts + 1
               WHEN NOT date_only AND i.end_ts < c.day + 1 THEN i.end_ts ELSE 1e300 END AS b,
          CASE WHEN i.end_ts + date_only::INT >= i.start_ts
               AND ((date_only AND floor(i.end_ts) <= c.day) OR (NOT date_only AND i.end_ts < c.day + 1))
               THEN floor(i.end_ts) END AS end_day
        FROM f_calendar c LEFT JOIN f_interval_daily i
          ON i.entity = c.entity AND i.start_ts < c.day + 1 AND i.kind = '{kind}')))
) GROUP BY entity, day"""


_PAN_17 = f"""
SELECT x.entity, x.day, x.in_use AS x_in_use_eod, x.restarts AS x_restarts, x.run_days AS x_run_days,
  x.since_end AS x_days_since_end, z.in_use AS z_in_use_eod, z.restarts AS z_restarts, z.run_days AS z_run_days,
  z.since_end AS z_days_since_end
FROM ({_union_sql('x')}) x JOIN ({_union_sql('z')}) z USING (entity, day)"""


def union_state_frame(x, records=None, pairs=()):
    out = intervals.union_state(
        x.calendar.select(*K), x.interval_daily if records is None else records, ["x", "z"], start="start_ts",
        end="end_ts", date_only="date_only", pairs=pairs,
    )
    names = [f"{k}_{c}" for k in "xz" for c in ("restarts", "run_days", "days_since_end")]
    return longs(out, *names)


@query("pan_17", _PAN_17)
def pan_17(x):
    return union_state_frame(x)


@query("pan_18", f"SELECT entity, day, x_in_use_eod * z_in_use_eod AS x_z_eod FROM ({_PAN_17})")
def pan_18(x):
    return union_state_frame(x, pairs=[("x", "z")]).select(*K, "x_z_eod")


@query(
    "pan_19",
    f"""{_STATUS} SELECT entity, day, CASE WHEN on1 = 1 THEN day - min(CASE WHEN on1 = 1 THEN day END)
 OVER (PARTITION BY entity) END AS days_since_on
FROM (SELECT entity, day, max(coalesce(b, 0)) OVER w AS on1 FROM s {_W})""",
)
def pan_19(x):
    s = _status(x).withColumn("on1", F.max(F.coalesce("b", F.lit(0))).over(panel.up_to_day()))
    return panel.days_since_first(s, "on1", "days_since_on").select(*K, "days_since_on")


@query(
    "pan_20",
    """
WITH p AS (SELECT c.*, CASE WHEN q.day IS NULL THEN 0 ELSE 1 END AS pulse FROM f_risk c LEFT JOIN
  (SELECT DISTINCT entity, day FROM f_point WHERE kind = 'click') q ON q.entity = c.entity AND q.day = c.day)
SELECT entity, day, CAST(site + 30 + rel AS INTEGER) AS z_age, day - adm AS z_since_start,
  CASE WHEN rel >= 0 THEN 1 ELSE 0 END AS z_post, CASE WHEN rel >= 0 THEN rel END AS z_rel,
  pulse - lag(pulse) OVER (PARTITION BY entity ORDER BY day) AS z_d1_pulse FROM p""",
)
def pan_20(x):
    base = panel.pulse(x.risk, x.point.where("kind = 'click'")).withColumn("age0", F.col("site") + 30)
    return panel.clocks(base, ["pulse"], age="age0").select(
        *K, "z_age", "z_since_start", "z_post", "z_rel", "z_d1_pulse")


@query(
    "pan_21",
    """SELECT entity, day, y3, y30, CASE WHEN y3 = 1 THEN event - day END AS lead FROM f_risk""",
)
def pan_21(x):
    return panel.labels(panel.risk_set(x.calendar)).select(*K, "y3", "y30", "lead")


def _gate_sql(op: str) -> str:
    pl = "(icu - idx BETWEEN 0 AND 2)"
    return f"""CAST(day >= idx AS INTEGER) AS {{p}}post,
  CAST(day >= idx AND (day > idx OR ({pl} AND icu {op} day + 1)) AS INTEGER) AS {{p}}surgery,
  CAST(day >= idx AND {pl} AND icu + CAST(2 AS DOUBLE) / 24 {op} day + 1 AS INTEGER) AS {{p}}two_hour"""


@query(
    "pan_22",
    f"SELECT entity, day, {_gate_sql('<').format(p='s_')}, {_gate_sql('<=').format(p='i_')} FROM f_calendar",
)
def pan_22(x):
    names = {"post": "post_open", "surgery": "surgery_open", "two_hour": "two_hour_open"}
    strict = panel.availability_gates(x.calendar)
    strict = strict.select(*x.calendar.columns, *[F.col(g).cast("int").alias(f"s_{n}") for n, g in names.items()])
    both = panel.availability_gates(strict, strict=False)
    return both.select(*K, *[f"s_{n}" for n in names], *[F.col(g).cast("int").alias(f"i_{n}") for n, g in names.items()])


_GATES = {"dose": ["two_hour_open"], "kmax": ["surgery_open"], "n": []}
_DAILY_AGG = "SELECT entity, day, max(value) AS dose, max(k) AS kmax, count(*) AS n FROM f_point GROUP BY entity, day"


def gated_panel(x):
    daily = panel.daily_facts(x.point, {"dose": F.max("value"), "kmax": F.max("k"), "n": F.count("*")})
    return panel.apply_gates(panel.availability_gates(panel.attach_daily(x.calendar, daily)), _GATES)


_GATED = f"""
g AS (SELECT *, {_gate_sql('<').format(p='g_')} FROM f_calendar),
gp AS (SELECT g.entity, g.day, g.g_post, g.g_surgery, g.g_two_hour, CASE WHEN g_two_hour = 1 THEN d.dose END AS dose,
   CASE WHEN g_surgery = 1 THEN d.kmax END AS kmax, d.n FROM g LEFT JOIN ({_DAILY_AGG}) d USING (entity, day))"""


@query("pan_23", f"WITH {_GATED.strip()} SELECT entity, day, dose, kmax, n FROM gp")
def pan_23(x):
    return gated_panel(x).select(*K, "dose", "kmax", "n")


@query(
    "pan_24",
    f"""WITH {_GATED.strip()} SELECT entity, day,
 CASE WHEN g_two_hour = 1 AND g_surgery = 1 THEN {sr6('coalesce(dose, 0) + coalesce(kmax, 0)', 'x').rsplit(' AS ', 1)[0]} END AS mix,
 CASE WHEN g_surgery = 1 THEN CASE WHEN kmax IS NULL THEN 1 ELSE 0 END END AS k_missing FROM gp""",
)
def pan_24(x):
    derived = {
        "mix": (F.coalesce("dose", F.lit(0.0)) + F.coalesce("kmax", F.lit(0)), ["dose", "kmax"]),
        "k_missing": (F.col("kmax").isNull().cast("int"), ["kmax"]),
    }
    return r6(panel.derive(gated_panel(x), derived, _GATES).select(*K, "mix", "k_missing"), "mix")


_LANDMARKS = {"DOA0": "day - adm = 0", "DOA2": "day - adm = 2", "POD0": "rel = 0", "POD1": "rel = 1",
              "POD3": "rel = 3", "POD7": "rel = 7"}


@query(
    "pan_25",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS landmark, entity, day,
  CASE WHEN event > day AND event - idx <= 31 THEN 1 ELSE 0 END AS yB,
  CASE WHEN event > day AND event - day <= 30 THEN 1 ELSE 0 END AS yB30 FROM f_risk WHERE {c}"""
        for n, c in _LANDMARKS.items()
    ),
)
def pan_25(x):
    from tidemark.contract import LANDMARKS

    parts = [
        panel.landmark(x.risk, kind, k).select(F.lit(n).alias("landmark"), *K, "yB", "yB30")
        for n, (kind, k) in LANDMARKS.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _cumulative_sql(active: str) -> str:
    return f"""
SELECT entity, day, active, CAST(sum(CASE WHEN rel >= 0 THEN active ELSE 0 END) OVER w AS BIGINT) AS post_days,
  CAST(sum(CASE WHEN rel >= 0 THEN 1 - active ELSE 0 END) OVER w AS BIGINT) AS off_days,
  CAST(sum(CASE WHEN rel < 0 THEN active ELSE 0 END) OVER w AS BIGINT) AS pre_days
FROM (SELECT c.entity, c.day, c.rel, {active} AS active FROM f_calendar c) {_W}"""


_EOD = """CASE WHEN EXISTS (SELECT 1 FROM f_interval_daily i WHERE i.entity = c.entity
   AND (i.end_ts IS NULL OR i.end_ts >= i.start_ts) AND i.start_ts < c.day + 1
   AND (i.end_ts IS NULL OR i.end_ts >= c.day + 1)) THEN 1 ELSE 0 END"""


@query("pan_26", _cumulative_sql(_ACTIVE.format(extra="")))
def pan_26(x):
    out = intervals.union_day_totals(x.calendar, x.interval_daily, start="start_ts", end="end_ts")
    return longs(out.select(*K, "active", "post_days", "off_days", "pre_days"), "post_days", "off_days", "pre_days")


@query("pan_26_eod", _cumulative_sql(_EOD))
def pan_26_eod(x):
    out = intervals.union_day_totals(x.calendar, x.interval_daily, start="start_ts", end="end_ts", eod=True)
    return longs(out.select(*K, "active", "post_days", "off_days", "pre_days"), "post_days", "off_days", "pre_days")


@query("flt_01", "SELECT entity, day, rel, CAST(post AS INTEGER) AS post FROM f_risk")
def flt_01(x):
    return panel.risk_set(x.calendar).select(*K, "rel", F.col("post").cast("int").alias("post"))


@query(
    "flt_02",
    """
SELECT set, count(*) AS n, count(DISTINCT entity) AS entities FROM (
  SELECT entity, CASE WHEN ok AND g IN ('a', 'b', 'none') AND day - ix <= 10 THEN 'formal'
    WHEN ok AND g = 'c' AND day < ix THEN 'c_aux' WHEN ok AND g = 'd' AND day - ix <= 10 THEN 'd_window'
    WHEN ok AND g IN ('d', 'none') AND day - ix > 10 THEN 'late_aux' ELSE 'drop' END AS set
  FROM (SELECT *, site <> 3 AS ok, CASE WHEN event IS NULL THEN 'none' WHEN event < ix THEN 'c'
          WHEN event - ix <= 3 THEN 'b' WHEN event - ix <= 10 THEN 'a' ELSE 'd' END AS g
        FROM (SELECT *, idx - 3 AS ix FROM f_risk))) GROUP BY set""",
)
def flt_02(x):
    ix, ev = F.col("idx") - 3, F.col("event")
    g = (F.when(ev.isNull(), "none").when(ev < ix, "c").when(ev - ix <= 3, "b").when(ev - ix <= 10, "a")
         .otherwise("d"))
    s = panel.row_set(F.col("site") != 3, g, F.col("day"), ix, limit=10)
    return x.risk.select("entity", s.alias("set")).groupBy("set").agg(
        F.count("*").alias("n"), F.countDistinct("entity").alias("entities"))
