"""Calendar-window queries (WIN) with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import panel, windows
from tidemark.plans.catalog import query
from tidemark.plans.common import r6, sr6
from tidemark.plans.panel_queries import _DAILY_AGG, _gate_sql

K = ["entity", "day"]
FEATURES = ["dose", "kmax"]

# rows exist only on days with an event, so the windows have real gaps
_ROWS = f"""
WITH rows_ AS (SELECT g.entity, g.day, g.rel, g_surgery, d.n, CASE WHEN g_two_hour = 1 THEN d.dose END AS dose,
  CASE WHEN g_surgery = 1 THEN d.kmax END AS kmax
  FROM (SELECT *, {_gate_sql('<').format(p='g_')} FROM f_calendar) g JOIN ({_DAILY_AGG}) d
    ON d.entity = g.entity AND d.day = g.day)
"""


def window_rows(x):
    daily = panel.daily_facts(x.point, {"dose": F.max("value"), "kmax": F.max("k"), "n": F.count("*")})
    rows = panel.availability_gates(x.calendar.join(daily, K))
    gates = {"dose": ["two_hour_open"], "kmax": ["surgery_open"]}
    return panel.apply_gates(rows, gates).select(*K, "rel", "surgery_open", "n", *FEATURES)


def _slot_joins(w: int) -> str:
    return " ".join(f"LEFT JOIN rows_ l{i} ON l{i}.entity = r.entity AND l{i}.day = r.day - {i}" for i in range(w))


@query(
    "win_01",
    f"""{_ROWS}
SELECT r.entity, r.day, concat_ws(',', """
    + ", ".join(f"CASE WHEN l{i}.day IS NULL THEN '0' ELSE '1' END" for i in range(6, -1, -1))
    + ") AS observed, concat_ws(',', "
    + ", ".join(f"coalesce(CAST(l{i}.kmax AS VARCHAR), '-')" for i in range(6, -1, -1))
    + f") AS kmax_slots FROM rows_ r {_slot_joins(7)}",
)
def win_01(x):
    w = windows.calendar_windows(window_rows(x), FEATURES, window=7)
    return w.select(
        *K,
        F.array_join(F.transform("slots", lambda s: F.when(s.isNull(), "0").otherwise("1")), ",").alias("observed"),
        F.array_join(F.transform("slots", lambda s: F.coalesce(s["kmax"].cast("string"), F.lit("-"))), ",").alias(
            "kmax_slots"),
    )


@query(
    "win_02",
    f"{_ROWS} SELECT r.entity, r.day, "
    + ", ".join(f"l{i}.{f} AS {f}__lag{i}" for i in range(5) for f in FEATURES)
    + ", "
    + ", ".join(f"CASE WHEN l{i}.day IS NULL THEN 0 ELSE 1 END AS row_observed__lag{i}" for i in range(5))
    + ", CAST("
    + " + ".join(f"CASE WHEN l{i}.day IS NULL THEN 0 ELSE 1 END" for i in range(5))
    + f" AS INTEGER) AS window_observed_day_count FROM rows_ r {_slot_joins(5)}",
)
def win_02(x):
    w = windows.calendar_windows(window_rows(x), FEATURES, window=5)
    return windows.flat_window(w, FEATURES, window=5, keys=K)


def _summary_sql(f: str, w: int) -> str:
    vals = [f"CAST(l{i}.{f} AS DOUBLE)" for i in range(w)]
    old_first = ", ".join(reversed(vals))
    n = " + ".join(f"CASE WHEN {v} IS NULL THEN 0 ELSE 1 END" for v in vals)
    pairs = [f"{vals[i]} - {vals[i + 1]}" for i in range(w - 1)]
    n_pairs = " + ".join(f"CASE WHEN {p} IS NULL THEN 0 ELSE 1 END" for p in pairs)
    n_changed = " + ".join(f"CASE WHEN abs({p}) > 1e-6 THEN 1 ELSE 0 END" for p in pairs)
    total = " + ".join(f"coalesce({v}, 0e0)" for v in vals)
    return f"""{vals[0]} AS {f}__current,
  CASE WHEN {n} > 0 THEN {sr6(f'({total}) / ({n})', 'x').rsplit(' AS ', 1)[0]} END AS {f}__mean,
  least({old_first}) AS {f}__min, greatest({old_first}) AS {f}__max,
  CASE WHEN {n} > 1 THEN {sr6(f'coalesce({", ".join(vals)}) - coalesce({old_first})', 'x').rsplit(' AS ', 1)[0]} END AS {f}__delta,
  CASE WHEN {n_pairs} > 0 THEN {n_changed} END AS {f}__changes, {n} AS {f}__n_observed"""


@query(
    "win_03",
    f"{_ROWS} SELECT r.entity, r.day, {_summary_sql('dose', 7)}, {_summary_sql('kmax', 7)}, CAST("
    + " + ".join(f"CASE WHEN l{i}.day IS NULL THEN 0 ELSE 1 END" for i in range(7))
    + f" AS INTEGER) AS window_observed_day_count FROM rows_ r {_slot_joins(7)}",
)
def win_03(x):
    w = windows.calendar_windows(window_rows(x), FEATURES, window=7)
    out = windows.summary_window(w, FEATURES, keys=K)
    return r6(out, *[f"{f}__{s}" for f in FEATURES for s in ("mean", "delta")])


def _tensor_sql(i: int) -> str:
    v = ", ".join(f"CASE WHEN l{i}.day IS NULL THEN '0' ELSE coalesce(CAST(CAST(l{i}.{f} AS INTEGER) AS VARCHAR), '-') END"
                  for f in ("kmax", "n"))
    m = ", ".join(f"CASE WHEN l{i}.{f} IS NULL THEN '1' ELSE '0' END" for f in ("kmax", "n"))
    return f"concat_ws(',', {v}, {m}, CASE WHEN l{i}.day IS NULL THEN '0' ELSE '1' END)"


@query(
    "win_04",
    f"{_ROWS} SELECT r.entity, r.day, concat_ws('|', {', '.join(_tensor_sql(i) for i in (2, 1, 0))}) AS tensor "
    f"FROM rows_ r {_slot_joins(3)}",
)
def win_04(x):
    names = ["kmax", "n"]
    w = windows.calendar_windows(window_rows(x), names, window=3)
    t = windows.tensor_window(w, names, keys=K)
    text = lambda s: F.array_join(
        F.concat(
            F.transform(s["values"], lambda v: F.coalesce(v.cast("int").cast("string"), F.lit("-"))),
            F.transform(s["missing"], lambda m: m.cast("string")),
            F.array(s["row"].cast("string")),
        ),
        ",",
    )
    return t.select(*K, F.array_join(F.transform("tensor", text), "|").alias("tensor"))


@query(
    "val_21",
    "SELECT * FROM (VALUES ('padding', CAST(0 AS BIGINT)), ('missing_bits', 0), ('infinite', 0), ('width', 0),"
    " ('current_row', 0)) t(\"check\", n)",
)
def val_21(x):
    w = windows.calendar_windows(window_rows(x), FEATURES, window=7)
    return windows.check_windows(windows.tensor_window(w, FEATURES, keys=K), len(FEATURES))


_BIN_SQL = """CASE WHEN r.rel < 0 THEN 'pre' WHEN r.rel <= 2 THEN '0-2' WHEN r.rel <= 7 THEN '3-7'
  WHEN r.rel <= 14 THEN '8-14' WHEN r.rel <= 31 THEN '15-31' ELSE '>31' END"""


def rel_bin(rel="rel"):
    c = F.col(rel)
    return (F.when(c < 0, "pre").when(c <= 2, "0-2").when(c <= 7, "3-7").when(c <= 14, "8-14")
            .when(c <= 31, "15-31").otherwise(">31"))


@query(
    "win_05",
    f"""{_ROWS}
SELECT bin, count(*) AS rows, count(*) * 10 AS cells, CAST(sum((5 - days) * 2 + nulls) AS BIGINT) AS missing_with_padding,
  CAST(sum(nulls) AS BIGINT) AS missing_without_padding, CAST(sum(closed) AS BIGINT) AS gate_closed_cells, """
    + ", ".join(f"count(*) FILTER (days = {d}) AS days_{d}" for d in range(1, 6))
    + f" FROM (SELECT {_BIN_SQL} AS bin, "
    + " + ".join(f"(l{i}.day IS NOT NULL)::INT" for i in range(5))
    + " AS days, "
    + " + ".join(f"(l{i}.day IS NOT NULL AND l{i}.{f} IS NULL)::INT" for i in range(5) for f in FEATURES)
    + " AS nulls, "
    + " + ".join(f"CASE WHEN l{i}.day IS NOT NULL AND l{i}.g_surgery = 0 THEN 2 ELSE 0 END" for i in range(5))
    + f" AS closed FROM rows_ r {_slot_joins(5)}) GROUP BY bin",
)
def win_05(x):
    w = windows.calendar_windows(window_rows(x), FEATURES, window=5, carry=["surgery_open"])
    return windows.occupancy(w.withColumn("bin", rel_bin()), FEATURES, window=5, bin_col="bin", gate="surgery_open")


@query(
    "win_06",
    """SELECT entity, day, CAST(sum(n) OVER w AS BIGINT) AS events_so_far, max(n) OVER w AS busiest_so_far
FROM (SELECT entity, day, count(*) AS n FROM f_point GROUP BY entity, day)
WINDOW w AS (PARTITION BY entity ORDER BY day)""",
)
def win_06(x):
    daily = panel.daily_facts(x.point, {"n": F.count("*")})
    w = panel.up_to_day()
    return daily.select(*K, F.sum("n").over(w).alias("events_so_far"), F.max("n").over(w).alias("busiest_so_far"))


@query(
    "win_07",
    """SELECT p_type, p_brand, n, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS rank
FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL)""",
)
def win_07(x):
    counts = x.table("part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    return windows.descending_rank(counts, ["p_type"], "n", "p_brand").withColumn("rank", F.col("rank").cast("long"))


@query(
    "win_08",
    f"""{_ROWS} SELECT r.entity, r.day, CASE WHEN l.day IS NULL THEN 0 ELSE 1 END AS adjacent, l.n AS prev_n,
  l.kmax AS prev_kmax FROM rows_ r LEFT JOIN rows_ l ON l.entity = r.entity AND l.day = r.day - 1""",
)
def win_08(x):
    out = windows.previous_day(window_rows(x), ["n", "kmax"])
    return out.select(*K, F.col("adjacent").cast("int").alias("adjacent"), "prev_n", "prev_kmax")


@query(
    "win_09",
    """SELECT arm, probability, CAST(sum(p) OVER w AS BIGINT) AS cum_pos, CAST(sum(q) OVER w AS BIGINT) AS cum_neg FROM (
  SELECT arm, probability, sum(y) AS p, sum(1 - y) AS q FROM f_scores GROUP BY arm, probability)
WINDOW w AS (PARTITION BY arm ORDER BY probability)""",
)
def win_09(x):
    from tidemark.functions.ordered import running, value_block

    # an order's rows of one score are merged where they are, all others behind the one exchange by block
    g = x.scores.groupBy("stay", "arm", "probability").agg(
        F.sum(F.col("y").cast("long")).alias("p"), F.sum(1 - F.col("y").cast("long")).alias("q"))
    return running(g.drop("stay"), ["arm"], ["probability"], block=value_block("probability"), merge=True, tasks=x.tasks,
                   sums={"cum_pos": "p", "cum_neg": "q"}).select("arm", "probability", "cum_pos", "cum_neg")
