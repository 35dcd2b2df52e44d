"""Join (JOI), aggregate (AGG), sort (SRT) and set (SET) queries with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.ordered import exact_quantiles, weighted_quantiles
from tidemark.operators import aggregates, checks, cohort, intervals, metrics, panel
from tidemark.plans.catalog import query
from tidemark.plans.common import r6, sr6
from tidemark.plans.metric_sql import metrics_sql
from tidemark.session import materialize

K = ["entity", "day"]


@query("joi_01", f"SELECT o_orderpriority, count(*) AS n, {sr6('sum(l_quantity)', 'qty')} FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def joi_01(x):
    o = x.table("orders").withColumnRenamed("o_orderkey", "l_orderkey")
    out = x.table("lineitem").join(o, "l_orderkey", "left").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))
    return r6(out, "qty")


@query("joi_02", "SELECT o_orderkey, CASE WHEN l.k IS NULL THEN 'left_only' ELSE 'both' END AS match FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 49) l ON l.k = o_orderkey")
def joi_02(x):
    have = x.table("lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    out = checks.select_requested(have, x.table("orders").select("o_orderkey"), ["o_orderkey"])
    return out.select("o_orderkey", F.when(F.col("matched") == 1, "both").otherwise("left_only").alias("match"))


@query("joi_03", """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' WHEN a.k IS NULL THEN 'right' ELSE 'both' END AS side
FROM (SELECT l_orderkey AS k FROM lineitem GROUP BY 1 HAVING count(*) > 4) a FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 250000) b ON a.k = b.k""")
def joi_03(x):
    a = x.table("lineitem").groupBy(F.col("l_orderkey").alias("k")).count().where("count > 4").select("k", F.lit(1).alias("a"))
    b = x.table("orders").where("o_totalprice > 250000").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("b"))
    side = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").otherwise("both")
    return a.join(b, "k", "full_outer").select("k", side.alias("side"))


@query("joi_04", "SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 0 AND o_orderstatus = 'O' GROUP BY c_custkey")
def joi_04(x):
    c = x.table("customer").where("c_acctbal > 0").select(F.col("c_custkey"))
    o = x.table("orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey").groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("joi_05", """SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)
UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""")
def joi_05(x):
    c = x.table("customer").select("c_custkey")
    o = x.table("orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return aggregates.union_all([c.join(o, "c_custkey", f"left_{k}").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k in ("semi", "anti")])


@query("joi_06", """SELECT c.entity, c.day, p.value AS value_last FROM f_calendar c ASOF LEFT JOIN (SELECT entity, serial, value FROM f_point WHERE kind = 'purchase') p
 ON p.entity = c.entity AND p.serial < c.day + 1""")
def joi_06(x):
    out = panel.last_observed(x.calendar, x.point.where("kind = 'purchase'"), ["value"], tie="event_id")
    return out.select(*K, "value_last")


@query("joi_07", """SELECT c.entity, c.day, count(i.rec) AS open_records FROM f_calendar c LEFT JOIN f_interval_daily i ON i.entity = c.entity AND end_ts >= start_ts
 AND c.day BETWEEN floor(start_ts) AND floor(end_ts) GROUP BY c.entity, c.day""")
def joi_07(x):
    """Day-in-interval join, counted from start and end changes."""
    closed = x.interval_daily.where("end_ts is not null")
    changes = intervals.day_changes(closed, "start_ts", "end_ts", {"g": F.lit(True)})
    out = intervals.running_counts(x.calendar, changes, ["g"], "entity", "day")
    return out.select(*K, (F.col("g__cs") - F.col("g__cp")).alias("open_records"))


_PAIRS_SQL = """SELECT k.relation, count(p.rel) AS pairs, count(DISTINCT p.entity) AS entities FROM
 (SELECT unnest(['identical_interval', 'strict_overlap', 'equal_boundary', 'zero_length_inside', 'disjoint']) AS relation) k LEFT JOIN (
 SELECT a.entity, CASE WHEN a.s = b.s AND a.e = b.e THEN 'identical_interval' WHEN greatest(a.s, b.s) < least(a.e, b.e) THEN 'strict_overlap'
   WHEN a.e = b.s OR b.e = a.s THEN 'equal_boundary' WHEN greatest(a.s, b.s) = least(a.e, b.e) THEN 'zero_length_inside' ELSE 'disjoint' END AS rel
 FROM v a JOIN v b ON a.entity = b.entity AND a.rn < b.rn) p ON p.rel = k.relation GROUP BY k.relation"""


@query("joi_08", f"""WITH v AS (SELECT entity, floor(start_ts) AS s, floor(end_ts) AS e, row_number() OVER () AS rn FROM f_interval_daily WHERE end_ts >= start_ts) {_PAIRS_SQL}""")
def joi_08(x):
    """Theta self-join of records within an entity, answered from boundary counts."""
    d = x.interval_daily.select("entity", F.floor("start_ts").alias("s"), F.when(F.col("end_ts") >= F.col("start_ts"), F.floor("end_ts")).alias("e"))
    return intervals.pair_relations(d, "s", "e")


@query("joi_09", f"""SELECT l_orderkey, l_linenumber, {sr6('coalesce(r.rate, 0.5)', 'rate')} FROM f_lines LEFT JOIN (SELECT p_partkey, avg(p_size) / 50 AS rate FROM part
 WHERE p_size > 20 GROUP BY 1) r ON p_partkey = l_partkey""")
def joi_09(x):
    r = x.table("part").where("p_size > 20").groupBy(F.col("p_partkey").alias("l_partkey")).agg((F.avg("p_size") / 50).alias("rate"))
    return r6(x.lines.join(r, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("rate", F.lit(0.5)).alias("rate")), "rate")


@query("joi_10", """SELECT a.entity, a.day, b.n AS n_lag3 FROM (SELECT DISTINCT entity, day FROM f_point) a LEFT JOIN
 (SELECT entity, day, count(*) AS n FROM f_point GROUP BY ALL) b ON b.entity = a.entity AND b.day = a.day - 3""")
def joi_10(x):
    from tidemark.operators.windows import calendar_windows

    d = x.point.groupBy("entity", "day").agg(F.count("*").alias("n"))
    return calendar_windows(d, ["n"], window=4).select(*K, F.col("slots")[0]["n"].alias("n_lag3"))


_FIRST = """fe AS (SELECT entity, min(d) AS first_event, max(CASE WHEN d IS NULL THEN 1 ELSE 0 END) AS u FROM
 (SELECT entity, CASE WHEN k <> 9 THEN day END AS d FROM f_point WHERE kind = 'error' AND value > 100) GROUP BY entity),
 en AS (SELECT a.entity, f.first_event, coalesce(f.u, 0) AS u FROM f_anchors a LEFT JOIN fe f USING (entity) WHERE a.site <> 5)"""


def event_entities(x):
    d = F.when(F.col("k") != 9, F.col("day"))
    f = x.point.where("kind = 'error' and value > 100").groupBy("entity").agg(F.min(d).alias("first_event"), F.max(d.isNull().cast("int")).alias("undated_event"))
    return x.anchors.where("site <> 5").join(f, "entity", "left").withColumn("undated_event", F.coalesce("undated_event", F.lit(0)))


_ORDER = """CASE WHEN en.entity IS NULL THEN 'unlinked' WHEN {d} IS NULL THEN 'date_missing' WHEN u = 1 THEN 'event_date_incomplete'
  WHEN first_event IS NULL THEN 'no_event' WHEN {d} < first_event THEN 'before_event' WHEN {d} = first_event THEN 'same_day_ambiguous' ELSE 'after_event' END"""


@query("joi_11", f"WITH {_FIRST} SELECT i.rec, {_ORDER.format(d='floor(i.end_ts)')} AS order_class FROM f_interval_daily i LEFT JOIN en ON en.entity = i.entity")
def joi_11(x):
    e = event_entities(x).select("entity", "first_event", "undated_event", F.lit(True).alias("in_"))
    d, f = F.floor("end_ts"), F.col("first_event")
    k = (F.when(F.col("in_").isNull(), "unlinked").when(d.isNull(), "date_missing").when(F.col("undated_event") == 1, "event_date_incomplete")
         .when(f.isNull(), "no_event").when(d < f, "before_event").when(d == f, "same_day_ambiguous").otherwise("after_event"))
    return x.interval_daily.join(e, "entity", "left").select("rec", k.alias("order_class"))


_STAGE = """SELECT repeat, phase, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positive_rows, CAST(sum(1 - y) AS BIGINT) AS negative_rows, count(DISTINCT stay) AS entities,
  count(DISTINCT CASE WHEN "case" = 1 THEN stay END) AS case_entities, count(DISTINCT CASE WHEN "case" = 0 THEN stay END) AS control_entities,
  count(DISTINCT CASE WHEN y = 1 THEN stay END) AS positive_entities, count(DISTINCT CASE WHEN y = 0 THEN stay END) AS negative_entities"""


@query("agg_01", f"""{_STAGE}, {sr6("CASE WHEN phase = 'total' THEN sum(CASE WHEN pod < 0 THEN 1 - y ELSE 0 END) / sum(1 - y) END", 'pre_negative_fraction')} FROM (
 SELECT *, CASE WHEN pod >= 0 THEN 'post' ELSE 'pre' END AS phase FROM f_targets UNION ALL SELECT *, 'total' FROM f_targets) GROUP BY repeat, phase""")
def agg_01(x):
    return r6(aggregates.stage_counts(x.targets, by=["repeat"]), "pre_negative_fraction")


@query("agg_02", """SELECT o_custkey, max(CAST(o_orderstatus = 'F' AS INTEGER)) AS label, any_value(CAST(o_custkey % 9 AS BIGINT)) AS static FROM orders GROUP BY 1""")
def agg_02(x):
    o = x.table("orders").withColumn("static", F.col("o_custkey") % 9)
    lab = o.groupBy("o_custkey").agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("label"))
    return lab.join(aggregates.first_value(o, "o_custkey", ["static"]), "o_custkey")


@query("agg_03", """SELECT unnest(['o_orderstatus', 'site']) AS "column", unnest([count(*) FILTER (a > 1), count(*) FILTER (b > 1)]) AS n FROM (
 SELECT count(DISTINCT o_orderstatus) AS a, count(DISTINCT o_custkey % 9) AS b FROM orders GROUP BY o_custkey)""")
def agg_03(x):
    return aggregates.inconsistent_groups(x.table("orders").withColumn("site", F.col("o_custkey") % 9), "o_custkey", ["o_orderstatus", "site"])


@query("agg_04", f"""SELECT kind, count(*) AS n, {sr6('quantile_cont(value, 0.25)', 'q1')}, {sr6('quantile_cont(value, 0.5)', 'median')}, {sr6('quantile_cont(value, 0.75)', 'q3')},
 {sr6('quantile_cont(value, 0.975)', 'p975')} FROM f_point GROUP BY kind""")
def agg_04(x):
    return r6(exact_quantiles(x.point, ["kind"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75, "p975": 0.975}), "q1", "median", "q3", "p975")


@query("agg_05", """SELECT kind, min(CASE WHEN c >= 0.25 * t THEN value END) AS q1, min(CASE WHEN c >= 0.5 * t THEN value END) AS median, min(CASE WHEN c >= 0.9 * t THEN value END) AS p90, max(t) AS total_weight
FROM (SELECT kind, value, CAST(sum(k) OVER (PARTITION BY kind ORDER BY value) AS BIGINT) AS c, CAST(sum(k) OVER (PARTITION BY kind) AS BIGINT) AS t FROM f_point) GROUP BY kind""")
def agg_05(x):
    return weighted_quantiles(x.point, ["kind"], "value", "k", {"q1": 0.25, "median": 0.5, "p90": 0.9})


@query("agg_06", "SELECT kind, k AS value, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY kind) AS BIGINT) AS denominator FROM f_point GROUP BY kind, k")
def agg_06(x):
    return aggregates.frequency(x.point, F.col("k"), by=["kind"])


@query("agg_07", """SELECT unnest(['big', 'late']) AS metric, unnest([count(*) FILTER (value > 100), count(*) FILTER (kind = 'view' AND k > 50)]) AS n,
 unnest([count(*), count(*) FILTER (kind = 'view')]) AS denominator FROM f_point""")
def agg_07(x):
    return aggregates.count_with_denominator(x.point, {"big": (F.lit(True), F.col("value") > 100), "late": (F.col("kind") == "view", F.col("k") > 50)})


@query("agg_08", f"""SELECT l_suppkey, n, CASE WHEN n >= 600 THEN {sr6('q1', 'x').rsplit(' AS ', 1)[0]} END AS q1, CASE WHEN n >= 600 THEN {sr6('m', 'x').rsplit(' AS ', 1)[0]} END AS median,
 CASE WHEN n >= 600 THEN {sr6('q3', 'x').rsplit(' AS ', 1)[0]} END AS q3 FROM (SELECT l_suppkey, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS m,
 quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)""")
def agg_08(x):
    return r6(aggregates.suppressed_quartiles(x.table("lineitem"), ["l_suppkey"], "l_extendedprice", minimum=600), "q1", "median", "q3")


@query("agg_09", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS \"l_linestatus_O\", count(*) FILTER (l_linestatus = 'F') AS \"l_linestatus_F\", count(*) AS total FROM lineitem GROUP BY 1")
def agg_09(x):
    return aggregates.cross_tab(x.table("lineitem"), "l_returnflag", "l_linestatus", ["O", "F"])


# one repeat is undefined in one cell: only negatives survive there
_REP = f"""(SELECT repeat, bin, auc FROM ({metrics_sql("(SELECT *, CASE WHEN pod < 0 THEN 'pre' ELSE 'post' END AS bin FROM f_scores WHERE arm = 'ties' AND NOT (repeat = 3 AND pod < 0 AND y = 1))", "repeat, bin")}))"""


def _rep(x):
    s = x.scores.where("arm = 'ties' and not (repeat = 3 and pod < 0 and y = 1)").withColumn("bin", F.when(F.col("pod") < 0, "pre").otherwise("post"))
    return metrics.rank_metrics(s, ["repeat", "bin"])


@query("agg_10", f"SELECT bin, CASE WHEN count(auc) = count(*) THEN {sr6('avg(auc)', 'x').rsplit(' AS ', 1)[0]} END AS auc FROM {_REP} GROUP BY bin")
def agg_10(x):
    return r6(aggregates.equal_repeat_mean(_rep(x), ["bin"], ["auc"]), "auc")


@query("agg_11", f"SELECT bin, {sr6('avg(auc)', 'auc')} FROM {_REP} GROUP BY bin")
def agg_11(x):
    return r6(aggregates.equal_repeat_mean(_rep(x), ["bin"], ["auc"], skip_null=True), "auc")


@query("agg_12", f"SELECT p_type, p_brand, {sr6('v / sum(v) OVER (PARTITION BY p_type)', 'share')} FROM (SELECT p_type, p_brand, sum(p_retailprice) AS v FROM part GROUP BY ALL)")
def agg_12(x):
    g = x.table("part").groupBy("p_type", "p_brand").agg(F.sum("p_retailprice").alias("v"))
    return r6(aggregates.normalised_share(g, ["p_type"], "v").drop("v"), "share")


@query("srt_01", f"SELECT p_name, {sr6('sum(l_extendedprice)', 'gain')} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name ORDER BY sum(l_extendedprice) DESC, p_name LIMIT 50")
def srt_01(x):
    g = x.table("lineitem").join(x.table("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_name").agg(F.sum("l_extendedprice").alias("gain"))
    return r6(aggregates.top_k(g, "gain", "p_name", 50), "gain")


@query("srt_02", """SELECT entity, start_day, count(*) AS n_tied, min(rec) AS rec FROM f_interval i WHERE start_day = (SELECT min(start_day) FROM f_interval j WHERE j.entity = i.entity) GROUP BY entity, start_day""")
def srt_02(x):
    return aggregates.first_interval(x.interval, entity="entity", start="start_day", carry=["rec"])


@query("srt_03", f"""WITH b AS (SELECT p_brand, p_type, avg(p_retailprice) / 10000 AS score, count(*) AS size FROM part GROUP BY ALL)
SELECT p_brand, p_type, {sr6('score', 'score')}, size FROM b WHERE (SELECT max(score) FROM b) - score <= 0.002 ORDER BY size, p_type, p_brand LIMIT 1""")
def srt_03(x):
    b = x.table("part").groupBy("p_brand", "p_type").agg((F.avg("p_retailprice") / 10000).alias("score"), F.count("*").alias("size"))
    return r6(aggregates.choose_arm(b, score="score", tie_break=["size", "p_type", "p_brand"]), "score")


@query("set_01", """SELECT stream, count(*) AS n, count(DISTINCT k) AS keys FROM (SELECT 'o' AS stream, o_custkey AS k FROM orders UNION ALL SELECT 'e', user_id FROM events UNION ALL SELECT 'c', c_custkey FROM customer) GROUP BY stream""")
def set_01(x):
    u = aggregates.union_all([x.table("orders").select(F.lit("o").alias("stream"), F.col("o_custkey").alias("k")), x.table("events").select(F.lit("e").alias("stream"), F.col("user_id").alias("k")),
                              x.table("customer").select(F.lit("c").alias("stream"), F.col("c_custkey").alias("k"))])
    return u.groupBy("stream").agg(F.count("*").alias("n"), F.countDistinct("k").alias("keys"))


@query("set_02", "SELECT repeat, stay FROM f_targets WHERE pod < 0 INTERSECT SELECT repeat, stay FROM f_targets WHERE pod >= 3")
def set_02(x):
    t = x.targets
    return t.where("pod < 0").select("repeat", "stay").intersect(t.where("pod >= 3").select("repeat", "stay"))


@query("set_03", "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_03(x):
    o = x.table("orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return aggregates.missing_keys(o.where("o_orderstatus = 'O'").select("k"), o.where("o_orderstatus = 'F'").select("k"))


@query("set_04", """WITH a AS (SELECT entity, day, count(*) AS n FROM f_point GROUP BY ALL), b AS (SELECT entity, day, count(*) FILTER (value < 300) AS n FROM f_point GROUP BY ALL)
SELECT (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) AS only_left, (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) AS only_right""")
def set_04(x):
    a = x.point.groupBy("entity", "day").agg(F.count("*").alias("n"))
    b = x.point.groupBy("entity", "day").agg(F.count_if(F.col("value") < 300).alias("n"))
    return aggregates.same_rows(a, b)


# --- cohort audits (CAU) ---


@query("cau_01", f"""WITH v AS (SELECT entity, start_day AS s, end_day AS e, row_number() OVER () AS rn FROM f_interval WHERE end_day >= start_day) {_PAIRS_SQL}""")
def cau_01(x):
    return intervals.pair_relations(x.interval, "start_day", "end_day")


@query("cau_01_excluded", """SELECT CASE WHEN end_day IS NULL THEN 'missing_or_invalid_end' WHEN end_day < start_day THEN 'reverse_interval' ELSE 'valid' END AS reason, count(*) AS n FROM f_interval GROUP BY 1""")
def cau_01_excluded(x):
    return intervals.excluded_records(x.interval, "start_day", "end_day")


@query("cau_02", f"""WITH {_FIRST} SELECT order_class, count(*) AS rows, count(DISTINCT entity) AS entities FROM (
 SELECT i.entity, {_ORDER.format(d='floor(i.end_ts)')} AS order_class FROM f_interval_daily i LEFT JOIN en ON en.entity = i.entity) GROUP BY 1""")
def cau_02(x):
    rec = x.interval_daily.withColumn("d", F.floor("end_ts"))
    return cohort.event_order(rec, event_entities(x), day="d")


_C03 = {
    "linked_rows": ("TRUE", "l"), "reverse_interval": ("l AND e IS NOT NULL", "e < s"), "zero_duration": ("l AND e IS NOT NULL", "e = s"),
    "start_before_start_anchor": ("l", "floor(s) < adm"), "end_after_end_anchor": ("l AND e IS NOT NULL", "floor(e) > dis"),
    "end_on_end_anchor_day": ("l AND e IS NOT NULL", "floor(e) = dis"), "start_equals_arrival_time": ("l", "s = icu"), "start_on_arrival_day": ("l", "floor(s) = floor(icu)"),
    "spanning_index_day": ("l AND NOT coalesce(e < s, FALSE)", "floor(s) <= idx AND (e IS NULL OR floor(e) >= idx)"),
}


@query("cau_03", "WITH j AS (SELECT i.start_ts AS s, i.end_ts AS e, a.*, a.entity IS NOT NULL AS l FROM f_interval_daily i LEFT JOIN (SELECT * FROM f_anchors WHERE site <> 5) a ON a.entity = i.entity) "
       + " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) FILTER (({d}) AND ({h})) AS n, count(*) FILTER ({d}) AS denominator FROM j" for m, (d, h) in _C03.items()))
def cau_03(x):
    return cohort.interval_audit(x.interval_daily, x.anchors.where("site <> 5"), start="start_ts", end="end_ts")


@query("cau_03_frequency", """WITH a AS (SELECT * FROM f_anchors WHERE site <> 5), j AS (SELECT CAST(floor(end_ts) - idx AS BIGINT) AS r, floor(start_ts) <= idx AS sp FROM f_interval_daily JOIN a USING (entity) WHERE end_ts >= start_ts),
 t AS (SELECT 'records_per_entity' AS "table", coalesce(c, 0) AS value FROM a LEFT JOIN (SELECT entity, count(*) AS c FROM f_interval_daily GROUP BY 1) USING (entity) UNION ALL
  SELECT 'end_rel_day_post', r FROM j WHERE r >= 0 UNION ALL SELECT 'end_rel_day_spanning', r FROM j WHERE r >= 0 AND sp)
SELECT "table", value, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY "table") AS BIGINT) AS denominator FROM t GROUP BY "table", value""")
def cau_03_frequency(x):
    return cohort.interval_frequencies(x.interval_daily, x.anchors.where("site <> 5"), start="start_ts", end="end_ts")


_C04 = """WITH v AS (SELECT i.entity, floor(start_ts * 2) / 2 AS s, floor(end_ts * 2) / 2 AS e, rec FROM f_interval_daily i JOIN f_anchors USING (entity) WHERE floor(end_ts * 2) >= floor(start_ts * 2)),
 o AS (SELECT v.*, idx, dis, event, (SELECT min(w.s) FROM v w WHERE w.entity = v.entity AND w.s > v.e) AS nx,
   EXISTS (SELECT 1 FROM v w WHERE w.entity = v.entity AND w.s < v.e AND v.e < w.e) AS ov,
   EXISTS (SELECT 1 FROM v w WHERE w.entity = v.entity AND w.s = v.e AND NOT (w.s = v.s AND w.e = v.e)) AS eq
  FROM v JOIN f_anchors USING (entity) WHERE floor(v.e) BETWEEN idx AND dis),
 p AS (SELECT o.*, pop.population, h.horizon, coalesce(nx - e <= horizon, FALSE) AS hit, e + horizon < dis AS fu FROM o,
  (SELECT unnest(['all', 'no_boundary_or_overlap', 'before_event']) AS population) pop, (SELECT CAST(unnest([2, 7]) AS INTEGER) AS horizon) h
  WHERE population = 'all' OR (floor(e) <> dis AND NOT ov AND (population = 'no_boundary_or_overlap' OR event IS NULL OR floor(e) < event)))
SELECT population, horizon, count(*) AS ends, count(*) FILTER (hit) AS observed_restart, count(*) FILTER (fu) AS complete_followup, count(*) FILTER (hit AND fu) AS restart_in_complete,
 count(*) FILTER (NOT hit AND NOT fu) AS truncated_unknown, count(*) FILTER (eq) AS equal_time, count(*) FILTER (ov) AS open_across FROM p GROUP BY ALL"""


@query("cau_04", _C04)
def cau_04(x):
    half = lambda c: F.floor(F.col(c) * 2) / 2
    rec = x.interval_daily.select("entity", half("start_ts").alias("s"), half("end_ts").alias("e"))
    first = x.anchors.select("entity", F.col("event").alias("first_event"))
    return cohort.restarts(rec, x.anchors, first, start="s", end="e")


_C05 = f"""{_FIRST}, ea AS (SELECT a.*, first_event, u FROM f_anchors a JOIN en USING (entity)),
 d AS (SELECT entity, floor(start_ts) AS s, floor(end_ts) AS e FROM f_interval_daily),
 cand AS (SELECT d.* FROM d JOIN ea USING (entity) WHERE (e IS NULL OR e >= s) AND s BETWEEN adm AND dis AND (e IS NULL OR e >= idx) AND greatest(idx, s) < dis),
 fi AS (SELECT entity, s, count(*) AS t, min(e) AS e FROM cand WHERE s = (SELECT min(c2.s) FROM cand c2 WHERE c2.entity = cand.entity) GROUP BY entity, s),
 sel AS (SELECT h.entity, ea.site, ea.adm, ea.idx, ea.dis, ea.first_event, ea.u, fi.s AS start_day, fi.e AS end_day, greatest(ea.idx, fi.s) AS t0,
  CASE WHEN ea.entity IS NULL THEN 'unlinked' WHEN fi.s IS NULL THEN 'no_valid_post_interval' WHEN t > 1 THEN 'tied_first_start' WHEN u = 1 THEN 'undated'
   WHEN first_event <= greatest(ea.idx, fi.s) THEN 'event_on_or_before_entry' ELSE 'eligible' END AS reason
  FROM (SELECT DISTINCT entity FROM d) h LEFT JOIN ea USING (entity) LEFT JOIN fi USING (entity))"""


def selected(x):
    return cohort.select_first_interval(x.interval_daily, event_entities(x), start="start_ts", end="end_ts")


@query("cau_05", f"WITH {_C05} SELECT reason, count(*) AS n FROM sel GROUP BY reason")
def cau_05(x):
    return selected(x).groupBy("reason").agg(F.count("*").alias("n"))


@query("cau_05_timing", f"""WITH {_C05}, oc AS (SELECT site, end_day - idx AS r, CASE WHEN end_day IS NULL THEN 'no_end' WHEN end_day >= dis THEN 'boundary' WHEN end_day = first_event THEN 'event_day'
   WHEN end_day > first_event THEN 'after_event' ELSE 'observed' END AS o FROM sel WHERE reason = 'eligible')
SELECT site, count(*) AS eligible, {", ".join(f"count(*) FILTER (o = '{k}') AS {k}" for k in ('observed', 'no_end', 'boundary', 'event_day', 'after_event'))},
 {", ".join(f"CASE WHEN count(*) FILTER (o = 'observed') >= 20 THEN round(quantile_cont(CASE WHEN o = 'observed' THEN CAST(r AS DOUBLE) END, {q}), 6) + 0e0 END AS {n}" for n, q in (('q1', 0.25), ('median', 0.5), ('q3', 0.75)))}
FROM oc GROUP BY site""")
def cau_05_timing(x):
    return r6(cohort.end_timing_by_site(selected(x)), "q1", "median", "q3")


@query("cau_06", """SELECT CASE WHEN fc < s THEN 'reopened_after_closure' WHEN fc = s THEN 'same_time_ambiguous' ELSE 'no_prior_closure' END AS reopen_class, count(*) AS n FROM (
 SELECT entity, start_day AS s, min(CASE WHEN kind = 'R' THEN end_day END) OVER w AS fc, count(*) OVER w AS c FROM f_interval
 WINDOW w AS (PARTITION BY entity ORDER BY start_day, rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE c > 0 GROUP BY 1""")
def cau_06(x):
    u = x.interval
    return cohort.reopenings(u, opened="start_day", closed="end_day", closed_flag=F.col("kind") == "R", record="rec")


@query("cau_06_flags", "SELECT status AS flag, CAST(end_day IS NOT NULL AS INTEGER) AS dated, count(*) AS n FROM f_interval GROUP BY ALL")
def cau_06_flags(x):
    return cohort.flag_date_consistency(x.interval, flag="status", date="end_day")


@query("cau_07", """SELECT unnest(['known_binary', 'finite_non_negative', 'positive']) AS metric, unnest([count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')), count(*) FILTER (c_acctbal >= 0),
 count(*) FILTER (c_acctbal > 0)]) AS n, unnest([count(*), count(*), count(*)]) AS denominator FROM customer""")
def cau_07(x):
    t = F.lit(True)
    return aggregates.count_with_denominator(x.table("customer"), {"known_binary": (t, F.col("c_mktsegment").isin("BUILDING", "MACHINERY")),
                                                                   "finite_non_negative": (t, F.col("c_acctbal") >= 0), "positive": (t, F.col("c_acctbal") > 0)})


_ELIG = """CASE WHEN NOT (adm <= idx AND idx <= {d} AND {d} <= dis) THEN 'absent' WHEN u = 1 THEN 'undated' WHEN {p} THEN 'known_before'
  WHEN first_event < {d} THEN 'too_late' END"""


@query("cau_08", f"""WITH {_FIRST} SELECT c.entity, c.day, coalesce({_ELIG.format(d='c.day', p='c.site = 7')}, 'eligible') AS reason FROM f_calendar c JOIN en USING (entity)""")
def cau_08(x):
    e = event_entities(x).select("entity", "first_event", "undated_event")
    c = x.calendar.join(e, "entity").withColumn("prior_flag", (F.col("site") == 7).cast("int"))
    return c.select(*K, F.coalesce(cohort.eligibility(F.col("day")), F.lit("eligible")).alias("reason"))


_GRID = f"""{_C05}, g AS (SELECT s.*, CAST(rel_day AS INTEGER) AS rel_day, CAST(grace AS INTEGER) AS grace, idx + rel_day AS dd, idx + rel_day + grace - 1 AS ld
   FROM sel s, (SELECT unnest(range(1, 8)) AS rel_day), (SELECT unnest([1, 2]) AS grace) WHERE reason = 'eligible'),
 x AS (SELECT *, coalesce({_ELIG.format(d='dd', p='site = 7')}, CASE WHEN start_day >= dd THEN 'start_later' WHEN end_day < dd THEN 'over' END) AS exclusion FROM g),
 w AS (SELECT *, CASE WHEN exclusion IS NULL THEN CASE WHEN first_event BETWEEN dd AND ld THEN 'cut_by_event' WHEN dis <= ld THEN 'cut_by_exit' WHEN end_day IS NULL THEN 'open' END END AS unknown FROM x),
 ch AS (SELECT *, CASE WHEN exclusion IS NULL AND unknown IS NULL THEN CASE WHEN end_day <= ld THEN 1 ELSE 0 END END AS arm_a FROM w)"""


def cohort_grid(x):
    s = selected(x).where("reason = 'eligible'").withColumn("prior_flag", (F.col("site") == 7).cast("int"))
    return cohort.interval_cohort(s, rel_days=range(1, 8), graces=(1, 2))


@query("cau_09", f"""WITH {_GRID} SELECT rel_day, grace, event_class, count(*) AS n FROM (SELECT rel_day, grace, CASE WHEN first_event IS NULL OR first_event < dd OR first_event > idx + 31 THEN NULL WHEN first_event > dis THEN 'after_end'
 WHEN first_event = dd THEN 'same_decision_day' WHEN first_event = dis THEN 'same_end_day' ELSE 'strictly_after' END AS event_class FROM ch WHERE exclusion IS NULL) WHERE event_class IS NOT NULL GROUP BY ALL""")
def cau_09(x):
    return cohort.event_inventory(cohort_grid(x).where("exclusion is null"), day="decision", by=["rel_day", "grace"])


@query("cau_10", f"WITH {_GRID} SELECT rel_day, grace, unknown, count(*) AS n FROM ch WHERE unknown IS NOT NULL GROUP BY ALL")
def cau_10(x):
    return cohort_grid(x).where("unknown is not null").groupBy("rel_day", "grace", "unknown").agg(F.count("*").alias("n"))


_COUNTS = """count(*) AS source, count(exclusion) AS excluded, count(*) FILTER (exclusion IS NULL) AS entries, count(*) FILTER (arm_a = 1) AS a, count(*) FILTER (arm_a = 0) AS b, count(unknown) AS unknown"""


@query("cau_11", f"WITH {_GRID} SELECT rel_day, grace, {_COUNTS} FROM ch GROUP BY ALL")
def cau_11(x):
    return cohort.cohort_counts(cohort_grid(x))


_POINT = f"""{_FIRST}, nom AS (SELECT entity, count(*) AS c, min(serial) AS t, min(value) AS v, min(entity % 12 + CASE WHEN k > 90 THEN 1 ELSE 0 END) AS enc FROM f_point WHERE kind = 'view' AND day = (SELECT floor(icu + 1) FROM f_anchors a WHERE a.entity = f_point.entity) GROUP BY entity),
 pj AS (SELECT a.*, first_event, u, icu + 1 AS stamp, CAST(floor(icu + 1) AS INTEGER) AS dd, n.c, n.t, n.v, n.enc FROM f_anchors a JOIN en USING (entity) LEFT JOIN nom n USING (entity)),
 px AS (SELECT *, {_ELIG.format(d='dd', p='site = 7')} AS exclusion FROM pj),
 pw AS (SELECT *, CASE WHEN exclusion IS NULL THEN CASE WHEN first_event = dd THEN 'cut_by_event' WHEN dis <= dd THEN 'cut_by_exit' WHEN c IS NULL THEN 'nominal_missing' WHEN c > 1 THEN 'nominal_duplicate'
    WHEN abs(t - stamp) > 0.5 OR enc <> site THEN 'time_or_encounter_mismatch' END END AS unknown FROM px)"""


def point_cohort(x):
    e = event_entities(x).withColumn("prior_flag", (F.col("site") == 7).cast("int"))
    r = x.point.where("kind = 'view'").withColumn("enc", F.col("entity") % 12 + F.when(F.col("k") > 90, 1).otherwise(0))
    want = x.anchors.select("entity", F.floor(F.col("icu") + 1).alias("nd"))
    r = r.join(want, "entity")
    return cohort.point_cohort(e, r, hours=24.0, time="serial", nominal=F.col("day") == F.col("nd"), value="value", encounter=("site", "enc"), tolerance=0.5)


@query("cau_12", f"""WITH {_POINT} SELECT dd - idx AS rel_day, count(*) AS source, count(exclusion) AS excluded, count(*) FILTER (exclusion IS NULL) AS entries,
 count(*) FILTER (exclusion IS NULL AND unknown IS NULL AND v > 0) AS a, count(*) FILTER (exclusion IS NULL AND unknown IS NULL AND v = 0) AS b, count(unknown) AS unknown FROM pw GROUP BY 1""")
def cau_12(x):
    return cohort.cohort_counts(point_cohort(x), by=["rel_day"])


_PS = """(SELECT rel_day, grace, arm_a AS a, entity, 0.1e0 + 0.8e0 * ((entity * 7 + rel_day) % 10) / 10 AS p FROM ch WHERE arm_a IS NOT NULL)"""


@query("cau_13", f"""WITH {_GRID}, z AS (SELECT *, CASE WHEN a = 1 THEN q / p ELSE (1 - q) / (1 - p) END AS w FROM (SELECT *, avg(a) OVER (PARTITION BY rel_day, grace) AS q FROM {_PS}))
SELECT rel_day, grace, CASE WHEN ok THEN 'fitted' ELSE 'too_small' END AS status, n, n_a, n_b, p_low, p_high, {", ".join(f"CASE WHEN ok THEN round({c}, 6) + 0e0 END AS {c}" for c in ('ess', 'ess_a', 'ess_b', 'weight_max', 'p_q05', 'p_q25', 'p_q50', 'p_q75', 'p_q95'))} FROM (
 SELECT rel_day, grace, count(*) AS n, count(*) FILTER (a = 1) AS n_a, count(*) FILTER (a = 0) AS n_b, count(*) FILTER (p < 0.05) AS p_low, count(*) FILTER (p > 0.95) AS p_high, sum(w) ** 2 / sum(w * w) AS ess,
  sum(w) FILTER (a = 1) ** 2 / sum(w * w) FILTER (a = 1) AS ess_a, sum(w) FILTER (a = 0) ** 2 / sum(w * w) FILTER (a = 0) AS ess_b, max(w) AS weight_max, {', '.join(f'quantile_cont(p, {q}) AS p_q{n}' for q, n in ((0.05, '05'), (0.25, '25'), (0.5, '50'), (0.75, '75'), (0.95, '95')))}, count(*) >= 30 AND least(count(*) FILTER (a = 1), count(*) FILTER (a = 0)) >= 5 AS ok FROM z GROUP BY rel_day, grace)""")
def cau_13(x):
    g = cohort_grid(x).where("arm_a is not null").withColumn("p", F.lit(0.1) + F.lit(0.8) * ((F.col("entity") * 7 + F.col("rel_day")) % 10) / 10)
    return r6(cohort.overlap_summary(g, by=["rel_day", "grace"], arm="arm_a", propensity="p"), "ess", "ess_a", "ess_b", "weight_max", "p_q05", "p_q25", "p_q50", "p_q75", "p_q95")


_SITE = f"""SELECT rel_day, grace, site, entries, a, b, entries - a - b AS unclassified, CAST(a >= 5 AND b >= 5 AS INTEGER) AS both_large, CAST((a > 0) <> (b > 0) AS INTEGER) AS single_arm FROM (
 SELECT rel_day, grace, site, count(*) AS entries, count(*) FILTER (arm_a = 1) AS a, count(*) FILTER (arm_a = 0) AS b FROM ch WHERE exclusion IS NULL GROUP BY ALL)"""


@query("cau_14", f"WITH {_GRID} {_SITE}")
def cau_14(x):
    return cohort.cohort_by_site(cohort_grid(x))


_SUMMARY = f"""SELECT c.*, s.sites, s.sites_both_large, s.sites_single_arm FROM (SELECT rel_day, grace, {_COUNTS} FROM ch GROUP BY ALL) c LEFT JOIN (SELECT rel_day, grace, count(*) AS sites,
  CAST(sum(both_large) AS BIGINT) AS sites_both_large, CAST(sum(single_arm) AS BIGINT) AS sites_single_arm FROM ({_SITE}) GROUP BY ALL) s USING (rel_day, grace)"""


@query("cau_15", f"WITH {_GRID} {_SUMMARY}")
def cau_15(x):
    return cohort.cohort_summary(cohort_grid(x))


@query("cau_16", f"""WITH cards AS (SELECT DISTINCT p_brand AS card, p_type AS feature FROM part),
 att AS (SELECT p_type AS feature, avg(p_retailprice) AS m FROM part WHERE p_type <> 'SMALL' GROUP BY 1), pm AS (SELECT p_type AS feature, stddev_pop(p_size) AS l FROM part WHERE p_type <> 'LARGE' GROUP BY 1),
 su AS (SELECT p_type AS feature, CAST(l_linenumber AS INTEGER) AS day, count(*) AS eligible_rows, count(*) FILTER (l_discount > 0.05) AS nonmissing FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber IN (1, 3, 7) AND p_type <> 'PROMO' GROUP BY ALL)
SELECT card, feature, CASE WHEN feature <> 'PROMO' THEN round(m, 6) + 0e0 END AS mean_abs, CASE WHEN feature <> 'PROMO' THEN round(m / (SELECT sum(m) FROM att), 6) + 0e0 END AS share,
 CASE WHEN m IS NOT NULL THEN CAST(feature <> 'PROMO' AS INTEGER) END AS agrees, {sr6('l', 'auc_loss')}, day, eligible_rows, nonmissing FROM cards LEFT JOIN att USING (feature) LEFT JOIN pm USING (feature) LEFT JOIN su USING (feature)""")
def cau_16(x):
    p = x.table("part").withColumnRenamed("p_type", "feature")
    cards = p.select(F.col("p_brand").alias("card"), "feature").distinct()
    at = p.where("feature <> 'SMALL'").groupBy("feature").agg(F.avg("p_retailprice").alias("mean_abs"))
    at = materialize(aggregates.normalised_share(at, [], "mean_abs"))
    told = at.withColumn("mean_abs", F.when(F.col("feature") == "PROMO", F.col("mean_abs") + 1).otherwise(F.col("mean_abs")))  # the other file, with one planted difference
    pm = p.where("feature <> 'LARGE'").groupBy("feature").agg(F.stddev_pop("p_size").alias("auc_loss"))
    li = x.table("lineitem").where(F.col("l_linenumber").isin(1, 3, 7)).join(p, F.col("l_partkey") == F.col("p_partkey")).where("feature <> 'PROMO'")
    su = li.groupBy("feature", F.col("l_linenumber").alias("day"), "l_returnflag").agg(F.count("*").alias("eligible_rows"), F.count_if(F.col("l_discount") > 0.05).alias("nonmissing")).drop("l_returnflag")
    return r6(cohort.evidence_rollup(cards, at, pm, su, second=told), "mean_abs", "share", "auc_loss")


@query("cau_17", f"""WITH {_GRID}, sm AS (SELECT site % 3 AS card, rel_day, grace, count(*) FILTER (exclusion IS NULL) AS entries, count(*) FILTER (arm_a = 1) AS a FROM ch GROUP BY ALL)
SELECT CAST(card AS INTEGER) AS card, rel_day, grace, entries, a FROM (SELECT *, row_number() OVER (PARTITION BY card ORDER BY CASE WHEN rel_day = 3 AND grace = 1 AND card <> 1 THEN 0 ELSE 1 END, entries DESC, rel_day, grace) AS r FROM sm
 WHERE NOT (card = 1 AND rel_day = 3)) WHERE r = 1""")
def cau_17(x):
    g = cohort_grid(x).withColumn("card", F.col("site") % 3).groupBy("card", "rel_day", "grace").agg(F.count_if(F.col("exclusion").isNull()).alias("entries"), F.count_if(F.col("arm_a") == 1).alias("a"))
    return cohort.representative_cells(g.where("not (card = 1 and rel_day = 3)"), card="card", fixed={"rel_day": 3, "grace": 1}, size="entries", order=["rel_day", "grace"])
