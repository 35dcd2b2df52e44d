"""Metric and inference (MET), split (SPL) and encoding (ENC) queries with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.contract import LOCKED_DRAWS, REPORT_DRAWS, valid_floor
from tidemark.functions.scalars import hash32
from tidemark.operators import aggregates, encode, metrics, splits
from tidemark.operators.resample import resampled_sums
from tidemark.plans.catalog import query
from tidemark.plans.common import config_rows, r6, sr6
from tidemark.plans.metric_sql import metrics_sql, phase_sql, repeat_mean_sql
from tidemark.plans.sqlviews import EVERY, QUERY_DRAWS, h32

D = QUERY_DRAWS


@query("met_01", f"SELECT repeat, arm, {sr6('auc', 'auc')}, {sr6('ap', 'ap')}, {sr6('brier', 'brier')} FROM ({metrics_sql('f_scores', 'repeat, arm')})")
def met_01(x):
    return r6(metrics.rank_metrics(x.scores, ["repeat", "arm"]).select("repeat", "arm", "auc", "ap", "brier"), "auc", "ap", "brier")


@query("met_02", f"SELECT repeat, arm, metric, {sr6('value', 'value')} FROM ({phase_sql('f_scores', 'repeat, arm')})")
def met_02(x):
    return r6(metrics.phase_metrics(x.scores, ["repeat", "arm"]), "value")


def _cells(two: bool) -> str:
    pos = "(SELECT 'all' AS positive_phase)" if two else "(SELECT unnest(['pre', 'post']) AS positive_phase)"
    src = f"""(SELECT r.repeat, r.arm, r.y, r.probability, pp.positive_phase, np.negative_phase FROM f_scores r, {pos} pp,
   (SELECT unnest(['pre', 'post']) AS negative_phase) np
   WHERE (y = 1 AND (positive_phase = 'all' OR (pod < 0) = (positive_phase = 'pre'))) OR (y = 0 AND (pod < 0) = (negative_phase = 'pre')))"""
    return f"""
SELECT c.repeat, c.arm, positive_phase, negative_phase, {sr6('n_pos * n_neg / (tp * tn)', 'weight')}, {sr6('auc', 'auc')},
  {sr6('CASE WHEN n_pos * n_neg = 0 THEN 0 ELSE n_pos * n_neg / (tp * tn) * auc END', 'contribution')}, {sr6('ta', 'total_auc')}
FROM ({metrics_sql(src, 'repeat, arm, positive_phase, negative_phase')}) c
JOIN (SELECT repeat, arm, n_pos AS tp, n_neg AS tn, auc AS ta FROM ({metrics_sql('f_scores', 'repeat, arm')})) USING (repeat, arm)"""


@query("met_03", _cells(False))
def met_03(x):
    return r6(metrics.auc_decomposition(x.scores, ["repeat", "arm"], four_cells=True), "weight", "auc", "contribution", "total_auc")


@query("met_03_two", _cells(True))
def met_03_two(x):
    return r6(metrics.auc_decomposition(x.scores, ["repeat", "arm"], four_cells=False), "weight", "auc", "contribution", "total_auc")


_WEIGHTED = """(SELECT m.draw, s.repeat, s.arm, s.pod, s.y, s.probability, m.m AS w FROM f_scores s JOIN f_mult m ON m.stay = s.stay)"""
_DRAWN = repeat_mean_sql(phase_sql(_WEIGHTED, "draw, repeat, arm", "w"), "draw, arm, metric")
_POINT = repeat_mean_sql(phase_sql("f_scores", "repeat, arm"), "arm, metric")
_CONTRASTS = [("fine", "noise", "AUROC_post"), ("ties", "noise", "AUROC_post"), ("fine", "ties", "AUROC_total")]
_CON = "(VALUES " + ", ".join(map(str, _CONTRASTS)) + ") k(arm, reference, metric)"
_EVAL = f"""
pt AS ({_POINT}), dr AS ({_DRAWN}),
est AS (SELECT k.*, a.value - b.value AS delta FROM {_CON} JOIN pt a ON a.arm = k.arm AND a.metric = k.metric
  JOIN pt b ON b.arm = k.reference AND b.metric = k.metric),
smp AS (SELECT a.draw, k.*, a.value - b.value AS delta FROM {_CON} JOIN dr a ON a.arm = k.arm AND a.metric = k.metric
  JOIN dr b ON b.arm = k.reference AND b.metric = k.metric AND b.draw = a.draw),
ci AS (SELECT arm, reference, metric, count(delta) AS valid_draws, {D} - count(delta) AS undefined_draws,
  quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM smp GROUP BY ALL),
er AS (SELECT draw, max(abs(s.delta - e.delta)) AS err FROM smp s JOIN est e USING (arm, reference, metric) GROUP BY draw
  HAVING count(s.delta) = {len(_CONTRASTS)}),
band AS (SELECT quantile_cont(err, 0.95) AS q, count(*) AS n FROM er)"""


def contrasts(x):
    return config_rows(x.spark, ["arm", "reference", "metric"], _CONTRASTS)


@query(
    "met_04",
    f"""SELECT arm, metric, count(value) AS valid_draws, {D} - count(value) AS undefined_draws,
  {sr6('quantile_cont(value, 0.025)', 'ci_lo')}, {sr6('quantile_cont(value, 0.975)', 'ci_hi')} FROM ({_DRAWN}) GROUP BY arm, metric""",
    drawn=True,
)
def met_04(x):
    out = metrics.interval_summary(metrics.drawn_arm_metrics(x.scores, x.weights, draws=D), ["arm", "metric"], value="value", draws=D)
    return r6(out.drop("estimate"), "ci_lo", "ci_hi")


@query("met_04_draws", f"""WITH w AS (SELECT 0 AS draw, repeat, arm, pod, y, probability, 1 AS w FROM f_scores UNION ALL
  SELECT m.draw, s.repeat, s.arm, s.pod, s.y, s.probability, m.m FROM f_scores s JOIN f_mult_some m ON m.stay = s.stay)
 SELECT draw, arm, metric, {sr6('value', 'value')} FROM ({repeat_mean_sql(phase_sql('w', 'draw, repeat, arm', 'w'), 'draw, arm, metric')})""")
def met_04_draws(x):
    """Every ``EVERY``-th draw of the run that met_04 to met_07 and met_09 summarise."""
    drawn = metrics.drawn_arm_metrics(x.scores, x.weights, draws=D)
    return r6(drawn.where(F.col("draw") % EVERY == 0), "value")


@query(
    "met_05",
    f"""WITH {_EVAL.strip()} SELECT arm, reference, metric, {sr6('delta', 'delta')}, n AS common_valid_draws, {sr6('q', 'q')},
 {sr6('delta - q', 'sim_lo')}, {sr6('delta + q', 'sim_hi')} FROM est, band""",
    drawn=True,
)
def met_05(x):
    deltas = metrics.contrast(metrics.drawn_arm_metrics(x.scores, x.weights, draws=D), contrasts(x), ["draw"])
    out = metrics.simultaneous_summary(deltas, ["arm", "reference", "metric"], draws=D)
    names = ["delta", "q", "sim_lo", "sim_hi"]
    return r6(out.select("arm", "reference", "metric", "common_valid_draws", *names), *names)


_MET06 = f"""WITH {_EVAL.strip()} SELECT arm, reference, metric, {sr6('delta', 'delta')}, n AS common_valid_draws, {sr6('q', 'q')},
 {sr6('delta - q', 'sim_lo')}, {sr6('delta + q', 'sim_hi')}, valid_draws, undefined_draws, {sr6('lo', 'ci_lo')}, {sr6('hi', 'ci_hi')}
 FROM est JOIN ci USING (arm, reference, metric), band"""


def _paired(x):
    return metrics.paired_evaluation(x.scores, x.weights, contrasts(x), draws=D)


@query("met_06", _MET06, drawn=True)
def met_06(x):
    return r6(_paired(x), "delta", "q", "sim_lo", "sim_hi", "ci_lo", "ci_hi")


@query(
    "met_07",
    f"""SELECT arm, reference, metric, h AS holds, CAST(h = '' AS INTEGER) AS passes FROM (SELECT arm, reference, metric, concat(
  CASE WHEN least((SELECT count(DISTINCT repeat) FROM f_scores f WHERE f.arm = c.arm), (SELECT count(DISTINCT repeat) FROM f_scores f WHERE f.arm = c.reference)) < 5 THEN 'R' ELSE '' END,
  CASE WHEN (SELECT count(*) FROM ({_MET06}) WHERE delta IS NOT NULL) < {len(_CONTRASTS)} OR common_valid_draws < {valid_floor(D)} THEN 'F' ELSE '' END,
  CASE WHEN delta >= 0.01 THEN '' ELSE 'E' END, CASE WHEN sim_lo > 0 THEN '' ELSE 'L' END) AS h FROM ({_MET06}) c)""",
    drawn=True,
)
def met_07(x):
    out = metrics.promotion(_paired(x), x.scores, contrasts(x), stage="confirm", repeats=5, draws=D)
    return out.select("arm", "reference", "metric", "holds", F.col("passes").cast("int").alias("passes"))


_BIN = "CASE WHEN pod < 0 THEN 'pre' WHEN pod <= 2 THEN '0-2' ELSE '3-7' END"
_BS = f"(SELECT *, {_BIN} AS bin FROM f_scores)"
_BW = f"(SELECT m.draw, s.*, m.m AS w FROM {_BS} s JOIN f_mult m ON m.stay = s.stay)"


def _long(inner: str, keys: str) -> str:
    return (f"SELECT {keys}, metric, CASE metric WHEN 'auc' THEN auc WHEN 'ap' THEN ap ELSE brier END AS value FROM ({inner}),"
            " (SELECT unnest(['auc', 'ap', 'brier']) AS metric)")


@query(
    "met_08",
    f"""WITH sup AS (SELECT arm, bin, min(CAST(p >= 10 AND n >= 10 AS INTEGER)) AS supported FROM (SELECT repeat, arm, bin,
   count(DISTINCT CASE WHEN y = 1 THEN stay END) AS p, count(DISTINCT CASE WHEN y = 0 THEN stay END) AS n FROM {_BS} GROUP BY ALL) GROUP BY ALL),
 pt AS ({repeat_mean_sql(_long(metrics_sql(_BS, 'repeat, arm, bin'), 'repeat, arm, bin'), 'arm, bin, metric')}),
 dr AS ({repeat_mean_sql(_long(metrics_sql(_BW, 'draw, repeat, arm, bin', w='w'), 'draw, repeat, arm, bin'), 'draw, arm, bin, metric')}),
 ci AS (SELECT arm, bin, metric, count(value) AS valid_draws, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM dr GROUP BY ALL)
SELECT arm, bin, metric, valid_draws, CASE WHEN metric <> 'auc' OR supported = 1 THEN {sr6('value', 'x').rsplit(' AS ', 1)[0]} END AS estimate,
 CASE WHEN metric <> 'auc' OR supported = 1 THEN {sr6('lo', 'x').rsplit(' AS ', 1)[0]} END AS ci_lo,
 CASE WHEN metric <> 'auc' OR supported = 1 THEN {sr6('hi', 'x').rsplit(' AS ', 1)[0]} END AS ci_hi, supported
FROM pt JOIN ci USING (arm, bin, metric) JOIN sup USING (arm, bin)""",
    drawn=True,
)
def met_08(x):
    return r6(metrics.binned_metrics(x.scores, x.weights, draws=D), "estimate", "ci_lo", "ci_hi")


@query(
    "met_09",
    f"""SELECT p.arm, p.metric, {sr6('p.value', 'estimate')}, valid_draws, undefined_draws, {sr6('lo', 'ci_lo')}, {sr6('hi', 'ci_hi')} FROM
 (SELECT * FROM ({_POINT})) p JOIN (SELECT arm, metric, count(value) AS valid_draws, {D} - count(value) AS undefined_draws,
  quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM ({_DRAWN}) GROUP BY arm, metric) d ON d.arm = p.arm AND d.metric = p.metric""",
    drawn=True,
)
def met_09(x):
    return r6(metrics.arm_intervals(x.scores, x.weights, draws=D), "estimate", "ci_lo", "ci_hi")


@query("met_08_draws", f"""WITH w AS (SELECT *, 0 AS draw, 1 AS w FROM {_BS} UNION ALL SELECT s.*, m.draw, m.m FROM {_BS} s JOIN f_mult_some m ON m.stay = s.stay)
 SELECT draw, repeat, arm, bin, {sr6('auc', 'auc')}, {sr6('ap', 'ap')}, {sr6('brier', 'brier')} FROM ({metrics_sql('w', 'draw, repeat, arm, bin', w='w')})""")
def met_08_draws(x):
    """Every ``EVERY``-th draw of the run that met_08 and met_19 summarise."""
    drawn = metrics.binned_draws(x.scores, x.weights, draws=D).where(F.col("draw") % EVERY == 0)
    return r6(drawn.select("draw", "repeat", "arm", "bin", "auc", "ap", "brier"), "auc", "ap", "brier")


_MASKS = {"all": "TRUE", "pre": "rel < 0", "pod0_3": "rel BETWEEN 0 AND 3", "pod4plus": "rel >= 4", "lead3": "y3 = 0 OR event - day = 3"}


def _masked_src(masks: dict, y: str, source: str = "f_risk_scores") -> str:
    return "(" + " UNION ALL ".join(f"SELECT repeat, {y} AS y, probability, '{n}' AS subset FROM {source} WHERE {c}" for n, c in masks.items()) + ")"


def _mean_sd(inner: str, value: str) -> str:
    return f"SELECT subset, {sr6(f'avg({value})', 'mean')}, {sr6(f'stddev_samp({value})', 'sd')} FROM ({inner}) GROUP BY subset"


def _newton_sql(shift_only: bool, steps: int, source: str = "f_scores", keys: str = "repeat, arm", y: str = "y") -> str:
    """(keys, a, b): the fits by a fixed number of Newton steps over (keys, z) counts, as nested selects."""
    g = f"""(SELECT {keys}, z, count(*) AS n, sum({y}) AS k FROM (SELECT {keys}, {y}, ln(c / (1 - c)) AS z FROM (
 SELECT {keys}, {y}, least(greatest(probability, 1e-6), 1 - 1e-6) AS c FROM {source})) GROUP BY ALL)"""
    out = [f"g AS MATERIALIZED {g}", f"s0 AS (SELECT {keys}, " + ("0e0 AS a, 1e0 AS b" if shift_only else "ln(sum(k) / (sum(n) - sum(k))) AS a, 0e0 AS b") + f" FROM g GROUP BY {keys})"]
    for i in range(steps):
        p = f"(SELECT g.*, a, b, 1 / (1 + exp(-(a + b * z))) AS p FROM g JOIN s{i} USING ({keys}))"
        m = f"(SELECT {keys}, any_value(a) AS a, any_value(b) AS b, sum(k - n * p) AS g0, sum((k - n * p) * z) AS g1, sum(n * p * (1 - p)) AS h0, sum(n * p * (1 - p) * z) AS h1, sum(n * p * (1 - p) * z * z) AS h2 FROM {p} GROUP BY {keys})"
        new = "a + g0 / h0 AS a, b" if shift_only else "a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b"
        out.append(f"s{i + 1} AS MATERIALIZED (SELECT {keys}, {new} FROM {m})")
    return "(WITH " + ", ".join(out) + f" SELECT {keys}, a, b FROM s{steps})"


def _auc_report_sql(source: str, mult: str, group: str = "") -> str:
    """``metrics.auc_report`` of ``source`` (repeat, arm, stay, group, y, probability)."""
    keys, by = f"draw, repeat, arm{group}", f"draw{group}"
    drawn = f"(SELECT s.*, 0 AS draw, 1 AS w FROM {source} s UNION ALL SELECT s.*, m.draw, m.m FROM {source} s JOIN {mult} m ON m.stay = s.stay)"
    v = f"""(SELECT {by}, avg(auc) FILTER (arm = 'model') AS auc, avg(auc) FILTER (arm = 'model') - avg(auc) FILTER (arm = 'reference') AS delta FROM ({metrics_sql(drawn, keys, w='w')}) GROUP BY {by})"""
    out = ", ".join(f"max({c}) FILTER (draw = 0) AS {c}, quantile_cont({c}, 0.025) FILTER (draw > 0) AS {lo}, quantile_cont({c}, 0.975) FILTER (draw > 0) AS {hi}" for c, lo, hi in (("auc", "ci_lo", "ci_hi"), ("delta", "delta_lo", "delta_hi")))
    head = group.lstrip(", ") + ", " if group else ""
    return f"SELECT {head}count(auc) FILTER (draw > 0) AS valid_draws, {out} FROM {v}" + (f" GROUP BY {group.lstrip(', ')}" if group else "")


@query(
    "met_10",
    f"""WITH thr AS (SELECT repeat, quantile_cont(probability, 0.95) AS t FROM f_risk_scores WHERE y3 = 0 GROUP BY repeat),
 det AS (SELECT repeat, entity, min(grp) AS g, max(CAST(probability >= t AS INTEGER)) AS hit FROM f_risk_scores JOIN thr USING (repeat) WHERE y3 = 1 GROUP BY ALL),
 m AS ({metrics_sql(_masked_src(_MASKS, 'y3'), 'repeat, subset')}),
 ci AS ({_auc_report_sql('(SELECT *, y3 AS y FROM f_report)', 'f_report_mult')}),
 t AS (SELECT 'auc_' || subset AS metric, mean, sd FROM ({_mean_sd('SELECT * FROM m', 'auc')}) UNION ALL
SELECT 'ap_all', mean, sd FROM ({_mean_sd("SELECT * FROM m WHERE subset = 'all'", 'ap')}) UNION ALL
SELECT 'calibration_slope', mean, sd FROM ({_mean_sd("SELECT 'all' AS subset, b FROM " + _newton_sql(False, 12, 'f_risk_scores', 'repeat', 'y3'), 'b')}) UNION ALL
SELECT 'detect_' || subset, mean, sd FROM ({_mean_sd("SELECT repeat, 'all' AS subset, avg(hit) AS h FROM det GROUP BY repeat UNION ALL SELECT repeat, g, avg(hit) FROM det GROUP BY repeat, g", 'h')}))
SELECT t.*, CASE WHEN metric = 'auc_all' THEN round(ci_lo, 6) + 0e0 END AS ci_lo, CASE WHEN metric = 'auc_all' THEN round(ci_hi, 6) + 0e0 END AS ci_hi, CASE WHEN metric = 'auc_all' THEN valid_draws END AS valid_draws FROM t, ci
UNION ALL SELECT 'delta_auc', {sr6('delta', 'mean')}, NULL, {sr6('delta_lo', 'ci_lo')}, {sr6('delta_hi', 'ci_hi')}, valid_draws FROM ci""",
)
def met_10(x):
    from tidemark.functions.ordered import exact_quantiles

    s = x.risk_scores.withColumn("y", F.col("y3"))
    auc = metrics.masked_auc(s, {n: F.expr(c) for n, c in _MASKS.items()}, ["repeat"])
    per = metrics.repeat_summary(auc, ["subset"], ["auc", "ap"])
    thr = exact_quantiles(s.where("y = 0"), ["repeat"], "probability", {"threshold": 0.95}).drop("n")
    det = metrics.repeat_summary(metrics.detection(s, thr, ["repeat"], group="grp", entity="entity"), ["segment"], ["detected"])
    slope = metrics.repeat_summary(metrics.calibration_slope(s, ["repeat"]), [], ["slope"])
    ci = metrics.auc_report(x.report_scores.withColumn("y", F.col("y3")), x.report_weights, draws=REPORT_DRAWS, entity="entity")
    plain = aggregates.union_all([
        per.select(F.concat(F.lit("auc_"), "subset").alias("metric"), F.col("auc_mean").alias("mean"), F.col("auc_sd").alias("sd")),
        per.where("subset = 'all'").select(F.lit("ap_all").alias("metric"), F.col("ap_mean").alias("mean"), F.col("ap_sd").alias("sd")),
        slope.select(F.lit("calibration_slope").alias("metric"), F.col("slope_mean").alias("mean"), F.col("slope_sd").alias("sd")),
        det.select(F.concat(F.lit("detect_"), "segment").alias("metric"), F.col("detected_mean").alias("mean"), F.col("detected_sd").alias("sd"))])
    plain = plain.join(ci.select(F.lit("auc_all").alias("metric"), "ci_lo", "ci_hi", "valid_draws"), "metric", "left")
    delta = ci.select(F.lit("delta_auc").alias("metric"), F.col("delta").alias("mean"), F.lit(None).cast("double").alias("sd"), F.col("delta_lo").alias("ci_lo"), F.col("delta_hi").alias("ci_hi"), "valid_draws")
    return r6(plain.unionByName(delta), "mean", "sd", "ci_lo", "ci_hi")


_LM = {"DOA0": "day - adm = 0", "DOA2": "day - adm = 2", "POD0": "rel = 0", "POD1": "rel = 1", "POD3": "rel = 3", "POD7": "rel = 7"}
_YB = "CASE WHEN event > day AND event - idx <= 31 THEN 1 ELSE 0 END"


_LM_ROWS = "(" + " UNION ALL ".join(f"SELECT repeat, arm, stay, {_YB} AS y, probability, '{n}' AS landmark FROM f_report WHERE {c}" for n, c in _LM.items()) + ")"


@query(
    "met_11",
    f"""SELECT subset AS landmark, n, n_pos, {sr6('p.auc', 'auc')}, {sr6('auc_sd', 'auc_sd')}, {sr6('ap', 'ap')}, valid_draws,
  {', '.join(sr6(c, c) for c in ('ci_lo', 'ci_hi', 'delta', 'delta_lo', 'delta_hi'))} FROM (SELECT subset, CAST(max(n_pos + n_neg) AS BIGINT) AS n, CAST(max(n_pos) AS BIGINT) AS n_pos, avg(auc) AS auc,
  stddev_pop(auc) AS auc_sd, avg(ap) AS ap FROM ({metrics_sql(_masked_src(_LM, _YB), 'repeat, subset')}) GROUP BY subset) p JOIN ({_auc_report_sql(_LM_ROWS, 'f_report_mult', ', landmark')}) c ON c.landmark = p.subset""",
)
def met_11(x):
    from tidemark.contract import LANDMARKS
    from tidemark.operators.panel import landmark

    rows = aggregates.union_all([landmark(x.report_scores, k, o).select("repeat", "arm", "entity", F.lit(n).alias("landmark"), F.col("yB").alias("y"), "probability")
                                 for n, (k, o) in LANDMARKS.items()])
    m = metrics.rank_metrics(rows.where("arm = 'model'"), ["repeat", "landmark"])
    out = m.groupBy("landmark").agg((F.max(F.col("n_pos") + F.col("n_neg"))).cast("long").alias("n"), F.max("n_pos").cast("long").alias("n_pos"),
                                    F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("auc_sd"), F.avg("ap").alias("ap"))
    ci = metrics.auc_report(rows, x.report_weights, ["landmark"], draws=REPORT_DRAWS, entity="entity").drop("auc")
    return r6(out.join(ci, "landmark"), "auc", "auc_sd", "ap", "ci_lo", "ci_hi", "delta", "delta_lo", "delta_hi")


_M12 = {"all": "TRUE", "pre": "rel < 0", "pod0_3": "rel BETWEEN 0 AND 3", "pod4plus": "rel >= 4", **{f"at_{k}": v for k, v in _LM.items()}}


@query("met_12", _mean_sd(metrics_sql(_masked_src(_M12, "y30"), "repeat, subset"), "auc"))
def met_12(x):
    s = x.risk_scores.withColumn("y", F.col("y30"))
    m = metrics.masked_auc(s, {n: F.expr(c) for n, c in _M12.items()}, ["repeat"])
    out = metrics.repeat_summary(m, ["subset"], ["auc"])
    return r6(out.select("subset", F.col("auc_mean").alias("mean"), F.col("auc_sd").alias("sd")), "mean", "sd")


# entities with an event after the target window (8 days past the index) are the late group "d"
_LATE_DAY = 8
_SETS = f"""(SELECT *, CASE WHEN grp <> 'c' AND NOT late AND rel <= {_LATE_DAY} THEN 'formal' WHEN grp = 'c' AND rel < 0 THEN 'c_aux' WHEN late AND rel <= {_LATE_DAY} THEN 'd_window'
  WHEN (late OR grp = 'none') AND rel > {_LATE_DAY} THEN 'late_aux' ELSE 'drop' END AS set FROM (SELECT *, coalesce(event - idx > {_LATE_DAY}, FALSE) AS late FROM f_risk_scores))"""
_M13 = {"pre_pooled": "set = 'c_aux' OR (set = 'formal' AND rel < 0)", "late": "set = 'late_aux'", "formal_plus_d_window": "set IN ('formal', 'd_window')"}


@query("met_13", f"""SELECT subset, {sr6('avg(auc)', 'mean')}, {sr6('stddev_samp(auc)', 'sd')}, CAST(max(n_pos) AS BIGINT) AS positive_rows, CAST(max(n_pos + n_neg) AS BIGINT) AS n_rows
 FROM ({metrics_sql(_masked_src(_M13, 'y3', _SETS), 'repeat, subset')}) GROUP BY subset""")
def met_13(x):
    grp, rel = F.col("grp"), F.col("rel")
    late = F.coalesce(F.col("event") - F.col("idx") > _LATE_DAY, F.lit(False))
    st = (F.when((grp != "c") & ~late & (rel <= _LATE_DAY), "formal").when((grp == "c") & (rel < 0), "c_aux").when(late & (rel <= _LATE_DAY), "d_window")
          .when((late | (grp == "none")) & (rel > _LATE_DAY), "late_aux").otherwise("drop"))
    s = x.risk_scores.withColumn("y", F.col("y3")).withColumn("set", st)
    m = metrics.masked_auc(s, {n: F.expr(c) for n, c in _M13.items()}, ["repeat"])
    counts = m.groupBy("subset").agg(F.max("n_pos").cast("long").alias("positive_rows"), F.max(F.col("n_pos") + F.col("n_neg")).cast("long").alias("n_rows"))
    out = metrics.repeat_summary(m, ["subset"], ["auc"]).join(counts, "subset")
    return r6(out.select("subset", F.col("auc_mean").alias("mean"), F.col("auc_sd").alias("sd"), "positive_rows", "n_rows"), "mean", "sd")


_THR = """(SELECT arm, avg(q) AS threshold FROM (SELECT repeat, arm, quantile_cont(probability, 0.95) AS q FROM f_scores WHERE y = 0 GROUP BY ALL) GROUP BY arm)"""


@query("met_14", f"SELECT arm, {sr6('threshold', 'threshold')} FROM {_THR}")
def met_14(x):
    return r6(metrics.alert_threshold(x.scores), "threshold")


@query(
    "met_15",
    f"""WITH s AS (SELECT *, probability >= threshold AS hit FROM f_scores JOIN {_THR} USING (arm))
SELECT repeat, arm, 'alert_rate' AS metric, {sr6('avg(CAST(hit AS INTEGER))', 'value')} FROM s WHERE y = 0 GROUP BY repeat, arm UNION ALL
SELECT repeat, arm, 'detected_all', {sr6('avg(h)', 'value')} FROM (SELECT repeat, arm, stay, max(CAST(hit AS INTEGER)) AS h FROM s WHERE y = 1 GROUP BY ALL) GROUP BY repeat, arm UNION ALL
SELECT repeat, arm, 'detected_' || g, {sr6('avg(h)', 'value')} FROM (SELECT repeat, arm, stay, min(CASE WHEN pod < 0 THEN 'early' ELSE 'late' END) AS g, max(CAST(hit AS INTEGER)) AS h FROM s WHERE y = 1 GROUP BY ALL) GROUP BY repeat, arm, g UNION ALL
SELECT repeat, arm, 'logit_mean_difference', {sr6('ln(avg(y) / (1 - avg(y))) - ln(avg(least(greatest(probability, 1e-6), 1 - 1e-6)) / (1 - avg(least(greatest(probability, 1e-6), 1 - 1e-6))))', 'value')} FROM s GROUP BY repeat, arm UNION ALL
SELECT repeat, arm, 'calibration_slope', {sr6('b', 'value')} FROM {_newton_sql(False, 12)} UNION ALL
SELECT repeat, arm, 'calibration_intercept', {sr6('a', 'value')} FROM {_newton_sql(True, 12)}""",
)
def met_15(x):
    thr = metrics.alert_threshold(x.scores)
    s = x.scores.withColumn("phase", F.when(F.col("pod") < 0, "early").otherwise("late"))
    thr = s.select("repeat", "arm").distinct().join(thr, "arm")
    det = metrics.detection(s, thr, ["repeat", "arm"], group="phase")
    rate = metrics.negative_alert_rate(s, thr, ["repeat", "arm"])
    lmd = metrics.logit_mean_difference(s, ["repeat", "arm"])
    packs = metrics.score_packs(x.scores, ["repeat", "arm"])
    slope, intercept = (fit(x.scores, ["repeat", "arm"], packs=packs) for fit in (metrics.calibration_slope, metrics.calibration_intercept))
    return r6(aggregates.union_all([
        slope.select("repeat", "arm", F.lit("calibration_slope").alias("metric"), F.col("slope").alias("value")),
        intercept.select("repeat", "arm", F.lit("calibration_intercept").alias("metric"), F.col("intercept").alias("value")),
        rate.select("repeat", "arm", F.lit("alert_rate").alias("metric"), F.col("alert_rate").alias("value")),
        det.select("repeat", "arm", F.concat(F.lit("detected_"), "segment").alias("metric"), F.col("detected").alias("value")),
        lmd.select("repeat", "arm", F.lit("logit_mean_difference").alias("metric"), F.col("logit_mean_difference").alias("value"))]), "value")


_LOCKED = "(SELECT *, y3 AS y FROM f_report WHERE repeat = 1)"


@query(
    "met_15_locked",
    f"""WITH thr AS (SELECT avg(q) AS t FROM (SELECT repeat, quantile_cont(probability, 0.95) AS q FROM f_risk_scores WHERE y3 = 0 GROUP BY repeat)),
 s AS (SELECT *, probability >= t AS hit FROM {_LOCKED}, thr WHERE arm = 'model'), ci AS ({_auc_report_sql(_LOCKED, 'f_locked_mult')}),
 det AS (SELECT entity, min(grp) AS g, max(CAST(hit AS INTEGER)) AS h FROM s WHERE y = 1 GROUP BY entity)
SELECT metric, {sr6('value', 'value')}, {sr6('ci_lo', 'ci_lo')}, {sr6('ci_hi', 'ci_hi')}, valid_draws FROM (
 SELECT 'auc' AS metric, auc AS value, ci_lo, ci_hi, valid_draws FROM ci UNION ALL SELECT 'delta_auc', delta, delta_lo, delta_hi, valid_draws FROM ci UNION ALL
 SELECT metric, value, NULL, NULL, NULL FROM (SELECT 'threshold' AS metric, t AS value FROM thr UNION ALL SELECT 'alert_rate', avg(CAST(hit AS INTEGER)) FROM s WHERE y = 0 UNION ALL
  SELECT 'detected_all', avg(h) FROM det UNION ALL SELECT 'detected_' || g, avg(h) FROM det GROUP BY g UNION ALL
  SELECT 'ap', ap FROM ({metrics_sql("(SELECT *, 1 AS one FROM s)", 'one')}) UNION ALL
  SELECT 'calibration_slope', b FROM {_newton_sql(False, 12, 's', 'arm')} UNION ALL SELECT 'calibration_intercept', a FROM {_newton_sql(True, 12, 's', 'arm')} UNION ALL
  SELECT 'logit_mean_difference', ln(avg(y) / (1 - avg(y))) - ln(avg(least(greatest(probability, 1e-6), 1 - 1e-6)) / (1 - avg(least(greatest(probability, 1e-6), 1 - 1e-6)))) FROM s UNION ALL
  SELECT 'auc_' || subset, auc FROM ({metrics_sql("(SELECT s.*, u.subset FROM s, (SELECT unnest(['pre', 'pod0_3', 'pod4plus']) AS subset) u WHERE CASE subset WHEN 'pre' THEN rel < 0 WHEN 'pod0_3' THEN rel BETWEEN 0 AND 3 ELSE rel >= 4 END)", 'subset')})))""",
)
def met_15_locked(x):
    """The whole report of one final model at a threshold that was fixed before: repeat 1 stands for the locked set."""
    thr = metrics.alert_threshold(x.risk_scores.withColumns({"y": F.col("y3"), "arm": F.lit("model")}))
    both = x.report_scores.where("repeat = 1").withColumn("y", F.col("y3"))
    s = both.where("arm = 'model'")
    det = metrics.detection(s, thr, ["arm"], group="grp", entity="entity")
    masks = {n: F.expr(c) for n, c in _MASKS.items() if n in ("pre", "pod0_3", "pod4plus")}
    ci = metrics.auc_report(both, x.report_weights, draws=LOCKED_DRAWS, entity="entity")
    one = lambda df, metric, value: df.select(metric.alias("metric"), F.col(value).alias("value"))
    name = F.lit
    plain = aggregates.union_all([
        one(thr, name("threshold"), "threshold"), one(metrics.negative_alert_rate(s, thr, ["arm"]), name("alert_rate"), "alert_rate"),
        one(det, F.concat(F.lit("detected_"), "segment"), "detected"), one(metrics.rank_metrics(s, ["arm"]), name("ap"), "ap"),
        one(metrics.calibration_slope(s, ["arm"]), name("calibration_slope"), "slope"), one(metrics.calibration_intercept(s, ["arm"]), name("calibration_intercept"), "intercept"),
        one(metrics.logit_mean_difference(s, ["arm"]), name("logit_mean_difference"), "logit_mean_difference"),
        one(metrics.masked_auc(s, masks, ["arm"]), F.concat(F.lit("auc_"), "subset"), "auc")])
    none = F.lit(None).cast("double")
    plain = plain.select("*", none.alias("ci_lo"), none.alias("ci_hi"), F.lit(None).cast("long").alias("valid_draws"))
    auc = ci.select(F.lit("auc").alias("metric"), F.col("auc").alias("value"), "ci_lo", "ci_hi", "valid_draws")
    delta = ci.select(F.lit("delta_auc").alias("metric"), F.col("delta").alias("value"), F.col("delta_lo").alias("ci_lo"), F.col("delta_hi").alias("ci_hi"), "valid_draws")
    return r6(aggregates.union_all([plain, auc, delta]), "value", "ci_lo", "ci_hi")


@query("met_16", f"SELECT repeat, arm, 'converged' AS status, {sr6('a', 'intercept')}, {sr6('b', 'slope')} FROM {_newton_sql(False, 12)}")
def met_16(x):
    return r6(metrics.calibration_slope(x.scores, ["repeat", "arm"]).drop("steps"), "intercept", "slope")


@query("met_17", f"SELECT repeat, arm, 'converged' AS status, {sr6('a', 'intercept')} FROM {_newton_sql(True, 12)}")
def met_17(x):
    return r6(metrics.calibration_intercept(x.scores, ["repeat", "arm"]).drop("steps"), "intercept")


@query(
    "met_18",
    f"""SELECT repeat, arm, frame, {sr6('auc', 'auc')} FROM ({metrics_sql("(SELECT *, 'all' AS frame FROM f_scores UNION ALL SELECT *, 'post' FROM f_scores WHERE pod >= 0)", 'repeat, arm, frame')})""",
)
def met_18(x):
    m = metrics.masked_auc(x.scores, {"all": F.lit(True), "post": F.col("pod") >= 0}, ["repeat", "arm"])
    return r6(m.select("repeat", "arm", F.col("subset").alias("frame"), "auc"), "auc")


@query(
    "met_19",
    f"""WITH pt AS ({repeat_mean_sql('SELECT repeat, arm, bin, auc AS value FROM (' + metrics_sql(_BS, 'repeat, arm, bin') + ')', 'arm, bin')}),
 dr AS ({repeat_mean_sql('SELECT draw, repeat, arm, bin, auc AS value FROM (' + metrics_sql(_BW, 'draw, repeat, arm, bin', w='w') + ')', 'draw, arm, bin')}),
 sm AS (SELECT a.draw, a.arm, b.arm AS reference, a.bin, a.value - b.value AS delta FROM dr a JOIN dr b ON a.draw = b.draw AND a.bin = b.bin AND a.arm = 'fine' AND b.arm = 'noise')
SELECT a.arm, b.arm AS reference, a.bin, {sr6('a.value - b.value', 'delta')}, valid_draws, undefined_draws, {sr6('lo', 'ci_lo')}, {sr6('hi', 'ci_hi')}
FROM pt a JOIN pt b ON a.bin = b.bin AND a.arm = 'fine' AND b.arm = 'noise'
JOIN (SELECT bin, count(delta) AS valid_draws, {D} - count(delta) AS undefined_draws, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM sm GROUP BY bin) c ON c.bin = a.bin""",
    drawn=True,
)
def met_19(x):
    c = config_rows(x.spark, ["arm", "reference"], [("fine", "noise")])
    return r6(metrics.binned_gains(x.scores, x.weights, c, draws=D), "delta", "ci_lo", "ci_hi")


_FRACS = (0.25, 0.5, 0.75, 1.0)


def _subset_sql(fr: float) -> str:
    return f"""SELECT s.*, {fr}e0 AS fraction, c.cases FROM f_scores s JOIN (SELECT *, sum(CASE WHEN "case" = 1 THEN 1 ELSE 0 END) OVER () AS cases FROM (
  SELECT stay, "case", row_number() OVER (PARTITION BY "case" ORDER BY {h32("concat_ws('|', 'curve', stay)")}, stay) AS r,
    count(*) OVER (PARTITION BY "case") AS n FROM (SELECT DISTINCT stay, "case" FROM f_targets)) WHERE r <= floor({fr} * n)) c ON c.stay = s.stay"""


@query(
    "met_20",
    f"""SELECT arm, {sr6('avg(slope)', 'slope')} FROM (SELECT repeat, arm, regr_slope(auc, log2(cases)) AS slope FROM (
 {metrics_sql('(' + ' UNION ALL '.join(_subset_sql(f) for f in _FRACS) + ')', 'repeat, arm, cases')}) GROUP BY ALL) GROUP BY arm""",
)
def met_20(x):
    ent = x.targets.select("stay", "case").distinct()
    sub = splits.nested_subsets(ent, entity="stay", strata="case", fractions=_FRACS)
    n = sub.groupBy("fraction").agg(F.sum("case").alias("cases"))
    m = metrics.rank_metrics(x.scores.drop("case").join(sub.select("fraction", "stay"), "stay"), ["repeat", "arm", "fraction"])
    slopes = metrics.learning_slope(m.join(n, "fraction"), ["repeat", "arm"])
    return r6(slopes.groupBy("arm").agg(F.avg("slope").alias("slope")), "slope")


def _slope_draws_sql(mult: str) -> str:
    """(draw, arm, slope) with the point as draw 0."""
    w = f"(SELECT s.*, 0 AS draw, 1 AS w FROM sub s UNION ALL SELECT s.*, m.draw, m.m FROM sub s JOIN {mult} m ON m.stay = s.stay)"
    return f"""sub AS MATERIALIZED ({' UNION ALL '.join(_subset_sql(f) for f in _FRACS)}),
 sd AS (SELECT draw, arm, CASE WHEN count(slope) = count(*) THEN avg(slope) END AS slope FROM (SELECT draw, repeat, arm, CASE WHEN count(auc) = count(*) THEN regr_slope(auc, log2(cases)) END AS slope
   FROM ({metrics_sql(w, 'draw, repeat, arm, cases', w='w')}) GROUP BY ALL) GROUP BY draw, arm)"""


def _slope_draws(x):
    sub = splits.nested_subsets(x.targets.select("stay", "case").distinct(), entity="stay", strata="case", fractions=_FRACS)
    cases = sub.groupBy("fraction").agg(F.sum("case").alias("cases"))
    scores = x.scores.drop("case").join(sub.select("fraction", "stay"), "stay")
    return metrics.learning_slope_draws(scores, cases, x.weights, draws=D)


@query("met_20_intervals", f"""WITH {_slope_draws_sql('f_mult')} SELECT arm, {sr6('max(CASE WHEN draw = 0 THEN slope END)', 'slope')}, count(CASE WHEN draw > 0 THEN slope END) AS valid_draws,
 {sr6('quantile_cont(CASE WHEN draw > 0 THEN slope END, 0.025)', 'ci_lo')}, {sr6('quantile_cont(CASE WHEN draw > 0 THEN slope END, 0.975)', 'ci_hi')} FROM sd GROUP BY arm""", drawn=True)
def met_20_intervals(x):
    out = metrics.interval_summary(_slope_draws(x), ["arm"], value="slope", draws=D)
    return r6(out.select("arm", F.col("estimate").alias("slope"), "valid_draws", "ci_lo", "ci_hi"), "slope", "ci_lo", "ci_hi")


@query("met_20_draws", f"WITH {_slope_draws_sql('f_mult_some')} SELECT draw, arm, {sr6('slope', 'slope')} FROM sd")
def met_20_draws(x):
    """Every ``EVERY``-th draw of the run that met_20_intervals summarises."""
    return r6(_slope_draws(x).where(F.col("draw") % EVERY == 0), "slope")


_LEDGER = """fits AS (SELECT l_orderkey * 10 + l_linenumber AS attempt_id, concat(p_brand, '/', l_linenumber) AS fit_key, p_type AS arm,
   CASE WHEN l_linestatus = 'O' THEN 'inner' ELSE 'outer' END AS kind, CASE WHEN l_returnflag = 'A' AND l_suppkey % 3 = 0 THEN 'completed' ELSE 'failed' END AS status
   FROM f_lines JOIN part ON p_partkey = l_partkey),
 per AS (SELECT fit_key, count(*) FILTER (status = 'completed') AS ok FROM fits GROUP BY fit_key)"""


@query(
    "met_21",
    f"""WITH {_LEDGER} SELECT 'attempts_' || status || '_' || kind AS measure, count(*) AS n FROM fits GROUP BY status, kind UNION ALL
SELECT 'double_success', count(*) FROM per WHERE ok > 1 UNION ALL SELECT 'unresolved', count(*) FROM per WHERE ok = 0 UNION ALL
SELECT 'missing', count(*) FROM (SELECT DISTINCT concat(p_brand, '/1') AS k FROM part) WHERE k NOT IN (SELECT fit_key FROM per WHERE ok > 0) UNION ALL
SELECT 'undeclared', count(*) FROM fits WHERE arm = 'SMALL' UNION ALL SELECT 'slots_over', CAST(1 AS BIGINT)""",
)
def met_21(x):
    f = x.lines.join(x.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    ok = (F.col("l_returnflag") == "A") & (F.col("l_suppkey") % 3 == 0)
    fits = f.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("attempt_id"),
                    F.concat("p_brand", F.lit("/"), F.col("l_linenumber").cast("string")).alias("fit_key"), F.col("p_type").alias("arm"),
                    F.when(F.col("l_linestatus") == "O", "inner").otherwise("outer").alias("kind"),
                    F.when(ok, "completed").otherwise("failed").alias("status"))
    part = x.table("part")
    decl = part.where("p_type <> 'SMALL'").select(F.col("p_type").alias("id")).distinct().select(
        "id", F.lit("A").alias("frame"), F.lit("configuration").alias("kind"))
    required = part.select(F.concat("p_brand", F.lit("/1")).alias("fit_key")).distinct()
    caps = config_rows(x.spark, ["frame", "kind", "cap"], [("A", "configuration", 2)])
    a = metrics.ledger_audit(decl, fits, required, caps)
    one = lambda n, df: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("measure"), "n")
    return aggregates.union_all([
        a["attempts"].select(F.concat(F.lit("attempts_"), "status", F.lit("_"), "kind").alias("measure"), "n"),
        one("double_success", a["double_success"]), one("unresolved", a["unresolved"]), one("missing", a["missing"]),
        one("undeclared", a["undeclared"]), one("slots_over", a["slots"].where("over"))])


# --- splits ---

_ENT = 'SELECT DISTINCT stay, "case" FROM f_targets'


def _rank(salt: str, part: str = '"case"', extra: str = "") -> str:
    return f"row_number() OVER (PARTITION BY {part} ORDER BY {h32(f"concat_ws('|', '{salt}', {extra}stay)")}, stay)"


@query(
    "spl_01",
    f"""SELECT stay, "case", CASE WHEN r <= CASE WHEN "case" = 1 THEN 3000 ELSE 1000 END THEN 'train' ELSE 'test' END AS part
 FROM (SELECT *, {_rank('split')} AS r FROM ({_ENT})) WHERE "case" = 1 OR r <= 2500""",
)
def spl_01(x):
    return splits.case_control_split(x.targets.select("stay", "case").distinct(), entity="stay", label="case", n_controls=2500,
                                     case_train=3000, control_train=1000)


@query(
    "spl_02",
    f"""SELECT CAST(repeat AS INTEGER) AS repeat, stay, "case", CAST((r - 1) % 5 AS INTEGER) AS fold FROM (
 SELECT *, {_rank('fold', 'repeat, "case"', 'repeat, ')} AS r FROM ({_ENT}), (SELECT unnest(range(0, 5)) AS repeat))""",
)
def spl_02(x):
    return splits.repeated_folds(x.targets.select("stay", "case").distinct(), entity="stay", positive="case")


@query(
    "spl_03",
    """SELECT c_nationkey, n, CAST(CASE WHEN (pos // 5) % 2 = 0 THEN pos % 5 ELSE 4 - pos % 5 END AS INTEGER) AS fold FROM (
 SELECT *, row_number() OVER (ORDER BY n DESC, c_nationkey) - 1 AS pos FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1))""",
)
def spl_03(x):
    return splits.site_folds(x.table("customer"), entity="c_custkey", site="c_nationkey")


@query("spl_04", "SELECT entity, CASE WHEN idx >= 45300 THEN 1 ELSE 0 END AS late_era FROM f_anchors")
def spl_04(x):
    return splits.era_flag(x.anchors, "idx", 45300).select("entity", "late_era")


_INNER = f"""(SELECT stay, "case", (r - 1) % 3 AS fold FROM (SELECT *, {_rank('inner', '"case"', '0, ')} AS r FROM ({_ENT})))"""


@query(
    "spl_05",
    f"""SELECT CAST(fold AS INTEGER) AS fold, count(*) AS entities, CAST(sum("case") AS BIGINT) AS cases,
 CAST(min("case") < max("case") AS INTEGER) AS both_classes FROM {_INNER} GROUP BY fold""",
)
def spl_05(x):
    f = splits.repeated_folds(x.targets.select("stay", "case").distinct(), entity="stay", positive="case", repeats=1, folds=3, salt="inner")
    return f.groupBy("fold").agg(F.count("*").alias("entities"), F.sum("case").alias("cases"),
                                 (F.min("case") < F.max("case")).cast("int").alias("both_classes"))


@query(
    "spl_06",
    " UNION ALL ".join(
        f"""SELECT {f}e0 AS fraction, stay, "case" FROM (SELECT *, {_rank('curve')} AS r, count(*) OVER (PARTITION BY "case") AS n FROM ({_ENT})) WHERE r <= floor({f} * n)"""
        for f in _FRACS
    ),
)
def spl_06(x):
    return splits.nested_subsets(x.targets.select("stay", "case").distinct(), entity="stay", strata="case", fractions=_FRACS)


_MARK = f"{h32("concat_ws('|', 'mark', stay)")} % 1000003"


def _digest(x, weights, by):
    """Per draw: picks, and the sum over picks of a number that names the entity."""
    ent = x.targets.select("stay", *by).distinct().withColumn("mark", (hash32(F.lit("mark"), "stay") % 1000003).cast("double"))
    s = resampled_sums(ent, weights, by, ["mark"], draws=D).where("draw > 0")
    return s.select("draw", *by, F.col("weight").cast("long").alias("picks"), F.col("mark").cast("long").alias("marks"))


@query("spl_07", f'SELECT draw, "case", CAST(sum(m) AS BIGINT) AS picks, CAST(sum(m * ({_MARK})) AS BIGINT) AS marks FROM f_mult GROUP BY draw, "case"')
def spl_07(x):
    return _digest(x, x.weights, ["case"])


def _plain() -> str:
    from tidemark.plans.sqlviews import mult_sql

    return mult_sql(D, '(SELECT DISTINCT stay, 0 AS "case" FROM f_targets)', "plain")


@query("spl_08", f"SELECT draw, stay, m FROM ({_plain()})")
def spl_08(x):
    one = x.targets.select("stay", F.lit(0).alias("one")).distinct()
    return splits.multiplicity_rows(splits.bootstrap_slots(one, stratum="one", salt="plain"), draws=D)


@query(
    "spl_09",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY repeat, pod, pat ORDER BY {h32("concat_ws('|', 'donor', stay)")}, stay) AS rank,
   count(*) OVER (PARTITION BY repeat, pod, pat) AS n FROM (SELECT repeat, stay, pod, CASE WHEN l_tax > 0.04 THEN '11' ELSE '01' END AS pat FROM f_targets)),
 p AS (SELECT *, CASE WHEN n >= 5 THEN (rank - 1 + {h32("concat_ws('|', 'donor-shift', repeat, pod, pat)")} % (n - 1) + 1) % n + 1 END AS pos FROM r)
SELECT p.repeat, p.stay, p.pod, p.pat, q.stay AS donor FROM p LEFT JOIN r q ON q.repeat = p.repeat AND q.pod = p.pod AND q.pat = p.pat AND q.rank = p.pos""",
)
def spl_09(x):
    rows = x.targets.select("repeat", "stay", "pod", F.when(F.col("l_tax") > 0.04, "11").otherwise("01").alias("pat"))
    return splits.matched_donors(rows, entity="stay", keys=["repeat", "pod", "pat"], tasks=x.tasks)


@query(
    "spl_10",
    "SELECT count(DISTINCT stay) AS entities, count(DISTINCT CASE WHEN y = 1 THEN stay END) AS cases, CAST(sum(y) AS BIGINT) AS positive_rows FROM f_targets WHERE fold <> 0",
)
def spl_10(x):
    return splits.pool_counts(x.targets.where("fold <> 0"), entity="stay", y="y")


# --- encodings ---

_LAB = "lab AS (SELECT l_orderkey AS entity, max(CAST(l_returnflag = 'R' AS INTEGER)) AS label FROM lineitem GROUP BY 1), pr AS (SELECT avg(label) AS prior FROM lab)"
_COD = """cod AS (SELECT DISTINCT l_orderkey AS entity, 'brand' AS field, p_brand AS code FROM lineitem JOIN part ON p_partkey = l_partkey UNION ALL
 SELECT l_orderkey, 'type', min(p_type) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 10 GROUP BY 1)"""
_RATES = """rt AS (SELECT field, code, count(*) AS n, (sum(label) + 100e0 * max(prior)) / (count(*) + 100e0) AS rate FROM cod JOIN lab USING (entity), pr GROUP BY field, code)"""


def code_long(x):
    lines = x.code_lines
    line = x.table("lineitem").join(x.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    typ = line.where("p_size > 10").groupBy(F.col("l_orderkey").alias("entity")).agg(F.min("p_type").alias("code")).select(
        "entity", F.lit("type").alias("field"), "code")
    return lines.select("entity", F.lit("brand").alias("field"), F.col("brand").alias("code")).distinct().unionByName(typ)


@query("enc_01", f"WITH {_LAB}, {_COD}, {_RATES} SELECT field, code, n, {sr6('rate', 'rate')}, {sr6('prior', 'prior')} FROM rt, pr")
def enc_01(x):
    return r6(encode.fit_rates(x.code_labels, code_long(x), entity="entity"), "rate", "prior")


@query(
    "enc_02",
    f"""WITH {_LAB}, pr2 AS (SELECT avg(label) AS prior FROM lab) SELECT code, count(*) AS n, {sr6('(sum(label) + 200e0 * max(prior)) / (count(*) + 200e0)', 'rate')}
FROM (SELECT o_orderkey AS entity, CAST(o_custkey % 25 AS VARCHAR) AS code FROM orders WHERE o_custkey % 25 <> 3) JOIN lab USING (entity), pr2 GROUP BY code""",
)
def enc_02(x):
    from tidemark.contract import SITE_STRENGTH

    site = F.col("o_custkey") % 25
    sites = x.table("orders").where(site != 3).select(F.col("o_orderkey").alias("entity"), site.cast("string").alias("code"))
    return r6(encode.fit_rates(x.code_labels, sites, entity="entity", by=["code"], strength=SITE_STRENGTH).select("code", "n", "rate"), "rate")


_APPLY = """SELECT o.o_orderkey AS entity, {sel} FROM orders o LEFT JOIN (SELECT entity, max(CASE WHEN field = 'type' THEN r END) AS type,
  avg(CASE WHEN field = 'brand' THEN r END) AS bm, max(CASE WHEN field = 'brand' THEN r END) AS bx, count(CASE WHEN field = 'brand' THEN r END) AS bc
  FROM (SELECT c.entity, c.field, coalesce(rt.rate, prior) AS r FROM cod c LEFT JOIN rt USING (field, code), pr) GROUP BY entity) w ON w.entity = o.o_orderkey, pr"""


@query(
    "enc_03",
    f"WITH {_LAB.replace('prior FROM lab', 'prior FROM lab WHERE entity % 3 > 0')}, {_COD}, {_RATES.replace('FROM cod JOIN lab', 'FROM cod JOIN (SELECT * FROM lab WHERE entity % 3 > 0) lab')} "
    + _APPLY.format(sel="CASE WHEN o.o_orderkey % 10 > 0 THEN " + sr6("coalesce(w.type, prior)", "x").rsplit(" AS ", 1)[0] + " END AS type, "
                    + sr6("coalesce(bm, prior)", "brand_mean") + ", " + sr6("coalesce(bx, prior)", "brand_max") + ", coalesce(bc, 0) AS brand_count"),
)
def enc_03(x):
    """Rates fitted on part of the pool; unseen codes fall back to the prior; a closed gate gives NULL."""
    codes, labels = code_long(x), x.code_labels
    fit = labels.where(F.col("entity") % 3 > 0)
    rates = encode.fit_rates(fit, codes, entity="entity")
    ents = x.table("orders").select(F.col("o_orderkey").alias("entity"))
    out = encode.apply_rates(ents, codes, rates, fit, entity="entity", single=["type"], multi=["brand"])
    out = out.withColumn("type", F.when(F.col("entity") % 10 > 0, F.col("type")))
    return r6(out, "type", "brand_mean", "brand_max")


_FOLD = h32("concat_ws('|', 'cf', entity)") + " % 3"


@query(
    "enc_04",
    f"""WITH {_LAB}, {_COD}, lf AS (SELECT *, {_FOLD} AS fold FROM lab),
 pf AS (SELECT f.fold, avg(label) AS prior FROM (SELECT DISTINCT fold FROM lf) f JOIN lf ON lf.fold <> f.fold GROUP BY f.fold),
 rf AS (SELECT f.fold, field, code, (sum(label) + 100e0 * max(prior)) / (count(*) + 100e0) AS rate FROM (SELECT DISTINCT fold FROM lf) f
   JOIN (cod JOIN lf USING (entity)) l ON l.fold <> f.fold JOIN pf ON pf.fold = f.fold GROUP BY f.fold, field, code),
 ap AS (SELECT c.entity, c.field, coalesce(rf.rate, pf.prior) AS r FROM cod c JOIN lf USING (entity) JOIN pf ON pf.fold = lf.fold
   LEFT JOIN rf ON rf.fold = lf.fold AND rf.field = c.field AND rf.code = c.code)
SELECT lf.entity, CAST(lf.fold AS BIGINT) AS fold, {sr6('coalesce(type, prior)', 'type')}, {sr6('coalesce(bm, prior)', 'brand_mean')},
 {sr6('coalesce(bx, prior)', 'brand_max')}, coalesce(bc, 0) AS brand_count FROM lf JOIN pf USING (fold) LEFT JOIN (
 SELECT entity, max(CASE WHEN field = 'type' THEN r END) AS type, avg(CASE WHEN field = 'brand' THEN r END) AS bm,
  max(CASE WHEN field = 'brand' THEN r END) AS bx, count(CASE WHEN field = 'brand' THEN r END) AS bc FROM ap GROUP BY entity) w ON w.entity = lf.entity""",
)
def enc_04(x):
    from tidemark.functions.scalars import hash32

    labels = x.code_labels.withColumn("fold", hash32(F.lit("cf"), "entity") % 3)
    out = encode.crossfit_encode(labels, code_long(x), entity="entity", fold="fold", single=["type"], multi=["brand"])
    return r6(out, "type", "brand_mean", "brand_max")


@query(
    "enc_05",
    f"WITH {_LAB}, {_COD}, {_RATES} SELECT q.l_quantity, w.* EXCLUDE (entity), q.l_orderkey, q.l_linenumber FROM f_lines q JOIN ("
    + _APPLY.format(sel=sr6("coalesce(w.type, prior)", "rate_type") + ", " + sr6("coalesce(bm, prior)", "rate_brand_mean")
                    + ", coalesce(bc, 0) AS rate_brand_count")
    + ") w ON w.entity = q.l_orderkey",
)
def enc_05(x):
    """Assembly: masked bank, code rates and counts in their fixed order."""
    codes, labels = code_long(x), x.code_labels
    ents = labels.select("entity")
    e = encode.apply_rates(ents, codes, encode.fit_rates(labels, codes, entity="entity"), labels, entity="entity", single=["type"], multi=["brand"])
    out = x.lines.join(e, x.lines.l_orderkey == e.entity)
    cols = encode.rate_table_layout(["l_quantity"], ["type", "brand_mean"], [], "brand_count")
    return r6(out.select(*[F.col(c).alias(c if c.startswith("l_") else f"rate_{c}") for c in cols], "l_orderkey", "l_linenumber"),
              "rate_type", "rate_brand_mean")


_SEQ = {"a": "CASE WHEN l_quantity > 5 THEN l_quantity - 25 END", "b": "CASE WHEN l_suppkey % 4 > 0 THEN l_extendedprice END", "c": "CAST(NULL AS DOUBLE)"}


def _stats_sql(fn: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", coalesce(fill, 0) AS fill, mean, CASE WHEN sd > 1e-12 THEN sd ELSE 1 END AS sd, coalesce(om, 0) AS observed_mean, nobs AS n_observed, nall AS n_rows FROM (
  SELECT max(f) AS fill, avg(coalesce(v, f, 0)) AS mean, stddev_pop(coalesce(v, f, 0)) AS sd, avg(v) AS om, count(v) AS nobs, count(*) AS nall
  FROM (SELECT {fn.format(e='(' + e + ')')} AS v FROM f_lines), (SELECT median({fn.format(e='(' + e + ')')}) AS f FROM f_lines))"""
        for n, e in _SEQ.items()
    )


_SLOG = "sign({e}) * ln(1 + abs({e}))"


def seq_rows(x):
    q = x.lines.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 5, F.col("l_quantity") - 25).alias("a"),
                       F.when(F.col("l_suppkey") % 4 > 0, F.col("l_extendedprice")).alias("b"), F.lit(None).cast("double").alias("c"))
    return q


@query("enc_06", f"""SELECT "column", {sr6('fill', 'fill')}, {sr6('mean', 'mean')}, {sr6('sd', 'sd')}, n_observed, n_rows FROM ({_stats_sql(_SLOG)})""")
def enc_06(x):
    s = encode.fit_preprocessor(seq_rows(x), ["a", "b", "c"])
    return r6(s.select("column", "fill", "mean", "sd", "n_observed", "n_rows"), "fill", "mean", "sd")


@query(
    "enc_07",
    f"""WITH st AS ({_stats_sql(_SLOG)}), lg AS ({" UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{n}' AS \"column\", {_SLOG.format(e='(' + e + ')')} AS v FROM f_lines" for n, e in _SEQ.items())})
SELECT "column", count(*) AS n, CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, {sr6('avg(z)', 'mean_scaled')}, {sr6('max(observed_mean)', 'observed_mean')} FROM (
 SELECT lg.*, observed_mean, CASE WHEN v IS NULL THEN -7e0 ELSE least(greatest((v - mean) / sd, -6e0), 6e0) END AS z FROM lg JOIN st USING ("column")) GROUP BY "column" """,
)
def enc_07(x):
    rows = seq_rows(x)
    st = encode.fit_preprocessor(rows, ["a", "b", "c"])
    z = encode.apply_preprocessor(rows, st, ["a", "b", "c"], key=["l_orderkey", "l_linenumber"], missing=-7.0)
    out = z.groupBy("column").agg(F.count("*").alias("n"), F.sum("missing").alias("missing"), F.avg("scaled").alias("mean_scaled"))
    return r6(out.join(st.select("column", "observed_mean"), "column"), "mean_scaled", "observed_mean")


@query(
    "enc_08",
    f"""WITH st AS (SELECT * FROM ({_stats_sql('{e}')}) WHERE "column" <> 'c'),
 nm AS ({" UNION ALL ".join(f"SELECT '{n}' AS \"column\", {e} AS v FROM f_lines" for n, e in _SEQ.items() if n != 'c')}),
 d AS (SELECT "column" AS covariate, "column", (coalesce(v, fill) - mean) / sd AS value FROM nm JOIN st USING ("column") UNION ALL
  SELECT "column" || '__missing', "column" || '__missing', 1 FROM nm WHERE v IS NULL UNION ALL
  SELECT 'status', 'status=' || CASE WHEN l_tax < 0.02 THEN '__missing__' ELSE l_linestatus END, 1 FROM f_lines)
SELECT covariate, "column", count(*) AS n, {sr6('sum(value * value)', 'sum_squares')} FROM d WHERE value <> 0 GROUP BY ALL""",
)
def enc_08(x):
    rows = seq_rows(x).join(x.lines.select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") >= 0.02, F.col("l_linestatus")).alias("status")),
                            ["l_orderkey", "l_linenumber"])
    d = encode.design_long(rows, key=["l_orderkey", "l_linenumber"], numeric=["a", "b"], categorical=["status"])
    return r6(d.groupBy("covariate", "column").agg(F.count("*").alias("n"), F.sum(F.col("value") * F.col("value")).alias("sum_squares")),
              "sum_squares")


