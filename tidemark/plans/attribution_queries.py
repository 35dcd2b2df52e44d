"""Attribution (INT) and model (MOD) queries with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.contract import TRAJECTORY_DRAWS, TRAJECTORY_VALID
from tidemark.functions.scalars import expit, hash32
from tidemark.operators import aggregates, attribution, cohort, encode, models
from tidemark.operators.splits import Slots
from tidemark.plans.catalog import query
from tidemark.plans.common import config_rows, r6, sr6
from tidemark.plans.metric_queries import code_long
from tidemark.plans.metric_sql import metrics_sql
from tidemark.plans.sqlviews import QUERY_DRAWS as D
from tidemark.plans.sqlviews import EVERY, h32, mult_sql
from tidemark.session import materialize

# margins carry a planted error on a few rows
_MARGIN = f"""(SELECT repeat, row_key, 0.1e0 * repeat AS base, 0.1e0 * repeat + sum(phi)
   + CASE WHEN {h32("concat_ws('|', 'm', repeat, row_key)")} % 500 = 0 THEN 0.01e0 ELSE 0e0 END AS margin FROM f_phi GROUP BY repeat, row_key)"""


@query("int_02", f"SELECT count(*) AS rows, count(*) FILTER (e > 1e-4) AS failed, {sr6('max(e)', 'max_error')} FROM (SELECT abs(s + base - margin) AS e FROM {_MARGIN} JOIN (SELECT repeat, row_key, sum(phi) AS s FROM f_phi GROUP BY ALL) USING (repeat, row_key))")
def int_02(x):
    off = F.when(hash32(F.lit("m"), "repeat", "row_key") % 500 == 0, 0.01).otherwise(0.0)
    t = x.targets
    total = ((F.col("l_quantity") - 25) / 100 * (1 + F.col("repeat") * F.lit(0.1)) + (F.col("l_discount") - F.lit(0.05)) * 3
             + (F.lit(0.04) - F.col("l_tax")) * 4 * F.col("repeat") + (F.col("l_extendedprice") - 50000) / 170017)
    base = F.lit(0.1) * F.col("repeat")
    rows = t.select("repeat", "row_key", base.alias("base"), (base + total + off).alias("margin"))
    return r6(attribution.additivity_errors(x.phi, rows), "max_error")


_GROUPED = """(SELECT repeat, row_key, stay, pod, "case", fold, feature, sum(abs(phi)) AS abs_sum, abs(sum(phi)) AS net_abs, sum(phi) AS signed,
   sum(CASE WHEN kind <> 'value' THEN abs(phi) ELSE 0 END) AS observation_abs FROM f_phi JOIN f_layout USING ("column") GROUP BY ALL)"""
_S4 = ("abs_sum", "net_abs", "signed", "observation_abs")


def grouped(x):
    return attribution.group_by_source(x.phi, x.layout, keys=("repeat", "row_key", "stay", "pod", "case", "fold"))


@query("int_03", f"SELECT repeat, row_key, feature, {', '.join(sr6(s, s) for s in _S4)} FROM {_GROUPED}")
def int_03(x):
    return r6(grouped(x).select("repeat", "row_key", "feature", *_S4), *_S4)


# each (repeat, fold) is a model; some do not select the rates or the price
_SELECTED = f"""(SELECT * FROM f_phi WHERE NOT ("column" IN ('discount', 'tax') AND {h32("concat_ws('|', 'sel', repeat, fold)")} % 3 = 0) AND NOT ("column" = 'price' AND repeat = 2))"""
_SOURCES = f"""(SELECT t.repeat, t.row_key, t.stay, t.pod, t."case", t.fold, u.feature, coalesce(sum(abs(phi)), 0) AS abs_sum, abs(coalesce(sum(phi), 0)) AS net_abs, coalesce(sum(phi), 0) AS signed,
   coalesce(sum(CASE WHEN kind <> 'value' THEN abs(phi) END), 0) AS observation_abs, CAST(count(phi) > 0 AS INTEGER) AS included
   FROM f_targets t CROSS JOIN (SELECT DISTINCT feature FROM f_layout) u LEFT JOIN (SELECT repeat, row_key, feature, kind, phi FROM {_SELECTED} JOIN f_layout USING ("column")) p
   ON p.repeat = t.repeat AND p.row_key = t.row_key AND p.feature = u.feature GROUP BY ALL)"""


def selected_phi(x):
    out = F.col("column").isin("discount", "tax") & (hash32(F.lit("sel"), "repeat", "fold") % 3 == 0) | (F.col("column") == "price") & (F.col("repeat") == 2)
    return x.phi.where(~out)


def sources(x):
    """Grouped attributions over the whole universe of features, with the flag of the model's selection."""
    keys = ("repeat", "row_key", "stay", "pod", "case", "fold")
    return attribution.group_by_source(selected_phi(x), x.layout, keys, rows=x.targets, universe=["quantity", "rate", "price"])


@query("int_03_sources", f"SELECT repeat, row_key, feature, included, {', '.join(sr6(s, s) for s in _S4)} FROM {_SOURCES}")
def int_03_sources(x):
    return r6(sources(x).select("repeat", "row_key", "feature", "included", *_S4), *_S4)


@query("int_03_identities", f"""WITH g AS (SELECT repeat, row_key, sum(abs_sum) AS pg, sum(signed) AS ps, max(abs(net_abs - abs(signed))) AS net FROM {_SOURCES} GROUP BY ALL),
 w AS (SELECT repeat, row_key, sum(abs(phi)) AS g, sum(phi) + CASE WHEN {h32("concat_ws('|', 'm', repeat, row_key)")} % 500 = 0 THEN 0.01e0 ELSE 0e0 END AS s FROM {_SELECTED} GROUP BY repeat, row_key),
 e AS (SELECT unnest(['gross', 'signed', 'net']) AS "identity", unnest([abs(w.g - pg), abs(w.s - ps), net]) AS e FROM g JOIN w USING (repeat, row_key))
 SELECT "identity", count(*) AS "rows", count(*) FILTER (e > 1e-4) AS failed, {sr6('max(e)', 'max_error')} FROM e GROUP BY 1""")
def int_03_identities(x):
    """Partition identities of the grouped form, against columns with a planted error on a few rows."""
    off = F.when((F.col("column") == "quantity") & (hash32(F.lit("m"), "repeat", "row_key") % 500 == 0), 0.01).otherwise(0.0)
    planted = selected_phi(x).withColumn("phi", F.col("phi") + off)
    gross = attribution.group_identities(selected_phi(x), sources(x)).where("identity <> 'signed'")
    return r6(gross.unionByName(attribution.group_identities(planted, sources(x)).where("identity = 'signed'")), "max_error")


@query("int_03_lags", f"SELECT feature, CAST(lag AS INTEGER) AS lag, {sr6('avg(m)', 'mean_abs')} FROM (SELECT repeat, feature, lag, sum(abs(phi)) / count(DISTINCT row_key) AS m FROM f_phi JOIN f_layout USING (\"column\") GROUP BY ALL) GROUP BY ALL")
def int_03_lags(x):
    return r6(attribution.lag_profile(x.phi, x.layout), "mean_abs")


@query("int_04", """SELECT entity, day, concat_ws(';', CASE WHEN rel >= 0 THEN 'post' END, 'all') AS overall, CASE WHEN rel < 0 THEN 'pre' WHEN rel <= 2 THEN '0-2' WHEN rel <= 7 THEN '3-7' WHEN rel <= 14 THEN '8-14'
  WHEN rel <= 31 THEN '15-31' ELSE '' END AS pods, CASE WHEN event IS NULL THEN '' WHEN event - day <= 3 THEN CAST(event - day AS VARCHAR) WHEN event - day <= 7 THEN '4-7' WHEN event - day <= 14 THEN '8-14'
  WHEN event - day <= 31 THEN '15-31' ELSE '>31' END AS leads FROM f_risk""")
def int_04(x):
    r = x.risk.withColumn("case", F.col("event").isNotNull().cast("int")).withColumn("lead", F.col("event") - F.col("day"))
    return r.select("entity", "day", *[F.array_join(attribution.strata(v, pod="rel"), ";").alias(n) for v, n in (("overall", "overall"), ("pod", "pods"), ("lead", "leads"))])


_CELLS = f"""sg AS MATERIALIZED (SELECT g.*, s.stratum FROM {_SOURCES} g, (SELECT unnest(['post', 'all']) AS stratum) s WHERE s.stratum = 'all' OR pod >= 0),
 cl AS (SELECT stratum, repeat, stay, feature, count(*) AS n, sum(abs_sum) AS abs_sum, sum(net_abs) AS net_abs, sum(signed) AS signed, sum(observation_abs) AS observation_abs FROM sg GROUP BY ALL),
 sl AS (SELECT stratum, feature, repeat, fold, max(included) AS i FROM sg GROUP BY ALL), sr AS (SELECT stratum, feature, repeat, max(i) AS i FROM sl GROUP BY ALL),
 sf AS (SELECT stratum, feature, sum(i) / count(*) AS selection_frequency, CAST(max(i) AS INTEGER) AS included FROM sl GROUP BY ALL),
 per AS (SELECT stratum, repeat, feature, {', '.join(f'sum({s}) / sum(n) AS {s}' for s in _S4)}, avg(abs_sum / n) AS equal_entity FROM cl GROUP BY ALL),
 rk AS (SELECT per.*, row_number() OVER (PARTITION BY stratum, repeat ORDER BY abs_sum DESC, feature) AS r, sr.i FROM per JOIN sr USING (stratum, repeat, feature)),
 pt AS (SELECT stratum, feature, {', '.join(f'avg({s}) AS {s}' for s in _S4)}, avg(equal_entity) AS equal_entity, CAST(min(r) AS INTEGER) AS rank_min, CAST(max(r) AS INTEGER) AS rank_max,
  {', '.join(f'avg(CASE WHEN r <= {k} AND i = 1 THEN 1e0 ELSE 0e0 END) AS top{k}' for k in (10, 20))} FROM rk GROUP BY ALL)"""


def _importance_draws_sql(mult: str) -> str:
    return f"""dr AS (SELECT draw, stratum, feature, avg(v) AS v, avg(e) AS e FROM (SELECT draw, stratum, repeat, feature, sum(m * abs_sum) / sum(m * n) AS v, sum(m * abs_sum / n) / sum(m) AS e FROM cl JOIN {mult} m ON m.stay = cl.stay GROUP BY ALL) GROUP BY ALL),
 dk AS (SELECT *, row_number() OVER (PARTITION BY draw, stratum ORDER BY v DESC, feature) AS r FROM dr)"""


_POINT05 = f"""stratum, feature, {', '.join(sr6(s, s) for s in _S4)}, {sr6('equal_entity', 'equal_entity')}, {sr6('abs_sum / sum(abs_sum) OVER (PARTITION BY stratum)', 'share')},
 {sr6('selection_frequency', 'selection_frequency')}, included, rank_min, rank_max, top10, top20"""
_CI05 = ("ci_lo", "ci_hi", "equal_entity_lo", "equal_entity_hi", "rank_lo", "rank_hi")


@query("int_05", f"""WITH {_CELLS}, {_importance_draws_sql('f_mult')},
 ci AS (SELECT stratum, feature, count(v) AS valid_draws, {', '.join(f'quantile_cont(CAST({c} AS DOUBLE), {q}) AS {n}_{end}' for c, n in (('v', 'ci'), ('e', 'equal_entity'), ('r', 'rank')) for q, end in ((0.025, 'lo'), (0.975, 'hi')))} FROM dk GROUP BY ALL)
SELECT {_POINT05}, valid_draws, {', '.join(sr6(s, s) for s in _CI05)} FROM pt JOIN ci USING (stratum, feature) JOIN sf USING (stratum, feature)""", drawn=True)
def int_05(x):
    out = attribution.importance(sources(x), x.weights, attribution.strata("overall"), draws=D)
    return r6(out, *_S4, "equal_entity", "share", "selection_frequency", *_CI05)


@query("int_05_point", f"WITH {_CELLS} SELECT {_POINT05} FROM pt JOIN sf USING (stratum, feature)")
def int_05_point(x):
    """The point columns of int_05: no draws."""
    none = Slots(x.targets.where("false").select("stay", F.lit(None).cast("long").alias("slot")), ())
    out = attribution.importance(sources(x), none, attribution.strata("overall"), draws=0)
    return r6(out.drop("valid_draws", *_CI05), *_S4, "equal_entity", "share", "selection_frequency")


@query("int_05_draws", f"""WITH {_CELLS}, {_importance_draws_sql('f_mult_some')}
SELECT draw, stratum, feature, {sr6('v', 'abs_sum')}, {sr6('e', 'equal_entity')}, CAST(r AS INTEGER) AS rank FROM dk UNION ALL
SELECT 0, stratum, feature, {sr6('abs_sum', 'abs_sum')}, {sr6('equal_entity', 'equal_entity')}, CAST(row_number() OVER (PARTITION BY stratum ORDER BY abs_sum DESC, feature) AS INTEGER) FROM pt""")
def int_05_draws(x):
    """Every ``EVERY``-th draw of the run that int_05 summarises."""
    drawn = attribution.importance_draws(sources(x), x.weights, attribution.strata("overall"), draws=D).where(F.col("draw") % EVERY == 0)
    return r6(drawn.select("draw", "stratum", "feature", "abs_sum", "equal_entity", F.col("rank").cast("int").alias("rank")), "abs_sum", "equal_entity")


_PAIRS = f"""b AS (SELECT CASE WHEN pod BETWEEN 0 AND 2 THEN 1 ELSE 2 END AS b, repeat, fold, stay, feature, avg(abs_sum) AS v FROM {_GROUPED} WHERE pod BETWEEN 0 AND 7 GROUP BY ALL),
 d AS (SELECT e.repeat, e.stay, e.feature, l.v - e.v AS diff FROM b e JOIN b l ON e.b = 1 AND l.b = 2 AND e.repeat = l.repeat AND e.fold = l.fold AND e.stay = l.stay AND e.feature = l.feature),
 dr AS (SELECT draw, feature, avg(v) AS v FROM (SELECT draw, repeat, feature, sum(m * diff) / sum(m) AS v FROM d JOIN {{mult}} m ON m.stay = d.stay GROUP BY ALL) GROUP BY ALL),
 pt AS (SELECT feature, avg(v) AS v FROM (SELECT repeat, feature, avg(diff) AS v FROM d GROUP BY ALL) GROUP BY feature)"""


@query("int_06_draws", f"""WITH {_PAIRS.format(mult='f_mult_some')}
SELECT draw, '0-2' AS earlier, '3-7' AS later, feature, {sr6('v', 'change')} FROM (SELECT draw, feature, v FROM dr UNION ALL SELECT 0, feature, v FROM pt)""")
def int_06_draws(x):
    """Every ``EVERY``-th draw of the run that int_06 summarises."""
    v = attribution.paired_change_draws(grouped(x), x.weights, draws=D).where(F.col("draw") % EVERY == 0)
    return r6(v.select("draw", "earlier", "later", "feature", F.col("value").alias("change")), "change")


@query("int_06", f"""WITH {_PAIRS.format(mult='f_mult')}
SELECT '0-2' AS earlier, '3-7' AS later, p.feature, {sr6('p.v', 'change')}, c.valid_draws, {sr6('c.lo', 'ci_lo')}, {sr6('c.hi', 'ci_hi')} FROM pt p JOIN
 (SELECT feature, count(v) AS valid_draws, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM dr GROUP BY feature) c USING (feature)""", drawn=True)
def int_06(x):
    return r6(attribution.paired_changes(grouped(x), x.weights, draws=D), "change", "ci_lo", "ci_hi")


@query("int_07", f"""WITH r AS (SELECT feature, avg(abs_sum) AS a FROM {_GROUPED} GROUP BY feature)
SELECT 'feature:' || feature AS "group", feature FROM (SELECT * FROM r ORDER BY a DESC, feature LIMIT 20) UNION ALL SELECT 'semantic:rates', 'rate' UNION ALL SELECT 'semantic:money', feature FROM f_layout WHERE feature = 'price'""")
def int_07(x):
    ranking = grouped(x).groupBy("feature").agg(F.avg("abs_sum").alias("abs_sum"))
    return attribution.permutation_groups(x.layout, ranking, fixed={"rates": ["rate"], "money": ["price"]})


# the price is derived from the quantity, the tax from the price
_NAMES = """n0 AS (SELECT "group", feature AS name FROM gr), """ + ", ".join(
    f"""n{k} AS (SELECT "group", name FROM n{k - 1} UNION SELECT n."group", unnest([l."column", l.feature]) FROM n{k - 1} n JOIN ly l ON n.name = l.feature OR n.name = l.dep)""" for k in range(1, 5))


@query("int_07_columns", f"""WITH r AS (SELECT feature, avg(abs_sum) AS a FROM {_GROUPED} GROUP BY feature),
 ly AS (SELECT *, CASE "column" WHEN 'price' THEN 'quantity' WHEN 'tax' THEN 'price' END AS dep FROM f_layout),
 gr AS (SELECT 'feature:' || feature AS "group", feature FROM (SELECT * FROM r ORDER BY a DESC, feature LIMIT 20) UNION ALL SELECT 'semantic:rates', 'rate' UNION ALL SELECT 'semantic:money', 'price'), {_NAMES}
SELECT "group", split_part("group", ':', 1) AS kind, name AS "column" FROM n4 WHERE name IN (SELECT "column" FROM ly)
UNION ALL SELECT 'lag:' || lag, 'lag', "column" FROM ly""")
def int_07_columns(x):
    """Columns that each permutation group moves: closures of sources, and lag blocks."""
    dep = F.when(F.col("column") == "price", F.array(F.lit("quantity"))).when(F.col("column") == "tax", F.array(F.lit("price")))
    return attribution.group_columns(x.layout.withColumn("dependencies", dep), int_07(x))


_LIN = "1e0 / (1e0 + exp(-(0.0213e0 * ({q} - 25) + 3.7e0 * ({d} - 0.05e0))))"
_TRIALS = 20


def _donor(trial: int) -> str:
    hs = h32(f"concat_ws('|', 'donor', repeat, {trial}, stay)")
    sh = h32(f"concat_ws('|', 'donor-shift', repeat, {trial}, pod, pat)")
    return f"""(WITH r AS (SELECT *, row_number() OVER (PARTITION BY repeat, pod, pat ORDER BY {hs}, stay) AS rank, count(*) OVER (PARTITION BY repeat, pod, pat) AS n FROM t)
 SELECT p.*, q.l_quantity AS dq, q.l_discount AS dd, q.stay AS donor FROM r p LEFT JOIN r q ON q.repeat = p.repeat AND q.pod = p.pod AND q.pat = p.pat
   AND q.rank = CASE WHEN p.n >= 5 THEN (p.rank - 1 + {sh.replace('repeat', 'p.repeat').replace('pod', 'p.pod').replace('pat)', 'p.pat)')} % (p.n - 1) + 1) % p.n + 1 END)"""


def _reliance_sql(mult: str) -> str:
    """ls (draw, scope, grp, v, e): losses by rows and by equal entities."""
    arms = "".join(
        f" UNION ALL SELECT repeat, stay, y, pod, '{g}', {k}, CASE WHEN donor IS NULL THEN {_LIN.format(q='l_quantity', d='l_discount')} ELSE {_LIN.format(q=q, d=d)} END FROM {_donor(k)}"
        for k in range(_TRIALS) for g, q, d in (("feature:quantity", "dq", "l_discount"), ("feature:rate", "l_quantity", "dd"), ("semantic:both", "dq", "dd")))
    return f"""t AS (SELECT *, CASE WHEN l_tax > 0.04 THEN '11' ELSE '01' END AS pat FROM f_targets),
 sc AS MATERIALIZED (SELECT repeat, stay, y, pod, '' AS grp, 0 AS trial, {_LIN.format(q='l_quantity', d='l_discount')} AS probability FROM t{arms}),
 sp AS (SELECT s.*, scope, 1e0 / count(*) OVER (PARTITION BY repeat, stay, grp, trial, scope) AS u FROM sc s, (SELECT unnest(['total', 'post']) AS scope) WHERE scope = 'total' OR pod >= 0),
 sw AS (SELECT *, 0 AS draw, 1 AS w, u AS wu FROM sp UNION ALL SELECT sp.*, m.draw, m.m, m.m * u FROM sp JOIN {mult} m ON m.stay = sp.stay),
 au AS (SELECT draw, repeat, scope, grp, avg(auc) AS auc, avg(eauc) AS eauc FROM ({metrics_sql('sw', 'draw, repeat, scope, grp, trial', w='w')})
   JOIN (SELECT draw, repeat, scope, grp, trial, auc AS eauc FROM ({metrics_sql('sw', 'draw, repeat, scope, grp, trial', w='wu')})) USING (draw, repeat, scope, grp, trial) GROUP BY ALL),
 ls AS (SELECT a.draw, a.scope, a.grp, avg(b.auc - a.auc) AS v, avg(b.eauc - a.eauc) AS e FROM au a JOIN au b ON b.draw = a.draw AND b.repeat = a.repeat AND b.scope = a.scope AND b.grp = '' WHERE a.grp <> '' GROUP BY ALL)"""


_ENDS08 = (("v", "ci"), ("e", "equal_entity"), ("r", "rank"))
_INT08 = f"""WITH {_reliance_sql('f_mult')},
 rk AS (SELECT *, row_number() OVER (PARTITION BY draw, scope, split_part(grp, ':', 1) ORDER BY v DESC, grp) AS r FROM ls),
 fin AS (SELECT scope, grp, max(CASE WHEN draw = 0 THEN v END) AS v, max(CASE WHEN draw = 0 THEN e END) AS e, max(CASE WHEN draw = 0 THEN r END) AS r, count(CASE WHEN draw > 0 THEN v END) AS n,
  {', '.join(f'quantile_cont(CASE WHEN draw > 0 THEN CAST({c} AS DOUBLE) END, {q}) AS {n}_{end}' for c, n in _ENDS08 for q, end in ((0.025, 'lo'), (0.975, 'hi')))} FROM rk GROUP BY ALL),
 cv AS (SELECT scope, avg(CASE WHEN donor IS NULL THEN 0e0 ELSE 1e0 END) AS c FROM {_donor(0)}, (SELECT unnest(['total', 'post']) AS scope) WHERE scope = 'total' OR pod >= 0 GROUP BY scope)
SELECT scope, grp AS "group", n AS valid_draws, {sr6('v', 'auc_loss')}, {sr6('e', 'equal_entity_loss')}, {', '.join(sr6(f'{n}_{end}', f'{n}_{end}') for _, n in _ENDS08 for end in ('lo', 'hi'))},
 {sr6('c', 'coverage')}, CAST(r AS INTEGER) AS rank FROM fin JOIN cv USING (scope)"""


def _reliance(x):
    """Rows, groups and the fixed model of the reliance queries."""
    rows = x.targets.select("repeat", "stay", "y", "pod", "l_quantity", "l_discount", F.when(F.col("l_tax") > 0.04, "11").otherwise("01").alias("pat"))

    def predict(df):
        return expit(F.lit(0.0213) * (df["l_quantity"] - 25) + F.lit(3.7) * (df["l_discount"] - F.lit(0.05)))

    return rows, {"feature:quantity": ["l_quantity"], "feature:rate": ["l_discount"], "semantic:both": ["l_quantity", "l_discount"]}, predict


@query("int_08", _INT08, drawn=True)
def int_08(x):
    rows, groups, predict = _reliance(x)
    out = attribution.grouped_reliance(rows, x.weights, groups, predict, match=["pod", "pat"], trials=_TRIALS, draws=D)
    return r6(out, "auc_loss", "equal_entity_loss", *[f"{n}_{end}" for _, n in _ENDS08 for end in ("lo", "hi")], "coverage")


_FEW = max(1, D // 4)


@query("int_08_draws", f"WITH mf AS ({mult_sql(D, every=_FEW)}), {_reliance_sql('mf')} SELECT draw, scope, grp AS \"group\", {sr6('v', 'auc_loss')}, {sr6('e', 'equal_entity_loss')} FROM ls")
def int_08_draws(x):
    """The point and every fourth part's last draw of the run that int_08 summarises."""
    rows, groups, predict = _reliance(x)
    swapped = attribution.donor_trials(rows, x.weights, ["l_discount", "l_quantity"], match=["pod", "pat"], trials=_TRIALS)
    v = attribution.reliance_draws(swapped, x.weights, groups, predict, draws=D).where(F.col("draw") % _FEW == 0)
    return r6(v, "auc_loss", "equal_entity_loss")


@query("int_09", f"SELECT feature, {sr6('g / sum(g) OVER ()', 'normalised_gain')} FROM (SELECT feature, sum(g) AS g FROM (SELECT \"column\", sum(phi * phi) AS g FROM f_phi GROUP BY 1) JOIN f_layout USING (\"column\") GROUP BY feature)")
def int_09(x):
    gain = x.phi.groupBy("column").agg(F.sum(F.col("phi") * F.col("phi")).alias("gain"))
    return r6(attribution.normalised_gain(gain, x.layout), "normalised_gain")


_TR = """tr AS (SELECT k.entity, k.day, k.rel AS pod, CASE WHEN k.event IS NULL THEN 0 ELSE 1 END AS cs, k.event, p.dose, CASE WHEN p.km IS NULL THEN NULL WHEN p.km > 90 THEN 9 WHEN p.km > 60 THEN 1 ELSE 0 END AS flag, k.rel >= -3 AS gate
   FROM f_risk k LEFT JOIN (SELECT entity, day, max(value) AS dose, max(k) AS km FROM f_point GROUP BY ALL) p ON p.entity = k.entity AND p.day = k.day),
 tv AS (SELECT a.*, b.day IS NOT NULL AS adj, b.dose AS pdose, b.flag AS pflag, b.gate AS pgate FROM tr a LEFT JOIN tr b ON b.entity = a.entity AND b.day = a.day - 1),
 {weights}
 cm AS (SELECT draw, day - event AS t, pod, sum(m) AS c FROM dw WHERE cs = 1 AND day - event BETWEEN -14 AND -1 GROUP BY ALL),
 km AS (SELECT draw, pod, sum(m) AS k FROM dw WHERE cs = 0 GROUP BY ALL),
 df AS (SELECT draw, t, count(k) = count(*) AS ok FROM cm LEFT JOIN km USING (draw, pod) GROUP BY ALL),
 al AS (SELECT dw.*, 'index' AS alignment, pod AS t, CASE WHEN cs = 1 THEN 'case' ELSE 'control' END AS cohort, CAST(m AS DOUBLE) AS w FROM dw WHERE pod BETWEEN -14 AND 31 UNION ALL
  SELECT dw.*, 'event', day - event, 'case', CAST(m AS DOUBLE) FROM dw WHERE cs = 1 AND day - event BETWEEN -14 AND -1 UNION ALL
  SELECT dw.*, 'event', cm.t, 'standardized_control', CAST(dw.m * cm.c AS DOUBLE) / km.k FROM dw JOIN cm ON cm.draw = dw.draw AND cm.pod = dw.pod JOIN km ON km.draw = dw.draw AND km.pod = dw.pod WHERE cs = 0),
 fl AS (SELECT draw, alignment, t, cohort, w, entity, adj, 'dose' AS feature, CASE WHEN gate THEN dose END AS x, CASE WHEN gate AND pgate THEN dose - pdose END AS dx, dose IS NULL AS nul, FALSE AS unk, NOT gate AS closed,
    adj AND ((dose IS NOT NULL AND gate) <> (coalesce(pdose IS NOT NULL AND pgate, FALSE))) AS sw FROM al UNION ALL
  SELECT draw, alignment, t, cohort, w, entity, adj, 'flag', CASE WHEN flag <> 9 THEN CAST(flag AS DOUBLE) END, CASE WHEN flag <> 9 AND pflag <> 9 THEN CAST(flag - pflag AS DOUBLE) END, flag IS NULL, coalesce(flag = 9, FALSE), FALSE,
    adj AND (coalesce(flag <> 9, FALSE) <> coalesce(pflag <> 9, FALSE)) FROM al)"""


def _wq(col: str, q: float, alias: str) -> str:
    return f"min(CASE WHEN c_{col} >= ({q} - 1e-9) * t_{col} AND {col} IS NOT NULL THEN {col} END) AS {alias}"


_TRQ = """SELECT draw, alignment, t, cohort, feature, count(*) AS "rows", count(DISTINCT entity) AS entities, count(x) AS nonmissing, count(*) FILTER (adj) AS adjacent_pairs, count(dx) AS pairs,
  count(*) FILTER (abs(dx) > 1e-6) AS changes, count(*) FILTER (sw) AS switches, sum(CASE WHEN nul THEN w ELSE 0 END) / sum(w) AS null_fraction, sum(CASE WHEN unk THEN w ELSE 0 END) / sum(w) AS unknown_fraction,
  sum(CASE WHEN closed THEN w ELSE 0 END) / sum(w) AS closed_fraction, sum(x * w) / sum(CASE WHEN x IS NOT NULL THEN w END) AS mean, """ + ", ".join(
    [_wq("x", 0.25, "q25"), _wq("x", 0.5, "median"), _wq("x", 0.75, "q75"), _wq("dx", 0.5, "delta_median")]) + """
 FROM (SELECT *, sum(CASE WHEN x IS NOT NULL THEN w ELSE 0 END) OVER (PARTITION BY draw, alignment, t, cohort, feature ORDER BY x) AS c_x, sum(CASE WHEN x IS NOT NULL THEN w ELSE 0 END) OVER (PARTITION BY draw, alignment, t, cohort, feature) AS t_x,
   sum(CASE WHEN dx IS NOT NULL THEN w ELSE 0 END) OVER (PARTITION BY draw, alignment, t, cohort, feature ORDER BY dx) AS c_dx, sum(CASE WHEN dx IS NOT NULL THEN w ELSE 0 END) OVER (PARTITION BY draw, alignment, t, cohort, feature) AS t_dx FROM fl)
 GROUP BY draw, alignment, t, cohort, feature"""

_PLAIN = "dw AS (SELECT tv.*, 0 AS draw, 1 AS m FROM tv),"
_HIDE = ("q25", "median", "q75", "delta_median", "null_fraction", "unknown_fraction", "closed_fraction")


@query("int_10", f"""WITH {_TR.format(weights=_PLAIN)} SELECT alignment, t, cohort, feature, "rows", entities, nonmissing, adjacent_pairs, pairs, changes, switches,
 CASE WHEN ok THEN round(CASE WHEN feature = 'flag' THEN mean ELSE median END, 6) + 0e0 END AS estimate, {', '.join(f'CASE WHEN ok THEN round({c}, 6) + 0e0 END AS {c}' for c in _HIDE)}, CAST(ok AS INTEGER) AS defined
 FROM (SELECT q.*, CASE WHEN cohort = 'standardized_control' THEN df.ok ELSE TRUE END AS ok FROM ({_TRQ}) q LEFT JOIN df ON df.draw = q.draw AND df.t = q.t)""")
def int_10(x):
    out = attribution.trajectories(trajectory_rows(x), _TR_FEATURES)
    return r6(out.drop("draw"), "estimate", *_HIDE)


_TR_FEATURES = {"dose": {"kind": "continuous", "gate": "gate"}, "flag": {"kind": "binary", "unknown": (9,)}}


def trajectory_rows(x):
    daily = x.point.groupBy("entity", "day").agg(F.max("value").alias("dose"), F.max("k").alias("km"))
    km = F.col("km")
    return x.risk.join(daily, ["entity", "day"], "left").select(
        "entity", "day", F.col("rel").alias("pod"), F.col("event").isNotNull().cast("int").alias("case"), F.col("event").alias("event_day"), "dose",
        F.when(km > 90, 9).when(km > 60, 1).when(km.isNotNull(), 0).alias("flag"), (F.col("rel") >= -3).alias("gate"))


def _trajectory_draws(x):
    from tidemark.operators import splits

    rows = trajectory_rows(x)
    ent = rows.groupBy("entity").agg(F.max("case").alias("case"))
    w = splits.bootstrap_slots(ent, entity="entity")
    return attribution.trajectory_draws(rows, _TR_FEATURES, w, draws=TRAJECTORY_DRAWS)


@query("int_10_draws")
def int_10_draws(x):
    """Intervals of trajectory estimates and of paired changes over all shared entity draws."""
    from tidemark.operators import metrics

    drawn, cell = materialize(_trajectory_draws(x)), ["alignment", "t", "cohort", "feature"]
    out = metrics.interval_summary(drawn, cell, value="estimate", draws=TRAJECTORY_DRAWS, minimum=TRAJECTORY_VALID)
    delta = metrics.interval_summary(drawn, cell, value="delta", draws=TRAJECTORY_DRAWS, minimum=TRAJECTORY_VALID)
    return out.join(delta.select(*cell, *[F.col(c).alias(f"delta_{c}") for c in ("estimate", "valid_draws", "ci_lo", "ci_hi")]), cell)


_EACH = TRAJECTORY_DRAWS // 10
_SOME = "mu AS (" + mult_sql(TRAJECTORY_DRAWS, '(SELECT entity AS stay, max(cs) AS "case" FROM tr GROUP BY entity)', every=_EACH) + """),
 dw AS (SELECT tv.*, 0 AS draw, 1 AS m FROM tv UNION ALL SELECT tv.*, mu.draw, mu.m FROM tv JOIN mu ON mu.stay = tv.entity),"""


@query("int_10_every", f"""WITH {_TR.format(weights=_SOME)} SELECT draw, alignment, CAST(t AS INTEGER) AS t, cohort, feature, CASE WHEN ok THEN round(CASE WHEN feature = 'flag' THEN mean ELSE median END, 6) + 0e0 END AS estimate,
 CASE WHEN ok THEN round(delta_median, 6) + 0e0 END AS delta
 FROM (SELECT q.*, CASE WHEN cohort = 'standardized_control' THEN df.ok ELSE TRUE END AS ok FROM ({_TRQ}) q LEFT JOIN df ON df.draw = q.draw AND df.t = q.t) WHERE nonmissing > 0 OR pairs > 0""")
def int_10_every(x):
    """Every hundredth draw of the run that int_10_draws summarises."""
    return r6(_trajectory_draws(x).where(F.col("draw") % _EACH == 0), "estimate", "delta")


@query("int_11", f"""SELECT unnest(['unexplained', 'explained_twice', 'outside_targets', 'mixed_models']) AS "check", unnest([count(*) FILTER (d = 1), count(*) FILTER (d = 2), count(*) FILTER (d = 3),
  (SELECT count(*) FROM (SELECT repeat, fold FROM (SELECT *, {h32("concat_ws('|', 'cov', repeat, row_key)")} % 900 AS d FROM f_targets) WHERE d NOT IN (1) GROUP BY ALL HAVING min(CASE WHEN repeat = 2 AND d = 4 THEN 'b' ELSE 'a' END) <> max(CASE WHEN repeat = 2 AND d = 4 THEN 'b' ELSE 'a' END)))]) AS n
FROM (SELECT *, {h32("concat_ws('|', 'cov', repeat, row_key)")} % 900 AS d FROM f_targets)""")
def int_11(x):
    d = hash32(F.lit("cov"), "repeat", "row_key") % 900
    t = x.targets.select("stay", "repeat", "row_key", "fold", d.alias("d"))
    model = F.when((F.col("repeat") == 2) & (F.col("d") == 4), "b").otherwise("a")
    copies = F.when(F.col("d") == 1, 0).when(F.col("d") == 2, 2).otherwise(1)
    e = t.withColumn("model_id", model).withColumn("i", F.explode(F.array_repeat(F.lit(1), copies)))
    return attribution.coverage(e.select("stay", "repeat", "row_key", "fold", "model_id"), t.where("d <> 3").select("stay", "repeat", "row_key"), within="stay")


# --- models ---

_COLS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


# Bounds of the fits: most rounds, and rounds without a better AUC after which a fit stops.
_ROUNDS, _PATIENCE = 64, 5
_POST_DAY = 3  # primary rows: days from here on


def model_rows(x):
    return x.lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_key"), F.col("l_orderkey").alias("stay"), F.col("l_linenumber").cast("int").alias("day"), *_COLS,
                          ((F.col("l_quantity") > 30) != (F.col("l_discount") > 0.07)).cast("int").alias("y"),
                          (hash32(F.lit("inner"), "l_orderkey") % 4).cast("int").alias("fold"))


@query("mod_01")
def mod_01(x):
    """One inner fit: AUC of the primary validation rows after every round, and the round at which it stops."""
    rows = model_rows(x)
    stop, history, _ = models.stopped_fit(rows.where("fold not in (0, 3)"), rows.where("fold = 0"), _COLS, primary=F.col("day") >= _POST_DAY, patience=_PATIENCE, max_rounds=_ROUNDS)
    return config_rows(x.spark, ["round", "auc", "chosen"], [(r, a, int(r == stop)) for r, a in history])


def _program(x):
    rows = model_rows(x)
    return rows, *models.tree_program(rows.where("fold < 3"), rows.where("fold = 3"), _COLS, fold="fold", keep=["row_key", "stay", "y"], rounds=_ROUNDS, patience=_PATIENCE, primary=F.col("day") >= _POST_DAY)


@query("mod_02")
def mod_02(x):
    """Apply the refitted program: coverage of the requested rows and their AUC."""
    from tidemark.operators import metrics

    rows, p, info = _program(x)
    want = rows.where("fold = 3").select("row_key")
    missing = want.join(p, "row_key", "left_anti").agg(F.count("*").alias("c")).select("c").scalar()
    m = metrics.rank_metrics(p.withColumn("g", F.lit("test")), ["g"])
    return m.select(F.col("g").alias("part"), "n_pos", "n_neg", "auc", missing.alias("missing"), F.lit(info["rounds"]).alias("rounds"))


@query("mod_03")
def mod_03(x):
    model = models.fit_trees(model_rows(x).where("fold < 3"), _COLS, rounds=20)
    return models.gain_ranking(model, _COLS, x.spark)


@query("mod_04")
def mod_04(x):
    """Encoded program: cross-fitted code rates on the pool, full-pool rates on the test rows, then the tree program."""
    from tidemark.operators import metrics

    rows, codes = model_rows(x), code_long(x)
    pool, test = rows.where("fold < 3"), rows.where("fold = 3")
    labels = pool.groupBy(F.col("stay").alias("entity")).agg(F.max("y").alias("label"), F.min("fold").alias("fold"))
    own = encode.crossfit_encode(labels, codes, entity="entity", fold="fold", single=["type"], multi=["brand"]).drop("fold")
    rates = encode.fit_rates(labels, codes, entity="entity")
    full = encode.apply_rates(test.select(F.col("stay").alias("entity")).distinct(), codes, rates, labels, entity="entity", single=["type"], multi=["brand"])
    cols = [*_COLS, "type", "brand_mean", "brand_max", "brand_count"]
    join = lambda r, e: r.join(e.withColumnRenamed("entity", "stay"), "stay")
    p, info = models.tree_program(join(pool, own), join(test, full), cols, fold="fold", keep=["row_key", "y"], rounds=_ROUNDS, patience=_PATIENCE, primary=F.col("day") >= _POST_DAY)
    m = metrics.rank_metrics(p.withColumn("g", F.lit("encoded")), ["g"])
    return m.select(F.col("g").alias("arm"), "n_pos", "n_neg", "auc", F.lit(info["rounds"]).alias("rounds"))


@query("mod_05")
def mod_05(x):
    """Fixed feature-slice arms over the same rows, windows of one and of seven days: three inner fits that stop early, their median round, a refit."""
    from tidemark.operators import metrics

    rows, out = model_rows(x), []
    for arm in models.slice_arms(["l_tax"], {"quantity": ["l_quantity"], "price": ["l_discount", "l_extendedprice"]}):
        framed = materialize(models.slice_frame(rows, arm, keys=["stay", "y", "fold", "day"], entity="stay", day="day"))
        scored, _ = models.tree_program(
            framed.where("fold < 3"), framed.where("fold = 3"), arm["columns"], fold="fold", keep=["y"], rounds=_ROUNDS, patience=_PATIENCE, primary=F.col("day") >= _POST_DAY)
        out.append(scored.select("y", "probability", F.lit(arm["arm"]).alias("arm"), F.lit(len(arm["columns"])).alias("columns")))
    return metrics.rank_metrics(aggregates.union_all(out), ["arm", "columns"])


_FITS = """SELECT p_type AS arm, CAST(l_linenumber % 3 AS INTEGER) AS fold, CAST(l_suppkey % 3 AS INTEGER) AS init,
  CASE WHEN count(*) FILTER (p_size = 50 AND l_quantity = 50) > 40 THEN 'failed' ELSE 'completed' END AS status, CAST(min(l_partkey) % 60 + 1 AS BIGINT) AS best_round,
  avg(CASE WHEN p_type = 'PROMO' THEN NULL ELSE l_discount END) AS auc FROM f_lines JOIN part ON p_partkey = l_partkey GROUP BY ALL"""


@query("mod_06_rounds", f"""WITH fits AS ({_FITS}), pf AS (SELECT arm, fold, avg(auc) AS auc, count(DISTINCT init) = 3 AND count(*) = 3 AND count(*) FILTER (status = 'completed' AND best_round >= 1) = 3 AND count(auc) = 3 AS ok FROM fits GROUP BY ALL),
 pa AS (SELECT arm, avg(auc) AS auc, bool_and(ok) AND count(*) = 3 AS ok FROM pf GROUP BY arm)
SELECT arm, CAST(ok AS INTEGER) AS complete, CASE WHEN ok THEN (SELECT CAST(floor(median(best_round)) AS BIGINT) FROM fits f WHERE f.arm = pa.arm) END AS rounds, CASE WHEN ok THEN round(auc, 6) + 0e0 END AS mean_auc FROM pa""")
def mod_06_rounds(x):
    """Median of the stopping rounds over folds and initialisations; an arm with a failed or unscored fit has none."""
    p = x.table("part").select("p_partkey", F.col("p_type").alias("arm"), "p_size")
    lines = x.lines.join(p, F.col("l_partkey") == F.col("p_partkey"))
    fits = lines.groupBy("arm", (F.col("l_linenumber") % 3).alias("fold"), (F.col("l_suppkey") % 3).alias("init")).agg(
        F.when(F.count_if((F.col("p_size") == 50) & (F.col("l_quantity") == 50)) > 40, "failed").otherwise("completed").alias("status"),
        (F.min("l_partkey") % 60 + 1).cast("long").alias("best_round"), F.avg(F.when(F.col("arm") != "PROMO", F.col("l_discount"))).alias("auc"))
    return r6(models.stopping_summary(fits), "mean_auc")


@query("mod_06", f"SELECT repeat, row_key, CASE WHEN count(p) = count(*) THEN {sr6('avg(p)', 'x').rsplit(' AS ', 1)[0]} END AS probability, count(*) AS members FROM (SELECT repeat, row_key, CASE WHEN arm = 'noise' AND pod = 4 THEN NULL ELSE probability END AS p FROM f_scores) GROUP BY ALL")
def mod_06(x):
    p = x.scores.withColumn("probability", F.when(~((F.col("arm") == "noise") & (F.col("pod") == 4)), F.col("probability")))
    return r6(models.ensemble_mean(p, ["repeat", "row_key"], within="stay"), "probability")


@query("mod_07")
def mod_07(x):
    rows = model_rows(x).withColumn("arm_a", (F.col("l_tax") > 0.04).cast("int"))
    cols = ["l_quantity", "l_discount", "l_extendedprice"]
    return models.treatment_model(rows, cols, label="arm_a", keep=["row_key", "arm_a"])


@query("mod_08", f"""SELECT row_key, c AS "column", {sr6("CASE c WHEN 'l_quantity' THEN 0.02e0 * (l_quantity - mq) ELSE -1.5e0 * (l_discount - md) END", 'phi')} FROM
 (SELECT concat_ws('-', l_orderkey, l_linenumber) AS row_key, l_quantity, l_discount FROM f_lines), (SELECT avg(l_quantity) AS mq, avg(l_discount) AS md FROM f_lines), (SELECT unnest(['l_quantity', 'l_discount']) AS c)""")
def mod_08(x):
    rows = x.lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_key"), "l_quantity", "l_discount")
    return r6(models.linear_contributions(rows, {"l_quantity": 0.02, "l_discount": -1.5}, keep=["row_key"]), "phi")


@query("cau_13_smd", """WITH r AS (SELECT row_number() OVER () AS id, CAST(l_tax > 0.04 AS INTEGER) AS a, 0.2e0 + l_quantity / 100 AS p, CASE WHEN l_suppkey % 7 > 0 THEN l_quantity END AS v1, l_extendedprice AS v2, l_linestatus AS st FROM f_lines),
 st AS (SELECT median(v1) AS f1, (SELECT avg(coalesce(v1, (SELECT median(v1) FROM r))) FROM r) AS m1, (SELECT stddev_pop(coalesce(v1, (SELECT median(v1) FROM r))) FROM r) AS s1, avg(v2) AS m2, stddev_pop(v2) AS s2, avg(a) AS q FROM r),
 d AS (SELECT a, CASE WHEN a = 1 THEN q / p ELSE (1 - q) / (1 - p) END AS w, (coalesce(v1, f1) - m1) / s1 AS c1, CAST(v1 IS NULL AS INTEGER) AS c2, (v2 - m2) / s2 AS c3, CAST(st = 'O' AS INTEGER) AS c4, CAST(st = 'F' AS INTEGER) AS c5 FROM r, st),
 l AS (SELECT a, w, k.cov, k.col, CASE k.col WHEN 'l_quantity' THEN c1 WHEN 'l_quantity__missing' THEN c2 WHEN 'l_extendedprice' THEN c3 WHEN 'status=O' THEN c4 ELSE c5 END AS v FROM d,
   (VALUES ('l_quantity', 'l_quantity'), ('l_quantity__missing', 'l_quantity__missing'), ('l_extendedprice', 'l_extendedprice'), ('status', 'status=O'), ('status', 'status=F')) k(cov, col)),
 s AS (SELECT cov, col, abs(avg(v) FILTER (a = 1) - avg(v) FILTER (a = 0)) AS dd, abs(sum(v * w) FILTER (a = 1) / sum(w) FILTER (a = 1) - sum(v * w) FILTER (a = 0) / sum(w) FILTER (a = 0)) AS dw,
   sqrt((var_pop(v) FILTER (a = 1) + var_pop(v) FILTER (a = 0)) / 2) AS sd FROM l GROUP BY cov, col)
SELECT cov AS covariate, count(*) AS "columns", round(max(dd / sd), 6) + 0e0 AS smd_before, round(max(dw / sd), 6) + 0e0 AS smd_after, CAST(0 AS BIGINT) AS undefined FROM s GROUP BY cov""")
def cau_13_smd(x):
    rows = x.lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), (F.col("l_tax") > 0.04).cast("int").alias("a"), (F.lit(0.2) + F.col("l_quantity") / 100).alias("p"),
                          F.when(F.col("l_suppkey") % 7 > 0, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice", F.col("l_linestatus").alias("status"))
    design = encode.design_long(rows, key=["id"], numeric=["l_quantity", "l_extendedprice"], categorical=["status"])
    return r6(cohort.standardized_differences(design, rows, key="id", arm="a", propensity="p"), "smd_before", "smd_after")
