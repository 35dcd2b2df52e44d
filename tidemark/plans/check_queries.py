"""Contract-check (VAL), filter (FLT) and remaining panel (PAN-27..35) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates, checks, panel
from tidemark.plans.catalog import query
from tidemark.plans.common import longs, r6, sr6
from tidemark.plans.panel_queries import _gate_sql, pan_17, union_state_frame
from tidemark.plans.sqlviews import h32
from tidemark.sources import tables as src

K = ["entity", "day"]


def rules_sql(source: str, rules: dict[str, tuple[str, str]], key: str) -> str:
    """One (check, n, sample_key) row per rule: rule -> (from/where tail, key expression or default)."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", count(*) AS n, min({k or key}) AS sample_key FROM {source_ or source} WHERE {cond}"
        for name, (cond, k, source_) in {n: (*v, None)[:3] if len(v) == 2 else v for n, v in rules.items()}.items()
    )


_LK = "concat_ws('|', l_orderkey, l_linenumber)"


@query(
    "val_01",
    "WITH r AS (SELECT l_orderkey AS entity, CASE WHEN l_partkey % 97 = 0 THEN l_linenumber + 0.5e0 ELSE l_linenumber END AS day,"
    " CASE WHEN l_suppkey % 37 <> 0 THEN concat_ws('-', l_orderkey, l_partkey, l_suppkey) END AS rid FROM lineitem) "
    + rules_sql("r", {
        "null_entity": ("entity IS NULL", ""),
        "null_or_fractional_day": ("day <> floor(day)", ""),
        "null_row_id": ("rid IS NULL", ""),
        "duplicate_entity_day": ("c > 1", "", "(SELECT entity, day, count(*) AS c FROM r GROUP BY entity, day)"),
        "duplicate_row_id": ("c > 1", "rid", "(SELECT rid, count(*) AS c FROM r WHERE rid IS NOT NULL GROUP BY rid)"),
    }, "concat_ws('|', entity, day)"),
)
def val_01(x):
    day = F.when(F.col("l_partkey") % 97 == 0, F.col("l_linenumber") + 0.5).otherwise(F.col("l_linenumber").cast("double"))
    rid = F.when(F.col("l_suppkey") % 37 != 0, F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey"))
    df = x.table("lineitem").select(F.col("l_orderkey").alias("entity"), day.alias("day"), rid.alias("rid"))
    return checks.check_keys(df, entity="entity", day="day", row_id="rid")


@query(
    "val_02",
    "WITH r AS (SELECT CASE WHEN user_id % 10 = 0 THEN NULL WHEN user_id % 10 = 1 THEN ' . ' ELSE CAST(user_id AS VARCHAR)"
    " END AS entity FROM events) "
    + rules_sql("r", {"null_id": ("entity IS NULL", "coalesce(entity, '')"), "blank_id": ("trim(entity) = '.'", "")}, "entity"),
)
def val_02(x):
    u = F.col("user_id")
    e = F.when(u % 10 == 0, F.lit(None).cast("string")).when(u % 10 == 1, F.lit(" . ")).otherwise(u.cast("string"))
    return checks.check_entity_ids(x.table("events").select(e.alias("entity")), "entity")


@query(
    "val_03",
    rules_sql("", {
        "duplicate_anchor": ("c > 1", "", "(SELECT c_custkey AS entity, count(*) AS c FROM customer GROUP BY 1)"),
        "entity_without_anchor": ("TRUE", "", "(SELECT DISTINCT o_custkey AS entity FROM orders WHERE o_custkey NOT IN"
                                  " (SELECT c_custkey FROM customer WHERE c_nationkey <> 3))"),
        "fractional_anchor": ("c_acctbal <> floor(c_acctbal)", "", "(SELECT c_custkey AS entity, c_acctbal FROM customer WHERE c_nationkey <> 3)"),
        "index_before_start": ("c_nationkey < c_acctbal", "", "(SELECT c_custkey AS entity, c_acctbal, c_nationkey FROM customer WHERE c_nationkey <> 3)"),
    }, "CAST(entity AS VARCHAR)"),
)
def val_03(x):
    keys = x.table("orders").select(F.col("o_custkey").alias("entity"))
    anchors = x.table("customer").where("c_nationkey <> 3").select(
        F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("adm"), F.col("c_nationkey").alias("idx"))
    return checks.check_anchors(keys, anchors, entity="entity", start="adm", index="idx")


# targets with planted defects: wrong labels, a moved case flag, a missing row, a second fold
_DEFECT = h32("concat_ws('|', 'defect', repeat, row_key)") + " % 1000"
_BADT = f"""bt AS (SELECT repeat, row_key, stay, CASE WHEN d = 1 THEN 2 ELSE y END AS y, pod,
   CASE WHEN d = 2 THEN 1 - "case" ELSE "case" END AS "case", CASE WHEN d = 3 THEN 4 - fold ELSE fold END AS fold
   FROM (SELECT *, {_DEFECT} AS d FROM f_targets) WHERE d <> 4)"""


def bad_targets(x):
    from tidemark.functions.scalars import hash32

    d = hash32(F.lit("defect"), "repeat", "row_key") % 1000
    t = x.targets.withColumn("d", d).where("d <> 4")
    return t.select("repeat", "row_key", "stay", F.when(F.col("d") == 1, 2).otherwise(F.col("y")).alias("y"), "pod",
                    F.when(F.col("d") == 2, 1 - F.col("case")).otherwise(F.col("case")).alias("case"),
                    F.when(F.col("d") == 3, 4 - F.col("fold")).otherwise(F.col("fold")).alias("fold"))


def _varies(col: str, group: str) -> str:
    return f"(SELECT {group}, min({col}) AS lo, max({col}) AS hi FROM bt GROUP BY {group})"


@query(
    "val_05",
    f"WITH {_BADT} "
    + rules_sql("bt", {
        "missing_metadata": ("FALSE", ""),
        "label_not_binary": ("y NOT IN (0, 1)", ""),
        "case_not_binary": ("\"case\" NOT IN (0, 1)", ""),
        "positive_row_of_control": ("y = 1 AND \"case\" = 0", ""),
        "rel_day_not_integer": ("FALSE", ""),
        "unknown_repeat": ("repeat NOT IN (1, 2, 3, 4)", ""),
        "positive_row_before_index": ("y = 1 AND pod < 0", ""),
        "fold_out_of_range": ("fold NOT BETWEEN 0 AND 4", ""),
        "duplicate_target": ("c > 1", "", "(SELECT repeat, row_key, count(*) AS c FROM bt GROUP BY ALL)"),
        "duplicate_entity_day": ("c > 1", "concat_ws('|', repeat, stay, pod)", "(SELECT repeat, stay, pod, count(*) AS c FROM bt GROUP BY ALL)"),
        "case_varies": ("lo <> hi", "CAST(stay AS VARCHAR)", _varies('"case"', "stay")),
        "stay_varies_across_repeats": ("lo <> hi", "row_key", _varies("stay", "row_key")),
        "y_varies_across_repeats": ("lo <> hi", "row_key", _varies("y", "row_key")),
        "pod_varies_across_repeats": ("lo <> hi", "row_key", _varies("pod", "row_key")),
        "case_varies_across_repeats": ("lo <> hi", "row_key", _varies('"case"', "row_key")),
        "entity_in_two_folds": ("lo <> hi", "concat_ws('|', repeat, stay)", _varies("fold", "repeat, stay")),
        "repeat_without_all_folds": ("c < 5", "CAST(repeat AS VARCHAR)", "(SELECT repeat, count(DISTINCT fold) AS c FROM bt GROUP BY repeat)"),
    }, "concat_ws('|', repeat, row_key)"),
)
def val_05(x):
    return checks.check_targets(bad_targets(x), repeats=[1, 2, 3, 4], folds=5, allow_pre_positive=False)


_PRED = h32("concat_ws('|', 'pred', arm, row_key)") + " % 500"
_BADP = f"""bp AS (SELECT repeat, row_key, arm, stay, CASE WHEN d = 1 THEN 1 - y ELSE y END AS y, pod, "case",
  CASE WHEN d = 2 THEN probability + 2 ELSE probability END AS probability
  FROM (SELECT *, {_PRED} AS d FROM f_scores WHERE arm <> 'noise') WHERE d <> 3),
ft AS (SELECT *, {h32("concat_ws('|', 'tgt', row_key)")} % 700 AS dt FROM f_targets),
tt AS (SELECT * FROM ft, (SELECT unnest(['ties', 'fine']) AS arm) WHERE dt <> 5)"""


@query(
    "val_06",
    f"WITH {_BADP}, j AS (SELECT coalesce(t.arm, p.arm) AS arm, coalesce(t.repeat, p.repeat) AS repeat,"
    " coalesce(t.row_key, p.row_key) AS row_key, t.arm AS ta, p.arm AS pa, t.y AS ty, p.y AS py, p.probability"
    " FROM tt t FULL JOIN bp p ON t.arm = p.arm AND t.repeat = p.repeat AND t.row_key = p.row_key) "
    + rules_sql("j", {
        "prediction_missing": ("pa IS NULL", ""),
        "prediction_without_target": ("ta IS NULL", ""),
        "metadata_differs": ("pa IS NOT NULL AND ta IS NOT NULL AND ty <> py", ""),
        "invalid_probability": ("probability > 1", ""),
        "duplicate_prediction": ("FALSE", ""),
    }, "concat_ws('|', arm, repeat, row_key)"),
)
def val_06(x):
    from tidemark.functions.scalars import hash32

    d = hash32(F.lit("pred"), "arm", "row_key") % 500
    p = x.scores.where("arm <> 'noise'").withColumn("d", d).where("d <> 3")
    p = p.select("repeat", "row_key", "arm", "stay", F.when(F.col("d") == 1, 1 - F.col("y")).otherwise(F.col("y")).alias("y"),
                 "pod", "case", F.when(F.col("d") == 2, F.col("probability") + 2).otherwise(F.col("probability")).alias("probability"))
    t = x.targets.where(hash32(F.lit("tgt"), "row_key") % 700 != 5)
    return checks.check_predictions(t, p, within="stay")


@query(
    "val_07",
    """SELECT CASE WHEN lo = hi THEN 'kept' ELSE 'conflict' END AS outcome, count(*) AS n FROM (
  SELECT min(p) AS lo, max(p) AS hi FROM (
    SELECT l_orderkey, CASE WHEN l_suppkey % 10 = 0 THEN concat('row', l_partkey, '|', l_suppkey, '|', l_shipdate, '|', l_returnflag)
        ELSE concat('id', l_linenumber) END AS rid,
      concat_ws('|', l_partkey, l_suppkey, l_shipdate, l_returnflag) AS p FROM lineitem) GROUP BY l_orderkey, rid)
GROUP BY outcome""",
)
def val_07(x):
    rid = F.when(F.col("l_suppkey") % 10 != 0, F.col("l_linenumber").cast("string")).otherwise("")
    df = x.table("lineitem").withColumn("rid", rid)
    kept, bad = checks.unique_records(df, entity="l_orderkey", record="rid",
                                      payload=["l_partkey", "l_suppkey", "l_shipdate", "l_returnflag"])
    return aggregates.union_all([kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("outcome"), "n"),
                                 bad.agg(F.count("*").alias("n")).select(F.lit("conflict").alias("outcome"), "n")])


@query(
    "val_08",
    """SELECT CAST(idx AS INTEGER) AS is_index, CAST(idx AND d <> od AS INTEGER) AS date_conflict, count(*) AS n FROM (
  SELECT l.l_orderkey = m.op AS idx, CAST(CASE WHEN l_quantity > 45 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS DATE) AS d, m.od
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey
  JOIN (SELECT o_custkey, min(o_orderkey) AS op, min_by(CAST(o_orderdate AS DATE), o_orderkey) AS od FROM orders GROUP BY o_custkey) m
    ON m.o_custkey = o.o_custkey) GROUP BY ALL""",
)
def val_08(x):
    o, line = x.table("orders"), x.table("lineitem")
    master = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("op"),
                                        F.min_by(F.to_date("o_orderdate"), "o_orderkey").alias("od"))
    d = F.to_date("o_orderdate")
    rec = line.join(o, line.l_orderkey == o.o_orderkey).select(
        "o_custkey", "l_orderkey", F.when(F.col("l_quantity") > 45, F.date_add(d, 1)).otherwise(d).alias("d"))
    out = checks.index_record_match(rec, master, entity="o_custkey", op="l_orderkey", date="d", index_op="op", index_date="od")
    return out.groupBy(F.col("is_index").cast("int").alias("is_index"),
                       F.col("date_conflict").cast("int").alias("date_conflict")).agg(F.count("*").alias("n"))


def encoding_rows(x):
    codes = x.code_lines.groupBy("entity").agg(F.sort_array(F.collect_set("brand")).alias("codes"))
    o = x.table("orders").select(F.col("o_orderkey").alias("entity"), (F.col("o_orderkey") % 10 != 0).alias("gate"),
                                 (F.col("o_custkey") % 12).alias("site"))
    return o.join(codes, "entity", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


@query(
    "val_09",
    "WITH r AS (SELECT o_orderkey AS entity, o_orderkey % 10 <> 0 AS gate, n, f FROM orders LEFT JOIN (SELECT l_orderkey,"
    " count(*) AS n, max(CASE WHEN p_brand = 'Brand#7' THEN 1 ELSE 0 END) AS f FROM lineitem JOIN part ON l_partkey = p_partkey"
    " GROUP BY l_orderkey) ON l_orderkey = o_orderkey) "
    + rules_sql("r", {"codes_visible_while_closed": ("NOT gate AND n > 0", ""), "codes_forbidden": ("f = 1", ""),
                      "site_varies": ("FALSE", "")}, "CAST(entity AS VARCHAR)"),
)
def val_09(x):
    return checks.check_encoding_inputs(encoding_rows(x), entity="entity", site="site", codes={"codes": "gate"},
                                        forbidden=["Brand#7"])


@query(
    "val_10",
    """SELECT status, count(*) AS n, count(raw_id) AS recovered FROM (
  SELECT l.f, CASE WHEN m.c IS NULL THEN 'unknown' WHEN m.c > 1 THEN 'ambiguous' ELSE 'recovered' END AS status,
    CASE WHEN m.c = 1 THEN m.raw_id END AS raw_id
  FROM (SELECT CAST(o_totalprice AS FLOAT) AS f FROM orders WHERE o_orderkey % 2 = 0) l
  LEFT JOIN (SELECT CAST(p AS FLOAT) AS f, count(*) AS c, min(p) AS raw_id FROM (SELECT DISTINCT o_totalprice AS p FROM orders WHERE o_orderkey % 3 > 0)
     GROUP BY 1) m ON m.f = l.f) GROUP BY status""",
)
def val_10(x):
    o = x.table("orders")
    lossy = o.where("o_orderkey % 2 = 0").select(F.col("o_totalprice").cast("float").alias("f"))
    raw = o.where("o_orderkey % 3 > 0").select(F.col("o_totalprice").alias("raw_id"))
    out = checks.recover_ids(lossy, raw, lossy_id="f", raw_id="raw_id")
    return out.groupBy("status").agg(F.count("*").alias("n"), F.count("raw_id").alias("recovered"))


@query(
    "val_11",
    rules_sql("f_targets", {"other_repeat": ("repeat <> 1", ""), "other_fold": ("fold <> 2", "")}, "concat_ws('|', repeat, row_key)"),
)
def val_11(x):
    return checks.check_context(x.targets, repeat=1, fold=2)


_CLEAN = """clean AS (SELECT c.entity, c.day, CASE WHEN c.event - c.day BETWEEN 1 AND 3 THEN 1 ELSE 0 END AS y,
  CASE WHEN c.event IS NULL THEN 0 ELSE 1 END AS is_case, CASE WHEN c.entity % 50 = 7 THEN rel + 1 ELSE rel END AS rel, site
  FROM (SELECT DISTINCT entity, day FROM f_point) p JOIN f_calendar c USING (entity, day)),
cache AS (SELECT *, CASE WHEN event IS NULL THEN 'none' WHEN event < idx THEN 'c' ELSE 'a' END AS g FROM f_risk)"""


def _clean_cache(x):
    pts = x.point.select(*K).distinct()
    lead = F.col("event") - F.col("day")
    clean = x.calendar.join(pts, K).select(
        *K, F.coalesce(lead.between(1, 3), F.lit(False)).cast("int").alias("y"),
        F.col("event").isNotNull().cast("int").alias("is_case"),
        F.when(F.col("entity") % 50 == 7, F.col("rel") + 1).otherwise(F.col("rel")).alias("rel"), "site")
    g = F.when(F.col("event").isNull(), "none").when(F.col("event") < F.col("idx"), "c").otherwise("a")
    return clean, x.risk.withColumn("g", g)


@query(
    "val_12",
    f"""WITH {_CLEAN} SELECT *, unmatched <= 0.05 * "rows" AND positives_lost <= 0.02 * positives AND disagree_rel + disagree_site = 0 AS passed FROM (
  SELECT count(*) AS "rows", count(*) FILTER (k.entity IS NULL) AS unmatched, count(*) FILTER (y = 1) AS positives,
   count(*) FILTER (y = 1 AND k.entity IS NULL) AS positives_lost, count(DISTINCT c.entity) AS entities,
   count(DISTINCT CASE WHEN is_case = 1 THEN c.entity END) AS case_entities,
   count(*) FILTER (k.entity IS NOT NULL AND c.rel <> k.rel) AS disagree_rel,
   count(*) FILTER (k.entity IS NOT NULL AND c.site <> k.site) AS disagree_site
  FROM clean c LEFT JOIN cache k ON k.entity = c.entity AND k.day = c.day)""",
)
def val_12(x):
    clean, cache = _clean_cache(x)
    return checks.reconcile(clean, cache, key=K, label="y", case="is_case", group="g", compare=["rel", "site"])


@query(
    "val_12_pool",
    f"""WITH {_CLEAN} SELECT coalesce(k.g, 'absent') AS g, count(*) AS n
 FROM (SELECT entity FROM clean GROUP BY entity HAVING max(is_case) = 0) c
 LEFT JOIN (SELECT entity, min(g) AS g FROM cache GROUP BY entity) k USING (entity) GROUP BY 1""",
)
def val_12_pool(x):
    clean, cache = _clean_cache(x)
    return checks.control_composition(clean, cache, entity="entity", case="is_case", group="g")


@query(
    "val_13",
    """SELECT matched, count(*) AS n FROM (SELECT CASE WHEN r.day IS NULL THEN 0 ELSE 1 END AS matched
 FROM (SELECT DISTINCT entity, day FROM f_point) q LEFT JOIN f_risk r ON r.entity = q.entity AND r.day = q.day) GROUP BY matched""",
)
def val_13(x):
    out = checks.select_requested(x.risk.select(*K), x.point.select(*K).distinct(), K)
    return out.groupBy("matched").agg(F.count("*").alias("n"))


@query(
    "val_14",
    "WITH rr AS (SELECT entity AS stay, day, rel AS pod, CASE WHEN event IS NULL THEN 0 ELSE 1 END AS \"case\", y3 AS y,"
    " CASE WHEN entity % 40 = 11 THEN event + 1 ELSE event END AS event_day FROM f_risk),"
    " cs AS (SELECT stay, min(event_day) AS anchor, min(day - pod) AS ix, sum(y) AS positives FROM rr WHERE \"case\" = 1 GROUP BY stay),"
    " el AS (SELECT cs.stay, min(p.day) AS fe FROM cs JOIN f_point p ON p.entity = cs.stay AND p.kind = 'error' AND p.value >= 150"
    "   AND p.day - cs.ix BETWEEN 1 AND 31 GROUP BY cs.stay),"
    " j AS (SELECT cs.*, el.fe FROM cs LEFT JOIN el USING (stay)) "
    + rules_sql("j", {
        "anchor_missing": ("anchor IS NULL", ""), "anchor_varies": ("FALSE", ""),
        "anchor_not_first_eligible_event": ("anchor IS DISTINCT FROM fe", ""),
        "case_without_positive_row": ("positives = 0", ""),
        "lead_outside_1_3": ("y = 1 AND event_day - day NOT BETWEEN 1 AND 3", "", "rr"),
    }, "CAST(stay AS VARCHAR)"),
)
def val_14(x):
    ev = F.col("event")
    rows = x.risk.select(F.col("entity").alias("stay"), "day", F.col("rel").alias("pod"), ev.isNotNull().cast("int").alias("case"),
                         F.col("y3").alias("y"), F.when(F.col("entity") % 40 == 11, ev + 1).otherwise(ev).alias("event_day"))
    events = x.point.where("kind = 'error' AND value >= 150").select(F.col("entity").alias("stay"), F.col("day").alias("event_day"))
    return checks.check_event_anchors(rows, events)


@query(
    "val_15",
    """SELECT unnest(['a=b', 'a=c']) AS pair, unnest([CAST(0 AS BIGINT), count(*) FILTER (k IS DISTINCT FROM CASE WHEN value > 400 THEN NULL ELSE k END)]) AS n
FROM f_point""",
)
def val_15(x):
    df = x.point.select(F.col("k").alias("a"), F.col("k").alias("b"), F.when(F.col("value") <= 400, F.col("k")).alias("c"))
    return checks.check_equal_columns(df, [("a", "b"), ("a", "c")])


@query(
    "val_16",
    f"""SELECT i.entity, rec, {sr6('start_ts', 'start_ts')}, {sr6('CASE WHEN end_ts < idx + 1 THEN end_ts END', 'end_ts')}
FROM f_interval_daily i JOIN f_anchors a USING (entity) WHERE start_ts < idx + 1""",
)
def val_16(x):
    out = checks.truncate_as_of(x.interval_daily, x.anchors, entity="entity", cutoff="idx", start="start_ts", dates=["end_ts"])
    return r6(out.select("entity", "rec", "start_ts", "end_ts"), "start_ts", "end_ts")


@query(
    "val_17",
    "SELECT v.variant, (SELECT count(*) FROM f_calendar WHERE day <= idx) AS compared, CAST(0 AS BIGINT) AS only_left,"
    " CAST(0 AS BIGINT) AS only_right FROM (SELECT unnest(['truncated', 'shifted']) AS variant) v",
)
def val_17(x):
    """The state up to the cutoff must not change when the future is cut off or moved."""
    cut = x.anchors.select("entity", "idx")
    limit = F.col("idx") + 1
    rec = x.interval_daily.join(cut, "entity")
    truncated = checks.truncate_as_of(x.interval_daily, cut, entity="entity", cutoff="idx", start="start_ts", dates=["end_ts"])
    later_end = F.col("end_ts").isNull() | (F.floor("end_ts") > F.col("idx"))
    # reversed ends stay as they are: they are open in every version
    reverse = F.col("end_ts") + F.col("date_only").cast("int") < F.col("start_ts")
    shifted = rec.select(
        "entity", "rec", F.when(F.col("start_ts") >= limit, F.col("start_ts") + 100).otherwise(F.col("start_ts")).alias("start_ts"),
        F.when(later_end & ~F.coalesce(reverse, F.lit(False)), F.col("idx") + 200.5).otherwise(F.col("end_ts")).alias("end_ts"),
        F.when(later_end, F.lit(False)).otherwise(F.col("date_only")).alias("date_only"), "kind")
    parts = []
    keys = x.calendar.select(*K, "idx")
    base = pan_17(x).join(keys, K).where("day <= idx").drop("idx")
    for name, records in (("truncated", truncated), ("shifted", shifted)):
        other = union_state_frame(x, records=records).join(keys, K).where("day <= idx").drop("idx")
        d = aggregates.same_rows(base, other)
        parts.append(d.select(F.lit(name).alias("variant"), keys.where("day <= idx").agg(F.count("*").alias("c"))
                              .select("c").scalar().alias("compared"), "only_left", "only_right"))
    return aggregates.union_all(parts)


@query(
    "val_18",
    """SELECT unnest(['rows', 'entities', 'cases', 'positives']) AS measure,
  unnest([count(*), count(DISTINCT stay), count(DISTINCT CASE WHEN "case" = 1 THEN stay END), count(*) FILTER (y = 1)]) AS n,
  unnest([(SELECT 5 * count(*) FROM f_lines), (SELECT count(DISTINCT l_orderkey) FROM lineitem), NULL, NULL]) AS expected FROM f_targets""",
)
def val_18(x):
    rows = x.lines.agg((5 * F.count("*")).alias("n")).select("n").scalar()
    entities = x.table("lineitem").agg(F.countDistinct("l_orderkey").alias("n")).select("n").scalar()
    return checks.check_population(x.targets, entity="stay", label="y", case="case", expected={"rows": rows, "entities": entities})


@query(
    "val_19",
    "WITH p AS (SELECT l_orderkey AS e, CASE WHEN l_partkey % 3 = 0 THEN 'valid' ELSE 'train' END AS part,"
    " CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE CAST(l_returnflag = 'R' AS INTEGER) END AS y FROM lineitem) "
    + rules_sql("", {
        "entity_in_two_parts": ("lo <> hi", "CAST(e AS VARCHAR)", "(SELECT e, min(part) AS lo, max(part) AS hi FROM p GROUP BY e)"),
        "single_class_part": ("lo = hi", "part", "(SELECT part, min(y) AS lo, max(y) AS hi FROM p GROUP BY part)"),
    }, "e"),
)
def val_19(x):
    valid = F.col("l_partkey") % 3 == 0
    df = x.table("lineitem").select(F.col("l_orderkey").alias("e"), F.when(valid, "valid").otherwise("train").alias("part"),
                                    F.when(valid, 0).otherwise((F.col("l_returnflag") == "R").cast("int")).alias("y"))
    return checks.check_partition(df, entity="e", part="part", label="y")


@query(
    "val_20",
    rules_sql("", {
        "duplicate_label": ("c > 1", "", "(SELECT doc_id, count(*) AS c FROM labels GROUP BY doc_id)"),
        "row_without_label": ("TRUE", "", "(SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"),
        "label_without_row": ("TRUE", "", "(SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))"),
        "label_not_binary": ("quality NOT IN (0, 1)", "", "labels"),
    }, "CAST(doc_id AS VARCHAR)"),
)
def val_20(x):
    return checks.check_labels(x.table("documents").select("doc_id"), x.table("labels"), key="doc_id", label="quality")


@query("val_23", "SELECT unnest(['keys', 'labels']) AS part, unnest([CAST(1 AS BIGINT), CAST(0 AS BIGINT)]) AS same")
def val_23(x):
    """Two versions of one panel: same keys, but a changed label column must be noticed."""
    a = x.risk
    b = x.risk.withColumn("y3", F.when(F.col("entity") == F.col("site"), 1 - F.col("y3")).otherwise(F.col("y3")))
    return aggregates.union_all([
        src.same_version(a, b, K).select(F.lit("keys").alias("part"), "same"),
        src.same_version(a, b, [*K, "y3"]).select(F.lit("labels").alias("part"), "same")])


# --- filters ---


@query(
    "flt_03",
    """SELECT unnest(['l_quantity', 'l_tax', 'constant', 'mostly_null']) AS feature, unnest([CAST(count(DISTINCT l_quantity) > 1 AS INTEGER),
  CAST(count(DISTINCT l_tax) > 1 AS INTEGER), 0, CAST(count(DISTINCT CASE WHEN l_partkey = 1 THEN 1 END) > 1 AS INTEGER)]) AS kept
FROM lineitem""",
)
def flt_03(x):
    from tidemark.operators.encode import varying_columns

    df = x.table("lineitem").select("l_quantity", "l_tax", F.lit(1).alias("constant"),
                                    F.when(F.col("l_partkey") == 1, 1).alias("mostly_null"))
    return varying_columns(df, df.columns)


@query("flt_04", "SELECT l_tax, l_quantity, l_orderkey, l_linenumber FROM f_lines JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '2-HIGH'")
def flt_04(x):
    """Selected columns in declared order, rows by exact id, label left out."""
    want = x.table("orders").where("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("l_orderkey"))
    return x.lines.join(want, "l_orderkey", "left_semi").select("l_tax", "l_quantity", "l_orderkey", "l_linenumber")


@query("flt_05", "SELECT entity, day, rel FROM f_risk WHERE idx < 45300")
def flt_05(x):
    from tidemark.operators.splits import era_flag

    sealed = era_flag(x.anchors, "idx", 45300, "sealed").select("entity", "sealed")
    return x.risk.join(sealed, "entity").where("sealed = 0").select(*K, "rel")


# --- code sets and cohort rows ---


@query(
    "pan_27",
    f"""SELECT e.entity, e.day, CASE WHEN g_surgery = 1 THEN coalesce(c.codes, '') ELSE '' END AS codes
FROM (SELECT *, {_gate_sql('<').format(p='g_')} FROM f_calendar) e LEFT JOIN
 (SELECT o_custkey AS entity, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS codes FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  JOIN part ON p_partkey = l_partkey GROUP BY 1) c USING (entity)""",
)
def pan_27(x):
    o = x.table("orders").select(F.col("o_orderkey").alias("entity"), "o_custkey")
    codes = x.code_lines.join(o, "entity").groupBy(F.col("o_custkey").alias("entity")).agg(
        F.sort_array(F.collect_set("type")).alias("codes"))
    rows = panel.availability_gates(x.calendar).join(codes, "entity", "left")
    seen = panel.visible_codes(F.coalesce("codes", F.array().cast("array<string>")), "surgery_open")
    return rows.select(*K, F.array_join(seen, ",").alias("codes"))


_PRIOR = """count(*) FILTER (floor(start_ts) < c.day AND (end_ts IS NULL OR floor(end_ts) >= c.day))"""


@query(
    "pan_28",
    f"""SELECT c.entity, c.day, CAST({_PRIOR} > 0 AS INTEGER) AS active, {_PRIOR} AS active_records,
  CAST(coalesce(max(CASE WHEN floor(start_ts) < c.day AND (end_ts IS NULL OR floor(end_ts) >= c.day) THEN c.day - floor(start_ts) END), 0) AS BIGINT) AS max_elapsed
FROM f_calendar c LEFT JOIN f_interval_daily i USING (entity) GROUP BY c.entity, c.day""",
)
def pan_28(x):
    from tidemark.operators.cohort import prior_day_status

    out = prior_day_status(x.calendar.select(*K), x.interval_daily, start="start_ts", end="end_ts")
    return longs(out.select(*K, "active", "active_records", "max_elapsed"), "active_records", "max_elapsed")


_SNAP = """s AS (SELECT a.entity, p.serial, p.value, p.event_id FROM f_anchors a JOIN f_point p ON p.entity = a.entity
  WHERE p.kind = 'view' AND p.serial < a.idx AND a.idx - p.serial <= 2)"""


@query(
    "pan_29",
    f"""WITH {_SNAP} SELECT a.entity, x.value AS snap_value, {sr6('(a.idx - x.serial) * 24', 'age_hours')}
FROM f_anchors a LEFT JOIN (SELECT s.entity, min(serial) AS serial, min(value) AS value FROM s
  JOIN (SELECT entity, max(serial) AS m FROM s GROUP BY entity) b ON b.entity = s.entity AND b.m = s.serial
  GROUP BY s.entity HAVING count(*) = 1) x USING (entity)""",
)
def pan_29(x):
    from tidemark.operators.cohort import last_snapshot

    out = last_snapshot(x.anchors.select("entity", "idx"), x.point.where("kind = 'view'"), decision="idx", serial="serial",
                        values=["value"], max_age=2.0)
    return r6(out.select("entity", F.col("value").alias("snap_value"), (F.col("snap_age") * 24).alias("age_hours")), "age_hours")


@query(
    "pan_30",
    f"""WITH {_SNAP} SELECT a.entity, concat('C', lpad(CAST(a.site + 1 AS VARCHAR), 2, '0')) AS site_label,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS static_number, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 WHEN c_mktsegment = 'MACHINERY' THEN 0 END AS static_binary,
  coalesce(c_mktsegment, '__missing__') AS category, CAST(regexp_matches(c_name, '7') AS INTEGER) AS text_flag,
  CASE WHEN n_codes > 0 THEN has_code END AS code_group, CAST(coalesce(act, 0) > 0 AS INTEGER) AS active, coalesce(act, 0) AS active_records,
  x.value AS snap_value
FROM f_anchors a JOIN customer ON c_custkey = a.entity
LEFT JOIN (SELECT o_custkey AS entity, count(*) AS n_codes, max(CAST(p_brand IN ('Brand#1', 'Brand#2') AS INTEGER)) AS has_code
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1) k USING (entity)
LEFT JOIN (SELECT i.entity, count(*) AS act FROM f_interval_daily i JOIN f_anchors b USING (entity)
  WHERE floor(start_ts) < b.idx AND (end_ts IS NULL OR floor(end_ts) >= b.idx) GROUP BY 1) t USING (entity)
LEFT JOIN (SELECT s.entity, min(value) AS value FROM s JOIN (SELECT entity, max(serial) AS m FROM s GROUP BY entity) b
  ON b.entity = s.entity AND b.m = s.serial GROUP BY s.entity HAVING count(*) = 1) x USING (entity)""",
)
def pan_30(x):
    from tidemark.functions.scalars import finite_number, recode
    from tidemark.operators import cohort

    cust = x.table("customer").withColumnRenamed("c_custkey", "entity")
    base = x.anchors.select("entity", "idx", "site").join(cust, "entity")
    o = x.table("orders").select(F.col("o_orderkey").alias("entity"), "o_custkey")
    codes = x.code_lines.join(o, "entity").groupBy(F.col("o_custkey").alias("entity")).agg(F.collect_set("brand").alias("codes"))
    status = cohort.prior_day_status(x.anchors.select("entity", F.col("idx").alias("day")), x.interval_daily, start="start_ts", end="end_ts")
    snap = cohort.last_snapshot(x.anchors.select("entity", "idx"), x.point.where("kind = 'view'"), decision="idx", serial="serial",
                                values=["value"], max_age=2.0)
    out = base.join(codes, "entity", "left").join(status.drop("day"), "entity", "left").join(snap.drop("idx"), "entity", "left")
    return out.select(
        "entity", F.format_string("C%02d", F.col("site") + 1).alias("site_label"),
        finite_number("c_acctbal", non_negative=True).alias("static_number"),
        recode("c_mktsegment", {"BUILDING": 1, "MACHINERY": 0}).alias("static_binary"),
        F.coalesce("c_mktsegment", F.lit("__missing__")).alias("category"),
        F.col("c_name").rlike("7").cast("int").alias("text_flag"),
        *panel.member_flags("codes", {"code_group": ["Brand#1", "Brand#2"]}),
        "active", "active_records", F.col("value").alias("snap_value"))


@query(
    "pan_31",
    """SELECT c_custkey AS entity, coalesce(codes, '') AS codes, CASE WHEN np = 1 THEN p ELSE '' END AS primary_code FROM customer LEFT JOIN (
 SELECT m.o_custkey, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS codes, min(CASE WHEN l_returnflag = 'R' THEN p_brand END) AS p,
  count(DISTINCT CASE WHEN l_returnflag = 'R' THEN p_brand END) AS np
 FROM (SELECT o_custkey, min(o_orderkey) AS op FROM orders GROUP BY o_custkey) m JOIN lineitem ON l_orderkey = m.op
 JOIN part ON p_partkey = l_partkey WHERE p_brand NOT IN ('Brand#7', 'Brand#8') GROUP BY m.o_custkey) ON o_custkey = c_custkey""",
)
def pan_31(x):
    first = x.table("orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.min("o_orderkey").alias("op"))
    master = x.table("customer").select(F.col("c_custkey").alias("entity")).join(first, "entity", "left")
    o = x.table("orders").select(F.col("o_orderkey").alias("op"), F.col("o_custkey").alias("cust"))
    rec = x.code_lines.withColumnRenamed("entity", "op").join(o, "op").select(F.col("cust").alias("entity"), "op", "brand", "l_returnflag")
    book = panel.index_code_book(master, rec, entity="entity", op="op", code="brand", primary=F.col("l_returnflag") == "R",
                                 forbidden=["Brand#7", "Brand#8"])
    return book.select("entity", F.array_join("codes", ",").alias("codes"), F.array_join("primary_code", ",").alias("primary_code"))


@query(
    "pan_32",
    """WITH f AS (SELECT o_orderkey AS e, CASE WHEN o_orderpriority < '4' OR o_totalprice > 100000 THEN 1 ELSE 0 END AS flag FROM orders),
 p AS (SELECT DISTINCT l_orderkey AS e, l_suppkey * 1000 + l_partkey AS code FROM lineitem),
 cand AS (SELECT code, count(*) AS entities FROM p JOIN f USING (e) GROUP BY code HAVING min(flag) = 1),
 sole AS (SELECT e, min(code) AS code FROM p JOIN cand USING (code) GROUP BY e HAVING count(*) = 1)
SELECT code, entities, coalesce(n, 0) AS sole_cover, CASE WHEN n > 0 THEN 1 ELSE 0 END AS essential
FROM cand LEFT JOIN (SELECT code, count(*) AS n FROM sole GROUP BY code) USING (code)""",
)
def pan_32(x):
    flag = ((F.col("o_orderpriority") < "4") | (F.col("o_totalprice") > 100000)).cast("int")
    flags = x.table("orders").select(F.col("o_orderkey").alias("e"), flag.alias("flag"))
    codes = x.table("lineitem").select(F.col("l_orderkey").alias("e"), (F.col("l_suppkey") * 1000 + F.col("l_partkey")).alias("code"))
    return panel.flag_code_crosswalk(flags, codes, entity="e", flag="flag", code="code")


@query(
    "pan_33",
    """SELECT o_orderkey AS entity, CASE WHEN n > 0 THEN g1 END AS g1, CASE WHEN n > 0 THEN g2 END AS g2 FROM orders LEFT JOIN (
 SELECT l_orderkey, count(*) AS n, max(CAST(p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AS INTEGER)) AS g1,
   max(CAST(p_brand IN ('Brand#9') AS INTEGER)) AS g2 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def pan_33(x):
    flags = panel.member_flags("codes", {"g1": ["Brand#1", "Brand#2", "Brand#3"], "g2": ["Brand#9"]})
    return encoding_rows(x).select("entity", *flags)


@query(
    "pan_34",
    """WITH m AS (SELECT user_id AS entity, min(site) AS site FROM (SELECT DISTINCT user_id, CAST(user_id % 12 AS VARCHAR) AS site, CASE WHEN user_id % 9 = 0 THEN event_type END AS dup FROM events)
  GROUP BY user_id HAVING count(*) = 1)
SELECT m.entity, concat('C', lpad(CAST(l.r AS VARCHAR), 2, '0')) AS site_label, e.first_event, coalesce(e.u, 0) AS undated_event FROM m
LEFT JOIN (SELECT site, row_number() OVER (ORDER BY site) AS r FROM (SELECT DISTINCT site FROM m)) l USING (site)
LEFT JOIN (SELECT entity, min(d) AS first_event, max(CASE WHEN d IS NULL THEN 1 ELSE 0 END) AS u FROM
  (SELECT entity, CASE WHEN k <> 9 THEN day END AS d FROM f_point WHERE kind = 'error') GROUP BY entity) e USING (entity)""",
)
def pan_34(x):
    u = F.col("user_id")
    master = x.table("events").select(u.alias("entity"), (u % 12).cast("string").alias("site"),
                                      F.when(u % 9 == 0, F.col("event_type")).alias("dup")).distinct()
    ev = x.point.where("kind = 'error'").select("entity", F.when(F.col("k") != 9, F.col("day")).alias("d"))
    return panel.cohort_context(master, ev, entity="entity", event_day="d", site="site")


_PAN35 = """SELECT '{rs}' AS row_set, c.entity, c.day, {y} AS y3, CASE WHEN p.n > 0 THEN 1 ELSE 0 END AS pulse, p.m AS dose_max,
  CASE WHEN c.day >= c.idx THEN c.rel END AS rel_post FROM {src} c LEFT JOIN
  (SELECT entity, day, count(*) AS n, max(value) AS m FROM f_point WHERE kind = 'click' GROUP BY entity, day) p USING (entity, day)"""


@query("pan_35", _PAN35.format(rs="labelled", y="c.y3", src="f_risk") + " UNION ALL "
       + _PAN35.format(rs="complete", y="NULL", src="f_calendar"))
def pan_35(x):
    from tidemark.operators.assemble import assemble_panel

    clicks = x.point.where("kind = 'click'")
    blocks = {"click": panel.daily_facts(clicks, {"n": F.count("*"), "dose_max": F.max("value")})}
    out = []
    for rs in ("labelled", "complete"):
        p = assemble_panel(x.anchors, blocks, row_set=rs)
        y = F.col("y3") if rs == "labelled" else F.lit(None).cast("int")
        out.append(p.select(F.lit(rs).alias("row_set"), *K, y.alias("y3"), F.coalesce((F.col("n") > 0).cast("int"), F.lit(0)).alias("pulse"),
                            "dose_max", F.when(F.col("day") >= F.col("idx"), F.col("day") - F.col("idx")).alias("rel_post")))
    return aggregates.union_all(out)
