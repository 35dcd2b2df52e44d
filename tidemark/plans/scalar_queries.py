"""Scalar-function (SCL) and source/sink (SRC) queries with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.operators import aggregates, windows
from tidemark.plans.catalog import query
from tidemark.plans.common import r6, sr6
from tidemark.plans.sqlviews import h32
from tidemark.sources import tables as src

# three text forms plus impossible dates and missing tokens, all derived from the order dates
_KIND = "o_orderkey % 5"


def date_texts(x):
    k, ts = F.col("o_orderkey") % 5, F.col("o_orderdate").cast("timestamp_ntz")
    sec = (F.col("o_orderkey") * 7919 % 86400).cast("int")
    hms = F.format_string("%02d:%02d:%02d", F.floor(sec / 3600), F.floor(sec % 3600 / 60), sec % 60)
    text = (
        F.when(k == 0, F.date_format(ts, "dd-MMM-yy"))
        .when(k == 1, F.concat(F.upper(F.date_format(ts, "ddMMMyy")), F.lit(":"), hms))
        .when(k == 2, F.concat(F.lit("31-Feb-"), F.date_format(ts, "yy")))
        .when(k == 3, F.concat(F.lit(" "), F.date_format(ts, "dd-MMM-yy"), F.lit(" ")))
        .otherwise(F.lit("."))
    )
    return x.table("orders").select("o_orderkey", text.alias("txt"))


_DAYNUM = "date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE))"


@query(
    "scl_01",
    f"""SELECT o_orderkey, CASE {_KIND} WHEN 0 THEN CAST({_DAYNUM} AS DOUBLE) WHEN 3 THEN CAST({_DAYNUM} AS DOUBLE)
  WHEN 1 THEN {sr6(f'{_DAYNUM} + CAST(o_orderkey * 7919 % 86400 AS DOUBLE) / 86400', 'v').rsplit(' AS ', 1)[0]} END AS serial
FROM orders""",
)
def scl_01(x):
    return r6(date_texts(x).select("o_orderkey", s.serial_day("txt").alias("serial")), "serial")


@query("scl_02", f"SELECT o_orderkey, CASE WHEN {_KIND} IN (0, 3) THEN 1 ELSE 0 END AS date_only FROM orders")
def scl_02(x):
    return date_texts(x).select("o_orderkey", s.date_only_flag("txt").cast("int").alias("date_only"))


def id_texts(x):
    k = F.col("o_orderkey")
    raw = (F.when(k % 3 == 0, F.concat(F.lit(" "), k.cast("string"), F.lit(".00 ")))
           .when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".50"))).otherwise(k.cast("string")))
    code = F.when(k % 7 == 0, F.lit(" . ")).when(k % 7 == 1, F.lit("nan")).when(k % 7 == 2, F.lit(None)).otherwise(raw)
    return x.table("orders").select(k, raw.alias("raw"), code.alias("code"))


@query(
    "scl_03",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN concat(o_orderkey, '.50') ELSE CAST(o_orderkey AS VARCHAR) END"
    " AS id FROM orders",
)
def scl_03(x):
    return id_texts(x).select("o_orderkey", s.norm_id("raw").alias("id"))


@query(
    "scl_04",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 3 THEN '' WHEN o_orderkey % 3 = 1 THEN concat(o_orderkey, '.50')"
    " ELSE CAST(o_orderkey AS VARCHAR) END AS code FROM orders",
)
def scl_04(x):
    return id_texts(x).select("o_orderkey", s.norm_code("code").alias("code"))


@query(
    "scl_05",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN -value ELSE value END AS number,
  CASE WHEN event_id % 5 > 1 THEN value END AS non_negative, CASE WHEN k NOT IN (9, 99) THEN CAST(k AS DOUBLE) END AS no_sentinel
FROM f_point""",
)
def scl_05(x):
    e, v = F.col("event_id"), F.col("value").cast("string")
    txt = F.when(e % 10 == 0, "Infinity").when(e % 5 == 0, "n/a").when(e % 5 == 1, F.concat(F.lit("-"), v)).otherwise(v)
    return x.point.withColumn("txt", txt).select(
        "event_id", s.finite_number("txt").alias("number"), s.finite_number("txt", non_negative=True).alias("non_negative"),
        s.finite_number("k", sentinels=(9, 99)).alias("no_sentinel"))


@query(
    "scl_06",
    """SELECT o_orderkey, CASE c WHEN '1' THEN 1 WHEN '2' THEN 0 END AS flag, CASE WHEN c = '5' THEN 1 ELSE 0 END AS flag_unknown
FROM (SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS c FROM orders)""",
)
def scl_06(x):
    c = F.substring("o_orderpriority", 1, 1)
    return x.table("orders").select("o_orderkey", s.recode(c, {"1": 1, "2": 0}).alias("flag"),
                                    s.unknown_flag(c, "5").alias("flag_unknown"))


@query(
    "scl_07",
    """SELECT event_id, CASE WHEN k % 10 = 0 THEN 'none' WHEN k - 20 < 0 THEN 'err' WHEN k - 30 < 0 THEN 'c'
  WHEN k - 30 <= 3 THEN 'b' WHEN k - 30 <= 31 THEN 'a' ELSE 'd' END AS event_group FROM f_point""",
)
def scl_07(x):
    k = F.when(F.col("k") % 10 != 0, F.col("k"))
    return x.point.select("event_id", s.event_group(k - 30, k - 20).alias("event_group"))


@query(
    "scl_08",
    "SELECT entity, day, day - idx AS rel, day - adm AS since_start, CASE WHEN day >= idx THEN 1 ELSE 0 END AS post,"
    " event - day AS lead FROM f_calendar",
)
def scl_08(x):
    d = F.col("day")
    return x.calendar.select("entity", "day", (d - F.col("idx")).alias("rel"), (d - F.col("adm")).alias("since_start"),
                             (d >= F.col("idx")).cast("int").alias("post"), (F.col("event") - d).alias("lead"))


_RULES = {"nation": "tion|nation", "mental": "ment|mind", "english": "the |and ", "german": "nicht|und "}
_EXTRA = {"mental": "heit|keit", "german": "sch"}


@query(
    "scl_09",
    "SELECT doc_id, CASE WHEN f = '' THEN 'other' ELSE f END AS families, CASE WHEN f = '' THEN 'fallback_other' ELSE"
    " 'text_rule' END AS status FROM (SELECT doc_id, concat_ws(';', "
    + ", ".join(
        f"CASE WHEN regexp_matches(text, '(?i){p}{'|' + _EXTRA[n] if n in _EXTRA else ''}') THEN '{n}' END"
        for n, p in _RULES.items()
    )
    + ") AS f FROM documents)",
)
def scl_09(x):
    fam = s.tag_families("text", _RULES, _EXTRA)
    return x.table("documents").select(
        "doc_id", F.array_join(fam, ";").alias("families"),
        F.when(fam[0] == "other", "fallback_other").otherwise("text_rule").alias("status"))


@query(
    "scl_09_labels",
    """SELECT p_brand AS code, string_agg(p_type, ' / ' ORDER BY p_type) AS label, count(*) AS label_variants
FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY p_brand""",
)
def scl_09_labels(x):
    return x.table("part").groupBy(F.col("p_brand").alias("code")).agg(
        F.array_join(F.sort_array(F.collect_set("p_type")), " / ").alias("label"),
        F.countDistinct("p_type").alias("label_variants"))


@query(
    "scl_10",
    f"""SELECT event_id, {sr6('value + k5 + 100 * k5', 'score')} FROM (
  SELECT event_id, value, CASE WHEN k % 4 <> 0 THEN k END AS k5 FROM f_point)""",
)
def scl_10(x):
    k5 = F.when(F.col("k") % 4 != 0, F.col("k"))
    df = x.point.select("event_id", "value", k5.alias("a"), k5.alias("b"))
    return r6(df.select("event_id", s.weighted_sum({"value": 1, "a": 1, "b": 100}).alias("score")), "score")


@query(
    "scl_11",
    f"""SELECT event_id, {sr6('sign(v) * ln(1 + abs(v))', 'signed_log')},
  {sr6('CASE WHEN v IS NOT NULL THEN least(greatest((sign(v) * ln(1 + abs(v)) - 2) / 0.5e0, -6e0), 6e0) END', 'scaled')},
  {sr6('CASE WHEN v IS NULL THEN -7e0 ELSE least(greatest((sign(v) * ln(1 + abs(v)) - 2) / 0.5e0, -6e0), 6e0) END', 'flat')}
FROM (SELECT event_id, CASE WHEN v <> 0 THEN v END AS v FROM (SELECT event_id, CASE WHEN k % 6 = 0 THEN NULL ELSE value - 50 END AS v FROM f_point))""",
)
def scl_11(x):
    v = F.when(F.col("k") % 6 != 0, F.col("value") - 50)
    v = F.when(v != 0, v)
    sl = s.signed_log(v)
    sc = windows.scaled(sl, F.lit(2.0), F.lit(0.5))
    return r6(x.point.select("event_id", sl.alias("signed_log"), sc.alias("scaled"),
                             F.coalesce(sc, F.lit(-7.0)).alias("flat")), "signed_log", "scaled", "flat")


@query(
    "scl_12",
    f"""SELECT repeat, arm, row_key, {sr6('ln(c / (1 - c))', 'logit')}, {sr6('1 / (1 + exp(-(p * 8 - 4)))', 'expit')} FROM (
 SELECT repeat, arm, row_key, probability AS p, least(greatest(probability, 1e-6), 1 - 1e-6) AS c FROM f_scores)""",
)
def scl_12(x):
    return r6(x.scores.select("repeat", "arm", "row_key", s.logit("probability").alias("logit"),
                        s.expit(F.col("probability") * 8 - 4).alias("expit")), "logit", "expit")


_SHA = "sha256(concat_ws('|', 'ctx', o_orderkey, 'boot'))"


@query(
    "scl_13",
    f"""SELECT o_orderkey, {h32("concat_ws('|', 'salt', o_orderkey)")} AS hash32,
  CAST(concat('0x', substr({_SHA}, 7, 2), substr({_SHA}, 5, 2), substr({_SHA}, 3, 2), substr({_SHA}, 1, 2)) AS BIGINT) % 2147483647 AS seed
FROM orders""",
)
def scl_13(x):
    return x.table("orders").select("o_orderkey", s.hash32(F.lit("salt"), "o_orderkey").alias("hash32"),
                                    s.context_seed(F.lit("ctx"), "o_orderkey", F.lit("boot")).alias("seed"))


@query(
    "scl_14",
    """SELECT entity, day, concat("""
    + ", ".join(
        f"CASE WHEN EXISTS (SELECT 1 FROM f_point p WHERE p.entity = c.entity AND p.day = c.day - {i}) THEN '1' ELSE '0' END"
        for i in (4, 3, 2, 1, 0)
    )
    + ") AS pattern FROM (SELECT DISTINCT entity, day FROM f_point) c",
)
def scl_14(x):
    rows = x.point.select("entity", "day").distinct()
    w = windows.calendar_windows(rows, [], window=5)
    return w.select("entity", "day", s.bit_string(F.transform("slots", lambda z: z.isNotNull())).alias("pattern"))


@query(
    "scl_16",
    """SELECT l_orderkey, """
    + f"""{sr6('f', 'first_seen')}, {sr6('l', 'last_seen')}, {sr6('mx', 'max_step')}, any_r, all_r FROM (
 SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber) FILTER (l_discount > 0.02) AS q, q[1] AS f, q[-1] AS l,
  list_max(list_transform(range(2, len(q) + 1), lambda i: q[i] - q[i - 1])) AS mx,
  CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS any_r,
  CAST(min(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS all_r FROM f_lines GROUP BY l_orderkey)""",
)
def scl_16(x):
    v = F.when(F.col("l_discount") > 0.02, F.col("l_quantity"))
    g = x.lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(
        F.struct("l_linenumber", v.alias("v"), (F.col("l_returnflag") == "R").alias("r")))).alias("h"))
    seen = F.filter(F.transform("h", lambda z: z["v"]), lambda z: z.isNotNull())
    step = F.when(F.size(seen) > 1, F.array_max(s.differences(seen)))
    bits = F.transform("h", lambda z: z["r"])
    out = g.select("l_orderkey", s.first_observed(F.transform("h", lambda z: z["v"])).alias("first_seen"),
                   s.last_observed(F.transform("h", lambda z: z["v"])).alias("last_seen"), step.alias("max_step"),
                   s.any_true(bits).cast("int").alias("any_r"), s.all_true(bits).cast("int").alias("all_r"))
    return r6(out, "first_seen", "last_seen", "max_step")


@query(
    "scl_17",
    """SELECT event_id, k, CASE WHEN k = (CAST(round(value) AS BIGINT) % 100) THEN 1 ELSE 0 END AS equal FROM f_point""",
)
def scl_17(x):
    parsed = F.from_json("props", "k INT")["k"]
    return x.table("events").select("event_id", parsed.alias("k"), (parsed == F.round("value").cast("long") % 100)
                                    .cast("int").alias("equal"))


# --- sources and sinks ---


@query(
    "src_01",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS entity, CASE {_KIND} WHEN 0 THEN CAST({_DAYNUM} AS DOUBLE)
  WHEN 3 THEN CAST({_DAYNUM} AS DOUBLE)
  WHEN 1 THEN {sr6(f'{_DAYNUM} + CAST(o_orderkey * 7919 % 86400 AS DOUBLE) / 86400', 'v').rsplit(' AS ', 1)[0]} END AS txt__serial
FROM orders""",
)
def src_01(x):
    path = src.scratch_path(x.spark, "text")
    rows = date_texts(x).select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")).alias("id"), "txt")
    rows.write.option("header", True).option("emptyValue", "").csv(f"{path}/orders_text")
    spec = {"orders_text": {"columns": ["id", "txt"], "entity": "id", "dates": ["txt"]}}
    t = src.read_text_folder(x.spark, spec, path)["orders_text"]
    return r6(t.select("entity", "txt__serial"), "txt__serial")


@query("src_01_files", """SELECT CAST(o_orderkey AS VARCHAR) AS entity, concat('caf\u00e9 \u2013 \u201c', o_orderpriority, '\u201d') AS note,
  CASE WHEN o_orderkey % 2 = 0 THEN '\u00ff\u017e' ELSE '\u00fc' END AS tail FROM orders""")
def src_01_files(x):
    """A table folder whose files differ in encoding: one half of the orders in UTF-8, the other in windows-1252."""
    path = src.scratch_path(x.spark, "mixed")
    o = x.table("orders")
    note = F.concat(F.lit("caf\u00e9 \u2013 \u201c"), "o_orderpriority", F.lit("\u201d"))
    tail = F.when(F.col("o_orderkey") % 2 == 0, "\u00ff\u017e").otherwise("\u00fc")
    rows = o.select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")).alias("id"), note.alias("note"), tail.alias("tail"))
    even = o["o_orderkey"] % 4 < 2
    for part, encoding in ((rows.where(even), "UTF-8"), (rows.where(~even), "windows-1252")):
        src.write_text_table(part, f"{path}/notes", encoding=encoding)
    t = src.read_text_folder(x.spark, {"notes": {"columns": ["id", "note", "tail"], "entity": "id"}}, path)["notes"]
    return t.select("entity", "note", "tail")


@query(
    "src_02",
    f"""SELECT unnest(['rows', 'entities', 'blank_entity_rows', 'txt_missing', 'txt_parsed', 'txt_parse_failure',
    'exact_duplicate_excess_rows', 'record_key_excess_rows']) AS measure,
  unnest([count(*), count(DISTINCT CASE WHEN o_custkey % 11 <> 0 THEN o_custkey END), count(*) FILTER (o_custkey % 11 = 0),
    count(*) FILTER ({_KIND} = 4), count(*) FILTER ({_KIND} IN (0, 1, 3)), count(*) FILTER ({_KIND} = 2), CAST(0 AS BIGINT),
    count(*) - count(DISTINCT o_custkey)]) AS n FROM orders""",
)
def src_02(x):
    o = x.table("orders").join(date_texts(x), "o_orderkey")
    c = F.col("o_custkey")
    df = o.select("o_orderkey", F.when(c % 11 == 0, "").otherwise(c.cast("string")).alias("ent"), c.alias("rec"), "txt")
    return src.inventory(df, entity="ent", dates={"txt": s.serial_day("txt")}, record_key="rec")


@query("src_03", f"SELECT l_orderkey, {sr6('sum(l_quantity)', 'qty')} FROM lineitem GROUP BY l_orderkey")
def src_03(x):
    df = src.scan(x.spark, f"{x.sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"])
    return r6(df.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty")), "qty")


@query(
    "src_04",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30
 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def src_04(x):
    keys = x.table("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return src.scan(x.spark, f"{x.sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"],
                    where=F.col("l_quantity") > 30, keys=keys)


@query("src_05", "SELECT kind, count(*) AS n, count(DISTINCT entity) AS entities FROM f_point GROUP BY kind")
def src_05(x):
    path = src.scratch_path(x.spark, "points")
    first, second = x.point.where("kind < 'm'"), x.point.where("kind >= 'm'")
    src.write_table(first, path)
    src.write_table(second, path, like=first)
    return x.spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"),
                                                           F.countDistinct("entity").alias("entities"))


@query("src_06", f"SELECT kind, {sr6('avg(value)', 'mean')}, CASE WHEN kind <> 'view' THEN 1e0 END AS undefined FROM f_point GROUP BY kind")
def src_06(x):
    path = src.scratch_path(x.spark, "metrics")
    m = x.point.groupBy("kind").agg(F.avg("value").alias("mean")).withColumn(
        "undefined", F.when(F.col("kind") == "view", F.lit(float("nan"))).otherwise(F.lit(1.0)))
    src.write_metrics(m, path)
    return r6(x.spark.read.schema("kind STRING, mean DOUBLE, undefined DOUBLE").json(path), "mean")


@query("src_07")
def src_07(x):
    parts = [src.fingerprint(x.table(t)).select(F.lit(t).alias("table"), "rows", "xor", "sum", "schema")
             for t in ("orders", "lineitem", "events")]
    return aggregates.union_all(parts)


@query("src_08", "SELECT repeat, row_key, arm, probability FROM f_scores")
def src_08(x):
    path = src.scratch_path(x.spark, "predictions")
    src.write_predictions(x.scores, path)
    return src.read_predictions(x.spark, path)
