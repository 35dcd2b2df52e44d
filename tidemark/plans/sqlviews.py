"""The shared views in DuckDB SQL. Their Spark form is in ``fixtures.py``."""

from tidemark import contract
from tidemark.functions.scalars import DRAW_STEP, MIX32, RANK_STEP, WORD32

H32 = "CAST(concat('0x', substr(md5({}), 1, 8)) AS BIGINT)"


def h32(expr: str) -> str:
    return H32.format(expr)


SQL_VIEWS: dict[str, str] = {
    "f_point": """
SELECT event_id, user_id AS entity,
       CAST(date_diff('day', DATE '1899-12-30', CAST(ts AS DATE)) AS INTEGER) AS day,
       CAST(epoch_us(ts) - epoch_us(TIMESTAMP '1899-12-30 00:00:00') AS DOUBLE) / 86400e6 AS serial,
       event_type AS kind, value,
       CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) AS k
FROM events""",
    "f_anchors": """
SELECT entity, adm, dis, adm + CAST(5 + entity % 5 AS INTEGER) AS idx,
       adm + CAST(5 + entity % 5 AS INTEGER) + (entity % 4) * 0.75e0 AS icu,
       CAST(entity % 12 AS INTEGER) AS site, event
FROM (
  SELECT p.entity, CAST(min(a.adm) AS INTEGER) AS adm, CAST(max(p.day) + 1 AS INTEGER) AS dis,
         CAST(min(CASE WHEN kind = 'error' AND value >= 150 AND p.day > a.adm THEN p.day END) AS INTEGER) AS event
  FROM f_point p JOIN (SELECT entity, min(day) AS adm FROM f_point GROUP BY entity) a ON a.entity = p.entity
  GROUP BY p.entity)""",
    "f_calendar": """
SELECT a.*, CAST(a.adm + i AS INTEGER) AS day, CAST(a.adm + i - a.idx AS INTEGER) AS rel,
       a.adm + i >= a.idx AS post
FROM f_anchors a, LATERAL (SELECT unnest(range(0, a.dis - a.adm + 1)) AS i)""",
    "f_risk": """
SELECT *, CASE WHEN event - day BETWEEN 1 AND 3 THEN 1 ELSE 0 END AS y3,
       CASE WHEN event - day BETWEEN 1 AND 30 THEN 1 ELSE 0 END AS y30
FROM f_calendar WHERE day < dis AND (event IS NULL OR day < event)""",
    "f_interval": """
SELECT o_custkey AS entity,
       concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rec,
       CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS INTEGER) AS start_day,
       CASE WHEN l_linestatus <> 'O'
            THEN CAST(date_diff('day', DATE '1899-12-30', CAST(l_shipdate AS DATE)) AS INTEGER) END AS end_day,
       l_returnflag AS kind, l_linestatus AS status, o_orderkey AS op
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "f_interval_daily": """
SELECT entity, event_id AS rec, serial AS start_ts,
       CASE WHEN event_id % 7 = 0 THEN NULL
            WHEN event_id % 11 = 0 THEN serial - 1.5e0
            WHEN event_id % 3 = 0 THEN floor(serial) + (event_id % 5)
            ELSE serial + (event_id % 5) + 0.25e0 END AS end_ts,
       event_id % 3 = 0 AS date_only,
       CASE WHEN event_id % 2 = 0 THEN 'x' ELSE 'z' END AS kind
FROM f_point WHERE kind = 'view'""",
    "f_codes": """
SELECT l_orderkey AS entity, p_brand AS brand, p_type AS type, l_returnflag,
       CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS INTEGER) AS label
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "f_lines": """
SELECT * FROM (
  SELECT l.*, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
           ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax,
                    l_returnflag, l_linestatus) AS rn
  FROM lineitem l) WHERE rn = 1""",
    "f_targets": f"""
SELECT CAST(r.r AS INTEGER) AS repeat, concat_ws('-', l_orderkey, l_linenumber) AS row_key,
       l_orderkey AS stay, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
       CAST(l_linenumber - 3 AS INTEGER) AS pod,
       max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS "case",
       CAST({h32("concat_ws('|', 'fold', r.r, l_orderkey)")} % 5 AS INTEGER) AS fold,
       l_quantity, l_discount, l_tax, l_extendedprice
FROM f_lines, (SELECT unnest(range(1, 6)) AS r) r""",
    "f_scores": f"""
SELECT t.repeat, t.row_key, t.stay, t.y, t.pod, t."case", t.fold, a.arm,
       CASE a.arm WHEN 'ties' THEN t.l_discount * 5e0
                  WHEN 'fine' THEN t.l_extendedprice / (t.l_extendedprice + 50000e0)
                  ELSE {h32("concat_ws('|', 'noise', t.repeat, t.row_key)")} / 4294967296e0 END AS probability
FROM f_targets t, (SELECT unnest(['ties', 'fine', 'noise']) AS arm) a""",
    "f_mult": "",
    "f_phi": """
SELECT t.repeat, t.row_key, t.stay, t.y, t.pod, t."case", t.fold, c.col AS "column",
  CASE c.col WHEN 'quantity' THEN (l_quantity - 25) / 100 * (1 + repeat * 0.1e0) WHEN 'discount' THEN (l_discount - 0.05e0) * 3
             WHEN 'tax' THEN (0.04e0 - l_tax) * 4 * repeat ELSE (l_extendedprice - 50000) / 170017 END AS phi
FROM f_targets t, (SELECT unnest(['quantity', 'discount', 'tax', 'price']) AS col) c""",
    "f_layout": """
SELECT * FROM (VALUES ('quantity', 'quantity', 0, 'value'), ('discount', 'rate', 0, 'value'), ('tax', 'rate', 1, 'value'),
  ('price', 'price', 0, 'observation')) v("column", feature, lag, kind)""",
    "f_report": f"""
SELECT s.* EXCLUDE (probability), s.entity AS stay, a.arm, CASE a.arm WHEN 'model' THEN probability ELSE {h32("concat_ws('|', 'ref', repeat, entity, day)")} / 4294967296e0 END AS probability
FROM f_risk_scores s, (SELECT unnest(['model', 'reference']) AS arm) a""",
    "f_report_mult": "",
    "f_locked_mult": "",
    "f_mult_some": "",
    "f_risk_scores": f"""
SELECT k.*, CAST(r.r AS INTEGER) AS repeat, CASE WHEN event IS NULL THEN 0 ELSE 1 END AS "case",
       CASE WHEN event IS NULL THEN 'none' WHEN event < idx THEN 'c' WHEN event - idx <= 3 THEN 'b' ELSE 'a' END AS grp,
       0.7e0 * ({h32("concat_ws('|', 'rs', r.r, entity, day)")} / 4294967296e0)
         + 0.3e0 * (CASE WHEN event IS NULL THEN 0e0 ELSE 1e0 / (event - day) END) AS probability
FROM f_risk k, (SELECT unnest(range(1, 6)) AS r) r""",
}


def mix32_sql(source: str, name: str) -> str:
    """``source`` with its column ``name`` sent through ``scalars.mix32``."""
    for shift, factor in zip((16, 15), MIX32, strict=True):
        source = f"SELECT * REPLACE ((xor({name}, {name} >> {shift}) * {factor}) & {WORD32} AS {name}) FROM ({source})"
    return f"SELECT * REPLACE (xor({name}, {name} >> 16) AS {name}) FROM ({source})"


def mult_sql(draws: int, source: str = "f_targets", salt: str = "boot", every: int = 1) -> str:
    """Stratified bootstrap multiplicities: slot r of draw d picks the entity ranked hash(d, r) mod n. ``every``: only the draws that it divides."""
    hs = h32("concat_ws('|', 'rank', stay)")
    seed = h32(f"concat_ws('|', '{salt}', c.\"case\")")
    of_draw = mix32_sql(f"""SELECT d.d, c."case", ({seed} + d.d * {DRAW_STEP}) & {WORD32} AS h FROM (SELECT DISTINCT "case" FROM {source}) c,
         (SELECT CAST(unnest(range({every}, {draws} + 1, {every})) AS BIGINT) AS d) d""", "h")
    slots = mix32_sql(f"""SELECT h.d, h."case", u.n, (h.h + (u.rank & {WORD32}) * {RANK_STEP}) & {WORD32} AS pick FROM ({of_draw}) h JOIN (
      SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY {hs}, stay) AS rank, count(*) OVER (PARTITION BY "case") AS n
      FROM (SELECT DISTINCT stay, "case" FROM {source})) u ON u."case" = h."case\"""", "pick")
    return f"""
SELECT CAST(d AS INTEGER) AS draw, "case", stay, m FROM (
  SELECT d, "case", pick % n + 1 AS pick, CAST(count(*) AS INTEGER) AS m FROM ({slots}) GROUP BY ALL) c
JOIN (SELECT stay, "case" AS case2, row_number() OVER (PARTITION BY "case" ORDER BY {hs}, stay) AS rank
      FROM (SELECT DISTINCT stay, "case" FROM {source})) e
  ON e.case2 = c."case" AND e.rank = c.pick"""


QUERY_DRAWS = contract.QUERY_DRAWS
EVERY = max(1, QUERY_DRAWS // 10)  # the draws of full runs that DuckDB repeats
_RISK_ENTITIES = '(SELECT DISTINCT entity AS stay, 0 AS "case" FROM f_risk_scores)'
SQL_VIEWS["f_mult"] = mult_sql(QUERY_DRAWS)
SQL_VIEWS["f_mult_some"] = mult_sql(QUERY_DRAWS, every=EVERY)
SQL_VIEWS["f_report_mult"] = mult_sql(contract.REPORT_DRAWS, _RISK_ENTITIES, "plain")
SQL_VIEWS["f_locked_mult"] = mult_sql(contract.LOCKED_DRAWS, _RISK_ENTITIES, "plain")
