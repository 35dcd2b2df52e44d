"""DuckDB building blocks for the metric queries: plain window sums over score groups."""


def groups_sql(source: str, keys: str, score: str = "probability", w: str = "1") -> str:
    return (f"SELECT {keys}, {score} AS s, CAST(sum(CASE WHEN y = 1 THEN {w} ELSE 0 END) AS DOUBLE) AS pos,"
            f" CAST(sum(CASE WHEN y = 0 THEN {w} ELSE 0 END) AS DOUBLE) AS neg FROM {source} GROUP BY {keys}, {score}")


def metrics_sql(source: str, keys: str, score: str = "probability", w: str = "1") -> str:
    """(keys, n_pos, n_neg, auc, ap, brier)."""
    return f"""
SELECT {keys}, p AS n_pos, n AS n_neg, CASE WHEN p > 0 AND n > 0 THEN u / (p * n) END AS auc,
  CASE WHEN p > 0 THEN a / p END AS ap, CASE WHEN p + n > 0 THEN b / (p + n) END AS brier FROM (
 SELECT {keys}, sum(pos) AS p, sum(neg) AS n, sum(pos * (cn - neg / 2)) AS u,
   sum(CASE WHEN dp + dn > 0 THEN pos * dp / (dp + dn) ELSE 0 END) AS a, sum(pos * (s - 1) * (s - 1) + neg * s * s) AS b
 FROM (SELECT *, sum(neg) OVER (PARTITION BY {keys} ORDER BY s) AS cn, sum(pos) OVER (PARTITION BY {keys} ORDER BY s DESC) AS dp,
        sum(neg) OVER (PARTITION BY {keys} ORDER BY s DESC) AS dn FROM ({groups_sql(source, keys, score, w)}))
 GROUP BY {keys})"""


SCOPE_ROWS = """(SELECT r.*, sc.scope FROM {source} r, (SELECT unnest(['total', 'post', 'pre', 'cross']) AS scope) sc
 WHERE sc.scope = 'total' OR (sc.scope = 'post' AND pod >= 0) OR (sc.scope = 'pre' AND pod < 0)
   OR (sc.scope = 'cross' AND (y = 1 OR pod < 0)))"""

METRIC_MAP = [("AUROC_total", "total", "auc"), ("AUROC_post", "post", "auc"), ("AUROC_cross_phase", "cross", "auc"),
              ("AUROC_pre", "pre", "auc"), ("AP_total", "total", "ap"), ("AP_post", "post", "ap"),
              ("Brier_total", "total", "brier"), ("Brier_post", "post", "brier")]


def phase_sql(source: str, keys: str, w: str = "1") -> str:
    """(keys, metric, value): the eight metrics in long form."""
    m = f"({metrics_sql(SCOPE_ROWS.format(source=source), keys + ', scope', w=w)})"
    values = ", ".join(f"('{n}', '{s}', '{c}')" for n, s, c in METRIC_MAP)
    return (f"SELECT {keys}, metric, CASE st WHEN 'auc' THEN auc WHEN 'ap' THEN ap ELSE brier END AS value FROM {m} m"
            f" JOIN (VALUES {values}) v(metric, sc, st) ON v.sc = m.scope")


def repeat_mean_sql(inner: str, keys: str, value: str = "value") -> str:
    return (f"SELECT {keys}, CASE WHEN count({value}) = count(*) THEN avg({value}) END AS {value} FROM ({inner}) GROUP BY {keys}")
