"""Mixing sources to target weights by hierarchical budgeting (operator 8); DataFrame functions only.

A token budget goes down the tree domain -> language -> source in proportion to the children's weights. A child never
gets more than its subtree can give (tokens x ``max_epochs``); what it leaves goes to its siblings first, and only what
the whole subtree can't take goes back to the parent's siblings. Each leaf then gives whole epochs of its documents and
of the next epoch, in an order seeded by the epoch's number, the longest prefix of documents within its budget.

The tree is an aggregate of one row per leaf. No document is sorted or shuffled: tokens are summed per leaf and hash
bucket, and only documents of the one bucket in which a leaf's prefix ends are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import written

LEVELS = ("domain", "lang", "source")
BUCKET_DIGITS = 3  # hex digits: 4,096 buckets in each leaf
SMALL_LEAVES = 20_000  # up to so many leaves (a few MB) the leaf table is sent to all executors; beyond, Spark picks the join
WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 2, "other": 1, "en": 5, "fr": 2, "de": 2, "es": 2}


def default_domain() -> Column:
    """Domain of a source: its trailing number modulo 4; other names, and null, form the domain "other"."""
    number = F.regexp_extract("source", "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("long") % 4).cast("string"))).otherwise(F.lit("other"))


def default_tokens() -> Column:
    """Four UTF-8 bytes a token, rounded up; null text has none."""
    return F.expr("coalesce((octet_length(text) + 3) div 4, 0)")


def _exact(column: str) -> str:
    return f"cast({column} as decimal(19, 0))"


def fill_level(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Water-fill each parent's ``budget`` over its children (``weight`` >= 1, ``capacity``): adds ``given``.

    Children in ascending order of capacity / weight: one is full if its weighted share of what the smaller ones leave
    reaches its capacity; the others share the rest by weight, rounded down.
    """
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col("capacity").cast("double") / F.col("weight"), child)
    below, above = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    step = nodes.withColumns(
        {"__left": F.greatest(F.col("budget") - F.coalesce(F.sum("capacity").over(below), F.lit(0)), F.lit(0)), "__weights": F.sum("weight").over(above)}
    )
    step = step.withColumn("__full", F.expr(f"{_exact('__left')} * {_exact('weight')} >= {_exact('capacity')} * {_exact('__weights')}"))
    step = step.withColumns(
        {
            "__rest": F.col("budget") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("capacity"))).over(group), F.lit(0)),
            "__open": F.coalesce(F.sum(F.when(~F.col("__full"), F.col("weight"))).over(group), F.lit(1)),
        }
    )
    part = F.expr(f"({_exact('__rest')} * {_exact('weight')}) div {_exact('__open')}")
    return step.withColumn("given", F.when(F.col("__full"), F.col("capacity")).otherwise(part)).drop("__left", "__weights", "__full", "__rest", "__open")


def leaf_budgets(leaves: DataFrame, weights: dict[str, int], budget: Column, max_epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) plus ``given``: each leaf's budget in tokens."""
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None).cast("map<string,int>")

    def weight(*path: str) -> Column:
        full = F.concat_ws("/", *path)
        return F.coalesce(F.try_element_at(known, full), F.try_element_at(known, F.col(path[-1])), F.lit(1)).cast("long")

    leaf = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    langs = leaf.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    total = leaf.agg(budget.cast("long").alias("budget"))
    domains = fill_level(domains.crossJoin(F.broadcast(total)).withColumn("weight", weight("domain")), [], "domain")  # total: one row
    langs = langs.join(domains.select("domain", F.col("given").alias("budget")), "domain").withColumn("weight", weight("domain", "lang"))
    langs = fill_level(langs, ["domain"], "lang")
    leaf = leaf.join(langs.select("domain", "lang", F.col("given").alias("budget")), ["domain", "lang"]).withColumn("weight", weight("domain", "lang", "source"))
    return fill_level(leaf, ["domain", "lang"], "source").select(*LEVELS, "tokens", "given")


def mix(
    df: DataFrame, *, weights: dict[str, int] | None = None, share: tuple[int, int] = (1, 1), max_epochs: int = 4, seed: int = 1,
    domain: Column | None = None, tokens: Column | None = None,
) -> DataFrame:
    """Rows of ``df`` that the mixture takes, one per epoch a row is in, with ``mix_domain``, ``mix_tokens`` and ``mix_epoch`` (from 0).

    ``weights``: whole numbers >= 1 by node name or path ("d0", "d0/en", "d0/en/src4"), 1 where none is given. Budget:
    ``share`` (numerator, denominator) of all tokens. Null lang and source are leaves of their own (""). Rows with equal
    doc_id have one place in an epoch's order and enter together or not at all; null doc_id counts as one such id. Empty
    and null texts have no tokens and follow their place in the order; a leaf without tokens gives nothing. An empty table
    gives an empty result. Extra columns pass through; columns with the three new names are replaced.
    """
    domain, tokens = default_domain() if domain is None else domain, default_tokens() if tokens is None else tokens
    weights = WEIGHTS if weights is None else weights
    plain = df.drop("mix_domain", "mix_tokens", "mix_epoch")
    keyed = plain.withColumns(
        {"__d": F.coalesce(domain, F.lit("")), "__l": F.coalesce(F.col("lang"), F.lit("")), "__s": F.coalesce(F.col("source"), F.lit("")), "mix_tokens": tokens}
    )
    narrow = written(keyed.select(F.col("__d").alias("domain"), F.col("__l").alias("lang"), F.col("__s").alias("source"), "doc_id", "mix_tokens"), "mixing")
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("mix_tokens").alias("tokens"))
    budget = F.expr(f"(cast(sum(tokens) as decimal(28, 0)) * {share[0]}) div {share[1]}")
    given = leaf_budgets(leaves, weights, F.coalesce(budget, F.lit(0)), max_epochs).where("tokens > 0")
    given = written(given.select(*LEVELS, F.expr("given div tokens").alias("epochs"), F.expr("given % tokens").alias("rest")), "mixing")
    n = given.count()
    sent = F.broadcast if n <= SMALL_LEAVES else (lambda x: x)

    def place(doc_id: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))

    placed = narrow.join(sent(given), list(LEVELS)).withColumn("place", place(F.col("doc_id")))
    placed = placed.withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    buckets = placed.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("mix_tokens").alias("held"))
    upto = Window.partitionBy(*LEVELS).orderBy("bucket")
    buckets = buckets.withColumn("after", F.sum("held").over(upto)).where("after > rest")
    edge = buckets.groupBy(*LEVELS).agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("after") + F.col("held")).alias("room")), "bucket").alias("edge"))
    edge = edge.select(*LEVELS, "edge.bucket", "edge.room")
    inside = placed.join(sent(edge), [*LEVELS, "bucket"]).select(*LEVELS, "room", "place", "mix_tokens")
    upto = Window.partitionBy(*LEVELS).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("used", F.sum("mix_tokens").over(upto)).where("used <= room").groupBy(*LEVELS).agg(F.max("place").alias("last"))
    limits = given.join(edge, list(LEVELS), "left").join(last, list(LEVELS), "left")
    limits = written(limits.select(F.col("domain").alias("__d"), F.col("lang").alias("__l"), F.col("source").alias("__s"), "epochs", F.coalesce("last", "bucket", F.lit("g")).alias("__limit")), "mixing")
    taken = keyed.join(sent(limits.withColumnRenamed("epochs", "__epochs")), ["__d", "__l", "__s"])
    here = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    copies = (F.col("__epochs") + F.when(here <= F.col("__limit"), 1).otherwise(0)).cast("int")
    taken = taken.withColumn("__copies", copies).where("__copies > 0")
    return taken.select(*[F.col(f"`{c}`") for c in plain.columns], F.col("__d").alias("mix_domain"), "mix_tokens", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)).alias("mix_epoch"))


_WEIGHT = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 1 END"


def _fill_sql(name: str, source: str, parent: str, child: str) -> str:
    """One level of water-filling as common table expressions."""
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_a AS (SELECT *, greatest(budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::HUGEINT AS room,
  (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS weights FROM {source}
  WINDOW w AS ({by} ORDER BY capacity::DOUBLE / weight, {child})),
{name}_b AS (SELECT *, room * weight >= capacity * weights AS is_full FROM {name}_a),
{name}_c AS (SELECT *, (budget - coalesce(sum(CASE WHEN is_full THEN capacity END) OVER ({by}), 0))::HUGEINT AS left_over,
  coalesce(sum(CASE WHEN NOT is_full THEN weight END) OVER ({by}), 1)::HUGEINT AS open_weights FROM {name}_b),
{name} AS (SELECT * EXCLUDE (room, weights, is_full, left_over, open_weights), CASE WHEN is_full THEN capacity ELSE left_over * weight // open_weights END AS given FROM {name}_c)"""


def mix_sql(share: tuple[int, int] = (1, 1), max_epochs: int = 4, seed: int = 1) -> str:
    """The registered query in DuckDB's SQL, without buckets: one running sum per leaf."""
    return f"""
WITH d AS (SELECT doc_id, CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> '' THEN 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 4) ELSE 'other' END AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce((strlen(text) + 3) // 4, 0)::BIGINT AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens, (sum(tokens) * {max_epochs})::HUGEINT AS capacity FROM d GROUP BY ALL),
dom_in AS (SELECT domain, sum(capacity)::HUGEINT AS capacity, {_WEIGHT.format("domain")} AS weight, (SELECT sum(tokens)::HUGEINT * {share[0]} // {share[1]} FROM leaf) AS budget FROM leaf GROUP BY domain),
{_fill_sql("dom", "dom_in", "", "domain")},
lng_in AS (SELECT leaf.domain, leaf.lang, sum(leaf.capacity)::HUGEINT AS capacity, {_WEIGHT.format("leaf.lang")} AS weight, any_value(dom.given) AS budget FROM leaf JOIN dom USING (domain) GROUP BY ALL),
{_fill_sql("lng", "lng_in", "domain", "lang")},
src_in AS (SELECT leaf.domain, leaf.lang, leaf.source, leaf.tokens, leaf.capacity, {_WEIGHT.format("leaf.source")} AS weight, lng.given AS budget FROM leaf JOIN lng USING (domain, lang)),
{_fill_sql("src", "src_in", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, (given // tokens)::BIGINT AS epochs, given % tokens AS rest FROM src WHERE tokens > 0),
run AS (SELECT d.doc_id, domain, lang, source, d.tokens, epochs, rest,
  sum(d.tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || epochs || ':' || coalesce(doc_id::VARCHAR, 'null'))) AS used FROM d JOIN plan USING (domain, lang, source)),
copies AS (SELECT *, epochs + CASE WHEN used <= rest THEN 1 ELSE 0 END AS n FROM run)
SELECT doc_id, domain AS mix_domain, lang, source, tokens AS mix_tokens, unnest(range(n))::INTEGER AS mix_epoch FROM copies WHERE n > 0
"""
