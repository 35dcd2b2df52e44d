"""Contract checks. Each returns violations ``(check, n, sample_key)``; ``require`` raises on any.

Nothing is repaired. All checks are aggregations or equi joins; no row reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize


class ContractError(ValueError):
    """A contract check found violations."""


def require(violations: DataFrame) -> None:
    """Raise when any check reports rows (the report has one row per check)."""
    bad = violations.where(F.col("n") > 0).orderBy("check").collect()
    if bad:
        raise ContractError("; ".join(f"{r['check']}: {r['n']}" for r in bad))


def _key(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def _report(agg: DataFrame, names: Sequence[str]) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(n).alias("check"), F.coalesce(F.col(f"{n}__n"), F.lit(0)).alias("n"),
                 F.col(f"{n}__k").alias("sample_key"))
        for n in names
    ])
    return agg.select(F.explode(rows).alias("r")).select("r.*")


def row_rules(df: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """Count rows breaking each rule in one pass; the smallest broken key is the sample."""
    aggs = []
    for name, broken in rules.items():
        b = F.coalesce(broken, F.lit(False))
        aggs += [F.count_if(b).alias(f"{name}__n"), F.min(F.when(b, _key(key))).alias(f"{name}__k")]
    return _report(df.agg(*aggs), list(rules))


def group_rules(df: DataFrame, group: Sequence[str], aggs: Mapping[str, Column], rules: Mapping[str, Column]) -> DataFrame:
    """Aggregate per group, then count groups breaking each rule."""
    per = df.groupBy(*group).agg(*[c.alias(n) for n, c in aggs.items()])
    return row_rules(per, group, rules)


def duplicates(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    return group_rules(df, key, {"__c": F.count("*")}, {name: F.col("__c") > 1})


def varies(column: str) -> Column:
    """Aggregate: the column takes more than one value, NULL counting as a value."""
    c = F.col(column)
    return (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1))))


def stack(*reports: DataFrame) -> DataFrame:
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Exact column set."""
    if sorted(df.columns) != sorted(columns):
        raise ContractError(f"columns {sorted(df.columns)} differ from {sorted(columns)}")


def check_keys(df: DataFrame, *, entity: str, day: str, row_id: str) -> DataFrame:
    """Null keys, non-integer days, duplicate (entity, day), duplicate or missing row ids."""
    d = F.col(day).cast("double")
    return stack(
        row_rules(df, [entity, day], {
            "null_entity": F.col(entity).isNull(),
            "null_or_fractional_day": d.isNull() | F.isnan(d) | (d != F.floor(d)),
            "null_row_id": F.col(row_id).isNull(),
        }),
        duplicates(df, [entity, day], "duplicate_entity_day"),
        duplicates(df.where(F.col(row_id).isNotNull()), [row_id], "duplicate_row_id"),
    )


def check_entity_ids(df: DataFrame, entity: str) -> DataFrame:
    """Null, blank or non-finite ids. A float32 column is rejected outright: its ids already lost digits."""
    kind = df.schema[entity].dataType
    if isinstance(kind, T.FloatType):
        raise ContractError("float32 entity ids have lost precision")
    c = F.col(entity)
    rules = {"null_id": c.isNull()}
    if isinstance(kind, T.StringType):
        rules["blank_id"] = F.trim(c).isin("", ".", "nan", "None", "NaN", "NA")
    if isinstance(kind, T.DoubleType):
        rules["non_finite_id"] = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return row_rules(df, [entity], rules)


def check_anchors(keys: DataFrame, anchors: DataFrame, *, entity: str, start: str, index: str) -> DataFrame:
    """Unique anchors, every key entity present, integer start and index, index on or after start."""
    missing = keys.select(entity).distinct().join(anchors.select(entity), entity, "left_anti")
    s, i = F.col(start).cast("double"), F.col(index).cast("double")
    return stack(
        duplicates(anchors, [entity], "duplicate_anchor"),
        row_rules(missing, [entity], {"entity_without_anchor": F.lit(True)}),
        row_rules(anchors, [entity], {
            "fractional_anchor": s.isNull() | i.isNull() | (s != F.floor(s)) | (i != F.floor(i)),
            "index_before_start": i < s,
        }),
    )


def check_targets(
    df: DataFrame, *, repeats: Sequence[int], folds: int | None = None, allow_pre_positive: bool = True
) -> DataFrame:
    """Evaluation-target contract on (repeat, row_key, stay, y, pod, case [, fold] [, post])."""
    meta = ["repeat", "row_key", "stay", "y", "pod", "case"]
    pod = F.col("pod").cast("double")
    any_null = F.lit(False)
    for c in meta:
        any_null = any_null | F.col(c).isNull()
    rules = {
        "missing_metadata": any_null,
        "label_not_binary": ~F.col("y").isin(0, 1),
        "case_not_binary": ~F.col("case").isin(0, 1),
        "positive_row_of_control": (F.col("y") == 1) & (F.col("case") == 0),
        "rel_day_not_integer": pod != F.floor(pod),
        "unknown_repeat": ~F.col("repeat").isin(list(repeats)),
    }
    if not allow_pre_positive:
        rules["positive_row_before_index"] = (F.col("y") == 1) & (F.col("pod") < 0)
    if "post" in df.columns:
        rules["phase_disagrees"] = F.col("post") != (F.col("pod") >= 0)
    if folds:
        rules["fold_out_of_range"] = F.col("fold").isNull() | ~F.col("fold").between(0, folds - 1)
    key = ["repeat", "row_key"]
    reports = [
        row_rules(df, key, rules),
        duplicates(df, key, "duplicate_target"),
        duplicates(df, ["repeat", "stay", "pod"], "duplicate_entity_day"),
        group_rules(df, ["stay"], {"v": varies("case")}, {"case_varies": F.col("v")}),
        group_rules(df, ["row_key"], {f"v_{c}": varies(c) for c in meta[2:]},
                    {f"{c}_varies_across_repeats": F.col(f"v_{c}") for c in meta[2:]}),
    ]
    if folds:
        reports += [
            group_rules(df, ["repeat", "stay"], {"v": varies("fold")}, {"entity_in_two_folds": F.col("v")}),
            group_rules(df.select("repeat", "fold").distinct(), ["repeat"], {"c": F.count("fold")},
                        {"repeat_without_all_folds": F.col("c") < folds}),
        ]
    return stack(*reports)


def check_predictions(
    targets: DataFrame, predictions: DataFrame, *, metadata: Sequence[str] = ("stay", "y", "pod", "case"), within: str | None = None
) -> DataFrame:
    """Per arm: coverage both ways, identical metadata, probability within [0, 1], no duplicate keys.

    ``within``: one of the metadata. Tables that are partitioned by it are compared where they are; only predictions without a target
    there are looked up among all targets. If one of them has its target elsewhere (a wrong ``within``), or target keys repeat or are
    null, or an arm is, all rows are joined by key, as without ``within``. The report is the same in each case.
    """
    key = ["repeat", "row_key"]
    if within is not None and (found := _predictions_within(targets, predictions, key, metadata, within)) is not None:
        return found
    arms = predictions.select("arm").distinct()
    arm_list = arms.agg(F.sort_array(F.collect_set("arm")).alias("a")).select("a").scalar()
    want = targets.select(*key, *metadata).withColumn("arm", F.explode(arm_list))
    t = want.select("arm", *key, *[F.col(m).alias(f"t_{m}") for m in metadata], F.lit(True).alias("in_t"))
    p = predictions.select("arm", *key, *[F.col(m).alias(f"p_{m}") for m in metadata], "probability",
                           F.lit(True).alias("in_p"))
    both = t.join(p, ["arm", *key], "full_outer")
    matched = F.col("in_t").isNotNull() & F.col("in_p").isNotNull()
    differs = F.lit(False)
    for m in metadata:
        differs = differs | ~F.col(f"t_{m}").eqNullSafe(F.col(f"p_{m}"))
    prob = F.col("probability")
    return stack(
        row_rules(both, ["arm", *key], {
            "prediction_missing": F.col("in_p").isNull(),
            "prediction_without_target": F.col("in_t").isNull(),
            "metadata_differs": matched & differs,
            "invalid_probability": F.col("in_p").isNotNull() & (prob.isNull() | F.isnan(prob) | (prob < 0) | (prob > 1)),
        }),
        duplicates(predictions, ["arm", *key], "duplicate_prediction"),
    )


def _predictions_within(targets: DataFrame, predictions: DataFrame, key: Sequence[str], metadata: Sequence[str], within: str) -> DataFrame | None:
    """The report of ``check_predictions`` from one sort per ``within``; None where rows have to be joined by key."""
    others = [m for m in metadata if m != within]
    lane = [within, *key]
    none, prob, has = F.lit(None), F.col("probability"), F.col("__n_t") == 1
    t = targets.select(*lane, *others, none.cast(predictions.schema["arm"].dataType).alias("arm"), none.cast("double").alias("probability"), F.lit(1).alias("__t"))
    p = predictions.select(*lane, *others, "arm", F.col("probability").cast("double").alias("probability"), F.lit(0).alias("__t"))
    at = Window.partitionBy(*lane).orderBy("arm")  # a target, without an arm, comes first
    all_at = at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = t.unionByName(p).select(
        *key, within, "arm", "probability", "__t", F.sum("__t").over(all_at).alias("__n_t"), F.collect_set("arm").over(all_at).alias("__arms"), F.lag("arm").over(at).alias("__last"),
        *[F.col(m).alias(f"__p_{m}") for m in others], *[F.first(m).over(all_at).alias(f"__t_{m}") for m in others])
    differs, odd = F.lit(False), F.col("__n_t") > 1
    for m in others:
        differs = differs | ~F.col(f"__t_{m}").eqNullSafe(F.col(f"__p_{m}"))
    for c in lane:
        odd = odd | F.col(c).isNull()
    is_p, again = F.col("__t") == 0, F.col("arm").eqNullSafe(F.col("__last"))
    odd = odd | (is_p & F.col("arm").isNull())
    foreign = is_p & ~has
    invalid = is_p & (prob.isNull() | F.isnan(prob) | (prob < 0) | (prob > 1))
    first_again = is_p & has & again
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    # few groups a task: sets of arms at a target, arms of predictions; keys of predictions without a target, or named twice, are listed by task
    listed = F.when(foreign | first_again, F.struct(*[F.col(c).alias(c) for c in key], name.alias("k")))
    marked = rows.withColumn("part", F.spark_partition_id())
    groups = marked.groupBy("part", "__t", "arm", F.when(F.col("__t") == 1, F.col("__arms")).alias("arms"), foreign.alias("foreign")).agg(
        F.count("*").alias("n"), F.min(name).alias("k"), F.count_if(differs & is_p & has).alias("n_differs"), F.min(F.when(differs & is_p & has, name)).alias("k_differs"),
        F.count_if(invalid).alias("n_invalid"), F.min(F.when(invalid, name)).alias("k_invalid"), F.max(odd).alias("odd"), F.collect_list(listed).alias("listed"))
    groups = materialize(groups)
    keyed = groups.where("size(listed) > 0").select("arm", "foreign", F.explode("listed").alias("x")).select("arm", "foreign", "x.*")
    lost = keyed.where("foreign")
    elsewhere = targets.select(*key).join(lost.select(*key).distinct(), list(key), "left_semi")
    if groups.where("odd").limit(1).count() or elsewhere.limit(1).count():
        return None
    arm, of = F.col("arm"), lambda a, k: F.concat_ws("|", a, k)
    arm_list = groups.where("__t = 0").agg(F.sort_array(F.collect_set("arm")).alias("a")).select("a").scalar()
    missing = groups.where("__t = 1").select(F.explode(F.array_except(arm_list, F.col("arms"))).alias("arm"), "n", "k")
    preds = groups.where("__t = 0")
    twice = lost.groupBy("arm", *key).agg(F.count("*").alias("c"), F.min("k").alias("k")).where("c > 1").select("arm", "k")
    twice = twice.unionByName(keyed.where("not foreign").select("arm", "k").distinct())

    def line(df: DataFrame, check: str, n: Column, k: Column) -> DataFrame:
        return df.agg(F.coalesce(n, F.lit(0)).cast("long").alias("n"), F.min(k).alias("sample_key")).select(F.lit(check).alias("check"), "n", "sample_key")

    return stack(
        line(missing, "prediction_missing", F.sum("n"), of(arm, F.col("k"))),
        line(preds.where("foreign"), "prediction_without_target", F.sum("n"), of(arm, F.col("k"))),
        line(preds, "metadata_differs", F.sum("n_differs"), F.when(F.col("n_differs") > 0, of(arm, F.col("k_differs")))),
        line(preds, "invalid_probability", F.sum("n_invalid"), F.when(F.col("n_invalid") > 0, of(arm, F.col("k_invalid")))),
        line(twice, "duplicate_prediction", F.count("*"), of(arm, F.col("k"))))


def align_predictions(targets: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions joined to the independent targets by exact key; check coverage with ``check_predictions``."""
    key = ["repeat", "row_key"]
    return targets.join(predictions.select(*key, "arm", "probability"), key)


def unique_records(df: DataFrame, *, entity: str, record: str, payload: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, conflicts): one row per record id; records without id are merged on their whole payload.

    A conflict is an id with two different payloads; the caller must not continue with conflicts.
    """
    digest = F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256)
    has_id = F.col(record).isNotNull() & (F.col(record).cast("string") != "")
    rid = F.when(has_id, F.concat(F.lit("id:"), F.col(record).cast("string"))).otherwise(F.concat(F.lit("row:"), digest))
    per = (
        df.select(entity, rid.alias("__rid"), digest.alias("__d"), F.struct(record, *payload).alias("__p"))
        .groupBy(entity, "__rid")
        .agg(F.min("__d").alias("lo"), F.max("__d").alias("hi"), F.min_by("__p", "__d").alias("__p"))
    )
    kept = per.where("lo = hi").select(entity, "__p.*")
    conflicts = per.where("lo <> hi").select(entity, "__p.*")
    return kept, conflicts


def index_record_match(
    records: DataFrame, master: DataFrame, *, entity: str, op: str, date: str, index_op: str, index_date: str
) -> DataFrame:
    """Marks index records; ``date_conflict`` when the id matches but the date does not."""
    m = master.select(entity, F.col(index_op).alias("__op"), F.col(index_date).alias("__date"))
    joined = records.join(m, entity, "left")
    is_index = F.coalesce(F.col(op) == F.col("__op"), F.lit(False))
    return joined.select(
        *records.columns,
        is_index.alias("is_index"),
        (is_index & ~F.col(date).eqNullSafe(F.col("__date"))).alias("date_conflict"),
    )


def check_encoding_inputs(
    df: DataFrame, *, entity: str, site: str, codes: Mapping[str, str], forbidden: Sequence[str]
) -> DataFrame:
    """``codes`` maps code column -> gate column. Closed gates hold no codes, no forbidden code, one site per entity."""
    rules = {}
    for c, g in codes.items():
        rules[f"{c}_visible_while_closed"] = ~F.col(g) & (F.size(c) > 0)
        rules[f"{c}_forbidden"] = F.exists(c, lambda v: v.isin(list(forbidden)))
    return stack(row_rules(df, [entity], rules),
                 group_rules(df, [entity], {"v": varies(site)}, {"site_varies": F.col("v")}))


def recover_ids(lossy: DataFrame, raw: DataFrame, *, lossy_id: str, raw_id: str) -> DataFrame:
    """Map float32 ids to the one raw id that rounds to them; ambiguous and unknown ids are marked."""
    by = raw.select(raw_id).distinct().groupBy(F.col(raw_id).cast("float").alias(lossy_id)).agg(
        F.count("*").alias("__c"), F.min(raw_id).alias(raw_id)
    )
    out = lossy.join(by, lossy_id, "left")
    status = F.when(F.col("__c").isNull(), "unknown").when(F.col("__c") > 1, "ambiguous").otherwise("recovered")
    return out.select(*lossy.columns, F.when(F.col("__c") == 1, F.col(raw_id)).alias(raw_id), status.alias("status"))


def check_context(df: DataFrame, *, repeat: int, fold: int | None = None) -> DataFrame:
    rules = {"other_repeat": F.col("repeat") != repeat}
    if fold is not None:
        rules["other_fold"] = F.col("fold") != fold
    return row_rules(df, ["repeat", "row_key"], rules)


def reconcile(clean: DataFrame, cache: DataFrame, *, key: Sequence[str], label: str, case: str, group: str,
              compare: Sequence[str], max_unmatched: float = 0.05, max_positive_loss: float = 0.02) -> DataFrame:
    """One-row audit of a clean table against the rebuilt calendar: 1:1 left join with match indicator."""
    entity = key[0]
    marked = clean.join(
        cache.select(*key, group, *[F.col(c).alias(f"__c_{c}") for c in compare], F.lit(True).alias("__hit")), key, "left"
    )
    lost = F.col("__hit").isNull()
    per = marked.agg(
        F.count("*").alias("rows"),
        F.count_if(lost).alias("unmatched"),
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(lost & (F.col(label) == 1)).alias("positives_lost"),
        F.countDistinct(entity).alias("entities"),
        F.countDistinct(F.when(F.col(case) == 1, F.col(entity))).alias("case_entities"),
        *[F.count_if(~lost & ~F.col(c).eqNullSafe(F.col(f"__c_{c}"))).alias(f"disagree_{c}") for c in compare],
    )
    bad = F.lit(0)
    for c in compare:
        bad = bad + F.col(f"disagree_{c}")
    return per.withColumn(
        "passed",
        (F.col("unmatched") <= max_unmatched * F.col("rows"))
        & (F.col("positives_lost") <= max_positive_loss * F.col("positives"))
        & (bad == 0),
    )


def control_composition(clean: DataFrame, cache: DataFrame, *, entity: str, case: str, group: str) -> DataFrame:
    """Control entities of the clean table by their cache group."""
    g = cache.groupBy(entity).agg(F.min(group).alias(group))
    ctl = clean.groupBy(entity).agg(F.max(case).alias("__case")).where("__case = 0")
    return ctl.join(g, entity, "left").groupBy(F.coalesce(group, F.lit("absent")).alias(group)).agg(
        F.count("*").alias("n"))


def select_requested(complete: DataFrame, requested: DataFrame, key: Sequence[str]) -> DataFrame:
    """Requested rows with a match flag (1:1 left join); any unmatched row is a contract violation."""
    return requested.join(complete.withColumn("matched", F.lit(1)), key, "left").withColumn(
        "matched", F.coalesce("matched", F.lit(0)))


def check_event_anchors(rows: DataFrame, events: DataFrame, *, low: int = 1, high: int = 31) -> DataFrame:
    """The anchor of each case must be its first eligible event; positive rows must lead it by 1..3 days.

    rows: stay, case, y, day, pod, event_day. events: stay, event_day.
    """
    cases = rows.where("case = 1").groupBy("stay").agg(
        F.min("event_day").alias("anchor"), varies("event_day").alias("anchor_varies"),
        F.min(F.col("day") - F.col("pod")).alias("index_day"), F.count_if(F.col("y") == 1).alias("positives"),
    )
    rel = F.col("e.event_day") - F.col("c.index_day")
    eligible = events.alias("e").join(cases.alias("c"), F.col("e.stay") == F.col("c.stay")).where(
        rel.between(low, high)
    ).groupBy(F.col("c.stay").alias("stay")).agg(F.min("e.event_day").alias("first_event"))
    joined = cases.join(eligible, "stay", "left")
    lead = F.col("event_day") - F.col("day")
    return stack(
        row_rules(joined, ["stay"], {
            "anchor_missing": F.col("anchor").isNull(),
            "anchor_varies": F.col("anchor_varies"),
            "anchor_not_first_eligible_event": ~F.col("anchor").eqNullSafe(F.col("first_event")),
            "case_without_positive_row": F.col("positives") == 0,
        }),
        row_rules(rows.where("y = 1"), ["stay"], {"lead_outside_1_3": ~F.coalesce(lead.between(1, 3), F.lit(False))}),
    )


def check_equal_columns(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    aggs = [F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(f"{a}={b}") for a, b in pairs]
    rows = F.array(*[F.struct(F.lit(f"{a}={b}").alias("pair"), F.col(f"`{a}={b}`").alias("n")) for a, b in pairs])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def truncate_as_of(
    records: DataFrame, cutoffs: DataFrame, *, entity: str, cutoff: str, start: str, dates: Sequence[str]
) -> DataFrame:
    """Records as known at the end of the cutoff day: later starts are dropped, later dates are blanked one by one."""
    limit = F.col(cutoff) + 1
    kept = records.join(cutoffs.select(entity, cutoff), entity).where(F.col(start) < limit)
    return kept.select(*[F.when(F.col(c) < limit, F.col(c)).alias(c) if c in dates else F.col(c)
                         for c in records.columns])


def check_population(df: DataFrame, *, entity: str, label: str, case: str, expected: Mapping[str, int | Column]) -> DataFrame:
    """Observed counts next to the contracted ones: numbers, or scalars of other tables."""
    agg = df.agg(
        F.count("*").alias("rows"),
        F.countDistinct(entity).alias("entities"),
        F.countDistinct(F.when(F.col(case) == 1, F.col(entity))).alias("cases"),
        F.count_if(F.col(label) == 1).alias("positives"),
    )
    rows = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("n"),
                              F.lit(expected.get(n)).cast("long").alias("expected")) for n in
                     ("rows", "entities", "cases", "positives")])
    return agg.select(F.explode(rows).alias("r")).select("r.*")


def check_partition(df: DataFrame, *, entity: str, part: str, label: str) -> DataFrame:
    """Entities present in two parts, and parts with a single label class."""
    return stack(
        group_rules(df, [entity], {"v": F.min(part) != F.max(part)}, {"entity_in_two_parts": F.col("v")}),
        group_rules(df, [part], {"lo": F.min(label), "hi": F.max(label)}, {"single_class_part": F.col("lo") == F.col("hi")}),
    )


def check_labels(rows: DataFrame, labels: DataFrame, *, key: str, label: str) -> DataFrame:
    """Separate label table: unique keys, complete coverage both ways, binary values."""
    lab = labels.select(key, label)
    return stack(
        duplicates(lab, [key], "duplicate_label"),
        row_rules(rows.select(key).join(lab.select(key), key, "left_anti"), [key], {"row_without_label": F.lit(True)}),
        row_rules(lab.select(key).join(rows.select(key), key, "left_anti"), [key], {"label_without_row": F.lit(True)}),
        row_rules(lab, [key], {"label_not_binary": F.col(label).isNull() | ~F.col(label).isin(0, 1)}),
    )


# --- metadata checks: they look at names only, no data is read ---


def lineage_roots(columns: Sequence[str], parents: Mapping[str, Sequence[str]], leaves: Sequence[str]) -> dict[str, set]:
    """Registered leaves each column depends on; cycles and unknown leaves are errors."""
    leaf = set(leaves)
    done: dict[str, set] = {}

    def walk(name: str, path: tuple[str, ...]) -> set:
        if name in path:
            raise ContractError("lineage cycle: " + " > ".join((*path, name)))
        if name not in done:
            if name in parents:
                done[name] = set().union(*(walk(p, (*path, name)) for p in parents[name]))
            elif name in leaf:
                done[name] = {name}
            else:
                raise ContractError(f"unknown lineage leaf {name}")
        return done[name]

    return {c: walk(c, ()) for c in columns}


def expected_layout(features: Sequence[str], window: int, representation: str, cap: int) -> list[str]:
    """Declared column list of a recipe: k, k*w+w+1 or 7k+1 columns, at most ``cap``."""
    from tidemark.operators.windows import SUMMARIES

    if window == 1:
        out = list(features)
    elif representation == "R1":
        out = [f"{f}__lag{lag}" for lag in range(window) for f in features]
        out += [f"row_observed__lag{lag}" for lag in range(window)] + ["window_observed_day_count"]
    elif representation == "R3":
        out = [f"{f}__{s}" for f in features for s in SUMMARIES] + ["window_observed_day_count"]
    else:
        raise ContractError("representation must be R1 or R3")
    if len(out) > cap:
        raise ContractError(f"{len(out)} engineered columns exceed {cap}")
    return out
