import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.ordered import exact_quantiles, hash_rank, running, value_block, weighted_quantiles


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("text,days,date_only", [
    ("01-Jan-00", 36526.0, True), ("31-Dec-68", 61728.0, True), ("01-Jan-69", 25204.0, True), (" 15-mar-21 ", 44270.0, True),
    ("15MAR21:12:00:00", 44270.5, False), ("15MAR21:24:00:00", None, False), ("31-Feb-20", None, False), (".", None, False),
    ("", None, False), (None, None, False), ("15-Foo-20", None, False), ("2021-03-15", None, False),
])
def test_serial_day(spark, text, days, date_only):
    row = frame(spark, [(text,)], "t string").select(scalars.serial_day("t"), scalars.date_only_flag("t")).first()
    assert row[0] == days and row[1] is date_only


def test_serial_and_day_number_agree(spark):
    row = frame(spark, [("2024-02-29 06:00:00",)], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("ts")).select(scalars.serial_number("ts"), scalars.day_number("ts")).first()
    assert row[0] == row[1] + 0.25


def test_forbidden_names():
    names = ["age", "outcome_day", "my-outcome", "outcomes", "lbl_x"]
    assert scalars.forbidden_names(names, ["outcome"], ["lbl_"]) == ["outcome_day", "my-outcome", "lbl_x"]


def test_clip_keeps_null(spark):
    rows = frame(spark, [(None,), (9.0,), (-9.0,)], "x double").select(scalars.clip("x", -6, 6)).collect()
    assert [r[0] for r in rows] == [None, 6.0, -6.0]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.floats(0, 1), st.just(0.0), st.integers(-64, 64).map(lambda k: 2.0**k)), min_size=2, max_size=200))
def test_value_block_is_monotone(spark, values):
    rows = frame(spark, [(float(v),) for v in values], "x double").select("x", value_block("x").alias("b")).orderBy("x").collect()
    blocks = [r["b"] for r in rows]
    assert blocks == sorted(blocks)


def test_running_matches_plain_cumsum(spark):
    rng = np.random.default_rng(3)
    vals = rng.normal(size=400).round(3)
    vals = np.unique(vals)
    rows = [(int(i % 3), float(v), float(abs(v))) for i, v in enumerate(vals)]
    df = frame(spark, rows, "g int, x double, w double")
    got = running(df, ["g"], ["x"], block=value_block("x"), sums={"c": "w"}, maxes={"m": "w"}, totals=True).collect()
    for g in range(3):
        mine = sorted((r["x"], r["c"], r["m"], r["c_total"]) for r in got if r["g"] == g)
        w = np.array([abs(r[0]) for r in mine])
        assert np.allclose([r[1] for r in mine], np.cumsum(w))
        assert np.allclose([r[2] for r in mine], np.maximum.accumulate(w))
        assert np.allclose([r[3] for r in mine], w.sum())


def test_running_before_excludes_current_row(spark):
    df = frame(spark, [(1, 1.0, 5), (1, 2.0, 7), (1, 40.0, 9)], "g int, x double, w long")
    got = running(df, ["g"], ["x"], block=value_block("x"), sums={"c": "w"}, maxes={"m": "w"}, before=True).orderBy("x").collect()
    assert [(r["c"], r["m"]) for r in got] == [(0, None), (5, 5), (12, 7)]


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.lognormal(size=300), np.full(150, 0.25)]  # a third of the rows share one value
    df = frame(spark, [("a", float(v)) for v in x] + [("b", 1.0), ("b", None)], "g string, x double")
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "x", {"q1": 0.25, "m": 0.5, "hi": 0.975}).collect()}
    assert np.allclose([got["a"][k] for k in ("q1", "m", "hi")], np.quantile(x, [0.25, 0.5, 0.975]))
    assert got["b"]["n"] == 1 and got["b"]["m"] == 1.0


def test_weighted_quantile_is_inverse_cdf(spark):
    df = frame(spark, [("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 2.0)], "g string, x double, w double")
    r = weighted_quantiles(df, ["g"], "x", "w", {"q25": 0.25, "m": 0.5, "q75": 0.75}).first()
    assert (r["q25"], r["m"], r["q75"]) == (1.0, 2.0, 3.0)


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("g")).withColumn("h", scalars.hash32(F.lit("s"), "id"))
    got = hash_rank(df.repartition(7), ["g"], "h", "id").collect()
    for g in (0, 1):
        mine = sorted(r["rank"] for r in got if r["g"] == g)
        assert mine == list(range(1, 251))
    again = {(r["id"], r["rank"]) for r in hash_rank(df.coalesce(1), ["g"], "h", "id").collect()}
    assert again == {(r["id"], r["rank"]) for r in got}


def test_negative_zero_is_not_non_negative(spark):
    rows = frame(spark, [("-0.0",), ("-0",), ("0",), ("-1",), ("2",)], "t string").select(
        scalars.finite_number("t").alias("x"), scalars.finite_number("t", non_negative=True).alias("n")).collect()
    assert [r["n"] for r in rows] == [None, None, 0.0, None, 2.0]
    assert [r["x"] for r in rows] == [0.0, 0.0, 0.0, -1.0, 2.0]


def test_multiplicities_of_some_slots():
    from tidemark.operators import splits

    rng, strata = np.random.default_rng(0), ((5, 1 << 18), (4123456789, 300_001))
    whole = splits.multiplicities(strata, 0, 61)
    for size in (1, 7, 400, 60_000):  # few slots are turned back, many are counted
        some = np.sort(rng.choice(whole.shape[1] - 1, size, replace=False))
        assert (splits.slot_multiplicities(strata, some, 60) == whole[:, some]).all()


def test_running_merges_equal_values_in_bounded_tasks(spark):
    rows = [("a", v, w) for v in (0.0, 0.25, 0.25, 0.5, 0.50001, 3.0, None) for w in (1, 2)] + [("b", 0.1, 5)]
    df = frame(spark, rows, "g string, x double, w int")
    out = running(df, ["g"], ["x"], block=value_block("x"), sums={"c": "w"}, maxes={"m": "w"}, totals=True, merge=True, tasks=3)
    got = sorted(((r["g"], r["x"], r["c"], r["m"], r["c_total"]) for r in out.collect()), key=lambda r: (r[0], -1 if r[1] is None else r[1]))
    assert got == [("a", None, 3, 2, 21), ("a", 0.0, 6, 2, 21), ("a", 0.25, 12, 2, 21), ("a", 0.5, 15, 2, 21), ("a", 0.50001, 18, 2, 21), ("a", 3.0, 21, 2, 21), ("b", 0.1, 5, 5, 5)]
    with pytest.raises(ValueError):
        running(df, ["g"], ["x"], block=value_block("x"), sums={"c": "w"}, before=True, merge=True)
