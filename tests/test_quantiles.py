"""Exact quantiles in two scans against numpy."""

import numpy as np
from pyspark.sql import functions as F

from margin_engine.operators import quantiles as Q
from margin_engine.operators.quantiles import exact_quantiles
from margin_engine.sources.fixtures import table

PROBS = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)


def _numpy(values, p):
    return float(np.percentile(np.array(values, dtype=float), p * 100, method="linear"))


def test_two_scans_agree_with_numpy(spark, sf001):
    li = table(spark, sf001, "lineitem").select("l_extendedprice", "l_quantity", "l_discount")
    vals = {c: [r[0] for r in li.select(c).collect()] for c in li.columns}
    for accuracy in (10_000, 200, 20):  # sketches from exact to coarse
        got = {(r["column"], r["p"]): r["value"] for r in exact_quantiles(li, li.columns, PROBS, accuracy).collect()}
        for c in li.columns:
            for p in PROBS:
                assert abs(got[(c, p)] - _numpy(vals[c], p)) < 1e-9, (accuracy, c, p)


def test_broken_sketch_bounds_are_widened(spark, sf001, monkeypatch):
    li = table(spark, sf001, "lineitem").select("l_extendedprice")
    vals = [r[0] for r in li.collect()]
    real, calls = Q._sketch, []

    def off(df, columns, probabilities, margin, accuracy, more):
        calls.append(margin)
        row, found = real(df, columns, probabilities, margin, accuracy, more)
        if len(calls) < 3:  # intervals that miss every rank but the smallest
            found = {c: (n, [(min(vals), min(vals))]) for c, (n, _) in found.items()}
        return row, found

    monkeypatch.setattr(Q, "_sketch", off)
    got = {r["p"]: r["value"] for r in exact_quantiles(li, li.columns, PROBS).collect()}
    assert len(calls) == 3
    assert all(abs(got[p] - _numpy(vals, p)) < 1e-9 for p in PROBS)


def test_hot_value_ties(spark, sf001):
    # A third of the rows share one value.
    li = table(spark, sf001, "lineitem")
    col = F.when(F.col("l_linenumber") <= 2, F.lit(5.0)).otherwise(F.col("l_extendedprice"))
    df = li.select(col.alias("v"))
    vals = [r[0] for r in df.collect()]
    got = {r["p"]: r["value"] for r in exact_quantiles(df, ["v"], PROBS, accuracy=50).collect()}
    for p in PROBS:
        assert abs(got[p] - _numpy(vals, p)) < 1e-9, p


def test_infinities_and_signed_zero(spark):
    df = spark.createDataFrame([(float("inf"),), (-0.0,), (0.0,), (float("-inf"),), (1.0,)], "v double")
    got = {r["p"]: r["value"] for r in exact_quantiles(df, ["v"], (0.0, 0.5, 1.0)).collect()}
    assert got == {0.0: float("-inf"), 0.5: 0.0, 1.0: float("inf")}


def test_samples_of_the_approximate_profile_come_from_all_rows(spark):
    from margin_engine.operators.profile import column_profile
    df = spark.range(0, 20000, 1, 8).select(F.when(F.col("id") >= 19900, F.col("id").cast("string")).alias("late"),
                                            F.lit("one").alias("constant"), F.lit(None).cast("string").alias("none"), "id")
    got = {r["column"]: r for r in column_profile(df, approximate=True).collect()}
    assert got["constant"]["sample_values"] == ["one"] and got["none"]["sample_values"] == []
    assert len(got["late"]["sample_values"]) == 3 and all(int(v) >= 19900 for v in got["late"]["sample_values"])
    assert got["late"]["null_count"] == 19900 and max(map(int, got["id"]["sample_values"])) >= 100


def test_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    got = exact_quantiles(df, ["v"], (0.5,)).collect()
    assert got[0]["value"] is None


def test_approximate_profiles(spark, sf001):
    from margin_engine.operators.profile import column_profile, numeric_summary
    li = table(spark, sf001, "lineitem")
    exact = {r["column"]: r for r in numeric_summary(li).collect()}
    approx = {r["column"]: r for r in numeric_summary(li, approximate=True).collect()}
    n = li.count()
    for c, e in exact.items():
        a = approx[c]
        assert a["count"] == e["count"] and a["min"] == e["min"] and a["max"] == e["max"]
        vals = sorted(r[0] for r in li.select(c).collect())
        # approximate quartile lies within n/accuracy ranks of the exact one
        lo = vals[max(0, int(0.5 * (n - 1)) - 2)]
        hi = vals[min(n - 1, int(0.5 * (n - 1)) + 2)]
        assert lo <= a["p50"] <= hi, c
    prof = {r["column"]: r for r in column_profile(li, approximate=True).collect()}
    exact_prof = {r["column"]: r for r in column_profile(li).collect()}
    for c, e in exact_prof.items():
        assert prof[c]["null_count"] == e["null_count"]
        assert abs(prof[c]["unique_count"] - e["unique_count"]) <= 0.1 * e["unique_count"] + 1


def test_nan_is_missing_in_numeric_summary(spark):
    from margin_engine.operators.profile import numeric_summary
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    r = numeric_summary(df).collect()[0]
    assert (r["count"], r["mean"], r["min"], r["p50"], r["max"]) == (2, 2.0, 1.0, 2.0, 3.0)


def test_intervals_come_from_counts_and_hold_few_values(spark):
    # heavy tails, a hot value, infinities and a constant: the intervals are exact, without a sketch
    rng = np.random.default_rng(3)
    tail = np.exp(rng.normal(0, 4, 4000))
    hot = np.where(np.arange(4000) % 3 == 0, 7.0, rng.uniform(-1e6, 1e6, 4000))
    far = np.concatenate([rng.normal(0, 1, 3990), [np.inf] * 5, [-1.7e308] * 5])
    df = spark.createDataFrame([(float(a), float(b), float(c), 2.0) for a, b, c in zip(tail, hot, far)], "tail double, hot double, far double, one double")
    row, found = Q._sketch(df, df.columns, PROBS, Q.MARGIN, 200, ())
    for name, values in (("tail", tail), ("hot", hot), ("far", far), ("one", np.full(4000, 2.0))):
        n, intervals = found[name]
        assert n == 4000 and all(b1 < a2 for (_, b1), (a2, _) in zip(intervals, intervals[1:]))
        for a, b in intervals:
            assert a == b or ((values >= a) & (values <= b)).sum() <= 4 * Q.MARGIN * 4000 / 200
    got = {(r["column"], r["p"]): r["value"] for r in exact_quantiles(df, ["tail", "hot", "one"], PROBS, 200).collect()}
    for name, values in (("tail", tail), ("hot", hot), ("one", np.full(4000, 2.0))):
        for p in PROBS:
            assert np.isclose(got[(name, p)], _numpy(values, p), rtol=1e-12, atol=1e-12), (name, p)
