"""Exports that appear whole, and runs that clean up."""

import datetime
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from margin_engine.operators import dedup as D
from margin_engine.operators import reports as R
from margin_engine.operators.clean import CleanOptions, clean_keyword
from margin_engine.plans import export as X
from margin_engine.plans.materialize import Intermediates, materialize
from margin_engine.plans.workflow import run_fixed, run_keyword
from margin_engine.session import ensure_checkpoint_dir
from margin_engine.sources import fixtures as FX
from margin_engine.sources.readers import drop_header_rows

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan(df)


@pytest.fixture(scope="module")
def fixed(spark):
    return run_fixed(FX.order_lines(spark, SF), drop_header_rows(FX.catalog(spark, SF)), stamp=None).processed


def test_csv_export_keeps_cells_and_types(spark):
    rows = [("a\nb", '"', None, 1.5, datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 4, 5)), ("", " x ", 7, None, None, None),
            (",", "\\", -1, 0.1, datetime.date(1999, 12, 31), None), (None, "\r\n", 0, 1e300, None, None)]
    df = spark.createDataFrame(rows, "s string, t string, n long, d double, day date, at timestamp")
    for options in ({}, {"header": False, "date_format": "dd/MM/yyyy", "timestamp_format": "yyyy-MM-dd HH:mm:ss"}):
        target = tempfile.mkdtemp(prefix="me-exp-") + "/out"
        assert X.export_run(df, target, "csv", **options).rows == 4
        back = X.read_export(spark, target)
        assert back.schema == df.schema
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_summaries_do_not_depend_on_the_format(spark, fixed):
    odd = fixed.withColumn("店铺名称", F.concat("店铺名称", F.lit('\n10.0,"x"')))
    want = {n: sorted(map(tuple, f(odd).collect())) for n, f in (("shop_summary", R.shop_summary), ("product_summary", R.product_summary))}
    for fmt in ("csv", "parquet", "json"):
        target = tempfile.mkdtemp(prefix="me-exp-") + "/out"
        res = X.export_run(odd, target, fmt, summaries=True)
        assert set(res.paths) == {"detail", "shop_summary", "product_summary"}
        for name, rows in want.items():
            assert sorted(map(tuple, X.read_export(spark, target, name).select(*(R.shop_summary(odd) if name == "shop_summary" else R.product_summary(odd)).columns).collect())) == rows
        assert {r["name"]: r["rows"] for r in X.read_manifest(spark, target).collect()} == {"detail": res.rows, **{n: len(v) for n, v in want.items()}}


def test_an_export_appears_whole_or_not_at_all(spark, fixed, monkeypatch):
    target = tempfile.mkdtemp(prefix="me-exp-") + "/out"
    assert X.export_run(fixed.limit(0), target) == X.ExportResult(False, 0, {})
    assert not os.path.exists(target)
    monkeypatch.setattr(X, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        X.export_run(fixed, target)
    assert not os.path.exists(f"{target}/data") and len(os.listdir(target)) == 1
    with pytest.raises(Exception, match="(?i)exist"):
        X.read_export(spark, target)
    monkeypatch.undo()
    assert X.export_run(fixed, target).written
    assert os.listdir(target) == ["data"]  # the stale staging folder went
    with pytest.raises(FileExistsError):
        X.export_run(fixed, target)
    with pytest.raises(ValueError):
        X.read_export(spark, target, "other")


def test_a_run_deletes_its_folders(spark):
    base = f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/margin-engine"
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    with run_keyword(FX.order_lines(spark, SF), drop_header_rows(FX.catalog(spark, SF)), product_order_by=["seq"], stamp=None) as run:
        saved = run.saved()
        assert set(os.listdir(base)) - before
        want = {r["counter"]: r["value"] for r in run.counters().collect()}
        got = {r["counter"]: r["value"] for r in saved.counters().collect()}
        assert want == got and got["deduplicated_lines"] == D.exact_dedup(run.orders).count() < got["original_lines"]
        assert saved.summary().collect() == run.summary().collect()
        # reports of a saved run read the one table and nothing else
        assert plan(saved.summary()).count("FileScan") == 1
    assert set(os.listdir(base)) == before


def test_nested_runs_keep_their_owner(spark):
    with Intermediates(spark) as outer:
        a = materialize(spark.range(3), "a")
        with Intermediates(spark) as inner:
            materialize(spark.range(4), "b")
            root = inner.root
        assert not os.path.exists(root.removeprefix("file:"))
        assert a.count() == 3 and outer.root in a.inputFiles()[0]


def test_counters_scan_the_raw_lines_once(spark):
    src = tempfile.mkdtemp(prefix="me-raw-") + "/lines"
    FX.order_lines(spark, SF).write.parquet(src)
    with run_keyword(spark.read.parquet(src), drop_header_rows(FX.catalog(spark, SF)), product_order_by=["seq"], stamp=None) as run:
        text = plan(run.saved().counters())
        assert text.count("FileScan") == 3 and text.count(src) == 1 and "Join" not in text


def test_duplicate_report_ships_fingerprints(spark):
    df = spark.createDataFrame([(0.0, "a", None), (-0.0, "a", None), (0.0, "", "a"), (0.0, None, "a"), (float("nan"), "1:", "x"), (float("nan"), "1:", "x")],
                               "d double, s string, t string")
    wide = df.withColumn("w", F.repeat(F.lit("w"), 500))
    rep = D.duplicate_report(wide).first()
    assert (rep["total_rows"], rep["unique_rows"]) == (6, 4) == (wide.count(), wide.distinct().count())
    text = plan(D.duplicate_report(wide))
    for line in text.split("\n"):
        if "Exchange hashpartitioning" in line:
            assert "__md5" in line and "w#" not in line
    nested = spark.createDataFrame([([1, None], (1, None)), ([1], (1, None)), ([1, None], (1, None))], "a array<int>, b struct<x:int,y:int>")
    assert D.duplicate_report(nested).first()["unique_rows"] == 2


def test_long_shop_list_shares_one_scan_and_exchange(spark):
    src = tempfile.mkdtemp(prefix="me-shops-") + "/lines"
    FX.order_lines(spark, SF).write.parquet(src)
    lines = spark.read.parquet(src)
    names = [r[0] for r in lines.select("店铺名称").distinct().limit(4).collect()]
    want = clean_keyword(lines).cleaned.filter(F.col("店铺名称").isin(names))
    for shops in (names, names + [f"shop {i}" for i in range(100_000)], spark.createDataFrame([(n,) for n in [*names, None, "none"]], "s string")):
        got = clean_keyword(lines, CleanOptions.of(shops)).cleaned
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to broadcast
    try:
        got = clean_keyword(lines, CleanOptions.of(names)).cleaned
        got.collect()
        text = plan(got).split("== Initial Plan ==")[0]
        assert text.count("FileScan") == 1 and "ReusedExchange" in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_text_times_order_by_time(spark):
    df = spark.createDataFrame([("2024-9-1",), ("2024-10-01",), (" 2024/9/2 7:05 ",), ("20240903",), ("2024年9月4日",), ("soon",), (None,), ("",)], "t string")
    row = R.date_range(df, "t").first()
    assert (str(row["start"]), str(row["end"]), row["unparsed"]) == ("2024-09-01 00:00:00", "2024-10-01 00:00:00", 2)
    assert R.date_range(df.limit(0), "t").first()["start"] is None
