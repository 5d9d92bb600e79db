"""Work that is done once, on narrow rows, and files that go when nobody reads them any more."""

import os
import random
import tempfile

from pyspark.sql import functions as F

from margin_engine import queries as Q
from margin_engine.operators import margin as M
from margin_engine.operators import match as J
from margin_engine.plans import workflow as W
from margin_engine.plans.materialize import Intermediates, dropping_shuffles, materialize
from margin_engine.streaming.ingest import StreamPaths, current_detail, start_ingest

LINES = "`订单号` string, `商品编码` string, `买家实付` {paid}, `数量` {quantity}, `规格` string, `线上订单状态` string, `备注` int, `重量` double"


def _rows(df):
    return sorted(map(str, df.collect()))


def _shuffle_files(spark):
    home = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in home for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_a_write_leaves_no_shuffle_files(spark):
    df = spark.range(5000).select(F.col("id") % 7, F.col("id").cast("string").alias("t")).distinct()
    before = _shuffle_files(spark)
    with Intermediates(spark, "test"):
        with dropping_shuffles(spark):
            assert materialize(df).count() == 5000
        left = _shuffle_files(spark) - before
    assert len(left) <= 1, left  # that of the count
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert df.count() == 5000


def test_the_pair_is_loaded_from_compressed_files_and_read_once(spark, monkeypatch):
    saved, real = [], W.materialize

    def save(df, tag="stage"):
        saved.append((tag, df._jdf.queryExecution().optimizedPlan().toString()))
        return real(df, tag)

    monkeypatch.setattr(W, "materialize", save)
    before = _shuffle_files(spark)
    df = Q.load_pair_csv(spark, "/root/testdata/sf0.001")
    assert len(_shuffle_files(spark) - before) < 60  # none of the joins', the sorts' and the cleaning's
    assert [tag for tag, _ in saved] == ["base", "cleaned"]
    assert " csv" in saved[0][1] and " csv" not in saved[1][1]  # the files are parsed for one exact dedup, not for two
    assert df.count() > 0
    folder = os.path.join(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"), "margin-engine")
    pairs = [os.path.join(folder, d, "orders") for d in os.listdir(folder) if d.startswith("pair-") and os.path.isdir(os.path.join(folder, d, "orders"))]
    assert pairs and all(f.endswith(".csv.gz") for d in pairs for f in os.listdir(d) if f.startswith("part-"))
    assert not [d for d in os.listdir(folder) if d.startswith(("base-", "pair-lines-"))]


def _some_lines(rng, n, number):
    def paid():
        return rng.choice([None, 0.0, 5.0, -2.0, float("nan"), float("inf")]) if number else rng.choice([None, "0", "5.00", " 5.0", "x", "1e999"])

    def quantity():
        return rng.choice([None, 0, 1, 3]) if number else rng.choice([None, "0", "2", "y"])

    return [(f"O{rng.randrange(12)}", rng.choice(["A", " A", "B", "C ", "q", None]), paid(), quantity(), rng.choice([None, "s", "t"]),
             rng.choice([None, "已完成", "已完成", "关闭"]), rng.choice([None, 0, -1, 2]), rng.choice([None, 0.0, float("nan"), -1.5])) for _ in range(n)]


def test_the_first_line_of_a_key_is_the_same_before_and_after_the_join(spark):
    products = spark.createDataFrame([("A", "3", 1), ("A ", "9", 2), ("B", "2.5", 1), (" C", "n/a", 3), (None, "1", 1)], "`商家编码` string, `成本` string, seq int")
    for seed in range(4):
        number = bool(seed % 2)
        schema = LINES.format(paid="double" if number else "string", quantity="int" if number else "string")
        lines = spark.createDataFrame(_some_lines(random.Random(seed), 150, number), schema)
        with W.run_keyword(lines, products, product_order_by=["seq"], stamp=None) as run:
            assert run.match.status == "matched" and W._lines_decide(run.match, run.dedup_keys)
            roles = M.MarginRoles(cost="成本", quantity="数量", revenue="买家实付")
            after = W.business_dedup(M.margin_keyword(J.without_post_join_dedup(run.match), roles, None), run.dedup_keys)
            assert _rows(run.processed) == _rows(after)
            plan = run.processed._jdf.queryExecution().optimizedPlan().toString()
            assert plan.index("Join") < plan.index("Window")  # the join stands above the dedup


def test_keys_of_the_catalogue_and_computed_headings_are_left_to_the_join(spark):
    products = spark.createDataFrame([("A", "S1", "3"), ("B", "S1", "4")], "`商家编码` string, `成本SKU` string, `成本` string")
    lines = spark.createDataFrame([("O1", "A", "5", "u"), ("O1", "B", "6", "v"), ("O2", "A", "7", "w")], "`订单号` string, `商家编码` string, `买家实付` string, revenue string")
    with W.run_keyword(lines, products, stamp=None, roles={"dedup": {"keys": ["订单号", "成本SKU"]}}) as run:
        assert not W._lines_decide(run.match, run.dedup_keys)
        assert sorted((r["订单号"], r["买家实付"]) for r in run.processed.collect()) == [("O1", 5.0), ("O2", 7.0)]


def _paths():
    base = tempfile.mkdtemp(prefix="me-stream-")
    return StreamPaths(f"{base}/landing", f"{base}/sink", f"{base}/ckpt")


def test_a_batch_touches_the_orders_whose_lines_pass_the_row_tests(spark):
    schema = "`订单号` string, `商品编码` string, `买家实付` string, `线上订单状态` string"
    products = spark.createDataFrame([("A", "3")], "`商家编码` string, `成本` string")
    paths, seen = _paths(), []
    batches = [[("O0", "A", "5", "关闭")],  # nothing passes: no order, no pair, no detail yet
               [("O1", "A", "5", "ok"), ("O2", "A", "6", "ok"), ("O3", "A", "1", "关闭")],
               [("O1", "A", "8", "关闭"), ("O2", "A", "-9", "ok"), ("O3", "A", "4", "ok")],
               [("O1", "A", "5", "关闭")], [("O2", "A", "10", "ok"), ("O2", "A", "6", "ok")]]
    for i, rows in enumerate(batches):
        seen += rows
        lines = spark.createDataFrame(rows, schema)
        lines.coalesce(1).write.parquet(f"{paths.landing}/e{i}")
        q = start_ingest(spark, paths, lines.schema, products, available_now=True, buckets=2)
        q.awaitTermination(200)
        assert q.exception() is None
        if i:
            run = W.run_keyword(spark.createDataFrame(seen, schema), products, stamp=None)
            assert _rows(current_detail(spark, paths).select(*run.processed.columns)) == _rows(run.processed)
            run.close()
    touched = spark.read.parquet(paths.touched).select("batch_id", "__order").collect()
    assert sorted(map(tuple, touched)) == [(1, "O1"), (1, "O2"), (2, "O2"), (2, "O3"), (4, "O2")]
    assert spark.read.parquet(paths.lines).count() == sum(map(len, batches))  # every line is stored all the same


def test_key_hits_equal_the_key_search(spark):
    orders = spark.createDataFrame([("O1", "A", "x"), ("O1", "A", "sa"), ("O1", " A", None), ("O2", "B", "sa"), (None, "A", "sb"), ("O3", "zz", "q")], "o string, a string, b string")
    products = spark.createDataFrame([("A", "sa"), ("A", "sb"), ("B", None)], "p string, s string")
    hits = J.key_hits(orders, products, ["p", "s"], ["a", "b"], "o")
    assert {(r.o, r.p_ix, r.o_ix): r.matched_lines for r in hits.collect()} == {
        ("O1", 0, 0): 3, ("O1", 1, 1): 1, ("O2", 0, 0): 1, ("O2", 1, 1): 1, (None, 0, 0): 1, (None, 1, 1): 1}
    whole = J.key_search(orders, products, ["p", "s"], ["a", "b"])
    assert {(r.p_ix, r.o_ix): r.matched_lines for r in whole.collect() if r.matched_lines} == {(0, 0): 5, (1, 1): 3}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[plan.index("Join"):plan.index("Aggregate [p_ix", plan.index("Join"))]  # the lines are not grouped before it


def test_the_exports_come_from_one_run_of_the_joins(spark, monkeypatch):
    sent = []
    real = Q.move_folder
    monkeypatch.setattr(Q, "move_folder", lambda s, a, b: (sent.append(os.path.basename(b)), real(s, a, b)))
    df = Q.stream_ingest(spark, "/root/testdata/sf0.001")
    assert sent == ["export_0", "export_1"]
    want = W.run_keyword(Q._lines(spark, "/root/testdata/sf0.001"), Q._products(spark, "/root/testdata/sf0.001"), product_order_by=["seq"], stamp=None)
    assert _rows(df.select(*want.processed.columns)) == _rows(want.processed)
