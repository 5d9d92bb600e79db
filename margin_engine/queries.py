"""Named queries over the test tables: one per operator of the inventory.

Each callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame.  The
order-line export and the catalogue are the stand-in views of
``sources.fixtures``; every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as K
from .functions.jsonsafe import to_json_rows
from .functions.numeric import to_number
from .operators import clean as C
from .operators import dedup as D
from .operators import match as J
from .operators import profile as P
from .operators import preview as PV
from .operators import reports as R
from .plans import export as X
from .plans import workflow as W
from .plans.materialize import Intermediates, dropping_shuffles, materialize, move_folder, shared_folder
from .sources import files as S
from .sources import fixtures as FX
from .sources.csv_files import DIALECT, read_csv
from .sources.readers import drop_header_rows, load_pair

# Parameters of the registered queries (a user's choices, not data subsets).
SELECTED_SHOPS = ("Supplier#000000001", "Supplier#000000003", "Supplier#000000007")
SHOP_SEARCH_TERM = "IER#00000001"
PRODUCT_ORDER = ("seq",)
PAGE_ROWS = 100
PREVIEW_ROWS = 10
STAMP = "2026-01-01 08:00:00"
NAME_TAIL = ',\n"件"'
STREAM_TIMEOUT_S = 1800
STREAM_BUCKETS = 4


def _lines(spark, sf) -> DataFrame:
    return FX.order_lines(spark, sf)


def _products(spark, sf) -> DataFrame:
    return drop_header_rows(FX.catalog(spark, sf))


def _cleaned(spark, sf, opts=None) -> DataFrame:
    return C.clean_keyword(_lines(spark, sf), opts).cleaned


def _cleaned_shared(spark, sf) -> DataFrame:
    """Cleaned lines read by two jobs (key search and join): written once."""
    return materialize(_cleaned(spark, sf), "cleaned")


def _run(spark, sf) -> W.KeywordRun:
    return W.run_keyword(_lines(spark, sf), _products(spark, sf),
                         product_order_by=PRODUCT_ORDER, stamp=None)


def _fixed(spark, sf) -> W.FixedRun:
    return W.run_fixed(_lines(spark, sf), _products(spark, sf), stamp=None)


# --- cleaning -------------------------------------------------------------

def clean_keyword(spark, sf):
    return _cleaned(spark, sf)


def clean_fixed(spark, sf):
    return C.clean_fixed(_lines(spark, sf))


def order_level_filter(spark, sf):
    res = C.clean_keyword(_lines(spark, sf), order_filter=False)
    return C.order_sums(res.base, res.roles.order_id, res.roles.amount)


def row_level_filter(spark, sf):
    return C.clean_keyword(_lines(spark, sf).drop(K.V1_ORDER_ID)).cleaned


def shop_filter(spark, sf):
    return _cleaned(spark, sf, C.CleanOptions.of(SELECTED_SHOPS))


def shop_filter_list(spark, sf):
    """The shop list is a table of any length (here: suppliers with a positive balance)."""
    shops = FX.table(spark, sf, "supplier").filter("s_acctbal > 0").select("s_name")
    return _cleaned(spark, sf, C.CleanOptions.of(shops))


def include_flags(spark, sf):
    return _cleaned(spark, sf, C.CleanOptions.of(None, True, True))


def header_row_drop(spark, sf):
    return _products(spark, sf)


# --- matching -------------------------------------------------------------

def match_fanout(spark, sf):
    return J.match_fanout(C.clean_fixed(_lines(spark, sf)), _products(spark, sf)).df


def match_first(spark, sf):
    return J.match_keyword(_cleaned_shared(spark, sf), _products(spark, sf), PRODUCT_ORDER).df


def match_key_search(spark, sf):
    cleaned, products = _cleaned(spark, sf), _products(spark, sf)
    pc, oc = J.candidates(cleaned, products)
    return J.key_search(cleaned, products, pc, oc)


def unmatched_lines(spark, sf):
    return J.unmatched_lines(_cleaned(spark, sf), _products(spark, sf),
                             K.V1_ORDER_KEY, K.V1_PRODUCT_KEY)


def match_fallback(spark, sf):
    # A catalogue whose only key candidate (SKU) shares no value with the codes.
    products = _products(spark, sf).drop(K.V1_PRODUCT_KEY)
    return J.match_keyword(_cleaned_shared(spark, sf), products, PRODUCT_ORDER).df


def match_no_candidates(spark, sf):
    # A catalogue without a key column.
    return J.match_keyword(_cleaned_shared(spark, sf), _products(spark, sf).select("成本", "seq"), PRODUCT_ORDER).df


def match_no_catalogue(spark, sf):
    return J.match_keyword(_cleaned_shared(spark, sf), None).df


def match_name_clash(spark, sf):
    # A catalogue whose item heading is also a heading of the lines: both get suffixes.
    products = _products(spark, sf).withColumnRenamed("商品", "商品名称")
    return J.match_keyword(_cleaned_shared(spark, sf), products, PRODUCT_ORDER).df


def post_join_dedup_spaces(spark, sf):
    """Every line once more with a blank before its code: the copies are equal after the join only."""
    lines = _lines(spark, sf)
    padded = lines.withColumn(K.V1_ORDER_KEY, F.concat(F.lit(" "), F.col(f"`{K.V1_ORDER_KEY}`")))
    cleaned = materialize(C.clean_keyword(lines.union(padded)).cleaned, "cleaned")
    match = J.match_keyword(cleaned, _products(spark, sf), PRODUCT_ORDER)
    return J.without_post_join_dedup(match).agg(F.count(F.lit(1)).alias("rows_before")).unionByName(
        match.df.agg(F.count(F.lit(1)).alias("rows_after")), allowMissingColumns=True).agg(
        F.max("rows_before").alias("rows_before"), F.max("rows_after").alias("rows_after"))


def post_join_dedup(spark, sf):
    joined = J.match_keyword(_cleaned_shared(spark, sf), _products(spark, sf), PRODUCT_ORDER,
                             dedup_after=False).df
    rep = D.duplicate_report(joined)
    return rep.select(F.col("total_rows").alias("rows_before"),
                      F.col("unique_rows").alias("rows_after"))


# --- dedup ----------------------------------------------------------------

def exact_dedup(spark, sf):
    return D.exact_dedup(_lines(spark, sf))


def business_dedup(spark, sf):
    return _run(spark, sf).processed


def dup_report(spark, sf):
    return D.duplicate_report(_lines(spark, sf), "order_lines")


def dup_fields(spark, sf):
    lines = _lines(spark, sf)
    return D.field_duplicates(lines, W.dup_key_fields(lines))


def dup_details(spark, sf):
    lines = _lines(spark, sf)
    return D.duplicate_details(lines, W.dup_key_fields(lines), "order_lines")


def dedup_details(spark, sf):
    return _run(spark, sf).saved().dedup_details()


def dedup_stats(spark, sf):
    return _run(spark, sf).dedup_stats()


# --- margin and reports ---------------------------------------------------

def margin_lines(spark, sf):
    return _run(spark, sf).margined


def margin_stamped(spark, sf):
    return W.run_keyword(_lines(spark, sf), _products(spark, sf), product_order_by=PRODUCT_ORDER, stamp=STAMP).margined


def margin_fixed(spark, sf):
    return _fixed(spark, sf).processed


def summary(spark, sf):
    return _run(spark, sf).summary()


def run_report(spark, sf):
    """Summary, counters and shop rollup of one run from its one saved detail."""
    return _run(spark, sf).saved().report()


def summary_fixed(spark, sf):
    return R.summary_fixed(_fixed(spark, sf).processed)


def shop_rollup(spark, sf):
    return _run(spark, sf).shop_rollup()


def shop_rollup_fixed(spark, sf):
    return R.shop_rollup_fixed(_fixed(spark, sf).processed)


def shop_first_products(spark, sf):
    return R.shop_first_products(_fixed(spark, sf).processed)


def shop_distribution(spark, sf):
    return R.shop_distribution(_fixed(spark, sf).processed)


def status_counts(spark, sf):
    return P.status_counts(_lines(spark, sf))


def shop_counts(spark, sf):
    return P.shop_counts(_lines(spark, sf))


def shop_list(spark, sf):
    return R.shop_list(_lines(spark, sf))


def shop_search(spark, sf):
    return R.shop_search(R.shop_list(_lines(spark, sf)), SHOP_SEARCH_TERM)


def run_counters(spark, sf):
    return _run(spark, sf).counters()


def run_counters_fixed(spark, sf):
    return _fixed(spark, sf).counters()


def shop_summary(spark, sf):
    return R.shop_summary(_fixed(spark, sf).processed)


def product_summary(spark, sf):
    return R.product_summary(_fixed(spark, sf).processed)


def date_range(spark, sf):
    return R.date_range(_fixed(spark, sf).processed, "下单时间")


def date_range_text(spark, sf):
    """The same times as text in several forms, and cells that hold none."""
    time = F.col("`下单时间`")
    text = (F.when(F.col("`商品编码`").endswith("0"), F.lit("待定")).when(F.dayofmonth(time) % 2 == 0, F.date_format(time, "yyyy-M-d"))
            .otherwise(F.date_format(time, "yyyy/M/d 0:0:0")))
    return R.date_range(_lines(spark, sf).withColumn("下单时间", text), "下单时间")


# --- profiles -------------------------------------------------------------

def column_profile(spark, sf):
    prof = P.column_profile(_lines(spark, sf))
    return prof.withColumn("sample_values", F.to_json("sample_values"))


def catalog_profile(spark, sf):
    prof = P.column_profile(_products(spark, sf), kind="product")
    return prof.withColumn("sample_values", F.to_json("sample_values"))


def table_profile(spark, sf):
    return P.table_profile(FX.table(spark, sf, "documents"))


def numeric_summary(spark, sf):
    return P.numeric_summary(FX.table(spark, sf, "lineitem"))


# --- pages, functions, sinks ----------------------------------------------

def preview_page(spark, sf):
    processed = _run(spark, sf).processed
    return processed.orderBy(*D.row_order(processed)).limit(PAGE_ROWS)


def page_info(spark, sf):
    return PV.page_info(_run(spark, sf).processed, PAGE_ROWS)


def preview_info(spark, sf):
    return S.preview_info(_products(spark, sf), PREVIEW_ROWS)


def table_headers(spark, sf):
    return S.table_headers({name: FX.table(spark, sf, name) for name in FX.TABLES}).drop("files")


def priority_preview(spark, sf):
    return PV.priority_preview(_run(spark, sf).processed, PREVIEW_ROWS)


def fixed_preview(spark, sf):
    return PV.fixed_preview(_fixed(spark, sf).processed, PREVIEW_ROWS)


def numeric_coercion(spark, sf):
    lines = _lines(spark, sf)
    raw = lines.select(F.explode(F.array(
        F.struct(F.lit(K.V1_PAID).alias("column"), F.col(f"`{K.V1_PAID}`").alias("raw")),
        F.struct(F.lit("数量").alias("column"), F.col("`数量`").alias("raw")))).alias("u")
    ).select("u.*")
    return (raw.groupBy("column", "raw").agg(F.count(F.lit(1)).alias("lines"))
            .select("column", "raw", to_number(F.col("raw")).alias("parsed"), "lines"))


def safe_json(spark, sf):
    return to_json_rows(_run(spark, sf).shop_rollup(), scale=4)


def safe_json_nulls(spark, sf):
    """Null keys, a non-finite number and a nested array over every line item."""
    rows = FX.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linestatus")).alias("t"),
        F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_quantity").cast("double")).alias("x"),
        F.array(F.lit(float("nan")), F.lit(None).cast("double"), F.lit(1.0)).alias("arr"))
    return to_json_rows(rows)


def load_pair_csv(spark, sf):
    """Both tables written as CSV files (gzip, largest rows first), loaded as a pair and run: "first"
    rows are the files' first."""
    base = shared_folder(spark, "pair")

    def save(df, order, name):
        (df.orderBy(*[F.col(f"`{c}`").desc_nulls_last() for c in order]).drop("seq").write.option("header", True)
         .option("compression", "gzip").option("ignoreLeadingWhiteSpace", False).csv(f"{base}/{name}"))

    # The lines are saved between their joins and their sort, which reads its input twice: the files of the
    # joins' shuffles have gone when those of the sort's come.
    with Intermediates(spark, "pair-lines"), dropping_shuffles(spark):
        save(FX.catalog(spark, sf), ("seq", K.V1_PRODUCT_KEY), "products")
        save(materialize(_lines(spark, sf), "lines"), FX.ORDER_LINE_COLUMNS, "orders")
    pair = load_pair(spark, f"{base}/products", f"{base}/orders", "csv", "csv")
    return W.run_pair(pair, stamp=None).processed


def file_catalogue(spark, sf):
    return S.file_catalogue(spark, sf)


def encoded_orders(spark, sf):
    """The order lines in GB18030 files: half with the columns turned round and a further column whose cells hold
    line breaks and quotes; read in splits and united by name."""
    base, lines = shared_folder(spark, "encoded"), _lines(spark, sf).withColumn("下单时间", F.col("`下单时间`").cast("string"))
    note = F.concat(F.lit('第一行\n"'), F.trim("`商品编码`"), F.lit('" 第二行'))
    even = F.pmod(F.col("`订单号`").cast("bigint"), F.lit(2)) == 0
    options = {**DIALECT, "header": True, "encoding": "GB18030", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    held = spark.conf.get("spark.sql.legacy.javaCharsets", "false")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Spark's writer knows the standard charsets only
    try:
        lines.filter(even).write.options(**options).csv(f"{base}/a")
        lines.filter(~even).select(*[F.col(f"`{c}`") for c in reversed(lines.columns)], note.alias("备注")).write.options(**options).csv(f"{base}/b")
    finally:
        spark.conf.set("spark.sql.legacy.javaCharsets", held)
    return read_csv(spark, [f"{base}/a", f"{base}/b"], encoding="GB18030")


def encoded_catalog(spark, sf):
    """The catalogue as UTF-16 files, with the header row inside the data dropped."""
    base = shared_folder(spark, "encoded")
    (FX.catalog(spark, sf).write.options(**DIALECT, header=True, encoding="UTF-16").csv(base))
    return drop_header_rows(read_csv(spark, base, encoding="UTF-16"))


def export_roundtrip(spark, sf):
    """Publish detail + shop / product summaries under the shared checkpoint
    folder, read the detail back."""
    base = shared_folder(spark, "export")
    X.export_run(_fixed(spark, sf).processed, base, summaries=True)
    return X.read_export(spark, base)


def _csv_export(spark, sf) -> str:
    base, processed = shared_folder(spark, "export"), _fixed(spark, sf).processed
    # names with a line break, quotes and a comma
    processed = processed.withColumn(K.V1_PRODUCT_NAME, F.concat(F.col(f"`{K.V1_PRODUCT_NAME}`"), F.lit(NAME_TAIL)))
    X.export_run(processed, base, "csv", summaries=True)
    return base


def export_detail_csv(spark, sf):
    return X.read_export(spark, _csv_export(spark, sf))


def export_shop_summary(spark, sf):
    return X.read_export(spark, _csv_export(spark, sf), "shop_summary")


def export_product_summary(spark, sf):
    return X.read_export(spark, _csv_export(spark, sf), "product_summary")


def stream_ingest(spark, sf):
    """The order lines arrive as two exports, which orders span, and the first arrives twice,
    in a landing folder under the shared checkpoint folder; the streaming ingest processes
    each arrival; the result is the current detail."""
    from .streaming.ingest import StreamPaths, current_detail, start_ingest
    base = shared_folder(spark, "stream")
    paths = StreamPaths(f"{base}/landing", f"{base}/sink", f"{base}/checkpoint")
    lines, products = _lines(spark, sf), _products(spark, sf)
    part = F.pmod(F.xxhash64(F.col("`订单号`"), F.col("`商品编码`")), F.lit(2))
    with dropping_shuffles(spark):
        lines.withColumn("__export", part).write.partitionBy("__export").parquet(f"{base}/exports")
    for n, i in enumerate((0, 1, 0)):
        # both exports come from one run of the joins; the repeated arrival is the first export's file once more
        if n < 2:
            move_folder(spark, f"{base}/exports/__export={i}", f"{paths.landing}/export_{n}")
        else:
            spark.read.schema(lines.schema).parquet(f"{paths.landing}/export_{i}").write.parquet(f"{paths.landing}/export_{n}")
        q = start_ingest(spark, paths, lines.schema, products,
                         product_order_by=list(PRODUCT_ORDER), available_now=True, buckets=STREAM_BUCKETS)
        if not q.awaitTermination(STREAM_TIMEOUT_S):
            q.stop()
            raise TimeoutError(f"stream ingest did not drain within {STREAM_TIMEOUT_S}s")
        if q.exception() is not None:
            raise RuntimeError(f"stream ingest failed: {q.exception()}")
    return current_detail(spark, paths)


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_keyword": clean_keyword,
    "clean_fixed": clean_fixed,
    "order_level_filter": order_level_filter,
    "row_level_filter": row_level_filter,
    "shop_filter": shop_filter,
    "include_flags": include_flags,
    "header_row_drop": header_row_drop,
    "match_fanout": match_fanout,
    "match_first": match_first,
    "match_key_search": match_key_search,
    "unmatched_lines": unmatched_lines,
    "match_fallback": match_fallback,
    "exact_dedup": exact_dedup,
    "post_join_dedup": post_join_dedup,
    "business_dedup": business_dedup,
    "dup_report": dup_report,
    "dup_fields": dup_fields,
    "dedup_stats": dedup_stats,
    "margin_lines": margin_lines,
    "margin_fixed": margin_fixed,
    "summary": summary,
    "summary_fixed": summary_fixed,
    "shop_rollup": shop_rollup,
    "shop_rollup_fixed": shop_rollup_fixed,
    "shop_first_products": shop_first_products,
    "shop_distribution": shop_distribution,
    "status_counts": status_counts,
    "shop_counts": shop_counts,
    "shop_list": shop_list,
    "shop_search": shop_search,
    "run_counters": run_counters,
    "run_counters_fixed": run_counters_fixed,
    "shop_summary": shop_summary,
    "product_summary": product_summary,
    "column_profile": column_profile,
    "catalog_profile": catalog_profile,
    "table_profile": table_profile,
    "numeric_summary": numeric_summary,
    "date_range": date_range,
    "preview_page": preview_page,
    "priority_preview": priority_preview,
    "fixed_preview": fixed_preview,
    "numeric_coercion": numeric_coercion,
    "safe_json": safe_json,
    "safe_json_nulls": safe_json_nulls,
    "load_pair_csv": load_pair_csv,
    "file_catalogue": file_catalogue,
    "export_roundtrip": export_roundtrip,
    "stream_ingest": stream_ingest,
    "shop_filter_list": shop_filter_list,
    "match_no_candidates": match_no_candidates,
    "match_no_catalogue": match_no_catalogue,
    "match_name_clash": match_name_clash,
    "post_join_dedup_spaces": post_join_dedup_spaces,
    "dup_details": dup_details,
    "dedup_details": dedup_details,
    "margin_stamped": margin_stamped,
    "run_report": run_report,
    "date_range_text": date_range_text,
    "page_info": page_info,
    "preview_info": preview_info,
    "table_headers": table_headers,
    "encoded_orders": encoded_orders,
    "encoded_catalog": encoded_catalog,
    "export_detail_csv": export_detail_csv,
    "export_shop_summary": export_shop_summary,
    "export_product_summary": export_product_summary,
}
