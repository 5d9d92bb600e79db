"""DuckDB oracle SQL for the named queries (correctness gate).

The stand-in views use the same SQL text as the Spark side
(``sources.fixtures``); everything after them is written independently in
DuckDB SQL.  Expressions that must agree bit for bit:

* coercion: the same number regex, then ``TRY_CAST(trim(x) AS DOUBLE)``;
* rounding: ``round_even(x * 10^d, 0) / 10^d`` (= ``rint`` on the Spark side);
* money sums: ``SUM(CAST(x AS DECIMAL(28,6)))`` cast back to DOUBLE;
* means: exact decimal sum / count, both as DOUBLE;
* "first" rows: row_number over the same ordering, ``ASC NULLS FIRST``.
"""

from __future__ import annotations

from .functions.numeric import NUMBER_PATTERN
from .operators.profile import STAT_DIGITS
from .operators.reports import MEAN_DIGITS
from .queries import NAME_TAIL, PAGE_ROWS, PREVIEW_ROWS, SELECTED_SHOPS, SHOP_SEARCH_TERM, STAMP
from .sources.fixtures import (CATALOG_SQL, ORDER_LINE_COLUMNS, ORDER_LINES_SQL, TABLES,
                               duckdb_sql_text)


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def coerce(x: str) -> str:
    return (f"(CASE WHEN regexp_matches(CAST({x} AS VARCHAR), {lit(NUMBER_PATTERN)}) "
            f"THEN TRY_CAST(trim(CAST({x} AS VARCHAR)) AS DOUBLE) END)")


def rnd(x: str, d: int) -> str:
    s = f"{float(10 ** d)!r}"
    return f"(round_even(({x}) * {s}, 0) / {s})"


def strip(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"


def money_sum(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(28,6))) AS DOUBLE)"


def exact_mean(x: str) -> str:
    return f"(CAST(SUM(CAST({x} AS DECIMAL(28,6))) AS DOUBLE) / CAST(COUNT({x}) AS DOUBLE))"


def not_eq(c: str, v: str) -> str:
    return f"({c} IS DISTINCT FROM {lit(v)})"


def not_contains(c: str, v: str) -> str:
    return f"(NOT COALESCE(contains({c}, {lit(v)}), false))"


OID, SHOP, CODE, NAME, PAID, QTY = (q("订单号"), q("店铺名称"), q("商品编码"), q("商品名称"),
                                    q("买家实付"), q("数量"))
ONLINE, DETAIL, MARK, SPEC, TIME = (q("线上订单状态"), q("明细状态"), q("订单标记"), q("规格"),
                                    q("下单时间"))
PKEY, ITEM, SKU, COST = q("商家编码"), q("商品"), q("SKU"), q("成本")

LINE_COLS = [q(c) for c in ORDER_LINE_COLUMNS]
PRODUCT_COLS = [PKEY, ITEM, SKU, COST, "seq"]

LINES = f"lines AS ({duckdb_sql_text(ORDER_LINES_SQL)})"
PRODUCTS = (f"catalog_raw AS ({duckdb_sql_text(CATALOG_SQL)}),\n"
            f"products AS (SELECT * FROM catalog_raw WHERE {PKEY} IS DISTINCT FROM '商家编码')")


def _cols(cols, replace: dict[str, str] | None = None, prefix: str = "") -> str:
    replace = replace or {}
    return ", ".join(f"{replace[c]} AS {c}" if c in replace else f"{prefix}{c}" for c in cols)


def keyword_preds(include_closed=False, include_offline=False) -> str:
    preds = [not_contains(MARK, "空单")]
    for s in (ONLINE, DETAIL):
        if not include_closed:
            preds.append(not_eq(s, "关闭"))
        preds.append(not_contains(s, "退款"))
        if not include_offline:
            preds.append(not_eq(s, "[线下订单]"))
    return " AND ".join(preds)


def clean_ctes(include_closed=False, include_offline=False, shops=None,
               with_order_id=True) -> str:
    """lines -> d1 -> typed -> base -> cleaned (the keyword cleaning)."""
    cols = LINE_COLS if with_order_id else [c for c in LINE_COLS if c != OID]
    typed_cols = _cols(cols, {PAID: f"COALESCE({coerce(PAID)}, 0.0)"})
    parts = [LINES,
             f"d1 AS (SELECT DISTINCT {', '.join(cols)} FROM lines)",
             f"typed AS (SELECT {typed_cols} FROM d1)",
             f"base AS (SELECT * FROM typed WHERE {keyword_preds(include_closed, include_offline)})"]
    if with_order_id:
        parts.append(f"qual AS (SELECT {OID} FROM base WHERE {OID} IS NOT NULL GROUP BY {OID} "
                     f"HAVING SUM(CAST({PAID} AS DECIMAL(28,6))) > 0)")
        cond = f"{OID} IN (SELECT {OID} FROM qual)"
    else:
        cond = f"{PAID} > 0"
    if shops:
        cond += f" AND {SHOP} IN ({', '.join(lit(s) for s in shops)})"
    parts.append(f"cleaned AS (SELECT * FROM base WHERE {cond})")
    return ",\n".join(parts)


CAT_FIRST = (
    f"cat_first AS (SELECT {_cols(PRODUCT_COLS)} FROM ("
    f"SELECT {_cols(PRODUCT_COLS, {PKEY: strip(PKEY)})}, row_number() OVER ("
    f"PARTITION BY {strip(PKEY)} ORDER BY seq ASC NULLS FIRST, {ITEM} ASC NULLS FIRST, "
    f"{SKU} ASC NULLS FIRST, {COST} ASC NULLS FIRST) AS rn FROM products) WHERE rn = 1)")

JOINED = (
    f"joined AS (SELECT {_cols(LINE_COLS, {CODE: strip('o.' + CODE)}, 'o.')}, "
    f"{_cols(PRODUCT_COLS, prefix='p.')}, "
    f"CASE WHEN p.{PKEY} IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS match_status "
    f"FROM cleaned o LEFT JOIN cat_first p ON {strip('o.' + CODE)} = p.{PKEY})")

MATCHED = "matched AS (SELECT DISTINCT * FROM joined)"

MARGIN = ",\n".join([
    f"m1 AS (SELECT *, COALESCE({coerce(COST)}, 0.0) AS unit_cost, "
    f"COALESCE({coerce(QTY)}, 1.0) AS quantity, {rnd(f'COALESCE({PAID}, 0.0)', 2)} AS revenue "
    f"FROM matched)",
    f"m2 AS (SELECT *, {rnd('unit_cost * quantity', 2)} AS total_cost FROM m1)",
    f"m3 AS (SELECT *, {rnd('revenue - total_cost', 2)} AS profit FROM m2)",
    f"margined AS (SELECT {_cols(LINE_COLS + PRODUCT_COLS, {'seq': 'COALESCE(seq, 0)'})}, "
    f"match_status, unit_cost, quantity, revenue, total_cost, profit, "
    f"CASE WHEN revenue > 0 THEN {rnd('profit / revenue', 4)} ELSE 0.0 END AS margin FROM m3)",
])

MARGINED_COLS = (LINE_COLS + PRODUCT_COLS +
                 ["match_status", "unit_cost", "quantity", "revenue", "total_cost", "profit",
                  "margin"])
DEDUP_KEYS = [OID, CODE, SPEC]


def _order(cols) -> str:
    return ", ".join(f"{c} ASC NULLS FIRST" for c in cols)


FINAL = (
    f"final AS (SELECT {', '.join(MARGINED_COLS)} FROM (SELECT *, row_number() OVER ("
    f"PARTITION BY {', '.join(DEDUP_KEYS)} ORDER BY "
    f"{_order([c for c in MARGINED_COLS if c not in DEDUP_KEYS])}) AS rn FROM margined) "
    f"WHERE rn = 1)")


def keyword_run_ctes() -> str:
    return ",\n".join([clean_ctes(), PRODUCTS, CAT_FIRST, JOINED, MATCHED, MARGIN, FINAL])


V1_CTES = ",\n".join([
    LINES, PRODUCTS,
    f"v1_clean AS (SELECT * FROM lines WHERE {PAID} IS NOT NULL AND {not_eq(ONLINE, '关闭')} "
    f"AND {not_eq(DETAIL, '关闭')} AND {not_eq(ONLINE, '[线下订单]')} "
    f"AND {not_contains(DETAIL, '退款')})",
    f"v1_match AS (SELECT {_cols(LINE_COLS, {CODE: strip('o.' + CODE)}, 'o.')}, "
    f"p.{PKEY}, p.{ITEM}, p.{SKU}, p.{COST} FROM v1_clean o LEFT JOIN "
    f"(SELECT {strip(PKEY)} AS {PKEY}, {ITEM}, {SKU}, {COST} FROM products) p "
    f"ON {strip('o.' + CODE)} = p.{PKEY})",
    f"v1_typed AS (SELECT {_cols(LINE_COLS, {PAID: coerce(PAID)})}, {PKEY}, {ITEM}, {SKU}, "
    f"{coerce(COST)} AS {COST} FROM v1_match)",
    f"v1_proc AS (SELECT *, {PAID} - {COST} AS profit, "
    f"CASE WHEN {PAID} > 0 THEN ({PAID} - {COST}) / {PAID} ELSE 0.0 END AS margin FROM v1_typed)",
])


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def _rollup_select(group: str | None) -> str:
    key = f"CAST({group} AS VARCHAR) AS shop_name, " if group else ""
    return (f"SELECT {key}COUNT(*) AS n, COALESCE({money_sum('total_cost')}, 0.0) AS tc, "
            f"COALESCE({money_sum('revenue')}, 0.0) AS tr, "
            f"{exact_mean('CASE WHEN revenue > 0 THEN margin END')} AS m FROM final")


def _unpivot(cols, src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {lit(c)} AS \"column\", CAST({q(c)} AS VARCHAR) AS value FROM {src}" for c in cols)


DOCUMENT_SCHEMA = (("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                   ("source", "string"), ("n_chars", "bigint"))
LINEITEM_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax")


def _numeric_summary_sql() -> str:
    parts = []
    for c in LINEITEM_NUMERIC:
        v = f"(CASE WHEN CAST({c} AS DOUBLE) = 0.0 THEN 0.0 ELSE CAST({c} AS DOUBLE) END)"
        parts.append(
            f"SELECT {lit(c)} AS \"column\", COUNT({v}) AS count, {rnd(f'AVG({v})', STAT_DIGITS)} AS mean, "
            f"{rnd(f'STDDEV_SAMP({v})', STAT_DIGITS)} AS std, MIN({v}) AS min, "
            f"{rnd(f'QUANTILE_CONT({v}, 0.25)', STAT_DIGITS)} AS p25, "
            f"{rnd(f'QUANTILE_CONT({v}, 0.5)', STAT_DIGITS)} AS p50, "
            f"{rnd(f'QUANTILE_CONT({v}, 0.75)', STAT_DIGITS)} AS p75, MAX({v}) AS max "
            f"FROM lineitem")
    return " UNION ALL ".join(parts)


def _table_profile_sql() -> str:
    n = len(DOCUMENT_SCHEMA)
    return " UNION ALL ".join(
        f"SELECT {i} AS position, {lit(c)} AS \"column\", {lit(t)} AS dtype, "
        f"CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count, "
        f"CAST(COUNT(*) AS BIGINT) AS total_rows, {n} AS total_columns FROM documents"
        for i, (c, t) in enumerate(DOCUMENT_SCHEMA))


def _column_profile_sql(source: str = "lines") -> str:
    if source == "lines":
        columns, ctes = ORDER_LINE_COLUMNS, LINES
        types = {c: "string" for c in columns}
        types["下单时间"] = "date"
        # C1b roles of the export's headers (sku / amount / status / shop).
        roles = {"店铺名称": "shop", "买家实付": "amount", "线上订单状态": "status",
                 "明细状态": "status"}
    else:
        columns, ctes = ("商家编码", "商品", "SKU", "成本", "seq"), PRODUCTS
        types = {"商家编码": "string", "商品": "string", "SKU": "string", "成本": "string",
                 "seq": "int"}
        roles = {"SKU": "sku"}          # C1a: potential SKU columns of the catalogue
    meta = " UNION ALL ".join(
        f"SELECT {i} AS position, {lit(c)} AS \"column\", {lit(types[c])} AS dtype, "
        + (f"{lit(roles[c])}" if c in roles else "CAST(NULL AS VARCHAR)") + " AS role"
        for i, c in enumerate(columns))
    return with_(
        ctes + f",\nu AS ({_unpivot(columns, source)}),\n"
        "g AS (SELECT \"column\", value, COUNT(*) AS n FROM u GROUP BY \"column\", value),\n"
        "pc AS (SELECT \"column\", CAST(COALESCE(SUM(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) "
        "AS null_count, COUNT(value) AS unique_count FROM g GROUP BY \"column\"),\n"
        "s AS (SELECT \"column\", to_json(list(value ORDER BY value)) AS sample_values FROM ("
        "SELECT \"column\", value, row_number() OVER (PARTITION BY \"column\" ORDER BY value) AS rn "
        "FROM g WHERE value IS NOT NULL) WHERE rn <= 3 GROUP BY \"column\"),\n"
        f"meta AS ({meta})",
        "SELECT meta.position, meta.\"column\", meta.dtype, meta.role, "
        "COALESCE(pc.null_count, 0) AS null_count, "
        "COALESCE(pc.unique_count, 0) AS unique_count, COALESCE(s.sample_values, '[]') "
        "AS sample_values FROM meta LEFT JOIN pc USING (\"column\") LEFT JOIN s USING (\"column\")")


def build() -> dict[str, str]:
    K = keyword_run_ctes()
    o: dict[str, str] = {}
    o["clean_keyword"] = with_(clean_ctes(), "SELECT * FROM cleaned")
    o["clean_fixed"] = with_(V1_CTES, "SELECT * FROM v1_clean")
    o["order_level_filter"] = with_(
        clean_ctes(),
        f"SELECT {OID}, COUNT(*) AS n_lines, {money_sum(PAID)} AS order_amount, "
        f"({OID} IS NOT NULL AND COALESCE(SUM(CAST({PAID} AS DECIMAL(28,6))) > 0, false)) AS kept "
        f"FROM base GROUP BY {OID}")
    o["row_level_filter"] = with_(clean_ctes(with_order_id=False), "SELECT * FROM cleaned")
    o["shop_filter"] = with_(clean_ctes(shops=SELECTED_SHOPS), "SELECT * FROM cleaned")
    o["include_flags"] = with_(clean_ctes(True, True), "SELECT * FROM cleaned")
    o["header_row_drop"] = with_(PRODUCTS, "SELECT * FROM products")
    o["match_fanout"] = with_(V1_CTES, "SELECT * FROM v1_match")
    o["match_first"] = with_(",\n".join([clean_ctes(), PRODUCTS, CAT_FIRST, JOINED, MATCHED]),
                             "SELECT * FROM matched")
    o["match_key_search"] = with_(
        ",\n".join([clean_ctes(), PRODUCTS,
                    f"ok AS (SELECT 0 AS o_ix, {strip(CODE)} AS key, COUNT(*) AS n FROM cleaned "
                    f"WHERE {strip(CODE)} IS NOT NULL GROUP BY 1, 2)",
                    f"pk AS (SELECT DISTINCT 0 AS p_ix, {strip(PKEY)} AS key FROM products "
                    f"WHERE {strip(PKEY)} IS NOT NULL UNION SELECT DISTINCT 1, {strip(SKU)} "
                    f"FROM products WHERE {strip(SKU)} IS NOT NULL)",
                    "hits AS (SELECT p_ix, o_ix, SUM(n) AS m FROM ok JOIN pk USING (key) "
                    "GROUP BY 1, 2)",
                    "grid AS (SELECT * FROM (VALUES (0, '商家编码', 0, '商品编码'), "
                    "(1, 'SKU', 0, '商品编码')) t(p_ix, product_column, o_ix, order_column))"]),
        "SELECT grid.p_ix, grid.product_column, grid.o_ix, grid.order_column, "
        "CAST(COALESCE(hits.m, 0) AS BIGINT) AS matched_lines, "
        "CAST(COALESCE(nk.k, 0) AS BIGINT) AS product_keys "
        "FROM grid LEFT JOIN hits USING (p_ix, o_ix) "
        "LEFT JOIN (SELECT p_ix, COUNT(*) AS k FROM pk GROUP BY p_ix) nk USING (p_ix)")
    o["unmatched_lines"] = with_(
        ",\n".join([clean_ctes(), PRODUCTS]),
        f"SELECT {_cols(LINE_COLS, {CODE: strip(CODE)})} FROM cleaned WHERE {strip(CODE)} "
        f"IS NULL OR {strip(CODE)} NOT IN (SELECT {strip(PKEY)} FROM products "
        f"WHERE {strip(PKEY)} IS NOT NULL)")
    o["match_fallback"] = with_(clean_ctes(), "SELECT *, '匹配失败' AS match_status FROM cleaned")
    o["exact_dedup"] = with_(LINES, "SELECT DISTINCT * FROM lines")
    o["post_join_dedup"] = with_(
        ",\n".join([clean_ctes(), PRODUCTS, CAT_FIRST, JOINED]),
        "SELECT CAST(COUNT(*) AS BIGINT) AS rows_before, "
        "CAST((SELECT COUNT(*) FROM (SELECT DISTINCT * FROM joined)) AS BIGINT) AS rows_after "
        "FROM joined")
    o["business_dedup"] = with_(K, "SELECT * FROM final")
    o["dup_report"] = with_(
        LINES,
        "SELECT 'order_lines' AS description, total_rows, unique_rows, "
        "total_rows - unique_rows AS duplicate_rows, CASE WHEN total_rows > 0 THEN "
        + rnd("CAST(total_rows - unique_rows AS DOUBLE) / CAST(total_rows AS DOUBLE) * 100.0", 2)
        + " ELSE 0.0 END AS duplicate_rate FROM (SELECT CAST(COUNT(*) AS BIGINT) AS total_rows, "
        "CAST((SELECT COUNT(*) FROM (SELECT DISTINCT * FROM lines)) AS BIGINT) AS unique_rows "
        "FROM lines)")
    o["dup_fields"] = with_(
        LINES,
        " UNION ALL ".join(
            f"SELECT {lit(f)} AS field, total, uniq AS unique, total - uniq AS duplicates, "
            f"CASE WHEN total > 0 THEN "
            + rnd("CAST(total - uniq AS DOUBLE) / CAST(total AS DOUBLE) * 100.0", 2)
            + f" ELSE 0.0 END AS duplicate_rate FROM (SELECT CAST(COUNT(*) AS BIGINT) AS total, "
            f"CAST(COUNT(DISTINCT {q(f)}) AS BIGINT) AS uniq FROM lines)"
            for f in ("订单号", "商品编码")))
    rate = rnd("CAST(t - u AS DOUBLE) / CAST(t AS DOUBLE) * 100.0", 2)
    o["dedup_stats"] = with_(
        K,
        "SELECT stage, t AS total_rows, u AS unique_rows, t - u AS duplicate_rows, "
        f"CASE WHEN t > 0 THEN {rate} ELSE 0.0 END AS duplicate_rate, "
        "'订单号,商品编码,规格' AS key_columns FROM ("
        "SELECT 'before_final_dedup' AS stage, CAST(COUNT(*) AS BIGINT) AS t, "
        "CAST((SELECT COUNT(*) FROM (SELECT DISTINCT * FROM margined)) AS BIGINT) AS u "
        "FROM margined UNION ALL "
        "SELECT 'after_final_dedup', CAST(COUNT(*) AS BIGINT), "
        "CAST((SELECT COUNT(*) FROM (SELECT DISTINCT * FROM final)) AS BIGINT) FROM final)")
    o["margin_lines"] = with_(",\n".join([clean_ctes(), PRODUCTS, CAT_FIRST, JOINED, MATCHED,
                                          MARGIN]), "SELECT * FROM margined")
    o["margin_fixed"] = with_(V1_CTES, "SELECT * FROM v1_proc")
    o["summary"] = with_(
        K, "SELECT n AS total_records, (SELECT COUNT(DISTINCT " + SHOP + ") FROM final) "
        "AS total_shops, tc AS total_cost, tr AS total_revenue, "
        f"{rnd('tr - tc', 2)} AS total_profit, CASE WHEN tr > 0 THEN COALESCE(m, 0.0) "
        f"ELSE 0.0 END AS avg_margin FROM ({_rollup_select(None)})")
    o["shop_rollup"] = with_(
        K, f"SELECT shop_name, n AS total_orders, tc AS total_cost, tr AS total_revenue, "
        f"{rnd('tr - tc', 2)} AS total_profit, CASE WHEN tr > 0 THEN COALESCE(m, 0.0) "
        f"ELSE 0.0 END AS avg_margin FROM ({_rollup_select(SHOP)} WHERE {SHOP} IS NOT NULL "
        f"GROUP BY {SHOP})")
    o["summary_fixed"] = with_(
        V1_CTES,
        f"SELECT COUNT(*) AS total_records, COUNT(DISTINCT {SHOP}) AS total_shops, "
        f"COUNT(DISTINCT {CODE}) AS total_products, "
        f"COALESCE({money_sum(PAID)}, 0.0) AS total_revenue, "
        f"COALESCE({money_sum(COST)}, 0.0) AS total_cost, "
        f"COALESCE({money_sum('profit')}, 0.0) AS total_profit, "
        f"{rnd('AVG(margin)', MEAN_DIGITS)} AS avg_profit_margin FROM v1_proc")
    o["shop_rollup_fixed"] = with_(
        V1_CTES,
        f"SELECT {SHOP} AS shop_name, COUNT(*) AS total_orders, "
        f"COALESCE({money_sum(PAID)}, 0.0) AS total_revenue, "
        f"COALESCE({money_sum(COST)}, 0.0) AS total_cost, "
        f"COALESCE({money_sum('profit')}, 0.0) AS total_profit, "
        f"{rnd('AVG(margin)', MEAN_DIGITS)} AS avg_profit_margin FROM v1_proc "
        f"WHERE {SHOP} IS NOT NULL GROUP BY {SHOP}")
    o["shop_first_products"] = with_(
        V1_CTES,
        "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY shop_name ORDER BY "
        "product_name) AS INTEGER) AS position FROM ("
        f"SELECT {SHOP} AS shop_name, {NAME} AS product_name, "
        f"{rnd(f'COALESCE({money_sum(PAID)}, 0.0)', 2)} AS revenue, "
        f"{rnd('COALESCE(' + money_sum('profit') + ', 0.0)', 2)} AS profit, "
        f"COUNT({OID}) AS order_count FROM v1_proc WHERE {SHOP} IS NOT NULL AND {NAME} IS NOT NULL "
        f"GROUP BY {SHOP}, {NAME})) WHERE position <= 5")
    o["shop_distribution"] = with_(
        V1_CTES,
        f"SELECT {SHOP} AS shop_name, COUNT(*) AS count FROM v1_proc WHERE {SHOP} IS NOT NULL "
        f"GROUP BY {SHOP} ORDER BY count DESC, shop_name ASC LIMIT 10")
    o["status_counts"] = with_(
        LINES + f",\nu AS ({_unpivot(['线上订单状态', '明细状态'], 'lines')})",
        "SELECT g.\"column\", g.value, g.count, t.total_records FROM (SELECT \"column\", value, "
        "COUNT(*) AS count FROM u WHERE value IS NOT NULL GROUP BY \"column\", value) g JOIN "
        "(SELECT \"column\", COUNT(*) AS total_records FROM u GROUP BY \"column\") t USING (\"column\")")
    o["shop_counts"] = with_(
        LINES + f",\nu AS ({_unpivot(['店铺名称'], 'lines')})",
        "SELECT g.\"column\", g.value, g.count, t.total_shops, t.total_orders FROM (SELECT \"column\", "
        "value, COUNT(*) AS count FROM u WHERE value IS NOT NULL GROUP BY \"column\", value) g JOIN "
        "(SELECT \"column\", COUNT(DISTINCT value) AS total_shops, COUNT(*) AS total_orders FROM u "
        "GROUP BY \"column\") t USING (\"column\")")
    o["shop_list"] = with_(LINES, f"SELECT DISTINCT {SHOP} AS shop_name FROM lines "
                                  f"WHERE {SHOP} IS NOT NULL ORDER BY shop_name")
    o["shop_search"] = with_(
        LINES, f"SELECT DISTINCT {SHOP} AS shop_name FROM lines WHERE {SHOP} IS NOT NULL AND "
               f"contains(lower({SHOP}), {lit(SHOP_SEARCH_TERM.lower())})")
    o["run_counters"] = with_(
        K,
        "SELECT 'original_lines' AS counter, CAST(COUNT(*) AS BIGINT) AS value FROM lines "
        "UNION ALL SELECT 'deduplicated_lines', COUNT(*) FROM (SELECT DISTINCT * FROM lines) u "
        "UNION ALL SELECT 'cleaned_lines', COUNT(*) FROM cleaned "
        f"UNION ALL SELECT 'original_orders', COUNT(DISTINCT {OID}) FROM lines "
        f"UNION ALL SELECT 'cleaned_orders_after_clean', COUNT(DISTINCT {OID}) FROM cleaned "
        f"UNION ALL SELECT 'cleaned_orders', COUNT(DISTINCT {OID}) FROM final "
        "UNION ALL SELECT 'matched_lines', COUNT(*) FROM final")
    summary_cols = (
        f"{rnd(f'COALESCE({money_sum(PAID)}, 0.0)', 2)} AS paid_sum, "
        f"{rnd(f'COALESCE({money_sum(COST)}, 0.0)', 2)} AS cost_sum, "
        f"{rnd('COALESCE(' + money_sum('profit') + ', 0.0)', 2)} AS profit_sum, "
        f"{rnd('AVG(margin)', 2)} AS margin_mean, COUNT({OID}) AS order_count")
    o["shop_summary"] = with_(
        V1_CTES, f"SELECT {SHOP} AS shop_name, {summary_cols} FROM v1_proc "
                 f"WHERE {SHOP} IS NOT NULL GROUP BY {SHOP} ORDER BY shop_name")
    o["product_summary"] = with_(
        V1_CTES, f"SELECT {NAME} AS product_name, {CODE} AS product_code, {summary_cols} "
                 f"FROM v1_proc WHERE {NAME} IS NOT NULL AND {CODE} IS NOT NULL "
                 f"GROUP BY {NAME}, {CODE} ORDER BY product_name, product_code")
    o["column_profile"] = _column_profile_sql()
    o["catalog_profile"] = _column_profile_sql("products")
    o["table_profile"] = _table_profile_sql()
    o["numeric_summary"] = _numeric_summary_sql()
    o["date_range"] = with_(V1_CTES, f"SELECT MIN({TIME}) AS start, MAX({TIME}) AS \"end\" "
                                     f"FROM v1_proc")
    o["preview_page"] = with_(K, f"SELECT * FROM final ORDER BY {_order(MARGINED_COLS)} "
                                 f"LIMIT {PAGE_ROWS}")
    o["numeric_coercion"] = with_(
        LINES + f",\nu AS (SELECT '买家实付' AS \"column\", {PAID} AS raw FROM lines UNION ALL "
                f"SELECT '数量', {QTY} FROM lines)",
        f"SELECT \"column\", raw, {coerce('raw')} AS parsed, COUNT(*) AS lines FROM u "
        f"GROUP BY \"column\", raw")
    dec = "CAST({} AS DECIMAL(38,4))"
    o["safe_json"] = with_(
        K, "SELECT to_json({'shop_name': shop_name, 'total_orders': total_orders, "
           f"'total_cost': {dec.format(rnd('total_cost', 4))}, "
           f"'total_revenue': {dec.format(rnd('total_revenue', 4))}, "
           f"'total_profit': {dec.format(rnd('total_profit', 4))}, "
           f"'avg_margin': {dec.format(rnd('avg_margin', 4))}}}) AS json FROM ("
           + o["shop_rollup"].split("\n")[-1] + ")")
    v1_cols = LINE_COLS + [PKEY, ITEM, SKU, COST, "profit", "margin"]
    v1_page = f"(SELECT * FROM v1_proc ORDER BY {_order(v1_cols)} LIMIT 10)"
    # Per priority word the first column that contains it, then two columns that contain none.
    plain = (f"CASE WHEN COALESCE({PAID}, 0) = 0 THEN '' ELSE "
             f"regexp_replace(CAST(CAST({PAID} AS DECIMAL(28,6)) AS VARCHAR), '\\.?0+$', '') END AS {PAID}")
    text_cells = ", ".join(f"COALESCE({c}, '') AS {c}" for c in (SHOP, CODE, PKEY, COST, MARK, OID, NAME))
    o["priority_preview"] = with_(
        K, f"SELECT {text_cells}, {plain} FROM (SELECT * FROM final ORDER BY {_order(MARGINED_COLS)} LIMIT 10)")

    def fixed(x: str, digits: int) -> str:  # exact binary value, exact ties away from zero
        return (f"printf('%.{digits}f', CASE WHEN (abs({x}) * {2 ** (digits + 1)}) % 2 = 1 "
                f"THEN {x} + sign({x}) * {10.0 ** -(digits + 1)!r}::DOUBLE ELSE {x} END)")

    o["fixed_preview"] = with_(
        V1_CTES,
        f"SELECT COALESCE({SHOP}, '') AS {SHOP}, COALESCE({NAME}, '') AS {NAME}, COALESCE({CODE}, '') AS {CODE}, "
        + ", ".join(f"'¥' || {fixed(f'COALESCE({c}, 0.0)::DOUBLE', 2)} AS {n}"
                    for c, n in ((PAID, PAID), (COST, COST), ("profit", '"利润"')))
        + f", {fixed('(COALESCE(margin, 0.0) * 100.0)::DOUBLE', 1)} || '%' AS \"毛利率\" FROM {v1_page}")
    o["safe_json_nulls"] = (
        "SELECT to_json({'k': l_orderkey || '-' || l_linenumber, 't': CASE WHEN l_linenumber > 1 THEN l_linestatus END, "
        "'x': CASE WHEN l_linenumber = 1 THEN 0.0::DOUBLE ELSE l_quantity::DOUBLE END, "
        "'arr': [0.0::DOUBLE, NULL, 1.0::DOUBLE]}) AS json FROM lineitem")
    o["export_roundtrip"] = o["margin_fixed"]
    o["run_counters_fixed"] = with_(
        V1_CTES,
        "SELECT 'original_orders' AS counter, CAST(COUNT(*) AS BIGINT) AS value FROM lines "
        "UNION ALL SELECT 'cleaned_orders', COUNT(*) FROM v1_clean "
        f"UNION ALL SELECT 'matched_orders', COUNT({PKEY}) FROM v1_proc")
    # The files hold the catalogue by seq and the lines by all columns, descending; seq itself is not written.
    products = [PKEY, ITEM, SKU, COST]
    in_file = ", ".join(f"{c} DESC NULLS LAST" for c in (SHOP, NAME, "paid_raw", QTY, ONLINE, DETAIL, MARK, TIME))
    typed = _cols(LINE_COLS, {PAID: f"COALESCE({coerce(PAID)}, 0.0)", TIME: f"CAST({TIME} AS VARCHAR)"})
    o["load_pair_csv"] = with_(
        ",\n".join([
            LINES, PRODUCTS, f"d1 AS (SELECT DISTINCT {', '.join(LINE_COLS)} FROM lines)",
            f"base AS (SELECT {typed}, {PAID} AS paid_raw FROM d1 WHERE {keyword_preds()})",
            f"cleaned AS (SELECT * FROM base WHERE {OID} IN (SELECT {OID} FROM base GROUP BY {OID} "
            f"HAVING SUM(CAST({PAID} AS DECIMAL(28,6))) > 0))",
            f"first_rows AS (SELECT {_cols(products, {PKEY: strip(PKEY)})}, row_number() OVER (PARTITION BY {strip(PKEY)} "
            f"ORDER BY seq DESC) AS rn FROM products)",
            f"one AS (SELECT {_cols(LINE_COLS, {CODE: strip('o.' + CODE)}, 'o.')}, {_cols(products, prefix='p.')}, paid_raw, "
            f"CASE WHEN p.{PKEY} IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS match_status, "
            f"row_number() OVER (PARTITION BY {OID}, {strip('o.' + CODE)}, {SPEC} ORDER BY {in_file}) AS line_no "
            f"FROM cleaned o LEFT JOIN first_rows p ON {strip('o.' + CODE)} = p.{PKEY} AND p.rn = 1)",
            f"m1 AS (SELECT *, COALESCE({coerce(COST)}, 0.0) AS unit_cost, COALESCE({coerce(QTY)}, 1.0) AS quantity, "
            f"{rnd(f'COALESCE({PAID}, 0.0)', 2)} AS revenue FROM one WHERE line_no = 1)",
            f"m2 AS (SELECT *, {rnd('unit_cost * quantity', 2)} AS total_cost FROM m1)",
            f"m3 AS (SELECT *, {rnd('revenue - total_cost', 2)} AS profit FROM m2)"]),
        f"SELECT {', '.join(LINE_COLS + products)}, match_status, unit_cost, quantity, revenue, total_cost, profit, "
        f"CASE WHEN revenue > 0 THEN {rnd('profit / revenue', 4)} ELSE 0.0 END AS margin FROM m3")
    o["shop_filter_list"] = with_(clean_ctes(), f"SELECT * FROM cleaned WHERE {SHOP} IN (SELECT s_name FROM supplier WHERE s_acctbal > 0)")
    o["match_no_candidates"] = with_(clean_ctes(), "SELECT *, '未匹配' AS match_status FROM cleaned")
    o["match_no_catalogue"] = with_(clean_ctes(), "SELECT *, CAST(NULL AS VARCHAR) AS match_status FROM cleaned WHERE false")
    o["match_name_clash"] = with_(
        ",\n".join([clean_ctes(), PRODUCTS, CAT_FIRST, JOINED, MATCHED]),
        f"SELECT * EXCLUDE ({NAME}, {ITEM}), {NAME} AS {q('商品名称_order')}, {ITEM} AS {q('商品名称_product')} FROM matched")
    o["post_join_dedup_spaces"] = with_(
        ",\n".join([clean_ctes(), PRODUCTS, CAT_FIRST, JOINED]),
        "SELECT CAST(2 * COUNT(*) AS BIGINT) AS rows_before, "
        "CAST((SELECT COUNT(*) FROM (SELECT DISTINCT * FROM joined)) AS BIGINT) AS rows_after FROM joined")
    details = ("SELECT {d} AS {h}, field, t AS total, u AS \"unique\", t - u AS duplicates, "
               f"CASE WHEN t > 0 THEN {rate} ELSE 0.0 END AS duplicate_rate")

    def counted(src: str, fields) -> str:
        rows = [f"SELECT CAST(NULL AS VARCHAR) AS field, CAST(COUNT(*) AS BIGINT) AS t, "
                f"CAST((SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {src})) AS BIGINT) AS u FROM {src}"]
        rows += [f"SELECT {lit(f)}, CAST(COUNT(*) AS BIGINT), CAST(COUNT(DISTINCT {q(f)}) AS BIGINT) FROM {src}" for f in fields]
        return " UNION ALL ".join(rows)

    o["dup_details"] = with_(LINES, details.format(d="'order_lines'", h="description") + f" FROM ({counted('lines', ('订单号', '商品编码'))})")
    run_fields = ("订单号", "商品编码", "商家编码", "SKU")
    o["dedup_details"] = with_(K, " UNION ALL ".join(
        details.format(d=lit(stage), h="stage") + f", '订单号,商品编码,规格' AS key_columns FROM ({counted(src, run_fields)})"
        for stage, src in (("before_final_dedup", "margined"), ("after_final_dedup", "final"))))
    o["margin_stamped"] = with_(",\n".join([clean_ctes(), PRODUCTS, CAT_FIRST, JOINED, MATCHED, MARGIN]),
                                f"SELECT *, {lit(STAMP)} AS processed_at FROM margined")
    numbers = ("total_cost", "total_revenue", "total_profit", "avg_margin")
    long = lambda name, item, cols, src: " UNION ALL ".join(
        f"SELECT {lit(name)} AS report, {item.format(c=c)} AS item, CAST({c} AS DOUBLE) AS value FROM ({src})" for c in cols)
    o["run_report"] = (
        f"SELECT * FROM ({long('summary', chr(39) + '{c}' + chr(39), ('total_records', 'total_shops') + numbers, o['summary'])}) "
        f"UNION ALL SELECT 'counters', counter, CAST(value AS DOUBLE) FROM ({o['run_counters']}) "
        f"UNION ALL SELECT * FROM ({long('shops', 'shop_name || ' + chr(39) + '.{c}' + chr(39), ('total_orders',) + numbers, o['shop_rollup'])})")
    o["date_range_text"] = with_(
        LINES, f"SELECT CAST(MIN({TIME}) FILTER (NOT ends_with({CODE}, '0')) AS TIMESTAMP) AS start, "
               f"CAST(MAX({TIME}) FILTER (NOT ends_with({CODE}, '0')) AS TIMESTAMP) AS \"end\", "
               f"COUNT(*) FILTER (ends_with({CODE}, '0')) AS unparsed FROM lines")
    o["page_info"] = with_(K, f"SELECT CAST(COUNT(*) AS BIGINT) AS total_rows, CAST(least(COUNT(*), {PAGE_ROWS}) AS BIGINT) AS page_rows, "
                              f"{lit('[' + ','.join(c if c.startswith(chr(34)) else chr(34) + c + chr(34) for c in MARGINED_COLS) + ']')} AS columns FROM final")
    types = [(PKEY, "string"), (ITEM, "string"), (SKU, "string"), (COST, "string"), (q("seq"), "int")]
    o["preview_info"] = with_(PRODUCTS, " UNION ALL ".join(
        f"SELECT {i} AS position, {lit(c.strip(chr(34)))} AS \"column\", '{t}' AS dtype, CAST(least(COUNT(*), {PREVIEW_ROWS}) AS BIGINT) AS preview_rows, "
        f"{len(types)} AS preview_columns FROM products" for i, (c, t) in enumerate(types)))
    o["table_headers"] = " UNION ALL ".join(
        f"SELECT '{t}' AS name, CAST((SELECT COUNT(*) FROM duckdb_columns() WHERE table_name = '{t}') AS INTEGER) AS column_count, "
        f"(SELECT string_agg(column_name, ',' ORDER BY column_index) FROM duckdb_columns() WHERE table_name = '{t}') AS columns, "
        f"(SELECT COUNT(*) FROM {t}) AS rows" for t in TABLES)
    texts = _cols(LINE_COLS, {TIME: f"CAST({TIME} AS VARCHAR)"})
    o["encoded_orders"] = with_(
        LINES, f"SELECT {texts}, CASE WHEN CAST({OID} AS BIGINT) % 2 <> 0 THEN '第一行' || chr(10) || '\"' || trim({CODE}) || '\" 第二行' END "
               f"AS {q('备注')} FROM lines")
    o["encoded_catalog"] = with_(PRODUCTS, f"SELECT {_cols(PRODUCT_COLS, {'seq': 'CAST(seq AS VARCHAR)'})} FROM products")
    tail = " || ".join(["','", "chr(10)", lit(NAME_TAIL[2:])])
    o["export_detail_csv"] = with_(V1_CTES, f"SELECT * REPLACE ({NAME} || {tail} AS {NAME}) FROM v1_proc")
    o["export_shop_summary"] = o["shop_summary"]
    o["export_product_summary"] = f"SELECT * REPLACE (product_name || {tail} AS product_name) FROM ({o['product_summary']})"
    # The streamed detail must equal the batch detail.
    o["stream_ingest"] = o["business_dedup"]
    return o


ORACLE: dict[str, str] = build()
