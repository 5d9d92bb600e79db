"""Composite runs: the keyword-schema run (clean -> match -> margin -> business
dedup -> reports) and the fixed-schema run.

Physical shape of the keyword run (asserted in ``tests/test_plans.py``)::

    job 1  scan -> row filters -> partial agg (exact dedup) -> Exchange(all columns)
           -> [lines]  Exchange(order id) ------------------------\
           -> [sums]   partial sum -> Exchange(struct(order id)) -> Exchange(order id)
           -> SortMergeJoin left_semi (AQE splits a hot order) -> write Parquet
    job 2  read cleaned (key columns only) -> key-pair counts -> best pair (1 row)
    job 3  catalogue -> first row per key -> count <= bound ? broadcast : shuffle join
    job 4  read cleaned -> BroadcastHashJoin(catalogue) -> margin (codegen)
           -> partial WindowGroupLimit -> Exchange(struct(business key)) -> first row

The business dedup partitions by the key *tuple*, so it gets its own exchange
with the partial group limit under it (a hot business key sends one row per
map task); the post-join exact dedup is skipped on that path because the
business dedup subsumes it.  Where the key's columns are all the lines' own it runs before the
join of job 4: the lines are shuffled without catalogue and computed columns, and only first rows are joined.

With a place in a file per line (``line_order_by``), job 1 saves the lines after the exact dedup, as the sums of the order
test do not need the place and would read and dedup the files once more.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.roles import MarginRoles, OrderRoles, find_columns
from ..operators import clean as C
from ..operators import dedup as D
from ..operators import margin as M
from ..operators import match as J
from ..operators import reports as R
from ..operators.joins import DEFAULT_MAX_BROADCAST_ROWS
from ..sources.readers import LoadedPair
from .materialize import Intermediates, dropping_shuffles, materialize


def business_dedup(df: DataFrame, keys: Sequence[str],
                   order_by: Sequence[str] | None = None) -> DataFrame:
    """First row per business key (order id, SKU, spec), nulls grouped."""
    return D.first_per_key(df, keys, order_by)


@dataclass
class KeywordRun:
    """A run and its reports.  The run owns the folders of its intermediates: ``with run_keyword(...) as
    run:`` (or ``close``) deletes them, after which its lazy results are void."""

    orders: DataFrame                 # raw input
    cleaned: DataFrame                # Q1 output
    clean_roles: OrderRoles
    match: J.MatchResult
    margined: DataFrame               # Q3 output (before business dedup)
    processed: DataFrame              # final detail
    dedup_keys: tuple[str, ...]
    folders: Intermediates
    ordering: tuple[str, ...] = ()    # columns of ``raw`` that are no part of a row's identity
    raw: DataFrame | None = field(default=None, repr=False)

    def __enter__(self) -> "KeywordRun":
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        self.folders.close()

    def saved(self) -> "KeywordRun":
        """The same run with its final detail written once: every report after this reads that table."""
        with self.folders.using():
            return replace(self, processed=materialize(self.processed, "processed"))

    def summary(self) -> DataFrame:
        return R.summary_keyword(self.processed, self._shop())

    def shop_rollup(self) -> DataFrame:
        return R.shop_rollup_keyword(self.processed, self._shop())

    def _shop(self) -> str | None:
        return self.match.order_names.get(self.clean_roles.shop) if self.clean_roles.shop else \
            R.shop_column(self.processed)

    def dedup_stats(self) -> DataFrame:
        return D.dedup_stats(self.margined, self.processed, self.dedup_keys)

    def dedup_details(self) -> DataFrame:
        return D.dedup_details(self.margined, self.processed, self.dedup_keys, dup_key_fields(self.margined))

    def counters(self) -> DataFrame:
        """A11 + A12 as a long (counter, value) table.

        Counts come from data, not from task metrics, which a lost executor's repeated
        stage would add twice: one scan of the raw lines gives lines, lines after the exact dedup and
        orders from (row fingerprint, order) groups; the other counts read the cleaned table that the run
        has written and the final detail (written too after ``saved``)."""
        oid = self.clean_roles.order_id
        final_oid = self.match.order_names.get(oid, oid) if oid else None
        raw = self.orders if self.raw is None else self.raw
        own = [c for c in raw.columns if c not in self.ordering]
        order = lambda c: F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")
        rows = raw.select(*D.row_fingerprint(raw, own), order(oid).alias("oid")).groupBy("__md5", "__check", "oid").agg(F.count(F.lit(1)).alias("n"))
        per_order = rows.groupBy("oid").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct_lines"))
        whole = per_order.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("original_lines"),
                              F.coalesce(F.sum("distinct_lines"), F.lit(0)).alias("deduplicated_lines"), F.count("oid").alias("original_orders"))

        def lines_and_orders(df: DataFrame, key: str | None, lines: str, orders: str) -> DataFrame:
            return (df.select(order(key).alias("oid")).groupBy("oid").agg(F.count(F.lit(1)).alias("n"))
                    .agg(F.coalesce(F.sum("n"), F.lit(0)).alias(lines), F.count("oid").alias(orders)))

        def stacked(one: DataFrame) -> DataFrame:
            names = [c for c in one.columns if oid or not c.endswith(("_orders", "_after_clean"))]
            return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("counter"), F.col(n).cast("long").alias("value"))
                                                  for n in names])).alias("s")).select("s.*")

        return (stacked(whole)
                .unionByName(stacked(lines_and_orders(self.cleaned, oid, "cleaned_lines", "cleaned_orders_after_clean")))
                .unionByName(stacked(lines_and_orders(self.processed, final_oid, "matched_lines", "cleaned_orders"))))

    def report(self) -> DataFrame:
        """Summary, counters and dedup statistics as one long (report, item, value) table; call it on a ``saved`` run."""
        def melted(df: DataFrame, name: str, item: str | None = None) -> DataFrame:
            shown = [c for c in df.columns if c != item and dict(df.dtypes)[c] != "string"]
            label = lambda c: F.concat_ws(".", *([F.col(item)] if item else []), *([F.lit(c)] if not item or len(shown) > 1 else []))
            return df.select(F.explode(F.array(*[F.struct(label(c).alias("item"), F.col(f"`{c}`").cast("double").alias("value"))
                                                 for c in shown])).alias("s")).select(F.lit(name).alias("report"), "s.*")

        return (melted(self.summary(), "summary").unionByName(melted(self.counters(), "counters", "counter"))
                .unionByName(melted(self.shop_rollup(), "shops", "shop_name")))


def _resolve(pairs: list[tuple[str, str]], keywords, override: str | None = None) -> str | None:
    """Output name of the first input name containing a keyword (or equal to
    ``override``), scanning ``(input name, output name)`` pairs in order."""
    for inp, out in pairs:
        if override is not None:
            if inp == override:
                return out
        elif any(k in str(inp).lower() for k in keywords):
            return out
    return None


def _lines_decide(mres: J.MatchResult, keys: Sequence[str]) -> bool:
    """Whether the business keys are columns of the lines, joined to one catalogue row each, and no heading is that of a
    computed column (which would take its place)."""
    names = {*mres.order_names.values(), *mres.product_names.values()}
    return mres.rejoin is not None and set(keys) <= set(mres.lines.columns) and not names & {*M.COMPUTED, "match_status", "processed_at"}


def run_keyword(orders: DataFrame, products: DataFrame,
                opts: C.CleanOptions | None = None,
                product_order_by: Sequence[str] | None = None,
                line_order_by: Sequence[str] | None = None,
                stamp: str | None = "now",
                max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                roles: dict | None = None, materialize_cleaned: bool = True,
                key_pair: tuple[str, str] | str | None = None, cleaned: DataFrame | None = None) -> KeywordRun:
    """Q4: keyword-schema run.  Roles are resolved once on the two input
    schemas (before any join, so suffixes cannot be mistaken for roles).

    The cleaned lines feed both the key-pair search and the final join, so
    by default they are written once to the shared checkpoint folder and
    read back (see ``plans.materialize``), in a folder that the run owns.  ``cleaned`` gives the saved lines
    that the same cleaning of ``orders`` made before."""
    folders = Intermediates(orders.sparkSession)
    with folders.using():
        return _run_keyword(folders, orders, products, opts, product_order_by, line_order_by, stamp, max_broadcast_rows,
                            roles, materialize_cleaned, key_pair, cleaned)


def _run_keyword(folders: Intermediates, orders: DataFrame, products: DataFrame, opts, product_order_by, line_order_by,
                 stamp, max_broadcast_rows, roles, materialize_cleaned, key_pair, cleaned) -> KeywordRun:
    r = dict(roles or {})
    # ordering columns (a row's place in its file, say) play no role
    line_columns = [c for c in orders.columns if c not in (line_order_by or ())]
    save = bool(line_order_by) and materialize_cleaned and cleaned is None
    with Intermediates(orders.sparkSession, "base"), dropping_shuffles(orders.sparkSession):  # writes alone
        cres = C.clean_keyword(orders, opts, OrderRoles.resolve(line_columns, r.get("orders")),
                               line_order_by=line_order_by, share=(lambda df: materialize(df, "base")) if save else None)
        if cleaned is None:
            with folders.using():
                cleaned = materialize(cres.cleaned, "cleaned") if materialize_cleaned else cres.cleaned
    mres = J.match_keyword(cleaned, products, product_order_by, max_broadcast_rows,
                           dedup_after=True, line_order_by=line_order_by, key_pair=key_pair)
    # Roles are resolved on input names, order columns first, then mapped to
    # the output names of their own side (a clashing name is suffixed).
    product_names = [(c, n) for c, n in mres.product_names.items() if c not in (product_order_by or ())]
    merged = [(c, mres.order_names[c]) for c in line_columns if c in mres.order_names] + product_names
    # a product column whose name clashes (and is suffixed) wins for the cost
    product_side = sorted(product_names, key=lambda pair: pair[0] == pair[1])
    m_over = dict(r.get("margin") or {})
    mroles = MarginRoles(
        cost=_resolve(product_side, K.KW_COST, m_over.get("cost")),
        quantity=_resolve(merged, K.KW_QUANTITY, m_over.get("quantity")),
        revenue=_resolve(merged, K.KW_REVENUE, m_over.get("revenue")))
    margined = M.margin_keyword(mres.df, mroles, stamp)
    d_over = (r.get("dedup") or {}).get("keys")
    if d_over is not None:
        keys = tuple(k for k in (_resolve(merged, (), c) for c in d_over) if k)
    else:
        keys = tuple(k for k in (_resolve(merged, kw) for kw in
                                 (K.KW_ORDER_ID, K.KW_DEDUP_SKU, K.KW_DEDUP_SPEC)) if k)
    order_by = [mres.order_names.get(c, c) for c in (line_order_by or [])]
    if keys and _lines_decide(mres, keys):
        # the join adds to a line what its code alone decides, so D4 on the lines keeps the same rows: lines
        # without catalogue and computed columns are shuffled for it, and only those it keeps are joined.
        fields = {f.name: f for f in mres.lines.schema.fields}
        first = D.first_per_key(mres.lines, keys, order_by, lambda c: M.filled(fields[c]), M.ties(mres.lines, mroles))
        processed = M.margin_keyword(mres.rejoin(first), mroles, stamp)
    elif keys:
        # D4 keeps one row per key; exact copies share the key and are equal,
        # so it subsumes the post-join exact dedup: skip that shuffle here.
        pre = M.margin_keyword(J.without_post_join_dedup(mres), mroles, stamp)
        processed = business_dedup(pre, keys, order_by)
    else:
        processed = margined
    bare = lambda df: df.drop(K.LINE_POSITION)  # noqa: E731 - the place in a file is no result column
    return KeywordRun(bare(orders), bare(cleaned), cres.roles, mres, bare(margined), bare(processed), keys, folders,
                      tuple(line_order_by or ()), orders)


def run_pair(pair: LoadedPair, opts: C.CleanOptions | None = None, **params) -> KeywordRun:
    """Q4 over loaded files: "first" rows follow the order of the files (by path) and of
    their rows.  The exact dedup's keep-first value is then a struct, which Spark
    aggregates by sorting instead of hashing."""
    return run_keyword(pair.positioned_orders, pair.positioned_products, opts,
                       product_order_by=[K.PRODUCT_POSITION], line_order_by=[K.LINE_POSITION], **params)


@dataclass
class FixedRun:
    orders: DataFrame
    cleaned: DataFrame
    match: J.MatchResult
    processed: DataFrame

    def counters(self) -> DataFrame:
        """A11 (fixed schema): input lines, cleaned lines, matched lines."""
        spark = self.orders.sparkSession
        pkey = self.match.product_names.get(K.V1_PRODUCT_KEY, K.V1_PRODUCT_KEY)
        return R.counters_frame(spark, [
            ("original_orders", self.orders.agg(F.count(F.lit(1)))),
            ("cleaned_orders", self.cleaned.agg(F.count(F.lit(1)))),
            # the catalogue key is non-null exactly on matched rows
            ("matched_orders", self.processed.agg(F.count(F.col(f"`{pkey}`")))),
        ])


def run_fixed(orders: DataFrame, products: DataFrame, opts: C.CleanOptions | None = None,
              stamp: str | None = "now",
              max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> FixedRun:
    """Q7: fixed-schema run: clean -> fan-out match -> margin."""
    cleaned = C.clean_fixed(orders, opts)
    mres = J.match_fanout(cleaned, products, max_broadcast_rows=max_broadcast_rows)
    processed = M.margin_fixed(mres.df, stamp=stamp)
    return FixedRun(orders, cleaned, mres, processed)


def dup_key_fields(df: DataFrame) -> list[str]:
    """C1o: key fields examined by the per-field duplicate report."""
    return find_columns(df.columns, K.KW_DUP_FIELDS)
