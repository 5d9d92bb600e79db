"""Matching order lines to the product catalogue.

* ``key_search`` (J3) scores every (product key column, order key column)
  candidate pair in **one** job instead of one join per pair: the order
  candidates are unpivoted to ``(o_ix, key)`` and counted (map-side partial
  counts, so a hot code costs one row per task), the product candidates are
  unpivoted to distinct ``(p_ix, key)``, the two meet on ``key`` and the hits
  are summed per pair.  Only the single best pair reaches the driver.
* ``match_first`` (J2) keeps the first catalogue row per key (D2), then
  left-joins the lines; the catalogue side is broadcast only under a checked
  row bound, otherwise a shuffle join is planned.
* Keys are stringified and stripped of Unicode white space on both sides;
  a null key never matches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.roles import find_columns
from ..functions.text import strip_key
from .dedup import exact_dedup, first_per_key
from .joins import DEFAULT_MAX_BROADCAST_ROWS, bounded_broadcast


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


#: States that no candidate pair has hits.
NO_PAIR = "no pair"

SCORE_SCHEMA = T.StructType([
    T.StructField("p_ix", T.IntegerType(), False),
    T.StructField("product_column", T.StringType(), False),
    T.StructField("o_ix", T.IntegerType(), False),
    T.StructField("order_column", T.StringType(), False),
])


def _unpivot_keys(df: DataFrame, cands: Sequence[str], ix_name: str) -> DataFrame:
    pairs = F.explode(F.array(*[
        F.struct(F.lit(i).alias(ix_name), strip_key(_c(c)).alias("key"))
        for i, c in enumerate(cands)]))
    return df.select(pairs.alias("u")).select("u.*").filter(F.col("key").isNotNull())


def key_search(orders: DataFrame, products: DataFrame,
               product_candidates: Sequence[str], order_candidates: Sequence[str]) -> DataFrame:
    """Matched-line count for every candidate pair, zero pairs included.

    Columns: p_ix, product_column, o_ix, order_column, matched_lines,
    product_keys (distinct non-null stripped keys of the product column; the
    first-row-per-key catalogue has at most ``product_keys + 1`` rows).
    """
    spark = orders.sparkSession
    grid = spark.createDataFrame(
        [(pi, pc, oi, oc) for pi, pc in enumerate(product_candidates)
         for oi, oc in enumerate(order_candidates)], SCORE_SCHEMA)
    if not product_candidates or not order_candidates:
        return (grid.withColumn("matched_lines", F.lit(0).cast("long"))
                .withColumn("product_keys", F.lit(0).cast("long")))
    o_counts = (_unpivot_keys(orders, order_candidates, "o_ix")
                .groupBy("o_ix", "key").agg(F.count(F.lit(1)).alias("n")))
    p_keys = _unpivot_keys(products, product_candidates, "p_ix").distinct()
    hits = (o_counts.join(p_keys, on="key", how="inner")
            .groupBy("p_ix", "o_ix").agg(F.sum("n").alias("matched_lines")))
    n_keys = p_keys.groupBy("p_ix").agg(F.count(F.lit(1)).alias("product_keys"))
    return (grid.join(hits, on=["p_ix", "o_ix"], how="left")
            .join(n_keys, on="p_ix", how="left")
            .select("p_ix", "product_column", "o_ix", "order_column",
                    F.coalesce(F.col("matched_lines"), F.lit(0)).cast("long").alias("matched_lines"),
                    F.coalesce(F.col("product_keys"), F.lit(0)).cast("long").alias("product_keys")))


def key_hits(orders: DataFrame, products: DataFrame, product_candidates: Sequence[str],
             order_candidates: Sequence[str], by: str) -> DataFrame:
    """J3 per group of lines: (``by``, p_ix, o_ix, matched_lines) of pairs with hits.

    Summed over the groups it is ``key_search``; a store keeps it per group and replaces the groups
    that change."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("o_ix"), strip_key(_c(c)).alias("key")) for i, c in enumerate(order_candidates)]))
    keys = orders.select(_c(by), pairs.alias("u")).select(_c(by), "u.*").filter("key is not null")
    # a group's lines mostly differ in their keys, so counting them before the join would be a shuffle that joins nothing
    p_keys = _unpivot_keys(products, product_candidates, "p_ix").distinct()
    return keys.join(p_keys, "key").groupBy(_c(by), "p_ix", "o_ix").agg(F.count(F.lit(1)).alias("matched_lines"))


def best_pair(scores: DataFrame) -> tuple[str, str, int, int] | None:
    """Most matched lines; ties go to the earlier product, then order column.

    Returns (product column, order column, matched lines, product keys)."""
    row = (scores.orderBy(F.desc("matched_lines"), F.asc("p_ix"), F.asc("o_ix"))
           .limit(1).collect())
    if not row:
        return None
    r = row[0]
    return (r["product_column"], r["order_column"], int(r["matched_lines"]),
            int(r["product_keys"]))


@dataclass
class MatchResult:
    df: DataFrame
    status: str                      # "matched", "no_candidates", "no_hits", "no_catalogue"
    pair: tuple[str, str] | None = None
    matched_lines: int = 0
    order_names: dict[str, str] = field(default_factory=dict)    # input name -> output name
    product_names: dict[str, str] = field(default_factory=dict)
    broadcast: bool = False
    pre_dedup: DataFrame | None = None      # joined rows before D3
    lines: DataFrame | None = None          # J2: the lines as they go into the join, stripped key and output names
    rejoin: Callable[[DataFrame], DataFrame] | None = None   # J2 for some of ``lines``: joined rows before D3


def _rename_clashes(orders: DataFrame, products: DataFrame, o_key: str, p_key: str,
                    suffixes: tuple[str, str]):
    """Clashing names get suffixes; equal key names collapse to one."""
    clash = set(orders.columns) & set(products.columns)
    same_key = o_key == p_key
    o_names, p_names = {}, {}
    for c in orders.columns:
        o_names[c] = c + suffixes[0] if (c in clash and not (same_key and c == o_key)) else c
    for c in products.columns:
        if same_key and c == p_key:
            continue
        p_names[c] = c + suffixes[1] if c in clash else c
    o = orders.select([_c(c).alias(n) for c, n in o_names.items()])
    p = products.select([_c(c).alias(n) for c, n in p_names.items()] +
                        ([_c(p_key).alias("__pkey")]))
    return o, p, o_names, p_names


def join_catalogue(orders: DataFrame, products: DataFrame, o_key: str, p_key: str,
                   first_only: bool, product_order_by: Sequence[str] | None,
                   max_broadcast_rows: int, suffixes: tuple[str, str],
                   known_rows: int | None = None):
    """Strip both keys, optionally keep the first product per key, left join."""
    o = orders.withColumn(o_key, strip_key(_c(o_key)))
    p = products.withColumn(p_key, strip_key(_c(p_key)))
    if first_only:
        p = first_per_key(p, [p_key], product_order_by)
    p = p.drop(K.PRODUCT_POSITION)
    o2, p2, o_names, p_names = _rename_clashes(o, p, o_key, p_key, suffixes)
    p2 = p2.withColumn("__matched", F.lit(True))
    p2, used_broadcast = bounded_broadcast(p2, max_broadcast_rows, known_rows)
    left_key = o_names[o_key]
    cols = [F.col(f"o.`{n}`") for n in o_names.values()]
    cols += [F.col(f"p.`{n}`") for n in p_names.values()]
    cols.append(F.coalesce(F.col("p.__matched"), F.lit(False)).alias("__matched"))

    def join(lines: DataFrame) -> DataFrame:
        """Lines with stripped keys and output names, joined to the catalogue."""
        return lines.alias("o").join(p2.alias("p"), F.col(f"o.`{left_key}`") == F.col("p.__pkey"), "left").select(*cols)

    return o2, join, o_names, p_names, used_broadcast


def match_first(orders: DataFrame, products: DataFrame, o_key: str, p_key: str,
                product_order_by: Sequence[str] | None = None,
                max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                dedup_after: bool = True, product_keys: int | None = None) -> MatchResult:
    """J2 (+D2, D3): left join on the first product row per key.

    ``product_keys`` (distinct non-null keys, known from the key search)
    bounds the first-row catalogue at ``product_keys + 1`` rows, so the
    broadcast decision needs no counting job of its own."""
    lines, join, o_names, p_names, bc = join_catalogue(
        orders, products, o_key, p_key, True, product_order_by, max_broadcast_rows,
        ("_order", "_product"),
        None if product_keys is None else product_keys + 1)

    def matched(some: DataFrame) -> DataFrame:
        return join(some).withColumn(
            "match_status",
            F.when(F.col("__matched"), F.lit(K.MATCH_MATCHED)).otherwise(F.lit(K.MATCH_UNMATCHED))
        ).drop("__matched")

    out = matched(lines)
    pre = out
    if dedup_after:
        out = exact_dedup(out, [K.LINE_POSITION])
    return MatchResult(out, "matched", (p_key, o_key), 0, o_names, p_names, bc, pre, lines, matched)


def match_fanout(orders: DataFrame, products: DataFrame,
                 o_key: str = K.V1_ORDER_KEY, p_key: str = K.V1_PRODUCT_KEY,
                 max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> MatchResult:
    """Fixed-schema left join; duplicate product keys fan out.

    The product side is projected to the fixed product columns it has.
    """
    keep = [c for c in K.V1_PRODUCT_COLUMNS if c in products.columns]
    if p_key not in keep:
        raise KeyError(f"fixed-schema match needs product column {p_key}")
    lines, join, o_names, p_names, bc = join_catalogue(
        orders, products.select([_c(c) for c in keep]), o_key, p_key, False, None,
        max_broadcast_rows, ("_x", "_y"))
    return MatchResult(join(lines).drop("__matched"), "matched", (p_key, o_key), 0,
                       o_names, p_names, bc)


def unmatched_lines(orders: DataFrame, products: DataFrame, o_key: str, p_key: str,
                    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Order lines with no catalogue key (anti join; null keys never match).

    The distinct catalogue keys are broadcast under the row bound; above it
    they are grouped by a struct so the anti join's key side is a direct
    shuffle and AQE can split a hot code on the line side."""
    o = orders.withColumn(o_key, strip_key(_c(o_key)))
    p_keys = (products.select(F.struct(strip_key(_c(p_key)).alias("k")).alias("__s"))
              .filter(F.col("__s.k").isNotNull()).distinct()
              .select(F.col("__s.k").alias("__pkey")))
    p_keys, _ = bounded_broadcast(p_keys, max_broadcast_rows)
    return o.join(p_keys, _c(o_key) == F.col("__pkey"), "left_anti")


def candidates(orders: DataFrame, products: DataFrame, product_order_by: Sequence[str] | None = None,
               line_order_by: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """C1j / C1k: product and order key candidates, schema order, without ordering columns."""
    return (find_columns([c for c in products.columns if c not in (product_order_by or ())], K.KW_PRODUCT_KEY),
            find_columns([c for c in orders.columns if c not in (line_order_by or ())], K.KW_ORDER_KEY))


def match_keyword(orders: DataFrame, products: DataFrame,
                  product_order_by: Sequence[str] | None = None,
                  max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                  dedup_after: bool = True, line_order_by: Sequence[str] | None = None,
                  key_pair: tuple[str, str] | str | None = None) -> MatchResult:
    """Q2: pick the best key pair, then J2; J4 fallbacks when nothing matches.

    ``key_pair`` (product column, order column) skips the search; ``NO_PAIR`` states that it found no hits."""
    names = {c: c for c in orders.columns}
    if products is None:
        # No catalogue loaded -> nothing to process.
        return MatchResult(orders.limit(0).withColumn("match_status", F.lit(None).cast("string")),
                           "no_catalogue", None, 0, names, {})
    p_cands, o_cands = candidates(orders, products, product_order_by, line_order_by)
    if not p_cands or not o_cands:
        return MatchResult(orders.withColumn("match_status", F.lit(K.MATCH_NO_CANDIDATES)),
                           "no_candidates", None, 0, names, {})
    if isinstance(key_pair, tuple):
        return match_first(orders, products, key_pair[1], key_pair[0], product_order_by, max_broadcast_rows, dedup_after)
    best = None if key_pair == NO_PAIR else best_pair(key_search(orders, products, p_cands, o_cands))
    if best is None or best[2] <= 0:
        return MatchResult(orders.withColumn("match_status", F.lit(K.MATCH_ALL_FAILED)),
                           "no_hits", None, 0, names, {})
    p_key, o_key, hits, n_keys = best
    res = match_first(orders, products, o_key, p_key, product_order_by,
                      max_broadcast_rows, dedup_after, product_keys=n_keys)
    res.matched_lines = hits
    return res


def without_post_join_dedup(res: MatchResult) -> DataFrame:
    """The joined rows of ``res`` before D3 (exact dedup after the join).

    Used under a keep-first-per-key dedup, which already collapses exact
    copies (they share every key and are interchangeable), so the full-width
    shuffle of D3 would be wasted there.
    """
    return res.pre_dedup if res.pre_dedup is not None else res.df
