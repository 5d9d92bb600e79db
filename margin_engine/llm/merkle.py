"""Merkle manifest of a dataset, with inclusion proofs, by nested-interval labels.

Every node of a group's tree carries the interval [lo, hi) of leaf ranks that it covers; a node of level k
starts at a multiple of ``FAN``^k, so the bucket ``lo div FAN^k`` names a node among its level.

1. A row's leaf is the SHA-256 of its fields; ranks within a group come from a deal by range (``ranks.ranked``), so a
   group that holds a third of all rows is spread over many tasks.
2. A level is one aggregation by (group, bucket) with at most ``FAN`` rows each; the levels are written once.
   Their number is the logarithm of the largest group.
3. The groups' roots (subroots), in order of their group, are the leaves of a second tree, built alike.
4. From the top down, each node joins its parent: an equi-join on (group, bucket of the parent's level), then containment
   of its interval in the parent's.  The parent's interval less the node's own leaves the intervals of its siblings, those before it and
   those after; they are added to the front of the parent's own path.  At the end the leaves join level 1.
5. A path (siblings before and after, level by level) hashes to ``proof_sha256`` and folds any leaf to a root.

Defined cases: fields that are null count as ``-``; a null group comes first; rows are ordered in a group by ``key``
(null first), rows of one key by their leaf (equal leaves are interchangeable); a group of one row has its leaf as
subroot, a dataset of one group its subroot as root; no rows give no rows; other columns than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .ranks import ranked
from .url_filter import _LOWER, _UPPER, lower_ascii

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 5


def field(value: Column) -> Column:
    """A field's bytes: ``-`` if null, else its UTF-8 length, a colon and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _join_text(parts: Column) -> Column:
    return F.array_join(parts, "")


def _height(n: int, fan: int) -> int:
    k = 0
    while fan ** k < n:
        k += 1
    return k


class Forest:
    """Trees over ``items`` (grp, rank, size, digest): one per group, of ``fan`` children a node."""

    def __init__(self, items: DataFrame, fan: int = FAN, tag: str = "merkle"):
        self.fan, self.items = fan, items
        self.height = _height(items.agg(F.max("size")).first()[0] or 0, fan)
        self.levels = []
        below = items.filter("size > 1").select("grp", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "size", "digest")
        for k in range(1, self.height + 1):
            kids = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))
            nodes = (below.filter(F.col("size") > fan ** (k - 1)).groupBy("grp", self._bucket(k).alias("bucket"))
                     .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("size").alias("size"), kids.alias("kids"))
                     .withColumn("digest", F.sha2(_join_text(F.col("kids.digest")), 256)).drop("bucket"))
            below = materialize(nodes, f"{tag}-{k}")
            self.levels.append(below)

    def _bucket(self, k: int) -> Column:
        return F.expr(f"lo div {self.fan ** k}")

    def roots(self) -> DataFrame:
        """(grp, digest) of each tree's root: the lone leaf, or the node that covers all ranks."""
        out = self.items.filter("size = 1").select("grp", "digest")
        for nodes in self.levels:
            out = out.union(nodes.filter("hi - lo = size").select("grp", "digest"))
        return out

    def paths(self, above: DataFrame, payload: list[str]) -> DataFrame:
        """(grp, rank, payload of the item, carried columns of ``above``, path) for every item.

        ``above`` (grp, path, others) says what follows a tree's root; path entries are (before, after), leaf to root."""
        extra = [c for c in above.columns if c not in ("grp", "path")]
        parents = None
        for k in range(self.height, 0, -1):
            nodes = self.levels[k - 1].withColumn("bucket", F.expr(f"lo div {self.fan ** (k + 1)}"))
            named = nodes.join(above, "grp")  # one node a group: no group is large here
            top = named.filter("hi - lo = size").select("grp", "lo", "hi", "kids", "path", *extra)
            if parents is not None:
                inner = self._climb(nodes.filter("hi - lo < size"), parents, k + 1, ["kids"], extra).select("grp", "lo", "hi", "kids", "path", *extra)
                top = top.union(inner)
            parents = top
        items = self.items.select("grp", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "size", "digest", *payload)
        single = items.filter("size = 1").join(above, "grp")
        cols = ["grp", F.col("lo").alias("rank"), "digest", *payload, "path", *extra]
        if parents is None:
            return single.select(*cols)
        many = items.filter("size > 1").withColumn("bucket", F.expr(f"lo div {self.fan}"))
        return single.select(*cols).union(self._climb(many, parents, 1, ["digest", *payload], extra).select(*cols))

    def _climb(self, nodes: DataFrame, parents: DataFrame, k: int, carried: list[str], extra: list[str]) -> DataFrame:
        """Attach to each node (grp, lo, hi, bucket) its level-k ancestor and lead its path by its siblings."""
        p = parents.select(F.col("grp").alias("p_grp"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("kids").alias("p_kids"),
                           F.col("path").alias("p_path"), F.expr(f"lo div {self.fan ** k}").alias("p_bucket"), *extra)
        met = nodes.join(p, (F.col("grp") == F.col("p_grp")) & (F.col("bucket") == F.col("p_bucket"))
                         & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi")))
        before = F.expr("transform(filter(p_kids, x -> x.hi <= lo), x -> x.digest)")
        after = F.expr("transform(filter(p_kids, x -> x.lo >= hi), x -> x.digest)")
        step = F.struct(_join_text(before).alias("before"), _join_text(after).alias("after"))
        return met.select("grp", "lo", "hi", *carried, F.concat(F.array(step), F.col("p_path")).alias("path"), *extra)


def proof_digest(path: Column) -> Column:
    return F.sha2(_join_text(F.transform(path, lambda s: F.concat(s["before"], s["after"]))), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def manifest(rows: DataFrame, group: str, key: str, leaf: Column, carried: dict[str, Column] | None = None, fan: int = FAN) -> DataFrame:
    """(key, group, rank, leaf, subroot, root, path, carried columns) for every row of ``rows``."""
    carried = carried or {}
    grp = F.coalesce(F.concat(F.lit("."), F.col(group)), F.lit(""))  # null first, then by UTF-8 bytes
    # the hashes are computed once; a deal by range looks at its rows twice
    leaves = materialize(rows.select(F.col(key).alias("item"), grp.alias("grp"), leaf.alias("digest"),
                                     *[v.alias(f"with_{c}") for c, v in carried.items()]), "merkle-leaves")
    kept = ["item", *[f"with_{c}" for c in carried]]
    items = ranked(leaves, "grp", ["item", "digest", *kept[1:]], "merkle-ranks")
    trees = Forest(items, fan)
    subroots = materialize(trees.roots().withColumnRenamed("grp", "of_group"), "merkle-subroots")
    tops = ranked(subroots.withColumn("grp", F.lit("")), "grp", ["of_group"], "merkle-groups")
    top = Forest(tops, fan, "merkle-top")
    root = top.roots().select(F.col("digest").alias("root"))
    digest = root.first()  # one row
    start = spark_row(tops, digest["root"] if digest else None)
    above = materialize(top.paths(start, ["of_group"]).select(F.col("of_group").alias("grp"), "path", "root", F.col("digest").alias("subroot")), "merkle-above")
    out = trees.paths(above, kept)
    return out.select(F.col("item").alias(key), F.expr("if(grp = '', null, substring(grp, 2))").alias(group), "rank", F.col("digest").alias("leaf"),
                      "subroot", "root", "path", *[F.col(f"with_{c}").alias(c) for c in carried])


def spark_row(like: DataFrame, root: str | None) -> DataFrame:
    """The one row above the top tree: nothing follows its root."""
    return like.sparkSession.createDataFrame([("", [], root)], "grp string, path array<struct<before:string,after:string>>, root string")


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = [F.col(c) for c in FIELDS]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0, F.lit(False))
    changed = [*plain[:-1], lower_ascii(F.col("text"))]
    tampered = F.when(hit, leaf_of(changed))
    m = manifest(docs, "source", "doc_id", leaf_of(plain), {"tampered": tampered})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                    folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


#: DuckDB SQL for crc32 of a text of ASCII characters.
def crc32_sql(text: str) -> str:
    return (f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), "
            "lambda a, b: list_reduce(list_concat([xor(a, b)], CAST(range(8) AS BIGINT[])), "
            "lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)")


def _leaf_sql(text: str) -> str:
    cells = [f"CAST({c} AS VARCHAR)" for c in FIELDS[:-1]] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in cells) + ")"


OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS n, doc_id, source, {_leaf_sql('text')} AS leaf,
    CASE WHEN coalesce({crc32_sql('CAST(doc_id AS VARCHAR)')} % {TAMPER} = 0, false)
      THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS tampered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, n) - 1 AS i, count(*) OVER (PARTITION BY source) AS size FROM d),
t(lvl, source, size, i, digest) AS (SELECT 0, source, size, i, leaf FROM l
  UNION ALL SELECT lvl + 1, source, any_value(CAST((size + {FAN - 1}) // {FAN} AS BIGINT)), i // {FAN}, sha256(string_agg(digest, '' ORDER BY i))
    FROM t WHERE size > 1 GROUP BY lvl, source, i // {FAN}),
s AS (SELECT source, digest AS subroot, lvl AS h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS size FROM t WHERE size = 1),
u(lvl, size, i, digest) AS (SELECT 0, size, i, subroot FROM s
  UNION ALL SELECT lvl + 1, any_value(CAST((size + {FAN - 1}) // {FAN} AS BIGINT)), i // {FAN}, sha256(string_agg(digest, '' ORDER BY i))
    FROM u WHERE size > 1 GROUP BY lvl, i // {FAN}),
tree AS (SELECT false AS top, source, lvl, size, i, digest FROM t UNION ALL SELECT true, NULL, lvl, size, i, digest FROM u),
f(n, top, source, lvl, i, acc, proof) AS (SELECT n, false, source, 0, i, coalesce(tampered, leaf), '' FROM l
  UNION ALL (
    WITH c AS (SELECT f.n, f.top, f.source, f.lvl, f.i, f.acc, f.proof, o.i AS oi, o.digest, o.size
      FROM f JOIN tree o ON o.top = f.top AND (f.top OR o.source IS NOT DISTINCT FROM f.source) AND o.lvl = f.lvl AND o.i // {FAN} = f.i // {FAN})
    SELECT n, top, source, lvl + 1, i // {FAN}, sha256(string_agg(CASE WHEN oi = i THEN acc ELSE digest END, '' ORDER BY oi)),
      any_value(proof) || coalesce(string_agg(digest, '' ORDER BY oi) FILTER (oi <> i), '') FROM c WHERE size > 1 GROUP BY n, top, source, lvl, i
    UNION ALL
    SELECT c.n, true, c.source, 0, s.i, c.acc, c.proof FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source WHERE c.size = 1 AND NOT c.top)),
e AS (SELECT f.n, f.acc, f.proof, u.digest AS root FROM f JOIN u ON f.top AND u.lvl = f.lvl AND u.i = f.i AND u.size = 1)
SELECT l.doc_id, l.leaf, s.subroot, e.root, sha256(e.proof) AS proof_sha256, e.acc AS folded_root, e.acc = e.root AS verified
FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN e ON e.n = l.n"""
