"""URL filters: allow and block rules on hosts and paths.

A rule (host, path, verdict) fits a url whose host is the rule's or a subdomain of it and
whose path starts with the rule's path; of the rules that fit, the longest text (host and
path, then the longer host) decides, and of two rules of one text ``block``.

1. The rules' *shapes* (number of host labels, length of the path) say which expressions a url
   can share with a rule: its last ``labels`` host labels followed by the first ``chars`` characters of its
   path.  A url is expanded into these only, so a long host or path costs no more than the rules ask for.
2. Urls collapse to distinct (host, path cut to the longest rule path) before they are expanded
   (partial aggregation), so a page or host that holds a third of all rows is expanded once.
3. Expressions equi-join with the rules on the first ``PREFIX`` hex digits of their SHA-256; the full
   digest confirms.  The rules are broadcast only if measured small; otherwise the adaptive skew join
   splits an expression that most urls share (the rules' side has one row for it).
4. The longest confirmed rule of a (host, path cut) goes back to its pages, by a broadcast if measured small, else by a
   join with salted keys.

The shapes are collected: at most (labels of a host) x (distinct lengths of rule paths), whatever the number of
pages or rules.

Defined cases: a null url or one without ``://`` has empty host and path and fits no rule; a rule with a null
part, an empty host or a path that neither is empty nor starts with ``/`` fits nothing and is left out; a verdict other
than ``block`` counts as ``allow``; repeated rows are judged each; no rules or no pages give the default verdict or no rows; further
columns are carried, columns named like the four that ``judge`` adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from ..plans.materialize import materialize

PREFIX = 8
SALT = 16
DEFAULT = "allow"
#: The rules of the registered query: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.split(host, r"\.", -1)


def _keyed(df: DataFrame, text: str) -> DataFrame:
    df = df.withColumn("digest", F.sha2(F.col(text), 256))
    return df.withColumn("prefix", F.substring("digest", 1, PREFIX))


def catalogue(rules: DataFrame) -> DataFrame:
    """One row per usable rule text: rule, rule_host, labels, chars, verdict, digest, prefix."""
    host = lower_ascii(F.col("host"))
    usable = (F.length("host") > 0) & F.col("verdict").isNotNull() & ((F.col("path") == "") | F.col("path").startswith("/"))
    verdict = F.when(F.col("verdict") == "block", "block").otherwise("allow")
    texts = (rules.filter(usable).select(F.concat(host, F.col("path")).alias("rule"), host.alias("rule_host"),
                                         F.size(_labels(host)).alias("labels"), F.length("path").alias("chars"), verdict.alias("verdict"))
             .groupBy("rule", "rule_host", "labels", "chars").agg(F.max("verdict").alias("verdict")))
    return _keyed(texts, "rule")


def expressions(urls: DataFrame, shapes: list) -> DataFrame:
    """Explode each (host, cut) into its host-suffix and path-prefix expressions of the given shapes."""
    fits = F.filter(F.lit([list(s) for s in shapes]), lambda s: (s[0] <= F.size("labels")) & (s[1] <= F.length("cut")))
    texts = F.transform(fits, lambda s: F.concat(
        F.array_join(F.slice("labels", F.size("labels") - s[0] + 1, s[0]), "."), F.col("cut").substr(F.lit(1), s[1])))
    return _keyed(urls.withColumn("labels", _labels(F.col("host")))
                  .select("host", "cut", F.explode(texts).alias("expression")), "expression").drop("expression")


def _attach(rows: DataFrame, best: DataFrame) -> DataFrame:
    """The verdict of each row's (host, cut): broadcast if measured small; otherwise the rows of a host that many
    share are dealt over ``SALT`` keys and the verdicts are repeated for each."""
    best, small = bounded_broadcast(best)
    if small:
        return rows.join(best, ["host", "cut"], "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALT)))
    spread = best.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
    return salted.join(spread, ["host", "cut", "salt"], "left")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with url_host, url_path, url_rule (null if none fits) and url_verdict."""
    own = ("url_host", "url_path", "url_rule", "url_verdict")
    carried = [c for c in pages.columns if c not in own]
    known = catalogue(rules)
    shapes = [tuple(r) for r in known.select("labels", "chars").distinct().collect()]
    longest = max((chars for _, chars in shapes), default=0)
    url = F.col(url_col)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("page"), url_host(url).alias("host"), url_path(url).alias("path"))
    if not shapes:
        judged = rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    else:
        rows = rows.withColumn("cut", F.col("path").substr(1, longest))
        urls = pages.select(url_host(url).alias("host"), url_path(url).substr(1, longest).alias("cut")).distinct()
        known, _ = bounded_broadcast(known)
        met = expressions(urls, shapes).join(known.withColumnRenamed("digest", "rule_digest"), "prefix").filter("digest = rule_digest")
        best = met.groupBy("host", "cut").agg(F.max(F.struct(
            F.length("rule").alias("len"), F.length("rule_host").alias("host_len"), "rule", "verdict")).alias("best"))
        judged = _attach(rows, materialize(best, "url-verdicts")).select(
            "page", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return judged.select(*[F.col("page").getField(c).alias(c) for c in carried], *[F.col(c[4:]).alias(c) for c in own])


def keep(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """The pages that are not blocked, with their own columns."""
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row_of_page"), F.col(url_col).alias("url"))
    kept = judge(rows, rules, "url", default).filter("url_verdict <> 'block'")
    return kept.select(*[F.col("row_of_page").getField(c).alias(c) for c in pages.columns])


def op11(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge(pages, rules).select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"),
                                      F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


OP11_SQL = f"""
WITH r(rule_host, rule_path, rule_verdict) AS (VALUES {', '.join(str(x) for x in RULES)}),
p AS (SELECT row_number() OVER () AS n, page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT p.*, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
  FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, '{DEFAULT}') AS verdict FROM m WHERE k = 1"""
