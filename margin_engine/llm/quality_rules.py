"""Quality rules with adaptive thresholds per language and source.

Main path: DataFrame functions only.  One pass measures every whole text
(arrays and higher-order functions inside the row, no shuffle of words).
Each measure is an integer; a group's distribution is a mergeable quantile
sketch: counts per log-linear bin, exact below 200 and within 10 % above, so
sketches of partitions merge by adding counts, in any order, with the same
result.  Thresholds are upper fences (Q75 + 3 * max(IQR, floor)) read from the
sketch of (lang, source); groups under ``MIN_DOCS`` documents take the merged
sketch of the language, then the merged sketch of all documents; under
``MIN_DOCS`` documents in all, no threshold applies.  Documents join their
group's thresholds (null languages and sources are groups of their own).

Defined cases: a null or empty text has no words and fails the base rule; a
null doc_id is measured like any other; repeated rows each count; an empty
table gives an empty result; further columns are ignored by ``measure``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_DOCS = 50
FENCE = 3
#: measure -> least spread (its own unit) that the fence takes for the IQR
FLOORS = {"symbol_pm": 20, "dup_line_pm": 100, "repeat_pm": 30, "word_len_x100": 100,
          "shout_pm": 60}


def _let(value, body):
    """Bind an expression once inside a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _grams(words):
    return F.when(F.size(words) >= 5, F.transform(
        F.sequence(F.lit(0), F.size(words) - 5),
        lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]))
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(grams):
    """Words inside 5-word windows whose content occurs twice or more."""
    ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def positions(s):
        last = F.size(s) - 1
        twice = F.filter(F.sequence(F.lit(0), last), lambda j: (
            (j > 0) & (s[F.greatest(j - 1, F.lit(0))]["g"] == s[j]["g"]))
            | ((j < last) & (s[F.least(j + 1, last)]["g"] == s[j]["g"])))
        return F.array_sort(F.transform(twice, lambda j: s[j]["i"]))

    start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("bigint").alias("n"))
    total = F.aggregate(
        _let(ordered, positions), start,
        lambda acc, p: F.struct(p.alias("last"),
                                (acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n")),
        lambda acc: acc["n"])
    repeats = (F.size(grams) > 0) & (F.size(F.array_distinct(grams)) < F.size(grams))
    return F.when(repeats, total).otherwise(F.lit(0).cast("bigint"))


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the struct ``quality_m``: base counts and integer measures of each whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def counts(words):
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(text, rf"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
            F.length(F.regexp_replace(text, "[^A-Z!]+", "")).cast("bigint").alias("n_shout"),
            _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))
                 ).alias("lines"),
            _let(_grams(words), _covered).alias("n_repeat_words"))

    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    out = df.withColumn("quality_m", _let(words, counts))
    m = F.col("quality_m")
    per = lambda k, a, b: F.expr(f"{k} * {a} div greatest({b}, 1)")
    return out.withColumn("quality_m", F.struct(
        m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        (m["lines"]["n"] - m["lines"]["d"]).cast("bigint").alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"),
        per(1000, "quality_m.n_symbols", "quality_m.word_chars").alias("symbol_pm"),
        F.expr("1000 * bigint(quality_m.lines.n - quality_m.lines.d) div "
               "greatest(quality_m.lines.n, 1)").alias("dup_line_pm"),
        per(1000, "quality_m.n_repeat_words", "quality_m.n_words").alias("repeat_pm"),
        per(100, "quality_m.word_chars", "quality_m.n_words").alias("word_len_x100"),
        per(1000, "quality_m.n_shout", "quality_m.word_chars").alias("shout_pm"),
    )).withColumn("base_failed", (F.col("quality_m.n_words") < 10) | (
        100 * F.col("quality_m.n_repeat_words") > 20 * F.col("quality_m.n_words")))


def _bin(v):
    """Log-linear bin: exact below 200, then two or three leading digits."""
    out = F.when(v < 200, v)
    for k in range(1, 8):
        out = out.when(v < 200 * 10 ** k, v - v % (10 ** k))
    return out.otherwise(v - v % (10 ** 8))


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Mergeable quantile sketches: (lang, source, measure, bin, n)."""
    each = F.explode(F.array(*[
        F.struct(F.lit(k).alias("measure"), _bin(F.col(f"quality_m.{k}")).alias("bin"))
        for k in FLOORS]))
    return (measured.select(F.col(lang).alias("lang"), F.col(source).alias("source"),
                            each.alias("e"))
            .groupBy("lang", "source", "e.measure", "e.bin").agg(F.count(F.lit(1)).alias("n")))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, limits): per group the upper fence of each measure, null where no
    sketch has ``MIN_DOCS`` documents."""
    floor = F.create_map(*[F.lit(x) for kv in FLOORS.items() for x in kv])

    def fences(keys, tag):
        merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "measure")
        run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        q = (merged.withColumn("cum", F.sum("n").over(run)).withColumn("all", F.sum("n").over(w))
             .groupBy(*keys, "measure").agg(
                 F.min(F.when(4 * F.col("cum") >= F.col("all"), F.col("bin"))).alias("q1"),
                 F.min(F.when(4 * F.col("cum") >= 3 * F.col("all"), F.col("bin"))).alias("q3"),
                 F.max("all").alias("all")))
        limit = F.when(F.col("all") >= MIN_DOCS, F.col("q3") + FENCE * F.greatest(
            F.col("q3") - F.col("q1"), floor[F.col("measure")]))
        return q.select(*keys, "measure", limit.alias(tag))

    own = fences(["lang", "source"], "own").alias("o")
    by_lang = fences(["lang"], "by_lang").alias("l")
    overall = fences([], "overall").alias("a")
    j = (own.join(by_lang, F.col("o.lang").eqNullSafe(F.col("l.lang"))
                  & (F.col("o.measure") == F.col("l.measure")), "left")
         .join(overall, F.col("o.measure") == F.col("a.measure"), "left"))
    best = F.coalesce("own", "by_lang", "overall")
    return (j.groupBy(F.col("o.lang").alias("lang"), F.col("o.source").alias("source"))
            .agg(*[F.max(F.when(F.col("o.measure") == k, best)).alias(k) for k in FLOORS]))


def judge(measured: DataFrame, limits: DataFrame, lang: str = "lang",
          source: str = "source") -> DataFrame:
    """Join each document with its group's thresholds; adds ``kept``."""
    t = limits.select(F.col("lang").alias("limit_lang"), F.col("source").alias("limit_source"),
                      F.struct(*FLOORS).alias("limits"))
    over = F.lit(False)
    for k in FLOORS:
        over = over | F.coalesce(F.col(f"quality_m.{k}") > F.col(f"limits.{k}"), F.lit(False))
    return (measured.join(t, F.col(lang).eqNullSafe(F.col("limit_lang"))
                          & F.col(source).eqNullSafe(F.col("limit_source")), "left")
            .withColumn("kept", ~F.col("base_failed") & ~over)
            .drop("limit_lang", "limit_source", "limits"))


def apply_rules(df: DataFrame, text_col: str = "text", lang: str = "lang",
                source: str = "source") -> DataFrame:
    """Rows of ``df`` with ``quality_m``, ``base_failed`` and ``kept``.  The measured rows are
    written once (shared checkpoint folder) and serve the sketches and the filter."""
    rows = materialize(measure(df, text_col), "quality")
    return judge(rows, thresholds(sketches(rows, lang, source)), lang, source)


def keep(df: DataFrame, text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``df`` that the rules keep, with their own columns, whatever their names."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("quality_row"), F.col(text_col).alias("text"),
                       F.col(lang).alias("lang"), F.col(source).alias("source"))
    rows = materialize(measure(packed, "text").drop("text"), "quality")
    kept = judge(rows, thresholds(sketches(rows, "lang", "source")), "lang", "source").filter("kept")
    return kept.select(*[F.col("quality_row").getField(c).alias(c) for c in df.columns])


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = materialize(measure(docs).drop("text"), "quality")
    out = judge(rows, thresholds(sketches(rows)))
    return out.select("doc_id", "quality_m.n_words", "quality_m.word_chars", "quality_m.n_symbols",
                      "quality_m.n_dup_lines", "quality_m.n_repeat_words", "base_failed", "kept")


def rules_sql(docs: str = "documents") -> str:
    """DuckDB CTEs ending in ``q_judged`` (doc_id, base counts, base_failed, kept)."""
    bins = "CASE WHEN v < 200 THEN v " + " ".join(
        f"WHEN v < {200 * 10 ** k} THEN v - v % {10 ** k}" for k in range(1, 8)) + " ELSE v - v % 100000000 END"
    floors = "CASE measure " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in FLOORS.items()) + " END"
    measures = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, '{k}' AS measure, {k} AS v FROM q_measured" for k in FLOORS)

    def fence(keys):
        part = ", ".join([*keys, "measure"])
        return f"""SELECT {part}, CASE WHEN max(total) >= {MIN_DOCS} THEN min(bin) FILTER (4 * cum >= 3 * total)
            + {FENCE} * greatest(min(bin) FILTER (4 * cum >= 3 * total) - min(bin) FILTER (4 * cum >= total), {floors}) END AS lim
          FROM (SELECT {part}, bin, sum(n) OVER (PARTITION BY {part} ORDER BY bin) AS cum,
                       sum(n) OVER (PARTITION BY {part}) AS total
                FROM (SELECT {part}, bin, count(*) AS n FROM q_binned GROUP BY {part}, bin))
          GROUP BY {part}"""

    return f"""
q_words AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM {docs}),
q_grams AS (SELECT doc_id, i, ws[i:i+4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM q_words)),
q_twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM q_grams) WHERE n > 1),
q_rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM q_twice) GROUP BY doc_id),
q_counts AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(text, '[^A-Z!]+', '', 'g')) AS BIGINT) AS n_shout,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM q_words w LEFT JOIN q_rep r USING (doc_id)),
q_measured AS (SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS symbol_pm,
    1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_pm,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeat_pm,
    100 * word_chars // greatest(n_words, 1) AS word_len_x100,
    1000 * n_shout // greatest(word_chars, 1) AS shout_pm,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q_counts),
q_long AS ({measures}),
q_binned AS (SELECT *, {bins} AS bin FROM q_long),
q_own AS ({fence(['lang', 'source'])}),
q_lang AS ({fence(['lang'])}),
q_all AS ({fence([])}),
q_over AS (SELECT x.doc_id, bool_or(coalesce(x.v > coalesce(o.lim, l.lim, a.lim), false)) AS bad FROM q_long x
  JOIN q_own o ON x.lang IS NOT DISTINCT FROM o.lang AND x.source IS NOT DISTINCT FROM o.source AND x.measure = o.measure
  JOIN q_lang l ON x.lang IS NOT DISTINCT FROM l.lang AND x.measure = l.measure
  JOIN q_all a ON x.measure = a.measure GROUP BY x.doc_id),
q_judged AS (SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT bad AS kept FROM q_measured m JOIN q_over USING (doc_id))"""


OP10_SQL = f"WITH {rules_sql().strip()}\nSELECT * FROM q_judged"
