"""Quality rules with adaptive thresholds from mergeable quantile sketches (operator 2), DataFrame operations only.

Each document gets whole-number metrics. A sketch is the histogram of a metric in buckets of a relative width
of 1/32 (values below 32 are exact), so sketches merge by adding counts, whatever the order, and one
sketch per (language, source) rolls up to one per language and one for all. A group with few documents
uses the sketch of the next level. The fence of a metric is its quartile plus `reach` times the distance of
the quartiles, with a least distance, so a group in which all documents are alike loses none of them.
Documents are then filtered by a join with their group's fences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import BLANKS, read_table, small_side, written

#: metric -> (the least distance of quartiles, fence above, fence below)
METRICS = {
    "symbol_rate": (100, True, False),  # symbols per 10,000 characters of words
    "word_length": (60, True, True),  # hundredths of characters
    "dup_line_rate": (100, True, False),  # per 1,000 lines with a word
    "repeat_rate": (45, True, False),  # words in repeated windows per 1,000
    "upper_rate": (40, True, False),  # upper-case letters per 1,000 characters of words
}


def base_metrics(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines, n_upper (long) to docs.

    Words are runs of characters other than ASCII blanks; a null text has none. Long texts are linear up to one
    sort of their window hashes, and only where a window repeats.
    """
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    df = docs.withColumn("__words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    df = df.withColumn("__lines", F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    n = F.size("__words")
    word = lambda i: F.get("__words", i)
    df = df.withColumn(
        "__windows",
        F.when(n < 5, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(word(i + j) for j in range(5))))),
    )
    df = df.withColumn(
        "__sorted",
        F.when(F.size(F.array_distinct("__windows")) == F.size("__windows"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
            F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        ),
    )
    at = lambda j: F.get("__sorted", j)["h"]
    twice = F.transform("__sorted", lambda x, j: F.when((at(j - 1) == x["h"]) | (at(j + 1) == x["h"]), x["i"]))
    df = df.withColumn("__starts", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    covered = F.aggregate(
        "__starts",
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["sum"] + i + 5 - F.greatest(i, a["end"])).alias("sum"), (i + 5).alias("end")),
        lambda a: a["sum"],
    )
    return df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        }
    ).drop("__words", "__lines", "__windows", "__sorted", "__starts")


def rates(df: DataFrame) -> DataFrame:
    share = lambda a, b, per: F.floor(F.col(a) * per / F.greatest(F.col(b), F.lit(1))).cast("long")
    return df.withColumns(
        {
            "symbol_rate": share("n_symbols", "word_chars", 10_000),
            "word_length": share("word_chars", "n_words", 100),
            "dup_line_rate": share("n_dup_lines", "n_lines", 1000),
            "repeat_rate": share("n_repeat_words", "n_words", 1000),
            "upper_rate": share("n_upper", "word_chars", 1000),
        }
    )


def bucket(value: Column) -> Column:
    """The least value of the bucket: all but the five leading bits are 0."""
    drop = F.greatest(F.char_length(F.bin(value)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(df: DataFrame) -> DataFrame:
    """(lang, source, metric, value, n): one mergeable sketch per language, source and metric."""
    cells = F.explode(F.map_from_arrays(F.array(*map(F.lit, METRICS)), F.array(*(bucket(F.col(m)) for m in METRICS)))).alias("metric", "value")
    return df.select("lang", "source", cells).groupBy("lang", "source", "metric", "value").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "value").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """(keys, docs, low_<metric>, high_<metric>) from the quartiles of each sketch."""
    w = Window.partitionBy(*keys, "metric").orderBy("value")
    whole = Window.partitionBy(*keys, "metric")
    ranked = sketch.withColumns({"before": F.sum("n").over(w), "docs": F.sum("n").over(whole)})
    quartile = lambda p: F.min(F.when(F.col("before") * 4 >= F.col("docs") * p, F.col("value")))
    q = ranked.groupBy(*keys, "metric").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.first("docs").alias("docs"))
    floor = F.create_map(*(F.lit(x) for m, (least, _, _) in METRICS.items() for x in (m, least)))
    spread = reach * F.greatest(F.col("q3") - F.col("q1"), floor[F.col("metric")])
    of = lambda m, c: F.max(F.when(F.col("metric") == m, c))
    out = q.groupBy(*keys) if keys else q.groupBy()
    return out.agg(
        F.max("docs").alias("docs"),
        *(of(m, F.col("q3") + spread).alias(f"high_{m}") for m, (_, above, _) in METRICS.items() if above),
        *(of(m, F.col("q1") - spread).alias(f"low_{m}") for m, (_, _, below) in METRICS.items() if below),
    )


def quality_filter(docs: DataFrame, *, reach: int = 4, least_docs: int = 200) -> DataFrame:
    """Judge documents; returns doc_id, n_words, the base metrics, base_failed and kept, one row per input row.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated five-word windows. Only documents that pass
    that rule feed the sketches. kept: not base_failed, and all metrics inside the fences of the group. Null lang
    and source are groups of their own. Other columns than doc_id, text, lang, source are ignored. Null and empty texts
    have no words and fail. Repeated rows are judged each, and count each in the sketches; a text of any length is read whole.
    """
    keys = ["lang", "source"]
    df = rates(base_metrics(docs.select("doc_id", "text", *keys)).drop("text"))
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    # null-safe equi-join keys
    df = written(df.withColumns({k: F.coalesce(F.concat(F.lit("="), k), F.lit("null")) for k in keys}), "metrics")
    by_source = written(sketches(df.filter(~F.col("base_failed"))), "sketches")
    fine = fences(by_source, keys, reach)
    rough = fences(merged(by_source, ["lang"]), ["lang"], reach)
    whole = fences(merged(by_source, []), [], reach).first().asDict()  # one row
    limits = [c for c in whole if c != "docs"]
    named = lambda t, p: t.select(*(c if c in keys else F.col(c).alias(f"{p}_{c}") for c in t.columns))
    groups = df.select(*keys).distinct().join(named(fine, "a"), keys, "left").join(named(rough, "b"), "lang", "left")
    pick = lambda c: F.when(F.col("a_docs") >= least_docs, F.col(f"a_{c}")).when(F.col("b_docs") >= least_docs, F.col(f"b_{c}")).otherwise(F.lit(whole[c]).cast("long"))
    # one row a language and source, so a large group is not gathered for its limits
    chosen = small_side(groups.select(*keys, *(pick(c).alias(c) for c in limits)), "limits")
    inside = F.lit(True)
    for m, (_, above, below) in METRICS.items():
        inside = inside & (F.col(m) <= F.col(f"high_{m}")) if above else inside
        inside = inside & (F.col(m) >= F.col(f"low_{m}")) if below else inside
    out = df.join(chosen, keys, "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and verdicts of all documents; see quality_filter() for odd rows."""
    return quality_filter(read_table(spark, sf_dir, "documents"))


_FENCE = lambda keys: f"""SELECT {keys}, max(docs) AS docs, {', '.join(
    [f"max(CASE WHEN metric = '{m}' THEN q3 + 4 * greatest(q3 - q1, {least}) END) AS high_{m}" for m, (least, _, _) in METRICS.items()]
    + [f"max(CASE WHEN metric = '{m}' THEN q1 - 4 * greatest(q3 - q1, {least}) END) AS low_{m}" for m, (least, _, below) in METRICS.items() if below])}
  FROM (SELECT {keys}, metric, max(docs) AS docs, min(CASE WHEN before * 4 >= docs THEN value END) AS q1, min(CASE WHEN before * 4 >= docs * 3 THEN value END) AS q3
    FROM (SELECT {keys}, metric, value, sum(n) OVER (PARTITION BY {keys}, metric ORDER BY value) AS before, sum(n) OVER (PARTITION BY {keys}, metric) AS docs
      FROM (SELECT {keys}, metric, value, count(*) AS n FROM cells GROUP BY ALL)) GROUP BY ALL) GROUP BY ALL"""  # noqa: E731

ORACLE = (
    r"""
WITH w AS (SELECT doc_id, coalesce('=' || lang, 'null') AS lang, coalesce('=' || source, 'null') AS source, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(0, 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(text, '\p{Lu}')) AS n_upper FROM w LEFT JOIN r USING (doc_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols * 10000 // greatest(word_chars, 1) AS symbol_rate, word_chars * 100 // greatest(n_words, 1) AS word_length,
  n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_line_rate, n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_rate, n_upper * 1000 // greatest(word_chars, 1) AS upper_rate FROM b),
v AS (SELECT lang, source, '' AS whole, metric, v, greatest(length(bin(v)) - 5, 0) AS s FROM (
"""
    + " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, CAST({m} AS BIGINT) AS v FROM m WHERE NOT base_failed" for m in METRICS)
    + """)),
cells AS (SELECT lang, source, whole, metric, (v >> s) << s AS value FROM v),
"""
    + f"fa AS ({_FENCE('lang, source')}), fb AS ({_FENCE('lang')}), fc AS ({_FENCE('whole')}),\n"
    + "t AS (SELECT m.*, "
    + ", ".join(
        f"CASE WHEN fa.docs >= 200 THEN fa.{c} WHEN fb.docs >= 200 THEN fb.{c} ELSE fc.{c} END AS {c}" for c in [f"high_{m}" for m in METRICS] + [f"low_{m}" for m, x in METRICS.items() if x[2]]
    )
    + " FROM m LEFT JOIN fa ON fa.lang = m.lang AND fa.source = m.source LEFT JOIN fb ON fb.lang = m.lang CROSS JOIN fc)\n"
    + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND "
    + " AND ".join([f"{m} <= high_{m}" for m in METRICS] + [f"{m} >= low_{m}" for m, x in METRICS.items() if x[2]])
    + " AS kept FROM t"
)
