"""Secret scan with a random forest against false positives (operator 5), DataFrame operations only.

Candidates are all runs of key-like characters that are long enough, and all assigned or quoted values, of any length and
alphabet, with the text before them. The forest
sees a candidate's length, its character transitions (how often the kind of character changes), how much
of it a dictionary of the corpus covers (letter triples of words that several documents use), the path it
stands in (here: the source) and the neighbouring word. It learns from labelled findings, secrets and false ones
(checksums, ids, paths, words of the corpus), and drops the candidates that it takes for false positives. Candidates that
no rule labels are only judged.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import ngrams
from textloom.llm.common import doc_key, read_table, small_side, version_of, written

#: A whole run of these characters, of 12 or more.
RUN = r"[A-Za-z0-9+/_-]{12,}+"

_NAME = r"(?:password|passwd|pwd|secret|token|api_?key|access_?key)"
#: Characters that end a value if nothing of it follows; the first of them also before the name of the next value.
_SPLIT, _TAIL = r",;&?|{(\[", r",;&?|{(\[.)\]}>"
_VALUE = rf"""(?:(?!(?i:{_NAME})["']?\s{{0,8}}[:=])(?:[^\s"'{_TAIL}]|[{_TAIL}](?![{_TAIL}]{{0,8}}+(?:[\s"']|$))(?<![{_SPLIT}](?=["']?[\w-]{{1,64}}["']?\s{{0,2}}[:=]))))++"""
#: Quoted behind a name for secrets (blanks belong to it), behind : or =, or in quotes that open behind no word (but not a name).
VALUE = rf"""(?<=["'])(?<=(?i:{_NAME})["']?\s{{0,8}}[:=]>?\s{{0,8}}["'])[^"'\r\n]++(?=["'])|(?<=[:=>\s"'])(?<=[:=]>?\s{{0,8}}["']?)(?!//){_VALUE}|(?<=["'])(?<!\w.)[^\s"']++(?=["'](?!\s{{0,8}}[:=]))"""
CONTEXT = 24

#: Words before a value that make it a secret, and words that make it something else.
NEAR_SECRET = ["password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "access_key", "auth", "bearer", "credential", "private"]
NEAR_OTHER = ["sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "hash", "uuid", "guid", "version", "isbn", "id", "http", "https", "www"]

FEATURES = ["length", "transitions", "digits", "upper", "lower", "distinct", "coverage", "near_secret", "near_other", "assigned", "quoted", "path_rate"]


def _found(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc, version, source, start, end, value, before): every match of every text, in code points."""
    text = F.coalesce("text", F.lit(""))
    gaps = F.split(text, pattern, -1)
    found = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    parts = F.transform(found, lambda x, i: F.struct(i.alias("i"), F.char_length(x["gap"]).alias("gap"), x["value"].alias("value"), F.right(x["gap"], F.lit(CONTEXT)).alias("before")))
    rows = docs.select("doc", "version", "source", F.explode(parts).alias("m")).select("doc", "version", "source", "m.*").filter(F.col("value").isNotNull())
    upto = Window.partitionBy("doc", "version").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("value")).over(upto)
    rows = rows.dropDuplicates(["doc", "version", "i"]).withColumn("end", end)
    return rows.select("doc", "version", "source", (F.col("end") - F.char_length("value")).alias("start"), "end", "value", "before")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc, version, source, start, end, value, before): runs and values, also runs inside values; one row each, with the longer text before it."""
    both = _found(docs, RUN).unionAll(_found(docs, VALUE))
    before = F.max_by("before", F.struct(F.char_length("before"), "before"))
    return both.groupBy("doc", "version", "start", "end", "value").agg(F.min("source").alias("source"), before.alias("before")).select("doc", "version", "source", "start", "end", "value", "before")


def dictionary(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """(triple): letter triples of the words of 4 to 11 letters that at least `least_docs` documents use."""
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]++"))
    used = docs.select(F.explode(F.filter(words, lambda w: F.char_length(w).between(4, 11))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_docs)
    return used.select(F.explode(ngrams(F.col("word"), 3)).alias("triple")).distinct()


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Add FEATURES to candidates. Equal values are looked up in the dictionary once."""
    value = F.col("value")
    kind = F.translate(F.translate(F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 26), "abcdefghijklmnopqrstuvwxyz", "a" * 26), "0123456789", "0" * 10)
    n = F.char_length(value)
    own = found.select("value").distinct()
    triples = F.when(n < 3, F.array(F.lower(value))).otherwise(ngrams(F.lower(value), 3))
    hits = own.select("value", F.explode(triples).alias("triple")).join(words.withColumn("known", F.lit(1)), "triple", "left").groupBy("value").agg(F.avg(F.coalesce("known", F.lit(0))).alias("coverage"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    word = F.lower(F.regexp_extract("before", r"([A-Za-z_0-9]+)[^A-Za-z_0-9]*$", 1))
    share = lambda p: F.regexp_count(value, F.lit(p)) / n
    return found.join(hits, "value").withColumns(
        {
            "length": n.cast("double"),
            "transitions": (n - F.char_length(F.regexp_replace(kind, r"(.)(?!\1|$)", ""))) / n,
            "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"),
            "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
            "near_secret": flag(word.isin(NEAR_SECRET)), "near_other": flag(word.isin(NEAR_OTHER)),
            "assigned": flag(F.col("before").rlike(r"[:=]>?\s*[\"']?$")), "quoted": flag(F.col("before").rlike(r"[\"']$")),
        }
    )


def known_format(value: Column, before: Column) -> Column:
    """Findings of the fixed rules: cloud key ids, and values assigned to a name for secrets."""
    return value.rlike(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[0-9A-Za-z]{36}$|^xox[abp]-[0-9A-Za-z-]{10,}$") | before.rlike(
        rf"""(?i){_NAME}["']?\s*[:=]>?\s*["']?$"""
    )


def known_false(value: Column, before: Column, coverage: Column) -> Column:
    """Findings labelled as false: uuids, checksums by their name, paths, and words (letters that the dictionary covers)."""
    hexa, uuid = value.rlike(r"(?i)^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{128})$"), value.rlike(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    path = value.rlike(r"^(?:\.{0,2}/)?(?:[a-z0-9_.-]+/)++[a-z0-9_.-]*+$")
    words = value.rlike(r"^[\p{L}_/-]++$") & (coverage >= 0.9)
    return uuid | (hexa & before.rlike(r"(?i)\b(?:sha-?\d*|md5|commit|checksum|digest|hash)[^A-Za-z0-9]*$")) | path | words


def train(labelled: DataFrame, *, most: int = 20_000, trees: int = 20, seed: int = 5) -> RandomForestClassificationModel | None:
    """Fit the forest on labelled findings (FEATURES, label), on at most `most` of either label, by the smallest hash."""
    sides = [labelled.filter(F.col("label") == x).orderBy(F.xxhash64("value", "start"), "doc", "start").limit(most) for x in (0.0, 1.0)]
    rows = written(sides[0].unionAll(sides[1]), "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=6, seed=seed, subsamplingRate=0.8)
    return forest.fit(vectors.transform(rows).select("features", "label"))


def scan(docs: DataFrame, *, least_docs: int = 3, threshold: float = 0.5) -> DataFrame:
    """Secrets: doc_id, start, end (code points), value, rule (a fixed rule found it), score; one row each.

    The fixed rules give the labelled findings to learn from, secret or false; the forest judges all candidates. Null
    and empty texts hold none. A secret inside another one is not reported. If there is nothing to tell apart, the rules' findings are returned with score 1.
    Rows that share a doc_id are told apart by their text; equal rows are reported once. Texts and values of any length are read whole.
    Of findings with equal places the longer one counts; of training rows with equal hashes those of smaller doc and place. Other columns are ignored.
    """
    version = version_of(docs)
    base = docs.select(doc_key().alias("doc"), version.alias("version"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    found = candidates(base).withColumn("rule", known_format(F.col("value"), F.col("before")))
    # the dictionary is a table, so that a frequent triple can be split in the join
    found = written(features(written(found, "candidates"), written(dictionary(docs, least_docs), "dictionary")), "features")
    # how often a path holds findings, smoothed
    path = small_side(found.groupBy("source").agg(((F.sum(F.col("rule").cast("int")) + 1) / (F.count("*") + 100)).alias("path_rate")), "paths")
    shaped = found.join(path, "source")
    label = F.when(F.col("rule"), 1.0).when(known_false(F.col("value"), F.col("before"), F.col("coverage")), 0.0)
    model = train(shaped.withColumn("label", label).filter(F.col("label").isNotNull()))
    if model is None:
        out = shaped.filter("rule").withColumn("score", F.lit(1.0))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
        out = model.transform(vectors.transform(shaped)).withColumn("score", vector_to_array("probability")[1]).filter(F.col("score") >= threshold)
    earlier = Window.partitionBy("doc", "version").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("reach", F.max("end").over(earlier)).filter(F.col("reach").isNull() | (F.col("reach") < F.col("end")))
    ids = docs.select("doc_id", doc_key().alias("doc")).distinct()
    return out.join(ids, "doc").select("doc_id", "start", "end", "value", "rule", "score")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents; see scan() for odd rows."""
    return scan(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
