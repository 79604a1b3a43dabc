"""Personal data by weak supervision (operator 10), DataFrame operations only.

Base kinds (e-mail, IP, card, phone) come from fixed patterns with validation. Further candidates, such as
phone numbers without a plus sign or spelled-out e-mail addresses, come from wide patterns. On every candidate,
regex, gazetteer and context labelers vote personal, not personal, or abstain; base spans are candidates as well, so that
the labelers meet all kinds. Expectation-maximisation over the counts of vote patterns (3 to the number of
labelers at most, however many documents) estimates how reliable each labeler is. Its posteriors are the soft
labels of a logistic regression on the span's own shape and context, which decides the candidates.

A match's place comes from the lengths of the text between the matches of its pattern, summed over the
document by a window; texts stay where they are, only matches are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import doc_key, read_table, version_of, written

# Fixed patterns of the base kinds. Runs are possessive and start where they can start first, so that
# matching is linear in a text and needs no stack; they find the same spans as the plain patterns.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
KINDS = list(BASE)

#: Wide patterns of further candidates.
EXTRA = {
    "other_phone": (r"(?<![0-9A-Za-z+.(-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])", None),
    "other_email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z]{2,24}(?![A-Za-z])", None),
    "other_id": (r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", None),
}

#: Gazetteers of words beside personal data, and of words beside numbers that are none.
NEAR_PERSONAL = ["phone", "tel", "telephone", "call", "mobile", "cell", "fax", "email", "mail", "contact", "ssn", "social", "card", "visa", "address", "ip", "telefon", "anruf", "tél", "teléfono", "correo", "courriel"]
NEAR_OTHER = ["version", "isbn", "issn", "license", "section", "page", "figure", "table", "chapter", "no", "order", "invoice", "part", "ticket", "build", "release"]

CONTEXT = 24


def luhn(digits: Column) -> Column:
    """True if the decimal digits, at most 19, pass the Luhn check."""
    turned = F.reverse(digits)
    one = lambda i: F.ascii(F.substr(turned, i, F.lit(1))) - 48
    doubled = lambda i: F.when(one(i) > 4, 2 * one(i) - 9).otherwise(2 * one(i))
    total = F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(i)).otherwise(one(i)))
    return total % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, r"[^0-9]", "")
    small = lambda x: (F.char_length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.concat(F.lit("0"), F.right(x, F.lit(3))), F.lit("9999")).cast("int"), F.lit(0)) <= 255)
    count = F.char_length(digits)
    return (
        F.when(kind == "ip", F.forall(F.split(match, r"\."), small))
        .when(kind == "card", count.between(13, 19) & F.when(count.between(13, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", count.between(9, 15))
        .otherwise(True)
    )


def matches(docs: DataFrame, patterns: dict[str, tuple[str, str | None]]) -> DataFrame:
    """(doc, version, kind, start, end, match, before, after): leftmost matches of each pattern, in code points."""
    text = F.coalesce("text", F.lit(""))

    def of(kind: str) -> Column:
        pattern, needs = patterns[kind]
        gaps = F.split(text, pattern, -1)
        found = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
        tail = F.transform(found, lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.char_length(x["gap"]).alias("gap"), x["match"].alias("match"),
            F.right(x["gap"], F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after")))
        there = text.contains(needs) if needs else text.rlike("[0-9@(\\[]")
        return F.when(there & (F.size(gaps) > 1), tail).otherwise(F.array().cast(KIND_TYPE))

    rows = docs.select("doc", "version", F.explode(F.concat(*(of(k) for k in patterns))).alias("m")).select("doc", "version", "m.*")
    rows = rows.filter(F.col("match").isNotNull()).dropDuplicates(["doc", "version", "kind", "i"])
    upto = Window.partitionBy("doc", "version", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("match")).over(upto)
    return rows.withColumn("end", end).select("doc", "version", "kind", (F.col("end") - F.char_length("match")).alias("start"), "end", "match", "before", "after")


KIND_TYPE = "array<struct<kind:string,i:int,gap:int,match:string,before:string,after:string>>"


def votes(spans: DataFrame) -> DataFrame:
    """Add v0.. : 1 personal, 0 not, -1 abstain."""
    word = F.lower(F.regexp_extract("before", r"(\p{L}+)\P{L}*$", 1))
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.char_length(digits)
    vote = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(-1)
    never = F.lit(False)
    labelers = [
        # regex: the shape of the match
        vote(F.col("match").rlike(r"@[^@]+\.[A-Za-z]{2,}$|^\+|^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), (F.col("match").rlike(r"^[0-9.]+$") & (n < 7)) | F.col("match").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$")),
        vote(n.between(9, 16) | F.col("match").contains("@"), (n < 7) & ~F.col("match").rlike("[@.]")),
        vote(never, F.col("match").rlike(r"^([0-9])(?:[^0-9]*+\1)*+[^0-9]*+$") | (digits == "") & ~F.col("match").rlike(r"@|\[|\(")),
        # gazetteers: the word before
        vote(word.isin(NEAR_PERSONAL), word.isin(NEAR_OTHER)),
        # context: what touches the match
        vote(F.col("before").rlike(r"[:=]\s*$") & ~word.isin(NEAR_OTHER), F.col("before").rlike(r"[\w/$#.]$") | F.col("after").rlike(r"^[\w/%]")),
        vote(F.col("before").rlike(r"(^|\s)$") & F.col("after").rlike(r"^([\s.,;)]|$)"), F.col("before").rlike(r"[A-Za-z]$")),
    ]
    return spans.withColumns({f"v{i}": v for i, v in enumerate(labelers)})


def reliabilities(patterns: Sequence[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[tuple[float, float]]]:
    """EM for the two-class labeler model: (share of personal spans, [(p(1 | personal), p(1 | not)) of each labeler]).

    patterns: (votes, how often). Votes of -1 tell nothing. Starts from labelers that are right in 8 of 10 cases.
    """
    width = len(patterns[0][0]) if patterns else 0
    share, rates = 0.5, [(0.8, 0.2)] * width
    for _ in range(rounds):
        yes = [[1.0, 2.0, 1.0, 2.0] for _ in range(width)]  # votes and their sum for either class, smoothed
        for i in range(width):
            yes[i] = [1.6, 2.0, 0.4, 2.0]
        total = personal = 0.0
        for vote, n in patterns:
            q = posterior(vote, share, rates)
            total, personal = total + n, personal + n * q
            for i, v in enumerate(vote):
                if v >= 0:
                    yes[i] = [yes[i][0] + n * q * v, yes[i][1] + n * q, yes[i][2] + n * (1 - q) * v, yes[i][3] + n * (1 - q)]
        share = (personal + 1) / (total + 2)
        rates = [(a / b, c / d) for a, b, c, d in yes]
    return share, rates


def posterior(vote: Sequence[int], share: float, rates: Sequence[tuple[float, float]]) -> float:
    odds = math.log(share / (1 - share))
    for v, (a, b) in zip(vote, rates):
        odds += math.log(a / b) if v == 1 else math.log((1 - a) / (1 - b)) if v == 0 else 0.0
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


FEATURES = ["f_digits", "f_length", "f_at", "f_plus", "f_groups", "f_near", "f_other", "f_colon", "f_blank", "f_tight"]


def features(spans: DataFrame) -> DataFrame:
    word = F.lower(F.regexp_extract("before", r"(\p{L}+)\P{L}*$", 1))
    flag = lambda c: c.cast("double")
    return spans.withColumns(
        {
            "f_digits": F.regexp_count("match", F.lit("[0-9]")) / F.char_length("match"),
            "f_length": F.least(F.char_length("match"), F.lit(40)) / 40,
            "f_at": flag(F.col("match").rlike(r"@|\bat\b")),
            "f_plus": flag(F.col("match").startswith("+")),
            "f_groups": F.least(F.regexp_count("match", F.lit("[0-9]++")), F.lit(6)) / 6,
            "f_near": flag(word.isin(NEAR_PERSONAL)),
            "f_other": flag(word.isin(NEAR_OTHER)),
            "f_colon": flag(F.col("before").rlike(r"[:=]\s*$")),
            "f_blank": flag(F.col("before").rlike(r"(^|\s)$")),
            "f_tight": flag(F.col("after").rlike(r"^[\w/%]")),
        }
    )


def classify(candidates: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Candidates (of all kinds) that the final classifier takes for personal data, with `probability`."""
    voted = votes(candidates)
    names = [c for c in voted.columns if c[0] == "v" and c[1:].isdigit()]
    # at most 3 ** len(names) rows
    counts = [(tuple(r[c] for c in names), r["n"]) for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    spark = candidates.sparkSession
    if not counts:
        return candidates.withColumn("probability", F.lit(None).cast("double"))
    share, rates = reliabilities(sorted(counts))
    soft = spark.createDataFrame([(*v, posterior(v, share, rates)) for v, _ in counts], ", ".join(f"{c} int" for c in names) + ", q double")
    shaped = features(voted).join(F.broadcast(soft), names)
    # equal feature rows are one weighted training row for either class
    rows = shaped.groupBy(*FEATURES).agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no"))
    rows = rows.select(*FEATURES, F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("yes").alias("weight")), F.struct(F.lit(0.0).alias("label"), F.col("no").alias("weight")))).alias("x"))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    model = LogisticRegression(weightCol="weight", regParam=0.01, maxIter=30).fit(vectors.transform(rows.select(*FEATURES, "x.*")))
    scored = model.transform(vectors.transform(shaped))
    return scored.select(*candidates.columns, vector_to_array("probability")[1].alias("probability")).filter(F.col("probability") >= threshold)


def find_pii(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; one row per row of docs.

    spans: kind:start:end of all spans, kinds as listed, then by start; base_sha256: of the base spans alone. A null
    or empty text has none. A span of a further kind that overlaps a base span is not added. Rows that share
    a doc_id are told apart by their text.
    """
    version = version_of(docs)
    base = docs.select(doc_key().alias("doc"), version.alias("version"), "text")
    found = written(matches(base, BASE | EXTRA), "matches")
    fixed = found.filter(F.col("kind").isin(KINDS)).filter(valid(F.col("kind"), F.col("match")))
    extra = found.filter(~F.col("kind").isin(KINDS))
    candidates = written(fixed.withColumn("base", F.lit(True)).unionByName(extra.withColumn("base", F.lit(False))), "candidates")
    added = classify(candidates, threshold).filter(~F.col("base")).select("doc", "version", "kind", "start", "end")
    added = _apart(added, candidates.filter("base"))
    order = F.create_map(*(x for i, k in enumerate([*KINDS, *EXTRA]) for x in (F.lit(k), F.lit(i))))
    name = F.concat_ws(":", "kind", "start", "end")
    every = candidates.filter("base").select("doc", "version", "kind", "start", "end").unionByName(added).withColumn("k", order[F.col("kind")]).withColumn("name", name)
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["name"]), ",")
    row = F.struct("k", "start", "end", "name")
    per_doc = every.groupBy("doc", "version").agg(
        *(F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in KINDS),
        listed(F.when(F.col("k") < len(KINDS), row)).alias("base"),
        listed(row).alias("spans"),
    )
    keyed = docs.select("doc_id", doc_key().alias("doc"), version.alias("version"))
    out = keyed.join(per_doc, ["doc", "version"], "left")
    return out.select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def _apart(added: DataFrame, base: DataFrame) -> DataFrame:
    """Added spans that overlap no base span: one sweep over the spans of a document, by start."""
    rows = base.select("doc", "version", "kind", "start", "end", F.lit(True).alias("base")).unionByName(added.withColumn("base", F.lit(False)))
    by = Window.partitionBy("doc", "version").orderBy("start", F.desc("base"))
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    coming = F.min(F.when(F.col("base"), F.col("start"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumns({"reach": reach, "coming": coming})
    return rows.filter(~F.col("base") & (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("coming").isNull() | (F.col("coming") >= F.col("end")))).select("doc", "version", "kind", "start", "end")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of all documents; see find_pii() for odd rows."""
    return find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
