"""Text primitives as column expressions; all are linear in the text and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: All characters that count as blank at the ends of a text.
WHITESPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def spread(docs: DataFrame) -> DataFrame:
    """Deal the rows out anew if they are too few bytes for a partition a core, as a small file is; larger inputs stay as they are. Sizes are those of the plan: nothing is run to know them."""
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return docs.repartition(cores) if size < cores * most else docs


def settled(df: DataFrame) -> DataFrame:
    """The same rows, with all columns computed where they are.

    Filters and explodes of a computed column are moved below the columns that it is made of, with each replaced by its
    expression; over some layers of arrays such an expression grows without bounds. Nothing is moved below a generator.
    """
    return df.select(F.explode_outer(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))).alias("row")).select("row.*")


def sentences(text: Column) -> Column:
    parts = F.split(F.trim(text), r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")  # not F.trim itself: it would get the place as the characters to trim


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9_'-]*"), F.lit(0))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), lambda s: F.trim(s)), lambda s: s != "")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rounded(x: Column, digits: int) -> Column:
    """Half up; what is within 1e-9 of a tie goes up, so that neither the engine nor the order of a sum matters."""
    return F.floor(x * 10**digits + (0.5 + 1e-9)) / 10**digits


def present(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases the text holds."""
    return sum((text.contains(p).cast("int") for p in phrases), F.lit(0))


def any_match(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def all_matches(text: Column, patterns: list[str]) -> Column:
    return sum((F.regexp_count(text, F.lit(p)) for p in patterns), F.lit(0))


def ngrams(text: Column, n: int) -> Column:
    """Every n characters that follow each other, in one pass over the text."""
    first = F.regexp_extract_all(text, F.lit(f"(?s)(.)(?=.{{{n - 1}}})"), F.lit(1))
    rest = F.regexp_extract_all(text, F.lit(f"(?s).(?=(.{{{n - 1}}}))"), F.lit(1))
    return F.zip_with(first, rest, lambda a, b: F.concat(a, b))


def trigrams(text: Column) -> Column:
    return ngrams(F.lower(text), 3)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Share of a's words (over three letters) that b has too; 0 if either has none."""
    wa, wb = (F.array_distinct(F.filter(tokens(x), lambda w: F.char_length(w) > 3)) for x in (a, b))
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).otherwise(F.size(F.array_intersect(wa, wb)) / F.size(wa))


def html_text(html: Column, most: int | None = None) -> Column:
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style[^>]*>.*?</style>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " "))
    return text if most is None else F.substring(text, 1, most)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def match_spans(text: Column, pattern: str) -> Column:
    """(start, end, match) of every match of the pattern, in characters from 0."""
    gaps = F.split(text, pattern, -1)
    found = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    kind = "struct<end:int,spans:array<struct<start:int,end:int,match:string>>>"
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("spans")).cast(kind)

    def step(a: Column, x: Column) -> Column:
        at = a["end"] + F.char_length(x["gap"])
        end = at + F.char_length(x["match"])
        return F.struct(end.alias("end"), F.concat(a["spans"], F.array(F.struct(at.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("spans")).cast(kind)

    return F.aggregate(F.filter(found, lambda x: x["match"].isNotNull()), start, step, lambda a: a["spans"])


def tiles(text: Column, size: int) -> Column:
    """The text in pieces of `size` characters, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
