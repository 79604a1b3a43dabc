"""Text out of feeds, pages and files, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import strip

#: Kinds of writing that a text names, in the order in which they are looked for.
NAMED_DOMAINS = [("pull request", "code_review"), ("documentation", "docs"), ("resume", "hiring"), ("abstract", "academia"), ("review", "marketplace")]


def atom_entries(feeds: DataFrame, keys: list[str], least: int = 50, most: int = 800) -> DataFrame:
    """(keys, pos, title, summary, link) of Atom feeds (keys, xml): titles but the feed's own, summaries and ids in turn; summaries of `least` characters and more, cut to `most`."""
    part = lambda tag: F.transform(F.regexp_extract_all("xml", F.lit(f"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1)), lambda x: strip(F.regexp_replace(x, r"\s+", " ")))
    titles, links = (F.slice(part(t), 2, 1_000_000) for t in ("title", "id"))
    rows = feeds.select(*keys, F.posexplode(F.arrays_zip(titles.alias("title"), part("summary").alias("summary"), links.alias("link"))).alias("pos", "x"))
    return rows.select(*keys, "pos", "x.title", F.left("x.summary", F.lit(most)).alias("summary"), "x.link").filter(F.char_length("summary") >= least)


def article_entries(feeds: DataFrame, keys: list[str], least: int = 50, most: int = 800) -> DataFrame:
    """(keys, pos, title, abstract) of article XML (keys, xml): titles and abstracts in turn, without tags."""
    part = lambda tag: F.transform(F.regexp_extract_all("xml", F.lit(f"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1)), lambda x: strip(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", ""), r"\s+", " ")))
    rows = feeds.select(*keys, F.posexplode(F.arrays_zip(part("ArticleTitle").alias("title"), part("AbstractText").alias("abstract"))).alias("pos", "x"))
    return rows.select(*keys, "pos", "x.title", F.left("x.abstract", F.lit(most)).alias("abstract")).filter(F.char_length("abstract") >= least)


def readme_sections(readmes: DataFrame, keys: list[str], least: int = 80, most: int = 800) -> DataFrame:
    """(keys, pos, text) of base64 READMEs (keys, content): the parts under headings of levels 1 to 3, without what stands before the first one."""
    text = F.decode(F.unbase64(F.regexp_replace("content", r"\s", "")), "UTF-8")
    parts = F.split(text, "\\n#{1,3}\\s+")
    rows = readmes.select(*keys, F.posexplode(F.transform(F.slice(parts, 2, 1_000_000), strip)).alias("pos", "text"))
    return rows.filter(F.char_length("text").between(least, most))


def batch_items(batches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, text, domain) of texts parted by lines of three dashes: trimmed, empty ones dropped; the domain by what the text names."""
    items = F.filter(F.transform(F.split("text", "---"), strip), lambda x: x != "")
    domain = F.lit("general")
    for word, kind in reversed(NAMED_DOMAINS):
        domain = F.when(F.lower("item").contains(word), kind).otherwise(domain)
    return batches.select(*keys, F.posexplode(items).alias("pos", "item")).select(*keys, "pos", F.col("item").alias("text"), domain.alias("domain"))


def citation_ids(text: Column) -> Column:
    """(doi, pmid, title) of a citation, each null where there is none: a PMID may be a bare number of 7 to 9 digits unless a DOI is named; a title is quoted, or a run of capitalised text."""
    pick = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    pmid = F.coalesce(pick(r"(?i)PMID[:\s]*(\d{5,9})"), F.when(~F.lower(text).contains("doi"), pick(r"(?U)\b(\d{7,9})\b")))
    title = F.coalesce(pick(r'"([^"]{10,})"'), strip(pick(r"([A-Z][A-Za-z\s,':\-]{20,80})")))
    return F.struct(pick(r"(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)").alias("doi"), pmid.alias("pmid"), title.alias("title"))
