"""Manifest, licence scan and filter audit against brute force, on a small table with every awkward case."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import filter_audit, license_scan, merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, tree string, pos string, part string, mask string, n_words string, labels string"
EXTRA = ("x",) * 7
LICENSE_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def rows():
    texts = ["one", "", None, "é 中文", "a\nb", "x" * 50_000, "One One One One " * 20, "A B C $ 5", "one", "The quick brown fox " * 30, " \t", "word " * 60, "one"]
    out = [(i * 5 - 10, t, [None, "en", "de", "z"][min(i % 5, 3)], [None, "s", "", "t"][i % 4], None if i % 3 == 0 else i) for i, t in enumerate(texts * 4)]
    out += [(900 + i, f"{'Word ' * (i % 70)}{i % 9}", "en", "s", i) for i in range(150)]
    # a repeated row, an id with two texts, null ids
    out += [out[4], (out[7][0], "one", "en", "s", 3), (None, "one", None, None, 3), (None, "only here", None, "t", 3), (None, "only here", "en", "t", None)]
    return [r + EXTRA for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def stored(docs, path):
    docs.write.mode("overwrite").parquet(str(path / "documents.parquet"))
    return str(path)


# ---- manifest ----------------------------------------------------------------------------------------------------------


def levels_of(leaves, arity=2):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def siblings_and_fold(levels, at, shown, arity=2):
    sibs = []
    for level in levels[:-1]:
        start = at // arity * arity
        run = level[start : start + arity]
        sibs += run[: at - start] + run[at - start + 1 :]
        shown = sha("".join(run[: at - start] + [shown] + run[at - start + 1 :]))
        at //= arity
    return "".join(sibs), shown


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def slow_manifest(table, arity=2):
    trees = defaultdict(list)
    for d, text, lang, source, n, *_ in table:
        leaf = sha("".join(map(field, (d, source, lang, n, text))))
        hit = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
        shown = sha("".join(map(field, (d, source, lang, n + 1, text)))) if hit else leaf
        trees[lang].append(((d is not None, d or 0, leaf), d, leaf, shown))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: levels_of([leaf for _, _, leaf, _ in sorted(trees[x])], arity) for x in names}
    top = levels_of([built[x][-1][0] for x in names], arity)
    out = []
    for k, x in enumerate(names):
        for at, (_, d, leaf, shown) in enumerate(sorted(trees[x])):
            low, folded = siblings_and_fold(built[x], at, shown, arity)
            high, folded = siblings_and_fold(top, k, folded, arity)
            out.append((d, leaf, built[x][-1][0], top[-1][0], sha(low + high), folded, folded == top[-1][0]))
    return out


def test_manifest_against_brute_force(spark, docs, tmp_path):
    got = [tuple(r) for r in merkle_manifest.op11_merkle_manifest(spark, stored(docs, tmp_path)).collect()]
    want = slow_manifest(rows())
    assert Counter(got) == Counter(want)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


@pytest.mark.parametrize("arity,height", [(2, 2), (3, 1), (4, 2)])
def test_blocks_and_runs_of_other_sizes(spark, docs, arity, height):
    leaves = docs.withColumn("leaf", merkle_manifest.leaf_hash(*(F.col(c) for c in merkle_manifest.FIELDS)))
    out = merkle_manifest.manifest(leaves, arity=arity, height=height)
    assert out.select("row.row", "row.tree", "row.pos").distinct().count() == 1  # columns under the names used inside
    got = [tuple(r) for r in out.select("row.doc_id", "row.leaf", "subroot", "root", F.sha2(merkle_manifest.proof(F.col("path")), 256), merkle_manifest.fold(F.col("path"), F.col("row.leaf"))).collect()]
    assert Counter(got) == Counter((*r[:5], r[3]) for r in slow_manifest(rows(), arity))


def test_manifest_of_one_row_and_of_none(spark, docs, tmp_path):
    one = docs.filter("doc_id = 900").drop(*SCHEMA.split(", ")[5:])
    r = merkle_manifest.op11_merkle_manifest(spark, stored(one.limit(1), tmp_path / "one")).collect()[0]
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == sha("") and r["verified"] == (zlib.crc32(b"900") % 7 != 0)
    assert merkle_manifest.op11_merkle_manifest(spark, stored(docs.limit(0), tmp_path / "none")).collect() == []


def test_a_tree_for_every_row(spark):
    """As many trees as rows: the subroots themselves fill many blocks."""
    leaves = spark.range(600).select(F.col("id").alias("doc_id"), F.format_string("%04d", "id").alias("lang"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    out = merkle_manifest.manifest(leaves, height=3).select("row.leaf", "subroot", "root", merkle_manifest.fold(F.col("path"), F.col("row.leaf")).alias("folded")).collect()
    root = levels_of([sha(str(i)) for i in range(600)])[-1][0]
    assert len(out) == 600 and all(r["leaf"] == r["subroot"] and r["root"] == r["folded"] == root for r in out)


# ---- licences ----------------------------------------------------------------------------------------------------------


def slow_base(text):
    words = LICENSE_WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for i in range(len(words)) for p, label in license_scan.BASE_PHRASES.items() if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({label for _, label in at}))


NOTICE_TEXTS = [
    None, "", "no words about it", "Released under the MIT License.", "UNDER the mit-license under the MIT licenses", "cc by nc by cc by nc cc by nc", "CC-BY-NC 4.0, Apache License, Version 2.0",
    "under the mit license under the mit license", "é under the mit license中", "É under the mit license", "apache license version 2" + " w" * 5000 + " cc by nc", "under the\nmit\tlicense", "under the mit  license version 2 apache license version 2",
    "This work is licensed under the GNU General Public License, version 3.",
]


def test_license_base_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(NOTICE_TEXTS + NOTICE_TEXTS[3:4])], "doc_id long, text string, n_words string, labels string, `odd name` string")
    out = license_scan.scan_licenses(docs)
    assert "odd name" in out.columns and out.columns.count("labels") == 1
    got = out.collect()
    assert len(got) == len(NOTICE_TEXTS) + 1
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == slow_base(r["text"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
    by_text = {r["text"]: r for r in got}
    assert by_text[NOTICE_TEXTS[-1]]["labels"] == "gpl,gpl-3" and by_text[NOTICE_TEXTS[-1]]["n_base"] == 0
    assert license_scan.scan_licenses(docs.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("under the mit license apache version 2 cc by nc \n é -".split(" ")), max_size=40))
def test_license_places_of_any_words(words):
    text = " ".join(words)
    scanner = license_scan.Scanner(license_scan.BASE_PHRASES, license_scan.NOTICES, license_scan.TAGS)
    assert scanner.scan(text)[:5] == slow_base(text)


@pytest.mark.parametrize(
    "text,tokens,labels,restriction",
    [
        ("MIT", "MIT", {"mit"}, 0), ("MIT. It is", "MIT", {"mit"}, 0), ("MIT OR GPL-2.0-only", "MIT OR GPL-2.0-only", {"mit", "gpl-2"}, 0), ("mit and gpl-3.0+", "mit AND gpl-3.0+", {"mit", "gpl-3"}, 2),
        ("MIT OR GPL-2.0 AND CC-BY-NC-4.0", "MIT OR GPL-2.0 AND CC-BY-NC-4.0", {"mit", "gpl-2", "cc-by-nc"}, 0), ("(MIT OR GPL-2.0) AND CC-BY-NC-4.0", "( MIT OR GPL-2.0 ) AND CC-BY-NC-4.0", {"mit", "gpl-2", "cc-by-nc"}, 3),
        ("GPL-2.0-only WITH Classpath-exception-2.0 AND MIT", "GPL-2.0-only WITH Classpath-exception-2.0 AND MIT", {"gpl-2", "mit"}, 1), ("see the file", "see", set(), 4), ("MIT AND", "MIT", {"mit"}, 0), ("(MIT OR", "", None, None),
        ("((MIT))) OR ISC", "( ( MIT ) )", {"mit"}, 0), (") MIT", "", None, None), ("MIT\nOR ISC", "MIT", {"mit"}, 0), ("MIT OR OR ISC", "MIT", {"mit"}, 0), ("", "", None, None), ("(" * 3000 + "MIT" + ")" * 3000, None, {"mit"}, 0),
        (" OR ".join(["GPL-3.0"] * 5000 + ["ISC"]), None, {"gpl-3", "isc"}, 0), ("mitten", "mitten", set(), 4),
    ],
)
def test_expressions(text, tokens, labels, restriction):
    found = license_scan.expression_at(text)
    assert tokens is None or found == tokens.split()
    value = license_scan.evaluate(found)
    assert (value is None) if labels is None else (value.labels == labels and value.restriction == restriction)


def random_tree():
    leaf = st.sampled_from(["MIT", "GPL-2.0", "LGPL-2.1", "CC-BY-NC-4.0", "Odd-1.0"])
    return st.recursive(leaf, lambda x: st.tuples(st.sampled_from(["OR", "AND"]), x, x), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(random_tree())
def test_expressions_against_trees(tree):
    def text(t):
        return t if isinstance(t, str) else f"({text(t[1])} {t[0]} {text(t[2])})"

    def worth(t):
        if isinstance(t, str):
            return license_scan.RESTRICTION.get(license_scan.label_of(t), license_scan.UNKNOWN)
        return (min if t[0] == "OR" else max)(worth(t[1]), worth(t[2]))

    assert license_scan.evaluate(license_scan.expression_at(text(tree))).restriction == worth(tree)


def test_tags_add_labels(spark):
    texts = ["// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", "sublicense: MIT", "License: Apache-2.0.\nLICENCE: isc", "license: see below", "license: license: mit"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["expressions"], r["n_base"]) for r in license_scan.scan_licenses(docs).collect()}
    assert got == {0: ("apache-2,bsd-3,mit", ["(MIT OR Apache-2.0) AND BSD-3-Clause"], 0), 1: ("", [], 0), 2: ("apache-2,isc", ["Apache-2.0", "isc"], 0), 3: ("", [], 0), 4: ("mit", ["mit"], 0)}


# ---- filter audit ------------------------------------------------------------------------------------------------------


def slow_audit(docs, labels):
    """Each order applied to each document."""
    far = 1 << 63
    first = {}
    for d, t in docs_of(docs):
        first[t] = min(first.get(t, far), far - 1 if d is None else d)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    table = []
    for r in docs:
        d, t = r[0], r[1] or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": (far - 1 if d is None else d) > first[t]}
        table.append((r[3] or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = []
    for part in {r[0] for r in table}:
        mine = [r for r in table if r[0] == part]
        cells = {}
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, x in enumerate(order):
                gone, kept = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                cells[order, k] = [x, len(kept), len(gone), sum(x in r[1] for r in mine) - len(gone), sum(r[1] == {x} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                left = kept
        shapley = Counter()
        for v in cells.values():
            shapley[v[0]] += v[2]
        out += [(part, order, k + 1, *v[1:], shapley[v[0]]) for (order, k), v in cells.items()]
    return out


def docs_of(docs):
    return [(r[0], r[1] or "") for r in docs]


def test_filter_audit_against_brute_force(spark, docs):
    labels = [(i * 5 - 10, i % 2, int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1), (0, 1, 0), (900, None, 1), (77777, 1, 1)]
    got = filter_audit.audit_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert Counter(map(tuple, got.collect())) == Counter(slow_audit(rows(), labels))


def test_filter_audit_without_rows(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_documents(docs.limit(0), labels).collect() == []
    alone = filter_audit.audit_documents(docs.limit(3), labels)
    assert alone.agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[0:2] == (0, 0)


def test_other_filters_and_their_number(spark):
    rows = spark.range(100).select("id", (F.col("id") % 3 == 0).alias("x"), (F.col("id") % 5 == 0).alias("y"))
    counts = filter_audit.mask_counts(rows, {"x": F.col("x"), "y": F.col("y")}, F.lit(None), {"n": F.lit(1)})
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in filter_audit.orders(filter_audit.survivors(counts, 2, ["n"]), "xy", []).collect()}
    assert got == {("xy", 1): (66, 34, 0, 27, 61), ("xy", 2): (53, 13, 7, 13, 33), ("yx", 1): (80, 20, 0, 13, 33), ("yx", 2): (53, 27, 7, 27, 61)}
    with pytest.raises(ValueError):
        filter_audit.orders(filter_audit.survivors(counts, 2, ["n"]), "abcdefgh", [])
