"""License scans (operator 12): an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser evaluates licence expressions.

Two automata run over each document in one Arrow pass: one over its words, lower-cased and joined by one blank, for
notice phrases; one over its text, for tags such as `SPDX-License-Identifier:`. What follows a tag is read as an
expression: operands, `and`, `or`, `with` and brackets, by two stacks and without recursion, to the first token that
cannot follow. Nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import read_table
from textloom.llm.decontaminate import words_of

#: The phrases whose places are counted.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Words of further notices: (phrase, label, how sure the label is).
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 0.95),
    ("released under mit", "mit", 0.8),
    ("mit licensed", "mit", 0.8),
    ("licensed under the apache license", "apache", 0.9),
    ("apache software license", "apache", 0.8),
    ("redistribution and use in source and binary forms", "bsd", 0.95),
    ("bsd 3 clause", "bsd-3", 0.9),
    ("bsd 2 clause", "bsd-2", 0.9),
    ("under the bsd license", "bsd", 0.9),
    ("gnu general public license", "gpl", 0.9),
    ("gnu general public license version 2", "gpl-2", 0.95),
    ("gnu general public license version 3", "gpl-3", 0.95),
    ("gnu lesser general public license", "lgpl", 0.95),
    ("gnu affero general public license", "agpl", 0.95),
    ("mozilla public license", "mpl", 0.9),
    ("eclipse public license", "epl", 0.9),
    ("creative commons attribution noncommercial", "cc-by-nc", 0.95),
    ("creative commons attribution sharealike", "cc-by-sa", 0.95),
    ("creative commons attribution noderivatives", "cc-by-nd", 0.95),
    ("cc by sa", "cc-by-sa", 0.9),
    ("cc by nd", "cc-by-nd", 0.9),
    ("cc by 4 0", "cc-by", 0.9),
    ("cc0 1 0", "cc0", 0.9),
    ("released into the public domain", "public-domain", 0.9),
    ("all rights reserved", "reserved", 0.6),
]

#: What stands before an identifier or an expression, in lower case.
TAGS = ["spdx-license-identifier:", "license:", "licence:", "license-expression:", "license ="]

#: Identifiers by how they begin, the longest that fits: (beginning, label).
IDENTIFIERS = [
    ("mit", "mit"), ("apache-2", "apache-2"), ("apache", "apache"), ("bsd-2", "bsd-2"), ("bsd-3", "bsd-3"), ("bsd", "bsd"), ("isc", "isc"), ("zlib", "zlib"), ("unlicense", "public-domain"),
    ("gpl-2", "gpl-2"), ("gpl-3", "gpl-3"), ("gpl", "gpl"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("mpl", "mpl"), ("epl", "epl"), ("cc0", "cc0"), ("cc-by-nc", "cc-by-nc"), ("cc-by-nd", "cc-by-nd"),
    ("cc-by-sa", "cc-by-sa"), ("cc-by", "cc-by"), ("proprietary", "reserved"),
]

#: How far a licence restricts use: 0 hardly, 1 its own files, 2 whole works, 3 no commerce or no changes, 4 not at all free or not known.
RESTRICTION = {
    "mit": 0, "apache": 0, "apache-2": 0, "bsd": 0, "bsd-2": 0, "bsd-3": 0, "isc": 0, "zlib": 0, "public-domain": 0, "cc0": 0, "cc-by": 0,
    "lgpl": 1, "mpl": 1, "epl": 1, "gpl": 2, "gpl-2": 2, "gpl-3": 2, "agpl": 2, "cc-by-sa": 2, "cc-by-nc": 3, "cc-by-nd": 3, "reserved": 4,
}
UNKNOWN = 4
TAG_SURE = 0.99
BASE_SURE = 0.95

_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+\-]*)")
#: Operators by how early they bind.
_BEFORE = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str | None:
    """The label of an identifier such as `GPL-2.0-only`, or null; a number or a hyphen may follow a beginning, a letter may not."""
    low = identifier.lower()
    fits = [(len(start), label) for start, label in IDENTIFIERS if low.startswith(start) and not low[len(start) : len(start) + 1].isalpha()]
    return max(fits)[1] if fits else None


@dataclass(frozen=True)
class Value:
    """What an expression says: its labels, and how far it restricts."""

    labels: frozenset[str]
    restriction: int


def _operand(identifier: str) -> Value:
    label = label_of(identifier)
    return Value(frozenset([label] if label else []), RESTRICTION.get(label, UNKNOWN))


def _apply(op: str, a: Value, b: Value) -> Value:
    """Of alternatives the freer one may be chosen; terms that hold together restrict as the stricter one; an exception takes a whole-work licence down to its own files."""
    if op == "with":
        return Value(a.labels, 1 if a.restriction == 2 else a.restriction)
    return Value(a.labels | b.labels, min(a.restriction, b.restriction) if op == "or" else max(a.restriction, b.restriction))


def expression_at(text: str, start: int = 0) -> list[str]:
    """The tokens of the longest whole expression that begins at that place of a line; none if none does.

    Reading ends at the first token that cannot follow; a full stop that ends a sentence does not belong to an identifier.
    """
    tokens: list[str] = []
    whole, depth, wants_operand, at = 0, 0, True, start
    while m := _TOKEN.match(text, at):
        token, at = m.group(1), m.end()
        stop = False
        if token == "(":
            if not wants_operand:
                break
            depth += 1
        elif token == ")":
            if wants_operand or not depth:
                break
            depth -= 1
        elif token.lower() in _BEFORE:
            if wants_operand:
                break
            token, wants_operand = token.upper(), True
        else:
            if not wants_operand:
                break
            stop, token, wants_operand = token.endswith("."), token.rstrip(".-"), False
        tokens.append(token)
        if not depth and not wants_operand:
            whole = len(tokens)
        if stop:
            break
    return tokens[:whole]


def evaluate(tokens: list[str]) -> Value | None:
    """The value of a whole expression, by a stack of values and one of operators: `with` binds before `and`, that before `or`; equal ones from the left."""
    values: list[Value] = []
    ops: list[str] = []

    def settle(level: int) -> None:
        while ops and ops[-1] != "(" and _BEFORE[ops[-1]] >= level:
            b, a = values.pop(), values.pop()
            values.append(_apply(ops.pop(), a, b))

    for token in tokens:
        word = token.lower()
        if token == "(":
            ops.append(token)
        elif token == ")":
            settle(0)
            ops.pop()
        elif word in _BEFORE:
            settle(_BEFORE[word])
            ops.append(word)
        else:
            values.append(_operand(token))
    settle(0)
    return values[0] if values else None


class Scanner:
    """The two automata; made once a task."""

    def __init__(self, phrases: dict[str, str], notices: list[tuple[str, str, float]], tags: list[str]):
        import ahocorasick

        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        # blanks at both ends, so that whole words match; phrases may overlap by such a blank
        known: dict[str, list[tuple[str, float, bool]]] = {}
        for p, label in phrases.items():
            known.setdefault(p, []).append((label, BASE_SURE, True))
        for p, label, sure in notices:
            known.setdefault(p, []).append((label, sure, False))
        for p, found in known.items():
            self.phrases.add_word(f" {p} ", (len(p) + 2, found))
        for t in tags:
            self.tags.add_word(t, len(t))
        self.phrases.make_automaton()
        self.tags.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, restriction, expressions)."""
        text = text or ""
        words = words_of(text)
        joined = f" {b' '.join(words).decode('latin-1')} "
        n_base, first, last, base, labels, doubt = 0, None, None, set(), set(), 1.0
        seen, counted = 0, 0
        starts = sorted((end - length + 1, found) for end, (length, found) in self.phrases.iter(joined))
        for start, found in starts:
            counted += joined.count(" ", seen, start)  # blanks before the one that begins the match: words before it
            seen = start
            for label, sure, is_base in found:
                if label not in labels:
                    doubt *= 1 - sure
                labels.add(label)
                if is_base:
                    n_base += 1
                    base.add(label)
                    first = counted if first is None else first
                    last = counted
        low = text.lower() if text.isascii() else text.translate(_LOWER)
        values, shown = [], []
        tags = sorted((end - length + 1, end + 1) for end, length in self.tags.iter(low))
        reached = 0
        for start, end in tags:
            if start < reached or (start and (low[start - 1].isalnum() or low[start - 1] in "-_")):
                continue  # inside another tag, or the end of a longer word
            tokens = expression_at(text, end)
            value = evaluate(tokens)
            if value and value.labels:
                values.append(value)
                shown.append(" ".join(tokens).replace("( ", "(").replace(" )", ")"))
                labels |= value.labels
                doubt *= 1 - TAG_SURE
                reached = end
        restriction = max([v.restriction for v in values] + [RESTRICTION[x] for x in labels if not any(x in v.labels for v in values)], default=None)
        return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - doubt if labels else 0.0, restriction, shown


_LOWER = {c: c + 32 for c in range(65, 91)}
NEW = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, restriction int, expressions array<string>"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.list_(pa.string())]


def scan_licenses(docs: DataFrame, *, phrases: dict[str, str] = BASE_PHRASES, notices: list[tuple[str, str, float]] = NOTICES, tags: list[str] = TAGS) -> DataFrame:
    """The columns of docs (without those named like the new ones) and what its text says of licences.

    n_words; n_base, first_word and last_word: places of `phrases`, and the least and largest of their starts (null: none);
    base_labels and labels: distinct, sorted, comma-joined, without and with those of notices and tags; score: how sure it is
    that any label holds, 1 - the product of the doubts; restriction: the strictest, by RESTRICTION (null: no
    label); expressions: what the tags say, operators in capitals. Null texts are empty: no words, no labels, score 0.
    Rows with equal texts get equal results; a text of any length is one row of one task.
    """
    new = [c.split()[0] for c in NEW.split(", ")]
    own = [c for c in docs.columns if c not in new]
    docs = docs.select(*(f"`{c}`" for c in own))
    at = own.index("text")

    def run(batches):
        scanner = Scanner(phrases, notices, tags)
        for batch in batches:
            found = [scanner.scan(t) for t in batch.column(at).to_pylist()]
            columns = zip(*found) if found else [[]] * len(new)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(map(list, columns), _TYPES))], names=[*own, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, {NEW}")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, phrase places, labels and score of all documents; see scan_licenses() for odd rows."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).drop("text")
