"""Counts of a document's words by sentence, in Arrow batches: what needs a dictionary of words takes one pass in Python, and sorts and loops over arrays in the JVM."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.lexicons import CURVE_STOP_WORDS, STOP_WORDS

#: Columns of each part: stats of all words, sentences that say again what a long one says, fresh words, the novelty curve, forms of sentences.
PARTS = {
    "stats": "words int, distinct int, hapax int, entropy double, pairs int, stop int, letters int", "circular": "circular int", "fresh": "fresh double",
    "curve": "curve array<double>, curve_wide double", "forms": "openers_again int, first_most int, length_varies double, complexity_varies double",
    "own": "said_again int, of_families int, opening_most int",
}
ARROW = {"int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
_TOKEN, _CURVE_WORD = re.compile(r"[a-z][a-z0-9_'-]*"), re.compile(r"\b[a-z][a-z0-9_-]*\b")
_STOP, _CURVE_STOP = frozenset(STOP_WORDS), frozenset(CURVE_STOP_WORDS)


class _Kinds(dict):
    """Characters beyond ASCII as an é or a middle dot: whether Java takes them for a part of a word."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        inside = unicodedata.category(c) in {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Nd", "Mn", "Me", "Mc", "Pc"} or c in "‌‍"
        inside = inside or 0x24B6 <= code <= 0x24E9 or 0x1F130 <= code <= 0x1F149 or 0x1F150 <= code <= 0x1F169 or 0x1F170 <= code <= 0x1F189
        self[code] = c if code < 128 else "é" if inside else "·"
        return self[code]


_KINDS = _Kinds()


def _mean(values: list[float]) -> float:
    return sum(values) / max(len(values), 1)


def _variation(values: list[float]) -> float:
    """Population standard deviation over mean; 0 where the mean is 0."""
    m = _mean(values)
    return math.sqrt(max(_mean([x * x for x in values]) - m * m, 0.0)) / m if m > 0 else 0.0


def _stats(toks: list[list[str]]) -> tuple:
    words = list(chain.from_iterable(toks))
    n, counts = len(words), Counter(words)
    bits = math.log2(n) - sum(c * math.log2(c) for c in counts.values() if c > 1) / n if n else None
    pairs = len(set(zip(words, words[1:])))
    return n, len(counts), sum(c == 1 for c in counts.values()), bits, pairs, sum(c for w, c in counts.items() if w in _STOP), sum(len(w) * c for w, c in counts.items())


def _circular(sents: list[str], sets: list[set]) -> int:
    """How many sentences have over half of the key words of a long one (15 different words and more), and under 30 % words of their own; at most 4."""
    long = [i for i, s in enumerate(sets) if len(s) >= 15]
    if not long:
        return 0
    holders, found = defaultdict(list), 0
    for j, s in enumerate(sets):
        for w in s:
            holders[w].append(j)
    for i in long:
        key = [w for w in sets[i] if len(w) > 4 and w not in _STOP]
        shared = Counter(chain.from_iterable(holders[w] for w in key))
        for j, k in shared.items():
            if 2 * k > len(key) and len(sets[j] - sets[i]) / len(sets[j]) < 0.3 and sents[j] != sents[i]:
                found += 1
        if found >= 4:
            return 4
    return found


def _fresh(sets: list[set]) -> float | None:
    """Mean share of a sentence's different words that no earlier one has; none without words."""
    seen, shares = set(), []
    for s in sets:
        if s:
            shares.append(len(s - seen) / len(s))
            seen |= s
    return _mean(shares) if shares else None


def _curve(low: list[str]) -> tuple[list[float], float]:
    """Of each sentence the share of its content words that no earlier one has; and the share of words that three or more sentences have."""
    curve, sentences = [], Counter()
    for s in low:
        words = [w for w in _CURVE_WORD.findall(s if s.isascii() else s.translate(_KINDS)) if len(w) > 2 and w not in _CURVE_STOP]
        curve.append(sum(w not in sentences for w in words) / max(len(words), 1))
        sentences.update(set(words))
    return curve, sum(n > 2 for n in sentences.values()) / max(len(sentences), 1)


def _forms(sents: list[str], toks: list[list[str]]) -> tuple:
    """How many openings of three words come again, how often the most frequent first word comes, how lengths and punctuation vary."""
    spoken = [t for t in toks if t]
    openers = {tuple(t[:3]) if len(t) > 2 else t[0] for t in spoken}
    openers = {" ".join(o) if isinstance(o, tuple) else o for o in openers}
    firsts = Counter(t[0] for t in spoken)
    complexity = [s.count(",") + 2.0 * s.count(";") + 1.5 * s.count("(") for s in sents]
    return len(spoken) - len(openers), max(firsts.values(), default=0), _variation([float(len(t)) for t in toks]), _variation(complexity)


def _own(domain: str | None, toks: list[list[str]]) -> tuple:
    """docs: sentences that say the same as two before, and words of families of three forms and more; hiring: how often sentences open with the same two words."""
    if domain == "hiring":
        return None, None, max(Counter(" ".join(t[:2]) for t in toks if t).values(), default=0)
    if domain != "docs":
        return None, None, None
    sets = [{w for w in t if len(w) > 3} for t in toks]
    again = sum(len(c - a - b) <= 1 and len(a) + len(b) > 0 and len(a & c) / max(len(a | c), 1) > 0.5 for a, b, c in zip(sets, sets[1:], sets[2:]))
    forms = Counter(w for w in chain.from_iterable(toks) if len(w) >= 6)
    stems = Counter(w[:6] for w in forms)
    return again, sum(n for w, n in forms.items() if stems[w[:6]] > 2), None


def _counted(sents: pa.Array, domains: pa.Array, parts: tuple[str, ...]) -> pa.Array:
    rows = []
    for doc, domain in zip(sents.to_pylist(), domains.to_pylist()):
        doc = doc or []
        low = [s.lower() for s in doc]
        toks = [_TOKEN.findall(s) for s in low]
        sets = [set(t) for t in toks] if "circular" in parts or "fresh" in parts else []
        row = ()
        for p in parts:
            row += _stats(toks) if p == "stats" else (_circular(doc, sets),) if p == "circular" else (_fresh(sets),) if p == "fresh" else _curve(low) if p == "curve" else _own(domain, toks) if p == "own" else _forms(doc, toks)
        rows.append(row)
    fields = [tuple(f.split(" ")) for p in parts for f in PARTS[p].split(", ")]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], ARROW[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def counted(sents: Column, domain: Column, parts: tuple[str, ...]) -> Column:
    """The columns of those parts, as a struct, of an array of sentences."""

    def count(sents: pa.Array, domain: pa.Array) -> pa.Array:
        return _counted(sents, domain, parts)

    return F.arrow_udf(count, f"struct<{', '.join(f.replace(' ', ':', 1) for p in parts for f in PARTS[p].split(', '))}>")(sents, domain)
