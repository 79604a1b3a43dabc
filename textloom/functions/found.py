r"""How often patterns occur in texts, by Arrow's regexes (RE2): they read a text once, however many alternatives a pattern has.

RE2 knows word boundaries, \w and \d of ASCII only. So letters beyond ASCII become an "X" first, which no lower-cased pattern names, and
blanks beyond ASCII a form feed. Where that does not settle it (marks, other digits, letters of two cases that fold to ASCII), the count
is null, and the Java expression beside it decides: both functions only spare Java work.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from textloom.functions import domain_patterns as D
from textloom.functions import lexicons as L
from textloom.functions import patterns as P
from textloom.functions import reasoning_patterns as R
from textloom.functions.text import settled
from textloom.functions.wordstats import counted

#: Groups of phrases of which each counts once if the text holds it.
PHRASES = {"filler": L.FILLER_PHRASES, "transitions": L.TRANSITIONS, "complexity": P.COMPLEXITY, "negative": P.NEGATIVE, "curve": P.CURVE_FILLER}
#: Groups of patterns of which each counts once if it occurs in the lower-cased text.
ONCE = {
    "editing": P.EDITING, "revision": P.REVISION, "uncertainty": P.UNCERTAINTY, "disagreement": P.DISAGREEMENT, "hedges": P.HEDGE_PHRASES, "balance": P.FALSE_BALANCE,
    "commit": P.COMMITMENT, "launder": P.OPINION_LAUNDERING, "resolution": P.RESOLUTION, "alt": P.REJECTED_ALTERNATIVES, "fail": P.FAILURE_MODES, "cond": P.SPECIFIC_CONDITIONS,
    "trade": P.SPECIFIC_TRADEOFFS, "generic": P.GENERIC_COUNTERFACTUALS, "conditional": R.CONDITIONAL, "comparative": R.COMPARATIVE, "tradeoff": R.TRADEOFF,
}
#: Patterns of which each occurrence counts, without case and with it.
TIMES = {
    "personal": r"\b(I|me|my|we|us|our|you|your)\b", "distant": r"\b(it is|there is|there are|one should|one can|this is)\b", "contraction": P.CONTRACTION, "reference": P.DIRECT_REFERENCE,
    "before": R.BEFORE_AFTER[0], "reduced": R.BEFORE_AFTER[1],
}
WITH_CASE = {"first_person": P.FIRST_PERSON, "name_pair": P.NAME_PAIR} | {f"concrete{i}": p for i, p in enumerate(L.CONCRETE)}
#: What letters beyond ASCII are in the SQL of those; concrete patterns read the text as it is, so their words end at such a letter.
LETTERS = {"first_person": "x", "name_pair": "_"}
TRIPLES = [t for t in R.SLOP_TRIGRAMS if len(t) == 3]
COUNTS, CASED = D.COUNTS, D.WITH_CASE  # by name, as workers have no module of ours
OWN = "own"
#: Patterns of domains that read the text as it is. For others the SQL has an x, or in docs a _, for each letter beyond ASCII.
RAW = {"headings", "examples", "dashes", "shouting"}
NAMES = [*PHRASES, *ONCE, *TIMES, *WITH_CASE, *TRIPLES, *(f"{OWN}{i}" for i in range(max(map(len, COUNTS.values()))))]
PLACE = {name: i for i, name in enumerate(NAMES)}

_LETTER = r"[^\P{L}\x00-\x7F]"
_BLANK = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_UNSURE = r"[\p{M}\p{Nl}\p{No}\x{131}\x{17F}\x{200C}\x{200D}\x{203F}\x{2040}\x{2054}\x{FE33}\x{FE34}\x{FE4D}-\x{FE4F}\x{FF3F}\x{24B6}-\x{24E9}\x{1F130}-\x{1F189}\x0B]|[^\P{Nd}\x00-\x7F]"


def portable(pattern: str) -> bool:
    """Whether RE2 reads the pattern as Java does, once it is lower-cased."""
    if re.search(r"\\[A-Z]|\(\?[=!<]|\\[1-9]|\(\?[a-z]*[^a-z:s)]|\$$", pattern):
        return False
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid:
        return False
    return True


def _plain(low: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts with letters and blanks beyond ASCII replaced, and which of them RE2 can tell all of."""
    sure = ~pc.match_substring_regex(low, _UNSURE).to_numpy(zero_copy_only=False).astype(bool)
    rest = pc.invert(pc.string_is_ascii(low))
    if pc.any(rest).as_py():
        changed = pc.replace_substring_regex(pc.replace_substring_regex(low.filter(rest), _LETTER, "X"), _BLANK, "\f")
        low = pc.replace_with_mask(low, rest, changed)
    return low, sure


def needed(pattern: str) -> list[str]:
    """Plain strings of which any match of the pattern holds one; empty if there are none to tell.

    The longest plain run outside groups, or else the alternatives of a group that has plain ones only.
    """
    body = re.sub(r"^\(\?\w+\)", "", pattern)
    groups = [m.split("|") for m in re.findall(r"\(\?:([a-z' |-]+)\)(?![?*{])", body)]
    outside = re.sub(r"\[[^]]*\]", "\0", body)
    while (flat := re.sub(r"\([^()]*\)", "\0", outside)) != outside:
        outside = flat
    outside = re.sub(r".[?*]|\{\d+(?:,\d*)?\}|\\.", "\0", outside)
    runs = [] if "|" in outside else [[r] for r in re.findall(r"[a-z':~ -]{3,}", outside)]
    return max(runs + groups, key=lambda g: min(map(len, g)), default=[])


def _once(low: pa.Array, texts: list[str], pattern: str) -> np.ndarray:
    """Whether each text has the pattern; it is searched for only where plain words that it needs are."""
    out, words = np.zeros(len(texts), np.int32), needed(pattern)
    rows = np.array([i for i, s in enumerate(texts) if any(w in s for w in words)], np.int64) if words else np.arange(len(texts))
    if len(rows):
        out[rows] = pc.match_substring_regex(low.take(pa.array(rows)), pattern).to_numpy(zero_copy_only=False)
    return out


def _triple(s: str, t: str) -> int:
    """A triple that begins and ends alike can overlap itself."""
    if t[0] != t[-1] or t not in s:
        return s.count(t)
    return sum(1 for _ in re.finditer(f"{re.escape(t[:2])}(?={re.escape(t[2])})", s))


def _found(text: pa.Array, low: pa.Array, domain: pa.Array, names: frozenset = frozenset(NAMES)) -> pa.Array:
    """The counts of those names, each in its place; null in the others."""
    texts, n = low.to_pylist(), len(low)
    out, known = np.zeros((n, len(NAMES)), np.int32), np.zeros((n, len(NAMES)), bool)
    known[:, [PLACE[k] for k in [*PHRASES, *TRIPLES] if k in names]] = True
    wanted = lambda group: ((k, v) for k, v in group.items() if k in names)
    for name, phrases in wanted(PHRASES):
        out[:, PLACE[name]] = [sum(p in s for p in phrases) for s in texts]
    for t in names.intersection(TRIPLES):
        out[:, PLACE[t]] = [_triple(s, t) for s in texts]
    low, sure = _plain(low)
    for name, group in wanted(ONCE):
        lowered = [p.lower() for p in group]
        known[:, PLACE[name]] = sure if all(map(portable, group)) else False
        if all(map(portable, group)):
            out[:, PLACE[name]] = sum(_once(low, texts, p) for p in lowered)
    count = lambda rows, p: pc.count_substring_regex(rows, p).to_numpy(zero_copy_only=False)
    for name, p in wanted(TIMES):
        known[:, PLACE[name]] = sure if portable(p) else False
        if portable(p):
            out[:, PLACE[name]] = count(low, p.lower())
    raw, cased = text.filter(pa.array(sure)), list(wanted(WITH_CASE))
    lettered = {k: pc.replace_substring_regex(raw, _LETTER, to) for k, to in LETTERS.items() if k in names}
    for name, p in cased:
        known[:, PLACE[name]] = sure
        out[sure, PLACE[name]] = count(lettered.get(name, raw), p)
    domains = np.array(domain.to_pylist(), object)
    for d, patterns in COUNTS.items():
        mine = domains == d
        if f"{OWN}0" not in names or not mine.any():
            continue
        able = mine & sure
        raw = text.filter(pa.array(able))
        plain = pc.replace_substring_regex(raw, _LETTER, "_" if d == "docs" else "x")
        for i, (name, p) in enumerate(patterns.items()):
            known[able, PLACE[f"{OWN}{i}"]] = True
            out[able, PLACE[f"{OWN}{i}"]] = count(raw if name in RAW else plain, p if name in CASED else "(?i)" + p)
    values = pa.array(out.ravel(), mask=~known.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(NAMES)), values)


_either = lambda patterns: "|".join(f"(?:{p})" for p in patterns)
CONCRETE, JARGON, EVIDENCE, CAUSAL = 1, 2, 4, 8
_FLAGS = {CONCRETE: _either(L.CONCRETE), EVIDENCE: _either(L.EVIDENCE), CAUSAL: "(?i)" + R.CAUSAL}
_JARGON = _either(map(re.escape, L.JARGON))  # in lower-cased sentences, where one with a capital never is


def _flags(sents: pa.Array) -> pa.Array:
    """Of each sentence the sum of its flags; null where RE2 cannot tell them. As in the SQL, words end at letters beyond ASCII."""
    flat, lengths = sents.flatten(), pc.fill_null(pc.list_value_length(sents), 0).to_numpy(zero_copy_only=False)
    known = ~pc.match_substring_regex(flat, _UNSURE).to_numpy(zero_copy_only=False).astype(bool)
    plain, total = flat.filter(pa.array(known)), np.zeros(len(flat), np.int32)
    has = lambda s, p: pc.match_substring_regex(s, p).to_numpy(zero_copy_only=False).astype(np.int32)
    total[known] = sum(bit * has(plain, p) for bit, p in _FLAGS.items()) + JARGON * has(pc.utf8_lower(plain), _JARGON)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(total, mask=~known))


def found(text: Column, low: Column, domain: Column, names: frozenset) -> Column:
    @F.arrow_udf(ArrayType(IntegerType()))
    def found(text: pa.Array, low: pa.Array, domain: pa.Array) -> pa.Array:
        return _found(text, low, domain, names)

    return found(text, low, domain)


@F.arrow_udf(ArrayType(IntegerType()))
def flags(sents: pa.Array) -> pa.Array:
    return _flags(sents)


def with_found(df: DataFrame, names=NAMES, sentences: bool = True, words: tuple[str, ...] = ()) -> DataFrame:
    """Add _found, if there are names, _flags of the sentences, and counts of those parts of wordstats to df (text, _low, sents, perhaps domain). All are computed in one call of a worker, which reads whole batches."""
    domain = F.col("domain") if "domain" in df.columns else F.lit("general")
    counts = {"_found": found(F.col("text"), F.col("_low"), domain, frozenset(names))} if names else {}
    counts |= {"_words": counted(F.col("sents"), domain, words)} if words else {}
    out = settled(df.withColumns(counts | ({"_flags": flags("sents")} if sentences else {})))
    return out.select(*(c for c in out.columns if c != "_words"), "_words.*") if words else out


def told(df: DataFrame, name: str, otherwise: Column) -> Column:
    """The count of that name if df has it; where RE2 cannot tell it, and without _found, what Java makes of it."""
    return F.coalesce(F.get("_found", F.lit(PLACE[name])), otherwise) if "_found" in df.columns else otherwise


def flagged(flag: Column, bit: int, otherwise: Column) -> Column:
    return F.when(flag.isNull(), otherwise).otherwise(flag.bitwiseAND(F.lit(bit)) != 0)
