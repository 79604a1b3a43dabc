"""Bulk-synchronous best-fit packing of tokenised documents (operator 1).

Pieces and gaps are whole numbers of tokens, from 1 to the capacity. Pieces are range-sorted by length and
ranked inside their length, so all pieces of one length are one run (length, first rank, count); sequences
that have the same gap are a run as well. However many rows there are, a sorted list of runs has at most
`capacity` entries a side, and it is all that the rounds pass around:

1. sweep: from the long end to the short end, each piece run takes the nearest gaps at least as long that no
   longer piece has taken (its successors in the sorted list);
2. conflicts inside a run go by rank: the first ranks get the gaps, the others wait for the next round;
3. the gaps shrink, the runs split, and the next round starts; pieces for which no gap is long enough open
   sequences, longest first and only as many as their tokens fill.

The rounds give contiguous rank ranges of pieces contiguous ranges of sequences. Rows meet that plan in one
join on (length, rank), so each document row is shuffled once, by the range sort.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import read_table, text_bytes, written

#: Encodings of words that a Python worker remembers from one task to the next: that many of words met once lately, as many of
#: those before them, and twice as many of words met again.
REMEMBERED = 200_000
#: How a tokenizer parts words whose words of printable ASCII and Latin-1 letters (LATIN) are parted by LATIN_PARTS here, and lower-cased before.
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
LATIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Words that a task codes together; a table of their own for each such lot stays in the processor's cache.
CHUNK_WORDS = 100_000


def _word_chunks(texts: pa.Array):
    """(rows, words of each row) in chunks of about CHUNK_WORDS words, whole texts each; a null text has none."""
    rows, parts, held = [], [], 0
    ends, data = text_bytes(texts)
    ends, data = ends.tolist(), memoryview(data)
    for i, there in enumerate(texts.is_valid().to_pylist()):
        words = data[ends[i] : ends[i + 1]].tobytes().split() if there else []
        rows.append(i)
        parts.append(words)
        held += len(words)
        if held >= CHUNK_WORDS:
            yield rows, parts
            rows, parts, held = [], [], 0
    if rows:
        yield rows, parts


class WordCoder:
    """The ids of words as little-endian bytes; the tokenizer parts words at blanks, so a text is its words' ids in turn.

    Words go through the tokenizer many at a time, kept apart by a control character that it turns into one id of its own.
    Words of ASCII letters do without it if the model marks the ends of words and a lot has as many ends as words. Words
    with the control character or with the string of a special token, or all if there is no such id, go alone. Words are
    remembered in two generations: a word of the older one that is met again moves to the newer.

    Where the tokenizer parts words by KNOWN_SPLIT, a word of LATIN is the ids of its parts in turn, and the model codes each part once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.coder.get_added_tokens_decoder().values()] + [b"\x01"]
        self.known, self.old = {}, {}
        self.parts: dict[str, bytes] = {}
        self.by_parts = self._parts_known()
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that the byte level shows as themselves; it numbers the others
        self.byte_level = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        one = lambda text: self.coder.encode(text, add_special_tokens=False).ids
        self.mark, ids = "\x01", one("\x01")
        self.mark_id = ids[0] if len(ids) == 1 and one("a \x01 b") == [*one("a"), *ids, *one("b")] else None
        suffix = getattr(self.coder.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.coder.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for token, i in self.coder.get_vocab().items() if token.endswith(suffix)]] = True

    def _parts_known(self) -> bool:
        about = json.loads(self.coder.to_str())
        before = (about["normalizer"] or {}).get("normalizers", [])
        splits = (about["pre_tokenizer"] or {}).get("pretokenizers", [])
        if [x["type"] for x in before] != ["NFC", "Replace", "Lowercase"] or before[1]["pattern"] != {"Regex": r"\s+"} or before[1]["content"] != " " or [x["type"] for x in splits] != ["Split", "ByteLevel"]:
            return False
        split, level = splits
        whole = split["pattern"] == {"Regex": KNOWN_SPLIT} and split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]
        return whole and about["post_processor"] is None and about["model"]["type"] == "BPE" and not about["model"]["dropout"]

    def _code_parts(self, words: list[bytes]):
        """Words of LATIN without the string of a special token: what the model makes of each part."""
        split, known, tokenize, pack = LATIN_PARTS.findall, self.parts, self.coder.model.tokenize, struct.pack
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            code = []
            low = w.decode().lower()
            for part in (low,) if w.isalpha() else split(low):  # isalpha: ASCII letters only
                found = known.get(part)
                if found is None:
                    ids = [x.id for x in tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.byte_level))]
                    found = known[part] = pack(f"<{len(ids)}I", *ids)
                code.append(found)
            yield w, code[0] if len(code) == 1 else b"".join(code)

    def learn(self, texts: list[list[bytes]]) -> dict[bytes, bytes]:
        """A table that has all words of these texts, until the next call."""
        if len(self.known) > REMEMBERED:
            self.known, self.old = {}, self.known
        known = self.known
        lacking = list({w for words in texts for w in words if w not in known})
        found = list(map(self.old.get, lacking))
        known.update((w, ids) for w, ids in zip(lacking, found) if ids is not None)
        known.update(self._code([w for w, ids in zip(lacking, found) if ids is None]))
        return known

    def _code(self, words: list[bytes], join: int = 30):
        if self.by_parts:
            fits, whole = LATIN.fullmatch, []
            latin = [w for w in words if w.isalpha() or (fits(w) and not (b"|" in w and any(x in w for x in self.special))) or whole.append(w)]
            yield from self._code_parts(latin)
            words = whole
        plain = [w for w in words if w.isalpha() and len(w) < 64] if self.ends.any() else []
        groups = [plain[i : i + join] for i in range(0, len(plain), join)]
        left = [w for w in words if not (w.isalpha() and len(w) < 64)] if plain else words
        for group, coded in zip(groups, self.coder.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(coded.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                yield from self._cut(group, ids, ends, 0)
            else:
                left += group
        odd = [w for w in left if self.mark_id is None or any(x in w for x in self.special)]
        left = [w for w in left if w not in set(odd)] if odd else left
        groups = [left[i : i + join] for i in range(0, len(left), join)]
        glue = f" {self.mark} ".encode()
        for group, coded in zip(groups, self.coder.encode_batch_fast([glue.join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(coded.ids, "<u4")
            yield from self._cut(group, ids, [*np.flatnonzero(ids == self.mark_id), len(ids)], 1)
        for w, coded in zip(odd, self.coder.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False)):
            yield w, np.array(coded.ids, "<u4").tobytes()

    @staticmethod
    def _cut(words: list[bytes], ids: np.ndarray, ends, gap: int):
        """The ids up to each end are a word's; gap ids lie between two words."""
        flat, start = ids.tobytes(), 0
        for w, end in zip(words, ends):
            yield w, flat[4 * start : 4 * end]
            start = end + gap


_CODERS: dict[str, WordCoder] = {}


def word_coder(path: str) -> WordCoder:
    """The coder of this Python worker, which outlives a task."""
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def _pieces(tokenizer: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches):
        coder = word_coder(tokenizer)
        end, size = np.array([end_id], "<u4").tobytes(), 4 * capacity
        gc.disable()  # nothing here refers to itself, and a collection would walk through all remembered words
        try:
            for batch in batches:
                ids, out = batch.column(0), []
                for numbers, parts in _word_chunks(batch.column(1)):
                    known = coder.learn(parts)
                    for i, words in zip(numbers, parts):
                        code = b"".join(map(known.__getitem__, words)) + end
                        for n in range(-(-len(code) // size)):
                            cut = code[n * size : (n + 1) * size]
                            out.append((i, n, n * capacity, len(cut) // 4, zlib.crc32(cut), cut if with_ids else None))
                rows, piece, start, length, crc, cuts = zip(*out) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())] + ([pa.array(cuts, pa.binary())] if with_ids else []),
                    names=["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else []),
                )
        finally:
            gc.enable()

    return run


def tokenize(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32 (and ids, little-endian).

    A document is its ids and one end_id; a null or empty text is the end_id alone. tokenizer: a file that
    every executor has, of a `tokenizers` model that parts words at ASCII blanks. Repeated rows and rows without a doc_id
    have pieces of their own; texts of any length are coded whole; other columns are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _pieces(tokenizer, capacity, end_id, with_ids), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    )


def best_fit_rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Place counts[length] pieces of each length; returns runs (length, first rank, count, first sequence, offset).

    Works on runs only: its time grows with the capacity and the number of runs, not with the pieces.
    """
    left = {s: n for s, n in counts.items() if n}
    taken: dict[int, int] = defaultdict(int)  # ranks of a length that have a place
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs (first sequence, count)
    plan: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def place(size: int, n: int, sequence: int, gap: int, into: dict) -> None:
        plan.append((size, taken[size], n, sequence, capacity - gap))
        taken[size] += n
        left[size] -= n
        if gap > size:
            into[gap - size].append((sequence, n))

    while left:
        grown: dict[int, list[tuple[int, int]]] = defaultdict(list)
        stack: list[int] = []  # free gaps met by the sweep, the nearest on top
        order = sorted({*left, *gaps}, reverse=True)
        for value in order:
            if gaps.get(value):
                stack.append(value)
            need = left.get(value, 0)
            while need and stack:
                runs = gaps[stack[-1]]
                sequence, n = runs.pop()
                use = min(n, need)
                if use < n:
                    runs.append((sequence + use, n - use))
                place(value, use, sequence, stack[-1], grown)
                need -= use
                if not runs:
                    stack.pop()
        for gap, runs in grown.items():
            gaps[gap] += runs
        gaps = defaultdict(list, {g: r for g, r in gaps.items() if r})
        left = {s: n for s, n in left.items() if n}
        longest = max(gaps, default=0)
        # pieces that no gap holds any longer open sequences: longest first, as many as their tokens fill
        over = {s: n for s, n in left.items() if s > longest}
        want = -(-sum(s * n for s, n in over.items()) // capacity)
        big = sum(n for s, n in over.items() if 2 * s > capacity)
        for size in sorted(over, reverse=True):
            n = min(over[size], max(want, big))
            if n <= 0:
                break
            place(size, n, opened, capacity, gaps)
            opened, want, big = opened + n, want - n, big - n
        left = {s: n for s, n in left.items() if n}
    return plan


def pack(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset (long) to pieces, whose `length` is from 1 to capacity.

    Sequences are full from 0 without a gap between their pieces. Equal lengths go by (doc_id, piece); repeated rows are packed
    as often as they come, rows with a null doc_id before others. Other columns stay, but for two of those names; without pieces the result is empty.
    """
    n = max(2, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # written first: the range sort reads its input twice, once for the bounds
    ordered = written(pieces, "pieces").repartitionByRange(n, "length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    ordered = written(ordered.withColumn("__part", F.spark_partition_id()), "ordered")
    # a range holds few lengths, so this has at most n + capacity rows
    runs = sorted((r["length"], r["__part"], r["count"]) for r in ordered.groupBy("length", "__part").count().collect())
    counts: dict[int, int] = defaultdict(int)
    before = []
    for length, part, count in runs:
        before.append((length, part, counts[length]))
        counts[length] += count
    plan = best_fit_rounds(counts, capacity)
    spark = pieces.sparkSession
    before = spark.createDataFrame(before, "length long, __part int, __before long")
    local = Window.partitionBy("__part", "length").orderBy("doc_id", "piece")
    ranked = ordered.withColumn("__local", F.row_number().over(local) - 1).join(F.broadcast(before), ["length", "__part"])
    ranked = ranked.withColumn("__rank", F.col("__local") + F.col("__before"))
    steps: dict[int, list] = defaultdict(list)
    for length, rank, _, sequence, offset in plan:
        steps[length].append((rank, sequence, offset))
    # the runs of a length in one array, found by its rank
    table = spark.createDataFrame([(k, sorted(v)) for k, v in steps.items()], "length long, __runs array<struct<rank:long,sequence:long,offset:long>>")
    run = F.aggregate("__runs", F.col("__runs")[0], lambda a, x: F.when(x["rank"] <= F.col("__rank"), x).otherwise(a))
    placed = ranked.join(F.broadcast(table), "length").withColumn("__run", run)
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    return placed.select(*own, (F.col("__run.sequence") + F.col("__rank") - F.col("__run.rank")).alias("sequence_id"), F.col("__run.offset").alias("offset"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents and their places; see tokenize() and pack() for odd rows."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return pack(tokenize(docs, public_tokenizers.path("word_bpe_49k.json")))
