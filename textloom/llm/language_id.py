"""Language ID by a bidirectional gated recurrent network over bytes (operator 6).

The network reads the bytes of a whole document in both directions, blanks and all, and gives each position a
distribution over the languages. A document's score is the sum of the log probabilities of all its positions, as a
softmax over languages.

Documents are read in segments, so that many positions of many documents go through the network together. A segment
is led in by the CONTEXT bytes before it (forward) and behind it (backward), which the network reads
without labelling them. So every position is labelled once, from at least CONTEXT bytes on either side or from
all there are up to the ends of the document, whatever its length and whatever else is in the batch.

It is trained in numpy by backpropagation through time on `windows` pieces of each of at most `train_docs` labelled
documents; these bounds are the only things that do not grow with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import read_table, text_bytes

#: Bytes that a segment labels, bytes that lead in to it on either side, and segments that run together.
SEGMENT, CONTEXT, TOGETHER = 112, 16, 2048


def encode(pieces: list[bytes]) -> np.ndarray:
    """Bytes as (longest, pieces) with 0 beyond the end; a byte 0 in a piece is read as a blank."""
    out = np.zeros((max(map(len, pieces), default=0), len(pieces)), np.intp)
    for i, p in enumerate(pieces):
        out[: len(p), i] = np.frombuffer(p.replace(b"\0", b" "), np.uint8)
    return out


class BiGru:
    """Two gated recurrent layers (forward, backward) over byte embeddings and a softmax at every position.

    Arrays are (steps, sequences). Byte 0 stands for "nothing here": its update gate is shut, so a state passes it unchanged.
    """

    def __init__(self, langs: list[str], hidden: int = 12, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden, self.p = langs, hidden, {}
        for d in "fb":
            for gate in "zrc":  # update, reset, candidate: embeddings times input weights, with biases; recurrent weights
                self.p[f"E{gate}{d}"] = (rng.standard_normal((256, hidden)) * 0.3).astype(np.float32)
                self.p[f"U{gate}{d}"] = (rng.standard_normal((hidden, hidden)) / np.sqrt(hidden) / 2).astype(np.float32)
            self.p[f"Ez{d}"][0] = -30
        self.p["W"] = (rng.standard_normal((2 * hidden, len(langs))) * 0.3).astype(np.float32)
        self.p["c"] = np.zeros(len(langs), np.float32)

    def _states(self, x: np.ndarray, d: str, steps: range, first: int, count: int, keep: list | None = None) -> np.ndarray:
        """States after each step; those of steps first .. first + count are returned."""
        (Ez, Er, Ec), (Uz, Ur, Uc) = ([self.p[f"{m}{g}{d}"] for g in "zrc"] for m in "EU")
        n, h, kind = x.shape[1], self.hidden, Ez.dtype
        state, out = np.zeros((n, h), kind), np.empty((count, n, h), kind)
        z, r, c, t = (np.empty((n, h), kind) for _ in range(4))
        for i in steps:
            Ez.take(x[i], 0, z, "clip"), Er.take(x[i], 0, r, "clip"), Ec.take(x[i], 0, c, "clip")
            np.tanh(np.add(z, np.matmul(state, Uz, t), z), z)
            np.tanh(np.add(r, np.matmul(state, Ur, t), r), r)
            if keep is not None:
                keep.append((i, state.copy(), z.copy(), r.copy()))
            r += 1
            r *= state
            np.tanh(np.add(c, np.matmul(r, Uc, t), c), c)
            if keep is not None:
                keep[-1] += (c.copy(),)
            z += 1
            z *= 0.5
            c -= state
            c *= z
            state += c
            if first <= i < first + count:
                out[i - first] = state
        return out

    def forward(self, x: np.ndarray, context: int = 0, keep: tuple[list, list] | None = None):
        """(log probabilities as (languages, positions, sequences), states of both directions) of all but `context` steps at either end."""
        whole, kf, kb = len(x), *(keep or (None, None))
        count = whole - 2 * context
        f = self._states(x, "f", range(whole - context), context, count, kf)
        b = self._states(x, "b", range(whole - 1, context - 1, -1), context, count, kb)
        h, flat = self.hidden, (-1, self.hidden)
        logp = self.p["W"][:h].T @ f.reshape(flat).T + self.p["W"][h:].T @ b.reshape(flat).T + self.p["c"][:, None]
        logp -= logp.max(0)
        logp -= np.log(np.exp(logp).sum(0))
        return logp.reshape(-1, count, x.shape[1]), f, b

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all bytes and its gradients, by backpropagation through time."""
        keep = ([], [])
        logp, *states = self.forward(x, keep=keep)
        mask = (x > 0).astype(logp.dtype)
        total, each = mask.sum(), np.arange(len(y))
        d = np.exp(logp)
        d[y, :, each] -= 1
        d *= mask / total
        d = d.transpose(1, 2, 0)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        h, p = self.hidden, self.p
        g["c"] = d.sum(axis=(0, 1))
        for s, own, held, W in (("f", states[0], keep[0], slice(0, h)), ("b", states[1], keep[1], slice(h, 2 * h))):
            g["W"][W] = own.reshape(-1, h).T @ d.reshape(-1, d.shape[2])
            up = d @ p["W"][W].T
            carry = np.zeros((len(y), h), logp.dtype)
            for t, state, tz, tr, c in reversed(held):
                dn = carry + up[t]
                z, r = 0.5 * (tz + 1), tr + 1
                dz, dc = dn * (c - state) * 0.5 * (1 - tz * tz), dn * z * (1 - c * c)
                drs = dc @ p[f"Uc{s}"].T
                dr = drs * state * (1 - tr * tr)
                for gate, v, into in (("z", dz, state), ("r", dr, state), ("c", dc, r * state)):
                    np.add.at(g[f"E{gate}{s}"], x[t], v)
                    g[f"U{gate}{s}"] += into.T @ v
                carry = dn * (1 - z) + drs * r + dz @ p[f"Uz{s}"].T + dr @ p[f"Ur{s}"].T
        loss = -(logp[y, :, each] * mask.T).sum() / total
        return float(loss), g

    def train(self, pieces: list[bytes], labels: np.ndarray, *, steps: int, batch: int = 192, rate: float = 0.02, seed: int = 2) -> None:
        """Adam over random batches of (piece, label)."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            own = rng.integers(0, len(pieces), batch)
            _, g = self.gradients(encode([pieces[i] for i in own]), labels[own])
            step = rate * min(1.0, 2 * (1 - (t - 1) / steps))
            for k in self.p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                self.p[k] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)

    def totals(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(documents, languages): sum over the positions of data[start:end] of their log probabilities."""
        out = np.zeros((len(start), len(self.langs)))
        parts = -(-(end - start) // SEGMENT)
        doc = np.repeat(np.arange(len(start)), parts)
        first = start[doc] + SEGMENT * (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts))
        length = np.minimum(end[doc] - first, SEGMENT)
        order = np.argsort(length, kind="stable")
        for a in range(0, len(order), TOGETHER):
            own = order[a : a + TOGETHER]
            at = first[own] + np.arange(-CONTEXT, length[own[-1]] + CONTEXT)[:, None]
            inside = (at >= start[doc[own]]) & (at < end[doc[own]])
            x = data[np.where(inside, at, 0)].astype(np.intp)
            x[x == 0] = 32
            x[~inside] = 0
            logp, _, _ = self.forward(x, CONTEXT)
            logp *= np.arange(logp.shape[1])[:, None] < length[own]
            np.add.at(out, doc[own], logp.sum(1).T)
        return out


def training_windows(docs: DataFrame, *, train_docs: int, windows: int, width: int) -> dict[str, list[bytes]]:
    """Pieces of `width` characters from all over the drawn documents, `windows` of each, by language.

    Of each language at most train_docs / languages documents, those with the smallest hash of id and text, are drawn;
    repeated rows count once, and pieces without a letter do not count. Only these pieces reach the driver.
    """
    known = docs.filter(F.col("lang").isNotNull() & (F.col("text") != ""))
    sizes = [(r["lang"], r["count"]) for r in known.groupBy("lang").count().collect()]  # the network has an output for each
    if not sizes:
        return {}
    share, span = max(1, train_docs // len(sizes)), 1 << 40
    # a few more than the share, as the hash decides which
    bar = known.sparkSession.createDataFrame([(k, min(span, int(span * (1.2 * share + 10) / n))) for k, n in sizes], "lang string, bar long")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(span))
    room = F.greatest(F.char_length("text") - width, F.lit(0)) + 1
    pieces = F.transform(F.sequence(F.lit(1), F.lit(windows)), lambda i: F.substr("text", F.pmod(F.xxhash64("draw", i), room).cast("int") + 1, F.lit(width)))
    drawn = known.withColumn("draw", draw).join(F.broadcast(bar), "lang").filter("draw < bar").select("lang", "draw", pieces.alias("pieces")).dropDuplicates(["lang", "draw"])
    out: dict[str, list[bytes]] = {}
    taken: dict[str, int] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["lang"], r["draw"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= share and (own := [p.encode() for p in r["pieces"] if any(map(str.isalpha, p))]):
            out.setdefault(r["lang"], []).extend(own)
    return out


def train_on(docs: DataFrame, *, train_docs: int = 1500, windows: int = 10, width: int = 48, steps: int = 350) -> BiGru | None:
    """Fit the network on labelled documents (doc_id, text, lang); see training_windows() for the bounds.

    Languages count alike, however many documents each has. None if there is nothing to learn from.
    """
    pieces = training_windows(docs, train_docs=train_docs, windows=windows, width=width)
    langs, rng = sorted(pieces), np.random.default_rng(0)
    if not langs:
        return None
    model = BiGru(langs)
    if len(langs) > 1:
        each = max(1, train_docs * windows // len(langs))
        drawn = [(pieces[k][i], n) for n, k in enumerate(langs) for i in rng.integers(0, len(pieces[k]), each)]
        model.train([p for p, _ in drawn], np.array([n for _, n in drawn]), steps=steps)
    return model


def _predict(model: BiGru | None, column: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(column)
            has = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False)) if model else np.zeros(len(texts), bool)
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if has.any():
                bounds, data = text_bytes(texts)
                start, end = bounds[:-1][has], bounds[1:][has]
                total = model.totals(data, start, end)
                p = np.exp((total - total.max(1, keepdims=True)) / np.sqrt(end - start)[:, None])
                lang[has], score[has] = np.array(model.langs, object)[total.argmax(1)], p.max(1) / p.sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: BiGru | None) -> DataFrame:
    """Add lang_pred and score (0 to 1) to docs, which has a column text; columns named so are replaced, others are kept.

    `und` with score 0 if the text is null or has no letter (or nothing was learned). The score is the sum of the log
    probabilities of the document's positions, divided by the square root of their number, as a share of all languages';
    of equal languages the first by name is taken. Equal texts get equal results, and texts of any length are read whole.
    """
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_predict(model, docs.columns.index("text")), schema)


def learn_from(docs: DataFrame) -> DataFrame:
    """The rows a model may see: crc32 of the doc_id as text is no multiple of 5, or there is no doc_id."""
    return docs.filter(~held_out())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document. Null ids are not held out; repeated rows are each returned."""
    docs = read_table(spark, sf_dir, "documents")
    model = train_on(learn_from(docs))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
