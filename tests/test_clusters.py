"""TF-IDF and vector clusters against plain loops."""

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.operators import clusters as X
from textloom.operators import tfidf as W
from textloom.operators import vector_index as V


def greedy(ids, linked):
    """(leader, members) in order: a leader is in no earlier group; members may be."""
    used, out = set(), []
    for i, a in enumerate(ids):
        if a not in used:
            group = [b for b in ids[i + 1 :] if linked(a, b)]
            if group:
                used |= {a, *group}
                out.append((a, group))
    return out


@pytest.mark.parametrize("at_once", [10**6, 0])
def test_leaders_in_one_call_and_in_rounds(spark, monkeypatch, at_once):
    monkeypatch.setattr(X, "SETTLE_PAIRS", at_once)
    rng = np.random.default_rng(3)
    pairs = {(b, *sorted(map(int, rng.choice(40, 2, replace=False)))) for b in (1, 2) for _ in range(60)} | {(3, i, i + 1) for i in range(9)}
    got = defaultdict(set)
    for r in X.leaders(spark.createDataFrame(list(pairs), "batch int, a long, b long")).collect():
        got[r["batch"], r["leader"]].add(r["member"])
    assert got == {(k, a): set(g) for k in (1, 2, 3) for a, g in greedy(list(range(40)), lambda a, b: (k, a, b) in pairs)}  # noqa: B023


def slow_tfidf(texts, features):
    def terms(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", (t or "").lower()) if not unicodedata.combining(c))
        w = re.findall(r"\b\w\w+\b", t)
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    counts = {i: Counter(terms(t)) for i, t in texts.items()}
    total = Counter()
    for c in counts.values():
        total.update(c)
    kept = sorted(total, key=lambda t: (-total[t], t))[:features]
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in kept}
    out = {}
    for i, c in counts.items():
        v = {t: (1 + math.log(c[t])) * idf[t] for t in c if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        out[i] = {t: x / norm for t, x in v.items()}
    return out


def batch_texts(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(60)]
    base = [[words[min(int(x), 59)] for x in rng.exponential(12, rng.integers(4, 60))] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(2):
            c = [words[int(rng.integers(60))] if rng.random() < 0.12 else w for w in b]
            texts.append(" ".join(c))
    texts += [texts[0], texts[0].upper(), texts[3], "", None, "a b c", "Été été ete"] + [texts[5]] * 9
    return {i * 3: t for i, t in enumerate(rng.permutation(np.array(texts, dtype=object)).tolist())}


@pytest.mark.parametrize("features,whole", [(5000, 0), (40, 0), (40, 2000)])
def test_tfidf_against_all_pairs(spark, monkeypatch, features, whole):
    monkeypatch.setattr(W, "WHOLE_BATCH", whole)
    batches = {b: batch_texts(b) for b in (1, 2)}
    rows = [(b, i, t, "x") for b, texts in batches.items() for i, t in texts.items()]
    docs = spark.createDataFrame(rows + rows[:3] + [(1, None, "no id", "x")], "batch int, id long, text string, rep string")
    got_pairs = {(r["batch"], r["a"], r["b"]): r["similarity"] for r in W.tfidf_pairs(docs, features=features).collect()}
    got = defaultdict(set)
    for r in W.tfidf_clusters(docs, features=features).collect():
        got[r["batch"], r["leader"], r["size"], r["similarity_score"]].add(r["id"])
    want, pairs = {}, {}
    for b, texts in batches.items():
        v = slow_tfidf(texts, features)
        dot = {(i, j): sum(x * v[j].get(t, 0) for t, x in v[i].items()) for i in v for j in v}
        first = {}
        for i in sorted(texts):
            first.setdefault(texts[i] or "", i)
        pairs |= {(b, i, j): round(dot[i, j], 9) for i in first.values() for j in first.values() if i < j and dot[i, j] >= 0.6}
        for a, group in greedy(sorted(texts), lambda x, y: dot[x, y] >= 0.6 - 1e-9):  # noqa: B023
            g = [a, *group]
            mean = sum(dot[x, y] for n, x in enumerate(g) for y in g[n + 1 :]) / (len(g) * (len(g) - 1) / 2)
            want[b, a, len(g), math.floor(mean * 1e3 + 0.5 + 1e-9) / 1e3] = set(g)
    assert got == want and len(want) > 5
    assert got_pairs.keys() == pairs.keys() and all(abs(got_pairs[k] - pairs[k]) < 1e-8 for k in pairs)


def test_batch_report_of_the_usual_cases(spark):
    same = "Amazing product. Great quality. Highly recommend."
    texts = [same, same, "The battery lasted 9 hours and the screen is bright at 500 nits.", "", None]
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "batch int, id long, text string")
    got = defaultdict(set)
    for r in W.batch_report(rows).collect():
        got[r["type"], r["leader"], r["detail"]].add(r["id"])
    assert got == {("structural_template", 0, "2,2,2"): {0, 1}, ("structural_template", 3, ""): {3, 4}, ("repeated_opening", 0, "amazing product great quality highly"): {0, 1}, ("tfidf_similarity", 0, "1.000"): {0, 1}}
    different = ["Changed auth/session.ts to rotate tokens every 15 minutes because of replay risk.", "The XL hoodie shrank 2 cm after first wash but zipper stayed smooth.", "Decision: ship importer Friday. Owner: Riya."]
    assert W.batch_report(spark.createDataFrame([(0, i, t) for i, t in enumerate(different)], "batch int, id long, text string")).collect() == []
    assert W.batch_report(rows.limit(0)).collect() == []


# ---- vectors -----------------------------------------------------------------------------------------------------------


def some_vectors():
    rng = np.random.default_rng(11)
    base = rng.normal(size=(20, 8))
    v = np.concatenate([base[rng.integers(0, 20, 260)] + rng.normal(size=(260, 8)) * 0.45, np.repeat(base[:1], 40, 0), np.repeat(base[1:2], 3, 0)])
    return {i * 2 + 1: x for i, x in enumerate(rng.permutation(v))}


def slow_neighbours(vectors, least, k):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = np.round(m @ m.T, 6)
    return {a: [(ids[j], sim[i, j]) for j in sorted(range(len(ids)), key=lambda j: (-sim[i, j], j)) if j != i and sim[i, j] >= least][:k] for i, a in enumerate(ids)}  # noqa: B023


@pytest.mark.parametrize("least,k,cells,block", [(0.6, 15, 1, 2048), (0.6, 15, 9, 32), (0.9, 3, 20, 16), (-1.0, 2, 5, 2048)])
def test_neighbours_and_clusters_against_loops(spark, monkeypatch, least, k, cells, block):
    monkeypatch.setattr(V, "BLOCK_ROWS", block)
    vectors = some_vectors()
    odd = [(2, None), (4, []), (6, [0.0] * 8), (8, [1.0, 2.0]), (10, [float("nan")] * 8), (None, [1.0] * 8), (1, [float(x) for x in vectors[1]])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()] + odd, "vec_id long, embedding array<double>")
    near = V.neighbours(df, least, k, cells=cells)
    got = defaultdict(list)
    for r in sorted(near.collect(), key=lambda r: (r["a"], r["rank"])):
        got[r["a"]].append((r["b"], r["sim"]))
    want = {a: x for a, x in slow_neighbours(vectors, least, k).items() if x}
    assert got == want
    used, groups = set(), {}
    for a in sorted(vectors):
        if a not in used:
            group = [(b, s) for b, s in want.get(a, []) if b not in used]
            if group:
                used |= {a, *(b for b, _ in group)}
                groups[a] = ({a, *(b for b, _ in group)}, sum(s for _, s in group) / len(group))
    found = defaultdict(set)
    for r in V.vector_clusters(near).collect():
        found[r["leader"]].add(r["vec_id"])
        assert r["size"] == len(groups[r["leader"]][0]) and abs(r["similarity_score"] - groups[r["leader"]][1]) < 1e-3
    assert found == {a: g for a, (g, _) in groups.items()}


def test_a_vector_without_company_can_be_taken_later(spark):
    """1 has only 2, which 0 took; then 5, which has 1 in its list, takes it, and so 7 cannot."""
    near = spark.createDataFrame([(0, 2, 1, 0.9), (1, 2, 1, 0.8), (5, 1, 1, 0.7), (7, 5, 1, 0.9), (7, 1, 2, 0.7), (9, 7, 1, 0.8)], "a long, b long, rank int, sim double")
    got = {(r["leader"], r["vec_id"]) for r in V.vector_clusters(near).collect()}
    assert got == {(0, 0), (0, 2), (5, 5), (5, 1), (9, 9), (9, 7)}


def test_recall_of_few_cells(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    exact, fast = ({(r["a"], r["b"]) for r in V.neighbours(df, 0.3, 15, probes, cells=16).collect()} for probes in (None, 10))
    assert fast <= exact and len(fast) >= 0.9 * len(exact)


def test_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 64)
    vectors = some_vectors()
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(V.search(df, df.filter("vec_id % 10 = 1"), 4).collect()):
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    assert {a: [b for _, b in sorted(x)] for a, x in got.items()} == {a: [b for b, _ in x] for a, x in slow_neighbours(vectors, -2, 4).items() if a % 10 == 1}


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert V.neighbours(none).collect() == [] and V.vector_clusters(V.neighbours(none)).collect() == [] and V.search(none, none, 3).collect() == []


@pytest.mark.parametrize("at_once", [10**6, 0])
def test_a_leader_that_has_only_copies_after_it(spark, monkeypatch, at_once):
    monkeypatch.setattr(X, "SETTLE_PAIRS", at_once)
    one, other = (" ".join(f"{s}word{i}" for i in range(12)) for s in "ab")
    texts = [(0, 1, one), (0, 2, f"{one} {other}"), (0, 3, other), (0, 4, other), (0, 5, f"{one} {other}")]
    got = defaultdict(list)
    for r in W.tfidf_clusters(spark.createDataFrame(texts, "batch int, id long, text string")).collect():
        got[r["leader"]].append((r["id"], r["size"]))
    # 2 is similar to both; 3 leads, as only 1 leads before it, and its group are a copy and a copy of 2
    assert {k: sorted(v) for k, v in got.items()} == {1: [(1, 3), (2, 3), (5, 3)], 3: [(3, 3), (4, 3), (5, 3)]}


def test_cells_share_blocks(spark, monkeypatch):
    """What is met with every block is the same however cells are dealt to blocks, and many small cells are one block."""
    assert V._blocks([3, 4, 9, 25, 2, 5], 10, True) == [(0, 1), (0, 1), (1, 1), (2, 3), (5, 1), (5, 1)] and V._blocks([3, 25, 2], 10, False) == [(0, 1), (1, 3), (4, 1)]
    draw = np.random.default_rng(3)
    points = draw.normal(size=(400, 8)).round(1)
    points[50:60] = points[0]
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    met = []
    search = V.block_search
    monkeypatch.setattr(V, "block_search", lambda q, v, pairs, *rest: (met.append(pairs.count()), search(q, v, pairs, *rest))[1])
    rows = lambda **more: sorted(map(tuple, V.neighbours(df, 0.5, 5, **more).collect()))
    many = rows(cells=12)
    monkeypatch.setattr(V, "GROUP_ROWS", 40)
    assert rows(cells=12) == many and met[0] == 1 and met[1] > 9
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 6)
    want = [(i, j, r + 1) for i in range(400) for r, j in enumerate(sorted((j for j in range(400) if j != i and sim[i, j] >= 0.5), key=lambda j: (-sim[i, j], j))[:5])]
    assert [r[:3] for r in many] == sorted(want)


def test_batches_in_one_task_and_by_the_index(spark, monkeypatch):
    """A batch has the same groups in one task as by the index; a small one shuffles its texts once and writes no tables of terms."""
    draw = random.Random(11)
    base = [" ".join(draw.choice("alpha beta gamma delta épsilon zeta eta theta iota kappa".split()) for _ in range(30)) for _ in range(6)]
    texts = [" ".join(w if draw.random() < 0.8 else draw.choice(["new", "old", "1", "of"]) for w in draw.choice(base).split()) for _ in range(50)] + base + base[:3] + ["", None, "..", ""]
    df = spark.createDataFrame([(i % 2, i, t) for i, t in enumerate(texts)] + [(0, 0, texts[0]), (1, None, "x y")], "batch int, id long, text string")
    rows = lambda out: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in out.collect())
    made = []
    monkeypatch.setattr(W, "written", lambda d, name, real=W.written: (made.append(name), real(d, name))[1])
    pairs, groups = rows(W.tfidf_pairs(df, 0.5, 40)), rows(W.tfidf_clusters(df, 0.5, 40))
    assert made == ["large", "large"] and len(pairs) > 20 and len(groups) > 10
    monkeypatch.setattr(W, "WHOLE_BATCH", 3)
    assert rows(W.tfidf_pairs(df, 0.5, 40)) == pairs and rows(W.tfidf_clusters(df, 0.5, 40)) == groups
