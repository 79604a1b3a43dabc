"""The numbered operators against brute force, on a small table with every awkward case."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.llm import decontaminate, jaccard_join, language_id, line_dedup, packing, pii, quality_rules, secret_scan, substring_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, version string, n_words string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
BLANK = "[^\x20\x09-\x0d]+"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(0, 50)) for i in rng.integers(0, len(WORDS), n))


def rows():
    a, b = prose(1, 300), prose(2, 120)
    near = a.split()
    near[150] = "changed"
    texts = [a, a, b, " ".join(near), prose(3, 40) + " " + b[:400] + "\nA shared line of text\n" + prose(4, 30), "a SHARED line of text \n\nx\nA shared line of text", "", None, " \t\n", "one", "One",
             "two words", prose(5, 9), prose(5, 10), "é ß 中文 ​ word \x0b\x0cx", prose(6, 9000), a[:900], "dup dup dup dup dup dup dup dup dup dup dup dup " * 9, "a<|endoftext|>b <|startoftext|> It's 'S ５ e\u0301 ǅ İ", "$$$ ### *** " * 20 + prose(7, 20)]
    out = [(i * 3 + 1, t, "en" if i % 2 else None, "s" if i % 3 else None, 0, "x", "y", "z") for i, t in enumerate(texts)]
    # a repeated row, an id with two texts, null ids
    return out + [out[4], (1, "one", "en", None, 0, "x", "y", "z"), (None, a, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_doc():
    """(row, doc key): null ids are one document behind all others."""
    return [(r, r[0] if r[0] is not None else 1 << 63) for r in rows()]


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_substring_dedup(docs, nothing):
    first = {}
    cut = [(r, k, re.findall(BLANK, r[1] or "")) for r, k in by_doc()]
    for _, k, w in cut:
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, k), k)
    want = []
    for r, k, w in cut:
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k for j in range(i, i + 13)}
        want.append((r[0], len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    same(substring_dedup.dedup_substrings(docs, with_text=False).collect(), want)
    same(substring_dedup.dedup_substrings(docs, with_text=False, hot_share=1e-9, sample=1.0).collect(), want)
    assert substring_dedup.dedup_substrings(nothing).count() == 0


@pytest.mark.parametrize("hot_share", [1.0, 1e-9])
def test_substring_dedup_of_phrases_repeated_in_one_document(spark, hot_share):
    """A document of one phrase over and over, rows without an id that hold it too, and branches of it."""
    phrase = [f"w{i}" for i in range(17)]
    texts = [(5, phrase * 40 + ["end"]), (7, ["x", *phrase * 3]), (None, phrase * 2), (None, ["y", *phrase, "z"]), (None, [f"v{i}" for i in range(20)] * 3), (9, phrase[3:] + phrase[:9] + ["q"]), (5, ["other", *phrase])]
    first = {}
    for k, w in texts:
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, 1 << 63), 1 << 63 if k is None else k)
    want = []
    for k, w in texts:
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < (1 << 63 if k is None else k) for j in range(i, i + 13)}
        want.append((k, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts], "doc_id long, text string")
    same(substring_dedup.dedup_substrings(df, with_text=False, hot_share=hot_share, sample=1.0).collect(), want)


def test_line_dedup(docs, nothing):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(lower)
    first = {}
    for r, k in by_doc():
        for x in (r[1] or "").split("\n"):
            first[key(x)] = min(first.get(key(x), k), k)
    want = []
    for r, k in by_doc():
        lines = (r[1] or "").split("\n")
        left = [x for x in lines if len(key(x)) < 10 or first[key(x)] >= k]
        want.append((r[0], len(lines), len(lines) - len(left), sha("\n".join(left))))
    for batches in (1, 4):
        same(line_dedup.dedup_lines(docs, batches=batches).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect(), want)
    assert line_dedup.dedup_lines(nothing).count() == 0


def shingles(text, width):
    w = re.findall(BLANK, (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_join(docs, nothing, width, percent):
    sets = [(r, k, shingles(r[1], width)) for r, k in by_doc()]
    root = {k: k for _, k, _ in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for _, a, s in sets:
        for _, b, t in sets:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = [(r[0], len(s), find(k) if find(k) < 1 << 63 else None) for r, k, s in sets]
    same(jaccard_join.jaccard_join(docs, width=width, percent=percent).select("doc_id", "n_shingles", "component_id").collect(), want)
    assert jaccard_join.jaccard_join(nothing).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_signatures_never_miss(percent):
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
    tried = 0
    for n in (1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 14, 19, 25, 40, 77, 120, 200, 410, 900, 2500):
        for _ in range(40 if n < 500 else 10):
            s = np.unique(draw(n))
            # as different as two similar sets can be, or nearly: lost, gained or both
            lost, gained = rng.integers(0, n * (100 - percent) // percent + 2, 2)
            t = np.unique(np.concatenate([s[lost:], draw(gained)]))
            both = len(np.intersect1d(s, t))
            if len(t) and 100 * both >= percent * (len(s) + len(t) - both):
                tried += 1
                assert set(jaccard_join.signatures(s, percent).tolist()) & set(jaccard_join.signatures(t, percent).tolist())
    assert tried > 150


def test_signatures_of_unlike_sets_differ():
    rng = np.random.default_rng(4)
    made = [set(jaccard_join.signatures(np.unique(rng.integers(0, 1 << 63, 300 + i % 20, dtype=np.int64).astype(np.uint64)), 80).tolist()) for i in range(200)]
    assert sum(len(a & b) for i, a in enumerate(made) for b in made[:i]) < 400


def test_decontaminate_by_items_without_id(spark):
    a, b = prose(21, 30), prose(22, 30)
    docs = spark.createDataFrame([(1, a), (2, b), (3, a + " " + b), (4, prose(23, 30))], "doc_id long, text string")
    bench = spark.createDataFrame([(None, a), (None, a), (7, b)], "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench).select("doc_id", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    same(got, [(1, 30, 1, sha(""), True), (2, 30, 1, sha("7"), True), (3, 60, 2, sha("7"), True), (4, 0, 0, sha(""), False)])


@pytest.mark.parametrize("small", [True, False])
def test_decontaminate(spark, docs, nothing, monkeypatch, small):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 10**6 if small else -1)
    text = prose(1, 300).split()
    items = [(1, " ".join(text[20:45]).upper()), (2, "one"), (3, "TWO-words"), (4, ""), (5, None), (6, prose(5, 9)), (7, " ".join(text[20:40])), (12, "nowhere at all to be found in any of these documents ever")]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: re.findall(pattern, (t or "").translate(lower))
    want = []
    for r, _ in by_doc():
        w, hit, named = cut(r[1]), set(), set()
        for item, t in items:
            v = cut(t)
            n = min(10, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    named.add(str(item))
        want.append((r[0], len(w), len(hit), len(named), sha(",".join(sorted(named))), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    same(decontaminate.decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect(), want)
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    assert not decontaminate.decontaminate(docs, bench.limit(0)).filter("contaminated").count()


def test_packing(docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    got = packing.pack(packing.tokenize(docs, path, capacity=64, with_ids=True), capacity=64).collect()
    want = Counter()
    for r in rows():
        ids = [*coder.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for p in range(-(-len(ids) // 64)):
            cut = np.array(ids[p * 64 : p * 64 + 64], "<u4").tobytes()
            want[r[0], p, p * 64, len(cut) // 4, zlib.crc32(cut), cut] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(r["length"] for r in got)
    assert len(places) <= -(-total // 64) + 2
    assert packing.pack(packing.tokenize(nothing, path)).count() == 0


def test_packing_is_near_best_fit_decreasing():
    rng = np.random.default_rng(1)
    sizes = np.minimum(2048, rng.lognormal(6.3, 0.8, 20_000).astype(int) + 1)
    plan = packing.best_fit_rounds(dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)))), 2048)
    used = max(q + n for _, _, n, q, _ in plan)
    assert used <= 1.01 * -(-sizes.sum() // 2048)
    assert packing.best_fit_rounds({}, 2048) == []


def test_quality_rules(docs, nothing):
    want = []
    for r in rows():
        w = re.findall(BLANK, r[1] or "")
        lines = [x for x in (r[1] or "").split("\n") if re.search(BLANK, x)]
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r[1] or "")), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)))
    got = quality_rules.quality_filter(docs, least_docs=5).collect()
    same([tuple(r)[:7] for r in got], want)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert [r["kept"] for r in got if r["n_symbols"] == 180] == [False]
    assert quality_rules.quality_filter(nothing).count() == 0


def test_quality_sketches_merge(spark):
    rows_ = [(f"l{i % 2}", f"s{i % 3}", *[i * 7 % 997] * 5) for i in range(600)]
    names = ["lang", "source", *quality_rules.METRICS]
    whole, left, right = (quality_rules.sketches(spark.createDataFrame(x, names)) for x in (rows_, rows_[:250], rows_[250:]))
    for keys in (["lang"], []):
        merge = lambda df: sorted(map(tuple, quality_rules.merged(df, keys).collect()))
        assert merge(whole) == merge(left.unionAll(right))
    low = {r["value"]: r["b"] for r in spark.range(5000).selectExpr("id AS value").withColumn("b", quality_rules.bucket(quality_rules.F.col("value"))).collect()}
    assert all(b <= v and (v - b) * 16 <= v for v, b in low.items()) and all(low[v] == v for v in range(32))


def test_language_id_gradients_and_accuracy(spark, nothing):
    model = language_id.BiGru(["a", "b"], hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = language_id.encode([b"hello you", b"welt", b"ab", b"z"]), np.array([0, 1, 0, 1])
    _, g = model.gradients(x, y)
    for k, at in (("Ezf", (ord("e"), 1)), ("Erb", (ord("l"), 2)), ("Ecf", (ord("o"), 0)), ("Uzf", (1, 2)), ("Urb", (2, 1)), ("Ucb", (0, 2)), ("W", (3, 1)), ("c", (0,))):
        old, eps = model.p[k][at], 1e-4
        model.p[k][at] = old + eps
        up, _ = model.gradients(x, y)
        model.p[k][at] = old - eps
        down, _ = model.gradients(x, y)
        model.p[k][at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-6
    assert not g["Ezf"][0].any()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train_on(language_id.learn_from(docs), train_docs=200, steps=150)
    got = language_id.identify(docs.select("doc_id", "lang", language_id.held_out().alias("h"), "text"), model).filter("h").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9 and all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(None,), ("",), ("123 !",), ("a\0b",)], "text string")
    assert [r["lang_pred"] == "und" for r in language_id.identify(odd, model).collect()] == [True, True, True, False]
    assert language_id.train_on(nothing) is None
    assert [r["lang_pred"] for r in language_id.identify(odd, None).collect()] == ["und"] * 4


def read_slowly(model, text):
    """Log probabilities summed over all positions, one position after another."""
    data, out = [b or 32 for b in text], 0.0
    p, size = model.p, language_id.SEGMENT

    def pass_over(direction, part):
        state = np.zeros(model.hidden)
        for b in part:
            z, r = (1 / (1 + np.exp(-2 * (p[f"E{g}{direction}"][b] + state @ p[f"U{g}{direction}"]))) for g in "zr")
            state = (1 - z) * state + z * np.tanh(p[f"Ec{direction}"][b] + (2 * r * state) @ p[f"Uc{direction}"])
            yield state

    for a in range(0, len(data), size):
        b = min(a + size, len(data))
        low, high = max(0, a - language_id.CONTEXT), min(len(data), b + language_id.CONTEXT)
        f = list(pass_over("f", data[low:b]))[a - low :]
        w = list(pass_over("b", data[a:high][::-1]))[::-1][: b - a]
        for x, y in zip(f, w):
            logits = np.concatenate([x, y]) @ p["W"] + p["c"]
            out = out + logits - np.log(np.exp(logits).sum())
    return out


def test_language_id_reads_whole_documents(spark):
    model = language_id.BiGru(["a", "b", "c"], hidden=4)
    texts = ["x", "é\0 中", prose(1, 9), prose(2, 40), prose(3, 400), "z" * 113, "y" * 111 + "é", prose(5, 3000), prose(2, 40)]
    rows_ = [(i % 3 or None, t, "x", 1.0, i) for i, t in enumerate(texts)] + [(1, None, None, None, None), (1, " 1", None, None, None)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang_pred string, score double, doc long")
    for parts in (1, 4):
        got = language_id.identify(df.repartition(parts), model).collect()
        assert len(got) == len(rows_)
        for r in got:
            if r["doc"] is None:
                assert (r["lang_pred"], r["score"]) == ("und", 0.0)
                continue
            total = read_slowly(model, r["text"].encode())
            p = np.exp((total - total.max()) / np.sqrt(len(r["text"].encode())))
            assert r["lang_pred"] == "abc"[total.argmax()] and abs(r["score"] - p.max() / p.sum()) < 1e-3


def test_language_id_draws_bounded_windows(spark):
    many = [(i, prose(i, 60), f"l{i % 3}") for i in range(300)] + [(7, "w " * 50, "l0")] * 200 + [(None, "q " * 40, None), (None, "1 2", "l9"), (None, None, "l9"), (3, "", "l9")]
    df = spark.createDataFrame(many, "doc_id long, text string, lang string")
    got = language_id.training_windows(df, train_docs=40, windows=5, width=20)
    assert sorted(got) == ["l0", "l1", "l2"]
    assert all(0 < len(v) <= 50 and all(len(p) <= 20 for p in v) for v in got.values())
    assert got == language_id.training_windows(df.repartition(7), train_docs=40, windows=5, width=20)


def url_brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.Example.org/es/1", "https://x.org", "https://x.org?q=/", "http://example.org/en/12?x", "ftp://b.com/de/é#f", "http://c.com/fr/", "http://d.net/de/9", "http://", "a://b://c/d", "http://notexample.org/es/", "http://c.com/fr/", "http://org/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://q.net/fr/", None), (3, urls[3], "h")], "page_id long, url string, html string").select("page_id", "url")
    got = url_filter.filter_urls(pages).collect()
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == Counter((i, *url_brute(u)[:3]) for i, u in [*enumerate(urls), (None, "http://q.net/fr/"), (3, urls[3])])
    for r in got:
        known = [url_brute(u)[3] for u in urls if url_brute(u)[2] and url_brute(u)[:2] == (r["host"], r["path"])]
        assert r["verdict"] in ("allow", "block") and (not known or known[0] == r["verdict"])
    assert {r["verdict"] for r in url_filter.filter_urls(pages, rules=[]).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_brute(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    spans = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
    return spans


def test_pii(spark, docs, nothing):
    texts = ["é a@b.c_x@y.z, a@b.cd.e@f.g x@@y.z a@b. ..@x.y +1 (988) 555-2485+49 30 1234567 1.2.3.4.5.6.7.8 999.1.1.1 001.2.3.255", "9" * 30_000 + " " + "a" * 30_000 + "@ " + "1" * 5000 + "@x.y", None, "",
             "4111 1111 1111 1111 and 4111111111111112", "call (988) 555-2485 or joe [at] mail [dot] com"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[4]), (None, texts[0])], "doc_id long, text string")
    got = {(r["doc_id"], r["base_sha256"]): r for r in pii.find_pii(df).collect()}
    for i, t in [*enumerate(texts), (0, texts[4]), (None, texts[0])]:
        spans = pii_brute(t)
        r = got[i, sha(",".join(spans))]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k + ":") for s in spans) for k in PATTERNS]
        assert r["spans"].split(",")[: len(spans)] == (spans or [""])[: len(spans)]
    assert pii.find_pii(docs).count() == len(rows()) and pii.find_pii(nothing).count() == 0


def test_pii_em_finds_the_good_labeler():
    share, rates = pii.reliabilities([((1, 1, 0), 40), ((1, 1, 1), 40), ((0, 0, 0), 40), ((0, 0, 1), 40), ((1, -1, 1), 5)])
    assert rates[0][0] > 0.9 > 0.6 > rates[2][0] and 0.4 < share < 0.6


def test_secret_scan(spark, nothing):
    rng = np.random.default_rng(0)
    hexa = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    texts = [f'{prose(i, 20)} token = "{hexa(40)}" {prose(i, 5)}' if i % 3 == 0 else f"{prose(i, 20)} incomprehensibilities-{WORDS[i % 20]}" for i in range(60)] + [None, "", "x" * 5000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = secret_scan.scan(df).collect()
    assert {r["doc_id"] for r in got} == {i for i in range(60) if i % 3 == 0}
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == r["value"] for r in got)
    assert secret_scan.scan(nothing).count() == 0


def test_secret_scan_finds_short_and_odd_values(spark):
    secrets = ["S3cr3t99", "aB3$kd9!Qz.7", "eyJhbGci.eyJzdWIi.x9", "four words of it", "é#1"]
    texts = [f'{prose(1, 9)} password = "{v}" {prose(2, 5)}' for v in secrets] + ["my_database_password: S3cr3t99, and", "https://a.org/p?n=1&token=S3cr3t99&b=2", '{"pwd": "S3cr3t99"}', "cmd='--secret=S3cr3t99'"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {(r["doc_id"], r["value"]) for r in secret_scan.scan(df).collect()}
    assert got == set(enumerate(secrets + ["S3cr3t99"] * 4))


def test_secret_scan_learns_from_labelled_findings_only(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(secret_scan, "train", lambda labelled: seen.extend(labelled.collect()))
    texts = ['token = "Zx81kQpL7mN2"', "sha256: " + "ab12" * 16, "id 123e4567-e89b-12d3-a456-426614174000", "in /usr/local/share/doc", "unknown Qz81-kQpL7-mN2xx"]
    secret_scan.scan(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string"))
    assert {(r["doc"], r["label"]) for r in seen} == {(0, 1.0), (1, 0.0), (2, 0.0), (3, 0.0)}


def test_pii_adds_what_the_base_lacks(spark):
    texts = []
    for i in range(60):
        texts += [f"call ({200 + i}) 555-{1000 + i} today, or mail a{i}@b.org and +49 30 12345{i:02d}", f"{prose(i, 8)} version {i}.{i + 100}.{i + 300} and no. {i} here", f"contact joe{i} [at] mail [dot] com, phone 415-555-{2000 + i}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}
    planted = [i for i in got if i % 3 != 1]
    caught = [i for i in planted if "other_" in got[i]]
    assert len(caught) >= 0.9 * len(planted)
    assert sum("other_" in got[i] for i in got if i % 3 == 1) <= 2
    for i in caught:
        for kind, a, b in (x.split(":") for x in got[i].split(",")):
            assert kind in [*pii.BASE, *pii.EXTRA] and 0 <= int(a) < int(b) <= len(texts[i])


def test_clashing_columns(spark):
    row = (1, prose(1, 30) + ' token = "S3cr3t99xy12"', "en", "s", "http://a.org/x", 1, 0.5, "v", "r")
    names = "doc_id long, text string, lang string, source string, url string, page_id long, score double, version string, rule string, doc string, start string, kind string, host string, path string, verdict string"
    df = spark.createDataFrame([(*row, "a", "b", "c", "d", "e", "f")] * 2, names)
    assert secret_scan.scan(df).count() == 1
    assert pii.find_pii(df).count() == 2
    assert url_filter.filter_urls(df).count() == 2
    assert quality_rules.quality_filter(df).count() == 2
    assert [r["lang_pred"] for r in language_id.identify(df, None).collect()] == ["und"] * 2
    pieces = packing.tokenize(df, __import__("public_tokenizers").path("word_bpe_49k.json")).selectExpr("*", "1 AS part", "2 AS local", "3 AS `rank`", "4 AS runs", "5 AS run", "6 AS before", "7 AS offset")
    assert {"part", "local", "rank", "runs", "run", "before"} <= set(packing.pack(pieces).columns) and packing.pack(pieces).select("part", "run").distinct().count() == 1


def test_secret_scan_of_odd_rows(spark, nothing):
    texts = [None, "", "x" * 200_000, 'password = "S3cr3t99"', 'password = "S3cr3t99"', "\n"]
    df = spark.createDataFrame([(i // 2 if i else None, t, None) for i, t in enumerate(texts)] + [(2, texts[4], None)], "doc_id long, text string, source string")
    got = secret_scan.scan(df).collect()
    assert {(r["doc_id"], r["value"]) for r in got} == {(1, "S3cr3t99"), (2, "S3cr3t99")} and len(got) == 2


def test_url_filter_of_long_and_equal_urls(spark):
    urls = ["http://x.net/" + "a" * 100_000, "http://x.net/a", "http://x.net/a", "http://b.org/fr/x", "http://c.com/de/y"]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert len(got) == 5 and len({r["verdict"] for r in got if r["host"] == "x.net" and len(r["path"]) < 9}) == 1


def witten_bell(urls, order):
    """The probability of a character after a context, by the book, from the texts of one class."""
    seen = Counter()
    for t in urls:
        t = "\x02" * order + t + "\x03"
        for i in range(order, len(t)):
            for k in range(order + 1):
                seen[t[i - k : i + 1]] += 1

    def p(context, c):
        low = p(context[1:], c) if context else 1 / url_filter.SYMBOLS
        after = {g[-1]: n for g, n in seen.items() if len(g) == len(context) + 1 and g.startswith(context)}
        n, t = sum(after.values()), len(after)
        return (after.get(c, 0) + t * low) / (n + t) if n else low

    return p


def url_score(text, allow, block, order):
    t = "\x02" * order + text + "\x03"
    ratios = [math.log(allow(t[i - order : i], t[i])) - math.log(block(t[i - order : i], t[i])) for i in range(order, len(t))]
    return sum(ratios) / len(ratios)


@pytest.mark.parametrize("many", [6, 1])
def test_url_models_and_threshold_against_plain_counts(spark, many):
    """Scores of all URLs, and the verdicts by a threshold from folds that the other fold's models score; 0 where a fold lacks a class."""
    rules, order = [("allow", "good", "/"), ("block", "bad", "/")], 2
    texts = [f"{host}/{a}?{b}" for host, a, b in [("good", "ab" * k, f"q={k}") for k in range(many)] + [("bad", "xy" * k, f"p#{k}") for k in range(many)]]
    texts += ["new/ab?q=1", "new/xy?p#1", "new/xy?p#2", "new/", "new/axby", "ne\u00e9/ab"]
    urls = ["http://" + t for t in texts] + ["good/ab", ""]
    texts += ["good/ab", ""]
    kind = ["allow"] * many + ["block"] * many + [None] * 8

    def fold(t, u):
        host, path = url_brute(u)[:2]
        return zlib.crc32(hashlib.md5(f"{len(host.encode())}\n{len(path.encode())}\n{t}".encode()).hexdigest().encode()) % 2

    folds = [fold(t, u) for t, u in zip(texts, urls)]
    of = lambda v, out=None: witten_bell([t for t, k, f in zip(texts, kind, folds) if k == v and f != out], order)
    allow, block = of("allow"), of("block")
    want = [url_score(t, allow, block, order) for t in texts]
    cut = 0.0
    if len({(k, f) for k, f in zip(kind, folds) if k}) == 4:
        models = {f: (of("allow", f), of("block", f)) for f in (0, 1)}
        held = {v: [url_score(t, *models[f], order) for t, k, f in zip(texts, kind, folds) if k == v] for v in ("allow", "block")}
        (a, sa), (b, sb) = ((np.mean(held[v]), np.std(held[v])) for v in ("allow", "block"))
        cut = (a * sb + b * sa) / (sa + sb)
    else:
        assert many == 1
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules, order=order).collect()}
    assert [got[i]["score"] for i in range(len(urls))] == pytest.approx(want)
    assert [got[i]["verdict"] for i in range(len(urls))] == [k or ("allow" if w >= cut else "block") for k, w in zip(kind, want)]
