"""Each operator against a brute-force version on the smallest tables, and on a table of odd rows."""

import base64
import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import byte_bpe, divergence, langid, mixing, nearest, ppm, pretokens, queries, sequences, vptree, wrapper

SF = "/root/testdata/sf0.001"
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "Hello  world again"), (4, "Hello  world again"), (None, "no id here"), (5, "x" * 300_000), (6, "word " * 20_000), (7, "<|endoftext|> é \U0001f600 'S don't 12345"), (8, "a\nb\na\n\na b c a b c a b c"), (9, "…—" * 50), (10, "%% $$ ## 100|200 <b>&</b>")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i else None, "s", len(t or ""), 1, "block", "f") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block int, told string, f string")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))


def held(i, n, r):
    return i is not None and zlib.crc32(str(i).encode()) % n == r


def ppm_brute(rows, order=5):
    """Counts by context in dictionaries; a symbol is searched from the longest context down."""
    counts, vocab = defaultdict(Counter), Counter()
    fill = b"\xff" * order
    stream = lambda t: fill + (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) + b"\xff"
    for i, t in rows:
        if not held(i, 7, 2):
            vocab.update(words(t))
            vocab[b"\n"] += 1
            s = stream(t)
            for k in range(order, len(s)):
                for n in range(order + 1):
                    counts[s[k - n : k]][s[k]] += 1
    out = []
    for i, t in rows:
        w, score, s = words(t), 0.0, stream(t)
        for k in range(order, len(s)):
            out_of = set()
            for n in range(order, -1, -1):
                left = {c: x for c, x in counts.get(s[k - n : k], {}).items() if c not in out_of}
                total = sum(left.values())
                if s[k] in left:
                    score += math.log10((left[s[k]] - ppm.ESCAPE) / total)
                    break
                if total:
                    score += math.log10(ppm.ESCAPE * len(left) / total)
                out_of |= set(left)
            else:
                score -= math.log10(256 - len(out_of))
        n, v = sum(vocab.values()), sum(c > 0 for c in vocab.values())
        tokens = [*w, b"\n"]
        out.append((i, held(i, 7, 2), len(tokens), sum(vocab[x] > 0 for x in tokens), n, round(sum(math.log10((vocab[x] + 1) / (n + v + 1)) for x in tokens), 4), round(score, 1)))
    return sorted(out, key=str)


def ppm_rows(df, **parameters):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 1)) for r in ppm.ppm_scores(df, **parameters).collect()), key=str)


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:5] == y[:5]
        assert x[5] == pytest.approx(y[5], rel=1e-6, abs=1e-3) and x[6] == pytest.approx(y[6], rel=1e-4, abs=0.2)


def test_ppm(docs, odd):
    some = docs.filter("doc_id < 60")
    want = ppm_brute(texts(some))
    close(ppm_rows(some), want)
    close(ppm_rows(some, block_bytes=4000, fan=3), want)  # many blocks, a tree of several levels
    close(ppm_rows(odd), ppm_brute(texts(odd)))


def test_ppm_reads_layout(spark):
    """Texts that differ in white space only have the same base_score, and scores of their own."""
    lines = [(i, "one two\nthree four\n\n  five") for i in range(40)] + [(100, "one two three four five"), (101, "one two\nthree four\n\n  five")]
    got = {r.doc_id: r for r in ppm.ppm_scores(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert got[100].base_score == pytest.approx(got[101].base_score) and got[101].score > got[100].score + 1


def test_token_counts(docs, odd):
    t = Tokenizer.from_file(WORD)
    for df in (docs, odd):
        want = sorted(((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x in texts(df)), key=str)
        assert sorted((tuple(r) for r in pretokens.document_token_counts(df, WORD).collect()), key=str) == want


def test_divergence(docs, odd):
    for df in (docs, odd):
        got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in divergence.quality_verdicts(df).collect()), key=str)
        want = []
        for i, t in texts(df):
            w, t = re.findall(r"[^\x20\x09-\x0D]+", t or ""), t or ""
            n, cover = Counter(zip(w, w[1:], w[2:])), set()
            for k in range(len(w) - 2):
                if n[tuple(w[k : k + 3])] > 1:
                    cover |= {k, k + 1, k + 2}
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
        assert got == sorted(want, key=str)


def test_verdicts(docs, odd):
    """`kept` and both distances from histograms counted in plain Python."""
    chars = lambda t: Counter(next((k for k, c in enumerate((r"[a-z]", r"\p{Lu}", r"\p{L}", r"\p{N}", r"[.,;:!?'\"()-]", r"[|]", r"[#*$%&<>=+~^_/\\@{}\[\]]", r".")) if regex.fullmatch(c, x, regex.S)), 7) for x in t if x not in " \t\n\x0b\x0c\r")
    listed = set(divergence.WORDS) | {w.capitalize() for w in divergence.WORDS}

    def histograms(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = chars(t or "")
        n = Counter(x.lower() if x in listed else None for x in w)
        return np.array([c[k] for k in range(8)], dtype=float), np.array([n[x] for x in (*divergence.WORDS, None)], dtype=float), len(w)

    def distance(p, q):
        p, q = p / max(1, p.sum()), q / max(1, q.sum())
        m = (p + q) / 2
        part = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
        return math.sqrt(max(0, (part(p) + part(q)) / 2))

    for df in (docs, odd):
        rows = df.select("doc_id", "text", "lang").collect()
        found = [histograms(r.text) for r in rows]
        fixed = [[sum((f[k] for f, r in zip(found, rows) if r.lang == x), np.zeros(8 if k == 0 else len(divergence.WORDS) + 1)) for x in divergence.COMMON] for k in (0, 1)]
        want = []
        for r, f in zip(rows, found):
            far = [min(distance(f[k], q) for q in fixed[k]) for k in (0, 1)]
            bad = f[2] >= divergence.LEAST_WORDS and (far[0] > divergence.FAR_CHARS or far[1] > divergence.FAR_WORDS)
            want.append((r.doc_id, bad, round(far[0], 6), round(far[1], 6)))
        got = [(r.doc_id, not r.kept and not r.base_failed, r.kept, r.base_failed, round(r.char_distance, 6), round(r.word_distance, 6)) for r in divergence.quality_verdicts(df).collect()]
        assert sorted(((a, d, e) for a, _, _, _, d, e in got), key=str) == sorted(((a, c, d) for a, _, c, d in want), key=str)
        verdict = {(a, d, e): x for a, x, d, e in want}
        assert all(kept == (not base and not verdict[a, d, e]) for a, _, kept, base, d, e in got)


def test_js_distance(spark):
    d = lambda p, q: spark.range(1).select(divergence.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    assert d([1.0, 0.0], [0.0, 1.0]) == pytest.approx(1) and d([0.5, 0.5], [0.5, 0.5]) == 0


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.language_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    got = {r.doc_id: r for r in langid.language_predictions(odd).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4 and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.language_predictions(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_by_hand(docs, odd):
    """Predictions and posteriors from counts of hashed n-grams in plain Python."""
    bits, smoothing = 16, 0.5

    def grams(t):
        points = [ord(c) for c in f" {t.lower()} "]
        for i in range(len(points)):
            code = 0
            for k in range(min(3, len(points) - i)):
                code = (code + points[i + k] + 1) * 0x9E3779B1 & 0xFFFFFFFF
                code ^= code >> 15
                yield code >> (32 - bits)

    for df in (docs, odd):
        rows = df.select("doc_id", "text", "lang").collect()
        counts = defaultdict(Counter)
        for r in rows:
            if r.text is not None and r.lang is not None and not held(r.doc_id, 5, 0):
                counts[r.lang].update(grams(r.text))
        total = {x: sum(c.values()) + smoothing * (1 << bits) for x, c in counts.items()}
        want = []
        for r in rows:
            lang, score = "und", 0.0
            if r.text is not None and regex.search(r"\p{L}", r.text):
                mine = list(grams(r.text))
                logs = {x: sum(math.log((c[g] + smoothing) / total[x]) for g in mine) for x, c in counts.items()}
                lang = min(logs, key=lambda x: (-logs[x], x))
                score = 1 / sum(math.exp(v - logs[lang]) for v in logs.values())
            want.append((r.doc_id, held(r.doc_id, 5, 0), lang, round(score, 6)))
        got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in langid.language_predictions(df).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_six_hundred_languages(spark, odd):
    """Shards of the matrix change no prediction: of 600 languages with a few words each, in one shard, two and many."""
    rows = [(k, " ".join(f"{chr(0x400 + k)}{chr(97 + (k * j) % 26)}{chr(97 + j % 26)}" for j in range(1, 12)), f"l{k:03}") for k in range(600)]
    df = spark.createDataFrame(rows + [(600 + k, t, lang) for k, t, lang in rows[:40]], "doc_id long, text string, lang string")
    each = 8 << 10
    told = [sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9), round(r.fit, 9)) for r in langid.language_predictions(df, bits=10, most_bytes=n * each).collect()) for n in (600, 512, 100)]
    assert len(told[0]) == 640 and told[0] == told[1] == told[2]
    assert len({r[2] for r in told[0]}) > 400
    several = odd.withColumn("lang", F.concat(F.lit("l"), (F.length("text") % 4).cast("string")))
    one, each_alone = (sorted((str(r.doc_id), r.lang_pred, round(r.score, 9), str(r.fit)[:9]) for r in langid.language_predictions(several, bits=10, most_bytes=n * each).collect()) for n in (9, 1))
    assert one == each_alone and len(one) == len(ODD)


def test_nearest(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    bad = spark.createDataFrame([(100, None), (None, [1.0] * 64), (200, [0.0] * 64), (250, [float("nan")] * 64), (300, [None] * 64)], "vec_id long, embedding array<float>")
    rows = [r for r in v.collect() if r.vec_id not in (100, 200, 250, 300)]
    base = v.filter("vec_id not in (100, 200, 250, 300)").select("vec_id", "embedding")
    twice = base.filter("vec_id = 7").withColumn("vec_id", F.lit(1007).cast("long"))
    got = defaultdict(list)
    for r in sorted(nearest.nearest_vectors(base.union(bad).union(twice)).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    ids = [r.vec_id for r in rows] + [1007]
    m = np.array([r.embedding for r in rows] + [next(r.embedding for r in rows if r.vec_id == 7)], dtype=np.float64)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    near = unit @ unit.T
    want = {q: [i for _, i in sorted((-round(near[k, j], 12), i) for j, i in enumerate(ids) if i != q)[:5]] for k, q in enumerate(ids) if q % 50 == 0}
    assert dict(got) == want
    assert nearest.nearest_vectors(v.limit(0)).count() == 0


def test_nearest_of_odd_vectors(spark):
    """Very large and very small components, a query id with two vectors, other dimensions, clashing columns."""
    rows = [(50, [1e200, 0.0]), (1, [1e-200, 1e-200]), (2, [3e-320, 0.0]), (3, [-1e300, 1e300]), (100, [0.0, 1.0]), (100, [0.0, -1.0]), (4, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"block": F.lit("b"), "slot": F.lit(1), "rank": F.lit(2), "query_id": F.lit(3)})
    got = defaultdict(list)
    for r in sorted(nearest.nearest_vectors(df, 50, 3).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    assert got[50] == [(2, 1.0), (1, round(math.sqrt(0.5), 9)), (100, 0.0)]
    assert got[100] == [(2, 0.0), (50, 0.0), (1, -round(math.sqrt(0.5), 9))] or got[100][:2] == [(2, -0.0), (50, -0.0)]


def test_wrapper(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in wrapper.main_texts(pages).collect()}
    for r in pages.collect():
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S).group(1))
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_wrapper_without_articles(spark):
    page = lambda k: f"<html><head><title>t{k}</title></head><body><div id=top>Our site</div><div class='side-bar sidebar'>s{k}</div><div><h2>Title {k}</h2><p>Body &amp; soul {k}<p>More  {k}</div><form>go {k}</form><p>All rights reserved</p><script>x('</p>')</script><div class=comments>c{k}</div></body>"
    rows = [(k, "http://h.example/", page(k)) for k in range(5)] + [(9, None, None), (10, "", ""), (None, "x", "plain"), (11, "http://h.example/", "<p>" * 5000)]
    got = {r.page_id: r.text for r in wrapper.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h"))).collect()}
    assert got[3] == "Title 3\nBody & soul 3\nMore 3" and got[9] == got[10] == got[11] == "" and got[None] == "plain"


def test_mixing(spark, docs, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels, weights = spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), {"good": 0.8, "low": 0.15, "toxic": 0.05}
    rows = mixing.mixing_rates(docs, labels, weights).collect()
    n = sum(r.n_tokens for r in rows)
    assert n == sum(len(words(t)) for _, t in texts(docs)) and min(r.rate for r in rows) >= 0
    for d, w in weights.items():
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) / n == pytest.approx(w, abs=1e-3)
    # the same steps in numpy
    tokens, p = np.array([r.n_tokens for r in rows], dtype=float), np.array([[r[f"p_{d}"] for d in weights] for r in rows])
    rate, have = np.ones(len(rows)), tokens @ p
    for _ in range(1000):
        rate = np.maximum(0, rate - p @ (((rate * tokens) @ p - n * np.array(list(weights.values()))) / have))
    assert np.abs(rate - [r.rate for r in rows]).max() < 1e-2
    assert mixing.mixing_rates(odd, labels.limit(0), weights).count() == len(ODD)
    assert mixing.mixing_rates(odd, labels, weights).count() == len(ODD)


def test_classifier_by_hand(spark):
    """Posteriors of a Bernoulli naive Bayes over the known words, worked out in plain Python from the same labelled texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 150").select("doc_id", "text")
    labelled = docs.withColumn("domain", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b")).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Zyx, qwerty! ").otherwise(" plain ")))
    model = mixing.fit_classifier(labelled.select("text", "domain"), ["a", "b"])
    assert {"zyx", "qwerty", "plain"} <= {*model.words} | {"plain"}
    seen = mixing.with_seen(labelled, "text", "seen")
    got = {r.doc_id: list(r.p) for r in seen.select("doc_id", model.posterior("seen").alias("p")).collect()}
    bags = {}
    for r in seen.select("doc_id", "text", "domain", "seen").collect():
        low = regex.sub(r"[^\p{L}\p{N}\x20\x09-\x0D]+", "\x01", r.text.lower())
        own = {w.strip("\x01") for w in re.split(r"[\x20\x09-\x0D]+", low)}
        assert own == set(r.seen.words)
        bags[r.doc_id] = (r.domain, own | {w[: mixing.BEGINNING] + "*" for w in own} | set(r.seen.signs))
    n = Counter(d for d, _ in bags.values())
    there = {w: {d: (sum(w in b for x, b in bags.values() if x == d) + 0.5) / (n[d] + 1) for d in "ab"} for w in model.words}
    for i, (_, bag) in bags.items():
        logs = {d: math.log((n[d] + 0.5) / (len(bags) + 1)) + sum(math.log(p[d]) if w in bag else 0.0 if w.startswith(" ") else math.log(1 - p[d]) for w, p in there.items()) for d in "ab"}
        top = max(logs.values())
        odds = [math.exp(logs[d] - top) for d in "ab"]
        assert got[i] == pytest.approx([x / sum(odds) for x in odds], abs=2e-6)


def test_labels_that_disagree(spark):
    rows = [(1, 1, 0), (1, 0, 0), (2, 1, 0), (2, 1, 1), (3, None, None), (4, 1, None), (None, 1, 1)]
    got = mixing.label_domains(spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()
    assert {r.doc_id: r.domain for r in got} == {1: "low", 2: "toxic", 4: "good"}


def test_draw_meets_its_targets(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    weights = {"good": 0.6, "low": 0.35, "toxic": 0.05}
    out = mixing.drawn(docs, labels, weights, 1.5)
    told = mixing.mixing_rates(docs, labels, weights, 1.5)
    rates = told.select("doc_id", "n_tokens", "rate", *[f"p_{d}" for d in weights])
    n = rates.agg(F.sum("n_tokens")).first()[0]
    got = out.groupBy("doc_id").agg(F.count("*").alias("copies")).join(rates, "doc_id").agg(*[F.sum(F.col("copies") * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in weights]).first()
    for d, w in weights.items():
        assert got[d] / n == pytest.approx(1.5 * w, rel=0.06)
    wrong = out.groupBy("doc_id").agg(F.count("*").alias("copies")).join(rates, "doc_id").filter("copies not in (floor(rate), floor(rate) + 1)")
    assert wrong.count() == 0 and out.columns == docs.columns


def simhash(text):
    w = words(text)
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, odd):
    for df in (docs, odd):
        rows = texts(df)
        f = np.array([simhash(t) for _, t in rows], dtype=np.uint64)
        near, label = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2, np.array([math.inf if i is None else i for i, _ in rows])
        for _ in rows:
            label = np.array([label[near[k]].min() for k in range(len(rows))])
        want = sorted(((i, f"{int(x):016x}", None if math.isinf(c) else int(c)) for (i, _), x, c in zip(rows, f, label)), key=str)
        assert sorted((tuple(r) for r in vptree.simhash_components(df).collect()), key=str) == want


def test_a_shard_that_no_cut_makes_smaller(spark, monkeypatch):
    """A ball of near fingerprints, held against itself in pieces, beside shards that split; every link against all pairs."""
    rng = np.random.default_rng(4)
    ball = np.uint64(0xFEED_F00D_CAFE_BEEF) ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64))
    points = np.unique(np.concatenate([ball, rng.integers(0, 1 << 63, 3_000, dtype=np.uint64)]))
    links = [(i, j) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points[:i] ^ points[i]) <= 2)]
    label = np.arange(len(points))
    for _ in range(8):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    monkeypatch.setattr(vptree, "SHARD", 256)
    nodes = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long").repartition(4)
    groups = {}
    for r in vptree.components(vptree.near_links(nodes, 2, sampled=64, split=200)).collect():
        groups.setdefault(r.root, {r.root}).add(r.node)
    want = {}
    for x, k in zip(points.view(np.int64).tolist(), label.tolist()):
        want.setdefault(k, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_rates_settle_however_long_it_takes(spark):
    """Domains that are hard to tell apart take many steps; the end meets the targets."""
    rows = spark.createDataFrame([(100, [0.55, 0.45]), (100, [0.45, 0.55])], "n long, p array<double>")
    history = mixing.fit_rates(rows, [0.52, 0.48], 1.0, tolerance=1e-9)
    p, r = np.array([[0.55, 0.45], [0.45, 0.55]]), np.ones(2)
    for g in history:
        r = np.maximum(0, r - p @ np.array(g))
    assert len(history) > 200 and np.allclose((r * 100) @ p, [104, 96], atol=1e-3)


def test_shards_that_are_cut_again(spark):
    """The same links with a first tree of a few leaves, whose shards are cut by trees of their own."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 15_000, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, 5_000, dtype=np.uint64)
    points = np.unique(np.concatenate([base, base[:5_000] ^ flips]))
    nodes = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long").repartition(4)
    got = {(r.node, r.root) for r in vptree.components(vptree.near_links(nodes, 2, sampled=40, split=1500)).collect()}
    assert got == {(r.node, r.root) for r in vptree.components(vptree.near_links(nodes, 2)).collect()} and len(got) >= 4_990


def test_vantage_points_lose_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (2, 2000), dtype=np.uint64)
    points = np.unique(np.concatenate([base, base[:2000] ^ flips[0], base[:2000] ^ flips[0] ^ flips[1]]))
    tree = vptree.Tree(points[::8], 4)
    at, leaf, home = tree.route(points, 2)
    assert tree.leaves > 4 and np.array_equal(np.sort(at[home]), np.arange(len(points)))
    where, own = defaultdict(set), {}
    for a, x, h in zip(at.tolist(), leaf.tolist(), home.tolist()):
        where[a].add(x)
        if h:
            own[a] = x
    for i in range(0, len(points), 500):
        a, b = np.nonzero(np.bitwise_count(points[i : i + 500, None] ^ points[None, :]) <= 2)
        assert all(own[y] in where[x] or own[x] in where[y] for x, y in zip((a + i).tolist(), b.tolist()))


def test_sequences(docs, odd, tmp_path):
    t = Tokenizer.from_file(WORD)
    folder = f"file://{tmp_path}/ids"
    for df, place in ((docs, folder), (odd, None)):
        rows = sorted(texts(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        got = sorted(sequences.sequence_digests(df, WORD, 1, place).collect(), key=lambda r: r.start)
        start = 0
        for (i, x), r in zip(rows, got, strict=True):
            ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
            start += len(ids)
    first = sorted((tmp_path / "ids").glob("part-*[0-9a-f].arrow"))[0]
    ids, mask = sequences.sequence_at(sequences.open_file(f"file://{first}"), 1)
    assert len(ids) == len(mask) == sequences.LENGTH and not ids.flags.owndata


def test_byte_bpe(docs, odd):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    small = odd.filter("doc_id is null or doc_id <> 5")  # the library needs minutes for one token of 300,000 bytes
    long_ = byte_bpe.document_codes(odd.filter("doc_id = 5"), BYTE, P.PATTERN, True).first()
    token = {i: t for t, i in ranks.items()}
    assert b"".join(token[k] for k in long_.ids) == b"x" * 300_000
    runs = Counter(e.encode_ordinary("x" * 4096))
    assert long_.n_tokens == len(long_.ids) and set(long_.ids) == set(runs)
    for df in (docs, small):
        want = []
        for i, t in texts(df):
            ids = e.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert sorted((tuple(r) for r in byte_bpe.document_codes(df, BYTE, P.PATTERN).collect()), key=str) == sorted(want, key=str)


def test_perfect_hash():
    keys = [b"%d" % (i * i) for i in range(3000)]
    h = byte_bpe.PerfectHash(keys)
    assert sorted(h.slot(h.hashes(keys)).tolist()) == list(range(3000))
    assert h.find(keys).tolist() == list(range(3000)) and set(h.find([b"x%d" % i for i in range(500)])) == {-1}


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "embeddings", "pages", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name
