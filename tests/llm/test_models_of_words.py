"""Periodic runs, the language model and importance resampling against plain loops."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.llm import chunks, language_model, queries, resampling
from chorale.llm.runs import find_runs, runs_of
from test_llm import EXTRA, LONG, ODD, ROWS, WORD, documents, long_text

FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in ROWS], ODD).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]


# runs


def plain_runs(w, shortest=12):
    """All runs (start, period, end) by looking at every period."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, q, b) for (a, b), q in out.items())


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_run_row(doc_id, text):
    w = planted(doc_id, WORD.findall(text or ""))
    found = plain_runs(w)
    gone = {i for a, q, b in found for i in range(a + q, b)}
    best = min(((a - b, a, q) for a, q, b in found), default=None)
    lines = "".join(f"{a},{b - a},{q}\n" for a, q, b in found)
    collapsed = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    own = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *own, sha(lines), sha(collapsed))


def test_runs_of_random_texts_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(400):
        docs = []
        for _ in range(rng.integers(0, 4)):
            w = rng.integers(0, rng.choice([1, 2, 3, 5, 30]), rng.integers(0, 80)).tolist()
            if len(w) and rng.random() < 0.5:
                a = int(rng.integers(len(w)))
                p = int(rng.integers(1, max(2, (len(w) - a) // 2)))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            docs.append(w + w[: int(rng.integers(0, len(w) + 1))] + w if rng.random() < 0.4 else w)
        codes = np.array([d * 100 + x for d, w in enumerate(docs) for x in w], np.int64)
        for shortest in (6, 12):
            start, end, period = runs_of(codes, np.array([len(w) for w in docs], np.int64), shortest)
            want, at = [], 0
            for w in docs:
                want += [(a + at, q, b + at) for a, q, b in plain_runs(w, shortest)]
                at += len(w)
            assert list(zip(start.tolist(), period.tolist(), end.tolist(), strict=True)) == want


def test_op11_by_brute_force(spark, sf_dir, texts):
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, sf_dir).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()))
    assert got == sorted(plain_run_row(*x) for x in texts)
    assert sum(r[1] for r in got) > 10


def test_runs_of_odd_rows(odd, none):
    def key(r):
        return str(r)

    out = find_runs(odd).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["collapsed"]) for r in out), key=key) == sorted(((i, len(WORD.findall(t or "")), " ".join(WORD.findall(t or ""))) for i, t, *_ in ROWS), key=key)
    assert all(r["runs"] == [] for r in out) and find_runs(none).count() == 0
    again = queries.with_planted_period(odd)
    assert sorted(((r["doc_id"], WORD.findall(r["text"] or "")) for r in again.collect()), key=key) == sorted(((i, planted(i, WORD.findall(t or ""))) for i, t, *_ in ROWS), key=key)


def test_one_word_over_and_over(spark):
    rows = [(1, "a " * 5000), (2, "a b " * 700 + "c " + "a b " * 700), (3, "x " * 11), (4, "x " * 12)]
    out = {r["doc_id"]: (r["runs"], r["collapsed"]) for r in find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: ([(0, 5000, 1)], "a"), 2: ([(0, 1400, 2), (1401, 1400, 2)], "a b c a b"), 3: ([], " ".join("x" * 11)), 4: ([(0, 12, 1)], "x")}


# language model


def plain_good_turing(counts):
    nr = Counter(counts)
    pts = [(math.log(r), math.log(n)) for r, n in nr.items() if r <= language_model.FITTED]
    slope = -2.0
    if len(pts) > 1:
        mx, my = sum(x for x, _ in pts) / len(pts), sum(y for _, y in pts) / len(pts)
        slope = sum((x - mx) * (y - my) for x, y in pts) / sum((x - mx) ** 2 for x, _ in pts)
    slope = slope if slope < -1.01 else -2.0

    def d(r):
        if r <= language_model.TURING and nr[r] and nr[r + 1] and (r + 1) * nr[r + 1] / (r * nr[r]) < 1:
            return (r + 1) * nr[r + 1] / (r * nr[r])
        return (1 + 1 / r) ** (slope + 1)

    return d


class PlainKatz:
    def __init__(self, texts):
        self.one, self.two, self.history = Counter(), Counter(), Counter()
        for t in texts:
            w = [*WORD.findall((t or "").translate(LOWER)), "\n"]
            self.one.update(w)
            self.two.update(zip([" ", *w[:-1]], w, strict=True))
        self.after = defaultdict(list)
        for (v, w), c in self.two.items():
            self.history[v] += c
            self.after[v].append(w)
        self.n = sum(self.one.values())
        self.d1, self.d2 = plain_good_turing(self.one.values()), plain_good_turing(self.two.values())
        self.unknown = 1 - math.fsum(self.d1(c) * c / self.n for c in self.one.values()) if self.n else 1.0
        self.alpha = {v: (1 - math.fsum(self.seen(v, w) for w in ws)) / max(1 - math.fsum(self.single(w) for w in ws), self.unknown) for v, ws in self.after.items()}

    def seen(self, v, w):
        return self.d2(self.two[v, w]) * self.two[v, w] / self.history[v]

    def single(self, w):
        return self.d1(self.one[w]) * self.one[w] / self.n if self.one[w] else self.unknown

    def p(self, w, v):
        return self.seen(v, w) if self.two[v, w] else self.alpha.get(v, 1.0) * self.single(w)

    def row(self, doc_id, text):
        w = [*WORD.findall((text or "").translate(LOWER)), "\n"]
        base = sum(math.log10((self.one[x] + 1) / (self.n + len(self.one) + 1)) for x in w)
        return (doc_id, len(w), sum(self.one[x] > 0 for x in w), self.n, base, sum(math.log10(self.p(x, v)) for v, x in zip([" ", *w[:-1]], w, strict=True)))


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:4], round(r[5], 4))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9, atol=1e-9)


def scored(out):
    return [tuple(r) for r in out.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def test_op12_by_brute_force(spark, sf_dir, texts):
    model = PlainKatz([t for i, t in texts if not held(i)])
    out = queries.op12_lm_scoring(spark, sf_dir)
    same(scored(out), [model.row(*x) for x in texts])
    apart = out.where("held_out").toPandas()
    assert set(apart["doc_id"]) == {i for i, _ in texts if held(i)}
    assert apart["score"].sum() > apart["base_score"].sum()


def test_every_history_sums_to_one(spark):
    words = "the cat sat on the mat and the dog sat on the log while a cat and a dog ran".split()
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words, 30))) for i in range(40)]
    _, model = language_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), most=100)
    single = {r["w"]: model.single.array(np.array([r["c"]]))[0] * r["c"] / model.tokens for r in model.words.collect()}
    assert math.isclose(sum(single.values()) + model.unknown, 1)
    seen = defaultdict(dict)
    for r in model.pairs.collect():
        seen[r["v"]][r["w"]] = model.double.array(np.array([r["c"]]))[0] * r["c"]
    backoffs = {r["v"]: (r["c"], r["log_mass"]) for r in model.backoffs.collect()}
    assert set(seen) == set(backoffs) and language_model.START in seen
    for v, after in seen.items():
        c, log_mass = backoffs[v]
        alpha = 10**log_mass / c
        assert math.isclose(sum(after.values()) / c + alpha * (sum(p for w, p in single.items() if w not in after) + model.unknown), 1, rel_tol=1e-9)


def test_language_model_of_odd_rows_in_small_chunks(spark, odd, none):
    model = PlainKatz([r[1] for r in ROWS if r[0] is not None and r[0] < 7])
    out, _ = language_model.score_texts(odd, F.col("doc_id") < 7, most=50)
    same(scored(out), [model.row(*r[:2]) for r in ROWS])
    assert language_model.score_texts(none, F.lit(True))[0].count() == 0
    untrained, _ = language_model.score_texts(odd, F.lit(False))
    assert all(r[2] == 0 and r[4] == r[5] == 0 for r in scored(untrained))


def test_discounts_leave_mass():
    for counts in ({}, {1: 5}, {1: 10, 2: 4, 3: 2, 4: 1}, {3: 7, 9: 1}, {1: 1, 2: 100, 3: 1}):
        d = language_model.good_turing(counts)
        left = d.array(np.arange(1, 200))
        assert (left < 1).all() and (left > 0).all()


# resampling


def plain_features(text, shortest=1, longest=1):
    w = FEATURE.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)]


def plain_resample(rows, target, percent=10, least=20, buckets=10_000, shortest=1, longest=1):
    def count(texts):
        out = [0] * buckets
        for t in texts:
            for f in plain_features(t, shortest, longest)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = count(x for _, x in rows), count(target)
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        n, features = plain_features(text, shortest, longest)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def ranked(out):
    return sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_op13_by_brute_force(spark, sf_dir, texts):
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = ranked(queries.op13_importance_resampling(spark, sf_dir))
    assert got == plain_resample(texts, target)
    assert sum(r[4] is not None for r in got) > 10


def test_resampling_of_longer_features_and_odd_rows(spark, odd, none):
    rows = [r[:2] for r in ROWS] + [(20 + i, f"Word{i % 3}, and X-{i % 5} é{i % 2} {long_text(i % 4, 20)}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(long_text(1),), (None,), ("word1 and",)], "words string")
    for shortest, longest in ((1, 2), (2, 3)):
        got = ranked(resampling.resample(docs, target, target_text="words", percent=50, buckets=97, shortest=shortest, longest=longest, most=64))
        want = plain_resample(rows, [long_text(1), None, "word1 and"], 50, buckets=97, shortest=shortest, longest=longest)
        assert [r[:4] for r in got] == [r[:4] for r in want]
        assert sorted(r[3:] for r in got if r[4]) == sorted(r[3:] for r in want if r[4])  # rows that repeat may change places
    assert len(ranked(resampling.resample(odd, odd))) == len(ROWS) and resampling.resample(none, none).count() == 0
    assert all(r[4] is None for r in ranked(resampling.resample(odd, odd, percent=0)))


def test_draws_follow_the_target(spark):
    rows = [(i, ("alpha beta gamma " if i % 4 == 0 else "one two three ") * 8) for i in range(400)]
    target = spark.createDataFrame([("alpha beta gamma delta " * 2000,)], "text string")
    out = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), target).where("rank IS NOT NULL").collect()
    assert len(out) == 40 and sum(r["doc_id"] % 4 == 0 for r in out) > 36


def test_words_features_and_packing():
    import pyarrow as pa

    texts = ["  A b\tc\n", None, "", "x", "Ünï É z q", LONG]
    n, words = chunks.cut(pa.array(texts), chunks.byte_table(chunks.SPACES, lower=True))
    want = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    assert n.tolist() == [len(w) for w in want] and [w.decode() for w in words.to_pylist()] == [x for w in want for x in w]
    n, words = chunks.cut(pa.array(texts).slice(3), chunks.byte_table(chunks.NO_WORD, lower=True))
    want = [FEATURE.findall(t.translate(LOWER)) for t in texts[3:]]
    assert n.tolist() == [len(w) for w in want] and [w.decode() for w in words.to_pylist()] == [x for w in want for x in w]
    for values in ([], [0], [5, -7, 1 << 60, -(1 << 62)], list(range(1000))):
        assert chunks.unpack(chunks.pack(np.array(values, np.int64))).tolist() == values
    assert chunks.per_document(np.array([1, 2, 3]), np.array([0, 2, 0, 1, 0])).tolist() == [0, 3, 0, 3, 0]
