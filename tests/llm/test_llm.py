"""The corpus operators on small tables: odd rows, brute force, exact round trips."""

import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.llm import exact_dedup as exact
from chorale.llm import jaccard_join as joins
from chorale.llm import language_id as lang
from chorale.llm import line_dedup as lines
from chorale.llm import packing, pieces, quality, queries, sharding, shared, url_filter, warc
from chorale.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "doc_id long, text string, lang string, source string, n_chars long, _row string, id string, t string, key string, mark string, words string, _kept string, _lang string, `a.b` string"
EXTRA = ("r", "i", "t", "k", "m", "w", "no", "xx", "dot")
SENTENCE = "the quick brown fox jumps over the lazy dog and runs away from every hunter in the forest"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30000))


def long_text(seed, n=80):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


ROWS = [
    (1, long_text(1), "en", "a"), (2, long_text(1), "en", "a"), (2, long_text(1), "en", "a"), (3, None, "en", "b"), (4, "", None, None), (5, " \t\n", "fr", "b"), (None, long_text(1), "en", None),
    (None, None, None, "a"), (6, LONG, "en", "a"), (7, LONG + " end", "en", "b"), (8, "x", "de", "c"), (9, long_text(9) + "\n" + long_text(10) + "\n" + long_text(11), "en", "a"), (10, long_text(1) + " ", "en", "d"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in ROWS], ODD).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# every query against SQL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, sf_dir, as_rows, name):
    ours, theirs = queries.queries()[name](spark, sf_dir).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert as_rows(ours) == as_rows(theirs)


# exact dedup


def brute_exact(rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    return sorted(((i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g), key=str)


def test_exact_dedup_odd_rows(odd, none):
    out = exact.exact_dedup(odd).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in out), key=str) == brute_exact(ROWS)
    assert sum(r["kept"] for r in out) == len({r["fingerprint"] for r in out})
    kept = exact.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len({r["fingerprint"] for r in out})
    assert exact.exact_dedup(none).count() == 0 and exact.drop_copies(none).count() == 0


def test_exact_dedup_collisions_are_told_apart_by_bytes(spark, odd):
    weak = exact.exact_dedup(odd, capacity=1, max_depth=4, key=lambda t: F.length(t) % 3, fingerprint=lambda t: F.lit("same"))
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in weak.collect()), key=str) == brute_exact(ROWS)
    assert weak.where("kept").count() == exact.exact_dedup(odd).where("kept").count()


def test_owners_follow_chains_and_decide(spark, odd, monkeypatch):
    seen = []
    plain = exact.owners
    monkeypatch.setattr(exact, "owners", lambda index, texts: seen.append((index, texts)) or plain(index, texts))
    exact.exact_dedup(odd, capacity=1, max_depth=4)
    index, texts = seen[0]
    links = plain(index, texts).collect()
    assert index.select("bucket").distinct().count() > 1 and texts.join(index.select("bucket", "key").distinct(), ["bucket", "key"], "left_anti").count() == 0
    assert all(r["norm"] is None and r["keep_row"] is not None and r["n"] > 1 for r in links) and len({(r["key"], r["link"]) for r in links}) == len(links)
    monkeypatch.setattr(exact, "owners", lambda index, texts: plain(index, texts).limit(0))  # without their verdicts nothing is a copy
    assert exact.exact_dedup(odd).where("NOT kept").count() == 0


def test_owners_compare_bytes_and_choose(spark, sf_dir, monkeypatch):
    """Every text comes to its owner once a partition; sizes and keepers are the owner's, in several buckets without being asked."""
    seen = []
    plain = exact.owners
    monkeypatch.setattr(exact, "owners", lambda index, texts: seen.append((index, texts)) or plain(index, texts))
    docs = documents(spark, sf_dir)
    docs = docs.unionByName(docs.where("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(docs.where("doc_id < 20")).repartition(5)
    out = exact.exact_dedup(docs).collect()
    index, texts = seen[0]
    assert index.select("bucket").distinct().count() > 4
    assert texts.count() > texts.select("norm").distinct().count()  # copies from several partitions meet at the owner only
    want = brute_exact([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in out), key=str) == want
    monkeypatch.setattr(exact, "owners", lambda index, texts: plain(index, texts.withColumn("norm", F.concat("norm", F.expr("CAST(uuid() AS STRING)")))))
    other = exact.exact_dedup(docs).collect()  # an owner to whom no two texts are equal finds no copies
    assert sum(r["group_size"] for r in other) < sum(r["group_size"] for r in out)


def test_directory_doubles_where_it_must():
    depth, buckets = exact.grow_directory({0: 5, 1: 5, 15: 1}, capacity=6, max_depth=4)
    assert depth == 4 and sum(n for _, _, n in buckets) == 11
    assert sum(2 ** (4 - d) for _, d, _ in buckets) == 16 and all(n <= 6 for _, _, n in buckets)
    assert exact.grow_directory({}, 6, 4) == (0, [(0, 0, 0)])
    assert max(n for _, _, n in exact.grow_directory({3: 100}, 6, 4)[1]) == 100


# quality


def test_repeat_words_by_brute_force(spark):
    texts = [long_text(1), "a b c a b c", "a a a a a", "a b", "", "x y z " * 30 + "q", "a b c d a b c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(quality.repeat_words(shared.words(F.col("t"))).alias("n"))

    def brute(t):
        w = WORD.findall(t)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        return len({i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)})

    assert [r["n"] for r in df.collect()] == [brute(t) for t in texts]


def test_quality_keeps_columns_and_does_not_depend_on_order(spark, odd, none):
    kept = quality.keep_quality(odd)
    assert kept.columns == odd.columns
    forward, back = (sorted(r["doc_id"] or 0 for r in quality.quality_cascade(odd, rules=r).where("_kept").collect()) for r in (quality.RULES, quality.RULES[::-1]))
    assert forward == back == sorted(r["doc_id"] or 0 for r in kept.collect())
    assert quality.keep_quality(none).count() == 0
    assert quality.quality_cascade(odd, keep_stats=("n_words",)).where("n_words IS NULL").count() == 0


def test_rules_are_ordered_by_evidence_that_repeats(spark):
    texts = [long_text(i) for i in range(60)] + ["# " * 60] * 40 + ["SHOUT " * 60 + long_text(0)] * 3 + ["short"] * 30 + ["no words at all here"] * 5
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    orders = [quality.order_rules(d) for d in (df, df.repartition(3), df.orderBy("t"))]
    assert orders[0] == orders[1] == orders[2] and {r.name for r in orders[0]} == {r.name for r in quality.RULES}
    alone = {r.name: quality.order_rules(df, (r,))[0] for r in quality.RULES}
    assert orders[0][0] == max(alone.values(), key=lambda r: r.rejects / r.cost) and orders[0][0].rejects > 0
    # cost and rejection of each rule among the documents that reach it, shared statistics charged once
    every = quality.with_needs(s for r in quality.RULES for s in r.stats)
    judged = quality._cascade(df, (), every).select("t", *[F.coalesce(F.expr(r.reject), F.lit(False)).alias(r.name) for r in quality.RULES]).toPandas()
    units = {"chars": judged["t"].map(len), "words": judged["t"].map(lambda t: len(WORD.findall(t))), "lines": judged["t"].map(lambda t: t.count("\n"))}
    have, alive = set(), np.ones(len(judged), bool)
    for rule in orders[0]:
        work = sum(quality.STATS[s].price * units[quality.STATS[s].unit][alive].sum() for s in rule.stats if s not in have)
        assert rule.cost == pytest.approx(max(work / max(alive.sum(), 1), 1.0)) and rule.rejects == pytest.approx(judged[rule.name][alive].sum() / max(alive.sum(), 1))
        have |= set(rule.stats)
        alive &= ~judged[rule.name].to_numpy()
    assert quality.order_rules(df.limit(0)) == quality.RULES


def test_later_statistics_are_not_computed_for_rejected_rows(spark):
    df = spark.createDataFrame([("short",), (long_text(1),)], "t string")
    out = quality._cascade(df, quality.RULES, ("n_words",)).collect()
    assert [(r["n_words"], r["n_upper"], r["_failed"]) for r in out] == [(1, None, "too_few_words"), (80, 0, None)]


def test_measured_order_differs_and_skips_work(spark, sf_dir):
    """The order by measured work is not the list's, and what it skips is counted."""
    docs = documents(spark, sf_dir).select(F.coalesce("text", F.lit("")).alias("t"))
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    order = quality.order_rules(docs, always=shown)
    assert [r.name for r in order] != [r.name for r in quality.RULES]
    lazy = [s for s in quality.STATS if s not in quality.with_needs(shown) and any(s in r.stats for r in quality.RULES)]
    assert len(lazy) >= 5
    judged = quality._cascade(docs, order, shown).select("_failed", *[F.col(s).isNull().alias(s) for s in lazy]).toPandas()
    failed = judged["_failed"].notna()
    assert failed.any() and not judged.loc[~failed, lazy].any().any()  # kept documents have every statistic
    place = {s: min(k for k, r in enumerate(order) if s in r.stats) for s in lazy}
    at = judged["_failed"].map({r.name: k for k, r in enumerate(order)})
    for s in lazy:
        assert (judged[s] == (at < place[s])).all()  # skipped exactly where an earlier rule has rejected


@pytest.mark.parametrize("text", ["- one bullet line with words\n* and two\n\u2022 three" * 20, "it goes on ...\nand on \u2026 \n" * 40, "12 34 5.6 " * 30 + "word " * 10, "same words again " * 60])
def test_method_rules_reject(spark, text):
    rules = {r.name: bool(quality._cascade(spark.createDataFrame([(text,)], "t string"), (r,)).first()["_failed"]) for r in quality.METHOD_RULES}
    assert any(rules[n] for n in ("bullets", "ellipses", "letterless_words", "few_distinct_words"))


# sharding


def test_shards_are_whole_even_and_gapless(spark, sf_dir, odd, none):
    out = sharding.shard_documents(documents(spark, sf_dir).unionByName(documents(spark, sf_dir).where("doc_id = 1")), 8).toPandas()
    assert len(out) == 201
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() < 1.3 * sizes.mean()
    few = sharding.shard_documents(odd, 3).toPandas()
    assert len(few) == len(ROWS) and few["size"].min() == 8
    assert sharding.shard_documents(none, 3).count() == 0


def test_a_hot_group_is_split_and_others_are_not(spark):
    rows = [(i, "hot text") for i in range(300)] + [(1000 + i, f"text {i // 2}") for i in range(600)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    assert out.groupby("shard").size().pipe(lambda s: s.max() - s.min()) <= 6
    rng = np.random.default_rng(5)
    many = [(i, "a hot text of some words") for i in range(3000)] + [(10_000 + i, long_text(int(rng.integers(2000)), 12)) for i in range(6000)]
    big = sharding.shard_documents(spark.createDataFrame(many, "doc_id long, text string"), 24).toPandas()
    for sums in (big.groupby("shard").size(), big.groupby("shard")["size"].sum()):
        assert sums.max() / sums.mean() < 1.02 and len(sums) == 24
    cold = out[out["doc_id"] >= 1000].merge(spark.createDataFrame(rows, "doc_id long, text string").toPandas())
    assert (cold.groupby("text")["shard"].nunique() == 1).all()


def by_plain_loop(rows, n):
    """Shards of whole groups by the definition, all in one residual; None for groups that would be split."""
    import hashlib

    groups = {}
    for _, text in rows:
        key = hashlib.sha256((text or "").encode()).hexdigest()
        g = groups.setdefault(key, [0, 0, 0])
        for d, x in enumerate((len((text or "").encode()) + 8, len(WORD.findall(text or "")), 1)):
            g[d] += x
    total = [max(1, sum(g[d] for g in groups.values())) for d in range(3)]
    room = [[1 / n] * 3 for _ in range(n)]
    out = {}
    for key, g in sorted(groups.items(), key=lambda kg: (-max(x / t for x, t in zip(kg[1], total, strict=True)), kg[0])):
        w = [x / t for x, t in zip(g, total, strict=True)]
        fits = [s for s in range(n) if all(r >= x for r, x in zip(room[s], w, strict=True))] or list(range(n))
        best = max(fits, key=lambda s: (sum(r * x for r, x in zip(room[s], w, strict=True)), -s))
        room[best] = [r - x for r, x in zip(room[best], w, strict=True)]
        out[key] = best
    return out


def test_shards_are_those_of_a_plain_loop(spark):
    import hashlib

    rows = [(i, long_text(i, 60 + 4 * i)) for i in range(40)] + [(100 + i, long_text(i % 3, 60 + 4 * (i % 3))) for i in range(6)]
    want = by_plain_loop(rows, 4)  # every item is over 1 / 64 of a shard, so all are placed in one pass
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    texts = dict(rows)
    assert {r["doc_id"]: r["shard"] for r in out} == {i: want[hashlib.sha256(texts[i].encode()).hexdigest()] for i in texts}
    rng = np.random.default_rng(3)
    weights = rng.random((200, 3)) / 150
    got, room = sharding.place(weights, np.full((5, 3), 0.2)), [[0.2] * 3 for _ in range(5)]
    for w, shard in zip(weights, got, strict=True):
        dots = [sum(r * x for r, x in zip(room[s], w, strict=True)) for s in range(5)]
        fits = [s for s in range(5) if all(r >= x for r, x in zip(room[s], w, strict=True))] or list(range(5))
        assert max(dots[s] for s in fits) - dots[shard] < 1e-12
        room[shard] = [r - x for r, x in zip(room[shard], w, strict=True)]


def test_shards_and_windows_do_not_depend_on_partitions(spark, sf_dir):
    docs = documents(spark, sf_dir)
    docs = docs.unionByName(docs.where("doc_id < 40")).unionByName(docs.where("doc_id < 20").withColumn("doc_id", F.lit(None).cast("long")))
    for make in (lambda d: sharding.shard_documents(d, 6), lambda d: packing.pack_documents(d, 256, pack_rows=64)):
        few, many = (sorted(map(tuple, make(docs.repartition(n)).collect()), key=str) for n in (3, 7))
        assert few == many and len(few) >= docs.count()


# Jaccard join


def shingle_set(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_join(rows, t=0.8):
    sets = [shingle_set(x[1]) for x in rows]
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) / union >= t:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i in range(n):
        members.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return sorted(((rows[i][0], least[find(i)], links[i]) for i in range(n)), key=str)


def near_rows(n=60, words=120):
    rng = np.random.default_rng(4)
    base = long_text(77, words).split()
    out = []
    for i in range(n):
        w = list(base)
        for p in rng.integers(0, words, int(rng.integers(0, 4))):
            w[p] = f"e{i}"
        out.append((i, " ".join(w)))
    return out + [(1000 + i, long_text(1000 + i)) for i in range(20)]


@pytest.mark.parametrize("cold", [64, 2])
def test_jaccard_join_by_brute_force(spark, monkeypatch, cold):
    monkeypatch.setattr(joins, "COLD_DOCS", cold)
    monkeypatch.setattr(joins, "BLOCK_DOCS", 16)
    rows = near_rows()
    out = joins.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in out), key=str) == brute_join(rows)


def test_jaccard_join_odd_rows(odd, none):
    out = joins.jaccard_join(odd).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in out), key=str) == brute_join([r[:2] for r in ROWS])
    kept = joins.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in out) == len({r["class_id"] if r["class_id"] is not None else "none" for r in out})
    assert joins.jaccard_join(none).count() == 0 and joins.drop_near_copies(none).count() == 0


def test_word_hashes_do_not_depend_on_place():
    a, b = joins.word_hashes("alpha beta  alpha\n\tgamma"), joins.word_hashes("gamma alpha")
    assert a[0] == a[2] == b[1] and a[3] == b[0] and len(set(a)) == 3
    spot = joins.word_hashes("ab " * 400_000 + "zz")
    assert len(spot) == 400_001 and len(set(spot.tolist())) == 2
    assert len(joins.word_hashes("x" * 2_500_000 + " y")) == 2


def test_bayes_bounds():
    least = joins.least_matches(0.8, 1e-9)
    assert least[200] > least[20] >= 0 and least[200] < 160
    p = sum(np.random.default_rng(0).binomial(200, 0.8, 100_000) < least[200])
    assert p == 0


@pytest.mark.parametrize("few", [True, False])
def test_components(spark, monkeypatch, few):
    if not few:  # as for a table of nodes that is too large for a broadcast, with hubs
        from chorale.llm import components as module

        monkeypatch.setattr(module, "fits", lambda df: False)
        monkeypatch.setattr(module, "HUB", 2)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7), (None, 3)] + [(200, 201 + i) for i in range(20)]
    out = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100} | {200 + i: 200 for i in range(21)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# pieces

needs_model = pytest.mark.skipif(not Path(queries.PIECE_MODEL).exists(), reason="no tokenizer files")


@needs_model
def test_pieces_are_the_library_s_and_decode_exactly(spark, odd, none):
    proto = Path(queries.PIECE_MODEL).read_bytes()
    library = pieces.Pieces(proto).library
    texts = [r[1] for r in ROWS] + ["漢字かな混じり" * 300, "a" * 900, "  two  spaces \n\n end  ", "ÀéÎ😀 mixed " * 40, " " * 500, "no-space-" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (64, 1 << 15):
        out = {r["doc_id"]: r for r in pieces.encode_and_decode(df.where(F.length("text") < 5000) if chunk == 64 else df, proto, chunk=chunk).collect()}
        for i, r in out.items():
            assert r["ids"] == library.encode(texts[i] or ""), (chunk, i)
            assert r["decoded"] == (texts[i] or "")
        assert any(r["n_chunks"] > 1 for r in out.values())
    got = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in pieces.encode_and_decode(odd, proto).collect()), key=str)
    assert got == sorted(((r[0], library.encode(r[1] or ""), r[1] or "") for r in ROWS), key=str) and pieces.encode_and_decode(none, proto).count() == 0


def unigram_model(scores):
    """A serialised unigram model with byte fallback and no normalisation, from {piece: score}."""
    import struct

    def number(x):
        return bytes([x]) if x < 128 else bytes([x & 127 | 128]) + number(x >> 7)

    def field(k, value):
        return number(k << 3) + number(value) if isinstance(value, int) else number(k << 3 | 2) + number(len(value)) + value

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + number(2 << 3 | 5) + struct.pack("<f", score) + field(3, kind))

    out = piece("<unk>", 0.0, 2) + piece("<s>", 0.0, 3) + piece("</s>", 0.0, 3)
    out += b"".join(piece(f"<0x{b:02X}>", 0.0, 6) for b in range(256))
    out += b"".join(piece(p, x, 1) for p, x in scores.items())
    return out + field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


#: Scores are multiples of 1 / 8, so that the library's 32-bit sums are exact; many segmentations are tied.
UNIGRAM = {"▁": -3.0, "a": -2.0, "b": -2.5, "c": -2.25, "ab": -3.5, "ba": -4.5, "abc": -5.0, "bc": -4.75, "▁a": -4.0, "▁ab": -5.25, "ca": -4.25, "aa": -4.0, "aaa": -6.0, "caab": -7.5, "b▁a": -6.5, "▁▁": -5.0, "é": -3.0}


def test_unigram_scan_is_the_library_s(spark):
    import sentencepiece

    proto = unigram_model(UNIGRAM)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abc "), int(n), p=[0.4, 0.25, 0.25, 0.1])) for n in rng.integers(1, 400, 60)]
    texts += ["a" * 300, "ab" * 150, "caab" * 90, " " * 70, "xé漢字 ab" * 40, "zzz" * 50, "", None, "aab" * 2000]
    known = pieces.Pieces(proto)
    assert known.unigram and pieces.model_type(proto) == pieces.UNIGRAM
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (7, 64):
        for r in pieces.encode_and_decode(df, proto, chunk=chunk).collect():
            assert r["ids"] == library.encode(texts[r["doc_id"]] or ""), (chunk, r["doc_id"])
            assert r["decoded"] == (texts[r["doc_id"]] or "")
    apart = pieces.decode(pieces.encode(df, proto, chunk=64), proto).collect()
    spelt = {}
    for r in sorted(apart, key=lambda r: (r["id"], r["k"])):
        spelt[r["id"]] = spelt.get(r["id"], "") + r["marked"]
    assert {i: pieces.unmark(m) for i, m in spelt.items()} == {i: t or "" for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        pieces.encode(df, proto, chunk=2)


def test_max_plus_product_is_associative():
    rng = np.random.default_rng(6)

    def matrix(rows, columns):
        out = {e: {} for e in rows}
        for x in columns:
            for rank, e in enumerate(rng.permutation(list(rows)).tolist()):
                out[e][x] = (int(rng.integers(-2, 1)), rank)
        return out

    for _ in range(50):
        a, b, c = matrix([""], "xyz"), matrix("xyz", "pq"), matrix("pq", ["0", "1"])
        assert pieces.compose(pieces.compose(a, b), c) == pieces.compose(a, pieces.compose(b, c))
        b, c = matrix("xyz", "pqr"), matrix("pqr", "xyz")
        assert pieces.compose(pieces.compose(b, c), b) == pieces.compose(b, pieces.compose(c, b))
    one = lambda **rows: {k.strip("_"): {x: (w, 0) for x, w in row.items()} for k, row in rows.items()}
    assert pieces.boundary_states([one(_={"x": 0, "y": -1}), one(x={"p": -2}, y={"p": 0, "q": -5}), one(p={"end": 0}, q={"end": 1})]) == ["", "y", "p", "end"]


# WARC


def pages(spark):
    rows = [(1, "http://a/x", "same"), (2, "http://a/y", "same"), (2, "http://a/y", "same"), (3, None, None), (4, "http://b", ""), (None, "http://c", "same"), (5, "http://d\r\nX: y", "ä" * 5000), (6, "http://e", long_text(3, 9000)), (7, "http://f", "\x1f\x8b\x08" * 10)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("split", [1 << 25, 97])
def test_warc_round_trip(spark, split):
    rows, df = pages(spark)
    out = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(df.repartition(2), split_bytes=split).collect()), key=str)
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(h or "", i)
    want = [(i, len((h or "").encode()), warc.base32_sha1((h or "").encode()), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in rows]
    assert out == sorted(want, key=str)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_warc_keeps_pages_with_very_long_urls(spark):
    rows = [(1, "data:text/html," + "a1" * 60_000, "same"), (2, "http://a/?" + "q" * 70_000, "same"), (3, "http://b", "other")]
    out = {r["page_id"]: r for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert sorted(out) == [1, 2, 3] and out[1]["record_type"] == "response" and out[2]["refers_to"] == 1


def record(number, payload):
    return warc.record_bytes(f"urn:page:{number}", "u", payload, warc.base32_sha1(payload), None, "2024-01-01T00:00:00Z")


def stored_member(data):
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def read_back(spark, tmp_path, data, step, with_payload=False):
    path = tmp_path / f"x{step}.warc.gz"
    path.write_bytes(data)
    files = spark.createDataFrame([(f"file://{path}", len(data))], "path string, length long")
    return warc.read_warc(files, step, with_payload).orderBy("offset").collect()


@pytest.mark.parametrize("step", [97, 1 << 25])
def test_ranges_own_every_record_once(spark, tmp_path, step):
    inner = warc.gzip_member(record(9, b"inner"))
    long_name = MAGIC_NAME + warc.gzip_member(record(4, b"named"))[10:]
    damaged = bytearray(warc.gzip_member(record(5, b"damaged" * 40)))
    damaged[-20] ^= 255
    parts = [warc.gzip_member(record(1, b"one" * 50)), stored_member(record(2, inner * 3)), b"\0\0", long_name, bytes(damaged), warc.gzip_member(record(3, b"three" * 99)), b"rubbish" * 30, warc.gzip_member(record(6, b""))]
    out = read_back(spark, tmp_path, b"".join(parts), step, with_payload=True)
    assert [r["record_id"] for r in out] == [f"urn:page:{i}" for i in (1, 2, 4, 3, 6)]
    assert [bytes(r["payload"]) for r in out] == [b"one" * 50, inner * 3, b"named", b"three" * 99, b""]
    assert all(r["payload_digest"] == warc.base32_sha1(bytes(r["payload"])) and r["payload_bytes"] == len(r["payload"]) for r in out)


#: A gzip header with a file name of 70,000 bytes.
MAGIC_NAME = b"\x1f\x8b\x08\x08\0\0\0\0\0\xff" + b"n" * 70_000 + b"\0"


def test_warc_ids_of_any_type_and_clashing_columns(spark):
    rows = [("a:1", "http://a", "same"), ("b 2/%", "http://b", "same"), (None, "http://c", "same"), ("null", None, "x" * 50)]
    df = spark.createDataFrame([(*r, "p", "q", "r", "s") for r in rows], "page_id string, url string, html string, payload string, id string, record_id string, `a.b` string")
    out = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archive_pages(df).collect()}
    assert out == {"a:1": ("response", None), "b 2/%": ("revisit", "a:1"), None: ("revisit", "a:1"), "null": ("response", None)}


def test_records_longer_than_a_split_take_bounded_steps(spark, tmp_path):
    big = np.random.default_rng(0).bytes(3_000_000)
    out = read_back(spark, tmp_path, warc.gzip_member(record(1, big)) + warc.gzip_member(record(2, b"small")), 1 << 18)
    assert [(r["record_id"], r["payload_bytes"], r["payload_digest"]) for r in out] == [("urn:page:1", len(big), warc.base32_sha1(big)), ("urn:page:2", 5, warc.base32_sha1(b"small"))]


# URLs


def test_bloom_has_no_false_negatives_and_the_join_no_false_positives(spark):
    listed = spark.createDataFrame([(f"h{i}.org/p",) for i in range(500)] + [(None,), ("",), ("h1.org/p",)], "canonical string")
    rows = [(i, f"https://H{i}.org/p/?utm_source=x#f") for i in range(1000)] + [(5000, None), (5001, "no scheme"), (5002, "http://www.example.com/en/"), (5003, "https://x.NET/es/q"), (5003, "https://x.NET/es/q")]
    out = url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), listed, queries.URL_RULES, bits_per_url=2).select("_row.page_id", "host", "path", "rule", "verdict").collect()
    assert len(out) == len(rows)
    for r in out:
        if r["page_id"] < 1000:
            assert r["verdict"] == ("block" if r["page_id"] < 500 else "allow") and r["path"] == "/p/"
    got = {r["page_id"]: r for r in out}
    assert got[5000]["host"] == got[5001]["host"] == "" and got[5000]["verdict"] == "allow"
    assert (got[5002]["rule"], got[5002]["verdict"]) == ("www.example.com/en/", "allow") and (got[5003]["rule"], got[5003]["verdict"]) == ("net/es/", "block")


def test_url_verdicts_of_odd_tables(spark):
    kind = "page_id long, url string, host string, path string, verdict string, block long, canonical string, `a.b` string"
    long_url = "https://a.org/" + "x" * 300_000 + "?q=" + "y" * 300_000
    df = spark.createDataFrame([(1, long_url, *"hpv", 3, "c", "d"), (2, None, *[None] * 6), (3, "", *"hpv", 3, "c", "d"), (3, "", *"hpv", 3, "c", "d")], kind)
    listed = url_filter.with_parts(df, "url")
    out = url_filter.url_verdicts(df, listed, queries.URL_RULES).collect()
    assert len(out) == 4 and {(r["_row"]["page_id"], r["verdict"]) for r in out} == {(1, "block"), (2, "allow"), (3, "allow")}
    assert all(set(r["_row"].asDict()) == set(df.columns) for r in out)
    assert url_filter.url_verdicts(df.limit(0), listed, queries.URL_RULES).count() == 0
    assert url_filter.url_verdicts(df, listed.limit(0), queries.URL_RULES).where("verdict = 'block'").count() == 0


def test_the_list_and_not_the_host_decides(spark, sf_dir, monkeypatch):
    with_list = {r["page_id"]: r for r in queries.op7_url_filters(spark, sf_dir).collect()}
    monkeypatch.setattr(url_filter, "fits", lambda df: False)  # the same by a shuffle
    assert {r["page_id"]: r for r in queries.op7_url_filters(spark, sf_dir).collect()} == with_list
    listed = [r for r in with_list.values() if r["rule"] is None and r["verdict"] == "block"]
    assert any(not re.search(r"(^|\.)(%s)\." % "|".join(queries.LISTED_SITES), r["host"]) for r in listed)


# languages


def test_language_id_learns_from_the_rest_only(spark, sf_dir, odd, none):
    out = queries.op8_language_id(spark, sf_dir).toPandas()
    truth = documents(spark, sf_dir).select("doc_id", "lang").toPandas().merge(out)
    unseen = truth[truth["held_out"]]
    assert len(out) == 200 and (unseen["lang"] == unseen["lang_pred"]).mean() > 0.95
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]).all()
    profiles = lang.learn(odd)
    told = lang.identify(odd, profiles, carry=["doc_id", "text"]).collect()
    assert all(r["_lang"] == "und" and r["_score"] == 0 for r in told if not re.search(r"[^\W\d_]", r["text"] or "")) and all(0 <= r["_score"] <= 1 for r in told)
    kept = lang.keep_languages(odd, profiles)
    assert kept.columns == odd.columns and kept.count() == sum(r["_lang"] != "und" for r in told)
    assert lang.learn(none) == {} and lang.identify(odd, {}).where("_lang <> 'und'").count() == 0 and lang.keep_languages(none, profiles).count() == 0


def test_language_sample_takes_a_copied_text_once(spark):
    texts = spark.createDataFrame([(long_text(i, 5),) for i in range(2000)], "text string")
    hot = texts.orderBy(F.xxhash64("text", F.lit("sample"))).first()["text"]  # the likeliest to be chosen
    rows = [("aa", hot)] * 1000 + [("aa", f"{long_text(1000 + i, 5)} {i}") for i in range(1000)]
    got = [r["text"] for r in lang._sampled(spark.createDataFrame(rows, "lang string, text string").repartition(4), "lang", "text", 20).collect()]
    assert len(got) == len(set(got)) and len(got) < 60
    few = spark.createDataFrame([("aa", "xyx")] * 50 + [("aa", "qq q"), ("aa", "qq")], "lang string, text string")
    assert lang.learn(few)["aa"][0] == ord("q")


def test_ngrams_by_hand():
    codes, counts = lang.ngrams("Ab, a!")
    a, b, e = ord("a"), ord("b"), lang.EDGE
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {a: 2, b: 1, e << 21 | a: 2, a << 21 | b: 1, b << 21 | e: 1, a << 21 | e: 1, (e << 21 | a) << 21 | b: 1, (a << 21 | b) << 21 | e: 1, (e << 21 | a) << 21 | e: 1}


def out_of_place(text, profiles, size):
    """Language and score of a text by the definition: n-grams ranked by count, then code; ranks compared one by one."""
    runs = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    grams = Counter()
    for run in runs:
        marked = "\x01" + run + "\x01"
        for n in (1, 2, 3):
            grams.update(g for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if g != "\x01")
    # neighbouring words share one mark, so pairs over it are the same as at two marks
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    own = [c for c, _ in sorted(((code(g), n) for g, n in grams.items()), key=lambda x: (-x[1], x[0]))][:size]
    best = ("und", 0.0, None)
    for lang_name in sorted(profiles):
        place = {c: r for r, c in enumerate(profiles[lang_name])}
        far = sum(abs(place[c] - r) if c in place else size for r, c in enumerate(own))
        if own and (best[2] is None or far < best[2]):
            best = (lang_name, 1 - far / (size * len(own)), far)
    return best[:2]


def test_languages_by_brute_force(spark, sf_dir, odd):
    docs = documents(spark, sf_dir).select("text", "lang")
    tie = [("aa bb", "xx"), ("aa bb", "yy")]
    more = odd.where("length(text) < 5000 OR text IS NULL").select("text", F.lit(None).cast("string").alias("lang"))
    for train, size in ((docs, 400), (docs, 30), (spark.createDataFrame(tie, "text string, lang string"), 50)):
        profiles = lang.learn(train, size=size)
        told = lang.identify(train.unionByName(more), profiles, size=size).collect()
        assert len(told) >= len(profiles)
        for r in told:
            name, score = out_of_place(r["text"], profiles, size)
            assert r["_lang"] == name and r["_score"] == pytest.approx(score, abs=1e-12), r["text"]


# packing


def check_windows(out, capacity):
    assert (out.groupby("bin")["n_tokens"].sum() <= capacity).all()
    for _, g in out.groupby("bin"):
        known = g["source"].dropna()
        assert known.is_unique and g["cluster"].is_unique
        g = g.sort_values(["bin_offset", "n_tokens"])
        assert (g["bin_offset"].to_numpy() == np.concatenate(([0], g["n_tokens"].cumsum()[:-1]))).all()


def test_packing_is_whole_and_free_of_conflicts(spark, sf_dir, odd, none):
    docs = documents(spark, sf_dir)
    out = packing.pack_documents(docs, 256, pack_rows=64).toPandas()
    marks = docs.select("doc_id", "source", F.xxhash64(shared.squeezed(F.col("text"))).alias("cluster"), shared.n_words(F.col("text")).alias("n")).toPandas()
    out = out.merge(marks)
    check_windows(out, 256)
    assert (out.groupby("doc_id")["n_tokens"].sum() == marks.set_index("doc_id")["n"]).all()
    assert len(packing.pack_documents(odd, 5000).toPandas()) == len(ROWS) + 5 + 6 and packing.pack_documents(none).count() == 0


def test_best_fit_takes_the_tightest_compatible_window():
    windows, offsets = packing.best_fit([70, 60, 30, 30, 10], [0, 1, 0, 2, 3], [-1] * 5, 100)
    assert windows == [0, 1, 1, 0, 1] and offsets == [0, 0, 60, 70, 90]
    rng = np.random.default_rng(2)
    sizes = sorted(rng.integers(0, 50, 400).tolist(), reverse=True)
    sources, clusters = rng.integers(-1, 4, 400).tolist(), rng.integers(-1, 30, 400).tolist()
    got, _ = packing.best_fit(sizes, sources, clusters, 100)
    room, has, want = [], [], []
    for s, a, c in zip(sizes, sources, clusters, strict=True):
        tags = ({("s", a)} if a >= 0 else set()) | ({("c", c)} if c >= 0 else set())
        fits = [w for w in range(len(room)) if room[w] >= s and not has[w] & tags]
        w = min(fits, key=lambda w: room[w]) if fits else len(room)
        if w == len(room):
            room.append(100)
            has.append(set())
        room[w] -= s
        has[w] |= tags
        want.append(room[w])
    left = [100] * (max(got) + 1)
    mine = []
    for s, w in zip(sizes, got, strict=True):
        left[w] -= s
        mine.append(left[w])
    assert mine == want


# lines


def plain_chunks(text, scales=lines.SCALES):
    """(start, stop) of all chunks with two worded lines, by plain loops; lines from 0, stop excluded."""
    import hashlib

    ls = (text or "").split("\n")
    codes = [int(hashlib.md5(x.encode()).hexdigest()[:12], 16) % lines.MODULUS for x in ls]
    out = set()
    for d, r in scales:
        marks = [(c * 31 + (codes[i - 1] * 1000003 if i else 0)) % lines.MODULUS % d == r for i, c in enumerate(codes)]
        ends = sorted({0, len(ls)} | {i + 1 for i, m in enumerate(marks) if m})
        for j, begin in enumerate(ends[:-1]):
            stop = ends[j + 1]
            if stop - begin < 2 and j + 2 < len(ends):
                stop = ends[j + 2]
            out |= {(a, min(a + lines.MOST, stop)) for a in range(begin, stop, lines.MOST)}
    return {(a, b) for a, b in out if sum(bool(WORD.search(x)) for x in ls[a:b]) > 1}


def plain_line_dedup(rows, scales=lines.SCALES):
    """Lines removed, as (row number of the document, line), of distinct (id, text)."""
    first, gone = {}, set()
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    spans = sorted((k, a, b) for k, (_, t) in enumerate(order) for a, b in plain_chunks(t, scales))
    for k, a, b in spans:
        at = first.setdefault("\n".join(order[k][1].split("\n")[a:b]), (k, a, b))
        if at != (k, a, b) and not (at[0] == k and a < at[2]):
            gone |= {(k, i) for i in range(a, b)}
    cleaned = {r: None if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if (k, i) not in gone) for k, r in enumerate(order)}
    return cleaned, {(order[k][0], i + 1) for k, i in gone}


def test_line_dedup_keeps_the_first_and_shifts_do_no_harm(spark, odd, none):
    block = [f"shared passage line {k} with some words" for k in range(40)]
    rows = [(1, "\n".join(block)), (2, "\n".join(["new head", *block])), (3, "\n".join([f"own {k}" for k in range(7)] + block + ["tail"])), (4, "alone\nhere"), (4, "alone\nhere"), (5, None), (6, "")]
    out = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("_row.*", "cleaned", "n_removed_lines").collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["cleaned"] == rows[0][1] and by[2]["n_removed_lines"] > 37 and by[3]["n_removed_lines"] > 37
    assert by[2]["cleaned"].startswith("new head") and all(f"own {k}" in by[3]["cleaned"] for k in range(7))
    assert by[4]["cleaned"] == "alone\nhere" and by[5]["cleaned"] is None and by[6]["cleaned"] == ""
    clean = lines.line_dedup(odd).collect()
    assert len(clean) == len(ROWS) and lines.line_dedup(none).count() == 0
    want, _ = plain_line_dedup([r[:2] for r in ROWS if r[0] is not None])
    assert all(r["cleaned"] == want[r["_row"]["doc_id"], r["_row"]["text"]] for r in clean if r["_row"]["doc_id"] is not None)
    assert all(r["n_removed_lines"] == 0 for r in clean if r["_row"]["text"] is None)


@pytest.mark.parametrize("period", [1, 2, 3, 5])
def test_periodic_texts_lose_their_repeats(spark, period):
    line = lambda k: f"line {k % period} of a period"
    rows = [(n, "\n".join(line(k) for k in range(n))) for n in (700, 701)]
    out = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, _ = plain_line_dedup(rows)
    assert {(r["_row"]["doc_id"], r["_row"]["text"]): r["cleaned"] for r in out} == want
    assert all(r["n_removed_lines"] > 500 for r in out)


def test_chunks_are_those_of_plain_loops(spark):
    texts = ["\n".join(f"line {k * 7919 % 1000}" for k in range(500)), "\n".join(["same"] * 300), "one", "a\n\nb\n \n\nc", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lines.chunk_texts(F.split("t", "\n")).alias("s"))
    for r in df.collect():
        got = [(x["start"] - 1, x["start"] - 1 + x["lines"]) for x in r["s"]]
        assert len(set(got)) == len(got) and set(got) == plain_chunks(r["t"])
        assert all(x["chunk"] == "\n".join(r["t"].split("\n")[x["start"] - 1 : x["start"] - 1 + x["lines"]]) and 1 < x["lines"] <= lines.MOST for x in r["s"])


def brute_runs(rows):
    """Lines that are in a pair of worded lines which came before, as (id, line) from 1."""
    first, gone = {}, set()
    for i, text in rows:
        ls = (text or "").split("\n")
        w = [k for k, x in enumerate(ls) if WORD.search(x)]
        for a, b in zip(w, w[1:], strict=False):
            at = first.setdefault(tuple(ls[a : b + 1]), (i, b))
            if at[0] != i or at[1] < a:
                gone |= {(i, k) for k in range(a, b + 1)}
    return {(i, k + 1) for i, k in gone}


def test_chunks_of_all_scales_find_nine_tenths_of_repeated_lines(spark):
    """Against every pair of neighbouring lines that came before; fewer scales find less."""
    docs = sorted((r["doc_id"], r["text"]) for r in documents(spark, "/root/testdata/sf0.01").select("doc_id", "text").collect())
    pairs, (_, all_scales), (_, one) = brute_runs(docs), plain_line_dedup(docs), plain_line_dedup(docs, lines.SCALES[2:3])
    assert all_scales <= pairs and len(all_scales) >= 0.95 * len(pairs) and len(one) < 0.7 * len(pairs)


@pytest.mark.parametrize("size", [2, 3, 5, 6])
def test_repeated_passages_by_brute_force(spark, size):
    rows = []
    for k in range(30):
        passage = [f"passage {k} of {size} line {j} with words" for j in range(size)]
        if k % 3 == 0:
            passage.insert(1, " ")
        for copy in range(3):
            rows.append((k * 3 + copy, "\n".join([f"before {k} {copy} {j}" for j in range(3)] + passage + [f"after {k} {copy} {j}" for j in range(4)])))
    rows += [(900, "same\nsame\nsame\nsame"), (901, "one\nline\n\none\n\nline")]
    want, gone = plain_line_dedup(rows)
    out = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r["_row"]["doc_id"], r["_row"]["text"]): r["cleaned"] for r in out} == want and sum(r["n_removed_lines"] for r in out) == len(gone)
    assert size < 4 or len(gone) > 0.6 * 60 * size


def test_chunks_with_one_name_go_by_their_bytes(spark, monkeypatch):
    rows = [(i, f"line a {i // 2}\nline b {i // 2}\nline c {i // 2}\nline d {i // 2}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r["_row"]["doc_id"], r["cleaned"]) for r in lines.line_dedup(df).collect())
    monkeypatch.setattr(lines, "_name", lambda t: F.unhex(F.left(F.md5(t), F.lit(1)).substr(1, 0)))  # all names alike
    assert sorted((r["_row"]["doc_id"], r["cleaned"]) for r in lines.line_dedup(df).collect()) == want


def test_every_distinct_text_teaches_its_language(spark):
    """Each of 9,000 texts has a letter of its own, and a profile that is large enough has them all."""
    docs = spark.range(9000).selectExpr("'aa' lang", "char(19968 + id % 256) || decode(unhex(hex(19968 + id)), 'UTF-16BE') text")
    docs = docs.selectExpr("lang", "substring(text, -1) text")
    letters = {ord(r["text"]) for r in docs.collect()}
    profiles, floors = lang.learn_with_floors(docs, size=100_000)
    assert len(letters) == 9000 and letters <= set(profiles["aa"]) and letters <= set(lang.learn(docs, size=100_000)["aa"])
    assert set(floors) == {"aa"}
