"""The pipeline, stage by stage, against brute force on a small table."""

import base64
import random
import re
from collections import Counter

import pyarrow as pa

import corpus_pipeline
from chorale.llm import exact_dedup as exact
from chorale.llm import jaccard_join as joins
from chorale.llm import language_id as lang
from chorale.llm import shared
from chorale.llm.shared import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passes(text):
    w = WORD.findall(text or "")
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = len({i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)})
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    upper, letters = sum(x.isupper() for x in text or ""), sum(x.isalpha() for x in text or "")
    chars, symbols = sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or "")
    return len(w) >= 50 and 2 * again <= len(w) and 10 * symbols <= len(w) and 3 * len(w) <= chars <= 10 * len(w) and 10 * (len(lines) - len(set(lines))) <= 4 * len(lines) and 10 * upper <= 3 * letters


def test_stages_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    profiles = lang.Profiles(lang.learn(docs.where(~lang.held_out(docs["doc_id"]))))
    want = {i for i, t in rows.items() if profiles.predict(t)[0] != "und"}
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert seen[0] == want
    want = {i for i in want if passes(rows[i])}
    assert seen[1] == want
    first = {}
    for i in sorted(want):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]), i)
    assert seen[2] == set(first.values())
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i in seen[2] for w in [WORD.findall(rows[i])]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert seen[3] == {find(i) for i in sets}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert set(packed["doc_id"]) == seen[3] and (packed.groupby("bin")["n_tokens"].sum() <= 2048).all()
    assert len(corpus_pipeline.STAGES) == 5


def test_run_gives_all_that_the_stages_keep(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "n_tokens", "bin", "bin_offset"] and out.count() > 0


def test_language_stage_rejects_what_no_labelled_document_teaches(spark, sf_dir):
    rng = random.Random(1)
    keys = " ".join("".join(rng.choice("asdfghjklqwertyuiopzxcvbnm") for _ in range(rng.randint(3, 12))) for _ in range(80))
    noise = ["Москва является столицей России и крупнейшим городом страны " * 5, "北京是中华人民共和国的首都也是全国的政治中心" * 5, keys, base64.b64encode(rng.randbytes(900)).decode(), rng.randbytes(400).hex(), "asdf jkl; qwer asdfgh zxcv " * 20, "1234 5678"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame([(10**6 + i, t, None, "noise", len(t)) for i, t in enumerate(noise)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(more), sf_dir).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert lang.keep_languages(more, {}, least={}).count() == 0


def test_stages_send_small_batches_to_python(spark, sf_dir):
    before = spark.conf.get(shared.BATCH)
    try:
        docs = spark.range(2000, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat(id, ' word '), 1000) AS text", "'en' AS lang", "'a' AS source", "1L AS n_chars")
        most = lambda: docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").agg({"n": "max"}).first()[0]
        for stage in (corpus_pipeline.language_id, corpus_pipeline.ngram_jaccard_join):
            spark.conf.set(shared.BATCH, shared.BATCH_DEFAULT)
            assert most() > 16 << 20
            stage(spark, docs.limit(5), sf_dir)
            assert most() < 6 << 20
        spark.conf.set(shared.BATCH, "1m")
        corpus_pipeline.ngram_jaccard_join(spark, docs.limit(5), sf_dir)
        assert spark.conf.get(shared.BATCH) == "1m"
    finally:
        spark.conf.set(shared.BATCH, before)


def test_exact_dedup_needs_no_python_workers(spark):
    entries = spark.range(100).selectExpr("xxhash64(id) AS key", "sha2(string(id), 256) AS fingerprint")
    directory = exact.build_directory(entries, 10)
    assert directory.slots.dtypes == [("slot", "bigint"), ("bucket", "int")] and directory.slots.count() == 2**directory.depth
    assert "RDD" not in directory.slots._jdf.queryExecution().optimizedPlan().toString()


def test_powers_are_kept_for_the_longest_text_seen(monkeypatch):
    monkeypatch.setattr(joins, "_POWERS", [])
    short = joins.word_hashes("some words here")
    assert sum(p.nbytes for p in joins._POWERS) <= 1 << 17
    assert joins.word_hashes("x " * 50_000 + "some words here")[-3:].tolist() == short.tolist()
    assert sum(p.nbytes for p in joins._POWERS) >= 16 * 100_000
