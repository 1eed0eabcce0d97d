"""The wav format: what is pruned is not opened, new clips stream in, and a failed write leaves nothing."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.sources import wav
from chorale.sources.audio import encode_wav


@pytest.fixture
def corpus(tmp_path):
    for k in range(8):
        at = tmp_path / "corpus" / f"IND{k % 3}" / f"clip{k}.wav"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(encode_wav(np.sin(np.arange(1000 * (k + 1)) / 5) / 2, 8000))
    return tmp_path / "corpus"


def test_clips_and_headers(spark, corpus):
    wav.register(spark)
    out = spark.read.format("wav").option("partitionBytes", "20000").load(str(corpus))
    rows = {r["file_key"]: r for r in out.collect()}
    assert len(rows) == 8 and out.rdd.getNumPartitions() > 2
    r = rows["IND1/clip4.wav"]
    assert (r["label"], r["sample_rate"], r["channels"], r["frames"], r["duration"], r["error"]) == ("IND1", 8000, 1, 5000, 0.625, None)
    assert np.allclose(r["samples"], np.sin(np.arange(5000) / 5) / 2, atol=1e-4)
    bare = spark.read.format("wav").option("samples", "false").load(str(corpus))
    assert "samples" not in bare.columns and bare.agg(F.sum("frames")).first()[0] == 36000
    assert spark.read.format("wav").option("target", "4000").load(str(corpus)).where("file_key = 'IND0/clip0.wav'").first()["samples"].__len__() == 500


def test_pruned_files_are_not_opened(spark, corpus):
    wav.register(spark)
    (corpus / "IND9").mkdir()
    (corpus / "IND9" / "broken.wav").write_bytes(b"no clip at all")
    strict = lambda **options: spark.read.format("wav").options(errors="fail", **options).load(str(corpus))
    assert strict(labels="IND1").count() == 3 and strict(prefix="IND2/").count() == 2 and strict(labels="IND0,IND1,IND2", least=0.5).count() == 5
    one = strict(labels="IND0,IND2")
    assert (one.where("label = 'IND0'").count(), one.count()) == (3, 5)  # a query leaves nothing for the next
    with pytest.raises(Exception, match="RIFF|EOF"):
        strict().count()
    kept = spark.read.format("wav").load(str(corpus)).where("error IS NOT NULL").collect()
    assert [r["file_key"] for r in kept] == ["IND9/broken.wav"] and kept[0]["samples"] is None
    assert spark.read.format("wav").options(least=100, labels="IND0").load(str(corpus)).count() == 0
    assert spark.read.format("wav").options(rate=8000, most=0.25).load(str(corpus)).where("error IS NULL").count() == 2


def test_bytes_decide_partitions():
    parts = wav.by_bytes([(f"f{k}", n) for k, n in enumerate([100, 10, 10, 10, 10, 60])], 100)
    assert sorted(sum(n for _, n in p.files) for p in parts) == [100, 100] and [p.files for p in wav.by_bytes([], 10)] == [[]]


def test_new_clips_stream_in(spark, corpus, tmp_path):
    wav.register(spark)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def drain():
        q = spark.readStream.format("wav").option("samples", "false").load(str(corpus)).select("file_key", "frames").writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination(60)
        return sorted(r["file_key"] for r in spark.read.parquet(out).collect())

    assert len(drain()) == 8
    (corpus / "IND0" / "later.wav").write_bytes(encode_wav(np.zeros(100), 8000))
    assert len(drain()) == 9 and "IND0/later.wav" in drain()


def test_written_tree_mirrors_and_failures_leave_nothing(spark, corpus, tmp_path):
    wav.register(spark)
    waves = spark.read.format("wav").load(str(corpus)).select("file_key", "samples", F.col("sample_rate").alias("sr")).repartition(3)
    target = tmp_path / "processed"
    target.mkdir()
    waves.write.format("wav").mode("append").save(str(target))
    again = spark.read.format("wav").load(str(target))
    assert sorted(r["file_key"] for r in again.collect()) == sorted(r["file_key"] for r in waves.collect())
    assert again.agg(F.sum("frames")).first()[0] == 36000
    broken = tmp_path / "broken"
    broken.mkdir()
    fails = waves.withColumn("sr", F.when(F.col("file_key").endswith("clip7.wav"), F.raise_error(F.lit("stop"))).otherwise(F.col("sr")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        fails.write.format("wav").mode("append").save(str(broken))
    outside = waves.withColumn("file_key", F.concat(F.lit("../"), "file_key"))
    with pytest.raises(Exception, match="outside"):
        outside.write.format("wav").mode("append").save(str(broken))
    assert list(Path(broken).rglob("*.wav")) == [] and [p for p in Path(broken).iterdir() if any(p.rglob("*"))] == []
