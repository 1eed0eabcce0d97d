"""Clips from bytes to features, on files made here."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.functions import dsp
from chorale.operators import stats
from chorale.operators.reduction import tsne, umap
from chorale.plans import pipelines, reports
from chorale.sources import audio, tables
from chorale.streaming.clips import stream_waveforms


def tone(f, seconds=1.0, sr=16000):
    return np.sin(2 * np.pi * f * np.arange(int(seconds * sr)) / sr)


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("clips")
    for name, seconds in (("AL/a.wav", 0.5), ("AL/b.wav", 0.4), ("BE/c.wav", 0.5), ("BE/short.wav", 0.05), ("BE/d.wav", 0.3)):
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(audio.encode_wav(0.5 * tone(300 if "AL" in name else 900, seconds, 8000), 8000))
    (root / "BE/bad.wav").write_bytes(b"not a clip")
    return f"file://{root}"


def test_wav_round_trip():
    x, sr = audio.decode_wav(audio.encode_wav(0.5 * tone(440), 16000))
    assert sr == 16000 and np.allclose(x, 0.5 * tone(440), atol=1e-4)
    assert audio.parse_header(audio.encode_wav(tone(440), 16000)) == {"sample_rate": 16000, "channels": 1, "duration": 1.0, "frames": 16000, "format": "WAV", "subtype": "PCM_16"}
    y, sr = audio.decode_wav(audio.encode_wav(tone(440, 1, 44100), 44100), 16000)
    assert len(y) == 16000 and np.allclose(y[1000:-1000], tone(440)[1000:-1000], atol=0.01)


def test_sine_features():
    x = tone(440)
    s = dsp.spectrum(x)
    assert np.median(dsp.centroid(s, 16000)) == pytest.approx(440, rel=0.2)
    assert np.median(dsp.zero_crossings(x)) == pytest.approx(880 / 16000, rel=0.1)
    assert np.median(dsp.rms(x)) == pytest.approx(2**-0.5, rel=0.02)
    f0, voiced, _ = dsp.pitch(x, 16000)
    assert np.nanmedian(f0) == pytest.approx(440, rel=0.01) and voiced.mean() > 0.8
    assert dsp.mfcc_frames(x, 16000).shape[1] == 26 and dsp.spectral_frames(x, 16000).shape[1] == 24 and dsp.prosody(x, 16000).shape == (26,)
    assert (dsp.prosody(np.zeros(8000), 16000)[:10] == 0).all()
    assert np.allclose(dsp.delta(np.arange(20.0)[:, None]), 1) and np.allclose(dsp.delta(np.arange(20.0)[:, None] ** 2, order=2), 2)
    with pytest.raises(ValueError):
        dsp.delta(np.zeros((5, 2)))
    padded = np.concatenate((np.zeros(16000), x, np.zeros(16000)))
    assert 15000 < len(dsp.trim_silence(padded)) < 20000


def test_pitch_follows_a_smoothed_path():
    rng = np.random.default_rng(3)
    t = np.arange(16000) / 16000
    glide = np.sin(2 * np.pi * (200 * t + 100 * t**2)) + 0.5 * np.sin(4 * np.pi * (200 * t + 100 * t**2))
    f0, voiced, chance = dsp.pitch(glide + 0.02 * rng.normal(size=16000), 16000)
    want = 200 + 200 * np.arange(len(f0)) * 512 / 16000
    inner = slice(3, -3)
    assert voiced[inner].all() and np.allclose(f0[inner], want[inner], rtol=0.05) and (chance >= 0).all() and (chance <= 1).all()
    hissed = np.concatenate((tone(440, 0.5), 0.3 * rng.normal(size=8000), tone(440, 0.5)))
    f0, voiced, _ = dsp.pitch(hissed, 16000)
    assert voiced[2:13].all() and voiced[18:28].mean() < 0.3 and np.allclose(f0[2:13], 440, rtol=0.01)
    assert not dsp.pitch(np.zeros(5000), 16000)[1].any()


def plain_power(x, n, hop, shape):
    """Power spectra by the definition of the Fourier transform, frame by frame."""
    padded = np.concatenate((np.zeros(n // 2), x, np.zeros(n // 2)))
    t = np.arange(n)
    w = {"hamming": 0.54 - 0.46 * np.cos(2 * np.pi * t / n), "hann": 0.5 - 0.5 * np.cos(2 * np.pi * t / n)}[shape]
    out = []
    for at in range(0, len(padded) - n + 1, hop):
        y = padded[at : at + n] * w
        out.append([abs(sum(y * np.exp(-2j * np.pi * k * t / n))) ** 2 for k in range(n // 2 + 1)])
    return np.array(out)


def test_mfcc_contrast_and_chroma_by_definition():
    rng = np.random.default_rng(4)
    x, sr, n = tone(440, 0.08) + 0.3 * tone(1500, 0.08) + 0.05 * rng.normal(size=1280), 16000, 512
    mel = lambda f: f * 3 / 200 if f < 1000 else 15 + 27 * np.log(f / 1000) / np.log(6.4)
    hertz = lambda m: m * 200 / 3 if m < 15 else 1000 * np.exp((m - 15) * np.log(6.4) / 27)
    points = [hertz(mel(sr / 2) * i / 129) for i in range(130)]
    bins = [k * sr / n for k in range(n // 2 + 1)]
    power = plain_power(x, n, 256, "hamming")
    db = np.empty((len(power), 128))
    for i, row in enumerate(power):
        for m in range(128):
            low, mid, high = points[m : m + 3]
            weights = [max(0, min((f - low) / (mid - low), (high - f) / (high - mid))) * 2 / (high - low) for f in bins]
            db[i, m] = 10 * np.log10(max(sum(a * b for a, b in zip(weights, row, strict=True)), 1e-10))
    db = np.maximum(db, db.max() - 80)
    want = np.array([[sum(row[m] * np.cos(np.pi * k * (2 * m + 1) / 256) for m in range(128)) * np.sqrt((1 if k == 0 else 2) / 128) for k in range(13)] for row in db])
    assert np.allclose(dsp.mfcc(x, sr), want, atol=1e-6)
    magnitude = np.sqrt(plain_power(x, n, 256, "hann"))
    edges = [0, 200, 400, 800, 1600, 3200, 6400, sr]
    for i, row in enumerate(magnitude):
        for k in range(7):
            band = sorted(v for v, f in zip(row, bins, strict=True) if edges[k] <= f <= edges[k + 1])
            count = max(1, int(round(0.02 * len(band))))
            got = 10 * np.log10(max(np.mean(band[-count:]), 1e-10)) - 10 * np.log10(max(np.mean(band[:count]), 1e-10))
            assert dsp.contrast(magnitude, sr)[i, k] == pytest.approx(got, abs=1e-6)
        classes = [0.0] * 12
        for v, f in zip(row[1:], bins[1:], strict=True):
            classes[int(np.round(12 * np.log2(f / 440) + 69)) % 12] += v**2
        assert dsp.chroma(magnitude, sr)[i] == pytest.approx([c / max(classes) for c in classes], abs=1e-9)
    assert np.allclose(dsp.spectrum(x, kind="hann"), magnitude, atol=1e-9)
    both = dsp.mfcc_frames(tone(440, 0.3), sr, delta_deltas=True)
    assert both.shape[1] == 39 and np.allclose(both[:, 26:], dsp.delta(both[:, :13], order=2))


def test_preprocess_tells_failures_apart(spark, corpus):
    waves, failures = pipelines.preprocess(spark, corpus)
    assert sorted(r["file_key"] for r in waves.collect()) == ["AL/a.wav", "AL/b.wav", "BE/c.wav", "BE/d.wav"]
    errors = {r["file_key"]: r["error"] for r in failures.collect()}
    assert "out of range" in errors["BE/short.wav"] and "not a PCM WAV" in errors["BE/bad.wav"]
    assert waves.select(F.max(F.array_max("samples"))).first()[0] == pytest.approx(1, abs=1e-3)
    heads = audio.headers(audio.scan(spark, corpus)).where("error IS NULL")
    assert heads.count() == 5 and heads.select("header.sample_rate").distinct().first()[0] == 8000
    assert pipelines.subset(spark, corpus, 1).count() == 2


def test_features_and_layers(spark, corpus, tmp_path):
    waves, _ = pipelines.preprocess(spark, corpus)
    out = pipelines.handcrafted(waves).toPandas()
    widths = out.groupby("feature_type")["vec"].apply(lambda v: {len(x) for x in v}).to_dict()
    assert widths == {"mfcc": {26}, "spectral": {24}, "prosodic": {26}, "combined": {76}}
    pipelines.extract_and_pool(spark, corpus, str(tmp_path), "toy", "projection", audio.RandomProjectionEncoder(2, 8))
    stored = tables.read_table(spark, str(tmp_path), "features_pooled", method="mean", layer=1)
    assert stored.count() == 4 and "layer" in str(stored._jdf.queryExecution().executedPlan().toString())
    scores = pipelines.evaluate_layers(spark.read.parquet(f"{tmp_path}/features_pooled"), (1,))
    assert {r["layer"] for r in scores.collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        audio.extract(waves, "unknown")


def test_missing_folders_are_told_and_skipped(spark, corpus):
    with pytest.warns(UserWarning, match="finch"):
        files = audio.scan_corpora(spark, {"toy": corpus, "finch": corpus + "-none"}, content=False)
    assert files.count() == 6 and files.select("dataset").distinct().first()[0] == "toy"
    with pytest.warns(UserWarning):
        assert audio.scan_corpora(spark, {"finch": corpus + "-none"}) is None


def test_manifests_and_stored_sets(spark, corpus, tmp_path):
    chosen = pipelines.subset(spark, corpus, 1)
    reports.write_json(pipelines.manifest(chosen, "toy", 1), f"{tmp_path}/manifest")
    back = spark.read.json(f"{tmp_path}/manifest").first()
    assert (back["dataset"], back["total_files"], back["random_seed"]) == ("toy", 2, 42) and back["individuals"]["AL"]["num_files"] == 1
    assert pipelines.chosen_clips(spark, corpus, chosen).count() == 2
    assert tables.handcrafted_sets(spark, str(tmp_path), "toy") is None
    waves, _ = pipelines.preprocess(spark, corpus)
    tables.write_table(pipelines.handcrafted(waves).withColumn("dataset", F.lit("toy")), str(tmp_path), "features_handcrafted")
    sets = tables.handcrafted_sets(spark, str(tmp_path), "toy")
    assert {r[0] for r in sets.select("feature_type").distinct().collect()} == set(tables.HANDCRAFTED) and tables.handcrafted_sets(spark, str(tmp_path), "none") is None


def test_blocks_of_a_corpus(spark):
    rows = [("adult", "A", "DC", 1.0), ("adult", "B", None, 3.0), ("adult", "A", "Te", 2.0), ("chick", "C", "DC", None)]
    out = {r["block"]: r for r in stats.corpus_blocks(spark.createDataFrame(rows, "block string, who string, call string, seconds double"), "block", "who", "call", "seconds").collect()}
    assert (out["adult"]["individuals"], out["adult"]["call_types"], out["adult"]["avg_duration"]) == (["A", "B"], ["DC", "Te"], 2.0)
    assert (out["chick"]["num_files"], out["chick"]["avg_duration"]) == (1, 0.0)


def test_encoder_layers_by_numpy(spark):
    encoder = audio.RandomProjectionEncoder(2, 8)
    x = tone(440, 0.2).astype(np.float32)
    found = encoder.encode(x, 16000)
    frames = np.stack([x[i : i + 400] for i in range(0, len(x) - 399, 320)]).astype(float)
    rng = np.random.default_rng(42)
    state = np.tanh(frames @ rng.normal(size=(400, 8)) / 20)
    assert np.allclose(found[0], state)
    for k in (1, 2):
        state = np.tanh(state @ rng.normal(size=(8, 8)) / np.sqrt(8))
        assert np.allclose(found[k], state)
    again = encoder.encode(x, 16000)
    assert all((again[k] == v).all() for k, v in found.items())


def test_stream(spark, corpus):
    q = stream_waveforms(spark, corpus).select("file_key", "label", "error").writeStream.format("memory").queryName("clips").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("clips").where("error IS NULL").count() == 4


def test_layouts_keep_clusters_apart():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(25, 6)) + 12 * np.eye(6)[k] for k in range(3)])
    for y in (tsne(x, perplexity=8, steps=250), umap(x, neighbours=8, epochs=100)):
        centres = np.stack([y[25 * k : 25 * (k + 1)].mean(0) for k in range(3)])
        near = np.linalg.norm(y[:, None] - centres[None], axis=2).argmin(1)
        assert (near == np.repeat(range(3), 25)).mean() > 0.9


def test_resampling_does_not_wrap_and_blocks_do_not_matter():
    rng = np.random.default_rng(6)
    x = rng.normal(size=24414)
    for sr, target in ((24414, 16000), (44100, 16000), (8000, 16000)):
        whole, parts = dsp.resample(x, sr, target, 1 << 20), dsp.resample(x, sr, target, 1000)
        assert len(whole) == round(len(x) * target / sr) and np.allclose(whole, parts, atol=1e-12)
        click = np.zeros(sr)
        click[-1] = 1
        assert np.abs(dsp.resample(click, sr, target)[: target // 2]).max() == 0
        t = np.arange(sr) / sr
        tone = dsp.resample(np.sin(2 * np.pi * 440 * t), sr, target)
        at = np.arange(target) / target
        assert np.abs(tone - np.sin(2 * np.pi * 440 * at))[200:-200].max() < 1e-3
    high = dsp.resample(np.sin(2 * np.pi * 11000 * np.arange(44100) / 44100), 44100, 16000)
    assert np.abs(high[200:-200]).max() < 1e-3  # above the band of the lower rate
    assert np.allclose(dsp.resample(np.ones(5000), 44100, 16000)[200:-200], 1)


def test_one_run_counts_and_writes(spark, tmp_path):
    from chorale.plans import pipelines

    for name, n in (("A/a.wav", 8000), ("A/b.wav", 16000), ("B/short.wav", 100)):
        at = tmp_path / "in" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(audio.encode_wav(np.sin(np.arange(n) / 7), 16000))
    (tmp_path / "in" / "B" / "bad.wav").write_bytes(b"nothing")
    counts = pipelines.preprocess_to(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert counts == {"success": 2, "failed": 1, "out_of_range": 1}
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert {r["file_key"]: r["status"] for r in stored.collect()} == {"A/a.wav": "success", "A/b.wav": "success", "B/short.wav": "out_of_range", "B/bad.wav": "failed"}
