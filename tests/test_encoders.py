"""The speech encoder on small random weights against plain loops, and clips through Spark."""

import json
import math

import numpy as np
import pytest

from chorale.sources import audio
from chorale.sources.encoders import SpeechEncoder, gelu

KERNELS, STEPS = (10, 3, 2), (5, 2, 2)


def save(path, weights, prefix="wav2vec2."):
    head, at, parts = {"__metadata__": {"format": "np"}}, 0, []
    for name, v in weights.items():
        v = np.ascontiguousarray(v, "<f4")
        head[prefix + name] = {"dtype": "F32", "shape": list(v.shape), "data_offsets": [at, at + v.nbytes]}
        at += v.nbytes
        parts.append(v.tobytes())
    text = json.dumps(head).encode()
    path.write_bytes(len(text).to_bytes(8, "little") + text + b"".join(parts))
    return str(path)


def random_weights(large, channels=6, width=8, inner=12, layers=2, groups=2, kernel=4, seed=1):
    rng = np.random.default_rng(seed)
    w = {}

    def linear(name, a, b):
        w[f"{name}.weight"], w[f"{name}.bias"] = rng.normal(size=(b, a)) / np.sqrt(a), rng.normal(size=b) / 10

    def norm(name, n):
        w[f"{name}.weight"], w[f"{name}.bias"] = 1 + rng.normal(size=n) / 10, rng.normal(size=n) / 10

    for k, size in enumerate(KERNELS):
        name = f"feature_extractor.conv_layers.{k}"
        w[f"{name}.conv.weight"] = rng.normal(size=(channels, 1 if k == 0 else channels, size))
        if large:
            w[f"{name}.conv.bias"] = rng.normal(size=channels)
        if large or k == 0:
            norm(f"{name}.layer_norm", channels)
    norm("feature_projection.layer_norm", channels)
    linear("feature_projection.projection", channels, width)
    name = "encoder.pos_conv_embed.conv"
    w[f"{name}.weight_g"], w[f"{name}.weight_v"], w[f"{name}.bias"] = rng.random((1, 1, kernel)) + 0.5, rng.normal(size=(width, width // groups, kernel)), rng.normal(size=width) / 10
    norm("encoder.layer_norm", width)
    for k in range(layers):
        name = f"encoder.layers.{k}"
        for p in ("q_proj", "k_proj", "v_proj", "out_proj"):
            linear(f"{name}.attention.{p}", width, width)
        linear(f"{name}.feed_forward.intermediate_dense", width, inner)
        linear(f"{name}.feed_forward.output_dense", inner, width)
        norm(f"{name}.layer_norm", width)
        norm(f"{name}.final_layer_norm", width)
    return w


def plain(w, x, large, heads, kernel=4, groups=2):
    """Every layer by loops over frames, channels and places."""
    act = np.vectorize(lambda v: 0.5 * v * (1 + math.erf(v / math.sqrt(2))))

    def norm(name, row):
        m, s = sum(row) / len(row), sum((v - sum(row) / len(row)) ** 2 for v in row) / len(row)
        return np.array([(v - m) / math.sqrt(s + 1e-5) * a + b for v, a, b in zip(row, w[f"{name}.weight"], w[f"{name}.bias"], strict=True)])

    def linear(name, row):
        return np.array([sum(a * b for a, b in zip(line, row, strict=True)) + c for line, c in zip(w[f"{name}.weight"], w[f"{name}.bias"], strict=True)])

    x = (x - x.mean()) / math.sqrt(x.var() + 1e-7)
    frames = [[v] for v in x]
    for k, (size, step) in enumerate(zip(KERNELS, STEPS, strict=True)):
        name = f"feature_extractor.conv_layers.{k}"
        weight, bias = w[f"{name}.conv.weight"], w.get(f"{name}.conv.bias", np.zeros(len(w[f"{name}.conv.weight"])))
        frames = [[bias[o] + sum(weight[o, c, j] * frames[t + j][c] for c in range(weight.shape[1]) for j in range(size)) for o in range(len(weight))] for t in range(0, len(frames) - size + 1, step)]
        if large:
            frames = [norm(f"{name}.layer_norm", f) for f in frames]
        elif k == 0:
            f = np.array(frames)
            frames = (f - f.mean(0)) / np.sqrt(f.var(0) + 1e-5) * w[f"{name}.layer_norm.weight"] + w[f"{name}.layer_norm.bias"]
        frames = [act(np.array(f)) for f in frames]
    h = [linear("feature_projection.projection", norm("feature_projection.layer_norm", f)) for f in frames]
    g, v, b = (w[f"encoder.pos_conv_embed.conv.{n}"] for n in ("weight_g", "weight_v", "bias"))
    width = len(b)
    weight = np.array([[[g[0, 0, j] * v[o, c, j] / math.sqrt((v[:, :, j] ** 2).sum()) for j in range(kernel)] for c in range(v.shape[1])] for o in range(width)])
    n, per = len(h), width // groups
    placed = [[b[o] + sum(weight[o, c, j] * h[t + j - kernel // 2][o // per * per + c] for c in range(per) for j in range(kernel) if 0 <= t + j - kernel // 2 < n) for o in range(width)] for t in range(n)]
    h = [h[t] + act(np.array(placed[t])) for t in range(n)]
    if not large:
        h = [norm("encoder.layer_norm", r) for r in h]
    out = {0: np.array(h)}

    def attend(name, rows):
        q, k, v = ([linear(f"{name}.{p}_proj", r) for r in rows] for p in "qkv")
        d, got = width // heads, []
        for i in range(n):
            row = []
            for a in range(heads):
                s = [math.exp(sum(q[i][a * d + e] * k[j][a * d + e] for e in range(d)) / math.sqrt(d)) for j in range(n)]
                row += [sum(s[j] * v[j][a * d + e] for j in range(n)) / sum(s) for e in range(d)]
            got.append(linear(f"{name}.out_proj", row))
        return got

    for k in range(2):
        name = f"encoder.layers.{k}"
        feed = lambda r, name=name: linear(f"{name}.feed_forward.output_dense", act(linear(f"{name}.feed_forward.intermediate_dense", r)))
        if large:
            h = [r + a for r, a in zip(h, attend(f"{name}.attention", [norm(f"{name}.layer_norm", r) for r in h]), strict=True)]
            h = [r + feed(norm(f"{name}.final_layer_norm", r)) for r in h]
        else:
            h = [norm(f"{name}.layer_norm", r + a) for r, a in zip(h, attend(f"{name}.attention", h), strict=True)]
            h = [norm(f"{name}.final_layer_norm", r + feed(r)) for r in h]
        out[k + 1] = np.array(h)
    if large:
        out[2] = np.array([norm("encoder.layer_norm", r) for r in h])
    return out


@pytest.mark.parametrize("large", [False, True])
def test_every_layer_equals_plain_loops(tmp_path, large):
    w = {k: v.astype(np.float32).astype(float) for k, v in random_weights(large).items()}
    encoder = SpeechEncoder(save(tmp_path / "model.safetensors", w), heads=2, strides=STEPS)
    x = np.sin(np.arange(150) / 3) + np.random.default_rng(2).normal(size=150) / 5
    got, want = encoder.encode(x, 16000), plain(w, x.astype(np.float32).astype(float), large, 2)
    assert sorted(got) == sorted(want) == [0, 1, 2]
    for k in want:
        assert got[k].shape == want[k].shape and np.allclose(got[k], want[k], atol=1e-4)


def test_activation_and_faults(tmp_path):
    x = np.linspace(-6, 6, 200)
    assert np.allclose(gelu(x), [0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in x], atol=1e-6)
    path = save(tmp_path / "other.safetensors", {"head.weight": np.ones((2, 2))})
    with pytest.raises(ValueError, match="no weights"):
        SpeechEncoder(path).encode(np.zeros(100), 16000)
    encoder = SpeechEncoder(save(tmp_path / "m.safetensors", random_weights(False)), heads=2, strides=STEPS)
    with pytest.raises(ValueError, match="too short"):
        encoder.encode(np.zeros(5), 16000)


def test_clips_go_through_the_encoder_in_spark(spark, tmp_path):
    encoder = SpeechEncoder(save(tmp_path / "model.safetensors", random_weights(True)), heads=2, strides=STEPS)
    rng = np.random.default_rng(3)
    clips = [(str(i), rng.normal(size=100 + 20 * i).tolist(), 16000) for i in range(5)] + [("short", [0.0] * 4, 16000)]
    out = audio.encode(spark.createDataFrame(clips, "file_key string, samples array<float>, sr int"), encoder, [0, 2]).collect()
    assert len(out) == 11 and [r["file_key"] for r in out if r["error"]] == ["short"]
    for r in out:
        if not r["error"]:
            x = np.array(dict((k, s) for k, s, _ in clips)[r["file_key"]], np.float32)
            assert np.allclose(r["frames"], encoder.encode(x, 16000)[r["layer"]], atol=1e-4)
