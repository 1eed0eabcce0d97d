"""A frozen speech encoder on numpy that reads its weights from a file: convolutions over samples, then transformer layers.

The shape is that of wav2vec 2.0 (Baevski et al., 2020), and the names of the weights are those under which such
checkpoints are published as safetensors files. What differs between checkpoints is told by their weights: number,
width and kernels of convolutions and layers, and whether every convolution is followed by a norm over channels, in
which case layers are normed before their parts, or only the first by one over time, in which case after them. The
file is mapped once in every worker, so its pages are shared and only what a layer needs is read.
"""

from __future__ import annotations

import functools
import json
import mmap
from dataclasses import dataclass

import numpy as np

#: Steps of the seven convolutions; weights do not tell them.
STRIDES = (5, 2, 2, 2, 2, 2, 2)
_KINDS = {"F32": "<f4", "F16": "<f2", "F64": "<f8", "I64": "<i8", "I32": "<i4"}
EPS = 1e-5


@functools.cache
def mapped(path: str) -> dict[str, np.ndarray]:
    """Arrays of a safetensors file by name, without a prefix that all encoder weights share; nothing is copied."""
    with open(path, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(data[:8], "little")
    out = {}
    for name, about in json.loads(data[8 : 8 + size]).items():
        if name == "__metadata__" or about["dtype"] not in _KINDS:
            continue
        begin, end = about["data_offsets"]
        out[name] = np.frombuffer(data, _KINDS[about["dtype"]], (end - begin) // np.dtype(_KINDS[about["dtype"]]).itemsize, 8 + size + begin).reshape(about["shape"])
    first = next((n for n in out if n.endswith("feature_extractor.conv_layers.0.conv.weight")), None)
    if first is None:
        raise ValueError(f"{path} has no weights of such an encoder")
    prefix = first[: -len("feature_extractor.conv_layers.0.conv.weight")]
    return {n[len(prefix) :]: v for n, v in out.items() if n.startswith(prefix)}


def gelu(x: np.ndarray) -> np.ndarray:
    """x times the normal distribution function; the error function by a rational form with an error below 1.5e-7."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return 0.5 * x * (1 + np.sign(x) * (1 - tail))


def _centred(x: np.ndarray, axis: int) -> np.ndarray:
    x = x - x.mean(axis=axis, keepdims=True)
    return x / np.sqrt((x * x).mean(axis=axis, keepdims=True) + EPS)


def convolve(x: np.ndarray, weight: np.ndarray, bias: np.ndarray | None, step: int = 1, groups: int = 1) -> np.ndarray:
    """(frames, inputs) with weights (outputs, inputs / groups, kernel) as (frames, outputs)."""
    out, each, kernel = weight.shape
    windows = np.lib.stride_tricks.sliding_window_view(x, kernel, axis=0)[::step]  # frames, inputs, kernel
    per = out // groups
    parts = [windows[:, g * each : (g + 1) * each].reshape(len(windows), -1) @ weight[g * per : (g + 1) * per].reshape(per, -1).T for g in range(groups)]
    y = np.concatenate(parts, axis=1)
    return y if bias is None else y + bias


@dataclass(frozen=True)
class SpeechEncoder:
    """An :class:`chorale.sources.audio.Encoder` from a file of weights that every worker can open.

    Layer 0 is what the first layer gets, the others are what each layer gives; with norms before the parts the last
    one is normed once more. ``heads`` are by default as many as 64 go into the width.
    """

    path: str
    heads: int | None = None
    strides: tuple[int, ...] = STRIDES
    normalise: bool = True

    def encode(self, samples: np.ndarray, sr: int) -> dict[int, np.ndarray]:
        w = mapped(self.path)
        x = np.asarray(samples, np.float32)
        if self.normalise:
            x = (x - x.mean()) / np.sqrt(x.var() + 1e-7)
        before = "feature_extractor.conv_layers.1.layer_norm.weight" in w
        state = self._positioned(w, self._frames(w, x[:, None], before))
        if not before:
            state = self._norm(w, "encoder.layer_norm", state)
        out, k = {0: state}, 0
        while f"encoder.layers.{k}.attention.q_proj.weight" in w:
            state = self._layer(w, f"encoder.layers.{k}", state, before)
            k += 1
            out[k] = state
        if before:
            out[k] = self._norm(w, "encoder.layer_norm", state)
        return out

    def _norm(self, w: dict, name: str, x: np.ndarray) -> np.ndarray:
        return _centred(x, -1) * w[f"{name}.weight"] + w[f"{name}.bias"]

    def _linear(self, w: dict, name: str, x: np.ndarray) -> np.ndarray:
        return x @ w[f"{name}.weight"].T + w[f"{name}.bias"]

    def _frames(self, w: dict, x: np.ndarray, normed: bool) -> np.ndarray:
        k = 0
        while f"feature_extractor.conv_layers.{k}.conv.weight" in w:
            name = f"feature_extractor.conv_layers.{k}"
            weight = w[f"{name}.conv.weight"]
            if len(x) < weight.shape[2]:
                raise ValueError("the clip is too short for a frame")
            x = convolve(x, weight, w.get(f"{name}.conv.bias"), self.strides[k])
            if normed:
                x = self._norm(w, f"{name}.layer_norm", x)
            elif k == 0:  # each channel over time
                x = _centred(x, 0) * w[f"{name}.layer_norm.weight"] + w[f"{name}.layer_norm.bias"]
            x = gelu(x)
            k += 1
        return self._linear(w, "feature_projection.projection", self._norm(w, "feature_projection.layer_norm", x))

    def _positioned(self, w: dict, x: np.ndarray) -> np.ndarray:
        """``x`` and a convolution over it, whose weights are stored as a direction and a length for each place of the kernel."""
        name = "encoder.pos_conv_embed.conv"
        length = w.get(f"{name}.parametrizations.weight.original0", w.get(f"{name}.weight_g"))
        direction = w.get(f"{name}.parametrizations.weight.original1", w.get(f"{name}.weight_v"))
        weight = length * direction / np.sqrt((direction.astype(np.float64) ** 2).sum(axis=(0, 1), keepdims=True))
        kernel = weight.shape[2]
        padded = np.pad(x, ((kernel // 2, kernel // 2 - (kernel % 2 == 0)), (0, 0)))
        return x + gelu(convolve(padded, weight, w[f"{name}.bias"], 1, x.shape[1] // weight.shape[1]))

    def _layer(self, w: dict, name: str, x: np.ndarray, before: bool) -> np.ndarray:
        if before:
            x = x + self._attend(w, f"{name}.attention", self._norm(w, f"{name}.layer_norm", x))
            return x + self._feed(w, name, self._norm(w, f"{name}.final_layer_norm", x))
        x = self._norm(w, f"{name}.layer_norm", x + self._attend(w, f"{name}.attention", x))
        return self._norm(w, f"{name}.final_layer_norm", x + self._feed(w, name, x))

    def _feed(self, w: dict, name: str, x: np.ndarray) -> np.ndarray:
        return self._linear(w, f"{name}.feed_forward.output_dense", gelu(self._linear(w, f"{name}.feed_forward.intermediate_dense", x)))

    def _attend(self, w: dict, name: str, x: np.ndarray) -> np.ndarray:
        heads = self.heads or max(1, x.shape[1] // 64)
        q, k, v = (self._linear(w, f"{name}.{p}_proj", x).reshape(len(x), heads, -1).transpose(1, 0, 2) for p in "qkv")
        scores = q @ k.transpose(0, 2, 1) / np.sqrt(q.shape[2])
        scores = np.exp(scores - scores.max(axis=2, keepdims=True))
        mixed = (scores / scores.sum(axis=2, keepdims=True)) @ v
        return self._linear(w, f"{name}.out_proj", mixed.transpose(1, 0, 2).reshape(len(x), -1))
