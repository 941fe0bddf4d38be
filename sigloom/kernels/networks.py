"""Network architectures over a parameter table {tensor: array}. No parameters ship with the library."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import cycle

import numpy as np

from sigloom.kernels import layers as L


def normalised_event_features(mean, stdv, length):
    """mean, stdv, length and the absolute step to the next mean, each to zero mean and unit deviation."""
    step = np.abs(np.diff(mean, append=mean[-1:]))
    x = np.stack([mean, stdv, length, step], axis=1).astype(float)
    dev = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(dev > 0, dev, 1.0)


def _finish(x, p, min_prob, t_weight, t_bias, log):
    out = L.softmax_tempered(x, p["softmax_W"], p["softmax_b"], t_weight, t_bias)
    return L.robust_log(out, min_prob) if log else out


def events_posterior(features, p, min_prob=1e-5, t_weight=1.0, t_bias=1.0, log=True, zero_head=False):
    """Windows of three, two bidirectional LSTM layers with combining layers, softmax."""
    x = L.window(features, 3, zero_head=zero_head)
    for k in (1, 2):
        fwd, bwd = (L.lstm(x, p[f"lstm{d}{k}_iW"], p[f"lstm{d}{k}_b"], p[f"lstm{d}{k}_sW"], p[f"lstm{d}{k}_p"], d == "B") for d in "FB")
        x = L.both_ways(fwd, bwd, p[f"ff{k}_Wf"], p[f"ff{k}_Wb"], p[f"ff{k}_b"])
    return _finish(x, p, min_prob, t_weight, t_bias, log)


def raw_r94_posterior(signal, p, stride, min_prob=1e-5, t_weight=1.0, t_bias=1.0, log=True):
    """Convolution with tanh, two bidirectional GRU layers, softmax."""
    x = np.tanh(L.convolve(np.asarray(signal, float)[:, None], p["conv_W"], p["conv_b"], stride))
    for k in (1, 2):
        fwd, bwd = (L.gru(x, p[f"gru{d}{k}_iW"], p[f"gru{d}{k}_b"], p[f"gru{d}{k}_sW"], p[f"gru{d}{k}_sW2"], d == "B") for d in "FB")
        x = L.both_ways(fwd, bwd, p[f"ff{k}_Wf"], p[f"ff{k}_Wb"], p[f"ff{k}_b"])
    return _finish(x, p, min_prob, t_weight, t_bias, log)


def _five_grus(signal, p, stride, activation, residual):
    x = activation(L.convolve(np.asarray(signal, float)[:, None], p["conv_W"], p["conv_b"], stride))
    for k, d in zip(range(1, 6), cycle("BF")):
        y = L.gru(x, p[f"gru{d}{k}_iW"], p[f"gru{d}{k}_b"], p[f"gru{d}{k}_sW"], p[f"gru{d}{k}_sW2"], d == "B")
        x = x + y if residual else y
    return x


def rgrgr_posterior(signal, p, stride, activation=L.elu, min_prob=1e-5, t_weight=1.0, t_bias=1.0, log=True):
    """Convolution, GRU layers backward, forward, backward, forward, backward, softmax."""
    return _finish(_five_grus(signal, p, stride, activation, False), p, min_prob, t_weight, t_bias, log)


def rnnrf_transitions(signal, p, stride, **_ignored):
    """As rgrgr with residual layers, and globally normalised transition scores, in logs."""
    return L.global_norm(_five_grus(signal, p, stride, L.elu, True), p["globalnorm_W"], p["globalnorm_b"])


def squiggle(states, p, rescale=False):
    """(positions, 3): current, log of its deviation, minus log of the dwell; rescaled: current, deviation, dwell."""
    x = np.tanh(L.convolve(L.embedding(states, p["embed_W"]), p["conv1_W"], p["conv1_b"]))
    for k in range(2, 6):
        x = x + np.tanh(L.convolve(x, p[f"conv{k}_W"], p[f"conv{k}_b"]))
    x = L.convolve(x, p["conv6_W"], p["conv6_b"])
    return np.stack([x[:, 0], np.exp(x[:, 1]), np.exp(-x[:, 2])], axis=1) if rescale else x


def squiggles(sequences, p, rescale=False):
    """squiggle of each of several sequences of states, in one pass: they lie side by side with gaps that stay zero between layers."""
    reach = max(p[f"conv{k}_W"].shape[1] for k in range(1, 7))
    sizes = np.array([len(s) for s in sequences])
    first = np.cumsum(sizes + reach) - sizes - reach
    total = int((sizes + reach).sum())
    inside = np.zeros(total, bool)
    where = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    inside[where] = True
    x = np.zeros((total, p["embed_W"].shape[1]))
    x[where] = L.embedding(np.concatenate(sequences), p["embed_W"])
    for k in range(1, 6):
        y = np.tanh(L.convolve(x, p[f"conv{k}_W"], p[f"conv{k}_b"])) * inside[:, None]
        x = y if k == 1 else x + y
    x = L.convolve(x, p["conv6_W"], p["conv6_b"])[where]
    if rescale:
        x = np.stack([x[:, 0], np.exp(x[:, 1]), np.exp(-x[:, 2])], axis=1)
    return np.split(x, np.cumsum(sizes)[:-1])


@dataclass(frozen=True)
class Architecture:
    run: object
    stride: int
    crf: bool = False


#: Basecalling models by name. Strides are fixed values.
RAW = {
    "raw_r94": Architecture(raw_r94_posterior, 4),
    "rgrgr_r94": Architecture(rgrgr_posterior, 5),
    "rgrgr_r941": Architecture(rgrgr_posterior, 5),
    "rgrgr_r10": Architecture(lambda signal, p, stride, **k: rgrgr_posterior(signal, p, stride, np.tanh, **k), 5),
    "rnnrf_r94": Architecture(rnnrf_transitions, 5, True),
}
SQUIGGLE = ("squiggle_r94", "squiggle_r94_rna", "squiggle_r10")


def model(name: str) -> Architecture:
    if name not in RAW:
        raise ValueError(f"no model {name!r}; one of {', '.join(RAW)}")
    return RAW[name]


def model_stride(name: str) -> int:
    return model(name).stride


def posterior(name: str, signal, params, **options):
    m = model(name)
    return m.run(signal, params, params.get("stride", m.stride), **options)


def squiggle_model(name: str):
    if name not in SQUIGGLE:
        raise ValueError(f"no squiggle model {name!r}; one of {', '.join(SQUIGGLE)}")
    return squiggles


# ---- seeded parameters, for tests and benchmarks ------------------------------------------------------------
def random_parameters(name: str, size: int = 8, states: int = 1025, width: int = 11, seed: int = 0) -> dict[str, np.ndarray]:
    """Parameters of the right shapes for a model name, "events" or a squiggle model."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-1]), shape)
    p: dict[str, np.ndarray] = {}
    if name in SQUIGGLE:
        p["embed_W"] = draw(4, 3)
        for k, (n, m) in enumerate([(3, size), *[(size, size)] * 4, (size, 3)], 1):
            p[f"conv{k}_W"], p[f"conv{k}_b"] = draw(m, 7, n) / 3, draw(m)
        return p
    if name == "events":
        n = 12
        for k in (1, 2):
            for d in "FB":
                p |= {f"lstm{d}{k}_iW": draw(4 * size, n), f"lstm{d}{k}_b": draw(4 * size), f"lstm{d}{k}_sW": draw(4 * size, size), f"lstm{d}{k}_p": draw(3, size)}
            p |= {f"ff{k}_Wf": draw(size, size), f"ff{k}_Wb": draw(size, size), f"ff{k}_b": draw(size)}
            n = size
    else:
        p |= {"conv_W": draw(size, width, 1), "conv_b": draw(size)}
        layout = [(k, d) for k in (1, 2) for d in "FB"] if name == "raw_r94" else list(zip(range(1, 6), cycle("BF")))
        for k, d in layout:
            p |= {f"gru{d}{k}_iW": draw(3 * size, size), f"gru{d}{k}_b": draw(3 * size), f"gru{d}{k}_sW": draw(2 * size, size), f"gru{d}{k}_sW2": draw(size, size)}
        if name == "raw_r94":
            for k in (1, 2):
                p |= {f"ff{k}_Wf": draw(size, size), f"ff{k}_Wb": draw(size, size), f"ff{k}_b": draw(size)}
    if name == "rnnrf_r94":
        p |= {"globalnorm_W": draw(25, size), "globalnorm_b": draw(25)}
    else:
        p |= {"softmax_W": draw(states, size), "softmax_b": draw(states)}
    return p


def with_temperature(p: dict, weight: float, bias: float | None = None) -> dict:
    """The parameters with the softmax layer at another temperature."""
    return p | {"softmax_W": p["softmax_W"] / weight, "softmax_b": p["softmax_b"] / (weight if bias is None else bias)}
