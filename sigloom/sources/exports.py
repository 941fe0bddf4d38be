"""Parameters from pickled networks of layer objects, without the library that made them and without running its code.

A network is walked for its leaf layers, which are told apart by their tensors: a convolution has filters W (outputs,
inputs, window), a gated unit iW, sW and sW2, an LSTM iW, sW and peepholes p, a dense layer W and b. Where dense layers
stand between pairs of recurrent ones, a pair is one level read forward and backward; else levels alternate, backward first.
"""

from __future__ import annotations

import io
import pickle

import numpy as np

from sigloom.sources.readers import stay_last

_NUMPY = ("_reconstruct", "ndarray", "dtype", "scalar", "_frombuffer")


class Holder:
    """Stands for any object: its state, and nothing that it could do."""

    def __init__(self, *args):
        self.args = args

    def __setstate__(self, state) -> None:
        for part in state if isinstance(state, tuple) else (state,):
            if isinstance(part, dict):
                self.__dict__.update({str(k): v for k, v in part.items()})
            elif part is not None:
                self.__dict__["state"] = part


class _Unpickler(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if module.split(".")[0] == "numpy" and name in _NUMPY:
            return super().find_class(module, name)
        return type(name, (Holder,), {})


def load_layers(content: bytes):
    """The network as holders."""
    return _Unpickler(io.BytesIO(content), encoding="latin1").load()


def _array(x) -> np.ndarray | None:
    """An array, or the one that a variable holds."""
    if isinstance(x, np.ndarray):
        return x.astype(float)
    inner = x if isinstance(x, (list, tuple)) else list(vars(x).values()) if isinstance(x, Holder) else []
    return next((a for a in map(_array, inner) if a is not None), None)


def leaves(layer) -> list:
    """Layers with tensors, in order."""
    inner = getattr(layer, "sublayers", None)
    if inner is not None:
        return [x for part in inner for x in leaves(part)]
    return [layer] if any(hasattr(layer, n) for n in ("W", "iW")) else []


def gate_major(w: np.ndarray, gates: int = 4) -> np.ndarray:
    """Rows of a unit's gates side by side to all units of a gate side by side."""
    return w.reshape(-1, gates, *w.shape[1:]).swapaxes(0, 1).reshape(w.shape)


def parameters_from_layers(network, crf: bool = False) -> dict[str, np.ndarray]:
    """The tensors of an events, raw, rgr, rgrgr (also residual) or, with crf, rnnrf network under the names of sigloom.kernels.networks.

    A softmax's stay row, the first, goes last; a CRF's rows stay.
    """
    parts = leaves(network)
    of = lambda x, n: _array(getattr(x, n))
    recurrent = [x for x in parts if hasattr(x, "iW")]
    dense = [x for x in parts if not hasattr(x, "iW") and of(x, "W").ndim == 2]
    filters = [x for x in parts if not hasattr(x, "iW") and of(x, "W").ndim == 3]
    if not dense or len(filters) > 1 or len(dense) > 1 and len(recurrent) != 2 * (len(dense) - 1):
        raise ValueError("not a network of a known layout")
    out: dict[str, np.ndarray] = {}
    for x in filters:
        out |= {"conv_W": of(x, "W").swapaxes(1, 2), "conv_b": of(x, "b").reshape(-1)}
        if hasattr(x, "stride"):
            out["stride"] = int(x.stride)
    paired = len(dense) > 1
    for i, x in enumerate(recurrent):
        name = f"{'FB'[i % 2]}{i // 2 + 1}" if paired else f"{'BF'[i % 2]}{i + 1}"
        if hasattr(x, "sW2"):
            out |= {f"gru{name}_{n}": of(x, n) for n in ("iW", "sW", "sW2")} | {f"gru{name}_b": of(x, "b").reshape(-1)}
        else:
            out |= {f"lstm{name}_{n}": gate_major(of(x, n)) for n in ("iW", "sW")}
            out |= {f"lstm{name}_b": gate_major(of(x, "b").reshape(-1)), f"lstm{name}_p": of(x, "p").reshape(3, -1)}
    for k, x in enumerate(dense[:-1], 1):
        w = of(x, "W")
        out |= {f"ff{k}_Wf": w[:, : w.shape[1] // 2], f"ff{k}_Wb": w[:, w.shape[1] // 2 :], f"ff{k}_b": of(x, "b").reshape(-1)}
    w, b = of(dense[-1], "W"), of(dense[-1], "b").reshape(-1)
    return out | ({"globalnorm_W": w, "globalnorm_b": b} if crf else {"softmax_W": stay_last(w), "softmax_b": stay_last(b)})


def parameters_from_network_file(path: str, crf: bool = False) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        return parameters_from_layers(load_layers(f.read()), crf)
