"""Matrices as array<array<double>>: a list of blocks (columns), each a list of features. All Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloom.functions import numeric as N


def each(m: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(m, lambda block: F.transform(block, f))


def tanh(m: Column) -> Column:
    return each(m, F.tanh)


def exp(m: Column) -> Column:
    return each(m, F.exp)


def log(m: Column) -> Column:
    return each(m, F.log)


def elu(m: Column) -> Column:
    return each(m, N.elu)


def robust_log(m: Column, min_prob: float) -> Column:
    """log(min_prob + (1 - min_prob) x)."""
    return each(m, lambda x: F.log(F.lit(min_prob) + x * (1.0 - min_prob)))


def shift_scale(m: Column, shift: float, scale: float) -> Column:
    return each(m, lambda x: (x - shift) / scale)


def clip(m: Column, threshold: float) -> Column:
    return each(m, lambda x: N.clip(x, threshold))


def filter_large(m: Column, threshold: float, fill: float = 0.0) -> Column:
    return each(m, lambda x: N.large_to(x, threshold, fill))


def difference(m: Column, last: float = 0.0) -> Column:
    """Next block less this one; the last block is filled."""
    step = lambda x, y: F.coalesce(F.zip_with(y, x, lambda q, p: q - p), F.transform(x, lambda p: F.lit(last)))
    return F.zip_with(m, F.slice(m, 2, F.size(m)), step)


def normalise(m: Column) -> Column:
    """Each block divided by its sum."""
    return F.transform(m, normalise_block)


def normalise_block(block: Column) -> Column:
    return N.let(N.total(block), lambda t: F.transform(block, lambda x: x / t))


def softmax(m: Column) -> Column:
    """Of each block, shifted by its maximum so that nothing overflows."""
    return F.transform(m, lambda block: softmax_block(block))


def softmax_block(block: Column) -> Column:
    return N.let(F.array_max(block), lambda most: N.let(F.transform(block, lambda x: F.exp(x - most)), normalise_block))


def affine(m: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Every block times weights (outputs x features) plus bias."""
    outs = F.lit([[*map(float, w), float(b)] for w, b in zip(weights, bias, strict=True)])
    k = len(weights[0])
    dot = lambda block, w: N.total(F.zip_with(block, F.slice(w, 1, k), lambda x, y: x * y)) + F.element_at(w, k + 1)
    return F.transform(m, lambda block: F.transform(outs, lambda w: dot(block, w)))


def tanh_dense(m: Column, weights: list[list[float]], bias: list[float]) -> Column:
    return tanh(affine(m, weights, bias))


def exp_dense(m: Column, weights: list[list[float]], bias: list[float]) -> Column:
    return exp(affine(m, weights, bias))


def affine2(m1: Column, m2: Column, w1: list[list[float]], w2: list[list[float]], bias: list[float]) -> Column:
    """Two inputs' products added, and the bias."""
    return residual(affine(m1, w1, bias), affine(m2, w2, [0.0] * len(bias)))


def residual(x: Column, fx: Column) -> Column:
    return F.zip_with(x, fx, lambda a, b: F.zip_with(a, b, lambda p, q: p + q))


def embedding(index: Column, vectors: list[list[float]]) -> Column:
    """The vector of each zero-based index."""
    table = F.lit([list(map(float, v)) for v in vectors])
    return F.transform(index, lambda i: F.element_at(table, i.cast("int") + 1))


def window(m: Column, width: int, stride: int = 1, zero_head: bool = False) -> Column:
    """Blocks i - width // 2 to i + width // 2 side by side, zero beyond the ends, every ``stride`` blocks.

    zero_head: blocks whose window begins before the first block are all zero.
    """
    half = width // 2

    def over(m: Column) -> Column:
        zero = F.transform(F.get(m, F.lit(0)), lambda x: F.lit(0.0))

        def stacked(i: Column) -> Column:
            parts = F.flatten(F.array(*[F.when(i + d >= 0, F.coalesce(F.get(m, i + d), zero)).otherwise(zero) for d in range(-half, width - half)]))
            return F.when(i - half < 0, F.transform(parts, lambda x: F.lit(0.0))).otherwise(parts) if zero_head else parts

        return F.transform(F.sequence(F.lit(0), F.size(m) - 1, F.lit(stride)), stacked)

    return N.let(m, over)


def maximum(m: Column) -> Column:
    return F.array_max(F.transform(m, F.array_max))


def minimum(m: Column) -> Column:
    return F.array_min(F.transform(m, F.array_min))


def argmax(m: Column) -> Column:
    """Index in the flattened matrix."""
    return N.argmax(F.flatten(m))


def argmin(m: Column) -> Column:
    return N.argmin(F.flatten(m))


def to_array(m: Column) -> Column:
    return F.flatten(m)


def from_array(a: Column, rows: int) -> Column:
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / rows).cast("int") - 1), lambda i: F.slice(a, i * rows + 1, rows))
    return N.let(a, cut)


def blocks(m: Column, start: int, end: int) -> Column:
    """The half-open range of blocks."""
    return F.slice(m, start + 1, end - start)


def equal_within(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    same = F.zip_with(a, b, lambda x, y: F.coalesce(N.equal_within(x, y, tolerance), F.lit(False)))
    return (F.size(a) == F.size(b)) & F.forall(same, lambda x: x)


def valid(m: Column, lower: float = float("-inf"), upper: float = float("inf")) -> Column:
    """All blocks equally long, and every value finite and within bounds."""
    flat = F.flatten(m)
    even = F.forall(m, lambda b: F.size(b) == F.size(F.get(m, F.lit(0))))
    return even & F.forall(flat, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")) & (x >= lower) & (x <= upper))


def rotate_stay(m: Column, to_front: bool = True) -> Column:
    """Move each block's last entry (stay) to the front, or back."""
    if to_front:
        return F.transform(m, lambda b: F.concat(F.slice(b, -1, 1), F.slice(b, 1, F.size(b) - 1)))
    return F.transform(m, lambda b: F.concat(F.slice(b, 2, F.size(b) - 1), F.slice(b, 1, 1)))


# ---- small dynamic programs as folds ------------------------------------------------------------------------
def _transitions(block: Column, states: int) -> list[list[Column]]:
    """[to][from]."""
    return [[F.get(block, F.lit(to * states + frm)) for frm in range(states)] for to in range(states)]


def crf_partition(m: Column, states: int) -> Column:
    """log of the sum over all paths of exp(score); blocks hold transition scores at to * states + from."""
    step = lambda prev, block: F.array(*[N.log_sum_exp_of(F.array(*[row[f] + F.get(prev, F.lit(f)) for f in range(states)])) for row in _transitions(block, states)])
    return N.log_sum_exp_of(F.aggregate(m, F.array(*[F.lit(0.0)] * states), step))


def crf_score(m: Column, states: int) -> Column:
    """The best path's score."""
    step = lambda prev, block: F.array(*[F.greatest(*[row[f] + F.get(prev, F.lit(f)) for f in range(states)]) for row in _transitions(block, states)])
    return F.array_max(F.aggregate(m, F.array(*[F.lit(0.0)] * states), step))


def argmax_decode(m: Column) -> tuple[Column, Column]:
    """(path, score): each block's best state, -1 where that is the last state."""
    path = F.transform(m, lambda b: F.when(N.argmax(b) == F.size(b) - 1, F.lit(-1)).otherwise(N.argmax(b)))
    return path, N.total(F.transform(m, F.array_max))
