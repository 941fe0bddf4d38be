import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigloom.functions import matrix as M
from sigloom.functions import numeric as N
from sigloom.functions import sequence as Q
from sigloom.kernels import decode, detect, layers


def one(spark, *cols, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<double>' if isinstance(v, list) and not (v and isinstance(v[0], list)) else 'array<array<double>>' if isinstance(v, list) else 'string' if isinstance(v, str) else 'double'}" for k, v in values.items()))
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_medians(spark):
    assert one(spark, N.median_of(F.col("a")), N.median_of(F.col("b")), a=[0.0, 1.0, 2.0, 3.0, 4.0], b=[0.0, 1.0, 2.0, 3.0]) == (2.0, 1.5)


def test_array_reductions(spark):
    a = [3.0, -1.0, 7.0, 7.0, 2.0]
    r = one(spark, N.argmax(F.col("a")), N.argmin(F.col("a")), N.mad_of(F.col("a")), N.medmad_of(F.col("a")), N.studentise_of(F.col("a")), N.difference(F.col("a")), N.quantile_of(F.col("a"), 0.3), a=a)
    x = np.array(a)
    assert r[:2] == (2, 1)
    assert r[2] == pytest.approx(detect.mad(x))
    assert r[3] == pytest.approx(detect.medmad(x))
    assert r[4] == pytest.approx((x - x.mean()) / x.std())
    assert r[5] == [-4.0, 8.0, 0.0, -5.0, 0.0]
    assert r[6] == pytest.approx(np.quantile(x, 0.3))


def test_degenerate_arrays(spark):
    r = one(spark, N.medmad_of(F.col("a")), N.medmad_of(F.col("b")), N.mad_of(F.col("a")), N.median_of(F.col("c")), a=[5.0], b=[2.0, 2.0, 2.0], c=[])
    assert r == ([0.0], [None, None, None], 0.0, None)


@pytest.mark.parametrize("x", [-4.0, -1.0, -0.0, 0.0, 0.5, 3.0])
def test_scalars(spark, x):
    r = one(spark, N.elu(F.col("x")), N.logistic(F.col("x")), N.logistic_cdf(F.col("x")), N.log_logistic_cdf(F.col("x")), N.laplace(F.col("x"), F.lit(0.5), F.lit(2.0)), N.clip(F.col("x"), 2.0), N.large_to(F.col("x"), 2.0, 9.0), x=x)
    s = 1 / (1 + math.exp(-x))
    want = (x if x >= 0 else math.expm1(x), s, s, math.log(s), math.exp(-abs(x - 0.5) / 2) / 4, max(-2.0, min(2.0, x)), 9.0 if abs(x) > 2 else x)
    assert tuple(r) == pytest.approx(want, abs=1e-12)


def test_log_sum_exp_of_nothing(spark):
    low = float("-inf")
    r = one(spark, N.log_sum_exp(F.col("x"), F.col("y")), N.log_sum_exp(F.col("x"), F.lit(3.0)), N.log_sum_exp_of(F.array("x", "y")), x=low, y=low)
    assert tuple(r) == (low, 3.0, low)


def test_integer_division(spark):
    r = one(spark, N.ceil_div(F.lit(7), F.lit(2)), N.floor_div(F.lit(-7), F.lit(2)), N.int_min(F.lit(3), F.lit(2)), N.int_max(F.lit(3), F.lit(2)), x=0.0)
    assert tuple(r) == (4, -3, 2, 3)


@pytest.mark.parametrize("rows", [8, 9, 10, 11])
def test_column_normalise(spark, rows):
    r = one(spark, M.normalise(F.col("m")), m=[[1.0] * rows] * 3)
    assert r[0] == [pytest.approx([1 / rows] * rows)] * 3


def test_matrix_functions(spark):
    m = [[1.0, -2.0], [3.0, 0.5], [-1.0, 4.0]]
    x, f = np.array(m), F.col("m")
    r = one(spark, M.maximum(f), M.minimum(f), M.argmax(f), M.argmin(f), M.softmax(f), M.window(f, 3), M.window(f, 3, zero_head=True), M.affine(f, [[1.0, 2.0], [0.5, 0.0], [0.0, 1.0]], [0.1, 0.2, 0.3]), M.rotate_stay(f), M.rotate_stay(M.rotate_stay(f), False), M.from_array(M.to_array(f), 2), M.blocks(f, 1, 3), M.valid(f, -2.0, 4.0), M.valid(f, -1.0), M.equal_within(f, M.shift_scale(f, 0.001, 1.0), 0.01), M.robust_log(M.softmax(f), 0.1), m=m)
    assert r[:4] == (4.0, -2.0, 5, 1)
    soft = np.exp(x) / np.exp(x).sum(1, keepdims=True)
    assert np.allclose(r[4], soft)
    assert np.allclose(r[5], layers.window(x, 3)) and np.allclose(r[6], layers.window(x, 3, zero_head=True))
    assert np.allclose(r[7], layers.affine(x, np.array([[1.0, 2], [0.5, 0], [0, 1]]), np.array([0.1, 0.2, 0.3])))
    assert r[8] == [[-2.0, 1.0], [0.5, 3.0], [4.0, -1.0]] and r[9] == m and r[10] == m and r[11] == m[1:]
    assert r[12] and not r[13] and r[14]
    assert np.allclose(r[15], layers.robust_log(soft, 0.1))


def test_crf_folds(spark):
    x = np.random.default_rng(1).normal(size=(6, 16))
    r = one(spark, M.crf_partition(F.col("m"), 4), M.crf_score(F.col("m"), 4), m=x.tolist())
    assert r[0] == pytest.approx(layers.crf_partition(x)) and r[1] == pytest.approx(decode.crf_viterbi(x)[0])


def test_kmers(spark):
    r = one(spark, Q.encode_kmers(F.col("s"), 5), Q.encode_kmers(F.col("s"), 9), Q.encode_kmers(F.concat("s", F.lit("N")), 5), Q.encode_kmers(F.col("s"), 1), s="ccata")
    assert tuple(r) == ([332], None, None, [1, 1, 0, 3, 0])


@settings(max_examples=20, deadline=None)
@given(st.text("ACGT", min_size=5, max_size=40))
def test_kmer_states(s):
    states = [int(s[i : i + 5].translate(str.maketrans("ACGT", "0123")), 4) for i in range(len(s) - 4)]
    bases, pos = decode.stitch(states, 5)
    assert len(bases) >= 5 and len(pos) == len(states)
    assert all(decode.kmer_text(k, 5) == s[i : i + 5] for i, k in enumerate(states))


def test_stitch_matches_kernel(spark):
    rng = np.random.default_rng(0)
    paths = [[-1, -1], [-1, 5, -1, 20, 83], [0, 0, 0], *[rng.integers(-1, 1024, 12).tolist() for _ in range(20)]]
    df = spark.createDataFrame([(p,) for p in paths], "p array<int>")
    bases, pos = Q.stitch(F.col("p"), 5)
    for p, b, q in df.select("p", bases, pos).collect():
        want, at = decode.stitch(p, 5)
        assert b == want and (q is None if at is None else q == at.tolist())


def test_small_sequence_functions(spark):
    r = one(spark, Q.base_to_int(F.lit("g")), Q.base_to_int(F.lit("x")), Q.highest_bit(F.lit(1024)), Q.kmer_length(F.lit(1025)), Q.four_to(F.lit(5)), Q.is_homopolymer(F.lit(341), 5), Q.repeat_block(F.lit(2), 5), Q.calibrated_dwell(F.lit(7.5), F.lit(0.0), F.lit(5.0)), Q.decode_kmer(F.lit(332), 5), x=0.0)
    assert tuple(r) == (2, -1, 11, 5, 1024, True, 682, 2, "CCATA")
    assert Q.guess_alphabet(1025) == (4, 5) and Q.guess_alphabet(5) == (4, 1)
    with pytest.raises(ValueError):
        Q.guess_alphabet(12)


def test_ctc_and_crf_bases(spark):
    df = spark.createDataFrame([([-1, 2, 2, -1, 2, 3, 4, 0],), ([],)], "p array<int>")
    bases, at = Q.crf_bases(F.filter("p", lambda x: x >= 0))
    rows = df.select(Q.ctc_collapse(F.col("p")), bases, at).collect()
    assert rows[0][0] == [2, 2, 3, 4, 0] and rows[0][1] == "GGGTA" and rows[0][2] == [0, 1, 2, 3, 5]
    assert rows[1][0] == [] and rows[1][1] == ""
