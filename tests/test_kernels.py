import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigloom.kernels import decode as C
from sigloom.kernels import detect as D
from sigloom.kernels import layers as L
from sigloom.kernels import mapping as P
from sigloom.kernels import networks as W

rng = np.random.default_rng(0)
PLATEAUS = np.repeat([1.0, 2.0, 3.0, 2.0, 1.0], 10)


def test_cumulative():
    t, s = D.cumulative([1, 2, 3])
    assert t.tolist() == [0, 1, 3, 6] and s.tolist() == [0, 1, 5, 14]


def test_t_statistic():
    t = D.t_statistic(PLATEAUS, 4)
    for step in (10, 20, 30, 40):
        around = t[step - 3 : step + 4]
        assert around[[0, 1, 2, 4, 5, 6]] == pytest.approx([1.1547, 2, 3.4641, 3.4641, 2, 1.1547], abs=1e-4)
        assert around[3] > 100
    assert (np.delete(t, [s + d for s in (10, 20, 30, 40) for d in range(-3, 4)]) == 0).all()
    assert not D.t_statistic(np.ones(5), 3).any() and not D.t_statistic(PLATEAUS, 1).any()


def test_events_from_peaks():
    x = np.repeat(np.arange(1.0, 11), 2)
    ev = D.events_from(x, np.arange(2, 20, 2))
    assert ev["start"].tolist() == list(range(0, 20, 2)) and set(ev["length"]) == {2}
    assert ev["mean"].tolist() == list(range(1, 11)) and not ev["stdv"].any()
    assert D.events_from(x, np.array([], int))["length"].tolist() == [20]
    assert len(D.events_from(np.array([]), np.array([], int))["start"]) == 0


def test_shift_and_scale_leave_events():
    x = np.repeat(rng.normal(0, 5, 20), 12) + rng.normal(0, 0.3, 240)
    a, b = D.detect(x), D.detect(0.5 * x + 0.25)
    assert a["start"].tolist() == b["start"].tolist() and np.allclose(b["mean"], 0.5 * a["mean"] + 0.25)
    assert len(a["start"]) > 10


def plain_peaks(scores, p):
    """The rules as one table of states."""
    st = [{"at": -1, "v": np.inf, "ok": False, "mask": 0, "w": w, "t": t} for w, t in ((p.short, p.short_threshold), (p.long, p.long_threshold))]
    out = []
    for i, row in enumerate(zip(*scores)):
        for d, x in zip(st, row):
            if d["mask"] >= i:
                continue
            if d["at"] < 0:
                if x < d["v"]:
                    d["v"] = x
                elif x - d["v"] > p.height:
                    d.update(v=x, at=i)
                continue
            if x > d["v"]:
                d.update(v=x, at=i)
            if d is st[0] and d["v"] > d["t"]:
                st[1].update(mask=d["at"] + d["w"], at=-1, v=np.inf, ok=False)
            d["ok"] |= bool(d["v"] - x > p.height and d["v"] > d["t"])
            if d["ok"] and i - d["at"] > d["w"] // 2:
                out.append(d["at"])
                d.update(at=-1, v=x, ok=False)
    return sorted(out)


@pytest.mark.parametrize("threshold", [9.0, 3.0, 1.0])
def test_peaks_against_a_plain_program(threshold):
    p, found = D.Detection(long_threshold=threshold), 0
    for _ in range(40):
        x = np.repeat(rng.normal(0, 3, 40), rng.integers(3, 12, 40))
        x = x + rng.normal(0, 0.8, len(x))
        scores = D.t_statistic(x, 3), D.t_statistic(x, 6)
        got = D.peaks(*scores, p).tolist()
        assert got == plain_peaks(scores, p)
        found += len(got)
    assert found > 100


def test_trim():
    x = np.concatenate((np.full(300, 5.0), rng.normal(0, 3, 500), np.full(250, 5.0)))
    assert D.trim_by_mad(x, 100, 0.0) == (300, 800)
    assert D.trim(x, 20, 10) == (320, 790)
    assert D.trim(x, 600, 10) == (0, 0) and D.trim_by_mad(np.ones(10)) == (0, 0)
    assert D.medmad(np.ones(4)) is None and D.medmad(np.array([3.0])).tolist() == [0]


@pytest.mark.parametrize("width,stride,n", list(itertools.product(range(1, 6), range(1, 6), (10, 11))))
def test_convolution(width, stride, n):
    x, w, b = rng.normal(size=(n, 2)), rng.normal(size=(3, width, 2)), rng.normal(size=3)
    out = L.convolve(x, w, b, stride)
    want = []
    for i in range(0, n, stride):
        at = [i - (width - 1) // 2 + k for k in range(width)]
        want.append([b[o] + sum(w[o, k] @ x[j] for k, j in enumerate(at) if 0 <= j < n) for o in range(3)])
    assert np.allclose(out, want) and len(out) == -(-n // stride)


def test_recurrent_layers_run_both_ways():
    x = rng.normal(size=(7, 4))
    w, b, s, s2 = rng.normal(size=(9, 4)), rng.normal(size=9), rng.normal(size=(6, 3)), rng.normal(size=(3, 3))
    assert np.allclose(L.gru(x, w, b, s, s2, True), L.gru(x[::-1], w, b, s, s2)[::-1])
    u = rng.normal(size=(9, 3))
    assert np.allclose(L.gru_after(x, w, b, u, True), L.gru_after(x[::-1], w, b, u)[::-1])
    w, b, s, p = rng.normal(size=(12, 4)), rng.normal(size=12), rng.normal(size=(12, 3)), rng.normal(size=(3, 3))
    assert np.allclose(L.lstm(x, w, b, s, p, True), L.lstm(x[::-1], w, b, s, p)[::-1])
    h = L.lstm(x, w, b, s, 0 * p)
    assert np.abs(h).max() < 1


def test_gates_alone():
    h, x = np.array([0.3, -0.2]), np.zeros(6)
    assert np.allclose(L.gru_step(h, x, np.zeros((4, 2)), np.zeros((2, 2))), h / 2)
    assert np.allclose(L.gru_after_step(h, x, np.zeros((6, 2))), h / 2)


def test_softmax_and_norm():
    x, w, b = rng.normal(size=(5, 3)) * 300, rng.normal(size=(25, 3)), rng.normal(size=25)
    assert np.allclose(L.softmax(x, w, b).sum(1), 1)
    assert np.allclose(L.softmax_tempered(x, w, b, 2.0, 2.0), L.softmax(x / 2, w, b / 2))
    assert L.crf_partition(L.global_norm(x / 300, w, b)) == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("name", [*W.RAW, "events"])
def test_networks(name):
    p = W.random_parameters(name, states=65)
    y = W.events_posterior(rng.normal(size=(20, 4)), p) if name == "events" else W.posterior(name, rng.normal(size=103), p)
    n = 20 if name == "events" else -(-103 // W.model_stride(name))
    assert y.shape == (n, 25 if name == "rnnrf_r94" else 65)
    if name != "rnnrf_r94":
        assert np.allclose(np.exp(y).sum(1), 1, atol=1e-2)


def test_squiggle_units():
    p = W.random_parameters("squiggle_r94_rna")
    a, b = W.squiggle([0, 1, 2, 3, 3], p), W.squiggle([0, 1, 2, 3, 3], p, True)
    assert np.allclose(b[:, 1], np.exp(a[:, 1])) and np.allclose(b[:, 2], np.exp(-a[:, 2])) and np.allclose(a[:, 0], b[:, 0])


def test_registry():
    assert W.model_stride("rgrgr_r94") == 5
    for f in (W.model, W.squiggle_model):
        with pytest.raises(ValueError):
            f("nothing")
    hot = W.with_temperature({"softmax_W": np.ones(2), "softmax_b": np.ones(2)}, 2.0)
    assert hot["softmax_W"].tolist() == [0.5, 0.5]


# ---- decoding -----------------------------------------------------------------------------------------------
@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.floats(0, 1), st.floats(0, 1), st.sampled_from([2.0, 4.0, 100.0]))
def test_both_viterbis_agree(seed, stay, skip, local):
    post = np.log(np.random.default_rng(seed).dirichlet(np.full(257, 0.1), 30) + 1e-6)
    a, b = C.viterbi(post, stay, skip, local), C.viterbi(post, stay, skip, local, skip_wins_ties=True)
    assert a[0] == pytest.approx(b[0]) and a[1].tolist() == b[1].tolist()
    assert C.viterbi(post, stay, skip, local, slip=True)[0] >= a[0] - 1e-9


def _all_paths_score(post, stay_pen, skip_pen, local):
    """Best score by a plain scalar program over (start, states, end)."""
    n, low = post.shape[1] - 1, -1e30
    now = {s: low for s in range(n)} | {"start": 0.0, "end": low}
    for row in post:
        was, wait = now, max(-local, row[n] - stay_pen)
        now = {"start": was["start"] + wait, "end": max([was["end"] + wait, *[was[s] - local for s in range(n)]])}
        for s in range(n):
            step = max(was[q * n // 4 + s // 4] for q in range(4))
            skip = max(was[q * n // 16 + s // 16] for q in range(16)) - skip_pen
            now[s] = max(was[s] + row[n] - stay_pen, row[s] + max(step, skip, was["start"]))
    return max(now.values())


def test_viterbi_against_plain_program():
    for k in range(4):
        post = np.log(rng.dirichlet(np.full(65, 0.2), 9) + 1e-6)
        assert C.viterbi(post, 0.1 * k, 0.3, 1.5)[0] == pytest.approx(_all_paths_score(post, 0.1 * k, 0.3, 1.5))


def test_stays_alone():
    post = np.log(np.full((5, 65), 1e-9))
    post[:, -1] = 0.0
    score, path = C.viterbi(post)
    assert score == 0 and (path == -1).all() and C.stitch(path, 3) == (None, None)


def test_argmax_decode():
    path, score = C.argmax_decode(np.array([[1.0, 0, 2], [3, 0, 1]]))
    assert path.tolist() == [-1, 0] and score == 5


def test_crf():
    x = rng.normal(size=(5, 9))
    total, best = [], []
    for p in itertools.product(range(3), repeat=6):
        best.append(sum(x[b, 3 * p[b + 1] + p[b]] for b in range(5)))
        total.append(best[-1])
    score, path = C.crf_viterbi(x)
    assert score == pytest.approx(max(best)) == pytest.approx(sum(x[b, 3 * path[b + 1] + path[b]] for b in range(5)))
    assert L.crf_partition(x) == pytest.approx(np.logaddexp.reduce(total))
    post = C.crf_posterior(x)
    assert np.allclose(post.sum(1), 1) and (C.crf_posterior(x, True).sum(1) < 1).all()
    want = np.zeros(3)
    for p, s in zip(itertools.product(range(3), repeat=6), total):
        want[p[2]] += np.exp(s - L.crf_partition(x))
    assert np.allclose(post[2], want)
    assert C.crf_bases([0, 4, 2, 3]) == ("AGT", pytest.approx([0, 2, 3]))


def test_homopolymers():
    k, a = 5, C.repeat_state(0, 5)
    before = int("30000", 4)  # TAAAA
    path = [7, before, -1, a, a, -1, 9, 9, 9]
    assert C.homopolymer_runs(path, k) == [(2, 4, 0)]
    farther = int("33000", 4)  # TTAAA
    assert C.homopolymer_runs([7, farther, -1, a, -1, 9, 9, 9], k) == [(3, 2, 0)]
    assert C.homopolymer_runs([1, 2, 3, 6, 7], k) == []
    post = np.full((9, 1025), -20.0)
    post[:, a] = np.log(0.75)
    post[:, -1] = np.log(0.25)
    fixed = C.homopolymer_mean(post, path)
    assert (fixed[2:6] == a).sum() == 3 and fixed[[0, 1, 6]].tolist() == [7, before, 9]
    assert C.homopolymer_correct(post, path, "nochange").tolist() == path
    with pytest.raises(ValueError):
        C.homopolymer_correct(post, path, "median")


def test_dwell():
    aaa = 0
    # ACG -> CGA -> GAA -> AAA (two events) -> AAC
    path, dwell = [6, 24, 32, aaa, -1, 1], [5, 5, 5, 20, 11, 5]
    assert C.dwell_stitch(path, dwell, 3, 10.0) == "ACGAAA" + "A" * 3 + "C"
    assert C.dwell_stitch([-1, -1], [1, 1], 3, 1.0) is None
    assert C.dwell_scale([0, 1, 2], [5, 6, 7], [4, 6, 8], [0, 4, 10], 9) == pytest.approx((18 / 9 + 4 + 6) / 3)


# ---- mapping ------------------------------------------------------------------------------------------------
def _map_scores(post, seq, stay, skip, local):
    out, n = [], len(seq)

    def go(b, s, sc):
        if b == len(post):
            return out.append(sc) if s in (n - 1, n) else None
        row = post[b]
        wait = max(-local, row[-1])
        if s == -1:
            go(b + 1, -1, sc + wait)
            go(b + 1, 0, sc + row[seq[0]])
        elif s == n:
            go(b + 1, n, sc + wait)
        else:
            go(b + 1, s, sc - stay + row[-1])
            for d, pen in ((1, 0), (2, skip)):
                if s + d < n:
                    go(b + 1, s + d, sc - pen + row[seq[s + d]])
            if s == n - 1:
                go(b + 1, n, sc - local)

    go(0, -1, 0.0)
    return out


@pytest.mark.parametrize("n", [1, 2, 4])
def test_map_to_sequence(n):
    post, seq = np.log(rng.dirichlet(np.ones(17), 7)), rng.integers(0, 16, n)
    every = _map_scores(post, seq, 0.3, 0.5, 1.5)
    best, path = P.map_to_sequence(post, seq, 0.3, 0.5, 1.5)
    total, none = P.map_to_sequence(post, seq, 0.3, 0.5, 1.5, forward=True)
    assert best == pytest.approx(max(every)) and total == pytest.approx(np.logaddexp.reduce(every)) and none is None
    full = (np.zeros(7, int), np.full(7, n))
    assert P.map_to_sequence(post, seq, 0.3, 0.5, 1.5, bands=full)[0] == pytest.approx(best)
    assert P.map_to_sequence(post, seq, 0.3, 0.5, 1.5, True, full)[0] == pytest.approx(total)
    on = path[path >= 0]
    assert (np.diff(on) >= 0).all() and (np.diff(on) <= 2).all()


def test_bands():
    ok = ([0, 1, 2, 3, 3], [1, 2, 3, 3, 6])
    assert not P.bounds_sane(*ok, 6)  # an empty band
    ok = ([0, 1, 2, 2, 3], [1, 2, 3, 3, 6])
    assert P.bounds_sane(*ok, 6)
    assert not P.bounds_sane([1, *ok[0][1:]], ok[1], 6)
    assert not P.bounds_sane(ok[0], [*ok[1][:-1], 5], 6)
    assert not P.bounds_sane([0, 1, 2, 2, 4], ok[1], 6)
    low, high = P.diagonal_bands(50, 20, 4)
    assert P.bounds_sane(low, high, 20)
    post, seq = np.log(rng.dirichlet(np.ones(17), 50)), rng.integers(0, 16, 20)
    assert P.map_to_sequence(post, seq, bands=(low, high))[0] <= P.map_to_sequence(post, seq)[0] + 1e-9
    with pytest.raises(ValueError):
        P.map_to_sequence(post, seq, bands=(low + 1, high))


def test_squiggle_match():
    q = np.stack([rng.normal(0, 3, 8), np.full(8, -1.5), np.full(8, -1.0)], axis=1)
    x = np.concatenate((np.full(4, 40.0), np.repeat(q[:, 0], 6) + rng.normal(0, 0.05, 48), np.full(3, -40.0)))
    for back in (0.0, 0.05):
        score, path = P.match_squiggle(x, q, back_probability=back)
        assert (path[4:52] == np.repeat(np.arange(8), 6)).mean() > 0.95 and path[0] == -1 and path[-1] == -1
        assert P.match_squiggle(x, q, back_probability=back, forward=True)[0] >= score


@pytest.mark.parametrize("rescale", [False, True])
def test_squiggles_together_are_those_alone(rescale):
    rng = np.random.default_rng(8)
    p = W.random_parameters("squiggle_r94")
    some = [rng.integers(0, 4, n) for n in (1, 7, 2, 40, 3, 1)]
    for got, s in zip(W.squiggles(some, p, rescale), some, strict=True):
        assert np.allclose(got, W.squiggle(s, p, rescale))


@pytest.mark.parametrize(("scale", "blocks"), [(1.0, 20_000), (1.0, L.LONG), (1.0, 100), (0.0, 9_001)])
def test_gru_side_by_side(scale, blocks):
    """Pieces of a long chain give the chain's states, also where a state is never forgotten and rounds don't settle."""
    rng = np.random.default_rng(3)
    w, b, sw, sw2 = rng.normal(size=(24, 8)) * scale, rng.normal(size=24) * scale, rng.normal(size=(16, 8)) * scale, rng.normal(size=(8, 8))
    x, start = rng.normal(size=(blocks, 8)), rng.normal(size=8)
    if not scale:
        b[:8] = 40.0  # the update gate keeps the old state
        want = np.tile(start, (blocks, 1))
    else:
        h, want = start, []
        for row in L.affine(x, w, b):
            h = L.gru_step(h, row, sw, sw2)
            want.append(h)
    assert np.allclose(L.gru_along(x, w, b, sw, sw2, start), want, atol=1e-12)
    assert np.allclose(L.gru_along(x, w, b, sw, sw2, np.zeros(8)), L.gru(x, w, b, sw, sw2), atol=1e-12)


def test_crf_stretches():
    """Stretches made apart and joined score like the whole; a missing score is no path."""
    rng = np.random.default_rng(4)
    owner = np.repeat(np.arange(7), [1, 2, 3, 50, 1, 64, 9])
    x, there = rng.normal(size=(len(owner), 4, 4)), rng.random((len(owner), 4, 4)) < 0.9
    got, ok, left = C.crf_stretches(x, np.ones_like(there), owner)
    assert left.tolist() == list(range(7)) and ok.all()
    assert np.allclose(got.max(axis=(1, 2)), [C.crf_viterbi(x[owner == k].reshape(-1, 16))[0] for k in range(7)])
    some, ok, _ = C.crf_stretches(x, there, owner)
    holes = np.where(there, x, -1e6)
    assert np.allclose(some[ok], C.crf_stretches(holes, np.ones_like(there), owner)[0][ok]) and (C.crf_stretches(holes, np.ones_like(there), owner)[0][~ok] < -1e5).all()
    assert not len(C.crf_stretches(x[:0], there[:0], owner[:0])[2])
