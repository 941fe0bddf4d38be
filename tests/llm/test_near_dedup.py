import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigloom.llm import near_dedup as N
from sigloom.llm import shingles as H
from sigloom.llm._common import Stage


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_groups(rows):
    sets = [brute_set(t) for _, t in rows]
    label = {d: d for d, _ in rows if d is not None}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (d, _) in enumerate(rows):
        for j in range(i):
            e = rows[j][0]
            both = len(sets[i] & sets[j])
            if d is not None and e is not None and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(d), find(e)
                label[max(a, b)] = min(a, b)
    return [(d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets)]


def check(df, rows):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)
    assert got == sorted(brute_groups(rows), key=repr)


def chunk(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def test_shingle_sets():
    texts = ["", "A b\tC d e f", "a b c d e f", "x y", "  ", "é É b c d e\x1cf", "w " * 3000, "a b c d e a b c d e a b c d e"]
    sets, bounds = H.shingle_sets(*chunk(texts))
    parts = [set(sets[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    assert [len(p) for p in parts] == [len(brute_set(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(parts[i] & parts[j]) == len(brute_set(a) & brute_set(b))


@pytest.mark.parametrize("shared,own", [(60, 20), (300, 50), (5, 1)])
def test_signatures_estimate_similarity(shared, own):
    rng = np.random.default_rng(shared)
    got = []
    for _ in range(40):
        x = rng.integers(1, 2**63, shared + 2 * own, dtype=np.uint64)
        a, b = np.sort(x[: shared + own]), np.sort(np.concatenate((x[:shared], x[shared + own :])))
        s = N.super_minhash(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        got.append((s[0] == s[1]).mean())
    want = shared / (shared + 2 * own)
    assert abs(np.mean(got) - want) < 0.03


def test_signature_is_a_permutation_in_steps():
    s = N.super_minhash(np.array([123456789], np.uint64), np.array([0, 1]))[0]
    assert sorted((s >> np.uint32(24)).tolist()) == list(range(N.SLOTS))
    # A set's signature is the minimum of its elements'.
    e = np.array([5, 77, 10**12], np.uint64)
    alone = N.super_minhash(e, np.arange(4))
    both = N.super_minhash(e, np.array([0, 3]))[0]
    assert (both == alone.min(axis=0)).all()


def test_against_brute_force(docs, texts):
    check(N.near_duplicates(docs), texts)


@pytest.mark.parametrize("band", [0, 7, 9])
def test_chance_bytes_in_an_earlier_band(band):
    """Keys agree in bands 7 and 9 only: the pair is found in band 7."""
    keys = np.arange(2 * N.BANDS, dtype=np.int64).reshape(2, -1)
    keys[1, [7, 9]] = keys[0, [7, 9]]
    text = " ".join(f"w{i}" for i in range(40))
    member = pa.struct({"node": pa.int64(), "comp": pa.int64(), "size": pa.int64(), "profile": pa.binary(), "bands": pa.list_(pa.int64()), "text": pa.string()})
    look = {"size": 36, "profile": N.profiles(*H.shingle_sets(*chunk([text])))[0].tobytes(), "text": text}
    a, b = ([{"node": i, "comp": i, "bands": keys[i].tolist(), **look}] for i in (0, 1))
    # A row before it, of other buckets, shifts the values.
    far = [{"node": i, "comp": i, "bands": [i] * N.BANDS, **look} for i in (5, 6)]
    rb = pa.RecordBatch.from_arrays([pa.array([3, band], pa.int32()), pa.array([far[:1], a], pa.list_(member)), pa.array([far, b], pa.list_(member))], names=["band", "left", "right"])
    got = [(x["a"], x["b"]) for out in N._compare(iter([rb])) for x in out.to_pylist()]
    assert got == ([(0, 1)] if band == 7 else [])
    rb = pa.RecordBatch.from_arrays([pa.array([1, 2]), rb.column(0), pa.array([0, 0]), pa.array([0, 0]), rb.column(1), rb.column(2)], names=["b", "band", "l", "r", "left", "right"])
    screened = [(x["b"], [m["node"] for m in x["left"]], [m["node"] for m in x["right"]]) for out in N._screen(iter([rb])) for x in out.to_pylist()]
    assert screened == ([(2, [0], [1])] if band == 7 else [])


def copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_large_groups_of_copies_and_chains(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = copies(rng, base, 150, 5) + copies(rng, base, 60, 14) + [" ".join(base)] * 30
    chain = [f"c{i}" for i in range(60)]
    for i in range(40):  # each is near the one before, the ends are far apart
        chain = [*chain[2:], f"n{i}a", f"n{i}b"]
        texts.append(" ".join(chain))
    passage = [f"p{i}" for i in range(60)]
    texts += [" ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(60)]) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    check(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), rows)


@pytest.mark.parametrize("shared,own", [(60, 20), (300, 50), (3, 1), (30_000, 5_000), (200_000, 33_333)])
def test_the_bound_is_never_under_the_truth(shared, own):
    rng = np.random.default_rng(shared)
    for _ in range(20):
        x = rng.integers(1, 2**63, shared + 2 * own, dtype=np.uint64)
        sets = [np.sort(x[: shared + own]), np.sort(np.concatenate((x[:shared], x[shared + own + rng.integers(0, own + 1) :])))]
        sizes = np.array([len(v) for v in sets])
        p = N.profiles(np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes))))
        assert N.may_be_similar(p[0], p[1], sizes[0], sizes[1]) or not N._similar(*sets)
    far = np.sort(rng.integers(1, 2**63, 100, dtype=np.uint64))
    p = N.profiles(np.concatenate((far, far + np.uint64(1 << 20))), np.array([0, 100, 200]))
    assert N.may_be_similar(p[0], p[1], 100, 100) and not N.may_be_similar(p[0], p[0] * 0, 100, 100)


def test_thousands_of_planted_pairs(spark):
    """Pairs at a similarity of 0.75 to 0.85 that share a passage with hundreds of others: each is found."""
    rng = random.Random(11)
    passage, rows, pairs = [f"p{i}" for i in range(30)], [], []
    for k in range(1500):
        n = rng.randint(60, 90)
        base = (passage if k % 2 else []) + [f"b{k}w{i}" for i in range(n)]
        edit = list(base)
        for _ in range(rng.choice([1, 2, 2, 3])):
            edit[rng.randrange(len(edit) - n, len(edit))] = f"x{rng.randrange(10**9)}"
        a, b = brute_set(" ".join(base)), brute_set(" ".join(edit))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edit))]
        if 100 * len(a & b) >= 75 * len(a | b):
            pairs.append(2 * k)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert len(pairs) > 1000
    # A pair at 0.75 shares no band with a probability of 2e-5, so none is expected among these.
    assert {d for d, _ in rows if got[d] != d} == {k + 1 for k in pairs} and all(got[k + 1] == k for k in pairs)


def test_repeated_ids_with_other_texts(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(5, text("a")), (5, text("b")), (3, text("b")), (9, text("a") + " more"), (7, text("c")), (7, text("c")), (8, text("d")), (8, text("c") + " x"), (2, None), (2, text("d"))]
    check(N.near_duplicates(spark.createDataFrame(rows * 2, "doc_id long, text string")), rows * 2)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    out = N.near_duplicates(odd)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    check(out, rows)
    assert {(r.doc_id, r.kept) for r in out.collect()} >= {(4, True), (5, False), (None, True), (1, True)}
    assert N.near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(a, b) for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(150)) if a != b] + [(i + 1, i) for i in range(500, 560)]
    got = {r.node: r.root for r in N.components(spark.createDataFrame(pairs, "a long, b long").repartition(4), Stage(spark, "t")).collect()}
    label = {x: x for p in pairs for x in p}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in label if find(x) != x}
    assert N.components(spark.createDataFrame([], "a long, b long"), Stage(spark, "t")).where(F.lit(True)).count() == 0
