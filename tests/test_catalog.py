import re
import time

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from compare import assert_same
from pyspark.sql import functions as F
from sigloom.kernels import decode, detect, layers, mapping, networks
from sigloom.operators import reads
from sigloom.plans import catalog
from sigloom.plans.pipelines import Options


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["read", "i", "y"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir), sf_dir, catalog.ORACLE_SQL[name])


# ---- queries without SQL: networks as plain loops, decoders and mappings as test_kernels holds them against brute force ----
def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def loop_convolve(x, w, b, stride=1):
    width, out = w.shape[1], []
    for i in range(0, len(x), stride):
        at = [i - (width - 1) // 2 + k for k in range(width)]
        out.append(b + sum(w[:, k] @ x[j] for k, j in enumerate(at) if 0 <= j < len(x)))
    return np.array(out)


def loop_gru(x, p, name):
    iw, b, sw, sw2 = (p[f"gru{name}_{t}"] for t in ("iW", "b", "sW", "sW2"))
    n, out = len(sw2), [None] * len(x)
    h = np.zeros(n)
    for i in sorted(range(len(x)), reverse=name[0] == "B"):
        u = iw @ x[i] + b
        z, r = sigmoid(u[:n] + sw[:n] @ h), sigmoid(u[n : 2 * n] + sw[n:] @ h)
        h = out[i] = z * h + (1 - z) * np.tanh(u[2 * n :] + sw2 @ (r * h))
    return np.array(out)


def loop_lstm(x, p, name):
    iw, b, sw, peep = (p[f"lstm{name}_{t}"] for t in ("iW", "b", "sW", "p"))
    n, out = sw.shape[1], [None] * len(x)
    h, c = np.zeros(n), np.zeros(n)
    for i in sorted(range(len(x)), reverse=name[0] == "B"):
        new, enter, keep, leave = (iw @ x[i] + sw @ h + b).reshape(4, n)
        c = sigmoid(keep + peep[1] * c) * c + sigmoid(enter + peep[0] * c) * np.tanh(new)
        h = out[i] = sigmoid(leave + peep[2] * c) * np.tanh(c)
    return np.array(out)


def loop_softmax(x, p):
    e = np.exp(x @ p["softmax_W"].T + p["softmax_b"])
    return e / e.sum(axis=1, keepdims=True)


def loop_combine(x, layer, k, p):
    return np.tanh(layer(x, p, f"F{k}") @ p[f"ff{k}_Wf"].T + layer(x, p, f"B{k}") @ p[f"ff{k}_Wb"].T + p[f"ff{k}_b"])


def loop_network(model, signal, p):
    """Probabilities of states, or transition scores."""
    x = loop_convolve(signal[:, None], p["conv_W"], p["conv_b"], 4 if model == "raw_r94" else 5)
    x = np.tanh(x) if model in ("raw_r94", "rgrgr_r10") else np.where(x > 0, x, np.exp(x) - 1)
    if model == "raw_r94":
        return loop_softmax(loop_combine(loop_combine(x, loop_gru, 1, p), loop_gru, 2, p), p)
    for name in ("B1", "F2", "B3", "F4", "B5"):
        x = loop_gru(x, p, name) + (x if model == "rnnrf_r94" else 0)
    if model != "rnnrf_r94":
        return loop_softmax(x, p)
    scores = x @ p["globalnorm_W"].T + p["globalnorm_b"]
    total = np.ones(5)
    for block in scores:
        total = np.exp(block.reshape(5, 5)) @ total
    return scores - np.log(total.sum()) / len(scores)


def loop_events(ev, p):
    step = [abs(b - a) for a, b in zip(ev["mean"], ev["mean"][1:])] + [0.0]
    x = np.stack([np.float32(ev["mean"]), np.float32(ev["stdv"]), ev["length"], np.float32(step)], axis=1).astype(float)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    padded = np.concatenate((np.zeros((1, 4)), x, np.zeros((1, 4))))
    x = np.array([padded[i : i + 3].reshape(-1) for i in range(len(x))])
    return loop_softmax(loop_combine(loop_combine(x, loop_lstm, 1, p), loop_lstm, 2, p), p)


def loop_squiggle(states, p):
    x = np.tanh(loop_convolve(p["embed_W"][states], p["conv1_W"], p["conv1_b"]))
    for k in range(2, 6):
        x = x + np.tanh(loop_convolve(x, p[f"conv{k}_W"], p[f"conv{k}_b"]))
    return loop_convolve(x, p["conv6_W"], p["conv6_b"])


def logs(post, least):
    return np.log(least + (1 - least) * post)


def natural(q):
    return np.stack([q[:, 0], np.exp(q[:, 1]), np.exp(-q[:, 2])], axis=1)


@pytest.fixture(scope="module")
def views(sf_dir):
    """read: (signal, start, end, normalised view)."""
    ev = pd.read_parquet(f"{sf_dir}/events.parquet").dropna(subset=["value"]).sort_values("ts")
    out = {}
    for read, x in ev.groupby("user_id")["value"]:
        x = x.to_numpy()
        mads = [np.median(np.abs(c - np.median(c))) for c in x[: len(x) // 10 * 10].reshape(-1, 10)]
        loud = [k for k, m in enumerate(mads) if m > min(mads)]
        start, end = (loud[0] * 10 + 3, loud[-1] * 10 + 8) if loud else (0, 0)
        y = x[start:end]
        if len(y) and (mad := np.median(np.abs(y - np.median(y)))):
            out[int(read)] = x, start, end, (y - np.median(y)) / (1.4826 * mad)
    assert len(out) > 10
    return out


RGRGR, SQUIGGLE = networks.random_parameters("rgrgr_r94", states=257), networks.random_parameters("squiggle_r94")
BASES = [0, 1, 2, 3, 3, 2, 1, 0, 0, 1, 2, 3]


def alike(got, want):
    """Lines (or cells) that agree, numbers up to the last digit that is printed."""
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        a, b = (re.split(r"[\s,]+", str(x)) for x in (a, b))
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert x == y or abs(float(x) - float(y)) <= 2e-6 * max(1.0, abs(float(y)))


def called(post, stay=0.0, skip=0.0, local=50.0, homopolymer="nochange"):
    score, path = decode.viterbi(post, stay, skip, local)
    path = decode.homopolymer_correct(post, path, homopolymer)
    bases, pos = decode.stitch(path, 4)
    return score, path, bases, pos


def test_transducer_viterbi(spark, sf_dir, views):
    got = {r.read_id: r for r in catalog.QUERIES["transducer_viterbi"](spark, sf_dir).collect()}
    assert got.keys() == views.keys()
    for read, (*_, y) in views.items():
        score, path, bases, _ = called(logs(loop_network("rgrgr_r94", y, RGRGR), 1e-6), 0.1, 0.2, 50.0, "mean")
        assert got[read].score == pytest.approx(score, abs=1e-4) and (got[read].bases, got[read].n_path) == (bases, len(path))


def test_mapped_to_states(spark, sf_dir, views):
    p = networks.random_parameters("rgrgr_r941", states=257)
    got = {r.read_id: r for r in catalog.QUERIES["map_to_sequence"](spark, sf_dir).collect()}
    assert got.keys() == views.keys()
    for read, (*_, y) in views.items():
        score, path = mapping.map_to_sequence(logs(loop_network("rgrgr_r941", y, p), 1e-6), [(37 * i + read) % 256 for i in range(6)])
        assert got[read].score == pytest.approx(score, abs=1e-4) and got[read].n == len(path)


def test_squiggles_matched(spark, sf_dir, views):
    got = {r.read_id: r for r in catalog.QUERIES["squiggle_match"](spark, sf_dir).collect()}
    assert got.keys() == views.keys()
    for read, (*_, y) in views.items():
        score, path = mapping.match_squiggle(y, loop_squiggle([(3 * i + read) % 4 for i in range(10)], SQUIGGLE), back_probability=0.05)
        assert got[read].score == pytest.approx(score, abs=1e-4) and got[read].n == len(path)


def test_networks_forward(spark, sf_dir, views):
    got = {(r.read_id, r.model): r for r in catalog.QUERIES["networks_forward"](spark, sf_dir).collect()}
    assert got.keys() == {(read, m) for read in views for m in networks.RAW}
    for model in networks.RAW:
        p = networks.random_parameters(model, states=257)
        for read, (*_, y) in views.items():
            post = loop_network(model, y, p)
            assert got[read, model].blocks == len(post) and got[read, model].mass == pytest.approx(post.sum(), abs=2e-3)


def test_squiggle_predict(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    seqs = {str(d): ["ACGT".index(c) for c in (t or "").upper() if c in "ACGT"] for d, t in zip(docs.doc_id, docs.text, strict=True)}
    got = {r.name: r for r in catalog.QUERIES["squiggle_predict"](spark, sf_dir).collect()}
    assert got.keys() == {k for k, s in seqs.items() if len(s) >= 10}
    for name in got:
        want = natural(loop_squiggle(seqs[name], SQUIGGLE))
        assert got[name].n == len(want) and got[name].total == pytest.approx(want.sum(), rel=1e-6, abs=1e-3)


def test_basecall_raw_lines(spark, sf_dir, views):
    got = {r.value.split()[0][1:]: r.value for r in catalog.QUERIES["basecall_raw"](spark, sf_dir).collect()}
    want = {}
    for read, (x, start, end, y) in views.items():
        post = logs(loop_network("rgrgr_r94", y, RGRGR), Options().min_prob)
        score, _, bases, _ = called(post, homopolymer=Options().homopolymer)
        n = len(post)
        info = f'{{ "filename" : "{read}", "uuid" : "read-{read}", "normalised_score" : {-score / n:f},  "nblock" : {n},  "sequence_length" : {len(bases)},  "blocks_per_base" : {n / len(bases):f}, "nsample" : {len(x)}, "trim" : [ {start}, {end} ] }}'
        want[str(read)] = f">{read}  {info}\n{bases}"
    assert got.keys() == want.keys()
    alike([got[k] for k in want], list(want.values()))


def test_basecall_events_lines(spark, sf_dir, views):
    p = networks.random_parameters("events", states=257)
    got = {r.value.split()[0][1:]: r.value for r in catalog.QUERIES["basecall_events"](spark, sf_dir).collect()}
    want = {}
    for read, (x, start, end, _) in views.items():
        ev = {k: np.float32(v).astype(float) if k != "start" else v for k, v in detect.detect(x[start:end]).items()}
        post = logs(loop_events(ev, p), Options().min_prob)
        score, path, bases, pos = called(post)
        n = len(ev["start"])
        bases = decode.dwell_corrected(path[:n], ev | {"pos": pos[:n], "state": path[:n] + 1}, 257, len(bases)) or bases
        want[str(read)] = f'>{read}  {{ "filename" : "{read}", "uuid" : "read-{read}", "normalised_score" : {-score / n:f},  "nevent" : {n},  "sequence_length" : {len(bases)},  "events_per_base" : {n / len(bases):f} }}\n{bases}'
    assert got.keys() == want.keys()
    alike([got[k] for k in want], list(want.values()))


def test_seqmappy_lines(spark, sf_dir, views):
    got, read = {}, None
    for (line,) in catalog.QUERIES["seqmappy"](spark, sf_dir).collect():
        read = int(line.split()[1]) if line.startswith("#") else read
        got.setdefault(read, []).append(line)
    assert got.keys() == views.keys()
    kmers = [sum(4 ** (3 - j) * BASES[i + j] for j in range(4)) for i in range(len(BASES) - 3)]
    for read, (*_, y) in views.items():
        post = logs(loop_network("rgrgr_r94", y, RGRGR), Options().min_prob)
        score, path = mapping.map_to_sequence(post, kmers, Options().stay_penalty, Options().skip_penalty, 4.0)
        title = f"# {read}  Score {-score:f} over {len(path)} blocks ({-score / len(path):f} per block)"
        alike([x.replace("(", "").replace(")", "") for x in got[read]], [title.replace("(", "").replace(")", ""), "block\tpos", *[f"{i}\t{v}" for i, v in enumerate(path)]])


def test_mappy_lines(spark, sf_dir, views):
    got = {}
    for r in catalog.QUERIES["mappy"](spark, sf_dir).collect():
        got.setdefault(r.read_id, {})[r.idx] = r.value
    assert got.keys() == views.keys()
    q = loop_squiggle(BASES, SQUIGGLE)
    rows = [" ".join(f"{v:.6f}" for v in row) for row in natural(q)]
    for read, (x, start, end, y) in views.items():
        path = [-1] * start + list(mapping.match_squiggle(y, q)[1]) + [-1] * (len(x) - end)
        want = [f"{i} {v:.6f} {k} {'N nan nan nan' if k < 0 else 'ACGT'[BASES[k]] + ' ' + rows[k]}" for i, (v, k) in enumerate(zip(x, path, strict=True))]
        alike([got[read][i] for i in range(len(x))], want)


def test_every_query_has_sql_or_a_program():
    held = {"transducer_viterbi", "map_to_sequence", "squiggle_match", "networks_forward", "squiggle_predict", "basecall_raw", "basecall_events", "seqmappy", "mappy"}
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == held


@pytest.mark.parametrize("name", ["crf_decode", "gru", "lstm"])
def test_whole_vectors(spark, tmp_path, name):
    """Each of a vector's eight parts of eight features counts; the CRF has a block a vector."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(3, 64))
    tables = [m.copy() for _ in range(9)]
    for k in range(8):
        tables[k][2, 8 * k + 7] += 3.0
    rows = [(n, i, v.tolist()) for n, t in enumerate(tables) for i, v in enumerate(t)]
    spark.createDataFrame(rows, "label int, vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {}
    for r in catalog.QUERIES[name](spark, str(tmp_path)).collect():
        out.setdefault(r.read_id, []).append(tuple(r)[1:])
    out = {k: sorted(v) for k, v in out.items()}
    assert len(out) == 9 and all(out[k] != out[8] for k in range(8))
    if name == "crf_decode":
        assert len(out[8][0][1]) == 3 + 1
    else:
        assert len(out[8]) == 3 * 64 * (1 if name == "gru" else 2)


LONG = {
    "crf_partition": lambda m: layers.crf_partition(m.reshape(-1, 16)),
    "crf_viterbi": lambda m: decode.crf_viterbi(m.reshape(-1, 16))[0],
    "gru": lambda m: loop_gru(m.reshape(-1, 8), catalog._GRU, "F1"),
    "lstm": lambda m: loop_lstm(layers.window(m.reshape(-1, 4), 3), catalog._LSTM, "B1"),
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_one_long_matrix(spark, tmp_path, name):
    """Cutting a label's vectors into blocks takes time in proportion to them: minutes if every block reads all of them."""
    m = np.random.default_rng(5).normal(size=(6000, 64)).astype(np.float32)
    for n in (3, len(m)):
        rows = pd.DataFrame({"vec_id": range(n), "embedding": m[:n].tolist(), "label": 4})
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        began = time.perf_counter()
        got = catalog.QUERIES[name](spark, f"{tmp_path}/{n}").toPandas()
        took = time.perf_counter() - began
        cells = got.sort_values(["block", "row"]).y if "block" in got else got.iloc[:, 1]
        assert np.allclose(cells, np.ravel(LONG[name](m[:n].astype(float))), atol=1e-5)
    assert took < 15, f"{took:.1f} s"


def test_trimmed_like_its_sql(spark, tmp_path):
    """The first chunk's MAD is a bit over the last one's, and equal to it once both are multiplied by 1.4826."""
    x = [114.43, 3.42, 126.58, 5.62, 61.12, 2.61, 14.21, 38.62, 15.22, 16.87, 3.37, 12.77, 23.38, 73.35, 32.59, 3.93, 59.63, 3.41, 91.83, 32.07]
    x += [105.83, 101.62, 83.2, 63.05, 13.23, 33.35, 43.74, 38.02, 63.16, 79.39, 43.69, 40.32, 41.51, 22.44, 33.33, 2.75, 168.99, 20.88, 44.91, 70.36]
    ev = pd.DataFrame({"user_id": 7, "ts": pd.date_range("2024-01-01", periods=len(x), freq="min"), "value": x})
    spark.createDataFrame(ev, "user_id long, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/t")
    next(tmp_path.glob("t/*.parquet")).rename(tmp_path / "events.parquet")
    assert detect.trim(np.array(x), 3, 2, 10, 0.0) == (3, 28)
    assert_same(catalog.QUERIES["event_table"](spark, str(tmp_path)), str(tmp_path), catalog.ORACLE_SQL["event_table"])


def test_pushdown(spark, sf_dir):
    plan = catalog.QUERIES["signal_mad"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,value:double>" in plan and "IsNotNull(value)" in plan


def _embeddings(spark, path, rows) -> str:
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/t")
    next(path.glob("t/*.parquet")).rename(path / "embeddings.parquet")
    return str(path)


def test_crf_viterbi_of_odd_vectors(spark, tmp_path):
    """Missing and surplus values, missing vectors, orders and labels, as in its SQL."""
    x = np.random.default_rng(6).normal(size=(60, 64)).astype(np.float32).astype(float).tolist()
    rows = [(i, v, i % 4) for i, v in enumerate(x[:40])]
    rows += [(40, [None if j % 5 == 0 else y for j, y in enumerate(x[40])], 0), (41, x[41][:50], 1), (42, x[42] + x[43], 2), (43, None, 5), (44, x[44], 5), (None, x[45], 3), (46, x[46], None), (47, [], 6)]
    sf = _embeddings(spark, tmp_path, rows)
    assert_same(catalog.QUERIES["crf_viterbi"](spark, sf), sf, catalog.ORACLE_SQL["crf_viterbi"])


def test_crf_viterbi_in_stretches(spark, tmp_path):
    """A label's vectors are never in one row: they are scored where they lie, and each partition's stretch is a block."""
    x = np.random.default_rng(7).normal(size=(30_000, 64)).astype(np.float32)
    sf = _embeddings(spark, tmp_path, pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist(), "label": 4}))
    got = catalog.QUERIES["crf_viterbi"](spark, sf)
    assert "collect_list(struct(vec_id" not in got._jdf.queryExecution().toString()
    assert np.isclose(got.first().score, decode.crf_viterbi(x.reshape(-1, 16).astype(float))[0], atol=1e-5)
    stretches = reads.crf_stretches(spark.read.parquet(f"{sf}/embeddings.parquet"), "label", "vec_id", "embedding", 64, 4).first().m
    assert 1 < len(stretches) < 100


def test_gru_of_one_long_label(spark, tmp_path):
    """The whole query takes less time than its label's blocks one by one, and no row holds a label."""
    p = catalog._GRU
    x = np.random.default_rng(8).normal(size=(60_000, 64)).astype(np.float32)
    sf = _embeddings(spark, tmp_path, pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist(), "label": 4}))
    run = lambda: catalog.QUERIES["gru"](spark, sf)
    assert "collect_list" not in run()._jdf.queryExecution().toString()
    began = time.perf_counter()
    want = layers.gru(x.reshape(-1, 8).astype(float), p["gruF1_iW"], p["gruF1_b"], p["gruF1_sW"], p["gruF1_sW2"])
    one_by_one = time.perf_counter() - began
    began = time.perf_counter()
    total = run().agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.max("block").alias("last")).first()
    took = time.perf_counter() - began
    assert (total.n, total.last) == (want.size, len(want) - 1) and np.isclose(total.y, want.sum(), atol=0.1)
    some = run().where("block % 997 = 0").toPandas().sort_values(["block", "row"]).y
    assert np.allclose(some, want[::997].ravel(), atol=1e-6)
    assert took < one_by_one, f"{took:.1f} s, one by one {one_by_one:.1f} s"


def test_gru_from_a_missing_value_on(spark, tmp_path):
    """States are null from a missing value on, in that label only; vectors without a label are left out."""
    x = np.random.default_rng(9).normal(size=(12, 64)).astype(np.float32).astype(float).tolist()
    clean = _embeddings(spark, (tmp_path / "clean"), [(i, v, i % 2) for i, v in enumerate(x)])
    x[4][17] = None
    odd = _embeddings(spark, (tmp_path / "odd"), [(i, v, i % 2) for i, v in enumerate(x)] + [(20, x[0], None)])
    want, got = ({(r.read_id, r.block, r.row): r.y for r in catalog.QUERIES["gru"](spark, sf).collect()} for sf in (clean, odd))
    assert got == {k: None if k[0] == 0 and k[1] >= 2 * 8 + 2 else v for k, v in want.items()}
    assert_same(catalog.QUERIES["gru"](spark, clean), clean, catalog.ORACLE_SQL["gru"])
