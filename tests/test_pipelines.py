import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.api import Reads
from sigloom.kernels import detect, networks
from sigloom.operators import reads
from sigloom.operators import signal as S
from sigloom.plans import pipelines
from sigloom.sources import sinks

rng = np.random.default_rng(3)
SIGNALS = {"a": np.repeat(rng.normal(0, 5, 60), 10) + rng.normal(0, 0.5, 600), "b": np.repeat(rng.normal(0, 5, 80), 8) + rng.normal(0, 0.5, 640), "flat": np.ones(500), "short": np.arange(30.0), "none": None, "empty": np.zeros(0)}
OPTS = {"trim": (20, 10), "local_penalty": 50.0}


@pytest.fixture(scope="module")
def df(spark):
    rows = [(k, f"u-{k}", None if v is None else v.tolist()) for k, v in SIGNALS.items()]
    return spark.createDataFrame(rows, "read_id string, uuid string, signal array<double>")


def test_options():
    o = pipelines.Options.parse(trim="50", segmentation="80:5", skip_penalty="1.5", model="raw_r94")
    assert o.trim == (50, 50) and o.segmentation == (80, 0.05) and o.skip_penalty == 1.5
    for bad in ({"min_prob": 1.0}, {"model": "x"}, {"homopolymer": "x"}, {"trim": (-1, 0)}, {"segmentation": (0, 0)}, {"weight_temperature": 0}, {"limit": -1}, {"stay_penalty": -1}):
        with pytest.raises(ValueError):
            pipelines.Options(**bad)
    with pytest.raises(ValueError):
        pipelines.command("nothing")


def test_per_read_operators_match_kernels(df):
    out = {r.read_id: r for r in reads.detect_events(reads.normalise(reads.trim(df, 20, 10))).collect()}
    for k in "ab":
        a, b = detect.trim(SIGNALS[k], 20, 10)
        assert (out[k].start, out[k].end) == (a, b) and np.allclose(out[k].normalised, detect.medmad(SIGNALS[k][a:b]))
        assert [e.start for e in out[k].events] == detect.detect(SIGNALS[k][a:b])["start"].tolist()
    assert out["none"].start is None and out["none"].events is None and out["short"].normalised is None and out["empty"].events is None


def test_long_form_matches_arrays(spark, df):
    long = reads.to_samples(df.where("read_id in ('a', 'b')"))
    back = {r.read_id: r.signal for r in reads.to_reads(long).collect()}
    assert back["a"] == SIGNALS["a"].tolist()
    bounds = {r.read: (r.start, r.end) for r in S.trim_bounds(long, 20, 10, 100, 0.0).collect()}
    assert bounds == {k: detect.trim(SIGNALS[k], 20, 10) for k in "ab"}
    t = S.t_statistic(long, 6).where("read = 'b'").orderBy("i").toPandas()["t"]
    assert np.allclose(t, detect.t_statistic(SIGNALS["b"], 6))
    cut = S.trimmed(long, S.trim_bounds(long, 20, 10)).where("read = 'a'").orderBy("i").toPandas()
    a, b = detect.trim(SIGNALS["a"], 20, 10)
    assert np.allclose(cut["x"], SIGNALS["a"][a:b]) and cut["i"].tolist() == list(range(b - a))


@pytest.mark.parametrize("model", list(networks.RAW))
def test_basecall_raw(df, model):
    params = networks.random_parameters(model, states=257)
    out = pipelines.basecall_raw(df, params, pipelines.Options(model=model, **OPTS)).collect()
    assert {r.read_id for r in out} <= {"a", "b"} and len(out) == 2
    for r in out:
        a, b = detect.trim(SIGNALS[r.read_id], 20, 10)
        assert (r.start, r.end, r.n) == (a, b, len(SIGNALS[r.read_id]))
        assert r.nblock == -(-(b - a) // networks.model_stride(model)) and len(r.path) == r.nblock + 1
        assert set(r.bases) <= set("ACGT") and r.bases


def test_fluent_basecall_is_the_uncorrected_command(df):
    params = networks.random_parameters("rgrgr_r94", states=257)
    opts = pipelines.Options(homopolymer="nochange", min_prob=1e-6, **OPTS)
    want = {r.read_id: (r.bases, round(r.score, 6)) for r in pipelines.basecall_raw(df, params, opts).collect()}
    fluent = Reads(df.where("read_id in ('a', 'b')")).trim(20, 10).scale().posterior("rgrgr_r94", params).basecall("rgrgr_r94", local_penalty=50.0)
    assert {r.read_id: (r.bases, round(r.score, 6)) for r in fluent.df.collect()} == want
    with pytest.raises(ValueError):
        fluent.basecall("rgrgr_r94", base_probs=True)
    crf = Reads(df.where("read_id = 'a'")).trim(20, 10).scale().posterior("rnnrf_r94", networks.random_parameters("rnnrf_r94")).basecall("rnnrf_r94", base_probs=True).df.first()
    assert np.allclose(np.sum(crf.base_probs, axis=1), 1) and len(crf.base_probs) == len(crf.path)


def test_basecall_events(df):
    params = networks.random_parameters("events", states=257)
    for dwell in (True, False):
        out = pipelines.basecall_events(df, params, pipelines.Options(dwell_correction=dwell, **OPTS)).collect()
        assert {"a", "b"} <= {r.read_id for r in out}
        for r in out:
            assert r.nevent == len(r.events) == len(r.path) - 1 and [e.pos for e in r.events] == r.pos[:-1] and [e.state - 1 for e in r.events] == r.path[:-1]
    assert sinks.fasta_events(pipelines.basecall_events(df, params, pipelines.Options(**OPTS))).count() >= 2


def test_event_table_and_limit(df):
    assert pipelines.event_table(df, pipelines.Options(trim=(20, 10))).count() == 2
    assert pipelines.event_table(df, pipelines.Options(trim=(20, 10), limit=1)).count() <= 1


def test_squiggle_and_mapping(spark, df):
    params = networks.random_parameters("squiggle_r94")
    seqs = spark.createDataFrame([("s", "ACGTTGCA"), ("lower", "acgt"), ("bad", "ACNT"), ("none", None)], "name string, seq string")
    out = {r.name: r.squiggle for r in pipelines.predict_squiggle(seqs, params).collect()}
    assert set(out) == {"s", "lower"} and len(out["s"]) == 8
    mapped = pipelines.map_signal(df.withColumn("seq", F.lit("ACGTTGCA")), params, options=pipelines.Options(trim=(20, 10))).collect()
    assert len(mapped) == 2
    for r in mapped:
        assert len(r.map_path) == len(r.signal) and set(r.map_path[: r.start]) == {-1} and max(r.map_path) <= 7
    post = networks.random_parameters("rgrgr_r94", states=65)
    for kw in ({}, {"band": 6}, {"forward": True}):
        got = pipelines.map_sequence(df.withColumn("seq", F.lit("ACGTTGCATT")), post, 3, pipelines.Options(trim=(20, 10), local_penalty=4.0), **kw).collect()
        assert len(got) == 2 and all(np.isfinite(r.map_score) for r in got)


def test_networks_need_no_shuffle(df):
    plan = pipelines.basecall_raw(df, networks.random_parameters("rgrgr_r94", states=257), pipelines.Options(**OPTS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
