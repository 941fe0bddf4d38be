import contextlib
import pickle
import sys
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigloom.kernels import networks
from sigloom.sources import exports, readers, sinks

FASTA = ">one first read\nACGT\nAC\n>two\nGG\n\n>three x\nT\n"


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(FASTA)
    (tmp_path / "b.fa").write_text(">four\r\nAC\r\nGT\r\n")
    got = {r.name: (r.comment, r.seq) for r in readers.fasta(spark, str(tmp_path)).collect()}
    assert got == {"one": ("first read", "ACGTAC"), "two": ("", "GG"), "three": ("x", "T"), "four": ("", "ACGT")}
    first = {r.name: r.seq for r in readers.fasta_first(spark, str(tmp_path)).collect()}
    assert first == {"one": "ACGTAC", "four": "ACGT"}


def test_fastx(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@q1 c\nACG\nT\n+\n@III\n" + FASTA)
    got = {r.name: (r.comment, r.seq, r.qual) for r in readers.fastx(spark, str(tmp_path)).collect()}
    assert got["q1"] == ("c", "ACGT", "@III") and got["one"] == ("first read", "ACGTAC", None) and len(got) == 4


def test_crp_round_trip(spark, tmp_path):
    m = np.random.default_rng(0).normal(size=(9, 5))
    df = spark.createDataFrame([(m.tolist(),)], "matrix array<array<double>>")
    sinks.write_text(sinks.crp_lines(df), str(tmp_path / "out"))
    back = readers.crp(spark, str(tmp_path / "out")).first().matrix
    assert back == m.tolist()


def test_random_matrices(spark):
    a, b = (readers.random_matrices(spark, 20, 4, 3, -2.0, 2.0, seed).orderBy("id").collect() for seed in (1, 1))
    x = np.array([r.matrix for r in a])
    assert a == b and x.shape == (20, 3, 4) and x.min() >= -2 and x.max() < 2 and abs(x.mean()) < 0.3 and len(np.unique(x)) == x.size


def test_scaling(spark):
    df = spark.createDataFrame([([1.0, 2.0], 16.0, 1373.41, 8192.0)], "adc array<double>, offset double, range double, digitisation double")
    assert readers.scaled(df).first().signal == pytest.approx([17 * 1373.41 / 8192, 18 * 1373.41 / 8192])


def test_fast5_says_what_is_missing():
    pytest.importorskip("pyspark")
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="h5py"):
            readers._decode_fast5(b"")


class _Group(dict):
    attrs: dict = {}


def _made_file(reads, channel=None):
    f = {"/Raw/Reads": reads} if reads is not None else {}
    if channel is not None:
        f["/UniqueGlobalKey/channel_id"] = group = _Group()
        group.attrs = channel
    return f


def _made_read(read_id, signal):
    r = _Group({"Signal": {(): np.array(signal, np.int16)}} if signal is not None else {})
    r.attrs = {} if read_id is None else {"read_id": read_id}
    return r


CHANNEL = {"digitisation": np.float64(8192), "offset": 16.0, "range": 1373.41, "sampling_rate": 4000.0}


@pytest.mark.parametrize(
    "made, uuid, adc, offset",
    [
        (_made_file(_Group(Read_9=_made_read("nine", [9]), Read_10=_made_read(b"ten\0\0", [1, 2])), CHANNEL), "ten", [1.0, 2.0], 16.0),
        (_made_file(_Group(R=_made_read("variable", [3])), {"offset": 1.0}), "variable", [3.0], 1.0),
        (_made_file(_Group(R=_made_read(None, [3]))), None, [3.0], None),
        (_made_file(_Group()), None, None, None),
        (_made_file(_Group(R=_made_read("x", None))), None, None, None),
        (_made_file(None), None, None, None),
    ],
)
def test_fast5_rules(monkeypatch, made, uuid, adc, offset):
    """The first read by name, fixed and variable strings, missing attributes, groups and signals."""

    class Opened(contextlib.nullcontext):
        def __init__(self, content, mode):
            super().__init__(made)

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=Opened))
    r = readers._decode_fast5(b"")
    rows = [x for rb in readers._decode_files(True)(iter([pa.RecordBatch.from_pydict({"path": ["a/b.fast5"], "content": [b""]})])) for x in rb.to_pylist()]
    if adc is None:
        assert r is None and rows == []
        return
    assert r["uuid"] == uuid and r["adc"].tolist() == adc and (r["offset"] == offset if offset is not None else np.isnan(r["offset"]))
    assert rows[0]["read_id"] == "b.fast5"
    if uuid == "ten":
        assert rows[0]["signal"] == pytest.approx([17 * 1373.41 / 8192, 18 * 1373.41 / 8192])
    else:
        assert np.isnan(rows[0]["signal"]).all()


# ---- networks of layer objects ------------------------------------------------------------------------------
class Layer:
    def __init__(self, **kw):
        self.__dict__.update(kw)


class Shared:
    def __init__(self, a):
        self.container = Layer(storage=[a])


def _network(model, crf=False, lstm=False, levels=5):
    """(pickled network in the layout of its library, the parameters it stands for)."""
    rng = np.random.default_rng(1)
    draw = lambda *s: rng.normal(size=s)
    n, want, top = 4, {}, []
    shared = lambda a: Shared(a)

    def recurrent(name, size):
        b = draw((4 if lstm else 3) * n)
        if lstm:
            t = {"iW": draw(4 * n, size), "sW": draw(4 * n, n), "p": draw(3, n)}
            mixed = lambda w: np.stack(np.split(w, 4), axis=1).reshape(w.shape)
            want.update({f"lstm{name}_{k}": v for k, v in t.items()} | {f"lstm{name}_b": b})
            return Layer(iW=shared(mixed(t["iW"])), sW=shared(mixed(t["sW"])), b=shared(mixed(b).reshape(n, 4)), p=shared(t["p"]))
        t = {"iW": draw(3 * n, size), "sW": draw(2 * n, n), "sW2": draw(n, n)}
        want.update({f"gru{name}_{k}": v for k, v in t.items()} | {f"gru{name}_b": b})
        return Layer(**{k: shared(v) for k, v in t.items()}, b=shared(b))

    if model == "events":
        top.append(Layer(w=3))
    else:
        w, b = draw(n, 1, 11), draw(n)
        top.append(Layer(W=shared(w), b=shared(b), stride=5))
        want.update({"conv_W": w.transpose(0, 2, 1), "conv_b": b, "stride": 5})
    if model in ("events", "raw_r94"):
        for k in (1, 2):
            top.append(Layer(sublayers=[recurrent(f"F{k}", n), Layer(sublayers=[recurrent(f"B{k}", n)])]))
            w, b = draw(n, 2 * n), draw(n)
            top.append(Layer(W=shared(w), b=shared(b), insize=2 * n))
            want.update({f"ff{k}_Wf": w[:, :n], f"ff{k}_Wb": w[:, n:], f"ff{k}_b": b})
    else:
        for k in range(1, levels + 1):
            unit = recurrent(f"{'FB'[k % 2]}{k}", n)
            top.append(Layer(sublayers=[unit]) if k % 2 else unit)
    w, b = draw(17, n), draw(17)
    top.append(Layer(W=shared(w), b=shared(b)))
    want.update({"globalnorm_W": w, "globalnorm_b": b} if crf else {"softmax_W": np.roll(w, -1, axis=0), "softmax_b": np.roll(b, -1)})
    return pickle.dumps(Layer(sublayers=top, version=(1, 0))), want


@pytest.mark.parametrize("model, opts", [("events", {"lstm": True}), ("raw_r94", {}), ("rgr", {"levels": 3}), ("rgrgr_r94", {}), ("residual gru", {}), ("residual lstm", {"lstm": True}), ("rnnrf_r94", {"crf": True})])
def test_networks_of_layer_objects(tmp_path, model, opts):
    content, want = _network(model, **opts)
    (tmp_path / "n.pkl").write_bytes(content)
    got = exports.parameters_from_network_file(str(tmp_path / "n.pkl"), opts.get("crf", False))
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want)
    if model in networks.RAW and not opts.get("crf"):
        assert networks.posterior(model, np.linspace(-1, 1, 40), got).shape[1] == 17


def test_pickles_run_nothing():
    class Bad:
        def __reduce__(self):
            return (print, ("ran",))

    assert isinstance(exports.load_layers(pickle.dumps(Bad())), exports.Holder)
    with pytest.raises(ValueError):
        exports.parameters_from_layers(exports.load_layers(pickle.dumps(Layer(sublayers=[]))))


def test_parameter_tables(spark, tmp_path):
    p = networks.random_parameters("squiggle_r94", size=4)
    table = readers.table_from_parameters(spark, "s", p)
    table.write.parquet(str(tmp_path / "p"))
    back = readers.parameters_from_table(spark.read.parquet(str(tmp_path / "p")), "s")
    assert back.keys() == p.keys() and all(np.allclose(back[k], p[k]) for k in p)
    with open(tmp_path / "p.pkl", "wb") as f:
        pickle.dump(p, f)
    assert np.allclose(readers.parameters_from_pickle(str(tmp_path / "p.pkl"))["embed_W"], p["embed_W"])
    with open(tmp_path / "bad.pkl", "wb") as f:
        pickle.dump(print, f)
    with pytest.raises(pickle.UnpicklingError):
        readers.parameters_from_pickle(str(tmp_path / "bad.pkl"))


def test_parameter_headers():
    text = "float __embed_x_W[8] = {0x1.8p+0, 2.5f, 3, 0,\n 4, 5, -0x1p-1, 0};\n_Mat _embed_x_W = {\n.nr = 3,\n.nrq = 1,\n.nc = 2,\n.stride = 4,\n.data.f = __embed_x_W\n};"
    m, rows = readers.parse_header(text)["embed_x_W"]
    assert rows == 3 and m.tolist() == [[1.5, 2.5, 3, 0], [4, 5, -0.5, 0]]
    assert readers.parameters_from_squiggle_header(text)["embed_W"].shape == (2, 3)


def test_gates_and_stay():
    w = np.arange(6.0).reshape(6, 1)
    assert readers.regroup_gates(w, [2, 0, 1]).ravel().tolist() == [4, 5, 0, 1, 2, 3]
    assert readers.stay_last(w).ravel().tolist() == [1, 2, 3, 4, 5, 0]


def test_json_lines(spark):
    lines = spark.createDataFrame([('{"b": 1, "a": "x"}',), ('{"a": "y", "c": 3}',)], "value string")
    out = readers.json_to_columns(lines, readers.first_json(lines))
    assert out.columns == ["b", "a"]
    assert [r.value for r in sinks.json_tsv(out).collect()] == ["1\tx", "\ty"]


def test_spread(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(readers.spread(df).collect(), key=repr) == sorted(df.collect(), key=repr)
    assert readers.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(readers, "ONE_TASK", 1)
    assert readers.spread(df) is df


def test_limit(spark):
    df = spark.range(10)
    assert readers.limited(df, 3).count() == 3 and readers.limited(df).count() == 10


def test_text_formats(spark):
    row = ("r", "u", -30.0, "ACGT", 100, 5, 95, 12)
    df = spark.createDataFrame([row], "read_id string, uuid string, score double, bases string, n int, start int, end int, nblock int")
    head, seq = sinks.fasta_raw(df, "p_").first().value.split("\n")
    assert seq == "ACGT" and head.startswith('>p_r  { "filename" : "r", "uuid" : "u", "normalised_score" : 2.500000,  "nblock" : 12,') and '"trim" : [ 5, 95 ]' in head
    assert sinks.sam(df, use_uuid=True).first().value == "u\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*"
    ev = spark.createDataFrame([("r", [(0, 3.0, 1.5, 0.25, -1, -1)])], "read_id string, events array<struct<start: bigint, length: float, mean: float, stdv: float, pos: int, state: int>>")
    assert [r.value for r in sinks.event_tsv(ev).collect()] == ["#r", "event\tstart\tmean\tstdv\tdwell", "0\t0\t1.500000\t0.250000\t3"]
    sq = spark.createDataFrame([("n", "AC", [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]])], "name string, seq string, squiggle array<array<double>>")
    assert [r.value for r in sinks.squiggle_tsv(sq).collect()][2:] == ["0\tA\t1.000000\t2.000000\t3.000000", "1\tC\t4.000000\t5.000000\t6.000000"]
    mp = spark.createDataFrame([("r", [0.5, 1.5], [-1, 1], "AC", [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], -4.0)], "read_id string, signal array<double>, map_path array<int>, seq string, squiggle array<array<double>>, map_score double")
    assert [r.value for r in sinks.mappy_tsv(mp).collect()] == ["0\t0.500000\t-1\tN\tnan\tnan\tnan", "1\t1.500000\t1\tC\t4.000000\t5.000000\t6.000000"]
    assert [r.value for r in sinks.seqmappy_tsv(mp).collect()] == ["# r  Score 4.000000 over 2 blocks (2.000000 per block)", "block\tpos", "0\t-1", "1\t1"]


def test_events_to_parquet(spark, tmp_path):
    ev = spark.range(1).select(F.lit("r").alias("read_id"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(2.0).alias("length"))).alias("events"))
    sinks.write_events(ev, str(tmp_path / "ev"))
    assert spark.read.parquet(str(tmp_path / "ev")).first().asDict() == {"read_id": "r", "event": 0, "start": 0, "length": 2.0}
