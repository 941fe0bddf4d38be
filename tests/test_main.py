import numpy as np
import pytest

from sigloom import __main__ as cli
from sigloom import __version__
from sigloom.kernels import networks
from sigloom.sources import readers


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("cli")
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(0, 5, 60), 10) + rng.normal(0, 0.5, 600)
    spark.createDataFrame([("r", "u", x.tolist())], "read_id string, uuid string, signal array<double>").write.parquet(str(tmp / "reads"))
    table = None
    for model, states in (("rgrgr_r94", 1025), ("events", 257), ("squiggle_r94", 0)):
        part = readers.table_from_parameters(spark, model, networks.random_parameters(model, states=states))
        table = part if table is None else table.union(part)
    table.write.parquet(str(tmp / "params"))
    (tmp / "s.fa").write_text(">s\nACGTTGCAAC\n>t\nAC\n")
    return tmp


@pytest.mark.parametrize("name,extra", [("raw", ["--format", "sam", "--local-penalty", "50"]), ("raw", ["--local-penalty", "50", "--prefix", "x_", "--use-uuid"]), ("events", ["--local-penalty", "50"]), ("event_table", []), ("mappy", []), ("seqmappy", [])])
def test_commands(spark, data, tmp_path, name, extra):
    extra = [*extra, "--trim", "20:10", *(["--sequence", str(data / "s.fa")] if "mappy" in name else [])]
    cli.main([name, str(data / "reads"), str(tmp_path / "out"), "--params", str(data / "params"), *extra])
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines and ("--prefix" not in extra or lines[0].startswith(">x_u "))


def test_squiggle(spark, data, tmp_path, capsys):
    cli.main(["squiggle", str(data / "s.fa"), str(tmp_path / "out"), "--params", str(data / "params"), "--rescale"])
    assert spark.read.text(str(tmp_path / "out")).count() == 2 * 2 + 12
    cli.main(["version"])
    assert __version__ in capsys.readouterr().out
    with pytest.raises(ValueError):
        cli.run(spark, cli.parser().parse_args(["event_table", str(data / "reads"), "x", "--format", "sam"]))
