import numpy as np
import pytest

from sigloom.kernels import detect
from sigloom.operators import reads
from sigloom.streaming import events, reads as streams

rng = np.random.default_rng(5)


@pytest.mark.parametrize("n,piece", [(0, 3), (5, 2), (40, 7), (600, 1), (600, 64)])
def test_online_equals_batch(n, piece):
    x = np.repeat(rng.normal(0, 5, n // 10 + 1), 10)[:n] + rng.normal(0, 0.4, n)
    online, got = events.Online(), []
    for k in range(0, n, piece):
        got += online.feed(x[k : k + piece])
        online = events.Online(state=online.state())
    got += online.finish()
    want = detect.detect(x)
    assert [g[0] for g in got] == want["start"].tolist()
    if n:
        assert np.allclose([g[1:] for g in got], np.stack([want["length"], want["mean"], want["stdv"]], axis=1))


def test_stream_of_reads(spark, tmp_path):
    x = np.repeat(rng.normal(0, 5, 60), 10)
    df = spark.createDataFrame([("a", x.tolist()), ("b", x[::-1].tolist())], "read_id string, signal array<double>")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = reads.detect_events(streams.stream_reads(spark, str(tmp_path / "in"), df.schema, 1))
    streams.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(90)
    out = {r.read_id: len(r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {r.read_id: len(r.events) for r in reads.detect_events(df).collect()}


def test_stream_of_samples(spark, tmp_path):
    x = np.repeat(rng.normal(0, 5, 40), 10) + rng.normal(0, 0.3, 400)
    rows = [(r, i, float(v)) for r in (1, 2) for i, v in enumerate(x)]
    for k, part in enumerate((rows[:250], rows[250:400] + rows[400:500], rows[500:])):
        spark.createDataFrame(part, "read long, i long, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema("read long, i long, x double, k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.detect_stream(stream.select("read", "i", "x"), idle_ms=None).writeStream.format("memory").queryName("ev").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
        got = spark.sql("select * from ev where read = 1 order by start").collect()
    finally:
        q.stop()
    want = detect.detect(x)["start"].tolist()
    assert len(got) >= len(want) - 3 and [r.start for r in got] == want[: len(got)]
