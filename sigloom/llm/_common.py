"""Shared plumbing of the training-data operators: staging in the shared folder, text chunks."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most text bytes that a kernel looks at in one go; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Files of a small staged table: enough tasks for a few executors.
LEAST_FILES = 8
#: Without Hadoop's native library a file in a local folder costs a process (chmod) of the executor's JVM for each time that its mode is set:
#: four with a checksum file beside it, one without. Until such a process runs its program it shares the JVM's memory, and counts as much again
#: where memory is summed by process. Parquet's own page checksums are written and verified instead. Other file systems aren't concerned.
LOCAL_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.page.write-checksum.enabled": "true", "parquet.page.verify-checksum.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent, a local session gets a temporary folder of its own; a cluster
    without the setting is an error, as a machine-local folder would lose data there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sigloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_ROOTS: list[str] = []


def _delete(jvm, path: str) -> None:
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


@atexit.register
def _clean() -> None:
    """The driver's end is the end of what it staged."""
    if gateway := SparkContext._gateway:
        for root in _ROOTS:
            with contextlib.suppress(Py4JError, OSError):
                _delete(gateway.jvm, root)


class Stage:
    """Tables written to the shared folder, so that lost executors cost no recomputation.

    ``put`` writes a DataFrame and returns it as read again; ``drop`` deletes what is no longer read. What an operator's
    result reads stays until the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/sigloom/{name}-{uuid.uuid4().hex}"
        self.made = 0
        _ROOTS.append(self.root)

    def put(self, df: DataFrame, rows: int | None = None, per_file: int = 50_000, by: str | None = None) -> DataFrame:
        """rows: about how many there will be, where that is known; a small table then goes to few files, not to one a partition.

        by: a column whose values get folders of their own, so that reading one of them skips the others.
        """
        path = f"{self.root}/{self.made}"
        self.made += 1
        if rows is not None:
            df = df.coalesce(max(LEAST_FILES, -(-rows // per_file)))
        write = df.write.options(**LOCAL_FILES)
        (write.partitionBy(by) if by else write).parquet(path)
        out = self.spark.read.schema(df.schema).options(**LOCAL_FILES).parquet(path)
        out._sigloom_path = path
        return out

    def put_sorted(self, df: DataFrame, buckets: int, *keys: str) -> DataFrame:
        """Bucketed and sorted by keys, a table of the session's catalog: joins and groups on keys need no exchange of it."""
        path, name = f"{self.root}/{self.made}", f"sigloom_{uuid.uuid4().hex}"
        self.made += 1
        df.write.options(**LOCAL_FILES).bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
        out = self.spark.read.table(name)
        out._sigloom_path, out._sigloom_table = path, name
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete what put wrote: the frames that it returned, not ones made from them."""
        for df in frames:
            if name := getattr(df, "_sigloom_table", None):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            where = self.spark._jvm.org.apache.hadoop.fs.Path(df._sigloom_path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def narrow(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under the operator's own names: other columns can't clash."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in cols.items()])


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = CHUNK_BYTES, max_rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their text as bytes: (rows, uint8 buffer, offsets). Null is empty."""
    for rb in batches:
        if not rb.num_rows:
            continue
        col = rb.column(rb.schema.get_field_index(column))
        if col.null_count:
            col = pc.fill_null(col, "")
        _, offs, data = col.buffers()
        wide = pa.types.is_large_string(col.type)
        offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + rb.num_rows + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < rb.num_rows:
            to = min(at + max_rows, max(at + 1, int(np.searchsorted(offs, offs[at] + max_bytes, "right")) - 1))
            yield rb.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def texts_of(buf: np.ndarray, offs: np.ndarray) -> list[str]:
    raw = buf.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
