"""Readers: sequences, hex-float matrices, raw reads, parameter tables."""

from __future__ import annotations

import io
import json
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, comment, seq of every record; sequences may span lines. Records split files, so one file feeds many tasks."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace("value", "^>|\r", "")
    seq = F.regexp_replace(F.expr("substring(body, length(head) + 2)"), r"\s", "")
    out = raw.select(body.alias("body")).where(F.trim("body") != "").withColumn("head", F.substring_index("body", "\n", 1))
    return out.select(F.regexp_extract("head", r"^(\S*)", 1).alias("name"), F.regexp_extract("head", r"^\S*\s+(.*)$", 1).alias("comment"), seq.alias("seq"))


def fasta_first(spark: SparkSession, path: str) -> DataFrame:
    """file, name, comment, seq of each file's first record."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r", "").alias("v"))
    first = raw.select("file", F.regexp_extract("v", r"(?s)^>([^\n]*)\n?((?:(?!\n>).)*)", 1).alias("head"), F.regexp_replace(F.regexp_extract("v", r"(?s)^>[^\n]*\n?(.*?)(?:\n>|$)", 1), r"\s", "").alias("seq"))
    return first.select("file", F.regexp_extract("head", r"^(\S*)", 1).alias("name"), F.regexp_extract("head", r"^\S*\s+(.*)$", 1).alias("comment"), "seq")


def parse_fastx(text: str) -> Iterator[tuple[str, str, str, str | None]]:
    """(name, comment, sequence, quality) of FASTA and FASTQ records, mixed and multi-line."""
    lines, i = text.splitlines(), 0
    while i < len(lines):
        if not lines[i].startswith((">", "@")):
            i += 1
            continue
        name, comment = re.match(r"(\S*)\s*(.*)", lines[i][1:]).groups()
        i, seq, qual = i + 1, [], None
        while i < len(lines) and not lines[i].startswith((">", "@", "+")):
            seq.append(re.sub(r"\s", "", lines[i]))
            i += 1
        seq = "".join(seq)
        if i < len(lines) and lines[i].startswith("+"):
            i, qual = i + 1, ""
            while i < len(lines) and len(qual) < len(seq):
                qual, i = qual + lines[i], i + 1
        yield name, comment.strip(), seq, qual


def fastx(spark: SparkSession, path: str) -> DataFrame:
    """file, name, comment, seq, qual of FASTA or FASTQ files; a file is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for file, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                rows = [(file, *r) for r in parse_fastx(text or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(5)], names=["file", "name", "comment", "seq", "qual"])

    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.mapInArrow(run, "file string, name string, comment string, seq string, qual string")


def parse_crp(text: str) -> np.ndarray:
    """(blocks, rows) of a matrix file: rows and blocks on the first line, then a line of hex floats for each block."""
    rows, blocks = map(int, text.split(None, 2)[:2])
    out = np.array([float.fromhex(v) for v in text.split()[2:]])
    return out.reshape(blocks, rows)


def crp(spark: SparkSession, path: str) -> DataFrame:
    """file, matrix of hex-float matrix files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            cells = [parse_crp(t).tolist() for t in rb.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(cells, pa.list_(pa.list_(pa.float64())))], names=["file", "matrix"])

    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.mapInArrow(run, "file string, matrix array<array<double>>")


def random_matrices(spark: SparkSession, n: int, rows: int, blocks: int, lower: float = -1.0, upper: float = 1.0, seed: int = 0) -> DataFrame:
    """id, matrix: n uniform random matrices, for tests; the seed and the id decide each."""
    cell = lambda i, j: (F.pmod(F.xxhash64(F.lit(seed), "id", i, j), F.lit(2**53)) / float(2**53)) * (upper - lower) + lower
    block = lambda i: F.transform(F.sequence(F.lit(1), F.lit(rows)), lambda j: cell(i, j))
    return spark.range(n).withColumn("matrix", F.transform(F.sequence(F.lit(1), F.lit(blocks)), block))


def _text(x) -> str | None:
    """A string attribute, of fixed length (bytes, padded with zeros) or variable (text)."""
    return x.decode().rstrip("\0") if isinstance(x, bytes) else None if x is None else str(x)


def _decode_fast5(content: bytes) -> dict | None:
    """The first read by name; its id is None and its scaling NaN where attributes are missing; None for a file without reads."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading FAST5 files needs h5py on the executors") from e
    with h5py.File(io.BytesIO(content), "r") as f:
        reads = f["/Raw/Reads"] if "/Raw/Reads" in f else {}
        read = reads[min(reads)] if len(reads) else {}
        if "Signal" not in read:
            return None
        channel = f["/UniqueGlobalKey/channel_id"].attrs if "/UniqueGlobalKey/channel_id" in f else {}
        scaling = {k: float(channel.get(k, float("nan"))) for k in ("digitisation", "offset", "range", "sampling_rate")}
        return {"uuid": _text(read.attrs.get("read_id")), "adc": read["Signal"][()].astype(float), **scaling}


_FAST5 = "read_id string, uuid string, signal array<double>, digitisation double, offset double, range double, sampling_rate double"


def _decode_files(scale: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = pa.float64()
        schema = pa.schema([("read_id", pa.string()), ("uuid", pa.string()), ("signal", pa.list_(number)), *[(k, number) for k in ("digitisation", "offset", "range", "sampling_rate")]])
        for rb in batches:
            for file, content in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                if r := _decode_fast5(content):
                    x = (r["adc"] + r["offset"]) * (r["range"] / r["digitisation"]) if scale else r["adc"]
                    signal = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                    yield pa.RecordBatch.from_arrays([pa.array([file.rsplit("/", 1)[-1]]), pa.array([r["uuid"]], pa.string()), signal, *[pa.array([r[f.name]], number) for f in list(schema)[3:]]], schema=schema)

    return run


def fast5(spark: SparkSession, path: str, scale: bool = True) -> DataFrame:
    """read_id (file name), uuid, signal, digitisation, offset, range, sampling_rate of a directory or glob. Needs h5py.

    A missing path gives no rows at read time, and neither does a file without reads.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.fast5").option("ignoreMissingFiles", "true").load(path)
    return raw.select("path", "content").mapInArrow(_decode_files(scale), _FAST5)


def scaled(reads: DataFrame) -> DataFrame:
    """reads (adc, offset, range, digitisation) with signal in pA."""
    return reads.withColumn("signal", F.transform("adc", lambda x: (x + F.col("offset")) * F.col("range") / F.col("digitisation")))


#: Bytes under which an input counts as one task's work: a quarter of what Spark puts in a task by default.
ONE_TASK = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it is one task's work by size, as a small file of a single row group is read by one task whatever follows.

    Larger inputs stay as they are split, so nothing of size is ever shuffled.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < ONE_TASK else df


def limited(df: DataFrame, limit: int = 0) -> DataFrame:
    """At most so many reads; 0 for all."""
    return df.limit(limit) if limit else df


# ---- parameter tables ---------------------------------------------------------------------------------------
_ARRAY = re.compile(r"(?:float|__m128)\s+(\w+)\s*\[[^\]]*\]\s*=\s*\{(.*?)\};", re.S)
_SHAPE = re.compile(r"_Mat\s+(\w+)\s*=\s*\{(.*?)\};", re.S)
_NUMBER = re.compile(r"[-+]?0x[0-9a-fA-F.]+p[-+]?\d+|[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?")


def parse_header(text: str) -> dict[str, tuple[np.ndarray, int]]:
    """Matrices of a header of float arrays and the _Mat literals that shape them: (blocks with their padding, rows without it)."""
    values = {n: np.array([float.fromhex(x) if "x" in x else float(x) for x in _NUMBER.findall(re.sub(r"(?<=[\dp])f\b", "", body))]) for n, body in _ARRAY.findall(text)}
    out = {}
    for name, body in _SHAPE.findall(text):
        field = {k: v.strip() for k, v in re.findall(r"\.([\w.]+)\s*=\s*([^,}\s]+)", body)}
        if field.get("data.f") in values:
            out[name.strip("_")] = (values[field["data.f"]].reshape(int(field["nc"]), -1), int(field["nr"]))
    return out


def parameters_from_squiggle_header(text: str, width: int = 7) -> dict[str, np.ndarray]:
    """Parameters of a squiggle model from such a header; filters become (outputs, window, inputs), features being padded to four in the file."""
    out, inputs = {}, 0
    for name, (m, rows) in parse_header(text).items():
        part, kind = name.split("_")[0], name.rsplit("_", 1)[-1]
        if part.startswith("conv") and kind == "W":
            m = m.reshape(len(m), width, -1)[:, :, : inputs or None]
            inputs = len(m)
        elif kind == "b":
            m = m.reshape(-1)[:rows]
        else:
            m = m[:, :rows]
            inputs = rows
        out[f"{part}_{kind}"] = m
    return out


def table_from_parameters(spark: SparkSession, model: str, params: dict[str, np.ndarray]) -> DataFrame:
    """model, tensor, shape, values: one row a tensor."""
    rows = [(model, k, [int(n) for n in v.shape], [float(x) for x in np.ravel(v)]) for k, v in params.items() if isinstance(v, np.ndarray)]
    return spark.createDataFrame(rows, "model string, tensor string, shape array<int>, values array<double>")


def parameters_from_table(table: DataFrame, model: str) -> dict[str, np.ndarray]:
    """A model's tensors; a model is at most some megabytes."""
    rows = table.where(F.col("model") == model).select("tensor", "shape", "values").collect()
    return {t: np.array(v).reshape(s) for t, s, v in rows}


class _Plain(pickle.Unpickler):
    """Only numpy arrays and plain containers: a pickle can't run code."""

    def find_class(self, module: str, name: str):
        if module.split(".")[0] == "numpy" and name in ("_reconstruct", "ndarray", "dtype", "scalar", "_frombuffer"):
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} isn't allowed")


def parameters_from_pickle(path: str) -> dict[str, np.ndarray]:
    """A dict of arrays that was pickled."""
    with open(path, "rb") as f:
        return {k: np.asarray(v, float) for k, v in _Plain(f).load().items()}


def regroup_gates(w: np.ndarray, order: list[int]) -> np.ndarray:
    """Rows of equally large gates in another order."""
    return np.concatenate([w.reshape(len(order), -1, *w.shape[1:])[g] for g in order])


def stay_last(w: np.ndarray) -> np.ndarray:
    """Softmax rows with stay, the first, put last."""
    return np.roll(w, -1, axis=0)


def json_to_columns(lines: DataFrame, first: str, column: str = "value") -> DataFrame:
    """Columns of JSON lines by the keys of a first object, in its order."""
    keys = list(json.loads(first))
    field = lambda k: F.get_json_object(column, f"$['{k}']").alias(k)
    return lines.select(*map(field, keys))


def first_json(lines: DataFrame, column: str = "value") -> str:
    return lines.select(column).first()[0]


def file_column() -> Column:
    return F.col("_metadata.file_path")
