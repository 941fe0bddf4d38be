"""Operators on reads: one row a read, with arrays for signal, blocks and paths. numpy kernels over Arrow batches, no shuffle.

Inputs that are null give null outputs, as do reads on which a kernel has no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sigloom.kernels import decode, detect, layers, mapping, networks

EVENT = "struct<start: bigint, length: float, mean: float, stdv: float, pos: int, state: int>"


def to_reads(samples: DataFrame, key: str = "read", at: str = "i", value: str = "x") -> DataFrame:
    """read_id, signal from long form."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(at).alias("i"), F.col(value).cast("double").alias("x"))))
    return samples.groupBy(F.col(key).alias("read_id")).agg(F.transform(pairs, lambda p: p["x"]).alias("signal"))


def to_samples(reads: DataFrame, key: str = "read_id", signal: str = "signal") -> DataFrame:
    """read, i, x from one row a read."""
    return reads.select(F.col(key).alias("read"), F.posexplode(signal).alias("i", "x")).withColumn("i", F.col("i").cast("long"))


def _value(col: pa.Array, i: int):
    x = col[i]
    if not x.is_valid:
        return None
    if pa.types.is_list(x.type) or pa.types.is_large_list(x.type):
        inner = x.values
        if pa.types.is_struct(inner.type):
            return {f.name: inner.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(inner.type)}
        if pa.types.is_list(inner.type) or pa.types.is_large_list(inner.type):
            return inner.flatten().to_numpy(zero_copy_only=False).reshape(len(inner), -1) if len(inner) else np.zeros((0, 0))
        return inner.to_numpy(zero_copy_only=False)
    return x.as_py()


#: Bytes of kernel output that are held before a batch is handed on.
OUT_BYTES = 16 << 20


def _bytes(x) -> int:
    if isinstance(x, np.ndarray):
        return x.nbytes
    return sum(map(_bytes, x.values())) if isinstance(x, Mapping) else 8 if x is None or np.isscalar(x) and not isinstance(x, str) else len(x)


def _lists(sizes: list[int], inner: pa.Array, missing: list[bool]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), inner, mask=pa.array(missing))


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow array of kernel results: numbers and texts, 1-d and 2-d arrays, or dicts of arrays as lists of structs. Buffers are copied, not boxed."""
    if not pa.types.is_list(kind):
        return pa.array([x.item() if isinstance(x, np.generic) else x for x in values], kind)
    missing, there = [x is None for x in values], [x for x in values if x is not None]
    flat = lambda parts, t: pa.array(np.concatenate([np.asarray(p).reshape(-1) for p in parts]) if parts else [], t)
    inner = kind.value_type
    if pa.types.is_struct(inner):
        cols = [flat([x[f.name] for x in there], f.type) if f.type != pa.float32() else flat([np.asarray(x[f.name], np.float32) for x in there], f.type) for f in inner]
        count = [0 if x is None else len(x[inner[0].name]) for x in values]
        return _lists(count, pa.StructArray.from_arrays(cols, fields=list(inner)), missing)
    count = [0 if x is None else len(x) for x in values]
    if pa.types.is_list(inner):
        rows = _lists([x.shape[1] for x in there for _ in range(len(x))], flat(there, inner.value_type), [False] * sum(count))
        return _lists(count, rows.cast(inner), missing)
    return _lists(count, flat(there, inner), missing)


#: Entries of a first input that a kernel of several rows gets at a time.
TOGETHER = 1 << 15


def per_read(df: DataFrame, kernel: Callable[..., tuple | None], inputs: list[str], outputs: str, together: bool = False) -> DataFrame:
    """df with further columns (a DDL string) that kernel(*inputs) returns as a tuple for each row. Rows go on once their output has OUT_BYTES.

    together: the kernel takes a list of rows' inputs, about TOGETHER entries of the first one, and returns a tuple for each.
    """
    added = T._parse_datatype_string(outputs)
    schema = T.StructType([*df.schema.fields, *added.fields])
    arrow = to_arrow_schema(added)
    empty = [None] * len(arrow)

    def results(rb: pa.RecordBatch) -> Iterator[list]:
        at = [rb.schema.get_field_index(c) for c in inputs]
        held: list[tuple | None] = []
        entries = 0
        for i in range(rb.num_rows):
            args = tuple(_value(rb.column(c), i) for c in at)
            args = None if any(a is None for a in args) else args
            if not together:
                yield (kernel(*args) if args else None) or empty
                continue
            held.append(args)
            entries += len(args[0]) if args else 0
            if entries >= TOGETHER or i + 1 == rb.num_rows:
                got = iter(kernel([a for a in held if a]))
                yield from ((next(got) if a else None) or empty for a in held)
                held, entries = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows, first, size = [], 0, 0
            for i, out in enumerate(results(rb)):
                rows.append(out)
                size += sum(map(_bytes, out))
                if size >= OUT_BYTES or i + 1 == rb.num_rows:
                    part = rb.slice(first, len(rows))
                    cols = [_column([r[k] for r in rows], f.type).cast(f.type) for k, f in enumerate(arrow)]
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in range(rb.num_columns)] + cols, names=[*rb.schema.names, *arrow.names])
                    rows, first, size = [], i + 1, 0

    return df.mapInArrow(run, schema)


# ---- signals ------------------------------------------------------------------------------------------------
def trim(df: DataFrame, head: int = 200, tail: int = 10, chunk: int = 100, quantile: float = 0.0, signal: str = "signal") -> DataFrame:
    """df with start and end of the trimmed view; both 0 where nothing is left."""
    return per_read(df, lambda x: detect.trim(x, head, tail, chunk, quantile), [signal], "start int, end int")


def normalise(df: DataFrame, signal: str = "signal") -> DataFrame:
    """df with normalised: the view [start, end) by median and MAD; null for an empty view or a MAD of 0."""

    def kernel(x, start, end):
        y = detect.medmad(x[start:end]) if end > start else None
        return None if y is None else (y,)

    return per_read(df, kernel, [signal, "start", "end"], "normalised array<double>")


def detect_events(df: DataFrame, params: detect.Detection = detect.Detection(), signal: str = "signal") -> DataFrame:
    """df with events of the view [start, end), or of the whole signal without such columns; starts count from the view's."""
    views = ["start", "end"] if {"start", "end"} <= set(df.columns) else []

    def kernel(x, start=0, end=None):
        ev = detect.detect(x[start : len(x) if end is None else end], params)
        n = len(ev["start"])
        return (ev | {"pos": np.full(n, -1), "state": np.full(n, -1)},) if n else None

    return per_read(df, kernel, [signal, *views], f"events array<{EVENT}>")


# ---- networks -----------------------------------------------------------------------------------------------
def posterior(df: DataFrame, model: str, params: dict, min_prob: float = 1e-6, weight_temperature: float = 1.0, bias_temperature: float = 1.0, log: bool = True, signal: str = "normalised") -> DataFrame:
    """df with post: blocks of state (or transition) scores. params travel to the executors as one broadcast."""
    networks.model(model)
    shared = df.sparkSession.sparkContext.broadcast(params)
    opts = {"min_prob": min_prob, "t_weight": weight_temperature, "t_bias": bias_temperature, "log": log}
    return per_read(df, lambda x: (networks.posterior(model, x, shared.value, **opts),), [signal], "post array<array<double>>")


def events_posterior(df: DataFrame, params: dict, zero_head: bool = False, **opts) -> DataFrame:
    """df (with events) with post."""
    shared = df.sparkSession.sparkContext.broadcast(params)

    def kernel(ev):
        x = networks.normalised_event_features(ev["mean"], ev["stdv"], ev["length"])
        return (networks.events_posterior(x, shared.value, zero_head=zero_head, **opts),)

    return per_read(df, kernel, ["events"], "post array<array<double>>")


def squiggle(df: DataFrame, model: str, params: dict, rescale: bool = False, states: str = "states") -> DataFrame:
    """df with squiggle: (current, deviation, dwell) of each base; null without bases. Sequences go through the network many at a time."""
    run, shared = networks.squiggle_model(model), df.sparkSession.sparkContext.broadcast(params)

    def kernel(rows: list[tuple]) -> Iterator[tuple | None]:
        some = [s for (s,) in rows if len(s)]
        out = iter(run(some, shared.value, rescale) if some else [])
        return [(next(out),) if len(s) else None for (s,) in rows]

    return per_read(df, kernel, [states], "squiggle array<array<double>>", together=True)


# ---- from signal to bases in one kernel: posteriors, some thousand times a read's size, never leave it -------------
def _decoded(post, crf: bool, homopolymer: str, **penalties) -> tuple | None:
    if crf:
        score, path = decode.crf_viterbi(post)
        bases, pos = decode.crf_bases(path[:-1])
    else:
        score, path = decode.viterbi(post, **penalties)
        path = decode.homopolymer_correct(post, path, homopolymer)
        bases, pos = decode.stitch(path, ((post.shape[1] - 1).bit_length() - 1) // 2)
    return None if bases is None else (score, path, bases, pos, len(post))


_CALL = "score double, path array<int>, bases string, pos array<int>, nblock int"


def call_signal(df: DataFrame, model: str, params: dict, network: dict, homopolymer: str = "nochange", signal: str = "signal", **penalties) -> DataFrame:
    """df with score, path, bases, pos, nblock of the view [start, end): normalise, posterior and the model's decoder. network: options of posterior."""
    crf, shared = networks.model(model).crf, df.sparkSession.sparkContext.broadcast(params)

    def kernel(x, start, end):
        y = detect.medmad(x[start:end]) if end > start else None
        return None if y is None else _decoded(networks.posterior(model, y, shared.value, **network), crf, homopolymer, **penalties)

    return per_read(df, kernel, [signal, "start", "end"], _CALL)


def call_events(df: DataFrame, params: dict, network: dict, zero_head: bool = False, dwell_correction: bool = False, **penalties) -> DataFrame:
    """df (with events) with score, path, bases, pos, nblock, corrected: posterior, decoder and, if asked for, bases with homopolymers by dwell."""
    shared = df.sparkSession.sparkContext.broadcast(params)

    def kernel(ev):
        x = networks.normalised_event_features(ev["mean"], ev["stdv"], ev["length"])
        post = networks.events_posterior(x, shared.value, zero_head=zero_head, **network)
        out = _decoded(post, False, "nochange", **penalties)
        if out is None or not dwell_correction:
            return out and (*out, None)
        called = ev | {"pos": out[3][: len(ev["pos"])], "state": out[1][: len(ev["pos"])] + 1}
        return *out, decode.dwell_corrected(out[1][: len(ev["pos"])], called, post.shape[1], len(out[2]))

    return per_read(df, kernel, ["events"], _CALL + ", corrected string")


def map_signal_to_sequence(df: DataFrame, model: str, params: dict, network: dict, band: int | None = None, signal: str = "signal", **mapping_options) -> DataFrame:
    """df (with states) with map_score, map_path of the view [start, end): normalise, posterior and mapping."""
    shared = df.sparkSession.sparkContext.broadcast(params)

    def kernel(x, start, end, states):
        y = detect.medmad(x[start:end]) if end > start else None
        if y is None:
            return None
        post = networks.posterior(model, y, shared.value, **network)
        bands = None if band is None else mapping.diagonal_bands(len(post), len(states), band)
        return mapping.map_to_sequence(post, states, bands=bands, **mapping_options)

    return per_read(df, kernel, [signal, "start", "end", "states"], "map_score double, map_path array<int>")


# ---- decoding -----------------------------------------------------------------------------------------------
def decode_transducer(df: DataFrame, stay_penalty: float = 0.0, skip_penalty: float = 0.0, local_penalty: float = 2.0, slip: bool = False, homopolymer: str = "nochange") -> DataFrame:
    """df (with post) with score, path, bases, pos."""

    def kernel(post):
        score, path = decode.viterbi(post, stay_penalty, skip_penalty, local_penalty, slip)
        path = decode.homopolymer_correct(post, path, homopolymer)
        bases, pos = decode.stitch(path, ((post.shape[1] - 1).bit_length() - 1) // 2)
        return None if bases is None else (score, path, bases, pos)

    return per_read(df, kernel, ["post"], "score double, path array<int>, bases string, pos array<int>")


def decode_crf(df: DataFrame) -> DataFrame:
    """df (with post holding transition scores) with score, path, bases, pos."""

    def kernel(post):
        score, path = decode.crf_viterbi(post)
        bases, pos = decode.crf_bases(path[:-1])
        return score, path, bases, pos

    return per_read(df, kernel, ["post"], "score double, path array<int>, bases string, pos array<int>")


def crf_posterior(df: DataFrame, extra_unit: bool = False) -> DataFrame:
    """df (with post) with base_probs: blocks + 1 rows of state probabilities."""
    return per_read(df, lambda post: (decode.crf_posterior(post, extra_unit),), ["post"], "base_probs array<array<double>>")


def decode_post(df: DataFrame, model: str, **opts) -> DataFrame:
    """The model's own decoder."""
    return decode_crf(df) if networks.model(model).crf else decode_transducer(df, **opts)


def dwell_correct(df: DataFrame) -> DataFrame:
    """df (with post, path and events that carry pos and state) with corrected: bases with homopolymers by dwell."""

    def kernel(post, path, ev, bases):
        return (decode.dwell_corrected(path[: len(ev["pos"])], ev, post.shape[1], len(bases)),)

    return per_read(df, kernel, ["post", "path", "events", "bases"], "corrected string")


# ---- mapping ------------------------------------------------------------------------------------------------
def map_post_to_sequence(df: DataFrame, stay_penalty: float = 0.0, skip_penalty: float = 0.0, local_penalty: float = 4.0, forward: bool = False, band: int | None = None, scored_start: bool = False) -> DataFrame:
    """df (with post and states) with map_score and, for the best unbanded mapping, map_path. band: positions either side of the diagonal."""

    def kernel(post, states):
        bands = None if band is None else mapping.diagonal_bands(len(post), len(states), band)
        score, path = mapping.map_to_sequence(post, states, stay_penalty, skip_penalty, local_penalty, forward, bands, scored_start)
        return score, path

    return per_read(df, kernel, ["post", "states"], "map_score double, map_path array<int>")


def map_signal_to_squiggle(df: DataFrame, rate: float = 1.0, back_probability: float = 0.0, local_penalty: float = 2.0, skip_penalty: float = 5000.0, min_score: float = 5.0, forward: bool = False) -> DataFrame:
    """df (with normalised and squiggle) with map_score and map_path."""
    opts = (rate, back_probability, local_penalty, skip_penalty, min_score, forward)
    return per_read(df, lambda x, q: mapping.match_squiggle(x, q, *opts), ["normalised", "squiggle"], "map_score double, map_path array<int>")


# ---- chains in long form: one row a vector, so that no read has to fit in a row ------------------------------------------
def _in_order(key: str, order: str, values: str) -> list[Column]:
    return [F.col(key), F.col(order).asc_nulls_last(), F.col(values)]


def _vectors(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, width) of a column of lists, and whether each value is there; what is missing is 0, what is beyond is left out."""
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().cast(pa.float64())
    valid, x = flat.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    if (size == width).all():
        return x.reshape(-1, width), valid.reshape(-1, width)
    x, valid = np.append(x, 0.0), np.append(valid, False)
    at = np.where(np.arange(width) < size[:, None], (np.cumsum(size) - size)[:, None] + np.arange(width), len(x) - 1)
    return x[at], valid[at]


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return list(zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))


def crf_stretches(df: DataFrame, key: str, order: str, values: str, width: int, states: int) -> DataFrame:
    """key, m: a few blocks with the best scores of a read, one for each stretch of it, that a CRF takes in place of the read's own blocks.

    A vector of ``width`` values is blocks of states * states scores. Stretches are made side by side, also those of one read.
    A score that is missing is no path; rows without a key are left out.
    """
    schema = T.StructType([df.schema[key], *T._parse_datatype_string("part int, at long, block array<double>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for rb in batches:
            if not rb.num_rows:
                continue
            runs = _runs(rb.column(0).to_numpy(zero_copy_only=False))
            x, there = (a.reshape(-1, states, states) for a in _vectors(rb.column(1), width))
            owner = np.repeat(np.arange(len(runs)), [(b - a) * (width // states**2) for a, b in runs])
            x, there, _ = decode.crf_stretches(x, there, owner)
            blocks = pa.array(x.reshape(-1), mask=~there.reshape(-1))
            n = len(runs)
            yield pa.RecordBatch.from_arrays(
                [rb.column(0).take(pa.array([a for a, _ in runs])), pa.array(np.full(n, TaskContext.get().partitionId()), pa.int32()), pa.array(np.arange(done, done + n)), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * states**2, blocks)],
                names=schema.names,
            )
            done += n

    own = _in_order(key, order, values)
    # Partitions are ranges in the same order, so that partition and place in it order a read's stretches.
    rows = df.where(F.col(key).isNotNull()).repartitionByRange(*own[:2]).sortWithinPartitions(*own).select(key, values)
    parts = F.array_sort(F.collect_list(F.struct("part", "at", "block")))
    return rows.mapInArrow(run, schema).groupBy(key).agg(F.transform(parts, lambda p: p["block"]).alias("m"))


def gru_vectors(df: DataFrame, key: str, order: str, values: str, width: int, params: tuple) -> DataFrame:
    """key, block, h: of each vector, the number of its first block in its read and the states of all its blocks, one after the other.

    A vector of ``width`` values is blocks of as many values as the network (weights, bias, gate and candidate recurrence) takes.
    A read's vectors pass through one task in their order, a batch at a time. From a missing value on, a read's states are null; rows
    without a key are left out.
    """
    shared = df.sparkSession.sparkContext.broadcast(params)
    features, size = params[0].shape[1], len(params[3])
    per = width // features
    schema = T.StructType([df.schema[key], *T._parse_datatype_string("block long, h array<double>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, state, whole, done = None, np.zeros(size), True, 0
        for rb in batches:
            if not rb.num_rows:
                continue
            keys = rb.column(0).to_numpy(zero_copy_only=False)
            x, there = _vectors(rb.column(1), width)
            out, missing, number = np.zeros((len(keys) * per, size)), np.zeros(len(keys) * per, bool), np.empty(len(keys), np.int64)
            for a, b in _runs(keys):
                if keys[a] != read:
                    read, state, whole, done = keys[a], np.zeros(size), True, 0
                good = there[a:b].reshape(-1, features).all(axis=1)
                n = (len(good) if good.all() else int(good.argmin())) if whole else 0
                if n:
                    out[a * per : a * per + n] = layers.gru_along(x[a:b].reshape(-1, features)[:n], *shared.value, state)
                    state = out[a * per + n - 1].copy()
                missing[a * per + n : b * per] = True
                whole = whole and n == len(good)
                number[a:b] = (done + np.arange(b - a)) * per
                done += b - a
            flat = pa.array(out.reshape(-1), mask=np.repeat(missing, size))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(number), pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * (per * size), flat)], names=schema.names)

    rows = df.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(*_in_order(key, order, values)).select(key, values)
    return rows.mapInArrow(run, schema)
