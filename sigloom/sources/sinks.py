"""Sinks: DataFrames of one string column ``value`` to write as text, in the reference formats, and Parquet for events.

Formats (keys, their order, column heads) are fixed values.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fixed(x: Column, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def fasta_raw(df: DataFrame, prefix: str = "", use_uuid: bool = False) -> DataFrame:
    """From read_id, uuid, score, bases, signal length (n), start, end, nblock: a record of two lines."""
    name = F.concat(F.lit(prefix), F.col("uuid" if use_uuid else "read_id"))
    info = F.format_string(
        '{ "filename" : "%s", "uuid" : "%s", "normalised_score" : %f,  "nblock" : %d,  "sequence_length" : %d,  "blocks_per_base" : %f, "nsample" : %d, "trim" : [ %d, %d ] }',
        "read_id", "uuid", -F.col("score") / F.col("nblock"), F.col("nblock").cast("int"), F.length("bases"), F.col("nblock") / F.length("bases"), F.col("n").cast("int"), F.col("start").cast("int"), F.col("end").cast("int"),
    )
    return df.select(F.concat(F.lit(">"), name, F.lit("  "), info, F.lit("\n"), F.col("bases")).alias("value"))


def fasta_events(df: DataFrame, prefix: str = "", use_uuid: bool = False) -> DataFrame:
    """From read_id, uuid, score, bases, nevent."""
    name = F.concat(F.lit(prefix), F.col("uuid" if use_uuid else "read_id"))
    info = F.format_string(
        '{ "filename" : "%s", "uuid" : "%s", "normalised_score" : %f,  "nevent" : %d,  "sequence_length" : %d,  "events_per_base" : %f }',
        "read_id", "uuid", -F.col("score") / F.col("nevent"), F.col("nevent").cast("int"), F.length("bases"), F.col("nevent") / F.length("bases"),
    )
    return df.select(F.concat(F.lit(">"), name, F.lit("  "), info, F.lit("\n"), F.col("bases")).alias("value"))


def sam(df: DataFrame, prefix: str = "", use_uuid: bool = False) -> DataFrame:
    """Unaligned lines from read_id, uuid, bases; no header."""
    name = F.concat(F.lit(prefix), F.col("uuid" if use_uuid else "read_id"))
    return df.select(F.concat_ws("\t", name, F.lit("4"), *[F.lit(x) for x in ("*", "0", "0", "*", "*", "0", "0")], F.col("bases"), F.lit("*")).alias("value"))


def _lines(df: DataFrame, title: Column, head: str, rows: Column) -> DataFrame:
    return df.select(F.explode(F.concat(F.array(title, F.lit(head)), rows)).alias("value"))


def event_tsv(df: DataFrame) -> DataFrame:
    """From read_id, events: a title, heads, then event, start, mean, stdv, dwell."""
    rows = F.transform("events", lambda e, i: F.concat_ws("\t", i.cast("string"), e["start"].cast("string"), _fixed(e["mean"]), _fixed(e["stdv"]), e["length"].cast("int").cast("string")))
    return _lines(df, F.concat(F.lit("#"), F.col("read_id")), "event\tstart\tmean\tstdv\tdwell", rows)


def squiggle_tsv(df: DataFrame) -> DataFrame:
    """From name, seq, squiggle: pos, base, current, sd, dwell."""
    rows = F.transform("squiggle", lambda q, i: F.concat_ws("\t", i.cast("string"), F.substring("seq", i + 1, F.lit(1)), *[_fixed(F.get(q, F.lit(k))) for k in range(3)]))
    return _lines(df, F.concat(F.lit("#"), F.col("name")), "pos\tbase\tcurrent\tsd\tdwell", rows)


def path_squiggle(df: DataFrame) -> DataFrame:
    """From read_id, signal, map_path, seq, squiggle: a row a sample with its squiggle row; unmapped samples have base N and nulls."""
    out = df.select("read_id", "signal", "seq", "squiggle", F.posexplode("map_path").alias("idx", "pos"))
    on = F.col("pos") >= 0
    row = F.when(on, F.get("squiggle", F.col("pos")))
    base = F.when(on, F.substring("seq", F.col("pos") + 1, F.lit(1))).otherwise(F.lit("N"))
    return out.select("read_id", "idx", F.get("signal", F.col("idx")).alias("signal"), "pos", base.alias("base"), *[F.get(row, F.lit(k)).alias(n) for k, n in enumerate(("current", "sd", "dwell"))])


def mappy_tsv(df: DataFrame) -> DataFrame:
    """idx, signal, pos, base, current, sd, dwell of path_squiggle's rows; nan where unmapped."""
    rows = path_squiggle(df)
    num = lambda c: F.when(F.col(c).isNull(), F.lit("nan")).otherwise(_fixed(F.col(c)))
    return rows.select("read_id", "idx", F.concat_ws("\t", F.col("idx").cast("string"), num("signal"), F.col("pos").cast("string"), "base", num("current"), num("sd"), num("dwell")).alias("value"))


def seqmappy_tsv(df: DataFrame) -> DataFrame:
    """From read_id, map_score, map_path: a title with the score, blocks and score a block, then block and pos."""
    n = F.size("map_path")
    title = F.format_string("# %s  Score %f over %d blocks (%f per block)", "read_id", -F.col("map_score"), n, -F.col("map_score") / n)
    return _lines(df, title, "block\tpos", F.transform("map_path", lambda p, i: F.concat_ws("\t", i.cast("string"), p.cast("string"))))


def event_rows(df: DataFrame) -> DataFrame:
    """read_id, event, start, length, mean, stdv, pos, state: events as rows, for Parquet."""
    return df.select("read_id", F.posexplode("events").alias("event", "e")).select("read_id", "event", "e.*")


def write_events(df: DataFrame, path: str) -> None:
    event_rows(df).write.parquet(path)


def crp_lines(df: DataFrame, matrix: str = "matrix") -> DataFrame:
    """value: each matrix as text with hex floats, as the reader takes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out = []
            for m in rb.column(0).to_pylist():
                out.append("\n".join([f"{len(m[0]) if m else 0}\t{len(m)}", *["\t".join(float(x).hex() for x in block) for block in m]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return df.select(matrix).mapInArrow(run, "value string")


def json_tsv(df: DataFrame, sep: str = "\t") -> DataFrame:
    """value: the columns of each row joined, null as empty."""
    return df.select(F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value"))


def write_text(df: DataFrame, path: str) -> None:
    """One ``value`` a record, which may hold several lines."""
    df.write.text(path)


def show_matrix(df: DataFrame, matrix: str = "matrix", rows: int = 20) -> None:
    df.select(matrix).show(rows, truncate=False)
