"""Signals in long form: one row a sample, (read, position, value). Window and aggregate expressions only.

``key`` names the read, ``at`` the order within it. Windows are per read; a read is the unit that one task holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.numeric import MAD_SCALE

#: Least variance in a t-statistic: the smallest normal single-precision number.
LEAST_VARIANCE = 1.17549435e-38


def indexed(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """read, i, x: rows numbered from 0 within a read."""
    w = Window.partitionBy(key).orderBy(order)
    return df.select(F.col(key).alias("read"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.col(value).cast("double").alias("x"))


def quantiles(df: DataFrame, ps: Sequence[float], key: str = "read", value: str = "x") -> DataFrame:
    """read, q: exact, linearly interpolated."""
    return df.groupBy(key).agg(F.percentile(value, F.array(*map(F.lit, ps))).alias("q"))


def medians(df: DataFrame, key: str = "read", value: str = "x") -> DataFrame:
    return df.groupBy(key).agg(F.median(value).alias("med"), F.count("*").alias("n"))


def mads(df: DataFrame, key: str = "read", value: str = "x") -> DataFrame:
    """read, n, med, mad. One shuffle: the median is a window over the read, which the group by read then finds in place."""
    dev = df.select(key, value).withColumn("med", F.median(value).over(Window.partitionBy(key)))
    mad = F.median(F.abs(F.col(value) - F.col("med"))) * MAD_SCALE
    return dev.groupBy(key).agg(F.count("*").alias("n"), F.first("med").alias("med"), mad.alias("mad"))


def medmad(df: DataFrame, key: str = "read", value: str = "x") -> DataFrame:
    """df with y = (x - median) / MAD; 0 for a single sample, null where the MAD is 0. One shuffle: both medians are windows over the read."""
    w = Window.partitionBy(key)
    out = df.withColumn("_med", F.median(value).over(w)).withColumn("_n", F.count("*").over(w))
    out = out.withColumn("_dev", F.col(value) - F.col("_med"))
    out = out.withColumn("_mad", F.median(F.abs("_dev")).over(w) * MAD_SCALE)
    y = F.when(F.col("_n") == 1, F.lit(0.0)).when(F.col("_mad") > 0, F.col("_dev") / F.col("_mad"))
    return out.withColumn("y", y).drop("_med", "_n", "_dev", "_mad")


def studentise(df: DataFrame, key: str = "read", value: str = "x") -> DataFrame:
    """df with y = (x - mean) / population standard deviation; null where that is 0."""
    w = Window.partitionBy(key)
    dev = F.stddev_pop(value).over(w)
    return df.withColumn("_m", F.avg(value).over(w)).withColumn("_s", dev).withColumn("y", F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def _order(key: str, at: str):
    return Window.partitionBy(key).orderBy(at)


def difference(df: DataFrame, key: str = "read", at: str = "i", value: str = "x") -> DataFrame:
    """df with y: the next value less this one, 0 at the end."""
    return df.withColumn("y", F.coalesce(F.lead(value).over(_order(key, at)) - F.col(value), F.lit(0.0)))


def cumulative(df: DataFrame, key: str = "read", at: str = "i", value: str = "x") -> DataFrame:
    """df with exclusive running sums: total and total of squares."""
    w = _order(key, at).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("total", F.coalesce(F.sum(value).over(w), F.lit(0.0))).withColumn("squares", F.coalesce(F.sum(F.col(value) * F.col(value)).over(w), F.lit(0.0)))


def t_statistic(df: DataFrame, width: int, key: str = "read", at: str = "i", value: str = "x", name: str = "t") -> DataFrame:
    """df with the absolute t between the samples before a position and those from it on; 0 where a window doesn't fit."""
    before, after = _order(key, at).rowsBetween(-width, -1), _order(key, at).rowsBetween(0, width - 1)
    both = F.greatest(F.var_pop(value).over(before) + F.var_pop(value).over(after), F.lit(LEAST_VARIANCE))
    score = F.abs(F.avg(value).over(after) - F.avg(value).over(before)) / F.sqrt(both / width)
    fits = (F.count(value).over(before) == width) & (F.count(value).over(after) == width)
    return df.withColumn(name, F.when(fits, score).otherwise(F.lit(0.0)) if width >= 2 else F.lit(0.0))


def chunk_mads(df: DataFrame, chunk: int, key: str = "read", at: str = "i", value: str = "x") -> DataFrame:
    """read, chunk, mad of whole chunks of samples."""
    cut = df.select(key, F.floor(F.col(at) / chunk).alias("chunk"), F.col(value).alias("x"))
    med = cut.groupBy(key, "chunk").agg(F.median("x").alias("med"), F.count("*").alias("n")).where(F.col("n") == chunk)
    return cut.join(med, [key, "chunk"]).groupBy(key, "chunk").agg((F.median(F.abs(F.col("x") - F.col("med"))) * MAD_SCALE).alias("mad"))


def trim_bounds(df: DataFrame, head: int = 200, tail: int = 10, chunk: int = 100, quantile: float = 0.0, key: str = "read", at: str = "i", value: str = "x") -> DataFrame:
    """read, start, end: between the outermost chunks with a MAD over the quantile of a read's, less head and tail; reads with nothing left are dropped."""
    mad = chunk_mads(df, chunk, key, at, value)
    limit = mad.groupBy(key).agg(F.percentile("mad", quantile).alias("limit"))
    loud = mad.join(limit, key).where("mad > limit").groupBy(key)
    out = loud.agg((F.min("chunk") * chunk + head).cast("long").alias("start"), ((F.max("chunk") + 1) * chunk - tail).cast("long").alias("end"))
    return out.where("start < end")


def trimmed(df: DataFrame, bounds: DataFrame, key: str = "read", at: str = "i") -> DataFrame:
    """The samples within bounds, numbered from 0."""
    out = df.join(bounds, key).where((F.col(at) >= F.col("start")) & (F.col(at) < F.col("end")))
    return out.withColumn(at, F.col(at) - F.col("start")).drop("start", "end")


def segments(df: DataFrame, boundary: Column, key: str = "read", at: str = "i") -> DataFrame:
    """df with seg: a new segment begins at every row where boundary holds."""
    w = _order(key, at).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("seg", F.sum(F.when(boundary & (F.col(at) > 0), 1).otherwise(0)).over(w))


def segment_events(df: DataFrame, key: str = "read", at: str = "i", value: str = "x") -> DataFrame:
    """read, seg, start, length, mean, stdv of each segment."""
    return df.groupBy(key, "seg").agg(F.min(at).alias("start"), F.count("*").alias("length"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdv"))


def event_features(events: DataFrame, key: str = "read", at: str = "seg") -> DataFrame:
    """events with f_mean, f_stdv, f_length, f_step: studentised mean, stdv, length and absolute step to the next mean (0 at the end)."""
    step = F.coalesce(F.abs(F.col("mean") - F.lead("mean").over(_order(key, at))), F.lit(0.0))
    out, w = events.withColumn("step", step), Window.partitionBy(key)
    for c in ("mean", "stdv", "length", "step"):
        m, s = F.avg(c).over(w), F.stddev_pop(c).over(w)
        out = out.withColumn(f"f_{c}", F.when(s > 0, (F.col(c) - m) / s).otherwise(F.lit(0.0)))
    return out.drop("step")


def delta_features(df: DataFrame, threshold: float, shift: float = 0.0, key: str = "read", at: str = "i", value: str = "x") -> DataFrame:
    """df with y: differences, shifted and scaled by the read's own MAD, with those over the threshold set to 0."""
    scale = mads(df, key, value).select(key, "mad")
    out = difference(df, key, at, value).join(scale, key)
    moved = F.when(F.col("mad") > 0, (F.col("y") - shift) / F.col("mad"))
    return out.withColumn("y", F.when(F.abs(moved) > threshold, F.lit(0.0)).otherwise(moved)).drop("mad")


def samples_in_events(samples: DataFrame, events: DataFrame, key: str = "read", at: str = "i") -> DataFrame:
    """samples with the event (seg) whose [start, start + length) holds them. Runs are spread over their samples, so the join is on equality."""
    spread = events.select(key, "seg", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias(at))
    return samples.join(spread, [key, at])


def bounds_sane(bands: DataFrame, seq_length: Column, key: str = "read", block: str = "block") -> DataFrame:
    """read, sane: bands (low, high) start at 0, end at the sequence's end, never go back, and touch the block before."""
    w = _order(key, block)
    n = seq_length
    first = F.lag("low").over(w).isNull()
    ok = F.when(first, F.col("low") == 0).otherwise((F.col("low") >= F.lag("low").over(w)) & (F.col("high") >= F.lag("high").over(w)) & (F.col("low") <= F.lag("high").over(w)))
    ok = ok & (F.col("low") < F.col("high")) & (F.col("high") <= n) & F.when(F.lead("low").over(w).isNull(), F.col("high") == n).otherwise(True)
    return bands.withColumn("ok", ok).groupBy(key).agg(F.bool_and("ok").alias("sane"))
