"""Queries over the driver's tables, and the SQL that says the same where SQL can.

``events`` is a set of signals: user_id is the read, ts the order, value the sample. ``embeddings`` is a set of
matrices: label is the read, vec_id the order of blocks. ``documents``, upper-cased and stripped to A C G T, is a
set of sequences. Floats are rounded to six digits on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions import matrix as M
from sigloom.functions import numeric as N
from sigloom.functions import sequence as Q
from sigloom.kernels import layers, networks
from sigloom.operators import reads
from sigloom.operators import signal as S
from sigloom.plans import pipelines
from sigloom.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(x: Column | str) -> Column:
    """Rounded, with no negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _signal(spark, sf_dir) -> DataFrame:
    return S.indexed(_table(spark, sf_dir, "events").where("value is not null"), "user_id", "ts", "value")


def _reads(spark, sf_dir) -> DataFrame:
    ev = _table(spark, sf_dir, "events").where("value is not null")
    return reads.to_reads(ev, "user_id", "ts", "value").withColumn("uuid", F.format_string("read-%d", "read_id"))


def _sequences(spark, sf_dir) -> DataFrame:
    """doc_id, seq: at least ten bases."""
    docs = readers.spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]+", "").alias("seq"))
    return docs.where(F.length("seq") >= 10)


#: Components of a vector, all of which the queries read.
WIDTH = 64


def _matrices(spark, sf_dir, width: int = WIDTH) -> DataFrame:
    """read_id, m: blocks of ``width`` features, so many a vector as it takes, in order of vec_id."""
    rows = F.array_sort(F.collect_list(F.struct("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))))
    out = _table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("read_id")).agg(F.transform(rows, lambda r: r["v"]).alias("m"))
    return out if width == WIDTH else out.withColumn("m", M.from_array(F.flatten("m"), width))


_SIG = "sig AS (SELECT user_id AS read, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, value AS x FROM events WHERE value IS NOT NULL)"
_MED = f"{_SIG}, med AS (SELECT read, median(x) AS med, count(*) AS n FROM sig GROUP BY read), mad AS (SELECT read, n, med, 1.4826 * median(abs(x - med)) AS mad FROM sig JOIN med USING (read) GROUP BY read, n, med)"
_SEQ = "seq AS (SELECT doc_id, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS seq FROM documents), s AS (SELECT * FROM seq WHERE length(seq) >= 10)"


def _blocks_sql(width: int = WIDTH) -> str:
    n = WIDTH // width
    whole = "vectors AS (SELECT label AS read_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
    return f"{whole}, b AS (SELECT read_id, i * {n} + j AS block, v[{width} * j + 1 : {width} * j + {width}] AS v FROM vectors, range(0, {n}) r(j))"


# ---- signals ------------------------------------------------------------------------------------------------
@query("SELECT event_id, round((value + 16) * 1373.41 / 8192, 6) + 0.0 AS pa, round(greatest(-30.0, least(30.0, (value + 16) * 1373.41 / 8192)), 6) + 0.0 AS clipped FROM events")
def signal_scale(spark, sf_dir):
    pa = N.adc_to_pa(F.col("value"), F.lit(16.0), F.lit(1373.41), F.lit(8192.0))
    return _table(spark, sf_dir, "events").select("event_id", r6(pa).alias("pa"), r6(N.clip(pa, 30.0)).alias("clipped"))


@query(f"WITH {_SIG} SELECT read, " + ", ".join(f"round(quantile_cont(x, {p}), 6) + 0.0 AS q{round(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM sig GROUP BY read")
def signal_quantiles(spark, sf_dir):
    ps = (0.1, 0.25, 0.5, 0.75, 0.9)
    q = S.quantiles(_table(spark, sf_dir, "events"), ps, "user_id", "value")
    return q.select(F.col("user_id").alias("read"), *[r6(F.get("q", F.lit(k))).alias(f"q{round(p * 100)}") for k, p in enumerate(ps)])


@query(f"WITH {_MED} SELECT read, n, round(med, 6) + 0.0 AS med, round(mad, 6) + 0.0 AS mad FROM mad")
def signal_mad(spark, sf_dir):
    ev = _table(spark, sf_dir, "events").select(F.col("user_id").alias("read"), F.col("value").alias("x")).where("x is not null")
    return S.mads(ev).select("read", "n", r6("med").alias("med"), r6("mad").alias("mad"))


@query(f"WITH {_MED} SELECT read, i, round(CASE WHEN n = 1 THEN 0.0 WHEN mad > 0 THEN (x - med) / mad END, 6) + 0.0 AS y FROM sig JOIN mad USING (read)")
def signal_medmad(spark, sf_dir):
    return S.medmad(_signal(spark, sf_dir)).select("read", "i", r6("y").alias("y"))


@query(f"WITH {_SIG} SELECT read, i, round(CASE WHEN stddev_pop(x) OVER w > 0 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w END, 6) + 0.0 AS y FROM sig WINDOW w AS (PARTITION BY read)")
def signal_studentise(spark, sf_dir):
    return S.studentise(_signal(spark, sf_dir)).select("read", "i", r6("y").alias("y"))


@query(f"WITH {_SIG} SELECT read, i, round(coalesce(lead(x) OVER (PARTITION BY read ORDER BY i) - x, 0), 6) + 0.0 AS y FROM sig")
def signal_diff(spark, sf_dir):
    return S.difference(_signal(spark, sf_dir)).select("read", "i", r6("y").alias("y"))


@query("SELECT event_id, round(CASE WHEN abs(value - 100) > 50 THEN 0.0 ELSE value - 100 END, 6) + 0.0 AS y FROM events")
def signal_filter(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", r6(N.large_to(F.col("value") - 100, 50.0)).alias("y"))


@query(f"WITH {_MED}, d AS (SELECT read, i, mad, coalesce(lead(x) OVER (PARTITION BY read ORDER BY i) - x, 0) AS d FROM sig JOIN mad USING (read)), s AS (SELECT read, i, CASE WHEN mad > 0 THEN (d - 1) / mad END AS y FROM d) SELECT read, i, round(CASE WHEN abs(y) > 1.5 THEN 0.0 ELSE y END, 6) + 0.0 AS y FROM s")
def delta_features(spark, sf_dir):
    return S.delta_features(_signal(spark, sf_dir), 1.5, 1.0).select("read", "i", r6("y").alias("y"))


@query(
    f"""WITH {_SIG}, c AS (SELECT read, i // 10 AS chunk, x FROM sig), md AS (SELECT read, chunk, median(x) AS med FROM c GROUP BY read, chunk HAVING count(*) = 10),
    m AS (SELECT read, chunk, 1.4826 * median(abs(x - med)) AS mad FROM c JOIN md USING (read, chunk) GROUP BY read, chunk),
    l AS (SELECT read, quantile_cont(mad, 0.25) AS lim FROM m GROUP BY read),
    t AS (SELECT read, (min(chunk) * 10 + 3)::BIGINT AS "start", ((max(chunk) + 1) * 10 - 2)::BIGINT AS "end" FROM m JOIN l USING (read) WHERE mad > lim GROUP BY read)
    SELECT * FROM t WHERE "start" < "end\""""
)
def trim_mad(spark, sf_dir):
    return S.trim_bounds(_signal(spark, sf_dir), 3, 2, 10, 0.25)


@query(f"WITH {_SIG} SELECT read, i, round(coalesce(sum(x) OVER w, 0), 4) + 0.0 AS total, round(coalesce(sum(x * x) OVER w, 0), 4) + 0.0 AS squares FROM sig WINDOW w AS (PARTITION BY read ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def cumsum(spark, sf_dir):
    out = S.cumulative(_signal(spark, sf_dir))
    return out.select("read", "i", (F.round("total", 4) + 0.0).alias("total"), (F.round("squares", 4) + 0.0).alias("squares"))


def _tstat_sql(w: int) -> str:
    return f"""WITH {_SIG}, t AS (SELECT read, i, count(*) OVER b AS nb, count(*) OVER a AS na, abs(avg(x) OVER a - avg(x) OVER b) / sqrt(greatest(var_pop(x) OVER a + var_pop(x) OVER b, 1.17549435e-38) / {w}) AS t FROM sig
    WINDOW b AS (PARTITION BY read ORDER BY i ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), a AS (PARTITION BY read ORDER BY i ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING))
    SELECT read, i, round(CASE WHEN nb = {w} AND na = {w} THEN t ELSE 0 END, 4) + 0.0 AS t FROM t"""


@query(_tstat_sql(3))
def tstat_short(spark, sf_dir):
    return S.t_statistic(_signal(spark, sf_dir), 3).select("read", "i", (F.round("t", 4) + 0.0).alias("t"))


@query(_tstat_sql(6))
def tstat_long(spark, sf_dir):
    return S.t_statistic(_signal(spark, sf_dir), 6).select("read", "i", (F.round("t", 4) + 0.0).alias("t"))


_SEG = f"{_SIG}, j AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY read ORDER BY i)) > 60 AS cut FROM sig), g AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY read ORDER BY i) AS seg FROM j), e AS (SELECT read, seg::BIGINT AS seg, min(i) AS start, count(*) AS length, avg(x) AS mean, stddev_pop(x) AS stdv FROM g GROUP BY read, seg)"


def _segments(spark, sf_dir):
    sig = _signal(spark, sf_dir)
    jump = F.abs(F.col("x") - F.lag("x").over(Window.partitionBy("read").orderBy("i"))) > 60
    return S.segments(sig.withColumn("cut", F.coalesce(jump, F.lit(False))), F.col("cut")).drop("cut")


@query(f"WITH {_SEG} SELECT read, seg, start, length, round(mean, 6) + 0.0 AS mean, round(stdv, 5) + 0.0 AS stdv FROM e")
def segment_stats(spark, sf_dir):
    return S.segment_events(_segments(spark, sf_dir)).select("read", "seg", "start", "length", r6("mean").alias("mean"), (F.round("stdv", 5) + 0.0).alias("stdv"))


_FEATS = ("mean", "stdv", "length", "step")


@query(f"WITH {_SEG}, f AS (SELECT *, coalesce(abs(mean - lead(mean) OVER (PARTITION BY read ORDER BY seg)), 0) AS step FROM e) SELECT read, seg, " + ", ".join(f"round(CASE WHEN stddev_pop({c}) OVER w > 1e-9 THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w ELSE 0 END, 5) + 0.0 AS f_{c}" for c in _FEATS) + " FROM f WINDOW w AS (PARTITION BY read)")
def event_features(spark, sf_dir):
    ev = S.event_features(S.segment_events(_segments(spark, sf_dir)))
    return ev.select("read", "seg", *[(F.round(f"f_{c}", 5) + 0.0).alias(f"f_{c}") for c in _FEATS])


@query(f"WITH {_SEG} SELECT g.read, g.i, e.seg, round(g.x - e.mean, 6) + 0.0 AS off FROM g JOIN e ON g.read = e.read AND g.i >= e.start AND g.i < e.start + e.length")
def samples_in_events(spark, sf_dir):
    seg = _segments(spark, sf_dir)
    ev = S.segment_events(seg)
    return S.samples_in_events(seg.drop("seg"), ev).join(ev.select("read", "seg", "mean"), ["read", "seg"]).select("read", "i", "seg", r6(F.col("x") - F.col("mean")).alias("off"))


def _events_sql(ctes: str, sig: str = "sig") -> str:
    """Events of the signals in one of the CTEs: both detectors sample by sample, the long one silenced by the short one's peaks."""
    t = lambda w, k: f"CASE WHEN count(*) OVER b{w} = {w} AND count(*) OVER a{w} = {w} THEN abs(avg(x) OVER a{w} - avg(x) OVER b{w}) / sqrt(greatest(var_pop(x) OVER a{w} + var_pop(x) OVER b{w}, 1.17549435e-38) / {w}) ELSE 0 END AS {k}"
    windows = ", ".join(f"b{w} AS (PARTITION BY read ORDER BY i ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), a{w} AS (PARTITION BY read ORDER BY i ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)" for w in (3, 6))

    def seen(d: str, now: str, threshold: float, live: str = "TRUE") -> str:
        """at, value and valid of a detector once it has seen a score."""
        return f"""CASE WHEN NOT {live} THEN {d}a WHEN {d}a < 0 THEN CASE WHEN {now} >= {d}v AND {now} - {d}v > 0.2 THEN i ELSE -1 END WHEN {now} > {d}v THEN i ELSE {d}a END AS {d}a1,
            CASE WHEN NOT {live} THEN {d}v WHEN {d}a < 0 THEN CASE WHEN {now} < {d}v OR {now} - {d}v > 0.2 THEN {now} ELSE {d}v END ELSE greatest({now}, {d}v) END AS {d}v1,
            {d}o OR ({live} AND {d}a >= 0 AND {now} <= {d}v AND {d}v - {now} > 0.2 AND {d}v > {threshold}) AS {d}o1, {live} AND {d}a >= 0 AS {d}h"""

    reset = lambda d, when, value: f"CASE WHEN {when} THEN -1 ELSE {d}a1 END AS {d}a, CASE WHEN {when} THEN {value} ELSE {d}v1 END AS {d}v, {d}o1 AND NOT ({when}) AS {d}o"
    return f"""WITH RECURSIVE {ctes}, t AS (SELECT read, i, {t(3, "s")}, {t(6, "l")} FROM {sig} WINDOW {windows}),
    r AS (SELECT read, i, -1::BIGINT AS sa, 'inf'::DOUBLE AS sv, FALSE AS so, -1::BIGINT AS la, 'inf'::DOUBLE AS lv, FALSE AS lo, 0::BIGINT AS lm, []::BIGINT[] AS cuts FROM t WHERE i = 0
      UNION ALL SELECT read, i, sa, sv, so, {reset("l", "lp", "l")}, lm, CASE WHEN lp THEN list_append(cuts, la1) ELSE cuts END FROM
        (SELECT *, lh AND lo1 AND i - la1 > 3 AS lp FROM
          (SELECT *, {seen("l", "l", 9.0, "(lm < i)")} FROM
            (SELECT read, i, l, {reset("s", "sp", "s")}, CASE WHEN mute THEN -1 ELSE la END AS la, CASE WHEN mute THEN 'inf'::DOUBLE ELSE lv END AS lv, lo AND NOT mute AS lo,
                    CASE WHEN mute THEN sa1 + 3 ELSE lm END AS lm, CASE WHEN sp THEN list_append(cuts, sa1) ELSE cuts END AS cuts FROM
              (SELECT *, sh AND sv1 > 1.4 AS mute, sh AND so1 AND i - sa1 > 1 AS sp FROM
                (SELECT read, i, s, l, la, lv, lo, lm, cuts, {seen("s", "s", 1.4)} FROM
                  (SELECT r.* EXCLUDE (i), t.i, s, l FROM r JOIN t ON t.read = r.read AND t.i = r.i + 1))))))),
    c AS (SELECT read, unnest(list_distinct(list_append(arg_max(cuts, i), 0))) AS start FROM r GROUP BY read),
    p AS (SELECT read, start, lead(start, 1, 9223372036854775807) OVER o AS stop, row_number() OVER o - 1 AS event FROM c WINDOW o AS (PARTITION BY read ORDER BY start)),
    e AS (SELECT read, event, start, count(*) AS length, avg(x)::FLOAT::DOUBLE AS mean, stddev_pop(x)::FLOAT::DOUBLE AS stdv FROM p JOIN {sig} USING (read) WHERE i >= start AND i < stop GROUP BY read, event, start)"""


@query(f"{_events_sql(_SIG)} SELECT read AS read_id, event::INT AS event, start, length, round(mean, 3) + 0.0 AS mean, round(stdv, 3) + 0.0 AS stdv FROM e")
def event_detect(spark, sf_dir):
    """Both detectors over every read's signal."""
    out = sinks.event_rows(reads.detect_events(_reads(spark, sf_dir)))
    return out.select("read_id", "event", "start", F.col("length").cast("long").alias("length"), *[(F.round(F.col(c).cast("double"), 3) + 0.0).alias(c) for c in ("mean", "stdv")])


# ---- sequences ----------------------------------------------------------------------------------------------
_KMER = "list_sum(list_transform(range(0, 5), lambda j: (strpos('ACGT', substr(seq, (i + j)::BIGINT, 1)) - 1) * (4 ** (4 - j))::BIGINT))::INT"
_KMERS = f"{_SEQ}, k AS (SELECT doc_id, i, {_KMER} AS k FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - 3)) AS i FROM s))"
_OVER = "CASE " + " ".join(f"WHEN a % {4 ** (5 - o)} = b // {4**o} THEN {o}" for o in range(1, 5)) + " ELSE 5 END"


def _kmers(spark, sf_dir):
    """doc_id, states: never empty. Queries explode them by posexplode_outer, as the inner form filters by size first, for which the states are made twice."""
    return _sequences(spark, sf_dir).select("doc_id", Q.encode_kmers(F.col("seq"), 5).alias("states"))


@query(f"WITH {_KMERS} SELECT doc_id, i::INT AS i, k FROM k")
def kmer_encode(spark, sf_dir):
    return _kmers(spark, sf_dir).select("doc_id", F.posexplode_outer("states").alias("i", "k")).withColumn("i", F.col("i") + 1)


@query(f"WITH {_KMERS}, t AS (SELECT doc_id, i, k AS b, lag(k, 3) OVER (PARTITION BY doc_id ORDER BY i) AS a FROM k) SELECT doc_id, i::INT AS i, {_OVER} AS shift FROM t WHERE a IS NOT NULL")
def kmer_overlap(spark, sf_dir):
    """Every k-mer against the one three before it. Both come from one array, so nothing is shuffled."""
    pairs = lambda m: F.zip_with(F.slice(m, 1, F.greatest(F.size(m) - 3, F.lit(0))), F.slice(m, 4, F.size(m)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    k = _kmers(spark, sf_dir).select("doc_id", F.posexplode_outer(N.let(F.col("states"), pairs)).alias("i", "p")).select("doc_id", (F.col("i") + 4).alias("i"), "p.a", "p.b")
    return k.select("doc_id", "i", Q.overlap(F.col("a"), F.col("b"), 5).alias("shift"))


# A path through all k-mers, with a stay in place of each whose state is a multiple of three.
_PATHS = f"{_KMERS}, p AS (SELECT doc_id, i, k AS b, lag(k) OVER (PARTITION BY doc_id ORDER BY i) AS a, substr('ACGT', (k // 256) + 1, 1) || substr('ACGT', (k // 64) % 4 + 1, 1) || substr('ACGT', (k // 16) % 4 + 1, 1) || substr('ACGT', (k // 4) % 4 + 1, 1) || substr('ACGT', k % 4 + 1, 1) AS word FROM k WHERE k % 3 <> 0), q AS (SELECT *, CASE WHEN a IS NULL THEN 5 ELSE {_OVER} END AS o FROM p)"


def _path(states: Column) -> Column:
    return F.transform(states, lambda s: F.when(s % 3 != 0, s).otherwise(F.lit(-1)))


@query(f"WITH {_PATHS} SELECT doc_id, string_agg(right(word, o), '' ORDER BY i) AS bases, (sum(o) - 5)::INT AS last_pos FROM q GROUP BY doc_id")
def overlap_stitch(spark, sf_dir):
    bases, pos = Q.stitch(F.col("path"), 5)
    paths = _kmers(spark, sf_dir).select("doc_id", _path(F.col("states")).alias("path")).where(F.exists("path", lambda s: s >= 0))
    return paths.select("doc_id", bases.alias("bases"), F.array_max(pos).alias("last_pos"))


@query(f"WITH {_KMERS}, c AS (SELECT doc_id, i, k % 4 AS s, lag(k % 4, 1, -1) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k) SELECT doc_id, list(s ORDER BY i) AS states FROM c WHERE s <> before GROUP BY doc_id")
def ctc_collapse(spark, sf_dir):
    return _kmers(spark, sf_dir).select("doc_id", Q.ctc_collapse(F.transform("states", lambda s: s % 4)).alias("states"))


@query(f"WITH {_SEQ}, u AS (SELECT doc_id, i, substr(seq, i, 1) AS base FROM (SELECT doc_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM s)), j AS (SELECT *, CASE WHEN base = lag(base) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS cut FROM u), g AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM j) SELECT doc_id, min(i)::INT AS start, count(*) AS length, base FROM g GROUP BY doc_id, run, base HAVING count(*) >= 3")
def homopolymer_runs(spark, sf_dir):
    """Runs of three or more equal bases, as islands."""
    b = _sequences(spark, sf_dir).select("doc_id", F.posexplode(F.split("seq", "")).alias("i", "base")).where("base <> ''").withColumn("i", F.col("i") + 1)
    w = Window.partitionBy("doc_id").orderBy("i")
    b = b.withColumn("cut", F.when(F.col("base") == F.lag("base").over(w), 0).otherwise(1)).withColumn("run", F.sum("cut").over(w))
    return b.groupBy("doc_id", "run", "base").agg(F.min("i").alias("start"), F.count("*").alias("length")).where("length >= 3").select("doc_id", "start", "length", "base")


@query(f"WITH {_SEQ} SELECT doc_id, (strpos('ACGT', substr(seq, 1, 1)) - 1)::INT AS code, (4 ** length(substr(seq, 1, 6)))::BIGINT AS states, (floor(log2(length(seq)) / 2))::INT AS k, (length(seq) + 6) // 7 AS up, length(seq) // 7 AS down, (length(bin(length(seq))))::INT AS bits FROM s")
def sequence_numbers(spark, sf_dir):
    n = F.length("seq")
    return _sequences(spark, sf_dir).select(
        "doc_id", Q.base_to_int(F.substring("seq", 1, 1)).cast("int").alias("code"), Q.four_to(F.length(F.substring("seq", 1, 6))).alias("states"),
        Q.kmer_length(n).alias("k"), N.ceil_div(n, F.lit(7)).alias("up"), N.floor_div(n, F.lit(7)).alias("down"), Q.highest_bit(n).alias("bits"),
    )


@query(f"WITH {_KMERS} SELECT doc_id, i::INT AS i FROM k WHERE k IN (0, 341, 682, 1023)")
def homopolymer_kmers(spark, sf_dir):
    k = _kmers(spark, sf_dir).select("doc_id", F.posexplode_outer("states").alias("i", "k")).withColumn("i", F.col("i") + 1)
    return k.where(Q.is_homopolymer(F.col("k"), 5)).select("doc_id", "i")


@query("SELECT event_id, (CASE WHEN value >= 0 THEN floor((value - 1.5) / 7.25 + 0.5) END)::INT AS bases FROM events WHERE value >= 1.5")
def calibrated_dwell(spark, sf_dir):
    ev = _table(spark, sf_dir, "events").where("value >= 1.5")
    return ev.select("event_id", Q.calibrated_dwell(F.col("value"), F.lit(1.5), F.lit(7.25)).alias("bases"))


# ---- matrices -----------------------------------------------------------------------------------------------
_W = [[round(0.01 * ((7 * i + 3 * j) % 11 - 5), 4) for j in range(64)] for i in range(5)]
_B = [0.1, -0.2, 0.3, 0.0, 0.05]
_AFFINE = f"{_blocks_sql()}, a AS (SELECT read_id, block, [" + ", ".join(f"list_dot_product(v, {w}::DOUBLE[]) + {b}" for w, b in zip(_W, _B, strict=True)) + "] AS z FROM b)"


def _cells(df: DataFrame, m: str, name: str = "y") -> DataFrame:
    """read_id, block, row, y."""
    out = df.select("read_id", F.posexplode(m).alias("block", "v")).select("read_id", "block", F.posexplode("v").alias("row", "y"))
    return out.select("read_id", F.col("block").cast("long").alias("block"), F.col("row").cast("long").alias("row"), r6("y").alias(name))


def _cells_sql(table: str, column: str) -> str:
    return f"SELECT read_id, block, unnest(range(0, len({column}))) AS row, round(unnest({column}), 6) + 0.0 AS y FROM {table}"


@query(f"WITH {_AFFINE} {_cells_sql('a', 'z')}")
def affine(spark, sf_dir):
    return _cells(_matrices(spark, sf_dir).withColumn("z", M.affine("m", _W, _B)), "z")


@query(f"WITH {_AFFINE}, e AS (SELECT read_id, block, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM a), p AS (SELECT read_id, block, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e) {_cells_sql('p', 'p')}")
def softmax(spark, sf_dir):
    return _cells(_matrices(spark, sf_dir).withColumn("z", M.affine("m", _W, _B)).withColumn("p", M.softmax("z")), "p")


@query(f"WITH {_AFFINE}, d AS (SELECT read_id, block, unnest(range(0, 5)) AS row, unnest(z) AS z FROM a) SELECT read_id, block, row, round(tanh(z), 6) + 0.0 AS t, round(exp(z), 6) + 0.0 AS e FROM d")
def dense_layers(spark, sf_dir):
    m = _matrices(spark, sf_dir).select("read_id", M.tanh_dense(F.col("m"), _W, _B).alias("t"), M.exp_dense(F.col("m"), _W, _B).alias("e"))
    return _cells(m, "t", "t").join(_cells(m, "e", "e"), ["read_id", "block", "row"])


@query(f"WITH {_AFFINE}, e AS (SELECT read_id, block, list_transform(z, lambda x: exp(x / 2)) AS e FROM a), p AS (SELECT read_id, block, list_transform(e, lambda x: ln(0.001 + 0.999 * x / list_sum(e))) AS p FROM e) {_cells_sql('p', 'p')}")
def robust_log(spark, sf_dir):
    """A softmax at temperature two, robustly logged."""
    w, b = [[x / 2 for x in row] for row in _W], [x / 2 for x in _B]
    return _cells(_matrices(spark, sf_dir).withColumn("z", M.affine("m", w, b)).withColumn("p", M.robust_log(M.softmax("z"), 0.001)), "p")


@query(f"WITH {_AFFINE} SELECT read_id, list(CASE WHEN list_position(z, list_max(z)) = 5 THEN -1 ELSE list_position(z, list_max(z)) - 1 END ORDER BY block)::INT[] AS path, round(sum(list_max(z)), 6) + 0.0 AS score FROM a GROUP BY read_id")
def argmax_decode(spark, sf_dir):
    path, score = M.argmax_decode(F.col("z"))
    return _matrices(spark, sf_dir).withColumn("z", M.affine("m", _W, _B)).select("read_id", path.alias("path"), r6(score).alias("score"))


@query(f"WITH {_blocks_sql()}, p AS (SELECT read_id, block, list_transform(v, lambda x: abs(x) / list_sum(list_transform(v, lambda y: abs(y)))) AS p FROM b) {_cells_sql('p', 'p')}")
def column_normalise(spark, sf_dir):
    return _cells(_matrices(spark, sf_dir).withColumn("p", M.normalise(M.each("m", F.abs))), "p")


_ACT = {"tanh": ("tanh(y)", F.tanh), "exp": ("exp(y)", F.exp), "elu": ("CASE WHEN y >= 0 THEN y ELSE exp(y) - 1 END", N.elu), "logistic": ("1 / (1 + exp(-y))", N.logistic)}


@query(f"WITH {_blocks_sql()}, c AS (SELECT read_id, block, unnest(range(0, {WIDTH})) AS row, unnest(v) AS y FROM b) SELECT read_id, block, row, " + ", ".join(f"round({s}, 6) + 0.0 AS {k}" for k, (s, _) in _ACT.items()) + " FROM c")
def activations(spark, sf_dir):
    out = _matrices(spark, sf_dir).select("read_id", F.posexplode("m").alias("block", "v")).select("read_id", F.col("block").cast("long").alias("block"), F.posexplode("v").alias("row", "y"))
    return out.select("read_id", "block", F.col("row").cast("long").alias("row"), *[r6(f(F.col("y"))).alias(k) for k, (_, f) in _ACT.items()])


@query(f"WITH {_blocks_sql()}, f AS (SELECT read_id, flatten(list(v ORDER BY block)) AS f FROM b GROUP BY read_id) SELECT read_id, round(list_max(f), 6) AS hi, round(list_min(f), 6) AS lo, (list_position(f, list_max(f)) - 1)::INT AS at_hi, (list_position(f, list_min(f)) - 1)::INT AS at_lo, len(f)::INT AS n FROM f")
def matrix_extremes(spark, sf_dir):
    m = F.col("m")
    return _matrices(spark, sf_dir).select("read_id", F.round(M.maximum(m), 6).alias("hi"), F.round(M.minimum(m), 6).alias("lo"), M.argmax(m).alias("at_hi"), M.argmin(m).alias("at_lo"), F.size(M.to_array(m)).alias("n"))


@query(f"WITH {_blocks_sql()}, c AS (SELECT read_id, block, unnest(range(0, {WIDTH})) AS row, unnest(v) AS y FROM b), d AS (SELECT read_id, block, row, (coalesce(lead(y) OVER (PARTITION BY read_id, row ORDER BY block) - y, 0.5) - 0.25) / 2 AS y FROM c) SELECT read_id, block, row, round(CASE WHEN abs(greatest(-0.4, least(0.4, y))) > 0.3 THEN 0 ELSE greatest(-0.4, least(0.4, y)) END, 6) + 0.0 AS y FROM d")
def matrix_transforms(spark, sf_dir):
    """Difference across blocks, shift and scale, clip, filter."""
    m = M.filter_large(M.clip(M.shift_scale(M.difference(F.col("m"), 0.5), 0.25, 2.0), 0.4), 0.3)
    return _cells(_matrices(spark, sf_dir).select("read_id", m.alias("y")), "y")


def _stacked_sql() -> str:
    zero = f"list_transform(range(0, {WIDTH}), lambda i: 0.0::DOUBLE)"
    return f"{_blocks_sql()}, w AS (SELECT read_id, block, coalesce(lag(v) OVER o, {zero}) || v || coalesce(lead(v) OVER o, {zero}) AS y FROM b WINDOW o AS (PARTITION BY read_id ORDER BY block))"


@query(f"WITH {_stacked_sql()} {_cells_sql('w', 'y')}")
def window_stack(spark, sf_dir):
    return _cells(_matrices(spark, sf_dir).select("read_id", M.window(F.col("m"), 3).alias("y")), "y")


@query(f"WITH {_stacked_sql()}, r AS (SELECT read_id, block, list_transform(range(1, {WIDTH} + 1), lambda k: y[k + {WIDTH}] + tanh(y[k] - y[k + 2 * {WIDTH}])) AS y FROM w) {_cells_sql('r', 'y')}")
def residual(spark, sf_dir):
    """The input plus a tanh of the difference of its neighbours."""
    w = F.transform(M.window(F.col("m"), 3), lambda b: F.zip_with(F.slice(b, 1, WIDTH), F.slice(b, 2 * WIDTH + 1, WIDTH), lambda p, q: F.tanh(p - q)))
    return _cells(_matrices(spark, sf_dir).select("read_id", M.residual(F.col("m"), w).alias("y")), "y")


_FILTER = (0.5, -1.0, 2.0, 0.25)


@query(f"WITH {_SIG}, c AS (SELECT read, i, " + " + ".join(f"{f} * coalesce({'lag' if k < 1 else 'lead'}(x, {abs(k - 1)}) OVER (PARTITION BY read ORDER BY i), 0)" for k, f in enumerate(_FILTER)) + " AS y FROM sig) SELECT read, i // 2 AS block, round(y, 6) + 0.0 AS y FROM c WHERE i % 2 = 0")
def conv1d(spark, sf_dir):
    """A filter of four samples at a stride of two, zero beyond the ends."""
    import numpy as np

    w = np.array(_FILTER)[None, :, None]
    out = reads.per_read(_reads(spark, sf_dir).select("read_id", "signal"), lambda x: (layers.convolve(x[:, None], w, np.zeros(1), 2)[:, 0],), ["signal"], "y array<double>")
    return out.select(F.col("read_id").alias("read"), F.posexplode("y").alias("block", "y")).select("read", F.col("block").cast("long").alias("block"), r6("y").alias("y"))


@query("SELECT doc_id, list_transform(string_split(regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g'), ''), lambda c: round([1.0, -1.0, 0.5, -0.5][strpos('ACGT', c)], 6)) AS v FROM documents WHERE length(regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g')) >= 10")
def embedding_lookup(spark, sf_dir):
    states = Q.encode_kmers(F.col("seq"), 1)
    return _sequences(spark, sf_dir).select("doc_id", F.transform(M.embedding(states, [[1.0], [-1.0], [0.5], [-0.5]]), lambda v: F.get(v, F.lit(0))).alias("v"))


# ---- dynamic programs ---------------------------------------------------------------------------------------
def _crf_sql(inner: str, outer: str, name: str) -> str:
    to = lambda t: "[" + ", ".join(f"v[{4 * t + f + 1}] + s[{f + 1}]" for f in range(4)) + "]"
    step = "[" + ", ".join(inner.format(a=to(t)) for t in range(4)) + "]"
    return f"""WITH RECURSIVE {_blocks_sql(16)}, r AS (SELECT read_id, -1::BIGINT AS block, [0.0::DOUBLE, 0, 0, 0] AS s FROM b GROUP BY read_id
    UNION ALL SELECT b.read_id, b.block, {step} FROM r JOIN b ON b.read_id = r.read_id AND b.block = r.block + 1), e AS (SELECT read_id, max(block) AS block FROM b GROUP BY read_id)
    SELECT read_id, round({outer.format(a="s")}, 6) + 0.0 AS {name} FROM r JOIN e USING (read_id, block)"""




@query(_crf_sql("(SELECT ln(sum(exp(x - m))) + any_value(m) FROM (SELECT unnest({a}) AS x, list_max({a}) AS m))", "ln(list_sum(list_transform({a}, lambda x: exp(x - list_max({a}))))) + list_max({a})", "log_z"))
def crf_partition(spark, sf_dir):
    return _matrices(spark, sf_dir, 16).select("read_id", r6(M.crf_partition(F.col("m"), 4)).alias("log_z"))


@query(_crf_sql("list_max({a})", "list_max({a})", "score"))
def crf_viterbi(spark, sf_dir):
    """A label's stretches are scored side by side."""
    out = reads.crf_stretches(_table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", WIDTH, 4)
    return out.select(F.col("label").alias("read_id"), r6(M.crf_score(F.col("m"), 4)).alias("score"))


_LSE = "ln(list_sum(list_transform({a}, lambda x: exp(x - list_max({a}))))) + list_max({a})"


def _weights(outputs: int) -> tuple[list[list[float]], list[float]]:
    """Fixed weights from a vector to so many outputs."""
    return [[round(0.02 * ((5 * i + 3 * j + i * j) % 13 - 6), 4) for j in range(WIDTH)] for i in range(outputs)], [round(0.1 * ((7 * i) % 5 - 2), 4) for i in range(outputs)]


def _scores(spark, sf_dir, outputs: int) -> DataFrame:
    """read_id, post: blocks of so many scores, each from a whole vector."""
    return _matrices(spark, sf_dir).select("read_id", M.affine(F.col("m"), *_weights(outputs)).alias("post"))


def _scores_sql(outputs: int) -> str:
    z = ", ".join(f"list_dot_product(v, {w}::DOUBLE[]) + {b}" for w, b in zip(*_weights(outputs), strict=True))
    return f"{_blocks_sql()}, a AS (SELECT read_id, block, [{z}] AS z FROM b), e AS (SELECT read_id, max(block) AS last FROM b GROUP BY read_id)"


_CRF = f"""WITH RECURSIVE {_scores_sql(25)},
    best AS (SELECT read_id, -1::BIGINT AS block, [0.0::DOUBLE, 0, 0, 0, 0] AS s, [[0], [1], [2], [3], [4]] AS paths FROM e
      UNION ALL SELECT read_id, block, list_transform(c, lambda x: list_max(x)), list_transform(range(1, 6), lambda t: list_append(paths[list_position(c[t], list_max(c[t]))], (t - 1)::INT)) FROM
        (SELECT a.read_id, a.block, paths, list_transform(range(0, 5), lambda t: list_transform(range(1, 6), lambda f: z[5 * t + f] + s[f])) AS c FROM best JOIN a ON a.read_id = best.read_id AND a.block = best.block + 1)),
    fwd AS (SELECT read_id, -1::BIGINT AS block, [0.0::DOUBLE, 0, 0, 0, 0] AS s FROM e
      UNION ALL SELECT read_id, block, list_transform(c, lambda y: {_LSE.format(a="y")}) FROM
        (SELECT a.read_id, a.block, list_transform(range(0, 5), lambda t: list_transform(range(1, 6), lambda f: z[5 * t + f] + s[f])) AS c FROM fwd JOIN a ON a.read_id = fwd.read_id AND a.block = fwd.block + 1)),
    bwd AS (SELECT read_id, last AS block, [0.0::DOUBLE, 0, 0, 0, 0] AS s FROM e
      UNION ALL SELECT read_id, block - 1, list_transform(c, lambda y: {_LSE.format(a="y")}) FROM
        (SELECT a.read_id, a.block, list_transform(range(1, 6), lambda f: list_transform(range(0, 5), lambda t: z[5 * t + f] + s[t + 1])) AS c FROM bwd JOIN a ON a.read_id = bwd.read_id AND a.block = bwd.block)),
    path AS (SELECT read_id, list_max(s) AS score, paths[list_position(s, list_max(s))] AS path FROM best JOIN e USING (read_id) WHERE block = last)"""


@query(f"""{_CRF} SELECT read_id, round(score, 6) + 0.0 AS score, path, array_to_string(list_transform(list_filter(path[1:len(path) - 1], lambda p: p < 4), lambda p: substr('ACGT', p + 1, 1)), '') AS bases,
    list_transform(list_filter(range(0, len(path) - 1), lambda i: path[i + 1] < 4), lambda i: i::INT) AS pos FROM path""")
def crf_decode(spark, sf_dir):
    """Best path through five states, its bases and their places; a block's 25 transition scores come from a whole vector."""
    return reads.decode_crf(_scores(spark, sf_dir, 25)).select("read_id", r6("score").alias("score"), "path", "bases", "pos")


@query(f"""{_CRF}, t AS (SELECT fwd.read_id, fwd.block + 1 AS block, list_transform(range(1, 6), lambda i: fwd.s[i] + bwd.s[i]) AS s FROM fwd JOIN bwd ON fwd.read_id = bwd.read_id AND fwd.block = bwd.block),
    p AS (SELECT read_id, block, list_transform(s, lambda x: exp(x - ({_LSE.format(a="s")}))) AS p FROM t) {_cells_sql('p', 'p')}""")
def crf_posterior(spark, sf_dir):
    """Probabilities of the five states before, between and after blocks."""
    return _cells(reads.crf_posterior(_scores(spark, sf_dir, 25)), "base_probs")


_TARGET = [0, 1, 2, 3, 1, 0, 2]


def _map_sql(pick: str, live: str = "TRUE") -> str:
    n = len(_TARGET)
    low = "-1e30::DOUBLE"
    options = f"[s[p] + z[5] - 0.5, CASE WHEN p > 1 THEN s[p - 1] ELSE {low} END + emit[p], CASE WHEN p > 2 THEN s[p - 2] ELSE {low} END - 0.75 + emit[p], CASE WHEN p = 1 THEN start + emit[1] ELSE {low} END]"
    return f"""WITH RECURSIVE {_scores_sql(5)}, r AS (SELECT read_id, -1::BIGINT AS block, list_transform(range(0, {n}), lambda p: {low}) AS s, 0.0::DOUBLE AS start, {low} AS "end" FROM e
      UNION ALL SELECT read_id, block, list_transform(range(1, {n + 1}), lambda p: CASE WHEN {live} THEN {pick.format(a="c[p]")} ELSE {low} END), start + greatest(-4.0, z[5]), {pick.format(a="outs")} FROM
        (SELECT *, list_transform(range(1, {n + 1}), lambda p: {options}) AS c, ["end" + greatest(-4.0, z[5]), s[{n}] - 4.0] AS outs FROM
          (SELECT a.read_id, a.block, e.last + 1 AS blocks, z, s, start, "end", list_transform({_TARGET}, lambda q: z[q + 1]) AS emit FROM r JOIN a ON a.read_id = r.read_id AND a.block = r.block + 1 JOIN e ON e.read_id = r.read_id))),
    f AS (SELECT r.read_id, [s[{n}], "end"] AS ends FROM r JOIN e ON r.read_id = e.read_id AND r.block = e.last) SELECT read_id, round({pick.format(a="ends")}, 6) + 0.0 AS score FROM f"""


#: Positions of a band three either side of the diagonal, as in mapping.diagonal_bands.
_BAND = f"(p - 1 >= CASE WHEN block = 0 THEN 0 ELSE greatest(0, least({len(_TARGET) - 1}, floor(block * {len(_TARGET)} / blocks - 3))) END AND p - 1 < CASE WHEN block = blocks - 1 THEN {len(_TARGET)} ELSE greatest(1, least({len(_TARGET)}, ceil(block * {len(_TARGET)} / blocks + 3) + 1)) END)"


def _map(spark, sf_dir, **opts) -> DataFrame:
    df = _scores(spark, sf_dir, 5).withColumn("states", F.lit(_TARGET).cast("array<int>"))
    return reads.map_post_to_sequence(df, 0.5, 0.75, 4.0, **opts).select("read_id", r6("map_score").alias("score"))


@query(_map_sql("list_max({a})"))
def map_viterbi(spark, sf_dir):
    """The best way of a read's blocks through seven states; scores of four states and the stay come from whole vectors."""
    return _map(spark, sf_dir)


@query(_map_sql(_LSE))
def map_forward(spark, sf_dir):
    """All ways of them."""
    return _map(spark, sf_dir, forward=True)


@query(_map_sql("list_max({a})", _BAND))
def map_viterbi_banded(spark, sf_dir):
    return _map(spark, sf_dir, band=3)


@query(_map_sql(_LSE, _BAND))
def map_forward_banded(spark, sf_dir):
    return _map(spark, sf_dir, forward=True, band=3)


_SQUIGGLE = ((-1.2, -0.5, 0.2), (0.4, -0.3, -0.4), (-0.6, -0.8, 0.5), (1.5, 0.1, -0.1))
_MATCH = {"back_probability": 0.1, "local_penalty": 2.0, "skip_penalty": 1.0}


def _match_sql(forward: bool) -> str:
    """States by number: a start, the squiggle's positions, an end, then a rear state a position. Each lists its ways in, preferred ones first."""
    n, ways, labels = len(_SQUIGGLE), {}, [-1, *range(len(_SQUIGGLE)), -1, *range(len(_SQUIGGLE))]
    move = [0.9 / (1 + math.exp(-q)) for *_, q in _SQUIGGLE]
    stay = [math.log(0.9 - m) for m in move]
    move = [math.log(m) for m in move]
    move, stay = ([sum(x) / n, *x, sum(x) / n] for x in (move, stay))
    for k in range(n + 2):
        ways[k] = [(k, stay[k])] + [(k - 1, move[k - 1])] * (k > 0) + [(k - 2, move[k - 2] - 1.0)] * (k > 1)
        if 2 <= k <= n:
            ways[k] += [(0, move[0] - 2.0 * (k - 1)), (n + k, math.log(0.5))]
        elif k == n + 1:
            ways[k] += [(j, move[j] - 2.0 * (n - j)) for j in range(1, n)]
    for k in range(n):
        ways[n + 2 + k] = [(n + 2 + k, math.log(0.5))] + [(k + 2, math.log(0.1))] * (k < n - 1)
    options = ", ".join("[" + ", ".join(f"f[{a + 1}] + {c!r}::DOUBLE" for a, c in w) + "]" for w in ways.values())
    sources = ", ".join("[" + ", ".join(str(a + 1) for a, _ in w) + "]" for w in ways.values())
    emits = [f"greatest(-5.0, -abs(x - {loc!r}) / {math.exp(scale)!r} - {scale!r} - ln(2))" for loc, scale, _ in _SQUIGGLE]
    emits = ["-2.0", *emits, "-2.0", *emits]
    best = _LSE.format(a="o[j]") if forward else "list_max(o[j])"
    path = "NULL" if forward else f"list_transform(range(1, {2 * n + 3}), lambda j: list_append(w[src[j][list_position(o[j], list_max(o[j]))]], {labels}[j]))"
    empty = "NULL" if forward else "[" + ", ".join(["[]::INT[]"] * (2 * n + 2)) + "]"
    ends = f"f[{n + 1}]", f"f[{n + 2}]"
    result = f"greatest({ends[0]}, {ends[1]}) + ln(1 + exp(-abs({ends[0]} - {ends[1]})))" if forward else f"greatest({ends[0]}, {ends[1]})"
    return f"""WITH RECURSIVE {_SIG}, v AS (SELECT read, i, (x - 100) / 60 AS x FROM sig),
    r AS (SELECT DISTINCT read, -1::BIGINT AS i, [0.0::DOUBLE, {", ".join(["-1e30"] * (2 * n + 1))}] AS f, {empty} AS w FROM v
      UNION ALL SELECT read, i, list_transform(range(1, {2 * n + 3}), lambda j: {best} + e[j]), {path} FROM
        (SELECT v.read, v.i, w, [{options}] AS o, [{sources}] AS src, [{", ".join(emits)}] AS e FROM r JOIN v ON v.read = r.read AND v.i = r.i + 1))
    SELECT read AS read_id, round({result}, 5) + 0.0 AS score{"" if forward else f", CASE WHEN {ends[0]} > {ends[1]} THEN w[{n + 1}] ELSE w[{n + 2}] END AS path"}
    FROM r QUALIFY row_number() OVER (PARTITION BY read ORDER BY i DESC) = 1"""


def _match(spark, sf_dir, **opts) -> DataFrame:
    squiggle = F.array(*[F.array(*map(F.lit, row)) for row in _SQUIGGLE])
    df = _reads(spark, sf_dir).withColumns({"normalised": F.transform("signal", lambda x: (x - 100) / 60), "squiggle": squiggle})
    return reads.map_signal_to_squiggle(df, **_MATCH, **opts).select("read_id", (F.round("map_score", 5) + 0.0).alias("score"), F.col("map_path").alias("path"))


@query(_match_sql(False))
def squiggle_viterbi(spark, sf_dir):
    """The best way of a whole signal through a squiggle of four positions, with skips, clipped ends and falls back."""
    return _match(spark, sf_dir)


@query(_match_sql(True))
def squiggle_forward(spark, sf_dir):
    return _match(spark, sf_dir, forward=True).drop("path")


def _transducer_sql() -> str:
    """States 1 to 16 are k-mers of two bases, 17 the start, 18 the end. Each carries its path; stays are -1, entries at an end too."""
    return f"""WITH RECURSIVE {_scores_sql(17)},
    r AS (SELECT read_id, -1::BIGINT AS block, list_transform(range(1, 19), lambda j: CASE WHEN j = 17 THEN 0.0 ELSE -1e30 END::DOUBLE) AS s, list_transform(range(1, 19), lambda j: [-1]) AS paths FROM e
      UNION ALL SELECT read_id, block,
        list_transform(range(1, 19), lambda j: CASE WHEN j <= 16 THEN list_max(o[j]) WHEN j = 17 THEN s[17] + wait ELSE greatest(s[18] + wait, list_max(s[1:16]) - 3.0) END),
        list_transform(range(1, 19), lambda j: CASE WHEN j <= 16 THEN list_append(paths[w[j]], CASE WHEN list_position(o[j], list_max(o[j])) = 1 THEN -1 ELSE j - 1 END::INT)
          WHEN j = 17 OR s[18] + wait >= list_max(s[1:16]) - 3.0 THEN list_append(paths[j], -1) ELSE list_append(paths[list_position(s, list_max(s[1:16]))], -1) END) FROM
        (SELECT *, list_transform(range(1, 17), lambda j: [j, list_position(one[j], list_max(one[j])) * 4 - 4 + (j - 1) // 4 + 1, list_position(s, list_max(s[1:16])), 17][list_position(o[j], list_max(o[j]))]) AS w FROM
          (SELECT *, list_transform(range(1, 17), lambda j: [s[j] + z[17] - 0.3, list_max(one[j]) + z[j], list_max(s[1:16]) - 0.4 + z[j], s[17] + z[j]]) AS o FROM
            (SELECT a.read_id, a.block, z, s, paths, greatest(-3.0, z[17] - 0.3) AS wait, list_transform(range(1, 17), lambda j: list_transform(range(0, 4), lambda l: s[4 * l + (j - 1) // 4 + 1])) AS one
             FROM r JOIN a ON a.read_id = r.read_id AND a.block = r.block + 1)))),
    f AS (SELECT read_id, s, paths[list_position(s, list_max(s))] AS path FROM r JOIN e USING (read_id) WHERE block = last)
    SELECT read_id, round(list_max(s), 6) + 0.0 AS score, list_transform(path, lambda x: x::INT) AS path FROM f"""


@query(_transducer_sql())
def transducer_path(spark, sf_dir):
    """The best path through 16 k-mer states and stays, ends clipped; scores come from whole vectors."""
    out = reads.decode_transducer(_scores(spark, sf_dir, 17), 0.3, 0.4, 3.0)
    return out.select("read_id", r6("score").alias("score"), "path")


@query("""WITH v AS (SELECT label AS read_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
    b AS (SELECT read_id, i, n, CASE WHEN read_id % 7 = 1 AND i = 0 THEN 1 WHEN read_id % 7 = 2 AND i = 5 THEN 2 ELSE least(i, n - 2) END AS low,
                 CASE WHEN read_id % 7 = 3 AND i = 6 THEN 6 WHEN read_id % 7 = 4 THEN least(i + 2, n - 1) WHEN read_id % 7 = 5 AND i = 4 THEN n + 1 ELSE least(i + 2, n) END AS high FROM v),
    w AS (SELECT read_id, low < high AND high <= n AND (i > 0 OR low = 0) AND (i < n - 1 OR high = n) AND (i = 0 OR low >= lag(low) OVER o AND high >= lag(high) OVER o AND low <= lag(high) OVER o) AS ok
          FROM b WINDOW o AS (PARTITION BY read_id ORDER BY i))
    SELECT read_id, bool_and(ok) AS sane FROM w GROUP BY read_id""")
def bands_sane(spark, sf_dir):
    """Bands [0, 2), [1, 3), ... up to the number of vectors, of which some labels' are spoilt in one of five ways."""
    w = Window.partitionBy("label").orderBy("vec_id")
    v = _table(spark, sf_dir, "embeddings").select(F.col("label").alias("read_id"), (F.row_number().over(w) - 1).alias("block"), F.count("*").over(Window.partitionBy("label")).alias("n"))
    kind, i, n = F.col("read_id") % 7, F.col("block"), F.col("n")
    low = F.when((kind == 1) & (i == 0), 1).when((kind == 2) & (i == 5), 2).otherwise(F.least(i, n - 2))
    high = F.when((kind == 3) & (i == 6), 6).when(kind == 4, F.least(i + 2, n - 1)).when((kind == 5) & (i == 4), n + 1).otherwise(F.least(i + 2, n))
    return S.bounds_sane(v.withColumns({"low": low, "high": high}), n, "read_id").select("read_id", "sane")


def _network(spark, sf_dir, model: str, states: int = 257, **opts) -> DataFrame:
    out = reads.normalise(reads.trim(_reads(spark, sf_dir), 3, 2, 10, 0.0).where("end > start")).where("normalised is not null")
    return reads.posterior(out, model, networks.random_parameters(model, states=states), **opts)


@query()
def transducer_viterbi(spark, sf_dir):
    out = reads.decode_transducer(_network(spark, sf_dir, "rgrgr_r94"), 0.1, 0.2, 50.0, homopolymer="mean")
    return out.select("read_id", F.round("score", 4).alias("score"), "bases", F.size("path").alias("n_path"))


@query()
def map_to_sequence(spark, sf_dir):
    out = _network(spark, sf_dir, "rgrgr_r941").withColumn("states", F.expr("transform(sequence(0, 5), i -> cast((i * 37 + read_id) % 256 as int))"))
    return reads.map_post_to_sequence(out).select("read_id", F.round("map_score", 4).alias("score"), F.size("map_path").alias("n"))


@query()
def squiggle_match(spark, sf_dir):
    out = reads.normalise(reads.trim(_reads(spark, sf_dir), 3, 2, 10, 0.0).where("end > start")).where("normalised is not null")
    out = out.withColumn("states", F.expr("transform(sequence(0, 9), i -> cast((i * 3 + read_id) % 4 as int))"))
    out = reads.squiggle(out, "squiggle_r94", networks.random_parameters("squiggle_r94"))
    return reads.map_signal_to_squiggle(out, back_probability=0.05).select("read_id", F.round("map_score", 4).alias("score"), F.size("map_path").alias("n"))


@query()
def networks_forward(spark, sf_dir):
    """Blocks and total probability under each basecalling network, with seeded parameters."""
    out = None
    for model in networks.RAW:
        df = _network(spark, sf_dir, model, log=False)
        df = df.select("read_id", F.lit(model).alias("model"), F.size("post").alias("blocks"), F.round(N.total(F.flatten("post")), 3).alias("mass"))
        out = df if out is None else out.unionByName(df)
    return out


@query()
def squiggle_predict(spark, sf_dir):
    seqs = _sequences(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), "seq")
    out = pipelines.predict_squiggle(seqs, networks.random_parameters("squiggle_r94"))
    return out.select("name", F.size("squiggle").alias("n"), F.round(N.total(F.flatten("squiggle")), 4).alias("total"))


@query()
def basecall_raw(spark, sf_dir):
    opts = pipelines.Options(model="rgrgr_r94", trim=(3, 2), segmentation=(10, 0.0), local_penalty=50.0)
    return sinks.fasta_raw(pipelines.basecall_raw(_reads(spark, sf_dir).withColumn("read_id", F.col("read_id").cast("string")), networks.random_parameters("rgrgr_r94", states=257), opts))


@query()
def basecall_events(spark, sf_dir):
    opts = pipelines.Options(trim=(3, 2), segmentation=(10, 0.0), local_penalty=50.0)
    return sinks.fasta_events(pipelines.basecall_events(_reads(spark, sf_dir).withColumn("read_id", F.col("read_id").cast("string")), networks.random_parameters("events", states=257), opts))


#: Signals without their quiet ends, as the catalog's commands trim them.
_VIEW = f"""{_SIG}, chunks AS (SELECT read, i // 10 AS chunk, x FROM sig), mid AS (SELECT read, chunk, median(x) AS med FROM chunks GROUP BY read, chunk HAVING count(*) = 10),
    mads AS (SELECT read, chunk, median(abs(x - med)) AS mad FROM chunks JOIN mid USING (read, chunk) GROUP BY read, chunk),
    loud AS (SELECT read, chunk FROM mads QUALIFY mad > min(mad) OVER (PARTITION BY read)), ends AS (SELECT read, min(chunk) * 10 + 3 AS first, max(chunk) * 10 + 8 AS beyond FROM loud GROUP BY read),
    view AS (SELECT read, i - first AS i, x FROM sig JOIN ends USING (read) WHERE i >= first AND i < beyond)"""
_FIXED = "printf('%.6f', round({0} * 1000000) / 1000000)"


@query(
    f"""{_events_sql(_VIEW, "view")} SELECT '#' || read AS value FROM e WHERE event = 0 UNION ALL SELECT concat_ws(chr(9), 'event', 'start', 'mean', 'stdv', 'dwell') FROM e WHERE event = 0
    UNION ALL SELECT concat_ws(chr(9), event, start, {_FIXED.format("mean")}, {_FIXED.format("stdv")}, length) FROM e"""
)
def event_table(spark, sf_dir):
    opts = pipelines.Options(trim=(3, 2), segmentation=(10, 0.0))
    return sinks.event_tsv(pipelines.event_table(_reads(spark, sf_dir), opts))


@query()
def seqmappy(spark, sf_dir):
    opts = pipelines.Options(trim=(3, 2), segmentation=(10, 0.0), local_penalty=4.0)
    df = _reads(spark, sf_dir).withColumn("read_id", F.col("read_id").cast("string")).withColumn("seq", F.lit("ACGTTGCAACGT"))
    return sinks.seqmappy_tsv(pipelines.map_sequence(df, networks.random_parameters("rgrgr_r94", states=257), 4, opts))


@query()
def mappy(spark, sf_dir):
    opts = pipelines.Options(trim=(3, 2), segmentation=(10, 0.0))
    df = _reads(spark, sf_dir).withColumn("seq", F.lit("ACGTTGCAACGT"))
    return sinks.mappy_tsv(pipelines.map_signal(df, networks.random_parameters("squiggle_r94"), options=opts))


# ---- densities ----------------------------------------------------------------------------------------------
_LAP = "-abs(x) / 2.5 - ln(2.5) - ln(2)"
_Z = "(value - 100) / 60"
_DENS = {
    "log_laplace": _LAP, "laplace": f"exp({_LAP})", "by_loc": "sign(x) / 2.5", "by_scale": "(abs(x) / 2.5 - 1) / 2.5", "by_logscale": "abs(x) / 2.5 - 1",
    "d_loc": f"exp({_LAP}) * sign(x) / 2.5", "d_scale": f"exp({_LAP}) * (abs(x) / 2.5 - 1) / 2.5", "d_logscale": f"exp({_LAP}) * (abs(x) / 2.5 - 1)",
}


@query(f"SELECT event_id, {', '.join(f'round({v}, 6) + 0.0 AS {k}' for k, v in _DENS.items())} FROM (SELECT event_id, {_Z} AS x FROM events)")
def loglaplace(spark, sf_dir):
    x, loc, s = F.col("x"), F.lit(0.0), F.lit(2.5)
    fs = (N.log_laplace, N.laplace, N.log_laplace_by_loc, N.log_laplace_by_scale, N.log_laplace_by_logscale, N.laplace_by_loc, N.laplace_by_scale, N.laplace_by_logscale)
    return _table(spark, sf_dir, "events").select("event_id", ((F.col("value") - 100) / 60).alias("x")).select("event_id", *[r6(f(x, loc, s)).alias(k) for k, f in zip(_DENS, fs, strict=True)])


@query(f"SELECT event_id, round(1 / (1 + exp(-x)), 6) + 0.0 AS cdf, round(-ln(1 + exp(-x)), 6) + 0.0 AS log_cdf, round(1 / (1 + exp(-x)) * (1 - 1 / (1 + exp(-x))), 6) + 0.0 AS density, round(ln(p / (1 - p)), 6) + 0.0 AS quantile, round(ln(exp(x) + exp(p)), 6) + 0.0 AS lse, round(sin(x), 6) + 0.0 AS s, round(cos(x), 6) + 0.0 AS c FROM (SELECT event_id, {_Z} AS x, (value + 1) / 1000 AS p FROM events)")
def logistic_family(spark, sf_dir):
    x, p = F.col("x"), F.col("p")
    out = _table(spark, sf_dir, "events").select("event_id", ((F.col("value") - 100) / 60).alias("x"), ((F.col("value") + 1) / 1000).alias("p"))
    sc = N.sincos(x)
    return out.select("event_id", r6(N.logistic_cdf(x)).alias("cdf"), r6(N.log_logistic_cdf(x)).alias("log_cdf"), r6(N.logistic_density(x)).alias("density"), r6(N.logistic_quantile(p)).alias("quantile"), r6(N.log_sum_exp(x, p)).alias("lse"), r6(sc["sin"]).alias("s"), r6(sc["cos"]).alias("c"))


# ---- formats ------------------------------------------------------------------------------------------------
@query(f"""WITH {_SEQ} SELECT '>doc-' || doc_id || '  {{ "filename" : "doc-' || doc_id || '", "uuid" : "u' || doc_id || '", "normalised_score" : -1.500000,  "nevent" : ' || (2 * length(seq)) || ',  "sequence_length" : ' || length(seq) || ',  "events_per_base" : 2.000000 }}' || chr(10) || seq AS value FROM s""")
def fasta_json(spark, sf_dir):
    s = _sequences(spark, sf_dir)
    s = s.select(F.format_string("doc-%d", "doc_id").alias("read_id"), F.format_string("u%d", "doc_id").alias("uuid"), F.col("seq").alias("bases"), (2 * F.length("seq")).alias("nevent"))
    return sinks.fasta_events(s.withColumn("score", F.col("nevent") * 1.5))


@query(f"WITH {_SEQ} SELECT 'doc-' || doc_id || chr(9) || '4' || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9) || '*' || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9) || seq || chr(9) || '*' AS value FROM s")
def sam_lines(spark, sf_dir):
    return sinks.sam(_sequences(spark, sf_dir).select(F.col("doc_id").cast("string").alias("read_id"), F.col("seq").alias("bases")), "doc-")


@query("SELECT user_id || chr(9) || event_type || chr(9) || printf('%.2f', value) AS value FROM events")
def json_columns(spark, sf_dir):
    """Objects to lines of tab-separated columns, by the keys of a first object."""
    ev = _table(spark, sf_dir, "events")
    js = ev.select(F.to_json(F.struct("event_type", "user_id", F.format_string("%.2f", "value").alias("v"))).alias("value"))
    return sinks.json_tsv(readers.json_to_columns(js, '{"user_id": 0, "event_type": "", "v": ""}'))


@query(f"""WITH {_SIG}, p AS (SELECT read, i, x, CASE WHEN i < 2 THEN -1 ELSE i // 4 END AS pos FROM sig)
    SELECT read AS read_id, i::INT AS idx, round(x, 6) AS signal, pos::INT AS pos, CASE WHEN pos < 0 THEN 'N' ELSE substr('ACGTAC', (pos + 1)::BIGINT, 1) END AS base,
    CASE WHEN pos BETWEEN 0 AND 5 THEN 10.0 * (pos + 1) END AS current, CASE WHEN pos BETWEEN 0 AND 5 THEN 1.0 + pos END AS sd, CASE WHEN pos BETWEEN 0 AND 5 THEN 4.0 END AS dwell FROM p""")
def path_squiggle(spark, sf_dir):
    """Each sample's squiggle row; samples outside and positions beyond the squiggle's six have none."""
    rows = F.array(*[F.array(F.lit(10.0 * (k + 1)), F.lit(1.0 + k), F.lit(4.0)) for k in range(6)])
    df = _reads(spark, sf_dir).withColumns({"seq": F.lit("ACGTAC"), "squiggle": rows, "map_path": F.expr("transform(signal, (x, i) -> case when i < 2 then -1 else i div 4 end)")})
    return sinks.path_squiggle(df).select("read_id", "idx", r6("signal").alias("signal"), F.col("pos").cast("int").alias("pos"), "base", "current", "sd", "dwell")


# ---- recurrent layers ---------------------------------------------------------------------------------------
def _list(a) -> str:
    return "[" + ", ".join(_list(x) if getattr(x, "ndim", 0) else repr(float(x)) for x in a) + "]"


def _dots(w, b, v: str) -> str:
    return "[" + ", ".join(f"list_dot_product({v}, {_list(row)}::DOUBLE[]) + {float(x)!r}" for row, x in zip(w, b, strict=True)) + "]"


_GRU, _LSTM = networks.random_parameters("raw_r94"), networks.random_parameters("events")
_SIGMOID = "1 / (1 + exp(-({})))"


@query(
    f"""WITH RECURSIVE {_blocks_sql(8)}, x AS (SELECT read_id, block, {_dots(_GRU["gruF1_iW"], _GRU["gruF1_b"], "v")} AS x FROM b),
    k AS (SELECT {_list(_GRU["gruF1_sW"])}::DOUBLE[][] AS sw, {_list(_GRU["gruF1_sW2"])}::DOUBLE[][] AS sw2),
    r AS (SELECT DISTINCT read_id, -1::BIGINT AS block, list_transform(range(0, 8), lambda i: 0.0::DOUBLE) AS h FROM b
      UNION ALL SELECT read_id, block, list_transform(range(1, 9), lambda i: g[i] * h[i] + (1 - g[i]) * tanh(x[16 + i] + list_dot_product(sw2[i], rh))) FROM
        (SELECT *, list_transform(range(1, 9), lambda i: g[8 + i] * h[i]) AS rh FROM
          (SELECT x.read_id, x.block, x, h, sw2, list_transform(range(1, 17), lambda i: {_SIGMOID.format("x[i] + list_dot_product(sw[i], h)")}) AS g FROM r JOIN x ON x.read_id = r.read_id AND x.block = r.block + 1, k))),
    y AS (SELECT read_id, block, h FROM r WHERE block >= 0) {_cells_sql("y", "h")}"""
)
def gru(spark, sf_dir):
    """A vector is eight blocks of eight features."""
    p = _GRU
    out = reads.gru_vectors(_table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", WIDTH, (p["gruF1_iW"], p["gruF1_b"], p["gruF1_sW"], p["gruF1_sW2"]))
    out, size = out.select(F.col("label").alias("read_id"), "block", F.posexplode("h").alias("at", "y")), len(p["gruF1_sW2"])
    return out.select("read_id", (F.col("block") + F.floor(F.col("at") / size)).alias("block"), F.pmod("at", F.lit(size)).cast("long").alias("row"), r6("y").alias("y"))


@query(
    f"""WITH RECURSIVE {_blocks_sql(4)}, w AS (SELECT read_id, block, coalesce(lag(v) OVER o, [0.0::DOUBLE, 0, 0, 0]) || v || coalesce(lead(v) OVER o, [0.0::DOUBLE, 0, 0, 0]) AS v FROM b WINDOW o AS (PARTITION BY read_id ORDER BY block)),
    x AS (SELECT read_id, block, {_dots(_LSTM["lstmB1_iW"], _LSTM["lstmB1_b"], "v")} AS x FROM w), k AS (SELECT {_list(_LSTM["lstmB1_sW"])}::DOUBLE[][] AS sw, {_list(_LSTM["lstmB1_p"])}::DOUBLE[][] AS p),
    r AS (SELECT read_id, max(block) + 1 AS block, list_transform(range(0, 8), lambda i: 0.0::DOUBLE) AS h, list_transform(range(0, 8), lambda i: 0.0::DOUBLE) AS c FROM b GROUP BY read_id
      UNION ALL SELECT read_id, block, list_transform(range(1, 9), lambda i: {_SIGMOID.format("u[24 + i] + p[3][i] * d[i]")} * tanh(d[i])), d FROM
        (SELECT *, list_transform(range(1, 9), lambda i: {_SIGMOID.format("u[16 + i] + p[2][i] * c[i]")} * c[i] + {_SIGMOID.format("u[8 + i] + p[1][i] * c[i]")} * tanh(u[i])) AS d FROM
          (SELECT x.read_id, x.block, c, p, list_transform(range(1, 33), lambda i: x[i] + list_dot_product(sw[i], h)) AS u FROM r JOIN x ON x.read_id = r.read_id AND x.block = r.block - 1, k))),
    y AS (SELECT r.read_id, r.block, h FROM r JOIN b USING (read_id, block)) {_cells_sql("y", "h")}"""
)
def lstm(spark, sf_dir):
    """Backward; a vector is sixteen blocks of four features, in windows of three, as in the events network."""
    p = _LSTM
    run = lambda m: (layers.lstm(layers.window(m, 3), p["lstmB1_iW"], p["lstmB1_b"], p["lstmB1_sW"], p["lstmB1_p"], True),)
    return _cells(reads.per_read(_matrices(spark, sf_dir, 4), run, ["m"], "h array<array<double>>"), "h")
