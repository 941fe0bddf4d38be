"""Line dedup over levelled sorted runs of line hashes.

A store holds runs: tables of (h1, h2, n, last), bucketed and sorted by the line's 128-bit hash, with the line's number
of documents and largest document. A batch of documents becomes a sorted run of its own lines, which merge-anti-joins
the store's runs: the lines that no run holds are added to the store as a run, so a line is in one run only; those that
some run holds are kept apart as repeats, of which there are few. Once a level has more than ``FANOUT`` runs, they are
compacted into one run of the next level. Runs keep their buckets, so neither the anti-joins nor compaction deal them out
anew. The lines' totals are the runs' rows with their repeats added. All of it is DataFrame operations.

Cases: null or empty text is one empty line; lines under ``LEAST_CHARS`` code points (stripped) always stay; a
null doc_id takes no part and loses nothing; rows that repeat a doc_id count as one document and each keeps
or loses lines alike; an empty table gives an empty result; extra columns are ignored (dedup_lines) or kept
(drop_repeated_lines in the pipeline passes documents' columns on).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm._common import LEAST_FILES, Stage, narrow

LEAST_CHARS, LEAST_DOCS = 20, 3
BATCHES, FANOUT = 4, 2
#: A batch's lines for each bucket of a run, as far as the session's shuffle partitions go.
BUCKET_LINES = 20_000
KEY = ("h1", "h2")
_STRIP = "\x09\x0a\x0b\x0c\x0d\x20"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def folded(text: Column) -> Column:
    """A-Z lower-cased. For pure ASCII that is lower(), which is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(_STRIP))


def hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


def long_lines(text: Column) -> Column:
    """Hashes of the distinct keys of at least LEAST_CHARS code points. Keys are made distinct as strings, which Spark does by hashing."""
    keys = F.transform(lines_of(folded(text)), line_key)
    return F.transform(F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= LEAST_CHARS)), hashed)


class LineRuns:
    """The levelled store. ``add`` takes a batch's lines (h1, h2, doc); ``totals`` is (h1, h2, n, last).

    rows: about how many lines a batch has, where that is known; runs of few lines then have few buckets, each of which is a file.
    """

    def __init__(self, stage: Stage, fanout: int = FANOUT, rows: int | None = None):
        self.stage, self.fanout = stage, fanout
        self.most = self.buckets = int(stage.spark.conf.get("spark.sql.shuffle.partitions"))
        if rows is not None:
            self.buckets = min(self.most, max(LEAST_FILES, -(-rows // BUCKET_LINES)))
        self.levels: list[list[DataFrame]] = [[]]
        self.repeats: list[DataFrame] = []

    def _write(self, run: DataFrame) -> DataFrame:
        return self.stage.put_sorted(run.select(*KEY, "n", "last"), self.buckets, *KEY)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def fresh(self, own: DataFrame) -> DataFrame:
        """The rows of a sorted run whose lines no run of the store holds."""
        for r in self.runs():
            own = own.join(r.select(*KEY).hint("merge"), list(KEY), "left_anti")
        return own

    def known(self, own: DataFrame) -> DataFrame | None:
        """The other rows. A line is in one run only, so it is found once."""
        parts = [own.join(r.select(*KEY).hint("merge"), list(KEY), "left_semi") for r in self.runs()]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def add(self, lines: DataFrame) -> None:
        if self.buckets < self.most:  # a task a bucket, or each task would write a file for every bucket
            lines = lines.repartition(self.buckets, *KEY)
        own = self._write(lines.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc").alias("last")))
        known = self.known(own)
        if known is None:
            self.levels[0].append(own)
            return
        self.repeats.append(self.stage.put(known))
        self.levels[0].append(self._write(self.fresh(own)))
        self.stage.drop(own)
        for depth, level in enumerate(self.levels):
            if len(level) > self.fanout:
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(self._write(reduce(DataFrame.unionByName, level)))
                self.stage.drop(*level)
                level.clear()

    def totals(self) -> DataFrame:
        """One row a line: the run's row and what repeats add to it."""
        first = reduce(DataFrame.unionByName, self.runs())
        if not self.repeats:
            return first
        more = reduce(DataFrame.unionByName, self.repeats).groupBy(*KEY).agg(F.sum("n").alias("more"), F.max("last").alias("later"))
        both = first.join(more, list(KEY), "left")
        return both.select(*KEY, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("last", "later").alias("last"))

    def drop(self) -> None:
        self.stage.drop(*self.runs(), *self.repeats)


def repeated_lines(docs: DataFrame, stage: Stage, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc, drop): per document the sorted hashes of lines that it loses, an array of at most its own distinct lines."""
    ids = docs.where("doc_id is not null")
    lines = ids.select(F.col("doc_id").alias("doc"), F.explode(long_lines(F.col("text"))).alias("h")).select("doc", "h.h1", "h.h2")
    n, distinct = ids.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n != distinct:  # rows that repeat a doc_id count once
        lines = lines.distinct()
    lines = stage.put(lines.withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")), by="batch")
    store = LineRuns(stage, fanout, -(-lines.count() // batches))
    for k in range(batches):
        store.add(lines.where(F.col("batch") == k))
    # Written, so that the join reads it as it is: a frequent line's rows can then be split among tasks.
    common = stage.put(store.totals().where(F.col("n") >= LEAST_DOCS).select(*KEY, F.col("last").alias("last_doc")))
    store.drop()
    lost = lines.join(common, list(KEY)).where("doc != last_doc")
    out = stage.put(lost.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*KEY))).alias("drop")))
    stage.drop(lines, common)
    return out


def _within(ordered: Column, x: Column) -> Column:
    """Whether a sorted array holds x, by halving: the number of entries under x grows by the powers of two that fit."""
    n = F.size(ordered)
    powers = F.transform(F.sequence(F.ceil(F.log2(n)).cast("int"), F.lit(0), F.lit(-1)), lambda e: F.pow(F.lit(2.0), e).cast("int"))
    under = F.aggregate(powers, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(ordered, at + step - 1) < x), at + step).otherwise(at))
    return F.coalesce(F.get(ordered, under) == x, F.lit(False))


def kept_text(text: Column, drop: Column) -> Column:
    """The lines whose hash is not in drop, a sorted array; each line costs the logarithm of the array's size."""
    lines = lines_of(text)
    short = lambda key: F.char_length(key) < LEAST_CHARS
    hashes = F.transform(F.transform(lines_of(folded(text)), line_key), lambda key: F.when(~short(key), hashed(key)))
    return F.filter(F.zip_with(lines, hashes, lambda line, h: F.when(h.isNull() | ~_within(drop, h), line)), lambda line: line.isNotNull())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (what stays), and the columns in ``keep``: one row for each row of docs."""
    stage = Stage(docs.sparkSession, "lines")
    own = {f"_keep{i}": c for i, c in enumerate(keep) if c not in (id_col, text_col)}
    drops = repeated_lines(narrow(docs, doc_id=id_col, text=text_col), stage)
    rows = narrow(docs, doc_id=id_col, text=text_col, **own)
    out = rows.join(drops, F.col("doc_id") == F.col("doc"), "left")
    stay = F.when(F.col("drop").isNotNull(), kept_text(F.col("text"), F.col("drop")))
    out = out.select("doc_id", "text", *own, F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), stay.alias("stay"))
    dropped = F.when(F.col("stay").isNotNull(), F.col("n_lines") - F.size("stay")).otherwise(F.lit(0)).cast("long")
    text = F.when(F.col("stay").isNotNull(), F.array_join("stay", "\n")).otherwise(F.coalesce("text", F.lit("")))
    return out.select("doc_id", *[F.col(k).alias(c) for k, c in own.items()], "n_lines", dropped.alias("n_dropped"), text.alias("text"))
