"""Exact top-k search by inner product: tiled matrix products, partial selection, tree merging.

Vectors are dealt evenly into tiles of at most ``TILE`` rows and queries into blocks of at most ``BLOCK``. A grid of
cells covers all pairs: a cell holds a strip of up to ``BLOCKS`` blocks and one of up to ``TILES`` tiles, so a tile
travels once for every strip of blocks, not for every block, and a block once for every strip of tiles. A cell
multiplies tile by tile; of a tile's scores only those go on that reach the tile's and the running k-th best. Cells'
top lists merge in a tree of fan-in ``FAN``. Products are exact integers: in doubles while they can't exceed 2**53,
else in Python integers.

Cases: vectors that are null or hold a null or non-finite component take no part; vectors of another
length than a query's are no candidates of it (empty ones are candidates of empty queries, at 0); a query's own row is
no candidate, but other rows of its vec_id are; rows that repeat a vec_id are queries and candidates each; a null vec_id
takes no part; a score beyond a long is null, and scores of more than 38 digits count as equal; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm._common import Stage, narrow

TILE, BLOCK, FAN, K = 4096, 1024, 32, 5
#: A cell's blocks and tiles: at 64 dimensions some 8 MB of queries and 32 MB of vectors, if their components take two bytes.
BLOCKS, TILES = 64, 64
EVERY = 50
_WHOLE = 2.0**53


def _smallest(data: np.ndarray) -> tuple[str, np.ndarray]:
    """Whole numbers in the narrowest type that holds them: (type, array)."""
    most = float(np.abs(data).max(initial=0))
    kind = next((k for k, top in (("<i2", 2**15), ("<i4", 2**31), ("<i8", _WHOLE)) if most < top), "<f8")
    return kind, data.astype(kind)


def _packer(per_part: int):
    """Parts of at most per_part rows: their row numbers, ids and components, row after row, as bytes. One dimension a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}

        def parts(d: int) -> Iterator[pa.RecordBatch]:
            rows, ids, data = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
            order = np.argsort(rows)
            rows, ids, data = rows[order], ids[order], data[order]
            for at in range(0, len(rows), per_part):
                kind, cells = _smallest(data[at : at + per_part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d], pa.int32()), pa.array([kind]), *[pa.array([x.tobytes()], pa.binary()) for x in (rows[at : at + per_part], ids[at : at + per_part], cells)]],
                    names=["dim", "kind", "rows", "ids", "data"],
                )

        for rb in batches:
            rows, ids, lists = rb.column(0).to_numpy(), rb.column(1).to_numpy(), rb.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy().astype(np.float64)
            ends = np.cumsum(sizes)
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                held.setdefault(d, []).append((rows[own], ids[own], flat[(ends[own] - d)[:, None] + np.arange(d)]))
                count[d] = count.get(d, 0) + len(own)
                if count[d] >= 4 * per_part:
                    yield from parts(d)
                    count[d] = 0
        for d in sorted(held):
            yield from parts(d)

    return run


_PART = "dim int, kind string, rows binary, ids binary, data binary"


class Top:
    """Running k best of each of n queries: by score, then the smaller id, then the earlier row."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.ids = np.zeros((n, k), np.int64)
        self.rows = np.full((n, k), -1, np.int64)

    def see(self, q: np.ndarray, q_rows: np.ndarray, ids: np.ndarray, rows: np.ndarray, data: np.ndarray) -> None:
        """Take in a tile: its ids, row numbers (ascending) and components."""
        most = float(np.abs(q).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, q.shape[1])
        if most >= _WHOLE or self.score.dtype == object:
            return self._see_whole(q, q_rows, ids, rows, data)
        scores = q @ data.T
        at = np.searchsorted(rows, q_rows)
        own = np.flatnonzero(rows[np.minimum(at, len(rows) - 1)] == q_rows)
        scores[own, at[own]] = -np.inf
        least = self.score[:, -1]
        if len(rows) > self.k and np.count_nonzero(np.isinf(least)):
            least = np.maximum(least, np.partition(scores, len(rows) - self.k, axis=1)[:, len(rows) - self.k])
        i, j = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if len(i):
            self._merge(i, scores[i, j], ids[j], rows[j])

    def _merge(self, i: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        live = np.unique(i)
        held = np.repeat(live, self.k)
        i = np.concatenate((held, i))
        score, ids, rows = (np.concatenate((old[live].reshape(-1), new)) for old, new in ((self.score, score), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((rows, ids, -score, i))
        i, score, ids, rows = i[order], score[order], ids[order], rows[order]
        begin = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        place = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i))))
        keep = place < self.k
        at = i[keep], place[keep]
        self.score[at], self.ids[at], self.rows[at] = score[keep], ids[keep], rows[keep]

    def _see_whole(self, q, q_rows, ids, rows, data) -> None:
        """As see, in Python integers."""
        if self.score.dtype != object:
            self.score = np.array([[x if x == -np.inf else int(x) for x in row] for row in self.score.tolist()], object).reshape(self.score.shape)
        whole = lambda m: [[int(x) for x in row] for row in m.tolist()]
        vectors = list(zip(whole(data), ids.tolist(), rows.tolist(), strict=True))
        for n, (v, own) in enumerate(zip(whole(q), q_rows.tolist(), strict=True)):
            best = [x for x in zip(self.score[n], self.ids[n], self.rows[n], strict=True) if x[2] >= 0]
            best += [(sum(a * b for a, b in zip(v, w, strict=True)), c, r) for w, c, r in vectors if r != own]
            for place, (s, c, r) in enumerate(sorted(best, key=lambda x: (-x[0], x[1], x[2]))[: self.k]):
                self.score[n, place], self.ids[n, place], self.rows[n, place] = s, c, r

    def lists(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(query's number, candidate's id, score), without empty places."""
        n, place = np.nonzero(self.rows >= 0)
        return n, self.ids[n, place], [int(x) for x in self.score[n, place].tolist()]


def _part(t: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, ids, components) of a part."""
    rows, ids = (np.frombuffer(t.column(c)[i].as_buffer(), np.int64) for c in ("rows", "ids"))
    data = np.frombuffer(t.column("data")[i].as_buffer(), t.column("kind")[i].as_py())
    return rows, ids, data.reshape(len(rows), -1)


_TOP = T.StructType([T.StructField(n, T.LongType()) for n in ("query_row", "query_id", "strip", "vec_id")] + [T.StructField("score", T.DecimalType(38, 0))])
_MOST = 10**38 - 1


def _cell(k: int):
    def run(key: tuple, blocks: pa.Table, tiles: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], []]
        parts = [_part(tiles, t) for t in range(tiles.num_rows)] if blocks.num_rows else []
        for b in range(blocks.num_rows):
            q_rows, q_ids, q = _part(blocks, b)
            top = Top(len(q_rows), k)
            for rows, ids, data in parts:
                top.see(q.astype(np.float64), q_rows, ids, rows, data.astype(np.float64))
            n, ids, score = top.lists()
            for c, x in zip(cols, (q_rows[n].tolist(), q_ids[n].tolist(), ids.tolist(), [max(-_MOST, min(_MOST, s)) for s in score]), strict=True):
                c += x
        strip = [key[2].as_py()] * len(cols[0])
        return pa.table([*[pa.array(c, pa.int64()) for c in (cols[0], cols[1], strip, cols[2])], pa.array(cols[3], pa.decimal128(38, 0))], names=_TOP.names)

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score, for each query row, from two tables of (row, vec_id, v array<double> of whole numbers, no nulls in them).

    ``row`` numbers the rows of both: a query is no candidate of its own row number.
    """
    spark = vectors.sparkSession
    stage = Stage(spark, "topk")

    def dealt(df: DataFrame, rows: int) -> tuple[DataFrame, int]:
        n = max(1, math.ceil(df.count() / rows))
        parts = df.select("row", "vec_id", "v").repartition(n).mapInArrow(_packer(rows), _PART)
        return stage.put(parts.withColumn("part", F.spark_partition_id())), n

    (blocks, n_q), (tiles, n_c) = dealt(queries, BLOCK), dealt(vectors, TILE)
    # A cell's size is bounded; with few parts, cells are smaller, so that there are some for every core.
    q_strips = math.ceil(n_q / BLOCKS)
    c_strips = max(math.ceil(n_c / TILES), min(n_c, math.ceil(2 * spark.sparkContext.defaultParallelism / q_strips)))
    q = blocks.withColumn("q", F.floor(F.col("part") * q_strips / n_q).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c_strips - 1))))
    c = tiles.withColumn("c", F.floor(F.col("part") * c_strips / n_c).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_strips - 1))))
    top = q.drop("part").groupBy("dim", "q", "c").cogroup(c.drop("part").groupBy("dim", "q", "c")).applyInArrow(_cell(k), _TOP)
    best = [F.col("score").desc(), F.col("vec_id")]
    n = c_strips
    while n > FAN:
        top = top.withColumn("strip", F.floor(F.col("strip") / FAN))
        w = Window.partitionBy("query_row", "strip").orderBy(*best)
        top = top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
        n = math.ceil(n / FAN)
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(*best))).where(F.col("rank") <= k)
    out = stage.put(ranked.select("query_id", F.col("rank").cast("int"), "vec_id", F.expr("try_cast(score as long)").alias("score")))
    stage.drop(blocks, tiles)
    return out


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as double; rows that take no part are left out."""
    rows = narrow(df, vec_id=id_col, v=vector_col).where("vec_id is not null and v is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>")).where(F.forall("v", finite))
    return rows.select("vec_id", F.transform("v", lambda x: _floor(x * F.lit(float(scale)))).alias("v"))


def _floor(x):
    """floor as a double; numbers of 2**53 and more are whole already."""
    return F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)


def search_every(df: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows."""
    stage = Stage(df.sparkSession, "vectors")
    rows = stage.put(quantised(df).withColumn("row", F.monotonically_increasing_id()))  # written, so that a row keeps its number
    out = top_k(rows.where(F.col("vec_id") % every == 0), rows, k)
    stage.drop(rows)
    return out
