"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find grouping.

Before two sets are compared, a bound says whether they can be similar at all: a profile counts a set's shingles by the
last byte of their hash, and two sets can't share more shingles than the sums of the lesser counts. The bound is never
under the truth, so no similar pair is left out.

Cases: null or empty text, or text without words, has an empty set and is linked with nothing; a null
doc_id is linked with nothing (component_id null, kept); rows that repeat a doc_id count as one
document, linked by each of its texts, and each gets a result row; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm._common import Stage, narrow, splitmix, text_chunks
from sigloom.llm.shingles import shingle_sets

#: A pair at similarity 0.75 shares no band with a probability of (1 - 0.75 ** 5) ** 40 = 2e-5.
BANDS, ROWS = 40, 5
SLOTS = BANDS * ROWS
#: A link needs 100 * intersection >= LEAST * union.
LEAST = 75
#: Counts of a profile; a count of 255 may stand for more.
PROFILE = 256
#: Members of a bucket that are compared at a time, and their shingles.
CHUNK, CHUNK_SHINGLES = 512, 400_000
#: Parts of a component's centre where its neighbours are joined with it.
SALTS = 8
_BLOCK = 1 << 15


def super_minhash(elements: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set: uint32 of shape (sets, slots).

    Each element draws, step by step, a random permutation of the slots (Fisher-Yates) and offers
    step + fraction to the slot it lands on; slots keep minima. All elements take a step together.
    A set stops once every slot holds a value of an earlier step. The step is in the top 8 bits.
    """
    n = len(bounds) - 1
    h = np.full((n, slots), 0xFFFFFFFF, np.uint32)
    flat = h.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    for lo in range(0, len(elements), _BLOCK):
        e, own = elements[lo : lo + _BLOCK], owner[lo : lo + _BLOCK]
        row = np.arange(len(e))
        perm = np.tile(np.arange(slots, dtype=np.uint8), (len(e), 1))
        for j in range(slots):
            x = splitmix(e + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
            k = j + ((x & np.uint64(0xFFFFFFFF)) % np.uint64(slots - j)).astype(np.int64)
            got = perm[row, k]
            perm[row, k] = perm[row, j]
            np.minimum.at(flat, own * slots + got, (np.uint32(j << 24) | (x >> np.uint64(40)).astype(np.uint32)))
            live = np.unique(own) if j else np.arange(own[0], own[-1] + 1)
            done = h[live].max(axis=1) < np.uint32((j + 1) << 24) if j + 1 < slots else np.ones(len(live), bool)
            if done.any():
                open_ = np.zeros(int(live[-1]) + 1, bool)
                open_[live[~done]] = True
                keep = open_[own]
                e, own, row = e[keep], own[keep], row[keep]
                if not len(e):
                    break
    return h


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """int64 of shape (sets, BANDS): a hash of each band's rows and number."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), 1))
    for r in range(ROWS):
        key = splitmix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def profiles(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """uint8 of shape (sets, PROFILE): how many of a set's hashes end in each byte."""
    n = len(bounds) - 1
    at = np.repeat(np.arange(n), np.diff(bounds)) * PROFILE + (sets % np.uint64(PROFILE)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=n * PROFILE), 255).astype(np.uint8).reshape(n, PROFILE)


def may_be_similar(x: np.ndarray, y: np.ndarray, x_size: np.ndarray, y_size: np.ndarray) -> np.ndarray:
    """Whether sets with these profiles (the last axis) and sizes can have the similarity of a link; never false for one."""
    both = np.minimum(x, y).sum(axis=-1, dtype=np.int64)
    unknown = ((x == 255) & (y == 255)).any(axis=-1)
    return (100 * both >= LEAST * (x_size + y_size - both)) | (unknown & (100 * np.minimum(x_size, y_size) >= LEAST * np.maximum(x_size, y_size)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb, buf, offs in text_chunks(batches, "text", 1 << 19):
        sets, bounds = shingle_sets(buf, offs)
        keys = band_keys(super_minhash(sets, bounds))
        size = np.diff(bounds)
        digest = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                rb.column(0),
                rb.column(2),
                pa.array(size, pa.int64()),
                pa.array(digest, pa.binary()),
                pa.ListArray.from_arrays(np.arange(len(size) + 1, dtype=np.int32) * BANDS, keys.reshape(-1)),
                pa.array([x.tobytes() for x in profiles(sets, bounds)], pa.binary()),
            ],
            names=["doc_id", "text_hash", "n_shingles", "digest", "bands", "profile"],
        )


_SIGNED = "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, profile binary"


def _profiles_of(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, PROFILE)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with sizes and profiles, those that may be similar."""
    for rb in batches:
        if rb.num_rows:
            x, y = (_profiles_of(rb.column(i)) for i in (4, 5))
            yield rb.select([0, 1]).filter(pa.array(may_be_similar(x, y, rb.column(2).to_numpy(), rb.column(3).to_numpy())))


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether 100 * |x and y| >= LEAST * |x or y|, for sorted sets."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if not len(small) or 100 * len(small) < LEAST * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= LEAST * (len(small) + len(large) - both)


def _sets(texts: list[str | None]) -> list[np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    sets, bounds = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offs)
    return [sets[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


#: What is compared of a bucket's member; the text only where it comes to that.
_MEMBER = ("node", "comp", "size", "profile", "bands")


def _to_compare(left: pa.StructArray, right: pa.StructArray, band: int) -> dict[int, np.ndarray]:
    """Of two chunks of a bucket's members, the right ones that each left one is to be compared with.

    They lie in other components and may be similar. A pair is looked at only in the first band whose keys agree.
    """
    (lc, lz, lp, lk), (rc, rz, rp, rk) = ((x.field(1).to_numpy(), x.field(2).to_numpy(), _profiles_of(x.field(3)), x.field(4).flatten().to_numpy().reshape(-1, BANDS)) for x in (left, right))
    todo: dict[int, np.ndarray] = {}
    for k in range(len(lc)):
        at = np.flatnonzero(rc != lc[k])
        at = at[(rk[at] == lk[k]).argmax(axis=1) == band] if len(at) else at
        at = at[may_be_similar(rp[at], lp[k], rz[at], lz[k])] if len(at) else at
        if len(at):
            todo[k] = at
    return todo


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two chunks of a bucket (b, band, l, r, left, right), the members whose texts are needed, as (node, comp); none, no row."""
    kind = pa.list_(pa.struct([("node", pa.int64()), ("comp", pa.int64())]))
    for rb in batches:
        kept, found = [], ([], [])
        for i in range(rb.num_rows):
            sides = [rb.column(c)[i].values for c in (4, 5)]
            if todo := _to_compare(*sides, rb.column(1)[i].as_py()):
                kept.append(i)
                for x, at, out in zip(sides, (np.array(list(todo)), np.unique(np.concatenate(list(todo.values())))), found, strict=True):
                    some = x.take(pa.array(at))
                    out.append([{"node": n, "comp": c} for n, c in zip(some.field(0).to_pylist(), some.field(1).to_pylist(), strict=True)])
        yield pa.RecordBatch.from_arrays([*[rb.column(c).take(pa.array(kept, pa.int64())) for c in range(4)], *[pa.array(x, kind) for x in found]], names=["b", "band", "l", "r", "left", "right"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two chunks of a bucket's members (band, left, right; members with text), the similar pairs of different components."""
    for rb in batches:
        out_a, out_b = [], []
        for i in range(rb.num_rows):
            left, right = (rb.column(c)[i].values for c in (1, 2))
            if todo := _to_compare(left, right, rb.column(0)[i].as_py()):
                ln, rn = left.field(0).to_numpy(), right.field(0).to_numpy()
                used = np.unique(np.concatenate(list(todo.values())))
                sets = dict(zip(used.tolist(), _sets(right.field(5).take(pa.array(used)).to_pylist()), strict=True))
                own = _sets(left.field(5).take(pa.array(list(todo), pa.int64())).to_pylist())
                for (k, at), mine in zip(todo.items(), own, strict=True):
                    hits = [j for j in at.tolist() if _similar(mine, sets[j])]
                    out_a += [int(ln[k])] * len(hits)
                    out_b += [int(rn[j]) for j in hits]
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both texts, the similar ones."""
    hub, known = None, None
    for rb in batches:
        for part, buf, offs in text_chunks(iter([rb]), "text_a"):
            sets, bounds = shingle_sets(buf, offs)
            texts = part.column(3)
            keep = []
            for i in range(part.num_rows):
                if (text := texts[i].as_py() or "") != hub:
                    raw = np.frombuffer(text.encode(), np.uint8)
                    hub, known = text, shingle_sets(raw, np.array([0, len(raw)]))[0]
                keep.append(_similar(sets[bounds[i] : bounds[i + 1]], known))
            yield part.select([0, 1]).filter(pa.array(keep))


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find with path halving over one partition's links, blocks of a bounded size at a time."""
    for rb in batches:
        parent: dict[int, int] = {}

        def find(x: int, parent: dict[int, int] = parent) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        pairs = [(x, find(x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["u", "v"])


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """(node, root) for every node in links (two long columns) but the roots: root is the component's smallest node.

    Union-find within partitions first; then rounds that hang every node's larger neighbours on its smallest
    and every node with its smaller ones on the smallest, until nothing changes. Minima are pre-aggregated, and a node's
    neighbours meet its minimum in SALTS tasks, as the centre of a large component may have most of all edges.
    """
    a, b = links.columns
    edges = stage.put(links.select(F.col(a).alias("u"), F.col(b).alias("v")).mapInArrow(_local_forest, "u long, v long").distinct(), links.count())
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._sigloom_path = edges._sigloom_path
            return out
        seen = mark
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        least = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        parts = both.where("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        large = parts.join(least, (F.col("u") == F.col("w")) & (F.col("salt") == F.col("part"))).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stage.put(large, mark[0])
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        after = stage.put(small.union(least.select("u", F.col("m").alias("v"))).distinct(), mark[0])
        stage.drop(edges, large)
        edges = after


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    Equal sets collapse to a class first. Then every bucket compares its members with one hub, the member that
    meets most others over all its buckets. Members that this leaves in other components than their bucket's
    largest are compared with all other members in bounded chunks, first by their profiles; only members that may be similar
    to another one are joined with their texts, and only links leave a chunk. So copies of a text merge without their
    pairs being emitted, and no pair of different components that shares a bucket is left open.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "near")
    docs = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    signed = stage.put(docs.mapInArrow(_sign, _SIGNED))
    linkable = signed.where("doc_id is not null and digest is not null")
    one = linkable.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.first("bands").alias("bands"), F.first("profile").alias("profile"), F.first("n_shingles").alias("size"))
    classes = stage.put(one.select("digest", F.col("one.doc_id").alias("node"), "one.text_hash", "bands", "profile", "size"))
    slots = classes.select("node", "text_hash", "size", F.posexplode("bands").alias("band", "b"))
    shared = slots.groupBy("b").agg(F.min("node").alias("low"), F.max("node").alias("top"), F.count("*").alias("n")).where("low < top").select("b", "n")
    members = stage.put(slots.join(shared, "b"))
    reach = members.groupBy("node").agg(F.sum("n").alias("reach"))
    hubs = members.join(reach, "node").groupBy("b").agg(F.max_by("node", F.struct("reach", -F.col("node"))).alias("hub"))
    rest = stage.put(members.join(hubs, "b").where("node != hub").select("b", "band", "node", "size", "hub"))
    # One text a class, also where rows repeat a doc_id or a row.
    needed = members.select(F.col("node").alias("doc_id"), "text_hash").distinct()
    rows = stage.put(docs.join(needed, ["doc_id", "text_hash"], "left_semi"))
    texts = stage.put(rows.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("node"), "text_hash", "text"))
    stage.drop(members, rows)

    left, right = (classes.select(F.col("node").alias(k), F.col("profile").alias(f"profile_{k}"), F.col("size").alias(f"size_{k}")) for k in "ab")
    pairs = rest.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct().join(left, "a").join(right, "b")
    pairs = stage.put(pairs.select("a", "b", "size_a", "size_b", "profile_a", "profile_b").mapInArrow(_alike, "a long, b long").distinct())
    left, right = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    links = stage.put(both.mapInArrow(_verify, "a long, b long"), pairs.count(), 2000)
    # Rows of a doc_id with different sets are one document, so their classes are linked.
    h = F.xxhash64("digest")
    several = linkable.groupBy("doc_id").agg(F.min(h).alias("low"), F.max(h).alias("top")).where("low < top").select("doc_id")
    own = linkable.join(several, "doc_id", "left_semi").join(classes.select("digest", "node"), "digest").where("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    roots = components(links.union(own), stage)
    stage.drop(pairs, links)

    placed = rest.join(roots, "node", "left").select("b", "band", "node", "size", F.coalesce("root", "node").alias("comp"))
    sizes = placed.groupBy("b", "comp").agg(F.struct(F.count("*").alias("n"), F.sum("size").alias("size"), F.first("comp").alias("comp")).alias("one"))
    open_ = sizes.groupBy("b").agg(F.count("*").alias("k"), F.sum("one.n").alias("n"), F.sum("one.size").alias("size"), F.max("one").alias("main")).where("k > 1")
    parts = lambda n, size: F.ceil(F.greatest(n / CHUNK, size / CHUNK_SHINGLES))
    n_right, n_left = parts(F.col("n"), F.col("size")), parts(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size"))
    open_ = open_.select("b", F.col("main.comp").alias("main"), n_right.alias("n_right"), n_left.alias("n_left"))
    here = stage.put(placed.drop("size").join(open_, "b"))
    if not here.isEmpty():
        full = here.join(classes.select("node", "size", "profile", "bands"), "node")
        packed = F.collect_list(F.struct(*_MEMBER))
        keys = [F.pmod(F.xxhash64("node"), F.col(f"n_{side}")) for side in ("left", "right")]
        left = full.where("comp != main").groupBy("b", keys[0].alias("l"), "n_right").agg(packed.alias("left"))
        right = full.groupBy("b", "band", keys[1].alias("r"), "n_left").agg(packed.alias("right"))
        left = left.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_right") - 1)))
        right = right.withColumn("l", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_left") - 1)))
        node = "array<struct<node: long, comp: long>>"
        chunks = left.join(right, ["b", "l", "r"]).select("b", "band", "l", "r", "left", "right")
        chunks = stage.put(chunks.mapInArrow(_screen, f"b long, band int, l long, r long, left {node}, right {node}"))
        looks = classes.select("node", "text_hash", "size", "profile", "bands").join(texts, ["node", "text_hash"]).drop("text_hash")
        packed = F.collect_list(F.struct(*_MEMBER, "text"))
        left, right = (
            chunks.select("b", "band", "l", "r", F.explode(side).alias("m")).select("b", "band", "l", "r", "m.*").join(looks, "node").groupBy("b", "band", "l", "r").agg(packed.alias(side))
            for side in ("left", "right")
        )
        more = stage.put(left.join(right, ["b", "band", "l", "r"]).select("band", "left", "right").mapInArrow(_compare, "a long, b long"))
        # The components so far are a forest of their own, so only new links are added to it.
        after = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), stage)
        stage.drop(chunks, more, roots)
        roots = after
    group = classes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "digest").join(group, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = stage.put(out.select("doc_id", "n_shingles", component.alias("component_id")))
    stage.drop(signed, classes, rest, texts, here, roots)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
