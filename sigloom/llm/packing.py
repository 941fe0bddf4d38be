"""Sequence packing: first-fit decreasing over a tournament tree, in randomised groups of documents.

A document's ids and an end id are cut into whole sequences and one rest. Pieces are dealt at random (by a hash)
to groups of about ``GROUP`` pieces; a group packs its pieces alone, longest first, each into the first
sequence with room, which a tournament tree of the sequences' room finds in logarithmic time.

Cases: a null or empty text is its end id alone; very long texts of any characters are encoded whole; repeated rows are packed each; a null doc_id is packed like
any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm._common import Stage, narrow, text_chunks, texts_of

LENGTH, END_ID = 1024, 0
GROUP = 8192
#: The split pattern of byte-level BPE, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tiktoken.Encoding:
    """The encoder of a byte-level BPE JSON file; its special tokens' strings in a text are their ids, as the file's own library does.

    The file's merges are in the order of their ids, so ids are ranks; this is checked.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
    at = [spec["model"]["vocab"][m] for m in made]
    if at != sorted(at):
        raise ValueError("ids don't follow the merges")
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def _own_library(path: str) -> tokenizers.Tokenizer:
    return tokenizers.Tokenizer.from_file(path)


def encode(text: str, path: str) -> list[int]:
    """Ids of a text. The fast encoder's pattern gives up on very long runs of blanks; the file's own library, which takes them, then encodes the text."""
    try:
        return tokenizer(path).encode(text, allowed_special="all")
    except ValueError:
        return _own_library(path).encode(text, add_special_tokens=False).ids


def _pieces(path: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb, buf, offs in text_chunks(batches, "text"):
            cols: list[list[int]] = [[], [], [], [], []]
            for row, text in enumerate(texts_of(buf, offs)):
                ids = np.array([*encode(text, path), end], "<u4")
                for at in range(0, len(ids), length):
                    part = ids[at : at + length]
                    for c, v in zip(cols, (row, at, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each size. Sizes are taken longest first, then in their order."""
    order = np.argsort(-np.asarray(sizes), kind="stable").tolist()
    leaves = 1 << max(0, len(order) - 1).bit_length()
    tree = [room] * (2 * leaves)  # tree[1] is the winner: the most room of any bin
    bins, offsets = [0] * len(order), [0] * len(order)
    for i in order:
        size, at = int(sizes[i]), 1
        while at < leaves:  # down to the leftmost bin with room
            at = 2 * at if tree[2 * at] >= size else 2 * at + 1
        bins[i], offsets[i] = at - leaves, room - tree[at]
        tree[at] -= size
        at >>= 1
        while at:
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
            at >>= 1
    return bins, offsets


def _packer(length: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), length)
        group = table.column("group").to_numpy().astype(np.int64)
        sequence = (group << 32) + np.array(bins, np.int64)
        out = table.drop_columns(["group"])
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END_ID, group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece of each row of docs."""
    stage = Stage(docs.sparkSession, "pack")
    rows = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    pieces = stage.put(rows.mapInArrow(_pieces(path, length, end), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"))
    groups = max(1, math.ceil(pieces.count() / group))
    # The row hash spreads repeated rows' ids too, as the pieces' own place in the staged file is part of it.
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    out = stage.put(dealt.groupBy("group").applyInArrow(_packer(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
    stage.drop(pieces)
    return out
