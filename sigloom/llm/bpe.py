"""Byte-level BPE by a two-tier lookup.

A minimal perfect hash (buckets displaced until every vocabulary entry has a slot of its own) resolves pre-tokens
that are vocabulary entries as they are; the others are merged by rank with a heap over linked bytes. A
worker keeps resolved pre-tokens in a bounded table.

Cases: null and empty texts have no ids; repeated rows give repeated results; an empty table gives an
empty result; extra columns are ignored. No special tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm._common import narrow, splitmix, text_chunks, texts_of

#: Resolved pre-tokens that a worker keeps, some 150 MB of them; beyond it, those of the text at hand stay.
KEPT = 600_000
_PLACE = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def piece_hashes(pieces: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each byte string."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    buf = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    place = np.arange(len(buf)) - np.repeat(ends - sizes, sizes)
    terms = np.concatenate((splitmix((buf + np.uint64(1)) * _PLACE[place & 255] + (place >> 8).astype(np.uint64)), np.zeros(1, np.uint64)))
    total = np.where(sizes > 0, np.add.reduceat(terms, np.minimum(ends - sizes, len(buf))), np.uint64(0))
    return splitmix(total ^ (sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings: a bucket's displacement sends its keys to free slots; as many slots as keys."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        h = piece_hashes(keys)
        if len(np.unique(h)) != n:
            raise ValueError("keys repeat")
        self.n, self.buckets = n, max(1, n // 4)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(size) - size
        self.shift = np.zeros(self.buckets, np.uint64)
        taken = np.zeros(n, bool)
        self.key_at = np.zeros(n, np.int64)
        draws = np.arange(1, 257, dtype=np.uint64)
        for b in np.argsort(-size, kind="stable").tolist():
            if not size[b]:
                break
            own = order[first[b] : first[b] + size[b]]
            tried = np.uint64(0)
            while True:
                d = draws + tried
                slots = (splitmix(h[own][:, None] + d[None] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)
                ok = ~taken[slots].any(axis=0)
                if size[b] > 1:
                    s = np.sort(slots, axis=0)
                    ok &= (s[1:] != s[:-1]).all(axis=0)
                if ok.any():
                    k = int(np.argmax(ok))
                    self.shift[b] = d[k]
                    taken[slots[:, k]] = True
                    self.key_at[slots[:, k]] = own
                    break
                tried += np.uint64(256)
        self.keys = keys
        self.check = h[self.key_at]

    def find(self, pieces: list[bytes]) -> np.ndarray:
        """Index of each piece among the keys, or -1. The slot's key itself is compared."""
        if not pieces:
            return np.zeros(0, np.int64)
        h = piece_hashes(pieces)
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = (splitmix(h + shift * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)
        out = np.where(self.check[slot] == h, self.key_at[slot], -1)
        for i in np.flatnonzero(out >= 0).tolist():
            if self.keys[out[i]] != pieces[i]:
                out[i] = -1
        return out


def merge(piece: bytes, rank) -> list[int]:
    """Ids of a piece: the lowest rank merges first, the leftmost of equal ones; rank(bytes) is None for no entry."""
    n = len(piece)
    heap = []
    cur = [-1] * n  # rank of the pair that begins here, -1 for none
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            cur[i] = r
            heap.append(r * n + i)
    heapify(heap)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while heap:
        r, i = divmod(heappop(heap), n)
        if cur[i] != r:
            continue
        j = end[i]  # the right part, taken in
        e = end[j]
        cur[j] = -1
        end[i] = e
        if e < n:
            before[e] = i
            r = rank(piece[i : end[e]])
            if r is None:
                cur[i] = -1
            else:
                cur[i] = r
                heappush(heap, r * n + i)
        else:
            cur[i] = -1
        if i:
            p = before[i]
            r = rank(piece[p:e])
            if r is None:
                cur[p] = -1
            else:
                cur[p] = r
                heappush(heap, r * n + p)
    out, i = [], 0
    while i < n:
        out.append(rank(piece[i : end[i]]))
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one rank file (lines of base64 bytes and rank)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.entries = list(ranks)
        self.ids = np.array(list(ranks.values()), np.int64)
        self.bytes_of = {str(v): k for k, v in ranks.items()}
        self.hash = PerfectHash(self.entries)
        self.rank = ranks.get
        self.kept: dict[str, str] = {}

    def resolve(self, pieces: list[str]) -> None:
        """Put the pieces' ids (decimal, joined by commas) into the table of resolved ones."""
        raw = [p.encode() for p in pieces]
        whole = self.hash.find(raw)
        ids = np.where(whole >= 0, self.ids[whole], -1).tolist()
        for text, piece, at in zip(pieces, raw, ids, strict=True):
            self.kept[text] = str(at) if at >= 0 else ",".join(map(str, merge(piece, self.rank)))

    def shown(self, texts: list[str]) -> list[str]:
        """The ids of each text, decimal and joined by commas."""
        find = self.pattern.findall
        words = [find(t) for t in texts]
        need = set(chain.from_iterable(words))
        if len(self.kept) > KEPT:
            self.kept = {w: self.kept[w] for w in need if w in self.kept}
        self.resolve([w for w in need if w not in self.kept])
        get = self.kept.__getitem__
        return [",".join(map(get, w)) for w in words]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(map(int, s.split(","))) if s else [] for s in self.shown(texts)]

    def decode(self, ids: list[str]) -> bytes:
        """The bytes of decimal ids."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for rb, buf, offs in text_chunks(batches, "text"):
            ids = c.encode(texts_of(buf, offs))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: one row for each row of docs. path: a rank file at the same place on every executor."""
    return narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(_encoder(path, pattern), "doc_id long, ids array<int>")


def _decoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([c.decode(map(str, x or [])) for x in rb.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return run


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes from doc_id, ids."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path, pattern), "doc_id long, bytes binary")


def _digester(path: str, pattern: str):
    """Encode, then decode, and keep digests of both: neither the ids nor the bytes travel to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for rb, buf, offs in text_chunks(batches, "text"):
            sha, count, shown, decoded = hashlib.sha256, [], [], []
            for text in c.shown(texts_of(buf, offs)):
                ids = text.split(",") if text else []
                count.append(len(ids))
                shown.append(sha(text.encode()).hexdigest())
                decoded.append(sha(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(count, pa.int64()), pa.array(shown, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256."""
    return narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(_digester(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
