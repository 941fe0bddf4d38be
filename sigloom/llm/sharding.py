"""Sharding by a permutation-filled lookup table.

Every shard orders the slots of a prime-sized table by a permutation of its own (an offset and a step from
hashes of its name); shards take turns, each claiming its next free slot, until the table is full. A key's
slot is a hash modulo the table's size. Shards differ by at most one slot, and a shard that leaves
moves few other keys. The table is a literal in the plan, its size fixed, so placement is one array lookup. All
of it is DataFrame expressions on the rows; only the table, whose size no input changes, is filled on the driver.

Cases: a null key goes to slot 0; equal keys go to one shard; repeated rows give repeated results; an empty
table gives an empty result; extra columns are ignored (shard_of works on any column).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm._common import narrow

#: Prime, and over a hundred times the number of shards.
SLOTS = 2039
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard number of each slot."""
    if not 0 < len(set(shards)) == len(shards) <= slots or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("shards must be distinct and fewer than the slots, whose number must be prime")
    offset = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"step:{s}") % (slots - 1) + 1 for s in shards]
    turn, table, left = [0] * len(shards), [-1] * slots, slots
    while left:
        for s in range(len(shards)):
            while True:
                at = (offset[s] + turn[s] * step[s]) % slots
                turn[s] += 1
                if table[at] < 0:
                    break
            table[at] = s
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 15 hex digits of the key's md5, modulo the table's size."""
    return F.coalesce(F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long") % slots, F.lit(0))


def shard_of(slot: Column, table: list[int]) -> Column:
    literal = F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<int>")  # folds to one literal
    return F.element_at(literal, slot.cast("int") + 1)


def place(docs: DataFrame, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, slot, shard, text_bytes: one row for each row of docs, placed by doc_id."""
    docs = narrow(docs, doc_id=id_col, text=text_col)
    docs = docs.select("doc_id", slot_of(F.col("doc_id"), slots).alias("slot"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("text_bytes"))
    return docs.select("doc_id", "slot", shard_of(F.col("slot"), fill(shards, slots)).alias("shard"), "text_bytes")


def write_shards(docs: DataFrame, path: str, shards: tuple[str, ...] = SHARDS, key: str = "doc_id", files: int = 8) -> None:
    """Write docs partitioned by a column ``shard``; a shard's rows are spread over ``files`` tasks by their slot."""
    slot = slot_of(F.col(key))
    placed = docs.withColumn("shard", shard_of(slot, fill(shards)))
    placed.repartition(len(shards) * files, "shard", slot % files).write.partitionBy("shard").parquet(path)
