"""Bases, k-mers and paths as Columns. A k-mer state is base 4 with A C G T as 0 1 2 3, the last base least."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloom.functions import numeric as N

BASES = "ACGT"


def base_to_int(base: Column, fold: bool = True) -> Column:
    """-1 for other characters."""
    letter = F.upper(base) if fold else base
    return F.when(F.length(base) == 1, F.instr(F.lit(BASES), letter) - 1).otherwise(F.lit(-1))


def encode_kmers(seq: Column, k: int, fold: bool = True) -> Column:
    """States of all k-mers in order; null if the sequence is shorter or holds another letter."""
    s = F.upper(seq) if fold else seq

    def rolled(codes: Column) -> Column:  # k shifted copies side by side: linear in the sequence's length
        n = F.size(codes) - k + 1
        states = F.slice(codes, 1, n)
        for j in range(1, k):
            states = F.zip_with(states, F.slice(codes, j + 1, n), lambda a, b: a * 4 + b)
        return states

    states = N.let(F.transform(F.filter(F.split(s, ""), lambda c: F.length(c) > 0), lambda c: F.instr(F.lit(BASES), c) - 1), rolled)
    return F.when((F.length(s) >= k) & s.rlike(f"^[{BASES}]+$"), states)


def decode_kmer(state: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(state.cast("string"), 10, 4), k, "0"), "0123", BASES)


def repeat_block(base: Column, n: int) -> Column:
    """The n-mer state of a base repeated."""
    return (base * ((4**n - 1) // 3)).cast("int")


def four_to(n: Column) -> Column:
    return F.pow(F.lit(4.0), n).cast("long")


def highest_bit(x: Column) -> Column:
    """Bits needed to write x; 0 for 0."""
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0)


def kmer_length(n_states: Column) -> Column:
    """Largest k with 4**k <= n_states."""
    return F.floor((highest_bit(n_states) - 1) / 2).cast("int")


def is_homopolymer(state: Column, k: int) -> Column:
    unit = (4**k - 1) // 3
    return state.isin(0, unit, 2 * unit, 3 * unit)


def overlap(before: Column, after: Column, k: int) -> Column:
    """The least shift o >= 1 by which the k-mers overlap; k if they share nothing."""
    out = F.lit(k)
    for o in range(k - 1, 0, -1):
        rest = 4 ** (k - o)
        out = F.when(before % rest == F.shiftright(after, 2 * o), F.lit(o)).otherwise(out)
    return out


def first_nonnegative(path: Column) -> Column:
    """Index of the first entry that isn't a stay; the length if there is none."""
    at = F.array_position(F.transform(path, lambda x: (x >= 0).cast("int")), 1)
    return F.when(at > 0, at - 1).otherwise(F.size(path)).cast("int")


def running(a: Column) -> Column:
    """Running sums of an array of integers, by doubling: each round adds the sums so far of as many entries before."""

    def summed(a: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(a) + 1)).cast("int"))
        add = lambda acc, d: F.zip_with(acc, F.concat(F.array_repeat(F.lit(0), d), F.slice(acc, 1, F.greatest(F.size(acc) - d, F.lit(0)))), lambda x, y: x + F.coalesce(y, F.lit(0)))
        trimmed = lambda acc, e: N.let(F.least(F.pow(F.lit(2.0), e).cast("int"), F.size(acc)), lambda d: add(acc, d))
        return F.aggregate(rounds, a, trimmed)

    return N.let(a, summed)


def stitch(path: Column, k: int) -> tuple[Column, Column]:
    """(bases, positions): the first k-mer, then the new bases of each next one; positions are -1 before it, else the running shift.

    Null without any k-mer.
    """
    states = F.filter(F.transform(path, lambda s: s.cast("int")), lambda s: s >= 0)
    # Of neighbours that aren't stays, how far the later one is ahead; the first is at 0.
    ahead = lambda m: F.concat(F.array(F.lit(0)), F.zip_with(F.slice(m, 1, F.size(m) - 1), F.slice(m, 2, F.size(m) - 1), lambda x, y: overlap(x, y, k)))
    new = lambda s, o, i: F.when(i == 0, decode_kmer(s, k)).otherwise(F.right(decode_kmer(s, k), o))
    text = lambda m: F.array_join(F.transform(F.arrays_zip(m.alias("s"), ahead(m).alias("o")), lambda z, i: new(z["s"], z["o"], i)), "")
    seen = running(F.transform(path, lambda s: (s >= 0).cast("int")))
    place = N.let(running(N.let(states, ahead)), lambda at: F.transform(seen, lambda n: F.when(n > 0, F.get(at, n - 1)).otherwise(F.lit(-1))))
    some = F.exists(path, lambda s: s >= 0)
    return F.when(some, N.let(states, text)), F.when(some, place)


def ctc_collapse(path: Column) -> Column:
    """States without stays and without repeats that no stay parts."""
    keep = lambda p: F.zip_with(p, F.concat(F.array(F.lit(-1)), F.slice(p, 1, F.size(p) - 1)), lambda s, b: F.when((s >= 0) & (s != b), s))
    return F.when(F.size(path) == 0, path).otherwise(F.filter(N.let(path, keep), lambda s: s.isNotNull()))


def crf_bases(path: Column) -> tuple[Column, Column]:
    """(bases, positions) of a path over A C G T and a blank (4)."""
    indexed = F.filter(F.transform(path, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda z: z["s"] < 4)
    return F.array_join(F.transform(indexed, lambda z: F.substring(F.lit(BASES), z["s"].cast("int") + 1, F.lit(1))), ""), F.transform(indexed, lambda z: z["i"])


def calibrated_dwell(dwell: Column, adjust: Column, scale: Column) -> Column:
    """Bases that a dwell is worth, half away from zero."""
    return F.round((dwell - adjust) / scale).cast("int")


def guess_alphabet(n_states: int) -> tuple[int, int]:
    """(letters, k) with letters ** k == n_states - 1, letters from 4 to 7, k from 1 to 9; the smallest letters."""
    for letters in range(4, 8):
        for k in range(1, 10):
            if letters**k == n_states - 1:
                return letters, k
    raise ValueError(f"{n_states} states fit no alphabet")
