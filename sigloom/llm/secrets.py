"""Secret scan: all rules in one deterministic byte automaton.

Each rule is written over byte classes; Thompson fragments become one combined automaton by subset
construction, Moore refinement minimises it, and byte classes compress its transition array. One pass
steps through the bytes of many segments at once; a segment ends at a byte that no rule can contain, so no
match crosses one and the state is the start state there. In segments where the combined automaton accepts a
rule, one pass from the end by the automaton of the reversed rule marks the bytes at which a match begins, and the
rule's own anchored automaton runs from such bytes alone to fix leftmost, longest, non-overlapping spans. All
passes are linear in the text: no byte is tried as a start in vain.

Cases: null and empty texts have no spans; repeated rows give repeated results; an empty table gives an
empty result; extra columns are ignored. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm._common import narrow, text_chunks

ALNUM = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
UPPER_DIGIT = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
QUOTE = frozenset(b"\"'")


# A rule is nested tuples: ("set", bytes), ("cat", ...), ("alt", ...), ("star", x); the rest is made of these.
def word(text: str, fold: bool = False) -> tuple:
    return ("cat", *[("set", frozenset({ord(c.lower()), ord(c.upper())} if fold else {ord(c)})) for c in text])


def some(x: tuple, least: int = 1) -> tuple:
    return ("cat", *[x] * least, ("star", x))


def maybe(x: tuple) -> tuple:
    return ("alt", x, ("cat",))


@dataclass(frozen=True)
class Rule:
    """least: a shorter match is dropped after matching; of an assignment, the value counts.

    Long counts stay out of the patterns, but for hex: side by side they would multiply the automaton's states.
    Once a pattern matches, it matches with each further byte or never again (checked on compiling), so the longest
    match is found without reading past it.
    """

    kind: str
    pattern: tuple
    least: int = 0


_SPACES = ("star", ("set", frozenset(b" ")))
_VALUE = some(("set", ALNUM | frozenset(b"+/_.=-")))
RULES = (
    Rule("assign", ("cat", ("alt", word("password", True), word("passwd", True), word("secret", True), word("token", True), ("cat", word("api", True), maybe(word("_")), word("key", True))), maybe(("set", QUOTE)), _SPACES, ("set", frozenset(b":=")), _SPACES, maybe(("set", QUOTE)), _VALUE), 6),
    Rule("access", ("cat", word("AKIA"), some(("set", UPPER_DIGIT))), 20),
    Rule("hex", some(("set", frozenset(b"0123456789abcdef")), 24)),
    # Spans that this scan adds to the three kinds above.
    Rule("github", ("cat", word("gh"), ("set", frozenset(b"pousr")), word("_"), some(("set", ALNUM))), 40),
    Rule("pem", ("cat", word("-----BEGIN "), ("star", ("set", UPPER_DIGIT | frozenset(b" "))), word("PRIVATE KEY-----"))),
    Rule("jwt", ("cat", word("eyJ"), some(("set", ALNUM | frozenset(b"_-"))), word("."), word("eyJ"), some(("set", ALNUM | frozenset(b"_-"))), word("."), some(("set", ALNUM | frozenset(b"_-")))), 30),
)


@dataclass(frozen=True)
class Automaton:
    """next[state * classes + byte_class[byte]]; accept[state] is a bit mask of rules. State 0 is the start."""

    byte_class: np.ndarray
    classes: int
    next: np.ndarray
    accept: np.ndarray
    dead: int


def _thompson(patterns: list[tuple]) -> tuple[list[list[tuple]], list[list[int]], list[int], list[int]]:
    moves: list[list[tuple]] = []
    free: list[list[int]] = []

    def state() -> int:
        moves.append([])
        free.append([])
        return len(moves) - 1

    def build(p: tuple, a: int) -> int:
        kind, *rest = p
        if kind == "set":
            b = state()
            moves[a].append((rest[0], b))
            return b
        if kind == "cat":
            for x in rest:
                a = build(x, a)
            return a
        b = state()
        for x in rest:
            c = state()
            free[a].append(c)
            end = build(x, c)
            free[end].append(b)
            if kind == "star":
                free[end].append(c)
        if kind == "star":
            free[a].append(b)
        return b

    starts, ends = [], []
    for p in patterns:
        starts.append(state())
        ends.append(build(p, starts[-1]))
    return moves, free, starts, ends


def compile_rules(patterns: list[tuple], anywhere: bool) -> Automaton:
    """Subset construction and minimisation; anywhere: a match may begin at every byte."""
    moves, free, starts, ends = _thompson(patterns)
    sets = {s for m in moves for s, _ in m}
    signature = [tuple(b in s for s in sets) for b in range(256)]
    names = {x: i for i, x in enumerate(dict.fromkeys(signature))}
    byte_class = np.array([names[x] for x in signature], np.uint8)
    sample = {c: b for b, c in enumerate(byte_class.tolist())}

    def closure(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    first = closure(set(starts))
    index, table, at = {first: 0}, [], [first]
    for now in at:
        row = []
        for c in range(len(names)):
            to = closure({t for s in now for on, t in moves[s] if sample[c] in on})
            to = to | first if anywhere else to
            if to not in index:
                index[to] = len(at)
                at.append(to)
            row.append(index[to])
        table.append(row)
    accept = [sum(1 << r for r, e in enumerate(ends) if e in s) for s in at]
    part = [sorted(set(accept)).index(a) for a in accept]
    while True:
        keys = [(part[s], *[part[t] for t in table[s]]) for s in range(len(at))]
        order = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        fresh = [order[k] for k in keys]
        if len(order) == len(set(part)):
            break
        part = fresh
    part = fresh
    count = len(order)
    rows, marks = [None] * count, [0] * count
    for s, p in enumerate(part):
        rows[p], marks[p] = [part[t] for t in table[s]], accept[s]
    dead = next((p for p in range(count) if not marks[p] and set(rows[p]) == {p}), -1)
    return Automaton(byte_class, len(names), np.array(rows, np.uint16).reshape(-1), np.array(marks, np.uint32), dead)


def mirrored(p: tuple) -> tuple:
    """The rule that matches the same strings read from their end."""
    kind, *rest = p
    if kind == "set":
        return p
    parts = [mirrored(x) for x in rest]
    return (kind, *(parts[::-1] if kind == "cat" else parts))


@cache
def _compiled(rules: tuple[Rule, ...]) -> tuple:
    whole = compile_rules([r.pattern for r in rules], True)
    each, back = [], []
    for r in rules:
        d = compile_rules([r.pattern], False)
        cls = d.byte_class.tolist()
        rows = d.next.reshape(-1, d.classes).tolist()
        accept = [bool(x) for x in d.accept]
        if any(accept[s] and not accept[t] and t != d.dead for s, row in enumerate(rows) for t in row):
            raise ValueError(f"the rule {r.kind} may go on after a match without matching")
        each.append(([[row[c] for c in cls] for row in rows], accept, d.dead))
        back.append(compile_rules([mirrored(r.pattern)], True))
    to_start = (whole.next.reshape(-1, whole.classes) == 0).all(axis=0)
    return whole, to_start[whole.byte_class], each, back


def trace(auto: Automaton, cls: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The automaton's state after each byte; every segment begins in state 0."""
    out = np.zeros(len(cls), np.uint16)
    order = np.argsort(starts - ends, kind="stable")
    at, left = starts[order], (ends - starts)[order]
    state = np.zeros(len(at), np.intp)
    step = auto.next
    t, live = 0, len(at)
    while live > 24:
        here = at[:live] + t
        state = step[state[:live] * auto.classes + cls[here]].astype(np.intp)
        out[here] = state
        t += 1
        live = int(np.searchsorted(-left, -t, "left"))  # those with left > t
        state = state[:live]
    rows = step.reshape(-1, auto.classes).tolist()
    for i in range(live):  # the few longest, byte by byte
        s, a, b = int(state[i]), int(at[i]) + t, int(at[i] + left[i])
        got = []
        for c in cls[a:b].tolist():
            s = rows[s][c]
            got.append(s)
        out[a:b] = got
    return out


def _matches(dfa: tuple, data: bytes, starts: list[int]) -> Iterator[tuple[int, int]]:
    """Leftmost, longest, non-overlapping; starts are the bytes at which a match begins, in order."""
    rows, accept, dead = dfa
    done, n = 0, len(data)
    for at in starts:
        if at < done:
            continue
        s, i = 0, at
        while i < n:
            s = rows[s][data[i]]
            if s == dead:
                break
            i += 1
            if accept[s]:
                done = i
        yield at, done


def scan(buf: np.ndarray, offs: np.ndarray, rules: tuple[Rule, ...] = RULES, compiled: tuple | None = None) -> dict[int, list[tuple[int, int, int]]]:
    """text number -> [(start, end, rule number)] in bytes of the text, sorted; only texts with spans."""
    auto, cuts, each, back = compiled or _compiled(rules)
    if not len(buf):
        return {}
    cut = cuts[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    edge[1:] |= cut
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[:-1], bounds[1:]
    wide = ends - starts > 1
    starts, ends = starts[wide], ends[wide]
    marks = auto.accept[trace(auto, auto.byte_class[buf], starts, ends)]
    at = np.flatnonzero(marks)
    segment = np.searchsorted(starts, at, "right") - 1
    hits = np.zeros(len(starts), np.uint32)
    np.bitwise_or.at(hits, segment, marks[at])
    found: dict[int, list[tuple[int, int, int]]] = {}
    for r, rule in enumerate(rules):
        own = np.flatnonzero(hits >> np.uint32(r) & np.uint32(1))
        if not len(own):
            continue
        # The segments of this rule, side by side and from their ends.
        size = ends[own] - starts[own]
        last = np.cumsum(size)
        first = last - size
        place = np.arange(int(last[-1])) - np.repeat(first, size)
        mirror = back[r].byte_class[buf[np.repeat(ends[own] - 1, size) - place]]
        begins = back[r].accept[trace(back[r], mirror, first, last)] > 0
        for s, f, e in zip(own.tolist(), first.tolist(), last.tolist(), strict=True):
            a, b = int(starts[s]), int(ends[s])
            text = int(np.searchsorted(offs, a, "right")) - 1
            base, data = a - int(offs[text]), buf[a:b].tobytes()
            for x, y in _matches(each[r], data, (e - f - 1 - np.flatnonzero(begins[f:e])[::-1]).tolist()):
                if (_value_length(data[x:y]) if rule.kind == "assign" else y - x) >= rule.least:
                    found.setdefault(text, []).append((base + x, base + y, r))
    return {k: sorted(v, key=lambda m: (m[0], m[2], m[1])) for k, v in found.items()}


def _value_length(match: bytes) -> int:
    """Bytes after the first ":" or "=", spaces and an optional quote."""
    cut = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    rest = match[cut + 1 :].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte spans as code point spans."""
    if data.isascii():
        return spans
    before = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(int(before[a]), int(before[b]), r) for a, b, r in spans]


_BASE = ("assign", "access", "hex")


def _scanner():
    compiled = _compiled(RULES)  # on the driver, once; workers get the arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [r.kind for r in RULES]
        for rb, buf, offs in text_chunks(batches, "text", 4 << 20):
            found = scan(buf, offs, compiled=compiled)
            spans = [code_points(buf[offs[i] : offs[i + 1]].tobytes(), found[i]) if i in found else [] for i in range(rb.num_rows)]
            rows = [[{"kind": kinds[r], "start": a, "end": b} for a, b, r in x] for x in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, start, end; by start, then the rules' order): one row for each row of docs."""
    docs = narrow(docs, doc_id=id_col, text=text_col)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scanner(), "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The query's columns, from the operator's spans."""
    found = find_secrets(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*_BASE))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in _BASE]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact_text(text: str, spans: list) -> str:
    """Each span becomes [kind]; overlapping spans become one, of the first one's kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redactor():
    compiled = _compiled(RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb, buf, offs in text_chunks(batches, "text", 4 << 20):
            found = scan(buf, offs, compiled=compiled)
            if found:
                i = rb.schema.get_field_index("text")
                texts = rb.column(i).to_pylist()
                for k, spans in found.items():
                    texts[k] = redact_text(texts[k], [(RULES[r].kind, a, b) for a, b, r in code_points(buf[offs[k] : offs[k + 1]].tobytes(), spans)])
                rb = rb.set_column(i, rb.schema.field(i), pa.array(texts, rb.schema.field(i).type))
            yield rb

    return run


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with the column ``text`` redacted; all other columns as they are."""
    return docs.mapInArrow(_redactor(), docs.schema)
