"""Media columns: a baseline JPEG reader for DC-only luminance thumbnails, and a writer that stores bytes.

The reader parses markers, Huffman-decodes the scans and keeps each luminance block's DC coefficient: one
thumbnail sample a block. Restart intervals decode side by side, a numpy lane each. The writer
stores a payload losslessly: each byte is one 8x8 block whose DC coefficient, at a quantiser of 8, is the
byte less 128, so that the thumbnail is the payload; a row of MCUs is a restart interval.

Cases: null and empty texts are 192 spaces; equal texts give equal values; repeated rows give repeated
results; an empty table gives an empty result; extra columns are ignored. Payloads beyond a frame's
65535 lines are several frames, one after the other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm._common import narrow, text_chunks

UNIT = 192
#: Rows of a frame: 65535 lines at most, eight to a row.
FRAME = UNIT * (65535 // 8)
#: The standard's luminance DC codes (counts by length 1 to 16, then symbols), and its four-bit end of block as the only AC code.
DC_COUNTS, DC_SYMBOLS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
AC_COUNTS, AC_SYMBOLS = (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (0,)


def canonical(counts, symbols) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup(counts, symbols) -> np.ndarray:
    """By the next 16 bits: length << 8 | symbol; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int64)
    for symbol, code, length in canonical(counts, symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    quant = bytes([0]) + bytes([8]) + bytes([1]) * 63
    frame = struct.pack(">BHHB", 8, rows * 8, UNIT * 8, 1) + bytes([1, 0x11, 0])
    tables = bytes([0x00, *DC_COUNTS, *DC_SYMBOLS]) + bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])
    return b"\xff\xd8" + _segment(0xDB, quant) + _segment(0xC0, frame) + _segment(0xC4, tables) + _segment(0xDD, struct.pack(">H", UNIT)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


_CODE = np.zeros(12, np.int64)
_LENGTH = np.zeros(12, np.int64)
for _s, _c, _l in canonical(DC_COUNTS, DC_SYMBOLS):
    _CODE[_s], _LENGTH[_s] = _c, _l
_CATEGORY = np.array([abs(d).bit_length() for d in range(-255, 256)], np.int64)
# By difference + 255: the bits of a whole block (DC code, magnitude, end of block "0") and their number.
_DIFF = np.arange(-255, 256)
_BITS = _LENGTH[_CATEGORY] + _CATEGORY + 1
_BLOCK = ((_CODE[_CATEGORY] << _CATEGORY) | np.where(_DIFF >= 0, _DIFF, _DIFF + (1 << _CATEGORY) - 1)) << 1


def entropy_rows(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of rows of UNIT samples, stuffed: (all bytes, bytes of each row)."""
    rows = payload.reshape(-1, UNIT).astype(np.int64) - 128
    diff = np.diff(rows, axis=1, prepend=0) + 255
    bits, block = _BITS[diff], _BLOCK[diff]
    ends = np.cumsum(bits, axis=1)
    size = -(-ends[:, -1] // 8)
    base = np.cumsum(size) - size
    at = ends - bits + (base * 8)[:, None]
    word = (block << (32 - bits - (at & 7))).reshape(-1)
    at = (at >> 3).reshape(-1)
    total = int(size.sum())
    out = np.zeros(total + 4, np.float64)
    for k in range(4):
        out += np.bincount(at + k, weights=(word >> (24 - 8 * k)) & 0xFF, minlength=total + 4)
    out = out[:total].astype(np.uint8)
    pad = (size * 8 - ends[:, -1]).astype(np.int64)
    out[base + size - 1] |= ((1 << pad) - 1).astype(np.uint8)
    ff = out == 0xFF
    if ff.any():
        extra = np.add.reduceat(ff.astype(np.int64), base)
        stuffed = np.zeros(total + int(ff.sum()), np.uint8)
        stuffed[np.arange(total) + np.cumsum(ff) - ff] = out
        return stuffed, size + extra
    return out, size


def encode(payload: np.ndarray, entropy: tuple[np.ndarray, np.ndarray] | None = None) -> bytes:
    """Frames that hold the payload (a positive multiple of UNIT bytes)."""
    coded, size = entropy or entropy_rows(payload)
    ends = np.cumsum(size)
    rows = len(size)
    out = []
    for lo in range(0, rows, FRAME // UNIT):
        hi = min(rows, lo + FRAME // UNIT)
        out.append(_header(hi - lo))
        a = int(ends[lo - 1]) if lo else 0
        body = coded[a : int(ends[hi - 1])]
        mark = ends[lo : hi - 1] - a  # a restart marker after each row but the last
        full = np.empty(len(body) + 2 * len(mark), np.uint8)
        where = mark + 2 * np.arange(len(mark))
        plain = np.ones(len(full), bool)
        plain[where], plain[where + 1] = False, False
        full[plain] = body
        full[where], full[where + 1] = 0xFF, 0xD0 + np.arange(len(mark)) % 8
        out += [full.tobytes(), b"\xff\xd9"]
    return b"".join(out)


class Frame:
    """A parsed frame: its size, tables and restart intervals (begin, end in the data)."""

    def __init__(self) -> None:
        self.quant, self.huff, self.parts = {}, {}, {}
        self.height = self.width = self.interval = 0
        self.scan: list[tuple[int, int, int]] = []
        self.spans: list[tuple[int, int]] = []

    @property
    def shape(self) -> tuple[int, int]:
        """Blocks of the first component: rows and columns that the picture covers."""
        c = self.scan[0][0]
        high, wide = max(p[1] for p in self.parts.values()), max(p[0] for p in self.parts.values())
        h, v, _ = self.parts[c]
        return -(-(-(-self.height * v // high)) // 8), -(-(-(-self.width * h // wide)) // 8)


def parse(data: bytes) -> list[Frame]:
    """All frames of data. Baseline, 8 bits, all components in one scan; anything else is a ValueError."""
    raw, out, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        frame = Frame()
        while True:
            if data[at] != 0xFF:
                raise ValueError("no marker")
            marker = data[at + 1]
            if marker == 0xD9:
                at += 2
                break
            n = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xDB:
                i = 0
                while i < len(body):
                    wide = body[i] >> 4
                    frame.quant[body[i] & 15] = struct.unpack_from(">H" if wide else ">B", body, i + 1)[0]
                    i += 129 if wide else 65
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    counts = tuple(body[i + 1 : i + 17])
                    frame.huff[body[i]] = (counts, tuple(body[i + 17 : i + 17 + sum(counts)]))
                    i += 17 + sum(counts)
            elif marker == 0xC0:
                bits, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8:
                    raise ValueError("not 8 bits")
                frame.parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("not baseline")
            elif marker == 0xDD:
                frame.interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                frame.scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                if len(frame.scan) != len(frame.parts):
                    raise ValueError("components in several scans")
                ff = np.flatnonzero(raw[at:] == 0xFF) + at
                ff = ff[ff + 1 < len(raw)]
                follow = raw[ff + 1]
                stop = ff[(follow != 0) & ((follow < 0xD0) | (follow > 0xD7))]
                end = int(stop[0]) if len(stop) else len(data)
                cuts = ff[(follow >= 0xD0) & (follow <= 0xD7) & (ff < end)].tolist()
                frame.spans = list(zip([at, *[c + 2 for c in cuts]], [*cuts, end], strict=True))
                at = end
        out.append(frame)
    return out


def _unstuffed(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes without stuffing, each with 8 bytes of ones behind; begins of each."""
    size = ends - begins
    base = np.cumsum(size) - size
    at = np.repeat(begins - base, size) + np.arange(int(size.sum()))
    body = raw[at]
    keep = np.ones(len(body), bool)
    keep[1:] = ~((body[1:] == 0) & (body[:-1] == 0xFF))
    keep[base[size > 0]] = True
    less = np.add.reduceat(keep.astype(np.int64), base) if len(base) else size
    to = np.cumsum(less + 8) - less - 8
    out = np.full(int((less + 8).sum()), 0xFF, np.uint8)
    kept = body[keep]
    out[np.repeat(to - (np.cumsum(less) - less), less) + np.arange(len(kept))] = kept
    return out, to


_TABLES: dict[tuple, np.ndarray] = {}


def _table(spec: tuple) -> np.ndarray:
    if spec not in _TABLES:
        if len(_TABLES) > 64:
            _TABLES.clear()
        _TABLES[spec] = lookup(*spec)
    return _TABLES[spec]


def decode_lanes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, blocks: list[tuple[int, tuple, tuple]], mcus: np.ndarray) -> np.ndarray:
    """DC coefficients of restart intervals with the same tables: (lanes, most MCUs, blocks of an MCU).

    blocks: of an MCU, in order, (component, DC table, AC table). mcus: how many each lane holds.
    """
    data, base = _unstuffed(raw, begins, ends)
    wide = (data[:-3].astype(np.uint32) << 24) | (data[1:-2].astype(np.uint32) << 16) | (data[2:-1].astype(np.uint32) << 8) | data[3:]
    lanes, most = len(begins), int(mcus.max(initial=0))
    out = np.zeros((most, len(blocks), lanes), np.int16)
    at = base * 8
    limit = (len(wide) - 1) * 8
    pred = {c: np.zeros(lanes, np.int64) for c, _, _ in blocks}
    even = bool((mcus == most).all())

    def peek(at: np.ndarray) -> np.ndarray:
        return (wide[at >> 3].astype(np.int64) >> (16 - (at & 7))) & 0xFFFF

    tables = [(c, _table(dc), _table(ac)) for c, dc, ac in blocks]
    for m in range(most):
        live = None if even else np.flatnonzero(mcus > m)
        for k, (c, dc, ac) in enumerate(tables):
            pos = at if live is None else at[live]
            code = dc[peek(pos)]
            if not code.all():
                raise ValueError("bad code")
            cat = code & 0xFF
            pos = pos + (code >> 8)
            value = peek(pos) >> (16 - cat)
            value = np.where(value < (1 << cat >> 1), value - (1 << cat) + 1, value)
            pos = pos + cat
            if live is None:
                pred[c] += value
                out[m, k] = pred[c]
            else:
                pred[c][live] += value
                out[m, k, live] = pred[c][live]
            todo, seen = None, np.zeros(len(pos), np.int64)
            while True:  # AC codes up to the end of block or the 63rd coefficient
                code = ac[peek(pos if todo is None else pos[todo])]
                if not code.all():
                    raise ValueError("bad code")
                step = (code >> 8) + (code & 15)
                if todo is None:
                    pos = pos + step
                    if not (code & 0xFF).any():
                        break
                    todo = np.arange(len(pos))
                else:
                    pos[todo] += step
                seen[todo] += ((code >> 4) & 15) + 1
                todo = todo[((code & 0xFF) != 0) & (seen[todo] < 63)]
                if not len(todo):
                    break
                if (pos > limit).any():
                    raise ValueError("truncated scan")
            if live is None:
                at = pos
            else:
                at[live] = pos
        if (at > limit).any():
            raise ValueError("truncated scan")
    return out.transpose(2, 0, 1)


def thumbnails(files: list[bytes]) -> list[list[np.ndarray]]:
    """DC-only luminance thumbnails of each file's frames: uint8, one sample for each 8x8 block. Like intervals of all files decode together."""
    raw = np.frombuffer(b"".join(files), np.uint8)
    groups: dict[tuple, list[tuple[int, int, int, int, int]]] = {}
    frames: list[list[Frame]] = []
    made: dict[tuple[int, int], list[np.ndarray]] = {}
    start = 0
    for f, data in enumerate(files):
        frames.append(parse(data))
        for g, frame in enumerate(frames[-1]):
            high, wide = max(p[1] for p in frame.parts.values()), max(p[0] for p in frame.parts.values())
            alone = len(frame.scan) == 1
            blocks = tuple((c, frame.huff[d], frame.huff[16 | a]) for c, d, a in frame.scan for _ in range(1 if alone else frame.parts[c][0] * frame.parts[c][1]))
            rows, cols = frame.shape if alone else (-(-frame.height // (8 * high)), -(-frame.width // (8 * wide)))
            total = rows * cols
            step = frame.interval or total
            if len(frame.spans) != -(-total // step):
                raise ValueError("restart intervals don't fit the size")
            made[f, g] = [None] * len(frame.spans)
            for i, (a, b) in enumerate(frame.spans):
                groups.setdefault(blocks, []).append((start + a, start + b, min(step, total - i * step), f * 65536 + g, i))
        start += len(data)
    for blocks, lanes in groups.items():
        begins, ends, mcus = (np.array(x, np.int64) for x in list(zip(*lanes, strict=True))[:3])
        dc = decode_lanes(raw, begins, ends, list(blocks), mcus)
        for lane, (_, _, n, key, i) in enumerate(lanes):
            made[divmod(key, 65536)][i] = dc[lane, :n]
    out = []
    for f, own in enumerate(frames):
        out.append([])
        for g, frame in enumerate(own):
            dc = np.concatenate(made[f, g])
            c = frame.scan[0][0]
            h, v, q = frame.parts[c]
            if len(frame.scan) == 1:
                h = v = 1
            rows, cols = frame.shape
            wide = max(p[0] for p in frame.parts.values())
            across = cols if len(frame.scan) == 1 else -(-frame.width // (8 * wide))
            y = dc[:, : h * v].reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)[:rows, :cols]
            level = np.floor_divide(y.astype(np.int64) * frame.quant[q] + 4, 8) + 128
            out[-1].append(np.clip(level, 0, 255).astype(np.uint8))
    return out


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8x8 reduction are above its mean."""
    r = np.minimum(np.arange(8) * thumb.shape[0] // 8, thumb.shape[0] - 1)
    c = np.arange(9) * thumb.shape[1] // 8
    sums = np.concatenate((np.zeros((thumb.shape[0], 1), np.int64), np.cumsum(thumb, axis=1, dtype=np.int64)), axis=1)
    part = sums[:, c[1:]] - sums[:, c[:-1]] if thumb.shape[1] >= 8 else np.repeat(sums[:, -1:], 8, axis=1)
    tall = np.concatenate((np.zeros((1, 8), np.int64), np.cumsum(part, axis=0)))
    to = np.maximum(r + 1, np.append(r[1:], thumb.shape[0]))
    cells = (tall[to] - tall[r]) / (to - r)[:, None]
    return f"{int(''.join('1' if x else '0' for x in (cells > cells.mean()).reshape(-1)), 2):016x}"


def padded(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text's bytes and spaces up to a positive multiple of UNIT: (all bytes, offsets)."""
    size = np.diff(offs)
    to = np.concatenate(([0], np.cumsum(np.maximum(1, -(-size // UNIT)) * UNIT)))
    out = np.full(int(to[-1]), 32, np.uint8)
    out[np.repeat(to[:-1] - offs[:-1], size) + np.arange(len(buf))] = buf
    return out, to


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb, buf, offs in text_chunks(batches, "text"):
        payload, to = padded(buf, offs)
        coded, size = entropy_rows(payload)
        ends = np.concatenate(([0], np.cumsum(size)))
        files = []
        for a, b in zip((to[:-1] // UNIT).tolist(), (to[1:] // UNIT).tolist(), strict=True):
            files.append(encode(payload[a * UNIT : b * UNIT], (coded[ends[a] : ends[b]], size[a:b])))
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(np.diff(offs)), pa.array(files, pa.large_binary()).cast(pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as JPEG frames whose thumbnail is its padded bytes."""
    docs = narrow(docs, doc_id=id_col, text=text_col)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        at = 0
        while at < rb.num_rows:
            to, room = at, 0
            while to < rb.num_rows and (to == at or room < 3 << 20):
                room += len(rb.column(2)[to].as_buffer())
                to += 1
            part = rb.slice(at, to - at)
            at = to
            files = part.column(2).to_pylist()
            rows = []
            for data, thumbs in zip(files, thumbnails(files), strict=True):
                payload = b"".join(t.tobytes() for t in thumbs)
                h, w = sum(t.shape[0] for t in thumbs) * 8, thumbs[0].shape[1] * 8
                whole = thumbs[0] if len(thumbs) == 1 else np.concatenate(thumbs)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"{w}x{h}:{average_hash(whole)}"))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in cols]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_features(media: DataFrame) -> DataFrame:
    """From doc_id, n_bytes, media: size and hash of the thumbnail's samples and of the file, and the dimensions with the thumbnail's average hash."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
