"""Language ID by error-correcting output codes.

Every language gets a binary codeword. A linear classifier over hashed byte n-grams predicts each bit;
decoding weighs each bit's exponential loss by the bit's accuracy on the training rows and takes the nearest
codeword. A document is ambiguous where the two nearest codewords are about as far.

Training takes a bounded sample of the rows whose crc32(doc_id as text) mod 4 is not 2: a hash deals doc_ids to
``SALTS`` classes, and each class gives the ``PER_SALT`` documents of a language with the smallest hashes, so a
language has at most 448. With many languages fewer are taken, ``MOST_ROWS`` in all, but one of each language at least.
Each is reduced to ``FEATURES`` numbers on the executors. Prediction reads whole texts.

Cases: a text that is null, empty or without a letter is "und", score 0, not ambiguous; without any training
row every document is; a null doc_id is not held out and not trained on; with one language known, it is
predicted for all texts with letters; repeated rows give repeated results, and rows that repeat a doc_id and a label
are trained on once, with the least text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm._common import narrow, splitmix, text_chunks

#: The training sample's bounds: documents of a language in each class of doc_ids, classes, and rows of all languages.
PER_SALT, SALTS, MOST_ROWS = 7, 64, 16_384
FEATURES = 4096
#: Bits of a codeword at least; a random code of this length keeps codewords some 8 bits apart.
BITS = 15
HELD_OUT = 2
#: A margin under this makes a prediction ambiguous.
AMBIGUOUS = 0.05
#: Texts that are turned into features at a time.
ROWS = 256
_LETTER = regex.compile(r"\p{L}")
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def _grams(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Feature of the three bytes that begin at each position; digits count as one, bytes beyond a text's end as zero."""
    b = _LOWER[buf]
    b = np.where((b >= 48) & (b <= 57), np.uint64(48), b)
    b = np.concatenate((b, np.zeros(2, np.uint64)))
    second, third = b[1:-1].copy(), b[2:].copy()
    size, ends = np.diff(offs), offs[1:]
    second[ends[size > 0] - 1] = 0
    third[ends[size > 0] - 1] = 0
    third[ends[size > 1] - 2] = 0
    key = b[:-2] | (second << np.uint64(8)) | (third << np.uint64(16))
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)).astype(np.intp)


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """n distinct words of +1 and -1, every bit splitting the languages; a seeded draw with the largest least distance."""
    if n == 1:
        return np.ones((1, 1), np.int8)
    bits = max(bits, int(np.ceil(np.log2(n))) * 5)
    rng, best, apart = np.random.default_rng(7), None, -1
    for _ in range(200):
        words = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        flat = np.flatnonzero(np.abs(words.sum(axis=0)) == n)
        words[rng.integers(n, size=len(flat)), flat] *= -1
        least = min(int((words[i] != words[j]).sum()) for i in range(n) for j in range(i))
        if least > apart:
            best, apart = words, least
    return best


@dataclass
class Model:
    langs: list[str]
    words: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, score, ambiguous) from bit margins of shape (texts, bits)."""
        loss = np.exp(-np.clip(margins, -8, 8)[:, None, :] * self.words[None]) @ self.trust
        if len(self.langs) == 1:
            return np.zeros(len(loss), int), np.ones(len(loss)), np.zeros(len(loss), bool)
        near = np.argsort(loss, axis=1, kind="stable")[:, :2]
        first, second = np.take_along_axis(loss, near, axis=1).T
        margin = (second - first) / np.maximum(second + first, 1e-12)
        return near[:, 0], (1 + margin) / 2, margin < AMBIGUOUS


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Root frequencies of n-gram features, float32 of shape (texts, FEATURES)."""
    n = len(offs) - 1
    owner = np.repeat(np.arange(n), np.diff(offs))
    counts = np.bincount(owner * FEATURES + _grams(buf, offs), minlength=n * FEATURES).reshape(n, FEATURES)
    return np.sqrt(counts / np.maximum(1, np.diff(offs))[:, None]).astype(np.float32)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb, buf, offs in text_chunks(batches, "text", max_rows=ROWS):
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([v.astype(np.float16).tobytes() for v in features(buf, offs)], pa.binary())], names=["lang", "vector"])


def sample(docs: DataFrame, per_salt: int = PER_SALT, salts: int = SALTS, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, lang, text of the training sample: at most per_salt * salts rows of a language. docs: doc_id, text, lang."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", F.col("lang").cast("string"), "text")
    languages = usable.agg(F.count_distinct("lang")).first()[0]
    if not languages:
        return usable.limit(0)
    each = max(1, most_rows // languages)
    salts = min(salts, each)
    per_salt = min(per_salt, each // salts)
    h = F.xxhash64("doc_id")
    # The window's first step keeps per_salt rows of a group in each task, so that is all that travels.
    w = Window.partitionBy("lang", "salt").orderBy("h", "doc_id")
    picked = usable.select("doc_id", "lang", h.alias("h"), F.pmod(h, F.lit(salts)).alias("salt"))
    picked = picked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_salt)
    picked = picked.select(F.col("doc_id").alias("picked"), F.col("lang").alias("label")).distinct()
    # At most max(most_rows, languages) pairs: small enough to broadcast. A repeated doc_id joins all its rows, of which one stays.
    rows = usable.join(F.broadcast(picked), (F.col("doc_id") == F.col("picked")) & (F.col("lang") == F.col("label")), "left_semi")
    return rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def train(docs: DataFrame, **bounds: int) -> Model | None:
    """Fit on a bounded sample; None without a labelled row. docs: doc_id, text, lang."""
    rows = sample(docs, **bounds).select("lang", "text").mapInArrow(_vectors, "lang string, vector binary").collect()
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    x = np.stack([np.frombuffer(r[1], np.float16) for r in rows]).astype(np.float32)
    label = np.array([langs.index(r[0]) for r in rows])
    order = np.lexsort((x[:, 0], x.sum(axis=1), label))
    x, label = x[order], label[order]
    words = codewords(len(langs))
    target = words[label].astype(np.float32)
    weights, bias = np.zeros((FEATURES, words.shape[1]), np.float32), np.zeros(words.shape[1], np.float32)
    speed = np.float32(1.0)
    share = 1 / np.bincount(label)[label].astype(np.float32) / len(langs)  # languages count alike
    momentum = np.zeros_like(weights)
    for _ in range(200):  # logistic loss, full gradient with momentum
        pull = target / (1 + np.exp(np.clip(target * (x @ weights + bias), -30, 30))) * share[:, None]
        momentum = 0.9 * momentum + (x.T @ pull - 1e-4 * weights)
        weights += speed * 4 * momentum
        bias += speed * pull.sum(axis=0)
    right = ((x @ weights + bias) * target > 0).T @ share
    trust = np.log(np.maximum(right, 0.51) / np.maximum(1 - right, 1e-3))
    return Model(langs, words.astype(np.float32), weights, bias, trust / trust.sum())


def _predictor(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb, buf, offs in text_chunks(batches, "text", max_rows=ROWS):
            texts = rb.column(rb.schema.get_field_index("text"))
            letters = np.array([bool(t.as_py() and _LETTER.search(t.as_py())) for t in texts])
            best, score, doubt = model.decode(features(buf, offs) @ model.weights + model.bias)
            lang = [model.langs[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            cols = [pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0).astype(np.float64)), pa.array(doubt & letters)]
            yield pa.RecordBatch.from_arrays([rb.column(i) for i in range(rb.num_columns)] + cols, names=[*rb.schema.names, "lang_pred", "score", "ambiguous"])

    return predict


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (with a column text and none named lang_pred, score or ambiguous) and lang_pred, score, ambiguous."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "ambiguous": F.lit(False)})
    schema = docs.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0), "ambiguous": F.lit(False)}).schema
    for name in ("lang_pred", "score", "ambiguous"):
        schema[name].nullable = True
    return docs.mapInArrow(_predictor(model), schema)


def detect_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: one row for each row of docs."""
    docs = narrow(docs, doc_id=id_col, text=text_col, lang=lang_col)
    out = predict(docs.select(F.col("doc_id").cast("long"), "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
