"""Language identification with string kernels.

The kernel of two texts is the blended spectrum over byte n-grams of 1 to 4
bytes of the lower-cased letters (other characters count as one blank):
``k(x, y) = sum_n |P_n(x) & P_n(y)| / sqrt(|P_n(x)| |P_n(y)|)`` with ``P_n`` the
*set* of n-grams that are present, taken within the n-grams of the landmarks.
A bounded sample of landmark texts per language gives the Nystroem map, and
one-versus-rest kernel ridge regression is solved in it: tasks send the normal
equations (landmarks x landmarks) of the training sample, never its texts.
Scoring a batch is two matrix products: presence x landmarks, kernel x weights.

Bounds (parameters): ``grams`` n-grams of each order, those of most landmarks;
``landmarks`` (over all languages ``most_landmarks``, or
one each) and ``sample`` rows per language of the ``most_languages`` most frequent
labels, chosen by
the least hash of their text among distinct texts of up to ``fit_chars`` characters,
or among the longer ones where a language has no shorter. What is predicted is always
the whole text, in time proportional to its length.

Defined results: null text and text without a letter are ``und`` with score 0;
so is everything if there is nothing to learn from; ties take the first
language in order; equal texts get equal predictions; columns of the input
stay, but for those named like the two results, which are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrays, durable

ORDERS = (1, 2, 3, 4)
#: N-grams of each order in the kernel at most.
GRAMS = 6000
_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_OTHER = re.compile(rb"[^a-z\x80-\xff]+")
#: Slots for n-grams of each order; grams of up to two bytes have slots of their own.
_SLOTS = {1: 1 << 8, 2: 1 << 16, 3: 1 << 20, 4: 1 << 20}
_ODD = np.uint32(2654435761)


def letters(text: str | None) -> bytes | None:
    """Lower-cased letters with single blanks between and around; None if there is no letter."""
    if not text:
        return None
    raw = text.encode()
    if not _ASCII_LETTER.search(raw) and not _LETTER.search(text):
        return None
    return b" " + _OTHER.sub(b" ", text.lower().encode()).strip() + b" "


def _slots(data: np.ndarray, n: int) -> np.ndarray:
    """The slot of the n-gram that begins at each byte."""
    code = data[: len(data) - n + 1].astype(np.uint32)
    for k in range(1, n):
        code = (code << np.uint32(8)) | data[k : len(data) - n + 1 + k]
    return code if n < 3 else (code * _ODD) >> np.uint32(12)


class Kernel:
    """Blended-spectrum presence kernel against fixed landmarks."""

    def __init__(self, landmarks: list[bytes], most: int = GRAMS):
        self.tables, self.width, blocks = {}, 0, []
        for n in ORDERS:
            own = [np.unique(_slots(np.frombuffer(x, np.uint8), n)) for x in landmarks]
            known, count = np.unique(np.concatenate(own), return_counts=True)
            # The n-grams of at least two landmarks, the most frequent first if they are too many.
            known = np.sort(known[np.lexsort((known, -count))][: min(most, max(1, int((count > 1).sum())))])
            table = np.full(_SLOTS[n], -1, np.int16)
            table[known] = np.arange(len(known), dtype=np.int16)
            block = np.zeros((len(landmarks), len(known)), np.float32)
            for row, slots in enumerate(own):
                at = table[slots]
                block[row, at[at >= 0]] = 1
            self.tables[n] = (table, len(known))
            blocks.append(block / np.sqrt(np.maximum(block.sum(1, keepdims=True), 1)))
        self.blocks = [np.ascontiguousarray(b.T) for b in blocks]

    def rows(self, texts: list[bytes]) -> np.ndarray:
        """Kernel values: texts x landmarks."""
        out = np.zeros((len(texts), self.blocks[0].shape[1]), np.float32)
        raw = [np.frombuffer(x, np.uint8) for x in texts]
        for n, block in zip(ORDERS, self.blocks, strict=True):
            table, width = self.tables[n]
            seen = np.zeros((len(texts), width + 1), np.float32)
            for row, data in enumerate(raw):
                if len(data) >= n:
                    seen[row, table[_slots(data, n)]] = 1
            seen = seen[:, :width]
            norm = np.sqrt(np.maximum(seen.sum(1, keepdims=True), 1))
            out += (seen @ block) / norm
        return out


class Model:
    """Languages, kernel and ridge weights."""

    def __init__(self, languages: list[str], kernel: Kernel | None, weights: np.ndarray | None):
        self.languages, self.kernel, self.weights = languages, kernel, weights

    def predict(self, texts: list[str | None], block: int = 128) -> tuple[list[str], list[float]]:
        clean = [letters(x) for x in texts]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        full = [k for k, x in enumerate(clean) if x is not None] if self.kernel else []
        for at in range(0, len(full), block):
            part = full[at : at + block]
            margin = self.kernel.rows([clean[k] for k in part]).astype(np.float64) @ self.weights
            best = np.argmax(np.round(margin, 5), axis=1)
            score = np.clip((margin[np.arange(len(part)), best] + 1) / 2, 0, 1)
            for k, b, s in zip(part, best, score, strict=True):
                names[k], scores[k] = self.languages[b], round(float(s), 4)
        return names, scores


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", landmarks: int = 48, sample: int = 900, fit_chars: int = 20_000, most_landmarks: int = 1200, most_languages: int = 1000, grams: int = GRAMS, ridge: float = 1e-3) -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("short", F.length("text") <= fit_chars)
    # The rows of least hash, found among a share of each language's rows that is about four times as large; copies count once.
    most = landmarks + sample
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.count_if("short").alias("short")).orderBy(F.desc("rows"), "lang").limit(most_languages).collect()
    table = spark.createDataFrame([(r.lang, max(1.0, (r.short or r.rows) / (4.0 * most)), r.short == 0) for r in counts], "lang string, one_of double, long boolean")
    share = rows.join(F.broadcast(table), "lang").where(F.col("short") | F.col("long")).withColumn("order", F.xxhash64("text")).where(F.pmod("order", F.lit(1 << 40)) < F.lit(float(1 << 40)) / F.col("one_of"))
    share = share.groupBy("lang", "order").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("order", F.lit(1 << 40)), "text"))
    chosen = durable.keep(share.withColumn("nth", nth).where(F.col("nth") <= most))
    own = chosen.where(F.col("nth") <= max(1, min(landmarks, most_landmarks // max(1, chosen.select("lang").distinct().count())))).orderBy("lang", "nth").collect()
    languages = sorted({r.lang for r in own})
    if not languages:
        return Model([], None, None)
    kernel = Kernel([letters(r.text) for r in own if letters(r.text)], grams)
    shared = spark.sparkContext.broadcast((kernel, languages))
    size = kernel.blocks[0].shape[1]

    def equations(batches):
        inner, right = np.zeros((size, size)), np.zeros((size, len(languages)))
        known, names = shared.value
        index = {x: k for k, x in enumerate(names)}
        for batch in batches:
            texts = [(letters(t), index.get(x)) for x, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            texts = [x for x in texts if x[0] is not None and x[1] is not None]
            for at in range(0, len(texts), 128):
                part = texts[at : at + 128]
                values = known.rows([x[0] for x in part]).astype(np.float64)
                target = np.full((len(part), len(names)), -1.0)
                target[np.arange(len(part)), [x[1] for x in part]] = 1
                inner += values.T @ values
                right += values.T @ target
        yield pa.RecordBatch.from_arrays([pa.array([inner.tobytes()]), pa.array([right.tobytes()])], names=["inner", "right"])

    sums = [np.zeros((size, size)), np.zeros((size, len(languages)))]
    for row in chosen.select("lang", "text").coalesce(12).mapInArrow(arrays.tidy(equations), "inner binary, right binary").toLocalIterator():
        for total, part in zip(sums, row, strict=True):
            total += np.frombuffer(part).reshape(total.shape)
    among = kernel.rows([letters(r.text) for r in own if letters(r.text)]).astype(np.float64)
    # Ridge in the Nystroem space: the penalty is the landmarks' own kernel matrix.
    among = (among + among.T) / 2
    weights = np.linalg.solve(sums[0] + ridge * np.trace(sums[0]) / size * (among / np.trace(among) * size + np.eye(size) * 1e-3), sums[1])
    return Model(languages, kernel, weights)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.drop("lang_pred", "score")
    schema = out.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                names, scores = [], []
                for texts in arrays.pieces(batch.column(text_col)):
                    found = shared.value.predict(texts)
                    names += found[0]
                    scores += found[1]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return out.mapInArrow(arrays.tidy(run), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """A quarter of the ids, never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accepted(least: float = 0.3) -> Column:
    """Rows whose language is known: not ``und``, and some language's margin isn't far below zero."""
    return (F.col("lang_pred") != "und") & (F.col("score") >= least)


def op1_language(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
