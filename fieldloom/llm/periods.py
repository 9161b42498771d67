"""Periodic runs of words: stretches that repeat a block of words again and again.

A run is a stretch of consecutive words with smallest period q (words q apart are
equal) that no neighbouring word extends, of ``least`` words or more and at least
``times`` periods.

Names of power-of-two blocks (Karp, Miller and Rosenberg): equal words of a text have
one number, and two blocks of 2^k words have one number if their halves have; only
blocks that occur again get a number, and levels end where none does. The longest
common extension of two places follows from comparing numbers by descending level.
Candidates lie on a grid: where words q apart are equal over max(``least`` - q,
(``times`` - 1) q) places, one of these is a multiple of that many, so for period q
only such places are looked at, some n/2 log n over all periods. Those with equal
words are extended both ways. Stretches that several multiples of a period find
keep the smallest. There is no hash of words, no sorting of suffixes and no shuffle:
all rows of a batch are worked on together, as words of different rows have different numbers.

Defined results: a null text has no words and stays null when collapsed; an empty text has none;
repeated rows have equal results; an empty table gives an empty one; columns of
the input stay, but those named like the three results are replaced; a text is
worked on whole by one task, in time n log n squared and some 100 bytes of memory for each
of its n words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

#: Words of a run at least, and its periods.
LEAST, TIMES = 24, 3
#: Grid places that are looked at together.
PLACES = 1 << 20
#: Results of :func:`periodic_runs`.
RESULTS = ("n_words", "runs", "collapsed")
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number for each different word."""
    sizes = ends - starts
    marks = np.concatenate(([0], np.cumsum(sizes)))
    index = np.repeat(starts - marks[:-1], sizes) + np.arange(marks[-1])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(marks.astype(np.int64)), pa.py_buffer(raw[index])])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Numbers of equal keys, -1 for a key that occurs once."""
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    return np.where(count[number] > 1, number, -1).astype(np.int32)


def block_names(words: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Level k: the number of the block of 2^k words that begins at each place, -1 for blocks that occur once in their row."""
    levels = [_repeated(rows * (int(words.max(initial=0)) + 1) + words)]
    size = 1
    while (n := len(levels[-1]) - size) > 0:
        last = levels[-1]
        at = np.flatnonzero((last[:n] >= 0) & (last[size:] >= 0))
        names = _repeated(last[at].astype(np.int64) * (len(last) + 1) + last[at + size])
        if not len(at) or names.max() < 0:
            break
        level = np.full(n, -1, np.int32)
        level[at] = names
        levels.append(level)
        size *= 2
    return levels


def extension(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Equal words from places i and j (> i) on."""
    length = np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        names = levels[k]
        a, b = i + length, j + length
        inside = b < len(names)
        left = names[np.where(inside, a, 0)]
        length += (inside & (left >= 0) & (left == names[np.where(inside, b, 0)])).astype(np.int64) << k
    return length


def extension_before(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Equal words that end right before places i and j (> i)."""
    length = np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        names = levels[k]
        a, b = i - length - (1 << k), j - length - (1 << k)
        inside = (a >= 0) & (b < len(names))
        left = names[np.where(inside, a, 0)]
        length += (inside & (left >= 0) & (left == names[np.where(inside, b, 0)])).astype(np.int64) << k
    return length


def find_runs(words: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs, by start and then period. ``first``: the first word of each row, and the number of words."""
    none = np.zeros(0, np.int64)
    longest = int(np.diff(first).max(initial=0))
    if longest < max(least, times):
        return none, none, none
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    levels = block_names(words, rows)
    n, names = len(words), levels[0]
    periods = np.arange(1, longest // times + 1)
    steps = np.maximum(np.maximum(least - periods, (times - 1) * periods), 1)
    counts = -(-(n - periods) // steps)
    upto = np.concatenate(([0], np.cumsum(counts)))
    found, at = [np.zeros((0, 3), np.int64)], 0
    while at < len(periods):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + PLACES, side="right")) - 1)
        q = np.repeat(periods[at:to], counts[at:to])
        i = (np.arange(upto[to] - upto[at]) - np.repeat(upto[at:to] - upto[at], counts[at:to])) * np.repeat(steps[at:to], counts[at:to])
        met = (names[i] >= 0) & (names[i] == names[i + q])
        i, q = i[met], q[met]
        start, end = i - extension_before(levels, i, i + q), i + q + extension(levels, i, i + q)
        long = end - start >= np.maximum(least, times * q)
        if long.any():
            found.append(np.unique(np.stack((start[long], end[long], q[long]), 1), axis=0))
        at = to
    every = np.unique(np.concatenate(found), axis=0)
    # The smallest period of a stretch divides the others, and its run is the same stretch.
    own = np.ones(len(every), bool)
    own[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    every = every[own]
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    return every[:, 0], every[:, 1], every[:, 2]


def joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each row (so many by row) joined by one space: all bytes, and where rows begin."""
    sizes = ends - starts + 1
    marks = np.concatenate(([0], np.cumsum(sizes)))
    index = np.repeat(starts - marks[:-1], sizes) + np.arange(marks[-1])
    out = raw[np.minimum(index, max(len(raw) - 1, 0))] if len(raw) else np.zeros(0, np.uint8)
    lasts = marks[1:] - 1
    out[lasts] = 0x20
    # No space after a row's last word.
    words = np.cumsum(per_row)
    last_words = words[per_row > 0] - 1
    keep = np.ones(len(out), bool)
    keep[lasts[last_words]] = False
    own = np.zeros(len(per_row), np.int64)
    own[per_row > 0] = np.diff(np.concatenate(([0], marks[words[per_row > 0]]))) - 1
    return out[keep], np.concatenate(([0], np.cumsum(own)))


def _work(ids: list, column: pa.Array, least: int, times: int, rewrite):
    """For bounded parts of a batch: words by row, runs (row, start, length, period), collapsed bytes and their row marks."""
    data, offsets = arrays.column_bytes(column)
    for a, b in arrays.chunks(offsets):
        raw, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = arrays.words(raw, own, arrays.NOT_SPACE)
        words = word_numbers(raw, starts, ends)
        if rewrite:
            source = np.arange(len(words))
            for row in range(b - a):
                if (new := rewrite(ids[a + row], int(first[row + 1] - first[row]))) is not None:
                    source[first[row] : first[row + 1]] = first[row] + new
            words, starts, ends = words[source], starts[source], ends[source]
        begin, end, period = find_runs(words, first, least, times)
        rows = np.searchsorted(first, begin, side="right") - 1
        kept = ~arrays.covered(len(words), begin + period, end)
        per_row = np.diff(np.concatenate(([0], np.cumsum(kept)))[first])
        yield np.diff(first), (rows, begin - first[rows], end - begin, period), joined(raw, starts[kept], ends[kept], per_row)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, rewrite: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """``docs`` with n_words, runs (by start, then period) and collapsed: the words but those after the first period of a run, joined by one space.

    ``rewrite`` may give, for an id and a number of words, which of a text's words stand in its places.
    """
    kinds = (pa.int64(), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string())
    out = docs.withColumns(dict(zip(RESULTS, (F.lit(None).cast(k) for k in ("bigint", _RUNS, "string")), strict=True)))
    source = docs.withColumns({"_id": F.col(f"`{id_col}`"), "_text": F.col(f"`{text_col}`")}) if {id_col, text_col} & set(RESULTS) else docs
    id_name, text_name = ("_id", "_text") if source is not docs else (id_col, text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, lists, texts = [], [], []
        column = batch.column(text_name)
        for n_words, (rows, *runs), (raw, marks) in _work(batch.column(id_name).to_pylist() if rewrite else [], column, least, times, rewrite):
            counts.append(n_words)
            fields = pa.StructArray.from_arrays([pa.array(r, pa.int64()) for r in runs], [f.name for f in kinds[1].value_type])
            lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(n_words) + 1)), pa.int32()), fields))
            texts.append(pa.Array.from_buffers(pa.string(), len(n_words), [None, pa.py_buffer(marks.astype(np.int32)), pa.py_buffer(raw)]))
        text = pa.concat_arrays(texts)
        if column.null_count:
            text = pa.compute.if_else(column.is_null(), pa.scalar(None, pa.string()), text)
        new = dict(zip(RESULTS, (pa.array(np.concatenate(counts), pa.int64()), pa.concat_arrays(lists), text), strict=True))
        return pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)

    names = out.columns
    return arrays.map_batches(source, work, out.schema)


def planted(doc: int | None, n: int) -> np.ndarray | None:
    """In one document of ten, by the CRC-32 of its id: which word stands in each place once a block repeats to the end."""
    if doc is None or not n:
        return None
    g, rest = divmod(zlib.crc32(str(doc).encode()), 10)
    if rest:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    return np.where(places < a, places, a + (places - a) % p)


def op11_periods(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, with blocks repeated to the end in one of ten."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(docs, rewrite=planted)
    none = F.lit(None).cast(_RUNS.removeprefix("array<").removesuffix(">"))
    higher = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.withColumn("best", F.aggregate("runs", none, lambda best, r: F.when(higher(best, r), r).otherwise(best)))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(F.expr("(1000 * best.length) div best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")).cast("binary"), 256).alias("collapsed_sha256"),
    )
