"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

The windows of the benchmark items (``n`` consecutive words; a shorter item is
one window) become a sorted array of hashes that every task gets by broadcast.
Tasks scan the word windows of the training texts, compare the words of every
hash hit, and mark the words of verified hits.

The broadcast is bounded: items are dealt to blocks of about ``block_bytes`` of
text, the documents pass through one scan for each block, and a benchmark of more
than ``most_bytes`` is an error. No shuffle is needed. Spans are removed once all blocks
have been searched, so the blocks make no difference to the result.

Defined results: a null or empty text has no words and is never contaminated;
rows are judged one by one, so repeated ids give repeated rows; an empty
benchmark marks nothing and an empty table gives an empty one; items of null text
have no windows; texts of any length are searched whole, in time proportional to
it; columns of the input stay, but :func:`contamination` replaces those named like
its three results.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays

#: Bytes that make up words after A-Z are lower-cased: digits, a-z, and all of other scripts.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
_TABLE = arrays.byte_table(10)
#: Text of benchmark items that one broadcast holds.
BLOCK_BYTES = 8_000_000
#: Text of all items together.
MOST_BYTES = 256_000_000
#: Results of :func:`contamination`.
RESULTS = ("n_words", "hit_spans", "hit_items")


class Windows:
    """The hash set of one block: windows by length, and the items in which each occurs."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        found: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            raw = arrays.LOWER[np.frombuffer(text.encode(), np.uint8)]
            starts, ends, _ = arrays.words(raw, np.array([0, len(raw)]), WORD)
            line = [raw[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
            size = min(n, len(line))
            for k in range(len(line) - size + 1 if size else 0):
                found[size][b" ".join(line[k : k + size])].add(item)
        self.sets = {size: self._table(texts) for size, texts in found.items()}

    @staticmethod
    def _table(texts: dict[bytes, set[str]]):
        rows = []
        for text, items in texts.items():
            raw = np.frombuffer(text, np.uint8)
            starts, ends, _ = arrays.words(raw, np.array([0, len(raw)]), WORD)
            h = arrays.window_hashes(arrays.span_hashes(raw, starts, ends, _TABLE), len(starts))
            rows.append((int(h[0]), text, sorted(items)))
        rows.sort()
        return np.array([r[0] for r in rows], np.uint64), [r[1] for r in rows], [r[2] for r in rows]


def _hits(raw, starts, ends, hashes, first, windows: Windows):
    """Verified hits: first word, word after the last, items."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for size, (known, texts, items) in windows.sets.items():
        h = arrays.window_hashes(hashes, size)
        if not len(h):
            continue
        small = np.zeros(1 << 20, bool)
        small[(known >> np.uint64(44)).astype(np.int64)] = True
        at = np.flatnonzero(small[(h >> np.uint64(44)).astype(np.int64)])
        at = at[rows[at] == rows[at + size - 1]]
        left = np.searchsorted(known, h[at], side="left")
        right = np.searchsorted(known, h[at], side="right")
        for i, a, b in zip(at[left < right], left[left < right], right[left < right], strict=True):
            text = b" ".join(raw[starts[k] : ends[k]].tobytes() for k in range(i, i + size))
            for j in range(a, b):
                if texts[j] == text:
                    yield int(i), int(i) + size, items[j]


def _scan(column: pa.Array, windows: Windows):
    """For every row: number of words, hit spans of words (merged), the items."""
    data, offsets = arrays.column_bytes(column)
    for a, b in arrays.chunks(offsets):
        raw = arrays.LOWER[data[offsets[a] : offsets[b]]]
        own = offsets[a : b + 1] - offsets[a]
        starts, ends, first = arrays.words(raw, own, WORD)
        hashes = arrays.span_hashes(raw, starts, ends, _TABLE)
        found: dict[int, list] = defaultdict(list)
        for s, e, items in _hits(raw, starts, ends, hashes, first, windows):
            found[int(np.searchsorted(first, s, side="right")) - 1].append((s, e, items))
        for row in range(b - a):
            hit, base = found.get(row, []), int(first[row])
            spans: list[list[int]] = []
            for s, e, _ in sorted(hit, key=lambda x: x[:2]):
                if spans and s - base <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e - base)
                else:
                    spans.append([s - base, e - base])
            yield int(first[row + 1] - base), spans, sorted({i for *_, items in hit for i in items})


def blocks(benchmark: DataFrame, n: int, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, most_bytes: int = MOST_BYTES) -> list:
    """Broadcast window sets of bounded size that together hold the whole benchmark."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the benchmark has {size} bytes of text, more than the {most_bytes} that are broadcast")
    count = -(-size // block_bytes)
    part = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(count, 1))))
    return [spark.sparkContext.broadcast(Windows([(r.item, r.text) for r in part.where(F.col("block") == k).collect()], n)) for k in range(count)]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", into: tuple[str, str, str] = RESULTS, **options) -> DataFrame:
    """``docs`` with n_words, hit_spans (word ranges, merged by block) and hit_items (sorted as strings), or the names in ``into``."""
    spans = "array<struct<first:int,last:int>>"
    out = docs.withColumns(dict(zip(into, (F.lit(None).cast("bigint"), F.array().cast(spans), F.array().cast("array<string>")), strict=True)))
    sets = blocks(benchmark, n, **options) or [docs.sparkSession.sparkContext.broadcast(Windows([], n))]
    kinds = (pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.list_(pa.string()))
    for block in sets:

        def work(batch: pa.RecordBatch, block=block) -> pa.RecordBatch:
            made: tuple[list, list, list] = ([], [], [])
            before = [batch.column(c) for c in into[1:]]
            for k, (words, hits, names) in enumerate(_scan(batch.column(text_col), block.value)):
                made[0].append(words)
                made[1].append(before[0][k].as_py() + [{"first": s, "last": e} for s, e in hits])
                made[2].append(sorted({*before[1][k].as_py(), *names}))
            new = {c: pa.array(values, kind) for c, values, kind in zip(into, made, kinds, strict=True)}
            return pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

        out = arrays.map_batches(out, work, out.schema)
    return out


def hit_words(spans: Column) -> Column:
    """Words in the union of word ranges."""
    step = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(F.greatest(a["upto"], s["last"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(a["upto"], s["first"]))).alias("n")),
    )
    return step["n"]


def without_words(text: str, spans: list[dict]) -> str:
    """A text without the characters from the first to the last word of each word range."""
    if not spans:
        return text
    raw = text.encode()
    starts, ends, _ = arrays.words(arrays.LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]), WORD)
    out, upto, last = [], 0, -1
    for first, after in sorted((s["first"], s["last"]) for s in spans):
        if first > last:  # ranges that touch are one: what is between their words goes too
            out.append(raw[upto : int(starts[first])])
        last = max(last, after)
        upto = int(ends[last - 1])
    return b"".join([*out, raw[upto:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without the hit spans."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    mark = max((len(c) for c in docs.columns), default=0)
    into = tuple(f"{c}{'_' * mark}" for c in RESULTS)  # longer than any name of the input
    found = contamination(docs, benchmark, n, text_col, into, **options)
    if remove == "documents":
        return found.where(F.size(into[1]) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))

    names = docs.columns

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [without_words(t, s) for t, s in zip(batch.column(text_col).to_pylist(), batch.column(into[1]).to_pylist(), strict=True)]
        at = batch.schema.get_field_index(text_col)
        batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        return batch.select(names)

    return arrays.map_batches(found, work, docs.schema)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`contamination` over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        hit_words(F.col("hit_spans")).alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH word AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', CAST(item_id AS VARCHAR), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), needle AS (
  SELECT DISTINCT id AS item, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS t
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM word WHERE kind = 'b' AND len(w) > 0)
), spot AS (
  SELECT id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM word, (SELECT DISTINCT n FROM needle) WHERE kind = 'd')
), hit AS (
  SELECT id, i, spot.n, item FROM spot JOIN needle ON spot.t = needle.t AND spot.n = needle.n
), place AS (
  SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY id
), item AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM hit) GROUP BY id
)
SELECT CAST(word.id AS BIGINT) AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM word LEFT JOIN place ON word.id = place.id LEFT JOIN item ON word.id = item.id WHERE kind = 'd'
"""
