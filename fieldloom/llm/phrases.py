"""Removal of repeated passages of words, found with Aho-Corasick automata.

A window is ``length`` consecutive words (between ASCII white space, unchanged).

1. Candidates. Anchors of windows that occur in two documents (see :mod:`repeats`)
   narrow the search; about them, windows of equal hash meet in a bucket, and runs
   of windows that another document of lesser id has become *links*: a span of a
   text and the span of the other that seems to be equal.
2. Passages. The words of each link are fetched from the document of lesser id
   and sent to the documents that are linked to it.
3. Automata. All documents pass in shards of bounded text; the passages of a
   shard's documents are compiled into one automaton over word numbers, and every
   document of the shard streams through it. A passage is removed where the
   automaton finds it: words are compared, not hashes, so a false link from a
   chance collision removes nothing.

A passage goes only to shards whose documents are linked to it, so the work grows
with the corpus and not with its square, as sending each document through the
automata of the whole corpus would.

Defined results: null text has no words and stays null; rows are judged by id and
text, so rows that repeat both have equal results; rows without an id neither
remove nor lose anything; an empty table gives an empty one; time and memory go
in proportion to the longest text; a shard has more than its bound only for one
longer document; of the input's columns the id and the text alone are returned.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, repeats

LENGTH = 50
#: Words of an anchor.
GRAM = 8
#: Text of the documents of one shard at most, unless one document has more.
SHARD_BYTES = 8_000_000
#: Parts that the requests for passages of one document are dealt to.
PARTS = 16
_TABLE = arrays.byte_table(8)


def word_chunk(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> repeats.Chunk:
    starts, ends, first = arrays.words(data, offsets, arrays.NOT_SPACE)
    return repeats.Chunk(arrays.span_hashes(data, starts, ends, _TABLE), first, length, min(GRAM, length))


class Shard:
    """An automaton of passages, each with the least document that has it."""

    def __init__(self, passages: dict[bytes, int]):
        self.numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for passage, owner in passages.items():
            # Zero stands for all words that no passage has.
            words = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in passage.split(b" "))
            self.automaton.add_word(words, (len(words), owner))
        if passages:
            self.automaton.make_automaton()

    def locate(self, words: list[bytes], doc: int | None) -> list[list[int]]:
        """Merged spans of words that are passages of documents of lesser id."""
        spans: list[list[int]] = []
        if doc is None or not self.numbers:
            return spans
        for end, (size, owner) in self.automaton.iter(tuple(map(self.numbers.get, words, repeat(0)))):
            if owner < doc:
                start = end + 1 - size
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, end + 1])
        return spans


def links(keyed: DataFrame, count: int, length: int = LENGTH) -> DataFrame:
    """Spans of words that, by the hashes of their windows, a document of lesser id has too."""

    def make(data, offsets):
        return word_chunk(data, offsets, length)

    held = keyed.join(repeats.recurring(keyed, make, count, SHARD_BYTES), "doc", "left").select("doc", "row_key", "text", "places")
    names = ["bucket", "hashes", "docs", "keys", "places", *(f"hit_{c}" for c in repeats.LINK_KINDS)]

    def windows(batches):
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column("places")))
            if not batch.num_rows:
                continue
            for _, ids, keys, chunk, marked in repeats.marked_chunks(batch, make, SHARD_BYTES):
                size = chunk.run_to[marked] - chunk.run_from[marked] + 1
                run = np.repeat(np.flatnonzero(marked), size)
                if not len(run):
                    continue
                at = chunk.run_from[run] + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
                hashes, row = arrays.window_hashes(chunk.values, length)[at], chunk.row[run]
                doc, key, place = ids[row], keys[row], (at - chunk.first[row]).astype(np.int32)
                first = repeats.least_item(hashes, doc)
                hit = np.flatnonzero(doc > doc[first])
                if len(hit):  # linked within the chunk: these only pass through
                    made = repeats.links_of(doc, key, place, (hit, first[hit]), length)
                    yield repeats.by_bucket(names, arrays.mix(made["doc"].astype(np.uint64)) % np.uint64(count), {f"hit_{c}": v for c, v in made.items()})
                left = doc == doc[first]
                yield repeats.by_bucket(names, arrays.mix(chunk.hash[run][left]) % np.uint64(count), {"hashes": hashes[left], "docs": doc[left], "keys": key[left], "places": place[left]})

    def settle(table: pa.Table) -> pa.Table:
        hashes, doc, key, place = (repeats.joined(table, c, t) for c, t in (("hashes", np.uint64), ("docs", np.int64), ("keys", np.int64), ("places", np.int32)))
        first = repeats.least_item(hashes, doc)
        hit = np.flatnonzero(doc > doc[first])
        made = repeats.links_of(doc, key, place, (hit, first[hit]), length)
        return pa.table({c: np.concatenate([repeats.joined(table, f"hit_{c}", kind), made[c]]) for c, kind in repeats.LINK_KINDS.items()})

    return held.mapInArrow(windows, repeats.binaries(names)).groupBy("bucket").applyInArrow(settle, repeats.LINKS)


def passages(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """``(doc, passages)``: the words of each text's links, as the documents of lesser id have them."""
    shift = (F.col("start") - F.col("owner_start")).alias("shift")
    runs = found.groupBy("doc", "row_key", "owner", "owner_key", shift).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    runs = runs.select("doc", "row_key", "owner", "owner_key", "shift", F.col("spans.start").alias("start"), F.col("spans.stop").alias("stop"))
    asked = "doc bigint, row_key bigint, owner bigint, owner_key bigint, low int, high int"

    def merge(batches):
        for batch in batches:
            table = pa.table(batch)
            start, stop = (table.column(c).combine_chunks() for c in ("start", "stop"))
            sizes = np.diff(start.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
            made = repeats.spans_of(row, row, start.flatten().to_numpy(), stop.flatten().to_numpy())
            at = made["doc"]
            shift = table.column("shift").to_numpy()[at]
            columns = [table.column(c).combine_chunks().take(pa.array(at)) for c in ("doc", "row_key", "owner", "owner_key")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((made["start"] - shift).astype(np.int32)), pa.array((made["stop"] - shift).astype(np.int32))], names=[x.split()[0] for x in asked.split(", ")])

    part = F.pmod(F.xxhash64("doc"), F.lit(PARTS)).alias("part")
    wanted = runs.mapInArrow(merge, asked).distinct().groupBy("owner", "owner_key", part).agg(F.collect_list(F.struct("doc", "row_key", "low", "high")).alias("asked"))
    source = keyed.join(wanted.withColumnRenamed("owner", "doc"), "doc").where(F.col("row_key") == F.col("owner_key")).select("doc", "text", "asked")
    sent = "doc bigint, row_key bigint, owner bigint, passage binary"

    def fetch(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                words = batch.column("text")[at].as_py().encode().split()
                rows = [(a["doc"], a["row_key"], b" ".join(words[a["low"] : a["high"]])) for a in batch.column("asked")[at].as_py()]
                owner = pa.array([batch.column("doc")[at].as_py()] * len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), owner, pa.array([r[2] for r in rows], pa.binary())], names=["doc", "row_key", "owner", "passage"])

    # Rows that repeat an id and a text answer once each.
    return source.mapInArrow(fetch, sent).groupBy("doc").agg(F.collect_set(F.struct("row_key", "owner", "passage")).alias("passages"))


def _shards(batch: pa.RecordBatch):
    """Rows of a batch with at most ``SHARD_BYTES`` of text, or one: ids, texts, and the automaton of their passages."""
    _, offsets = arrays.column_bytes(batch.column("text"))
    ids, keys = batch.column("doc"), batch.column("row_key")
    for a, b in arrays.chunks(offsets, SHARD_BYTES):
        least: dict[bytes, int] = {}
        for key, asked in zip(keys.slice(a, b - a).to_pylist(), batch.column("passages").slice(a, b - a).to_pylist(), strict=True):
            for p in asked or ():
                if p["row_key"] == key:
                    least[p["passage"]] = min(p["owner"], least.get(p["passage"], p["owner"]))
        yield ids.slice(a, b - a).to_pylist(), batch.column("text").slice(a, b - a).to_pylist(), Shard(least)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, n_words, n_removed, kept_sha256`` of every row: kept words joined by one blank (the text itself if none goes)."""
    keyed = repeats.with_key(docs, id_col, text_col)
    sent = passages(keyed, links(keyed, repeats.buckets(docs, text_col), length))
    whole = keyed.join(sent, "doc", "left").select("doc", "row_key", "text", "passages")
    schema = f"{id_col} bigint, {text_col} string, n_words bigint, n_removed bigint, kept_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches):
        for batch in batches:
            for ids, texts, shard in _shards(batch):
                rows = []
                for doc, text in zip(ids, texts, strict=True):
                    words = (text or "").encode().split()
                    edges = [0, *(x for span in shard.locate(words, doc) for x in span), len(words)]
                    kept = words if len(edges) == 2 else [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                    joined = b" ".join(kept)
                    rows.append((doc, text if len(kept) == len(words) else joined.decode(), len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return whole.mapInArrow(cut, schema)


def op8_phrases(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`remove_repeats` over all documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text")


ORACLE_SQL = r"""
WITH doc AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM doc WHERE len(w) >= 50)),
own AS (SELECT t, min(doc_id) AS d FROM win GROUP BY t),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN own USING (t) WHERE doc_id > d),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM doc),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM doc LEFT JOIN kept ON doc.doc_id = kept.doc_id LEFT JOIN n ON doc.doc_id = n.doc_id
"""
