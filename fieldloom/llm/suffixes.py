"""Removal of repeated byte strings by interval expansion on a Burrows-Wheeler transform.

Hashes only bring equal text together; the transform decides every span:

* Segments of text (their ends depend on the content, so copies have the same)
  whose hash occurs in two documents, and
* stretches of the windows of ``length`` bytes outside copied segments whose anchor
  (see :mod:`repeats`) occurs in two documents

come into the bucket of their hash or anchor, where all copies of a window meet. A
bucket's distinct pieces, divided by a byte that UTF-8 never has, form one text;
suffixes are sorted as far as needed and give its transform. Common prefixes are
then derived by increasing value: the interval of the empty string is extended
backward by every byte in it, breadth first, so the intervals of all strings of
one length come before those of the next; the place after an interval that has
no value yet has the length at hand as its common prefix. At ``length`` the
expansion stops: places without a value join suffixes that share a whole window,
whatever more they share. In each group so joined, windows of a document of
greater id than the least are removed.

Pieces that repeat within a chunk of documents are judged there, in the same way,
and sent once, for the document of least id. So what a very frequent passage puts
into its bucket is one entry for each chunk; a bucket is worked on in shards of
whole anchors.

Defined results: null text has no bytes and stays null; what is kept of a text
may not be whole characters, so ``kept`` is binary; rows are judged by id and text,
so rows that repeat both have equal results; rows without an id neither remove nor
lose anything; an empty table gives an empty one; time and memory go in proportion
to the longest text; of the input's columns the id alone is returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrays, repeats

LENGTH = 50
#: Bytes of an anchor: so many that texts rarely share them by chance.
GRAM = 24
_TABLE = arrays.byte_table(9)
_DIVIDE = 0xFF
#: Mean size of segments in windows (a power of two).
SEGMENT = 256
#: Bytes of documents whose windows are hashed at a time, unless one document has more.
CHUNK_BYTES = 2_000_000
#: Bytes of stretches that are worked on as one text at most, unless one anchor has more.
SHARD_BYTES = 4_000_000


def byte_chunk(data: np.ndarray, offsets: np.ndarray, skip: np.ndarray | None = None, length: int = LENGTH) -> repeats.Chunk:
    return repeats.Chunk(_TABLE[data], offsets, length, min(GRAM, length), skip)


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and stops of segments.

    A segment is a range of windows by their first byte; its ends hang on the
    bytes after them alone, so copies have the same. Segments without a window are
    left out.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    grams = arrays.window_hashes(_TABLE[data], min(GRAM, length))
    cuts = np.flatnonzero((grams & np.uint64(SEGMENT - 1)) == 0)
    full = np.flatnonzero(np.diff(offsets) >= length)
    ends = offsets[1:][full] - length + 1  # after the last window of each row
    # Cuts that lie behind a row's last window see bytes of the next row; they cut nothing.
    row = np.searchsorted(offsets, cuts, side="right") - 1
    cuts = cuts[cuts < offsets[row + 1] - length + 1]
    starts = np.unique(np.concatenate([offsets[:-1][full], cuts]))
    row = np.searchsorted(offsets, starts, side="right") - 1
    return row, starts, np.minimum(np.append(starts[1:], n), ends[np.searchsorted(full, row)])


def segments_met(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """Ranges of windows ``(doc, row_key, start, stop, hash, kind)``.

    Kind 0: removed, as judged within a chunk of documents; 1: the hash of the
    segment occurs in a document of lesser id; 2: it occurs in greater ones only.
    """
    schema = "doc bigint, row_key bigint, start int, stop int, hash bigint, judged boolean"

    def cut(batches):
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "row_key"))
            data, offsets = arrays.column_bytes(batch.column("text"))
            for a, b in arrays.chunks(offsets, CHUNK_BYTES):
                own, raw = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
                row, start, stop = segments(raw, own, length)
                raw = raw.tobytes()
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(raw[x : y + length - 1]) for x, y in zip(start.tolist(), stop.tolist(), strict=True)), np.uint64, len(start))
                doc, key, place = ids[a + row], keys[a + row], start - own[row]
                first = repeats.least_item(hashes, doc)
                copy = doc > doc[first]
                met = np.flatnonzero(np.isin(hashes, hashes[copy]))
                gone = decide(hashes[met], doc[met], key[met], place[met], [raw[x : y + length - 1] for x, y in zip(start[met].tolist(), stop[met].tolist(), strict=True)], length)
                left = ~copy
                columns = {
                    "doc": np.concatenate([gone["doc"], doc[left]]),
                    "row_key": np.concatenate([gone["row_key"], key[left]]),
                    "start": np.concatenate([gone["start"], place[left]]).astype(np.int32),
                    "stop": np.concatenate([gone["stop"] - (length - 1), (stop - own[row])[left]]).astype(np.int32),
                    "hash": np.concatenate([arrays.mix(gone["doc"].astype(np.uint64)), hashes[left]]).astype(np.int64),
                    "judged": np.append(np.ones(len(gone["doc"]), bool), np.zeros(left.sum(), bool)),
                }
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))

    every = keyed.where(F.col("doc").isNotNull()).mapInArrow(cut, schema)
    # At most one row for each chunk of documents under a hash: chunks have settled their copies.
    group = Window.partitionBy("judged", "hash")
    every = every.withColumns({"least": F.min("doc").over(group), "most": F.max("doc").over(group)}).where(F.col("judged") | (F.col("least") < F.col("most")))
    kind = F.when(F.col("judged"), 0).when(F.col("doc") > F.col("least"), 1).otherwise(2).alias("kind")
    return every.select("doc", "row_key", "start", "stop", "hash", kind)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes (at least): those that still agree are sorted again by ranks of doubled length."""
    n = len(text)
    kind = np.int32 if n + 1 < 1 << 31 else np.int64
    key = np.zeros(n + 8, np.uint64)
    key[:n] = text
    for k in (1, 2, 4):
        key = (key[:-k] << np.uint64(8 * k)) | key[k:]
    key = key[:n]
    order = np.argsort(key)
    ordered = key[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    # A rank is the place where its group begins, counted from one; zero lies behind the end.
    rank, places, own, reach = np.zeros(n + max(depth, 8), kind), np.arange(n), order, 8
    while reach < depth and len(places):
        begin = np.flatnonzero(new)
        of = np.repeat((places[begin] + 1).astype(kind), np.diff(np.append(begin, len(places))))
        rank[own] = of
        tied = ~(new & np.append(new[1:], True))
        places, of, own = places[tied], of[tied], own[tied]
        if not len(places):
            break
        pair = (of.astype(np.int64) << 32) | rank[own + reach]
        at = np.argsort(pair)
        own, pair = own[at], pair[at]
        order[places] = own
        new = np.append(True, pair[1:] != pair[:-1])
        reach *= 2
    return order


def short_prefixes(bwt: np.ndarray, length: int) -> np.ndarray:
    """Whether each place has a common prefix of under ``length`` with the place before it."""
    n = len(bwt)
    kind = np.int32 if n * (length + 1) < 1 << 31 else np.int64  # intervals are numbered, at most one for each place and round
    by_byte = np.argsort(bwt, kind="stable")
    step = np.empty(n, kind)  # where the suffix one byte longer stands
    step[by_byte] = np.arange(n, dtype=kind)
    begins = np.zeros(n + 1, bool)
    begins[0] = begins[n] = True
    begins[1:n] = bwt[by_byte][1:] != bwt[by_byte][:-1]
    step[bwt == _DIVIDE] = -1
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    tag, serial = np.full(n + 2, -1, kind), 0  # shifted by one, so that no place lacks a neighbour
    own_tag, next_tag, next_begins = tag[1:], tag[2:], begins[1:]
    low, high = np.zeros(1, kind), np.full(1, n - 1, kind)
    for _ in range(length):
        size = high - low + 1
        ends = np.cumsum(size, dtype=np.int64)
        place = step[np.arange(ends[-1]) + np.repeat(low - (ends - size), size)]
        owner = np.repeat(np.arange(serial, serial + len(size), dtype=kind), size)
        serial += len(size)
        inside = place >= 0
        place, owner = place[inside], owner[inside]
        at = place.astype(np.intp)
        own_tag[at] = owner
        first = (tag[at] != owner) | begins[at]
        last = (next_tag[at] != owner) | next_begins[at]
        low, high = np.sort(place[first]), np.sort(place[last])
        new = ~known[high + 1]
        low, high = low[new], high[new]
        known[high + 1] = True
        if not len(low):
            break
    return known[:n]


def least_owner(texts: list[bytes], owners: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each text and each window of it, the least owner among the texts that hold an equal window."""
    joined = np.frombuffer(bytes([_DIVIDE]).join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    order = suffix_order(joined, length + 1)
    short = short_prefixes(joined[order - 1], length)
    owner = np.full(len(joined), np.iinfo(np.int64).max)
    windows = np.maximum(sizes - length + 1, 0)
    at = np.repeat(starts, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    owner[at] = np.repeat(owners, windows)
    ordered = owner[order]
    least = np.minimum.reduceat(ordered, np.flatnonzero(short))[np.cumsum(short) - 1]
    result = np.empty(len(joined), np.int64)
    result[order] = least
    return [result[a : a + w] for a, w in zip(starts.tolist(), windows.tolist(), strict=True)]


def hits(judged: list[np.ndarray], text: np.ndarray, doc: np.ndarray, most: int = SHARD_BYTES):
    """``(row, first window, window after the last)`` of the runs of windows of lesser owner, for rows that hold one of the ``judged`` texts each.

    Rows are worked on together, of up to ``most`` windows in all, unless one row has more.
    """
    flat, windows = np.concatenate(judged), np.fromiter(map(len, judged), np.int64, len(judged))
    begin, full = np.cumsum(windows) - windows, windows > 0
    least = np.full(len(judged), np.iinfo(np.int64).max)
    if full.any():
        least[full] = np.minimum.reduceat(flat, begin[full])
    rows = np.flatnonzero(least[text] < doc)
    ends = np.cumsum(windows[text[rows]] + 1)
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        some, n = rows[a:b], windows[text[rows[a:b]]]
        # A place after each row's last window, which is no hit, keeps rows apart.
        row = np.repeat(np.arange(len(some)), n + 1)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
        hit = (at < n[row]) & (flat[np.minimum(begin[text[some]][row] + at, len(flat) - 1)] < doc[some][row])
        before = np.append(False, hit[:-1])
        first, last = np.flatnonzero(hit & ~before), np.flatnonzero(before & ~hit)
        yield some[row[first]], at[first], at[last]
        a = b


def decide(anchor: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray, texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """Spans to remove among pieces of text; only those of equal anchor are compared for sure."""
    numbers: dict[bytes, int] = {}
    which = np.fromiter((numbers.setdefault(t, len(numbers)) for t in texts), np.int64, len(texts))
    distinct = list(numbers)
    owner, most = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(owner, which, doc)
    np.maximum.at(most, which, doc)
    of_anchor = np.zeros(len(distinct), np.uint64)
    of_anchor[which] = anchor
    out = [[np.zeros(0, np.int64)] for _ in range(4)]
    # Shards of whole anchors. A text of one document alone under its anchor shares no window with another document.
    order = np.argsort(of_anchor, kind="stable")
    _, place, count = np.unique(of_anchor, return_inverse=True, return_counts=True)
    order = order[(count[place[order]] > 1) | (owner[order] < most[order])]
    lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
    rows = np.argsort(which, kind="stable")
    rows_at = np.searchsorted(which[rows], np.arange(len(distinct) + 1))
    a = 0
    while a < len(order):
        b, total = a, 0
        while b < len(order) and (b == a or total + lengths[order[b]] <= SHARD_BYTES or of_anchor[order[b]] == of_anchor[order[b - 1]]):
            total += lengths[order[b]]
            b += 1
        part = order[a:b]
        judged = least_owner([distinct[k] for k in part], owner[part], length)
        counts = rows_at[part + 1] - rows_at[part]
        text = np.repeat(np.arange(len(part)), counts)
        own = rows[np.repeat(rows_at[part] - (np.cumsum(counts) - counts), counts) + np.arange(len(text))]
        for row, first, last in hits(judged, text, doc[own]):
            some = own[row]
            for column, values in zip(out, (doc[some], key[some], start[some] + first, start[some] + last + length - 1), strict=True):
                column.append(values)
        a = b
    return repeats.spans_of(*(np.concatenate(c) for c in out))


def repeated_spans(keyed: DataFrame, count: int, length: int = LENGTH) -> DataFrame:
    """Byte spans ``(doc, row_key, start, stop)`` that are covered by repeated windows."""

    def make(data, offsets, skip):
        return byte_chunk(data, offsets, skip, length)

    met = segments_met(keyed, length)
    listed = met.groupBy("doc").agg(F.collect_list(F.struct("row_key", "start", "stop", "hash", "kind")).alias("segments"))
    listed = listed.select("doc", "segments", F.filter("segments", lambda s: s["kind"] < 2).alias("skip"))
    split = keyed.join(listed, "doc", "left").select("doc", "row_key", "text", "segments", "skip")
    held = split.join(repeats.recurring(split.drop("segments"), make, count, CHUNK_BYTES), "doc", "left").where(F.col("places").isNotNull() | F.col("segments").isNotNull())
    held = held.select("doc", "row_key", "text", "segments", "skip", F.coalesce("places", F.array().cast("array<binary>")).alias("places"))
    names = ["bucket", "anchors", "docs", "keys", "starts", "sizes", "texts", "hit_docs", "hit_keys", "hit_starts", "hit_stops"]

    def pieces(batches):
        for batch in batches:
            data, offsets = arrays.column_bytes(batch.column("text"))
            for a, ids, keys, chunk, marked in repeats.marked_chunks(batch, make, CHUNK_BYTES):
                raw = data[offsets[a] : offsets[a + len(ids)]].tobytes()
                run = np.flatnonzero(marked)
                own = [(row, s) for row, found in enumerate(batch.column("segments").slice(a, len(ids)).to_pylist()) for s in found or () if s["kind"] and s["row_key"] == keys[row]]
                row = np.append(chunk.row[run], np.array([r for r, _ in own], np.int64))
                low = np.append(chunk.run_from[run], np.array([chunk.first[r] + s["start"] for r, s in own], np.int64))
                high = np.append(chunk.run_to[run], np.array([chunk.first[r] + s["stop"] - 1 for r, s in own], np.int64)) + length
                anchor = np.append(chunk.hash[run], np.array([s["hash"] for _, s in own], np.int64).astype(np.uint64))
                if not len(row):
                    continue
                doc, key, start = ids[row], keys[row], low - chunk.first[row]
                texts = [raw[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True)]
                numbers: dict[bytes, int] = {}
                which = np.fromiter((numbers.setdefault(t, len(numbers)) for t in texts), np.int64, len(texts))
                hit = doc > repeats.group_least(which, doc)[0]
                if hit.any():  # judged here: these only pass through
                    again = np.flatnonzero(np.isin(which, which[hit]))
                    made = decide(which[again].astype(np.uint64), doc[again], key[again], start[again], [texts[k] for k in again.tolist()], length)
                    if len(made["doc"]):
                        yield repeats.by_bucket(names, arrays.mix(made["doc"].astype(np.uint64)) % np.uint64(count), {f"hit_{n}": made[c] for n, c in (("docs", "doc"), ("keys", "row_key"), ("starts", "start"), ("stops", "stop"))})
                left = np.flatnonzero(~hit)
                yield repeats.by_bucket(names, arrays.mix(anchor[left]) % np.uint64(count), {"anchors": anchor[left], "docs": doc[left], "keys": key[left], "starts": start[left].astype(np.int32), "sizes": (high - low)[left].astype(np.int32)}, {"texts": [texts[k] for k in left.tolist()]})

    def settle(table: pa.Table) -> pa.Table:
        anchor, doc, key, start, size = (repeats.joined(table, c, t) for c, t in (("anchors", np.uint64), ("docs", np.int64), ("keys", np.int64), ("starts", np.int32), ("sizes", np.int32)))
        raw, ends = b"".join(x for x in table.column("texts").to_pylist() if x), np.cumsum(size, dtype=np.int64)
        texts = [raw[b - s : b] for b, s in zip(ends.tolist(), size.tolist(), strict=True)]
        return repeats.with_passed(table, decide(anchor, doc, key, start.astype(np.int64), texts, length))

    among = held.mapInArrow(pieces, repeats.binaries(names)).groupBy("bucket").applyInArrow(settle, repeats.SPANS)
    return among.unionByName(met.where("kind = 0").select("doc", "row_key", "start", (F.col("stop") + (length - 1)).alias("stop")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, kept, n_bytes, n_removed, n_spans`` of every row: the remaining bytes, and what went."""
    keyed = repeats.with_key(docs, id_col, text_col)
    spans = repeats.gathered(repeated_spans(keyed, repeats.buckets(docs, text_col), length))
    whole = keyed.join(spans, "doc", "left").select("doc", "row_key", "text", "spans")
    schema = f"{id_col} bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def cut(batches):
        for batch in batches:
            rows = [[], [], [], [], []]
            spans, keys = batch.column("spans").to_pylist(), batch.column("row_key").to_pylist()
            for row, text in enumerate(batch.column("text").to_pylist()):
                raw = (text or "").encode()
                starts, ends = repeats.span_ends(spans[row], keys[row])
                edges = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(raw)]
                kept = raw if len(edges) == 2 else b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for column, value in zip(rows, (None if text is None else kept, len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return whole.mapInArrow(cut, schema)


def op9_suffixes(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`remove_repeats` over all documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


ORACLE_SQL = r"""
WITH doc AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(length(hex(encode(coalesce(text, '')))) // 2 AS BIGINT) AS n FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS t FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM doc WHERE n >= 50)),
own AS (SELECT t, min(doc_id) AS d FROM win GROUP BY t),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN own USING (t) WHERE doc_id > d),
span AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < p - 1) AS n_spans
         FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id),
byte AS (SELECT doc_id, substr(h, 2 * p + 1, 2) AS x, p FROM (SELECT doc_id, h, unnest(range(0, n)) AS p FROM doc WHERE doc_id IN (SELECT doc_id FROM span))),
kept AS (SELECT doc_id, string_agg(x, '' ORDER BY p) AS t FROM byte ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc.doc_id, n AS n_bytes, CAST(coalesce(span.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(span.n_spans, 0) AS BIGINT) AS n_spans,
       CASE WHEN span.doc_id IS NULL THEN sha256(unhex(h)) ELSE sha256(unhex(coalesce(kept.t, ''))) END AS kept_sha256
FROM doc LEFT JOIN span ON doc.doc_id = span.doc_id LEFT JOIN kept ON doc.doc_id = kept.doc_id
"""
