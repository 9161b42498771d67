"""Common steps of the two operators on repeated passages.

A document is a sequence of units (words or bytes); a window is ``length``
consecutive units. Every window selects one of its grams of fewer units, that
of least hash (the first of equals), so equal windows select equal grams, their
*anchor*. Neighbouring windows mostly share an anchor: of grams of 8 words one in
22 is one, of 24 bytes one in 14. Only anchors that occur in two documents can
belong to a repeated window.

Anchors and windows are dealt to buckets by the anchor's hash; the number of
buckets follows the size of the input, so a bucket's size doesn't. Before
anything is sent, a chunk of documents settles what is repeated within it and
sends each anchor or window once, so what a very frequent passage puts into its
bucket is one entry for each chunk, not for each document.

What is removed goes by document id and a hash of the text (``row_key``), so rows
that repeat an id are each judged on their own text. Rows without an id neither
remove nor lose anything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

#: Bytes of text for each bucket.
BUCKET_BYTES = 1_500_000
_LOW = np.uint64(0xFFFFFFFF)


class Chunk:
    """Units of some rows: ``values``, and the first unit of each row (and the total)."""

    def __init__(self, values: np.ndarray, first: np.ndarray, length: int, gram: int, skip: np.ndarray | None = None):
        """``skip`` marks the units at which windows begin that are left out."""
        self.values, self.first, self.length, self.gram = values, first, length, gram
        # Runs of windows with one anchor: first and last window, place and hash of the anchor, row.
        empty = np.zeros(0, np.int64)
        self.run_from = self.run_to = self.anchor = self.row = empty
        self.hash = np.zeros(0, np.uint64)
        width, n = length - gram + 1, len(values)
        if n < length:
            return
        grams = arrays.window_hashes(values, gram)
        least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        chosen = (least & _LOW).astype(np.int64)
        sizes = np.diff(first)
        rows = np.repeat(np.arange(len(sizes)), sizes)[: len(chosen)]
        valid = np.arange(len(chosen)) + length <= first[1:][rows]
        if skip is not None:
            valid &= ~skip[: len(valid)]
        at = np.flatnonzero(valid)
        if not len(at):
            return
        new = np.ones(len(at), bool)
        new[1:] = (chosen[at][1:] != chosen[at][:-1]) | (np.diff(at) != 1)
        starts = np.flatnonzero(new)
        self.run_from = at[starts]
        self.run_to = at[np.append(starts[1:], len(at)) - 1]
        self.anchor, self.row = chosen[self.run_from], rows[self.run_from]
        self.hash = grams[self.anchor]


def with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, row_key and text of every row."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).alias("text"))


def buckets(docs: DataFrame, text_col: str) -> int:
    """Number of buckets for a table."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return int(-(-total // BUCKET_BYTES)) or 1


def _blobs(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary array of slices of ``data`` between ``edges`` (counted in items)."""
    raw = np.ascontiguousarray(data)
    offsets = (edges * raw.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


def by_bucket(names: list[str], bucket: np.ndarray, columns: dict[str, np.ndarray], blobs: dict[str, list[bytes]] | None = None) -> pa.RecordBatch | None:
    """One row for each bucket: the slices of ``columns`` (and the pieces of ``blobs``) as binaries, null under other names."""
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    made = {"bucket": pa.array(bucket[edges[:-1]].astype(np.int64))} | {name: _blobs(c[order], edges) for name, c in columns.items()}
    for name, pieces in (blobs or {}).items():
        made[name] = pa.array([b"".join(pieces[k] for k in order[a:b].tolist()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([made.get(n, pa.nulls(len(edges) - 1, pa.binary())) for n in names], names=names)


def binaries(names: list[str]) -> str:
    """Schema of rows by bucket."""
    return ", ".join(["bucket bigint", *(f"{n} binary" for n in names[1:])])


def joined(table: pa.Table, name: str, kind) -> np.ndarray:
    """All slices of a binary column, one after the other."""
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x), kind)


def group_least(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item the least and the greatest value among those of equal key."""
    if not len(keys):
        return values, values
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(np.append(False, keys[order][1:] != keys[order][:-1]))
    return np.minimum.reduceat(values[order], edges)[group], np.maximum.reduceat(values[order], edges)[group]


def least_item(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each item the place of the first item of least document among those of equal key."""
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    new = np.append(True, keys[order][1:] != keys[order][:-1])
    edges, group = np.flatnonzero(new), np.cumsum(new) - 1
    least = np.minimum.reduceat(docs[order], edges)[group]
    out = np.empty(len(keys), np.int64)
    out[order] = np.minimum.reduceat(np.where(docs[order] == least, order, len(keys)), edges)[group]
    return out


#: Columns of links: a span of a text, and the equal span of a document of lesser id.
LINK_KINDS = {"doc": np.int64, "row_key": np.int64, "start": np.int32, "stop": np.int32, "owner": np.int64, "owner_key": np.int64, "owner_start": np.int32}
LINKS = "doc bigint, row_key bigint, start int, stop int, owner bigint, owner_key bigint, owner_start int"


def links_of(doc: np.ndarray, key: np.ndarray, place: np.ndarray, own: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of neighbouring windows, those at ``hit`` of each item, that equal neighbouring windows of one other text.

    ``own`` pairs an item with the item that its window equals: two rows of places.
    """
    hit, other = own
    order = np.lexsort((place[hit], key[hit], doc[hit]))
    hit, other = hit[order], other[order]
    d, k, p, o, ok, op = doc[hit], key[hit], place[hit], doc[other], key[other], place[other]
    new = np.ones(len(hit), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (o[1:] != o[:-1]) | (ok[1:] != ok[:-1]) | (np.diff(p) != 1) | (np.diff(op) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit))[: len(first)] - 1
    made = (d[first], k[first], p[first], p[last] + length, o[first], ok[first], op[first])
    return {name: column.astype(kind) for (name, kind), column in zip(LINK_KINDS.items(), made, strict=True)}


def _split(batch: pa.RecordBatch, make, chunk_bytes: int):
    """First row, row after the last and :class:`Chunk` of the parts of an Arrow batch of documents.

    A column ``skip`` with ranges of windows (by byte) is given to ``make`` as a mask.
    """
    data, offsets = arrays.column_bytes(batch.column("text"))
    skips = batch.column("skip").to_pylist() if "skip" in batch.schema.names else None
    keys = batch.column("row_key").to_pylist() if skips else None
    for a, b in arrays.chunks(offsets, chunk_bytes):
        own = offsets[a : b + 1] - offsets[a]
        if skips is None:
            yield a, b, make(data[offsets[a] : offsets[b]], own)
        else:
            mask = np.zeros(own[-1] + 1, bool)
            for row in range(a, b):
                for span in skips[row] or ():
                    if span["row_key"] == keys[row]:
                        mask[own[row - a] + span["start"] : own[row - a] + span["stop"]] = True
            yield a, b, make(data[offsets[a] : offsets[b]], own, mask)


def recurring(docs: DataFrame, make, count: int, chunk_bytes: int) -> DataFrame:
    """``(doc, places)``: where in the texts of each id (by unit) anchors stand that occur in two documents.

    ``make`` turns bytes and row offsets into a :class:`Chunk`; a chunk has at most
    ``chunk_bytes`` of text, or one longer row. Within a bucket anchors are told
    apart by 32 bits: this only narrows the search, so a chance meeting costs a look.
    """
    names = ["bucket", "hashes", "docs", "places", "known_docs", "known_places"]

    def anchors(batches):
        for batch in batches:
            # Rows without an id are left out here: a filter before would make another plan of the same scan.
            there, ids = batch.column("doc").is_valid().to_numpy(zero_copy_only=False), batch.column("doc").fill_null(0).to_numpy(zero_copy_only=False)
            for a, _, chunk in _split(batch, make, chunk_bytes):
                known_id = there[a + chunk.row]
                row, anchor, hashes = chunk.row[known_id], chunk.anchor[known_id], chunk.hash[known_id]
                if not len(row):
                    continue
                doc, place = ids[a + row].astype(np.int64), (anchor - chunk.first[row]).astype(np.int32)
                low, high = group_least(hashes, doc)
                known = low < high
                if known.any():  # nothing to settle: these only pass through
                    yield by_bucket(names, arrays.mix(doc[known].astype(np.uint64)) % np.uint64(count), {"known_docs": doc[known], "known_places": place[known]})
                # Of an anchor known to recur one entry goes out, with place -1.
                marks = np.unique(hashes[known])
                send = np.concatenate([hashes[~known], marks])
                columns = {"docs": np.concatenate([doc[~known], np.zeros(len(marks), np.int64)]), "places": np.concatenate([place[~known], np.full(len(marks), -1, np.int32)])}
                yield by_bucket(names, arrays.mix(send) % np.uint64(count), {"hashes": (send >> np.uint64(32)).astype(np.uint32)} | columns)

    def settle(table: pa.Table) -> pa.Table:
        hashes, doc, place = joined(table, "hashes", np.uint32), joined(table, "docs", np.int64), joined(table, "places", np.int32)
        real = place >= 0
        marked = np.isin(hashes, hashes[~real])
        low, high = group_least(hashes[real], doc[real])
        out = (low < high) | marked[real]
        doc, place = np.concatenate([joined(table, "known_docs", np.int64), doc[real][out]]), np.concatenate([joined(table, "known_places", np.int32), place[real][out]])
        # One row for each document of the bucket.
        order = np.argsort(doc, kind="stable")
        starts = np.flatnonzero(np.append(True, doc[order][1:] != doc[order][:-1]))[: len(doc)]
        return pa.table({"doc": doc[order][starts], "place": _blobs(place[order], np.append(starts, len(doc)))})

    return docs.mapInArrow(anchors, binaries(names)).groupBy("bucket").applyInArrow(settle, "doc bigint, place binary").groupBy("doc").agg(F.collect_list("place").alias("places"))


def marked_chunks(batch: pa.RecordBatch, make, chunk_bytes: int):
    """``(first row, documents, keys, chunk, is the run's anchor among the row's places)`` of rows that carry ``places``."""
    ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row_key"))
    for a, b, chunk in _split(batch, make, chunk_bytes):
        mark = np.zeros(len(chunk.values) + 1, bool)
        for row, pieces in enumerate(batch.column("places").slice(a, b - a).to_pylist()):
            places = np.frombuffer(b"".join(pieces), np.int32)
            mark[chunk.first[row] + places[places < chunk.first[row + 1] - chunk.first[row]]] = True
        yield a, ids[a:b].astype(np.int64), keys[a:b].astype(np.int64), chunk, mark[chunk.anchor]


def spans_of(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """Spans of equal row that touch or overlap, merged."""
    order = np.lexsort((start, key, doc))
    doc, key, start, end = doc[order], key[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return {"doc": doc, "row_key": key, "start": start.astype(np.int32), "stop": end.astype(np.int32)}
    other = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))
    group = np.cumsum(other) - 1
    # A greatest end so far that never leaks from one row into the next.
    lift = group * np.int64(1 << 33)
    reach = np.maximum.accumulate(end + lift)
    new = other.copy()
    new[1:] |= (start + lift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return {"doc": doc[first], "row_key": key[first], "start": start[first].astype(np.int32), "stop": (reach[last] - lift[last]).astype(np.int32)}


SPANS = "doc bigint, row_key bigint, start int, stop int"


def with_passed(table: pa.Table, spans: dict[str, np.ndarray]) -> pa.Table:
    """Spans that a bucket settled, and those that came with it (columns ``hit_...``)."""
    passed = {c: joined(table, f"hit_{n}", t) for c, n, t in (("doc", "docs", np.int64), ("row_key", "keys", np.int64), ("start", "starts", np.int32), ("stop", "stops", np.int32))}
    return pa.table({c: np.concatenate([passed[c], spans[c]]) for c in passed})


def gathered(spans: DataFrame) -> DataFrame:
    """``(doc, spans)``, in no order and not merged; each with the ``row_key`` of its text."""
    return spans.groupBy("doc").agg(F.collect_list(F.struct("row_key", "start", "stop")).alias("spans"))


def span_ends(value: list[dict] | None, row_key: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged spans of the text with a key."""
    own = [(s["start"], s["stop"]) for s in value or () if s["row_key"] == row_key]
    none, (start, stop) = np.zeros(len(own), np.int64), np.array(own, np.int64).reshape(-1, 2).T
    made = spans_of(none, none, start, stop)
    return made["start"], made["stop"]
