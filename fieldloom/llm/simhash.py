"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint has bit k if more than half of the text's word shingles have it
in their XXH64. Documents with equal fingerprints are one row from the start.
Fingerprints within ``radius`` bits agree on ``k`` of ``radius + k`` blocks of bits, for
any ``k``: so each stands in one order for each choice of ``k`` blocks, with these
in front, sorted by Gray rank (range partitions: no key is gathered in a task).
``k`` is the least at which there are as many values of the front as leaves, so
a value has about one leaf at every size. Consecutive fingerprints of one front
form leaves of at most ``LEAF``; a leaf's upper node is the pattern that its
fingerprints share (mask and bits).

Within a leaf, smaller nodes of 16 are compared first: the bits on which two
nodes are known to differ add up, and whole pairs of nodes go if that is beyond
the radius. Leaves of one front (only dense groups have several) are joined on
their upper nodes with the same rule, and those that are left are searched in the
same way. Each search sends a spanning forest of its links, never all pairs; the
components of these links are exact.

Defined results: null and empty texts have fingerprint zero, which is linked
like any other; rows that repeat an id share a component; a null id is never the
least of its component unless all are null; an empty table gives an empty one;
texts are hashed whole, in time proportional to their length; of the input's
columns the id alone is returned.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, durable
from .components import components

LEAF, NODE = 2048, 16
_BITS = [np.uint64(1) << np.uint64(k) for k in range(64)]


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words (A-Z lower-cased, split at ASCII white space); of all words, if they are fewer."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(words[k : k + size]), 42) for k in range(n)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    n = len(hashes)
    if not n:
        return 0
    counts = sum(np.unpackbits(hashes[k : k + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) for k in range(0, n, 4096))
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, size: int = 4) -> int:
    """SimHash of a text's shingles of ``size`` words."""
    return majority(shingle_hashes(text, size))


_LOWER = arrays.LOWER.tobytes()


def fingerprints(docs: DataFrame, text_col: str = "text", into: str = "fp", size: int = 4) -> DataFrame:
    """``docs`` with the fingerprint (as a signed long) instead of the text."""
    out = docs.drop(into)
    schema = out.withColumn(into, F.lit(0).cast("bigint")).drop(text_col).schema

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(x, size) for texts in arrays.pieces(batch.column(text_col)) for x in texts], np.uint64).astype(np.int64)
        keep = [n for n in batch.schema.names if n != text_col]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(made)], names=[*keep, into])

    return arrays.map_batches(out, work, schema)


def fronts(radius: int, count: int) -> list[list[tuple[int, int]]]:
    """Orders of bits: first bit and width of each block, those of the front first; the last entry is the width of the front."""
    k = 1
    while count > LEAF << (64 * k // (radius + k)):
        k += 1
    edges = [64 * n // (radius + k) for n in range(radius + k + 1)]
    blocks = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    made = []
    for chosen in combinations(range(len(blocks)), k):
        front = [blocks[n] for n in chosen]
        made.append([*front, *(b for n, b in enumerate(blocks) if n not in chosen), (0, sum(w for _, w in front))])
    return made


def ordered(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """The blocks of bits of each value in another order."""
    out = np.zeros_like(fp)
    for first, width in order[:-1]:
        out = (out << np.uint64(width)) | ((fp >> np.uint64(first)) & np.uint64((1 << width) - 1))
    return out


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each value in Gray order: the number whose Gray code it is."""
    out = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def _pattern(fps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the bits that all of each run of ``fps`` share, and those bits."""
    one, any_ = np.bitwise_and.reduceat(fps, starts), np.bitwise_or.reduceat(fps, starts)
    return one | ~any_, one


class Forest:
    """Union-find over positions; the links that joined two sets are kept."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def add(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def search(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within ``radius``: of ``left`` with itself, or with ``right`` (offset by its length)."""
    every = left if right is None else np.concatenate([left, right])
    forest = Forest(len(every))
    tops = np.arange(0, len(left), NODE)
    others = tops if right is None else np.arange(0, len(right), NODE)
    mask, bits = _pattern(left, tops)
    mask2, bits2 = (mask, bits) if right is None else _pattern(right, others)
    base = 0 if right is None else len(left)
    for k, a in enumerate(tops):
        known = np.bitwise_count((bits[k] ^ bits2) & mask[k] & mask2)
        near = np.flatnonzero(known <= radius)
        if right is None:
            near = near[near >= k]
        for at in range(0, len(near), 256):
            own = np.concatenate([np.arange(others[j], min(others[j] + NODE, len(every) - base)) for j in near[at : at + 256]])
            mine = np.arange(a, min(a + NODE, len(left)))
            x, y = np.nonzero(np.bitwise_count(left[mine][:, None] ^ every[base + own][None, :]) <= radius)
            x, y = mine[x], base + own[y]
            for i, j in zip(x[x < y].tolist(), y[x < y].tolist(), strict=True):
                forest.add(i, j)
    return forest.links


_LEAVES = "turn int, head bigint, leaf bigint, mask bigint, bits bigint, fps binary, links binary"


def _leaves(batches, radius: int, orders: list[list[tuple[int, int]]]):
    """Leaves of rows that come in order of (turn, Gray rank); no leaf goes over the value of a front."""
    from pyspark import TaskContext

    serial = TaskContext.get().partitionId() << 40
    rest_turn, rest = None, np.zeros(0, np.uint64)

    def leaf(turn: int, head: int, fps: np.ndarray) -> dict:
        nonlocal serial
        serial += 1
        mask, bits = _pattern(fps, np.zeros(1, int))
        links = np.array(search(fps, None, radius), np.int64).reshape(-1, 2)
        return {"turn": turn, "head": head, "leaf": serial, "mask": int(mask.astype(np.int64)[0]), "bits": int(bits.astype(np.int64)[0]), "fps": fps.tobytes(), "links": fps[links].tobytes() if len(links) else b""}

    def cut(turn: int, fps: np.ndarray, last: bool):
        """Leaves of ``fps``, and those at the end that must wait for more."""
        heads = ordered(fps, orders[turn]) >> np.uint64(64 - orders[turn][-1][1])
        edges = [0, *(np.flatnonzero(heads[1:] != heads[:-1]) + 1).tolist(), len(fps)]
        made = []
        for a, b in zip(edges, edges[1:], strict=False):
            for at in range(a, b, LEAF):
                if not last and b == len(fps) and at + LEAF >= b:
                    return made, fps[at:]
                if b > a:
                    made.append(leaf(turn, int(heads[a]), fps[at : min(b, at + LEAF)]))
        return made, fps[:0]

    def out(rows: list[dict]):
        kinds = {"turn": pa.int32(), "fps": pa.binary(), "links": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(k, pa.int64())) for k in rows[0]], names=list(rows[0]))

    for batch in batches:
        turns, fps = batch.column("turn").to_numpy(), batch.column("fp").to_numpy().astype(np.uint64)
        for turn in np.unique(turns).tolist():
            own = fps[turns == turn]
            if rest_turn not in (None, turn) and len(rest):
                if made := cut(rest_turn, rest, True)[0]:
                    yield out(made)
                rest = rest[:0]
            made, rest = cut(turn, np.concatenate([rest, own]), False)
            rest_turn = turn
            if made:
                yield out(made)
    if len(rest) and (made := cut(rest_turn, rest, True)[0]):
        yield out(made)


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (column ``fp``) whose components are those of all pairs within ``radius``."""
    spark = fps.sparkSession
    orders = fronts(radius, fps.count())

    def turns(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().astype(np.uint64)
            for turn, order in enumerate(orders):
                rank = gray_rank(ordered(fp, order)) ^ (np.uint64(1) << np.uint64(63))  # signed order of longs
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), turn, np.int32)), pa.array(rank.astype(np.int64)), batch.column("fp")], names=["turn", "rank", "fp"])

    turned = fps.select("fp").mapInArrow(arrays.tidy(turns), "turn int, rank bigint, fp bigint")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = durable.keep(turned.repartitionByRange(count, "turn", "rank").sortWithinPartitions("turn", "rank").mapInArrow(lambda b: _leaves(b, radius, orders), _LEAVES))

    def pairs(column: str):
        def run(batches):
            for batch in batches:
                raw = b"".join(x for x in batch.column(column).to_pylist() if x)
                both = np.frombuffer(raw, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        return run

    inside = leaves.select("links").where(F.length("links") > 0).mapInArrow(pairs("links"), "a bigint, b bigint")
    # Upper nodes first; the fingerprints of those that are left follow.
    upper = leaves.select("turn", "head", "leaf", "mask", "bits")
    other = upper.select("turn", "head", *(F.col(c).alias(f"{c}2") for c in ("leaf", "mask", "bits")))
    differing = F.bit_count(F.col("bits").bitwiseXOR(F.col("bits2")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask2")))
    meeting = upper.join(other, ["turn", "head"]).where((F.col("leaf") < F.col("leaf2")) & (differing <= radius)).select("leaf", "leaf2")
    blobs = leaves.select("leaf", "fps")
    meeting = meeting.join(blobs, "leaf").join(blobs.withColumnsRenamed({"leaf": "leaf2", "fps": "fps2"}), "leaf2").select("fps", "fps2")

    def across(batches):
        for batch in batches:
            for x, y in zip(batch.column("fps").to_pylist(), batch.column("fps2").to_pylist(), strict=True):
                left, right = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                every, found = np.concatenate([left, right]).astype(np.int64), np.array(search(left, right, radius), int).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(every[found[:, 0]]), pa.array(every[found[:, 1]])], names=["a", "b"])

    return inside.unionByName(meeting.mapInArrow(across, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, radius: int = 4, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``fp`` and ``component_id`` (least id that is reached over links of ``radius`` bits)."""
    found = durable.keep(fingerprints(docs.select(id_col, text_col), text_col, size=size))
    distinct = durable.keep(found.groupBy("fp").agg(F.min(id_col).alias("first")))
    grouped = components(links(distinct, radius))
    # One row for each fingerprint that has links: a component may have many, so their least id is taken by a partial
    # aggregate and sent back by a join whose large side can be split.
    linked = grouped.join(distinct.withColumnRenamed("fp", "id"), "id").select(F.col("id").alias("fp"), "component", "first")
    least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    named = linked.join(least, "component").select("fp", "component_id")
    out = found.join(distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "fp")
    return out.select(id_col, "fp", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
