"""Near copies by the Jaccard similarity of their word shingles.

Texts with equal sets of shingles are one node from the start. Candidates are
nodes that agree on one of ``BANDS`` groups of ``ROWS`` min-hashes (a pair of
Jaccard similarity s is one with probability 1 - (1 - s^5)^20: 0.9996 at 0.8),
and the links of the SimHash index. The shingle sets of every candidate are
compared before it is a link; the components of the links are the groups.

No key emits all its pairs: each node is first compared with the least node of
one of its keys; nodes of keys that still have several components are compared with
two nodes of each such key; then only nodes that share a key, lie in different
components and have sets of similar size are compared, all of them.

Defined results: null and empty texts are copies of each other; rows without an
id may link others, but are never dropped; a row is told by its id and text, so
rows that repeat an id with different texts are rows of their own; of rows of equal
id and text the one whose columns have the least hash stays; ties go to the least id;
an empty table gives an empty one; texts are read whole, in time proportional to their
length; other columns stay, but none may be called ``_t`` or ``_r``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, durable, simhash
from .components import components

SIZE, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 5
#: Groups of texts that a broadcast may name at most.
GROUPS = 1 << 20
_TURN, _TIMES = np.random.default_rng(11).integers(1, 2**63, (2, BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of min-hashes of a set of shingles."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[None, at : at + 1024] ^ _TURN) * _TIMES).min(1), out=least)
    return np.fromiter((xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))), np.uint64, BANDS).astype(np.int64)


def alike(x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sets (sorted) have that Jaccard similarity."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared >= similarity * (len(x) + len(y) - shared) - 1e-9


def _texts(column: pa.Array):
    return (x for texts in arrays.pieces(column) for x in texts)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ``t`` (hash of the text), ``h`` (of its set of shingles), ``n`` (size of the set), ``fp`` and ``keys`` of each row."""
    source = docs.select(id_col, F.xxhash64(text_col).alias("t"), F.col(text_col).alias("_text"))
    schema = source.drop("_text").select("*", *(F.lit(0).cast("bigint").alias(c) for c in ("h", "n", "fp")), F.array(F.lit(0).cast("bigint")).alias("keys")).schema

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = []
        for text in _texts(batch.column("_text")):
            every = simhash.shingle_hashes(text, SIZE)
            own = np.unique(every)
            made.append((xxhash.xxh64_intdigest(own.tobytes(), 7), len(own), simhash.majority(every), band_keys(own) if len(own) else own))
        columns = [pa.array(np.array([m[k] for m in made], np.uint64).astype(np.int64)) for k in range(3)]
        lists = pa.array([m[3] for m in made], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("t"), *columns, lists], names=[id_col, "t", "h", "n", "fp", "keys"])

    return arrays.map_batches(source, work, schema)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """``pairs`` (a, b) of nodes with ``ok``: whether their sets are alike."""
    wanted = durable.keep(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct().join(nodes.select("h", "t"), "h"))
    group = lambda: F.pmod("t", F.lit(GROUPS))
    source = docs.select(F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).withColumn("_group", group())
    source = source.join(F.broadcast(wanted.select(group().alias("_group")).distinct()), "_group", "left_semi")
    texts = durable.keep(source.join(wanted, "t").select("h", "text").dropDuplicates(["h"]))
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("text").alias("y")), "b")

    def judge(batches):
        for batch in batches:
            x, y = ((np.unique(simhash.shingle_hashes(t, SIZE)) for t in _texts(batch.column(c))) for c in ("x", "y"))
            ok = [alike(p, q) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return both.select("a", "b", "x", "y").mapInArrow(arrays.tidy(judge), "a bigint, b bigint, ok boolean")


def _apart(met: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (key, h, n, component) of the keys whose nodes lie in several ``parts``."""
    placed = met.join(parts.withColumnRenamed("id", "h"), "h", "left").select("key", "h", "n", F.coalesce("component", "h").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") < F.col("high")).select("key")
    return placed.join(mixed, "key", "left_semi")


def _pairs(placed: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a key, lie in different components and whose sizes allow the similarity."""
    other = other.select("key", *(F.col(c).alias(f"{c}2") for c in ("h", "n", "component")))
    sizes = F.least("n", "n2") >= F.greatest("n", "n2") * SIMILARITY - 1e-9
    pairs = placed.join(other, "key").where((F.col("component") != F.col("component2")) & sizes)
    return pairs.select(F.greatest("h", "h2").alias("a"), F.least("h", "h2").alias("b")).distinct()


def _starred(met: DataFrame, parts: DataFrame) -> DataFrame:
    """Each node with two nodes of each of its keys."""
    placed = durable.keep(_apart(met, parts).withColumn("turn", F.xxhash64("key", "h")))
    ends = placed.groupBy("key").agg(F.min("turn").alias("low"), F.max("turn").alias("high")).select("key", F.explode(F.array("low", "high")).alias("turn"))
    return _pairs(placed, placed.join(ends, ["key", "turn"], "left_semi"))


def _meeting(met: DataFrame, parts: DataFrame) -> DataFrame:
    """All nodes of a key."""
    placed = durable.keep(_apart(met, parts))
    return _pairs(placed, placed)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``t``, ``h`` and ``component`` of every row."""
    found = durable.keep(sketches(docs, id_col, text_col))
    nodes = durable.keep(found.groupBy("h").agg(F.min("t").alias("t"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.first("keys").alias("keys")))
    keyed = nodes.select("h", "n", F.explode("keys").alias("key"))
    least = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("h").alias("h0")).where(F.col("size") > 1).select("key", "h0")
    met = durable.keep(keyed.join(least, "key"))
    stars = met.where(F.col("h") != F.col("h0")).groupBy("h").agg(F.min("h0").alias("b")).select(F.col("h").alias("a"), "b")

    # Links of the SimHash index, by the least node of each fingerprint.
    prints = durable.keep(nodes.where("n > 0").groupBy("fp").agg(F.min("h").alias("h0")))
    same = nodes.where("n > 0").join(prints, "fp").where(F.col("h") != F.col("h0")).select("h", "h0")
    name = lambda end: prints.select(F.col("fp").alias(end), F.col("h0").alias(f"h_{end}"))
    close = simhash.links(prints).join(name("a"), "a").join(name("b"), "b").select("h_a", "h_b")
    drawn = same.union(close).toDF("x", "y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))

    judged = durable.keep(_verified(durable.keep(stars.union(drawn).distinct()), nodes, docs, text_col))
    links = judged.where("ok").select("a", "b")
    parts, seen = components(links), judged.select("a", "b")
    for meet in (_starred, _meeting):
        again = durable.keep(meet(met, parts).join(seen, ["a", "b"], "left_anti"))
        if again.isEmpty():
            continue
        more = durable.keep(_verified(again, nodes, docs, text_col).where("ok").select("a", "b"))
        seen = seen.unionByName(again)
        if not more.isEmpty():
            links = links.union(more)
            parts = components(links)
    named = found.select(id_col, "t", "h").join(parts.withColumnRenamed("id", "h"), "h", "left")
    return named.select(id_col, "t", "h", F.coalesce("component", "h").alias("component"))


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of the least id of each group of near copies, and the rows without an id."""
    groups = near_copies(docs, id_col, text_col).where(F.col(id_col).isNotNull())
    first = groups.groupBy("component").agg(F.min(F.struct(id_col, "t")).alias("first")).select(f"first.{id_col}", F.col("first.t").alias("_t"))
    rows = docs.withColumn("_t", F.xxhash64(text_col)).withColumn("_r", F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    one = rows.select(id_col, "_t", "_r").join(first, [id_col, "_t"], "left_semi").groupBy(id_col, "_t").agg(F.min("_r").alias("_r"))
    kept = rows.join(one, [id_col, "_t", "_r"], "left_semi").dropDuplicates([id_col, "_t", "_r"])
    return kept.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
