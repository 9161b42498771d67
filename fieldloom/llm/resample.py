"""Importance resampling towards a target distribution.

Texts are bags of hashed word n-grams (CRC-32 of the joined words, modulo the
number of buckets). A bucket's gain is the logarithm of its smoothed share in the
target over that in the corpus, a document's weight the sum of the gains of its
features, and its score the weight with Gumbel noise of the document's id: the
documents of the highest scores are a sample without replacement in proportion to
the exponentials of the weights.

* **Weights** are array look-ups: the registers of CRC-32 advance for all words of
  a batch at once, and the gains of all buckets are one array that every task gets.
  What is collected and broadcast has one number for each bucket.
* **Runs**: tasks sort the eligible rows in runs of ``RUN_ROWS`` and cut them into
  pages at ``PAGE`` rows and at the borders of score ranges. Ranges have about
  ``RANGE_ROWS`` rows; scores that very many rows share are cut by id too.
* **Merge**: a range's pages are dealt to one task, where Spark's own sort (it spills)
  puts them in order of their first rows. So a page comes in just when its first
  row can be the next one, and a k-way tournament tree over the open pages
  gives out the rows in order while at most one page of a run is open, but for
  rows of equal score and id.
* **Stop**: exact counts by range tell where the draws end. Ranges beyond are never dealt;
  the range with the last draw is merged up to it and the rest passes unordered.

Defined results: a null or empty text has no features and weight 0; rows without an
id have no score and are never drawn; repeated rows are scored and drawn each by
itself, with ranks in any order among equal rows; ties of score go to the
smaller id; an empty corpus gives an empty result, an empty target gives weights
against the uniform distribution of its smoothing; time grows in proportion to the
length of a text. Ids are integers; other columns are neither used nor kept.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays, durable
from .decontam import WORD

#: Longest features in words, buckets, scale of logarithms, seed of the noise, words of an eligible document, drawn hundredths.
ORDER, BUCKETS, SCALE, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 1000, 2024, 20, 10
#: Rows of a sorted run, of a page, and of a score range.
RUN_ROWS, PAGE, RANGE_ROWS = 1 << 18, 512, 1 << 22
#: Bytes of a word that are taken for all words at once; the rest of a longer word goes through zlib.
TOGETHER = 48
_ONES = np.uint32(0xFFFFFFFF)
#: Parts by id of a score that very many rows share, at most.
_SUBS = 1 << 12


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def advanced(registers: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes ``raw[start:end]`` of each."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    state, at, left = registers[order], starts[order], sizes[order]
    upto = np.searchsorted(-left, -np.arange(1, min(TOGETHER, int(left[0]) if len(left) else 0) + 1), side="right")
    for k, n in enumerate(upto.tolist()):
        some = state[:n]
        state[:n] = _CRC[(some ^ raw[at[:n] + k]) & np.uint32(255)] ^ (some >> np.uint32(8))
    for k in range(int(np.searchsorted(-left, -TOGETHER, side="left"))):
        rest = raw[at[k] + TOGETHER : at[k] + left[k]].tobytes()
        state[k] = zlib.crc32(rest, int(state[k] ^ _ONES)) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def features(data: np.ndarray, offsets: np.ndarray, order: int, buckets: int):
    """Words by row, then for each n-gram length: buckets of all windows (by first word), and which lie in one row."""
    starts, ends, first = arrays.words(data, offsets, WORD)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    registers, levels = np.full(len(starts), _ONES), []
    for size in range(1, order + 1):
        n = max(len(starts) - size + 1, 0)
        registers = registers[:n]
        if size > 1:
            registers = _CRC[(registers ^ np.uint32(0x20)) & np.uint32(255)] ^ (registers >> np.uint32(8))
        registers = advanced(registers, data, starts[size - 1 :], ends[size - 1 :])
        levels.append(((registers ^ _ONES).astype(np.int64) % buckets, rows[:n] == rows[size - 1 :]))
    return first, levels


def _pieces(column: pa.Array):
    """Lower-cased bytes and row marks of a column, a bounded part at a time."""
    data, offsets = arrays.column_bytes(column)
    for a, b in arrays.chunks(offsets):
        yield arrays.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]


def bucket_counts(docs: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Features of a corpus by bucket. Tasks send one row for each bucket that they met."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data, offsets in _pieces(batch.column(0)):
                for ids, whole in features(data, offsets, order, buckets)[1]:
                    total += np.bincount(ids[whole], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], names=["bucket", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # at most one row for each bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Scaled logarithms of the smoothed share in the target over that in the corpus, rounded down."""
    s_all, t_all = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(scale * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(id_col: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Gumbel noise of an id, scaled and rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(float(-scale)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, target_text_col: str = "text") -> DataFrame:
    """``(id, key, n_words, n_features, weight, score)`` of every row; key is a hash of the text."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, text_col, order, buckets), bucket_counts(target, target_text_col, order, buckets)))

    def weigh(batches):
        for batch in batches:
            made = [[], [], []]
            for data, offsets in _pieces(batch.column("text")):
                first, levels = features(data, offsets, order, buckets)
                n_features, weight = np.zeros((2, len(first) - 1), np.int64)
                for ids, whole in levels:
                    for total, values in ((n_features, whole), (weight, gain.value[ids] * whole)):
                        sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
                        edge = np.minimum(first, len(sums) - 1)
                        total += sums[edge[1:]] - sums[edge[:-1]]
                for k, values in enumerate((np.diff(first), n_features, weight)):
                    made[k].append(values)
            columns = [pa.array(np.concatenate(m) if m else np.zeros(0, np.int64), pa.int64()) for m in made]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), *columns], names=["id", "key", "n_words", "n_features", "weight"])

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return source.mapInArrow(weigh, "id bigint, key bigint, n_words bigint, n_features bigint, weight bigint").withColumn("score", F.col("weight") + noise(F.col("id"), seed))


class Tournament:
    """A tree of matches between the next rows of pages: the least row wins. Keys are ``(-score, id)``."""

    def __init__(self):
        self.pages: list = [None]
        self.keys: list = [None]
        self.size, self.winner, self.free = 1, [0, 0], [0]

    def _better(self, a: int, b: int) -> int:
        x, y = self.keys[a], self.keys[b]
        return a if y is None or (x is not None and x <= y) else b

    def _replay(self, leaf: int) -> None:
        node = (leaf + self.size) >> 1
        while node:
            left, right = (self._at(2 * node), self._at(2 * node + 1))
            self.winner[node] = self._better(left, right)
            node >>= 1

    def _at(self, node: int) -> int:
        return node - self.size if node >= self.size else self.winner[node]

    def add(self, page) -> None:
        """A page: an iterator of ``(key, row)`` with at least one row."""
        if not self.free:  # twice the leaves, and all matches anew
            old, self.size = self.size, 2 * self.size
            self.pages += [None] * old
            self.keys += [None] * old
            self.free = list(range(2 * old - 1, old - 1, -1))
            self.winner = [0] * self.size
            for node in range(self.size - 1, 0, -1):
                self.winner[node] = self._better(self._at(2 * node), self._at(2 * node + 1))
        leaf = self.free.pop()
        key, row = next(page)
        self.pages[leaf], self.keys[leaf] = [row, page], key
        self._replay(leaf)

    def best(self):
        """The least key, or None."""
        return self.keys[self._at(1)]

    def pop(self):
        """The least row; its page moves on."""
        leaf = self._at(1)
        row, page = self.pages[leaf]
        following = next(page, None)
        if following is None:
            self.pages[leaf] = self.keys[leaf] = None
            self.free.append(leaf)
        else:
            self.keys[leaf], self.pages[leaf][0] = following
        self._replay(leaf)
        return row


#: What goes with a row through the runs, besides the score.
_FIELDS = ("id", "key", "n_words", "n_features", "weight", "score")
_PAGE = f"part int, head bigint, head_id bigint, {', '.join(f'{c} array<bigint>' for c in _FIELDS)}"


def runs(rows: DataFrame, run_rows: int = RUN_ROWS, page: int = PAGE) -> DataFrame:
    """Pages of the sorted runs of ``rows`` (with ``part``)."""

    def cut(tables: list[pa.RecordBatch]):
        columns = {c: np.concatenate([t.column(c).to_numpy(zero_copy_only=False) for t in tables]) for c in ("part", *_FIELDS)}
        order = np.lexsort((columns["id"], -columns["score"], columns["part"]))
        columns = {c: v[order] for c, v in columns.items()}
        borders = np.flatnonzero(np.diff(columns["part"])) + 1
        edges = np.unique(np.concatenate(([0], borders, *(np.arange(a, b, page) for a, b in zip([0, *borders], [*borders, len(order)], strict=True)), [len(order)])))
        heads = edges[:-1]
        lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(columns[c], pa.int64())) for c in _FIELDS]
        return pa.RecordBatch.from_arrays([pa.array(columns["part"][heads], pa.int32()), pa.array(columns["score"][heads]), pa.array(columns["id"][heads]), *lists], names=["part", "head", "head_id", *_FIELDS])

    def work(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= run_rows:
                yield cut(held)
                held, n = [], 0
        if n:
            yield cut(held)

    return rows.select("part", *_FIELDS).mapInArrow(work, _PAGE)


def merged(pages: DataFrame, offsets: dict[int, int], draws: int, parts: int) -> DataFrame:
    """Rows of the pages with their ranks: those of part p follow ``offsets[p]`` others. From the last draw on ranks are null."""

    def out(rows: list, ranks: list):
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(_FIELDS))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(ranks, pa.int64())], names=[*_FIELDS, "rank"])

    def work(batches):
        tree, part, rank, rows, ranks = Tournament(), None, 0, [], []

        def upto(key):
            # Rows that sort no later than the key, but none after the last draw.
            nonlocal rank
            while rank < draws and (best := tree.best()) is not None and (key is None or best <= key):
                rank += 1
                rows.append(tree.pop())
                ranks.append(rank)
                if len(rows) >= 8192:
                    yield out(rows, ranks)
                    rows.clear()
                    ranks.clear()
            if rank >= draws:
                while tree.best() is not None:
                    rows.append(tree.pop())
                    ranks.append(None)

        def of(lists):
            score, ids = lists[_FIELDS.index("score")], lists[0]
            return (((-s, i), row) for s, i, row in zip(score, ids, zip(*lists, strict=True), strict=True))

        for batch in batches:
            for k in range(batch.num_rows):
                here, head, head_id = (batch.column(c)[k].as_py() for c in ("part", "head", "head_id"))
                if here != part:
                    yield from upto(None)
                    part, rank = here, offsets[here]
                yield from upto((-head, head_id))
                lists = [batch.column(c)[k].values.to_pylist() for c in _FIELDS]
                if rank >= draws:  # after the last draw the order doesn't matter
                    rows.extend(zip(*lists, strict=True))
                    ranks.extend([None] * len(lists[0]))
                else:
                    tree.add(of(lists))
                if len(rows) >= 8192:
                    yield out(rows, ranks)
                    rows.clear()
                    ranks.clear()
        yield from upto(None)
        if rows:
            yield out(rows, ranks)

    dealt = pages.repartition(parts, "part").sortWithinPartitions("part", F.desc("head"), "head_id")
    return dealt.mapInArrow(work, ", ".join(f"{c} bigint" for c in (*_FIELDS, "rank")))


def placed(rows: DataFrame, cuts: list[int], inner: dict[int, list[int]]) -> DataFrame:
    """``rows`` with ``part``, from the highest scores on: ranges between the ascending ``cuts``, those in ``inner`` cut by ascending ids too."""
    up = np.array(cuts, np.int64)
    width = np.array([1 + len(inner.get(k, ())) for k in range(len(up) + 1)])
    base = np.cumsum(width) - width

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("score", "id"))
        at = len(up) - np.searchsorted(up, score, side="right")
        part = base[at]
        for k, by_id in inner.items():
            here = at == k
            part[here] += np.searchsorted(np.array(by_id, np.int64), ids[here], side="right")
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=[*batch.schema.names, "part"])

    return arrays.map_batches(rows, work, rows.withColumn("part", F.lit(0)).schema)


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, range_rows: int = RANGE_ROWS, **options) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... for the drawn rows, null for the others. ``scored`` is written once and read several times."""
    spark = scored.sparkSession
    scored = durable.keep(scored.select(*_FIELDS))
    eligible = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    rows = scored.where(eligible)
    total = rows.count()
    draws = total * percent // 100
    undrawn = F.lit(None).cast("bigint").alias("rank")
    if not draws:
        return scored.select("*", undrawn)
    # Cuts for the drawn part, and three steps beyond it; the sketch's error is a sixteenth of a step.
    steps = max(-(-draws // range_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [share for k in range(1, steps + 4) if (share := k * draws / steps / total) < 1]
    accuracy = min(max(10_000, 16 * steps * total // draws), 2**31 - 1)
    found = rows.agg(F.percentile_approx("score", [1 - s for s in shares], accuracy)).first()[0] if shares else []
    # A score that several cuts share has a range of its own.
    cuts = sorted({c for c in found} | {c + 1 for c in found if found.count(c) > 1})
    dealt = placed(rows, cuts, {})
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.min("id").alias("first"), F.max("id").alias("last")).collect()
    aim, inner = max(draws // steps, 1), {}
    for r in sizes:
        if r.n > 4 * aim and r.low == r.high and r.first < r.last:
            n = min(r.n // aim, _SUBS)
            by_id = dealt.where(F.col("part") == r.part).agg(F.percentile_approx("id", [k / n for k in range(1, n)], 4 * int(n) + 10_000)).first()[0]
            inner[r.part] = sorted(set(by_id))
    if inner:
        dealt = placed(rows, cuts, inner)
        sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()
    before, offsets = 0, {}
    for r in sorted(sizes, key=lambda r: r.part):
        if before < draws:
            offsets[r.part] = before
        before += r.n
    last = max(offsets)
    inside = merged(runs(dealt.where(F.col("part") <= last), **options), offsets, draws, len(offsets))
    beyond = dealt.where(F.col("part") > last).select(*_FIELDS, undrawn)
    return inside.unionByName(beyond).unionByName(scored.where(~F.coalesce(eligible, F.lit(False))).select("*", undrawn))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with ``rank`` (the least of equal rows) and ``draws``, or such names with ``_`` where they are taken.

    Rows of equal id and text are one row here; which of their other columns stay is not fixed.
    """
    drawn = ranked(scores(docs, target, id_col, text_col, **options), percent, least_words).where("rank is not null")
    keys = drawn.groupBy("id", "key").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("draws"))
    names = {}
    for n in ("rank", "draws", "id", "key"):
        names[n] = n
        while names[n].lower() in {c.lower() for c in docs.columns}:
            names[n] += "_"
    keys = keys.withColumnsRenamed(names)
    source = docs.withColumn(names["key"], F.xxhash64(text_col)).withColumn(names["id"], F.col(f"`{id_col}`").cast("bigint"))
    source = source.join(keys.select(names["id"], names["key"]), [names["id"], names["key"]], "left_semi").dropDuplicates([names["id"], names["key"]])
    return source.join(keys, [names["id"], names["key"]]).select(*(F.col(f"`{c}`") for c in docs.columns), names["rank"], names["draws"])


def op12_resample(spark, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, with all benchmark texts as the target."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return ranked(scores(docs, target)).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


ORACLE_SQL = r"""
WITH RECURSIVE step AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) AS r(i)
  UNION ALL
  SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY byte) AS t FROM step WHERE k = 8
), word AS (
  SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), kind AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(w)) + 1), lambda k: ('0x' || substr(hex(encode(w)), 2 * k - 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM word), crc
), total AS (
  SELECT count(*) FILTER (kind = 'd') AS s_all, count(*) FILTER (kind = 'b') AS t_all FROM word
), met AS (
  SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM word JOIN kind USING (w) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS g FROM met, total
), weight AS (
  SELECT id, count(*) AS n, sum(g)::BIGINT AS w FROM word JOIN kind USING (w) JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(w, 0)::BIGINT AS weight,
         coalesce(w, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weight ON doc_id = id
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20
), draws AS (
  SELECT (10 * count(*)) // 100 AS n FROM placed
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= draws.n THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id), draws
"""
