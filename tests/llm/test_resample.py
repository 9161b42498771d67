import hashlib
import math
import random
import re
import zlib
from collections import Counter

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import resample

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TARGET = ["the and the ing tion", "un deux ß é", None, "", "the"]


def bags(text, order):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % resample.BUCKETS for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, order=1, percent=10, least=20):
    """Sorted (doc, n_features, weight, score, rank) of every row, by the definition."""
    s, t = Counter(), Counter()
    for _, text, *_ in rows:
        s.update(bags(text, order)[1])
    for text in target:
        t.update(bags(text, order)[1])
    s_all, t_all, b = sum(s.values()), sum(t.values()), resample.BUCKETS
    made = []
    for doc, text, *_ in rows:
        n, own = bags(text, order)
        weight = sum(math.floor(1000 * math.log((t[k] + 1) * (s_all + b) / ((s[k] + 1) * (t_all + b)))) for k in own)
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        made.append((doc, n, len(own), weight, score))
    able = sorted((m for m in made if m[4] is not None and m[1] >= least), key=lambda m: (-m[4], m[0]))
    draws = percent * len(able) // 100
    out = [(d, f, w, s, k + 1) for k, (d, _, f, w, s) in enumerate(able[:draws])]
    gone = Counter((d, f, w, s) for d, f, w, s, _ in out)
    for d, _, f, w, s in made:
        if gone[d, f, w, s]:
            gone[d, f, w, s] -= 1
        else:
            out.append((d, f, w, s, None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("id", "n_features", "weight", "score", "rank").collect()), key=str)


def target(spark, texts=TARGET):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")


@pytest.mark.parametrize("order,percent", [(1, 10), (1, 60), (3, 35), (1, 100)])
def test_against_definition(spark, order, percent):
    rows = [*corpus.documents(), (None, "the and " * 30, "en", "s", 1), (None, None, None, None, None)]
    df = resample.ranked(resample.scores(corpus.frame(spark, rows), target(spark), order=order), percent, range_rows=7, run_rows=5, page=2)
    assert got(df) == brute(rows, TARGET, order, percent)


def test_long_words_and_long_texts(spark):
    r = random.Random(4)
    rows = [(k, " ".join("".join(r.choices("abcé", k=r.choice((1, 3, 47, 48, 49, 300)))) for _ in range(40)), None, None, 0) for k in range(12)]
    rows += [(90, "x" * 100_000, None, None, 0), (91, "the tion " * 60_000, None, None, 0)]
    assert got(resample.ranked(resample.scores(corpus.frame(spark, rows), target(spark)), 50)) == brute(rows, TARGET, percent=50)


def test_crc_registers():
    r = random.Random(1)
    for _ in range(20):
        parts = [bytes(r.choices(range(256), k=r.choice((0, 1, 5, 48, 60)))) for _ in range(r.randint(0, 30))]
        raw = np.frombuffer(b"".join(parts) or b"\0", np.uint8)
        ends = np.cumsum([0, *map(len, parts)])
        made = resample.advanced(np.full(len(parts), 0xFFFFFFFF, np.uint32), raw, ends[:-1], ends[1:]) ^ np.uint32(0xFFFFFFFF)
        assert made.tolist() == [zlib.crc32(p) for p in parts]


def test_tournament_against_sorting():
    r = random.Random(2)
    for _ in range(60):
        pages = [sorted((r.randint(-9, 9), r.randint(0, 5)) for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 20))]
        tree, out, waiting = resample.Tournament(), [], sorted(pages)
        for page in waiting:  # by their first rows, as the merge gets them
            while tree.best() is not None and tree.best() <= page[0]:
                out.append(tree.pop())
            tree.add(iter([(k, k) for k in page]))
        while tree.best() is not None:
            out.append(tree.pop())
        assert out == sorted(k for p in pages for k in p)


@pytest.mark.parametrize("scores", ["one", "few", "hot"])
def test_ties_of_very_many_rows(spark, scores):
    """Scores that most rows share are cut by id; equal rows have ranks of their own."""
    score = {"one": F.lit(5), "few": F.col("id") % 3, "hot": F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7)}[scores]
    rows = spark.range(3000).union(spark.range(50)).select("id", F.lit(1).alias("key"), F.lit(30).alias("n_words"), F.lit(30).alias("n_features"), F.lit(0).alias("weight"), score.cast("bigint").alias("score"))
    rows = rows.select(*(F.col(c).cast("bigint") for c in rows.columns)).repartition(4)
    made = resample.ranked(rows, 40, range_rows=40, run_rows=100, page=8).where("rank is not null").select("rank", "score", "id").orderBy("rank").collect()
    want = sorted(((-r.score, r.id) for r in rows.collect()))[: 3050 * 40 // 100]
    assert [(-r.score, r.id) for r in made] == want and [r["rank"] for r in made] == list(range(1, len(want) + 1))


def test_pages_stay_bounded():
    """At most one page of each run is open, whatever comes."""
    r = random.Random(3)
    every = [sorted((r.random(), k) for k in range(400)) for _ in range(6)]
    pages = sorted(p[a : a + 10] for p in every for a in range(0, 400, 10))
    tree, most = resample.Tournament(), 0
    for page in pages:
        while tree.best() is not None and tree.best() <= page[0]:
            tree.pop()
        tree.add(iter([(k, k) for k in page]))
        most = max(most, sum(k is not None for k in tree.keys))
    assert most <= 6


def test_empty_tables(spark):
    none = corpus.frame(spark, []).coalesce(1)
    assert got(resample.ranked(resample.scores(none, target(spark, [])))) == []
    rows = corpus.documents()
    assert got(resample.ranked(resample.scores(corpus.frame(spark, rows), target(spark, []).coalesce(1)))) == brute(rows, [])


def test_drawn_rows_with_clashing_columns(spark):
    rows = corpus.documents()
    docs = corpus.frame(spark, rows).withColumnsRenamed({"source": "rank", "lang": "id", "n_chars": "score"})
    made = resample.resample(docs, target(spark), percent=50)
    assert made.columns == [*docs.columns, "rank_", "draws"]
    ranks = {}
    for d, *_, rank in brute(rows, TARGET, percent=50):
        if rank:
            ranks.setdefault(d, []).append(rank)
    out = {r.doc_id: r for r in made.collect()}
    assert {d: (min(k), len(k)) for d, k in ranks.items()} == {d: (r.rank_, r.draws) for d, r in out.items()}
    texts = {d: t for d, t, *_ in rows}
    assert all(r.text == texts[d] for d, r in out.items())


def test_query(spark, tmp_path):
    rows = corpus.documents()
    corpus.saved(spark, tmp_path, rows)
    target(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    df = resample.op12_resample(spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {k for _, k in df.dtypes} == {"bigint"}
    assert got(df.withColumnRenamed("doc_id", "id")) == brute(rows, TARGET)
