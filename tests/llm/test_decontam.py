import hashlib
import re

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import decontam

LONG = " ".join(f"w{k}" for k in range(30))
DOCS = [
    (1, f"Start {LONG.upper()}! end"),
    (2, None),
    (3, ""),
    (4, "one, TWO three"),
    (5, "w0 w1 w2 w3 w4 w5 w6 w7 w8 x9"),
    (6, "été " * 12),
    (6, "été " * 12),
    (7, " ".join(LONG.split()[5:16]) + "   " + LONG + " one two"),
]
ITEMS = [(1, LONG), (2, "one two"), (10, None), (11, "  "), (12, "été " * 10), (9, " ".join(LONG.split()[:12]))]


def brute(docs, items, n=10):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    needles = {}
    for item, text in items:
        w = split(text)
        for k in range(max(len(w) - n, 0) + 1 if w else 0):
            needles.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for size in {len(x) for x in needles}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in needles:
                    hit |= set(range(k, k + size))
                    found |= needles[tuple(w[k : k + size])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [10_000, 60])
def test_blocks_make_no_difference(spark, block_bytes):
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, "Before; " + ", ".join(words) + "! after", "x", 5), (2, "short - one. three", "y", 6)], "doc_id long, text string, hit_items string, n_words long")
    bench = spark.createDataFrame([(k, " ".join(words[a:b])) for k, (a, b) in enumerate([(0, 12), (5, 20), (12, 24), (24, 36)])] + [(9, "one"), (10, "three")], "item_id long, text string")
    cut = {r.doc_id: r for r in decontam.decontaminate(docs, bench, remove="spans", block_bytes=block_bytes).collect()}
    assert cut[1].text == "Before; , w36, w37, w38, w39! after" and cut[2].text == "short - "
    assert (cut[1].hit_items, cut[1].n_words) == ("x", 5)
    assert decontam.decontaminate(docs, bench, block_bytes=block_bytes).count() == 0
    with pytest.raises(ValueError):
        decontam.decontaminate(docs, bench, most_bytes=10)


def test_very_long_text(spark):
    words = " ".join(f"w{k}" for k in range(200_000))
    docs = spark.createDataFrame([(1, words)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(199_980, 200_000)))], "item_id long, text string")
    got = decontam.contamination(docs, bench).select("n_words", "hit_spans").first()
    assert got.n_words == 200_000 and [(s.first, s.last) for s in got.hit_spans] == [(199_980, 200_000)]


@pytest.mark.parametrize("block_bytes", [10_000, 100])
def test_against_brute_force(spark, block_bytes):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("n_chars", F.lit(1)).repartition(3)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontam.contamination(docs, bench, block_bytes=block_bytes)
    got = [(r.doc_id, r.n_words, r.hit, len(r.hit_items), hashlib.sha256(",".join(r.hit_items).encode()).hexdigest(), r.hit > 0) for r in found.withColumn("hit", decontam.hit_words(F.col("hit_spans"))).collect()]
    assert sorted(got) == brute(DOCS, ITEMS)


def test_removal(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontam.decontaminate(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]
    cut = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[1] == "Start ! end" and cut[4] == " three" and cut[5] == DOCS[4][1] and cut[2] is None


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("size(hit_spans) > 0").count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(DOCS)
    with pytest.raises(ValueError):
        decontam.decontaminate(docs, bench, remove="words")
