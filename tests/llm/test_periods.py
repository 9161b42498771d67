import hashlib
import random
import re
import zlib

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import periods

WORD = r"[^\x20\x09-\x0D]+"


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[: len(w) - q])


def brute_runs(w, least=24, times=3):
    """(start, length, period), by looking at every stretch that a period can't extend."""
    out = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q) and smallest_period(w[i : j + q]) == q:
                out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return [x for k, x in enumerate(w) if k not in gone]


def planted_words(doc, text):
    w = re.findall(WORD, text or "")
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(w)
    if doc is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def periodic(r):
    """A text of random words with blocks that repeat, some in others."""
    out = []
    for _ in range(r.randint(1, 5)):
        block = r.choices("abcdefgh", k=r.choice((1, 1, 2, 3, 5, 9, 17)))
        if r.random() < 0.4:
            block = block * r.randint(1, 4) + r.choices("abc", k=1)
        out += block * r.randint(1, 14) + block[: r.randrange(len(block))] + r.choices("abcdefgh", k=r.randint(0, 9))
    return out


@pytest.mark.parametrize("least,times", [(24, 3), (4, 2), (9, 3), (1, 3)])
def test_runs_against_every_stretch(least, times):
    r = random.Random(least * 10 + times)
    for _ in range(120):
        rows = [periodic(r) if r.random() < 0.9 else [] for _ in range(r.randint(1, 5))]
        first = np.cumsum([0, *map(len, rows)])
        words = np.array([ord(x) for row in rows for x in row], np.int64)
        start, end, q = periods.find_runs(words, first, least, times)
        want = [(int(first[k]) + s, int(first[k]) + s + n, p) for k, row in enumerate(rows) for s, n, p in brute_runs(row, least, times)]
        assert list(zip(start.tolist(), end.tolist(), q.tolist(), strict=True)) == want


def test_extensions():
    r = random.Random(8)
    for _ in range(40):
        w = periodic(r)
        levels = periods.block_names(np.array([ord(x) for x in w], np.int64), np.zeros(len(w), np.int64))
        i, j = np.array(sorted(sorted((r.randrange(len(w)), r.randrange(len(w)))) for _ in range(30))).T
        i, j = i[i < j], j[i < j]
        on = [next((k for k in range(len(w) - b) if w[a + k] != w[b + k]), len(w) - b) for a, b in zip(i, j, strict=True)]
        back = [next((k for k in range(a) if w[a - 1 - k] != w[b - 1 - k]), a) for a, b in zip(i, j, strict=True)]
        assert periods.extension(levels, i, j).tolist() == on and periods.extension_before(levels, i, j).tolist() == back


def rows_with_runs(seed=3):
    r = random.Random(seed)
    rows = corpus.documents()
    rows += [(1000 + k, r.choice((" ", "\t", "\n\n")).join(periodic(r)) + " é", "en", "s", 0) for k in range(60)]
    rows += [(2000, "ab " * 5000, None, None, None), (2001, "x" * 50_000, None, None, 1), (None, "a b " * 30, None, None, 1), (None, None, None, None, 1), rows[-1]]
    return rows


def test_query_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(periods, "PLACES", 500)
    rows = rows_with_runs()
    df = periods.op11_periods(spark, corpus.saved(spark, tmp_path, rows))
    assert [(c, k) for c, k in df.dtypes] == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    want = []
    for doc, text, *_ in rows:
        w = planted_words(doc, text)
        runs = brute_runs(w) if len(set(w)) > 1 else [(0, len(w), 1)] * (len(w) >= 24)
        best = None
        for s, n, q in runs:
            if best is None or n * best[2] > best[1] * q:
                best = (s, n, q)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(kept(w, runs)))))
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert sum(x[1] for x in want) > 40 and any(x[1] and x[0] is not None and x[0] < 1000 for x in want)


def test_texts_spans_and_clashing_columns(spark):
    rows = rows_with_runs(5)
    docs = corpus.frame(spark, rows).withColumnsRenamed({"lang": "runs", "source": "n_words"}).withColumn("_id", F.lit(1))
    made = periods.periodic_runs(docs, least=9, times=2)
    assert set(made.columns) == {*docs.columns, *periods.RESULTS}
    got = sorted(((r.doc_id, r.text, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in made.where("doc_id < 2000").collect()), key=str)
    want = []
    for doc, text, *_ in rows:
        if doc is not None and doc < 2000:
            w = re.findall(WORD, text or "")
            runs = brute_runs(w, 9, 2) if len(set(w)) > 1 else [(0, len(w), 1)] * (len(w) >= 9)
            want.append((doc, text, len(w), runs, None if text is None else " ".join(kept(w, runs))))
    assert got == sorted(want, key=str)
    # The text may be in a column that has a result's name.
    again = periods.periodic_runs(docs.select("doc_id", F.col("text").alias("collapsed")), text_col="collapsed", least=9, times=2).where("doc_id < 2000")
    assert sorted((r.doc_id, r.collapsed) for r in again.collect()) == sorted((d, c or None if t is None else c) for d, t, _, _, c in got)


def test_empty_table(spark, tmp_path):
    assert periods.op11_periods(spark, corpus.saved(spark, tmp_path, [])).count() == 0


def test_grows_little_more_than_text():
    """The same word again and again is the worst case of the grid."""
    for n in (1000, 200_000):
        start, end, q = periods.find_runs(np.zeros(n, np.int64), np.array([0, n]))
        assert (start.tolist(), end.tolist(), q.tolist()) == ([0], [n], [1])
