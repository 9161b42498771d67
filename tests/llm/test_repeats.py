import hashlib
import random
import re

import corpus
import numpy as np
import pytest

from fieldloom.llm import phrases, suffixes


def brute(rows, split, join, length):
    """{(doc, text): (units, removed, spans, digest)} by looking at every window."""
    first, units = {}, {}
    for doc, text, *_ in rows:
        u = units[doc, text] = split(text or "")
        for k in range(len(u) - length + 1):
            w = tuple(u[k : k + length])
            first[w] = min(first.get(w, doc), doc)
    out = {}
    for (doc, text), u in units.items():
        gone = bytearray(len(u))
        for k in range(len(u) - length + 1):
            if first[tuple(u[k : k + length])] < doc:
                gone[k : k + length] = b"\1" * length
        kept = join([x for x, g in zip(u, gone, strict=True) if not g])
        out[doc, text] = (len(u), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [50, 6])
def test_words(spark, length):
    rows = corpus.documents()
    want = brute(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), lambda w: " ".join(w).encode(), length)
    got = phrases.remove_repeats(corpus.frame(spark, rows), length).collect()
    texts = {d: t for d, t, *_ in rows}
    assert len(got) == len(rows) and any(r.n_removed for r in got)
    for r in got:
        n, gone, _, digest = want[r.doc_id, texts[r.doc_id]]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, digest)
        assert r.text == texts[r.doc_id] or r.n_removed


@pytest.mark.parametrize("length", [50, 9])
def test_bytes(spark, length, monkeypatch):
    rows = corpus.documents()
    want = brute(rows, lambda t: list(t.encode()), bytes, length)
    got = suffixes.remove_repeats(corpus.frame(spark, rows).withColumnRenamed("source", "row_key"), length).collect()
    texts = {d: t for d, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id, texts[r.doc_id]]
        assert (r.kept is None) == (texts[r.doc_id] is None)


def test_interval_expansion_against_windows():
    r = random.Random(3)
    for _ in range(40):
        base = "".join(r.choice("ab") for _ in range(80))
        texts = [(base[(a := r.randrange(70)) : a + r.randrange(30)] + "".join(r.choices("abc", k=r.randrange(20))) + base[: r.randrange(40)]).encode() for _ in range(6)]
        owners, length = np.array([r.randrange(9) for _ in texts], np.int64), r.choice([3, 5, 12, 20])
        least = {}
        for text, owner in zip(texts, owners.tolist(), strict=True):
            for k in range(len(text) - length + 1):
                least[text[k : k + length]] = min(least.get(text[k : k + length], 99), owner)
        for text, got in zip(texts, suffixes.least_owner(texts, owners, length), strict=True):
            assert got.tolist() == [least[text[k : k + length]] for k in range(max(0, len(text) - length + 1))]


def test_rows_without_id_and_rows_that_share_one(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(None, long, None, None, 1), (1, "a b", None, None, 1), (1, long, None, None, 1), (2, long, None, None, 1), (2, "c d", None, None, 1)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in phrases.remove_repeats(corpus.frame(spark, rows)).collect())
    assert got == [(0, 60, 0), (1, 2, 0), (1, 60, 0), (2, 2, 0), (2, 60, 60)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(corpus.frame(spark, rows)).collect())
    n = len(long)
    assert got == [(0, n, 0), (1, 3, 0), (1, n, 0), (2, 3, 0), (2, n, n)]


def thue_morse(order, one, other):
    """Two texts that hashes by powers of a base modulo 2^64 can't tell apart."""
    bits = [bin(k).count("1") & 1 for k in range(1 << order)]
    return "".join((one, other)[b] for b in bits), "".join((other, one)[b] for b in bits)


def test_texts_that_collide_modulo_2_to_64(spark):
    x, y = thue_morse(11, "a", "b")
    start, end = (" ".join(f"{c}{k}" for k in range(30)) for c in "st")
    rows = [(1, f"{start} {x} {end}", None, None, 1), (2, f"{start} {y} {end}", None, None, 1), (3, f"{start} {y} {end}", None, None, 1)]
    got = {r.doc_id: r.n_removed for r in phrases.remove_repeats(corpus.frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 61}
    want = brute(rows, lambda t: list(t.encode()), bytes, 50)
    for r in suffixes.remove_repeats(corpus.frame(spark, rows)).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id, rows[r.doc_id - 1][1]]


def test_the_transform_decides_every_span(spark, monkeypatch):
    """Pieces that are taken for equal by a hash, but aren't; and equal ones that the transform is told to pass."""
    docs, keys, starts = np.array([1, 2, 3]), np.zeros(3, np.int64), np.zeros(3, np.int64)
    texts = [b"a" * 30 + b"b" * 30, b"a" * 30 + b"c" * 30, b"a" * 30 + b"c" * 30]
    got = suffixes.decide(np.ones(3, np.uint64), docs, keys, starts, texts, 50)
    assert {k: v.tolist() for k, v in got.items()} == {"doc": [3], "row_key": [0], "start": [0], "stop": [60]}
    monkeypatch.setattr(suffixes, "least_owner", lambda texts, owners, length: [np.full(len(t) - length + 1, 99) for t in texts])
    assert not len(suffixes.decide(np.ones(3, np.uint64), docs, keys, starts, texts, 50)["doc"])


def test_automaton():
    shard = phrases.Shard({b"a b c": 1, b"c d": 5})
    assert shard.locate(b"a b c d".split(), 3) == [[0, 3]] and shard.locate(b"a b c d".split(), 9) == [[0, 4]]
    assert shard.locate(b"a b c".split(), 1) == [] and shard.locate(b"a b c".split(), None) == [] and phrases.Shard({}).locate([b"a"], 2) == []


def test_very_long_and_monotonous_texts(spark):
    rows = [(1, "word " * 60_000, None, None, 1), (2, "word " * 90_000 + "end", None, None, 1)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in phrases.remove_repeats(corpus.frame(spark, rows)).collect()}
    assert got == {1: (60_000, 0), 2: (90_001, 90_000)}


def test_empty_tables(spark):
    empty = corpus.frame(spark).limit(0)
    assert phrases.remove_repeats(empty).count() == 0 and suffixes.remove_repeats(empty).count() == 0


def test_queries(spark, tmp_path):
    folder = corpus.saved(spark, tmp_path)
    assert phrases.op8_phrases(spark, folder).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert suffixes.op9_suffixes(spark, folder).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_suffix_order_by_sorting():
    r = random.Random(8)
    for n, depth, letters in ((0, 9, b"ab"), (1, 51, b"a"), (300, 51, b"ab"), (400, 20, b"a"), (500, 8, b"abc"), (700, 51, bytes(range(256)))):
        text = bytes(r.choices(letters, k=n)) * 2
        order = suffixes.suffix_order(np.frombuffer(text, np.uint8), depth).tolist()
        assert sorted(order) == list(range(len(text)))
        assert [text[k : k + depth] for k in order] == sorted(text[k : k + depth] for k in range(len(text)))


def test_runs_of_windows_of_all_rows_at_once():
    """Rows that hold one text are judged by their own documents, in parts of any size."""
    r = random.Random(4)
    judged = [np.array([r.randrange(6) for _ in range(n)], np.int64) for n in (5, 0, 1, 40, 7)]
    text = np.array([r.randrange(5) for _ in range(60)])
    doc = np.array([r.randrange(7) for _ in text], np.int64)
    want = [(k, m.start(), m.end()) for k, (t, d) in enumerate(zip(text.tolist(), doc.tolist(), strict=True)) for m in re.finditer(b"\1+", bytes((judged[t] < d).astype(np.uint8)))]
    for most in (1, 9, 100, 10**6):
        assert [tuple(map(int, x)) for part in suffixes.hits(judged, text, doc, most) for x in zip(*part, strict=True)] == want
