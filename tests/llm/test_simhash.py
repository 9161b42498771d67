import random
import re

import corpus
import numpy as np
import pytest
import xxhash

from fieldloom.llm import simhash
from fieldloom.llm.components import components


def by_hand(text, size=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + size]).encode(), 42) for k in range(max(1, len(words) - size + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(fps, radius):
    up = {k: k for k in fps}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    items = list(fps.items())
    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            if bin(x ^ y).count("1") <= radius:
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {k: find(k) for k in fps}


def test_against_brute_force(spark, tmp_path):
    rows = corpus.documents()
    folder = corpus.saved(spark, tmp_path, rows)
    fps = {d: by_hand(t) for d, t, *_ in rows}
    want = groups(fps, 4)
    got = simhash.op5_simhash(spark, folder).collect()
    assert len(got) == len(rows)
    assert all(r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id] for r in got)


def near(r, center, most):
    for k in r.sample(range(64), r.randint(0, most)):
        center ^= 1 << k
    return center


@pytest.mark.parametrize("leaf, radius", [(2048, 4), (8, 4), (16, 2), (0.001, 4)])
def test_index_is_exact(spark, monkeypatch, leaf, radius):
    monkeypatch.setattr(simhash, "LEAF", max(leaf, 2))
    if leaf < 1:  # two blocks in front
        orders = simhash.fronts(radius, 2 << 20)
        monkeypatch.setattr(simhash, "fronts", lambda radius, count: orders)
    r = random.Random(leaf)
    centers = [r.getrandbits(64) for _ in range(10)]
    fps = {k: near(r, r.choice(centers), 7) for k in range(250)} | {k: r.getrandbits(64) for k in range(250, 300)}
    signed = [(k, np.array([f], np.uint64).astype(np.int64).item()) for k, f in fps.items()]
    table = spark.createDataFrame(signed, "doc long, fp long")
    found = {x.id: x.component for x in components(simhash.links(table.select("fp").distinct(), radius)).collect()}
    want = groups(fps, radius)
    label = {}
    for k, fp in signed:
        assert label.setdefault(want[k], found.get(fp, fp)) == found.get(fp, fp)
    assert len(set(label.values())) == len(label)


def test_pairs_of_leaves_grow_with_the_leaves(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 4)
    r = np.random.default_rng(1)
    per_value = []
    for count in (1 << 12, 1 << 14, 1 << 16, 1 << 18):
        orders = simhash.fronts(4, count)
        fps = np.unique(r.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2))
        pairs = 0
        for order in orders[:2]:
            _, sizes = np.unique(simhash.ordered(fps, order) >> np.uint64(64 - order[-1][1]), return_counts=True)
            leaves = -(-sizes // 4)
            pairs += int((leaves * (leaves - 1) // 2).sum())
        per_value.append(pairs / count)
    assert max(per_value) < 2
    assert len(simhash.fronts(4, 10)) == 5 and len(simhash.fronts(4, 4 << 20)) == 15
    assert all(sorted(order[:-1])[0][0] == 0 and sum(w for _, w in order[:-1]) == 64 for order in simhash.fronts(4, 4 << 20))


def test_gray_order():
    rank = simhash.gray_rank(np.array([0, 1, 3, 2, 6], np.uint64)).tolist()
    assert rank == [0, 1, 2, 3, 4]


def test_search_of_two_sides_links_what_is_near():
    r = random.Random(1)
    left, right = (np.array([near(r, 12345, 5) for _ in range(40)], np.uint64) for _ in range(2))
    close = {(i, 40 + j) for i in range(40) for j in range(40) if bin(int(left[i]) ^ int(right[j])).count("1") <= 4}
    found = simhash.search(left, right, 4)
    assert set(found) <= close and {i for i, _ in close} | {j for _, j in close} == {x for pair in found for x in pair}


def test_components(spark):
    r = random.Random(2)
    for case in ([(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)], [(r.randrange(80), r.randrange(80)) for _ in range(60)], [(1, 1)], []):
        links = spark.createDataFrame([*case, (None, 3)], "a long, b long")
        up = {x: x for pair in case if pair[0] != pair[1] for x in pair}

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in case:
            if a != b:
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
        assert {x.id: x.component for x in components(links).collect()} == {x: find(x) for x in up}
        rough = {x.id: x.component for x in components(links, rounds=1, exact=False).collect()}
        assert set(rough) == set(up) and all(find(c) == find(x) for x, c in rough.items())


def test_empty_table(spark):
    assert simhash.near_duplicates(corpus.frame(spark).limit(0)).count() == 0
