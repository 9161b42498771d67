import random

import corpus
import corpus_pipeline as pipeline
import numpy as np

from fieldloom.llm import shingles


def sets(text, size=5):
    w = text.lower().split()
    return {" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def rows(count=120, seed=3):
    """Texts of 40 to 300 words, each with copies of which one word in 20 to 100 was changed."""
    r, out = random.Random(seed), []
    for k in range(count):
        base = corpus.words(r, r.randint(40, 300))
        base = [f"{w}{r.randrange(1000)}" for w in base]
        for c in range(3):
            w = base.copy()
            for at in r.sample(range(len(w)), max(1, c * len(w) // 80) if c else 0):
                w[at] = f"changed{r.randrange(10**6)}"
            out.append((10 * k + c, " ".join(w), "en", "s", 1))
    return out


def test_recall_against_brute_force(spark):
    every = rows()
    own = {d: sets(t) for d, t, *_ in every}
    want = [(a, b) for a in own for b in own if a // 10 == b // 10 and a < b and len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])]
    assert len(want) > 150
    part = {x.doc_id: x.component for x in shingles.near_copies(corpus.frame(spark, every)).collect()}
    recall = np.mean([part[a] == part[b] for a, b in want])
    assert recall >= 0.98
    up = {d: d for d in own}
    for a, b in want:  # groups by brute force
        x, y = up[a], up[b]
        up = {d: min(x, y) if u in (x, y) else u for d, u in up.items()}
    linked = {(a, b) for a in own for b in own if a < b and part[a] == part[b]}
    assert all(up[a] == up[b] for a, b in linked)


def test_pipeline_drops_near_copies_and_keeps_rows(spark, tmp_path):
    r = random.Random(1)
    base, other = ([f"{a}{b}{k}" for k, (a, b) in enumerate(zip(corpus.words(r, 300), corpus.words(r, 300), strict=True))] for _ in range(2))
    near = base.copy()
    near[40] = near[150] = near[260] = "changed"
    made = [(1, " ".join(base), "en", "s", 1), (2, " ".join(near), "en", "s", 1), (1, " ".join(other), "en", "s", 1), (1, " ".join(base), "en", "s", 1)]
    left = pipeline.near_dedup(spark, corpus.frame(spark, made), str(tmp_path)).collect()
    assert sorted((x.doc_id, x.text) for x in left) == sorted([(1, " ".join(base)), (1, " ".join(other))])


def test_rows_of_equal_id_and_text_leave_a_defined_one(spark):
    """Of rows that differ in other columns alone one stays, the same whatever the order of rows."""
    text = "one and the same text of some more words than five"
    every = [(7, text, "en", "a", 1), (7, text, "de", "b", 1), (8, text, "fr", "c", 1), (7, "quite another text under the id of the others here", "en", "a", 1)]
    kept = []
    for some in (every, every[::-1]):
        kept.append(sorted(tuple(x) for x in shingles.first_copies(corpus.frame(spark, some)).collect()))
    assert kept[0] == kept[1] and len(kept[0]) == 2 and {x[0] for x in kept[0]} == {7}


def test_empty_table(spark):
    assert shingles.first_copies(corpus.frame(spark).limit(0)).count() == 0


def test_nodes_of_one_key_that_are_apart_are_joined_by_stars(spark):
    """Two families that share a key: stars join each, and no link is lost."""
    met = spark.createDataFrame([(1, h, 10, 0) for h in range(40)], "key long, h long, n long, h0 long")
    none = spark.createDataFrame([], "id long, component long")
    stars = shingles._starred(met, none).collect()
    assert len(stars) == 39 + 38 and len({x.a for x in stars} | {x.b for x in stars}) == 40
    assert shingles._meeting(met, none).count() == 40 * 39 // 2
    assert shingles._meeting(met, spark.createDataFrame([(h, 0) for h in range(40)], "id long, component long")).count() == 0
