import corpus
import duckdb
import numpy as np
import pytest

from fieldloom.llm import mixing


def test_against_sql(spark, tmp_path):
    folder = corpus.saved(spark, tmp_path)
    df = mixing.op2_mixing(spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    other = con.sql(mixing.ORACLE_SQL)
    order = [other.columns.index(c) for c in df.columns]
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(df.collect()) == text(tuple(r[k] for k in order) for r in other.fetchall())


def test_raking_meets_every_marginal():
    r = np.random.default_rng(2)
    codes = [r.integers(0, n, 60) for n in (4, 3, 2)]
    cells = r.integers(1, 1000, 60)
    targets = [(x := r.random(n)) / x.sum() for n in (4, 3, 2)]
    weights = mixing.rake(cells, codes, targets, 200)
    for code, target in zip(codes, targets, strict=True):
        assert np.allclose(np.bincount(code, weights, len(target)), target, atol=1e-9)


def test_targets_that_cannot_be_met_are_told():
    cells, codes = np.array([3, 5]), [np.array([0, 1]), np.array([0, 1])]
    with pytest.warns(UserWarning, match="off its target by 0.4"):
        mixing.rake(cells, codes, [np.array([0.7, 0.3]), np.array([0.3, 0.7])])


@pytest.mark.parametrize("share", [0.1, 0.6, 1.0])
def test_calibrated_probabilities(share):
    r = np.random.default_rng(3)
    cells, factors = r.integers(1, 1000, 50), r.random(50)
    p, scaled = mixing.calibrate(cells, factors, share * cells.sum())
    assert (p <= 1).all() and np.isclose((cells * p).sum(), share * cells.sum()) and np.allclose(p, np.minimum(1, scaled))


def test_targets_columns_and_draws(spark):
    df = corpus.frame(spark)
    mixed = mixing.mix(df, targets={"lang": {"de": 0.5, "en": 0.5}}).collect()
    assert [r.p for r in mixed if r.lang == "fr" and r.n_tokens] and all(r.p == 0 and not r.sampled for r in mixed if r.lang == "fr")
    assert {r.topic for r in mixed if not r.n_tokens} == {"empty"} and all(not r.sampled for r in mixed if not r.n_tokens)
    clash = mixing.mix(df.withColumnRenamed("n_chars", "p"))
    assert clash.columns == ["doc_id", "text", "lang", "source", "n_tokens", "topic", "p", "weight", "sampled"]
    again = mixing.mix(df.repartition(5)).collect()
    assert {r.doc_id: r.sampled for r in again} == {r.doc_id: r.sampled for r in mixing.mix(df).collect()}


def test_bounds_and_empty_tables(spark, monkeypatch):
    assert mixing.mix(corpus.frame(spark).limit(0)).count() == 0
    monkeypatch.setattr(mixing, "MOST_CELLS", 2)
    with pytest.raises(ValueError, match="cells"):
        mixing.mix(corpus.frame(spark))
