"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells (source x language x topic) are raked in turn to the
target share of every source, language and topic, until no share is off by more
than ``tolerance`` (targets that no weights can meet, as by categories that never occur
together, end after ``rounds`` with a warning that states the remaining error). A document of a cell is then
sampled with a probability in proportion to the cell's raked weight by token,
scaled so that the expected sample has ``share`` of the tokens; probabilities
stop at one, the rest of the scale goes to the other cells, and ``weight`` is
what a kept document counts beyond its probability (one unless stopped).
The draw of a document is a hash of its id: no shuffle, the same every time.

Cells that occur are gathered on the driver; they are products of categories,
not of documents, and more than ``MOST_CELLS`` of them is an error, not a cut.

Targets are shares by category for each of the three dimensions; by default
they go with the square root of the tokens (``power``), which lifts small
categories. Categories without a target get zero.

Defined results: null categories are the category ``none``; null text has no
tokens; cells without tokens have probability zero; rows that repeat an id
share their draw; a null id draws like the text ``null``; columns of the input
stay, but for those named like results, which are replaced.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import durable

ROUNDS, TOLERANCE, SHARE, POWER, MOST_CELLS = 500, 1e-10, 0.6, 0.5, 1_000_000
DIMENSIONS = ("source", "lang", "topic")
_WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("bigint")


def topic(text: Column, count: Column) -> Column:
    """Topic by surface form, for corpora without a topic column."""
    text = F.coalesce(text, F.lit(""))
    marks = F.regexp_count(text, F.lit(r"[|#%$&*<>{}]"))
    digits = F.regexp_count(text, F.lit(r"[0-9]"))
    rows = F.regexp_count(text, F.lit(r"\n"))
    return F.when(count == 0, "empty").when(marks * 4 > count, "markup").when(digits * 4 > count, "numbers").when(rows * 20 > count, "lists").otherwise("prose")


def features(docs: DataFrame, text_col: str = "text", topic_col: str | None = None) -> DataFrame:
    """``docs`` with n_tokens and the three dimensions without nulls."""
    out = docs.withColumn("n_tokens", tokens(F.col(text_col)))
    out = out.withColumn("topic", F.col(topic_col) if topic_col else topic(F.col(text_col), F.col("n_tokens")))
    return out.withColumns({d: F.coalesce(F.col(d).cast("string"), F.lit("none")) for d in DIMENSIONS})


def error(weights: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> float:
    """The greatest difference between a category's share and its target."""
    return max((float(np.abs(np.bincount(c, weights, len(t)) - t).max()) for c, t in zip(codes, targets, strict=True) if len(t)), default=0.0)


def rake(cells: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights of the cells after fitting each marginal in turn until all are met within ``tolerance``."""
    weights = cells.astype(float)
    for _ in range(rounds):
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, weights, len(target))
            weights = weights * np.divide(target, now, out=np.zeros(len(target)), where=now > 0)[code]
        if error(weights, codes, targets) <= tolerance:
            return weights
    warnings.warn(f"after {rounds} rounds a share is off its target by {error(weights, codes, targets):.2g}", stacklevel=2)
    return weights


def calibrate(cells: np.ndarray, factors: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities min(1, scale x factor) whose expected tokens are the budget, and the scaled factors."""
    order = np.argsort(-factors, kind="stable")
    full = np.concatenate([[0.0], np.cumsum(cells[order].astype(float))])
    mass = np.concatenate([np.cumsum((cells * factors)[order][::-1])[::-1], [0.0]])
    scale = 0.0
    for k, at in enumerate(order):
        if mass[k] <= 0:
            break
        scale = (budget - full[k]) / mass[k]
        if scale * factors[at] <= 1:
            break
    return np.minimum(1.0, scale * factors), scale * factors


def probabilities(found: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = SHARE, power: float = POWER, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each cell: the dimensions, ``p`` and ``weight``."""
    spark = found.sparkSession
    rows = found.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n")).limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of source, language and topic: take coarser categories")
    schema = ", ".join(f"{d} string" for d in DIMENSIONS) + ", p double, weight double"
    if not rows:
        return spark.createDataFrame([], schema)
    rows.sort(key=lambda r: tuple(r[d] for d in DIMENSIONS))
    cells = np.array([r.n for r in rows], np.int64)
    codes, shares = [], []
    for d in DIMENSIONS:
        names, code = np.unique([r[d] for r in rows], return_inverse=True)
        aim = np.bincount(code, cells).astype(float) ** power if targets is None or d not in targets else np.array([targets[d].get(n, 0.0) for n in names.tolist()], float)
        codes.append(code)
        shares.append(aim / aim.sum() if aim.sum() else aim)
    raked = rake(cells, codes, shares, rounds, tolerance)
    factors = np.divide(raked, cells, out=np.zeros(len(cells)), where=cells > 0)
    p, scaled = calibrate(cells, factors, share * cells.sum())
    weight = np.divide(scaled, p, out=np.ones(len(p)), where=p > 0)
    return spark.createDataFrame([(*(r[d] for d in DIMENSIONS), float(a), float(b)) for r, a, b in zip(rows, p, weight, strict=True)], schema)


def draw(id_col: str = "doc_id", seed: str = "mix") -> Column:
    """Uniform in [0, 1) from a hash of the id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None, **options) -> DataFrame:
    """Every document with n_tokens, topic, p, weight and ``sampled``; its own columns stay as they are."""
    own = [c for c in docs.columns if c not in ("n_tokens", "topic", "p", "weight", "sampled") or c == topic_col]
    kept = {d: f"_{d}" for d in DIMENSIONS if d in own}
    table = probabilities(features(docs, text_col, topic_col), **options)
    out = features(docs.select(*own, *(F.col(d).alias(n) for d, n in kept.items())), text_col, topic_col).join(table, list(DIMENSIONS), "left")
    out = out.withColumn("sampled", draw(id_col) < F.col("p"))
    return out.select(*(F.col(kept.get(c, c)).alias(c) for c in own), "n_tokens", *([] if "topic" in own else ["topic"]), "p", "weight", "sampled")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Cell, probability, weight and draw of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    found = durable.keep(features(docs).select("doc_id", "n_tokens", *DIMENSIONS))
    out = found.join(probabilities(found), list(DIMENSIONS), "left")
    return out.select("doc_id", *DIMENSIONS, "n_tokens", F.round("p", 6).alias("p"), F.round("weight", 6).alias("weight"), (draw() < F.col("p")).alias("sampled"))


#: Rounds in SQL, which can't stop when the error is small enough.
SQL_ROUNDS = 40


def _oracle() -> str:
    steps, last = [], "c0"
    for k in range(SQL_ROUNDS * 3):
        d = DIMENSIONS[k % 3]
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.* REPLACE (coalesce(w * t{d} / nullif(sum(w) OVER (PARTITION BY {d}), 0), 0) AS w) FROM {last} c)")
        last = f"c{k + 1}"
    shares = ", ".join(f"s{d} AS (SELECT {d}, sqrt(sum(n)::DOUBLE) / sum(sqrt(sum(n)::DOUBLE)) OVER () AS t{d} FROM cell GROUP BY {d})" for d in DIMENSIONS)
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, coalesce(text, '') AS text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), doc AS MATERIALIZED (
  SELECT doc_id, source, lang, n_tokens, CASE WHEN n_tokens = 0 THEN 'empty'
    WHEN len(regexp_extract_all(text, '[|#%$&*<>{{}}]')) * 4 > n_tokens THEN 'markup'
    WHEN len(regexp_extract_all(text, '[0-9]')) * 4 > n_tokens THEN 'numbers'
    WHEN len(regexp_extract_all(text, '\\n')) * 20 > n_tokens THEN 'lists' ELSE 'prose' END AS topic FROM base
), cell AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS n FROM doc GROUP BY ALL), {shares},
c0 AS MATERIALIZED (SELECT *, n::DOUBLE AS w FROM cell JOIN ssource USING (source) JOIN slang USING (lang) JOIN stopic USING (topic)),
{", ".join(steps)},
f AS MATERIALIZED (SELECT source, lang, topic, n, CASE WHEN n > 0 THEN w / n ELSE 0 END AS f FROM {last}),
o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY f DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
             sum(n * f) OVER (ORDER BY f DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mass FROM f),
z AS (SELECT max_by(({SHARE} * (SELECT sum(n) FROM f) - done) / mass, f) AS s FROM o WHERE mass > 0 AND ({SHARE} * (SELECT sum(n) FROM f) - done) / mass * f <= 1),
p AS (SELECT source, lang, topic, least(1.0, s * f) AS p, CASE WHEN least(1.0, s * f) > 0 THEN s * f / least(1.0, s * f) ELSE 1 END AS weight FROM f, z)
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS p, round(weight, 6) AS weight,
       CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 < p AS sampled
FROM doc JOIN p USING (source, lang, topic)
"""


ORACLE_SQL = _oracle()
