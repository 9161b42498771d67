"""Connected components of a link table, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import durable


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, exact: bool = True) -> DataFrame:
    """``(id, component)`` for every id that ``links`` names; the component is its least id.

    Rounds of stars, with every link kept as (larger, smaller) id: a link's smaller
    end moves on to that id's own least neighbour, then all links of an id move to
    the least of them, until nothing changes. A key that has very many links costs a partial aggregate and a
    join on one side only, which can be split. Every round is written to the
    checkpoint folder. Null ids and links from an id to itself are no links.

    With ``exact=False`` it stops after ``rounds``: ids of one component are
    connected then, though connected ids may still be in several.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    stars = durable.keep(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high.alias("x"), low.alias("y")).distinct())
    before = None
    for _ in range(rounds):
        least = stars.groupBy("x").agg(F.min("y").alias("m"))
        # Of an id with smaller neighbours, the least of them is the least of all.
        large = stars.join(least.withColumnRenamed("x", "y"), "y", "left").select("x", F.coalesce("m", "y").alias("y"))
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        ends = large.join(least, "x").select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e"))
        stars = durable.keep(ends.select("e.*").where(F.col("x") != F.col("y")).distinct())
        if not exact:
            continue
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)")), F.max(F.xxhash64("x", "y"))).first()
        if now == before:
            break
        before = now
    else:
        if exact:
            raise RuntimeError(f"no fixed point after {rounds} rounds")
    if not exact:
        stars = stars.groupBy("x").agg(F.min("y").alias("y"))
    return stars.select(F.col("x").alias("id"), F.col("y").alias("component")).unionByName(stars.select(F.col("y").alias("id"), F.col("y").alias("component")).distinct())
