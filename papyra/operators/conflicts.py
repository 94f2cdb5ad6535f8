"""Claims of a paper that may contradict each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import claim_score, claim_terms


def claim_pairs(claims: DataFrame, *, most: int = 10) -> DataFrame:
    """paper_id, l, r (l < r: places of claims), score: all pairs of a paper's claims (paper_id, ord, statement) while they are ``most`` at most, else the ``most`` pairs that share telling words, by score, then place.

    Papers of many claims meet over shared words only, by an equi-join, so that pairs without a
    score are never made; of the others all pairs are few.
    """
    c = claims.select("paper_id", "ord", claim_terms(F.col("statement")).alias("x"))
    n = F.count("*").over(W.partitionBy("paper_id"))
    c = c.withColumn("_many", n * (n - 1) / 2 > most)
    side = lambda a: c.select("paper_id", F.col("ord").alias(a), F.col("x").alias(f"x{a}"), "_many")
    few = side("l").filter("not _many").drop("_many").join(side("r").filter("not _many").drop("_many"), "paper_id").filter("l < r")
    word = lambda a: side(a).filter("_many").select("paper_id", a, F.explode(f"x{a}").alias("w"))
    met = word("l").join(word("r"), ["paper_id", "w"]).filter("l < r").select("paper_id", "l", "r").distinct()
    many = met.join(side("l").drop("_many"), ["paper_id", "l"]).join(side("r").drop("_many"), ["paper_id", "r"]).withColumn("score", claim_score(F.col("xl"), F.col("xr")))
    rank = F.row_number().over(W.partitionBy("paper_id").orderBy(F.desc("score"), "l", "r"))
    best = many.withColumn("_k", rank).filter(F.col("_k") <= most).select("paper_id", "l", "r", "score")
    return few.select("paper_id", "l", "r", claim_score(F.col("xl"), F.col("xr")).alias("score")).union(best)
