"""Recall of search results against exact neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_per_query(results: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, hits, recall)`` for every query of ``truth``: found among its first ``k``, over min(k, their number).

    Both have ``(query_id, vec_id, rank)``. A query without results has recall 0; one without truth does not appear.
    """
    wanted = truth.where(F.col("rank") <= k).select("query_id", "vec_id")
    found = results.where(F.col("rank") <= k).select("query_id", "vec_id", F.lit(1).alias("hit")).distinct()
    per = wanted.join(found, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("hit").alias("hits"), F.count("*").alias("n"))
    return per.select("query_id", "hits", (F.col("hits") / F.least(F.lit(k), F.col("n"))).alias("recall"))


def recall_summary(per_query: DataFrame) -> DataFrame:
    """``(queries, mean_recall, min_recall)``."""
    return per_query.agg(F.count("*").alias("queries"), F.avg("recall").alias("mean_recall"), F.min("recall").alias("min_recall"))
