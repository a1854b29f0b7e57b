"""Sweeps over cells, rounds and probes: one fit for each (C, I), all P from one search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.operators import kmeans
from quiverlake.operators.ivf import IvfIndex
from quiverlake.operators.knn import knn_join

RUNS = "stamp string, num_centroids int, kmeans_iter int, nprobe int, recall double, cost double"


def recall_by_probes(index: IvfIndex, queries: DataFrame, truth: DataFrame, probes: list[int], k: int = 10) -> DataFrame:
    """``(nprobe, recall, cost)`` of one index: mean recall, and mean distance computations a query (cells plus rows of the probed cells).

    One search at the widest probing keeps the rank of each candidate's cell; a narrower search is the
    candidates of the lower ranks.
    """
    spark = queries.sparkSession
    widest = max(probes)
    found = index.candidates(queries, k, widest)
    each = found.select("*", F.explode(F.array(*(F.lit(p) for p in probes))).alias("nprobe")).where("probe_rank <= nprobe")
    best = Window.partitionBy("nprobe", "query_id").orderBy("dist_sq", "vec_id")
    kept = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("nprobe", "query_id", "vec_id")
    want = truth.where(F.col("rank") <= k).select("query_id", "vec_id")
    size = want.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = kept.join(want, ["query_id", "vec_id"]).groupBy("nprobe", "query_id").agg(F.count("*").alias("hits"))
    grid = size.select("query_id", "n", F.explode(F.array(*(F.lit(p) for p in probes))).alias("nprobe"))
    per = grid.join(hits, ["nprobe", "query_id"], "left").select("nprobe", "query_id", (F.coalesce("hits", F.lit(0)) / F.least(F.lit(k), F.col("n"))).alias("recall"))
    lists = F.broadcast(index.list_sizes())  # one row a cell
    scanned = index.probe(queries, widest).join(lists, "cid").select("query_id", "probe_rank", "n", F.explode(F.array(*(F.lit(p) for p in probes))).alias("nprobe")).where("probe_rank <= nprobe")
    cost = scanned.groupBy("nprobe", "query_id").agg((F.sum("n") + len(index.centroids)).alias("cost"))
    return per.join(cost, ["nprobe", "query_id"]).groupBy("nprobe").agg(F.avg("recall").alias("recall"), F.avg("cost").alias("cost"))


def grid(points: DataFrame, queries: DataFrame, cells: list[int], rounds: list[int], probes: list[int], k: int = 10, seed: int = 42, done: DataFrame | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Runs ``(stamp, num_centroids, kmeans_iter, nprobe, recall, cost)`` of a grid, but for the stamps in ``done``.

    For each C the rounds go on from the fit of fewer rounds.
    """
    spark = points.sparkSession
    truth = knn_join(queries, points, k, id_col=id_col, vector=vector)
    out = spark.createDataFrame([], RUNS)
    for c in cells:
        centroids, at = kmeans.seeds(points, c, seed, id_col, vector), 0
        for i in sorted(rounds):
            while at < i:
                centroids, _ = kmeans.update(points, centroids, id_col, vector)
                at += 1
            index = IvfIndex.of(points, np.array(centroids), id_col, vector)
            runs = recall_by_probes(index, queries, truth, probes, k)
            stamp = F.concat(F.lit(f"c{c}_i{i}_p"), F.col("nprobe").cast("string"))
            out = out.unionByName(runs.select(stamp.alias("stamp"), F.lit(c).alias("num_centroids"), F.lit(i).alias("kmeans_iter"), "nprobe", "recall", "cost"))
    return out if done is None else out.join(done.select("stamp").distinct(), "stamp", "left_anti")
