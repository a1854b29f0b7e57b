"""Analysis of runs ``(stamp, num_centroids, kmeans_iter, nprobe, status, elapsed_s, recall, avg_query_time_ms, index_build_time_s)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("num_centroids", "kmeans_iter", "nprobe")
SALTS = 64


def clean(raw: DataFrame, status: str | None = "status") -> DataFrame:
    """Metrics as numbers (``NA`` and rubbish null); ``ok``: the status begins with OK, or without a status column recall is there.

    A run delivered more than once (same ``run_id``) counts once, as first received.
    """
    runs = raw
    if "run_id" in raw.columns:
        first = F.min_by(F.struct(*raw.columns), F.struct("received_at") if "received_at" in raw.columns else F.struct(*raw.columns))
        runs = raw.groupBy("run_id").agg(first.alias("_r")).select("_r.*")
    number = lambda c: F.when(F.trim(F.col(c).cast("string")).rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), F.trim(F.col(c).cast("string")).try_cast("double"))
    runs = runs.withColumns({c: number(c) for c in ("elapsed_s", "recall", "avg_query_time_ms", "index_build_time_s") if c in runs.columns})
    ok = F.coalesce(F.startswith(status, F.lit("OK")), F.lit(False)) if status and status in runs.columns else F.col("recall").isNotNull()
    return runs.withColumn("ok", ok)


def succeeded(runs: DataFrame) -> DataFrame:
    return runs.where("ok")


def with_derived(runs: DataFrame) -> DataFrame:
    """Recall a second of elapsed time (null at zero) and the probed share of the cells."""
    return runs.withColumns({"recall_per_sec": F.col("recall") / F.nullif(F.col("elapsed_s"), F.lit(0.0)), "p_c_ratio": F.round(F.col("nprobe") / F.nullif(F.col("num_centroids"), F.lit(0)), 4)})


def top(runs: DataFrame, by: str, n: int = 20, tie: Sequence[str] = (*KEYS, "run_id")) -> DataFrame:
    """The ``n`` runs of the highest ``by``; runs without it don't count."""
    return runs.where(F.col(by).isNotNull()).orderBy(F.desc(by), *tie).limit(n)


def group_stats(runs: DataFrame) -> DataFrame:
    """Statistics of the runs of each (C, I, P); a single run has no deviation, runs without a key are left out."""
    known = runs.where(" AND ".join(f"{k} IS NOT NULL" for k in KEYS))
    return known.groupBy(*KEYS).agg(F.avg("recall").alias("recall_mean"), F.stddev_samp("recall").alias("recall_std"), F.avg("avg_query_time_ms").alias("time_mean"), F.avg("index_build_time_s").alias("build_mean"), F.count("recall").alias("runs"))


def pareto(runs: DataFrame, score: str = "recall", cost: str = "elapsed_s") -> DataFrame:
    """The runs no other run dominates: none costs no more and scores no less, one of them strictly. Equal runs all stay.

    By cost: a run is on the front if it has its cost's best score, and that beats every score at a lower
    cost. Runs are first reduced to one row a distinct cost and to the fronts of ``SALTS`` parts of them, in
    parallel; only what is left goes into the one ordered window.
    """
    return _front(runs, score, cost, F.max, F.asc, lambda now, before: now > before)


def pareto_compat(runs: DataFrame, score: str = "recall", cost: str = "elapsed_s") -> DataFrame:
    """The runs that dominate no other run (the front read the other way round)."""
    return _front(runs, score, cost, F.min, F.desc, lambda now, before: now < before)


def _front(runs: DataFrame, score: str, cost: str, extreme, order, beats) -> DataFrame:
    known = runs.where(F.col(score).isNotNull() & F.col(cost).isNotNull() & ~F.isnan(score) & ~F.isnan(cost))
    front = known.groupBy(F.col(cost).alias("_cost")).agg(extreme(score).alias("_best"))
    for window in (Window.partitionBy(F.pmod(F.xxhash64("_cost"), F.lit(SALTS))), Window.partitionBy()):
        earlier = window.orderBy(order("_cost")).rowsBetween(Window.unboundedPreceding, -1)
        front = front.withColumn("_before", extreme("_best").over(earlier)).where(F.col("_before").isNull() | beats(F.col("_best"), F.col("_before"))).drop("_before")
    return known.join(front, (F.col(cost) == F.col("_cost")) & (F.col(score) == F.col("_best")), "left_semi")


def high_recall(runs: DataFrame, limit: float = 0.98, strict: bool = True) -> DataFrame:
    """Runs above the limit (analysis) or at least at it (tuning)."""
    return runs.where(F.col("recall") > limit if strict else F.col("recall") >= limit)


def describe(runs: DataFrame, *columns: str) -> DataFrame:
    """Count, mean, deviation, minimum and maximum of columns, in one row."""
    return runs.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))))


def best(runs: DataFrame) -> DataFrame:
    """The run of the highest recall; ties by the parameters and the id."""
    return top(runs, "recall", 1)


def heatmap(runs: DataFrame, probes: Sequence[int], value: str = "recall") -> DataFrame:
    """Mean of ``value`` by rounds and cells, a column for each of the given probe numbers."""
    return runs.groupBy("kmeans_iter", "num_centroids").pivot("nprobe", list(probes)).agg(F.avg(value))


def heatmap_cells(runs: DataFrame, value: str = "recall") -> DataFrame:
    """``(kmeans_iter, num_centroids, nprobe, mean, n)``: the heat map's cells, a row each, for all probe numbers there are."""
    return runs.groupBy("kmeans_iter", "num_centroids", "nprobe").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def box(runs: DataFrame, by: str = "kmeans_iter", value: str = "recall") -> DataFrame:
    """Quartiles, extremes and number of ``value`` by group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return runs.where(F.col(value).isNotNull()).groupBy(by).agg(F.min(value).alias("low"), q.alias("q"), F.max(value).alias("high"), F.count("*").alias("n")).select(by, "low", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"), "high", "n")


def histogram(runs: DataFrame, value: str = "recall", bins: int = 20) -> DataFrame:
    """``(bin, n)`` for equal bins between minimum and maximum, the maximum in the last; one value makes one bin."""
    known = runs.where(F.col(value).isNotNull() & ~F.isnan(value))
    ends = known.agg(F.min(value).alias("low"), F.max(value).alias("high")).head()
    if ends["low"] is None:
        return known.limit(0).select(F.lit(1).alias("bin"), F.lit(0).cast("bigint").alias("n"))
    if ends["low"] == ends["high"]:
        return known.groupBy(F.lit(1).alias("bin")).agg(F.count("*").alias("n"))
    place = F.least(F.floor((F.col(value) - ends["low"]) / ((ends["high"] - ends["low"]) / bins)) + 1, F.lit(bins)).cast("int")
    return known.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def series(runs: DataFrame, x: str, by: Sequence[str], value: str) -> DataFrame:
    """Mean of ``value`` along ``x`` for each group: the points of a line plot."""
    return runs.where(F.col(value).isNotNull()).groupBy(x, *by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def marker_size(cells: Column) -> Column:
    """Marker area by number of cells, between 10 and 400."""
    return F.greatest(F.lit(10.0), F.least(F.lit(400.0), cells / 4))


def early_stop(runs: DataFrame, limit: float = 0.98, order: str = "num_centroids") -> DataFrame:
    """The runs a sweep makes that leaves a (rounds, probes) row once recall falls below the limit; that run is made still."""
    before = Window.partitionBy("kmeans_iter", "nprobe").orderBy(order, "run_id").rowsBetween(Window.unboundedPreceding, -1)
    return runs.where("recall IS NOT NULL").withColumn("_low", F.min("recall").over(before)).where(F.col("_low").isNull() | (F.col("_low") >= limit)).drop("_low")


def distinct_stamps(runs: DataFrame) -> DataFrame:
    """One run a stamp: the one finished first."""
    w = Window.partitionBy("stamp").orderBy("finished_at", "run_id")
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
