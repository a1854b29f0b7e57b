"""Queries of the run analytics over ``run_summary``, with SQL that computes the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.operators import analysis, models, tune
from quiverlake.session import shared_dir, table
from quiverlake.sources import runs as run_files

POINTS = 1_000_000  # N of the time model
TARGET = 0.98


def runs(spark: SparkSession, d: str) -> DataFrame:
    return analysis.clean(table(spark, d, "run_summary"), "run_status")


def good(spark: SparkSession, d: str) -> DataFrame:
    return analysis.succeeded(runs(spark, d))


def r6(c: str, name: str | None = None):
    return (F.round(c, 6) + F.lit(0.0)).alias(name or c)


def runs_clean(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).select("run_id", "stamp", "ok", r6("elapsed_s"), r6("recall"), r6("avg_query_time_ms"), r6("index_build_time_s"))


def runs_topk_recall(spark: SparkSession, d: str) -> DataFrame:
    return analysis.top(good(spark, d), "recall").select("run_id", "stamp", r6("recall"))


def runs_recall_per_cost(spark: SparkSession, d: str) -> DataFrame:
    return analysis.top(analysis.with_derived(good(spark, d)), "recall_per_sec").select("run_id", "stamp", r6("recall_per_sec"), r6("p_c_ratio"))


def runs_group_stats(spark: SparkSession, d: str) -> DataFrame:
    return analysis.group_stats(good(spark, d)).select(*analysis.KEYS, r6("recall_mean"), r6("recall_std"), r6("time_mean"), r6("build_mean"), "runs")


def runs_pareto(spark: SparkSession, d: str) -> DataFrame:
    return analysis.pareto(good(spark, d)).select("run_id", r6("recall"), r6("elapsed_s"))


def runs_pareto_compat(spark: SparkSession, d: str) -> DataFrame:
    return analysis.pareto_compat(good(spark, d)).select("run_id", r6("recall"), r6("elapsed_s"))


def runs_high_recall_stats(spark: SparkSession, d: str) -> DataFrame:
    out = analysis.describe(analysis.high_recall(good(spark, d), TARGET), "avg_query_time_ms", "elapsed_s")
    return out.select(*(r6(c) if k == "double" else c for c, k in out.dtypes))


def runs_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Mean recall of every (rounds, cells, probes) that was run, a row each; ``analysis.heatmap`` makes columns of chosen probes."""
    return analysis.heatmap_cells(good(spark, d)).select("kmeans_iter", "num_centroids", "nprobe", r6("mean"), "n")


def runs_box_by_iter(spark: SparkSession, d: str) -> DataFrame:
    return analysis.box(good(spark, d)).select("kmeans_iter", *(r6(c) for c in ("low", "q1", "median", "q3", "high")), "n")


def runs_histogram(spark: SparkSession, d: str) -> DataFrame:
    return analysis.histogram(good(spark, d))


def runs_series(spark: SparkSession, d: str) -> DataFrame:
    return analysis.series(good(spark, d), "nprobe", ["kmeans_iter"], "recall").select("nprobe", "kmeans_iter", r6("mean"), "n")


def runs_marker_size(spark: SparkSession, d: str) -> DataFrame:
    return good(spark, d).select("run_id", analysis.marker_size(F.col("num_centroids")).alias("size"))


def runs_early_stop(spark: SparkSession, d: str) -> DataFrame:
    return analysis.early_stop(good(spark, d), TARGET).select("run_id", "num_centroids", "kmeans_iter", "nprobe", r6("recall"))


def runs_best(spark: SparkSession, d: str) -> DataFrame:
    return analysis.best(good(spark, d)).select("run_id", "stamp", r6("recall"))


def runs_distinct_stamps(spark: SparkSession, d: str) -> DataFrame:
    return analysis.distinct_stamps(runs(spark, d)).select("stamp", "run_id")


def runs_not_done(spark: SparkSession, d: str) -> DataFrame:
    """Stamps of failed runs that no successful run has."""
    every = runs(spark, d)
    return run_files.not_done(every.where("NOT ok").select("stamp").distinct(), every.where("ok"))


def runs_summary_lines(spark: SparkSession, d: str) -> DataFrame:
    """Runs written as summary lines and read again."""
    r = runs(spark, d).where("recall IS NOT NULL")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NA"))
    line = F.concat_ws(" ", *(F.concat(F.lit(f"{k}="), text(c), F.lit(u)) for k, c, u in (("NUM_CENTROIDS", "num_centroids", ""), ("KMEANS_ITER", "kmeans_iter", ""), ("NPROBE", "nprobe", ""), ("STATUS", "ok", ""), ("ELAPSED", "elapsed_s", "s"), ("RECALL", "recall", ""), ("AVG_QUERY_TIME_ms", "avg_query_time_ms", ""), ("INDEX_BUILD_s", "index_build_time_s", ""))))
    out = run_files.parse_summary(r.select(line.alias("value")))
    return out.groupBy("num_centroids", "kmeans_iter", "nprobe").agg(F.count("*").alias("n"), F.sum("elapsed_s").alias("elapsed_s"), F.sum("recall").alias("recall")).select("num_centroids", "kmeans_iter", "nprobe", "n", r6("elapsed_s"), r6("recall"))


def runs_log_scrape(spark: SparkSession, d: str) -> DataFrame:
    """Result blocks inside documents, read as run logs."""
    logs = table(spark, d, "documents").select("doc_id", F.col("stamp").alias("name"), "text")
    out = run_files.parse_logs(logs.where("text IS NOT NULL").select(F.concat_ws("|", "doc_id", "name").alias("name"), "text"))
    return out.groupBy("complete").agg(F.count("*").alias("n"), F.sum("recall").alias("recall"), F.sum("avg_query_time_ms").alias("ms"), F.sum("index_build_time_s").alias("build_s"), F.count("stamp").alias("stamps")).select("complete", "n", r6("recall"), r6("ms"), r6("build_s"), "stamps")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ql-{name}-{uuid.uuid4().hex}"


def runs_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Runs written as a summary CSV and read again; what is missing goes as NA."""
    names = dict(zip(("stamp", *analysis.KEYS, "elapsed_s", "recall", "avg_query_time_ms", "index_build_time_s"), run_files.CSV_COLUMNS))
    path = _folder(spark, "summary-csv")
    run_files.append_csv(runs(spark, d).withColumnsRenamed(names), path)
    back = run_files.read_csv(spark, path).withColumnsRenamed({v: k for k, v in names.items()})
    return back.select("stamp", *(F.col(k).cast("int").alias(k) for k in analysis.KEYS), r6("elapsed_s"), r6("recall"), r6("avg_query_time_ms"), r6("index_build_time_s"))


def runs_tsv_dialect(spark: SparkSession, d: str) -> DataFrame:
    """A summary with tabs, padded column names, a status column and the older spelling of the rounds, read by the same reader."""
    r = runs(spark, d)
    old = r.select(F.col("stamp").alias(" STAMP "), F.col("num_centroids").alias("NUM_CENTROIDS "), F.col("kmeans_iter").alias("KMEAN_ITER"), F.col("nprobe").alias("NPROBE"), F.col("run_status").alias("STATUS"), F.col("recall").alias("RECALL"))
    path = _folder(spark, "summary-tsv")
    old.write.csv(path, header=True, sep="\t", nullValue="NA", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = run_files.read_csv(spark, path)
    return back.groupBy(F.col("KMEANS_ITER").cast("int").alias("kmeans_iter")).agg(F.count("*").alias("n"), F.sum("RECALL").alias("recall"), F.count(F.when(F.col("STATUS") == "OK", 1)).alias("ok")).select("kmeans_iter", "n", r6("recall"), "ok")


def reward_expr(spark: SparkSession, d: str) -> DataFrame:
    return good(spark, d).select("run_id", F.round(tune.reward(F.col("recall"), F.col("avg_query_time_ms")), 6).alias("reward"))


def score_compat(spark: SparkSession, d: str) -> DataFrame:
    """Both scores of all runs, as signed log10(1 + |score|): below the target they reach 1e98."""
    both = [f(F.col("recall"), F.col("avg_query_time_ms")).alias(n) for n, f in (("compat", tune.score_compat), ("signed", tune.score))]
    return good(spark, d).select("run_id", *both).select("run_id", *((F.round(F.signum(c) * F.log10(1 + F.abs(c)), 6) + F.lit(0.0)).alias(c) for c in ("compat", "signed")))


def neighbours_12(spark: SparkSession, d: str) -> DataFrame:
    """The twelve neighbours of every configuration that was run."""
    return tune.neighbours(runs(spark, d).select("num_centroids", "nprobe").distinct(), jitter_seed=7).select("num_centroids", "nprobe", "n", "c", "p")


def ratio_window(spark: SparkSession, d: str) -> DataFrame:
    low = tune.ratio_window(spark, [384, 512, 640, 768], [12, 16, 20, 24], 0.02, 0.04)
    return low.unionByName(tune.ratio_window(spark, [2048, 3072, 4096, 5120], [48, 64, 80, 96], 0.015, 0.025))


def time_model_fit(spark: SparkSession, d: str) -> DataFrame:
    coef, fitted = models.time_model(good(spark, d), POINTS)
    q = models.fit_quality(fitted, "avg_query_time_ms")
    return spark.createDataFrame([(round(float(coef[0]), 6), round(float(coef[1]), 8), round(float(coef[2]), 4), q["n"], round(q["rmse"], 4))], "a double, b double, d double, n bigint, rmse double")


def cold_start(spark: SparkSession, d: str) -> DataFrame:
    sizes = [(1_000_000, 128), (1_192_514, 100), (10_000, 48)]
    return spark.createDataFrame([(n, k, *models.cold_start(n, k)) for n, k in sizes], "n bigint, d int, c int, i int, p int")


def _surrogates(spark: SparkSession, d: str):
    r = good(spark, d)
    return models.boosting(r, "avg_query_time_ms"), models.boosting(r, "recall")


def surrogate_grid(spark: SparkSession, d: str) -> DataFrame:
    """The fastest configurations that the fitted trees predict to reach the target recall, of 1.3 million."""
    return models.surrogate_search(*_surrogates(spark, d), models.config_grid(spark, range(64, 16000, 32), range(1, 5120, 2), 6), TARGET)


def poly_fit(spark: SparkSession, d: str) -> DataFrame:
    r = good(spark, d)
    rows = []
    for degree in (2, 3):
        model, cv = models.polynomial(r, "recall", degree)
        q = models.fit_quality(model.transform(models._known(r, "recall")), "recall")
        rows.append((degree, q["r2"], q["rmse"], float(cv), q["n"]))
    return spark.createDataFrame(rows, "degree int, r2 double, rmse double, cv_r2 double, n bigint")


def gbt_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = models.compare(good(spark, d), "recall")
    return spark.createDataFrame([(x["model"], x["n"], x["rmse"], x["r2"]) for x in rows], "model string, n bigint, rmse double, r2 double")


def theta_fit(spark: SparkSession, d: str) -> DataFrame:
    r = good(spark, d)
    theta, full = models.recall_model(r), models.full_recall_model(r)
    return spark.createDataFrame([(theta, *map(float, full))], "theta double, kappa double, theta_full double, base double")


def _worst_start(r: DataFrame) -> tuple[int, int, int]:
    """(C, P, I) of the run of the lowest reward among those with the most frequent number of rounds: a search from there has a way to go."""
    known = r.where("recall IS NOT NULL AND avg_query_time_ms > 0")
    rounds = known.groupBy("kmeans_iter").agg(F.count("*").alias("n")).agg(F.max_by("kmeans_iter", F.struct("n", "kmeans_iter")).alias("i"))
    worst = F.min_by(F.struct("num_centroids", "nprobe", "kmeans_iter"), F.struct(tune.reward(F.col("recall"), F.col("avg_query_time_ms")), "run_id"))
    x = known.join(F.broadcast(rounds), known["kmeans_iter"] == rounds["i"]).agg(worst.alias("w")).head()["w"]
    return x["num_centroids"], x["nprobe"], x["kmeans_iter"]


def hill_climb(spark: SparkSession, d: str) -> DataFrame:
    r = good(spark, d)
    path = tune.hill_climb(tune.from_runs(r), *_worst_start(r))
    return spark.createDataFrame([(s.step, s.kind, s.c, s.p, s.recall, s.ms, s.reward) for s in path], "step int, kind string, c int, p int, recall double, ms double, reward double")


def adaptive_search(spark: SparkSession, d: str) -> DataFrame:
    """From the worst run, over the fitted time and recall models (a table of runs is flat between runs, so small steps don't move there)."""
    r = good(spark, d)
    c, p, i = _worst_start(r)
    coef, _ = models.time_model(r, POINTS)
    path = tune.Adaptive().search(tune.from_models(tuple(map(float, coef)), models.recall_model(r), POINTS), {"c": c, "p": p, "i": i})
    return spark.createDataFrame([(n, x["c"], x["i"], x["p"], s) for n, (x, s) in enumerate(path)], "step int, c int, i int, p int, score double")


def search_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of all configurations that the fitted time and recall models predict to reach the target: number, least and mean time, and the twenty fastest."""
    r = good(spark, d)
    coef, _ = models.time_model(r, POINTS)
    theta = models.recall_model(r)
    grid = models.config_grid(spark, range(64, 16000, 32), range(1, 5120, 2), 6).where("nprobe <= num_centroids")
    share = 1 - F.col("nprobe") / F.col("num_centroids")
    time = sum((t * float(x) for t, x in zip(models.time_terms(POINTS), coef)), F.lit(0.0))
    return models.search_summary(grid.withColumns({"recall_pred": 1 - F.pow(share, F.lit(theta)), "time_pred": time}), TARGET)


#: Coefficients to try the analytic models with; their formulas are fixed, their coefficients are to be fitted.
ANALYTIC_TIME = dict(a1=1e-3, a2=1e-3, b=1e-6, rho=1.0, k0=0.1, k1=0.1, eta=0.5, lam=0.1, i0=0.0, mu=0.5, gamma=0.3, xi=0.85, delta=1.0, tau=0.15, c0=0.01, zeta=0.1, k=10.0)
ANALYTIC_RECALL = dict(alpha=8.0, beta=0.3, beta_d=0.1, phi=0.02, theta=0.5, psi=0.1, z0=1.0, z1=0.5, w1=0.2, nu=0.3, w2=0.1)


def analytic_models(spark: SparkSession, d: str) -> DataFrame:
    """Both analytic models for every run."""
    r = good(spark, d).where("num_centroids > 0 AND nprobe IS NOT NULL AND kmeans_iter IS NOT NULL")
    return r.select("run_id", F.round(models.analytic_time(ANALYTIC_TIME, POINTS, 128), 6).alias("time"), F.round(models.analytic_recall(ANALYTIC_RECALL, POINTS, 128), 6).alias("recall"))


def best_config_json(spark: SparkSession, d: str) -> DataFrame:
    return run_files.best_config(good(spark, d).withColumnRenamed("run_status", "status"))


QUERIES = {
    f.__name__: f
    for f in (
        runs_clean, runs_topk_recall, runs_recall_per_cost, runs_group_stats, runs_pareto, runs_pareto_compat, runs_high_recall_stats, runs_heatmap,
        runs_box_by_iter, runs_histogram, runs_series, runs_marker_size, runs_early_stop, runs_best, runs_distinct_stamps, runs_not_done, runs_summary_lines, runs_log_scrape, runs_csv_roundtrip, runs_tsv_dialect,
        reward_expr, score_compat, neighbours_12, ratio_window, time_model_fit, cold_start, surrogate_grid, poly_fit, gbt_fit, theta_fit, analytic_models, hill_climb, adaptive_search, search_summary, best_config_json,
    )
}

_RUNS = """WITH runs AS MATERIALIZED (SELECT run_id, stamp, num_centroids, kmeans_iter, nprobe, run_status, finished_at, coalesce(starts_with(run_status, 'OK'), false) AS ok,
 TRY_CAST(elapsed_s AS DOUBLE) AS elapsed_s, TRY_CAST(recall AS DOUBLE) AS recall, TRY_CAST(avg_query_time_ms AS DOUBLE) AS avg_query_time_ms, TRY_CAST(index_build_time_s AS DOUBLE) AS index_build_time_s
 FROM run_summary QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY received_at) = 1), good AS (SELECT * FROM runs WHERE ok) """
_TIE = "num_centroids, kmeans_iter, nprobe, run_id"
_BEATS = "EXISTS (SELECT 1 FROM good b WHERE b.recall IS NOT NULL AND b.elapsed_s IS NOT NULL AND {x}.recall >= {y}.recall AND {x}.elapsed_s <= {y}.elapsed_s AND ({x}.recall > {y}.recall OR {x}.elapsed_s < {y}.elapsed_s))"


def _pareto(x: str, y: str) -> str:
    return _RUNS + "SELECT run_id, round(recall, 6) AS recall, round(elapsed_s, 6) AS elapsed_s FROM good a WHERE recall IS NOT NULL AND elapsed_s IS NOT NULL AND NOT " + _BEATS.format(x=x, y=y)


def _analytic_sql() -> str:
    from math import exp, log, log2, log10

    t, q, n, dim = ANALYTIC_TIME, ANALYTIC_RECALL, POINTS, 128
    width, loss, load = 0.85 + 0.15 * exp(-0.02 * dim), 0.3 * (1 - exp(-0.03 * max(0, dim - 64))), 1 + log10(n) / 10
    pure = f"(1 - exp(-{t['gamma']} * pow(i, {t['xi']})))"
    cover = f"(1 - exp(-{t['delta']} * least(p, c) / c - {t['tau']} * sqrt(c / {n}.0)))"
    tree = f"{t['a1']} * p * log2(c + 1) * (1 + {t['k0'] + t['k1'] * log2(n)} / pow(c, {t['eta']})) * (1 - exp(-{t['lam']} * greatest(i - {t['i0']}, 0))) * {width}"
    linear = f"{t['a2']} * c * (1 - exp(-{t['mu']} * pow(i, 0.8))) * {width}"
    lists = f"{t['b'] * load / t['rho']} * least(p, c) * {n}.0 / c * (1 - {pure} * {cover} * {1 - loss})"
    merge = t["c0"] * (log(t["k"]) + t["k"]) * (1 + t["zeta"] * log2(n / 1e5))
    time = f"CASE WHEN p < c THEN {tree} ELSE {linear} END + {lists} + {merge}"
    scale, purity = 1 + 0.2 * log10(n / 1e5), exp(-0.015 * max(0, dim - 64))
    recall = (
        f"(1 - exp(-{q['alpha']} * least(p, c) / c / {1 + q['beta_d'] * log2(dim / 64)})) * (1 - {q['beta']} * exp(-{q['phi']} * (pow(c, {q['theta']}) + {q['psi']} * i) * {scale}))"
        f" * (1 - {q['z0'] + q['z1'] * log2(n / 1e5)} / c) * (1 - exp(-{q['w1']} * pow(c, {q['nu']}) * {purity} - {q['w2']} * pow(i, 0.9) * (1 - exp(-0.002 * c))))"
    )
    return _RUNS + f", m AS (SELECT run_id, num_centroids::DOUBLE AS c, kmeans_iter::DOUBLE AS i, nprobe::DOUBLE AS p FROM good WHERE num_centroids > 0 AND nprobe IS NOT NULL AND kmeans_iter IS NOT NULL) SELECT run_id, round({time}, 6) AS time, round({recall}, 6) AS recall FROM m"


_STATS = "count({c}) AS {c}_count, round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std, round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max"
_AROUND = ["(dc, 0)", "(-dc, 0)", "(0, dp)", "(0, -dp)", "(dc, dp)", "(dc, -dp)", "(-dc, dp)", "(-dc, -dp)", "(rc, 0)", "(-rc, 0)", "(0, rp)", "(0, -rp)"]

SQL = {
    "runs_clean": _RUNS + "SELECT run_id, stamp, ok, round(elapsed_s, 6) AS elapsed_s, round(recall, 6) AS recall, round(avg_query_time_ms, 6) AS avg_query_time_ms, round(index_build_time_s, 6) AS index_build_time_s FROM runs",
    "runs_topk_recall": _RUNS + f"SELECT run_id, stamp, round(recall, 6) AS recall FROM good WHERE recall IS NOT NULL ORDER BY good.recall DESC, {_TIE} LIMIT 20",
    "runs_recall_per_cost": _RUNS + f", s AS (SELECT *, recall / nullif(elapsed_s, 0) AS rps FROM good) SELECT run_id, stamp, round(rps, 6) AS recall_per_sec, round(nprobe / num_centroids, 4) AS p_c_ratio FROM s WHERE rps IS NOT NULL ORDER BY rps DESC, {_TIE} LIMIT 20",
    "runs_group_stats": _RUNS + "SELECT num_centroids, kmeans_iter, nprobe, round(avg(recall), 6) AS recall_mean, round(stddev_samp(recall), 6) AS recall_std, round(avg(avg_query_time_ms), 6) AS time_mean, round(avg(index_build_time_s), 6) AS build_mean, count(recall) AS runs FROM good WHERE num_centroids IS NOT NULL AND kmeans_iter IS NOT NULL AND nprobe IS NOT NULL GROUP BY 1, 2, 3",
    "runs_pareto": _pareto("b", "a"),
    "runs_pareto_compat": _pareto("a", "b"),
    "runs_high_recall_stats": _RUNS + f"SELECT {_STATS.format(c='avg_query_time_ms')}, {_STATS.format(c='elapsed_s')} FROM good WHERE recall > {TARGET}",
    "runs_heatmap": _RUNS + "SELECT kmeans_iter, num_centroids, nprobe, round(avg(recall), 6) AS mean, count(recall) AS n FROM good GROUP BY 1, 2, 3",
    "runs_box_by_iter": _RUNS + "SELECT kmeans_iter, round(min(recall), 6) AS low, round(quantile_cont(recall, 0.25), 6) AS q1, round(quantile_cont(recall, 0.5), 6) AS median, round(quantile_cont(recall, 0.75), 6) AS q3, round(max(recall), 6) AS high, count(*) AS n FROM good WHERE recall IS NOT NULL GROUP BY 1",
    "runs_histogram": _RUNS + ", k AS (SELECT recall, min(recall) OVER () AS low, max(recall) OVER () AS high FROM good WHERE recall IS NOT NULL) SELECT least(floor((recall - low) / ((high - low) / 20)) + 1, 20)::INT AS bin, count(*) AS n FROM k GROUP BY 1",
    "runs_series": _RUNS + "SELECT nprobe, kmeans_iter, round(avg(recall), 6) AS mean, count(*) AS n FROM good WHERE recall IS NOT NULL GROUP BY 1, 2",
    "runs_marker_size": _RUNS + "SELECT run_id, greatest(10.0, least(400.0, num_centroids / 4))::DOUBLE AS size FROM good",
    "runs_early_stop": _RUNS + "SELECT run_id, num_centroids, kmeans_iter, nprobe, round(recall, 6) AS recall FROM (SELECT *, min(recall) OVER (PARTITION BY kmeans_iter, nprobe ORDER BY num_centroids, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM good WHERE recall IS NOT NULL) WHERE low IS NULL OR low >= 0.98",
    "runs_best": _RUNS + f"SELECT run_id, stamp, round(recall, 6) AS recall FROM good WHERE recall IS NOT NULL ORDER BY good.recall DESC, {_TIE} LIMIT 1",
    "runs_distinct_stamps": _RUNS + "SELECT stamp, run_id FROM runs QUALIFY row_number() OVER (PARTITION BY stamp ORDER BY finished_at NULLS FIRST, run_id) = 1",
    "runs_not_done": _RUNS + "SELECT DISTINCT stamp FROM runs WHERE NOT ok AND stamp NOT IN (SELECT stamp FROM good)",
    "runs_summary_lines": _RUNS + "SELECT num_centroids, kmeans_iter, nprobe, count(*) AS n, round(sum(elapsed_s), 6) AS elapsed_s, round(sum(recall), 6) AS recall FROM runs WHERE recall IS NOT NULL GROUP BY 1, 2, 3",
    "runs_log_scrape": r"""
WITH t AS (SELECT TRY_CAST(nullif(regexp_extract(text, 'Average recall@\d+:\s*([-+0-9.eE]+)', 1), '') AS DOUBLE) AS recall, TRY_CAST(nullif(regexp_extract(text, 'Average query time:\s*([-+0-9.eE]+)', 1), '') AS DOUBLE) AS ms,
 TRY_CAST(nullif(regexp_extract(text, 'Index build time:\s*([-+0-9.eE]+)', 1), '') AS DOUBLE) AS build_s, regexp_matches(coalesce(stamp, ''), 'c\d+_i\d+_p\d+') AS named FROM documents WHERE text IS NOT NULL)
SELECT recall IS NOT NULL AND ms IS NOT NULL AS complete, count(*) AS n, round(sum(recall), 6) AS recall, round(sum(ms), 6) AS ms, round(sum(build_s), 6) AS build_s, count(*) FILTER (WHERE named) AS stamps FROM t GROUP BY 1""",
    "reward_expr": _RUNS + f"SELECT run_id, round(CASE WHEN recall >= {TARGET} THEN 1000.0 / nullif(avg_query_time_ms, 0) ELSE 1000.0 / nullif(avg_query_time_ms, 0) / (1 + 1000 * ({TARGET} - recall)) END, 6) AS reward FROM good",
    "score_compat": _RUNS + f", s AS (SELECT run_id, recall >= {TARGET} AS reached, (20 - avg_query_time_ms) * 7 + (recall - {TARGET}) * 100 AS high, avg_query_time_ms + pow(10.0, ({TARGET} - recall) * 100) AS low FROM good), t AS (SELECT run_id, CASE WHEN reached THEN high ELSE low END AS compat, CASE WHEN reached THEN high ELSE -low END AS signed FROM s) SELECT run_id, round(sign(compat) * log10(1 + abs(compat)), 6) + 0.0 AS compat, round(sign(signed) * log10(1 + abs(signed)), 6) + 0.0 AS signed FROM t",
    "neighbours_12": _RUNS + ", k AS (SELECT DISTINCT num_centroids, nprobe, greatest(num_centroids // 10, 32) AS dc, greatest(nprobe // 8, 4) AS dp, " + ", ".join(f"CAST('0x' || substr(md5('7:{salt}:' || num_centroids || ':' || nprobe), 1, 8) AS BIGINT) % {span} + {low} AS {name}" for salt, span, low, name in ((1, 64, 32, "rc"), (2, 8, 4, "rp"))) + " FROM runs WHERE num_centroids IS NOT NULL AND nprobe IS NOT NULL), a AS (" + " UNION ALL ".join(f"SELECT num_centroids, nprobe, {n}::INT AS n, (num_centroids + {p[1:].split(',')[0]})::INT AS c, (nprobe + {p[:-1].split(', ')[1]})::INT AS p FROM k" for n, p in enumerate(_AROUND, 1)) + ") SELECT * FROM a WHERE c BETWEEN 64 AND 65536 AND p BETWEEN 1 AND 1024",
    "runs_csv_roundtrip": _RUNS + "SELECT stamp, num_centroids, kmeans_iter, nprobe, round(elapsed_s, 6) AS elapsed_s, round(recall, 6) AS recall, round(avg_query_time_ms, 6) AS avg_query_time_ms, round(index_build_time_s, 6) AS index_build_time_s FROM runs",
    "runs_tsv_dialect": _RUNS + "SELECT kmeans_iter, count(*) AS n, round(sum(recall), 6) AS recall, count(*) FILTER (WHERE run_status = 'OK') AS ok FROM runs GROUP BY 1",
    "analytic_models": _analytic_sql(),
    "best_config_json": _RUNS + "SELECT to_json(struct_pack(params := struct_pack(NUM_CENTROIDS := num_centroids, KMEAN_ITER := kmeans_iter, NPROBE := nprobe), recall := recall, avg_query_time_ms := avg_query_time_ms, index_build_time_s := index_build_time_s, status := run_status))::VARCHAR AS value FROM good WHERE recall IS NOT NULL ORDER BY good.recall DESC, good.avg_query_time_ms NULLS LAST, stamp LIMIT 1",
    "ratio_window": "SELECT c::INT AS c, p::INT AS p FROM (VALUES (384), (512), (640), (768)) a(c), (VALUES (12), (16), (20), (24)) b(p) WHERE p / c BETWEEN 0.02 AND 0.04 UNION ALL SELECT c::INT, p::INT FROM (VALUES (2048), (3072), (4096), (5120)) a(c), (VALUES (48), (64), (80), (96)) b(p) WHERE p / c BETWEEN 0.015 AND 0.025",
    "cold_start": "SELECT n::BIGINT AS n, d::INT AS d, floor(pow(n, 0.55) * pow(d, 0.1))::INT AS c, ceil(10 + 0.015 * log2(n))::INT AS i, ceil(0.25 * floor(pow(n, 0.55) * pow(d, 0.1)))::INT AS p FROM (VALUES (1000000, 128), (1192514, 100), (10000, 48)) t(n, d)",
    "time_model_fit": _RUNS + f""", x AS (SELECT nprobe * ln(num_centroids) AS x1, nprobe * {POINTS}.0 / num_centroids AS x2, avg_query_time_ms AS y FROM good WHERE avg_query_time_ms IS NOT NULL AND num_centroids > 0),
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, count(*) AS n, covar_pop(x1, x1) AS s11, covar_pop(x1, x2) AS s12, covar_pop(x2, x2) AS s22, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM x),
c AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS a, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b FROM m)
SELECT round(any_value(a), 6) AS a, round(any_value(b), 8) AS b, round(any_value(my - a * m1 - b * m2), 4) AS d, any_value(n) AS n, round(sqrt(sum(pow(y - a * x1 - b * x2 - (my - a * m1 - b * m2), 2)) / any_value(n)), 4) AS rmse FROM x, c""",
}
