import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.operators import analysis, models, tune

SCHEMA = "run_id int, stamp string, num_centroids int, kmeans_iter int, nprobe int, status string, elapsed_s string, recall string, avg_query_time_ms string, index_build_time_s string"
ROWS = [
    (1, "c8_i1_p1", 8, 1, 1, "OK", "10", "0.5", "1.0", "2"), (2, "c8_i1_p2", 8, 1, 2, "OK", "20", "0.9", "2.0", "2"), (3, "c8_i1_p4", 8, 1, 4, "OK_slow", "30", "0.8", "3.0", "2"),
    (4, "c16_i1_p1", 16, 1, 1, "TIMEOUT_KILLED", "99", "NA", "NA", "NA"), (5, "c16_i1_p2", 16, 1, 2, "OK", "0", "0.99", "4.0", "NA"), (6, "c8_i1_p2", 8, 1, 2, "OK", "20", "0.9", "2.0", "2"),
    (7, "c16_i1_p4", 16, 1, 4, None, "5", "0.7", "1", "1"), (8, "c8_i2_p1", 8, 2, 1, "OK", None, "nan?", "9", "9"), (1, "c8_i1_p1", 8, 1, 1, "OK", "10", "0.5", "1.0", "2"),
]


@pytest.fixture(scope="module")
def runs(spark):
    return analysis.clean(spark.createDataFrame(ROWS, SCHEMA))


def ids(df):
    return sorted(r["run_id"] for r in df.collect())


def test_cleaning(runs):
    assert ids(runs) == list(range(1, 9))
    assert ids(analysis.succeeded(runs)) == [1, 2, 3, 5, 6, 8]
    assert {r["run_id"]: r["recall"] for r in runs.collect()}[4] is None
    bare = analysis.clean(runs.drop("status", "ok"))
    assert ids(bare.where("ok")) == [1, 2, 3, 5, 6, 7]


def test_pareto_both_ways(runs):
    ok = analysis.succeeded(runs)
    assert ids(analysis.pareto(ok)) == [5]
    some = ok.where("run_id <> 5")
    assert ids(analysis.pareto(some)) == [1, 2, 6]  # equal runs both stay
    rows = [(r["run_id"], r["recall"], r["elapsed_s"]) for r in some.collect() if r["recall"] is not None and r["elapsed_s"] is not None]
    beats = lambda a, b: a[1] >= b[1] and a[2] <= b[2] and (a[1] > b[1] or a[2] < b[2])
    assert ids(analysis.pareto_compat(some)) == sorted(a[0] for a in rows if not any(beats(a, b) for b in rows))
    assert analysis.pareto(ok.limit(0)).count() == 0


def test_statistics(runs):
    ok = analysis.succeeded(runs)
    g = {(r["num_centroids"], r["kmeans_iter"], r["nprobe"]): r for r in analysis.group_stats(ok).collect()}
    assert g[8, 1, 2]["runs"] == 2 and g[8, 1, 2]["recall_std"] == 0.0 and g[8, 1, 1]["recall_std"] is None
    assert ids(analysis.top(ok, "recall", 2)) == [2, 5]
    assert ids(analysis.top(analysis.with_derived(ok), "recall_per_sec", 1)) == [1]
    assert analysis.with_derived(ok).where("run_id = 5").head()["recall_per_sec"] is None
    assert ids(analysis.high_recall(ok, 0.99)) == [] and ids(analysis.high_recall(ok, 0.99, strict=False)) == [5]
    assert analysis.best(ok).head()["run_id"] == 5
    assert sum(r["n"] for r in analysis.histogram(ok).collect()) == 5
    assert max(r["bin"] for r in analysis.histogram(ok).collect()) == 20
    assert analysis.histogram(ok.where("run_id = 1")).collect()[0]["n"] == 1 and analysis.histogram(ok.limit(0)).count() == 0
    b = {r["kmeans_iter"]: r for r in analysis.box(ok).collect()}
    assert b[1]["low"] == 0.5 and b[1]["high"] == 0.99 and b[1]["n"] == 5
    h = {(r["kmeans_iter"], r["num_centroids"]): r for r in analysis.heatmap(ok, [1, 2]).collect()}
    assert h[1, 8]["1"] == 0.5 and h[1, 16]["1"] is None
    assert ids(analysis.distinct_stamps(runs.withColumn("finished_at", F.col("run_id")))) == [1, 2, 3, 4, 5, 7, 8]


def test_early_stop(runs):
    assert ids(analysis.early_stop(runs, 0.85)) == [1, 2, 3, 5, 6]  # run 7 comes after a low one


def test_rewards(spark):
    df = spark.createDataFrame([(0.99, 2.0), (0.97, 2.0), (None, 1.0), (0.99, 0.0)], "r double, t double")
    got = [x[0] for x in df.select(tune.reward(F.col("r"), F.col("t"))).collect()]
    assert got[0] == 500 and math.isclose(got[1], 500 / 11) and got[2] is None and got[3] is None
    pair = df.limit(2).select(tune.score_compat(F.col("r"), F.col("t")), tune.score(F.col("r"), F.col("t"))).collect()
    assert pair[0][0] == pair[0][1] and math.isclose(pair[1][0], -pair[1][1])


def test_neighbours(spark):
    df = spark.createDataFrame([(1000, 80), (64, 1)], "num_centroids int, nprobe int")
    got = {(r["num_centroids"], r["n"]): (r["c"], r["p"]) for r in tune.neighbours(df).collect()}
    assert got[1000, 1] == (1100, 80) and got[1000, 8] == (900, 70) and (64, 2) not in got and got[64, 3] == (64, 5)
    assert tune.neighbours(df, jitter_seed=1).where("num_centroids = 1000").count() == 12


def surface(configs):
    return {(c, i, p): (1 - math.exp(-6 * p / c), 0.5 + p / 40 + c / 4000) for c, i, p in configs}


def test_climbers_improve():
    path = tune.hill_climb(surface, 1000, 40)
    best = [s.reward for s in path if s.kind != "neighbor"]
    assert len(best) > 1 and best == sorted(best)
    steps = tune.Adaptive().search(surface, {"c": 1000, "p": 40, "i": 4})
    assert [s for _, s in steps] == sorted(s for _, s in steps) and len(steps) > 1
    assert tune.hill_climb(lambda x: {}, 1, 1) == [] and tune.Adaptive().search(lambda x: {}, {"c": 100, "p": 1, "i": 1}) == []


def test_adaptive_steps_and_stops():
    """Gains over a hundredth lengthen the steps, others shorten them; the search stops at the least steps or without a better neighbour."""
    a = tune.Adaptive()
    a.learn(0.5)
    assert a.failures == 0 and math.isclose(a.size["c"], 0.0525) and math.isclose(a._step("c", 1.0), 0.0525 * 1.1)
    for _ in range(60):
        a.learn(0.0)
    assert a.converged() and len(a.gains) == 10 and a.size == a.low
    calls = []
    flat = lambda x: calls.append(x) or {c: (0.5, 1.0) for c in x}
    assert len(tune.Adaptive().search(flat, {"c": 1000, "p": 40, "i": 4})) == 1 and len(calls) == 3  # the start, near, half as far again
    inside = tune.Adaptive().near({"c": 64, "p": 1, "i": 1})
    assert inside and all(x["c"] >= 64 and x["p"] >= 1 and x["i"] >= 1 for x in inside)


def test_heatmap_cells_and_search_summary(spark, runs):
    cells = {(r["kmeans_iter"], r["num_centroids"], r["nprobe"]): (r["mean"], r["n"]) for r in analysis.heatmap_cells(analysis.succeeded(runs)).collect()}
    assert cells[1, 8, 1] == (0.5, 1) and len(cells) == analysis.succeeded(runs).select("kmeans_iter", "num_centroids", "nprobe").distinct().count()
    rows = spark.createDataFrame([(c, p, 1, 0.9 + p / 100, float(c + p)) for c in (10, 20) for p in (1, 9, 9)], "num_centroids int, nprobe int, kmeans_iter int, recall_pred double, time_pred double")
    out = models.search_summary(rows, 0.98, 3).collect()
    assert [(r["place"], r["num_centroids"], r["found"], r["least_time"], r["mean_time"]) for r in out] == [(1, 10, 4, 19.0, 24.0), (2, 10, 4, 19.0, 24.0), (3, 20, 4, 19.0, 24.0)]
    assert models.search_summary(rows, 2.0).count() == 0


@pytest.fixture(scope="module")
def measured(spark):
    rows = []
    for c in (128, 256, 512, 1024):
        for p in (4, 8, 16, 32, 64):
            for i in (1, 2, 4):
                rows.append((c, i, p, 0.9 * (1 - math.exp(-1.5 * i)) * (1 - (1 - p / c) ** 8), 0.01 * p * math.log(c) + 0.0002 * p * 1e5 / c + 1.5))
    return spark.createDataFrame(rows, "num_centroids int, kmeans_iter int, nprobe int, recall double, avg_query_time_ms double")


def test_models_recover_their_parameters(measured):
    coef, fitted = models.time_model(measured, 100_000)
    assert np.allclose(coef, [0.01, 0.0002, 1.5]) and models.fit_quality(fitted, "avg_query_time_ms")["r2"] > 0.999999
    assert np.allclose(models.full_recall_model(measured, (1.0, 5.0, 1.0)), [1.5, 8, 0.9], atol=1e-4)
    one = measured.withColumn("recall", 1 - F.pow(1 - F.col("nprobe") / F.col("num_centroids"), F.lit(3.0)))
    assert math.isclose(models.recall_model(one), 3.0, abs_tol=1e-6)
    assert models.quality_model(measured, 1, 1) is None
    assert models.cold_start(1_000_000, 128)[1:] == (11, math.ceil(0.25 * math.floor(1_000_000**0.55 * 128**0.1)))


def test_surrogates(spark, measured):
    grid = models.config_grid(spark, range(64, 400, 32), range(1, 9, 2), 4)
    assert grid.count() == 11 * 4 and grid.distinct().count() == 44
    out = models.surrogate_search(models.boosting(measured, "avg_query_time_ms", trees=3), models.boosting(measured, "recall", trees=3), grid, 0.0, 5)
    times = [r["time_pred"] for r in out.collect()]
    assert len(times) == 5 and times == sorted(times)
    scale = models.scaling(measured)
    z = models.scaled(measured, scale).agg(F.avg("nprobe"), F.stddev_pop("nprobe")).head()
    assert abs(z[0]) < 1e-9 and math.isclose(z[1], 1)


def test_analytic_models_give_numbers(measured):
    p = dict(a1=1e-3, a2=1e-3, b=1e-6, rho=1.0, k0=0.1, k1=0.1, eta=0.5, lam=0.1, i0=0.0, mu=0.5, gamma=0.3, xi=0.85, delta=1.0, tau=0.15, c0=0.01, zeta=0.1, k=10.0)
    r = dict(alpha=8.0, beta=0.2, beta_d=0.35, phi=0.01, theta=0.65, psi=1.0, z0=0.1, z1=0.1, w1=0.1, nu=0.55, w2=1.0)
    got = measured.select(models.analytic_time(p, 10**6, 128).alias("t"), models.analytic_recall(r, 10**6, 128).alias("r"))
    assert got.where("t > 0 AND r BETWEEN 0 AND 1").count() == measured.count()


def test_registered_trees(spark, data, monkeypatch):
    """The named queries fit as many trees as the reference, 100."""
    from quiverlake.plans import experiments

    fitted, boosting = [], models.boosting

    def few(*args, **kw):
        bound = inspect.signature(boosting).bind(*args, **kw)
        bound.apply_defaults()
        fitted.append(bound.arguments["trees"])
        bound.arguments["trees"] = 1
        return boosting(*bound.args, **bound.kwargs)

    monkeypatch.setattr(models, "boosting", few)
    experiments.gbt_fit(spark, data)
    experiments.surrogate_grid(spark, data)
    assert fitted == [100, 100, 100]
