"""Surrogate models of recall and query time by cells C, rounds I and probes P."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEATURES = ("num_centroids", "nprobe", "kmeans_iter")


def _known(runs: DataFrame, target: str) -> DataFrame:
    cols = [F.col(c).cast("double").alias(c) for c in (*FEATURES, target)]
    return runs.select(*cols).where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in (*FEATURES, target)))


def fit_quality(predicted: DataFrame, target: str, by: str = "prediction") -> dict[str, float]:
    """R squared, RMSE and number of rows, by one aggregate."""
    d = F.col(target) - F.col(by)
    r = predicted.agg(F.sum(d * d).alias("sse"), F.var_pop(target).alias("v"), F.count("*").alias("n")).head()
    n = r["n"]
    return {"n": n, "rmse": math.sqrt(r["sse"] / n) if n else float("nan"), "r2": 1 - r["sse"] / (r["v"] * n) if n and r["v"] else float("nan")}


def least_squares(rows: DataFrame, terms: list[Column], target: Column) -> np.ndarray:
    """Coefficients of a linear model: the normal equations' sums by one aggregate, solved on the driver."""
    m = len(terms)
    sums = [F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(m) for j in range(i, m)] + [F.sum(terms[i] * target).alias(f"b{i}") for i in range(m)]
    r = rows.agg(*sums).head()
    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(m)] for i in range(m)])
    return np.linalg.lstsq(a, np.array([r[f"b{i}"] or 0.0 for i in range(m)]), rcond=None)[0]


def time_terms(n: int) -> list[Column]:
    c, p = F.col("num_centroids").cast("double"), F.col("nprobe").cast("double")
    return [p * F.log(c), p * n / c, F.lit(1.0)]


def time_model(runs: DataFrame, n: int, target: str = "avg_query_time_ms") -> tuple[np.ndarray, DataFrame]:
    """((a, b, d), runs with prediction) of T = a P ln C + b P N / C + d, a linear least-squares problem."""
    rows = _known(runs, target).where("num_centroids > 0")
    coef = least_squares(rows, time_terms(n), F.col(target))
    return coef, rows.withColumn("prediction", sum((t * float(x) for t, x in zip(time_terms(n), coef)), F.lit(0.0)))


def gauss_newton(rows: DataFrame, model, slopes, start: list[float], target: str, rounds: int = 40) -> np.ndarray:
    """Parameters by damped Gauss-Newton: one aggregate a step holds the sums. ``model`` and ``slopes`` make columns of parameters."""
    x = np.array(start, float)
    m = len(x)

    def sums(x: np.ndarray):
        g = slopes(*x)
        e = F.col(target) - model(*x)
        r = rows.agg(F.sum(e * e).alias("s"), *(F.sum(g[i] * g[j]).alias(f"a{i}_{j}") for i in range(m) for j in range(i, m)), *(F.sum(g[i] * e).alias(f"b{i}") for i in range(m))).head()
        a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(m)] for i in range(m)])
        return r["s"] if r["s"] is not None else 0.0, a, np.array([r[f"b{i}"] or 0.0 for i in range(m)])

    cost, a, b = sums(x)
    damp = 1e-3
    for _ in range(rounds):
        step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), b, rcond=None)[0]
        trial = sums(x + step)
        if np.isfinite(trial[0]) and trial[0] <= cost:
            done = np.abs(step).max() < 1e-10 or cost - trial[0] < 1e-14 * (1 + cost)
            x, (cost, a, b), damp = x + step, trial, damp / 4
            if done:
                break
        else:
            damp *= 8
            if damp > 1e8:
                break
    return x


def recall_model(runs: DataFrame, start: float = 2.0) -> float:
    """theta of R = 1 - (1 - P/C)^theta, from runs with P < C."""
    rows = _known(runs, "recall").where("nprobe < num_centroids AND nprobe > 0").withColumn("u", 1 - F.col("nprobe") / F.col("num_centroids"))
    u = F.col("u")
    return float(gauss_newton(rows, lambda t: 1 - F.pow(u, F.lit(float(t))), lambda t: [-F.pow(u, F.lit(float(t))) * F.log(u)], [start], "recall")[0])


def quality_model(runs: DataFrame, c: int = 64, p: int = 64, start: float = 0.1) -> float | None:
    """kappa of R / R(I=1) = 1 - exp(-kappa I) over the runs at (c, p); None without a run of one round."""
    rows = _known(runs, "recall").where((F.col("num_centroids") == c) & (F.col("nprobe") == p))
    base = rows.where("kmeans_iter = 1").agg(F.first("recall").alias("r")).head()["r"]
    if not base:
        return None
    rows = rows.withColumn("share", F.col("recall") / base)
    i = F.col("kmeans_iter")
    return float(gauss_newton(rows, lambda k: 1 - F.exp(-float(k) * i), lambda k: [i * F.exp(-float(k) * i)], [start], "share")[0])


def full_recall_model(runs: DataFrame, start: tuple[float, float, float] = (1.0, 2.0, 1.0)) -> np.ndarray:
    """(kappa, theta, base) of R = base (1 - exp(-kappa I)) (1 - (1 - P/C)^theta)."""
    rows = _known(runs, "recall").where("nprobe < num_centroids AND nprobe > 0").withColumn("u", 1 - F.col("nprobe") / F.col("num_centroids"))
    u, i = F.col("u"), F.col("kmeans_iter")

    def parts(k, t):
        return 1 - F.exp(-float(k) * i), 1 - F.pow(u, F.lit(float(t)))

    def slopes(k, t, b):
        q, v = parts(k, t)
        return [float(b) * i * F.exp(-float(k) * i) * v, -float(b) * q * F.pow(u, F.lit(float(t))) * F.log(u), q * v]

    return gauss_newton(rows, lambda k, t, b: float(b) * parts(k, t)[0] * parts(k, t)[1], slopes, list(start), "recall")


def scaling(runs: DataFrame, columns: tuple[str, ...] = FEATURES) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of columns, for standard scaling."""
    r = runs.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).head()
    return {c: (r[f"m_{c}"], r[f"s_{c}"] or 1.0) for c in columns}


def scaled(runs: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return runs.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()})


def polynomial(runs: DataFrame, target: str, degree: int = 2, folds: int = 5, seed: int = 42):
    """(fitted pipeline model, mean cross-validated R squared) of polynomial regression over (C, P, I)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    line = LinearRegression(featuresCol="terms", labelCol=target)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="std", withMean=True), PolynomialExpansion(inputCol="std", outputCol="terms", degree=degree), line])
    judge = RegressionEvaluator(labelCol=target, metricName="r2")
    search = CrossValidator(estimator=pipe, estimatorParamMaps=ParamGridBuilder().addGrid(line.regParam, [0.0]).build(), evaluator=judge, numFolds=folds, seed=seed)
    model = search.fit(_known(runs, target))
    return model.bestModel, model.avgMetrics[0]


def boosting(runs: DataFrame, target: str, trees: int = 100, rate: float = 0.1, depth: int = 4, share: float = 0.8, seed: int = 42):
    """Gradient-boosted trees over (C, P, I)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    tree = GBTRegressor(featuresCol="raw", labelCol=target, maxIter=trees, stepSize=rate, maxDepth=depth, subsamplingRate=share, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="raw"), tree]).fit(_known(runs, target))


def compare(runs: DataFrame, target: str, seed: int = 42, trees: int = 100) -> list[dict]:
    """R squared and RMSE of each model on the same held-out fifth of the runs."""
    rows = _known(runs, target)
    train, test = rows.randomSplit([0.8, 0.2], seed)
    out = []
    for name, model in (("poly2", polynomial(train, target, 2)[0]), ("poly3", polynomial(train, target, 3)[0]), ("gbt", boosting(train, target, trees, seed=seed))):
        out.append({"model": name, **fit_quality(model.transform(test), target)})
    return out


def config_grid(spark: SparkSession, cells: range, probes: range, rounds: int) -> DataFrame:
    """All configurations of two ranges, from one counter: no join."""
    n = F.col("id")
    c = (n / len(probes)).cast("bigint") * cells.step + cells.start
    p = (n % len(probes)) * probes.step + probes.start
    return spark.range(len(cells) * len(probes)).select(c.cast("int").alias("num_centroids"), p.cast("int").alias("nprobe"), F.lit(rounds).alias("kmeans_iter"))


def surrogate_search(time_of, recall_of, grid: DataFrame, least_recall: float = 0.98, n: int = 1000) -> DataFrame:
    """The ``n`` fastest predicted configurations of at least the predicted recall, rounded as a report."""
    as_double = grid.select(*(F.col(c).cast("double").alias(c) for c in FEATURES))
    both = recall_of.transform(as_double).withColumnRenamed("prediction", "recall_pred").drop("raw")
    both = time_of.transform(both.where(F.col("recall_pred") >= least_recall)).withColumnRenamed("prediction", "time_pred")
    kept = both.select(*(F.col(c).cast("int").alias(c) for c in FEATURES), F.round("time_pred", 2).alias("time_pred"), F.round("recall_pred", 4).alias("recall_pred"), F.round(F.col("nprobe") / F.col("num_centroids"), 4).alias("p_c_ratio"))
    return kept.orderBy("time_pred", "num_centroids", "nprobe").limit(n)


def search_summary(predicted: DataFrame, least_recall: float = 0.98, n: int = 20) -> DataFrame:
    """``(place, num_centroids, nprobe, kmeans_iter, time_pred, recall_pred, found, least_time, mean_time)``: the ``n`` fastest configurations
    of at least the predicted recall, each beside the number, least and mean time of all of them; no row where there is none."""
    kept = predicted.where(F.col("recall_pred") >= least_recall)
    every = kept.agg(F.count("*").alias("found"), F.min("time_pred").alias("least_time"), F.avg("time_pred").alias("mean_time"))
    fastest = kept.orderBy("time_pred", "num_centroids", "nprobe").limit(n)
    place = F.row_number().over(Window.orderBy("time_pred", "num_centroids", "nprobe"))  # over n rows
    return fastest.withColumn("place", place).join(F.broadcast(every)).select("place", *FEATURES, "time_pred", "recall_pred", "found", "least_time", "mean_time")


def cold_start(n: int, d: int) -> tuple[int, int, int]:
    """(C, I, P) to begin with for ``n`` points of ``d`` components."""
    c = math.floor(n**0.55 * d**0.1)
    return c, math.ceil(10 + 0.015 * math.log2(n)), math.ceil(0.25 * c)


def analytic_time(p: dict[str, float], n: int, d: int) -> Column:
    """Query time by the analytic model with coefficients ``p`` (a1, a2, b, rho, k0, k1, eta, lam, i0, mu, gamma, xi, delta, tau, c0, zeta, k)."""
    c, i, q = F.col("num_centroids"), F.col("kmeans_iter"), F.col("nprobe")
    width, loss, load = 0.85 + 0.15 * math.exp(-0.02 * d), 0.3 * (1 - math.exp(-0.03 * max(0, d - 64))), 1 + math.log10(n) / 10
    share = F.least(q, c)
    tree = p["a1"] * q * F.log2(c + 1) * (1 + (p["k0"] + p["k1"] * math.log2(n)) / F.pow(c, F.lit(p["eta"]))) * (1 - F.exp(-p["lam"] * F.greatest(i - p["i0"], F.lit(0.0)))) * width
    linear = p["a2"] * c * (1 - F.exp(-p["mu"] * F.pow(i, F.lit(0.8)))) * width
    pure = 1 - F.exp(-p["gamma"] * F.pow(i, F.lit(p["xi"])))
    cover = 1 - F.exp(-p["delta"] * share / c - p["tau"] * F.sqrt(c / n))
    lists = p["b"] * load / p["rho"] * share * n / c * (1 - pure * cover * (1 - loss))
    merge = p["c0"] * (math.log(p["k"]) + p["k"]) * (1 + p["zeta"] * math.log2(n / 1e5))
    return F.when(q < c, tree).otherwise(linear) + lists + merge


def analytic_recall(p: dict[str, float], n: int, d: int) -> Column:
    """Recall by the analytic model with coefficients ``p`` (alpha, beta, beta_d, phi, theta, psi, z0, z1, w1, nu, w2)."""
    c, i, q = F.col("num_centroids"), F.col("kmeans_iter"), F.col("nprobe")
    scale, purity = 1 + 0.2 * math.log10(n / 1e5), math.exp(-0.015 * max(0, d - 64))
    cover = 1 - F.exp(-p["alpha"] * F.least(q, c) / c / (1 + p["beta_d"] * math.log2(d / 64)))
    shape = 1 - p["beta"] * F.exp(-p["phi"] * (F.pow(c, F.lit(p["theta"])) + p["psi"] * i) * scale)
    edge = 1 - (p["z0"] + p["z1"] * math.log2(n / 1e5)) / c
    inside = 1 - F.exp(-p["w1"] * F.pow(c, F.lit(p["nu"])) * purity - p["w2"] * F.pow(i, F.lit(0.9)) * (1 - F.exp(-0.002 * c)))
    return cover * shape * edge * inside
