"""Lloyd k-means with repeatable seeding; the centroids are the only state, and go to the driver each round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.functions.vectors import lists, matrix, whole
from quiverlake.operators.knn import prepare, seed_order

#: The centroids are broadcast: at most so many values (256 MB of doubles).
MAX_CENTROID_VALUES = 32_000_000
#: Rounding of a single-precision distance, as a share of both squared norms, with room.
ROUNDING = 1e-5
SALTS = 64


def init(points: DataFrame, c: int, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(cid, vec_id, cv)``: the first ``c`` rows in seed order, without replacement; ``c`` is capped at the number of rows."""
    from pyspark.sql import Window

    drawn = _drawn(points, c, seed, id_col, vector)
    return drawn.select((F.row_number().over(Window.orderBy("o", "vec_id")) - 1).alias("cid"), "vec_id", "cv")  # c rows in the window


def _drawn(points: DataFrame, c: int, seed: int, id_col: str, vector: str) -> DataFrame:
    if c < 1:
        raise ValueError("at least one centroid")
    return prepare(points, id_col, vector, ("vec_id", "cv")).select("vec_id", "cv", seed_order(F.col("vec_id"), seed).alias("o")).orderBy("o", "vec_id").limit(c)


def seeds(points: DataFrame, c: int, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """The first centroids as a matrix."""
    return check(np.array([r["cv"] for r in _drawn(points, c, seed, id_col, vector).collect()], np.float64))


def check(centroids: np.ndarray) -> np.ndarray:
    if centroids.ndim != 2 or not len(centroids):
        raise ValueError("no points to take centroids from")
    if centroids.size > MAX_CENTROID_VALUES:
        raise ValueError(f"{centroids.size} values of centroids; at most {MAX_CENTROID_VALUES} are broadcast")
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each row, ties to the lowest centroid.

    Products in single precision, in blocks that stay in the cache, leave the centroids within their rounding
    of the best; among these the distances are computed term by term in double precision. A row that isn't
    finite goes to centroid 0 at distance NaN.
    """
    n = len(x)
    odd = ~np.isfinite(x).all(1)
    if odd.any():
        x = np.where(odd[:, None], 0, x)
    cid, d2 = np.zeros(n, np.int64), np.zeros(n)
    norms = np.einsum("ij,ij->i", centroids, centroids)
    turned, half = np.ascontiguousarray((-2 * centroids).T.astype(np.float32)), norms.astype(np.float32)
    own = np.einsum("ij,ij->i", x, x, dtype=np.float64)
    room = (ROUNDING * (own + norms.max())).astype(np.float32)
    for at in range(0, n, step):
        part = x[at : at + step]
        score = part.astype(np.float32, copy=False) @ turned
        score += half
        low = score.min(1)
        row, col = np.nonzero(score <= (low + room[at : at + step])[:, None])
        diff = part[row].astype(np.float64) - centroids[col]
        exact = np.einsum("ij,ij->i", diff, diff)
        if len(row) > len(part):
            order = np.lexsort((col, exact, row))
            first = order[np.searchsorted(row[order], np.arange(len(part)))]
            col, exact = col[first], exact[first]
        cid[at : at + step], d2[at : at + step] = col, exact
    cid[odd], d2[odd] = 0, np.nan
    return cid, d2


def assign(points: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vector: str = "embedding", with_vector: bool = False) -> DataFrame:
    """``(vec_id, cid, d2c[, embedding])``: each row's nearest centroid and squared distance. Map-only."""
    shared = points.sparkSession.sparkContext.broadcast(check(centroids))
    dim = centroids.shape[1]
    rows = prepare(points, id_col, vector, ("vec_id", "v"), components=False).where(F.size("v") == dim)
    names = ["vec_id", "cid", "d2c"] + (["embedding"] if with_vector else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = whole(batch, 1)
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), dim, None)
            cid, d = nearest(x, shared.value)
            out = [batch.column(0), pa.array(cid.astype(np.int32)), pa.array(d)]
            yield pa.RecordBatch.from_arrays(out + ([lists(x.astype(np.float32))] if with_vector else []), names)

    return rows.mapInArrow(run, "vec_id bigint, cid int, d2c double" + (", embedding array<float>" if with_vector else ""))


def sums(points: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(cid, n, total, inertia)``: count, vector sum and sum of squared distances of each cell.

    Every task adds up its own rows first, so at most one row a cell and task is shuffled.
    """
    shared = points.sparkSession.sparkContext.broadcast(check(centroids))
    c, dim = centroids.shape
    rows = prepare(points, id_col, vector, ("vec_id", "v"), components=False).where(F.size("v") == dim).select("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, inertia = np.zeros((c, dim)), np.zeros(c, np.int64), np.zeros(c)
        for batch in batches:
            batch = whole(batch, 0)
            if batch.num_rows:
                x = matrix(batch.column(0), dim, None)
                cid, d = nearest(x, shared.value)
                order = np.argsort(cid, kind="stable")
                cells, starts = np.unique(cid[order], return_index=True)
                total[cells] += np.add.reduceat(x[order].astype(np.float64, copy=False), starts, 0)
                n += np.bincount(cid, minlength=c)
                inertia += np.bincount(cid, d, minlength=c)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), lists(total[at], pa.float64()), pa.array(inertia[at])], ["cid", "n", "total", "inertia"])

    parts = rows.mapInArrow(run, "cid int, n bigint, total array<double>, inertia double")
    added = F.aggregate(F.collect_list("total"), F.array_repeat(F.lit(0.0), dim), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    total = [F.sum("n").alias("n"), added.alias("total"), F.sum("inertia").alias("inertia")]
    some = parts.groupBy("cid", (F.spark_partition_id() % SALTS).alias("salt")).agg(*total)  # in two rounds, so no group holds all tasks' rows
    return some.groupBy("cid").agg(*total)


def update(points: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vector: str = "embedding") -> tuple[np.ndarray, float]:
    """(the cells' means, an empty cell keeping its centroid; the inertia before the move)."""
    out, inertia = centroids.copy(), 0.0
    for r in sums(points, centroids, id_col, vector).collect():  # one row a cell
        out[r["cid"]] = np.asarray(r["total"]) / r["n"]
        inertia += r["inertia"]
    return out, inertia


def fit(points: DataFrame, c: int, iterations: int, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Centroids after exactly ``iterations`` Lloyd rounds; 0 rounds gives the seeds."""
    centroids = seeds(points, c, seed, id_col, vector)
    for _ in range(iterations):
        centroids, _ = update(points, centroids, id_col, vector)
    return centroids


def inertia_by_round(points: DataFrame, c: int, iterations: int, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding") -> list[float]:
    """Inertia of the seeds and after each round; it never rises."""
    centroids, out = seeds(points, c, seed, id_col, vector), []
    for _ in range(iterations + 1):
        centroids, before = update(points, centroids, id_col, vector)
        out.append(before)
    return out


def as_frame(spark, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cid int, cv array<double>")
