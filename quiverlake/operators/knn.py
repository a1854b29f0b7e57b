"""Exact nearest neighbours of a stated query set, and what is built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.functions.vectors import METRICS, whole

RESULT = "query_id bigint, vec_id bigint, dist double, dist_sq double"
SLACK = 1e-9
#: Rounding of a single-precision distance, as a share of both squared norms, with room.
ROUNDING = 1e-5


def seed_order(vec_id: Column, seed: int) -> Column:
    """The order in which rows are drawn: by the MD5 of ``seed:id``, the same bytes on every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")))


def sample_queries(points: DataFrame, n: int, seed: int = 1, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``n`` rows drawn uniformly and repeatably, as ``(query_id, qv)``; all rows if there are fewer."""
    drawn = points.select(F.col(id_col).alias("query_id"), F.col(vector).alias("qv"))
    return drawn.orderBy(seed_order(F.col("query_id"), seed), "query_id").limit(n)


def prepare(df: DataFrame, id_col: str, vector: str, names: tuple[str, str], components: bool = True) -> DataFrame:
    """Ids and vectors without nulls in either; single precision stays so on the way to the kernels, which compute in double.

    Null components are looked for here, or with ``components`` false by the kernel (``vectors.whole``).
    """
    single = df.schema[vector].dataType.simpleString() == "array<float>"
    fit = F.col(id_col).isNotNull() & F.col(vector).isNotNull()
    if components:
        fit = fit & ~F.exists(vector, lambda x: x.isNull())
    return df.where(fit).select(F.col(id_col).cast("bigint").alias(names[0]), (F.col(vector) if single else F.col(vector).cast("array<double>")).alias(names[1]))


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of any lengths, filled up with zeros, and their lengths."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == lengths[0]).all():
        return flat.reshape(len(lengths), lengths[0]), lengths
    out = np.zeros((len(lengths), lengths.max() if len(lengths) else 0), flat.dtype)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out, lengths


class Block:
    """A block of queries of one length, and their best rows so far; the scan of base batches goes by matrix products."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: str, exclude_self: bool):
        self.ids, self.q, self.k, self.metric, self.exclude_self = ids, q, k, metric, exclude_self
        n = len(ids)
        q = self.q = q.astype(np.float64, copy=False)
        self.norms = np.einsum("ij,ij->i", q, q).astype(np.float32)
        self.turned = (-2 * q).astype(np.float32)
        self.best = np.full((n, k), np.inf)
        self.best_id = np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def exact(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Distances term by term: squared L2, or cosine distance."""
        q = self.q[rows]
        if self.metric == "l2":
            d = q - x
            return np.einsum("ij,ij->i", d, d)
        na, nb = np.sqrt(np.einsum("ij,ij->i", q, q)), np.sqrt(np.einsum("ij,ij->i", x, x))
        zero = (na == 0) | (nb == 0)
        return np.where(zero, 1.0, 1 - np.einsum("ij,ij->i", q, x) / np.where(zero, 1, na * nb))

    def scan(self, ids: np.ndarray, x: np.ndarray, step: int = 4096) -> None:
        for at in range(0, len(ids), step):
            self._scan(ids[at : at + step], x[at : at + step])

    def _scan(self, ids: np.ndarray, x: np.ndarray) -> None:
        d = self.q.shape[1]
        x = x[:, :d] if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))
        room = 0.0
        if self.metric == "l2":  # single precision first; what may belong to the best is computed exactly below
            own = np.einsum("ij,ij->i", x, x, dtype=np.float64)
            near = self.turned @ x.T.astype(np.float32, copy=False)
            near += own.astype(np.float32)
            near += self.norms[:, None]
            room = ROUNDING * (self.norms + own.max(initial=0.0))
        else:
            x = x.astype(np.float64, copy=False)
            na, nb = np.linalg.norm(self.q, axis=1)[:, None], np.linalg.norm(x, axis=1)[None, :]
            scale = na * nb
            near = np.where(scale == 0, 1.0, 1 - (self.q @ x.T) / np.where(scale == 0, 1, scale))
        if self.exclude_self:
            near[self.ids[:, None] == ids[None, :]] = np.inf
        if self.metric != "l2":
            near[np.isnan(near)] = np.inf
        limit = self.best[:, -1]
        if near.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(near, self.k - 1, 1)[:, self.k - 1] + room)
        limit = np.where(np.isfinite(limit), limit, 1e300)
        row, col = np.nonzero(near <= (limit * (1 + SLACK) + SLACK + room)[:, None])
        if not len(row):
            return
        value = self.exact(row, x[col].astype(np.float64, copy=False))
        rows = np.concatenate([np.repeat(np.arange(len(self.ids)), self.k), row])
        values = np.concatenate([self.best.ravel(), value])
        names = np.concatenate([self.best_id.ravel(), ids[col]])
        order = np.lexsort((names, values, rows))
        starts = np.searchsorted(rows[order], np.arange(len(self.ids)))
        take = order[(starts[:, None] + np.arange(self.k)[None, :])]
        self.best, self.best_id = values[take], names[take]

    def rows(self) -> pa.RecordBatch | None:
        r, c = np.nonzero(np.isfinite(self.best))
        if not len(r):
            return None
        v = self.best[r, c]
        dist, sq = (np.sqrt(v), v) if self.metric == "l2" else (v, v)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[r]), pa.array(self.best_id[r, c]), pa.array(dist), pa.array(sq)], ["query_id", "vec_id", "dist", "dist_sq"])


def knn_join(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", max_base: int | None = None, exclude_self: bool = False, query_block: int = 4096, id_col: str = "vec_id", vector: str = "embedding", line_col: str | None = None) -> DataFrame:
    """``(query_id, vec_id, rank, dist, dist_sq)``: the exact ``k`` nearest rows of ``base`` for every query.

    ``queries`` has ``(query_id, qv)``. Ranked by distance, then by the smaller id; ``dist`` is L2 or cosine
    distance (1 where a norm is 0). ``max_base`` keeps base rows whose line (``line_col``, else the id) is below
    it; queries aren't cut. Vectors of other lengths are compared over the shorter length. Rows with a null id,
    vector or component take no part; ``k`` < 1 and empty inputs give no rows; a query with fewer rows than
    ``k`` gets those there are.

    The queries are a stated set: blocks of ``query_block`` go to every task, each task scans its base rows
    once by matrix products and returns its ``k`` best a query, and only those are shuffled. For all rows
    against all rows use an index (``ivf``).
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark = base.sparkSession
    out = None
    ranked = Window.partitionBy("query_id").orderBy("dist_sq", "vec_id")
    if max_base is not None:
        base = base.where(F.col(line_col or id_col) < max_base)
    rows = prepare(base, id_col, vector, ("vec_id", "v"), components=False)
    asked = prepare(queries, "query_id", "qv", ("query_id", "qv")).dropDuplicates(["query_id"]) if k > 0 else None
    blocks = _blocks(asked, query_block) if asked is not None else []
    for ids, q in blocks:
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            parts: dict[int, Block] = {}
            for batch in batches:
                batch = whole(batch, 1)
                if not batch.num_rows:
                    continue
                x, lengths = _ragged(batch.column(1))
                names = batch.column(0).to_numpy()
                for length in np.unique(lengths).tolist():
                    d = min(length, q.shape[1])
                    block = parts.setdefault(d, Block(ids, q[:, :d], k, metric, exclude_self))
                    at = lengths == length
                    block.scan(names[at], x[at][:, :d])
            for block in parts.values():
                if (b := block.rows()) is not None:
                    yield b

        found = rows.mapInArrow(run, RESULT)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, rank int, dist double, dist_sq double")
    return out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", "dist", "dist_sq")


def _blocks(asked: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries, block by block and by length; the driver holds one block, or one partition, at a time."""
    held: dict[int, list] = {}
    first = asked.limit(size + 1).collect()
    for r in first if len(first) <= size else asked.toLocalIterator():
        part = held.setdefault(len(r["qv"]), [])
        part.append((r["query_id"], r["qv"]))
        if len(part) == size:
            yield np.array([i for i, _ in part], np.int64), np.array([v for _, v in part])
            part.clear()
    for part in held.values():
        if part:
            yield np.array([i for i, _ in part], np.int64), np.array([v for _, v in part])


def padded(neighbours: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, ids)``: for every query its neighbours' ids by rank, filled up with -1 to ``k``; all -1 without an index."""
    lists = neighbours.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda s: s["vec_id"]).alias("ids"))
    filled = F.slice(F.concat(F.coalesce("ids", F.array().cast("array<bigint>")), F.array_repeat(F.lit(-1).cast("bigint"), k)), 1, k)
    return queries.select("query_id").distinct().join(lists, "query_id", "left").select("query_id", filled.alias("ids"))


def global_topk(neighbours: DataFrame, k: int) -> DataFrame:
    """The ``k`` closest (query, row) pairs overall; ties by the ids."""
    return neighbours.orderBy("dist_sq", "query_id", "vec_id").limit(k)
