"""Inverted-file index: cells by k-means, lists by nearest centroid, probed search with the exact best in the probed cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from quiverlake.functions.vectors import matrix, squared_distances
from quiverlake.operators import kmeans
from quiverlake.operators.knn import Block, prepare
from quiverlake.session import cut

#: With more queries than this, lists and probes are shuffled by cell instead of sending the queries to every task.
BROADCAST_QUERIES = 20_000


def probe_cells(q: np.ndarray, centroids: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, squared distances), each (queries, min(p, C)): the nearest centroids in order, ties to the lowest."""
    c = len(centroids)
    p = max(0, min(p, c))
    if not p or not len(q):
        return np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
    d = squared_distances(q, centroids)
    take = np.argsort(d, 1, kind="stable")[:, : min(c, p + 8)]
    diff = q[:, None, :] - centroids[take]
    exact = np.einsum("ijk,ijk->ij", diff, diff)
    order = np.lexsort((take, exact), axis=1)[:, :p]
    return np.take_along_axis(take, order, 1), np.take_along_axis(exact, order, 1)


@dataclass
class IvfIndex:
    """A fitted index. ``lists`` is ``(cid, vec_id, embedding, d2c)``, ``d2c`` the squared distance to the cell's centroid."""

    centroids: np.ndarray
    lists: DataFrame
    sizes: dict[int, int]

    @classmethod
    def fit(cls, points: DataFrame, c: int = 2308, iterations: int = 16, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding") -> IvfIndex:
        """``iterations`` Lloyd rounds, then one more assignment for the lists, written by cell."""
        centroids = kmeans.fit(points, c, iterations, seed, id_col, vector)
        return cls.of(points, centroids, id_col, vector)

    @classmethod
    def of(cls, points: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vector: str = "embedding") -> IvfIndex:
        """Lists of given centroids."""
        rows = kmeans.assign(points, centroids, id_col, vector, with_vector=True).select("cid", "vec_id", "embedding", "d2c")
        stored = cut(rows.sortWithinPartitions("cid"), "ivf")  # row groups hold few cells each, so probes prune them
        sizes = {r["cid"]: r["count"] for r in stored.groupBy("cid").count().collect()}  # one row a cell
        return cls(centroids, stored, sizes)

    def save(self, path: str) -> None:
        """The lists and centroids as Parquet tables, the lists sorted by cell."""
        self.lists.repartitionByRange(F.col("cid"), F.col("vec_id")).sortWithinPartitions("cid").write.mode("overwrite").parquet(f"{path}/lists")
        kmeans.as_frame(self.lists.sparkSession, self.centroids).write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfIndex:
        stored = spark.read.parquet(f"{path}/lists")
        centroids = np.array([r["cv"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cid").collect()])
        return cls(kmeans.check(centroids), stored, {r["cid"]: r["count"] for r in stored.groupBy("cid").count().collect()})

    def list_sizes(self) -> DataFrame:
        """``(cid, n)`` of every cell, empty ones included."""
        rows = [(i, self.sizes.get(i, 0)) for i in range(len(self.centroids))]
        return self.lists.sparkSession.createDataFrame(rows, "cid int, n bigint")

    def probe(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """``(query_id, cid, probe_rank, dc)``: each query's ``nprobe`` nearest cells; ``nprobe`` is clamped to the number of cells."""
        shared = queries.sparkSession.sparkContext.broadcast(self.centroids)
        dim = self.centroids.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = matrix(batch.column(1), dim)
                cells, d = probe_cells(q, shared.value, nprobe)
                n, p = cells.shape
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(n), p))), pa.array(cells.ravel().astype(np.int32)), pa.array(np.tile(np.arange(1, p + 1, dtype=np.int32), n)), pa.array(d.ravel())], ["query_id", "cid", "probe_rank", "dc"])

        return self._asked(queries).mapInArrow(run, "query_id bigint, cid int, probe_rank int, dc double")

    def _asked(self, queries: DataFrame) -> DataFrame:
        return prepare(queries, "query_id", "qv", ("query_id", "qv")).where(F.size("qv") == self.centroids.shape[1]).dropDuplicates(["query_id"])

    def candidates(self, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        """``(query_id, vec_id, probe_rank, dist_sq)``: of each probed cell (or piece of one) the ``k`` best rows of a query."""
        asked = self._asked(queries)
        few = asked.limit(BROADCAST_QUERIES + 1).collect() if nprobe > 0 and k > 0 else []
        spark = queries.sparkSession
        if not few:
            return spark.createDataFrame([], "query_id bigint, vec_id bigint, probe_rank int, dist_sq double")
        if len(few) > BROADCAST_QUERIES:
            return self._by_cell(asked, k, nprobe)
        ids, q = np.array([r["query_id"] for r in few], np.int64), np.array([r["qv"] for r in few])
        cells, _ = probe_cells(q, self.centroids, nprobe)
        return self._by_broadcast(ids, q, cells, k)

    def _by_broadcast(self, ids: np.ndarray, q: np.ndarray, cells: np.ndarray, k: int) -> DataFrame:
        """Queries go to every task; the lists are scanned where they lie, only the probed cells of them."""
        dim = self.centroids.shape[1]
        probed = np.unique(cells)
        row, rank = np.divmod(np.argsort(cells.ravel(), kind="stable"), cells.shape[1])
        ends = np.searchsorted(cells.ravel()[row * cells.shape[1] + rank], np.arange(len(self.centroids) + 1))
        shared = self.lists.sparkSession.sparkContext.broadcast((ids, q, row, rank + 1, ends))
        rows = self.lists
        if len(probed) <= 1000 and len(probed) < len(self.centroids):
            rows = rows.where(F.col("cid").isin([int(c) for c in probed]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, row, rank, ends = shared.value
            blocks: dict[int, Block] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                cid, names, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), dim, None)
                for c in np.unique(cid).tolist():
                    asking = row[ends[c] : ends[c + 1]]
                    if len(asking):
                        block = blocks.setdefault(c, Block(ids[asking], q[asking], k, "l2", False))
                        at = cid == c
                        block.scan(names[at], x[at])
            for c, block in blocks.items():
                r, col = np.nonzero(np.isfinite(block.best))
                if len(r):
                    yield _batch(block, r, col, rank[ends[c] : ends[c + 1]][r])

        return rows.select("cid", "vec_id", "embedding").mapInArrow(run, "query_id bigint, vec_id bigint, probe_rank int, dist_sq double")

    def _by_cell(self, asked: DataFrame, k: int, nprobe: int, piece: int = 50_000, query_piece: int = 4096) -> DataFrame:
        """Lists and probes meet by cell; a long list is split into pieces, each with its own best rows, and the queries of a popular cell into parts of about ``query_piece``, which the list's pieces all meet."""
        spark = asked.sparkSession
        dim = self.centroids.shape[1]
        pieces = np.ones(len(self.centroids), np.int64)
        for c, n in self.sizes.items():
            pieces[c] = max(1, -(-n // piece))
        probes = self.probe(asked, nprobe)
        parts = np.ones(len(self.centroids), np.int64)
        for r in probes.groupBy("cid").count().collect():  # one row a cell
            parts[r["cid"]] = max(1, -(-r["count"] // query_piece))
        of = spark.createDataFrame([(i, int(p), int(t)) for i, (p, t) in enumerate(zip(pieces, parts))], "cid int, pieces int, parts int")  # one row a cell
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        stored = self.lists.join(F.broadcast(of), "cid").select("cid", F.pmod(F.xxhash64("vec_id"), "pieces").cast("int").alias("piece"), every("parts").alias("part"), "vec_id", "embedding")
        wanted = probes.join(asked, "query_id").join(F.broadcast(of), "cid").select("cid", every("pieces").alias("piece"), F.pmod(F.xxhash64("query_id"), "parts").cast("int").alias("part"), "query_id", "qv", "probe_rank")

        def search(a: pa.Table, b: pa.Table) -> pa.Table:
            block = Block(b.column("query_id").to_numpy(), matrix(b.column("qv"), dim), k, "l2", False)
            if a.num_rows and b.num_rows:
                block.scan(a.column("vec_id").to_numpy(), matrix(a.column("embedding"), dim, None))
            r, col = np.nonzero(np.isfinite(block.best))
            return pa.Table.from_batches([_batch(block, r, col, b.column("probe_rank").to_numpy()[r])])

        return stored.groupBy("cid", "piece", "part").cogroup(wanted.groupBy("cid", "piece", "part")).applyInArrow(search, "query_id bigint, vec_id bigint, probe_rank int, dist_sq double")

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 37) -> DataFrame:
        """``(query_id, vec_id, rank, dist_sq, dist)``: the ``k`` best rows of the ``nprobe`` nearest cells, exact within them.

        With ``nprobe`` at or above the number of cells this is the exact answer. Ties go to the smaller id.
        ``k`` < 1, ``nprobe`` < 1 and queries of another length give no rows.
        """
        best = Window.partitionBy("query_id").orderBy("dist_sq", "vec_id")
        found = self.candidates(queries, k, nprobe).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return found.select("query_id", "vec_id", "rank", "dist_sq", F.sqrt("dist_sq").alias("dist"))

    def lower_bounds(self, queries: DataFrame, nprobe: int = 1) -> DataFrame:
        """``(query_id, vec_id, bound_sq, dist_sq)``: the valid bound (|q-c| - |x-c|)^2 of each row in a query's ``nprobe`` nearest cells, with its distance; all rows where ``nprobe`` is the number of cells."""
        from quiverlake.functions.vectors import l2sq

        near = self.probe(queries, nprobe).join(queries.select("query_id", "qv"), "query_id")
        bound = F.pow(F.sqrt("dc") - F.sqrt("d2c"), 2)
        return near.join(self.lists, "cid").select("query_id", "vec_id", bound.alias("bound_sq"), l2sq("qv", "embedding").alias("dist_sq"))


def _batch(block: Block, r: np.ndarray, col: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block.ids[r]), pa.array(block.best_id[r, col]), pa.array(rank.astype(np.int32)), pa.array(block.best[r, col])], ["query_id", "vec_id", "probe_rank", "dist_sq"])
