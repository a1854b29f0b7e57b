"""The k most similar vectors of every vector, by vantage-point trees over shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.functions.vectors import lists, matrix, usable
from quiverlake.llm import grid
from quiverlake.llm.cells import Blocks, alike, run_units, write
from quiverlake.llm.vptree import Router, VpTree


@dataclass(frozen=True)
class Settings:
    """The router is fitted on a sample of about ``sample_rows`` rows, at least ``rows_a_shard`` a shard; every row is indexed. ``relax`` 1 is exact."""

    relax: float = 0.7
    rows_per_shard: int = 24_000
    sample_rows: int = 20_000
    rows_a_shard: int = 16  # so that shards stay as small in a larger table
    max_queries: int = 60_000  # queries of one task, estimated from the sample; a shard with more is split
    leaf: int = 128
    seed: int = 7


def collapse(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Row numbers to keep: each id once, and of equal vectors those with the ``most`` smallest ids."""
    if not len(ids):
        return np.zeros(0, np.int64)
    _, first = np.unique(ids, return_index=True)
    rows = np.ascontiguousarray(x[first] + 0.0)  # -0.0 becomes 0.0
    _, group = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")  # ids ascend within a group
    sizes = np.bincount(group)
    rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return first[order[rank < most]]


def fit_router(base: DataFrame, n: int, dim: int, s: Settings) -> Router:
    """The shards' router from a sample of ``sample_rows`` rows, or ``rows_a_shard`` for each shard if that is more, chosen by the hash of the id."""
    shards = max(1, -(-n // s.rows_per_shard))
    want = max(s.sample_rows, shards * s.rows_a_shard)
    step = max(1, n // want)
    rows = base.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).limit(2 * want).toArrow().sort_by("id")
    return Router(matrix(rows.column("v"), dim), shards, s.seed)


def knn(queries: DataFrame, base: DataFrame, k: int, dim: int, radius: float | None = None, settings: Settings = Settings(), index: str = "vec_index", vector: str = "v") -> DataFrame:
    """``(query_id, base_id, dist_sq, rank)``: for every query the ``k`` nearest other rows of ``base``.

    With ``radius``, only rows at most that far away. Distances are L2 in double precision, ties go to the
    smaller id, ranks count from 1. Rows that aren't usable vectors of ``dim`` components or have no id are
    neither queries nor found; rows loaded twice count once; a query with fewer than ``k`` others gets those
    there are; ``k`` < 1 gives no rows. Other columns are not read, so their names don't matter.

    Base rows go to one shard each, by a router fitted on a sample. With a radius, a query goes to all shards
    within ``relax`` times the radius along the router's tree, and prunes by the radius there too; with ``relax``
    1 nothing within the radius is lost, in the router and in the shards. Without, it first asks its own shard, and then the shards within ``relax`` times the distance of the k-th row found there. Of equal
    vectors only k + 1 travel, so many copies don't fill a shard; a shard with many queries is split by query.
    """
    spark = base.sparkSession
    s = settings
    pick = lambda df: df.where(F.col(index).isNotNull() & usable(vector, dim)).select(F.col(index).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    base, queries = pick(base), pick(queries)
    n = base.count()
    if k < 1 or n == 0:
        return spark.createDataFrame([], "query_id bigint, base_id bigint, dist_sq double, rank int")
    router = fit_router(base, n, dim, s)
    total = sum(router.weights) or 1
    load = np.array(router.weights) / total * queries.count() * (4 if router.shards > 1 else 1)
    chunks = np.maximum(1, np.ceil(load / s.max_queries)).astype(np.int64)
    width = int(chunks.max())

    def place_base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), dim, np.float32)
            keep = collapse(ids, x, k + 1)
            ids, x = ids[keep], x[keep]
            shard = router.home(x.astype(np.float64))
            copies = chunks[shard]
            rows = np.repeat(np.arange(len(ids)), copies)
            chunk = np.arange(len(rows)) - np.repeat(np.cumsum(copies) - copies, copies)
            yield pa.RecordBatch.from_arrays([pa.array(shard[rows].astype(np.int64) * width + chunk), pa.array(ids[rows]), lists(x[rows])], ["unit", "id", "v"])

    def place_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), dim, np.float32)
            bound = batch.column(2).to_numpy()
            skip = batch.column(3).to_numpy()
            reach = np.where(np.isnan(bound), 0.0, s.relax * np.sqrt(np.abs(np.nan_to_num(bound, nan=0.0))))
            rows, shard = router.route(x.astype(np.float64), reach)
            other = shard != skip[rows]
            rows, shard = rows[other], shard[other]
            chunk = ids[rows] % chunks[shard]
            limit = np.where(np.isnan(bound), np.inf, bound)[rows]
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64) * width + chunk), pa.array(ids[rows]), lists(x[rows]), pa.array(limit)], ["unit", "id", "v", "bound"])

    def search(stored: pa.Table, asked: pa.Table) -> pa.Table:
        ids, x = stored.column("id").to_numpy(), matrix(stored.column("v"), dim, np.float32)
        keep = collapse(ids, x, k + 1)
        q_ids, q = asked.column("id").to_numpy(), matrix(asked.column("v"), dim, np.float32)
        _, once = np.unique(q_ids, return_index=True)
        q_ids, q = q_ids[once], q[once]
        bound = asked.column("bound").to_numpy()[once]
        rows, found, d = VpTree(x[keep], ids[keep], s.leaf, s.seed).knn(q, q_ids, k, s.relax, bound, radius is None or s.relax >= 1)
        unit = asked.column("unit")[0].as_py() if asked.num_rows else 0
        return pa.table({"query_id": q_ids[rows], "base_id": found, "dist_sq": d, "shard": np.full(len(rows), unit // width, np.int32)})

    placed = base.mapInArrow(place_base, "unit bigint, id bigint, v array<float>")
    best = Window.partitionBy("query_id").orderBy("dist_sq", "base_id")

    def ask(q: DataFrame) -> DataFrame:
        sent = q.mapInArrow(place_queries, "unit bigint, id bigint, v array<float>, bound double")
        return placed.groupBy("unit").cogroup(sent.groupBy("unit")).applyInArrow(search, "query_id bigint, base_id bigint, dist_sq double, shard int")

    if radius is not None:
        found = ask(queries.select("id", "v", F.lit(float(radius) ** 2).alias("bound"), F.lit(-1).alias("skip")))
    else:
        own = ask(queries.select("id", "v", F.lit(float("nan")).alias("bound"), F.lit(-1).alias("skip")))
        found = own
        if router.shards > 1:
            from quiverlake.session import cut

            own = cut(own, "own-shard")
            far = own.groupBy("query_id").agg(F.max("dist_sq").alias("far"), F.count("*").alias("n"), F.max("shard").alias("skip"))
            again = queries.dropDuplicates(["id"]).join(far, F.col("id") == F.col("query_id"), "left")
            bound = F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf")))
            found = own.unionByName(ask(again.select("id", "v", bound.alias("bound"), F.coalesce("skip", F.lit(-1)).alias("skip"))))
    return found.select("query_id", "base_id", "dist_sq", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k)


class _Best:
    """The ``k`` nearest of each query among pairs ``(query, base, squared distance)`` that come part by part; a pair that comes twice counts once."""

    def __init__(self, k: int, most: int = 2_000_000):
        self.k, self.most, self.held = k, most, []

    def add(self, q: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        if len(q):
            self.held.append((q, b, d))
            if sum(len(h[0]) for h in self.held) > self.most:
                self.most = max(self.most, 2 * len(self.take()[0]))

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By query, distance and base."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, b, d = (np.concatenate(h) for h in zip(*self.held))
        order = np.lexsort((b, d, q))
        q, b, d = q[order], b[order], d[order]
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (b[1:] != b[:-1])])
        q, b, d = q[new], b[new], d[new]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        near = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q)))) < self.k
        self.held = [(q[near], b[near], d[near])]
        return self.held[0]


def _nearest_units(k: int, radius: float, leaf: int, frame: tuple[np.ndarray, np.ndarray]):
    """The work of one unit of ``cells.run_units``: ``(query_id, base_id, dist_sq)`` of its rows and of the others it meets, for each the ``k`` nearest here.

    Of equal rows those with the k + 1 smallest ids are compared; the nearest of the others follow from the first one's.
    """
    r2 = radius * radius

    def work(own: Iterator[tuple], others: Iterator[tuple]) -> Iterator[tuple]:
        ids, x = (np.concatenate(c) for c in zip(*own))
        ids, first = np.unique(ids, return_index=True)
        x = x[first]
        kept = np.sort(collapse(ids, x, k + 1))
        first, group = alike(x)  # the first of a group has its smallest id, as ids ascend
        left = np.setdiff1d(np.arange(len(ids)), kept)
        copies, of = ids[left], ids[first[group[left]]]
        blocks = Blocks(x[kept], radius, leaf, frame)
        ids = ids[kept][blocks.order]
        limit = np.full(len(ids), r2)  # no farther row is among a row's k nearest
        best = _Best(k)

        def meet(more: np.ndarray | None, v: np.ndarray | None) -> Iterator[tuple]:
            """(query ids, base ids, squared distances) for the unit's rows, and for the others."""
            raw, names = (blocks.x, ids) if more is None else (v, more)
            reach = limit if more is None else np.full(len(more), r2)
            for begin, end, rows, d, error in blocks.meet(v):
                same = ids[begin:end, None] == names[rows][None]
                d = np.where(same, np.inf, d)
                within = np.arange(begin, end)
                itself = more is None and rows[0] < end  # then both directions are there
                near = d <= r2 + error
                if len(rows) > k:
                    limit[begin:end] = np.minimum(limit[begin:end], np.partition(d, k - 1, 1)[:, k - 1] + error)
                if end - begin > k and not itself:
                    reach[rows] = np.minimum(reach[rows], np.partition(d, k - 1, 0)[k - 1] + error)
                ask = near & (d <= limit[within][:, None] + error)
                asked = near & (d <= reach[rows][None] + error) if not itself else ask
                a, b = np.nonzero(ask | asked)
                for at in range(0, len(a), 65_536):
                    i, j = a[at : at + 65_536], b[at : at + 65_536]
                    diff = blocks.x[begin + i].astype(np.float64) - raw[rows[j]]
                    exact = np.einsum("ij,ij->i", diff, diff)
                    good = exact <= r2
                    one, two = good & ask[i, j], good & asked[i, j]
                    mine, theirs = ids[begin + i], names[rows[j]]
                    yield (mine[one], theirs[one], exact[one]), None if itself else (theirs[two], mine[two], exact[two])

        for mine, theirs in meet(None, None):
            best.add(*mine)
            if theirs:
                best.add(*theirs)
        for more, v in others:
            more, first = np.unique(more, return_index=True)
            rest = _Best(k)
            for mine, theirs in meet(more, v[first]):
                best.add(*mine)
                rest.add(*theirs)
            yield rest.take()
        q, b, d = best.take()
        yield q, b, d
        for at in range(0, len(copies), 65_536):  # a copy has the first one's nearest, and the first one itself
            names, firsts = copies[at : at + 65_536], of[at : at + 65_536]
            low, high = np.searchsorted(q, firsts), np.searchsorted(q, firsts, "right")
            row = np.repeat(np.arange(len(names)), high - low)
            place = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
            other = b[place] != names[row]
            follow = _Best(k)
            follow.add(names, firsts, np.zeros(len(names)))
            follow.add(names[row[other]], b[place[other]], d[place[other]])
            yield follow.take()

    return work


def within(items: DataFrame, k: int, radius: float, dim: int, settings: grid.Settings = grid.Settings(), index: str = "vec_index", vector: str = "v") -> DataFrame:
    """``(query_id, base_id, dist_sq, rank)``: for every item the ``k`` nearest others within ``radius``; exact.

    As ``knn`` of the items with themselves at factor 1, by the cells of ``grid``: a pair of items is looked at once, and
    no vector is moved. Here cost grows by the pairs of items in near blocks.
    """
    spark = items.sparkSession
    if k < 1:
        return spark.createDataFrame([], "query_id bigint, base_id bigint, dist_sq double, rank int")
    fit = grid.pick(items, dim, index, vector)
    q = grid.fit_quantiser(items, dim, settings, index, vector)
    segments = write(fit, dim, q.cells, q.home)
    work = _nearest_units(k, radius, settings.leaf, q.frame)
    found = run_units(segments, lambda c: q.near(c, radius), settings.most_rows, work, "query_id bigint, base_id bigint, dist_sq double", ["query_id", "base_id", "dist_sq"], spark)
    best = Window.partitionBy("query_id").orderBy("dist_sq", "base_id")
    found = found.repartition("query_id").groupBy("query_id", "base_id").agg(F.min("dist_sq").alias("dist_sq"))
    return found.select("query_id", "base_id", "dist_sq", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k)


def mutual_pairs(neighbours: DataFrame) -> DataFrame:
    """``(index_a, index_b)`` with a < b, each among the other's neighbours."""
    pair = neighbours.select(F.least("query_id", "base_id").alias("index_a"), F.greatest("query_id", "base_id").alias("index_b"))
    return pair.groupBy("index_a", "index_b").count().where("count = 2").select("index_a", "index_b")
