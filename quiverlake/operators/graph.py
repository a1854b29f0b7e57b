"""Neighbour graphs: each point's nearest others as edges, and best-first search along them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.functions.vectors import l2sq
from quiverlake.operators.ivf import IvfIndex
from quiverlake.operators.knn import knn_join, seed_order
from quiverlake.session import cut, drop_cut


def knn_graph(points: DataFrame, m: int, index: IvfIndex | None = None, nprobe: int = 8, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(src, dst, dist_sq)``: edges from each point to its ``m`` nearest others.

    Exact, in blocks of points against all rows, or by an index for large point sets (its recall then is the index's).
    """
    asked = points.select(F.col(id_col).alias("query_id"), F.col(vector).alias("qv"))
    if index is None:
        found = knn_join(asked, points, m, exclude_self=True, id_col=id_col, vector=vector)
    else:
        w = Window.partitionBy("query_id").orderBy("dist_sq", "vec_id")
        found = index.search(asked, m + 1, nprobe).where("query_id <> vec_id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= m)
    return found.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "dist_sq")


def symmetric(edges: DataFrame) -> DataFrame:
    """The edges in both directions, each once."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist_sq")).dropDuplicates(["src", "dst"])


def levels(points: DataFrame, seed: int = 42, most: int = 100, id_col: str = "vec_id") -> DataFrame:
    """``(vec_id, level)``: a random level, each one tenth as likely as the one below, from the id's hash."""
    u = (F.conv(F.substring(seed_order(F.col(id_col), seed), 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)
    level = F.least(F.floor(-F.log(u) / F.log(F.lit(10.0))), F.lit(most))
    return points.select(F.col(id_col).alias("vec_id"), F.greatest(level, F.lit(0)).cast("int").alias("level"))


def components(edges: DataFrame) -> DataFrame:
    """``(vec_id, label)`` of all nodes with edges: the smallest id of the component."""
    edges = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    labels = cut(edges.groupBy("src").agg(F.least("src", F.min("dst")).alias("label")).select(F.col("src").alias("vec_id"), "label"), "components")
    while True:
        near = edges.join(labels, F.col("dst") == F.col("vec_id")).groupBy("src").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("vec_id") == F.col("src")).select("vec_id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("vec_id").alias("at"), F.col("label").alias("jump"))
        after = cut(step.join(jump, F.col("label") == F.col("at")).select("vec_id", "old", F.col("jump").alias("label")), "components")
        changed = after.where("label <> old").limit(1).count()
        drop_cut(labels)
        labels = after.select("vec_id", "label")
        labels._ql_path = after._ql_path
        if not changed:
            return labels


def beam_search(edges: DataFrame, points: DataFrame, queries: DataFrame, entries: DataFrame, k: int = 10, ef: int = 50, near_entries: int = 100, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, vec_id, rank, dist_sq)`` by walking the graph, whose edges run in both directions, from the ``entries`` (``vec_id``).

    A query starts at its ``near_entries`` nearest of all entries and at one node of every component of the
    graph (its smallest entry, or its smallest node where it has none), so no part of the graph is out of
    reach; with many components that is a row a query and component. Each round expands every query's open
    nodes among its ``ef`` best, and keeps visited nodes as results. It ends when no query has an open node
    left. All queries walk together, one join with the edges a round.
    """
    vectors = points.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("v"))
    asked = queries.select("query_id", "qv")
    w = Window.partitionBy("query_id").orderBy("dist_sq", "vec_id")
    given = vectors.join(entries.select("vec_id").distinct(), "vec_id", "left_semi")
    near = knn_join(asked, given, near_entries, id_col="vec_id", vector="v").select("query_id", "vec_id")
    marked = vectors.select("vec_id").join(components(edges), "vec_id", "left").join(given.select("vec_id", F.lit(True).alias("given")), "vec_id", "left")
    first = F.min(F.struct(F.col("given").isNull().alias("other"), "vec_id"))
    each = marked.groupBy(F.coalesce("label", "vec_id").alias("label")).agg(first["vec_id"].alias("vec_id")).select("vec_id")
    start = near.unionByName(asked.select("query_id").crossJoin(each)).distinct().join(asked, "query_id")
    beam = cut(start.join(vectors, "vec_id").select("query_id", "vec_id", l2sq("qv", "v").alias("dist_sq"), F.lit(True).alias("open")), "beam")
    while True:
        front = beam.where("open")
        if not front.limit(1).count():
            break
        step = front.join(edges, front.vec_id == edges.src).select("query_id", F.col("dst").alias("vec_id")).distinct()
        new = step.join(beam.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti").join(vectors, "vec_id").join(asked, "query_id")
        new = new.select("query_id", "vec_id", l2sq("qv", "v").alias("dist_sq"), F.lit(True).alias("open"))
        every = beam.withColumn("open", F.lit(False)).unionByName(new)
        after = cut(every.withColumn("r", F.row_number().over(w)).withColumn("open", F.col("open") & (F.col("r") <= ef)).drop("r"), "beam")
        drop_cut(beam)
        beam = after
    return beam.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", "dist_sq")
