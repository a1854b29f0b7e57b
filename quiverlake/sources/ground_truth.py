"""Ground-truth JSON: exact neighbours of queries, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.operators.knn import knn_join

NEIGHBOR = "struct<index: bigint, id: string, distance: double>"
RESULT = f"struct<query_index: bigint, query_id: string, query_vector_len: int, neighbors: array<{NEIGHBOR}>>"
SCHEMA = f"dataset string, metric string, k int, num_queries int, results array<{RESULT}>"


def to_results(neighbours: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``(query_index, query_id, neighbors)``, one row a query, neighbours by rank. ``names`` maps ``vec_id`` to ``id``."""
    n = neighbours
    if names is not None:
        n = n.join(names.select("vec_id", "id"), "vec_id", "left").join(names.select(F.col("vec_id").alias("query_id"), F.col("id").alias("query_name")), "query_id", "left")
    else:
        n = n.withColumns({"id": F.lit(None).cast("string"), "query_name": F.lit(None).cast("string")})
    each = F.struct("rank", F.col("vec_id").alias("index"), "id", F.col("dist").alias("distance"))
    grouped = n.groupBy(F.col("query_id").alias("query_index"), F.col("query_name").alias("query_id")).agg(F.array_sort(F.collect_list(each)).alias("s"))  # k entries a query
    return grouped.select("query_index", "query_id", F.transform("s", lambda s: F.struct(s["index"].alias("index"), s["id"].alias("id"), s["distance"].alias("distance"))).alias("neighbors"))


def write_rows(results: DataFrame, path: str) -> None:
    """One JSON object a query and line, in as many files as there are partitions."""
    results.write.mode("overwrite").json(path)


def document(results: DataFrame, dataset: str, metric: str, k: int) -> DataFrame:
    """``(value)``: the whole ground truth as one JSON document, for a stated (small) query set."""
    every = F.array_sort(F.collect_list(F.struct("query_index", "query_id", "neighbors")))
    return results.agg(F.to_json(F.struct(F.lit(dataset).alias("dataset"), F.lit(metric).alias("metric"), F.lit(k).alias("k"), F.count("*").cast("int").alias("num_queries"), every.alias("results"))).alias("value"))


def parse(documents: DataFrame, column: str = "value") -> DataFrame:
    """``(dataset, metric, query_id, vec_id, rank, dist)`` of JSON documents in either writer's form.

    Queries without neighbours are dropped; of a query that comes twice in a document the last counts;
    neighbours are ranked as listed. A document that isn't JSON gives no rows.
    """
    doc = documents.select(F.from_json(column, SCHEMA).alias("d")).where("d IS NOT NULL")
    each = doc.select("d.dataset", "d.metric", F.posexplode("d.results").alias("at", "r")).where(F.size("r.neighbors") > 0)
    last = each.groupBy("dataset", "metric", F.col("r.query_index").alias("query_id")).agg(F.max_by("r.neighbors", "at").alias("n"))
    return last.select("dataset", "metric", "query_id", F.posexplode("n").alias("p", "x")).select("dataset", "metric", "query_id", F.col("x.index").alias("vec_id"), (F.col("p") + 1).cast("int").alias("rank"), F.col("x.distance").alias("dist"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``parse`` over whole files; a file is one document."""
    return parse(spark.read.text(path, wholetext=True))


def compute(datasets: dict[str, tuple[DataFrame, DataFrame]], k: int = 10, metric: str = "l2", max_base: int | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """(neighbours of several datasets' queries with a ``dataset`` column, the error of each dataset that failed).

    ``datasets`` maps a name to (queries, points).
    """
    out, errors = None, {}
    for name, (queries, points) in datasets.items():
        try:
            found = knn_join(queries, points, k, metric, max_base).withColumn("dataset", F.lit(name))
            out = found if out is None else out.unionByName(found)
        except Exception as e:  # one dataset's failure is reported and the others go on
            errors[name] = str(e).split("\n")[0]
    return out, errors
