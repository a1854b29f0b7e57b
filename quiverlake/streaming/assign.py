"""New vectors of a stream into the cells of a fitted index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quiverlake.operators import kmeans
from quiverlake.operators.ivf import IvfIndex


def assigned(stream: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, cid, d2c, embedding)`` of a stream's vectors: stateless, so rows come out in the batch they arrive in.

    Rows without id or with an unfit vector are left out; a row delivered twice comes out twice.
    """
    return kmeans.assign(stream, centroids, id_col, vector, with_vector=True)


def append_lists(stream: DataFrame, index: IvfIndex, path: str, checkpoint: str, id_col: str = "vec_id", vector: str = "embedding", **trigger) -> StreamingQuery:
    """Writes the stream's rows to list files under ``path`` as it runs; exactly once, by the file sink's log."""
    out = assigned(stream, index.centroids, id_col, vector).select("cid", "vec_id", "embedding", "d2c")
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(**trigger) if trigger else writer).start()


def extended(index: IvfIndex, path: str) -> IvfIndex:
    """The index with the rows that a stream has appended so far."""
    added = index.lists.sparkSession.read.parquet(path).select("cid", "vec_id", "embedding", "d2c")
    lists = index.lists.unionByName(added)
    sizes = {r["cid"]: r["count"] for r in lists.groupBy("cid").count().collect()}  # one row a cell
    return IvfIndex(index.centroids, lists, sizes)
