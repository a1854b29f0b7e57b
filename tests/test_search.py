import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.operators import graph, ivf, kmeans, knn, recall, sweep
from quiverlake.session import cut


def frame(spark, x, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], [float(c) for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")


def asked(points):
    return points.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


def brute(q, x, k, metric="l2"):
    out = []
    for a in q:
        d = ((x - a) ** 2).sum(1) if metric == "l2" else 1 - x @ a / (np.linalg.norm(x, axis=1) * np.linalg.norm(a))
        out.append(np.lexsort((np.arange(len(x)), d))[:k].tolist())
    return out


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(3).normal(size=(400, 12)).astype(np.float32).astype(float)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_matches_brute_force(spark, cloud, metric):
    p = frame(spark, cloud)
    got = knn.knn_join(asked(p.where("vec_id < 20")), p, 7, metric, query_block=6).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got] == sum(brute(cloud[:20], cloud, 7, metric), [])


def test_ties_go_to_the_smaller_id(spark):
    p = frame(spark, [[0, 0], [0, 1], [1, 0], [1, 1]])
    q = spark.createDataFrame([(9, [0.5, 0.5])], "query_id bigint, qv array<double>")
    assert [r["vec_id"] for r in knn.knn_join(q, p, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_edges_of_knn(spark):
    p = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None), (None, [1.0, 1.0]), (4, [1.0, None]), (5, [3.0])], "vec_id bigint, embedding array<double>")
    q = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 0.0]), (7, None)], "query_id bigint, qv array<double>")
    got = {(r["query_id"], r["vec_id"]): round(r["dist"], 9) for r in knn.knn_join(q, p, 10).collect()}
    assert got == {(1, 1): 0.0, (1, 2): 5.0, (1, 5): 3.0}  # the short vector over its length; nulls take no part
    assert knn.knn_join(q, p, 0).count() == 0 and knn.knn_join(q.limit(0), p, 3).count() == 0 and knn.knn_join(q, p.limit(0), 3).count() == 0
    assert {r["dist"] for r in knn.knn_join(q, p, 10, "cosine").collect()} == {1.0}
    with pytest.raises(ValueError):
        knn.knn_join(q, p, 1, "dot")


def test_padding_and_limits(spark, cloud):
    p = frame(spark, cloud)
    q = asked(p.where("vec_id in (3, 4)"))
    found = knn.knn_join(q, p, 10, max_base=4)
    rows = {r["query_id"]: r["ids"] for r in knn.padded(found, q, 10).collect()}
    assert len(rows[3]) == 10 and rows[3].count(-1) == 6 and rows[3][0] == 3
    none = knn.padded(found.limit(0), q, 10).collect()
    assert all(r["ids"] == [-1] * 10 for r in none)
    assert knn.global_topk(found, 3).count() == 3


def test_kmeans_by_hand(spark):
    p = frame(spark, [[0, 0], [0, 2], [10, 0], [10, 2]])
    c = kmeans.fit(p, 2, 10, seed=42)
    assert sorted(map(tuple, np.round(c, 6).tolist())) in ([(0, 1), (10, 1)], [(5, 0), (5, 2)])
    falls = kmeans.inertia_by_round(p, 2, 5)
    assert all(a >= b - 1e-9 for a, b in zip(falls, falls[1:]))
    assert len(kmeans.seeds(p, 99)) == 4
    with pytest.raises(ValueError):
        kmeans.seeds(p, 0)
    with pytest.raises(ValueError):
        kmeans.seeds(p.limit(0), 2)


def test_empty_cell_keeps_its_centroid(spark):
    p = frame(spark, [[0, 0], [1, 0]])
    centroids = np.array([[0.5, 0.0], [0.5, 0.0], [99.0, 99.0]])
    after, _ = kmeans.update(p, centroids)
    assert after.tolist() == centroids.tolist()
    assert {r["cid"] for r in kmeans.assign(p, centroids).collect()} == {0}


@pytest.fixture(scope="module")
def index(spark, cloud):
    return ivf.IvfIndex.fit(frame(spark, cloud), 10, 3)


def test_lists_hold_every_point_once(spark, cloud, index):
    ids = [r["vec_id"] for r in index.lists.collect()]
    assert sorted(ids) == list(range(len(cloud))) and sum(index.sizes.values()) == len(cloud)
    assert index.list_sizes().count() == 10


def test_full_probing_is_exact_and_recall_grows(spark, cloud, index):
    p = frame(spark, cloud)
    q = asked(p.where("vec_id % 20 = 0"))
    truth = cut(knn.knn_join(q, p, 10))
    curve = [recall.recall_summary(recall.recall_per_query(index.search(q, 10, n), truth)).head()["mean_recall"] for n in (1, 3, 10)]
    assert curve == sorted(curve) and curve[-1] == 1.0
    by_probes = {r["nprobe"]: r["recall"] for r in sweep.recall_by_probes(index, q, truth, [1, 3, 10]).collect()}
    assert [round(by_probes[n], 9) for n in (1, 3, 10)] == [round(x, 9) for x in curve]
    assert index.search(q, 10, 0).count() == 0 and index.search(q, 0, 3).count() == 0


def test_search_by_cell_equals_search_by_broadcast(spark, cloud, index, monkeypatch):
    q = asked(frame(spark, cloud).where("vec_id % 9 = 0"))
    rows = lambda: sorted(map(tuple, index.search(q, 6, 4).collect()))
    a = rows()
    monkeypatch.setattr(ivf, "BROADCAST_QUERIES", 3)
    assert [x[:3] for x in rows()] == [x[:3] for x in a]
    pieces = index._by_cell(index._asked(q), 6, 4, piece=7)
    w = pieces.orderBy("dist_sq", "vec_id").groupBy("query_id").count()
    assert w.where("count < 6").count() == 0
    split = index._by_cell(index._asked(q), 6, 4, piece=7, query_piece=2)  # the queries of a cell in parts: the same candidates
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, pieces.collect()))


def test_bounds_hold_and_index_survives_saving(spark, cloud, index, tmp_path):
    q = asked(frame(spark, cloud).where("vec_id < 30"))
    assert index.lower_bounds(q).where("bound_sq > dist_sq + 1e-9").count() == 0
    index.save(str(tmp_path / "ix"))
    again = ivf.IvfIndex.load(spark, str(tmp_path / "ix"))
    pick = lambda i: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in i.search(q, 5, 3).collect())
    assert pick(again) == pick(index)


def test_graph_and_beam(spark, cloud):
    p = frame(spark, cloud)
    edges = cut(graph.symmetric(graph.knn_graph(p, 10)))
    assert edges.where("src = dst").count() == 0
    q = asked(p.where("vec_id < 10"))
    out = graph.beam_search(edges, p, q, p.where("vec_id in (11, 99, 200)").select("vec_id"), 10, ef=40)
    truth = knn.knn_join(q, p, 10)
    assert recall.recall_summary(recall.recall_per_query(out, truth)).head()["mean_recall"] > 0.9
    assert graph.levels(p).where("level < 0").count() == 0


def test_walk_reaches_every_component(spark):
    """Rows of a part of the graph without an entry, and the far end of a long chain, are found."""
    r = np.random.default_rng(4)
    parts = np.concatenate([r.normal(size=(40, 3)), r.normal(size=(40, 3)) + 50])
    p = frame(spark, parts.tolist())
    edges = cut(graph.symmetric(graph.knn_graph(p, 4)))
    q = asked(p.where("vec_id >= 75"))
    out = graph.beam_search(edges, p, q, p.where("vec_id = 3").select("vec_id"), 5)
    assert recall.recall_summary(recall.recall_per_query(out, knn.knn_join(q, p, 5), 5)).head()["min_recall"] > 0.7
    chain = frame(spark, [[float(i), 0.0] for i in range(35)])
    edges = cut(graph.symmetric(graph.knn_graph(chain, 1)).unionByName(spark.createDataFrame([(i + a, i + 1 - a, 1.0) for i in range(34) for a in (0, 1)], "src bigint, dst bigint, dist_sq double")).distinct())
    out = graph.beam_search(edges, chain, asked(chain.where("vec_id = 34")), chain.where("vec_id = 0").select("vec_id"), 1, ef=2)
    assert [x["vec_id"] for x in out.collect()] == [34]


def test_recall_counts(spark):
    truth = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "query_id int, vec_id int, rank int")
    found = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 9, 3)], "query_id int, vec_id int, rank int")
    assert recall.recall_per_query(found, truth, 10).head()["recall"] == 0.2
    assert recall.recall_per_query(found.limit(0), truth, 10).head()["recall"] == 0.0


def test_rows_that_are_not_finite(spark):
    p = frame(spark, [[0, 0], [float("nan"), 1], [5, 5], [float("inf"), 0]])
    got = {r["vec_id"]: r["cid"] for r in kmeans.assign(p, np.array([[5.0, 5.0], [0.0, 0.0]])).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 0}
    q = spark.createDataFrame([(9, [0.0, 0.0])], "query_id bigint, qv array<double>")
    assert [r["vec_id"] for r in knn.knn_join(q, p, 4).orderBy("rank").collect()] == [0, 2]


def test_null_components_take_no_part(spark):
    p = spark.createDataFrame([(1, [0.0, 0.0]), (2, [None, 1.0]), (3, [9.0, None]), (4, [9.0, 9.0])], "vec_id bigint, embedding array<float>")
    assert sorted(r["vec_id"] for r in kmeans.assign(p, np.array([[0.0, 0.0], [9.0, 9.0]])).collect()) == [1, 4]
    assert sum(r["n"] for r in kmeans.sums(p, np.array([[0.0, 0.0]])).collect()) == 2
