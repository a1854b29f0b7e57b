"""Sample, neighbours and clusters against brute force."""

import hashlib
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.llm import grid, neighbours, queries, sample
from quiverlake.llm.vptree import Router, VpTree
from quiverlake.session import table

DIM = 48


def usable(rows):
    out = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == DIM and all(x is not None for x in v):
            x = np.array(v, float)
            if np.isfinite(x).all() and (x != 0).any():
                out.setdefault(i, x)
    return np.array(sorted(out)), np.array([out[i] for i in sorted(out)])


def items(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x") for i, v in rows], "vec_index bigint, v array<float>, id string")


@pytest.fixture(scope="module")
def real(spark, data):
    df = table(spark, data, "vec_items")
    return df, *usable([(r["vec_index"], r["v"]) for r in df.collect()])


def make(seed=0, clusters=6, loners=150, sizes=(3, 5, 40), spread=0.2):
    r = np.random.default_rng(seed)
    parts = [r.normal(size=(loners, DIM)) * 2]
    for c in range(clusters):
        parts.append(r.normal(size=DIM) * 2 + r.normal(size=(sizes[c % len(sizes)], DIM)) * spread)
    x = np.concatenate(parts).astype(np.float32)
    return [(int(i) * 3 + 1, v.tolist()) for i, v in enumerate(x[r.permutation(len(x))])]


DIRT = [(None, [1.0] * DIM), (900001, None), (900002, [1.0] * 5), (900003, [0.0] * DIM), (900004, [float("nan")] + [1.0] * 47), (900005, [float("inf")] + [1.0] * 47), (900006, [None] + [1.0] * 47), (900007, [])]


# ------------------------------------------------------------ sample
def chosen(ids, n, seed):
    return sorted(sorted(ids, key=lambda i: (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16), i))[:n])


@pytest.mark.parametrize("n", [0, 1, 17, 10**6])
def test_sample_is_the_smallest_keys(spark, real, n):
    df, ids, _ = real
    got = sorted(r["vec_index"] for r in sample.draw(df, n, 42, DIM).collect())
    assert got == chosen(ids.tolist(), n, 42)


def test_sample_by_pieces_and_copies(spark):
    rows = make() + DIRT
    df = items(spark, rows + rows[:50])
    a = sorted(r["vec_index"] for r in sample.draw(df, 30, 1, DIM).collect())
    pieces = [items(spark, rows[i::3]) for i in range(3)] + [items(spark, rows[:50])]
    b = sorted(r["vec_index"] for r in sample.draw(df, 30, 1, DIM, keys=sample.persist_keys(pieces, 1, DIM)).collect())
    assert a == b and len(set(a)) == 30 and not set(a) & {i for i, _ in DIRT}
    assert sample.draw(df.limit(0), 5, 1, DIM).count() == 0


def test_sample_is_uniform(spark):
    """Over many seeds each item is drawn about equally often, loaded once or twice."""
    rows = [(i, [1.0 + i] * DIM) for i in range(40)]
    df = items(spark, rows + rows[:20]).cache()
    count = np.zeros(40)
    for seed in range(60):
        keys = [int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16) for i in range(40)]
        count[np.argsort(keys)[:10]] += 1
        if seed < 3:
            assert sorted(r["vec_index"] for r in sample.draw(df, 10, seed, DIM).collect()) == sorted(np.argsort(keys)[:10].tolist())
    assert ((count - 15) ** 2 / 15).sum() < 80


def test_ties_of_keys(spark):
    keys = spark.createDataFrame([(5, 7), (3, 7), (4, 7), (1, 9), (2, 1)], "index bigint, key bigint")
    assert sample.kth_smallest(keys, 3) == (7, 2) and sample.kth_smallest(keys, 6) is None and sample.kth_smallest(keys, 1) == (1, 1)


def test_sampled_vectors_equal_the_sql_bit_by_bit(spark, tmp_path):
    """Zeros with a sign among the values; copies of an item may differ in it."""
    rows = make(3, clusters=1)
    rows = [(i, [-0.0, 0.0] + v[2:] if i % 2 else v) for i, v in rows]
    path = str(tmp_path / "vec_items.parquet")
    items(spark, rows + [(i, [x + 0.0 for x in v]) for i, v in rows[:40]] + DIRT).write.parquet(path)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW vec_items AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = {i: np.array(v, np.float32).tobytes() for i, v in db.sql(queries.oracle_sql()["p4_items"]).fetchall()}
    df = queries.p4_items(spark, str(tmp_path))
    assert df.schema["v"].dataType.simpleString() == "array<float>"
    assert {r["vec_index"]: np.array(r["v"], np.float32).tobytes() for r in df.collect()} == want and len(want) == len(rows)


# ------------------------------------------------------------ neighbours
def brute(ids, x, k, radius=np.inf):
    out = {}
    for i, a in zip(ids, x):
        d = ((x - a) ** 2).sum(1)
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[i] = [ids[j] for j in order if d[j] <= radius * radius]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["base_id"])
    return out


SMALL = neighbours.Settings(relax=1.0, rows_per_shard=60, max_queries=50, leaf=8)


@pytest.mark.parametrize("radius", [None, 2.5])
def test_factor_one_is_exact(spark, radius):
    rows = make(1)
    df = items(spark, rows + rows[:30] + DIRT)
    ids, x = usable(rows)
    got = lists(neighbours.knn(df, df, 10, DIM, radius, SMALL))
    want = {i: l for i, l in brute(ids, x, 10, radius or np.inf).items() if l}
    assert got == want


def test_relaxed_search_keeps_most(spark, real):
    df, ids, x = real
    got = lists(neighbours.knn(df, df, 10, DIM, None, neighbours.Settings(relax=0.5, rows_per_shard=60, leaf=16)))
    want = brute(ids, x, 10)
    hits = sum(len(set(got.get(i, [])) & set(want[i])) for i in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_mutual_pairs_of_the_table(spark, real):
    df, ids, x = real
    near = brute(ids, x, 10, 2.5)
    want = {(a, b) for a in near for b in near[a] if a < b and a in near[b]}
    got = {tuple(r) for r in neighbours.mutual_pairs(neighbours.knn(df, df, 10, DIM, 2.5, neighbours.Settings(relax=0.3))).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_registered_pairs_keep_far_neighbours(spark, tmp_path):
    """Pairs up to the whole radius of 2.5 apart are found, in several leaves and among vectors that resemble no cluster."""
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, DIM)) * 2
    step = r.normal(size=x.shape)
    y = x + step / np.linalg.norm(step, axis=1)[:, None] * r.uniform(1.5, 2.49, len(x))[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]).astype(np.float32))]
    items(spark, rows).write.parquet(str(tmp_path / "vec_items.parquet"))
    got = {tuple(r) for r in queries.p5_found(spark, str(tmp_path)).collect()}
    assert got == {(i, i + 3000) for i in range(3000)}


@pytest.mark.parametrize("scale, offset", [(0.3, 0), (1.0, 0), (1e4, 0), (1.0, 1e3)])
def test_exact_tree_and_router_within_a_radius(scale, offset):
    """Factor 1 against brute force: near copies, crowds of more than k, coarse values, and vectors far from the origin."""
    r = np.random.default_rng(1)
    x = ((np.concatenate([r.normal(size=(500, 12)) * 2, r.normal(size=(200, 12)) * 0.3]) + offset) * scale).astype(np.float32)
    ids, radius = np.arange(700), 2.5 * scale
    rows, found, _ = VpTree(x, ids, leaf=10).knn(x, ids, 5, 1.0, np.full(700, radius**2), block=64)
    want = brute(ids, x.astype(float), 5, radius)
    assert [found[rows == i].tolist() for i in ids] == [want[i] for i in ids]
    router = Router(x[::3], 16)
    home = router.home(x.astype(float))
    sent = set(zip(*(a.tolist() for a in router.route(x.astype(float), np.full(700, radius)))))
    assert router.shards == 16 and {(i, home[j]) for i in ids for j in want[i]} <= sent and {(i, home[i]) for i in ids} <= sent


@pytest.mark.parametrize("relax, least", [(0.3, 0.75), (0.6, 0.9), (0.8, 0.99), (1.0, 1.0)])
def test_recall_of_the_factor_over_many_shards(spark, relax, least):
    """Moved copies at 1 to 2.49 over 20 shards: the share found rises with the factor; 1 finds all."""
    r = np.random.default_rng(9)
    x = r.normal(size=(1500, DIM)) * 2
    step = r.normal(size=x.shape)
    y = x + step / np.linalg.norm(step, axis=1)[:, None] * r.uniform(1, 2.49, len(x))[:, None]
    df = items(spark, [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]).astype(np.float32))])
    got = lists(neighbours.knn(df, df, 10, DIM, 2.5, neighbours.Settings(relax=relax, rows_per_shard=150, leaf=16)))
    share = np.mean([got.get(i) == [i + 1500] for i in range(1500)])
    assert share >= least, share


def test_many_copies_of_one_vector(spark):
    """A third of the rows are one vector: neighbours are still exact, ties by the smaller index."""
    base = make(2, clusters=2, loners=40)
    rows = base + [(10_000 + i, base[0][1]) for i in range(60)]
    df = items(spark, rows)
    ids, x = usable(rows)
    assert lists(neighbours.knn(df, df, 10, DIM, 2.5, SMALL)) == {i: l for i, l in brute(ids, x, 10, 2.5).items() if l}


UNITS = [grid.Settings(), grid.Settings(cell_rows=40, leaf=8), grid.Settings(cell_rows=100, most_rows=30, leaf=16)]


@pytest.mark.parametrize("settings", UNITS)
def test_pairs_within_cells_are_exact(spark, settings):
    """Items, copies of items and of vectors, a crowd of more than k near ones, in one cell, many, and cells of several units."""
    base = make(2, clusters=5, loners=60)
    rows = base + [(10_000 + 7 * i, base[i % 3][1]) for i in range(70)]
    df = items(spark, rows + rows[:90] + DIRT).repartition(5)
    ids, x = usable(rows)
    for k in (3, 10):
        got = neighbours.within(df, k, 2.5, DIM, settings).collect()
        assert len({(r["query_id"], r["base_id"]) for r in got}) == len(got) and max(r["rank"] for r in got) == k
        near = {}
        for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
            near.setdefault(r["query_id"], []).append(r["base_id"])
        assert near == {i: l for i, l in brute(ids, x, k, 2.5).items() if l}
    assert neighbours.within(df.limit(0), 10, 2.5, DIM, settings).count() == 0 and neighbours.within(df, 0, 2.5, DIM, settings).count() == 0


def test_pairs_are_found_without_moving_vectors(spark, data):
    """Whatever the number of cells, a vector is on disk once: no shuffle of the query has vectors, only pairs."""
    plan = queries.p5_found(spark, data)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert moved and not any(re.search(r"\bv#", columns) for columns in moved)


def test_small_and_empty_inputs(spark):
    df = items(spark, [(1, [1.0] * DIM), (2, [1.5] * DIM)])
    assert lists(neighbours.knn(df, df, 10, DIM)) == {1: [2], 2: [1]}
    assert neighbours.knn(df, df.limit(0), 10, DIM).count() == 0 and neighbours.knn(df, df, 0, DIM).count() == 0
    assert neighbours.knn(df.limit(0), df, 3, DIM).count() == 0


def test_tree_and_router_alone():
    r = np.random.default_rng(0)
    x = r.normal(size=(700, 6))
    tree = VpTree(x, np.arange(700), leaf=10)
    rows, found, d = tree.knn(x[:50], np.arange(50), 5, 1.0, np.full(50, np.inf))
    want = brute(np.arange(700), x, 5)
    assert [found[rows == i].tolist() for i in range(50)] == [want[i] for i in range(50)]
    router = Router(x, 16)
    assert router.shards == 16 and set(router.home(x)) == set(range(16))
    home = router.home(x)
    a, b = router.route(x, np.full(700, 0.3))
    assert {(i, home[i]) for i in range(700)} <= set(zip(a.tolist(), b.tolist()))
    same = Router(np.ones((50, 3)), 8)
    assert same.shards == 1 and VpTree(np.ones((50, 3)), np.arange(50), leaf=4).knn(np.ones((1, 3)), np.array([-1]), 3, 1.0, np.array([np.inf]))[1].tolist() == [0, 1, 2]


# ------------------------------------------------------------ clusters
def linked(ids, x, radius=2.5, least=5):
    root = list(range(len(ids)))

    def up(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(((x[i + 1 :] - x[i]) ** 2).sum(1) <= radius * radius) + i + 1:
            a, b = sorted((up(i), up(int(j))))
            root[b] = a
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(up(i), []).append(ids[i])
    return {(int(i), int(min(g))) for g in groups.values() if len(g) >= least for i in g}


def members(df):
    return {tuple(r) for r in df.collect()}


SPLIT = grid.Settings(cell_rows=40, most_rows=60, piece_rows=25, pivots=8, leaf=8)
CELLS = grid.Settings(cell_rows=10, leaf=4)


@pytest.mark.parametrize("settings", [grid.Settings(), SPLIT, CELLS])
def test_clusters_of_the_table(spark, real, settings):
    df, ids, x = real
    assert members(grid.cluster(df, 2.5, DIM, settings=settings)) == linked(ids, x)


@pytest.mark.parametrize("settings", [grid.Settings(), SPLIT, CELLS])
def test_clusters_of_all_sizes(spark, settings):
    rows = make(4, clusters=9, sizes=(4, 5, 6, 60))
    df = items(spark, rows + rows[:40] + DIRT)
    assert members(grid.cluster(df, 2.5, DIM, settings=settings)) == linked(*usable(rows))


def test_one_cluster_and_copies_hold_most_rows(spark):
    rows = make(5, clusters=3, loners=60, sizes=(5, 300, 8))
    rows += [(50_000 + i, rows[0][1]) for i in range(200)]
    assert members(grid.cluster(items(spark, rows), 2.5, DIM, settings=SPLIT)) == linked(*usable(rows))


@pytest.mark.parametrize("piece_rows", [20, 45])
def test_crowded_units_lose_nothing(spark, piece_rows):
    """Everything in one cell: a large cluster with small ones and loners beside it, by either way of the second pass."""
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(120, DIM)) * 0.2, *(r.normal(size=DIM) * 0.6 + r.normal(size=(5, DIM)) * 0.05 for _ in range(6)), r.normal(size=(30, DIM)) * 0.9]) + 1
    rows = [(int(i) + 1, v.tolist()) for i, v in enumerate(x[r.permutation(len(x))])]
    s = grid.Settings(most_rows=50, piece_rows=piece_rows, pivots=4)
    assert members(grid.cluster(items(spark, rows), 2.5, DIM, settings=s)) == linked(*usable(rows))


@pytest.mark.parametrize("rows", [1500, 6000])
def test_single_links_in_any_direction(spark, rows):
    """Chains of five held by single links of 2.4 to 2.5 in random directions: all found, however many cells, and split or not."""
    r = np.random.default_rng(rows)
    step = r.normal(size=(rows // 5, 5, DIM))
    step *= r.uniform(2.4, 2.4999, size=(rows // 5, 5, 1)) / np.linalg.norm(step, axis=2, keepdims=True)
    x = (r.normal(size=(rows // 5, 1, DIM)) * np.linspace(6, 2, DIM) + step.cumsum(1)).reshape(-1, DIM).astype(np.float32)
    ids = r.permutation(len(x)) + 1
    df = items(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)])
    want = linked(ids, x.astype(float))
    assert len(want) == rows
    for s in (grid.Settings(), grid.Settings(cell_rows=rows // 40, leaf=32), grid.Settings(cell_rows=rows // 4, most_rows=rows // 6, piece_rows=rows // 12, pivots=2)):
        assert members(grid.cluster(df, 2.5, DIM, settings=s)) == want


def test_guests_meet_every_link():
    """Of every linked pair in different cells one row is a guest in the other's cell, and only one."""
    r = np.random.default_rng(6)
    x = r.normal(size=(5000, DIM)) * np.linspace(3.3, 1.0, DIM)
    step = r.normal(size=x.shape)
    y = x + step / np.linalg.norm(step, axis=1)[:, None] * 2.5
    for n in (200_000, 2_000_000):
        q = grid.Quantiser(x, n, grid.Settings())
        (a, i, c), (b, j, d) = q.place(q.project(x), 2.5), q.place(q.project(y), 2.5)
        met = [k for k, cell in zip(i.tolist(), c) if cell == b[k]] + [k for k, cell in zip(j.tolist(), d) if cell == a[k]]
        assert sorted(met) == np.flatnonzero(a != b).tolist() and met


def test_clusters_move_no_vectors(spark):
    """However many cells a row is near to, shuffles hold links only: far fewer bytes than the vectors have."""
    r = np.random.default_rng(12)
    x = r.normal(size=(4000, DIM)).astype(np.float32) * np.linspace(3, 1, DIM, dtype=np.float32)
    df = items(spark, [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, x[:500] + np.float32(0.1)]))])

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        time.sleep(0.5)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    got = grid.cluster(df, 2.5, DIM, min_size=2, settings=grid.Settings(cell_rows=50, sample_rows=500, leaf=16))
    assert got.count() == 1000 and 0 < shuffled() - before < 4500 * DIM * 4 / 2


def test_long_chain(spark):
    step = np.zeros(DIM)
    step[0] = 2.4
    rows = [(i * 7 % 101 + 1, (np.ones(DIM) + step * i).tolist()) for i in range(60)]
    assert members(grid.cluster(items(spark, rows), 2.5, DIM)) == linked(*usable(rows))


def test_no_clusters(spark):
    df = items(spark, make(6, clusters=0, loners=30))
    assert grid.cluster(df, 2.5, DIM).count() == 0 and grid.cluster(df.limit(0), 2.5, DIM).count() == 0
    assert grid.describe(df, 2.5, DIM).count() == 0


def test_typical_members(spark, real):
    df, ids, x = real
    of = dict(linked(ids, x))
    rows = grid.describe(df, 2.5, DIM).collect()
    assert {r["cluster_id"] for r in rows} == set(of.values())
    for r in rows:
        assert of[r["vec_index"]] == r["cluster_id"] and r["size"] == sum(c == r["cluster_id"] for c in of.values()) and 1 <= r["rank"] <= 3


def test_labels_reach_every_end(spark):
    edges = [(i + 1, i) for i in range(200, 300)] + [(5, 900), (900, 2), (7, 7)]
    got = {r["id"]: r["label"] for r in grid.propagate(spark.createDataFrame(edges, "id bigint, root bigint")).collect()}
    assert all(got[i] == 200 for i in range(200, 301)) and got[5] == got[900] == got[2] == 2 and 7 not in got
    assert grid.propagate(spark.createDataFrame([], "id bigint, root bigint")).count() == 0


def test_components_exact():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(80, 4)) * 6, r.normal(size=(40, 4))])
    ids = np.arange(120) * 2
    got = grid.components(x, ids, 1.5, leaf=16)
    want = dict(linked(ids, x, 1.5, 1))
    assert [want[i] for i in ids.tolist()] == got.tolist()
