"""Queries of the vector operators over ``embeddings``, and SQL that computes the same from scratch.

The query set of searches is every row whose id is divisible by 50.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.functions import vectors as V
from quiverlake.operators import graph, kmeans, knn, recall, sweep
from quiverlake.operators.ivf import IvfIndex
from quiverlake.session import shared_dir, table
from quiverlake.sources import ground_truth, vector_text

K, CELLS, ROUNDS, PROBES, SEED = 10, 16, 4, 12, 42  # 12 probes: recall of 0.9 and more
LONG_K = 200  # more than most cells hold, so that lists run short
GRID_CELLS, GRID_ROUNDS, GRID_PROBES = [8, 16, 32], [1, 2, 4], [1, 2, 4, 8]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def asked(p: DataFrame) -> DataFrame:
    return p.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


def rescaled(p: DataFrame) -> DataFrame:
    """Vectors of different lengths, so that cosine and L2 rank differently."""
    return p.select("vec_id", F.transform(V.doubles("embedding"), lambda x: x * (1 + F.col("vec_id") % 7)).alias("embedding"))


def r6(c: str):
    return (F.round(c, 6) + F.lit(0.0)).alias(c)


# ------------------------------------------------------------ scans and parsing
def vec_scan_dims(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))


def _rendered(p: DataFrame, prefix) -> DataFrame:
    return p.select("vec_id", F.concat(prefix, F.array_join(V.doubles("embedding").cast("array<string>"), " ")).alias("line"))


def _parsed(lines: DataFrame) -> DataFrame:
    out = lines.select("vec_id", vector_text.parse_vector_line(F.col("line")).alias("p"))
    total = F.aggregate("p.vec", F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", F.col("p.id").alias("id"), F.size("p.vec").alias("dim"), (F.round(total, 6) + F.lit(0.0)).alias("total"))


def parse_line_noid(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(_rendered(points(spark, d), F.lit("")))


def parse_line_with_id(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(_rendered(points(spark, d), F.concat(F.lit("w"), F.col("vec_id").cast("string"), F.lit(" "))))


def parse_line_reject(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document's text is a vector line."""
    docs = table(spark, d, "documents", spread=True).select("doc_id", vector_text.parse_vector_line(F.col("text")).alias("p"))
    return docs.select("doc_id", F.col("p").isNotNull().alias("accepted"), F.coalesce(F.size("p.vec"), F.lit(0)).alias("dim"))


def dim_filter(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "vec_items").where(F.size("v") == 48)
    return items.groupBy("dataset").agg(F.count("*").alias("n"), F.countDistinct("vec_index").alias("items"))


def flat_reshape(spark: SparkSession, d: str) -> DataFrame:
    flat = points(spark, d).select(F.col("vec_id").alias("flat_id"), F.col("embedding").alias("flat"))
    out = vector_text.from_flat(flat, 15, keep=("flat_id",))
    return out.select("flat_id", "vec_id", F.size("embedding").alias("dim"), (F.round(F.aggregate(V.doubles("embedding"), F.lit(0.0), lambda a, x: a + x), 6) + F.lit(0.0)).alias("total"))


def text_scan_file(spark: SparkSession, d: str) -> DataFrame:
    """The raw lines written as text files, one a source, and scanned again: each file's lines and their numbers."""
    lines = table(spark, d, "vec_lines").where("raw_text IS NOT NULL").select("src_file", F.translate("raw_text", "\r\n", "  ").alias("value"))
    path = f"{shared_dir(spark)}/ql-base-{uuid.uuid4().hex}"
    lines.repartition("src_file").write.partitionBy("src_file").text(path)
    found = vector_text.read_lines(spark, f"{path}/*/*").groupBy(F.regexp_extract("file", "src_file=([^/]+)/", 1).alias("src_file"))
    return found.agg(F.count("*").alias("n"), F.countDistinct("line_idx").alias("numbers"), F.max("line_idx").alias("last"))


def cache_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as text, scanned, cached as Parquet and read again, equal to the table's."""
    path = f"{shared_dir(spark)}/ql-text-{uuid.uuid4().hex}"
    _rendered(points(spark, d), F.concat(F.lit("w"), F.col("vec_id").cast("string"), F.lit(" "))).select("line").write.text(path)
    found = vector_text.write_cache(vector_text.read_vectors(spark, f"{path}/*.txt"), f"{path}.cache")
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return found.select("id", F.size("vec").alias("dim"), (F.round(total, 6) + F.lit(0.0)).alias("total"))


def gt_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    found = knn.knn_join(asked(points(spark, d)), points(spark, d), K)
    doc = ground_truth.document(ground_truth.to_results(found), "embeddings", "l2", K)
    return ground_truth.parse(doc).select("dataset", "metric", "query_id", "vec_id", "rank", r6("dist"))


# ------------------------------------------------------------ distances
def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each vector beside the next one."""
    p = points(spark, d)
    return p.join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


def dist_l2sq(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", V.l2sq("embedding", "other", 64).alias("dist")).select("vec_id", r6("dist"))


def dist_l2(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", V.l2("embedding", "other").alias("dist")).select("vec_id", r6("dist"))


def dist_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", V.cosine("embedding", "other").alias("dist")).select("vec_id", r6("dist"))


def dist_zero_norm(spark: SparkSession, d: str) -> DataFrame:
    zero = F.transform(V.doubles("embedding"), lambda x: x * 0)
    return points(spark, d).select("vec_id", V.cosine("embedding", zero).alias("dist")).select("vec_id", r6("dist"))


def dist_truncated_len(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", V.l2(F.slice("embedding", 1, 20), "other").alias("dist")).select("vec_id", r6("dist"))


def vec_norm(spark: SparkSession, d: str) -> DataFrame:
    return rescaled(points(spark, d)).select("vec_id", V.norm("embedding").alias("norm")).select("vec_id", r6("norm"))


# ------------------------------------------------------------ nearest neighbours
def sample_queries(spark: SparkSession, d: str) -> DataFrame:
    return knn.sample_queries(points(spark, d), 25, seed=1).select("query_id")


def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return knn.knn_join(asked(points(spark, d)), points(spark, d), K).select("query_id", "vec_id", "rank", r6("dist"), r6("dist_sq"))


def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    p = rescaled(points(spark, d))
    return knn.knn_join(asked(p), p, K, "cosine").select("query_id", "vec_id", "rank", F.greatest(F.round("dist", 6), F.lit(0.0)).alias("dist"))


def knn_max_base(spark: SparkSession, d: str) -> DataFrame:
    """The limit is half of the table's rows."""
    p = points(spark, d)
    return knn.knn_join(asked(p), p, K, max_base=p.count() // 2).select("query_id", "vec_id", "rank", r6("dist"))


def knn_global_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 closest pairs of a query and another row."""
    found = knn.knn_join(asked(points(spark, d)), points(spark, d), K, exclude_self=True)
    return knn.global_topk(found, 20).select("query_id", "vec_id", r6("dist"))


def knn_padded(spark: SparkSession, d: str) -> DataFrame:
    """Searches of one cell for more rows than most cells hold, filled up with -1."""
    q = asked(points(spark, d))
    ids = knn.padded(_index(spark, d).search(q, LONG_K, 1), q, LONG_K)
    return ids.select("query_id", F.posexplode("ids").alias("place", "vec_id"))


def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.knn_graph(points(spark, d), 8).select("src", "dst", r6("dist_sq"))


def knn_graph_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return graph.symmetric(graph.knn_graph(points(spark, d), 8)).select("src", "dst")


def graph_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.levels(points(spark, d)).groupBy("level").agg(F.count("*").alias("n"))


def beam_search(spark: SparkSession, d: str) -> DataFrame:
    from quiverlake.session import cut

    p = points(spark, d)
    edges = cut(graph.symmetric(graph.knn_graph(p, 8)), "graph")
    return graph.beam_search(edges, p, asked(p), p.where("vec_id % 100 = 7").select("vec_id"), K).select("query_id", "vec_id", "rank", r6("dist_sq"))


# ------------------------------------------------------------ k-means and the index
def _index(spark: SparkSession, d: str) -> IvfIndex:
    return IvfIndex.fit(points(spark, d), CELLS, ROUNDS, SEED)


def kmeans_init(spark: SparkSession, d: str) -> DataFrame:
    return kmeans.init(points(spark, d), CELLS, SEED).select("cid", "vec_id")


def kmeans_assign(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return kmeans.assign(p, kmeans.seeds(p, CELLS, SEED)).select("vec_id", "cid", r6("d2c"))


def _exploded(spark: SparkSession, centroids) -> DataFrame:
    return kmeans.as_frame(spark, centroids).select("cid", F.posexplode("cv").alias("pos", "x")).select("cid", "pos", r6("x"))


def kmeans_update(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return _exploded(spark, kmeans.update(p, kmeans.seeds(p, CELLS, SEED))[0])


def kmeans_fit_i4(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(spark, kmeans.fit(points(spark, d), CELLS, ROUNDS, SEED))


def kmeans_inertia(spark: SparkSession, d: str) -> DataFrame:
    rows = list(enumerate(kmeans.inertia_by_round(points(spark, d), CELLS, ROUNDS, SEED)))
    return spark.createDataFrame(rows, "round int, inertia double").select("round", r6("inertia"))


def ivf_lists(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).lists.select("cid", "vec_id", r6("d2c"))


def ivf_list_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).list_sizes()


def ivf_probe(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).probe(asked(points(spark, d)), PROBES).select("query_id", "cid", "probe_rank", r6("dc"))


def ivf_search(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search(asked(points(spark, d)), K, PROBES).select("query_id", "vec_id", "rank", r6("dist_sq"))


def ivf_search_full_probe(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search(asked(points(spark, d)), K, CELLS + 5).select("query_id", "vec_id", "rank", r6("dist_sq"))


def ivf_lower_bound(spark: SparkSession, d: str) -> DataFrame:
    """For how many of all pairs of a query and a row the bound holds, and the sums of bounds and distances."""
    both = _index(spark, d).lower_bounds(asked(points(spark, d)), CELLS)
    holds = F.count(F.when(F.col("bound_sq") <= F.col("dist_sq") + 1e-9, 1)).alias("holds")
    return both.agg(F.count("*").alias("n"), holds, F.sum("bound_sq").alias("bounds"), F.sum("dist_sq").alias("dists")).select("n", "holds", F.round("bounds", 4).alias("bounds"), F.round("dists", 4).alias("dists"))


def _searched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, d)
    return _index(spark, d).search(asked(p), K, PROBES), knn.knn_join(asked(p), p, K)


def recall_per_query(spark: SparkSession, d: str) -> DataFrame:
    return recall.recall_per_query(*_searched(spark, d), K).select("query_id", "hits", r6("recall"))


def recall_mean(spark: SparkSession, d: str) -> DataFrame:
    return recall.recall_summary(recall.recall_per_query(*_searched(spark, d), K)).select("queries", r6("mean_recall"), r6("min_recall"))


def recall_curve_nprobe(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return sweep.recall_by_probes(_index(spark, d), asked(p), knn.knn_join(asked(p), p, K), [1, 2, 4, 8, 16], K).select("nprobe", r6("recall"), r6("cost"))


def runs_grid(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return sweep.grid(p, asked(p), GRID_CELLS, GRID_ROUNDS, GRID_PROBES, K, SEED).select("stamp", "num_centroids", "kmeans_iter", "nprobe", r6("recall"), r6("cost"))


QUERIES = {
    f.__name__: f
    for f in (
        vec_scan_dims, parse_line_noid, parse_line_with_id, parse_line_reject, dim_filter, flat_reshape, text_scan_file, cache_roundtrip, gt_json_roundtrip,
        dist_l2sq, dist_l2, dist_cosine, dist_zero_norm, dist_truncated_len, vec_norm,
        sample_queries, knn_l2, knn_cosine, knn_max_base, knn_global_topk, knn_padded, knn_graph, knn_graph_symmetric, graph_levels, beam_search,
        kmeans_init, kmeans_assign, kmeans_update, kmeans_fit_i4, kmeans_inertia, ivf_lists, ivf_list_sizes, ivf_probe, ivf_search, ivf_search_full_probe, ivf_lower_bound,
        recall_per_query, recall_mean, recall_curve_nprobe, runs_grid,
    )
}

# ------------------------------------------------------------ SQL
_E = "e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS MATERIALIZED (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id % 50 = 0)"
_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_NEXT = "SELECT a.vec_id, a.v, b.v AS w FROM e a JOIN e b ON b.vec_id = a.vec_id + 1"
_NUM = r"regexp_full_match(t, '[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:nan|inf|infinity)|0[xX][0-9a-fA-F]{1,15})')"


def _d2(a: str, b: str) -> str:
    return _D2.format(a=a, b=b)


def _ranked(base: str = "e", k: int = K, where: str = "true") -> str:
    return f"SELECT query_id, vec_id, d2, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS r FROM (SELECT query_id, vec_id, {_d2('qv', 'v')} AS d2 FROM q, {base} WHERE {where}) QUALIFY r <= {k}"


def _lloyd(c: int, rounds: int, tag: str = "") -> list[str]:
    """CTEs of the centroids c0 … cI of Lloyd's rounds."""
    out = [f"c{tag}0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5('{SEED}:' || vec_id), vec_id) - 1 AS cid, v AS cv, vec_id AS seed_id FROM e QUALIFY cid < {c})"]
    for t in range(1, rounds + 1):
        out += [_assigned(f"a{tag}{t}", f"c{tag}{t - 1}")]
        out += [f"m{tag}{t} AS MATERIALIZED (SELECT cid, list(x ORDER BY pos) AS mv FROM (SELECT cid, pos, avg(x) AS x FROM (SELECT cid, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{tag}{t}) GROUP BY cid, pos) GROUP BY cid)"]
        out += [f"c{tag}{t} AS MATERIALIZED (SELECT c.cid, coalesce(m.mv, c.cv) AS cv FROM c{tag}{t - 1} c LEFT JOIN m{tag}{t} m USING (cid))"]
    return out


def _assigned(name: str, centroids: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT vec_id, v, cid, d2 FROM (SELECT vec_id, v, cid, {_d2('v', 'cv')} AS d2 FROM e, {centroids}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, cid) = 1)"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join([_E, *parts]) + " "


_IVF = [*_lloyd(CELLS, ROUNDS), _assigned("lists", f"c{ROUNDS}")]
_PROBE = f"probe AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dc, cid) AS pr FROM (SELECT query_id, qv, cid, {_d2('qv', 'cv')} AS dc FROM q, c{ROUNDS}))"


def _found(p: int, k: int = K) -> str:
    return f"found AS MATERIALIZED (SELECT query_id, vec_id, d2, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS r FROM (SELECT query_id, vec_id, {_d2('qv', 'v')} AS d2 FROM probe JOIN lists USING (cid) WHERE pr <= {p}) QUALIFY r <= {k})"


_TRUTH = f"truth AS MATERIALIZED ({_ranked()})"
_PER_QUERY = f"per AS (SELECT t.query_id, count(f.vec_id) AS hits, count(f.vec_id) / least({K}, count(*)) AS recall FROM truth t LEFT JOIN found f USING (query_id, vec_id) GROUP BY t.query_id)"


def _curve(tag: str, c: int, lists: str, centroids: str, probes: list[int]) -> list[str]:
    """CTE ``curve{tag}(nprobe, recall, cost)`` of one index."""
    ps = ", ".join(f"({p})" for p in probes)
    return [
        f"pr{tag} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dc, cid) AS pr FROM (SELECT query_id, qv, cid, {_d2('qv', 'cv')} AS dc FROM q, {centroids}))",
        f"sz{tag} AS (SELECT c.cid, count(l.vec_id) AS n FROM {centroids} c LEFT JOIN {lists} l USING (cid) GROUP BY c.cid)",
        f"cand{tag} AS MATERIALIZED (SELECT query_id, vec_id, pr, {_d2('qv', 'v')} AS d2 FROM pr{tag} JOIN {lists} USING (cid))",
        f"hit{tag} AS (SELECT nprobe, query_id, count(*) AS hits FROM (SELECT nprobe, query_id, vec_id FROM cand{tag}, (VALUES {ps}) p(nprobe) WHERE pr <= nprobe QUALIFY row_number() OVER (PARTITION BY nprobe, query_id ORDER BY d2, vec_id) <= {K}) JOIN truth USING (query_id, vec_id) GROUP BY ALL)",
        f"cost{tag} AS (SELECT nprobe, query_id, sum(n) + {c} AS cost FROM pr{tag} JOIN sz{tag} USING (cid), (VALUES {ps}) p(nprobe) WHERE pr <= nprobe GROUP BY ALL)",
        f"curve{tag} AS (SELECT nprobe, avg(coalesce(hits, 0) / {K}.0) AS recall, avg(cost) AS cost FROM cost{tag} LEFT JOIN hit{tag} USING (nprobe, query_id) GROUP BY nprobe)",
    ]


def _grid_sql() -> str:
    parts, rows = [_TRUTH], []
    for c in GRID_CELLS:
        parts += _lloyd(c, max(GRID_ROUNDS), f"k{c}_")
        for i in GRID_ROUNDS:
            tag = f"_{c}_{i}"
            parts += [_assigned(f"l{tag}", f"ck{c}_{i}"), *_curve(tag, c, f"l{tag}", f"ck{c}_{i}", GRID_PROBES)]
            rows.append(f"SELECT 'c{c}_i{i}_p' || nprobe AS stamp, {c}::INT AS num_centroids, {i}::INT AS kmeans_iter, nprobe::INT AS nprobe, round(recall, 6) AS recall, round(cost, 6) AS cost FROM curve{tag}")
    return _with(*parts) + " UNION ALL ".join(rows)


def _centroid_rows(name: str) -> str:
    return f"SELECT cid::INT AS cid, (pos - 1)::INT AS pos, round(x, 6) + 0.0 AS x FROM (SELECT cid, unnest(cv) AS x, generate_subscripts(cv, 1) AS pos FROM {name})"


SQL = {
    "vec_scan_dims": "SELECT len(embedding)::INT AS dim, count(*) AS n FROM embeddings GROUP BY 1",
    "parse_line_noid": _with() + "SELECT vec_id, NULL::VARCHAR AS id, len(v)::INT AS dim, round(list_sum(v), 6) + 0.0 AS total FROM e",
    "parse_line_with_id": _with() + "SELECT vec_id, 'w' || vec_id AS id, len(v)::INT AS dim, round(list_sum(v), 6) + 0.0 AS total FROM e",
    "parse_line_reject": rf"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\r\n\x0b\f]+'), lambda x: x <> '') AS ts FROM documents),
n AS (SELECT doc_id, len(ts) AS k, list_transform(ts, lambda t: {_NUM}) AS num FROM t),
a AS (SELECT doc_id, k, k > 0 AND list_bool_and(num) AS whole, k > 1 AND list_bool_and(num[2:]) AS named FROM n)
SELECT doc_id, coalesce(whole OR named, false) AS accepted, (CASE WHEN whole THEN k WHEN named THEN k - 1 ELSE 0 END)::INT AS dim FROM a""",
    "dim_filter": "SELECT dataset, count(*) AS n, count(DISTINCT vec_index) AS items FROM vec_items WHERE len(v) = 48 GROUP BY dataset",
    "flat_reshape": _with() + "SELECT vec_id AS flat_id, i AS vec_id, 15::INT AS dim, round(list_sum(v[i * 15 + 1 : i * 15 + 15]), 6) + 0.0 AS total FROM e, range(4) r(i)",
    "text_scan_file": "SELECT src_file, count(*) AS n, count(*) AS numbers, count(*) - 1 AS last FROM vec_lines WHERE raw_text IS NOT NULL GROUP BY 1",
    "cache_roundtrip": _with() + "SELECT 'w' || vec_id AS id, len(v)::INT AS dim, round(list_sum(v), 6) + 0.0 AS total FROM e",
    "gt_json_roundtrip": _with() + f"SELECT 'embeddings' AS dataset, 'l2' AS metric, query_id, vec_id, r::INT AS rank, round(sqrt(d2), 6) AS dist FROM ({_ranked()})",
    "dist_l2sq": _with() + f"SELECT vec_id, round({_d2('v', 'w')}, 6) AS dist FROM ({_NEXT})",
    "dist_l2": _with() + f"SELECT vec_id, round(list_distance(v, w), 6) AS dist FROM ({_NEXT})",
    "dist_cosine": _with() + f"SELECT vec_id, round(list_cosine_distance(v, w), 6) AS dist FROM ({_NEXT})",
    "dist_zero_norm": "SELECT vec_id, 1.0::DOUBLE AS dist FROM embeddings",
    "dist_truncated_len": _with() + f"SELECT vec_id, round(list_distance(v[1:20], w[1:20]), 6) AS dist FROM ({_NEXT})",
    "vec_norm": _with() + "SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x * (1 + vec_id % 7) * (1 + vec_id % 7)))), 6) AS norm FROM e",
    "sample_queries": "SELECT vec_id AS query_id FROM embeddings ORDER BY md5('1:' || vec_id), vec_id LIMIT 25",
    "knn_l2": _with() + f"SELECT query_id, vec_id, r::INT AS rank, round(sqrt(d2), 6) AS dist, round(d2, 6) AS dist_sq FROM ({_ranked()})",
    "knn_cosine": "WITH e AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 7)) AS v FROM embeddings), d AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_distance(a.v, b.v) AS d FROM e a, e b WHERE a.vec_id % 50 = 0) SELECT query_id, vec_id, (row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id))::INT AS rank, greatest(round(d, 6), 0.0) AS dist FROM d QUALIFY rank <= 10",
    "knn_max_base": _with() + f"SELECT query_id, vec_id, r::INT AS rank, round(sqrt(d2), 6) AS dist FROM ({_ranked(where='vec_id < (SELECT count(*) // 2 FROM e)')})",
    "knn_global_topk": _with() + f"SELECT query_id, vec_id, round(sqrt(d2), 6) AS dist FROM ({_ranked(where='vec_id <> query_id')}) ORDER BY d2, query_id, vec_id LIMIT 20",
    "knn_padded": _with(*_IVF, _PROBE, _found(1, LONG_K)) + f"SELECT query_id, place::INT AS place, coalesce(n.vec_id, -1) AS vec_id FROM (SELECT query_id, place FROM q, range({LONG_K}) p(place)) LEFT JOIN (SELECT query_id, r - 1 AS place, vec_id FROM found) n USING (query_id, place)",
    "knn_graph": "WITH e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.v, b.v) AS d FROM e a, e b WHERE a.vec_id <> b.vec_id) SELECT src, dst, round(d * d, 6) AS dist_sq FROM d QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 8",
    "knn_graph_symmetric": "WITH e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.v, b.v) AS d FROM e a, e b WHERE a.vec_id <> b.vec_id), g AS (SELECT src, dst FROM d QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 8) SELECT src, dst FROM g UNION SELECT dst, src FROM g",
    "graph_levels": "SELECT least(greatest(floor(-ln((CAST('0x' || substr(md5('42:' || vec_id), 1, 13) AS BIGINT) + 1) / 4503599627370496.0) / ln(10.0)), 0), 100)::INT AS level, count(*) AS n FROM embeddings GROUP BY 1",
    "kmeans_init": _with(*_lloyd(CELLS, 0)) + "SELECT cid::INT AS cid, seed_id AS vec_id FROM c0",
    "kmeans_assign": _with(*_lloyd(CELLS, 0), _assigned("a", "c0")) + "SELECT vec_id, cid::INT AS cid, round(d2, 6) AS d2c FROM a",
    "kmeans_update": _with(*_lloyd(CELLS, 1)) + _centroid_rows("c1"),
    "kmeans_fit_i4": _with(*_lloyd(CELLS, ROUNDS)) + _centroid_rows(f"c{ROUNDS}"),
    "kmeans_inertia": _with(*_lloyd(CELLS, ROUNDS), _assigned(f"a{ROUNDS + 1}", f"c{ROUNDS}")) + " UNION ALL ".join(f"SELECT {t - 1}::INT AS round, round(sum(d2), 6) AS inertia FROM a{t}" for t in range(1, ROUNDS + 2)),
    "ivf_lists": _with(*_IVF) + "SELECT cid::INT AS cid, vec_id, round(d2, 6) AS d2c FROM lists",
    "ivf_list_sizes": _with(*_IVF) + f"SELECT c.cid::INT AS cid, count(l.vec_id) AS n FROM c{ROUNDS} c LEFT JOIN lists l USING (cid) GROUP BY c.cid",
    "ivf_probe": _with(*_IVF, _PROBE) + f"SELECT query_id, cid::INT AS cid, pr::INT AS probe_rank, round(dc, 6) AS dc FROM probe WHERE pr <= {PROBES}",
    "ivf_search": _with(*_IVF, _PROBE, _found(PROBES)) + "SELECT query_id, vec_id, r::INT AS rank, round(d2, 6) AS dist_sq FROM found",
    "ivf_search_full_probe": _with() + f"SELECT query_id, vec_id, r::INT AS rank, round(d2, 6) AS dist_sq FROM ({_ranked()})",
    "ivf_lower_bound": _with(*_IVF, _PROBE) + f", b AS (SELECT pow(sqrt(dc) - sqrt(d2), 2) AS b2, {_d2('qv', 'v')} AS x2 FROM probe JOIN lists USING (cid)) SELECT count(*) AS n, count(*) FILTER (WHERE b2 <= x2 + 1e-9) AS holds, round(sum(b2), 4) AS bounds, round(sum(x2), 4) AS dists FROM b",
    "recall_per_query": _with(*_IVF, _PROBE, _found(PROBES), _TRUTH, _PER_QUERY) + "SELECT query_id, hits, round(recall, 6) AS recall FROM per",
    "recall_mean": _with(*_IVF, _PROBE, _found(PROBES), _TRUTH, _PER_QUERY) + "SELECT count(*) AS queries, round(avg(recall), 6) AS mean_recall, round(min(recall), 6) AS min_recall FROM per",
    "recall_curve_nprobe": _with(_TRUTH, *_IVF, *_curve("", CELLS, "lists", f"c{ROUNDS}", [1, 2, 4, 8, 16])) + "SELECT nprobe::INT AS nprobe, round(recall, 6) AS recall, round(cost, 6) AS cost FROM curve",
    "runs_grid": _grid_sql(),
}
