"""Named queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.functions.vectors import unsigned_zeros
from quiverlake.llm import grid, leakage, neighbours, pii, sample, tokens
from quiverlake.session import table

DIM = 48
SAMPLE_SIZE, SAMPLE_SEED = 1000, 42


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of sets of at least 5 items connected by links of at most 2.5."""
    return grid.cluster(table(spark, sf_dir, "vec_items", spread=True), 2.5, DIM)


def p3_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical members of every cluster."""
    return grid.describe(table(spark, sf_dir, "vec_items", spread=True), 2.5, DIM)


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform sample of the usable items: index and random key."""
    return sample.draw(table(spark, sf_dir, "vec_items"), SAMPLE_SIZE, SAMPLE_SEED, DIM).select("vec_index", "sample_key")


def p4_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled items with their vectors, zeros without a sign as in the SQL."""
    items = sample.draw(table(spark, sf_dir, "vec_items"), SAMPLE_SIZE, SAMPLE_SEED, DIM)
    return items.select("vec_index", unsigned_zeros("v").alias("v"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items within 2.5 of each other, each among the other's 10 nearest."""
    items = table(spark, sf_dir, "vec_items", spread=True)
    return neighbours.mutual_pairs(neighbours.within(items, 10, 2.5, DIM))


def p5_heaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other items of every item whose index is divisible by 50, however far."""
    items = table(spark, sf_dir, "vec_items", spread=True)
    found = neighbours.knn(items.where("vec_index % 50 = 0"), items, 10, DIM, settings=neighbours.Settings(relax=1.0))
    return found.select("query_id", "base_id", F.round("dist_sq", 6).alias("dist_sq"), "rank")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, sf_dir, "documents", spread=True))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the token ids decode to."""
    return tokens.decode(p6_ids(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items of which they hold at least 12 consecutive units."""
    return leakage.leaks(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "eval_items"))


def p7_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents close to an evaluation item without such a stretch: cosine, common subsequence, answer figures."""
    return leakage.paraphrases(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal information in the documents: kind and place."""
    return pii.occurrences(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "name_parts"))


def p8_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with typed placeholders."""
    return pii.masked(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "name_parts"))


_QUERIES = (p3_found, p3_typical, p4_sample, p4_items, p5_found, p5_heaps, p6_ids, p6_decoded, p7_found, p7_paraphrases, p8_found, p8_masked)

_USABLE = f"vec_index IS NOT NULL AND v IS NOT NULL AND len(v) = {DIM} AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(v, lambda x: x <> 0))"


def _components_sql(rounds: int = 12) -> str:
    """Members of clusters: all links by brute force, then the minimum label over neighbours, round by round."""
    parts = [
        f"i AS MATERIALIZED (SELECT vec_index, any_value(v)::DOUBLE[] AS v FROM vec_items WHERE {_USABLE} GROUP BY vec_index)",
        "e AS MATERIALIZED (SELECT a.vec_index AS a, b.vec_index AS b FROM i a, i b WHERE list_distance(a.v, b.v) <= 2.5)",
        "l0 AS MATERIALIZED (SELECT a, min(b) AS l FROM e GROUP BY a)",
    ]
    parts += [f"l{t} AS MATERIALIZED (SELECT e.a, min(l.l) AS l FROM e JOIN l{t - 1} l ON l.a = e.b GROUP BY e.a)" for t in range(1, rounds + 1)]
    return "WITH " + ", ".join(parts) + f" SELECT a AS vec_index, l AS cluster_id FROM l{rounds} QUALIFY count(*) OVER (PARTITION BY l) >= 5"


_SQL = {
    "p4_sample": f"""
WITH items AS (SELECT DISTINCT vec_index FROM vec_items WHERE {_USABLE}),
keys AS (SELECT vec_index, CAST('0x' || substr(md5('{SAMPLE_SEED}:' || vec_index), 1, 15) AS BIGINT) AS sample_key FROM items)
SELECT vec_index, sample_key FROM keys ORDER BY sample_key, vec_index LIMIT {SAMPLE_SIZE}""",
    "p4_items": f"""
WITH items AS (SELECT vec_index, any_value(v) AS v FROM vec_items WHERE {_USABLE} GROUP BY vec_index)
SELECT vec_index, v FROM items ORDER BY CAST('0x' || substr(md5('{SAMPLE_SEED}:' || vec_index), 1, 15) AS BIGINT), vec_index LIMIT {SAMPLE_SIZE}""",
    "p5_heaps": f"""
WITH i AS MATERIALIZED (SELECT vec_index, any_value(v)::DOUBLE[] AS v FROM vec_items WHERE {_USABLE} GROUP BY vec_index),
d AS (SELECT a.vec_index AS query_id, b.vec_index AS base_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM i a, i b WHERE a.vec_index % 50 = 0 AND a.vec_index <> b.vec_index)
SELECT query_id, base_id, round(d2, 6) AS dist_sq, (row_number() OVER (PARTITION BY query_id ORDER BY d2, base_id))::INT AS rank FROM d QUALIFY rank <= 10""",
    "p3_found": _components_sql(),
    "p5_found": f"""
WITH i AS MATERIALIZED (SELECT vec_index, any_value(v)::DOUBLE[] AS v FROM vec_items WHERE {_USABLE} GROUP BY vec_index),
p AS MATERIALIZED (SELECT a.vec_index AS a, b.vec_index AS b, list_distance(a.v, b.v) AS d FROM i a JOIN i b ON a.vec_index < b.vec_index AND abs(a.v[1] - b.v[1]) <= 2.5 WHERE d <= 2.5),
n AS MATERIALIZED (SELECT a, b FROM (SELECT a, b, d FROM p UNION ALL SELECT b, a, d FROM p) QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 10)
SELECT x.a AS index_a, x.b AS index_b FROM n x JOIN n y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
