"""Queries of the loading operators: text lines that fail to parse, and drifting JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiverlake.session import table
from quiverlake.sources import drift
from quiverlake.sources.linefsm import split_lines

#: The table that all best_config records are read into.
BEST_CONFIG = {
    "params.NUM_CENTROIDS": "int",
    "params.KMEANS_ITER": "int",
    "params.NPROBE": "int",
    "recall": "double",
    "avg_query_time_ms": "double",
    "index_build_time_s": "double",
    "elapsed_s": "double",
    "objective": "double",
    "status": "string",
    "logfile": "string",
}
#: Approved: fields promoted from the rescue, each with its type and the other names it goes by.
APPROVED = {
    "params.NUM_CENTROIDS": ("int", ["params.NUM_CENTROID", "params.num_centroids"]),
    "params.KMEANS_ITER": ("int", ["params.KMEAN_ITER", "params.KMEANS_ITERS", "params.kmeans_iter", "params.kmeanIter"]),
    "params.NPROBE": ("int", ["params.NUM_PROBES", "params.nprob"]),
    "recall": ("double", ["recall_at_10", "avg_recall"]),
    "avg_query_time_ms": ("double", ["avg_time_ms", "query_ms"]),
    "index_build_time_s": ("double", ["index_build_s", "build_time_s", "indexBuildTime_s"]),
    "status": ("string", ["run_status"]),
    "params.METRIC": ("string", []),
    "params.TOL": ("double", []),
    "seed": ("bigint", ["params.SEED"]),
}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that fail to parse, with the reason."""
    return split_lines(table(spark, sf_dir, "vec_lines"))[1].select("line_id", "reason")


def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that parse: their id and vector."""
    return split_lines(table(spark, sf_dir, "vec_lines"), keep=("line_id", "src_file", "line_idx"))[0]


def p1_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed lines with the place of the error, in bytes from the line's start."""
    return split_lines(table(spark, sf_dir, "vec_lines"), keep=("line_id", "src_file", "line_idx", "raw_text"))[1]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a field between a file and the one before it."""
    return drift.changes(table(spark, sf_dir, "best_config"))


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records in one table: typed columns, approved fields promoted and replayed, the rest rescued."""
    out = drift.ingest(table(spark, sf_dir, "best_config"), BEST_CONFIG, ["rec_id", "series_name", "file_seq"])
    for path, (kind, others) in APPROVED.items():
        out = drift.promote(out, path, kind, others)
    return drift.finish(out)


QUERIES = {f.__name__: f for f in (p1_found, p1_loaded, p1_errors, p2_found, p2_table)}

_WS = r"[ \t\r\n\x0b\f]"
_NUMBER = r"""(regexp_full_match(t, '[+-]?(?i:nan|inf|infinity)') OR (regexp_full_match(t, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(isfinite(TRY_CAST(t AS DOUBLE)), false)))"""
_LINES = rf"""
WITH l AS (SELECT line_id, file_dim, coalesce(raw_text, '') AS x FROM vec_lines),
q AS (SELECT *, x LIKE '%"%' AS quoted, regexp_full_match(x, '{_WS}*"([^"]|"")*"({_WS}[^"]*)?') AS whole, regexp_extract(x, '^{_WS}*"([^"]|"")*"(({_WS}[^"]*)?)$', 2) AS rest FROM l),
t AS (SELECT *, list_filter(regexp_split_to_array(CASE WHEN quoted THEN rest ELSE x END, '{_WS}+'), lambda t: t <> '') AS ts FROM q),
n AS (SELECT *, list_transform(ts, lambda t: {_NUMBER}) AS num FROM t),
c AS (SELECT *, CASE WHEN NOT quoted AND len(num) > 0 AND NOT num[1] THEN num[2:] ELSE num END AS comp FROM n),
r AS (SELECT *, CASE WHEN regexp_full_match(x, '{_WS}*') THEN 'empty' WHEN quoted AND NOT whole THEN 'broken_quote' WHEN len(comp) <> file_dim THEN 'column_count' WHEN NOT list_bool_and(comp) THEN 'bad_value' END AS reason FROM c) """
_CHANGES = """
WITH b AS (SELECT DISTINCT series_name AS s, file_seq AS q, body FROM best_config),
f AS (SELECT s, q, dense_rank() OVER (PARTITION BY s ORDER BY q) AS r FROM (SELECT DISTINCT s, q FROM b)),
top AS (SELECT s, q, unnest(json_keys(body)) AS k, body FROM b),
inner_keys AS (SELECT s, q, unnest(json_keys(body, '$.params')) AS k, body FROM b),
e AS (SELECT s, q, k AS path, '' AS parent, json_type(body, '$."' || k || '"') AS t, json_extract_string(body, '$."' || k || '"') AS v, body FROM top WHERE k <> 'params'
 UNION ALL SELECT s, q, 'params.' || k, 'params', json_type(body, '$.params."' || k || '"'), NULL, body FROM inner_keys),
k AS (SELECT DISTINCT s, q, path, parent, CASE WHEN t IN ('UBIGINT', 'BIGINT', 'HUGEINT') THEN 'integer' WHEN t = 'DOUBLE' THEN 'double' WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t = 'ARRAY' THEN 'array' END AS t FROM e),
g AS (SELECT s, q, path, parent, CASE WHEN count(t) = 1 THEN max(t) WHEN count(t) = 2 AND min(t) = 'double' AND max(t) = 'integer' THEN 'double' WHEN count(t) > 1 THEN 'string' END AS t FROM k GROUP BY ALL),
h AS (SELECT g.*, f.r, f.r - row_number() OVER (PARTITION BY s, path ORDER BY f.r) AS stay FROM g JOIN f USING (s, q)),
y AS (SELECT s, q, r, path, parent, stay, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY s, path, stay ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(t IGNORE NULLS) OVER (PARTITION BY s, path, stay ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS t FROM h),
now AS (SELECT y.s, y.r, y.path, y.parent, y.t, p.t AS before, p.path AS was FROM y LEFT JOIN y p ON p.s = y.s AND p.path = y.path AND p.r = y.r - 1),
added AS (SELECT s, r, path, parent, t FROM now WHERE was IS NULL AND r > 1),
removed AS (SELECT y.s, y.r + 1 AS r, y.path, y.parent, y.t FROM y JOIN f n ON n.s = y.s AND n.r = y.r + 1 LEFT JOIN y z ON z.s = y.s AND z.path = y.path AND z.r = y.r + 1 WHERE z.path IS NULL),
one AS (SELECT s, r, parent, t, any_value(a.path) AS new_field FROM added a GROUP BY ALL HAVING count(*) = 1),
two AS (SELECT s, r, parent, t, any_value(d.path) AS old_field FROM removed d GROUP BY ALL HAVING count(*) = 1),
renamed AS (SELECT s, r, parent, t, old_field, new_field FROM one JOIN two USING (s, r, parent, t)),
every AS (SELECT s, r, 'renamed' AS change_kind, old_field, new_field FROM renamed
 UNION ALL SELECT s, r, 'added', '', path FROM added a WHERE NOT EXISTS (SELECT 1 FROM renamed n WHERE n.s = a.s AND n.r = a.r AND n.new_field = a.path)
 UNION ALL SELECT s, r, 'removed', path, '' FROM removed d WHERE NOT EXISTS (SELECT 1 FROM renamed n WHERE n.s = d.s AND n.r = d.r AND n.old_field = d.path)
 UNION ALL SELECT s, r, 'retyped', path, path FROM now WHERE was IS NOT NULL AND before <> t)
SELECT s AS series_name, f.q::INT AS file_seq, change_kind, old_field, new_field FROM every JOIN f USING (s, r)"""

# as _LINES, with the id and the components of lines that parse
_LOADED = (
    _LINES.replace("SELECT line_id, file_dim,", "SELECT line_id, src_file, line_idx, file_dim,", 1)
    + rf""", w AS (SELECT *, CASE WHEN quoted THEN replace(regexp_extract(x, '^{_WS}*"(([^"]|"")*)"', 1), '""', '"') WHEN NOT num[1] THEN ts[1] END AS id, CASE WHEN NOT quoted AND NOT num[1] THEN ts[2:] ELSE ts END AS fs FROM r WHERE reason IS NULL)
SELECT line_id, src_file, line_idx, id, list_transform(fs, lambda t: CASE WHEN regexp_matches(t, '(?i)nan') THEN 'nan'::DOUBLE WHEN regexp_matches(t, '(?i)inf') THEN (CASE WHEN t[1] = '-' THEN '-inf' ELSE 'inf' END)::DOUBLE ELSE TRY_CAST(t AS DOUBLE) END) AS v FROM w"""
)

SQL = {
    "p1_loaded": _LOADED,
    "p1_found": _LINES + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p2_found": _CHANGES,
}
