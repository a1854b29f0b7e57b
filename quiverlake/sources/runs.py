"""Records of experiment runs: logs, summary lines, CSV in two dialects, best-configuration JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column names of the summary CSV, and the older form's further column.
CSV_COLUMNS = ("STAMP", "NUM_CENTROIDS", "KMEANS_ITER", "NPROBE", "ELAPSED_s", "RECALL", "AVG_QUERY_TIME_ms", "INDEX_BUILD_TIME_s")
STATUS = "STATUS"
METRICS = ("NUM_CENTROIDS", "KMEANS_ITER", "NPROBE", "ELAPSED_s", "RECALL", "AVG_QUERY_TIME_ms", "INDEX_BUILD_TIME_s")


def scrape(text: Column, label: str) -> Column:
    """The first number after ``label:`` in a log, null if there is none."""
    return F.nullif(F.regexp_extract(text, rf"{label}:\s*([-+0-9.eE]+)", 1), F.lit("")).try_cast("double")


def parse_logs(logs: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """``(stamp, num_centroids, kmeans_iter, nprobe, recall, avg_query_time_ms, index_build_time_s, complete)`` of run logs.

    The parameters come from the file name ``…c{C}_i{I}_p{P}…``; of several result blocks the first counts;
    what an unfinished log lacks is null.
    """
    part = lambda i: F.nullif(F.regexp_extract(F.col(name), r"c(\d+)_i(\d+)_p(\d+)", i), F.lit("")).try_cast("int")
    t = F.col(text)
    out = logs.select(
        F.nullif(F.regexp_extract(F.col(name), r"(c\d+_i\d+_p\d+)", 1), F.lit("")).alias("stamp"),
        part(1).alias("num_centroids"),
        part(2).alias("kmeans_iter"),
        part(3).alias("nprobe"),
        scrape(t, r"Average recall@\d+").alias("recall"),
        scrape(t, "Average query time").alias("avg_query_time_ms"),
        scrape(t, "Index build time").alias("index_build_time_s"),
    )
    return out.withColumn("complete", F.col("recall").isNotNull() & F.col("avg_query_time_ms").isNotNull())


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``parse_logs`` over log files; a file is one run."""
    return parse_logs(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text")))


def parse_summary(lines: DataFrame, column: str = "value") -> DataFrame:
    """Summary lines ``KEY=value KEY=value …`` as a row each; units after numbers are dropped, ``NA`` is null."""
    value = lambda *keys: F.nullif(F.regexp_extract(F.col(column), rf"(?:^|\s)(?:{'|'.join(keys)})=(\S*)", 1), F.lit(""))
    number = lambda kind, *keys: F.nullif(F.regexp_extract(value(*keys), r"^([-+0-9.eE]+)", 1), F.lit("")).try_cast(kind)
    rows = lines.where(F.col(column).rlike(r"(?:^|\s)NUM_CENTROIDS="))
    return rows.select(
        number("int", "NUM_CENTROIDS").alias("num_centroids"),
        number("int", "KMEANS_ITER", "KMEAN_ITER").alias("kmeans_iter"),
        number("int", "NPROBE").alias("nprobe"),
        value("STATUS").alias("status"),
        number("double", "ELAPSED").alias("elapsed_s"),
        number("double", "RECALL").alias("recall"),
        number("double", "AVG_QUERY_TIME_ms").alias("avg_query_time_ms"),
        number("double", "INDEX_BUILD_s", "INDEX_BUILD_TIME_s").alias("index_build_time_s"),
    )


def tidy(raw: DataFrame) -> DataFrame:
    """Trimmed column names, ``KMEAN_ITER`` spelt ``KMEANS_ITER``, numbers cast (``NA`` and rubbish become null)."""
    out = raw.withColumnsRenamed({c: c.strip() for c in raw.columns if c != c.strip()})
    if "KMEAN_ITER" in out.columns and "KMEANS_ITER" not in out.columns:
        out = out.withColumnRenamed("KMEAN_ITER", "KMEANS_ITER")
    return out.withColumns({c: F.trim(F.col(c).cast("string")).try_cast("double") for c in METRICS if c in out.columns})


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A run summary CSV, comma or tab separated, with or without the status column; an error if neither separator gives the columns."""
    for sep in (",", "\t"):
        raw = spark.read.csv(path, header=True, sep=sep)
        if {"STAMP", "RECALL"} <= {c.strip() for c in raw.columns}:
            return tidy(raw)
    raise ValueError(f"{path}: neither commas nor tabs give the columns STAMP and RECALL")


def append_csv(runs: DataFrame, path: str) -> None:
    """Appends runs in the CSV's columns; nulls are written ``NA``."""
    have = [c for c in CSV_COLUMNS if c in runs.columns]
    runs.select(*(F.col(c).cast("string").alias(c) for c in have)).write.mode("append").csv(path, header=True, nullValue="NA")


def not_done(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Configurations whose stamp has no record yet."""
    return wanted.join(done.select("stamp").distinct(), "stamp", "left_anti")


def best_config(runs: DataFrame) -> DataFrame:
    """``(value)``: the run of the highest recall (then the shortest query time, then the stamp) as JSON."""
    params = F.struct(F.col("num_centroids").alias("NUM_CENTROIDS"), F.col("kmeans_iter").alias("KMEAN_ITER"), F.col("nprobe").alias("NPROBE"))
    best = runs.where("recall IS NOT NULL").orderBy(F.desc("recall"), F.asc_nulls_last("avg_query_time_ms"), "stamp").limit(1)
    return best.select(F.to_json(F.struct(params.alias("params"), "recall", "avg_query_time_ms", "index_build_time_s", "status")).alias("value"))
