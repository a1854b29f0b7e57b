"""Command line: ``python -m quiverlake ground-truth | evaluate | sweep | analyse``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.operators import analysis, knn, recall, sweep
from quiverlake.operators.ivf import IvfIndex
from quiverlake.session import local_session
from quiverlake.sources import ground_truth, runs, vector_text


def _points(spark: SparkSession, base: str, cache: bool = False) -> DataFrame:
    """Vectors of a text file with the line number as id; with ``cache`` by way of a Parquet copy beside it."""
    parsed = vector_text.read_vectors(spark, base)
    rows = parsed.select(F.col("line_idx").alias("vec_id"), "id", F.col("vec").cast("array<float>").alias("embedding"))
    return vector_text.write_cache(rows, f"{base}.parquet") if cache else rows


def make_ground_truth(spark: SparkSession, args: argparse.Namespace) -> None:
    """Exact neighbours of sampled queries for each base file; a file that fails is reported and the others go on."""
    for base in args.base:
        try:
            p = _points(spark, base)
            q = knn.sample_queries(p, args.num, args.seed)
            found = knn.knn_join(q, p, args.k, args.metric, args.max_base)
            out = f"{base}.{args.metric}.gt.json" if len(args.base) > 1 or not args.out else args.out
            document = ground_truth.document(ground_truth.to_results(found, p), base, args.metric, args.k)
            with open(out, "w", encoding="utf-8") as f:
                f.write(document.head()["value"])
            print(f"{base}: {out}")
        except Exception as e:  # one file's failure is reported
            print(f"{base}: failed: {str(e).splitlines()[0]}")


def _asked(spark: SparkSession, points: DataFrame, truth: DataFrame) -> DataFrame:
    """Ground-truth queries with their vectors, by line number."""
    return truth.select("query_id").distinct().join(points, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("qv"))


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    points = _points(spark, args.base, cache=True).cache()
    truth = ground_truth.read(spark, args.truth).cache()
    asked = _asked(spark, points, truth).cache()
    n = asked.count()
    began = time.perf_counter()
    index = IvfIndex.fit(points, args.n, args.k, args.seed)
    built = time.perf_counter() - began
    began = time.perf_counter()
    found = index.search(asked, 10, args.p).cache()
    found.count()
    took = (time.perf_counter() - began) * 1000 / max(n, 1)
    mean = recall.recall_summary(recall.recall_per_query(found, truth, 10)).head()["mean_recall"]
    print(f"=== Results ===\nTotal queries: {n}\nAverage recall@10: {mean:.4f}\nAverage query time: {took:.2f} ms\nIndex build time: {int(built)} seconds")


def run_sweep(spark: SparkSession, args: argparse.Namespace) -> None:
    points = _points(spark, args.base, cache=True).cache()
    asked = knn.sample_queries(points, args.num, args.seed)
    out = sweep.grid(points, asked, args.n, args.k, args.p, 10, args.seed)
    out.orderBy("num_centroids", "kmeans_iter", "nprobe").coalesce(1).write.mode("overwrite").csv(args.out, header=True)


def analyse(spark: SparkSession, args: argparse.Namespace) -> None:
    raw = runs.read_csv(spark, args.summary)
    lower = {c: c.lower() for c in raw.columns}
    table = analysis.clean(raw.withColumnsRenamed(lower), "status" if "status" in lower.values() else None)
    ok = analysis.with_derived(analysis.succeeded(table)).cache()
    ties = [c for c in analysis.KEYS if c in ok.columns]
    for title, df in (
        ("Best by recall", analysis.top(ok, "recall", args.top, ties)),
        ("Best by recall a second", analysis.top(ok, "recall_per_sec", args.top, ties)),
        ("By cells, rounds and probes", analysis.group_stats(ok).orderBy(F.desc("recall_mean"))),
        ("Pareto front", analysis.pareto(ok, "recall", "avg_query_time_ms").orderBy("avg_query_time_ms")),
        ("High recall", analysis.describe(analysis.high_recall(ok), "avg_query_time_ms", "index_build_time_s")),
    ):
        print(title)
        df.show(args.top, truncate=False)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quiverlake", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("ground-truth")
    g.add_argument("base", nargs="+")
    g.add_argument("--num", type=int, default=1000)
    g.add_argument("--k", type=int, default=10)
    g.add_argument("--metric", choices=("l2", "cosine"), default="l2")
    g.add_argument("--max_base", type=int)
    g.add_argument("--seed", type=int, default=1)
    g.add_argument("--out")
    g.set_defaults(run=make_ground_truth)
    e = sub.add_parser("evaluate")
    e.add_argument("base")
    e.add_argument("truth")
    e.add_argument("--n", type=int, default=2308, help="cells")
    e.add_argument("--k", type=int, default=16, help="k-means rounds")
    e.add_argument("--p", type=int, default=37, help="probed cells")
    e.add_argument("--seed", type=int, default=42)
    e.set_defaults(run=evaluate)
    s = sub.add_parser("sweep")
    s.add_argument("base")
    s.add_argument("out")
    for flag in ("--n", "--k", "--p"):
        s.add_argument(flag, type=int, nargs="+", required=True)
    s.add_argument("--num", type=int, default=1000)
    s.add_argument("--seed", type=int, default=42)
    s.set_defaults(run=run_sweep)
    a = sub.add_parser("analyse")
    a.add_argument("summary")
    a.add_argument("--top", type=int, default=20)
    a.set_defaults(run=analyse)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.getActiveSession() or local_session(), args)


if __name__ == "__main__":
    main()
