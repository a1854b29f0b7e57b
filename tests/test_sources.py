import json

import pytest

from quiverlake.operators import knn
from quiverlake.sources import ground_truth, runs, vector_text
from pyspark.sql import functions as F


def test_line_grammar(spark):
    cases = {
        "1 2 3": (None, [1, 2, 3]), "w1 1 2 3": ("w1", [1, 2, 3]), "7 1 2": (None, [7, 1, 2]), "w1": None, "w1 1 x": None, "": None, "   ": None, "1e-3 +2 -3.5": (None, [0.001, 2, -3.5]),
        "1d 2": ("1d", [2]), "0x10 2": (None, [16, 2]), "-0x10 2": (None, [-16, 2]), " \t a  1\t2 ": ("a", [1, 2]), "1e400 2": ("1e400", [2]), "inf -Infinity": (None, [float("inf"), float("-inf")]),
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,), ("nan 1",)], "line string")
    got = {r["line"]: r["p"] for r in df.select("line", vector_text.parse_vector_line(F.col("line")).alias("p")).collect()}
    for k, want in cases.items():
        assert (got[k] and (got[k]["id"], got[k]["vec"])) == want, k
    assert got[None] is None and got["nan 1"]["vec"][0] != got["nan 1"]["vec"][0]


def test_files_with_line_numbers(spark, tmp_path):
    lines = [f"v{i} {i} {i + 1} {i + 2}" for i in range(5000)]
    lines[7], lines[9] = "bad line x", "q 1 2"
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("1 2\n3 4\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {(r["file"][-5:], r["line_idx"]): r for r in vector_text.read_vectors(spark, str(tmp_path / "*.txt")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5000 - 2 + 2
    assert all(got["a.txt", i]["id"] == f"v{i}" for i in (0, 6, 8, 10, 4999)) and ("a.txt", 9) not in got
    assert got["b.txt", 1]["vec"] == [3.0, 4.0] and got["b.txt", 1]["id"] is None
    assert vector_text.read_vectors(spark, str(tmp_path / "a.txt"), max_base=10).count() == 8
    assert vector_text.read_vectors(spark, str(tmp_path / "none.txt")).count() == 0


def test_flat(spark):
    flat = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [1.0]), (3, None)], "k int, flat array<double>")
    assert [(r["k"], r["vec_id"], r["embedding"]) for r in vector_text.from_flat(flat, 2, keep=("k",)).collect()] == [(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0])]


def test_ground_truth_there_and_back(spark, tmp_path):
    p = spark.createDataFrame([(i, [float(i), 0.0], f'n"{i}') for i in range(8)], "vec_id bigint, embedding array<float>, id string")
    q = p.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    found = knn.knn_join(q, p, 4)
    doc = ground_truth.document(ground_truth.to_results(found, p), "d", "l2", 4)
    obj = json.loads(doc.head()["value"])
    assert obj["num_queries"] == 3 and obj["results"][0]["neighbors"][0] == {"index": 0, "id": 'n"0', "distance": 0.0}
    key = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], r["dist"]) for r in df.collect())
    assert key(ground_truth.parse(doc)) == key(found)
    (tmp_path / "gt.json").write_text(doc.head()["value"])
    assert key(ground_truth.read(spark, str(tmp_path / "gt.json"))) == key(found)


def test_ground_truth_of_the_other_writer(spark):
    text = '{"dataset":"s","metric":"l2","k":2,"results":[{"query_index":5,"query_id":"","neighbors":[{"index":5,"distance":0}]},{"query_index":6,"query_id":"","neighbors":[]},{"query_index":5,"query_id":"","neighbors":[{"index":7,"distance":1.5}]}]}'
    got = ground_truth.parse(spark.createDataFrame([(text,), ("{broken",), (None,)], "value string")).collect()
    assert [(r["query_id"], r["vec_id"], r["rank"], r["dist"]) for r in got] == [(5, 7, 1, 1.5)]


def test_errors_of_one_dataset_leave_the_others(spark):
    p = spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<float>")
    q = p.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    out, errors = ground_truth.compute({"ok": (q, p), "bad": (q, p.drop("embedding"))}, 1)
    assert out.count() == 1 and list(errors) == ["bad"]


LOG = "x\r 1/2\r 2/2\n=== Results ===\nTotal queries: 1000\nAverage recall@10: 0.9832\nAverage query time: 1.72 ms\nIndex build time: 6 seconds\n"


def test_logs(spark, tmp_path):
    (tmp_path / "run_c512_i16_p16.log").write_text(LOG + LOG.replace("0.9832", "0.1"))
    (tmp_path / "run_c64_i1_p2_g.log").write_text("Base: 5\nstart\n")
    got = {r["stamp"]: r for r in runs.read_logs(spark, str(tmp_path / "*.log")).collect()}
    assert (got["c512_i16_p16"]["recall"], got["c512_i16_p16"]["nprobe"], got["c512_i16_p16"]["complete"]) == (0.9832, 16, True)
    assert got["c64_i1_p2"]["recall"] is None and not got["c64_i1_p2"]["complete"]


def test_summary_lines(spark):
    lines = ["NUM_CENTROIDS=64 KMEANS_ITER=1 NPROBE=224 STATUS=OK ELAPSED=40s RECALL=0.9996 AVG_QUERY_TIME_ms=33.15 INDEX_BUILD_s=0", "NUM_CENTROIDS=8 KMEAN_ITER=2 NPROBE=3 STATUS=TIMEOUT_KILLED ELAPSED=9s RECALL=NA AVG_QUERY_TIME_ms=NA INDEX_BUILD_s=NA", "garbage"]
    got = sorted(runs.parse_summary(spark.createDataFrame([(x,) for x in lines], "value string")).collect(), key=lambda r: r["num_centroids"])
    assert len(got) == 2 and got[1]["elapsed_s"] == 40 and got[1]["recall"] == 0.9996 and got[0]["recall"] is None and got[0]["kmeans_iter"] == 2


@pytest.mark.parametrize("sep", [",", "\t"])
def test_csv_dialects(spark, tmp_path, sep):
    head = ["STAMP", " NUM_CENTROIDS", "KMEAN_ITER", "NPROBE", "STATUS", "ELAPSED_s", "RECALL", "AVG_QUERY_TIME_ms", "INDEX_BUILD_TIME_s"]
    (tmp_path / "s.csv").write_text(sep.join(head) + "\n" + sep.join(["c1_i2_p3", "1", "2", "3", "OK", "0", "NA", "1.5", "x"]) + "\n")
    r = runs.read_csv(spark, str(tmp_path / "s.csv")).head()
    assert (r["NUM_CENTROIDS"], r["KMEANS_ITER"], r["RECALL"], r["AVG_QUERY_TIME_ms"], r["INDEX_BUILD_TIME_s"]) == (1.0, 2.0, None, 1.5, None)
    (tmp_path / "bad.csv").write_text("a;b\n1;2\n")
    with pytest.raises(ValueError):
        runs.read_csv(spark, str(tmp_path / "bad.csv"))


def test_append_and_skip(spark, tmp_path):
    df = spark.createDataFrame([("c1_i1_p1", 1, 1, 1, 5, 0.5, None, 2.0)], "STAMP string, NUM_CENTROIDS int, KMEANS_ITER int, NPROBE int, ELAPSED_s int, RECALL double, AVG_QUERY_TIME_ms double, INDEX_BUILD_TIME_s double")
    runs.append_csv(df, str(tmp_path / "out"))
    runs.append_csv(df, str(tmp_path / "out"))
    back = runs.read_csv(spark, str(tmp_path / "out"))
    assert back.count() == 2 and back.head()["AVG_QUERY_TIME_ms"] is None and back.head()["RECALL"] == 0.5
    wanted = spark.createDataFrame([("c1_i1_p1",), ("c2_i1_p1",)], "stamp string")
    assert [r["stamp"] for r in runs.not_done(wanted, back.withColumnRenamed("STAMP", "stamp")).collect()] == ["c2_i1_p1"]
