import json
import random

from quiverlake.__main__ import main


def test_from_text_to_recall(spark, tmp_path, capsys):
    r = random.Random(0)
    lines = [f"v{i} " + " ".join(f"{r.gauss(0, 1):.4f}" for _ in range(6)) for i in range(300)]
    lines[5] = "not a vector"
    base = tmp_path / "base.txt"
    base.write_text("\n".join(lines) + "\n")
    gt = tmp_path / "gt.json"
    main(["ground-truth", str(base), "--num", "20", "--out", str(gt)], spark)
    doc = json.loads(gt.read_text())
    assert doc["num_queries"] == 20 and all(q["neighbors"][0]["index"] == q["query_index"] for q in doc["results"])
    main(["evaluate", str(base), str(gt), "--n", "8", "--k", "2", "--p", "8"], spark)
    assert "Average recall@10: 1.0000" in capsys.readouterr().out
    main(["sweep", str(base), str(tmp_path / "runs"), "--n", "4", "--k", "1", "--p", "1", "4", "--num", "10"], spark)
    rows = spark.read.csv(str(tmp_path / "runs"), header=True).collect()
    assert {x["stamp"]: float(x["recall"]) for x in rows}["c4_i1_p4"] == 1.0
    main(["ground-truth", str(base), str(tmp_path / "no" / "x.txt"), "--num", "3"], spark)
    assert "base.txt.l2.gt.json" in capsys.readouterr().out


def test_report(spark, tmp_path, capsys):
    (tmp_path / "s.csv").write_text("STAMP,NUM_CENTROIDS,KMEANS_ITER,NPROBE,ELAPSED_s,RECALL,AVG_QUERY_TIME_ms,INDEX_BUILD_TIME_s\nc8_i1_p2,8,1,2,4,0.99,1.5,2\nc8_i1_p4,8,1,4,0,NA,NA,NA\n")
    main(["analyse", str(tmp_path / "s.csv")], spark)
    out = capsys.readouterr().out
    assert "Pareto front" in out and "c8_i1_p2" in out and "c8_i1_p4" not in out.split("By cells")[0]
