from quiverlake.operators.ivf import IvfIndex
from quiverlake.streaming import assign


def test_stream_joins_the_index(spark, tmp_path):
    points = spark.createDataFrame([(i, [float(i % 5), float(i)]) for i in range(60)], "vec_id bigint, embedding array<float>")
    index = IvfIndex.fit(points, 4, 2)
    new = spark.createDataFrame([(100, [0.0, 1.0]), (101, [4.0, 58.0]), (102, None)], "vec_id bigint, embedding array<float>")
    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    q = assign.append_lists(stream, index, str(tmp_path / "lists"), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination(60)
    more = assign.extended(index, str(tmp_path / "lists"))
    assert sum(more.sizes.values()) == 62
    asked = spark.createDataFrame([(1, [4.0, 58.1])], "query_id bigint, qv array<float>")
    assert 101 in {r["vec_id"] for r in more.search(asked, 2, 4).collect()}
