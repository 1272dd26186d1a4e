from quillfind.sources import datasets
from quillfind.streaming import index


def test_benchmark_layout(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "a", "title": "T", "text": "x"}\n{"_id": "b", "text": "y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q", "text": "x?"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq\ta\t1\nq\ta\t2\n")
    corpus, queries, qrels = datasets.load_dataset(spark, str(tmp_path))
    assert sorted(map(tuple, corpus.collect())) == [("a", "T", "x"), ("b", "", "y")]
    assert queries.first()["query_id"] == "q" and [tuple(r) for r in qrels.collect()] == [("q", "a", 2)]


def test_run_folder(spark, tmp_path):
    d = f"file://{tmp_path}/run"
    datasets.save_table(spark.createDataFrame([("p", "ndcg", 10, 0.5)], "pipeline string, metric string, k int, value double"), d, "metrics")
    datasets.save_json(spark, {"a": 1}, f"{d}/config.json")
    got = datasets.load_run(spark, d)
    assert set(got) == {"metrics", "config"} and got["config"] == {"a": 1} and got["metrics"].count() == 1


def test_stream_keeps_postings(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "doc_id long, title string, text string"
    spark.createDataFrame([(1, "", "cats cats dogs")], schema).write.parquet(source)
    stream = lambda: index.maintain(spark.readStream.schema(schema).parquet(source), target, f"{tmp_path}/ck").awaitTermination()
    stream()
    spark.createDataFrame([(2, "", "dogs")], schema).write.mode("append").parquet(source)
    stream()
    assert sorted((r["doc_id"], r["term"], r["tf"]) for r in index.read(spark, target).collect()) == [(1, "cat", 2), (1, "dog", 1), (2, "dog", 1)]
