from pathlib import Path

from pyspark.sql import functions as F


def test_python_function_over_the_context_prefix_is_evaluated(spark):
    from quillfind.functions import text as T

    long = " ".join(f"w{i}" for i in range(150))
    rows = spark.createDataFrame([(1, "", "One here. Two."), (2, None, None), (3, long, "x"), (4, "a title", "x")], "id int, title string, text string")
    size = F.udf(lambda s: len(s), "int")
    prefixed = rows.select("id", T.context_prefix(F.col("title"), F.col("text")).alias("c"))
    got = {r.id: r.c for r in prefixed.collect()}
    assert [got[k] for k in (1, 2, 4)] == ["Document begins: One here.", "Document begins: .", "Document title: a title."]
    assert got[3] == "Document title: " + " ".join(long.split()[:98]) + "..."
    assert {r.id: r.n for r in prefixed.select("id", size("c").alias("n")).collect()} == {k: len(c) for k, c in got.items()}


def test_contextual_dense_is_as_its_sql(spark, sf):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for path in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    want = sorted(con.execute(entry.oracle_sql()["contextual_dense"]).fetchall())
    got = sorted(tuple(r) for r in entry.queries()["contextual_dense"](spark, sf).collect())
    assert len(got) == len(want) and [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want]
    assert all(abs(a[2] - b[2]) < 1e-6 for a, b in zip(got, want))
