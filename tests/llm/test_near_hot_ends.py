from pyspark.sql import functions as F

from quillfind.llm import near


def test_pairs_of_hot_ends_are_joined_once(spark, monkeypatch):
    monkeypatch.setattr(near, "GROUP", 10)
    ids = spark.range(200).select("id")
    # The smallest and the largest id have very many pairs, so both ends are dealt to groups.
    pairs = ids.filter("id > 0").select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).unionByName(ids.filter("id between 1 and 198").select(F.col("id").alias("a"), F.lit(199).cast("long").alias("b")))
    pairs = near.stored(pairs, "test-pairs")
    side = lambda end: spark.range(200).select(F.col("id").alias(end), (F.col("id") * 3).alias(f"x{end}"))
    both = near._with_sides(pairs, side("a"), side("b"))
    assert sorted(tuple(r) for r in both.select("a", "b", "xa", "xb").collect()) == sorted((r.a, r.b, 3 * r.a, 3 * r.b) for r in pairs.collect())
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [a#" in line and "b#" in line for line in plan.split("\n")) == 1
