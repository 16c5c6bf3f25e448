from pyspark.sql import functions as F

from caliperlake import registry
from caliperlake.session import SETTINGS, prepared


def test_queries_set_what_they_need(spark):
    for name in SETTINGS:
        spark.conf.unset(name)
    registry.QUERIES["agg16_agg17_progress"](spark, "/root/testdata/sf0.001")
    assert {name: spark.conf.get(name) for name in SETTINGS} == SETTINGS


def test_a_union_of_sides_dealt_by_one_key_is_grouped_whole(spark):
    one = prepared(spark).range(4).select(F.lit(1).alias("k"), "id", (F.col("id") + 1).alias("next")).repartition("k").distinct()
    keys = one.select("k").distinct()
    near = one.join(keys, "k", "left_semi").distinct()
    both = near.unionByName(near.select("k", F.col("next").alias("id"), F.col("id").alias("next")))
    ranks = both.groupBy("k", "id").agg(F.count("*").alias("n"))
    got = both.join(ranks, ["k", "id"]).join(ranks.withColumnsRenamed({"id": "next", "n": "m"}), ["k", "next"]).orderBy("id", "next").collect()
    assert [(r.id, r.next) for r in got] == [(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3)]


def test_a_table_that_is_exploded_from_a_small_one_is_not_broadcast_by_its_estimate(spark):
    plan = registry.QUERIES["agg29_join27_watermarks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
