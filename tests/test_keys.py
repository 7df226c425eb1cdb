"""Order keys stay unique for large supplier keys; the sweep's weight sets differ."""
from pyspark.sql import functions as F

from vendorlens.plans.scorecard import weight_sets
from vendorlens.sources.adapter import order_id


def test_order_ids_do_not_collide(spark):
    df = spark.createDataFrame([(1, 1_000_005), (2, 5)], "l_orderkey long, l_suppkey long")
    assert df.select(order_id().alias("k")).distinct().count() == 2


def test_weight_sets_are_distinct(spark):
    weights = [c for c in weight_sets(spark, 800).columns if c != "weight_id"]
    assert weight_sets(spark, 800).select(*weights).distinct().count() == 800
    assert weight_sets(spark, 800).where(sum(F.col(c) for c in weights) <= 0).count() == 0
