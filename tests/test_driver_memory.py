"""What the driver gets to hold doesn't grow with the rows."""

from pyspark.sql import functions as F

from orrery.operators import dedup as D
from orrery.operators.graph import components


def broadcasts(spark, run):
    """Rows broadcast by each query that ``run`` makes: (description of the final plan, whether it has a broadcast)."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    made = store.executionsList(int(before), 1000)
    return [made.apply(i).physicalPlanDescription() for i in range(made.size())]


def test_components_broadcast_nothing(spark):
    edges = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") + 1 - F.col("id") % 2).alias("b"))
    plans = broadcasts(spark, lambda: components(edges).collect())
    assert len(plans) > 3 and not [p for p in plans if "BroadcastExchange" in p]


def test_similar_groups_broadcast_segments_only(spark):
    df = spark.range(600).select(F.col("id").alias("k"), (F.xxhash64(F.col("id") % 400)).alias("h"), F.lit(1).alias("size"))
    plans = broadcasts(spark, lambda: D.similar_groups(df, "k", "h", "size", 18).collect())
    # segments have 16 values at most, so their counts are few rows for any input
    assert len(plans) > 3 and not [p for p in plans if "BroadcastExchange" in p and "_s#" not in p]
