"""Fits of the learned models do not depend on the session's partitions."""

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from spillway.operators import learning, series


def test_fits_and_their_tasks_do_not_follow_the_shuffle_partitions(spark, monkeypatch):
    small = lambda seed=7: {"forest": RandomForestRegressor(featuresCol="x", labelCol="q", predictionCol="p", numTrees=4, minInstancesPerNode=3, seed=seed)}
    monkeypatch.setattr(learning, "models", small)
    got, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("4", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            made = series.synthetic(spark, 80, seed=3).withColumn("series_id", F.concat("series_id", (F.col("t") % 2).cast("string")))
            out = learning.forecasts(made, ("forest",), 2)
            assert learning._dealt(made, 2).rdd.getNumPartitions() == 1
            got.append(sorted(map(tuple, out.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and len(got[0]) == 44
