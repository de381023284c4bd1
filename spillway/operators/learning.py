"""Tree and linear regressors on lag features, by Spark's own library, over expanding time splits."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import folds, lag_features, scores

#: Rows of a partition of the training data, and fits that are under way at once.
ROWS, AT_ONCE = 50_000, 10


def models(seed: int = 7) -> dict[str, object]:
    own = {"featuresCol": "x", "labelCol": "q", "predictionCol": "p"}
    return {
        "linear": LinearRegression(**own, solver="normal"),
        "ridge": LinearRegression(**own, regParam=1.0, elasticNetParam=0.0, solver="normal"),
        "forest": RandomForestRegressor(**own, numTrees=400, minInstancesPerNode=3, seed=seed),
        "boosting": GBTRegressor(**own, maxIter=300, stepSize=0.05, maxDepth=2, subsamplingRate=0.8, seed=seed),
    }


def _dealt(series: DataFrame, k: int) -> DataFrame:
    """The rows of all folds, cached in as few partitions as they fill, dealt and sorted by their keys.

    A boosted fit is hundreds of small jobs with a task for each partition, mostly empty ones if there are as many as the
    session's shuffles have; and trees draw their samples by partition, so the fits do not depend on the session.
    """
    data = folds(lag_features(series), k)
    parts = max(1, -(-data.count() // ROWS))
    return data.repartition(parts, "series_id", "t").sortWithinPartitions("series_id", "t", "fold").cache()


def _fits(data: DataFrame, names: tuple[str, ...], k: int) -> list[tuple[str, int, PipelineModel]]:
    """Each model fitted on each fold's training rows over all series together; several fits are under way at once."""
    columns = [c for c in data.columns if c not in ("series_id", "t", "q", "fold", "role")]

    def fit(one: tuple[str, int]) -> tuple[str, int, PipelineModel]:
        name, fold = one
        steps = [VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), models()[name]]
        return name, fold, Pipeline(stages=steps).fit(data.filter((F.col("fold") == fold) & (F.col("role") == "train")))

    asked = [(name, fold) for name in names for fold in range(k)]
    with ThreadPool(max(1, min(AT_ONCE, len(asked)))) as pool:
        return pool.map(inheritable_thread_target(data.sparkSession)(fit), asked, chunksize=1)


def forecasts(series: DataFrame, names: tuple[str, ...] = ("linear", "ridge", "forest", "boosting"), k: int = 5) -> DataFrame:
    """Out-of-fold predictions of each model, fitted over all series together; the driver loops over models and folds only."""
    data = _dealt(series, k)
    out = []
    for name, fold, fitted in _fits(data, names, k):
        test = data.filter((F.col("fold") == fold) & (F.col("role") == "test"))
        out.append(fitted.transform(test).select("series_id", "t", F.lit(name).alias("model"), F.lit(fold).alias("fold"), F.col("q").alias("y"), "p", F.col("lag_1").alias("baseline")))
    return reduce(DataFrame.unionByName, out)


def importances(series: DataFrame, names: tuple[str, ...] = ("forest", "boosting"), k: int = 5) -> DataFrame:
    """model, fold, feature, importance of the tree models' fits; the mean by feature ranks them."""
    data = _dealt(series, k)
    columns = [c for c in data.columns if c not in ("series_id", "t", "q", "fold", "role")]
    rows = [(name, fold, c, float(v)) for name, fold, fitted in _fits(data, names, k) for c, v in zip(columns, fitted.stages[-1].featureImportances.toArray(), strict=True)]
    data.unpersist()
    return series.sparkSession.createDataFrame(rows, "model string, fold int, feature string, importance double")


def mean_importance(found: DataFrame, model: str = "forest") -> DataFrame:
    return found.filter(F.col("model") == model).groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature")


def best(table: DataFrame) -> DataFrame:
    """The model of least root mean square error among those that beat persistence; no row if none does."""
    return table.filter("skill > 0 and model <> 'persistence'").orderBy("rmse", "model").limit(1)


def score_table(predictions: DataFrame) -> DataFrame:
    """Scores per model over all series and persistence as a row of its own, the best root mean square error first."""
    one = predictions.select(F.col("model").alias("series_id"), "y", "p", "baseline")
    first = predictions.agg(F.min("model").alias("_m"))  # persistence is judged on one model's rows: all models have the same
    same = predictions.join(F.broadcast(first), F.col("model") == F.col("_m")).select(F.lit("persistence").alias("series_id"), "y", F.col("baseline").alias("p"), "baseline")
    s = scores(one.unionByName(same)).withColumnRenamed("series_id", "model")
    return s.orderBy("rmse", "model")
