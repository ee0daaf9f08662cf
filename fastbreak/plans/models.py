"""Small models by Spark's own library."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expected_points(shots: DataFrame, kinds: list[str], numbers: list[str], value: str = "value", made: str = "made"):
    """Logistic chance of a make times the shot's value; returns the fitted model and the scored rows."""
    rows = shots.withColumn("_label", F.col(made).cast("double")).fillna("none", kinds).fillna(0.0, numbers)
    index = StringIndexer(inputCols=kinds, outputCols=[f"_i_{k}" for k in kinds], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"_i_{k}" for k in kinds], outputCols=[f"_h_{k}" for k in kinds])
    model = Pipeline(stages=[index, hot, VectorAssembler(inputCols=[f"_h_{k}" for k in kinds] + numbers, outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="_label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_y", regParam=0.01)]).fit(rows)
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(rows).withColumn("xpts", vector_to_array("_p")[1] * F.col(value))
    return model, scored.select(*shots.columns, "xpts")


def archetypes(players: DataFrame, features: list[str], k: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(players with a cluster, mean features and size of each cluster)."""
    rows = players.dropna(subset=features)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_s", withMean=True), KMeans(k=k, seed=seed, featuresCol="_s", predictionCol="cluster")])
    out = pipe.fit(rows).transform(rows).select(*players.columns, "cluster")
    return out, out.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in features])
