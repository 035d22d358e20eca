"""The ranker: listwise gradient boosting with Spark ML's trees, and a pointwise one."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.features import RANKER_FEATURES
from millrace.scratch import drop_scratch, temporary, write_table

#: Prefix of the columns that the trees of a listwise ranker predict.
_TREE = "_tree_"


def _imputed(df: DataFrame, features: list[str]) -> DataFrame:
    """Nulls and NaN become 0 with a flag of their own: trees of Spark ML take neither."""
    columns = {}
    for c in features:
        missing = F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
        columns[f"{c}__value"] = F.when(missing, F.lit(0.0)).otherwise(F.col(c).cast("double"))
        columns[f"{c}__missing"] = missing.cast("double")
    return df.withColumns(columns)


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=[f"{c}__{kind}" for c in features for kind in ("value", "missing")], outputCol="_features")


def train_ranker(labelled: DataFrame, features: list[str] | None = None, trees: int = 50, depth: int = 5, rate: float = 0.2, seed: int = 42) -> PipelineModel:
    """Gradient boosting of a listwise loss: the cross-entropy of each query's softmax over its pool against its labels.

    ``labelled`` has ``query_id`` and ``label``; a query is a group, and one without a positive label teaches nothing.  Each
    round takes the loss's gradient at every row, from sums over its query, and fits a regression tree to it; a tree's leaf
    values count ``rate`` times.  Rows stay in tables, one for each round, of which the last is kept.
    """
    features = features or RANKER_FEATURES
    spark, assembler = labelled.sparkSession, _assembler(features)
    query = Window.partitionBy("query_id")
    base = assembler.transform(_imputed(labelled, features)).select("query_id", F.col("label").cast("double").alias("label"), "_features")
    positive = F.sum("label").over(query)
    stages: list = [assembler]
    with temporary(spark):
        # a row's target is its share of the query's relevance, scaled by the pool's size so that gradients are of the order of one
        rows = base.withColumn("_n", F.count("*").over(query)).withColumn("_target", F.when(positive > 0, F.col("label") / positive)).where(F.col("_target").isNotNull())
        frame, before = write_table(rows.select("query_id", "_features", "_n", "_target", F.lit(0.0).alias("_score")), "boosting")
        for k in range(trees):
            likely = F.exp(F.col("_score") - F.max("_score").over(query))
            gradients = frame.withColumn("_e", likely).withColumn("_gradient", (F.col("_target") - F.col("_e") / F.sum("_e").over(query)) * F.col("_n")).drop("_e")
            tree = DecisionTreeRegressor(featuresCol="_features", labelCol="_gradient", predictionCol=f"{_TREE}{k}", maxDepth=depth, seed=seed + k).fit(gradients)
            stages.append(tree)
            if k + 1 < trees:
                moved = tree.transform(frame).withColumn("_score", F.col("_score") + F.lit(rate) * F.col(f"{_TREE}{k}"))
                frame, path = write_table(moved.select(*frame.columns), "boosting")
                drop_scratch(spark, before)
                before = path
    return PipelineModel(stages=stages)


def train_pointwise(labelled: DataFrame, features: list[str] | None = None, trees: int = 50, depth: int = 5, seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees on the labels of single pairs."""
    features = features or RANKER_FEATURES
    boosted = GBTRegressor(featuresCol="_features", labelCol="label", predictionCol="score", maxIter=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[_assembler(features), boosted]).fit(_imputed(labelled, features))


def predict_scores(model: PipelineModel, df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """``df`` with ``score``: the sum of the trees of a listwise ranker, or what another one predicts."""
    out = model.transform(_imputed(df, features or RANKER_FEATURES))
    trees = [c for c in out.columns if c.startswith(_TREE)]
    if trees:
        out = out.withColumn("score", F.aggregate(F.array(*trees), F.lit(0.0), lambda s, x: s + x))
    return out.select(*df.columns, "score")


def save_ranker(model: PipelineModel, path: str) -> None:
    """Writes a ranker through Spark, in place of one that is there."""
    model.write().overwrite().save(path)


def load_ranker(path: str) -> PipelineModel:
    return PipelineModel.load(path)
