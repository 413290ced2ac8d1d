"""Classifier, thresholded predictions and the match output."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tarnwork.config import Config
from tarnwork.functions.normalize import format_match_list
from tarnwork.operators import boosting
from tarnwork.operators.pairs import FEATURES
from tarnwork.storage import dropped, exists, get_text, put_text, remove, stored

SIDECAR = "model.json"
#: Training rows of one task.
ROWS_A_TASK = 50_000


def class_weights(rows: DataFrame) -> DataFrame:
    """(label, n, weight) of each class: weights under which all classes count the same."""
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    all_ = sizes.agg(F.sum("n").alias("__all"), F.count(F.lit(1)).alias("__k"))  # one row
    return sizes.crossJoin(F.broadcast(all_)).select("label", "n", (F.col("__all") / (F.col("__k") * F.col("n"))).alias("weight"))


def counted(rows: DataFrame, columns=FEATURES) -> DataFrame:
    """(label, columns, n): equal rows once, with their number."""
    return rows.groupBy("label", *columns).agg(F.count(F.lit(1)).alias("n"))


def copies(equal: DataFrame, least: int) -> DataFrame:
    """Rows of :func:`counted` with a ``weight`` for each, ``least`` times at most, the weight of all their number shared among these.

    Trees judge as those of all rows do: equal rows go the same way at every split, sums of
    weights are those of all rows (but for rounding, so a split that gains nothing may be there
    or not), and a node has ``least`` rows here exactly if it has them there. The values to split
    at MLlib takes from a random sample of 10,000 rows, if there are more, of these rows as of all.
    """
    k = F.least(F.col("n"), F.lit(max(1, least)).cast("long"))
    return equal.withColumn("weight", F.col("weight") * F.col("n") / k).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), k))).drop("__copy", "n")


def train(rows: DataFrame, config: Config = Config(), columns=FEATURES) -> PipelineModel | boosting.Model:
    """Boosted trees on balanced class weights, by the learner of the config. ValueError if only one class is present."""
    if config.learner == "leaves":
        return boosting.train(rows, config, columns)
    weights = {r["label"]: r["weight"] for r in class_weights(rows).collect()}  # two rows
    if len(weights) < 2:
        raise ValueError("training needs both classes")
    weight = F.when(F.col("label") == 1, weights[1]).otherwise(weights[0])
    trees = GBTClassifier(
        labelCol="label", featuresCol="features", weightCol="weight", maxIter=config.trees, stepSize=config.learning_rate,
        maxDepth=config.tree_depth, minInstancesPerNode=config.min_leaf, seed=config.seed,
    )
    equal = stored(counted(rows, columns), "equal")
    n = equal.agg(F.sum(F.least("n", F.lit(max(1, config.min_leaf))))).first()[0]
    few = copies(equal.repartition(-(-n // ROWS_A_TASK)).withColumn("weight", weight), config.min_leaf)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), trees]).fit(few)
    dropped(equal)
    return model


def score(model: PipelineModel | boosting.Model, pairs: DataFrame) -> DataFrame:
    if isinstance(model, boosting.Model):
        return model.score(pairs)
    scored = model.transform(pairs.withColumn("weight", F.lit(1.0)))
    return scored.withColumn("probability", vector_to_array("probability")[1]).drop("features", "weight", "rawPrediction", "prediction")


def save_model(model: PipelineModel | boosting.Model, path: str, threshold: float, report: dict | None = None) -> None:
    """The model, and beside it threshold, report and version as JSON; the model first and the sidecar whole, so a sidecar means a whole model."""
    spark = SparkSession.getActiveSession()
    remove(spark, f"{path}/{SIDECAR}")
    if isinstance(model, boosting.Model):
        put_text(spark, f"{path}/leaves.json", model.to_json())
    else:
        remove(spark, f"{path}/leaves.json")
        model.write().overwrite().save(f"{path}/model")
    put_text(spark, f"{path}/{SIDECAR}", json.dumps({"threshold": threshold, "report": report or {}, "version": 1}))


def load_model(spark: SparkSession, path: str, default_threshold: float = Config.threshold) -> tuple[PipelineModel | boosting.Model, float]:
    """Model and threshold; a bare model without the sidecar gets the default threshold. ValueError if there is no whole model."""
    sidecar = get_text(spark, f"{path}/{SIDECAR}")
    if sidecar is not None:
        leaves = get_text(spark, f"{path}/leaves.json")
        return PipelineModel.load(f"{path}/model") if leaves is None else boosting.Model.from_json(leaves), json.loads(sidecar)["threshold"]
    if not exists(spark, f"{path}/metadata/_SUCCESS"):
        raise ValueError(f"no finished model at {path}")
    return PipelineModel.load(path), default_threshold


def top_predictions(scored: DataFrame, config: Config = Config(), threshold: float | None = None) -> DataFrame:
    limit = config.threshold if threshold is None else threshold
    best = Window.partitionBy("source1_id").orderBy(F.desc("probability"), F.md5("target_id"), "target_id")
    return scored.filter(F.col("probability") >= limit).withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= config.max_predictions).drop("rn")


def match_output(source1: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row for every source1 row: its matches, or ``[]``."""
    grouped = predictions.groupBy("source1_id").agg(F.collect_set("target_id").alias("ids"))
    joined = source1.select(F.col("entity_id").alias("source1_entity_id")).join(grouped, F.col("source1_entity_id") == F.col("source1_id"), "left")
    return joined.select("source1_entity_id", format_match_list(F.col("ids")).alias("matched_entity_ids"))
