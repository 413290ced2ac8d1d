"""Recall, precision and threshold choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnwork.config import Config
from tarnwork.operators.pairs import TruthClasses, label_pairs


def parse_truth(raw: DataFrame) -> DataFrame:
    from tarnwork.functions.normalize import parse_match_list

    return raw.select(F.col("source1_entity_id").alias("source1_id"), F.explode(parse_match_list(F.col("matched_entity_ids"))).alias("target_id"))


def truth_by_lists(raw: DataFrame) -> TruthClasses:
    """Truth as written by classes: sources with equal lists share one, and each list is taken apart once.

    A class is the digest of its sorted ids. Sources without an id in their list are left out.
    """
    from tarnwork.functions.normalize import parse_match_list

    ids = F.array_join(F.array_sort(parse_match_list(F.col("matched_entity_ids"))), ",")  # no id holds a comma
    lists = raw.select(F.col("source1_entity_id").alias("source1_id"), ids.alias("ids")).filter("ids <> ''").withColumn("class", F.sha2("ids", 256))
    targets = lists.select("class", "ids").dropDuplicates(["class"]).select(F.explode(F.split("ids", ",")).alias("target_id"), "class")
    return TruthClasses(lists.select("source1_id", "class").distinct(), targets)


def _hits(pairs: DataFrame, truth: DataFrame | TruthClasses) -> DataFrame:
    """One row: distinct true pairs, distinct ``pairs``, and how many are both."""
    given = pairs.select("source1_id", "target_id").distinct()
    if isinstance(truth, TruthClasses):
        found = label_pairs(given, truth).agg(F.count(F.lit(1)).cast("bigint").alias("given"), F.coalesce(F.sum("label"), F.lit(0)).cast("bigint").alias("found"))
        return truth.n_pairs().crossJoin(F.broadcast(found))
    true = truth.select("source1_id", "target_id").distinct().withColumn("t", F.lit(1))
    n = lambda c: F.count_if(c).cast("bigint")
    both = F.col("p").isNotNull() & F.col("t").isNotNull()
    return given.withColumn("p", F.lit(1)).join(true, ["source1_id", "target_id"], "full").agg(n(F.col("t").isNotNull()).alias("true_pairs"), n(F.col("p").isNotNull()).alias("given"), n(both).alias("found"))


def blocking_recall(candidates: DataFrame, truth: DataFrame | TruthClasses) -> DataFrame:
    """One row. Recall is 0 without candidates, else 1 without true pairs."""
    recall = F.when(F.col("given") == 0, 0.0).when(F.col("true_pairs") == 0, 1.0).otherwise(F.try_divide("found", "true_pairs"))
    return _hits(candidates, truth).select("true_pairs", F.col("found").alias("found_pairs"), recall.cast("double").alias("recall"))


def missing_from(pairs: DataFrame, truth: DataFrame | TruthClasses) -> DataFrame:
    """Distinct (source1_id, target_id) of ``pairs`` that are not true."""
    return label_pairs(pairs.select("source1_id", "target_id").distinct(), truth).filter("label = 0").drop("label")


def found_in(pairs: DataFrame, truth: DataFrame | TruthClasses) -> DataFrame:
    """Distinct (source1_id, target_id) of ``pairs`` that are true."""
    return label_pairs(pairs.select("source1_id", "target_id").distinct(), truth).filter("label = 1").drop("label")


def _f_half(p, r):
    return F.when(0.25 * p + r > 0, F.try_divide(1.25 * p * r, 0.25 * p + r)).otherwise(0.0)


def threshold_sweep(scored: DataFrame, thresholds, missed=0) -> DataFrame:
    """tp, fp, fn, precision, recall and F0.5 at each threshold.

    Rows are first reduced to one row per (label, number of thresholds reached), so the
    sweep costs one pass however many thresholds there are. ``missed`` adds true pairs
    that blocking never offered, which makes the recall an end-to-end one.
    """
    ordered = sorted(thresholds)
    spark = scored.sparkSession
    cuts = F.array(*[F.lit(float(t)) for t in ordered])
    reached = F.size(F.filter(cuts, lambda t: F.col("probability") >= t))
    steps = scored.groupBy(reached.alias("reached"), "label").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(1).select(F.posexplode(cuts).alias("pos", "threshold"))
    pos, neg, hit = F.col("label") == 1, F.col("label") == 0, F.col("reached") > F.col("pos")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    sums = grid.join(steps, F.lit(True), "left").groupBy("threshold").agg(n(pos & hit).alias("tp"), n(neg & hit).alias("fp"), (n(pos & ~hit) + F.lit(missed)).cast("bigint").alias("fn"))
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return sums.withColumns({"precision": p, "recall": r}).withColumn("f05", _f_half(F.col("precision"), F.col("recall")))


def select_threshold(sweep: DataFrame, config: Config = Config(), quick: bool = False) -> DataFrame:
    """The best row: highest F0.5 among those precise enough, else the most precise.

    Ties: higher precision (not in the quick variant), then the lower threshold.
    """
    ok = (F.col("precision") >= config.min_precision).cast("int")
    score = F.when(ok == 1, F.col("f05")).otherwise(F.col("precision"))
    second = F.when(ok == 1, F.col("precision")).otherwise(F.col("f05"))
    order = [ok.desc(), score.desc()] + ([] if quick else [second.desc()]) + [F.col("threshold")]
    return sweep.orderBy(*order).limit(1)


def confusion(predicted: DataFrame, truth: DataFrame | TruthClasses) -> DataFrame:
    """tp, fp and fn of distinct pairs, with zero-safe precision, recall and F0.5."""
    sums = _hits(predicted, truth).select(F.col("found").alias("tp"), (F.col("given") - F.col("found")).alias("fp"), (F.col("true_pairs") - F.col("found")).alias("fn"))
    out = sums.withColumns({
        "precision": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)),
        "recall": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)),
    })
    return out.withColumn("f05", _f_half(F.col("precision"), F.col("recall")))
