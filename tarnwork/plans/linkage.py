"""The whole linkage run: tables in, normalized, blocked by batches, trained, predicted, matches out.

Everything lies under one work folder, each step in its own table with a manifest of what it
was made from (:mod:`tarnwork.operators.batches`). A step that is current is not done again; a
change of an input file or of a parameter makes the steps anew that depend on it. Candidates and
predictions are batched by source1 entity: a run that was stopped goes on with the batches
that are missing, all of them in one job. ``reset`` removes the tables and the model, not
the entities.

Entities and indexes are bucketed by their join keys, with as many buckets as shuffles have
partitions when they are written, so the joins of blocking and of the features shuffle source1
keys and candidates, never the entity tables and indexes.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnwork.config import Config
from tarnwork.operators import blocking as B
from tarnwork.operators import evaluate as E
from tarnwork.operators import pairs as P
from tarnwork.operators import predict as R
from tarnwork.operators.batches import Batches, batch_of, digest, files_digest, step
from tarnwork.operators.entities import combine_targets, normalize_entities
from tarnwork.sources.io import TRUTH_COLUMNS, attach_bucketed, read_tsv, require_columns, write_bucketed, write_json, write_parquet, write_tsv
from tarnwork.storage import get_text, put_text, remove, stored

SOURCES = ("source1", "source2", "source3")
#: The parameters that each step reads; ``batch_rows`` is none of them, since it changes no row.
NORMALIZING = ("min_name_length", "name_prefix_length")
BLOCKING = ("max_candidates", "fallback_below", "max_token_df", "min_token_length", "rare_rank_limit")
TRAINING = (
    "max_positives", "hard_per_positive", "easy_per_positive", "validation_percent", "validation_max_positives", "validation_negatives_per_positive", "trees", "learning_rate",
    "tree_depth", "min_leaf", "learner", "leaves", "l2", "min_hessian", "seed", "thresholds", "min_precision",
)
PREDICTING = ("prefilter_name", "prefilter_address", "prefilter_top_k", "max_predictions")
# The names under which labels are found, in this order.
LABELS = ("label", "is_match", "target", "match")


# ---------------------------------------------------------------------------- tables


def fingerprints(spark: SparkSession, inputs: dict[str, str], config: Config) -> dict[str, str]:
    """What each step up to the candidates and the model would be made from."""
    values = asdict(config)
    of = lambda names: {n: values[n] for n in names}
    out = {s: digest(s, files_digest(spark, inputs[s]), of(NORMALIZING)) for s in SOURCES}
    out["truth"] = digest("truth", files_digest(spark, inputs["truth"]))
    out["targets"] = digest("targets", out["source2"], out["source3"])
    out["indexes"] = digest("indexes", out["targets"], of(BLOCKING))
    out["candidates"] = digest("candidates", out["source1"], out["indexes"], of(BLOCKING))
    out["model"] = digest("model", out["candidates"], out["truth"], of(TRAINING))
    out["predicting"] = digest("predicting", out["candidates"], of(PREDICTING))
    return out


def _name(work: str, table: str) -> str:
    """The catalog name of a table under ``work``."""
    return f"linkage_{digest(work)[:16]}_{table}"


def _buckets(spark: SparkSession, path: str, table: str) -> int:
    """How many buckets a table has, or would get."""
    held = get_text(spark, f"{path}/_buckets_{table}")
    return int(held) if held else int(spark.conf.get("spark.sql.shuffle.partitions"))


def _bucketed(spark: SparkSession, work: str, table: str, keys: tuple[str, ...], fingerprint: str, make) -> DataFrame:
    """A bucketed step under ``work/entities``."""
    folder = f"{work}/entities"

    def write(path: str) -> None:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        write_bucketed(make(), _name(work, table), keys, n, path)
        put_text(spark, f"{folder}/_buckets_{table}", str(n))

    step(spark, f"{folder}/{table}", fingerprint, write)
    return attach_bucketed(spark, _name(work, table), keys, _buckets(spark, folder, table), f"{folder}/{table}")


def prepare(spark: SparkSession, inputs: dict[str, str], work: str, config: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(source1, targets, true pairs) as tables; ``inputs`` names the TSV of each source and of the truth, which is kept by classes (:func:`truth_classes`)."""
    prints = fingerprints(spark, inputs, config)
    entities = lambda source: normalize_entities(read_tsv(spark, inputs[source]), source, config)
    source1 = _bucketed(spark, work, "source1", ("entity_id",), prints["source1"], lambda: entities("source1"))
    for source in SOURCES[1:]:
        step(spark, f"{work}/entities/{source}", prints[source], lambda path, source=source: write_parquet(entities(source), path))
    whole = lambda: combine_targets(*[spark.read.parquet(f"{work}/entities/{s}") for s in SOURCES[1:]])
    targets = _bucketed(spark, work, "targets", ("entity_id", "source"), prints["targets"], whole)
    truth = lambda: E.truth_by_lists(require_columns(read_tsv(spark, inputs["truth"], TRUTH_COLUMNS), TRUTH_COLUMNS))
    for side in ("sources", "targets"):
        step(spark, f"{work}/entities/truth_{side}", prints["truth"], lambda path, side=side: write_parquet(getattr(truth(), side), path))
    return source1, targets, truth_classes(spark, work).pairs()


def truth_classes(spark: SparkSession, work: str) -> P.TruthClasses:
    """The truth that :func:`prepare` has written."""
    return P.TruthClasses(*[spark.read.parquet(f"{work}/entities/truth_{side}") for side in ("sources", "targets")])


def _only(truth: P.TruthClasses, ids: DataFrame) -> P.TruthClasses:
    """The truth of these sources."""
    return P.TruthClasses(truth.sources.join(ids, "source1_id", "left_semi"), truth.targets)


def indexes(spark: SparkSession, targets: DataFrame, work: str, config: Config, fingerprint: str) -> B.Indexes:
    """The blocking indexes, written once under the work folder."""
    folder, prefix = f"{work}/indexes", _name(work, "index")

    def write(path: str) -> None:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        B.save_indexes(B.plan_indexes(targets, config), prefix, n, path)
        put_text(spark, f"{path}/_buckets_index", str(n))

    step(spark, folder, fingerprint, write)
    if B.indexes_ready(spark, prefix):
        return B.load_indexes(spark, prefix)
    return B.attach_indexes(spark, prefix, _buckets(spark, folder, "index"), folder)


# --------------------------------------------------------------------------- batches


def n_batches(source1: DataFrame, config: Config) -> int:
    return max(1, math.ceil(source1.count() / config.batch_rows))


def candidate_batches(spark: SparkSession, source1: DataFrame, work: str, config: Config, fingerprint: str) -> Batches:
    return Batches(spark, f"{work}/candidates", fingerprint, "source1_id", lambda: n_batches(source1, config))


def block(spark: SparkSession, source1: DataFrame, targets: DataFrame, work: str, config: Config, prints: dict[str, str], jobs: int = 1) -> Batches:
    """All candidates; the batches that are missing are written by ``jobs`` jobs at most."""
    batches = candidate_batches(spark, source1, work, config, prints["candidates"])
    if batches.missing():
        index = indexes(spark, targets, work, config, prints["indexes"])
        batches.write(lambda part: B.candidates(batches.only(source1, part, batch_of(F.col("entity_id"), batches.n)), None, config, index), jobs)
    return batches


# ---------------------------------------------------------------------------- models


def label_column(df: DataFrame) -> str:
    """The name under which labels are found."""
    found = [c for c in LABELS if c in df.columns]
    if not found:
        raise ValueError("no label column")
    return found[0]


def with_hardness(labelled: DataFrame) -> DataFrame:
    """Feature columns and ``hard_score``."""
    rows = P.features(labelled, arrow=True)
    return rows.withColumn("hard_score", P.hard_score(F.col("name_wratio"), F.col("address_wratio"), F.col("country_exact")))


def train_with_validation(enriched: DataFrame, config: Config = Config()):
    """(model, threshold, report) from labelled pairs with both sides' texts.

    Split by source1 entity; trained on capped positives with hard and easy negatives of the
    one part; the threshold is chosen on a balanced sample of the other.
    """
    name = label_column(enriched)
    rows = stored(with_hardness(enriched if name == "label" else enriched.withColumnRenamed(name, "label")), "features")
    held = P.in_validation(F.col("source1_id"), config)
    sample = stored(P.training_sample(rows.filter(~held), config), "training")
    model = R.train(sample, config)
    scored = stored(R.score(model, P.validation_sample(rows.filter(held), config)).select("source1_id", "label", "probability"), "scored")
    sweep = E.threshold_sweep(scored, config.thresholds)
    best = E.select_threshold(sweep, config).first()
    counts = rows.agg(F.count(F.lit(1)).alias("pairs"), F.sum("label").alias("positives"), F.countDistinct("source1_id").alias("entities")).first()
    report = {
        "pairs": counts.pairs, "positive_pairs": counts.positives, "entities": counts.entities, "training_pairs": sample.count(), "validation_pairs": scored.count(),
        "selected": best.asDict(), "sweep": [r.asDict() for r in sweep.orderBy("threshold").collect()],
    }
    return model, best.threshold, report


def predict(candidates: DataFrame, source1: DataFrame, targets: DataFrame, model, threshold: float, config: Config = Config()) -> DataFrame:
    """(source1_id, target_id, target_source, probability) of the predicted matches."""
    likely = P.cheap_prefilter(P.enrich(candidates, source1, targets), config)
    scored = R.score(model, P.features(likely, arrow=True))
    return R.top_predictions(scored, config, threshold).select(*B.PAIR, "probability")


# ------------------------------------------------------------------------------ runs


def reset(spark: SparkSession, work: str) -> None:
    for name in ("indexes", "candidates", "predictions", "model", "report", "matches", "quick"):
        remove(spark, f"{work}/{name}")


def run(spark: SparkSession, inputs: dict[str, str], work: str, config: Config = Config(), fresh: bool = False, jobs: int = 1) -> DataFrame:
    """The matches of every source1 row; also ``matches`` (TSV), ``model`` and ``report`` (JSON) under ``work``.

    Missing batches are written by ``jobs`` jobs at most, of candidates and of predictions each.
    """
    if fresh:
        reset(spark, work)
    prints = fingerprints(spark, inputs, config)
    source1, targets, _ = prepare(spark, inputs, work, config)
    truth = truth_classes(spark, work)
    batches = block(spark, source1, targets, work, config, prints, jobs)
    found = batches.read()

    def learn(path: str) -> None:
        pairs = found.drop("batch_id")
        model, threshold, report = train_with_validation(P.enrich(P.label_pairs(pairs, truth), source1, targets), config)
        report["blocking_recall"] = E.blocking_recall(pairs, _only(truth, source1.select(F.col("entity_id").alias("source1_id")))).first().recall
        R.save_model(model, path, threshold, report)
        write_json(spark.createDataFrame([(json.dumps(report),)], "report string"), f"{work}/report")

    step(spark, f"{work}/model", prints["model"], learn)
    model, threshold = R.load_model(spark, f"{work}/model", config.threshold)
    mark = digest(prints["predicting"], prints["model"], get_text(spark, f"{work}/model/{R.SIDECAR}"))
    predictions = Batches(spark, f"{work}/predictions", mark, "source1_id", lambda: batches.n)
    predictions.write(lambda part: predict(predictions.only(found, part, F.col("batch_id")).drop("batch_id"), source1, targets, model, threshold, config), jobs)
    out = R.match_output(source1, predictions.read().drop("batch_id"))
    write_tsv(out, f"{work}/matches")
    return read_tsv(spark, f"{work}/matches", TRUTH_COLUMNS, multi_line=False)


def quick_eval(spark: SparkSession, inputs: dict[str, str], work: str, limit: int | None = 100_000, config: Config = Config(), prefilter: bool = False) -> dict:
    """Held-out evaluation on the candidates of a run: a report, also written as JSON under ``work``.

    ``limit`` source1 entities (in the order of their ids' digest); all batches must be there.
    Recall is end to end: true pairs that blocking missed count, of the evaluated entities only.
    """
    source1, targets, _ = prepare(spark, inputs, work, config)
    prints = fingerprints(spark, inputs, config)
    found = candidate_batches(spark, source1, work, config, prints["candidates"]).read().drop("batch_id")
    ids = source1.select(F.col("entity_id").alias("source1_id")).distinct()
    if limit is not None:
        ids = ids.orderBy(F.md5("source1_id"), "source1_id").limit(limit)
    ids = stored(ids, "evaluated")
    held = P.in_validation(F.col("source1_id"), config)
    true, found = _only(truth_classes(spark, work), ids), found.join(ids, "source1_id", "left_semi")
    labelled = P.enrich(P.label_pairs(found, true), source1, targets)
    rows = stored(with_hardness(labelled), "features")
    model = R.train(stored(P.training_sample(rows.filter(~held), config), "training"), config)
    asked = rows.filter(held)
    scored = stored(R.score(model, P.cheap_prefilter(asked, config) if prefilter else asked).select("source1_id", "target_id", "label", "probability"), "scored")
    held_true = P.TruthClasses(true.sources.filter(held), true.targets)
    offered = scored.filter("label = 1").select("source1_id", "target_id").distinct()
    missed = held_true.n_pairs().first().true_pairs - offered.count()  # what was offered is true and held
    sweep = E.threshold_sweep(scored.dropDuplicates(["source1_id", "target_id"]), [round(0.5 + i / 100, 2) for i in range(47)], missed)
    best = E.select_threshold(sweep, config, quick=True).first()
    report = {
        "entities": ids.count(), "validation_entities": ids.filter(held).count(), "blocking_recall": E.blocking_recall(found, true).first().recall,
        "validation_blocking_recall": E.blocking_recall(found.filter(held), held_true).first().recall, "selected": best.asDict(), "sweep": [r.asDict() for r in sweep.orderBy("threshold").collect()],
    }
    write_json(spark.createDataFrame([(json.dumps(report),)], "report string"), f"{work}/quick")
    return report
