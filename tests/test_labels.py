"""Truth by classes: labels, and classes from lists."""

from pyspark.sql import functions as F

from tarnwork.operators import blocking as B
from tarnwork.operators import evaluate as E
from tarnwork.operators import pairs as P
from tarnwork.sources import fixtures as X
from tests.conftest import SF


def _truth(spark):
    """Sources and targets of which every tenth shares a class; source 3 and target 4 are also in a second one."""
    sources = spark.createDataFrame([(str(i), i % 10) for i in range(60)] + [("3", 4)], "source1_id string, class int")
    targets = spark.createDataFrame([(str(i), i % 10) for i in range(200)] + [("4", 3)], "target_id string, class int")
    return P.TruthClasses(sources, targets)


def _true(a: int, b: int) -> bool:
    return bool(({a % 10} | ({4} if a == 3 else set())) & ({b % 10} | ({3} if b == 4 else set())))


def test_labels_are_dealt_by_number(spark, monkeypatch):
    """A task gets the pairs of a bounded number of targets, however small their files are, and no side is broadcast."""
    monkeypatch.setattr(B, "SOURCES_A_TASK", 10)
    pairs = spark.createDataFrame([(str(a), str(b), "source2") for a in range(65) for b in range(0, 205, 3)], "source1_id string, target_id string, target_source string")
    got = P.label_pairs(pairs, _truth(spark))
    assert {(r.source1_id, r.target_id): r.label for r in got.collect()} == {(str(a), str(b)): int(a < 60 and b < 200 and _true(a, b)) for a in range(65) for b in range(0, 205, 3)}
    assert got.rdd.getNumPartitions() == 21  # 201 rows of targets by ten
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_lists_are_taken_apart_once(spark):
    """Sources with equal lists, however spelled and ordered, share a class: no pair is made; repeated sources have all their lists."""
    raw = [("1", "[a, b]"), ("2", "b,a"), ("3", "['a','b']"), ("4", "c"), ("4", "a,b"), ("5", "[]"), ("6", None), ("7", "c,c")]
    table = spark.createDataFrame(raw, "source1_entity_id string, matched_entity_ids string")
    truth = E.truth_by_lists(table)
    assert (truth.sources.count(), truth.targets.count(), truth.n_pairs().first()[0]) == (6, 3, 10)
    assert sorted(map(tuple, truth.pairs().collect())) == sorted(map(tuple, E.parse_truth(table).distinct().collect()))


def test_truth_lists(spark, tmp_path):
    """The lists of the truth file are those of its pairs, also where a source has several classes."""
    part = spark.read.parquet(f"{SF}/part.parquet")
    twice = part.filter("p_partkey % 40 = 0").withColumn("p_brand", F.lit("Brand#1"))
    part.unionByName(twice).write.parquet(f"{tmp_path}/part.parquet")
    pairs = X.truth_part(spark, str(tmp_path)).groupBy("source1_id").agg(F.array_sort(F.collect_set("target_id")).alias("ids"))
    assert sorted(map(tuple, X.truth_lists(spark, str(tmp_path)).collect())) == sorted(map(tuple, pairs.collect()))
