"""Exact top-n by counting in bins."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import evaluate as E
from tarnwork.operators import pairs as P
from tarnwork.operators import select
from tarnwork.operators.select import md5_keys, top_n
from tarnwork.storage import stored

LAST = 8e307


def _x(x):
    return LAST if x is None or math.isnan(x) else max(min(x, LAST), -LAST)


def _k(k):
    return 2**63 - 1 if k is None else k


@pytest.mark.parametrize(("few", "bins"), [(2000, 2048), (5, 7), (1, 2)])
def test_top_n(spark, monkeypatch, few, bins):
    """Whatever the passes: NULL, NaN, infinite, tiny and far-apart keys, and a row that a fifth of the table repeats."""
    monkeypatch.setattr(select, "FEW", few)
    monkeypatch.setattr(select, "BINS", bins)
    rng = random.Random(3)
    doubles = [None, 0.5, 0.25, math.nan, math.inf, -math.inf, 1e-320, 2e-320, -3.0]
    longs = [None, 1, 2, -(2**63), 2**62]
    rows = [(i, rng.choice([*doubles, rng.random()]), rng.choice([*longs, rng.randrange(-(2**63), 2**63)])) for i in range(200)] + [(1000, 0.5, 1)] * 50
    df = stored(spark.createDataFrame(rows, "i long, x double, __k long").repartition(3))
    order = sorted((_x(x), _k(k)) for _, x, k in rows)
    for n in (0, 1, 77, 111, 250, 300) if few > 1 else (60, 111):
        first, rest = (t.collect() for t in top_n(df, n, F.col("x"), F.col("__k")))
        assert sorted((_x(r.x), _k(r[2])) for r in first) == order[:n]
        assert sorted(map(repr, first + rest)) == sorted(map(repr, df.collect()))
    (nulls,) = [t.collect() for t in top_n(df.limit(0), 5, F.col("x"))[:1]]
    assert nulls == []


def test_samples_have_no_single_task(spark):
    """Samples are filters: no sort, no exchange to one partition, and the same rows as a global sort."""
    rows = [(f"s{i % 40}", f"t{i}", "x", int(i % 5 == 0), (i * 37 % 101) / 101) for i in range(3000)]
    df = stored(spark.createDataFrame(rows, "source1_id string, target_id string, target_source string, label int, hard_score double"))
    key = [F.md5(F.concat_ws("|", *P.PAIR)), *P.PAIR]
    config = P.Config(max_positives=90, validation_max_positives=50)
    for name, sample in (("training", P.training_sample(df, config)), ("validation", P.validation_sample(df, config))):
        plan = sample._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "Sort" not in plan and "TakeOrdered" not in plan, name
    got = {tuple(r) for r in P.training_sample(df, config).collect()}
    positive, negative = df.filter("label = 1"), df.filter("label = 0")
    hard = negative.orderBy(F.desc("hard_score"), *key).limit(360)
    easy = negative.join(hard.select(*P.PAIR), P.PAIR, "left_anti").select(*df.columns).orderBy(*key).limit(90)
    want = [tuple(r) for t in (positive.orderBy(*key).limit(90), hard, easy) for r in t.collect()]
    assert got == set(want) and len(want) == 540


def test_md5_keys(spark):
    rows = spark.range(500).select(F.concat(F.lit("a|"), F.col("id").cast("string")).alias("t"))
    ordered = [r.t for r in rows.orderBy(F.md5("t")).collect()]
    assert [r.t for r in rows.orderBy(*md5_keys(F.col("t"))).collect()] == ordered


def test_truth_by_classes_makes_no_pairs(spark):
    """Ids of several classes, repeated rows, ids of one side only: the same as truth by pairs; one class of 20,000 x 20,000 costs its ids."""
    a = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 3), ("d", 1), ("d", 2), ("d", 2), ("e", 9)], "source1_id string, class int")
    b = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("y", 2), ("z", 3), ("u", 8)], "target_id string, class int")
    classes, truth = P.TruthClasses(a, b), a.join(b, "class").drop("class")
    pairs = spark.createDataFrame([(s, t, n) for n, (s, t) in enumerate([("a", "x"), ("a", "y"), ("a", "y"), ("b", "y"), ("c", "z"), ("d", "u"), ("q", "x"), ("e", "q")])], "source1_id string, target_id string, n int")
    for found in (pairs, pairs.limit(0)):
        assert sorted(P.label_pairs(found, classes).collect()) == sorted(P.label_pairs(found, truth).select(*pairs.columns, "label").collect())
        assert E.blocking_recall(found, classes).collect() == E.blocking_recall(found, truth).collect()
        assert E.confusion(found, classes).collect() == E.confusion(found, truth).collect()
        assert sorted(E.missing_from(found, classes).collect()) == sorted(E.missing_from(found, truth).collect())
        assert sorted(E.found_in(found, classes).collect()) == sorted(E.found_in(found, truth).collect())
    none = P.TruthClasses(a.limit(0), b)
    assert E.blocking_recall(pairs, none).first() == (0, 0, 1.0)
    big = P.TruthClasses(*[spark.range(20_000).select(F.col("id").cast("string").alias(k), F.lit(1).alias("class")) for k in ("source1_id", "target_id")])
    assert E.blocking_recall(pairs, big).first().true_pairs == 400_000_000
