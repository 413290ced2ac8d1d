"""Leaf-wise boosted trees against a plain search for splits, and beside MLlib's."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tarnwork import Config
from tarnwork.operators import boosting
from tarnwork.operators import evaluate as E
from tarnwork.operators import predict as R
from tarnwork.storage import stored


def _data(n, seed):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 6, n), np.round(rng.normal(size=n), 1), rng.random(n) < 0.3, rng.exponential(size=n).round(2)], 1).astype(float)
    y = ((x[:, 0] * x[:, 1] + 2 * x[:, 2] - x[:, 3] + rng.normal(scale=0.7, size=n)) > 0.5).astype(int)
    return x, y


def _table(spark, x, y):
    rows = [(int(k), *map(float, v)) for k, v in zip(y, x)]
    return stored(spark.createDataFrame(rows, "label int, a double, b double, c double, d double").repartition(3), "rows")


def _plain(x, y, cuts, config):
    """Every split of every leaf is tried on the rows themselves; always the best leaf is split. Returns trees as nested tuples, and margins."""
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    margin, trees = np.zeros(len(y)), []
    for _ in range(config.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        part = lambda r: g[r].sum() ** 2 / (h[r].sum() + config.l2)

        def search(rows):
            best = (0.0, None)
            for f in range(x.shape[1]):
                for c in cuts[f]:
                    left, right = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                    if min(len(left), len(right)) < max(1, config.min_leaf) or min(h[left].sum(), h[right].sum()) < config.min_hessian:
                        continue
                    gain = part(left) + part(right) - part(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, c, left, right))
            return best

        leaves, splits = {(): (np.arange(len(y)), search(np.arange(len(y))))}, {}
        while len(leaves) < config.leaves:
            name = max(leaves, key=lambda k: leaves[k][1][0])
            gain, found = leaves[name][1]
            if found is None:
                break
            f, c, left, right = found
            del leaves[name]
            splits[name] = (f, c)
            leaves[(*name, 0)], leaves[(*name, 1)] = (left, search(left)), (right, search(right))
        for name, (rows, _) in leaves.items():
            margin[rows] += -config.learning_rate * g[rows].sum() / (h[rows].sum() + config.l2)
        trees.append(splits)
    return trees, margin


def _splits(model, tree, node=0, name=()):
    if tree.feature[node] < 0:
        return {}
    f = tree.feature[node]
    return {name: (f, model.cuts[f][tree.cut[node]])} | _splits(model, tree, tree.left[node], (*name, 0)) | _splits(model, tree, tree.right[node], (*name, 1))


@pytest.mark.parametrize(("leaves", "l2", "min_leaf", "refresh"), [(7, 1.0, 5, 2), (31, 1.0, 3, 10), (4, 0.0, 30, 1), (12, 25.0, 1, 10)])
def test_trees_against_a_plain_search(spark, monkeypatch, leaves, l2, min_leaf, refresh):
    monkeypatch.setattr(boosting, "REFRESH", refresh)
    x, y = _data(400, leaves)
    config = Config(trees=3, leaves=leaves, l2=l2, min_leaf=min_leaf, learning_rate=0.3, learner="leaves")
    model = boosting.train(_table(spark, x, y), config, ["a", "b", "c", "d"])
    trees, margin = _plain(x, y, model.cuts, config)
    assert [_splits(model, t) for t in model.trees] == trees
    assert np.abs(model.margin(x) - margin).max() < 1e-4
    assert all((np.array(t.feature) < 0).sum() <= leaves for t in model.trees)


def test_passes_and_bounds(spark):
    """A tree takes far fewer passes than splits, and cuts are at most BINS - 1."""
    x, y = _data(3000, 5)
    x[:, 3] = np.random.default_rng(1).random(3000)
    config = Config(trees=1, min_leaf=5, learner="leaves")
    rows = _table(spark, x, y)
    model = boosting.Model(["a", "b", "c", "d"], boosting._cuts(rows, ["a", "b", "c", "d"]), 0.0, [])
    assert len(model.cuts[0]) == 6 and 200 < len(model.cuts[3]) <= boosting.BINS - 1
    table, asked = stored(boosting._binned(rows, model, {0: 1.0, 1: 1.0})), []
    tree = boosting.grow(lambda t, asks: asked.append(len(asks)) or boosting._gather(table, [], t, asks, 4), config)
    assert (np.array(tree.feature) < 0).sum() == 31 and len(asked) <= 14 and sum(asked) <= 62


def test_model(spark, tmp_path):
    """The same model from any number of tasks; saved and loaded; missing values; one class refused."""
    x, y = _data(500, 8)
    config = Config(trees=4, min_leaf=5, learner="leaves")
    rows = _table(spark, x, y)
    model = R.train(rows, config, ["a", "b", "c", "d"])
    again = R.train(stored(rows.repartition(7)), config, ["a", "b", "c", "d"])
    assert model.to_json() == again.to_json()
    R.save_model(model, str(tmp_path / "m"), 0.6, {"x": 1})
    loaded, threshold = R.load_model(spark, str(tmp_path / "m"))
    asked = rows.unionByName(spark.createDataFrame([(0, None, float("nan"), 1.0, None)], rows.schema))
    got, want = (sorted(r.probability for r in R.score(m, asked).collect()) for m in (loaded, model))
    assert threshold == 0.6 and got == want and len(got) == 501 and all(0 < p < 1 for p in got)
    inf = R.score(model, spark.createDataFrame([(0, np.inf, np.inf, 1.0, np.inf), (0, None, float("nan"), 1.0, None)], rows.schema)).collect()
    assert inf[0].probability == inf[1].probability
    with pytest.raises(ValueError, match="both classes"):
        R.train(rows.filter("label = 1"), config, ["a"])


def test_held_out_beside_the_other_learner(spark):
    """F0.5 on held-out rows is no worse than that of trees of fixed depth."""
    x, y = _data(4000, 21)
    rows = _table(spark, x, y).withColumn("i", F.monotonically_increasing_id())
    train, held = stored(rows.filter("i % 4 > 0")), stored(rows.filter("i % 4 = 0"))
    best = {}
    for learner in ("leaves", "depth"):
        model = R.train(train, Config(trees=20, min_leaf=10, learner=learner, learning_rate=0.2), ["a", "b", "c", "d"])
        sweep = E.threshold_sweep(R.score(model, held).select("label", "probability"), Config.thresholds)
        best[learner] = max(r.f05 for r in sweep.collect())
    assert best["leaves"] > 0.85 and best["leaves"] > best["depth"] - 0.02, best


def test_equal_rows_are_one_row_with_their_number(spark, monkeypatch):
    """The same trees as from all rows, from a table that holds each distinct row once."""
    rows = spark.range(4000).selectExpr("CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 11 AS DOUBLE) AS b", "CAST((id % 7) * (id % 11) % 5 < 2 AS INT) AS label")
    held, real = [], boosting._collapsed
    monkeypatch.setattr(boosting, "_collapsed", lambda df: held.append(real(df)) or held[-1])
    config = Config(trees=3, min_leaf=20, learner="leaves")
    few = boosting.train(rows, config, ["a", "b"])
    assert held[0].count() == 77 and held[0].agg(F.sum("n")).first()[0] == 4000
    monkeypatch.setattr(boosting, "_collapsed", lambda df: df)
    assert boosting.train(rows, config, ["a", "b"]).to_json() == few.to_json()


def test_depth_trees_on_equal_rows_once(spark):
    """MLlib's trees are fitted to each distinct row ``min_leaf`` times at most, and judge as those of all rows do."""
    config = Config(trees=4, min_leaf=6)
    rows = spark.range(3000).selectExpr("CAST(hash(id) % 3 = 0 OR id % 7 = 1 AS INT) AS label", "id % 7 AS a", "pmod(hash(id, 1), 5) AS b", "CAST(id % 400 = 3 AS INT) AS c")
    few = R.copies(R.counted(rows, ["a", "b", "c"]).withColumn("weight", F.lit(2.0)), config.min_leaf)
    (distinct,), (n, weight) = rows.agg(F.countDistinct("label", "a", "b", "c")).first(), few.agg(F.count(F.lit(1)), F.sum("weight")).first()
    assert n <= config.min_leaf * distinct < 1000 and weight == pytest.approx(6000)
    fitted = R.train(rows, config, ["a", "b", "c"])
    weights = {r.label: r.weight for r in R.class_weights(rows).collect()}
    plain = GBTClassifier(labelCol="label", weightCol="weight", maxIter=4, stepSize=config.learning_rate, maxDepth=config.tree_depth, minInstancesPerNode=6, seed=config.seed)
    whole = rows.withColumn("weight", F.when(F.col("label") == 1, weights[1]).otherwise(weights[0]))
    want = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"), plain]).fit(whole)
    got, all_ = ({(r.a, r.b, r.c): r.probability for r in R.score(m, rows).select("a", "b", "c", "probability").distinct().collect()} for m in (fitted, want))
    assert got.keys() == all_.keys() and all(got[k] == pytest.approx(all_[k], abs=1e-9) for k in got)
