"""Boosted trees grown leaf by leaf, on second-order histograms that executors sum.

Features are cut into bins by quantiles once, and the rows are kept as one byte a feature. For
every tree, tasks add up gradients and second derivatives of the logistic loss by (node,
feature, bin); only these sums, whose size is set by parameters, reach the driver, which grows
the tree: always the leaf whose best split gains most, until there are ``leaves``. A pass
over the rows gathers the sums below all open leaves at once (the left child; the right one is
the rest), so a tree takes about as many passes as it is deep, not one for each split.

Sums are integers (gradients in units of 2**-24), so they do not depend on the order in which
tasks end, and neither do the trees. Rows that are equal in all bins and the label are one row
with their number from the start: they stay together in every tree, and n times an integer
is what n rows add up to, so the trees are the same. Rows carry their margin, brought up to date in a new table
every ``REFRESH`` trees; between them tasks apply the few trees since.

Missing and NaN values go with the largest. ValueError if only one class is present.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from tarnwork.config import Config
from tarnwork.storage import dropped, stored

BINS = 256
REFRESH = 10
UNIT = float(1 << 24)


@dataclass
class Tree:
    """Nodes in the order in which they were made; a leaf has feature -1. Rows whose bin is at most ``cut`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, leaf: int, feature: int, cut: int) -> tuple[int, int]:
        children = len(self.feature), len(self.feature) + 1
        self.feature[leaf], self.cut[leaf], (self.left[leaf], self.right[leaf]) = feature, cut, children
        for x in (self.feature, self.cut, self.left, self.right, self.value):
            x += [-1, -1] if x is self.feature else [0, 0]
        return children

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            rows = rows[feature[node[rows]] >= 0]
            if not len(rows):
                return node
            at = node[rows]
            node[rows] = np.where(bins[rows, feature[at]] <= cut[at], left[at], right[at])

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


@dataclass
class Model:
    columns: list[str]
    cuts: list[list[float]]
    start: float
    trees: list[Tree]

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Bins of a matrix of raw values, a column for each feature."""
        return np.stack([np.searchsorted(np.array(c), values[:, i], "left") for i, c in enumerate(self.cuts)], 1).astype(np.uint8)

    def margin(self, values: np.ndarray) -> np.ndarray:
        bins = self.bins(values)
        return self.start + sum((t.margin(bins) for t in self.trees), np.zeros(len(values)))

    def score(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with the column ``probability``."""
        shared = pairs.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf(DoubleType())
        def probability(values: pd.DataFrame) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-shared.value.margin(values.to_numpy(float)))))

        return pairs.withColumn("probability", probability(F.struct(*[F.col(c).cast("double").alias(c) for c in self.columns])))

    def to_json(self) -> str:
        return json.dumps({"columns": self.columns, "cuts": self.cuts, "start": self.start, "trees": [vars(t) for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Model:
        held = json.loads(text)
        return Model(held["columns"], held["cuts"], held["start"], [Tree(**t) for t in held["trees"]])


# ----------------------------------------------------------------------------- growing


@dataclass
class _Node:
    """A leaf that may be split: its sums, and those of its left child once a pass has brought them."""

    sums: np.ndarray
    gain: float = 0.0
    feature: int = 0
    cut: int = 0
    below: np.ndarray | None = None


def best_split(sums: np.ndarray, config: Config) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split of a node with these (gradient, second derivative, rows) by feature and bin; ties go to the smaller feature, then bin."""
    left = np.cumsum(sums, 2)[:, :, :-1]
    total = sums.sum(2)[:, :1, None]
    (gl, hl), nl = left[:2] / UNIT, left[2]
    (g, h), n = total[:2] / UNIT, total[2]
    lam = config.l2
    gain = gl**2 / (hl + lam) + (g - gl) ** 2 / (h - hl + lam) - g**2 / (h + lam)
    fits = (nl >= config.min_leaf) & (n - nl >= config.min_leaf) & (hl >= config.min_hessian) & (h - hl >= config.min_hessian)
    gain = np.where(fits, gain, 0.0)
    at = int(gain.argmax())
    return float(gain.flat[at]), *divmod(at, gain.shape[1])


def _leaf_value(sums: np.ndarray, config: Config) -> float:
    g, h = sums[:2, 0].sum(1) / UNIT
    return float(-config.learning_rate * g / (h + config.l2))


def grow(gather, config: Config) -> Tree:
    """One tree. ``gather(tree, asks)`` gives the sums of the rows that reach leaf ``a`` and have feature ``f`` in a bin of at most ``c``, for each ask (a, f, c)."""
    tree = Tree()
    (root,) = gather(tree, [(0, 0, BINS - 1)])
    leaves = {0: _Node(root, *best_split(root, config))}
    while len(leaves) < config.leaves:
        at = max(leaves, key=lambda i: (leaves[i].gain, -i))
        node = leaves[at]
        if node.gain <= 0:
            break
        if node.below is None:  # one pass for all leaves that could be next
            open_ = [i for i, x in leaves.items() if x.gain > 0 and x.below is None]
            for i, sums in zip(open_, gather(tree, [(i, leaves[i].feature, leaves[i].cut) for i in open_])):
                leaves[i].below = sums
        del leaves[at]
        for child, sums in zip(tree.split(at, node.feature, node.cut), (node.below, node.sums - node.below)):
            leaves[child] = _Node(sums, *best_split(sums, config))
    for i, node in leaves.items():
        tree.value[i] = _leaf_value(node.sums, config)
    return tree


# ------------------------------------------------------------------------------- Spark


def _cuts(rows: DataFrame, columns: list[str]) -> list[list[float]]:
    """Upper bounds of the bins of each feature: its quantiles, at most BINS - 1."""
    at = [(i + 1) / BINS for i in range(BINS - 1)]
    found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), at, 20_000).alias(c) for c in columns]).first()
    return [sorted(set(x or [])) for x in found]


def _binned(rows: DataFrame, model: Model, weights: dict[int, float]) -> DataFrame:
    """(bins, label, weight, margin, n), a row of each pair."""

    def work(batches):
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]], 1)
            bins = pa.FixedSizeBinaryArray.from_buffers(pa.binary(values.shape[1]), len(values), [None, pa.py_buffer(model.bins(values).tobytes())]).cast(pa.binary())
            weight = np.where(label == 1, weights[1], weights[0])
            yield pa.RecordBatch.from_arrays([bins, pa.array(label), pa.array(weight), pa.array(np.full(len(label), model.start)), pa.array(np.ones(len(label), np.int64))], names=["bins", "label", "weight", "margin", "n"])

    return rows.select(F.col("label").cast("long"), *[F.col(c).cast("double") for c in model.columns]).mapInArrow(work, "bins binary, label long, weight double, margin double, n long")


def _collapsed(binned: DataFrame) -> DataFrame:
    """Equal rows once, with their number ``n``."""
    return binned.groupBy("bins", "label", "weight", "margin").agg(F.sum("n").alias("n"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _gather(table: DataFrame, since: list[Tree], tree: Tree, asks: list[tuple[int, int, int]], width: int) -> list[np.ndarray]:
    """Sums of each ask, as (gradient, second derivative, rows) x features x bins."""
    shape = (len(asks), 3, width, BINS)

    def work(batches):
        sums = np.zeros(shape, np.int64)
        ask_of = np.full(len(tree.feature), -1)
        ask_of[[a for a, _, _ in asks]] = np.arange(len(asks))
        feature, cut = np.array([f for _, f, _ in asks]), np.array([c for _, _, c in asks])
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, margin = _matrix(batch.column(0), width), batch.column(3).to_numpy()
            for t in since:
                margin = margin + t.margin(bins)
            ask = ask_of[tree.leaf_of(bins)]
            mine = np.flatnonzero((ask >= 0) & (bins[np.arange(len(bins)), feature[ask]] <= cut[ask]))
            p = 1 / (1 + np.exp(-margin[mine]))
            w, y, n = (batch.column(c).to_numpy()[mine] for c in (2, 1, 4))
            slot = ((ask[mine][:, None] * width + np.arange(width)) * BINS + bins[mine]).ravel()
            for k, x in enumerate((n * np.rint(w * (p - y) * UNIT), n * np.rint(w * p * (1 - p) * UNIT), n)):
                sums[:, k] += np.bincount(slot, np.repeat(x, width), len(asks) * width * BINS).astype(np.int64).reshape(len(asks), width, BINS)
        yield pa.RecordBatch.from_pydict({"ask": pa.array(range(len(asks)), pa.int32()), "sums": pa.array([s.tobytes() for s in sums], pa.binary())})

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), np.int64) for b in parts["sums"])
        return pa.table({"ask": parts["ask"][:1].cast(pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    found = table.mapInArrow(work, "ask int, sums binary").groupBy("ask").applyInArrow(add, "ask int, sums binary").collect()
    by_ask = {r.ask: np.frombuffer(r.sums, np.int64).reshape(shape[1:]) for r in found}
    return [by_ask.get(i, np.zeros(shape[1:], np.int64)) for i in range(len(asks))]


def _moved(table: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    """The rows with margins that know these trees too."""

    def work(batches):
        for batch in batches:
            bins, margin = _matrix(batch.column(0), width), batch.column(3).to_numpy()
            for t in trees:
                margin = margin + t.margin(bins)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(margin), batch.column(4)], names=["bins", "label", "weight", "margin", "n"])

    return table.mapInArrow(work, table.schema)


def train(rows: DataFrame, config: Config, columns: list[str]) -> Model:
    """A model of ``label`` (0 or 1) on balanced class weights. ``rows`` is read twice: a stored table."""
    sizes = {r[0]: r[1] for r in rows.groupBy("label").agg(F.count(F.lit(1))).collect()}
    if len(sizes) < 2:
        raise ValueError("training needs both classes")
    weights = {k: sum(sizes.values()) / (2 * n) for k, n in sizes.items()}  # both classes weigh the same, so the margin starts at 0
    model = Model(list(columns), _cuts(rows, list(columns)), 0.0, [])
    table, since, width = stored(_collapsed(_binned(rows, model, weights)), "binned"), [], len(model.columns)
    for _ in range(config.trees):
        tree = grow(lambda t, asks: _gather(table, since, t, asks, width), config)
        model.trees.append(tree)
        since.append(tree)
        if len(since) == REFRESH:
            now = stored(_moved(table, since, width), "binned")
            dropped(table)
            table, since = now, []
    dropped(table)
    return model
