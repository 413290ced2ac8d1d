"""Ratios of many pairs at once are those of single pairs."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwork.functions import batch_similarity as batch
from tarnwork.functions import similarity as S

WORDS = ["acme", "inc", "ltd", "global", "trading", "co", "st", "rd", "12", "7", "blue", "x", "é", "漢字", "international", "a"]


def _pairs(seed, n):
    rng = random.Random(seed)

    def text():
        t = " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 14])))
        if rng.random() < 0.3 and t:
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice("abc d　é") + t[i + 1 :]
        if rng.random() < 0.05:
            t = " " * rng.randint(0, 3) + t + rng.choice(["", "\t", "\n\x1c"])
        return t * rng.randint(2, 12) if rng.random() < 0.02 else t

    a = [text() for _ in range(n)]
    b = [x if rng.random() < 0.05 else x[: rng.randrange(len(x) + 1)] + text() if rng.random() < 0.3 else text() for x in a]
    return [None, "", None, "x", *a], ["x", "", None, None, *b]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_single_pairs(seed, monkeypatch):
    """Also when tables, lanes and windows are worked through in many small parts."""
    if seed == 3:
        for name, value in (("TABLE_WORDS", 40), ("LANES", 3), ("WINDOWS", 50)):
            monkeypatch.setattr(batch, name, value)
    a, b = _pairs(seed, 6000 if seed < 3 else 150)
    got = zip(*batch.all_ratios(pa.array(a, pa.string()), pa.array(b, pa.string())))
    assert [tuple(map(float, g)) for g in got] == [(S.ratio(x, y), S.token_set(x, y), S.weighted(x, y)) for x, y in zip(a, b)]


def test_long_texts_and_many_symbols():
    """Hundreds of words of state with carries between them, and more symbols than a table of letters has."""
    rng = random.Random(5)
    long = "".join(rng.choice("ab") for _ in range(3000))
    wide = "".join(chr(0x4E00 + i) for i in range(2500))
    a = [long, wide, long[:64], long[:65], "a" * 200, wide[100:140]]
    b = [long[1500:] + long[:1500], wide[::-1], long[1:65], long[1:66], "a" * 199 + "b", wide]
    got = batch.ratios(pa.array(a), pa.array(b))
    assert got.tolist() == [S.ratio(x, y) for x, y in zip(a, b)]
    assert batch.weighted_ratios(pa.array(a[-1:]), pa.array(b[-1:])).tolist() == [S.weighted(a[-1], b[-1])]


def test_windows_are_skipped(monkeypatch):
    """Few windows of a long text are looked at when one of them matches."""
    rng = random.Random(9)
    hay = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(4000))
    short, asked, plain = hay[1600:1900], [], batch.lcs
    monkeypatch.setattr(batch, "lcs", lambda p, row, *rest: asked.append(len(row)) or plain(p, row, *rest))
    best = batch.partial(batch.Texts(pa.array([short])), batch.Texts(pa.array([hay])), np.zeros(1))
    assert best.tolist() == [1.0] and sum(asked) < 4299 / 5


def test_udfs(spark):
    a, b = _pairs(4, 200)
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(a)), "a": a, "b": b}))
    three = S.all_ratios(F.col("a"), F.col("b"))
    rows = df.select("i", "a", "b", S.indel_ratio_arrow("a", "b").alias("r"), S.token_set_ratio_arrow("a", "b").alias("t"), S.weighted_ratio("a", "b").alias("w"), three["ratio"].alias("r3"), three["wratio"].alias("w3")).collect()
    for r in rows:
        want = S.ratio(r.a, r.b), S.token_set(r.a, r.b), S.weighted(r.a, r.b)
        assert (r.r, r.t, r.w) == want and (r.r3, r.w3) == (want[0], want[2])
    plan = df.select(three["ratio"].alias("x"), three["wratio"].alias("y"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.split("ArrowEvalPython", 1)[1].split("]", 1)[0].count("all_ratios(") == 1
    assert df.limit(0).select(three["ratio"]).count() == 0
