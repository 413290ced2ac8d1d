"""String similarity on [0, 1].

``indel_ratio`` and ``token_set_ratio`` are native expressions (an LCS row is
carried through nested ``aggregate`` calls): for short texts, and to be compared with
SQL. ``indel_ratio_arrow``, ``token_set_ratio_arrow``, ``weighted_ratio`` and
``all_ratios`` are the Arrow UDFs for volume, which work on all pairs of a batch at once
(:mod:`tarnwork.functions.batch_similarity`). ``ratio``, ``token_set`` and ``weighted``
are the same values for a single pair.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tarnwork.functions import batch_similarity as batch


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    other = _chars(b)
    first = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def next_row(row: Column, ch: Column) -> Column:
        cells = F.arrays_zip(other.alias("c"), F.slice(row, 1, F.length(b)).alias("d"), F.slice(row, 2, F.length(b)).alias("u"))
        grow = lambda out, x: F.concat(
            out, F.array(F.when(x["c"] == ch, x["d"] + 1).otherwise(F.greatest(x["u"], F.element_at(out, -1))))
        )
        return F.aggregate(cells, F.array(F.lit(0)), grow)

    return F.when((a == "") | (b == ""), F.lit(0)).otherwise(F.element_at(F.aggregate(_chars(a), first, next_row), -1))


def indel_ratio(a: Column, b: Column) -> Column:
    """``2 * LCS / (len a + len b)``; 0 if either side is empty."""
    total = F.length(a) + F.length(b)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(2.0 * lcs_length(a, b) / total)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best Indel ratio among sorted intersection and differences of word sets."""
    words = lambda x: F.array_sort(F.array_distinct(F.filter(F.split(x, " "), lambda w: w != "")))
    wa, wb = words(a), words(b)
    both = F.array_sort(F.array_intersect(wa, wb))
    only_a, only_b = F.array_sort(F.array_except(wa, wb)), F.array_sort(F.array_except(wb, wa))
    join = lambda *xs: F.array_join(F.concat(*xs), " ")
    base, left, right = join(both), join(both, only_a), join(both, only_b)
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when((F.size(both) > 0) & ((F.size(only_a) == 0) | (F.size(only_b) == 0)), F.lit(1.0))
        .otherwise(F.greatest(indel_ratio(left, right), indel_ratio(base, left), indel_ratio(base, right)))
    )


def _lcs(a: str, b: str) -> int:
    """Bit-parallel LCS (Hyyro 2004)."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & where.get(ch, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def ratio(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 2 * _lcs(a, b) / (len(a) + len(b))


def _sorted(words) -> str:
    return " ".join(sorted(words))


def token_set(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    wa, wb = set(a.split()), set(b.split())
    if not wa or not wb:
        return 0.0
    both, only_a, only_b = sorted(wa & wb), sorted(wa - wb), sorted(wb - wa)
    if both and (not only_a or not only_b):
        return 1.0
    base, left, right = " ".join(both), " ".join(both + only_a), " ".join(both + only_b)
    return max(ratio(left, right), ratio(base, left), ratio(base, right))


def token_sort(a: str, b: str) -> float:
    return ratio(_sorted(a.split()), _sorted(b.split()))


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text and a window of the longer one, windows over its ends included."""
    if not a or not b:
        return 0.0
    best = 0.0
    for short, long in ([(a, b), (b, a)] if len(a) == len(b) else [tuple(sorted((a, b), key=len))]):
        width = len(short)
        for i in range(1 - width, len(long)):
            best = max(best, ratio(short, long[max(0, i) : i + width]))
            if best == 1.0:
                return best
    return best


def partial_token(a: str, b: str) -> float:
    """1 where a word is shared; else the best partial ratio of the sorted words, repeated or not."""
    wa, wb = a.split(), b.split()
    if set(wa) & set(wb):
        return 1.0
    return max(partial(_sorted(wa), _sorted(wb)), partial(_sorted(set(wa)), _sorted(set(wb))))


def weighted(a: str | None, b: str | None) -> float:
    """The usual weighted blend of whole, token and partial ratios (WRatio), on [0, 1]."""
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    if spread < 1.5:
        return max(ratio(a, b), 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if spread <= 8 else 0.6
    return max(ratio(a, b), scale * partial(a, b), 0.95 * scale * partial_token(a, b))


def _arrow(x: pd.Series) -> pa.Array:
    return pa.array(x, pa.string(), from_pandas=True)


@F.pandas_udf(DoubleType())
def indel_ratio_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(batch.ratios(_arrow(a), _arrow(b)))


@F.pandas_udf(DoubleType())
def token_set_ratio_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(batch.token_set_ratios(_arrow(a), _arrow(b)))


@F.pandas_udf(DoubleType())
def weighted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(batch.weighted_ratios(_arrow(a), _arrow(b)))


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("ratio", "token_ratio", "wratio")]))
def all_ratios(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The three ratios in one pass over the texts."""
    return pd.DataFrame(dict(zip(("ratio", "token_ratio", "wratio"), batch.all_ratios(_arrow(a), _arrow(b)))))


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("ratio", "token_ratio")]))
def two_ratios(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The ratios but the weighted one in one pass over the texts."""
    return pd.DataFrame(dict(zip(("ratio", "token_ratio"), batch.two_ratios(_arrow(a), _arrow(b)))))
