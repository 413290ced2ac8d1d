"""Exact top-n of any size without a task that holds the n rows.

The n-th row in the wanted order is found by counting: rows are counted in ``BINS`` bins of
the first key, the bin that holds the n-th row is divided again, and so on until a bin has one
value or few enough rows to look at. Ties go on to the next key. What is returned is the
table behind a filter with the keys of the n-th row: no sort, no shuffle of rows, and each pass
brings at most ``BINS`` counts (or ``FEW`` keys) to the driver, whatever n is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BINS = 2048
FEW = 2000
_LAST = 8e307


def md5_keys(text: Column) -> list[Column]:
    """Integers in whose order a text's md5 digests lie."""
    digest = F.md5(text)
    part = lambda start, n: F.conv(F.substring(digest, start, n), 16, 10).cast("bigint")
    return [part(1, 15), part(16, 15), part(31, 2)]


def _as_key(c: Column, kind: str) -> Column:
    """A key as a finite double or a long; NULL (and NaN) last."""
    if kind in ("float", "double", "decimal"):
        return F.when(c.isNull() | F.isnan(c.cast("double")), _LAST).otherwise(F.greatest(F.least(c.cast("double"), F.lit(_LAST)), F.lit(-_LAST)))
    return F.coalesce(c.cast("bigint"), F.lit(2**63 - 1))


def _place(key: str, low, high) -> Column:
    """The bin of a key: at least two bins have rows if ``low`` and ``high`` differ."""
    if isinstance(low, float):
        return F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(max((high - low) / BINS, 5e-324))), F.lit(BINS - 1)).cast("int")
    width = -(-(high - low + 1) // BINS)
    if high - low < 2**52:
        return F.floor((F.col(key) - F.lit(low)) / F.lit(width)).cast("int")
    number = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    return F.call_function("div", F.col(key).cast("decimal(20,0)") - number(low), number(width)).cast("int")


def _nth(rows: DataFrame, key: str, n: int):
    """(value of the n-th smallest key, rows with a smaller one, rows with that one), 1 <= n <= number of rows."""
    before, part = 0, rows.select(key)
    while True:
        low, high, count = part.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        if low == high:
            return low, before, count
        if count <= FEW:
            values = sorted(r[0] for r in part.collect())
            value = values[n - before - 1]
            return value, before + sum(v < value for v in values), values.count(value)
        place = _place(key, low, high)
        counts = dict(part.groupBy(place.alias("bin")).agg(F.count(F.lit(1))).collect())
        for b in sorted(counts):
            if before + counts[b] >= n:
                break
            before += counts[b]
        part = part.filter(place == b)


def top_n(df: DataFrame, n: int, *keys: Column) -> tuple[DataFrame, DataFrame]:
    """(the first ``n`` rows in ascending order of ``keys``, the other rows), both in no order.

    ``df`` is read several times: a stored table. Keys are numbers; NULL comes last. Rows that
    tie in all keys are interchangeable: as many as needed are taken, by their place in the
    table. All rows are first if there are no more than ``n``.
    """
    names = [f"__key{i}" for i in range(len(keys) + 1)]
    kinds = [t.split("(")[0] for _, t in df.select(*keys).dtypes]
    rows = df.withColumns({names[i]: _as_key(k, kinds[i]) for i, k in enumerate(keys)})
    numbered = rows.withColumn(names[-1], F.monotonically_increasing_id())
    drop = lambda t: t.select(*df.columns)
    if n <= 0:
        return df.limit(0), df
    if rows.count() <= n:
        return df, df.limit(0)
    tied, left, cut = numbered, n, []
    for name in names:
        value, before, equal = _nth(tied, name, left)
        cut.append((name, value))
        left -= before
        if left == equal:  # all rows up to here belong to the first
            break
        tied = tied.filter(F.col(name) == F.lit(value))
    # rows before the last one, key by key, or equal to it in all keys that were needed
    first = F.lit(True)
    for name, value in reversed(cut):
        key = F.col(name)
        first = (key < F.lit(value)) | ((key == F.lit(value)) & first)
    return drop(numbered.filter(first)), drop(numbered.filter(~first))
