"""Byte-level helpers: words and their hashes straight from Arrow buffers.

A batch is worked through in chunks of about a megabyte of text, so that the arrays
(eight bytes for each byte of text) stay small whatever the batch size is. One document
is never cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

CHUNK = 1 << 20
SLICE = 1 << 15
LANES = 8
MARK_BITS = 1 << 22
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if which not in _powers or len(_powers[which][0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        out = []
        for b in (BASE[which], pow(BASE[which], -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[which] = (out[0], out[1])
    p, q = _powers[which]
    return p[:n], q[:n]


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """P with P[j] - P[i] = sum of BYTE[data[k]] * BASE**k over i <= k < j.

    For short spans only (a rolling hash): a polynomial modulo 2**64 has colliding pairs of
    a thousand bytes. Words have :func:`word_hash`.
    """
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE[data] * powers(len(data), which)[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the bytes [start, end), the same wherever they stand."""
    inverse = powers(len(prefix), which)[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * U(0xA24BAED4963EE407))


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32, n + 1, column.offset * (8 if large else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        j = min(j, n, i + 4096)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, starts, ends, first word of each document and the total)."""
    low = fold[data]
    inside = ~space[low]
    first = inside.copy()
    last = inside.copy()
    if len(inside) > 1:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return low, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes [start, end) of each word.

    Eight bytes at a time go through a bijective mix, so words of up to eight bytes can't
    collide with others of their length and no family of strings does by construction, as
    it would under a polynomial modulo a power of two. Words beyond LANES * 8 bytes are
    hashed one by one.
    """
    n = ends - starts
    out = mix(n.astype(np.uint64) * U(0xA24BAED4963EE407) + U(0x9FB21C651E98DF25))
    if not len(n):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    rows = np.flatnonzero(n <= LANES * 8)
    for k in range(LANES):
        rows = rows[n[rows] > 8 * k]
        if not len(rows):
            break
        left = np.minimum(n[rows] - 8 * k, 8).astype(np.uint64)
        lane = lanes[starts[rows] + 8 * k] & (~U(0) >> (U(64) - U(8) * left))
        out[rows] = mix(out[rows] ^ lane) + U(0x9E3779B97F4A7C15)
    for i in np.flatnonzero(n > LANES * 8):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), 0x51ED)
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, **kind) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each document's words begin."""
    low, starts, ends, bounds = words(data, offsets, **kind)
    return word_hash(low, starts, ends), bounds


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes (also across documents: the caller cuts)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * U((0x9E3779B97F4A7C15 * (2 * k + 1) + 0x5851F42D4C957F2D * k * 2) % 2**64 | 1)
    return mix(out)


def doc_shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles of one document; a shorter one is a single shingle."""
    if not len(h):
        return np.zeros(0, np.uint64)
    if len(h) < n:
        return ngrams(h, len(h)) ^ U(len(h))
    return np.unique(ngrams(h, n))


def slices(counts: np.ndarray) -> pa.RecordBatch:
    """A task's counts as compressed slices, dealt to up to 16 partial sums."""
    rows = [(i, counts[i * SLICE : (i + 1) * SLICE]) for i in range(len(counts) // SLICE)]
    rows = [(i, zlib.compress(c.astype(np.int64).tobytes(), 1)) for i, c in rows if c.any()]
    part = int(counts[:SLICE].sum()) % 16
    return pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["slice", "part", "counts"]
    )


def sum_slices(found: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the slices of all tasks; one row a slice comes to the driver, whatever the input."""

    def total(table: pa.Table) -> pa.Table:
        out = np.zeros(SLICE, np.int64)
        for b in table["counts"]:
            out += np.frombuffer(zlib.decompress(b.as_py()), np.int64)
        return pa.table({"slice": table["slice"][:1].cast(pa.int32()), "counts": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

    spread = found.groupBy("slice", "part").applyInArrow(total, "slice int, counts binary")
    return {r[0]: np.frombuffer(zlib.decompress(r[1]), np.int64) for r in spread.groupBy("slice").applyInArrow(total, "slice int, counts binary").collect()}


def bitmap(keys: DataFrame, key: str, bits: int = MARK_BITS) -> np.ndarray:
    """A bitmap of fixed size with the slot of every value of ``key`` set (``bits`` / 32 rows to the driver at most)."""
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 32).cast("int"))
    table = np.zeros(bits // 32, np.int64)
    for w, found in keys.groupBy((slot / 32).cast("int").alias("w")).agg(F.bit_or(one).alias("bits")).collect():
        table[w] = found
    return table


def marked(rows: DataFrame, keys: DataFrame, key: str, then=None, schema: str | None = None) -> DataFrame:
    """The rows whose ``key`` may be among ``keys``; a false one costs time only, a join decides.

    ``then`` makes rows of ``schema`` of their batches in the same worker; as a step of its own
    it would keep a second Python worker for every task.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(bitmap(keys, key))
    slot = F.pmod(F.xxhash64(key), F.lit(MARK_BITS)).alias("__slot")

    def kept(batches):
        bits = shared.value
        for batch in batches:
            slots = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(batch.columns[1:], schema=pa.schema(list(batch.schema)[1:])).filter(pa.array(((bits[slots >> 5] >> (slots & 31)) & 1).astype(bool)))

    work = kept if then is None else lambda batches: then(kept(batches))
    return rows.select(slot, *rows.columns).mapInArrow(work, schema or rows.schema)
