"""Benchmark decontamination by spaced-seed hashing.

Fixed masks ignore some positions of a run of tokens, so a run hashes alike even where a
token at an ignored position was replaced. The steps:

1. Items are tokenized and hashed on the executors; each run of ``SPAN`` tokens gives a seed a
   mask. A shorter item gives one seed, the hash of all its tokens.
2. Documents are hashed alike. Seeds that a bitmap of fixed size rules out are dropped where
   they arise; the rest are joined with the items' seeds, salted by document.
3. Each (document, item, diagonal) that was hit is verified: the item is laid over the
   document, and the overlap that tolerates substitutions decides. Only texts of documents
   that were hit are shuffled.

A hit has at least ``MIN_MATCH`` equal tokens, or the whole item, and ``PENALTY`` equal tokens
for each substitution.

Defined cases: NULL and empty texts hit nothing. Items under ``SPAN`` tokens are found where
all their tokens stand in a row; items under ``SHORTEST`` tokens are words, not passages, and
are not searched. One row for each (id, text, item): repeated rows and items are reported
once, rows of one id with different texts each for itself. A NULL doc_id is reported as NULL.
Texts may have any length; an empty table, of documents or of items, gives no row. Other columns
are not read, whatever their names are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnwork.llm.common import LOWER, U, chunks, marked, mix, word_hashes
from tarnwork.storage import stored

#: 1 counts, 0 is ignored.
MASKS = ("111111111111", "110110110110", "101011010111", "111010110101")
SPAN = 12
SHORTEST = 5
MIN_MATCH, PENALTY = 13, 4  # tokens equal at least; a substitution costs four matches (0.8 identity)
SIEVE_BITS = 1 << 24
SALT = 16
_KIND = np.ones(256, bool)
_KIND[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False  # all but letters, digits and non-ASCII separates
_WEIGHT = mix(np.arange(1, SPAN + 1, dtype=np.uint64)) | U(1)


def tokens(column) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return [(i, *word_hashes(data, offsets, space=_KIND, fold=LOWER)) for i, _, data, offsets in chunks(column)]


def seeds(h: np.ndarray) -> list[np.ndarray]:
    """Per mask the hash of each run of SPAN tokens."""
    n = len(h) - SPAN + 1
    if n <= 0:
        return [np.zeros(0, np.uint64) for _ in MASKS]
    out = []
    for m, mask in enumerate(MASKS):
        s = np.full(n, m + 1, np.uint64)
        for k, bit in enumerate(mask):
            if bit == "1":
                s += h[k : k + n] * _WEIGHT[k]
        out.append(mix(s))
    return out


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` (less than SPAN) tokens."""
    n = len(h) - size + 1
    s = np.full(max(n, 0), len(MASKS) + size, np.uint64)
    for k in range(size if n > 0 else 0):
        s += h[k : k + n] * _WEIGHT[k]
    return mix(s)


def best_overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(equal tokens, first, last + 1 in the document) of the best run of the item laid at ``diagonal``.

    The best-scoring run; where that has too few equal tokens, the run with most of them that
    has PENALTY matches to each substitution: it can hold substitutions near its ends.
    """
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    equal = doc[lo + diagonal : hi + diagonal] == item[lo:hi]
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -PENALTY))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmin(total[: end + 1]))
    if equal[start:end].sum() < min(MIN_MATCH, len(item)):
        first = np.searchsorted(-low, -total)  # for each end the longest run whose score is not below 0
        seen = np.concatenate([[0], np.cumsum(equal)])
        end = int(np.argmax(seen - seen[first]))
        places = np.flatnonzero(equal[first[end] : end]) + first[end]
        start, end = (int(places[0]), int(places[-1]) + 1) if len(places) else (0, 0)
    return int(equal[start:end].sum()), lo + diagonal + start, lo + diagonal + end


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, tokens, seeds, places) of every item that is long enough."""

    def work(batches):
        for batch in batches:
            for i, h, bounds in tokens(batch.column(1)):
                rows = []
                for d in range(len(bounds) - 1):
                    own = h[bounds[d] : bounds[d + 1]]
                    if len(own) >= SHORTEST:
                        found = seeds(own) if len(own) >= SPAN else [run_hashes(own, len(own))]
                        rows.append((i + d, own, np.concatenate(found), np.concatenate([np.arange(len(f)) for f in found])))
                if rows:
                    row, *columns = zip(*rows)
                    ends = lambda c: pa.array(np.cumsum([0, *map(len, c)]), pa.int32())
                    lists = [pa.ListArray.from_arrays(ends(c), _i64(np.concatenate(c))) for c in columns]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *lists], names=["item_id", "tokens", "seeds", "places"])

    base = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(work, "item_id long, tokens array<long>, seeds array<long>, places array<long>").dropDuplicates(["item_id", "tokens"])


def sieve(seeded: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of all seeds (at most SIEVE_BITS / 64 words reach the driver)."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftrightunsigned(F.col("s"), 64 - SIEVE_BITS.bit_length() + 1 + 6)
    table = np.zeros(SIEVE_BITS // 64, np.int64)
    for w, bits in seeded.groupBy(word.alias("w")).agg(F.bit_or(bit)).collect():
        table[w] = bits
    return table


def _in_sieve(table: np.ndarray, s: np.ndarray) -> np.ndarray:
    word = (s >> U(64 - SIEVE_BITS.bit_length() + 1 + 6)).astype(np.int64)
    return (table.view(np.uint64)[word] >> (s & U(63)) & U(1)).astype(bool)


def candidates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(__i, __t, item, diagonals): what the seeds of documents (__i: id, __t: digest of the text) and items have in common."""
    spark = docs.sparkSession
    seeded = stored(found.select(F.col("item"), F.explode(F.arrays_zip("seeds", "places")).alias("x")).select("item", F.col("x.seeds").alias("s"), F.col("x.places").alias("p")), "seeds")
    short = [r[0] for r in found.filter(F.size("tokens") < SPAN).select(F.size("tokens")).distinct().collect()]  # at most SPAN - SHORTEST
    shared = spark.sparkContext.broadcast(sieve(seeded))

    def work(batches):
        table = shared.value
        for batch in batches:
            for i, h, bounds in tokens(batch.column(2)):
                for at, s in [(SPAN, s) for s in seeds(h)] + [(n, run_hashes(h, n)) for n in short]:
                    p = np.flatnonzero(_in_sieve(table, s))
                    d = np.searchsorted(bounds, p, "right") - 1
                    whole = p + at <= bounds[d + 1]  # a run across two documents is none
                    p, d = p[whole], d[whole]
                    if len(p):
                        rows = pa.array(i + d)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), _i64(s[p]), pa.array(p - bounds[d])], names=["__i", "__t", "s", "at"])

    hits = docs.select("__i", "__t", "text").mapInArrow(work, "__i long, __t long, s long, at long")
    # a seed that very many documents share is dealt over the salts; the items' side is repeated for each
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("__i", "__t"), F.lit(SALT)).cast("int"))
    spread = seeded.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALT)])))
    pairs = salted.join(spread, ["s", "salt"]).select("__i", "__t", "item", (F.col("at") - F.col("p")).alias("diagonal"))
    return pairs.groupBy("__i", "__t", "item").agg(F.collect_set("diagonal").alias("diagonals"))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, matched, first_token, last_token) of every overlap of a document and an item."""
    base = docs.select(F.col(id_col).cast("long").alias("__i"), F.xxhash64(text_col).alias("__t"), F.col(text_col).alias("text"))
    found = stored(items(benchmark, item_col, item_text).withColumn("item", F.monotonically_increasing_id()), "items")
    hit = stored(candidates(base, found), "candidates")
    laid = hit.join(found.select("item", "item_id", "tokens"), "item")
    texts = marked(base, hit.select("__t").distinct(), "__t").dropDuplicates(["__i", "__t"])
    full = laid.join(texts.withColumnRenamed("__i", "__j").withColumnRenamed("__t", "__u"), F.col("__i").eqNullSafe(F.col("__j")) & (F.col("__t") == F.col("__u")))

    def work(batches):
        for batch in batches:
            kept = []
            wanted, diagonals = batch.column(2), batch.column(3)
            last, words = None, None
            for r, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key != last:
                    last, words = key, tokens(batch.column(4).slice(r, 1))[0][1]
                item = wanted[r].values.to_numpy().view(np.uint64)
                best = (0, 0, 0)
                for diagonal in sorted(diagonals[r].values.to_pylist()):
                    m, a, b = best_overlap(words, item, diagonal)
                    best = max(best, (m, -a, b))
                if best[0] >= min(MIN_MATCH, len(item)):
                    kept.append((r, best[0], -best[1], best[2] - 1))
            if kept:
                rows, *numbers = zip(*kept)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(rows)) for c in (0, 5)] + [pa.array(c, pa.int64()) for c in numbers], names=["__i", "item_id", "matched", "first_token", "last_token"])

    rows = full.select("__i", "__t", "tokens", "diagonals", "text", "item_id").mapInArrow(work, "__i long, item_id long, matched long, first_token long, last_token long")
    return rows.withColumnRenamed("__i", id_col)


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark passage (all rows of such an id)."""
    hit = find(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("__hit")).distinct()
    return docs.join(hit, F.col(id_col).cast("long").eqNullSafe(F.col("__hit")), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
