"""Quality classifier by importance resampling.

Three hashed n-gram models are counted: the raw one over all documents, the target one over
labelled good documents, the negative one over labelled bad or toxic documents. A document's
importance weight is the ratio of its probability under target and raw, drawn by Gumbel
top-k: the k largest of ``log weight + Gumbel noise`` are a sample without replacement in
proportion to the weights.

* Models: each hashed feature is drawn for a document or not, so that a word repeated within
  one document, or a list of them, is one observation.
* Features: words and punctuation runs, word bigrams, and pairs of neighbours' forms (case,
  length, kind, and whether the token repeats one of the four before it). A bigram has two
  buckets of independent hashes and takes the ratio nearer to 1 of the two, since nearly all
  bigrams are rare and would else take over what they meet in a bucket.
* Ratio of a feature: ``(c + a) / (e + a)`` with c its target count and e the count expected
  from the raw model; below 1 also that expected from the labels, good and bad in their
  proportion, if it is larger.
* The log ratio is signed and speaks for the target as well as against it. It counts where
  chance does not explain it (the log likelihood ratio of the target's share of the feature is
  above CRITICAL) and beyond a dead zone: ``DEAD`` against the target, and for it ``REACH`` of
  the largest log ratio that there can be. So neither chance nor length of an ordinary text
  moves its weight from 1, at any number of labels.
* The target is part of the raw text, so no document is more than n / g times as likely under
  it, with n documents and g good labels: what speaks for a document counts up to log(n / g),
  what speaks against it counts in full.
* k: a parameter; by default the expected number of acceptances if each document were
  accepted with its weight, 1 at most.

The labelled samples are bounded (``max_labelled`` each, by hash of the id); the raw model,
the weights and k cover all documents. At most that many ids reach the driver.

Defined cases: NULL and empty texts have weight 1; rows of one id and text share key and
fate; rows tied at the k-th key are all kept; without good labels all documents are kept; a
NULL doc_id is a value like any other; texts are read whole, whatever their length; an empty table
stays empty. Columns log_weight and sample_key are replaced, others are carried.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnwork.llm.common import LOWER, SLICE, U, chunks, mix, slices, sum_slices, word_hash
from tarnwork.storage import stored

WORDS, PAIRS, BIGRAMS = 1 << 20, 1 << 17, 1 << 18  # few words meet in a bucket: one that meets a rejected word is rejected with it
LAGS = 4
SIZE = WORDS + PAIRS + 2 * BIGRAMS
PRIOR, DEAD, REACH, CRITICAL = 1.0, 1.6, 0.5, 8.0
MAX_LABELLED = 20_000
GATHER = 1 << 20
LOTS = SIZE // SLICE + 1  # the last slice holds the number of documents
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_AGAIN = U(0x51ED270B7A1FF7A3)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Buckets of every token: its word, its form and its predecessor's, the bigram's two; and the first token of each document."""
    kind = _CLASS[data]
    change = np.ones(len(kind) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    cuts = np.flatnonzero(change)
    keep = kind[cuts[:-1]] != 0 if len(kind) else np.zeros(0, bool)
    starts, ends = cuts[:-1][keep], cuts[1:][keep]
    bounds = np.searchsorted(starts, offsets)
    h = word_hash(LOWER[data], starts, ends)
    caps = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    n, up = ends - starts, caps[ends] - caps[starts]
    shape = np.where(up == 0, 0, np.where((up == n) & (n > 1), 2, 1)) + 3 * (kind[starts] == 2) + 6 * np.minimum(n, 7 + (n > 15) + (n > 40))
    at = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))  # place within the document
    lag = np.zeros(len(h), np.int64)
    for k in range(LAGS, 0, -1):  # equal to the k-th token before it; the nearest counts
        same = np.zeros(len(h), bool)
        same[k:] = h[k:] == h[:-k]
        lag[same & (at >= k)] = k
    word = np.where(lag == 1, _AGAIN, h)
    state = (shape * (LAGS + 1) + lag + 1).astype(np.uint64)
    before = np.where(at > 0, np.concatenate([[U(0)], state[:-1]])[: len(h)], U(0))
    bucket = lambda x, m: (mix(x) >> U(40)).astype(np.int64) & (m - 1)
    last = np.where(at > 0, np.concatenate([[U(0)], h[:-1]])[: len(h)], U(0))
    both = mix(last + U(0x9E3779B97F4A7C15)) ^ h
    first = WORDS + PAIRS
    return bucket(word, WORDS), bucket(before * U(1 << 20) + state, PAIRS) + WORDS, bucket(both, BIGRAMS) + first, bucket(both ^ _AGAIN, BIGRAMS) + first + BIGRAMS, bounds


def log_weights(log: np.ndarray, word: np.ndarray, pair: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What every token's features say for its document, and against it."""
    a, b = log[one], log[two]
    said = np.stack([log[word], log[pair], np.where(a * b > 0, np.where(np.abs(a) < np.abs(b), a, b), 0.0)])
    return np.maximum(said, 0.0).sum(0), np.minimum(said, 0.0).sum(0)


def _surprise(c: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Log likelihood ratio of c of n cases against the share p; below 0 where c is below it."""
    p = min(max(p, 1e-12), 1 - 1e-12)
    f = c / np.maximum(n, 1)
    out = c * np.log(np.maximum(f, 1e-12) / p) + (n - c) * np.log(np.maximum(1 - f, 1e-12) / (1 - p))
    return np.where(n > 0, np.where(f < p, -out, out), 0.0)


def log_ratio(raw: np.ndarray, good: np.ndarray, bad: np.ndarray, share: float) -> np.ndarray:
    """Log ratio of every bucket (0 where it says nothing) from document counts, their numbers last; share: of good labels among all."""
    n, g, b = raw[-1], good[-1], bad[-1]
    raw, good, bad = raw[:-1], good[:-1], bad[:-1]
    expected, sure = raw * (g / n), _surprise(good, raw, g / n)
    up = np.log((good + PRIOR) / (expected + PRIOR))
    low = sure
    if b:
        expected = np.maximum(expected, share * good + (1 - share) * bad * (g / b))
        low = np.minimum(sure, _surprise(good, good + bad, g / (g + b)))
    down = np.log((good + PRIOR) / (expected + PRIOR))
    reach = min(DEAD, REACH * most_log_weight(n, g))
    return np.where((down < -DEAD) & (low < -CRITICAL), down, np.where((up > reach) & (sure > CRITICAL), up, 0.0))


def most_log_weight(n: float, g: float) -> float:
    """The largest log weight of a document, with n documents of which g are labelled good."""
    return float(np.log(max(n, g, 1) / max(g, 1)))


def document_weights(up: np.ndarray, down: np.ndarray, bounds: np.ndarray, most: float) -> np.ndarray:
    """Log weights of documents from what their tokens say."""
    total = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[bounds])
    return np.round(np.minimum(total(up), most) + total(down), 9)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> np.ndarray | None:
    """Log ratio of every bucket (0 where it says nothing), and the largest log weight last; None without good labels."""
    spark = docs.sparkSession
    is_good, is_bad = (F.col("quality") == 1) & (F.col("toxic") == 0), (F.col("quality") == 0) | (F.col("toxic") == 1)
    found = []
    for side in (is_good, is_bad):
        rows = labels.filter(side & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i")).distinct()
        ids = [r[0] for r in rows.orderBy(F.xxhash64("i"), "i").limit(max_labelled).collect()]
        found.append((np.sort(np.array(ids, np.int64)), rows.count() if len(ids) == max_labelled else len(ids)))
    (good_ids, n_good), (bad_ids, n_bad) = found
    if not n_good:
        return None
    target = spark.sparkContext.broadcast((good_ids, bad_ids))

    def work(batches):
        counts = np.zeros((3, LOTS * SLICE), np.int32)
        waiting: list[list[np.ndarray]] = [[], [], []]

        def settle(least: int) -> None:
            for m, parts in enumerate(waiting):
                if sum(map(len, parts)) > least:
                    counts[m, :SIZE] += np.bincount(np.concatenate(parts), minlength=SIZE).astype(np.int32)
                    parts.clear()

        for batch in batches:
            id_values = batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            sides = [np.isin(id_values, wanted) for wanted in target.value]
            for i, j, data, offsets in chunks(batch.column(1)):
                *kinds, bounds = features(data, offsets)
                owner = np.repeat(np.arange(j - i), np.diff(bounds)) * SIZE
                for x in kinds:
                    seen = np.unique(owner + x)
                    document, seen = seen // SIZE, (seen % SIZE).astype(np.int32)
                    waiting[0].append(seen)
                    for m, side in enumerate(sides, 1):
                        waiting[m].append(seen[side[i:j][document]])
                counts[0, SIZE] += j - i
                for m, side in enumerate(sides, 1):
                    counts[m, SIZE] += side[i:j].sum()
                settle(GATHER)
        settle(0)
        yield slices(counts.ravel())

    sums = sum_slices(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(work, "slice int, part int, counts binary"))
    target.unpersist()
    raw, good, bad = (np.concatenate([sums.get(m * LOTS + s, np.zeros(SLICE, np.int64)) for s in range(LOTS)])[: SIZE + 1].astype(float) for m in range(3))
    return np.append(log_ratio(raw, good, bad, n_good / (n_good + n_bad)), most_log_weight(raw[SIZE], good[SIZE])) if good[SIZE] else None


def _gumbel(ids: np.ndarray, h: np.ndarray, seed: int) -> np.ndarray:
    u = mix(mix(ids.astype(np.int64).view(np.uint64) + U(seed)) ^ h)
    return -np.log(-np.log(((u >> U(11)).astype(float) + 0.5) / 2.0**53))


def weigh(docs: DataFrame, ratio: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, least: float | None = None, columns: list[str] | None = None) -> DataFrame:
    """``columns`` with log_weight and sample_key; with ``least`` only rows whose key reaches it."""
    columns = [c for c in (columns or docs.columns) if c not in ("log_weight", "sample_key")]
    at = columns.index(text_col) + 1 if text_col in columns else len(columns) + 1  # a text goes to Python once
    table = docs.sparkSession.sparkContext.broadcast(np.zeros(SIZE + 1) if ratio is None else ratio)

    def work(batches):
        log, most = table.value[:-1], float(table.value[-1])
        for batch in batches:
            ids = batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            weights, keys = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for i, j, data, offsets in chunks(batch.column(at)):
                *kinds, bounds = features(data, offsets)
                weights[i:j] = document_weights(*log_weights(log, *kinds), bounds, most)
                text = word_hash(data, offsets[:-1], offsets[1:])
                keys[i:j] = weights[i:j] + _gumbel(ids[i:j], text, seed)
            last = len(columns) + 1
            out = pa.RecordBatch.from_arrays([*batch.columns[1:last], pa.array(weights), pa.array(keys)], schema=pa.schema([*list(batch.schema)[1:last], ("log_weight", pa.float64()), ("sample_key", pa.float64())]))
            yield out if least is None else out.filter(pa.array(keys >= least))

    schema = docs.select(*columns).schema.add("log_weight", "double").add("sample_key", "double")
    text = [] if text_col in columns else [F.col(text_col).alias("__t")]
    return docs.select(F.col(id_col).cast("long").alias("__i"), *columns, *text).mapInArrow(work, schema)


def kth_largest(keys: DataFrame, k: int, bins: int = 1024) -> float:
    """The k-th largest ``sample_key``, by histograms that zoom in (``bins`` rows to the driver each)."""
    lo, hi = keys.agg(F.min("sample_key"), F.max("sample_key")).first()
    while True:
        width = (hi - lo) / bins
        inside = keys.filter((F.col("sample_key") >= lo) & (F.col("sample_key") <= hi))
        if not width or lo + width <= lo:
            return lo
        bin_of = F.least(F.floor((F.col("sample_key") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        rows = inside.groupBy(bin_of.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("sample_key").alias("lo"), F.max("sample_key").alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["b"]):
            if k <= r["n"]:
                if r["lo"] == r["hi"]:
                    return r["lo"]
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, columns: list[str] | None = None, max_labelled: int = MAX_LABELLED, k: int | None = None) -> DataFrame:
    """The drawn documents: ``columns`` (default: all) with log_weight and sample_key, which replace columns of those names."""
    ratio = fit(docs, labels, id_col, text_col, max_labelled)
    keys = stored(weigh(docs, ratio, id_col, text_col, seed, columns=[id_col]), "weights")
    n, total = keys.agg(F.count(F.lit(1)), F.sum(F.exp(F.least("log_weight", F.lit(0.0))))).first()
    k = round(total or 0) if k is None else k
    least = kth_largest(keys, max(1, min(n, k))) if n else 0.0
    if columns == [id_col]:
        return keys.filter(F.col("sample_key") >= least)
    return weigh(docs, ratio, id_col, text_col, seed, least, columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return sample(docs, labels, columns=["doc_id"])
