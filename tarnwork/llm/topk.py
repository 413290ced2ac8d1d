"""Exact top-k inner products by block-at-a-time pruning.

Terms are vector dimensions, weights ``floor(1024 * x)``. Candidates lie in groups of a
bounded number of rows, and in those in blocks, each with a forward index (its matrix) and the
largest and smallest weight of every term. The steps:

1. Vectors are dealt to groups by the nearest of a few pivots, so that a group's maxima say
   something. Pivots are a sample of at most ``PIVOTS`` rows; results do not depend on it.
2. Each query searches its own group: a first bound of its k-th score.
3. A (query, group) pair lives on only if the sum over terms of what the group could give at
   most reaches that bound. Only groups with such queries are shipped, to these queries.
4. In a group the blocks are ordered by that sum per query, and scored one after the other
   until it falls below the bound or the k-th score, whichever is higher.

Defined cases: a vector that is NULL or holds a NULL or a non-finite component takes no part;
shorter vectors count as padded with zeros; ties go to the smaller id. A row that repeats
another's id and vector counts once. An id with several vectors is a candidate with each of
them and asks with the smallest in array order; it never meets rows of its own id. Scores that
exceed 63 bits are plus or minus 2**63 - 1, and tie there. An empty table gives no row; vectors
may be of any length that fits a task. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tarnwork.storage import stored

GROUP, QUERIES, BLOCK = 2048, 1024, 128
PIVOTS = 1024
MOST = 2**63 - 1
SCALE = 1024


def _matrix(column: pa.Array, dim: int = 0) -> np.ndarray:
    rows = column.to_numpy(zero_copy_only=False)
    width = max([dim, *map(len, rows)])
    if all(len(r) == width for r in rows):
        x = np.stack(rows) if len(rows) else np.zeros((0, width))
    else:
        x = np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            x[i, : len(r)] = r
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(SCALE * x.astype(np.float64)))


def _dot(block: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles below 2**53, else in Python's integers, cut to 64 bits."""
    with np.errstate(over="ignore"):
        top = np.abs(block).max(initial=0) * np.abs(q).max(initial=0) * max(1, len(q))
    if top < 2**53:
        return (block @ q).astype(np.int64)
    ints = lambda a: np.vectorize(int, otypes=[object])(a)
    return np.array([max(-MOST, min(MOST, s)) for s in ints(block).dot(ints(q))], dtype=np.int64)


def upper(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(query, block): the sum over terms of the most that the block could give, rounded up."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        return np.nan_to_num(out + 1e-6 * np.abs(out), nan=np.inf, posinf=np.inf, neginf=-np.inf)


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, block: int = BLOCK, known: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """The best k (query, id, score) among these candidates, and how many blocks were scored.

    ``known``: scores that the k-th best of all candidates is known to reach; what lies below is left out.
    """
    # neighbours in value order make tighter blocks than arrival order
    order = np.lexsort((ids, *[x[:, d] for d in np.argsort(-np.minimum(x.max(axis=0) - x.min(axis=0), 1e300))[:1]])) if len(x) else np.arange(0)
    ids, x = ids[order], x[order]
    starts = np.arange(0, len(ids), block)
    bounds = upper(q, np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)) if len(ids) else np.zeros((len(q), 0))
    scored, out = 0, []
    for n in range(len(q)):
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor = -np.inf if known is None else float(known[n])
        for b in np.argsort(-bounds[n], kind="stable"):
            if bounds[n, b] < max(floor, float(best[-1]) if len(best) >= k else -np.inf):
                break
            scored += 1
            at = slice(starts[b], starts[b] + block)
            other = ids[at] != query_ids[n]
            all_ids = np.concatenate([best_ids, ids[at][other]])
            all_scores = np.concatenate([best, _dot(x[at], q[n])[other]])
            top = _top(all_scores, all_ids, k)
            best_ids, best = all_ids[top], all_scores[top]
        out += [(int(query_ids[n]), int(i), int(s)) for i, s in zip(best_ids, best) if s >= floor]
    return out, scored


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def _groups(good: DataFrame, n: int) -> DataFrame:
    """(id, v, q, g): every row once, with its group. Written, since pivots and counts must not change between uses."""
    spark = good.sparkSession
    at_most = max(1, min(PIVOTS, math.ceil(n / GROUP)))
    pivots = [r[0] for r in good.select("v", "id").orderBy(F.xxhash64("id"), "id", "v").limit(at_most).select("v").collect()]
    width = max([1, *map(len, pivots)])
    table = spark.sparkContext.broadcast(np.clip(np.array([[*p, *[0.0] * (width - len(p))] for p in pivots] or [[0.0]]), -1e100, 1e100))

    def nearest(batches):
        centre = table.value
        for batch in batches:
            x = np.clip(_matrix(batch.column(1)), -1e100, 1e100)[:, : centre.shape[1]]
            x = np.pad(x, ((0, 0), (0, centre.shape[1] - x.shape[1])))
            c = (SCALE * centre) @ x.T
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.argmin(((SCALE * centre) ** 2).sum(1)[:, None] - 2 * c, axis=0).astype(np.int32))], names=["id", "v", "q", "c"])

    near = stored(good.mapInArrow(nearest, f"id long, v {good.schema['v'].dataType.simpleString()}, q boolean, c int"), "vectors")
    first, deal = 0, []
    for c, rows in sorted(near.groupBy("c").agg(F.count(F.lit(1))).collect()):  # a row a pivot
        deal.append((c, first, math.ceil(rows / GROUP)))
        first += deal[-1][2]
    dealt = spark.createDataFrame(deal or [(0, 0, 1)], "c int, first int, parts int")
    return near.join(F.broadcast(dealt), "c").select("id", "v", "q", (F.col("first") + F.pmod(F.xxhash64("id", F.hash("v")), F.col("parts"))).cast("int").alias("g"))


def _arrays(table: pa.Table, id_col: str = "id") -> tuple[np.ndarray, np.ndarray]:
    return table[id_col].to_numpy(), _matrix(table["v"].combine_chunks())


def _alike(*parts: np.ndarray) -> list[np.ndarray]:
    width = max(p.shape[1] for p in parts)
    return [np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts]


def _once(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = list({(i, r.tobytes()): n for n, (i, r) in enumerate(zip(ids.tolist(), x))}.values())
    return ids[own], x[own]


def _long(rows) -> list[pa.Array]:
    return [pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [(), (), ()])]


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, counts=None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that ``is_query`` (a column) marks.

    ``counts``: two accumulators, for the blocks scored and for all (query, block) pairs.
    """
    fine = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine)
    )
    n = good.count()
    placed = stored(_groups(good, n), "groups")
    asks = placed.filter("q").groupBy("id").agg(F.min(F.struct("v", "g")).alias("m")).select("id", "m.v", "m.g")

    def at_home(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x = _arrays(left)
        found = []
        if right.num_rows:
            query_ids, q = _arrays(right)
            x, q = _alike(x, q)
            own, y = _once(ids, x)
            found, scored = search(own, y, query_ids, q, k)
            if counts:
                counts[0].add(scored)
        if counts:
            counts[1].add(-(-len(ids) // BLOCK))
        m = len(found) + 1  # the first row tells the group's bounds
        none = pa.array([None] * len(found), pa.list_(pa.float64()))
        box = lambda v: pa.concat_arrays([pa.array([v.tolist()], pa.list_(pa.float64())), none])
        cols = [pa.concat_arrays([pa.array([None], pa.int64()), c]) for c in _long(found)]
        return pa.table({"g": pa.array([left["g"][0].as_py()] * m, pa.int32()), **dict(zip(("query_id", "vec_id", "score"), cols)), "high": box(x.max(axis=0)), "low": box(x.min(axis=0))})

    home = placed.groupBy("g").cogroup(asks.groupBy("g")).applyInArrow(at_home, "g int, query_id long, vec_id long, score long, high array<double>, low array<double>")
    home = stored(home, "home")
    boxes, own = home.filter("high IS NOT NULL").select("g", "high", "low"), home.filter("query_id IS NOT NULL").select("query_id", "vec_id", "score")
    known = own.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("known"))
    asks = stored(asks.join(known, F.col("id") == F.col("query_id"), "left").select("id", "v", "g", "known"), "asks")

    n_asks, n_groups = asks.count(), boxes.count()
    lots, parts = max(1, math.ceil(n_asks / QUERIES)), max(1, math.ceil(n_groups / QUERIES))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    lot = F.pmod(F.xxhash64("id"), F.lit(lots)).cast("int")
    # a double may lie above the integer that it stands for
    floors = lambda t: np.nextafter(np.array([-np.inf if s is None else s for s in t["known"].to_pylist()], float), -np.inf)

    def reach(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = (np.zeros(0, np.int64),) * 2
        if left.num_rows and right.num_rows:
            g, high = right["g"].to_numpy(), right["high"].to_pylist()
            width = max(map(len, high))
            pad = lambda c: np.array([[*v, *[0.0] * (width - len(v))] for v in c])
            q, high, low = _alike(_matrix(left["v"].combine_chunks()), pad(high), pad(right["low"].to_pylist()))
            rows = np.nonzero((upper(q, high, low) >= floors(left)[:, None]) & (left["g"].to_numpy()[:, None] != g[None, :]))
            rows = (left["id"].to_numpy()[rows[0]], g[rows[1]])
        return pa.table({"id": pa.array(rows[0], pa.int64()), "g": pa.array(rows[1], pa.int32())})

    lots_of_boxes = boxes.select("g", "high", "low", F.pmod(F.hash("g"), F.lit(parts)).cast("int").alias("part")).withColumn("lot", every(lots))
    pairs = asks.withColumn("l", lot).withColumn("m", every(parts)).groupBy("l", "m").cogroup(lots_of_boxes.groupBy("lot", "part")).applyInArrow(reach, "id long, g int")
    pairs = stored(pairs.withColumn("l", lot), "reach")

    def away(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            (ids, x), (query_ids, q) = _arrays(left), _arrays(right)
            x, q = _alike(x, q)
            ids, x = _once(ids, x)
            found, scored = search(ids, x, query_ids, q, k, known=floors(right))
            if counts:
                counts[0].add(scored)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), _long(found))))

    there = placed.select("id", "v", "g").join(pairs.select("g", "l").distinct(), "g")
    asking = pairs.join(asks.select("id", "v", "known"), "id").select("id", "v", "known", F.col("g").alias("to"), F.col("l").alias("lot"))
    far = there.groupBy("g", "l").cogroup(asking.groupBy("to", "lot")).applyInArrow(away, "query_id long, vec_id long, score long")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.unionByName(far).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.w, b.w) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
