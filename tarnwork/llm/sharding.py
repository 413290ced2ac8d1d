"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``2**ring_bits`` cells. Every shard owns ``vnodes`` points on it; a key hashes
to a cell and belongs to the first shard clockwise. A shard that is full passes what it
can't take on to the next distinct shard clockwise, so loads are bounded and a key leaves
its home only if its home is full of keys that live there.

Only the ring is planned on the driver: at most ``2**ring_bits`` counts, whatever the number
of rows. Rows are ranked within a part of their cell (one shuffle of narrow rows; a cell has
``PARTS`` parts, by the columns in ``order``, so that a key which very many rows share is
ranked by many tasks) and find shard and slot in the plan.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window, functions as F

from tarnwork.storage import stored

LAW = "rows"
PARTS = 16


def ring_walks(n_shards: int, vnodes: int, ring_bits: int) -> list[tuple[int, ...]]:
    """For each cell, all shards in the order in which a key from there meets them."""
    cells = 1 << ring_bits
    points: dict[int, list[tuple[bytes, int]]] = {}
    for s in range(n_shards):
        for v in range(vnodes):
            digest = hashlib.md5(f"{s}/{v}".encode()).digest()
            points.setdefault(int.from_bytes(digest[:8], "big") % cells, []).append((digest, s))
    walk: tuple[int, ...] = ()
    out: list[tuple[int, ...]] = [()] * cells
    for lap in range(2):  # the second lap knows what lies beyond the end of the ring
        for c in range(cells - 1, -1, -1):
            for _, s in sorted(points.get(c, ()), reverse=True):
                walk = (s, *[x for x in walk if x != s])
            out[c] = walk
    return out


def capacities(total: int, n_shards: int, slack: float) -> list[int]:
    """The load bound of each shard; without slack the counts are at most one apart."""
    if slack:
        return [-int(-total * (1 + slack) // n_shards)] * n_shards
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def plan(counts: dict[int, int], walks: list[tuple[int, ...]], free: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, rank after the last, shard, first slot): homes first, then onward clockwise."""
    left = dict(counts)
    done = dict.fromkeys(counts, 0)
    used = [0] * len(free)
    pieces = []
    for step in range(len(free)):
        for cell in sorted(left):
            shard = walks[cell][step]
            take = min(left[cell], free[shard] - used[shard])
            if take:
                pieces.append((cell, done[cell], done[cell] + take, shard, used[shard]))
                used[shard] += take
                done[cell] += take
                left[cell] -= take
        left = {c: n for c, n in left.items() if n}
    return pieces


def assign(df: DataFrame, key: str = "doc_id", order: tuple[str, ...] = (), n_shards: int = 16, vnodes: int = 128, ring_bits: int = 14, slack: float = 0.0) -> DataFrame:
    """``df`` with ``shard`` and a gapless ``slot``.

    Rows that agree in key and ``order`` are interchangeable. A NULL key is a key like any
    other. Columns named shard or slot are replaced. An empty table stays empty.
    """
    spark = df.sparkSession
    cell = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << ring_bits)).cast("int")
    part = F.pmod(F.xxhash64(F.lit(7), F.col(key), *order), F.lit(PARTS)).cast("int")
    per = stored(df.groupBy(cell.alias("__c"), part.alias("__p")).agg(F.count(F.lit(1)).alias("__n")), "cells")  # at most PARTS rows a cell
    counts = {r[0]: r[1] for r in per.groupBy("__c").agg(F.sum("__n")).collect()}  # one row a cell
    pieces = plan(counts, ring_walks(n_shards, vnodes, ring_bits), capacities(sum(counts.values()), n_shards, slack))
    table = spark.createDataFrame(pieces or [(0, 0, 0, 0, 0)], "__c int, __lo long, __hi long, shard int, __base long")
    before = Window.partitionBy("__c").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("__c", "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    rank = Window.partitionBy("__c", "__p").orderBy(F.xxhash64(F.col(key)), F.col(key), *order)
    ranked = df.drop("shard", "slot").withColumns({"__c": cell, "__p": part}).withColumn("__i", F.row_number().over(rank) - 1).join(F.broadcast(starts), ["__c", "__p"])
    ranked = ranked.withColumn("__r", (F.col("__s") + F.col("__i")).cast("long"))
    # counts and plan have at most PARTS and n_shards rows a cell: bounds that the data can't move
    placed = ranked.join(F.broadcast(table), "__c").filter((F.col("__r") >= F.col("__lo")) & (F.col("__r") < F.col("__hi")))
    return placed.withColumn("slot", F.col("__base") + F.col("__r") - F.col("__lo")).drop("__c", "__p", "__s", "__i", "__r", "__lo", "__hi", "__base")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32")
    )
    out = assign(docs, order=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
