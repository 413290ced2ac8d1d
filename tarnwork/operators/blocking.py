"""Staged candidate generation: exact name, rare token, name prefix.

Within a bucket every source ranks the targets alike (by md5 of the target id), so a
bucket never has to give more rows than one source may keep. The indexes use that: each
bucket is cut *before* the join, and a hot name or prefix costs ``cap * sources`` rows
rather than ``targets * sources``. The bucket sizes that the gates and quotas need are
counted beforehand, over all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tarnwork.config import Config
from tarnwork.sources.io import attach_bucketed, write_bucketed
from tarnwork.storage import stored

PAIR = ["source1_id", "target_id", "target_source"]
NO_DF = 999_999_999
#: Sources (or targets) whose pairs one task merges, ranks or labels, and pairs that one task of a whole exact join makes.
SOURCES_A_TASK = 5_000
PAIRS_A_TASK = 4_000_000


def tokens(entities: DataFrame, config: Config = Config()) -> DataFrame:
    """(entity_id, source, country_norm, token) for tokens that may be rare."""
    return (
        entities.filter((F.col("country_norm") != "") & (F.col("name_norm") != ""))
        .select("entity_id", "source", "country_norm", F.explode(F.array_distinct(F.split("name_norm", " "))).alias("token"))
        .filter(F.length("token") >= config.min_token_length)
    )


def rare_token_index(targets: DataFrame, config: Config = Config()) -> DataFrame:
    """(country_norm, token, target_id, target_source, token_df), tokens of at most ``max_token_df`` targets."""
    rows = tokens(targets, config).select("country_norm", "token", F.col("entity_id").alias("target_id"), F.col("source").alias("target_source")).distinct()
    # two-step distinct count: one row per (token, id) first, so a common token is combined on the map side
    ids = rows.select("country_norm", "token", "target_id").distinct()
    df = ids.groupBy("country_norm", "token").agg(F.count(F.lit(1)).cast("bigint").alias("token_df")).filter(F.col("token_df") <= config.max_token_df)
    return rows.join(df, ["country_norm", "token"])


def _keyed(targets: DataFrame, key: str) -> DataFrame:
    return targets.filter((F.col("country_norm") != "") & (F.col(key) != "")).select("country_norm", key, F.col("entity_id").alias("target_id"), F.col("source").alias("target_source"))


def bucket(targets: DataFrame, key: str, keep: int | None) -> DataFrame:
    """Targets of each (country, key), cut to its first ``keep`` ids."""
    rows = _keyed(targets, key)
    if keep is None:
        return rows
    rank = Window.partitionBy("country_norm", key).orderBy(F.md5("target_id"), "target_id", "target_source")
    return rows.distinct().withColumn("rn", F.row_number().over(rank)).filter(F.col("rn") <= keep).drop("rn")


def bucket_sizes(targets: DataFrame, key: str) -> DataFrame:
    """(country_norm, key, bucket_rows, bucket_ids)."""
    per_id = _keyed(targets, key).groupBy("country_norm", key, "target_id", "target_source").agg(F.count(F.lit(1)).alias("n"))
    return per_id.groupBy("country_norm", key).agg(F.sum("n").cast("bigint").alias("bucket_rows"), F.count(F.lit(1)).cast("bigint").alias("bucket_ids"))


# --------------------------------------------------------------------------- indexes


@dataclass(frozen=True)
class Indexes:
    """What blocking looks up on the target side, as tables."""

    exact: DataFrame
    exact_sizes: DataFrame
    prefix: DataFrame
    rare: DataFrame


_KEYS = {"exact": "name_norm", "exact_sizes": "name_norm", "prefix": "name_prefix", "rare": "token"}


def plan_indexes(targets: DataFrame, config: Config = Config()) -> Indexes:
    # a gated source has fewer than fallback_below pairs, so the cut exact index holds all of them
    exact = bucket(targets, "name_norm", max(config.max_candidates, config.fallback_below))
    # a source that gets to the prefix stage has fewer than fallback_below pairs that could hide prefix rows
    prefix = bucket(targets, "name_prefix", config.quotas[2] + config.fallback_below)
    return Indexes(exact, bucket_sizes(targets, "name_norm"), prefix, rare_token_index(targets, config))


def build_indexes(targets: DataFrame, config: Config = Config()) -> Indexes:
    """The indexes, written once in the shared folder."""
    plan = plan_indexes(targets, config)
    return Indexes(*[stored(getattr(plan, f.name), f"index-{f.name}") for f in fields(plan)])


def save_indexes(indexes: Indexes, prefix: str, buckets: int = 8, folder: str | None = None) -> None:
    """Catalog tables ``<prefix>_<index>``, bucketed by their join keys, so that joins shuffle the other side only; older ones of the name are replaced."""
    for f in fields(indexes):
        write_bucketed(getattr(indexes, f.name), f"{prefix}_{f.name}", ("country_norm", _KEYS[f.name]), buckets, folder and f"{folder}/{f.name}")


def attach_indexes(spark: SparkSession, prefix: str, buckets: int, folder: str) -> Indexes:
    """The indexes saved in ``folder``, for a session whose catalog may not know them."""
    return Indexes(*[attach_bucketed(spark, f"{prefix}_{f.name}", ("country_norm", _KEYS[f.name]), buckets, f"{folder}/{f.name}") for f in fields(Indexes)])


def indexes_ready(spark: SparkSession, prefix: str) -> bool:
    return all(spark.catalog.tableExists(f"{prefix}_{f.name}") for f in fields(Indexes))


def load_indexes(spark: SparkSession, prefix: str) -> Indexes:
    return Indexes(*[spark.table(f"{prefix}_{f.name}") for f in fields(Indexes)])


def drop_indexes(spark: SparkSession, prefix: str) -> None:
    for f in fields(Indexes):
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_{f.name}")


# ---------------------------------------------------------------------------- stages


def _sources(source1: DataFrame, key: str) -> DataFrame:
    return source1.filter((F.col("country_norm") != "") & (F.col(key) != "")).select(F.col("entity_id").alias("source1_id"), "country_norm", key)


def parts(entities: DataFrame) -> int:
    """Partitions by entity (source or target), as many as keep a task's rows bounded however many there are. A number, since what is dealt without one is put together again by bytes."""
    rows = entities.count()
    return max(1, math.ceil(rows / SOURCES_A_TASK), min(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / 500)))


def exact_block(source1: DataFrame, exact: DataFrame) -> DataFrame:
    return _sources(source1, "name_norm").join(exact, ["country_norm", "name_norm"]).select(*PAIR)


def exact_block_whole(source1: DataFrame, exact: DataFrame, pairs_a_task: int = PAIRS_A_TASK) -> DataFrame:
    """:func:`exact_block` on whole buckets, whose pairs grow as sources times targets: the sources of a large
    bucket are dealt to several tasks, which each get its targets. Both sides are read twice: stored tables."""
    keys = ["country_norm", "name_norm"]
    a = _sources(source1, "name_norm")
    size = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    n_pairs = F.col("n_a") * F.col("n_b")
    # no more parts than sources; half of what a task may make, so that groups fit in beside each other
    dealt = F.least(F.ceil(n_pairs / F.lit(max(1, pairs_a_task // 2))), F.col("n_a")).cast("int")
    sizes = stored(size(a, "n_a").join(size(exact, "n_b"), keys).select(*keys, n_pairs.alias("n_pairs"), dealt.alias("dealt")), "sizes")
    n = max(1, math.ceil((sizes.agg(F.sum("n_pairs")).first()[0] or 0) / pairs_a_task))
    n = max(n, min(int(source1.sparkSession.conf.get("spark.sql.shuffle.partitions")), sizes.count()))
    left = a.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("source1_id"), F.col("dealt")).cast("int"))
    right = exact.join(sizes, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("dealt") - 1)))
    deal = lambda df, *columns: df.select(*keys, "part", *columns).repartition(n, *keys, "part")
    return deal(left, "source1_id").join(deal(right, "target_id", "target_source"), [*keys, "part"]).select(*PAIR)


def exact_counts(source1: DataFrame, exact_sizes: DataFrame, exact: DataFrame) -> DataFrame:
    """(source1_id, exact_count, exact_ids) of the source1 ids with a match: pairs as rows, and distinct ones."""
    rows = _sources(source1, "name_norm").groupBy("source1_id", "country_norm", "name_norm").agg(F.count(F.lit(1)).alias("times")).join(exact_sizes, ["country_norm", "name_norm"])
    sums = rows.groupBy("source1_id").agg(
        F.sum(F.col("times") * F.col("bucket_rows")).cast("bigint").alias("exact_count"), F.sum("bucket_ids").cast("bigint").alias("exact_ids"), F.count(F.lit(1)).alias("names")
    )
    # an id with several names may meet a target under more than one of them; up to the cut of the index its pairs are counted themselves
    several = rows.join(sums.filter("names > 1").select("source1_id"), "source1_id", "left_semi").join(exact, ["country_norm", "name_norm"])
    own = several.groupBy("source1_id").agg(F.countDistinct("target_id", "target_source").alias("own_ids"), F.max("bucket_ids").alias("most"))
    ids = F.coalesce(F.greatest("own_ids", "most"), F.col("exact_ids")).cast("bigint")
    return sums.join(own, "source1_id", "left").select("source1_id", "exact_count", ids.alias("exact_ids"))


def rare_block(source1: DataFrame, rare: DataFrame, exact: DataFrame, counts: DataFrame, config: Config = Config()) -> DataFrame:
    """Pairs that share a rare token and are no exact pairs, at most ``rare_rank_limit`` a source."""
    full = counts.filter(F.col("exact_count") >= config.fallback_below).select(F.col("source1_id").alias("entity_id"))
    gated = source1.join(full, "entity_id", "left_anti")
    pairs = tokens(gated, config).withColumnRenamed("entity_id", "source1_id").join(rare, ["country_norm", "token"]).select(*PAIR, "token_df", F.lit(False).alias("exact"))
    found = exact_block(gated, exact).select(*PAIR, F.lit(NO_DF).cast("bigint").alias("token_df"), F.lit(True).alias("exact"))  # fewer than fallback_below a source
    # dealt by source once: the marks of exact pairs, the least frequency of each pair and the ranks all lie within a source
    dealt = pairs.unionByName(found).repartition(parts(source1), "source1_id")
    new = dealt.withColumn("exact", F.max("exact").over(Window.partitionBy("source1_id", "target_id"))).filter("NOT exact").groupBy(*PAIR).agg(F.min("token_df").alias("token_df"))
    rank = Window.partitionBy("source1_id").orderBy("token_df", F.md5("target_id"), "target_id", "target_source")
    return new.withColumn("rn", F.row_number().over(rank)).filter(F.col("rn") <= config.rare_rank_limit).drop("rn")


def prefix_block(source1: DataFrame, prefix: DataFrame, counts: DataFrame, rare: DataFrame, config: Config = Config()) -> DataFrame:
    """Pairs that share the prefix, for sources with too few candidates so far."""
    so_far = counts.select("source1_id", F.col("exact_count").alias("n")).unionByName(rare.groupBy("source1_id").agg(F.count(F.lit(1)).alias("n")))
    enough = so_far.groupBy("source1_id").agg(F.sum("n").alias("n")).filter(F.col("n") >= config.fallback_below).select("source1_id")
    return _sources(source1, "name_prefix").join(enough, "source1_id", "left_anti").join(prefix, ["country_norm", "name_prefix"]).select(*PAIR)


def candidates(source1: DataFrame, targets: DataFrame | None, config: Config = Config(), indexes: Indexes | None = None) -> DataFrame:
    """(source1_id, target_id, target_source, block_priority), at most ``max_candidates`` a source.

    Give either ``targets`` or their ``indexes``. Both sides are read several times: stored tables.
    """
    index = indexes or build_indexes(targets, config)
    first, second, third = config.quotas
    counts = stored(exact_counts(source1, index.exact_sizes, index.exact), "counts")
    rare = stored(rare_block(source1, index.rare, index.exact, counts, config), "rare")
    staged = (
        exact_block(source1, index.exact).select(*PAIR, F.lit(1).alias("block_priority"), F.lit(0).cast("bigint").alias("token_df"))
        .unionByName(rare.select(*PAIR, F.lit(2).alias("block_priority"), "token_df"))
        .unionByName(prefix_block(source1, index.prefix, counts, rare, config).select(*PAIR, F.lit(3).alias("block_priority"), F.lit(NO_DF).cast("bigint").alias("token_df")))
        .repartition(parts(source1), "source1_id")  # the one exchange of the merge: pairs, quotas and ranks lie within a source, of which each stage gives a bounded number
        .groupBy(*PAIR).agg(F.min("block_priority").alias("block_priority"), F.min("token_df").alias("token_df"))
    )
    by_stage = Window.partitionBy("source1_id", "block_priority").orderBy("token_df", F.md5("target_id"), "target_id", "target_source")
    quota = F.when(
        F.col("block_priority") == 1, F.when(F.col("exact_ids") <= config.max_candidates, config.max_candidates).otherwise(first)
    ).when(F.col("block_priority") == 2, second).otherwise(third)
    kept = staged.join(counts.select("source1_id", "exact_ids"), "source1_id", "left").withColumn("rn", F.row_number().over(by_stage)).filter(F.col("rn") <= quota)
    final = Window.partitionBy("source1_id").orderBy("block_priority", F.md5("target_id"), "target_id", "target_source")
    return kept.withColumn("rn", F.row_number().over(final)).filter(F.col("rn") <= config.max_candidates).select(*PAIR, "block_priority")
