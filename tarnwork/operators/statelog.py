"""Lists, lookups, tallies and latest states folded from append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tarnwork.sources.io import write_bucketed
from tarnwork.storage import new_path, stored


def lookup(df: DataFrame, key: str, value, owner: tuple[str, object] | None = None) -> DataFrame:
    """The row with this key, scoped to an owner if one is given."""
    found = df.filter(F.col(key) == F.lit(value))
    if owner:
        found = found.filter(F.col(owner[0]) == F.lit(owner[1]))
    return found.limit(1)


def keyed(df: DataFrame, name: str, key: str, buckets: int = 8) -> DataFrame:
    """``df`` as a table laid out for :func:`lookup`: a point query opens one bucket, and Parquet's bloom filter and order of the key leave little of it to read."""
    write_bucketed(df, name, (key,), buckets, new_path(df.sparkSession, name), bloom=True)
    return df.sparkSession.table(name)


def with_defaults(spark: SparkSession, name: str, columns: str) -> DataFrame:
    """A new, empty catalog table in the shared folder whose DDL may have DEFAULT values; inserts that leave such columns out get them."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet LOCATION '{new_path(spark, name)}'")
    return spark.table(name)


def insert(rows: DataFrame, name: str) -> None:
    """Appends ``rows`` by the names of their columns; columns that they lack get the table's defaults."""
    rows.sparkSession.sql(f"INSERT INTO {name} ({', '.join(f'`{c}`' for c in rows.columns)}) SELECT * FROM {{rows}}", rows=rows)


def listing(df: DataFrame, *order, owner: tuple[str, object] | None = None) -> DataFrame:
    return (df.filter(F.col(owner[0]) == F.lit(owner[1])) if owner else df).orderBy(*order)


def seeded(table: DataFrame, seed: DataFrame) -> DataFrame:
    """``table``, or ``seed`` if it has no rows."""
    empty = table.limit(1).agg((F.count(F.lit(1)) == 0).alias("__empty"))
    return table.unionByName(seed.crossJoin(F.broadcast(empty)).filter("__empty").drop("__empty").select(*table.columns))


def stamped(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with the current instant where these columns are NULL or absent, whatever the session's time zone is."""
    now = F.current_timestamp()
    return rows.withColumns({c: F.coalesce(F.col(c), now) if c in rows.columns else now for c in columns})


def touched(rows: DataFrame, changed, column: str = "updated_at") -> DataFrame:
    """``rows`` with the current instant in ``column`` where ``changed`` (a condition) holds."""
    return rows.withColumn(column, F.when(changed, F.current_timestamp()).otherwise(F.col(column)))


def appended(log: DataFrame, rows: DataFrame, key: str, *order) -> DataFrame:
    """``log`` and ``rows`` with the next keys, in the given order."""
    last = log.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint").alias("__last"))  # one row
    new = with_keys(rows, key, *order).crossJoin(F.broadcast(last)).withColumn(key, F.col(key) + F.col("__last")).drop("__last")
    return log.unionByName(new.select(*log.columns))


def tally(votes: DataFrame) -> DataFrame:
    return votes.groupBy("item").agg(F.count(F.lit(1)).cast("bigint").alias("votes"))


def latest(log: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Latest ``value`` of each key; ``max_by`` on a struct combines before the shuffle."""
    return log.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def availability_summary(states: DataFrame) -> DataFrame:
    return states.agg(
        F.count(F.lit(1)).cast("bigint").alias("total"), F.count_if(F.col("available")).cast("bigint").alias("n_available"),
        F.count_if(~F.col("available")).cast("bigint").alias("n_away"),
    )


def live_notes(log: DataFrame) -> DataFrame:
    """Current notes: the highest version of each, unless that is a delete."""
    last = F.max_by(F.struct("op", "user_id", "title", "content", "version"), F.col("version"))
    created = F.min(F.when(F.col("op") == "insert", F.col("version")))
    folded = log.groupBy("note_id").agg(last.alias("s"), created.alias("created_version"))
    return folded.filter(F.col("s.op") != "delete").select("note_id", "s.user_id", "s.title", "s.content", F.col("s.version").alias("updated_version"), "created_version")


def with_keys(rows: DataFrame, name: str, *order) -> DataFrame:
    """Generated keys 1, 2, 3, ... in the given order.

    The rows are range-partitioned by the order; only each partition's size meets in
    one place, so no task sorts the whole table.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    # written once: range boundaries are sampled, so a second evaluation could cut elsewhere
    inside = stored(spread.withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("bigint"), 33)), "keys")
    sizes = inside.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    return inside.join(F.broadcast(starts), "__p").withColumn(name, (F.col("__s") + F.col("__i") + 1).cast("bigint")).drop("__p", "__i", "__s")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("n")).filter("n > 1")


def missing_batches(present: DataFrame, n_batches: int, key: str = "batch_id") -> DataFrame:
    """Batches of 0 .. n_batches - 1 that have not been written."""
    expected = present.sparkSession.range(n_batches).select(F.col("id").cast("bigint").alias(key))
    return expected.join(present.select(F.col(key).cast("bigint").alias(key)).distinct(), key, "left_anti")
