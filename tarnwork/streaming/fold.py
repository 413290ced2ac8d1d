"""Keyed state of a change log: inserts, updates and deletes folded as they come.

Each key has one state; a change is applied if its version is the newest so far, in whatever
order changes come. Every micro-batch writes the keys that it changed to a folder of its own, so a
batch that is run again after a restart overwrites what it had written, and the current table is
the last change of each key. State and progress lie in the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from tarnwork.storage import folders

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "user_id long, title string, content string, updated_version long, created_version long, deleted boolean"


class NoteFold(StatefulProcessor):
    """The newest version of a note, and the version that inserted it first."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("note", STATE)

    def handleInputRows(self, key, rows, timer_values):
        before = self.state.get() if self.state.exists() else None
        newest = before and tuple(before)
        for r in rows:
            created = newest[4] if newest else None
            if r.op == "insert":
                created = r.version if created is None else min(created, r.version)
            if newest is None or r.version >= newest[3]:
                newest = (r.user_id, r.title, r.content, r.version, created, r.op == "delete")
            else:
                newest = (*newest[:4], created, newest[5])
        if newest != (before and tuple(before)):
            self.state.update(newest)
            yield Row(note_id=key[0], user_id=newest[0], title=newest[1], content=newest[2], updated_version=newest[3], created_version=newest[4], deleted=newest[5])

    def close(self) -> None:
        pass


def fold_notes(log: DataFrame) -> DataFrame:
    """(note_id, user_id, title, content, updated_version, created_version, deleted) of the notes that a micro-batch changed."""
    columns = log.select(F.col("note_id").cast("long"), F.col("version").cast("long"), F.col("user_id").cast("long"), "op", "title", "content")
    return columns.groupBy("note_id").transformWithState(statefulProcessor=NoteFold(), outputStructType=f"note_id long, {STATE}", outputMode="update", timeMode="none")


def run_fold(log: DataFrame, out: str, checkpoint: str):
    """Folds all that the stream holds now, from where the checkpoint stands; returns the query."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch_id={batch_id}")

    return fold_notes(log).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_notes(spark: SparkSession, out: str) -> DataFrame:
    """The live notes after the last micro-batch: no row for deleted ones."""
    schema = f"note_id long, {STATE}"
    if not folders(spark, out):
        return spark.createDataFrame([], schema).drop("deleted")
    changes = spark.read.schema(f"{schema}, batch_id long").parquet(out)
    columns = [c for c in changes.columns if c not in ("note_id", "batch_id")]
    last = changes.groupBy("note_id").agg(F.max_by(F.struct(*columns), "batch_id").alias("s"))
    return last.filter("NOT s.deleted").select("note_id", *[f"s.{c}" for c in columns if c != "deleted"])
