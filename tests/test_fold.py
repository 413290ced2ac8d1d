"""The streaming fold of a change log against the fold of the whole log."""

from pyspark.sql import functions as F

from tarnwork.operators.statelog import live_notes
from tarnwork.sources import fixtures as X
from tarnwork.streaming.fold import current_notes, run_fold
from tests.conftest import SF

LOG = "note_id long, version long, user_id long, op string, title string, content string"


def _rows(df):
    return sorted(tuple(r) for r in df.select("note_id", "user_id", "title", "content", "updated_version", "created_version").collect())


def test_fold_after_each_batch_and_restart(spark, tmp_path):
    """Files come one after the other, with a stop between them; changes of a note are spread over all, newer ones also come first."""
    log = X.note_log(spark, SF).select(F.col("note_id").cast("long"), F.col("version").cast("long"), F.col("user_id").cast("long"), "op", "title", "content")
    folder = str(tmp_path / "in")
    part = F.pmod(F.xxhash64("note_id", "version"), F.lit(4))
    stream = lambda: spark.readStream.schema(LOG).parquet(folder)
    spark.createDataFrame([], LOG).write.parquet(folder)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    assert current_notes(spark, out).count() == 0
    deleted = 0
    for k in range(4):
        log.filter(part == k).coalesce(1).write.mode("append").parquet(folder)
        query = run_fold(stream(), out, checkpoint)  # a new query each time: it goes on from the checkpoint
        query.awaitTermination()
        assert query.exception() is None
        seen = log.filter(part <= k)
        assert _rows(current_notes(spark, out)) == _rows(live_notes(seen))
        deleted += seen.select("note_id").distinct().count() - current_notes(spark, out).count()
    assert deleted > 0
    before = _rows(current_notes(spark, out))
    run_fold(stream(), out, checkpoint).awaitTermination()  # nothing new: nothing changes
    assert _rows(current_notes(spark, out)) == before


def test_fold_orders_by_version(spark, tmp_path):
    """A late older version changes nothing but the version that created the note; a delete can be undone by a newer insert."""
    batches = [
        [(1, 5, 9, "update", "t5", "c"), (2, 1, 9, "insert", "a", None)],
        [(1, 2, 9, "insert", "t2", "c"), (2, 2, 9, "delete", None, None)],
        [(2, 3, 9, "insert", "b", "x"), (1, 1, 9, "insert", "t1", "c"), (3, 1, 9, "delete", None, None)],
    ]
    want = [{1: ("t5", 5, None), 2: ("a", 1, 1)}, {1: ("t5", 5, 2)}, {1: ("t5", 5, 1), 2: ("b", 3, 1)}]
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for rows, live in zip(batches, want):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(folder)
        run_fold(spark.readStream.schema(LOG).parquet(folder), out, checkpoint).awaitTermination()
        assert {r.note_id: (r.title, r.updated_version, r.created_version) for r in current_notes(spark, out).collect()} == live
