"""SQLite tables as a source: ranges, pushed filters, types."""

import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, LessThanOrEqual, StringContains

from tarnwork.sources.sqlite import Range, SqliteSource, read_sqlite, write_sqlite
from tests.conftest import SF


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "notes.db")
    db = sqlite3.connect(path)
    db.execute('CREATE TABLE "my notes" (id INTEGER PRIMARY KEY, title VARCHAR(100), score REAL, live BOOLEAN, raw BLOB, made DATETIME, "a""b" TEXT)')
    rows = [(i * 3, None if i % 7 == 0 else f"t{i % 5}", i / 4, i % 2, bytes([i % 256]), f"2024-01-{i % 28 + 1:02}", "x'y") for i in range(1, 101)]
    db.executemany('INSERT INTO "my notes" VALUES (?, ?, ?, ?, ?, ?, ?)', rows)
    db.execute("CREATE TABLE none (id INTEGER)")
    db.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
    db.execute("INSERT INTO keyed VALUES ('a', 1), ('b', NULL)")
    db.execute('CREATE VIEW seen AS SELECT id, title FROM "my notes" WHERE id < 10')
    db.commit()
    db.close()
    return path, [(*r[:3], bool(r[3]), bytearray(r[4]), *r[5:]) for r in rows]


def test_table(spark, database):
    path, rows = database
    df = read_sqlite(spark, f"file://{path}", "my notes", partitions=5)
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "boolean", "binary", "string", "string"] and df.columns[-1] == 'a"b'
    assert sorted(map(tuple, df.collect())) == rows and df.rdd.getNumPartitions() == 5
    assert df.filter("title IS NULL").count() == 14 and df.filter("title = 't1' AND id > 30 AND score <= 20").count() == sum(r[1] == "t1" and r[0] > 30 and r[2] <= 20 for r in rows)
    assert df.filter(F.col("title").isin("t1", "t2") & (F.col("live") == True) & F.col("made").contains("-0")).count() == sum(r[1] in ("t1", "t2") and r[3] and "-0" in r[5] for r in rows)  # noqa: E712


def test_other_tables(spark, database):
    path, _ = database
    assert read_sqlite(spark, path, "none").count() == 0
    assert sorted(map(tuple, read_sqlite(spark, path, "keyed").collect())) == [("a", 1), ("b", None)]
    assert sorted(r.id for r in read_sqlite(spark, path, "seen").collect()) == [3, 6, 9]
    with pytest.raises(Exception, match="no table"):
        read_sqlite(spark, path, "absent").count()
    with pytest.raises(Exception, match="executors can open"):
        read_sqlite(spark, "hdfs://x/y.db", "t").count()


def test_pushed_filters(spark, database):
    """What SQLite is asked, and which filters stay with Spark."""
    source = SqliteSource({"path": database[0], "table": "my notes", "partitions": "3"})
    reader = source.reader(source.schema())
    left = list(reader.pushFilters([
        EqualTo(("title",), "t1"), GreaterThan(("id",), 9), In(("id",), (12, 15, 18)), IsNull(("made",)), LessThanOrEqual(("score",), 2.0), StringContains(("title",), "t"), EqualTo(("id",), "12"), EqualTo(("live",), True),
    ]))
    assert [type(f).__name__ for f in left] == ["LessThanOrEqual", "StringContains", "EqualTo", "EqualTo"]
    parts = reader.partitions()
    assert [(p.low, p.high) for p in parts] == [(3, 102), (103, 202), (203, 300)]
    text, values = reader.query(parts[1])
    assert text.endswith('FROM "my notes" WHERE "title" = ? AND "id" > ? AND "id" IN (?, ?, ?) AND "made" IS NULL AND rowid BETWEEN ? AND ?')
    assert values == ["t1", 9, 12, 15, 18, 103, 202] and reader.query(Range("f"))[1] == values[:5]
    plan = read_sqlite(spark, database[0], "my notes").filter("id = 12")._jdf.queryExecution().executedPlan().toString()
    assert "id" in plan and "Filter (isnotnull" not in plan


def test_round_trip(spark, tmp_path):
    """A folder with a database of each task gives the rows that Parquet gives; a task that runs again changes nothing."""
    orders = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"), "o_orderpriority", F.col("o_totalprice").cast("double").alias("p")).repartition(3)
    for _ in range(2):
        files = write_sqlite(orders, f"file://{tmp_path}/db", "orders").collect()
    again = read_sqlite(spark, f"file://{tmp_path}/db", "orders", partitions=2)
    assert len(files) == 3 and again.rdd.getNumPartitions() == 6
    assert again.exceptAll(orders).count() == orders.exceptAll(again).count() == 0
    with pytest.raises(Exception, match="no .db file"):
        (tmp_path / "empty").mkdir()
        read_sqlite(spark, str(tmp_path / "empty"), "orders").count()
