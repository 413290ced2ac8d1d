"""SQLite tables as a Spark source: ``spark.read.format("sqlite").option("path", ...).option("table", ...)``.

``path`` is a database file, or a folder whose ``.db`` files hold the same table; it has to be a
path that every executor can open. Each file is read in ``partitions`` (default 4) ranges of
rowid; a view, or a table without rowid, is one range. Filters that SQLite answers as Spark
does are put into its query (``spark.sql.python.filterPushdown.enabled``), the others stay with Spark.

Types follow the declared column types: INTEGER and BIGINT are long, REAL double, BLOB binary,
BOOLEAN boolean, all others string; NULL stays NULL. Databases are opened read-only. A folder
without files is a ValueError.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

ROWS = 10_000
_TYPES = {"INTEGER": LongType(), "INT": LongType(), "BIGINT": LongType(), "REAL": DoubleType(), "DOUBLE": DoubleType(), "BLOB": BinaryType(), "BOOLEAN": BooleanType()}
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
_COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _local(path: str) -> str:
    scheme, _, rest = path.partition(":")
    if rest.startswith("/") and scheme == "file":
        return "/" + rest.lstrip("/")
    if "://" in path:
        raise ValueError(f"SQLite needs a path that executors can open, not {path}")
    return path


def _files(path: str) -> list[str]:
    path = _local(path)
    found = sorted(f"{path}/{f}" for f in os.listdir(path) if f.endswith(".db")) if os.path.isdir(path) else [path]
    if not found:
        raise ValueError(f"no .db file in {path}")
    return found


def _open(file: str):
    return closing(sqlite3.connect(f"file:{file}?mode=ro", uri=True))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Range(InputPartition):
    """Rows of one file whose rowid is in [low, high]; None: all its rows."""

    file: str
    low: int | None = None
    high: int | None = None


@dataclass
class Reader(DataSourceReader):
    table: str
    path: str
    n: int
    schema: StructType
    where: list[str] = field(default_factory=list)
    values: list = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self._push(f):
                yield f

    def _push(self, f: Filter) -> bool:
        name = f.attribute[0] if len(f.attribute) == 1 and f.attribute[0] in self.schema.names else None
        if name is None:
            return False
        column = _quoted(name)
        if isinstance(f, (IsNull, IsNotNull)):
            self.where.append(f"{column} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL")
            return True
        kind = self.schema[name].dataType
        values = list(f.value) if isinstance(f, In) else [f.value] if type(f) in _COMPARE else []
        # text and numbers only: SQLite compares them as Spark does where the column's own type is that
        if not values or not all(isinstance(v, {LongType: int, StringType: str}.get(type(kind), ())) and not isinstance(v, bool) for v in values):
            return False
        if isinstance(f, In):
            self.where.append(f"{column} IN ({', '.join('?' * len(values))})")
        else:
            self.where.append(f"{column} {_COMPARE[type(f)]} ?")
        self.values += values
        return True

    def partitions(self) -> list[Range]:
        out = []
        for file in _files(self.path):
            with _open(file) as db:
                try:
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
                except sqlite3.OperationalError:
                    out.append(Range(file))
                    continue
            if low is None:
                continue
            step = max(1, -(-(high - low + 1) // self.n))
            out += [Range(file, a, min(a + step - 1, high)) for a in range(low, high + 1, step)]
        return out or [Range(_files(self.path)[0])]

    def query(self, part: Range) -> tuple[str, list]:
        """The SQL of a range, and its parameters."""
        where = list(self.where) + (["rowid BETWEEN ? AND ?"] if part.low is not None else [])
        text = f"SELECT {', '.join(map(_quoted, self.schema.names))} FROM {_quoted(self.table)}"
        return text + (f" WHERE {' AND '.join(where)}" if where else ""), [*self.values, *([part.low, part.high] if part.low is not None else [])]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        types = [_ARROW[f.dataType.simpleString()] for f in self.schema]
        with _open(part.file) as db:
            rows = db.execute(*self.query(part))
            while found := rows.fetchmany(ROWS):
                columns = [pa.array([None if v is None else bool(v) for v in c] if t == pa.bool_() else c, t) for c, t in zip(zip(*found), types)]
                yield pa.RecordBatch.from_arrays(columns, names=self.schema.names)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with _open(_files(self.options["path"])[0]) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return StructType([StructField(c[1], _TYPES.get(c[2].upper().split("(")[0].strip(), StringType())) for c in columns])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["table"], self.options["path"], int(self.options.get("partitions", 4)), schema)


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    """The table, with filters pushed into SQLite."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", str(partitions)).load()


def write_sqlite(df: DataFrame, folder: str, table: str) -> DataFrame:
    """Writes ``df`` as one database a task; returns (file, rows) of what was written. Columns are longs, doubles, booleans, binaries or strings.

    A task that runs again replaces its own file.
    """
    declared = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "boolean": "BOOLEAN", "binary": "BLOB"}
    columns = ", ".join(f"{_quoted(n)} {declared.get(t, 'TEXT')}" for n, t in df.dtypes)
    root = _local(folder)

    def work(batches):
        os.makedirs(root, exist_ok=True)
        file, n = f"{root}/part-{TaskContext.get().partitionId():05}.db", 0
        draft = f"{file}.{uuid.uuid4().hex}"
        db = sqlite3.connect(draft)
        db.execute(f"CREATE TABLE {_quoted(table)} ({columns})")
        for batch in batches:
            db.executemany(f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' * batch.num_columns)})", zip(*[c.to_pylist() for c in batch.columns]))
            n += batch.num_rows
        db.commit()
        db.close()
        os.replace(draft, file)
        yield pa.RecordBatch.from_pydict({"file": [file], "rows": pa.array([n], pa.int64())})

    return df.mapInArrow(work, "file string, rows long")
