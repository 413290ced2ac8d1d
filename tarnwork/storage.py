"""Tables written to the folder that driver and executors share.

A written table cuts the lineage: a lost executor costs the tasks of the current step
and never the steps before it.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in local mode, where it is unset, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tarnwork-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Shuffle files of the queries that start in here go as soon as each of them ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffle_cleanup(spark):  # the table is whole, so nothing will ask for them again
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of :func:`stored` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        root = shared_folder(spark)
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
                remove(spark, folder)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole: it gets its name only when it is complete."""
    fs, p = _hadoop(spark, path)
    _, draft = _hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(draft, p):
        raise OSError(f"cannot write {path}")


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file, None if it is not there."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, time) of the files at a path or directly in it; names that begin with . or _ are left out."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return []
    found = [(f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p) if f.isFile()]
    return sorted(f for f in found if f[0][0] not in "._")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly in a path."""
    fs, p = _hadoop(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()] if fs.exists(p) else []
