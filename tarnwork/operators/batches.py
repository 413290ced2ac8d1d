"""Steps that know what they were made from, and tables written by resumable batches.

A step's table is current only if a manifest beside it holds the fingerprint that the step
would have now. Fingerprints are digests of the input files' listing and of the parameters that
the step reads, and each step's goes into those of the steps that read it, so a change
of input or parameter makes everything that hangs on it anew, and nothing else.

A batched table holds rows by ``batch_id``, a hash of a key modulo the number of batches. The
number is part of the manifest: a run that would count other batches goes on with the ones
that are there. All missing batches are written by one job (or by a stated number of them,
whatever the number of batches is) that overwrites their partitions alone; a batch is done
when a job that held it has ended and said so, rows or no rows. So a run that was stopped,
also in the middle of a commit, loses and repeats nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from tarnwork.storage import exists, folders, get_text, listing, put_text, remove

MANIFEST = "_manifest"


def digest(*parts) -> str:
    """Fingerprint of anything that JSON can hold."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def files_digest(spark: SparkSession, path: str) -> str:
    """Fingerprint of the files at a path: names, sizes and times, not their content."""
    return digest(path, listing(spark, path))


# ------------------------------------------------------------------------------ steps


def current(spark: SparkSession, path: str, fingerprint: str) -> bool:
    """Whether the step at ``path`` was finished with this fingerprint."""
    text = get_text(spark, f"{path}/{MANIFEST}")
    return text is not None and json.loads(text).get("fingerprint") == fingerprint


def step(spark: SparkSession, path: str, fingerprint: str, write: Callable[[str], object]) -> bool:
    """Runs ``write(path)`` unless the step is current; returns whether it ran. The manifest comes after the last file."""
    if current(spark, path, fingerprint):
        return False
    remove(spark, path)
    write(path)
    put_text(spark, f"{path}/{MANIFEST}", json.dumps({"fingerprint": fingerprint}))
    return True


# ---------------------------------------------------------------------------- batches


def batch_of(key: Column, n: int) -> Column:
    """The batch of a key: all its rows lie in one, batches are about equal."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def ranges(numbers) -> list[tuple[int, int]]:
    """Sorted (first, last) of the runs of consecutive numbers."""
    out: list[tuple[int, int]] = []
    for n in sorted(numbers):
        if out and out[-1][1] == n - 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


class Batches:
    """A table at ``path``, batched by a hash of ``key``. ``n`` is how many batches a new table gets."""

    def __init__(self, spark: SparkSession, path: str, fingerprint: str, key: str, n: Callable[[], int]):
        self.spark, self.path, self.fingerprint, self.key, self._count = spark, path, fingerprint, key, n
        text = get_text(spark, f"{path}/{MANIFEST}")
        held = json.loads(text) if text else {}
        self.known = held.get("fingerprint") == fingerprint
        self.n = held["n"] if self.known else None
        self.schema = held.get("schema") if self.known else None

    def done(self) -> set[int]:
        """Batches that a finished job has written."""
        if not self.known:
            return set()
        out: set[int] = set()
        for name in [f[0] for f in listing(self.spark, f"{self.path}/_done") if f[0].endswith(".json")]:
            for first, last in json.loads(get_text(self.spark, f"{self.path}/_done/{name}")):
                out.update(range(first, last + 1))
        return out

    def missing(self) -> list[int]:
        """Batches still to be written; all of a table that is not there, or was made from something else."""
        if not self.known:
            return list(range(self._count()))
        return sorted(set(range(self.n)) - self.done())

    def _begin(self) -> None:
        """An empty table with its manifest; what was there was made from something else."""
        remove(self.spark, self.path)
        self.n, self.known, self.schema = self._count(), True, None
        self._save()

    def _save(self) -> None:
        put_text(self.spark, f"{self.path}/{MANIFEST}", json.dumps({"fingerprint": self.fingerprint, "n": self.n, "schema": self.schema}))

    def only(self, df: DataFrame, batches: list[int], mine: Column) -> DataFrame:
        """The rows of ``df`` whose batch (the column ``mine``) is among these."""
        if len(batches) == self.n:
            return df
        parts = ranges(batches)
        if len(parts) <= 16:
            wanted = F.lit(False)
            for first, last in parts:
                wanted = wanted | mine.between(first, last)
            return df.filter(wanted)
        ids = self.spark.createDataFrame([(b,) for b in batches], "__batch int")
        return df.withColumn("__batch", mine).join(ids, "__batch", "left_semi").drop("__batch")

    def write(self, make: Callable[[list[int]], DataFrame], jobs: int = 1) -> list[int]:
        """Writes ``make(batches)`` for all missing batches in at most ``jobs`` jobs; returns the batches written now.

        ``make`` gets a list of batches (see :meth:`only`) and returns their rows, with the key.
        More jobs lose less when a run is stopped and read the inputs as many times.
        """
        if not self.known:
            self._begin()
        gone = self.missing()
        size = -(-len(gone) // max(1, jobs))
        # rows of a job that was stopped while it gave its files their names
        left = {int(d.split("=")[1]) for d in folders(self.spark, self.path) if d.startswith("batch_id=")}
        for at in range(0, len(gone), size or 1):
            part = gone[at : at + size]
            rows = make(part)
            if self.schema is None:
                self.schema = json.loads(rows.schema.json())
                self._save()
            batched = rows.withColumn("batch_id", batch_of(F.col(self.key), self.n))
            for b in left.intersection(part):
                remove(self.spark, f"{self.path}/batch_id={b}")
            batched.repartition("batch_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("batch_id").parquet(self.path)
            put_text(self.spark, f"{self.path}/_done/{uuid.uuid4().hex}.json", json.dumps(ranges(part)))
        return gone

    def read(self) -> DataFrame:
        """All rows with their ``batch_id``. ValueError if the table is not of this fingerprint or not complete."""
        if not self.known and exists(self.spark, f"{self.path}/{MANIFEST}"):
            raise ValueError(f"{self.path} was made from other inputs or parameters")
        gone = self.missing()
        if gone or not self.known:
            parts = [str(a) if a == b else f"{a}-{b}" for a, b in ranges(gone)]
            raise ValueError(f"missing batches: {', '.join(parts)}")
        schema = StructType.fromJson(self.schema).add("batch_id", IntegerType())
        return self.spark.read.schema(schema).parquet(self.path).filter(F.col("batch_id") < self.n)
