"""Scans and sinks. All columns of a TSV are strings and '' stays ''."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

ENTITY_COLUMNS = ("entity_id", "business_name", "business_address", "country")
TRUTH_COLUMNS = ("source1_entity_id", "matched_entity_ids")


def _typed(**columns) -> StructType:
    return StructType([StructField(n, t, nullable) for n, (t, nullable) in columns.items()])


_ID, _TEXT, _TIME = (LongType(), False), (StringType(), False), (TimestampType(), False)
#: The typed rows of the application tables.
SCHEMAS = {
    "coffee": _typed(id=_ID, name=_TEXT, votes=(LongType(), False)),
    "user": _typed(id=_ID, name=_TEXT, department=_TEXT, available=(BooleanType(), False)),
    "quote": _typed(id=_ID, quote=_TEXT, author=_TEXT, created_at=_TEXT),
    "profile": _typed(id=_ID, name=_TEXT, bio=_TEXT, image_url=_TEXT, created_at=_TIME),
    "note": _typed(id=_ID, title=_TEXT, content=_TEXT, created_at=_TIME, updated_at=_TIME, user_id=_ID),
}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with exactly the schema's columns and types; ValueError for columns that it lacks."""
    require_columns(df, schema.names)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field may hold a newline: some line has an odd number of quotes."""
    odd = F.regexp_count("value", F.lit('"')) % 2 == 1
    return bool(spark.read.text(path).filter(odd).limit(1).count())


def read_tsv(spark: SparkSession, path: str, columns=ENTITY_COLUMNS, multi_line: bool | None = None) -> DataFrame:
    """Tab-separated with a header, quoted fields may hold newlines, '' is never NULL.

    A file whose fields may hold newlines can't be split, so it is one task. ``multi_line`` says
    whether there are such fields; None looks through the lines first, which is split.
    """
    many = spans_lines(spark, path) if multi_line is None else multi_line
    return spark.read.csv(path, sep="\t", header=True, schema=strings(*columns), escape='"', multiLine=many, enforceSchema=False).na.fill("")


def write_tsv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """``single_file`` is for hand-over of small results; the default keeps the parallel writers."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").csv(path, sep="\t", header=True, escape='"', emptyValue="")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_head(spark: SparkSession, path: str, columns, n: int, *order) -> DataFrame:
    """The first ``n`` rows of some columns in the given order; files have none of their own."""
    return spark.read.parquet(path).select(*columns).orderBy(*(order or columns)).limit(n)


def landed_json(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Fields of JSON texts as landed from a service; malformed texts, and those without all fields, give NULLs."""
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    names = StructType.fromDDL(schema).names
    whole = F.forall(F.array(*[parsed[n].isNotNull() for n in names]), lambda x: x)
    return lines.withColumns({n: F.when(whole, parsed[n]) for n in names})


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def file_counts(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows and distinct keys of each file under ``path``."""
    df = spark.read.parquet(path)
    return df.groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_distinct")
    )


def write_bucketed(df: DataFrame, name: str, keys, buckets: int, path: str | None = None, bloom: bool = False) -> None:
    """Catalog table ``name``, bucketed and sorted by ``keys`` with one file a bucket; an older one of the name is replaced.

    ``bloom``: Parquet bloom filters of the keys, so that a lookup of a key that is not there reads
    no row of its bucket.
    """
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*keys)
    for k in keys if bloom else ():
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{k}", "true")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def attach_bucketed(spark: SparkSession, name: str, keys, buckets: int, path: str) -> DataFrame:
    """The table that :func:`write_bucketed` left at ``path``, for a session whose catalog does not know it."""
    if not spark.catalog.tableExists(name):
        schema = spark.read.parquet(path).schema.toDDL()
        columns = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({columns}) SORTED BY ({columns}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
