"""Line dedup by overlapping three-line windows.

Every three consecutive lines are hashed (128 bits). A window that also stands earlier
(smaller doc_id, or same document, earlier line) is a repeat; all lines that a repeat covers
go, the first occurrence stays.

Defined cases: NULL and empty texts, and texts of fewer than three lines, have no window
and stay as they are. A window of blank lines only is none. Rows of one doc_id and one text
count as one document, so a repeated row is treated like its twin; rows of one doc_id with
different texts are different documents, ordered by a hash of the text. A NULL doc_id sorts
first. Columns n_lines and n_removed of the input are replaced. Texts may
have any length that a row has; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tarnwork.storage import stored

KEY = ["__id", "__h"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({"__id": F.col(id_col), "__h": F.xxhash64(F.col(text_col))})


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(__id, __h, pos, a, b): where each window begins, and its hash."""
    keyed = _keyed(docs.select(id_col, text_col), id_col, text_col).select(*KEY, _lines(F.col(text_col)).alias("ls")).filter(F.size("ls") >= size)
    hashed = keyed.select(
        *KEY, F.transform("ls", lambda x: F.struct(F.xxhash64(F.lit(1), x).alias("a"), F.xxhash64(F.lit(2), x).alias("b"), (F.trim(x) != "").alias("full"))).alias("hs")
    )
    parts = lambda i: [F.element_at("hs", i + 1 + k) for k in range(size)]
    window = lambda i: F.struct(
        i.alias("pos"), F.xxhash64(F.lit(3), *[p["a"] for p in parts(i)]).alias("a"), F.xxhash64(F.lit(5), *[p["b"] for p in parts(i)]).alias("b"),
        F.exists(F.slice("hs", i + 1, F.lit(size)), lambda p: p["full"]).alias("full"),
    )
    rows = hashed.select(*KEY, F.explode(F.transform(F.sequence(F.lit(0), F.size("hs") - size), window)).alias("w"))
    return rows.filter("w.full").select(*KEY, "w.pos", "w.a", "w.b")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``docs`` without repeated lines, and with n_lines and n_removed."""
    found = windows(docs, id_col, text_col, size)
    first = found.groupBy("a", "b").agg(F.min(F.struct(*KEY, "pos")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b", "first")
    # written, so that the join below shuffles both sides and AQE can split a hot window
    repeats = found.join(stored(first, "windows"), ["a", "b"]).filter(~F.struct(*KEY, "pos").eqNullSafe(F.col("first")))
    marks = repeats.groupBy(*KEY).agg(F.collect_set("pos").alias("__starts"))
    base = _keyed(docs.drop("n_lines", "n_removed"), id_col, text_col)
    marks = marks.select(F.col("__id").alias("__mid"), F.col("__h").alias("__mh"), "__starts")
    joined = base.join(marks, F.col("__id").eqNullSafe(F.col("__mid")) & (F.col("__h") == F.col("__mh")), "left")
    lines = _lines(F.col(text_col))
    covered = F.flatten(F.transform("__starts", lambda s: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: s + k)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    text = F.when(F.col("__starts").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(F.col("__starts").isNull(), 0).otherwise(F.size(F.array_distinct(covered))).cast("long")
    return joined.withColumns({"n_lines": n_lines, "n_removed": n_removed, "__text": text}).withColumn(text_col, F.col("__text")).drop("__id", "__h", "__mid", "__mh", "__starts", "__text")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
 w AS (SELECT doc_id, p, ls[p] || chr(10) || ls[p + 1] || chr(10) || ls[p + 2] AS t FROM (SELECT *, unnest(range(1, len(ls) - 1)) AS p FROM l WHERE len(ls) >= 3)),
 again AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, p) AS k FROM w WHERE trim(replace(t, chr(10), '')) <> '') WHERE k > 1),
 gone AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM again) GROUP BY 1)
SELECT l.doc_id, CASE WHEN qs IS NULL THEN text ELSE array_to_string([ls[i] for i in range(1, len(ls) + 1) if NOT list_contains(qs, i)], chr(10)) END AS text,
 CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id
"""
