"""Divergence of a language's sources: how their word frequencies differ, by DuckDB on hash shards.

1. Each task counts the terms of its documents in DuckDB, batch by batch, and hands on sums by
   (lang, source, term): a term that every document has costs a task one row a source.
2. The sums are dealt to shards by a hash of (lang, term). A shard's DuckDB adds them up and
   keeps the terms that enough of the language's documents have.
3. Sums of a shard's terms by source and by language, added up by Spark, are what frequencies
   are relative to: p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)).
4. The shards, dealt anew from the much smaller table of kept terms, give partial sums for each
   pair of sources, a histogram of each source's p, and their own best terms; Spark merges the
   sums and ranks them.

A pair's sum runs over all V kept terms, though most terms are absent from most sources. An
absent term has the source's p of count 0, its floor. So shards add up only where both sources
have a term (with what the other sums count there in excess taken off), the histograms give the
sums of a source's own terms against the other's floor, and all other terms differ by the
floors. No row is made for an absent term, and every integer is exact (128 bits in DuckDB,
decimals in Spark).

Memory of a task: one batch's documents and ``FLUSH`` groups while counting; a shard's part of
the sums afterwards, which more shuffle partitions make smaller. Every pair of sources of a
language is a row of the result by its definition.

Defined cases: NULL text, lang and source are ''; repeated rows are documents of their own; a
language without kept terms gives pairs of value 0 and no terms; a language with one source
gives no pairs; an empty table gives no row; texts of any length are read whole. Other columns
are not read.
"""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnwork.llm.common import LOWER
from tarnwork.storage import stored

#: Fixed values of the contract.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, SCALE, PRIOR, TOP_TERMS = 30, 1_000_000_000, 5, 50
FLUSH = 1_000_000
SLICE_BYTES = 8 << 20


def _connect() -> duckdb.DuckDBPyConnection:
    """A connection that stays in memory and in its task's thread."""
    con = duckdb.connect(config={"threads": 1, "preserve_insertion_order": False, "temp_directory": ""})
    _do(con, "SET enable_progress_bar = false")
    return con


def _do(con: duckdb.DuckDBPyConnection, sql: str) -> list[tuple]:
    """Runs a statement to its end."""
    return con.execute(sql).fetchall()


def _lowered(texts: pa.Array) -> pa.Array:
    """The texts with A-Z in lower case, NULL as ''."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    if data is None or not data.size:
        return texts
    return pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(LOWER[np.frombuffer(data, np.uint8)].tobytes())], offset=texts.offset)


def _slices(batch: pa.RecordBatch, column: int):
    """Parts of a batch of about SLICE_BYTES of text, one document at least."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + SLICE_BYTES, "right")))
        yield batch.slice(i, j - i)
        i = j


COUNT_DOCS = f"""
INSERT INTO sums SELECT lang, source, term, sum(n) AS n, count(*) AS docs FROM (
  SELECT lang, source, doc, term, count(*) AS n FROM (SELECT lang, source, doc, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM batch) GROUP BY ALL) GROUP BY ALL
"""
SUMS = "lang string, source string, term string, n decimal(38,0), docs long"
_TABLE = "CREATE OR REPLACE TABLE sums (lang VARCHAR, source VARCHAR, term VARCHAR, n HUGEINT, docs BIGINT)"


def term_sums(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of each task's documents (columns lang, source, text)."""

    def work(batches):
        con = _connect()
        _do(con, _TABLE)
        for whole in batches:
            for part in _slices(whole, 2):
                batch = pa.table({"lang": part.column(0), "source": part.column(1), "text": _lowered(part.column(2)), "doc": pa.array(np.arange(part.num_rows))})
                con.register("batch", batch)
                _do(con, COUNT_DOCS)
                if _do(con, "SELECT count(*) FROM sums")[0][0] > FLUSH:
                    yield from _merged(con)
                    _do(con, _TABLE)
        yield from _merged(con)

    return docs.mapInArrow(work, SUMS)


def _merged(con):
    yield from _arrow(con, "SELECT lang, source, term, CAST(sum(n) AS DECIMAL(38,0)) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM sums GROUP BY ALL")


def _arrow(con, sql: str):
    yield from con.sql(sql).to_arrow_reader(100_000)


KEPT = """
WITH s AS (SELECT lang, source, term, sum(n) AS n, sum(docs) AS docs FROM sums GROUP BY ALL),
 k AS (SELECT lang, term, sum(n) AS n FROM s GROUP BY ALL HAVING sum(docs) >= {0})
SELECT lang, s.source, term, CAST(s.n AS DECIMAL(38,0)) AS n, CAST(k.n AS DECIMAL(38,0)) AS lang_n FROM s JOIN k USING (lang, term)
"""


def _fill(con, batches, columns: str) -> None:
    _do(con, f"CREATE TABLE sums ({columns})")
    for rows in batches:
        con.register("batch", pa.Table.from_batches([rows]))
        _do(con, "INSERT INTO sums SELECT * FROM batch")
        con.unregister("batch")


def kept_terms(sums: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n): counts of the kept terms in the sources that have them, and in the language."""

    def work(batches):
        con = _connect()
        _fill(con, batches, "lang VARCHAR, source VARCHAR, term VARCHAR, n DECIMAL(38,0), docs BIGINT")
        yield from _arrow(con, KEPT.format(min_docs))

    return sums.repartition("lang", "term").mapInArrow(work, "lang string, source string, term string, n decimal(38,0), lang_n decimal(38,0)")


# One row of ``sums`` is a kept term of a source; total is N and lang_total the language's N.
_P = "CAST(1 + ({scale}::HUGEINT * ({n} + {prior})) // ({total} + {prior} * vocab) AS BIGINT)"
PARTIAL = """
WITH r AS (SELECT lang, source, term, {p} AS p, {floor} AS p0, {q} AS q FROM (SELECT lang, source, term, n::HUGEINT AS n, lang_n::HUGEINT AS lang_n, total::HUGEINT AS total, lang_total::HUGEINT AS lang_total, vocab::HUGEINT AS vocab FROM sums)),
 pairs AS (SELECT lang, a.source AS source, b.source AS item, sum(abs(a.p - b.p) - abs(a.p - b.p0) - abs(b.p - a.p0) + abs(a.p0 - b.p0)) AS v FROM r a JOIN r b USING (lang, term) WHERE a.source < b.source GROUP BY ALL),
 best AS (SELECT lang, source, term, p - q AS v FROM r WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, encode(term)) <= {top})
SELECT 'pair' AS part, lang, source, item, NULL::BIGINT AS p, CAST(v AS DECIMAL(38,0)) AS value FROM pairs
UNION ALL SELECT 'term', lang, source, term, NULL, CAST(v AS DECIMAL(38,0)) FROM best
UNION ALL SELECT 'own', lang, source, NULL, p, CAST(count(*) AS DECIMAL(38,0)) FROM r GROUP BY lang, source, p
"""


def partial_sums(sized: DataFrame, scale: int = SCALE, prior: int = PRIOR, top: int = TOP_TERMS) -> DataFrame:
    """(part, lang, source, item, p, value) of each shard: sums of pairs, best terms, number of own terms of each p."""
    p = lambda n, total: _P.format(n=n, total=total, scale=scale, prior=prior)
    sql = PARTIAL.format(p=p("n", "total"), floor=p("0", "total"), q=p("lang_n", "lang_total"), top=top)

    def work(batches):
        con = _connect()
        _fill(con, batches, "lang VARCHAR, source VARCHAR, term VARCHAR, n DECIMAL(38,0), lang_n DECIMAL(38,0), total DECIMAL(38,0), lang_total DECIMAL(38,0), vocab BIGINT")
        yield from _arrow(con, sql)

    columns = ["lang", "source", "term", "n", "lang_n", "total", "lang_total", "vocab"]
    return sized.select(*columns).repartition("lang", "term").mapInArrow(work, "part string, lang string, source string, item string, p long, value decimal(38,0)")


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, scale: int = SCALE, prior: int = PRIOR, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of all (lang, source) groups.

    ``pair``: every other source of the language, by the sum of the differences over its kept
    terms. ``term``: the ``top`` terms that are more frequent in the source than in the
    language. Ranks go by value, largest first, ties by the bytes of the item.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(filled(lang).alias("lang"), filled(source).alias("source"), filled(text).alias("text"))
    kept = stored(kept_terms(term_sums(rows), min_docs), "kept-terms")
    groups = rows.select("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").cast("decimal(38,0)").alias("total"), F.count(F.lit(1)).alias("terms"))
    # a term's language count stands on the row of each source that has it: taken from the first of them
    per_term = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
    langs = per_term.groupBy("lang").agg(F.sum("lang_n").cast("decimal(38,0)").alias("lang_total"), F.count(F.lit(1)).alias("vocab"))
    zero = F.lit(0).cast("decimal(38,0)")
    sizes = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    sizes = stored(sizes.select(
        "lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", zero).alias("lang_total"), F.coalesce("vocab", F.lit(0)).alias("vocab")
    ), "sizes")
    partial = stored(partial_sums(kept.join(sizes, ["lang", "source"]), scale, prior, top), "partial")

    # the p of a term that a source does not have; 128 bits hold scale * prior and any total
    floor = F.when(F.col("vocab") > 0, 1 + F.expr(f"CAST({scale * prior} AS DECIMAL(38,0)) div (total + {prior} * vocab)")).otherwise(0).cast("long")
    sides = sizes.select("lang", "source", "terms", "vocab", floor.alias("p0"))
    other = sides.select("lang", F.col("source").alias("item"), F.col("terms").alias("item_terms"), F.col("p0").alias("item_p0"))
    pairs = sides.join(other, "lang").filter("source <> item")
    # a source's own terms against another's floor, from the number of its terms of each p
    steps = partial.filter("part = 'own'").groupBy("lang", "source", "p").agg(F.sum("value").cast("decimal(38,0)").alias("k"))
    against = steps.join(other.select("lang", "item", "item_p0"), "lang").filter("source <> item")
    lone = against.groupBy("lang", "source", "item").agg(F.sum(_exact(F.col("k") * F.abs(F.col("p") - F.col("item_p0")))).cast("decimal(38,0)").alias("v"))
    shared = partial.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").cast("decimal(38,0)").alias("v"))
    swapped = lambda t: t.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "v")
    neither = _exact((F.col("vocab") - F.col("terms") - F.col("item_terms")) * F.abs(F.col("p0") - F.col("item_p0")))
    parts = pairs.select("lang", "source", "item", neither.alias("v"))
    for t in (lone, swapped(lone), shared, swapped(shared)):
        parts = parts.unionByName(t)
    pair_rows = parts.groupBy("lang", "source", "item").agg(F.sum("v").cast("long").alias("value")).withColumn("part", F.lit("pair"))
    term_rows = partial.filter("part = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value"), "part")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = term_rows.withColumn("rank", rank).filter(F.col("rank") <= top)  # apart from the pairs, so that tasks cut their part before the shuffle
    return pair_rows.withColumn("rank", rank).unionByName(best).select("lang", "source", "part", "item", "value", "rank")


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
 t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM d),
 kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= {MIN_DOCS}),
 have AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
 groups AS (SELECT DISTINCT lang, source FROM d),
 dense AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(h.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN have h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
 sums AS (SELECT *, sum(n) OVER w AS total, sum(lang_n) OVER w AS lang_total, count(*) OVER w AS vocab FROM dense WINDOW w AS (PARTITION BY lang, source)),
 f AS (SELECT lang, source, term, n, 1 + ({SCALE}::HUGEINT * (n + {PRIOR})) // (total + {PRIOR} * vocab) AS p, 1 + ({SCALE}::HUGEINT * (lang_n + {PRIOR})) // (lang_total + {PRIOR} * vocab) AS q FROM sums),
 gaps AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS v FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source
   UNION ALL SELECT lang, source, 'term', term, p - q FROM f WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM every QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
