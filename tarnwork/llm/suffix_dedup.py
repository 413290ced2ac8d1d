"""Exact removal of repeated 100-byte strings by prefix-free parsing.

Every byte goes that a 100-byte string covers which also starts earlier (smaller doc_id, or
same document, earlier start). Texts are UTF-8 bytes, matches stay within a document.

* Parse: a trigger is the least rolling hash (of ``GRAM`` bytes) in a window as long as a
  string has grams. It depends on the string alone, so equal strings have equal triggers at
  equal places, and every string has one, which bounds the phrases. A phrase is a trigger with
  the bytes of all strings that it decides, about thirty starts.
* Dictionary: only triggers that occur twice matter. Of their phrases, each distinct one is
  kept once, at its first place; later copies are repeats as a whole.
* Suffix order: of the phrases left that share a trigger with another one, all suffixes of
  ``LENGTH`` bytes are brought into classes of equal suffixes, and all but the first of a
  class are repeats. Equality at depth 100 is all that is asked for, so suffixes are ordered
  by 96-bit fingerprints (phrases: 128), not by their bytes.

Work beyond the first pass follows the repeated part of the text. A text that is needed
again is shuffled only if its document is marked in a bitmap of fixed size (a false mark
costs time only). Sorted streams are read row by row, so a trigger that a third of all
documents share needs no memory. Rows that their own task shows to be repeats are salted, so
neither such a trigger nor such a suffix gathers in one task.

Texts of any length are worked through in segments that overlap by a string, so no array is
larger than a segment.

Defined cases: NULL is an empty text; texts under 100 bytes lose nothing; doc_id is the key,
and rows that repeat one with its text are judged alike. Of several texts under one id that
with the smallest SHA-256 is the document; the others lose nothing and cost no other text
anything, as do rows without doc_id. An id that is no integer is an error (under ANSI mode,
which is Spark's default). An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnwork.llm.common import U, chunks, marked, mix, powers, prefix_hash, span_hash
from tarnwork.storage import dropped, stored

LENGTH, GRAM = 100, 32
SEGMENT = 1 << 22  # bytes of a text that are worked through at a time
INDEX = 28  # bits of a place within a segment or chunk; the rest of a word orders the grams
PLACE = 31  # bits of a place within a text
TABLE, SALT_BITS = 1 << 16, 20
KNOWN = 40  # bit of ``at``, above a place and the length of its phrase
PASSES = 2  # over the suffixes, a power of two; more need less disk and more time


def parse(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(trigger hash, first start, last start, document) of every phrase, in text order."""
    n = len(data)
    none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    if n < length:
        return none
    prefix = prefix_hash(data)
    inverse = powers(n + 1)[1]
    h = mix((prefix[gram:] - prefix[:-gram]) * inverse[: n - gram + 1])
    least = (h >> U(INDEX) << U(INDEX)) | np.arange(len(h), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    start = np.arange(len(least))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(start)]
    start = start[start + length <= offsets[doc + 1]]
    if not len(start):
        return none
    at = (least[start] & U((1 << INDEX) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return h[at[first]], start[first], start[last], doc[start[first]]


def parse_all(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """:func:`parse` of texts, or of one text of any length, with starts relative to their text."""
    if len(data) <= 2 * SEGMENT or len(offsets) > 2:
        h, lo, hi, doc = parse(data, offsets, length, gram)
        yield h, lo - offsets[doc], hi - offsets[doc], doc
        return
    for base in range(0, len(data), SEGMENT):  # strings that start in this segment; the next one has the others
        part = data[base : base + SEGMENT + length - 1]
        h, lo, hi, doc = parse(part, np.array([0, len(part)]), length, gram)
        yield h, lo + base, hi + base, doc


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of short spans of one text, segment by segment."""
    out, segment = np.empty(len(start), np.uint64), start // SEGMENT
    for k in np.unique(segment):
        rows, base = segment == k, int(k) * SEGMENT
        prefix = prefix_hash(data[base : end[rows].max()], which)
        out[rows] = span_hash(prefix, start[rows] - base, end[rows] - base, which)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text")


def triggers(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, doc_id, at): every phrase's trigger hash, first start and number of further starts, ``at`` as of :func:`_repeats`.

    A trigger that a task has met before is surely repeated. Of such places one for each task
    tells the other tasks so, and the rest are dealt anywhere.
    """

    def work(batches):
        met, told = np.zeros(TABLE, np.uint64), np.zeros(TABLE, np.uint64)  # hints only: a later hash takes the slot
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, h, lo, hi, doc in ((i, *found) for i, _, data, offsets in chunks(batch.column(1)) for found in parse_all(data, offsets, length, gram)):
                own, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                slot = (own & U(TABLE - 1)).astype(np.int64)
                spoken = told[slot] == own
                repeated = (count > 1) | (met[slot] == own) | spoken
                known = repeated[inverse]
                speaks = np.zeros(len(h), bool)
                speaks[first[~spoken]] = True
                met[slot], told[slot[repeated]] = own, own[repeated]
                doc_id = ids[i + doc]
                at = _dealt(lo | (hi - lo) << PLACE, known, speaks, doc_id)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc_id), pa.array(at)], names=["h", "doc_id", "at"])

    return _texts(docs).mapInArrow(work, "h long, doc_id long, at long")


def _dealt(place: np.ndarray, known: np.ndarray, speaks: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """``place`` with KNOWN where a row surely belongs to the result, and a salt where no other row needs it."""
    salt = np.where(known & ~speaks, (mix(doc_id.view(np.uint64) + place.astype(np.uint64)) >> U(64 - SALT_BITS)).astype(np.int64) + 1, 0)
    return place.astype(np.int64) | known.astype(np.int64) << KNOWN | salt << KNOWN + 1


def _neighbours(batches, keys: int, emit_first: bool):
    """Rows of a stream sorted by its first ``keys`` columns that equal a neighbour in them, or are KNOWN.

    Without ``emit_first`` the first row of each class is left out, unless it is KNOWN.
    """
    held = None  # the last row, and whether it has an equal before it
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([held[0], batch]) if held else pa.Table.from_batches([batch])
        cols = [table.column(k).to_numpy() for k in range(keys)]
        same = np.ones(table.num_rows - 1, bool)
        for c in cols:
            same &= c[1:] == c[:-1]
        before = np.concatenate([[held[1] if held else False], same])
        before |= (table.column("at").to_numpy() >> KNOWN & 1).astype(bool)
        after = np.concatenate([same, [False]])
        keep = before | after if emit_first else before.copy()
        keep[-1] = False
        yield table.filter(pa.array(keep)).combine_chunks()
        held = (pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.slice(table.num_rows - 1).columns], schema=table.schema), bool(before[-1]))
    if held and held[1]:
        yield pa.Table.from_batches([held[0]])


def _repeats(rows: DataFrame, keys: list[str], emit_first: bool) -> DataFrame:
    """(keys, doc_id, place) of the rows that share ``keys``; without ``emit_first`` not the earliest of a class.

    ``at`` holds the place, above it the KNOWN bit and the salt. Salted rows are KNOWN and
    spread, so a class of any size leaves a few rows of each task to meet.
    """
    n = len(keys)
    place = F.col("at").bitwiseAND(F.lit((1 << KNOWN) - 1))

    def work(batches):
        for table in _neighbours(batches, n, emit_first):
            yield from table.to_batches()

    dealt = rows.repartition(*keys, F.shiftright("at", KNOWN + 1)).sortWithinPartitions(*keys, "doc_id", place)
    return dealt.mapInArrow(work, rows.schema).select(*keys, "doc_id", place.alias("place"))


def _texts_of(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``marks`` (one row a document) with the documents' texts."""
    some = marked(_texts(docs), marks, "doc_id")
    return some.join(marks.hint("merge"), "doc_id")  # in order of doc_id, so that a task that runs again salts alike


def _per_document(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("at"))


def _with_text(joined: DataFrame, schema: str, each, all_of=None) -> DataFrame:
    """Runs ``each(doc_id, bytes, structs as numpy columns)`` for every row, and ``all_of`` on the columns of many; both return columns."""

    def work(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("at"))
            ids, texts = batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("text"))
            ends, flat = lists.offsets.to_numpy(), [f.to_numpy() for f in lists.values.flatten()]
            parts = []
            for i, text in enumerate(texts):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                parts.append(each(ids[i].as_py(), data, [f[ends[i] : ends[i + 1]] for f in flat]))
                if sum(len(p[0]) for p in parts) > 200_000:
                    yield from _emit(parts)
                    parts = []
            yield from _emit(parts)

    names = [c.split()[0] for c in schema.split(", ")]

    def _emit(parts):
        if parts:
            cols = [np.concatenate(c) for c in zip(*parts)]
            cols = all_of(*cols) if all_of else cols
            yield pa.RecordBatch.from_arrays([pa.array(c) if c.dtype != np.uint64 else pa.array(c.view(np.int64)) for c in cols], names=names)

    return joined.select("doc_id", "text", "at").mapInArrow(work, schema)


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    ``documents`` should be a scan of a table: salting goes by the order in which a task reads.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = stored(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "digests")
    own = F.col("doc_id").isNotNull()
    if not base.filter(own).groupBy("doc_id").count().filter("count > 1").isEmpty():  # a repeated row is no second place of its own strings
        one = stored(base.filter(own).groupBy("doc_id").agg(F.min("sha").alias("own")), "ids")
        docs = stored(docs.join(one, "doc_id").filter(F.sha2("text", 256) == F.col("own")).select("doc_id", "text").dropDuplicates(["doc_id"]), "rows")
        base = stored(base.join(one, "doc_id", "left").withColumn("part", F.col("own").isNotNull() & (F.col("sha") == F.col("own"))).drop("own"), "digests")
    else:
        base = base.withColumn("part", own)
    whole = base.filter((F.col("n_bytes") >= length) & F.col("part"))
    # a text that stands whole in an earlier document goes whole, and nothing needs it
    firsts = stored(whole.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first"), "firsts")
    copies = stored(whole.join(firsts, "sha").filter("doc_id <> first").select("doc_id").distinct(), "copies")

    twice = _repeats(triggers(docs, length, gram), ["h"], True)
    kept = stored(twice.join(copies, "doc_id", "left_anti"), "triggers")

    def contexts(doc_id, data, at):
        h, place = at
        lo, hi = place & ((1 << PLACE) - 1), (place & ((1 << PLACE) - 1)) + (place >> PLACE)
        c = [span_hashes(data, lo, hi + length, k) for k in (0, 1)]
        return [h, *c, np.full(len(lo), doc_id), lo.astype(np.int32), hi.astype(np.int32)]

    phrases = stored(_with_text(_texts_of(docs, _per_document(kept.distinct(), "h", "place")), "h long, c1 long, c2 long, doc_id long, lo int, hi int", contexts), "phrases")
    dropped(kept)
    dictionary = stored(phrases.groupBy("h", "c1", "c2").agg(F.min(F.struct("doc_id", "lo", "hi")).alias("first"), F.count(F.lit(1)).alias("n")), "dictionary")
    again = dictionary.filter("n > 1").select("c1", "c2", F.col("first.doc_id").alias("fd"), F.col("first.lo").alias("fl"))
    copied = stored(phrases.join(again, ["c1", "c2"]).filter((F.col("doc_id") != F.col("fd")) | (F.col("lo") != F.col("fl"))).select("doc_id", "lo", (F.col("hi") + length).alias("hi")), "copied")
    dropped(phrases)
    several = dictionary.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("h")
    several = stored(dictionary.select("h", "first").join(stored(several, "several"), "h").select("h", "first.doc_id", "first.lo", "first.hi"), "suffixes")

    def suffixes(doc_id, data, at):
        lo, n = at[0].astype(np.int64), at[1].astype(np.int64) - at[0] + 1
        s = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        w1 = span_hashes(data, s, s + length)
        w2 = span_hashes(data, s, s + length, 1)
        return [w1, (w2 >> U(32)).astype(np.uint32).view(np.int32), np.full(len(s), doc_id), s]

    def later_here(w1, w2, doc_id, s):
        """All but the earliest of a class among these rows are repeats, whatever other tasks hold."""
        order = np.lexsort((s, doc_id, w2, w1))
        known = np.zeros(len(s), bool)
        known[order[1:]] = (w1[order[1:]] == w1[order[:-1]]) & (w2[order[1:]] == w2[order[:-1]])
        return [w1, w2, doc_id, _dealt(s, known, ~known, doc_id)]

    dropped(dictionary)
    spans = copied
    for part in range(PASSES):  # by trigger, which equal suffixes share, so that the suffixes of one pass alone are on disk
        own = several.filter(F.col("h").bitwiseAND(F.lit(PASSES - 1)) == part)
        rows = _with_text(_texts_of(docs, _per_document(own, "lo", "hi")), "w1 long, w2 int, doc_id long, at long", suffixes, later_here)
        later = stored(_repeats(rows, ["w1", "w2"], False).select("doc_id", F.col("place").cast("int").alias("lo")), "later")
        spans = spans.unionByName(later.select("doc_id", "lo", (F.col("lo") + length).alias("hi")))

    def cut(doc_id, data, at):
        lo, hi = at
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order].astype(np.int64), np.maximum.accumulate(hi[order].astype(np.int64))
        new = np.concatenate([[True], lo[1:] > hi[:-1]])
        first = lo[new]
        last = hi[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])]
        digest, end = hashlib.sha256(), 0
        for a, b in zip(first, last):
            digest.update(data[end:a].tobytes())
            end = b
        digest.update(data[end:].tobytes())
        return [np.array([doc_id]), np.array([(last - first).sum()]), np.array([len(first)]), np.array([digest.hexdigest()], object)]

    removed = _with_text(_texts_of(docs, _per_document(spans, "lo", "hi")), "doc_id long, n_removed long, n_spans long, kept_sha256 string", cut).dropDuplicates(["doc_id"])
    gone = copies.withColumn("copy", F.lit(True))
    empty = hashlib.sha256(b"").hexdigest()
    out = base.join(removed, "doc_id", "left").join(gone, "doc_id", "left")
    copy, part = F.col("copy").isNotNull() & F.col("part"), F.col("part")
    return out.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.when(part, F.coalesce("n_removed", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.when(part, F.coalesce("n_spans", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))).alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.when(part, F.coalesce("kept_sha256", "sha")).otherwise(F.col("sha"))).alias("kept_sha256"),
    )


# every 100-byte string on its own, as hexadecimal digits: for small tables
SQL = r"""
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), parts AS (
  SELECT doc_id, p, substr(x, 2 * p + 1, 2198) AS x FROM (SELECT doc_id, x, unnest(range(0, greatest(len(x) // 2 - 99, 0), 1000)) AS p FROM h)
), starts AS (
  SELECT doc_id, p + q AS s, md5_number(substr(x, 2 * q + 1, 200)) AS k FROM (SELECT doc_id, p, x, unnest(range(0, least(1000, len(x) // 2 - 99))) AS q FROM parts)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM starts) WHERE r > 1
), runs AS (
  SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run
  FROM (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 1 ELSE 0 END AS new FROM later)
), spans AS (
  SELECT doc_id, min(s) AS lo, max(s) + 100 AS hi FROM runs GROUP BY doc_id, run
), pieces AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM spans
  UNION ALL SELECT h.doc_id, coalesce(m.e, 0), len(x) // 2 FROM h LEFT JOIN (SELECT doc_id, max(hi) AS e FROM spans GROUP BY doc_id) m ON h.doc_id = m.doc_id
), kept AS (
  SELECT h.doc_id, count(*) - 1 AS n_spans, sum(b - a) AS n_kept, string_agg(substr(x, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS x
  FROM h JOIN pieces p ON h.doc_id = p.doc_id GROUP BY h.doc_id
)
SELECT h.doc_id, CAST(len(h.x) // 2 AS BIGINT) AS n_bytes, CAST(len(h.x) // 2 - n_kept AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(k.x)) AS kept_sha256
FROM h JOIN kept k ON h.doc_id = k.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
