"""Spelling variants: words one code point apart, tied to the form that is far more frequent.

1. Tasks cut the texts into runs of letters and count them; one run in ``NOISE`` (by the crc32
   of its document and itself, in lanes of NumPy) loses a code point. Only counts are shuffled.
2. A word of n code points has n deletion keys and one of its own, all 64-bit: with prefix hashes
   P and suffix hashes S of a polynomial, the word without place i is P[i] and S[i + 1] put
   together, so the keys of a batch of words are a few array operations, whatever their lengths.
   Keys for replacements have the place mixed in.
3. Keys are radix-partitioned and sorted by Spark; one pass over the sorted keys drops those that
   meet no other: a replacement needs two words with one key, a deletion a word that is the key.
4. What is left gets its word back and is compared as strings, so that keys which collide cost
   time only. Words that are alike but for one place differ there in one of the alphabet's
   letters, which bounds every group; no pairs are made within a group: each word needs the
   number of its group and the group's most frequent other word.
5. Forms are followed to their roots by doubling; a form is ``RATIO`` times as frequent as its
   word, so there are few steps.

Defined cases: a NULL or empty text has no words; a NULL doc_id counts as an empty one; repeated
rows count again; a run of any length is a word; ties go to the smaller word in code-point order;
an empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tarnwork.llm.common import BYTE, LOWER, U, chunks, mix, powers
from tarnwork.storage import dropped, stored

#: Fixed values of the contract.
NOISE, MIN_LENGTH, MIN_COUNT, RATIO = 199, 6, 5, 5
FLUSH = 500_000
KEY_ROWS = 1 << 18
_BITS = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _BITS = np.where(_BITS & 1, np.uint32(0xEDB88320) ^ (_BITS >> 1), _BITS >> 1)

# ----------------------------------------------------------------------------- counts


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, document) of the runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8 texts."""
    low = LOWER[data]
    lead = low == 0xC3  # the only lead byte of these code points; what follows it is always one of them
    inside = ((low >= 97) & (low <= 122)) | lead
    inside[1:] |= lead[:-1]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[inside[cuts] & inside[cuts - 1]]  # runs do not go on from one text to the next
    starts, ends = np.sort(np.concatenate([first, cuts])), np.sort(np.concatenate([last, cuts]))
    return low, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The crc32 of each span, going on from the crc32 of what stands before it."""
    out = seeds.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    n = ends - starts
    rows = np.argsort(-n, kind="stable")
    n = n[rows]
    for k in range(int(n[0]) if len(n) else 0):
        rows = rows[: np.searchsorted(-n[: len(rows)], -k, "left")]
        if len(rows) < 4:  # a few long runs are left
            for i in rows:
                out[i] = zlib.crc32(data[starts[i] + k : ends[i]].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
            break
        c = out[rows]
        out[rows] = _BITS[(c ^ data[starts[rows] + k]) & 0xFF] ^ (c >> np.uint32(8))
    return out ^ np.uint32(0xFFFFFFFF)


def _n_points(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    leads = np.concatenate([[0], np.cumsum(low == 0xC3)])
    return ends - starts - (leads[ends] - leads[starts])


def words_of(ids: list, data: np.ndarray, offsets: np.ndarray, noise: int = NOISE, min_length: int = MIN_LENGTH) -> pa.Array:
    """All words of at least ``min_length`` code points, one entry for each occurrence, after the deletions."""
    low, starts, ends, doc = runs(data, offsets)
    if not len(starts):
        return pa.array([], pa.string())
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    n = _n_points(low, starts, ends)
    keep = n >= min_length
    starts, ends, doc, n = starts[keep], ends[keep], doc[keep], n[keep]
    h = crc32_spans(low, starts, ends, prefix[doc])
    hit = h % np.uint32(noise) == 0
    out = []
    for i in np.flatnonzero(hit):
        word, at = low[starts[i] : ends[i]].tobytes().decode(), int(h[i]) % int(n[i])
        if n[i] > min_length:
            out.append(word[:at] + word[at + 1 :])
    starts, ends = starts[~hit], ends[~hit]
    marks = np.zeros(len(low) + 1, np.int8)
    marks[starts] += 1
    marks[ends] -= 1
    text = low[np.cumsum(marks[:-1], dtype=np.int8).astype(bool)]
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    plain = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(text.tobytes())])
    return pa.concat_arrays([plain, pa.array(out, pa.string())])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    for i, j, data, offsets in chunks(batch.column(1)):
        yield batch.column(0).slice(i, j - i).to_pylist(), data, offsets


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) over all documents."""

    def work(batches):
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            for ids, data, offsets in _texts(batch):
                counted = pc.value_counts(words_of(ids, data, offsets, noise, min_length))
                held.append(pa.table({"word": counted.field(0), "n": counted.field(1)}))
                size += len(counted)
                if size > FLUSH:
                    held = [_summed(held)]
                    size = held[0].num_rows
                    if 2 * size > FLUSH:
                        yield from held[0].to_batches(100_000)
                        held, size = [], 0
        if held:
            yield from _summed(held).to_batches(100_000)

    found = docs.select(id_col, text_col).mapInArrow(work, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


# ------------------------------------------------------------------------------- keys


def deletion_keys(words: pa.Array, ids: np.ndarray, bits: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, word id, place, kind) of words: kind 0 the word itself, 1 without a place, 2 without a place and with it in the key.

    ``bits`` below 64 make keys collide (for tests).
    """
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    i = 0
    while i < len(words):  # about KEY_ROWS places at a time; one word is never cut
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + KEY_ROWS, "right")))
        yield _keys(words.slice(i, j - i), lengths[i:j], ids[i:j], bits)
        i = j


def _keys(words: pa.Array, lengths: np.ndarray, ids: np.ndarray, bits: int):
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(points)) - begin[owner]
    power, inverse = powers(len(points) + 2)
    value = mix(points.astype(U) + BYTE[points & 255])
    # sums of value * base**k before each place, and of value * base**(k - 1) from the next one on
    prefix = np.concatenate([np.zeros(1, U), np.cumsum(value * power[: len(points)], dtype=U)])
    ends = (begin + lengths)[owner]
    here = np.arange(len(points))
    scale = inverse[begin[owner]]
    before = (prefix[here] - prefix[begin[owner]]) * scale
    after = (prefix[ends] - prefix[here + 1]) * scale * inverse[1]
    length = lengths[owner].astype(U)
    without = mix(before + after + (length - U(1)) * U(0xA24BAED4963EE407))
    itself = mix((prefix[begin + lengths] - prefix[begin]) * inverse[begin] + lengths.astype(U) * U(0xA24BAED4963EE407))
    replaced = mix(without + (place.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
    single = np.ones(len(points), bool)  # of equal letters in a row one deletion stands for all
    single[1:] = (points[1:] != points[:-1]) | (place[1:] == 0)
    key = np.concatenate([itself, without[single], replaced])
    if bits < 64:
        key &= U((1 << bits) - 1)
    kind = np.repeat(np.array([0, 1, 2], np.int8), [len(itself), int(single.sum()), len(replaced)])
    return key, np.concatenate([ids, ids[owner][single], ids[owner]]), np.concatenate([np.zeros(len(itself), np.int64), place[single], place]).astype(np.int32), kind


def meeting(vocabulary: DataFrame, bits: int = 64) -> DataFrame:
    """(id, place, kind) of the keys that may join words: sorted runs of equal keys are read once, in order."""

    def make(batches):
        for batch in batches:
            for key, word, place, kind in deletion_keys(batch.column(1), batch.column(0).to_numpy(), bits):
                for side in (kind < 2, kind == 2):
                    yield pa.RecordBatch.from_arrays([pa.array(key[side].view(np.int64)), pa.array(word[side]), pa.array(place[side]), pa.array(kind[side])], names=["key", "id", "place", "kind"])

    def runs_of(batches):
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            last = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0  # the last run may go on
            if last:
                yield from _met([*kept, batch.slice(0, last)])
                kept = []
            if len(keys):
                if kept and kept[-1].column(0)[0].as_py() != keys[0]:
                    yield from _met(kept)
                    kept = []
                kept.append(batch.slice(last))
        yield from _met(kept)

    keys = vocabulary.select("id", "word").mapInArrow(make, "key long, id long, place int, kind byte")
    sorted_keys = keys.repartition("key").sortWithinPartitions("key")
    return sorted_keys.mapInArrow(runs_of, "key long, id long, place int, kind byte")


def _met(parts: list[pa.RecordBatch]):
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    key, kind = table["key"].to_numpy(), table["kind"].to_numpy()
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(begin, len(key)))
    count = lambda k: np.repeat(np.add.reduceat((kind == k).astype(np.int64), begin), n)
    own, gone, replaced = count(0), count(1), count(2)
    keep = np.where(kind == 2, replaced > 1, (own > 0) & (gone > 0))
    yield from table.filter(pa.array(keep)).to_batches(50_000)


# ------------------------------------------------------------------------------- links


def near_words(vocabulary: DataFrame, bits: int = 64) -> DataFrame:
    """(id, n_near, best): how many words are near, and the first of them as (-n, word). ``vocabulary`` (id, word, n): a stored table."""
    met = meeting(vocabulary, bits).join(vocabulary, "id")
    at = F.col("place")
    rest = F.when(F.col("kind") == 0, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, place)"), F.expr("substring(word, place + 2)")))
    rows = met.select("id", "word", "n", rest.alias("rest"), F.when(F.col("kind") == 2, at).otherwise(-1).alias("place"), (F.col("kind") != 0).alias("member"))
    group = Window.partitionBy("rest", "place")
    order = group.orderBy("member", F.desc("n"), "word")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    this = F.struct((-F.col("n")).alias("n"), F.col("word").alias("word"))
    ranked = rows.withColumns({
        "k": F.row_number().over(order), "size": F.count(F.lit(1)).over(group), "one": F.first(this).over(whole), "two": F.nth_value(this, 2).over(whole), "centre": ~F.first("member").over(whole)
    })
    real = ranked.filter((F.col("size") > 1) & ((F.col("place") >= 0) | F.col("centre")))
    first = F.col("k") == 1
    # the words with a deletion are near the word that is left, not each other
    links = F.when((F.col("place") >= 0) | first, F.col("size") - 1).otherwise(1)
    found = real.select("id", links.alias("links"), F.when(first, F.col("two")).otherwise(F.col("one")).alias("best"))
    return found.groupBy("id").agg(F.sum("links").cast("long").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last, twice as far in every step."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = stored(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        more = then.filter("moved").limit(1).count()
        dropped(now)
        now = then.select("word", "root")
        if not more:
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, bits: int = 64) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = stored(word_counts(docs, id_col, text_col, noise, min_length, min_count).withColumn("id", F.monotonically_increasing_id()), "words")
    near = near_words(words, bits)
    form = (F.col("best.n") * -1) >= F.col("n") * ratio
    rows = stored(words.join(near, "id", "left").select(
        "word", "n", F.when(form, F.col("best.word")).alias("form"), F.when(form, -F.col("best.n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")
    ), "variants")
    dropped(words)
    found = roots(rows.filter("form IS NOT NULL"))
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
 r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
 c AS (SELECT doc_id, w, count(*) AS k FROM r WHERE length(w) >= {MIN_LENGTH} GROUP BY ALL),
 b AS (SELECT *, flatten(list_transform(string_split(concat(doc_id, ':', w), ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END)) AS bytes FROM c),
 h AS (SELECT w, k, xor(list_reduce(bytes, lambda x, y: xor(t[CAST(xor(x, y) & 255 AS BIGINT) + 1], x >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM b, tab),
 v AS (SELECT CASE WHEN h % {NOISE} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, CAST(sum(k) AS BIGINT) AS n FROM h GROUP BY 1 HAVING sum(k) >= {MIN_COUNT} AND length(word) >= {MIN_LENGTH}),
 d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
 pairs AS (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
   UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
 best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, n AS near_n FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(near)) = 1),
 f AS (SELECT v.word, v.n, CASE WHEN near_n >= {RATIO} * v.n THEN near END AS form, CASE WHEN near_n >= {RATIO} * v.n THEN near_n END AS form_n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near FROM v LEFT JOIN best USING (word)),
 walk AS (WITH RECURSIVE s AS (SELECT word, word AS here FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.here WHERE f.form IS NOT NULL) SELECT word, here FROM s),
 top AS (SELECT walk.word, walk.here AS root FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN top USING (word)
"""
