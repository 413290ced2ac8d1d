"""Packing by non-negative least squares over shallow length combinations.

1. Tokenize; cut a document into full windows, the rest into pieces of at most half a window.
2. Count pieces by length: a histogram of at most ``window`` bins, over all documents.
3. Enumerate combinations of two to four lengths that fill a window exactly, solve their
   repeat counts against the histogram (multiplicative NNLS updates), round down, and pack
   what is left greedily, longest first into the tightest open window. Steps on the
   histogram cost the same for a thousand documents and for a billion.
4. Rank the pieces of each length, in as many buckets as the length has pieces for, so that a
   common length is no hot spot, and look up sequence and offset in the plan.

Defined cases: a NULL text is an empty one, which is the single end token; repeated rows are
packed as often as they come; an empty table gives no row; a NULL doc_id is carried along.
Other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tarnwork.storage import stored

WINDOW, END = 2048, 1
PER_BUCKET = 512
CACHE_WORDS = 300_000

# --------------------------------------------------------------------------- tokens

#: Fixed values of a tokenizer file: how it normalizes and cuts words.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUTTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
#: Texts of these characters are cut into words here exactly as such a tokenizer would: its
#: normalizer only lower-cases them and folds white space. All other texts go to it whole,
#: and so do all texts under a tokenizer whose file says anything else.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ÿ]*\Z")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
_loaded: dict[str, tuple] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        file = json.loads(text)
        simple = file["normalizer"] == _NORMALIZER and file["pre_tokenizer"] == _CUTTER and all("<|" in t["content"] for t in file.get("added_tokens", []))
        _loaded[path] = (Tokenizer.from_str(text), {}, simple)
    return _loaded[path]


def _pack_ids(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def encode(texts: list[str], path: str) -> list[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit integers.

    Equal words have equal ids, so words are looked up; a word seen for the first time is
    tokenized alone. The memory of words is bounded and starts anew when full.
    """
    tokenizer, known, simple = _tokenizer(path)
    if len(known) > CACHE_WORDS:
        known.clear()
    split: list[list[str] | None] = [_PIECE.findall(t.lower()) if simple and "<|" not in t and _PLAIN.match(t) else None for t in texts]
    new = set()
    for s in split:
        if s:
            new.update(s)
    new = [w for w in new if w not in known]
    for w, e in zip(new, tokenizer.encode_batch(new, add_special_tokens=False)):
        known[w] = _pack_ids(e.ids)
    look = known.__getitem__
    return [b"".join(map(look, s)) if s is not None else _pack_ids(tokenizer.encode(t, add_special_tokens=False).ids) for s, t in zip(split, texts)]


def cut(n: int, window: int) -> list[int]:
    """Piece lengths of a document of n tokens: full windows, then at most half a window each."""
    out = [window] * (n // window)
    rest = n % window
    if rest > window // 2:
        out.append(window // 2)
        rest -= window // 2
    return out + ([rest] if rest else [])


PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens) of every piece."""

    def work(batches):
        from tarnwork.llm.tokens import encoder

        encode_all = encoder(tokenizer_path)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                ids, begins = encode_all(texts.slice(at, 256), end)
                raw, begins = memoryview(ids.astype("<u4").tobytes()), begins.tolist()
                owner, rows = [], []
                for i, (first, last) in enumerate(zip(begins, begins[1:])):
                    start = first
                    for n in cut(last - first, window):
                        rows.append((start - first, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), last - first))
                        owner.append(at + i)
                        start += n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c, pa.int64()) for c in zip(*rows)]],
                    names=[id_col, "start", "length", "ids_crc32", "doc_tokens"],
                )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, {PIECES}")


# ----------------------------------------------------------------------------- plan


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """Rows of up to four lengths (0: none) that fill the window, each length with spread-out partners."""
    present = np.sort(present[present < window])
    if not len(present):
        return np.zeros((0, 4), np.int64)
    have = np.zeros(window + 1, bool)
    have[present] = True
    pick = lambda n: present[np.unique(np.linspace(0, len(present) - 1, n).astype(int))]
    few, fewer = pick(24), pick(8)
    two = np.stack([present, window - present], 1)
    three = np.stack([np.repeat(present, len(few)), np.tile(few, len(present))], 1)
    three = np.column_stack([three, window - three.sum(1)])
    b, c = (x.ravel() for x in np.meshgrid(fewer, fewer))
    b, c = b[b <= c], c[b <= c]
    four = np.stack([np.repeat(present, len(b)), np.tile(b, len(present)), np.tile(c, len(present))], 1)
    four = np.column_stack([four, window - four.sum(1)])
    out = []
    for rows in (two, three, four):
        rows = rows[rows[:, -1] > 0]
        rows = np.sort(rows[have[rows[:, -1]]], axis=1)[:, ::-1]
        out.append(np.pad(rows, ((0, 0), (0, 4 - rows.shape[1]))))
    return np.unique(np.concatenate(out), axis=0)


def nnls(combos: np.ndarray, histogram: np.ndarray, rounds: int = 80) -> np.ndarray:
    """x >= 0 that brings the lengths used near the histogram, in the least-squares sense."""
    if not len(combos):
        return np.zeros(0)
    b = histogram.astype(float)
    b[0] = 0
    gather = lambda v: v[combos].sum(1)  # noqa: E731  (v[0] is 0)
    spread = lambda x: _spread(combos, x, len(b))
    goal = gather(b)
    x = np.full(len(combos), max(b.sum(), 1) / (3 * len(combos)))
    for _ in range(rounds):
        x *= goal / np.maximum(gather(spread(x)), 1e-12)
    return x


def _spread(combos: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    for k in range(combos.shape[1]):
        out += np.bincount(combos[:, k], x, n)
    out[0] = 0
    return out


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences) that use up the histogram exactly."""
    left = np.zeros(window + 1, np.int64)
    for n, k in histogram.items():
        left[n] = k
    out: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    combos = combinations(np.flatnonzero(left), window)
    counts = np.floor(nnls(combos, left)).astype(np.int64)
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] <= 0:
            break
        lengths = tuple(int(n) for n in combos[i] if n)
        times = int(min(counts[i], min(left[n] // lengths.count(n) for n in lengths)))
        if times:
            for n in lengths:
                left[n] -= times
            out.append((lengths, times))
    return out + _greedy(left, window)


def _greedy(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first; equal windows move as one."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    spaces: set[int] = set()
    done: list[tuple[tuple[int, ...], int]] = []

    def put(lengths, times):
        space = window - sum(lengths)
        if space:
            room[space][lengths] = room[space].get(lengths, 0) + times
            spaces.add(space)
        else:
            done.append((lengths, times))

    for n in range(window, 0, -1):
        count = int(left[n])
        while count:
            fit = min((s for s in spaces if s >= n), default=0)
            if fit:
                lengths, times = room[fit].popitem()
                if not room[fit]:
                    spaces.discard(fit)
                each = 1 if times > count else min(fit // n, count // times)
                moved = min(times, count)
                if moved < times:
                    room[fit][lengths] = times - moved
                    spaces.add(fit)
            else:
                lengths, each = (), min(window // n, count)
                moved = count // each
            put(lengths + (n,) * each, moved)
            count -= moved * each
    return done + [(k, t) for group in room.values() for k, t in group.items()]


def lookup(sequences: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length, first rank) keys with first rank, first sequence and offset."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for lengths, times in sequences:
        offset = 0
        for n in lengths:
            rows.append((n << 48 | used[n], used[n], base, offset))
            used[n] += times
            offset += n
        base += times
    rows.sort()
    cols = list(zip(*rows)) or [(), (), (), ()]
    return tuple(np.array(c, np.int64) for c in cols)


def pack(cut_pieces: DataFrame, id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """The pieces with sequence_id and offset. ``cut_pieces`` is read several times: a stored table, with a column ``number`` that differs from piece to piece."""
    spark = cut_pieces.sparkSession
    histogram = {int(r[0]): int(r[1]) for r in cut_pieces.groupBy("length").count().collect()}  # at most ``window`` rows
    table = spark.sparkContext.broadcast(lookup(plan(histogram, window)))
    parts = spark.createDataFrame([(n, -(-k // PER_BUCKET)) for n, k in sorted(histogram.items())] or [(1, 1)], "length long, __q long")
    dealt = cut_pieces.join(F.broadcast(parts), "length").withColumn("__b", F.pmod(F.xxhash64("number"), F.col("__q")))
    per = dealt.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("__n"))
    # what lies before a bucket, by groups of PER_BUCKET buckets and then within the group: no window holds all buckets of a common length
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    grouped = per.withColumn("__u", F.floor(F.col("__b") / PER_BUCKET))
    groups = grouped.groupBy("length", "__u").agg(F.sum("__n").alias("__m")).select("length", "__u", F.coalesce(F.sum("__m").over(before(["length"], "__u")), F.lit(0)).alias("__o"))
    inside = grouped.select("length", "__u", "__b", F.coalesce(F.sum("__n").over(before(["length", "__u"], "__b")), F.lit(0)).alias("__i"))
    starts = inside.join(groups, ["length", "__u"]).select("length", "__b", (F.col("__i") + F.col("__o")).alias("__s"))
    rank = Window.partitionBy("length", "__b").orderBy(id_col, "start", "ids_crc32", "number")
    ranked = dealt.withColumn("__r", F.row_number().over(rank) - 1).join(starts, ["length", "__b"])
    rows = ranked.select(id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("__s") + F.col("__r")).cast("long").alias("__r"))

    def work(batches):
        keys, first, base, offset = table.value
        for batch in batches:
            n, r = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (n << 48) | r, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(base[at] + r - first[at]), pa.array(offset[at])], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            )

    kind = cut_pieces.select(id_col).schema[0].dataType.simpleString()
    return rows.mapInArrow(work, f"`{id_col}` {kind}, {PIECES}, sequence_id long, offset long")


def run(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    cut_pieces = pieces(docs, tokenizer_path, id_col, text_col, window).withColumn("number", F.monotonically_increasing_id())
    return pack(stored(cut_pieces, "pieces"), id_col, window)


def query(spark, sf_dir: str) -> DataFrame:
    return run(spark.read.parquet(f"{sf_dir}/documents.parquet"))
