"""Token-id files in Simple-8b: 64-bit words whose selector says how many ids share the word.

A word has a 4-bit selector and 60 bits of payload, for 60 ids of one bit up to one id of 60
bits. Ids are coded in blocks of ``BLOCK``; a block's words stand alone, and the file lists
where each block begins, so any range of blocks is decoded at once with a few array
operations per selector. An id of more than 60 bits is an escape: its word (selector 0) holds
a place in the list of full ids that ends the block, so no word depends on the one before.

A file, all integers little-endian::

    magic | blocks: words, then escapes | documents (Arrow stream: id, start) | word offset of
    each block and of the end, uint64 | escapes of each block, uint32 | trailer: ids, blocks,
    bytes of the documents, uint64 | magic

``write`` deals documents by ranges of their ids, so that files follow the order of ids; every
task tokenizes its range and writes files of about ``IDS_PER_FILE`` ids. Names are unique, and
only those that a finished task has reported are in the table that it returns, so a task that
runs again leaves a file which nobody reads. ``read`` decodes the files, several documents at a
time.

Defined cases: a NULL or empty text is the end token alone; documents that share an id are
ordered by a hash of their text (equal ones are interchangeable); NULL ids come first; an empty
table gives no file and no row; a text may be of any length that Spark's own strings have, and
its ids must fit in one binary value (500 million). Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tarnwork.llm.tokens import encoder
from tarnwork.storage import new_path, stored

END = 2
BLOCK = 1024
IDS_PER_FILE = 1 << 27
CHUNK_IDS = 1 << 20
MAGIC = b"TWS8B001"
TRAILER = struct.Struct("<QQQ8s")
ESCAPE = 0
#: Fixed values: (selector, ids in a word, bits of each), as published for Simple-8b.
LAYOUT = [(2, 60, 1), (3, 30, 2), (4, 20, 3), (5, 15, 4), (6, 12, 5), (7, 10, 6), (8, 8, 7), (9, 7, 8), (10, 6, 10), (11, 5, 12), (12, 4, 15), (13, 3, 20), (14, 2, 30), (15, 1, 60)]
COUNTS = np.zeros(16, np.int64)
COUNTS[ESCAPE] = 1
for _s, _n, _b in LAYOUT:
    COUNTS[_s] = _n
LIMITS = np.array([1 << b for _, _, b in LAYOUT], np.uint64)
PAD = max(n for _, n, _ in LAYOUT)
U = np.uint64

# ------------------------------------------------------------------------------ words


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words and escapes, words of each block with its escapes, escapes of each block) of unsigned ids."""
    ids = ids.astype(U)
    rows = -(-len(ids) // block)
    if not rows:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.zeros((rows, block + PAD), U)
    flat = np.zeros(rows * block, U)
    flat[: len(ids)] = ids
    value[:, :block] = flat.reshape(rows, block)
    length = np.full(rows, block)
    length[-1] = len(ids) - (rows - 1) * block
    # the narrowest layout that holds each id, and of runs of ids by maxima over windows that double
    need = np.searchsorted(LIMITS, value.ravel(), "right").astype(np.uint8).reshape(value.shape)
    best, tops, at = np.full(value.shape, 255, np.uint8), {1: need}, 1
    for k in range(len(LAYOUT) - 1, -1, -1):
        n = LAYOUT[k][1]
        while 2 * at <= n:
            tops[2 * at] = _window(tops[at], tops[at], at)
            at *= 2
        top = tops[n] if n in tops else _window(tops[at], tops[at], n - at)
        np.copyto(best, np.uint8(k), where=top <= k)
    # greedily from left to right, all blocks in step; 255: an escape
    step = np.append(np.array([n for _, n, _ in LAYOUT]), [1])
    begins = np.zeros(value.shape, bool)
    lane, place = np.arange(rows), np.zeros(rows, np.int64)
    while len(lane):
        begins[lane, place] = True
        place += step[np.minimum(best[lane, place], len(LAYOUT))]
        more = place < length[lane]
        lane, place = lane[more], place[more]
    start = np.flatnonzero(begins.ravel())
    chosen, whole = best.ravel()[start], value.ravel()
    words = np.zeros(len(start), U)
    for k, (s, n, bits) in enumerate(LAYOUT):
        mine = np.flatnonzero(chosen == k)
        if len(mine):
            fields = whole[start[mine][:, None] + np.arange(n)] << (np.arange(n, dtype=U) * U(bits))
            words[mine] = np.bitwise_or.reduce(fields, 1) | U(s << 60)
    per = begins.sum(1)
    escaped = np.flatnonzero(chosen == 255)
    if not len(escaped):
        return words, per, np.zeros(rows, np.int64)
    home = np.searchsorted(np.cumsum(per), escaped, "right")
    n_escaped = np.bincount(home, minlength=rows)
    words[escaped] = (np.arange(len(escaped)) - (np.cumsum(n_escaped) - n_escaped)[home]).astype(U)
    ends = np.cumsum(per)
    return np.insert(words, ends[home], whole[start[escaped]]), per + n_escaped, n_escaped


def _window(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
    """Maxima of windows that begin at each place, from those of a shorter window and of one ``shift`` later; nothing counts beyond a row's end."""
    out = left.copy()
    if shift:
        np.maximum(out[:, :-shift], right[:, shift:], out=out[:, :-shift])
    return out


def decode_blocks(words: np.ndarray, per: np.ndarray, escapes: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
    """The first ``n_ids`` ids of whole blocks, the inverse of :func:`encode_blocks`."""
    rows = len(per)
    if not rows:
        return np.zeros(0, U)
    home = np.repeat(np.arange(rows), per)
    begin = np.cumsum(per) - per
    full = np.zeros(0, U)
    if escapes.any():
        tail = np.arange(len(words)) >= (begin + per - escapes)[home]
        full, words, home = words[tail], words[~tail], home[~tail]
        per = per - escapes
        begin = np.cumsum(per) - per
    selector = (words >> U(60)).astype(np.int64)
    held = COUNTS[selector]
    before = np.cumsum(held) - held
    width = block + PAD
    place = before - before[begin][home] + home * width
    out = np.zeros(rows * width, U)
    for s, n, bits in LAYOUT:
        mine = np.flatnonzero(selector == s)
        if len(mine):
            out[place[mine][:, None] + np.arange(n)] = (words[mine][:, None] >> (np.arange(n, dtype=U) * U(bits))) & U((1 << bits) - 1)
    mine = np.flatnonzero(selector == ESCAPE)
    if len(mine):
        out[place[mine]] = full[(np.cumsum(escapes) - escapes)[home[mine]] + words[mine].astype(np.int64)]
    return out.reshape(rows, width)[:, :block].ravel()[:n_ids]


# ------------------------------------------------------------------------------ files


class Writer:
    """One file: ids are added document by document and coded a chunk of blocks at a time."""

    def __init__(self, fs, name: str, id_type: pa.DataType):
        self.name, self.id_type, self.out = name, id_type, fs.open_output_stream(name, compression=None)
        self.out.write(MAGIC)
        self.buffer: list[np.ndarray] = []
        self.waiting = self.n_ids = 0
        self.keys: list[pa.Array] = []
        self.starts: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []

    def add(self, keys: pa.Array, ids: np.ndarray, begins: np.ndarray) -> None:
        """Documents with their ids, and where each one's begin among them."""
        self.keys.append(keys)
        self.starts.append(self.n_ids + begins[:-1])
        self.buffer.append(ids)
        self.n_ids += len(ids)
        self.waiting += len(ids)
        if self.waiting >= CHUNK_IDS:
            self._code(False)

    def _code(self, last: bool) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.buffer])
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for at in range(0, whole, CHUNK_IDS):
            words, per, escapes = encode_blocks(ids[at : min(at + CHUNK_IDS, whole)])
            self.out.write(words.astype("<u8").tobytes())
            self.sizes.append(per)
            self.escapes.append(escapes)
        self.buffer, self.waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> tuple[int, int]:
        """(ids, documents)"""
        self._code(True)
        sizes = np.concatenate([[0], *self.sizes])
        keys = pa.chunked_array(self.keys, self.id_type)
        table = pa.table({"id": keys, "start": pa.array(np.concatenate(self.starts))})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        docs = sink.getvalue().to_pybytes()
        self.out.write(docs)
        self.out.write(np.cumsum(sizes).astype("<u8").tobytes())
        self.out.write(np.concatenate([np.zeros(0, np.int64), *self.escapes]).astype("<u4").tobytes())
        self.out.write(TRAILER.pack(self.n_ids, len(sizes) - 1, len(docs), MAGIC))
        self.out.close()
        return self.n_ids, len(keys)


class Reader:
    """One file: its documents, and ids of any range."""

    def __init__(self, fs, name: str):
        self.file = fs.open_input_file(name)
        size = self.file.size()
        self.n_ids, blocks, n_docs, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{name} is no token-id file")
        tail = self.file.read_at(8 * (blocks + 1) + 4 * blocks, size - TRAILER.size - 8 * (blocks + 1) - 4 * blocks)
        self.offsets = np.frombuffer(tail, "<u8", blocks + 1).astype(np.int64)
        self.escapes = np.frombuffer(tail, "<u4", blocks, 8 * (blocks + 1)).astype(np.int64)
        table = pa.ipc.open_stream(self.file.read_at(n_docs, len(MAGIC) + 8 * int(self.offsets[-1]))).read_all()
        self.keys, self.starts = table["id"].combine_chunks(), table["start"].to_numpy()

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end), from the blocks that hold them."""
        a, b = start // BLOCK, -(-end // BLOCK)
        words = np.frombuffer(self.file.read_at(8 * int(self.offsets[b] - self.offsets[a]), len(MAGIC) + 8 * int(self.offsets[a])), "<u8").astype(U)
        n = min(b * BLOCK, self.n_ids) - a * BLOCK
        return decode_blocks(words, np.diff(self.offsets[a : b + 1]), self.escapes[a:b], n)[start - a * BLOCK : end - a * BLOCK]

    def documents(self):
        """(first document, document after the last, their ids), about a chunk of ids at a time."""
        i, n = 0, len(self.starts)
        ends = np.append(self.starts[1:], self.n_ids) if n else self.starts
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, self.starts[i] + CHUNK_IDS, "right")))
            yield i, j, self.ids(int(self.starts[i]), int(ends[j - 1]))
            i = j


# ------------------------------------------------------------------------------ Spark


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Writes the files; returns (part, seq, file, ids, docs), part and seq in the order of document ids."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__h"), F.monotonically_increasing_id().alias("__m"))
    ordered = rows.repartitionByRange("__id", "__h", "__m").sortWithinPartitions("__id", "__h", "__m").select("__id", "__text")

    def work(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, seq, out, encode = TaskContext.get().partitionId(), 0, None, encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, texts = (c.slice(at, 256) for c in batch.columns)
                out = out or Writer(fs, f"{root}/{uuid.uuid4().hex}.s8b", keys.type)
                out.add(keys, *encode(texts, end))
                if out.n_ids >= ids_per_file:
                    yield _entry(part, seq, out)
                    seq, out = seq + 1, None
        if out:
            yield _entry(part, seq, out)

    return ordered.mapInArrow(work, "part int, seq int, file string, ids long, docs long")


def _entry(part: int, seq: int, out: Writer) -> pa.RecordBatch:
    ids, docs = out.close()
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([out.name]), pa.array([ids], pa.int64()), pa.array([docs], pa.int64())], names=["part", "seq", "file", "ids", "docs"])


def read(files: DataFrame, folder: str, id_col: str = "doc_id", id_type: str = "long") -> DataFrame:
    """(id, start, n_tokens, ids) of every document: ``start`` counts the ids of all documents before it, ``ids`` are little-endian unsigned 32-bit integers."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    based = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long").alias("base"))

    def work(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = Reader(fs, name)
                ends = np.append(reader.starts[1:], reader.n_ids)
                for i, j, ids in reader.documents():
                    starts, n = reader.starts[i:j], ends[i:j] - reader.starts[i:j]
                    offsets = 4 * np.append(starts - starts[0], ends[j - 1] - starts[0])
                    data = pa.py_buffer(ids.astype("<u4").tobytes())
                    blob = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), data]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([reader.keys.slice(i, j - i), pa.array(base + starts), pa.array(n), blob], names=[id_col, "start", "n_tokens", "ids"])

    return based.repartition(max(1, files.count())).mapInArrow(work, f"`{id_col}` {id_type}, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = END, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """The documents' ids, written to files in the shared folder and read back from them."""
    folder = new_path(docs.sparkSession, "token-ids")
    files = stored(write(docs, folder, tokenizer_path or tokenizer_file(), id_col, text_col, end, ids_per_file), "token-files")
    return read(files, folder, id_col, docs.select(id_col).schema[0].dataType.simpleString())


def query(spark, sf_dir: str) -> DataFrame:
    rows = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
