"""WARC archives: written whole, normalised to one gzip member a record, read by offset.

* ``write``: each task writes one archive as a monolithic gzip stream.
* ``normalise``: each archive is inflated once, as a stream; every record becomes a gzip
  member of its own, and a sidecar index lists offset, length and record id. The monolithic
  file then goes.
* ``read``: every record is read from its member by the index, and its digest checked.

Records of equal payloads of at least ``MIN_REVISIT`` bytes: the one with the largest page_id
is the response, the others revisit it.

Records are WARC/1.0: a response holds an HTTP message with the payload as its body, a revisit
the head of that message, its profile and the record it refers to. Record ids are derived
from page_id, digest and, for rows that repeat both, their number, so they are unique and a
revisit knows the id that it refers to. All records of a run carry one date.

Files lie in the shared folder and are reached through pyarrow's file systems, so it may be
a local path or an object store. They get their final name only when complete; a task that
runs again writes the same rows anew under another name, and only names that a finished
task has reported are read.

Defined cases: a NULL payload is empty, a NULL url is written as an empty one; CR and LF in a
url are written as %0D and %0A; rows of one page_id are records of their own (of equal long
payloads under the largest page_id, all are responses); a NULL page_id is carried and is
smaller than any other; payloads may have any length that a row has; an empty table gives no file and
no row. Other columns are not read.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window, functions as F

from tarnwork.storage import new_path, stored

MIN_REVISIT = 1000
LEVEL = 4
BLOCK = 1 << 18


def _fs(uri: str):
    return pafs.FileSystem.from_uri(uri)


_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "tarnwork:warc")
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def record_id(page_id, digest: str, number: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}/{number}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to: int | None, number: int = 1, date: str = "1970-01-01T00:00:00Z") -> bytes:
    first = refers_to is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first else http
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.0", f"WARC-Type: {'response' if first else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, number)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if not first:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["" if page_id is None else f"X-Page-ID: {page_id}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(x for x in head if x).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def split_records(blocks):
    """Whole records from a stream of byte blocks; holds one record at a time."""
    buffer = bytearray()
    need = -1
    for block in blocks:
        buffer += block
        while True:
            if need < 0:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                fields = dict(x.split(b": ", 1) for x in bytes(buffer[:end]).split(b"\r\n")[1:] if b": " in x)
                need = end + 4 + int(fields[b"Content-Length"]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = -1
    if buffer:
        raise ValueError("truncated archive")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    return fields, rest[: int(fields["Content-Length"])]


def decisions(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", url_col: str = "url", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, number): refers_to for revisits; number counts rows of one page_id and digest.

    Which page stands for a payload is settled on narrow rows; the payloads themselves are
    dealt by page_id and digest, so a payload that very many pages share is no hot spot.
    """
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"), F.sha1(body).alias("digest"))
    long = base.filter(F.octet_length("payload") >= min_revisit).select("page_id", F.col("digest").alias("d"))
    # combined before the shuffle, so a page with very many copies costs one row a task
    groups = long.groupBy("d").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("d", "last")
    key = F.coalesce("page_id", F.lit(-(2**63)))
    older = long.join(stored(groups, "payloads"), "d").filter(~F.col("page_id").eqNullSafe(F.col("last"))).select(key.alias("k"), F.col("d").alias("digest"), "last").distinct()
    joined = base.withColumn("k", key).join(older, ["k", "digest"], "left")
    number = F.row_number().over(Window.partitionBy("k", "digest").orderBy("url"))  # dealt like the join: the payloads are shuffled once
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"), number.alias("number"))


def write(rows: DataFrame, folder: str) -> DataFrame:
    """One monolithic .warc.gz a task; returns (file, records)."""
    date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def work(batches):
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        name, n, out, gz = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, None, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                out = out or fs.open_output_stream(name, compression=None)
                out.write(gz.compress(record(*row, date)))
                n += 1
        if out:
            out.write(gz.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})

    return rows.mapInArrow(work, "file string, records long")


def _inflate(stream):
    inflater = zlib.decompressobj(31)
    while block := stream.read(BLOCK):
        while block:
            yield inflater.decompress(block)
            block = inflater.unused_data
            if inflater.eof:
                inflater = zlib.decompressobj(31)


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites each file; returns (file, index, records)."""

    def work(batches):
        fs, _ = _fs(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                stem = f"{name.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}"
                offset, lines = 0, []
                with fs.open_input_stream(name, compression=None) as source, fs.open_output_stream(f"{stem}.norm.warc.gz", compression=None) as out:
                    for raw in split_records(_inflate(source)):
                        gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = gz.compress(raw) + gz.flush()
                        out.write(member)
                        lines.append(f"{offset}\t{len(member)}\t{parse_id(raw)}\n")
                        offset += len(member)
                with fs.open_output_stream(f"{stem}.idx", compression=None) as out:
                    out.write("".join(lines).encode())
                yield pa.RecordBatch.from_pydict({"file": [f"{stem}.norm.warc.gz"], "index": [f"{stem}.idx"], "records": pa.array([len(lines)], pa.int64())})

    return files.select("file").mapInArrow(work, "file string, index string, records long")


def parse_id(raw: bytes) -> str:
    return raw.split(b"WARC-Record-ID: <", 1)[1].split(b">", 1)[0].decode()


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(archives: DataFrame, folder: str) -> DataFrame:
    """One row a record, through the sidecar index. ValueError if a payload lacks its digest or length."""

    def work(batches):
        fs, _ = _fs(folder)
        page = lambda x: None if x is None else int(x)
        for batch in batches:
            for name, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(index, compression=None) as s:
                    entries = [(int(a), int(b)) for a, b, _ in (x.split("\t") for x in s.read().decode().splitlines())]
                rows = []
                with fs.open_input_file(name) as f:
                    for offset, length in entries:
                        fields, body = parse(zlib.decompress(f.read_at(length, offset), 31))
                        digest, kind = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), fields["WARC-Type"]
                        http, _, payload = body.partition(b"\r\n\r\n")
                        size = int(http.rsplit(b"Content-Length: ", 1)[1])
                        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{name} at {offset}: payload does not have its digest")
                        rows.append((page(fields.get("X-Page-ID")), size, digest, kind, page(fields.get("X-Refers-To-Page"))))
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return archives.select("file", "index").mapInArrow(work, READ)


def _rows(rows) -> pa.RecordBatch:
    a, b, c, d, e = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.string()), pa.array(e, pa.int64())], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _spread(files: DataFrame) -> DataFrame:
    n = files.count()
    return files.repartition(max(1, n))


def delete_files(files: DataFrame, folder: str) -> None:
    """Removes the files listed; the tasks do it, and one that runs again finds them gone."""

    def work(batches):
        fs, _ = _fs(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if fs.get_file_info(name).type != pafs.FileType.NotFound:
                    fs.delete_file(name)
            yield batch

    files.select("file").mapInArrow(work, "file string").write.format("noop").mode("overwrite").save()


def archive(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", url_col: str = "url") -> tuple[DataFrame, str]:
    """Writes and normalises; returns the (file, index, records) table and the folder."""
    folder = new_path(pages.sparkSession, "warc")
    whole = stored(write(decisions(pages, id_col, body_col, url_col), folder), "written")
    done = stored(normalise(_spread(whole), folder), "normalised")
    delete_files(whole, folder)
    return done, folder


def query(spark, sf_dir: str) -> DataFrame:
    done, folder = archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return read(_spread(done), folder)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM q
"""
