"""URL filter on a sorted digest array.

Rules become sorted 64-bit xxhash keys in one file, with their strings in a second. Each
executor gets both files and maps them into memory. A batch of urls is probed by one
vectorised binary search over all (host suffix, path prefix) keys; a hit counts only if the
stored string equals the probed one, so a hash collision can't change a verdict.

The list is a parameter of the operator, not of the data: it is built on the driver and
copied to every executor. A list of more than ``PER_INDEX`` rules makes several such indexes,
which are probed one after the other; the longest rule of all wins.

Defined cases: a NULL url and one without ``://`` have an empty host and path and get the
default verdict; repeated rows are judged alike; urls may have any length; an
empty table gives no row, an empty list of rules the default verdict. Other columns are not read.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

PER_INDEX = 20_000_000
#: Fixed values of the query's rules: (verdict, host, path prefix).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
DEFAULT = "allow"
_open: dict[str, tuple] = {}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path). Host: after the first ``://`` up to ``/ ? #``; NULL or no ``://``: two empty strings."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host.translate(_FOLD), tail[:end]


_FOLD = {c: c + 32 for c in range(65, 91)}


def latest(rules) -> list[tuple[str, str, str]]:
    """The rules with folded hosts; of equal (host, path) the last one counts."""
    return [(v, h, p) for (h, p), v in {(h.translate(_FOLD), p): v for v, h, p in rules}.items()]


def build_index(rules) -> tuple[np.ndarray, np.ndarray, bytes, list[int]]:
    """Sorted keys, string offsets in that order, the strings (host, tab, path, tab, verdict), and the path lengths in use."""
    rows = sorted((xxhash.xxh64_intdigest(f"{h}\t{p}"), f"{h}\t{p}\t{v}".encode()) for v, h, p in rules)
    keys = np.array([k for k, _ in rows], np.uint64)
    offsets = np.cumsum([0, *[len(s) for _, s in rows]]).astype(np.int64)
    return keys, offsets, b"".join(s for _, s in rows), sorted({len(p) for _, _, p in rules})


def publish(spark: SparkSession, rules) -> list[tuple[str, list[int]]]:
    """Writes the indexes and sends them to the executors; returns their names and path lengths."""
    rules = latest(rules)
    return [_publish(spark, rules[at : at + PER_INDEX]) for at in range(0, max(1, len(rules)), PER_INDEX)]


def _publish(spark: SparkSession, rules) -> tuple[str, list[int]]:
    keys, offsets, strings, lengths = build_index(rules)
    name = f"urls-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="tarnwork-urls-")  # the driver serves the files as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    for part, data in (("keys", keys.tobytes()), ("offsets", offsets.tobytes()), ("strings", strings)):
        path = os.path.join(folder, f"{name}.{part}")
        with open(path, "wb") as f:
            f.write(data or b"\0" * 8)
        spark.sparkContext.addFile(path)
    return name, lengths


def _index(name: str) -> tuple:
    if name not in _open:
        at = lambda part, kind: np.memmap(SparkFiles.get(f"{name}.{part}"), kind, "r")
        offsets = at("offsets", np.int64)
        keys = at("keys", np.uint64)[: len(offsets) - 1]
        _open[name] = (keys, offsets, at("strings", np.uint8))
    return _open[name]


def match(urls, indexes: list[tuple]) -> list[tuple[str, str, str | None, str | None]]:
    """(host, path, rule, verdict of the rule) of each url; the longest rule wins, the longer host among equals."""
    parts = [split_url(url) for url in urls]
    best: dict[int, tuple] = {}
    for index in indexes:
        for n, found in _probe(parts, *index).items():
            best[n] = max(best.get(n, found), found)
    return [(*hp, *(best[n][1:] if n in best else (None, None))) for n, hp in enumerate(parts)]


def _probe(parts: list[tuple[str, str]], keys: np.ndarray, offsets: np.ndarray, strings: np.ndarray, lengths: list[int]) -> dict[int, tuple]:
    """url -> (rank, rule, verdict) of the longest rule of one index."""
    probes, texts, owner, rank = [], [], [], []
    for n, (host, path) in enumerate(parts):
        at = 0
        while host:
            suffix = host[at:]
            for length in lengths:
                if length <= len(path):
                    text = f"{suffix}\t{path[:length]}"
                    texts.append(text)
                    probes.append(xxhash.xxh64_intdigest(text))
                    owner.append(n)
                    rank.append((len(suffix) + length, len(suffix)))
            at = host.find(".", at) + 1
            if not at:
                break
    best: dict[int, tuple] = {}
    if probes and len(keys):
        wanted = np.array(probes, np.uint64)
        places = np.searchsorted(keys, wanted)
        for i in np.flatnonzero(keys[np.minimum(places, len(keys) - 1)] == wanted):
            p = places[i]
            while p < len(keys) and keys[p] == wanted[i]:  # equal digests lie side by side
                found, _, verdict = bytes(strings[offsets[p] : offsets[p + 1]]).decode().rpartition("\t")
                if found == texts[i]:
                    best[owner[i]] = max(best.get(owner[i], ((0, 0), "", "")), (rank[i], found.replace("\t", ""), verdict))
                p += 1
    return best


def judge(pages: DataFrame, rules, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(id, host, path, rule, verdict) of every row; repeated rows are judged alike."""
    names = publish(pages.sparkSession, rules)

    def work(batches):
        for old in set(_open) - {name for name, _ in names}:
            del _open[old]
        indexes = [(*_index(name), lengths) for name, lengths in names]
        for batch in batches:
            found = match(batch.column(1).to_pylist(), indexes)
            cols = list(zip(*found)) or [()] * 4
            text = [pa.array(c, pa.string()) for c in (cols[0], cols[1], cols[2], [v or default for v in cols[3]])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *text], names=[id_col, "host", "path", "rule", "verdict"])

    kind = pages.select(id_col).schema[0].dataType.simpleString()
    return pages.select(id_col, url_col).mapInArrow(work, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def _sql() -> str:
    fits = "\n UNION ALL ".join(f"SELECT page_id, '{h}{p}' AS rule, '{v}' AS verdict, {len(h + p)} AS n, {len(h)} AS k FROM u WHERE (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')" for v, h, p in RULES)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM r),
 u AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(substr(rest, length(h) + 1), '^[^?#]*'), '') AS path FROM s),
 f AS ({fits}),
 b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, k DESC) = 1)
SELECT u.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM u LEFT JOIN b ON b.page_id = u.page_id
"""


SQL = _sql()
