"""Each operator against SQL or brute force, and its edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnwork.llm import decontaminate, graph, line_dedup, ngram_join, packing, quality, sharding, suffix_dedup, topk, url_filter, warc
from tarnwork.llm.registry import ORACLE, QUERIES
from tests.conftest import SF
from tests.oracle import compare

DOC = "doc_id long, text string, n int, shard string, slot string, h long, at string"


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs, empty and long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"w{i * 7919 % 3001}" for i in range(6000))
    lines = "\n".join(f"line {i}" for i in range(9))
    texts = [None, "", "a", "a a", long, long, long + " end", lines, lines + "\nmore", "x" * 400, "ab" * 300, "É" * 120, "same", "same", "\n\n\n\n\n"]
    rows = [(i, t, i, "s", "t", i, "u") for i, t in enumerate(texts)] + [(4, long, 4, "s", "t", 4, "u"), (None, "no id at all", 99, "s", "t", 0, "u")]
    return spark.createDataFrame(rows, DOC)


@pytest.mark.parametrize("name", list(ORACLE))
def test_matches_sql(spark, name):
    compare(QUERIES[name](spark, SF), ORACLE[name], SF)


def _sets(rows, n):
    fold = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    out = {}
    for i, t in rows:
        w = (t or "").encode().translate(fold).split()
        out[i] = frozenset() if not w else frozenset([tuple(w)]) if len(w) < n else frozenset(zip(*[w[k:] for k in range(n)]))
    return out


def _classes(rows, n, percent):
    sets, inverse = _sets(rows, n), defaultdict(list)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        met = Counter(j for s in sets[i] for j in inverse[s])
        for j, k in met.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            inverse[s].append(i)
    return {(i, len(sets[i]), root(i)) for i in sets}


def test_ngram_join(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = _classes([(r.doc_id, r.text) for r in docs.collect()], 3, 90)
    assert {tuple(r) for r in ngram_join.join_classes(docs, 3, 90).collect()} == want


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_ngram_join_large_family(spark, n, percent):
    """Several hundred near copies at all distances: many blocks of one family, chains of links, texts just below the limit."""
    rng = np.random.default_rng(7)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(420):
        w = list(base if i % 3 else rows[-1][1].split() if rows else base)
        for k in rng.choice(len(w), rng.integers(0, 6), replace=False):
            w[k] = f"x{rng.integers(0, 40)}"
        rows.append((int(rng.integers(0, 10**6)) * 1000 + i, " ".join(w)))
    rows += [(i, f"lone text {i} " + " ".join(f"u{i}_{k}" for k in range(9))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {tuple(r) for r in ngram_join.join_classes(docs, n, percent).collect()} == _classes(rows, n, percent)


def test_ngram_join_passages_make_no_family(spark):
    """A passage in many texts that are otherwise their own ties none of them; copies that share it are found."""
    own = lambda i: [i * 1000 + k for k in range(140)]
    passage = [-k for k in range(1, 16)]
    rows = [(i, 1000, own(i) + passage) for i in range(60)] + [(100 + i, 1000, own(i)[:130] + own(200 + i)[:10] + passage) for i in range(3)]
    reps = spark.createDataFrame(rows, "node long, n long, lists array<long>")
    assert sorted((r.f, r.node) for r in ngram_join.families(reps, 90).collect()) == [(i, j) for i in range(3) for j in (i, 100 + i)]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_short_and_long_lists(spark, monkeypatch, n, percent):
    """Pairs whose shingles lie in short and in long lists, large families of several components that never link."""
    monkeypatch.setattr(ngram_join, "SHORT", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    rng = np.random.default_rng(11)
    passages = [[f"p{j}_{k}" for k in range(25)] for j in range(4)]
    rows = []
    for g in range(25):
        base = [f"g{g}_{k}" for k in range(int(rng.integers(10, 90)))]
        for j in rng.choice(4, rng.integers(0, 3), replace=False):
            base = base + passages[j]
        for _ in range(int(rng.choice([1, 2, 3, 40]))):
            w = list(base)
            for k in rng.choice(len(w), int(rng.integers(0, 1 + len(w) // 15)), replace=False):
                w[k] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {tuple(r) for r in ngram_join.join_classes(docs, n, percent).collect()} == _classes(rows, n, percent)


def test_ngram_join_ids_and_hashes(spark):
    """One id with two texts, in either order; long words that a polynomial hash takes for equal."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    x, y = " ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(30))
    rows = [(1, x), (1, y), (2, x), (3, y), (10, f"{a} same end"), (11, f"{b} same end")]
    for order in (rows, rows[::-1]):
        got = sorted((r.doc_id, r.component_id) for r in ngram_join.join_classes(spark.createDataFrame(order, "doc_id long, text string"), 3, 90).collect())
        assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (10, 10), (11, 11)]
    for order in ([(5, x), (5, y), (2, x), (7, y)], [(5, y), (7, y), (2, x), (5, x)]):  # the two texts stay apart
        got = sorted((r.doc_id, r.component_id) for r in ngram_join.join_classes(spark.createDataFrame(order, "doc_id long, text string"), 3, 90).collect())
        assert got == [(2, 2), (5, 2), (5, 5), (7, 5)]
    kept = ngram_join.one_of_each(spark.createDataFrame([(1, x), (1, x), (2, x), (None, x), (4, ""), (4, ""), (5, y)], "doc_id long, text string"), 3, 90)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 4, 5]


def test_divide_skip_against_counting():
    """T-occurrence with long lists probed, against plain counting."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        m = int(rng.integers(2, 60))
        lists = [np.flatnonzero(rng.random(m) < rng.choice([0.05, 0.5, 0.95])) for _ in range(int(rng.integers(4, 40)))]
        need = int(rng.integers(1, len(lists)))
        least = np.full(m, need) + rng.integers(0, 2, m)
        open_ = rng.random(m) < 0.8
        lists = sorted(lists, key=len)[::-1] if sum(len(x) > 0 for x in lists) >= need else [np.arange(m)] * len(lists)
        counts = np.bincount(np.concatenate(lists), minlength=m)
        ids, hits = ngram_join.occurrences(lists, need, np.ones(m), open_, least)
        want = np.flatnonzero((counts >= least) & open_)
        assert ids.tolist() == want.tolist() and hits.tolist() == counts[want].tolist()


def test_ngram_join_odd(spark, odd):
    got = {tuple(r) for r in ngram_join.join_classes(odd, 3, 90).collect()}
    want = _classes([(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None], 3, 90)
    assert {g for g in got if g[0] is not None} == want
    assert ngram_join.join_classes(odd.limit(0)).count() == 0


def _repeats(rows, length=100):
    seen, out = set(), set()
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.add((i, len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark, odd):
    for docs in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), odd.filter("doc_id IS NOT NULL")):
        want = _repeats({(r.doc_id, r.text) for r in docs.collect()})
        assert {tuple(r) for r in suffix_dedup.dedup(docs).collect()} == want
    assert suffix_dedup.dedup(odd).count() == odd.count()
    assert suffix_dedup.dedup(odd.limit(0)).count() == 0


def test_suffix_dedup_ids_and_long_texts(spark):
    """Several texts under one id, and a text of several segments with a repeat across their border."""
    passage = " ".join(f"p{i * 7919 % 997}" for i in range(60))
    other = " ".join(f"q{i * 7919 % 997}" for i in range(60))
    rows = [(1, passage, 0), (1, passage, 1), (2, other, 2), (2, passage, 3), (None, passage, 4), (3, f"{other} {passage}", 5)]
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame([(i, t, n, "x") for i, t, n in order], "doc_id long, text string, n_removed int, sha string")
        got = {(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.dedup(table).collect()}
        first, second = sorted([passage, other], key=lambda t: hashlib.sha256(t.encode()).hexdigest())
        kept = {(1, passage), (2, first), (3, f"{other} {passage}")}
        want = {(i, b, r, k) for i, b, r, _, k in _repeats(kept)} | {(2, len(second), 0, hashlib.sha256(second.encode()).hexdigest()), (None, len(passage), 0, hashlib.sha256(passage.encode()).hexdigest())}
        assert got == want
    alone = lambda n, salt: "".join(hashlib.sha256(f"{salt}/{i}".encode()).hexdigest() for i in range(n // 64))
    at = suffix_dedup.SEGMENT - 250
    big = alone(3 * suffix_dedup.SEGMENT, "big")
    long = big[:at] + passage + big[at:] + passage
    got = {r.doc_id: r for r in suffix_dedup.dedup(spark.createDataFrame([(5, passage), (9, long)], "doc_id long, text string")).collect()}
    assert got[5].n_removed == 0 and got[9].n_removed == 2 * len(passage) and got[9].n_spans == 2
    assert got[9].kept_sha256 == hashlib.sha256(big.encode()).hexdigest()


def test_suffix_dedup_last_row_of_a_batch():
    """A repeat that ends a batch, or the whole stream, is reported."""
    table = pa.table({"w1": [1, 1, 1, 2], "w2": [5, 5, 5, 5], "doc_id": [1, 2, 3, 4], "at": [0, 0, 0, 0]})
    for cuts in ((4,), (3,), (2, 3), (1, 2, 3, 4)):
        edges = [0, *cuts, 4]
        batches = [b for lo, hi in zip(edges, edges[1:]) for b in table.slice(lo, hi - lo).to_batches()]
        for part in (batches, batches[: len(cuts)]):
            rows = sum(b.num_rows for b in part)
            got = [i for t in suffix_dedup._neighbours(part, 2, False) for i in t["doc_id"].to_pylist()]
            assert got == [i for i in (2, 3) if i <= rows]


def test_suffix_dedup_hot_passage(spark, tmp_path):
    """A passage that most documents share in different surroundings, over several tasks."""
    passage = " ".join(f"p{i * 7919 % 997}" for i in range(60))
    own = lambda i: " ".join(f"{hashlib.md5(f'{i}-{k}'.encode()).hexdigest()[: 3 + i % 5]}" for k in range(25))
    rows = [(i, f"{own(i)} {passage[i % 40 :]} {own(-i - 1)}" + (f" {passage}" if i % 7 == 0 else "")) for i in range(160)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert {tuple(r) for r in suffix_dedup.dedup(docs).collect()} == _repeats(rows)


def test_packing(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    special = spark.createDataFrame([(100, "It's <|endoftext|> 10²x ½ İstanbul ﬁ don't'S!?"), (101, "tab\tnew\r\nline\x0b\x1c\x85 x")], "doc_id long, text string")
    docs = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumns({"length": F.lit(1), "number": F.lit("n"), "offset": F.lit(0)}).unionByName(special, allowMissingColumns=True)
    rows = packing.run(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d in docs.collect():
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[d.doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.run(odd.limit(0)).count() == 0
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.start, r.length, r.ids_crc32)
    twice = packing.run(odd.unionByName(odd)).collect()  # repeated rows and NULL ids: every piece twice, each at a place of its own
    assert Counter(map(key, twice)) == Counter({k: 2 * n for k, n in Counter(map(key, packing.run(odd).collect())).items()})
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)


def test_packing_other_tokenizers(spark):
    """A file that cuts words otherwise gives its own ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["It's  two   blanks", "Upper lower 123", "", "a\nb"]
    assert packing.encode(texts, path) == [np.asarray(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_packing_hot_length(spark, monkeypatch):
    """A length with many pieces is ranked in many buckets; the plan is used up exactly."""
    monkeypatch.setattr(packing, "PER_BUCKET", 7)
    rows = [(i, 0, 30 if i % 3 else 64, i, 64, i) for i in range(500)]
    cut = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, number long")
    by = defaultdict(list)
    for r in packing.pack(cut, window=64).collect():
        by[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, by.values())) == 500 and sorted(by) == list(range(len(by)))
    for s in by.values():
        assert [o for o, _ in sorted(s)] == np.cumsum([0, *[n for _, n in sorted(s)]])[:-1].tolist() and sum(n for _, n in s) <= 64


def test_packing_is_tight():
    histogram = dict(Counter(np.random.default_rng(1).integers(1, 1025, 50_000).tolist()))
    plan = packing.plan(histogram)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 2048
        for n in lengths:
            used[n] += times
    assert dict(used) == histogram
    assert sum(n * k for n, k in histogram.items()) / (2048 * sum(t for _, t in plan)) > 0.99


def test_sharding(spark, odd):
    rows = sharding.assign(odd.select("doc_id", "shard", "slot", "n"), n_shards=4, order=("n",)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == odd.count() and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.assign(odd.select("doc_id").limit(0)).count() == 0
    walks, many = sharding.ring_walks(16, 128, 14), {c: 7 for c in range(1 << 14)}
    home = sum(e - s for c, s, e, shard, _ in sharding.plan(many, walks, sharding.capacities(7 << 14, 16, 0.0)) if shard == walks[c][0])
    assert home / (7 << 14) > 0.9  # few keys leave their home


def test_sharding_against_a_walk(spark):
    """The same ring walked key by key in plain Python; a key that a third of the rows share, and repeated rows."""
    rows = [(None if i % 3 == 0 else i // 2, i % 200 if i % 2 else 7, "s") for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, n int, shard string").repartition(6)
    got = sharding.assign(table, order=("n",), n_shards=5, vnodes=8, ring_bits=6).collect()
    cells = {r.doc_id: r.c for r in table.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("c")).distinct().collect()}
    points = sorted((int.from_bytes(d[:8], "big") % 64, d, s) for s in range(5) for v in range(8) for d in [hashlib.md5(f"{s}/{v}".encode()).digest()])
    waiting = Counter(cells[i] for i, _, _ in rows)
    home = {c: list(dict.fromkeys(s for _, _, s in [p for p in points if p[0] >= c] + points)) for c in waiting}
    free, want = [180] * 5, Counter()
    for step in range(5):
        for c in sorted(waiting):
            s = home[c][step]
            moved = min(waiting[c], free[s])
            waiting[c] -= moved
            free[s] -= moved
            want[c, s] += moved
    assert Counter((cells[r.doc_id], r.shard) for r in got) == +want
    assert Counter((r.doc_id, r.n) for r in got) == Counter((i, n) for i, n, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(180)) for v in by.values()) and len(by) == 5


def test_url_filter_rules_are_those_of_the_contract(spark):
    table = spark.createDataFrame([(1, "http://b.net/de/7"), (2, "http://example.net/de/8"), (3, "http://a.example.net/de/81?q"), (4, "http://com/en/"), (5, "http://example.com/en/7"), (6, "http://x.org/es/"), (7, "http://x.org/en/")], "page_id long, url string")
    rows = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(table, url_filter.RULES).collect()}
    assert rows == {1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("example.net/de/8", "block"), 4: ("com/en/", "block"), 5: ("example.com/en/7", "allow"), 6: ("org/es/", "block"), 7: (None, "allow")}


def test_url_filter_collisions_and_edges(spark):
    keys, offsets, strings, lengths = url_filter.build_index(url_filter.RULES)
    index = (keys, offsets, np.frombuffer(strings, np.uint8), lengths)
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7x?q", "x://com/en/", "x://notcom/en/", "x://example.com:80/en/", "http://example.net/de/8#f", "http://b.net/de/8"]
    found = url_filter.match(urls, [index])
    assert found[:3] == [("", "", None, None)] * 3
    assert found[3] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and found[4][2:] == ("com/en/", "block")
    assert found[5][2] is None and found[6][2] is None and found[7][3] == "block" and found[8][2:] == ("net/de/", "allow")
    forged = (np.full_like(keys, keys[0]), *index[1:])  # every digest collides: only strings decide
    assert url_filter.match(["x://zzz.dev/fr/"], [forged]) == [("zzz.dev", "/fr/", None, None)]
    table = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate([*urls, *urls, "http://" + "a." * 20_000 + "com/en/" + "p" * 500_000])], "page_id long, url string, host string, rule string")
    rows = {r.page_id: tuple(r)[1:] for r in url_filter.judge(table, url_filter.RULES).collect()}
    assert [rows[i] for i in range(9)] == [rows[i] for i in range(9, 18)] == [(h, p, r, v or "allow") for h, p, r, v in found]
    assert rows[18][2:] == ("com/en/", "block") and url_filter.judge(table.limit(0), url_filter.RULES).count() == 0


def test_url_filter_several_indexes(spark, monkeypatch):
    """Rules beyond one index lie in further ones; the last of equal rules counts, the longest wins."""
    monkeypatch.setattr(url_filter, "PER_INDEX", 2)
    rules = [("block", "com", "/"), ("allow", "a.com", "/x"), ("block", "b.a.com", "/x/y"), ("allow", "COM", "/"), ("block", "org", "/q")]
    table = spark.createDataFrame(list(enumerate(["s://a.com/x", "s://b.a.com/x/yz", "s://c.com/", "s://z.org/qq", "s://z.org/"])), "page_id long, url string")
    rows = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(table, rules, default="block").collect()}
    assert rows == {0: ("a.com/x", "allow"), 1: ("b.a.com/x/y", "block"), 2: ("com/", "allow"), 3: ("org/q", "block"), 4: (None, "block")}


def _best(rows, k=10):
    """Brute force in Python's integers; rows of (id, vector)."""
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    whole = lambda v: [int(np.floor(x * 1024) if abs(x) < 1e300 else np.copysign(np.finfo(float).max, x) if abs(x) > 1e305 else np.floor(x * 1024)) for x in v]
    out = set()
    for q in {i for i, _ in fine if i % 100 == 0}:
        mine = whole(min(v for i, v in fine if i == q))
        scores = [(-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(mine, whole(v))))), i) for i, v in fine if i != q]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_topk_prunes_through_the_query(spark, monkeypatch):
    """Clustered vectors: whole groups and most blocks are never scored, and the rows are exact."""
    monkeypatch.setattr(topk, "GROUP", 150)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 4, (24, 8))
    x = (centres[rng.integers(0, 24, 3000)] + rng.normal(0, 0.05, (3000, 8))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    counts = [spark.sparkContext.accumulator(0) for _ in range(2)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, counts=counts)
    assert {tuple(r) for r in got.collect()} == _best(rows)
    assert 0 < counts[0].value < 0.5 * 30 * counts[1].value


def test_topk_odd(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0])]
    rows += [(400, [1e30, -2.0]), (500, [1e308, 1.0]), (5, [-1e30, 3.0]), (6, [1e300]), (7, []), (600, [3.0, 1.0]), (600, [-3.0, 1.0]), (None, [1.0, 1.0]), (8, [0.25, 0.5, 0.125]), (700, [float("inf")])]
    table = spark.createDataFrame([(i, v, 1, 2, "g") for i, v in rows], "vec_id long, embedding array<double>, id int, q int, g string").repartition(3)
    for k in (3, 10):
        assert {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 100 == 0, k=k).collect()} == _best(rows, k)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_decontamination(spark):
    item = [f"t{i}" for i in range(40)]
    swapped = [*item[:9], "zz", *item[10:25], "yy", *item[26:]]
    texts = [" ".join(["pre"] * 30 + item), " ".join(swapped).upper(), " ".join(item[:8]), None, "", " ".join(reversed(item)), ", ".join(item[5:25])]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.matched) for r in decontaminate.find(docs, bench).collect()}
    assert got == {(0, 7, 40), (1, 7, 38), (6, 7, 20)}
    assert {r.doc_id for r in decontaminate.remove(docs, bench).collect()} == {2, 3, 4, 5}
    assert decontaminate.find(docs.limit(0), bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).count() == 0


def test_decontamination_edge_substitutions(spark):
    """A substitution near an end of a short item doesn't hide the rest of it."""
    cases = [(15, (2,), (14, 1, 15)), (15, (12,), (14, 1, 15)), (20, (3, 16), (18, 1, 20)), (24, (3, 11, 20), (15, 5, 20)), (13, (), (13, 1, 13))]
    items = [[f"i{n}x{k}" for k in range(size)] for n, (size, _, _) in enumerate(cases)]
    texts = [" ".join(["before", *("zz" if k in gone else w for k, w in enumerate(item)), "after"]) for item, (_, gone, _) in zip(items, cases)]
    bench = spark.createDataFrame([*enumerate(map(" ".join, items))], "item_id long, text string")
    got = {tuple(r) for r in decontaminate.find(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), bench).collect()}
    assert got == {(n, n, *found) for n, (_, _, found) in enumerate(cases)}


def test_best_overlap_accepts_any_run():
    """Against all runs of a diagonal: 13 equal tokens, or the whole item, with four matches to each substitution."""
    rng = np.random.default_rng(5)
    for _ in range(1500):
        n, before, cut = rng.integers(12, 36), rng.integers(0, 4), rng.integers(0, 3)
        item = np.arange(n).astype(np.uint64)
        laid = np.where(rng.random(n) < rng.choice([0.05, 0.1, 0.2, 0.3]), 999, item).astype(np.uint64)
        doc = np.concatenate([np.full(before, 998, np.uint64), laid[cut:]])
        equal = laid[cut:] == item[cut:]
        runs = [equal[a:b] for a in range(len(equal)) for b in range(a + 1, len(equal) + 1)]
        most = max((int(r.sum()) for r in runs if r.sum() >= decontaminate.PENALTY * (~r).sum()), default=0)
        matched, first, last = decontaminate.best_overlap(doc, item, int(before) - int(cut))
        need = min(decontaminate.MIN_MATCH, n)
        assert (matched >= need) == (most >= need) and matched <= most
        inside = equal[first - before : last - before]
        assert matched == inside.sum() and matched >= decontaminate.PENALTY * (~inside).sum()


def _overlaps(docs, items):
    """All (document, item) pairs that a seed of some mask hits and whose overlap meets the rule, by trying every place."""
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())  # noqa: E731  (bytes.lower folds A-Z alone)
    out = set()
    for i, t in docs:
        d = words(t)
        for k, x in items:
            it = words(x)
            if len(it) < decontaminate.SHORTEST:
                continue
            places = []
            for shift in range(-len(it) + 1, len(d)):
                eq = [0 <= p + shift < len(d) and d[p + shift] == it[p] for p in range(len(it))]
                if len(it) < decontaminate.SPAN:
                    ok = all(eq)
                else:
                    runs = range(max(0, -shift), min(len(it), len(d) - shift) - decontaminate.SPAN + 1)
                    ok = any(all(eq[p + o] for o, bit in enumerate(m) if bit == "1") for m in decontaminate.MASKS for p in runs)
                if ok:
                    whole = [eq[p] for p in range(max(0, -shift), min(len(it), len(d) - shift))]
                    most = max((sum(whole[a:b]) for a in range(len(whole)) for b in range(a + 1, len(whole) + 1) if sum(whole[a:b]) >= decontaminate.PENALTY * (b - a - sum(whole[a:b]))), default=0)
                    places.append(most)
            if places and max(places) >= min(decontaminate.MIN_MATCH, len(it)):
                out.add((i, k))
    return out


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(11)
    bench = [(k, " ".join(f"v{rng.integers(0, 60)}" for _ in range(int(n)))) for k, n in enumerate([4, 5, 8, 11, 12, 13, 15, 20, 28, 11])]
    docs = []
    for i in range(60):
        w = [f"v{rng.integers(0, 60)}" for _ in range(int(rng.integers(0, 40)))]
        copy = bench[i % len(bench)][1].split()
        copy = [f"z{i}" if rng.random() < (0, 0.05, 0.15)[i % 3] else x for x in copy]
        at = int(rng.integers(0, len(w) + 1))
        docs.append((i, " ".join(w[:at] + (copy[: -2] if i % 7 == 0 else copy) + w[at:])))
    docs += [(100, None), (101, ""), (102, "A " * 30_000 + bench[7][1].upper().replace(" ", " -- "))]
    table = spark.createDataFrame([(i, t, 1, 2, "c") for i, t in docs], "doc_id long, text string, item int, s int, tokens string").repartition(5)
    got = decontaminate.find(table, spark.createDataFrame([*bench, bench[3], (50, None)], "item_id long, text string")).collect()
    assert len(got) == len({(r.doc_id, r.item_id) for r in got}) and {(r.doc_id, r.item_id) for r in got} == _overlaps(docs, bench) != set()


def test_line_dedup(spark, odd):
    rows = {r.n: r for r in line_dedup.dedup(odd).collect()}
    assert rows[8].text == "more" and rows[8].n_removed == 9 and rows[7].n_removed == 0
    assert rows[0].text is None and rows[1].text == "" and rows[14].n_removed == 0 and rows[14].n_lines == 6
    assert line_dedup.dedup(odd.limit(0)).count() == 0
    inside = spark.createDataFrame([(1, "a\nb\nc\nd\na\nb\nc\nd")], "doc_id long, text string")
    long = "\n".join(f"line {i % 9000}" for i in range(20_000))
    assert line_dedup.dedup(spark.createDataFrame([(1, long)], "doc_id long, text string")).first().text == "\n".join(f"line {i}" for i in range(9000))
    assert line_dedup.dedup(inside).first().text == "a\nb\nc\nd"


def test_quality(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.sample(docs, labels, columns=["doc_id"]).collect()}
    rows = labels.collect()
    share = lambda f: np.mean([r.doc_id in kept for r in rows if f(r)])
    assert share(lambda r: r.quality and not r.toxic) > 0.95 and share(lambda r: not r.quality) < 0.05 and share(lambda r: r.toxic) < 0.5
    none = labels.limit(0)
    assert quality.sample(odd, none).count() == odd.count() and quality.sample(odd.limit(0), none).count() == 0


@pytest.mark.parametrize(
    ("sf", "good", "bad", "most"),
    [("sf0.01", 0.97, 0.05, {"en": 0.05}), ("sf0.1", 0.97, 0.01, {"en": 0.01, "de": 0.1, "fr": 0.1, "es": 0.35})],
)
def test_quality_toxic_by_language(spark, sf, good, bad, most):
    """Toxic documents go in every language with enough of them in the labelled sample, at either size."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.sample(docs, labels, columns=["doc_id"]).collect()}
    rows = labels.join(docs.select("doc_id", "lang"), "doc_id").collect()
    share = lambda f: np.mean([r.doc_id in kept for r in rows if f(r)])
    assert share(lambda r: r.quality and not r.toxic) > good and share(lambda r: not r.quality) < bad
    for lang, limit in most.items():
        assert share(lambda r: r.toxic and r.lang == lang) < limit, lang


def test_quality_log_ratio():
    """Two features of 4 % of the documents, in no good one: chance with 20 good labels, not with 300; with the bad labels' evidence 100 are enough."""
    docs = lambda n, k: np.array([k, n / 2, n], float)
    for n, rejected in ((20, False), (300, True)):
        ratio = quality.log_ratio(docs(4 * n, 0.16 * n), docs(n, 0), docs(0, 0), 1.0)
        assert (ratio[0] < 0) == rejected and ratio[1] == 0
    assert quality.log_ratio(docs(400, 16), docs(100, 0), docs(0, 0), 1.0)[0] == 0
    assert quality.log_ratio(docs(400, 16), docs(100, 0), docs(40, 9), 100 / 140)[0] < 0


def test_quality_against_plain_counts(spark):
    """Models, weights and the draw of a small table, counted document by document; rows with clashing columns, ties, NULLs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000").limit(300).select("doc_id", "text")
    rows = [(r.doc_id, r.text, 1.0, "k") for r in docs.collect()]
    rows += [rows[0], rows[0], (-1, None, 1.0, "k"), (-2, "", 1.0, "k"), (None, "free text", 1.0, "k"), (-3, "buy now " * 20, 1.0, "k")]
    rows += [(-10 - i, f"{t} spamword", 1.0, "k") for i, (_, t, _, _) in enumerate(rows[:60])]
    good, bad = {r[0] for r in rows[:200]}, {-10 - i for i in range(50)}
    labels = [(i, 1, 0) for i in sorted(good)] + [(i, 0, 0) for i in sorted(bad)]
    table = spark.createDataFrame(rows, "doc_id long, text string, log_weight double, sample_key string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    counts = np.zeros((3, quality.SIZE + 1))
    buckets = {}
    for n, (i, t, _, _) in enumerate(rows):
        data = np.frombuffer((t or "").encode(), np.uint8)
        buckets[n] = quality.features(data, np.array([0, len(data)]))[:-1]
        own = [*set(np.concatenate(buckets[n]).tolist()), quality.SIZE]
        for m in [0] + [1] * (i in good) + [2] * (i in bad):
            counts[m][own] += 1
    ratio = quality.log_ratio(*counts, len(good) / (len(good) + len(bad)))
    most = np.log((len(rows)) / counts[1][-1])
    tokens = {n: quality.log_weights(ratio, *b) for n, b in buckets.items()}
    weight = {n: round(float(min(up.sum(), most) + down.sum()), 9) for n, (up, down) in tokens.items()}

    fitted = quality.fit(table, marks)
    assert np.allclose(fitted, np.append(ratio, most), atol=1e-12) and (ratio < 0).any()
    got = quality.weigh(table, fitted).collect()
    assert sorted((str(r.doc_id), r.text or "", round(r.log_weight, 6)) for r in got) == sorted((str(rows[n][0]), rows[n][1] or "", round(w, 6)) for n, w in weight.items())
    for k in (None, 40):
        want = round(sum(min(1.0, np.exp(w)) for w in weight.values())) if k is None else k
        least = sorted((r.sample_key for r in got), reverse=True)[want - 1]
        drawn = quality.sample(table, marks, k=k)
        assert drawn.columns == ["doc_id", "text", "log_weight", "sample_key"]
        assert sorted(r.sample_key for r in drawn.collect()) == sorted(r.sample_key for r in got if r.sample_key >= least)


def test_quality_speaks_for_a_rare_target():
    """A feature that most of a rare target has, and little else, raises a weight."""
    raw, good = np.array([300.0, 5000, 10_000]), np.array([90.0, 50, 100])
    up, same = quality.log_ratio(raw, good, np.zeros(3), 1.0)
    assert up > quality.DEAD and same == 0


def _plain_quality(rows, good, bad):
    """Log weights by dictionaries of the features themselves, without any hash: rows of (id, text)."""

    def tokens(text):
        return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", (text or "").encode())

    def look(text):
        raw, out, before = tokens(text), [], None
        low = [t.lower() for t in raw]  # of bytes: A-Z only
        for i, (t, w) in enumerate(zip(raw, low)):
            lag = next((k for k in range(1, 5) if i >= k and low[i - k] == w), 0)
            upper = sum(65 <= c <= 90 for c in t)
            case = "lower" if not upper else "upper" if upper == len(t) > 1 else "mixed"
            form = (case, t[:1].isalnum() or t[0] >= 128, len(t) if len(t) < 7 else 7 + (len(t) > 15) + (len(t) > 40), lag)
            out.append((("word", "again" if lag == 1 else w), ("forms", before, form), ("two", low[i - 1] if i else None, w)))
            before = form
        return out

    found = [look(t) for _, t in rows]
    raw, of_good, of_bad = Counter(), Counter(), Counter()
    n_good = n_bad = 0
    for (i, _), fs in zip(rows, found):
        own = {x for three in fs for x in three}
        raw.update(own)
        if i in good:
            of_good.update(own)
            n_good += 1
        if i in bad:
            of_bad.update(own)
            n_bad += 1
    n, share, most = len(rows), len(good) / (len(good) + len(bad)), math.log(len(rows) / n_good)

    def surprise(c, m, p):
        out = sum(k * math.log(k / m / q) for k, q in ((c, p), (m - c, 1 - p)) if k)
        return -out if c / m < p else out

    def ratio(x):
        c, expected = of_good[x], raw[x] * n_good / n
        sure = surprise(c, raw[x], n_good / n)
        up, least = math.log((c + 1) / (expected + 1)), sure
        if n_bad:
            expected = max(expected, share * c + (1 - share) * of_bad[x] * n_good / n_bad)
            least = min(sure, surprise(c, c + of_bad[x], n_good / (n_good + n_bad)) if c + of_bad[x] else 0)
        down = math.log((c + 1) / (expected + 1))
        return down if down < -1.6 and least < -8 else up if up > min(1.6, most / 2) and sure > 8 else 0.0

    known = {x: ratio(x) for x in raw}
    weights = [[known[x] for three in fs for x in three] for fs in found]
    return [min(sum(x for x in w if x > 0), most) + sum(x for x in w if x < 0) for w in weights], known


@pytest.mark.parametrize("n_bad", [0, 60])
def test_quality_against_brute_force(spark, n_bad):
    """Features, models, weights on both sides of 1, and the draw, by a plain version that shares nothing with the operator."""
    rng = np.random.default_rng(13)  # texts of which no two features meet in a bucket
    topic = lambda words, k: " ".join(words[int(i)] for i in rng.integers(0, len(words), k))
    plain, target, spam = ["the", "cat", "Sat", "on", "it", "10", "..."], ["Prime", "lemma", "proof"], ["BUY", "now", "!!!", "cheap"]
    rows = [(i, topic(plain, 12)) for i in range(400)] + [(400 + i, topic(plain, 6) + " " + topic(target, 5)) for i in range(90)] + [(500 + i, topic(plain, 5) + " " + topic(spam, 6)) for i in range(90)]
    rows += [(700, None), (701, ""), (702, "\n \t"), (None, "the cat"), (703, "é É the the the"), (0, rows[0][1]), (704, "Prime proof now BUY lemma")]
    good, bad = {*range(400, 470), *range(0, 30)}, set(range(500, 500 + n_bad))
    labels = [(i, 1, 0) for i in good] + [(i, int(i % 2), int(i % 2)) for i in bad]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weights, known = _plain_quality(rows, good, bad)
    assert any(x > 0 for x in known.values()) and (any(x < 0 for x in known.values()) or not n_bad) and max(weights) > 1 and (min(weights) < -1.6 or not n_bad)
    got = quality.weigh(table, quality.fit(table, marks)).collect()
    order = lambda r: (str(r[0]), r[1] or "", r[2])
    assert sorted(((r.doc_id, r.text, round(r.log_weight, 6)) for r in got), key=order) == sorted(((i, t, round(w, 6)) for (i, t), w in zip(rows, weights)), key=order)
    noise = np.sort([r.sample_key - r.log_weight for r in got])
    steps = np.arange(1, len(noise) + 1) / len(noise)
    assert np.abs(np.exp(-np.exp(-noise)) - steps).max() < 0.08  # as Gumbel's distribution has it
    assert len({round(x, 9) for x in noise}) == len({(i, t) for i, t in rows})
    for k in (None, 25):
        n = round(sum(math.exp(min(w, 0.0)) for w in weights)) if k is None else k
        want = sorted((r.sample_key for r in got), reverse=True)[:n]
        kept = quality.sample(table, marks, k=k).collect()
        assert sorted((r.sample_key for r in kept), reverse=True)[:n] == want and len(kept) <= n + 1
    drawn = quality.sample(table, marks, k=25).collect()
    if n_bad:
        assert np.mean([400 <= (r.doc_id or 0) < 490 for r in drawn]) > 2 * 90 / len(rows)  # towards the target


def test_quality_held_out(spark):
    """Fitted on one half of the labels, judged on the other; something is rejected at the small size too."""
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2))
    for sf, most in (("sf0.01", 0.1), ("sf0.1", 0.02)):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        kept = {r.doc_id for r in quality.sample(docs, labels.filter(half == 0), columns=["doc_id"]).collect()}
        rows = labels.filter(half == 1).join(docs.select("doc_id", "lang"), "doc_id").collect()
        share = lambda f: np.mean([r.doc_id in kept for r in rows if f(r)])
        assert share(lambda r: r.quality and not r.toxic) > 0.95 and share(lambda r: not r.quality) < most
        assert share(lambda r: r.toxic and r.lang == "en") < 0.1


def test_kth_largest(spark):
    values = [1.0, 5.0, 5.0, 2.0, -7.5, 3.25] * 3
    keys = spark.createDataFrame([(v,) for v in values], "sample_key double")
    for k in (1, 6, 7, 18):
        assert quality.kth_largest(keys, k, bins=4) == sorted(values)[-k]


def test_warc(spark):
    body = "é" * 600
    rows = [(1, "u", body), (5, None, body), (5, "again", body), (1, "u", body), (3, "u\r\nX: y", body), (4, "u", None), (6, "u", "\r\n\r\nWARC/1.0"), (None, "u", body), (7, "http://x/" + "y" * 9000, "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 0, "f") for r in rows], "page_id long, url string, html string, number int, digest string").repartition(3)
    done, folder = warc.archive(pages)
    found = warc.read(done, folder).collect()
    by = {r.page_id: r for r in found}
    assert by[5].record_type == "response" and by[1].refers_to == by[3].refers_to == by[None].refers_to == 5 and by[1].payload_bytes == 1200
    assert Counter(r.page_id for r in found) == Counter(r[0] for r in rows) and sum(r.record_type == "response" for r in found) == 5
    assert by[4].payload_bytes == 0 and by[6].record_type == "response" and by[7].payload_bytes == 3_000_000
    assert by[6].payload_digest == hashlib.sha1(b"\r\n\r\nWARC/1.0").hexdigest()
    ids, referred = [], set()
    for r in done.collect():  # each member on its own, by the sidecar, as any reader of the format would
        data, index = open(r["file"], "rb").read(), open(r["index"]).read().splitlines()
        for offset, length, name in (x.split("\t") for x in index):
            fields, block = warc.parse(zlib.decompress(data[int(offset) : int(offset) + int(length)], 31))
            assert fields["WARC-Record-ID"] == f"<{name}>" and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
            assert fields["Content-Type"] == "application/http; msgtype=response" and block.startswith(b"HTTP/1.1 200 OK\r\n") and "\n" not in fields["WARC-Target-URI"]
            assert (fields["WARC-Type"] == "revisit") == ("WARC-Profile" in fields) == ("WARC-Refers-To" in fields)
            ids.append(fields["WARC-Record-ID"])
            referred |= {fields.get("WARC-Refers-To")} - {None}
    assert len(set(ids)) == len(ids) == len(rows) and referred and referred <= set(ids)
    done, folder = warc.archive(pages.limit(0))
    assert warc.read(done, folder).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 90), (7, 7)]
    got = {tuple(r) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(95, 90), (100, 90)}


def _plain_lines(rows):
    """Lines left of each (id, text) in order, by a set of the windows seen."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        ls = (t or "").split("\n")
        gone = set()
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if any(x.strip(" ") for x in w):
                gone |= set(range(p, p + 3)) if w in seen else set()
                seen.add(w)
        out[i] = t if not gone else "\n".join(x for k, x in enumerate(ls) if k not in gone)
    return out


def test_pipeline(spark, tmp_path):
    """Every stage against a plain version, and run() against the stages; odd rows, clashing columns."""
    import public_tokenizers
    from tokenizers import Tokenizer

    real = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000").orderBy("doc_id").limit(200)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(5)
    item = items.first().text
    extra = [(-1, None, "en"), (-2, "", "en"), (-3, "word", None), (-4, f"some lead {item} and a tail", "en")]
    docs = real.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    docs = docs.unionByName(docs.limit(20)).withColumns({"n_removed": F.lit(5), "log_weight": F.col("doc_id") * 2, "__id": F.lit("i"), "s": F.lit("x"), "number": F.lit(1.5)})
    folder = str(tmp_path / "sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    labels, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = Counter((r.doc_id, r.text) for r in now.collect())
        now = corpus_pipeline.stored(stage(spark, now, folder), name)
        rows = now.collect()
        after = Counter((r.doc_id, r.text) for r in rows)
        assert now.columns == columns and all((r.n_removed, r.log_weight, r["__id"], r.s, r.number) == (5, 2 * r.doc_id, "i", "x", 1.5) for r in rows)
        if name == "quality":
            want = Counter((r.doc_id, r.text) for r in quality.sample(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), labels).collect())
            assert after == want and set(after) <= set(before)
        elif name == "lines":
            left = _plain_lines(set(before))
            assert after == Counter({(i, left[i]): n for (i, t), n in before.items() if left[i] == t or left[i].strip(" ")})
        elif name == "near":
            keep = {i for i, n, c in _classes(dict(before).keys(), 5, 80) if not n or i == c}
            assert after == Counter(k for k in before if k[0] in keep)
        else:
            hit = {i for i, _ in _overlaps(before, [(r.item_id, r.text) for r in bench.collect()])}
            assert -4 in hit and set(after) == {k for k in before if k[0] not in hit}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter({i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in after})
    got = Counter()
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r.doc_id] += r.length
    assert got == want and len(want) > 60


def test_pipeline_on_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    """A folder of empty tables."""
    folder = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "pipeline"])
def test_queries_on_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_quality_and_benchmark_on_long_texts(spark):
    """Texts of a million words are read whole: what stands at their end counts."""
    long = "plain words of no kind " * 200_000
    docs = spark.createDataFrame([(i, f"good text number {i} of many") for i in range(60)] + [(100 + i, f"spam spam offer {i}") for i in range(60)] + [(500, long), (501, long + " spam spam offer")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    weight = {r.doc_id: r.log_weight for r in quality.weigh(docs, quality.fit(docs, labels)).collect()}
    assert weight[501] < min(weight[500], -1.6)
    items = spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(30)))], "item_id long, text string")
    hit = spark.createDataFrame([(7, long + " ".join(f"item{i}" for i in range(30))), (8, long)], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.remove(hit, items).collect()] == [8]


def test_full_sets_take_one_worker_a_task(spark):
    """The rows of classes are found and taken apart in one Python step: a second one would keep its own workers beside it."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, None)], "doc_id long, text string")
    need = ngram_join.short_lists(docs, np.zeros(ngram_join.SKETCH, np.int64), 5, 80).filter("doc_id = 2").selectExpr("7L AS node", "doc_id AS rid", "d1")
    rows = ngram_join._full_sets(docs, need.localCheckpoint(), 5)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    (row,) = rows.collect()
    assert row.node == 7 and len(row.s) == 2
