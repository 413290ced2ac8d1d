"""N-gram Jaccard self-join by T-occurrence search (DivideSkip).

Two texts of n and m shingles that reach the similarity share at least T = ceil(sim * max(n, m))
shingles. The steps:

1. Count shingles in a sketch (all documents); its counts order each text's shingles, rare
   ones first. Any order gives right results, this one keeps the lists below short.
2. Rows with equal shingle sets become one class.
3. Who has to be searched together. A class leaves its most frequent shingles aside, all but K
   of those T that a partner may share, so partners share K of what remains (K a sixteenth of
   T, OCCUR at least). Shingles of one class only go, then classes with less than K left. Lists
   of up to ``SHORT`` classes give pairs, whose longer lists are counted one by one where a pair
   lacks some. Longer lists tie only classes that have K of them, and there the K - 1 longest
   are left aside again. So a passage that many texts hold
   ties none of them, as long as it is not most of what they share with others.
   Pairs and ties make families.
4. A family is dealt to blocks of a bounded number of classes and shingles: an inverted index
   of a block, and T-occurrence queries of it or of another one. Each query's lists are divided
   into the L longest and the short ones; the short ones are merged with a heap and what occurs
   T - L times is probed in the long ones by binary search. Pairs that are connected already
   are skipped, so only a spanning forest of verified links comes out.
5. First every block is searched by itself, in a family of several blocks under two ways to
   deal. Copies of one text are one component then. Of such a family only classes that share
   enough for a link with other components go on; those that are not in the largest component
   meet all the blocks, the largest component's blocks don't meet again.

A small family is one block, a large one many: the same search, and no group that grows with
the family. A component is what links reach, so the operator returns components, not the
number of links.

Defined cases: NULL and empty texts have the empty set and are linked with nothing; a text
shorter than a shingle is one shingle; repeated rows are equal texts; rows of one doc_id with
different texts are documents of their own, each with its own component, whatever their order;
a NULL doc_id is not searched and its component is NULL; a text of any length is one set; an empty
table gives no row. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnwork.llm.common import SLICE, U, chunks, doc_shingles, marked, mix, slices, sum_slices, word_hashes
from tarnwork.llm.graph import components
from tarnwork.storage import dropped, stored

SKETCH = 1 << 20
SHORT = 16
OCCUR, PART = 3, 16
BLOCK_SETS, BLOCK_SHINGLES = 64, 1 << 17
MU = 0.01  # cost of a probe against a merge step, as in the published choice of L


def shingles_of(column, n: int):
    """(row, sorted distinct shingles) of each text."""
    for i, j, data, offsets in chunks(column):
        h, bounds = word_hashes(data, offsets)
        for k in range(j - i):
            yield i + k, doc_shingles(h[bounds[k] : bounds[k + 1]], n)


def least_overlap(n, percent: int):
    return -(-n * percent // 100)


def shared_at_least(need: int) -> int:
    """K: how many of its T = ``need`` shared shingles a text keeps in its lists."""
    return min(need, max(OCCUR, need // PART))


def _cell(s: np.ndarray) -> np.ndarray:
    return (s >> U(44)).astype(np.int64)


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    def work(batches):
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(0)):
                h, bounds = word_hashes(data, offsets)
                sets = [doc_shingles(h[bounds[k] : bounds[k + 1]], n) for k in range(j - i)]
                counts += np.bincount(_cell(np.concatenate(sets)), minlength=SKETCH)
        yield slices(counts)

    found = sum_slices(docs.select("text").mapInArrow(work, "slice int, part int, counts binary"))
    return np.concatenate([found.get(i, np.zeros(SLICE, np.int64)) for i in range(SKETCH // SLICE)])


def short_lists(docs: DataFrame, order: np.ndarray, n: int, percent: int) -> DataFrame:
    """(doc_id, n, d1, d2, lists): set size, digest of the set, and the shingles that are not left aside."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(order, 2**31 - 1).astype(np.int32))  # any order will do

    def work(batches):
        rank = shared.value
        for batch in (x.slice(at, 512) for x in batches for at in range(0, x.num_rows, 512)):  # the lists of a whole batch are large
            sizes, d1, d2, lists, lengths = [], [], [], [], [0]
            for _, s in shingles_of(batch.column(1), n):
                size = len(s)
                need = least_overlap(size, percent)
                keep = size - need + shared_at_least(need)
                m = mix(s)
                sizes.append(size)
                d1.append(m.sum(dtype=np.uint64))
                d2.append(mix(m ^ U(0x2545F4914F6CDD1D)).sum(dtype=np.uint64))
                lists.append(s[np.lexsort((s, rank[_cell(s)]))[:keep]])
                lengths.append(lengths[-1] + len(lists[-1]))
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            values = pa.array((np.concatenate(lists) if lists else np.zeros(0, np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), long(d1), long(d2), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), values)], names=["doc_id", "n", "d1", "d2", "lists"]
            )

    return docs.mapInArrow(work, "doc_id long, n long, d1 long, d2 long, lists array<long>")


# --------------------------------------------------------------------------- search


def divide(lengths: np.ndarray, need: int) -> int:
    """L, the number of longest lists to probe: the published choice, at most T - 1."""
    longest = max(2, int(lengths.max(initial=2)))
    return min(need - 1, int(need / (MU * math.log2(longest) + 1)))


def heap_merge(runs: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur in at least ``least`` of the ascending runs, and in how many."""
    found = [(i, n) for i, n in ((i, sum(1 for _ in same)) for i, same in groupby(heapq.merge(*[r.tolist() for r in runs]))) if n >= least]
    return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)


def occurrences(lists: list[np.ndarray], need: int, sizes: np.ndarray, open_: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, occurrences) of the ``open_`` ids that occur in at least ``least`` of the lists, none of which may be below ``need``.

    ``lists`` ascend by id; ``open_`` and ``least`` are given for every id.
    """
    lengths = np.array([len(x) for x in lists], np.int64)
    order = np.argsort(lengths, kind="stable")
    n_long = divide(lengths, need)
    short, long = order[: len(order) - n_long], order[len(order) - n_long :]
    ids, counts = heap_merge([lists[k] for k in short if lengths[k]], need - n_long)
    keep = open_[ids]
    ids, counts = ids[keep], counts[keep]
    for done, k in enumerate(long):  # the shorter of the long ones first: fewer can be reached the later it gets
        keep = counts + (n_long - done) >= least[ids]
        ids, counts = ids[keep], counts[keep]
        if not len(ids):
            break
        run = lists[k]
        at = np.minimum(np.searchsorted(run, ids), len(run) - 1)
        counts = counts + (run[at] == ids)
    keep = counts >= least[ids]
    return ids[keep], counts[keep]


def search(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest (node, smallest node) of the links between the two sides, or within the one there is.

    Nodes of one ``known`` component are connected already.
    """
    order = np.lexsort((nodes, side))
    nodes, sets, side = nodes[order], [sets[i] for i in order], side[order]
    sizes = np.array([len(s) for s in sets])
    m, first = len(nodes), int((side == side[0]).sum())
    within = first == m
    n_index = first  # the first side is indexed, the last one asks
    tokens, local, df = np.unique(np.concatenate(sets[:n_index]), return_inverse=True, return_counts=True)
    starts = np.concatenate([[0], np.cumsum(df)])
    lists = np.repeat(np.arange(n_index), sizes[:n_index])[np.argsort(local, kind="stable")]  # by shingle, ids ascending
    parent = np.arange(m)
    if known is not None:
        _, at, which = np.unique(known[order], return_index=True, return_inverse=True)
        parent = at[which]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(1 if within else first, m):
        s = sets[i]
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        mine = at[tokens[at] == s]
        need = int(least_overlap(sizes[i], percent))
        if len(mine) < need:
            continue
        most = i if within else n_index  # within one block a text asks those before it
        own = root(i)
        joined = np.array([root(j) for j in range(most)]) == own
        close = 100 * np.minimum(sizes[:most], sizes[i]) >= percent * np.maximum(sizes[:most], sizes[i])
        open_ = np.zeros(n_index, bool)
        open_[:most] = close & ~joined
        if not open_.any():
            continue
        least = -(-percent * (sizes[:n_index] + sizes[i]) // (100 + percent))  # overlap that the similarity asks of this pair
        runs = [lists[starts[t] : starts[t + 1]] for t in mine]
        runs += [np.zeros(0, np.int64)] * (len(s) - len(runs))
        for j in occurrences(runs, need, sizes, open_, least)[0]:
            a, b = root(int(j)), root(i)
            parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(m)])
    smallest = {}
    for i in np.argsort(nodes, kind="stable"):
        smallest.setdefault(int(roots[i]), int(nodes[i]))
    return [(int(nodes[i]), smallest[int(roots[i])]) for i in range(m) if smallest[int(roots[i])] != nodes[i]]


def _full_sets(docs: DataFrame, need: DataFrame, n: int) -> DataFrame:
    """(node, s) of the classes in ``need`` (node, rid, d1): the whole set, from a text of the class."""

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                sets = [s for _, s in shingles_of(some.column(1), n)]
                ends = np.cumsum([0, *map(len, sets)])
                digest = [mix(s).sum(dtype=np.uint64) for s in sets]
                values = pa.array((np.concatenate(sets) if sets else np.zeros(0, np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.array(digest, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["rid", "d1", "s"])

    found = marked(docs.select(F.col("doc_id").alias("rid"), "text"), need, "rid", work, "rid long, d1 long, s array<long>")
    return found.join(need, ["rid", "d1"]).select("node", "s").dropDuplicates(["node"])


def families(reps: DataFrame, percent: int) -> DataFrame:
    """(node, f): the classes that have to be searched together; classes that have no partner are left out."""
    need = lambda x: F.floor((x * percent + 99) / 100)
    share = lambda x: F.least(need(x), F.greatest(F.lit(OCCUR), F.floor(need(x) / PART))).cast("long")
    close = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    postings = reps.select("node", F.explode("lists").alias("s"))
    met = postings.groupBy("s").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("s")
    shared = stored(postings.join(met, "s"), "postings")
    # a partner has need(n) shingles at least, so a class that shares less than it asks for has none
    asks = reps.select("node", "n", share(need(F.col("n"))).alias("k"))
    enough = shared.groupBy("node").agg(F.count(F.lit(1)).alias("m")).join(asks, "node").filter("m >= k").select("node", "n", "k")
    some = stored(shared.join(enough, "node"), "postings")
    dropped(shared)
    met = some.groupBy("s").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = stored(some.join(met, "s"), "postings")
    dropped(some)
    lists = shared.filter(F.col("c") <= SHORT).groupBy("s").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("l"))
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(
        F.filter(F.slice("l", i + 2, F.lit(SHORT)), lambda y: close(x["n"], y["n"])),
        lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), F.least(share(x["n"]), share(y["n"])).alias("k")),
    )))
    met = stored(lists.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b", "p.k").agg(F.count(F.lit(1)).alias("m")), "pairs")
    # what a pair lacks in short lists must be in long ones: as many as each of the two has there, then as many as both have
    hot = stored(shared.filter(F.col("c") > SHORT).groupBy("node", "k").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("l")).withColumn("long", F.size("l")), "long")
    of = lambda x, *what: hot.select(F.col("node").alias(x), *[y.alias(f"{z}_{x}") for z, y in what])
    long, ids = ("long", F.col("long")), ("ids", F.col("l.s"))
    weak = met.filter("m < k").join(of("a", long), "a").join(of("b", long), "b").filter("m + least(long_a, long_b) >= k").select(*met.columns)
    weak = weak.join(of("a", ids), "a").join(of("b", ids), "b").filter("m + size(array_intersect(ids_a, ids_b)) >= k").select(*met.columns)
    often = met.filter("m >= k").unionByName(weak)
    # a partner that no short list shows is in k long ones, so in one that is not among the k - 1 longest of either
    some = hot.filter("long >= k").select("node", F.explode(F.expr("slice(l, 1, long - k + 1)")).alias("e")).select("node", F.col("e.s").alias("s"))
    tied = some.join(some.groupBy("s").agg(F.min("node").alias("first")), "s").select(F.col("node").alias("a"), F.col("first").alias("b"))
    joined = components(stored(often.select("a", "b").unionByName(tied), "ties"))
    dropped(shared, met, hot)
    return joined.select(F.col("a").alias("node"), F.col("b").alias("f")).unionByName(joined.select(F.col("b").alias("node"), F.col("b").alias("f")).distinct())


def _blocks(which=None):
    """The number of blocks that the rows of a group (those of ``which``) are dealt to."""
    of = lambda x: x if which is None else F.when(which, x)
    return F.ceil(F.greatest(F.count(of(F.lit(1))) / BLOCK_SETS, F.coalesce(F.sum(of(F.col("n"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int")


def _apart(left: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The rows of ``left`` (f, node, n, c, rest) that share as much with other components of their family as a link asks for."""
    held = left.join(full, "node").select("f", "c", "node", F.explode("s").alias("s"))
    others = held.groupBy("f", "s").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x < y").select("f", "s")
    most = held.join(others, ["f", "s"]).groupBy("node").agg(F.count(F.lit(1)).alias("most"))
    # the smallest partner there is asks for the least
    sizes = left.select("f", "n").distinct()
    of = sizes.groupBy("f").agg(F.collect_list("n").alias("sizes"))
    n = F.col("n")
    least = sizes.join(of, "f").select("f", "n", F.array_min(F.filter("sizes", lambda x: 100 * x >= percent * n)).alias("least"))
    asks = F.floor((percent * (n + F.col("least")) + 99 + percent) / (100 + percent))
    return stored(left.join(least, ["f", "n"]).join(most, "node").filter(F.col("most") >= asks).select("f", "node", "n", "c", "rest"), "apart")


def _linked(docs: DataFrame, member: DataFrame, n: int, percent: int) -> DataFrame:
    """:func:`components` of the links in the families ``member`` (node, n, rid, d1, f)."""

    def work(table: pa.Table) -> pa.Table:
        s = table["s"].combine_chunks()
        ends, values = s.offsets.to_numpy(), s.values.to_numpy().view(np.uint64)
        side = table["h"].to_numpy()
        alone = table["k1"][0] != table["k2"][0] and side.min() == side.max()  # two blocks, one of them empty
        sets = [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
        links = search(table["node"].to_numpy(), sets, side, percent, table["c"].to_numpy()) if len(side) > 1 and not alone else []
        cols = list(zip(*links)) or [(), ()]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})

    found = lambda groups, full: groups.join(full, "node").select("f", "k1", "k2", "h", "node", "c", "s").groupBy("f", "k1", "k2").applyInArrow(work, "a long, b long")

    # first every class meets those of its own block, in a family of several blocks twice, dealt in two ways
    blocks = member.groupBy("f").agg(_blocks().alias("q"))
    dealt = member.join(blocks, "f").select("node", "f", "q", F.explode(F.when(F.col("q") == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("r"))
    k = F.col("r") * F.col("q") + F.pmod(F.xxhash64("node", "r"), F.col("q")).cast("int")
    groups = dealt.select("node", "f", k.alias("k1"), k.alias("k2"), F.lit(0).alias("h"), F.col("node").alias("c"))
    linked = components(found(groups, _full_sets(docs, member.select("node", "rid", "d1"), n)))

    # then those that this has not connected with their family's largest component meet all the others
    several = member.join(blocks.filter("q > 1").select("f"), "f").join(linked, F.col("node") == F.col("a"), "left").select("f", "node", "n", "rid", "d1", F.coalesce("b", "node").alias("c"))
    several = stored(several, "several")
    sizes = several.groupBy("f", "c").agg(F.count(F.lit(1)).alias("m"))
    top = sizes.groupBy("f").agg(F.count(F.lit(1)).alias("of"), F.max_by("c", F.struct("m", "c")).alias("top")).filter("of > 1").select("f", "top")
    left = stored(several.join(top, "f").withColumn("rest", F.col("c") != F.col("top")).drop("top"), "left")
    dropped(several)
    if not left.isEmpty():
        full = stored(_full_sets(docs, left.select("node", "rid", "d1"), n), "full")
        left_over = _apart(left, full, percent)
        blocks = left_over.groupBy("f").agg(_blocks(F.col("rest")).alias("q"), _blocks(~F.col("rest")).alias("p")).filter("q > 0")
        at = F.xxhash64("node")
        dealt = left_over.join(blocks, "f").withColumn("h", F.when(F.col("rest"), F.pmod(at, F.col("q"))).otherwise(F.col("q") + F.pmod(at, F.greatest("p", F.lit(1)))).cast("int"))
        meets = F.sequence(F.lit(0), F.when(F.col("rest"), F.col("q") + F.col("p")).otherwise(F.col("q")) - 1)
        pairs = dealt.select("node", "f", "c", "h", F.explode(meets).alias("o")).select("node", "f", F.least("h", "o").alias("k1"), F.greatest("h", "o").alias("k2"), "h", "c")
        linked = components(linked.unionByName(found(pairs, full)))
        dropped(full, left_over)
    dropped(left)
    return linked


def join_classes(documents: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = stored(short_lists(docs, sketch(docs, n), n, percent), "sets")
    same = sets.filter("n > 0 AND doc_id IS NOT NULL")
    # numbered when written, so a class has the same number wherever it is read
    whole = stored(same.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rid"), F.first("lists").alias("lists")).withColumn("node", F.monotonically_increasing_id()), "reps")
    ids, reps = stored(sets.drop("lists"), "ids"), stored(whole.drop("lists"), "classes")
    dropped(sets)  # the lists are needed once more only, those of the classes
    found = families(whole, percent)
    dropped(whole)
    member = stored(found.join(reps.select("node", "n", "rid", "d1"), "node"), "families")

    linked = _linked(docs, member, n, percent)

    to = reps.select("d1", "d2", F.col("n").alias("rn"), "rid", "node").join(linked, F.col("node") == F.col("a"), "left").withColumn("c", F.coalesce("b", "node"))
    to = stored(to.select("d1", "d2", "rn", "rid", "c"), "roots")
    least = to.groupBy("c").agg(F.min("rid").alias("component_id"))
    # both sides come from written tables, so AQE may split a class of very many copies
    classes = stored(to.join(least, "c").select("d1", "d2", "rn", "component_id"), "components")
    dropped(reps, member, to)
    known = F.col("n") > 0
    out = ids.join(classes, ["d1", "d2"], "left").filter(~known | F.col("rn").isNull() | (F.col("n") == F.col("rn")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).when(known, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(documents: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with one row of each class, that of the smallest id; rows without shingles stay.

    Of rows that repeat an id with its text one stays. An id with several texts is one
    document here: it goes if all its texts have a smaller representative.
    """
    classes = join_classes(documents, n, percent, id_col, text_col).filter("doc_id IS NOT NULL")
    gone = classes.groupBy("doc_id").agg(F.bool_and((F.col("n_shingles") > 0) & (F.col("component_id") != F.col("doc_id"))).alias("__all")).filter("__all").select(F.col("doc_id").alias("__gone"))
    kept = documents.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
    return kept.withColumns({"__d1": F.xxhash64(text_col), "__d2": F.xxhash64(F.lit(1), text_col)}).dropDuplicates([id_col, "__d1", "__d2"]).drop("__d1", "__d2")


# links by counting shared shingles, components by reachability: for small tables
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), sized AS (
  SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS d, s FROM sets
), reps AS (
  SELECT d, min(doc_id) AS rep, any_value(n) AS n, arg_min(s, doc_id) AS s FROM sized WHERE n > 0 GROUP BY d
), postings AS (
  SELECT rep, n, unnest(s) AS g FROM reps
), links AS (
  SELECT a.rep AS a, b.rep AS b FROM postings a JOIN postings b ON a.g = b.g AND a.rep < b.rep
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), least_of AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
)
SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_shingles, CASE WHEN z.n = 0 THEN z.doc_id ELSE least(r.rep, coalesce(m.m, r.rep)) END AS component_id
FROM sized z LEFT JOIN reps r ON z.d = r.d AND z.n > 0 LEFT JOIN least_of m ON m.a = r.rep
"""


def query(spark, sf_dir: str) -> DataFrame:
    return join_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)
