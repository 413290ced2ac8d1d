"""The whole linkage run on files, its restart, and what it writes."""

import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnwork import Config
from tarnwork.operators import blocking as B
from tarnwork.operators import pairs as P
from tarnwork.operators import predict as R
from tarnwork.operators.batches import Batches, batch_of
from tarnwork.plans import linkage
from tarnwork.sources import fixtures as X
from tarnwork.sources.io import SCHEMAS, conform, file_counts, read_head, read_tsv, spans_lines, write_json, write_parquet, write_tsv
from tarnwork.storage import exists, get_text, listing, put_text, remove, stored
from tests.conftest import SF

CONFIG = Config(trees=6, min_leaf=5, batch_rows=120)


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('linkage')}"
    inputs = X.linkage_files(spark, SF, f"{folder}/in")
    out = linkage.run(spark, inputs, f"{folder}/work", CONFIG)
    return inputs, f"{folder}/work", [tuple(r) for r in out.collect()]


def _candidates(spark, ran, config=CONFIG):
    """The batched table of the candidates as the run would see it."""
    inputs, work, _ = ran
    source1, _, _ = linkage.prepare(spark, inputs, work, config)
    return linkage.candidate_batches(spark, source1, work, config, linkage.fingerprints(spark, inputs, config)["candidates"])


def _block(spark, inputs, work, config, jobs=1):
    source1, targets, _ = linkage.prepare(spark, inputs, work, config)
    return linkage.block(spark, source1, targets, work, config, linkage.fingerprints(spark, inputs, config), jobs)


def _rows(df):
    return sorted(tuple(r) for r in df.select(*B.PAIR, "block_priority").collect())


def test_run(spark, ran):
    inputs, work, out = ran
    source1, targets, truth = linkage.prepare(spark, inputs, work)
    batches = _candidates(spark, ran)
    assert batches.n == linkage.n_batches(source1, CONFIG) == 5 and sorted(i for i, _ in out) == sorted(r.entity_id for r in source1.collect())
    found = batches.read()
    assert {r.batch_id for r in found.select("batch_id").distinct().collect()} <= set(range(5))
    assert found.filter(F.col("batch_id") != batch_of(F.col("source1_id"), 5)).count() == 0
    whole = B.candidates(source1, targets)
    assert _rows(found) == _rows(whole)
    model, threshold = R.load_model(spark, f"{work}/model")
    predicted = linkage.predict(whole, source1, targets, model, threshold, CONFIG)
    assert sorted(tuple(r) for r in R.match_output(source1, predicted).collect()) == sorted(out)
    found_ids = {(i, t) for i, m in out for t in m.split(",") if m != "[]"}
    true = {tuple(r) for r in truth.collect()}
    assert len(true & found_ids) > 0.8 * len(true)
    report = json.loads(spark.read.json(f"{work}/report").first().report)
    assert report["selected"]["threshold"] == threshold in CONFIG.thresholds and len(report["sweep"]) == len(CONFIG.thresholds)
    assert report["blocking_recall"] == 1.0 and 0 < report["training_pairs"] < report["pairs"]


def test_restart(spark, ran, monkeypatch):
    """Nothing current is done again; batches that no job has reported are; gaps are listed and refused; a reset starts anew."""
    inputs, work, out = ran
    monkeypatch.setattr(linkage.B, "candidates", lambda *a: pytest.fail("blocked again"))
    monkeypatch.setattr(linkage.R, "train", lambda *a: pytest.fail("trained again"))
    assert sorted(tuple(r) for r in linkage.run(spark, inputs, work, CONFIG).collect()) == sorted(out)
    monkeypatch.undo()
    before = _rows(_candidates(spark, ran).read())
    (report,) = [name for name, _, _ in listing(spark, f"{work}/candidates/_done")]
    put_text(spark, f"{work}/candidates/_done/{report}", "[[0, 0], [2, 2], [4, 4]]")
    remove(spark, f"{work}/candidates/batch_id=3")  # of batch 1 all rows lie there, of batch 3 none
    assert _candidates(spark, ran).missing() == [1, 3]
    with pytest.raises(ValueError, match="missing batches: 1, 3"):
        _candidates(spark, ran).read()
    with pytest.raises(ValueError, match="missing batches: 1, 3"):
        linkage.quick_eval(spark, inputs, work, config=CONFIG)
    spark.read.parquet(f"{work}/candidates/batch_id=0").coalesce(1).write.mode("append").parquet(f"{work}/candidates/batch_id=1")  # as a job leaves it that is stopped
    assert sorted(tuple(r) for r in linkage.run(spark, inputs, work, CONFIG).collect()) == sorted(out)
    assert _rows(_candidates(spark, ran).read()) == before
    linkage.reset(spark, work)
    assert not exists(spark, f"{work}/model") and exists(spark, f"{work}/entities/source1/_SUCCESS")
    assert sorted(tuple(r) for r in linkage.run(spark, inputs, work, CONFIG, fresh=True).collect()) == sorted(out)


@pytest.mark.parametrize(("first", "second"), [(120, 47), (47, 1000), (1000, 120)])
def test_other_batch_size(spark, ran, tmp_path, first, second):
    """A run goes on with the batches it finds, whatever size it would choose: no row is lost or repeated."""
    inputs, work = ran[0], f"file://{tmp_path}/w"
    want = _rows(_candidates(spark, ran).read())
    a = _block(spark, inputs, work, CONFIG.but(batch_rows=first))
    (report,) = [name for name, _, _ in listing(spark, f"{work}/candidates/_done")]
    put_text(spark, f"{work}/candidates/_done/{report}", "[[0, 0]]")
    b = _block(spark, inputs, work, CONFIG.but(batch_rows=second))
    assert b.n == a.n and _rows(b.read()) == want
    linkage.run(spark, inputs, work, CONFIG.but(batch_rows=second, trees=2))
    out = linkage.run(spark, inputs, work, CONFIG.but(batch_rows=first, trees=2))
    assert out.count() == out.select("source1_entity_id").distinct().count() == len(ran[2])


def test_other_parameters(spark, ran, tmp_path):
    """Another cap makes candidates anew, up and down; what does not depend on it stays."""
    inputs, work = ran[0], f"file://{tmp_path}/w"
    of = lambda cap: _rows(_block(spark, inputs, work, CONFIG.but(max_candidates=cap)).read())
    wide, narrow, again = of(50), of(2), of(50)
    assert wide == again and max(Counter(r[0] for r in narrow).values()) == 2 < max(Counter(r[0] for r in wide).values())
    before = get_text(spark, f"{work}/entities/targets/_manifest")
    with pytest.raises(ValueError, match="other inputs or parameters"):
        linkage.quick_eval(spark, inputs, work, config=CONFIG.but(max_candidates=2))
    prints = lambda **c: linkage.fingerprints(spark, inputs, CONFIG.but(**c))
    changed = lambda **c: {k for k, v in prints(**c).items() if v != prints()[k]}
    assert changed(batch_rows=7) == set() and changed(trees=9) == {"model"} and changed(prefilter_top_k=3) == {"predicting"}
    assert changed(max_candidates=3) == {"indexes", "candidates", "model", "predicting"} and get_text(spark, f"{work}/entities/targets/_manifest") == before


def test_other_inputs(spark, tmp_path):
    """Input files that change make everything anew that hangs on them."""
    inputs, work = X.linkage_files(spark, "/root/testdata/sf0.001", f"file://{tmp_path}/in"), f"file://{tmp_path}/w"
    n = len(_rows(_block(spark, inputs, work, CONFIG).read()))
    half = read_tsv(spark, inputs["source2"])
    write_tsv(half.filter(F.col("entity_id").cast("int") % 8 == 1), f"file://{tmp_path}/half")
    moved = inputs | {"source2": f"file://{tmp_path}/half"}
    targets = {r[1] for r in _rows(_block(spark, moved, work, CONFIG).read())}
    assert 0 < len(targets) and all(int(t) % 8 == 1 or int(t) % 4 == 3 for t in targets)
    assert len(_rows(_block(spark, inputs, work, CONFIG).read())) == n


def test_jobs_do_not_grow_with_batches(spark, ran, tmp_path):
    inputs, used = ran[0], {}
    for rows in (500, 20):
        config = CONFIG.but(batch_rows=rows)
        source1, targets, _ = linkage.prepare(spark, inputs, f"file://{tmp_path}/{rows}", config)
        spark.sparkContext.setJobGroup(f"batches-{rows}", "")
        batches = linkage.block(spark, source1, targets, f"file://{tmp_path}/{rows}", config, linkage.fingerprints(spark, inputs, config))
        used[batches.n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"batches-{rows}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(used) == [1, 25] and used[25] <= used[1] + 3


def test_batches_in_several_jobs(spark, tmp_path):
    """Each job says what it has done; a stop loses the job that ran, empty batches are done too."""
    rows = stored(spark.range(100).select(F.col("id").cast("string").alias("key"), F.col("id").alias("v")))
    table = lambda: Batches(spark, f"file://{tmp_path}/t", "f", "key", lambda: 40)
    calls = []

    def make(fail, part):
        calls.append(part)
        if len(calls) == fail:
            raise RuntimeError("stopped")
        return table().only(rows, part, batch_of(F.col("key"), 40)).filter("v % 3 = 0")

    with pytest.raises(RuntimeError):
        table().write(lambda part: make(3, part), jobs=4)
    assert table().missing() == list(range(20, 40))
    assert table().write(lambda part: make(0, part)) == list(range(20, 40)) and table().missing() == []
    got = table().read()
    assert sorted(r.v for r in got.collect()) == list(range(0, 100, 3)) and len({r.batch_id for r in got.collect()}) < 40
    put_text(spark, f"file://{tmp_path}/t/_done/x.json.draft", "[[")  # a report that was not finished
    assert table().missing() == [] and Batches(spark, f"file://{tmp_path}/t", "other", "key", lambda: 3).missing() == [0, 1, 2]
    scattered = list(range(0, 40, 2))
    assert {r.v for r in table().only(rows, scattered, batch_of(F.col("key"), 40)).collect()} == {r.v for r in rows.filter(batch_of(F.col("key"), 40) % 2 == 0).collect()}


def test_half_written_model(spark, ran, tmp_path):
    """A model whose save was stopped is trained again; one that is none is refused with a reason."""
    inputs, work, out = ran
    remove(spark, f"{work}/model")
    put_text(spark, f"{work}/model/meta/_temporary/x", "")
    put_text(spark, f"{work}/model/model/metadata/_temporary/x", "")
    with pytest.raises(ValueError, match="no finished model"):
        R.load_model(spark, f"{work}/model")
    assert sorted(tuple(r) for r in linkage.run(spark, inputs, work, CONFIG).collect()) == sorted(out)


def _exchanges_over(plan, table):
    """Whether an Exchange stands between the scan of a table and the first join above it."""
    lines = plan.splitlines()
    deep = lambda x: max(x.find("+- "), x.find(":- "))
    at = next(i for i, x in enumerate(lines) if "Scan parquet" in x and re.search(rf"_{table}\b", x))
    depth = deep(lines[at])
    for x in reversed(lines[:at]):
        if deep(x) < depth:
            depth = deep(x)
            if "Exchange" in x or "Join" in x:
                return "Exchange" in x
    return False


def test_bucketed_joins(spark, ran):
    """Neither entity tables nor indexes are shuffled in the run's joins, also for a session that has to attach them."""
    inputs, work, _ = ran
    prefix = linkage._name(work, "index")
    B.drop_indexes(spark, prefix)
    spark.sql(f"DROP TABLE IF EXISTS {linkage._name(work, 'targets')}")
    source1, targets, _ = linkage.prepare(spark, inputs, work, CONFIG)
    index = linkage.indexes(spark, targets, work, CONFIG, linkage.fingerprints(spark, inputs, CONFIG)["indexes"])
    assert B.indexes_ready(spark, prefix)
    found = _candidates(spark, ran).read()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        enriched = plan(P.enrich(found, source1, targets))
        assert not _exchanges_over(enriched, "targets") and not _exchanges_over(enriched, "source1") and enriched.count("Exchange hashpartitioning") == 2
        assert not _exchanges_over(plan(B.exact_block(source1, index.exact)), "index_exact")
        counts = stored(B.exact_counts(source1, index.exact_sizes, index.exact), "counts")
        assert not _exchanges_over(plan(B.exact_counts(source1, index.exact_sizes, index.exact)), "index_exact_sizes")
        rare = B.rare_block(source1, index.rare, index.exact, counts, CONFIG)
        assert not _exchanges_over(plan(rare), "index_rare")
        assert not _exchanges_over(plan(B.prefix_block(source1, index.prefix, counts, stored(rare, "rare"), CONFIG)), "index_prefix")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_quick_eval(spark, ran):
    inputs, work, _ = ran
    report = linkage.quick_eval(spark, inputs, work, limit=300, config=CONFIG, prefilter=True)
    assert report["entities"] == 300 and 0 < report["validation_entities"] < 300 and len(report["sweep"]) == 47
    assert report["selected"]["recall"] > 0.5 and report["validation_blocking_recall"] == 1.0
    assert json.loads(spark.read.json(f"{work}/quick").first().report) == report


def test_label_column(spark):
    name = lambda *names: linkage.label_column(spark.createDataFrame([tuple(range(len(names)))], list(names)))
    assert name("a", "is_match") == "is_match" and name("a", "match") == "match" and name("match", "label") == "label"
    with pytest.raises(ValueError, match="no label column"):
        name("y", "z")
    with pytest.raises(ValueError, match="no label column"):
        linkage.label_column(spark.range(1))


def test_model_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, float(i % 2) + i / 1000) for i in range(200)], "i int, label int, x double")
    config = Config(trees=3, min_leaf=2)
    model = R.train(rows, config, ["x"])
    R.save_model(model, str(tmp_path / "m"), 0.42, {"a": 1})
    again, threshold = R.load_model(spark, str(tmp_path / "m"))
    assert threshold == 0.42 and R.score(again, rows).select("probability").collect() == R.score(model, rows).select("probability").collect()
    model.write().save(str(tmp_path / "bare"))
    assert R.load_model(spark, str(tmp_path / "bare"))[1] == Config.threshold
    with pytest.raises(ValueError, match="both classes"):
        R.train(rows.filter("label = 1"), config, ["x"])


def test_hard_score_orders_negatives(spark):
    rows = [("a", f"t{i}", "s", 0, float(n), float(x), c) for i, (n, x, c) in enumerate([(1, 1, 1), (0.2, 0.1, 0), (0.9, 0, 1), (0, 1, 0)])] + [("a", "p", "s", 1, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "source1_id string, target_id string, target_source string, label int, n double, x double, c int")
    scored = df.withColumn("hard_score", P.hard_score(F.col("n"), F.col("x"), F.col("c")))
    assert [round(r.hard_score, 9) for r in scored.orderBy("target_id").collect()] == [1.0, 1.0, 0.13, 0.65, 0.3]
    got = {r.target_id for r in P.training_sample(scored, Config(hard_per_positive=2, easy_per_positive=0)).collect()}
    assert got == {"p", "t0", "t2"}


def test_index_tables(spark, tmp_path):
    from tarnwork.operators.entities import normalize_entities, split_sides

    a, b = split_sides(normalize_entities(X.entities_part(spark, "/root/testdata/sf0.001")))
    B.drop_indexes(spark, "linkage_test")
    assert not B.indexes_ready(spark, "linkage_test")
    for _ in range(2):  # replaced when built again
        B.save_indexes(B.build_indexes(b), "linkage_test", buckets=2)
    assert B.indexes_ready(spark, "linkage_test")
    whole, looked_up = B.candidates(a, b), B.candidates(a, None, indexes=B.load_indexes(spark, "linkage_test"))
    assert whole.count() > 0 and whole.exceptAll(looked_up).count() == looked_up.exceptAll(whole).count() == 0
    B.drop_indexes(spark, "linkage_test")
    assert not B.indexes_ready(spark, "linkage_test")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    write_parquet(df.coalesce(1), str(tmp_path / "p"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).collect())) == [(1, "a"), (2, "b"), (2, "c")]
    assert [f.name.split(".")[-2] for f in (tmp_path / "p").iterdir() if f.name.startswith("part")] == ["zstd"]
    write_parquet(df, str(tmp_path / "by"), "k")
    assert {f.name for f in (tmp_path / "by").iterdir() if f.is_dir()} == {"k=1", "k=2"}
    write_json(df, str(tmp_path / "j"))
    assert sorted((r.k, r.v) for r in spark.read.json(str(tmp_path / "j")).collect()) == [(1, "a"), (2, "b"), (2, "c")]
    (row,) = file_counts(spark, str(tmp_path / "p"), "k").collect()
    assert row.file.startswith("part-") and (row.n_rows, row.n_distinct) == (3, 2)
    assert [tuple(r) for r in read_head(spark, str(tmp_path / "p"), ["v"], 2, F.desc("v")).collect()] == [("c",), ("b",)]
    with pytest.raises(ValueError, match="missing columns: author"):
        conform(df.withColumnsRenamed({"k": "id", "v": "quote"}), SCHEMAS["quote"])


def test_tsv_newlines(spark, tmp_path):
    """Only a file with a newline inside quotes is read in one piece."""
    plain = "entity_id\tbusiness_name\tbusiness_address\tcountry\n1\ta \"\"b\"\"\t\"x \"\"y\"\" z\"\tc\n2\t\t\t\n"
    broken = plain + "3\t\"two\nlines\"\tq\tc\n"
    for text, many in ((plain, False), (broken, True)):
        (tmp_path / "t.tsv").write_text(text)
        assert spans_lines(spark, str(tmp_path / "t.tsv")) == many
        whole, guess = (read_tsv(spark, str(tmp_path / "t.tsv"), multi_line=m).collect() for m in (True, None))
        assert sorted(whole) == sorted(guess) and len(whole) == (3 if many else 2) and ("", "", "") in {tuple(r)[1:] for r in whole}
