import pytest
from pyspark.sql import functions as F
from tarnwork import Config
from tarnwork.functions import normalize as N
from tarnwork.functions import similarity as S
from tarnwork.operators import blocking, checks, evaluate, statelog
from tarnwork.operators.entities import normalize_entities
from tarnwork.sources.io import read_tsv, require_columns, write_tsv


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_normalization_values(spark):
    row = one(
        spark, N.normalize_name(F.lit("  Acme, Company Limited ")), N.normalize_country(F.lit("U.S.A.")), N.normalize_text(F.lit("Café")),
        N.normalize_text(F.lit("ﬁne")), N.normalize_text(F.lit(None).cast("string")),
    )
    assert tuple(row) == ("acme co ltd", "united states", "caf", "fine", "")


def test_short_name_keeps_prefix(spark):
    df = spark.createDataFrame([("1", "A", "x", "fr"), ("2", "--", "", "")], "entity_id string, business_name string, business_address string, country string")
    a, b = normalize_entities(df, "source1").orderBy("entity_id").collect()
    assert (a.name_norm, a.name_prefix, a.name_first_token, a.country_norm) == ("", "a", "a", "france")
    assert (b.name_norm, b.name_prefix, b.country_norm) == ("", "", "")


def test_match_lists(spark):
    texts = ["['a','b']", "[a, b]", "a,b", "", "[]", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", N.parse_match_list(F.col("t")).alias("m")).orderBy("i").collect()
    assert [r.m for r in rows] == [["a", "b"]] * 3 + [[]] * 3
    assert one(spark, N.format_match_list(F.array(F.lit("b"), F.lit("a"))), N.format_match_list(F.lit(None).cast("array<string>"))) == ("a,b", "[]")


def test_similarity(spark):
    a, b = F.lit("small ring"), F.lit("small thing")
    row = one(spark, S.lcs_length(a, b), S.indel_ratio(a, b), S.indel_ratio(a, F.lit("")), S.token_set_ratio(F.lit("x y"), F.lit("y x z")))
    assert row[0] == 9 and abs(row[1] - 18 / 21) < 1e-12 and row[2] == 0 and row[3] == 1
    assert S.ratio("small ring", "small thing") == 18 / 21
    assert S.weighted("abc", "abc") == 1 and S.weighted("", "a") == 0


def test_known_similarity_values():
    """Values as published for the usual library, divided by 100."""
    close = lambda x, y: abs(x - y) < 1e-9
    assert close(S.ratio("this is a test", "this is a test!"), 0.9655172413793103)
    assert close(S.partial("this is a test", "this is a test!"), 1.0)
    assert close(S.ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear"), 0.9090909090909091)
    assert close(S.token_sort("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear"), 1.0)
    assert close(S.token_sort("fuzzy was a bear", "fuzzy fuzzy was a bear"), 0.8421052631578947)
    assert close(S.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear"), 1.0)
    assert close(S.weighted("this is a test", "this is a new test!!!"), 0.855)
    assert close(S.weighted("this is a test", "this is a new test"), 0.95)
    assert S.weighted("abc", "abc") == 1 and S.weighted("", "a") == S.weighted(None, "a") == 0
    assert close(S.partial("abcd", "xxab"), max(S.ratio("abcd", w) for w in ("xxab", "xab", "ab", "b", "xxa", "xx", "x")))


def test_arrow_forms_agree_with_native_ones(spark):
    texts = ["", "a", "small ring", "ring small", "small thing", "ring", "a b c", "c b", "thing of beauty", "é à"]
    df = spark.createDataFrame([(x, y) for x in texts for y in texts], "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select(S.indel_ratio(a, b), S.indel_ratio_arrow(a, b), S.token_set_ratio(a, b), S.token_set_ratio_arrow(a, b)).collect()
    assert all(abs(r[0] - r[1]) < 1e-12 and abs(r[2] - r[3]) < 1e-12 for r in rows)


def test_quotas():
    assert Config().quotas == (30, 13, 7)


def _entities(spark, n_targets):
    rows = [("s", "source1", "acme", "", "x", "acme", "acme")] + [(f"t{i}", "source2", "acme", "", "x", "acme", "acme") for i in range(n_targets)]
    df = spark.createDataFrame(rows, "entity_id string, source string, name_norm string, address_norm string, country_norm string, name_prefix string, name_first_token string")
    return df.filter("source = 'source1'"), df.filter("source <> 'source1'")


def test_repeated_sources_and_shared_ids(spark):
    """The quota counts distinct pairs; a pair found by exact name is no rare pair, whatever its source."""
    a, b = _entities(spark, 40)
    out = blocking.candidates(a.unionByName(a), b).collect()
    assert len(out) == 40
    columns = "entity_id string, source string, name_norm string, address_norm string, country_norm string, name_prefix string, name_first_token string"
    one = spark.createDataFrame([("s", "source1", "zebra shop", "", "x", "zebr", "zebra")], columns)
    targets = [("7", "source2", "zebra shop", "", "x", "zebr", "zebra"), ("7", "source3", "zebra store", "", "x", "zebr", "zebra"), ("8", "source3", "zebra store", "", "x", "zebr", "zebra")]
    got = {(r.target_id, r.target_source, r.block_priority) for r in blocking.candidates(one, spark.createDataFrame(targets, columns)).collect()}
    assert got == {("7", "source2", 1), ("8", "source3", 2), ("7", "source3", 3)}
    names = spark.createDataFrame([("s", "source1", f"name{k}", "", "x", "name", f"name{k}") for k in (0, 1)], columns)
    both = spark.createDataFrame([(f"t{i}", "source2", f"name{k}", "", "x", "name", f"name{k}") for i in range(40) for k in (0, 1)], columns)
    assert len(blocking.candidates(names, both).collect()) == 40  # 80 rows, 40 pairs: within the cap
    wide = spark.createDataFrame([(f"t{i}-{k}", "source2", f"name{k}", "", "x", "name", f"name{k}") for i in range(40) for k in (0, 1)], columns)
    assert len(blocking.candidates(names, wide).collect()) == 30  # 80 pairs: over it


def test_seeds_keys_and_stamps(spark):
    none, seed = spark.createDataFrame([], "id long, name string"), spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert statelog.seeded(none, seed).count() == 2 and statelog.seeded(seed, seed.union(seed)).count() == 2
    assert sorted(map(tuple, statelog.appended(seed, spark.createDataFrame([("z",), ("y",)], "name string"), "id", "name").collect())) == [(1, "a"), (2, "b"), (3, "y"), (4, "z")]
    rows = statelog.stamped(spark.createDataFrame([(1, None), (2, "2020-01-01 00:00:00")], "id int, t string").withColumn("created_at", F.to_timestamp("t")), "created_at", "updated_at").orderBy("id").collect()
    assert rows[0].created_at is not None and rows[1].created_at.year == 2020 and rows[1].updated_at.year > 2020
    later = statelog.touched(spark.createDataFrame([(1,), (2,)], "id int").withColumn("updated_at", F.lit("2020-01-01").cast("timestamp")), F.col("id") == 2).orderBy("id").collect()
    assert later[0].updated_at.year == 2020 and later[1].updated_at.year > 2020


def test_uniqueness_and_foreign_keys(spark):
    wanted, known = spark.createDataFrame([("ann", "a@x"), ("bob", "b@x")], "username string, email string"), spark.createDataFrame([("bob", "a@x"), ("bob", "z")], "username string, email string")
    got = {r.username: r.errors for r in checks.taken(wanted, known, "username", "email").collect()}
    assert got == {"ann": ["email taken"], "bob": ["username taken"]}


def test_taken_by_earlier_requests(spark):
    """Requests are served in order; who is refused takes nothing; NULL is never taken."""
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice([None, *"abcdefgh"]), rng.choice([None, *"uvwxyz"])) for i in range(60)] + [(60 + i, f"n{i}", f"m{i - 1}") for i in range(3)]
    known = [("a", "q"), (None, "u")]
    us, es = {k[0] for k in known} - {None}, {k[1] for k in known} - {None}
    want = {}
    for i, u, e in rows:
        want[i] = [f"{n} taken" for n, v, used in (("u", u, us), ("e", e, es)) if v in used and v is not None]
        if not want[i]:
            us |= {u} - {None}
            es |= {e} - {None}
    got = checks.taken(spark.createDataFrame(rows, "i long, u string, e string"), spark.createDataFrame(known, "u string, e string"), "u", "e", order="i")
    assert got.columns == ["i", "u", "e", "errors"] and {r.i: r.errors for r in got.collect()} == want
    assert any(len(v) == 2 for v in want.values()) and sum(not v for v in want.values()) > 5


def test_stamps_are_instants(spark):
    """The same instant in every session time zone."""
    import datetime

    rows = spark.createDataFrame([(1,)], "id int")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tokyo", "America/Lima"):
            spark.conf.set("spark.sql.session.timeZone", z)
            seconds = statelog.touched(statelog.stamped(rows, "a"), F.lit(True), "a").select(F.unix_timestamp("a")).first()[0]
            assert abs(seconds - datetime.datetime.now().timestamp()) < 60
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    notes = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, user_id int")
    found = checks.constraint_violations(notes, references={"user_id": spark.createDataFrame([(5,), (5,)], "id int")}).collect()
    assert [tuple(r) for r in found] == [("foreign key user_id", 1)]


def test_landed_json(spark):
    from tarnwork.sources.io import landed_json

    lines = spark.createDataFrame([('{"q": "x", "a": "y"}',), ('{"q": "x"',), ('{"q": "x"}',), (None,), ("[]",)], "value string")
    assert [(r.q, r.a) for r in landed_json(lines, "q string, a string").collect()] == [("x", "y")] + [(None, None)] * 4


@pytest.mark.parametrize(("n", "kept"), [(50, 50), (51, 30), (19, 19)])
def test_exact_quota(spark, n, kept):
    out = blocking.candidates(*_entities(spark, n)).collect()
    assert len(out) == kept and {r.block_priority for r in out} == {1}


def test_recall_conventions(spark):
    pairs = spark.createDataFrame([("a", "b")], "source1_id string, target_id string")
    none = pairs.limit(0)
    assert evaluate.blocking_recall(none, pairs).first().recall == 0
    assert evaluate.blocking_recall(pairs, none).first().recall == 1
    assert evaluate.blocking_recall(pairs, pairs).first().recall == 1


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi"', "two\nlines", "")], "entity_id string, business_name string, business_address string, country string")
    write_tsv(df, str(tmp_path / "t"), single_file=True)
    assert [tuple(r) for r in read_tsv(spark, str(tmp_path / "t")).collect()] == [tuple(r) for r in df.collect()]
    with pytest.raises(ValueError, match="missing columns: x"):
        require_columns(df, ["x"])


def test_checks_and_keys(spark):
    assert one(spark, checks.note_errors(F.lit("ab"), F.lit(None).cast("string")))[0] == ["title too short", "content required"]
    keys = statelog.with_keys(spark.range(100).select((F.col("id") * 7 % 100).alias("v")), "id", "v").orderBy("v").collect()
    assert [r.id for r in keys] == list(range(1, 101))


def test_streaming_matches_batch(spark, tmp_path):
    from tarnwork import streaming

    votes = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "event_id long, item string")
    votes.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(votes.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        streaming.run_batches(stream, lambda b: b.groupBy("item").count(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.item, r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 5), ("b", 5)}


def test_streaming_folds(spark, tmp_path):
    """Running tallies, windows and latest states end at what the batch forms give."""
    from tarnwork import streaming

    rows = [(i, f"2024-01-01 {i % 3:02d}:{i % 60:02d}:00", "ab"[i % 2], i % 5, i % 4 != 0) for i in range(40)]
    log = spark.createDataFrame(rows, "event_id long, t string, item string, user_id long, available boolean").withColumn("ts", F.to_timestamp("t")).drop("t")
    for k in range(2):
        log.filter(F.col("event_id") % 2 == k).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def ends(df, mode, name):
        df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    assert {tuple(r) for r in ends(streaming.vote_tally(stream), "complete", "tallied").collect()} == {tuple(r) for r in statelog.tally(log).collect()}
    last = {tuple(r) for r in ends(streaming.latest_availability(stream), "complete", "states").collect()}
    assert last == {tuple(r) for r in statelog.latest(log, "user_id", "available", "ts", "event_id").collect()}
    windows = {(r.window.start, r.item): r.votes for r in ends(streaming.windowed_votes(stream, "1 hour", "1 day"), "complete", "windows").collect()}
    assert sum(windows.values()) == 40 and len(windows) == 6


def test_constraints_in_one_scan(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, None, "a"), (2, 7, None), (None, 7, None), (None, 8, "b")], "id int, owner int, t string")
    owners = spark.createDataFrame([(5,), (5,), (8,), (None,)], "key long")
    check = lambda t: checks.constraint_violations(t, ["id", "t"], ["id", "t"], {"owner": owners})
    want = {"not null id": 2, "not null t": 2, "unique id": 2, "unique t": 2, "foreign key owner": 2}
    assert dict(map(tuple, check(rows).collect())) == want
    assert dict(map(tuple, check(rows.limit(0)).collect())) == dict.fromkeys(want, 0)
    table = statelog.stored(rows, "constrained")
    plan = check(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("constrained-") == 1


def _scanned(plan):
    """Rows that the scans of an executed plan have read."""
    own = plan.metrics().get("numOutputRows").get().value() if "Scan" in plan.nodeName() else 0
    children = plan.children()
    return own + sum(_scanned(children.apply(i)) for i in range(children.size()))


def test_keyed_lookup_reads_one_bucket(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 10).alias("owner"), F.concat(F.lit("t"), "id").alias("t"))
    table = statelog.keyed(rows, "keyed_rows", "k", buckets=8)
    found = statelog.lookup(table, "k", 777, owner=("owner", 7))
    assert [tuple(r) for r in found.collect()] == [(777, 7, "t777")]
    asked = table.filter("k = 777")
    assert len(asked.collect()) == 1 and _scanned(asked._jdf.queryExecution().executedPlan()) < 20_000 / 8 * 1.2  # rows of one bucket
    absent = table.filter("k = 20001")
    assert absent.collect() == [] and _scanned(absent._jdf.queryExecution().executedPlan()) == 0  # by order and bloom filter
    assert statelog.lookup(table, "k", 777, owner=("owner", 3)).count() == statelog.lookup(table, "k", -1).count() == 0
    spark.sql("DROP TABLE keyed_rows")


def test_table_defaults(spark):
    import datetime

    table = statelog.with_defaults(spark, "with_defaults", "id BIGINT, name STRING DEFAULT 'none', made TIMESTAMP DEFAULT current_timestamp()")
    assert table.count() == 0
    statelog.insert(spark.createDataFrame([(1,), (2,)], "id long"), "with_defaults")
    statelog.insert(spark.createDataFrame([("x", 3)], "name string, id long"), "with_defaults")
    rows = {r.id: r for r in spark.table("with_defaults").collect()}
    assert [rows[i].name for i in (1, 2, 3)] == ["none", "none", "x"] and all(abs((r.made - datetime.datetime.now(r.made.tzinfo)).days) < 2 for r in rows.values())
    spark.sql("DROP TABLE with_defaults")


def test_sql_functions(spark):
    """The SQL functions give what the column functions give, also on NULL and on texts that need folding."""
    from tarnwork.functions import sql as Q

    Q.install(spark)
    texts = ["  Acme, Company Limited ", "U.S.A.", "Caf\u00e9 \ufb01ne", None, "", "12 Main Street", "DE"]
    name = Q.relation(spark.createDataFrame([(t,) for t in texts], "x string"), "some_texts")
    got = spark.sql(f"SELECT x, norm_text(x) AS t, norm_name(x) AS n, norm_address(x) AS a, norm_country(x) AS c FROM {name}").collect()
    want = spark.table(name).select("x", N.normalize_text(F.col("x")).alias("t"), N.normalize_name(F.col("x")).alias("n"), N.normalize_address(F.col("x")).alias("a"), N.normalize_country(F.col("x")).alias("c")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sorted(r[0] for r in spark.sql("SELECT token FROM name_tokens('acme ltd blue acme x', 4)").collect()) == ["acme", "blue"]


def test_whole_exact_buckets_are_dealt_out(spark):
    """A bucket of 60 x 60 pairs goes to many tasks of at most 100 pairs and a few; pairs and repeated rows are those of the plain join."""
    side = lambda n, source: spark.range(n).selectExpr("CAST(id AS STRING) AS entity_id", f"'{source}' AS source", "IF(id < 60, 'hot', 'n' || id % 9) AS name_norm", "'X' AS country_norm")
    a, b = side(90, "source1"), side(80, "source2")
    a, targets = a.union(a.filter("entity_id = '7'")), b.unionByName(b.limit(0))
    exact = blocking.bucket(targets, "name_norm", None)
    out = blocking.exact_block_whole(a, exact, 100)
    assert sorted(out.collect()) == sorted(blocking.exact_block(a, exact).collect())
    sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) > 15 and max(sizes) < 1000
    assert blocking.exact_block_whole(a.limit(0), exact).count() == 0


def test_tasks_by_source_stay_bounded(spark):
    """More sources make more partitions, not larger ones."""
    rows = lambda n: spark.range(n).selectExpr("CAST(id AS STRING) AS entity_id")
    assert blocking.parts(rows(0)) == 1 and blocking.parts(rows(900)) == 2 and blocking.parts(rows(300_001)) == 61


def test_features_without_the_weighted_ratio(spark):
    """pair_features computes its ratios in Arrow: no fold over characters in the plan, the same values."""
    from tarnwork.operators import pairs as P

    texts = [("red bolt", "red bolt"), ("red bolt", "bolt red x"), ("", "a"), ("kitten", "sitting"), ("a b c", "c d"), ("x" * 70, "x" * 69 + "y")]
    row = lambda s: {f"{f}_norm_{s}": "" for f in ("name", "address", "country")}
    df = spark.createDataFrame([{**row("a"), **row("b"), "name_norm_a": x, "name_norm_b": y, "address_norm_a": y, "address_norm_b": x} for x, y in texts])
    new, old = P.features(df, arrow=True, weighted=False), P.features(df, weighted=False)
    assert new.columns == old.columns and "wratio" not in str(new.columns)
    for r, q in zip(sorted(new.collect()), sorted(old.collect())):
        assert [round(v, 9) if isinstance(v, float) else v for v in r] == [round(v, 9) if isinstance(v, float) else v for v in q]
    from tarnwork.plans import QUERIES

    assert "two_ratios" in QUERIES["pair_features"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
