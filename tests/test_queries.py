import pytest
from tarnwork.operators import statelog
from tarnwork.plans import ORACLE, QUERIES
from tarnwork.plans.queries import n_batches

from tests.conftest import SF
from tests.oracle import compare


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_matches_sql(spark, name):
    compare(QUERIES[name](spark, SF), ORACLE[name], SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE and n not in ("linkage_run", "quick_eval", "train_and_score")])
def test_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    if name.startswith("train_and_score"):
        good = [r.probability for r in rows if r.label == 1]
        bad = [r.probability for r in rows if r.label == 0]
        assert sum(good) / len(good) > sum(bad) / len(bad) + 0.3


def test_missing_batches_beyond_the_third(spark):
    """Batches are counted from the ids: gaps after batch 2 are reported too."""
    sources = spark.range(0, 20_001, 4).selectExpr("CAST(id AS STRING) AS entity_id")
    written = sources.selectExpr("CAST(floor(CAST(entity_id AS BIGINT) / 1000) AS BIGINT) AS batch_id").filter("batch_id % 3 <> 1")
    assert n_batches(sources) == 21 and n_batches(sources.limit(0)) == 0
    assert sorted(r[0] for r in statelog.missing_batches(written, n_batches(sources)).collect()) == [1, 4, 7, 10, 13, 16, 19]


def test_checkpoint_counts_cover_all_candidates(spark):
    rows = QUERIES["checkpoint_counts"](spark, SF).collect()
    assert {r.batch_id for r in rows} >= {0, 1} and sum(r.n_rows for r in rows) == QUERIES["block_final"](spark, SF).count()


@pytest.mark.parametrize("name", ["cheap_prefilter", "top_predictions", "training_sample", "validation_sample"])
def test_production_caps_keep_more(spark, name):
    assert QUERIES[name](spark, SF).count() > QUERIES[f"{name}_small_caps"](spark, SF).count()


def test_whole_texts(spark):
    """No query works on a prefix."""
    read = lambda name: QUERIES[name](spark, SF).collect()
    docs = read("normalize_docs")
    assert max(len(r.name_norm) for r in docs) > 260 and max(len(r.address_norm) for r in docs) > 260
    assert max(len(r.title) for r in read("duplicate_keys")) > 20
    assert any("title too long" in r.errors for r in read("validate_notes"))
    assert max(len(r.title) for r in read("notes_live")) > 100
