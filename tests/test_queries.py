"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small, name):
    _, _, verdict = compare(spark, con, QUERIES[name], ORACLES.get(name), small)
    assert not verdict, verdict


LONG = ("baseline_report_a16", "missing_reason_p9", "predictions_view", "predict_or_decline_m7", "vantage_strict_any_order_j3",
        "calling_pattern_m9_p15", "link_counts_a25", "scenario_days_a27", "score_states_m8")


@pytest.mark.parametrize("name", LONG)
def test_query_with_every_journey_treated_as_long(spark, con, small, name):
    spark.conf.set("timekeel.maxGroupRows", "5")
    try:
        _, _, verdict = compare(spark, con, QUERIES[name], ORACLES[name], small)
    finally:
        spark.conf.unset("timekeel.maxGroupRows")
    assert not verdict, verdict
