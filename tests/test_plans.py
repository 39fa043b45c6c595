"""The jobs end to end on the smallest tables, and the shape of the main plan."""


from pyspark.sql import functions as F

from timekeel import views
from timekeel.operators import journeys
from timekeel.plans import nightly, offline
from timekeel.session import scratch_path


def test_examples_cost_one_shuffle(spark, small):
    moves, t = views.movements(spark, small)
    prep = journeys.prepared(moves, t)
    ex = journeys.examples(journeys.observed(prep.where("consistent"), t), t)
    plan = ex._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_filter_and_columns_reach_the_scan(spark, small):
    from timekeel.queries.storage import archive
    from timekeel.sources import logs
    path, _ = archive(spark, small)
    df = logs.read_archive(spark, path, ["train_code", "delay_sec"], (F.col("date") == "2024-01-13") & (F.col("station_group") == "view"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(station_group,view)" in plan and "PartitionFilters: [isnotnull(date" in plan
    assert "ReadSchema: struct<train_code:string,station_group:string,delay_sec:int>" in plan


def test_nightly_scores_once_and_derives(spark, small):
    moves, t = views.movements(spark, small)
    preds, polls = views.predictions(moves, t), views.polls(moves)
    out, derived = scratch_path(spark, "scores"), scratch_path(spark, "derived")
    now = F.lit("2024-01-26 12:00:00").cast("timestamp")
    dates = nightly.missing_dates(preds, out, now, back=40)
    assert {str(r[0]) for r in dates.collect()} == {"2024-01-01", "2024-01-07", "2024-01-13", "2024-01-19", "2024-01-25"}
    nightly.score_dates(preds, moves, polls, dates, out)
    back = spark.read.json(out)
    assert back.count() == preds.select("service_date", "train_code", "location_code", F.col("lead_sec") < 900).distinct().count()
    schema = "service_date date, score_state string, station_group string, lead_band string, model_err_sec bigint, model_err_rounded_sec bigint, rival_err_sec bigint, interval_hit boolean, raw_interval_hit boolean, actual_delay_sec int, q10_sec int, q90_sec int"
    nightly.derive(spark, out, schema, derived)
    assert spark.read.parquet(f"{derived}/days").count() == 5
    assert spark.read.parquet(f"{derived}/rolling").where("scope = 'overall'").count() == 1


def test_offline_job(spark, small):
    from timekeel.queries.storage import written_feed
    from timekeel.sources import feeds
    parsed, ex = scratch_path(spark, "parsed"), scratch_path(spark, "ex")
    raw = written_feed(spark, small)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(raw).count()
    assert files > 0
    rows = feeds.parse_movements(feeds.read_movements(spark, raw))
    offline.cut_examples(feeds.as_stops(rows), ex, {"train": ("2024-01-01", "2024-01-31")})
    got = spark.read.parquet(ex)
    assert got.count() > 0 and got.select("split").distinct().count() == 1
    report = offline.baseline(got).where("scope = 'overall'")
    assert {r["predictor"] for r in report.collect()} == {"zero", "persistence"}
