"""Quantile models over the examples: cells with an SQL check, boosted trees without one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import journeys, metrics, model
from ..session import scratch_path, settle
from .journeys import examples
from .oracle_views import VIEWS, band_sql
from .registry import fixed_sql, query, shown

VIEWS["trusted_ex"] = f"SELECT *, {band_sql('horizon_sched_sec')} AS band, target_delay_sec - current_delay_sec AS d FROM examples WHERE auto_vantage = '1' AND auto_target = '1'"
VIEWS["train_ex"] = "SELECT * FROM trusted_ex WHERE service_date < DATE '2024-01-20'"
VIEWS["eval_ex"] = "SELECT * FROM trusted_ex WHERE service_date >= DATE '2024-01-20'"


def _level(keys: str, n: int) -> str:
    cols = {0: "target_location, band", 2: "NULL AS target_location, band", 3: "NULL AS target_location, NULL AS band"}[n]
    return f"""SELECT {cols}, CAST({n} AS BIGINT) AS level, count(*) AS n, quantile_cont(d, 0.1) AS d10, quantile_cont(d, 0.5) AS d50, quantile_cont(d, 0.9) AS d90
      FROM train_ex {'GROUP BY ' + keys if keys else ''}"""


VIEWS["cell_model"] = f"SELECT * FROM ({_level('target_location, band', 0)} UNION ALL {_level('band', 2)} UNION ALL {_level('', 3)}) WHERE n >= 50 OR level = 3"
VIEWS["cell_pred"] = """
  SELECT e.*, current_delay_sec + coalesce(c.d10, b.d10, o.d10) AS q10, current_delay_sec + coalesce(c.d50, b.d50, o.d50) AS q50, current_delay_sec + coalesce(c.d90, b.d90, o.d90) AS q90
  FROM eval_ex e LEFT JOIN (SELECT * FROM cell_model WHERE level = 0) c ON c.target_location = e.target_location AND c.band = e.band
  LEFT JOIN (SELECT * FROM cell_model WHERE level = 2) b ON b.band = e.band CROSS JOIN (SELECT * FROM cell_model WHERE level = 3) o"""


def halves(spark, sf):
    ex = journeys.trusted(examples(spark, sf))
    return ex.where("service_date < DATE '2024-01-20'"), ex.where("service_date >= DATE '2024-01-20'")


@query("cell_quantiles_m3", f"""
SELECT target_location, band, level, n, {fixed_sql('d10')} AS d10, {fixed_sql('d50')} AS d50, {fixed_sql('d90')} AS d90 FROM cell_model""")
def cell_quantiles(spark, sf):
    return shown(model.fit_cells(halves(spark, sf)[0]))


def cell_predictions(spark, sf):
    tr, ev = halves(spark, sf)
    return model.apply_cells(ev, model.fit_cells(tr))


@query("model_against_persistence_a17", f"""
SELECT predictor, scope, key, count(*) AS n, {fixed_sql('avg(abs(err))')} AS mae_sec, {fixed_sql('quantile_cont(abs(err), 0.5)')} AS medae_sec, {fixed_sql('avg(err)')} AS bias_sec
FROM (SELECT p.predictor, CASE WHEN p.predictor = 'model' THEN q50 ELSE current_delay_sec END - target_delay_sec AS err, s.scope,
             CASE s.scope WHEN 'overall' THEN '' WHEN 'horizon' THEN CAST(horizon_observed_stops AS VARCHAR) ELSE band END AS key
      FROM cell_pred CROSS JOIN (VALUES ('model'), ('persistence')) AS p(predictor) CROSS JOIN (VALUES ('overall'), ('horizon'), ('band')) AS s(scope))
WHERE key IS NOT NULL GROUP BY 1, 2, 3""")
def model_against_persistence(spark, sf):
    p = cell_predictions(spark, sf).withColumns({
        "horizon": F.col("horizon_observed_stops").cast("string"), "band": times.band("horizon_sched_sec")})
    return shown(metrics.predictor_report(p, {"model": F.col("q50"), "persistence": F.col("current_delay_sec")}, ["horizon", "band"]))


@query("interval_report_a18", f"""
SELECT scope, key, count(*) AS n, {fixed_sql('100 * avg(CAST(target_delay_sec BETWEEN q10 AND q90 AS INT))')} AS coverage_pct,
       {fixed_sql('quantile_cont(q90 - q10, 0.5)')} AS median_width_sec, {fixed_sql('100 * avg(CAST(target_delay_sec < q10 AS INT))')} AS below_pct,
       {fixed_sql('100 * avg(CAST(target_delay_sec > q90 AS INT))')} AS above_pct
FROM (SELECT *, CASE s.scope WHEN 'overall' THEN '' ELSE CAST(horizon_observed_stops AS VARCHAR) END AS key FROM cell_pred CROSS JOIN (VALUES ('overall'), ('horizon')) AS s(scope)) GROUP BY 1, 2""")
def interval_report(spark, sf):
    p = cell_predictions(spark, sf).withColumn("horizon", F.col("horizon_observed_stops").cast("string"))
    return shown(metrics.interval_report(p, ["horizon"], "target_delay_sec", "q10", "q90"))


@query("pinball_loss_m3", f"""
SELECT {fixed_sql('avg(greatest(0.1 * (y - q10), -0.9 * (y - q10)))')} AS loss10, {fixed_sql('avg(greatest(0.5 * (y - q50), -0.5 * (y - q50)))')} AS loss50,
       {fixed_sql('avg(greatest(0.9 * (y - q90), -0.1 * (y - q90)))')} AS loss90 FROM (SELECT *, target_delay_sec AS y FROM cell_pred)""")
def pinball_loss(spark, sf):
    p = cell_predictions(spark, sf)
    return shown(p.agg(*[F.avg(metrics.pinball("target_delay_sec", f"q{int(q * 100)}", q)).alias(f"loss{int(q * 100)}") for q in model.QUANTILES]))


@query("category_vocabulary_m2", """
SELECT location, CAST(CASE WHEN known THEN rn ELSE (SELECT count(DISTINCT target_location) FROM train_ex) + 1 END AS DOUBLE) AS idx FROM (
  SELECT location, true AS known, row_number() OVER (ORDER BY location) AS rn FROM (SELECT DISTINCT target_location AS location FROM train_ex)
  UNION ALL SELECT 'never seen', false, 0) UNION ALL SELECT NULL, 0""")
def category_vocabulary(spark, sf):
    """Each category's index, that of one never seen, and that of a missing one."""
    tr, _ = halves(spark, sf)
    tr = model.numbers(tr)
    fitted = model.fit_encoder(tr)
    every = tr.select("target_location").distinct()
    rest = spark.createDataFrame([("never seen",), (None,)], "target_location string")
    asked = every.unionByName(rest)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in tr.schema.fields if f.name != "target_location" and not f.name.endswith(("_d", "_m", "_c"))]
    asked = model.numbers(asked.select("target_location", *blank))
    return fitted.transform(asked).select(F.col("target_location").alias("location"), F.col("target_location_i").alias("idx"))


ROUNDS, DEPTH = 3, 4


def boosted(spark, sf, quantiles=(0.5,)):
    tr, ev = halves(spark, sf)
    tr, ev = settle(model.numbers(tr), "train"), settle(model.numbers(ev), "eval")
    enc = model.fit_encoder(tr)
    encoded = settle(enc.transform(tr).select("features", model.LABEL), "encoded")
    models = [model.fit_boosted(encoded, q, rounds=ROUNDS, rate=0.3, depth=DEPTH) for q in quantiles]
    return enc, models, enc.transform(ev), enc.transform(tr)


@query("boosted_quantiles_m3_p24", """
SELECT count(*) AS n, 0 AS crossed_after, true AS better10, true AS better50, true AS better90 FROM train_ex""")
def boosted_quantiles(spark, sf):
    """Over the rows of the fit: crossings left after ordering, and whether each quantile's loss is below that of its start value."""
    _, models, _, tr = boosted(spark, sf, model.QUANTILES)
    p = model.predict_all(tr, models)
    aggs = [F.count(F.lit(1)).alias("n"),
            F.count_if((F.col("q10") > F.col("q50")) | (F.col("q50") > F.col("q90"))).alias("crossed_after")]
    for m in models:
        k = int(m.quantile * 100)
        fitted, started = metrics.pinball(model.LABEL, f"q{k}", m.quantile), metrics.pinball(F.col(model.LABEL), F.lit(m.start), m.quantile)
        aggs.append((F.avg(fitted) < F.avg(started)).alias(f"better{k}"))
    return p.agg(*aggs)


@query("gain_importance_m5", """
SELECT feature, true AS within, 1.0::DOUBLE AS all_shares FROM (VALUES ('current_delay_sec'), ('prev_delay_sec'), ('prev2_delay_sec'), ('horizon_route_stops'), ('horizon_sched_sec'),
  ('vantage_hour'), ('vantage_minute_of_day'), ('day_of_week'), ('vantage_location'), ('target_location')) AS v(feature) WHERE (SELECT count(*) FROM train_ex) > 0""")
def gain_importance(spark, sf):
    """Every feature, whether its share of the gain is between 0 and 1, and the sum of all shares."""
    _, models, _, tr = boosted(spark, sf)
    share = model.importance(tr, models[0])
    names = [*model.NUMERIC, *model.categorical(tr)]
    rows = [(k, float(share.get(k, 0.0))) for k in names]
    whole = round(sum(v for _, v in rows), 6)
    return spark.createDataFrame([(k, 0 <= v <= 1, whole) for k, v in rows], "feature string, within boolean, all_shares double")


@query("artifact_round_trip_m4_m6", "SELECT 'rows' AS part, count(*) AS n FROM eval_ex UNION ALL SELECT 'differ', 0")
def artifact_round_trip(spark, sf):
    """Saved, loaded and applied again: rows that differ from the first predictions."""
    enc, models, ev, _ = boosted(spark, sf)
    path = scratch_path(spark, "models")
    features = [*model.NUMERIC, *model.CATEGORICAL]
    model.save(spark, path, "v1", enc, models, features, {})
    enc2, again, _ = model.load(spark, path, features)
    keys = ["service_date", "train_code", "vantage_order", "target_order"]
    first = settle(models[0].predict(ev, "q50").select(*keys, "q50"), "first")
    raw = ev.drop(*[c for c in ev.columns if c.endswith(("_i", "_f")) or c == "features"])
    second = settle(again[0].predict(enc2.transform(raw), "q50").select(*keys, "q50"), "second")
    n = F.count(F.lit(1)).alias("n")
    return first.agg(n).select(F.lit("rows").alias("part"), "n").unionByName(
        first.exceptAll(second).unionByName(second.exceptAll(first)).agg(n).select(F.lit("differ").alias("part"), "n"))
