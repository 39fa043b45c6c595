"""The training job: examples to fitted, saved, reloaded and compared quantile models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import journeys, metrics, model
from ..session import settle


class ArtifactDiffers(Exception):
    """The models read back give other predictions than those that were fitted."""


def train(spark: SparkSession, ex: DataFrame, ranges: dict[str, tuple[str, str]], path: str, version: str,
          fitted_on: str = "train", judged_on: str = "test", rounds: int = model.ROUNDS, rate: float = model.RATE, depth: int = model.DEPTH) -> DataFrame:
    """Split machine-captured examples by date, fit the quantiles, save them, read them back,
    and report the errors of median and persistence and the losses of the quantiles."""
    split = journeys.trusted(ex).withColumn("split", times.split_of("service_date", ranges, ()))
    fit_rows = settle(model.numbers(split.where(F.col("split") == fitted_on)), "fit")
    eval_rows = settle(model.numbers(split.where(F.col("split") == judged_on)), "judge")
    enc = model.fit_encoder(fit_rows)
    encoded = settle(enc.transform(fit_rows).select("features", model.LABEL), "encoded")
    models = [model.fit_boosted(encoded, q, rounds=rounds, rate=rate, depth=depth) for q in model.QUANTILES]
    names = [*model.NUMERIC, *model.categorical(fit_rows)]
    model.save(spark, path, version, enc, models, names, {})
    enc2, again, _ = model.load(spark, path, names)
    first = settle(model.predict_all(enc.transform(eval_rows), models), "first")
    second = model.predict_all(enc2.transform(eval_rows), again)
    keys = ["service_date", "train_code", "vantage_order", "target_order"]
    cols = [*keys, "q10", "q50", "q90"]
    if not first.select(*cols).exceptAll(second.select(*cols)).isEmpty():
        raise ArtifactDiffers(version)
    losses = first.agg(*[F.avg(metrics.pinball(model.LABEL, f"q{int(q * 100)}", q)).alias(f"loss{int(q * 100)}") for q in model.QUANTILES])
    report = metrics.predictor_report(first, {"model": F.col("q50"), "persistence": F.col("current_delay_sec")}, [])
    return report.withColumns({c: losses.select(c).scalar() for c in losses.columns})
