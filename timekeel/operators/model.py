"""Quantile models of the delay at the target: a cell table, and boosted trees.

Only facts known at the vantage are features. The observed-stop horizon is an axis of the
reports and never an input.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, ImputerModel, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times, values
from ..session import settle

# Fixed values.
NUMERIC = (
    "current_delay_sec", "prev_delay_sec", "prev2_delay_sec", "horizon_route_stops",
    "horizon_sched_sec", "vantage_hour", "vantage_minute_of_day",
)
CATEGORICAL = ("day_of_week", "vantage_location", "target_location", "train_origin", "train_destination")
QUANTILES = (0.1, 0.5, 0.9)
ROUNDS, RATE, DEPTH, MIN_LEAF = 100, 0.1, 5, 20
LABEL = "target_delay_sec"
#: Stands for a category that is not known.
MISSING = "(missing)"


def categorical(df: DataFrame) -> list[str]:
    return [c for c in CATEGORICAL if c in df.columns]


# ---- cells: percentiles of the change since the vantage

def fit_cells(ex: DataFrame, min_rows: int = 50) -> DataFrame:
    """Percentiles of (label - current delay) per (target, band), per band, and overall, in
    one grouping-sets pass; thin cells are left to the next level."""
    d = ex.select("target_location", times.band("horizon_sched_sec").alias("band"), (F.col(LABEL) - F.col("current_delay_sec")).alias("d"))
    out = d.groupingSets([["target_location", "band"], ["band"], []], "target_location", "band").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"),
        *[F.percentile("d", q).alias(f"d{int(q * 100)}") for q in QUANTILES])
    return out.where((F.col("n") >= min_rows) | (F.col("level") == 3))


def apply_cells(ex: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds q10, q50, q90 from the narrowest level that has the cell."""
    qs = [int(q * 100) for q in QUANTILES]

    def level(n: int, keys: list[str], tag: str) -> DataFrame:
        return cells.where(F.col("level") == n).select(
            *[F.col(k).alias(f"_{k}") for k in keys], *[F.col(f"d{q}").alias(f"_{tag}{q}") for q in qs])

    keyed = ex.withColumns({"_band": times.band("horizon_sched_sec"), "_target_location": F.col("target_location")})
    overall = level(3, [], "o")
    out = keyed.join(level(0, ["target_location", "band"], "c"), ["_target_location", "_band"], "left").join(level(2, ["band"], "b"), ["_band"], "left")
    return out.withColumns({
        f"q{q}": F.col("current_delay_sec") + F.coalesce(f"_c{q}", f"_b{q}", overall.select(f"_o{q}").scalar()) for q in qs
    }).select(*ex.columns, *[f"q{q}" for q in qs])


# ---- boosted trees

def encoder(df: DataFrame) -> Pipeline:
    """Categories by training vocabulary, in which missing is a category of its own and unseen
    ones get an extra index; numbers with a missing flag each."""
    cats = categorical(df)
    filled = [f"{c}_f" for c in NUMERIC]
    return Pipeline(stages=[
        StringIndexer(inputCols=[f"{c}_c" for c in cats], outputCols=[f"{c}_i" for c in cats], handleInvalid="keep", stringOrderType="alphabetAsc"),
        Imputer(inputCols=[f"{c}_d" for c in NUMERIC], outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=[*filled, *[f"{c}_m" for c in NUMERIC], *[f"{c}_i" for c in cats]], outputCol="features"),
    ])


def numbers(df: DataFrame) -> DataFrame:
    return df.withColumns({
        **{f"{c}_d": F.col(c).cast("double") for c in NUMERIC},
        **{f"{c}_m": F.col(c).isNull().cast("double") for c in NUMERIC},
        **{f"{c}_c": F.coalesce(F.col(c), F.lit(MISSING)) for c in categorical(df)},
    })


def fit_encoder(df: DataFrame) -> PipelineModel:
    """The encoder of numbered training rows. A row without any value joins them, so missing
    has its index even if no category is missing in training; medians pass over it."""
    none = df.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields))
    return encoder(df).fit(df.unionByName(numbers(none.select(*(c for c in df.columns if not c.endswith(("_d", "_m", "_c"))))).select(*df.columns)))


@dataclass
class Boosted:
    """One quantile's model: a start value, and per round a tree and a value per leaf."""

    quantile: float
    start: float
    rate: float
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)
    leaves: list[dict[int, float]] = field(default_factory=list)

    def _step(self, df: DataFrame, tree, leaf: dict[int, float], out: str, base: Column) -> DataFrame:
        table = F.create_map(*[F.lit(x) for pair in leaf.items() for x in pair])
        moved = tree.transform(df)
        return moved.withColumn(out, base + self.rate * F.coalesce(table[F.col("_leaf").cast("int")], F.lit(0.0))).drop("_leaf", "_p")

    def predict(self, encoded: DataFrame, out: str) -> DataFrame:
        df = encoded.withColumn(out, F.lit(self.start))
        for tree, leaf in zip(self.trees, self.leaves):
            df = self._step(df, tree, leaf, out, F.col(out))
        return df


def bins_for(encoded: DataFrame, least: int = 64) -> int:
    """Bins that the trees need: one at least for each value of the largest vocabulary."""
    attrs = encoded.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    return max([least, *(len(a.get("vals", ())) + 1 for a in attrs.get("nominal", ()))])


def fit_boosted(encoded: DataFrame, q: float, rounds: int = ROUNDS, rate: float = RATE, depth: int = DEPTH,
                min_leaf: int = MIN_LEAF, seed: int = 42) -> Boosted:
    """Gradient boosting of the pinball loss.

    Each round fits a tree to the loss's gradient, then sets each leaf to the q-percentile
    of the residuals that fall in it. Only leaf values, at most 2**depth numbers, come back
    to the driver. The running prediction is written every round, so a round's plan never
    contains the rounds before it.
    """
    start = float(encoded.agg(F.percentile(LABEL, q)).first()[0])
    bins = bins_for(encoded)
    m = Boosted(q, start, rate)
    state = settle(encoded.select("features", F.col(LABEL).cast("double").alias("y"), F.lit(start).alias("f")), "boost")
    for r in range(rounds):
        graded = state.withColumn("g", F.when(F.col("y") >= F.col("f"), q).otherwise(q - 1))
        tree = DecisionTreeRegressor(
            labelCol="g", featuresCol="features", predictionCol="_p", leafCol="_leaf", maxDepth=depth,
            minInstancesPerNode=min_leaf, maxBins=bins, seed=seed + r).fit(graded)
        placed = tree.transform(state)
        rows = placed.groupBy(F.col("_leaf").cast("int").alias("leaf")).agg(F.percentile(F.col("y") - F.col("f"), q).alias("v")).collect()
        leaf = {int(x["leaf"]): float(x["v"]) for x in rows}
        m.trees.append(tree)
        m.leaves.append(leaf)
        state = settle(m._step(state, tree, leaf, "f", F.col("f")), "boost")
    return m


def predict_all(encoded: DataFrame, models: list[Boosted]) -> DataFrame:
    """q10, q50, q90 after rearrangement, and whether they crossed before it."""
    df = encoded
    for m in models:
        df = m.predict(df, f"_q{int(m.quantile * 100)}")
    a, b, c = (F.col(f"_q{int(q * 100)}") for q in QUANTILES)
    fixed = values.rearranged(a, b, c)
    return df.withColumns({
        "crossed": values.crosses(a, b, c), "q10": fixed[0], "q50": fixed[1], "q90": fixed[2],
    }).drop("_q10", "_q50", "_q90")


def importance(encoded: DataFrame, m: Boosted) -> dict[str, float]:
    """Share of total gain per feature, from the encoder's vector attributes."""
    attrs = encoded.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    total: dict[str, float] = {}
    for tree in m.trees:
        for i, g in zip(tree.featureImportances.indices, tree.featureImportances.values):
            base = names[int(i)].rsplit("_", 1)[0]
            total[base] = total.get(base, 0.0) + float(g)
    whole = sum(total.values()) or 1.0
    return {k: v / whole for k, v in sorted(total.items(), key=lambda kv: -kv[1])}


def _digest(features: list[str], enc: PipelineModel, models: list[Boosted]) -> str:
    """Over everything that a prediction depends on: vocabularies, medians, trees, leaf values."""
    labels = [list(map(list, s.labelsArray)) for s in enc.stages if isinstance(s, StringIndexerModel)]
    medians = [list(map(str, s.surrogateDF.first())) for s in enc.stages if isinstance(s, ImputerModel)]
    text = json.dumps([features, labels, medians, [[m.quantile, m.start, m.rate, [t.toDebugString for t in m.trees], [sorted(leaf.items()) for leaf in m.leaves]] for m in models]])
    return hashlib.sha256(text.encode()).hexdigest()


def save(spark: SparkSession, path: str, version: str, enc: PipelineModel, models: list[Boosted], features: list[str],
         metrics: dict) -> None:
    """A versioned artifact; the pointer to the latest is written last."""
    root = f"{path}/{version}"
    enc.write().overwrite().save(f"{root}/encoder")
    for m in models:
        for i, tree in enumerate(m.trees):
            tree.write().overwrite().save(f"{root}/q{int(m.quantile * 100)}/tree{i}")
    manifest = {
        "version": version, "features": features, "digest": _digest(features, enc, models), "metrics": metrics,
        "models": [{"quantile": m.quantile, "start": m.start, "rate": m.rate,
                    "leaves": [sorted(leaf.items()) for leaf in m.leaves]} for m in models],
    }
    _put(spark, f"{root}/manifest", json.dumps(manifest))
    _put(spark, f"{path}/LATEST", version)


def load(spark: SparkSession, path: str, features: list[str], version: str | None = None):
    """Encoder and models of a version, refused when its features or its digest differ."""
    version = version or spark.read.text(f"{path}/LATEST").first()[0]
    root = f"{path}/{version}"
    manifest = json.loads(spark.read.text(f"{root}/manifest", wholetext=True).first()[0])
    if manifest["features"] != list(features):
        raise ValueError(f"{version} was trained on other features: {manifest['features']}")
    models = []
    for m in manifest["models"]:
        trees = [DecisionTreeRegressionModel.load(f"{root}/q{int(m['quantile'] * 100)}/tree{i}") for i in range(len(m["leaves"]))]
        models.append(Boosted(m["quantile"], m["start"], m["rate"], trees, [{int(k): v for k, v in leaf} for leaf in m["leaves"]]))
    enc = PipelineModel.load(f"{root}/encoder")
    if _digest(list(features), enc, models) != manifest["digest"]:
        raise ValueError(f"{version} does not match its manifest")
    return enc, models, manifest


def _put(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def same_predictions(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
