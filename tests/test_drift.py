"""The bootstrap and the promotion gate against plain resampling."""

import datetime as dt
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from timekeel.operators import drift

SCHEMA = "g string, unit int, d double"


def resampled(d, reps, seed):
    n, means = len(d), []
    for r in range(reps):
        picks = [int(hashlib.md5(f"{seed}|{r}|{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]
        means.append(sum(d[p] for p in picks) / n)
    return np.mean(d), *np.percentile(means, [2.5, 97.5])


def test_bootstrap_equals_plain_resampling_and_shuffles_once(spark):
    rng = random.Random(1)
    groups = {"a": 1, "b": 7, "c": 40, None: 7}
    rows = [(g, i, rng.uniform(-50, 40)) for g, n in groups.items() for i in range(n)] + [("b", 99, None), ("empty", 1, None)]
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), SCHEMA)
    out = drift.bootstrap(df, "d", 300, seed=5, by=("g",))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = {r["g"]: r for r in out.collect()}
    assert set(got) == set(groups)
    for g, n in groups.items():
        point, lo, hi = resampled([d for k, _, d in rows if k == g and d is not None], 300, 5)
        assert np.allclose([got[g]["point"], got[g]["lo"], got[g]["hi"]], [point, lo, hi], atol=1e-9) and got[g]["n_units"] == n
        assert got[g]["significant"] == (hi < 0)


def test_many_units_go_by_blocks_with_the_same_draws(spark):
    rng = random.Random(3)
    d = [rng.uniform(-1, 1) for _ in range(2500)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(d)], SCHEMA)
    got = drift.bootstrap(df, "d", 2000).first()
    draws = np.array([[int.from_bytes(hashlib.md5(f"0|{r}|{i}".encode()).digest()[:4]) % 2500 for i in range(2500)] for r in range(40)])
    some = np.array(d)[draws].mean(axis=1)
    assert got["n_units"] == 2500 and got["lo"] - 0.02 < some.min() and some.max() < got["hi"] + 0.02


def test_gate_on_error_and_coverage_overall_and_by_group(spark):
    rng = random.Random(4)
    rows = []
    for day in range(20):
        for g, n, worse in (("big", 80, 0.0), ("small", 10, 30.0), (None, 5, 0.0)):
            for _ in range(n):
                err = rng.uniform(0, 100)
                rows.append((g, dt.date(2024, 1, 1 + day), err, err - 5 + worse + rng.uniform(-1, 1), True, g != "big" or rng.random() > 0.3))
    df = spark.createDataFrame(rows, "station_group string, day date, a double, b double, hit_a boolean, hit_b boolean")
    out = drift.promotion_gate(df, "station_group", F.col("a"), F.col("b"), "day", reps=500, hits=(F.col("hit_a"), F.col("hit_b")))
    got = {(r["metric"], r["station_group"]): r for r in out.collect()}
    assert len(got) == 8 and {r["n_units"] for r in got.values()} == {20}
    assert not got["error", "big"]["worse"] and got["error", "small"]["worse"] and not got["error", "small"]["veto"]
    assert got["coverage", "big"]["veto"] and got["coverage", None]["veto"] and not got["coverage", "small"]["worse"]
    assert got["error", None]["can_veto"] and got["error", None]["n"] == 1900 and not got["error", None]["veto"]


def test_counts_of_days_add_up_to_the_fit_of_their_rows(spark):
    from timekeel.operators import calibration
    rng = random.Random(9)
    rows = [(dt.date(2024, 1, 1 + rng.randrange(9)), rng.choice("ab"), rng.choice(["0-5 min", "5-15 min"]), rng.randint(-90, 90), rng.randint(-90, 90)) for _ in range(4000)]
    res = spark.createDataFrame(rows, "service_date date, station_group string, lead_band string, low_res int, high_res int")
    by_day = [calibration.residual_counts(res.where(F.col("service_date") == F.lit(dt.date(2024, 1, d)))) for d in range(1, 10)]
    added = by_day[0]
    for c in by_day[1:]:
        added = added.unionByName(c)
    got = {(r["station_group"], r["lead_band"]): (r["n"], r["lo"], r["hi"]) for r in calibration.fit_counts(added, min_rows=1).collect()}
    for g, b in got:
        mine = [r for r in rows if g in (None, r[1]) and b == r[2]]
        assert got[g, b] == (len(mine), round(np.percentile([r[3] for r in mine], 10)), round(np.percentile([r[4] for r in mine], 90)))
    assert added.count() < 2 * 9 * 4 * 181


def test_days_are_judged_once_for_all_that_read_them(spark, small):
    from timekeel import views
    from timekeel.operators import scenarios

    stops = views.scenario_stops(spark, small)
    inst = scenarios.instances(stops, scenarios.day_track(stops), 1)
    # The plan begins at the written segments, days and runs: what orders a day's stops is not in it again.
    plan = inst._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "events.parquet" not in plan
