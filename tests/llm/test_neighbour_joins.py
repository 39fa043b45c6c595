"""The search's joins go through no driver, however small their sides look."""

import numpy as np

from timekeel.llm import neighbours


def test_cells_and_queries_meet_without_broadcast(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 4))
    vec = [[float(v) for v in r] for r in x]
    cell = [i % 3 for i in range(40)]
    index = spark.createDataFrame([(vec[i], [i], i) for i in range(40)], "vec array<double>, ids array<long>, entry long")
    placed = spark.createDataFrame([(0, cell[i], i) for i in range(40)], "t int, cell long, entry long")
    asked = range(0, 40, 10)
    queries = spark.createDataFrame([(i, vec[i]) for i in asked], "query_id long, vec array<double>")
    probed = spark.createDataFrame([(0, c, i) for i in asked for c in (0, 2)], "t int, cell long, query_id long")
    found = neighbours.best_of(placed, probed, index, queries, 5)
    rows = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    want = []
    for q in asked:
        near = sorted((float(np.sqrt(np.square(x[i] - x[q]).sum())), i) for i in range(40) if cell[i] != 1 and i != q)[:5]
        want += [(q, rank, i) for rank, (_, i) in enumerate(near, 1)]
    assert rows == sorted(want)
