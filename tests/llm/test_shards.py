"""Shuffles of exact sizes: the law, the draws, and uniformity."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from timekeel.llm import shards


def test_shards_hold_all_rows_at_most_one_apart(docs, rows, empty):
    got = shards.shard_documents(docs).toPandas()
    assert sorted(got.doc_id.fillna(-1)) == sorted(-1 if r[0] is None else r[0] for r in rows)
    sizes = got.groupby("shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    want = sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted(zip(got["size"], got.text_crc32)) == want
    assert set(got.law) == {"rows"} and got.grown_shard.isna().all()
    assert shards.shard_documents(empty).count() == 0


def test_many_blocks_are_reached_in_levels(docs, rows):
    out = shards.shuffle(docs.select("doc_id", "text", "row", "part"), n_shards=3, block_rows=10, fan_out=2)
    got = out.toPandas()
    assert out.columns == ["doc_id", "text", "row", "part", "shard", "slot"]
    assert len(got) == len(rows)
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_the_same_seed_gives_the_same_order(docs):
    slim = docs.select("doc_id", "n_chars")
    one, two, other = (sorted(map(str, shards.shuffle(slim, 4, s).collect())) for s in (1, 1, 2))
    assert one == two != other


def test_matrix_has_the_margins_and_the_mean_of_a_shuffle():
    rng = np.random.default_rng(0)
    sent, received = [10, 0, 30, 60], [50, 25, 25]
    draws = np.array([shards.communication_matrix(sent, received, rng) for _ in range(3000)])
    assert (draws.sum(axis=2) == sent).all() and (draws.sum(axis=1) == received).all()
    assert np.allclose(draws.mean(axis=0), np.outer(sent, received) / 100, atol=0.2)
    # Variance of a hypergeometric count: 30 drawn, 50 of 100 fit.
    assert abs(draws[:, 2, 0].var() - 30 * 0.5 * 0.5 * 70 / 99) < 0.4


def test_places_are_uniform(spark):
    counts = np.zeros((4, 4))
    frame = spark.range(8).repartition(2).select(F.col("id").alias("doc_id"))
    for seed in range(12):
        for r in shards.shuffle(frame, 4, seed).collect():
            counts[r["doc_id"] % 4, r["shard"]] += 1
    assert counts.min() >= 1 and counts.sum() == 96


def test_draws_beyond_the_library_have_its_law():
    """The same numbers by the other way, against exact probabilities; and counts of billions."""
    from math import comb
    rng = np.random.default_rng(5)
    for good, bad, sample in ((30, 70, 40), (70, 30, 40), (30, 70, 85), (500, 700, 300), (4, 90, 50), (60, 60, 7)):
        n = 20_000
        got = np.bincount([shards.drawn(good, bad, sample, rng, library_most=1) for _ in range(n)], minlength=good + 1)
        want = np.array([comb(good, k) * comb(bad, sample - k) / comb(good + bad, sample) if 0 <= sample - k <= bad else 0.0 for k in range(good + 1)]) * n
        assert got[want == 0].sum() == 0
        often = want >= 5
        off = ((got[often] - want[often]) ** 2 / want[often]).sum()
        assert off < often.sum() + 5 * np.sqrt(2 * often.sum()) + 5, (good, bad, sample)
    received = [750_000_000] * 3 + [750_000_001]
    matrix = shards.communication_matrix([3_000_000_000 - 500, 400, 101], received, rng)
    assert matrix.sum(axis=0).tolist() == received and matrix.sum(axis=1).tolist() == [3_000_000_000 - 500, 400, 101]
    assert (np.abs(matrix[0] - 750_000_000) < 10_000).all() and (matrix >= 0).all()
    free = shards.communication_matrix([4 * 10**9, 4 * 10**9], [2 * 10**9] * 4, rng)
    assert (np.abs(free - 10**9) < 400_000).all() and (free.sum(axis=0) == 2 * 10**9).all()
