"""Near-duplicates and nearest neighbours against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from timekeel.llm import near_duplicates, neighbours, shingles


def word_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: word_set(t) for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if v == old else v for i, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in ids}


def test_shingles_are_those_of_words():
    for text in ("", " ", "a", "A b\tc  d", "a b c d e f a b c d e", "É é x y z w v"):
        assert len(shingles.shingle_set(text)) == len(word_set(text))
    assert list(shingles.shingle_set("One  two\nthree four five six")) == list(shingles.shingle_set("one two three FOUR five six"))


def test_near_duplicates_equal_brute_force(docs, rows, empty):
    got = near_duplicates.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = brute({(r[0], r[1]) for r in rows if r[0] is not None})
    for r in got:
        if r["doc_id"] is None:
            assert (r["component_id"], r["kept"]) == (None, True)
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert len({v[1] for v in want.values()}) < len(want) - 30
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_every_list_is_common_and_sketches_are_short(docs, rows, monkeypatch):
    """All lists go the way of common hashes, with sketches much shorter than the sets."""
    monkeypatch.setattr(near_duplicates, "COMMON", 1)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs).collect()}
    want = brute({(r[0], r[1]) for r in rows if r[0] is not None})
    assert all(got[i] == v[1] for i, v in want.items())


def test_cut_copies_of_large_groups(spark):
    """40 variants of each text share nearly all hashes; a copy cut to 80 to 88 % has a sketch that reaches further."""
    rng = random.Random(1)
    made = []
    for g, n in enumerate((300, 330, 345, 360, 450, 700)):
        for k, part in enumerate((0.80, 0.84, 0.88)):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            at = 1000 * (3 * g + k)
            made += [(at + i, " ".join([*base[:-1], f"v{i}"])) for i in range(40)]
            made.append((at + 100, " ".join(base[:int(n * part)])))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    want = {i: v[1] for k in range(18) for i, v in brute([m for m in made if m[0] // 1000 == k]).items()}
    assert want[100] == 0 and got == want


def test_texts_made_of_the_same_passages(spark):
    """Passages that most texts hold fill the part of the sketch that makes lists; only real links come out."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    passages = [[word() for _ in range(70)] for _ in range(6)]
    made = []
    for i in range(90):
        parts = rng.sample(passages, 4)
        made.append((i, " ".join(w for p in parts for w in p) + " " + " ".join(word() for _ in range(rng.choice([5, 40, 90])))))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    want = {i: v[1] for i, v in brute(made).items()}
    assert got == want and 1 < len(set(want.values())) < 90


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(300, 200), (200, 300)]
    got = {r["node"]: r["label"] for r in near_duplicates.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200, 300: 200}


def test_stage_keeps_one_of_each(docs):
    left = near_duplicates.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert left.where(F.col("doc_id").isNull()).count() == 1
    assert left.where("doc_id between 160 and 199").count() < 10


def test_stages_tell_rows_of_one_id_apart_and_keep_clashing_columns(spark, docs):
    """A removed row takes no other row of its id with it, and a table may have columns named as the stage's own."""
    from timekeel.llm import quality
    text = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i}" for i in range(80))
    rows = [(1, text), (2, text), (2, other), (3, "x " + text)]
    df = spark.createDataFrame([(i, t, "aa", "s", 5, i, 7, 8) for i, t in rows], "doc_id long, text string, lang string, source string, mark int, k_id long, k_mark int, id int")
    left = near_duplicates.without_near_duplicates(df)
    assert left.columns == df.columns and sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(1, text), (2, other)]
    fine = quality.accepted(df)
    assert fine.columns == df.columns and sorted((r["doc_id"], r["text"], r["k_id"]) for r in fine.collect()) == sorted((i, t, i) for i, t in rows)


def table(spark, vecs):
    return spark.createDataFrame([(i, v, 0, 1.0) for i, v in vecs], "vec_id long, embedding array<double>, entry int, score double")


def nearest(vecs, q, k=10):
    fine = [(i, np.array(v, float)) for i, v in vecs if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    at = dict(fine)[q]
    far = sorted((float(np.sqrt(np.square(v - at).sum())), i) for i, v in fine if i != q)
    return [(i, s) for s, i in far[:k]]


@pytest.fixture(scope="module")
def vecs():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 24))
    out = [(i, (centres[i % 12] + 0.4 * rng.normal(size=24)).tolist()) for i in range(600)]
    out += [(i, out[5][1]) for i in range(600, 800)]
    out += [(900, None), (1000, [0.0] * 24), (1100, [float("nan")] + [1.0] * 23), (1200, [None] + [1.0] * 23), (1300, [float("inf")] + [1.0] * 23), (None, [1.0] * 24), (5, out[5][1])]
    return out


def test_neighbours_recall_and_scores(spark, vecs):
    got = neighbours.search(table(spark, vecs), lambda i: i % 100 == 0).collect()
    queries = {r["query_id"] for r in got}
    assert queries == {0, 100, 200, 300, 400, 500, 600, 700}
    hit = total = 0
    for q in queries:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        want = nearest(vecs, q)
        scores = dict(nearest(vecs, q, 2000))
        assert all(abs(scores[m[1]] - m[2]) < 1e-12 for m in mine)
        hit += len({m[1] for m in mine} & {w[0] for w in want})
        total += 10
    assert hit / total >= 0.9
    equal = sorted(r["vec_id"] for r in got if r["query_id"] == 700)
    assert equal == [5, *range(600, 609)]


def test_neighbours_of_few_and_none(spark, vecs):
    few = neighbours.search(table(spark, [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.1, 0.0]), (2, [1.0, 0.0, 0.1])]), lambda i: i % 100 == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert neighbours.search(table(spark, vecs).limit(0), lambda i: i % 100 == 0).count() == 0


def test_every_query_gets_ten_where_there_are_ten(spark, vecs):
    """Few vectors without structure; and one far from a hot cluster."""
    few = [(i, v) for i, v in enumerate(np.random.default_rng(4).normal(size=(11, 64)).tolist())]
    hot = [(i, [1.0 + 0.001 * i] + [0.01 * (i % 7)] * 23) for i in range(1, 60)] + [(0, [0.0] * 12 + [1.0, -1.0] * 6)]
    for given, asks in ((few, 1), (hot, 100)):
        got = neighbours.search(table(spark, given), lambda i, asks=asks: i % asks == 0).collect()
        for q in range(0, len(given), asks):
            mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
            assert [m[0] for m in mine] == list(range(1, 11))
            assert {m[1] for m in mine} <= {i for i, _ in given} - {q}
            if asks == 1:
                assert [m[1] for m in mine] == [w[0] for w in nearest(given, q)]


def test_large_cells_are_dealt_over_blocks(spark, vecs, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in neighbours.search(table(spark, vecs), lambda i: i % 300 == 0).collect()}
    monkeypatch.undo()
    want = {(r["query_id"], r["rank"]): r["vec_id"] for r in neighbours.search(table(spark, vecs), lambda i: i % 300 == 0).collect()}
    assert got == want


def test_hashing_is_a_rotation():
    x = np.random.default_rng(1).normal(size=(5, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = neighbours.rotated(x, 3, 0)
    assert np.allclose(y @ y.T, x @ x.T)
