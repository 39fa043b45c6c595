"""The classifier against moments and risks in NumPy, and on held-out and planted documents."""

import random
import zlib

import numpy as np
import pytest

from timekeel.llm import positive_unlabelled as C

SCHEMA = "doc_id long, text string, lang string, source string, x string, score string, positive string, p_id string, quality string"


def prose(rng, n):
    return " ".join("".join(rng.choice("etaonrishdlu") for _ in range(rng.randint(2, 8))) + ("." if rng.random() < 0.1 else "") for _ in range(n)).capitalize()


def junk(rng, n, kind):
    words = prose(rng, n).split(" ")
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in words)
    if kind == 2:
        return " | ".join(words)
    return " ".join(w for w in words[:8] for _ in range(n // 8 + 2))


def make():
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(1200):
        good = rng.random() < 0.8
        docs.append((i, prose(rng, rng.randint(20, 300)) if good else junk(rng, rng.randint(20, 300), i % 4), "aa", "s"))
        if rng.random() < 0.4:
            labels.append((i, int(good), 0))
    docs += [(5000, None, None, None), (5001, "", "aa", None), (None, "no id", "aa", "s"), (5002, " \n\t", "aa", "s"), (5003, "word " * 200_000, "aa", "s"), (3, docs[3][1], "aa", "s")]
    labels += [(5001, None, None), (None, 1, 0), labels[0], (labels[1][0], 0, 1), (99999, 1, 0)]
    return [(*d, "x", "s", "p", "i", "q") for d in docs], labels


@pytest.fixture(scope="module")
def given(spark):
    docs, labels = make()
    return spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs, labels


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_and_planted_documents(given):
    docs, labels, rows, marks = given
    out = C.score_quality(docs, labels).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all() and out.score.notna().all()
    assert (out.predicted == (out.score >= 0.3)).all()
    by = {int(r.doc_id): r for r in out.itertuples() if r.doc_id == r.doc_id}
    assert all(by[i].held_out == held(i) for i in by)
    truth = {i: q for i, q, _ in marks if i is not None and i < 1200 and q is not None}
    judged = [(by[i].predicted, q) for i, q in truth.items() if held(i)]
    assert len(judged) > 60 and np.mean([p == q for p, q in judged]) >= 0.97
    assert by[5003].predicted == 0


def test_labels_zero_and_held_out_labels_are_not_learned_from(spark, given):
    docs, labels, _, marks = given
    rows = C.settle(C.vectors(docs))
    one = C.train(rows, labels).weights
    trusted = {i for i in {m[0] for m in marks if m[0] is not None} if min((m[1] or 0) for m in marks if m[0] == i) == 1}
    fewer = spark.createDataFrame([(i, 1) for i in trusted if not held(i)], "doc_id long, quality int")
    assert (C.train(rows, fewer).weights == one).all()


def test_moments_and_risk_equal_numpy(given):
    docs, labels, rows, marks = given
    x = np.array([C.vector(r[1]) for r in rows if not held(r[0])]) / C.STEP
    good = {m[0] for m in marks} - {m[0] for m in marks if m[1] != 1}
    positive = np.array([r[0] in good for r in rows if not held(r[0])])
    found, known = C.vectors(docs).where("not held_out"), C.positives(labels)
    marked = found.join(known, found["doc_id"] == known["p_id"], "left").selectExpr("x", "p_id IS NOT NULL AS positive")
    model, m = C.fit(C.settle(marked)), C.moments(marked)
    assert m[0][0] == len(x) and m[1][0] == positive.sum()
    assert np.allclose(m[0][1], x.T @ x / len(x), atol=1e-12) and np.allclose(m[1][1], x[positive].T @ x[positive] / positive.sum(), atol=1e-12)
    g, loss = x @ model.weights, lambda z: ((1 - z) ** 2 / 4).mean()
    risk = model.prior * loss(g[positive]) + max(0, loss(-g) - model.prior * loss(-g[positive]))
    assert abs(risk - model.risk) < 1e-9
    assert 0.7 < model.prior < 0.9


def test_minimum_of_the_unbiased_risk_and_its_correction():
    rng = np.random.default_rng(4)
    p, n = rng.normal(1, 0.5, (400, 3)), rng.normal(-1, 0.5, (100, 3))
    column = lambda a: np.c_[np.ones(len(a)), a]
    every, positive = column(np.r_[p, n]), column(p)
    a, b = every.T @ every / 500, positive.T @ positive / 400
    w = C.minimise(a, b, 0.8, ridge=0.0)
    value = lambda w: sum(C.parts(w, a, b, 0.8)[:1]) + max(0, C.parts(w, a, b, 0.8)[1])
    assert all(value(w) <= value(w + d) + 1e-12 for d in rng.normal(0, 0.05, (300, 4)))
    # A prior that is too high drives the negatives' part below zero unless it is held there.
    plain = np.linalg.solve(a / 2, 0.99 * b[0] - a[0] / 2)
    bounded = C.minimise(a, b, 0.99, ridge=0.0)
    corrected = lambda w: C.parts(w, a, b, 0.99)[0] + max(0, C.parts(w, a, b, 0.99)[1])
    assert corrected(bounded) <= corrected(plain)


def test_prior_is_the_least_ratio_of_tails():
    cells = np.zeros((2, C.BINS))
    cells[1, 1500:1600] = 1
    cells[0, 1500:1600] = 3
    cells[0, 100:200] = 1
    assert abs(C.class_prior(cells) - 0.75) < 1e-12
    assert C.class_prior(np.zeros((2, C.BINS))) == 1.0


def test_without_positives_and_empty(spark, given):
    docs, labels, rows, _ = given
    assert {r["score"] for r in C.score_quality(docs, labels.limit(0)).collect()} == {1.0}
    assert C.score_quality(docs.limit(0), labels).collect() == []
