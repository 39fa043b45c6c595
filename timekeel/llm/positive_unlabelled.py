"""A quality classifier from trusted positives and unlabelled text.

Every whole text becomes a vector of shares (characters by class, repeated words, lines and
windows) as piecewise linear pieces. The classifier is linear in it and minimises the
non-negative unbiased risk

    prior * E_positive[l(g)] + max(0, E_all[l(-g)] - prior * E_positive[l(-g)])

with the squared loss l(z) = (1 - z)^2 / 4, so the risk is a function of two moment matrices.
Spark sums these over all documents that are not held out (unlabelled: every one of them,
whatever its label) and over those labelled 1; labels 0 are never read. The class prior is
the least ratio of the shares of all and of positive documents above a threshold of a first
discriminator: where there are no negatives that ratio is the prior. A score is
(1 + g) / 2, the squared loss's estimate of the probability.

Vectors hold whole numbers of 1/1024, so moments are exact and every run gives the same
classifier. The driver holds matrices of `len(NAMES)` columns and two histograms, whatever
the size of the tables; texts are read once.

Cases: a null text is an empty one and gets a score like others; rows without an id are held
out; a document with several labels is positive if all are 1; repeated rows count as often as
they occur; without positives or without other documents every score is the prior (1, if there
is nothing to estimate it from); an empty table gives an empty result; columns but `doc_id`,
`text` and `quality` are not read.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timekeel.session import settle

from .common import crc_of_id, ship
from .quality import SPACES, WORD, repeated_words

STEP = 1024
#: Share of positives that lies above the thresholds at which the prior is judged, at least.
TAIL = 0.25
BINS = 2048
RIDGE = 1e-3
STEPS = 400
THRESHOLD = 0.3
CHUNK = 1 << 20

OTHER, LOWER, UPPER, DIGIT, SPACE, LINE, STOP, COMMA, CALL, BAR, SYMBOL, MARK = range(12)
SHARES = ("upper", "digit", "line", "stop", "comma", "call", "bar", "symbol", "mark", "other", "follows", "windows", "lines", "commonest", "long", "few")
#: A share's root is kept whole and above these values.
KNOTS = (0.0, 0.1, 0.3)
NAMES = ("one", *(f"{s}_{k}" for s in SHARES for k in range(len(KNOTS))))


def char_classes() -> np.ndarray:
    """The class of every code point; made once in each process."""
    held = sys.modules[__name__].__dict__
    if "_classes" not in held:
        table = np.zeros(0x110000, dtype=np.uint8)
        kinds = {"Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Zs": SPACE, "Sm": SYMBOL, "Sc": SYMBOL, "Sk": SYMBOL, "So": SYMBOL}
        for i in range(0x110000):
            kind = unicodedata.category(chr(i))
            table[i] = kinds.get(kind, LOWER if kind[0] in "LM" else MARK if kind[0] == "P" else OTHER)
        for chars, kind in (("#*$%&<>@\\^_~+=/", SYMBOL), ("\t\x0b\x0c\r", SPACE), ("\n", LINE), (".", STOP), (",", COMMA), ("!?", CALL), ("|", BAR)):
            for c in chars:
                table[ord(c)] = kind
        held["_classes"] = table
    return held["_classes"]


def shares(text: str | None) -> list[float]:
    """The shares, each from 0 to 1, in the order of `SHARES`."""
    text = text or ""
    n = np.zeros(12, dtype=np.int64)
    for i in range(0, len(text), CHUNK):
        n += np.bincount(char_classes()[np.frombuffer(text[i:i + CHUNK].encode("utf-32-le", "surrogatepass"), dtype="<u4")], minlength=12)
    words = WORD.findall(text)
    many, chars, letters = max(1, len(words)), max(1, len(text)), max(1, int(n[LOWER] + n[UPPER]))
    seen, lines, again = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            again += line in seen
            seen.add(line)
    follows = sum(map(str.__eq__, words, words[1:]))
    commonest = max(Counter(words).values(), default=0) if len(words) > 1 else 0
    return [n[UPPER] / letters, n[DIGIT] / chars, n[LINE] / chars, n[STOP] / many if n[STOP] < many else 1.0, min(1.0, n[COMMA] / many), min(1.0, n[CALL] / many),
            min(1.0, n[BAR] / many), min(1.0, n[SYMBOL] / chars), n[MARK] / chars, n[OTHER] / chars, follows / many, repeated_words(words) / many, again / max(1, lines),
            commonest / many, min(1.0, len(text) / many / 100), 1 / math.sqrt(1 + len(words))]


def vector(text: str | None) -> list[int]:
    roots = [math.sqrt(s) for s in shares(text)]
    return [STEP, *(round(STEP * max(0.0, r - k)) for r in roots for k in KNOTS)]


def vectors(docs: DataFrame) -> DataFrame:
    """`doc_id`, `held_out` and the vector `x` of every document."""
    ship(docs.sparkSession)
    size = len(NAMES)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [v for t in b.column(2) for v in vector(t.as_py())]
            x = pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.int32()), size).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), x], names=["doc_id", "held_out", "x"])

    doc_id = F.col("doc_id").cast("long")
    picked = docs.select(doc_id.alias("doc_id"), (F.pmod(crc_of_id(doc_id), F.lit(5)) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(rows, "doc_id long, held_out boolean, x array<int>")


def matrix(b: pa.RecordBatch, at: int) -> np.ndarray:
    return b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)).astype(float)


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Number of rows and mean outer product of `x`, of all rows (0) and of the positive ones (1)."""
    size = len(NAMES)
    i, j = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums of products of whole numbers below 2^53 are exact as doubles.
        total = np.zeros((2, size, size), dtype=np.int64)
        for b in batches:
            x, positive = matrix(b, 0), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            total[0] += (x.T @ x).astype(np.int64)
            total[1] += (x[positive].T @ x[positive]).astype(np.int64)
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[k][i, j])], names=["k", "i", "j", "s"])

    found = rows.select("x", "positive").mapInArrow(run, "k int, i int, j int, s long").groupBy("k", "i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("double").alias("s")).toPandas()
    out = {}
    for k in (0, 1):
        part, m = found[found.k == k], np.zeros((size, size))
        m[part.i, part.j] = m[part.j, part.i] = part.s / STEP**2
        n = round(m[0, 0])
        out[k] = n, m / max(1, n)
    return out


def margins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.round((x * w).sum(axis=1) / STEP, 9)


def tails(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """Histograms of the discriminator over all rows and over positives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS), dtype=np.int64)
        for b in batches:
            cell = np.clip((margins(matrix(b, 0), w) + 2) * (BINS / 4), 0, BINS - 1).astype(np.int64)
            total[0] += np.bincount(cell, minlength=BINS)
            total[1] += np.bincount(cell[b.column(1).to_numpy(zero_copy_only=False).astype(bool)], minlength=BINS)
        k, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(cell), pa.array(total[k, cell])], names=["k", "cell", "n"])

    found = rows.select("x", "positive").mapInArrow(run, "k long, cell long, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((2, BINS))
    out[found.k, found.cell] = found.n
    return out


def class_prior(histograms: np.ndarray, tail: float = TAIL) -> float:
    """The least ratio of the shares of all and of positive rows above a threshold."""
    every, positive = (h[::-1].cumsum() / max(1, h.sum()) for h in histograms)
    enough = positive >= tail
    return float(min(1.0, (every[enough] / positive[enough]).min())) if enough.any() else 1.0


def parts(w: np.ndarray, every: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float]:
    """prior * E_positive[l(g)], and the risk of negatives that may not fall below zero."""
    loss = lambda m, sign: (m[0, 0] - 2 * sign * m[0] @ w + w @ m @ w) / 4
    return prior * loss(positive, 1), loss(every, -1) - prior * loss(positive, -1)


def minimise(every: np.ndarray, positive: np.ndarray, prior: float, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights of least non-negative risk, by preconditioned descent from the unbiased risk's minimum.

    While the negatives' part is below zero the step goes up that part alone; the weights of the
    least risk seen are returned.
    """
    penalty = ridge * np.diag(np.r_[0.0, np.ones(len(every) - 1)])
    inverse = np.linalg.pinv(every / 2 + penalty, hermitian=True)

    def risk(w: np.ndarray) -> float:
        kept, other = parts(w, every, positive, prior)
        return kept + max(0.0, other) + w @ penalty @ w / 2

    # The unbiased risk is quadratic: its gradient is (every / 2 + penalty) w + every[0] / 2 - prior * positive[0].
    w = best = inverse @ (prior * positive[0] - every[0] / 2)
    for k in range(steps):
        _, other = parts(w, every, positive, prior)
        down = (every @ w + every[0]) / 2 - prior * (positive @ w + positive[0]) / 2
        if other < 0:
            w = w + 0.5 / (1 + k) ** 0.5 * inverse @ down
        else:
            w = w - 0.5 / (1 + k) ** 0.5 * inverse @ ((every / 2 + penalty) @ w + every[0] / 2 - prior * positive[0])
        best = w if risk(w) < risk(best) else best
    return best


class Classifier:
    def __init__(self, weights: np.ndarray, prior: float, risk: float):
        self.weights, self.prior, self.risk = weights, prior, risk

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.round(np.clip((1 + margins(x, self.weights)) / 2, 0, 1), 6)


def fit(rows: DataFrame) -> Classifier:
    """From rows with `x` and `positive`, all of which count as unlabelled."""
    found = moments(rows)
    (n, every), (n_positive, positive) = found[0], found[1]
    constant = np.zeros(len(NAMES))
    if not n_positive or n == n_positive:
        constant[0] = 1.0
        return Classifier(constant, 1.0, 0.0)
    first = np.linalg.pinv(every + positive + RIDGE * np.eye(len(every)), hermitian=True) @ (positive[0] - every[0])
    prior = class_prior(tails(rows, first / max(1e-9, np.abs(first).max())))
    weights = np.round(minimise(every, positive, prior), 9)
    kept, other = parts(weights, every, positive, prior)
    return Classifier(weights, prior, kept + max(0.0, other))


def positives(labels: DataFrame) -> DataFrame:
    """Ids whose labels are all 1."""
    return labels.select(F.col("doc_id").cast("long").alias("p_id"), F.col("quality").cast("int").alias("quality")).where("p_id IS NOT NULL").groupBy("p_id").agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("least")).where("least = 1").select("p_id")


def predict(rows: DataFrame, model: Classifier) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = held.value.scores(matrix(b, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def train(rows: DataFrame, labels: DataFrame) -> Classifier:
    """From vectors that are not held out and the labels 1."""
    learned = rows.where("not held_out")
    known = positives(labels).withColumn("positive", F.lit(True))
    marked = learned.join(known, learned["doc_id"] == known["p_id"], "left").select("x", F.coalesce("positive", F.lit(False)).alias("positive"))
    return fit(settle(marked, "marked"))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction of every document."""
    rows = settle(vectors(docs), "vectors")
    return predict(rows, train(rows, labels))
