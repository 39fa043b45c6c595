"""Language identification with error-correcting output codes.

Every language gets a codeword of bits; each bit has a binary classifier on hashed character
bigrams and trigrams (log odds of the bit's two sides, each side the mean of its languages).
A text's margins are decoded with the logistic loss, weighted by how well each classifier
does on each language (loss-weighted decoding); the nearest codeword wins, and a text whose
second codeword is about as near is flagged as ambiguous.

The classifiers are fitted on `fit_rows` labelled documents of each language at most (those
with the smallest hash of id), whole texts, counted by Spark; the driver holds one count per
language and bucket. Weights are whole numbers, so a prediction does not depend on the order
of sums.

Cases: null texts and texts without a letter are `und` with score 0; rows without a language
or id are not learned from but predicted; with one language all texts with letters get it;
with none all are `und`; repeated rows get the same prediction; an empty table gives an empty
result.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timekeel.session import settle

from .common import crc_of_id, ship

UNKNOWN = "und"
BUCKETS = 1 << 16
#: Labelled documents of one language that the classifiers are fitted on.
FIT_ROWS = 1500
#: Languages that are learned at most: the most frequent ones.
MOST_LANGUAGES = 256
SCALE = 1024
#: Flagged if the best score leads the second by less.
LEAD = 0.2
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


def is_letter() -> np.ndarray:
    """Which code points are letters; made once in each process."""
    held = sys.modules[__name__].__dict__
    if "_letters" not in held:
        held["_letters"] = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)
    return held["_letters"]


def grams(text: str | None) -> np.ndarray:
    """Buckets of all bigrams and trigrams of lower-cased letters, with one blank for whatever stands between; empty without a letter."""
    if not text:
        return np.zeros(0, np.int64)
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    a = np.where(is_letter()[a], a, np.uint32(32))
    if (a == 32).all():
        return np.zeros(0, np.int64)
    a = np.concatenate([[32], a, [32]]).astype(np.uint32)
    blank = a == 32
    keep = np.ones(len(a), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    a = a[keep]
    two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + a[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
    both = np.concatenate([two, three])
    return ((both ^ (both >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """n codewords of bits: all splits in two for few languages, else the best of seeded random codes."""
    if n <= 1:
        return np.zeros((n, 0), dtype=bool)
    if n <= 6:
        splits = [s for s in itertools.product([False, True], repeat=n) if s[0] and not all(s)]
        return np.array(splits).T
    width, best, far = math.ceil(10 * math.log2(n)), None, -1
    rng = np.random.default_rng(n)
    for _ in range(200):
        code = rng.random((n, width)) < 0.5
        code = code[:, code.any(axis=0) & ~code.all(axis=0)]
        apart = (code[:, None, :] ^ code[None, :, :]).sum(axis=2)
        np.fill_diagonal(apart, width)
        if apart.min() > far:
            best, far = code, apart.min()
    return best


class Model:
    """Codewords, one column of gram weights per bit, margin scales and decoding weights."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS) if len(languages) else counts
        sides = [(share[self.code[:, j]].mean(axis=0), share[~self.code[:, j]].mean(axis=0)) for j in range(self.code.shape[1])]
        odds = np.array([np.log(one) - np.log(other) for one, other in sides]).T.reshape(BUCKETS, -1)
        # Grams that no labelled text has say nothing.
        odds[counts.sum(axis=0) == 0] = 0
        self.weights = np.round(np.clip(odds, -30, 30) * SCALE).astype(np.int32)
        self.trust = np.ones(self.code.shape, dtype=float)

    def margins(self, buckets: np.ndarray) -> np.ndarray:
        """Evidence for each bit; it grows with the root of the text's length."""
        return self.weights[buckets].sum(axis=0, dtype=np.int64) / (SCALE * math.sqrt(len(buckets)))

    def scores(self, margins: np.ndarray) -> np.ndarray:
        signs = np.where(self.code, 1.0, -1.0)
        loss = np.logaddexp(0, -signs * np.clip(margins, -30, 30))
        far = (self.trust * loss).sum(axis=1)
        near = np.exp(far.min() - far)
        return near / near.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        buckets = grams(text)
        if not len(buckets) or not self.languages:
            return UNKNOWN, 0.0, True
        scores = self.scores(self.margins(buckets))
        order = np.argsort(-scores, kind="stable")
        lead = scores[order[0]] - (scores[order[1]] if len(order) > 1 else 0.0)
        return self.languages[order[0]], float(scores[order[0]]), bool(lead < LEAD)


def labelled(docs: DataFrame, fit_rows: int) -> DataFrame:
    """The texts that the classifiers are fitted on."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) != 0))
    # Ids are chosen before texts are read, so no text is sorted.
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("lang", "doc_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= fit_rows)
    return rows.join(chosen.select("lang", "doc_id").distinct(), ["lang", "doc_id"])


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, most_languages: int = MOST_LANGUAGES) -> Model:
    sample = settle(labelled(docs, fit_rows).select("lang", "text"), "labelled")
    sizes = sample.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    languages = sorted(r["lang"] for r in sizes)
    place = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                if lang in place:
                    total[place[lang]] += np.bincount(grams(text.as_py()), minlength=BUCKETS)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[lang, bucket])], names=["lang", "bucket", "n"])

    counts = np.zeros((len(languages), BUCKETS))
    if languages:
        found = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts[found["lang"], found["bucket"]] = found["n"]
    model = Model(languages, counts)
    if len(languages) > 1:
        model.trust = trust(sample, model)
    return model


def trust(sample: DataFrame, model: Model) -> np.ndarray:
    """How often each bit's classifier is right on each language, as weights that sum to the number of bits."""
    place = {lang: i for i, lang in enumerate(model.languages)}
    held = sample.sparkSession.sparkContext.broadcast(model)

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        hits = np.zeros(m.code.shape, dtype=np.int64)
        n = np.zeros(len(m.languages), dtype=np.int64)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                g = grams(text.as_py()) if lang in place else ()
                if len(g):
                    i = place[lang]
                    n[i] += 1
                    hits[i] += (m.margins(g) > 0) == m.code[i]
        i, j = np.indices(hits.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i, j, hits[i, j], n[i])], names=["i", "j", "hits", "n"])

    found = sample.mapInArrow(right, "i long, j long, hits long, n long").groupBy("i", "j").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).toPandas()
    out = np.ones(model.code.shape)
    out[found["i"], found["j"]] = (found["hits"] + 1) / (found["n"] + 2)
    return out * out.shape[1] / out.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    spark = ship(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            out = [m.predict(t.as_py()) for t in b.column(2)]
            lang, score, ambiguous = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    doc_id = F.col("doc_id").cast("long")
    picked = docs.select(doc_id.alias("doc_id"), (F.pmod(crc_of_id(doc_id), F.lit(5)) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(rows, RESULT)


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Predicted language of every document, from classifiers fitted on those that are not held out."""
    ship(docs.sparkSession)
    return predict(docs, fit(docs, fit_rows))


def accepted(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """`docs` without those whose text has no letter or is about as near to two languages."""
    spark = ship(docs.sparkSession)
    held = spark.sparkContext.broadcast(fit(docs, fit_rows))
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [not held.value.predict(t.as_py())[2] for t in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
