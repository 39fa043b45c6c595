"""Quality rules: plain text statistics, then robust multivariate outliers.

Statistics of every whole text are transformed to a vector; per language and source the
minimum-covariance-determinant estimate of its centre and scatter is found by concentration
steps that Spark runs over all rows: distances, the h nearest rows, their mean and
covariance, until no determinant falls any more. Deterministic starts take the place of random ones.
A text whose robust Mahalanobis distance passes the cutoff is rejected.

Values are held in steps of 1/1024, so sums are exact whole numbers and every run gives the
same estimates. The h nearest rows are taken from a histogram of distances (16 cells to a
doubling), so no row list of a group is ever gathered; a large group is aggregated map-side.

Cases: a null text has no words and fails the base rules; null languages and sources are
groups like others; a group with fewer than `min_group` rows is judged within its language,
or else within all rows, and nothing is rejected if those are too few as well; repeated
rows count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timekeel.session import settle

from .common import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The transformed vector: log of length, log of mean word length, and roots of three shares.
FEATURES = ("x_words", "x_word_chars", "x_symbols", "x_dup_lines", "x_repeats")
#: Smallest standard deviation that a feature is taken to have, so that one that is nearly always zero doesn't reject its first other value.
FLOORS = (0.30, 0.10, 0.10, 0.10, 0.10)
STEP = 1024
#: Share of a group's rows that an estimate rests on.
SUPPORT = 0.75
MIN_GROUP = 100
#: Tail probability, under a normal distribution, of the squared distance at which a text goes.
TAIL = 1e-7
#: Fall of the log determinant below which a start has settled.
SETTLED = 0.02


def repeated_words(words: list[str]) -> int:
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, covered, until = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The five counts and the number of lines with a word."""
    text = text or ""
    words = WORD.findall(text)
    seen, lines, again = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            again += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), again, repeated_words(words), lines


def vector(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int, n_lines: int) -> list[int]:
    root = lambda part, whole: math.sqrt(part / whole) if whole else 0.0
    x = (math.log1p(n_words), math.log((word_chars + 1) / (n_words + 1)), root(n_symbols, word_chars), root(n_dup_lines, n_lines), root(n_repeat_words, n_words))
    return [round(v * STEP) for v in x]


def statistics(docs: DataFrame) -> DataFrame:
    """`doc_id`, the group columns, the counts and the vector of every text."""
    ship(docs.sparkSession)
    names = [*COUNTS, *FEATURES]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                c = counts(b.column(1)[i].as_py())
                out.append([*c[:5], *vector(*c)])
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "lang", "source", "mark", *names])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), mark())
    return picked.mapInArrow(rows, "doc_id long, lang string, source string, mark long, " + ", ".join(f"{n} long" for n in names))


def mark() -> Column:
    """Tells rows apart that share an id or have none."""
    return F.xxhash64(*(F.col(c).cast("string") for c in ("text", "lang", "source"))).alias("mark")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def chi2_cdf(x: float, p: int) -> float:
    """Distribution function of chi-squared by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = p / 2, x / 2
    if x > 400:
        return 1.0
    term = total = 1 / a
    k = 0
    while term > total * 1e-16:
        k += 1
        term *= x / (a + k)
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 800.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return (low + high) / 2


def tail_quantile(tail: float, p: int) -> float:
    """The value that chi-squared passes with probability `tail`, also where 1 - tail is nearly 1."""
    z = math.sqrt(2) * _erfc_inverse(2 * tail)
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def _erfc_inverse(y: float) -> float:
    low, high = 0.0, 30.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(mid) > y else (low, mid)
    return (low + high) / 2


def shrink_factor(share: float, p: int) -> float:
    """What the covariance of the nearest `share` of normal rows is multiplied by."""
    if share >= 1:
        return 1.0
    return share / chi2_cdf(chi2_quantile(share, p), p + 2)


def solve(params: DataFrame, features: tuple[str, ...], floors: tuple[float, ...], factor: float) -> DataFrame:
    """From sums of the chosen rows to centre, inverse scatter and log determinant of each group and start."""
    p = len(features)

    def rows(frames):
        for f in frames:
            n = f["n"].to_numpy(float)
            s = np.stack(f["s"].to_numpy()).astype(float).reshape(-1, p) / STEP if len(f) else np.zeros((0, p))
            q = np.stack(f["q"].to_numpy()).astype(float).reshape(-1, p, p) / STEP**2 if len(f) else np.zeros((0, p, p))
            mean = s / n[:, None]
            cov = (q / n[:, None, None] - mean[:, :, None] * mean[:, None, :]) * factor + np.diag(np.square(floors))
            inverse = np.linalg.inv(cov) if len(f) else cov
            f["centre"] = list(mean)
            f["inverse"] = list(inverse.reshape(-1, p * p))
            f["logdet"] = np.round(np.linalg.slogdet(cov)[1], 9) if len(f) else []
            yield f[["g", "start", "centre", "inverse", "logdet"]]

    return params.mapInPandas(rows, "g string, start int, centre array<double>, inverse array<double>, logdet double")


def distance(features: tuple[str, ...]) -> Column:
    """Squared Mahalanobis distance from columns `centre` and `inverse`."""
    p = len(features)
    d = [F.col(x) / STEP - F.col("centre")[i] for i, x in enumerate(features)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + d[i] * d[j] * F.col("inverse")[i * p + j] * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


def sums(features: tuple[str, ...]) -> list[Column]:
    p = len(features)
    return [F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(features)),
            *(F.sum(F.col(features[i]) * F.col(features[j])).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p))]


def packed(p: int) -> list[Column]:
    q = [F.col(f"q{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)]
    return [F.col("n"), F.array(*(F.col(f"s{i}") for i in range(p))).alias("s"), F.array(*q).alias("q")]


def nearest(rows: DataFrame, params: DataFrame, sizes: DataFrame, features: tuple[str, ...], share: float) -> DataFrame:
    """Sums over the `share` of each group's rows that lie nearest to its centre, by cells of the distance."""
    p = len(features)
    cell = F.greatest(F.lit(-320), F.least(F.lit(960), F.floor(F.log2(distance(features) + 1e-9) * 16))).cast("int")
    cells = rows.join(params, "g").groupBy("g", "start", cell.alias("cell")).agg(*sums(features))
    order = Window.partitionBy("g", "start").orderBy("cell")
    before = F.sum("n").over(order) - F.col("n")
    chosen = cells.withColumn("before", before).join(sizes, "g").where(F.col("before") < F.ceil(F.col("size") * share))
    total = [F.sum(c).alias(c) for c in ["n", *(f"s{i}" for i in range(p)), *(f"q{i}_{j}" for i in range(p) for j in range(i, p))]]
    return chosen.groupBy("g", "start").agg(*total).select("g", "start", *packed(p))


def estimates(rows: DataFrame, features: tuple[str, ...] = FEATURES, floors: tuple[float, ...] = FLOORS, share: float = SUPPORT) -> DataFrame:
    """Reweighted minimum-covariance-determinant centre and inverse scatter of each group `g`.

    Starts: median and spread of each feature; mean and covariance of the rows that are near
    the median in every feature. The start with the least determinant after concentration wins.
    """
    p = len(features)
    sizes = settle(rows.groupBy("g").agg(F.count(F.lit(1)).alias("size")), "sizes")
    middle = settle(rows.groupBy("g").agg(*(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"m{i}") for i, x in enumerate(features))), "middle")
    spread = [F.greatest((F.col(f"m{i}")[2] - F.col(f"m{i}")[0]) / (1.349 * STEP), F.lit(floors[i])) for i in range(p)]
    by_median = middle.select("g", F.lit(0).alias("start"), F.array(*(F.col(f"m{i}")[1] / STEP for i in range(p))).alias("centre"),
                              F.array(*(1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(p) for j in range(p))).alias("inverse"), F.lit(1e9).alias("logdet"))
    inner = [F.abs(F.col(x) - F.col(f"m{i}")[1]) <= F.greatest(F.col(f"m{i}")[2] - F.col(f"m{i}")[0], F.lit(int(floors[i] * STEP))) for i, x in enumerate(features)]
    within = inner[0]
    for c in inner[1:]:
        within = within & c
    boxed = rows.join(middle, "g").where(within).groupBy("g").agg(*sums(features)).select("g", F.lit(1).alias("start"), *packed(p))
    factor = shrink_factor(share, p)
    now = settle(by_median.unionByName(solve(boxed, features, floors, 1.0)), "starts")
    moving = True
    while moving:
        # A step that doesn't lower the determinant isn't taken, so the steps come to an end.
        after = solve(nearest(rows, now, sizes, features, share), features, floors, factor)
        both = now.select("g", "start", F.struct("logdet", "centre", "inverse").alias("old")).join(after.select("g", "start", F.struct("logdet", "centre", "inverse").alias("new")), ["g", "start"])
        fell = F.col("new.logdet") < F.col("old.logdet") - SETTLED
        both = settle(both.select("g", "start", F.when(fell, F.col("new")).otherwise(F.col("old")).alias("m"), fell.alias("fell")), "step")
        moving = both.where("fell").limit(1).count() > 0
        now = both.select("g", "start", "m.centre", "m.inverse", "m.logdet")
    best = Window.partitionBy("g").orderBy("logdet", "start")
    best = now.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")
    inside = chi2_quantile(0.975, p)
    kept = rows.join(best, "g").where(distance(features) <= inside).groupBy("g", "start").agg(*sums(features)).select("g", "start", *packed(p))
    return settle(solve(kept, features, floors, shrink_factor(0.975, p)), "estimates")


def grouped(rows: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Adds `g`: language and source, or the language, or all, whichever first has enough rows; null if none has."""
    pairs = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    langs = pairs.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    total = pairs.agg(F.sum("n").alias("n_all"))
    small = pairs.alias("p").join(langs.alias("l"), F.expr("p.lang <=> l.lang")).select("p.lang", "p.source", "n", "n_lang")
    every = total.select(F.col("n_all")).head()[0] or 0
    key = (F.when(F.col("n") >= min_group, F.to_json(F.struct("lang", "source")))
           .when(F.col("n_lang") >= min_group, F.concat(F.lit("language "), F.coalesce("lang", F.lit("unknown"))))
           .when(F.lit(every >= min_group), F.lit("all")))
    small = small.select(F.col("lang").alias("k_lang"), F.col("source").alias("k_source"), key.alias("g"))
    return rows.join(small, F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source"))).drop("k_lang", "k_source")


def judged(stats: DataFrame, tail: float = TAIL, min_group: int = MIN_GROUP) -> DataFrame:
    """`stats` with `base_failed`, the robust squared `distance`, and `kept`."""
    rows = settle(grouped(settle(stats, "statistics"), min_group), "grouped")
    fit = rows.where(F.col("g").isNotNull()).select("g", *FEATURES)
    best = estimates(fit).drop("start", "logdet")
    cutoff = tail_quantile(tail, len(FEATURES))
    out = rows.join(best, "g", "left").withColumn("distance", F.when(F.col("centre").isNotNull(), distance(FEATURES)))
    out = out.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).drop("centre", "inverse", "g", *FEATURES)


def quality(docs: DataFrame, tail: float = TAIL, min_group: int = MIN_GROUP) -> DataFrame:
    """Counts and verdict of every document."""
    return judged(statistics(docs), tail, min_group).select("doc_id", *COUNTS, "base_failed", "kept", "distance")


def accepted(docs: DataFrame, tail: float = TAIL, min_group: int = MIN_GROUP) -> DataFrame:
    """`docs` without the documents that the rules reject."""
    fine = judged(statistics(docs), tail, min_group).where("kept").select("doc_id", "mark").distinct().alias("fine")
    held = docs.alias("docs")
    of = F.xxhash64(*(F.col(f"docs.{c}").cast("string") for c in ("text", "lang", "source")))
    same = F.col("docs.doc_id").cast("long").eqNullSafe(F.col("fine.doc_id")) & (of == F.col("fine.mark"))
    return held.join(fine, same, "left_semi").select(*(F.col(f"docs.`{c}`") for c in docs.columns))
