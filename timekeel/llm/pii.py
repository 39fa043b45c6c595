"""Personal data by bootstrapped contextual extraction, with DataFrame operations alone.

Seeds are what the plain patterns find. Around every identifier-like token (one with a digit
or an at sign) the text gives lexical patterns: the two words before it, and the word
before with the word after. Patterns and instances (token texts) make a graph with one edge
per pattern and instance, weighted by the number of occurrences. Scores go to and fro: an
instance that is a seed scores 1 for its kind; a pattern scores the share of its weight that
lies on instances of a kind, held down for rare patterns; an unseen instance gets half the mean
of its patterns' scores, so evidence reaches further patterns in the next round. When no
score moves, tokens that stand in a high-confidence pattern and have the kind's coarse shape are
found as well.

Positions come from the plain matches in their order: a match starts at the first place,
after the one before, where its text occurs, because patterns are tried at every place.

Cases: null and empty texts have no spans; repeated rows and ids give repeated rows, and
count as evidence as often as they occur; other columns are not looked at; an empty table
gives an empty result. A token that overlaps a plain span adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timekeel.session import settle

from .common import id_and_text

KINDS = ("email", "ip", "card", "phone")
#: The plain patterns. Runs are taken whole (possessive), and a match starts only at a run's start or where the last match ended: the same matches, in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A run with fewer than 14 digits can't pass, so it need not be matched first.
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: What an instance of a kind looks like at least when its context alone speaks for it.
SHAPES = {
    "email": r"^[^\s@]+(?:@|\(at\)|\[at\])[^\s@]+$",
    "ip": r"^[0-9A-Fa-f]{1,4}(?:[.:_-][0-9A-Fa-f]{1,4}){3,7}$",
    "card": r"^(?:[0-9][._/-]?){13,18}[0-9]$",
    "phone": r"^\(?[0-9](?:[0-9()./_-]){7,16}[0-9]$",
}
#: Tokens that may be identifiers, and what is cut from their ends.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
OPENING, CLOSING = r"""^[("'\[<{]+""", r"""[)"'\]>},;:.!?]+$"""
#: Characters before and after a token in which its context words are looked for.
REACH = 64
CONFIDENCE, LEAST_INSTANCES, DAMPING = 0.8, 5, 2.0
#: What an unseen instance passes on of its patterns' mean score: evidence halves with each step away from a seed, so it soon comes to rest.
HOP = 0.5
SETTLED = 0.01


def positions(text: Column, found: Column) -> Column:
    """(start, match) of each match, starts counted from 0."""
    step = lambda acc, m: F.struct(
        (F.call_function("locate", m, text, acc["at"]) + F.length(m)).cast("int").alias("at"),
        F.concat(acc["spans"], F.array(F.struct((F.call_function("locate", m, text, acc["at"]) - 1).cast("int").alias("s"), m.alias("m")))).alias("spans"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<s:int,m:string>>").alias("spans"))
    return F.aggregate(found, start, step, lambda acc: acc["spans"])


def once(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """`keep` and new columns that are worked out once a row, however often they are used: a generator isn't merged with the projection above it."""
    made = F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))).alias("made")
    return rows.select(*keep, made).select(*keep, *(F.col("made")[name].alias(name) for name in columns))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """The check digit of a number of 14 to 19 digits."""
    place = F.sequence(F.lit(1), F.length(d))
    value = F.transform(place, lambda i: F.substring(d, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # Zeros in front do not count; more than three other digits are over 255.
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).cast("int"), F.lit(0)) <= 255))
    n = F.length(digits(m))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.when((n >= 14) & (n <= 19), luhn(digits(m))).otherwise(False)


def found_spans(docs: DataFrame) -> DataFrame:
    """`doc_id`, `text`, the plain spans in order as (start, kind number, end, match), and identifier-like tokens with their starts."""
    rows = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = once(rows, ["doc_id", "text"], at=F.contains("text", F.lit("@")), digit=F.col("text").rlike("[0-9]"))
    none = F.array().cast("array<string>")
    made = {}
    for k, kind in enumerate(KINDS):
        need = F.col("at") if kind == "email" else F.col("digit")
        if NEEDS[kind]:
            need = need & F.contains("text", F.lit(NEEDS[kind]))
        made[kind] = spans_of(k, kind, positions(F.col("text"), F.when(need, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none)))
    made["tokens"] = positions(F.col("text"), F.when(F.col("at") | F.col("digit"), F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).otherwise(none))
    rows = once(rows, ["doc_id", "text"], **made)
    return once(rows, ["doc_id", "text", "tokens"], plain=F.array_sort(F.concat(*KINDS)))


def spans_of(k: int, kind: str, placed: Column) -> Column:
    fine = F.filter(placed, lambda x: passes(kind, x["m"]))
    return F.transform(fine, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), (x["s"] + F.length(x["m"])).alias("e"), x["m"].alias("m")))


MENTION = "array<struct<s:int,k:int,e:int,m:string,before:string,around:string>>"


def word(c: Column) -> Column:
    """A context word: lower case, without marks at its ends."""
    return F.lower(F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def in_context(text: Column, x: Column) -> Column:
    """A span with its two patterns: the two words before, and the words on either side."""
    left = F.substring(text, F.greatest(F.lit(1), x["s"] + 1 - REACH), F.least(F.lit(REACH), x["s"]))
    right = F.substring(text, x["e"] + 1, F.lit(REACH))
    near = word(F.regexp_extract(left, r"(\S+)\s*$", 1))
    far = word(F.regexp_extract(left, r"(\S+)\s+\S+\s*$", 1))
    after = word(F.regexp_extract(right, r"^\S*\s*(\S+)", 1))
    return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["m"].alias("m"), F.concat(far, F.lit(" "), near, F.lit(" _")).alias("before"), F.concat(near, F.lit(" _ "), after).alias("around"))


def mentions(docs: DataFrame) -> DataFrame:
    """Each document's plain spans and identifier-like tokens that overlap none, with their patterns, and a row number."""
    rows = found_spans(docs)

    def trimmed(x: Column) -> Column:
        opened = F.regexp_replace(x["m"], OPENING, "")
        inner = F.regexp_replace(opened, CLOSING, "")
        start = (x["s"] + F.length(x["m"]) - F.length(opened)).cast("int")
        return F.struct(start.alias("s"), F.lit(None).cast("int").alias("k"), (start + F.length(inner)).alias("e"), inner.alias("m"))

    rows = once(rows, ["doc_id", "text", "plain"], tokens=F.transform("tokens", trimmed))
    free = F.filter("tokens", lambda t: (F.length(t["m"]) >= 5) & ~F.exists("plain", lambda p: (t["s"] < p["e"]) & (p["s"] < t["e"])))
    both = F.concat(F.col("plain").cast("array<struct<s:int,k:int,e:int,m:string>>"), free)
    found = F.transform(both, lambda x: in_context(F.col("text"), x)).cast(MENTION)
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.transform("plain", lambda x: F.struct(x["s"], x["k"], x["e"])).cast("array<struct<s:int,k:int,e:int>>").alias("plain"), found.alias("found"))


def graph(found: DataFrame, least: int) -> DataFrame:
    """Edges (pattern, instance, kind of a seed or null, n) of patterns that hold `least` different instances."""
    each = found.select(F.explode("found").alias("x")).select(F.col("x.m").alias("instance"), F.col("x.k").alias("kind"), F.explode(F.array("x.before", "x.around")).alias("pattern"))
    edges = each.groupBy("pattern", "instance", "kind").agg(F.count(F.lit(1)).alias("n"))
    wide = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= least)
    return settle(edges.join(wide, "pattern").select("pattern", "instance", "kind", "n"), "edges")


def pattern_scores(edges: DataFrame) -> DataFrame:
    """Score of each pattern for each kind, when evidence no longer moves."""
    kinds = F.array(*(F.lit(k) for k in range(len(KINDS))))
    seeds = [F.when(F.col("kind") == k, 1.0).otherwise(0.0) for k in range(len(KINDS))]
    instances = settle(edges.groupBy("instance").agg(F.max("kind").alias("kind")).select("instance", "kind", F.array(*seeds).alias("score")), "instances")
    scores, patterns, moving = instances.select("instance", "score"), None, True
    while moving:
        weighed = edges.join(scores, "instance")
        patterns = weighed.groupBy("pattern").agg(*(F.sum(F.col("n") * F.col("score")[k]).alias(f"p{k}") for k in range(len(KINDS))), F.sum("n").alias("n"))
        patterns = settle(patterns.select("pattern", F.transform(kinds, lambda k: F.element_at(F.array(*(F.col(f"p{i}") for i in range(len(KINDS)))), k + 1) / (F.col("n") + DAMPING)).alias("score")), "patterns")
        told = edges.join(patterns, "pattern").groupBy("instance").agg(*(F.sum(F.col("n") * F.col("score")[k]).alias(f"p{k}") for k in range(len(KINDS))), F.sum("n").alias("n"))
        told = instances.withColumnRenamed("score", "seed").join(told, "instance").withColumn("mean", F.array(*(HOP * F.col(f"p{k}") / F.col("n") for k in range(len(KINDS)))))
        # Seeds keep their score.
        told = told.select("instance", F.when(F.col("kind").isNull(), F.col("mean")).otherwise(F.col("seed")).alias("score"))
        both = settle(told.join(scores.withColumnRenamed("score", "old"), "instance"), "scores")
        moving = both.where(F.exists(F.zip_with("score", "old", lambda a, b: F.abs(a - b) > SETTLED), lambda x: x)).limit(1).count() > 0
        scores = both.select("instance", "score")
    return patterns


def find_personal_data(docs: DataFrame, confidence: float = CONFIDENCE, least: int = LEAST_INSTANCES) -> DataFrame:
    """Plain spans of every document and those that confident patterns add."""
    rows = settle(mentions(docs), "mentions")
    patterns = pattern_scores(graph(rows.where(F.size("found") > 0), least))
    sure = patterns.select("pattern", F.posexplode("score").alias("kind", "score")).where(F.col("score") >= confidence)
    free = rows.select("row", F.explode("found").alias("x")).where(F.col("x.k").isNull())
    free = free.select("row", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.m").alias("m"), F.explode(F.array("x.before", "x.around")).alias("pattern"))
    shape = F.lit(False)
    for k, kind in enumerate(KINDS):
        shape = shape | ((F.col("kind") == k) & F.col("m").rlike(SHAPES[kind]))
    added = free.join(sure, "pattern").where(shape).groupBy("row").agg(F.collect_set(F.struct("s", F.col("kind").cast("int").alias("k"), "e")).alias("added"))
    out = rows.join(added, "row", "left")
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    every = F.array_sort(F.array_distinct(F.concat("plain", F.coalesce("added", none))))
    names = F.array(*(F.lit(k) for k in KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("plain", lambda x: x["k"] == k)).cast("long")
    counted = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select("doc_id", *counted, F.sha2(joined(F.col("plain")).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"))
