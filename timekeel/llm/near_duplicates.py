"""Near-duplicates by bottom-k sketches from one hash function.

1. Every text becomes the sorted hashes of its distinct word shingles; texts with equal sets
   form a class, and the class goes on as its smallest id. A class keeps the `SKETCH` smallest
   hashes of its set.
2. Inverted lists of the `INDEXED` smallest hashes give pairs. The first hash that two sets
   have in common (in the order of hashes) is among those of both, unless that many differing
   hashes come before it: a chance of 0.25^24 at a similarity of 0.75.
3. A hash in more than `COMMON` lists' rows (a passage that many documents share, a large group
   of copies) makes no list. Documents that have one keep a longer sketch (`LONG`), ordered
   from rare to common, and only the part of it that a linked pair must share makes lists: for
   sets that fit whole, all but 75 % and one; else all but 56 % and one (a similar pair shares
   fewer with a chance under 1e-9). Shared passages come last in that order, so documents that
   share a passage and little else meet in no list.
4. In each list every member is compared with one centre, the member with the least before
   that hash. Members that are then in one component with the list's largest need no more
   comparisons among themselves; the others are compared with every member of another component,
   each pair in the first list that it shares. So lists cost about their length, no link between components is missed, and components
   are exact.
5. A pair is first dropped if what stands before the common hash leaves too little to share
   (of the longer-reaching sketch only what lies below the other's end for sure),
   then if its bottom-k union sketch shares under 39 % (chance under 1e-8 for a similar pair),
   and is then confirmed on the whole sets of both texts.
6. Components come from alternating large and small stars over the links.

Cases: a text without words has an empty set and stays alone; a null id is linked with
nothing, has no component, and is kept; rows that share an id are judged by their own texts;
repeated rows form one class; other columns are not looked at; an empty table gives an empty
result. With equal ids for choice, the smallest is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timekeel.session import settle

from .common import id_and_text, ship
from .shingles import shingle_set

SKETCH, INDEXED, COMMON, LONG = 64, 24, 32, 256
#: Largest sets of which the long sketch must keep as much as of whole sets, and what other sets must share.
WHOLE, SHARED = 192, 0.56
#: Standard deviations of slack where a place in the long sketch stands for one in the set.
SLACK = 5
ESTIMATE = 0.39
#: Where the sketch of a set that fits whole ends.
END = (1 << 63) - 1
#: What a list holds of each member.
MEMBER = ("rep", "n", "end", "before", "least_before")
#: A link: 100 times the intersection is at least 75 times the union.
PERCENT = 75


def sketches(docs: DataFrame) -> DataFrame:
    """Set size, fingerprint of the set, and its smallest hashes, for every text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py()) for t in b.column(1)]
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), lists([s[:SKETCH] for s in sets])], names=["doc_id", "mark", "n", "print", "sketch"])

    return id_and_text(docs).withColumn("mark", F.xxhash64("text")).mapInArrow(rows, "doc_id long, mark long, n long, print binary, sketch array<long>")


def lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *parts]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def may_link(a: str, b: str) -> Column:
    """Whether enough stands at and after the common hash: the overlap must be 3/7 of both sizes.

    `a` and `b` are prefixes of columns. Values above the end of the other's sketch may be in the other set, so
    only the side whose sketch ends first counts all that stands before; the other counts `least_before`.
    """
    left = [F.col(f"{x}n") - F.when(F.col(f"{x}end") <= F.col(f"{y}end"), F.col(f"{x}before")).otherwise(F.col(f"{x}least_before")) for x, y in ((a, b), (b, a))]
    return 7 * F.least(*left) >= 3 * (F.col(f"{a}n") + F.col(f"{b}n"))


def must() -> Column:
    """How many values of its long sketch a set of `n` shares with that of any set linked to it."""
    return F.ceil(F.when(F.col("n") <= WHOLE, 0.75).otherwise(SHARED) * F.least("n", F.lit(LONG)))


def long_postings(texts: DataFrame) -> DataFrame:
    """List entries of documents with a common hash: the part of the long sketch, from rare to common, that a link must share."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py()) for t in b.column(1)]
            ends = [int(s[LONG - 1]) if len(s) > LONG else END for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ends, pa.int64()), lists([s[:LONG] for s in sets])], names=["rep", "n", "end", "sketch"])

    held = texts.select("rep", "text").mapInArrow(rows, "rep long, n long, end long, sketch array<long>")
    # A linked set's sketch has as many of these values as `must` says, so it ends at or after that many: low ones are below its end.
    each = settle(held.select("rep", "n", "end", F.posexplode("sketch").alias("at", "value")).select("rep", "n", "end", "value", (F.col("at") < must()).alias("low")), "long")
    often = each.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = each.join(often, "value").groupBy("rep", "n", "end").agg(F.sort_array(F.collect_list(F.struct("df", "value", "low"))).alias("shared"))
    shared = shared.join(each.where("low").groupBy("rep").agg(F.count(F.lit(1)).alias("lows")), "rep")
    kept = F.least("n", F.lit(LONG))
    # The low values that no other sketch has stand first.
    low_alone = F.col("lows") - F.size(F.filter("shared", lambda x: x["low"]))
    placed = shared.select("rep", "n", "end", "lows", (kept - must() + 1).alias("prefix"), (kept - F.size("shared")).alias("alone"), low_alone.alias("low_alone"), F.posexplode("shared").alias("k", "entry"))
    # How many low ones stand before: a running count along the order.
    order = Window.partitionBy("rep").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("low_place", F.col("low_alone") + F.coalesce(F.sum(F.col("entry.low").cast("int")).over(order), F.lit(0)))
    place = F.col("alone") + F.col("k")

    def before(place: Column, of: Column) -> Column:
        # The sketch is a draw without replacement from the set, so the share before a hash is known with this deviation.
        share = place / of
        deviation = F.sqrt(share * (1 - share) / of * (1 - of / F.col("n")))
        return F.when(F.col("n") <= LONG, place).otherwise(F.floor(F.col("n") * F.greatest(F.lit(0.0), share - SLACK * deviation))).cast("long")

    out = placed.where(place < F.col("prefix")).select(F.lit(1).alias("kind"), F.col("entry.value").alias("value"), "rep", "n", "end", place.cast("long").alias("at"), before(place, F.lit(LONG)).alias("before"), before(F.col("low_place"), F.col("lows")).alias("least_before"))
    return out.where(4 * F.col("least_before") <= F.col("n"))


def centre_pairs(postings: DataFrame) -> DataFrame:
    centres = postings.groupBy("kind", "value").agg(F.min(F.struct((F.col("before") / F.col("n")).alias("share"), *MEMBER)).alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1")
    both = postings.join(centres.select("kind", "value", *(F.col(f"c.{x}").alias(f"c_{x}") for x in MEMBER)), ["kind", "value"])
    both = both.where((F.col("rep") != F.col("c_rep")) & may_link("", "c_"))
    return both.select(F.least("rep", "c_rep").alias("a"), F.greatest("rep", "c_rep").alias("b")).distinct()


def other_pairs(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of one list in different components; every such pair has a member outside the list's largest component.

    A pair is made in the first list that both are in alone. Lists have one order, and what is
    before a hash only grows along it, so a pair that a later list would make the first one makes.
    """
    known = settle(postings.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("part", F.coalesce("label", "rep")).drop("label"), "parts")
    sizes = known.groupBy("kind", "value", "part").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("kind", "value").agg(F.max(F.struct("size", (-F.col("part")).alias("part"))).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    main = main.select("kind", "value", (-F.col("m.part")).alias("main"))
    # The lists of one document before this one, of those with several components: at most its prefix.
    order = Window.partitionBy("kind", "rep").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    mixed = settle(known.join(main, ["kind", "value"]).withColumns({"earlier": F.collect_list("value").over(order), "odd": F.col("part") != F.col("main")}).drop("main", "at"), "mixed")
    odd = mixed.where("odd").select("kind", "value", *(F.col(c).alias(f"x_{c}") for c in (*MEMBER, "part", "earlier")))
    # Of two odd members one asks the other.
    once = ~F.col("odd") | (F.col("x_rep") < F.col("rep"))
    both = odd.join(mixed, ["kind", "value"]).where((F.col("x_part") != F.col("part")) & once & may_link("", "x_") & ~F.arrays_overlap("earlier", "x_earlier"))
    return both.select(F.least("rep", "x_rep").alias("a"), F.greatest("rep", "x_rep").alias("b")).distinct()


def confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs that pass the estimate from sketches and then the test on whole sets."""
    sides = pairs
    for s in "ab":
        sides = sides.join(reps.select(F.col("rep").alias(s), F.col("sketch").alias(f"sketch_{s}")), s)
    union = F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
    common = F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union)
    likely = settle(sides.where(F.size(common) >= ESTIMATE * F.size(union)).select("a", "b"), "likely")
    whole = likely
    for s in "ab":
        whole = whole.join(texts.select(F.col("rep").alias(s), F.col("text").alias(f"text_{s}")), s)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict = {}

        def held(i, text):
            # A centre meets many others, one after the other.
            if last.get("id") != i:
                last.update(id=i, set=shingle_set(text.as_py()))
            return last["set"]

        for b in batches:
            keep = []
            for a, text_a, text_b in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                one, two = held(a, text_a), shingle_set(text_b.as_py())
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * shared >= PERCENT * (len(one) + len(two) - shared))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return settle(whole.select("a", "b", "text_a", "text_b").mapInArrow(rows, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """`node` and `label`, the smallest node that it is connected with, for every node of a link."""
    now = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    now, mark = settle(now, "edges"), None
    while True:
        # Large star: each node's larger neighbours to the smallest of its neighbourhood.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = settle(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # Small star: each node and its smaller neighbours to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = settle(small.where("u != v").distinct(), "small")
        after = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).head()
        if after == mark:
            break
        mark = after
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Set size, component and verdict of every document."""
    return judged(docs).drop("mark")


def judged(docs: DataFrame) -> DataFrame:
    """The verdicts, with a mark of the text that tells rows of one id apart."""
    ship(docs.sparkSession)
    every = settle(sketches(docs), "sketches")
    able = every.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = settle(able.groupBy("print", "n").agg(F.min(F.struct("doc_id", "sketch")).alias("m")).select("print", "n", F.col("m.doc_id").alias("rep"), F.col("m.sketch").alias("sketch")), "classes")

    entries = classes.select("rep", "n", F.posexplode(F.slice("sketch", 1, INDEXED)).alias("before", "value"))
    often = entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    entries = settle(entries.join(often, "value"), "entries")
    met = entries.groupBy("rep").agg(F.max("df").alias("most"))
    texts = id_and_text(docs).where(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "rep").join(met, "rep")
    texts = settle(texts, "texts")
    short = entries.where(F.col("df") <= COMMON).select(F.lit(0).alias("kind"), "value", "rep", "n", F.lit(END).alias("end"), F.col("before").cast("long").alias("at"), F.col("before").cast("long").alias("before"), F.col("before").cast("long").alias("least_before")).where(4 * F.col("before") <= F.col("n"))
    postings = settle(short.unionByName(long_postings(texts.where(F.col("most") > COMMON))), "postings")

    first = settle(centre_pairs(postings), "centre_pairs")
    links = confirmed(first, classes, texts)
    second = other_pairs(postings, components(links)).join(first, ["a", "b"], "left_anti")
    more = confirmed(second, classes, texts)
    labels = components(links.unionByName(more))

    out = every.select("doc_id", "mark", "n", "print").join(classes.select(F.col("print").alias("c_print"), F.col("n").alias("c_n"), "rep"), (F.col("print") == F.col("c_print")) & (F.col("n") == F.col("c_n")), "left")
    out = out.join(labels, out["rep"] == labels["node"], "left")
    part = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("label", "rep", "doc_id"))
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), part.alias("component_id"), F.coalesce(part == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` without documents that belong to the component of a smaller id; of rows that share an id each is judged by its own text."""
    gone = judged(docs).where(~F.col("kept")).select(F.col("doc_id").alias("id"), "mark").distinct().alias("gone")
    same = (F.col("docs.doc_id").cast("long") == F.col("gone.id")) & (F.xxhash64(F.col("docs.text").cast("string")) == F.col("gone.mark"))
    return docs.alias("docs").join(gone, same, "left_anti").select(*(F.col(f"docs.`{c}`") for c in docs.columns))
