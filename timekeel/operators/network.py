"""The link graph journeys run over, and searches on it.

Searches are rounds of equality joins on edge tables. A round writes what it improves to the
shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geodesy
from ..session import scratch_path, settle
from .journeys import JOURNEY, changed_only
from .ordered import Track, count_of, first_by, neighbours, running

# Fixed values.
SKIP_DETOUR_RATIO = 1.3
PLACE_METRES = 300

#: Nodes whose distances bound the searches.
LANDMARKS = 4


def hops(stops: DataFrame, t: Track) -> tuple[DataFrame, DataFrame]:
    """(hops, passed): steps between consecutive placed stations of a journey, and the
    locations without a place that lie within each step.

    `stops` carries `placed`. A step from a station to itself is skipped.
    """
    ranked = running(stops, t, {"hop": count_of(F.col("placed"))})
    ends = neighbours(ranked.where("placed"), t, "hop", {"to_code": ("location_code", 1)})
    steps = ends.where(F.col("to_code").isNotNull() & (F.col("to_code") != F.col("location_code"))).select(
        *JOURNEY, "hop",
        F.least("location_code", "to_code").alias("a"), F.greatest("location_code", "to_code").alias("b"),
    )
    between = ranked.where(~F.col("placed")).select(*JOURNEY, "hop", F.col("location_code").alias("point"))
    return steps, between.join(steps, [*JOURNEY, "hop"]).select("a", "b", "point").distinct()


def links(steps: DataFrame, passed: DataFrame) -> DataFrame:
    """Per undirected link: distinct services, runs, and the points passed on the way."""
    counts = steps.groupBy("a", "b").agg(
        F.countDistinct("train_code").alias("services"), F.count(F.lit(1)).alias("runs"))
    points = passed.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("points"), F.array_join(F.array_sort(F.collect_set("point")), ",").alias("passes_unplaced"))
    return counts.join(points, ["a", "b"], "left").withColumns({
        "points": F.coalesce("points", F.lit(0)), "passes_unplaced": F.coalesce("passes_unplaced", F.lit(""))})


def with_length(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Straight-line metres between the ends; a link without both places goes."""
    p = places.select("code", "x", "y")
    pa = p.withColumnsRenamed({"code": "a", "x": "ax", "y": "ay"})
    pb = p.withColumnsRenamed({"code": "b", "x": "bx", "y": "by"})
    metres = geodesy.metres_between("ax", "ay", "bx", "by")
    return edges.join(pa, "a").join(pb, "b").withColumn("metres", metres).drop("ax", "ay", "bx", "by")


def arcs(edges: DataFrame) -> DataFrame:
    there = edges.select(F.col("a").alias("node"), F.col("b").alias("next"), "metres")
    return there.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("next"), "metres"))


def distances(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """Shortest way in metres from each `source` to every node that it reaches."""
    roads = settle(arcs(edges), "arcs")
    start = sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist"))

    def ahead(last: DataFrame, seen: DataFrame) -> DataFrame:
        return last.join(roads, "node").select("source", F.col("next").alias("node"), (F.col("dist") + F.col("metres")).alias("dist"))

    return _rounds(start, ["source", "node"], ["dist"], ahead).groupBy("source", "node").agg(F.min("dist").alias("dist"))


def _rounds(start: DataFrame, keys: list[str], value: list[str], ahead: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Relaxation until a round improves nothing.

    A round extends only what the last one improved, and writes only what it improves itself,
    as a part of its own beside the earlier ones: nothing that is known is written again.
    """
    spark, path = start.sparkSession, scratch_path(start.sparkSession, "reach")
    start.write.parquet(f"{path}/round=0")
    schema = T.StructType([*start.schema.fields, T.StructField("round", T.IntegerType())])
    turn = 0
    while True:
        turn += 1
        seen = spark.read.schema(schema).parquet(path)
        found = ahead(seen.where(F.col("round") == turn - 1), seen).select(start.columns)
        found = first_by(found, keys, value)
        known = seen.groupBy(*keys).agg(F.min(F.struct(*value)).alias("_known"))
        better = found.join(known, keys, "left").where(F.col("_known").isNull() | (F.struct(*value) < F.col("_known")))
        better.select(start.columns).write.parquet(f"{path}/round={turn}")
        if spark.read.schema(start.schema).parquet(f"{path}/round={turn}").isEmpty():
            return spark.read.schema(schema).parquet(path).drop("round")


def landmarks(edges: DataFrame, count: int = LANDMARKS) -> DataFrame:
    """For every node its distances to `count` fixed nodes, null where there is no way.

    The difference of two nodes' distances to a landmark is never more than the way between
    them, and removing links only lengthens ways, so the marks of a graph serve its parts.
    """
    ends = edges.select(F.explode(F.array("a", "b")).alias("source")).distinct()
    names = [r["source"] for r in ends.orderBy(F.xxhash64("source"), "source").limit(count).collect()]
    far = distances(ends.where(F.col("source").isin(names)), edges).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("source", "dist"))).alias("_far"))
    marks = F.array(*[F.try_element_at("_far", F.lit(n)) for n in names]) if names else F.array().cast("array<double>")
    return settle(far.select("node", marks.alias("marks")), "marks")


def _at_least(here: Column, there: Column) -> Column:
    """Metres that the way between two marked nodes has at least."""
    gaps = F.zip_with(here, there, lambda x, y: F.abs(x - y))
    return F.coalesce(F.array_max(gaps), F.lit(0.0))


def shortest(wanted: DataFrame, edges: DataFrame, skip_own: bool = False, marks: DataFrame | None = None) -> DataFrame:
    """Shortest chain per wanted (a, b), not using the link a-b itself when `skip_own`.

    A chain is extended only while it and what its end is away from `b`, at least, stay within
    the best chain found so far, and within the pair's `limit` where `wanted` has that column.
    """
    marks = landmarks(edges) if marks is None else marks
    roads = settle(arcs(edges).join(marks.withColumnsRenamed({"node": "next", "marks": "next_marks"}), "next", "left"), "arcs")
    limit = F.col("limit").cast("double") if "limit" in wanted.columns else F.lit(None).cast("double")
    goal = marks.withColumnsRenamed({"node": "b", "marks": "goal"})
    start = wanted.select("a", "b", limit.alias("limit")).join(goal, "b", "left").select(
        "a", "b", "limit", "goal", F.col("a").alias("node"), F.lit(0.0).alias("dist"), F.array("a").alias("path"))

    def ahead(last: DataFrame, seen: DataFrame) -> DataFrame:
        done = seen.where(F.col("node") == F.col("b")).groupBy("a", "b").agg(F.min("dist").alias("_best"))
        step = last.where((F.col("node") != F.col("b")) | (F.size("path") == 1)).join(roads, "node")
        if skip_own:
            step = step.where(~((F.least("node", "next") == F.least("a", "b")) & (F.greatest("node", "next") == F.greatest("a", "b"))))
        at = F.col("dist") + F.col("metres")
        most = F.least("limit", "_best")
        # A little more than the bound, as sums of lengths are rounded.
        within = at + _at_least(F.col("next_marks"), F.col("goal")) <= most * (1 + 1e-9)
        return step.join(done, ["a", "b"], "left").where(most.isNull() | within).select(
            "a", "b", "limit", "goal", F.col("next").alias("node"), at.alias("dist"), F.concat("path", F.array("next")).alias("path"))

    best = _rounds(start, ["a", "b", "node"], ["dist", "path"], ahead).where((F.col("node") == F.col("b")) & (F.size("path") > 1))
    return first_by(best, ["a", "b"], ["dist", "path"]).select("a", "b", "dist", "path")


def detours(edges: DataFrame, of: DataFrame | None = None, ratio: float | None = None, marks: DataFrame | None = None) -> DataFrame:
    """For every link (or those of `of`), the best other chain between its ends over the
    link's own length; with `ratio`, only chains up to that many times the length."""
    asked = edges if of is None else edges.join(of.select("a", "b"), ["a", "b"], "left_semi")
    asked = asked.select("a", "b", "metres")
    alt = shortest(asked if ratio is None else asked.withColumn("limit", F.col("metres") * ratio), edges, skip_own=True, marks=marks)
    return asked.join(alt, ["a", "b"]).select(
        "a", "b", "metres", F.col("dist").alias("chain_metres"), (F.col("dist") / F.col("metres")).alias("ratio"),
        (F.size("path") - 2).alias("via"), "path")


def _own_points(cand: DataFrame, points: DataFrame) -> DataFrame:
    """Points a link passes that lie neither on the chain nor on any of its links."""
    legs = cand.withColumn("_leg", F.explode(F.arrays_zip(
        F.slice("path", 1, F.size("path") - 1).alias("u"), F.slice("path", 2, F.size("path") - 1).alias("v"))))
    on_legs = legs.select(
        F.col("a").alias("la"), F.col("b").alias("lb"),
        F.least("_leg.u", "_leg.v").alias("a"), F.greatest("_leg.u", "_leg.v").alias("b"),
    ).join(points, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b"), "point")
    on_chain = cand.select("a", "b", F.explode("path").alias("point"))
    mine = points.join(cand.select("a", "b"), ["a", "b"], "left_semi")
    return mine.join(on_legs.unionByName(on_chain), ["a", "b", "point"], "left_anti").select("a", "b").distinct()


def remove_skips(edges: DataFrame, points: DataFrame, ratio: float = SKIP_DETOUR_RATIO) -> DataFrame:
    """Links with a verdict: removed as express skips, kept for their own points, or kept.

    A link is judged on the graph without the longer links already removed. Removing links
    only lengthens chains, so the candidates are found once on the whole graph. Each round
    judges every candidate whose best chain uses no longer link still undecided: no later
    removal can change that chain. The longest undecided one always qualifies.
    """
    live = settle(edges.select("a", "b", "metres"), "links")
    marks = landmarks(live)
    verdicts = None
    open_ = None
    while True:
        found = detours(live, open_, ratio, marks)
        near = settle(found.where((F.col("via") > 0) & (F.col("ratio") <= ratio)), "near")
        if near.isEmpty():
            break
        legs = near.withColumn("_leg", F.explode(F.arrays_zip(
            F.slice("path", 1, F.size("path") - 1).alias("u"), F.slice("path", 2, F.size("path") - 1).alias("v")))).select(
            F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("metres").alias("cm"),
            F.least("_leg.u", "_leg.v").alias("a"), F.greatest("_leg.u", "_leg.v").alias("b"))
        waiting = near.select("a", "b", F.col("metres").alias("wm"))
        longer = legs.join(waiting, ["a", "b"]).where(
            (F.col("wm") > F.col("cm")) | ((F.col("wm") == F.col("cm")) & (F.struct("a", "b") < F.struct(F.col("ca").alias("a"), F.col("cb").alias("b")))))
        blocked = longer.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        ready = near.join(blocked, ["a", "b"], "left_anti")
        own = _own_points(ready, points).withColumn("_own", F.lit(True))
        judged = settle(ready.join(own, ["a", "b"], "left").select(
            "a", "b", F.when(F.col("_own"), "kept_own_points").otherwise("removed").alias("verdict")), "judged")
        verdicts = judged if verdicts is None else verdicts.unionByName(judged)
        live = settle(live.join(judged.where("verdict = 'removed'"), ["a", "b"], "left_anti"), "links")
        open_ = settle(near.join(judged, ["a", "b"], "left_anti").select("a", "b"), "open")
        if open_.isEmpty():
            break
    out = edges.select("a", "b", "metres")
    if verdicts is None:
        return out.withColumn("verdict", F.lit("kept"))
    return out.join(verdicts, ["a", "b"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("kept")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Component of every node: the smallest code that can be reached from it.

    Labels pass along links and each round also jumps to the label's own label, so long
    chains close in few rounds.
    """
    roads = settle(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), "roads")
    label = settle(nodes.select(F.col("code"), F.col("code").alias("label")), "labels")
    while True:
        told = label.join(roads, label["code"] == roads["u"]).groupBy(F.col("v").alias("code")).agg(F.min("label").alias("_n"))
        near = label.join(told, "code", "left").select("code", "label", F.least("label", "_n").alias("_m"))
        jump = label.select(F.col("code").alias("_m"), F.col("label").alias("_j"))
        new = settle(near.join(jump, "_m", "left").select("code", F.col("label").alias("was"), F.least("_m", "_j").alias("label")), "labels")
        if new.where(F.col("was") != F.col("label")).isEmpty():
            return new.select("code", "label")
        label = new.select("code", "label")


def stations_over_link(stops: DataFrame, t: Track) -> DataFrame:
    """For each link, every placed station any journey running over it calls at or passes.

    A journey's station set is bounded by the number of stations, and equal sets on a link
    are merged before they are opened.
    """
    seq = changed_only(stops.where("placed"), t, "location_code")
    steps, _ = hops(seq.withColumn("placed", F.lit(True)), t)
    sets = seq.groupBy(*JOURNEY).agg(F.array_sort(F.collect_set("location_code")).alias("_set"))
    met = steps.select(*JOURNEY, "a", "b").distinct().join(sets, list(JOURNEY)).select("a", "b", "_set").distinct()
    return met.select("a", "b", F.explode("_set").alias("code")).distinct()


def shared(stations: DataFrame, keys: list[Column]) -> DataFrame:
    """Groups of several codes under one key (a name, a position)."""
    return stations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes")
    ).where("n > 1")


def ranked_places(stations: DataFrame, edges: DataFrame, major: tuple[str, ...]) -> DataFrame:
    """One mark per place, major names first, then by services of the links that meet there."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("code"), "services")
    degree = ends.groupBy("code").agg(F.sum("services").alias("degree"))
    placed = stations.join(degree, "code")
    cell = [F.lower("name").alias("_nm"), F.round(F.col("x") / PLACE_METRES).alias("_cx"), F.round(F.col("y") / PLACE_METRES).alias("_cy")]
    one = first_by(placed.select("*", *cell), ["_nm", "_cx", "_cy"], ["code"]).drop("_nm", "_cx", "_cy")
    place = F.array_position(F.array(*[F.lit(m) for m in major]), F.col("name"))
    return one.select("code", "name", "degree", F.when(place > 0, place).otherwise(99).alias("precedence"))


def compare_lists(feed: DataFrame, listed: DataFrame) -> DataFrame:
    """Codes in one list only, and codes whose names differ."""
    f = feed.select("code", F.col("name").alias("feed_name"))
    met = f.join(listed.select("code", F.col("name").alias("list_name")), "code", "full")
    kind = (
        F.when(F.col("list_name").isNull(), "feed_only").when(F.col("feed_name").isNull(), "list_only")
        .when(~F.col("feed_name").eqNullSafe(F.col("list_name")), "renamed")
    )
    return met.withColumn("difference", kind).where(F.col("difference").isNotNull())


def thin_links(link_table: DataFrame, at_most: int = 2) -> DataFrame:
    return link_table.where(F.col("services") <= at_most)
