"""Running values over ordered groups, exact for groups of any length.

A window over a group sorts the whole group in one task. That is the cheapest plan for
ordinary journeys, so it is used after a check of the longest group. Where one group is
longer than a task should hold, the same values are computed per piece of the group and
carried across pieces: each piece is one task's work, and only one row per piece is
ordered over the whole group.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_GROUP_ROWS = 1_000_000
MAX_GROUP_ROWS_CONF = "timekeel.maxGroupRows"


@dataclass(frozen=True)
class Track:
    """Group keys, row order, and the column expression that cuts a long group."""

    keys: tuple[str, ...]
    by: tuple[str, ...]
    piece: str
    long: bool = False

    def ordered(self, *by: str, piece: str | None = None) -> "Track":
        return replace(self, by=tuple(by), piece=piece or self.piece)


def track(df: DataFrame, keys, by, piece: str, max_rows: int | None = None) -> Track:
    """Check the longest group and choose the plan. `piece` must not decrease along `by`."""
    if max_rows is None:
        max_rows = int(df.sparkSession.conf.get(MAX_GROUP_ROWS_CONF, str(MAX_GROUP_ROWS)))
    longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return Track(tuple(keys), tuple(by), piece, longest > max_rows)


@dataclass(frozen=True)
class Running:
    kind: str
    value: Column
    before: bool


def count_of(condition: Column | None = None, before: bool = False) -> Running:
    one = F.lit(1) if condition is None else F.when(condition, 1).otherwise(0)
    return Running("sum", one, before)


def total_of(value: Column, before: bool = False) -> Running:
    return Running("sum", value, before)


def lowest_of(value: Column, before: bool = False) -> Running:
    return Running("min", value, before)


def highest_of(value: Column, before: bool = False) -> Running:
    return Running("max", value, before)


def latest_before(value: Column) -> Running:
    """The last non-null value on an earlier row."""
    return Running("last", value, True)


_OVER = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _joined(kind: str, local: Column, carried: Column) -> Column:
    if kind == "sum":
        return F.coalesce(local + carried, local, carried)
    if kind == "min":
        return F.least(local, carried)
    if kind == "max":
        return F.greatest(local, carried)
    return F.coalesce(local, carried)


def running(df: DataFrame, t: Track, values: Mapping[str, Running]) -> DataFrame:
    """Add running columns along each group."""
    def frame(w, before):
        return w.rowsBetween(Window.unboundedPreceding, -1 if before else 0)

    if not t.long:
        w = Window.partitionBy(*t.keys).orderBy(*t.by)
        return df.withColumns(
            {n: _OVER[v.kind](v.value).over(frame(w, v.before)) for n, v in values.items()}
        )

    cut = df.withColumn("_piece", F.expr(t.piece))
    keys = [*t.keys, "_piece"]
    per_piece = cut.groupBy(*keys).agg(
        *[
            (
                F.max_by(v.value, F.when(v.value.isNotNull(), F.struct(*t.by)))
                if v.kind == "last"
                else _OVER[v.kind](v.value)
            ).alias(f"_in_{n}")
            for n, v in values.items()
        ]
    )
    along = frame(Window.partitionBy(*t.keys).orderBy("_piece"), True)
    carried = per_piece.select(
        *keys, *[_OVER[v.kind](F.col(f"_in_{n}")).over(along).alias(f"_in_{n}") for n, v in values.items()]
    )
    w = Window.partitionBy(*keys).orderBy(*t.by)
    local = cut.withColumns(
        {f"_at_{n}": _OVER[v.kind](v.value).over(frame(w, v.before)) for n, v in values.items()}
    )
    out = local.join(_safe(carried, keys), _same(keys), "left")
    return out.select(
        *[c for c in df.columns if c not in values],
        *[_joined(v.kind, F.col(f"_at_{n}"), F.col(f"_in_{n}")).alias(n) for n, v in values.items()],
    )


def neighbours(df: DataFrame, t: Track, rank: str, values: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Add columns read from the row `offset` ranks away; `rank` is dense from 1."""
    if not t.long:
        w = Window.partitionBy(*t.keys).orderBy(rank)
        return df.withColumns(
            {n: F.lead(c, o).over(w) if o > 0 else F.lag(c, -o).over(w) for n, (c, o) in values.items()}
        )
    out = df
    for offset in sorted({o for _, o in values.values()}):
        cols = {n: c for n, (c, o) in values.items() if o == offset}
        there = df.select(
            *t.keys,
            (F.col(rank) - offset).alias(rank),
            *[F.col(c).alias(n) for n, c in cols.items()],
        )
        keys = [*t.keys, rank]
        out = out.join(_safe(there, keys), _same(keys), "left").drop(*[f"_k_{k}" for k in keys])
    return out


def whole(df: DataFrame, t: Track, values: Mapping[str, Column]) -> DataFrame:
    """Add aggregates of the whole group to each of its rows."""
    if not t.long:
        w = Window.partitionBy(*t.keys)
        return df.withColumns({n: v.over(w) for n, v in values.items()})
    keys = list(t.keys)
    agg = df.groupBy(*keys).agg(*[v.alias(n) for n, v in values.items()])
    out = df.drop(*values).join(_safe(agg, keys), _same(keys), "left")
    return out.drop(*[f"_k_{k}" for k in keys])


def _safe(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_k_{k}" for k in keys})


def _same(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return cond


def first_by(df: DataFrame, keys, order) -> DataFrame:
    """The whole row that comes first in `order` within each group.

    Spark cuts each map task's groups to one row before the shuffle, so a hot group reaches
    its reducer as one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_pick", F.row_number().over(w)).where("_pick = 1").drop("_pick")
