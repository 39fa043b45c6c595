"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns a unit
vector, and the axis with the largest coordinate, with its sign, is the hash. Each table has
its own rotations; a query probes in each table the cells whose axes its own coordinates
favour most, and everything found is ranked again by exact distance in double precision.

With more vectors a table concatenates more hashes, so that a cell holds about `CELL` different
vectors; a probe order over concatenated hashes adds the losses of its axes. Equal vectors are
one entry of the index with the smallest ids they have (one more than is asked for, as a query
doesn't find itself): no other copy can be among the nearest. A cell with more entries than
`BLOCK` is dealt over blocks, each of which meets the cell's queries, and every block gives
its best only.

Nearness is Euclidean distance on the original vectors. Cells are chosen by direction, so the
index also finds vectors of very different length less surely; `tests/llm` measures recall.

Cases: vectors that are null, zero, or hold null or non-finite components take no part; nor do
rows without an id, or vectors of another length than the most frequent one; ties go to the
smaller id; an empty table gives an empty result. A query that met fewer than were asked for
probes its next cells in further rounds, `WIDER` times as many in each and all cells at last,
so fewer are given only where the table has no more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timekeel.session import settle

from .common import ship

NEAREST = 10
TABLES = 16
#: Probes of a query in each table, as a share of its cells, and at least.
PROBE_SHARE, LEAST_PROBES = 0.05, 7
#: What the probes of queries with too few results are multiplied by in each further round.
WIDER = 4
CELL = 512
BLOCK = 4096
SEED = 77


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows transformed; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def rotated(x: np.ndarray, table: int, k: int, seed: int = SEED) -> np.ndarray:
    """Unit rows under the k-th pseudo-rotation of a table, padded to a power of two."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([seed, table, k])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], size))
    return y


def axes(y: np.ndarray) -> np.ndarray:
    """Number of the nearest signed axis: 2 i for +i, 2 i + 1 for -i."""
    best = np.argmax(np.abs(y), axis=1)
    return 2 * best + (y[np.arange(len(y)), best] < 0)


def hashes_for(n: int, size: int) -> int:
    """Hashes that a table concatenates."""
    return max(1, round(math.log(max(1.0, n / CELL)) / math.log(2 * size)))


def probes_of(losses: list[np.ndarray], orders: list[np.ndarray], most: int) -> np.ndarray:
    """The `most` cells with the least loss for one query; losses and axes of each hash are given best first."""
    width = len(losses[0])
    cells, total = orders[0][:most], losses[0][:most]
    for loss, order in zip(losses[1:], orders[1:]):
        both = total[:, None] + loss[None, :most]
        best = np.argsort(both, axis=None, kind="stable")[:most]
        i, j = np.unravel_index(best, both.shape)
        cells, total = cells[i] * width + order[j], both[i, j]
    return cells


def stack(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def vectors(table: DataFrame) -> DataFrame:
    """`vec_id` and `vec` (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    rows = rows.where(F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False)))
    return rows


def entries(rows: DataFrame, nearest: int) -> DataFrame:
    """One row for each different vector, with the smallest ids that have it."""
    # -0.0 and 0.0 are one value.
    same = rows.select("vec_id", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec")).distinct()
    # Ids of a vector that many rows share are cut to the smallest in each task first.
    salted = same.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("key", F.xxhash64("vec"))
    order = Window.partitionBy("key", "vec", "salt").orderBy("vec_id")
    few = salted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= nearest + 1)
    return few.groupBy("key", "vec").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, nearest + 1).alias("ids")).select("vec", "ids", F.element_at("ids", 1).alias("entry"))


def search(table: DataFrame, queries_where, nearest: int = NEAREST, tables: int = TABLES, seed: int = SEED, probe_share: float = PROBE_SHARE) -> DataFrame:
    """The nearest found for every row for which `queries_where(vec_id)` holds."""
    ship(table.sparkSession)
    rows = settle(vectors(table), "vectors")
    lengths = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").head()
    d = lengths["d"] if lengths else 1
    rows = rows.where(F.size("vec") == d)
    index = settle(entries(rows, nearest), "index")
    n = index.count()
    size = 1 << max(1, (d - 1).bit_length())
    k = hashes_for(n, size)
    most = max(LEAST_PROBES, math.ceil(probe_share * (2 * size) ** k))

    def units(x: np.ndarray) -> np.ndarray:
        # Scaled first, so that very large or small components neither overflow nor vanish.
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = units(stack(b.column(1)))
            for t in range(tables):
                cell = np.zeros(len(u), dtype=np.int64)
                for i in range(k):
                    cell = cell * (2 * size) + axes(rotated(u, t, i, seed))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), t, np.int32)), pa.array(cell), b.column(0)], names=["t", "cell", "entry"])

    def probe(batches: Iterator[pa.RecordBatch], most: int, before: int, tables: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = units(stack(b.column(1)))
            for t in range(tables):
                losses, orders = [], []
                for i in range(k):
                    y = rotated(u, t, i, seed)
                    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
                    order = np.argsort(-both, axis=1, kind="stable")
                    top = np.abs(y).max(axis=1, keepdims=True)
                    losses.append((top - np.take_along_axis(both, order, axis=1)) ** 2)
                    orders.append(order)
                cells = np.concatenate([probes_of([x[r] for x in losses], [x[r] for x in orders], most)[before:] for r in range(len(u))])
                each = len(cells) // len(u)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), t, np.int32)), pa.array(cells.astype(np.int64)), b.column(0).take(pa.array(np.repeat(np.arange(len(u)), each)))], names=["t", "cell", "query_id"])

    queries = settle(rows.where(queries_where(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "vec"), "queries")
    placed = settle(index.select("entry", "vec").mapInArrow(place, "t int, cell long, entry long"), "placed")

    def met_by(asking: DataFrame, most: int, before: int, tables: int) -> DataFrame:
        probed = asking.mapInArrow(lambda batches: probe(batches, most, before, tables), "t int, cell long, query_id long")
        return best_of(placed, probed, index, queries, nearest)

    cells = (2 * size) ** k
    found = settle(met_by(queries, most, 0, tables), "found")
    done = most
    while done < cells:
        met = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("met"))
        asking = settle(queries.join(met.hint("merge"), "query_id", "left").where(F.coalesce("met", F.lit(0)) < nearest).select("query_id", "vec"), "asking")
        if asking.isEmpty():
            break
        most = min(cells, WIDER * done)
        # Once all cells are probed, one table has every entry.
        more = met_by(asking, cells, 0, 1) if most == cells else met_by(asking, most, done, tables)
        found, done = settle(ranked(found.drop("rank").unionByName(more.drop("rank")), nearest), "found"), most
    return found


def ranked(met: DataFrame, nearest: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best_of(placed: DataFrame, probed: DataFrame, index: DataFrame, queries: DataFrame, nearest: int) -> DataFrame:
    """Meet queries and entries cell by cell, and rank what each query met.

    Joins are merge joins: probes, cells and queries pack small on disk, so that Spark would
    take them for small and send them through the driver, where they are many times as large.
    """
    # A block of a large cell is a part of its entries by a hash; it meets all queries of the cell.
    sizes = placed.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("held")).withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int")).hint("merge")
    entries_of = placed.join(sizes, ["t", "cell"]).withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")).join(index.select("entry", "vec", "ids").hint("merge"), "entry")
    queries_of = probed.join(sizes, ["t", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(queries.hint("merge"), "query_id")

    def meet(key: tuple[pa.Scalar, ...], found: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if found.num_rows and asked.num_rows:
            x = stack(found["vec"].combine_chunks())
            ids = found["ids"].to_pylist()
            least = np.array([i[0] for i in ids])
            for q, vec in zip(asked["query_id"].to_pylist(), stack(asked["vec"].combine_chunks())):
                far = np.sqrt(np.square(x - vec).sum(axis=1))
                # Ten entries hold ten other ids at least, unless the query's own is one: one more.
                for e in np.lexsort((least, far))[: nearest + 1]:
                    for i in ids[e]:
                        if i != q:
                            out["query_id"].append(q)
                            out["vec_id"].append(i)
                            out["score"].append(float(far[e]))
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    keys = ["t", "cell", "block"]
    met = queries_of.select(*keys, "query_id", "vec")
    met = entries_of.select(*keys, "vec", "ids").groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    return ranked(met, nearest)
