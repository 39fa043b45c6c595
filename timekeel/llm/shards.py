"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each input partition sends to each block of each shard is drawn exactly: the
rows of the matrix are multivariate hypergeometric draws from the places still free. Every
partition permutes its rows and deals them out in those counts; after the exchange every
block permutes what it got. All orders of all rows are then equally likely, and shard sizes
are exact, at most one row apart.

The partitions are written down first, with each row's partition and place, so a task that
is repeated after a lost executor deals the same rows again. One exchange deals to 64
destinations at most; more blocks than that are reached in further levels, each of which
deals one range of blocks among parts of it. So the driver holds 64 counts per partition at
most, never rows, and what it holds grows with the number of partitions only.

Cases: any nulls and repeated rows are dealt like other rows; empty texts have size 1; with
fewer rows than shards some shards stay empty; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timekeel.session import settle

from .common import id_and_text, ship

N_SHARDS = 16
SEED = 20_240
#: Rows of a block, the part of a shard that one task permutes.
BLOCK_ROWS = 1 << 17
#: Numbers from here on are not the library's to draw from.
LIBRARY_MOST = 10**9
#: Destinations of one exchange.
FAN_OUT = 64


def block_sizes(n_rows: int, n_shards: int, block_rows: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, rows) of each block: shards at most one row apart, blocks of a shard too."""
    out = []
    for shard in range(n_shards):
        size = n_rows // n_shards + (shard < n_rows % n_shards)
        blocks = -(-size // block_rows)
        at = 0
        for k in range(blocks):
            rows = size // blocks + (k < size % blocks)
            out.append((shard, at, rows))
            at += rows
    return out


def drawn(good: int, bad: int, sample: int, rng: np.random.Generator, library_most: int = LIBRARY_MOST) -> int:
    """A hypergeometric number: how many of `sample` draws without replacement are good.

    Beyond what the library draws, few draws are made one by one, and others by the ratio of
    uniforms: a point under the scaled density of the smaller side, accepted or drawn again.
    """
    if max(good, bad, sample) < library_most:
        return int(rng.hypergeometric(good, bad, sample))
    whole = good + bad
    if sample > whole - sample:
        return good - drawn(good, bad, whole - sample, rng, library_most)
    if good > bad:
        return sample - drawn(bad, good, sample, rng, library_most)
    if sample < 10 or good < 10:
        # Draws and good ones can change places.
        few, many, hits = min(sample, good), max(sample, good), 0
        for k in range(few):
            hits += rng.random() * (whole - k) < many - hits
        return hits
    share = good / whole
    mean = sample * share
    spread = math.sqrt((whole - sample) / (whole - 1) * sample * share * (1 - share) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    weight = lambda k: sum(math.lgamma(x + 1) for x in (k, good - k, sample - k, bad - sample + k))
    most = weight((sample + 1) * (good + 1) // (whole + 2))
    last = min(sample, good, math.floor(mean + 0.5 + 16 * spread))
    while True:
        u, x = rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (x - 0.5) / u) if u else -1
        if 0 <= k <= last and 2 * math.log(u) <= most - weight(k):
            return k


def communication_matrix(sent: list[int], received: list[int], rng: np.random.Generator) -> np.ndarray:
    """Rows of `sent[p]` rows dealt over places `received[b]`, as a uniform permutation would deal them."""
    free = np.array(received, dtype=np.int64)
    out = np.zeros((len(sent), len(received)), dtype=np.int64)
    for p, n in enumerate(sent):
        left, rest = int(n), int(free.sum())
        for b in range(len(received)):
            if not left:
                break
            rest -= int(free[b])
            out[p, b] = drawn(int(free[b]), rest, left, rng) if rest else left
            left -= int(out[p, b])
        free -= out[p]
    return out


def level(parts: dict[int, list[tuple[int, int]]], ranges: dict[int, tuple[int, int]], blocks: list[tuple[int, int, int]], block_rows: int, rng: np.random.Generator, fan_out: int):
    """One exchange. parts: (id, rows) of each node; ranges: the node's blocks, from and to.

    Gives what each part sends (counts and the part it goes to) and the nodes that come out.
    """
    sends, new_parts, new_ranges, next_part = [], {}, {}, 0
    for node, (first, last) in ranges.items():
        cuts = np.linspace(first, last, min(fan_out, last - first) + 1).astype(int)
        children = list(zip(cuts[:-1], cuts[1:]))
        matrix = communication_matrix([n for _, n in parts[node]], [sum(b[2] for b in blocks[f:t]) for f, t in children], rng)
        target = np.zeros_like(matrix)
        for c, (f, t) in enumerate(children):
            child, held = len(new_ranges), 0
            new_ranges[child], new_parts[child] = (int(f), int(t)), []
            for p in range(len(matrix)):
                n = int(matrix[p, c])
                if not new_parts[child] or held + n > block_rows:
                    new_parts[child].append((next_part, 0))
                    next_part, held = next_part + 1, 0
                held += n
                new_parts[child][-1] = (new_parts[child][-1][0], held)
                target[p, c] = new_parts[child][-1][0]
        sends += [(i, matrix[k].tolist(), target[k].tolist()) for k, (i, _) in enumerate(parts[node])]
    return sends, new_parts, new_ranges


def shuffle(df: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS, fan_out: int = FAN_OUT) -> DataFrame:
    """`df` with columns `shard` and `slot` (gapless from 0 in each shard), in uniformly random order."""
    spark = ship(df.sparkSession)
    fields = [f for f in df.schema.fields if f.name not in ("shard", "slot")]
    row = F.struct(*(F.col(f"`{f.name}`") for f in fields)).alias("row")
    now = settle(df.select(row, F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("place")), "dealt")
    fields = now.schema["row"].dataType.fields  # as they are read back: any may be null
    sizes = sorted((r["part"], r["n"]) for r in now.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    blocks = block_sizes(sum(n for _, n in sizes), n_shards, block_rows)
    rng = np.random.default_rng(seed)
    parts, ranges, depth = {0: sizes}, {0: (0, len(blocks))}, 0
    while sizes and (not depth or any(t - f > 1 for f, t in ranges.values())):
        sends, parts, ranges = level(parts, ranges, blocks, block_rows, rng, fan_out)
        if depth:
            now = settle(now, "dealt")
        now = dealt(now, sends, seed, depth)
        depth += 1
    place_of = {p: blocks[f] for c, (f, _) in ranges.items() for p, _ in parts[c]} if sizes else {}
    result = T.StructType([T.StructField("row", T.StructType(fields)), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def arrange(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        shard, first, _ = place_of[part]
        rows = rows.sort_by("place")
        order = np.random.default_rng([seed, 2, part]).permutation(rows.num_rows)
        return pa.table({"row": rows["row"], "shard": pa.array(np.full(rows.num_rows, shard, np.int32)), "slot": pa.array(first + order.astype(np.int64))})

    out = now.groupBy("part").applyInArrow(arrange, result)
    return out.select(*(F.col("row")[f.name].alias(f.name) for f in fields), "shard", "slot")


def dealt(rows: DataFrame, sends: list, seed: int, depth: int) -> DataFrame:
    """Every part's rows, permuted, with the parts they go to."""
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("target", T.ArrayType(T.LongType()))])
    told = rows.sparkSession.createDataFrame(pd.DataFrame(sends, columns=["part", "counts", "target"]), schema)

    def deal(key: tuple[pa.Scalar, ...], mine: pa.Table, what: pa.Table) -> pa.Table:
        mine = mine.sort_by("place")
        order = np.random.default_rng([seed, 1, depth, key[0].as_py()]).permutation(mine.num_rows)
        part = np.empty(mine.num_rows, dtype=np.int64)
        part[order] = np.repeat(np.array(what["target"][0].as_py(), dtype=np.int64), what["counts"][0].as_py())
        return pa.table({"row": mine["row"], "part": pa.array(part), "place": mine["place"]})

    return rows.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(deal, T.StructType([rows.schema[c] for c in ("row", "part", "place")]))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """Shard and slot of every document, with its size and checksum; law `rows`."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = id_and_text(docs).select("doc_id", (F.octet_length(raw).cast("long") + 1).alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"))
    out = shuffle(slim, n_shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
