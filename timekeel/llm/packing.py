"""Best-fit packing by linear grouping of lengths.

Large pieces are sorted by length and cut into groups of equal cardinality; each length is
rounded up to the largest of its group, so few sizes remain. The fewest sequences for those
sizes come from a linear programme over configurations (how many pieces of each size share a
sequence), solved by column generation and rounded down; what the rounding leaves is placed
by best fit. Actual pieces then take the rounded ones' places, which leaves more room, and
small pieces fill the fullest sequences that still take them.

Pieces are dealt by hash into cells of equal size and each cell is packed on its own: a cell
holds (id, length) only, never texts, and costs at most a few sequences at its end.

Cases: a null text is empty; every document has one token at least, its end id; repeated
rows are packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timekeel.session import settle

from .common import id_and_text, ship, slices
from .tokens import encoder

CAPACITY = 2048
#: A piece longer than this share of a sequence is large.
LARGE = 1 / 3
GROUPS = 8
CELL_PIECES = 1 << 17
#: Columns that the programme may add before it is rounded.
MOST_COLUMNS = 400
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, copy long"


def pieces(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Tokens of every document, cut only where a document is longer than a sequence."""
    ship(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.uint32(end_id).tobytes()
        serial = 0
        for b in slices(batches):
            out = []
            for doc, ids in zip(b.column(0).to_pylist(), encode.batch(b.column(1).to_pylist())):
                ids += end
                serial += 1
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), serial))
            cols = list(zip(*out)) or [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "copy"])

    return id_and_text(docs).mapInArrow(rows, PIECES)


def linear_programme(sizes: list[int], demand: list[int], capacity: int, most: int = MOST_COLUMNS) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, for the fewest sequences in fractions.

    Column generation: prices of the sizes come from the basis, and a knapsack over whole
    lengths finds the configuration worth most; it ends when none is worth more than 1.
    """
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    level = np.array(demand, dtype=float) / np.diag(basis)
    for _ in range(most):
        price = np.linalg.solve(basis.T, np.ones(n))
        column = knapsack(sizes, price, capacity)
        if price @ column <= 1 + 1e-7:
            break
        along = np.linalg.solve(basis, column)
        usable = along > 1e-9
        if not usable.any():
            break
        ratio = np.where(usable, level / np.where(usable, along, 1.0), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        level = level - step * along
        level[out] = step
        basis[:, out] = column
        level = np.maximum(level, 0)
    return [(basis[:, k].astype(int), float(level[k])) for k in range(n)]


def knapsack(sizes: list[int], price: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration worth most; sizes may repeat."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    order = [i for i in range(len(sizes)) if price[i] > 1e-12]
    floor = min((sizes[i] for i in order), default=capacity + 1)
    s = np.array([sizes[i] for i in order])
    p = np.array([price[i] for i in order])
    for c in range(floor, capacity + 1):
        value = np.where(s <= c, best[c - s] + p, -1.0)
        k = int(np.argmax(value))
        best[c], last[c] = (best[c - 1], -1) if best[c - 1] >= value[k] else (value[k], order[k])
    out, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[last[c]] += 1
            c -= sizes[last[c]]
    return out


class Bins:
    """Open sequences by room left; best fit takes the one with the least room that is enough."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room, self.rooms, self.count = capacity, {}, [], 0

    def open(self, room: int) -> int:
        self.count += 1
        self.keep(self.count - 1, room)
        return self.count - 1

    def keep(self, number: int, room: int) -> None:
        if room not in self.by_room:
            self.by_room[room] = []
            bisect.insort(self.rooms, room)
        self.by_room[room].append(number)

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the place in it."""
        k = bisect.bisect_left(self.rooms, length)
        if k == len(self.rooms):
            number, room = self.count, self.capacity
            self.count += 1
        else:
            room = self.rooms[k]
            held = self.by_room[room]
            number = held.pop()
            if not held:
                del self.by_room[room]
                self.rooms.pop(k)
        self.keep(number, room - length)
        return number, self.capacity - room


def pack(lengths: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece."""
    lengths = np.asarray(lengths, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    n_large = int((lengths > large * capacity).sum())
    number = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    bins = Bins(capacity)
    rest = list(order[n_large:])
    if n_large:
        cuts = np.unique(np.linspace(0, n_large, min(groups, n_large) + 1).astype(int))
        waiting: dict[int, list[int]] = {}
        for a, b in zip(cuts[:-1], cuts[1:]):
            # Longest first: a group is rounded up to its first; groups of one size become one.
            waiting.setdefault(int(lengths[order[a]]), []).extend(order[a:b].tolist())
        sizes = sorted(waiting, reverse=True)
        plan = linear_programme(sizes, [len(waiting[s]) for s in sizes], capacity)
        for s in sizes:
            waiting[s].reverse()
        for config, times in plan:
            for _ in range(int(times + 1e-9)):
                chosen = [waiting[s].pop() for s, k in zip(sizes, config) for _ in range(k) if waiting[s]]
                if not chosen:
                    break
                at = 0
                for i in chosen:
                    number[i], offset[i] = bins.count, at
                    at += int(lengths[i])
                bins.open(capacity - at)
        left = sorted((i for s in sizes for i in waiting[s]), key=lambda i: (-lengths[i], i))
        rest = left + rest
    for i in rest:
        number[i], offset[i] = bins.place(int(lengths[i]))
    return number, offset


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY, cell_pieces: int = CELL_PIECES) -> DataFrame:
    """Rows with a `length` get `sequence_id` and `offset`."""
    n = rows.count()
    cells = max(1, -(-n // cell_pieces))
    cell = F.pmod(F.xxhash64("doc_id", "piece", "copy"), F.lit(cells))

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("copy", "ascending")])
        number, offset = pack(table["length"].to_numpy(), capacity)
        table = table.drop_columns(["cell", "copy"])
        return table.append_column("sequence_id", pa.array(number * cells + key[0].as_py())).append_column("offset", pa.array(offset))

    return rows.withColumn("cell", cell).groupBy("cell").applyInArrow(packed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, cell_pieces: int = CELL_PIECES) -> DataFrame:
    return pack_pieces(settle(pieces(docs, path, end_id, capacity), "pieces"), capacity, cell_pieces)
