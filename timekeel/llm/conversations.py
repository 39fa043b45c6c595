"""Repair of conversation structure by generalised LR search.

Rows of a conversation, in order of turn, are read against the role grammar (`roles`). The
search keeps a graph-structured stack: one node for each stack top that any sequence of
edits reaches, and equal tops merge to the one with the least (cost, audit). Every row can be
kept (if its role may follow), given another role, or deleted; empty turns can be inserted
anywhere. Blank and repeated rows must go; a truncated row that stays costs extra.

Scale: rows are dealt out by ranges of (conversation, turn), so a conversation with a third of
all rows spreads over many tasks, and each task cuts its rows into pieces of at most
`PIECE_ROWS` rows or about `PIECE_CHARS` characters. A conversation that is one piece is
repaired where it lies. For the others (at most two a task, and long ones), each piece is
searched from every stack top; what goes on is a fixed number of costs, and the order of the
audits. Two audits that end in different tops after the same row differ before either ends,
so that order decides all later ties; folding the pieces gives each its way in and out.
Texts are shuffled once. Only the digest of a long conversation, one sequence by its nature,
reads its pieces one after the other, as a stream.

Cases: nulls count as one space, so a null text is blank and a null role has to be changed;
an empty role cannot be kept; rows of one turn are ordered by role, then text (its first 64
characters, then a hash), copies next to each other; a null conv_id is a conversation of its
own; a conversation with no rows left gives zeros, an empty audit and the digest of the empty
text; an empty table gives an empty result; columns but the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timekeel.session import settle

from .common import ship, slices
from .roles import PLACE, STACKS, accepts, shift

PIECE_ROWS = 4096
PIECE_CHARS = 4_000_000
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
GIVEN = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
#: The stack top after a role's initial, by top.
NEXT = {(i, c): PLACE[s[-1]] for i, stack in enumerate(STACKS) for c in "sua" if (s := shift(stack, c))}
#: The role that can be given or inserted on a top.
MAY = {i: [c for c in "ua" if (i, c) in NEXT] for i in range(len(STACKS))}
TOPS = len(STACKS)

PIECE = "conv_id long, piece long, whole boolean, turns array<long>, roles array<string>, texts array<string>"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string"

#: Stack tops of a graph-structured stack with the least (cost, audit) that leads to each.
Frontier = dict[int, tuple[int, str]]


def merge(frontier: Frontier, top: int, cost: int, audit: str) -> bool:
    """Equal tops become one; whether this way in is the better one."""
    held = frontier.get(top)
    if held is None or (cost, audit) < held:
        frontier[top] = (cost, audit)
        return True
    return False


def with_inserts(frontier: Frontier) -> Frontier:
    found, todo = dict(frontier), list(frontier)
    while todo:
        top = todo.pop()
        cost, audit = found[top]
        for c in MAY[top]:
            if merge(found, NEXT[top, c], cost + INSERT, audit + "I"):
                todo.append(NEXT[top, c])
    return found


def read(frontier: Frontier, initial: str, fault: str | None) -> Frontier:
    """The tops after one more row."""
    after: Frontier = {}
    for top, (cost, audit) in with_inserts(frontier).items():
        merge(after, top, cost + DELETE, audit + "D")
        if fault in (BLANK, DUPLICATE):
            continue
        extra = TRUNCATED if fault == CUT else 0
        if (top, initial) in NEXT:
            merge(after, NEXT[top, initial], cost + extra, audit + "K")
        for c in MAY[top]:
            merge(after, NEXT[top, c], cost + REROLE + extra, audit + "R")
    return after


def search(rows: list[tuple[str, str | None]], top: int) -> Frontier:
    frontier: Frontier = {top: (0, "")}
    for initial, fault in rows:
        frontier = read(frontier, initial, fault)
    return frontier


def finish(top: int) -> tuple[int, str]:
    """What completes a conversation from a top."""
    return min(way for t, way in with_inserts({top: (0, "")}).items() if accepts(STACKS[t]))


FINISH = [finish(t) for t in range(TOPS)]


def replay(audit: str, top: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts of the repaired rows."""
    new_roles, new_texts, at = [], [], 0
    for edit in audit:
        if edit != "D":
            role = roles[at] if edit == "K" else GIVEN[MAY[top][0]]
            new_roles.append(role)
            new_texts.append("" if edit == "I" else texts[at])
            top = NEXT[top, role[:1]]
        at += edit != "I"
    return new_roles, new_texts


def faults(roles: list[str], texts: list[str], again: set[int] = frozenset()) -> list[str | None]:
    """Each row's first fault; `again` are rows known to repeat one of an earlier piece."""
    seen, out = set(), []
    for i, row in enumerate(zip(roles, texts)):
        end = row[1].rstrip(SPACES)
        if not end:
            out.append(BLANK)
            continue
        out.append(DUPLICATE if row in seen or i in again else None if end[-1] in ".!?" else CUT)
        seen.add(row)
    return out


def stats(turns: list[int | None], roles: list[str], found: list[str | None], before: tuple | None = None) -> tuple[int, ...]:
    """Least and greatest turn, different turns, the three faults, and illegal neighbours; `before` is the last (turn, initial) of the piece before."""
    known = [t for t in turns if t is not None]
    initials = [r[:1] for r in roles]
    if before and turns:
        initials.insert(0, before[1])
    distinct = len(set(known)) - bool(before and known and known[0] == before[0])
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    return (min(known, default=None), max(known, default=None), distinct, *(found.count(f) for f in (BLANK, DUPLICATE, CUT)), illegal)


def gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


# --- Spark ---------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with seeded faults; `copies` is how often a row stands there, 0 if it is dropped."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(hit <= 1, "").when(hit == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(hit == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"))


def pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Conversations cut to pieces: consecutive rows of one conversation in arrays; `whole` if surely all of it."""
    order = ["conv_id", "turn", "role", "head", "mark", "at"]
    keyed = rows.select("conv_id", "turn", "role", "text", "copies", F.substring("text", 1, 64).alias("head"), F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("at"))
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "copies")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Partitions are consecutive ranges, so their numbers continue the order of pieces.
        base, number = TaskContext.get().partitionId() << 32, 0
        none = object()
        now, first, was_cut, chars = none, True, False, 0
        turns, roles, texts, out, ready = [], [], [], [], 0

        def close(last: bool) -> None:
            nonlocal number, chars, turns, roles, texts, ready
            out.append((now, base + number, not (first or last or was_cut), turns, roles, texts))
            number, ready, chars, turns, roles, texts = number + 1, ready + chars, 0, [], [], []

        for b in slices(batches):
            for conv, turn, role, text, copies in zip(*(c.to_pylist() for c in b.columns)):
                if conv != now or now is none:
                    if now is not none:
                        close(last=False)
                        first = False
                    now, was_cut = conv, False
                elif len(turns) >= piece_rows or chars >= piece_chars:
                    was_cut = True
                    close(last=False)
                turns += [turn] * copies
                roles += [role] * copies
                texts += [text] * copies
                chars += len(text) * copies
            if ready >= piece_chars or len(out) >= 1000:
                yield record(out, PIECE)
                out, ready = [], 0
        if now is not none:
            close(last=True)
        yield record(out, PIECE)

    return dealt.mapInArrow(cut, PIECE)


ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def each(df: DataFrame, schema: str, rows_of: Callable[..., Iterator[tuple]]) -> DataFrame:
    """One call of `rows_of` for each row, with its values in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                yield record([r for values in zip(*(c.to_pylist() for c in part.columns)) for r in rows_of(*values)], schema)

    return df.mapInArrow(run, schema)


REPAIRED = f"{RESULT}, piece long, whole boolean, low long, high long, distinct long, new_roles array<string>, new_texts array<string>"


def repaired_piece(conv_id, piece, whole, turns, roles, texts, again, way_in, way_out, before_turn, before_initial, last):
    """One repaired piece with its share of the counts; `way_out` is null if the piece is all of its conversation."""
    found = faults(roles, texts, set(again or ()))
    frontier = search([(r[:1], f) for r, f in zip(roles, found)], way_in)
    ends = {t: (c + FINISH[t][0], a + FINISH[t][1]) for t, (c, a) in frontier.items()}
    cost, audit = min(ends.values()) if way_out is None else (ends if last else frontier)[way_out]
    low, high, distinct, *counted = stats(turns, roles, found, (before_turn, before_initial) if before_initial is not None else None)
    yield (conv_id, gaps(low, high, distinct), *counted, cost, audit, piece, whole, low, high, distinct, *replay(audit, way_in, roles, texts))


def repeated(parts: DataFrame) -> DataFrame:
    """For each piece the rows that repeat one of an earlier piece, as `again`."""
    def keys(conv_id, piece, roles, texts):
        for i, f in enumerate(faults(roles, texts)):
            if f in (None, CUT):
                yield conv_id, piece, i, hashlib.sha256(f"{len(roles[i])}:{roles[i]}{texts[i]}".encode("utf-8", "surrogatepass")).digest()

    # A piece has a key once, so the rows of one key are at most its conversation's pieces.
    first = F.min("piece").over(Window.partitionBy("conv_id", "key"))
    marked = each(parts.select("conv_id", "piece", "roles", "texts"), "conv_id long, piece long, i long, key binary", keys)
    return marked.withColumn("first", first).where("piece > first").groupBy("conv_id", "piece").agg(F.collect_list("i").alias("again"))


def summary(conv_id, piece, turns, roles, texts, again):
    """Costs of a piece from each top to each, and the places of the ways' audits in order."""
    found = faults(roles, texts, set(again or ()))
    rows = [(r[:1], f) for r, f in zip(roles, found)]
    costs, places = [], []
    for top in range(TOPS):
        frontier = search(rows, top)
        order = sorted(frontier, key=lambda t: frontier[t][1])
        costs += [frontier[t][0] if t in frontier else -1 for t in range(TOPS)]
        places += [order.index(t) if t in frontier else -1 for t in range(TOPS)]
    known = [t for t in turns if t is not None]
    yield conv_id, piece, costs, places, known[-1] if known else None, roles[-1][:1] if roles else None


SUMMARY = "conv_id long, piece long, costs array<long>, places array<long>, last_turn long, last_initial string"
WAYS = "conv_id long, piece long, way_in long, way_out long, before_turn long, before_initial string, last boolean"


def fold(table: pa.Table) -> pa.Table:
    """The ways in and out of all pieces of one conversation, from their summaries."""
    rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
    cost, place, came = {0: 0}, {0: 0}, []
    for r in rows:
        best = {}
        for x in range(TOPS):
            ways = [(cost[m] + r["costs"][m * TOPS + x], place[m], m) for m in cost if r["costs"][m * TOPS + x] >= 0]
            if ways:
                best[x] = min(ways)
        order = sorted(best, key=lambda x: (best[x][1], r["places"][best[x][2] * TOPS + x]))
        cost, place = {x: best[x][0] for x in best}, {x: order.index(x) for x in best}
        came.append({x: best[x][2] for x in best})
    top = min(cost, key=lambda x: (cost[x] + FINISH[x][0], place[x]))
    out, turn, initial = [], [None], [None]
    for r in rows:
        turn.append(r["last_turn"] if r["last_turn"] is not None else turn[-1])
        initial.append(r["last_initial"] if r["last_initial"] is not None else initial[-1])
    for i in range(len(rows) - 1, -1, -1):
        out.append((rows[i]["conv_id"], rows[i]["piece"], came[i][top], top, turn[i], initial[i], i == len(rows) - 1))
        top = came[i][top]
    return pa.Table.from_batches([record(out, WAYS)])


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> tuple[DataFrame, DataFrame]:
    """Repaired pieces of `rows` (conv_id, turn, role, text, copies): conversations of one piece, and the pieces of others."""
    ship(rows.sparkSession)
    cut = settle(pieces(rows, piece_rows, piece_chars), "pieces")
    cols = ["conv_id", "piece", "whole", "turns", "roles", "texts"]
    whole = cut.where("whole").select(*cols, F.array().cast("array<long>"), F.lit(0).cast("long"), *(F.lit(None).cast(t) for t in ("long", "long", "string", "boolean")))
    parts = cut.where("not whole")
    same = ["conv_id", "piece"]

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({c: f"r_{c}" for c in same})
        return left.join(right, (F.col("piece") == F.col("r_piece")) & F.col("conv_id").eqNullSafe(F.col("r_conv_id")), "left").drop("r_conv_id", "r_piece")

    marked = settle(joined(parts, repeated(parts)), "marked")
    ways = each(marked.select(*same, "turns", "roles", "texts", "again"), SUMMARY, summary).groupBy("conv_id").applyInArrow(fold, WAYS)
    parts = joined(marked, ways).select(*cols, "again", "way_in", "way_out", "before_turn", "before_initial", "last")
    return tuple(each(df.toDF(*parts.columns), REPAIRED, repaired_piece) for df in (whole, parts))


def repaired_rows(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """The repaired conversations as rows in order of (conv_id, piece, place)."""
    return whole.unionByName(parts).select("conv_id", "piece", F.posexplode(F.arrays_zip("new_roles", "new_texts")).alias("place", "row")).select(
        "conv_id", "piece", "place", F.col("row.new_roles").alias("role"), F.col("row.new_texts").alias("text"))


def digested(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """One row for each conversation: counts, cost, audit, and the digest of its repaired rows."""
    schema = f"{RESULT}, repaired_sha256 string"

    def line(roles: list[str], texts: list[str]) -> bytes:
        return "\n".join(f"{r}:{t}" for r, t in zip(roles, texts)).encode("utf-8", "surrogatepass")

    cols = ["conv_id", *COUNTS, "audit"]
    complete = each(whole.select(*cols, "new_roles", "new_texts"), schema, lambda *v: iter([(*v[:-2], hashlib.sha256(line(*v[-2:])).hexdigest())]))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, total, out = none, None, []

        def close() -> None:
            low, high, distinct = total["turns"]
            out.append((now, gaps(low, high, distinct), *total["counts"], "".join(total["audit"]), total["sha"].hexdigest()))

        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if now is none or r["conv_id"] != now:
                    if now is not none:
                        close()
                    now, total = r["conv_id"], {"turns": (None, None, 0), "counts": (0,) * 5, "audit": [], "sha": hashlib.sha256(), "any": False}
                low, high, distinct = total["turns"]
                known = [x for x in (low, high, r["low"], r["high"]) if x is not None]
                total["turns"] = min(known, default=None), max(known, default=None), distinct + r["distinct"]
                total["counts"] = tuple(a + r[c] for a, c in zip(total["counts"], COUNTS[1:]))
                total["audit"].append(r["audit"])
                if r["new_roles"]:
                    total["sha"].update((b"\n" if total["any"] else b"") + line(r["new_roles"], r["new_texts"]))
                    total["any"] = True
        if now is not none:
            close()
        yield record(out, schema)

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return complete.unionByName(ordered.mapInArrow(stream, schema))


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    return digested(*repair(damage(conversations)))
