"""Repair of conversations against a search over all edits, cut anywhere."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from timekeel.llm import conversations as C
from timekeel.llm import oracles, roles

SCHEMA = "conv_id long, turn long, role string, text string, piece string, audit string, copies string"
AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def damaged(conv, rows):
    out = []
    for turn, role, text in rows:
        known = lambda x: " " if x is None else str(x)
        hit = zlib.crc32(f"{known(conv)}:{known(turn)}".encode()) % 20
        role, text = known(role), known(text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def cheapest(rows):
    """The least (cost, audit) of all sequences of edits, by a search over (rows read, last initial)."""
    seen, found = set(), []
    for _, role, text in rows:
        chars = re.findall(r"[^\x20\x09-\x0D]", text)
        found.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return found, cost, audit, list(out)
        for c in set(AFTER[last]) & set("ua"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, c, (*out, f"{NAME[c]}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
            if found[i] in ("", "truncated"):
                extra = 5 * bool(found[i])
                if role[:1] and role[:1] in AFTER[last]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))
                for c in set(AFTER[last]) & set("ua"):
                    heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, c, (*out, f"{NAME[c]}:{text}")))


def expected(table):
    by = {}
    for conv, turn, role, text, *_ in table:
        by.setdefault(conv, []).append((turn, role, text))
    out = {}
    for conv, rows in by.items():
        rows = damaged(conv, rows)
        found, cost, audit, lines = cheapest(rows)
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[conv] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def make_table():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "", None, "ok. \n", "é?", "No!", "\x1c", "long " * 50 + "end."]
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, None, rng.randint(0, 20)]), rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "usher"]), rng.choice(texts + [f"{turn}. So.", f"{turn} so"] * 8)))
    rows += [(None, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(6)] + rows[:40]
    rows += [(1000, i, rng.choice(["user", "assistant", "user", "system"]), rng.choice([f"{i}.", f"{i}", "Same.", ""])) for i in range(400)]
    dropped = next(i for i in range(5000, 9000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "A."), (dropped, 0, "assistant", "B.")]
    return [(*r, "p", "x", "y") for r in rows]


@pytest.fixture(scope="module")
def table():
    return make_table()


def rows_of(df):
    return {r["conv_id"]: tuple(r[c] for c in (*C.COUNTS, "audit", "repaired_sha256")) for r in df.collect()}


@pytest.mark.parametrize("piece_rows, piece_chars", [(C.PIECE_ROWS, C.PIECE_CHARS), (1, 10**6), (3, 10**6), (7, 200)])
def test_equals_a_search_over_all_edits(spark, table, piece_rows, piece_chars):
    rows = C.damage(spark.createDataFrame(table, SCHEMA).repartition(3))
    assert rows_of(C.digested(*C.repair(rows, piece_rows, piece_chars))) == expected(table)


def test_sql_has_the_same_rows(table):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    # An empty role has no initial, which the SQL leaves open.
    rows = [r for r in table if r[2] != ""]
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    cur = con.execute(oracles.CONVERSATIONS)
    at = [d[0] for d in cur.description]
    got = {r[0]: tuple(r[at.index(c)] for c in (*C.COUNTS, "audit", "repaired_sha256")) for r in cur.fetchall()}
    assert got == expected(rows)


def test_repaired_rows_follow_the_grammar(spark, table):
    rows = C.damage(spark.createDataFrame(table, SCHEMA))
    by = {}
    for r in sorted(C.repaired_rows(*C.repair(rows, 3)).collect(), key=lambda r: (str(r["conv_id"]), r["piece"], r["place"])):
        by.setdefault(r["conv_id"], []).append(r["role"][0])
    assert by and all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in by.values())


def test_empty_table(spark, table):
    assert C.damaged_and_repaired(spark.createDataFrame(table, SCHEMA).limit(0)).collect() == []


def test_automaton_reads_the_grammar():
    import itertools
    for n in range(7):
        for word in itertools.product("sua", repeat=n):
            stack = roles.EMPTY
            for c in word:
                stack = stack and roles.shift(stack, c)
            assert bool(stack and roles.accepts(stack)) == bool(re.fullmatch("(s?(ua)+)?", "".join(word)))


def test_one_conversation_spreads_over_tasks(spark):
    rows = spark.range(20_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat(id, '.') AS text", "1 AS copies")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [r["piece"] >> 32 for r in C.pieces(rows, 500).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(set(parts)) == 4 and len(parts) >= 40
