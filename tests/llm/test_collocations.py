"""Phrases against plain counting, with samples that miss and texts cut anywhere."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from timekeel.llm import collocations as C
from timekeel.llm import oracles

SCHEMA = "doc_id long, text string, lang string, phrase string, size string, mark string, f string, a string, l string, rank string"


def phrases_of(rows):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    f[lang][tuple(w[i:i + size])] += 1
    return f, n


def expected(rows, least=10, top=2000):
    f, n = phrases_of(rows)
    out = []
    for lang in f:
        often = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in often.items()):
                continue
            score, k, l, r = min((10**6 * a * a // (f[lang][p[:k]] * f[lang][p[k:]]), k, f[lang][p[:k]], f[lang][p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def make_rows():
    rng = random.Random(11)
    vocabulary = ["the", "The", "of", "and", "é", "ÉA", "éa", "日本", "x\x1cy", "no break", "#1", "a", "b", "c", "don't"]
    rows = []
    for i in range(260):
        words = [rng.choice(vocabulary if rng.random() < 0.8 else ["rare%d" % rng.randrange(200)]) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" "] * 8 + ["\t", "  ", ". ", ",", "\n", "!?", ";\r\n", " : "]) for w in words)
        rows.append((i, text, rng.choice(["aa", "aa", "bb", None])))
    rows += [(400, None, "aa"), (401, "", "bb"), (402, " \t\n", None), (None, "the of the of the of", "aa"), (403, "a a a a a a a a a a a a a a", "cc"), (404, "z" * 5000, "aa")]
    rows += [(405, "license terms apply here", "bb")] * 30 + rows[:20]
    return [(*r, "p", "s", "m", "f", "a", "l", "r") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


def listed(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"sample_least": 1, "flush_words": 50, "block_bytes": 16}, {"sample_least": 10**6}, {"sample_least": 8, "most_bits": C.BLOCK_BITS, "flush_words": 1}])
def test_equals_plain_counting(spark, rows, options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert listed(C.collocations(docs, **options)) == expected(rows)


@pytest.mark.parametrize("least, top", [(2, 5), (10, 3), (1, 2000)])
def test_thresholds_and_tops(spark, rows, least, top):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert listed(C.collocations(docs, least, top)) == expected(rows, least, top)


def test_passes_go_on_until_closed(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    found, passes = C.frequent(docs, sample_least=10**6)
    assert passes == 3
    f, _ = phrases_of(rows)
    want = {(lang, " ".join(p)): a for lang in f for p, a in f[lang].items() if a >= 10}
    got = [((r["lang"], r["phrase"]), r["f"]) for r in found.where("size > 0").collect()]
    assert len(got) == len(want) and dict(got) == want


def test_sql_has_the_same_rows(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in rows])
    cur = con.execute(oracles.COLLOCATIONS)
    at = [[d[0] for d in cur.description].index(c) for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")]
    assert sorted(tuple(r[i] for i in at) for r in cur.fetchall()) == expected(rows)


def test_products_beyond_64_bits(spark):
    big = 3 * 10**12
    counts = spark.createDataFrame([("aa", 1, "x", big + 7), ("aa", 1, "y", big + 1), ("aa", 2, "x y", big - 5)], "lang string, size int, phrase string, f long")
    assert C.scored(counts).head()["score"] == 10**6 * (big - 5) ** 2 // ((big + 7) * (big + 1))


def test_phrases_of_one_hash_are_told_apart(spark, rows):
    """Many phrases on one bit: more is counted by text, and nothing else changes."""
    docs = spark.createDataFrame(rows, SCHEMA)
    few = C.frequent(docs, most_bits=C.BLOCK_BITS, least=10)[0]
    f, _ = phrases_of(rows)
    assert {(r["lang"], r["phrase"]): r["f"] for r in few.where("size > 0").collect()} == {(lang, " ".join(p)): a for lang in f for p, a in f[lang].items() if a >= 10}


def test_bits_hold_what_was_put_in(spark):
    marks = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 5000)
    df = spark.createDataFrame([(int(m),) for m in marks], "mark long")
    small, large = C.bits(df, 10), C.bits(df, 10**6)
    assert small.size < large.size
    both = small.union(large)
    for b in (small, large, both):
        assert b.has(marks.astype(np.uint64)).all()
    assert large.has(np.arange(10**5, dtype=np.uint64) * np.uint64(7919)).mean() < 0.01
    assert not C.Bits().has(marks.astype(np.uint64)).any()


def test_blocks_end_between_words():
    text = b" one two  three" * 40 + b"x" * 100
    for size in (1, 5, 17, 10**6):
        parts = list(C.blocks(text, size))
        assert b"".join(parts) == text and all(p.startswith(b" ") for p in parts)


def test_empty_table(spark, rows):
    assert C.collocations(spark.createDataFrame(rows, SCHEMA).limit(0)).collect() == []


def test_counts_by_hash_take_sorted_hashes():
    marks = np.array([7, 3, 2**63 + 5, 3, 7, 7], dtype=np.uint64)
    got = [r for b in C.Counter("aa", C.Wanted(C.Bits(), C.Bits())).by_mark(2, marks) for r in b.to_pylist()]
    assert [(r["mark"] % 2**64, r["f"]) for r in got] == [(3, 2), (7, 3), (2**63 + 5, 1)]
    assert all(r["size"] == 2 and r["phrase"] is None for r in got)


def test_named_words_are_found_whatever_parts_them():
    wanted = C.Wanted(C.Bits(), C.Bits(), named=frozenset([b"word"]))
    for c in ".,;:!?\n\x0b\x0c\r\t ":
        assert wanted.in_text(f"a{c}WoRd{c}b".encode())
    for c in "\x1c\x85\xa0-":
        assert not wanted.in_text(f"a{c}word b".encode())
