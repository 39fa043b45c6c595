"""Collocations by Toivonen's sampling method.

Phrases of up to three words with `LEAST` occurrences in a language are found as follows.

1. A sample of the documents is mined with a threshold of its share, first words, then pairs
   of words that it holds often enough. These are the proposals.
2. One pass over all documents counts the proposals and their negative border: all words, all
   pairs of proposed words, all triples whose two pairs are proposed. Pairs and triples, of
   which nearly all are rare, go by 64-bit hashes in it.
3. A frequent word or pair of the border is a failure: what it might extend to was not
   counted. Failures join the proposals, and a further pass counts what that adds, and by
   their texts what the hashes left as likely. When a pass has no failures the result is
   closed, so it is exact whatever the sample held and whatever hashes met.

Proposals travel as bit tables of hashes. The tables' size follows the number of proposals up
to `MOST_BITS`; two phrases on one bit mean that some more are counted, never fewer.
Counts are taken per task over ids of words in NumPy and merged by Spark. The ranking joins
frequent phrases only, and cuts each language's list by salted parts first.

Cases: null texts are empty, null languages `und`; texts are read in blocks, cut between
words, so a long one takes bounded memory; repeated rows count as often as they occur; an empty table
gives an empty result; columns but `lang`, `text` and `doc_id` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timekeel.session import settle

from .common import ship, slices

UNKNOWN = "und"
LEAST = 10
TOP = 2000
#: One document of so many is in the sample, and a phrase is proposed with so many occurrences there.
SAMPLE_OF, SAMPLE_LEAST = 3, 4
#: A bit table has 32 bits for each proposal, and at most so many: 64 MB.
BITS_EACH, MOST_BITS = 32, 1 << 29
#: Bits of one row of a table under construction, as bitmap_construct_agg makes them.
BLOCK_BITS = 1 << 15
#: Words of one language that a task counts at a time, and bytes of text that it splits at a time.
FLUSH_WORDS = 1_000_000
#: Failures whose words are told by name to the tasks of the next pass, at most.
MOST_NAMED = 50_000
BLOCK_BYTES = 1 << 20
#: Phrases that a task holds as text at a time.
BATCH_ROWS = 1 << 16
SALTS = 64
COUNTED = "lang string, size int, phrase string, mark long, f long"

#: Ends of pieces become a line feed, a tab a blank.
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
#: The same with A-Z as a-z and all that parts words as a blank.
WORDS_ALONE = bytes(range(256)).lower().translate(ENDS).replace(b"\n", b" ")
NOTHING, END = 0, 1


class Ids(dict):
    """Numbers of words in order of appearance; 0 is no word, 1 the end of a piece."""

    def __init__(self):
        super().__init__({b"": NOTHING, b"\n": END})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks(text: bytes, size: int) -> Iterator[bytes]:
    """The text in blocks that end between words."""
    start = 0
    while len(text) - start > size:
        cut = text.find(b" ", start + size)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


class Bits:
    """A set of hashes as one bit for each; nothing is in an empty one."""

    def __init__(self, size: int = 0, data: np.ndarray | None = None):
        self.size, self.data = size, data

    def has(self, marks: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.zeros(len(marks), dtype=bool)
        at = marks & np.uint64(self.size - 1)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def union(self, other: Bits) -> Bits:
        """Both sets at the larger size; a smaller table repeats, as its bits are the last ones of a hash."""
        if not self.size or not other.size:
            return self if self.size else other
        size = max(self.size, other.size)
        return Bits(size, np.tile(self.data, size // self.size) | np.tile(other.data, size // other.size))


def pair_marks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = left * np.uint64(0x9E3779B97F4A7C15) ^ (right + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(29))


class Wanted:
    """What a pass counts.

    Words if `all_words`; pairs of words in `words` and triples of pairs in `pairs`, but not
    what `old_words` and `old_pairs` allowed an earlier pass to count, unless that found it
    `likely`. With `by_mark` pairs and triples go by their hash, without their text. Where
    `named` is given, texts without any of its words hold nothing that is wanted.
    """

    def __init__(self, words: Bits, pairs: Bits, old_words: Bits = Bits(), old_pairs: Bits = Bits(), likely: Bits = Bits(), all_words: bool = False, by_mark: bool = False, named: frozenset[bytes] | None = None):
        self.words, self.pairs, self.old_words, self.old_pairs = words, pairs, old_words, old_pairs
        self.likely, self.all_words, self.by_mark, self.named = likely, all_words, by_mark, named

    def in_text(self, text: bytes) -> bool:
        return self.named is None or not self.named.isdisjoint(text.translate(WORDS_ALONE).split())

    def take(self, allowed: np.ndarray, before: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return allowed & (~before | self.likely.has(marks))


class Counter:
    """Counts of one language in one task."""

    def __init__(self, lang: str, wanted: Wanted):
        self.lang, self.wanted, self.ids, self.parts, self.held, self.skip = lang, wanted, Ids(), [], 0, 0

    def add(self, block: bytes) -> None:
        tokens = block.lower().translate(ENDS).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.ids.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        ids = ids[ids != NOTHING]
        self.parts.append(ids)
        self.held += len(ids)

    def end(self) -> None:
        self.parts.append(np.array([END]))

    def flush(self) -> Iterator[pa.RecordBatch]:
        """What was added since the last flush; the last two words go on, as a phrase may continue."""
        a, want = np.concatenate(self.parts or [np.zeros(0, np.int64)]), self.wanted
        words, skip, many = list(self.ids), self.skip, len(self.ids)
        seed = self.lang.encode()
        marks = np.fromiter((xxhash.xxh64_intdigest(seed + b"\0" + w) for w in words), dtype=np.uint64, count=many)
        word = a > END
        if want.all_words:
            f = np.bincount(a[skip:][word[skip:]], minlength=many)
            found = np.flatnonzero(f)
            yield from self.batches(words, marks[found], f[found], found)
            yield self.batch(0, [b""], np.zeros(1, np.uint64), np.array([f.sum()]))
        if len(a) > 1:
            new, old, left, right = want.words.has(marks), want.old_words.has(marks), a[:-1], a[1:]
            both, fresh = word[:-1] & word[1:], np.arange(1, len(a)) >= skip
            of_pair = pair_marks(marks[left], marks[right])
            chosen = np.flatnonzero(both & fresh & want.take(new[left] & new[right], old[left] & old[right], of_pair))
            if want.by_mark:
                yield from self.by_mark(2, of_pair[chosen])
            else:
                _, at, f = np.unique(left[chosen] * many + right[chosen], return_index=True, return_counts=True)
                at = chosen[at]
                yield from self.batches(words, of_pair[at], f, a[at], a[at + 1])
        if want.pairs.size and len(a) > 2:
            new, old = both & want.pairs.has(of_pair), both & want.old_pairs.has(of_pair)
            of_three = pair_marks(of_pair[:-1], marks[a[2:]])
            chosen = np.flatnonzero(fresh[1:] & want.take(new[:-1] & new[1:], old[:-1] & old[1:], of_three))
            if want.by_mark:
                yield from self.by_mark(3, of_three[chosen])
            else:
                _, rank = np.unique((left * many + right)[chosen], return_inverse=True)
                _, at, f = np.unique(rank * many + a[chosen + 2], return_index=True, return_counts=True)
                at = chosen[at]
                yield from self.batches(words, of_three[at], f, a[at], a[at + 1], a[at + 2])
        last = [words[x] for x in a[-2:]]
        self.ids, self.held, self.skip = Ids(), 0, len(last)
        self.parts = [np.array([self.ids[w] for w in last], dtype=np.int64)]

    def by_mark(self, size: int, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts of phrases by their hash alone, so sorted hashes are enough."""
        marks = np.sort(marks)
        first = np.flatnonzero(np.concatenate([np.ones(min(len(marks), 1), bool), marks[1:] != marks[:-1]]))
        f = np.diff(first, append=len(marks))
        for at in range(0, len(first), BATCH_ROWS):
            part = slice(at, at + BATCH_ROWS)
            yield self.batch(size, None, marks[first[part]], f[part])

    def batches(self, words: list[bytes], marks: np.ndarray, f: np.ndarray, *places: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts of the phrases whose words stand at `places`, some at a time."""
        for at in range(0, len(f), BATCH_ROWS):
            part = slice(at, at + BATCH_ROWS)
            phrases = [b" ".join(p) for p in zip(*(map(words.__getitem__, x[part].tolist()) for x in places))]
            yield self.batch(len(places), phrases, marks[part], f[part])

    def batch(self, size: int, phrases: list[bytes] | None, marks: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        # A hash holds its language already.
        n = len(f)
        text = [pa.nulls(n, pa.string())] * 2 if phrases is None else [pa.array([self.lang] * n, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([text[0], pa.array(np.full(n, size, np.int32)), text[1], pa.array(marks.astype(np.int64)), pa.array(f.astype(np.int64))], names=["lang", "size", "phrase", "mark", "f"])


def texts(docs: DataFrame) -> DataFrame:
    """Language and text, and whether the document is in the sample; empty texts have no words."""
    known = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    text = F.col("text").cast("string")
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), text), F.lit(SAMPLE_OF)) == 0
    return docs.select(known.alias("lang"), text.alias("text"), drawn.alias("drawn")).where(F.length("text") > 0)


def count(rows: DataFrame, wanted: Wanted, least: int, flush_words: int = FLUSH_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact counts, over `rows`, of the wanted phrases with `least` occurrences; size 0 is a language's number of words."""
    held = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, Counter] = {}
        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                body = text.as_buffer().to_pybytes()
                if not held.value.in_text(body):
                    continue
                c = counters.setdefault(lang, Counter(lang, held.value))
                for block in blocks(body, block_bytes):
                    c.add(block)
                    if c.held >= flush_words:
                        yield from c.flush()
                c.end()
            # Many small languages together are bounded like one.
            if sum(c.held for c in counters.values()) >= 2 * flush_words:
                for c in counters.values():
                    yield from c.flush()
                counters.clear()
        for c in counters.values():
            yield from c.flush()

    found = rows.select("lang", "text").mapInArrow(run, COUNTED).groupBy("lang", "size", "phrase", "mark").agg(F.sum("f").alias("f"))
    return found.where((F.col("f") >= least) | (F.col("size") == 0))


def bits(marks: DataFrame, many: int, most: int = MOST_BITS) -> Bits:
    """The bit table of a column of hashes; its blocks come to the driver, `most` bits at most."""
    if not many:
        return Bits()
    size = BLOCK_BITS
    while size < min(most, BITS_EACH * many):
        size *= 2
    at = F.col("mark").bitwiseAND(F.lit(size - 1))
    rows = marks.groupBy(F.shiftright(at, 15).alias("block")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(BLOCK_BITS - 1))).alias("bits")).collect()
    data = np.zeros(size // 8, dtype=np.uint8)
    for r in rows:
        data[r["block"] * BLOCK_BITS // 8:(r["block"] + 1) * BLOCK_BITS // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return Bits(size, data)


def table_of(counted: DataFrame, size: int, most: int) -> Bits:
    chosen = counted.where(F.col("size") == size)
    return bits(chosen, chosen.count(), most)


def failures(counted: DataFrame, size: int, proposed: Bits, most: int) -> tuple[Bits, frozenset[bytes] | None]:
    """Bits of frequent phrases of the border, and a word of each if they are `MOST_NAMED` at most."""
    held = counted.sparkSession.sparkContext.broadcast(proposed)

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~held.value.has(b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64))))

    missed = settle(counted.where(F.col("size") == size).select("mark", "phrase").mapInArrow(missing, "mark long, phrase string"), "missed")
    many = missed.count()
    rows = missed.collect() if many <= MOST_NAMED else []
    # The longer word of a pair is likely the rarer one.
    named = frozenset(max(r["phrase"].split(" "), key=len).encode() for r in rows) if len(rows) == many and all(r["phrase"] for r in rows) else None
    return bits(missed, many, most), named


def proposals(rows: DataFrame, least: int, most: int) -> tuple[Bits, Bits]:
    """Words and pairs that are frequent enough in the sample."""
    sample = rows.where("drawn")
    words = table_of(settle(count(sample, Wanted(Bits(), Bits(), all_words=True), least), "sample-words"), 1, most)
    return words, table_of(settle(count(sample, Wanted(words, Bits(), by_mark=True), least), "sample-pairs"), 2, most)


def frequent(docs: DataFrame, least: int = LEAST, sample_least: int = SAMPLE_LEAST, most_bits: int = MOST_BITS, **blocks_of: int) -> tuple[DataFrame, int]:
    """Exact counts of all phrases of one to three words with `least` occurrences, and the number of passes that it took."""
    ship(docs.sparkSession)
    rows = texts(docs)
    words, pairs = proposals(rows, sample_least, most_bits)
    wanted, passes = Wanted(words, pairs, all_words=True, by_mark=True), 1
    now = settle(count(rows, wanted, least, **blocks_of), "counted")
    found = [now.where("size <= 1")]
    marks = now.where("size >= 2")
    likely = bits(marks, marks.count(), most_bits)
    while True:
        more_words, _ = failures(now, 1, wanted.words, most_bits)
        more_pairs, named = failures(now, 2, wanted.pairs, most_bits)
        if not (likely.size or more_words.size or more_pairs.size):
            break
        passes += 1
        wanted = Wanted(wanted.words.union(more_words), wanted.pairs.union(more_pairs), wanted.words, wanted.pairs, likely,
                        named=None if likely.size or more_words.size else named)
        now, likely = settle(count(rows, wanted, least, **blocks_of), "counted"), Bits()
        found.append(now)
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.select("lang", "size", "phrase", "f"), passes


def scored(counts: DataFrame) -> DataFrame:
    """Candidates with the cut that scores lowest."""
    part = lambda i, n: F.concat_ws(" ", F.slice("w", i, n))
    cut = lambda k: F.struct(F.lit(k).alias("k"), part(1, k).alias("first"), part(k + 1, 3).alias("rest"))
    split = counts.where("size >= 2").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = split.select("lang", "size", "phrase", "a", F.explode(F.when(F.col("size") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))).alias("c")).select("lang", "size", "phrase", "a", "c.*")
    f = counts.where("size between 1 and 2")
    left = f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    # Decimals hold a * a * 1000000 for counts up to 10^14.
    exact = {c: f"CAST({c} AS DECIMAL(14,0))" for c in "alr"}
    score = F.expr(f"({exact['a']} * {exact['a']} * CAST(1000000 AS DECIMAL(7,0))) div ({exact['l']} * {exact['r']})")
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    best = cuts.groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "size", "phrase", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, **options: int) -> DataFrame:
    """Each language's `top` phrases that no longer one with half of their occurrences contains."""
    counted = settle(frequent(docs, least, **options)[0], "frequent")
    longer = counted.where("size = 3").select("lang", F.split("phrase", " ").alias("w"), "f")
    inside = longer.select("lang", "f", F.explode(F.array(F.concat_ws(" ", F.slice("w", 1, 2)), F.concat_ws(" ", F.slice("w", 2, 2)))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    kept = scored(counted).join(inside, ["lang", "phrase"], "left").where("within IS NULL OR 100 * within < 50 * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    first = kept.withColumn("place", F.row_number().over(salted)).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = counted.where("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
