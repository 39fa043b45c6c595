"""Byte-pair encoding and decoding as streaming transducers.

Encoding reads one symbol at a time. The state is the longest end of what was read that begins
a token; it and the next symbol give the next state and the tokens that end there. For every
position of a word the last token of the encoding of what was read so far is kept: the longest
one ending there that is stable on its own and beside the last token of the position where it
starts. Two tokens are stable beside each other if no merge across their border comes before the
merges that use up the symbols on either side. Merges reach back by less than the longest token:
this is the lookahead, computed from the merge list. A border is settled as soon as the paths of
all positions within the lookahead run through it, and the tokens before it are emitted; what is
held does not grow with the word. A word's last symbol carries the end mark, so it is known when
the next one is read.

Decoding feeds the emitted ids one at a time, by the rule of the tokenizer file: names parted by
blanks where the file has no decoder, else bytes, held until a character is whole.

The different chunks of a batch are encoded and decoded once each. Those seen before are looked
up; a worker remembers as many as `tokens.Known` does.

Cases: null and empty texts have no tokens; special tokens in a text are ids of their own, as
the library has it; unused truncation and padding play no part; repeated rows give repeated
rows; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import sys
from array import array
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import id_and_text, ship, slices
from .tokens import BEYOND_LATIN, LONGEST_KNOWN, SEPARATORS, WORD_PATTERN, Known, byte_letters

#: Meanings that a worker remembers (of pairs of tokens twice as many), and steps from a state.
MOST_KNOWN, MOST_STEPS = 400_000, 200_000
NEVER = 1 << 60
#: Characters of text whose different chunks are held at one time.
SLICE = 4_000_000
#: White space as the vocabulary's normalizer has it.
BLANKS = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Worked(dict):
    """Values worked out when first asked for; emptied when they are too many."""

    def __init__(self, work: Callable[[Hashable], Any], most: int):
        super().__init__()
        self.work, self.most = work, most

    def __missing__(self, key: Hashable) -> Any:
        if len(self) >= self.most:
            self.clear()
        got = self[key] = self.work(key)
        return got


class Vocabulary:
    """The merge list of a tokenizer file and what follows from it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end_mark = model["end_of_word_suffix"] or ""
        decoder = config.get("decoder")
        #: What turns tokens into text: "ByteLevel", or None for names parted by blanks.
        self.decoder = decoder and decoder["type"]
        self.bytes = {letter: b for b, letter in byte_letters().items()}
        self.specials = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.specials.items()}
        self.rank: dict[tuple[str, str], int] = {}
        self.made_of: dict[str, tuple[str, str]] = {}
        for k, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[left, right] = k
            self.made_of.setdefault(left + right, (left, right))
        self.lookahead = max(map(self.width, self.made_of), default=1)
        #: Tokens that the merges of their own symbols end in.
        self.stable = {t: t for t in self.ids if self.reached(t)}
        #: What begins a token.
        self.begun = {t[:n] for t in self.stable for n in range(1, self.width(t) + 1)}
        #: By a state and a symbol: the next state and the tokens that end there; those that end there if it is the word's last.
        self.moves = Worked(self.move, MOST_STEPS)
        self.endings = Worked(lambda read: self.ending(read, self.end_mark), MOST_STEPS)
        self.beside = Worked(self.stable_beside, 2 * MOST_KNOWN)
        self.right_edges: dict[str, list] = {}
        self.left_edges: dict[str, list] = {}

    def width(self, token: str) -> int:
        """Symbols of a token."""
        return len(token) - len(self.end_mark) if self.end_mark and token.endswith(self.end_mark) else len(token)

    def symbols(self, token: str) -> list[str]:
        n = self.width(token)
        return [*token[: n - 1], token[n - 1:]]

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at one edge of a token while it is built: each piece and the rank of the merge that uses it up."""
        held = self.right_edges if side else self.left_edges
        if token not in held:
            pair = self.made_of.get(token)
            held[token] = [(token, NEVER)] if pair is None else [*((p, min(until, self.rank[pair])) for p, until in self.edge(pair[side], side)), (token, NEVER)]
        return held[token]

    def move(self, read: str) -> tuple[str, list[tuple[str, int]]]:
        """The longest end of what was read that begins a token, and the tokens that end there."""
        while read and read not in self.begun:
            read = read[1:]
        return read, self.ending(read, "")

    def ending(self, read: str, mark: str) -> list[tuple[str, int]]:
        """Stable tokens at the end of what was read, the longest first, and their symbols."""
        return [(self.stable[t], n) for n in range(len(read), 0, -1) if (t := read[-n:] + mark) in self.stable]

    def stable_beside(self, pair: tuple[str, str]) -> bool:
        """Whether no merge across the border of two tokens comes first. Of equal merges the one further left comes first."""
        for x, x_until in self.edge(pair[0], 1):
            for y, y_until in self.edge(pair[1], 0):
                r = self.rank.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True

    def reached(self, token: str) -> bool:
        """Whether the merges of a token's own symbols end in it."""
        parts = self.symbols(token)
        while len(parts) > 1:
            rank, i = min((self.rank.get(p, NEVER), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                return False
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return True


class WordTransducer:
    """One word, read symbol by symbol; `push` and `finish` give the tokens that have become certain."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        #: What was read since the last settled border, and the longest end of all that was read that begins a token.
        self.text = self.state = ""
        #: The last token of each position since the last settled border, and where it starts.
        self.last: list[str] = [""]
        self.back: list[int] = [0]
        #: The token before the settled border; what follows must be stable beside it.
        self.before = ""

    def push(self, symbols: str) -> list[str]:
        """Read symbols that are not the word's last."""
        out, room = [], 4 * self.v.lookahead
        while symbols:
            n = max(self.v.lookahead, room - len(self.text))
            self.read(symbols[:n], "")
            symbols = symbols[n:]
            if len(self.text) >= room:
                out += self.settled()
        return out

    def read(self, symbols: str, mark: str) -> None:
        v, last, back, state = self.v, self.last, self.back, self.state
        moves, beside = v.moves, v.beside
        for i, symbol in enumerate(symbols, len(self.text) + 1):
            read = state + symbol
            if mark:
                tokens = v.endings[read]
            else:
                state, tokens = moves[read]
            for token, n in tokens:
                start = i - n
                # A token across the settled border is on no path.
                if start < 0:
                    continue
                left = last[start] if start else self.before
                if not left or beside[left, token]:
                    last.append(token)
                    back.append(start)
                    break
            else:
                raise ValueError(f"no token ends in {symbol!r}")
        self.text, self.state = self.text + symbols, state

    def finish(self, symbol: str) -> list[str]:
        """Read the word's last symbol."""
        self.read(symbol, self.v.end_mark)
        return self.path(len(self.text))

    def path(self, i: int) -> list[str]:
        out = []
        while i:
            out.append(self.last[i])
            i = self.back[i]
        return [t for t in reversed(out) if t]

    def settled(self) -> list[str]:
        """Tokens up to the last border that the paths of all positions within the lookahead have in common."""
        n = len(self.text)
        meet = {n - k for k in range(self.v.lookahead + 1)}
        while len(meet) > 1:
            far = max(meet)
            meet.discard(far)
            meet.add(self.back[far])
        border = meet.pop()
        if not border:
            return []
        out = self.path(border)
        self.before = self.last[border]
        self.text = self.text[border:]
        self.last = ["", *self.last[border + 1:]]
        self.back = [0, *(max(0, b - border) for b in self.back[border + 1:])]
        return out


class Encoder:
    """Whole texts to (ids of four bytes each, what these ids decode to)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.v = Vocabulary(path)
        self.split = regex.compile(WORD_PATTERN)
        self.letters = byte_letters()
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.v.specials, key=len, reverse=True)) or "(?!)")
        # How letters beyond the Latin blocks are composed, lowered and split is the library's affair.
        library = Tokenizer.from_file(path)
        self.normalized, self.pieces = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.known = Known(self.chunk)
        self.meanings = Meanings(self.v)
        #: A word and one of these are two pieces.
        self.marks = {m: self.word(m) for m in ".,"}

    def word(self, written: str) -> bytes:
        if len(written) <= self.v.lookahead:
            return array("I", map(self.v.ids.__getitem__, self.short(written))).tobytes()
        t = WordTransducer(self.v)
        tokens = t.push(written[:-1]) + t.finish(written[-1])
        return array("I", map(self.v.ids.__getitem__, tokens)).tobytes()

    def short(self, text: str) -> list[str]:
        """A word within the lookahead, in one go: nothing is certain before its end."""
        v, many, state = self.v, len(text), ""
        moves, beside, last, back = v.moves, v.beside, [""], [0]
        for i, symbol in enumerate(text, 1):
            if i < many:
                state, tokens = moves[state + symbol]
            else:
                tokens = v.endings[state + symbol]
            for token, n in tokens:
                left = last[i - n]
                if not left or beside[left, token]:
                    last.append(token)
                    back.append(i - n)
                    break
            else:
                raise ValueError(f"no token ends in {symbol!r}")
        out = []
        while many:
            out.append(last[many])
            many = back[many]
        out.reverse()
        return out

    def spelled(self, piece: str) -> str:
        """The letters of the piece's bytes."""
        return piece.encode("utf-8").decode("latin-1").translate(self.letters)

    def piece(self, piece: str) -> bytes:
        # Printable characters without a blank are written as they are; other bytes have letters of their own.
        if not (piece.isascii() and piece.isprintable()):
            return self.word(self.spelled(piece))
        # A word of letters is a chunk as well.
        return self.known[piece] if piece.isalpha() else self.word(piece)

    def chunk(self, chunk: str) -> bytes:
        text = chunk.lower()
        # In the Latin blocks nothing is left to compose, and Python lowers as the library does.
        if chunk.isascii() or (max(chunk) < BEYOND_LATIN and max(text) < BEYOND_LATIN):
            if text.isalpha():
                return self.known[text] if text != chunk else self.word(text if text.isascii() else self.spelled(text))
            word = text[:-1]
            if text[-1] in self.marks and word.isalpha():
                return self.known[word] + self.marks[text[-1]]
        else:
            text = self.normalized(chunk)
        if text and (max(text) >= BEYOND_LATIN or any(c in text for c in SEPARATORS)):
            return b"".join([self.word(p) for p, _ in self.pieces(text)])
        return b"".join([self.piece(p) for p in self.split.findall(text)])

    def chunks(self, text: str) -> list[str]:
        return [c for c in BLANKS.split(text) if c] if any(c in text for c in SEPARATORS) else text.split()

    def plain(self, text: str) -> list[bytes]:
        return list(map(self.known.__getitem__, self.chunks(text)))

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids, and the text that they decode to."""
        parts, at = [], 0
        for m in self.special.finditer(text or ""):
            parts += self.plain(text[at:m.start()])
            parts.append(array("I", [self.v.specials[m[0]]]).tobytes())
            at = m.end()
        parts += self.plain((text or "")[at:])
        self.known.forget()
        ids = b"".join(parts)
        back = self.meanings.after_others(parts)
        return ids, decoded(self.v, array("I", ids)) if back is None else back

    def batch(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """What `encode` gives for each text: the different chunks of all texts are encoded and decoded once, then put in each text's order."""
        whole = [bool(t and self.special.search(t)) for t in texts]
        split = pc.split_pattern(pa.array([" ".join(self.chunks(t)) or None if t and not w else None for t, w in zip(texts, whole)], pa.string()), " ")
        of = split.flatten().dictionary_encode()
        ids = list(map(self.known.__getitem__, of.dictionary.to_numpy(zero_copy_only=False).tolist()))
        self.known.forget()
        meant = self.meanings.each(ids)
        if None in meant:
            return list(map(self.encode, texts))
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy())])
        parts = []
        for values in (pa.array(ids, pa.large_binary()), pa.array(meant, pa.large_string())):
            _, offsets, data = values.take(of.indices).buffers()
            at = np.frombuffer(offsets, np.int64)[ends].tolist() if len(of) else [0] * len(ends)
            held = memoryview(data or b"")
            parts.append([bytes(held[a:b]) for a, b in zip(at, at[1:])])
        return [self.encode(t) if w else (i, self.meanings.first(b.decode("utf-8"))) for t, w, i, b in zip(texts, whole, *parts)]


class Decoder:
    """Ids to text, one at a time: `feed` gives the characters that have become whole."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.bytes = vocabulary.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token_id: int) -> str:
        name = self.v.names[token_id]
        if name in self.v.specials:
            return self.state.decode(b"", final=True) + name
        mark = self.v.end_mark
        ends = bool(mark) and name.endswith(mark)
        raw = bytes(self.bytes[c] for c in (name[: -len(mark)] if ends else name))
        return self.state.decode(raw) + (self.state.decode(b"", final=True) + " " if ends else "")

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


class FileDecoder:
    """Ids to text, one at a time, by the rule of the tokenizer file."""

    def __init__(self, vocabulary: Vocabulary):
        if vocabulary.decoder not in (None, "ByteLevel"):
            raise ValueError(f"no rule for decoder {vocabulary.decoder}")
        self.names, self.letters = vocabulary.names, vocabulary.bytes
        self.state, self.started = codecs.getincrementaldecoder("utf-8")("replace"), False
        self.feed = self.name if vocabulary.decoder is None else self.characters

    def name(self, token_id: int) -> str:
        if self.started:
            return " " + self.names[token_id]
        self.started = True
        return self.names[token_id]

    def characters(self, token_id: int) -> str:
        name, letters = self.names[token_id], self.letters
        return self.state.decode(bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode("utf-8"))

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


class Meanings:
    """What the ids of chunks decode to, remembered by the ids.

    All that a decoder carries from one chunk to the next is whether anything came before, so
    chunks are decoded as if something did. A chunk that ends within a character carries more.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.decoder = vocabulary, FileDecoder(vocabulary)
        self.decoder.started = True
        self.known: dict[bytes, str | None] = {}

    def of(self, ids: bytes) -> str | None:
        got = self.known.get(ids, "")
        if got == "":
            d = self.decoder
            got = "".join(map(d.feed, array("I", ids)))
            got = None if d.finish() else got
            d.state.reset()
            if len(ids) <= 4 * LONGEST_KNOWN and len(self.known) < MOST_KNOWN:
                self.known[ids] = got
        return got

    def each(self, parts: list[bytes]) -> list[str | None]:
        """What each chunk's ids decode to after others."""
        known, of = self.known, self.of
        return [known.get(p) or of(p) for p in parts]

    def first(self, text: str) -> str:
        """The text of chunks that nothing came before."""
        return text[1:] if self.v.decoder is None else text

    def after_others(self, parts: list[bytes]) -> str | None:
        """The text of chunks one after the other; null if one of them does not end with a character."""
        found = self.each(parts)
        return None if None in found else self.first("".join(found))


def decoded(vocabulary: Vocabulary, ids: array) -> str:
    d = FileDecoder(vocabulary)
    return "".join(map(d.feed, ids)) + d.finish()


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    held = sys.modules[__name__].__dict__.setdefault("_encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Number and checksums of every document's ids and of what they decode to."""
    ship(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in slices(batches, most=SLICE):
            n, ids_sum, text_sum = [], [], []
            for ids, back in e.batch(b.column(1).to_pylist()):
                n.append(len(ids) // 4)
                ids_sum.append(hashlib.sha256(ids).hexdigest())
                text_sum.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sum, pa.string()), pa.array(text_sum, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(rows, SCHEMA)
