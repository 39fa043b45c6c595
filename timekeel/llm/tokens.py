"""Encoding with the tokenizers library, once for each different chunk between blanks.

Both public vocabularies split a text before they merge, so what stands between blanks is
encoded apart from the rest. The different chunks of a batch are looked up once each. A worker
keeps the ids of the first `MOST_KNOWN` that it has seen and asks the library's model for others only. Texts and chunks for which this is not certain to be the
same (runs of blanks, other white space, special tokens, letters beyond the Latin blocks)
go to the library's encode whole.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Chunks that a worker remembers, and the longest that it does.
MOST_KNOWN, LONGEST_KNOWN = 500_000, 48
#: The first character that is not taken apart here.
BEYOND_LATIN = "\u0250"
#: White space for Python but not for the vocabularies.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Blanks and line ends that follow each other.
RUNS = ("  ", "\n\n", " \n", "\n ")
#: Stands before a text's first chunk. No text that is taken apart holds it: it is a separator.
FIRST = "\x1c"
#: How the two kinds of vocabulary split a text (the patterns of their files).
LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Known(dict):
    """Ids of chunks, worked out when first asked for; those that are too many or too long to remember are held aside until `forget`."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.passing = encode, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.passing.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
            (self if len(chunk) <= LONGEST_KNOWN and len(self) < MOST_KNOWN else self.passing)[chunk] = ids
        return ids

    def forget(self) -> None:
        self.passing = {}


class Encoder:
    """Texts to ids, four bytes each, as `Tokenizer.encode(text, add_special_tokens=False)` gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.specials = [t["content"] for t in config["added_tokens"]]
        # A splitter that drops white space leaves nothing of it to keep with the next word.
        self.drops_space = "Removed" in json.dumps(config["pre_tokenizer"])
        self.split = regex.compile(WORD_PATTERN if self.drops_space else LEVEL_PATTERN)
        self.lowers = config["normalizer"] is not None
        self.letters = byte_letters()
        self.blank = self.letters[32]
        self.model = self.library.model
        self.tokenize = self.model.tokenize
        self.known = Known(self.chunk)
        #: A word and one of these are two pieces for both vocabularies.
        self.marks = {m: self.piece(m) for m in ".,"}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=np.uint32).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def parted(self, text: str) -> str | None:
        """The text with a blank between parts that are encoded apart; None if it is not certain that they are."""
        if any(s in text for s in self.specials) or any(c in text for c in SEPARATORS):
            return None
        if self.drops_space:
            return " ".join(text.split())
        # Printable texts have no white space but blanks and line ends; others are counted.
        if not text.replace("\n", " ").isprintable() and len(text.split()) != text.count(" ") + text.count("\n") + 1:
            return None
        if text[0] in " \n" or text[-1] in " \n" or any(s in text for s in RUNS):
            return None
        # A chunk after a blank is encoded with it; the first, and one after a line's end, without.
        return FIRST + text.replace("\n", " \n")

    def meant(self, chunk: str) -> str:
        return chunk if self.drops_space else chunk[1:] if chunk[0] == FIRST else chunk if chunk[0] == "\n" else " " + chunk

    def chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            if chunk.isascii():
                return self.ids((chunk.lower() if self.lowers else chunk) if self.drops_space else self.blank + chunk)
            if not self.drops_space and max(chunk) < BEYOND_LATIN:
                return self.ids(self.blank + self.spelled(chunk))
        word = chunk[:-1]
        if chunk[-1] in self.marks and word.isalpha() and (word.isascii() or not self.lowers and max(word) < BEYOND_LATIN):
            return self.known[word] + self.marks[chunk[-1]]
        text = self.meant(chunk)
        if not text.isascii() and max(text) >= BEYOND_LATIN:
            return self.whole([text])[0]
        if self.lowers:
            text = text.lower() if text.isascii() else self.library.normalizer.normalize_str(text)
        plain = text.isalpha() if self.drops_space else chunk.isalpha()
        return self.piece(text) if plain else b"".join(map(self.known_piece, self.split.findall(text)))

    def known_piece(self, piece: str) -> bytes:
        # A word of letters is a chunk as well, without the blank before it.
        word = piece if self.drops_space else piece[1:] if piece[0] == " " else ""
        got = self.known.get(word) if word.isalpha() else None
        return self.piece(piece) if got is None else got

    def piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            written = piece
        elif piece[0] == " " and piece[1:].isalpha() and piece.isascii():
            written = self.blank + piece[1:]
        else:
            written = self.spelled(piece)
        return self.ids(written)

    def spelled(self, piece: str) -> str:
        """The letters of the piece's bytes."""
        return piece.encode("utf-8").decode("latin-1").translate(self.letters)

    def ids(self, written: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(written)]).tobytes()

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text: those of the different chunks of all texts together, put in each text's order."""
        parted = [self.parted(t) if t else "" for t in texts]
        split = pc.split_pattern(pa.array([p or None for p in parted], pa.string()), " ")
        of = split.flatten().dictionary_encode()
        ids = list(map(self.known.__getitem__, of.dictionary.to_numpy(zero_copy_only=False).tolist()))
        self.known.forget()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, chunk = np.frombuffer(b"".join(ids), np.uint32), of.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[chunk])])
        place = np.repeat((np.cumsum(size) - size)[chunk] - ends[:-1], size[chunk]) + np.arange(ends[-1])
        raw = flat[place].tobytes()
        at = (ends[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy())])] * 4).tolist()
        return [raw[a:b] if p is not None else self.whole([t])[0] for a, b, p, t in zip(at, at[1:], parted, texts)]


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary: what it has learned serves the next task."""
    held = sys.modules[__name__].__dict__.setdefault("_encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]
