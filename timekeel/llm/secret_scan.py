"""Secret scan with a recursive decoding worklist.

The text is layer 0. Each layer is scanned, then unwrapped in every known way: percent
escapes, Unicode escapes, base64 runs, and compressed bytes inside base64. What comes out
is a new layer with a map to positions of the original text. The worklist ends when no
layer gives a new one; a layer with the same content at the same place as an earlier one
is not taken up again, so cycles end too.

Cases: null and empty texts have no spans; repeated rows and ids give repeated rows; other
columns are not looked at; an empty table gives an empty result. Decoded bytes that are not
printable UTF-8 make no layer. `incomplete` is true if unwrapping a text would hold more
than `most` decoded characters (a decompression bomb): the layers up to there count.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, ship

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
#: Runs that pass are those of 32 or more, so shorter ones need not be matched first.
HEX = re.compile(r"[0-9a-f]{32,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})")
#: "token:" and eight characters are 14 bytes, which base64 writes with 19 characters.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{19,}={0,2}")
MOST_DECODED = 1 << 26
URLSAFE = bytes.maketrans(b"-_", b"+/")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, incomplete boolean"


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain findings of one layer."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text with the original position of each character: `begin[i]` to `end[i]`."""

    def __init__(self, text: str, begin: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text, self.begin, self.end = text, begin, end

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.begin is None else (int(self.begin[start]), int(self.end[end - 1]))

    def derived(self, text: str, starts: np.ndarray, ends: np.ndarray) -> "Layer":
        """A layer whose character i comes from this one's characters starts[i] to ends[i]."""
        if self.begin is None:
            return Layer(text, starts, ends)
        return Layer(text, self.begin[starts], self.end[ends - 1])


def printable(raw: bytes) -> str | None:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and all(c.isprintable() or c in "\t\n\r\f\v" for c in text) else None


def byte_of_char(text: str) -> np.ndarray:
    """First byte of each character in UTF-8, and the length of all at the end."""
    return np.concatenate([[0], np.cumsum([len(c.encode("utf-8")) for c in text])]).astype(np.int64)


def replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match replaced by what `decode` makes of it: (text, first and last source character of each)."""
    out, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        got = decode(m[0])
        if got is None:
            continue
        text, s, e = got
        out += [layer.text[at:m.start()], text]
        plain = np.arange(at, m.start(), dtype=np.int64)
        starts += [plain, s + m.start()]
        ends += [plain + 1, e + m.start()]
        at = m.end()
    if not out:
        return None
    plain = np.arange(at, len(layer.text), dtype=np.int64)
    return layer.derived("".join([*out, layer.text[at:]]), np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1]))


def percent(run: str):
    text = printable(bytes.fromhex(run.replace("%", "")))
    if text is None:
        return None
    at = byte_of_char(text) * 3
    return text, at[:-1], at[1:]


def escape(code: str):
    value = int(code.strip("\\uUx{}"), 16)
    if value > 0x10FFFF or 0xD800 <= value < 0xE000:
        return None
    return chr(value), np.zeros(1, np.int64), np.full(1, len(code), np.int64)


SURROGATES = re.compile(r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}")


def surrogate_pair(code: str):
    value = 0x10000 + ((int(code[2:6], 16) - 0xD800) << 10) + int(code[8:12], 16) - 0xDC00
    return chr(value), np.zeros(1, np.int64), np.full(1, 12, np.int64)


def inflate(raw: bytes, most: int) -> tuple[bytes | None, bool]:
    """What compressed bytes hold, and whether it was more than `most`; None if they aren't compressed."""
    if raw[:2] == b"\x1f\x8b":
        box = zlib.decompressobj(31)
    elif len(raw) > 2 and raw[0] == 0x78 and (raw[0] << 8 | raw[1]) % 31 == 0:
        box = zlib.decompressobj()
    elif raw[:3] == b"BZh":
        box = bz2.BZ2Decompressor()
    elif raw[:6] == b"\xfd7zXZ\x00":
        box = lzma.LZMADecompressor()
    else:
        return None, False
    try:
        got = box.decompress(raw, most + 1)
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
        return None, False
    return (None, True) if len(got) > most else (got or None, False)


def unwrapped(layer: Layer, most: int) -> Iterator[tuple[Layer | None, bool]]:
    """The layers directly inside this one; with true, one that would be too large."""
    text = layer.text
    if "%" in text:
        yield replaced(layer, PERCENT, percent), False
    if "\\" in text:
        joined = replaced(layer, SURROGATES, surrogate_pair) or layer
        plain = replaced(joined, ESCAPE, escape)
        yield plain or (joined if joined is not layer else None), False
    for m in BASE64.finditer(text):
        body = m[0].rstrip("=")
        body = body[: len(body) - (len(body) % 4 == 1)]
        try:
            raw = base64.b64decode(body.encode().translate(URLSAFE) + b"=" * (-len(body) % 4), validate=True)
        except ValueError:
            continue
        whole, known = False, {raw}
        while True:
            inner, over = inflate(raw, most)
            if over:
                yield None, True
            if inner is None or inner in known:
                break
            whole, raw = True, inner
            known.add(raw)
        inside = printable(raw)
        if inside is None:
            continue
        if whole:
            n = len(inside)
            yield layer.derived(inside, np.full(n, m.start(), np.int64), np.full(n, m.end(), np.int64)), False
        else:
            at = byte_of_char(inside) * 8
            yield layer.derived(inside, m.start() + at[:-1] // 6, m.start() + (at[1:] - 1) // 6 + 1), False


def spans_of(text: str, most: int = MOST_DECODED) -> tuple[list, list, int, bool]:
    """Plain findings, all findings (start, kind number, end), layers seen, and whether any was too large."""
    base = scan(text)
    found, held, incomplete = set(base), 0, False
    todo, seen = deque([Layer(text)]), {(text, 0, len(text))}
    while todo:
        layer = todo.popleft()
        for inner, over in unwrapped(layer, most - held):
            incomplete |= over
            if inner is None:
                continue
            key = (inner.text, *inner.origin(0, len(inner.text)))
            if key in seen:
                continue
            if held + len(inner.text) > most:
                incomplete = True
                continue
            seen.add(key)
            held += len(inner.text)
            todo.append(inner)
            for start, kind, end in scan(inner.text):
                start, end = inner.origin(start, end)
                found.add((start, kind, end))
    return base, sorted(found), len(seen), incomplete


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i in range(b.num_rows):
            base, every, layers, incomplete = spans_of(b.column(1)[i].as_py() or "")
            kinds = [k for _, k, _ in base]
            out.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), layers, incomplete))
        cols = list(zip(*out)) or [()] * 7
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.bool_()]
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "incomplete"]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Every secret of every text, plain or wrapped, one row per document."""
    ship(docs.sparkSession)
    return id_and_text(docs).mapInArrow(_rows, SCHEMA)


def mask(text: str) -> str:
    """The text with every span written as [SECRET]; spans that touch or overlap become one."""
    out, at, open_until = [], 0, -1
    for start, _, end in spans_of(text)[1]:
        if start > open_until:
            out += [text[at:start], "[SECRET]"]
        at = open_until = max(end, open_until)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with secrets masked in `text`, and `n_chars` of the new text where there is such a column."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def change(batches):
        for b in batches:
            texts = [x if x is None else mask(x) for x in b.column(at).to_pylist()]
            cols = list(b.columns)
            if size is not None:
                cols[size] = pa.array([len(new) if new is not None and new != old else n for new, old, n in zip(texts, cols[at].to_pylist(), cols[size].to_pylist())], cols[size].type)
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(change, docs.schema)
