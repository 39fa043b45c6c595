"""Tokens against the library itself, wavelet matrices against lists, packing against its rules."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from timekeel.llm import common, packing, tokens, transducer, wavelet

LEVEL, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path):
    return Tokenizer.from_file(path)


def key(i):
    return (i is not None, i or 0)


def odd_texts():
    rng = random.Random(1)
    return ["", " ", "a", "a  b <|endoftext|> c\n\n d's 12", " x\ty z é É don't\n", "x\x1cy\n z q", "I'll 12345 ΣΑΣ ẞ İ 日本語 ﬁ ½", "the" * 300, "aaaa" * 100 + " b\x1cc\x85d", "!!!---", "\nab\n",
            "".join(rng.choice("etaoinsh") for _ in range(2000)), "".join(rng.choice("abcd \n") for _ in range(2000)), "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(1500))]


def fuzzed_texts(n=4000):
    """Short texts of blanks, control characters, joiners, letters of many blocks, and what stands beside the surrogates."""
    rng = random.Random(7)
    odd = [*map(chr, range(0x21)), "\x7f", "\x85", "\xa0", "\u200b", "\u200d", "\u2028", "\ufeff", "\ufffd", "\ud7ff", "\ue000", "\U0001f600", "\U0010ffff", "\u0301", "ß", "İ", "é", "日", "'s", "12", "a", "B", "the", "ing", "<|endoftext|>"]
    return ["".join(rng.choice(odd if rng.random() < 0.6 else [" ", "a", "in", "\0"]) for _ in range(rng.randint(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("path", [LEVEL, WORD])
def test_odd_characters_anywhere(path):
    t, e = library(path), tokens.encoder(path)
    texts = fuzzed_texts()
    assert [list(np.frombuffer(x, np.uint32)) for x in e.batch(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_transducer_on_odd_characters_anywhere():
    t, e = library(WORD), transducer.encoder(WORD)
    for text in fuzzed_texts():
        want = t.encode(text, add_special_tokens=False).ids
        ids, back = e.encode(text)
        assert list(np.frombuffer(ids, np.uint32)) == want, text
        assert back == t.decode(want, skip_special_tokens=False)


def test_a_symbol_that_no_token_has_is_not_passed_over():
    with pytest.raises(ValueError):
        transducer.encoder(WORD).word("a\x01b")


@pytest.mark.parametrize("path", [LEVEL, WORD])
def test_chunks_are_encoded_as_whole_texts(path):
    t, e = library(path), tokens.encoder(path)
    texts = odd_texts()
    assert [list(np.frombuffer(x, np.uint32)) for x in e.batch(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert e.batch([None, "a"])[0] == b""


@pytest.mark.parametrize("path", [LEVEL, WORD])
def test_words_before_marks_are_looked_up(path, monkeypatch):
    e, asked = tokens.Encoder(path), []
    e.batch(["some words here"])
    model = e.tokenize
    monkeypatch.setattr(e, "tokenize", lambda w: asked.append(w) or model(w))
    texts = ["x words, words here.", "x words. here, \u00e9words,"]
    got = e.batch(texts)
    assert len(asked) == (2 if path == LEVEL else 3)
    assert [list(np.frombuffer(x, np.uint32)) for x in got] == [library(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_chunks_beyond_those_remembered(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_KNOWN", 2)
    e, texts = tokens.Encoder(LEVEL), ["the one, the two the one", None, "", "two " + "o" * 60 + " one", "a\tb", "one\ntwo"]
    for _ in range(2):
        assert [list(np.frombuffer(x, np.uint32)) for x in e.batch(texts)] == [library(LEVEL).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(e.known) == 2 and not e.known.passing


def test_workers_get_small_batches(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('words ', 20000) AS text").coalesce(1)
    common.ship(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    assert docs.mapInArrow(sizes, "n long").agg({"n": "max"}).head()[0] < 1 << 23


def test_transducer_gives_the_librarys_ids_and_text():
    t, e = library(WORD), transducer.encoder(WORD)
    for text in odd_texts():
        want = t.encode(text, add_special_tokens=False).ids
        ids, decoded = e.encode(text)
        assert list(np.frombuffer(ids, np.uint32)) == want
        assert decoded == t.decode(want, skip_special_tokens=False)


def latin_texts():
    """Every character below the first that is left to the library, alone, between letters, and before marks."""
    return [form.replace("?", chr(c)) for c in range(0x260) for form in ("?", "a?b", "?.", "The?, x", "?\u0301,", "?'s ?12")]


def test_batches_are_encoded_and_decoded_as_single_texts():
    t, e = library(WORD), transducer.Encoder(WORD)
    texts = [None, *odd_texts(), *fuzzed_texts(1000), *latin_texts(), "the" * 40 + "x" * 50 + "ing", None, "a"]
    got = e.batch(texts)
    for text, (ids, back) in zip(texts, got, strict=True):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert list(np.frombuffer(ids, np.uint32)) == want, text
        assert back == t.decode(want, skip_special_tokens=False)
    assert e.batch([]) == [] and e.batch([None, " "]) == [(b"", "")] * 2
    # A chunk that does not end with a character is decoded with what follows.
    e.meanings.known[e.known["a"]] = None
    assert e.batch(["b a", "b"]) == [e.encode("b a"), e.encode("b")] and e.encode("b a")[1] == "b</w> a</w>"


def test_transducer_encodes_the_different_chunks_of_a_batch_once(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_KNOWN", 0)
    e, asked = transducer.Encoder(WORD), []
    word = e.word
    monkeypatch.setattr(e, "word", lambda w: asked.append(w) or word(w))
    got = e.batch(["Words here, words. Words", None, "caf\u00e9, words Here Caf\u00e9"])
    assert sorted(asked) == sorted(["words", "here", e.spelled("caf\u00e9")]) and not e.known and not e.known.passing
    want = library(WORD).encode("caf\u00e9, words Here Caf\u00e9", add_special_tokens=False).ids
    assert list(np.frombuffer(got[2][0], np.uint32)) == want


def test_a_symbol_is_read_in_one_step():
    """However long the tokens may be, a symbol is looked at with the state before it alone."""
    e, asked = transducer.Encoder(WORD), []
    e.word("internationalising" * 20 + "s")

    class Asked(dict):
        def __contains__(self, token):
            asked.append(token)
            return dict.__contains__(self, token)

    e.v.stable = Asked({t: t for t in e.v.stable})
    e.word("internationalising" * 30 + "s")
    assert not asked


def test_steps_beyond_those_remembered(monkeypatch):
    want = [transducer.encoder(WORD).encode(t) for t in odd_texts()]
    monkeypatch.setattr(transducer, "MOST_STEPS", 2)
    monkeypatch.setattr(transducer, "MOST_KNOWN", 1)
    e = transducer.Encoder(WORD)
    assert e.batch(odd_texts()) == want
    assert len(e.v.moves) <= 2 and len(e.v.endings) <= 2 and len(e.v.beside) <= 2 and len(e.meanings.known) <= 1


def test_transducer_holds_no_more_of_a_longer_word():
    v = transducer.Vocabulary(WORD)
    held = []
    for n in (2_000, 20_000):
        t = transducer.WordTransducer(v)
        rng, most = random.Random(n), 0
        for _ in range(n // 50):
            t.push("".join(rng.choice("etaoinshrd") for _ in range(50)))
            most = max(most, len(t.text))
        held.append(most)
    assert held[1] <= 2 * held[0] <= 2000


def test_decoder_gives_characters_when_they_are_whole():
    e = transducer.encoder(WORD)
    d = transducer.Decoder(e.v)
    out = "".join(d.feed(i) for i in np.frombuffer(e.encode("Größe 日本 x")[0], np.uint32)) + d.finish()
    assert out == "größe 日本 x "


def test_decoded_text_comes_from_the_ids():
    e = transducer.Encoder(WORD)
    a, b = e.v.ids["a</w>"], e.v.ids["b</w>"]
    e.v.ids = e.v.ids | {"a</w>": b, "b</w>": a}
    assert e.encode("a b")[1] == "b</w> a</w>"


def test_file_decoder_follows_the_file():
    for path in (LEVEL, WORD):
        t, v = library(path), transducer.Vocabulary(path)
        for text in odd_texts():
            ids = t.encode(text, add_special_tokens=False).ids
            for some in (ids, ids[::2]):
                assert transducer.decoded(v, some) == t.decode(some, skip_special_tokens=False)


def test_transducer_query(docs, rows, empty):
    t = library(WORD)
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in transducer.round_trip(docs, WORD).collect()), key=lambda r: (key(r[0]), r[2]))
    want = []
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, np.uint32).tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=lambda r: (key(r[0]), r[2]))
    assert transducer.round_trip(empty, WORD).count() == 0


def test_wavelet_matrix_answers_as_a_list_does():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, np.uint32), np.array([5], np.uint32), rng.integers(0, 40, 3000).astype(np.uint32), rng.integers(0, 50_257, 2000).astype(np.uint32)):
        m, _ = wavelet.WaveletMatrix.from_bytes(memoryview(wavelet.WaveletMatrix.of(ids).to_bytes()))
        assert list(m.ids()) == list(ids)
        for i in rng.integers(0, len(ids), 40) if len(ids) else ():
            v = int(ids[i])
            assert m.access(int(i)) == v
            assert m.rank(v, int(i)) == int((ids[:i] == v).sum())
            assert m.count(v) == int((ids == v).sum())
            k = int((ids[:i] == v).sum())
            assert m.select(v, k) == i
        assert m.count(70_000) == 0


def test_wavelet_query(docs, rows, empty):
    t = library(LEVEL)
    got = [tuple(r) for r in wavelet.round_trip(docs, LEVEL, shard_tokens=2000).orderBy("start").collect()]
    assert [g[0] for g in got] == sorted((r[0] for r in rows), key=key)
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    want = []
    for i, text, *_ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], np.uint32)
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(((g[0], g[2], g[3]) for g in got), key=lambda r: (key(r[0]), r[2])) == sorted(want, key=lambda r: (key(r[0]), r[2]))
    assert wavelet.round_trip(empty, LEVEL).count() == 0


def test_occurrences_come_from_the_planes(spark, docs, rows, tmp_path):
    path = f"{tmp_path}/shards"
    wavelet.write_shards(docs, path, LEVEL, shard_tokens=5000)
    files = wavelet.read_shards(spark, path)
    assert files.count() > 5
    found = wavelet.occurrences(files, 2).collect()
    assert sum(r["n"] for r in found) == len(rows)
    ends = {r["start"] + r["n_tokens"] - 1 for r in wavelet.shard_documents(files).collect()}
    assert {r["first"] for r in found} <= ends


def test_packing_keeps_all_pieces_in_few_sequences(docs, rows, empty):
    t = library(WORD)
    got = packing.pack_documents(docs, WORD, capacity=256, cell_pieces=400).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= 256).all()
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    want = []
    for i, text, *_ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], np.uint32)
        want += [(-1 if i is None else i, k, at, len(ids[at:at + 256]), zlib.crc32(ids[at:at + 256].tobytes())) for k, at in enumerate(range(0, len(ids), 256))]
    have = got.assign(doc_id=got.doc_id.fillna(-1).astype(int))[["doc_id", "piece", "start", "length", "ids_crc32"]]
    assert sorted(map(tuple, have.values.tolist())) == sorted(want)
    assert packing.pack_documents(empty, WORD).count() == 0


@pytest.mark.parametrize("lengths", [[], [1], [2048] * 5, [1025] * 7, [700] * 9, [1] * 5000])
def test_packing_of_plain_cases(lengths):
    number, _ = packing.pack(np.array(lengths, dtype=np.int64))
    least = {0: 0, 1: 1, 5: 5, 7: 7, 9: 5, 5000: 3}[len(lengths)]
    assert len(set(number.tolist())) == least


def test_packing_is_near_the_least():
    rng = np.random.default_rng(0)
    lengths = np.minimum(2048, np.exp(rng.normal(5.8, 1.1, 8000)).astype(int) + 1)
    number, offset = packing.pack(lengths)
    held = np.bincount(number, weights=lengths)
    assert held.max() <= 2048 and len(held) <= 1.005 * lengths.sum() / 2048 + 2
