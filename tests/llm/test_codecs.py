"""Encoders, token counts, token files and decoding against the libraries."""

import hashlib
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import public_tokenizers

from sparkloom.llm import _byte_level, _table, sentencepiece_codec, token_counts, token_files
from sparkloom.llm._pieces import SPACE

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
EDGES = [
    "", " ", "  ", "a", " a", "a ", "a  b", "\n\n x\t", "▁▁a ▁", "<s>x</s>", "<|endoftext|>", "a<|endoftext|> b", "日本語 text", "😀" * 30, "é́", "\x00\x01", " " * 40 + "x",
    "x" * 3000, "the " * 500, "don't we'll I'M", "1234567", "ﬁ　﻿", "a b",
]


def texts(n: int, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    alphabet = "ab the inerst▁  \n\t.,é😀中文ñ0123<s>ﬁ　aaaa'’"
    vocabulary = sentencepiece_codec.codec(PIECES).merger.name
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return out + ["".join(rng.choice(vocabulary).replace(SPACE, " ") for _ in range(rng.randint(1, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def test_pieces_like_the_library(library):
    c = sentencepiece_codec.codec(PIECES)
    for t in EDGES + texts(3000):
        assert c.encode(t) == library.encode(t), t
        assert c.decode(library.encode(t)) == library.decode(library.encode(t)), t


def test_any_ids_decode_like_the_library(library):
    c, rng = sentencepiece_codec.codec(PIECES), random.Random(3)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 9))]
        assert c.decode(ids) == library.decode(ids), ids


def test_compatibility_is_that_of_merging():
    m, rng = sentencepiece_codec.codec(PIECES).merger, random.Random(1)
    made = [k for k in range(m.fixed) if m.left[k] >= 0]
    for _ in range(5000):
        a, b = rng.choice(made), rng.choice(made)
        assert m._unwound(a, b) == (m.merge(list(m.name[a] + m.name[b])) == [m.name[a], m.name[b]])


def test_codec_columns(spark, library):
    rows = [(k, t, "kept") for k, t in enumerate([None, *EDGES])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, PIECE_IDS string")
    got = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, PIECES), PIECES).collect()
    for r in got:
        assert list(r.piece_ids) == [1, *library.encode(r.text or ""), 2]
        assert r.decoded == library.decode(list(r.piece_ids))
    d = {r.doc_id: r for r in sentencepiece_codec.digests(docs, PIECES).collect()}
    ids = np.array([1, *library.encode(EDGES[3]), 2], "<u4").tobytes()
    assert d[4].ids_sha256 == hashlib.sha256(ids).hexdigest() and d[0].n_tokens == 2


@pytest.mark.parametrize("path", [PIECES, BYTES])
def test_counts(spark, library, tokenizer, path):
    given = [None, *EDGES, *texts(200)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(given)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts.token_counts(docs, path, limit=400).collect()}
    for k, t in enumerate(given):
        t = t or ""
        n = len(library.encode(t)) if path == PIECES else len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len(t.encode()), n > 400), repr(t)


@pytest.mark.parametrize("path", [PIECES, BYTES])
def test_counts_when_the_table_is_emptied(library, tokenizer, path, monkeypatch):
    """Small tables, met again and again when full; texts in small slices."""
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 40)
    monkeypatch.setattr(token_counts, "SLICE", 25)
    r = token_counts.reader(path)
    one = _table.Table(4)
    one.add(token_counts._keys_of([b"same", b"x", b" x", b""]), np.array([*r.count([b"same", b"x", b" x"]), 1 if path == PIECES else 0]))
    counts = token_counts.Counts(path, one)
    given = [f"same  words of all texts {k % 7}x{k % 7} and new{k} rare{k * k} odd{k % 30} " for k in range(300)] + texts(300, 8)
    for at in range(0, len(given), 7):
        lot = given[at : at + 7]
        want = [len(library.encode(t)) if path == PIECES else len(tokenizer.encode(t, add_special_tokens=False).ids) for t in lot]
        assert counts.of(lot).tolist() == want
    assert counts.two.held <= 40


def test_tables():
    rng = random.Random(4)
    words = list({bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 24))) for _ in range(5000)})
    buf, first = _table.padded(words)
    k = _table.keys(buf, first[:-1], first[1:])
    t = _table.Table(3000)
    for a in range(0, 3000, 500):
        t.add(k[a : a + 500], np.arange(a, a + 500))
    assert t.find(k).tolist() == [i if i < 3000 else -1 for i in range(len(words))]
    with pytest.raises(ValueError):
        t.add(k[3000:3001], np.array([1]))
    t.clear()
    assert (t.find(k) == -1).all()


def test_byte_level_ids(tokenizer, monkeypatch):
    """Cut anywhere, with a table that is emptied often, the ids are the library's."""
    monkeypatch.setattr(_byte_level, "ENTRIES", 300)
    monkeypatch.setattr(_byte_level, "LOT", 200)
    coder, rng = _byte_level.ByteLevel(BYTES), random.Random(6)
    some = ["a", "b.", ",", ".", "*", "?", "\n", "\n\n", "\t", " ", " ", "  ", "\x1c", "\x85", "\u00a0", "\u3000", "é", "×", "·", "ж", "中", "1", "'s", "'", "<|endoftext|>", "…", "\0"]
    given = ["".join(rng.choice(some) for _ in range(rng.randint(0, 9))) for _ in range(6000)] + EDGES + texts(500) + [None]
    for at in range(0, len(given), 500):
        lot = given[at : at + 500]
        assert [g.tolist() for g in coder.encode(lot)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in lot]


def test_byte_level_worker_is_small():
    """Many new pieces at once take no threads and little memory: an executor has several workers beside its heap."""
    code = """
import random, re, sys
from sparkloom.llm._byte_level import ByteLevel

def status(name):
    return int(re.search(name + r":\\s+(\\d+)", open("/proc/self/status").read())[1])

coder, rng = ByteLevel(sys.argv[1]), random.Random(8)
texts = [" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(1000)) for _ in range(400)]
before = status("VmHWM"), status("Threads")
coder.encode(texts)
print((status("VmHWM") - before[0]) // 1024, status("Threads") - before[1])
"""
    said = subprocess.run([sys.executable, "-c", code, str(BYTES)], capture_output=True, text=True, check=True).stdout
    mb, threads = map(int, said.split())
    assert mb < 200 and threads == 0


@pytest.mark.parametrize("text", [" " * 1_500_000, "a" + " " * 1_500_000 + "b", "x" * 1_000_000, "ab c.\n" * 300_000, "wé" * 100_000 + " <|endoftext|> z" * 3])
def test_long_texts(library, tokenizer, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert _byte_level.byte_level(BYTES).encode([text, "b", text])[2].tolist() == ids
    assert token_counts.Counts(BYTES, _table.Table(1)).of([text]).tolist() == [len(ids)]
    assert token_counts.Counts(PIECES, _table.Table(1)).of([text, None]).tolist() == [len(library.encode(text)), 0]


def test_code_lengths_are_best():
    rng = random.Random(2)
    for _ in range(60):
        counts = np.array([rng.choice([0, 1, 2, rng.randint(1, 10_000)]) for _ in range(rng.randint(1, 40))])
        bits = token_files.code_lengths(counts, 6)
        used = bits[counts > 0].astype(int)
        assert (bits[counts == 0] == 0).all() and used.max(initial=1) <= 6
        if len(used) > 1:
            assert sum(2.0**-b for b in used) == 1.0
            assert int((counts * bits).sum()) == _best(sorted(counts[counts > 0]), 6)


def _best(counts: list[int], longest: int) -> int:
    """The least total of any code of at most ``longest`` bits: by the number of leaves and inner nodes on each level."""
    from functools import lru_cache

    counts = [int(c) for c in sorted(counts, reverse=True)]
    total = [0]
    for c in counts:
        total.append(total[-1] + c)

    @lru_cache(None)
    def go(done: int, slots: int, depth: int) -> float:
        left = len(counts) - done
        if not left:
            return 0
        if depth == longest or slots > left:
            return (total[-1] - total[done]) * 0 if slots >= left else float("inf")
        # leaves on this level; what is not a leaf goes one level down and costs a bit
        return min((total[-1] - total[done + k]) + go(done + k, 2 * (slots - k), depth + 1) for k in range(0, slots + 1) if k <= left)

    return int(go(0, 1, 0))


def test_pack_and_unpack():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 511, 512, 513, 5000):
        ids = np.minimum(rng.geometric(0.02, n), 299)
        bits = token_files.code_lengths(np.bincount(ids, minlength=300))
        payload, marks = token_files.pack(ids, bits, token_files.canonical_codes(bits))
        back = token_files.Decoder(bits).blocks([payload, payload], [marks, marks], [n, n])
        assert (back[0] == ids).all() and (back[1] == ids).all()


def test_files(spark, tmp_path, tokenizer):
    given = [(k * 3 - 5, t) for k, t in enumerate([None, *EDGES, *texts(100)])] + [(None, "null key"), (7, "twice"), (7, "again")]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
    token_files.write(docs, BYTES, f"file://{tmp_path}/f")
    got = sorted(token_files.read(spark, f"file://{tmp_path}/f").collect(), key=lambda r: r.start)
    order = docs.withColumn("h", F.xxhash64("text")).orderBy(F.asc_nulls_first("doc_id"), "h").select("doc_id", "text").collect()
    start = 0
    for (k, t), r in zip(order, got, strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, list(r.ids)) == (k, start, ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.round_trip(none, BYTES).count() == 0
    assert token_counts.token_counts(none, PIECES).count() == 0
    assert sentencepiece_codec.digests(none, PIECES).count() == 0
