"""The registered queries of this subpackage over whole tables, against plain versions of their contracts."""

import hashlib
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from test_near import plain_classes

from sparkloom.llm import queries


@pytest.fixture(scope="module")
def texts(sf):
    import pyarrow.parquet as pq

    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}


def labels_of(sf, name):
    import pyarrow.parquet as pq

    return {r["doc_id"]: r[name] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if r[name] is not None}


def test_op1(spark, sf, texts):
    got = {r.doc_id: (r.doc_id, r.n_shingles, r.component_id) for r in queries.op1_jaccard_join(spark, sf).collect()}
    assert got == plain_classes([(k, t, "") for k, t in texts.items()], 4, 85)


def test_op2(spark, sf, texts):
    """Every item that stands in a text as it is, is found there."""
    import pyarrow.parquet as pq

    items = {r["item_id"]: r["text"] for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()}
    got = {(r.doc_id, r.item_id) for r in queries.op2_decontamination(spark, sf).collect()}
    there = {(d, i) for d, t in texts.items() for i, x in items.items() if x and x in t}
    assert there and there <= got and len(got) <= 2 * len(there) + 5


def test_op3(spark, sf, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = queries.op3_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = [model.bos_id(), *model.encode(texts[r.doc_id]), model.eos_id()]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_op4(spark, sf, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in queries.op4_token_files(spark, sf).collect()}
    start = 0
    for k in sorted(texts):
        ids = [*library.encode(texts[k], add_special_tokens=False).ids, 0]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op5(spark, sf, texts):
    got = {r.doc_id: r for r in queries.op5_fingerprints(spark, sf).collect()}
    order = sorted(texts)
    prints: dict = {}
    for k, after in zip(order, order[1:] + order[:1]):
        t, n = texts[k], len(texts[k]) // 4
        edited = t[: len(t) - n] + texts[after][:n]
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
        assert prints.setdefault(t, got[k].fingerprint) == got[k].fingerprint and prints.setdefault(edited, got[k].edited_fingerprint) == got[k].edited_fingerprint
    long = [k for k in order if len(texts[k]) > 400]
    assert np.mean([got[k].near_edited for k in long]) > 0.6 > 0.3 > np.median([got[k].near_next for k in long])


def test_op6(spark, sf, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = queries.op6_token_counts(spark, sf).collect()
    want = {k: len(model.encode(t)) for k, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {k: (len(t.encode()), want[k], want[k] > 4096) for k, t in texts.items()}


def test_op7(spark, sf, texts):
    import pyarrow.parquet as pq

    langs = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    rows = queries.op7_language_id(spark, sf).collect()
    assert {r.doc_id: r.held_out for r in rows} == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in texts}
    held = [r for r in rows if r.held_out and langs[r.doc_id] and any(c.isalpha() for c in texts[r.doc_id])]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and all(r.lang_pred == "und" for r in rows if not any(c.isalpha() for c in texts[r.doc_id]))


@pytest.mark.parametrize("name,label,least", [("op8_toxicity", "toxic", 0.5), ("op10_quality", "quality", 0.3)])
def test_op8_and_op10(spark, sf, texts, name, label, least):
    rows = getattr(queries, name)(spark, sf).collect()
    assert {r.doc_id: r.held_out for r in rows} == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in texts}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= least) for r in rows)
    known = labels_of(sf, label)
    trained = [r for r in rows if not r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in trained) >= 0.9 * len(trained)


def test_op9(spark, sf, texts):
    rows = queries.op9_pii(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all((r.text or "") == texts[r.doc_id] for r in rows if r.n_entities == 0)
    assert any(r.n_entities for r in rows) and all(r.text != texts[r.doc_id] for r in rows if r.n_entities)
