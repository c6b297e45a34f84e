import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tapeworks.llm import bpe
from tapeworks.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ours():
    return bpe.Bpe(bpe.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def test_code_points_split_alike(ours, theirs):
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}  {chr(c)} !" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    for text, want in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ours.encode(text).tolist() == want.ids, hex(ord(text[1]))


def test_random_texts(ours, theirs):
    rnd = random.Random(1)
    parts = ["a", "b", " ", "é", "1", "'s", "\n", "<|endoftext|>", "the", "日本", "\x00", "aaaa", "=", "==="]
    for _ in range(2000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))
        ids = ours.encode(text).tolist()
        assert ids == theirs.encode(text, add_special_tokens=False).ids
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
        cut = ids[rnd.randint(0, len(ids)):]
        assert ours.decode(cut) == theirs.decode(cut, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 50_000, "=" * 50_000, "é" * 30_000])
def test_long_pieces(ours, theirs, text):
    assert ours.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_bounded_memory(ours, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 5)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 5)
    small = bpe.Bpe(ours.source)
    text = "Some words come again and again, some words do not. Words!"
    assert small.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert len(small.known) <= 5


def test_query(spark, sf, documents, theirs):
    import hashlib
    got = {r.doc_id: r for r in QUERIES["op1_bpe"](spark, sf).collect()}
    for r in documents.collect():
        ids = theirs.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_odd_rows(odd, empty, theirs):
    vocabulary = bpe.read_vocabulary(PATH)
    for r in bpe.decode(bpe.encode(odd, vocabulary), vocabulary).collect():
        assert r.ids == theirs.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert bpe.encode(empty, vocabulary).count() == 0
    clash = bpe.encode(odd.withColumnRenamed("source", "ids"), vocabulary)
    assert clash.columns == ["doc_id", "text", "row", "id", "ids"][:3] + ["ids"] or "ids" in clash.columns
