import public_tokenizers
import pytest
import sentencepiece

from tapeworks.llm import token_counts
from tapeworks.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return token_counts.read_model(PATH)


@pytest.fixture(scope="module")
def theirs(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


@pytest.mark.parametrize("text", ["", " ", "\n", "\n\n", "  a  b ", "a▁b ▁c", "日本語" * 50, "x" * 300, " \n \t x\n" * 40, "é é日 本" * 30, "<s> </s> <unk>" * 20, "\x00a\x00 " * 30, "é ﬁ½" * 20])
def test_parts_add_up(model, theirs, text):
    counter = token_counts.Counter(model)
    assert counter.can_split
    for size in (1, 2, 3, 7, 50):
        parts = list(counter.parts(text, size))
        assert "".join(p[k > 0:] for k, p in enumerate(parts)) == text
        assert sum(counter.lengths(parts)) - 2 * max(0, len(parts) - 1) == len(theirs.encode(text))


@pytest.mark.parametrize("long_bytes", [20, 700, 1 << 20])
def test_documents(documents, model, theirs, long_bytes):
    want = {r.doc_id: (len((r.text or "").encode()), len(theirs.encode(r.text or ""))) for r in documents.collect()}
    got = token_counts.count(documents, model, keep=["doc_id"], long_bytes=long_bytes).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("long_bytes", [10, 1 << 20])
def test_odd_rows(odd, empty, model, theirs, long_bytes):
    rows = token_counts.count(odd, model, long_bytes=long_bytes)
    assert set(rows.columns) == {"doc_id", "source", "row", "id", "n_bytes", "n_tokens"}
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(theirs.encode(r.text or ""))) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows.collect()) == want
    assert token_counts.count(empty, model).count() == 0
    clash = token_counts.count(odd.withColumnsRenamed({"source": "n_tokens", "row": "digest", "id": "body"}), model, long_bytes=long_bytes)
    assert sorted(clash.columns) == ["body", "digest", "doc_id", "n_bytes", "n_tokens"] and clash.count() == odd.count()


def test_query(spark, sf, documents, theirs):
    got = {r.doc_id: r for r in QUERIES["op12_token_counts"](spark, sf).collect()}
    for r in documents.collect():
        n = len(theirs.encode(r.text or ""))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (n, n > 4096)
