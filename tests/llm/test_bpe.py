import random

import public_tokenizers as P
import pytest
import tiktoken

from envlake.llm.bpe import Codec, decode_documents, encode_documents, token_digests

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    codec = Codec.load(PATH)
    return codec, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_equals_the_library_on_odd_strings(both):
    codec, library = both
    random.seed(5)
    parts = ["'", "s", "re", "ll", " ", "  ", "\n", "\t", "　", "\x85", "\x1c", "a", "É", "1", "²", "!", "🙂", "\0", "中", "x" * 400]
    texts = ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(3000)]
    assert codec.encode(texts) == library.encode_ordinary_batch(texts)


def test_spans_cover_and_decode(both):
    codec, _ = both
    text = "it's  12 häuser\n\n 'll"
    spans = codec.spans(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(codec.decode(list(ids)).decode() == text[a:b] for a, b, ids in spans)


def test_documents_round_trip(documents, odd, none, odd_rows):
    want = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert {r["doc_id"]: r["text"] for r in decode_documents(encode_documents(documents, PATH), PATH).collect()} == want
    got = decode_documents(encode_documents(odd, PATH), PATH).collect()
    assert sorted(r["text"] for r in got) == sorted(t or "" for _, t, _, _ in odd_rows)
    assert token_digests(none, PATH).count() == 0
    assert {r["n_tokens"] for r in token_digests(odd, PATH).where("doc_id IN (1, 2)").collect()} == {0}
