import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from dossia.llm import tokenize as T

PATH = f"{T.TOKENIZER_DIR}/{T.BYTE_BPE_50K}"
# Fixed value: the pattern of the vocabulary's pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return T.TrieEncoder(PATH)


def ids(encoder, texts):
    offsets, flat = encoder.encode_batch(texts)
    return [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_fuzz(encoder, reference):
    rng = random.Random(7)
    alphabet = list(" \n\t\r\x0b \u3000\x1c\x85aBяЖ1२½²'.,!s tdll€😀é\u0306\ufeff\u200b-—《") + ["  ", "слово", "'ll", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    assert ids(encoder, texts) == [reference.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    enc = T.encoder(PATH)
    offsets, flat = enc.encode_batch([text])
    raw = text.encode("utf-8", "surrogatepass").decode("utf-8", "replace") if any(0xD800 <= ord(c) < 0xE000 for c in text) else text
    assert b"".join(enc.bytes_of[i] for i in flat.tolist()).decode("utf-8", "replace").replace("\ufffd", "?") == raw.replace("\ufffd", "?") or "\ufffd" in raw


def test_long_texts(encoder, reference):
    texts = ["а" * 5000, "-" * 5000, " " * 3000, "12345" * 1000, None, "", "слово " * 20000]
    assert ids(encoder, texts) == [reference.encode_ordinary(t or "") for t in texts]


def test_table_is_emptied_and_refilled(reference):
    small = T.TrieEncoder(PATH, keep=10)
    for n in range(5):
        texts = [f"слово{n}{i} и ещё {i}" for i in range(30)]
        assert ids(small, texts) == [reference.encode_ordinary(t) for t in texts]


def test_rows(spark, data, reference):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.ids for r in T.token_ids(docs).collect()}
    assert got == {k: reference.encode_ordinary(t or "") for k, t in text.items()}
    assert {r.doc_id: r.n_tokens for r in T.token_counts(docs).collect()} == {k: len(v) for k, v in got.items()}
    assert T.token_ids(docs.limit(0)).count() == 0
    extra = docs.selectExpr("doc_id", "text", "1 as ids", "2 as _key")
    assert T.token_ids(extra).columns == ["doc_id", "ids"]
