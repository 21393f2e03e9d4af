"""Long texts in parts, and spans from their own tokens."""

import random

import numpy as np
import pytest

from siteloom.llm import byte_bpe


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")


def test_parts_of_a_long_text(path, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(list("abcs't  \n.1é漢😀!\x1c\x85\u2003")) for _ in range(n)) for n in (0, 5, 400, 1000)] + ["x" * 300, " " * 200 + "a " * 100]
    own = byte_bpe.codec(path)
    whole = own.encode_batch(texts)
    monkeypatch.setattr(byte_bpe, "BLOCK", 37)
    parts = list(own.encode(texts))
    assert len(parts) == len(whole)
    for (a, b, c), (x, y, z) in zip(whole, parts, strict=True):
        assert a == x and (b == y).all() and (c == z).all()
    assert all("".join(byte_bpe._parts(t)) == t for t in texts)


def test_spans(spark, docs, path):
    text = "It's a façade\n  of 漢字 and 😀 words, isn't it?"
    encoded = byte_bpe.encode(docs((1, text), (2, None), (3, "")), path, offsets=True)
    for start, length in [(0, 3), (2, 9), (10, 100), (60, 5), (7, 0)]:
        got = {r["doc_id"]: r["span"] for r in byte_bpe.decode_span(encoded, path, start, length).collect()}
        assert got == {1: text[start : start + length], 2: "", 3: ""}
    row = encoded.where("doc_id = 1").first()
    assert len(row["piece_starts"]) == len(row["piece_tokens"]) and row["piece_starts"][0] == row["piece_tokens"][0] == 0 and np.all(np.diff(row["piece_tokens"]) > 0)
