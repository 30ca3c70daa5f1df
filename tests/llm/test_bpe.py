"""Forced-boundary BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillspark.llm import bpe, tokens
from tests.llm.test_edges import clashing
from tests.llm.test_operators import docs, rows_of

PIECES = list("abcdeABCDE's 1290 \n\t\v!?.,-<|>\r\f") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "</w>", "é", "é", "́", "ß", "İ", "ǅ", "　", "\xa0", "\x85", "漢", "字", "한", "하", "😀", "Σ", "ς", "\x00", "\x1c", "ﬁ", "٣", "Ⅷ", "'re", "'ll", "​", "‍", "क्ष", "Å", "the", "ing ", " of"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(bpe.tokenizer_file())


def want(plain, key, text):
    ids = plain.encode(text or "", add_special_tokens=False).ids
    decoded = plain.decode(ids, skip_special_tokens=False)
    return key, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_random_texts(plain, monkeypatch):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(60))) for _ in range(4000)]
    codec = bpe.codec_of(bpe.tokenizer_file())
    for limit in (bpe.REMEMBERED, 50):  # with 50, words and fragments are forgotten again and again
        monkeypatch.setattr(bpe, "REMEMBERED", limit)
        for k in range(0, len(texts), 500):
            ids, at = codec.encode(pa.array(texts[k : k + 500], pa.large_string()))
            decoded = codec.decode(ids, at).to_pylist()
            for j, text in enumerate(texts[k : k + 500]):
                same = plain.encode(text, add_special_tokens=False).ids
                assert ids[at[j] : at[j + 1]].tolist() == same and decoded[j] == plain.decode(same, skip_special_tokens=False), repr(text)


def test_cuts_are_made_inside_words(plain):
    """The table of pairs does part words, and no token of the vocabulary has a pair outside it."""
    codec = bpe.codec_of(bpe.tokenizer_file())
    assert 0 < codec.inside.sum() < codec.inside.size // 10
    met = []
    inner, codec.bpe = codec.bpe, None

    class Watched:
        def encode_batch_fast(self, texts, **more):
            met.extend(texts)
            return inner.encode_batch_fast(texts, **more)

    codec.bpe = Watched()
    try:
        codec.fragments._forget()
        codec.words._forget()
        ids, _ = codec.encode(pa.array(["qzéxqjzé漢"], pa.large_string()))
    finally:
        codec.bpe = inner
    assert len(met) > 2 and ids.tolist() == plain.encode("qzéxqjzé漢", add_special_tokens=False).ids


def test_digest(spark, plain):
    rnd = random.Random(5)
    texts = [(k, "".join(rnd.choice(PIECES) for _ in range(200))) for k in range(40)]
    texts += [(50, None), (51, ""), (None, "same"), (None, "same"), (50, " \n"), (52, "word " * 120_000), (53, "x" * 200_000 + "é" * 50_000), (54, "<|endoftext|>" * 3)]
    assert rows_of(bpe.digest(docs(spark, texts))) == sorted((want(plain, k, t) for k, t in texts), key=repr)
    assert rows_of(bpe.digest(clashing(spark, texts[:3]))) == sorted((want(plain, k, t) for k, t in texts[:3]), key=repr)
    assert bpe.digest(docs(spark, [])).count() == 0
    both = bpe.decode(bpe.encode(docs(spark, texts[:5])))
    assert both.columns == ["doc_id", "ids", "decoded"]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(tokens.tokenizer_file())
