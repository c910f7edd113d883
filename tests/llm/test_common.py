"""Hashes of words."""

import numpy as np
import public_tokenizers as P
import pytest
from finspan.llm import common, token_store
from finspan.llm.sketch import shingles
from tokenizers import Tokenizer


def thue_morse(n, a, b):
    """Two words on which every sum of powers modulo 2^64 agrees once they are long enough."""
    word = "".join((a, b)[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans(a + b, b + a))


@pytest.mark.parametrize("n", [64, 100, 101, 1024, 2048])
def test_words_apart(n):
    x, y = thue_morse(n, "a", "b")
    h, starts, ends = common.word_hashes(np.frombuffer(f"{x} {y} {x.upper()} {x}".encode(), np.uint8))
    assert h[0] != h[1] and h[0] == h[2] == h[3] and (ends - starts).tolist() == [n] * 4
    assert not set(shingles(x.encode())) & set(shingles(y.encode()))
    loud, _, _ = common.word_hashes(np.frombuffer(f"{x} {x.upper()}".encode(), np.uint8), lower=False)
    assert loud[0] != loud[1]


def test_ids_of_such_words():
    x, y = thue_morse(1024, "a", "b")
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    e = token_store.WordEncoder(P.path("word_bpe_49k.json"))
    assert np.frombuffer(e.encode([f"{x} {y}".encode()])[0], "<u2").tolist() == t.encode(f"{x} {y}", add_special_tokens=False).ids
