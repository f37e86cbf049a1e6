"""Chunks encoded side by side: as few texts for the library as they need, and the ids of whole texts."""

import random
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexforge.llm import token_files, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


class Counted:
    """The library's tokenizer, with the number of texts it got."""

    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def encode_batch_fast(self, texts, **kw):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **kw)


PLAIN = {path: Tokenizer.from_file(path) for path in (WORDS, BYTES)}


def want(path, texts):
    return [array("I", e.ids).tobytes() for e in PLAIN[path].encode_batch(texts, add_special_tokens=False)]


def test_new_words_are_encoded_side_by_side():
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdeéñü", k=9)) for _ in range(5000))
    coder = tokens.Encoder(WORDS)
    coder.tokenizer = Counted(coder.tokenizer)
    got = coder.encode([text])
    assert got == want(WORDS, [text])
    assert coder.tokenizer.texts < 50  # one a word before
    coder.encode([text.upper().replace(" ", "\n"), text.title().replace(" ", "\t")])
    assert coder.tokenizer.texts < 6000  # letters É, Ñ and Ü stay as they are, and make other words


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_characters_that_change_their_length(path):
    odd = ["İstanbul", "J̌", "H̱ow", "T̈ a", "éÉ", "ẞ ß ſ", "Kelvin Ångstrom", "Ÿ ŉ", "ǅ ǰ", "한글 한"]
    odd += ["A\x0bB\x0cC", "x\x00Y \x01Z", "a\x1cB", "§ 12 µm²", "<|EndOfText|> A", "B<|endoftext|>C", "A<|ENDOFTEXT|>", "|>A<|", "IT'S It'S i'LL", "'S 'T", "a$b#C%d&E*F|G", "cafÉ.Été", "   ", "\n", "\U0001f600A", "—A—"]
    rng = random.Random(7)
    signs = "aBcJHéÉßİŸſ̱́̌̈ \n\t\r\x0b\x0c.,;:!?#$%&*'\"<|>-1²µ—KΣς\x00\x1c 中"
    texts = odd + ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(4000)] + ["中文 Σς"]
    assert tokens.Encoder(path).encode(texts) == want(path, texts)
    coder = tokens.Encoder(path)
    for t in odd:  # alone, so that no neighbour changes how its slice is read
        assert coder.encode([t]) == want(path, [t])


def test_an_end_within_an_id_falls_back():
    coder = tokens.Encoder(WORDS)
    coder.width = coder.width + 1
    assert coder.encode(["some words here, some there"]) == want(WORDS, ["some words here, some there"])


def test_short_lists_pack_as_long_ones_do():
    rng = np.random.default_rng(3)
    for width in range(1, 33):
        values = rng.integers(0, 2**width, (3, token_files.FEW)).astype("<u4")
        long = token_files._pack(values, width)
        for row, packed in zip(values, long):
            assert (token_files._pack(row[None, :], width)[0] == packed).all()
            assert (token_files._unpack(packed[None, :], width, len(row))[0] == row).all()
