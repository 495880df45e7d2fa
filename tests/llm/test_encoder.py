"""The encoder of token files: new words are encoded as few texts, with the ids that the library gives whole texts."""

from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

from sensorium.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


class Counting:
    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def encode_batch_fast(self, texts, **kw):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **kw)


def ids(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_new_words_are_encoded_together():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdeéñ漢ж.,'-9") for _ in range(rnd.randrange(1, 12))) for _ in range(5000)]
    texts = [" ".join(words[k : k + 50]) for k in range(0, 5000, 50)]
    enc = token_files.Encoder(PATH)
    enc.tokenizer = Counting(enc.tokenizer)
    assert [x.tolist() for x in enc.batch(texts)] == ids(texts)
    assert enc.tokenizer.texts < 200  # the 100 first words, and texts of new words


def test_words_that_cannot_be_joined():
    added = token_files.Encoder(PATH).added
    odd = ["", " ", "a", " a", "a ", "a\n", "b a\n", "x  y z", "a \n b", "a b c ", "c Ġd Ġ", "a\tb c\t d", "it's we 'll don't", "w" * 300 + " " + "v" * 300, "́ ́a é", "\U0001f600 ‍\U0001f600 x", "1 22 333 4444"]
    odd += [f"a {x} b" for x in added] + [f"a{x}b c {x[:-1]} d" for x in added]
    rnd = random.Random(5)
    texts = odd + [" ".join(rnd.choice(odd) for _ in range(5)) for _ in range(200)]
    enc = token_files.Encoder(PATH)
    assert [x.tolist() for x in enc.batch(texts)] == ids(texts)
    assert [x.tolist() for x in enc.batch(texts)] == ids(texts)  # remembered
    assert max(map(len, (*enc.first, *enc.later))) <= token_files.MAX_CHARS


class Letters(Counting):
    def encode_batch_fast(self, texts, **kw):
        self.texts += sum(x.isalpha() for t in texts for x in t)
        return self.inner.encode_batch_fast(texts, **kw)


def test_marks_and_line_ends_bring_no_new_words():
    rnd = random.Random(6)
    words = sorted({"".join(rnd.choice("abcdeéжß") for _ in range(rnd.randrange(4, 10))) for _ in range(500)})
    marked = [x + m for x in words for m in (".", ",", "?!", "'", "...", "\"')")]
    rnd.shuffle(marked)
    texts = [" ".join(words), " ".join(marked), "\n".join(words), "\n".join(f"{x} {y}" for x, y in zip(marked, reversed(marked), strict=True))]
    enc = token_files.Encoder(PATH)
    enc.tokenizer = Letters(enc.tokenizer)
    assert [x.tolist() for k in range(4) for x in enc.batch(texts[k : k + 1])] == ids(texts)
    assert enc.tokenizer.texts < 2.2 * len("".join(words))  # each word after a space, and after a line end


def test_white_space_and_marks_anywhere():
    rnd = random.Random(7)
    pieces = ["\n", " ", " ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", " ", "　", "᠎", "​", ".", ",", "'", "'s", "'ll", "..", "<|", "a", "Bc", "é", "×", "ж", "漢", "ก็", "́", "Ϳ", "ᲀ", "½", "7", "٣", "_", "😀"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(12))) for _ in range(30_000)]
    enc = token_files.Encoder(PATH)
    assert [x.tolist() for x in enc.batch(texts)] == ids(texts)
    assert [x.tolist() for x in enc.batch(texts)] == ids(texts)
