"""The ids of words against the whole tokenizer, and which words it is asked for."""

import random

import numpy as np
import public_tokenizers

from textloom.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = ["Word", "word.", "it's", "IT'LL", "don't,", "'s", "''s", "x'dy", "a1b22", "3.14", "éÉß", "Ñandú,", "ÿ÷×", "«a»", "\x7f", "a\x1cb", "é", "İx", "ΣΑΣ", "日本語", "<|endoftext|>", "a|b", "\x01", "ﬁ", "ŉ", "\xad", "¼½"]


class Spy:
    def __init__(self, coder):
        self.coder, self.asked = coder, []

    def __getattr__(self, name):
        return getattr(self.coder, name)

    def encode_batch_fast(self, texts, **kw):
        self.asked += texts
        return self.coder.encode_batch_fast(texts, **kw)


def test_words_have_the_ids_of_the_tokenizer():
    rng = random.Random(5)
    letters = "abcXYZ019'.,|<>-éÉßöÀÿ×÷²ª"
    words = {w.encode() for w in WORDS} | {"".join(rng.choices(letters, k=rng.randint(1, 9))).encode() for _ in range(5000)}
    coder = P.WordCoder(PATH)
    got = coder.learn([list(words)])
    for w in words:
        assert got[w] == np.array(coder.coder.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes(), w


def test_latin_words_are_coded_by_their_parts_alone():
    coder = P.WordCoder(PATH)
    coder.coder = spy = Spy(coder.coder)
    coder.learn([[w.encode() for w in ("plain", "Plain.", "plain,")], ["naïve".encode(), "l'Été;".encode(), b"x2"]])
    assert not spy.asked and {"plain", ".", ",", "naïve", "été"} <= set(coder.parts)


def test_words_outlive_a_generation_if_they_are_met_again(monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 2)
    coder = P.WordCoder(PATH)
    coder.coder = spy = Spy(coder.coder)
    for words in (["日本", "b", "c"], ["日本", "d", "e"], ["日本", "f"], ["本"]):
        table = coder.learn([[w.encode() for w in words]])
        assert all(table[w.encode()] == np.array(spy.coder.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words)
    assert spy.asked == ["日本", "本"] and len(coder.known) + len(coder.old) < 8
