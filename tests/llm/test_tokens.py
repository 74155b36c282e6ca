"""Ids of words by Arrow against the library."""

import random

import numpy as np

from duelgrid.llm.tokens import WordIds

PIECES = [
    "a", "The", "ÄRGER", "straße", "été", "é", "J̌", "İ", "Σας", "ΣΑΣ", "K", "ſ", "中文", "क़", "ﬁ", "ª", "µ", "ÿ", "Ÿ",
    "'s", "'S", "'", "’", "“", "…", "€", " ", "\xa0", "\x85", "\x1c", "\t", "\n", " ", "  ", ",", ".&&&", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "≮",
    "́", "½", "7", "_", "-", "\\", "]", "^", "`", "~", "@", "[", "😀", "﻿",
]


def check(mine, texts):
    want = [e.ids for e in mine.library.encode_batch(texts, add_special_tokens=False)]
    for text, got, ids in zip(texts, mine.encode(texts), want, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids, repr(text)


def test_ids_are_the_librarys_whatever_stands_together():
    rng, mine = random.Random(5), WordIds(entries=40)
    check(mine, [a + b for a in PIECES for b in PIECES])
    check(mine, ["x" + a + b + "y" for a in PIECES for b in PIECES])
    for _ in range(30):
        check(mine, ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(60)])
        assert len(mine.chunks) == len(mine.ids) == len(mine.met) <= 40
    latin = [chr(c) for c in range(1, 256)]
    check(mine, [a + b for a in latin for b in "aZ.'é"] + [b + a for a in latin for b in "aZ.'é"])
    assert mine.encode([]) == [] and mine.encode(["", ""]) == [b"", b""]


def test_words_cost_the_library_once_and_python_nothing():
    class Asked(dict):
        def get(self, *a):
            raise AssertionError("a word is looked up in Python")

        __getitem__ = get

    mine, seen = WordIds(), []
    mine.memo, words = Asked(mine.memo), mine._words
    mine._words = lambda w, library: seen.extend(w) or words(w, library)
    text = "Alpha alpha beta ALPHA Beta " * 500 + "gamma"
    check(mine, [text])
    check(mine, [f"{text} delta"])
    assert sorted(seen) == ["alpha", "beta", "delta", "gamma"]


def test_the_chunks_met_last_stay():
    mine = WordIds(entries=4)
    for text in ("a b c", "a d", "a e"):
        mine.encode([text])
    assert len(mine.chunks) <= 4 and "a" in mine.chunks.to_pylist()
    mine.encode(["y" * 100, "word " + "y" * 100 + ","])
    assert "y" * 100 not in mine.chunks.to_pylist()
