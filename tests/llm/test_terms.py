"""Words and symbols by Arrow against those of single texts."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from duelgrid.llm import hmm, terms

PIECES = ["a", "The", "É", "K", "ſ", "中", "😀", "\x00", "\x1c", "\x85", "\xa0", " ", "\t", "\n", "\v", "\f", "\r", "  ", "x.", "\x1f", " "]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    some = ["".join(rng.choices(PIECES, k=rng.randint(0, 9))) for _ in range(2000)]
    return [None, "", " ", "\n\n", *some, "word " * 3000, " "]


def test_words_and_ends_are_those_of_each_text(texts):
    for kind in (pa.string(), pa.large_string()):
        words, sizes = terms.words_and_ends(pa.array(texts, kind))
        want = [hmm.tokens_of(t or "") for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and words.to_pylist() == [t for w in want for t in w]
    words, sizes = terms.words_and_ends(pa.array([], pa.string()))
    assert len(words) == len(sizes) == 0
    words, sizes = terms.words_and_ends(pa.array(texts).slice(700, 50))
    assert words.to_pylist() == [t for x in texts[700:750] for t in hmm.tokens_of(x or "")]


def test_symbols_are_own_ones_or_classes_of_tails():
    own = [b"the", b"", b"a", b"\xff"]
    tokens = [b"the", b"b", b"", b"\xfe", b"\xff", b"ab", b"xyab", b"a", bytes(300), "é".encode(), "Zé".encode()] * 2
    for symbols in (hmm.Symbols(own), hmm.Symbols([])):
        want = [symbols.own.get(t, len(symbols.own) + zlib.crc32(t[-2:]) % hmm.CLASSES) for t in tokens]
        assert symbols.encode(tokens).tolist() == want == [symbols.own.get(t, symbols.class_of(t)) for t in tokens]
        assert symbols.encode([]).tolist() == [] and symbols.encode_column(pa.array(tokens, pa.large_binary()).slice(3)).tolist() == want[3:]
        assert hmm.Symbols(symbols.__getstate__()).encode(tokens).tolist() == want


def test_words_are_counted_without_python(spark, texts, monkeypatch):
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {bytes(r.term): r.n for r in terms.count_words(df).collect()}
    assert got == Counter(t for x in texts for t in hmm.tokens_of(x or ""))
    batch = pa.RecordBatch.from_pydict({"text": texts[:9], "doc_id": np.arange(9), "held_out": [True] * 9})

    def refused(*a):
        raise AssertionError("a text is cut into words in Python")

    monkeypatch.setattr(hmm, "ascii_words", refused)
    symbols = hmm.Symbols([b"a", b""])
    counts = hmm.counts_of(symbols, {b"a": 3, b"": 9, b"x.": 1}, 20, 5, np.ones((hmm.CLASSES, 2)))
    shared = type("Shared", (), {"value": (symbols, hmm.initial(np.ones(symbols.size)), counts)})
    [rows] = hmm._documents(iter([batch]), shared, hmm.to_arrow_schema(hmm.StructType.fromDDL(hmm.ROWS)))
    assert [r["n_tokens"] for r in rows.to_pylist() if r["n_tokens"]] == [len(terms.ascii_words(t or "")) + 1 for t in texts[:9]]
