"""Tokenizers inside tasks: ids of whole texts, with the work of the library done once per distinct word.

The word tokenizer's pre-tokenizer never joins characters across white space, and a run of letters ends before a punctuation
mark. So a text's ids are those of its space-separated chunks one after the other, also with a space set in between the two.
Arrow splits texts and numbers their distinct chunks. A worker remembers a bounded number of chunks and their ids as Arrow
arrays, and the library itself runs for distinct chunks that are not among them.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"
#: Chunks that a worker remembers, half of which stay when there are more, and the longest chunk that it keeps, in bytes.
MEMO_ENTRIES = 900_000
MEMO_CHUNK = 48
#: Words that the library gets as one text.
TOGETHER = 256
#: Small letters of Latin-1, and punctuation that ends a run of letters whatever follows; an apostrophe may begin a contraction.
SMALL, MARK = "a-zß-öø-ÿ", r"!-&(-/:-@\[-`{-~"
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters whose small forms are single ones and which never compose: Latin-1, dashes, quotation marks and the like.
EASY = r"\x00-\xff\x{2010}-\x{2027}\x{20ac}"


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; a name with a slash is taken as a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of texts by a tokenizers .json file whose words end in an end-of-word suffix, as little-endian uint32 bytes."""

    def __init__(self, name: str = WORD_TOKENIZER, entries: int = MEMO_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path(name))
        # for words of small letters, which the normalizer leaves as they are
        self.bare = Tokenizer.from_file(tokenizer_path(name))
        self.bare.normalizer = None
        vocabulary = self.library.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, i in vocabulary.items():
            if piece.endswith("</w>"):
                self.word_end[i] = True
        # texts that keep their case and get no spaces: small letters may turn a word into an added token
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.odd = "(?i)" + "|".join([f"[^{EASY}]", *added])
        self.entries = entries
        # what the worker remembers: chunks, their ids, and in which call each was last met
        self.chunks, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.met, self.calls = np.zeros(0, np.int64), 0
        # stems and tails of chunks that are not small letters alone
        self.memo: dict[str, bytes] = {"": b""}

    def _words(self, words: list[str], library) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of words of letters alone, many to a text, and the words' numbers of ids; the end-of-word pieces show where each ends."""
        ids, sizes = [], []
        for k in range(0, len(words), 16 * TOGETHER):
            parts = [words[j : j + TOGETHER] for j in range(k, min(k + 16 * TOGETHER, len(words)), TOGETHER)]
            for part, e in zip(parts, library.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
                got = np.array(e.ids, "<u4")
                ends = np.flatnonzero(self.word_end[got]) + 1
                if len(ends) != len(part) or ends[-1] != len(got):  # a letter that normalizes to more than one pre-token
                    each = [np.array(x.ids, "<u4") for x in self.library.encode_batch_fast(part, add_special_tokens=False)]
                    got, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
                ids.append(got)
                sizes.append(np.diff(ends, prepend=0))
        return ids, sizes

    def _others(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that are not small letters alone: by their letters and what follows them, or as they are."""
        if len(self.memo) > self.entries:
            self.memo = {"": b""}
        memo, plain, other, built = self.memo, {}, {}, []
        for chunk in chunks:
            stem = chunk.rstrip(MARKS)
            if stem.isalpha() and unicodedata.normalize("NFC", stem.lower()).isalpha():
                tail = chunk[len(stem) :]
                built.append((chunk, stem, tail))
                if stem not in memo:
                    plain[stem] = None
                chunk = tail
            if chunk not in memo:
                other[chunk] = None
        ids, sizes = self._words(list(plain), self.library)
        if plain:
            raw, ends = np.concatenate(ids).tobytes(), (4 * np.cumsum(np.concatenate(sizes))).tolist()
            memo.update(zip(plain, [raw[a:b] for a, b in zip([0, *ends], ends)], strict=True))
        other = list(other)
        for k in range(0, len(other), 1024):
            for c, e in zip(part := other[k : k + 1024], self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                memo[c] = np.array(e.ids, "<u4").tobytes()
        whole = {chunk: memo[stem] + memo[tail] for chunk, stem, tail in built}
        out = [found if (found := whole.get(c)) is not None else memo[c] for c in chunks]
        for c in [*plain, *other]:
            if len(c) > MEMO_CHUNK:
                del memo[c]
        return out

    def _learn(self, chunks: pa.Array) -> pa.Array:
        """Ids of chunks by the library."""
        small = pc.match_substring_regex(chunks, f"^[{SMALL}]+$")
        ids, sizes = self._words(_strings(chunks.filter(small)), self.bare)
        ends = 4 * np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes]))
        raw = np.concatenate([np.zeros(0, "<u4"), *ids])
        by_words = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
        others = pa.array(self._others(_strings(chunks.filter(pc.invert(small)))), pa.large_binary())
        small = small.to_numpy(zero_copy_only=False)
        place = np.where(small, np.cumsum(small) - 1, len(by_words) + np.cumsum(~small) - 1)
        return pa.concat_arrays([by_words, others]).take(pa.array(place))

    def _ids(self, chunks: pa.Array) -> pa.Array:
        """Ids of distinct chunks, from what the worker remembers or from the library."""
        at = pc.index_in(chunks, value_set=self.chunks)
        missing = chunks.filter(at.is_null())
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.chunks) + np.arange(len(missing))
        self.calls += 1
        if len(missing):
            self.chunks = pa.concat_arrays([self.chunks, missing])
            self.ids = pa.concat_arrays([self.ids, self._learn(missing)])
            self.met = np.concatenate([self.met, np.zeros(len(missing), np.int64)])
        self.met[at] = self.calls
        out = self.ids.take(pa.array(at))
        if len(missing):
            keep = pc.less_equal(pc.binary_length(self.chunks), MEMO_CHUNK).to_numpy(zero_copy_only=False)
            if len(keep) > self.entries:
                keep[np.argsort(self.met, kind="stable")[: len(keep) - self.entries // 2]] = False
            if not keep.all():
                self.chunks, self.ids, self.met = self.chunks.filter(pa.array(keep)), self.ids.filter(pa.array(keep)), self.met[keep]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        given = pa.array(texts, pa.large_string())
        spaced = pc.replace_substring_regex(pc.utf8_lower(given), f"([{SMALL}])([{MARK}])", r"\1 \2")
        given = pc.if_else(pc.match_substring_regex(given, self.odd), given, spaced)
        chunks = pc.split_pattern(pc.replace_substring(given, "\n", " "), " ")
        numbered = chunks.flatten().dictionary_encode()
        # the ids of all places, one after the other
        placed = self._ids(numbered.dictionary).take(numbered.indices)
        ends = np.frombuffer(placed.buffers()[1], np.int64)[chunks.offsets.to_numpy()].tolist() if len(placed) else []
        data = placed.buffers()[2]
        return [data[a:b].to_pybytes() for a, b in zip(ends, ends[1:])]


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class PieceCounts:
    """Number of pieces that a sentencepiece model gives for a pre-token.

    A pre-token is a run of spaces and the characters up to the next space or line end. It is written as the text after
    its first space; one that follows a line end directly, without a space, is written with that line end before it.
    Pieces never hold an inner space mark nor a line end (checked when the model is loaded), so counts add up.
    """

    def __init__(self, name: str = PIECE_MODEL):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        pieces = (self.library.id_to_piece(i) for i in range(self.library.vocab_size()))
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("the model has pieces that span pre-tokens; their counts do not add up")
        self.line_end = len(self.library.encode("\n", num_threads=1)) - 1

    def count(self, units: list[str]) -> list[int]:
        """The counts of pre-tokens. One bare space mark is the empty pre-token."""
        lone = len(self.library.encode("\n ", num_threads=1)) - 1 - self.line_end
        skip = 1 + self.line_end
        return [
            lone if not u else len(ids) - skip if u[0] == "\n" else len(ids)
            for u, ids in zip(units, self.library.encode(units, num_threads=1), strict=True)
        ]


def pre_tokens(text: str) -> tuple[list[str], int]:
    """The pre-tokens of a text, with repeats, as PieceCounts.count() takes them, and the number of line ends."""
    if not text:
        return [], 0
    if "▁" in text:
        text = text.replace("▁", " ")
    lines = text.split("\n")
    out: list[str] = []
    for k, line in enumerate(lines):
        if k and not line:
            continue
        words = line.split(" ")
        if k:
            if words[0]:
                out.append("\n" + words[0])
            del words[0]
        elif len(lines) > 1 and line == "":
            out.append("")
            continue
        if "" in words:
            spaces = 0
            for w in words:
                if w:
                    out.append(" " * spaces + w)
                    spaces = 0
                else:
                    spaces += 1
            if spaces:
                out.append(" " * (spaces - 1))
        else:
            out += words
    return out, len(lines) - 1


_loaded: dict[tuple[type, str], object] = {}


def per_worker(kind: type, name: str):
    """One instance per worker process; workers are reused, and so are what they remember."""
    if (kind, name) not in _loaded:
        _loaded[kind, name] = kind(name)
    return _loaded[kind, name]
