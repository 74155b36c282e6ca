"""Languages of texts by any detector, and a small one of our own."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgrid.session import share_package

#: Texts to languages, None where there is none.
Detector = Callable[[list[str]], "list[str | None]"]
#: What makes a detector in a worker, or where it is found: "package.module:function".
Loader = Callable[[], Detector] | str
DEFAULT = "duelgrid.sources.language:function_words"

# Frequent words that tell languages of Latin script apart; a tie goes to the language that stands first.
WORDS: dict[str, tuple[str, ...]] = {
    "en": ("the", "and", "of", "to", "is", "that", "for", "with"),
    "fr": ("le", "les", "des", "et", "une", "est", "dans", "pour"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "ein", "mit"),
    "es": ("el", "los", "las", "y", "que", "por", "con", "para"),
    "it": ("il", "di", "che", "gli", "della", "sono", "non", "per"),
    "pt": ("os", "uma", "não", "em", "do", "da", "com", "são"),
    "nl": ("het", "een", "van", "niet", "zijn", "voor", "op", "aan"),
}
# Ranges of letters that a script has to itself, looked at in this order where no word tells.
SCRIPTS: dict[str, str] = {
    "ja": "぀-ヿ", "ko": "가-힯", "zh": "一-鿿", "el": "Ͱ-Ͽ", "ru": "Ѐ-ӿ", "he": "֐-׿",
    "ar": "؀-ۿ", "hi": "ऀ-ॿ", "th": "฀-๿",
}
LATIN = "a-zß-öø-ÿ"
#: Where neither words nor script tell.
UNKNOWN = "und"

_LOADED: dict[str, Detector] = {}


def function_words() -> Detector:
    """Counts frequent words of some languages; without any, the script decides."""
    language_of = {}
    for lang, words in WORDS.items():
        for w in words:
            language_of.setdefault(w, []).append(lang)
    word, scripts = re.compile(f"[{LATIN}]+"), [(lang, re.compile(f"[{letters}]")) for lang, letters in SCRIPTS.items()]
    order = list(WORDS)

    def one(text: str) -> str:
        counts = dict.fromkeys(order, 0)
        for w in word.findall(text.lower()):
            for lang in language_of.get(w, ()):
                counts[lang] += 1
        best = max(order, key=counts.__getitem__)
        return best if counts[best] else next((lang for lang, letters in scripts if letters.search(text)), UNKNOWN)

    return lambda texts: [one(t) for t in texts]


def load(loader: Loader) -> Detector:
    """The detector, made once a worker where it is named by its place."""
    if not isinstance(loader, str):
        return loader()
    if loader not in _LOADED:
        module, _, name = loader.partition(":")
        _LOADED[loader] = getattr(importlib.import_module(module), name)()
    return _LOADED[loader]


def with_language(df: DataFrame, text: Column, loader: Loader = DEFAULT, column: str = "lang") -> DataFrame:
    """df with missing languages filled in from text, in lower case; languages that are there stay.

    Only texts of rows without a language reach the detector; it is made once a worker or task and gets a batch at a time.
    A null text has no language.
    """
    share_package(df.sparkSession)

    @F.arrow_udf("string")
    def detect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        detector = None
        for batch in batches:
            texts = batch.to_pylist()
            at = [k for k, t in enumerate(texts) if t is not None]
            out: list[str | None] = [None] * len(texts)
            if at:
                detector = detector or load(loader)
                for k, lang in zip(at, detector([texts[k] for k in at]), strict=True):
                    out[k] = None if lang is None else lang.lower()
            yield pa.array(out, pa.string())

    known = F.col(column) if column in df.columns else F.lit(None).cast("string")
    return df.withColumn(column, F.coalesce(known, detect(F.when(known.isNull(), text))))
