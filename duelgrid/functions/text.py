"""Text expressions: truncation, reasoning removal, judge-text parsing, slugs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that a judge's scores must match. (?d) lets `.` stop at \n only.
SCORE_A = r'(?d)score.*?a[": *\n]*(-?\d+)'
SCORE_B = r'(?d)score.*?b[": *\n]*(-?\d+)'
THINK_BLOCK = r"(?is)<think>.*?</think>"
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
# Fixed value: what an engine writes where it ends a model's reasoning by force.
FORCED_END = "I have to give the solution based on the thinking directly now.</think>"


def truncate(text: Column, limit: int | None = None) -> Column:
    """The first `limit` code points; NULL becomes ''."""
    return F.coalesce(text if limit is None else F.left(text, F.lit(limit)), F.lit(""))


def safe_text(value: Column, limit: int | None = None) -> Column:
    return truncate(value.cast("string"), limit)


def _lstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often the body uses it; plain columns are copied into each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without_thinking(text: Column) -> Column:
    """struct(answer, found): a text without its reasoning, and whether it had any."""

    def of(text: Column, cleaned: Column) -> Column:
        closing, opening = F.instr(F.lower(text), THINK_CLOSE), F.instr(F.lower(text), THINK_OPEN)
        stray, forced = (closing > 0) & ((opening == 0) | (opening > closing)), F.instr(text, FORCED_END)
        after = lambda at, mark: _lstrip(text.substr(at + len(mark), F.length(text)))
        tidy = (
            F.when(cleaned != text, _lstrip(cleaned)).when(stray, after(closing, THINK_CLOSE)).when(forced > 0, after(forced, FORCED_END))
        )
        return let(tidy, lambda t: F.struct(F.coalesce(t, text, F.lit("")).alias("answer"), t.isNotNull().alias("found")))

    # most texts hold no closing tag, and nothing to look for with it
    searched = let(text, lambda t: let(F.regexp_replace(t, THINK_BLOCK, ""), lambda c: of(t, c)))
    plain = F.struct(F.coalesce(text, F.lit("")).alias("answer"), F.lit(False).alias("found"))
    return F.when(F.contains(F.lower(text), F.lit(THINK_CLOSE)), searched).otherwise(plain)


def strip_thinking(text: Column) -> Column:
    """Text without its reasoning: whole blocks, all up to a closing tag that nothing opened, or up to a forced end; NULL becomes ''."""
    return _without_thinking(text)["answer"]


def had_thinking(text: Column) -> Column:
    return _without_thinking(text)["found"]


def regexp_number(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match as a double; NULL where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("double")


def score_a(judge_text: Column) -> Column:
    return regexp_number(F.lower(strip_thinking(judge_text)), SCORE_A)


def score_b(judge_text: Column) -> Column:
    return regexp_number(F.lower(strip_thinking(judge_text)), SCORE_B)


def verdict(judge_text: Column) -> Column:
    """A, B, tie or error by the first of [[A]], [[B]], [[C]] in that order of precedence."""
    return let(strip_thinking(judge_text), lambda text: (
        F.when(F.contains(text, F.lit("[[A]]")), "A").when(F.contains(text, F.lit("[[B]]")), "B")
        .when(F.contains(text, F.lit("[[C]]")), "tie").otherwise("error")
    ))


def slugify(name: Column, default: str = "model") -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def provider_of(spec: Column) -> Column:
    return F.split_part(spec, F.lit("/"), F.lit(1))


def model_of(spec: Column) -> Column:
    """All after the first slash; '' without one."""
    at = F.instr(spec, "/")
    return F.when(at > 0, spec.substr(at + 1, F.length(spec))).otherwise("")


# Model families that reason before they answer, and their reasoning parsers.
THINKING_MODELS = (("qwen3", "qwen3"), ("smollm3", "qwen3"), ("olmo-3-7b-think", "olmo3"))


def reasoning_parser(model: Column) -> Column:
    """The parser of a thinking model, NULL for others."""
    low = F.lower(model)
    return F.coalesce(*(F.when(F.contains(low, F.lit(k)), v) for k, v in THINKING_MODELS))


def criteria_numbers(text: Column) -> Column:
    """The integers of the first bracketed list in a text; an empty array without one."""
    inner = F.regexp_extract(text, r"\[(.*?)\]", 1)
    parts = F.split(F.regexp_replace(inner, r"[^\d.,]", ""), ",")
    return F.coalesce(F.filter(F.transform(parts, lambda x: F.when(x.rlike(r"^\d+$"), x.try_cast("int"))), lambda x: x.isNotNull()), F.array().cast("array<int>"))


def content_text(content: Column) -> Column:
    """Text of a message given as blocks array<struct<type, text>>: its text blocks, joined by spaces."""
    return F.array_join(F.transform(F.filter(content, lambda b: b["type"] == "text"), lambda b: b["text"]), " ")


def message(conversation: Column, position: int) -> Column:
    """The content of a conversation's message, NULL beyond its end."""
    return F.get(conversation, F.lit(position))["content"]


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("-", *parts)


def fixed_map(key: Column, values: dict[str, object], default: object = None) -> Column:
    """A small fixed lookup as a CASE expression."""
    out = reduce(lambda w, kv: w.when(key == kv[0], F.lit(kv[1])), values.items(), F)
    return out.otherwise(F.lit(default)) if values else F.lit(default)


# Sampling temperatures of the two-turn benchmark's categories.
CATEGORY_TEMPERATURE = {
    "writing": 0.7, "roleplay": 0.7, "extraction": 0.0, "math": 0.0, "coding": 0.0, "reasoning": 0.0, "stem": 0.1,
    "humanities": 0.1, "arena-hard-200": 0.0,
}
REFERENCE_CATEGORIES = ("math", "reasoning", "coding", "arena-hard-200")


def category_temperature(category: Column, default: float = 0.7) -> Column:
    return fixed_map(category, CATEGORY_TEMPERATURE, default)


def needs_reference(category: Column) -> Column:
    return F.coalesce(category.isin(*REFERENCE_CATEGORIES), F.lit(False))
