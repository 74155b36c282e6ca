"""Judging criteria: definitions, validation and prompt text."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST, MOST = 1, 10


@dataclass(frozen=True)
class Criterion:
    name: str
    description: str
    score_references: dict[int, str] = field(default_factory=dict)

    def __post_init__(self):
        if not self.name.strip():
            raise ValueError("a criterion needs a name")
        cleaned = {}
        for score, text in self.score_references.items():
            if not LEAST <= int(score) <= MOST:
                raise ValueError(f"score reference {score} of {self.name!r} is not in {LEAST}..{MOST}")
            cleaned[int(score)] = str(text).strip()
        for k, v in (("name", self.name.strip()), ("description", self.description.strip()), ("score_references", cleaned)):
            object.__setattr__(self, k, v)

    def prompt_block(self) -> str:
        """The criterion and its reference scores, highest first."""
        lines = [f"- {self.name}: {self.description}"]
        lines += [f"    {s}: {t}" for s, t in sorted(self.score_references.items(), reverse=True)]
        return "\n".join(lines)


# The names under which judges report scores.
DEFAULT = (
    Criterion("adherence", "Does what the prompt asks, in the form, scope and style that it sets."),
    Criterion("helpfulness", "Brings the user closer to the goal by relevant and usable content."),
    Criterion("factuality", "States what is right, and says so where it is unsure."),
    Criterion("completeness", "Leaves out no part of what was asked."),
    Criterion("clarity", "Is well ordered, easy to follow and has one meaning."),
    Criterion("fluency", "Reads well: natural language, fitting tone and length."),
)


def from_mapping(data: dict) -> list[Criterion]:
    if not isinstance(data, dict) or not isinstance(data.get("criteria"), list):
        raise ValueError("criteria must be a mapping with a list `criteria`")
    return [Criterion(c["name"], c.get("description", ""), c.get("score_references") or {}) for c in data["criteria"]]


def load(path: str) -> list[Criterion]:
    if Path(path).suffix not in (".yaml", ".yml"):
        raise ValueError("criteria come from .yaml or .yml files")
    import yaml

    return from_mapping(yaml.safe_load(Path(path).read_text()))


def resolve(path: str | None = None) -> list[Criterion]:
    return load(path) if path else list(DEFAULT)


def prompt_block(criteria: list[Criterion]) -> str:
    return "\n".join(c.prompt_block() for c in criteria)


def scores_in_order(scores: Column, criteria: list[Criterion]) -> Column:
    """A map name -> score as an array in the criteria's order, 0.0 where a score is missing."""
    return F.array(*(F.coalesce(F.try_element_at(scores, F.lit(c.name)), F.lit(0.0)) for c in criteria))
