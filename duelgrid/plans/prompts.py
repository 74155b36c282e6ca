"""Judge prompts: rendering as Column expressions, presets and their resolution."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from duelgrid.functions.text import truncate

OUTPUT_SECTION = "# Your output"
SYSTEM = (
    "You compare two assistants' answers to the same user prompt. Judge correctness, helpfulness and clarity, and let "
    "neither the order nor the length of the answers sway you."
)
FLUENCY_SYSTEM = "You compare two texts by fluency alone: grammar, natural wording and consistent use of the language."
SCORES = "score_A: <number from 0 to 10>\nscore_B: <number from 0 to 10>\n"
EXPLAINED = "explanation: <a short comparison>\n" + SCORES
SLOTS = ("{user_prompt}", "{completion_A}", "{completion_B}", "{output}")
TEMPLATE = (
    "<|User Prompt|>\n{user_prompt}\n\n"
    "<|The Start of Assistant A's Answer|>\n{completion_A}\n<|The End of Assistant A's Answer|>\n\n"
    "<|The Start of Assistant B's Answer|>\n{completion_B}\n<|The End of Assistant B's Answer|>\n\n"
    f"{OUTPUT_SECTION}\n{{output}}"
)


def fill(template: str, values: dict[str, Column]) -> Column:
    """Concatenate a template's literal parts with columns, so that braces in a value are never taken for a slot."""
    parts: list[Column] = []
    rest = template
    while rest:
        found = min(((rest.find(k), k) for k in values if k in rest), default=None)
        if found is None:
            parts.append(F.lit(rest))
            break
        at, slot = found
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[slot])
        rest = rest[at + len(slot) :]
    return F.concat(*parts) if parts else F.lit("")


def render_pair(prompt: Column, a: Column, b: Column, limit: int | None = None, template: str = TEMPLATE, explain: bool = False) -> Column:
    values = (truncate(prompt, limit), truncate(a, limit), truncate(b, limit), F.lit(EXPLAINED if explain else SCORES))
    return fill(template, dict(zip(SLOTS, values)))


def render_single_turn(question: Column, a: Column, b: Column, reference: Column | None = None) -> Column:
    """One turn; a reference block stands only where `reference` is not NULL."""
    block = F.lit("")
    if reference is not None:
        block = F.when(reference.isNull(), "").otherwise(F.concat(F.lit("\n\n[Reference Answer]\n"), reference))
    return F.concat(
        F.lit("[Question]\n"), truncate(question), block, F.lit("\n\n[Assistant A]\n"), truncate(a), F.lit("\n\n[Assistant B]\n"), truncate(b), F.lit("\n")
    )


def render_two_turns(q1: Column, q2: Column, a: tuple[Column, Column], b: tuple[Column, Column], references: tuple[Column, Column] | None = None) -> Column:
    """Both turns of each assistant, one conversation after the other."""
    parts: list[Column] = []
    if references is not None:
        for k, (q, r) in enumerate(zip((q1, q2), references), 1):
            parts += [F.lit(f"[Question {k}]\n"), truncate(q), F.lit(f"\n[Reference Answer {k}]\n"), truncate(r), F.lit("\n\n")]
    for name, answers in (("A", a), ("B", b)):
        for k, (q, answer) in enumerate(zip((q1, q2), answers), 1):
            parts += [F.lit(f"[User to {name}, turn {k}]\n"), truncate(q), F.lit(f"\n[Assistant {name}, turn {k}]\n"), truncate(answer), F.lit("\n\n")]
    return F.concat(*parts)


def output_section(template: str) -> str:
    """What follows from the output heading on; an error where a template has none."""
    at = template.find(OUTPUT_SECTION)
    if at < 0:
        raise ValueError(f"the template lacks {OUTPUT_SECTION!r}")
    return template[at:]


@dataclass(frozen=True)
class Preset:
    name: str
    system: str | None = SYSTEM
    template: str | None = TEMPLATE
    explain: bool = False
    #: Judged by verdicts, with prompts of the two-turn benchmark.
    delegated: bool = False

    def metadata(self) -> dict[str, object]:
        sha = lambda s: None if s is None else hashlib.sha256(s.encode()).hexdigest()
        return {"preset": self.name, "system_sha256": sha(self.system), "template_sha256": sha(self.template), "explain": self.explain}


PRESETS = {
    p.name: p
    for p in (
        Preset("default"), Preset("default_with_explanation", explain=True), Preset("fluency", system=FLUENCY_SYSTEM),
        Preset("fastchat-pairwise", system=None, template=None, delegated=True),
    )
}
TASK_PRESET = {"alpaca-eval": "default", "arena-hard-v0.1": "default", "arena-hard-v2.0": "default", "mt-bench": "fastchat-pairwise"}


def default_preset(task: str | None) -> str:
    if task in TASK_PRESET:
        return TASK_PRESET[task]
    return "fluency" if (task or "").startswith("fluency") else "default"


def resolve(task: str | None = None, preset: str | None = None, system_file: str | None = None, template_file: str | None = None) -> Preset:
    """Files win over a named preset, which wins over the task's default."""
    name = preset or default_preset(task)
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; known: {', '.join(PRESETS)}")
    found = PRESETS[name]
    if not (system_file or template_file):
        return found
    template = Path(template_file).read_text() if template_file else found.template or TEMPLATE
    lost = [s for s in SLOTS[1:3] if s not in template]
    if lost:
        raise ValueError(f"the template lacks {', '.join(lost)}")
    return Preset("file", Path(system_file).read_text() if system_file else found.system, template, found.explain)
