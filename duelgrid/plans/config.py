"""Run configuration: defaults, then a YAML file, then explicit values; the later wins."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

SWAP_MODES = ("fixed", "both")


@dataclass
class ModelConfig:
    model_a: str | None = None
    model_b: str | None = None
    max_out_tokens: int = 32768
    temperature: float | None = None
    top_p: float | None = None
    top_k: int | None = None
    seed: int | None = None
    engine_kwargs: dict = field(default_factory=dict)
    #: For the other model; what is None here is taken from above.
    baseline: dict = field(default_factory=dict)

    def generation_kwargs(self, baseline: bool = False) -> dict[str, Any]:
        own = {"max_tokens": self.max_out_tokens, "temperature": self.temperature, "top_p": self.top_p, "top_k": self.top_k, "seed": self.seed}
        extra = self.engine_kwargs
        if baseline:
            extra = self.baseline.get("engine_kwargs", extra)
            own |= {k: v for k, v in self.baseline.items() if k in own and v is not None}
        return {**extra, **{k: v for k, v in own.items() if v is not None}}


@dataclass
class JudgeConfig:
    model: str = "Dummy/score_A: 0 score_B: 0"
    swap_mode: str = "fixed"
    temperature: float | None = None
    preset: str | None = None
    system_file: str | None = None
    template_file: str | None = None
    explain: bool = False
    max_out_tokens: int = 32768
    engine_kwargs: dict = field(default_factory=dict)

    def generation_kwargs(self, engine_kwargs: dict[str, Any] | None = None) -> dict[str, Any]:
        """What the judge's model call gets; engine settings of the evaluated model go only to a local engine."""
        from duelgrid.plans.inference import judge_defaults

        own = {"max_tokens": self.max_out_tokens} | ({} if self.temperature is None else {"temperature": self.temperature})
        return judge_defaults(self.model, engine_kwargs or {}, self.engine_kwargs) | own


@dataclass
class EloConfig:
    n_random: int | None = None
    #: The first battles in all; n_instructions, where given, counts in its place.
    n_head: int | None = None
    n_per_language: int | None = None
    languages: list[str] = field(default_factory=list)
    #: What tells the language of a battle that has none: "package.module:function", a function that makes a detector.
    detector: str | None = "duelgrid.sources.language:function_words"
    bootstraps: int = 20
    least_battles: int = 500
    soft: bool = True
    calibrate: bool = False
    #: Human battles that calibration judges; 0 takes all.
    n_calibration: int = 1000
    baseline: str | None = None


@dataclass
class RunConfig:
    task: str = "alpaca-eval"
    n_instructions: int | None = None
    truncate_chars: int = 8192
    seed: int = 0
    result_folder: str = "results"
    #: Folder of judged and generated tables that later runs may use; None keeps none.
    cache_folder: str | None = None
    ignore_cache: bool = False
    #: Requests that a task has under way at once, of providers that take one at a time.
    in_flight: int = 32
    #: Turns of the two-turn benchmark: both, single or multi.
    turns: str = "both"
    models: ModelConfig = field(default_factory=ModelConfig)
    judge: JudgeConfig = field(default_factory=JudgeConfig)
    elo: EloConfig = field(default_factory=EloConfig)

    def validate(self) -> RunConfig:
        from duelgrid.operators.battles import sampling_mode
        from duelgrid.plans.baselines import ARENAS

        if self.judge.swap_mode not in SWAP_MODES:
            raise ValueError(f"swap_mode is one of {', '.join(SWAP_MODES)}")
        if not self.models.model_a:
            raise ValueError("model_a is needed")
        if self.task.startswith("elo-"):
            if self.task not in ARENAS:
                raise ValueError(f"unknown rating task {self.task!r}; known: {', '.join(ARENAS)}")
            sampling_mode(self.elo.n_random, self.elo.n_head if self.n_instructions is None else self.n_instructions, self.elo.n_per_language)
            if self.elo.calibrate and not self.elo.soft:
                raise ValueError("calibration only serves soft ratings")
        return self


def _merged(into: Any, values: dict[str, Any], where: str = "") -> Any:
    known = {f.name for f in fields(into)}
    for k, v in values.items():
        if k not in known:
            raise ValueError(f"unknown setting {where}{k}")
        now = getattr(into, k)
        if is_dataclass(now):
            _merged(now, v, f"{where}{k}.")
        else:
            setattr(into, k, v)
    return into


def build(path: str | None = None, text: str | None = None, **values: Any) -> RunConfig:
    """Nested values are given as mappings, or with dots: build(**{"judge.swap_mode": "both"}). text stands for a file's content."""
    config = RunConfig()
    if path or text is not None:
        import yaml

        data = yaml.safe_load(Path(path).read_text() if text is None else text) or {}
        if not isinstance(data, dict):
            raise ValueError("a configuration file holds a mapping")
        _merged(config, data)
    for k, v in values.items():
        nested: Any = v
        for part in reversed(k.split(".")):
            nested = {part: nested}
        _merged(config, nested)
    return config.validate()


def dumped(config: RunConfig) -> str:
    """YAML that build() reads back to the same configuration."""
    import yaml

    return yaml.safe_dump(asdict(config), sort_keys=True)


def dump(config: RunConfig, path: str) -> None:
    Path(path).write_text(dumped(config))
