"""Configuration of a run, checked on the driver before anything is asked."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cost import time_unit_seconds
from ..operators.scoring import FieldConfig, check_expensive, infer_config
from .prompts import ModelSpec, check_labels, check_prompt

# Manipulations of a prompt or an answer; those that need a response schema.
MANIPULATIONS = ("few_shot", "explanation", "prompt_repetition", "prompt_repetition_x3", "decompose", "hallucination_filter", "multi_pass")
STRUCTURED = ("decompose", "hallucination_filter", "multi_pass")


@dataclass
class Settings:
    """How models are called; ``from_env`` reads TALLYMARK_* variables."""

    retries: int = 3
    delay: float = 1.0
    per_minute: int | None = None
    workers: int = 5
    log_level: str = "INFO"
    keys: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        get = lambda name, kind, default: kind(env[f"TALLYMARK_{name}"]) if env.get(f"TALLYMARK_{name}") else default
        keys = {k.removesuffix("_API_KEY").lower(): v for k, v in env.items() if k.endswith("_API_KEY") and v}
        return cls(get("RETRIES", int, 3), get("DELAY", float, 1.0), get("PER_MINUTE", int, None), get("WORKERS", int, 5), get("LOG_LEVEL", str, "INFO"), keys)


@dataclass
class FewShot:
    """Examples that are generated: by which model, checked by which others, how many."""

    generator: str
    validators: list[str] = field(default_factory=list)
    count: int = 10
    seeds: int = 10
    injected: int = 5


@dataclass
class RunConfig:
    models: list[ModelSpec]
    prompt: str
    use_case: str = "evaluation"
    temperature: float = 0.0
    output_dir: str | None = None
    scoring: FieldConfig | None = None
    few_shot: FewShot | None = None
    schema: dict | None = None

    @classmethod
    def parse(cls, raw: dict[str, Any]) -> RunConfig:
        """From its dict form; unknown keys, manipulations and model types raise. A model's type is
        ``llm`` unless told."""
        known = {"models", "prompt", "use_case", "temperature", "output_dir", "field_metrics_config", "few_shot", "response_format"}
        if set(raw) - known:
            raise ValueError(f"unknown keys: {sorted(set(raw) - known)}")
        check_prompt(raw["prompt"])
        models = [parse_model(m) for m in raw["models"]]
        check_labels(models)
        config = raw.get("field_metrics_config")
        shots = raw.get("few_shot")
        return cls(models, raw["prompt"], raw.get("use_case", "evaluation"), float(raw.get("temperature", 0.0)), raw.get("output_dir"), FieldConfig.parse(config) if config else None, FewShot(**shots) if shots else None, raw.get("response_format"))

    def folder(self, given: str | None = None) -> str:
        """The argument, else the configuration; without either it raises."""
        out = given or self.output_dir
        if not out:
            raise ValueError("no output folder given")
        return out


def parse_model(raw: dict[str, Any] | str) -> ModelSpec:
    raw = {"name": raw} if isinstance(raw, str) else dict(raw)
    kind = raw.pop("type", "llm")
    if kind not in ("llm", "classifier"):
        raise ValueError(f"unknown type of model: {kind}")
    known = {"name", "label", "prompt", "params", "manipulations", "cost_rate", "cost_rate_time_unit", "passes"}
    if set(raw) - known:
        raise ValueError(f"unknown keys of a model: {sorted(set(raw) - known)}")
    bad = sorted(set(raw.get("manipulations", ())) - set(MANIPULATIONS))
    if bad:
        raise ValueError(f"unknown manipulations: {bad}")
    time_unit_seconds(raw.get("cost_rate_time_unit", "1 hour"))
    return ModelSpec(**raw)


def arguments(model: ModelSpec, temperature: float) -> dict[str, Any]:
    """Of a call: the run's temperature, replaced by the model's own parameters, and its rate."""
    return {"temperature": temperature} | model.params | ({"cost_rate": model.cost_rate} if model.cost_rate is not None else {})


def scoring_config(given: FieldConfig | None, first_label: Any) -> FieldConfig | None:
    """What is given, else inferred from the first label if it is an object or a list; None
    (text equality) for plain labels."""
    if given is not None:
        return given
    return infer_config(first_label) if isinstance(first_label, (dict, list)) else None


def missing_keys(models: list[str], keys: dict[str, str]) -> dict[str, list[str]]:
    """Providers without a key, with the models that need it: the part of a name before ``/``."""
    out: dict[str, list[str]] = {}
    for m in models:
        provider = m.split("/")[0].lower() if "/" in m else ""
        if provider and provider not in keys:
            out.setdefault(provider, []).append(m)
    return out


def preflight(config: RunConfig, settings: Settings | None = None, supports: DataFrame | None = None) -> list[str]:
    """Raises on labels used twice, keys that are missing, comparisons that cost without leave
    and manipulations that need a schema; returns warnings on parameters that a model (of
    ``supports``: ``model, parameter``) does not take."""
    check_labels(config.models)
    if settings is not None and (lack := missing_keys([m.name for m in config.models], settings.keys)):
        raise ValueError("no key for " + "; ".join(f"{p} ({', '.join(ms)})" for p, ms in sorted(lack.items())))
    if config.scoring is not None and (bad := check_expensive(config.scoring)):
        raise ValueError(f"lists at {', '.join(bad)} would ask a model for all pairs: name them in allow_expensive_comparisons_for or use a local metric")
    for m in config.models:
        need = sorted(set(m.manipulations) & set(STRUCTURED))
        if need and config.schema is None:
            raise ValueError(f"{m.key}: {', '.join(need)} needs a response schema")
    if supports is None:
        return []
    names = [m.name for m in config.models]
    takes = {(r.model, r.parameter) for r in supports.where(F.col("model").isin(names)).select("model", "parameter").distinct().collect()}
    return [f"{m.key} does not take {p}" for m in config.models for p in sorted(m.params) if (m.name, p) not in takes]


def available(catalog: DataFrame) -> DataFrame:
    return catalog.select("name").distinct().orderBy("name")


def suggested(catalog: DataFrame, current: list[str], n: int = 3) -> DataFrame:
    """The first ``n`` usable models by expected cost that are not in use."""
    cost = F.col("input_cost_per_token") + F.col("output_cost_per_token")
    return catalog.where((F.col("mode") == "chat") & cost.isNotNull() & ~F.col("name").isin(current)).orderBy(cost, "name").select("name").limit(n)


def priced(catalog: DataFrame, name: str, tokens_in: int, tokens_out: int) -> float:
    """Expected cost of a call; an unknown or unpriced model and negative counts raise."""
    if tokens_in < 0 or tokens_out < 0:
        raise ValueError("token counts cannot be negative")
    row = catalog.where((F.col("name") == name) & (F.col("mode") == "chat")).select("input_cost_per_token", "output_cost_per_token").first()
    if row is None or row[0] is None or row[1] is None:
        raise ValueError(f"unknown model: {name}")
    return tokens_in * row[0] + tokens_out * row[1]


def capabilities(catalog: DataFrame) -> DataFrame:
    """``name, provider, chat, free, long_context`` of each model for a chooser."""
    free = (F.coalesce("input_cost_per_token", F.lit(0.0)) == 0) & (F.coalesce("output_cost_per_token", F.lit(0.0)) == 0)
    return catalog.select("name", F.col("litellm_provider").alias("provider"), (F.col("mode") == "chat").alias("chat"), free.alias("free"), (F.coalesce("max_input_tokens", F.lit(0)) >= 100_000).alias("long_context")).dropDuplicates(["name"])
