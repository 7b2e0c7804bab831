"""Prompts of a run, prepared once for each model on the driver."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.arrowmap import map_batches
from .schemas import json_block


@dataclass
class ModelSpec:
    name: str
    label: str | None = None
    prompt: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    manipulations: list[str] = field(default_factory=list)
    cost_rate: float | None = None
    cost_rate_time_unit: str = "1 hour"
    passes: int = 2

    @property
    def key(self) -> str:
        return self.label or self.name


def check_prompt(prompt: str) -> None:
    if not re.search(r"\{\w+\}", prompt):
        raise ValueError("a prompt needs a placeholder such as {content}")


def check_labels(models: list[ModelSpec]) -> None:
    keys = [m.key for m in models]
    twice = sorted({k for k in keys if keys.count(k) > 1})
    if twice:
        raise ValueError(f"labels used twice: {', '.join(twice)}")


def inject_examples(prompt: str, examples: list[tuple[str, str]], mode: str = "classify") -> str:
    """A block of worked examples before the first ``{content}``."""
    if not examples:
        return prompt
    verb = "extracted" if mode == "extract" else "classified"
    block = f"Examples of how texts were {verb}:\n" + "".join(f"\nDocument: {d}\nLabel: {l}\n" for d, l in examples) + "\n"
    head, mark, tail = prompt.partition("{content}")
    return f"{head}{block}{mark}{tail}" if mark else block + prompt


# Words by which a prompt asks for JSON, for one word only, or for a reason already.
ASKS_JSON = ("json", "schema", "structured output", "key-value")
ASKS_BRIEF = ("only the label", "only with", "one word", "single word", "nothing else", "no explanation", "just the")
ASKS_REASON = ("explain", "explanation", "reasoning", "justify", "rationale", "step by step", "because")


def add_explanation(prompt: str, schema: dict | None = None) -> str:
    """Ask for a reason: as a member of the answer if that is JSON (a schema, an example in the
    prompt, or its words say so; an example gets the member), else as text, taking back a
    request for the bare answer. A prompt that asks for a reason already stays as it is."""
    low = prompt.lower()
    if any(w in low for w in ASKS_REASON if w != "explanation" or "no explanation" not in low):
        return prompt
    shown = json_block(prompt)
    if isinstance(shown, dict) and "properties" not in shown:
        example = json.dumps({"explanation": "why"} | shown, ensure_ascii=False)
        return f'{prompt}\n\nPut a member "explanation" with your reason before all others, such as {example}'
    if schema is not None or shown is not None or any(w in low for w in ASKS_JSON):
        return prompt + '\n\nPut a member "explanation" with your reason before all others.'
    brief = " This replaces the request for the bare answer." if any(w in low for w in ASKS_BRIEF) else ""
    return f"{prompt}\n\nGive the answer on the first line, and your reason on the next.{brief}"


def for_field(prompt: str, name: str, note: str = "") -> str:
    """The prompt of one list of an extraction that is split; the others are not asked for."""
    told = f" {note.strip()}" if note.strip() else ""
    ask = f"\n\nExtract {name} only, as a JSON list.{told} Another request covers the other fields; leave them out. Do not guess: an empty list if there are none."
    head, mark, tail = prompt.partition("{content}")
    return f"{head}{mark}{tail}{ask}"


def missing_fields(wanted: list[str], given: dict[str, str]) -> list[str]:
    """Fields without a prompt of their own, where prompts are given by hand."""
    return [f for f in wanted if f not in given] if given else []


def with_explanation(schema: dict) -> dict:
    """A JSON schema with an explanation first and no members besides."""
    inner = {"explanation": {"type": "string"}} | schema.get("properties", {})
    return schema | {"properties": inner, "required": ["explanation", *schema.get("required", [])], "additionalProperties": False}


def prepare(prompt: str, model: ModelSpec, examples: list[tuple[str, str]] = (), schema: dict | None = None, strategies: tuple[Callable[[str], str], ...] = ()) -> str:
    """Override, strategies of the caller's (text to text; a placeholder has to stay), examples,
    explanation, then repetition; three times wins over twice. Examples
    are worded by the kind of task that their labels show."""
    out = model.prompt or prompt
    check_prompt(out)
    for change in strategies:
        out = change(out)
        check_prompt(out)
    if "few_shot" in model.manipulations:
        out = inject_examples(out, list(examples), "extract" if task_type([l for _, l in examples]) == "extraction" else "classify")
    if "explanation" in model.manipulations:
        out = add_explanation(out, schema)
    times = 3 if "prompt_repetition_x3" in model.manipulations else 2 if "prompt_repetition" in model.manipulations else 1
    return "\n\nLet me repeat that:\n\n".join([out] * times)


def task_type(labels: list[Any]) -> str:
    """'extraction' if one of the first three labels is an object or JSON with a nested value."""
    for label in labels[:3]:
        try:
            value = json.loads(label) if isinstance(label, str) else label
        except ValueError:
            continue
        if isinstance(value, dict) and (not isinstance(label, str) or any(isinstance(v, (dict, list)) for v in value.values())):
            return "extraction"
    return "classification"


def parse_examples(text: str) -> list[tuple[str, str]]:
    """(document, label) pairs of ``Document:``/``Label:`` blocks; further lines continue a
    document; a document without a label is dropped."""
    out, doc = [], None
    for line in text.splitlines():
        if m := re.match(r"\s*(?:\d+[.)]\s*)?document\s*:\s*(.*)", line, re.I):
            doc = [m[1]]
        elif m := re.match(r"\s*label\s*:\s*(.*)", line, re.I):
            if doc is not None:
                out.append(("\n".join(doc).strip(), m[1].strip()))
            doc = None
        elif doc is not None:
            doc.append(line)
    return out


def length_range(seeds: list[str]) -> tuple[int, int]:
    """0.8 and 1.2 times the mean length of the seeds."""
    mean = sum(map(len, seeds)) // max(1, len(seeds))
    return int(mean * 0.8), int(mean * 1.2)


def parsed_examples(answers: DataFrame, text: str = "text") -> DataFrame:
    """``ordinal, document, label`` and the other columns: a row for each example in a text."""
    keep = [c for c in answers.columns if c not in ("ordinal", "document", "label")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in answers.select(*keep).schema.fields) + ", ordinal int, document string, label string"
    at = keep.index(text)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, out = [], []
            for i, t in enumerate(batch.column(at).to_pylist()):
                found = parse_examples(t or "")
                row += [i] * len(found)
                out += [(n, *pair) for n, pair in enumerate(found)]
            taken = [c.take(pa.array(row, pa.int32())) for c in batch.columns]
            kinds = pa.int32(), pa.string(), pa.string()
            return pa.RecordBatch.from_arrays([*taken, *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]], [*keep, "ordinal", "document", "label"])

        return step

    return map_batches(answers.select(*keep), schema, make)
