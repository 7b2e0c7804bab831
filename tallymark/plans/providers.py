"""Model execution as a pluggable map over rows; offline providers included.

A provider answers a batch of prompts. Spark may run a task again, so answers must not
depend on how often they are asked; keep finished ones by input hash and anti-join.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER = "predicted_value string, llm_cost double, response_time double"


@dataclass
class Answer:
    text: str
    cost: float = 0.0
    seconds: float = 0.0


class Provider(Protocol):
    def complete(self, model: str, prompt: str, temperature: float = 0.0) -> Answer: ...


@dataclass
class Scripted:
    """Answers from a function of model and prompt."""

    answer: Callable[[str, str], str]
    cost_per_char: float = 0.0

    def complete(self, model: str, prompt: str, temperature: float = 0.0) -> Answer:
        return Answer(self.answer(model, prompt), self.cost_per_char * len(prompt))


class Unsupported(ValueError):
    """A model refuses a parameter; ``parameter`` names it."""

    def __init__(self, parameter: str):
        super().__init__(f"unsupported parameter: {parameter}")
        self.parameter = parameter


@dataclass
class Retrying:
    """Tries again after ``delay * 2 ** (n - 1)`` seconds. A refused temperature is left out,
    without counting as a try."""

    inner: Provider
    retries: int = 3
    delay: float = 1.0
    sleep: Callable[[float], None] = time.sleep

    def complete(self, model: str, prompt: str, temperature: float | None = 0.0) -> Answer:
        n = 1
        while True:
            try:
                return self.inner.complete(model, prompt, temperature)
            except Unsupported as e:
                if e.parameter != "temperature" or temperature is None:
                    raise
                temperature = None
            except Exception:
                if n >= self.retries:
                    raise
                self.sleep(self.delay * 2 ** (n - 1))
                n += 1


@dataclass
class Parametrised:
    """A provider that takes parameters by model (``options``), less what the model is known
    not to support; an option replaces the temperature of the call."""

    inner: Callable[..., Answer]
    options: dict[str, dict] = field(default_factory=dict)
    unsupported: dict[str, set[str]] = field(default_factory=dict)

    def complete(self, model: str, prompt: str, temperature: float | None = 0.0) -> Answer:
        given = {"temperature": temperature} | self.options.get(model, {})
        return self.inner(model, prompt, **{k: v for k, v in given.items() if v is not None and k not in self.unsupported.get(model, ())})


@dataclass
class Limited:
    """At most ``per_minute`` calls in any 60 seconds by all ``workers`` together: each has its
    share, at least one call."""

    inner: Provider
    per_minute: int
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    calls: deque = field(default_factory=deque)
    workers: int = 1

    def complete(self, model: str, prompt: str, temperature: float | None = 0.0) -> Answer:
        share = max(1, self.per_minute // max(1, self.workers))
        now = self.clock()
        while self.calls and now - self.calls[0] >= 60:
            self.calls.popleft()
        if len(self.calls) >= share:
            self.sleep(60 - (now - self.calls.popleft()))
        self.calls.append(self.clock())
        return self.inner.complete(model, prompt, temperature)


@dataclass
class Responses:
    """A provider over an interface that takes ``input`` and a ``text`` format and answers with
    a list of outputs: the prompt becomes the input, an enveloped schema is unwrapped, and
    the texts of the outputs are joined."""

    call: Callable[..., dict]
    schema: dict | None = None

    def complete(self, model: str, prompt: str, temperature: float | None = 0.0) -> Answer:
        more = {} if temperature is None else {"temperature": temperature}
        if self.schema:
            more["text"] = {"format": {"type": "json_schema"} | self.schema.get("json_schema", self.schema)}
        out = self.call(model=model, input=[{"role": "user", "content": prompt}], **more)
        parts = [c.get("text", "") for o in out.get("output", []) for c in o.get("content", []) or []]
        return Answer(out.get("output_text") or "".join(parts), float(out.get("cost", 0.0)))


@dataclass
class Counted:
    """Adds calls, failures and cost to accumulators of the session, so the driver can read
    them after an action; a task that is run again counts again."""

    inner: Provider
    calls: object
    failures: object
    cost: object

    @classmethod
    def over(cls, spark, inner: Provider) -> Counted:
        sc = spark.sparkContext
        return cls(inner, sc.accumulator(0), sc.accumulator(0), sc.accumulator(0.0))

    def complete(self, model: str, prompt: str, temperature: float | None = 0.0) -> Answer:
        self.calls.add(1)
        try:
            out = self.inner.complete(model, prompt, temperature)
        except Exception:
            self.failures.add(1)
            raise
        self.cost.add(float(out.cost))
        return out


@dataclass
class Fallback:
    """The first model of the chain that answers."""

    inner: Provider
    models: list[str]

    def complete(self, model: str, prompt: str, temperature: float = 0.0) -> Answer:
        error: Exception | None = None
        for name in [model, *self.models]:
            try:
                return self.inner.complete(name, prompt, temperature)
            except Exception as e:  # noqa: BLE001
                error = e
        raise error or RuntimeError("no model")


def predict(prompts: DataFrame, provider: Provider, workers: int | None = None, temperature: str | None = None) -> DataFrame:
    """Add an answer to each row (``model, prompt`` and others); ``workers`` bounds how many
    call at once. A failure is a row with text 'ERROR: ...' and no cost; null prompts fail."""
    keep = [f for f in prompts.schema.fields if f.name not in ("predicted_value", "llm_cost", "response_time")]
    names = [f.name for f in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", " + ANSWER
    at = names.index("model"), names.index("prompt")
    heat = names.index(temperature) if temperature else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            heats = batch.column(heat).to_pylist() if heat is not None else [0.0] * batch.num_rows
            for model, prompt, t in zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), heats):
                try:
                    if prompt is None:
                        raise ValueError("no prompt")
                    a = provider.complete(model, prompt, t)
                    out.append((a.text, float(a.cost), float(a.seconds)))
                except Exception as e:  # noqa: BLE001
                    out.append((f"ERROR: {e}", 0.0, 0.0))
            kinds = pa.string(), pa.float64(), pa.float64()
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([o[i] for o in out], kinds[i]) for i in range(3)]], [*names, "predicted_value", "llm_cost", "response_time"])

    rows = prompts.select(*names)
    if workers and isinstance(provider, Limited):
        provider.workers = workers
    return (rows.repartition(workers) if workers else rows).mapInArrow(run, schema)


def chain(prompts: DataFrame, provider: Provider, steps: list[str]) -> DataFrame:
    """Each step's template is formatted with ``{content}``, the step before's answer."""
    from ..functions.text import format_text

    out, cost = predict(prompts, provider), F.col("llm_cost")
    for template in steps:
        out = out.withColumn("_c", cost).withColumn("prompt", format_text(F.lit(template), F.col("predicted_value"))).drop("predicted_value", "llm_cost", "response_time")
        out = predict(out, provider).withColumn("llm_cost", F.col("llm_cost") + F.col("_c")).drop("_c")
    return out


def passes(prompts: DataFrame, temperatures: tuple[float, ...] = (0.0, 0.3)) -> DataFrame:
    """Every row once for each temperature, numbered by ``pass_no``."""
    each = F.array(*[F.struct(F.lit(i).alias("pass_no"), F.lit(t).alias("temperature")) for i, t in enumerate(temperatures)])
    return prompts.withColumn("_p", F.explode(each)).select("*", "_p.pass_no", "_p.temperature").drop("_p")
