"""Extractions in several requests: a list field each, repeated passes, verified values."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_text, strip_fence
from ..operators.extraction import grounded, merge_passes, split_point
from .prompts import for_field, missing_fields
from .providers import Provider, passes, predict


def field_prompts(prompt: str, schema: dict, own: dict[str, str] | None = None, notes: dict[str, str] | None = None) -> dict[str, str]:
    """A prompt for each list of the schema's split point; {} if it has none. Prompts of one's
    own have to cover all of them."""
    found = split_point(schema)
    if not found:
        return {}
    lack = missing_fields(found[1], own or {})
    if lack:
        raise ValueError(f"no prompt for {', '.join(lack)}")
    return {f: (own or {}).get(f) or for_field(prompt, f, (notes or {}).get(f, "")) for f in found[1]}


def _listed(text: Column, name: str) -> Column:
    """The list in an answer: itself, or the member ``name`` of an object at any level of the
    first two; [] for anything else."""
    v = F.try_parse_json(strip_fence(text))
    kind = F.schema_of_variant(v)
    member = F.try_variant_get(v, f"$['{name}']", "variant")
    inner = F.element_at(F.filter(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: F.schema_of_variant(F.try_variant_get(x, f"$['{name}']", "variant")).startswith("ARRAY")), 1)
    deep = F.try_variant_get(inner, f"$['{name}']", "variant")
    is_list = lambda x: F.schema_of_variant(x).startswith("ARRAY")
    return F.when(kind.startswith("ARRAY"), F.to_json(v)).when(is_list(member), F.to_json(member)).when(is_list(deep), F.to_json(deep)).otherwise("[]")


def extract(docs: DataFrame, model: str, provider: Provider, schema: dict, prompts: dict[str, str], workers: int | None = None) -> DataFrame:
    """``docs`` (``id, content``) with ``predicted_value`` (the lists of all fields, as one object in
    the schema's shape), ``llm_cost`` and ``response_time``: one request for each field,
    those of a document brought together by its id. A failed one leaves an empty list."""
    path, fields = split_point(schema)
    steps = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(prompts[f]).alias("step")) for f in fields])
    asked = docs.select("id", "content", F.explode(steps).alias("_s")).select("id", "_s.field", F.lit(model).alias("model"), format_text(F.col("_s.step"), F.col("content")).alias("prompt"))
    answered = predict(asked, provider, workers)
    by_field = [F.max(F.when(F.col("field") == f, _listed(F.col("predicted_value"), f))).alias(f"_f{i}") for i, f in enumerate(fields)]
    merged = answered.groupBy("id").agg(*by_field, F.sum("llm_cost").alias("llm_cost"), F.sum("response_time").alias("response_time"))
    parts = [F.concat(F.lit(json.dumps(f) + ":"), F.coalesce(F.col(f"_f{i}"), F.lit("[]"))) for i, f in enumerate(fields)]
    text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    for k in reversed(path):
        text = F.concat(F.lit("{" + json.dumps(k) + ":"), text, F.lit("}"))
    return docs.join(merged.select("id", text.alias("predicted_value"), "llm_cost", "response_time"), "id")


def several_passes(prompts: DataFrame, provider: Provider, n: int = 2, workers: int | None = None) -> DataFrame:
    """``prompts`` (``id, model, prompt``) asked ``n`` times, the first at temperature 0 and the
    others at 0.3, and the answers merged: lists united, else the first one."""
    rows = predict(passes(prompts, (0.0, *[0.3] * (n - 1))), provider, workers, "temperature")
    order = F.transform(F.array_sort(F.collect_list(F.struct("pass_no", F.col("predicted_value").alias("t")))), lambda x: x["t"])
    rest = [c for c in prompts.columns if c not in ("id", "model")]
    gathered = rows.groupBy("id", "model").agg(*[F.first(c).alias(c) for c in rest], order.alias("_texts"), F.sum("llm_cost").alias("llm_cost"), F.sum("response_time").alias("response_time"))
    merged = merge_passes(gathered, "_texts", "_merged")
    return merged.withColumn("predicted_value", F.coalesce("_merged", F.element_at("_texts", 1))).drop("_texts", "_merged")


def verified(answers: DataFrame, document: str = "content", verdicts: DataFrame | None = None) -> DataFrame:
    """Predictions without strings that the document does not hold; ``verdicts`` (``id, value,
    grounded``) of a model that was asked before may keep one."""
    if verdicts is None:
        return grounded(answers, "predicted_value", document, "_found").drop("predicted_value").withColumnRenamed("_found", "predicted_value")
    kept = verdicts.where("grounded").groupBy("id").agg(F.concat_ws("\n", F.collect_set("value")).alias("_kept"))
    rows = answers.join(kept, "id", "left").withColumn("_all", F.concat_ws("\n", document, "_kept"))
    return grounded(rows, "predicted_value", "_all", "_found").drop("_kept", "_all", "predicted_value").withColumnRenamed("_found", "predicted_value")


def filtered(answers: DataFrame, keep: Callable[[str, str], str], document: str = "content") -> DataFrame:
    """``keep(value, document)`` applied to each answer on the executors, in Arrow batches; an
    answer on which it fails stays as it is."""
    @F.pandas_udf("string")
    def run(values: pd.Series, docs: pd.Series) -> pd.Series:
        def one(v, d):
            try:
                return keep(v, d)
            except Exception:  # noqa: BLE001
                return v

        return pd.Series([one(v, d) for v, d in zip(values, docs)], dtype="object")

    return answers.withColumn("predicted_value", run("predicted_value", document))


def split_examples(examples: DataFrame, fields: list[str], path: list[str] = ()) -> DataFrame:
    """``field, document, label``: an example (``document, label`` as JSON) for each field that it
    has items of."""
    at = "$" + "".join(f"['{k}']" for k in path)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.to_json(F.try_variant_get("_v", f"{at}['{f}']", "variant")).alias("label")) for f in fields])
    rows = examples.withColumn("_v", F.try_parse_json("label")).select("document", F.explode(each).alias("e")).select("e.field", "document", "e.label")
    return rows.where("label IS NOT NULL AND label LIKE '[_%' AND label <> '[]'")


def rewrite(prompt: str, provider: Provider, model: str, how: str = "Make this prompt clearer. Keep every placeholder in braces.") -> str:
    """A prompt rewritten by a model, without a fence around it; the old one if it fails or
    loses a placeholder."""
    try:
        new = provider.complete(model, f"{how}\n\n{prompt}").text.strip()
    except Exception:  # noqa: BLE001
        return prompt
    fence = re.fullmatch(r"```\w*\n(.*?)\n?```", new, re.S)
    new = fence[1] if fence else new
    holes = set(re.findall(r"\{\w+\}", prompt))
    return new if new and holes <= set(re.findall(r"\{\w+\}", new)) else prompt


def steps_of(prompt: str, provider: Provider, model: str) -> list[str]:
    """A prompt cut into steps by a model that answers with a JSON list; the prompt alone if not."""
    try:
        found = json.loads(provider.complete(model, f"Split this task into steps, as a JSON list of prompts; {{content}} stands for the text or the answer before.\n\n{prompt}").text)
    except Exception:  # noqa: BLE001
        return [prompt]
    return [str(x) for x in found] if isinstance(found, list) and found else [prompt]


def compare(whole: DataFrame, split: DataFrame) -> DataFrame:
    """``way, correct, accuracy, llm_cost, response_time`` of two scored runs over the same documents."""
    rows = whole.select(F.lit("whole").alias("way"), "is_correct", "llm_cost", "response_time").unionByName(split.select(F.lit("split").alias("way"), "is_correct", "llm_cost", "response_time"))
    return rows.groupBy("way").agg(F.count_if("is_correct").alias("correct"), (F.count_if("is_correct") / F.count("*")).alias("accuracy"), F.sum("llm_cost").alias("llm_cost"), F.sum("response_time").alias("response_time"))
