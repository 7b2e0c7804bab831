"""Examples for prompts: generated from seeds, voted on by other models, the best injected."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import vote
from ..operators.metrics import vote_consensus
from ..operators.sampling import schedule, shuffle_key
from .prompts import length_range, parsed_examples, task_type
from .providers import Provider, predict


def seeds(labelled: DataFrame, n: int, order: str = "id") -> list[tuple[str, str]]:
    """The first ``n`` documents with a label, as (content, label)."""
    return [(r[0], r[1]) for r in labelled.where("content IS NOT NULL AND expected_value IS NOT NULL").orderBy(order).select("content", "expected_value").limit(n).collect()]


def generation_prompt(examples: list[tuple[str, str]], label: str | None, task: str = "") -> str:
    """One new example: of a given label, or, for extractions, with a label of the same shape."""
    low, high = length_range([d for d, _ in examples])
    shown = "\n\n".join(f"Document: {d}\nLabel: {l}" for d, l in examples)
    want = f"with the label {label}" if label is not None else f"with a label of the same shape as {shape(examples[0][1])}"
    about = f"Task: {task}\n\n" if task else ""
    return f"{about}Examples:\n\n{shown}\n\nWrite one new document {want}, {low} to {high} characters long, unlike those above. Answer in the form:\nDocument: ...\nLabel: ..."


def bulk_prompt(examples: list[tuple[str, str]], n: int, task: str = "") -> str:
    """``n`` new examples at once."""
    shown = "\n\n".join(f"Document: {d}\nLabel: {l}" for d, l in examples)
    about = f"Task: {task}\n\n" if task else ""
    return f"{about}Examples:\n\n{shown}\n\nWrite {n} new ones, each as\nDocument: ...\nLabel: ..."


def validation_prompt(document: str, label: str, task: str = "") -> str:
    about = f"Task: {task}\n\n" if task else ""
    return f"{about}Document: {document}\nLabel: {label}\n\nIs the label right? Answer 'correct' or 'incorrect' on the first line, then why."


def shape(label: str) -> str:
    """A JSON label with its values emptied; other labels as they are."""
    try:
        value = json.loads(label)
    except ValueError:
        return label

    def bare(v):
        return {k: bare(x) for k, x in v.items()} if isinstance(v, dict) else [bare(v[0])] if isinstance(v, list) and v else [] if isinstance(v, list) else ""

    return json.dumps(bare(value), ensure_ascii=False) if isinstance(value, (dict, list)) else label


def label_schedule(spark: SparkSession, labels: list[str], n: int, seed: int = 42) -> DataFrame:
    """``ordinal, label``: each label ``n`` div times, the remainder to the first, shuffled."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(schedule(labels, n))], "ordinal int, label string")
    return rows.orderBy(shuffle_key("ordinal", seed=seed))


def generate(spark: SparkSession, examples: list[tuple[str, str]], model: str, provider: Provider, n: int, task: str = "") -> DataFrame:
    """``example_id, document, label, cost`` of ``n`` requests: for classifications each label in
    turn, for extractions free. What cannot be read as an example is left out; an example
    without a label has the one asked for."""
    if not examples:
        raise ValueError("no seeds to generate from")
    free = task_type([l for _, l in examples]) == "extraction"
    labels = [None] * n if free else schedule(list(dict.fromkeys(l for _, l in examples)), n)
    rows = [(i, model, generation_prompt(examples, l, task), l) for i, l in enumerate(labels)]
    asked = spark.createDataFrame(rows, "request int, model string, prompt string, asked string")
    answered = predict(asked, provider).where(~F.col("predicted_value").startswith("ERROR:"))
    text = F.when(F.lower("predicted_value").contains("label:") | F.col("asked").isNull(), F.col("predicted_value")).otherwise(F.concat("predicted_value", F.lit("\nLabel: "), "asked"))
    found = parsed_examples(answered.select("request", text.alias("text"), F.col("llm_cost").alias("cost")))
    return found.where("document <> ''").select((F.col("request") * 1000 + F.col("ordinal")).cast("bigint").alias("example_id"), "document", "label", F.when(F.col("ordinal") == 0, F.col("cost")).otherwise(0.0).alias("cost"))


def validate(examples: DataFrame, models: list[str], provider: Provider, task: str = "") -> DataFrame:
    """``example_id, model, is_correct, cost, explanation``: a vote of each model on each example;
    a failed call votes incorrect and costs nothing."""
    about = F.lit(f"Task: {task}\n\n" if task else "")
    prompt = F.concat(about, F.lit("Document: "), "document", F.lit("\nLabel: "), "label", F.lit("\n\nIs the label right? Answer 'correct' or 'incorrect' on the first line, then why."))
    asked = examples.withColumn("model", F.explode(F.array(*map(F.lit, models)))).select("example_id", "model", prompt.alias("prompt"))
    voted = predict(asked, provider)
    failed = F.col("predicted_value").startswith("ERROR:")
    return voted.select("example_id", "model", (~failed & (vote(F.col("predicted_value")) == "correct")).alias("is_correct"), F.when(failed, 0.0).otherwise(F.col("llm_cost")).alias("cost"), F.trim(F.regexp_replace("predicted_value", r"^[^\n]*\n?", "")).alias("explanation"))


def chosen(examples: DataFrame, votes: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` examples that most of the validators call correct; all are good without any."""
    agreed = vote_consensus(votes, "example_id", "is_correct")
    return examples.join(agreed, "example_id", "left").where("consensus IS NULL OR consensus = 'correct'").orderBy("example_id").limit(k)


def costs(examples: DataFrame, votes: DataFrame) -> DataFrame:
    """``stage, model, cost``: of the generation, of each validator, and, where those are null,
    of all together."""
    rows = examples.select(F.lit("generation").alias("stage"), F.lit(None).cast("string").alias("model"), "cost").unionByName(votes.select(F.lit("validation").alias("stage"), "model", "cost"))
    return rows.groupingSets([["stage", "model"], []], "stage", "model").agg(F.sum("cost").alias("cost"))
