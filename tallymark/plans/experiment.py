"""An experiment: documents, labels and models to scored predictions, metrics and a report."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cost import effective_cost, time_unit_seconds
from ..functions.text import equal_score, format_text, input_hash
from ..operators import joins, metrics, reports
from ..operators.external import score_external
from ..operators.scoring import FieldConfig, JsonScorer, score_fields, score_json
from ..session import cut
from ..sources import writers
from . import decomposed, schemas
from .prompts import ModelSpec, check_labels, prepare
from .providers import Provider, predict

#: What is staged of each answer.
STAGED = ("document_id", "model", "hash", "predicted_value", "original_cost", "llm_cost", "response_time")


@dataclass
class Experiment:
    """Documents (``id, content``) and labels (``document_id, value``) by models.

    With ``staging``, a folder, answers are written there as they come and read back, keyed
    by a hash of content, prompt and parameters: no provider is asked twice for one input,
    whatever is done with the results, nor after a run that was cut off. Without it the
    answers are checkpointed, so that they are asked for once in this session.
    """

    spark: SparkSession
    documents: DataFrame
    labels: DataFrame
    prompt: str
    models: list[ModelSpec]
    provider: Provider
    config: FieldConfig | None = None
    metrics_by_name: dict = field(default_factory=dict)
    workers: int | None = None
    results: DataFrame | None = None
    staging: str | None = None
    schema: dict | None = None
    examples: list[tuple[str, str]] = field(default_factory=list)
    keep: Callable[[str, str], str] | None = None
    same: Callable[[str, str], bool] | None = None
    judge: Callable | None = None
    embed: Callable | None = None
    answers: DataFrame | None = None
    strategies: tuple[Callable[[str], str], ...] = ()

    def add_models(self, models: list[ModelSpec]) -> None:
        check_labels([*self.models, *models])
        self.models = [*self.models, *models]

    def _work(self) -> DataFrame:
        """``id, content, expected_value, model`` and how to ask, of each labelled document and model."""
        labels = schemas.wrap_labels(self.labels, self.schema)
        labels = joins.last_label(labels, "document_id", [F.desc("value")]).select(F.col("document_id").alias("id"), F.col("value").alias("expected_value"))
        docs = joins.labelled(self.documents.select("id", "content"), labels, "id")
        ways = {m.key: "split" if "decompose" in m.manipulations and decomposed.field_prompts(self.prompt, self.schema or {}) else "passes" if "multi_pass" in m.manipulations else "plain" for m in self.models}  # part of what was asked
        specs = [(i, m.key, m.name, prepare(self.prompt, m, self.examples, self.schema, self.strategies), m.cost_rate, time_unit_seconds(m.cost_rate_time_unit), json.dumps(m.params, sort_keys=True), ways[m.key], m.passes) for i, m in enumerate(self.models)]
        kinds = [("ordinal", "int"), ("model", "string"), ("model_name", "string"), ("template", "string"), ("rate", "double"), ("unit", "double"), ("params", "string"), ("way", "string"), ("passes", "int")]
        each = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(s, kinds)]) for s in specs])
        rows = docs.withColumn("_m", F.explode(each)).select("*", "_m.*").drop("_m").withColumn("prompt", format_text(F.col("template"), F.col("content")))
        asked = F.concat_ws("|", "model_name", "params", "way", "passes")
        return rows.withColumn("hash", input_hash(F.col("content"), F.col("template"), F.to_json(F.struct(asked.alias("asked")))))

    def _ask(self, todo: DataFrame) -> DataFrame:
        """Answers to work, each way of asking on its own."""
        # A filter behind a provider would not reach the rows before it, so those that are
        # treated differently are asked for apart.
        parts = []
        renamed = todo.withColumnRenamed("model", "key").withColumnRenamed("model_name", "model")
        columns = [*renamed.columns, "predicted_value", "llm_cost", "response_time"]
        plain: dict[bool, list[str]] = {}
        for m in self.models:
            mine, checked = renamed.where(F.col("key") == m.key), "hallucination_filter" in m.manipulations
            if "decompose" in m.manipulations and (prompts := decomposed.field_prompts(m.prompt or self.prompt, self.schema or {})):
                out = decomposed.extract(mine.drop("model", "prompt"), m.name, self.provider, self.schema, prompts, self.workers).withColumn("model", F.lit(m.name)).withColumn("prompt", F.lit(None).cast("string"))
            elif "multi_pass" in m.manipulations:
                out = decomposed.several_passes(mine, self.provider, m.passes, self.workers)
            else:
                plain.setdefault(checked, []).append(m.key)
                continue
            parts.append(decomposed.verified(out) if checked else out)
        for checked, keys in plain.items():
            out = predict(renamed.where(F.col("key").isin(keys)), self.provider, self.workers)
            parts.append(decomposed.verified(out) if checked else out)
        out = parts[0].select(*columns)
        for p in parts[1:]:
            out = out.unionByName(p.select(*columns))
        if self.keep:
            out = decomposed.filtered(out, self.keep)
        failed = F.col("predicted_value").startswith("ERROR:")
        cost = F.coalesce(F.col("rate") * F.col("response_time") / F.col("unit"), effective_cost(F.col("llm_cost"), F.col("model"), F.col("response_time")))
        priced = out.withColumn("original_cost", F.col("llm_cost")).withColumn("llm_cost", F.when(failed, 0.0).otherwise(cost))
        return priced.drop("model").withColumnRenamed("key", "model").withColumnRenamed("id", "document_id").select(*STAGED)

    def _staged(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.staging) if self.staging else None
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def remaining(self, work: DataFrame, staged: DataFrame | None) -> DataFrame:
        """Work without a valid answer of its model, document and input."""
        if staged is None:
            return work
        valid = joins.valid_staging(staged, work.select(F.col("id").alias("document_id"), "hash"), "document_id", "hash", [F.desc("written_at")])
        return work.join(valid.select(F.col("document_id").alias("id"), "model", "hash"), ["id", "model", "hash"], "left_anti")

    def evaluate(self, done: DataFrame | None = None) -> DataFrame:
        """Predictions of every labelled document by every model that ``done`` lacks, scored,
        together with ``done``."""
        check_labels(self.models)
        work = self._work()
        if done is not None:
            work = work.join(done.select(F.col("document_id").alias("id"), "model").distinct(), ["id", "model"], "left_anti")
        if self.staging:
            writers.append_staging(self._ask(self.remaining(work, self._staged())), self.staging)
            rows = self._staged()
            # Failed answers are asked for again by the next run; here they count as what they are.
            latest = joins.last_label(rows.withColumn("_k", F.concat_ws("|", "model", "document_id", "hash")), "_k", [F.col("predicted_value").startswith("ERROR:").asc(), F.desc("written_at")]).drop("_k")
        else:
            latest = cut(self._ask(work))
        answered = work.select(F.col("id").alias("document_id"), "model", "hash", "expected_value").join(latest.select(*STAGED), ["document_id", "model", "hash"])
        scored = self._score(answered).select("document_id", "model", "predicted_value", "expected_value", "is_correct", "example_score", "response_time", "original_cost", "llm_cost", "evaluation_cost")
        self.results = scored if done is None else done.select(*scored.columns).unionByName(scored)
        return self.results

    def _score(self, preds: DataFrame) -> DataFrame:
        if self.same:
            return by_function(preds, self.same)
        if self.config is not None and (self.judge or self.embed):
            keyed = preds.withColumn("_key", F.concat_ws("|", "model", "document_id"))
            scored, self.answers = score_external(keyed, "_key", "expected_value", "predicted_value", self.config, self.judge, self.embed, self.answers, self.metrics_by_name)
            return _root(scored.drop("_key"))
        return rescore(preds, self.config, self.metrics_by_name)

    def reevaluate(self, labels: DataFrame | None = None, config: FieldConfig | None = None) -> DataFrame:
        """Stored predictions scored again, without asking a model."""
        if self.results is None:
            raise ValueError("nothing to score: evaluate or load first")
        rows = self.results if labels is None else joins.relabel(self.results, labels, "document_id", "value")
        self.config = config or self.config
        self.results = self._score(rows).select(*self.results.columns)
        return self.results

    def in_order(self) -> DataFrame:
        """Metrics of the models in the order in which they were given."""
        order = F.create_map(*[x for i, m in enumerate(self.models) for x in (F.lit(m.key), F.lit(i))])
        return self.model_metrics().orderBy(F.try_element_at(order, F.col("model")).asc_nulls_last(), "model")

    def model_metrics(self) -> DataFrame:
        return metrics.model_metrics(self.results)

    def field_results(self) -> DataFrame | None:
        return None if self.config is None else field_results(self.results, self.config)

    def save(self, run_dir: str) -> None:
        """Predictions as a table, and the documents, prompts and configuration that ``restore`` needs."""
        docs = self.documents.join(self.labels.select(F.col("document_id").alias("id"), F.col("value").alias("label")), "id", "left")
        writers.write_run(self.results, docs, run_dir)
        body = {"prompt": self.prompt, "models": [vars(m) for m in self.models], "schema": self.schema, "config": _plain(self.config), "examples": self.examples}
        reports.write_text(self.spark, f"{run_dir}/experiment.json", json.dumps(body))

    def load(self, run_dir: str) -> DataFrame:
        self.results = self.spark.read.parquet(f"{run_dir}/predictions")
        return self.results

    @classmethod
    def restore(cls, spark: SparkSession, run_dir: str, provider: Provider | None = None) -> Experiment:
        """A saved experiment with its results; ``provider`` is needed to ask again only."""
        text = reports.read_text(spark, f"{run_dir}/experiment.json")
        if text is None:
            raise FileNotFoundError(f"no experiment in {run_dir}")
        body = json.loads(text)
        docs = spark.read.json(f"{run_dir}/metadata")
        out = cls(
            spark, docs.select("id", "content"), docs.where("label IS NOT NULL").select(F.col("id").alias("document_id"), F.col("label").alias("value")), body["prompt"],
            [ModelSpec(**m) for m in body["models"]], provider, _config(body["config"]), schema=body["schema"], examples=[tuple(x) for x in body["examples"]],
        )
        out.load(run_dir)
        return out

    def run(self, run_dir: str) -> DataFrame:
        """Evaluate, save, report. Models whose predictions are in the folder are not asked again;
        what was staged is dropped once it is saved."""
        self.staging = self.staging or f"{run_dir}/staging"
        writers.write_status(self.spark, run_dir, "evaluating")
        try:
            done = self.spark.read.parquet(f"{run_dir}/predictions")
            done = cut(done)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = None
        self.evaluate(done)
        self.save(run_dir)
        self.load(run_dir)
        writers.finalize_staging(self.spark, self.staging)
        total = self.labels.select("document_id").distinct().count()
        done_by = self.results.groupBy("model").agg(F.countDistinct("document_id").alias("docs_done")).withColumn("docs_total", F.lit(total)).withColumn("completed", F.col("docs_done") >= total)
        writers.write_status(self.spark, run_dir, models=done_by)
        write_report(self.results, f"{run_dir}/report.html", self.field_results())
        return self.model_metrics()


def _plain(config: FieldConfig | None):
    if config is None:
        return None
    return vars(config) | {"item": _plain(config.item), "fields": {k: _plain(v) for k, v in config.fields.items()}}


def _config(raw: dict | None) -> FieldConfig | None:
    if raw is None:
        return None
    return FieldConfig(**(raw | {"item": _config(raw["item"]), "fields": {k: _config(v) for k, v in raw["fields"].items()}}))


def _root(scored: DataFrame) -> DataFrame:
    root = F.element_at("result", 1)
    return scored.withColumns({"example_score": root["score"], "is_correct": root["is_correct"], "evaluation_cost": root["cost"]}).drop("result")


def rescore(preds: DataFrame, config: FieldConfig | None, metrics_by_name: dict | None = None) -> DataFrame:
    """New ``is_correct, example_score, evaluation_cost`` by the config, else by text equality. A
    pair that cannot be scored by the config falls back to text equality."""
    if config is None:
        score = F.coalesce(equal_score(F.col("predicted_value"), F.col("expected_value")), F.lit(0.0))
        return preds.withColumns({"example_score": score, "is_correct": score == 1.0, "evaluation_cost": F.lit(0.0)})
    return _root(score_json(preds, "expected_value", "predicted_value", JsonScorer(config, metrics_by_name)))


def rescore_or_keep(preds: DataFrame, config: FieldConfig, metrics_by_name: dict | None = None) -> DataFrame:
    """As ``rescore``, but a pair that the config cannot score keeps what was stored."""
    scored = score_json(preds, "expected_value", "predicted_value", JsonScorer(config, metrics_by_name))
    root = F.element_at("result", 1)
    ok = root["metric"] != "text"
    pick = lambda new, old: F.when(ok, new).otherwise(F.coalesce(F.col(old), new))
    return scored.withColumns({"example_score": pick(root["score"], "example_score"), "is_correct": pick(root["is_correct"], "is_correct"), "evaluation_cost": pick(root["cost"], "evaluation_cost")}).drop("result")


def by_function(preds: DataFrame, same: Callable[..., bool]) -> DataFrame:
    """``is_correct`` by ``same(predicted, expected)`` on the executors, in Arrow batches; a pair on
    which it fails is wrong."""
    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            try:
                return bool(same(x, y))
            except Exception:  # noqa: BLE001
                return False

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="bool")

    ok = run("predicted_value", "expected_value")
    return preds.withColumn("is_correct", ok).withColumns({"example_score": F.col("is_correct").cast("double"), "evaluation_cost": F.lit(0.0)})


def field_results(preds: DataFrame, config: FieldConfig) -> DataFrame:
    """Metrics of each model and field, objects re-derived from their fields."""
    parts = score_fields(preds, ["model"], "expected_value", "predicted_value", JsonScorer(config))
    return metrics.roll_up(metrics.sum_fields(parts, ["model"]), ["model"])


def recommend(table: DataFrame) -> DataFrame:
    """The most accurate model, the cheaper one of equals."""
    return table.orderBy(F.desc("accuracy"), F.asc_nulls_last("total_cost"), "model").limit(1)


def recommendation(table: DataFrame, provider: Provider | None = None, model: str = "") -> str:
    """Advice in words: a provider's, if there is one that answers, else a sentence on the most
    accurate model."""
    if provider is not None:
        try:
            return provider.complete(model, "Recommend one of these models in two sentences.\n" + "\n".join(reports.summary(table))).text
        except Exception:  # noqa: BLE001
            pass
    best = recommend(table).first()
    return "" if best is None else f"{best.model} is right most often ({100 * best.accuracy:.1f} %)" + (f" at a cost of {best.total_cost:.6f}." if best.total_cost is not None else ".")


def write_report(preds: DataFrame, path: str, fields: DataFrame | None = None) -> None:
    """One HTML page on any file system; only aggregates reach the driver."""
    table = metrics.model_metrics(preds)
    reports.write_text(preds.sparkSession, path, reports.page(preds, fields, recommendation(table)))
