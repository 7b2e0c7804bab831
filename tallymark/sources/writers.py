"""Experiments to disk: predictions by model, metadata once, staging appended."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import model_metrics
from ..operators.reports import read_text, write_text


def write_predictions(preds: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One directory for each model; models written again are replaced, others stay."""
    preds.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").format(fmt).save(path)


def write_metadata(meta: DataFrame, path: str) -> None:
    """Only if there is none yet."""
    meta.write.mode("ignore").json(path)


def write_run(preds: DataFrame, docs: DataFrame, run_dir: str) -> None:
    write_metadata(docs, f"{run_dir}/metadata")
    write_predictions(preds, f"{run_dir}/predictions")


def model_rows(preds: DataFrame, models: DataFrame) -> DataFrame:
    """One row for each model, as its JSON file holds it: the columns of ``models`` (``model,
    run_id, prompt_template, llm_config, status, ...``), its metrics, and its predictions.

    For interchange: a model's predictions are gathered into one row. Tables of any size
    are written by ``write_predictions``.
    """
    rest = [c for c in preds.columns if c != "model"]
    gathered = preds.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("document_id", *[c for c in rest if c != "document_id"]))).alias("predictions"))
    measured = model_metrics(preds).select("model", F.struct("*").alias("metrics"))
    return models.join(measured, "model").join(gathered, "model")


def write_model_files(preds: DataFrame, models: DataFrame, run_dir: str) -> None:
    """``run_dir/models/<label>.json`` for each model of ``models``, ``/`` in a name replaced;
    rows stream to the driver one model at a time."""
    spark = preds.sparkSession
    for row in model_rows(preds, models).select("model", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
        write_text(spark, f"{run_dir}/models/{row.model.replace('/', '_')}.json", row.j)


def write_metadata_file(spark: SparkSession, run_dir: str, docs: DataFrame, use_case: str, prompt: str, field_config: dict | None = None, schema: dict | None = None, costs: DataFrame | None = None) -> bool:
    """``run_dir/metadata.json`` with the documents (``id, content, label``), prompt, scoring
    config, response schema and the cost of each model; False, and nothing written, if
    there is one. The documents of a run stream to the driver."""
    if read_text(spark, f"{run_dir}/metadata.json") is not None:
        return False
    cost = {r.model: {"llm_cost": r.llm_cost, "evaluation_cost": r.evaluation_cost} for r in costs.where("model IS NOT NULL").collect()} if costs is not None else {}
    head: dict[str, Any] = {"use_case": use_case, "original_prompt": prompt, "field_metrics_config": field_config, "response_format_schema": schema, "cost": cost, "total_cost": sum((v["llm_cost"] or 0) + (v["evaluation_cost"] or 0) for v in cost.values())}
    rows = [r.j for r in docs.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()]
    write_text(spark, f"{run_dir}/metadata.json", json.dumps(head)[:-1] + ', "documents": [' + ", ".join(rows) + "]}")
    return True


def add_result(preds: DataFrame, models: DataFrame, run_dir: str, use_case: str, prompt: str) -> None:
    """A single model's result into a run: its file, and metadata from its own documents if
    there are none yet. ``preds`` has ``content`` beside the usual columns."""
    docs = preds.select(F.col("document_id").alias("id"), "content", F.col("expected_value").alias("label")).dropDuplicates(["id"])
    write_metadata_file(preds.sparkSession, run_dir, docs, use_case, prompt)
    write_model_files(preds.drop("content"), models, run_dir)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_staging(rows: DataFrame, path: str) -> None:
    """Append results as they come, a file for each task: no lock is needed."""
    rows.withColumn("written_at", F.current_timestamp()).write.mode("append").partitionBy("model").parquet(path)


def finalize_staging(spark: SparkSession, path: str, model: str | None = None) -> None:
    """Drop what is staged for a model, or for all, once its result is written."""
    jvm = spark.sparkContext._jvm
    name = path if model is None else f"{path}/model={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(model)}"
    at = jvm.org.apache.hadoop.fs.Path(name)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_status(spark: SparkSession, run_dir: str, message: str | None = None, models: DataFrame | None = None) -> None:
    """``run_dir/progress.json``: a message before the evaluation, or the progress of each model
    (``model, docs_done, docs_total, completed``); the start is kept from the file before."""
    now = spark.range(1).select(F.date_format(F.to_utc_timestamp(F.current_timestamp(), spark.conf.get("spark.sql.session.timeZone")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).first()[0]
    try:
        started = json.loads(read_text(spark, f"{run_dir}/progress.json") or "{}").get("started_at") or now
    except ValueError:
        started = now
    body: dict[str, Any] = {"started_at": started, "last_update": now}
    if models is None:
        body["status_message"] = message
    else:
        body["models"] = [{"name": r.model, "docs_done": r.docs_done, "docs_total": r.docs_total, "completed": r.completed} for r in models.orderBy("model").collect()]
    write_text(spark, f"{run_dir}/progress.json", json.dumps(body))


def write_scan(hits: DataFrame, path: str) -> None:
    """A code scan as JSON: ``summary`` with the counts by each property, ``instances``."""
    from ..operators.metrics import scan_counts

    write_json(scan_counts(hits, ["provider", "library", "call_type", "file"]), f"{path}/summary")
    write_json(hits, f"{path}/instances")


def run_costs(preds: DataFrame) -> DataFrame:
    """Cost of each model and, under a null model, of the run."""
    return preds.rollup("model").agg(F.sum("llm_cost").alias("llm_cost"), F.sum("evaluation_cost").alias("evaluation_cost"))
