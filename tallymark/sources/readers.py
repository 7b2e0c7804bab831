"""Documents, labels and results from JSON and CSV files, and experiments on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import equal_score

_DOC = "id string, content string, label string, value string, document_id string, metadata map<string,string>, attachments array<string>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file with an array of objects or with one object; containers in text fields are JSON
    text. Files that are no JSON and rows of nulls only give none."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.na.drop("all")


def json_lines(spark: SparkSession, path: str, schema: str = _DOC) -> DataFrame:
    """One object a line, which splits to any number of tasks; broken lines are left out."""
    return spark.read.schema(schema).json(path).na.drop("all")


def _rest(df: DataFrame, used: set[str]) -> Column:
    """The other columns that are not empty, as a map."""
    others = [c for c in df.columns if c not in used]
    if not others:
        return F.create_map().cast("map<string,string>")
    full = F.create_map(*[x for c in others for x in (F.lit(c), F.col(f"`{c}`"))])
    return F.map_filter(full, lambda _, v: v.isNotNull() & (v != ""))


def documents_json(spark: SparkSession, path: str) -> DataFrame:
    """``id, content, metadata``; attachments are not kept."""
    return _json(spark, path, _DOC).select("id", "content", "metadata")


def documents_csv(spark: SparkSession, path: str, id_column: str = "id", content_column: str = "content") -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.select(F.col(id_column).alias("id"), F.col(content_column).alias("content"), _rest(df, {id_column, content_column}).alias("metadata"))


def labels_json(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, _DOC).select("document_id", "value", "metadata")


def labels_csv(spark: SparkSession, path: str, document_id_column: str = "document_id", value_column: str = "label") -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.select(F.col(document_id_column).alias("document_id"), F.col(value_column).alias("value"), _rest(df, {document_id_column, value_column}).alias("metadata"))


def combined_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents with attachments, and their labels."""
    df = _json(spark, path, _DOC)
    return df.select("id", "content", "metadata", "attachments"), df.where("label IS NOT NULL").select(F.col("id").alias("document_id"), F.col("label").alias("value"))


def combined_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    docs = df.select("id", "content", _rest(df, {"id", "content", "label"}).alias("metadata"))
    return docs, df.where("label IS NOT NULL").select(F.col("id").alias("document_id"), F.col("label").alias("value"))


def in_memory(spark: SparkSession, rows: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Documents and labels from dicts of ``id?, content, label?``; a missing id is doc_<index>."""
    import json

    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, sort_keys=True)
    flat = [(str(r.get("id") if r.get("id") is not None else f"doc_{i}"), i, text(r.get("content")), text(r.get("label"))) for i, r in enumerate(rows)]
    df = spark.createDataFrame(flat, "id string, ordinal bigint, content string, label string")
    return df.select("id", "ordinal", "content"), df.where("label IS NOT NULL").select(F.col("id").alias("document_id"), F.col("label").alias("value"))


_PREDICTION = "document_id: string, predicted_value: string, expected_value: string, is_correct: boolean, example_score: double, response_time: double, original_cost: double, llm_cost: double, evaluation_cost: double, field_metrics: string"
_MODEL_FILE = f"run_id string, model string, label string, started_at string, completed_at string, status string, prompt_template string, llm_config string, predictions array<struct<{_PREDICTION}>>, results array<struct<run_id: string, model: string, status: string, predictions: array<struct<{_PREDICTION}>>>>"


def model_files(spark: SparkSession, run_dir: str) -> DataFrame:
    """One row for each prediction of ``run_dir/models/*.json``; unreadable files give none.

    A missing ``example_score`` is 1 or 0 by ``is_correct``; a label equal to the model's
    name is no label.
    """
    df = _json(spark, f"{run_dir}/models/*.json", _MODEL_FILE).withColumn("label", F.nullif("label", "model"))
    rows = df.select("run_id", "model", "label", "status", "prompt_template", F.explode("predictions").alias("p"))
    return rows.select("run_id", "model", "label", "status", "prompt_template", "p.*").withColumn(
        "example_score", F.coalesce("example_score", F.col("is_correct").cast("double"))
    )


def legacy_results(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of one file that holds all results."""
    rows = _json(spark, path, _MODEL_FILE).select(F.explode("results").alias("r")).select("r.run_id", "r.model", "r.status", F.explode("r.predictions").alias("p"))
    return rows.select("run_id", "model", "status", "p.*").withColumn("example_score", F.coalesce("example_score", F.col("is_correct").cast("double")))


def run_metadata(spark: SparkSession, run_dir: str) -> DataFrame:
    """``use_case, original_prompt, field_config, id, content, label`` of each document."""
    schema = "use_case string, original_prompt string, field_metrics_config string, field_config string, documents array<struct<id: string, content: string, label: string, attachments: array<string>>>"
    df = _json(spark, f"{run_dir}/metadata.json", schema)
    return df.select(
        F.coalesce("use_case", F.lit("evaluation")).alias("use_case"), F.coalesce("original_prompt", F.lit("{content}")).alias("original_prompt"),
        F.coalesce("field_metrics_config", "field_config").alias("field_config"), F.explode_outer("documents").alias("d"),
    ).select("use_case", "original_prompt", "field_config", "d.*")


def completed_models(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'completed'").select("model").distinct()


def result_dir(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of a folder of result files, of either form: a result with its predictions,
    or a list of simplified rows (``id, content, label, predicted_label, ...``), whose model
    and run are told by the file's name up to and after its last underscore.

    Missing costs and times are 0; a simplified row is correct if it says so or its texts
    are equal apart from case and outer space. Files that cannot be read give no rows.
    """
    files = spark.read.text(path.rstrip("/") + "/*.json", wholetext=True).select("value", F.input_file_name().alias("_f"))
    stem = F.regexp_replace(F.url_decode(F.substring_index("_f", "/", -1)), r"\.json$", "")
    parsed = files.select("value", stem.alias("_s"), F.schema_of_variant(F.try_parse_json("value")).alias("_k"))
    whole = parsed.where("_k LIKE 'OBJECT%'").select(F.from_json("value", _MODEL_FILE).alias("r")).select("r.run_id", "r.model", "r.status", F.explode("r.predictions").alias("p"))
    whole = whole.select("run_id", "model", "status", "p.*").withColumn("example_score", F.coalesce("example_score", F.col("is_correct").cast("double"))).withColumn("content", F.lit(None).cast("string"))
    simple = "array<struct<id: string, content: string, label: string, predicted_label: string, is_correct: boolean, response_time: double, llm_cost: double, cost: double, original_cost: double, evaluation_cost: double, example_score: double, field_metrics: string>>"
    named = F.col("_s").contains("_")
    head, tail = F.regexp_extract("_s", "^(.*)_[^_]*$", 1), F.substring_index("_s", "_", -1)
    rows = parsed.where("_k LIKE 'ARRAY%'").select(F.when(named, tail).otherwise(F.col("_s")).alias("run_id"), F.when(named, head).otherwise(F.col("_s")).alias("model"), F.explode(F.from_json("value", simple)).alias("p"))
    correct = F.coalesce(F.col("p.is_correct"), F.lit(False)) | F.coalesce(equal_score(F.coalesce("p.predicted_label", F.lit("")), F.coalesce("p.label", F.lit(""))) == 1.0, F.lit(False))
    zero = F.lit(0.0)
    simple_rows = rows.select(
        "run_id", "model", F.lit("completed").alias("status"), F.col("p.id").alias("document_id"), F.col("p.predicted_label").alias("predicted_value"), F.col("p.label").alias("expected_value"), correct.alias("is_correct"),
        F.coalesce("p.example_score", correct.cast("double")).alias("example_score"), F.coalesce("p.response_time", zero).alias("response_time"), F.col("p.original_cost").alias("original_cost"),
        F.coalesce("p.llm_cost", "p.cost", zero).alias("llm_cost"), F.coalesce("p.evaluation_cost", zero).alias("evaluation_cost"), F.col("p.field_metrics").alias("field_metrics"), F.col("p.content").alias("content"),
    )
    return whole.select(*simple_rows.columns).unionByName(simple_rows)


def is_legacy(spark: SparkSession, path: str) -> bool:
    """A single file, or a folder without metadata."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    return fs.getFileStatus(at).isFile() or not any(fs.exists(jvm.org.apache.hadoop.fs.Path(path, n)) for n in ("metadata.json", "metadata"))


def any_results(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of a run or of legacy results, in a folder or a file."""
    if not is_legacy(spark, path):
        return run_predictions(spark, path)
    if path.endswith(".json"):
        return legacy_results(spark, path)
    return result_dir(spark, path)


def run_predictions(spark: SparkSession, run_dir: str) -> DataFrame:
    """Predictions of a run joined to their documents: ``content``, and the document's label
    where a prediction has no expected value. Missing costs and times are 0."""
    preds = model_files(spark, run_dir)
    docs = run_metadata(spark, run_dir).select(F.col("id").alias("document_id"), "content", F.col("label").alias("_l"))
    joined = preds.join(docs.dropDuplicates(["document_id"]), "document_id", "left").withColumn("expected_value", F.coalesce("expected_value", "_l")).drop("_l")
    return joined.fillna(0.0, ["response_time", "llm_cost", "evaluation_cost"])


def first_documents(preds: DataFrame) -> DataFrame:
    """``document_id, content, expected_value``: the documents of legacy results, each as first
    seen by model and run."""
    content = F.col("content") if "content" in preds.columns else F.lit(None).cast("string")
    order = F.struct("model", "run_id")
    seen = preds.select("document_id", "model", "run_id", content.alias("content"), "expected_value")
    return seen.groupBy("document_id").agg(F.min_by(F.struct("content", "expected_value"), order).alias("f")).select("document_id", "f.content", "f.expected_value")


def code_files(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """``file, text`` of every .py file below ``root`` whose path matches none of ``exclude`` (regex)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", True).load(root)
    for pattern in exclude or []:
        files = files.where(~F.col("path").rlike(pattern))
    return files.select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))
