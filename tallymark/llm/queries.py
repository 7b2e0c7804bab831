"""Queries of the training-data operators over the whole tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .canon import free_values, unmatched
from .lookalike import lookalikes, same_form
from .names import class_pairs, mention_classes
from .packing import fill_report, instruction_sizes, pack, token_sizes
from .quantiles import day_and_model_percentiles, rank_checks
from .residue import clean_corpus, residue_ids
from .tokenizer import decode_ids, encode_texts


#: Use cases whose values are typed or answered freely.
FREE = ["city", "brand", "job_title"]


def _free_records(spark: SparkSession, d: str) -> DataFrame:
    labels, answers = table(spark, d, "labels"), table(spark, d, "predictions")
    return labels.where(F.col("use_case").isin(FREE)).select(
        F.lit("label").alias("record_kind"), F.col("label_id").alias("record_id"), F.col("use_case").alias("kind"), F.col("value").alias("text")
    ).unionByName(
        answers.where(F.col("use_case").isin(FREE)).select(
            F.lit("prediction").alias("record_kind"), F.col("prediction_id").alias("record_id"), F.col("use_case").alias("kind"), F.col("predicted_value").alias("text")
        )
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return free_values(_free_records(spark, d), table(spark, d, "canonical_values"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return unmatched(_free_records(spark, d), table(spark, d, "canonical_values"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = lookalikes(table(spark, d, "text_pairs"), ["pair_id"], "a", "b")
    answers = lookalikes(table(spark, d, "predictions"), ["prediction_id"], "predicted_value", "expected_value")
    return pairs.select(F.lit("text_pair").alias("record_kind"), F.col("pair_id").alias("record_id")).unionByName(
        answers.select(F.lit("prediction").alias("record_kind"), F.col("prediction_id").alias("record_id"))
    )


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "text_pairs").select("pair_id", "a", "b").distinct()
    return same_form(pairs, ["a", "b"]).select("pair_id", "a_form", "b_form")


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    columns = ["mention_id", "name", "zip", "city"]
    items = table(spark, d, "field_matching").select(F.explode(F.concat(*[F.coalesce(c, F.array()) for c in ("predicted_list", "expected_list")])).alias("m"))
    return table(spark, d, "institutions").select(*columns).unionByName(items.where("m IS NOT NULL").select(*[f"m.{c}" for c in columns]))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return class_pairs(mention_classes(_mentions(spark, d)))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return mention_classes(_mentions(spark, d))


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    measures = ["response_time", "llm_cost", "example_score"]
    return day_and_model_percentiles(table(spark, d, "predictions"), measures, {"response_time": -1.0})


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_sizes(table(spark, d, "documents")), table(spark, d, "prompt_windows"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p8_packing(spark, d), table(spark, d, "prompt_windows"))


def p8_instructions(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels as answers, under limits that bind: a segment for each 64
    tokens, a loss-bearing token for each 16."""
    answers = table(spark, d, "labels").select("label_id", F.substring_index("document_id", "-", -1).cast("bigint").alias("doc_id"), F.col("value").alias("answer")).distinct()
    windows = table(spark, d, "prompt_windows").select("window_id", "capacity_tokens", (F.col("capacity_tokens") / 64).cast("int").alias("capacity_segments"), (F.col("capacity_tokens") / 16).cast("int").alias("capacity_loss"))
    return pack(instruction_sizes(table(spark, d, "documents"), answers), windows)


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """For each window: documents listed, and whether no window is too full, no piece of a
    document is missing or doubled, and only documents above the capacity are cut."""
    packed = p8_packing(spark, d).join(table(spark, d, "prompt_windows").select("window_id", "capacity_tokens").distinct(), "window_id")
    full = packed.where("bin_id IS NOT NULL").groupBy("window_id", "bin_id").agg((F.sum("n_tokens") <= F.max("capacity_tokens")).alias("ok")).groupBy("window_id").agg(F.bool_and("ok").alias("within"))
    cap = F.max("capacity_tokens")
    docs = packed.groupBy("window_id", "doc_id").agg(((F.count("*") == 1) | (F.sum("n_tokens") > cap)).alias("u"), (F.sum("n_tokens") == F.max(F.col("start_token") + F.col("n_tokens"))).alias("w"))
    whole = docs.groupBy("window_id").agg(F.count("*").alias("documents"), F.bool_and("u").alias("uncut"), F.bool_and("w").alias("whole"))
    return whole.join(full, "window_id").select("window_id", "documents", "within", "uncut", "whole")


def p7_texts(spark: SparkSession, d: str) -> DataFrame:
    """Encoding undone; null texts come back as empty ones."""
    return decode_ids(encode_texts(table(spark, d, "documents")))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """For each model, measure and percentile: values, and whether the true rank of the answer
    is within the error shown and that within the bound."""
    measures = ["response_time", "llm_cost", "example_score"]
    return rank_checks(p6_percentiles(spark, d), table(spark, d, "predictions"), measures, {"response_time": -1.0})


def p1_cases(spark: SparkSession, d: str) -> DataFrame:
    """The records that have to be mapped."""
    return p1_found(spark, d).select("record_kind", "record_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue_ids(table(spark, d, "documents"))


def p9_corpus(spark: SparkSession, d: str) -> DataFrame:
    return clean_corpus(table(spark, d, "documents"))


_BLANK = "regexp_full_match(text, '[\\s\\x0B\\x1C-\\x1F\\x85\\pZ]*')"
_MEASURES = "response_time llm_cost example_score".split()
QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p1_cases, p3_found, p3_forms, p5_found, p5_classes, p6_percentiles, p6_checks, p7_ids, p7_texts, p8_packing, p8_instructions, p8_fill, p8_checks, p9_found, p9_corpus)}
SQL: dict[str, str] = {
    "p1_cases": f"""WITH r AS (SELECT 'label' AS record_kind, label_id AS record_id, use_case AS kind, value AS text FROM labels
      UNION ALL SELECT 'prediction', prediction_id, use_case, predicted_value FROM predictions)
    SELECT DISTINCT record_kind, record_id FROM r WHERE kind IN ('city', 'brand', 'job_title') AND text IS NOT NULL AND NOT {_BLANK}
      AND NOT EXISTS (SELECT 1 FROM canonical_values c WHERE c.kind = r.kind AND c.value = r.text)""",
    "p6_checks": "WITH p AS (SELECT DISTINCT prediction_id, model, response_time, llm_cost, example_score FROM predictions), v AS ("
    + " UNION ALL ".join(f"SELECT model, '{m}' AS measure, {m} AS x FROM p" for m in _MEASURES)
    + """) SELECT model, measure, p.p, count(*) AS n, true AS within FROM v, (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.95, 0.99])::DOUBLE AS p) p
    WHERE x IS NOT NULL AND NOT isnan(x) AND NOT (measure = 'response_time' AND x = -1) GROUP BY ALL""",
    "p7_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_checks": "SELECT window_id, (SELECT count(*) FROM documents) AS documents, true AS within, true AS uncut, true AS whole FROM prompt_windows",
}
