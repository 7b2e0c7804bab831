"""Aggregates over scored predictions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import f_score
from ..session import cut


def measured(c: str) -> Column:
    """The measure without what a failed clock leaves: NaN and negatives become null."""
    return F.when(F.isnan(c) | (F.col(c) < 0), None).otherwise(F.col(c))


def model_metrics(preds: DataFrame) -> DataFrame:
    """One row for each model: counts, accuracy, score, cost and time.

    A null ``is_correct`` counts as not correct; null and failed measures are left out
    of sums and means. No predictions give no rows.
    """
    rt, llm, ev, score = (measured(c) for c in ("response_time", "llm_cost", "evaluation_cost", "example_score"))
    return preds.groupBy("model").agg(
        F.count("*").alias("predictions"),
        F.count_if("is_correct").alias("correct"),
        (F.count_if("is_correct") / F.count("*")).alias("accuracy"),
        F.avg(score).alias("average_score"),
        F.sum(llm).alias("total_llm_cost"),
        F.sum(ev).alias("total_evaluation_cost"),
        (F.coalesce(F.sum(llm), F.lit(0.0)) + F.coalesce(F.sum(ev), F.lit(0.0))).alias("total_cost"),
        F.sum(rt).alias("total_time"),
        F.avg(rt).alias("average_time"),
        F.avg(llm).alias("average_cost"),
    )


def best_models(metrics: DataFrame) -> DataFrame:
    """The extremum of each measure and the first model, by name, that reaches it."""

    def best(c: str, largest: bool) -> Column:
        key = F.col(c) if largest else -F.col(c)
        return F.max(F.when(F.col(c).isNotNull(), F.struct(key.alias("k"), (-F.col("_o")).alias("o"), F.col("model"), F.col(c).alias("v"))))

    ranked = metrics.withColumn("_o", F.row_number().over(Window.orderBy("model")))
    plan = {"accuracy": True, "average_score": True, "total_cost": False, "average_time": False}
    one = ranked.agg(*[best(c, up).alias(c) for c, up in plan.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"{c}.model").alias("model"), F.col(f"{c}.v").alias("value")) for c in plan])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def nice_width(low: float, high: float, bins: int = 10) -> float:
    """1, 2, 5 or 10 times a power of ten, not below a ``bins``-th of the range."""
    raw = (high - low) / bins or 1.0
    power = 10.0 ** math.floor(math.log10(raw))
    return next(m * power for m in (1, 2, 5, 10) if m * power >= raw * (1 - 1e-12))


def histogram(preds: DataFrame, measure: str, bins: int = 10) -> DataFrame:
    """``model, bin, low, high, n`` over bins shared by all models; the last one is closed.

    Empty bins of a model are listed. Only the range of the measure reaches the driver.
    Without any value there are no rows.
    """
    clean = preds.select("model", measured(measure).alias("x")).where("x IS NOT NULL")
    span = clean.agg(F.min("x"), F.max("x")).first()
    if span[0] is None:
        return clean.select("model", F.lit(0).alias("bin"), "x", "x", F.lit(0).cast("bigint").alias("n")).toDF("model", "bin", "low", "high", "n").where("false")
    width = nice_width(span[0], span[1], bins)
    start = math.floor(span[0] / width + 1e-9) * width
    count = max(1, math.ceil((span[1] - start) / width - 1e-9))
    at = F.least(F.floor((F.col("x") - start) / width), F.lit(count - 1)).cast("int")
    counted = clean.groupBy("model", F.greatest(at, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
    every = clean.select("model").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return every.join(counted, ["model", "bin"], "left").select(
        "model", "bin", (F.lit(start) + F.col("bin") * width).alias("low"), (F.lit(start) + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n")
    )


def document_pivot(preds: DataFrame, models: list[str]) -> DataFrame:
    """A row for each document, a column for each of the given models: the predicted value."""
    return preds.groupBy("document_id").pivot("model", models).agg(F.max("predicted_value"))


def document_results(preds: DataFrame) -> DataFrame:
    """Per document, its expected value, number of models and how many are right."""
    return preds.groupBy("document_id").agg(
        F.min("expected_value").alias("expected_value"), F.countDistinct("model").alias("models"), F.count("*").alias("n"), F.count_if("is_correct").alias("correct")
    )


def vote_consensus(votes: DataFrame, example: str, is_correct: str) -> DataFrame:
    """'correct' or 'incorrect' by majority of the votes of an example, 'split' at a tie."""
    yes, no = F.count_if(F.col(is_correct)), F.count_if(~F.coalesce(F.col(is_correct), F.lit(False)))
    return votes.groupBy(example).agg(
        yes.alias("votes_correct"), no.alias("votes_incorrect"), F.when(yes > no, "correct").when(no > yes, "incorrect").otherwise("split").alias("consensus")
    )


def classification_report(pairs: DataFrame, expected: str = "expected", predicted: str = "predicted", by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class, from one pass over the confusion counts."""
    cells = pairs.groupBy(*by, expected, predicted).agg(F.count("*").alias("n"))
    both = F.array(
        F.struct(F.col(expected).alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"), F.when(F.col(expected) == F.col(predicted), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called"), F.lit(0).cast("bigint").alias("hit")),
    )
    sums = cells.select(*by, F.explode(both).alias("c")).where("c.label IS NOT NULL").groupBy(*by, F.col("c.label").alias("label")).agg(F.sum("c.support").alias("support"), F.sum("c.called").alias("called"), F.sum("c.hit").alias("hit"))
    p = F.when(F.col("called") > 0, F.col("hit") / F.col("called")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    return sums.select(*by, "label", p.alias("precision"), r.alias("recall"), f_score(p, r).alias("f1"), "support")


def scan_counts(hits: DataFrame, keys: list[str]) -> DataFrame:
    """``key, value, n``: counts by each key in one pass of grouping sets."""
    sets = hits.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    which = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, k in enumerate(keys):
        mine = F.col("g") == (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i))
        which, value = F.when(mine, k).otherwise(which), F.when(mine, F.col(k)).otherwise(value)
    return sets.select(which.alias("key"), value.alias("value"), "n")


def label_enum(labels: DataFrame, value: str, by: str, most: int = 50) -> DataFrame:
    """Sorted distinct non-blank labels of each group, null if there are more than ``most``.

    Distinct values are counted first, so a set of more than ``most`` is never gathered.
    """
    distinct = labels.where(F.length(F.trim(value)) > 0).select(by, value).distinct()
    ranked = distinct.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(value))).where(F.col("_n") <= most + 1)
    grouped = ranked.groupBy(by).agg(F.array_sort(F.collect_list(value)).alias("_v"))
    return grouped.select(by, F.when(F.size("_v") <= most, F.array_join("_v", "|")).alias("enum"))


def field_metrics(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Sums over the nodes of result trees (``path, score, weight, tp, fp, fn, precision,
    recall, metric, is_correct``): one row for each field, list positions and the root
    left out of its name. Leaves and lists have micro precision and recall, objects the
    mean of their nodes'."""
    field = F.regexp_replace(F.regexp_replace("path", r"\[\d+\]", ""), r"^root\.?", "")
    field = F.when(field == "", F.when(F.col("metric").startswith("list"), "[*]").otherwise("[root]")).otherwise(field)
    compared = ~F.col("metric").isin("missing_field", "unexpected_field", "optional_missing_both")
    one = nodes.select(
        *by, field.alias("field"), F.lit(1).cast("bigint").alias("n"), "score", "tp", "fp", "fn", "precision", "recall",
        F.when(F.col("weight") != 0, F.col("path")).alias("weight_at"), "weight", F.when(compared, F.concat(F.when(F.col("metric") == "text", "~").otherwise(""), "path")).alias("metric_at"), "metric",
    )
    return sum_fields(one, by)


def sum_fields(parts: DataFrame, by: list[str]) -> DataFrame:
    """The field metrics of partial sums, such as those of ``scoring.score_fields``."""
    s = parts.groupBy(*by, "field").agg(
        F.sum("n").alias("n"), F.sum("score").alias("score_sum"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        (F.sum("precision") / F.sum("n")).alias("_p"), (F.sum("recall") / F.sum("n")).alias("_r"), F.min(F.when(F.col("weight_at").isNotNull(), F.struct("weight_at", "weight")))["weight"].alias("weight"), F.min(F.when(F.col("metric_at").isNotNull(), F.struct("metric_at", "metric")))["metric"].alias("metric"),
    )
    macro = F.col("metric").startswith("agg:") | (F.col("metric") == "object")
    micro_p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    micro_r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    p, r = F.when(macro, F.coalesce("_p", F.lit(0.0))).otherwise(micro_p), F.when(macro, F.coalesce("_r", F.lit(0.0))).otherwise(micro_r)
    return s.select(*by, "field", "n", (F.col("score_sum") / F.col("n")).alias("score"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f_score(p, r).alias("f1"), "weight", "metric")


def roll_up(fields: DataFrame, by: list[str]) -> DataFrame:
    """Precision and recall of every object as the weighted mean of its direct children,
    deepest first; one join for each level of the deepest field. ``fields`` is written once:
    it has a row for each group and field, not for each node."""
    fields = cut(fields)
    depth = F.size(F.split("field", r"\."))
    out = fields.withColumn("_d", F.when(F.col("field").isin("[root]", "[*]"), 0).otherwise(depth))
    deepest = out.agg(F.max("_d")).first()[0] or 0
    for level in range(deepest - 1, -1, -1):
        parent = F.when(F.lit(level == 0), "[root]").otherwise(F.regexp_replace("field", r"\.[^.]*$", ""))
        child = out.where(F.col("_d") == level + 1).withColumn("field", parent)
        w = F.coalesce("weight", F.lit(1.0))
        mean = lambda c: F.sum(w * F.col(c)) / F.sum(w)
        up = child.groupBy(*by, "field").agg(mean("precision").alias("_cp"), mean("recall").alias("_cr"))
        is_object = F.col("metric").startswith("agg:") | (F.col("metric") == "object")
        pick = lambda new, old: F.when((F.col("_d") == level) & is_object & F.col(new).isNotNull(), F.col(new)).otherwise(F.col(old))
        out = out.join(up, [*by, "field"], "left").withColumn("precision", pick("_cp", "precision")).withColumn("recall", pick("_cr", "recall")).drop("_cp", "_cr")
    return out.withColumn("f1", f_score(F.col("precision"), F.col("recall"))).drop("_d")
