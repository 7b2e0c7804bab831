"""Queries of the core operators over the whole tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cost, similarity, text
from .operators import drift, extraction, joins, metrics, nested, sampling
from .operators.scoring import FieldConfig, JsonScorer, infer_config, score_columns, score_fields, score_json
from .plans import providers
from .session import table
from .streaming.progress import progress

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Columns of a prediction that are the same each time it is received.
FACTS = [
    "prediction_id", "run_id", "document_id", "use_case", "predicted_value", "expected_value", "is_correct", "example_score",
    "response_time", "original_cost", "llm_cost", "evaluation_cost", "model",
]


def predictions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each prediction once, with the given columns; long texts are no keys of the shuffle."""
    rows = table(spark, d, "predictions").select("prediction_id", *[c for c in columns or FACTS if c != "prediction_id"])
    return rows.dropDuplicates(["prediction_id"]) if {"predicted_value", "expected_value"} & set(rows.columns) else rows.distinct()


def _p(*columns: str) -> str:
    return f"(SELECT DISTINCT prediction_id, {', '.join(columns)} FROM predictions)"


def _clean(c: str) -> str:
    return f"CASE WHEN isnan({c}) OR {c} < 0 THEN NULL ELSE {c} END"


def _rounded(df: DataFrame, places: int = 6, nudge: float = 0.0) -> DataFrame:
    """With rounded doubles; ``nudge`` takes sums, whose last bits depend on their order, off the halves."""
    return df.select(*[F.round(F.col(c) + F.lit(nudge), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_METRICS = f"""
SELECT model, count(*) AS predictions, count(*) FILTER (WHERE is_correct) AS correct,
  round(count(*) FILTER (WHERE is_correct) / count(*) + 1e-10, 6) AS accuracy, round(avg(s) + 1e-10, 6) AS average_score,
  round(sum(l) + 1e-10, 6) AS total_llm_cost, round(sum(e) + 1e-10, 6) AS total_evaluation_cost,
  round(coalesce(sum(l), 0) + coalesce(sum(e), 0) + 1e-10, 6) AS total_cost,
  round(sum(t) + 1e-10, 6) AS total_time, round(avg(t) + 1e-10, 6) AS average_time, round(avg(l) + 1e-10, 6) AS average_cost
FROM (SELECT model, is_correct, {_clean('example_score')} AS s, {_clean('llm_cost')} AS l, {_clean('evaluation_cost')} AS e, {_clean('response_time')} AS t
  FROM {_p('model', 'is_correct', 'example_score', 'llm_cost', 'evaluation_cost', 'response_time')})
GROUP BY model"""


@query(_METRICS)
def model_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.model_metrics(predictions(spark, d, "model", "is_correct", "example_score", "llm_cost", "evaluation_cost", "response_time")), nudge=1e-10)


@query(f"""
WITH m AS ({_METRICS}), o AS (SELECT *, row_number() OVER (ORDER BY model NULLS FIRST) AS o FROM m)
SELECT 'accuracy' AS measure, model, value FROM (SELECT model, accuracy AS value FROM o WHERE accuracy IS NOT NULL ORDER BY accuracy DESC, o LIMIT 1)
UNION ALL SELECT 'average_score', model, value FROM (SELECT model, average_score AS value FROM o WHERE average_score IS NOT NULL ORDER BY average_score DESC, o LIMIT 1)
UNION ALL SELECT 'total_cost', model, value FROM (SELECT model, total_cost AS value FROM o WHERE total_cost IS NOT NULL ORDER BY total_cost, o LIMIT 1)
UNION ALL SELECT 'average_time', model, value FROM (SELECT model, average_time AS value FROM o WHERE average_time IS NOT NULL ORDER BY average_time, o LIMIT 1)""")
def best_models(spark: SparkSession, d: str) -> DataFrame:
    return metrics.best_models(model_metrics(spark, d))


# White space of any kind, for SQL's trim.
_WS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _strip(c: str) -> str:
    return f"trim({c}, '{_WS}')"


_LABEL = "(SELECT * FROM (SELECT DISTINCT ON (label_id) * FROM labels) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY labelled_at DESC, label_id DESC) = 1)"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "labels").select("label_id", "document_id", "value", "use_case", "annotator", "labelled_at").distinct()
    return joins.last_label(once, "document_id", [F.desc("labelled_at"), F.desc("label_id")])


@query(f"""SELECT d.doc_id, d.use_case, l.value AS label, d.n_chars FROM documents d JOIN {_LABEL} l ON l.document_id = 'doc-' || d.doc_id""")
def labelled_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "use_case", "n_chars", F.concat(F.lit("doc-"), "doc_id").alias("document_id"))
    labels = _labels(spark, d).select("document_id", F.col("value").alias("label"))
    return joins.labelled(docs, labels, "document_id").select("doc_id", "use_case", "label", "n_chars")


@query(f"""SELECT prediction_id, (lower({_strip('predicted_value')}) = lower({_strip('expected_value')}))::DOUBLE AS score
FROM {_p('predicted_value', 'expected_value', 'use_case')} WHERE use_case IN ('topic', 'sentiment')""")
def equality_scores(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d, "predicted_value", "expected_value", "use_case").where("use_case IN ('topic', 'sentiment')")
    return p.select("prediction_id", text.equal_score(F.col("predicted_value"), F.col("expected_value")).alias("score"))


_RATE = "CASE WHEN contains(lower(model), 'llama') THEN CASE WHEN TRY_CAST(regexp_extract(lower(model), '(\\d+(?:\\.\\d+)?)\\s*b\\b', 1) AS DOUBLE) <= 8 THEN 1.006 WHEN TRY_CAST(regexp_extract(lower(model), '(\\d+(?:\\.\\d+)?)\\s*b\\b', 1) AS DOUBLE) <= 30 THEN 1.212 ELSE 16.288 END ELSE 1.212 END"


@query(f"""SELECT prediction_id, round(CASE WHEN llm_cost = 0 THEN {_RATE} * t / 3600 ELSE llm_cost END, 9) AS cost, round(2.5 * t / 1800, 9) AS cost_at_rate
FROM (SELECT prediction_id, model, llm_cost, {_clean('response_time')} AS t FROM (SELECT prediction_id, model, response_time, {_clean('llm_cost')} AS llm_cost FROM {_p('model', 'llm_cost', 'response_time')}))""")
def effective_costs(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d, "model", "llm_cost", "response_time").withColumn("t", metrics.measured("response_time")).withColumn("llm_cost", metrics.measured("llm_cost"))
    own = cost.effective_cost(F.col("llm_cost"), F.col("model"), F.col("t"))
    rated = cost.effective_cost(F.lit(None).cast("double"), F.col("model"), F.col("t"), F.lit(2.5), cost.time_unit_seconds("30 min"))
    return p.select("prediction_id", F.round(own, 9).alias("cost"), F.round(rated, 9).alias("cost_at_rate"))


@query(f"""SELECT model, count(*) AS n, round(sum(new_cost), 6) AS cost FROM (
SELECT model, CASE WHEN bool_and(coalesce(llm_cost = 0, true)) OVER (PARTITION BY model) THEN {_RATE} * t / 3600 ELSE llm_cost END AS new_cost
FROM (SELECT model, {_clean('llm_cost')} AS llm_cost, {_clean('response_time')} AS t FROM {_p('model', 'llm_cost', 'response_time')})) GROUP BY model""")
def reapplied_rates(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d, "model", "llm_cost", "response_time").withColumn("t", metrics.measured("response_time")).withColumn("llm_cost", metrics.measured("llm_cost"))
    return joins.reapply_rates(p, cost.imputed_cost(F.col("model"), F.col("t"))).groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("new_cost"), 6).alias("cost"))


@query("""SELECT name, litellm_provider, round((1000 * input_cost_per_token + 200 * output_cost_per_token) * 1000000, 6) AS cost FROM model_catalog
WHERE mode = 'chat' AND input_cost_per_token IS NOT NULL AND output_cost_per_token IS NOT NULL
AND regexp_matches(litellm_provider || '/' || name, '[a-m]') AND NOT regexp_matches(litellm_provider || '/' || name, 'petit')""")
def usable_models(spark: SparkSession, d: str) -> DataFrame:
    priced = cost.token_cost(F.lit(1000), F.lit(200), F.col("input_cost_per_token"), F.col("output_cost_per_token"))
    return sampling.usable_models(table(spark, d, "model_catalog"), "[a-m]", "petit").select("name", "litellm_provider", F.round(priced * 1000000, 6).alias("cost"))


_PRICED = "(SELECT name, 1000 * input_cost_per_token + 200 * output_cost_per_token AS cost FROM model_catalog WHERE mode = 'chat' AND input_cost_per_token IS NOT NULL AND output_cost_per_token IS NOT NULL)"


@query(f"""
WITH p AS {_PRICED}, cur AS (SELECT name, cost FROM p ORDER BY cost DESC, name LIMIT 1), lo AS (SELECT min(cost) AS low FROM p),
t AS (SELECT i, low + (cur.cost - low) * i / 4 AS target FROM lo, cur, range(5) r(i)),
b AS (SELECT i, name, cost, row_number() OVER (PARTITION BY i ORDER BY abs(cost - target), cost, name) AS r FROM p, t WHERE i < 4)
SELECT name, round(cost * 1000000, 6) AS cost, min(i)::INT AS rank FROM (SELECT i, name, cost FROM b WHERE r = 1 UNION ALL SELECT 4, name, cost FROM cur) GROUP BY name, cost""")
def cost_spread(spark: SparkSession, d: str) -> DataFrame:
    priced = sampling.usable_models(table(spark, d, "model_catalog")).select("name", cost.token_cost(F.lit(1000), F.lit(200), F.col("input_cost_per_token"), F.col("output_cost_per_token")).alias("cost"))
    top = priced.orderBy(F.desc("cost"), "name").first()
    return sampling.cost_spread(priced, top.name, 5).withColumn("cost", F.round(F.col("cost") * 1000000, 6))


@query(f"""
WITH v AS (SELECT model, {_clean('response_time')} AS x FROM {_p('model', 'response_time')}), c AS (SELECT * FROM v WHERE x IS NOT NULL),
s AS (SELECT min(x) AS lo, max(x) AS hi, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / 10 ELSE 1 END AS raw FROM c),
w AS (SELECT lo, hi, (SELECT min(m * pow(10, floor(log10(raw)))) FROM (SELECT unnest([1, 2, 5, 10]) AS m) WHERE m * pow(10, floor(log10(raw))) >= raw * (1 - 1e-12)) AS width FROM s),
e AS (SELECT width, floor(lo / width + 1e-9) * width AS start, greatest(1, ceil((hi - floor(lo / width + 1e-9) * width) / width - 1e-9))::BIGINT AS bins FROM w)
SELECT m.model, b.bin::INT AS bin, round(start + b.bin * width, 6) AS low, round(start + (b.bin + 1) * width, 6) AS high, coalesce(n, 0) AS n
FROM (SELECT DISTINCT model FROM c) m CROSS JOIN e CROSS JOIN LATERAL (SELECT unnest(range(bins)) AS bin) b
LEFT JOIN (SELECT model, greatest(least(floor((x - start) / width), bins - 1), 0)::BIGINT AS bin, count(*) AS n FROM c, e GROUP BY ALL) k ON k.model IS NOT DISTINCT FROM m.model AND k.bin = b.bin""")
def response_time_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.histogram(predictions(spark, d, "model", "response_time"), "response_time"))


@query(f"""
WITH v AS (SELECT model, {_clean('example_score')} AS x FROM {_p('model', 'example_score')})
SELECT m.model, b.bin::INT AS bin, round(b.bin * 0.1, 6) AS low, round((b.bin + 1) * 0.1, 6) AS high, coalesce(n, 0) AS n
FROM (SELECT DISTINCT model FROM v WHERE x IS NOT NULL) m CROSS JOIN range(10) b(bin)
LEFT JOIN (SELECT model, greatest(least(floor(x / 0.1), 9), 0) AS bin, count(*) AS n FROM v WHERE x IS NOT NULL GROUP BY ALL) c ON c.model = m.model AND c.bin = b.bin""")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.histogram(predictions(spark, d, "model", "example_score"), "example_score"))


@query(f"""
WITH top AS (SELECT name FROM model_catalog ORDER BY name LIMIT 6), m AS (SELECT name, row_number() OVER (ORDER BY name) AS i FROM top)
SELECT document_id, {', '.join(f"max(predicted_value) FILTER (WHERE i = {i}) AS value_{i}" for i in range(1, 7))}
FROM {_p('document_id', 'model', 'predicted_value')} LEFT JOIN m ON m.name = model GROUP BY document_id""")
def report_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the first six models of the catalogue; columns are numbered, as names vary."""
    models = [r.name for r in table(spark, d, "model_catalog").select("name").orderBy("name").limit(6).collect()]
    wide = metrics.document_pivot(predictions(spark, d, "document_id", "model", "predicted_value"), models)
    return wide.toDF("document_id", *[f"value_{i + 1}" for i in range(len(models))])


@query(f"""SELECT document_id, min(expected_value) AS expected_value, count(DISTINCT model) AS models, count(*) AS n, count(*) FILTER (WHERE is_correct) AS correct
FROM {_p('document_id', 'expected_value', 'model', 'is_correct')} GROUP BY document_id""")
def document_results(spark: SparkSession, d: str) -> DataFrame:
    return metrics.document_results(predictions(spark, d, "document_id", "expected_value", "model", "is_correct"))


@query(f"""SELECT document_id, votes_correct, votes_incorrect, CASE WHEN votes_correct > votes_incorrect THEN 'correct' WHEN votes_incorrect > votes_correct THEN 'incorrect' ELSE 'split' END AS consensus
FROM (SELECT document_id, count(*) FILTER (WHERE is_correct) AS votes_correct, count(*) FILTER (WHERE NOT coalesce(is_correct, false)) AS votes_incorrect FROM {_p('document_id', 'is_correct')} GROUP BY document_id)""")
def vote_consensus(spark: SparkSession, d: str) -> DataFrame:
    return metrics.vote_consensus(predictions(spark, d, "document_id", "is_correct"), "document_id", "is_correct")


@query(f"""
WITH p AS (SELECT model, expected_value AS e, predicted_value AS a FROM {_p('model', 'expected_value', 'predicted_value', 'use_case')} WHERE use_case IN ('topic', 'sentiment')),
l AS (SELECT model, e AS label, count(*) AS support, 0 AS called, count(*) FILTER (WHERE e = a) AS hit FROM p WHERE e IS NOT NULL GROUP BY ALL
  UNION ALL SELECT model, a, 0, count(*), 0 FROM p WHERE a IS NOT NULL GROUP BY ALL),
s AS (SELECT model, label, sum(support)::BIGINT AS support, sum(called) AS called, sum(hit) AS hit FROM l GROUP BY ALL),
r AS (SELECT model, label, CASE WHEN called > 0 THEN hit / called ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r, support FROM s)
SELECT model, label, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, support FROM r""")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d, "model", "expected_value", "predicted_value", "use_case").where("use_case IN ('topic', 'sentiment')")
    return _rounded(metrics.classification_report(p, "expected_value", "predicted_value", ("model",)))


@query("""
WITH v AS (SELECT DISTINCT use_case, value FROM labels WHERE length(trim(value, ' ')) > 0), n AS (SELECT use_case, count(*) AS n FROM v GROUP BY use_case)
SELECT n.use_case, CASE WHEN n.n <= 50 THEN (SELECT string_agg(value, '|' ORDER BY value) FROM v WHERE v.use_case = n.use_case) END AS enum FROM n""")
def label_enum(spark: SparkSession, d: str) -> DataFrame:
    return metrics.label_enum(table(spark, d, "labels"), "value", "use_case")


@query("""SELECT doc_id, replace('Classify the text: {content} ({content})', '{content}', coalesce(text, '')) AS prompt,
CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS shown,
replace(replace('{use_case}/{lang}/{none}', '{use_case}', coalesce(use_case, '')), '{lang}', coalesce(lang, '')).replace('{none}', '') AS filled FROM documents""")
def formatted_prompts(spark: SparkSession, d: str) -> DataFrame:
    values = F.create_map(F.lit("use_case"), F.col("use_case"), F.lit("lang"), F.col("lang"))
    return table(spark, d, "documents").select(
        "doc_id", text.format_text(F.lit("Classify the text: {content} ({content})"), F.col("text")).alias("prompt"),
        text.truncate(F.col("text")).alias("shown"), text.format_map(F.lit("{use_case}/{lang}/{none}"), values).alias("filled"),
    )


@query("""SELECT DISTINCT mention_id, left(concat_ws(chr(10), 'name: ' || name, 'city: ' || city, 'zip: ' || zip), 512) AS match_key FROM institutions""")
def match_keys(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct("name", "city", "zip")
    return table(spark, d, "institutions").select("mention_id", text.match_key(item, ["name", "city", "zip"]).alias("match_key")).distinct()


@query("""
WITH r AS (SELECT doc_id, use_case, row_number() OVER (PARTITION BY use_case ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents WHERE use_case IS NOT NULL),
l AS (SELECT use_case, row_number() OVER (ORDER BY use_case) AS l, count(*) OVER () AS k FROM (SELECT DISTINCT use_case FROM r))
SELECT doc_id, use_case FROM r JOIN l USING (use_case) WHERE r <= 100 // k + (l <= 100 % k)::INT""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(table(spark, d, "documents").select("doc_id", "use_case"), "use_case", "doc_id", 100)


@query("""SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY use_case ORDER BY md5('42|' || doc_id), doc_id) <= ceil(count(*) OVER (PARTITION BY use_case) * 0.8) THEN 'train' ELSE 'test' END AS part FROM documents""")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split(table(spark, d, "documents").select("doc_id", "use_case"), "use_case", "doc_id").select("doc_id", "part")


@query("""SELECT name, rank FROM (SELECT name, CASE WHEN lower(name) = 'sage' THEN 0 WHEN starts_with(lower(name), 'sage') THEN 1
WHEN split_part(lower(name), '/', -1) = 'sage' THEN 2 WHEN starts_with(split_part(lower(name), '/', -1), 'sage') THEN 3 WHEN contains(lower(name), 'sage') THEN 4 END AS rank FROM model_catalog)
WHERE rank IS NOT NULL ORDER BY rank, name LIMIT 20""")
def model_search(spark: SparkSession, d: str) -> DataFrame:
    ranked = table(spark, d, "model_catalog").select("name", text.search_rank(F.col("name"), "sage").alias("rank"))
    return ranked.where("rank IS NOT NULL").orderBy("rank", "name").limit(20)


@query(f"""SELECT c.name AS model FROM model_catalog c WHERE NOT EXISTS (SELECT 1 FROM {_p('model')} p WHERE p.model = c.name)""")
def models_without_results(spark: SparkSession, d: str) -> DataFrame:
    models = table(spark, d, "model_catalog").select(F.col("name").alias("model"))
    return joins.models_without_results(models, table(spark, d, "predictions"))


@query("""SELECT model, count(*) AS docs_left FROM (SELECT 'doc-' || doc_id AS document_id, name AS model FROM documents CROSS JOIN model_catalog WHERE mode = 'chat'
EXCEPT SELECT document_id, model FROM predictions) GROUP BY model""")
def remaining_work(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("document_id"))
    models = table(spark, d, "model_catalog").where("mode = 'chat'").select(F.col("name").alias("model"))
    return joins.remaining(docs, models, table(spark, d, "predictions"), "document_id").groupBy("model").agg(F.count("*").alias("docs_left"))


@query(f"""SELECT prediction_id, CASE WHEN l.document_id IS NOT NULL THEN l.value ELSE p.expected_value END AS expected_value
FROM {_p('document_id', 'expected_value')} p LEFT JOIN {_LABEL} l USING (document_id)""")
def relabelled(spark: SparkSession, d: str) -> DataFrame:
    return joins.relabel(predictions(spark, d, "document_id", "expected_value"), _labels(spark, d), "document_id", "value").select("prediction_id", "expected_value")


@query("""SELECT DISTINCT label_id, document_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.document_id = l.document_id)""")
def unknown_labels(spark: SparkSession, d: str) -> DataFrame:
    return joins.unknown_labels(table(spark, d, "predictions"), table(spark, d, "labels"), "document_id").select("label_id", "document_id").distinct()


@query(f"""SELECT DISTINCT pair_id, lower({_strip('a')}) = lower({_strip('b')}) AS same, {_strip('a')} = {_strip('b')} AS same_case,
replace(lower({_strip('a')}), ' ', '') = replace(lower({_strip('b')}), ' ', '') AS same_packed FROM text_pairs""")
def exact_comparisons(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return table(spark, d, "text_pairs").select(
        "pair_id", text.exact_compare(a, b).alias("same"), text.exact_compare(a, b, case_sensitive=True).alias("same_case"), text.exact_compare(a, b, ignore_spaces=True).alias("same_packed")
    ).distinct()


_GRAMS = "list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n} - 1], ' '))"
_HITS = "coalesce(list_sum(list_transform(list_distinct({g}), lambda x: least(len(list_filter({g}, lambda y: y = x)), len(list_filter({h}, lambda y: y = x))))), 0)::BIGINT"


def _gram_sql() -> str:
    """Counts of the n-grams of both sides and those they share."""
    grams = ", ".join(f"{_GRAMS.format(t=t, n=n)} AS {t}{n}" for n in range(1, 5) for t in ("c", "r"))
    return f"g AS (SELECT *, {grams} FROM w), h AS (SELECT *, {', '.join(_HITS.format(g=f'c{n}', h=f'r{n}') + f' AS h{n}' for n in range(1, 5))} FROM g)"


@query(f"""
WITH t AS (SELECT DISTINCT pair_id, lower({_strip('a')}) AS x, lower({_strip('b')}) AS y FROM text_pairs),
k AS (SELECT *, CASE WHEN x = '' THEN [] ELSE list_transform(string_split(x, ''), lambda c: [unicode(c)::BIGINT]) END AS xs, CASE WHEN y = '' THEN []::BIGINT[] ELSE list_transform(string_split(y, ''), lambda c: unicode(c)::BIGINT) END AS ys FROM t),
l AS (SELECT *, CASE WHEN len(xs) = 0 OR len(ys) = 0 THEN 0 ELSE list_extract(list_reduce(xs, lambda row, c: list_reduce(list_transform(range(1, len(ys) + 1), lambda j: [j]),
  lambda acc, j: list_append(acc, CASE WHEN ys[j[1]] = c[1] THEN row[j[1]] + 1 ELSE greatest(acc[len(acc)], row[j[1] + 1]) END), [0::BIGINT]), list_transform(range(len(ys) + 1), lambda i: 0::BIGINT)), -1) END AS lcs FROM k),
w AS (SELECT *, list_filter(string_split_regex(y, '[{_WS}]+'), lambda v: v <> '') AS c, list_filter(string_split_regex(x, '[{_WS}]+'), lambda v: v <> '') AS r FROM l), {_gram_sql()}
SELECT pair_id, round(CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN length(x) + length(y) = 0 THEN 1 ELSE 2 * lcs / (length(x) + length(y)) END, 6) AS fuzz_ratio,
round(CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN h1 = 0 THEN 0 ELSE CASE WHEN len(c) > len(r) THEN 1 ELSE exp(1 - len(r) / len(c)) END * exp(
  ({' + '.join(f"ln(CASE WHEN h{n} = 0 THEN 0.1 ELSE h{n} END / greatest(1, len(c{n})))" for n in range(1, 5))}) / 4) END, 6) AS bleu,
round(CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN len(c) + len(r) = 0 THEN 0 ELSE (h1 + h2 + h3 + h4) / greatest(len(c1) + len(c2) + len(c3) + len(c4), len(r1) + len(r2) + len(r3) + len(r4)) END, 6) AS gleu FROM h""")
def text_similarities(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "text_pairs").select("pair_id", "a", "b").distinct()
    return pairs.select("pair_id", *[F.round(text_m, 6).alias(m) for m in ("fuzz_ratio", "bleu", "gleu") for text_m in [similarity.text_similarity(m, F.col("a"), F.col("b"))]])


@query("""SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def neighbour_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", F.round(similarity.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


_PLACE = {f: FieldConfig() for f in ("city", "country")} | {"zip": FieldConfig(weight=2.0, optional=True)}


@query("""
WITH x AS (SELECT case_id, p, e FROM (SELECT case_id, unnest(predicted_list) AS p, unnest(expected_list) AS e FROM field_matching)),
f AS (SELECT case_id, p.mention_id AS pm, e.mention_id AS em,
  CASE WHEN p.city IS NULL AND e.city IS NULL THEN 0 ELSE 1 END AS wc, CASE WHEN p.city IS NULL AND e.city IS NULL OR p.city = e.city THEN 1 ELSE 0 END AS sc,
  CASE WHEN p.country IS NULL AND e.country IS NULL THEN 0 ELSE 1 END AS wn, CASE WHEN p.country IS NULL AND e.country IS NULL OR p.country = e.country THEN 1 ELSE 0 END AS sn,
  CASE WHEN p.zip IS NULL OR e.zip IS NULL THEN 0 ELSE 2 END AS wz, CASE WHEN p.zip IS NULL OR e.zip IS NULL OR p.zip = e.zip THEN 1 ELSE 0 END AS sz FROM x)
SELECT case_id, pm, em, round(CASE WHEN wc + wn + wz > 0 THEN (coalesce(sc, 0) * wc + coalesce(sn, 0) * wn + coalesce(sz, 0) * wz) / (wc + wn + wz) ELSE 0 END, 6) AS score FROM f""")
def place_scores(spark: SparkSession, d: str) -> DataFrame:
    zipped = table(spark, d, "field_matching").select("case_id", F.explode(joins.zip_lists(F.col("predicted_list"), F.col("expected_list"))).alias("z"))
    rows = zipped.select("case_id", F.col("z.a").alias("p"), F.col("z.b").alias("e"))
    form = lambda c: F.to_json(F.struct(*[F.col(f"{c}.{f}").alias(f) for f in _PLACE]))
    score = score_columns(form("e"), form("p"), FieldConfig("object", fields=_PLACE))
    return rows.select("case_id", F.col("p.mention_id").alias("pm"), F.col("e.mention_id").alias("em"), F.round(score, 6).alias("score"))


_ITEM = {f: FieldConfig(metric="text_similarity", params={"metric": "fuzz_ratio"}) for f in ("name", "city")} | {"country": FieldConfig(metric="exact_compare")}


@query()
def list_scores(spark: SparkSession, d: str) -> DataFrame:
    """Unordered lists of institutions, matched one to one."""
    form = lambda c: F.to_json(F.transform(F.coalesce(c, F.array()), lambda x: F.struct(*[x[f].alias(f) for f in _ITEM])))
    rows = table(spark, d, "field_matching").select("case_id", form(F.col("expected_list")).alias("e"), form(F.col("predicted_list")).alias("p"))
    scored = score_json(rows, "e", "p", JsonScorer(FieldConfig("list", item=FieldConfig("object", fields=_ITEM))))
    root = F.element_at("result", 1)
    return scored.select("case_id", *[(F.round(root[c], 6) if c == "score" else root[c]).alias(c) for c in ("score", "tp", "fp", "fn", "is_correct")])


@query()
def entity_field_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of each model and field of the extraction use cases."""
    p = predictions(spark, d, "model", "use_case", "expected_value", "predicted_value").where("use_case IN ('entities', 'affiliation')")
    shape = infer_config({"entities": {"people": [{"name": "", "type": ""}], "pathogens": [{"name": "", "type": ""}]}, "institutions": [{"name": "", "city": "", "state": "", "country": ""}]})
    return _rounded(metrics.roll_up(metrics.sum_fields(score_fields(p, ["model"], "expected_value", "predicted_value", JsonScorer(shape)), ["model"]), ["model"]))


@query("""
WITH v AS (SELECT DISTINCT doc_id, text, value FROM documents d JOIN labels l ON l.document_id = 'doc-' || d.doc_id WHERE value IS NOT NULL AND text IS NOT NULL)
SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE contains(lower(text), lower(value))) AS found FROM v GROUP BY doc_id""")
def grounded_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat(F.lit("doc-"), "doc_id").alias("document_id"))
    both = docs.join(table(spark, d, "labels").select("document_id", "value"), "document_id").where("value IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "value").distinct()
    return both.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.lower("text").contains(F.lower("value"))).alias("found"))


@query()
def grounded_extractions(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d, "document_id", "use_case", "predicted_value").where("use_case IN ('entities', 'affiliation')")
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("document_id"), "text")
    return extraction.grounded(p.join(docs, "document_id").select("prediction_id", "predicted_value", "text"), "predicted_value", "text").select("prediction_id", "grounded")


@query("""SELECT use_case, annotator, count(*) AS n FROM (SELECT DISTINCT label_id, use_case, annotator FROM labels) GROUP BY ROLLUP (use_case, annotator)""")
def annotation_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("label_id", "use_case", "annotator").distinct().rollup("use_case", "annotator").agg(F.count("*").alias("n"))


@query(f"""SELECT prediction_id, round(sum(c) OVER (PARTITION BY model ORDER BY prediction_id), 9) AS running_cost FROM (SELECT prediction_id, model, {_clean('llm_cost')} AS c FROM {_p('model', 'llm_cost')})""")
def running_cost(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d, "model", "llm_cost")
    return sampling.running_sum(rows, "model", "prediction_id", metrics.measured("llm_cost"), "running_cost").select("prediction_id", F.round("running_cost", 9).alias("running_cost"))


@query(f"""SELECT prediction_id, document_id FROM {_p('document_id', 'is_correct')} WHERE is_correct ORDER BY prediction_id LIMIT 5""")
def first_correct(spark: SparkSession, d: str) -> DataFrame:
    return sampling.first_correct(predictions(spark, d, "document_id", "is_correct"), [F.col("prediction_id")]).select("prediction_id", "document_id")


@query("""SELECT DISTINCT model FROM runs WHERE status = 'completed'""")
def completed_models(spark: SparkSession, d: str) -> DataFrame:
    from .sources.readers import completed_models as completed

    return completed(table(spark, d, "runs"))


@query("""SELECT model, count(DISTINCT document_id) AS docs_done, (SELECT count(*) FROM documents) AS docs_total, count(DISTINCT document_id) >= (SELECT count(*) FROM documents) AS completed FROM predictions GROUP BY model""")
def run_progress(spark: SparkSession, d: str) -> DataFrame:
    return progress(table(spark, d, "predictions"), table(spark, d, "documents").count())


@query("""SELECT prediction_id, count(*) AS n FROM predictions GROUP BY prediction_id HAVING count(*) > 1""")
def repeated_predictions(spark: SparkSession, d: str) -> DataFrame:
    return joins.duplicates(table(spark, d, "predictions"), "prediction_id")


@query("""SELECT document_id FROM predictions UNION SELECT document_id FROM labels""")
def known_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").select("document_id").union(table(spark, d, "labels").select("document_id")).distinct()


@query("""SELECT doc_id, use_case, 'echo' AS model, length(text) % 7 = 0 AS short_answer, coalesce(text, 'ERROR: no prompt') AS predicted_value FROM documents""")
def offline_predictions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "use_case", F.lit("echo").alias("model"), F.col("text").alias("prompt"))
    answered = providers.predict(docs, providers.Scripted(_echo))
    return answered.select("doc_id", "use_case", "model", (F.length("prompt") % 7 == 0).alias("short_answer"), "predicted_value")


def _echo(model: str, prompt: str) -> str:
    return prompt


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "staging_lines")).select("file_id", "change_kind", "old_field", "new_field")


@query()
def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unify(table(spark, d, "staging_lines"))


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = nested.flatten(table(spark, d, "predictions"), "prediction_id", list(nested.PREDICTION_FIELDS), attributes=False)
    return nodes.select("prediction_id", "field_name", "node_path", "parent_path")


@query()
def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten(table(spark, d, "predictions"), "prediction_id", list(nested.PREDICTION_FIELDS))


from . import catalog_parts  # noqa: E402, F401  (more queries, registered with those above)
