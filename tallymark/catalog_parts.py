"""More queries of the core operators: runs, prompts, providers, reports, schemas, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _METRICS, _clean, _p, _rounded, _strip, model_metrics, predictions, query
from .functions import media, text
from .operators import codescan, drift, extraction, joins, metrics, nested, reports
from .operators.external import score_external
from .operators.scoring import FieldConfig, JsonScorer, score_json
from .plans import decomposed, fewshot, prompts, providers, schemas, settings
from .session import table
from .sources import readers, writers

# Runs


@query("""SELECT DISTINCT document_id, model, sha256('{"content":"' || document_id || '","params":{"t":0},"prompt":"' || model || '"}') AS hash FROM predictions""")
def input_hashes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "predictions").select("document_id", "model").distinct()
    return rows.select("document_id", "model", text.input_hash(F.col("document_id"), F.col("model"), F.lit('{"t":0}')).alias("hash"))


@query("""
WITH s AS (SELECT DISTINCT prediction_id, document_id, model, use_case, predicted_value, completed_at FROM predictions WHERE NOT coalesce(starts_with(predicted_value, 'ERROR:'), false)),
w AS (SELECT DISTINCT document_id, use_case FROM labels WHERE use_case IS NOT NULL)
SELECT document_id, model, prediction_id FROM s JOIN w USING (document_id, use_case)
QUALIFY row_number() OVER (PARTITION BY model, document_id ORDER BY completed_at DESC NULLS LAST, prediction_id DESC) = 1""")
def valid_answers(spark: SparkSession, d: str) -> DataFrame:
    """Staged answers whose input is the one wanted now, the last of each document and model."""
    of = lambda c: text.input_hash(F.col("document_id"), F.col("use_case"), F.lit(None).cast("string"))
    staged = predictions(spark, d, "document_id", "model", "use_case", "predicted_value").join(table(spark, d, "predictions").select("prediction_id", "completed_at").distinct(), "prediction_id").withColumn("hash", of(None))
    wanted = table(spark, d, "labels").where("use_case IS NOT NULL").select("document_id", "use_case").distinct().withColumn("hash", of(None))
    return joins.valid_staging(staged, wanted, "document_id", "hash", [F.desc_nulls_last("completed_at"), F.desc("prediction_id")]).select("document_id", "model", "prediction_id")


@query(f"""SELECT model, round(sum(l), 6) AS llm_cost, round(sum(e), 6) AS evaluation_cost FROM (SELECT model, {_clean('llm_cost')} AS l, {_clean('evaluation_cost')} AS e FROM {_p('model', 'llm_cost', 'evaluation_cost')}) GROUP BY ROLLUP (model)""")
def run_costs(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d, "model", "llm_cost", "evaluation_cost").select("model", metrics.measured("llm_cost").alias("llm_cost"), metrics.measured("evaluation_cost").alias("evaluation_cost"))
    return _rounded(writers.run_costs(rows))


@query(f"""SELECT document_id, expected_value FROM {_p('document_id', 'model', 'run_id', 'expected_value')} QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY model, run_id, expected_value NULLS FIRST) = 1""")
def first_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of results as first seen; a run's value of a document is its least."""
    rows = predictions(spark, d, "document_id", "model", "run_id", "expected_value").groupBy("document_id", "model", "run_id").agg(F.min(F.struct("expected_value"))["expected_value"].alias("expected_value"))
    return readers.first_documents(rows).select("document_id", "expected_value")


@query("""SELECT DISTINCT prediction_id, strftime(completed_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM predictions""")
def utc_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").select("prediction_id", text.utc_millis(F.col("completed_at")).alias("at")).distinct()


@query(f"""SELECT prediction_id, d.n_chars FROM {_p('document_id')} p LEFT JOIN documents d ON 'doc-' || d.doc_id = p.document_id""")
def prediction_contents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("document_id"), F.col("n_chars").alias("content"))
    return joins.documents_of(predictions(spark, d, "document_id"), docs, "document_id").select("prediction_id", F.col("content").alias("n_chars"))


# Prompts and answers


@query(f"""
WITH a AS (SELECT prediction_id, lower(predicted_value) AS t, lower(string_split({_strip('predicted_value')}, chr(10))[1]) AS f FROM {_p('predicted_value')})
SELECT prediction_id, CASE WHEN contains(f, 'incorrect') THEN 'incorrect' WHEN contains(f, 'correct') THEN 'correct' WHEN contains(t, 'incorrect') THEN 'incorrect' WHEN contains(t, 'correct') THEN 'correct' ELSE 'incorrect' END AS vote FROM a""")
def answer_votes(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d, "predicted_value").select("prediction_id", text.vote(F.col("predicted_value")).alias("vote"))


@query(f"""SELECT prediction_id, length(CASE WHEN regexp_matches(predicted_value, '(?s)```(?:json)?\\s*.*?```') THEN regexp_extract(predicted_value, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1) ELSE predicted_value END) AS size FROM {_p('predicted_value')}""")
def unfenced_answers(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d, "predicted_value").select("prediction_id", F.length(text.strip_fence(F.col("predicted_value"))).cast("bigint").alias("size"))


@query("""SELECT doc_id, 3 * length(text) + 2 * length('Let me repeat that:') + 8 AS size, starts_with(text, text) AS whole FROM documents""")
def repeated_prompts(spark: SparkSession, d: str) -> DataFrame:
    again = text.repeat_prompt(F.col("text"), 3)
    return table(spark, d, "documents").select("doc_id", F.length(again).cast("bigint").alias("size"), (again.startswith(F.col("text")) & again.endswith(F.col("text"))).alias("whole"))


@query("""SELECT use_case, floor(0.8 * m)::INT AS least, floor(1.2 * m + 1e-9)::INT AS most FROM (SELECT use_case, floor(avg(length(text))) AS m FROM documents WHERE text IS NOT NULL GROUP BY use_case)""")
def seed_lengths(spark: SparkSession, d: str) -> DataFrame:
    mean = F.floor(F.avg(F.length("text")))
    rows = table(spark, d, "documents").where("text IS NOT NULL").groupBy("use_case").agg(mean.alias("m"))
    return rows.select("use_case", F.floor(0.8 * F.col("m")).cast("int").alias("least"), F.floor(1.2 * F.col("m") + 1e-9).cast("int").alias("most"))


@query("""
WITH u AS (SELECT use_case, row_number() OVER (ORDER BY use_case) AS i, count(*) OVER () AS k FROM (SELECT DISTINCT use_case FROM documents WHERE use_case IS NOT NULL))
SELECT use_case AS label, (100 // k + (i <= 100 % k)::INT)::BIGINT AS n FROM u""")
def label_schedule(spark: SparkSession, d: str) -> DataFrame:
    labels = [r[0] for r in table(spark, d, "documents").where("use_case IS NOT NULL").select("use_case").distinct().orderBy("use_case").collect()]
    return fewshot.label_schedule(spark, labels, 100).groupBy("label").agg(F.count("*").alias("n"))


@query("""
WITH u AS (SELECT doc_id, 'http://host/' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.PDF?v=1' WHEN 2 THEN '.xyz' WHEN 3 THEN '' ELSE '.jpeg' END AS url FROM documents)
SELECT doc_id, url, CASE WHEN doc_id % 5 = 0 THEN 'image/png' WHEN doc_id % 5 = 1 THEN 'application/pdf' WHEN doc_id % 5 = 4 THEN 'image/jpeg' END AS media FROM u""")
def attachment_media(spark: SparkSession, d: str) -> DataFrame:
    return media.attachments(_attached(spark, d), "doc_id").select("doc_id", "url", "media")


def _attached(spark: SparkSession, d: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, (".png", ".PDF?v=1", ".xyz", "", ".jpeg"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", "text", F.array(F.concat(F.lit("http://host/"), "doc_id", ending)).alias("attachments"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 IN (2, 3) THEN 'text' WHEN doc_id % 5 = 1 THEN 'text,file' ELSE 'text,image' END AS parts, text FROM documents""")
def message_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = _attached(spark, d).withColumn("m", media.message(F.col("text"), F.col("attachments")))
    return rows.select("doc_id", F.array_join(F.col("m.kind"), ",").alias("parts"), F.col("m")[0]["text"].alias("text"))


@query("""
WITH m AS (SELECT name AS model FROM model_catalog WHERE mode = 'chat')
SELECT model, count(*) AS n FROM documents, m WHERE NOT (doc_id % 5 IN (0, 4) AND length(model) % 2 = 0) GROUP BY model""")
def refused_attachments(spark: SparkSession, d: str) -> DataFrame:
    """Attachments that a model does not take: here models of names of even length take images."""
    models = table(spark, d, "model_catalog").where("mode = 'chat'").select(F.col("name").alias("model"))
    takes = models.where(F.length("model") % 2 == 0).withColumn("media", F.explode(F.array(F.lit("image/png"), F.lit("image/jpeg"))))
    return media.refused(media.attachments(_attached(spark, d), "doc_id"), models, takes).groupBy("model").agg(F.count("*").alias("n"))


# Providers, offline ones


def _parity(model: str, prompt: str) -> str:
    return "incorrect\nno" if (len(prompt) + len(model)) % 3 == 0 else "correct\nyes"


_ASKED = "length('Document: ' || text || chr(10) || 'Label: ' || use_case || chr(10) || chr(10) || 'Is the label right? Answer ''correct'' or ''incorrect'' on the first line, then why.')"
_VOTES = f"""v AS (SELECT doc_id AS example_id, 'v' || repeat('x', k::INT) AS model, ({_ASKED} + 1 + k) % 3 <> 0 AS is_correct, 0.001 * {_ASKED} AS cost FROM documents, range(3) r(k) WHERE text IS NOT NULL AND use_case IS NOT NULL)"""


def _examples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text IS NOT NULL AND use_case IS NOT NULL")
    return rows.select(F.col("doc_id").alias("example_id"), F.col("text").alias("document"), F.col("use_case").alias("label"), F.lit(0.25).alias("cost"))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return fewshot.validate(_examples(spark, d), ["v", "vx", "vxx"], providers.Scripted(_parity, 0.001))


@query(f"""WITH {_VOTES} SELECT example_id, votes_correct, votes_incorrect, CASE WHEN votes_correct > votes_incorrect THEN 'correct' WHEN votes_incorrect > votes_correct THEN 'incorrect' ELSE 'split' END AS consensus
FROM (SELECT example_id, count(*) FILTER (WHERE is_correct) AS votes_correct, count(*) FILTER (WHERE NOT is_correct) AS votes_incorrect FROM v GROUP BY example_id)""")
def example_votes(spark: SparkSession, d: str) -> DataFrame:
    return metrics.vote_consensus(_votes(spark, d), "example_id", "is_correct")


@query(f"""WITH {_VOTES}, c AS (SELECT 'generation' AS stage, NULL AS model, 0.25 AS cost FROM documents WHERE text IS NOT NULL AND use_case IS NOT NULL UNION ALL SELECT 'validation', model, cost FROM v)
SELECT stage, model, round(sum(cost)::DOUBLE, 4) AS cost FROM c GROUP BY GROUPING SETS ((stage, model), ())""")
def example_costs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fewshot.costs(_examples(spark, d), _votes(spark, d)), 4)


@query(f"""WITH {_VOTES} SELECT example_id, label FROM (SELECT example_id, count(*) FILTER (WHERE is_correct) AS y FROM v GROUP BY example_id HAVING count(*) < 2 * y ORDER BY example_id LIMIT 5) JOIN (SELECT doc_id AS example_id, use_case AS label FROM documents) USING (example_id)""")
def chosen_examples(spark: SparkSession, d: str) -> DataFrame:
    return fewshot.chosen(_examples(spark, d), _votes(spark, d)).select("example_id", "label")


_LISTS = {"type": "object", "properties": {"people": {"type": "array"}, "places": {"type": "array"}}}


def _lists(model: str, prompt: str) -> str:
    name = "people" if "Extract people" in prompt else "places"
    return "oops" if len(prompt) % 5 == 0 else '["a", "b"]' if len(prompt) % 2 else '```json\n{"' + name + '": ["c"]}\n```'


def _list_sql(name: str) -> str:
    # The length of the prompt of a field beside that of the text.
    size = len(prompts.for_field("Find {content}", name)) - len("{content}")
    n = f"(length(text) + {size})"
    return f"CASE WHEN {n} % 5 = 0 THEN 0 WHEN {n} % 2 = 1 THEN 2 ELSE 1 END"


@query(f"SELECT doc_id, {_list_sql('people')}::INT AS people, {_list_sql('places')}::INT AS places FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def split_extractions(spark: SparkSession, d: str) -> DataFrame:
    """One request for each list, merged to one object; broken answers are empty lists."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    found = decomposed.extract(docs, "m", providers.Scripted(_lists), _LISTS, decomposed.field_prompts("Find {content}", _LISTS))
    read = F.from_json("predicted_value", "people array<string>, places array<string>")
    return found.select(F.col("id").alias("doc_id"), read.alias("r")).select("doc_id", F.size("r.people").alias("people"), F.size("r.places").alias("places"))


class _ByHeat:
    def complete(self, model, prompt, temperature=0.0):
        return providers.Answer('{"x": ["%s"], "k": %d}' % ("far" if temperature else "near", len(prompt) % 10), 0.5)


@query("""SELECT doc_id, ['near', 'far'] AS x, (length(coalesce(text, '')) % 10)::INT AS k, 1.0::DOUBLE AS llm_cost FROM documents""")
def merged_passes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("m").alias("model"), F.coalesce("text", F.lit("")).alias("prompt"))
    out = decomposed.several_passes(rows, _ByHeat(), 2).withColumn("r", F.from_json("predicted_value", "x array<string>, k int"))
    return out.select(F.col("id").alias("doc_id"), "r.x", "r.k", "llm_cost")


@query("""SELECT doc_id, '<' || coalesce(text, 'ERROR: no prompt') || '>' AS predicted_value FROM documents""")
def chained_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.lit("m").alias("model"), F.col("text").alias("prompt"))
    return providers.chain(rows, providers.Scripted(lambda m, p: p), ["<{content}>"]).select("doc_id", "predicted_value")


def _fussy(model: str, prompt: str) -> str:
    if model == "first" and len(prompt) % 2:
        raise RuntimeError("down")
    return model


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN 'ERROR: no prompt' WHEN length(text) % 2 = 1 THEN 'second' ELSE 'first' END AS predicted_value FROM documents""")
def fallback_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.lit("first").alias("model"), F.col("text").alias("prompt"))
    return providers.predict(rows, providers.Fallback(providers.Scripted(_fussy), ["second"])).select("doc_id", "predicted_value")


# Scores


@query(f"""
WITH p AS (SELECT DISTINCT pair_id, a, b FROM text_pairs)
SELECT pair_id, CASE WHEN a IS NULL AND b IS NULL THEN 1.0 WHEN b IS NULL OR a IS NULL OR a <> b THEN 0.0 ELSE 1.0 END::DOUBLE AS score,
CASE WHEN a IS NULL AND b IS NULL THEN 0.0 ELSE 2.0 END::DOUBLE AS weight, coalesce(a = b, a IS NULL AND b IS NULL) AS is_correct,
(coalesce(a = b, a IS NULL AND b IS NULL))::INT::DOUBLE AS tp, (CASE WHEN b IS NULL THEN false WHEN a IS NULL THEN true ELSE a <> b END)::INT::DOUBLE AS fp, (CASE WHEN a IS NULL THEN false WHEN b IS NULL THEN true ELSE a <> b END)::INT::DOUBLE AS fn FROM p""")
def leaf_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A leaf expected as ``a`` and answered as ``b``, each maybe missing."""
    form = lambda c: F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("{}"))
    rows = table(spark, d, "text_pairs").select("pair_id", "a", "b").distinct().select("pair_id", F.to_json(F.struct(F.col("a").alias("v")), {"ignoreNullFields": "false"}).alias("e"), form("b").alias("p"))
    scored = score_json(rows, "e", "p", JsonScorer(FieldConfig("object", fields={"v": FieldConfig(weight=2.0)})))
    node = F.element_at("result", 2)
    return scored.select("pair_id", *[node[c].alias(c) for c in ("score", "weight", "is_correct", "tp", "fp", "fn")])


_CITIES = """c AS (SELECT case_id, list_filter(list_transform(coalesce(expected_list, []), lambda x: coalesce(x.city, '-')), lambda x: true) AS e, list_transform(coalesce(predicted_list, []), lambda x: coalesce(x.city, '-')) AS a FROM field_matching)"""


def _cities(spark: SparkSession, d: str) -> DataFrame:
    form = lambda c: F.to_json(F.transform(F.coalesce(c, F.array()), lambda x: F.coalesce(x["city"], F.lit("-"))))
    return table(spark, d, "field_matching").select("case_id", form(F.col("expected_list")).alias("e"), form(F.col("predicted_list")).alias("a"))


def _list_result(scored: DataFrame) -> DataFrame:
    root = F.element_at("result", 1)
    return scored.select("case_id", F.round(root["score"], 6).alias("score"), *[root[c].alias(c) for c in ("tp", "fp", "fn", "is_correct")])


_SOFT = "round(CASE WHEN len(a) > 0 AND len(e) > 0 AND tp > 0 THEN 2.0 * (tp / len(a)) * (tp / len(e)) / (tp / len(a) + tp / len(e)) ELSE 0 END, 6)"


@query(f"""WITH {_CITIES}, m AS (SELECT *, len(list_filter(range(1, least(len(e), len(a)) + 1), lambda i: e[i] = a[i]))::DOUBLE AS tp FROM c)
SELECT case_id, {_SOFT} AS score, tp, len(a) - tp AS fp, len(e) - tp AS fn, len(e) = len(a) AND tp = len(e) AS is_correct FROM m""")
def ordered_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of cities compared place by place."""
    return _list_result(score_json(_cities(spark, d), "e", "a", JsonScorer(FieldConfig("list", ordered=True, item=FieldConfig()))))


@query(f"""WITH {_CITIES}, m AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(e), lambda x: least(len(list_filter(e, lambda y: y = x)), len(list_filter(a, lambda y: y = x))))), 0)::DOUBLE AS tp FROM c)
SELECT case_id, CASE WHEN len(e) = len(a) AND tp = len(e) THEN 1.0 ELSE {_SOFT} END AS score, tp, len(a) - tp AS fp, len(e) - tp AS fn, len(e) = len(a) AND tp = len(e) AS is_correct FROM m""")
def unordered_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of cities matched one to one in any order."""
    return _list_result(score_json(_cities(spark, d), "e", "a", JsonScorer(FieldConfig("list", item=FieldConfig()))))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings table as answers known before."""
    rows = table(spark, d, "embeddings").select(F.lit("embedding").alias("kind"), F.lit("embedding").alias("model"), F.concat(F.lit("v"), "vec_id").alias("text"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.select("*", F.lit(None).cast("boolean").alias("verdict"), F.lit(0.0).alias("cost"))


@query("""SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) >= 0.1 AS is_correct FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embedding_scores(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of texts by the cosine of their embeddings, read from a table of answers."""
    ids = table(spark, d, "embeddings").select("vec_id")
    pairs = ids.join(ids.select((F.col("vec_id") - 1).alias("vec_id")), "vec_id").select("vec_id", *[F.to_json(F.struct(F.concat(F.lit("v"), F.col("vec_id") + i).alias("t"))).alias(c) for i, c in ((0, "e"), (1, "a"))])
    config = FieldConfig("object", fields={"t": FieldConfig(metric="embedding", params={"comparison_threshold": 0.1})})
    scored, _ = score_external(pairs, "vec_id", "e", "a", config, answers=_vectors(spark, d))
    return scored.select("vec_id", F.round(F.element_at("result", 1)["score"], 6).alias("score"), F.element_at("result", 1)["is_correct"].alias("is_correct"))


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), q AS (SELECT a.vec_id, list_cosine_similarity(a.x, c.x) AS ac, list_cosine_similarity(a.x, e.x) AS ae, list_cosine_similarity(b.x, c.x) AS bc, list_cosine_similarity(b.x, e.x) AS be
  FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN v c ON c.vec_id = a.vec_id + 2 JOIN v e ON e.vec_id = a.vec_id + 3 WHERE a.vec_id % 4 = 0),
k AS (SELECT vec_id, (CASE WHEN ac >= 0 THEN 1 - ac ELSE 1e6 END) + (CASE WHEN be >= 0 THEN 1 - be ELSE 1e6 END) AS straight, (CASE WHEN ae >= 0 THEN 1 - ae ELSE 1e6 END) + (CASE WHEN bc >= 0 THEN 1 - bc ELSE 1e6 END) AS crossed, * EXCLUDE vec_id FROM q),
p AS (SELECT vec_id, CASE WHEN straight <= crossed THEN [ac, be] ELSE [ae, bc] END AS s FROM k)
SELECT vec_id, len(list_filter(s, lambda z: z >= 0))::DOUBLE AS tp, round(coalesce(list_sum(list_filter(s, lambda z: z >= 0)), 0) / 2, 6) AS score FROM p""")
def aligned_lists(spark: SparkSession, d: str) -> DataFrame:
    """Two texts expected and two answered, aligned by the cosines of their embeddings and
    scored by them; pairs of negative cosine do not match."""
    ids = table(spark, d, "embeddings").where("vec_id % 4 = 0").select("vec_id")
    last = table(spark, d, "embeddings").select((F.col("vec_id") - 3).alias("vec_id"))
    side = lambda i: F.to_json(F.array(*[F.concat(F.lit("v"), F.col("vec_id") + k) for k in (i, i + 1)]))
    pairs = ids.join(last, "vec_id").select("vec_id", side(0).alias("e"), side(2).alias("a"))
    config = FieldConfig("list", item=FieldConfig(metric="embedding"), allow_expensive=["$item"], align_least=0.0)
    scored, _ = score_external(pairs, "vec_id", "e", "a", config, answers=_vectors(spark, d))
    root = F.element_at("result", 1)
    return scored.select("vec_id", root["tp"].alias("tp"), F.round(F.when(root["is_correct"], F.aggregate(F.filter("result", lambda n: n["path"] != "root"), F.lit(0.0), lambda s, n: s + n["score"]) / 2).otherwise(root["score"]), 6).alias("score"))


def _same_letters(model: str, prompt: str) -> tuple[bool, float]:
    a, b = prompt.split("\n--\n")
    return sorted(a) == sorted(b), 0.5


@query("""
WITH p AS (SELECT DISTINCT pair_id, a, b FROM text_pairs WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT pair_id, (list_sort(string_split(a, '')) = list_sort(string_split(b, '')))::INT::DOUBLE AS score, 0.5::DOUBLE AS cost FROM p""")
def judged_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by an offline judge: the same letters in any order; each distinct pair is asked once."""
    rows = table(spark, d, "text_pairs").where("a IS NOT NULL AND b IS NOT NULL").select("pair_id", "a", "b").distinct()
    forms = rows.select("pair_id", *[F.to_json(F.struct(F.col(c).alias("v"))).alias(n) for c, n in (("a", "e"), ("b", "p"))])
    config = FieldConfig("object", fields={"v": FieldConfig(metric="llm", params={"prompt_template": "{expected}\n--\n{predicted}"})})
    scored, _ = score_external(forms, "pair_id", "e", "p", config, judge=_same_letters)
    root = F.element_at("result", 1)
    return scored.select("pair_id", root["score"].alias("score"), root["cost"].alias("cost"))


@query(f"""
WITH p AS (SELECT prediction_id, predicted_value, lower(coalesce(text, '')) AS text FROM {_p('document_id', 'use_case', 'predicted_value')} q JOIN documents d ON 'doc-' || d.doc_id = q.document_id WHERE q.use_case IN ('entities', 'affiliation') AND json_valid(predicted_value)),
s AS (SELECT prediction_id, text, atom->>'$' AS v FROM p, json_tree(predicted_value) t WHERE t.type = 'VARCHAR')
SELECT p.prediction_id, count(v) FILTER (WHERE length({_strip('v')}) > 0) AS strings, count(v) FILTER (WHERE length({_strip('v')}) > 0 AND contains(p.text, lower(v))) AS found FROM p LEFT JOIN s USING (prediction_id) GROUP BY p.prediction_id""")
def grounded_counts(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d, "document_id", "use_case", "predicted_value").where("use_case IN ('entities', 'affiliation')")
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("document_id"), "text")
    counted = extraction.ground_counts(p.join(docs, "document_id").select("prediction_id", "predicted_value", "text"), "predicted_value", "text")
    return counted.where("strings IS NOT NULL").select("prediction_id", "strings", "found")


# Labels and schemas

_INSTITUTIONS = {"type": "object", "required": ["institutions"], "properties": {"institutions": {"type": "array", "minItems": 1}}}


@query("""
SELECT DISTINCT label_id, CASE WHEN NOT coalesce(json_valid(value), false) THEN '$: no JSON' WHEN json_type(value) <> 'OBJECT' THEN '$: not of type object'
WHEN coalesce(json_type(value, '$.institutions'), 'NULL') <> 'ARRAY' THEN '$.institutions: not of type array' ELSE '$.institutions: minItems' END AS problem FROM labels
WHERE use_case = 'affiliation' AND NOT coalesce(json_valid(value) AND json_type(value) = 'OBJECT' AND json_type(value, '$.institutions') = 'ARRAY' AND json_array_length(value, '$.institutions') > 0, false)""")
def label_violations(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").where("use_case = 'affiliation'").select("label_id", "value").distinct()
    return schemas.violations(labels, _INSTITUTIONS, "label_id").select("label_id", F.array_join("problems", "; ").alias("problem"))


@query("""SELECT DISTINCT label_id, CASE WHEN value IS NULL OR NOT json_valid(value) THEN true ELSE json_type(value) NOT IN ('OBJECT', 'ARRAY') END AS plain FROM labels""")
def plain_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("label_id", schemas.plain(F.col("value")).alias("plain")).distinct()


@query("""SELECT DISTINCT label_id, json_object('label', value)->>'$.label' AS label FROM labels WHERE use_case = 'topic'""")
def wrapped_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").where("use_case = 'topic'").select("label_id", "value").distinct()
    wrapped = schemas.wrap_labels(labels, {"properties": {"label": {"type": "string"}}})
    return wrapped.select("label_id", F.get_json_object("value", "$.label").alias("label"))


# Reports


@query(f"""WITH m AS ({_METRICS}) SELECT model, row_number() OVER (ORDER BY total_cost NULLS LAST, model)::INT AS place FROM m""")
def results_by_cost(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return model_metrics(spark, d).select("model", F.row_number().over(Window.orderBy(F.asc_nulls_last("total_cost"), "model")).alias("place"))


@query(f"""
WITH m AS ({_METRICS}), r AS (SELECT unnest(['accuracy', 'total_cost', 'total_time']) AS measure, model, unnest([round_even(100 * accuracy, 2), round_even(total_cost, 6), round_even(total_time, 3)]) AS value FROM m)
SELECT measure, model, round(value, 4) AS value, round(CASE WHEN max(value) OVER (PARTITION BY measure) > 0 THEN value / max(value) OVER (PARTITION BY measure) ELSE 0 END, 4) AS share FROM r""")
def report_bars(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(reports.bars(model_metrics(spark, d)), 4)


@query(f"""
WITH p AS (SELECT model, expected_value AS e, predicted_value AS a FROM {_p('model', 'expected_value', 'predicted_value', 'use_case')} WHERE use_case = 'topic'),
l AS (SELECT model, e AS label, count(*) AS support, 0 AS called, count(*) FILTER (WHERE e = a) AS hit FROM p WHERE e IS NOT NULL GROUP BY ALL UNION ALL SELECT model, a, 0, count(*), 0 FROM p WHERE a IS NOT NULL GROUP BY ALL),
r AS (SELECT model, label, coalesce(sum(hit) / nullif(sum(called), 0), 0) AS p, coalesce(sum(hit) / nullif(sum(support), 0), 0) AS r FROM l GROUP BY ALL)
SELECT label AS field, round(max(p), 6) AS best_precision, round(max(r), 6) AS best_recall, round(max(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS best_f1 FROM r GROUP BY label""")
def field_best(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d, "model", "expected_value", "predicted_value", "use_case").where("use_case = 'topic'")
    return _rounded(reports.field_best(metrics.classification_report(p, "expected_value", "predicted_value", ("model",)).withColumnRenamed("label", "field")))


@query("""
WITH f AS (SELECT DISTINCT string_split(replace(name, '/', '.'), '.') AS p FROM model_catalog), n AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM f)
SELECT array_to_string(p[1:i], '.') AS path, min(array_to_string(p[1:i - 1], '.')) AS parent, min(p[i]) AS name, min(i)::INT AS depth, bool_or(i = len(p)) AS leaf FROM n GROUP BY 1""")
def field_tree(spark: SparkSession, d: str) -> DataFrame:
    return reports.field_tree(table(spark, d, "model_catalog").select(F.replace("name", F.lit("/"), F.lit(".")).alias("field")))


@query(f"""SELECT document_id, min_by(expected_value, model) FILTER (WHERE expected_value IS NOT NULL) AS expected_value, count(*) AS n, string_agg(model, '|' ORDER BY model) AS models
FROM (SELECT document_id, model, min(expected_value) AS expected_value FROM {_p('document_id', 'model', 'expected_value')} GROUP BY ALL) GROUP BY document_id""")
def document_details(spark: SparkSession, d: str) -> DataFrame:
    one = predictions(spark, d, "document_id", "model", "expected_value").groupBy("document_id", "model").agg(F.min("expected_value").alias("expected_value"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("predicted_value", "string"), ("is_correct", "boolean"), ("example_score", "double"), ("llm_cost", "double"), ("response_time", "double"))]
    found = reports.document_details(one.select("*", *none))
    return found.select("document_id", "expected_value", F.size("results").cast("bigint").alias("n"), F.array_join(F.col("results.model"), "|").alias("models"))


# Models


@query("SELECT DISTINCT name FROM model_catalog")
def available_models(spark: SparkSession, d: str) -> DataFrame:
    return settings.available(table(spark, d, "model_catalog"))


@query("""SELECT name FROM model_catalog WHERE mode = 'chat' AND input_cost_per_token + output_cost_per_token IS NOT NULL AND name NOT IN (SELECT name FROM model_catalog ORDER BY name LIMIT 2) ORDER BY input_cost_per_token + output_cost_per_token, name LIMIT 3""")
def suggested_models(spark: SparkSession, d: str) -> DataFrame:
    catalog = table(spark, d, "model_catalog")
    return settings.suggested(catalog, [r.name for r in catalog.select("name").orderBy("name").limit(2).collect()])


@query("""SELECT DISTINCT name, litellm_provider AS provider, coalesce(mode = 'chat', false) AS chat, coalesce(input_cost_per_token, 0) = 0 AND coalesce(output_cost_per_token, 0) = 0 AS free, coalesce(max_input_tokens, 0) >= 100000 AS long_context FROM model_catalog""")
def model_capabilities(spark: SparkSession, d: str) -> DataFrame:
    return settings.capabilities(table(spark, d, "model_catalog")).withColumn("chat", F.coalesce("chat", F.lit(False)))


# Scans


_RULES = {"digit": "[0-9]{4}", "mail": "@[a-z]+", "money": "[$€]", "quote": "[\"“]"}


def _line_hits(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").where("text IS NOT NULL").select(F.concat(F.lit("doc-"), "doc_id").alias("file"), "text")
    return codescan.scan_lines(files, spark.createDataFrame(list(_RULES.items()), "name string, regex string"))


_HITS = "h AS (SELECT file, line, name FROM (SELECT 'doc-' || doc_id AS file, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL), (VALUES " + ", ".join("('" + k + "', '" + v + "')" for k, v in _RULES.items()) + ") r(name, regex) WHERE regexp_matches(t, regex))"


@query(f"WITH {_HITS} SELECT * FROM h")
def line_hits(spark: SparkSession, d: str) -> DataFrame:
    return _line_hits(spark, d).select("file", "line", "name")


@query(f"WITH {_HITS} SELECT 'name' AS key, name AS value, count(*) AS n FROM h GROUP BY name UNION ALL SELECT 'file', file, count(*) FROM h GROUP BY file")
def scan_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.scan_counts(_line_hits(spark, d), ["name", "file"])


@query(f"WITH {_HITS} SELECT file, count(*) AS n FROM h GROUP BY file ORDER BY n DESC, file LIMIT 20")
def top_files(spark: SparkSession, d: str) -> DataFrame:
    return codescan.top_files(_line_hits(spark, d))


@query(f"WITH {_HITS} SELECT file, line, min(name) AS name FROM h GROUP BY file, line")
def first_rule_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = _line_hits(spark, d).select("file", "line", F.lit("").alias("function"), "name")
    return codescan.one_for_line(hits, "name").select("file", "line", "name")


@query("""
WITH i AS (SELECT DISTINCT use_case AS file, replace(name, '/', '.') AS library FROM documents, model_catalog WHERE use_case IS NOT NULL), p AS (SELECT litellm_provider AS name, split_part(replace(name, '/', '.'), '.', 1) AS library, row_number() OVER (ORDER BY name)::INT AS ordinal FROM model_catalog)
SELECT i.file, i.library, min_by(p.name, p.ordinal) AS name FROM i JOIN p ON i.library = p.library OR starts_with(i.library, p.library || '.') GROUP BY ALL""")
def nearest_libraries(spark: SparkSession, d: str) -> DataFrame:
    """The first pattern whose library is a prefix of an imported name."""
    from pyspark.sql import Window

    catalog = table(spark, d, "model_catalog").withColumn("library", F.replace("name", F.lit("/"), F.lit(".")))
    files = table(spark, d, "documents").where("use_case IS NOT NULL").select(F.col("use_case").alias("file")).distinct()
    imports = files.join(F.broadcast(catalog.select("library").distinct().agg(F.collect_list("library").alias("l")))).select("file", F.explode("l").alias("library"))
    patterns = catalog.select(F.col("litellm_provider").alias("name"), F.substring_index("library", ".", 1).alias("library"), F.row_number().over(Window.orderBy(F.col("name"))).alias("ordinal"))
    return joins.nearest_library(imports, patterns).select("file", "library", "name")


# Drift and nested records beside p2_found and p4_found

_NODES = r"""n AS (SELECT prediction_id, replace(fullkey, '"', '') AS node_path, replace(path, '"', '') AS path, regexp_matches(fullkey, '\]$') AS item
  FROM (SELECT DISTINCT prediction_id, CASE WHEN json_type(field_metrics) = 'VARCHAR' THEN field_metrics->>'$' ELSE field_metrics END AS field_metrics FROM predictions WHERE json_valid(field_metrics)) p, json_tree(p.field_metrics) t WHERE t.type = 'OBJECT')"""


@query(rf"""WITH {_NODES} SELECT prediction_id, node_path, CASE WHEN node_path = '$' THEN '' WHEN item THEN CASE WHEN regexp_matches(path, '^\$(\[\d+\])*$') THEN '' ELSE regexp_replace(regexp_replace(path, '(\[\d+\])*$', ''), '\.[^.]*$', '') END ELSE path END AS parent_path FROM n""")
def p4_metric_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The objects of the field metrics, which are plain JSON or that once more as a string."""
    nodes = nested.flatten(table(spark, d, "predictions"), "prediction_id", ["field_metrics"], attributes=False)
    return nodes.select("prediction_id", "node_path", "parent_path")


@query()
def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables that the nested fields make, one for each repeated path."""
    return nested.table_paths(nested.flatten(table(spark, d, "predictions"), "prediction_id", list(nested.PREDICTION_FIELDS)))


@query("""SELECT DISTINCT file_id, line_no FROM staging_lines WHERE json_valid(line_text) AND json_type(line_text) = 'OBJECT'""")
def p2_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines that reach the unified table."""
    return drift.unify(table(spark, d, "staging_lines")).select("file_id", "line_no")


@query("""
WITH l AS (SELECT DISTINCT file_id, line_no, line_text FROM staging_lines WHERE json_valid(line_text) AND json_type(line_text) = 'OBJECT')
SELECT f.file_id, k.key AS field FROM (SELECT DISTINCT file_id FROM l) f JOIN (SELECT DISTINCT file_id, unnest(json_keys(line_text)) AS key FROM l) k USING (file_id)""")
def p2_fields(spark: SparkSession, d: str) -> DataFrame:
    """The lifespan catalogue's top-level fields of each file."""
    cells = drift.cells(table(spark, d, "staging_lines"), "stream_name", "file_id", "written_at", "line_text")
    return drift.catalogue(cells).where("parent = ''").select(F.col("file").alias("file_id"), "field")
