import json

import pytest
from pyspark.sql import functions as F

from tallymark.functions import cost, text
from tallymark.operators import codescan, drift, extraction, joins, metrics, nested, sampling
from tallymark.plans import prompts, providers
from tallymark.plans.experiment import Experiment, write_report
from tallymark.sources import readers, writers
from tallymark.streaming import progress


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_text_functions(spark):
    assert one(spark, text.strip(F.lit(" \t a b \n"))) == "a b"
    assert one(spark, text.format_text(F.lit("{content} {x}"), F.lit("$1{content}"))) == "$1{content} {x}"
    assert one(spark, text.format_map(F.lit("{a}{b}{a}"), F.create_map(F.lit("a"), F.lit("1")))) == "11"
    assert one(spark, text.truncate(F.lit("x" * 201))) == "x" * 200 + "…"
    assert one(spark, text.strip_fence(F.lit("so:\n```json\n{}\n```"))) == "{}"
    assert [one(spark, text.vote(F.lit(v))) for v in ("Correct", "incorrect\ncorrect", "no\nit is correct", "", None)] == ["correct", "incorrect", "correct", "incorrect", "incorrect"]
    assert one(spark, text.media_hint(F.lit("http://a/b.PNG?x=1"))) == "image/png" and one(spark, text.media_hint(F.lit("data:text/css;base64,x"))) == "text/css"
    assert one(spark, text.media_sniff(F.lit(b"%PDF-1.4").cast("binary"))) == "application/pdf"
    h = [one(spark, text.input_hash(F.lit(c), F.lit("p"), F.lit(None).cast("string"))) for c in ("a", "a", "b")]
    assert h[0] == h[1] != h[2] and len(h[0]) == 64


def test_costs(spark):
    assert cost.time_unit_seconds("2 Hr") == 7200 and cost.time_unit_seconds("min") == 60
    with pytest.raises(ValueError):
        cost.time_unit_seconds("2 moons")
    rate = lambda m: one(spark, cost.imputed_hourly(F.lit(m)))
    assert [rate(m) for m in ("llama-3-8b", "llama 13b", "llama-70b", "llama", "other-7b")] == [1.006, 1.212, 16.288, 16.288, 1.212]
    assert one(spark, cost.effective_cost(F.lit(0.0), F.lit("m"), F.lit(3600.0))) == 1.212
    assert one(spark, cost.effective_cost(F.lit(0.0), F.lit("m"), F.lit(3600.0), F.lit(0.0))) == 0.0


def test_metrics_of_nulls_ties_and_empty(spark):
    schema = "model string, is_correct boolean, example_score double, llm_cost double, evaluation_cost double, response_time double, extra int"
    nan = float("nan")
    df = spark.createDataFrame([("a", True, 1.0, 0.5, 0.0, -1.0, 1), ("a", None, None, nan, None, 2.0, 1), ("b", True, 0.5, 0.25, 0.25, 2.0, 2), (None, False, None, None, None, None, None)], schema)
    got = {r.model: r for r in metrics.model_metrics(df).collect()}
    assert got["a"].accuracy == 0.5 and got["a"].average_time == 2.0 and got["a"].total_cost == 0.5
    assert got[None].total_cost == 0.0 and got[None].average_time is None
    assert metrics.model_metrics(df.limit(0)).count() == 0
    best = {r.measure: r.model for r in metrics.best_models(metrics.model_metrics(df).where("model IS NOT NULL")).collect()}
    assert best["accuracy"] == "b" and best["total_cost"] == "a" and best["average_time"] == "a"
    h = metrics.histogram(df, "response_time").collect()
    assert sum(r.n for r in h) == 2
    assert metrics.histogram(df.limit(0), "response_time").count() == 0
    assert metrics.nice_width(0, 1) == pytest.approx(0.1) and metrics.nice_width(5, 5) == 1


def test_field_metrics_roll_up(spark):
    rows = [("m", "root", 0.5, 1.0, 1.0, 0.0, 1.0, 0.0, 0.0, "agg:weighted_avg", True), ("m", "root.a[0]", 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0, "exact", True), ("m", "root.a[1]", 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0, "exact", False), ("m", "root.b", 1.0, 3.0, 1.0, 0.0, 0.0, 1.0, 1.0, "exact", True)]
    df = spark.createDataFrame(rows, "model string, path string, score double, weight double, tp double, fp double, fn double, precision double, recall double, metric string, is_correct boolean")
    got = {r.field: r for r in metrics.roll_up(metrics.field_metrics(df, ["model"]), ["model"]).collect()}
    assert got["a"].precision == 0.5 and got["a"].n == 2
    assert got["[root]"].precision == pytest.approx((0.5 * 1 + 1.0 * 3) / 4)


def test_joins(spark):
    preds = spark.createDataFrame([("d1", "m", "x", "h1", 1), ("d1", "m", "y", "h1", 2), ("d2", "m", "ERROR: no", "h2", 1), ("d3", "m", "z", "old", 1)], "document_id string, model string, predicted_value string, hash string, n int")
    wanted = spark.createDataFrame([("d1", "h1"), ("d2", "h2"), ("d3", "h3")], "document_id string, hash string")
    assert [r.predicted_value for r in joins.valid_staging(preds, wanted, "document_id", "hash", [F.desc("n")]).collect()] == ["y"]
    docs = spark.createDataFrame([("d1",), ("d9",)], "document_id string")
    models = spark.createDataFrame([("m",), ("k",), ("m",)], "model string")
    assert joins.remaining(docs, models, preds, "document_id").count() == 3
    assert joins.remaining(docs, models.limit(0), preds, "document_id").count() == 0
    imports = spark.createDataFrame([("f", "a.b.c"), ("f", "ab")], "file string, library string")
    patterns = spark.createDataFrame([("a", 2, "A"), ("a.b", 1, "AB")], "library string, ordinal int, name string")
    assert [r.name for r in joins.nearest_library(imports, patterns).collect()] == ["AB"]
    labels = spark.createDataFrame([("d1", None)], "document_id string, value string")
    both = preds.withColumn("expected_value", F.lit("e"))
    assert {r.expected_value for r in joins.relabel(both, labels, "document_id", "value").where("document_id = 'd1'").collect()} == {None}


def test_sampling(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)] + [(99, None)], "id int, label string")
    got = sampling.stratified(df, "label", "id", 5).groupBy("label").count().collect()
    assert sorted((r.label, r["count"]) for r in got) == [("a", 3), ("b", 2)]
    assert sampling.schedule(["x", "y"], 3) == ["x", "x", "y"]
    parts = sampling.split(df, "label", "id").groupBy("label", "part").count().collect()
    assert {(r.label, r.part): r["count"] for r in parts}[("a", "train")] == 8
    assert sampling.stratified(df.limit(0), "label", "id", 5).count() == 0
    with pytest.raises(ValueError):
        sampling.cost_spread(spark.createDataFrame([("a", 1.0)], "name string, cost double"), "zz", 3)


def test_extraction():
    people = {"type": "array", "items": {}}
    schema = {"properties": {"entities": {"type": "object", "properties": {"people": people, "pathogens": people}}}}
    assert extraction.split_point(schema) == (["entities"], ["people", "pathogens"])
    assert list(extraction.sub_schemas(schema)["people"]["properties"]["entities"]["properties"]) == ["people"]
    assert extraction.sub_schemas({"properties": {"a": people}}) == {}
    assert extraction.unique_items([{"n": "Anna Berg"}, {"n": "anna berg"}, {"n": "Bo"}]) == [{"n": "Anna Berg"}, {"n": "Bo"}]
    assert extraction.merge_values([{"a": ["x"]}, {"a": ["X", "yy"], "b": 1}]) == {"a": ["x", "yy"], "b": 1}
    assert extraction.drop_paths({"a": [{"n": "x"}, {"n": "y"}]}, {("a", 0, "n")}) == {"a": [{"n": "y"}]}


def test_grounded_and_merged(spark):
    df = spark.createDataFrame([('{"a": ["Rome", "Oslo"]}', "in rome"), ("broken", "x"), (None, None)], "e string, d string")
    assert [r.grounded for r in extraction.grounded(df, "e", "d").collect()] == ['{"a": ["Rome"]}', "broken", None]
    many = spark.createDataFrame([(['{"a": ["x"]}', "no", '{"a": ["y"]}'],), ([],), (None,)], "t array<string>")
    assert [r.merged for r in extraction.merge_passes(many, "t").collect()] == ['{"a": ["x", "y"]}', None, None]
    assert json.loads(one(spark, extraction.merge_fields({"a": F.lit("[1]"), "b": F.lit("oops")}))) == {"a": [1], "b": []}


def test_codescan(spark):
    code = 'import openai\nP = "Say " + "hi"\nc = openai.OpenAI()\nc.chat.completions.create(messages=[{"role": "user", "content": P}])\n'
    rows = codescan.scan_calls(spark.createDataFrame([("f.py", code), ("g.py", "def ("), ("h.py", None)], "file string, text string")).collect()
    assert [(r.line, r.provider, r.prompt) for r in rows] == [(4, "OpenAI", "Say hi")]
    hits = codescan.scan_lines(spark.createDataFrame([("f", "a\nb1")], "file string, text string"), spark.createDataFrame([("digit", "[0-9]")], "name string, regex string")).collect()
    assert [(r.line, r.name) for r in hits] == [(2, "digit")]


class Flaky:
    def __init__(self, fails):
        self.fails = fails

    def complete(self, model, prompt, temperature=0.0):
        self.fails -= 1
        if self.fails >= 0 or model == "bad":
            raise RuntimeError("down")
        return providers.Answer(model)


def test_providers(spark):
    waits = []
    assert providers.Retrying(Flaky(2), sleep=waits.append).complete("m", "p").text == "m" and waits == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        providers.Retrying(Flaky(9), sleep=waits.append).complete("m", "p")
    assert providers.Fallback(Flaky(0), ["good"]).complete("bad", "p").text == "good"
    slept = []
    limited = providers.Limited(Flaky(0), 2, clock=lambda: 0.0, sleep=slept.append)
    for _ in range(3):
        limited.complete("m", "p")
    assert slept == [60.0]
    df = spark.createDataFrame([("m", "hello"), ("m", None)], "model string, prompt string")
    got = {r.prompt: r.predicted_value for r in providers.predict(df, providers.Scripted(lambda m, p: p.upper())).collect()}
    assert got["hello"] == "HELLO" and got[None].startswith("ERROR:")
    chained = providers.chain(df.limit(1), providers.Scripted(lambda m, p: p + "!", 1.0), ["<{content}>"]).first()
    assert chained.predicted_value == "<hello!>!" and chained.llm_cost == 5 + 8
    assert providers.passes(df).count() == 4


def test_prompts():
    with pytest.raises(ValueError):
        prompts.check_prompt("no place")
    with pytest.raises(ValueError):
        prompts.check_labels([prompts.ModelSpec("a"), prompts.ModelSpec("b", label="a")])
    spec = prompts.ModelSpec("a", manipulations=["prompt_repetition", "prompt_repetition_x3", "few_shot"])
    out = prompts.prepare("Do {content}", spec, [("doc", "lab")])
    assert out.count("Do ") == 3 and "Document: doc\nLabel: lab" in out
    assert prompts.parse_examples("Document: a\nb\nLabel: x\n2. document: c\nlabel: y\nDocument: lost") == [("a\nb", "x"), ("c", "y")]
    assert prompts.task_type(["pos", '{"a": [1]}']) == "extraction" and prompts.task_type(["pos"]) == "classification"
    assert list(prompts.with_explanation({"properties": {"a": {}}})["properties"]) == ["explanation", "a"]


def test_sources_and_experiment(spark, tmp_path):
    (tmp_path / "d.csv").write_text('id,content,topic,empty\n1,"a, b",x,\n')
    r = readers.documents_csv(spark, str(tmp_path / "d.csv")).first()
    assert r.content == "a, b" and r.metadata == {"topic": "x"}
    (tmp_path / "l.csv").write_text("document_id,label\n1,pos\n")
    assert readers.labels_csv(spark, str(tmp_path / "l.csv")).first().value == "pos"
    (tmp_path / "c.json").write_text(json.dumps([{"id": 1, "content": "t", "label": {"b": 1}, "attachments": ["x.png"]}, {"id": 2, "content": "u"}]))
    docs, labels = readers.combined_json(spark, str(tmp_path / "c.json"))
    assert docs.count() == 2 and json.loads(labels.first().value) == {"b": 1}
    docs, labels = readers.in_memory(spark, [{"content": "good", "label": "pos"}, {"id": "z", "content": "bad", "label": "neg"}, {"content": "?"}])
    assert sorted(x.id for x in docs.collect()) == ["doc_0", "doc_2", "z"]
    exp = Experiment(spark, docs, labels, "Judge {content}", [prompts.ModelSpec("m")], providers.Scripted(lambda m, p: "pos"))
    table = exp.run(str(tmp_path / "run")).first()
    assert (table.predictions, table.correct) == (2, 1)
    assert "<h1>" in (tmp_path / "run/report.html").read_text()
    exp.add_models([prompts.ModelSpec("n", cost_rate=3600.0)])
    assert exp.evaluate(done=exp.results).groupBy("model").count().count() == 2
    again = exp.reevaluate(spark.createDataFrame([("z", "pos")], "document_id string, value string"))
    assert again.where("is_correct").count() == 4
    (tmp_path / "old/models").mkdir(parents=True)
    (tmp_path / "old/models/m.json").write_text(json.dumps({"run_id": "r", "model": "m", "label": "m", "status": "completed", "predictions": [{"document_id": "1", "is_correct": True}]}))
    (tmp_path / "old/models/bad.json").write_text("{")
    row = [x for x in readers.model_files(spark, str(tmp_path / "old")).collect()]
    assert len(row) == 1 and row[0].example_score == 1.0 and row[0].label is None
    writers.write_predictions(exp.results, str(tmp_path / "p"))
    write_report(exp.results.limit(0), str(tmp_path / "empty.html"))


def test_streaming(spark, tmp_path):
    rows = [(f"d{i % 3}", "m", i, 0.5) for i in range(6)]
    df = spark.createDataFrame(rows, "document_id string, model string, s int, llm_cost double").withColumn("at", F.timestamp_seconds(F.col("s") * 60))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    progress.stage(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    staged = spark.read.parquet(str(tmp_path / "out"))
    assert staged.count() == 6
    assert progress.progress(staged, 3).first().completed
    q = progress.progress(stream, 3).writeStream.format("memory").queryName("prog").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("prog").collect()] == [("m", 3, 3, True)]
    q = progress.throughput(stream, "at").writeStream.format("memory").queryName("thr").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM thr").first().n == 6
    q = progress.once(stream, ["document_id"], "at").writeStream.format("memory").queryName("uniq").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("uniq").count() == 3


def stage(spark, files):
    rows = [(f, "s", f, n, line) for f, lines in files for n, line in enumerate(lines)]
    return spark.createDataFrame(rows, "file_id bigint, stream_name string, w bigint, line_no int, line_text string").withColumn("written_at", F.timestamp_seconds("w"))


def test_drift(spark):
    a = [json.dumps({"hash": str(i), "llm_cost": i / 8, "ok": i % 2 == 0, "cost": {"x": i, "y": 1}, "gone": 1}) for i in range(8)]
    b = [json.dumps({"hash": str(i), "llmCost": str(i / 8), "ok": i % 2, "cost": {"z": i, "y": 1}, "new": None}) for i in range(8)] + ["", "{cut", "7", None]
    got = {(r.file_id, r.change_kind, r.old_field, r.new_field) for r in drift.changes(stage(spark, [(1, a), (2, b)])).collect()}
    assert got == {(2, "renamed", "llm_cost", "llmCost"), (2, "retyped", "llm_cost", "llmCost"), (2, "retyped", "ok", "ok"), (2, "renamed", "cost.x", "cost.z"), (2, "removed", "gone", ""), (2, "added", "", "new")}
    wide = drift.unify(stage(spark, [(1, a), (2, b)]))
    # Two names used equally often go by the first; numbers win over as many booleans.
    assert wide.count() == 16 and wide.where("llmCost IS NULL OR ok IS NULL").count() == 0 and dict(wide.dtypes)["ok"] == "double"
    assert drift.changes(stage(spark, [(1, a), (2, b)]).limit(0)).count() == 0


def test_unify_members(spark):
    a = [json.dumps({"hash": str(i), "cost": {"llm": i / 8, "cur": "USD", "deep": {"q": 1}}, "answer": '{"k": 1}', "l": [1]}) for i in range(8)]
    b = [json.dumps({"hash": str(i), "cost": {"llm_cost": str(i / 8), "cur": "USD"}, "answer": "x", "l": [2]}) for i in range(9)]
    c = [json.dumps({"hash": "20", "cost": [{"key": "llm_cost", "val": 2.5}, {"key": "cur", "val": "EUR"}]}), json.dumps({"hash": "21", "cost": '{"llm": 3.5}'}), json.dumps({"hash": "22", "cost": {}}), json.dumps({"hash": "23", "cost": [7]})]
    wide = drift.unify(stage(spark, [(1, a), (2, b), (3, c)]))
    assert dict(wide.dtypes) == {"file_id": "bigint", "line_no": "int", "answer": "string", "cost": "string", "cost.cur": "string", "cost.deep": "string", "cost.llm_cost": "double", "hash": "double", "l": "string"} | {"hash": dict(wide.dtypes)["hash"]}
    got = {(r.file_id, r.line_no): r for r in wide.collect()}
    assert [got[1, 3][x] for x in ("cost.llm_cost", "cost.cur", "cost.deep", "cost", "answer", "l")] == [0.375, "USD", '{"q":1}', None, '{"k": 1}', "[1]"]
    assert got[2, 3]["cost.llm_cost"] == 0.375 and got[2, 3].answer == "x"
    assert [got[3, i]["cost.llm_cost"] for i in range(4)] == [2.5, 3.5, None, None] and got[3, 0]["cost.cur"] == "EUR"
    assert [got[3, i].cost for i in range(4)] == [None, None, "{}", "[7]"] and len(got) == 21


def test_unify_keeps_every_cell(spark, sf, monkeypatch):
    lines = spark.read.parquet(f"{sf}/staging_lines.parquet")
    cells = drift._members(lines, producer="stream_name", file="file_id", written="written_at", line="line_text").where("NOT (filled AND parent = '')").distinct().count()
    filled = lambda w, skip: sum(r for r in w.select(*[F.count(F.col(f"`{c}`")) for c in w.columns if c not in skip]).first())
    assert filled(drift.unify(lines), ("file_id", "line_no")) == cells
    monkeypatch.setattr(drift, "MAX_COLUMNS", 5)
    few = drift.unify(lines)
    assert len(few.columns) == 8 and filled(few, ("file_id", "line_no", drift.REST)) + few.agg(F.sum(F.size(drift.REST))).first()[0] == cells


def test_nested(spark):
    objects = lambda t: None if (v := nested.find_json(t)) is None else nested.object_paths(v)
    assert sorted(objects('{"a": {"b": [{"c": 1}, {}]}, "d": 1}')) == [("$", ""), ("$.a", "$"), ("$.a.b[0]", "$.a"), ("$.a.b[1]", "$.a")]
    assert objects('Sure!\n```json\n[{"a": 1}]\n``` ok') == [("$[0]", "")]
    assert objects(json.dumps(json.dumps({"a": 1}))) == [("$", "")] and objects('Result: "{\\"a\\": 1}"') == [("$", "")]
    assert objects('{"a": {"b": 1}, "c') is None and objects("text") is None and objects("") is None and objects(None) is None
    assert nested.table_of("$.a[10].b[x][2]") == "$.a[*].b[x][*]"
    df = spark.createDataFrame([(1, '{"a": "x", "n": null, "l": [1, 2], "o": {"k": true}}', "junk"), (1, '{"a": "x", "n": null, "l": [1, 2], "o": {"k": true}}', "junk"), (2, None, "y"), (3, "{" * 5000, "z")], "id int, v string, node_path string")
    rows = {r.node_path: r for r in nested.flatten(df, "id", ["v"]).collect()}
    assert rows["$"].attributes == {"a": "x", "l": "[1, 2]"} and rows["$.o"].attributes == {"k": "true"} and len(rows) == 2
    assert nested.flatten(df.limit(0), "id", ["v"]).count() == 0


def test_nested_tables_rebuild_the_json(spark):
    value = {"a": "x", "list": [{"n": "1", "deep": {"k": "v"}}, {"n": "2", "node_path": "p"}], "o": {"e": {}}}
    df = spark.createDataFrame([(None, json.dumps(value)), (None, '{"b": "y"}'), (None, '{"b": "y"}'), (7, "Note [see text]: " + json.dumps(value))], "id int, v string")
    nodes = nested.flatten(df, "id", ["v"]).cache()
    assert nodes.where("id IS NULL").count() == 7 and nodes.where("id = 7").count() == 6
    one = nodes.where("id = 7")
    tables = {r.table_path: (r.parent_table, r.columns, r.n) for r in nested.table_paths(one).collect()}
    assert tables == {"$": (None, ["a"], 1), "$.list[*]": ("$", ["n", "node_path"], 2), "$.list[*].deep": ("$.list[*]", ["k"], 1), "$.o": ("$", [], 1), "$.o.e": ("$.o", [], 1)}
    part = nested.as_table(one, "id", "v", "$.list[*]")
    assert part.columns == ["id", "node_path", "parent_path", "ordinal", "n", "node_path_"] and [(r.ordinal, r.n, r.node_path_) for r in part.orderBy("ordinal").collect()] == [(0, "1", None), (1, "2", "p")]
    # Every table's rows joined to their parents give the record back.
    rows = {r.node_path: dict(r.attributes) for r in one.collect()}
    back = rows["$"] | {"list": [rows["$.list[0]"] | {"deep": rows["$.list[0].deep"]}, rows["$.list[1]"]], "o": rows["$.o"] | {"e": rows["$.o.e"]}}
    assert back == value and all(r.parent_path in rows for r in one.where("parent_path <> ''").collect())


def test_object_paths_come_from_pivoted_triples(monkeypatch):
    seen, triples = [], nested.triples
    monkeypatch.setattr(nested, "triples", lambda v: seen.append(v) or triples(v))
    value = {"a": {"b": [{"c": 1}, {}]}, "d": 1}
    assert nested.object_paths(value) == [r[:2] for r in nested.pivot(value)] and seen == [value, value]


def test_nested_keeps_list_scalars(spark):
    attributes = lambda v: {(r[0], r[1], r[2]): r[4] for r in nested.pivot(v)}
    root = ("$", "", "$")
    assert attributes({"n": ["see text", {"line": 2}, None]}) == {root: {"n[0]": "see text"}, ("$.n[1]", "$", "$.n[*]"): {"line": "2"}}
    assert attributes({"m": [[1, 2], [3, [4]], []]}) == {root: {"m[0]": "[1, 2]", "m[1][0]": "3", "m[1][1]": "[4]", "m[2]": "[]"}}
    assert attributes({"a[0]": "x", "b]": 1, "a": ["y", {}]}) == {root: {"a[0]": "x", "b]": "1", "a[0]'": "y"}, ("$.a[1]", "$", "$.a[*]"): {}}
    assert attributes({"a.b": {"x": 1}, "a": {"b": {"x": 2}}}) == {root: {}, ("$.a.b", "$", "$.a.b"): {"x": "1"}, ("$.a", "$", "$.a"): {}, ("$.a.b", "$.a", "$.a.b"): {"x": "2"}}
    assert attributes({"k[0]": {}}) == {root: {}, ("$.k[0]", "$", "$.k[0]"): {}}
    top = ["see text", {"line": 2}]
    assert attributes(top) == {("$[1]", "", "$[*]"): {"line": "2"}, root: {"$[0]": "see text"}} and nested.object_paths(top) == [("$[1]", "")]
    df = spark.createDataFrame([(1, json.dumps(top)), (2, '["a", "b"]')], "id int, v string")
    assert {(r.id, r.node_path): r.attributes for r in nested.flatten(df, "id", ["v"]).collect()} == {(1, "$[1]"): {"line": "2"}, (1, "$"): {"$[0]": "see text"}, (2, "$"): {"$": '["a", "b"]'}}
    assert [(r.id, r.node_path) for r in nested.flatten(df, "id", ["v"], attributes=False).collect()] == [(1, "$[1]")]


def test_text_queries_hold_all_scripts(spark, tmp_path):
    from tallymark import catalog

    sides = ["plain", " PLAIN\t", "Ünï", "\u3000üNÏ\u00a0", "ПРИВЕТ", "привет\u2003", "日本", "日 本", "日\u3000本", "ß", "ss", "", None]
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in sides for b in sides)]
    spark.createDataFrame([(*p, "topic") for p in pairs], "prediction_id int, predicted_value string, expected_value string, use_case string").write.parquet(str(tmp_path / "predictions.parquet"))
    spark.createDataFrame(pairs, "pair_id int, a string, b string").write.parquet(str(tmp_path / "text_pairs.parquet"))
    want = lambda f: {i: None if a is None or b is None else f(a.strip()) == f(b.strip()) for i, a, b in pairs}
    same, same_case, packed = want(str.lower), want(str), want(lambda x: x.lower().replace(" ", ""))
    assert {r.prediction_id: r.score for r in catalog.QUERIES["equality_scores"](spark, str(tmp_path)).collect()} == same
    got = {r.pair_id: tuple(r)[1:] for r in catalog.QUERIES["exact_comparisons"](spark, str(tmp_path)).collect()}
    assert got == {i: (same[i], same_case[i], packed[i]) for i in same}


def test_effective_costs_keep_unmeasured_costs(spark, tmp_path):
    from tallymark import catalog

    rows = [(1, "m", float("nan"), 1800.0), (2, "m", 0.5, 1800.0), (3, "m", 0.0, 3600.0), (4, "m", None, float("nan"))]
    spark.createDataFrame(rows, "prediction_id int, model string, llm_cost double, response_time double").write.parquet(str(tmp_path / "predictions.parquet"))
    got = {r.prediction_id: (r.cost, r.cost_at_rate) for r in catalog.QUERIES["effective_costs"](spark, str(tmp_path)).collect()}
    assert got == {1: (None, 2.5), 2: (0.5, 2.5), 3: (1.212, 5.0), 4: (None, None)}


def test_every_core_query_runs(spark, sf):
    from tallymark import catalog

    for name, q in catalog.QUERIES.items():
        df = q(spark, sf)
        assert len(set(df.columns)) == len(df.columns), name
        df.write.format("noop").mode("overwrite").save()
