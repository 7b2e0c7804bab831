import json

import pytest
from pyspark.sql import functions as F

from tallymark import cli
from tallymark.functions import media
from tallymark.operators import classifier, metrics, reports, sampling
from tallymark.operators.scoring import FieldConfig
from tallymark.plans import decomposed, fewshot, prompts, providers, schemas, settings
from tallymark.plans.experiment import Experiment, by_function, recommendation, rescore_or_keep
from tallymark.plans.prompts import ModelSpec
from tallymark.sources import readers, writers


def Logged(path, answer):  # a class of its own, so that workers need not import this file
    class Provider:
        """Answers by a function and notes every call in a file."""

        def complete(self, model, prompt, temperature=0.0):
            with open(str(path), "a") as f:
                f.write("call\n")
            return providers.Answer(answer(model, prompt), 0.5, 1.0)

        def calls(self):
            try:
                with open(str(path)) as f:
                    return len(f.readlines())
            except FileNotFoundError:
                return 0

    return Provider()


DOCS = [{"id": f"d{i}", "content": f"text {i}", "label": "pos" if i % 2 else "neg"} for i in range(6)]


def test_no_answer_is_asked_for_twice(spark, tmp_path):
    docs, labels = readers.in_memory(spark, DOCS)
    log = Logged(tmp_path / "log", lambda m, p: "pos")
    make = lambda prompt="Judge {content}": Experiment(spark, docs, labels, prompt, [ModelSpec("m"), ModelSpec("k")], log, staging=str(tmp_path / "staging"))
    exp = make()
    exp.evaluate()
    assert log.calls() == 12
    exp.save(str(tmp_path / "run"))
    exp.model_metrics().collect()
    exp.reevaluate().count()
    assert make().evaluate().count() == 12 and log.calls() == 12  # resumed after a stop
    assert make("Other {content}").evaluate().count() == 12 and log.calls() == 24  # another input
    again = Experiment.restore(spark, str(tmp_path / "run"))
    assert again.prompt == "Judge {content}" and [m.name for m in again.models] == ["m", "k"] and again.in_order().collect()[0].model == "m"
    assert again.reevaluate(spark.createDataFrame([("d0", "pos")], "document_id string, value string")).where("is_correct").count() == 8
    lazy = Experiment(spark, docs, labels, "Judge {content}", [ModelSpec("m")], log)
    lazy.evaluate()
    lazy.results.count(), lazy.model_metrics().collect()
    assert log.calls() == 30


def test_failed_answers_are_asked_for_again(spark, tmp_path):
    docs, labels = readers.in_memory(spark, DOCS[:2])
    flag = tmp_path / "up"

    def answer(m, p):
        if not flag.exists():
            raise RuntimeError("down")
        return "pos"

    log = Logged(tmp_path / "log", answer)
    exp = Experiment(spark, docs, labels, "Judge {content}", [ModelSpec("m")], log, staging=str(tmp_path / "s"))
    assert exp.evaluate().where("predicted_value LIKE 'ERROR:%' AND NOT is_correct AND llm_cost = 0").count() == 2
    flag.touch()
    assert exp.evaluate().where("predicted_value = 'pos'").count() == 2 and log.calls() == 4


def test_run_folder(spark, tmp_path):
    docs, labels = readers.in_memory(spark, DOCS)
    log = Logged(tmp_path / "log", lambda m, p: "pos")
    out = str(tmp_path / "run")
    exp = Experiment(spark, docs, labels, "Judge {content}", [ModelSpec("a/b")], log)
    assert exp.run(out).first().correct == 3
    state = json.loads((tmp_path / "run/progress.json").read_text())
    assert state["models"] == [{"name": "a/b", "docs_done": 6, "docs_total": 6, "completed": True}] and not (tmp_path / "run/staging").exists()
    assert "Evaluation" in (tmp_path / "run/report.html").read_text()
    exp.add_models([ModelSpec("c")])
    assert exp.run(out).count() == 2 and log.calls() == 12  # the first model is not asked again
    writers.write_status(spark, out, "more")
    assert json.loads((tmp_path / "run/progress.json").read_text())["started_at"] == state["started_at"]


def test_ways_of_asking(spark, tmp_path):
    schema = {"type": "object", "properties": {"e": {"type": "object", "properties": {"p": {"type": "array", "items": {"type": "string"}}, "q": {"type": "array", "items": {"type": "string"}}}}}}
    docs, labels = readers.in_memory(spark, [{"id": "1", "content": "Ann met Bo", "label": {"e": {"p": ["Ann"], "q": ["Bo"]}}}])

    def answer(model, prompt):
        if "Extract p" in prompt:
            return '```json\n{"p": ["Ann", "Zed"]}\n```'
        if "Extract q" in prompt:
            return '["Bo"]'
        return json.dumps({"e": {"p": ["Ann"], "q": []}})

    log = Logged(tmp_path / "log", answer)
    models = [ModelSpec("m", label="split", manipulations=["decompose", "hallucination_filter"]), ModelSpec("m", label="twice", manipulations=["multi_pass"], passes=3), ModelSpec("m")]
    exp = Experiment(spark, docs, labels, "Find {content}", models, log, schema=schema, config=FieldConfig.parse({"type": "object", "fields": {"e": {"type": "object", "fields": {k: {"type": "list", "fields": {}, "metric_config": {"item_logic": {}}} for k in "pq"}}}}))
    got = {r.model: r for r in exp.evaluate().collect()}
    assert json.loads(got["split"].predicted_value) == {"e": {"p": ["Ann"], "q": ["Bo"]}} and got["split"].is_correct and got["split"].llm_cost == 1.0
    assert json.loads(got["twice"].predicted_value) == {"e": {"p": ["Ann"], "q": []}} and got["twice"].llm_cost == 1.5 and not got["m"].is_correct
    assert log.calls() == 2 + 3 + 1
    assert exp.field_results().where("model = 'm' AND field = 'e.q'").first().recall == 0.0


def test_decomposition_parts(spark):
    schema = {"properties": {"a": {"type": "array"}, "b": {"type": "array"}}}
    assert list(decomposed.field_prompts("Do {content}", schema)) == ["a", "b"] and decomposed.field_prompts("Do {content}", {}) == {}
    with pytest.raises(ValueError):
        decomposed.field_prompts("Do {content}", schema, {"a": "x"})
    ex = spark.createDataFrame([("t", '{"a": [1], "b": []}'), ("u", "broken"), ("v", None)], "document string, label string")
    assert [(r.field, r.document, r.label) for r in decomposed.split_examples(ex, ["a", "b"]).collect()] == [("a", "t", "[1]")]
    one = lambda text: providers.Scripted(lambda m, p: text)
    assert decomposed.rewrite("Do {content}", one("```\nBetter {content}\n```"), "m") == "Better {content}" and decomposed.rewrite("Do {content}", one("lost it"), "m") == "Do {content}"
    assert decomposed.steps_of("p", one('["x", "y"]'), "m") == ["x", "y"] and decomposed.steps_of("p", one("no"), "m") == ["p"]
    rows = spark.createDataFrame([("1", '{"a": ["Ann", "Zed"]}', "Ann", )], "id string, predicted_value string, content string")
    kept = spark.createDataFrame([("1", "Zed", True)], "id string, value string, grounded boolean")
    assert decomposed.verified(rows).first().predicted_value == '{"a": ["Ann"]}' and decomposed.verified(rows, verdicts=kept).first().predicted_value == '{"a": ["Ann", "Zed"]}'
    assert decomposed.filtered(rows, lambda v, d: v[:3] + d).first().predicted_value == '{"aAnn'
    scored = spark.createDataFrame([(True, 1.0, 2.0), (False, 1.0, 2.0)], "is_correct boolean, llm_cost double, response_time double")
    assert {r.way: r.accuracy for r in decomposed.compare(scored, scored.where("is_correct")).collect()} == {"whole": 0.5, "split": 1.0}


def test_few_shot(spark):
    seeds = [("good stuff", "pos"), ("bad stuff", "neg")]
    model = providers.Scripted(lambda m, p: "Document: new one\nLabel: pos" if "label pos" in p else "Document: other\nsecond line", 0.01)
    made = fewshot.generate(spark, seeds, "g", model, 3)
    rows = {r.example_id: r for r in made.collect()}
    assert [(rows[k].document, rows[k].label) for k in sorted(rows)] == [("new one", "pos"), ("new one", "pos"), ("other\nsecond line", "neg")]
    judge = providers.Scripted(lambda m, p: "correct\nfine" if "new one" in p or m == "v1" else "incorrect", 0.01)
    votes = fewshot.validate(made, ["v1", "v2"], judge)
    assert votes.where("is_correct").count() == 5
    assert [r.document for r in fewshot.chosen(made, votes).collect()] == ["new one", "new one"]
    total = {(r.stage, r.model): r.cost for r in fewshot.costs(made, votes).collect()}
    assert total[None, None] == pytest.approx(sum(v for k, v in total.items() if k != (None, None))) and len(total) == 4
    assert sorted(r.label for r in fewshot.label_schedule(spark, ["x", "y"], 3).collect()) == ["x", "x", "y"]
    assert json.loads(fewshot.shape('{"a": [{"b": 1}], "c": "x"}')) == {"a": [{"b": ""}], "c": ""} and fewshot.shape("plain") == "plain"
    with pytest.raises(ValueError):
        fewshot.generate(spark, [], "g", model, 1)
    docs = spark.createDataFrame([("b", "x", "l"), ("a", "y", "l"), ("c", None, "l")], "id string, content string, expected_value string")
    assert fewshot.seeds(docs, 5) == [("y", "l"), ("x", "l")]


def test_schemas(spark):
    inferred = schemas.infer_schema({"a": [{"b": 1}], "c": True, "d": None, "e": 1.5})
    assert schemas.to_struct(inferred).simpleString() == "struct<a:array<struct<b:bigint>>,c:boolean,d:string,e:double>"
    tree = {"type": "object", "properties": {"kids": {"type": "array", "items": {"$ref": "#/$defs/n"}}, "when": {"type": "string", "format": "date"}, "x": {"type": ["integer", "null"]}, "y": {"anyOf": [{"type": "string"}, {"type": "integer"}]}}, "$defs": {"n": {"type": "object", "properties": {"kids": {"type": "array", "items": {"$ref": "#/$defs/n"}}}}}}
    assert schemas.to_struct(tree).simpleString() == "struct<kids:array<struct<kids:array<variant>>>,when:date,x:bigint,y:variant>"
    with pytest.raises(ValueError):
        schemas.to_struct({"type": "string"})
    rule = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 2, "multipleOf": 2}, "s": {"type": "string", "pattern": "^a", "enum": ["ab", "b"]}, "l": {"type": "array", "minItems": 1, "items": {"type": "number"}}, "d": {"type": "string", "format": "date"}, "o": {"anyOf": [{"type": "string"}, {"type": "null"}]}}}
    rows = {"ok": {"n": 4, "s": "ab", "l": [1, 2.5], "d": "2025-01-01", "o": None}, "missing": {}, "odd": {"n": 3}, "low": {"n": 0}, "text": {"n": "4"}, "pattern": {"n": 2, "s": "b"}, "enum": {"n": 2, "s": "ax"}, "short": {"n": 2, "l": []}, "item": {"n": 2, "l": [1, "x"]}, "date": {"n": 2, "d": "soon"}, "branch": {"n": 2, "o": 5}, "list": [1]}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()] + [("broken", "{"), ("null", None)], "document_id string, value string")
    got = {r.document_id: r.problems for r in schemas.violations(df, rule).collect()}
    assert set(got) == set(rows) - {"ok"} | {"broken", "null"} and got["odd"] == ["$.n: multipleOf"] and got["item"] == ["$.l[*]: not of type number"] and got["missing"] == ["$.n: not of type integer"]
    with pytest.raises(ValueError):
        schemas.check_labels(df, rule)
    schemas.check_labels(df.where("document_id = 'ok'"), rule)
    plain = spark.createDataFrame([("1", "a"), ("2", None)], "document_id string, value string")
    one = {"properties": {"label": {"type": "string"}}}
    assert [r.value for r in schemas.wrap_labels(plain, one).orderBy("document_id").collect()] == ['{"label":"a"}', None]
    mixed = plain.unionByName(spark.createDataFrame([("3", '{"x": 1}')], "document_id string, value string"))
    assert schemas.wrap_labels(mixed, one).where("value = 'a'").count() == 1 and schemas.wrap_labels(plain, None) is plain
    assert schemas.schema_of_labels(plain)["properties"]["label"]["enum"] == ["a"] and schemas.envelope(one)["json_schema"]["schema"] is one
    assert schemas.json_block('Say so: {"a": 1} now') == {"a": 1} and schemas.json_block("none {content}") is None


def test_settings():
    raw = {"models": ["p/m", {"name": "q", "params": {"top_p": 1}, "manipulations": ["explanation"]}], "prompt": "Do {content}", "output_dir": "out"}
    config = settings.RunConfig.parse(raw)
    assert config.folder() == "out" and config.folder("x") == "x" and settings.arguments(config.models[1], 0.2) == {"temperature": 0.2, "top_p": 1}
    for change in ({"models": ["a", "a"]}, {"prompt": "none"}, {"odd": 1}, {"models": [{"name": "a", "manipulations": ["magic"]}]}, {"models": [{"name": "a", "type": "oracle"}]}, {"models": [{"name": "a", "cost_rate_time_unit": "moon"}]}):
        with pytest.raises(ValueError):
            settings.RunConfig.parse(raw | change)
    s = settings.Settings.from_env({"TALLYMARK_RETRIES": "5", "P_API_KEY": "k"})
    assert (s.retries, s.per_minute, s.keys) == (5, None, {"p": "k"}) and settings.preflight(config, s) == []
    with pytest.raises(ValueError):
        settings.preflight(config, settings.Settings())
    with pytest.raises(ValueError):
        settings.preflight(settings.RunConfig.parse(raw | {"models": [{"name": "m", "manipulations": ["decompose"]}]}))
    with pytest.raises(ValueError):
        settings.RunConfig.parse({"models": ["m"], "prompt": "{content}"}).folder()
    assert settings.scoring_config(None, {"a": 1}).type == "object" and settings.scoring_config(None, "x") is None


def test_catalog(spark):
    cat = spark.createDataFrame([("b", 1.0, 2.0, "p", "chat", 200_000), ("a", 0.0, 0.0, "p", "chat", None), ("e", 1.0, None, "p", "embedding", 5)], "name string, input_cost_per_token double, output_cost_per_token double, litellm_provider string, mode string, max_input_tokens bigint")
    assert [r.name for r in settings.available(cat).collect()] == ["a", "b", "e"] and [r.name for r in settings.suggested(cat, ["a"]).collect()] == ["b"]
    assert settings.priced(cat, "b", 2, 1) == 4.0
    for bad in (("e", 1, 1), ("zz", 1, 1), ("b", -1, 0)):
        with pytest.raises(ValueError):
            settings.priced(cat, *bad)
    assert {r.name: (r.chat, r.free, r.long_context) for r in settings.capabilities(cat).collect()} == {"a": (True, True, False), "b": (True, False, True), "e": (False, False, False)}
    takes = spark.createDataFrame([("m", "top_p")], "model string, parameter string")
    config = settings.RunConfig.parse({"models": [{"name": "m", "params": {"top_p": 1, "seed": 2}}], "prompt": "{content}"})
    assert settings.preflight(config, supports=takes) == ["m does not take seed"]


def test_provider_parameters(spark):
    asked = []

    def raw(model, prompt, **params):
        asked.append(params)
        if "temperature" in params:
            raise providers.Unsupported("temperature")
        return providers.Answer("ok")

    assert providers.Retrying(providers.Parametrised(raw, {"m": {"top_p": 1, "seed": 3}}, {"m": {"seed"}})).complete("m", "p").text == "ok"
    assert asked == [{"temperature": 0.0, "top_p": 1}, {"top_p": 1}]
    slept = []
    limited = providers.Limited(providers.Scripted(lambda m, p: p), 4, clock=lambda: 0.0, sleep=slept.append, workers=2)
    for _ in range(3):
        limited.complete("m", "p")
    assert slept == [60.0]
    counted = providers.Counted.over(spark, providers.Scripted(lambda m, p: p if p != "x" else 1 / 0, 1.0))
    providers.predict(spark.createDataFrame([("m", "ab"), ("m", "x")], "model string, prompt string"), counted).collect()
    assert (counted.calls.value, counted.failures.value, counted.cost.value) == (2, 1, 2.0)


def test_adapters_and_strategies(spark, tmp_path):
    asked = []

    def call(**given):
        asked.append(given)
        return {"output": [{"content": [{"text": "a"}, {"text": "b"}]}, {}], "cost": 2}

    got = providers.Responses(call, schemas.envelope({"type": "object"})).complete("m", "p", None)
    assert (got.text, got.cost) == ("ab", 2.0) and asked[0]["text"]["format"]["schema"] == {"type": "object"} and "temperature" not in asked[0]
    assert prompts.prepare("do {content}", ModelSpec("m"), strategies=(str.upper, lambda p: p.replace("{CONTENT}", "{content}"))) == "DO {content}"
    with pytest.raises(ValueError):
        prompts.prepare("do {content}", ModelSpec("m"), strategies=(lambda p: "lost",))
    from tallymark.streaming import progress

    seen = str(tmp_path / "seen")

    def note(row):
        with open(seen, "a") as f:
            f.write(f"{row.document_id}\n")

    spark.createDataFrame([("d1",), ("d2",)], "document_id string").write.parquet(str(tmp_path / "in"))
    progress.each(spark.readStream.schema("document_id string").parquet(str(tmp_path / "in")), note, str(tmp_path / "ck")).awaitTermination()
    with open(seen) as f:
        assert sorted(f.read().split()) == ["d1", "d2"]


def test_prompt_words():
    add = prompts.add_explanation
    assert add("Explain it {content}") == "Explain it {content}" and "JSON" not in add("Say {content}") and "replaces" in add("Give only the label. {content}")
    assert '"explanation": "why", "a": 1' in add('Return {"a": 1} for {content}') and "member" in add("Answer in JSON: {content}") and "member" in add("x {content}", {"properties": {}})
    assert prompts.for_field("Do {content} well", "people", "Names only.").index("Do {content}") == 0 and prompts.missing_fields(["a", "b"], {"a": "x"}) == ["b"]
    shown = prompts.prepare("Do {content}", ModelSpec("m", manipulations=["few_shot"]), [("d", '{"a": [1]}')])
    assert "extracted" in shown


def test_parsed_example_rows(spark):
    df = spark.createDataFrame([(1, "Document: a\nb\nLabel: x\nDocument: c\nLabel: y"), (2, None), (3, "no")], "id int, text string")
    assert [(r.id, r.ordinal, r.document, r.label) for r in prompts.parsed_examples(df).orderBy("ordinal").collect()] == [(1, 0, "a\nb", "x"), (1, 1, "c", "y")]


def test_media(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"%PDF-1.4")
    docs = spark.createDataFrame([(1, ["data:image/png;base64,iVBORw0KGgo=", "a.bin", None, "http://x/y.gif?z=1"]), (2, None), (3, ["data:text/plain,hi%20you", "http://x/none"])], "id int, attachments array<string>")
    files = media.attachments(docs, "id")
    assert files.count() == 5
    got = {r.url: (r.media, None if r.data is None else bytes(r.data)) for r in media.load(files, str(tmp_path), lambda u: b"GIF89a" if "gif" in u else 1 / 0).collect()}
    assert got["a.bin"] == ("application/pdf", b"%PDF-1.4") and got["http://x/y.gif?z=1"] == ("image/gif", b"GIF89a") and got["data:text/plain,hi%20you"] == ("text/plain", b"hi you") and got["http://x/none"] == (None, None)
    assert got["data:image/png;base64,iVBORw0KGgo="][1][:4] == b"\x89PNG"
    models = spark.createDataFrame([("m",), ("k",)], "model string")
    takes = spark.createDataFrame([("m", "image/png"), ("m", "image/gif"), ("k", "image/png")], "model string, media string")
    bad = {(r.model, r.url) for r in media.refused(files, models, takes).collect()}
    assert ("k", "http://x/y.gif?z=1") in bad and ("m", "http://x/y.gif?z=1") not in bad and ("m", "a.bin") in bad
    parts = {r.id: [(p.kind, p.media) for p in r.m] for r in docs.select("id", media.message(F.lit("ask"), F.col("attachments")).alias("m")).collect()}
    assert parts == {1: [("text", None), ("image", "image/png"), ("image", "image/gif")], 2: [("text", None)], 3: [("text", None)]}
    assert {r.kind for r in media.for_report(media.load(files)).collect()} == {"image", "file"}


def test_reports(spark):
    table = spark.createDataFrame([("a", 0.5, 0.25, 1.0, 0.1, 4.0, 2.0), ("b", 0.123456, None, None, None, 8.0, 1.0)], "model string, accuracy double, average_score double, total_cost double, average_cost double, total_time double, average_time double")
    assert [r.model for r in reports.chart_rows(table).collect()] == ["a", "b"] and reports.chart_rows(table).collect()[1].accuracy == 12.35
    fields = spark.createDataFrame([("a", "x.y", 0.5, 1.0, 2 / 3, "exact"), ("b", "x.y", 1.0, 0.0, 0.0, "exact"), ("a", "x.z", 0.0, 0.0, 0.0, "llm")], "model string, field string, `precision` double, recall double, f1 double, metric string")
    assert {r.field: (r.best_precision, r.best_recall) for r in reports.field_best(fields).collect()} == {"x.y": (1.0, 1.0), "x.z": (0.0, 0.0)}
    tree = {r.path: (r.parent, r.depth, r.leaf, r.method) for r in reports.field_tree(fields, "metric").collect()}
    assert tree == {"x": ("", 1, False, None), "x.y": ("x", 2, True, "exact"), "x.z": ("x", 2, True, "llm")}
    assert [r.field for r in reports.field_names(fields).collect()] == ["x.y", "x.z"] and len(reports.summary(table, fields)) == 5
    assert reports.recommended(table, "I would take b or a") == "a" and reports.recommended(table, "?") is None and recommendation(table) .startswith("a is right")
    assert recommendation(table, providers.Scripted(lambda m, p: "take b")) == "take b"
    assert {(r.measure, r.model): r.share for r in reports.bars(table).collect()}["total_time", "a"] == 0.5
    titles = spark.createDataFrame([("exact", {"b": "2", "a": "1"}), ("agg:min", None), ("mine", {})], "m string, p map<string,string>")
    assert [r.t for r in titles.select(reports.metric_title(F.col("m"), F.col("p")).alias("t")).collect()] == ["Exact match (a=1, b=2)", "Object, min", "mine"]
    preds = spark.createDataFrame([("1", "m", "x", "e", True, 1.0, 0.0, 1.0), ("1", "k", "y", None, False, 0.0, 0.0, 1.0)], "document_id string, model string, predicted_value string, expected_value string, is_correct boolean, example_score double, llm_cost double, response_time double")
    row = reports.document_details(preds, spark.createDataFrame([("1", "text")], "id string, content string")).first()
    assert (row.content, row.expected_value, [r.model for r in row.results]) == ("text", "e", ["k", "m"])
    kept = rescore_or_keep(preds.withColumn("evaluation_cost", F.lit(0.0)).withColumn("predicted_value", F.lit("no json")), FieldConfig("object"))
    assert {r.model: r.is_correct for r in kept.collect()} == {"m": True, "k": False}
    assert {r.model: r.is_correct for r in by_function(preds, lambda a, b: {"x": True}[a]).collect()} == {"m": True, "k": False}


def test_result_folders(spark, tmp_path):
    old = tmp_path / "old"
    old.mkdir()
    (old / "big_model_run1.json").write_text(json.dumps([{"id": 1, "content": "c", "label": "Yes ", "predicted_label": "yes", "cost": 2}, {"id": 2, "label": "no", "predicted_label": "yes"}]))
    (old / "full.json").write_text(json.dumps({"run_id": "r", "model": "f", "status": "completed", "predictions": [{"document_id": "1", "is_correct": True, "expected_value": "Yes"}]}))
    (old / "bad.json").write_text("{nope")
    got = {(r.model, r.document_id): (r.run_id, r.is_correct, r.example_score, r.llm_cost) for r in readers.result_dir(spark, str(old)).collect()}
    assert got == {("big_model", "1"): ("run1", True, 1.0, 2.0), ("big_model", "2"): ("run1", False, 0.0, 0.0), ("f", "1"): ("r", True, 1.0, None)}
    assert readers.is_legacy(spark, str(old)) and readers.any_results(spark, str(old)).count() == 3
    assert {r.document_id: r.content for r in readers.first_documents(readers.result_dir(spark, str(old))).collect()} == {"1": "c", "2": None}
    run, page = str(tmp_path / "run"), str(tmp_path / "out/r.html")
    assert cli.report(spark, str(old), page, convert=run) and not cli.report(spark, str(old), page) and not readers.is_legacy(spark, run)
    preds = spark.createDataFrame([("1", "a/b", "x", "x", True, 1.0, 1.0, 0.5, 0.0, "text")], "document_id string, model string, predicted_value string, expected_value string, is_correct boolean, example_score double, response_time double, llm_cost double, evaluation_cost double, content string")
    models = spark.createDataFrame([("a/b", "r1", "{content}", "completed")], "model string, run_id string, prompt_template string, status string")
    out = str(tmp_path / "files")
    writers.add_result(preds, models, out, "topic", "{content}")
    writers.add_result(preds, models, out, "topic", "{content}")
    assert json.loads((tmp_path / "files/metadata.json").read_text())["documents"] == [{"id": "1", "content": "text", "label": "x"}]
    row = readers.run_predictions(spark, out).first()
    assert (row.content, row.model, row.run_id, row.llm_cost) == ("text", "a/b", "r1", 0.5)
    (tmp_path / "lines.json").write_text('{"id": "1", "content": "a"}\nbroken\n')
    assert readers.json_lines(spark, str(tmp_path / "lines.json")).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.is_legacy(spark, str(tmp_path / "none"))


def test_code_commands(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text('from langchain_openai import ChatOpenAI\nimport openai\nP = "Hi {x}".format(x=1)\nclient = openai.OpenAI(base_url="https://api.perplexity.ai")\nclient.images.generate(prompt=P)\nclient.embeddings.create(input=make())\nChatOpenAI().invoke(P)\n')
    lines = cli.scan(spark, str(tmp_path), [], str(tmp_path / "scan"))
    assert "call_type image_generation: 1" in lines and "library langchain: 2" in lines and any(x.endswith("embeddings.create (low)") for x in lines)
    assert spark.read.json(str(tmp_path / "scan/instances")).where("notes LIKE 'result of%'").count() == 1
    assert cli.main(["providers"]) == 0 and "Perplexity (openai)" in capsys.readouterr().out


def test_classifier(spark):
    rows = [(str(i), "good fine lovely" if i % 2 else "bad awful sad", "pos" if i % 2 else "neg") for i in range(40)]
    df = spark.createDataFrame([*rows, ("x", None, "pos"), ("y", "good", None)], "id string, content string, label string")
    model = classifier.train(df, features=256)
    assert classifier.classify(df, model).where("predicted_value = label").count() >= 40
    out = classifier.predictions(df, model, "local")
    assert out.count() == 42 and out.where("document_id = 'y'").first().predicted_value == "pos"
    assert {r.label: r.f1 for r in classifier.evaluate(classifier.classify(df.where("content IS NOT NULL"), model)).collect()}["neg"] == 1.0
    with pytest.raises(ValueError):
        classifier.train(df.where("label = 'pos'"))


def test_hot_groups_keep_their_results(spark):
    rows = [(i, "hot" if i % 3 else None, float(i % 7) if i % 11 else None) for i in range(1, 500)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    want, sums = {}, {}
    for i, g, v in rows:
        if v is not None:
            sums[g] = sums.get(g, 0.0) + v
        want[i] = sums.get(g)
    got = {r.id: r.s for r in sampling.running_sum(df, "g", "id", F.col("v"), "s", 8).collect()}
    assert got == want
    assert sampling.running_sum(df.limit(0), "g", "id", F.col("v"), "s").count() == 0
    parts = sampling.split(df, "g", "id").groupBy("g", "part").count().collect()
    assert {(r.g, r.part): r["count"] for r in parts}[None, "train"] == -(-166 * 8 // 10)
