import itertools
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark.functions import assignment, similarity
from tallymark.operators.scoring import FieldConfig, JsonScorer, check_expensive, infer_config, match_text, score_columns, score_json

FUZZ = {"type": "leaf", "metric_config": {"metric": "text_similarity", "params": {"metric": "fuzz_ratio"}}}


def lists(ordered=False, item=FUZZ, **more):
    return JsonScorer(FieldConfig.parse({"type": "list", "metric_config": {"ordered": ordered, "item_logic": item, **more}}))


def test_soft_f1_of_lists():
    for ordered in (False, True):
        root = lists(ordered).score(["apple", "banana", "cherry"], ["apple", "bananaa"])[0]
        assert root["score"] == pytest.approx(0.76923, abs=1e-5)
        assert (root["tp"], root["fn"]) == (2, 1)
    assert lists(item={"type": "leaf"}).score(["apple", "banana"], ["banana", "apple"])[0]["score"] == 1.0
    assert lists().score([], [])[0]["score"] == 1.0
    assert lists(True).score([], [])[0] | {"score": 0.0} == lists(True).score([], [])[0]


def test_optimal_alignment():
    cos = np.array([[0.50, 0.30], [0.45, 0.40]])
    assert assignment.align(cos, 0.35) == [(0, 0), (1, 1)]
    assert assignment.align(np.array([[0.5, 0.3], [0.45, 0.2]]), 0.35) in ([(0, 0)], [(1, 0)])
    assert assignment.optimal(np.zeros((0, 3))) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_optimal_is_brute_force(n, m, seed):
    cost = np.random.default_rng(seed).random((n, m))
    got = sum(cost[i, j] for i, j in assignment.optimal(cost))
    short, long = sorted((n, m))
    c = cost if n <= m else cost.T
    assert got == pytest.approx(min(sum(c[i, p[i]] for i in range(short)) for p in itertools.permutations(range(long), short)))


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert similarity.common_subsequence(a, b) == table[-1][-1]
    assert similarity.ratio("", "") == 1.0


@pytest.mark.parametrize(
    "expected,actual,optional,want",
    [
        (None, None, False, (1, 0, True, 1, 0, 0)), (None, None, True, (1, 0, True, 0, 0, 0)), (None, "x", False, (0, 1, False, 0, 1, 0)),
        (None, "x", True, (1, 0, True, 0, 0, 0)), ("x", None, False, (0, 1, False, 0, 0, 1)), ("x", None, True, (1, 0, False, 0, 0, 0)),
        ("x", "x", False, (1, 1, True, 1, 0, 0)), ("x", "y", False, (0, 1, False, 0, 1, 1)), (1, 1.0, False, (1, 1, True, 1, 0, 0)), (True, 1, False, (1, 1, True, 1, 0, 0)), ("1", 1, False, (0, 1, False, 0, 1, 1)),
    ],
)
def test_leaf_outcomes(expected, actual, optional, want):
    n = JsonScorer(FieldConfig(optional=optional)).score(expected, actual)[0]
    assert (n["score"], n["weight"], n["is_correct"], n["tp"], n["fp"], n["fn"]) == want


def test_objects_weights_and_custom_metrics():
    config = FieldConfig.parse({"type": "object", "fields": {"a": {"weight": 3}, "b": {"metric_config": {"metric": "half"}}}})
    root = JsonScorer(config, {"half": lambda e, a, p: (0.5, True, {"cost": 2.0})}).score({"a": 1, "b": 2}, {"a": 1, "b": 3})[0]
    assert root["score"] == pytest.approx(3.5 / 4) and root["cost"] == 2.0 and root["is_correct"]
    assert JsonScorer(FieldConfig("object")).score({}, {"x": 1})[0]["is_correct"] is False
    with pytest.raises(ValueError):
        FieldConfig.parse({"type": "leaf", "metric_config": {"weight": 2}})
    judged = FieldConfig.parse({"type": "list", "metric_config": {"item_logic": {"type": "leaf", "metric_config": {"metric": "llm"}}}})
    assert check_expensive(judged) == ["root.$item"]
    with pytest.raises(ValueError):
        JsonScorer(judged)


def test_required_fields_and_match_text():
    item = {"type": "object", "fields": {"name": {}, "city": {}}}
    strict = lists(item=item, required_fields_to_match=["name"], match_threshold=0.1)
    assert strict.score([{"name": "a", "city": "x"}], [{"name": "b", "city": "x"}])[0]["tp"] == 0
    assert match_text({"a": 1, "b": None, "c": [1]}, None) == "a: 1"
    assert match_text({"c": [1]}, None) == '{"c": [1]}'
    assert infer_config({"a": [{"b": 1}]}).fields["a"].item.fields["b"].type == "leaf"


def test_score_json_falls_back_and_keeps_columns(spark):
    rows = [(1, '{"a": 1}', '{"a": 1}', "x"), (2, '{"a": 1}', '"text"', "x"), (3, "Yes ", "yes", None), (4, None, "yes", None), (5, None, None, None), (6, "", "", None)]
    df = spark.createDataFrame(rows, "id int, e string, a string, result string")
    got = {r.id: r.result for r in score_json(df, "e", "a", JsonScorer(FieldConfig("object", fields={"a": FieldConfig()}))).collect()}
    assert got[1][0].metric == "agg:weighted_avg" and got[1][0].score == 1.0
    assert [got[i][0].score for i in (2, 3, 4, 5, 6)] == [0.0, 1.0, 0.0, 0.0, 1.0]
    assert score_json(df.limit(0), "e", "a", JsonScorer(FieldConfig())).count() == 0


def test_score_columns_equals_tree(spark):
    config = FieldConfig("object", fields={"a": FieldConfig(weight=2), "b": FieldConfig(optional=True)})
    values = [{}, {"a": 1}, {"a": 1.0, "b": "x"}, {"a": "1", "b": None}, {"b": "y"}]
    rows = [(json.dumps(e | {k: None for k in ("a", "b") if k not in e}), json.dumps(a)) for e in values for a in values]
    df = spark.createDataFrame(rows, "e string, a string")
    for r in df.select("e", "a", score_columns(F.col("e"), F.col("a"), config).alias("s")).collect():
        assert r.s == pytest.approx(JsonScorer(config).score(json.loads(r.e), json.loads(r.a))[0]["score"]), r


def test_object_members_and_unknown_metrics():
    nodes = JsonScorer(FieldConfig("object", fields={"a": FieldConfig()})).score({"a": 1, "b": {"c": 1}}, {"a": 1, "b": {"c": 2}})
    assert [n["path"] for n in nodes] == ["root", "root.a", "root.b"] and nodes[2]["metric"] == "exact" and nodes[2]["score"] == 0.0
    assert (nodes[0]["tp"], nodes[0]["fp"], nodes[0]["fn"]) == (0, 0, 0)
    for config in (FieldConfig(metric="nearly"), FieldConfig(metric="llm"), FieldConfig(metric="embedding"), FieldConfig(metric="text_similarity", params={"metric": "cosine"}), FieldConfig(metric="text_similarity", params={"metric": "vibes"}), FieldConfig(metric="comparator", params={"element_compare": "mind"})):
        with pytest.raises(ValueError):
            JsonScorer(config)
    mine = FieldConfig("list", item=FieldConfig(metric="mine"))
    with pytest.raises(ValueError):
        JsonScorer(mine, {"mine": lambda e, a, p: True})
    mine.allow_expensive = ["$item"]
    assert JsonScorer(mine, {"mine": lambda e, a, p: True}).score([1], [2])[0]["score"] == 1.0


@pytest.mark.parametrize(
    "params,pair,want",
    [
        ({}, ("Ab ", "ab"), (1.0, True)), ({"case_sensitive": True}, ("Ab", "ab"), (0.0, False)), ({"element_compare": "text_similarity"}, ("abcd", "abce"), (0.75, True)),
        ({"element_compare": "text_similarity", "text_similarity_threshold": 0.8}, ("abcd", "abce"), (0.0, False)), ({"element_compare": "text_similarity", "comparison_threshold": 0.8}, ("abcd", "abce"), (0.75, False)),
        ({"element_compare": "text_similarity", "text_similarity_metric": "bleu"}, ("x", " X"), (1.0, True)), ({"element_compare": "text_similarity", "text_similarity_metric": "gleu"}, ("a b", "a c"), (1 / 3, True)),
    ],
)
def test_comparator(params, pair, want):
    n = JsonScorer(FieldConfig(metric="comparator", params=params)).score(*pair)[0]
    assert (pytest.approx(n["score"]), n["is_correct"]) == want


def test_partial_sums_are_the_nodes_sums(spark):
    from tallymark.operators import metrics
    from tallymark.operators.scoring import score_fields

    item = FieldConfig("object", fields={"n": FieldConfig(weight=2), "t": FieldConfig()})
    scorer = JsonScorer(FieldConfig("object", fields={"l": FieldConfig("list", item=item), "s": FieldConfig()}))
    rows = [("m" if i % 3 else None, json.dumps({"l": [{"n": j, "t": i} for j in range(i % 4)], "s": i}), json.dumps({"l": [{"n": j, "t": 3} for j in range(3)], "s": 5}) if i % 5 else "broken") for i in range(40)]
    df = spark.createDataFrame(rows, "model string, e string, a string")
    nodes = score_json(df, "e", "a", scorer).select("model", F.explode("result").alias("x")).select("model", "x.*")
    flat = lambda x: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.collect()), key=repr)
    assert flat(metrics.field_metrics(nodes, ["model"])) == flat(metrics.sum_fields(score_fields(df, ["model"], "e", "a", scorer), ["model"]))


VECTORS = {"a": [1.0, 0.0], "a2": [0.9, 0.1], "b": [0.0, 1.0], "b2": [0.1, 0.9], "far": [-1.0, 0.0]}


def test_judged_and_embedded(spark, tmp_path):
    from tallymark.operators.external import score_external
    from tallymark.operators.scoring import judge_models

    log = tmp_path / "asked"

    def embed(model, texts):
        with open(log, "a") as f:
            f.writelines(f"embed {t}\n" for t in texts)
        return [VECTORS[t] for t in texts], 0.5 * len(texts)

    def judge(model, prompt):
        with open(log, "a") as f:
            f.write("judge\n")
        return "yes" in prompt, 0.25

    pairs = spark.createDataFrame([(1, '["a", "b"]', '["b2", "a2"]'), (2, '["a"]', '["far"]'), (3, "[]", "[]"), (4, "[]", '["a"]'), (5, "no json", "x"), (6, '["a"]', '["unknown"]')], "id int, e string, a string")
    near = FieldConfig.parse({"type": "list", "metric_config": {"allow_expensive_comparisons_for": ["$item"], "item_logic": {"type": "leaf", "metric_config": {"metric": "embedding", "params": {"threshold": 0.5}}}}})
    scored, answers = score_external(pairs, "id", "e", "a", near, embed=embed)
    got = {r.id: r.result[0] for r in scored.collect()}
    assert (got[1].score, got[1].metric, got[1].tp) == (1.0, "list_aligned_f1", 2) and got[2].tp == 0 and got[3].score == 1.0 and got[4].score == 0.0
    assert got[5].metric == "text" and got[6].metric == "text"
    asked = len(log.read_text().splitlines())
    again, _ = score_external(pairs.where("id < 6"), "id", "e", "a", near, embed=embed, answers=answers)
    assert again.where("result[0].score = 1").count() == 2 and len(log.read_text().splitlines()) == asked
    asks = FieldConfig("object", fields={"v": FieldConfig(metric="llm", params={"model": "j", "prompt_template": "{expected}/{predicted}/{who}", "template_vars": {"who": "me"}})})
    assert judge_models(asks) == ["j"]
    rows = spark.createDataFrame([(1, '{"v": "yes"}', '{"v": "q"}'), (2, '{"v": "yes"}', '{"v": "q"}'), (3, '{"v": "no"}', '{"v": "q"}'), (4, '{"v": "no"}', "{}")], "id int, e string, a string")
    scored, answers = score_external(rows, "id", "e", "a", asks, judge=judge)
    got = {r.id: (r.result[0].score, r.result[0].cost) for r in scored.collect()}
    assert got == {1: (1.0, 0.25), 2: (1.0, 0.25), 3: (0.0, 0.25), 4: (0.0, 0.0)} and log.read_text().count("judge") == 2
    assert answers.select("text").distinct().count() == 2
