"""Scoring nested JSON against an expected value under a tree of field configurations.

``FieldConfig`` is plan-time. ``score_json`` runs the compiled tree over Arrow batches and
returns each result tree flat, one struct for each node; ``score_fields`` adds the nodes of
a batch up to one row for each field before they leave Python; ``score_columns`` compiles a
config of flat exact leaves to Column expressions that stay in the JVM. Metrics that need
a judge or embeddings read them from answers gathered before (``external.py``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import assignment, similarity
from ..functions.text import equal_score
from ..session import spread
from .arrowmap import map_batches

NODE = "path string, score double, weight double, is_correct boolean, tp double, fp double, fn double, `precision` double, recall double, metric string, cost double"
#: Metrics that call a model for each comparison; refused inside unordered lists unless allowed.
EXPENSIVE = frozenset({"llm", "embedding"})
#: Least cosine of aligned items where a list does not say.
ALIGN_LEAST = 0.35


@dataclass
class FieldConfig:
    type: str = "leaf"
    weight: float = 1.0
    optional: bool = False
    metric: str = "exact"
    params: dict[str, Any] = field(default_factory=dict)
    propagation: str = "weighted_avg"
    ordered: bool = False
    match_threshold: float = 0.5
    required: list[str] = field(default_factory=list)
    item: FieldConfig | None = None
    fields: dict[str, FieldConfig] = field(default_factory=dict)
    align_fields: list[str] | None = None
    align_least: float | None = None
    align_model: str = "embedding"
    allow_expensive: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, raw: dict) -> FieldConfig:
        """From its nested dict form; unknown types and keys of a node raise."""
        known = {"type", "weight", "optional", "metric_config", "fields"}
        if set(raw) - known:
            raise ValueError(f"unknown keys: {sorted(set(raw) - known)}")
        kind = raw.get("type", "leaf")
        if kind not in ("leaf", "object", "list"):
            raise ValueError(f"unknown type: {kind}")
        m = raw.get("metric_config") or {}
        if "weight" in m:
            raise ValueError("weight belongs to the field, not to its metric_config")
        align = m.get("alignment") or {k: m[k] for k in ("match_key_fields", "lo", "embed_model") if k in m}
        item = m.get("item_logic") or ({"type": "object", "fields": raw["fields"]} if kind == "list" and raw.get("fields") else None)
        return cls(
            kind, float(raw.get("weight", 1.0)), bool(raw.get("optional", False)), m.get("metric", "exact"), m.get("params") or {}, m.get("propagation", "weighted_avg"),
            bool(m.get("ordered", False)), float(m.get("match_threshold", 0.5)), list(m.get("required_fields_to_match") or []),
            cls.parse(item) if item else cls() if kind == "list" else None, {k: cls.parse(v) for k, v in (raw.get("fields") or {}).items()} if kind == "object" else {},
            align.get("match_key_fields") if align else None, float(align.get("lo", ALIGN_LEAST)) if align else None, (align or {}).get("embed_model", "embedding"), list(m.get("allow_expensive_comparisons_for") or []),
        )


def infer_config(value: Any) -> FieldConfig:
    """Objects and lists by the value's containers, exact leaves elsewhere."""
    if isinstance(value, dict):
        return FieldConfig("object", fields={k: infer_config(v) for k, v in value.items()})
    if isinstance(value, list):
        return FieldConfig("list", item=infer_config(value[0]) if value else FieldConfig())
    return FieldConfig()


def asks(metric: str, params: dict) -> str | None:
    """'llm' or 'embedding' if the metric needs a model's answer."""
    if metric in EXPENSIVE:
        return metric
    if metric == "comparator":
        kind = params.get("element_compare", "exact")
        return kind if kind in EXPENSIVE else "embedding" if kind == "text_similarity" and params.get("text_similarity_metric") == "cosine" else None
    return "embedding" if metric == "text_similarity" and params.get("metric") == "cosine" else None


def leaves(config: FieldConfig, at: str = "") -> Iterable[tuple[str, FieldConfig]]:
    """(path, leaf) below a node; an item of a list is ``$item`` where it is a leaf itself."""
    if config.type == "leaf":
        yield at or "$item", config
    if config.item:
        yield from leaves(config.item, at)
    for k, v in config.fields.items():
        yield from leaves(v, f"{at}.{k}" if at else k)


def check_expensive(config: FieldConfig, path: str = "root", custom: frozenset[str] = frozenset()) -> list[str]:
    """Paths where an unordered list would ask a model, or run a metric of the caller's, for
    its items without leave."""
    found = []
    if config.type == "list" and not config.ordered:
        for at, leaf in leaves(config.item):
            if (leaf.metric in custom or asks(leaf.metric, leaf.params)) and at not in config.allow_expensive:
                found.append(f"{path}.{at}" if at == "$item" else f"{path}.$item.{at}")
    for k, v in config.fields.items():
        found += check_expensive(v, f"{path}.{k}", custom)
    if config.item:
        found += [p for p in check_expensive(config.item, f"{path}.$item", custom) if p not in found]
    return found


def judge_models(config: FieldConfig) -> list[str]:
    """The judge models that a config names, sorted."""
    return sorted({str(c.params.get("model") or c.params.get("llm_model") or "judge") for _, c in leaves(config) if asks(c.metric, c.params) == "llm"})


def _exact(expected: Any, actual: Any, params: dict) -> bool:
    return expected == actual


def _text(x: Any) -> str:
    return "" if x is None else str(x)


def _form(x: Any, params: dict) -> str:
    out = _text(x).strip()
    out = out if params.get("case_sensitive") else out.lower()
    return out.replace(" ", "") if params.get("ignore_spaces") else out


def _exact_compare(expected: Any, actual: Any, params: dict) -> bool:
    return _form(expected, params) == _form(actual, params)


@lru_cache(maxsize=100_000)
def _ratio(a: str, b: str) -> float:
    return similarity.ratio(a, b)


#: Placeholders of a judge's template.
JUDGE_PROMPT = "Do both values mean the same thing? More detail on one side, or an abbreviation, is no difference.\nFirst: {predicted}\nSecond: {expected}\nAnswer YES or NO."


def judge_prompt(expected: Any, actual: Any, params: dict) -> str:
    template = params.get("prompt_template") or params.get("llm_prompt_template") or JUDGE_PROMPT
    values = {k: _text(v) for k, v in (params.get("template_vars") or {}).items()} | {"predicted": _text(actual), "expected": _text(expected)}
    return re.sub(r"\{(\w+)\}", lambda m: values.get(m[1], m[0]), template)


@dataclass
class Answers:
    """What models said: vectors by (model, text), verdicts and their cost by (model,
    prompt). What is asked and not known is noted in ``wanted``."""

    vectors: dict[tuple[str, str], Any] = field(default_factory=dict)
    verdicts: dict[tuple[str, str], tuple[bool, float]] = field(default_factory=dict)
    wanted: dict[tuple[str, str, str], None] = field(default_factory=dict)

    def cosine(self, a: str, b: str, model: str) -> float | None:
        pair = []
        for text in (a, b):
            v = self.vectors.get((model, text))
            if v is None:
                self.wanted["embedding", model, text] = None
            pair.append(v)
        if pair[0] is None or pair[1] is None:
            return None
        x, y = (np.asarray(v, dtype=float) for v in pair)
        size = float(np.linalg.norm(x) * np.linalg.norm(y))
        return float(x @ y) / size if size else 0.0

    def verdict(self, prompt: str, model: str) -> tuple[bool, float] | None:
        known = self.verdicts.get((model, prompt))
        if known is None:
            self.wanted["llm", model, prompt] = None
        return known


class Unanswered(LookupError):
    """A model's answer is needed that was not gathered."""


METRICS: dict[str, Callable] = {
    "exact": _exact,
    "threshold": lambda e, a, p: (a or 0) >= (p.get("min") or 0),
    "exact_compare": _exact_compare,
    "text_similarity": None,
    "comparator": None,
    "llm": None,
    "embedding": None,
}
PROPAGATION: dict[str, Callable[[list[dict]], float]] = {
    "weighted_avg": lambda kids: sum(k["weight"] * k["score"] for k in kids) / w if (w := sum(k["weight"] for k in kids)) else 0.0,
    "min": lambda kids: min((k["score"] for k in kids), default=0.0),
    "max": lambda kids: max((k["score"] for k in kids), default=0.0),
}


class JsonScorer:
    """Scores one pair; ``metrics`` and ``aggregates`` add to or replace the built-in ones.

    A metric returns bool, float, (score, correct) or (score, correct, details), where
    ``details['cost']`` is billed. An unknown metric raises, and so does one that needs a
    model's answers (judge, embeddings, cosine) without ``answers`` to read them from.
    A list whose items need them is aligned by embeddings, any other unordered one greedily.
    """

    def __init__(self, config: FieldConfig, metrics: dict[str, Callable] | None = None, aggregates: dict[str, Callable] | None = None, answers: Answers | None = None):
        custom = frozenset(metrics or ())
        bad = check_expensive(config, custom=custom - set(METRICS))
        if bad:
            raise ValueError(f"expensive comparisons of all pairs at {', '.join(bad)}: allow them in allow_expensive_comparisons_for")
        for path, leaf in leaves(config):
            if leaf.metric not in METRICS and leaf.metric not in custom:
                raise ValueError(f"unknown metric {leaf.metric!r} at {path}")
            if answers is None and leaf.metric not in custom and asks(leaf.metric, leaf.params):
                raise ValueError(f"metric {leaf.metric!r} at {path} needs a model's answers: use external.score_external")
            name = leaf.params.get("metric", "fuzz_ratio") if leaf.metric == "text_similarity" else leaf.params.get("text_similarity_metric", "fuzz_ratio") if leaf.metric == "comparator" else "fuzz_ratio"
            if name not in ("fuzz_ratio", "bleu", "gleu", "cosine"):
                raise ValueError(f"unknown text similarity {name!r} at {path}")
            if leaf.metric == "comparator" and leaf.params.get("element_compare", "exact") not in ("exact", "text_similarity", "llm", "embedding"):
                raise ValueError(f"unknown element_compare at {path}")
        self.config, self.answers, self.custom = config, answers, custom
        own = {"text_similarity": self._similarity, "comparator": self._comparator, "llm": self._judge, "embedding": self._embedding}
        self.metrics, self.aggregates = METRICS | own | (metrics or {}), PROPAGATION | (aggregates or {})

    def score(self, expected: Any, actual: Any) -> list[dict]:
        """Nodes of the result tree, the root first."""
        out: list[dict] = []
        self._node("root", self.config, expected, actual, out)
        return out

    # Metrics

    def _cosine(self, expected: Any, actual: Any, model: str) -> float:
        got = self.answers.cosine(_text(actual), _text(expected), model)
        if got is None:
            raise Unanswered("embedding")
        return got

    def _similarity(self, expected: Any, actual: Any, params: dict, name: str | None = None, least: float | None = None) -> float | bool:
        name, least = name or params.get("metric", "fuzz_ratio"), params.get("threshold") if least is None else least
        if name == "cosine":  # of the texts as they are
            score = self._cosine(expected, actual, params.get("embedding_model", "embedding"))
        else:
            a, b = _form(expected, params), _form(actual, params)
            # The expected text is the candidate of the n-gram scores.
            score = _ratio(a, b) if name == "fuzz_ratio" else getattr(similarity, name)(b, a)
        return score if least is None else score >= least

    def _judge(self, expected: Any, actual: Any, params: dict) -> tuple[float, bool, dict]:
        got = self.answers.verdict(judge_prompt(expected, actual, params), str(params.get("model") or params.get("llm_model") or "judge"))
        if got is None:
            raise Unanswered("llm")
        return float(got[0]), got[0], {"cost": got[1]}

    def _embedding(self, expected: Any, actual: Any, params: dict) -> float | bool:
        score = self._cosine(expected, actual, params.get("model", "embedding"))
        return score if params.get("threshold") is None else score >= params["threshold"]

    def _comparator(self, expected: Any, actual: Any, params: dict) -> Any:
        """By ``element_compare``; equal texts need no model."""
        kind = params.get("element_compare", "exact")
        same = _exact_compare(expected, actual, params)
        if same or kind == "exact":
            return (1.0 if same else 0.0), same
        if kind == "llm":
            return self._judge(expected, actual, params)
        if kind == "embedding":
            score, least = self._cosine(expected, actual, params.get("embedding_model", "embedding")), params.get("embedding_threshold")
        else:
            least = params.get("text_similarity_threshold")
            score = self._similarity(expected, actual, params, params.get("text_similarity_metric", "fuzz_ratio"), 0.0 if least is None else least) if least is not None else self._similarity(expected, actual, {k: v for k, v in params.items() if k != "threshold"}, params.get("text_similarity_metric", "fuzz_ratio"))
            if isinstance(score, bool):
                return float(score), score
        if least is not None:
            return float(score >= least), score >= least
        bar = params.get("comparison_threshold") or params.get("text_similarity_threshold")
        return score, score >= bar if bar else True

    # Nodes

    def _put(self, out: list[dict], at: int, path: str, score: float, weight: float, ok: bool, tp=0.0, fp=0.0, fn=0.0, precision=0.0, recall=0.0, metric="", cost=0.0) -> dict:
        node = dict(path=path, score=float(score), weight=float(weight), is_correct=bool(ok), tp=float(tp), fp=float(fp), fn=float(fn), precision=float(precision), recall=float(recall), metric=metric, cost=float(cost))
        out.insert(at, node)
        return node

    def _node(self, path: str, c: FieldConfig, expected: Any, actual: Any, out: list[dict]) -> dict:
        return {"leaf": self._leaf, "object": self._object, "list": self._list}[c.type](path, c, expected, actual, out)

    def _compare(self, c: FieldConfig, expected: Any, actual: Any) -> tuple[float, bool, float]:
        """(score, correct, cost) of two values that are there."""
        got, cost = self.metrics[c.metric](expected, actual, c.params), 0.0
        if isinstance(got, tuple):
            return float(got[0]), bool(got[1]), float(got[2].get("cost", 0.0)) if len(got) > 2 and got[2] else 0.0
        if isinstance(got, bool):
            return float(got), got, cost
        least = c.params.get("comparison_threshold") or c.params.get("threshold")
        if c.metric in self.custom:
            return float(got), float(got) == 1.0, cost
        return float(got), got >= least if least else True, cost

    def _leaf(self, path, c, expected, actual, out):
        at = len(out)
        if expected is None and actual is None:
            return self._put(out, at, path, 1, 0, True, tp=0 if c.optional else 1, metric="optional_missing_both")
        if expected is None:
            return self._put(out, at, path, 1, 0, True, metric="unexpected_field") if c.optional else self._put(out, at, path, 0, c.weight, False, fp=1, metric="unexpected_field")
        if actual is None:
            return self._put(out, at, path, 1, 0, False, metric="missing_field") if c.optional else self._put(out, at, path, 0, c.weight, False, fn=1, metric="missing_field")
        score, ok, cost = self._compare(c, expected, actual)
        return self._put(out, at, path, score, c.weight, ok, tp=ok, fp=not ok, fn=not ok, precision=ok, recall=ok, metric=c.metric, cost=cost)

    def _object(self, path, c, expected, actual, out):
        """Members of the expected object; one without a configuration is an exact leaf.
        Counts belong to leaves and lists: an object has none of its own."""
        expected, actual = {} if expected is None else expected, {} if actual is None else actual
        if not isinstance(expected, dict) or not isinstance(actual, dict):
            raise TypeError(f"no object at {path}")
        at = len(out)
        kids = [self._node(f"{path}.{k}", c.fields.get(k) or _LEAF, v, actual.get(k), out) for k, v in expected.items()]
        score = self.aggregates.get(c.propagation, PROPAGATION["weighted_avg"])(kids)
        ok = all(k["is_correct"] for k in kids) and (bool(expected) or not actual)
        w = sum(k["weight"] for k in kids)
        mean = lambda f: sum(k["weight"] * k[f] for k in kids) / w if w else 0.0
        return self._put(out, at, path, score, c.weight, ok, 0, 0, 0, mean("precision"), mean("recall"), f"agg:{c.propagation}", sum(k["cost"] for k in kids))

    def _list(self, path, c, expected, actual, out):
        expected, actual = [] if expected is None else expected, [] if actual is None else actual
        if not isinstance(expected, list) or not isinstance(actual, list):
            raise TypeError(f"no list at {path}")
        at, item = len(out), c.item or _LEAF
        aligned = not c.ordered and self._asks(item)
        name = "list_ordered_f1" if c.ordered else "list_aligned_f1" if aligned else "list_greedy_f1"
        if aligned and not expected:  # nothing to find: right if nothing is there
            return self._put(out, at, path, float(not actual), c.weight, not actual, 0, len(actual), 0, metric=name)
        cost = 0.0
        if c.ordered:
            kids = [self._node(f"{path}[{i}]", item, e, actual[i] if i < len(actual) else None, out) for i, e in enumerate(expected)]
            paired = kids[: len(actual)]
            tp = sum(k["is_correct"] for k in paired)
            soft = sum(k["score"] for k in paired)
        else:
            pairs, cost = self._aligned(c, item, expected, actual) if aligned else self._greedy(c, item, expected, actual)
            kids, soft, tp = [], 0.0, len(pairs)
            for i, e in enumerate(expected):
                node = self._node(f"{path}[{i}]", item, e, actual[pairs[i]] if i in pairs else None, out)
                kids.append(node)
                soft += node["score"] if i in pairs else 0.0
        cost += sum(k["cost"] for k in kids)
        precision = tp / len(actual) if actual else 0.0
        recall = tp / len(expected) if expected else 0.0
        sp, sr = soft / len(actual) if actual else 0.0, soft / len(expected) if expected else 0.0
        score = 2 * sp * sr / (sp + sr) if sp + sr else 0.0
        ok = all(k["is_correct"] for k in kids) and len(expected) == len(actual) == (tp if not c.ordered else len(actual))
        if not c.ordered and ok:
            score = 1.0
        return self._put(out, at, path, score, c.weight, ok, tp, len(actual) - tp, len(expected) - tp, precision, recall, name, cost)

    def _asks(self, item: FieldConfig) -> bool:
        return any(leaf.metric in self.custom - set(METRICS) or asks(leaf.metric, leaf.params) for _, leaf in leaves(item)) and self.answers is not None

    def _allowed(self, c: FieldConfig, item: FieldConfig, e: Any, a: Any) -> bool:
        """Whether the members that a pair has to agree in do."""
        if not c.required or not item.fields or not isinstance(e, dict):
            return True
        if not isinstance(a, dict):
            return False
        return all(self._node("$", item.fields.get(k) or _LEAF, e.get(k), a.get(k), [])["is_correct"] for k in c.required)

    def _quick(self, c: FieldConfig, expected: Any, actual: Any) -> tuple[float, float, float]:
        """(score, weight, cost) of a node, without its tree where that can be."""
        if c.type == "leaf" and expected is not None and actual is not None:
            score, _, cost = self._compare(c, expected, actual)
            return score, c.weight, cost
        if c.type == "object" and c.propagation == "weighted_avg" and "weighted_avg" not in self.custom and isinstance(expected, dict) and isinstance(actual, dict) and expected:
            kids = [self._quick(c.fields.get(k) or _LEAF, v, actual.get(k)) for k, v in expected.items()]
            w = sum(k[1] for k in kids)
            return (sum(k[0] * k[1] for k in kids) / w if w else 0.0), c.weight, sum(k[2] for k in kids)
        node = self._node("$", c, expected, actual, [])
        return node["score"], node["weight"], node["cost"]

    def _greedy(self, c: FieldConfig, item: FieldConfig, expected: list, actual: list) -> tuple[dict[int, int], float]:
        """Every pair of a row's two lists is compared, as the best ones are asked for."""
        if not expected or not actual:
            return {}, 0.0
        scores, cost = np.full((len(expected), len(actual)), -1.0), 0.0
        for i, e in enumerate(expected):
            for j, a in enumerate(actual):
                if self._allowed(c, item, e, a):
                    scores[i, j], _, more = self._quick(item, e, a)
                    cost += more
        return dict(assignment.greedy(scores, c.match_threshold)), cost

    def _aligned(self, c: FieldConfig, item: FieldConfig, expected: list, actual: list) -> tuple[dict[int, int], float]:
        """Least-cost assignment over the cosines of the items' texts."""
        if not expected or not actual:
            return {}, 0.0
        scalar = [k for k, v in item.fields.items() if v.type == "leaf"]
        fields = c.align_fields or (scalar if len(scalar) == 1 and len(item.fields) == 1 else None)
        keys = [[match_text(x, fields) for x in side] for side in (expected, actual)]
        cosines = [[self.answers.cosine(b, a, c.align_model) for b in keys[1]] for a in keys[0]]
        if any(x is None for row in cosines for x in row):
            raise Unanswered("embedding")
        allowed = [[self._allowed(c, item, e, a) for a in actual] for e in expected]
        scores = np.where(np.array(allowed), np.array(cosines), -2.0)
        return dict(assignment.align(scores, ALIGN_LEAST if c.align_least is None else c.align_least)), 0.0


_LEAF = FieldConfig()


def match_text(item: Any, fields: list[str] | None, size: int = 512) -> str:
    """``key: value`` lines of the chosen, else all scalar members; the whole item if none."""
    if isinstance(item, dict):
        keys = fields or [k for k, v in item.items() if not isinstance(v, (dict, list))]
        lines = [f"{k}: {item[k]}" for k in keys if item.get(k) is not None]
        if lines:
            return "\n".join(lines)[:size]
    return (item if isinstance(item, str) else json.dumps(item, sort_keys=True, ensure_ascii=False))[:size]


def _struct(ddl: str) -> pa.StructType:
    kinds = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "bigint": pa.int64()}
    return pa.struct([(c.split()[0].strip("`"), kinds[c.split()[1]]) for c in ddl.split(", ")])


def score_texts(scorer: JsonScorer, e: str | None, a: str | None) -> list[dict]:
    """The result tree of two JSON texts; where a side is null, no JSON or of another shape
    than the config says, text equality without case and outer space, metric 'text'."""
    try:
        return scorer.score(json.loads(e), json.loads(a))
    except Unanswered:
        raise
    except (TypeError, ValueError, RecursionError):
        return text_tree(e, a)


def text_tree(e: str | None, a: str | None) -> list[dict]:
    same = e is not None and a is not None and e.strip().lower() == a.strip().lower()
    return [dict(path="root", score=float(same), weight=1.0, is_correct=same, tp=float(same), fp=float(not same), fn=float(not same), precision=float(same), recall=float(same), metric="text", cost=0.0)]


def score_json(df: DataFrame, expected: str, actual: str, scorer: JsonScorer, column: str = "result") -> DataFrame:
    """Add ``column``, the nodes of each pair's result tree, the root first.

    Where a side is null, no JSON, or of another shape than the config says, the pair
    falls back to text equality without case and outer space, metric 'text'.
    """
    keep = [f for f in df.schema.fields if f.name != column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + f", `{column}` array<struct<{NODE.replace(' double', ':double').replace(' string', ':string').replace(' boolean', ':boolean')}>>"
    names = [f.name for f in keep]
    at = names.index(expected), names.index(actual)
    struct = _struct(NODE)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            pairs = zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist())
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([score_texts(scorer, e, a) for e, a in pairs], pa.list_(struct))], [*names, column])

        return step

    return map_batches(spread(df.select(*names)), schema, make)


FIELD_SUM = "field string, n bigint, score double, tp double, fp double, fn double, `precision` double, recall double, weight_at string, weight double, metric_at string, metric string"
_NO_METRIC = frozenset({"missing_field", "unexpected_field", "optional_missing_both"})


def field_name(path: str, metric: str) -> str:
    """A node's field: its path without list positions and the root."""
    bare = re.sub(r"\[\d+\]", "", path)
    bare = bare[5:] if bare.startswith("root.") else "" if bare == "root" else bare
    return bare or ("[*]" if metric.startswith("list") else "[root]")


def score_fields(df: DataFrame, by: list[str], expected: str, actual: str, scorer: JsonScorer) -> DataFrame:
    """``by`` and partial sums (FIELD_SUM) of the nodes of each field, one row for each group
    and field of an Arrow batch: trees do not leave Python, and only sums are shuffled.

    ``weight`` is that of the first path whose node has one, ``metric`` of the first one
    that was compared.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", " + FIELD_SUM
    sums = _struct(FIELD_SUM)

    def make():
        known: dict[tuple[str, str], list[dict]] = {}

        def tree(e: str | None, a: str | None) -> list[dict]:
            key = (e, a)
            if key not in known:
                if len(known) >= 20_000:
                    known.clear()
                known[key] = [dict(n, field=field_name(n["path"], n["metric"])) for n in score_texts(scorer, e, a)]
            return known[key]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            groups = [batch.column(i).to_pylist() for i in range(len(by))]
            totals: dict[tuple, list] = {}
            first: dict[tuple, int] = {}
            for i, (e, a) in enumerate(zip(batch.column(len(by)).to_pylist(), batch.column(len(by) + 1).to_pylist())):
                group = tuple(g[i] for g in groups)
                for n in tree(e, a):
                    key = (*group, n["field"])
                    t = totals.get(key)
                    if t is None:
                        t = totals[key] = [0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, None, None, None]
                        first[key] = i
                    t[0] += 1
                    for k, f in enumerate(("score", "tp", "fp", "fn", "precision", "recall")):
                        t[k + 1] += n[f]
                    path = n["path"]
                    if n["weight"] and (t[7] is None or (path, n["weight"]) < (t[7], t[8])):
                        t[7], t[8] = path, n["weight"]
                    if n["metric"] not in _NO_METRIC:  # that of a text fallback comes last
                        place = f"~{path}" if n["metric"] == "text" else path
                        if t[9] is None or (place, n["metric"]) < (t[9], t[10]):
                            t[9], t[10] = place, n["metric"]
            at = pa.array([first[k] for k in totals], pa.int32())
            heads = [batch.column(i).take(at) for i in range(len(by))]
            columns = [pa.array([k[-1] for k in totals], pa.string())] + [pa.array([t[j] for t in totals.values()], sums.field(j + 1).type) for j in range(11)]
            return pa.RecordBatch.from_arrays([*heads, *columns], [*by, *[f.name for f in sums]])

        return step

    return map_batches(spread(df.select(*by, expected, actual)), schema, make)


def score_columns(expected: Column, actual: Column, config: FieldConfig) -> Column:
    """Score of an object of flat exact leaves as an expression over JSON text: the weighted
    mean of its members' equality; text equality if a side is no JSON object."""
    if config.type != "object" or any(c.type != "leaf" or c.metric != "exact" for c in config.fields.values()):
        raise ValueError("only objects of exact leaves")
    e, a = F.try_parse_json(expected), F.try_parse_json(actual)
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, c in config.fields.items():
        x, y = (F.to_json(F.try_variant_get(v, f"$['{name}']", "variant")) for v in (e, a))
        x, y = (F.when(z != "null", z) for z in (x, y))
        same = F.coalesce(x == y, x.try_cast("double") == y.try_cast("double"))
        missing = x.isNull() & y.isNull()
        w = F.when(missing | (F.lit(c.optional) & (x.isNull() | y.isNull())), 0.0).otherwise(c.weight)
        s = F.when(missing, 1.0).when(x.isNull() | y.isNull(), 1.0 if c.optional else 0.0).otherwise(F.coalesce(same, F.lit(False)).cast("double"))
        total, weight = total + w * s, weight + w
    shaped = F.schema_of_variant(e).like("OBJECT%") & F.schema_of_variant(a).like("OBJECT%")
    return F.when(shaped, F.when(weight > 0, total / weight).otherwise(0.0)).otherwise(F.coalesce(equal_score(actual, expected), F.lit(0.0)))
