"""Scoring by judges and embeddings: answers are gathered first, then read.

What the pairs of a table need is found by scoring them without answers: texts to embed,
then, as these decide which items are compared, prompts to judge. Every distinct one is
asked for once, written to a table of answers, and joined back to the pairs that need it;
then the pairs are scored without a model. Known answers are never asked for again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .arrowmap import map_batches
from .scoring import Answers, FieldConfig, JsonScorer, NODE, Unanswered, _struct, asks, leaves, score_texts, text_tree

ANSWERS = "kind string, model string, text string, vector array<double>, verdict boolean, cost double"
_NEED = "kind string, model string, text string"
_KNOWN = pa.struct([("kind", pa.string()), ("model", pa.string()), ("text", pa.string()), ("vector", pa.list_(pa.float64())), ("verdict", pa.bool_()), ("cost", pa.float64())])


def no_answers(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], ANSWERS)


def _loaded(rows: list[dict] | None) -> Answers:
    out = Answers()
    for r in rows or []:
        if r["kind"] == "embedding":
            out.vectors[r["model"], r["text"]] = r["vector"]
        else:
            out.verdicts[r["model"], r["text"]] = (bool(r["verdict"]), r["cost"] or 0.0)
    return out


def _gather(scorer: JsonScorer, e: str | None, a: str | None) -> list[tuple[str, str, str]]:
    """What a pair needs and ``scorer.answers`` does not hold."""
    class Dry(JsonScorer):
        """Goes on without an answer; a missing cosine counts as 0."""

        def _cosine(self, expected, actual, model):
            got = self.answers.cosine("" if actual is None else str(actual), "" if expected is None else str(expected), model)
            return 0.0 if got is None else got

        def _judge(self, expected, actual, params):
            try:
                return super()._judge(expected, actual, params)
            except Unanswered:
                return 0.0, False, {}

        def _aligned(self, c, item, expected, actual):
            try:
                return super()._aligned(c, item, expected, actual)
            except Unanswered:
                return {}, 0.0

    dry = Dry(scorer.config, {k: scorer.metrics[k] for k in scorer.custom}, scorer.aggregates, scorer.answers)
    score_texts(dry, e, a)
    return list(scorer.answers.wanted)


def needs(df: DataFrame, key: str, expected: str, actual: str, config: FieldConfig, metrics: dict[str, Callable] | None = None, known: str | None = None) -> DataFrame:
    """``key, kind, model, text`` of what each pair needs beside the ``known`` column."""
    kind = dict(df.dtypes)[key]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, out = [], []
            told = batch.column(3).to_pylist() if known else [None] * batch.num_rows
            for i, (e, a, have) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), told)):
                found = _gather(JsonScorer(config, metrics, answers=_loaded(have)), e, a)
                row += [i] * len(found)
                out += found
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), *[pa.array([o[i] for o in out], pa.string()) for i in range(3)]], [key, "kind", "model", "text"])

        return step

    columns = [F.col(key), F.col(expected).alias("_e"), F.col(actual).alias("_a"), *([F.col(known)] if known else [])]
    return map_batches(spread(df.select(*columns)), f"`{key}` {kind}, {_NEED}", make)


def ask(wanted: DataFrame, judge: Callable[[str, str], tuple[bool, float]] | None, embed: Callable[[str, list[str]], tuple[list[list[float]], float]] | None) -> DataFrame:
    """Answers (ANSWERS) to distinct ``kind, model, text``. ``judge(model, prompt)`` gives a
    verdict and its cost, ``embed(model, texts)`` the vectors of a batch and its cost, which
    is shared evenly. A failed or missing one gives no answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, models, texts = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for model in dict.fromkeys(m for k, m in zip(kinds, models) if k == "embedding"):
                mine = [t for k, m, t in zip(kinds, models, texts) if k == "embedding" and m == model]
                # A batch that fails is asked for text by text, so that only what fails is missing.
                rest = [mine]
                while rest:
                    part = rest.pop()
                    try:
                        vectors, cost = embed(model, part)
                        out += [("embedding", model, t, [float(x) for x in v], None, cost / len(part)) for t, v in zip(part, vectors, strict=True)]
                    except Exception:  # noqa: BLE001
                        rest += [[t] for t in part] if len(part) > 1 else []
            for k, model, text in zip(kinds, models, texts):
                if k == "llm":
                    try:
                        verdict, cost = judge(model, text)
                        out.append(("llm", model, text, None, bool(verdict), float(cost)))
                    except Exception:  # noqa: BLE001
                        continue
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(_KNOWN)], [f.name for f in _KNOWN])

    return wanted.select("kind", "model", "text").mapInArrow(run, ANSWERS)


def score_external(df: DataFrame, key: str, expected: str, actual: str, config: FieldConfig, judge=None, embed=None, answers: DataFrame | None = None, metrics: dict[str, Callable] | None = None, column: str = "result") -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``column`` as of ``score_json``, the answers known afterwards).

    ``key`` is unique in ``df``. ``answers`` (ANSWERS) are those known before; an answer
    that cannot be had makes its pair fall back to text equality, metric 'text'.
    """
    answers = no_answers(df) if answers is None else answers.select(*[c.split()[0] for c in ANSWERS.split(", ")])
    external = {asks(leaf.metric, leaf.params) for _, leaf in leaves(config)}
    wanted, have = None, None
    for kind in [k for k in ("embedding", "llm") if k == "embedding" or k in external]:
        base = df if have is None else df.join(have, key, "left")
        more = cut(needs(base, key, expected, actual, config, metrics, None if have is None else "_known").where(F.col("kind") == kind))
        open_ = more.select("kind", "model", "text").distinct().join(answers, ["kind", "model", "text"], "left_anti")
        fresh = cut(ask(open_, judge, embed))
        answers = answers.unionByName(fresh)
        wanted = more if wanted is None else wanted.unionByName(more)
        told = F.struct("kind", "model", "text", "vector", "verdict", "cost")
        have = wanted.join(answers, ["kind", "model", "text"]).groupBy(key).agg(F.collect_list(told).alias("_known"))
    keep = [f for f in df.schema.fields if f.name != column]
    names = [f.name for f in keep]
    at = names.index(expected), names.index(actual)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + f", `{column}` array<struct<{NODE.replace(' double', ':double').replace(' string', ':string').replace(' boolean', ':boolean')}>>"
    struct = _struct(NODE)

    def one(e: str | None, a: str | None, known: list[dict] | None) -> list[dict]:
        try:
            return score_texts(JsonScorer(config, metrics, answers=_loaded(known)), e, a)
        except Unanswered:
            return text_tree(e, a)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), batch.column(len(names)).to_pylist())
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([one(*r) for r in rows], pa.list_(struct))], [*names, column])

        return step

    return map_batches(df.select(*names).join(have, key, "left").select(*names, "_known"), schema, make), answers
