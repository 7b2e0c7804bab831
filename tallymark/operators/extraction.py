"""Splitting extraction schemas and merging, de-duplicating and verifying their results."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio
from .arrowmap import map_batches


def split_point(schema: dict) -> tuple[list[str], list[str]] | None:
    """(path, list members) of the first level, breadth first, with two list members or more."""
    level: list[tuple[list[str], dict]] = [([], schema)]
    while level:
        following = []
        for path, node in level:
            members = node.get("properties", {})
            lists = [k for k, v in members.items() if v.get("type") == "array"]
            if len(lists) >= 2:
                return path, lists
            following += [([*path, k], v) for k, v in members.items() if v.get("type") == "object"]
        level = following
    return None


def sub_schemas(schema: dict) -> dict[str, dict]:
    """A schema for each list member of the split point, wrapped in its path; none without one."""
    found = split_point(schema)
    if not found:
        return {}
    path, lists = found
    node = schema
    for k in path:
        node = node["properties"][k]
    out = {}
    for name in lists:
        inner: dict = {"type": "object", "properties": {name: node["properties"][name]}, "required": [name]}
        for k in reversed(path):
            inner = {"type": "object", "properties": {k: inner}, "required": [k]}
        out[name] = inner
    return out


def merge_fields(parts: dict[str, Column]) -> Column:
    """JSON text of one object whose members are the parts; broken JSON becomes []."""
    value = lambda c: F.coalesce(F.try_parse_json(c), F.parse_json(F.lit("[]")))
    return F.to_json(F.struct(*[value(c).alias(k) for k, c in parts.items()]))


def similar(a: Any, b: Any) -> float:
    """Mean text ratio over string members (missing ones are ''), else equality."""
    if isinstance(a, dict) and isinstance(b, dict):
        keys = [k for k in {**a, **b} if isinstance(a.get(k, ""), str) and isinstance(b.get(k, ""), str)]
        return sum(ratio((a.get(k) or "").lower(), (b.get(k) or "").lower()) for k in keys) / len(keys) if keys else float(a == b)
    if isinstance(a, str) and isinstance(b, str):
        return ratio(a.lower(), b.lower())
    return float(a == b)


def unique_items(items: list, least: float = 0.85) -> list:
    """Each item unless it is similar to one kept before."""
    kept: list = []
    for x in items:
        if not any(similar(x, y) >= least for y in kept):
            kept.append(x)
    return kept


def merge_values(values: list[Any], least: float = 0.85) -> Any:
    """Lists united and de-duplicated, objects member by member, else the first one not null."""
    present = [v for v in values if v is not None]
    if not present:
        return None
    first = present[0]
    if isinstance(first, list):
        return unique_items([x for v in present if isinstance(v, list) for x in v], least)
    if isinstance(first, dict):
        dicts = [v for v in present if isinstance(v, dict)]
        return {k: merge_values([d.get(k) for d in dicts], least) for k in dict.fromkeys(k for d in dicts for k in d)}
    return first


def _json_udf(df: DataFrame, columns: list[str], name: str, f) -> DataFrame:
    keep = [x for x in df.schema.fields if x.name != name]
    names = [x.name for x in keep]
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in keep) + f", `{name}` string"
    at = [names.index(c) for c in columns]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = zip(*[batch.column(i).to_pylist() for i in at])
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([f(*v) for v in values], pa.string())], [*names, name])

        return step

    return map_batches(df.select(*names), schema, make)


def merge_passes(df: DataFrame, texts: str, name: str = "merged") -> DataFrame:
    """Add the deep merge of an array of JSON texts; broken ones are left out."""

    def merge(values: list[str] | None) -> str | None:
        parsed = []
        for v in values or []:
            try:
                parsed.append(json.loads(v))
            except (TypeError, ValueError):
                continue
        return json.dumps(merge_values(parsed), ensure_ascii=False) if parsed else None

    return _json_udf(df, [texts], name, merge)


def leaf_strings(value: Any, path: tuple = ()) -> list[tuple[tuple, str]]:
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in leaf_strings(v, (*path, k))]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in leaf_strings(v, (*path, i))]
    return [(path, value)] if isinstance(value, str) and value.strip() else []


def drop_paths(value: Any, gone: set[tuple], path: tuple = ()) -> Any:
    """Without the leaves at ``gone``; objects inside lists that become empty vanish."""
    if isinstance(value, dict):
        return {k: drop_paths(v, gone, (*path, k)) for k, v in value.items() if (*path, k) not in gone}
    if isinstance(value, list):
        kept = [(v, drop_paths(v, gone, (*path, i))) for i, v in enumerate(value) if (*path, i) not in gone]
        return [new for old, new in kept if not (isinstance(old, dict) and old and not new)]
    return value


def grounded(df: DataFrame, extracted: str, document: str, name: str = "grounded", keep=None) -> DataFrame:
    """Add the extraction without strings that the document does not hold, case aside;
    ``keep(value, document)`` may rescue one. Broken JSON and null stay as they are."""

    def check(text: str | None, doc: str | None) -> str | None:
        try:
            value = json.loads(text)
        except (TypeError, ValueError):
            return text
        low = (doc or "").lower()
        gone = {p for p, s in leaf_strings(value) if s.lower() not in low and not (keep and keep(s, doc))}
        return json.dumps(drop_paths(value, gone), ensure_ascii=False)

    return _json_udf(df, [extracted, document], name, check)


def ground_counts(df: DataFrame, extracted: str, document: str) -> DataFrame:
    """Add ``strings`` and ``found``: the non-blank strings of an extraction and how many of them
    the document holds, case aside; null where it is no JSON."""
    keep = [x for x in df.schema.fields if x.name not in ("strings", "found")]
    names = [x.name for x in keep]
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in keep) + ", strings bigint, found bigint"
    at = names.index(extracted), names.index(document)

    def count(text: str | None, doc: str | None) -> tuple[int | None, int | None]:
        try:
            value = json.loads(text)
        except (TypeError, ValueError):
            return None, None
        low, strings = (doc or "").lower(), leaf_strings(value)
        return len(strings), sum(s.lower() in low for _, s in strings)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [count(t, d) for t, d in zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist())]
            return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([r[i] for r in rows], pa.int64()) for i in range(2)]], [*names, "strings", "found"])

        return step

    return map_batches(df.select(*names), schema, make)
