"""Nested JSON to flat, linked tables.

Each record is streamed once into path-value-ordinal triples. Triples are grouped by
their nearest repeated ancestor and pivoted: every object becomes one row of the table
named by its path with list positions left out, knows its own path, its position and
the path of its enclosing object, and holds its scalar members as attributes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .arrowmap import map_batches

PREDICTION_FIELDS = ("field_metrics", "predicted_value", "expected_value")

#: A bracket and what may follow it in JSON, also in JSON inside a JSON string.
_OPENS = re.compile(
    r'\{(?:\s|\\+[nrt])*(?:\\*"|\}|$)'
    r'|\[(?:\s|\\+[nrt])*(?:\\*"|[\[{\]]|-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?\s*[,\]]|(?:true|false|null)\s*[,\]]|NaN|-?Infinity|$)'
)

_decode = json.JSONDecoder(strict=False).raw_decode


def find_json(text: str | None):
    """The JSON value in a text, or None.

    The value may stand alone, in a code fence, among words, or be encoded again as a
    JSON string. It starts at the first bracket (or at the quote before it) after which
    there could be JSON; if no complete value starts there, there is none: later brackets
    are inside it. Brackets of prose, such as [see text], and scalars are no value.
    """
    for _ in range(8):
        if not text:
            return None
        found = _OPENS.search(text)
        if not found:
            return None
        at = found.start()
        head = text[:at].rstrip()
        value = None
        # A quote before the bracket opens an encoded string, unless it is part of the words.
        for start in ([len(head) - 1] if head.endswith('"') else []) + [at]:
            try:
                value, _ = _decode(text, start)
                break
            except (ValueError, RecursionError):
                continue
        if not isinstance(value, str):
            return value
        text = value
    return None


def is_branch(value) -> bool:
    """Whether this is a list that holds objects or lists."""
    return isinstance(value, list) and any(isinstance(x, (dict, list)) for x in value)


def triples(value) -> Iterator[tuple[str, str, int, str, bool, int, object]]:
    """(path, table, owner, name, keyed, ordinal, value) of every value inside, parents
    first; a list of scalars is one value.

    ``owner`` is the number of the enclosing object, counting objects as they come, -1
    for none; ``name`` is the path from there on, ``keyed`` if it is one key. The table
    is the path with list positions left out: steps are told apart by kind, not by print.
    """
    stack, objects = [("$", "$", -1, "$", False, 0, value)], 0
    while stack:
        item = stack.pop()
        yield item
        path, table, owner, name, _, _, value = item
        if isinstance(value, dict):
            stack += [(f"{path}.{k}", f"{table}.{k}", objects, k, True, i, v) for i, (k, v) in enumerate(value.items())][::-1]
            objects += 1
        elif is_branch(value):
            stack += [(f"{path}[{i}]", f"{table}[*]", owner, f"{name}[{i}]", False, i, v) for i, v in enumerate(value)][::-1]


def table_of(path: str) -> str:
    """The path with every list position replaced by [*]."""
    out, rest = [], path
    while rest:
        a, bracket, b = rest.partition("[")
        out.append(a)
        digits, close, after = b.partition("]")
        if bracket and close and digits.isdigit():
            out.append("[*]")
            rest = after
        else:
            out.append(bracket)
            rest = b
    return "".join(out)


def pivot(value) -> list[tuple[str, str, str, int, dict[str, str]]]:
    """(node path, parent path, table, ordinal, attributes) of each object.

    Scalar members are attributes: text as it is, other scalars as JSON; a null has
    none. A list without objects and lists is one attribute, its JSON text; the scalars
    of any other list are attributes named by key and position, such as ``note[0]``, and
    so are lists in it. A positional name that is also a key gets quotes behind it. What
    stands in no object, in a list that is the whole value, is held by a last row with
    path and table ``$``, of that list. Objects whose paths print alike keep a row each.
    """
    rows: list[tuple] = []
    placed: list[tuple[int, str, str]] = []
    for path, table, owner, name, keyed, ordinal, v in triples(value):
        if isinstance(v, dict):
            rows.append((path, rows[owner][0] if owner >= 0 else "", table, ordinal, {}))
        elif v is not None and not is_branch(v):
            text = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
            if keyed:
                rows[owner][4][name] = text
            else:
                placed.append((owner, name, text))
    if any(owner < 0 for owner, _, _ in placed):
        rows.append(("$", "", "$", 0, {}))  # owner -1 is the last row
    for owner, name, text in placed:
        held = rows[owner][4]
        while name in held:
            name += "'"
        held[name] = text
    return rows


def object_paths(value) -> list[tuple[str, str]]:
    """(path, enclosing object's path) of every object inside: the pivoted rows without attributes."""
    whole = isinstance(value, list)  # a list at the top has a row and is no object
    return list(dict.fromkeys(row[:2] for row in pivot(value) if not (whole and row[0] == "$")))


def flatten(df: DataFrame, key: str, fields: list[str], attributes: bool = True) -> DataFrame:
    """A row for each JSON object in the ``fields`` of ``df``, and with ``attributes`` for
    each list that is a whole value and holds what is in no object.

    Columns ``key, field_name, node_path, parent_path`` and, with ``attributes``,
    ``table_path, ordinal, attributes`` (a map). Rows with a null key stay under null;
    rows repeated under one key count once. Null, empty or incomplete JSON has no
    nodes. Other columns are ignored, whatever their names. Rows with a null key are told
    apart by their texts only.
    """
    kind = dict(df.dtypes)[key]
    texts = [F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]
    opens = ("{", "[") if attributes else ("{",)
    holds = F.lit(False)
    for i in range(len(fields)):
        for c in opens:
            holds |= F.coalesce(F.col(f"f{i}").contains(c), F.lit(False))
    rows = spread(df.select(F.col(key).alias("k"), *texts).where(holds))
    apart = F.when(F.col("k").isNull(), F.xxhash64(*[f"f{i}" for i in range(len(fields))]))
    rows = rows.withColumn("_apart", apart).dropDuplicates(["k", "_apart"]).drop("_apart")
    schema = f"k {kind}, field_name string, node_path string, parent_path string" + (
        ", table_path string, ordinal int, attributes map<string,string>" if attributes else ""
    )

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, name, nodes = [], [], []
            for i, field in enumerate(fields):
                for at, text in enumerate(batch.column(i + 1).to_pylist()):
                    if text and any(c in text for c in opens):
                        value = find_json(text)
                        if value is not None:
                            found = pivot(value) if attributes else object_paths(value)
                            nodes += found
                            row += [at] * len(found)
                            name += [field] * len(found)
            columns = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(name, pa.string())]
            columns += [pa.array([n[i] for n in nodes], pa.string()) for i in range(2)]
            if attributes:
                columns += [pa.array([n[2] for n in nodes], pa.string()), pa.array([n[3] for n in nodes], pa.int32())]
                columns += [pa.array([list(n[4].items()) for n in nodes], pa.map_(pa.string(), pa.string()))]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

        return step

    return map_batches(rows, schema, make).withColumnRenamed("k", key)


def table_paths(nodes: DataFrame) -> DataFrame:
    """``field_name, table_path, parent_table, columns, n`` of the tables in flattened nodes (with
    attributes): one for each repeated path, with the names of its scalar members."""
    parent = F.when(F.col("parent_path") != "", F.regexp_replace("parent_path", r"\[[0-9]+\]", "[*]"))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("attributes")))))
    return nodes.groupBy("field_name", "table_path").agg(F.min(parent).alias("parent_table"), names.alias("columns"), F.count("*").alias("n"))


def as_table(nodes: DataFrame, key: str, field: str, path: str) -> DataFrame:
    """One flat table of flattened nodes: ``key, node_path, parent_path, ordinal`` and a text column
    for each scalar member that any of its objects has. Members named like one of those
    get ``_`` behind them."""
    rows = nodes.where((F.col("field_name") == field) & (F.col("table_path") == path))
    names = [r[0] for r in rows.select(F.explode(F.map_keys("attributes"))).distinct().orderBy("col").collect()]
    fixed = [key, "node_path", "parent_path", "ordinal"]
    taken, columns = {f.lower() for f in fixed}, []
    for n in names:
        name = n
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        columns.append(F.col("attributes")[n].alias(name))
    return rows.select(*fixed, *columns)
