"""Response schemas: inferred, turned into Spark types, and checked against labels."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spark types of JSON Schema types and of formats of strings.
PLAIN = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}
FORMATS = {"date-time": T.TimestampType(), "date": T.DateType(), "duration": T.DayTimeIntervalType()}
#: Labels beyond which an enumeration is no longer inferred.
ENUM_MOST = 50


def infer_schema(value: Any, depth: int = 0) -> dict:
    """JSON Schema of a label: objects require their members, lists take their first item's."""
    if isinstance(value, dict):
        return {"type": "object", "properties": {k: infer_schema(v, depth + 1) for k, v in value.items()}, "required": list(value)}
    if isinstance(value, list):
        return {"type": "array", "items": infer_schema(value[0], depth + 1) if value else {"type": "string"}}
    kind = "boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "number" if isinstance(value, float) else "string"
    return {"type": kind} if value is not None else {"anyOf": [{"type": "string"}, {"type": "null"}]}


def schema_of_labels(labels: DataFrame, value: str = "value", order: str = "document_id") -> dict:
    """From the first label: its structure if it is an object or list, else an object with a
    ``label`` that is one of the distinct labels (ENUM_MOST at most) or any string."""
    first = labels.where(F.col(value).isNotNull()).orderBy(order, value).select(value).first()
    try:
        parsed = json.loads(first[0]) if first else None
    except ValueError:
        parsed = None
    if isinstance(parsed, (dict, list)):
        return infer_schema(parsed)
    seen = [r[0] for r in labels.where(F.length(F.trim(value)) > 0).select(value).distinct().limit(ENUM_MOST + 1).collect()]
    label = {"type": "string", "enum": sorted(seen)} if 0 < len(seen) <= ENUM_MOST else {"type": "string"}
    return {"type": "object", "properties": {"label": label}, "required": ["label"]}


def _resolved(schema: dict, root: dict) -> dict:
    ref = schema.get("$ref")
    if not ref:
        return schema
    node: Any = root
    for part in ref.lstrip("#/").split("/"):
        node = node[part]
    return node


def to_type(schema: dict, root: dict | None = None, inside: tuple[str, ...] = ()) -> T.DataType:
    """The Spark type: a nullable union is its other branch, any other union and a schema
    inside itself a VARIANT. Unknown types raise."""
    root = schema if root is None else root
    if schema.get("$ref"):
        if schema["$ref"] in inside or schema["$ref"] == "#":
            return T.VariantType()
        inside = (*inside, schema["$ref"])
    schema = _resolved(schema, root)
    kinds = schema.get("type")
    branches = schema.get("anyOf") or ([{**schema, "type": k} for k in kinds] if isinstance(kinds, list) else None)
    if branches:
        real = [b for b in branches if b.get("type") != "null"]
        return to_type(real[0], root, inside) if len(real) == 1 else T.VariantType()
    if kinds == "array":
        return T.ArrayType(to_type(schema.get("items") or {"type": "string"}, root, inside))
    if kinds == "object" or "properties" in schema:
        need = set(schema.get("required", ()))
        members = [T.StructField(k, to_type(v, root, inside), k not in need) for k, v in schema.get("properties", {}).items()]
        return T.StructType(members) if members else T.VariantType()
    if kinds is None and "enum" in schema:
        return PLAIN["string"]
    if kinds not in PLAIN:
        raise ValueError(f"unknown type in schema: {kinds!r}")
    return FORMATS.get(schema.get("format", ""), PLAIN[kinds]) if kinds == "string" else PLAIN[kinds]


def to_struct(schema: dict) -> T.StructType:
    out = to_type(schema)
    if not isinstance(out, T.StructType):
        raise ValueError("a response schema is an object")
    return out


def problems(value: Column, schema: dict, path: str = "$", root: dict | None = None, inside: int = 0) -> Column:
    """Array of texts, one for each way in which a VARIANT breaks a schema. Levels below the
    eighth of a schema inside itself are not looked at."""
    root = schema if root is None else root
    schema = _resolved(schema, root)
    none = F.array().cast("array<string>")
    if inside > 8:
        return none
    kind = F.schema_of_variant(value)
    missing = value.isNull() | (kind == "VOID")

    def say(bad: Column, text: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), F.array(F.lit(f"{path}: {text}"))).otherwise(none)

    kinds = schema.get("type")
    branches = schema.get("anyOf") or ([{**schema, "type": k} for k in kinds] if isinstance(kinds, list) else None)
    if branches:
        good = F.lit(False)
        for b in branches:
            good = good | (missing if b.get("type") == "null" else F.size(problems(value, b, path, root, inside + 1)) == 0)
        return say(~good, "no branch fits")
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    is_number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    wrong = {
        "string": kind != "STRING", "boolean": kind != "BOOLEAN", "number": ~is_number, "integer": ~(is_number & (number == F.floor(number))),
        "array": ~kind.startswith("ARRAY"), "object": ~kind.startswith("OBJECT"),
    }
    rules: list[Column] = []
    if kinds in wrong:
        rules.append(say(missing | wrong[kinds], f"not of type {kinds}"))
    if "enum" in schema:
        rules.append(say(~missing & ~text.isin([str(x) for x in schema["enum"]]), "not one of the values"))
    bounds = {"minimum": lambda b: number < b, "maximum": lambda b: number > b, "exclusiveMinimum": lambda b: number <= b, "exclusiveMaximum": lambda b: number >= b, "multipleOf": lambda b: F.abs(number / b - F.round(number / b)) > 1e-9}
    rules += [say(is_number & f(schema[k]), k) for k, f in bounds.items() if k in schema]
    if "pattern" in schema:
        rules.append(say((kind == "STRING") & ~text.rlike(schema["pattern"]), "pattern"))
    formats = {"date-time": lambda c: c.try_cast("timestamp").isNull(), "date": lambda c: c.try_cast("date").isNull(), "uuid": lambda c: ~c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), "time": lambda c: ~c.rlike(r"^\d\d:\d\d(:\d\d(\.\d+)?)?"), "duration": lambda c: ~c.rlike("^P")}
    if schema.get("format") in formats:
        rules.append(say((kind == "STRING") & formats[schema["format"]](text), f"format {schema['format']}"))
    if kinds == "array":
        items = F.try_variant_get(value, "$", "array<variant>")
        rules += [say(F.size(items) < schema[k], k) for k in ("minItems",) if k in schema] + [say(F.size(items) > schema[k], k) for k in ("maxItems",) if k in schema]
        if schema.get("items"):
            rules.append(F.array_distinct(F.flatten(F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda x: problems(x, schema["items"], f"{path}[*]", root, inside + 1)))))
    for name, part in schema.get("properties", {}).items():
        member = F.try_variant_get(value, f"$['{name}']", "variant")
        below = problems(member, part, f"{path}.{name}", root, inside + 1)
        absent = member.isNull() | (F.schema_of_variant(member) == "VOID")
        rules.append(below if name in schema.get("required", ()) else F.when(absent, none).otherwise(below))
    if not rules:
        return none
    own, rest = rules[0], rules[1:]
    return F.when(F.size(own) > 0, own).otherwise(F.concat(*rest)) if rest else own


def violations(labels: DataFrame, schema: dict, key: str = "document_id", value: str = "value") -> DataFrame:
    """``key, problems`` of every label that breaks the schema; text that is no JSON is one."""
    parsed = labels.select(key, F.col(value).alias("_t")).withColumn("_v", F.try_parse_json("_t"))
    found = F.when(F.col("_v").isNull(), F.array(F.lit("$: no JSON"))).otherwise(problems(F.col("_v"), schema))
    return parsed.select(key, found.alias("problems")).where(F.size("problems") > 0)


def check_labels(labels: DataFrame, schema: dict, key: str = "document_id", value: str = "value", told: int = 20) -> None:
    """Raises with the number of labels that break the schema and the first ``told`` of them."""
    bad = violations(labels, schema, key, value)
    some = bad.orderBy(key).limit(told).collect()
    if some:
        raise ValueError(f"{bad.count()} labels break the schema, such as " + "; ".join(f"{r[key]} ({', '.join(r.problems)})" for r in some))


def plain(value: Column) -> Column:
    """Whether a label is no JSON object or list; null is plain."""
    kind = F.schema_of_variant(F.try_parse_json(value))
    return F.coalesce(~(kind.startswith("OBJECT") | kind.startswith("ARRAY")), F.lit(True))


def wraps(schema: dict | None) -> bool:
    """Whether a schema is an object with a single string named label."""
    members = (schema or {}).get("properties", {})
    return list(members) == ["label"] and (members["label"].get("type") == "string" or "enum" in members["label"])


def wrap_labels(labels: DataFrame, schema: dict | None, value: str = "value") -> DataFrame:
    """``{"label": value}`` in place of each label, if the schema asks for it and all labels
    are plain; else as they are. Nulls stay null."""
    if not wraps(schema):
        return labels
    mixed = labels.agg(F.bool_and(plain(F.col(value))).alias("p"))
    wrapped = F.when(F.col(value).isNotNull(), F.to_json(F.struct(F.col(value).alias("label"))))
    return labels.join(F.broadcast(mixed)).withColumn(value, F.when(F.coalesce("p", F.lit(True)), wrapped).otherwise(F.col(value))).drop("p")


def envelope(schema: dict, name: str = "response") -> dict:
    """As a request to a model carries it."""
    return {"type": "json_schema", "json_schema": {"name": name, "schema": schema, "strict": True}}


def json_block(prompt: str) -> dict | list | None:
    """The first JSON object or list inside a prompt, fenced or bare."""
    decode = json.JSONDecoder().raw_decode
    for at in sorted(i for i, c in enumerate(prompt) if c in "{["):
        try:
            value = decode(prompt, at)[0]
        except ValueError:
            continue
        if value and (isinstance(value, dict) or any(isinstance(x, (dict, list, str)) for x in value)):
            return value
    return None
