"""Scalar text functions as Column expressions; all map null to null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}\x{85}]+|[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}\x{85}]+$", "")


def normalise(c: Column) -> Column:
    return F.lower(strip(c))


def equal_score(predicted: Column, expected: Column) -> Column:
    """1.0 if equal apart from case and outer white space, else 0.0; null if a side is."""
    return (normalise(predicted) == normalise(expected)).cast("double")


def exact_compare(a: Column, b: Column, case_sensitive: bool = False, ignore_spaces: bool = False) -> Column:
    def form(c: Column) -> Column:
        c = strip(c)
        c = c if case_sensitive else F.lower(c)
        return F.replace(c, F.lit(" "), F.lit("")) if ignore_spaces else c

    return form(a) == form(b)


def at_least(actual: Column, least: float = 0.0) -> Column:
    """A missing value counts as 0."""
    return F.coalesce(actual, F.lit(0.0)) >= F.lit(least)


def format_text(template: Column, content: Column) -> Column:
    """Every literal ``{content}`` replaced; a null content counts as empty."""
    return F.replace(template, F.lit("{content}"), F.coalesce(content, F.lit("")))


def format_map(template: Column, values: Column) -> Column:
    """Every ``{word}`` of the template replaced by its value; missing and null ones by ''."""
    keys = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1)))
    return F.aggregate(keys, template, lambda t, k: F.replace(t, F.concat(F.lit("{"), k, F.lit("}")), F.coalesce(values[k], F.lit(""))))


def truncate(c: Column, size: int = 200) -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("…"))).otherwise(c)


def repeat_prompt(c: Column, times: int) -> Column:
    """The prompt two or three times, joined by a request to read it again."""
    again = F.lit("\n\nLet me repeat that:\n\n")
    return F.concat(*[x for i in range(times) for x in ([again, c] if i else [c])])


def strip_fence(c: Column) -> Column:
    """What stands between the first code fences, or the text itself."""
    inner = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(c.rlike(r"(?s)```(?:json)?\s*.*?```"), inner).otherwise(c)


def vote(c: Column) -> Column:
    """'correct' or 'incorrect' from a validator's answer: its first line decides, else
    the whole; without either word it is incorrect, also if null."""
    low = F.lower(c)
    first = F.substring_index(strip(low), "\n", 1)
    pick = lambda x: F.when(x.contains("incorrect"), "incorrect").when(x.contains("correct"), "correct")
    return F.coalesce(pick(first), pick(low), F.lit("incorrect"))


def f_score(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def search_rank(name: Column, term: str) -> Column:
    """0 exact, 1 prefix, 2 exact after the provider, 3 prefix after it, 4 contained, else null."""
    low, t = F.lower(name), term.lower()
    tail = F.substring_index(low, "/", -1)
    return (
        F.when(low == t, 0).when(low.startswith(t), 1).when(tail == t, 2).when(tail.startswith(t), 3).when(low.contains(t), 4)
    )


def match_key(item: Column, keys: list[str], size: int = 512) -> Column:
    """``key: value`` lines of the chosen members of a struct that are not null, cut to ``size``."""
    lines = [F.when(item[k].isNotNull(), F.concat(F.lit(f"{k}: "), item[k].cast("string"))) for k in keys]
    return F.left(F.concat_ws("\n", *lines), F.lit(size))


def input_hash(content: Column, prompt: Column, params: Column) -> Column:
    """SHA-256 of canonical JSON with sorted keys; a null part is JSON null."""
    part = lambda c: F.coalesce(F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6), F.lit("null"))
    text = F.concat(F.lit('{"content":'), F.when(content.isNull(), "null").otherwise(part(content)), F.lit(',"params":'), F.coalesce(params, F.lit("null")), F.lit(',"prompt":'), F.when(prompt.isNull(), "null").otherwise(part(prompt)), F.lit("}"))
    return F.sha2(text, 256)


# Media types by extension.
MEDIA = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp",
    "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff", "pdf": "application/pdf", "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4",
}


def media_hint(c: Column) -> Column:
    """Media type of an attachment from its data URI or its extension; null if unknown."""
    data = F.regexp_extract(c, r"^data:([^;,]+)", 1)
    ext = F.lower(F.regexp_extract(F.substring_index(c, "?", 1), r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    return F.when(data != "", data).otherwise(F.try_element_at(table, ext))


def media_sniff(data: Column) -> Column:
    """Media type from the first bytes; octet-stream if unknown, null for null."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("47494638"), "image/gif")
        .when(head.startswith("25504446"), "application/pdf").when(head.startswith("52494646") & head.endswith("57454250"), "image/webp")
        .when(head.isNotNull(), "application/octet-stream")
    )


def utc_millis(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
