"""One consistent form for texts that look alike but differ in their characters.

A mapping over code points is compiled once: width forms and Roman-numeral signs by
rule, look-alike letters, ligatures, spaces and invisible marks from fixed values. It
is checked for conflicts, then a longest-match transducer applies it in one pass over
grapheme clusters: each cluster (a base with its combining marks) is decomposed, its
base mapped, and the whole composed again, so that accents survive and their spelling
no longer matters. The half-width voicing marks of kana belong to the cluster before them.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.arrowmap import map_batches
from ..session import spread

# Letters that print like an ASCII letter, by script.
CYRILLIC = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ӀI ԌG ԚQ ԜW "
    "аa еe оo рp сc уy хx ѕs іi јj һh ӏl ԁd ԛq ԝw ѵv"
)
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ οo ρp νv ϲc ϳj"
OTHER = "ɡg օo ոn սu հh µμ"
# Half-width voicing marks, which go with the letter before them.
VOICING = "\uff9e\uff9f"
# Ligatures that print as their letters; hyphens that print as the ASCII one.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "‐": "-", "‑": "-"}
# Spaces with a width.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Marks without ink or width.
INVISIBLE = (
    "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e"
    "\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufeff"
)


def compile_mapping() -> dict[str, str]:
    """Code point -> replacement; raises if two rules disagree or a result is mapped again."""
    mapping: dict[str, str] = {}

    def put(source: str, target: str) -> None:
        if source == target:
            return
        if mapping.setdefault(source, target) != target:
            raise ValueError(f"conflict: {source!r} -> {mapping[source]!r} and {target!r}")

    for pair in " ".join((CYRILLIC, GREEK, OTHER)).split():
        put(pair[0], pair[1:])
    for source, target in LIGATURES.items():
        put(source, target)
    for first, last in ((0xFF01, 0xFFEE), (0x2160, 0x217F)):
        for code in range(first, last + 1):
            put(chr(code), unicodedata.normalize("NFKC", chr(code)))
    for space in SPACES:
        put(space, " ")
    for mark in INVISIBLE:
        put(mark, "")
    for source, target in mapping.items():
        if source.isascii() or any(c in mapping for c in target):
            raise ValueError(f"not idempotent: {source!r} -> {target!r}")
    return mapping


class Transducer:
    """``apply`` is the identity on ASCII, idempotent, and maps null to null."""

    def __init__(self, mapping: dict[str, str] | None = None):
        self.mapping = compile_mapping() if mapping is None else mapping
        invisible = "".join(k for k, v in self.mapping.items() if not v)
        joiners = "\u200c\u200d"
        plain = regex.escape("".join(c for c in invisible if c not in joiners))
        # One alternative for each kind of cluster, longest first. A joiner stays where
        # it shows: between pictographs, or after letters of scripts that shape them.
        self.cluster = regex.compile(
            rf"(?P<join>\p{{Extended_Pictographic}}[\p{{M}}\U0001F3FB-\U0001F3FF]*(?:\u200d\p{{Extended_Pictographic}}[\p{{M}}\U0001F3FB-\U0001F3FF]*)+)"
            rf"|(?P<shape>[\p{{Arabic}}\p{{Syriac}}\p{{Mongolian}}\p{{Devanagari}}\p{{Bengali}}\p{{Tamil}}\p{{Telugu}}\p{{Kannada}}\p{{Malayalam}}\p{{Sinhala}}]\p{{M}}*[{joiners}]+(?=[\p{{L}}]))"
            rf"|(?P<void>[{plain}{joiners}]+)"
            rf"|(?P<mark>[^\x00-\x7f][{plain}{joiners}]*(?:[\p{{M}}{VOICING}][{plain}{joiners}]*)*|[\x00-\x7f](?:[{plain}{joiners}]*\p{{M}})+)"
        )
        self.memo: dict[str, str] = {}

    def _emit(self, match: regex.Match) -> str:
        text = match.group()
        known = self.memo.get(text)
        if known is None:
            kind = match.lastgroup
            if kind == "join":
                known = text
            elif kind == "shape":
                known = unicodedata.normalize("NFC", text)
            else:
                parts = unicodedata.normalize("NFD", text)
                known = unicodedata.normalize("NFC", "".join(self.mapping.get(c, c) for c in parts))
            if len(self.memo) < 100_000:
                self.memo[text] = known
        return known

    def apply(self, text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        return self.cluster.sub(self._emit, text)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


def same_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<column>_form``, the consistent form of each text column.

    Null stays null; ASCII texts, empty ones included, are their own form. Repeated
    rows stay. An existing column of the new name is replaced.
    """
    keep = [c for c in df.columns if c not in {f"{x}_form" for x in columns}]
    fields = df.select(*keep).schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{c}_form` string" for c in columns])
    at = [keep.index(c) for c in columns]

    def make():
        apply = transducer().apply

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            added = [pa.array(map(apply, batch.column(i).to_pylist()), pa.string()) for i in at]
            return pa.RecordBatch.from_arrays([*batch.columns, *added], [*keep, *[f"{c}_form" for c in columns]])

        return step

    return map_batches(df.select(*keep), schema, make)


def lookalikes(pairs: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """Distinct ``key`` of the rows whose two texts differ but have the same form.

    Rows with a null side have none. Two different ASCII texts never share a form
    (the transducer leaves ASCII alone), so those pairs are settled in the scan.
    """
    wide = F.col("_a").rlike(r"[^\x00-\x7F]") | F.col("_b").rlike(r"[^\x00-\x7F]")
    rows = pairs.select(*key, F.col(a).alias("_a"), F.col(b).alias("_b")).where((F.col("_a") != F.col("_b")) & wide)
    formed = same_form(spread(rows), ["_a", "_b"])
    return formed.where(F.col("_a_form") == F.col("_b_form")).select(*key).distinct()
