"""Text similarity as Arrow UDFs, embedding similarity as expressions."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """2 LCS / (len a + len b); 1.0 for two empty texts."""
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def _grams(words: list[str], n: int) -> Counter:
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def bleu(reference: str, candidate: str) -> float:
    """Sentence BLEU up to 4-grams; an n-gram order without a match counts 0.1 of one."""
    ref, cand = reference.split(), candidate.split()
    if not cand or not ref or not (_grams(ref, 1) & _grams(cand, 1)):
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        grams = _grams(cand, n)
        total = max(1, sum(grams.values()))
        hit = sum((grams & _grams(ref, n)).values())
        logs += math.log((hit or 0.1) / total) / 4
    brevity = 1.0 if len(cand) > len(ref) else math.exp(1 - len(ref) / len(cand))
    return brevity * math.exp(logs)


def gleu(reference: str, candidate: str) -> float:
    """Matching 1- to 4-grams over the larger of both numbers of them."""
    ref, cand = reference.split(), candidate.split()
    a = sum((_grams(ref, n) for n in range(1, 5)), Counter())
    b = sum((_grams(cand, n) for n in range(1, 5)), Counter())
    most = max(sum(a.values()), sum(b.values()))
    return sum((a & b).values()) / most if most else 0.0


def _udf(f):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


ratio_udf, bleu_udf, gleu_udf = _udf(ratio), _udf(bleu), _udf(gleu)


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors; 0 if one has no length, null if a side is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).when(size == 0, F.lit(0.0))


def text_similarity(metric: str, expected: Column, actual: Column) -> Column:
    """'fuzz_ratio', 'bleu' or 'gleu' of the texts without case and outer space."""
    from .text import normalise

    udfs = {"fuzz_ratio": ratio_udf, "bleu": bleu_udf, "gleu": gleu_udf}
    if metric not in udfs:
        raise ValueError(f"unknown text similarity: {metric}")
    return udfs[metric](normalise(expected), normalise(actual))
