"""Percentiles from deterministic, mergeable rank-interval summaries.

A summary holds tuples (value, lowest rank, highest rank) in value order and the count
n. The rank of a value is known exactly in a summary of sorted values; merging two
summaries adds the ranks of a tuple and of its neighbours in the other one; compressing
drops tuples while the gap between the highest rank of a kept tuple and the lowest rank
of the one before stays within twice the permitted error. The accumulated rank error is
half the widest gap, so it is read off the summary and never assumed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.arrowmap import map_batches
from ..session import UNKNOWN_BYTES, plan_bytes

#: Greatest rank error, as a share of the count, after the last of the STAGES.
EPS, STAGES = 0.001, 3
#: Rows that a task sorts at once.
CHUNK_ROWS = 500_000


class Summary(NamedTuple):
    v: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    n: int


def exact(values: np.ndarray) -> Summary:
    """Of sorted values."""
    ranks = np.arange(1, len(values) + 1)
    return Summary(values, ranks, ranks, len(values))


def merge(a: Summary, b: Summary) -> Summary:
    """Both together; ranks of ``a`` come first among equal values."""
    if not a.n or not b.n:
        return a if a.n else b

    def lift(x: Summary, y: Summary, side: str) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(y.v, x.v, side)
        below = np.concatenate(([0], y.lo))[at]
        above = np.concatenate((y.hi - 1, [y.n]))[at]
        return x.lo + below, x.hi + above

    (alo, ahi), (blo, bhi) = lift(a, b, "left"), lift(b, a, "right")
    v = np.concatenate((a.v, b.v))
    order = np.argsort(v, kind="stable")
    return Summary(v[order], np.concatenate((alo, blo))[order], np.concatenate((ahi, bhi))[order], a.n + b.n)


def compress(s: Summary, error: float) -> Summary:
    """The fewest tuples, both ends among them, whose gaps are within ``2 * error``
    ranks wherever the gaps of ``s`` are."""
    if len(s.v) < 3 or 2 * error < 2:
        return s
    keep, at, last = [0], 0, len(s.v) - 1
    while at < last:
        at = max(at + 1, int(np.searchsorted(s.hi, s.lo[at] + 2 * error, "right")) - 1)
        keep.append(at)
    return Summary(s.v[keep], s.lo[keep], s.hi[keep], s.n)


def rank_error(s: Summary) -> float:
    """Ranks by which the answer to any percentile may be off."""
    if len(s.v) < 2:
        return 0.0
    return max(float((s.hi[1:] - s.lo[:-1]).max()) / 2, float((s.hi - s.lo).max()) / 2)


def query(s: Summary, p: float) -> float:
    """A value whose rank is within ``rank_error`` of the target rank, ceil(p n)."""
    target = min(s.n, max(1, int(np.ceil(p * s.n - 1e-9))))
    off = np.maximum(target - s.lo, s.hi - target)
    return float(s.v[int(np.argmin(off))])


def _merge_all(parts: list[Summary]) -> Summary:
    """Pairwise, as a balanced tree."""
    while len(parts) > 1:
        parts = [merge(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


_SUMMARY = "v array<double>, lo array<bigint>, hi array<bigint>, n bigint"


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _pack(parts: list[Summary]) -> list[pa.Array]:
    sizes = np.array([len(s.v) for s in parts], dtype=np.int64)
    cat = lambda k, t: np.concatenate([s[k] for s in parts] or [np.empty(0)]).astype(t)
    return [_lists(cat(0, np.float64), sizes), _lists(cat(1, np.int64), sizes), _lists(cat(2, np.int64), sizes), pa.array([s.n for s in parts], pa.int64())]


def partition_summaries(rows: DataFrame, keys: list[str], measures: list[str], eps: float = EPS) -> DataFrame:
    """``keys, measure`` and a summary of each group in each chunk of each partition.

    Nulls and NaN are left out; a group without values gives no row.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", measure string, " + _SUMMARY
    share = eps / STAGES

    def summarise(table: pa.Table) -> Iterator[pa.RecordBatch]:
        codes = np.zeros(table.num_rows, dtype=np.int64)
        for k in keys:
            part = table[k].combine_chunks().dictionary_encode(null_encoding="encode")
            codes = codes * (len(part.dictionary) + 1) + part.indices.to_numpy(zero_copy_only=False)
        for measure in measures:
            values = table[measure].to_numpy().astype(np.float64)
            good = np.flatnonzero(~np.isnan(values))
            order = good[np.lexsort((values[good], codes[good]))]
            if not len(order):
                continue
            v, c = values[order], codes[order]
            starts = np.concatenate(([0], np.flatnonzero(np.diff(c)) + 1))
            ends = np.concatenate((starts[1:], [len(c)]))
            parts = [compress(exact(v[a:b]), share * (b - a)) for a, b in zip(starts, ends)]
            at = pa.array(order[starts])
            heads = [table[k].combine_chunks().take(at) for k in keys]
            heads = [h.combine_chunks() if isinstance(h, pa.ChunkedArray) else h for h in heads]
            yield pa.RecordBatch.from_arrays([*heads, pa.array([measure] * len(parts)), *_pack(parts)], [*keys, "measure", "v", "lo", "hi", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= CHUNK_ROWS:
                yield from summarise(pa.Table.from_batches(held))
                held, count = [], 0
        if count:
            yield from summarise(pa.Table.from_batches(held))

    return rows.select(*keys, *measures).mapInArrow(run, schema)


def merge_summaries(parts: DataFrame, keys: list[str], stage: int, eps: float = EPS) -> DataFrame:
    """One summary for each group of ``keys`` and measure, compressed to the error
    permitted after ``stage`` of the STAGES. Only summaries are shuffled."""
    by = [*keys, "measure"]
    kinds = dict(parts.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", " + _SUMMARY
    share = eps * stage / STAGES
    grouped = parts.groupBy(*by).agg(F.collect_list(F.struct("v", "lo", "hi", "n")).alias("s"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(len(by))
            flat = lists.flatten()
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(int)
            columns = [flat.field(i) for i in range(3)]
            bounds = np.concatenate(([0], np.cumsum(columns[0].value_lengths().to_numpy(zero_copy_only=False)))).astype(int)
            v, lo, hi = (c.flatten().to_numpy(zero_copy_only=False) for c in columns)
            n = flat.field(3).to_numpy(zero_copy_only=False)
            each = [Summary(v[a:b], lo[a:b], hi[a:b], int(k)) for a, b, k in zip(bounds, bounds[1:], n)]
            out = []
            for a, b in zip(ends, ends[1:]):
                s = _merge_all(each[a:b])
                out.append(compress(s, share * s.n))
            return pa.RecordBatch.from_arrays([*batch.columns[: len(by)], *_pack(out)], [*by, "v", "lo", "hi", "n"])

        return step

    return map_batches(grouped, schema, make)


def percentiles(summaries: DataFrame, keys: list[str], ps: tuple[float, ...]) -> DataFrame:
    """``keys, measure, p, value, n, rank_error``: one row for each group and p."""
    by = [*keys, "measure"]
    kinds = dict(summaries.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", p double, value double, n bigint, rank_error double"

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            value, error, n = [], [], batch.column(len(by) + 3).to_pylist()
            for v, lo, hi, k in zip(*[batch.column(len(by) + i) for i in range(3)], n):
                s = Summary(*[x.values.to_numpy(zero_copy_only=False) for x in (v, lo, hi)], k)
                e = rank_error(s)
                value += [query(s, p) for p in ps]
                error += [e] * len(ps)
            at = pa.array(np.repeat(np.arange(batch.num_rows), len(ps)))
            heads = [c.take(at) for c in batch.columns[: len(by)]]
            return pa.RecordBatch.from_arrays(
                [*heads, pa.array(np.tile(ps, batch.num_rows), pa.float64()), pa.array(value, pa.float64()), pa.array(np.repeat(n, len(ps)), pa.int64()), pa.array(error, pa.float64())],
                [*by, "p", "value", "n", "rank_error"],
            )

        return step

    return map_batches(summaries, schema, make)


def day_and_model_percentiles(predictions: DataFrame, measures: list[str], failed: dict[str, float], ps: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99), eps: float = EPS) -> DataFrame:
    """Percentiles per model and day, and per model from the summaries of its days.

    Columns ``level`` ('day' or 'model'), ``model, day, measure, p, value, n,
    rank_error``; day is null at level model and for rows without a time. A repeated
    ``prediction_id`` counts once. Nulls, NaN and the ``failed`` sentinel of a measure
    are no values; ties share their value. Empty input gives no rows.

    Rows move once: they are partitioned by model, day and, beyond a gigabyte of input,
    a salt of their id, so that repeats meet and no hot group is one task's alone.
    """
    size = plan_bytes(predictions)
    salts = min(1024, 1 + (size >> 30)) if size < UNKNOWN_BYTES else 16
    clean = [F.when(F.col(m) != failed[m], F.col(m)).alias(m) if m in failed else F.col(m) for m in measures]
    rows = (
        predictions.select("prediction_id", "model", F.to_date("completed_at").alias("day"), *clean)
        .withColumn("salt", F.pmod(F.xxhash64("prediction_id"), F.lit(salts)))
        .repartition("model", "day", "salt")
        .dropDuplicates(["model", "day", "salt", "prediction_id"])
    )
    parts = partition_summaries(rows, ["model", "day", "salt"], measures, eps)
    if salts > 64:
        parts = merge_summaries(parts.withColumn("salt", F.pmod("salt", F.lit(32))), ["model", "day", "salt"], 1, eps)
    days = merge_summaries(parts.drop("salt"), ["model", "day"], 2, eps)
    models = merge_summaries(days, ["model"], 3, eps)
    by_day = percentiles(days, ["model", "day"], ps).withColumn("level", F.lit("day"))
    by_model = percentiles(models, ["model"], ps).withColumn("level", F.lit("model")).withColumn("day", F.lit(None).cast("date"))
    columns = ["level", "model", "day", "measure", "p", "value", "n", "rank_error"]
    return by_day.select(*columns).unionByName(by_model.select(*columns))


def rank_checks(found: DataFrame, predictions: DataFrame, measures: list[str], failed: dict[str, float], eps: float = EPS) -> DataFrame:
    """``model, measure, p, n, within`` of the answers at level model: whether the ranks that
    the value truly holds come within ``rank_error`` of the target, and that within the bound."""
    asked = found.where("level = 'model'").select("model", "measure", "p", "value", F.col("n").alias("told"), "rank_error")
    rows = predictions.select("prediction_id", "model", *measures).dropDuplicates(["prediction_id"])
    clean = [F.struct(F.lit(m).alias("measure"), (F.when(F.col(m) != failed[m], F.col(m)) if m in failed else F.col(m)).alias("x")) for m in measures]
    values = rows.select("model", F.explode(F.array(*clean)).alias("v")).select("model", "v.*").where("x IS NOT NULL AND NOT isnan(x)")
    counted = values.groupBy("model", "measure", "x").agg(F.count("*").alias("c"))
    at = counted.withColumnRenamed("model", "_m").withColumnRenamed("measure", "_k")
    both = asked.join(at, F.col("model").eqNullSafe(F.col("_m")) & (F.col("measure") == F.col("_k")))
    n, below, upto = F.sum("c"), F.sum(F.when(F.col("x") < F.col("value"), F.col("c")).otherwise(0)), F.sum(F.when(F.col("x") <= F.col("value"), F.col("c")).otherwise(0))
    ranks = both.groupBy("model", "measure", "p", "value", "told", "rank_error").agg(n.alias("n"), below.alias("below"), upto.alias("upto"))
    target = F.least(F.col("n"), F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n") - 1e-9)))
    off = F.greatest(F.col("below") + 1 - target, target - F.col("upto"), F.lit(0))
    within = (F.col("told") == F.col("n")) & (off <= F.col("rank_error")) & (F.col("rank_error") <= F.greatest(F.lit(1.0), eps * F.col("n")))
    return ranks.select("model", "measure", "p", "n", within.alias("within"))
