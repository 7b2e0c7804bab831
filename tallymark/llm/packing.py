"""Vector bin packing of texts into windows of fixed capacity.

Each item has three demands: tokens, one segment, and loss-bearing tokens (of instruction
data, those of the answer). A window is
filled one item at a time with the item whose demand has the greatest dot product with
what is left of the window's limits, among those that fit all of them, until none does.
Only an item longer than the capacity is cut: into pieces that fill a window each, and a
rest that is packed like any item. Items are hashed to shards that are packed on their
own, so work is spread evenly however the sizes are; each shard leaves at most one
badly filled window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .tokenizer import DEFAULT_VOCABULARY, encode_texts

#: Items of a shard, on average.
SHARD_ITEMS = 20_000
#: Tokens of capacity for each segment that a window may hold.
TOKENS_PER_SEGMENT = 8
#: Windows that are packed in one pass; more are taken in further passes.
PASS_WINDOWS = 1_000


def fill(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Window number, from 0, of each row of ``demand`` (items x limits); each must fit alone.

    Equal demands are interchangeable, so choices are made among the distinct ones, and
    items of a demand are taken in the order given.
    """
    kinds, which = np.unique(demand, axis=0, return_inverse=True)
    which = which.reshape(-1)
    queue = np.argsort(which, kind="stable")
    left = np.bincount(which, minlength=len(kinds))
    head = np.concatenate(([0], np.cumsum(left)[:-1]))
    out = np.empty(len(demand), dtype=np.int64)
    scaled = kinds / np.maximum(limits, 1)
    alive = np.arange(len(kinds))
    window = 0
    while len(alive):
        room = limits.astype(np.int64).copy()
        while True:
            fits = alive[(kinds[alive] <= room).all(axis=1)]
            if not len(fits):
                break
            # What is left of each limit weighs its demand; ties go to the larger item.
            best = fits[int(np.argmax(scaled[fits] @ (room / np.maximum(limits, 1)) + 1e-9 * fits / len(kinds)))]
            out[queue[head[best]]] = window
            head[best] += 1
            left[best] -= 1
            room -= kinds[best]
            if not left[best]:
                alive = alive[alive != best]
        window += 1
    return out


def token_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key, tokens, loss``: sizes by the public tokenizer; every token but a text's first
    has a token before it to be predicted from, so those bear loss."""
    ids = encode_texts(docs, key, text, path)
    return ids.select(key, F.size("ids").cast("bigint").alias("tokens"), F.greatest(F.size("ids") - 1, F.lit(0)).cast("bigint").alias("loss"))


def pack(sizes: DataFrame, windows: DataFrame, key: str = "doc_id", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Assign items (``key, tokens, loss``) to windows of each row of ``windows``.

    Columns ``window_id, bin_id, key, piece, start_token, n_tokens``. ``bin_id`` is
    unique within a window_id. A window takes no more than its ``capacity_tokens``, than
    ``capacity_segments`` segments (one for each TOKENS_PER_SEGMENT of its tokens if that is
    null or no column) and than ``capacity_loss`` loss-bearing tokens (its tokens likewise).
    Of a single item with more loss than fits, only what fits is counted. Items without
    tokens, or of null size, take no room: they are listed with a null bin. Capacities
    below 1 raise. Equal sizes and repeated keys are items of their own.
    """
    optional = [c for c in ("capacity_segments", "capacity_loss") if c in windows.columns]
    rows = windows.select("window_id", "capacity_tokens", *optional).distinct().orderBy("window_id").collect()
    if any(r.capacity_tokens is None or r.capacity_tokens < 1 for r in rows):
        raise ValueError("capacities must be positive")

    def limit(r, name: str, otherwise: int) -> int:
        return int(r[name]) if name in optional and r[name] is not None else otherwise

    every = {r.window_id: (int(r.capacity_tokens), max(1, limit(r, "capacity_segments", r.capacity_tokens // TOKENS_PER_SEGMENT)), max(0, limit(r, "capacity_loss", r.capacity_tokens))) for r in rows}
    kind = dict(sizes.dtypes)[key]
    sizes = cut(sizes.select(F.col(key).alias("key"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), F.coalesce("loss", F.lit(0)).cast("bigint").alias("loss")))
    shards = max(1, -(-sizes.count() // shard_items))
    ids = sorted(every)
    passes = [{w: every[w] for w in ids[i : i + PASS_WINDOWS]} for i in range(0, max(1, len(ids)), PASS_WINDOWS)]
    out = None
    for limits in passes:
        part = _pack_pass(sizes, limits, shards, kind)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("key", key)


def _pack_pass(sizes: DataFrame, limits: dict[int, tuple[int, int, int]], shards: int, kind: str) -> DataFrame:
    choice = F.array(*[F.struct(F.lit(w).cast("int").alias("window_id"), F.lit(c[0]).cast("bigint").alias("cap")) for w, c in sorted(limits.items())])
    items = (
        sizes.where("tokens > 0")
        .withColumn("w", F.explode(choice if limits else F.expr("CAST(array() AS ARRAY<STRUCT<window_id: INT, cap: BIGINT>>)")))
        .select("key", "tokens", "loss", "w.window_id", "w.cap", F.pmod(F.xxhash64("key", "tokens"), F.lit(shards)).alias("shard"))
    )
    n = max(1, min(4 * sizes.sparkSession.sparkContext.defaultParallelism, shards * max(1, len(limits)))) if shards < 1000 else shards
    schema = f"window_id int, bin_id bigint, key {kind}, piece int, start_token bigint, n_tokens bigint"
    names = [c.split()[0] for c in schema.split(", ")]

    def pack_shard(table: pa.Table) -> pa.RecordBatch:
        window, shard = table["window_id"][0].as_py(), table["shard"][0].as_py()
        cap, segments, loss_cap = limits[window]
        tokens, loss = table["tokens"].to_numpy(), table["loss"].to_numpy()
        pieces = -(-tokens // cap)
        row = np.repeat(np.arange(len(tokens)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * cap
        size = np.minimum(cap, tokens[row] - start)
        # A piece bears loss in proportion to its share of the item, never more than fits.
        bears = np.minimum(np.minimum(-(-loss[row] * size // np.maximum(1, tokens[row])), size), loss_cap)
        demand = np.stack([size, np.ones_like(size), bears], axis=1)
        bins = fill(demand, np.array([cap, segments, loss_cap]))
        key_column = table["key"].combine_chunks().take(pa.array(row))
        columns = [pa.array(np.full(len(row), window), pa.int32()), pa.array((shard << 32) + bins, pa.int64()), key_column, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64())]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key_now = None
        for batch in batches:
            ids = batch.column(3).to_numpy(zero_copy_only=False) * np.int64(1 << 40) + batch.column(5).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    if held and ids[a] != key_now:
                        yield pack_shard(pa.Table.from_batches(held))
                        held = []
                    key_now = ids[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield pack_shard(pa.Table.from_batches(held))

    packed = items.repartition(n, "window_id", "shard").sortWithinPartitions("window_id", "shard", "key", "tokens").mapInArrow(run, schema)
    empty = (
        sizes.where("tokens <= 0")
        .withColumn("w", F.explode(choice if limits else F.expr("CAST(array() AS ARRAY<STRUCT<window_id: INT, cap: BIGINT>>)")))
        .select(F.col("w.window_id").alias("window_id"), F.lit(None).cast("bigint").alias("bin_id"), "key", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start_token"), F.lit(0).cast("bigint").alias("n_tokens"))
    )
    return packed.unionByName(empty)


def fill_report(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """``window_id, capacity_tokens, bins, tokens, unused_share`` over the windows in use."""
    used = packed.where("bin_id IS NOT NULL").groupBy("window_id", "bin_id").agg(F.sum("n_tokens").alias("t")).groupBy("window_id").agg(F.count("*").alias("bins"), F.sum("t").alias("tokens"))
    return used.join(windows.select("window_id", "capacity_tokens").distinct(), "window_id").select(
        "window_id", "capacity_tokens", "bins", "tokens", (1 - F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("unused_share")
    )


def instruction_sizes(docs: DataFrame, answers: DataFrame, key: str = "doc_id", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key, tokens, loss`` of documents (``key, text``) followed by their answers (``key,
    answer``): the answer's tokens bear loss. A document without an answer bears none; one
    with several counts once for each."""
    prompt = token_sizes(docs, key, "text", path).select(key, F.col("tokens").alias("_p"))
    numbered = answers.select(key, "answer").withColumn("_id", F.struct(key, F.monotonically_increasing_id()))
    reply = token_sizes(numbered, "_id", "answer", path).select(F.col(f"_id.{key}").alias(key), F.col("tokens").alias("_a"))
    both = prompt.join(reply, key, "left")
    return both.select(key, (F.col("_p") + F.coalesce("_a", F.lit(0))).alias("tokens"), F.coalesce("_a", F.lit(0)).cast("bigint").alias("loss"))
