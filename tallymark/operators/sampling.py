"""Samples, schedules, top rows and the choice of models by cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(*columns: str, seed: int = 42) -> Column:
    """A fixed random order that does not depend on partitions."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def stratified(df: DataFrame, label: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """``most`` rows spread over the labels: an equal share each, the remainder one by one
    to the first labels by name; fewer where a label has fewer rows."""
    labels = df.where(F.col(label).isNotNull()).select(label).distinct()
    counted = labels.agg(F.count("*").alias("_k"))
    ranks = labels.withColumn("_l", F.row_number().over(Window.orderBy(label)))
    quota = ranks.join(F.broadcast(counted)).withColumn("_q", F.floor(F.lit(most) / F.col("_k")) + (F.col("_l") <= F.lit(most) % F.col("_k")).cast("int"))
    order = Window.partitionBy(label).orderBy(shuffle_key(key, seed=seed), key)
    # The literal bound keeps no more than ``most`` rows of a label in each partition before the shuffle.
    top = df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return top.join(quota, label).where("_r <= _q").drop("_r", "_q", "_k", "_l")


def schedule(labels: list[str], n: int) -> list[str]:
    """Each label ``n`` div times, the remainder to the first ones."""
    share, rest = divmod(n, len(labels))
    return [x for i, x in enumerate(labels) for _ in range(share + (i < rest))]


def ranked(df: DataFrame, by: str, bucket: Column, order: list[Column]) -> DataFrame:
    """Add ``_rank`` (from 1) and ``_size`` within ``by``. ``bucket`` follows the order, so rows
    are sorted within a bucket and the counts of the buckets before are added."""
    rows = df.withColumn("_b", bucket)
    counts = rows.groupBy(F.col(by).alias("_by"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_by")
    before = counts.withColumn("_before", F.sum("_n").over(w.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))).withColumn("_size", F.sum("_n").over(w))
    inside = rows.withColumn("_i", F.row_number().over(Window.partitionBy(by, "_b").orderBy(*order)))
    joined = inside.join(before, inside[by].eqNullSafe(before["_by"]) & inside["_b"].eqNullSafe(before["_c"]))
    return joined.withColumn("_rank", F.coalesce("_before", F.lit(0)) + F.col("_i")).drop("_b", "_by", "_c", "_n", "_before", "_i")


def split(df: DataFrame, label: str, key: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``part``, 'train' or 'test', in the same share within each label. A label's rows
    are ranked in 4,096 buckets of the random order, not in one task."""
    random = shuffle_key(key, seed=seed)
    rows = ranked(df.withColumn("_h", random), label, F.substring("_h", 1, 3), [F.col("_h"), F.col(key)])
    return rows.withColumn("part", F.when(F.col("_rank") <= F.ceil(F.col("_size") * train), "train").otherwise("test")).drop("_h", "_rank", "_size")


def running_sum(df: DataFrame, by: str, order: str, value: Column, name: str, buckets: int = 256) -> DataFrame:
    """Add the sum of ``value`` up to each row in ``order`` within ``by``, null before the first
    value; ties of the order are summed in no fixed order, so it should be unique.

    Rows are cut into ``buckets`` ranges of the numeric order by its approximate quantiles;
    each range is summed on its own and the sums of those before it are added.
    """
    cuts = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000).alias("q")).first()["q"] or []
    edges = sorted({c for c in cuts if c is not None})
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(order))) if edges else F.lit(0)
    rows = df.withColumn("_v", value).withColumn("_b", bucket)
    sums = rows.groupBy(F.col(by).alias("_by"), F.col("_b").alias("_c")).agg(F.sum("_v").alias("_s"))
    before = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy("_by").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)))
    inside = rows.withColumn("_i", F.sum("_v").over(Window.partitionBy(by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    joined = inside.join(before, inside[by].eqNullSafe(before["_by"]) & (inside["_b"] == before["_c"]))
    total = F.when(F.col("_i").isNull() & F.col("_before").isNull(), None).otherwise(F.coalesce("_before", F.lit(0.0)) + F.coalesce("_i", F.lit(0.0)))
    return joined.withColumn(name, total).drop("_v", "_b", "_by", "_c", "_s", "_before", "_i")


def first_correct(preds: DataFrame, order: list[Column], k: int = 5) -> DataFrame:
    return preds.where("is_correct").orderBy(*order).limit(k)


def usable_models(catalog: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Chat models with both rates; ``include`` and ``exclude`` are searched for in
    ``provider/name``, and exclude wins."""
    full = F.concat_ws("/", "litellm_provider", "name")
    out = catalog.where((F.col("mode") == "chat") & F.col("input_cost_per_token").isNotNull() & F.col("output_cost_per_token").isNotNull())
    out = out if include is None else out.where(full.rlike(include))
    return out if exclude is None else out.where(~full.rlike(exclude))


def cost_spread(priced: DataFrame, current: str, n: int) -> DataFrame:
    """Up to ``n`` models (``name, cost``) evenly spread in cost from the cheapest to the
    current one: for each of ``n`` linear targets the nearest, ties by cost then name;
    the ends are the cheapest and the current model; each model once.

    An unknown model raises.
    """
    here = priced.where(F.col("name") == current).select("cost").first()
    if here is None:
        raise ValueError(f"unknown model: {current}")
    within = priced.where(F.col("cost") <= here.cost)
    low = within.agg(F.min("cost")).first()[0]
    targets = [low + (here.cost - low) * i / max(1, n - 1) for i in range(n)]
    choice = lambda t: F.struct(F.abs(F.col("cost") - F.lit(t)).alias("d"), F.col("cost"), F.col("name"))
    picks = [F.min(choice(t)).alias(f"t{i}") for i, t in enumerate(targets)]
    picks[-1] = F.min(F.when(F.col("name") == current, choice(targets[-1]))).alias(f"t{n - 1}")
    one = within.agg(*picks)
    rows = F.array(*[F.struct(F.lit(i).alias("rank"), F.col(f"t{i}.name").alias("name"), F.col(f"t{i}.cost").alias("cost")) for i in range(n)])
    return one.select(F.explode(rows).alias("r")).select("r.*").groupBy("name", "cost").agg(F.min("rank").alias("rank"))
