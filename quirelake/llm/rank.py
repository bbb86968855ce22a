"""One ranking from several scores on unlike scales by median rank aggregation.

Every item gets its rank in each score; items are ordered by the weighted median of their ranks, then by the mean rank,
then by id. Only the order within a score counts, so no score decides by its range.

Ranks of large groups: a group is cut into ranges of its scores at sampled quantiles, ranked within each range, and the
sizes of the ranges before are added. A group of any size is so ranked exactly, in parts of about RANGE_ROWS rows.

Defined cases: equal values of a score share the lowest rank; a null or NaN score ranks behind all values of its score,
shared by all nulls; items with no score at all come last; repeated (group, item) rows count once, with the highest value
of each score; a null group is a group of its own; rows with a null item are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quirelake.session import durable

RANGE_ROWS = 50_000


def _weighted_median(ranks: list[Column], weights: list[float]) -> Column:
    """Mean of the lower and upper weighted median of rank columns."""
    pairs = F.array_sort(F.array(*[F.struct(r.cast("double").alias("r"), F.lit(float(w)).alias("w")) for r, w in zip(ranks, weights) if w > 0]))
    half = sum(w for w in weights if w > 0) / 2

    def at(strict: bool) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("r"))

        def step(acc, x):
            total = acc["sum"] + x["w"]
            reached = (total > half + 1e-12) if strict else (total >= half - 1e-12)
            return F.struct(total.alias("sum"), F.when(acc["r"].isNull() & reached, x["r"]).otherwise(acc["r"]).alias("r"))

        return F.aggregate(pairs, start, step)["r"]

    return (at(False) + at(True)) / 2


def _rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds the rank of a descending value within a group (1 is best; nulls last), exact for groups of any size.

    df is read three times; pass a durable frame.
    """
    stats = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(value, [i / 64 for i in range(1, 64)], 2000).alias("_cut"))
    # Groups within RANGE_ROWS are one range; larger ones use as many of the quantiles as they need, at most 64 ranges.
    step = F.greatest(F.lit(1), F.floor(F.lit(64) / F.ceil(F.col("_n") / RANGE_ROWS))).cast("int")
    some = F.filter("_cut", lambda c, i: (i + 1) % step == 0)
    cuts = F.when(F.col("_n") > RANGE_ROWS, F.array_distinct(some)).otherwise(F.array().cast("array<double>"))
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    gone = [f"_k{i}" for i in range(len(keys))]
    j = df.join(stats.select(*own, cuts.alias("_cut")), same, "left").drop(*gone)
    # Range 0 holds the highest values; nulls are a range behind all.
    j = j.withColumn("_range", F.when(F.col(value).isNull(), 1000).otherwise(F.size(F.filter("_cut", lambda c: c >= F.col(value))))).drop("_cut")
    sizes = j.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    before = sizes.select(*own, F.col("_range").alias("_r"), (F.sum("_size").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_size")).alias("_before"))
    within = F.when(F.col("_range") == 1000, 1).otherwise(F.rank().over(Window.partitionBy(*keys, "_range").orderBy(F.col(value).desc_nulls_last())))
    j = j.withColumn("_within", within).join(before, same & (F.col("_range") == F.col("_r")))
    return j.withColumn(out, (F.col("_within") + F.col("_before")).cast("bigint")).drop(*gone, "_r", "_range", "_before", "_within")


def _rank_all(base: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """The ranks of all scores at once: one row per item and score is ranked within (group, score), then put back in columns."""
    long = durable(base).select(group, item, F.posexplode(F.array(*scores)).alias("_s", "_v"))
    ranked = _rank(long, [group, "_s"], "_v", "_rank")
    cols = [F.max(F.when(F.col("_s") == i, F.col("_rank"))).alias(f"{s}_rank") for i, s in enumerate(scores)]
    return durable(ranked.groupBy(group, item).agg(*cols, F.bool_and(F.col("_v").isNull()).alias("_none")))


def median_rank(df: DataFrame, group: str, item: str, scores: list[str], weights: list[float] | None = None) -> DataFrame:
    """(group, item, <score>_rank..., median_rank, mean_rank, position) of every item."""
    weights = weights or [1.0] * len(scores)
    if len(weights) != len(scores) or not any(w > 0 for w in weights):
        raise ValueError("one weight per score, and one above 0")
    clean = [F.max(F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double"))).alias(s) for s in scores]
    base = df.where(F.col(item).isNotNull()).groupBy(group, item).agg(*clean)
    # All groups small: plain windows share one shuffle by the group. The check is one count per group.
    largest = base.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0
    ranked = base
    if largest <= RANGE_ROWS:
        for s in scores:
            ranked = ranked.withColumn(f"{s}_rank", F.rank().over(Window.partitionBy(group).orderBy(F.col(s).desc_nulls_last())).cast("bigint"))
    else:
        ranked = _rank_all(base, group, item, scores)
    ranks = [F.col(f"{s}_rank") for s in scores]
    mean = reduce(lambda a, b: a + b, [r.cast("double") * w for r, w in zip(ranks, weights)]) / sum(weights)
    ranked = ranked.withColumn("median_rank", _weighted_median(ranks, weights)).withColumn("mean_rank", F.round(mean, 9))
    if largest <= RANGE_ROWS:
        ranked = ranked.withColumn("_none", reduce(lambda a, b: a & b, [F.col(s).isNull() for s in scores]))
        ranked = ranked.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy("_none", "median_rank", "mean_rank", item)).cast("bigint"))
    else:  # one number that orders like (none, median, mean): ranges of it, then ties by item within the equal numbers
        order = -(F.col("_none").cast("double") * 1e15 + F.col("median_rank") * 1e3 + F.col("mean_rank") / 1e9)
        ranked = _rank(durable(ranked.withColumn("_order", order)), [group], "_order", "_tied")
        ranked = ranked.withColumn("position", (F.col("_tied") + F.row_number().over(Window.partitionBy(group, "_tied").orderBy("_none", "median_rank", "mean_rank", item)) - 1).cast("bigint")).drop("_order", "_tied")
    return ranked.select(group, item, *[f"{s}_rank" for s in scores], "median_rank", "mean_rank", "position")
