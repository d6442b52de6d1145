"""Exact order statistics, prefix sums and numbering that never need one big group.

A plain window or an exact ``percentile`` puts all rows of a key into a single
task. The helpers here first count per order-preserving bucket, so that a key
holding a third of all rows is still spread over many tasks, and then touch only
the rows of the bucket that decides the answer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

# 4096 steps per unit of ln(1+|x|): values within 0.025 % share a bucket. A key whose
# values span six orders of magnitude has at most 57,000 buckets to add up.
_STEPS = 4096


def _order_bucket(value: Column) -> Column:
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * F.lit(_STEPS)).cast("long")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` with null = null; the keys appear once in the result."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def _as_key(keys: Sequence[str]) -> Column:
    """The keys as one struct. Structs with null fields equal each other, so a plain
    equi-join keeps the null group, and join, window and aggregate share one shuffle."""
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` per key, exact and skew-proof.

    Rows shrink to (key, value, count) before any shuffle; a per-bucket count finds
    the bucket that holds each wanted rank; only those buckets are ordered.
    Keys without a single non-null value do not appear. Null keys are kept.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .select(_as_key(list(keys)).alias("__k"), F.col(value).cast("double").alias("__v"))
        .groupBy("__k", "__v").agg(F.count(F.lit(1)).alias("__c"))
    )
    return _quantiles(counts, list(keys), probs)


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], value: str, count: str, probs: Mapping[str, float]) -> DataFrame:
    """The same from rows that already are one for each (keys, non-null value), with how often it occurs."""
    named = counts.select(_as_key(list(keys)).alias("__k"), F.col(value).cast("double").alias("__v"), F.col(count).alias("__c"))
    return _quantiles(named, list(keys), probs)


def _quantiles(counts: DataFrame, keys: list[str], probs: Mapping[str, float]) -> DataFrame:
    counts = counts.withColumn("__b", _order_bucket(F.col("__v")))
    per_key = W.partitionBy("__k")
    upto = F.sum("__n").over(per_key.orderBy("__b").rowsBetween(W.unboundedPreceding, 0))
    buckets = counts.groupBy("__k", "__b").agg(F.sum("__c").alias("__n")).select(
        "__k", "__b", (upto - F.col("__n")).alias("__from"), upto.alias("__upto"),
        F.sum("__n").over(per_key).alias("__total"))
    ranks: dict[str, tuple[Column, Column, Column]] = {}
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        ranks[name] = (F.floor(pos), F.ceil(pos), pos - F.floor(pos))

    def holds(rank: Column) -> Column:
        return (F.col("__from") <= rank) & (rank < F.col("__upto"))

    wanted = reduce(lambda a, b: a | b, [holds(r) for lo, hi, _ in ranks.values() for r in (lo, hi)])
    chosen = buckets.where(wanted).select("__k", "__b", F.col("__from").alias("__base"), "__total")
    inside = W.partitionBy("__k", "__b").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    upto = F.col("__base") + F.sum("__c").over(inside)
    placed = counts.join(chosen, ["__k", "__b"]).select(
        "__k", "__v", "__total", (upto - F.col("__c")).alias("__from"), upto.alias("__upto"))
    picks = []
    for name, (lo, hi, _) in ranks.items():
        picks.append(F.max(F.when(holds(lo), F.col("__v"))).alias(f"__lo_{name}"))
        picks.append(F.max(F.when(holds(hi), F.col("__v"))).alias(f"__hi_{name}"))
    result = placed.groupBy("__k").agg(F.max("__total").alias("__total"), *picks)
    return result.select(*[F.col("__k")[k].alias(k) for k in keys], *[
        (F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * frac).alias(name)
        for name, (_, _, frac) in ranks.items()
    ])


HEAVY_KEYS = 1000


def lookup(rows: DataFrame, groups: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Give every row the columns of its group (one row per key; ``weight`` = rows of the key).

    The group frame is written once when called, and the rows are read once. The heaviest groups come by broadcast, HEAVY_KEYS rows
    at most, whatever the data; among the others no key can hold more than a thousandth of all rows, so the shuffle of the
    second join is balanced. Rows that need no second join (their group was heavy, or their key is null) are dealt over all of its
    partitions by a salt, under which nothing is found. ``how`` is inner or left.
    """
    extra = [c for c in groups.columns if c != key]
    groups = cut_lineage(groups.where(F.col(key).isNotNull()).select(F.col(key).alias("__g"), F.struct(*extra).alias("__x")))
    heavy = groups.orderBy(F.desc(f"__x.{weight}"), F.col("__g")).limit(HEAVY_KEYS)
    tagged = rows.join(F.broadcast(heavy.withColumnRenamed("__x", "__h")), rows[key] == F.col("__g"), "left").drop("__g")
    settled = F.col("__h").isNotNull() | F.col(key).isNull()
    salt = F.when(settled, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 16)) + 1).otherwise(0)
    tagged = tagged.withColumn("__s", F.struct(F.when(~settled, F.col(key)).alias("k"), salt.cast("long").alias("s")))
    rest = groups.select(F.struct(F.col("__g").alias("k"), F.lit(0).cast("long").alias("s")).alias("__s"), "__x")
    found = tagged.join(rest, "__s", "left").withColumn("__x", F.coalesce("__h", "__x"))
    if how == "inner":
        found = found.where("__x is not null")
    return found.select(*rows.columns, *[F.col(f"__x.{c}").alias(c) for c in extra])


def lookup_parent(rows: DataFrame, parents: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``lookup`` in a parent table (one row per key), whose weights are worked out from ``rows``.

    Keys are counted with map-side combining, so the count of a hot or null key is one row from each task, and only parents that
    some row refers to are written. ``how`` is inner or left; a null key has no parent.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__weight"))
    return lookup(rows, parents.join(counts, key), key, "__weight", how).drop("__weight")


def bucket_offsets(sums: DataFrame, key: str, levels: Sequence[str]) -> DataFrame:
    """(key, levels, __off): the weight of all buckets before each; ``sums`` has ``__w`` per bucket."""
    levels = list(levels)
    before = W.partitionBy(key, *levels[:-1]).orderBy(levels[-1]).rowsBetween(W.unboundedPreceding, -1)
    own = F.coalesce(F.sum("__w").over(before), F.lit(0))
    within = sums.select(key, *levels, own.alias("__off"))
    if len(levels) == 1:
        return within
    above = sums.groupBy(key, *levels[:-1]).agg(F.sum("__w").alias("__w"))
    upper = bucket_offsets(above, key, levels[:-1]).withColumnRenamed("__off", "__up")
    return within.join(upper, [key, *levels[:-1]]).select(key, *levels, (F.col("__off") + F.col("__up")).alias("__off"))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    levels: Mapping[str, Column],
    order: Sequence[Column | str],
    weight: Column,
    out: str,
) -> DataFrame:
    """Weight of all rows before this one, per key, in a total order.

    ``levels`` are bucket expressions, coarse to fine, each following the order
    (day, hour, ... or id ranges). No window sees more than one finest bucket of
    rows, or one level's children, so no key is gathered in one task.
    """
    names = list(levels)
    rows = df.select(
        "*", _as_key(list(keys)).alias("__k"), *[F.struct(e.alias("x")).alias(n) for n, e in levels.items()],
        weight.alias("__w"))
    sums = rows.groupBy("__k", *names).agg(F.sum("__w").alias("__w"))
    offsets = bucket_offsets(sums, "__k", names)
    here = W.partitionBy("__k", *names).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    total = F.col("__off") + F.coalesce(F.sum("__w").over(here), F.lit(0))
    return rows.join(offsets, ["__k", *names]).select(*df.columns, total.alias(out))


def id_levels(column: str, fan_out: int = 1 << 20) -> dict[str, Column]:
    """Bucket level for a dense integer id: ``fan_out`` ids per bucket.

    A trillion ids make a million buckets, so both levels stay small for one task.
    """
    return {f"__{column}_range": F.floor(F.col(column) / fan_out).cast("long")}


def first_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group.

    The literal bound lets Spark cut every map task to ``n`` rows per group before
    the shuffle, so a hot group sends at most tasks x n rows to its window.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= F.lit(int(n)))
