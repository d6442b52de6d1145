"""Contract checks: each returns the offending rows, and a thin ``require`` raises."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .distributed import lookup, lookup_parent


class ContractError(ValueError):
    """The data cannot support a safe analysis."""


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str], what: str = "Missing required columns") -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ContractError(f"{what}: {', '.join(missing)}")
    return df


def require_none(violations: DataFrame, message: str, show: int = 10) -> None:
    """Raise with the first few offenders when a violation query has rows."""
    found = violations.limit(show).collect()
    if found:
        raise ContractError(f"{message}; first: {[tuple(r) for r in found]}")


def as_timestamp(df: DataFrame, column: str) -> Column:
    """Timestamp form of a column; unreadable text becomes null instead of failing."""
    if df.schema[column].dataType.typeName() == "string":
        return F.try_to_timestamp(F.col(column))
    return F.col(column).cast("timestamp")


def invalid_timestamps(df: DataFrame, column: str) -> DataFrame:
    return df.where(as_timestamp(df, column).isNull())


# Date (calendar or week, with or without hyphens), perhaps any one character and a time, perhaps an offset; times with or without colons.
_CLOCK = r"(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,]\d+)?)?|(\d{2})(?:(\d{2})(?:[.,]\d+)?)?)?"
ISO_FORM = (r"^(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2})|-W(\d{2})(?:-(\d))?|W(\d{2})(\d)?)"
            rf"(?:[\s\S]{_CLOCK}(?:Z|[+-]{_CLOCK})?)?$")


def invalid_iso8601(df: DataFrame, column: str, nullable: bool = False) -> DataFrame:
    """Rows whose ISO-8601 text is not a time; null is allowed only where said.

    The form is matched first, since Spark's own parser takes other texts too and refuses some of these: basic times, week
    dates, separators other than T, offsets with seconds, long fractions. Then each part must lie in its range and the day in its month
    or week year.
    """
    text = F.col(column)
    # One match gives all parts, and an outer lambda binds them, so the text is matched once and the checks are small.
    parts = F.when(text.rlike(ISO_FORM), F.split(F.regexp_replace(text, ISO_FORM, ",".join(f"${k}" for k in range(1, 20))), ","))

    def right(part: Column) -> Column:
        number = [None, *(F.try_to_number(F.nullif(F.get(part, k), F.lit("")), F.lit("9999")).cast("int") for k in range(19))]
        year, month, day = number[1], F.coalesce(number[2], number[4]), F.coalesce(number[3], number[5])
        week, week_day = F.coalesce(number[6], number[8]), F.coalesce(number[7], number[9], F.lit(1))
        last_day = F.day(F.last_day(F.make_date(year, F.when(month.between(1, 12), month).otherwise(1), F.lit(1))))
        last_week = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))
        dated = F.when(week.isNotNull(), week.between(1, last_week) & week_day.between(1, 7)).otherwise(month.between(1, 12) & day.between(1, last_day))
        hours = [F.coalesce(number[k], F.lit(0)) < 24 for k in (10, 15)]
        rest = [F.coalesce(number[k], F.lit(0)) < 60 for k in (11, 12, 13, 14, 16, 17, 18, 19)]
        good = (year > 0) & dated
        for cond in (*hours, *rest):
            good = good & cond
        return good

    bad = ~F.coalesce(F.get(F.transform(F.array(parts), right), F.lit(0)), F.lit(False))
    if nullable:
        bad = bad & text.isNotNull()
    return df.where(bad)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def orphan_keys(child: DataFrame, parent: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """(on, orphans): referenced keys without a parent and how many rows refer to each. Null references are reported too.

    Keys are counted before they meet the parents, so a key that many rows share is one row of the anti join.
    """
    keys = [on] if isinstance(on, str) else list(on)
    return child.groupBy(*keys).agg(F.count(F.lit(1)).alias("orphans")).join(parent.select(*keys), keys, "left_anti")


def orphan_count(child: DataFrame, parent: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """One row: how many child rows have no parent."""
    return orphan_keys(child, parent, on).agg(F.coalesce(F.sum("orphans"), F.lit(0).cast("long")).alias("orphans"))


def orphans(child: DataFrame, parent: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Child rows without a parent. Null references are reported too.

    The keys without a parent are found first and written; their rows are then looked up with heavy keys apart (``lookup``).
    """
    keys = [on] if isinstance(on, str) else list(on)
    lost = orphan_keys(child, parent, on)
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    one = F.when(whole, F.struct(*keys)).alias("__on")
    named = lookup(child.select("*", one), lost.select(one, F.col("orphans").alias("__orphans")), "__on", "__orphans", "left")
    return named.where("__on is null or __orphans is not null").select(*child.columns)


def identity_mismatches(child: DataFrame, parent: DataFrame, key: str, pairs: Mapping[str, str]) -> DataFrame:
    """Children whose copied attributes differ from their parent's (child column -> parent column).

    Parents (one row per key) are written with the number of their children, and heavy ones are looked up apart.
    """
    ref = parent.select(F.col(key), *[F.col(p).alias(f"__p_{p}") for p in dict.fromkeys(pairs.values())])
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__p_{p}")) for c, p in pairs.items()])
    return lookup_parent(child, ref, key).where(differs).select(key, *[c for c in child.columns if c != key])


def conflicting_payloads(df: DataFrame, key: str, payload_hash: str) -> DataFrame:
    """Keys that arrive with more than one payload. Min and max suffice to see that."""
    return (
        df.groupBy(key)
        .agg(F.min(payload_hash).alias("first_hash"), F.max(payload_hash).alias("last_hash"),
             F.count(F.lit(1)).alias("rows"))
        .where(F.col("first_hash") != F.col("last_hash"))
    )


def missing_keys(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """Records lacking required fields, with the sorted list of what is missing."""
    names = F.filter(
        F.array(*[F.when(fields[k].isNull(), F.lit(k)) for k in sorted(fields)]), lambda n: n.isNotNull()
    )
    return df.withColumn("missing", names).where(F.size("missing") > 0)


def domain_violations(df: DataFrame, rules: Mapping[str, Column | str]) -> DataFrame:
    """One (rule, violations) row per rule, in a single pass. A null passes, like SQL CHECK.

    A rule is a boolean column or its SQL text.
    """
    column = lambda rule: F.expr(rule) if isinstance(rule, str) else rule
    counts = df.agg(*[F.count_if(~column(rule)).alias(name) for name, rule in rules.items()])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules
    ]))
    return counts.select(pairs.alias("r")).select("r.*")


def reconcile_counts(found: Mapping[str, DataFrame], expected: Mapping[str, int]) -> DataFrame:
    """(name, expected, found, matches) per table."""
    rows = [
        df.agg(F.count(F.lit(1)).alias("found")).select(
            F.lit(name).alias("name"), F.lit(int(expected[name])).cast("long").alias("expected"), "found"
        )
        for name, df in found.items()
    ]
    table = reduce(DataFrame.unionByName, rows)
    return table.withColumn("matches", F.col("expected") == F.col("found"))


def id_set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on one side only; side says which."""
    a = left.select(key).distinct().withColumn("__l", F.lit(1))
    b = right.select(key).distinct().withColumn("__r", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.where(F.col("__l").isNull() | F.col("__r").isNull()).select(
        key, F.when(F.col("__r").isNull(), "left_only").otherwise("right_only").alias("side")
    )


def row_count_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows in, rows out, and whether they agree."""
    a = left.agg(F.count(F.lit(1)).alias("rows_in"))
    b = right.agg(F.count(F.lit(1)).alias("rows_out"))
    return a.crossJoin(b).withColumn("matches", F.col("rows_in") == F.col("rows_out"))


def denied_columns(df: DataFrame, deny: Iterable[str]) -> list[str]:
    """Identifier columns that leaked into a result, nested fields included."""
    names: set[str] = set()

    def walk(data_type) -> None:
        for field in getattr(data_type, "fields", []):
            names.add(field.name)
            walk(field.dataType)
        for inner in ("elementType", "valueType"):
            if hasattr(data_type, inner):
                walk(getattr(data_type, inner))

    walk(df.schema)
    return sorted(names & set(deny))


def group_leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups whose rows ended up in more than one split."""
    return (
        df.groupBy(group).agg(F.min(split).alias("first_split"), F.max(split).alias("last_split"))
        .where(F.col("first_split") != F.col("last_split"))
    )


def quota_gaps(df: DataFrame, strata: Sequence[str], quotas: DataFrame) -> DataFrame:
    """Strata whose row count differs from the frozen quota (either side may lack it)."""
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("found"))
    return (
        counts.join(quotas, list(strata), "full_outer")
        .select(*strata, F.coalesce("found", F.lit(0)).cast("long").alias("found"),
                F.coalesce("quota", F.lit(0)).cast("long").alias("quota"))
        .where("found <> quota")
    )
