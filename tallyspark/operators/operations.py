"""Delivery operations: interval metrics, month comparison, hotspots, watch-outs.

The source is read once for each report and reduced to a written cube: (group, day, metric, value, count), in which an order's yes/no
facts are one small number. Volumes, active days, completeness, signals, medians and rankings are all sums over the cube. Partial
results are additive, so a hot group sends its calendar and its distinct values to a shuffle, not its orders.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import evidence
from ..functions.evidence import AnalysisPolicy
from ..functions.stats import ratio
from ..functions.text import keyword_signal
from ..session import cut_lineage
from . import checks
from .checks import ContractError
from .distributed import join_null_safe, quantiles_of_counts

# --- fixed values: columns, metrics, terms and names of the operations contract ---
SOURCE_COLUMNS = (
    "OrderID", "CustomerID", "CustomerComment", "CustomerRatingAverage", "BranchID",
    "DeliveryZoneName", "RiderID", "Amount", "CreatedDate", "ShiftDate",
    "DeliveryTime", "AddedToTripTime", "PickingUpTime",
)
TIME_COLUMNS = ("CreatedDate", "DeliveryTime", "AddedToTripTime", "PickingUpTime")
METRICS = {
    "delivery_duration_minutes": ("DeliveryTime", "CreatedDate"),
    "dispatch_lag_minutes": ("AddedToTripTime", "CreatedDate"),
    "pickup_lag_minutes": ("PickingUpTime", "AddedToTripTime"),
}
LATE_TERMS = (
    "late", "delay", "delayed", "hours", "hour",
    "متأخر", "تأخير", "تاخير", "ساع", "وصل بعد",
)
PREPARED_COLUMNS = (
    "CustomerRatingAverage", "BranchID", "DeliveryZoneName", "RiderID", "CreatedDate",
    *METRICS, "late_comment_signal", "has_customer_comment", "delivery_hour",
)
IDENTIFIERS = ("OrderID", "CustomerID", "CustomerComment")
DIMENSIONS = {"branch": "BranchID", "zone": "DeliveryZoneName", "hour": "delivery_hour", "rider": "RiderID"}
PERIODS = ("latest_complete_month", "previous_complete_month", "all_time")
LOW_RATING = 2
# -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class DateWindow:
    """Half-open [start, end) with an inclusive label."""

    name: str
    start: datetime
    end: datetime

    @property
    def label(self) -> str:
        return f"{self.start.date().isoformat()} to {(self.end - timedelta(days=1)).date().isoformat()}"


def interval_minutes(later: Column, earlier: Column) -> Column:
    """Minutes between two times; a negative interval is no observation."""
    minutes = (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(60_000_000.0)
    return F.when(minutes >= 0, minutes)


def prepare(raw: DataFrame, check: bool = True) -> DataFrame:
    """The analysis frame: metrics and signals in, identifiers and comments out.

    ``check`` runs the two row checks (created time readable, order id unique) as
    jobs of their own; switch it off when the source has been checked already.
    """
    checks.require_columns(raw, SOURCE_COLUMNS)
    if check:
        checks.require_none(
            checks.invalid_timestamps(raw, "CreatedDate").select("OrderID"),
            "CreatedDate contains missing or invalid values",
        )
        checks.require_none(checks.duplicate_keys(raw, ["OrderID"]), "OrderID must be unique")
    timed = raw.select(
        *[c for c in SOURCE_COLUMNS if c not in TIME_COLUMNS],
        *[checks.as_timestamp(raw, c).alias(c) for c in TIME_COLUMNS],
    )
    return timed.select(
        F.col("CustomerRatingAverage").cast("double").alias("CustomerRatingAverage"),
        "BranchID", "DeliveryZoneName", "RiderID", "CreatedDate",
        *[interval_minutes(F.col(a), F.col(b)).alias(name) for name, (a, b) in METRICS.items()],
        keyword_signal(F.col("CustomerComment"), LATE_TERMS).alias("late_comment_signal"),
        F.col("CustomerComment").isNotNull().alias("has_customer_comment"),
        F.hour("CreatedDate").alias("delivery_hour"),
    )


def load(spark: SparkSession, path: str, source_format: str = "csv", check: bool = True) -> DataFrame:
    """Read a raw export (csv, gzip csv or parquet), or an already prepared parquet table."""
    if source_format == "csv":
        raw = spark.read.option("header", True).csv(path)
    else:
        raw = spark.read.format(source_format).load(path)
    if set(PREPARED_COLUMNS) <= set(raw.columns):
        if source_format != "csv":
            return raw.select(*PREPARED_COLUMNS)
        types = {**dict.fromkeys(("CustomerRatingAverage", *METRICS), "double"), "CreatedDate": "timestamp", "delivery_hour": "int",
                 **dict.fromkeys(("late_comment_signal", "has_customer_comment"), "boolean")}
        return raw.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in PREPARED_COLUMNS])
    if source_format == "csv":
        raw = checks.require_columns(raw, SOURCE_COLUMNS).withColumn(
            "CustomerRatingAverage", F.expr("try_cast(CustomerRatingAverage as double)")
        )
    return prepare(raw, check)


def write_prepared(prepared: DataFrame, path: str) -> None:
    """Compact table for repeated analyses, clustered by time so windows prune row groups."""
    (prepared.select(*PREPARED_COLUMNS)
     .repartitionByRange("CreatedDate").sortWithinPartitions("CreatedDate")
     .write.mode("errorifexists").parquet(path))


# --- time windows -------------------------------------------------------------------

def _month_start(day: date, back: int) -> datetime:
    months = day.year * 12 + day.month - 1 - back
    return datetime(months // 12, months % 12 + 1, 1)


def period_window(source: DataFrame | Cube, period: str, anchor: datetime | None = None) -> DateWindow:
    """A named period as two literals, so that the scan can prune on them.

    Months are counted back from ``anchor`` or, without one, from the newest row;
    the clock of the machine is never read. A cube knows its days, so it saves the source another scan.
    """
    if period not in PERIODS:
        raise ContractError(f"Unsupported period: {period}")
    df, time = (source.df, "day") if isinstance(source, Cube) else (source, "CreatedDate")
    if period == "all_time":
        low, high = df.agg(F.min(time), F.max(time)).first()
        if low is None:
            raise ContractError("No orders exist.")
        floor = lambda t: datetime(t.year, t.month, t.day)
        return DateWindow(period, floor(low), floor(high) + timedelta(days=1))  # all rows, whatever the anchor
    newest = anchor or df.agg(F.max(time)).first()[0]
    if newest is None:
        raise ContractError("No orders exist.")
    back = 1 if period == "latest_complete_month" else 2
    return DateWindow(period, _month_start(newest, back), _month_start(newest, back - 1))


def in_window(window: DateWindow) -> Column:
    return (F.col("CreatedDate") >= F.lit(window.start)) & (F.col("CreatedDate") < F.lit(window.end))


# --- building blocks ------------------------------------------------------------------

ORDERS = "#"  # the cube's rows that count orders; their value is the sum of the facts below


@dataclass(frozen=True)
class Cube:
    """(keys, metric, day, value, n): how many orders of a group had a value; written, so it is read, never worked out again.

    Rows of the metric ORDERS count orders by day and by their facts instead, each fact a bit of the value. Other rows have no day:
    a report that compares periods has the period among its keys.
    """

    df: DataFrame
    keys: tuple[str, ...]


def _facts(policy: AnalysisPolicy) -> dict[str, Column]:
    return {
        **{f"valid_{m}": F.col(m).isNotNull() for m in METRICS},
        "long_orders": F.coalesce(F.col("delivery_duration_minutes") > policy.long_delivery_minutes, F.lit(False)),
        "low_rating_orders": F.coalesce(F.col("CustomerRatingAverage") <= LOW_RATING, F.lit(False)),
        "comments": F.coalesce(F.col("has_customer_comment"), F.lit(False)),
        "late_comment_signals": F.coalesce(F.col("late_comment_signal"), F.lit(False)),
    }


def build_cube(
    df: DataFrame, keys: Sequence[str], policy: AnalysisPolicy, values: Sequence[str] = tuple(METRICS), values_where: Column | None = None,
) -> Cube:
    """Reduce orders to a cube in one pass over ``df``.

    ``values`` are the metrics whose values are kept (for medians), and only from rows of ``values_where``; the facts of all
    orders are.
    """
    bits = sum((F.when(fact, F.lit(float(1 << k))).otherwise(F.lit(0.0)) for k, fact in enumerate(_facts(policy).values())), F.lit(0.0))
    wanted = F.lit(True) if values_where is None else values_where
    no_day = F.lit(None).cast("date")
    cells = F.array(
        F.struct(F.lit(ORDERS).alias("metric"), F.to_date("CreatedDate").alias("day"), bits.alias("value")),
        *[F.struct(F.lit(m).alias("metric"), no_day.alias("day"), F.when(wanted, F.col(m)).alias("value")) for m in values])
    rows = df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.metric", "c.day", "c.value")
    counted = rows.where("value is not null").groupBy(*keys, "metric", "day", "value").agg(F.count(F.lit(1)).alias("n"))
    return Cube(cut_lineage(counted), tuple(keys))


def _counters(orders: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, orders, the facts' counts, active_days) from a cube's order rows."""
    facts = list(_facts(AnalysisPolicy()))
    bits = F.col("value").cast("int")
    daily = orders.groupBy(*keys, "day").agg(
        F.sum("n").alias("orders"), *[F.sum(F.when(bits.bitwiseAND(F.lit(1 << k)) != 0, F.col("n"))).alias(f) for k, f in enumerate(facts)])
    return daily.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("orders", *facts)], F.count("day").alias("active_days"))


def _order_rows(cube: Cube) -> DataFrame:
    return cube.df.where(F.col("metric") == ORDERS)


def _value_rows(cube: Cube) -> DataFrame:
    return cube.df.where(F.col("metric") != ORDERS)


def _some(orders: str, window: DateWindow) -> Column:
    """A filter that stops the run when the period holds no order. As a filter it is never pruned away."""
    return F.when(F.col(orders) > 0, F.lit(True)).otherwise(F.raise_error(F.lit(f"No orders exist for {window.label}.")))


def metric_rows(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, metric, value) rows of the valid observations."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return (
        df.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.metric", "m.value")
        .where(F.col("value").isNotNull())
    )


# --- analyses ---------------------------------------------------------------------------

def data_scope(df: DataFrame) -> DataFrame:
    """One row describing what the data covers, from one scan of the source.

    Each order becomes a row per distinct count after projection, and these are reduced
    to distinct ids before the shuffle.
    """
    facts = df.agg(
        F.to_date(F.min("CreatedDate")).alias("first_day"),
        F.to_date(F.max("CreatedDate")).alias("last_day"),
        F.count(F.lit(1)).alias("orders"),
        F.count_if("has_customer_comment").alias("orders_with_comments"),
        F.count_distinct("BranchID").alias("branches"),
        F.count_distinct("DeliveryZoneName").alias("zones"),
        F.count_distinct("RiderID").alias("riders"),
    )
    return facts.select(
        F.concat_ws(" to ", "first_day", "last_day").alias("data_window"),
        "orders", "branches", "zones", "riders", "orders_with_comments",
        ratio(F.col("orders_with_comments"), F.col("orders")).alias("comment_coverage"),
    )


def operations_summary(source: DataFrame | Cube, window: DateWindow, policy: AnalysisPolicy = AnalysisPolicy()) -> DataFrame:
    """One row per metric with volume, completeness, median, p90 and the period's signals.

    ``source`` are orders, or a cube of the window's orders without keys.
    """
    cube = source if isinstance(source, Cube) else build_cube(source.where(in_window(window)), (), policy)
    totals = _counters(_order_rows(cube), ()).where(_some("orders", window))
    per_metric = totals.select(
        "orders", "active_days", "low_rating_orders", "comments", "late_comment_signals",
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(f"valid_{m}").alias("valid_observations")) for m in METRICS
        ])).alias("m"),
    ).select("*", "m.*").drop("m").withColumn(
        "completeness", ratio(F.col("valid_observations"), F.col("orders"))
    )
    quantiles = quantiles_of_counts(_value_rows(cube), ["metric"], "value", "n", {"median_minutes": 0.5, "p90_minutes": 0.9})
    return per_metric.join(quantiles, "metric", "left").select(
        F.lit(window.label).alias("period"), "metric", "orders", "valid_observations", "active_days",
        "completeness", "median_minutes", "p90_minutes",
        evidence.strength(F.col("valid_observations"), F.col("active_days"), F.col("completeness"), policy)
        .alias("evidence_strength"),
        "low_rating_orders", ratio(F.col("low_rating_orders"), F.col("orders")).alias("low_rating_rate"),
        "comments", "late_comment_signals", ratio(F.col("comments"), F.col("orders")).alias("comment_coverage"),
    )


_SIDES = ("current", "previous")


def _with_side(df: DataFrame, current: DateWindow, previous: DateWindow) -> DataFrame:
    return df.withColumn("side", F.when(in_window(current), "current").when(in_window(previous), "previous"))


def compare_branches(
    source: DataFrame | Cube, metric: str, current: DateWindow, previous: DateWindow,
    policy: AnalysisPolicy = AnalysisPolicy(), key: str = "BranchID",
) -> DataFrame:
    """Every branch seen in both periods, with medians, change, floor verdict and strength.

    Both periods share one scan and one aggregation; a null branch is a group too. ``source`` are orders, or a cube by ``key`` and side.
    """
    if metric not in METRICS:
        raise ContractError(f"Unsupported metric: {metric}")
    cube = source if isinstance(source, Cube) else build_cube(
        _with_side(source.where(in_window(current) | in_window(previous)), current, previous), [key, "side"], policy, [metric])
    compared = Cube(cube.df.where("side is not null"), cube.keys)
    counters = _counters(_order_rows(compared), [key, "side"]).select(
        key, "side", "orders", F.col(f"valid_{metric}").alias("valid"), F.col("active_days").alias("days"))
    medians = quantiles_of_counts(compared.df.where(F.col("metric") == metric), [key, "side"], "value", "n", {"median": 0.5})
    per_side = join_null_safe(counters, medians, [key, "side"], "left")
    picked = [
        F.max(F.when(F.col("side") == s, F.col(source))).alias(f"{s}_{target}")
        for s in _SIDES
        for source, target in (("orders", "orders"), ("valid", "valid_observations"),
                               ("days", "active_days"), ("median", "median_minutes"))
    ]
    both = per_side.groupBy(key).agg(*picked).where("current_orders is not null and previous_orders is not null")
    for s in _SIDES:
        both = both.withColumn(f"{s}_completeness", F.col(f"{s}_valid_observations") / F.col(f"{s}_orders"))
    verdicts = {
        s: (F.col(f"{s}_valid_observations"), F.col(f"{s}_active_days"), F.col(f"{s}_completeness")) for s in _SIDES
    }
    change = F.col("current_median_minutes") - F.col("previous_median_minutes")
    return both.select(
        "*",
        change.alias("change_minutes"),
        (F.try_divide(change, F.col("previous_median_minutes")) * 100).alias("change_percent"),
        (evidence.meets_floor(*verdicts["current"], policy) & evidence.meets_floor(*verdicts["previous"], policy))
        .alias("eligible"),
        evidence.weakest(evidence.strength(*verdicts["current"], policy),
                         evidence.strength(*verdicts["previous"], policy)).alias("evidence_strength"),
    )


def comparison_counts(comparison: DataFrame) -> DataFrame:
    return comparison.agg(
        F.count_if("eligible").alias("eligible_branches"),
        F.count_if(~F.col("eligible")).alias("suppressed_branches"),
    )


CHANGE_COLUMNS = (
    "change_minutes", "change_percent", "current_median_minutes", "previous_median_minutes",
    "current_valid_observations", "previous_valid_observations", "current_active_days",
    "previous_active_days", "current_completeness", "previous_completeness", "evidence_strength",
)


def largest_increases(comparison: DataFrame, k: int, key: str = "BranchID") -> DataFrame:
    """The k eligible branches whose median rose most; ties fall to the branch name."""
    return (
        comparison.where("eligible").orderBy(F.desc("change_minutes"), F.asc_nulls_first(key)).limit(k)
        .select(key, *CHANGE_COLUMNS)
    )


def branch_delivery_change(
    df: DataFrame, metric: str, current: DateWindow, previous: DateWindow,
    policy: AnalysisPolicy = AnalysisPolicy(),
) -> DataFrame:
    """Top increases, each row carrying how many branches were eligible and suppressed."""
    comparison = cut_lineage(compare_branches(df, metric, current, previous, policy))
    return largest_increases(comparison, policy.max_results).crossJoin(comparison_counts(comparison))


def hotspots(
    source: DataFrame | Cube, dimension: str, window: DateWindow,
    policy: AnalysisPolicy = AnalysisPolicy(), limit: int | None = None,
) -> DataFrame:
    """Groups with the highest share of long deliveries, above their evidence floor.

    The ranking needs counters only, so medians are worked out afterwards and for
    the at most 20 shown groups alone. ``source`` are orders, or a cube by the dimension's column.
    """
    if dimension not in DIMENSIONS:
        raise ContractError(f"Unsupported dimension: {dimension}")
    column, duration = DIMENSIONS[dimension], "delivery_duration_minutes"
    floor = policy.min_comparison_orders if dimension in ("branch", "hour") else evidence.SMALL_GROUP_FLOOR
    shown = min(limit or policy.max_results, evidence.RESULT_LIMIT_MAX)
    cube = source if isinstance(source, Cube) else build_cube(
        source.where(in_window(window) & F.col(column).isNotNull()), [column], policy, [duration])
    rows = cube.df.where(F.col(column).isNotNull()).withColumnRenamed(column, "group")
    # One row per group, written once: the ranking and the counts start from it.
    groups = cut_lineage(_counters(_order_rows(Cube(rows, ("group",))), ["group"]).withColumn("valid_delivery_observations", F.col(f"valid_{duration}"))
                         .withColumn("completeness", F.col("valid_delivery_observations") / F.col("orders")))
    eligible = groups.withColumnRenamed("long_orders", "long_delivery_orders").where(
        (F.col("valid_delivery_observations") >= floor) & (F.col("completeness") >= policy.min_completeness)
    )
    ranked = eligible.withColumn(
        "long_delivery_rate", F.col("long_delivery_orders") / F.col("valid_delivery_observations")
    ).orderBy(F.desc("long_delivery_rate"), F.desc("long_delivery_orders"), F.asc("group")).limit(shown)
    # At most RESULT_LIMIT_MAX rows come to the driver; as literals their groups reach the scan.
    top, fit = ranked.collect(), eligible.count()
    medians = quantiles_of_counts(
        rows.where((F.col("metric") == duration) & F.col("group").isin([r["group"] for r in top])), ["group"], "value", "n", {"median_delivery_minutes": 0.5})
    ranked = rows.sparkSession.createDataFrame(top, ranked.schema)
    return ranked.join(medians, "group", "left").select(
        F.lit(window.label).alias("period"), F.lit(dimension).alias("dimension"),
        F.col("group").cast("string").alias("group"), "orders", "valid_delivery_observations", "active_days",
        "long_delivery_orders", "median_delivery_minutes", "late_comment_signals", "comments", "completeness",
        "long_delivery_rate",
        evidence.strength(F.col("valid_delivery_observations"), F.col("active_days"), F.col("completeness"), policy)
        .alias("evidence_strength"),
        F.lit(fit).cast("long").alias("eligible_groups"),
    )


def metric_quality(df: DataFrame) -> DataFrame:
    """Missing or negative observations per metric, over all rows."""
    counts = df.agg(*[F.count_if(F.col(m).isNull()).alias(m) for m in METRICS])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("invalid_or_missing")) for m in METRICS
    ])).alias("m")).select("m.*")


def watchouts(
    df: DataFrame, current: DateWindow, previous: DateWindow, policy: AnalysisPolicy = AnalysisPolicy(),
    top: int = 5,
) -> DataFrame:
    """The monthly report as (section, item, measure, value) rows.

    One pass reduces the whole table to a cube by branch; both months, the signals, the all-time data-quality counts and the
    branch comparison are read from it. Values are kept for the two months only.
    """
    now, before = F.col("side") == "current", F.col("side") == "previous"
    duration = "delivery_duration_minutes"
    cube = build_cube(_with_side(df, current, previous), ["BranchID", "side"], policy, [duration], F.col("side").isNotNull())
    daily = _counters(_order_rows(cube), ["side", "day"])
    total = daily.agg(
        F.sum(F.when(now, F.col("orders"))).alias("orders"),
        F.sum(F.when(before, F.col("orders"))).alias("previous_orders"),
        F.sum(F.when(now, F.col(f"valid_{duration}"))).alias("valid_observations"),
        F.count(F.when(now, F.col("day"))).alias("active_days"),
        F.sum(F.when(now, F.col("low_rating_orders"))).alias("low"),
        F.sum(F.when(before, F.col("low_rating_orders"))).alias("previous_low"),
        F.sum(F.when(now, F.col("comments"))).alias("comments"),
        F.sum(F.when(now, F.col("late_comment_signals"))).alias("late_comment_signals"),
        *[F.sum(F.col("orders") - F.col(f"valid_{m}")).alias(f"invalid_{m}") for m in METRICS],
    )
    # A month without orders cannot be reported on.
    total = total.where(_some("orders", current)).where(_some("previous_orders", previous))
    observed = cube.df.where(now & (F.col("metric") == duration)).groupBy("value").agg(F.sum("n").alias("n"))
    spread = quantiles_of_counts(observed, (), "value", "n", {"median_minutes": 0.5, "p90_minutes": 0.9})
    rate, previous_rate = F.col("low") / F.col("orders"), F.col("previous_low") / F.col("previous_orders")
    facts = {
        ("overall_delivery", duration, "orders"): F.col("orders"),
        ("overall_delivery", duration, "valid_observations"): F.col("valid_observations"),
        ("overall_delivery", duration, "active_days"): F.col("active_days"),
        ("overall_delivery", duration, "completeness"): F.col("valid_observations") / F.col("orders"),
        ("customer_reported_signals", "all", "comments"): F.col("comments"),
        ("customer_reported_signals", "all", "late_comment_signals"): F.col("late_comment_signals"),
        ("customer_reported_signals", "all", "comment_coverage"): F.col("comments") / F.col("orders"),
        ("rating_signal", "all", "current_low_rating_rate"): rate,
        ("rating_signal", "all", "previous_low_rating_rate"): previous_rate,
        ("rating_signal", "all", "change_percentage_points"): (rate - previous_rate) * 100,
        **{("data_quality", m, "invalid_or_missing"): F.col(f"invalid_{m}") for m in METRICS},
    }

    def as_rows(frame: DataFrame, cells: dict[tuple[str, str, str], Column], item: Column | None = None) -> DataFrame:
        return frame.select(F.explode(F.array(*[
            F.struct(F.lit(s).alias("section"), (F.lit(i) if item is None else item).alias("item"),
                     F.lit(m).alias("measure"), v.cast("double").alias("value"))
            for (s, i, m), v in cells.items()
        ])).alias("r")).select("r.*")

    comparison = cut_lineage(compare_branches(cube, duration, current, previous, policy))
    rises = as_rows(
        largest_increases(comparison, top),
        {("largest_increases", "branch", m): F.col(m) for m in ("change_minutes", "change_percent")},
        item=F.coalesce("BranchID", F.lit("(none)")),
    )
    counted = as_rows(comparison_counts(comparison), {
        ("comparison", "all", m): F.col(m) for m in ("eligible_branches", "suppressed_branches")
    })
    quantiles = as_rows(spread, {
        ("overall_delivery", duration, m): F.col(m) for m in ("median_minutes", "p90_minutes")
    })
    return as_rows(total, facts).unionByName(quantiles).unionByName(counted).unionByName(rises)


ANALYSES = (
    "data_scope", "branch_delivery_change", "late_order_hotspots", "operational_watchouts", "operations_summary",
)


def analyze(
    df: DataFrame, analysis: str, metric: str = "delivery_duration_minutes",
    period: str = "latest_complete_month", dimension: str = "branch", limit: int = 8,
    policy: AnalysisPolicy = AnalysisPolicy(), anchor: datetime | None = None,
) -> DataFrame:
    """One allow-listed analysis; anything outside the lists is refused."""
    if analysis not in ANALYSES:
        raise ContractError(f"Unsupported analysis: {analysis}")
    if metric not in METRICS:
        raise ContractError(f"Unsupported metric: {metric}")
    if period not in PERIODS:
        raise ContractError(f"Unsupported period: {period}")
    if dimension not in DIMENSIONS:
        raise ContractError(f"Unsupported dimension: {dimension}")
    if not 1 <= limit <= evidence.RESULT_LIMIT_MAX:
        raise ContractError(f"limit must be between 1 and {evidence.RESULT_LIMIT_MAX}")
    if analysis == "data_scope":
        return data_scope(df)
    if analysis in ("operations_summary", "late_order_hotspots"):
        summary = analysis == "operations_summary"
        # All orders are in the cube then, and its days tell the period.
        source = df if period != "all_time" else build_cube(df, (), policy) if summary else build_cube(
            df, [DIMENSIONS[dimension]], policy, ["delivery_duration_minutes"])
        window = period_window(source, period, anchor)
        return operations_summary(source, window, policy) if summary else hotspots(source, dimension, window, policy, limit)
    current = period_window(df, "latest_complete_month", anchor)
    previous = period_window(df, "previous_complete_month", anchor)
    if analysis == "branch_delivery_change":
        return branch_delivery_change(df, metric, current, previous, policy)
    return watchouts(df, current, previous, policy)
