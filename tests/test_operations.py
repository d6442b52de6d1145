"""Interval metrics, month comparison, hotspots and watch-outs on a hand-made export."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyspark.functions.evidence import AnalysisPolicy, weakest
from tallyspark.operators import checks, operations as ops
from tallyspark.operators.checks import ContractError

POLICY = AnalysisPolicy(3, 2, 0.75, 50.0, 8)
SCHEMA = (
    "OrderID string, CustomerID string, CustomerComment string, CustomerRatingAverage double, BranchID string, "
    "DeliveryZoneName string, RiderID string, Amount double, CreatedDate timestamp, ShiftDate timestamp, "
    "DeliveryTime timestamp, AddedToTripTime timestamp, PickingUpTime timestamp"
)
GROUPS = ((5, "BR-A", 35, 8), (6, "BR-A", 70, 8), (5, "BR-B", 65, 8), (6, "BR-B", 40, 8), (5, "BR-C", 45, 2), (6, "BR-C", 90, 2))


def rows():
    out = []

    def add(created, branch, minutes, bad_pickup=False, unhappy=False):
        added = created + timedelta(minutes=10)
        pickup = added + timedelta(minutes=-2 if bad_pickup else 5)
        mine = branch == "BR-A"
        out.append((
            f"o{len(out)}", f"c{len(out)}", "Order was late" if unhappy else None, 1.0 if unhappy else 5.0, branch,
            "Area-1" if mine else "Area-2", "rider-1" if mine else "rider-2", 10.0, created, created,
            created + timedelta(minutes=minutes), added, pickup))

    for month, branch, minutes, n in GROUPS:
        for i in range(n):
            june_a = month == 6 and branch == "BR-A"
            add(datetime(2026, month, i % 4 + 1, 10), branch, minutes, june_a and i == 0, june_a and i < 2)
    add(datetime(2026, 7, 3, 10), "BR-A", 50)
    return out


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def frame(raw):
    return ops.prepare(raw).cache()


def windows(frame):
    return ops.period_window(frame, "latest_complete_month"), ops.period_window(frame, "previous_complete_month")


def test_summary_of_the_latest_complete_month(frame):
    now, _ = windows(frame)
    got = {r.metric: r for r in ops.operations_summary(frame, now, POLICY).collect()}
    assert got["dispatch_lag_minutes"].period == "2026-06-01 to 2026-06-30"
    assert got["dispatch_lag_minutes"].median_minutes == 10.0
    pickup = got["pickup_lag_minutes"]
    assert (pickup.valid_observations, pickup.orders) == (17, 18)
    assert pickup.low_rating_orders == 2 and pickup.comments == 2 and pickup.late_comment_signals == 2


def test_comparison_floor_and_ranking(frame):
    now, before = windows(frame)
    top = ops.branch_delivery_change(frame, "delivery_duration_minutes", now, before, POLICY).collect()
    assert [r.BranchID for r in top] == ["BR-A", "BR-B"]
    assert top[0].change_minutes == 35 and top[0].change_percent == 100.0
    assert (top[0].eligible_branches, top[0].suppressed_branches) == (2, 1)


def test_null_branch_is_compared_like_any_other(frame):
    gone = frame.withColumn("BranchID", F.when(F.col("BranchID") != "BR-B", F.col("BranchID")))
    now, before = windows(frame)
    got = ops.compare_branches(gone, "delivery_duration_minutes", now, before, POLICY).where("BranchID is null").collect()
    assert len(got) == 1 and got[0].eligible and got[0].change_minutes == -25


def test_hotspots_keep_measured_and_reported_signals_apart(frame):
    now, _ = windows(frame)
    got = {r.group: r for r in ops.hotspots(frame, "branch", now, POLICY).collect()}
    assert got["BR-A"].long_delivery_orders == 8 and got["BR-A"].late_comment_signals == 2
    assert got["BR-A"].median_delivery_minutes == 70 and set(got) == {"BR-A", "BR-B"}


def test_small_dimensions_have_the_higher_fixed_floor(frame):
    now, _ = windows(frame)
    assert ops.hotspots(frame, "rider", now, POLICY).count() == 0
    assert [r.group for r in ops.hotspots(frame, "hour", now, POLICY).collect()] == ["10"]


def test_watchouts_cover_every_section(frame):
    now, before = windows(frame)
    got = {(r.section, r.item, r.measure): r.value for r in ops.watchouts(frame, now, before, POLICY).collect()}
    assert got["largest_increases", "BR-A", "change_minutes"] == 35
    assert got["comparison", "all", "suppressed_branches"] == 1
    assert got["data_quality", "pickup_lag_minutes", "invalid_or_missing"] == 1
    assert got["rating_signal", "all", "change_percentage_points"] == pytest.approx(100 * 2 / 18)


def test_scope(frame):
    got = ops.data_scope(frame).first()
    assert (got.orders, got.branches, got.zones, got.riders, got.orders_with_comments) == (37, 3, 2, 2, 2)
    assert got.data_window == "2026-05-01 to 2026-07-03"


def test_results_hold_no_identifiers(frame):
    now, before = windows(frame)
    for df in (frame, ops.hotspots(frame, "branch", now, POLICY), ops.watchouts(frame, now, before, POLICY)):
        assert checks.denied_columns(df, ops.IDENTIFIERS) == []


@pytest.mark.parametrize("wrong", [
    {"analysis": "drop_table"}, {"analysis": "branch_delivery_change", "metric": "Amount"},
    {"analysis": "operations_summary", "period": "yesterday"}, {"analysis": "late_order_hotspots", "dimension": "CustomerID"},
    {"analysis": "late_order_hotspots", "limit": 21}, {"analysis": "late_order_hotspots", "limit": 0},
])
def test_anything_outside_the_lists_is_refused(frame, wrong):
    with pytest.raises(ContractError):
        ops.analyze(frame, **wrong)


def test_contract_of_the_source(raw):
    with pytest.raises(ContractError, match="Missing required columns: Amount, RiderID"):
        ops.prepare(raw.drop("RiderID", "Amount"))
    with pytest.raises(ContractError, match="unique"):
        ops.prepare(raw.unionAll(raw.limit(1)))
    with pytest.raises(ContractError, match="CreatedDate"):
        ops.prepare(raw.withColumn("CreatedDate", F.when(F.col("OrderID") != "o3", F.col("CreatedDate"))))


def test_csv_export_and_prepared_table_give_the_same_answers(spark, raw, frame, tmp_path):
    raw.write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "raw"))
    loaded = ops.load(spark, str(tmp_path / "raw"))
    ops.write_prepared(loaded, str(tmp_path / "prepared"))
    again = ops.load(spark, str(tmp_path / "prepared"), "parquet")
    key = lambda df: sorted(map(tuple, ops.data_scope(df).collect())) + sorted(
        map(str, ops.analyze(df, "operational_watchouts", policy=POLICY).collect()))
    assert key(loaded) == key(frame) == key(again)
    with pytest.raises(Exception, match="(?i)exist"):
        ops.write_prepared(loaded, str(tmp_path / "prepared"))


def test_unreadable_times_become_missing_observations(spark, raw):
    text = raw.withColumn("DeliveryTime", F.lit("not a time"))
    assert ops.prepare(text).where("delivery_duration_minutes is not null").count() == 0


def test_the_window_reaches_the_scan(spark, frame, tmp_path):
    ops.write_prepared(frame, str(tmp_path / "p"))
    back = ops.load(spark, str(tmp_path / "p"), "parquet")
    plan = back.where(ops.in_window(windows(back)[0])).select("BranchID")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(CreatedDate" in plan and "CustomerRatingAverage" not in plan


def test_weakest_strength(spark):
    df = spark.createDataFrame([("high", "low"), ("medium", "high"), ("high", "high")], "a string, b string")
    assert [r[0] for r in df.select(weakest(F.col("a"), F.col("b"))).collect()] == ["low", "medium", "high"]


def test_no_orders_in_the_period(frame):
    empty = frame.where("BranchID = 'nobody'")
    with pytest.raises(ContractError):
        ops.period_window(empty, "latest_complete_month")
    now, _ = windows(frame)
    with pytest.raises(PySparkException, match="No orders exist for 2026-06-01"):
        ops.operations_summary(empty, now, POLICY).count()


def test_reports_read_their_source_once(spark, tmp_path, frame):
    """What a report returns reads its cube; the source, several tables here, is behind it and read once."""
    frame.write.parquet(str(tmp_path / "orders"))
    orders = spark.read.parquet(str(tmp_path / "orders"))
    now, before = windows(frame)
    reports = (ops.operations_summary(orders, now, POLICY), ops.compare_branches(orders, "delivery_duration_minutes", now, before, POLICY),
               ops.hotspots(orders, "branch", now, POLICY), ops.watchouts(orders, now, before, POLICY),
               ops.analyze(orders, "operations_summary", period="all_time", policy=POLICY))
    for report in reports:
        files = {f.rsplit("/", 2)[-2] for f in report.inputFiles()}
        assert "orders" not in files
