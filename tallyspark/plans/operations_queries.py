"""Operations analyses over line items and events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.evidence import AnalysisPolicy
from ..functions.text import keyword_signal
from ..operators import checks, operations as ops
from ..sources.tables import event_facts, order_facts, table
from .display import rounded
from .registry import query

# Floors set for the driver's data; 129,600 minutes are 90 days.
POLICY = AnalysisPolicy(10, 5, 0.40, 129_600.0, 8, "driver-tables-v1")
ALL_TIME_POLICY = AnalysisPolicy(50, 14, 0.50, 129_600.0, 8, "driver-tables-v1")
EVENT_POLICY = AnalysisPolicy(50, 14, 0.90, 90.0, 8, "driver-events-v1")
ANCHOR = datetime(1998, 8, 1)

FACTS = """
raw AS (
  SELECT n_name AS branch, s_name AS zone, 'R' || o_custkey AS rider, o_orderdate AS created,
         (CAST(round(l_discount * 100) AS INT) % 5 + 1)::DOUBLE AS rating,
         CASE WHEN l_returnflag = 'R' THEN 'Late ' || lower(o_orderpriority)
              WHEN l_returnflag = 'A' THEN lower(o_orderpriority) END AS comment,
         (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 60e6 AS d0,
         CASE WHEN l_linestatus = 'F' THEN l_quantity * 10 END AS d1,
         CASE WHEN l_linestatus = 'F' THEN round(l_tax * 1000) - 20 END AS d2
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
),
ops AS (
  SELECT branch, zone, rider, created, rating, comment IS NOT NULL AS has_comment,
         coalesce(lower(comment) LIKE '%late%' OR lower(comment) LIKE '%delay%' OR lower(comment) LIKE '%hour%', false) AS late,
         CASE WHEN d0 >= 0 THEN d0 END AS delivery_duration_minutes,
         CASE WHEN d1 >= 0 THEN d1 END AS dispatch_lag_minutes,
         CASE WHEN d2 >= 0 THEN d2 END AS pickup_lag_minutes
  FROM raw
)"""

LONG = """
long_form AS (
  SELECT 'delivery_duration_minutes' AS metric, created, delivery_duration_minutes AS v, rating, has_comment, late FROM ops
  UNION ALL SELECT 'dispatch_lag_minutes', created, dispatch_lag_minutes, rating, has_comment, late FROM ops
  UNION ALL SELECT 'pickup_lag_minutes', created, pickup_lag_minutes, rating, has_comment, late FROM ops
)"""


def strength_sql(n: str, days: str, complete: str, p: AnalysisPolicy) -> str:
    return (
        f"CASE WHEN {n} >= 100 AND {days} >= 20 AND {complete} >= 0.95 THEN 'high' "
        f"WHEN {n} >= {p.min_comparison_orders} AND {days} >= {p.min_comparison_days} "
        f"AND {complete} >= {p.min_completeness} THEN 'medium' ELSE 'low' END"
    )


def _orders(spark, folder):
    return ops.prepare(order_facts(spark, folder), check=False)


def _events(spark, folder):
    return ops.prepare(event_facts(spark, folder), check=False)


@query("data_scope", f"""
WITH {FACTS}
SELECT strftime(min(created), '%Y-%m-%d') || ' to ' || strftime(max(created), '%Y-%m-%d') AS data_window,
       count(*) AS orders, count(DISTINCT branch) AS branches, count(DISTINCT zone) AS zones,
       count(DISTINCT rider) AS riders, count_if(has_comment)::BIGINT AS orders_with_comments,
       round(count_if(has_comment) / count(*), 6) AS comment_coverage FROM ops""")
def data_scope(spark, folder):
    return rounded(ops.data_scope(_orders(spark, folder)))


@query("interval_metrics", f"""
WITH {FACTS}, {LONG}
SELECT metric, count(v) AS valid, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 4) AS mean
FROM long_form GROUP BY metric""")
def interval_metrics(spark, folder):
    rows = ops.metric_rows(_orders(spark, folder))
    return rows.groupBy("metric").agg(
        F.count("value").alias("valid"), F.round(F.min("value"), 6).alias("low"),
        F.round(F.max("value"), 6).alias("high"), F.round(F.avg("value"), 4).alias("mean"),
    )


@query("negative_interval_quality", f"""
WITH {FACTS}, {LONG}
SELECT metric, count(*) - count(v) AS invalid_or_missing FROM long_form GROUP BY metric""")
def negative_interval_quality(spark, folder):
    return ops.metric_quality(_orders(spark, folder))


def _summary_sql(where: str, label: str, p: AnalysisPolicy) -> str:
    return f"""
WITH {FACTS}, {LONG}
SELECT {label} AS period, metric, count(*) AS orders, count(v) AS valid_observations,
       count(DISTINCT created::DATE) AS active_days, round(count(v) / count(*), 6) AS completeness,
       round(quantile_cont(v, 0.5), 6) AS median_minutes, round(quantile_cont(v, 0.9), 6) AS p90_minutes,
       {strength_sql('count(v)', 'count(DISTINCT created::DATE)', '(count(v) / count(*))', p)} AS evidence_strength,
       count_if(rating <= 2)::BIGINT AS low_rating_orders, round(count_if(rating <= 2) / count(*), 6) AS low_rating_rate,
       count_if(has_comment)::BIGINT AS comments, count_if(late)::BIGINT AS late_comment_signals,
       round(count_if(has_comment) / count(*), 6) AS comment_coverage
FROM long_form {where} GROUP BY metric"""


@query("operations_summary", _summary_sql(
    "WHERE created >= TIMESTAMP '1998-07-01' AND created < TIMESTAMP '1998-08-01'", "'1998-07-01 to 1998-07-31'", POLICY))
def operations_summary(spark, folder):
    df = _orders(spark, folder)
    return rounded(ops.operations_summary(df, ops.period_window(df, "latest_complete_month", ANCHOR), POLICY))


@query("operations_summary_all_time", _summary_sql(
    "", "(SELECT strftime(min(created), '%Y-%m-%d') || ' to ' || strftime(max(created), '%Y-%m-%d') FROM ops)",
    ALL_TIME_POLICY))
def operations_summary_all_time(spark, folder):
    return rounded(ops.analyze(_orders(spark, folder), "operations_summary", period="all_time", policy=ALL_TIME_POLICY))


def _compare_sql(metric: str, p: AnalysisPolicy) -> str:
    def side(name, low, high):
        return f"""{name} AS (
  SELECT branch, count(*) AS o, count({metric}) AS n, count(DISTINCT created::DATE) AS d,
         quantile_cont({metric}, 0.5) AS m, count({metric}) / count(*) AS c
  FROM keyed WHERE created >= TIMESTAMP '{low}' AND created < TIMESTAMP '{high}' GROUP BY branch)"""

    floors = " AND ".join(
        f"{s}.n >= {p.min_comparison_orders} AND {s}.d >= {p.min_comparison_days} AND {s}.c >= {p.min_completeness}"
        for s in ("cur", "prev"))
    level = lambda s: (f"CASE {strength_sql(f'{s}.n', f'{s}.d', f'{s}.c', p)} "
                       "WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END")
    return f"""
WITH {FACTS},
keyed AS (SELECT * REPLACE (CASE WHEN branch LIKE '%1' THEN NULL ELSE branch END AS branch) FROM ops),
{side('cur', '1998-07-01', '1998-08-01')},
{side('prev', '1998-06-01', '1998-07-01')},
pair AS (
  SELECT cur.branch AS branch, cur.m - prev.m AS change, prev.m AS pm, cur.m AS cm, cur.n AS cn, prev.n AS pn,
         cur.d AS cd, prev.d AS pd, cur.c AS cc, prev.c AS pc, ({floors}) AS eligible,
         least({level('cur')}, {level('prev')}) AS weak
  FROM cur JOIN prev ON cur.branch IS NOT DISTINCT FROM prev.branch
)
SELECT coalesce(branch, '(none)') AS "BranchID", round(change, 6) AS change_minutes,
       round(CASE WHEN pm <> 0 THEN change / pm * 100 END, 6) AS change_percent,
       round(cm, 6) AS current_median_minutes, round(pm, 6) AS previous_median_minutes,
       cn AS current_valid_observations, pn AS previous_valid_observations,
       cd AS current_active_days, pd AS previous_active_days,
       round(cc, 6) AS current_completeness, round(pc, 6) AS previous_completeness,
       CASE weak WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS evidence_strength,
       (SELECT count_if(eligible)::BIGINT FROM pair) AS eligible_branches,
       (SELECT count_if(NOT eligible)::BIGINT FROM pair) AS suppressed_branches
FROM pair WHERE eligible ORDER BY change DESC, branch ASC NULLS FIRST LIMIT {p.max_results}"""


def _with_null_branch(df):
    """Nations whose name ends in 1 lose their branch, so that the null group is exercised."""
    return df.withColumn("BranchID", F.when(~F.col("BranchID").endswith("1"), F.col("BranchID")))


def _branch_change(metric):
    def run(spark, folder):
        df = _with_null_branch(_orders(spark, folder))
        report = ops.analyze(df, "branch_delivery_change", metric=metric, policy=POLICY, anchor=ANCHOR)
        return rounded(report.withColumn("BranchID", F.coalesce("BranchID", F.lit("(none)"))))
    return run


query("branch_change", _compare_sql("delivery_duration_minutes", POLICY))(_branch_change("delivery_duration_minutes"))
query("branch_change_dispatch", _compare_sql("dispatch_lag_minutes", POLICY))(_branch_change("dispatch_lag_minutes"))


def _hotspot_sql(facts: str, column: str, dimension: str, floor: int, p: AnalysisPolicy, label: str) -> str:
    return f"""
WITH {facts},
grouped AS (
  SELECT {column} AS grp, count(*) AS o, count(delivery_duration_minutes) AS n, count(DISTINCT created::DATE) AS d,
         count_if(delivery_duration_minutes > {p.long_delivery_minutes}) AS l,
         quantile_cont(delivery_duration_minutes, 0.5) AS m, count_if(late) AS s, count_if(has_comment) AS k
  FROM ops WHERE {column} IS NOT NULL GROUP BY {column}
),
fit AS (SELECT * FROM grouped WHERE n >= {floor} AND n / o >= {p.min_completeness})
SELECT {label} AS period, '{dimension}' AS dimension, grp::VARCHAR AS "group", o AS orders,
       n AS valid_delivery_observations, d AS active_days, l::BIGINT AS long_delivery_orders,
       round(m, 6) AS median_delivery_minutes, s::BIGINT AS late_comment_signals, k::BIGINT AS comments,
       round(n / o, 6) AS completeness, round(l / n, 6) AS long_delivery_rate,
       {strength_sql('n', 'd', '(n / o)', p)} AS evidence_strength,
       (SELECT count(*) FROM fit) AS eligible_groups
FROM fit ORDER BY l / n DESC, l DESC, grp LIMIT {p.max_results}"""


SPAN = "(SELECT strftime(min(created), '%Y-%m-%d') || ' to ' || strftime(max(created), '%Y-%m-%d') FROM ops)"

EVENT_FACTS = """
ops AS (
  SELECT hour(ts) AS delivery_hour, user_id::VARCHAR AS rider, ts AS created,
         CASE WHEN value >= 5 THEN floor(value * 60000000) / 60e6 END AS delivery_duration_minutes,
         event_type = 'error' AS late, event_type = 'error' AS has_comment
  FROM events
)"""


def _hotspot(facts, dimension, policy):
    def run(spark, folder):
        return rounded(ops.analyze(facts(spark, folder), "late_order_hotspots", period="all_time", dimension=dimension, policy=policy))
    return run


hotspots_branch = _hotspot(_orders, "branch", ALL_TIME_POLICY)
query("hotspots_branch", _hotspot_sql(FACTS, "branch", "branch", 50, ALL_TIME_POLICY, SPAN))(hotspots_branch)
query("hotspots_zone", _hotspot_sql(FACTS, "zone", "zone", 20, ALL_TIME_POLICY, SPAN))(
    _hotspot(_orders, "zone", ALL_TIME_POLICY))
query("hotspots_hour", _hotspot_sql(EVENT_FACTS, "delivery_hour", "hour", 50, EVENT_POLICY, SPAN))(
    _hotspot(_events, "hour", EVENT_POLICY))
query("hotspots_rider", _hotspot_sql(EVENT_FACTS, "rider", "rider", 20, EVENT_POLICY, SPAN))(
    _hotspot(_events, "rider", EVENT_POLICY))


@query("watchouts", f"""
WITH {FACTS},
cur AS (SELECT * FROM ops WHERE created >= TIMESTAMP '1998-07-01' AND created < TIMESTAMP '1998-08-01'),
prev AS (SELECT * FROM ops WHERE created >= TIMESTAMP '1998-06-01' AND created < TIMESTAMP '1998-07-01'),
c AS (SELECT count(*) o, count(delivery_duration_minutes) n, count(DISTINCT created::DATE) d,
             quantile_cont(delivery_duration_minutes, 0.5) m, quantile_cont(delivery_duration_minutes, 0.9) q,
             count_if(has_comment) k, count_if(late) s, count_if(rating <= 2) / count(*) r FROM cur),
p AS (SELECT count_if(rating <= 2) / count(*) r FROM prev),
cb AS (SELECT branch, count(*) o, count(delivery_duration_minutes) n, count(DISTINCT created::DATE) d,
              quantile_cont(delivery_duration_minutes, 0.5) m FROM cur GROUP BY branch),
pb AS (SELECT branch, count(*) o, count(delivery_duration_minutes) n, count(DISTINCT created::DATE) d,
              quantile_cont(delivery_duration_minutes, 0.5) m FROM prev GROUP BY branch),
pair AS (SELECT cb.branch, cb.m - pb.m AS change, (cb.m - pb.m) / nullif(pb.m, 0) * 100 AS pct,
                (cb.n >= 10 AND pb.n >= 10 AND cb.d >= 5 AND pb.d >= 5 AND cb.n / cb.o >= 0.4 AND pb.n / pb.o >= 0.4) AS fit
         FROM cb JOIN pb ON cb.branch = pb.branch),
top AS (SELECT * FROM pair WHERE fit ORDER BY change DESC, branch LIMIT 5),
q AS (SELECT count(*) - count(delivery_duration_minutes) a, count(*) - count(dispatch_lag_minutes) b,
             count(*) - count(pickup_lag_minutes) e FROM ops),
cells AS (
  SELECT 'overall_delivery' AS section, 'delivery_duration_minutes' AS item, 'orders' AS measure, o::DOUBLE AS value FROM c
  UNION ALL SELECT 'overall_delivery', 'delivery_duration_minutes', 'valid_observations', n FROM c
  UNION ALL SELECT 'overall_delivery', 'delivery_duration_minutes', 'active_days', d FROM c
  UNION ALL SELECT 'overall_delivery', 'delivery_duration_minutes', 'completeness', n / o FROM c
  UNION ALL SELECT 'overall_delivery', 'delivery_duration_minutes', 'median_minutes', m FROM c
  UNION ALL SELECT 'overall_delivery', 'delivery_duration_minutes', 'p90_minutes', q FROM c
  UNION ALL SELECT 'customer_reported_signals', 'all', 'comments', k FROM c
  UNION ALL SELECT 'customer_reported_signals', 'all', 'late_comment_signals', s FROM c
  UNION ALL SELECT 'customer_reported_signals', 'all', 'comment_coverage', k / o FROM c
  UNION ALL SELECT 'rating_signal', 'all', 'current_low_rating_rate', r FROM c
  UNION ALL SELECT 'rating_signal', 'all', 'previous_low_rating_rate', r FROM p
  UNION ALL SELECT 'rating_signal', 'all', 'change_percentage_points', (c.r - p.r) * 100 FROM c, p
  UNION ALL SELECT 'data_quality', 'delivery_duration_minutes', 'invalid_or_missing', a FROM q
  UNION ALL SELECT 'data_quality', 'dispatch_lag_minutes', 'invalid_or_missing', b FROM q
  UNION ALL SELECT 'data_quality', 'pickup_lag_minutes', 'invalid_or_missing', e FROM q
  UNION ALL SELECT 'comparison', 'all', 'eligible_branches', count_if(fit) FROM pair
  UNION ALL SELECT 'comparison', 'all', 'suppressed_branches', count_if(NOT fit) FROM pair
  UNION ALL SELECT 'largest_increases', branch, 'change_minutes', change FROM top
  UNION ALL SELECT 'largest_increases', branch, 'change_percent', pct FROM top
)
SELECT section, item, measure, round(value, 6) AS value FROM cells""")
def watchouts(spark, folder):
    df = _orders(spark, folder)
    return rounded(ops.analyze(df, "operational_watchouts", policy=POLICY, anchor=ANCHOR))


@query("keyword_signal", """
SELECT lang, count(*) AS documents,
       count_if(lower(text) LIKE '%late%' OR lower(text) LIKE '%delay%' OR lower(text) LIKE '%hour%')::BIGINT AS signals
FROM documents GROUP BY lang""")
def keyword(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(keyword_signal(F.col("text"), ops.LATE_TERMS)).alias("signals"),
    )


@query("period_windows", """
WITH m AS (SELECT date_trunc('month', max(o_orderdate)) AS this, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last FROM orders)
SELECT 'all_time' AS period, strftime(first, '%Y-%m-%d') || ' to ' || strftime(last, '%Y-%m-%d') AS label,
       (SELECT count(*) FROM orders) AS orders FROM m
UNION ALL
SELECT 'latest_complete_month', strftime(this - INTERVAL 1 MONTH, '%Y-%m-%d') || ' to ' || strftime(this - INTERVAL 1 DAY, '%Y-%m-%d'),
       (SELECT count(*) FROM orders WHERE o_orderdate >= this - INTERVAL 1 MONTH AND o_orderdate < this) FROM m
UNION ALL
SELECT 'previous_complete_month', strftime(this - INTERVAL 2 MONTH, '%Y-%m-%d') || ' to ' || strftime(this - INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d'),
       (SELECT count(*) FROM orders WHERE o_orderdate >= this - INTERVAL 2 MONTH AND o_orderdate < this - INTERVAL 1 MONTH) FROM m""")
def period_windows(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderdate").alias("CreatedDate"))
    rows = [
        orders.where(ops.in_window(w)).agg(F.count(F.lit(1)).alias("orders"))
        .select(F.lit(w.name).alias("period"), F.lit(w.label).alias("label"), "orders")
        for w in (ops.period_window(orders, p) for p in ops.PERIODS)
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("presence_hour", """
SELECT hour(ts) AS delivery_hour, count(*) AS orders, count_if(value >= 5)::BIGINT AS timed,
       count_if(coalesce(CASE WHEN value >= 5 THEN value END > 90, false))::BIGINT AS long_orders
FROM events GROUP BY 1""")
def presence_hour(spark, folder):
    df = _events(spark, folder)
    return df.groupBy("delivery_hour").agg(
        F.count(F.lit(1)).alias("orders"), F.count("delivery_duration_minutes").alias("timed"),
        F.count_if(F.coalesce(F.col("delivery_duration_minutes") > 90, F.lit(False))).alias("long_orders"),
    )


@query("privacy_projection", f"""
WITH {FACTS} SELECT count(*) AS orders, 0::BIGINT AS leaked_columns, count_if(has_comment)::BIGINT AS comments FROM ops""")
def privacy_projection(spark, folder):
    df = _orders(spark, folder)
    leaked = checks.denied_columns(df, ops.IDENTIFIERS)
    return df.agg(
        F.count(F.lit(1)).alias("orders"), F.lit(len(leaked)).cast("long").alias("leaked_columns"),
        F.count_if("has_customer_comment").alias("comments"),
    )


@query("required_columns", """
SELECT CASE WHEN o_orderstatus = 'F' THEN 'Amount' ELSE 'none' END AS missing, count(*) AS rows_checked
FROM orders GROUP BY 1""")
def required_columns(spark, folder):
    """Contract check against two projections of the orders table, one lacking a column."""
    whole = order_facts(spark, folder)
    lacking = checks.missing_columns(whole.drop("Amount"), ops.SOURCE_COLUMNS)
    complete = checks.missing_columns(whole, ops.SOURCE_COLUMNS)
    verdict = F.when(F.col("o_orderstatus") == "F", F.lit(",".join(lacking))).otherwise(F.lit(",".join(complete) or "none"))
    return table(spark, folder, "orders").groupBy(verdict.alias("missing")).agg(F.count(F.lit(1)).alias("rows_checked"))
