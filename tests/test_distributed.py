"""Distributed order statistics against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import checks, distributed, listing, reviews
from tallyspark.operators.distributed import exact_quantiles, first_n_per_group, id_levels, lookup, running_total


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quantiles_equal_numpy_under_skew_ties_nulls_and_null_keys(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(3000):
        key = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        value = rng.choice([None, -5.5, 0.0, rng.uniform(-1e3, 1e6), float(rng.randint(0, 9))])
        rows.append((key, value))
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"q50": 0.5, "q90": 0.9, "q0": 0.0, "q100": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    for key in {k for k, _ in rows}:
        values = [v for k, v in rows if k == key and v is not None]
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-9)


def test_quantiles_without_keys_and_without_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first().m == 1.5
    assert exact_quantiles(df.where("v is null"), [], "v", {"m": 0.5}).count() == 0


def test_running_total_equals_cumulative_sum(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["x", None]), i, rng.randint(0, 9)) for i in rng.sample(range(5000), 1200)]
    df = spark.createDataFrame(rows, "k string, id long, w long")
    levels = {**id_levels("id", 16), "piece": F.floor(F.col("id") / 4)}
    got = running_total(df, ["k"], levels, ["id"], F.col("w"), "before").toPandas()
    want = pd.DataFrame(rows, columns=["k", "id", "w"]).sort_values("id")
    want["before"] = want.groupby("k", dropna=False)["w"].cumsum() - want["w"]
    left = sorted(zip(got.id, got.before))
    assert left == sorted(zip(want.id, want.before))


def test_running_total_keeps_rows_whose_level_is_null(spark):
    df = spark.createDataFrame([(None, 1), (5, 1), (3, 1)], "id long, w long")
    got = running_total(df, [], {"l": F.floor(F.col("id") / 2)}, ["id"], F.col("w"), "b").orderBy("b").collect()
    assert [(r.id, r.b) for r in got] == [(None, 0), (3, 1), (5, 2)]


def test_first_n_and_its_map_side_limit(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    top = first_n_per_group(df, ["g"], [F.desc("id")], 4)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert {r.g: r.n for r in top.groupBy("g").agg(F.count("*").alias("n")).collect()} == {0: 4, 1: 4, 2: 4}


def test_lookup_covers_heavy_light_and_missing_keys(spark, monkeypatch):
    from tallyspark.operators import distributed

    monkeypatch.setattr(distributed, "HEAVY_KEYS", 1)
    rows = spark.createDataFrame([("h", i) for i in range(50)] + [("l", 1), ("z", 1), (None, 1)], "k string, x int")
    groups = spark.createDataFrame([("h", 50, "H"), ("l", 1, "L")], "k string, n long, name string")
    inner = lookup(rows, groups, "k", "n")
    assert {r.name: r["count"] for r in inner.groupBy("name").count().collect()} == {"H": 50, "L": 1}
    left = lookup(rows, groups, "k", "n", "left")
    assert left.count() == 53 and left.where("name is null").count() == 2


@pytest.mark.parametrize("heavy", [1000, 0, 1])
def test_lookup_of_hot_and_null_keys_reads_rows_once(spark, monkeypatch, tmp_path, heavy):
    """A third of the rows on one key, a third without a key."""
    from tallyspark.operators import distributed

    monkeypatch.setattr(distributed, "HEAVY_KEYS", heavy)
    data = [("hot" if k % 3 == 0 else None if k % 3 == 1 else f"k{k % 50}", k) for k in range(900)]
    spark.createDataFrame(data, "k string, x long").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    groups = rows.where("k is not null and k <> 'k5'").groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("high"))
    left = lookup(rows, groups, "k", "n", "left")
    sizes, high = {}, {}
    for k, x in data:
        sizes[k], high[k] = sizes.get(k, 0) + 1, x
    want = {(k, x, *((None, None) if k in (None, "k5") else (sizes[k], high[k]))) for k, x in data}
    assert set(map(tuple, left.collect())) == want and left.count() == len(data)
    assert set(map(tuple, lookup(rows, groups, "k", "n").collect())) == {r for r in want if r[2] is not None}
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [k#") == 1


def _children(spark):
    """A third of the rows without a key, a third on one key, the rest on many; some of those have no parent."""
    return spark.range(900).selectExpr(
        "id", "case when id % 3 = 0 then null when id % 3 = 1 then 7L else id % 40 end as k", "id % 5 as a", "'x' as __x", "2 as rows")


@pytest.mark.parametrize("heavy", [1000, 1, 0])
def test_reference_checks_under_null_and_hot_keys(spark, monkeypatch, heavy):
    monkeypatch.setattr(distributed, "HEAVY_KEYS", heavy)
    child = _children(spark).drop("__x")
    rows = [r.asDict() for r in child.collect()]
    for lost in (7, 8):
        parents = {k: k % 5 for k in range(40) if k != lost and k < 36}
        parent = spark.createDataFrame(list(parents.items()), "k long, a_true long")
        want = sorted(r["id"] for r in rows if r["k"] not in parents)
        got = checks.orphans(child, parent, "k")
        assert got.columns == child.columns and sorted(r.id for r in got.collect()) == want
        both = checks.orphans(child, parent.withColumnRenamed("a_true", "a"), ["k", "a"])
        assert sorted(r.id for r in both.collect()) == sorted(r["id"] for r in rows if parents.get(r["k"]) != r["a"])
        assert checks.orphan_count(child, parent, "k").first().orphans == len(want)
        bad = checks.identity_mismatches(child, parent, "k", {"a": "a_true"})
        assert sorted(r.id for r in bad.collect()) == sorted(r["id"] for r in rows if r["k"] in parents and r["a"] != parents[r["k"]])
    assert checks.orphan_count(child.limit(0), parent, "k").first().orphans == 0
    assert checks.orphans(child.limit(0), parent, "k").count() == 0 and checks.orphans(child, parent.limit(0), "k").count() == 900


def test_brands_and_branches_under_null_and_hot_keys(spark):
    listings = _children(spark).selectExpr("id", "cast(k as string) as brand")
    registry = spark.createDataFrame([("7",), ("8",), ("8",), (None,)], "brand_name string")
    got = {r.id: r.brand_signal for r in listing.brand_lookup(listings, registry).collect()}
    assert got == {r.id: "no_brand" if r.brand is None else "registered" if r.brand in "78" else "unregistered" for r in listings.collect()}
    written = _children(spark).selectExpr("id as review_id", "'b' as brand_name", "k as branch_id", "'r' as reviewer_id", "'t' as review_text", "5 as stars",
                                          "current_timestamp() as published_at", "'en' as original_language", "null as owner_response_text")
    place = spark.createDataFrame([(7, "seven", "c", "n"), (8, "eight", "c", "n")], "branch_id long, branch_label string, city string, neighbourhood string")
    seen = sorted((r.review_id, r.branch_label) for r in reviews.enriched(written, place).collect())
    assert seen == sorted((r.review_id, {7: "seven", 8: "eight"}[r.branch_id]) for r in written.collect() if r.branch_id in (7, 8))
