"""Splits, samples, weights and scores."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.hashing import conversation_split
from tallyspark.functions.text import sheet_safe
from tallyspark.operators import checks, evaluation as ev
from tallyspark.sources import readers, sinks

QUOTAS = {"calibration": {"complaint": 1, "order inquiry": 1}, "heldout": {"complaint": 1}}
REVIEW = "evaluation_id string, split string, message_id string, gold_intent string, gold_is_urgent string, reviewer_status string, reviewer_notes string"
MANIFEST = (
    "evaluation_id string, split string, message_id string, predicted_intent string, predicted_is_urgent string, "
    "predicted_triage_label string, sampling_stratum string, sampling_weight string")


def case(spark, status="reviewed"):
    reviews = spark.createDataFrame([
        ("CAL-0001", "calibration", "m1", "complaint", "false", status, ""),
        ("CAL-0002", "calibration", "m2", "complaint", "true", "adjudicated", "")], REVIEW)
    manifest = spark.createDataFrame([
        ("CAL-0001", "calibration", "m1", "complaint", "false", "complaint", "complaint", "5"),
        ("CAL-0002", "calibration", "m2", "order inquiry", "false", "order inquiry", "order inquiry", "2")], MANIFEST)
    return reviews, manifest


def test_scores_of_two_reviews(spark):
    report, errors = ev.score(*case(spark), "calibration", QUOTAS)
    got = {(r.target, r.weighting, r.label): r for r in report.collect()}
    assert got["triage", "rows", "complaint"].accuracy == 0.5
    assert got["intent", "rows", "complaint"].accuracy == 0.5
    assert got["triage", "population", "spam"].accuracy == pytest.approx(5 / 7)
    urgent = got["urgency", "rows", "urgent"]
    assert urgent.support == 1 and urgent.recall == 0.0
    assert got["triage", "rows", "spam"].f1 == 0.0 and got["triage", "rows", "spam"].macro_f1 == pytest.approx(1 / 6)
    assert [r.evaluation_id for r in errors.collect()] == ["CAL-0002"]


def test_unfinished_or_foreign_reviews_are_refused(spark):
    with pytest.raises(checks.ContractError, match="gold labels"):
        ev.score(*case(spark, ""), "calibration", QUOTAS)
    with pytest.raises(checks.ContractError, match="unknown evaluation split"):
        ev.score(*case(spark), "test", QUOTAS)
    reviews, manifest = case(spark)
    with pytest.raises(checks.ContractError, match="do not match"):
        ev.score(reviews, manifest.limit(1), "calibration", QUOTAS)
    with pytest.raises(checks.ContractError, match="strata"):
        ev.score(reviews, manifest.withColumn("sampling_stratum", F.lit("spam")), "calibration", QUOTAS)
    with pytest.raises(checks.ContractError, match="mismatch"):
        ev.score(reviews.withColumn("message_id", F.lit("m1")), manifest, "calibration", QUOTAS)


def test_splits_follow_the_hash_and_the_forced_list(spark):
    df = spark.range(600).select("id", conversation_split(F.col("id")).alias("split"))
    got = {r.id: r.split for r in df.collect()}
    assert got[150] == "calibration" and all(got[i] == "heldout" for i in (94, 102, 151, 152, 555))
    for i in range(600):
        if i not in (150, 94, 102, 151, 152, 555):
            value = int(hashlib.sha256(f"20260806:{i}".encode()).hexdigest()[:8], 16)
            assert got[i] == ("calibration" if value % 100 < 20 else "heldout")


def results(spark, n=3000):
    labels = [x for x in ev.QUOTAS["heldout"]]
    df = spark.range(n).select(
        F.format_string("c%d:s1:t0", "id").alias("message_id"), F.col("id").alias("conversation_index"), F.lit(1).alias("seed_id"),
        F.lit(0).alias("turn_index"), F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("id") % 6 + 1).cast("int")).alias("triage_label"))
    return df.withColumns({
        "intent": F.when(F.col("triage_label") == "urgent escalation", "complaint").otherwise(F.col("triage_label")),
        "is_urgent": F.col("triage_label") == "urgent escalation",
        "decision_source": F.lit("rule_gate"), "confidence_band": F.lit("high")})


def test_sample_meets_quotas_is_disjoint_and_weighs_up_to_the_population(spark):
    rows = results(spark, 6000)
    sample = ev.stratified_sample(rows).cache()
    assert sample.count() == 1000 and sample.select("message_id").distinct().count() == 1000
    assert checks.group_leaks(sample, "conversation_index", "split").count() == 0
    assert sample.agg(F.sum("sampling_weight")).first()[0] == pytest.approx(6000, abs=0.01)
    again = {r.message_id for r in ev.stratified_sample(rows.repartition(7)).collect()}
    assert again == {r.message_id for r in sample.collect()}


def test_queue_is_blinded_and_numbered(spark):
    turns = results(spark, 400).select(
        "conversation_index", "seed_id", F.lit("chat").alias("platform"), "turn_index", F.lit("customer").alias("author"),
        F.concat(F.lit("=x"), "conversation_index").alias("text"), F.lit(0).alias("gap_minutes"))
    review, manifest = ev.prepare(turns, results(spark, 400), "hash", QUOTAS)
    assert tuple(review.columns) == ev.REVIEW_HEADERS and tuple(manifest.columns) == ev.MANIFEST_HEADERS
    rows = review.orderBy("evaluation_id").collect()
    assert [r.evaluation_id for r in rows] == ["CAL-0001", "CAL-0002", "TEST-0001"]
    assert all(r.gold_intent == "" and r.current_message.startswith("'=x") for r in rows)
    with pytest.raises(checks.ContractError, match="insufficient"):
        ev.prepare(turns, results(spark, 400), "hash", {"heldout": {"spam": 4000}})
    with pytest.raises(checks.ContractError, match="do not match eligible"):
        ev.prepare(turns, results(spark, 401), "hash", QUOTAS)


def test_sheet_safety_and_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("=SUM(A1:A2)", 'say "hi",\nbye'), ("plain", ""), ("-1", "ü")], "a string, b string")
    safe = df.select(sheet_safe(F.col("a")).alias("a"), "b")
    assert [r.a for r in safe.collect()] == ["'=SUM(A1:A2)", "plain", "'-1"]
    sinks.write_csv(safe, str(tmp_path / "c"), ["b", "a"])
    part = next((tmp_path / "c").glob("part-*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbf")
    back = readers.csv_strings(spark, str(tmp_path / "c"))
    assert back.columns == ["b", "a"] and sorted(map(tuple, back.collect())) == sorted((r.b, r.a) for r in safe.collect())
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_csv(safe, str(tmp_path / "c"), ["a"])
