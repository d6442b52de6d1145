"""Themes, trends, overlap, trust checks and claims."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import stats
from tallyspark.functions.lexicon import THEMES, matches_theme, theme_named
from tallyspark.functions.text import language_tag, normalize_term, normalize_text
from tallyspark.operators import reviews as rv, signals as sg

SCHEMA = (
    "review_id string, brand_name string, branch_id string, reviewer_id string, review_text string, stars int, "
    "published_at timestamp, owner_response_text string")
START = datetime(2026, 4, 1)


def frame(spark, rows):
    return spark.createDataFrame(
        [(f"r{i:03d}", b, br, u, t, s, START + timedelta(hours=h), None) for i, (b, br, u, t, s, h) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("text, want", [
    ("  Café  LATTE \t", "café latte"), ("أَهْلاً  إلى آخر القهوة", "اهلا الي اخر القهوه"), ("ﬁne ①", "fine 1"),
    ("خــدمة", "خدمه"), (None, ""), ("   ", ""), ("plain", "plain"),
])
def test_normal_form(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(normalize_text(F.col("t"))).first()[0]
    assert got == want
    if text:
        assert normalize_term(text) == want


@pytest.mark.parametrize("text, stars, theme, want", [
    ("Very SLOW service", 2, "wait_time_complaint", True), ("Very slow service", 4, "wait_time_complaint", False),
    ("انتظار طويل", 3, "wait_time_complaint", True), ("تأخير", 1, "wait_time_complaint", True),
    ("back again and again", 5, "repeat_visit_language", True), ("برنامج الولاء ممتاز", 5, "loyalty_program_mention", True),
    (None, 1, "service_complaint", False), ("nice", 1, "service_complaint", False),
])
def test_theme_matches(spark, text, stars, theme, want):
    df = spark.createDataFrame([(text, stars)], "t string, s int")
    assert df.select(matches_theme(normalize_text(F.col("t")), F.col("s"), theme_named(theme))).first()[0] is want


def test_intervals(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (23, 1170)], "m int, n int")
    got = df.select(stats.wilson_low(F.col("m"), F.col("n")).alias("l"), stats.wilson_high(F.col("m"), F.col("n")).alias("h")).collect()
    assert tuple(got[0]) == (0.0, 0.0) and got[1].l == 0.0 and got[2].h == 1.0
    p, z, n = 23 / 1170, 1.96, 1170
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    assert tuple(got[3]) == pytest.approx((centre - half, centre + half))
    one = spark.createDataFrame([(3.0,)], "v double").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.count("v").alias("n"))
    assert one.select(stats.mean_low(F.col("m"), F.col("s"), F.col("n"))).first()[0] == 3.0


def test_language(spark):
    df = spark.createDataFrame([("سلام",), ("hi",), ("hi سلام",), ("123",)], "t string")
    assert [r[0] for r in df.select(language_tag(F.col("t"))).collect()] == ["arabic", "english", "mixed", "other"]


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [("A", "a1", f"u{i}", "slow queue" if i % 2 else "fine", 1, i) for i in range(12)]
    rows += [("A", f"a{i % 3}", f"u{i}", "so slow", 2, 100 + i) for i in range(20)]
    rows += [("B", "b1", f"u{i}", "loyalty points", 5 if i else 2, i * 9) for i in range(8)]
    rows += [("C", "c1", "u1", None, 4, 119)]
    return frame(spark, rows).cache()


def test_trends_with_grades_and_zero_rows(reviews):
    window = rv.analysis_window(reviews)
    got = {(r.brand_name, r.theme): r for r in rv.theme_trends(reviews, window).collect()}
    assert len(got) == 3 * len(THEMES)
    wait = got["A", "wait_time_complaint"]
    assert (wait.early_matches, wait.recent_matches, wait.early_text_reviews, wait.recent_text_reviews) == (6, 20, 12, 20)
    assert wait.evidence_grade == "eligible" and wait.relative_change_percent == pytest.approx(100.0)
    empty = got["C", "wait_time_complaint"]
    assert empty.recent_text_reviews == 0 and empty.recent_per_1000 == 0.0 and empty.relative_change_percent is None
    top = {r.brand_name: r.theme for r in rv.fastest_growing_complaints(rv.theme_trends(reviews, window)).collect()}
    assert top == {"A": "wait_time_complaint", "B": None, "C": None}


def test_evidence_is_whole_and_its_sample_starts_early(reviews):
    window = rv.analysis_window(reviews)
    evidence = rv.theme_evidence(reviews, window).where("theme = 'wait_time_complaint'")
    assert evidence.count() == 26
    sample = rv.evidence_sample(evidence, 8).orderBy("position").collect()
    assert [r.period for r in sample] == ["early"] * 6 + ["recent"] * 2


def test_loyalty_keeps_brands_without_mentions(reviews):
    got = {r.brand_name: (r.mentions, r.low_rating_mentions, r.high_rating_mentions) for r in rv.loyalty_evidence(reviews, reviews.select("brand_name")).collect()}
    assert got == {"A": (0, 0, 0), "B": (8, 1, 7), "C": (0, 0, 0)}


def test_overlap_is_inclusive_and_balanced_by_customer(reviews):
    brands = reviews.select("brand_name")
    got = {(r.brand_a, r.brand_b): r for r in rv.reviewer_overlap(reviews, brands).collect()}
    assert (got["A", "B"].shared_reviewers, got["A", "B"].shared_reviewers_at_all_brands, got["A", "B"].pair_exclusive_reviewers) == (8, 1, 7)
    assert got["A", "C"].shared_reviewers == got["B", "C"].shared_reviewers == 1
    rated = {(r.brand_a, r.brand_b): r for r in rv.overlap_ratings(reviews, brands).collect()}
    assert rated["A", "B"].a_overall_stars_mean == 1.5 and rated["A", "B"].b_overall_stars_mean == pytest.approx(37 / 8)
    assert rated["A", "C"].a_overall_stars_ci_low == rated["A", "C"].a_overall_stars_mean == 1.5
    share = {(r.brand_a, r.brand_b): (r.prefer_a, r.prefer_b) for r in rv.preference_share(reviews, brands).collect()}
    assert share["A", "B"] == (0, 8)


def test_pairs_without_shared_reviewers_remain(spark):
    r = frame(spark, [("A", "x", "u1", "t", 1, 0), ("B", "x", "u2", "t", 1, 1)])
    assert rv.reviewer_overlap(r, r).first().shared_reviewers == 0
    assert rv.overlap_ratings(r, r).first().a_overall_stars_mean is None


def test_midpoint_belongs_to_the_recent_half(spark):
    r = frame(spark, [("A", "x", "u", "t", 1, h) for h in (0, 5, 10)])
    got = {x.review_id: x.p for x in r.select("review_id", rv.analysis_window(r).period().alias("p")).collect()}
    assert got == {"r000": "early", "r001": "recent", "r002": "recent"}


def test_suspicion_flags_keep_every_review(spark):
    rows = [("A", "x", f"u{i}", f"unique text number {i} {'w' * (i + 1)}", 5, 24 * i) for i in range(30)]
    rows += [("A", "x", "spammer", "Best PLACE, best", 1, 24 * 40 + i / 10) for i in range(60)]
    flagged = sg.suspicious_reviews(frame(spark, rows), sg.SuspicionPolicy(3.0, 20, 2.0)).cache()
    assert flagged.count() == 90
    n = flagged.agg(*[F.count_if(c).alias(c) for c in ("repeated_wording", "burst", "extreme_reviewer", "concentrated")]).first()
    assert tuple(n) == (60, 60, 60, 0)
    got = sg.with_and_without(flagged, ["brand_name"], F.col("stars")).first()
    assert got.without_suspicious == 5.0 and got.with_all == pytest.approx((150 + 60) / 90)


def test_runs_of_weeks(spark):
    r = frame(spark, [("A", "x", "u", "t", 1, 24 * 7 * w) for w in (0, 1, 2, 5, 6)]).withColumn("theme", F.lit("t"))
    got = sg.persistence(r).first()
    assert (got.active_weeks, got.longest_run) == (5, 3)


def test_claims_and_their_validator(reviews):
    trends = rv.theme_trends(reviews, rv.analysis_window(reviews))
    claims = sg.claims(trends, "v1").cache()
    cited = "CLM-WAIT_TIME_COMPLAINT-A"
    sentences = reviews.sparkSession.createDataFrame([
        ("ok", "A went from 6 to 20 mentions, up.", cited), ("number", "A had 77 mentions.", cited),
        ("cause", "A fell because of 6 drivers.", cited), ("free", "Everybody loves A.", None), ("brand", "Z has 6 mentions.", cited),
    ], "sentence_id string, sentence string, claim_id string")
    got = {}
    for r in sg.narrative_violations(sentences, claims).collect():
        got.setdefault(r.sentence_id, set()).add(r.violation)
    assert got == {"number": {"unsupported_number"}, "cause": {"causal_verb", "wrong_direction"}, "free": {"unbound"}, "brand": {"wrong_brand"}}
    ranked = sg.ranked_claims(claims, {"a": "1"}).collect()
    assert [r.place for r in ranked] == list(range(1, len(ranked) + 1)) and len({r.snapshot_id for r in ranked}) == 1


def test_equal_changes_rank_by_claim_id_whatever_their_doubles(spark):
    counts = {"a": (7, 8, 90, 90), "b": (5, 6, 90, 90), "c": (6, 7, 90, 90), "top": (5, 7, 90, 90), "low": (9, 5, 90, 90), "none": (0, 0, 0, 90)}
    rows = [
        (k, "eligible", 1000.0 * (rm / rt) - (1000.0 * (em / et) if et else 0.0), [str(em), str(rm), str(et), str(rt)])
        for k, (em, rm, et, rt) in counts.items()]
    assert len({r[2] for r in rows[:3]}) > 1
    claims = spark.createDataFrame(rows, "claim_id string, evidence_grade string, absolute_change_per_1000 double, numbers array<string>")
    got = sg.ranked_claims(claims, {"a": "1"}).orderBy("place").collect()
    assert [r.claim_id for r in got] == ["top", "a", "b", "c", "none", "low"]


def test_only_texts_that_normalisation_may_change_leave_the_jvm(spark):
    import unicodedata

    from tallyspark.functions import text as tx

    second = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    second |= {int(p[1], 16) for p in (unicodedata.decomposition(chr(c)).split() for c in range(0x110000)) if len(p) == 2 and p[0][0] != "<"}
    kept = [c for a, b in tx.NORMAL_RANGES for c in range(a, b + 1)]
    assert all(unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)) and c not in second for c in kept)

    stay = ["", "plain\n", "déjà vu – “œuvre” été", "Ελλάδα ήταν", "привет ёж", "قهوه كل مره", "\U0001F600 日本か 한국", "".join(map(chr, kept))]
    leave = ["e\u0301", "a\ufb01b", "x²", "line\nＡ", "هـ\u064b", "ش\ufdfa", "é" * 5000 + "…"]
    df = spark.createDataFrame([(t,) for t in stay + leave], "t string")
    got = [r[0] for r in df.select(F.col("t").rlike(tx._MAY_CHANGE)).collect()]
    assert got == [False] * len(stay) + [True] * len(leave)
    assert [r[0] for r in df.select(tx.nfkc(F.col("t"))).collect()] == [unicodedata.normalize("NFKC", t) for t in stay + leave]
