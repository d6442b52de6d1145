"""Review benchmarking over normalised review tables.

Expected columns: review_id, brand_name, branch_id, reviewer_id, review_text,
stars, published_at (timestamp), and where used owner_response_text and the
language columns. Every function returns a lazy frame.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import stats
from ..functions.evidence import trend_grade
from ..functions.lexicon import COMPLAINTS, THEMES, Theme, matches_theme, theme_named
from ..functions.text import ARABIC_LETTERS, has_text, normalize_text
from . import checks
from .distributed import lookup_parent

PERIODS = ("early", "recent")
FOOD_ASPECT = "الطعام"  # fixed value: the structured food sub-rating


def brand_profile(reviews: DataFrame) -> DataFrame:
    """Per brand: volume, reach, dates, mean stars, text and owner responses.

    One scan. The distinct counts are planned as two-level aggregations over (brand,
    reviewer) and (brand, branch), so a brand with a third of all rows is never one task.
    """
    return reviews.where(F.col("brand_name").isNotNull()).groupBy("brand_name").agg(
        F.count(F.lit(1)).alias("unique_reviews"),
        F.to_date(F.min("published_at")).cast("string").alias("first_date"),
        F.to_date(F.max("published_at")).cast("string").alias("last_date"),
        F.avg("stars").alias("mean_stars"),
        F.count_if(has_text(F.col("review_text"))).alias("reviews_with_text"),
        F.count_if(F.col("owner_response_text").isNotNull()).alias("owner_responses"),
        F.count_distinct("reviewer_id").alias("reviewers"),
        F.count_distinct("branch_id").alias("reviewed_branches"),
    )


def reviewer_activity(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("reviewer_id", "brand_name").agg(
        F.count(F.lit(1)).alias("review_count"),
        F.min("published_at").alias("first_review_at"),
        F.max("published_at").alias("last_review_at"),
    )


def enriched(reviews: DataFrame, branches: DataFrame) -> DataFrame:
    """Reviews with their branch's place and an owner-response flag; a branch may hold any share of the reviews."""
    place = branches.select("branch_id", "branch_label", "city", "neighbourhood")
    return lookup_parent(reviews, place, "branch_id").select(
        "review_id", "brand_name", "branch_id", "branch_label", "city", "neighbourhood", "reviewer_id",
        "review_text", "stars", "published_at", "original_language",
        F.col("owner_response_text").isNotNull().cast("int").alias("has_owner_response"),
    )


def data_quality(reviews: DataFrame, branches: DataFrame, source_records: DataFrame) -> DataFrame:
    """(counter, value) rows; one pass per table plus one anti-join."""
    per_review = reviews.agg(
        F.count(F.lit(1)).alias("unique_review_ids"),
        F.count_if(~has_text(F.col("review_text"))).alias("reviews_without_text"),
        F.count_if(F.col("record_language") == "ar").alias("record_language_ar"),
        F.count_if(F.col("original_language") == "ar").alias("detected_arabic_text"),
        F.count_if(F.col("original_language").isin("en", "en-GB", "en-Arab")).alias("detected_english_text"),
        F.count_if(F.col("original_language").isNull()).alias("unknown_original_language"),
    )
    per_source = source_records.agg(
        F.count(F.lit(1)).alias("source_review_rows"),
        F.count_if("is_exact_duplicate").alias("exact_duplicate_source_rows"),
    )
    per_branch = branches.agg(F.count(F.lit(1)).alias("branches"))
    lost = checks.orphan_count(reviews.select("branch_id"), branches, "branch_id").withColumnRenamed("orphans", "orphan_reviews")
    wide = per_review.crossJoin(per_source).crossJoin(per_branch).crossJoin(lost)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("counter"), F.col(c).alias("value")) for c in wide.columns
    ])).alias("r")).select("r.*")


# --- periods -----------------------------------------------------------------------------

@dataclass(frozen=True)
class HalfSplit:
    """The observed span cut at its exact midpoint."""

    start: datetime
    end: datetime

    @property
    def midpoint(self) -> datetime:
        return self.start + timedelta(microseconds=int((self.end - self.start) / timedelta(microseconds=1)) // 2)

    @property
    def duration_days(self) -> float:
        return (self.end - self.start).total_seconds() / 86400

    @property
    def labels(self) -> tuple[str, str]:
        a, m, b = self.start.date(), self.midpoint.date(), self.end.date()
        return f"{a} to {m} (before midpoint timestamp)", f"{m} to {b} (from midpoint timestamp)"

    def is_early(self, time: Column | str = "published_at") -> Column:
        column = F.col(time) if isinstance(time, str) else time
        micros = int((self.midpoint - datetime(1970, 1, 1)) / timedelta(microseconds=1))
        return F.unix_micros(column) < F.lit(micros)

    def period(self, time: Column | str = "published_at") -> Column:
        return F.when(self.is_early(time), PERIODS[0]).otherwise(PERIODS[1])


def analysis_window(reviews: DataFrame) -> HalfSplit:
    low, high = reviews.agg(F.unix_micros(F.min("published_at")), F.unix_micros(F.max("published_at"))).first()
    if low is None:
        raise checks.ContractError("No reviews exist.")
    moment = lambda us: datetime.fromtimestamp(0, timezone.utc).replace(tzinfo=None) + timedelta(microseconds=us)
    return HalfSplit(moment(low), moment(high))


# --- themes -------------------------------------------------------------------------------

def _prepared(reviews: DataFrame) -> DataFrame:
    normal = reviews.withColumn("__norm", normalize_text(F.col("review_text")))
    return normal.withColumn("__arabic", F.col("__norm").rlike(ARABIC_LETTERS))


def theme_counts(
    reviews: DataFrame, window: HalfSplit, themes: tuple[Theme, ...] = THEMES, keys: Iterable[str] = ("brand_name",)
) -> DataFrame:
    """Matches and text totals per (keys, theme) in both halves, zero rows included.

    All themes are conditional counts of a single aggregation: one scan, one small
    shuffle, no exploded matches and no grid to join back.
    """
    keys = list(keys)
    early = window.is_early()
    flagged = _prepared(reviews).select(
        *keys, early.alias("__early"), (F.length("__norm") > 0).alias("__text"),
        *[matches_theme(F.col("__norm"), F.col("stars"), t, F.col("__arabic")).alias(f"__t{i}") for i, t in enumerate(themes)],
    )
    sides = {PERIODS[0]: F.col("__early"), PERIODS[1]: ~F.col("__early")}
    wide = flagged.groupBy(*keys).agg(
        *[F.count_if(on & F.col("__text")).alias(f"{p}_text_reviews") for p, on in sides.items()],
        *[F.count_if(on & F.col(f"__t{i}")).alias(f"{p}_{i}") for p, on in sides.items() for i in range(len(themes))],
    )
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(t.name).alias("theme"), F.lit(i).alias("theme_order"),
            *[F.col(f"{p}_{i}").alias(f"{p}_matches") for p in PERIODS],
        )
        for i, t in enumerate(themes)
    ]))
    return wide.select(*keys, *[f"{p}_text_reviews" for p in PERIODS], rows.alias("m")).select(
        *keys, *[f"{p}_text_reviews" for p in PERIODS], "m.*"
    )


def with_trend_measures(counts: DataFrame) -> DataFrame:
    """Rates, Wilson bounds, changes and the evidence grade for early/recent counts."""
    for p in PERIODS:
        m, t = F.col(f"{p}_matches"), F.col(f"{p}_text_reviews")
        counts = counts.withColumns({
            f"{p}_per_1000": stats.per_1000(m, t),
            f"{p}_ci_low_per_1000": 1000 * stats.wilson_low(m, t),
            f"{p}_ci_high_per_1000": 1000 * stats.wilson_high(m, t),
        })
    early, recent = F.col("early_per_1000"), F.col("recent_per_1000")
    return counts.withColumns({
        "absolute_change_per_1000": recent - early,
        "relative_change_percent": stats.relative_change_percent(early, recent),
        "evidence_grade": trend_grade(F.col("early_matches"), F.col("recent_matches")),
    })


def theme_trends(reviews: DataFrame, window: HalfSplit, themes: tuple[Theme, ...] = THEMES) -> DataFrame:
    return with_trend_measures(theme_counts(reviews, window, themes))


def theme_evidence(reviews: DataFrame, window: HalfSplit, themes: tuple[Theme, ...] = THEMES) -> DataFrame:
    """All evidence, one row per (brand, theme, period, review).

    The id lists stay rows: a popular theme may be cited by a third of all reviews,
    which no single array (and no single task) should hold.
    """
    matched = F.filter(
        F.array(*[F.when(matches_theme(F.col("__norm"), F.col("stars"), t, F.col("__arabic")), F.lit(t.name)) for t in themes]),
        lambda x: x.isNotNull(),
    )
    return _prepared(reviews).select(
        "brand_name", F.explode(matched).alias("theme"), window.period().alias("period"), "review_id", "published_at"
    )


def select_trends(trends: DataFrame, themes: Iterable[str]) -> DataFrame:
    return trends.where(F.col("theme").isin(*themes))


def evidence_sample(evidence: DataFrame, limit: int = 8) -> DataFrame:
    """First ``limit`` cited reviews per brand and theme, early ones first."""
    w = W.partitionBy("brand_name", "theme").orderBy("period", "published_at", "review_id")
    return (
        evidence.withColumn("position", F.row_number().over(w)).where(F.col("position") <= F.lit(int(limit)))
        .select("brand_name", "theme", "position", "period", "review_id")
    )


def fastest_growing_complaints(trends: DataFrame, complaints: tuple[str, ...] = COMPLAINTS) -> DataFrame:
    """The eligible complaint theme that rose most per brand; brands without one keep a row."""
    fit = trends.where(F.col("theme").isin(*complaints) & (F.col("evidence_grade") == "eligible"))
    w = W.partitionBy("brand_name").orderBy(F.desc("absolute_change_per_1000"), "theme_order")
    best = fit.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    columns = ("early_matches", "recent_matches", "early_per_1000", "recent_per_1000", "absolute_change_per_1000")
    return (
        trends.select("brand_name").distinct().join(best.select("brand_name", "theme", *columns), "brand_name", "left")
        .select("brand_name", "theme",
                F.when(F.col("theme").isNull(), "No eligible complaint theme").otherwise("eligible").alias("status"),
                *columns)
    )


def loyalty_evidence(reviews: DataFrame, brands: DataFrame, theme: str = "loyalty_program_mention") -> DataFrame:
    """Mentions split by low and high stars for every brand, also those without any."""
    hit = matches_theme(F.col("__norm"), F.col("stars"), theme_named(theme), F.col("__arabic"))
    counted = _prepared(reviews).where(hit).groupBy("brand_name").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.count_if(F.col("stars") <= 3).alias("low_rating_mentions"),
        F.count_if(F.col("stars") > 3).alias("high_rating_mentions"),
        F.min("review_id").alias("first_evidence_id"),
    )
    return brands.select("brand_name").join(counted, "brand_name", "left").select(
        "brand_name", *[F.coalesce(c, F.lit(0)).alias(c)
                        for c in ("mentions", "low_rating_mentions", "high_rating_mentions")], "first_evidence_id"
    )


def period_rating_trends(reviews: DataFrame, window: HalfSplit) -> DataFrame:
    """Mean stars with normal intervals in both halves, per brand."""
    stars = {p: F.when(window.period() == p, F.col("stars")) for p in PERIODS}
    wide = reviews.groupBy("brand_name").agg(*[
        c for p in PERIODS for c in (
            F.count(stars[p]).alias(f"{p}_n"), F.avg(stars[p]).alias(f"{p}_mean_stars"),
            F.stddev_samp(stars[p]).alias(f"{p}_sd"),
        )
    ])
    for p in PERIODS:
        parts = (F.col(f"{p}_mean_stars"), F.col(f"{p}_sd"), F.col(f"{p}_n"))
        wide = wide.withColumns({f"{p}_ci_low": stats.mean_low(*parts), f"{p}_ci_high": stats.mean_high(*parts)})
    return wide.withColumn("change_stars", F.col("recent_mean_stars") - F.col("early_mean_stars")).drop(
        *[f"{p}_sd" for p in PERIODS]
    )


def trend_vs_rating(trends: DataFrame, ratings: DataFrame, theme: str = "wait_time_complaint") -> DataFrame:
    """A theme's rate change beside the rating change; an association, nothing more."""
    return trends.where(F.col("theme") == theme).join(ratings, "brand_name").select(
        "brand_name", "theme", "early_per_1000", "recent_per_1000", "absolute_change_per_1000", "evidence_grade",
        "early_mean_stars", "recent_mean_stars", "change_stars",
    )


# --- reviewers shared between brands --------------------------------------------------------

def _pairs(sorted_array: str) -> Column:
    """All ordered pairs of a sorted array of structs or strings."""
    arr = F.col(sorted_array)
    return F.flatten(F.transform(
        arr, lambda a, i: F.transform(F.slice(arr, i + 2, F.size(arr)), lambda b: F.struct(a.alias("a"), b.alias("b")))
    ))


def brand_pairs(brands: DataFrame) -> DataFrame:
    """Every unordered brand pair once: the rows of the overlap report.

    Brands are the report's dimension (a handful of competitors), gathered as one
    sorted array of names.
    """
    names = brands.select("brand_name").distinct().agg(F.sort_array(F.collect_set("brand_name")).alias("names"))
    return names.select(F.explode(_pairs("names")).alias("p")).select(
        F.col("p.a").alias("brand_a"), F.col("p.b").alias("brand_b")
    )


def reviewer_overlap(reviews: DataFrame, brands: DataFrame) -> DataFrame:
    """Shared reviewers per brand pair, also split by presence at every brand.

    Reviewers collapse to counts per distinct brand set first; pairs come from those
    few sets, not from reviewers.
    """
    per_reviewer = reviews.groupBy("reviewer_id").agg(F.sort_array(F.collect_set("brand_name")).alias("names"))
    sets = per_reviewer.where(F.size("names") > 1).groupBy("names").agg(F.count(F.lit(1)).alias("n"))
    total = brands.select("brand_name").distinct().agg(F.count(F.lit(1)).alias("all_brands"))
    counted = (
        sets.crossJoin(F.broadcast(total))  # one row by construction
        .withColumn("everywhere", F.size("names") == F.col("all_brands"))
        .select("n", "everywhere", F.explode(_pairs("names")).alias("p"))
        .groupBy(F.col("p.a").alias("brand_a"), F.col("p.b").alias("brand_b"))
        .agg(F.sum("n").alias("shared_reviewers"), F.sum(F.when(F.col("everywhere"), F.col("n"))).alias("also_everywhere"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return brand_pairs(brands).join(counted, ["brand_a", "brand_b"], "left").select(
        "brand_a", "brand_b", zero("shared_reviewers").alias("shared_reviewers"),
        zero("also_everywhere").alias("shared_reviewers_at_all_brands"),
        (zero("shared_reviewers") - zero("also_everywhere")).alias("pair_exclusive_reviewers"),
    )


def customer_means(reviews: DataFrame, detailed: DataFrame | None = None, aspect: str = FOOD_ASPECT) -> DataFrame:
    """One mean per (reviewer, brand): overall stars and, if given, an aspect's score."""
    stars = reviews.groupBy("reviewer_id", "brand_name").agg(F.avg("stars").alias("overall_stars"))
    if detailed is None:
        return stars.withColumn("food_subrating", F.lit(None).cast("double"))
    food = (
        reviews.select("review_id", "reviewer_id", "brand_name")
        .join(detailed.where(F.col("aspect") == aspect), "review_id")
        .groupBy("reviewer_id", "brand_name").agg(F.avg("score").alias("food_subrating"))
    )
    return stars.join(food, ["reviewer_id", "brand_name"], "left")


def customer_balanced(
    reviews: DataFrame, brand: str, reviewers: DataFrame | None = None, measure: str = "overall_stars",
    detailed: DataFrame | None = None,
) -> DataFrame:
    """Mean of reviewer means at one brand, optionally only for a given set of reviewers."""
    data = reviews.where(F.col("brand_name") == brand)
    if reviewers is not None:
        data = data.join(reviewers.select("reviewer_id").distinct(), "reviewer_id", "left_semi")
    return _balance(customer_means(data, detailed).groupBy(), {measure: F.col(measure)})


def _balance(grouped, measures: dict[str, Column]) -> DataFrame:
    frame = grouped.agg(*[
        c for name, value in measures.items() for c in (
            F.avg(value).alias(f"{name}_mean"), F.count(value).alias(f"{name}_reviewers"),
            F.stddev_samp(value).alias(f"{name}_sd"),
        )
    ])
    for name in measures:
        parts = (F.col(f"{name}_mean"), F.col(f"{name}_sd"), F.col(f"{name}_reviewers"))
        frame = frame.withColumns({f"{name}_ci_low": stats.mean_low(*parts), f"{name}_ci_high": stats.mean_high(*parts)})
    return frame.drop(*[f"{name}_sd" for name in measures])


def _shared_pairs(means: DataFrame) -> DataFrame:
    """(reviewer, side a, side b) for the brands a reviewer shares.

    A reviewer contributes at most one row per brand pair, i.e. per report row.
    """
    per_reviewer = means.groupBy("reviewer_id").agg(
        F.sort_array(F.collect_list(F.struct("brand_name", "overall_stars", "food_subrating"))).alias("sides")
    )
    return per_reviewer.where(F.size("sides") > 1).select("reviewer_id", F.explode(_pairs("sides")).alias("p"))


def overlap_ratings(reviews: DataFrame, brands: DataFrame, detailed: DataFrame | None = None) -> DataFrame:
    """Customer-balanced ratings of both sides among the reviewers a pair shares."""
    shared = _shared_pairs(customer_means(reviews, detailed)).withColumns({
        "brand_a": F.col("p.a.brand_name"), "brand_b": F.col("p.b.brand_name")})
    measures = {f"{s}_{m}": F.col(f"p.{s}.{m}") for s in ("a", "b") for m in ("overall_stars", "food_subrating")}
    stats_frame = _balance(shared.groupBy("brand_a", "brand_b"), measures)
    joined = brand_pairs(brands).join(stats_frame, ["brand_a", "brand_b"], "left")
    counts = [f"{m}_reviewers" for m in measures]
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).withColumn(
        "shared_reviewers", F.col("a_overall_stars_reviewers")
    )


def preference_share(reviews: DataFrame, brands: DataFrame) -> DataFrame:
    """Among shared reviewers: who rates A above B, B above A, or both alike."""
    shared = _shared_pairs(customer_means(reviews))
    a, b = F.col("p.a.overall_stars"), F.col("p.b.overall_stars")
    counted = shared.groupBy(F.col("p.a.brand_name").alias("brand_a"), F.col("p.b.brand_name").alias("brand_b")).agg(
        F.count(F.lit(1)).alias("shared"), F.count_if(a > b).alias("prefer_a"),
        F.count_if(b > a).alias("prefer_b"), F.count_if(a == b).alias("no_preference"),
    )
    out = brand_pairs(brands).join(counted, ["brand_a", "brand_b"], "left").fillna(
        0, ["shared", "prefer_a", "prefer_b", "no_preference"])
    return out.withColumns({
        "share_a": stats.ratio(F.col("prefer_a"), F.col("shared")),
        "share_b": stats.ratio(F.col("prefer_b"), F.col("shared")),
    })
