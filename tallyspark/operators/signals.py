"""How far a review signal can be trusted: breadth, persistence, stability, suspicion, claims.

The written design names these checks without code; each docstring is the definition.
Evidence frames are those of ``reviews.theme_evidence`` joined with their review columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import stats
from ..functions.hashing import fingerprint, hash_percent
from ..functions.text import normalize_text
from ..session import cut_lineage
from .distributed import lookup
from .listing import word_fingerprint, words

THEME_KEYS = ("brand_name", "theme")


def concentration(evidence: DataFrame, keys: Sequence[str] = THEME_KEYS) -> DataFrame:
    """Mentions, branches, reviewers, weeks, and the largest branch's share per key."""
    keys = list(keys)
    per_branch = evidence.groupBy(*keys, "branch_id").agg(F.count(F.lit(1)).alias("n"))
    base = per_branch.groupBy(*keys).agg(
        F.sum("n").alias("mentions"), F.count("branch_id").alias("branches"), F.max("n").alias("__most"))
    for name, column in (("reviewers", F.col("reviewer_id")), ("weeks", F.date_trunc("week", "published_at"))):
        distinct = evidence.select(*keys, column.alias("__c")).distinct().groupBy(*keys).agg(F.count("__c").alias(name))
        base = base.join(distinct, keys)
    return base.withColumn("largest_branch_share", F.col("__most") / F.col("mentions")).drop("__most")


def weekly(evidence: DataFrame, keys: Sequence[str] = THEME_KEYS) -> DataFrame:
    return evidence.groupBy(*keys, F.to_date(F.date_trunc("week", "published_at")).alias("week")).agg(
        F.count(F.lit(1)).alias("mentions"))


def persistence(evidence: DataFrame, keys: Sequence[str] = THEME_KEYS, min_mentions: int = 1) -> DataFrame:
    """Longest run of adjacent weeks with at least ``min_mentions``, and how many such weeks.

    The windows run over weeks, so they are as long as the calendar.
    """
    keys = list(keys)
    active = weekly(evidence, keys).where(F.col("mentions") >= min_mentions)
    order = W.partitionBy(*keys).orderBy("week")
    week_number = F.floor(F.datediff("week", F.lit("1970-01-05").cast("date")) / 7)
    islands = active.withColumn("__island", week_number - F.row_number().over(order))
    runs = islands.groupBy(*keys, "__island").agg(F.count(F.lit(1)).alias("__run"))
    return runs.groupBy(*keys).agg(F.sum("__run").alias("active_weeks"), F.max("__run").alias("longest_run"))


def fold_stability(flagged: DataFrame, keys: Sequence[str], folds: int = 5) -> DataFrame:
    """Leave-one-fold-out rates of a boolean ``hit`` over rows; folds come from a hash of review_id.

    Totals and folds come from one aggregation; a fold's absence is a subtraction. Stable
    means that rate(recent) - rate(early) keeps its sign whichever fold is left out.
    """
    keys = list(keys)
    fold = (hash_percent(F.lit("fold"), F.col("review_id")) % folds).alias("fold")
    side = lambda p, c: F.count_if((F.col("period") == p) & c)
    always = F.lit(True)
    per_fold = flagged.groupBy(*keys, fold).agg(*[
        side(p, c).alias(f"{p}_{n}") for p in ("early", "recent") for n, c in (("rows", always), ("hits", F.col("hit")))])
    every = W.partitionBy(*keys)  # one row per fold
    rest = {f"__{c}": F.sum(c).over(every) - F.col(c) for c in ("early_rows", "early_hits", "recent_rows", "recent_hits")}
    out = per_fold.withColumns(rest).withColumn(
        "__change", stats.ratio(F.col("__recent_hits"), F.col("__recent_rows"))
        - stats.ratio(F.col("__early_hits"), F.col("__early_rows")))
    return out.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"), F.min("__change").alias("lowest_change"),
        F.max("__change").alias("highest_change"),
    ).withColumn("stable", (F.col("lowest_change") > 0) | (F.col("highest_change") < 0))


@dataclass(frozen=True)
class SuspicionPolicy:
    burst_z: float = 3.0
    reviewer_max: int = 20
    branch_share: float = 0.5
    version: str = "suspicion-v1"


def bursts(reviews: DataFrame, policy: SuspicionPolicy = SuspicionPolicy()) -> DataFrame:
    """(brand_name, day, reviews, z) of days whose volume lies z deviations above the brand's mean day."""
    daily = reviews.groupBy("brand_name", F.to_date("published_at").alias("day")).agg(F.count(F.lit(1)).alias("reviews"))
    brand = W.partitionBy("brand_name")  # one row per day
    z = F.try_divide(F.col("reviews") - F.avg("reviews").over(brand), F.stddev_pop("reviews").over(brand))
    return daily.withColumn("z", z).where(F.col("z") > policy.burst_z)


def suspicious_reviews(reviews: DataFrame, policy: SuspicionPolicy = SuspicionPolicy()) -> DataFrame:
    """All reviews with suspicion flags, without their text; nothing is called fraudulent.

    repeated_wording: the same non-empty word set occurs more than once. burst: written on
    a burst day. extreme_reviewer: more reviews than the limit. concentrated: the branch
    wrote more than the allowed share of its brand.
    """
    # Texts are fingerprinted once; what is written and joined from here on is narrow.
    kept = [c for c in reviews.columns if c != "review_text"]
    marked = cut_lineage(reviews.withColumns({
        "__words": F.when(F.length(normalize_text(F.col("review_text"))) > 0, word_fingerprint(words(normalize_text(F.col("review_text"))))),
        "day": F.to_date("published_at"), "__place": F.concat_ws("\u0000", "brand_name", "branch_id")}).drop("review_text"))
    sizes = lambda key: marked.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(f"{key}_n"))
    repeated = sizes("__words").where("__words_n > 1")
    extreme = sizes("reviewer_id").where(F.col("reviewer_id_n") > policy.reviewer_max)
    per_branch = marked.groupBy("__place", "brand_name").agg(F.count(F.lit(1)).alias("__place_n"))
    per_brand = per_branch.groupBy("brand_name").agg(F.sum("__place_n").alias("__total"))
    heavy = per_branch.join(per_brand, "brand_name").where(
        F.col("__place_n") / F.col("__total") > policy.branch_share).select("__place", "__place_n")
    burst_days = bursts(reviews, policy).select("brand_name", "day", F.lit(True).alias("__burst"))
    out = marked
    for key, groups in (("__words", repeated), ("reviewer_id", extreme), ("__place", heavy)):
        out = lookup(out, groups, key, f"{key}_n", "left")
    out = out.join(burst_days, ["brand_name", "day"], "left")
    out = out.withColumns({
        "repeated_wording": F.col("__words_n").isNotNull(), "burst": F.col("__burst").isNotNull(),
        "extreme_reviewer": F.col("reviewer_id_n").isNotNull(), "concentrated": F.col("__place_n").isNotNull()})
    flags = ("repeated_wording", "burst", "extreme_reviewer", "concentrated")
    out = out.withColumn("suspicious", reduce(lambda a, b: a | b, [F.col(f) for f in flags]))
    return out.select(*kept, "day", *flags, "suspicious")


def with_and_without(flagged: DataFrame, keys: Sequence[str], measure: Column) -> DataFrame:
    """A mean over all rows beside the mean without the suspicious ones."""
    calm = ~F.col("suspicious")
    return flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("suspicious").alias("suspicious_rows"),
        F.avg(measure).alias("with_all"), F.avg(F.when(calm, measure)).alias("without_suspicious"),
    ).withColumn("difference", F.col("without_suspicious") - F.col("with_all"))


def emerging_terms(reviews: DataFrame, period: Column, min_recent: int, min_branches: int) -> DataFrame:
    """Words absent early and then present in many reviews across branches; a queue, not a metric.

    Words shrink to (word, branch) counts before the second shuffle.
    """
    tokens = reviews.select("branch_id", period.alias("__p"), F.explode(F.array_distinct(words(F.col("review_text")))).alias("term"))
    per_branch = tokens.groupBy("term", "branch_id").agg(
        F.count_if(F.col("__p") == "early").alias("early"), F.count_if(F.col("__p") == "recent").alias("recent"))
    return per_branch.groupBy("term").agg(
        F.sum("early").alias("early"), F.sum("recent").alias("recent"),
        F.count_if(F.col("recent") > 0).alias("branches"),
    ).where((F.col("early") == 0) & (F.col("recent") >= min_recent) & (F.col("branches") >= min_branches)).drop("early")


def relative_position(reviews: DataFrame, trailing: int = 3, grain: str = "week") -> DataFrame:
    """Per brand and period: mean stars, percent rank among peers, gap to the own trailing mean."""
    means = reviews.groupBy("brand_name", F.to_date(F.date_trunc(grain, "published_at")).alias("period_start")).agg(
        F.avg("stars").alias("mean_stars"), F.count(F.lit(1)).alias("reviews"))
    peers = W.partitionBy("period_start").orderBy("mean_stars")
    own = W.partitionBy("brand_name").orderBy("period_start").rowsBetween(-trailing, -1)
    return means.withColumns({
        "peer_percent_rank": F.percent_rank().over(peers), "own_baseline": F.avg("mean_stars").over(own),
    }).withColumn("gap_to_baseline", F.col("mean_stars") - F.col("own_baseline"))


def branch_outliers(reviews: DataFrame, low_max: int = 3) -> DataFrame:
    """Branches whose low-rating rate lies above the brand's, Wilson lower bound included; with response coverage."""
    low = F.col("stars") <= low_max
    per = reviews.groupBy("brand_name", "branch_id").agg(
        F.count(F.lit(1)).alias("reviews"), F.count_if(low).alias("low"),
        F.count_if(F.col("owner_response_text").isNotNull()).alias("responses"))
    brand = per.groupBy("brand_name").agg((F.sum("low") / F.sum("reviews")).alias("brand_low_rate"))
    per = per.join(brand, "brand_name")
    return per.withColumns({
        "low_rate": F.col("low") / F.col("reviews"),
        "low_rate_floor": stats.wilson_low(F.col("low"), F.col("reviews")),
        "response_rate": F.col("responses") / F.col("reviews"),
    }).withColumn("outlier", F.col("low_rate_floor") > F.col("brand_low_rate"))


@dataclass(frozen=True)
class ConfidencePolicy:
    high_mentions: int = 50
    medium_mentions: int = 10
    min_branches: int = 3
    max_branch_share: float = 0.5
    min_run: int = 2
    version: str = "confidence-v1"


def confidence_label(breadth: DataFrame, runs: DataFrame, keys: Sequence[str] = THEME_KEYS, policy: ConfidencePolicy = ConfidencePolicy()) -> DataFrame:
    """high / medium / low from volume, breadth, concentration and persistence; the weakest check decides."""
    joined = breadth.join(runs, list(keys))
    broad = (F.col("branches") >= policy.min_branches) & (F.col("largest_branch_share") <= policy.max_branch_share)
    lasting = F.col("longest_run") >= policy.min_run
    label = (
        F.when((F.col("mentions") >= policy.high_mentions) & broad & lasting, "high")
        .when((F.col("mentions") >= policy.medium_mentions) & (broad | lasting), "medium").otherwise("low"))
    return joined.withColumn("confidence", label).withColumn("method_version", F.lit(policy.version))


# --- claims ---------------------------------------------------------------------------------------------

def claims(trends: DataFrame, method_version: str) -> DataFrame:
    """One publishable claim per trend row: id, numbers, grade and its JSON object."""
    claim_id = F.concat_ws("-", F.lit("CLM"), F.upper("theme"), F.upper("brand_name"))
    side = lambda p: F.struct(
        F.col(f"{p}_matches").alias("matches"), F.col(f"{p}_text_reviews").alias("text_reviews"),
        F.round(f"{p}_per_1000", 2).alias("rate_per_1000"))
    numbers = F.array(*[F.col(c).cast("string") for c in (
        "early_matches", "recent_matches", "early_text_reviews", "recent_text_reviews")])
    direction = F.when(F.col("absolute_change_per_1000") > 0, "up").when(F.col("absolute_change_per_1000") < 0, "down").otherwise("flat")
    body = F.struct(
        claim_id.alias("claim_id"), F.lit("aspect_trend").alias("claim_type"), F.col("brand_name").alias("subject_brand"),
        F.col("theme").alias("metric_definition"), F.struct(side("early").alias("early"), side("recent").alias("recent")).alias("periods"),
        F.round("relative_change_percent", 2).alias("relative_change_percent"), F.col("evidence_grade").alias("confidence"),
        F.lit(method_version).alias("method_version"))
    return trends.select(
        claim_id.alias("claim_id"), "brand_name", "theme", "evidence_grade", "absolute_change_per_1000",
        direction.alias("direction"), numbers.alias("numbers"), F.to_json(body).alias("claim_json"))


CAUSAL_VERBS = "(?i)\\b(?:caused|fixed|drove|because of|led to)\\b"  # fixed values
RISING, FALLING = "(?i)\\b(?:rose|increased|doubled|up)\\b", "(?i)\\b(?:fell|decreased|halved|down)\\b"


def narrative_violations(sentences: DataFrame, claim_rows: DataFrame) -> DataFrame:
    """(sentence_id, violation) for sentences their cited claim does not back.

    unbound: cites no known claim. causal_verb: states a cause. unsupported_number: a number
    the claim does not hold. wrong_brand: the claim's brand is not named. wrong_direction:
    the wording contradicts the claim's direction.
    """
    known = claim_rows.select("claim_id", "numbers", "brand_name", "direction", F.lit(True).alias("__known"))
    joined = sentences.join(known, "claim_id", "left")
    text = F.col("sentence")
    strange = F.array_except(F.regexp_extract_all(text, F.lit("\\b\\d+(?:\\.\\d+)?\\b"), 0), F.col("numbers"))
    bound = F.col("__known").isNotNull()
    found = F.filter(F.array(
        F.when(~bound, "unbound"),
        F.when(text.rlike(CAUSAL_VERBS), "causal_verb"),
        F.when(bound & (F.size(strange) > 0), "unsupported_number"),
        F.when(bound & ~F.contains(text, F.col("brand_name")), "wrong_brand"),
        F.when(bound & ((text.rlike(RISING) & (F.col("direction") != "up")) | (text.rlike(FALLING) & (F.col("direction") != "down"))),
               "wrong_direction"),
    ), lambda v: v.isNotNull())
    return joined.select("sentence_id", F.explode(found).alias("violation"))


def ranked_claims(claim_rows: DataFrame, snapshot: Mapping[str, str]) -> DataFrame:
    """Eligible claims in a total order, each carrying the frozen snapshot's id.

    There are as many claims as brands times themes, so one ordering window suffices. It orders by the change worked out
    from the counts in whole numbers (units of 1e-12): equal changes are equal, where doubles differ in their last digits,
    and go by claim id.
    """
    early, recent, early_texts, recent_texts = (F.col("numbers")[i].cast("decimal(18,0)") for i in range(4))
    counted = claim_rows.where(F.col("evidence_grade") != "insufficient").withColumns({
        "__em": early, "__rm": recent, "__et": F.greatest(early_texts, F.lit(1)), "__rt": F.greatest(recent_texts, F.lit(1))})
    exact = F.expr("1000000000000000 * (__rm * __et - __em * __rt) div (__et * __rt)")
    w = W.orderBy(F.desc("__change"), "claim_id")
    frozen = fingerprint({k: F.lit(v) for k, v in snapshot.items()})
    return counted.withColumn("__change", exact).select(
        "claim_id", "evidence_grade", "absolute_change_per_1000", F.row_number().over(w).alias("place"),
        frozen.alias("snapshot_id"))
