"""Listing intelligence: text clean-up, risk signals, category matching, review capacity.

These operators follow a written design without reference code, so each docstring
states the exact definition used here.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import stable_key
from ..functions.stats import ratio
from ..functions.text import language_tag, nfkc, normalize_text
from ..session import cut_lineage, spread
from .distributed import exact_quantiles, first_n_per_group, lookup, lookup_parent, running_total
from .similarity import SimilarityPolicy, similar_groups

UNKNOWN = "UNKNOWN"

# --- fixed values: review segments and their share of the monthly capacity ---------------------
CAPACITY_SHARE = 0.05
SEGMENT_SHARES = {"prohibited_gray_zone": 70, "adversarial": 20, "unknown_category": 1, "audit": 9}
# -----------------------------------------------------------------------------------------------

ZERO_WIDTH = "[\\u200B-\\u200F\\u202A-\\u202E\\u2060\\uFEFF]"
LEET_FROM, LEET_TO = "01345$@", "oieassa"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


# --- text ----------------------------------------------------------------------------------------

def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags removed, common entities decoded."""
    bare = F.regexp_replace(html, "(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, "(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, "\\s+", " "))


def clean_text(text: Column) -> Column:
    """Compatibility form without invisible characters, repeated punctuation or loose spaces."""
    bare = F.regexp_replace(nfkc(text), ZERO_WIDTH, "")
    bare = F.regexp_replace(bare, "([!?.,;:*#%_~-])\\1+", "$1")
    return F.trim(F.regexp_replace(bare, "(?U)\\s+", " "))


def with_clean_text(df: DataFrame, column: str = "text") -> DataFrame:
    """The original stays beside its clean copy and language."""
    return df.withColumn("clean_text", clean_text(F.col(column))).withColumn(
        "language", language_tag(F.col("clean_text")))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: F.length(w) > 0)


def obfuscation_flags(text: Column, watched: Sequence[str]) -> Column:
    """struct(leetspeak, mixed_script, separated_letters).

    leetspeak: a watched term appears only after digits and signs are read as letters.
    mixed_script: Latin next to Cyrillic, Greek or Arabic inside one word.
    separated_letters: four or more single letters in a row, one space between each.
    """
    low = F.lower(text)
    read = F.translate(low, LEET_FROM, LEET_TO)
    leet = reduce(lambda a, b: a | b, [read.contains(t) & ~low.contains(t) for t in watched])
    other = "\\u0370-\\u03FF\\u0400-\\u04FF\\u0600-\\u06FF"
    return F.struct(
        leet.alias("leetspeak"),
        text.rlike(f"[A-Za-z][{other}]|[{other}][A-Za-z]").alias("mixed_script"),
        text.rlike("(?:^|[^A-Za-z])(?:[A-Za-z] ){3,}[A-Za-z](?:[^A-Za-z]|$)").alias("separated_letters"),
    )


def reason_codes(text: Column, rules: Mapping[str, str]) -> Column:
    """Sorted codes of the policy rules (code -> pattern) that match; never a decision."""
    hits = F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(code)) for code, p in sorted(rules.items())])
    return F.filter(hits, lambda c: c.isNotNull())


def fuzzy_terms(df: DataFrame, key: str, text: str, terms: Sequence[str], max_distance: int = 1) -> DataFrame:
    """(key, term, token, distance) for tokens within an edit distance of a watched term.

    Distances are computed once per distinct word of the vocabulary. Words and terms meet by
    length, which an edit changes by one at most, so no watched term is missed. Exact
    occurrences have distance 0.
    """
    spark = df.sparkSession
    tokens = spread(df.select(key, text)).select(key, F.explode(F.array_distinct(words(F.col(text)))).alias("token"))
    blocks = spark.createDataFrame(
        [(t, n) for t in terms for n in range(max(1, len(t) - max_distance), len(t) + max_distance + 1)],
        "term string, size int")
    vocabulary = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("uses")).withColumn("size", F.length("token"))
    close = (
        vocabulary.join(F.broadcast(blocks), "size")  # as many rows as configured terms
        .withColumn("distance", F.levenshtein("token", "term")).where(F.col("distance") <= max_distance)
        .groupBy("token").agg(F.max("uses").alias("uses"), F.collect_list(F.struct("term", "distance")).alias("near"))
    )  # a word is near at most as many terms as there are
    hits = lookup(tokens, close, "token", "uses").select(key, "token", F.explode("near").alias("n"))
    return hits.select(key, "n.term", "token", "n.distance")


def consistency(left: Column, right: Column) -> Column:
    """Jaccard overlap of the word sets of two fields; null when both are empty."""
    a, b = F.array_distinct(words(left)), F.array_distinct(words(right))
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def brand_lookup(listings: DataFrame, registry: DataFrame, brand: str = "brand") -> DataFrame:
    """Adds brand_signal: registered, unregistered or no_brand. A weak signal only. Missing and frequent brands stay spread."""
    known = registry.select(F.col("brand_name").alias(brand)).distinct().withColumn("__known", F.lit(True))
    joined = lookup_parent(listings, known, brand, "left")
    return joined.withColumn(
        "brand_signal", F.when(F.col(brand).isNull(), "no_brand").when(F.col("__known"), "registered")
        .otherwise("unregistered")).drop("__known")


def injection_flag(text: Column) -> Column:
    """Monitored only: text that tries to instruct the system. Nothing decides on it."""
    return text.rlike(
        "(?i)(?:ignore|disregard|forget)\\s+(?:all\\s+|the\\s+|any\\s+|previous\\s+)*(?:rules?|instructions?|prompts?)"
        "|(?i)approve\\s+this\\s+(?:item|listing)|(?i)system\\s+prompt")


def unsupported_facts(description: Column, source: Column) -> Column:
    """Numbers of a description that do not occur in its source, each once, sorted."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit("\\d+(?:\\.\\d+)?"), 0)
    return F.sort_array(F.array_except(numbers(description), numbers(source)))


# --- risk and publication ---------------------------------------------------------------------------

@dataclass(frozen=True)
class RiskPolicy:
    """Versioned consolidation thresholds."""

    restricted_codes: tuple[str, ...] = ("RESTRICTED_TERM",)
    counterfeit_codes: tuple[str, ...] = ("REPLICA_TERM", "BRAND_MISSPELLING")
    vision_high: float = 0.9
    vision_medium: float = 0.5
    min_consistency: float = 0.1
    version: str = "risk-v1"


def consolidate(signals: DataFrame, policy: RiskPolicy = RiskPolicy()) -> DataFrame:
    """Adds risk (NONE, RESTRICTED, COUNTERFEIT), confirmed, suspicious and checks_complete.

    Needs codes (array), vision_score, consistency and brand_signal. A rule code sets the
    risk class; it is confirmed only with high vision evidence as well. A model score alone
    makes a listing suspicious, never confirmed. A missing score means the check is missing.
    """
    has = lambda codes: F.arrays_overlap("codes", F.array(*[F.lit(c) for c in codes]))
    complete = F.col("codes").isNotNull() & F.col("vision_score").isNotNull() & F.col("consistency").isNotNull()
    risk = (
        F.when(has(policy.restricted_codes), "RESTRICTED").when(has(policy.counterfeit_codes), "COUNTERFEIT")
        .otherwise("NONE")
    )
    suspicious = (
        (F.col("vision_score") >= policy.vision_medium) | (F.col("consistency") < policy.min_consistency)
        | (F.col("brand_signal") == "unregistered")
    )
    return signals.withColumns({
        "checks_complete": complete,
        "risk": F.coalesce(risk, F.lit("NONE")),
        "suspicious": F.coalesce(suspicious, F.lit(False)),
    }).withColumn(
        "confirmed", F.coalesce((F.col("risk") != "NONE") & (F.col("vision_score") >= policy.vision_high), F.lit(False))
    ).withColumn("policy_version", F.lit(policy.version))


def publication_action(confirmed: Column, complete: Column, risk: Column, suspicious: Column) -> Column:
    """reject when confirmed, hold when a check is missing or doubt remains, else publish.

    Category and queue capacity play no part."""
    return (
        F.when(~complete, "hold").when(confirmed, "reject").when((risk != "NONE") | suspicious, "hold")
        .otherwise("publish")
    )


def audit_record(decided: DataFrame, key: str, raw: str, versions: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """What is needed to reproduce a decision: input hashes, versions, signals, outcome."""
    return decided.select(
        key, F.sha2(raw, 256).alias("raw_sha256"), F.sha2(clean_text(F.col(raw)), 256).alias("normalized_sha256"),
        *[F.lit(v).alias(f"{k}_version") for k, v in sorted(versions.items())], *keep)


# --- categories ----------------------------------------------------------------------------------------

@dataclass(frozen=True)
class MatchPolicy:
    min_similarity: float = 0.5
    min_margin: float = 0.05
    max_cells: int = 4_000_000  # category vectors held by one task at a time, in numbers
    version: str = "taxonomy-v1"


def _blocks(categories: DataFrame, policy: MatchPolicy) -> Iterator[tuple[list, np.ndarray, list]]:
    """Category vectors in blocks of bounded size, fetched one after the other.

    A taxonomy is a curated table of some hundred rows, so there is one block; a larger
    one is matched in as many passes as it has blocks, each holding one block only.
    """
    width, count = categories.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    if not count:
        raise ValueError("no categories")
    n_blocks = -(-count * width // policy.max_cells)
    for block in range(n_blocks):
        mine = categories.where(F.pmod(F.xxhash64("category_id"), F.lit(n_blocks)) == block)
        rows = sorted(mine.collect(), key=lambda r: r.category_id)
        if rows:
            matrix = np.array([r.vector for r in rows], dtype="float64")
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            parents = [r["parent_id"] if "parent_id" in categories.columns else None for r in rows]
            yield [r.category_id for r in rows], matrix / np.where(norms == 0, 1, norms), parents


def _score_block(listings: DataFrame, key: str, ids: list, matrix: np.ndarray, parents: list, scope: str | None) -> DataFrame:
    spark = listings.sparkSession
    shared = spark.sparkContext.broadcast((ids, matrix, np.array([str(p) for p in parents])))
    key_type = listings.schema[key].dataType.simpleString()
    columns = [key, "vector"] + ([scope] if scope else [])

    def best_two(frames):
        names, cats, owners = shared.value
        for frame in frames:
            if not len(frame):
                continue
            x = np.array(frame["vector"].tolist(), dtype="float64")
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            sims = (x / np.where(norm == 0, 1, norm)) @ cats.T
            if scope:
                outside = frame[scope].astype(str).to_numpy()[:, None] != owners[None, :]
                sims = np.where(outside, -np.inf, sims)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :2]
            for rank in range(order.shape[1]):
                picked = order[:, rank]
                value = sims[np.arange(len(x)), picked]
                fit = np.isfinite(value)
                yield pd.DataFrame({
                    key: frame[key][fit], "category_id": [names[i] for i in picked[fit]], "similarity": value[fit]})

    return listings.select(*columns).mapInPandas(best_two, f"{key} {key_type}, category_id string, similarity double")


def match_categories(
    listings: DataFrame, categories: DataFrame, key: str = "listing_id", policy: MatchPolicy = MatchPolicy(),
    scope: str | None = None,
) -> DataFrame:
    """(key, top1, top1_similarity, top2_similarity, margin, category).

    Listings and categories carry ``vector``. The category is UNKNOWN unless the best
    cosine reaches the threshold and leads the second by the margin; a category may bring
    its own ``min_similarity``. ``scope`` restricts each listing to categories whose
    parent_id equals that column. Ties fall to the smaller category id.
    """
    categories = categories.withColumn("category_id", F.col("category_id").cast("string"))
    partial = reduce(DataFrame.unionByName, [
        _score_block(listings, key, ids, matrix, parents, scope) for ids, matrix, parents in _blocks(categories, policy)])
    # At most two rows per listing and block meet here.
    order = F.struct((-F.col("similarity")).alias("s"), F.col("category_id").alias("c"))
    best = partial.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(order)), 1, 2).alias("b"))
    top = best.select(
        key, F.col("b")[0]["c"].alias("top1"), (-F.col("b")[0]["s"]).alias("top1_similarity"),
        (-F.try_element_at("b", F.lit(2))["s"]).alias("top2_similarity"))
    margin = F.col("top1_similarity") - F.coalesce("top2_similarity", F.lit(-1.0))
    floor = F.lit(policy.min_similarity)
    if "min_similarity" in categories.columns:
        own = categories.select(F.col("category_id").alias("top1"), F.col("min_similarity").alias("__own"))
        top = top.join(own, "top1", "left")
        floor = F.coalesce(F.col("__own"), floor)
    fits = (F.col("top1_similarity") >= floor) & (margin >= policy.min_margin)
    return listings.select(key).join(top, key, "left").select(
        key, "top1", "top1_similarity", "top2_similarity", margin.alias("margin"),
        F.when(fits, F.col("top1")).otherwise(UNKNOWN).alias("category"),
        F.lit(policy.version).alias("taxonomy_version"))


def match_hierarchy(
    listings: DataFrame, departments: DataFrame, leaves: DataFrame, key: str = "listing_id",
    policy: MatchPolicy = MatchPolicy(),
) -> DataFrame:
    """Nearest department first, then the leaves of that department only."""
    broad = match_categories(listings, departments, key, MatchPolicy(-1.0, 0.0, policy.max_cells, policy.version))
    scoped = listings.join(broad.select(key, F.col("top1").alias("department")), key)
    matched = match_categories(scoped, leaves, key, policy, scope="department")
    return matched.join(broad.select(key, F.col("top1").alias("department")), key)


def reclassify_unknown(
    matches: DataFrame, listings: DataFrame, categories: DataFrame, key: str, policy: MatchPolicy
) -> DataFrame:
    """Only UNKNOWN listings are matched again, against the new taxonomy version."""
    unknown = matches.where(F.col("category") == UNKNOWN).select(key)
    again = match_categories(listings.join(unknown, key, "left_semi"), categories, key, policy)
    return matches.where(F.col("category") != UNKNOWN).unionByName(again)


# --- unknown pool ----------------------------------------------------------------------------------------

def word_fingerprint(found: Column) -> Column:
    """128 bits of the sorted distinct words; order and repetition vanish."""
    return F.unhex(F.substring(F.sha2(F.array_join(F.sort_array(F.array_distinct(found)), " "), 256), 1, 32))


def near_duplicates(listings: DataFrame, key: str, text: str, policy: SimilarityPolicy = SimilarityPolicy()) -> DataFrame:
    """(key, representative, copies): groups of near-duplicate listings, each represented by its smallest id.

    Two listings are near duplicates when they have the same words in any order, or when the sets of their five-word shingles
    have a Jaccard similarity of ``policy.percent`` or more (listings of fewer words: the set of their words); a group holds all
    that are connected by such pairs. Listings without words are copies of each other.
    """
    split = spread(listings.select(key, text)).select(key, words(normalize_text(F.coalesce(F.col(text), F.lit("")))).alias("__words"))
    found = similar_groups(split, F.col("__words"), word_fingerprint(F.col("__words")), policy)
    grouped = cut_lineage(found.select(key, "__group"))
    groups = grouped.groupBy("__group").agg(F.min(key).alias("representative"), F.count(F.lit(1)).alias("copies"))
    return lookup(grouped, groups, "__group", "copies").select(key, "representative", "copies")


def cluster(vectors: DataFrame, key: str, k: int, seed: int = 17, max_iter: int = 20) -> DataFrame:
    """(key, cluster, distance to its centre) by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select(key, array_to_vector(F.col("vector")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, initMode="k-means||").fit(data)
    centres = vectors.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    gap = F.sqrt(F.aggregate(
        F.zip_with("vector", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    placed = model.setPredictionCol("cluster").transform(
        vectors.select(key, "vector", array_to_vector(F.col("vector")).alias("features"))).drop("features")
    return placed.join(F.broadcast(centres), "cluster").select(key, "cluster", gap.alias("distance"))  # k rows


def cluster_report(
    members: DataFrame, key: str, seller: str, early: Column, min_size: int, min_growth: float, representatives: int = 3
) -> tuple[DataFrame, DataFrame]:
    """(cluster summary, representatives). ``early`` tells the first period from the second.

    A cluster is a candidate when it has the minimum size, more than one seller and grew
    by the given factor. Representatives are the members nearest to the centre.
    """
    sizes = members.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(early).alias("early"), F.count_if(~early).alias("recent"))
    sellers = members.select("cluster", seller).distinct().groupBy("cluster").agg(F.count(seller).alias("sellers"))
    growth = F.try_divide("recent", "early")
    summary = sizes.join(sellers, "cluster").withColumn("growth", growth).withColumn(
        "candidate", (F.col("size") >= min_size) & (F.col("sellers") > 1)
        & (F.coalesce(F.col("growth") >= min_growth, F.col("recent") > 0)))
    nearest = first_n_per_group(members, ["cluster"], [F.col("distance"), F.col(key)], representatives)
    return summary, nearest.select("cluster", "rank", key, "distance")


# --- review capacity ---------------------------------------------------------------------------------------

@dataclass(frozen=True)
class ReviewPlan:
    capacity: int
    shares: Mapping[str, int] = field(default_factory=lambda: dict(SEGMENT_SHARES))
    emergency: str = "emergency"


def segment_quotas(queue: DataFrame, plan: ReviewPlan) -> DataFrame:
    """(segment, waiting, quota): emergencies first, then shares, then what others left over.

    Each segment gets its share of the capacity after emergencies. Unused places go to
    the segments that still have more waiting, in proportion to how much. Fractions of a
    place go to the largest remainders (ties to the first segment by name), so the
    quotas always add up to the capacity or to all that wait.
    """
    spark = queue.sparkSession
    shares = spark.createDataFrame(
        [(s, int(n)) for s, n in plan.shares.items()] + [(plan.emergency, 0)], "segment string, share int")
    waiting = queue.groupBy("segment").agg(F.count(F.lit(1)).alias("waiting"))
    base = shares.join(waiting, "segment", "left").fillna(0, ["waiting"])
    all_segments = W.partitionBy(F.lit(0))  # one row per configured segment
    urgent = F.when(F.col("segment") == plan.emergency, F.least(F.col("waiting"), F.lit(plan.capacity))).otherwise(0)
    base = base.withColumn("__urgent", urgent).withColumn("__left", F.lit(plan.capacity) - F.sum("__urgent").over(all_segments))

    def apportion(frame: DataFrame, places: str, weight: str, out: str) -> DataFrame:
        # Whole numbers throughout; a product of two counts may need more than 64 bits.
        wide = frame.withColumn("__p", F.col(places).cast("decimal(19,0)") * F.col(weight).cast("decimal(19,0)")).withColumn(
            "__sum", F.greatest(F.sum(weight).over(all_segments), F.lit(1)).cast("decimal(19,0)"))
        wide = wide.withColumn("__floor", F.expr("__p div __sum")).withColumn("__rest", F.expr("__p % __sum"))
        wide = wide.withColumn("__over", F.expr(f"if(sum({weight}) over (partition by 0) > 0, {places}, 0)") - F.sum("__floor").over(all_segments))
        rank = F.row_number().over(all_segments.orderBy(F.desc("__rest"), "segment"))
        return wide.withColumn(out, F.col("__floor") + (rank <= F.col("__over")).cast("long")).drop("__p", "__sum", "__floor", "__rest", "__over")

    base = apportion(base, "__left", "share", "__first")
    base = base.withColumn("__used", F.when(F.col("segment") == plan.emergency, 0).otherwise(F.least("__first", "waiting")))
    base = base.withColumn("__excess", F.when(F.col("segment") == plan.emergency, 0).otherwise(F.col("waiting") - F.col("__used")))
    base = base.withColumn("__free", F.least(
        F.sum(F.col("__first") - F.col("__used")).over(all_segments), F.sum("__excess").over(all_segments)))
    base = apportion(base, "__free", "__excess", "__more")
    return base.select("segment", "waiting", (F.col("__urgent") + F.col("__used") + F.col("__more")).cast("long").alias("quota"))


def queue_levels(arrival: str = "arrival") -> dict[str, Column]:
    return {"__band": F.col("band"), "__month": F.date_trunc("month", arrival), "__hour": F.date_trunc("hour", arrival)}


def queue_positions(queue: DataFrame, key: str, arrival: str = "arrival", by_segment: bool = True) -> DataFrame:
    """1-based place in line: band first (0 is most urgent), then arrival, then id."""
    placed = running_total(
        queue, ["segment"] if by_segment else [], queue_levels(arrival), [arrival, key], F.lit(1).cast("long"), "__before")
    return placed.withColumn("place", F.col("__before") + 1).drop("__before")


def allocate_reviews(queue: DataFrame, plan: ReviewPlan, key: str, arrival: str = "arrival") -> DataFrame:
    """The listings reviewed this period; needs segment, band and arrival."""
    return queue_positions(queue, key, arrival).join(segment_quotas(queue, plan), "segment").where(
        F.col("place") <= F.col("quota")).drop("waiting", "quota")


def audit_sample(published: DataFrame, stratum: str, key: str, per_stratum: int, seed: int = 7) -> DataFrame:
    """A reproducible random audit of approved listings: the first by hash in every stratum."""
    order = stable_key(F.lit(seed), F.col(stratum), F.col(key))
    return first_n_per_group(published.withColumn("__k", order), [stratum], [F.col("__k"), F.col(key)], per_stratum).drop("__k")


# --- monitoring ------------------------------------------------------------------------------------------------

def daily_monitoring(scored: DataFrame, segment: str, low_confidence: float) -> DataFrame:
    """Per segment and day: volume, UNKNOWN rate, low-confidence rate, mean similarity and margin."""
    return scored.groupBy(segment, F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("listings"),
        (F.count_if(F.col("category") == UNKNOWN) / F.count(F.lit(1))).alias("unknown_rate"),
        (F.count_if(F.col("top1_similarity") < low_confidence) / F.count(F.lit(1))).alias("low_confidence_rate"),
        F.avg("top1_similarity").alias("mean_similarity"), F.avg("margin").alias("mean_margin"))


def with_alerts(daily: DataFrame, segment: str, measure: str, trailing: int = 7, factor: float = 1.5) -> DataFrame:
    """Baseline = mean of the previous ``trailing`` days of the segment; alert above factor x baseline."""
    w = W.partitionBy(segment).orderBy("day").rowsBetween(-trailing, -1)  # a row per day
    base = daily.withColumn("baseline", F.avg(measure).over(w))
    return base.withColumn("alert", F.coalesce(F.col(measure) > F.col("baseline") * factor, F.lit(False)))


def embedding_shift(vectors: DataFrame, period: Column) -> DataFrame:
    """Per dimension: mean in both periods and the difference; one aggregation of the items."""
    items = vectors.select(period.alias("period"), F.posexplode("vector").alias("dimension", "x"))
    means = items.groupBy("dimension").agg(
        F.avg(F.when(F.col("period") == "early", F.col("x"))).alias("early_mean"),
        F.avg(F.when(F.col("period") == "recent", F.col("x"))).alias("recent_mean"))
    return means.withColumn("shift", F.col("recent_mean") - F.col("early_mean"))


def safety_metrics(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per class: recall, false-positive rate, review yield, appeal overturn rate, overrides.

    Needs booleans prohibited, flagged, reviewed, actioned, appealed, overturned, overridden.
    """
    n = lambda cond: F.count_if(cond)
    c = F.col
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("listings"),
        ratio(n(c("prohibited") & c("flagged")), n(c("prohibited"))).alias("recall"),
        ratio(n(~c("prohibited") & c("flagged")), n(~c("prohibited"))).alias("false_positive_rate"),
        ratio(n(c("reviewed") & c("actioned")), n(c("reviewed"))).alias("review_yield"),
        ratio(n(c("appealed") & c("overturned")), n(c("appealed"))).alias("overturn_rate"),
        ratio(n(c("overridden")), F.count(F.lit(1))).alias("override_rate"),
        ratio(n(c("reviewed")), F.count(F.lit(1))).alias("reviewed_share"))


def latency(measured: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return exact_quantiles(measured, keys, value, {"p50": 0.5, "p95": 0.95})
