"""Review benchmarking over events (ratings, reviewers) and documents (text)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicon import THEMES, Theme
from ..functions.text import normalize_term
from ..operators import reviews as rv
from ..sources.tables import brands_of, document_reviews, event_reviews
from .display import rounded
from .registry import query

EVENT_CTE = """
ev AS (SELECT event_id AS review_id, event_type AS brand, (props::JSON->>'k')::INT AS branch, user_id AS reviewer,
              least(5, floor(value / 30)::INT + 1) AS stars, ts, value,
              CASE WHEN value > 100 THEN 'thanks' END AS response FROM events)"""

HALVES = """
span AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM {t}),
half AS (SELECT t.*, CASE WHEN epoch_us(ts) < (SELECT lo + (hi - lo) // 2 FROM span) THEN 'early' ELSE 'recent' END AS period FROM {t} t)"""

DOC_CTE = """
docs AS (SELECT d.doc_id AS review_id, source AS brand, d.doc_id % 7 AS branch, d.doc_id % 50 AS reviewer, lang, text,
                CASE quality WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 3 END AS stars,
                trim(regexp_replace(lower(nfc_normalize(text)), '\\s+', ' ', 'g')) AS norm,
                make_timestamp((1700000000 + d.doc_id * 3600) * 1000000) AS ts
         FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def theme_sql(theme) -> str:
    found = " OR ".join(f"contains(norm, '{normalize_term(t)}')" for t in theme.terms)
    return f"(({found}) AND stars <= 3)" if theme.low_rating_only else f"({found})"


def theme_rows(themes) -> str:
    return " UNION ALL ".join(
        f"SELECT *, '{t.name}' AS theme, {i} AS theme_order, {theme_sql(t)} AS hit FROM half" for i, t in enumerate(themes))


THEME_ROWS = theme_rows(THEMES)
# The generated texts hardly use review words, so a second lexicon has fragments they do use.
TEXT_THEMES = (
    Theme("wait_time_complaint", True, ("thou", "ering")),
    Theme("service_complaint", True, ("ther", "aient")),
    Theme("loyalty_program_mention", False, ("onne", "que")),
)


def wilson_sql(m: str, n: str, sign: str) -> str:
    z2 = 1.96 * 1.96
    p = f"({m} / nullif({n}, 0)::DOUBLE)"
    body = (f"(({p} + {z2} / (2 * {n})) {sign} 1.96 * sqrt({p} * (1 - {p}) / {n} + {z2} / (4.0 * {n} * {n}))) "
            f"/ (1 + {z2} / {n})")
    clamp = f"greatest(0.0, {body})" if sign == "-" else f"least(1.0, {body})"
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE {clamp} END"


def trend_cte(themes) -> str:
    return f"""
{DOC_CTE}, {HALVES.format(t='docs')},
themed AS ({theme_rows(themes)}),
counts AS (
  SELECT brand, theme, theme_order,
         count_if(period = 'early' AND norm <> '')::BIGINT AS et, count_if(period = 'recent' AND norm <> '')::BIGINT AS rt,
         count_if(period = 'early' AND hit)::BIGINT AS em, count_if(period = 'recent' AND hit)::BIGINT AS rm
  FROM themed GROUP BY brand, theme, theme_order),
rates AS (
  SELECT *, CASE WHEN et = 0 THEN 0.0 ELSE 1000.0 * em / et END AS er, CASE WHEN rt = 0 THEN 0.0 ELSE 1000.0 * rm / rt END AS rr,
         CASE WHEN em + rm >= 20 AND least(em, rm) >= 5 THEN 'eligible' WHEN em + rm >= 10 THEN 'directional'
              ELSE 'insufficient' END AS grade
  FROM counts)"""


TREND_CTE = trend_cte(THEMES)
TEXT_TREND_CTE = trend_cte(TEXT_THEMES)


@query("brand_profile", f"""
WITH {EVENT_CTE}
SELECT brand AS brand_name, count(*) AS unique_reviews, strftime(min(ts), '%Y-%m-%d') AS first_date,
       strftime(max(ts), '%Y-%m-%d') AS last_date, round(avg(stars), 6) AS mean_stars, 0::BIGINT AS reviews_with_text,
       count(response) AS owner_responses, count(DISTINCT reviewer) AS reviewers, count(DISTINCT branch) AS reviewed_branches
FROM ev GROUP BY brand""")
def brand_profile(spark, folder):
    return rounded(rv.brand_profile(event_reviews(spark, folder)))


@query("reviewer_activity", f"""
WITH {EVENT_CTE}
SELECT reviewer AS reviewer_id, brand AS brand_name, count(*) AS review_count,
       epoch_us(min(ts)) AS first_review_us, epoch_us(max(ts)) AS last_review_us FROM ev GROUP BY ALL""")
def reviewer_activity(spark, folder):
    return rv.reviewer_activity(event_reviews(spark, folder)).select(
        "reviewer_id", "brand_name", "review_count",
        F.unix_micros("first_review_at").alias("first_review_us"),
        F.unix_micros("last_review_at").alias("last_review_us"),
    )


@query("midpoint_trends", f"""
WITH {EVENT_CTE}, {HALVES.format(t='ev')}
SELECT brand AS brand_name, period, count(*) AS reviews, epoch_us(min(ts)) AS first_us FROM half GROUP BY ALL""")
def midpoint_trends(spark, folder):
    r = event_reviews(spark, folder)
    return r.groupBy("brand_name", rv.analysis_window(r).period().alias("period")).agg(
        F.count(F.lit(1)).alias("reviews"), F.unix_micros(F.min("published_at")).alias("first_us"))


def _mean_sql(p: str) -> str:
    s = f"CASE WHEN period = '{p}' THEN stars END"
    half_width = f"1.96 * stddev_samp({s}) / sqrt(count({s}))"
    return (f"count({s}) AS {p}_n, round(avg({s}), 6) AS {p}_mean_stars, "
            f"round(coalesce(avg({s}) - {half_width}, avg({s})), 6) AS {p}_ci_low, "
            f"round(coalesce(avg({s}) + {half_width}, avg({s})), 6) AS {p}_ci_high")


@query("period_rating_trends", f"""
WITH {EVENT_CTE}, {HALVES.format(t='ev')}
SELECT brand AS brand_name, {_mean_sql('early')}, {_mean_sql('recent')},
       round(avg(CASE WHEN period = 'recent' THEN stars END) - avg(CASE WHEN period = 'early' THEN stars END), 6) AS change_stars
FROM half GROUP BY brand""")
def period_rating_trends(spark, folder):
    r = event_reviews(spark, folder)
    return rounded(rv.period_rating_trends(r, rv.analysis_window(r)))


def _trends(spark, folder, themes=THEMES):
    r = document_reviews(spark, folder)
    return r, rv.theme_trends(r, rv.analysis_window(r), themes)


TREND_SELECT = f"""
SELECT brand AS brand_name, theme, theme_order, et AS early_text_reviews, rt AS recent_text_reviews,
       em AS early_matches, rm AS recent_matches, round(er, 6) AS early_per_1000, round(rr, 6) AS recent_per_1000,
       round(1000 * ({wilson_sql('em', 'et', '-')}), 6) AS early_ci_low_per_1000,
       round(1000 * ({wilson_sql('em', 'et', '+')}), 6) AS early_ci_high_per_1000,
       round(1000 * ({wilson_sql('rm', 'rt', '-')}), 6) AS recent_ci_low_per_1000,
       round(1000 * ({wilson_sql('rm', 'rt', '+')}), 6) AS recent_ci_high_per_1000,
       round(rr - er, 6) AS absolute_change_per_1000,
       round(CASE WHEN er > 0 THEN 100.0 * (rr / er - 1) END, 6) AS relative_change_percent, grade AS evidence_grade
FROM rates"""


@query("theme_trends", f"WITH {TREND_CTE} {TREND_SELECT}")
def theme_trends(spark, folder):
    return rounded(_trends(spark, folder)[1])


@query("theme_trends_text_lexicon", f"WITH {TEXT_TREND_CTE} {TREND_SELECT}")
def theme_trends_text_lexicon(spark, folder):
    return rounded(_trends(spark, folder, TEXT_THEMES)[1])


@query("theme_evidence", f"""
WITH {DOC_CTE}, {HALVES.format(t='docs')}, themed AS ({THEME_ROWS})
SELECT brand AS brand_name, theme, period, review_id FROM themed WHERE hit""")
def theme_evidence(spark, folder):
    r = document_reviews(spark, folder)
    return rv.theme_evidence(r, rv.analysis_window(r)).drop("published_at")


@query("evidence_sample", f"""
WITH {DOC_CTE}, {HALVES.format(t='docs')}, themed AS ({THEME_ROWS}),
numbered AS (SELECT brand, theme, period, review_id,
                    row_number() OVER (PARTITION BY brand, theme ORDER BY period, ts, review_id) AS position
             FROM themed WHERE hit)
SELECT brand AS brand_name, theme, position::INT AS position, period, review_id FROM numbered WHERE position <= 8""")
def evidence_sample(spark, folder):
    r = document_reviews(spark, folder)
    return rv.evidence_sample(rv.theme_evidence(r, rv.analysis_window(r)), 8)


COMPLAINT_LIST = ", ".join(f"'{t.name}'" for t in THEMES if t.low_rating_only)


FASTEST = f""",
best AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY rr - er DESC, theme_order) AS r
         FROM rates WHERE grade = 'eligible' AND theme IN ({COMPLAINT_LIST}))
SELECT b.brand AS brand_name, theme, CASE WHEN theme IS NULL THEN 'No eligible complaint theme' ELSE 'eligible' END AS status,
       em::DOUBLE AS early_matches, rm::DOUBLE AS recent_matches, round(er, 6) AS early_per_1000, round(rr, 6) AS recent_per_1000,
       round(rr - er, 6) AS absolute_change_per_1000
FROM (SELECT DISTINCT brand FROM rates) b LEFT JOIN (SELECT * FROM best WHERE r = 1) w ON b.brand = w.brand"""


def _fastest(trends):
    """Brands without an eligible theme have no counts; doubles say that alike in every engine."""
    found = rv.fastest_growing_complaints(trends)
    return rounded(found.withColumns({c: F.col(c).cast("double") for c in ("early_matches", "recent_matches")}))


@query("fastest_growing", f"WITH {TREND_CTE} {FASTEST}")
def fastest_growing(spark, folder):
    return _fastest(_trends(spark, folder)[1])


@query("fastest_growing_text_lexicon", f"WITH {TEXT_TREND_CTE} {FASTEST}")
def fastest_growing_text_lexicon(spark, folder):
    return _fastest(_trends(spark, folder, TEXT_THEMES)[1])


@query("selected_themes", f"""
WITH {TREND_CTE}
SELECT theme, sum(em)::BIGINT AS early_matches, sum(rm)::BIGINT AS recent_matches FROM rates
WHERE theme IN ('wait_time_complaint', 'packaging_complaint') GROUP BY theme""")
def selected_themes(spark, folder):
    picked = rv.select_trends(_trends(spark, folder)[1], ["wait_time_complaint", "packaging_complaint"])
    return picked.groupBy("theme").agg(
        F.sum("early_matches").alias("early_matches"), F.sum("recent_matches").alias("recent_matches"))


LOYAL = theme_sql(next(t for t in THEMES if t.name == "loyalty_program_mention"))


@query("loyalty_evidence", f"""
WITH {DOC_CTE}
SELECT brand AS brand_name, count_if({LOYAL})::BIGINT AS mentions, count_if({LOYAL} AND stars <= 3)::BIGINT AS low_rating_mentions,
       count_if({LOYAL} AND stars > 3)::BIGINT AS high_rating_mentions, coalesce(min(CASE WHEN {LOYAL} THEN review_id END), -1) AS first_evidence_id
FROM docs GROUP BY brand""")
def loyalty_evidence(spark, folder):
    r = document_reviews(spark, folder)
    return rv.loyalty_evidence(r, brands_of(r)).fillna(-1, ["first_evidence_id"])


@query("repeat_visit_by_stars", f"""
WITH {DOC_CTE}
SELECT brand AS brand_name, count_if({theme_sql(THEMES[7])})::BIGINT AS mentions,
       count_if({theme_sql(THEMES[7])} AND stars <= 3)::BIGINT AS low_rating_mentions,
       count_if({theme_sql(THEMES[7])} AND stars > 3)::BIGINT AS high_rating_mentions,
       coalesce(min(CASE WHEN {theme_sql(THEMES[7])} THEN review_id END), -1) AS first_evidence_id
FROM docs GROUP BY brand""")
def repeat_visit_by_stars(spark, folder):
    r = document_reviews(spark, folder)
    return rv.loyalty_evidence(r, brands_of(r), "repeat_visit_language").fillna(-1, ["first_evidence_id"])


@query("trend_vs_rating", f"""
WITH {TREND_CTE},
stars AS (SELECT brand, avg(CASE WHEN period = 'early' THEN stars END) AS es, avg(CASE WHEN period = 'recent' THEN stars END) AS rs
          FROM half GROUP BY brand)
SELECT r.brand AS brand_name, theme, round(er, 6) AS early_per_1000, round(rr, 6) AS recent_per_1000,
       round(rr - er, 6) AS absolute_change_per_1000, grade AS evidence_grade, round(es, 6) AS early_mean_stars,
       round(rs, 6) AS recent_mean_stars, round(rs - es, 6) AS change_stars
FROM rates r JOIN stars s ON r.brand = s.brand WHERE theme = 'wait_time_complaint'""")
def trend_vs_rating(spark, folder):
    r, trends = _trends(spark, folder)
    return rounded(rv.trend_vs_rating(trends, rv.period_rating_trends(r, rv.analysis_window(r))))


# All events count. The type alone would put every user under every brand, so rare high values are a brand of their own.
HIGH_VALUE = 120
TIER_CTE = f"""{EVENT_CTE},
tier AS (SELECT * REPLACE (CASE WHEN value > {HIGH_VALUE} THEN brand || ' premium' ELSE brand END AS brand) FROM ev)"""
PAIRS = """
brands AS (SELECT DISTINCT brand FROM tier),
pairs AS (SELECT a.brand AS a, b.brand AS b FROM brands a JOIN brands b ON a.brand < b.brand),
sets AS (SELECT DISTINCT brand, reviewer FROM tier)"""


def _tiered(spark, folder):
    return event_reviews(spark, folder).withColumn("brand_name", F.when(
        F.col("value") > HIGH_VALUE, F.concat("brand_name", F.lit(" premium"))).otherwise(F.col("brand_name")))


def _tiered_and_brands(spark, folder):
    every = _tiered(spark, folder)
    return every, brands_of(every)


@query("reviewer_overlap", f"""
WITH {TIER_CTE}, {PAIRS},
everywhere AS (SELECT reviewer FROM sets GROUP BY reviewer HAVING count(*) = (SELECT count(*) FROM brands)),
shared AS (SELECT x.brand AS a, y.brand AS b, x.reviewer, e.reviewer IS NOT NULL AS ev
           FROM sets x JOIN sets y ON x.reviewer = y.reviewer AND x.brand < y.brand LEFT JOIN everywhere e ON e.reviewer = x.reviewer)
SELECT p.a AS brand_a, p.b AS brand_b, count(s.reviewer) AS shared_reviewers,
       count_if(s.ev)::BIGINT AS shared_reviewers_at_all_brands, count_if(NOT s.ev)::BIGINT AS pair_exclusive_reviewers
FROM pairs p LEFT JOIN shared s ON s.a = p.a AND s.b = p.b GROUP BY p.a, p.b""")
def reviewer_overlap(spark, folder):
    return rv.reviewer_overlap(*_tiered_and_brands(spark, folder))


def _side(s: str, m: str) -> str:
    v = f"{s}_{m}"
    name = f"{s}_{'overall_stars' if m == 's' else 'food_subrating'}"
    w = f"1.96 * stddev_samp({v}) / sqrt(nullif(count({v}), 0))"
    return (f"round(avg({v}), 6) AS {name}_mean, count({v}) AS {name}_reviewers, "
            f"round(coalesce(avg({v}) - {w}, avg({v})), 6) AS {name}_ci_low, "
            f"round(coalesce(avg({v}) + {w}, avg({v})), 6) AS {name}_ci_high")


@query("overlap_ratings", f"""
WITH {TIER_CTE}, {PAIRS},
m AS (SELECT brand, reviewer, avg(stars) AS s, avg(CASE WHEN branch % 2 = 0 THEN 1 + branch % 5 END) AS f FROM tier GROUP BY ALL),
shared AS (SELECT x.brand AS a, y.brand AS b, x.s AS a_s, y.s AS b_s, x.f AS a_f, y.f AS b_f
           FROM m x JOIN m y ON x.reviewer = y.reviewer AND x.brand < y.brand)
SELECT p.a AS brand_a, p.b AS brand_b, {_side('a', 's')}, {_side('a', 'f')}, {_side('b', 's')}, {_side('b', 'f')},
       count(a_s) AS shared_reviewers
FROM pairs p LEFT JOIN shared s ON s.a = p.a AND s.b = p.b GROUP BY p.a, p.b""")
def overlap_ratings(spark, folder):
    every, brands = _tiered_and_brands(spark, folder)
    aspects = every.where(F.col("branch_id") % 2 == 0).select(
        "review_id", F.lit(rv.FOOD_ASPECT).alias("aspect"), (F.col("branch_id") % 5 + 1).cast("double").alias("score"))
    return rounded(rv.overlap_ratings(every, brands, aspects))


@query("preference_share", f"""
WITH {TIER_CTE}, {PAIRS},
m AS (SELECT brand, reviewer, avg(stars) AS s FROM tier GROUP BY ALL),
shared AS (SELECT x.brand AS a, y.brand AS b, x.s AS u, y.s AS v FROM m x JOIN m y ON x.reviewer = y.reviewer AND x.brand < y.brand)
SELECT p.a AS brand_a, p.b AS brand_b, count(u) AS shared, count_if(u > v)::BIGINT AS prefer_a, count_if(v > u)::BIGINT AS prefer_b,
       count_if(u = v)::BIGINT AS no_preference, round(CASE WHEN count(u) = 0 THEN 0.0 ELSE count_if(u > v) / count(u) END, 6) AS share_a,
       round(CASE WHEN count(u) = 0 THEN 0.0 ELSE count_if(v > u) / count(u) END, 6) AS share_b
FROM pairs p LEFT JOIN shared s ON s.a = p.a AND s.b = p.b GROUP BY p.a, p.b""")
def preference_share(spark, folder):
    return rounded(rv.preference_share(*_tiered_and_brands(spark, folder)))


@query("customer_balanced_rating", f"""
WITH {TIER_CTE}, chosen AS (SELECT DISTINCT reviewer FROM tier WHERE brand = 'view premium'),
m AS (SELECT reviewer, avg(stars) AS s FROM tier WHERE brand = 'click' AND reviewer IN (SELECT reviewer FROM chosen) GROUP BY reviewer)
SELECT round(avg(s), 6) AS overall_stars_mean, count(s) AS overall_stars_reviewers,
       round(avg(s) - 1.96 * stddev_samp(s) / sqrt(count(s)), 6) AS overall_stars_ci_low,
       round(avg(s) + 1.96 * stddev_samp(s) / sqrt(count(s)), 6) AS overall_stars_ci_high FROM m""")
def customer_balanced_rating(spark, folder):
    r = _tiered(spark, folder)
    chosen = r.where(F.col("brand_name") == "view premium").select("reviewer_id")
    return rounded(rv.customer_balanced(r, "click", chosen))
