"""Trust checks on review signals over events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..operators import reviews as rv, signals as sg
from ..sources.tables import document_reviews, event_reviews, table
from .display import rounded
from .registry import query
from .review_queries import DOC_CTE, EVENT_CTE, HALVES, TEXT_THEMES, TEXT_TREND_CTE

# Events as theme evidence: the type is the brand, a low-valued event is a mention.
MENTIONS = f"{EVENT_CTE}, m AS (SELECT *, 'low' AS theme FROM ev WHERE stars <= 1)"


def _mentions(spark, folder):
    r = event_reviews(spark, folder)
    return r.where("stars <= 1").withColumn("theme", F.lit("low"))


@query("concentration", f"""
WITH {MENTIONS}, b AS (SELECT brand, theme, branch, count(*) AS n FROM m GROUP BY ALL)
SELECT brand AS brand_name, theme, sum(n)::BIGINT AS mentions, count(*) AS branches,
       (SELECT count(DISTINCT reviewer) FROM m WHERE m.brand = b.brand) AS reviewers,
       (SELECT count(DISTINCT date_trunc('week', ts)) FROM m WHERE m.brand = b.brand) AS weeks,
       round(max(n) / sum(n), 6) AS largest_branch_share FROM b GROUP BY brand, theme""")
def concentration(spark, folder):
    return rounded(sg.concentration(_mentions(spark, folder)))


RUNS = f"""{MENTIONS},
w AS (SELECT branch, date_trunc('week', ts)::DATE AS week, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 8),
i AS (SELECT *, (week - DATE '1970-01-05') // 7 - row_number() OVER (PARTITION BY branch ORDER BY week) AS island FROM w),
r AS (SELECT branch, island, count(*) AS run FROM i GROUP BY ALL)"""


@query("persistence", f"""
WITH {RUNS} SELECT branch AS branch_id, sum(run)::BIGINT AS active_weeks, max(run) AS longest_run FROM r GROUP BY branch""")
def persistence(spark, folder):
    return sg.persistence(_mentions(spark, folder), ["branch_id"], 8)


@query("fold_stability", f"""
WITH {EVENT_CTE}, {HALVES.format(t='ev')},
f AS (SELECT *, (('0x' || substr(sha256('fold:' || review_id), 1, 8))::BIGINT % 100) % 5 AS fold, stars <= 1 AS hit FROM half),
a AS (SELECT brand, fold, count_if(period = 'early') AS er, count_if(period = 'early' AND hit) AS eh, count_if(period = 'recent') AS rr, count_if(period = 'recent' AND hit) AS rh FROM f GROUP BY ALL),
l AS (SELECT brand, (sum(rh) OVER w - rh) / (sum(rr) OVER w - rr) - (sum(eh) OVER w - eh) / (sum(er) OVER w - er) AS c FROM a WINDOW w AS (PARTITION BY brand))
SELECT brand AS brand_name, count(*) AS folds, round(min(c), 6) AS lowest_change, round(max(c), 6) AS highest_change, min(c) > 0 OR max(c) < 0 AS stable FROM l GROUP BY brand""")
def fold_stability(spark, folder):
    r = event_reviews(spark, folder)
    flagged = r.select("brand_name", "review_id", rv.analysis_window(r).period().alias("period"), (F.col("stars") <= 1).alias("hit"))
    return rounded(sg.fold_stability(flagged, ["brand_name"]))


BURST = sg.SuspicionPolicy(burst_z=1.2, reviewer_max=75, branch_share=0.012)


@query("suspicious_bursts", f"""
WITH {EVENT_CTE}, d AS (SELECT brand, ts::DATE AS day, count(*) AS n FROM ev GROUP BY ALL),
z AS (SELECT *, (n - avg(n) OVER (PARTITION BY brand)) / stddev_pop(n) OVER (PARTITION BY brand) AS z FROM d)
SELECT brand AS brand_name, strftime(day, '%Y-%m-%d') AS day, n AS reviews, round(z, 6) AS z FROM z WHERE z > 1.2""")
def suspicious_bursts(spark, folder):
    return rounded(sg.bursts(event_reviews(spark, folder), BURST).withColumn("day", F.col("day").cast("string")))


@query("suspicious_reviews", f"""
WITH {EVENT_CTE}, d AS (SELECT brand, ts::DATE AS day, count(*) AS n FROM ev GROUP BY ALL),
z AS (SELECT *, (n - avg(n) OVER (PARTITION BY brand)) / stddev_pop(n) OVER (PARTITION BY brand) AS z FROM d),
x AS (SELECT reviewer FROM ev GROUP BY reviewer HAVING count(*) > 75),
bb AS (SELECT brand, branch, count(*) / sum(count(*)) OVER (PARTITION BY brand) AS s FROM ev GROUP BY brand, branch),
f AS (SELECT ev.*, z.z > 1.2 AS burst, x.reviewer IS NOT NULL AS extreme, bb.s > 0.012 AS conc
      FROM ev JOIN z ON z.brand = ev.brand AND z.day = ev.ts::DATE LEFT JOIN x ON x.reviewer = ev.reviewer JOIN bb ON bb.brand = ev.brand AND bb.branch = ev.branch)
SELECT brand AS brand_name, count(*) AS rows, count_if(burst OR extreme OR conc)::BIGINT AS suspicious_rows, round(avg(stars), 6) AS with_all,
       round(avg(CASE WHEN NOT (burst OR extreme OR conc) THEN stars END), 6) AS without_suspicious,
       round(avg(CASE WHEN NOT (burst OR extreme OR conc) THEN stars END) - avg(stars), 6) AS difference FROM f GROUP BY brand""")
def suspicious_reviews(spark, folder):
    flagged = sg.suspicious_reviews(event_reviews(spark, folder), BURST)
    return rounded(sg.with_and_without(flagged, ["brand_name"], F.col("stars")))


@query("repeated_wording", """
WITH w AS (SELECT doc_id, source, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(nfc_normalize(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))), ' ') AS f,
                  trim(text) <> '' AS has FROM documents),
c AS (SELECT *, count(*) OVER (PARTITION BY f) AS n FROM w)
SELECT source AS brand_name, count(*) AS reviews, count_if(n > 1 AND has)::BIGINT AS repeated FROM c GROUP BY source""")
def repeated_wording(spark, folder):
    flagged = sg.suspicious_reviews(document_reviews(spark, folder))
    return flagged.groupBy("brand_name").agg(
        F.count(F.lit(1)).alias("reviews"), F.count_if("repeated_wording").alias("repeated"))


@query("emerging_terms", f"""
WITH {DOC_CTE}, {HALVES.format(t='docs')},
tok AS (SELECT branch, period, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) AS term FROM half)
SELECT term, count(*) AS recent, count(DISTINCT branch) AS branches FROM tok GROUP BY term
HAVING count_if(period = 'early') = 0 AND count(*) >= 3 AND count(DISTINCT branch) >= 3""")
def emerging_terms(spark, folder):
    r = document_reviews(spark, folder)
    return sg.emerging_terms(r, rv.analysis_window(r).period(), 3, 3)


@query("relative_position", f"""
WITH {EVENT_CTE}, w AS (SELECT brand, date_trunc('week', ts)::DATE AS p, avg(stars) AS s, count(*) AS n FROM ev GROUP BY ALL),
r AS (SELECT *, percent_rank() OVER (PARTITION BY p ORDER BY s) AS pr, avg(s) OVER (PARTITION BY brand ORDER BY p ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b FROM w)
SELECT brand AS brand_name, strftime(p, '%Y-%m-%d') AS period_start, round(s, 6) AS mean_stars, n AS reviews, round(pr, 6) AS peer_percent_rank,
       round(b, 6) AS own_baseline, round(s - b, 6) AS gap_to_baseline FROM r""")
def relative_position(spark, folder):
    return rounded(sg.relative_position(event_reviews(spark, folder)).withColumn("period_start", F.col("period_start").cast("string")))


Z2 = 1.96 * 1.96


@query("branch_outliers", f"""
WITH {EVENT_CTE}, b AS (SELECT brand, branch, count(*) AS n, count_if(stars <= 3) AS l, count(response) AS r FROM ev GROUP BY ALL),
t AS (SELECT *, sum(l) OVER (PARTITION BY brand) / sum(n) OVER (PARTITION BY brand) AS br, l / n AS p FROM b),
w AS (SELECT *, greatest(0.0, (p + {Z2} / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + {Z2} / (4.0 * n * n))) / (1 + {Z2} / n)) AS lo FROM t)
SELECT brand AS brand_name, branch AS branch_id, n AS reviews, l::BIGINT AS low, r AS responses, round(br, 6) AS brand_low_rate, round(p, 6) AS low_rate,
       round(lo, 6) AS low_rate_floor, round(r / n, 6) AS response_rate, lo > br AS outlier FROM w""")
def branch_outliers(spark, folder):
    return rounded(sg.branch_outliers(event_reviews(spark, folder)))


@query("confidence_label", f"""
WITH {MENTIONS}, b AS (SELECT brand, branch, count(*) AS n FROM m GROUP BY ALL), c AS (SELECT brand, sum(n) AS mentions, count(*) AS branches, max(n) / sum(n) AS share FROM b GROUP BY brand),
w AS (SELECT brand, date_trunc('week', ts)::DATE AS week FROM m GROUP BY ALL),
i AS (SELECT *, (week - DATE '1970-01-05') // 7 - row_number() OVER (PARTITION BY brand ORDER BY week) AS island FROM w),
r AS (SELECT brand, max(run) AS longest FROM (SELECT brand, island, count(*) AS run FROM i GROUP BY ALL) GROUP BY brand)
SELECT c.brand AS brand_name, 'low' AS theme, CASE WHEN mentions >= 50 AND branches >= 3 AND share <= 0.5 AND longest >= 2 THEN 'high'
       WHEN mentions >= 10 AND ((branches >= 3 AND share <= 0.5) OR longest >= 2) THEN 'medium' ELSE 'low' END AS confidence, 'confidence-v1' AS method_version
FROM c JOIN r ON r.brand = c.brand""")
def confidence_label(spark, folder):
    m = _mentions(spark, folder)
    return sg.confidence_label(sg.concentration(m), sg.persistence(m)).select("brand_name", "theme", "confidence", "method_version")


CLAIM = f"""{TEXT_TREND_CTE},
claim AS (SELECT 'CLM-' || upper(theme) || '-' || upper(brand) AS claim_id, brand, theme, grade, rr - er AS change, em, rm, et, rt,
                 CASE WHEN rr - er > 0 THEN 'up' WHEN rr - er < 0 THEN 'down' ELSE 'flat' END AS direction FROM rates)"""


def _claims(spark, folder):
    r = document_reviews(spark, folder)
    return sg.claims(rv.theme_trends(r, rv.analysis_window(r), TEXT_THEMES), "lexicon-v1")


@query("claims", f"""
WITH {CLAIM} SELECT claim_id, brand AS brand_name, theme, grade AS evidence_grade, round(change, 6) AS absolute_change_per_1000, direction,
       em || ',' || rm || ',' || et || ',' || rt AS numbers FROM claim""")
def claims(spark, folder):
    return rounded(_claims(spark, folder).withColumn("numbers", F.array_join("numbers", ",")).drop("claim_json"))


def _sentences(claim_rows):
    """Narratives about every claim; a hash of the claim decides what is wrong with each."""
    kind = F.pmod(F.conv(F.substring(F.sha2("claim_id", 256), 1, 4), 16, 10).cast("int"), F.lit(5))
    n = F.col("numbers")
    base = F.concat(F.col("brand_name"), F.lit(" had "), n[0], F.lit(" then "), n[1], F.lit(" mentions."))
    text = (
        F.when(kind == 0, base).when(kind == 1, F.concat(base, F.lit(" This led to 987654 losses.")))
        .when(kind == 2, F.concat(F.lit("Somebody rose to "), n[1], F.lit(".")))
        .when(kind == 3, F.concat(F.col("brand_name"), F.lit(" fell down.")))
        .otherwise(base))
    cited = F.when(kind == 4, F.lit("CLM-NONE")).otherwise(F.col("claim_id"))
    return claim_rows.select(F.col("claim_id").alias("sentence_id"), text.alias("sentence"), cited.alias("claim_id"))


@query("claim_validator", f"""
WITH {CLAIM}, k AS (SELECT *, ('0x' || substr(sha256(claim_id), 1, 4))::BIGINT % 5 AS kind FROM claim)
SELECT claim_id AS sentence_id, 'causal_verb' AS violation FROM k WHERE kind = 1 UNION ALL SELECT claim_id, 'unsupported_number' FROM k WHERE kind = 1
UNION ALL SELECT claim_id, 'wrong_brand' FROM k WHERE kind = 2 UNION ALL SELECT claim_id, 'wrong_direction' FROM k WHERE kind = 2 AND direction <> 'up'
UNION ALL SELECT claim_id, 'wrong_direction' FROM k WHERE kind = 3 AND direction <> 'down' UNION ALL SELECT claim_id, 'unbound' FROM k WHERE kind = 4""")
def claim_validator(spark, folder):
    rows = _claims(spark, folder)
    return sg.narrative_violations(_sentences(rows), rows)


# Doubles tell equal changes apart by their last digits, so claims are ranked by whole numbers made of the counts.
@query("ranked_claims", f"""
WITH {CLAIM}, n AS (SELECT *, rm::HUGEINT AS m2, em::HUGEINT AS m1, greatest(rt, 1)::HUGEINT AS t2, greatest(et, 1)::HUGEINT AS t1 FROM claim WHERE grade <> 'insufficient')
SELECT claim_id, grade AS evidence_grade, round(change, 6) AS absolute_change_per_1000,
       row_number() OVER (ORDER BY (1000000000000000::HUGEINT * (m2 * t1 - m1 * t2)) // (t1 * t2) DESC, claim_id)::INT AS place FROM n""")
def ranked_claims(spark, folder):
    snapshot = {"lexicon": "lexicon-v1", "dedup": "first-occurrence-v1", "ranking": "change-v1"}
    return rounded(sg.ranked_claims(_claims(spark, folder), snapshot).drop("snapshot_id"))


@query("text_coverage", f"""
WITH {DOC_CTE} SELECT brand AS brand_name, count(*) AS reviews, count_if(norm <> '')::BIGINT AS with_text, sum(length(norm))::BIGINT AS characters FROM docs GROUP BY brand""")
def text_coverage(spark, folder):
    r = document_reviews(spark, folder).withColumn("n", normalize_text(F.col("review_text")))
    return r.groupBy("brand_name").agg(
        F.count(F.lit(1)).alias("reviews"), F.count_if(F.length("n") > 0).alias("with_text"), F.sum(F.length("n")).alias("characters"))
