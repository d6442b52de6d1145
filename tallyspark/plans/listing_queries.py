"""Listing operators over pages, documents, parts, embeddings and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listing as ls
from ..sources.tables import table
from .display import rounded
from .registry import query

RULES = {"CONTACT": "whatsapp|call me|@", "REPLICA_TERM": "ther|copy", "RESTRICTED_TERM": "thou"}
WATCHED = ("their", "those", "onion", "other")


@query("html_strip", r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t, '(?s)<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM b)
SELECT page_id, trim(regexp_replace(t, '[ \t\n\r\f\v]+', ' ', 'g')) AS page_text FROM c""")
def html_strip(spark, folder):
    return table(spark, folder, "pages").select("page_id", ls.strip_html(F.col("html")).alias("page_text"))


_CLEAN = "nfc_normalize(text)"
for _c in "!?.,;:*#%_~-":
    _CLEAN = f"regexp_replace({_CLEAN}, '{chr(92)}{_c}+', '{_c}', 'g')"


@query("clean_text", f"""
SELECT doc_id, trim(regexp_replace({_CLEAN}, '\\s+', ' ', 'g')) AS clean_text,
       CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'english' ELSE 'other' END AS language FROM documents""")
def clean_text(spark, folder):
    return ls.with_clean_text(table(spark, folder, "documents")).select("doc_id", "clean_text", "language")


_READ = "translate(lower(text), '01345$@', 'oieassa')"
_LEET = " OR ".join(f"(contains({_READ}, '{t}') AND NOT contains(lower(text), '{t}'))" for t in WATCHED)


@query("obfuscation_flags", f"""
SELECT lang, count_if({_LEET})::BIGINT AS leetspeak, 0::BIGINT AS mixed_script,
       count_if(regexp_matches(text, '(?:^|[^A-Za-z])(?:[A-Za-z] ){{3,}}[A-Za-z](?:[^A-Za-z]|$)'))::BIGINT AS separated_letters, count(*) AS documents
FROM documents GROUP BY lang""")
def obfuscation_flags(spark, folder):
    d = table(spark, folder, "documents").withColumn("f", ls.obfuscation_flags(F.col("text"), WATCHED))
    return d.groupBy("lang").agg(
        F.count_if("f.leetspeak").alias("leetspeak"), F.count_if("f.mixed_script").alias("mixed_script"),
        F.count_if("f.separated_letters").alias("separated_letters"), F.count(F.lit(1)).alias("documents"))


CODES = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{c}' END" for c, p in sorted(RULES.items())) + "], lambda x: x IS NOT NULL)"


@query("policy_codes", f"""
SELECT array_to_string({CODES}, ',') AS codes, count(*) AS documents FROM documents GROUP BY 1""")
def policy_codes(spark, folder):
    d = table(spark, folder, "documents")
    return d.groupBy(F.array_join(ls.reason_codes(F.col("text"), RULES), ",").alias("codes")).agg(F.count(F.lit(1)).alias("documents"))


TERMS = ("widget", "gear", "bolts")


@query("fuzzy_terms", """
WITH tok AS (SELECT DISTINCT p_partkey, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS token FROM part),
terms(term) AS (VALUES ('widget'), ('gear'), ('bolts'))
SELECT p_partkey, term, token, levenshtein(token, term)::INT AS distance FROM tok, terms
WHERE token <> '' AND levenshtein(token, term) <= 1""")
def fuzzy_terms(spark, folder):
    return ls.fuzzy_terms(table(spark, folder, "part"), "p_partkey", "p_name", TERMS, 1)


@query("consistency", """
WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(split_part(text, chr(10), 1)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS a,
                  list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS b FROM documents)
SELECT doc_id, round(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 6) AS consistency FROM w""")
def consistency(spark, folder):
    d = table(spark, folder, "documents")
    title = F.substring_index("text", "\n", 1)
    return rounded(d.select("doc_id", ls.consistency(title, F.col("text")).alias("consistency")))


@query("brand_lookup", """
SELECT CASE WHEN p_type = 'SMALL' THEN 'no_brand' WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size > 49) THEN 'registered' ELSE 'unregistered' END AS brand_signal,
       count(*) AS parts FROM part GROUP BY 1""")
def brand_lookup(spark, folder):
    p = table(spark, folder, "part")
    registry = p.where("p_size > 49").select(F.col("p_brand").alias("brand_name"))
    listings = p.withColumn("brand", F.when(F.col("p_type") != "SMALL", F.col("p_brand")))
    return ls.brand_lookup(listings, registry).groupBy("brand_signal").agg(F.count(F.lit(1)).alias("parts"))


SIGNALS = f"""
s AS (SELECT doc_id, {CODES} AS codes, CASE WHEN doc_id % 20 <> 7 THEN (n_chars % 100) / 100.0::DOUBLE END AS vision,
             CASE WHEN doc_id % 20 <> 9 THEN (doc_id % 50) / 50.0::DOUBLE END AS consist, doc_id % 9 = 0 AS unreg FROM documents),
r AS (SELECT *, vision IS NOT NULL AND consist IS NOT NULL AS complete,
             CASE WHEN list_contains(codes, 'RESTRICTED_TERM') THEN 'RESTRICTED' WHEN list_contains(codes, 'REPLICA_TERM') THEN 'COUNTERFEIT' ELSE 'NONE' END AS risk,
             coalesce(vision >= 0.5, false) OR coalesce(consist < 0.1, false) OR unreg AS suspicious FROM s),
x AS (SELECT *, coalesce(risk <> 'NONE' AND vision >= 0.9, false) AS confirmed FROM r)"""


def _consolidated(spark, folder):
    d = table(spark, folder, "documents")
    signals = d.select(
        "doc_id", "text", ls.reason_codes(F.col("text"), RULES).alias("codes"),
        F.when(F.col("doc_id") % 20 != 7, (F.col("n_chars") % 100) / 100.0).alias("vision_score"),
        F.when(F.col("doc_id") % 20 != 9, (F.col("doc_id") % 50) / 50.0).alias("consistency"),
        F.when(F.col("doc_id") % 9 == 0, "unregistered").otherwise("registered").alias("brand_signal"))
    # suspicion from a null score must not hide behind the other signals
    return ls.consolidate(signals)


@query("consolidated_risk", f"""
WITH {SIGNALS} SELECT risk, confirmed, suspicious, complete AS checks_complete, count(*) AS listings FROM x GROUP BY ALL""")
def consolidated_risk(spark, folder):
    return _consolidated(spark, folder).groupBy("risk", "confirmed", "suspicious", "checks_complete").agg(F.count(F.lit(1)).alias("listings"))


ACTION = """CASE WHEN NOT complete THEN 'hold' WHEN confirmed THEN 'reject' WHEN risk <> 'NONE' OR suspicious THEN 'hold' ELSE 'publish' END"""


@query("publication_action", f"WITH {SIGNALS} SELECT doc_id, {ACTION} AS action FROM x")
def publication_action(spark, folder):
    c = _consolidated(spark, folder)
    return c.select("doc_id", ls.publication_action(F.col("confirmed"), F.col("checks_complete"), F.col("risk"), F.col("suspicious")).alias("action"))


@query("audit_record", f"""
WITH {SIGNALS} SELECT x.doc_id, sha256(text) AS raw_sha256, 'risk-v1' AS policy_version, 'rules-1' AS rules_version, risk, {ACTION} AS action, array_to_string(codes, ',') AS codes
FROM x JOIN documents d ON d.doc_id = x.doc_id""")
def audit_record(spark, folder):
    c = _consolidated(spark, folder)
    c = c.withColumn("action", ls.publication_action(F.col("confirmed"), F.col("checks_complete"), F.col("risk"), F.col("suspicious")))
    c = c.withColumn("codes", F.array_join("codes", ","))
    return ls.audit_record(c, "doc_id", "text", {"rules": "rules-1"}, ["policy_version", "risk", "action", "codes"]).drop("normalized_sha256")


@query("injection_flag", """
SELECT lang, count(*) AS documents, count_if(regexp_matches(text, '(?i)(?:ignore|disregard|forget)\\s+(?:all\\s+|the\\s+|any\\s+|previous\\s+)*(?:rules?|instructions?|prompts?)|approve\\s+this\\s+(?:item|listing)|system\\s+prompt'))::BIGINT AS flagged
FROM documents GROUP BY lang""")
def injection_flag(spark, folder):
    d = table(spark, folder, "documents")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count_if(ls.injection_flag(F.col("text"))).alias("flagged"))


@query("fact_check", """
WITH p AS (SELECT page_id, regexp_extract_all(html, '\\d+(?:\\.\\d+)?') AS src, regexp_extract_all(url, '\\d+(?:\\.\\d+)?') AS dsc FROM pages)
SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(dsc, lambda x: NOT list_contains(src, x)))), ',') AS unsupported FROM p""")
def fact_check(spark, folder):
    p = table(spark, folder, "pages")
    return p.select("page_id", F.array_join(ls.unsupported_facts(F.col("url"), F.col("html")), ",").alias("unsupported"))


# --- categories -------------------------------------------------------------------------------------

MATCH = ls.MatchPolicy(0.2, 0.02)
CENTRES = """
dim AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)),
cat AS (SELECT label AS category_id, i, avg(x) AS c FROM dim GROUP BY ALL),
cn AS (SELECT category_id, sqrt(sum(c * c)) AS n FROM cat GROUP BY category_id),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM dim GROUP BY vec_id),
sim AS (SELECT d.vec_id, c.category_id, sum(d.x * c.c) / any_value(vn.n) / any_value(cn.n) AS s
        FROM dim d JOIN cat c ON c.i = d.i JOIN vn ON vn.vec_id = d.vec_id JOIN cn ON cn.category_id = c.category_id GROUP BY ALL)"""


def _listings(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("listing_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), "label")


def _centres(listings, column="label"):
    """Mean vector per label, as a small taxonomy."""
    items = listings.select(column, F.posexplode("vector").alias("i", "x")).groupBy(column, "i").agg(F.avg("x").alias("c"))
    return items.groupBy(F.col(column).cast("string").alias("category_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda p: p["c"]).alias("vector"))


def _match_sql(where: str = "") -> str:
    return f"""
WITH {CENTRES}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, category_id::VARCHAR) AS r FROM sim {where}),
t AS (SELECT vec_id, max(CASE WHEN r = 1 THEN category_id END)::VARCHAR AS top1, max(CASE WHEN r = 1 THEN s END) AS s1, max(CASE WHEN r = 2 THEN s END) AS s2 FROM k WHERE r <= 2 GROUP BY vec_id)
SELECT vec_id AS listing_id, top1, round(s1, 5) AS top1_similarity, round(s2, 5) AS top2_similarity, round(s1 - s2, 5) AS margin,
       CASE WHEN s1 >= 0.2 AND s1 - s2 >= 0.02 THEN top1 ELSE 'UNKNOWN' END AS category, 'taxonomy-v1' AS taxonomy_version FROM t"""


@query("category_match", _match_sql())
def category_match(spark, folder):
    listings = _listings(spark, folder)
    return rounded(ls.match_categories(listings, _centres(listings), policy=MATCH), 5)


@query("hierarchical_match", """
WITH dim AS (SELECT vec_id, label, label % 2 AS dep, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM dim GROUP BY vec_id),
dc AS (SELECT dep AS id, i, avg(x) AS c FROM dim GROUP BY ALL), dn AS (SELECT id, sqrt(sum(c * c)) AS n FROM dc GROUP BY id),
ds AS (SELECT d.vec_id, c.id, sum(d.x * c.c) / any_value(dn.n) AS s FROM dim d JOIN dc c ON c.i = d.i JOIN dn ON dn.id = c.id GROUP BY ALL),
dep AS (SELECT vec_id, arg_max(id, s) AS department FROM ds GROUP BY vec_id),
lc AS (SELECT label AS id, label % 2 AS parent, i, avg(x) AS c FROM dim GROUP BY ALL), ln AS (SELECT id, sqrt(sum(c * c)) AS n FROM lc GROUP BY id),
s AS (SELECT d.vec_id, c.id, any_value(p.department) AS department, sum(d.x * c.c) / any_value(vn.n) / any_value(ln.n) AS s
      FROM dim d JOIN dep p ON p.vec_id = d.vec_id JOIN lc c ON c.i = d.i AND c.parent = p.department JOIN ln ON ln.id = c.id JOIN vn ON vn.vec_id = d.vec_id GROUP BY d.vec_id, c.id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, id) AS r FROM s)
SELECT vec_id AS listing_id, department::VARCHAR AS department, id::VARCHAR AS top1, round(s, 5) AS top1_similarity FROM k WHERE r = 1""")
def hierarchical_match(spark, folder):
    listings = _listings(spark, folder).withColumn("dep", F.col("label") % 2)
    leaves = _centres(listings).withColumn("parent_id", (F.col("category_id").cast("int") % 2).cast("string"))
    found = ls.match_hierarchy(listings, _centres(listings, "dep"), leaves, policy=MATCH)
    return rounded(found.select("listing_id", "department", "top1", "top1_similarity"), 5)


@query("reclassify_unknown", f"""
WITH {CENTRES}, old AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, category_id::VARCHAR) AS r FROM sim WHERE category_id % 2 = 0),
ot AS (SELECT vec_id, max(CASE WHEN r = 1 THEN category_id END)::VARCHAR AS top1, max(CASE WHEN r = 1 THEN s END) AS s1, max(CASE WHEN r = 2 THEN s END) AS s2 FROM old WHERE r <= 2 GROUP BY vec_id),
nw AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, category_id::VARCHAR) AS r FROM sim),
nt AS (SELECT vec_id, max(CASE WHEN r = 1 THEN category_id END)::VARCHAR AS top1, max(CASE WHEN r = 1 THEN s END) AS s1, max(CASE WHEN r = 2 THEN s END) AS s2 FROM nw WHERE r <= 2 GROUP BY vec_id)
SELECT ot.vec_id AS listing_id, CASE WHEN ot.s1 >= 0.2 AND ot.s1 - ot.s2 >= 0.02 THEN ot.top1 WHEN nt.s1 >= 0.2 AND nt.s1 - nt.s2 >= 0.02 THEN nt.top1 ELSE 'UNKNOWN' END AS category,
       CASE WHEN ot.s1 >= 0.2 AND ot.s1 - ot.s2 >= 0.02 THEN 'taxonomy-v1' ELSE 'taxonomy-v2' END AS taxonomy_version FROM ot JOIN nt ON nt.vec_id = ot.vec_id""")
def reclassify_unknown(spark, folder):
    listings = _listings(spark, folder)
    taxonomy = _centres(listings)
    first = ls.match_categories(listings, taxonomy.where("cast(category_id as int) % 2 = 0"), policy=MATCH)
    newer = ls.MatchPolicy(MATCH.min_similarity, MATCH.min_margin, version="taxonomy-v2")
    return ls.reclassify_unknown(first, listings, taxonomy, "listing_id", newer).select("listing_id", "category", "taxonomy_version")


@query("near_duplicates", """
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(nfc_normalize(coalesce(text, ''))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, w, array_to_string(list_sort(list_distinct(w)), ' ') AS f FROM t),
g AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, CASE WHEN len(w) < 5 THEN '# ' || f ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, f, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM f WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)
      UNION SELECT x.doc_id, y.doc_id FROM f x JOIN f y ON x.f = y.f AND x.doc_id <> y.doc_id),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS representative FROM r GROUP BY a)
SELECT doc_id, representative, count(*) OVER (PARTITION BY representative) AS copies FROM m""")
def near_duplicates(spark, folder):
    return ls.near_duplicates(table(spark, folder, "documents"), "doc_id", "text")


def _members(spark, folder):
    vectors = _listings(spark, folder)
    placed = ls.cluster(vectors, "listing_id", 8)
    return placed.join(vectors.select("listing_id", (F.col("listing_id") % 13).alias("seller")), "listing_id")


@query("unknown_clusters")
def unknown_clusters(spark, folder):
    """Iterative clustering: no SQL twin; the tests check its invariants."""
    summary, _ = ls.cluster_report(_members(spark, folder), "listing_id", "seller", F.col("listing_id") % 2 == 0, 20, 1.0)
    return rounded(summary)


@query("cluster_representatives")
def cluster_representatives(spark, folder):
    _, nearest = ls.cluster_report(_members(spark, folder), "listing_id", "seller", F.col("listing_id") % 2 == 0, 20, 1.0)
    return rounded(nearest)


# --- review capacity: orders as the queue; priority gives segment and band, the date the arrival ------------

CAPACITY_SQL = "(SELECT floor(count(*) * 0.05)::BIGINT FROM orders)"
QUEUE = """
q AS (SELECT o_orderkey AS id, o_orderdate AS arrival, (o_custkey % 3)::INT AS band,
             CASE WHEN o_custkey % 97 = 0 THEN 'emergency' WHEN o_custkey % 40 = 1 THEN 'unknown_category' WHEN o_orderpriority LIKE '1%' THEN 'prohibited_gray_zone'
                  WHEN o_custkey % 30 = 2 THEN 'adversarial' ELSE 'audit' END AS segment FROM orders)"""
QUOTA = f"""
cap AS (SELECT {CAPACITY_SQL} AS c),
sh(segment, share) AS (VALUES ('prohibited_gray_zone', 70), ('adversarial', 20), ('unknown_category', 1), ('audit', 9)),
wait AS (SELECT segment, count(*) AS waiting FROM q GROUP BY segment),
urgent AS (SELECT least(coalesce((SELECT waiting FROM wait WHERE segment = 'emergency'), 0), c)::BIGINT AS u, c FROM cap),
s AS (SELECT sh.segment, coalesce(waiting, 0) AS waiting, c - u AS places, ((c - u) * share) // 100 AS whole, ((c - u) * share) % 100 AS rest
      FROM sh LEFT JOIN wait ON wait.segment = sh.segment, urgent),
b AS (SELECT *, whole + (row_number() OVER (ORDER BY rest DESC, segment) <= places - sum(whole) OVER ())::INT AS first FROM s),
e AS (SELECT segment, waiting, first, least(first, waiting) AS used, waiting - least(first, waiting) AS excess FROM b),
t AS (SELECT *, least(sum(first - used) OVER (), sum(excess) OVER ()) AS free, greatest(sum(excess) OVER (), 1) AS n FROM e),
g AS (SELECT *, (free * excess) // n AS whole, (free * excess) % n AS rest FROM t),
f AS (SELECT *, used + whole + (row_number() OVER (ORDER BY rest DESC, segment) <= free - sum(whole) OVER ())::INT AS quota FROM g),
quota AS (SELECT segment, waiting::BIGINT AS waiting, quota::BIGINT AS quota FROM f
          UNION ALL SELECT 'emergency', coalesce((SELECT waiting FROM wait WHERE segment = 'emergency'), 0), u FROM urgent)"""


def _queue(spark, folder):
    o = table(spark, folder, "orders")
    segment = (
        F.when(F.col("o_custkey") % 97 == 0, "emergency").when(F.col("o_custkey") % 40 == 1, "unknown_category")
        .when(F.col("o_orderpriority").startswith("1"), "prohibited_gray_zone")
        .when(F.col("o_custkey") % 30 == 2, "adversarial").otherwise("audit"))
    queue = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("arrival"),
                     (F.col("o_custkey") % 3).cast("int").alias("band"), segment.alias("segment"))
    return queue, ls.ReviewPlan(int(o.count() * ls.CAPACITY_SHARE))


@query("segment_quotas", f"WITH {QUEUE}, {QUOTA} SELECT segment, waiting, quota FROM quota")
def segment_quotas(spark, folder):
    queue, plan = _queue(spark, folder)
    return ls.segment_quotas(queue, plan)


@query("review_allocation", f"""
WITH {QUEUE}, {QUOTA}, p AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY band, arrival, id) AS place FROM q)
SELECT p.id, p.segment, p.band, p.place FROM p JOIN quota ON quota.segment = p.segment WHERE place <= quota""")
def review_allocation(spark, folder):
    queue, plan = _queue(spark, folder)
    return ls.allocate_reviews(queue, plan, "id").select("id", "segment", "band", F.col("place").cast("long").alias("place"))


@query("priority_fifo", f"WITH {QUEUE} SELECT id, band, row_number() OVER (ORDER BY band, arrival, id) AS place FROM q")
def priority_fifo(spark, folder):
    queue, _ = _queue(spark, folder)
    return ls.queue_positions(queue, "id", by_segment=False).select("id", "band", "place")


@query("audit_sample", f"""
WITH {QUEUE}, r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY sha256('7:' || segment || ':' || id), id) AS rank FROM q)
SELECT id, segment, rank FROM r WHERE rank <= 12""")
def audit_sample(spark, folder):
    queue, _ = _queue(spark, folder)
    return ls.audit_sample(queue, "segment", "id", 12).select("id", "segment", F.col("rank").cast("long").alias("rank"))


# --- monitoring: events as scored listings --------------------------------------------------------------------

SCORED = """
sc AS (SELECT event_type AS segment, ts::DATE AS day, least(1.0, value / 100) AS s, CASE WHEN value < 10 THEN 'UNKNOWN' ELSE 'known' END AS category, user_id % 10 / 10.0::DOUBLE AS margin FROM events)"""


def _scored(spark, folder):
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_type").alias("segment"), "ts", F.least(F.lit(1.0), F.col("value") / 100).alias("top1_similarity"),
        F.when(F.col("value") < 10, ls.UNKNOWN).otherwise("known").alias("category"),
        (F.col("user_id") % 10 / 10.0).alias("margin"))


@query("monitoring_daily", f"""
WITH {SCORED}, d AS (SELECT segment, day, count(*) AS listings, count_if(category = 'UNKNOWN') / count(*) AS u, count_if(s < 0.2) / count(*) AS l, avg(s) AS ms, avg(margin) AS mm FROM sc GROUP BY ALL),
b AS (SELECT *, avg(u) OVER (PARTITION BY segment ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS base FROM d)
SELECT segment, strftime(day, '%Y-%m-%d') AS day, listings, round(u, 6) AS unknown_rate, round(l, 6) AS low_confidence_rate, round(ms, 6) AS mean_similarity,
       round(mm, 6) AS mean_margin, round(base, 6) AS baseline, coalesce(u > base * 1.5, false) AS alert FROM b""")
def monitoring_daily(spark, folder):
    daily = ls.daily_monitoring(_scored(spark, folder), "segment", 0.2)
    return rounded(ls.with_alerts(daily, "segment", "unknown_rate").withColumn("day", F.col("day").cast("string")))


@query("embedding_shift", """
WITH d AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i))
SELECT (i - 1)::INT AS dimension, round(avg(CASE WHEN vec_id % 2 = 0 THEN x END), 6) AS early_mean, round(avg(CASE WHEN vec_id % 2 = 1 THEN x END), 6) AS recent_mean,
       round(avg(CASE WHEN vec_id % 2 = 1 THEN x END) - avg(CASE WHEN vec_id % 2 = 0 THEN x END), 6) AS shift FROM d GROUP BY i""")
def embedding_shift(spark, folder):
    period = F.when(F.col("listing_id") % 2 == 0, "early").otherwise("recent")
    return rounded(ls.embedding_shift(_listings(spark, folder), period))


@query("success_metrics", """
WITH o AS (SELECT l_returnflag AS class, l_linestatus = 'F' AS prohibited, l_discount > 0.04 AS flagged, l_tax > 0.03 AS reviewed, l_quantity > 25 AS actioned,
                  l_linenumber = 1 AS appealed, l_quantity > 40 AS overturned, l_linenumber = 2 AS overridden FROM lineitem)
SELECT class, count(*) AS listings, round(count_if(prohibited AND flagged) / count_if(prohibited), 6) AS recall,
       round(count_if(NOT prohibited AND flagged) / count_if(NOT prohibited), 6) AS false_positive_rate, round(count_if(reviewed AND actioned) / count_if(reviewed), 6) AS review_yield,
       round(count_if(appealed AND overturned) / count_if(appealed), 6) AS overturn_rate, round(count_if(overridden) / count(*), 6) AS override_rate,
       round(count_if(reviewed) / count(*), 6) AS reviewed_share FROM o GROUP BY class""")
def success_metrics(spark, folder):
    c = F.col
    o = table(spark, folder, "lineitem").select(
        c("l_returnflag").alias("class"), (c("l_linestatus") == "F").alias("prohibited"), (c("l_discount") > 0.04).alias("flagged"),
        (c("l_tax") > 0.03).alias("reviewed"), (c("l_quantity") > 25).alias("actioned"), (c("l_linenumber") == 1).alias("appealed"),
        (c("l_quantity") > 40).alias("overturned"), (c("l_linenumber") == 2).alias("overridden"))
    return rounded(ls.safety_metrics(o, ["class"]))


@query("latency_percentiles", """
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""")
def latency_percentiles(spark, folder):
    return rounded(ls.latency(table(spark, folder, "events"), ["event_type"], "value"))
