"""Sources, sinks, contract checks and nested-record operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, ingest, operations as ops, reviews as rv
from ..session import scratch_path
from ..sources import readers, sinks
from ..sources.tables import document_reviews, event_facts, order_facts, table
from .display import rounded
from .registry import query

EVENT_TOTALS = """
SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY event_type"""


def _totals(df):
    return df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"),
        F.round(F.sum("value"), 4).alias("total"))


def _twice(write, path: str) -> None:
    """A second write to the same place must be refused."""
    write(path)
    try:
        write(path)
    except Exception as error:
        if "exist" not in str(error).lower():
            raise
        return
    raise AssertionError(f"{path} was overwritten")


@query("jsonl_source", EVENT_TOTALS)
def jsonl_source(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "user_id", "value")
    path = scratch_path(spark, "jsonl")
    _twice(lambda p: sinks.write_json_lines(events, p, ["event_id"]), path)
    return _totals(readers.json_lines(spark, path, "event_id long, event_type string, user_id long, value double"))


@query("bad_json_lines", """
WITH n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_id // 5000 ORDER BY event_id) AS line_number FROM events)
SELECT event_type, count(*) AS bad_lines, sum(line_number)::BIGINT AS line_numbers FROM n WHERE event_id % 10 = 0 GROUP BY event_type""")
def bad_json_lines(spark, folder):
    """Every tenth line is cut off behind its type; each must be reported with its number in its file, none dropped silently."""
    e = table(spark, folder, "events").select("event_id", "event_type", "value", F.floor(F.col("event_id") / 5000).alias("part"))
    whole = F.to_json(F.struct("event_type", "event_id", "value"))
    cut = F.concat(F.lit('{"event_type":"'), "event_type", F.lit('","event_id":'))
    path = scratch_path(spark, "badlines")
    lines = e.repartition("part").sortWithinPartitions("part", "event_id").select(
        "part", F.when(F.col("event_id") % 10 == 0, cut).otherwise(whole).alias("value"))
    lines.write.partitionBy("part").text(path)
    bad = readers.bad_json_lines(spark, path, "event_type string, event_id long, value double")
    return bad.groupBy(F.regexp_extract("line", '"event_type":"([a-z]+)"', 1).alias("event_type")).agg(
        F.count(F.lit(1)).alias("bad_lines"), F.sum("line_number").alias("line_numbers"))


@query("csv_source", EVENT_TOTALS)
def csv_source(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "user_id", "value", "props")
    path = scratch_path(spark, "csv")
    _twice(lambda p: sinks.write_csv(events, p, ["event_id", "event_type", "user_id", "value"]), path)
    back = readers.csv_strings(spark, path)
    checks.require_columns(back, ["event_id", "event_type", "user_id", "value"])
    return _totals(back.withColumn("value", F.col("value").cast("double")))


@query("csv_typed_source", EVENT_TOTALS)
def csv_typed_source(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "user_id", "value", "props")
    path = scratch_path(spark, "typedcsv")
    events.write.option("header", True).option("compression", "gzip").csv(path)
    schema = "event_id long, event_type string, user_id long, value double, props string"
    return _totals(readers.csv_typed(spark, path, schema, ["event_type", "user_id", "value"]))


@query("json_array_source", """
SELECT role, count(*) AS turns, sum(length(text))::BIGINT AS chars, max(turn) AS last_ordinal FROM conversations GROUP BY role""")
def json_array_source(spark, folder):
    """Conversations as elements of JSON array files, sixteen to a file."""
    c = table(spark, folder, "conversations")
    nested = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    path = scratch_path(spark, "array")
    lines = nested.select(F.to_json(F.struct("conv_id", "messages")).alias("line"), F.floor(F.col("conv_id") / 16).alias("part"))
    arrays = lines.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("line"), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    records = readers.json_records(spark, path, "*.txt")
    turns = records.select(F.posexplode(F.variant_get("record", "$.messages", "array<struct<role string, text string>>")).alias("ordinal", "m"))
    return turns.groupBy("m.role").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.length("m.text")).alias("chars"),
        F.max("ordinal").cast("long").alias("last_ordinal"))


@query("prepared_source", """
SELECT event_type AS "BranchID", count(*) AS orders, count(CASE WHEN value >= 5 THEN 1 END) AS timed,
       count_if(event_type = 'error')::BIGINT AS late FROM events GROUP BY event_type""")
def prepared_source(spark, folder):
    """The compact prepared table, written once and read back instead of the raw export."""
    path = scratch_path(spark, "prepared")
    prepared = ops.prepare(event_facts(spark, folder), check=False)
    _twice(lambda p: ops.write_prepared(prepared, p), path)
    back = ops.load(spark, path, "parquet")
    return back.groupBy("BranchID").agg(
        F.count(F.lit(1)).alias("orders"), F.count("delivery_duration_minutes").alias("timed"),
        F.count_if("late_comment_signal").alias("late"))


@query("file_manifest")
def file_manifest(spark, folder):
    """Name, hash and rows of the exported files; file bytes differ per run, so there is no SQL twin."""
    path = scratch_path(spark, "manifest")
    table(spark, folder, "events").select("event_id", "event_type").write.json(path)
    rows = readers.json_records(spark, path, "part-*", lines=True)
    return readers.file_manifest(spark, path, readers.rows_per_file(rows), "part-*")


@query("appended_events", """
SELECT event_type, 2 * count(*) AS events FROM events GROUP BY event_type""")
def appended_events(spark, folder):
    e = table(spark, folder, "events").select("event_id", "event_type")
    path = scratch_path(spark, "appends")
    for _ in range(2):
        sinks.append_events(e, path)
    return spark.read.schema(e.schema).parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query("published_tables", """
SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'nation', count(*) FROM nation""")
def published_tables(spark, folder):
    path = scratch_path(spark, "published")
    sources = {n: table(spark, folder, n) for n in ("customer", "nation")}

    def complete(written):
        for name, df in written.items():
            agree = checks.row_count_difference(sources[name], df)
            checks.require_none(agree.where("not matches"), f"{name} incomplete")

    done = sinks.publish(spark, sources, path, complete)
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in done.items()]
    return parts[0].unionByName(parts[1])


# --- lineage and nested records ------------------------------------------------------------------

EXPORT = """
ex AS (SELECT *, event_id AS id, (props::JSON->>'k')::INT AS k, least(5, floor(value / 30)::INT + 1) AS stars FROM events),
src AS (SELECT *, 0 AS copy FROM ex UNION ALL SELECT *, 1 FROM ex WHERE event_id % 25 = 0)"""


def _exported(spark, folder):
    """Review records of all events as JSON lines, every 25th record delivered twice."""
    e = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    record = F.struct(
        F.col("event_type").alias("brand"), (F.col("k").cast("string")).alias("branch_id"),
        F.concat(F.lit("B"), "k").alias("branch_label"), F.lit("city").alias("city"),
        F.col("event_id").cast("string").alias("review_id"), F.col("user_id").cast("string").alias("reviewer_id"),
        F.least(F.lit(5), F.floor(F.col("value") / 30).cast("int") + 1).alias("stars"),
        iso.alias("publishedAtDate"), iso.alias("scrapedAt"),
        F.when(F.col("k") % 2 == 0, F.array(F.lit("cafe"), F.concat(F.lit("k"), "k"))).alias("categories"),
        F.struct(F.lit("dine in").alias("service"), F.col("value").alias("spent"), (F.col("k") > 50).alias("queue"),
                 F.col("k").alias("party"), F.array("k").alias("tags")).alias("reviewContext"),
        F.when(F.col("k") % 3 == 0, F.create_map(F.lit("food"), (F.col("k") % 5 + 1).cast("double"))).alias("reviewDetailedRating"),
    )
    path = scratch_path(spark, "export")
    base = e.select(F.to_json(record).alias("value"), "event_id")
    copies = base.unionAll(base.where("event_id % 25 = 0"))
    copies.select("value").write.text(path)
    return readers.json_records(spark, path, "*.txt", lines=True)


@query("review_ingest", f"""
WITH {EXPORT}
SELECT event_type AS brand_name, (SELECT count(*) FROM src s WHERE s.event_type = ex.event_type) AS source_rows, count(*) AS unique_rows,
       count_if(event_id % 25 = 0)::BIGINT AS duplicates, sum(stars)::BIGINT AS stars, 1::BIGINT AS distinct_ordinals
FROM ex GROUP BY event_type""")
def review_ingest(spark, folder):
    """Typed reviews from the export: duplicates stay in the lineage and leave the metrics."""
    marked = ingest.mark_duplicates(ingest.type_reviews(_exported(spark, folder)))
    lineage = marked.groupBy("source_file", "source_ordinal").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max("n").alias("distinct_ordinals"))
    once = ~F.col("is_exact_duplicate")
    return marked.groupBy("brand_name").agg(
        F.count(F.lit(1)).alias("source_rows"), F.count_if(once).alias("unique_rows"), F.count_if(~once).alias("duplicates"),
        F.sum(F.when(once, F.col("stars"))).alias("stars")).crossJoin(lineage)


@query("variant_context", f"""
WITH {EXPORT}
SELECT key AS context_key, typ AS value_type, count(*) AS rows, max(v) AS largest, max(x) AS largest_number FROM (
  SELECT 'service' AS key, 'str' AS typ, '"dine in"' AS v, NULL::DOUBLE AS x FROM src UNION ALL SELECT 'queue', 'bool', (k > 50)::VARCHAR, NULL FROM src
  UNION ALL SELECT 'party', 'int', k::VARCHAR, NULL FROM src UNION ALL SELECT 'tags', 'list', '[' || k || ']', NULL FROM src
  UNION ALL SELECT 'spent', 'float', NULL, value FROM src WHERE value IS NOT NULL)
GROUP BY ALL""")
def variant_context(spark, folder):
    rows = ingest.context_rows(ingest.type_reviews(_exported(spark, folder)))
    # Numbers with a fraction are compared as numbers; their text is a matter of the writer.
    number = F.col("value_type") == "float"
    return rows.groupBy("context_key", "value_type").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.when(~number, F.col("json_value"))).alias("largest"),
        F.max(F.when(number, F.col("json_value").cast("double"))).alias("largest_number"))


@query("detailed_ratings", f"""
WITH {EXPORT} SELECT 'food' AS aspect, count(*) AS ratings, round(avg(k % 5 + 1), 6) AS mean FROM src WHERE k % 3 = 0""")
def detailed_ratings(spark, folder):
    rows = ingest.score_rows(ingest.type_reviews(_exported(spark, folder)))
    return rounded(rows.groupBy("aspect").agg(F.count(F.lit(1)).alias("ratings"), F.avg("score").alias("mean")))


@query("explode_ordinal", f"""
WITH {EXPORT}, c AS (SELECT 0 AS ordinal, 'cafe' AS category FROM src WHERE k % 2 = 0 UNION ALL SELECT 1, 'k' || k FROM src WHERE k % 2 = 0)
SELECT ordinal, category, count(*) AS rows FROM c GROUP BY ALL""")
def explode_ordinal(spark, folder):
    rows = ingest.ordinal_rows(ingest.type_reviews(_exported(spark, folder)), "review_id", "categories", {"category": None})
    return rows.groupBy("ordinal", "category").agg(F.count(F.lit(1)).alias("rows"))


@query("embedding_ordinals", """
SELECT (i - 1)::INT AS ordinal, count(*) AS rows, round(sum(embedding[i]::DOUBLE), 3) AS total
FROM embeddings, range(1, 65) r(i) GROUP BY i""")
def embedding_ordinals(spark, folder):
    rows = ingest.ordinal_rows(table(spark, folder, "embeddings"), "vec_id", "embedding", {"x": None})
    return rows.groupBy("ordinal").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(F.col("x").cast("double")), 3).alias("total"))


@query("unpivot", """
WITH n AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL)
SELECT user_id AS branch_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS stars,
       c AS review_count FROM n""")
def unpivot(spark, folder):
    """Five fixed keys of one struct per user become rows; keys without events give none."""
    types = ("view", "click", "signup", "purchase", "error")
    per_user = table(spark, folder, "events").groupBy(F.col("user_id").alias("branch_id")).agg(*[
        F.nullif(F.count_if(F.col("event_type") == t), F.lit(0)).alias(label) for t, label in zip(types, ingest.STAR_LABELS)])
    return ingest.star_distribution(per_user.select("branch_id", F.struct(*ingest.STAR_LABELS).alias("reviewsDistribution")))


@query("popular_times", """
WITH h AS (SELECT event_type, dayofweek(ts) AS d, hour(ts) AS hr, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type AS branch_id, d::VARCHAR AS weekday, (row_number() OVER (PARTITION BY event_type, d ORDER BY hr) - 1)::INT AS ordinal,
       hr AS hour, least(100, n) AS occupancy_percent FROM h""")
def popular_times(spark, folder):
    """A map of weekday to hour structs per event type, unnested with ordinals."""
    e = table(spark, folder, "events")
    hours = e.groupBy("event_type", (F.dayofweek("ts") - 1).cast("string").alias("d"), F.hour("ts").cast("long").alias("hour")).agg(
        F.least(F.lit(100).cast("long"), F.count(F.lit(1))).alias("occupancyPercent"))
    per_day = hours.groupBy("event_type", "d").agg(F.sort_array(F.collect_list(F.struct("hour", "occupancyPercent"))).alias("items"))
    nested = per_day.groupBy(F.col("event_type").alias("branch_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("d", "items"))).alias("popularTimesHistogram"))
    return ingest.popular_times(nested)


@query("attribute_rows", """
SELECT role AS attribute_group, turn % 3 AS item_ordinal, CASE turn % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS attribute_name,
       turn % 4 < 2 AS enabled, count(*) AS rows FROM conversations GROUP BY ALL""")
def attribute_rows(spark, folder):
    c = table(spark, folder, "conversations")
    name = F.when(F.col("turn") % 2 == 0, "even").otherwise("odd")
    item = F.create_map(name, F.col("turn") % 4 < 2)
    nothing = F.create_map().cast("map<string,boolean>")
    slots = F.array(*[F.when(F.col("turn") % 3 == i, item).otherwise(nothing) for i in range(3)])
    nested = c.select(F.concat_ws("-", "conv_id", "turn").alias("branch_id"), F.create_map("role", slots).alias("additionalInfo"))
    return ingest.attributes(nested).groupBy("attribute_group", F.col("item_ordinal").cast("long").alias("item_ordinal"), "attribute_name", "enabled").agg(
        F.count(F.lit(1)).alias("rows"))


@query("menu_items", """
WITH m AS (SELECT p_brand, p_type, p_name, max(p_retailprice) AS price FROM part GROUP BY ALL)
SELECT p_brand AS brand_name, (dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) - 1)::INT AS section_ordinal, p_type AS section_name,
       (row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_name) - 1)::INT AS item_ordinal, p_name AS item_name, price FROM m""")
def menu_items(spark, folder):
    """Parts as a menu: brand -> type -> name -> price, one object per brand."""
    m = table(spark, folder, "part").groupBy("p_brand", "p_type", "p_name").agg(F.max("p_retailprice").alias("price"))
    sections = m.groupBy("p_brand", "p_type").agg(F.map_from_entries(F.collect_list(F.struct("p_name", "price"))).alias("items"))
    brands = sections.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "items"))).alias("sections"))
    return ingest.menu_items(brands.select(F.parse_json(F.to_json(F.create_map("p_brand", "sections"))).alias("record")))


@query("entity_counts", """
SELECT event_type AS entity, count(DISTINCT props) AS fields FROM events GROUP BY event_type""")
def entity_counts(spark, folder):
    fields = table(spark, folder, "events").select(F.col("event_type").alias("entity"), "props").distinct()
    return ingest.entity_counts(fields)


@query("canonical_dedup", """
WITH r AS (SELECT doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS n FROM documents)
SELECT h AS payload_sha256, count(*) AS copies, min(CASE WHEN n = 1 THEN doc_id END) AS kept, count_if(n > 1)::BIGINT AS duplicates
FROM r GROUP BY h HAVING count(*) > 1""")
def canonical_dedup(spark, folder):
    """First occurrence by file (source) and ordinal (id) wins; later copies are flagged."""
    d = table(spark, folder, "documents").select(
        F.sha2("text", 256).alias("payload_sha256"), F.col("source").alias("source_file"), F.col("doc_id").alias("source_ordinal"))
    marked = ingest.mark_duplicates(d, "payload_sha256")
    return marked.groupBy("payload_sha256").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.when(~F.col("is_exact_duplicate"), F.col("source_ordinal"))).alias("kept"),
        F.count_if("is_exact_duplicate").alias("duplicates")).where("copies > 1")


@query("canonical_json", """
SELECT count(*) AS records, count(DISTINCT props) AS distinct_payloads, 0::BIGINT AS unstable FROM events""")
def canonical_json(spark, folder):
    """Key order must not change the canonical text, so nor its hash."""
    e = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k"))
    text = lambda a, b: F.concat(F.lit("{"), a, F.lit(", "), b, F.lit("}"))
    k, z = F.concat(F.lit('"k": '), "k"), F.lit('"a": [1,  2]')
    both = e.select(
        ingest.canonical_json(F.parse_json(text(k, z))).alias("x"), ingest.canonical_json(F.parse_json(text(z, k))).alias("y"))
    return both.agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct(F.sha2("x", 256)).alias("distinct_payloads"),
        F.count_if(F.sha2("x", 256) != F.sha2("y", 256)).alias("unstable"))


# --- contract checks ---------------------------------------------------------------------------------

@query("uniqueness", """
SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def uniqueness(spark, folder):
    return checks.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("orphans", """
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def orphans(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey")
    placed = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return checks.orphans(customers, placed, "c_custkey")


@query("fk_check", """
SELECT 'lineitem' AS child, 'l_orderkey' AS key, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'supplier', 's_nationkey', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'documents', 'doc_id', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def fk_check(spark, folder):
    t = lambda n: table(spark, folder, n)
    refs = (
        ("lineitem", "l_orderkey", t("lineitem").select("l_orderkey"), t("orders").select(F.col("o_orderkey").alias("l_orderkey"))),
        ("supplier", "s_nationkey", t("supplier").select("s_nationkey"), t("nation").select(F.col("n_nationkey").alias("s_nationkey"))),
        ("documents", "doc_id", t("documents").select("doc_id"), t("labels").select("doc_id")),
    )
    rows = [
        checks.orphan_count(child, parent, key).select(
            F.lit(name).alias("child"), F.lit(key).alias("key"), "orphans") for name, key, child, parent in refs]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("identity_check", """
SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE (o_custkey % 26) <> c_nationkey""")
def identity_check(spark, folder):
    """Orders carry a copied nation that follows a rule; customers hold the true one."""
    child = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_custkey") % 26).cast("int").alias("copied_nation"))
    return checks.identity_mismatches(child, table(spark, folder, "customer"), "c_custkey", {"copied_nation": "c_nationkey"}).select("o_orderkey")


@query("enriched_view", """
SELECT source || '-' || (d.doc_id % 7) AS branch_id, count(*) AS reviews, count(lang) AS with_language, 0::BIGINT AS responses,
       sum(CASE quality WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 3 END)::BIGINT AS stars
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def enriched_view(spark, folder):
    r = document_reviews(spark, folder).withColumn("branch_id", F.concat_ws("-", "brand_name", "branch_id"))
    branches = r.select("branch_id").distinct().withColumns(
        {"branch_label": F.col("branch_id"), "city": F.lit("c"), "neighbourhood": F.lit("n")})
    return rv.enriched(r, branches).groupBy("branch_id").agg(
        F.count(F.lit(1)).alias("reviews"), F.count("original_language").alias("with_language"),
        F.sum("has_owner_response").alias("responses"), F.sum("stars").alias("stars"))


@query("domain_checks", """
SELECT 'discount' AS rule, count_if(NOT l_discount <= 0.05)::BIGINT AS violations FROM lineitem
UNION ALL SELECT 'quantity', count_if(NOT l_quantity BETWEEN 1 AND 40)::BIGINT FROM lineitem
UNION ALL SELECT 'flag', count_if(l_returnflag NOT IN ('A', 'N'))::BIGINT FROM lineitem
UNION ALL SELECT 'ship_year', count_if(NOT year(l_shipdate) < 2000)::BIGINT FROM lineitem""")
def domain_checks(spark, folder):
    return checks.domain_violations(table(spark, folder, "lineitem"), {
        "discount": F.col("l_discount") <= 0.05, "quantity": F.col("l_quantity").between(1, 40),
        "flag": F.col("l_returnflag").isin("A", "N"), "ship_year": F.year("l_shipdate") < 2000})


@query("reconcile_counts", """
SELECT 'nation' AS name, 25::BIGINT AS expected, count(*) AS found, count(*) = 25 AS matches FROM nation
UNION ALL SELECT 'region', 6, count(*), count(*) = 6 FROM region
UNION ALL SELECT 'orders', 15000, count(*), count(*) = 15000 FROM orders""")
def reconcile_counts(spark, folder):
    names = {"nation": 25, "region": 6, "orders": 15000}
    return checks.reconcile_counts({n: table(spark, folder, n) for n in names}, names)


@query("required_keys", """
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'k,note' ELSE 'note' END AS missing FROM events WHERE event_id % 2 = 0""")
def required_keys(spark, folder):
    """Properties lose their key on every sixth event and never hold a note on even ones."""
    e = table(spark, folder, "events")
    props = F.when(F.col("event_id") % 6 == 0, "{}").when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(
        F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "note": null}')))
    records = e.select("event_id", F.parse_json(props).alias("v"))
    fields = {k: F.try_variant_get("v", f"$.{k}", "variant") for k in ("k", "note")}
    return checks.missing_keys(records, fields).select("event_id", F.array_join("missing", ",").alias("missing"))


def _clock_text(folder_df):
    """Times as text; every eighth is no time, every ninth is missing."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return folder_df.select("event_id", F.when(F.col("event_id") % 9 == 0, F.lit(None)).when(
        F.col("event_id") % 8 == 0, F.concat(F.lit("no-"), text)).otherwise(text).alias("at"))


@query("bad_timestamps", "SELECT event_id FROM events WHERE event_id % 9 = 0 OR event_id % 8 = 0")
def bad_timestamps(spark, folder):
    return checks.invalid_timestamps(_clock_text(table(spark, folder, "events")), "at").select("event_id")


@query("iso_validity", """
SELECT event_id FROM events WHERE event_id % 9 <> 0 AND (event_id % 8 = 0 OR event_id % 7 IN (1, 2, 3, 4))""")
def iso_validity(spark, folder):
    rows = _clock_text(table(spark, folder, "events"))
    # Shapes that are no ISO-8601 time, and one (without hyphens) that is.
    forms = F.when(F.col("event_id") % 8 == 0, F.col("at"))
    for rest, form in ((1, "2026"), (2, "2026-07"), (3, "2026-7-1"), (4, "T10:00"), (5, "20260701")):
        forms = forms.when(F.col("at").isNotNull() & (F.col("event_id") % 7 == rest), F.lit(form))
    return checks.invalid_iso8601(rows.withColumn("at", forms.otherwise(F.col("at"))), "at", nullable=True).select("event_id")


@query("conflicting_payloads", """
SELECT l_orderkey AS key, count(*) AS rows FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1""")
def conflicting_payloads(spark, folder):
    l = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key"), F.sha2(F.col("l_suppkey").cast("string"), 256).alias("h"))
    return checks.conflicting_payloads(l, "key", "h").select("key", "rows")


@query("id_set_diff", """
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'left_only' ELSE 'right_only' END AS side
FROM (SELECT doc_id FROM documents WHERE doc_id % 10 <> 3) a FULL JOIN labels b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL""")
def id_set_diff(spark, folder):
    docs = table(spark, folder, "documents").where("doc_id % 10 <> 3")
    return checks.id_set_difference(docs, table(spark, folder, "labels"), "doc_id")


@query("row_count_equality", """
SELECT (SELECT count(*) FROM orders) AS rows_in, (SELECT count(*) FROM customer) AS rows_out,
       (SELECT count(*) FROM orders) = (SELECT count(*) FROM customer) AS matches""")
def row_count_equality(spark, folder):
    return checks.row_count_difference(table(spark, folder, "orders"), table(spark, folder, "customer"))


@query("quality_summary", """
WITH d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents)
SELECT 'unique_review_ids' AS counter, count(*) AS value FROM documents UNION ALL SELECT 'reviews_without_text', count_if(trim(text) = '')::BIGINT FROM documents
UNION ALL SELECT 'record_language_ar', 0 UNION ALL SELECT 'detected_arabic_text', 0
UNION ALL SELECT 'detected_english_text', count_if(lang = 'en')::BIGINT FROM documents UNION ALL SELECT 'unknown_original_language', count_if(lang IS NULL)::BIGINT FROM documents
UNION ALL SELECT 'source_review_rows', count(*) FROM documents UNION ALL SELECT 'exact_duplicate_source_rows', count_if(n > 1)::BIGINT FROM d
UNION ALL SELECT 'branches', count(DISTINCT doc_id % 5) FROM documents UNION ALL SELECT 'orphan_reviews', count_if(doc_id % 7 >= 5)::BIGINT FROM documents""")
def quality_summary(spark, folder):
    """Documents as reviews of seven branches of which two are unknown."""
    r = document_reviews(spark, folder)
    branches = r.where("branch_id < 5").select("branch_id").distinct()
    source = ingest.mark_duplicates(table(spark, folder, "documents").select(
        F.sha2("text", 256).alias("h"), F.lit("f").alias("source_file"), F.col("doc_id").alias("source_ordinal")), "h")
    return rv.data_quality(r, branches, source)
