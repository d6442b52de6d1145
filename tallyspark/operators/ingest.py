"""Review exports to relational tables, with lineage and declared constraints.

Records arrive as variants with file and ordinal. They are typed once, written to
the shared folder, and every entity table is a column-pruned select of that.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import canonical_json
from ..session import cut_lineage
from ..sources import readers, sinks
from . import checks
from .checks import ContractError

SCHEMA_VERSION = 1

# --- fixed values: source fields -> table columns --------------------------------------------------
BRANCH_REQUIRED = ("brand", "branch_id", "title", "city", "neighbourhood", "branch_label", "scrapedAt")
REVIEW_REQUIRED = (
    "brand", "branch_id", "branch_label", "city", "review_id", "reviewer_id", "stars", "publishedAtDate", "scrapedAt",
)
BRANCH_FIELDS = {
    "branch_id": ("branch_id", "string"), "brand_name": ("brand", "string"), "title": ("title", "string"),
    "subtitle": ("subTitle", "string"), "city": ("city", "string"), "neighbourhood": ("neighbourhood", "string"),
    "branch_label": ("branch_label", "string"), "category_name": ("categoryName", "string"),
    "total_score": ("totalScore", "double"), "reviews_count": ("reviewsCount", "long"),
    "images_count": ("imagesCount", "long"), "popular_times_live_text": ("popularTimesLiveText", "string"),
    "popular_times_live_percent": ("popularTimesLivePercent", "long"), "scraped_at": ("scrapedAt", "string"),
    "language": ("language", "string"),
}
BRANCH_NESTED = {
    "categories": "array<string>",
    "reviewsDistribution": "struct<oneStar long, twoStar long, threeStar long, fourStar long, fiveStar long>",
    "openingHours": "array<struct<day string, hours string>>",
    "popularTimesHistogram": "map<string, array<struct<hour long, occupancyPercent long>>>",
    "additionalInfo": "map<string, array<map<string, boolean>>>",
    "placesTags": "array<struct<title string, count long>>",
    "reviewsTags": "array<struct<title string, count long>>",
}
STAR_LABELS = ("oneStar", "twoStar", "threeStar", "fourStar", "fiveStar")
REVIEW_FIELDS = {
    "review_id": ("review_id", "string"), "brand_name": ("brand", "string"), "branch_id": ("branch_id", "string"),
    "source_branch_label": ("branch_label", "string"), "source_city": ("city", "string"),
    "reviewer_id": ("reviewer_id", "string"), "reviewer_number_of_reviews": ("reviewerNumberOfReviews", "long"),
    "is_local_guide": ("isLocalGuide", "boolean"), "review_text": ("text", "string"),
    "translated_text": ("textTranslated", "string"), "owner_response_text": ("responseFromOwnerText", "string"),
    "owner_response_date": ("responseFromOwnerDate", "string"), "stars": ("stars", "long"),
    "alternate_rating": ("rating", "long"), "likes_count": ("likesCount", "long"),
    "relative_publish_text": ("publishAt", "string"), "published_at": ("publishedAtDate", "string"),
    "visited_in": ("visitedIn", "string"), "original_language": ("originalLanguage", "string"),
    "translated_language": ("translatedLanguage", "string"), "is_advertisement": ("isAdvertisement", "boolean"),
    "category_name": ("categoryName", "string"), "source_total_score": ("totalScore", "double"),
    "source_reviews_count": ("reviewsCount", "long"), "scraped_at": ("scrapedAt", "string"),
    "record_language": ("language", "string"),
}
REVIEW_NESTED = {
    "categories": "array<string>", "reviewContext": "map<string, variant>", "reviewDetailedRating": "map<string, double>",
}
VARIANT_TYPE_NAMES = (("STRING", "str"), ("BOOLEAN", "bool"), ("ARRAY", "list"), ("OBJECT", "dict"), ("VOID", "NoneType"),
                      ("DECIMAL", "float"), ("DOUBLE", "float"), ("FLOAT", "float"))
# -------------------------------------------------------------------------------------------------------


def _get(path: str, data_type: str) -> Column:
    return F.try_variant_get("record", f"$.{path}", data_type)


def with_lineage(records: DataFrame) -> DataFrame:
    """Adds the canonical JSON of the record and its hash."""
    raw = records.withColumn("raw_json", canonical_json(F.col("record")))
    return raw.withColumn("payload_sha256", F.sha2("raw_json", 256))


def _missing(required: tuple[str, ...]) -> Column:
    return F.filter(
        F.array(*[F.when(_get(k, "variant").isNull(), F.lit(k)) for k in sorted(required)]), lambda k: k.isNotNull())


def type_branches(records: DataFrame) -> DataFrame:
    return with_lineage(records).select(
        "source_file", "source_ordinal", "payload_sha256", "raw_json", _missing(BRANCH_REQUIRED).alias("missing"),
        *[_get(path, t).alias(c) for c, (path, t) in BRANCH_FIELDS.items()],
        *[_get(path, t).alias(path) for path, t in BRANCH_NESTED.items()],
    )


def type_reviews(records: DataFrame) -> DataFrame:
    """Typed reviews; absent likes count as 0 and absent flags as false."""
    typed = with_lineage(records).select(
        "source_file", "source_ordinal", "payload_sha256", "raw_json", _missing(REVIEW_REQUIRED).alias("missing"),
        *[_get(path, t).alias(c) for c, (path, t) in REVIEW_FIELDS.items()],
        *[_get(path, t).alias(path) for path, t in REVIEW_NESTED.items()],
    )
    return typed.withColumns({
        "likes_count": F.coalesce("likes_count", F.lit(0)).cast("long"),
        "is_local_guide": F.coalesce("is_local_guide", F.lit(False)),
        "is_advertisement": F.coalesce("is_advertisement", F.lit(False)),
    })


def first_occurrences(typed: DataFrame, key: str = "review_id") -> DataFrame:
    """(source_file, source_ordinal) of the first record per key, in file then ordinal order.

    The minimum is found by aggregation, so a record copied a billion times costs one
    row per map task; the pair then identifies the row, and joins on it are never skewed.
    """
    first = typed.groupBy(key).agg(F.min(F.struct("source_file", "source_ordinal")).alias("f"))
    return first.select("f.source_file", "f.source_ordinal")


def mark_duplicates(typed: DataFrame, key: str = "review_id") -> DataFrame:
    firsts = first_occurrences(typed, key).withColumn("__first", F.lit(True))
    return typed.join(firsts, ["source_file", "source_ordinal"], "left").withColumn(
        "is_exact_duplicate", F.col("__first").isNull()).drop("__first")


def review_violations(typed: DataFrame, branches: DataFrame) -> dict[str, DataFrame]:
    """Offending records by contract rule."""
    lineage = ["source_file", "source_ordinal"]
    return {
        "missing required fields": typed.where(F.size("missing") > 0).select(*lineage, "missing"),
        "publishedAtDate is not ISO-8601": checks.invalid_iso8601(typed, "published_at").select(*lineage),
        "scrapedAt is not ISO-8601": checks.invalid_iso8601(typed, "scraped_at").select(*lineage),
        "responseFromOwnerDate is not ISO-8601":
            checks.invalid_iso8601(typed, "owner_response_date", nullable=True).select(*lineage),
        "conflicting payloads share a review_id":
            checks.conflicting_payloads(typed, "review_id", "payload_sha256").select("review_id"),
        "orphan review": checks.orphans(typed, branches, "branch_id").select("review_id", "branch_id"),
        "review disagrees with its branch": checks.identity_mismatches(
            typed.select("review_id", "branch_id", F.col("brand_name").alias("b"), "source_branch_label", "source_city"),
            branches, "branch_id",
            {"b": "brand_name", "source_branch_label": "branch_label", "source_city": "city"}).select("review_id"),
        "domain": _domain_breaks(checks.domain_violations(typed, REVIEW_RULES)),
    }


def branch_violations(typed: DataFrame) -> dict[str, DataFrame]:
    lineage = ["source_file", "source_ordinal"]
    return {
        "missing required fields": typed.where(F.size("missing") > 0).select(*lineage, "missing"),
        "scrapedAt is not ISO-8601": checks.invalid_iso8601(typed, "scraped_at").select(*lineage),
        "branch_id is not unique": checks.duplicate_keys(typed, ["branch_id"]),
        "domain": _domain_breaks(checks.domain_violations(typed, BRANCH_RULES)),
    }


def _domain_breaks(counts: DataFrame) -> DataFrame:
    return counts.where("violations > 0")


def _not_null(columns: tuple[str, ...]) -> str:
    return " and ".join(f"{c} is not null" for c in columns)


REVIEW_RULES = {
    "required_not_null": _not_null((
        "review_id", "brand_name", "branch_id", "source_branch_label", "source_city", "reviewer_id", "stars",
        "published_at", "scraped_at")),
    "stars_1_to_5": "stars between 1 and 5",
    "alternate_rating_1_to_5": "alternate_rating between 1 and 5",
    "likes_not_negative": "likes_count >= 0",
    "reviewer_reviews_not_negative": "reviewer_number_of_reviews >= 0",
    "total_score_0_to_5": "source_total_score between 0 and 5",
    "reviews_count_not_negative": "source_reviews_count >= 0",
    "hash_has_64_digits": "length(payload_sha256) = 64",
    "ordinal_not_negative": "source_ordinal >= 0",
}
BRANCH_RULES = {
    "required_not_null": _not_null((
        "branch_id", "brand_name", "title", "city", "neighbourhood", "branch_label", "scraped_at")),
    "total_score_0_to_5": "total_score between 0 and 5",
    "reviews_count_not_negative": "reviews_count >= 0",
    "images_count_not_negative": "images_count >= 0",
    "live_percent_0_to_100": "popular_times_live_percent between 0 and 100",
    "hash_has_64_digits": "length(payload_sha256) = 64",
    "ordinal_not_negative": "source_ordinal >= 0",
}


# --- child tables ---------------------------------------------------------------------------------------

def ordinal_rows(df: DataFrame, key: str, array: str, columns: Mapping[str, Column | None]) -> DataFrame:
    """One row per array item with its position. A None column means the item itself."""
    items = df.select(key, F.posexplode(array).alias("ordinal", "item"))
    return items.select(key, "ordinal", *[
        (F.col("item") if c is None else c).alias(name) for name, c in columns.items()])


def star_distribution(branches: DataFrame) -> DataFrame:
    """oneStar..fiveStar unpivoted; absent keys give no row."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("stars"), F.col(f"reviewsDistribution.{label}").alias("review_count"))
        for i, label in enumerate(STAR_LABELS, start=1)])
    return branches.select("branch_id", F.explode(pairs).alias("p")).select("branch_id", "p.*").where(
        F.col("review_count").isNotNull())


def popular_times(branches: DataFrame) -> DataFrame:
    days = branches.select("branch_id", F.explode("popularTimesHistogram").alias("weekday", "hours"))
    return days.select("branch_id", "weekday", F.posexplode("hours").alias("ordinal", "h")).select(
        "branch_id", "weekday", "ordinal", F.col("h.hour").alias("hour"),
        F.col("h.occupancyPercent").alias("occupancy_percent"))


def attributes(branches: DataFrame) -> DataFrame:
    groups = branches.select("branch_id", F.explode("additionalInfo").alias("attribute_group", "items"))
    items = groups.select("branch_id", "attribute_group", F.posexplode("items").alias("item_ordinal", "item"))
    return items.select(
        "branch_id", "attribute_group", "item_ordinal", F.explode("item").alias("attribute_name", "enabled")
    ).withColumn("enabled", F.coalesce("enabled", F.lit(False)))


def variant_type_name(value: Column) -> Column:
    """The source language's name of a JSON value's type."""
    schema = F.schema_of_variant(value)
    named = None
    for prefix, name in VARIANT_TYPE_NAMES:
        hit = schema.startswith(prefix)
        named = F.when(hit, name) if named is None else named.when(hit, name)
    return named.otherwise("int")


def context_rows(df: DataFrame, key: str = "review_id", column: str = "reviewContext") -> DataFrame:
    """An open map as rows: key, type name and JSON of each value."""
    return df.select(key, F.explode(column).alias("context_key", "value")).select(
        key, "context_key",
        F.coalesce(variant_type_name(F.col("value")), F.lit("NoneType")).alias("value_type"),
        F.coalesce(F.to_json("value"), F.lit("null")).alias("json_value"))


def score_rows(df: DataFrame, key: str = "review_id", column: str = "reviewDetailedRating") -> DataFrame:
    return df.select(key, F.explode(column).alias("aspect", "score"))


def menu_items(menus: DataFrame) -> DataFrame:
    """brand -> section -> item -> price. Objects have no order in a variant, so the
    ordinals follow the names."""
    shape = "map<string, map<string, map<string, double>>>"
    named = lambda c: F.array_sort(F.map_keys(c))
    brands = menus.select(F.explode(F.variant_get("record", "$", shape)).alias("brand_name", "sections"))
    sections = brands.select("brand_name", "sections", F.posexplode(named("sections")).alias("section_ordinal", "section_name"))
    items = sections.withColumn("items", F.element_at("sections", F.col("section_name"))).select(
        "brand_name", "section_ordinal", "section_name", "items",
        F.posexplode(named("items")).alias("item_ordinal", "item_name"))
    return items.select(
        "brand_name", "section_ordinal", "section_name", "item_ordinal", "item_name",
        F.element_at("items", F.col("item_name")).alias("price"))


def review_tables(marked: DataFrame) -> dict[str, DataFrame]:
    unique = marked.where(~F.col("is_exact_duplicate"))
    return {
        "reviewers": unique.select("reviewer_id").distinct(),
        "reviews": unique.select(*REVIEW_FIELDS),
        "source_review_records": marked.select(
            "source_file", "source_ordinal", "review_id", "payload_sha256", "is_exact_duplicate", "raw_json"),
        "review_categories": ordinal_rows(unique, "review_id", "categories", {"category": None}),
        "review_context": context_rows(unique),
        "review_detailed_ratings": score_rows(unique),
    }


def branch_tables(typed: DataFrame) -> dict[str, DataFrame]:
    tag = {"title": F.col("item.title"), "tag_count": F.col("item.count")}
    return {
        "brands": typed.select("brand_name").distinct(),
        "branches": typed.select(*BRANCH_FIELDS),
        "source_branch_records": typed.select(
            "source_file", "source_ordinal", "branch_id", "payload_sha256", "raw_json"),
        "branch_categories": ordinal_rows(typed, "branch_id", "categories", {"category": None}),
        "branch_review_distribution": star_distribution(typed),
        "branch_opening_hours": ordinal_rows(
            typed, "branch_id", "openingHours", {"day": F.col("item.day"), "hours": F.col("item.hours")}),
        "branch_popular_times": popular_times(typed),
        "branch_attributes": attributes(typed),
        "branch_place_tags": ordinal_rows(typed, "branch_id", "placesTags", tag),
        "branch_review_tags": ordinal_rows(typed, "branch_id", "reviewsTags", tag),
    }


CHILD_RULES = {
    "branch_review_distribution": {"stars": "stars between 1 and 5", "review_count": "review_count >= 0"},
    "branch_popular_times": {
        "hour": "hour between 0 and 23", "occupancy_percent": "occupancy_percent between 0 and 100"},
    "branch_place_tags": {"tag_count": "tag_count >= 0"},
    "branch_review_tags": {"tag_count": "tag_count >= 0"},
    "review_detailed_ratings": {"score": "score between 1 and 5"},
    "menu_items": {"price": "price >= 0"},
}
FOREIGN_KEYS = (
    ("branches", "brand_name", "brands"), ("reviews", "brand_name", "brands"), ("reviews", "branch_id", "branches"),
    ("reviews", "reviewer_id", "reviewers"), ("source_review_records", "review_id", "reviews"),
    ("source_branch_records", "branch_id", "branches"), ("branch_categories", "branch_id", "branches"),
    ("branch_review_distribution", "branch_id", "branches"), ("branch_opening_hours", "branch_id", "branches"),
    ("branch_popular_times", "branch_id", "branches"), ("branch_attributes", "branch_id", "branches"),
    ("branch_place_tags", "branch_id", "branches"), ("branch_review_tags", "branch_id", "branches"),
    ("review_categories", "review_id", "reviews"), ("review_context", "review_id", "reviews"),
    ("review_detailed_ratings", "review_id", "reviews"), ("menu_items", "brand_name", "brands"),
)


def foreign_key_errors(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(child, key, orphans) for every declared reference."""
    rows = [
        checks.orphan_count(tables[child].select(key), tables[parent], key).select(
            F.lit(child).alias("child"), F.lit(key).alias("key"), "orphans")
        for child, key, parent in FOREIGN_KEYS if child in tables and parent in tables
    ]
    return reduce(DataFrame.unionByName, rows)


def validate(tables: Mapping[str, DataFrame]) -> None:
    """References, counts and value domains of finished tables."""
    checks.require_none(foreign_key_errors(tables).where("orphans > 0"), "Foreign-key validation failed")
    for name, rules in CHILD_RULES.items():
        if name in tables:
            checks.require_none(_domain_breaks(checks.domain_violations(tables[name], rules)), f"{name} out of domain")
    counted = tables["source_review_records"].agg(
        F.count(F.lit(1)).alias("source"), F.count_if("is_exact_duplicate").alias("duplicates")).first()
    agree = checks.reconcile_counts(
        {"reviews": tables["reviews"]}, {"reviews": counted["source"] - counted["duplicates"]})
    checks.require_none(agree.where("not matches"), "Row counts do not reconcile")


def ingest(
    spark: SparkSession, folder: str, dictionary_fields: DataFrame | None = None,
    dictionary_files: DataFrame | None = None, brands: int | None = 3, lines: bool = False,
) -> dict[str, DataFrame]:
    """All tables of one export folder, checked; ``publish`` writes them all or none.

    ``brands`` is how many branch and review files must be there (None: any number).
    """
    if brands is not None:
        readers.require_files(spark, folder, "*_branches.json", brands)
        readers.require_files(spark, folder, "*_reviews.json", brands)
        readers.require_files(spark, folder, "menus.json", 1)
    if not lines:
        for pattern in ("*_branches.json", "*_reviews.json"):
            checks.require_none(readers.not_an_array(spark, folder, pattern), "file must contain a JSON array")
    branch_records = readers.json_records(spark, folder, "*_branches.json", lines)
    review_records = readers.json_records(spark, folder, "*_reviews.json", lines)
    branches = cut_lineage(type_branches(branch_records))
    for rule, rows in branch_violations(branches).items():
        checks.require_none(rows, f"branches: {rule}")
    reviews = cut_lineage(mark_duplicates(type_reviews(review_records)))
    for rule, rows in review_violations(reviews, branches).items():
        checks.require_none(rows, f"reviews: {rule}")
    menus = spark.read.option("singleVariantColumn", "record").option("multiLine", True).option(
        "pathGlobFilter", "menus.json").json(folder)
    tables = {**branch_tables(branches), **review_tables(reviews), "menu_items": menu_items(menus)}
    unknown = checks.orphans(tables["menu_items"].select("brand_name"), tables["brands"], "brand_name")
    checks.require_none(unknown, "Menu references unknown brand")
    per_file = readers.rows_per_file(branches).unionByName(readers.rows_per_file(reviews)).unionByName(
        tables["menu_items"].agg(F.count(F.lit(1)).alias("rows")).select(F.lit("menus.json").alias("source_file"), "rows"))
    tables["ingestion_manifest"] = readers.file_manifest(spark, folder, per_file, "*.json")
    tables["schema_metadata"] = spark.createDataFrame(
        [("schema_version", str(SCHEMA_VERSION)), ("analysis_window", "source-defined trailing 90 days"),
         ("validation_status", "passed")], "key string, value string")
    tables["data_dictionary_fields"] = dictionary_fields if dictionary_fields is not None else spark.createDataFrame(
        [], "entity string, ordinal long, source_field string, declared_type string, description string, "
            "example string, provenance string")
    tables["data_dictionary_files"] = dictionary_files if dictionary_files is not None else spark.createDataFrame(
        [], "ordinal long, file_name string, description string, declared_size string")
    if brands is not None:
        found = tables["brands"].count()
        if found != brands:
            raise ContractError(f"Expected brands={brands}, found {found}")
    return tables


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], path: str) -> dict[str, DataFrame]:
    return sinks.publish(spark, tables, path, validate)


def analysis_reviews(reviews: DataFrame) -> DataFrame:
    """The reviews table with real times, as the benchmark operators expect it."""
    return reviews.withColumn("published_at", F.try_to_timestamp("published_at"))


def entity_counts(dictionary_fields: DataFrame) -> DataFrame:
    return dictionary_fields.groupBy("entity").agg(F.count(F.lit(1)).alias("fields"))
