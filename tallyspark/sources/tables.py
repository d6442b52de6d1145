"""Loading of parquet tables, and their projection onto the library's input frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import pin_utc, spread

_SCHEMAS: dict[str, object] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table; zone-less times become timestamps of the (UTC) session once."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    reader = pin_utc(spark).read
    if path in _SCHEMAS:  # footers are read once per table and process
        reader = reader.schema(_SCHEMAS[path])
    df = reader.parquet(path)
    _SCHEMAS.setdefault(path, df.schema)
    ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def _minutes_after(start: str, minutes) -> F.Column:
    return F.timestamp_micros(F.unix_micros(start) + (minutes * F.lit(60_000_000)).cast("long"))


def order_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The raw operations contract over line items.

    created = order date, delivered = ship date, branch = supplier nation, zone =
    supplier, rider = customer; trip times, ratings and comments follow from the
    line's quantity, tax, discount and flags.
    """
    line, orders = spread(table(spark, folder, "lineitem")), table(spark, folder, "orders")
    supplier, nation = table(spark, folder, "supplier"), table(spark, folder, "nation")
    joined = (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
    )
    added = _minutes_after("o_orderdate", F.col("l_quantity") * 10)
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("OrderID"),
        F.col("o_custkey").cast("string").alias("CustomerID"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Late "), F.lower("o_orderpriority")))
        .when(F.col("l_returnflag") == "A", F.lower("o_orderpriority")).alias("CustomerComment"),
        (F.round(F.col("l_discount") * 100).cast("int") % 5 + 1).cast("double").alias("CustomerRatingAverage"),
        F.col("n_name").alias("BranchID"),
        F.col("s_name").alias("DeliveryZoneName"),
        F.concat(F.lit("R"), F.col("o_custkey")).alias("RiderID"),
        F.col("l_extendedprice").alias("Amount"),
        F.col("o_orderdate").alias("CreatedDate"),
        F.col("o_orderdate").alias("ShiftDate"),
        F.col("l_shipdate").alias("DeliveryTime"),
        F.when(F.col("l_linestatus") == "F", added).alias("AddedToTripTime"),
        _minutes_after("o_orderdate", F.col("l_quantity") * 10 + F.round(F.col("l_tax") * 1000) - 20)
        .alias("PickingUpTime"),
    )


def event_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The prepared operations contract over events, which carry real hours of the day."""
    e = table(spark, folder, "events")
    delivered = F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 60_000_000).cast("long"))
    return e.select(
        F.col("event_id").cast("string").alias("OrderID"),
        F.col("user_id").cast("string").alias("CustomerID"),
        F.when(F.col("event_type") == "error", F.lit("order came late")).alias("CustomerComment"),
        (F.col("event_id") % 5 + 1).cast("double").alias("CustomerRatingAverage"),
        F.col("event_type").alias("BranchID"),
        F.col("props").alias("DeliveryZoneName"),
        F.col("user_id").cast("string").alias("RiderID"),
        F.col("value").alias("Amount"),
        F.col("ts").alias("CreatedDate"),
        F.col("ts").alias("ShiftDate"),
        F.when(F.col("value") >= 5, delivered).alias("DeliveryTime"),
        F.lit(None).cast("timestamp").alias("AddedToTripTime"),
        F.lit(None).cast("timestamp").alias("PickingUpTime"),
    )


def event_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews over events: brand = type, reviewer = user, branch = the ``k`` of the properties."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("review_id"),
        F.col("event_type").alias("brand_name"),
        F.get_json_object("props", "$.k").cast("int").alias("branch_id"),
        F.col("user_id").alias("reviewer_id"),
        F.lit(None).cast("string").alias("review_text"),
        F.least(F.lit(5), F.floor(F.col("value") / 30).cast("int") + 1).alias("stars"),
        F.col("ts").alias("published_at"),
        F.when(F.col("value") > 100, F.lit("thanks")).alias("owner_response_text"),
        "value",
    )


def document_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Text reviews: brand = source, stars from the quality label (3 where there is none)."""
    docs, labels = spread(table(spark, folder, "documents")), table(spark, folder, "labels")
    stars = F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 5).otherwise(3)
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("review_id"),
        F.col("source").alias("brand_name"),
        (F.col("doc_id") % 7).alias("branch_id"),
        (F.col("doc_id") % 50).alias("reviewer_id"),
        F.col("text").alias("review_text"),
        stars.alias("stars"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 3600).alias("published_at"),
        F.lit(None).cast("string").alias("owner_response_text"),
        F.col("lang").alias("original_language"),
        F.col("lang").alias("record_language"),
    )


def brands_of(reviews: DataFrame) -> DataFrame:
    return reviews.select("brand_name").distinct()


def chat_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of the conversations table: ``user`` is the customer, the rest is the brand."""
    c = table(spark, folder, "conversations")
    return c.select(
        F.col("conv_id").alias("conversation_index"), (F.col("conv_id") % 10).alias("seed_id"),
        F.lit("chat").alias("platform"), F.col("turn").alias("turn_index"),
        F.when(F.col("role") == "user", "customer").otherwise("brand").alias("author"),
        "text", (F.col("turn") * 3).alias("gap_minutes"),
    )
