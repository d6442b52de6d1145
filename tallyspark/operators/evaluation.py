"""Reproducible evaluation samples and weighted classification metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.hashing import EVALUATION_SEED, conversation_split, stable_key
from ..functions.rules import INTENTS, TRIAGE_LABELS, triage_label
from ..functions.stats import ratio
from ..functions.text import language_tag, sheet_safe
from . import checks
from .conversations import customer_messages, history_text, with_history
from .distributed import first_n_per_group

# --- fixed values: quotas, headers, review states ---------------------------------------------
QUOTAS = {
    "calibration": {
        "urgent escalation": 3, "spam": 20, "refund request": 24, "compliment": 36, "complaint": 40,
        "order inquiry": 77,
    },
    "heldout": {
        "urgent escalation": 8, "spam": 80, "refund request": 96, "compliment": 144, "complaint": 160,
        "order inquiry": 312,
    },
}
SPLIT_PREFIX = {"calibration": "CAL", "heldout": "TEST"}
REVIEW_HEADERS = (
    "evaluation_id", "split", "message_id", "conversation_index", "seed_id", "turn_index", "platform", "language",
    "available_history", "current_message", "gold_intent", "gold_is_urgent", "reviewer_status", "reviewer_notes",
)
MANIFEST_HEADERS = (
    "evaluation_id", "split", "message_id", "predicted_intent", "predicted_is_urgent", "predicted_triage_label",
    "decision_source", "confidence_band", "sampling_stratum", "population_count", "sample_count", "sampling_weight",
    "configuration_hash",
)
REVIEW_STATUSES = ("reviewed", "adjudicated")
# --------------------------------------------------------------------------------------------------

Quotas = Mapping[str, Mapping[str, int]]


def quota_table(spark: SparkSession, quotas: Quotas = QUOTAS) -> DataFrame:
    """(split, triage_label, quota): a handful of configured rows."""
    rows = [(s, label, int(n)) for s, labels in quotas.items() for label, n in labels.items()]
    return spark.createDataFrame(rows, "split string, triage_label string, quota long")


def assign_split(classified: DataFrame, seed: int = EVALUATION_SEED) -> DataFrame:
    return classified.withColumn("split", conversation_split(F.col("conversation_index"), seed))


def population_counts(split_rows: DataFrame) -> DataFrame:
    return split_rows.groupBy("split", "triage_label").agg(F.count(F.lit(1)).alias("population_count"))


def shortages(split_rows: DataFrame, quotas: Quotas = QUOTAS) -> DataFrame:
    """Strata with fewer candidates than their quota."""
    wanted = quota_table(split_rows.sparkSession, quotas)
    return wanted.join(population_counts(split_rows), ["split", "triage_label"], "left").select(
        "split", "triage_label", "quota", F.coalesce("population_count", F.lit(0)).alias("found")
    ).where("found < quota")


def stratified_sample(
    classified: DataFrame, quotas: Quotas = QUOTAS, seed: int = EVALUATION_SEED
) -> DataFrame:
    """The frozen quota per (split, label), chosen by stable hash, with inverse-probability weights.

    Every map task keeps at most the largest quota per stratum before anything moves.
    """
    rows = assign_split(classified, seed)
    order = stable_key(F.lit(seed), F.col("split"), F.col("triage_label"), F.col("message_id"))
    largest = max(n for labels in quotas.values() for n in labels.values())
    ranked = first_n_per_group(
        rows.withColumn("__key", order), ["split", "triage_label"], [F.col("__key"), F.col("message_id")], largest)
    limits = F.broadcast(quota_table(rows.sparkSession, quotas))
    return (
        ranked.join(limits, ["split", "triage_label"]).where(F.col("rank") <= F.col("quota"))
        .join(population_counts(rows), ["split", "triage_label"])
        .withColumn("sampling_weight", F.round(F.col("population_count") / F.col("quota"), 8))
        .drop("__key", "rank").withColumnRenamed("quota", "sample_count")
    )


def with_evaluation_ids(sample: DataFrame, seed: int = EVALUATION_SEED) -> DataFrame:
    """CAL-0001 / TEST-0001 in hash order; the sample is as small as its quotas."""
    order = stable_key(F.lit(seed), F.col("split"), F.col("message_id"))
    w = W.partitionBy("split").orderBy(order, "message_id")
    prefix = F.when(F.col("split") == "calibration", SPLIT_PREFIX["calibration"]).otherwise(SPLIT_PREFIX["heldout"])
    return sample.withColumn("evaluation_id", F.format_string("%s-%04d", prefix, F.row_number().over(w)))


def prepare(
    turns: DataFrame, classified: DataFrame, configuration_hash: str, quotas: Quotas = QUOTAS,
    seed: int = EVALUATION_SEED, check: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(blinded review queue, manifest). Predictions appear in the manifest alone.

    Text and history are looked up for the sample only, never for the population.
    """
    messages = customer_messages(turns)
    if check:
        checks.require_none(
            checks.id_set_difference(messages, classified, "message_id"),
            "classification ids do not match eligible message ids")
        checks.require_none(shortages(assign_split(classified, seed), quotas), "insufficient candidates")
    sample = with_evaluation_ids(stratified_sample(classified, quotas, seed), seed)
    if check:
        checks.require_none(checks.group_leaks(sample, "conversation_index", "split"), "conversation leakage")
    manifest = sample.select(
        "evaluation_id", "split", "message_id",
        F.col("intent").alias("predicted_intent"), F.col("is_urgent").cast("string").alias("predicted_is_urgent"),
        F.col("triage_label").alias("predicted_triage_label"), "decision_source", "confidence_band",
        F.col("triage_label").alias("sampling_stratum"), "population_count", "sample_count",
        F.format_string("%.8f", "sampling_weight").alias("sampling_weight"),
        F.lit(configuration_hash).alias("configuration_hash"),
    )
    chosen = sample.select("evaluation_id", "split", "message_id").join(messages, "message_id")
    review = with_history(chosen, turns).select(
        "evaluation_id", "split", "message_id", "conversation_index", "seed_id", "turn_index", "platform",
        language_tag(F.col("text")).alias("language"),
        sheet_safe(history_text(F.col("history"))).alias("available_history"),
        sheet_safe(F.col("text")).alias("current_message"),
        *[F.lit("").alias(c) for c in ("gold_intent", "gold_is_urgent", "reviewer_status", "reviewer_notes")],
    )
    return review.select(*REVIEW_HEADERS), manifest.select(*MANIFEST_HEADERS)


# --- metrics -------------------------------------------------------------------------------------------

def confusion_matrix(rows: DataFrame, gold: str, predicted: str, labels: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Dense (gold, predicted, weight) with zero cells."""
    weighed = F.sum(weight.cast("double")) if weight is not None else F.count(F.lit(1)).cast("double")
    seen = rows.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(weighed.alias("n"))
    names = F.array(*[F.lit(x) for x in labels])
    grid = (
        rows.sparkSession.range(1).select(F.explode(names).alias("gold"))
        .select("gold", F.explode(names).alias("predicted"))
    )
    # The grid has len(labels) squared rows.
    return F.broadcast(grid).join(seen, ["gold", "predicted"], "left").select(
        "gold", "predicted", F.coalesce("n", F.lit(0.0)).alias("n"))


def classification_metrics(rows: DataFrame, gold: str, predicted: str, labels: Sequence[str], weight: Column | None = None) -> DataFrame:
    """One row per label plus the overall accuracy and macro F1 on every row.

    A single aggregation over (gold, predicted) feeds all margins; labels nobody used
    count with F1 = 0.
    """
    weighed = F.sum(weight.cast("double")) if weight is not None else F.count(F.lit(1)).cast("double")
    cells = rows.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(weighed.alias("n"))
    per = {}
    for i, label in enumerate(labels):
        g, p = F.col("g") == label, F.col("p") == label
        zero = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0.0))
        per[label] = (zero(g & p).alias(f"tp{i}"), zero(~g & p).alias(f"fp{i}"), zero(g & ~p).alias(f"fn{i}"))
    wide = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("g") == F.col("p"), F.col("n"))), F.lit(0.0)).alias("correct"),
        *[c for trio in per.values() for c in trio],
    )
    rows_of = F.explode(F.array(*[
        F.struct(F.lit(label).alias("label"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
                 F.col(f"fn{i}").alias("fn"))
        for i, label in enumerate(labels)
    ]))
    tall = wide.select("total", "correct", rows_of.alias("m")).select("total", "correct", "m.*")
    tall = tall.withColumns({
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
    })
    tall = tall.withColumn(
        "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    everything = W.partitionBy(F.lit(0))  # one row per configured label
    return tall.select(
        "label", "precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support"),
        ratio(F.col("correct"), F.col("total")).alias("accuracy"),
        (F.sum("f1").over(everything) / len(labels)).alias("macro_f1"),
    )


def binary_metrics(rows: DataFrame, gold: str, predicted: str, weight: Column | None = None) -> DataFrame:
    w = weight.cast("double") if weight is not None else F.lit(1.0)
    g, p = F.col(gold), F.col(predicted)
    add = lambda cond: F.coalesce(F.sum(F.when(cond, w)), F.lit(0.0))
    frame = rows.agg(
        add(g & p).alias("true_positive"), add(~g & p).alias("false_positive"), add(g & ~p).alias("false_negative"))
    tp, fp, fn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return frame.select(
        precision.alias("precision"), recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"), (tp + fn).alias("support"),
        "true_positive", "false_positive", "false_negative",
    )


# --- scoring completed reviews ------------------------------------------------------------------------

def _flag(text: Column) -> Column:
    clean = F.lower(F.trim(text.cast("string")))
    return F.when(clean == "true", True).when(clean == "false", False)


def incomplete_gold(reviews: DataFrame) -> DataFrame:
    """Reviews without a valid intent, urgency flag or finished status."""
    good = (
        F.trim("gold_intent").isin(*INTENTS) & _flag(F.col("gold_is_urgent")).isNotNull()
        & F.lower(F.trim("reviewer_status")).isin(*REVIEW_STATUSES)
    )
    return reviews.where(~F.coalesce(good, F.lit(False))).select("evaluation_id")


def scored_rows(reviews: DataFrame, manifest: DataFrame) -> DataFrame:
    """Reviews joined with their predictions, typed and labelled."""
    predictions = manifest.select(
        "evaluation_id", "predicted_intent", _flag(F.col("predicted_is_urgent")).alias("predicted_is_urgent"),
        "predicted_triage_label", "sampling_stratum", F.col("sampling_weight").cast("double").alias("sampling_weight"),
    )
    gold = reviews.withColumns({
        "gold_intent": F.trim("gold_intent"), "gold_is_urgent": _flag(F.col("gold_is_urgent"))})
    return gold.join(predictions, "evaluation_id").withColumn(
        "gold_triage_label", triage_label(F.col("gold_intent"), F.col("gold_is_urgent")))


def check_reviews(reviews: DataFrame, manifest: DataFrame, split: str, quotas: Quotas = QUOTAS) -> None:
    """Everything that must hold before a review file may be scored."""
    if split not in quotas:
        raise checks.ContractError(f"unknown evaluation split: {split}")
    checks.require_none(checks.duplicate_keys(reviews, ["evaluation_id"]), "duplicate evaluation ids in the reviews")
    checks.require_none(checks.duplicate_keys(manifest, ["evaluation_id"]), "duplicate evaluation ids in the manifest")
    checks.require_none(
        checks.id_set_difference(reviews, manifest, "evaluation_id"), "review and manifest evaluation ids do not match")
    checks.require_none(reviews.where(F.col("split") != split).select("evaluation_id"), f"rows outside the {split} split")
    wanted = quota_table(reviews.sparkSession, {split: quotas[split]}).select(
        F.col("triage_label").alias("sampling_stratum"), "quota")
    checks.require_none(
        checks.quota_gaps(manifest, ["sampling_stratum"], wanted), "manifest strata do not match the frozen quotas")
    mismatch = reviews.select("evaluation_id", "message_id").join(
        manifest.select("evaluation_id", F.col("message_id").alias("m")), "evaluation_id").where("message_id <> m")
    checks.require_none(mismatch.select("evaluation_id"), "review/manifest mismatch")
    missing = incomplete_gold(reviews)
    checks.require_none(missing.orderBy("evaluation_id"), "rows are missing valid gold labels/reviewer status")


def score(reviews: DataFrame, manifest: DataFrame, split: str, quotas: Quotas = QUOTAS) -> tuple[DataFrame, DataFrame]:
    """(report, error rows). The report has one row per measure, target, label and weighting."""
    mine = manifest.where(F.col("split") == split)
    check_reviews(reviews, mine, split, quotas)
    rows = scored_rows(reviews, mine)
    weight = F.col("sampling_weight")
    parts = []
    for target, gold, predicted, labels in (
        ("triage", "gold_triage_label", "predicted_triage_label", TRIAGE_LABELS),
        ("intent", "gold_intent", "predicted_intent", INTENTS),
    ):
        for weighting, w in (("rows", None), ("population", weight)):
            parts.append(classification_metrics(rows, gold, predicted, labels, w).select(
                F.lit(target).alias("target"), F.lit(weighting).alias("weighting"), "label", "precision", "recall",
                "f1", "support", "accuracy", "macro_f1"))
    for weighting, w in (("rows", None), ("population", weight)):
        parts.append(binary_metrics(rows, "gold_is_urgent", "predicted_is_urgent", w).select(
            F.lit("urgency").alias("target"), F.lit(weighting).alias("weighting"), F.lit("urgent").alias("label"),
            "precision", "recall", "f1", "support", F.lit(None).cast("double").alias("accuracy"),
            F.lit(None).cast("double").alias("macro_f1")))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report, error_rows(rows)


ERROR_COLUMNS = (
    "evaluation_id", "message_id", "gold_intent", "predicted_intent", "gold_is_urgent", "predicted_is_urgent",
    "gold_triage_label", "predicted_triage_label", "reviewer_notes",
)


def error_rows(scored: DataFrame) -> DataFrame:
    return scored.where("gold_triage_label <> predicted_triage_label").select(*ERROR_COLUMNS)
