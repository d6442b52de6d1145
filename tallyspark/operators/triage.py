"""Message triage: rule gate, batched scorer under a spend cap, reconciliation, retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import money
from ..functions.hashing import fingerprint
from ..functions.money import Pricing
from ..functions.rules import DEFAULT_RULES, INTENTS, RuleSet, rule_gate, triage_label
from ..session import cut_lineage, scratch_path
from . import checks
from .conversations import TURNS_PER_PIECE, customer_messages, with_history
from .distributed import id_levels, running_total

# --- fixed values: result shape, sources and anomalies -----------------------------------
RESULT_COLUMNS = (
    "message_id", "conversation_index", "seed_id", "turn_index", "intent", "is_urgent",
    "triage_label", "decision_source", "confidence_band",
)
RULE_SOURCE, RULE_BAND = "rule_gate", "high"
MODEL_SOURCE, MODEL_BAND = "model_fallback", "medium"
UNKNOWN_IDS, DUPLICATE_IDS, MISSING_IDS = "unknown_ids_discarded", "duplicate_ids_retried", "missing_ids_retried"
# -------------------------------------------------------------------------------------------

#: What a scorer returns per request. ``payload`` holds {"id": [...], "i": [...], "u": [...]}.
RESPONSE_SCHEMA = (
    "request_id string, payload string, finish_reason string, prompt_tokens long, "
    "candidate_tokens long, thought_tokens long, total_tokens long"
)
Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


class TriageError(RuntimeError):
    """A run cannot be completed honestly."""


@dataclass(frozen=True)
class TriageConfig:
    batch_size: int = 50
    max_output_tokens: int = 2048
    cap_usd: Decimal = money.DEFAULT_CAP_USD
    pricing: Pricing = field(default_factory=Pricing)
    rules: RuleSet = DEFAULT_RULES
    instructions: str = "Classify each current_message. Use history only as context."
    max_rounds: int = 64

    def __post_init__(self) -> None:
        if self.batch_size < 1:
            raise ValueError("batch_size must be positive")
        if self.max_output_tokens < 1:
            raise ValueError("max_output_tokens must be positive")
        money.checked_cap(self.cap_usd)

    @property
    def prompt_head(self) -> str:
        return f"{self.instructions}\n\nMESSAGES_JSON:\n"


# --- gate and results -------------------------------------------------------------------------

def with_gate(messages: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    return messages.withColumn("gate", rule_gate(F.col("text"), rules))


def classified(decided: DataFrame, source: str, band: str) -> DataFrame:
    """Result rows from message metadata plus (intent, is_urgent)."""
    return decided.select(
        "message_id", "conversation_index", "seed_id", "turn_index", "intent", "is_urgent",
        triage_label(F.col("intent"), F.col("is_urgent")).alias("triage_label"),
        F.lit(source).alias("decision_source"), F.lit(band).alias("confidence_band"),
    )


def rule_results(gated: DataFrame) -> DataFrame:
    hit = gated.where(F.col("gate").isNotNull())
    return classified(
        hit.withColumns({"intent": F.col("gate.intent"), "is_urgent": F.col("gate.is_urgent")}), RULE_SOURCE, RULE_BAND)


def pending(messages: DataFrame, results: DataFrame) -> DataFrame:
    """Messages without a result yet: what a resumed run still has to do."""
    return messages.join(results.select("message_id"), "message_id", "left_anti")


def checkpoint_violations(results: DataFrame, messages: DataFrame) -> DataFrame:
    """(message_id, reason) for stored results that the source does not back."""
    source = messages.select(
        "message_id", *[F.col(c).alias(f"__{c}") for c in ("conversation_index", "seed_id", "turn_index")],
        F.lit(True).alias("__known"),
    )
    differs = reduce(lambda a, b: a | b, [
        ~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("conversation_index", "seed_id", "turn_index")])
    reason = (
        F.when(F.col("__known").isNull(), "unknown message id")
        .when(differs, "source metadata mismatch")
        .when(~F.col("triage_label").eqNullSafe(triage_label(F.col("intent"), F.col("is_urgent"))),
              "derived label mismatch")
    )
    return results.join(source, "message_id", "left").select("message_id", reason.alias("reason")).where(
        F.col("reason").isNotNull())


def invalid_results(results: DataFrame) -> DataFrame:
    """Result rows with an unknown label, source or band, or a missing flag."""
    return results.where(
        ~F.coalesce(F.col("intent").isin(*INTENTS), F.lit(False)) | F.col("is_urgent").isNull()
        | ~F.coalesce(F.col("decision_source").isin(RULE_SOURCE, MODEL_SOURCE), F.lit(False))
        | ~F.coalesce(F.col("confidence_band").isin("low", "medium", "high"), F.lit(False)))


# --- batching, payloads, forecast ---------------------------------------------------------------

def _source_levels() -> dict[str, Column]:
    return {
        **id_levels("conversation_index"),
        "__conversation": F.col("conversation_index"),
        "__piece": F.floor(F.col("turn_index") / TURNS_PER_PIECE).cast("long"),
    }


def number_batches(messages: DataFrame, size: int) -> DataFrame:
    """Consecutive batches of ``size`` in source order.

    The position comes from bucket counts over the dense conversation index, so no
    window ever sees the whole table.
    """
    placed = running_total(messages, [], _source_levels(), ["turn_index"], F.lit(1).cast("long"), "position")
    return placed.withColumn("batch", F.floor(F.col("position") / size).cast("long"))


def _record(history: Column) -> Column:
    return F.struct(
        F.col("message_id").alias("id"),
        F.transform(history, lambda t: F.struct(t["author"].alias("role"), t["text"].alias("text"))).alias("history"),
        F.col("text").alias("current_message"),
    )


def request_payloads(batched: DataFrame, request: str = "request_id") -> DataFrame:
    """One request per batch: ids, and the messages with their history as JSON in source order."""
    item = F.struct("conversation_index", "turn_index", "message_id", _record(F.col("history")).alias("record"))
    grouped = batched.groupBy(request).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return grouped.select(
        request, F.size("items").alias("item_count"),
        F.transform("items", lambda x: x["message_id"]).alias("ids"),
        F.to_json(F.transform("items", lambda x: x["record"])).alias("messages_json"),
    )


def record_bytes(turns: DataFrame) -> DataFrame:
    """Bytes of every customer message's request record, without building any history.

    The history's size is a running total of its turns' sizes plus commas, so the
    forecast stays linear even where the histories themselves would be quadratic.
    """
    turn_bytes = F.octet_length(F.to_json(F.struct(F.col("author").alias("role"), F.col("text").alias("text"))))
    sized = running_total(
        turns.withColumn("__bytes", turn_bytes.cast("long") + 1), ["conversation_index"],
        {"__piece": F.floor(F.col("turn_index") / TURNS_PER_PIECE).cast("long")}, ["turn_index"],
        F.col("__bytes"), "__before",
    )
    messages = customer_messages(sized.withColumn("gap_minutes", F.col("__before")))
    empty = F.octet_length(F.to_json(F.struct(
        F.col("message_id").alias("id"), F.array().cast("array<string>").alias("history"),
        F.col("text").alias("current_message"))))
    # n turns are joined by n - 1 commas, and each turn was counted with one.
    return messages.select(
        "message_id", "conversation_index", "seed_id", "turn_index", "platform", "text",
        (empty + F.greatest(F.col("gap_minutes") - 1, F.lit(0))).cast("long").alias("record_bytes"),
    )


def planned_requests(sized: DataFrame, config: TriageConfig) -> DataFrame:
    """(batch, item_count, estimated tokens, reserved cost) for undecided messages."""
    head = len(config.prompt_head.encode())
    # brackets plus one comma between records
    total = F.sum("record_bytes") + F.count(F.lit(1)) + 1 + head
    return (
        number_batches(sized, config.batch_size).groupBy("batch")
        .agg(F.count(F.lit(1)).alias("item_count"), total.alias("prompt_bytes"))
        .withColumn("estimated_input_tokens", money.tokens_from_bytes(F.col("prompt_bytes")))
        .withColumn("max_output_tokens", F.lit(config.max_output_tokens).cast("long"))
        .withColumn("reserved_usd", money.cost_usd(
            F.col("estimated_input_tokens"), F.col("max_output_tokens"), config.pricing))
    )


def admitted(requests: DataFrame, cap_usd: Decimal) -> DataFrame:
    """Requests in batch order with ``admitted``: false from the first one over the cap on."""
    cap = F.lit(money.checked_cap(cap_usd)).cast("decimal(18,6)")
    running = running_total(requests, [], id_levels("batch"), ["batch"], F.col("reserved_usd"), "committed_before")
    return running.withColumn("admitted", F.col("committed_before") + F.col("reserved_usd") <= cap)


def forecast(turns: DataFrame, config: TriageConfig = TriageConfig()) -> DataFrame:
    """What a run would cost at worst; nothing is sent anywhere."""
    sized = with_gate(record_bytes(turns), config.rules)
    open_messages = sized.where(F.col("gate").isNull())
    requests = planned_requests(open_messages, config).agg(
        F.coalesce(F.sum("item_count"), F.lit(0)).cast("long").alias("model_fallback_messages"),
        F.count(F.lit(1)).alias("request_count"),
        F.coalesce(F.sum("estimated_input_tokens"), F.lit(0)).cast("long").alias("conservative_input_tokens"),
        F.coalesce(F.sum("max_output_tokens"), F.lit(0)).cast("long").alias("reserved_max_output_tokens"),
        F.coalesce(F.sum("reserved_usd"), F.lit(0)).cast("decimal(18,6)").alias("worst_case_reserved_usd"),
    )
    eligible = turns.where(F.col("author") == "customer").agg(F.count(F.lit(1)).alias("eligible_messages"))
    return eligible.crossJoin(requests).withColumn(
        "rule_gate_messages", F.col("eligible_messages") - F.col("model_fallback_messages"))


# --- responses --------------------------------------------------------------------------------------

def parse_decisions(responses: DataFrame) -> DataFrame:
    """Responses with ``valid`` and, when valid, the decisions as an array.

    Valid means: exactly the keys id, i, u; three arrays of one length; known intents;
    real booleans.
    """
    parsed = F.from_json("payload", "id array<string>, i array<string>, u array<boolean>")
    keys = F.sort_array(F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>")))
    frame = responses.withColumns({"__p": parsed, "__keys": keys})
    ids, intents, flags = F.col("__p.id"), F.col("__p.i"), F.col("__p.u")
    # from_json would quietly turn numbers into strings; the variant keeps their type.
    typed_ids = F.try_variant_get(F.try_parse_json("payload"), "$.id", "array<variant>")
    all_strings = F.forall(typed_ids, lambda v: F.schema_of_variant(v) == "STRING")
    valid = (
        (F.col("__keys") == F.array(F.lit("i"), F.lit("id"), F.lit("u")))
        & ids.isNotNull() & (F.size(ids) == F.size(intents)) & (F.size(ids) == F.size(flags))
        & all_strings
        & F.forall(intents, lambda x: x.isNotNull() & x.isin(*INTENTS))
        & F.forall(flags, lambda x: x.isNotNull())
    )
    decisions = F.transform(
        F.arrays_zip(ids.alias("id"), intents.alias("i"), flags.alias("u")),
        lambda d: F.struct(d["id"].alias("message_id"), d["i"].alias("intent"), d["u"].alias("is_urgent")))
    return (
        frame.withColumn("valid", F.coalesce(valid, F.lit(False)))
        .withColumn("decisions", F.when(F.col("valid"), decisions))
        .drop("__p", "__keys")
    )


def usage(responses: DataFrame, pricing: Pricing) -> DataFrame:
    """Billed tokens and money per response; output counts candidate and thought tokens."""
    output = F.coalesce("candidate_tokens", F.lit(0)) + F.coalesce("thought_tokens", F.lit(0))
    return responses.select(
        "request_id", F.col("prompt_tokens").alias("input_tokens"), output.cast("long").alias("output_tokens"),
        "total_tokens", money.cost_usd(F.col("prompt_tokens"), output, pricing).alias("actual_usd"),
        (F.coalesce(F.col("prompt_tokens") > 0, F.lit(False)) & F.coalesce(F.col("total_tokens") > 0, F.lit(False)))
        .alias("usage_valid"),
    )


def reconcile(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """Every (request_id, message_id) seen on either side with its verdict.

    accepted: asked once, answered once. retry: asked, not answered or answered more
    than once. discarded: answered but never asked.
    """
    answers = returned.groupBy("request_id", "message_id").agg(
        F.count(F.lit(1)).alias("times"), F.min("intent").alias("intent"), F.min("is_urgent").alias("is_urgent"))
    asked = requested.select("request_id", "message_id").withColumn("asked", F.lit(True))
    both = asked.join(answers, ["request_id", "message_id"], "full_outer")
    times = F.coalesce("times", F.lit(0)).cast("long")
    verdict = (
        F.when(F.col("asked").isNull(), "discarded").when(times == 1, "accepted").otherwise("retry")
    )
    once = F.col("asked").isNotNull() & (times == 1)
    return both.select(
        "request_id", "message_id", F.coalesce("asked", F.lit(False)).alias("asked"), times.alias("times"),
        verdict.alias("verdict"), F.when(once, F.col("intent")).alias("intent"),
        F.when(once, F.col("is_urgent")).alias("is_urgent"),
    )


def anomalies(reconciled: DataFrame) -> DataFrame:
    """Anomaly rows per request with the affected ids; a request holds at most a batch of them."""
    kinds = F.filter(F.array(
        F.when(~F.col("asked"), F.lit(UNKNOWN_IDS)),
        F.when(F.col("asked") & (F.col("times") > 1), F.lit(DUPLICATE_IDS)),
        F.when(F.col("asked") & (F.col("times") != 1), F.lit(MISSING_IDS)),
    ), lambda k: k.isNotNull())
    per_request = reconciled.groupBy("request_id").agg(
        F.count_if("asked").alias("expected_count"), F.sum("times").alias("returned_count"))
    return (
        reconciled.select("request_id", "message_id", F.explode(kinds).alias("anomaly"))
        .groupBy("request_id", "anomaly").agg(F.sort_array(F.collect_list("message_id")).alias("affected_ids"))
        .join(per_request, "request_id")
        .select("request_id", "anomaly", "expected_count", "returned_count", "affected_ids")
    )


def retry_plan(items: DataFrame, reconciled: DataFrame, failed_requests: DataFrame) -> DataFrame:
    """The next round's items with new request ids.

    A request that failed as a whole, or of which nothing came back, is halved; of any
    other only the missing messages are asked again, together.
    """
    per_request = reconciled.where("asked").groupBy("request_id").agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(F.col("verdict") == "retry").alias("__missing"))
    state = (
        reconciled.where("asked and verdict = 'retry'").select("request_id", "message_id")
        .join(per_request, "request_id").join(failed_requests.select("request_id").withColumn("__failed", F.lit(True)),
                                              "request_id", "left")
        .withColumn("__whole", F.col("__failed").isNotNull() | (F.col("__missing") == F.col("__n")))
    )
    half = F.when(F.col("position_in_request") < F.floor(F.col("__n") / 2), "a").otherwise("b")
    return (
        items.join(state, ["request_id", "message_id"])
        .withColumn("request_id", F.concat(
            "request_id", F.when(F.col("__whole"), F.concat(F.lit("."), half)).otherwise(F.lit(".r"))))
        .select(*items.columns, F.col("__n").alias("parent_size"), F.col("__whole").alias("halved"))
    )


# --- ledger ---------------------------------------------------------------------------------------------

LEDGER_COLUMNS = (
    "event", "request_id", "model", "item_count", "estimated_input_tokens", "max_output_tokens", "reserved_usd",
    "input_tokens", "output_tokens", "actual_usd", "anomaly", "expected_count", "returned_count", "affected_ids",
)
_LEDGER_TYPES = {
    "event": "string", "request_id": "string", "model": "string", "item_count": "long",
    "estimated_input_tokens": "long", "max_output_tokens": "long", "reserved_usd": "decimal(18,6)",
    "input_tokens": "long", "output_tokens": "long", "actual_usd": "decimal(18,6)", "anomaly": "string",
    "expected_count": "long", "returned_count": "long", "affected_ids": "array<string>",
}


def ledger_rows(df: DataFrame, event: str, model: str | None = None) -> DataFrame:
    """A frame in the ledger's wide shape; absent fields are null."""
    have = df.withColumns({"event": F.lit(event), **({"model": F.lit(model)} if model else {})})
    return have.select(*[
        (F.col(c) if c in have.columns else F.lit(None)).cast(_LEDGER_TYPES[c]).alias(c) for c in LEDGER_COLUMNS
    ])


def ledger_state(events: DataFrame) -> DataFrame:
    """Per request: reserved, actual if completed, and what counts as committed."""
    amount = lambda kind, col: F.max(F.when(F.col("event") == kind, F.col(col)))
    return (
        events.where(F.col("event").isin("reserved", "completed")).groupBy("request_id")
        .agg(amount("reserved", "reserved_usd").alias("reserved_usd"),
             amount("completed", "actual_usd").alias("actual_usd"))
        .withColumn("committed_usd", F.when(F.col("reserved_usd").isNotNull(), F.coalesce("actual_usd", "reserved_usd")))
    )


def ledger_totals(events: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(18,6)").alias(c)
    return ledger_state(events).agg(
        F.count("reserved_usd").alias("reservations"), F.count("actual_usd").alias("completions"),
        zero("committed_usd"), zero("actual_usd"))


def over_reservation(events: DataFrame) -> DataFrame:
    """Requests billed above what had been reserved."""
    return ledger_state(events).where(F.col("actual_usd") > F.col("reserved_usd"))


# --- run state --------------------------------------------------------------------------------------------

def run_fingerprint(inputs: DataFrame, config: TriageConfig) -> DataFrame:
    """One row: a hash over the input's content, model, prices, sizes and instructions.

    The input hash folds row hashes by addition, so it needs no order and no big group.
    """
    row_hash = F.xxhash64(F.to_json(F.struct(*sorted(inputs.columns)))).cast("decimal(38,0)")
    content = inputs.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_hash), F.lit(0)).alias("digest"))
    return content.select(fingerprint({
        "input": F.concat_ws(":", "rows", "digest"),
        "model": F.lit(config.pricing.model),
        "input_usd_per_million": F.lit(str(config.pricing.input_usd_per_million)),
        "output_usd_per_million": F.lit(str(config.pricing.output_usd_per_million)),
        "cap_usd": F.lit(str(config.cap_usd)),
        "batch_size": F.lit(config.batch_size),
        "max_output_tokens": F.lit(config.max_output_tokens),
        "instructions": F.lit(config.prompt_head),
        "rules": F.lit(config.rules.version),
    }).alias("configuration_hash"))


def check_resume(
    stored_hash: str | None, current_hash: str, results: DataFrame | None, accept_change: bool = False
) -> None:
    """Refuse to mix results of two configurations, unless no model result exists yet."""
    if stored_hash is None:
        raise TriageError("cannot resume without run state")
    if stored_hash == current_hash:
        return
    if not accept_change:
        raise TriageError("refusing resume because the run configuration has changed")
    if results is not None and not results.where(F.col("decision_source") == MODEL_SOURCE).isEmpty():
        raise TriageError("cannot change configuration after accepting model results")


# --- the whole job -----------------------------------------------------------------------------------------

@dataclass
class TriageRun:
    """``open_items`` is None when every message got a result; ``budgets`` (request_id, round, budget) is None when one cap held for all."""

    results: DataFrame
    ledger: DataFrame
    rounds: int
    open_items: DataFrame | None = None
    budgets: DataFrame | None = None


def _priced(items: DataFrame, turns: DataFrame, config: TriageConfig) -> DataFrame:
    """The items' requests with their prompts and what each reserves."""
    return (
        request_payloads(with_history(items, turns))
        .withColumn("prompt", F.concat(F.lit(config.prompt_head), F.col("messages_json")))
        .withColumn("estimated_input_tokens", money.token_estimate(F.col("prompt")))
        .withColumn("max_output_tokens", F.lit(config.max_output_tokens).cast("long"))
        .withColumn("reserved_usd", money.cost_usd(
            F.col("estimated_input_tokens"), F.col("max_output_tokens"), config.pricing))
    )


def budgeted(requests: DataFrame, cap_usd: Decimal) -> DataFrame:
    """(request_id, budget): requests (request_id, reserved_usd) dealt in order over budgets, none of which reserves more than the cap.

    A budget takes the requests that start within one stretch of the running total. The stretch is the cap less the largest
    request, so also the last one ends below the cap. A request that alone is above the cap is an error.
    """
    largest = requests.agg(F.max("reserved_usd")).first()[0] or Decimal(0)
    if largest > money.checked_cap(cap_usd):
        raise TriageError(f"a request would raise committed spend above USD {cap_usd}")
    stretch = max(cap_usd - largest, Decimal("0.000001"))  # a millionth: each request has a budget of its own
    numbered = requests.select("request_id", "reserved_usd", F.regexp_extract("request_id", "[0-9]+", 0).cast("long").alias("batch"))
    running = running_total(numbered, [], id_levels("batch", 1 << 12), ["batch", "request_id"], F.col("reserved_usd"), "before")
    return running.select("request_id", F.floor(F.col("before") / F.lit(stretch).cast("decimal(18,6)")).cast("long").alias("budget"))


def _next_requests(items: DataFrame, turns: DataFrame, committed: Decimal, config: TriageConfig) -> DataFrame:
    """The requests that fit under the cap now, in request order, with their prompts.

    Every reservation costs at least one input token plus the full output allowance,
    so the budget left bounds how many requests can possibly be admitted. Only those
    few get their histories and prompts built.
    """
    price = config.pricing
    least = (price.input_usd_per_million + price.output_usd_per_million * config.max_output_tokens) / 1_000_000
    bound = int((config.cap_usd - committed) / least) + 1
    candidates = items.select("request_id").distinct().orderBy("request_id").limit(bound)
    chosen = items.join(F.broadcast(candidates), "request_id", "left_semi")  # at most ``bound`` ids
    requests = _priced(chosen, turns, config)
    upto = W.orderBy("request_id").rowsBetween(W.unboundedPreceding, 0)  # over ``bound`` rows at most
    fits = F.sum("reserved_usd").over(upto) + F.lit(committed).cast("decimal(18,6)") <= F.lit(config.cap_usd)
    return cut_lineage(requests.withColumn("__fits", fits).where("__fits").drop("__fits"))


def _settle(responses: DataFrame, billed: DataFrame, requests: DataFrame) -> Decimal:
    """Money spent by a round; one pass refuses bad usage, overspending and bad output."""
    joined = billed.join(requests.select("request_id", "reserved_usd"), "request_id").join(
        responses.select("request_id", "valid", "finish_reason"), "request_id")
    cut_off = F.coalesce(F.col("finish_reason").contains("MAX_TOKENS"), F.lit(False))
    state = joined.agg(
        F.count_if(~F.col("usage_valid")).alias("bad_usage"),
        F.count_if(F.col("actual_usd") > F.col("reserved_usd")).alias("over"),
        F.count_if(~F.col("valid") & ~cut_off).alias("bad_output"),
        F.coalesce(F.sum("actual_usd"), F.lit(0)).cast("decimal(18,6)").alias("spent"),
    ).first()
    for count, message in (
        (state.bad_usage, "invalid usage metadata"), (state.over, "usage exceeded its reservation"),
        (state.bad_output, "invalid structured output"),
    ):
        if count:
            raise checks.ContractError(f"{message} in {count} responses")
    return state.spent


def run(
    turns: DataFrame, scorer: Scorer, config: TriageConfig = TriageConfig(), done: DataFrame | None = None,
    stop_at_cap: bool = False, renew_budget: bool = False,
) -> TriageRun:
    """Classify every customer turn exactly once.

    Rules decide first. The rest is batched, admitted under the cap, scored on the
    executors, and reconciled; what is missing goes into the next round, and money a
    round did not use is free again for the next. Raw responses are written to the
    shared folder before they are looked at, so a lost executor never leads to a
    second paid call for a finished round.

    One cap holds for the whole run, and a run that needs more is refused. With
    ``renew_budget`` the caller grants as many budgets of ``cap_usd`` as the job takes:
    each round deals all its requests over new ones, so the rounds do not grow with the table.
    """
    if stop_at_cap and renew_budget:
        raise ValueError("a run either stops at its cap or renews it")
    spark = turns.sparkSession
    messages = customer_messages(turns)
    stored = done.select(*RESULT_COLUMNS) if done is not None else None
    if stored is not None:
        checks.require_none(invalid_results(stored), "invalid checkpoint row")
        checks.require_none(checks.duplicate_keys(stored, ["message_id"]), "duplicate checkpoint id")
        checks.require_none(checkpoint_violations(stored, messages), "checkpoint mismatch")
        messages = pending(messages, stored)
    gated = cut_lineage(with_gate(messages, config.rules))
    parts = [rule_results(gated)] + ([stored] if stored is not None else [])

    waiting = number_batches(gated.where(F.col("gate").isNull()).drop("gate"), config.batch_size)
    items = cut_lineage(waiting.select(
        F.format_string("req-%09d", F.col("batch").cast("long")).alias("request_id"),  # never cut, however large
        (F.col("position") % config.batch_size).cast("int").alias("position_in_request"),
        "message_id", "conversation_index", "seed_id", "turn_index", "text",
    ))
    ledger_parts: list[DataFrame] = []
    budget_parts: list[DataFrame] = []
    committed, rounds, left_open = Decimal(0), 0, None
    while not items.isEmpty():
        rounds += 1
        if rounds > config.max_rounds:
            raise TriageError(f"messages still open after {config.max_rounds} rounds")
        if renew_budget:
            requests = cut_lineage(_priced(items, turns, config))
            budget_parts.append(cut_lineage(budgeted(requests, config.cap_usd)).withColumn("round", F.lit(rounds)))
        else:
            requests = _next_requests(items, turns, committed, config)
        if requests.isEmpty():
            if not stop_at_cap:
                raise TriageError(f"the next request would raise committed spend above USD {config.cap_usd}")
            left_open = items
            break
        asked = items.join(requests.select("request_id"), "request_id", "left_semi")
        path = scratch_path(spark, "responses")
        scored = requests.select("request_id", "prompt", "ids", "messages_json", "max_output_tokens").mapInPandas(
            scorer, RESPONSE_SCHEMA)
        scored.write.mode("errorifexists").parquet(path)
        responses = parse_decisions(spark.read.schema(RESPONSE_SCHEMA).parquet(path))
        billed = usage(responses, config.pricing)
        failed = responses.where(~F.col("valid"))
        committed += _settle(responses, billed, requests)
        ledger_parts += [
            ledger_rows(requests, "reserved", config.pricing.model),
            ledger_rows(billed, "completed", config.pricing.model),
        ]
        returned = responses.where("valid").select("request_id", F.explode("decisions").alias("d")).select(
            "request_id", "d.*")
        verdicts = cut_lineage(reconcile(asked, returned))
        ledger_parts.append(ledger_rows(
            anomalies(verdicts.join(failed.select("request_id"), "request_id", "left_anti")), "response_anomaly"))
        accepted = verdicts.where("verdict = 'accepted'").select("request_id", "message_id", "intent", "is_urgent")
        parts.append(classified(asked.join(accepted, ["request_id", "message_id"]), MODEL_SOURCE, MODEL_BAND))
        later = items.join(requests.select("request_id"), "request_id", "left_anti")
        again = renumbered(retry_plan(asked, verdicts, failed))
        following = cut_lineage(again.unionByName(later, allowMissingColumns=True))
        checks.require_none(
            following.where("halved and parent_size = 1").select("message_id"), "the only requested id never came back")
        items = following.drop("parent_size", "halved")

    results = cut_lineage(reduce(DataFrame.unionByName, [p.select(*RESULT_COLUMNS) for p in parts]))
    if left_open is None:
        agree = checks.row_count_difference(customer_messages(turns), results).first()
        if not agree["matches"]:
            raise TriageError(f"{agree['rows_in']} messages in, {agree['rows_out']} results out")
    empty = spark.createDataFrame([], ", ".join(f"{c} {_LEDGER_TYPES[c]}" for c in LEDGER_COLUMNS))
    granted = reduce(DataFrame.unionByName, budget_parts).select("request_id", "round", "budget") if budget_parts else None
    return TriageRun(results, reduce(DataFrame.unionByName, ledger_parts, empty), rounds, left_open, granted)


def renumbered(items: DataFrame) -> DataFrame:
    """Positions 0.. inside each request; a request never exceeds the batch size."""
    w = W.partitionBy("request_id").orderBy("conversation_index", "turn_index")
    return items.withColumn("position_in_request", F.row_number().over(w) - 1)


def source_order(results: DataFrame) -> DataFrame:
    return results.orderBy("conversation_index", "turn_index")


def stub_scorer(decide: Callable[[str], tuple[str, bool]], tamper: Callable[[str, list], dict] | None = None) -> Scorer:
    """A deterministic scorer for tests and examples; ``tamper`` may spoil a response."""
    import json

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for request_id, prompt, text in zip(frame.request_id, frame.prompt, frame.messages_json):
                answers = [(r["id"], *decide(r["current_message"])) for r in json.loads(text)]
                extra: Mapping = tamper(request_id, answers) if tamper else {}
                answers = extra.get("answers", answers)
                payload = extra.get("payload") or json.dumps(
                    {"id": [a[0] for a in answers], "i": [a[1] for a in answers], "u": [a[2] for a in answers]})
                tokens = max(1, len(prompt.encode()) // 4)
                rows.append((request_id, payload, extra.get("finish_reason", "STOP"), tokens, len(answers) * 8, 0,
                             tokens + len(answers) * 8))
            yield pd.DataFrame(rows, columns=[
                "request_id", "payload", "finish_reason", "prompt_tokens", "candidate_tokens", "thought_tokens",
                "total_tokens"])

    return score
