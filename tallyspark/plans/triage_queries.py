"""Conversation triage and its evaluation over the conversations table."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ..functions.rules import INTENTS, Rule, RuleSet, rule_gate, triage_label
from ..functions.text import language_tag, sheet_safe
from ..operators import checks, conversations as cv, evaluation as ev, triage as tr
from ..sources.tables import chat_turns, table
from .display import rounded
from .registry import query

# The generated texts hold no real complaints, so the queries bring their own rules.
TEXT_RULES = RuleSet(
    (Rule("spam_text_v1", "thou", False, "spam"), Rule("urgent_text_v1", "ther", True), Rule("harm_text_v1", "wh", True)),
    "ing", "text-rules-v1",
)
CONFIG = tr.TriageConfig(batch_size=20, max_output_tokens=512, rules=TEXT_RULES, cap_usd=Decimal("1.00"))

TURNS = """
turns AS (SELECT conv_id, conv_id % 10 AS seed, turn, CASE WHEN role = 'user' THEN 'customer' ELSE 'brand' END AS author, text
          FROM conversations),
msgs AS (SELECT *, 'c' || conv_id || ':s' || seed || ':t' || turn AS message_id FROM turns WHERE author = 'customer')"""

GATE = """
gated AS (
  SELECT *, CASE WHEN regexp_matches(text, '(?i)thou') THEN 'spam_text_v1' WHEN regexp_matches(text, '(?i)ther') THEN 'urgent_text_v1'
                 WHEN regexp_matches(text, '(?i)wh') THEN 'harm_text_v1' END AS rule_id,
            regexp_matches(text, '(?i)ing') AS refund FROM msgs),
decided AS (
  SELECT *, CASE WHEN rule_id = 'spam_text_v1' THEN 'spam' WHEN rule_id IS NOT NULL AND refund THEN 'refund request'
                 WHEN rule_id IS NOT NULL THEN 'complaint' END AS intent, rule_id <> 'spam_text_v1' AS urgent FROM gated)"""

# What the stub scorer answers, in SQL and in Python.
STUB = "CASE WHEN contains(lower(text), 'que') THEN 'order inquiry' WHEN contains(lower(text), 'ung') THEN 'compliment' ELSE 'complaint' END"


def stub_decision(text: str) -> tuple[str, bool]:
    low = text.lower()
    return ("order inquiry" if "que" in low else "compliment" if "ung" in low else "complaint"), False


def stub_spoils(request_id: str, answers: list) -> dict:
    """Some first attempts lose, double or truncate answers; their retries come back clean."""
    if "." in request_id:
        return {}
    kind = int(request_id.rsplit("-", 1)[1]) % 4
    if kind == 1:
        return {"answers": [*answers[1:], ("nobody", "spam", False)]}
    if kind == 2 and len(answers) > 1:
        return {"answers": [*answers, answers[0]]}
    if kind == 3 and len(answers) > 1:
        return {"payload": '{"id": ["c', "finish_reason": "MAX_TOKENS"}
    return {}


@query("corpus_counts", f"""
WITH {TURNS}
SELECT count(DISTINCT conv_id) AS conversations, count(*) AS all_turns, count_if(author = 'customer')::BIGINT AS customer_turns,
       count_if(author = 'brand')::BIGINT AS brand_turns, (SELECT count(DISTINCT message_id) FROM msgs) AS unique_message_ids FROM turns""")
def corpus_counts(spark, folder):
    return cv.counts(chat_turns(spark, folder))


@query("past_history", f"""
WITH {TURNS}
SELECT m.message_id, m.turn AS turn_index, count(t.turn) AS history_turns,
       coalesce(string_agg('[' || t.author || '] ' || t.text, chr(10) ORDER BY t.turn), '') AS available_history
FROM msgs m LEFT JOIN turns t ON t.conv_id = m.conv_id AND t.turn < m.turn GROUP BY m.message_id, m.turn""")
def past_history(spark, folder):
    return cv.customer_turns(chat_turns(spark, folder)).select(
        "message_id", "turn_index", F.size("history").cast("long").alias("history_turns"),
        cv.history_text(F.col("history")).alias("available_history"))


@query("nested_history", f"""
WITH {TURNS}
SELECT m.message_id, count(t.turn) AS history_turns, coalesce(sum(length(t.text)), 0)::BIGINT AS history_chars
FROM msgs m LEFT JOIN turns t ON t.conv_id = m.conv_id AND t.turn < m.turn GROUP BY m.message_id""")
def nested_history(spark, folder):
    """Conversations that arrive as one nested record each, as in the source format."""
    nested = chat_turns(spark, folder).groupBy("conversation_index", "seed_id", "platform").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("turn_index", "author", "text", "gap_minutes"))),
            lambda t: F.struct(t["author"].alias("from"), t["text"].alias("text"), t["gap_minutes"].alias("gap_minutes")),
        ).alias("messages"))
    chars = F.aggregate("history", F.lit(0).cast("long"), lambda a, t: a + F.length(t["text"]))
    return cv.nested_customer_turns(nested).select(
        "message_id", F.size("history").cast("long").alias("history_turns"), chars.alias("history_chars"))


@query("recent_visible", """
WITH v AS (SELECT conv_id, turn, role, role IN ('user', 'assistant') AS visible FROM conversations),
l AS (SELECT *, coalesce(sum(visible::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM v)
SELECT conv_id AS session_id, turn AS pos, role FROM l WHERE later < 3""")
def recent_visible(spark, folder):
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role", "text")
    return cv.recent_visible(rows, 3, visible=F.col("role").isin("user", "assistant")).drop("text")


@query("rule_gate", f"""
WITH {TURNS}, {GATE} SELECT message_id, intent, urgent AS is_urgent, rule_id FROM decided WHERE rule_id IS NOT NULL""")
def gate(spark, folder):
    gated = tr.with_gate(cv.customer_messages(chat_turns(spark, folder)), TEXT_RULES)
    return gated.where("gate is not null").select("message_id", "gate.*")


@query("rule_gate_default_rules", """
SELECT lang, count(*) AS documents,
       count_if(regexp_matches(text, '(?i)\\b(?:crypto|forex|guaranteed returns?|earn money|buy followers|seo services?)\\b'))::BIGINT AS spam,
       count_if(regexp_matches(text, '(?i)\\b(?:refund|money back|chargeback)\\b'))::BIGINT AS refunds
FROM documents GROUP BY lang""")
def gate_default(spark, folder):
    from ..functions.rules import REFUND_PATTERN

    docs = table(spark, folder, "documents").withColumn("gate", rule_gate(F.col("text")))
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("gate.intent") == "spam").alias("spam"),
        F.count_if(F.col("text").rlike(f"(?iuU){REFUND_PATTERN}")).alias("refunds"))


LABEL = "CASE WHEN urgent THEN 'urgent escalation' ELSE intent END"


@query("triage_labels", f"""
WITH {TURNS}, {GATE}
SELECT {LABEL} AS triage_label, 'rule_gate' AS decision_source, 'high' AS confidence_band, count(*) AS messages
FROM decided WHERE rule_id IS NOT NULL GROUP BY 1""")
def triage_labels(spark, folder):
    results = tr.rule_results(tr.with_gate(cv.customer_messages(chat_turns(spark, folder)), TEXT_RULES))
    return results.groupBy("triage_label", "decision_source", "confidence_band").agg(F.count(F.lit(1)).alias("messages"))


@query("language_tag", """
SELECT CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'english' ELSE 'other' END AS language, role, count(*) AS turns
FROM conversations GROUP BY ALL""")
def language(spark, folder):
    return table(spark, folder, "conversations").groupBy(language_tag(F.col("text")).alias("language"), "role").agg(
        F.count(F.lit(1)).alias("turns"))


@query("sheet_safe", """
WITH signed AS (SELECT conv_id, turn, CASE turn % 5 WHEN 1 THEN '=' WHEN 2 THEN '+' WHEN 3 THEN '-' WHEN 4 THEN '@' ELSE '' END || text AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN left(t, 1) IN ('=', '+', '-', '@') THEN '''' || t ELSE t END AS cell FROM signed""")
def safe_cells(spark, folder):
    c = table(spark, folder, "conversations")
    sign = F.element_at(F.array(*[F.lit(x) for x in ("", "=", "+", "-", "@")]), (F.col("turn") % 5 + 1).cast("int"))
    return c.select("conv_id", "turn", sheet_safe(F.concat(sign, "text")).alias("cell"))


def _results(spark, folder):
    """Deterministic results for the evaluation queries: rules first, the stub's answer otherwise."""
    gated = tr.with_gate(cv.customer_messages(chat_turns(spark, folder)), TEXT_RULES)
    low = F.lower("text")
    answer = F.when(low.contains("que"), "order inquiry").when(low.contains("ung"), "compliment").otherwise("complaint")
    model = gated.where("gate is null").withColumns({"intent": answer, "is_urgent": F.lit(False)})
    return tr.rule_results(gated).unionByName(tr.classified(model, tr.MODEL_SOURCE, tr.MODEL_BAND))


RESULTS = f"""
{TURNS}, {GATE},
results AS (
  SELECT message_id, conv_id, seed, turn, coalesce(intent, {STUB}) AS intent, coalesce(urgent, false) AS urgent,
         CASE WHEN rule_id IS NULL THEN 'model_fallback' ELSE 'rule_gate' END AS source,
         CASE WHEN rule_id IS NULL THEN 'medium' ELSE 'high' END AS band, text FROM decided),
labelled AS (SELECT *, {LABEL} AS label FROM results)"""


@query("triage_run", f"""
WITH {RESULTS}
SELECT message_id, conv_id AS conversation_index, seed AS seed_id, turn AS turn_index, intent, urgent AS is_urgent,
       label AS triage_label, source AS decision_source, band AS confidence_band FROM labelled""")
def triage_run(spark, folder):
    """Every message of the table, however many budgets of the cap that takes; the stub's calls cost nothing."""
    done = tr.run(chat_turns(spark, folder), tr.stub_scorer(stub_decision, stub_spoils), CONFIG, renew_budget=True)
    return done.results


@query("resume_pending", f"""
WITH {TURNS} SELECT message_id FROM msgs WHERE conv_id % 3 <> 0""")
def resume_pending(spark, folder):
    stored = _results(spark, folder).where("conversation_index % 3 = 0")
    return tr.pending(cv.customer_messages(chat_turns(spark, folder)), stored).select("message_id")


JSON_TEXT = "octet_length(encode(to_json({'role': author, 'text': text})::VARCHAR))"
SIZED = f"""
hist AS (SELECT *, coalesce(sum({JSON_TEXT} + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hb FROM turns),
sized AS (
  SELECT d.*, octet_length(encode(to_json({{'id': d.message_id, 'history': []::VARCHAR[], 'current_message': d.text}})::VARCHAR)) + greatest(h.hb - 1, 0) AS rb
  FROM decided d JOIN hist h ON h.conv_id = d.conv_id AND h.turn = d.turn),
batched AS (SELECT *, (row_number() OVER (ORDER BY conv_id, turn) - 1) // {CONFIG.batch_size} AS batch FROM sized WHERE rule_id IS NULL),
requests AS (
  SELECT batch, count(*) AS items, (sum(rb) + count(*) + 1 + {len(CONFIG.prompt_head.encode())})::BIGINT AS bytes,
         greatest(1, ((sum(rb) + count(*) + 1 + {len(CONFIG.prompt_head.encode())})::BIGINT + 1) // 2) AS tokens FROM batched GROUP BY batch),
priced AS (SELECT *, ceil(tokens * 0.30::DECIMAL(8,2) + {CONFIG.max_output_tokens} * 2.50::DECIMAL(8,2))::BIGINT AS micros FROM requests)"""


@query("forecast", f"""
WITH {TURNS}, {GATE}, {SIZED}
SELECT (SELECT count(*) FROM msgs) AS eligible_messages, sum(items)::BIGINT AS model_fallback_messages, count(*) AS request_count,
       sum(tokens)::BIGINT AS conservative_input_tokens, (count(*) * {CONFIG.max_output_tokens})::BIGINT AS reserved_max_output_tokens,
       sum(micros)::BIGINT AS worst_case_micro_usd, (SELECT count(*) FROM msgs) - sum(items)::BIGINT AS rule_gate_messages FROM priced""")
def forecast(spark, folder):
    report = tr.forecast(chat_turns(spark, folder), CONFIG)
    return report.withColumn("worst_case_micro_usd", (F.col("worst_case_reserved_usd") * 1_000_000).cast("long")).drop(
        "worst_case_reserved_usd")


def _planned(spark, folder):
    sized = tr.with_gate(tr.record_bytes(chat_turns(spark, folder)), TEXT_RULES)
    return tr.planned_requests(sized.where("gate is null"), CONFIG)


@query("batch_admission", f"""
WITH {TURNS}, {GATE}, {SIZED}
SELECT batch, items AS item_count, tokens AS estimated_input_tokens, micros AS reserved_micro_usd,
       sum(micros) OVER (ORDER BY batch)::BIGINT <= 40000 AS admitted FROM priced""")
def batch_admission(spark, folder):
    return tr.admitted(_planned(spark, folder), Decimal("0.04")).select(
        "batch", "item_count", "estimated_input_tokens",
        (F.col("reserved_usd") * 1_000_000).cast("long").alias("reserved_micro_usd"), "admitted")


@query("request_payload", f"""
WITH {TURNS}, {GATE}, {SIZED}
SELECT batch, count(*) AS item_count, string_agg(message_id, ',' ORDER BY conv_id, turn) AS ids, (sum(rb) + count(*) + 1)::BIGINT AS json_bytes
FROM batched GROUP BY batch""")
def request_payload(spark, folder):
    """Payloads as built for the scorer; their true size must equal the forecast's arithmetic."""
    turns = chat_turns(spark, folder)
    undecided = tr.with_gate(cv.customer_turns(turns), TEXT_RULES).where("gate is null")
    built = tr.request_payloads(tr.number_batches(undecided, CONFIG.batch_size), "batch")
    return built.select(
        "batch", F.col("item_count").cast("long").alias("item_count"), F.array_join("ids", ",").alias("ids"),
        F.octet_length("messages_json").cast("long").alias("json_bytes"))


RETURNED = f"""
{TURNS},
asked AS (SELECT 'r' || (conv_id // 5) || '-' || (turn // 50) AS request_id, message_id, conv_id, turn FROM msgs),
answers AS (
  SELECT request_id, message_id FROM asked WHERE (conv_id + turn) % 5 <> 0
  UNION ALL SELECT request_id, message_id FROM asked WHERE (conv_id + turn) % 7 = 0
  UNION ALL SELECT request_id, 'x' || message_id FROM asked WHERE conv_id % 11 = 0),
verdicts AS (
  SELECT coalesce(a.request_id, b.request_id) AS request_id, coalesce(a.message_id, b.message_id) AS message_id,
         a.message_id IS NOT NULL AS asked, coalesce(b.times, 0) AS times
  FROM asked a FULL JOIN (SELECT request_id, message_id, count(*) AS times FROM answers GROUP BY ALL) b
       ON a.request_id = b.request_id AND a.message_id = b.message_id)"""


def _reconciled(spark, folder):
    """Answers lost, doubled or invented by a rule on the ids."""
    asked = cv.customer_messages(chat_turns(spark, folder)).select(
        F.concat(F.lit("r"), F.floor(F.col("conversation_index") / 5), F.lit("-"),
                 F.floor(F.col("turn_index") / 50)).alias("request_id"), "message_id",
        "conversation_index", "turn_index")
    spot = F.col("conversation_index") + F.col("turn_index")
    reply = [F.lit("complaint").alias("intent"), F.lit(False).alias("is_urgent")]
    answers = (
        asked.where(spot % 5 != 0).select("request_id", "message_id", *reply)
        .unionAll(asked.where(spot % 7 == 0).select("request_id", "message_id", *reply))
        .unionAll(asked.where("conversation_index % 11 = 0").select(
            "request_id", F.concat(F.lit("x"), "message_id").alias("message_id"), *reply)))
    return asked, tr.reconcile(asked, answers)


@query("reconcile_responses", f"""
WITH {RETURNED}
SELECT request_id, message_id, asked, times, CASE WHEN NOT asked THEN 'discarded' WHEN times = 1 THEN 'accepted' ELSE 'retry' END AS verdict
FROM verdicts""")
def reconcile_responses(spark, folder):
    return _reconciled(spark, folder)[1].drop("intent", "is_urgent")


@query("response_anomalies", f"""
WITH {RETURNED},
kinds AS (
  SELECT request_id, message_id, 'unknown_ids_discarded' AS anomaly FROM verdicts WHERE NOT asked
  UNION ALL SELECT request_id, message_id, 'duplicate_ids_retried' FROM verdicts WHERE asked AND times > 1
  UNION ALL SELECT request_id, message_id, 'missing_ids_retried' FROM verdicts WHERE asked AND times <> 1)
SELECT k.request_id, anomaly, (SELECT count_if(asked)::BIGINT FROM verdicts v WHERE v.request_id = k.request_id) AS expected_count,
       (SELECT sum(times)::BIGINT FROM verdicts v WHERE v.request_id = k.request_id) AS returned_count,
       string_agg(message_id, ',' ORDER BY message_id) AS affected_ids FROM kinds k GROUP BY k.request_id, anomaly""")
def response_anomalies(spark, folder):
    return tr.anomalies(_reconciled(spark, folder)[1]).withColumn("affected_ids", F.array_join("affected_ids", ","))


@query("retry_rounds", f"""
WITH {RETURNED},
per AS (SELECT request_id, count(*) AS n, count_if(times <> 1) AS missing FROM verdicts WHERE asked GROUP BY request_id),
pos AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY conv_id, turn) - 1 AS p FROM asked)
SELECT pos.message_id, pos.request_id || CASE WHEN pos.request_id = 'r3-0' OR missing = n THEN CASE WHEN p < n // 2 THEN '.a' ELSE '.b' END ELSE '.r' END AS request_id
FROM pos JOIN per ON per.request_id = pos.request_id
     JOIN verdicts v ON v.request_id = pos.request_id AND v.message_id = pos.message_id WHERE v.times <> 1""")
def retry_rounds(spark, folder):
    asked, verdicts = _reconciled(spark, folder)
    failed = asked.where("request_id = 'r3-0'").select("request_id").distinct()
    return tr.retry_plan(tr.renumbered(asked), verdicts, failed).select("message_id", "request_id")


@query("parse_parallel_arrays", f"""
WITH {TURNS}
SELECT conv_id, turn // 50 AS part, CASE conv_id % 6 WHEN 0 THEN true ELSE false END AS valid,
       CASE conv_id % 6 WHEN 0 THEN count(*) ELSE 0 END AS decisions FROM msgs GROUP BY conv_id, turn // 50""")
def parse_parallel_arrays(spark, folder):
    """One good and five broken response shapes, chosen by conversation; at most 50 turns each."""
    part = F.floor(F.col("turn_index") / 50).alias("part")
    per = cv.customer_messages(chat_turns(spark, folder)).groupBy("conversation_index", part).agg(
        F.sort_array(F.collect_list("message_id")).alias("id"))
    ids = F.to_json("id")
    all_of = lambda v: F.to_json(F.transform("id", lambda _: F.lit(v)))
    body = lambda i, u, more="", key="id": F.concat(
        F.lit('{"%s":' % key), ids, F.lit(',"i":'), i, F.lit(',"u":'), u, F.lit(more + "}"))
    good_i, good_u = all_of("complaint"), F.to_json(F.transform("id", lambda _: F.lit(False)))
    kind = F.col("conversation_index") % 6
    payload = (
        F.when(kind == 0, body(good_i, good_u)).when(kind == 1, body(all_of("banter"), good_u))
        .when(kind == 2, body(good_i, all_of("false"))).when(kind == 3, body(F.lit("[]"), good_u))
        .when(kind == 4, body(good_i, good_u, ',"z":1')).otherwise(F.substring(body(good_i, good_u), 1, 20))
    )
    parsed = tr.parse_decisions(per.select("conversation_index", "part", payload.alias("payload")))
    return parsed.select(
        F.col("conversation_index").alias("conv_id"), "part", "valid",
        F.coalesce(F.size("decisions"), F.lit(0)).cast("long").alias("decisions"))


LEDGER = """
reserved AS (SELECT user_id || '-' || event_id AS request_id, ceil(value * 100)::BIGINT AS micros FROM events WHERE event_type <> 'error'),
completed AS (SELECT user_id || '-' || event_id AS request_id,
                     ceil(value * 100)::BIGINT + CASE WHEN event_id % 50 = 0 THEN 10 ELSE -floor(value * 10)::BIGINT END AS micros
              FROM events WHERE event_type IN ('view', 'click'))"""


def _ledger(spark, folder):
    e = table(spark, folder, "events").withColumn("request_id", F.concat_ws("-", "user_id", "event_id"))
    micros = F.ceil(F.col("value") * 100).cast("long")
    usd = lambda m: (m.cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    change = F.when(F.col("event_id") % 50 == 0, F.lit(10)).otherwise(-F.floor(F.col("value") * 10).cast("long"))
    reserved = e.where("event_type <> 'error'").withColumn("reserved_usd", usd(micros))
    completed = e.where("event_type in ('view', 'click')").withColumn("actual_usd", usd(micros + change))
    return tr.ledger_rows(reserved, "reserved", "stub").unionByName(tr.ledger_rows(completed, "completed", "stub"))


@query("ledger_totals", f"""
WITH {LEDGER}
SELECT count(*) AS reservations, count(c.micros) AS completions, sum(coalesce(c.micros, r.micros))::BIGINT AS committed_micros,
       sum(c.micros)::BIGINT AS actual_micros FROM reserved r LEFT JOIN completed c ON c.request_id = r.request_id""")
def ledger_totals(spark, folder):
    totals = tr.ledger_totals(_ledger(spark, folder))
    micros = lambda c: (F.col(c) * 1_000_000).cast("long")
    return totals.select("reservations", "completions", micros("committed_usd").alias("committed_micros"),
                         micros("actual_usd").alias("actual_micros"))


@query("over_reservation", f"""
WITH {LEDGER}
SELECT r.request_id, r.micros AS reserved_micros, c.micros AS actual_micros
FROM reserved r JOIN completed c ON c.request_id = r.request_id WHERE c.micros > r.micros""")
def over_reservation(spark, folder):
    micros = lambda c: (F.col(c) * 1_000_000).cast("long")
    return tr.over_reservation(_ledger(spark, folder)).select(
        "request_id", micros("reserved_usd").alias("reserved_micros"), micros("actual_usd").alias("actual_micros"))


@query("usage_totals", """
SELECT event_type, sum(event_id % 1000)::BIGINT AS input_tokens, sum(event_id % 90 + user_id % 7)::BIGINT AS output_tokens,
       count_if(event_id % 1000 = 0)::BIGINT AS invalid,
       sum(ceil((event_id % 1000) * 0.30::DECIMAL(8,2) + (event_id % 90 + user_id % 7) * 2.50::DECIMAL(8,2)))::BIGINT AS micros
FROM events GROUP BY event_type""")
def usage_totals(spark, folder):
    e = table(spark, folder, "events").select(
        "event_type", F.col("event_id").cast("string").alias("request_id"),
        (F.col("event_id") % 1000).alias("prompt_tokens"), (F.col("event_id") % 90).alias("candidate_tokens"),
        (F.col("user_id") % 7).alias("thought_tokens"), F.lit(1).cast("long").alias("total_tokens"))
    billed = tr.usage(e, CONFIG.pricing).join(e.select("request_id", "event_type"), "request_id")
    return billed.groupBy("event_type").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.count_if(~F.col("usage_valid")).alias("invalid"),
        (F.sum("actual_usd") * 1_000_000).cast("long").alias("micros"))


@query("run_fingerprint", f"""
WITH {TURNS} SELECT count(*) AS rows_hashed, 64::BIGINT AS hash_length, true AS repeats, true AS differs FROM turns""")
def run_fingerprint(spark, folder):
    turns = chat_turns(spark, folder)
    first = tr.run_fingerprint(turns, CONFIG).select(F.col("configuration_hash").alias("a"))
    shuffled = tr.run_fingerprint(turns.repartition(3), CONFIG).select(F.col("configuration_hash").alias("b"))
    other = tr.run_fingerprint(turns, tr.TriageConfig(batch_size=21, rules=TEXT_RULES)).select(
        F.col("configuration_hash").alias("c"))
    return turns.agg(F.count(F.lit(1)).alias("rows_hashed")).crossJoin(first).crossJoin(shuffled).crossJoin(other).select(
        "rows_hashed", F.length("a").cast("long").alias("hash_length"), (F.col("a") == F.col("b")).alias("repeats"),
        (F.col("a") != F.col("c")).alias("differs"))


@query("checkpoint_violations", f"""
WITH {RESULTS}
SELECT message_id, CASE WHEN turn % 4 = 1 THEN 'source metadata mismatch' ELSE 'derived label mismatch' END AS reason
FROM labelled WHERE turn % 4 = 1 OR (conv_id % 9 = 0 AND turn % 4 <> 1)
UNION ALL SELECT 'ghost-' || conv_id, 'unknown message id' FROM labelled WHERE turn = 0 AND conv_id % 10 = 3""")
def checkpoint_violations(spark, folder):
    """Stored results with a wrong seed, a wrong label or an id nobody knows, by a rule on the ids."""
    good = _results(spark, folder)
    spoiled = good.withColumn("seed_id", F.when(F.col("turn_index") % 4 == 1, F.col("seed_id") + 100).otherwise(F.col("seed_id")))
    spoiled = spoiled.withColumn("triage_label", F.when(F.col("conversation_index") % 9 == 0, F.lit("nonsense")).otherwise(F.col("triage_label")))
    ghosts = good.where("turn_index = 0 and conversation_index % 10 = 3").withColumn(
        "message_id", F.concat(F.lit("ghost-"), "conversation_index"))
    return tr.checkpoint_violations(spoiled.unionByName(ghosts), cv.customer_messages(chat_turns(spark, folder)))


@query("turn_violations", """
SELECT conv_id AS conversation_index, turn AS turn_index, CASE WHEN role = 'system' THEN 'invalid author' ELSE 'invalid fields' END AS reason
FROM conversations WHERE role = 'system' OR turn % 6 = 5""")
def turn_violations(spark, folder):
    c = table(spark, folder, "conversations")
    turns = c.select(
        F.col("conv_id").alias("conversation_index"), F.col("turn").alias("turn_index"), F.lit(1).alias("seed_id"),
        F.lit("chat").alias("platform"),
        F.when(F.col("role") == "user", "customer").when(F.col("role") == "assistant", "brand").otherwise(F.col("role")).alias("author"),
        F.when(F.col("turn") % 6 != 5, F.col("text")).alias("text"), F.lit(0).alias("gap_minutes"))
    return cv.flat_turn_violations(turns)


# --- evaluation ---------------------------------------------------------------------------------------

SPLIT = """
CASE WHEN conv_id = 150 THEN 'calibration' WHEN conv_id IN (94, 102, 151, 152, 555) THEN 'heldout'
     WHEN ('0x' || substr(sha256('20260806:' || conv_id), 1, 8))::BIGINT % 100 < 20 THEN 'calibration' ELSE 'heldout' END"""
SMALL_QUOTAS = {
    "calibration": {"urgent escalation": 3, "complaint": 2, "spam": 1},
    "heldout": {"urgent escalation": 8, "spam": 4, "complaint": 9, "order inquiry": 2},
}
QUOTA_ROWS = ", ".join(f"('{s}', '{label}', {n})" for s, labels in SMALL_QUOTAS.items() for label, n in labels.items())
SAMPLED = f"""
{RESULTS},
pop AS (SELECT *, {SPLIT} AS split FROM labelled),
quota(split, label, quota) AS (VALUES {QUOTA_ROWS}),
ranked AS (
  SELECT p.*, q.quota, count(*) OVER (PARTITION BY p.split, p.label) AS population,
         row_number() OVER (PARTITION BY p.split, p.label ORDER BY sha256('20260806:' || p.split || ':' || p.label || ':' || message_id)) AS r
  FROM pop p JOIN quota q ON q.split = p.split AND q.label = p.label),
sample AS (
  SELECT *, CASE split WHEN 'calibration' THEN 'CAL-' ELSE 'TEST-' END || lpad(row_number() OVER (PARTITION BY split ORDER BY sha256('20260806:' || split || ':' || message_id))::VARCHAR, 4, '0') AS evaluation_id
  FROM ranked WHERE r <= quota)"""


@query("hash_split", f"""
SELECT conv_id, {SPLIT} AS split FROM (SELECT DISTINCT conv_id FROM conversations)""")
def hash_split(spark, folder):
    from ..functions.hashing import conversation_split

    return table(spark, folder, "conversations").select("conv_id").distinct().withColumn(
        "split", conversation_split(F.col("conv_id")))


@query("split_leak", f"""
WITH {RESULTS} SELECT count(*) AS messages, 0::BIGINT AS leaking_conversations FROM labelled""")
def split_leak(spark, folder):
    rows = ev.assign_split(_results(spark, folder))
    leaks = checks.group_leaks(rows, "conversation_index", "split").agg(F.count(F.lit(1)).alias("leaking_conversations"))
    return rows.agg(F.count(F.lit(1)).alias("messages")).crossJoin(leaks)


@query("stratified_sample", f"""
WITH {SAMPLED}
SELECT message_id, split, label AS triage_label, population AS population_count, quota::BIGINT AS sample_count,
       round(population / quota, 8) AS sampling_weight FROM sample""")
def stratified_sample(spark, folder):
    return ev.stratified_sample(_results(spark, folder), SMALL_QUOTAS).select(
        "message_id", "split", "triage_label", "population_count", "sample_count", "sampling_weight")


@query("sampling_weights", f"""
WITH {SAMPLED}
SELECT split, label AS triage_label, count(*) AS sampled, max(population) AS population_count,
       round(sum(round(population / quota, 8)), 4) AS weight_sum FROM sample GROUP BY ALL""")
def sampling_weights(spark, folder):
    return rounded(ev.stratified_sample(_results(spark, folder), SMALL_QUOTAS).groupBy("split", "triage_label").agg(
        F.count(F.lit(1)).alias("sampled"), F.max("population_count").alias("population_count"),
        F.sum("sampling_weight").alias("weight_sum")), 4)


@query("sample_shortage", f"""
WITH {RESULTS}, pop AS (SELECT label, {SPLIT} AS split, count(*) AS n FROM labelled GROUP BY ALL),
quota(split, label, quota) AS (VALUES {", ".join(f"('{s}', '{label}', {n})" for s, labels in ev.QUOTAS.items() for label, n in labels.items())})
SELECT q.split, q.label AS triage_label, quota::BIGINT AS quota, coalesce(n, 0) AS found
FROM quota q LEFT JOIN pop p ON p.split = q.split AND p.label = q.label WHERE coalesce(n, 0) < quota""")
def sample_shortage(spark, folder):
    return ev.shortages(ev.assign_split(_results(spark, folder)))


@query("quota_check", f"""
WITH {SAMPLED}, wanted AS (SELECT split, label, CASE label WHEN 'spam' THEN quota + 1 ELSE quota END AS quota FROM quota)
SELECT w.split, w.label AS triage_label, (SELECT count(*) FROM sample s WHERE s.split = w.split AND s.label = w.label) AS found, w.quota::BIGINT AS quota
FROM wanted w WHERE (SELECT count(*) FROM sample s WHERE s.split = w.split AND s.label = w.label) <> w.quota""")
def quota_check(spark, folder):
    raised = ev.quota_table(spark, SMALL_QUOTAS).withColumn(
        "quota", F.col("quota") + F.when(F.col("triage_label") == "spam", 1).otherwise(0))
    sample = ev.stratified_sample(_results(spark, folder), SMALL_QUOTAS)
    return checks.quota_gaps(sample, ["split", "triage_label"], raised)


def _prepared(spark, folder):
    return ev.prepare(chat_turns(spark, folder), _results(spark, folder), "cfg", SMALL_QUOTAS, check=False)


@query("review_queue", f"""
WITH {SAMPLED}
SELECT evaluation_id, split, message_id, conv_id AS conversation_index, seed AS seed_id, turn AS turn_index,
       CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'english' ELSE 'other' END AS language, text AS current_message,
       '' AS gold_intent, (SELECT count(*) FROM turns t WHERE t.conv_id = s.conv_id AND t.turn < s.turn) AS history_lines FROM sample s""")
def review_queue(spark, folder):
    review, _ = _prepared(spark, folder)
    marks = F.regexp_count(F.concat(F.lit("\n"), "available_history"), F.lit("\n\\[(customer|brand)\\] ")).cast("long")
    return review.select("evaluation_id", "split", "message_id", "conversation_index", "seed_id", "turn_index", "language",
                         "current_message", "gold_intent", marks.alias("history_lines"))


@query("evaluation_manifest", f"""
WITH {SAMPLED}
SELECT evaluation_id, split, message_id, intent AS predicted_intent, urgent::VARCHAR AS predicted_is_urgent, label AS predicted_triage_label,
       source AS decision_source, band AS confidence_band, label AS sampling_stratum, population AS population_count,
       quota::BIGINT AS sample_count, printf('%.8f', population / quota) AS sampling_weight, 'cfg' AS configuration_hash FROM sample""")
def evaluation_manifest(spark, folder):
    return _prepared(spark, folder)[1]


# Gold labels: the quality label; prediction: a rule on the length; weight: by source.
GOLD = """
g AS (SELECT l.doc_id, CASE quality WHEN 1 THEN 'complaint' ELSE 'spam' END AS gold,
             CASE WHEN n_chars > 5000 THEN 'complaint' WHEN n_chars > 800 THEN 'order inquiry' ELSE 'spam' END AS pred,
             toxic = 1 AS gold_urgent, n_chars % 5 = 0 AS pred_urgent, 1 + l.doc_id % 3 AS w
      FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def _gold(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return labels.join(docs, "doc_id").select(
        "doc_id", F.when(F.col("quality") == 1, "complaint").otherwise("spam").alias("gold"),
        F.when(F.col("n_chars") > 5000, "complaint").when(F.col("n_chars") > 800, "order inquiry").otherwise("spam").alias("pred"),
        (F.col("toxic") == 1).alias("gold_urgent"), (F.col("n_chars") % 5 == 0).alias("pred_urgent"),
        (1 + F.col("doc_id") % 3).alias("w"))


LABEL_ROWS = ", ".join(f"('{x}')" for x in INTENTS)


@query("confusion_matrix", f"""
WITH {GOLD}, lab(x) AS (VALUES {LABEL_ROWS})
SELECT a.x AS gold, b.x AS predicted, (SELECT count(*) FROM g WHERE gold = a.x AND pred = b.x)::DOUBLE AS n FROM lab a, lab b""")
def confusion_matrix(spark, folder):
    return ev.confusion_matrix(_gold(spark, folder), "gold", "pred", INTENTS)


METRIC_SQL = """
WITH {gold}, lab(x) AS (VALUES {labels}),
m AS (SELECT x, coalesce(sum(CASE WHEN gold = x AND pred = x THEN {w} END), 0)::DOUBLE AS tp,
             coalesce(sum(CASE WHEN gold <> x AND pred = x THEN {w} END), 0)::DOUBLE AS fp,
             coalesce(sum(CASE WHEN gold = x AND pred <> x THEN {w} END), 0)::DOUBLE AS fn FROM lab, g GROUP BY x),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r FROM m),
f AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr)
SELECT x AS label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, tp + fn AS support,
       (SELECT round(sum(CASE WHEN gold = pred THEN {w} ELSE 0 END) / sum({w}), 6) FROM g) AS accuracy,
       (SELECT round(sum(f1) / 5, 6) FROM f) AS macro_f1 FROM f"""


@query("classification_metrics", METRIC_SQL.format(gold=GOLD, labels=LABEL_ROWS, w="1"))
def classification_metrics(spark, folder):
    return rounded(ev.classification_metrics(_gold(spark, folder), "gold", "pred", INTENTS))


@query("classification_metrics_weighted", METRIC_SQL.format(gold=GOLD, labels=LABEL_ROWS, w="w"))
def classification_metrics_weighted(spark, folder):
    return rounded(ev.classification_metrics(_gold(spark, folder), "gold", "pred", INTENTS, F.col("w")))


@query("binary_metrics", f"""
WITH {GOLD}, c AS (SELECT coalesce(sum(CASE WHEN gold_urgent AND pred_urgent THEN w END), 0)::DOUBLE AS tp,
  coalesce(sum(CASE WHEN NOT gold_urgent AND pred_urgent THEN w END), 0)::DOUBLE AS fp,
  coalesce(sum(CASE WHEN gold_urgent AND NOT pred_urgent THEN w END), 0)::DOUBLE AS fn FROM g),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS q FROM c)
SELECT round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q = 0 THEN 0.0 ELSE 2 * p * q / (p + q) END, 6) AS f1,
       tp + fn AS support, tp AS true_positive, fp AS false_positive, fn AS false_negative FROM r""")
def binary_metrics(spark, folder):
    return rounded(ev.binary_metrics(_gold(spark, folder), "gold_urgent", "pred_urgent", F.col("w")))


REVIEWED = """
rev AS (SELECT 'CAL-' || l.doc_id AS evaluation_id, l.doc_id, CASE quality WHEN 1 THEN 'complaint' ELSE 'spam' END AS gold, toxic = 1 AS gold_urgent,
               CASE WHEN n_chars > 5000 THEN 'complaint' ELSE 'spam' END AS pred, n_chars % 5 = 0 AS pred_urgent, n_chars
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def _reviewed(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    joined = labels.join(docs, "doc_id").withColumn("evaluation_id", F.concat(F.lit("CAL-"), "doc_id"))
    reviews = joined.select(
        "evaluation_id", F.lit("calibration").alias("split"), F.col("doc_id").cast("string").alias("message_id"),
        F.when(F.col("quality") == 1, "complaint").otherwise(" spam ").alias("gold_intent"),
        F.when(F.col("toxic") == 1, "TRUE").otherwise("false").alias("gold_is_urgent"),
        F.when(F.col("n_chars") % 10 == 3, "").otherwise("reviewed").alias("reviewer_status"), F.lit("").alias("reviewer_notes"))
    predicted = F.when(F.col("n_chars") > 5000, "complaint").otherwise("spam")
    urgent = F.col("n_chars") % 5 == 0
    manifest = joined.select(
        "evaluation_id", F.col("doc_id").cast("string").alias("message_id"), predicted.alias("predicted_intent"),
        urgent.cast("string").alias("predicted_is_urgent"), triage_label(predicted, urgent).alias("predicted_triage_label"),
        F.lit("s").alias("sampling_stratum"), F.lit("2.00000000").alias("sampling_weight"))
    return reviews, manifest


@query("gold_incomplete", f"WITH {REVIEWED} SELECT evaluation_id FROM rev WHERE n_chars % 10 = 3")
def gold_incomplete(spark, folder):
    return ev.incomplete_gold(_reviewed(spark, folder)[0])


@query("score_errors", f"""
WITH {REVIEWED}
SELECT evaluation_id, doc_id::VARCHAR AS message_id, gold AS gold_intent, pred AS predicted_intent, gold_urgent AS gold_is_urgent,
       pred_urgent AS predicted_is_urgent, CASE WHEN gold_urgent THEN 'urgent escalation' ELSE gold END AS gold_triage_label,
       CASE WHEN pred_urgent THEN 'urgent escalation' ELSE pred END AS predicted_triage_label, '' AS reviewer_notes
FROM rev WHERE CASE WHEN gold_urgent THEN 'urgent escalation' ELSE gold END <> CASE WHEN pred_urgent THEN 'urgent escalation' ELSE pred END""")
def score_errors(spark, folder):
    return ev.error_rows(ev.scored_rows(*_reviewed(spark, folder)))
