"""Rules, histories, batching, reconciliation and the capped run."""

import sys
from decimal import Decimal

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallyspark.functions import money
from tallyspark.functions.rules import rule_gate, triage_label
from tallyspark.operators import checks, conversations as cv, triage as tr

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the scorers below run in tasks

TURN_SCHEMA = (
    "conversation_index long, seed_id long, platform string, turn_index int, author string, text string, gap_minutes long")


def turns(spark, n, conversations=1):
    rows = [
        (c, 1, "whatsapp", i, "customer" if i % 2 == 0 else "brand", f"text {c}-{i}", 1)
        for c in range(conversations) for i in range(2 * n)]
    return spark.createDataFrame(rows, TURN_SCHEMA)


def complaint(text):
    return "complaint", False


@pytest.mark.parametrize("text, want", [
    ("This is terrible and I will never order from you again!", None),
    ("بنتي عندها حساسية من اللبن، هل عندكم خيارات خالية من الألبان؟", None),
    ("روحنا المستشفى بسبب الطلب امبارح", ("complaint", True)),
    ("Refund me today or I will take legal action", ("refund request", True)),
    ("We sell SEO services and guaranteed followers for your account", ("spam", False)),
    ("REFUND ME TODAY OR I WILL TAKE LEGAL ACTION", ("refund request", True)),
])
def test_rule_gate(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(rule_gate(F.col("t")).alias("g")).first().g
    assert (got and (got.intent, got.is_urgent)) == want


def test_urgency_wins(spark):
    df = spark.createDataFrame([("spam", True), ("spam", False)], "i string, u boolean")
    assert [r[0] for r in df.select(triage_label(F.col("i"), F.col("u"))).collect()] == ["urgent escalation", "spam"]


# --- conversations -----------------------------------------------------------------------------

def nested(spark, rows):
    return spark.createDataFrame(rows, "conversation_index long, " + cv.CONVERSATION_SCHEMA)


CASE = [("customer", "first"), ("brand", "reply"), ("customer", "second"), ("brand", "future reply")]


def test_history_is_past_only_in_both_input_shapes(spark):
    df = nested(spark, [(0, 5, "whatsapp", [(a, t, 1) for a, t in CASE])])
    for messages in (cv.nested_customer_turns(df), cv.customer_turns(cv.explode_turns(df))):
        got = {r.turn_index: r for r in messages.collect()}
        assert set(got) == {0, 2} and got[2].message_id == "c0:s5:t2"
        assert [t.text for t in got[2].history] == ["first", "reply"] and got[0].history == []
        assert "future reply" not in str(got)


def test_long_conversations_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(cv, "TURNS_PER_PIECE", 4)
    t = turns(spark, 12)
    pieces = cv.history_pieces(t)
    assert pieces.agg(F.max(F.size("turns"))).first()[0] <= 4
    for r in cv.customer_turns(t).collect():
        assert [h.turn_index for h in r.history] == list(range(r.turn_index))


def test_repeated_seeds_still_give_unique_ids_and_counts(spark):
    df = nested(spark, [(0, 7, "x", [("customer", "a", 1), ("brand", "b", 1), ("customer", "c", 1)]), (1, 7, "x", [("customer", "a", 1)])])
    ids = [r.message_id for r in cv.nested_customer_turns(df).collect()]
    assert len(set(ids)) == 3
    got = cv.counts(cv.explode_turns(df)).first()
    assert (got.conversations, got.all_turns, got.customer_turns, got.brand_turns) == (2, 4, 3, 1)


def test_turn_contract(spark):
    df = nested(spark, [
        (0, 1, "x", [("agent", "a", 1), ("customer", None, 1), ("brand", "b", 1)]), (1, None, "x", []), (2, 1, "x", None),
        (3, 1, "x", [None])])
    got = {(r.conversation_index, r.turn_index, r.reason) for r in cv.turn_violations(df).collect()}
    assert got == {
        (0, 0, "invalid author"), (0, 1, "invalid fields"), (1, None, "invalid metadata"),
        (2, None, "messages must be an array"), (3, 0, "malformed")}


@pytest.mark.parametrize("piece", [2, 512])
def test_recent_visible(spark, monkeypatch, piece):
    monkeypatch.setattr(cv, "TURNS_PER_PIECE", piece)
    rows = []
    for i in range(14):
        rows.append(("s", len(rows), "user" if i % 2 == 0 else "model", f"m{i}", False))
        if i == 7:
            rows += [("s", len(rows), "model", None, False), ("s", len(rows) + 1, "model", "thinking", True)]
    df = spark.createDataFrame(rows, "session_id string, pos int, role string, text string, is_thought boolean")
    kept = [r.text for r in cv.recent_visible(df, 10).orderBy("pos").collect()]
    assert kept == ["m4", "m5", "m6", "m7", None, "thinking"] + [f"m{i}" for i in range(8, 14)]
    assert cv.recent_visible(df, 50).count() == len(rows)
    with pytest.raises(ValueError):
        cv.recent_visible(df, 0)


# --- money ---------------------------------------------------------------------------------------------

def test_prices_round_up_and_tokens_count_bytes(spark):
    df = spark.createDataFrame([(1_000_000, 1_000_000), (1, 0), (-1, 0)], "i long, o long")
    got = [r[0] for r in df.select(money.cost_usd(F.col("i"), F.col("o"), money.Pricing())).collect()]
    assert got == [Decimal("2.800000"), Decimal("0.000001"), None]
    text = spark.createDataFrame([("hello مرحبا",), ("",)], "t string").select(money.token_estimate(F.col("t")))
    assert [r[0] for r in text.collect()] == [8, 1]
    with pytest.raises(ValueError):
        money.checked_cap(Decimal("1.01"))
    with pytest.raises(ValueError):
        money.checked_cap(Decimal(0))


def test_first_letters_of_a_pattern_change_no_verdict(spark):
    """Every branch, with letters that only Unicode folding makes equal, against the same pattern without its guard."""
    from tallyspark.functions import rules as ru

    words = [
        "crypto", "forex", "guaranteed return", "guaranteed returns", "earn money", "buy followers", "seo service", "\u017feo services", "CRYPTO", "acrypto",
        "زيادة متابعين", "شراء لايكات", "استثمار كبير مضمون", "فوركس ارباح", "خدمات سيو نقدم", "i'll sue", "I will call the police", "\u0130 will sue", "\u0131'll sue",
        "i am going to report you", "I'll post this online", "legal action", "my lawyer", "consumer protection", "سوف أرفع قضية", "حارفع بلاغ", "هارفع شكوى", "راحأقدم بلاغ",
        "هكلم الشرطة", "سابلغ المحامي", "هنشر ده على فيسبوك", "افضح الناس", "food poisoning", "poisoned", "allergic reaction", "anaphylaxis", "went to hospital",
        "went to the hospital", "emergency room", "data breach", "lea\u212aed my data", "leaked my personal data", "card details exposed", "تسمم بعد الأكل", "اختناق بسبب", "روحنا المستشفى",
        "رحت الطوارئ", "سربتم بياناتي", "انكشفت بطاقتي", "refund", "money bac\u212a", "money back", "chargeback", "استرجاع فلوس", "استرداد", "رجعولي المبلغ", "refunds", "قrefund", "nothing",
    ]
    texts = [t for w in words for t in (w, w.upper(), f"please, {w}!", f"x{w}y", f"é{w}", f"line\n{w}\nmore")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (ru.SPAM_PATTERN, ru.ESCALATION_PATTERN, ru.HARM_PATTERN, ru.REFUND_PATTERN):
        assert pattern.startswith("(?=")
        bare = pattern[pattern.index(")") + 1:]
        seen = df.select("t", *[F.col("t").rlike(f"(?iduU){p}").alias(n) for n, p in (("now", pattern), ("before", bare))]).collect()
        assert [r.t for r in seen if r.now != r.before] == [] and sum(r.now for r in seen) >= 20


def ledger(spark, rows):
    return spark.createDataFrame(rows, "event string, request_id string, reserved_usd decimal(18,6), actual_usd decimal(18,6)")


def test_open_reservations_stay_committed_and_completions_replace_them(spark):
    d = Decimal
    events = ledger(spark, [("reserved", "a", d("0.5"), None), ("reserved", "b", d("0.2"), None), ("completed", "a", None, d("0.1"))])
    got = tr.ledger_totals(events).first()
    assert (got.committed_usd, got.actual_usd) == (d("0.3"), d("0.1"))
    over = ledger(spark, [("reserved", "a", d("0.1"), None), ("completed", "a", None, d("0.2"))])
    assert [r.request_id for r in tr.over_reservation(over).collect()] == ["a"]


def test_admission_stops_at_the_first_request_over_the_cap(spark):
    df = spark.createDataFrame([(i, Decimal("0.3")) for i in range(5)], "batch long, reserved_usd decimal(18,6)")
    got = {r.batch: r.admitted for r in tr.admitted(df, Decimal("0.8")).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False}


# --- responses --------------------------------------------------------------------------------------------

@pytest.mark.parametrize("payload, valid", [
    ('{"id":["a","b"],"i":["spam","complaint"],"u":[true,false]}', True),
    ('{"id":["a"],"i":["unhappy"],"u":[true]}', False),
    ('{"id":["a"],"i":["spam"],"u":["true"]}', False),
    ('{"id":["a","b"],"i":["spam"],"u":[true]}', False),
    ('{"id":[1],"i":["spam"],"u":[true]}', False),
    ('{"id":["a"],"i":["spam"],"u":[true],"x":1}', False),
    ('{"id":["a"],"i":["spam"]}', False),
    ('{"id":["a"', False), ('[]', False), (None, False),
])
def test_parallel_arrays(spark, payload, valid):
    got = tr.parse_decisions(spark.createDataFrame([("r", payload)], "request_id string, payload string")).first()
    assert got.valid is valid
    if valid:
        assert [(d.message_id, d.intent, d.is_urgent) for d in got.decisions] == [("a", "spam", True), ("b", "complaint", False)]


def test_reconciliation_rules(spark):
    asked = spark.createDataFrame([("r", x) for x in "abc"], "request_id string, message_id string")
    back = spark.createDataFrame(
        [("r", "a", "spam", False), ("r", "b", "spam", False), ("r", "b", "spam", True), ("r", "z", "spam", False)],
        "request_id string, message_id string, intent string, is_urgent boolean")
    verdicts = tr.reconcile(asked, back)
    assert {r.message_id: r.verdict for r in verdicts.collect()} == {"a": "accepted", "b": "retry", "c": "retry", "z": "discarded"}
    got = {r.anomaly: (r.expected_count, r.returned_count, r.affected_ids) for r in tr.anomalies(verdicts).collect()}
    assert got == {
        tr.UNKNOWN_IDS: (3, 4, ["z"]), tr.DUPLICATE_IDS: (3, 4, ["b"]), tr.MISSING_IDS: (3, 4, ["b", "c"])}


# --- runs ---------------------------------------------------------------------------------------------------

def calls(run):
    return run.ledger.where("event = 'completed'").count()


def test_a_clean_run_keeps_source_order_and_labels(spark):
    run = tr.run(turns(spark, 3, 2), tr.stub_scorer(lambda t: ("order inquiry", t.endswith("0"))))
    rows = tr.source_order(run.results).collect()
    assert [(r.conversation_index, r.turn_index) for r in rows] == [(c, t) for c in (0, 1) for t in (0, 2, 4)]
    assert [r.triage_label for r in rows[:2]] == ["urgent escalation", "order inquiry"]
    assert calls(run) == 1 and {r.decision_source for r in rows} == {"model_fallback"}


def test_doubled_and_missing_and_unknown_answers(spark):
    def spoil(request, answers):
        return {} if "." in request else {"answers": [*answers[1:], answers[-1], ("ghost", "spam", False)]}

    run = tr.run(turns(spark, 5), tr.stub_scorer(complaint, spoil))
    assert run.results.count() == 5 and calls(run) == 2
    retried = run.ledger.where("event = 'reserved' and request_id like '%.r'").first()
    assert retried.item_count == 2  # the missing one and the doubled one
    kinds = {r.anomaly for r in run.ledger.where("event = 'response_anomaly'").collect()}
    assert kinds == {tr.UNKNOWN_IDS, tr.DUPLICATE_IDS, tr.MISSING_IDS}


def test_truncated_answers_are_charged_and_halved(spark):
    def spoil(request, answers):
        return {"payload": '{"id":', "finish_reason": "FinishReason.MAX_TOKENS"} if len(answers) > 25 else {}

    run = tr.run(turns(spark, 50), tr.stub_scorer(complaint, spoil))
    assert run.results.count() == 50 and calls(run) == 3
    assert sorted(r.item_count for r in run.ledger.where("event = 'reserved'").collect()) == [25, 25, 50]


def test_only_the_missing_are_asked_again(spark):
    def spoil(request, answers):
        return {} if "." in request else {"answers": answers[5:]}

    run = tr.run(turns(spark, 50), tr.stub_scorer(complaint, spoil))
    assert calls(run) == 2
    missing = run.ledger.where(F.col("anomaly") == tr.MISSING_IDS).first()
    assert len(missing.affected_ids) == 5
    assert run.ledger.where("event = 'reserved' and item_count = 5").count() == 1


def test_invalid_output_and_an_id_that_never_comes_back_end_the_run(spark):
    with pytest.raises(checks.ContractError, match="invalid structured output"):
        tr.run(turns(spark, 1), tr.stub_scorer(complaint, lambda r, a: {"payload": "{}"}))
    with pytest.raises(checks.ContractError, match="never came back"):
        tr.run(turns(spark, 1), tr.stub_scorer(complaint, lambda r, a: {"answers": [("x", "spam", False)]}))


def test_resume_asks_nothing_again(spark):
    t = turns(spark, 4)
    first = tr.run(t, tr.stub_scorer(complaint)).results

    def never(frames):
        raise AssertionError("called again")
        yield

    again = tr.run(t, never, done=first)
    assert again.rounds == 0 and again.results.count() == 4
    with pytest.raises(checks.ContractError, match="checkpoint mismatch"):
        tr.run(t, never, done=first.withColumn("seed_id", F.lit(99).cast("long")))
    with pytest.raises(checks.ContractError, match="duplicate checkpoint"):
        tr.run(t, never, done=first.unionAll(first))


def test_the_cap_ends_a_run_before_the_first_request_over_it(spark):
    config = tr.TriageConfig(batch_size=2, cap_usd=Decimal("0.0053"))
    with pytest.raises(tr.TriageError, match="above USD"):
        tr.run(turns(spark, 12), tr.stub_scorer(complaint), config)
    kept = tr.run(turns(spark, 12), tr.stub_scorer(complaint), tr.TriageConfig(batch_size=1, cap_usd=Decimal("0.0052")), stop_at_cap=True)
    done, left = kept.results.count(), kept.open_items.count()
    assert done + left == 12 and done >= 1 and left >= 1
    assert tr.ledger_totals(kept.ledger).first().committed_usd <= Decimal("0.0052")


def test_a_renewed_budget_finishes_the_job_and_no_budget_exceeds_the_cap(spark):
    cap = Decimal("0.0120")
    config = tr.TriageConfig(batch_size=2, cap_usd=cap)
    done = tr.run(turns(spark, 12), tr.stub_scorer(complaint), config, renew_budget=True)
    assert done.results.count() == 12 and done.open_items is None
    reserved = done.ledger.where("event = 'reserved'").join(done.budgets, "request_id").groupBy("round", "budget").agg(
        F.sum("reserved_usd").alias("usd"), F.count(F.lit(1)).alias("n")).collect()
    assert len(reserved) > 1 and sum(r.n for r in reserved) == 6 and all(r.usd <= cap for r in reserved)
    with pytest.raises(tr.TriageError, match="above USD"):
        tr.run(turns(spark, 12), tr.stub_scorer(complaint), tr.TriageConfig(batch_size=2, cap_usd=Decimal("0.0050")), renew_budget=True)


def test_budgets_hold_several_requests_below_the_cap(spark):
    rows = [(f"req-{i:09d}{end}", Decimal(f"0.{1 + i % 3}")) for i in range(40) for end in ("", ".a")]
    df = spark.createDataFrame(rows, "request_id string, reserved_usd decimal(18,6)")
    got = df.join(tr.budgeted(df, Decimal("1.00")), "request_id").groupBy("budget").agg(F.sum("reserved_usd").alias("usd")).collect()
    assert max(r.usd for r in got) <= 1 and len(got) <= 24 and sum(r.usd for r in got) == sum(r[1] for r in rows)


def test_triage_run_finishes_a_table_that_one_budget_cannot_pay(spark, monkeypatch):
    from dataclasses import replace

    from tallyspark.plans import QUERIES, triage_queries as tq

    monkeypatch.setattr(tq, "CONFIG", replace(tq.CONFIG, cap_usd=Decimal("0.01")))
    folder = "/root/testdata/sf0.001"
    got = QUERIES["triage_run"](spark, folder)
    assert got.count() == cv.customer_messages(tq.chat_turns(spark, folder)).count()


def test_forecast_equals_the_built_prompts(spark):
    t = turns(spark, 7, 3)
    config = tr.TriageConfig(batch_size=4)
    plan = tr.forecast(t, config).first()
    built = tr.request_payloads(tr.number_batches(cv.customer_turns(t), 4), "batch")
    total = built.select(money.token_estimate(F.concat(F.lit(config.prompt_head), F.col("messages_json"))).alias("n")).agg(F.sum("n")).first()[0]
    assert plan.conservative_input_tokens == total and plan.request_count == 6


def test_configuration_guard(spark):
    t = turns(spark, 2)
    config = tr.TriageConfig()
    a = tr.run_fingerprint(t, config).first()[0]
    assert a == tr.run_fingerprint(t.repartition(3), config).first()[0]
    assert a != tr.run_fingerprint(t, tr.TriageConfig(batch_size=49)).first()[0]
    results = tr.run(t, tr.stub_scorer(complaint)).results
    tr.check_resume(a, a, results)
    with pytest.raises(tr.TriageError, match="changed"):
        tr.check_resume("old", a, None)
    tr.check_resume("old", a, results.where("false"), accept_change=True)
    with pytest.raises(tr.TriageError, match="after accepting"):
        tr.check_resume("old", a, results, accept_change=True)
    with pytest.raises(tr.TriageError, match="without run state"):
        tr.check_resume(None, a, None)


@pytest.mark.parametrize("bad", [{"batch_size": 0}, {"max_output_tokens": 0}, {"cap_usd": Decimal("2")}])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        tr.TriageConfig(**bad)
