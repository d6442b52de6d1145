"""Conversation turns with past-only history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .distributed import running_total

# A conversation longer than this is processed in several pieces.
TURNS_PER_PIECE = 512
AUTHORS = ("customer", "brand")  # fixed values

CONVERSATION_SCHEMA = (
    "seed_id long, platform string, messages array<struct<`from`: string, text: string, gap_minutes: long>>"
)


def message_id(conversation: Column, seed: Column, turn: Column) -> Column:
    return F.concat(F.lit("c"), conversation, F.lit(":s"), seed, F.lit(":t"), turn)


def explode_turns(conversations: DataFrame) -> DataFrame:
    """Nested conversations to one row per turn, in array order."""
    return conversations.select(
        "conversation_index", "seed_id", "platform", F.posexplode("messages").alias("turn_index", "m")
    ).select(
        "conversation_index", "seed_id", "platform", "turn_index",
        F.col("m.from").alias("author"), F.col("m.text").alias("text"), F.col("m.gap_minutes").alias("gap_minutes"),
    )


def nested_customer_turns(conversations: DataFrame) -> DataFrame:
    """Customer turns of nested rows; the history is a slice of the array at hand, no shuffle."""
    earlier = F.transform(
        F.expr("slice(messages, 1, pos)"),
        lambda m, i: F.struct(i.alias("turn_index"), m["from"].alias("author"), m["text"].alias("text"),
                              m["gap_minutes"].alias("gap_minutes")),
    )
    return (
        conversations.select("*", F.posexplode("messages").alias("pos", "m"))
        .where(F.col("m.from") == "customer")
        .select(
            message_id(F.col("conversation_index"), F.col("seed_id"), F.col("pos")).alias("message_id"),
            "conversation_index", "seed_id", F.col("pos").alias("turn_index"), "platform",
            F.col("m.text").alias("text"), F.col("m.gap_minutes").alias("gap_minutes"), earlier.alias("history"),
        )
    )


def turn_violations(conversations: DataFrame) -> DataFrame:
    """(conversation_index, turn_index, reason) for records that break the contract."""
    whole = conversations.select(
        "conversation_index", F.lit(None).cast("int").alias("turn_index"),
        F.when(F.col("seed_id").isNull() | F.col("platform").isNull(), "invalid metadata")
        .when(F.col("messages").isNull(), "messages must be an array").alias("reason"),
    )
    m = F.col("m")
    per_turn = conversations.select("conversation_index", F.posexplode("messages").alias("turn_index", "m")).select(
        "conversation_index", "turn_index",
        F.when(m.isNull() | m["from"].isNull(), "malformed")
        .when(~m["from"].isin(*AUTHORS), "invalid author")
        .when(m["text"].isNull() | m["gap_minutes"].isNull(), "invalid fields").alias("reason"),
    )
    return whole.unionByName(per_turn).where(F.col("reason").isNotNull())


def flat_turn_violations(turns: DataFrame) -> DataFrame:
    """The same contract on one-row-per-turn input."""
    return turns.select(
        "conversation_index", "turn_index",
        F.when(F.col("seed_id").isNull() | F.col("platform").isNull(), "invalid metadata")
        .when(F.col("author").isNull(), "malformed")
        .when(~F.col("author").isin(*AUTHORS), "invalid author")
        .when(F.col("text").isNull() | F.col("gap_minutes").isNull(), "invalid fields").alias("reason"),
    ).where(F.col("reason").isNotNull())


def counts(turns: DataFrame) -> DataFrame:
    """Conversations, turns by side, and distinct message ids in one row."""
    customer = F.col("author") == "customer"
    per_conversation = turns.groupBy("conversation_index").agg(
        F.count(F.lit(1)).alias("all_turns"), F.count_if(customer).alias("customer_turns"))
    ids = customer_messages(turns).select("message_id").distinct().agg(F.count("message_id").alias("unique_message_ids"))
    return per_conversation.agg(
        F.count(F.lit(1)).alias("conversations"), F.sum("all_turns").alias("all_turns"),
        F.sum("customer_turns").alias("customer_turns"),
        F.sum(F.col("all_turns") - F.col("customer_turns")).alias("brand_turns"),
    ).crossJoin(ids)


def customer_messages(turns: DataFrame) -> DataFrame:
    """Customer turns with their id, without history."""
    return turns.where(F.col("author") == "customer").select(
        message_id(F.col("conversation_index"), F.col("seed_id"), F.col("turn_index")).alias("message_id"),
        "conversation_index", "seed_id", "turn_index", "platform", "text", "gap_minutes",
    )


def _piece(turn: str = "turn_index") -> Column:
    return F.floor(F.col(turn) / TURNS_PER_PIECE).cast("long")


def history_pieces(turns: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """(message_id, piece, turns before the message inside that piece).

    Turns are first packed into pieces of bounded size; a message then meets exactly
    the pieces up to its own by an equi-join on (conversation, piece). The turns of a
    very long conversation are thus spread over as many tasks as it has pieces.
    ``messages`` restricts the work to some customer messages and their conversations.
    """
    if messages is None:
        messages = customer_messages(turns)
    else:
        turns = turns.join(messages.select("conversation_index").distinct(), "conversation_index", "left_semi")
    packed = turns.groupBy("conversation_index", _piece().alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct("turn_index", "author", "text", "gap_minutes"))).alias("packed"))
    wanted = messages.select(
        "message_id", "conversation_index", F.col("turn_index").alias("own_turn"),
        F.explode(F.sequence(F.lit(0).cast("long"), _piece())).alias("piece"),
    )
    return wanted.join(packed, ["conversation_index", "piece"]).select(
        "message_id", "piece", F.filter("packed", lambda t: t["turn_index"] < F.col("own_turn")).alias("turns"),
    )


def with_history(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """Messages plus ``history``: all earlier turns in order, never a later one."""
    whole = history_pieces(turns, messages).groupBy("message_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "turns"))), lambda p: p["turns"]))
        .alias("history"))
    return messages.join(whole, "message_id")


def customer_turns(turns: DataFrame) -> DataFrame:
    return with_history(customer_messages(turns), turns)


def history_text(history: Column) -> Column:
    return F.array_join(
        F.transform(history, lambda t: F.concat(F.lit("["), t["author"], F.lit("] "), t["text"])), "\n")


def recent_visible(rows: DataFrame, n: int, key: str = "session_id", pos: str = "pos", visible: Column | None = None) -> DataFrame:
    """The latest ``n`` visible messages per session and everything after the oldest of them.

    A row stays when fewer than ``n`` visible rows come later in its session.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    if visible is None:
        visible = (
            F.col("role").isin("user", "model") & (F.coalesce(F.length("text"), F.lit(0)) > 0) & ~F.col("is_thought")
        )
    later = running_total(
        rows, [key], {"__piece": -F.floor(F.col(pos) / TURNS_PER_PIECE).cast("long")}, [F.desc(pos)],
        F.coalesce(visible, F.lit(False)).cast("long"), "__later",
    )
    return later.where(F.col("__later") < n).drop("__later")
