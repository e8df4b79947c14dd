"""Session log, history, message routing, tool-call transcripts, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..params import CMD_AGENT, CMD_HISTORY, CMD_RESET, FEEDBACK_FLAGS, TOKEN_LENGTH
from .aggregates import ordered_concat, running_sums

ROUTE_RESET = "reset"
ROUTE_HISTORY = "history"
ROUTE_AGENT = "agent"
ROUTE_RETRIEVE = "retrieve"


def route(text) -> Column:
    """Route of a chat message; first match wins, on the lower-cased text."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    return (
        F.when(low.contains(CMD_RESET), F.lit(ROUTE_RESET))
        .when(low.contains(CMD_HISTORY), F.lit(ROUTE_HISTORY))
        .when(low.contains(CMD_AGENT), F.lit(ROUTE_AGENT))
        .otherwise(F.lit(ROUTE_RETRIEVE))
    )


def route_messages(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the trimmed message and its route."""
    clean = strip_ws(text_col)
    return df.withColumn("clean_text", clean).withColumn("route", route("clean_text"))


def loggable(messages: DataFrame, route_col: str = "route") -> DataFrame:
    """Messages that are stored in the session log: reset and history
    commands are answered but not stored."""
    return messages.filter(~F.col(route_col).isin(ROUTE_RESET, ROUTE_HISTORY))


def _epoch_columns(session_col: str, seq_col: str) -> list:
    """Output columns from ``resets`` and ``stored``, the numbers of resets
    and of stored messages up to a row, and ``base``, that of stored messages
    up to the last reset before it."""
    is_reset = F.col("route") == ROUTE_RESET
    epoch = F.col("resets") - is_reset.cast("bigint")
    stored = ~F.col("route").isin(ROUTE_RESET, ROUTE_HISTORY)
    return [session_col, seq_col, "route", epoch.alias("epoch"), F.when(stored, F.col("stored") - F.col("base")).alias("turn_no")]


def session_epochs(messages: DataFrame, session_col: str = "conv_id", seq_col: str = "turn", text_col: str = "text") -> DataFrame:
    """``session_col, seq_col, route, epoch, turn_no`` of every message.

    A reset ends the session of its conversation: ``epoch`` counts the resets
    before a message (the reset itself still belongs to what it ends), and
    ``turn_no`` numbers the stored messages of an epoch from 1 (NULL for
    resets and history commands, which are answered but not stored).  Running
    sums over range partitions: a conversation of any length is spread.
    Messages without a session are left out; ``seq_col`` tells the messages
    of a conversation apart.
    """
    rows = route_messages(messages.where(F.col(session_col).isNotNull()), text_col).select(
        session_col, seq_col, "route",
        (F.col("route") == ROUTE_RESET).alias("_reset"),
        (~F.col("route").isin(ROUTE_RESET, ROUTE_HISTORY)).alias("_stored"),
    )
    counted = running_sums(rows, [session_col], [seq_col], {"resets": "_reset", "stored": "_stored"})
    # where each epoch begins: one row a reset
    starts = counted.where("_reset").select(session_col, F.col("resets").alias("epoch"), F.col("stored").alias("base"))
    epoch = F.col("resets") - F.col("_reset").cast("bigint")
    joined = counted.withColumn("epoch", epoch).join(starts, [session_col, "epoch"], "left").drop("epoch")
    return joined.withColumn("base", F.coalesce("base", F.lit(0))).select(*_epoch_columns(session_col, seq_col))


def append_log(df: DataFrame, path: str) -> None:
    """Append rows ``(session_id, seq, ts, prompt)`` to the session log."""
    df.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def probe(log: DataFrame) -> bool:
    """Whether the log can be read and holds any row: a scan that stops at
    one row; an unreadable log raises."""
    return bool(log.limit(1).take(1))


def session_messages(log: DataFrame, session_id=None, session_col: str = "session_id") -> DataFrame:
    """Rows of one session (a column predicate, pushed to the scan) or of
    all sessions."""
    return log if session_id is None else log.filter(F.col(session_col) == F.lit(session_id))


def number_turns(log: DataFrame, session_col: str, ts_col: str, seq_col: str, out_col: str = "turn_no") -> DataFrame:
    """Turn number within a session, by time then sequence."""
    w = Window.partitionBy(session_col).orderBy(F.col(ts_col), F.col(seq_col))
    return log.withColumn(out_col, F.row_number().over(w))


def session_history(
    log: DataFrame,
    session_col: str = "session_id",
    seq_col: str = "seq",
    prompt_col: str = "prompt",
    sep: str = "\n",
    bucket_width: int = 1024,
) -> DataFrame:
    """One row per session: the prompts in order joined by ``sep``.  The
    two-level aggregation keeps a very long session from loading one task
    with all of its rows."""
    return ordered_concat(
        log, [session_col], seq_col, prompt_col, sep, "history", bucket_width=bucket_width, count_col="n_prompts"
    )


TOKEN_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def session_tokens(df: DataFrame, session_col: str, seed: int, length: int = TOKEN_LENGTH) -> DataFrame:
    """Synthetic session tokens of ``length`` (at most 32) characters from
    [A-Za-z0-9], derived from a digest of session and seed: the same on any
    cluster.  Real tokens come from the caller."""
    digest = F.sha2(F.concat_ws(":", F.col(session_col).cast("string"), F.lit(str(seed))), 256)

    def letter(i):
        byte = F.conv(F.substring(F.col("_digest"), 2 * i + 1, F.lit(2)), 16, 10).cast("int")
        return F.substring(F.lit(TOKEN_ALPHABET), byte % len(TOKEN_ALPHABET) + 1, F.lit(1))

    letters = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), letter)
    sessions = df.select(session_col).distinct().withColumn("_digest", digest)
    return sessions.select(session_col, F.array_join(letters, "").alias("token"))


# Tool calls ---------------------------------------------------------------

ACTION_PREFIX = "Action: "


def tool_calls(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Tool name and argument from the last line of an agent step.

    The last line must start with ``Action: ``; the tool is the text before
    the first ``[`` and the argument runs to the next ``]``.  ``Finish``
    marks a final answer.  Lines that do not parse give NULL tool.
    """
    t = F.col(text_col)
    trimmed = strip_ws(t)
    last_line = F.substring_index(trimmed, "\n", -1)
    is_action = last_line.startswith(ACTION_PREFIX)
    action = F.substring(last_line, len(ACTION_PREFIX) + 1, 1 << 30)
    # (?d): only a line feed ends a line, and a last line has none
    pattern = r"(?d)^([^\[]*)\[(.*?)\]"
    parsed = action.rlike(pattern)
    ok = is_action & parsed
    tool = F.when(ok, F.regexp_extract(action, pattern, 1))
    arg = F.when(ok, F.regexp_extract(action, pattern, 2))
    return df.select(
        "*",
        tool.alias("tool"),
        arg.alias("tool_input"),
        F.coalesce(tool == F.lit("Finish"), F.lit(False)).alias("finished"),
    )


def unknown_tools(calls: DataFrame, tools: DataFrame, tool_col: str = "tool") -> DataFrame:
    """Calls naming a tool missing from the registry (``Finish`` is always
    known).  The planner picks the join by the registry's size."""
    named = calls.filter(F.col(tool_col).isNotNull() & (F.col(tool_col) != "Finish"))
    return named.join(tools.select(F.col("name").alias(tool_col)), tool_col, "left_anti")


# Feedback -----------------------------------------------------------------


def check_feedback(df: DataFrame, flag_col: str = "flag") -> DataFrame:
    """Adds ``valid``: the flag is one of the accepted values."""
    return df.withColumn("valid", F.coalesce(F.col(flag_col).isin(*FEEDBACK_FLAGS), F.lit(False)))


def feedback_counts(df: DataFrame, flag_col: str = "flag") -> DataFrame:
    checked = check_feedback(df, flag_col)
    return checked.groupBy(flag_col, "valid").agg(F.count(F.lit(1)).alias("n"))


def store_feedback(df: DataFrame, path: str) -> None:
    """Append feedback rows ``(session_id, idx, text, flag)`` whose flag is
    accepted; the others are refused."""
    checked = check_feedback(df).where("valid")
    checked.select("session_id", "idx", "text", "flag").write.mode("append").parquet(path)
