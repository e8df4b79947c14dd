"""Chat formatting by a grammar round trip.

    conversation := turn*
    turn         := "### " role ":" NEWLINE text NEWLINE "</turn>" NEWLINE

A backslash takes the next character literally in role and text.  Every turn
is rendered with the least escaping, reparsed by the deterministic parser,
compared with its source, and rendered again with more escaping until the
parser returns the source exactly: nothing, then backslashes and control
strings only, then every special character (which always round-trips).
Turns are rendered where they lie, before any shuffle.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batches_of, ranged, shuffle_parts, written

HEAD, TAIL = "### ", "\n</turn>\n"
# possessive: no backtracking, linear in the text; the text's group holds the line end before the closing mark
_TURN = re.compile(r"### ((?:[^\\:\n]++|\\.)*+):\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_CONTROL = re.compile(r"\\|</turn>|### ")
_SPECIAL = re.compile(r"[\\<#:\n]")


def _lead(m: re.Match) -> str:
    return "\\" + m.group()


LEVELS = (lambda s: s, lambda s: _CONTROL.sub(_lead, s), lambda s: _SPECIAL.sub(_lead, s))


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s) if "\\" in s else s


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """``(role, text, start, end)`` of each turn; start and end are where the
    escaped text lies.  Raises ValueError when the whole is no conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None or not m[2].endswith("\n"):
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])[:-1], m.start(2), m.end(2) - 1))
        at = m.end()
    return out


def render(role: str, text: str) -> tuple[str, int]:
    """The rendered turn and the escaping level that made it round-trip."""
    for level, escape in enumerate(LEVELS):
        out = f"{HEAD}{LEVELS[2](role)}:\n{escape(text)}{TAIL}"
        # A control string in a text is escaped even where the parser would cope.
        if level == 0 and _CONTROL.search(text):
            continue
        try:
            if [(r, t) for r, t, _, _ in parse(out)] == [(role, text)]:
                return out, level
        except ValueError:
            pass
    raise AssertionError("full escaping always round-trips")


PART_CHARS = 1 << 20
PART_SCHEMA = (
    "conv_id long, first_turn long, seq long, formatted string, loss array<struct<start:int,end:int>>, levels array<int>"
)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formatted conversations in parts.

    ``turns``: conv_id, turn, role, text; others are not read.  Null role or
    text is the empty string, a null conv_id is a conversation of its own,
    null turns come first; equal turn numbers are ordered by role, then text;
    repeated rows stay.  A conversation is one or more parts of whole turns,
    in the order of ``seq``; a part ends after a mebi-character (or at a task's end),
    so no task holds a whole conversation however long.  ``loss`` holds the
    spans of assistant texts in ``formatted``.
    """
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rendered = rows.mapInArrow(_render_rows, "conv_id long, turn long, role string, text string, block string, level int")
    dealt = ranged(rendered, "conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "turn", "role", "block", "level").mapInArrow(_assemble, PART_SCHEMA)


def _render_rows(batches):
    def each(rows):
        for r in rows:
            block, level = render(r["role"], r["text"])
            yield r["conv_id"], r["turn"], r["role"], r["text"], block, level

    schema = arrow_schema("conv_id long, turn long, role string, text string, block string, level int")
    yield from batches_of(each, schema, 512)(batches)


def _assemble(batches):
    from pyspark import TaskContext

    # parts of a conversation are ordered by task, then by place in the task
    base = TaskContext.get().partitionId() << 40

    def each(rows):
        key, first, blocks, loss, levels, size, n = None, None, [], [], [], 0, 0

        def part():
            return key, first, base + n, "".join(blocks), loss, levels

        for r in rows:
            if blocks and (r["conv_id"] != key or size >= PART_CHARS):
                yield part()
                n += 1
                blocks, loss, levels, size = [], [], [], 0
            if not blocks:
                key, first = r["conv_id"], r["turn"]
            if r["role"] == "assistant":
                [(_, _, lo, hi)] = parse(r["block"])
                loss.append({"start": size + lo, "end": size + hi})
            blocks.append(r["block"])
            levels.append(r["level"])
            size += len(r["block"])
        if blocks:
            yield part()

    yield from batches_of(each, arrow_schema(PART_SCHEMA), 64)(batches)


DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation, from the formatted parts alone: the parsed turns and
    the masked text, digested in order.  A digest runs over its conversation
    from start to end; the task streams the parts and holds one at a time."""
    n = shuffle_parts(parts.sparkSession)
    dealt = parts.select("conv_id", "seq", "formatted", "loss").repartition(n, "conv_id")
    return dealt.sortWithinPartitions("conv_id", "seq").mapInArrow(_digest, DIGEST_SCHEMA)


def _digest(batches):
    def each(rows):
        key, open_, turns, loss, n, loss_chars, chars = None, False, None, None, 0, 0, 0

        def result():
            return key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        for r in rows:
            if not open_ or r["conv_id"] != key:
                if open_:
                    yield result()
                key, open_, turns, loss, n, loss_chars, chars = r["conv_id"], True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, text, _, _ in parse(r["formatted"]):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            for span in r["loss"]:
                text = unescape(r["formatted"][span["start"] : span["end"]])
                loss.update(text.encode())
                loss_chars += len(text)
            chars += len(r["formatted"])
        if open_:
            yield result()

    yield from batches_of(each, arrow_schema(DIGEST_SCHEMA), 1024)(batches)


def round_trip(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Format, write, read back, digest."""
    return digests(written(format_conversations(turns), "chat"))
