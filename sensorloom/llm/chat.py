"""Operator 13: chat formatting from event logs.

A log has one row per event: conv_id, seq and step (the event's place in the conversation), message, kind, role, text. Kinds:
`message` opens a message with its first text, `delta` appends a streamed piece, `edit` replaces the text, `regenerate`
throws it away and begins with its own. Events are dealt by conversation and message, sorted by sequence and folded as a
stream, so a task holds the text of one message, whatever was streamed and thrown away before and however long the
conversation is. Messages are numbered in their conversation by their first event; the number travels with the events as a
row of its own, so texts move once for the fold and once for the rendering.

Rendered conversations are Parquet rows of at most TURNS turns: text, and the loss mask as spans of code points that cover
the assistant's texts. Nearly all conversations are one row; a longer one goes on in the next row, so a conversation with
any share of all turns is spread over tasks. Only its digest, which SHA-256 makes sequential, is streamed through one task,
row by row.

Template: each turn stands between marks of its role (`MARKS`; another role is written out), a conversation begins with
`<s>`. A control string in a text gets a backslash after its first character, and one that has backslashes there already
gets one more; reading back takes one away. Text that looks like no control string is left as it is.

Cases: null text or role is empty; a null seq comes first; messages opened at equal sequence go by role, a hash of the
opening text, and message; an event delivered twice (equal in all columns) counts once; a message without `message` event
begins with its first event; the last non-null role counts; a null conv_id is a conversation of its own; an empty log gives
no rows. Extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.llm.ordered import number_within
from sensorloom.session import spool, spool_root

# Turns of a row.
TURNS = 256

# Code points of a streamed piece in the logs made from finished conversations.
PIECE = 512

BEGIN = "<s>"
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "</s>")
LEARNED = "assistant"

_ANGLE, _SQUARE = r"(?=/?s>)", r"(?=/?(?:INST|SYS|ANS|ROLE)\])"
_TURN = r"(?s)\[INST\].*?\[/INST\]|\[SYS\].*?\[/SYS\]|\[ANS\].*?</s>|\[ROLE\].*?\[/ROLE\].*?</s>"

LOG = "conv_id long, seq long, step long, message long, kind string, role string, text string"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"<\\*+{_ANGLE}|\[\\*+{_SQUARE}"), F.lit(r"$0\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"(<\\*)\\{_ANGLE}|(\[\\*)\\{_SQUARE}"), F.lit("$1$2"))


def log_of(conversations: DataFrame) -> DataFrame:
    """The event log that leads to finished conversations (conv_id, turn, role, text), stored.

    A user's message is first sent as its first half and then edited; an assistant's is begun, regenerated and streamed
    anew in pieces; others are sent once.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", F.col("turn").alias("seq"), F.monotonically_increasing_id().alias("message"), role.alias("role"), text.alias("text"))

    def event(step: Column | int, kind: str, part: Column) -> Column:
        step = F.lit(step) if isinstance(step, int) else step
        return F.struct(step.cast("long").alias("step"), F.lit(kind).alias("kind"), F.col("role").alias("role"), part.alias("text"))

    whole, nothing = F.col("text"), F.lit("")
    draft = F.substring(whole, F.lit(1), F.floor(F.char_length(whole) / 2).cast("int"))
    pieces = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    streamed = F.transform(pieces, lambda piece, i: event(i + 3, "delta", piece))
    begun = F.array(event(0, "message", nothing), event(1, "delta", draft), event(2, "regenerate", nothing))
    events = (
        F.when(F.col("role") == LEARNED, F.concat(begun, streamed))
        .when(F.col("role") == "user", F.array(event(0, "message", draft), event(1, "edit", whole)))
        .otherwise(F.array(event(0, "message", whole)))
    )
    log = rows.select("conv_id", "seq", "message", F.inline(events))
    return spool(log.select("conv_id", "seq", "step", "message", "kind", "role", "text"))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages of sorted events; the first row of each carries its place."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    head, parts, role, last = None, [], "", None
    done: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    for rows in batches:
        for top in range(0, rows.num_rows, 256):
            for e in rows.slice(top, 256).to_pylist():
                if e["place"] is not None:
                    if head is not None:
                        done.append((*head, role, "".join(parts)))
                        size += len(done[-1][3])
                    head, parts, role, last = (e["conv_id"], e["place"]), [], "", None
                    if size > 1 << 22 or len(done) == 2_000:
                        yield batch()
                        done, size = [], 0
                    continue
                this = (e["seq"], e["step"], e["kind"], e["role"], e["text"])
                if this == last:
                    continue
                last = this
                if e["kind"] != "delta":
                    parts = []
                parts.append(e["text"] or "")
                role = role if e["role"] is None else e["role"]
    if head is not None:
        done.append((*head, role, "".join(parts)))
        yield batch()


def messages(log: DataFrame) -> DataFrame:
    """Final messages of a stored log: (conv_id, place, role, text), `place` from 0 in each conversation."""
    log = log.select("conv_id", "seq", "step", "message", "kind", "role", "text")
    opened = F.min(F.struct("seq", "step", "role", F.xxhash64("text").alias("tie"))).alias("opened")
    opens = spool(log.groupBy("conv_id", "message").agg(opened).select("conv_id", "message", "opened.*"))
    places = number_within(opens, ["conv_id"], ["seq", "step", "role", "tie", "message"]).select("conv_id", "message", "place")
    both = log.withColumn("place", F.lit(None).cast("long")).unionByName(places, allowMissingColumns=True)
    dealt = both.repartition("conv_id", "message").sortWithinPartitions(
        "conv_id", "message", F.col("place").isNull(), "seq", "step", "kind", "role", "text"
    )
    return dealt.mapInArrow(_fold, "conv_id long, place long, role string, text string")


def render(turns: DataFrame, per_row: int = TURNS) -> DataFrame:
    """Formatted rows of messages: (conv_id, row, n_turns, text, loss); spans in `loss` are [start, end) in code points."""
    role = F.coalesce("role", F.lit(""))
    before, after = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])), F.lit(OTHER[2])
    for name, (left, right) in MARKS.items():
        before, after = F.when(role == name, F.lit(left)).otherwise(before), F.when(role == name, F.lit(right)).otherwise(after)
    before = F.concat(F.when(F.col("place") == 0, F.lit(BEGIN)).otherwise(F.lit("")), before)
    body = escape(F.coalesce("text", F.lit("")))
    cut = turns.select("conv_id", "place", F.expr(f"place div {per_row}").alias("row"), (role == LEARNED).alias("learned"),
                       before.alias("before"), body.alias("body"), after.alias("after"))
    cut = cut.withColumn("lead", F.char_length("before")).withColumn("long", F.char_length("body"))
    row = Window.partitionBy("conv_id", "row").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("lead") + F.col("long") + F.char_length("after")).over(row), F.lit(0)) + F.col("lead")
    cut = cut.select("conv_id", "row", "place", "learned", F.concat("before", "body", "after").alias("turn"), start.alias("start"), (start + F.col("long")).alias("end"))
    listed = F.array_sort(F.collect_list(F.struct("place", "turn")))
    spans = F.array_sort(F.collect_list(F.when(F.col("learned"), F.struct("start", "end"))))
    return cut.groupBy("conv_id", "row").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(listed, lambda t: t["turn"]), "").alias("text"), spans.alias("loss"))


def chat_folder(spark: SparkSession) -> str:
    return f"{spool_root(spark)}/chat-{uuid.uuid4().hex}"


def write_chats(log: DataFrame, path: str, per_row: int = TURNS) -> None:
    render(messages(log), per_row).write.parquet(path)


def _between(turn: Column, left: str, right: str) -> Column:
    return F.substring(turn, F.lit(len(left) + 1), F.char_length(turn) - len(left) - len(right))


def read_turns(rows: DataFrame) -> DataFrame:
    """Formatted rows with the turns parsed from the text (role, text, unescaped) and the text under the loss mask."""

    def parsed(turn: Column) -> Column:
        inner = _between(turn, OTHER[0], OTHER[2])
        cut = F.instr(inner, OTHER[1])
        role = F.substring(inner, F.lit(1), cut - 1)
        text = F.substring(inner, cut + len(OTHER[1]), F.char_length(inner))
        for name, (left, right) in MARKS.items():
            mine = F.startswith(turn, F.lit(left))
            role, text = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, _between(turn, left, right)).otherwise(text)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    turns = F.transform(F.regexp_extract_all("text", F.lit(_TURN), F.lit(0)), parsed)
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return rows.select("conv_id", "row", F.char_length("text").alias("chars"), turns.alias("turns"), learned.alias("learned"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and digests of conversations whose rows come in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    done: list[tuple] = []
    now = None

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    def close() -> None:
        conv, turns, all_turns, loss, all_loss, chars = now
        done.append((conv, turns, all_turns.hexdigest(), loss, all_loss.hexdigest(), chars))

    for rows in batches:
        for top in range(0, rows.num_rows, 64):
            for r in rows.slice(top, 64).to_pylist():
                if r["row"] == 0:
                    if now is not None:
                        close()
                    now = [r["conv_id"], 0, sha256(), 0, sha256(), 0]
                now[1] += r["n_turns"]
                now[2].update(r["turns"].encode())
                now[3] += len(r["learned"])
                now[4].update(r["learned"].encode())
                now[5] += r["chars"]
        if len(done) >= 2_000:
            yield batch()
            done = []
    if now is not None:
        close()
        yield batch()


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per conversation, from its formatted rows alone: turns, digest of all turns, the text under the mask, length."""
    read = read_turns(spark.read.schema("conv_id long, row long, text string, loss array<struct<start:long,end:long>>").parquet(path))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    slim = read.select("conv_id", "row", F.size("turns").cast("long").alias("n_turns"), said.alias("turns"), F.array_join("learned", "").alias("learned"), F.col("chars").cast("long").alias("chars"))
    dealt = slim.repartition("conv_id").sortWithinPartitions("conv_id", "row")
    return dealt.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
