r"""Chat formatting from an event log, with DataFrame functions only.

A log holds events ``(conv_id, message_id, seq, event, role, text)``: ``message`` opens a message,
``delta`` adds streamed text to it, ``edit`` sets its text, ``regenerate`` starts its text anew. The log
is folded per message, so a conversation with very many events is spread over many tasks; messages
then come together, in the order of their first events, where the one string of a conversation is made.

Rendered turns are ``<|im_start|>role\ntext<|im_end|>\n``. Control strings inside texts and roles are
escaped reversibly: in ``<``, any number of ``!``, ``|`` one ``!`` is added, so ``<|`` stands only
where the template put it. In roles a line break becomes ``\n`` and a backslash ``\s``. A turn's loss
span is kept as (start, length) within the turn, in characters of the rendered turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
START = "<|im_start|>"
END = "<|im_end|>"


def fold(events: DataFrame) -> DataFrame:
    """``(conv_id, position, role, text)``: the final text of every message.

    Events of a message apply in the order of ``seq``, ties by event, role and text, a null ``seq``
    first. Any event but ``delta`` sets the text; null texts are empty, a message takes its first role
    that is not null (else empty) and stands where its first event does.
    """
    event = F.struct("seq", F.coalesce("event", F.lit("message")).alias("event"), "role", F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "message_id").agg(F.sort_array(F.collect_list(event)).alias("log"))
    last_set = F.array_max(F.transform("log", lambda x, i: F.when(x["event"] != "delta", i).otherwise(0)))
    current = F.slice("log", last_set + 1, F.size("log"))
    role = F.filter("log", lambda x: x["role"].isNotNull())
    return log.select(
        "conv_id",
        F.col("log")[0]["seq"].alias("position"),
        F.coalesce(F.get(role, F.lit(0))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(current, lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, spans)`` per conversation, turns by position, then role and text.

    ``spans`` has a turn's ``(start, length)`` under the loss mask; other roles have length zero.
    """
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    body = _escape(F.col("text"))
    length = F.when(F.col("role") == loss_role, F.length("body")).otherwise(0)
    turns = messages.withColumns({"head": head, "body": body}).select(
        "conv_id",
        F.struct(
            "position",
            "role",
            "text",
            F.concat("head", "body", F.lit(END + "\n")).alias("turn"),
            F.struct(F.length("head").alias("start"), length.alias("length")).alias("span"),
        ).alias("turn"),
    )
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"),
        F.transform("turns", lambda x: x["span"]).alias("spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, turns, losses, formatted)``: roles and texts found in the output, and what the mask covers."""
    pieces = F.transform(F.split("formatted", r"<\|im_start\|>"), lambda x: F.concat(F.lit(START), x))
    cut = formatted.withColumn("pieces", F.slice(pieces, 2, F.size(pieces)))

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(START) + 1), F.length(piece) - len(START) - len(END) - 1)
        role = F.substring_index(inner, "\n", 1)
        return F.struct(_unescape_role(role).alias("role"), _unescape(F.substr(inner, F.length(role) + 2)).alias("text"))

    def loss(piece: Column, span: Column) -> Column:
        return _unescape(F.substr(piece, span["start"] + 1, span["length"]))

    return cut.select(
        "conv_id",
        F.transform("pieces", turn).alias("turns"),
        F.zip_with("pieces", "spans", loss).alias("losses"),
        "formatted",
    )


def digests(read: DataFrame) -> DataFrame:
    """Turn count, digest of roles and texts, length and digest of the loss text, length of the output."""
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(!*)\|", "<!$1|")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<!(!*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return _escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(_unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))
