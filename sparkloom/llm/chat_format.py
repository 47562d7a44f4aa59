"""Chat formatting: conversations rebuilt from event logs, then rendered with a loss mask.

A conversation arrives as events (conv_id, seq, message, kind, role, text):

* ``message``: the whole text of a message;
* ``edit``: replaces the text of a message, role kept unless given;
* ``regenerate``: starts a message afresh with the given text (often empty);
* ``delta``: appends to what the message has by then.

``fold_events`` gives each message its final text: that of its last event
other than a delta, followed by the later deltas in order of ``seq``.
``render`` writes one string a conversation, in order of ``message``, and the
spans of it that count for the loss. ``read_back`` recovers turns and
loss text from these two alone.

Everything is DataFrame and SQL functions. Deltas are folded by message
before anything is gathered by conversation, so a conversation with very many
events is spread over tasks until its final text, one row by definition, is
put together.

Defined cases: null text counts as empty and null role as the empty role; an
unknown or null kind counts as ``message``; events of one message with equal
``seq`` are taken in order of kind (delta last), then text, and exact
repetitions of an event count once; a null conv_id is a conversation of its
own; no events, no rows; further columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OPEN, ROLE_END, CLOSE = "<s>[INST] ", " [/INST]\n", "</s>\n"
# A control string is one of <s> </s> [INST] [/INST]. Inside a text, one more
# backslash goes behind its first character; reading takes one away again.
_RAW = r"([<\[])(\\*)(/?s>|/?INST\])"
_SLASHED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    """``text`` without control strings, reversibly."""
    return F.regexp_replace(text, _RAW, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _SLASHED, "$1$2$3")


def fold_events(events: DataFrame) -> DataFrame:
    """One row a message: conv_id, message, role, text."""
    kind = F.when(F.col("kind").isin("edit", "regenerate", "delta"), F.col("kind")).otherwise("message")
    order = F.when(kind == "delta", 1).otherwise(0)
    event = F.struct(F.col("seq").alias("seq"), order.alias("late"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("role"))
    folded = (
        events.select("conv_id", "message", event.alias("e"))
        .groupBy("conv_id", "message")
        .agg(
            F.max(F.when(F.col("e.late") == 0, F.col("e"))).alias("base"),
            F.collect_set(F.when(F.col("e.late") == 1, F.col("e"))).alias("deltas"),
            F.max_by("e.role", F.when(F.col("e.role").isNotNull(), F.col("e"))).alias("role"),
        )
    )
    later = F.filter("deltas", lambda d: F.col("base").isNull() | (F.struct(d.seq, d.late) > F.struct(F.col("base.seq"), F.col("base.late"))))
    text = F.concat(F.coalesce("base.text", F.lit("")), F.array_join(F.transform(F.array_sort(later), lambda d: d.text), ""))
    return folded.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans.

    Each span has the ordinal of its turn, where the turn starts in
    ``formatted``, and start and length of the loss text, in code points.
    """
    head = F.concat(F.lit(OPEN), escape("role"), F.lit(ROLE_END))
    turns = messages.select("conv_id", "message", "role", head.alias("head"), escape("text").alias("body"))
    turns = turns.withColumn("segment", F.concat("head", "body", F.lit(CLOSE)))
    by = W.partitionBy("conv_id").orderBy("message", "role", "body")
    turns = turns.select(
        "conv_id",
        "segment",
        F.row_number().over(by).alias("turn"),
        (F.sum(F.length("segment")).over(by.rowsBetween(W.unboundedPreceding, 0)) - F.length("segment")).alias("turn_start"),
        F.when(F.col("role") == loss_role, F.length("head")).alias("skip"),
        F.length("body").alias("length"),
    )
    span = F.struct("turn", "turn_start", (F.col("turn_start") + F.col("skip")).alias("start"), "length")
    whole = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "segment"))).alias("segments"),
        F.array_sort(F.collect_list(F.when(F.col("skip").isNotNull(), span))).alias("loss_spans"),
    )
    return whole.select("conv_id", F.array_join("segments.segment", "").alias("formatted"), "loss_spans")


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text) and loss_texts, both recovered
    from ``formatted`` and ``loss_spans``, with ``formatted`` kept."""
    pieces = F.split("formatted", CLOSE, -1)
    cut = rendered.withColumn("pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    mark = F.lit(ROLE_END)

    def turn(piece: Column) -> Column:
        at = F.instr(piece, mark)
        return F.struct(
            unescape(F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"),
            unescape(F.substring(piece, at + len(ROLE_END), F.length(piece))).alias("text"),
        )

    def loss(span: Column) -> Column:
        piece = F.element_at("pieces", span.turn)
        return unescape(F.substring(piece, (span.start - span.turn_start + 1).cast("int"), span.length))

    return cut.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), F.transform("loss_spans", loss).alias("loss_texts"))


def format_conversations(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Events to one rendered training text a conversation."""
    return render(fold_events(events), loss_role)


#: Characters of one streamed piece.
PIECE = 1000


def table_events(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as the log of how they came:
    a message with a first draft (its beginning), a regenerate that drops it, and the
    text as deltas of ``piece`` characters.

    Rows that share conversation and turn stay messages of their own, in order
    of role and text: a message is known by turn and place among these. Only
    rows of one turn are brought together before the fold.
    """
    by = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    message = F.struct("turn", F.row_number().over(by).alias("nth"))
    n = F.coalesce(F.ceil(F.length("text") / piece), F.lit(0)).cast("int")
    event = lambda seq, kind, text: F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    deltas = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: event(i + 2, "delta", F.substring("text", i * piece + 1, F.lit(piece)))))
    first = F.array(event(F.lit(0), "message", F.left("text", F.lit(8))), event(F.lit(1), "regenerate", F.lit("")))
    log = F.concat(first, F.coalesce(deltas, F.slice(first, 1, 0)))
    known = conversations.select("conv_id", "turn", "role", "text", message.alias("message"))
    return known.select("conv_id", "message", "role", F.explode(log).alias("e")).select("conv_id", "e.seq", "message", "e.kind", "role", "e.text")
