"""Chat formatting from event logs, with DataFrame functions only.

A log row is (conv_id, turn, seq, kind, role, text). Kinds:
  message     opens a message in its turn, with a role and text
  delta       appends text to the turn's open message
  edit        replaces the message's text
  regenerate  discards the message's text; deltas or text of this row follow
  delete      removes the message
Rows are dealt by conversation and turn, put in order of seq, and folded from the
last row that resets the text; messages are then dealt by conversation, in order
of turn, and rendered.

The template is <|im_start|>role, a line feed, text, <|im_end|>, a line feed.
Backslashes in roles and texts are doubled and <| becomes <\\|, so no text can hold
a control string; a line feed in a role becomes <|nl|>. The loss mask is a list of
spans in code points that cover the texts of assistants.

Defined cases: null text and null role are empty; a null kind is a message; rows
that share a turn and are messages stay separate messages, in order of (seq, role,
text); rows before a turn's first message belong to a message with an empty role;
null conv_id is one conversation, null turns come first; a conversation whose
messages are all deleted has no row; a repeated row is a message of its own; an empty
table gives no rows; long texts are folded and rendered whole, and one conversation is
one row, made in one task; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, nth, role, text): the messages that a log leaves."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    order = Window.partitionBy("conv_id", "turn").orderBy("seq", "role", "text", "kind")
    rows = events.select("conv_id", "turn", "seq", kind.alias("kind"), F.col("role"), text.alias("text"))
    rows = rows.withColumn("nth", F.sum((F.col("kind") == "message").cast("int")).over(order)).withColumn("at", F.row_number().over(order))
    log = F.array_sort(F.collect_list(F.struct("at", "kind", "role", "text")))
    messages = rows.groupBy("conv_id", "turn", "nth").agg(log.alias("log"))
    resets = F.filter("log", lambda e: e["kind"].isin("message", "edit", "regenerate"))
    last = F.coalesce(F.get(resets, F.size(resets) - 1)["at"], F.lit(0))
    return (
        messages.where(~F.exists("log", lambda e: e["kind"] == "delete"))
        .withColumn("last", last)
        .select(
            "conv_id",
            "turn",
            "nth",
            F.coalesce(F.get(F.filter("log", lambda e: e["role"].isNotNull()), F.lit(0))["role"], F.lit("")).alias("role"),
            F.array_join(F.transform(F.filter("log", lambda e: e["at"] >= F.col("last")), lambda e: e["text"]), "").alias("text"),
        )
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): the template over messages in order of (turn, nth)."""
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    parts = messages.select("conv_id", "turn", "nth", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    before = Window.partitionBy("conv_id").orderBy("turn", "nth").rowsBetween(Window.unboundedPreceding, -1)
    length = F.char_length("head") + F.char_length("body") + len(END) + 1
    at = F.coalesce(F.sum(length).over(before), F.lit(0)) + F.char_length("head")
    placed = parts.withColumn("start", at).withColumn("end", F.col("start") + F.char_length("body"))
    turns = F.array_sort(F.collect_list(F.struct("start", "end", "role", F.concat("head", "body", F.lit(END + "\n")).alias("part"))))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == TRAINED_ROLE), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return placed.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["part"]), "").alias("formatted"), spans.alias("loss_spans")
    )


def format_conversations(events: DataFrame) -> DataFrame:
    return render(fold_events(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (role, text), parsed from the output, and loss_text, the unescaped text under the mask."""
    parts = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda p: p != "")
    role = lambda p: F.substring_index(p.substr(F.lit(len(START) + 1), F.char_length(p)), "\n", 1)
    text = lambda p: p.substr(F.char_length(role(p)) + len(START) + 2, F.char_length(p))
    turn = lambda p: F.struct(unescape(F.replace(role(p), F.lit(LINE), F.lit("\n"))).alias("role"), unescape(text(p)).alias("text"))
    under = lambda s: F.col("formatted").substr(s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))
    return formatted.withColumn("turns", F.transform(parts, turn)).withColumn(
        "loss_text", unescape(F.array_join(F.transform("loss_spans", under), ""))
    )
