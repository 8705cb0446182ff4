"""Chat formatting with a grammar round trip: render, reparse, compare, escape what conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import running_total

# Fixed values of the template.
START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escaped(text: Column) -> Column:
    r"""One more backslash inside every ``<|``, ``<\|``, ``<\\|`` ...: no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    """Undoes ``escaped`` for every text."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def pieces(formatted: Column) -> Column:
    """What follows each start mark."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def parsed(piece: Column) -> Column:
    """Grammar of one turn: role, newline, body, end mark, newline. Struct (role, text, body, whole)."""
    head = F.substring_index(piece, "\n", 1)
    rest = F.substring(piece, F.length(head) + 2, F.length(piece))
    body = F.substring_index(rest, END, 1)
    return F.struct(
        unescaped(F.replace(head, F.lit(NEWLINE), F.lit("\n"))).alias("role"),
        unescaped(body).alias("text"),
        body.alias("body"),
        (piece == F.concat(head, F.lit("\n"), body, F.lit(END + "\n"))).alias("whole"),
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (role, text), loss_spans, round_trip, escaped_turns.

    ``turns(conv_id, turn, role, text)``; null role or text counts as empty, null conv_id is a conversation of
    its own, null turns come first, repeated turns are all kept (ordered by turn, role, text). An empty table
    gives no rows; other columns are not read. A conversation is one training example and lies in one row.

    A turn is rendered plainly and parsed back; only if role or text differ is it rendered escaped. The whole
    conversation is then parsed: ``turns`` is what came back, ``round_trip`` says that it equals the source.
    ``loss_spans`` are the code points (start, end) of ``formatted`` that hold the assistant's bodies.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("plain", rendered(F.col("role"), F.col("text")))
    rows = rows.withColumn("back", F.transform(pieces(F.col("plain")), parsed))
    same = (F.size("back") == 1) & F.exists("back", lambda t: (t["role"] == F.col("role")) & (t["text"] == F.col("text")) & t["whole"])
    safe = rendered(F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), escaped(F.col("text")))
    rows = rows.withColumn("same", same).withColumn("piece", F.when(F.col("same"), F.col("plain")).otherwise(safe))
    whole = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "piece"))).alias("source"), F.count(F.when(~F.col("same"), 1)).alias("escaped_turns")
    )
    whole = whole.withColumn("formatted", F.array_join("source.piece", ""))
    whole = whole.withColumn("parts", pieces(F.col("formatted")))
    whole = whole.withColumn("read", F.transform("parts", parsed))
    whole = whole.withColumn("before", running_total(F.transform("parts", lambda p: (F.length(p) + len(START)).cast("long"))))
    places = F.zip_with("read", "before", lambda t, b: F.struct(t["role"].alias("role"), (b + len(START)).alias("at"), F.length(t["body"]).alias("n")))
    bodies = F.zip_with(places, "parts", lambda x, p: F.struct(x["role"].alias("role"), (x["at"] + F.length(F.substring_index(p, "\n", 1)) + 1).alias("start"), x["n"].alias("n")))
    loss = F.transform(F.filter(bodies, lambda x: x["role"] == "assistant"), lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["n"]).alias("end")))
    known = F.transform("source", lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text")))
    got = F.transform("read", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return whole.select(
        "conv_id", "formatted", got.alias("turns"), loss.alias("loss_spans"),
        ((got == known) & ~F.exists("read", lambda t: ~t["whole"])).alias("round_trip"), "escaped_turns",
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
