"""Chat formatting with DataFrame functions only: event-sourced reconstruction of conversations, then rendering.

Events are rows (conv_id, seq, message, kind, role, text). Within a conversation they are folded in order of seq:
`delta` appends its text to its message; `edit` replaces what the message holds so far; `regenerate` empties it, so that
later deltas build it anew; any other kind, null included, counts as a delta. A message stands where its first event stood
and has the role of its last event that names one. Since an edit or regeneration makes all earlier texts of a message void,
the fold is: drop events before the last reset, then join the rest in order.

A turn renders as <turn role="ROLE">\\nTEXT</turn>\\n. In roles and texts & < and " become &amp; &lt; &quot;, so that no
text can look like a mark, and parsing restores every string. The loss mask lists code point ranges (end exclusive) of the
assistant's texts in the rendered string. Offsets are running sums over the messages of a conversation.

Edge cases: a null text or role is empty; a null conv_id is a conversation of its own; equal seq are ordered by message,
kind, role and text, so repeated rows stay; a conversation whose messages are all empty renders all the same; an empty
table gives no rows; further columns are ignored whatever their names. The rendered conversation is one string by
contract, so that one row must hold it; nothing else of a conversation is gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the template.
OPEN, MIDDLE, CLOSE = '<turn role="', '">\n', "</turn>\n"


def escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def restored(text: Column) -> Column:
    out = text
    for a, b in (('"', "&quot;"), ("<", "&lt;"), ("&", "&amp;")):
        out = F.replace(out, F.lit(b), F.lit(a))
    return out


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, first_seq, role, text) of the events."""
    order = ["seq", "kind", "role", "text"]
    rows = events.select("conv_id", "seq", "message", F.coalesce(F.lower("kind"), F.lit("delta")).alias("kind"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    of = Window.partitionBy("conv_id", "message").orderBy(*order)
    rows = rows.withColumn("n", F.row_number().over(of))
    whole = Window.partitionBy("conv_id", "message")
    reset = F.coalesce(F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("n"))).over(whole), F.lit(0))
    rows = rows.withColumn("first_seq", F.min("seq").over(whole)).withColumn("live", F.col("n") >= reset)
    text = F.when(F.col("live") & (F.col("kind") != "regenerate"), F.struct("n", "text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda x: x["text"]), "")
    role = F.max_by("role", F.when(F.col("role").isNotNull(), F.col("n")))
    return rows.groupBy("conv_id", "message", "first_seq").agg(F.coalesce(role, F.lit("")).alias("role"), joined.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask, n_turns) from messages (conv_id, message, first_seq, role, text); mask: array of (start, stop)."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE))
    rows = messages.select("conv_id", "message", "first_seq", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    by = Window.partitionBy("conv_id").orderBy(F.col("first_seq").asc_nulls_first(), F.col("message").asc_nulls_first())
    before = F.coalesce(F.sum(F.length("piece").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    rows = rows.withColumn("at", F.row_number().over(by)).withColumn("before", before)
    start = F.col("before") + F.length("head")
    span = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.length("body")).alias("stop")))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"])
    return rows.groupBy("conv_id").agg(F.array_join(pieces, "").alias("formatted"), F.array_sort(F.collect_list(span)).alias("mask"), F.count(F.lit(1)).alias("n_turns"))


def parse(rendered: DataFrame) -> DataFrame:
    """Turns (conv_id, at, role, body, text, start, stop) read back from `formatted`; start and stop bound the text in it."""
    cut = F.split("formatted", CLOSE, -1)
    rows = rendered.select("conv_id", F.posexplode(F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))).alias("at", "piece"))
    parts = F.split("piece", MIDDLE, 2)
    rows = rows.withColumn("head", F.element_at(parts, 1)).withColumn("body", F.element_at(parts, 2))
    by = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("piece").cast("long") + len(CLOSE)).over(by), F.lit(0))
    start = (before + F.length("head") + len(MIDDLE)).cast("long")
    role = restored(F.expr(f"substring(head, {len(OPEN) + 1})"))
    return rows.select("conv_id", "at", role.alias("role"), "body", restored(F.col("body")).alias("text"), start.alias("start"), (start + F.length("body")).alias("stop"))


def digests(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the rendered strings and masks.

    The loss text is what the string holds under the mask: each range is cut from the piece of the string that it starts in.
    """
    turns = parse(rendered)
    mask = rendered.select(F.col("conv_id").alias("c"), F.explode("mask").alias("m")).select("c", F.col("m.start").alias("s"), F.col("m.stop").alias("e"))
    turns = turns.join(mask, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("start") == F.col("s")), "left")
    under = restored(F.expr("substring(body, 1, cast(e - s as int))"))
    listed = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda y: y["v"]), "")
    all_turns = listed(F.struct("at", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("v")))
    loss = listed(F.when(F.col("s").isNotNull(), F.struct("at", under.alias("v"))))
    back = turns.groupBy(F.col("conv_id").alias("c")).agg(F.count(F.lit(1)).alias("n_turns"), all_turns.alias("turns"), loss.alias("loss"))
    back = back.select("c", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"))
    rows = rendered.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"))
    return rows.join(back, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def streamed(conversations: DataFrame, chunk: int = 120) -> DataFrame:
    """A plain log (conv_id, turn, role, text) as the events that a chat service would have written for it.

    A row is a message of its own, in order of turn, role and text. Its text streams in deltas of `chunk` characters. Before
    that an assistant's message has a draft that is regenerated, and any other a draft that is edited. An empty or null
    text has one empty delta.
    """
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("message", F.row_number().over(by))
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(chunk))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    deltas = F.transform(starts, lambda k: event("delta", F.col("text").substr(k + 1, F.lit(chunk))))
    first = F.element_at(deltas, 1)["text"]
    draft = event("delta", F.reverse(first))
    again = F.concat(F.array(draft, event("regenerate", F.lit(None).cast("string"))), deltas)
    edited = F.concat(F.array(draft, event("edit", first)), F.slice(deltas, F.lit(2), F.greatest(F.size(deltas) - 1, F.lit(0))))
    rows = rows.select("conv_id", "message", "role", F.posexplode(F.when(F.col("role") == "assistant", again).otherwise(edited)).alias("k", "event"))
    seq = F.col("message").cast("long") * F.lit(1 << 32) + F.col("k")
    return rows.select("conv_id", seq.alias("seq"), "message", "event.kind", F.when(F.col("k") == 0, F.col("role")).alias("role"), "event.text")
