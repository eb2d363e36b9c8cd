r"""Chat formatting with a grammar round trip, in DataFrame functions alone.

Template, one piece per turn::

    <s>[INST] ROLE [/INST]\nTEXT</s>\n

The four markers are the control strings.  A turn is first rendered as it is;
a deterministic parser (cut at the end marker, then at the role marker;
control strings inside a role or text are an error; bar escapes are undone)
reads it back.  Turns that do not come back identical are escaped: each
control string, and each string that looks like an escaped one, gets one more
backslash after its first character (``</s>`` -> ``<\/s>`` -> ``<\\/s>``),
which the parser takes off again, so any text survives.  The whole
conversation is then parsed once more, and must be the source.

Defined results: null text and null role are empty; turns are ordered by
turn (nulls first), then role, then text, so repeated turns have one order;
a null conv_id is a conversation of its own; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings with any number of bars: first character, bars, rest.
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_RAW = r"[<\[]/?(?:s>|INST\])"
_OPEN, _ROLE_END, _TURN_END = "<s>[INST] ", " [/INST]\n", "</s>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_CONTROL), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_CONTROL.replace(r"(\\*)", r"\\(\\*)")), F.lit("$1$2$3"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(_OPEN), role, F.lit(_ROLE_END), text, F.lit(_TURN_END))


def parse(rendered: Column) -> Column:
    """Turns of a rendered conversation: structs of role, text, raw text as
    rendered, and ok (false where the grammar does not hold)."""

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(_OPEN) + 1), F.length(piece))
        cut = F.instr(inner, _ROLE_END)
        role = F.substring(inner, F.lit(1), cut - 1)
        text = F.substring(inner, cut + len(_ROLE_END), F.length(inner))
        ok = piece.startswith(_OPEN) & (cut > 0) & ~role.rlike(_RAW) & ~text.rlike(_RAW)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"), text.alias("raw"), (F.length(role) + len(_ROLE_END) + len(_OPEN)).alias("lead"), ok.alias("ok"))

    pieces = F.split(rendered, F.lit(r"</s>\n"))
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def format_turns(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with ``rendered`` and ``escaped``.

    Works row by row, so a conversation that holds a third of all rows still
    spreads over all tasks here.
    """
    out = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    out = out.withColumn("plain", render_turn(F.col("role"), F.col("text")))
    back = parse(F.col("plain"))
    same = (F.size(back) == 1) & F.coalesce(back[0]["ok"] & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text")), F.lit(False))
    out = out.withColumn("escaped", ~F.coalesce(same, F.lit(False)))
    return out.select(
        "conv_id", "turn", "role", "text", "escaped",
        F.when(F.col("escaped"), render_turn(escape(F.col("role")), escape(F.col("text")))).otherwise(F.col("plain")).alias("rendered"),
    )


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: rendered text, the turns recovered from it, the
    loss mask (spans of code points over assistant texts, end exclusive) and
    ``identical``: the recovered turns are the source's."""
    turns = format_turns(rows)
    source = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered")))
    out = turns.groupBy("conv_id").agg(source.alias("source"))
    out = out.select("conv_id", "source", F.array_join(F.transform("source", lambda t: t["rendered"]), "").alias("rendered"))
    out = out.withColumn("turns", parse(F.col("rendered")))
    same = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    back = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    out = out.withColumn("identical", (same == back) & ~F.exists("turns", lambda t: ~t["ok"]))
    # Where each turn's raw text starts: the lengths of the turns before it, and its own lead.
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(s: Column, t: Column) -> Column:
        start = s["at"] + t["lead"]
        end = start + F.length(t["raw"])
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
        spans = F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(span))).otherwise(s["spans"])
        return F.struct((end + len(_TURN_END)).cast("long").alias("at"), spans.alias("spans"))

    return out.withColumn("loss_mask", F.aggregate("turns", first, add, lambda s: s["spans"]))


def loss_text(rendered: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(rendered, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, all read back from the rendered text.  A
    conversation that did not come back identical would have null counts and
    digests, and would not stop the others."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = formatted.withColumn("loss", loss_text(F.col("rendered"), F.col("loss_mask")))
    sound = lambda c: F.when(F.col("identical"), c)
    return out.select(
        "conv_id", sound(F.size("turns").cast("long")).alias("n_turns"), sound(F.sha2(whole.cast("binary"), 256)).alias("turns_sha256"),
        sound(F.length("loss").cast("long")).alias("loss_chars"), sound(F.sha2(F.col("loss").cast("binary"), 256)).alias("loss_sha256"),
        F.length("rendered").cast("long").alias("formatted_chars"),
    )
