"""Chat formatting: conversations as one text with marked turns and a loss mask.

Method: a finite-state machine over roles.  The template declares the roles, which role may
follow which, and whose text is learned; the machine walks the turns in order and either
accepts the conversation or names the first turn that breaks it.  Each turn then gives three
segments (opening with role, text, closing), each with its loss flag, and the formatted text
is their concatenation.

Control strings (the template's marks, and those of other templates) that stand inside a
text are taken apart by a backslash after their first character; a backslash of the text
itself is doubled.  So no control string of a text survives, and the text can be read back.
Only DataFrame functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open, mid and close stand around role and text; ``follows`` maps a state (the last role,
    "" at the start) to the roles that may come next; ``learned`` are the roles under the loss;
    ``final`` the roles that a conversation may end with."""

    open: str = "<|im_start|>"
    mid: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    learned: tuple[str, ...] = ("assistant",)
    final: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    """Control strings of other templates, taken apart as well."""

    def __post_init__(self):
        if any("\\" in c or len(c) < 2 for c in self.controls):
            raise ValueError("control strings have two characters or more and no backslash")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.mid, self.close, *self.foreign)


def _quoted(s: str) -> str:
    return re.sub(r"([^\w])", r"\\\1", s)


def escaped(text: Column, t: Template) -> Column:
    """Doubles each backslash and puts one after the first character of each control string, overlapping ones too."""
    starts = "|".join(f"{_quoted(c[0])}(?={_quoted(c[1:])})" for c in t.controls)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), starts, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(\\?)", "$1")


def formatted(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, error_turn (position of the first turn
    out of order; n_turns if the last role may not end a conversation; else null), segments (array
    of kind, text, loss), formatted (their concatenation).

    ``turns``: (conv_id, turn, role, text, ...), in the order of turn; further columns are ignored.
    Null texts and roles are empty ones, and an empty role is never in order.  Turns of equal
    number are ordered by role and text; null numbers come first; a null conv_id is a conversation
    of its own.  Repeated rows are turns of their own.  Conversations of any length are formatted
    whole, out-of-order ones too.
    """
    t = template
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = turns.select("conv_id", row.alias("r")).groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    arcs = F.array(*(F.lit(f"{len(a)} {a} {b}") for a, bs in t.follows.items() for b in bs))
    arc = lambda a, b: F.concat_ws(" ", F.length(a).cast("string"), a, b)
    # the state is the last role while all is well; bad holds the first turn that broke the order
    machine = F.aggregate(
        "rows",
        F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad")),
        lambda s, x: F.struct(x["role"].alias("state"), (s["at"] + 1).alias("at"), F.coalesce(s["bad"], F.when(~F.array_contains(arcs, arc(s["state"], x["role"])), s["at"])).alias("bad")),
    )
    ends = F.array(*map(F.lit, t.final)).cast("array<string>")
    learned = F.array(*map(F.lit, t.learned)).cast("array<string>")
    segment = lambda kind, text, loss: F.struct(F.lit(kind).alias("kind"), text.alias("text"), loss.alias("loss"))
    parts = F.flatten(F.transform("rows", lambda x: F.array(
        segment("open", F.concat(F.lit(t.open), escaped(x["role"], t), F.lit(t.mid)), F.lit(False)),
        segment("text", escaped(x["text"], t), F.array_contains(learned, x["role"])),
        segment("close", F.lit(t.close), F.lit(False)),
    )))
    out = conv.withColumn("m", machine).withColumn("segments", parts)
    error = F.coalesce(F.col("m.bad"), F.when(~F.array_contains(ends, F.col("m.state")), F.col("m.at")))
    return out.select("conv_id", F.size("rows").cast("long").alias("n_turns"), error.isNull().alias("valid"), error.alias("error_turn"), "segments", F.array_join("segments.text", "").alias("formatted"))


def read_back(texts: DataFrame, template: Template = Template(), carry: tuple = ()) -> DataFrame:
    """(conv_id, formatted, turns (array of role, text), those to carry along) from (conv_id, formatted, ...):
    the inverse of :func:`formatted`.  A null or empty formatted text has no turns."""
    t = template
    chunks = F.slice(F.split("formatted", _quoted(t.open)), F.lit(2), F.length("formatted"))
    text_of = lambda c: F.substring_index(F.split(c, _quoted(t.mid))[1], t.close, 1)
    turn = lambda c: F.struct(unescaped(F.substring_index(c, t.mid, 1)).alias("role"), unescaped(text_of(c)).alias("text"))
    return texts.select("conv_id", "formatted", F.transform(chunks, turn).alias("turns"), *carry)


def digests(formatted_rows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, error_turn of
    :func:`formatted`'s rows (conv_id, formatted, segments, valid, error_turn).

    Turns are read back from the formatted text, and what is learned from the segments whose flag is
    set.  A conversation without learned text has the digest of the empty text; an empty table gives
    an empty result; repeated rows give a row each.
    """
    sha = lambda s: F.sha2(F.encode(s, "UTF-8"), 256)
    every = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescaped(x["text"])), "")
    back = read_back(formatted_rows, template, ("valid", "error_turn", loss.alias("loss")))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(every).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "error_turn")
