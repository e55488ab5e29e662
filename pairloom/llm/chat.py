"""Chat formatting: a role automaton, text segments and loss flags from a declarative template.

All of it is column expressions. Each conversation is grouped once (its turns have
to stand in one text, so a single conversation must fit a row; different
conversations never meet), ordered by turn, then role and text for equal turns.

Texts and unknown role names are escaped so that neither a header mark nor an end
mark can appear inside them; ``read_back`` undoes it exactly.

Null texts and roles count as empty, null turns come first, rows without a
conversation id form one conversation of id null. A conversation that breaks the
turn order is still formatted: ``valid`` is false and ``bad_turn`` is the first
turn (from 0) the automaton refuses, or the number of turns if only the end is
wrong. Repeated rows are repeated turns. An empty table gives no conversations.
Other columns of the input play no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """What a turn looks like, who may follow whom, whose text carries loss."""

    mark: str = "###"
    end: str = "</turn>"
    names: dict[str, str] = field(
        default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"}
    )
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if not self.mark or not self.end or "\\" in self.mark + self.end or self.mark[0] == self.end[0]:
            raise ValueError("control strings must not be empty, hold a backslash or begin alike")
        if any(self.end[i:] == self.end[: len(self.end) - i] for i in range(1, len(self.end))):
            raise ValueError("the end mark must not overlap itself")


DEFAULT = Template()


def _java(text: str) -> str:
    return "".join(f"\\{c}" if re.match(r"[^\w\s]", c) else c for c in text)


def escaped(text: Column, template: Template, role: bool = False) -> Column:
    """No control string is left: the first character of each is replaced, however they overlap."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for control, code in ((template.mark, "\\\\h"), (template.end, "\\\\l")):
        ahead = f"(?={_java(control[1:])})" if len(control) > 1 else ""
        out = F.regexp_replace(out, _java(control[0]) + ahead, code)
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescaped(text: Column, template: Template) -> Column:
    """Every backslash is followed by its code, so the codes can be undone one after another, backslashes last."""
    for code, plain in (("\\c", ":"), ("\\l", template.end[0]), ("\\h", template.mark[0]), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _name(role: Column, template: Template) -> Column:
    out = F.concat(F.lit("="), escaped(role, template, role=True))
    for known, name in template.names.items():
        out = F.when(role == known, F.lit(name)).otherwise(out)
    return out


def _role(name: Column, template: Template) -> Column:
    out = unescaped(F.substring(name, 2, 2**31 - 1), template)
    for known, shown in template.names.items():
        out = F.when(name == shown, F.lit(known)).otherwise(out)
    return out


def _automaton(turns: Column, template: Template) -> Column:
    """Fold the roles: (state, turns seen, first refused turn)."""

    def step(acc: Column, turn: Column) -> Column:
        allowed = F.lit(False)
        for state, roles in template.follows.items():
            allowed = allowed | ((acc["state"] == state) & turn["role"].isin(*roles))
        return F.struct(
            turn["role"].alias("state"),
            (acc["seen"] + 1).alias("seen"),
            F.coalesce(acc["bad"], F.when(~allowed, acc["seen"])).alias("bad"),
        )

    start = F.struct(
        F.lit("").alias("state"), F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bad")
    )
    return F.aggregate(
        turns,
        start,
        step,
        lambda acc: F.coalesce(acc["bad"], F.when(~acc["state"].isin(*template.final), acc["seen"])),
    )


def format_conversations(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, n_turns, valid, bad_turn, segments (text, loss), text (the segments joined)."""
    empty = F.lit("")
    turns = (
        rows.select(
            F.col("conv_id"),
            F.struct(
                F.col("turn").cast("long").alias("turn"),
                F.coalesce(F.col("role").cast("string"), empty).alias("role"),
                F.coalesce(F.col("text").cast("string"), empty).alias("text"),
            ).alias("turn"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    )

    def segments(turn: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(f"{template.mark} "), _name(turn["role"], template), F.lit(": "))
        return F.array(
            segment(head, F.lit(False)),
            segment(escaped(turn["text"], template), turn["role"].isin(*template.loss)),
            segment(F.lit(f"{template.end}\n"), F.lit(False)),
        )

    out = turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _automaton(F.col("turns"), template).alias("bad_turn"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    )
    return out.select(
        "conv_id",
        "n_turns",
        F.col("bad_turn").isNull().alias("valid"),
        "bad_turn",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("text"),
    )


def read_back(text: Column, template: Template = DEFAULT) -> Column:
    """The turns (role, text) a formatted text was made from."""
    parts = F.split(text, _java(template.end) + "\n")
    skip = len(template.mark) + 1

    def turn(part: Column) -> Column:
        rest = F.substring(part, skip + 1, 2**31 - 1)
        name = F.substring_index(rest, ": ", 1)
        body = F.call_function("substring", rest, F.length(name) + 3)
        return F.struct(_role(name, template).alias("role"), unescaped(body, template).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def loss_text(segments: Column, template: Template = DEFAULT) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    under = F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template))
    return F.array_join(under, "")


def digests(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """What can be read back from the output, as counts and hashes per conversation."""
    read = formatted.withColumn("_turns", read_back(F.col("text"), template)).withColumn(
        "_loss", loss_text(F.col("segments"), template)
    )
    spoken = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )
