"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

A `Template` names, per role, what stands before and after a text and whether the text counts for the loss; a
table of allowed steps between roles is the machine. Formatting gives per conversation the segments of its
text, each with a loss flag, and the machine's verdict; a conversation that breaks the order is formatted all
the same. Control strings inside texts are escaped, so the formatted text can be read back turn by turn.

Defined results. Rows are ordered by turn, then role, then text, nulls first; equal rows stay as they are. A
null text is empty. A role that the template does not name (a null role is the empty name) is written with its
name between the `other` marks, has no loss and breaks the order. Rows without conv_id form one conversation
with a null id. An empty table gives no rows. Other columns are ignored. A formatted conversation is one value,
as its digest and its use in training ask for, so one conversation is limited by Spark's 2 GB per string; the
work is linear in its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
_BROKEN = "broken"


@dataclass(frozen=True)
class Turn:
    """What stands before and after a role's text, and whether the text counts for the loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks per role, steps of the role machine, and the control strings that no text may hold unescaped.

    `other` = (before the name, between name and text, after) serves roles without own marks. Every mark
    after a text ends with a control string that stands nowhere else, so that it ends a turn when reading.
    """

    start: str = "<s>"
    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("[SYS] ", " [/SYS]"),
            "user": Turn("[INST] ", " [/INST]"),
            "assistant": Turn(" ", "</s>", loss=True),
        }
    )
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/TEXT]")
    controls: tuple[str, ...] = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/TEXT]")
    steps: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    accepted: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        opens = [t.before for t in self.turns.values()] + [self.other[0]]
        marks = [m for t in self.turns.values() for m in (t.before, t.after)] + list(self.other)
        for c in self.controls:
            if len(c) < 2 or ESCAPE in c or c[0] in c[1:]:
                raise ValueError(f"{c!r}: a control string has two or more characters, no escape, and its first character once")
            cuts = [(c[:k], c[k:]) for k in range(1, len(c))]
            if any(m.startswith(v) or v.startswith(m) or m.endswith(u) or u.endswith(m) for u, v in cuts for m in marks):
                raise ValueError(f"a mark and a text could form {c!r} together")
            if any(c != d and c in d for d in self.controls):
                raise ValueError(f"{c!r} stands inside another control string")
        if any(a != b and b.startswith(a) for a in opens for b in opens) or len(set(opens)) < len(opens):
            raise ValueError("marks before texts must tell roles apart")
        ends = [self.last_control(t.after) for t in self.turns.values()] + [self.last_control(self.other[2])]
        if any(sum(e in m for m in [self.start, *marks]) != 1 for e in ends):
            raise ValueError("the control string that ends a turn may stand in one mark only")
        if self.other[1] not in self.controls:
            raise ValueError("the mark between an unnamed role and its text must be a control string")

    def last_control(self, mark: str) -> str:
        for c in self.controls:
            if mark.endswith(c):
                return c
        raise ValueError(f"{mark!r} does not end with a control string")

    @property
    def ends(self) -> list[tuple[str, str]]:
        """(mark, its last control string) after the text, of each role and of the others."""
        return [(m, self.last_control(m)) for m in [*(t.after for t in self.turns.values()), self.other[2]]]


def escape(text: Column, template: Template) -> Column:
    """An escape character after every escape character and after the first character of a control string."""
    firsts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls)
    return F.regexp_replace(text, F.lit(f"\\\\|{firsts}"), F.lit("$0\\\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def machine(roles: Column, template: Template) -> Column:
    """Struct of the machine's last state and the number of turns it takes before it breaks."""
    table = F.create_map(*[F.lit(x) for s, after in template.steps.items() for r in after for x in (f"{s} {r}", r)])

    def step(at: Column, role: Column) -> Column:
        to = F.coalesce(F.try_element_at(table, F.concat(at["state"], F.lit(" "), role)), F.lit(_BROKEN))
        return F.struct(to.alias("state"), (at["taken"] + F.when(to == _BROKEN, 0).otherwise(1)).alias("taken"))

    return F.aggregate(roles, F.struct(F.lit("start").alias("state"), F.lit(0).alias("taken")), step)


def _segment(text: Column, loss: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (F.lit(False) if loss is None else loss).alias("loss"))


def _turn_segments(row: Column, template: Template) -> Column:
    role, text = row["role"], escape(row["text"], template)
    a, b, c = template.other
    out = F.array(
        _segment(F.concat(F.lit(a), escape(role, template), F.lit(b))), _segment(text), _segment(F.lit(c))
    )
    for name, t in template.turns.items():
        named = F.array(_segment(F.lit(t.before)), _segment(text, F.lit(t.loss)), _segment(F.lit(t.after)))
        out = F.when(role == name, named).otherwise(out)
    return out


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: conv_id, segments (text, loss), formatted, valid, n_taken.

    `segments` joined give `formatted`; the texts of those with loss, unescaped, are what is trained on.
    """
    template = template or Template()
    rows = conversations.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("row")
    )
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    done = gathered.select(
        "conv_id",
        F.concat(
            F.array(_segment(F.lit(template.start))), F.flatten(F.transform("rows", lambda r: _turn_segments(r, template)))
        ).alias("segments"),
        machine(F.transform("rows", lambda r: r["role"]), template).alias("m"),
    )
    return done.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("m.state").isin(*template.accepted).alias("valid"),
        F.col("m.taken").alias("n_taken"),
    )


def _read_turn(piece: Column, template: Template) -> Column:
    def within(before: Column, after: str) -> Column:
        return unescape(F.substring(piece, before + 1, F.length(piece) - before - len(after)))

    a, b, c = template.other
    border = F.locate(b, piece)
    out = F.struct(
        unescape(F.substring(piece, F.lit(len(a) + 1), border - 1 - len(a))).alias("role"),
        within(border + (len(b) - 1), c).alias("text"),
    )
    for name, t in template.turns.items():
        read = F.struct(F.lit(name).alias("role"), within(F.lit(len(t.before)), t.after).alias("text"))
        out = F.when(F.startswith(piece, F.lit(t.before)), read).otherwise(out)
    return out


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) of a formatted conversation."""
    template = template or Template()
    behind = "|".join(f"(?<={re.escape(e)})" for _, e in template.ends)
    pieces = F.split(F.substring(formatted, F.lit(len(template.start) + 1), F.length(formatted)), behind, -1)
    return F.transform(F.filter(pieces, lambda p: p != ""), lambda p: _read_turn(p, template))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def chat_digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Counts and digests of what `format_chats` wrote, read back from it."""
    read = formatted.select(
        "conv_id", "valid", "n_taken", "formatted", read_back(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments")).alias("loss")
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("n_taken").cast("long").alias("n_taken"),
    )
