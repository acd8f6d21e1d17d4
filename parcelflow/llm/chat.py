"""Chat formatting: a finite-state machine over roles and a declarative template.

A template names the marks around a turn, the roles that are learned from, and the allowed steps from
role to role. Formatting gives text segments with a loss flag each; their concatenation is the text to
train on. Control strings inside roles and texts are escaped, so the text can be read back exactly.
Only DataFrame operations are used.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """``open`` + role + ``after_role`` + text + ``close`` is a turn.

    ``steps`` maps a state (``start`` or the role before) to the roles that may follow, ``final`` has the
    states in which a conversation may end, ``learned`` the roles whose texts bear loss.
    """

    open: str = "### "
    after_role: str = ": "
    close: str = "</turn>"
    between: str = "\n"
    learned: tuple[str, ...] = ("assistant",)
    steps: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def controls(self) -> tuple[str, ...]:
        """Strings that must not occur in an escaped text."""
        return (self.open, self.close)


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    """Doubles backslashes and puts one after the first character of each control string."""
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for mark in template.controls():
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + ESCAPE + mark[1:]))
    return text


def unescape(text: Column) -> Column:
    """Inverse of ``escape`` and ``escape_role``: a backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column, template: Template = DEFAULT) -> Column:
    mark = template.after_role[0]
    return F.replace(escape(role, template), F.lit(mark), F.lit(ESCAPE + mark))


def first_fault(turns: Column, template: Template = DEFAULT) -> Column:
    """Number of the first turn, from 1, whose role may not follow; null if all may. The state machine
    runs over the roles in order; 0 stands for a conversation that may not end where it does."""
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, then in template.steps.items() for b in then])
    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(0).alias("fault"))

    def step(state, turn):
        ok = F.array_contains(allowed, F.concat(state["state"], F.lit(">"), turn["role"]))
        n = state["n"] + F.lit(1)
        fault = F.when((state["fault"] == 0) & ~ok, n).otherwise(state["fault"])
        return F.struct(turn["role"].alias("state"), n.alias("n"), fault.alias("fault"))

    end = F.aggregate(turns, begin, step)
    ends = end["state"].isin(*template.final)
    return F.when(end["fault"] > 0, end["fault"]).when(~ends, F.lit(0))


def segments(turns: Column, template: Template = DEFAULT) -> Column:
    """Array of (text, loss): for each turn its marks and, apart from them, its text."""

    def turn(x, i):
        before = F.when(i > 0, F.lit(template.between)).otherwise(F.lit(""))
        opening = F.concat(
            before, F.lit(template.open), escape_role(x["role"], template), F.lit(template.after_role)
        )
        return F.array(
            F.struct(opening.alias("text"), F.lit(False).alias("loss")),
            F.struct(
                escape(x["text"], template).alias("text"),
                x["role"].isin(*template.learned).alias("loss"),
            ),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
        )

    return F.flatten(F.transform(turns, turn))


def format_conversations(
    turns: DataFrame,
    template: Template = DEFAULT,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """A row per conversation: ``conv_id``, ``segments``, ``formatted`` and ``fault`` (see
    ``first_fault``; faulty conversations are formatted too, the caller decides).

    Turns are ordered by number, a null number first; equal numbers by role, then text. Null roles and
    texts count as empty. Rows with a null id form one conversation. Repeated rows are turns of their
    own. No rows give no conversations. Other columns of ``turns`` are not looked at.

    A conversation is one value of the result, so its own turns have to meet in one task; that is the
    only grouping here.
    """
    entry = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    grouped = turns.groupBy(F.col(conv_id).alias(conv_id)).agg(
        F.sort_array(F.collect_list(entry)).alias("_turns")
    )
    made = grouped.select(
        F.col(conv_id),
        segments(F.col("_turns"), template).alias("segments"),
        first_fault(F.col("_turns"), template).alias("fault"),
    )
    return made.withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")
    )


def read_back(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    # The last piece is what follows the last closing mark: nothing.
    pieces = F.split(formatted, F.lit(f"\\Q{template.close}\\E"))
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    mark = template.after_role[0]
    role = rf"[^{ESCAPE * 2}{mark}]*+(?:{ESCAPE * 2}.[^{ESCAPE * 2}{mark}]*+)*+"
    opening = rf"(?s)^(?:{template.between})?\Q{template.open}\E({role})\Q{template.after_role}\E"
    return F.transform(
        turns,
        lambda x: F.struct(
            unescape(F.regexp_extract(x, opening, 1)).alias("role"),
            unescape(F.regexp_extract(x, opening + "(.*+)$", 2)).alias("text"),
        ),
    )


def loss_texts(parts: Column) -> Column:
    """The unescaped texts of the segments that bear loss, in order."""
    return F.transform(F.filter(parts, lambda s: s["loss"]), lambda s: unescape(s["text"]))
