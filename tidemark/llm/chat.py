"""Chat formatting from a declarative template, in DataFrame functions alone.

The template gives each role an opening and a closing mark and a loss flag; other roles are written with their name.
Control strings (the marks) inside texts get a backslash after their first character, backslashes are doubled, so a
formatted conversation splits at its marks and every text comes back unchanged.

A finite-state machine runs over the roles. Its edges, one per state and role, hold the next state and what the turn
emits: opening mark, closing mark, loss flag. A state is called after the role that led to it; a turn that no edge
of the current state allows leads to ``error``, which no turn leaves. Edges from ``error`` emit as the others do, so an
invalid conversation is formatted whole and its state says so.

Turns are ordered by turn, then role, then text; null turns come first. Null texts and roles are empty strings.
Turns without conversation id form one conversation whose id is null. Equal rows are separate turns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    #: role -> (opening mark, closing mark, whether its text counts for the loss)
    roles: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("[SYS]", "[/SYS]", False),
            "user": ("[INST]", "[/INST]", False),
            "assistant": ("<s>", "</s>", True),
            "tool": ("[TOOL]", "[/TOOL]", False),
        }
    )
    #: opening mark, end of the name, closing mark of a role that is not listed
    other: tuple[str, str, str] = ("[ROLE]", "[:]", "[/ROLE]")
    #: state -> role -> next state; a state is called after the role that led to it
    turns: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("tool", "assistant"),
        }
    )
    final: tuple[str, ...] = ("assistant",)

    @property
    def marks(self) -> list[str]:
        return sorted({m for o, c, _ in self.roles.values() for m in (o, c)} | set(self.other))

    def pattern(self, between: str = "") -> str:
        """A mark's first character and its rest as two groups, with ``between`` in the middle."""
        first = "".join(sorted({re.escape(m[0]) for m in self.marks}))
        rest = "|".join(re.escape(m[1:]) for m in self.marks)
        return f"([{first}]){between}({rest})"


TEMPLATE = Template()


def escape(text: Column, t: Template = TEMPLATE) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), t.pattern(), r"$1\\$2")


def unescape(text: Column, t: Template = TEMPLATE) -> Column:
    return F.replace(F.regexp_replace(text, t.pattern(r"\\"), "$1$2"), F.lit("\\\\"), F.lit("\\"))


def edges(t: Template = TEMPLATE) -> dict[str, tuple[str, str, str, bool]]:
    """``state>role`` -> (next state, opening mark, closing mark, loss flag), for all states and the roles listed."""
    out = {}
    for state in [*t.turns, "error"]:
        for role, (opening, closing, loss) in t.roles.items():
            out[f"{state}>{role}"] = (role if role in t.turns.get(state, ()) else "error", opening, closing, loss)
    return out


def run_machine(turns: Column, t: Template = TEMPLATE) -> Column:
    """For every turn what the machine emits on its edge: array<struct<state, opening, text, closing, loss>>.

    The state before a turn is its predecessor's role, unless a turn before it had no edge; so all steps are found
    from the place of the first such turn, and a conversation of n turns takes n steps.
    """
    step = lambda state, nxt, opening, closing, loss: F.struct(state.alias("state"), nxt.alias("next"), opening.alias("opening"), closing.alias("closing"), loss.alias("loss"))
    known = edges(t)
    table = F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*[step(F.lit(k.split(">")[0]), *map(F.lit, e)) for k, e in known.items()]))
    allowed = F.array(*[F.lit(k) for k, e in known.items() if e[0] != "error"])
    edge = lambda state, role: F.concat(state, F.lit(">"), role)
    before = lambda i: F.coalesce(F.get(turns, i - 1)["role"], F.lit("start"))
    # places count from 1; 0: every turn has an edge
    first_bad = F.array_position(F.transform(turns, lambda x, i: F.array_contains(allowed, edge(before(i), x["role"]))), False)

    def emit(x: Column, i: Column) -> Column:
        state = F.when((first_bad > 0) & (i >= first_bad), F.lit("error")).otherwise(before(i))
        name = F.concat(F.lit(t.other[0]), escape(x["role"], t), F.lit(t.other[1]))
        other = step(state, F.lit("error"), name, F.lit(t.other[2]), F.lit(False))
        taken = F.coalesce(F.try_element_at(table, edge(state, x["role"])), other)
        return F.struct(taken["next"].alias("state"), taken["opening"].alias("opening"), escape(x["text"], t).alias("text"), taken["closing"].alias("closing"), taken["loss"].alias("loss"))

    return F.transform(turns, emit)


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = TEMPLATE) -> DataFrame:
    """(conv, segments array<struct<text, loss>>, formatted string, state, valid) per conversation."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chats = rows.groupBy(F.col(conv).alias(conv)).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    steps = chats.select(conv, run_machine(F.col("turns"), template).alias("steps"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    parts = F.flatten(F.transform("steps", lambda s: F.array(part(s["opening"], F.lit(False)), part(s["text"], s["loss"]), part(s["closing"], F.lit(False)))))
    made = steps.select(conv, parts.alias("segments"), F.get("steps", F.size("steps") - 1)["state"].alias("state"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return made.select(conv, "segments", formatted.alias("formatted"), "state", F.col("state").isin(*template.final).alias("valid"))


def parse(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation."""
    close = "|".join(re.escape(c) for c in sorted({c for _, c, _ in template.roles.values()} | {template.other[2]}))

    def turn(piece: Column) -> Column:
        start, colon = template.other[0], template.other[1]
        at = F.instr(piece, colon)
        role = unescape(F.substring(piece, F.lit(len(start) + 1), at - 1 - len(start)), template)
        text = F.substring(piece, at + len(colon), F.char_length(piece))
        for name, (mark, _, _) in template.roles.items():
            own = F.startswith(piece, F.lit(mark))
            role = F.when(own, F.lit(name)).otherwise(role)
            text = F.when(own, F.substring(piece, F.lit(len(mark) + 1), F.char_length(piece))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text, template).alias("text"))

    pieces = F.split(formatted, close, -1)  # what follows the last mark is empty
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def loss_text(parts: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(parts, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
