"""Chat formatting: a state machine over roles and a declarative template, in DataFrame functions only.

A template names, for each role, the strings that open and close a turn and whether its text counts for the
loss, the allowed moves between roles, and the replacements that keep control strings out of texts.  The
result holds the segments (text, loss) of a conversation, the formatted text they add up to, and whether the
state machine accepted the order of turns.

Cases: turns are ordered by turn, then role and text (nulls first); a null text is empty; a null or unknown
role is marked by its own (escaped) name, gets no loss and is not valid; conversations that break the order
are formatted all the same, with valid false; a conversation is one row, as its output is; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import need


@dataclass(frozen=True)
class Template:
    opening: str = "<|turn|>{role}\n"
    closing: str = "<|end|>\n"
    #: In this order; undone in the reverse order.  No text keeps a "<", so none holds a control string.
    escapes: tuple[tuple[str, str], ...] = (("&", "&amp;"), ("<", "&lt;"))
    #: Beside those, in roles, which end at the first line break.
    role_escapes: tuple[tuple[str, str], ...] = (("\n", "&#10;"),)
    loss: tuple[str, ...] = ("assistant",)
    #: state: the roles that may come next; a role's name is the state after it.
    moves: tuple[tuple[str, tuple[str, ...]], ...] = (("start", ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user",)))
    final: tuple[str, ...] = ("user", "assistant")

    def escaped(self, text: Column, role: bool = False) -> Column:
        return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), self.escapes + self.role_escapes * role, text)

    def plain(self, text: Column, role: bool = False) -> Column:
        return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(self.escapes + self.role_escapes * role), text)

    def opens(self, role: Column) -> Column:
        before, after = self.opening.split("{role}")
        return F.concat(F.lit(before), self.escaped(role, True), F.lit(after))

    def accepts(self, roles: Column) -> Column:
        def step(state: Column, role: Column) -> Column:
            return reduce(lambda c, m: F.when((state == m[0]) & role.isin(*m[1]), role).otherwise(c), self.moves, F.lit("wrong"))

        return F.aggregate(roles, F.lit("start"), step).isin(*self.final)


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, segments array<struct<text, loss>>, formatted, valid."""
    rows = need(turns, "conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    one = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                one(template.opens(t["role"]), F.lit(False)),
                one(template.escaped(t["text"]), t["role"].isin(*template.loss)),
                one(F.lit(template.closing), F.lit(False)),
            ),
        )
    )
    convs = convs.select("conv_id", segments.alias("segments"), template.accepts(F.transform("turns", lambda t: t["role"])).alias("valid"))
    return convs.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> from a formatted text."""
    pieces = F.filter(F.split(formatted, "\\Q" + template.closing + "\\E"), lambda p: p != "")
    before, after = template.opening.split("{role}")

    def parsed(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(before) + 1), F.length(piece))
        role = F.substring_index(inner, after, 1)
        return F.struct(template.plain(role, True).alias("role"), template.plain(F.substring(inner, F.length(role) + len(after) + 1, F.length(inner))).alias("text"))

    return F.transform(pieces, parsed)


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.plain(s["text"])), "")
