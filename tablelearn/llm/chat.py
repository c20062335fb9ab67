"""Chat formatting: a role machine, a declarative template, loss-flagged segments.

Rows are turns.  A conversation's turns are ordered by turn number (null
first), then role and text, so that repeated and tied rows have one order.  A
finite-state machine over roles checks the order of turns.  Every turn becomes
three text segments: its header, its text and its tail; the text of a role
under ``loss_roles`` carries the loss flag, nothing else does.

Texts can hold the template's own control strings.  They are escaped: ``<``,
any number of backslashes and ``|`` get one backslash more, and no text can
then show a mark.  ``unescape`` takes it away again.  Roles are escaped
likewise, and in them ``%`` and line ends become ``%25`` and ``%0A``.

Only DataFrame functions are used.  A conversation is one string in the end,
so its turns must meet in one task; conversations are spread by id.

Defined cases: null role or text counts as empty; null conversation ids form
one conversation; an unknown role makes the conversation invalid, but it is
formatted all the same; an empty table gives an empty table.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import take


@dataclasses.dataclass(frozen=True)
class Template:
    """Marks, the roles to learn from, and the machine over roles."""
    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    initial: str = "begin"
    final: tuple[str, ...] = ("assistant",)
    moves: tuple[tuple[str, str, str], ...] = (       # state, role, next state
        ("begin", "system", "system"), ("begin", "user", "user"), ("system", "user", "user"),
        ("user", "assistant", "assistant"), ("assistant", "user", "user"),
        ("assistant", "tool", "tool"), ("tool", "tool", "tool"), ("tool", "assistant", "assistant"))

    @property
    def tail(self) -> str:
        return self.end + self.after_turn


CHATML = Template()
STUCK = "stuck"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _machine(turns: Column, template: Template) -> Column:
    """struct(state, at, bad): the last state and the first turn without a move."""
    moves = F.create_map(*[F.lit(x) for s, r, n in template.moves for x in (f"{s}\n{r}", n)])

    def step(acc: Column, t: Column) -> Column:
        after = F.coalesce(moves[F.concat(acc["state"], F.lit("\n"), t["role"])], F.lit(STUCK))
        return F.struct(
            after.alias("state"), (acc["at"] + 1).alias("at"),
            F.when(acc["bad"].isNull() & (after == STUCK), acc["at"]).otherwise(acc["bad"]).alias("bad"))

    return F.aggregate(turns, F.struct(F.lit(template.initial).alias("state"), F.lit(0).alias("at"),
                                       F.lit(None).cast("int").alias("bad")), step)


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", template: Template = CHATML) -> DataFrame:
    """One row per conversation.

    ``conv``; ``n_turns``; ``valid``, whether every turn had a move;
    ``complete``, whether the machine also ends in a final state; ``bad_turn``,
    the place of the first turn without a move; ``segments``, an array of
    (text, loss); ``formatted``, the segments side by side.
    """
    rows = take(df, conv=conv, turn=turn, role=role, text=text)
    one = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = rows.groupBy("conv").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    segment = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        segment(F.concat(F.lit(template.start), escape_role(t["role"]), F.lit(template.after_role)), no),
        segment(escape(t["text"]), t["role"].isin(*template.loss_roles)),
        segment(F.lit(template.tail), no))))
    out = (chats.withColumn("m", _machine(F.col("turns"), template))
           .withColumn("segments", segments)
           .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")))
    return out.select(
        F.col("conv").alias(conv), F.size("turns").cast("long").alias("n_turns"),
        F.col("m.bad").isNull().alias("valid"),
        (F.col("m.bad").isNull() & F.col("m.state").isin(*template.final)).alias("complete"),
        F.col("m.bad").alias("bad_turn"), "segments", "formatted")


def parse(formatted: Column, template: Template = CHATML) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    mark = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in template.start)
    parts = F.split(formatted, mark, -1)
    turns = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def one(t: Column) -> Column:
        role = F.substring_index(t, template.after_role, 1)
        at = F.length(role) + len(template.after_role)
        body = F.substring(t, at + 1, F.length(t) - at - len(template.tail))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, one)


def loss_text(segments: Column) -> Column:
    """All text under the loss flag, unescaped, side by side."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]),
                                    lambda s: unescape(s["text"])), "")
