"""Conversations as formatted text with a loss mask, by a finite-state machine over roles.

A template is data: the control strings around role and text, the roles whose
text is learned, and the machine's transitions. Everything runs as DataFrame
functions. Control strings inside roles and texts are escaped, so the format
reads back exactly.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings begin with ``<|`` and end with ``|>``; in texts ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``."""

    start: str = "<|start|>"
    sep: str = "<|text|>"
    end: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    begin: str = "begin"
    #: (state, role) -> state; any other pair ends in the state "error" and stays there.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("begin", "system"): "system",
            ("begin", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    #: States in which a conversation may end.
    ends: tuple[str, ...] = ("user", "assistant")


DEFAULT = Template()


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def format_chats(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments (text, loss), formatted, state, valid.

    turns: conv_id, turn, role, text; other columns are ignored. Rows go by
    turn, a null turn first, ties by role and then text; repeated rows are turns
    of their own. A null text or role is empty. Turn order that the machine
    rejects leaves ``valid`` false and the text formatted all the same. Rows
    with a null conv_id form one conversation. An empty table gives no rows.
    A conversation is one row of the result, so it must fit in a task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn").alias("turn"), role.alias("plain"), text.alias("order"), escape(role).alias("role"), escape(text).alias("text"), role.isin(*template.loss_roles).alias("loss")).alias("t"),
    )
    moves = F.create_map(*(F.lit(x) for (state, r), to in template.moves.items() for x in (f"{state}>{r}", to)))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    chats = chats.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.flatten(F.transform("ts", lambda t: F.array(segment(F.concat(F.lit(template.start), t["role"], F.lit(template.sep)), no), segment(t["text"], t["loss"]), segment(F.lit(template.end), no)))).alias("segments"),
        F.aggregate("ts", F.lit(template.begin), lambda state, t: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit(">"), t["plain"])), F.lit("error"))).alias("state"),
    )
    return chats.select("conv_id", "n_turns", "segments", F.array_join("segments.text", "").alias("formatted"), "state", F.col("state").isin(*template.ends).alias("valid"))


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns, an array of (role, text), of a formatted conversation."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, template.sep, 1)
        at = F.length(role) + F.lit(len(template.sep) + 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(piece, at, F.length(piece) - at - F.lit(len(template.end) - 1))).alias("text"))

    quoted = "".join(f"\\{ch}" if not ch.isalnum() else ch for ch in template.start)
    pieces = F.split(formatted, quoted, -1)
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), turn)


def read_loss(segments: Column) -> Column:
    """The text under the loss mask as it was before formatting."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
