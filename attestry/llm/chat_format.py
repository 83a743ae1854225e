"""Chat formatting from event logs, in DataFrame operations only.

A log has rows (conv_id, seq, kind, turn, role, text). Within a conversation, events are
folded in the order of (seq, kind as listed, role, text):

* ``regenerate`` withdraws what its turn and all later turns hold so far;
* ``edit`` replaces what its turn holds so far by one message;
* ``message`` adds a whole message to its turn;
* ``delta`` extends the last message of its turn, or opens one.

The fold is by turn, so a message streamed in very many deltas, or a conversation with very
many events, is spread over tasks by (conversation, turn), and withdrawn text never meets
the rest; only what a regeneration withdraws is looked up per conversation, from one small
row per turn. What is gathered per conversation are its final messages, which the result
holds in one row anyway.

Rendering marks every turn by control strings of a ``Template`` and escapes those strings
inside roles and texts: a backslash goes in after the first character, and where backslashes
stand there already, one more. Control strings can so appear as marks only, and taking one
backslash out again gives back every text (``turns_of``).

Defined results: a null text or role is empty; null conv_id, turn or seq are values of their
own that sort first; events of a null or unknown kind have no effect; repeated rows are
repeated events; a conversation that ends without messages has no row; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fold import let

KINDS = ("regenerate", "edit", "message", "delta")


@dataclass(frozen=True)
class Template:
    """Control strings around turns: ``begin`` role ``prompt`` text ``end``, or with ``learned``
    in place of ``prompt`` where the text is under the loss mask. ``others`` are further
    strings that must not appear unescaped."""

    begin: str = "<s>"
    prompt: str = "[INST]"
    learned: str = "[/INST]"
    end: str = "</s>"
    roles: tuple[str, ...] = ("assistant",)
    others: tuple[str, ...] = ("<unk>", "<|endoftext|>")

    def __post_init__(self):
        heads = {c[0] for c in self.controls}
        if len(set(self.controls)) < len(self.controls) or any(not c[1:] or heads & set(c[1:]) or "\\" in c for c in self.controls):
            raise ValueError("control strings must differ, and begin with characters that stand nowhere else in them")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.prompt, self.learned, self.end, *self.others)

    def _inside(self, backslash: str) -> str:
        """Places after the head of a control string, its own backslashes allowed."""
        tails: dict[str, list[str]] = {}
        for c in self.controls:
            tails.setdefault(c[0], []).append(re.escape(c[1:]))
        return "|".join(rf"(?<={re.escape(head)}){backslash}(?=\\*(?:{'|'.join(rest)}))" for head, rest in tails.items())

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._inside(""), r"\\")

    def plain(self, text: Column) -> Column:
        return F.regexp_replace(text, self._inside(r"\\"), "")

    def turn(self, role: Column, text: Column) -> Column:
        mark = F.when(role.isin(*self.roles), self.learned).otherwise(self.prompt)
        return F.concat(F.lit(self.begin), self.escaped(role), mark, self.escaped(text), F.lit(self.end))

    def turns_of(self, formatted: Column) -> Column:
        """Array of (role, text, learned), read back from a formatted conversation."""
        def read(turn: Column) -> Column:
            asked, learned = F.instr(turn, self.prompt), F.instr(turn, self.learned)
            at = F.greatest(asked, learned)
            size = F.when(learned > 0, len(self.learned)).otherwise(len(self.prompt))
            first = len(self.begin) + 1
            return F.struct(
                self.plain(F.substring(turn, F.lit(first), at - first)).alias("role"),
                self.plain(F.substring(turn, at + size, F.length(turn))).alias("text"),
                (learned > 0).alias("learned"))

        pieces = F.split(formatted, re.escape(self.end))
        return let(pieces, lambda every: F.transform(F.slice(every, F.lit(1), F.size(every) - 1), read))


CHAT = Template()


def messages(events: DataFrame) -> DataFrame:
    """Final messages of a log: (conv_id, turn, part, role, text), ``part`` counting the
    messages of one turn from 1."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    # The key is a struct, so that null ids match and one exchange serves all that follows.
    log = events.select(
        F.struct("conv_id", "turn").alias("_key"), F.struct("seq").alias("_seq"), order.alias("_kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).filter("_kind > 0")
    regenerate, edit, whole = (F.lit(KINDS.index(k) + 1) for k in ("regenerate", "edit", "message"))

    # One small row per turn: the last regeneration of it or of an earlier turn.
    upto = W.partitionBy("_key.conv_id").orderBy("_key.turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    turns = log.groupBy("_key").agg(F.max(F.when(F.col("_kind") == regenerate, F.col("_seq"))).alias("_again"))
    again = turns.select("_key", F.max("_again").over(upto).alias("_again"))
    live = log.filter(F.col("_kind") != regenerate).join(again, "_key").filter(
        F.col("_again").isNull() | (F.col("_seq") >= F.col("_again")))

    turn = W.partitionBy("_key").orderBy("_seq", "_kind", "role", "text")
    later = F.count(F.when(F.col("_kind") == edit, 1)).over(turn.rowsBetween(1, W.unboundedFollowing))
    kept = live.withColumn("_later", later).filter("_later = 0").withColumn("_place", F.row_number().over(turn))
    opens = (F.col("_kind") <= whole) | (F.col("_place") == 1)
    parts = kept.withColumn("part", F.count(F.when(opens, 1)).over(turn.rowsBetween(W.unboundedPreceding, W.currentRow)))
    deltas = F.sort_array(F.collect_list(F.struct("_place", "text")))
    return parts.groupBy("_key", "part").agg(
        F.min_by("role", "_place").alias("role"), F.array_join(F.transform(deltas, lambda s: s["text"]), "").alias("text"),
    ).select("_key.conv_id", "_key.turn", "part", "role", "text")


def formatted(final: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, formatted): every conversation of (conv_id, turn, part, role, text), rendered."""
    shown = final.select("conv_id", "turn", "part", template.turn(F.col("role"), F.col("text")).alias("_shown"))
    return shown.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "part", "_shown"))), lambda s: s["_shown"]), "").alias("formatted"))


def measured(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """Turns and loss text of (conv_id, formatted), read back from the output."""
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: t["text"]), "")
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = conversations.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), template.turns_of(F.col("formatted")).alias("turns"))
    texts = back.select("conv_id", "formatted_chars", F.size("turns").cast("long").alias("n_turns"), every.alias("_every"), learned.alias("_learned"))
    return texts.select(
        "conv_id", "n_turns", F.sha2("_every", 256).alias("turns_sha256"), F.length("_learned").cast("long").alias("loss_chars"),
        F.sha2("_learned", 256).alias("loss_sha256"), "formatted_chars")


def as_events(rows: DataFrame) -> DataFrame:
    """A table of finished messages (conv_id, turn, role, text) as a log."""
    return rows.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")


def quoting(conv_id: int, text: str, like: DataFrame) -> DataFrame:
    """A conversation in which user and assistant both say ``text``, with the types of ``like``."""
    turn = like.sparkSession.range(0, 2, 1, 1)
    return turn.select(
        F.lit(conv_id).cast(like.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(like.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
