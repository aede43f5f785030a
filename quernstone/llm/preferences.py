"""Chat formatting of preference pairs, in DataFrame operations alone.

Input is a row a turn: ``pair_id``, ``side`` (chosen or rejected), ``turn``, ``role``, ``text``.
The longest common prefix of the two turn lists (same role and text, in order of turn) is rendered
once as the prompt; the turns after it are rendered as one completion a side. A completion's mask
lists the ranges of code points (start:end, end exclusive) that assistant turns contribute,
their closing marker included; the rest is not to be learned.

Cases: turns with a null number come first; ties are ordered by role, then text, nulls first. A null role
renders as ``user`` and a null text as empty, but null and empty differ when prefixes are compared.
A pair that lacks a side has that side empty. Rows with another side or a null pair are ignored;
repeated turns are turns of their own. Equal sides give two empty completions. Extra columns of any
name are ignored; an empty table gives an empty result. A pair is one row, so its turns meet in one
task; texts of any length and any number of turns are read whole, a turn at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import scanned


@dataclass(frozen=True)
class Template:
    """A turn renders as opening + role + after_role + text + closing."""

    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>\n"
    learned: str = "assistant"


def _render(turn: Column, t: Template) -> Column:
    return F.concat(F.lit(t.opening), F.coalesce(turn["role"], F.lit("user")), F.lit(t.after_role), F.coalesce(turn["text"], F.lit("")), F.lit(t.closing))


def _mask(turns: str, starts: str, t: Template) -> Column:
    """start:end of what each learned turn contributes, comma-joined; ``starts``: where the turns start."""

    def one(turn: Column, at: Column) -> Column:
        head = at + F.length(F.concat(F.lit(t.opening), turn["role"], F.lit(t.after_role)))
        return F.when(turn["role"] == t.learned, F.concat_ws(":", head.cast("string"), (at + F.length(_render(turn, t))).cast("string")))

    return F.array_join(F.zip_with(turns, starts, one), ",")  # nulls are left out


def formatted(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """A row a pair: ``pair_id, prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask``."""
    turn = F.struct("turn", "role", "text")
    side = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, turn)))
    wanted = turns.where(F.col("side").isin("chosen", "rejected") & F.col("pair_id").isNotNull())
    pairs = wanted.groupBy("pair_id").agg(side("chosen").alias("_c"), side("rejected").alias("_r"))
    same = lambda a, b: F.struct(a["role"], a["text"]).eqNullSafe(F.struct(b["role"], b["text"])) & a.isNotNull() & b.isNotNull()
    pairs = pairs.withColumn("_same", F.zip_with("_c", "_r", same))
    pairs = pairs.withColumn("prefix_turns", F.coalesce(F.nullif(F.array_position("_same", False), F.lit(0)) - 1, F.size("_same")).cast("int"))
    cut = lambda c, after: F.slice(c, F.col("prefix_turns") + 1, F.size(c)) if after else F.slice(c, F.lit(1), F.col("prefix_turns"))
    pairs = pairs.select("pair_id", "prefix_turns", cut("_c", False).alias("_p"), cut("_c", True).alias("_c"), cut("_r", True).alias("_r"))
    size = lambda c: F.transform(c, lambda x: F.length(_render(x, template)))
    pairs = pairs.select("*", size("_c").alias("_cn"), size("_r").alias("_rn"))
    start = lambda c: scanned(c, F.lit(0), lambda at, n: at + n, lambda at, n: at, "int")
    pairs = pairs.select("*", start("_cn").alias("_cs"), start("_rn").alias("_rs"))
    text = lambda c: F.array_join(F.transform(c, lambda x: _render(x, template)), "")
    return pairs.select("pair_id", "prefix_turns", text("_p").alias("prompt"), text("_c").alias("chosen"), text("_r").alias("rejected"), _mask("_c", "_cs", template).alias("chosen_mask"), _mask("_r", "_rs", template).alias("rejected_mask"))


def weaker_replies(conversations: DataFrame, answering: str = "assistant") -> DataFrame:
    """Preference turns from plain conversations (``conv_id, turn, role, text``).

    The chosen side is the conversation. The rejected side is the same with its last reply replaced
    by the reply before it, or by an empty one if there is none. Conversations without a reply, or
    with a null id, are left out.
    """
    reply = F.struct(F.col("turn"), F.col("text"))
    said = F.col("role") == answering
    known = conversations.where(F.col("conv_id").isNotNull())
    last = known.where(said).groupBy("conv_id").agg(F.max("turn").alias("last"))
    turns = known.join(last, "conv_id").select("conv_id", "turn", "role", "text", "last")
    earlier = turns.where(said & (F.col("turn") < F.col("last"))).groupBy("conv_id").agg(F.max(reply)["text"].alias("before"))
    both = turns.join(earlier, "conv_id", "left")
    swapped = F.when(said & (F.col("turn") == F.col("last")), F.coalesce("before", F.lit(""))).otherwise(F.col("text"))
    sides = F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), swapped.alias("text"))))
    return both.select(F.col("conv_id").alias("pair_id"), "turn", "role", sides.alias("_s")).select("pair_id", "_s.side", "turn", "role", "_s.text")
