"""Multi-party perspective rotation of dialogues: one rendering per participant.

From each participant's view that speaker is the assistant and everyone else is a named user; masks cover what the
assistant says. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns per part, and messages per piece of a part: a dialogue of any length is a sequence of bounded renderings.
PART_TURNS = 64
END = "<|end|>\n"
CONTEXT_ROLES = ("system",)


def _plain(text: Column) -> Column:
    """Text that cannot open a marker of its own."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _name(role: Column) -> Column:
    """Name that can neither open nor close a marker, nor end its line."""
    return F.replace(F.translate(_plain(role), "\n\r", "  "), F.lit("|>"), F.lit("| >"))


def _header(role: Column, speaker: Column, context: Sequence[str]) -> Column:
    return (
        F.when(role.isin(*context), F.concat(F.lit("<|"), role, F.lit("|>\n")))
        .when(role == speaker, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), _name(role), F.lit("|>\n")))
    )


def _pieces(known: DataFrame, most: int) -> DataFrame:
    """``known`` (conv_id, part, turn, role, text, times) with the piece of its part that each message is in, and how often.

    Messages of a part are numbered by (turn, hash of role and text) and every ``most`` of them are a piece. Numbers come
    from counts of 4,096 hash ranges a turn, so a part that holds a third of all rows is ranked by many tasks. Only parts
    with more than ``most`` messages are ranked; for others the number is below ``most`` whatever the order."""
    range_of = F.conv(F.substring("digest", 1, 3), 16, 10).cast("int")
    digest = F.md5(F.concat_ws("\n", F.col("role"), F.coalesce("text", F.lit(""))).cast("binary"))
    sizes = known.groupBy("conv_id", "part").agg(F.sum("times").alias("messages"))
    crowded = sizes.where(F.col("messages") > most).select(F.col("conv_id").alias("of"), F.col("part").alias("of_part"), F.lit(True).alias("ranked"))
    marked = known.join(crowded, (F.col("conv_id") == F.col("of")) & F.col("part").eqNullSafe(F.col("of_part")), "left").drop("of", "of_part")
    whole = marked.where("ranked IS NULL").select("conv_id", "part", F.lit(0).cast("bigint").alias("piece"), "turn", "role", "text", "times")
    ranked = marked.where("ranked").withColumn("digest", digest).withColumn("range", range_of)
    keys = ["conv_id", "part", "turn", "range"]
    counts = ranked.groupBy(*keys).agg(F.sum("times").alias("n"))
    earlier = Window.partitionBy("conv_id", "part").orderBy("turn", "range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(k).alias(f"of_{k}") for k in keys), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*keys).orderBy("digest", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranked.withColumn("upto", F.sum("times").over(inside)).join(
        starts, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    )
    last = F.col("before") + F.col("upto") - 1
    first = last - F.col("times") + 1
    number = lambda x: F.floor(x / F.lit(most)).cast("bigint")
    spread = placed.withColumns({"first": first, "last": last}).withColumn("piece", F.explode(F.sequence(number(F.col("first")), number(F.col("last")))))
    here = F.least(F.col("last"), F.col("piece") * most + most - 1) - F.greatest(F.col("first"), F.col("piece") * most) + 1
    return whole.unionByName(spread.select("conv_id", "part", "piece", "turn", "role", "text", here.cast("bigint").alias("times")))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS, context_roles: Sequence[str] = CONTEXT_ROLES) -> DataFrame:
    """(conv_id, speaker, part, piece, n_turns, rendered, masks) for every dialogue, participant, part and piece.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Participants are a dialogue's distinct roles
    but for ``context_roles``, which keep their own header. A part holds the turns numbered part * part_turns up to the
    next part; messages without a turn are in part NULL. A part of more than part_turns messages (several of one turn, or
    without a turn) is cut into pieces of part_turns, numbered from 0, messages of one turn dealt by hash. Within a piece the
    order is (turn, role, text). So a dialogue that holds a third of all rows is dealt over bounded renderings, whatever
    its turn numbers. ``masks`` are half-open character spans of ``rendered``: the assistant's text and its end marker.
    Markers inside names and texts are broken up by a space, line breaks in names are spaces.

    Repeated identical rows with a turn are one message; without a turn each row is a message of its own. A NULL text is
    an empty message, told from an empty text; rows without conv_id or role belong to no dialogue. A dialogue with no
    participant gives no row, nor does an empty table. A text of any length stays whole."""
    said = turns.select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL AND role IS NOT NULL")
    times = F.when(F.col("turn").isNull(), F.count("*")).otherwise(1).cast("bigint").alias("times")
    part = F.floor(F.col("turn") / F.lit(part_turns)).cast("bigint").alias("part")
    known = said.groupBy("conv_id", "turn", "role", "text").agg(times).select("conv_id", part, "turn", "role", "text", "times")
    message = F.struct("turn", "role", _plain(F.col("text")).alias("text"))
    parts = _pieces(known, part_turns).groupBy("conv_id", "part", "piece").agg(
        F.array_sort(F.flatten(F.collect_list(F.array_repeat(message, F.col("times").cast("int"))))).alias("said")
    )
    speakers = known.where(~F.col("role").isin(*context_roles)).select("conv_id", F.col("role").alias("speaker")).distinct()
    views = parts.join(speakers, "conv_id")
    pieces = F.transform(
        "said",
        lambda x: F.struct(
            _header(x["role"], F.col("speaker"), context_roles).alias("header"),
            F.concat(x["text"], F.lit(END)).alias("body"),
            ((x["role"] == F.col("speaker")) & ~x["role"].isin(*context_roles)).alias("own"),
        ),
    )
    views = views.select("conv_id", "speaker", "part", "piece", F.size("said").cast("bigint").alias("n_turns"), pieces.alias("pieces"))
    span = F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.slice(F.array(span), 1, 0).alias("masks"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["header"])
        end = begin + F.length(x["body"])
        found = F.struct(begin.cast("bigint").alias("start"), end.cast("bigint").alias("end"))
        masks = F.when(x["own"], F.concat(state["masks"], F.array(found))).otherwise(state["masks"])
        return F.struct(end.cast("bigint").alias("at"), masks.alias("masks"))

    rendered = F.array_join(F.transform("pieces", lambda x: F.concat(x["header"], x["body"])), "")
    masks = F.aggregate("pieces", empty, step)["masks"]
    return views.select("conv_id", "speaker", "part", "piece", "n_turns", rendered.alias("rendered"), masks.alias("masks"))


def digest(views: DataFrame) -> DataFrame:
    """Renderings with masks as text (start-end joined by blanks) and the number of characters they cover."""
    text = lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))
    covered = F.aggregate("masks", F.lit(0).cast("bigint"), lambda n, m: n + m["end"] - m["start"])
    return views.select(
        "conv_id", "speaker", "part", "piece", "n_turns", "rendered",
        F.array_join(F.transform("masks", text), " ").alias("mask_spans"), covered.alias("n_masked"),
    )
