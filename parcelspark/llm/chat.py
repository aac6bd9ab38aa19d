"""Multi-party chat formatting: every dialogue once from each participant's place, with loss masks.

For each participant (every role but ``system``) the dialogue is rendered with that speaker as the assistant, the others
as named users and system messages as they are. The mask covers the assistant's own text and end mark. A rendering is
returned in parts of ``PART_TURNS`` turns, in order, so that no dialogue has to fit into one row: joining a rendering's
parts gives it whole, and mask places count from its beginning. Only DataFrame functions are used.

Defined cases: rows that repeat conversation, turn, role and text are one message. Messages of one turn follow each other
by role, then text, null first. Messages without a turn come last, in parts of their own by a hash of role and text. Null
text is empty. A null role is a user without a name, and no participant. Null conv_id is a dialogue of its own. Dialogues
without a participant have no rendering. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 64
LOOSE_PARTS = 4096  # parts of a dialogue's messages without a turn
END = "<|end|>\n"


def _head(role: Column, speaker: Column) -> Column:
    return (
        F.when(role.isNull(), F.lit("<|user|>\n"))
        .when(role == "system", F.lit("<|system|>\n"))
        .when(role == speaker, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))
    )


def _masks(messages: Column, speaker: Column, start: Column) -> Column:
    """(start, end) of what the speaker said, counted from the rendering's beginning."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    zero = F.struct(start.cast("bigint").alias("at"), empty.alias("masks"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + F.length(_head(m["role"], speaker))
        end = begin + F.length(m["text"]) + len(END)
        own = F.array(F.struct(begin.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
        return F.struct(end.cast("bigint").alias("at"), F.when(m["role"].eqNullSafe(speaker), F.concat(acc["masks"], own)).otherwise(acc["masks"]).alias("masks"))

    return F.aggregate(messages, zero, step, lambda acc: acc["masks"])


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, speaker, part (0 first), n_messages, start (characters before the part), rendered, masks."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    loose = F.pmod(F.xxhash64("role", "text"), F.lit(LOOSE_PARTS))
    rows = conversations.select(
        "conv_id", F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("v"), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).alias("key"),
        F.col("turn").isNull().alias("late"), F.when(F.col("turn").isNull(), loose).otherwise(F.floor(F.col("turn") / part_turns)).alias("block"),
        F.struct(F.col("turn"), F.col("role").cast("string").alias("role"), text).alias("m"),
    )
    blocks = rows.groupBy("key", "late", "block").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_set("m")).alias("messages"))
    speakers = rows.where(F.col("m.role").isNotNull() & (F.col("m.role") != "system")).groupBy("key").agg(F.collect_set("m.role").alias("speakers"))
    # where each block of each rendering starts: sums over narrow rows
    shape = blocks.select("key", "late", "block", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.length(m["text"]).alias("size"))).alias("shape"))
    sized = shape.join(speakers, "key").select("key", "late", "block", "shape", F.explode("speakers").alias("speaker"))
    size = F.aggregate("shape", F.lit(0).cast("bigint"), lambda acc, m: acc + F.length(_head(m["role"], F.col("speaker"))) + m["size"] + len(END))
    order = Window.partitionBy("key", "speaker").orderBy("late", "block")
    placed = sized.select("key", "late", "block", "speaker", size.alias("size")).select(
        "key", "late", "block", "speaker", (F.row_number().over(order) - 1).alias("part"), F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start")
    )
    both = blocks.join(placed.groupBy("key", "late", "block").agg(F.collect_list(F.struct("speaker", "part", "start")).alias("places")), ["key", "late", "block"])
    each = both.select("conv_id", "messages", F.explode("places").alias("p")).select("conv_id", "messages", "p.*")
    pieces = F.transform("messages", lambda m: F.concat(_head(m["role"], F.col("speaker")), m["text"], F.lit(END)))
    return each.select(
        "conv_id", "speaker", F.col("part").cast("bigint").alias("part"), F.size("messages").cast("bigint").alias("n_messages"), F.col("start").cast("bigint").alias("start"),
        F.array_join(pieces, "").alias("rendered"), _masks(F.col("messages"), F.col("speaker"), F.col("start")).alias("masks"),
    )
