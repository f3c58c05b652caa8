"""Chat formatting: every participant's view of a dialogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewait.llm.common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
RANGE_ROWS = 1 << 18  # rows of crowded blocks in one range of their order, on average
SMALL = 1 << 20  # crowded blocks that are broadcast


def _crowded(rows: DataFrame, heavy: DataFrame, most_turns: int) -> DataFrame:
    """The rows of the heavy blocks with part: their place in their block's order, by most_turns.

    Ranges of the order are put in order one by one; counts of the ranges before give each its first place. The ranges are cut by
    the first 200 characters of a text, so that no long text is sampled to the driver."""
    number, total = heavy.agg(F.count("*"), F.sum("n")).first()
    keys = heavy.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
    mine = rows.join(F.broadcast(keys) if number <= SMALL else keys, same).drop("_conv", "_block")
    ranges = mine.repartitionByRange(-(-total // RANGE_ROWS), "conv_id", "block", "turn", "role", F.substring("text", 1, 200))
    ranges = written(ranges.withColumn("range", F.spark_partition_id()), "chat-ranges")
    counts = ranges.groupBy("conv_id", "block", "range").count()
    before = Window.partitionBy("conv_id", "block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(
        F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), F.col("range").alias("_range"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin"),
    )
    inside = Window.partitionBy("conv_id", "block", "range").orderBy("turn", "role", "text")
    placed = ranges.withColumn("r", F.row_number().over(inside)).join(F.broadcast(begins) if number <= SMALL else begins, same & (F.col("range") == F.col("_range")))
    return placed.select(*rows.columns, F.floor((F.col("begin") + F.col("r") - 1) / most_turns).alias("part"))


def rotate_perspectives(
    turns: DataFrame, block_turns: int = 64, system_roles: tuple[str, ...] = ("system",), conv_col: str = "conv_id",
    turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_turns: int = 1024,
) -> DataFrame:
    """One row per conversation, participant, block of turns and part: conv_id, speaker, block, part, n_turns, n_own, text, mask.

    The speaker's turns are rendered as `assistant`, those of the others as `user name=<role>`, system turns as
    `system`; system roles are not participants. A turn is `<|im_start|>HEAD\\nTEXT<|im_end|>\\n`; `<|` in a
    text is written `<\\|`, so no text can open or close a turn. mask holds the (start, end) character
    ranges of text to be learnt: the speaker's words and the marker that ends them.

    Turns go by number, then role, then text; those of numbers [64k, 64k + 64) form block k. A block of up to
    most_turns turns is one part, 0; where numbers repeat (or are null) so often that it has more, parts of most_turns turns follow
    each other in that order, and their texts in turn are the block's. So a conversation of any
    length is rendered whole without being gathered whole; mask counts from the start of its own row's text. Exactly repeated rows count once. A null role is
    the participant `unknown`; null text is empty; null turns stand first, as number -1 of block -1; rows of null conv_id are one
    conversation. A conversation of system turns alone has no participant and no row. Other columns are
    not read. An empty table gives an empty result.

    Plan: rows are made distinct and gathered by (conversation, block, part), at most most_turns to an array; the
    participants, a row each, are joined to the blocks. Row counts, which need no text, tell which blocks may have more than
    one part; only their rows are put in order, in ranges that many tasks share.
    """
    role = F.coalesce(F.col(role_col), F.lit("unknown"))
    number = F.coalesce(F.col(turn_col).cast("long"), F.lit(-1).cast("long"))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), number.alias("turn"), role.alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).distinct()
    rows = rows.withColumn("block", F.floor(F.col("turn") / block_turns))
    heavy = turns.groupBy(F.col(conv_col).alias("conv_id"), F.floor(number / block_turns).alias("block")).agg(F.count("*").alias("n"))
    heavy = written(heavy.filter(F.col("n") > most_turns), "chat-heavy")
    parts = rows.withColumn("part", F.lit(0).cast("long"))
    if not heavy.isEmpty():
        keys = heavy.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"))
        same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
        parts = parts.join(F.broadcast(keys) if keys.count() <= SMALL else keys, same, "left_anti").unionByName(_crowded(rows, heavy, most_turns))
    blocks = parts.groupBy("conv_id", "block", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    people = rows.filter(~F.col("role").isin(*system_roles)).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()

    def piece(t: Column) -> Column:
        own = t["role"] == F.col("speaker")
        head = F.when(own, "assistant").when(t["role"].isin(*system_roles), "system").otherwise(F.concat(F.lit("user name="), t["role"]))
        head = F.concat(F.lit(OPEN), F.regexp_replace(head, r"[\r\n]", " "), F.lit("\n"))
        body = F.concat(F.replace(t["text"], F.lit("<|"), F.lit("<\\|")), F.lit(CLOSE))
        return F.struct(own.alias("own"), F.length(head).alias("skip"), (F.length(head) + F.length(body)).alias("size"), F.concat(head, body).alias("text"))

    def begin(k: Column) -> Column:
        return F.aggregate(F.slice("sizes", 1, k), F.lit(0), lambda total, size: total + size)

    marked = F.transform("pieces", lambda p, k: F.struct(
        p["own"].alias("own"), (begin(k) + p["skip"]).alias("start"), (begin(k) + p["size"] - 1).alias("end"),
    ))
    return (
        blocks.join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))
        .select("conv_id", "speaker", "block", "part", F.transform("turns", piece).alias("pieces"))
        .withColumn("sizes", F.col("pieces.size"))
        .select(
            "conv_id", "speaker", "block", "part", F.size("pieces").cast("long").alias("n_turns"),
            F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own"),
            F.array_join("pieces.text", "").alias("text"),
            F.transform(F.filter(marked, lambda m: m["own"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias("mask"),
        )
    )
