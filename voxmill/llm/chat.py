"""Multi-party perspective rotation of dialogues.

Every participant of a dialogue gets a rendering in which that speaker is the assistant and all others are users with
their names; only the assistant's own words count for the loss.  A rendering is a run of rows, one for each turn, with
the place of its text and of its loss span in the whole: no dialogue, however long, is gathered into one row or one
task, as places are added up within stretches of turns first and over stretches next.

Defined results: system turns are context in every rendering, and "system" is no participant; a null speaker is called
"unknown"; null text is empty; turns with null numbers come last; turns with equal numbers are ordered by speaker, then
text; repeated rows are turns of their own; rows with a null dialogue id are one dialogue.  A dialogue with system turns
alone, or an empty table, has no rendering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM, UNKNOWN = "system", "unknown"
_END = "<|end|>\n"
#: Turn numbers in a stretch.
_STRETCH = 256


def rotate(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", speaker_column: str = "role", text_column: str = "text") -> DataFrame:
    """conv_id, perspective, turn, role, name, text, start, length, loss_start, loss_end, in characters of the rendering."""
    rows = turns.select(
        F.col(conv_column).alias("conv_id"),
        F.col(turn_column).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_column), F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce(F.col(text_column), F.lit("")).alias("said"),
    )
    # null-safe key: the join below is an equality that Spark can hash and split
    rows = rows.withColumn("dialogue", F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("id")))
    people = rows.where(F.col("speaker") != SYSTEM).select("dialogue", F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(people, "dialogue")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    seen = seen.withColumns({"role": role, "name": F.when(~own & (F.col("speaker") != SYSTEM), F.col("speaker"))})
    head = F.concat(F.lit("<|"), F.concat_ws(" name=", "role", "name"), F.lit("|>\n"))
    seen = seen.withColumns({"head": F.length(head), "text": F.concat(head, F.col("said"), F.lit(_END)), "stretch": F.expr(f"turn div {_STRETCH}")})
    seen = seen.withColumn("length", F.length("text"))
    whole = ["dialogue", "perspective"]
    order = [F.col("turn").asc_nulls_last(), "speaker", "said"]
    totals = seen.groupBy(*whole, F.col("stretch").alias("s")).agg(F.sum("length").alias("chars"))
    before = Window.partitionBy(*whole).orderBy(F.col("s").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("dialogue").alias("d"), F.col("perspective").alias("p"), "s", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*whole, "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = seen.withColumn("within", F.sum("length").over(within) - F.col("length"))
    placed = placed.join(totals, (F.col("dialogue") == F.col("d")) & (F.col("perspective") == F.col("p")) & F.col("stretch").eqNullSafe(F.col("s")))
    start = F.col("base") + F.col("within")
    loss = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "turn", "role", "name", "text", start.alias("start"), F.col("length").cast("long").alias("length"),
        F.when(loss, start + F.col("head")).alias("loss_start"), F.when(loss, start + F.col("length")).alias("loss_end"),
    )


def documents(rendered: DataFrame) -> DataFrame:
    """One row for each rendering: its whole text and loss spans.  For dialogues that fit into a row."""
    one = F.sort_array(F.collect_list(F.struct("start", "text", "loss_start", "loss_end")))
    grouped = rendered.groupBy("conv_id", "perspective").agg(one.alias("turns"))
    spans = F.expr("transform(filter(turns, t -> t.loss_start is not null), t -> struct(t.loss_start as start, t.loss_end as end))")
    return grouped.select("conv_id", "perspective", F.expr("array_join(transform(turns, t -> t.text), '')").alias("text"), spans.alias("loss_spans"))
