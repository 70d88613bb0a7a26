"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant, and all others as users under their names; only what the assistant says is
learnt from. Instructions (the role ``system``) are nobody's turn and stay as they are in every
perspective.

The result has a row for each turn of each perspective: its rendered text, where it stands
in the whole rendering, and the span of it that the mask admits. A rendering is its rows' texts
in order; so a conversation of any length never has to fit one row or task. A range sort gives every turn
its place, and offsets are prefix sums of two levels: over runs of so many places, then within a run. A conversation
that holds a third of all turns is dealt to many runs, whatever its turns' numbers are.

Texts and names cannot forge a turn: in ``<|im_``, with which all marks begin, they get a blank behind the
``<``, and line breaks in a name become blanks. Offsets and masks speak of the texts as rendered.

Defined results: a null role is the speaker ``unknown``, a null text is empty. Turns of equal
number are ordered by role and text, and repeated rows stay; null numbers come first. Speakers whose names differ
stay apart, even if the names are rendered alike. A conversation
of instructions only has no participant and no rows. An empty table gives an empty result.
Other columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm.tables import numbered, settled

# The marks around a turn, in the common chat markup, and roles.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM, ASSISTANT, USER, UNKNOWN = "system", "assistant", "user", "unknown"
#: How marks begin, and what stands for that in texts and names.
MARK, BROKEN = "<|im_", "< |im_"
#: Turns to a run.
RUN = 4096


def unmarked(text: Column) -> Column:
    """The text without anything that could be taken for a mark."""
    return F.replace(text, F.lit(MARK), F.lit(BROKEN))


def perspectives(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", run: int = RUN) -> DataFrame:
    """``conv_id``, ``speaker`` (the perspective), ``turn``, ``place`` (from 0), ``rendered``, ``start``, ``end``, ``masked_from``, ``masked_to`` and ``learnt``.

    Offsets are characters in the perspective's whole rendering. The span admitted by the mask is the
    assistant's text with its closing mark; other turns have a null span.
    """
    turns = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(UNKNOWN)).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    # Conversations may have a null id, which joins must treat as one.
    turns = turns.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")))
    turns = numbered(turns, [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "number")
    turns = turns.withColumn("text", unmarked(F.col("text"))).withColumn("run", F.floor(F.col("number") / run))
    people = turns.filter(F.col("role") != SYSTEM).select("conv", F.col("role").alias("speaker")).distinct()
    rows = turns.join(people, "conv")

    own = F.col("role") == F.col("speaker")
    name = F.translate(unmarked(F.col("role")), "\r\n", "  ")
    head = F.when(own, F.lit(ASSISTANT)).when(F.col("role") == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit(f"{USER} name="), name))
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), head, F.lit("\n"))).withColumn("rendered", F.concat("head", "text", F.lit(f"{CLOSE}\n")))

    by = ["conv", "speaker"]
    runs = settled(rows.groupBy(*by, "run").agg(F.sum(F.length("rendered")).alias("chars"), F.count("*").alias("n")))
    earlier = Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = {"char_base": F.coalesce(F.sum("chars").over(earlier), F.lit(0)), "place_base": F.coalesce(F.sum("n").over(earlier), F.lit(0))}
    within = Window.partitionBy(*by, "run").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"start": F.coalesce(F.sum(F.length("rendered")).over(within), F.lit(0)), "place": F.count("*").over(within)})
    rows = rows.join(runs.withColumns(before).drop("chars", "n"), [*by, "run"])
    rows = rows.withColumns({"start": F.col("start") + F.col("char_base"), "place": F.col("place") + F.col("place_base")})
    masked_from = F.col("start") + F.length("head")
    return rows.select(
        "conv_id", "speaker", "turn", "place", "rendered", "start",
        (F.col("start") + F.length("rendered")).alias("end"),
        F.when(own, masked_from).alias("masked_from"),
        F.when(own, masked_from + F.length("text") + len(CLOSE)).alias("masked_to"),
        own.alias("learnt"),
    )
