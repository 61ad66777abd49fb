"""Templates of failure messages: few rows for messages of unbounded variety, with exact counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.reqlog import _failed
from tallyfield.session import written

DEPTH = 2
CHILDREN = 16
VARIES = "<*>"


def message_templates(
    log: DataFrame,
    keys: Sequence[str] = (),
    message: str = "message",
    depth: int = DEPTH,
    children: int = CHILDREN,
) -> DataFrame:
    """Failures per message template, and how many messages, numbers aside, have it.

    Runs of digits vary. A tree has the number of tokens at its root and one of the first ``depth`` tokens on each
    level; a node with more than ``children`` different next tokens has one child for all of them. In a leaf a token
    varies where more than ``children`` different ones stand. Both depend on the messages alone, not on their order or
    place, so tasks reduce their own messages first and any number of them gives the same templates. The tree is that of all
    rows; ``keys`` only split the counts. A null message is a template of its own, which is null.

    The distinct messages are written before the tree is built, as every level reads them.
    """
    text = F.regexp_replace(F.col(message), "[0-9]+", VARIES)
    counts = log.where(_failed()).groupBy(*keys, text.alias("__text")).agg(F.count(F.lit(1)).alias("__n"))
    tokens = F.split("__text", "[ \t\r\n]+")
    rows = written(counts, "messages").withColumn("__tokens", tokens)
    rows = rows.withColumn("__node", F.size("__tokens").cast("string"))
    for level in range(depth):
        token = F.coalesce(F.get("__tokens", F.lit(level)), F.lit(""))
        wide = (
            rows.select("__node", token.alias("__token")).distinct()
            .groupBy("__node").agg((F.count(F.lit(1)) > children).alias("__wide")).where("__wide")
        )
        here = F.expr(f"transform(__tokens, (t, i) -> if(__wide and i = {level}, '{VARIES}', t))")
        rows = rows.join(wide, "__node", "left").withColumn("__tokens", here)
        rows = rows.withColumn("__node", F.concat_ws("\n", "__node", token)).drop("__wide")
    places = rows.select("__node", F.posexplode("__tokens").alias("__place", "__token")).distinct()
    varying = (
        places.groupBy("__node", "__place").agg(F.count(F.lit(1)).alias("__several")).where(F.col("__several") > children)
        .groupBy("__node").agg(F.collect_set("__place").alias("__varying"))  # no more than a message has tokens
    )
    token = lambda t, i: F.when(F.array_contains("__varying", i), VARIES).otherwise(t)
    template = F.array_join(F.transform("__tokens", token), " ")
    return (
        rows.join(varying, "__node", "left")
        .groupBy(*keys, template.alias("template"))
        .agg(F.sum("__n").alias("failures"), F.count_distinct("__text").alias("messages"))
    )
