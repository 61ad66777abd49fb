"""Rows that a join may need, chosen before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESIDUES = 1 << 20


def residue(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(RESIDUES))


def only_matching(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows whose key may be one of ``wanted``: all that are, and of the others about one in ``RESIDUES`` for each.

    At most ``RESIDUES`` numbers are broadcast; with many more keys than that in ``wanted`` all rows pass.
    """
    held = wanted.select(residue(wanted_key).alias("_residue")).distinct()
    return rows.withColumn("_residue", residue(key)).join(F.broadcast(held), "_residue", "left_semi").drop("_residue")
