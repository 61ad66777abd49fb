"""Which sessions are in use, per group of sessions.

A session with no place in the listing takes its id for one. A session with no id cannot be
named: it may be active, but is neither first nor ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.running import BLOCK_BITS, running_total

# The states of a session in use, compared in lower case.
ACTIVE_STATES = ("idle", "starting", "running")


def is_active(state: str = "state") -> Column:
    return F.lower(F.col(state)).isin(*ACTIVE_STATES)


def active_sessions(sessions: DataFrame, state: str = "state") -> DataFrame:
    """The sessions whose state is one of ``ACTIVE_STATES`` in any letter case."""
    return sessions.where(is_active(state))


def _place(order: str, session_id: str) -> Column:
    return F.coalesce(F.col(order).cast("bigint"), F.col(session_id).cast("bigint"))


def first_active(
    sessions: DataFrame,
    keys: Sequence[str],
    order: str = "position",
    session_id: str = "id",
    state: str = "state",
) -> DataFrame:
    """Per group, the id of the active session listed first; 0 where none is active."""
    named = is_active(state) & F.col(session_id).isNotNull()
    chosen = F.min_by(F.col(session_id), F.when(named, _place(order, session_id)))
    return sessions.groupBy(*keys).agg(
        F.coalesce(chosen, F.lit(0)).cast("bigint").alias("first_active_id")
    )


def active_positions(
    sessions: DataFrame,
    keys: Sequence[str],
    order: str = "position",
    session_id: str = "id",
    state: str = "state",
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """One row per active session with its rank in its group, last listed first.

    ``order`` is the bigint place in the listing, unique in its group. Places may be far apart,
    such as ids, so blocks are cut twice. A long group is many rows, never one array.
    """
    named = active_sessions(sessions, state).where(F.col(session_id).isNotNull())
    active = named.select(
        *keys,
        F.col(session_id).alias("session_id"),
        (-_place(order, session_id)).alias("__from_end"),
        F.lit(1).cast("bigint").alias("__one"),
    )
    ranked = running_total(active, keys, "__from_end", "__one", "rank", bits=bits, levels=2)
    return ranked.select(*keys, "rank", "session_id")
