"""JSON replies of a statement service to typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields of the three JSON documents, and the reply kinds of a statement.
STATEMENT_SCHEMA = (
    "id BIGINT, state STRING, output STRUCT<status: STRING, data: MAP<STRING, STRING>, "
    "ename: STRING, evalue: STRING, stackTrace: ARRAY<STRING>>"
)
SESSION_SCHEMA = (
    "id BIGINT, appId STRING, state STRING, "
    "appInfo STRUCT<driverLogUrl: STRING, sparkUiUrl: STRING>, log ARRAY<STRING>"
)
SESSION_LIST_SCHEMA = f"`from` INT, total INT, sessions ARRAY<STRUCT<{SESSION_SCHEMA}>>"
FINISHED_STATE = "available"
TEXT_KIND = "text/plain"
TABLE_KIND = "application/vnd.livy.table.v1+json"


def statement_fields(reply: Column) -> Column:
    """The statement's id, state and output as columns; all null for text that is not such JSON.

    A generator parses each reply once. A plain column would be parsed again in every filter
    that Catalyst moves below it.
    """
    return F.inline(F.array(F.from_json(reply, STATEMENT_SCHEMA)))


def session_fields(reply: Column) -> Column:
    """The fields of a session snapshot as columns; unknown fields are ignored."""
    return F.inline(F.array(F.from_json(reply, SESSION_SCHEMA)))


def listed_sessions(reply: Column) -> Column:
    """The place, from 0, and the fields of each session in a JSON session list."""
    return F.posexplode(F.from_json(reply, SESSION_LIST_SCHEMA)["sessions"])


def statement_outcome(statement_id: Column, state: Column, output: Column) -> Column:
    """``ok``, ``error``, ``pending`` (not finished) or ``invalid`` (not a reply that can be read)."""
    status = output["status"]
    return (
        F.when(statement_id.isNull() & state.isNull() & output.isNull(), "invalid")
        .when(state.isNull() | (state != FINISHED_STATE), "pending")
        .when((status == "ok") & output["data"].isNotNull(), "ok")
        .when(status == "error", "error")
        .otherwise("invalid")
    )


def statement_text(output: Column) -> Column:
    """The table JSON if there is one, else the plain text, else the empty text."""
    data = output["data"]
    plain = F.try_element_at(data, F.lit(TEXT_KIND))
    return F.coalesce(
        F.try_element_at(data, F.lit(TABLE_KIND)),
        F.when(F.map_contains_key(data, TEXT_KIND), plain).otherwise(""),
    )
