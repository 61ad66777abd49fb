"""Secret scan: candidate values judged by who else in the corpus has them.

Three base patterns find assignments, access keys and hex runs. Opaque words (20 characters or
more, with letters and digits) are further candidates. The hash of every candidate value is counted over
the corpus by distinct repositories and owners: a value that many owners hold is a copied example,
one that few hold looks live. Opaque words outside the base spans that look live are added as
spans of kind ``live``.

Counts are reduced per (value, owner, repository), then per (value, owner), then per value, so a
value that a third of all rows hold reaches the last step as one row per owner and task.

Defined cases: a null text has no spans; a value counts once per owner and repository however
often it is repeated; rows with a null owner or repository share one unknown owner or repository;
spans are whole matches in code points, end exclusive; equal rows give equal results.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm.text import fields_and, map_pieces, texts, with_columns
from tallyfield.session import written

# The base patterns and the lengths that their matches need.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
ASSIGN_LENGTH = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGIT = re.compile(r"[0-9]")
LETTER = re.compile(r"[A-Za-z]")
#: A value that more distinct owners than this hold is a copied example.
LIVE_OWNERS = 2
#: The same for distinct repositories.
LIVE_REPOSITORIES = 4


def find_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind number, start, end, value) of base spans and of opaque words that no base span touches.

    A run long enough is the whole match of the access and hex patterns, and a shorter run cannot
    hold a longer one, so the length may stand in those patterns; an assignment too short is
    dropped after it was matched.
    """
    spans = [
        (0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH
    ]
    spans += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    spans += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    taken = sorted((a, b) for _, a, b, _ in spans)
    free, passed, reach = [], 0, 0  # both lists go by start, so each is walked once
    for m in OPAQUE.finditer(text):
        while passed < len(taken) and taken[passed][0] < m.end():
            reach = max(reach, taken[passed][1])
            passed += 1
        if reach <= m.start() and DIGIT.search(m[0]) and LETTER.search(m[0]):
            free.append((3, m.start(), m.end(), m[0]))
    return spans + free


def value_hash(value: str) -> bytes:
    return hashlib.blake2b(value.encode(), digest_size=16).digest()


SPAN = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("end", T.LongType()),
        T.StructField("value", T.BinaryType()),
    ]
)
_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.binary())])


def add_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``candidates``: the spans of each whole text by start and kind, with hashes of their values."""

    def make():
        def work(piece):
            found = [
                [
                    {"start": a, "kind": k, "end": b, "value": value_hash(v)}
                    for k, a, b, v in sorted(find_spans(t), key=lambda s: (s[1], s[0]))
                ]
                for t in texts(piece, text)
            ]
            return with_columns(piece, candidates=pa.array(found, pa.list_(_SPAN)))

        return work

    return map_pieces(df, text, fields_and(df.schema, candidates=T.ArrayType(SPAN)), make)


def ownership(candidates: DataFrame, owner: str, repository: str) -> DataFrame:
    """Distinct owners and repositories of each value."""
    return (
        candidates.groupBy("value", owner, repository)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .groupBy("value", owner)
        .agg(F.count(F.lit(1)).alias("_repositories"), F.sum("_rows").alias("_rows"))
        .groupBy("value")
        .agg(
            F.count(F.lit(1)).alias("n_owners"),
            F.sum("_repositories").alias("n_repositories"),
            F.sum("_rows").alias("n_uses"),
        )
    )


def scan_secrets(
    docs: DataFrame, text: str = "text", owner: str = "owner", repository: str = "repository",
    live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES,
) -> DataFrame:
    """Find and judge secrets; gives ``docs`` without its text, with ``secrets``.

    ``secrets`` lists (start, kind, end, live) by start and kind: all base spans, live or copied,
    and opaque words that look live.
    """
    found = written(
        add_candidates(docs, text).drop(text).withColumn("_row", F.monotonically_increasing_id()), "secrets"
    )
    uses = found.select("_row", owner, repository, F.explode("candidates").alias("c")).select(
        "_row", owner, repository, F.col("c.value").alias("value")
    )
    judged = written(ownership(uses, owner, repository), "secret-values")
    live = judged.where(
        (F.col("n_owners") <= live_owners) & (F.col("n_repositories") <= live_repositories)
    ).select("value")
    live_of_row = (
        uses.select("_row", "value").join(live, "value").groupBy("_row").agg(F.collect_set("value").alias("_live"))
    )

    def judged_span(c: Column) -> Column:
        return F.struct(
            c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"),
            F.array_contains(F.col("_live"), c["value"]).alias("live"),
        )

    none = F.array().cast("array<binary>")
    return (
        found.join(live_of_row, "_row", "left")
        .withColumn("_live", F.coalesce("_live", none))
        .withColumn("secrets", F.transform("candidates", judged_span))
        .withColumn("secrets", F.filter("secrets", lambda s: (s["kind"] < 3) | s["live"]))
        .drop("_row", "_live", "candidates")
    )


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )
