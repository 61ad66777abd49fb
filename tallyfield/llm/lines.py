"""Line dedup with two Bloom filters: lines found in many documents lose their places.

Tasks put the hash of each distinct line key of a document into a filter of keys seen once and,
when it is there already, into a filter of keys seen twice. Only keys in the merged second filter
are suspects: they alone are shuffled, with their exact text, and counted. The filters have a
bounded size; what tests positive by chance is counted and found harmless.

A key is the line without blanks ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased.

Defined cases: a null or empty text is one empty line, whose key has no characters and is never
dropped while ``min_length`` is 1 or more; a line repeated in one document counts that document
once; repeated rows are documents of their own; rows of equal text lose the same lines, or, when
first occurrences stay, all of the first text's rows keep it. Other columns pass through, and a
column with an output's name is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm.bloom import CHUNKS, Filter, OnceTwice, bits_for, merge_once_twice
from tallyfield.llm.text import fields_and, map_pieces, pieces, texts, with_columns
from tallyfield.session import written

MIN_DOCUMENTS = 10
MIN_LENGTH = 1


def line_keys(text: str) -> list[bytes]:
    """The key of each line in UTF-8; ``bytes`` lowers A-Z and strips the six blanks only."""
    return [line.strip() for line in text.encode().lower().split(b"\n")]


def keys_of(text: str, min_length: int = MIN_LENGTH) -> set[bytes]:
    """The distinct line keys of a text that may be dropped."""
    keys = set(line_keys(text))
    return {k for k in keys if len(k) >= min_length and (min_length < 2 or len(k.decode()) >= min_length)}


def hashes_of(keys) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)


def repeated_filter(docs: DataFrame, text: str, min_length: int) -> tuple[np.ndarray, int]:
    """The filter of line keys that seem to stand in two documents or more, and its size in bits.

    It is built by as many tasks as the cluster runs at once, each over many splits, so the filters
    that are merged grow with the cluster and not with the table.
    """
    lines = F.length(F.coalesce(text, F.lit(""))) - F.length(F.replace(F.coalesce(text, F.lit("")), F.lit("\n")))
    total = docs.agg(F.sum(lines + 1)).first()[0] or 0
    bits = bits_for(total)
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism

    def build(batches):
        seen = OnceTwice(bits)
        for batch in batches:
            for piece in pieces(batch, text):
                seen.add(hashes_of([k for t in texts(piece, text) for k in keys_of(t, min_length)]))
        yield from seen.chunks()

    return merge_once_twice(docs.select(text).coalesce(tasks).mapInArrow(build, CHUNKS), bits), bits


def drop_common_lines(
    docs: DataFrame, text: str = "text", order: str = "doc_id",
    min_documents: int = MIN_DOCUMENTS, min_length: int = MIN_LENGTH, keep_first: bool = False,
) -> DataFrame:
    """Remove the lines whose key stands in ``min_documents`` documents or more.

    Gives ``docs`` with the new text, ``n_lines`` before and ``n_dropped``. With ``keep_first`` the
    first line of each such key stays in the document that comes first by ``order``.
    """
    spark = docs.sparkSession
    data, bits = repeated_filter(docs, text, min_length)
    shared = spark.sparkContext.broadcast(data)  # at most MOST_BITS bits

    def make_suspects():
        suspected = Filter(bits, shared.value)

        def work(piece):
            orders, digests, keys = [], [], []
            for t, o in zip(texts(piece, text), piece.column("_order").to_pylist(), strict=True):
                own = sorted(keys_of(t, min_length))
                if own:
                    hit = [own[i] for i in np.flatnonzero(suspected.has(hashes_of(own)))]
                    keys += hit
                    orders += [o] * len(hit)
                    digests += [hashlib.md5(t.encode()).hexdigest()] * len(hit)
            return pa.RecordBatch.from_arrays(
                [pa.array(orders, pa.string()), pa.array(digests, pa.string()), pa.array(keys, pa.binary())],
                names=["_order", "_digest", "_key"],
            )

        return work

    # text order of a padded number is its number order
    padded = F.format_string("%020d", F.col(order)) if dict(docs.dtypes)[order] in ("bigint", "int") else F.col(order)
    suspects = written(
        map_pieces(
            docs.select(text, F.coalesce(padded.cast("string"), F.lit("~")).alias("_order")),
            text,
            T.StructType(
                [T.StructField(n, T.StringType()) for n in ("_order", "_digest")]
                + [T.StructField("_key", T.BinaryType())]
            ),
            make_suspects,
        ),
        "line-suspects",
    )
    common = written(
        suspects.groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_documents"), F.min(F.struct("_order", "_digest")).alias("_first"))
        .where(F.col("_documents") >= min_documents)
        .select("_key", F.col("_first._digest").alias("_first")),
        "common-lines",
    )
    first = (F.col("_first") == F.col("_digest")) & F.lit(keep_first)
    losses = written(
        suspects.select("_digest", "_key").distinct().join(common, "_key")
        .groupBy("_digest")
        .agg(F.collect_list(F.struct("_key", first.alias("_stays"))).alias("_losses")),
        "line-losses",
    )

    def make_cut():
        def work(piece):
            out, before, dropped = [], [], []
            losses_of = piece.column("_losses").to_pylist()
            for t, lost in zip(texts(piece, text), losses_of, strict=True):
                before.append(t.count("\n") + 1)
                dropped.append(0)
                if lost:
                    lines = t.split("\n")
                    stays = {x["_key"]: x["_stays"] for x in lost}
                    kept = []
                    for line, key in zip(lines, line_keys(t), strict=True):
                        if key not in stays:
                            kept.append(line)
                        elif stays[key]:
                            kept.append(line)
                            stays[key] = False
                    dropped[-1] = before[-1] - len(kept)
                    t = "\n".join(kept)
                out.append(t)
            return with_columns(
                piece.drop_columns(["_losses", "_digest"]),
                **{
                    text: pa.array(out, pa.string()),
                    "n_lines": pa.array(before, pa.int64()),
                    "n_dropped": pa.array(dropped, pa.int64()),
                },
            )

        return work

    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    marked = docs.withColumn("_digest", digest).join(losses, "_digest", "left")
    added = {text: T.StringType(), "n_lines": T.LongType(), "n_dropped": T.LongType()}
    return map_pieces(marked, text, fields_and(docs.schema, **added), make_cut).select(
        *docs.columns, *(c for c in ("n_lines", "n_dropped") if c not in docs.columns)
    )
