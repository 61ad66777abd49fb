"""Removal of repeated byte strings: suffixes of suspect stretches, sorted by induction shard by shard.

A byte goes if a string of ``length`` bytes that covers it also starts earlier, in a document with a
smaller id or in the same one further left.

Every string of that length holds as its anchor the place of its least hashed k-gram, so equal strings
have equal anchors in equal places. Anchors are counted by hash; only the strings at anchors found
twice are cut out, in runs of neighbouring strings with one anchor, and dealt to shards by anchor.
Strings at very common anchors are dealt one by one by their own hash instead. Each shard orders its
suffixes with ``suffixes.suffix_order``; neighbours that share ``length`` bytes are copies, and the
earliest of each group stays.

What is larger than memory lies in Spark's shuffle files, which are sorted on disk; shards are cut to
about ``SHARD_BYTES`` of all text. A task meets a hash or a run that is common in its own pieces and
sends it on once a piece, so a hot anchor costs each piece one row.

Defined cases: a null text is empty; a null id comes before all others; rows with the same id and the
same text are one document; rows with the same id and other texts are ordered by a hash of the text;
texts shorter than ``length`` lose nothing. Other columns pass through, and a column with an output's
name is replaced. Matches are judged on the bytes of the input and never cross documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm.suffixes import suffix_order
from tallyfield.llm.text import fields_and, map_pieces, mixed, pieces, with_columns
from tallyfield.session import written

LENGTH = 100
GRAM = 40

PIECE_BYTES = 4 << 20
SHARD_BYTES, LEAST_SHARDS = 4 << 20, 64
BUCKET_BYTES, LEAST_BUCKETS = 32 << 20, 32
#: An anchor found in more pieces than this and than one in 2^20 of all anchors is common.
COMMON = 2_000
RUNS_KNOWN = 200_000
PLACE_BITS = 24
NULL_ID = -(2**63)

_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` bytes from each place, from hashes of halves."""
    whole, factor, have = None, _FACTOR, 1
    part, out, done = _LETTERS[data], None, 0
    with np.errstate(over="ignore"):
        while True:
            if size & have:
                if out is None:
                    out = part
                else:
                    keep = len(part) - done
                    out = out[:keep] * factor + part[done:]
                done += have
            if 2 * have > size:
                return mixed(out)
            part = part[:-have] * factor + part[have:] if len(part) > have else part[:0]
            factor = factor * factor + np.uint64(2)
            have *= 2


class Runs:
    """The runs of neighbouring strings with one anchor in some texts: text, first string, strings, hash."""

    def __init__(self, texts: list[bytes], length: int):
        self.who, self.first, self.size, self.hash = [], [], [], []
        gram = min(GRAM, length)
        unit, units, total = 1 << 20, [], 0
        for i, t in enumerate(texts):
            for at in range(0, max(len(t) - length + 1, 0), unit):
                piece = t[at : at + unit + length - 1]
                units.append((i, at, piece))
                total += len(piece)
                if total >= PIECE_BYTES:
                    self._add(units, length, gram)
                    units, total = [], 0
        if units:
            self._add(units, length, gram)
        empty = np.zeros(0, np.int64)
        self.who, self.first, self.size = (np.concatenate(x) if x else empty for x in (self.who, self.first, self.size))
        self.hash = np.concatenate(self.hash) if self.hash else empty.astype(np.uint64)

    def _add(self, units, length: int, gram: int) -> None:
        data = np.frombuffer(b"".join(u for _, _, u in units), np.uint8)
        sizes = np.array([len(u) for _, _, u in units])
        starts = np.cumsum(sizes) - sizes
        hashes = gram_hashes(data, gram)
        places = np.uint64((1 << PLACE_BITS) - 1)
        least = (hashes & ~places) | np.arange(len(hashes), dtype=np.uint64)
        window, have = length - gram + 1, 1
        while 2 * have <= window:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if window > have:
            least = np.minimum(least[: len(least) - (window - have)], least[window - have :])
        # least[i] belongs to the string from place i; those that run over the end of a text do not count.
        anchor = (least & places).astype(np.int64)
        owner = np.repeat(np.arange(len(units)), sizes)[: len(anchor)]
        inside = np.flatnonzero(np.arange(len(anchor)) + length <= (starts + sizes)[owner])
        anchor, owner = anchor[inside], owner[inside]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
        text_of = np.array([i for i, _, _ in units])
        offset = np.array([at for _, at, _ in units])
        unit_of = owner[new]
        self.who.append(text_of[unit_of])
        self.first.append(inside[new] - starts[unit_of] + offset[unit_of])
        self.size.append(np.diff(np.r_[new, len(anchor)]))
        self.hash.append(hashes[anchor[new]])


def _binary(x: np.ndarray, dtype) -> bytes:
    return x.astype(dtype).tobytes()


_ANCHORS = "bucket int, ids array<long>, marks array<long>, who binary, run binary, hash binary"
_FOUND = "doc long, mark long, runs binary, common binary"


def _distinct(batch: pa.RecordBatch, text: str):
    """The distinct documents of a batch: ids, marks and texts in UTF-8."""
    known = {}
    for doc, mark, t in zip(*(batch.column(c).to_pylist() for c in ("_doc", "_mark", text)), strict=True):
        if t:
            known[doc, mark] = t.encode()
    return list(known), list(known.values())


def repeated_anchors(docs: DataFrame, text: str, length: int, buckets: int, common: int) -> DataFrame:
    """(doc, mark, runs): numbers of the runs of a document whose anchor is found twice or more.

    Rows without a document carry hashes of ``common`` anchors.
    """
    least = length

    def anchors(batches):
        turn = 0
        for batch in batches:
            for piece in pieces(batch, text, PIECE_BYTES):
                keys, found = _distinct(piece, text)
                runs = Runs(found, least)
                if not len(runs.hash):
                    continue
                begins = np.searchsorted(runs.who, np.arange(len(keys)))
                number = np.arange(len(runs.who)) - begins[runs.who]
                order = np.argsort(runs.hash, kind="stable")
                ordered = runs.hash[order]
                new = np.r_[True, ordered[1:] != ordered[:-1]]
                again = np.r_[~new[1:], False] | ~new
                # Twice in this piece: known here, and sent once, without a document, to tell the others.
                told = ordered[new & again]
                open_ = order[~again]
                turn += 1
                yield _send(turn % buckets + buckets, keys, runs, number, order[again], None)
                to = (runs.hash[open_] >> np.uint64(32)).astype(np.int64) % buckets
                told_to = (told >> np.uint64(32)).astype(np.int64) % buckets
                for bucket in np.unique(np.r_[to, told_to]).tolist():
                    yield _send(bucket, keys, runs, number, open_[to == bucket], told[told_to == bucket])

    def _send(bucket, keys, runs, number, rows, told):
        who, docs_of = np.unique(runs.who[rows], return_inverse=True)
        told = np.zeros(0, np.uint64) if told is None else told
        nobody = np.full(len(told), len(who))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([bucket], pa.int32()),
                pa.array([[keys[i][0] for i in who]], pa.list_(pa.int64())),
                pa.array([[keys[i][1] for i in who]], pa.list_(pa.int64())),
                pa.array([_binary(np.r_[docs_of, nobody], np.uint32)]),
                pa.array([_binary(np.r_[number[rows], nobody], np.uint32)]),
                pa.array([_binary(np.concatenate([runs.hash[rows], told]), np.uint64)]),
            ],
            names=["bucket", "ids", "marks", "who", "run", "hash"],
        )

    def twice(key, part):
        ids, marks, who, run, hashes, told = [], [], [], [], [], []
        base = 0
        for row in part.drop_columns(["bucket"]).to_pylist():
            w = np.frombuffer(row["who"], np.uint32).astype(np.int64)
            free = w == len(row["ids"])
            who.append(np.where(free, -1, w + base))
            run.append(np.frombuffer(row["run"], np.uint32))
            hashes.append(np.frombuffer(row["hash"], np.uint64))
            ids += row["ids"]
            marks += row["marks"]
            base += len(row["ids"])
        who, run, hashes = np.concatenate(who), np.concatenate(run), np.concatenate(hashes)
        hot = np.zeros(0, np.uint64)
        if key[0].as_py() < buckets:
            values, at, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            hot = values[counts > common]
            told = np.bincount(at, who < 0, len(values)) > 0
            keep = ((counts > 1) | told)[at] & (who >= 0)
            who, run = who[keep], run[keep]
        order = np.argsort(who, kind="stable")
        who, run = who[order], run[order]
        cuts = np.r_[0, np.flatnonzero(who[1:] != who[:-1]) + 1, len(who)] if len(who) else np.zeros(1, np.int64)
        docs_of = [int(who[a]) for a in cuts[:-1]]
        out = [[ids[i] for i in docs_of], [marks[i] for i in docs_of], [_binary(run[a:b], np.uint32) for a, b in zip(cuts[:-1], cuts[1:])]]
        rest = [None] * len(docs_of)
        if len(hot):
            out = [out[0] + [None], out[1] + [None], out[2] + [None]]
            rest.append(_binary(hot, np.uint64))
        return pa.table(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(rest, pa.binary())],
            names=["doc", "mark", "runs", "common"],
        )

    return docs.mapInArrow(anchors, _ANCHORS).groupBy("bucket").applyInArrow(twice, _FOUND)


_CUT = "shard int, doc long, mark long, first long, strings long, anchor long, body binary"
_SPANS = "doc long, mark long, spans binary"


def cut_runs(docs: DataFrame, text: str, length: int, shards: int, common: np.ndarray) -> DataFrame:
    """The bytes of marked runs, dealt to shards. Of equal runs met in one task the earliest goes on.

    A row without a body says that its strings are copies, whatever else there is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        known = {}
        for batch in batches:
            for piece in pieces(batch, text, PIECE_BYTES):
                rows = {}
                for doc, mark, t, marked in zip(*(piece.column(c).to_pylist() for c in ("_doc", "_mark", text, "_runs")), strict=True):
                    rows[doc, mark] = t.encode(), np.unique(np.frombuffer(b"".join(marked), np.uint32))
                keys, found = list(rows), [t for t, _ in rows.values()]
                runs = Runs(found, length)
                begins = np.searchsorted(runs.who, np.arange(len(keys)))
                chosen = np.concatenate([np.zeros(0, np.int64), *(begins[i] + m for i, (_, m) in enumerate(rows.values()))]).astype(np.int64)
                very = np.isin(runs.hash[chosen], shared.value)
                out = []

                def add(shard, key, first, strings, anchor, body):
                    here = (*key, first)
                    earliest = known.get(body)
                    if earliest is not None and earliest <= here:
                        if earliest < here:  # known as copies, so any shard may take them
                            out.append(((key[1] ^ first) % shards, *key, first, strings, None, None))
                        return
                    known[body] = here
                    out.append((shard, *key, first, strings, anchor, body))

                for r, hot in zip(chosen.tolist(), very.tolist(), strict=True):
                    i, first, n, h = int(runs.who[r]), int(runs.first[r]), int(runs.size[r]), int(runs.hash[r])
                    if hot:
                        for s in range(first, first + n):
                            body = found[i][s : s + length]
                            h = xxhash.xxh3_64_intdigest(body)
                            add(h % shards, keys[i], s, 1, h - (1 << 63), body)
                    else:
                        add((h >> 20) % shards, keys[i], first, n, h - (1 << 63), found[i][first : first + n + length - 1])
                if len(known) > RUNS_KNOWN:
                    known = {}
                if out:
                    columns = list(zip(*out, strict=True))
                    types = (pa.int32(), *[pa.int64()] * 5, pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                        names=["shard", "doc", "mark", "first", "strings", "anchor", "body"],
                    )

    return docs.mapInArrow(run, _CUT)


def copied(shard: pa.Table, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(doc, mark, start, end) of the copies in a shard, found in the order of all its suffixes."""
    plain = shard.filter(shard.column("body").is_null())
    for doc, mark, first, n in zip(*(plain.column(c).to_pylist() for c in ("doc", "mark", "first", "strings")), strict=True):
        yield doc, mark, first, first + n + length - 1
    shard = shard.filter(shard.column("body").is_valid()).drop_columns(["shard", "strings"])
    # Earlier documents and places come first, so the least position of a group is its earliest string.
    shard = shard.sort_by([("doc", "ascending"), ("mark", "ascending"), ("first", "ascending")])
    known, held = {}, []
    for row in zip(*(shard.column(c).to_pylist() for c in ("doc", "mark", "first", "anchor", "body")), strict=True):
        earliest = known.setdefault(row[4], row)
        if earliest is row:
            held.append(row)
        elif earliest[:3] != row[:3]:  # a document in several rows gives the same run once for each
            yield *row[:3], row[2] + len(row[4])
    # Strings with different anchors differ, so a run that is alone with its anchor has no copies left.
    runs_at = Counter(row[3] for row in held)
    held = [row for row in held if runs_at[row[3]] > 1]
    if not held:
        return
    doc, mark, first = (np.array([row[i] for row in held]) for i in range(3))
    bodies = [row[4] for row in held]
    del known, held, runs_at
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) + 1
    starts = np.cumsum(sizes) - sizes
    text = np.zeros(int(sizes.sum()), np.uint16)
    inside = np.ones(len(text), bool)
    inside[starts + sizes - 1] = False
    text[inside] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint16) + np.uint16(1)
    del bodies
    pos, shared = suffix_order(text)
    group = np.cumsum(shared < length)
    close = np.flatnonzero(np.r_[False, shared[1:] >= length] | np.r_[shared[1:] >= length, False])
    pos, group = pos[close], group[close]
    if not len(pos):
        return
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    earliest = np.repeat(np.minimum.reduceat(pos, begin), np.diff(np.r_[begin, len(pos)]))
    later = np.sort(pos[pos > earliest])
    segment = np.searchsorted(starts, later, side="right") - 1
    cut = np.flatnonzero(np.r_[True, (np.diff(later) != 1) | (np.diff(segment) != 0)])
    last = np.r_[cut[1:], len(later)] - 1
    for a, b in zip(cut.tolist(), last.tolist(), strict=True):
        s = segment[a]
        at = int(first[s] - starts[s])
        yield int(doc[s]), int(mark[s]), int(later[a]) + at, int(later[b]) + at + length


def repeated_spans(docs: DataFrame, text: str, length: int) -> DataFrame:
    """(doc, mark, spans): for documents that lose bytes, packed starts and ends, which may overlap."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // BUCKET_BYTES)
    shards = max(LEAST_SHARDS, total // SHARD_BYTES)
    # Fewer than 2^20 anchors can be that common, as there is one for each 20 bytes at most on average.
    found = written(repeated_anchors(docs, text, length, buckets, max(COMMON, total // 20 >> 20)), "repeated-anchors")
    hot = [np.frombuffer(r.common, np.uint64) for r in found.where("common IS NOT NULL").select("common").collect()]
    marked = found.where("doc IS NOT NULL").groupBy("doc", "mark").agg(F.collect_list("runs").alias("_runs"))
    joined = docs.join(marked, (F.col("_doc") == F.col("doc")) & (F.col("_mark") == F.col("mark"))).drop("doc", "mark")

    def spans(key, shard):
        known: dict[tuple[int, int], list[int]] = {}
        for doc, mark, start, end in copied(shard, length):
            known.setdefault((doc, mark), []).extend((start, end))
        return pa.table(
            [
                pa.array([d for d, _ in known], pa.int64()),
                pa.array([m for _, m in known], pa.int64()),
                pa.array([np.array(s, np.int64).tobytes() for s in known.values()], pa.binary()),
            ],
            names=["doc", "mark", "spans"],
        )

    common = np.concatenate([np.zeros(0, np.uint64), *hot])
    cut = cut_runs(joined, text, length, shards, common).groupBy("shard").applyInArrow(spans, _SPANS)
    return written(cut.groupBy("doc", "mark").agg(F.collect_list("spans").alias("spans")), "repeated-spans")


def merged_spans(packed: list[bytes] | None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; spans that touch are one."""
    if not packed:
        return []
    pairs = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.flatnonzero(np.r_[True, pairs[1:, 0] > reach[:-1]])
    return list(zip(pairs[new, 0].tolist(), reach[np.r_[new[1:], len(pairs)] - 1].tolist(), strict=True))


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """``docs`` with n_bytes, n_removed, removed (start and end of each run of bytes) and kept, the bytes that stay.

    ``kept`` is binary, as a string of bytes may begin or end within a character.
    """
    added = {
        "n_bytes": T.LongType(), "n_removed": T.LongType(),
        "removed": T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
        "kept": T.BinaryType(),
    }
    doc, mark = F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)), F.xxhash64(F.coalesce(text, F.lit("")))
    named = docs.select(text, doc.alias("_doc"), mark.alias("_mark"))
    spans = repeated_spans(named.where(F.octet_length(text) >= length), text, length)
    rest = [c for c in docs.columns if c not in added and c != text]
    # The caller's columns travel in one struct, so that none of their names can clash.
    held = docs.select(F.struct(*rest).alias("_row") if rest else F.lit(0).alias("_row"), F.col(text).alias("_text"), doc.alias("_doc"), mark.alias("_mark"))
    joined = held.join(spans, (F.col("_doc") == F.col("doc")) & (F.col("_mark") == F.col("mark")), "left").select(
        "_row", "_text", "spans"
    )

    def make():
        def work(piece):
            sizes, gone, runs, kept = [], [], [], []
            for t, packed in zip(piece.column("_text").to_pylist(), piece.column("spans").to_pylist(), strict=True):
                data = (t or "").encode()
                cuts = merged_spans(packed)
                sizes.append(len(data))
                gone.append(sum(b - a for a, b in cuts))
                runs.append([{"start": a, "end": b} for a, b in cuts])
                edges = [0, *(x for c in cuts for x in c), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if cuts else data)
            kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "kept": pa.binary()}
            kinds["removed"] = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            values = {"n_bytes": sizes, "n_removed": gone, "removed": runs, "kept": kept}
            return with_columns(
                piece.drop_columns(["spans"]), **{n: pa.array(values[n], kinds[n]) for n in added}
            )

        return work

    done = map_pieces(joined, "_text", fields_and(joined.drop("spans").schema, **added), make)
    out = [c for c in docs.columns if c not in added]
    return done.select(*(F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in out), *added)
