"""Substring dedup by level-wise doubling: only windows repeated at one length are looked at at twice that length.

A document loses the words that stand in a window of ``WINDOW`` words whose words also start earlier: in a document of smaller id, or
earlier in the same one. Windows are compared on the input.

Level one, half the length. Every full window holds several half windows; the one of least hash is its anchor. Equal
windows have equal anchors, and neighbouring windows share theirs, so about a fifth as many anchors as words move,
and none is missed. An anchor moves with a hash of its whole stretch (all windows that chose it). Of equal
stretches all but the first lose all their windows at once. A window can then only be repeated further if its anchor stands
in several different stretches: where a repeat begins, ends or is edited.

Level two, the full length, for the first occurrence of those stretches only: their windows move by their own hash, and all
but the first of each are repeats. Longer windows cannot remove more, so the ladder ends there.

Each task first keeps only the least occurrence of what it has several times and reports the others as repeats, so a passage
in a third of all documents is one row a task when it moves. Hashes of windows have 60 + 64 or 128 bits.

Defined cases: null and empty texts, and texts shorter than a window, lose nothing; rows that repeat an id are the same
document: equal ones do not count as earlier than each other and lose the same words; a null id sorts first; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import (BUCKETS_EACH, NULL_ID, as_bytes, as_ids, batch_hashes, blocks, first_of_run, joined, mapped, mix, out, owner_of, packed,
                                  partitions, table, texts, unpacked, windows, words_of)
from touchline.session import written

WINDOW = 20
_LOW = np.uint64(15)
BLOCK_BYTES = 4_000_000

_PACKED = pa.schema([("bucket", pa.int32()), ("key", pa.binary()), ("stretch", pa.binary()), ("doc", pa.binary()), ("place", pa.binary()),
                     ("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("open", pa.bool_())])
PACKED = "bucket int, key binary, stretch binary, doc binary, place binary, doc_id long, start int, stop int, open boolean"
_RANGE = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("open", pa.bool_())])
RANGE = "doc_id long, start int, stop int, open boolean"


def _rolled(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Unmixed hashes of the half windows and of the full windows."""
    half = windows(h, length // 2)
    full = joined(half[: len(half) - length // 2], half[length // 2 :], length // 2) if len(h) >= length else half[:0]
    return half, full


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    size, level = 1, keys
    while size * 2 <= width:
        level = np.minimum(level[: len(level) - size], level[size:])
        size *= 2
    rest = width - size
    return np.minimum(level[: len(level) - rest], level[rest:]) if rest else level


def anchors(h: np.ndarray, starts: np.ndarray, length: int = WINDOW) -> tuple[np.ndarray, ...]:
    """For the words of several texts in a row: key, stretch hash, row of the text, first and last window (within the
    text) of every stretch, and whether its anchor comes again close by, so that its own windows may repeat each other.
    The key is the anchor's hash without its lowest four bits."""
    if len(h) < length:
        empty = np.zeros(0, np.uint64)
        return empty, empty, *(np.zeros(0, np.int64) for _ in range(4))
    own = owner_of(starts)
    half, full = _rolled(h, length)
    place = np.arange(len(half), dtype=np.uint64)
    # The place in the lowest bits tells which of the half windows was the least; their number is below 16.
    tagged = (mix(half) & ~_LOW) | (place & _LOW)
    width = length - length // 2 + 1
    low = _least(tagged, width)
    at = np.flatnonzero(own[: len(low)] == own[length - 1 :])  # windows within one text
    low, first = low[at], place[at]
    anchor = first + ((low - first) & _LOW)
    new = first_of_run(anchor, own[at])
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(at)) - 1 if len(begin) else begin
    lo, hi = at[begin], at[stop]
    key = low[begin] & ~_LOW
    offset = (anchor[begin] - first[begin]) * np.uint64(64) + (first[stop] - first[begin])
    stretch = mix(mix(full[lo]) * np.uint64(3) + mix(full[hi] + np.uint64(7)) + offset * np.uint64(0x9E3779B97F4A7C15))
    text, p = own[lo], anchor[begin].astype(np.int64)
    again = np.zeros(len(p), np.int64)
    for d in range(1, width):
        q = np.maximum(p - d, 0)
        again |= (half[q] == half[p]) & (own[q] == text) & (q < p)
    return key, stretch, text, lo - starts[text], hi - starts[text], again


def _ranges(schema: pa.Schema, doc: np.ndarray, start: np.ndarray, stop: np.ndarray, open_: np.ndarray, buckets: int = 1) -> pa.RecordBatch:
    """Rows of windows start..stop, merged where they meet; sorted by document and start, closed ones first."""
    order = np.lexsort((start, doc, open_))
    doc, start, stop, open_ = doc[order], start[order], stop[order], open_[order]
    new = first_of_run(doc, open_)
    new[1:] |= start[1:] > stop[:-1] + 1
    cuts = np.flatnonzero(new)
    ends = np.append(cuts[1:], len(doc)) - 1
    columns = {"doc_id": doc[cuts], "start": start[cuts].astype(np.int32), "stop": stop[ends].astype(np.int32), "open": open_[cuts],
               "bucket": (doc[cuts] % buckets).astype(np.int32)}
    return out(schema, *[columns[f.name] if f.name in columns else pa.nulls(len(cuts), f.type) for f in schema])


def _packed_rows(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
    if batch is not None:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.nulls(n, f.type) for f in list(_PACKED)[5:]]], schema=_PACKED)


_HEAD = pa.schema(list(_PACKED)[:5])


def _level_one(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=BLOCK_BYTES):
            h, starts = batch_hashes(as_bytes(batch))
            ids = as_ids(batch)
            key, stretch, text, lo, hi, again = anchors(h, starts, length)
            doc = ids[text]
            order = np.lexsort((lo, doc, stretch, key))
            same = ~first_of_run(key[order], stretch[order])
            # Not the first in this task: repeats in any case. Equal rows of one document are as early as the first.
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            tie = (doc[order] == doc[order[lead]]) & (lo[order] == lo[order[lead]]) if len(order) else same
            late, keep = order[same & ~tie], order[~same]
            if len(late):
                yield _ranges(_PACKED, doc[late], lo[late], hi[late], np.zeros(len(late), bool), buckets)
            place = lo[keep] * 32 + again[keep] * 16 + (hi - lo)[keep]
            yield from _packed_rows(packed(_HEAD, key[keep] >> np.uint64(4), buckets, [key[keep], stretch[keep], doc[keep], place]))

    return run


def _known(batches: Iterator[pa.RecordBatch], rest: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges that a task of the level has already told; packed rows go to ``rest``."""
    for batch in batches:
        told = batch.column(5).is_valid()
        if pc.any(told).as_py():
            yield pa.RecordBatch.from_arrays(batch.filter(told).columns[5:], schema=_RANGE)
        rest.append(batch.filter(pc.invert(told)))


def _level_one_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows, and open ranges: windows of first stretches whose anchor stands in others too."""
    rest: list[pa.RecordBatch] = []
    yield from _known(batches, rest)
    key, stretch, doc, place = unpacked(rest, ["key", "stretch", "doc", "place"], [np.uint64, np.uint64, np.int64, np.int64])
    if not len(key):
        return
    order = np.lexsort((place, doc, stretch, key))
    key, stretch, doc, place = key[order], stretch[order], doc[order], place[order]
    first = first_of_run(key, stretch)
    lead = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    head = first | (doc == doc[lead]) & (place == place[lead])
    group = np.cumsum(first_of_run(key)) - 1
    unsure = (np.bincount(group[first], minlength=group[-1] + 1)[group] > 1) | (place & 16 > 0)
    start, stop = place // 32, place // 32 + place % 16
    take = ~head | unsure & first
    if take.any():
        yield _ranges(_RANGE, doc[take], start[take], stop[take], (head & unsure)[take])


def _expand(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the ranges start..stop."""
    size = stop - start + 1
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def _level_two(length: int, buckets: int):
    """Hashes of the open windows of each document, by their own hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=BLOCK_BYTES):
            h, starts = batch_hashes(as_bytes(batch))
            _, full = _rolled(h, length)
            ids, spans = as_ids(batch), batch.column(2).to_pylist()
            text = np.repeat(np.arange(len(spans)), [len(s) for s in spans])
            lo, hi = (np.array([r[k] for s in spans for r in s], np.int64) for k in ("start", "stop"))
            if not len(lo):
                continue
            base = starts[text]
            at = _expand(base + lo, base + hi)
            own = np.repeat(text, hi - lo + 1)
            fits = (at >= starts[own]) & (at + length <= starts[own + 1])  # an id with several texts: where the range exists
            at, own = at[fits], own[fits]
            a, b = mix(full[at]), mix(full[at] ^ mix(h[at]) + np.uint64(1)) ^ mix(h[at + length - 1])
            doc, place = ids[own], at - starts[own]
            order = np.lexsort((place, doc, b, a))
            same = ~first_of_run(a[order], b[order])
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            tie = (doc[order] == doc[order[lead]]) & (place[order] == place[order[lead]])
            late, keep = order[same & ~tie], order[~same]
            if len(late):
                yield _ranges(_PACKED, doc[late], place[late], place[late], np.zeros(len(late), bool), buckets)
            yield from _packed_rows(packed(_HEAD, a[keep] >> np.uint64(4), buckets, [a[keep], b[keep], doc[keep], place[keep]]))

    return run


def _level_two_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest: list[pa.RecordBatch] = []
    yield from _known(batches, rest)
    a, b, doc, place = unpacked(rest, ["key", "stretch", "doc", "place"], [np.uint64, np.uint64, np.int64, np.int64])
    if not len(a):
        return
    order = np.lexsort((place, doc, b, a))
    a, b, doc, place = a[order], b[order], doc[order], place[order]
    first = first_of_run(a, b)
    lead = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
    take = ~(first | (doc == doc[lead]) & (place == place[lead]))
    if take.any():
        yield _ranges(_RANGE, doc[take], place[take], place[take], np.zeros(take.sum(), bool))


def _grouped(made: DataFrame, groups) -> DataFrame:
    """Ranges of a level: those told within its tasks, and those found over all rows of a bucket."""
    return mapped(made.repartition(partitions(made), "bucket"), groups, RANGE)


def _listed(ranges: DataFrame) -> DataFrame:
    """One row a document: its ranges. A document has at most as many as windows."""
    return ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()), ("kept_sha256", pa.string())])


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            ids, total, removed, kept, digest = as_ids(batch), [], [], [], []
            for data, spans in zip(as_bytes(batch), batch.column(2).to_pylist()):
                words = words_of(data)
                n = len(words)
                if spans:
                    cover = np.zeros(n + 1, np.int64)
                    for r in spans:
                        if r["stop"] + length <= n:
                            cover[r["start"]] += 1
                            cover[r["stop"] + length] -= 1
                    gone = np.cumsum(cover[:-1]) > 0
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                text = b" ".join(words)
                total.append(n), removed.append(n - len(words)), digest.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode() if with_text else None)
            yield out(_RESULT, pa.array(ids, mask=ids == NULL_ID), total, removed, kept, digest)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text, kept_sha256): each document without its repeated windows; ``text`` is the kept words
    joined by one space (null without ``with_text``). ``window``: even, at most 30."""
    if window % 2 or not 4 <= window <= 30:
        raise ValueError("window must be even, from 4 to 30")
    df = texts(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    buckets = partitions(df) * BUCKETS_EACH
    one = written(_grouped(mapped(df, _level_one(window, buckets), PACKED), _level_one_groups), "repeats")
    open_ = _listed(one.where("open")).withColumnRenamed("ranges", "spans")
    two = _grouped(mapped(df.join(open_, "doc_id").select("doc_id", "text", "spans"), _level_two(window, buckets), PACKED), _level_two_groups)
    found = _listed(one.where("NOT open").unionByName(two).select("doc_id", "start", "stop"))
    rows = df.join(found, "doc_id", "left").select("doc_id", "text", "ranges")
    return mapped(rows, _cut(window, with_text), "doc_id long, n_words long, n_removed long, text string, kept_sha256 string")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
