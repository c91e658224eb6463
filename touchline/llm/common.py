"""What the operators of this subpackage share: input columns, words, hashes, packed keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of all contracts: space and the control characters 9 to 13.
SPACE = "\\x20\\x09-\\x0D"
_TRIM = " \t\n\u000b\u000c\r"
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """The named columns only, found by their exact name, first one first: further
    columns, also such that differ in case or come twice, do not disturb."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[plain[f"c{df.columns.index(old)}"].alias(new) for new, old in wanted.items()])


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str) -> DataFrame:
    """doc_id (long), text (null becomes empty) and further columns by exact name."""
    df = pick(docs, doc_id=id_col, text=text_col, **more)
    return df.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))})


def same(left: DataFrame, right: DataFrame, key: list[str]) -> Column:
    """Equality of the columns ``key`` of ``left`` with the columns of ``right``, one after the other; null equals null."""
    return reduce(Column.__and__, [left[a].eqNullSafe(right[b]) for a, b in zip(key, right.columns)])


def bounded_sample(df: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """About ``most`` rows by a hash of their id, all if there are no more, and never over twice as many. Only those rows move.
    Rows without an id go by a hash of all they hold, so that they are not all in or all out."""
    n = df.count()
    if n > most:
        key = F.when(F.col(id_col).isNull(), F.xxhash64(*df.columns)).otherwise(F.xxhash64(F.col(id_col)))
        df = df.where(F.pmod(key, F.lit(2**30)) < int(2**30 * most / n))
    return df.limit(2 * most)


def n_words(text: Column) -> Column:
    """Number of words, on the JVM."""
    inner = F.trim(text, F.lit(_TRIM))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, f"[{SPACE}]+"))).cast("long")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def blocks(batches: Iterator[pa.RecordBatch], column: str | int = "text", limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows whose values in ``column`` add up to about
    ``limit`` bytes; a longer single row is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data = batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column))
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(data), 0), np.int64))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def as_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def as_ids(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    """Ids as int64; null becomes the least long, so that it sorts first."""
    return np.asarray(batch.column(batch.schema.get_field_index(column)).fill_null(NULL_ID), dtype=np.int64)


NULL_ID = -(2**63)


def out(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


# --- words and their hashes -------------------------------------------------


def words_of(data: bytes) -> list[bytes]:
    """bytes.split() cuts at exactly the separators in SPACE."""
    return data.split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _C1
    x = (x ^ (x >> _S)) * _C2
    return x ^ (x >> _S)


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def batch_words(data: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, hashes of all words in a row, and where each text starts in them."""
    words = [words_of(x) for x in data]
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(x) for x in words], out=starts[1:])
    return words, np.concatenate([hashed(x) for x in words]) if words else np.zeros(0, np.uint64), starts


def batch_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As batch_words, without keeping the words."""
    found = [hashed(words_of(x)) for x in data]
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(x) for x in found], out=starts[1:])
    return np.concatenate(found) if found else np.zeros(0, np.uint64), starts


_FACTOR = 0x9E3779B97F4A7C15


def joined(left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Window hashes from the hashes of a left part and of a right part of ``length`` words."""
    return left * np.uint64(pow(_FACTOR, length, 2**64)) + right


def windows(h: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every window of ``length`` words, by doubling. Not mixed."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    got, size, level, span = None, 0, h, 1
    while True:
        if length & span:
            if got is None:
                got, size = level, span
            else:  # the part so far, then a window of this level behind it
                m = len(level) - size
                got, size = joined(got[:m], level[size:], span), size + span
        span *= 2
        if span > length:
            return got[: len(h) - length + 1]
        level = joined(level[: len(level) - span // 2], level[span // 2 :], span // 2)


def owner_of(starts: np.ndarray) -> np.ndarray:
    """For each word, the row of its text."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def first_of_run(*keys: np.ndarray) -> np.ndarray:
    """Mask of the rows of sorted key columns that start a new key."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


# --- rows packed by key ------------------------------------------------------


def packed(schema: pa.Schema, key: np.ndarray, buckets: int, arrays: list[np.ndarray]) -> pa.RecordBatch | None:
    """One row (bucket, bytes of each array) for each bucket of ``key`` that has rows."""
    if not len(key):
        return None
    bucket = (key % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(first_of_run(bucket))
    ends = np.append(cuts[1:], len(bucket))
    columns = [[a[s:e].tobytes() for s, e in zip(cuts, ends)] for a in (x[order] for x in arrays)]
    return out(schema, bucket[cuts], *columns)


def unpacked(batches: Iterable[pa.RecordBatch], names: list[str], types: list) -> list[np.ndarray]:
    """All rows of a partition as arrays."""
    found: list[list[bytes]] = [[] for _ in names]
    for batch in batches:
        for k, name in enumerate(names):
            found[k].extend(batch.column(batch.schema.get_field_index(name)).to_pylist())
    return [np.frombuffer(b"".join(x), t) for x, t in zip(found, types)]


#: Buckets for each shuffle partition: enough that the partitions get about as many.
BUCKETS_EACH = 16
