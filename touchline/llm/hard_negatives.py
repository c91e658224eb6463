"""Hard negatives by Fagin's threshold algorithm.

Vectors become integers floor(256 * c); a score is an integer inner product. All rows are written once and dealt into shards by
a hash of their row key; the anchors go to every shard in blocks, so a task holds one shard of at most ``SHARD`` rows and one
block of about ``BLOCK`` anchors whatever the table's size. In a shard each dimension has its rows sorted by that component. For an anchor the
lists are read from the end that its sign favours, all to the same depth; rows met there are scored in full by random access;
the threshold, the score of a row that stood at the present depth of every list, bounds all rows not met. A search ends when the
threshold is strictly below the k-th score of each of its windows (a tie could still win by its id), or below the window. It
begins at the first depth at which that is possible at all. First each shard gives its best rows of the anchor's label and the
best of all shards are the positives; then the same with other labels inside each positive's window.

Dense vectors of many dimensions let a threshold fall late: with 64 dimensions most rows of a shard are met before it does.

Defined cases: rows with a null label, a null or empty vector or one with null or non-finite entries take no part; a null id is no
anchor's and comes last among equal scores; repeated rows are rows of their own, so a copy of an anchor is an other row of
its label and anchors that come twice have their results twice; of vectors of different lengths the shorter counts as filled
up with zeros; an empty table, no anchors, no positives or no row in a window give no rows. Scores beyond 64 bits are an error."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import out, partitions, pick, table
from touchline.session import written

SCALE = 256
SHARD = 65_536
BLOCK = 8_192
#: Shards are not made smaller than this to use more tasks.
LEAST_SHARD = 1_024


class SortedLists:
    """Rows of x (float or long, exact either way) and for each dimension their order."""

    def __init__(self, x: np.ndarray):
        self.x, self.m = x, len(x)
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))
        values = np.take_along_axis(x.T, self.order, 1)
        depth, depths = 1, []
        while depth < self.m:
            depths.append(depth)
            depth += max(1, depth // 2)
        self.depths = np.array(depths + [self.m])
        self._top, self._bottom = values[:, self.m - self.depths], values[:, self.depths - 1]
        self.longest = float(np.sqrt((x.astype(float) ** 2).sum(1).max()))

    def thresholds(self, anchors: np.ndarray) -> np.ndarray:
        """For each anchor, the most that a row not met can score, at each depth; never rising."""
        return np.maximum(anchors, 0) @ self._top + np.minimum(anchors, 0) @ self._bottom

    def search(self, a: np.ndarray, falls: np.ndarray, below: float, settled: Callable[[np.ndarray, np.ndarray, float], bool]) -> tuple[np.ndarray, np.ndarray]:
        """Rows met and their scores. ``falls``: thresholds of the anchor; none of them from ``below`` up can end the search."""
        last = len(self.depths) - 1
        met, score = np.zeros(self.m, bool), np.zeros(self.m, self.x.dtype)
        up, down, before = np.flatnonzero(a > 0), np.flatnonzero(a < 0), 0
        for k in range(min(int(np.searchsorted(-falls, -below, "right")), last), last + 1):
            depth, new = self.depths[k], np.zeros(self.m, bool)
            new[self.order[up, self.m - depth : self.m - before]] = True
            new[self.order[down, before:depth]] = True
            if k == last:  # also where no component is other than zero
                new[:] = True
            new &= ~met
            fresh = np.flatnonzero(new)
            score[fresh] = self.x[fresh] @ a if 4 * len(fresh) < self.m else (self.x @ a)[fresh]
            met |= new
            rows = np.flatnonzero(met)
            if k == last or settled(rows, score[rows], falls[k]):
                return rows, score[rows]
            before = depth
        raise AssertionError("the last depth ends every search")


def kth(score: np.ndarray, k: int) -> float:
    """The k-th highest, less than any number if there are fewer."""
    return np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -math.inf


def first(score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by key."""
    near = np.flatnonzero(score >= kth(score, k))
    return near[np.lexsort((key[near], -score[near]))[:k]]


# --- what a task does with a shard and a block of anchors ----------------------------

_FOUND = "anchor long, slot int, row long, id long, score long"
_SCHEMA = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _column(t: pa.Table, name: str) -> np.ndarray:
    return np.asarray(t.column(name).fill_null(2**63 - 1).to_numpy(), np.int64)


def _vectors(t: pa.Table, dims: int, kind: type) -> np.ndarray:
    got = np.zeros((t.num_rows, dims), kind)
    for k, row in enumerate(t.column("x").to_pylist()):
        v = np.frombuffer(row, "<i8")
        got[k, : len(v)] = v
    return got


def _gathered(found: list[tuple], rows: pa.Table) -> pa.Table:
    if not found:
        return _SCHEMA.empty_table()
    anchor, slot, at, score = (np.concatenate([np.broadcast_to(x[k], len(x[2])) for x in found]) for k in range(4))
    return pa.Table.from_batches([out(_SCHEMA, anchor, slot.astype(np.int32), rows.column("row").combine_chunks().take(pa.array(at)), rows.column("id").combine_chunks().take(pa.array(at)), score.astype(np.int64))])


def _same_label(dims: int, kind: type, k: int):
    """The k best other rows of each anchor's label in the shard."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _SCHEMA.empty_table()
        labels, ids, own = (_column(rows, n) for n in ("label", "id", "row"))
        x, a, wanted, of = _vectors(rows, dims, kind), _vectors(anchors, dims, kind), _column(anchors, "label"), _column(anchors, "row")
        found = []
        for label in np.unique(wanted):
            part, asking = np.flatnonzero(labels == label), np.flatnonzero(wanted == label)
            if not len(part):
                continue
            lists = SortedLists(x[part])
            falls = lists.thresholds(a[asking])
            for fall, one in zip(falls, asking):
                others = own[part] != of[one]
                best = 1 + lists.longest * float(np.linalg.norm(a[one].astype(float))) * (1 + 1e-9)
                at, score = lists.search(a[one], fall, best, lambda at, s, t: t < kth(s[others[at]], k))
                at, score = at[others[at]], score[others[at]]
                pick_ = first(score, ids[part[at]], k)
                found.append((of[one], 0, part[at[pick_]], score[pick_]))
        return _gathered(found, rows)

    return run


def _in_windows(dims: int, kind: type, k: int, low: int, high: int):
    """The k best rows of other labels in the shard for each positive of each anchor: low to high per cent of its score."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _SCHEMA.empty_table()
        labels, ids = _column(rows, "label"), _column(rows, "id")
        x, a, own, of = _vectors(rows, dims, kind), _vectors(anchors, dims, kind), _column(anchors, "label"), _column(anchors, "row")
        lists = SortedLists(x)
        falls, found = lists.thresholds(a), []
        for one, targets in enumerate(anchors.column("targets").to_pylist()):
            windows = [(slot, s) for slot, s in enumerate(targets) if low * s <= high * s]
            if not windows:
                continue
            others = labels != own[one]
            inside = lambda s, p: (100 * s >= low * p) & (100 * s <= high * p)

            def settled(at: np.ndarray, score: np.ndarray, t: float) -> bool:
                score = score[others[at]]
                return all(100 * t < low * p or t < kth(score[inside(score, p)], k) for _, p in windows)

            at, score = lists.search(a[one], falls[one], min(p for _, p in windows) * max(low, high) / 100 + 1e-6, settled)
            at, score = at[others[at]], score[others[at]]
            for slot, p in windows:
                near = np.flatnonzero(inside(score, p))
                pick_ = near[first(score[near], ids[at[near]], k)]
                found.append((of[one], slot, at[pick_], score[pick_]))
        return _gathered(found, rows)

    return run


# --- the jobs -----------------------------------------------------------------------------


def integer_rows(rows: DataFrame, label: Callable[[Column, Column], Column] | None = None, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(row, id, label, x) of the rows that take part, written once; ``label`` maps (id, label) to the label that counts."""
    v = F.col("v")
    got = pick(rows, id=id_col, label=label_col, v=vector_col).withColumn("v", v.cast("array<double>")).where("label IS NOT NULL AND size(v) > 0")
    whole = got.where(~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    whole = whole.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform(v, lambda c: F.floor(c * SCALE)).alias("x"))
    if label:
        whole = whole.withColumn("label", label(F.col("id"), F.col("label")).cast("long"))
    return written(whole.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")


_PACKED = "row long, id long, label long, x binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("x", pa.binary())])
    for b in batches:
        flat, cuts = np.asarray(b.column(3).flatten(), "<i8"), np.asarray(b.column(3).offsets)
        cuts = cuts - cuts[0] if len(cuts) else cuts
        yield out(schema, b.column(0), b.column(1), b.column(2), [flat[s:e].tobytes() for s, e in zip(cuts, cuts[1:])])


def mined(rows: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for integer_rows; ``is_anchor`` is over id and label."""
    spark = rows.sparkSession
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims"), F.greatest(F.max(F.abs(F.array_max("x"))), F.max(F.abs(F.array_min("x")))).alias("most"),
                    F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not size["n"] or not size["anchors"]:
        return spark.createDataFrame([], schema)
    reach = 100 * size["dims"] * size["most"] ** 2
    if reach >= 2**63:
        raise OverflowError("scores beyond 64 bits")
    kind = np.float64 if reach < 2**53 else np.int64
    n_shards = max(math.ceil(size["n"] / SHARD), min(partitions(rows), math.ceil(size["n"] / LEAST_SHARD)))
    n_blocks = math.ceil(size["anchors"] / BLOCK)
    packed = rows.select("row", "id", "label", "x").mapInArrow(_packed, _PACKED)
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shards = packed.withColumn("shard", dealt(n_shards)).withColumn("block", each(n_blocks))
    anchors = packed.where(is_anchor).withColumn("block", dealt(n_blocks))

    def best(asking: DataFrame, fn, k: int) -> DataFrame:
        """What fn finds in every shard, then the k best for each anchor and slot."""
        sent = asking.withColumn("shard", each(n_shards))
        tasks = max(partitions(rows), min(n_shards * n_blocks, 20 * partitions(rows)))
        left, right = (df.repartition(tasks, "shard", "block").groupBy("shard", "block") for df in (shards, sent))
        found = left.cogroup(right).applyInArrow(fn, _FOUND)
        order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    pairs = written(best(anchors, _same_label(size["dims"], kind, positives), positives), "negatives-positives")
    targets = pairs.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("p"))
    asking = written(anchors.join(targets, F.col("row") == F.col("anchor")).select("row", F.col("id").alias("anchor_id"), "label", "x", "block", F.col("p.id").alias("positives"), F.col("p.score").alias("targets")), "negatives-asking")
    sent = asking.select("row", F.col("anchor_id").alias("id"), "label", "x", "block", "targets")
    found = best(sent, _in_windows(size["dims"], kind, negatives, low, high), negatives)
    got = found.join(asking.select(F.col("row").alias("anchor"), "anchor_id", "positives", "targets"), "anchor")
    return got.select("anchor_id", F.col("positives")[F.col("slot")].alias("positive_id"), "rank", F.col("id").alias("negative_id"),
                      F.col("targets")[F.col("slot")].alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Anchors: ids divisible by 50. Ids divisible by 7 carry the next of ten labels."""
    rows = integer_rows(table(spark, sf_dir, "embeddings"), lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label))
    return mined(rows, F.col("id") % 50 == 0)


#: Every score of every anchor: a plain statement of the same result.
SQL = """WITH e AS (SELECT vec_id id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
a AS (SELECT * FROM e WHERE id % 50 = 0),
s AS MATERIALIZED (SELECT a.id anchor_id, a.label anchor_label, e.id, e.label, list_dot_product(a.x, e.x)::BIGINT score FROM a JOIN e ON a.id <> e.id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) k FROM s WHERE label = anchor_label QUALIFY k <= 5),
n AS (SELECT p.anchor_id, p.id positive_id, s.id negative_id, p.score positive_score, s.score negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) k
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, k::INTEGER AS "rank", negative_id, positive_score, negative_score FROM n WHERE k <= 3"""
