import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import hard_negatives
from touchline.llm.hard_negatives import SortedLists, first, integer_rows, kth, mined, op12_hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>"


def _brute(rows, anchor=lambda i: i % 50 == 0, positives=5, negatives=3):
    """rows: (id, label, vector)."""
    good = [(i, b, [math.floor(256 * c) for c in v]) for i, b, v in rows
            if b is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    got = []
    for k, (i, b, v) in enumerate(good):
        if i is None or not anchor(i):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), math.inf if j is None else j, j, c) for n, (j, c, w) in enumerate(good) if n != k), key=lambda x: x[:2])
        for s, _, p, _ in [x for x in scored if x[3] == b][:positives]:
            window = [x for x in scored if x[3] != b and 50 * -s <= 100 * -x[0] <= 95 * -s]
            got += [(i, p, r + 1, x[2], -s, -x[0]) for r, x in enumerate(window[:negatives])]
    return sorted(got, key=str)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _mine(spark, rows, **more):
    return _rows(mined(integer_rows(spark.createDataFrame(rows, SCHEMA)), F.col("id") % 50 == 0, **more))


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = _brute(rows)
    assert len(want) > 100 and _rows(op12_hard_negatives(spark, sf)) == want


@pytest.mark.parametrize("seed", range(3))
def test_ties_and_few_dimensions(spark, seed, monkeypatch):
    """Small integers give many ties; several shards and blocks; the searches end early."""
    monkeypatch.setattr(hard_negatives, "SHARD", 60)
    monkeypatch.setattr(hard_negatives, "BLOCK", 2)
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(0, 3)), (rng.integers(-3, 6, 3) / 256).tolist()) for i in rng.permutation(300)]
    assert _mine(spark, rows) == _brute(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, i % 2, rng.standard_normal(4).tolist()) for i in range(101)]
    rows += [(None, 0, [1.0, 1.0, 1.0, 1.0]), (None, 1, [0.9, 0.8, 1.0, 0.7]), (200, None, [1.0] * 4), (250, 1, None), (300, 1, [1.0, None, 1.0, 1.0]),
             (350, 1, [float("nan")] * 4), (400, 0, [float("inf")] * 4), (450, 0, []), (500, 1, [0.0] * 4), (550, 0, [1.0, 0.5])]
    rows += [rows[50], rows[100], rows[3]]  # rows that come twice
    assert _mine(spark, rows) == _brute(rows)
    large = [(i, b, None if v is None else [None if c is None else c * 2.0**16 for c in v]) for i, b, v in rows]
    assert _mine(spark, large) == _brute(large)  # beyond the whole numbers of doubles
    with pytest.raises(OverflowError):
        _mine(spark, [(0, 1, [1e9]), (1, 1, [1e9])])


def test_one_vector_for_a_third(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 5, [0.5, -0.25] if i % 3 == 0 else rng.standard_normal(2).tolist()) for i in range(400)]
    assert _mine(spark, rows) == _brute(rows)


def test_nothing_to_mine(spark):
    empty = mined(integer_rows(spark.createDataFrame([], SCHEMA)), F.col("id") % 50 == 0)
    assert empty.count() == 0 and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert _mine(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []  # no anchors
    assert _mine(spark, [(0, 1, [1.0]), (2, 2, [1.0])]) == []  # no positives
    named = spark.createDataFrame([(0, 1, [1.0], "x"), (1, 1, [1.0], "y"), (2, 2, [0.75], "z")], "vec_id long, label int, embedding array<double>, LABEL string")
    assert _rows(mined(integer_rows(named), F.col("id") % 50 == 0)) == [(0, 1, 1, 2, 65536, 49152)]


def test_search_ends_early():
    """One dimension: the threshold falls below the third score after a few rows."""
    lists = SortedLists(np.arange(1000.0)[:, None])
    seen = []
    rows, score = lists.search(np.array([2.0]), lists.thresholds(np.array([[2.0]]))[0], 1998.5, lambda at, s, t: seen.append(len(at)) or t < kth(s, 3))
    assert len(rows) < 10 and list(rows[first(score, rows, 3)]) == [999, 998, 997]
