"""Mixing against water-filling by hand, with hot, empty and null sources."""

import random

import pytest

from brute import words
from touchline.llm import mixing as M


def by_hand(sizes):
    """Targets by resharing until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: M.WEIGHTS[k % 3] for k, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    sources = ["hot"] * 10 + ["a", "B", "é", "zz", None, "tiny", "none"]
    found = [(i, " ".join(["w"] * rng.randrange(0, 80)) if s != "none" else " ", s) for i in range(1500) for s in [rng.choice(sources)]]
    return found + [(5000, "long " * 20_000, "a"), (5001, None, "a"), (5002, "x y", "hot"), (5002, "x y", "hot"), (None, "q r s", "hot")]


def test_targets_and_takes(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "a long, b string, c string, d int").toDF("doc_id", "text", "source", "SOURCE")
    got = M.mix(df).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len(words(t))) for i, t, _ in rows)
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + len(words(t))
    want = by_hand(total)
    taken, largest = {}, {}
    for r in got:
        s = r["source"]
        assert r["source_size"] == total[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] = taken.get(s, 0) + r["taken"]
        largest[s] = max(largest.get(s, 0), r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in total)
    assert sum(want.values()) == pytest.approx(1.5 * sum(total.values()))
    assert {(r["doc_id"], r["taken"]) for r in M.mix(df.repartition(7)).collect()} == {(r["doc_id"], r["taken"]) for r in got}
    repeated = M.repeated(df)
    assert repeated.columns == df.columns
    assert repeated.count() == sum(r["copies"] for r in got)


def test_few_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(df).count() == 0 and M.repeated(df).count() == 0
    one = spark.createDataFrame([(1, "a b", None)], df.schema)
    assert [(r["target"], r["taken"]) for r in M.mix(one).collect()] == [(3.0, 4)] or [r["taken"] for r in M.mix(one).collect()] == [2]
