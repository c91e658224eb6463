"""Rows without an id and rows that repeat one, in op5 and in two stages of the pipeline."""

import duckdb
import pytest

from touchline.llm import decontamination as D
from touchline.llm import near_dedup as N


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t") for r in rows], "a long, b string, c string").toDF("doc_id", "text", "Text")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(40))), (None, "u v w x y z")], "item_id long, text string")


ITEM = " ".join(f"t{i}" for i in range(40))
DOCS = [(None, "a " * 30 + ITEM), (None, "sound text without an id"), (1, ITEM), (2, "sound"), (3, "q u v w x y z"), (3, "another row of that id"), (None, None)]


def test_contained_as_the_twin(spark, bench):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", DOCS)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [tuple(r) for r in bench.collect()])
    got = D.contained(frame(spark, DOCS), bench).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(D.SQL).fetchall()))
    assert (None, 1) in {(r["doc_id"], r["item_id"]) for r in got}


def test_benchmark_stage(spark, bench):
    clean = D.without_leaks(frame(spark, DOCS), bench)
    assert clean.columns == ["doc_id", "text", "Text"]
    assert sorted(map(str, ((r[0], r[1]) for r in clean.collect()))) == sorted(map(str, [DOCS[1], DOCS[3], DOCS[6]]))


def test_near_copies_stage(spark):
    """One row of each group: null ids, one id with equal rows, one id with other texts, a chain through a null id."""
    long, other, third = (" ".join(f"{k}{i}" for i in range(100)) for k in "xyz")
    rows = [(None, long), (None, long), (None, long + " more"), (None, other), (5, long), (6, other + " end"), (7, third), (7, third), (7, "quite another text of that id"), (8, third + " end"), (None, None), (None, "")]
    kept = N.first_of_each(frame(spark, rows), 5)
    got = [(r[0], r[1]) for r in kept.collect()]
    groups = [lambda t: (t or "").startswith(long[:20]), lambda t: (t or "").startswith(other[:20]), lambda t: (t or "").startswith(third[:20])]
    assert kept.columns == ["doc_id", "text", "Text"]
    assert [[i for i, t in got if g(t)] for g in groups] == [[None], [None], [7]]
    assert len(got) == 6 and (7, "quite another text of that id") in got and (None, None) in got and (None, "") in got
