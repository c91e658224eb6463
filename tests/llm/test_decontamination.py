"""Containment against plain sets; SQL twins; the pipeline."""

import duckdb
import pytest

from brute import words
from touchline.llm import decontamination as D
from touchline.llm import queries

SF = "/root/testdata/sf0.01"


def sets(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_contained(spark):
    w = [f"t{i}" for i in range(400)]
    items = [(1, " ".join(w[:40])), (2, " ".join(w[100:400])), (3, "a b c"), (4, None), (5, " "), (6, " ".join(w[:40])), (None, "u v w x y z")]
    docs = [(1, "x " * 3000 + " ".join(w[:40]).upper() + " y" * 3000), (2, " ".join(w[:20] + ["gap"] + w[20:40])), (3, " ".join(w[:24] + ["z"] + w[30:40])), (4, "A  b\nc"), (5, "a b c d"),
            (6, None), (7, ""), (8, " ".join(w[100:340])), (9, " ".join(w[100:330])), (9, " ".join(w[325:400])), (10, " ".join(w[150:400:2])), (11, " ".join(w)), (11, " ".join(w)), (12, "q u v w x y z")]
    df = spark.createDataFrame([(*d, "t") for d in docs], "a long, b string, c string").toDF("doc_id", "text", "Text")
    text_of = {}
    for i, t in docs:
        text_of.setdefault(i, []).append(t)
    want = set()
    for i, ts in text_of.items():
        held = set().union(*map(sets, ts))
        for k, t in items:
            s = sets(t)
            if s and len(s & held) >= 0.8 * len(s) - 1e-9:
                want.add((i, k, len(s), len(s & held)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in D.contained(df, bench).collect()} == want
    assert len(want) >= 8
    clean = D.without_leaks(df, bench)
    assert clean.columns == df.columns and {r[0] for r in clean.collect()} == set(text_of) - {x[0] for x in want}
    assert D.contained(df.limit(0), bench).count() == 0 and D.contained(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.ORACLES[name]).df()[list(got.columns)]
    order = list(got.columns)
    assert len(got) and got.sort_values(order).reset_index(drop=True).astype(str).equals(want.sort_values(order).reset_index(drop=True).astype(str))


def test_pipeline(spark):
    import corpus_pipeline as C
    from touchline.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality", "near copies", "benchmark", "mixture", "tokens"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for k, (_, stage) in enumerate(C.STAGES):
        before = docs.count()
        after = stage(spark, docs, SF)
        if k < 4:
            assert after.dtypes == docs.dtypes
        path = f"{C.written(after, 'stage').inputFiles()[0].rsplit('/', 1)[0]}"
        after = spark.read.parquet(path)
        if k == 0:
            kept = {r["doc_id"] for r in after.collect()}
            good = [i in kept for i, q in labels.items() if q == 1]
            assert sum(good) > 0.98 * len(good) and sum(i in kept for i, q in labels.items() if q == 0) < 0.1 * len(labels)
        if k == 1:
            from test_near_dedup import brute
            want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 5)
            assert {r["doc_id"] for r in after.collect()} == {i for i, v in want.items() if v[2]}
        if k == 2:
            bench = [sets(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            clean = {r["doc_id"] for r in docs.collect() if not any(len(b & sets(r["text"])) >= 0.8 * len(b) - 1e-9 for b in bench)}
            assert {r["doc_id"] for r in after.collect()} == clean and len(clean) < before
        if k == 3:
            times = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
            assert after.count() == sum(times.values())
        if k == 4:
            assert after.count() == before
        docs = after
