"""Substring dedup against every window of the corpus in a dictionary."""

import hashlib
import random

import pytest

from brute import words
from touchline.llm import substring_dedup as D

SF = "/root/testdata/sf0.01"


def brute(rows, n=20):
    """rows: (doc_id, text), doc_ids distinct."""
    seen, out = {}, {}
    split = {i: words(t) for i, t in rows}
    for i in sorted(split, key=lambda i: (i is not None, i or 0)):
        w, gone = split[i], set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in seen:
                gone.update(range(k, k + n))
            seen.setdefault(tuple(w[k : k + n]), i)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def run(df, **options):
    return sorted(((r["doc_id"], (r["n_words"], r["n_removed"], r["kept_sha256"])) for r in D.remove_repeats(df, **options).collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in D.op1_substring_dedup(spark, SF).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 0


@pytest.mark.parametrize("seed", range(3))
def test_few_words(spark, seed):
    """Texts of very few different words: periodic, nested and shifted repeats, ties of anchors."""
    rng = random.Random(seed)
    base = [rng.choice("ab") for _ in range(300)]
    rows = []
    for i in range(60):
        s = rng.randrange(250)
        body = base[s : s + rng.randrange(60)] + [rng.choice("abc") for _ in range(rng.randrange(30))] + base[:rng.randrange(40)]
        rows.append((i * 7, rng.choice([" ", "\n", " \t"]).join(body)))
    rows += [(1000, "a " * 200), (1001, "a b " * 50), (1002, None), (1003, ""), (1004, "a " * 19)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(df) == sorted(brute(rows).items(), key=str)
    assert run(df, window=8) == sorted(brute(rows, 8).items(), key=str)


def test_odd_rows(spark):
    p = " ".join(f"w{i}" for i in range(30))
    rows = [(5, p), (5, p), (None, p + " x"), (7, p), (8, "é" * 10), (9, f"{p} {p}"), (10, " ".join(f"w{i % 977}" for i in range(60_000)))]
    df = spark.createDataFrame([(*r, "t") for r in rows], "a long, b string, c string").toDF("doc_id", "text", "TEXT")
    want = brute(list(dict(rows).items()))
    assert run(df) == sorted([(i, want[i]) for i, _ in rows], key=str)
    assert want[None][1] == 0 and want[5][1] == 30
    assert run(df.limit(0)) == []
    assert [r["text"] for r in D.remove_repeats(df).where("doc_id = 9").collect()] == [""]
