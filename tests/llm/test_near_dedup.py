"""Near-dedup against all pairs of sets."""

import random

import pytest

from brute import words
from touchline.llm import near_dedup as N

SF = "/root/testdata/sf0.01"


def shingles(text, size):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size):
    sets = {i: shingles(t, size) for i, t in rows}
    ids = sorted(sets, key=lambda i: -(2**63) if i is None else i)
    top = {i: i for i in ids}
    where = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    rank = {i: k for k, i in enumerate(ids)}
    for i in ids:
        near = {}
        for s in sets[i]:
            for j in where[s]:
                if rank[j] < rank[i]:
                    near[j] = near.get(j, 0) + 1
        for j, both in near.items():
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)), key=rank.get)
                top[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(df, size):
    return [(r["doc_id"], (r["n_shingles"], r["component_id"], r["kept"])) for r in N.near_duplicates(df, size).collect()]


@pytest.mark.parametrize("size", [2, 5])
def test_documents(spark, size):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert dict(got(docs, size)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], size)


def edited(rng, w, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else x for x in w]


@pytest.mark.parametrize("block", [256, 5])
def test_chains_and_crowds(spark, monkeypatch, block):
    """Copies, chains whose ends are far apart, a crowd around one text, and texts just below the bound; also in small blocks."""
    for name in ("MEMBERS", "QUERIES", "LOOKED"):
        monkeypatch.setattr(N, name, block)
    rng = random.Random(5)
    rows, n = [], 0
    for family in range(6):
        w = [f"f{family}x{rng.randrange(400)}" for _ in range(150)]
        for _ in range(rng.choice([3, 40])):
            rows.append((n, " ".join(edited(rng, w, rng.choice([0, 0.01, 0.03, 0.06, 0.12])))))
            n += 1
        for _ in range(12):  # a chain
            w = edited(rng, w, 0.03)
            rows.append((n, " ".join(w).upper() if n % 2 else " ".join(w)))
            n += 1
    rng.shuffle(rows)
    want = brute(rows, 2)
    assert dict(got(spark.createDataFrame(rows, "doc_id long, text string"), 2)) == want
    assert len({v[1] for v in want.values()}) > 6


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One  two"), (7, "One  two"), (None, "one two"), (9, "é one two"), (10, "w " * 50_000), (11, "W " * 40_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "a long, b string, c int").toDF("doc_id", "text", "DOC_ID")
    want = brute(list(dict(rows).items()), 2)
    assert sorted(got(df, 2), key=str) == sorted([(i, want[i]) for i, _ in rows], key=str)
    assert got(df.limit(0), 2) == []
    kept = N.first_of_each(df, 2)
    assert kept.columns == df.columns
    assert sorted(str(r[0]) for r in kept.collect()) == ["1", "10", "2", "3", "4", "9", "None"]


def test_ids_with_several_texts(spark):
    """Each row is linked by its own text: 2 to the first text of id 1, 3 to its second; and to rows without an id."""
    rng = random.Random(3)
    a, b, c = ([f"{k}{rng.randrange(10**6)}" for _ in range(80)] for k in "abc")
    near = lambda w: " ".join([*w[:-2], "x", "y"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (None, " ".join(c)), (None, "alone here"), (9, near(c)), (5, "quite another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in N.near_duplicates(df, 2).collect()), key=str)
    assert found == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, None, True), (None, None, True), (9, None, False), (5, 5, True)], key=str)


def test_keys_of_close_signatures():
    """All signatures that differ in fewer than 2 * CHUNKS values share a key."""
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**16, (300, N.SIGNATURE), dtype=np.uint16)
    b = a.copy()
    for k in range(len(b)):
        at = rng.choice(N.CHUNKS * N.WIDTH, 2 * N.CHUNKS - 1, replace=False)
        b[k, at] += 1
    assert (N.chunk_keys(a) == N.chunk_keys(b)).any(1).all()
