"""Counts against plain Python, the language model against a plain one, held-out accuracy, and odd rows."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from brute import words
from touchline.llm import perplexity as P
from touchline.llm import quality_model as Q

SF = "/root/testdata/sf0.01"
ODD = [(1, None, None), (2, "", "en"), (3, "a a a a a a a a a\n\n x \n x \n #$<", "en"), (4, "é日本😀 | *", "xx"), (5, "w " * 30_000, "en"), (5, "w " * 30_000, "en"), (None, "one", "en"),
       (7, " ".join(f"v{i}" for i in range(9)) * 3, "de"), (8, "\x00\x1f\x85 a b", "de"), (9, " \n\t", "de")]


def odd(spark):
    return spark.createDataFrame([(*r, 1) for r in ODD], "a long, b string, c string, d int").toDF("doc_id", "text", "lang", "LANG")


def counts(text):
    w = words(text)
    n = len(w)
    seen = {}
    for k in range(n - 7):
        seen.setdefault(tuple(w[k : k + 8]), []).append(k)
    inside = {k + j for v in seen.values() if len(v) > 1 for k in v for j in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    base = n < 20 or 100 * len(inside) > 30 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), base


def test_rules(spark):
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df, rows in ((odd(spark), [(i, t) for i, t, _ in ODD]), (docs, [(r["doc_id"], r["text"]) for r in docs.collect()])):
        got = P.rules(df).collect()
        assert sorted((str(r["doc_id"]), *(r[f] for f in fields)) for r in got) == sorted((str(i), *counts(t)) for i, t in rows)
        assert all(not r["kept"] for r in got if r["base_failed"])
    assert P.rules(odd(spark).limit(0)).count() == 0


def test_good_documents_stay(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in P.op6_quality_rules(spark, SF).collect() if not r["base_failed"] and r["doc_id"] in labels]
    kept = {q: [r["kept"] for r in rows if labels[r["doc_id"]] == q] for q in (0, 1)}
    assert np.mean(kept[1]) > 0.99 and np.mean(kept[0]) < 0.7


def test_counts_are_spark_s(spark):
    data = ["abc abd", "Zu 12!", "ébc abc"]
    df = spark.createDataFrame([(t,) for t in data], "text string")
    plain = {}
    for t in data:
        c = [P.BREAK_CLASS] * 3 + P._CLASSES[[ord(x) for x in t]].tolist()
        for k in range(len(t)):
            g = sum(x * P.A ** (3 - j) for j, x in enumerate(c[k : k + 4]))
            plain[g] = plain.get(g, 0) + 1
    assert {r["gram"]: r["n"] for r in P.count_ngrams(df).collect()} == plain


def test_kneser_ney_is_a_distribution_and_smooths():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.choice(P.A**4, 5000, replace=False)).astype(np.int32)
    p = np.exp(P.kneser_ney(keys, rng.integers(1, 50, 5000)).astype(float)).reshape(-1, P.A)
    assert np.allclose(p.sum(1), 1, atol=1e-4) and (p > 0).all()


def test_kneser_ney_by_hand():
    """One order up from the uniform: discounts from counts of counts, weight to the lower order."""
    c = np.array([1, 1, 1, 2, 2, 3, 4, 9] + [0] * 32)
    lower = np.full(40, 1 / 40)
    p, weight = P._smoothed(c, lower)
    y = 3 / (3 + 4)
    d = [1 - 2 * y * 2 / 3, 2 - 3 * y * 1 / 2, 3 - 4 * y * 1 / 1]
    total = c.sum()
    w = (3 * d[0] + 2 * d[1] + 3 * d[2]) / total
    assert weight[0] == pytest.approx(w) and p[3] == pytest.approx((2 - d[1]) / total + w / 40) and p[20] == pytest.approx(w / 40)
    assert not math.isnan(p.sum())


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in Q.op3_quality_classifier(spark, SF).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for i, r in rows.items())
    marked = [(rows[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    held = [(r["predicted"], q) for r, q in marked if r["held_out"]]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) > 0.95
    assert np.mean([p for p, q in held if q == 1]) > 0.98


def test_held_out_labels_are_not_used(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(Q.is_held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(Q.scores(docs, labels).collect()) == sorted(Q.scores(docs, turned).collect())


def test_odd_texts_have_scores(spark):
    labels = spark.createDataFrame([(2, 0), (3, 1), (None, 1), (4, None), (77, 1)], "doc_id long, quality int")
    for marked in (labels, labels.limit(0)):
        got = Q.scores(odd(spark), marked).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got} == {0.5}
    assert Q.scores(odd(spark).limit(0), labels).count() == 0
    kept = Q.keep_good(odd(spark), labels.limit(0))
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD)


def test_pairs_learn_what_single_features_cannot():
    rng = random.Random(0)
    x = np.array([[rng.random() for _ in Q.FEATURES] for _ in range(3000)], np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
