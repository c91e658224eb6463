"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives ``FEATURES``; each feature is cut into at most ``BINS`` bins at quantiles of the training rows. Shallow
trees are boosted in turns: one feature a turn, round after round, each tree a step function on that feature's bins, so
that all trees of a feature add up to one lookup table. Then the pairs that explain most of what is left get tables of
their own in the same way. A score is the sigmoid of a sum of looked-up numbers.

Training takes about half and at most all of ``MAX_ROWS`` labelled rows (by a hash of their id), a documented bound; the fit runs on the
driver over their bins, a table of that many rows and 20 small numbers each. Everything else covers all rows.

Defined cases: null text is empty text, which has a score as any other; null labels are no labels; several labels for one
id are several training rows; without labels, or with one class only, the score is the smoothed share of label 1 (one half
without any); rows with one id get equal scores if their texts are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import as_bytes, batch_words, blocks, bounded_sample, first_of_run, mapped, mix, out, owner_of, pick, table, texts, windows
from touchline.session import written

FEATURES = ["log_words", "word_length", "distinct_words", "adjacent_repeats", "repeated_pairs", "capitals", "capital_words", "digits", "marks", "mark_ended",
            "bars", "bangs", "punctuation", "stops", "lines", "repeated_lines", "short_words", "long_words", "spaces", "non_ascii"]
BINS = 32
MAX_ROWS = 60_000
ROUNDS = 120
RATE = 0.1
LEAVES = 4
PAIRS = 10
PAIR_ROUNDS = 60
PAIR_BINS = 8
THRESHOLD = 0.3
FOLDS = 5

_KEEP = {k: bytes(x for x in range(256) if x not in v) for k, v in {
    "capitals": range(65, 91), "digits": range(48, 58), "marks": b"#*$%&|<>", "bars": b"|", "bangs": b"!", "punctuation": b",;:?", "stops": b".",
    "spaces": b" \t\n\r\x0b\x0c", "non_ascii": range(0xC0, 256), "continued": range(0x80, 0xC0)}.items()}
_ENDS = (b"#", b"*", b"$", b"%", b"&", b"|", b"!", b"<", b">")


def _share_found_twice(keys: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """For each text, the share of its keys that are not new in it."""
    order = np.argsort(mix(keys) ^ mix(own.astype(np.uint64) + np.uint64(1)), kind="stable")
    k, o = keys[order], own[order]
    fresh = np.bincount(o[first_of_run(k, o)], minlength=n)
    total = np.bincount(own, minlength=n)
    return 1 - fresh / np.maximum(total, 1)


def features(data: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(data)
    words, hashes, starts = batch_words(data)
    own, count = owner_of(starts), np.diff(starts).astype(float)
    per_word = np.maximum(count, 1)
    size = {k: np.array([len(x.translate(None, d)) for x in data], float) for k, d in _KEEP.items()}
    chars = np.maximum(np.array([len(x) for x in data], float) - size["continued"], 1)
    lengths = np.array([len(w) for ws in words for w in ws], float)
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])) if len(hashes) else np.zeros(0, int)
    pairs = windows(hashes, 2)
    at = np.flatnonzero(own[1:] == own[:-1]) if len(own) else np.zeros(0, int)
    lines = [[y for y in x.split(b"\n") if y.strip()] for x in data]
    n_lines = np.array([len(x) for x in lines], float)
    cols = {
        "log_words": np.log1p(count), "word_length": np.bincount(own, lengths, n) / per_word, "distinct_words": 1 - _share_found_twice(hashes, own, n),
        "adjacent_repeats": np.bincount(own[same], minlength=n) / per_word, "repeated_pairs": _share_found_twice(pairs[at], own[at], n),
        "capital_words": np.array([sum(map(bytes.isupper, ws)) for ws in words]) / per_word,
        "mark_ended": np.array([sum(w.endswith(_ENDS) for w in ws) for ws in words]) / per_word,
        "lines": n_lines / per_word, "repeated_lines": np.array([len(x) - len(set(x)) for x in lines]) / np.maximum(n_lines, 1),
        "short_words": np.bincount(own, lengths <= 3, n) / per_word, "long_words": np.bincount(own, lengths > 14, n) / per_word,
    } | {k: size[k] / chars for k in ("capitals", "digits", "marks", "bars", "bangs", "punctuation", "stops", "spaces", "non_ascii")}
    return np.stack([cols[k] for k in FEATURES], 1).astype(np.float32)


_ROW = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float32()))])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        x = features(as_bytes(batch))
        flat = pa.array(x.ravel(), pa.float32())
        yield out(_ROW, batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), flat))


def feature_table(df: DataFrame) -> DataFrame:
    """(doc_id, x) for (doc_id, text)."""
    return mapped(df.select("doc_id", "text"), _featured, "doc_id long, x array<float>")


@dataclass
class Model:
    """Bin edges for each feature, a lookup table for each, and tables for pairs of features on coarser bins."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        total, b = np.full(len(x), self.base), self.bins(x)
        for k, t in enumerate(self.tables):
            total += t[b[:, k]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            total += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-total))


def _steps(g: np.ndarray, h: np.ndarray, leaves: int, smooth: float = 1.0) -> np.ndarray:
    """The tree with at most ``leaves`` leaves on ordered bins with gradients g and curvatures h: best cuts first."""
    parts, n = [(0, len(g))], len(g)
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    gain_of = lambda s, e: (cg[e] - cg[s]) ** 2 / (ch[e] - ch[s] + smooth)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p in parts:
            s, e = p
            if e - s < 2:
                continue
            cut = np.arange(s + 1, e)
            gain = gain_of(s, cut) + gain_of(cut, e) - gain_of(s, e)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], p, int(cut[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    step = np.zeros(n)
    for s, e in parts:
        step[s:e] = (cg[e] - cg[s]) / (ch[e] - ch[s] + smooth)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray, smooth: float = 1.0) -> tuple[float, np.ndarray]:
    """The best tree of one cut on each of two features, and its gain."""
    cg, ch = (np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0))) for x in (g, h))
    a, b = g.shape
    i, j = np.arange(1, a)[:, None], np.arange(1, b)[None, :]
    quads = [(lambda c: c[i, j]), (lambda c: c[i, b] - c[i, j]), (lambda c: c[a, j] - c[i, j]), (lambda c: c[a, b] - c[i, b] - c[a, j] + c[i, j])]
    gain = sum(q(cg) ** 2 / (q(ch) + smooth) for q in quads)
    x, y = np.unravel_index(np.argmax(gain), gain.shape)
    v = [(q(cg) / (q(ch) + smooth))[x, y] for q in quads]
    step = np.empty((a, b))
    step[: x + 1, : y + 1], step[: x + 1, y + 1 :], step[x + 1 :, : y + 1], step[x + 1 :, y + 1 :] = v
    return float(gain[x, y]), step


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on at most MAX_ROWS rows."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))), [], [], [], [], [])
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for k in range(x.shape[1])]
    b = model.bins(x)
    size = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in size]
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k in range(len(size)):
            r, c = slopes()
            step = RATE * _steps(np.bincount(b[:, k], r, size[k]), np.bincount(b[:, k], c, size[k]), LEAVES)
            model.tables[k] += step
            total += step[b[:, k]]
    model.coarse = [np.arange(s) * PAIR_BINS // s for s in size]
    rough = np.stack([m[b[:, k]] for k, m in enumerate(model.coarse)], 1)

    def grids(i, j, r, c):
        cell = rough[:, i] * PAIR_BINS + rough[:, j]
        return (np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (r, c))

    r, c = slopes()
    ranked = sorted(((_quadrants(*grids(i, j, r, c))[0], i, j) for i in range(len(size)) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables):
            step = RATE * _quadrants(*grids(i, j, *slopes()))[1]
            t += step
            total += step[rough[:, i], rough[:, j]]
    return model


def is_held_out(doc_id: str = "doc_id"):
    """Ids whose crc32 as text is divisible by FOLDS: never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(rows: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, *, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fit on labelled feature rows that are not held out."""
    marked = pick(labels, doc_id=id_col, label=label_col).where("label IS NOT NULL AND doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    chosen = bounded_sample(written(marked.where(~is_held_out()), "quality-labels"), max_rows // 2)
    found = rows.join(chosen, "doc_id").select("doc_id", "x", "label").toPandas().sort_values(["doc_id", "label"], kind="stable")
    x = np.array(found["x"].tolist(), np.float32).reshape(-1, len(FEATURES))
    return fit(x, found["label"].to_numpy(float))


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten(), np.float32).reshape(-1, len(FEATURES))
                yield out(_SCORED, batch.column(0), model.score(x))

    return run


def scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document; features are made once and kept in the shared folder."""
    rows = written(feature_table(texts(docs, id_col, text_col)), "quality-features")
    return mapped(rows, _scorer(train(rows, labels)), "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose own text scores at least ``threshold``; the columns of docs, unchanged.
    The text is scored where it lies, so no row moves."""
    model = train(written(feature_table(texts(docs)), "quality-features"), labels)
    at, plain = docs.columns.index("text"), docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, at):
            data = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(model.score(features(data)) >= threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    got = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
