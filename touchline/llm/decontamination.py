"""Benchmark decontamination: MinHash containment search, verified by exact containment.

An item is contained in a document if at least ``THRESHOLD`` of its distinct shingles of ``SHINGLE`` words are shingles of
the document, however long that is. The size class of an item is told, but the search is not partitioned by it. An
item's sketch is its ``SKETCH`` shingles of least hash; of an item with no more shingles, that is all of them.
The documents' shingles are compared with the sketches only, so a document needs no sketch of its own
and its length does not matter. A document is a candidate for an item if it holds enough of the sketch: fewer than
``(1 - THRESHOLD) * n`` of an item's n shingles may be missing, and not more of its sketch can be missing than that, so
the least number of sketch shingles that an item in a document must show is exact, and no item is lost. Where
that number would fall below one, the sketch is enlarged. Candidates are verified with all shingles.

Only built-in functions touch the texts. Words are `[^\\x20\\x09-\\x0D]+`, A-Z in lower case. Sketches are broadcast behind a check of
their number and bytes; beyond it Spark joins by shuffle, with the same result.

Defined cases: null text has no words; a text with fewer words than a shingle is one shingle of all its words, without words
it has none and is neither contained nor contaminated; rows with one id count as one document, and so do the rows without
an id in ``contained``; ``without_leaks`` judges each row without an id by its own text; items with equal
texts are all reported; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import SPACE, same, table, texts
from touchline.session import written

SHINGLE = 5
THRESHOLD = 0.8
SKETCH = 16
BROADCAST_ROWS = 500_000  # of sketch hashes, 24 bytes each
BROADCAST_BYTES = 32_000_000  # of item shingles as text

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KEY = ["doc_id", "nameless"]  # a document; the second one is null, or tells rows without an id apart



def _words(df: DataFrame) -> DataFrame:
    lowered = F.translate("text", _UPPER, _UPPER.lower())
    return df.withColumn("words", F.filter(F.split(lowered, f"[{SPACE}]+"), lambda w: w != ""))


def hashed_shingles(df: DataFrame, size: int = SHINGLE):
    """``shingles``: 64-bit hashes of all windows of ``size`` words; of all words, if they are fewer."""
    df = _words(df).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    last = F.size("h") - size
    shifted = [F.slice("h", F.lit(k + 1), F.greatest(last + 1, F.lit(0))).alias(f"w{k}") for k in range(size)]
    many = F.transform(F.arrays_zip(*shifted), lambda z: F.xxhash64(*[z[f"w{k}"] for k in range(size)]))
    few = F.when(F.size("h") > 0, F.array(F.xxhash64(F.concat_ws(" ", "words")))).otherwise(F.array().cast("array<bigint>"))
    return F.when(last >= 0, many).otherwise(few), df


def exact_shingles(df: DataFrame, size: int = SHINGLE):
    """``shingles`` as text: the words joined by a space."""
    df = _words(df)
    last = F.size("words") - size
    many = F.transform(F.sequence(F.lit(1), F.greatest(last + 1, F.lit(1))), lambda i: F.array_join(F.slice("words", i, F.lit(size)), " "))
    few = F.when(F.size("words") > 0, F.array(F.array_join("words", " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(last >= 0, many).otherwise(few)), df


def sketches(items: DataFrame, threshold: float = THRESHOLD, sketch: int = SKETCH) -> DataFrame:
    """(item_id, size_class, n, need, h): the sketch of each item, and how many of it a document that contains the item must show.
    An item's shingles are a group bounded by the item."""
    column, df = hashed_shingles(items)
    rows = df.select("item_id", F.array_distinct(column).alias("s")).where("size(s) > 0")
    rows = rows.withColumn("n", F.size("s")).withColumn("missing", F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int"))
    rows = rows.withColumn("k", F.least("n", F.greatest(F.lit(sketch), 2 * F.col("missing"))))
    least = F.slice(F.array_sort("s"), F.lit(1), F.col("k"))
    return rows.select("item_id", F.floor(F.log2("n")).cast("int").alias("size_class"), "n", (F.col("k") - F.col("missing")).alias("need"), F.explode(least).alias("h"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only behind a count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def candidates(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, nameless, item_id) that share enough of the item's sketch."""
    marks = written(sketches(items, threshold), "bench-sketches")
    # Nothing above the largest sketch hash of any size class can be in a sketch.
    top = marks.groupBy("size_class").agg(F.max("h").alias("top")).agg(F.max("top")).first()[0]
    column, df = hashed_shingles(docs)
    seen = df.select(*_KEY, F.explode(F.filter(column, lambda h: h <= F.lit(top if top is not None else -(2**63)))).alias("h"))
    hits = seen.join(_small(marks.select("item_id", "size_class", "need", "h"), BROADCAST_ROWS), "h")
    return (hits.groupBy(*_KEY, "item_id", "need").agg(F.collect_set("h").alias("seen"))  # at most a sketch; summed up before the shuffle
            .where(F.size("seen") >= F.col("need")).select(*_KEY, "item_id"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, *, id_col: str = "doc_id", text_col: str = "text",
              item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of every item that a document contains."""
    docs = texts(docs, id_col, text_col).withColumn("nameless", F.lit(None).cast("long"))
    items = texts(items, item_id_col, item_text_col).withColumnRenamed("doc_id", "item_id")
    return _contained(docs, items, threshold).drop("nameless")


def _contained(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The same of docs (doc_id, nameless, text) and items (item_id, text), with ``nameless``."""
    found = written(candidates(docs, items, threshold).select(*_KEY).distinct(), "bench-candidates").toDF("id", "no_name")
    column, df = exact_shingles(docs.join(found, same(docs, found, _KEY), "left_semi"))
    shown = df.select(*_KEY, F.explode(column).alias("shingle"))
    item_column, item_df = exact_shingles(items)
    wanted = written(item_df.select("item_id", F.explode(item_column).alias("shingle"), F.size(item_column).alias("n_shingles")), "bench-shingles")
    bytes_ = wanted.agg(F.sum(F.octet_length("shingle") + 40)).first()[0] or 0
    hits = shown.join(F.broadcast(wanted) if bytes_ <= BROADCAST_BYTES else wanted, "shingle").select(*_KEY, "item_id", "n_shingles", "shingle").distinct()
    counted = hits.groupBy(*_KEY, "item_id", "n_shingles").agg(F.count("*").alias("n_found"))
    return (counted.where(F.col("n_found") >= F.ceil(F.col("n_shingles") * threshold - 1e-9))
            .select(*_KEY, "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment")))


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no item; the columns of docs, unchanged."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    id_, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    text = F.coalesce(text.cast("string"), F.lit(""))
    keyed = plain.withColumns({"doc_id": id_.cast("long"), "nameless": F.when(id_.cast("long").isNull(), F.xxhash64(text))})
    items = texts(items, "item_id").withColumnRenamed("doc_id", "item_id")
    bad = written(_contained(keyed.select(*_KEY, text.alias("text")), items, threshold).select(*_KEY).distinct(), "bench-leaks").toDF("id", "no_name")
    return keyed.join(bad, same(keyed, bad, _KEY), "left_anti").drop(*_KEY).toDF(*docs.columns)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH every AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
shingles AS (
  SELECT DISTINCT side, id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT side, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM every WHERE len(w) > 0)),
items AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE side = 1),
hits AS (
  SELECT d.id AS doc_id, i.id AS item_id, i.n AS n_shingles, count(*) AS n_found
  FROM shingles d JOIN items i USING (s) WHERE d.side = 0 GROUP BY 1, 2, 3)
SELECT doc_id, item_id, n_shingles::BIGINT AS n_shingles, n_found::BIGINT AS n_found, n_found / n_shingles AS containment
FROM hits WHERE n_found >= ceil(n_shingles * 0.8 - 1e-9)
"""
