"""Mixing sources to target weights by thresholds on a hash, found from histograms.

Every document has a fixed hash of its id. A source that is to give part of its words gives the
documents whose hash lies under a threshold. The threshold comes from histograms: words by source
and hash bucket; the bucket in which the budget ends is refined by the next bits of the hash, until
it holds one hash value. Nothing is sorted. Budgets for a first, second, ... copy of a document are
nested: each is met in full before the next one starts, so at most one of them is partial.

Defined cases: null text has size 0; a null source is a source of its own, last in order; rows with
one id and source share their hash, so they are taken together; an empty table gives an empty result;
a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.common import n_words, table, texts
from touchline.operators.ordering import with_position
from touchline.session import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
HASH_HEX = 12  # hex digits of the hash: 48 bits
STEP_HEX = 3  # refined by so many digits a time: 4,096 buckets


def sized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, h): one narrow row a document; h is the head of md5 of the id as text."""
    df = texts(docs, id_col, text_col, source=source_col)
    key = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, HASH_HEX)
    return df.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), key.alias("h"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target): weights repeat along the sources in order of code points, null last.
    A target stops at ``most`` times its source; the excess is shared again by weight until none is above."""
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull())
    placed = with_position(totals, ["_null", "source"], "_pos")
    turn = F.array(*[F.lit(float(w)) for w in weights])[((F.col("_pos") - 1) % len(weights)).cast("int")]
    table = written(placed.select("source", "source_size", turn.alias("weight"), (F.col("source_size") * float(most)).alias("cap")), "mix-sources")
    budget = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # sums of whole numbers: exact, so any order gives the same
        above = F.lit(level) * F.col("weight") > F.col("cap")
        row = table.agg(F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("cap"),
                        F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        if row["n"] == full or not row["w"]:
            break
        full, level = row["n"], (budget - row["cap"]) / row["w"]
    target = F.when(F.lit(level) * F.col("weight") > F.col("cap"), F.col("cap")).otherwise(F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, bound): every document is taken ``copies`` times and once more if its
    hash is at most ``bound`` (null: none). The whole document at the boundary goes in if that comes nearer."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    open_ = written(wanted.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
                    .withColumn("prefix", F.lit("")), "mix-open")
    for digits in range(STEP_HEX, HASH_HEX + 1, STEP_HEX):
        # Only the boundary buckets of the step before are looked at again, in finer buckets.
        inside = sizes.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        edge = open_.where("rest > 0").select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_s"), F.col("prefix").alias("_p"))
        hist = (inside.join(edge, "_s").where(F.col("h").startswith(F.col("_p")))
                .groupBy("_s", F.substring("h", 1, digits).alias("bucket"))
                .agg(F.sum("size").alias("words"), (F.min("h") < F.max("h")).alias("several")))
        order = W.partitionBy("_s").orderBy("bucket")  # at most 4,096 rows for each source
        below = F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        hist = hist.withColumn("below", below)
        state = open_.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        found = (hist.join(state.select("_s", "rest"), "_s").where("below < rest")
                 .groupBy("_s").agg(F.max(F.struct("bucket", "below", "words", "several")).alias("at")))
        open_ = written(state.join(found, "_s", "left").withColumn("prefix", F.coalesce("at.bucket", "prefix"))
                        .withColumn("rest", F.col("rest") - F.coalesce(F.col("at.below"), F.lit(0)))
                        .withColumn("words", F.coalesce(F.col("at.words"), F.lit(0)))
                        .withColumn("several", F.coalesce(F.col("at.several"), F.lit(False)))
                        .select(*wanted.columns, "copies", "rest", "prefix", "words", "several"), "mix-open")
        if not open_.where("rest > 0 AND several").limit(1).count():
            break
    # Taken: all hashes under the prefix, and those with it if the boundary document brings the sum nearer.
    takes = (F.col("rest") > 0) & (F.col("words") - F.col("rest") < F.col("rest"))
    high, low = F.rpad("prefix", HASH_HEX, "f"), F.rpad("prefix", HASH_HEX, "0")
    bound = F.when(F.col("rest") <= 0, F.lit(None)).when(takes, high).otherwise(low)
    return open_.select(*wanted.columns, "copies", bound.alias("bound"), takes.alias("closed"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MAX_COPIES, *, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often the mix takes each document."""
    sizes = written(sized(docs, id_col=id_col, text_col=text_col, source_col=source_col), "mix-sizes")
    plan = thresholds(sizes, targets(sizes, weights, share, most))
    per_source = plan.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    rows = sizes.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    more = F.when(F.col("bound").isNull(), False).when(F.col("closed"), F.col("h") <= F.col("bound")).otherwise(F.col("h") < F.col("bound"))
    copies = F.col("copies") + more.cast("long")
    return (rows.join(per_source, "_s").withColumn("copies", copies)
            .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")))


def repeated(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MAX_COPIES, *, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; columns unchanged. The plan is a row for each source, so
    rows are judged where they lie by their own hash."""
    sizes = written(sized(docs, id_col=id_col, source_col=source_col), "mix-sizes")
    plan = thresholds(sizes, targets(sizes, weights, share, most))
    plan = plan.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("s"), F.col("copies").alias("n"), "bound", "closed")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, source = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, source_col))
    h = F.substring(F.md5(F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))), 1, HASH_HEX)
    joined = plain.withColumn("s", F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))).withColumn("h", h).join(plan, "s")
    more = F.when(F.col("bound").isNull(), False).when(F.col("closed"), F.col("h") <= F.col("bound")).otherwise(F.col("h") < F.col("bound"))
    times = (F.col("n") + more.cast("long")).cast("int")
    return joined.withColumn("_t", F.explode(F.array_repeat(F.lit(0), times))).select(*plain.columns).toDF(*docs.columns)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12) AS h FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sizes GROUP BY source),
ranked AS (
  SELECT *, 2.0 * source_size AS cap, row_number() OVER (ORDER BY 2.0 * source_size / weight, source) AS rk FROM totals),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM ranked),
chosen AS (SELECT lev FROM levels WHERE lev * weight <= cap ORDER BY rk LIMIT 1),
wanted AS (
  SELECT source, source_size, CASE WHEN (SELECT lev FROM chosen) * weight > cap THEN cap ELSE (SELECT lev FROM chosen) * weight END AS target FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM wanted),
hashes AS (SELECT source, h, sum(size) AS words FROM sizes GROUP BY source, h),
below AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM hashes),
taken AS (
  SELECT b.source, b.h, p.source_size, p.target,
         p.copies + CASE WHEN under < target - copies * source_size
                          AND (under + words <= target - copies * source_size OR words - (target - copies * source_size - under) < target - copies * source_size - under)
                    THEN 1 ELSE 0 END AS times
  FROM below b JOIN parts p ON b.source IS NOT DISTINCT FROM p.source)
SELECT s.doc_id, s.size, t.source_size::BIGINT AS source_size, t.target::DOUBLE AS target, (s.size * t.times)::BIGINT AS taken
FROM sizes s JOIN taken t ON s.source IS NOT DISTINCT FROM t.source AND s.h = t.h
"""
