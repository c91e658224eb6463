"""Secrets, and who owns them: candidates are counted by the distinct owners and repositories that hold them.

Base spans (assignments, access keys, long hex strings) are exact rules and always stay. Every secret value, of base
spans and of further patterns, is hashed; the corpus is aggregated by hash to numbers of distinct owners and
repositories. A value held by ``COPIED`` owners or more is a copied example; one that a single owner holds and that is
varied enough looks live. Further patterns give spans of kind ``owned`` where they look live.

Only built-in functions are used. Hashes are aggregated by (hash, owner, repository) first, so a value that stands in
a third of all documents is one row a task before it moves.

Defined cases: null text is empty text; a null owner or repository counts as one of its own; rows with one id are
judged alone; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import spans as S
from touchline.llm.common import table, texts
from touchline.session import written

#: (kind, pattern); matches that are too short are dropped afterwards.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]++"),
    ("hex", r"[0-9a-f]{24,}+"),
]
#: A run of 32 characters or more; that it mixes digits, capitals and small letters is asked of the whole match afterwards.
_MIXED = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{32,}+"
#: Further shapes of credentials.
MORE = [
    r"(?<![A-Za-z0-9_])gh[opsur]_[A-Za-z0-9]{20,}+", r"(?<![A-Za-z0-9_])(?:sk|pk|rk)[-_](?:live|test)[-_][A-Za-z0-9]{16,}+", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+",
    r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", _MIXED,
]
COPIED = 3
VARIED = 8  # different characters that a live-looking value has at least


def _value(span: Column) -> Column:
    """The secret itself: of an assignment, what is assigned."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["value"], BASE[0][1], 2)).otherwise(span["value"])


def _assigned(v: Column) -> Column:
    return F.length(F.regexp_extract(v, BASE[0][1], 2)) >= 6


def found(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", group_col: str = "lang") -> DataFrame:
    """One row a document: base spans and further candidates."""
    text = F.col("text")
    df = texts(docs, id_col, text_col, owner=owner_col, part=group_col)
    hints = [F.regexp_like(text, F.lit("[:=]")), F.contains(text, F.lit("AKIA")), None]
    for rank, ((kind, pattern), hint) in enumerate(zip(BASE, hints)):
        df = df.withColumn(f"_b{rank}", S.find_spans(text, pattern, kind, rank, hint))
    good = [F.filter("_b0", lambda s: _assigned(s["value"])), F.filter("_b1", lambda s: F.length(s["value"]) >= 20), F.col("_b2")]
    df = df.withColumn("base", F.array_sort(F.concat(*good)))
    mixed = lambda s: F.regexp_like(s["value"], F.lit("[0-9]")) & F.regexp_like(s["value"], F.lit("[A-Z]")) & F.regexp_like(s["value"], F.lit("[a-z]"))
    for k, p in enumerate(MORE):
        df = df.withColumn(f"_l{k}", S.find_spans(text, p, "owned", 10 + k))
    df = df.withColumn("_loose", F.concat(*[F.filter(f"_l{k}", mixed) if p == _MIXED else F.col(f"_l{k}") for k, p in enumerate(MORE)]))
    df = df.withColumn("loose", S.without_overlaps(S.apart(F.col("_loose"), F.col("base"))))
    owner = F.coalesce(F.concat(F.lit("="), F.col("owner").cast("string")), F.lit(""))
    repository = F.concat_ws("/", owner, F.coalesce(F.concat(F.lit("="), F.col("part").cast("string")), F.lit("")))
    return S.numbered(df.select("doc_id", owner.alias("owner"), repository.alias("repository"), "base", "loose"))


def ownership(rows: DataFrame) -> DataFrame:
    """(hash, owners, repositories) from rows (hash, owner, repository)."""
    pairs = rows.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def secrets(docs: DataFrame, copied: int = COPIED, **columns: str) -> DataFrame:
    """(doc_id, base, added, n_live, n_copied): spans with their values, and how many values look live or are copied about."""
    seen = written(found(docs, **columns), "secrets")
    spans = seen.where("size(base) > 0 OR size(loose) > 0").select("row", "owner", "repository", F.explode(F.concat("base", "loose")).alias("span"))
    spans = written(spans.withColumn("hash", F.sha2(_value(F.col("span")), 256)), "secret-spans")
    judged = spans.join(ownership(spans), "hash")
    varied = F.size(F.array_distinct(F.split(_value(F.col("span")), ""))) >= VARIED
    live = (F.col("owners") == 1) & varied
    each = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(live & (F.col("span.kind") == "owned"), F.col("span")))).alias("added"),
        F.count(F.when(live, 1)).alias("n_live"), F.count(F.when(F.col("owners") >= copied, 1)).alias("n_copied"))
    return (seen.join(each, "row", "left")
            .select("doc_id", "base", F.coalesce("added", S.no_spans()).alias("added"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied")))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    got = secrets(table(spark, sf_dir, "documents"))
    return got.select("doc_id", *[S.count_of(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                      F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"), S.joined(F.array_sort(F.concat("base", "added"))).alias("spans"), "n_live", "n_copied")
