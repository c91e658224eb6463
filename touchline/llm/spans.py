"""Spans of regular expressions in texts, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


#: Arrays longer than this are built from pieces of this length, so that a text with n spans costs n * PIECE and not n * n.
PIECE = 128


def pieces(array: Column) -> Column:
    """The array cut into arrays of at most PIECE elements."""
    n = F.ceil(F.size(array) / PIECE).cast("int")
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.slice(array, (k - 1) * PIECE + 1, PIECE))


def find_spans(text: Column, pattern: str, kind: str, rank: int, hint: Column | None = None) -> Column:
    """All leftmost non-overlapping matches as an array of SPAN, in code points, end exclusive.
    The lengths of the pieces between the matches give the positions. ``hint``: a cheap test that every text with a
    match passes. Patterns should use possessive quantifiers for repeated groups: they do not recurse in long texts."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    found = F.zip_with(F.slice(between, F.lit(1), F.size(values)), values, lambda p, v: F.struct(F.length(p).alias("gap"), v.alias("value")))
    state = f"struct<at:int,spans:array<{SPAN}>>"

    def step(acc, x):
        s = acc["at"] + x["gap"]
        e = s + F.length(x["value"])
        span = F.struct(s.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), e.alias("end"), x["value"].alias("value"))
        return F.struct(e.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans")).cast(state)

    start = F.struct(F.lit(0).alias("at"), no_spans().alias("spans")).cast(state)
    inside = lambda part: F.aggregate(part, start, step)

    def behind(acc, part):
        """A piece's own positions, moved behind all pieces before it."""
        moved = F.transform(part["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["parts"], F.array(moved)).alias("parts"))

    many = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("parts"))
    placed = F.when(F.size(values) <= PIECE, inside(found)["spans"]).otherwise(F.flatten(F.aggregate(F.transform(pieces(found), inside), many, behind)["parts"]))
    test = F.regexp_like(text, F.lit(pattern))
    return F.when(test if hint is None else hint & test, placed).otherwise(no_spans())


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``, which are sorted by start."""
    hit = lambda s, o: (s["start"] < o["end"]) & (o["start"] < s["end"])
    parts = F.transform(pieces(others), lambda p: F.struct(F.array_min(F.transform(p, lambda o: o["start"])).alias("start"), F.array_max(F.transform(p, lambda o: o["end"])).alias("end"), p.alias("own")))
    near = lambda s: F.exists(parts, lambda p: hit(s, p) & F.exists(p["own"], lambda o: hit(s, o)))
    few = F.filter(spans, lambda s: ~F.exists(others, lambda o: hit(s, o)))
    return F.when(F.size(others) <= PIECE, few).otherwise(F.filter(spans, lambda s: ~F.coalesce(near(s), F.lit(False))))


def without_overlaps(spans: Column) -> Column:
    """In order of start, those that do not reach into one taken before."""
    state = f"struct<to:int,spans:array<{SPAN}>>"

    def step(acc, s):
        free = s["start"] >= acc["to"]
        return F.when(free, F.struct(s["end"].alias("to"), F.concat(acc["spans"], F.array(s)).alias("spans")).cast(state)).otherwise(acc)

    taken = lambda part, to: F.aggregate(part, F.struct(to.alias("to"), no_spans().alias("spans")).cast(state), step)

    def more(acc, part):
        # a piece whose spans are taken from where the pieces before end; evaluated once as the only element
        return F.element_at(F.transform(F.array(taken(part, acc["to"])), lambda x: F.struct(x["to"].alias("to"), F.concat(acc["parts"], F.array(x["spans"])).alias("parts"))), 1)

    many = F.struct(F.lit(0).alias("to"), F.array().cast(f"array<array<{SPAN}>>").alias("parts"))
    ordered = F.array_sort(spans)
    return F.when(F.size(spans) <= PIECE, taken(ordered, F.lit(0))["spans"]).otherwise(F.flatten(F.aggregate(pieces(ordered), many, more)["parts"]))


def numbered(df: DataFrame) -> DataFrame:
    """A column ``row`` that tells rows apart, also such with one id. Fixed only once the result is written."""
    return df.withColumn("row", F.monotonically_increasing_id())
