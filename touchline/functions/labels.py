"""Season labels, raw dates and configuration ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def season_key(label: Column) -> Column:
    """Sort key of a ``YYYY_YY`` label. Labels without a leading year sort
    after all others, by their text."""
    label = label.cast("string")
    head = F.trim(F.split_part(label, F.lit("_"), F.lit(1))).try_cast("int")
    return F.struct(
        F.when(head.isNull(), 1).otherwise(0).alias("bucket"),
        F.coalesce(head, F.lit(0)).alias("year"),
        F.when(head.isNull(), label).otherwise("").alias("text"),
    )


def season_years(label: Column) -> Column:
    """The two calendar years of a label: ``1999_00`` spans 1999 and 1900."""
    start = F.split_part(label, F.lit("_"), F.lit(1)).cast("int")
    suffix = F.split_part(label, F.lit("_"), F.lit(2)).cast("int")
    return F.array(start, (F.floor(start / 100) * 100).cast("int") + suffix)


def parse_raw_date(raw: Column) -> Column:
    """Day-first dates with a 2- or 4-digit year, chosen row by row.
    Two-digit years from 69 on belong to the 1900s."""
    short = F.try_to_date(raw, "d/M/yy")
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(F.try_to_date(raw, "d/M/yyyy"), short)


def config_id(model: Column, params: Column) -> Column:
    """``model[key=value_key=value]`` with keys sorted; the bare model without any."""
    pairs = F.transform(
        F.array_sort(F.map_entries(params)),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]),
    )
    return F.when(F.size(pairs) == 0, model).otherwise(
        F.concat(model, F.lit("["), F.array_join(pairs, "_"), F.lit("]"))
    )
