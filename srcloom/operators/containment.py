"""Rows joined with the spans of lines that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a bin.
BIN = 64


def by_key(df: DataFrame) -> DataFrame:
    """df that joins meet by key, in a shuffle.

    For rows that are made of texts (lines, blocks, symbols, bodies): Spark estimates them by
    the columns that were scanned, far too low, and would gather them at the driver as a broadcast.
    """
    return df.hint("merge")


def within(rows: DataFrame, spans: DataFrame, keys: list[tuple[str, str]], at: str, low: Column, high: Column, how: str = "inner", also: Column | None = None) -> DataFrame:
    """rows joined with the spans of equal keys for which low <= at <= high, and `also` holds.

    Lines are cut into bins of BIN. A row is in the bin of its line, a span is listed
    in all of its bins, and both meet by key and bin: so a row meets the spans
    that reach into its bin, not all of its file. Spans that nest as blocks do are in
    lines / BIN bins for each level of nesting, so the cost grows with the file and not with
    its square. keys: names in rows and in spans, which share no names; how: inner, left,
    left_semi or left_anti.
    """
    of = lambda line: F.floor(line / BIN).cast("long")
    binned = rows.withColumn("__bin", of(F.col(at)))
    listed = spans.where(low <= high).withColumn("__in_bin", F.explode(F.sequence(of(low), of(high))))
    same = (F.col("__bin") == F.col("__in_bin")) & F.col(at).between(low, high)
    for a, b in keys:
        same = same & (F.col(a) == F.col(b))
    return by_key(by_key(binned).join(by_key(listed), same if also is None else same & also, how).drop("__bin", "__in_bin"))
