"""Projections and look-ups over symbols and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom.functions.text import indent
from srcloom.operators.containment import by_key


def program_of_path(df: DataFrame, roots: list[tuple[str, str]], default: str = "") -> DataFrame:
    """df with the program of the longest root that begins the path; roots are (prefix, program) rows of the configuration."""
    out = F.lit(default)
    for prefix, program in sorted(roots, key=lambda r: len(r[0])):
        out = F.when(F.col("path").startswith(prefix), program).otherwise(out)
    return df.withColumn("program", out)


def program_from_layout(df: DataFrame, pattern: str = r"programs/([^/]+)/") -> DataFrame:
    """df with the program that the path itself names."""
    return df.withColumn("program", F.regexp_extract("path", pattern, 1))


def pretty_path(df: DataFrame) -> DataFrame:
    """df with the path from the program's folder on; contract files only lose leading ../ parts."""
    rust = F.regexp_replace("path", r"^.*?(programs/)", "$1")
    return df.withColumn("pretty_path", F.when(F.col("path").endswith(".sol"), F.regexp_replace("path", r"^(\.\./)+", "")).otherwise(rust))


def external_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("external", F.contains("path", F.lit("/lib/")))


def symbol_filter(symbol: DataFrame, name: str | None = None, sub_type: str | None = None, program: str | None = None, item: str | None = None) -> DataFrame:
    """Symbols of a name, sub-type, item and program; a symbol without a program fits any, as does an empty program asked for."""
    out = symbol
    for column, value in (("item", item), ("name", name), ("sub_type", sub_type)):
        out = out if value is None else out.where(F.col(column) == value)
    return out if not program else out.where(F.col("program").isin("", program))


def lookup_by_id(tables: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """(id, kind, name, payload) of ids in several tables; each table has columns id, name and others. Ids found nowhere have a null kind."""
    every = None
    for kind, t in tables.items():
        row = t.select(F.col("id"), F.lit(kind).alias("kind"), "name", F.to_json(F.struct(*[c for c in t.columns if c not in ("id", "name")])).alias("payload"))
        every = row if every is None else every.unionByName(row)
    return ids.select("id").join(every, "id", "left")


def find_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def missing(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys that df lacks."""
    return wanted.select(*keys).join(df.select(*keys).distinct(), keys, "left_anti")


def slice_source(source_file: DataFrame, symbol: DataFrame) -> DataFrame:
    """(symbol_id, content): the text of each symbol's lines; the end is clamped to the file.

    A file and its symbols are one row, and its text is cut into lines once.
    """
    files = source_file.select("path", F.split("content", "\n").alias("lines"))
    wanted = symbol.groupBy("path").agg(F.collect_list(F.struct("symbol_id", "start_line", "end_line")).alias("s"))
    start = lambda s: F.greatest(s["start_line"], F.lit(1))
    part = lambda s: F.slice("lines", start(s).cast("int"), F.greatest(s["end_line"] - start(s) + 1, F.lit(0)).cast("int"))
    cut = F.transform("s", lambda s: F.struct(s["symbol_id"].alias("symbol_id"), F.array_join(part(s), "\n").alias("content")))
    each = by_key(files).join(by_key(wanted), "path").select(F.explode(cut).alias("c"))
    return each.select("c.symbol_id", "c.content")


def strip_comments(source_line: DataFrame, filters: tuple[str, ...] = ()) -> DataFrame:
    """Lines with comment lines blanked, comment tails cut, and lines that contain a filter blanked."""
    line = F.col("line")
    blank = F.trim(line).startswith("//")
    for f in filters:
        blank = blank | F.contains(line, F.lit(f))
    return source_line.select("path", "line_no", F.when(blank, "").otherwise(F.regexp_replace(line, r"\s*//.*$", "")).alias("line"))


def dedent(source_line: DataFrame, group: list[str]) -> DataFrame:
    """Lines without the indent of the first line of their group; a shorter indent goes entirely."""
    w = Window.partitionBy(*group).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    first = F.length(F.first(indent(F.col("line"))).over(w))
    return source_line.withColumn("n", F.least(first, F.length(indent(F.col("line"))))).withColumn("line", F.expr("substring(line, n + 1)")).drop("n")


def symbol_label(symbol: DataFrame) -> DataFrame:
    """(symbol_id, label): `name: pretty path:line`, sorted by name."""
    return pretty_path(symbol).orderBy("name", "symbol_id").select("symbol_id", F.format_string("%s: %s:%d", "name", "pretty_path", F.col("start_line").cast("long")).alias("label"))


def permalink(symbol: DataFrame, commit_url: Column | str) -> DataFrame:
    """(symbol_id, url): a line of the committed file; empty if the commit address is malformed."""
    url = F.lit(commit_url) if isinstance(commit_url, str) else commit_url
    prefix, commit = F.regexp_extract(url, r"^(https?://[^/]+/[^/]+/[^/]+)/commit/[0-9a-f]+$", 1), F.regexp_extract(url, r"/commit/([0-9a-f]+)$", 1)
    at = F.concat(prefix, F.lit("/blob/"), commit, F.lit("/"), "pretty_path", F.lit("#L"), F.col("start_line").cast("string"))
    return pretty_path(symbol).select("symbol_id", F.when((prefix != "") & (commit != ""), at).otherwise("").alias("url"))
