"""Files in, tables out; tables in, documents out."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcloom.functions.text import stripped
from srcloom.sources.shared import durable

#: Documents that one task writes, each a file of its own.
FILES_OF_TASK = 1_000

# Folders that hold no audited code.
EXCLUDED = ["/test/", "/tests/", "/script/", "/scripts/", "/mock/", "/mocks/"]


def corpus_scan(spark: SparkSession, root: str, glob: str = "*.rs", exclude: list[str] | None = None) -> DataFrame:
    """source_file(path, content) of all files below root that match; paths that contain an excluded folder are left out by their name."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    found = found.where(~F.col("path").endswith(".gitkeep"))
    return found.where(~excluded(F.col("path"), exclude)) if exclude else found


def excluded(path, folders: list[str] | None = None):
    return reduce(lambda a, b: a | b, [F.contains(path, F.lit(f)) for f in folders or EXCLUDED])


def scan_roots(spark: SparkSession, roots: list[tuple[str, str, bool]], glob: str) -> DataFrame:
    """One read over several (path, program, external) roots, each file tagged with its root's program and flag."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text([r for r, _, _ in roots], wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return tag_roots(found, roots)


def tag_roots(files: DataFrame, roots: list[tuple[str, str, bool]]) -> DataFrame:
    """files with program and external of the longest root that the path contains."""
    program, external = F.lit(""), F.lit(False)
    for root, name, flag in sorted(roots, key=lambda r: len(r[0])):
        hit = F.contains("path", F.lit(root))
        program, external = F.when(hit, name).otherwise(program), F.when(hit, flag).otherwise(external)
    return files.withColumns({"program": program, "external": external})


def list_files(spark: SparkSession, root: str, exclude: list[str] | None = None, include: list[str] | None = None, sort: bool = False) -> DataFrame:
    """Paths and sizes below root; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return filter_listing(found, exclude, include, sort)


def filter_listing(files: DataFrame, exclude: list[str] | None = None, include: list[str] | None = None, sort: bool = False) -> DataFrame:
    """Files whose name is none of exclude and ends in one of include."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    out = files.where(~name.isin([".gitkeep", *(exclude or [])]))
    if include:
        out = out.where(reduce(lambda a, b: a | b, [name.endswith(s) for s in include]))
    return out.orderBy("path") if sort else out


def read_metadata(spark: SparkSession, paths: list[str], schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """The collections of JSON documents as tables with the given schemas; a missing collection or field is empty."""
    whole = T.StructType([T.StructField(n, T.ArrayType(s)) for n, s in schemas.items()])
    docs = spark.read.schema(whole).option("multiLine", "true").json(paths)
    return {n: defaulted(docs.select(F.explode(n).alias("r")).select("r.*")) for n in schemas}


def defaulted(df: DataFrame) -> DataFrame:
    """Nulls replaced by the empty value of their type."""
    empty = {"string": F.lit(""), "boolean": F.lit(False), "int": F.lit(0), "bigint": F.lit(0)}
    out = {}
    for f in df.schema:
        kind = f.dataType.simpleString()
        value = empty.get(kind, F.array().cast(kind) if kind.startswith("array") else None)
        if value is not None:
            out[f.name] = F.coalesce(F.col(f.name), value.cast(kind))
    return df.withColumns(out) if out else df


def write_metadata(tables: dict[str, DataFrame], folder: str, project: str, expected: str) -> None:
    """Tables as Parquet, by program, all of one state; nothing is written for another project.

    Every call writes a version of its own, and only when all tables are there is it named
    in the table of versions, which readers follow (metadata_table). So a call that fails half-way changes nothing for them.
    """
    if project != expected:
        raise ValueError(f"metadata of {expected} is not overwritten by {project}")
    version = uuid.uuid4().hex
    for name, df in tables.items():
        (df.write.partitionBy("program") if "program" in df.columns else df.write).parquet(f"{folder}/version-{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version, time.time_ns())], "version string, at long").coalesce(1).write.mode("append").parquet(f"{folder}/versions")


def metadata_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the newest complete version."""
    version = spark.read.parquet(f"{folder}/versions").agg(F.max(F.struct("at", "version"))["version"]).first()[0]
    return spark.read.parquet(f"{folder}/version-{version}/{name}")


def export_json(df: DataFrame) -> DataFrame:
    """One JSON document for each row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], lenient: str | None = None) -> DataFrame:
    """base with rows of delta instead of those with equal keys, and with its new rows; of several in delta the last by all columns.

    lenient names a key column that fits any value when it is empty on either side.
    """
    rest = [c for c in base.columns if c not in keys]
    new = delta.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*").select(*base.columns) if rest else delta.select(*base.columns).distinct()
    if lenient is None:
        return base.join(new.select(*keys), keys, "left_anti").select(*base.columns).unionByName(new)
    strict = [k for k in keys if k != lenient]
    d = new.select(*[F.col(k).alias(f"d_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"d_{k}") for k in strict], F.lit(True)) & ((F.col(lenient) == F.col(f"d_{lenient}")) | (F.col(lenient) == "") | (F.col(f"d_{lenient}") == ""))
    return base.join(d, same, "left_anti").unionByName(new)


def write_reports(report: DataFrame, folder: str) -> None:
    """One Markdown document for each entry: its lines in order, below its sections.

    Documents are dealt over tasks by their number: making a file takes long and its few bytes do not, by which Spark
    would leave all to one task. Tasks move the files to their place when they end (version 2 of Hadoop's committer),
    not the driver one after the other; so a folder is whole only if it has _SUCCESS.
    """
    found = durable(documents(report))
    tasks = max(found.sparkSession.sparkContext.defaultParallelism, found.count() // FILES_OF_TASK + 1)
    dealt = found.repartition(tasks, "entry")
    dealt.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("entry").text(folder)


def documents(report: DataFrame) -> DataFrame:
    """(entry, value) with the Markdown text of each entry's rows (entry_name, section, ord, line)."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "line")))
    parts = report.groupBy("entry_name", "section").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "t"))), lambda s: F.concat(F.lit("# "), s["section"], F.lit(":\n\n"), s["t"])), "\n\n")
    return parts.groupBy(F.col("entry_name").alias("entry")).agg(text.alias("value"))


def read_remappings(lines: DataFrame, list_name: str = "remappings") -> DataFrame:
    """(file, prefix, target) of `prefix=target` lines, and of the entries of an inline list in a configuration file.

    lines: file, line_no, line. Blank lines and those that begin with # are skipped.
    """
    text = stripped(F.col("line"))
    begins, ends = text.rlike(rf"^{list_name}\s*=\s*\["), F.contains(text, F.lit("]"))
    w = Window.partitionBy("file").orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({"b": F.max(F.when(begins, F.col("line_no"))).over(upto), "e": F.max(F.when(ends, F.col("line_no"))).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    inside = F.col("b").isNotNull() & (F.coalesce("e", F.lit(-1)) < F.col("b"))
    listed = marked.where(inside).select("file", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"""["']([^"'=]+=[^"']*)["']"""), F.lit(1))).alias("m"))
    config = lines.where(begins).select("file").distinct()
    plain = lines.join(config, "file", "left_anti").where((text != "") & ~text.startswith("#") & F.contains("line", F.lit("="))).select("file", "line_no", text.alias("m"))
    every = plain.unionByName(listed)
    return every.select("file", F.trim(F.substring_index("m", "=", 1)).alias("prefix"), F.trim(F.regexp_replace("m", "^[^=]*=", "")).alias("target"))
