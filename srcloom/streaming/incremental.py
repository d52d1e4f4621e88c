"""Symbols of files that keep arriving.

A file source never reads a path twice, so a new version of a file comes under
another revision folder (`rev=...`), which is not part of its key. Each
micro-batch appends the symbols of its files to a log by batch; a file without
symbols leaves a marker. The latest batch of each file is its state, so a batch
that is run again writes the same folder again, and nothing is rewritten as the
table grows. `compact` folds the log, so that reading costs what is current.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from srcloom.operators.blocks import RULES, symbol_extract


def file_key(path):
    """The path without revision folder and part name."""
    return F.regexp_replace(F.regexp_replace(path, r"/rev=[^/]+", ""), r"/part-[^/]+$", "/")


def _append(batch: DataFrame, batch_id: int, target: str, rules) -> None:
    files = batch.select(file_key(F.col("path")).alias("path"), F.regexp_extract("path", r"/rev=([^/]+)", 1).alias("rev"), "content")
    # of several versions in one batch the last revision counts
    last = Window.partitionBy("path").orderBy(F.length("rev").desc(), F.desc("rev"))
    files = files.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k", "rev")
    found = files.select("path").join(symbol_extract(files, rules), "path", "left")
    found.write.mode("overwrite").parquet(f"{target}/log/batch={batch_id}")


def incremental_symbols(spark: SparkSession, stream_dir: str, target: str, rules=RULES, glob: str = "*.txt", available_now: bool = True) -> StreamingQuery:
    """Start the job: files below stream_dir are scanned as they come, symbols go to the log of target."""
    files = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(stream_dir, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    writer = rows.writeStream.foreachBatch(lambda df, n: _append(df, n, target, rules)).option("checkpointLocation", f"{target}/state")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _base(spark: SparkSession, target: str) -> tuple[DataFrame, int] | None:
    """The newest folded state and the last batch that is in it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/base")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None  # nothing was folded yet; a table that is there but can't be read is an error
    every = spark.read.parquet(f"{target}/base")
    upto = every.agg(F.max("upto")).first()[0]
    return every.where(F.col("upto") == upto).drop("upto"), upto


def latest_symbols(spark: SparkSession, target: str) -> DataFrame:
    """The symbols of the latest version of each file: the folded state, and the log from there on."""
    log, folded = spark.read.parquet(f"{target}/log"), _base(spark, target)
    if folded is not None:
        base, upto = folded
        log = log.where(F.col("batch") > upto).unionByName(base.withColumn("batch", F.lit(upto)))
    newest = log.groupBy("path").agg(F.max("batch").alias("batch"))
    return log.join(newest, ["path", "batch"], "left_semi").where("symbol_id is not null").drop("batch")


def compact(spark: SparkSession, target: str) -> None:
    """Fold the log: the state as one table, from which reading starts; earlier batches are not read again and may be removed."""
    last = spark.read.parquet(f"{target}/log").agg(F.max("batch")).first()[0]
    folded = _base(spark, target)
    if last is not None and (folded is None or folded[1] < last):
        latest_symbols(spark, target).write.mode("overwrite").parquet(f"{target}/base/upto={last}")
