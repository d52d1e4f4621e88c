"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a Python task holds as Python objects at one time.
SLICE_ROWS = 512
#: Rows of an Arrow batch of texts, Spark's setting for that and its default, which takes some 40 MB of texts, more than once in the JVM and in Python.
BATCH_ROWS, BATCH_SETTING, BATCH_DEFAULT = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local session (tests) gets one of its own, a cluster an error."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that losing an executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Hand memory that was freed back to the system, that of Arrow's pool and, where the C library can, all other."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS from now on, unless the session has a value of its own: frames are computed after their operator has returned."""
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


class Scratch:
    """Parquet tables of one operator in the shared folder, each removed as soon as a later one has replaced it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, fresh_path(spark, name)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """The rows, computed once. Names are used once."""
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that no frame yet to be computed reads."""
        for path in [f"{self.path}/{n}" for n in names] or [self.path]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: Spark's own setting: the shuffle files of a query go when it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """In this block shuffle files go as soon as the query that wrote them has ended, not when the driver happens to collect garbage.

    Nothing made here may be run twice as the same frame; frames that are read
    again are kept as tables.
    """
    was = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, was)


#: A key of more rows than this may be hot; at most so many keys are.
HOT_ROWS, HOT_KEYS = 2_000, 50_000


def hot_limit(total: int) -> int:
    """Rows above which a key is hot: fewer than HOT_KEYS keys of `total` rows can be, so a row for each may be broadcast."""
    return max(HOT_ROWS, total // HOT_KEYS)


def join_by_key(rows: DataFrame, by_key: DataFrame, key: str, count: str, limit: int) -> DataFrame:
    """rows joined with the one row that by_key has for each key, less the column `count` (how many of rows have the key).

    Rows of hot keys meet their few partners by broadcast and are not shuffled,
    so no task gets all rows of a key; the others are shuffled by the key.
    """
    hot = durable(by_key.where(F.col(count) > limit).drop(count))
    cold = by_key.where(F.col(count) <= limit).drop(count)
    if hot.isEmpty():
        return rows.join(cold, key)
    few = F.broadcast(hot)  # fewer than HOT_KEYS rows, see hot_limit
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def in_test_fold(id_col: str, folds: int = 5) -> Column:
    """True for rows that a model may not learn from: crc32 of the id as text is 0 modulo folds, or the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


class Recent:
    """Values of short keys in two generations: what was not asked for during a whole generation is forgotten.

    make_all gives the values of a sorted list of new keys as a dict. At most
    twice `most` short keys are held, and the keys of the call that is running.
    """

    def __init__(self, make_all: Callable[[list[str]], dict], most: int, longest: int = 64):
        self.make_all, self.most, self.longest = make_all, most, longest
        self.now: dict = {}
        self.older: dict = {}

    def of(self, lists: list) -> list[list]:
        """For each list (or other collection) of keys the list of their values."""
        wanted = set().union(*lists)
        needed = [k for k in wanted if k not in self.now]
        if len(self.now) + len(needed) > self.most:
            self.older, self.now = self.now, {}
            needed = list(wanted)
        again = {k: self.older[k] for k in needed if k in self.older}
        fresh = self.make_all(sorted(k for k in needed if k not in again))
        self.now |= again
        self.now |= fresh
        out = [list(map(self.now.__getitem__, keys)) for keys in lists]
        for k in fresh:
            if len(k) > self.longest:  # hardly comes again
                del self.now[k]
        return out


_TABLES: dict[str, dict] = {}


def tables_of(operator: str, key, make: Callable):
    """make(), kept for the next tasks of this worker process that ask with the same key.

    Only the tables of one operator are kept at a time (the last two of them), so
    a worker that goes from stage to stage of a pipeline holds no more than one needs.
    """
    others = [o for o in _TABLES if o != operator]
    for other in others:
        del _TABLES[other]
    if others:
        give_back()
    kept = _TABLES.setdefault(operator, {})
    if key not in kept:
        while len(kept) >= 2:
            del kept[next(iter(kept))]
        kept[key] = make()
    return kept[key]


def appended(df: DataFrame, text_col: str, added: T.StructType, make: Callable[[], Callable[[list], list[list]]], buffer_bytes: int = 0) -> DataFrame:
    """df with the columns of `added`, computed from whole texts in Arrow batches.

    make() runs once in each task and gives a function from a list of texts
    (None for null) to one list of values for each added column; it gets SLICE_ROWS
    texts at a time or, if buffer_bytes is given, as many batches as have so many bytes.
    Columns of df that bear an added name are replaced.
    """
    small_batches(df.sparkSession)
    names = [f.name for f in added]
    kept = [c for c in df.columns if c not in names]
    held = "__text"
    while held in kept:
        held += "_"
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(held))
    schema = T.StructType([f for f in source.schema if f.name != held] + list(added))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        if not buffer_bytes:
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE_ROWS):
                    yield [whole.slice(at, SLICE_ROWS)]
            return
        some, size = [], 0
        for whole in batches:
            some.append(whole)
            size += whole.nbytes
            if size >= buffer_bytes:
                yield some
                some, size = [], 0
        if some:
            yield some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in added]
        work = make()
        for some in parts(batches):
            values = work([t for b in some for t in b.column(held).to_pylist()])
            at = 0
            for batch in some:
                cols = [batch.column(c) for c in batch.schema.names if c != held]
                names_out = [c for c in batch.schema.names if c != held] + names
                mine = [v[at : at + batch.num_rows] for v in values]
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays(cols + [pa.array(v, k) for v, k in zip(mine, kinds, strict=True)], names_out)
            del some, values, batch, cols, mine
        del work
        give_back()  # a worker waits for its next task with what it needs only

    return source.mapInArrow(run, schema)
