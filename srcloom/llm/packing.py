"""Vector best-fit packing of tokenized documents into sequences.

A document's ids (with the end id) are one piece, or pieces of exactly
`capacity` ids behind a first one that may be shorter. A piece is a vector: its
tokens, one document, and its attention cost (tokens squared). A sequence has a
capacity in each of the three. Pieces are taken by falling length; each goes to
the open sequence that has room for it in every dimension and the best score:

    norm   the least weighted norm of what is left after placing it
    dot    the greatest weighted dot product of the piece and what is left before

and to a new sequence if none has room. Dimensions count as shares of their
capacity. Of equal scores the fuller sequence in tokens, documents and cost is taken.

A piece's vector follows from its length, so pieces of one length are
interchangeable, and so are open sequences with equal rooms. Hence the packing
needs no pieces, only how many there are of each length: at most `capacity`
numbers, summed up by Spark. best_fit() packs these counts, placing whole runs of
equal pieces into whole runs of equal sequences, with the same result as placing
one piece after the other. It yields runs: pieces number lo to hi - 1 of a length
stand at one offset of consecutive sequences. A piece finds its place by its
length and its number among the pieces of that length, so the packing is global,
whatever the number of tasks, and no task or driver sees more than counts.

Every placement empties a run of open sequences or the pieces of a length, so
there are at most 2 * capacity runs open and some capacity ** 2 runs in all,
however many documents there are. Up to BROADCAST of them are sent to all tasks;
more meet the pieces by length and salt.

Defined cases: a null text is an empty one, so it has the end id only; rows with a
null or repeated id are packed like any other; without an end id an empty text has
no piece; a piece that exceeds the capacities of an empty sequence (where attention
cost is capped below capacity squared) is an error, raised before anything is
placed; an empty table gives no rows; columns other than id and text are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, fresh_path, table
from .planes import END_ID, loaded, tokenizer_path

CAPACITY = 1024
#: Weights of tokens, documents and attention cost in the score.
WEIGHTS = (1.0, 0.001, 0.001)
#: Runs that are sent to all tasks at most (some 40 bytes each), and copies of each where there are more.
BROADCAST, SALTS = 200_000, 64


def cuts(n: int, capacity: int) -> list[int]:
    """Where the pieces of n ids begin."""
    return [0, *range((n - 1) % capacity + 1, n, capacity)] if n else []


def token_pieces(docs: DataFrame, id_col: str, text_col: str, file: str | None, end_id: int | None, capacity: int, keep_ids: bool) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, (ids,) and its number `nth` among those of its length in its task `part`."""
    source = file or tokenizer_path()
    end = b"" if end_id is None else struct.pack("<I", end_id)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))
    fields = [rows.schema["id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())]
    fields += [T.StructField("ids", T.BinaryType())] * keep_ids
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = loaded(source), TaskContext.get().partitionId()
        so_far = np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                row, piece, start, length, crc, nth, kept = [], [], [], [], [], [], []
                for k, some in enumerate(encoder.encode_all(batch.column("t").to_pylist())):
                    ids = some + end
                    places = [*cuts(len(ids) // 4, capacity), len(ids) // 4]
                    for p, (a, b) in enumerate(pairwise(places)):
                        mine = ids[4 * a : 4 * b]
                        row.append(k)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(mine))
                        nth.append(int(so_far[b - a]))
                        so_far[b - a] += 1
                        if keep_ids:
                            kept.append(mine)
                ids_of = batch.column("id").take(pa.array(row, pa.int64()))
                columns = [ids_of, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, schema.names)

    return rows.mapInArrow(run, schema)


class _Open:
    """Open sequences by their rooms: (tokens, documents, cost) left, and the runs of sequences that have just that."""

    def __init__(self, capacities: tuple[int, int, int], weights: tuple[float, float, float], by: str):
        if by not in ("norm", "dot"):
            raise ValueError(f"score by 'norm' or 'dot', not {by!r}")
        self.full, self.by = capacities, by
        self.scale = np.array(capacities, float)
        self.weights = np.array(weights, float)
        self.rooms = np.zeros((0, 3), np.int64)
        self.runs: list[list[tuple[int, int]]] = []
        self.place: dict[tuple, int] = {}

    def scores(self, rooms: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The smaller the better; infinite where there is no room."""
        if self.by == "norm":
            found = (self.weights * ((rooms - item) / self.scale) ** 2).sum(1)
        else:
            found = -(self.weights * (rooms / self.scale) * (item / self.scale)).sum(1)
        return np.where((rooms >= item).all(1), found, np.inf)

    def best(self, item: np.ndarray, but: int = -1) -> tuple[float, tuple, int]:
        """Score, rooms and place of the best class, the class `but` aside; place -1 if none has room."""
        if not len(self.runs):
            return np.inf, (), -1
        found = self.scores(self.rooms, item)
        if but >= 0:
            found[but] = np.inf
        least = found.min()
        if least == np.inf:
            return np.inf, (), -1
        rooms, at = min((tuple(map(int, self.rooms[k])), int(k)) for k in np.flatnonzero(found == least))
        return float(least), rooms, at

    def add(self, rooms: tuple, runs: list[tuple[int, int]]) -> None:
        if rooms[0] <= 0 or rooms[1] <= 0 or rooms[2] <= 0:
            return  # full: nothing has a length of zero
        if rooms not in self.place:
            self.place[rooms] = len(self.runs)
            self.runs.append([])
            self.rooms = np.vstack([self.rooms, np.array([rooms], np.int64)])
        self.runs[self.place[rooms]] += runs

    def take(self, at: int, n: int) -> list[tuple[int, int]]:
        """n sequences of a class, as runs."""
        out, runs = [], self.runs[at]
        while n:
            a, b = runs.pop()
            if b - a > n:
                runs.append((a + n, b))
                b = a + n
            out.append((a, b))
            n -= b - a
        if not runs:
            del self.place[tuple(map(int, self.rooms[at]))]
            last = len(self.runs) - 1
            if at != last:
                self.runs[at], self.rooms[at] = self.runs[last], self.rooms[last]
                self.place[tuple(map(int, self.rooms[at]))] = at
            self.runs.pop()
            self.rooms = self.rooms[:last].copy()
        return out


def best_fit(counts: dict[int, int], capacities: tuple[int, int, int], weights: tuple[float, float, float] = WEIGHTS, by: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """Runs (length, lo, hi, sequence, offset): piece number r of the length, lo <= r < hi, is in sequence + r - lo at offset."""
    opened, new, out = _Open(capacities, weights, by), 0, []
    for length in sorted(counts, reverse=True):
        left, number = counts[length], 0
        item = np.array([length, 1, length * length], np.int64)
        if left and (item > np.array(capacities)).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities {capacities}")
        while left:
            _, rooms, at = opened.best(item)
            fresh = at < 0
            if fresh:
                rooms = capacities
            available = left if fresh else sum(b - a for a, b in opened.runs[at])
            # what the next pieces do: as long as the sequence that took the last one is the best for the next
            other = opened.best(item, -1 if available > 1 or fresh else at)
            after, chain = tuple(int(x) for x in np.array(rooms) - item), 1
            while chain < left:
                score = float(opened.scores(np.array([after], np.int64), item)[0])
                if score == np.inf or (score, after) > (other[0], other[1] or after):
                    break
                after, chain = tuple(int(x) for x in np.array(after) - item), chain + 1
            # the last of its class has other rivals, so it is looked at again
            alike = available - 1 if other[2] == at and not fresh and available > 1 else available
            sequences = max(1, min(alike, left // chain))
            if fresh:
                runs, new = [(new, new + sequences)], new + sequences
            else:
                runs = opened.take(at, sequences)
            for a, b in runs:
                for k in range(chain):
                    out.append((length, number, number + b - a, a, capacities[0] - rooms[0] + k * length))
                    number += b - a
            opened.add(after, runs)
            left -= chain * sequences
    return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    file: str | None = None,
    end_id: int | None = END_ID,
    capacity: int = CAPACITY,
    max_documents: int | None = None,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    by: str = "norm",
    keep_ids: bool = False,
    broadcast: int = BROADCAST,
) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id and offset, with keep_ids also ids (little-endian, 4 bytes each).

    Sequences hold at most `capacity` tokens, `max_documents` pieces and `max_cost`
    attention cost; the defaults of the last two never bind. Texts are encoded once
    and not shuffled; the rows of pieces are written to the shared folder.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "pieces")
    token_pieces(docs, id_col, text_col, file, end_id, capacity, keep_ids).write.parquet(path)
    pieces = spark.read.parquet(path)
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = best_fit(counts, (capacity, max_documents or capacity, max_cost or capacity * capacity), weights, by)
    plan = spark.createDataFrame([list(r) for r in runs], "length long, lo long, hi long, sequence long, offset long")
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    numbered = pieces.join(before, ["part", "length"]).withColumn("number", F.col("nth") + F.col("before"))
    if len(runs) <= broadcast:
        plan, keys = F.broadcast(plan), ["length"]
    else:
        numbered = numbered.withColumn("salt", F.pmod("number", F.lit(SALTS)))
        plan, keys = plan.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["length", "salt"]
    placed = numbered.join(plan, keys).where("number >= lo and number < hi")
    kept = [F.col("ids")] * keep_ids
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("number") - F.col("lo")).alias("sequence_id"), "offset", *kept)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, n_tokens, ids): the ids of each sequence, of the rows of pack(keep_ids=True). A sequence has at most `capacity` pieces."""
    of = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    made = packed.groupBy("sequence_id").agg(of.alias("p"), F.sum("length").alias("n_tokens"))
    empty = F.lit(b"").cast("binary")
    return made.select("sequence_id", F.size("p").alias("n_pieces"), "n_tokens", F.aggregate("p", empty, lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
