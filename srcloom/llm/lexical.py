"""Exact ranked lexical search by inner products over sparse ball trees.

A document is the sparse vector of the impacts of its terms, a query the sparse
vector of the weights of its terms; the score is their inner product. All numbers
are whole, so scores are exact and the ranking has no rounding:

    weight of a term      floor(1000 * ln((2 N + 2) / (2 df + 1)))
    m of a document       100 - 75 + (75 n N) div L
    impact of a term      (10^9 tf) div (1000 tf + 8 m)

N counts the documents with a term, L all terms, n those of a document, tf the
occurrences of a term in a document, df the documents that hold it.

Search takes two passes. The first reads each text once and keeps, of each
document, the number of its terms and the terms that some query has; N, L and df
are sums over that table. In the second, each task builds ball trees over blocks
of its documents (at most BLOCK documents or CELLS terms, so its memory is
bounded) and searches each of them for all queries: a node is a set of documents
with its centroid c and its radius r, the largest distance of a document from c.
No document of the node scores more than q.c + |q| r; the nodes are visited from
the highest bound down until a bound falls below the k-th score that the task
knows already. Bounds are rounded upwards by more than all rounding errors
(EPSILON), so pruning never loses a result. Documents in leaves are scored in whole
numbers. Each task gives k rows for a query, and a ranking by query keeps the best k.

Terms are maximal runs of 0-9, A-Z, a-z and characters beyond ASCII; A-Z become
a-z. Queries are held by every task, in blocks of at most QUERY_BYTES of text;
each block takes one search of its own.

Defined cases: documents without a term (null, empty) count nowhere and are never
found; queries without a term have no rows; queries equal in id and text count
once, and queries that share an id only are ranked each on its own; rows with a
repeated id are documents of their own; equal scores go by ascending id, null ids
last; empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, fresh_path, table, tables_of
from .decontam import normalised

K = 10
QUERY_BYTES = 1 << 20
BLOCK, CELLS, LEAF = 8_192, 1 << 21, 24
#: Numbers in the centroids of a tree, about: a larger vocabulary makes smaller blocks.
CENTRES = 1 << 23
#: Relative error granted to a bound; the true one is below 1e-11 for a hundred thousand terms.
EPSILON = 1e-9


def terms(text: str | None) -> list[bytes]:
    return normalised(text).split()


class Queries:
    """The queries of a block: their ids and texts, the vocabulary they share, and the terms of each with their counts."""

    def __init__(self, rows: list[tuple[object, str]]):
        self.ids: list = []
        self.vocabulary: dict[bytes, int] = {}
        self.terms: list[tuple[np.ndarray, np.ndarray]] = []
        for query_id, text in rows:
            found = Counter(self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms(text))
            if found:
                self.ids.append(query_id)
                self.terms.append((np.array(list(found), np.int64), np.array(list(found.values()), np.int64)))


def query_blocks(queries: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """Distinct queries in blocks of about block_bytes; one block at a time is on the driver."""
    rows = queries.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r.i, r.t) for r in part.toLocalIterator()]


def term_table(docs: DataFrame, id_col: str, text_col: str, sent) -> DataFrame:
    """id, n (terms of the text) and, of the queries' vocabulary, at (ascending places) and tf. Rows without a term are left out."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))
    schema = T.StructType([rows.schema["id"], T.StructField("n", T.LongType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _queries(sent).vocabulary
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(first, SLICE_ROWS)
                kept, n, at, tf = [], [], [], []
                for k, text in enumerate(batch.column("t").to_pylist()):
                    words = terms(text)
                    if words:
                        found = sorted((vocabulary[w], c) for w, c in Counter(filter(vocabulary.__contains__, words)).items())
                        kept.append(k)
                        n.append(len(words))
                        at.append([v for v, _ in found])
                        tf.append([c for _, c in found])
                lists = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(kept, pa.int64())), pa.array(n, pa.int64()), pa.array(at, lists), pa.array(tf, lists)], schema.names)

    return rows.mapInArrow(run, schema)


def _queries(sent) -> Queries:
    return tables_of("lexical", sent.value[0], lambda: Queries(sent.value[1]))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class BallTree:
    """A ball tree over sparse rows of whole numbers: row k has values[starts[k]:starts[k + 1]] at the ascending places at[...]."""

    def __init__(self, at: np.ndarray, values: np.ndarray, starts: np.ndarray, width: int, leaf: int = LEAF):
        self.at, self.values, self.starts, self.width = at, values, starts, width
        self.floats = values.astype(float)
        self.squares = np.add.reduceat(self.floats**2, starts[:-1]) if len(starts) > 1 else np.zeros(0)
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        pending = [(np.arange(len(starts) - 1), -1, 0)]
        while pending:
            rows, parent, side = pending.pop()
            node = len(self.rows)
            if parent >= 0:
                a, b = self.children[parent]
                self.children[parent] = (node, b) if side == 0 else (a, node)
            centre = self._centre(rows)
            apart = self._apart(rows, centre)
            self.rows.append(rows)
            self.centres.append(centre)
            self.radii.append(math.sqrt(float(apart.max(initial=0.0))))
            self.children.append(None)
            if len(rows) > leaf:
                left = self._halves(rows, apart)
                self.children[node] = (-1, -1)
                self.rows[node] = rows[:0]
                pending += [(rows[left], node, 0), (rows[~left], node, 1)]

    def _cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of all values of the rows, and where each row's begin among them."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        begins = np.cumsum(sizes) - sizes
        return np.repeat(self.starts[rows] - begins, sizes) + np.arange(int(sizes.sum())), begins

    def _centre(self, rows: np.ndarray) -> np.ndarray:
        cells, _ = self._cells(rows)
        return np.bincount(self.at[cells], self.floats[cells], self.width) / max(1, len(rows))

    def _apart(self, rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Squared distances from the centre, not below the true ones."""
        if not len(rows):
            return np.zeros(0)
        cells, begins = self._cells(rows)
        along = np.add.reduceat(self.floats[cells] * centre[self.at[cells]], begins)
        whole = self.squares[rows] + float(centre @ centre)
        return np.maximum(whole - 2 * along, 0) + EPSILON * whole

    def _halves(self, rows: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Which rows are nearer to the row farthest from the centre than to the row farthest from that one; halves if that parts nothing."""
        one = self._apart(rows, self._centre(rows[[int(apart.argmax())]]))
        two = self._apart(rows, self._centre(rows[[int(one.argmax())]]))
        left = one < two
        if not len(rows) // 16 <= left.sum() <= len(rows) - len(rows) // 16 or left.all() or not left.any():
            left = np.zeros(len(rows), bool)
            left[np.argsort(one - two, kind="stable")[: len(rows) // 2]] = True
        return left

    def bounds(self, places: np.ndarray, weights: np.ndarray, nodes: list[int]) -> list[float]:
        """What no row of the nodes scores above."""
        length = math.sqrt(float((weights.astype(float) ** 2).sum()))
        return [(float(self.centres[k][places] @ weights) + length * self.radii[k]) * (1 + EPSILON) + 1 for k in nodes]

    def search(self, places: np.ndarray, weights: np.ndarray, best: list, k: int, key_of) -> int:
        """Puts the rows that belong to the best k into the heap `best` of (score, key); returns how many rows were scored."""
        if not self.rows or not self.starts[-1]:
            return 0
        dense = np.zeros(self.width, np.int64)
        dense[places] = weights
        queue = [(-self.bounds(places, weights, [0])[0], 0)]
        scored = 0
        while queue:
            bound, node = heapq.heappop(queue)
            if len(best) == k and -bound < best[0][0]:
                break  # equal bounds are followed: an equal score may have a smaller id
            inner = self.children[node]
            if inner is not None:
                for bound, child in zip(self.bounds(places, weights, list(inner)), inner, strict=True):
                    if len(best) < k or bound >= best[0][0]:
                        heapq.heappush(queue, (-bound, child))
                continue
            rows = self.rows[node]
            cells, begins = self._cells(rows)
            scores = np.add.reduceat(self.values[cells] * dense[self.at[cells]], begins)
            scored += len(rows)
            least = best[0][0] if len(best) == k else 1
            for j in np.flatnonzero(scores >= max(1, least)).tolist():
                entry = (int(scores[j]), key_of(int(rows[j])))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return scored


class _Last:
    """Order of ids within equal scores turned round: the smallest id counts most, null least."""

    __slots__ = ("id",)

    def __init__(self, value):
        self.id = value

    def __lt__(self, other):
        return other.id is not None and (self.id is None or self.id > other.id)

    def __eq__(self, other):
        return self.id == other.id


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", k: int = K, query_bytes: int = QUERY_BYTES, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """(query id, rank, id, score): the k documents with the highest scores above 0 for each query."""
    spark = docs.sparkSession
    found = None
    for rows in query_blocks(queries, query_id, query_text, query_bytes):
        part = _search_block(spark, docs, queries.schema[query_id].dataType, rows, id_col, text_col, query_id, k, block, cells)
        found = part if found is None else found.unionByName(part)
    return found


def _search_block(spark: SparkSession, docs: DataFrame, query_type: T.DataType, rows: list, id_col: str, text_col: str, query_id: str, k: int, block: int, cells: int) -> DataFrame:
    asked = Queries(rows)
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, rows))
    path = fresh_path(spark, "terms")
    term_table(docs, id_col, text_col, sent).write.parquet(path)
    kept = spark.read.parquet(path)
    n_docs, n_terms = kept.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(kept.select(F.explode("at").alias("v")).groupBy("v").count().collect())  # at most the terms of a block of queries
    weights = np.array([weight(n_docs, df.get(v, 0)) for v in range(len(asked.vocabulary))], np.int64)
    known = spark.sparkContext.broadcast(weights)
    schema = T.StructType([T.StructField("q", T.IntegerType()), kept.schema["id"], T.StructField("score", T.LongType())])
    vectors = kept.where(F.size("at") > 0).withColumn("m", F.lit(25).cast("long") + F.expr(f"(75 * n * {n_docs}L) div {max(1, n_terms)}L"))
    vectors = vectors.select("id", "m", "at", "tf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = _queries(sent)
        asked_for = [(places, known.value[places] * counts) for places, counts in mine.terms]
        best: list[list] = [[] for _ in mine.terms]
        held: list[pa.RecordBatch] = []

        def work() -> None:
            ids = [i for b in held for i in b.column("id").to_pylist()]
            sizes = np.concatenate([np.diff(b.column("at").offsets.to_numpy()) for b in held])
            at = np.concatenate([b.column("at").flatten().to_numpy() for b in held]).astype(np.int64)
            tf = np.concatenate([b.column("tf").flatten().to_numpy() for b in held]).astype(np.int64)
            m = np.concatenate([b.column("m").to_numpy() for b in held])
            held.clear()
            impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes))
            tree = BallTree(at, impacts, np.concatenate([[0], np.cumsum(sizes)]), len(known.value))
            for (places, w), heap in zip(asked_for, best, strict=True):
                tree.search(places, w, heap, k, lambda row: _Last(ids[row]))

        most = max(64, min(block, CENTRES * LEAF // (3 * max(1, len(known.value)))))
        n_rows = n_cells = 0
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE_ROWS):
                held.append(whole.slice(first, SLICE_ROWS))
                n_rows += held[-1].num_rows
                n_cells += int(np.diff(held[-1].column("at").offsets.to_numpy()).sum())
                if n_rows >= most or n_cells >= cells:
                    work()
                    n_rows = n_cells = 0
        if held:
            work()
        flat = [(q, e[1].id, e[0]) for q, heap in enumerate(best) for e in heap]
        id_type = whole.schema.field("id").type if flat else None
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], id_type), pa.array([x[2] for x in flat], pa.int64())], schema.names)

    best = vectors.mapInArrow(run, schema)
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, i) for q, i in enumerate(asked.ids)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item", query_type)]))
    return ranked.join(F.broadcast(names), "q").select(F.col("item").alias(query_id), "rank", F.col("id").alias(id_col), "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
with d as (
    select row_number() over () as k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
    from documents where text is not null
), docs as (select k, doc_id, w, len(w)::bigint as n from d where len(w) > 0),
corpus as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from docs),
i as (
    select row_number() over () as q, item_id, text from (select distinct item_id, text from benchmark where text is not null)
), asked as (
    select q, item_id, t, count(*)::bigint as times from (
        select q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from i)
    group by all
), held as (
    select k, doc_id, n, t, count(*)::bigint as tf from (select k, doc_id, n, unnest(w) as t from docs)
    where t in (select t from asked) group by all
), weights as (
    select t, cast(floor(1000 * ln((2 * max(big_n) + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from held, corpus group by t
), scores as (
    select q, item_id, k, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * big_n) // big_l))))) as bigint) as score
    from asked join held using (t) join weights using (t), corpus group by q, item_id, k, doc_id
), ranked as (
    select item_id, row_number() over (partition by q order by score desc, doc_id asc nulls last) as rank, doc_id, score from scores where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""
