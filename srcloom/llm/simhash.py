"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a common variant: one that
differs from each of them in at most r/2 bits. So every fingerprint stands for
all its variants within half the radius, variants meet in a shuffle, and those
that share a variant are compared.

A 64-bit fingerprint has 2,081 variants within two bits. They are shuffled on
their leading bits: the row (leading bits, fingerprint) stands for all variants
of the fingerprint with those leading bits, and the task that owns the leading
bits writes the variants out, in blocks of bounded size. With t leading bits a
fingerprint is sent 1 + t + t(t-1)/2 times instead of 2,081 times, and no
variant is left out.

Fingerprints are made distinct first, so a group of exact copies counts once.
Links between distinct fingerprints that meet in a task are reduced to a
spanning star for each connected group there, so their number grows with the
fingerprints and not with the pairs.

Defined cases: a null text is empty; a text without words has fingerprint zero
and links like any other; repeated rows and equal ids are kept, each with its
component; a null id gets a component but never names one (a component of null
ids only is null). Columns of the documents that bear a name of an added column
are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import overlap
from .common import Scratch, appended, durable, give_back, hot_limit, join_by_key, shuffles_freed, table, tables_of
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Variants that a task writes out at one time.
BLOCK_VARIANTS = 1_000_000
#: Fingerprints that may be sent to the same leading bits before those are lengthened, by how many bits, and leads above which at most so many are.
HOT_LEAD, MORE_BITS, HOT_KEYS = 100_000, 16, 2_000
#: Shingle hashes that a task unpacks to bits at one time.
BLOCK_HASHES = 65_536
#: Keys of rows (id and text hash) that are sent to all tasks rather than shuffling the texts, at most.
FEW_KEYS = 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = ("" if text is None else text).encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(line, SEED)  # over half of one hash: its own bits
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1).tolist()
    hashes = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK_HASHES):
        some = np.array(hashes[at : at + BLOCK_HASHES], dtype="<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def signed(fp: int) -> int:
    """The same 64 bits as a signed number."""
    return fp - (1 << 64) if fp >> 63 else fp


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, name: str = "fingerprint") -> DataFrame:
    """docs with the 64-bit fingerprint as a long (the same bits, signed)."""

    def make():
        tables_of("near-duplicates", 0, dict)  # makes room: nothing is kept here
        return lambda texts: [np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)]

    return appended(docs, text_col, T.StructType([T.StructField(name, T.LongType())]), make)


def _masks(bits: int, most: int) -> list[np.ndarray]:
    """For each r up to most: the masks of at most r of the low bits."""
    out, so_far = [], []
    for r in range(most + 1):
        so_far += [sum(1 << i for i in c) for c in combinations(range(bits), r)]
        out.append(np.array(so_far, dtype=np.uint64))
    return out


def leading_bits(n_fingerprints: int) -> int:
    """So many that about a thousand fingerprints have the same leading bits."""
    return min(40, max(6, math.ceil(math.log2(max(2, n_fingerprints))) - 10))


def links(fingerprints: DataFrame, radius: int = RADIUS, lead: int | None = None, block_variants: int = BLOCK_VARIANTS, hot_rows: int = HOT_LEAD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp, signed longs) that have the same components as all pairs within the radius."""
    half, odd = divmod(radius, 2)
    if odd:
        raise ValueError("the radius must be even: each side takes half of it")
    total = fingerprints.count()
    lead = lead or leading_bits(total)
    low = BITS - lead
    flips = lambda bits: F.explode(F.array(*[F.struct(F.lit(sum(1 << i for i in c)).cast("long").alias("bits"), F.lit(r).alias("n")) for r in range(half + 1) for c in combinations(range(bits), r)]))
    sent = fingerprints.select("fp", flips(lead).alias("flip")).select("fp", F.shiftrightunsigned("fp", low).bitwiseXOR(F.col("flip.bits")).alias("lead"), F.col("flip.n").alias("used"))
    limit = max(hot_rows, total // HOT_KEYS)
    # fewer than HOT_KEYS * len(flips) leads have so many rows
    hot = durable(sent.groupBy("lead").count().where(F.col("count") > limit).select("lead"))
    if hot.isEmpty():
        return _met(sent, low, half, radius, block_variants).distinct()
    few = F.broadcast(hot)
    more = low - MORE_BITS
    longer = sent.join(few, "lead").select("fp", "lead", "used", flips(MORE_BITS).alias("flip")).where(F.col("used") + F.col("flip.n") <= half)
    next_bits = F.shiftrightunsigned("fp", more).bitwiseAND(F.lit((1 << MORE_BITS) - 1)).bitwiseXOR(F.col("flip.bits"))
    longer = longer.select("fp", F.shiftleft("lead", MORE_BITS).bitwiseOR(next_bits).alias("lead"))
    rest = sent.join(few, "lead", "left_anti")
    return _met(rest, low, half, radius, block_variants).unionByName(_met(longer, more, half, radius, block_variants)).distinct()


def _met(sent: DataFrame, low: int, half: int, radius: int, block_variants: int) -> DataFrame:
    """Stars of the fingerprints that meet in a variant with the leading bits they are sent to; low bits follow those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables_of("near-duplicates", 0, dict)
        masks = _masks(low, half)
        for leads, fps in _whole_groups(batches):
            a, b = _meet(leads, fps, masks, low, half, radius, block_variants)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
            del leads, fps, a, b
        give_back()

    return sent.select("fp", "lead").repartition("lead").sortWithinPartitions("lead").mapInArrow(run, "a long, b long")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows sorted by lead, cut only between two leads: the last lead of a batch waits for the next batch."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        fps, leads = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "lead"))
        cut = int(np.searchsorted(leads, leads[-1]))
        if cut or (held and held[-1][0][-1] != leads[0]):
            ready = held + [(leads[:cut], fps[:cut])]
            held = []
            yield _together(ready)
        held.append((leads[cut:], fps[cut:]))
    if held:
        yield _together(held)


def _together(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]).view(np.uint64)


def _meet(leads: np.ndarray, fps: np.ndarray, masks: list[np.ndarray], low: int, half: int, radius: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each group of fingerprints that share variants with these leads."""
    left = half - np.bitwise_count((fps >> np.uint64(low)) ^ leads.astype(np.uint64)).astype(np.int64)
    base = (leads.astype(np.uint64) << np.uint64(low)) | (fps & np.uint64((1 << low) - 1))
    sizes = np.array([len(m) for m in masks])
    order = np.argsort(leads, kind="stable")
    leads, fps, left, base = leads[order], fps[order], left[order], base[order]
    weight = sizes[left]
    cuts = np.flatnonzero(np.r_[True, leads[1:] != leads[:-1]])
    out_a, out_b = [], []
    total = np.add.reduceat(weight, cuts)
    ends = np.r_[cuts[1:], len(leads)]
    at = 0
    while at < len(cuts):
        upto = at + 1
        volume = total[at]
        while upto < len(cuts) and volume + total[upto] <= most:
            volume += total[upto]
            upto += 1
        rows = slice(cuts[at], ends[upto - 1])
        passes = 1 << max(0, math.ceil(math.log2(max(1, volume / most))))  # one lead with very many variants is worked off by their next bits
        a, b = _stars(base[rows], fps[rows], left[rows], masks, low, passes, radius)
        out_a.append(a)
        out_b.append(b)
        at = upto
    return np.concatenate(out_a), np.concatenate(out_b)


def _stars(base: np.ndarray, fps: np.ndarray, left: np.ndarray, masks: list[np.ndarray], low: int, passes: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    names, who = np.unique(fps, return_inverse=True)
    root = np.arange(len(names))
    step = np.uint64(max(0, low - int(math.log2(passes))))
    for p in range(passes):
        variants, owner = [], []
        for r, mask in enumerate(masks):
            rows = np.flatnonzero(left == r)
            for at in range(0, len(rows), max(1, BLOCK_VARIANTS // len(mask))):
                some = rows[at : at + max(1, BLOCK_VARIANTS // len(mask))]
                v = (base[some][:, None] ^ mask[None, :]).ravel()
                o = np.repeat(who[some], len(mask))
                if passes > 1:
                    mine = ((v >> step) & np.uint64(passes - 1)) == p
                    v, o = v[mine], o[mine]
                variants.append(v)
                owner.append(o)
        v, o = np.concatenate(variants), np.concatenate(owner)
        order = np.argsort(v)
        v, o = v[order], o[order]
        same = np.flatnonzero(v[1:] == v[:-1])
        if not len(same):
            continue
        pairs = np.unique(np.sort(np.stack([o[same], o[same + 1]], axis=1), axis=1), axis=0)  # neighbours in the order of variants: a path through each meeting
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        near = np.bitwise_count(names[pairs[:, 0]] ^ names[pairs[:, 1]]) <= radius
        root = _joined(root, pairs[near])
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def _joined(root: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Roots after joining the pairs: the least index of each group."""
    while True:
        a, b = root[pairs[:, 0]], root[pairs[:, 1]]
        differ = a != b
        if not differ.any():
            return root
        top, bottom = np.maximum(a, b)[differ], np.minimum(a, b)[differ]
        np.minimum.at(root, top, bottom)
        while (again := root[root] != root).any():
            root = np.where(again, root[root], root)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 hex digits), component_id (the least id reachable)."""
    ids = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    marked = durable(with_fingerprint(ids, "__t", shingle, "__fp").select("__id", "__fp"))
    # distinct fingerprints, each with its least id; a document group of any size is one row here
    groups = durable(marked.groupBy("__fp").agg(F.min("__id").alias("__least"), F.count("*").alias("__n")))
    limit = hot_limit(marked.count())
    roots = components(links(groups.select(F.col("__fp").alias("fp")), radius))
    named = durable(groups.join(roots, groups["__fp"] == roots["node"], "left").select("__fp", "__least", "__n", F.coalesce("root", "__fp").alias("__root")))
    least = named.groupBy("__root").agg(F.min("__least").alias("component_id"), F.count("*").alias("__members"))
    by_fp = durable(join_by_key(named, least, "__root", "__members", limit).select("__fp", "__n", "component_id"))
    out = join_by_key(marked, by_fp, "__fp", "__n", limit)
    return out.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def _linked(marked: DataFrame, radius: int) -> DataFrame:
    """(__fp, __n, __root): every fingerprint of marked, how many rows have it, and the least one that it can reach."""
    groups = durable(marked.groupBy("__fp").agg(F.count("*").alias("__copies")))
    roots = components(links(groups.select(F.col("__fp").alias("fp")), radius))
    return groups.join(roots, groups["__fp"] == roots["node"], "left").select("__fp", "__copies", F.coalesce("root", "__fp").alias("__root"))


def _rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, similar: bool, scratch: Scratch) -> tuple[DataFrame, int]:
    """(__id, __h, __root) for each row of docs: id, text hash, component; and how many rows of one key are many."""
    ids = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).withColumn("__h", F.xxhash64("__t"))
    if similar:
        both = overlap.with_prefix(ids, "__t", T.StructField("__fp", T.LongType()), lambda t: signed(fingerprint(t, shingle)))
    else:
        both = with_fingerprint(ids, "__t", shingle, "__fp")
    marked = scratch.stored(both.drop("__t"), "marked")
    limit = hot_limit(marked.count())
    named = join_by_key(marked.drop("__prefix"), durable(_linked(marked, radius)), "__fp", "__copies", limit)
    if not similar:
        return named.select("__id", "__h", "__root"), limit
    named = scratch.stored(named, "named")
    shared = scratch.stored(overlap.shared_shingles(marked.select("__key", "__n", "__prefix")), "shared")
    scratch.drop("marked")
    roots = overlap.connected(docs, text_col, named.withColumnRenamed("__root", "node"), shared, scratch)
    members = named.groupBy("__root").agg(F.count("*").alias("__members"))
    last = durable(members.join(roots, F.col("__root") == F.col("node"), "left").select("__root", "__members", F.coalesce("root", "__root").alias("__last")))
    return durable(join_by_key(named.select("__id", "__h", "__root"), last, "__root", "__members", limit).select("__id", "__h", F.col("__last").alias("__root"))), limit


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, similar: bool = False) -> DataFrame:
    """Of each component the first row by id and text hash; rows with a null id can't be told apart and stay.

    similar also links texts whose five-word shingles overlap by 0.8 or more
    (overlap.py), whatever their fingerprints. Rows go by their own text: one
    whose id is repeated stays if nothing is linked to its text. Of rows with
    equal id and text one stays, the one whose other columns have the least hash.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    with shuffles_freed(docs.sparkSession):
        every, limit = _rows(docs, id_col, text_col, shingle, radius, similar, scratch)
        rows = durable(every.where("__id is not null").groupBy("__id", "__h", "__root").agg(F.count("*").alias("n")))
        scratch.drop()
        first = durable(rows.groupBy("__root").agg(F.min(F.struct("__id", "__h")).alias("first"), F.count("*").alias("__members")))
        dropped = durable(join_by_key(rows, first, "__root", "__members", limit).where("struct(__id, __h) <> first").select("__id", "__h"))
        twice = durable(rows.where("n > 1").select("__id", "__h"))
    # a copy of few keys goes to every task, so that whole texts are not shuffled
    dropped, twice = (F.broadcast(t) if t.count() <= FEW_KEYS else t for t in (dropped, twice))
    this = lambda of: (docs[f"`{id_col}`"] == of["__id"]) & (F.xxhash64(docs[f"`{text_col}`"]) == of["__h"])
    kept = docs.join(dropped, this(dropped), "left_anti")
    if twice.isEmpty():
        return kept
    again = kept.join(twice, this(twice), "left_semi").select(*docs.columns)
    single = again.groupBy(id_col, F.xxhash64(text_col)).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(F.to_json(F.struct(*docs.columns)))).alias("__row")).select("__row.*")
    return kept.join(twice, this(twice), "left_anti").select(*docs.columns).unionByName(single)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
