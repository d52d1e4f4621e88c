"""Document fingerprints by winnowing, with DataFrame functions only.

Words (lower-cased, cut at ASCII white space) give k-gram hashes; of each window
of w neighbouring k-grams the least hash is chosen, of equal ones the rightmost,
and each choice is kept once with its position. A passage of at least w + k - 1
words that two texts share has a choice in common.

While windows are compared, a gram is one long: HASH_BITS bits of its hash above
bits that fall as the position rises, so that the least number is the least hash
and, of equals, the rightmost. Neighbouring windows that chose the same gram
have equal numbers side by side. Positions are kept modulo 2 to the
POSITION_BITS in it; in longer texts windows over that border are compared with
shifted positions, and the full position comes from the window's own.

Neighbours ("the next document" in descending id order) come from a window over
buckets of id ranges, never over the whole table: quantiles of the ids, cut
evenly inside, give buckets of about BUCKET_ROWS rows; each bucket also gets a
copy of the first document of the bucket that follows it. Equal ids are ordered
by the hash of their text, then the text, both descending; null ids come last.
An id (or null) with more rows than a bucket has is cut into buckets by that
hash, and its equal rows are one row with a count until the end.

Likeness of two fingerprints is the share of common hashes among all of both
(positions left aside); two empty fingerprints are alike (1), an empty and a
filled one are not (0).

Defined cases: a null text is empty; a text without words has the empty
fingerprint; a text of fewer words than k has one gram of all of them; of fewer
grams than w one window; a single document is its own next document. Ids are
whole numbers. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, table

GRAM, WINDOW = 5, 8
HASH_BITS, POSITION_BITS = 37, 26
BUCKET_ROWS = 400
QUANTILES = 512
#: Buckets that one task orders.
RING = 1000


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def choices(text: Column, gram: int = GRAM, window: int = WINDOW, position_bits: int = POSITION_BITS) -> Column:
    """The winnowed choices of a text as an array of (hash, position), in order of position."""
    room = (1 << position_bits) - 1
    words = F.filter(F.split(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")

    def hashed(ws: Column) -> Column:
        grams = F.greatest(F.size(ws) - (gram - 1), F.least(F.size(ws), F.lit(1)))
        key = lambda w, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(w, *[F.get(ws, i + d) for d in range(1, gram)]), 64 - HASH_BITS), position_bits).bitwiseOR(F.lit(room) - i.bitwiseAND(room))
        return F.transform(F.slice(ws, F.lit(1), grams), key)

    # of windows with the same choice the first stays
    changes = lambda ms, same: F.filter(ms, lambda m, i: (i == 0) | (same(m) != same(F.get(ms, i - 1))))

    def chosen(keys: Column) -> Column:
        windows = F.slice(keys, F.lit(1), F.greatest(F.size(keys) - (window - 1), F.least(F.size(keys), F.lit(1))))
        least = F.transform(windows, lambda _, i: F.array_min(F.slice(keys, i + 1, F.lit(window))))
        return _let(least, lambda ms: F.transform(changes(ms, lambda m: m), lambda m: F.struct(F.shiftright(m, position_bits).alias("hash"), (F.lit(room) - m.bitwiseAND(room)).cast("long").alias("position"))))

    def chosen_of_long(keys: Column) -> Column:
        windows = F.slice(keys, F.lit(1), F.size(keys) - (window - 1))
        half = 1 << (position_bits - 1)
        # over the border positions begin anew: half of their range away from there they are in order again
        moved = lambda ks: F.transform(ks, lambda k: k.bitwiseAND(~room).bitwiseOR((k + half).bitwiseAND(room)))
        low = lambda m: m.bitwiseAND(room)

        def least(i: Column) -> Column:
            ks = F.slice(keys, i + 1, F.lit(window))
            over = i.bitwiseAND(room) > room - window
            m = F.when(over, _let(F.array_min(moved(ks)), lambda m: m.bitwiseAND(~room).bitwiseOR((m - half).bitwiseAND(room)))).otherwise(F.array_min(ks))
            # the choice is less than a window behind the window's own position
            return _let(m, lambda m: F.struct(F.shiftright(m, position_bits).alias("hash"), (i + (F.lit(room) - low(m) - i).bitwiseAND(room)).cast("long").alias("position")))

        return _let(F.transform(windows, lambda _, i: least(i)), lambda ms: changes(ms, lambda m: m["position"]))

    return _let(words, lambda ws: _let(hashed(ws), lambda keys: F.when(F.size(keys) <= room, chosen(keys)).otherwise(chosen_of_long(keys))))


def hashes(choice: Column) -> Column:
    return F.array_distinct(F.transform(choice, lambda c: c["hash"]))


def shown(choice: Column) -> Column:
    """The fingerprint as text: hash in hexadecimal, @, position of the gram, blank-separated."""
    return F.array_join(F.transform(choice, lambda c: F.concat(F.lower(F.hex(c["hash"])), F.lit("@"), c["position"])), " ")


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of distinct hashes."""
    return _let(F.size(F.array_intersect(a, b)), lambda both: F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both)))


def _bucketed(docs: DataFrame, bucket_rows: int) -> tuple[DataFrame, bool]:
    """docs (i, t) with h (the hash of t), copies, and a bucket (b, c) that rises as the order goes on, of about bucket_rows rows; and whether some id has more rows than that."""
    ids = docs.select("i")
    n, known, low, high = ids.agg(F.count("*"), F.count("i"), F.min("i"), F.max("i")).first()
    docs = docs.select("i", "t", F.xxhash64("t").alias("h"))
    if not known:
        edges, fine = [0, 1], 1
    else:
        parts = max(1, min(QUANTILES, known // bucket_rows))
        cuts = ids.where("i is not null").agg(F.percentile_approx("i", [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0]
        edges = sorted({low, *cuts, high + 1}) if parts > 1 else [low, high + 1]
        fine = max(1, -(-known // ((len(edges) - 1) * bucket_rows)))
    at = F.array(*[F.lit(e).cast("long") for e in edges])
    k = F.size(F.filter(at, lambda e: e <= F.col("i")))  # 1 for the first range
    lo, hi = F.get(at, k - 1), F.get(at, k)  # null for a null id
    inside = F.floor((F.col("i") - lo).cast("double") / (hi - lo) * fine)
    place = (k - 1) * fine + F.least(inside, F.lit(fine - 1))
    b = F.coalesce(F.lit(len(edges) * fine) - place, F.lit(len(edges) * fine + 1)).cast("long")
    # ids of more rows than a bucket: at most HOT_KEYS, as each has at least that share of all rows
    many = max(bucket_rows, n // HOT_KEYS)
    hot = ids.groupBy("i").agg(F.count("*").alias("of_id")).where(F.col("of_id") > many)
    if hot.isEmpty():
        return docs.select("i", "t", "h", F.lit(1).cast("long").alias("copies"), b.alias("b"), F.lit(0).cast("long").alias("c")), False
    few = F.broadcast(hot.select(F.col("i").alias("hot_i"), "of_id"))
    split = docs.join(few, F.col("i").eqNullSafe(F.col("hot_i"))).groupBy("i", "t", "h", "of_id").agg(F.count("*").alias("copies"))
    share = (F.lit(2.0**63) - F.col("h").cast("double")) / F.lit(2.0**64)  # from 0 to 1 as h falls
    split = split.select("i", "t", "h", "copies", b.alias("b"), (F.floor(share * F.ceil(F.col("of_id") / bucket_rows)) + 1).alias("c"), F.col("i").alias("own"))
    rest = docs.join(few, F.col("i").eqNullSafe(F.col("hot_i")), "left_anti").select("i", "t", "h", F.lit(1).cast("long").alias("copies"), b.alias("b"))
    # rows of a bucket before, between and behind its hot ids keep the order: each hot id below a row pushes it on
    return _around(rest, split), True


def _around(rest: DataFrame, split: DataFrame) -> DataFrame:
    """All rows with a bucket (b, c): within b the hot ids stand between the other rows, in the order of ids."""
    step = 1 << 32
    order = Window.partitionBy("b").orderBy(F.col("own").desc_nulls_last())
    ranks = split.select("b", "own").distinct().withColumn("r", F.row_number().over(order).cast("long"))
    named = ranks.select(F.col("b").alias("r_b"), F.col("own").alias("r_own"), "r")
    placed = split.join(F.broadcast(named), (F.col("b") == F.col("r_b")) & F.col("own").eqNullSafe(F.col("r_own"))).select("i", "t", "h", "copies", "b", (F.col("r") * step + F.col("c")).alias("c"))
    listed = ranks.groupBy("b").agg(F.collect_list("own").alias("owns"))  # a bucket has few hot ids, and no row is repeated here
    before = F.size(F.filter(F.coalesce("owns", F.array().cast("array<long>")), lambda o: o > F.col("i")))
    others = rest.join(F.broadcast(listed), "b", "left").select("i", "t", "h", "copies", "b", (before.cast("long") * step + (step - 1)).alias("c"))
    return placed.unionByName(others)


def _followers(buckets: DataFrame) -> DataFrame:
    """(to_b, to_c, b, c): for each bucket the one that follows it, the first one after the last.

    Buckets are ordered within groups of about RING; one row for each group
    tells with which bucket it begins.
    """
    first = F.struct("b", "c")
    parts = buckets.select("b", "c", F.floor(F.col("b") / RING).alias("g"))
    inner = Window.partitionBy("g").orderBy("b", "c")
    follows = parts.withColumn("s", F.lead(first).over(inner))
    groups = parts.groupBy("g").agg(F.min(first).alias("begins"))
    ring = Window.orderBy("g")  # one row for each RING buckets of BUCKET_ROWS rows
    after = groups.select("g", F.coalesce(F.lead("begins").over(ring), F.first("begins").over(ring)).alias("next_begins"))
    every = follows.join(F.broadcast(after), "g").withColumn("s", F.coalesce("s", "next_begins"))
    return every.select(F.col("b").alias("to_b"), F.col("c").alias("to_c"), F.col("s.b").alias("b"), F.col("s.c").alias("c"))


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, gram: int = GRAM, window: int = WINDOW) -> tuple[DataFrame, bool]:
    """Columns i (id), t (text, null made empty), copies and e (the choices of t) of docs, and next_t, next_e of the next document; and whether there are rows with copies."""
    rows, repeated = _bucketed(docs, bucket_rows)
    # ids and hashes find the first row of each bucket, so only those texts are read again
    place = F.struct(F.col("i").isNull().alias("o"), (-F.col("i")).alias("i"), F.bitwise_not("h").alias("h"))
    firsts = rows.groupBy("b", "c").agg(F.min(place).alias("p"))
    ends = _followers(firsts).join(firsts, ["b", "c"])
    wanted = ends.select("to_b", "to_c", F.col("b").alias("f_b"), F.col("c").alias("f_c"), F.when(~F.col("p.o"), -F.col("p.i")).alias("f_i"), F.bitwise_not("p.h").alias("f_h"))
    copies = rows.join(wanted, (F.col("b") == F.col("f_b")) & (F.col("c") == F.col("f_c")) & F.col("i").eqNullSafe(F.col("f_i")) & (F.col("h") == F.col("f_h"))).groupBy("to_b", "to_c").agg(F.max("t").alias("t"))
    both = rows.select("b", "c", F.lit(False).alias("copy"), "i", "h", "t", "copies").unionByName(copies.select(F.col("to_b").alias("b"), F.col("to_c").alias("c"), F.lit(True).alias("copy"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("long").alias("h"), "t", F.lit(1).cast("long").alias("copies")))
    order = [F.col("copy").asc(), F.col("i").desc_nulls_last(), F.col("h").desc(), F.col("t").desc()]
    # texts are shuffled once; choices are made behind the shuffle
    dealt = both.repartition("b", "c").sortWithinPartitions(F.col("b").asc(), F.col("c").asc(), *order).withColumn("e", choices(F.col("t"), gram, window))
    neighbours = Window.partitionBy("b", "c").orderBy(*order)
    return dealt.select("i", "t", "e", "copies", "copy", F.lead("t").over(neighbours).alias("next_t"), F.lead("e").over(neighbours).alias("next_e")).where("not copy").drop("copy"), repeated


def _each_copy(pairs: DataFrame) -> DataFrame:
    """Of equal rows each but the last is followed by its like."""
    last = F.struct(F.lit(1).cast("long").alias("times"), "next_t", "next_e")
    like = F.struct((F.col("copies") - 1).alias("times"), F.col("t").alias("next_t"), F.col("e").alias("next_e"))
    return pairs.select("i", "t", "e", "n", F.explode(F.when(F.col("copies") > 1, F.array(last, like)).otherwise(F.array(last))).alias("x")).select("i", "t", "e", "n", "x.*")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """For each document its fingerprint, that of the text whose last half comes from the next document, and how alike they are."""
    plain = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found, repeated = with_next(plain, bucket_rows, gram, window)
    pairs = found.withColumns({"n": F.length("t"), "times": F.lit(1).cast("long")})
    if repeated:
        pairs = _each_copy(pairs)
    half = F.floor(F.col("n") / 2).cast("int")
    edited = pairs.withColumn("d", F.concat(F.substring("t", F.lit(1), F.col("n") - half), F.substring("next_t", F.lit(1), half)))
    chosen = edited.select("i", "n", "times", "e", "next_e", F.sha2("d", 256).alias("edited_sha256"), choices(F.col("d"), gram, window).alias("ee"))
    sets = chosen.select("*", hashes(F.col("e")).alias("h"), hashes(F.col("ee")).alias("he"), hashes(F.col("next_e")).alias("hn"))
    out = sets.select(
        "times",
        F.col("i").alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        shown(F.col("e")).alias("fingerprint"),
        shown(F.col("ee")).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("he")).alias("near_edited"),
        likeness(F.col("h"), F.col("hn")).alias("near_next"),
    )
    return (out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))) if repeated else out).drop("times")


def fingerprints(docs: DataFrame, text_col: str = "text", gram: int = GRAM, window: int = WINDOW, name: str = "fingerprint") -> DataFrame:
    """docs with an array of (hash, position) of the winnowed grams."""
    return docs.withColumn(name, choices(F.coalesce(F.col(text_col), F.lit("")), gram, window))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))
