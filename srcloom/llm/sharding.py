"""Sharding by extendible hashing.

The directory is indexed by leading bits of a hash of the row. A bucket over the
byte limit is split on its next bit, and only such a bucket, until it fits. So a
shard is the shortest prefix of the hash whose rows fit the limit.

Bytes are summed once for prefixes of a depth that the total size suggests
(about SLACK_BITS more than the shards need); shorter prefixes are sums of
those, so the splitting works on a table of prefixes and not on the rows. Rows
in prefixes that are still too large go on, alone, to STEP_BITS more bits, up to
HASH_BITS.

The hash is that of key and text, so a key with very many rows is split as well.
Rows equal in both can't be told apart by any bit: what is too large at
HASH_BITS is cut into numbered overflow pages, each of as many rows as fit.
Wherever rows meet their bucket they are dealt to tasks by a salt as well, which
comes from a row number that is stored with the row, so no task holds all of a
group of equal rows and a task that runs again deals alike. A single row above
the limit has a shard (or page) of its own.

assign() names the shard of each row; write_shards() writes the documents.

Defined cases: null key and null text hash like empty ones, a null text has zero
bytes; an empty table has no shards. Columns of the documents that bear a name
of an added column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

LIMIT = 1 << 20
SLACK_BITS, STEP_BITS, HASH_BITS = 4, 8, 48
#: Equal rows of one overflow group that a task numbers; parts that rows of one prefix or hash are dealt to in a join.
SALTED_ROWS, SALTS = 50_000, 8
ADDED = ["shard", "depth", "page", "shard_bytes", "shard_rows"]


def hash_of(key: Column, text: Column) -> Column:
    """The first HASH_BITS bits of an MD5 over key and text, as a long."""
    inner = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    whole = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), inner).cast("binary"))
    return F.conv(F.substring(whole, 1, HASH_BITS // 4), 16, 10).cast("long")


def _directory(sums: DataFrame, limit: int, frm: int, upto: int) -> DataFrame:
    """For each prefix p of upto bits below a bucket that fits its depth, shard_bytes and shard_rows.

    sums: p, n, bytes of the buckets to be split, all too large at frm - 1 bits.
    A bucket is a shard if it fits and the bucket that it was split from does not;
    each bucket meets only the one that it was split from.
    """
    each = sums.withColumn("depth", F.explode(F.sequence(F.lit(frm), F.lit(upto)))).withColumn("q", F.expr(f"shiftright(p, {upto} - depth)"))
    nodes = each.groupBy("depth", "q").agg(F.sum("n").alias("shard_rows"), F.sum("bytes").alias("shard_bytes"))
    nodes = durable(nodes.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)))
    above = nodes.where("not fits").select((F.col("depth") + 1).alias("depth"), F.col("q").alias("above"))
    split = nodes.where(f"fits and depth > {frm}").withColumn("above", F.shiftright("q", 1)).join(above, ["depth", "above"], "left_semi").drop("above")
    leaf = split.unionByName(nodes.where(f"fits and depth = {frm}").select(*split.columns))
    p = F.explode(F.expr(f"sequence(shiftleft(q, {upto} - depth), shiftleft(q + 1, {upto} - depth) - 1)"))
    return leaf.select(p.alias("p"), "depth", "shard_bytes", "shard_rows")


def _spread(few: DataFrame) -> DataFrame:
    """A row of a small table for each salt, for rows of which very many may have one key."""
    return few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """The columns of docs but for the text, with shard (its bits), depth, page (null unless an overflow page), shard_bytes and shard_rows."""
    return _assigned(docs, id_col, text_col, limit).drop(*([text_col] if text_col not in ADDED else []))


def _assigned(docs: DataFrame, id_col: str, text_col: str, limit: int, whole: bool = False) -> DataFrame:
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED and (whole or c != text_col)]).alias("__row")
    text = F.col(f"`{text_col}`")
    plain = docs.select(held, F.col(f"`{id_col}`").alias("__id"), hash_of(F.col(f"`{id_col}`"), text).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    # numbers of rows are kept with the rows, so a salt made from them is the same whenever a task runs again
    rows = durable(plain.withColumn("k", F.monotonically_increasing_id()))
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    upto = min(HASH_BITS, max(STEP_BITS, math.ceil(math.log2(max(1, total / limit))) + SLACK_BITS))
    frm, left, placed = 0, rows, []
    while True:
        by = left.withColumns({"p": F.shiftright("h", HASH_BITS - upto), "salt": F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int")})
        sums = durable(by.groupBy("p").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")))
        found = durable(_directory(sums, limit, frm, upto))
        placed.append(by.join(_spread(found), ["p", "salt"]).select("__row", F.substring(F.lpad(F.bin("h"), HASH_BITS, "0"), F.lit(1), F.col("depth")).alias("shard"), "depth", F.lit(None).cast("long").alias("page"), "shard_bytes", "shard_rows"))
        over = durable(sums.join(found, "p", "left_anti").select("p"))
        if over.isEmpty():
            break
        left = durable(by.join(_spread(over), ["p", "salt"]).select("__row", "__id", "h", "bytes", "k"))
        if upto == HASH_BITS:
            placed.append(_pages(left, limit))
            break
        frm, upto = upto + 1, min(HASH_BITS, upto + STEP_BITS)
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out.select("__row.*", *ADDED)


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of groups of rows with equal hash: a group is dealt to parts by a salt, each part is cut into pages of its own."""
    groups = rows.groupBy("h").agg(F.count("*").alias("n"), F.max("bytes").alias("most"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int")).join(_spread(groups), ["h", "salt"])
    salted = salted.withColumn("part", F.pmod(F.xxhash64("k", F.lit(1)), F.ceil(F.col("n") / SALTED_ROWS)))
    fit = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("most", F.lit(1))))
    numbered = salted.withColumn("j", F.floor((F.row_number().over(Window.partitionBy("h", "part").orderBy("k")) - 1) / fit))
    # pages of one part follow those of the parts before it; each part's last page may be part full
    at = numbered.withColumn("page", F.col("part") * F.ceil(F.col("n") / fit) + F.col("j"))
    w = Window.partitionBy("h", "page")
    return at.select("__row", F.lpad(F.bin("h"), HASH_BITS, "0").alias("shard"), F.lit(HASH_BITS).alias("depth"), "page", F.sum("bytes").over(w).alias("shard_bytes"), F.count("*").over(w).alias("shard_rows"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """The documents with all their columns as Parquet, a folder for each shard and page: shard=<bits>/page=<number>, 0 where there is no overflow.

    The empty prefix (one shard holds everything) is written as `all`.
    """
    named = _assigned(docs, id_col, text_col, limit, whole=True).drop("depth", "shard_bytes", "shard_rows")
    placed = named.withColumns({"shard": F.when(F.col("shard") == "", "all").otherwise(F.col("shard")), "page": F.coalesce("page", F.lit(0))})
    placed.repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = f"""
WITH hashed AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) AS h,
         coalesce(octet_length(encode(text)), 0) AS bytes
  FROM documents
), depths AS (
  SELECT doc_id, h, bytes, d, h >> ({HASH_BITS} - d) AS q FROM hashed, range(0, {HASH_BITS} + 1) AS r(d)
), sums AS (
  SELECT *, sum(bytes) OVER (PARTITION BY d, q) AS b, count(*) OVER (PARTITION BY d, q) AS n FROM depths
), leaf AS (
  SELECT doc_id, arg_min(struct_pack(h := h, d := d, b := b, n := n), d) AS s FROM sums WHERE b <= {LIMIT} OR n = 1 GROUP BY doc_id
)
SELECT doc_id, CASE WHEN s.d = 0 THEN '' ELSE substr(lpad(bin(s.h), {HASH_BITS}, '0'), 1, CAST(s.d AS INTEGER)) END AS shard, CAST(s.d AS INTEGER) AS depth,
       CAST(NULL AS BIGINT) AS page, CAST(s.b AS BIGINT) AS shard_bytes, CAST(s.n AS BIGINT) AS shard_rows
FROM leaf
"""
