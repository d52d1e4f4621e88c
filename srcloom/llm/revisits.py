"""Resolution of not-modified revisit records of web archives.

A revisit record (status 304) stands for the payload of an earlier capture of
the same page. Each is joined, as of its time, to the latest full response with
the same canonical URL and a strictly earlier date (of equal dates the greatest
record id). The validators must agree: entity tags if both records have one
(compared weakly, without W/), else Last-Modified if both have it; with neither
to compare the match counts as unverified. The headers of the resolved record
are those of the response, updated by those of the revisit that a 304 may update
(PERMITTED); headers that describe the stored payload are never overwritten.

The join is a running maximum over time within (URL, span of CHUNK_SECONDS), and
a second one over one row for each span that brings in what earlier spans end
with. So a URL with very many captures is spread over its spans. Payloads are
not shuffled: the result names the record that has it.

Canonical URL: no scheme, fragment, www prefix, default port or trailing slash;
lower-case host; query parameters sorted.

Defined cases: a revisit without URL or date, or without an earlier response, is
`missing`; a response without URL or date is never found; null headers are
empty; header names are compared, and returned, in lower case; a record whose
is_revisit is null counts as a response; repeated records each get a row;
columns beyond the named ones are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

CHUNK_SECONDS = 6 * 3600
#: Headers that a 304 response may update (RFC 9110, section 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]


def canonical_url(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^www[0-9]*[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^([^?]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&")), "&")
    return F.when(url.isNotNull(), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def lower_names(headers: Column) -> Column:
    """Headers with lower-case names; of names that become equal the least value stays, null is empty."""
    named = F.transform(F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    first = lambda es: F.map_from_entries(F.filter(es, lambda e, i: (i == 0) | (F.get(es, i - 1)["key"] != e["key"])))
    return F.get(F.transform(F.array(F.array_sort(named)), first), F.lit(0))


def resolve(records: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """records: record_id, url, ts (seconds), is_revisit, headers (map), digest.

    One row for each revisit: record_id, canonical, refers_to, status (resolved,
    unverified, mismatch, missing), digest and the merged headers.
    """
    plain = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), F.col("ts").cast("long").alias("ts"), F.coalesce("is_revisit", F.lit(False)).alias("is_revisit"), lower_names(F.col("headers")).alias("headers"), "digest")
    placed = plain.where("canonical is not null and ts is not null").withColumn("chunk", F.floor(F.col("ts") / chunk_seconds))
    lost = plain.where("is_revisit and (canonical is null or ts is null)")
    # maps can't be compared, so headers travel as sorted entries
    response = F.when(~F.col("is_revisit"), F.struct("ts", "record_id", "digest", F.array_sort(F.map_entries("headers")).alias("entries")))
    within = Window.partitionBy("canonical", "chunk").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("near", F.max(response).over(within)).where("is_revisit")
    ends = placed.where("not is_revisit").groupBy("canonical", "chunk").agg(F.max(response).alias("last"))
    # a span without a response needs what came before it as well
    spans = placed.select("canonical", "chunk").distinct().join(ends, ["canonical", "chunk"], "left")
    before = Window.partitionBy("canonical").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("far", F.max("last").over(before)).where("far is not null").select("canonical", "chunk", "far")
    found = near.join(carried, ["canonical", "chunk"], "left").withColumn("r", F.coalesce("near", "far")).drop("near", "far", "chunk")
    found = found.unionByName(lost.withColumn("r", F.lit(None).cast(found.schema["r"].dataType)))

    had = F.map_from_entries("r.entries")
    tag = lambda m: F.regexp_replace(F.element_at(m, F.lit("etag")), "^W/", "")
    stamp = lambda m: F.element_at(m, F.lit("last-modified"))
    by_tag, by_stamp = tag(had) == tag(F.col("headers")), stamp(had) == stamp(F.col("headers"))
    status = F.when(F.col("r").isNull(), "missing").when(F.coalesce(by_tag, by_stamp).isNull(), "unverified").when(F.coalesce(by_tag, by_stamp), "resolved").otherwise("mismatch")
    new = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter(had, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False))), new)
    good = F.col("status").isin("resolved", "unverified")
    return found.withColumn("status", status).select("record_id", "canonical", F.when(good, F.col("r.record_id")).alias("refers_to"), "status", F.when(good, F.col("r.digest")).alias("digest"), F.when(good, merged).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of the pages: a response of each, a revisit a day later, and others that come too early or with another tag."""
    day, at = 86_400, F.col("page_id") * 60
    digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    pairs = lambda *kv: F.create_map(*[x if isinstance(x, Column) else F.lit(x) for x in kv])
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    record = lambda kind, ts, revisit, headers: F.struct(F.concat_ws("-", F.lit(kind), F.col("page_id").cast("string")).alias("record_id"), ts.alias("ts"), F.lit(revisit).alias("is_revisit"), headers.alias("headers"), F.when(F.lit(not revisit), digest).alias("digest"))
    made = F.array(
        record("full", at, False, pairs("etag", digest, "content-length", size, "cache-control", "max-age=60", "date", at.cast("string"))),
        record("same", at + day, True, pairs("etag", F.concat(F.lit("W/"), digest), "content-length", "0", "cache-control", "max-age=600", "date", (at + day).cast("string"))),
        record("early", at - day, True, pairs("etag", digest, "date", (at - day).cast("string"))),
        record("other", at + 2 * day, True, F.when(F.col("page_id") % 2 == 0, pairs("etag", "changed", "date", (at + 2 * day).cast("string"))).otherwise(pairs("vary", "accept", "date", (at + 2 * day).cast("string")))),
    )
    return pages.select("url", F.explode(made).alias("r")).select("url", "r.*")


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return found.withColumn("headers", lines)


_ALLOWED = ", ".join(f"'{h}'" for h in PERMITTED)
OP3_SQL = f"""
WITH parts AS (
  SELECT page_id, md5(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS size, page_id * 60 AS t0,
         regexp_replace(regexp_replace(trim(url), '#.*', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages
), cut AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www[0-9]*[.]', ''), ':(80|443)$', '') AS host,
         regexp_replace(bare, '^[^/?]*', '') AS rest FROM parts
), canon AS (
  SELECT *, host || regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '')
         || CASE WHEN regexp_extract(rest, '[?](.*)$', 1) <> '' THEN '?' || array_to_string(list_sort(string_split(regexp_extract(rest, '[?](.*)$', 1), '&')), '&') ELSE '' END AS canonical
  FROM cut
), header AS (
  SELECT 'full-' || page_id AS record_id, canonical, t0 AS ts, false AS is_revisit, digest, k, v FROM canon,
    LATERAL (VALUES ('etag', digest), ('content-length', CAST(size AS VARCHAR)), ('cache-control', 'max-age=60'), ('date', CAST(t0 AS VARCHAR))) AS h(k, v)
  UNION ALL
  SELECT 'same-' || page_id, canonical, t0 + 86400, true, NULL, k, v FROM canon,
    LATERAL (VALUES ('etag', 'W/' || digest), ('content-length', '0'), ('cache-control', 'max-age=600'), ('date', CAST(t0 + 86400 AS VARCHAR))) AS h(k, v)
  UNION ALL
  SELECT 'early-' || page_id, canonical, t0 - 86400, true, NULL, k, v FROM canon, LATERAL (VALUES ('etag', digest), ('date', CAST(t0 - 86400 AS VARCHAR))) AS h(k, v)
  UNION ALL
  SELECT 'other-' || page_id, canonical, t0 + 172800, true, NULL, k, v FROM canon,
    LATERAL (VALUES (CASE WHEN page_id % 2 = 0 THEN 'etag' ELSE 'vary' END, CASE WHEN page_id % 2 = 0 THEN 'changed' ELSE 'accept' END), ('date', CAST(t0 + 172800 AS VARCHAR))) AS h(k, v)
), record AS (
  SELECT record_id, canonical, ts, is_revisit, any_value(digest) AS digest, max(v) FILTER (WHERE k = 'etag') AS etag FROM header GROUP BY ALL
), latest AS (
  SELECT r.record_id, any_value(r.canonical) AS canonical, any_value(r.etag) AS etag, arg_max(f, (f.ts, f.record_id)) FILTER (WHERE f.record_id IS NOT NULL) AS f
  FROM record r LEFT JOIN record f ON r.canonical = f.canonical AND NOT f.is_revisit AND f.ts < r.ts WHERE r.is_revisit GROUP BY r.record_id
), judged AS (
  SELECT *, CASE WHEN f IS NULL THEN 'missing' WHEN etag IS NULL THEN 'unverified' WHEN regexp_replace(etag, '^W/', '') = f.etag THEN 'resolved' ELSE 'mismatch' END AS status FROM latest
), merged AS (
  SELECT j.record_id, h.k, arg_min(h.v, CASE WHEN h.record_id = j.record_id THEN 0 ELSE 1 END) AS v
  FROM judged j JOIN header h ON (h.record_id = j.record_id AND h.k IN ({_ALLOWED})) OR h.record_id = j.f.record_id
  WHERE j.status IN ('resolved', 'unverified') GROUP BY j.record_id, h.k
), listed AS (
  SELECT record_id, string_agg(k || ': ' || v, chr(10) ORDER BY k) AS headers FROM merged GROUP BY record_id
)
SELECT j.record_id, j.canonical, CASE WHEN status IN ('resolved', 'unverified') THEN j.f.record_id END AS refers_to, j.status,
       CASE WHEN status IN ('resolved', 'unverified') THEN j.f.digest END AS digest, l.headers
FROM judged j LEFT JOIN listed l USING (record_id)
"""
