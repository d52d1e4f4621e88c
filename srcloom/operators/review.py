"""Review documents: sections, severities, completeness, and what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The sections of a review document.
HEADERS = ["State changes", "Notes", "Signers", "Dependency function parameters", "Context accounts", "Validations", "Miro frame url"]
# Ranks of severities.
SEVERITIES = {"high": 1, "medium": 2, "low": 3, "informational": 4}


def markdown_sections(review_doc: DataFrame, headers: list[str] | None = None) -> DataFrame:
    """entry_name, section, content, fences, items: the text from each known header to the next, its fenced blocks and its `- name: description` items."""
    names = headers or HEADERS
    lines = review_doc.select("entry_name", F.posexplode(F.split("body", "\n")).alias("at", "line"))
    head = F.regexp_replace(F.regexp_extract("line", r"^#+\s*(.*?):?\s*$", 1), r":$", "")
    marked = lines.withColumn("head", F.when(head.isin(names), head))
    w = Window.partitionBy("entry_name").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.withColumn("section", F.last("head", ignorenulls=True).over(w)).where("section is not null and head is null")
    blank = F.lit(" \n\r\t")
    text = inside.groupBy("entry_name", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), "\n").alias("content")).withColumn("content", F.btrim("content", blank))
    fences = F.transform(F.regexp_extract_all("content", F.lit(r"(?s)```\w*\n(.*?)```"), F.lit(1)), lambda t: F.btrim(t, blank))
    items = F.regexp_extract_all("content", F.lit(r"(?m)^- (\w+: .*)$"), F.lit(1))
    return text.select("entry_name", "section", "content", fences.alias("fences"), items.alias("items"))


def finding_severity(review_doc: DataFrame) -> DataFrame:
    """name (with the rank in front instead of an earlier one), rank, error, for each document with a severity line."""
    line = F.regexp_extract("body", r"(?m)^(.*Severity:.*)$", 1)
    said = F.lower(F.regexp_replace(F.regexp_replace(line, r"\*{0,2}Severity:\*{0,2}", ""), r"\s", ""))
    rank = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])[said]
    bare = F.regexp_replace(F.regexp_replace("entry_name", r"\.md$", ""), r"^[1-4]-", "")
    return review_doc.where(line != "").select(F.when(rank.isNotNull(), F.concat_ws("-", rank.cast("string"), bare)).otherwise(F.col("entry_name")).alias("name"), rank.alias("rank"), F.when(rank.isNull(), F.concat(F.lit("unknown severity: "), said)).alias("error"))


def completeness_check(review_doc: DataFrame, placeholders: list[str]) -> DataFrame:
    """Which placeholders each document still holds, in the order given."""
    found = F.array_compact(F.array(*[F.when(F.contains("body", F.lit(p)), p) for p in placeholders]))
    return review_doc.select("entry_name", F.coalesce(found, F.array().cast("array<string>")).alias("missing")).withColumn("complete", F.size("missing") == 0)


def review_reconcile(entry: DataFrame, review_doc: DataFrame, deprecated: str = "deprecated") -> DataFrame:
    """new (an entry without a document), kept, or deprecated (a document without an entry); documents already deprecated don't count."""
    docs = review_doc.where(F.col("status") != deprecated).select(F.col("name"), F.lit(True).alias("has_doc")).distinct()
    both = entry.select("name", F.lit(True).alias("has_entry")).distinct().join(docs, "name", "full_outer")
    return both.select("name", F.when(F.col("has_doc").isNull(), "new").when(F.col("has_entry").isNull(), "deprecated").otherwise("kept").alias("status_change"))
