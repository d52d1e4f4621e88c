"""Column expressions over source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value), the value being computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def indent(line: Column) -> Column:
    """The leading white space of a line."""
    return F.regexp_extract(line, r"^(\s*)", 1)


def stripped(line: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(line, F.lit(" \t\r\n\f\u000b"))


def lines_of(content: Column) -> Column:
    """Lines without line ends; a final line end does not start another line."""
    return F.split(F.regexp_replace(content, "\r?\n$", ""), "\r?\n")


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def without_lifetimes(type_text: Column) -> Column:
    """A type without its lifetime arguments."""
    return F.regexp_replace(F.regexp_replace(type_text, r"'\w+\s*,?\s*", ""), r"<\s*>", "")


def spaced(text: Column) -> Column:
    """Token text with canonical blanks: none around :: and brackets, one around = and after commas."""
    out = F.regexp_replace(F.trim(text), r"\s+", " ")
    for pattern, new in ((r"\s*::\s*", "::"), (r"\s*\.\s*", "."), (r"\s*\(\s*", "("), (r"\s*\)", ")"), (r"\s*\[\s*", "["), (r"\s*\]", "]"), (r"\s*<\s*(?=\w)", "<"), (r"(?<=[\w>])\s*>(?!=)", ">"), (r"\s*,\s*", ", "), (r"\s+\?", "?")):
        out = F.regexp_replace(out, pattern, new)
    return out


def at_sign(text: Column) -> tuple[Column, Column]:
    """(expression, error) of `expression @ error`; the error is null without the sign."""
    return F.trim(F.substring_index(text, "@", 1)), F.when(F.contains(text, F.lit("@")), F.trim(F.regexp_replace(text, r"^[^@]*@", "")))


def path_fragment(import_path: Column, name: Column) -> Column:
    """An import path as a piece of a file path: a::b::f becomes a/b; null if nothing is left."""
    parts = F.filter(F.split(import_path, "::"), lambda s: ~s.isin("crate", "super", "self") & (s != name))
    return F.when(F.size(parts) > 0, F.array_join(parts, "/"))


def stable_id(*parts: Column) -> Column:
    """A deterministic identifier."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


#: Brackets that split_top_level looks into.
OPEN, CLOSE = "([{<", ")]}>"


def _item(levels: int) -> str:
    """A pattern for text without a top-level comma in which brackets are closed and nest at most `levels` deep; closers outside of brackets close nothing."""
    inner = r"[^(\[{<)\]}>]*+"
    for _ in range(levels - 1):
        inner = rf"(?:[^(\[{{<)\]}}>]++|[(\[{{<]{inner}[)\]}}>])*+"
    return rf"(?:[^,(\[{{<]++|[(\[{{<]{inner}[)\]}}>])++"


#: Such text of up to six levels.
ITEM = _item(6)


def split_top_level(text: Column) -> Column:
    """Items between commas that stand outside brackets.

    Depth does not fall below zero, so the `>` of an arrow closes nothing. One pattern cuts texts whose
    brackets are closed and not very deep. Others are folded, over brackets, commas and the stretches
    between them, not over characters.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("depth"))

    def step(acc: Column, c: Column) -> Column:
        up, down = c.isin(*OPEN), c.isin(*CLOSE)
        cut = (c == ",") & (acc["depth"] == 0)
        depth = F.when(up, acc["depth"] + 1).when(down, F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        return F.struct(F.when(cut, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), F.when(cut, F.lit("")).otherwise(F.concat(acc["now"], c)).alias("now"), depth.alias("depth"))

    parts = F.regexp_extract_all(text, F.lit(r"[(\[{<)\]}>,]|[^(\[{<)\]}>,]+"), F.lit(0))
    whole = F.aggregate(parts, start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))
    kept = lambda items: F.filter(F.transform(items, lambda s: F.trim(s)), lambda s: s != "")
    closed = text.rlike(rf"^(?:{ITEM}|,)*+\z")
    return F.when(closed, kept(F.regexp_extract_all(text, F.lit(ITEM), F.lit(0)))).otherwise(kept(whole))


def plain_path(path: Column) -> Column:
    """A path without `.` and, as far as there is a folder before it, `..`."""
    start = F.array().cast("array<string>")
    last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(".."))

    def step(acc: Column, part: Column) -> Column:
        up = (part == "..") & ~last(acc).isin("..", "")
        return F.when(part == ".", acc).when(up, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")
