"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all test items (questions and answers: any text rows) are put in
one automaton over normalised words; each document is normalised once and
scanned once. A benchmark of more than BLOCK_BYTES makes several automata of
bounded size; the results are the same. A task then gathers BUFFER_BYTES of texts and takes them
through one automaton after the other, so it never holds two, and reads its
documents once. The text of the benchmark itself is held by every worker process.
Hits are reported as spans of words and, through the byte offsets of the words, as
spans of the original text.

Normal form: A-Z become a-z, words are maximal runs of 0-9, a-z and characters
beyond ASCII. A window is `window` consecutive words of an item; an item with
fewer words (but at least one) is a single window.

Defined cases: a null text has no words and no hits; an item with a null id or
null text is left out; repeated items count once; an empty benchmark leaves
every document clean; columns of the documents that bear a name of an added
column are replaced.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, table, tables_of

WINDOW = 10
#: Bytes of item text in one automaton, whose nodes take some hundred times that; a larger benchmark is worked off in blocks of this size.
BLOCK_BYTES = 4 << 20
#: Bytes of texts that pass through an automaton before the next one is built, where there are several.
BUFFER_BYTES = 64 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_NORMAL = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in _LOWER)
_WORD = re.compile(rb"[^ ]+")


def normalised(text: str | None) -> bytes:
    """The text with other characters blanked, byte for byte, so that offsets stay those of its UTF-8 form."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").translate(_NORMAL)


def windows_of(text: str | None, window: int) -> set[bytes]:
    words = normalised(text).split()
    if not words:
        return set()
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def automaton(items: list[tuple[object, str]], window: int):
    """The automaton over all windows; each leads to (number of words, ids of its items). None if there are none."""
    import ahocorasick

    owners: dict[bytes, set[str]] = {}
    for item_id, text in items:
        for w in windows_of(text, window):
            owners.setdefault(w, set()).add(str(item_id))
    if not owners:
        return None
    found = ahocorasick.Automaton()
    for w, ids in owners.items():
        found.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, sorted(ids)))
    found.make_automaton()
    return found


def scan(auto, normal: bytes) -> tuple[list[bytes], list[tuple[int, int]], set[str]]:
    """The words, the merged spans of hit words (from, to) and the ids of the items found."""
    words = normal.split()
    spans: list[list[int]] = []
    ids: set[str] = set()
    if words and auto is not None:
        ends: list[int] | None = None
        line = f" {b' '.join(words).decode('latin-1')} "
        for at, (n, owners) in auto.iter(line):
            ends = ends or list(accumulate(len(w) + 1 for w in words))  # place of the blank after each word
            last = bisect_right(ends, at - 1) + 1  # one past the last word of the match
            ids.update(owners)
            spans.append([last - n, last])
    return words, united(spans), ids


def united(spans: list) -> list[tuple[int, int]]:
    """Spans in order, those that touch as one."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def original_spans(text: str | None, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of code points of the original text."""
    if not spans:
        return []
    normal = normalised(text)
    places = [m.span() for m in _WORD.finditer(normal)]
    raw = text.encode("utf-8", "surrogatepass")
    out, at, chars = [], 0, 0  # spans ascend, so each stretch of the text is decoded once
    for a, b in spans:
        ends = []
        for upto in (places[a][0], places[b - 1][1]):
            chars += len(raw[at:upto].decode("utf-8", "surrogatepass"))
            at = upto
            ends.append(chars)
        out.append((ends[0], ends[1]))
    return out


ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about block_bytes of text."""
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r.i, r.t) for r in part.toLocalIterator()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, buffer_bytes: int = BUFFER_BYTES) -> DataFrame:
    """docs with n_words, hit_words and hit_spans (merged, by words and by code points) and item_ids (sorted strings).

    The documents are never shuffled and pass once through one Python stage, whatever the size of the benchmark.
    """
    blocks = list(item_blocks(benchmark, item_id, item_text, block_bytes))
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, blocks))

    def make():
        key, items = sent.value

        def work(texts: list) -> list[list]:
            found = [(0, [], set())] * len(texts)
            for k, block in enumerate(items):
                auto = tables_of("decontamination", (key, window), lambda: automaton(block, window)) if len(items) == 1 else automaton(block, window)  # noqa: B023
                for at, t in enumerate(texts):
                    words, spans, ids = scan(auto, normalised(t))
                    found[at] = (len(words), united(found[at][1] + spans) if k else spans, found[at][2] | ids)
                del auto
            rows = [(n, spans, original_spans(t, spans), sorted(ids)) for t, (n, spans, ids) in zip(texts, found, strict=True)]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]

        return work

    return appended(docs, text_col, ADDED, make, buffer_bytes=0 if len(blocks) == 1 else buffer_bytes)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and the spans."""
    found = find_leaks(docs, benchmark, text_col, **how)
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda acc, s: acc + (s[1] - s[0]).cast("long"))
    return found.withColumns(
        {
            "n_hit": n_hit,
            "n_items": F.size("item_ids").cast("long"),
            "items_sha256": F.sha2(F.array_join("item_ids", ","), 256),
            "contaminated": n_hit > 0,
        }
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")


