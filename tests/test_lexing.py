"""The lexer against a plain scanner, on written cases and on random text."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from srcloom.functions import lexing as L


def scan(text: str, language: str) -> str:
    """One character after the other."""
    rust, out, i, n = language == "rust", [], 0, len(text)

    def blank(a, b):
        out.extend("\n" if c == "\n" else " " for c in text[a:b])

    def literal(a, b):
        if b - a == 1:
            out.append('"')
        else:
            out.append('"')
            blank(a + 1, b - 1)
            out.append('"')

    word = lambda c: c.isascii() and (c.isalnum() or c == "_")
    while i < n:
        if text.startswith("//", i):
            j = text.find("\n", i)
            j = n if j < 0 else j
            blank(i, j)
        elif text.startswith("/*", i):
            depth, j = 1, i + 2
            while j < n and depth:
                if text.startswith("*/", j):
                    depth, j = depth - 1, j + 2
                elif rust and text.startswith("/*", j):
                    depth, j = depth + 1, j + 2
                else:
                    j += 1
            j = n if depth else j
            blank(i, j)
        elif text[i] == '"' or (not rust and text[i] == "'"):
            q, j = text[i], i + 1
            while j < n and text[j] != q and (rust or text[j] != "\n"):
                j += 2 if text[j] == "\\" and j + 1 < n else 1
            if j < n and text[j] == q:
                literal(i, j + 1)
                j += 1
            else:
                end = n if rust else text.find("\n", i)
                j = n if end < 0 else end
                literal(i, j)
        elif rust and text[i] == "'":
            j = i + 1
            if j + 1 < n and text[j] not in "'\\\n" and text[j + 1] == "'":
                literal(i, j + 2)
                j += 2
            elif text.startswith("\\", j) and j + 2 < n and text[j + 1] not in "ux\n" and text[j + 2] == "'":
                literal(i, j + 3)
                j += 3
            else:
                out.append("'")
            # hexadecimal and Unicode escapes are not in the random texts
        elif word(text[i]):
            j = i
            while j < n and word(text[j]):
                j += 1
            hashes = 0
            while rust and text.startswith("#", j + hashes):
                hashes += 1
            if rust and text[i:j] in ("r", "br", "cr") and text.startswith('"', j + hashes):
                end = text.find('"' + "#" * hashes, j + hashes + 1)
                end = n if end < 0 else end + 1 + hashes
                literal(i, end)
                j = end
            else:
                out.append(text[i:j])
        else:
            out.append(text[i])
            j = i + 1
        i = j
    return "".join(out)


@pytest.mark.parametrize("language", L.LANGUAGES)
def test_masks_like_a_plain_scanner(spark, language):
    rng = random.Random(4)
    parts = ["//", "/*", "*/", "*", "/", '"', "'", "\\", "\n", " ", "a", "r", "br", "#", "{", "}", "(", "x'", "'a'", "'\\n'", 'r"', 'r#"', '"#', "é", "for", "<'a>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)] + ["", "/* a /* b */ c */ d", 'let s = r##"a "# b"##;', "'\"' // x", "\\"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", L.masked(F.col("t"), language).alias("m"))
    found = {r.k: r.m for r in df.collect()}
    for k, t in enumerate(texts):
        assert found[k] == scan(t, language), repr(t)


def test_long_texts_and_deep_ones(spark):
    long = 'x = "' + "a\\\"b" * 200_000 + '"; /* ' + "* / " * 200_000 + "*/ y"
    deep = "/*" * 20 + "*/" * 20 + "z"
    rows = spark.createDataFrame([(long,), (deep,)], "t string").select(F.trim(F.regexp_replace(L.masked(F.col("t")), " +", " ")).alias("m")).collect()
    assert [r.m for r in rows] == ['x = " "; y', "z"]


def test_problems(spark):
    cases = {
        "fn a() { [1] }": [],
        "/* x": ["open comment"],
        "/*/": ["open comment"],
        'let a = "x': ["open string"],
        'r#"x"': ["open string"],
        'r#"x"#': [],
        '"a\\\\"': [],
        '"a\\"': ["open string"],
        "fn a() { (": ["unbalanced brackets"],
        "fn a() { (] }": ["unbalanced brackets"],
        "'a' \"}\" // }": [],
        "<'a>": [],
        "{" * 30 + "}" * 30: ["too deep"],
        "": [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", L.problems(F.col("t")).alias("p"))
    assert {r.t: r.p for r in df.collect()} == cases
    sol = {"string s = 'a\n';": ["open string"], "/* /* */ x": [], "a = '\"';": []}
    df = spark.createDataFrame([(t,) for t in sol], "t string").select("t", L.problems(F.col("t"), "solidity").alias("p"))
    assert {r.t: r.p for r in df.collect()} == sol


def test_groups(spark):
    df = spark.createDataFrame([("a(b[c], {d(e)}).f(g)",), ("",), ("plain",), ("(", )], "t string").select(L.bracket_groups(F.col("t")).alias("g"))
    c, i, b = L.CALL, L.INDEX, L.BLOCK
    assert [sorted(r.g) for r in df.collect()] == [sorted(["c", "e", "g", f"d{c}", f"b{i}, {b}", f"a{c}.f{c}"]), [""], ["plain"], ["("]]
