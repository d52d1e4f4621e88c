"""Column expressions over the lexical form of source text: comments, literals, brackets.

A text is cut into tokens by one pattern that is tried at each place where the
token before ended, so what looks like a quote in a comment, or like a comment in
a string, is read as what it is. Line comments, block comments (nested ones
where the language nests them, up to NESTED levels), strings, raw strings,
characters and code are tokens; a literal or comment that is never closed
reaches to the end of the text (of the line, for strings that can't go over
lines) and is found by problems().

All quantifiers inside tokens are possessive, so texts of any length are read
without backtracking and without a deep stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

NESTED = 24
#: Rust nests block comments and has raw strings and lifetimes; Solidity has neither, and strings in single quotes.
LANGUAGES = ("rust", "solidity")


def _nested(head: str, tail: str, plain: str, levels: int) -> str:
    """Pattern of a balanced pair whose inside is of `plain` parts and of such pairs."""
    found = f"{head}(?:{plain})*+{tail}"
    for _ in range(levels - 1):
        found = f"{head}(?:{plain}|{found})*+{tail}"
    return found


BRACES = _nested(r"\{", r"\}", r"[^{}]++", NESTED)
PARENS = _nested(r"\(", r"\)", r"[^()]++", 12)
BRACKETS = _nested(r"[(\[{]", r"[)\]}]", r"[^()\[\]{}]++", NESTED)

_RAW = r"(?<![A-Za-z0-9_])(?:br|cr|r)(?<hashes>#*+)\"[\s\S]*?\"\k<hashes>"
_OPEN_RAW = r"(?<![A-Za-z0-9_])(?:br|cr|r)#*+\"[\s\S]*+"
_CODE_RUST = r"(?:(?!(?:br|cr|r)#*+\")[A-Za-z0-9_]++|[^A-Za-z0-9_\"'/]++)++"
_TOKENS = {
    "rust": "|".join(
        [
            r"//[^\n]*+",
            _nested(r"/\*", r"\*/", r"[^*/]++|\*(?!/)|/(?!\*)", NESTED),
            r"/\*[\s\S]*+",
            _RAW,
            _OPEN_RAW,
            r"\"[^\"\\]*+(?:\\[\s\S][^\"\\]*+)*+\"",
            r"\"[\s\S]*+",
            r"'(?:[^'\\\n]|\\(?:u\{[^}'\n]*+\}|x[0-9A-Fa-f]{2}|[^ux\n]))'",
            _CODE_RUST,
            r"[\s\S]",
        ]
    ),
    "solidity": "|".join(
        [
            r"//[^\n]*+",
            r"/\*(?:[^*]++|\*(?!/))*+\*/",
            r"/\*[\s\S]*+",
            r"\"[^\"\\\n]*+(?:\\[\s\S][^\"\\\n]*+)*+\"",
            r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'",
            r"[\"'][^\n]*+",
            r"[^\"'/]++",
            r"[\s\S]",
        ]
    ),
}
#: What a literal begins with; a lifetime's quote is a token of one character.
_LITERAL = {"rust": r"^(?:[\"]|'[\s\S]|(?:br|cr|r)#*+\")", "solidity": r"^(?:\"|')"}

#: What a literal that is closed looks like.
_CLOSED = {
    "rust": r"^(?:\"[^\"\\]*+(?:\\[\s\S][^\"\\]*+)*+\"|'[\s\S]+'|(?:br|cr|r)(#*+)\"[\s\S]*\"\1)$",
    "solidity": r"^(?:\"[^\"\\\n]*+(?:\\[\s\S][^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+')$",
}


def _tokens(text: Column, language: str) -> Column:
    if language not in _TOKENS:
        raise ValueError(f"one of {LANGUAGES}, not {language!r}")
    return F.regexp_extract_all(text, F.lit(_TOKENS[language]), F.lit(0))


def _is_comment(t: Column) -> Column:
    return t.startswith("//") | t.startswith("/*")


def _blank(t: Column) -> Column:
    return F.regexp_replace(t, r"[^\n]", " ")


def masked(text: Column, language: str = "rust") -> Column:
    """The text with comments and the insides of literals blanked; every line and column stays where it was.

    A literal of any kind is two double quotes with blanks (and line ends) between them.
    """

    def mask(t: Column) -> Column:
        inside = F.concat(F.lit('"'), _blank(F.substring(t, F.lit(2), F.length(t) - 2)), F.lit('"'))
        literal = F.when(F.length(t) > 1, inside).otherwise(F.lit('"'))
        return F.when(_is_comment(t), _blank(t)).when(t.rlike(_LITERAL[language]), literal).otherwise(t)

    # most small texts have neither: no token of such a text changes
    return F.when(text.rlike(r"[\"'/]"), F.array_join(F.transform(_tokens(text, language), mask), "")).otherwise(text)


def uncommented(text: Column, language: str = "rust") -> Column:
    """The text with comments blanked; literals of one line without ; and quotes inside stay, others are blanked too."""

    def mask(t: Column) -> Column:
        odd = t.rlike(_LITERAL[language]) & ~t.rlike(r"^(?:\"[^\"\n;]*+\"|'[^'\n;\"]*+')$")
        return F.when(_is_comment(t), _blank(t)).when(odd, F.concat(F.lit('"'), _blank(F.substring(t, F.lit(2), F.length(t) - 2)), F.lit('"'))).otherwise(t)

    return F.array_join(F.transform(_tokens(text, language), mask), "")


def bracket_depth(text: Column) -> Column:
    """(most, left, wrong) of a masked text: the deepest nesting, brackets left open, and whether one was closed by another kind."""
    marks = F.split(F.regexp_replace(text, r"[^()\[\]{}]", ""), "")
    start = F.struct(F.lit("").alias("stack"), F.lit(0).alias("most"), F.lit(False).alias("wrong"))

    def step(acc: Column, c: Column) -> Column:
        opens, closes = c.isin("(", "[", "{"), c.isin(")", "]", "}")
        fits = F.substring(acc["stack"], 1, 1) == F.translate(c, ")]}", "([{")
        stack = F.when(opens, F.concat(c, acc["stack"])).when(closes & fits, F.substring(acc["stack"], F.lit(2), F.length(acc["stack"]))).otherwise(acc["stack"])
        return F.struct(stack.alias("stack"), F.greatest(acc["most"], F.length(stack)).alias("most"), (acc["wrong"] | (closes & ~fits)).alias("wrong"))

    return F.aggregate(marks, start, step, lambda acc: F.struct(acc["most"].alias("most"), F.length(acc["stack"]).alias("left"), acc["wrong"].alias("wrong")))


#: What stands for a pair of brackets with its inside.
CALL, INDEX, BLOCK = "\u0002", "\u0003", "\u0004"


def bracket_groups(text: Column) -> Column:
    """The insides of all pairs of brackets of a masked text, and the text around them; a pair inside is CALL for (), INDEX for [] and BLOCK for {}.

    Pairs are taken out from the innermost outwards, one level in each round, as
    many rounds as the text is deep; each round reads what is left of the text.
    """
    inner = r"([(\[{])([^()\[\]{}]*+)[)\]}]"
    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, _: Column) -> Column:
        marked = F.regexp_replace(acc["text"], inner, "\u0001$1")
        for bracket, sign in (("(", CALL), ("[", INDEX), ("{", BLOCK)):
            marked = F.replace(marked, F.lit("\u0001" + bracket), F.lit(sign))
        return F.struct(marked.alias("text"), F.concat(acc["done"], F.regexp_extract_all(acc["text"], F.lit(inner), F.lit(2))).alias("done"))

    rounds = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(let(bracket_depth(text), lambda d: rounds(d["most"])), start, step, lambda acc: F.concat(acc["done"], F.array(acc["text"])))


def problems(text: Column, language: str = "rust") -> Column:
    """Why a text can't be read to its end, as an array: open comment, open string, unbalanced brackets, too deep. Empty if it can."""
    def judge(tokens: Column) -> Column:
        comment = F.exists(tokens, lambda t: t.startswith("/*") & (~t.endswith("*/") | (F.length(t) < 4)))
        string = F.exists(tokens, lambda t: t.rlike(_LITERAL[language]) & ~t.rlike(_CLOSED[language]))
        return F.struct(comment.alias("comment"), string.alias("string"))

    def found(d: Column, open_: Column) -> Column:
        crooked = (d["left"] > 0) | d["wrong"]
        return F.array_compact(F.array(F.when(open_["comment"], "open comment"), F.when(open_["string"], "open string"), F.when(crooked & ~open_["comment"] & ~open_["string"], "unbalanced brackets"), F.when(d["most"] > NESTED, "too deep")))

    return let(bracket_depth(masked(text, language)), lambda d: let(judge(_tokens(text, language)), lambda o: found(d, o)))


def numbered_words(text: Column, words: str) -> Column:
    """A text in which each match of the pattern `words` is followed by its line's number between the signs 1 and 2."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line, k: F.regexp_replace(line, F.lit(f"({words})"), F.concat(F.lit("$1\u0001"), (k + 1).cast("string"), F.lit("\u0002")))), "\n")


def unnumbered(text: Column) -> Column:
    return F.regexp_replace(text, "\u0001\\d+\u0002", "")
