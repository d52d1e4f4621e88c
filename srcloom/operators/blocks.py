"""Lines, blocks, symbols and what is found inside them.

Tables: source_file(path, content, ...), source_line(path, line_no, line,
indent), block(path, kind, start_line, end_line, indent), symbol(symbol_id,
item, sub_type, name, program, path, start_line, end_line). Lines count from 1.
Rules are rows of plain values, so that other languages need other rows only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom.functions.lexing import masked
from srcloom.functions.text import file_stem, indent, lines_of, stable_id, stripped
from srcloom.operators.containment import by_key, within


@dataclass(frozen=True)
class BlockRule:
    """opens: words a trimmed line begins with; ends: what the opening line must contain; closers: what follows the indent of the closing line."""

    kind: str
    opens: tuple[str, ...]
    ends: tuple[str, ...]
    closers: tuple[str, ...]
    not_semicolon: bool = False  # an opening line that ends in ; opens nothing
    closes_itself: bool = False  # the opening line may hold the closer
    closer_contained: bool = False  # a later line closes if it contains indent and closer


# The block kinds and their words.
RULES = (
    BlockRule("Function", ("fn", "pub fn", "pub(crate) fn"), ("(",), ("}",), not_semicolon=True),
    BlockRule("Struct", ("struct", "pub struct"), ("{", ";"), ("}", ";"), closes_itself=True),
    BlockRule("Enum", ("enum", "pub enum"), ("{", ";"), ("}", ";")),
    BlockRule("Trait", ("trait", "pub trait"), ("{", ";"), ("}", ";")),
    BlockRule("TraitImpl", ("impl",), ("{", ";"), ("}", ";")),
    BlockRule("Module", ("mod", "pub mod"), ("{",), ("}",)),
    BlockRule("If", ("if",), ("{",), ("}",)),
    BlockRule("IfValidation", ("if",), ("{",), ("}",)),
    BlockRule("Validation", ("require", "valid", "assert", "verify"), ("(",), (");", ")?;", ")"), closes_itself=True),
    BlockRule("ContextAccountsNoValidation", ("pub", "#[account"), ("(", ">,"), ("pub", "}"), closes_itself=True, closer_contained=True),
)
_SEEN = ("", "pub ", "pub(crate) ", "pub(super) ", "pub(self) ")
_HOW = ("", "async ", "unsafe ", "const ", "const unsafe ", "async unsafe ", 'extern "C" ', 'unsafe extern "C" ')
_WORDS = {"Function": [h + "fn" for h in _HOW], "Struct": ["struct"], "Enum": ["enum"], "Trait": ["trait", "unsafe trait"], "Module": ["mod"]}
#: The same kinds with every visibility and function qualifier of the language; impl may be unsafe.
FULL_RULES = tuple(
    replace(r, opens=tuple(v + w for v in _SEEN for w in _WORDS[r.kind])) if r.kind in _WORDS else replace(r, opens=("impl", "unsafe impl")) if r.kind == "TraitImpl" else r
    for r in RULES
)
SYMBOL_KINDS = {"Function": "function", "Struct": "struct", "Enum": "enum", "Trait": "trait", "TraitImpl": "trait"}


def masked_lines(source_file: DataFrame, language: str = "rust") -> DataFrame:
    """source_lines with comments and the insides of literals blanked, and the line as it stands as `raw`.

    What is scanned for structure (blocks, braces, fields) is scanned in these; what reads
    comments, attributes or literals reads source_lines.
    """
    both = source_file.select("path", F.posexplode(F.arrays_zip(lines_of(masked(F.col("content"), language)).alias("line"), lines_of(F.col("content")).alias("raw"))).alias("at", "x"))
    return by_key(both.select("path", (F.col("at") + 1).alias("line_no"), "x.line", indent(F.col("x.line")).alias("indent"), "x.raw"))


def source_lines(source_file: DataFrame) -> DataFrame:
    """One row for each line of each file."""
    out = source_file.select("path", F.posexplode(lines_of(F.col("content"))).alias("at", "line"))
    return by_key(out.select("path", (F.col("at") + 1).alias("line_no"), "line", indent(F.col("line")).alias("indent")))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _opens(rule: BlockRule, legacy: bool, bare: Column) -> Column:
    """Whether the line, stripped as bare, opens a block. Patterns are for lines that hold an ending and begin with a word: few do."""
    line = F.col("line")
    first = _any(bare.startswith(w if legacy else w.split('"')[0]) for w in rule.opens)
    if not legacy:  # the word must end there; validation words may go on (require_eq!)
        edge = "" if rule.kind == "Validation" else r"(?![A-Za-z0-9_])"
        # literals are blanked in masked lines, so any calling convention does
        quoted = "|".join(w.replace("(", r"\(").replace(")", r"\)").replace("[", r"\[").replace('"C"', '"[^"]*"') for w in rule.opens)
        first = first & bare.rlike(f"^(?:{quoted}){edge}")
    found = _any(F.contains(line, F.lit(e)) for e in rule.ends) & first
    return found & ~line.endswith(";") if rule.not_semicolon else found


def block_scan(source_line: DataFrame, rules=RULES, kinds=None, legacy: bool = False, strict_spaces: bool = False, head: bool = False) -> DataFrame:
    """Blocks of every kind in one pass over the lines.

    An opening line is closed by the first later line that is its indent
    followed by a closer. Lines with the same indent are looked at from the end
    of the file, so the closer is a running value and no line looks ahead.
    legacy: an opening word needs no word boundary. strict_spaces: blocks
    indented with other white space than blanks never close. head: with the opening line, stripped.
    """
    picked = [r for r in rules if kinds is None or r.kind in kinds or (r.kind == "Validation" and "IfValidation" in kinds)]
    partition = ["path", *[c for c in ("owner",) if c in source_line.columns]]
    bare = F.expr("substring(line, length(indent) + 1)")
    closes = lambda r: (r.closer_contained, r.closers)
    ways = list(dict.fromkeys(closes(r) for r in picked))
    held_by = lambda closers: _any(F.contains("line", F.lit(c)) for c in closers)
    # each line is judged once; only those that open or close something, without their text, are sorted and looked at
    mark = {f"o{k}": lambda words, r=r: _opens(r, legacy, words) for k, r in enumerate(picked)}
    mark |= {f"c{k}": lambda _, c=held_by(closers) if contained else bare.isin(*closers): c for k, (contained, closers) in enumerate(ways)}
    mark |= {f"s{k}": lambda _, c=held_by(r.closers): c for k, r in enumerate(picked) if r.closes_itself}
    some = lambda x, kind: _any(F.coalesce(x[c], F.lit(False)) for c in mark if c[0] in kind)
    one = F.transform(F.array(stripped(F.col("line"))), lambda words: F.struct(*[c(words).alias(n) for n, c in mark.items()]))
    first = ["head"] if head else []
    text = [F.when(some(F.col("m"), "o"), stripped(F.col("line"))).alias("head")] if head else []
    marked = source_line.select(*partition, "line_no", "indent", *(["line"] if head else []), F.explode(F.filter(one, lambda x: some(x, "oc"))).alias("m")).select(*partition, "line_no", "indent", *text, "m.*")
    looks = lambda *keys: Window.partitionBy(*partition, *keys).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    for contained, back in ((False, looks("indent")), (True, looks())):
        marked = marked.withColumns({f"e{k}": F.last(F.when(F.col(f"c{k}"), F.col("line_no")), ignorenulls=True).over(back) for k, w in enumerate(ways) if w[0] == contained})
    ends = []
    for k, r in enumerate(picked):
        found = F.col(f"e{ways.index(closes(r))}")
        if r.closes_itself:
            found = F.when(F.col(f"s{k}"), F.col("line_no")).otherwise(found)
        if strict_spaces:
            found = F.when(F.col("indent").rlike("^ *$"), found)
        ends.append((r.kind, F.when(F.col(f"o{k}"), found)))
    if any(kind == "IfValidation" for kind, _ in ends):  # an if that the next validation, its own line included, begins in
        checks = F.when(_any(e.isNotNull() for kind, e in ends if kind == "Validation"), F.col("line_no"))
        marked = marked.withColumn("next", F.last(checks, ignorenulls=True).over(looks().rowsBetween(Window.unboundedPreceding, 0)))
        ends = [(kind, F.when(F.col("next") <= e, e) if kind == "IfValidation" else e) for kind, e in ends]
    hits = [F.when(e.isNotNull(), F.struct(F.lit(kind).alias("kind"), e.alias("end_line"))) for kind, e in ends]
    out = marked.where(some(marked, "o")).select(*partition, "line_no", "indent", *first, F.explode(F.array_compact(F.array(*hits))).alias("h"))
    blocks = by_key(out.select(*partition, "h.kind", F.col("line_no").alias("start_line"), "h.end_line", "indent", *first))
    return blocks if kinds is None else blocks.where(F.col("kind").isin(*kinds))


def block_in_range(source_line: DataFrame, symbol: DataFrame, rules=RULES, kinds=None) -> DataFrame:
    """Blocks inside the line range of each symbol: symbol_id, kind, start_line, end_line."""
    s = symbol.select("symbol_id", F.col("path").alias("s_path"), F.col("start_line").alias("s_from"), F.col("end_line").alias("s_to"))
    inside = within(source_line, s, [("path", "s_path")], "line_no", F.col("s_from"), F.col("s_to"))
    out = block_scan(inside.select("path", "line_no", "line", "indent", F.col("symbol_id").alias("owner")), rules, kinds)
    return out.select(F.col("owner").alias("symbol_id"), "kind", "start_line", "end_line")


def block_after_marker(source_line: DataFrame, marker: str, rules=RULES, kinds=None) -> DataFrame:
    """The first block of each kind that starts on or after the first line containing the marker, for each file."""
    at = source_line.where(F.contains("line", F.lit(marker))).groupBy("path").agg(F.min("line_no").alias("marked"))
    found = by_key(block_scan(source_line, rules, kinds)).join(at, "path").where("start_line >= marked")
    first = Window.partitionBy("path", "kind").orderBy("start_line")
    return found.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "marked")


def block_name_visibility(block: DataFrame, source_line: DataFrame) -> DataFrame:
    """Blocks with the name and pub flag read from the opening line; an impl is named `Trait for Type`."""
    first = source_line.select("path", F.col("line_no").alias("start_line"), stripped(F.col("line")).alias("head"))
    return by_key(_named(by_key(block).join(by_key(first), ["path", "start_line"])))


def _named(block: DataFrame) -> DataFrame:
    """Blocks with a head (the stripped opening line) with name and pub flag instead."""
    named = F.regexp_extract("head", r"(?:fn|struct|enum|trait|mod)\s+(\w+)", 1)
    impl = F.trim(F.regexp_extract("head", r"^(?:unsafe )?impl(?:<[^>]*>)?\s+(.*?)\s*(?:where\b.*)?(?:\{.*)?$", 1))
    return block.withColumns({"name": F.when(F.col("kind") == "TraitImpl", impl).otherwise(named), "is_public": F.col("head").rlike(r"^pub\b")}).drop("head")


def symbol_extract(source_file: DataFrame, rules=RULES) -> DataFrame:
    """Functions, structs, enums, traits and implementations of the files; what stands in comments and literals is none."""
    lines = masked_lines(source_file).drop("raw")
    named = _named(block_scan(lines, rules, list(SYMBOL_KINDS), head=True))
    item = F.create_map(*[F.lit(x) for kv in SYMBOL_KINDS.items() for x in kv])[F.col("kind")]
    program = "program" if "program" in source_file.columns else None
    sub = F.when(F.col("kind") == "Trait", "Definition").when(F.col("kind") == "TraitImpl", "Implementation").when(F.col("kind") == "Enum", "Enum").otherwise("Other")
    out = named.select(stable_id(F.lit("symbol"), F.col("path"), F.col("kind"), F.col("start_line")).alias("symbol_id"), item.alias("item"), sub.alias("sub_type"), "name", "is_public", "path", "start_line", "end_line")
    return by_key(by_key(out).join(by_key(source_file.select("path", "program").distinct()), "path") if program else out)


def attribute_lines(symbol: DataFrame, source_line: DataFrame) -> DataFrame:
    """symbol_id and the text of the attribute and comment lines directly above each symbol."""
    # lines above run together as long as each is an attribute or a comment: islands of such lines
    marked = source_line.withColumn("above", stripped(F.col("line")).rlike(r"^(#!?\[|//)") | stripped(F.col("line")).rlike(r"\)\]$"))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    islands = marked.withColumn("stop", F.max(F.when(~F.col("above"), F.col("line_no"))).over(w)).where("above")
    runs = islands.groupBy("path", "stop").agg(F.max("line_no").alias("last"), F.min("line_no").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("above"))
    keyed = runs.select("path", (F.col("last") + 1).alias("start_line"), "above", F.col("first").alias("above_from"))
    joined = by_key(symbol.select("symbol_id", "path", "start_line")).join(by_key(keyed), ["path", "start_line"], "left")
    return by_key(joined.select("symbol_id", F.coalesce("above", F.lit("")).alias("above"), "above_from"))


def symbol_classify(symbol: DataFrame, source_line: DataFrame, rules=RULES) -> DataFrame:
    """symbol with sub_type from attributes and from the modules and implementations around it."""
    above = attribute_lines(symbol, source_line)
    heads = source_line.select("path", F.col("line_no").alias("start_line"), F.col("line").alias("head"))
    base = by_key(by_key(symbol.drop("sub_type")).join(above.select("symbol_id", "above"), "symbol_id").join(by_key(heads), ["path", "start_line"]))
    modules = block_scan(source_line, rules, ["Module"]).withColumn("symbol_id", stable_id(F.lit("mod"), F.col("path"), F.col("start_line")))
    program = by_key(modules).join(attribute_lines(modules, source_line), "symbol_id").where(F.col("above").rlike(r"#\[program\]")).select(F.col("path").alias("m_path"), F.col("start_line").alias("m_from"), F.col("end_line").alias("m_to"))
    inside = base.where("item = 'function'").select("symbol_id", "path", "start_line", "end_line")
    inside = within(inside, program, [("path", "m_path")], "start_line", F.col("m_from") + 1, F.col("m_to"), "left_semi", F.col("end_line") < F.col("m_to")).select("symbol_id", F.lit(True).alias("in_program"))
    views = base.where(F.col("head").rlike(r"impl(<[^>]*>)?\s+TryFrom\s*<\s*&.*\[\s*AccountView\s*\]\s*>\s+for\s")).select("path", F.regexp_extract("head", r"\sfor\s+(\w+)", 1).alias("name")).distinct().withColumn("converts", F.lit(True))
    out = base.join(inside, "symbol_id", "left").join(by_key(views), ["path", "name"], "left")
    function = F.when(F.coalesce("in_program", F.lit(False)) | F.col("head").rlike(r"^\s*pub fn process\s*\(.*AccountView"), "EntryPoint").otherwise("Other")
    struct = F.when(F.col("above").rlike(r"derive\([^)]*\bAccounts\b") | F.coalesce("converts", F.lit(False)), "ContextAccounts").when(F.col("above").rlike(r"#\[account(\]|\()|derive\([^)]*\bCodamaAccount\b"), "SolanaAccount").otherwise("Other")
    trait = F.when(F.trim("head").rlike(r"^(pub )?trait\b"), "Definition").otherwise("Implementation")
    sub = F.when(F.col("item") == "function", function).when(F.col("item") == "struct", struct).when(F.col("item") == "trait", trait).otherwise("Enum")
    return by_key(out.withColumn("sub_type", sub).select(*symbol.columns))


def entry_rename(symbol: DataFrame) -> DataFrame:
    """An entry named `process` takes its file's stem."""
    return symbol.withColumn("name", F.when((F.col("sub_type") == "EntryPoint") & (F.col("name") == "process"), file_stem(F.col("path"))).otherwise(F.col("name")))


def brace_blocks(source_line: DataFrame, starts: DataFrame, fallback: int = 20) -> DataFrame:
    """For each (path, start_line) of starts, the line on which the braces opened from there are closed again; else start + fallback, at most the last line."""
    braces = F.split(F.regexp_replace("line", r"[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("closed"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.when(c == "}", F.concat(acc["closed"], F.array(now))).otherwise(acc["closed"]).alias("closed"))

    folded = source_line.select("path", "line_no", F.aggregate(braces, start, step).alias("b"))
    upto = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    depth = folded.select("path", "line_no", "b.closed", (F.sum("b.now").over(upto) - F.col("b.now")).alias("before"))
    # a } brings the depth to some level; a start waits for the next } that brings it back to its own
    events = depth.select("path", F.explode("closed").alias("to"), "before", "line_no").select("path", (F.col("before") + F.col("to")).alias("level"), "line_no", F.lit(False).alias("is_start"))
    waiting = by_key(starts.select("path", F.col("start_line").alias("line_no"))).join(by_key(depth).select("path", "line_no", F.col("before").alias("level")), ["path", "line_no"]).withColumn("is_start", F.lit(True))
    back = Window.partitionBy("path", "level").orderBy(F.desc("line_no"), "is_start").rowsBetween(Window.unboundedPreceding, 0)
    found = events.unionByName(waiting).withColumn("end_line", F.last(F.when(~F.col("is_start"), F.col("line_no")), ignorenulls=True).over(back)).where("is_start")
    ends = source_line.groupBy("path").agg(F.max("line_no").alias("total"))
    return by_key(found).join(by_key(ends), "path").select("path", F.col("line_no").alias("start_line"), F.coalesce("end_line", F.least(F.col("line_no") + fallback, "total")).alias("end_line"))


def validations_in_functions(source_line: DataFrame, symbol: DataFrame, rules=RULES) -> DataFrame:
    """If blocks that hold a validation, and validations outside of such blocks, for each function."""
    blocks = block_in_range(source_line, symbol.where("item = 'function'") if "item" in symbol.columns else symbol, rules, ["IfValidation", "Validation"])
    ifs = blocks.where("kind = 'IfValidation'")
    cover = ifs.select(F.col("symbol_id").alias("i_id"), F.col("start_line").alias("i_from"), F.col("end_line").alias("i_to"))
    alone = within(blocks.where("kind = 'Validation'"), cover, [("symbol_id", "i_id")], "start_line", F.col("i_from"), F.col("i_to"), "left_anti", F.col("end_line") <= F.col("i_to"))
    return by_key(ifs.unionByName(alone).select("symbol_id", F.col("kind").alias("origin"), "start_line", "end_line"))


def doc_start(source_line: DataFrame, symbol: DataFrame) -> DataFrame:
    """The first line of the comment directly above each function; its own first line if there is none."""
    comment = stripped(F.col("line")).rlike(r"^(///|/\*\*|\*|//)")
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    runs = source_line.withColumn("c", comment).withColumn("stop", F.max(F.when(~F.col("c"), F.col("line_no"))).over(w)).where("c").groupBy("path", "stop").agg(F.min("line_no").alias("doc_line"), (F.max("line_no") + 1).alias("start_line"))
    joined = by_key(symbol.select("symbol_id", "path", "start_line")).join(by_key(runs.drop("stop")), ["path", "start_line"], "left")
    return by_key(joined.select("symbol_id", F.coalesce("doc_line", "start_line").alias("doc_line")))


def struct_fields(symbol: DataFrame, source_line: DataFrame) -> DataFrame:
    """`pub name: type` fields of structs, in order."""
    s = symbol.select("symbol_id", F.col("path").alias("s_path"), F.col("start_line").alias("s_from"), F.col("end_line").alias("s_to"))
    inside = within(source_line, s, [("path", "s_path")], "line_no", F.col("s_from") + 1, F.col("s_to"))
    text = stripped(F.col("line"))
    found = inside.where(text.rlike(r"^pub(\([a-z]+\))?\s+\w+\s*:")).select("symbol_id", "line_no", F.regexp_extract(text, r"^pub(?:\([a-z]+\))?\s+(\w+)\s*:", 1).alias("field"), F.regexp_extract(text, r":\s*(.*?),?\s*(?://.*)?$", 1).alias("type"))
    return found.select("symbol_id", F.row_number().over(Window.partitionBy("symbol_id").orderBy("line_no")).alias("ord"), "field", "type")
