"""Call sites, imports and signatures.

Tables: call_site(caller_id, call_kind, callee_name, qualifier), import(path,
short_name, full_path, is_glob), local_item(path, name), sol_import(path,
import_path, symbol, alias, line, pragma). Texts are read with comments and the
insides of literals blanked (functions/lexing.py) and over line ends, so
statements may be wrapped as one likes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.functions.lexing import BRACKETS, CALL, bracket_groups, masked, numbered_words, uncommented, unnumbered
from srcloom.functions.text import let, split_top_level, without_lifetimes
from srcloom.operators.containment import by_key
from srcloom.sources.shared import durable

# Method names that are no dependencies.
NOISE_METHODS = """
unwrap expect clone to_string to_owned iter into_iter map filter collect fold for_each find any all push pop len
is_empty contains get insert remove extend ok_or ok_or_else map_err and_then or_else unwrap_or unwrap_or_else as_ref
as_mut borrow borrow_mut into from try_into try_from default to_vec as_slice as_str is_some is_none is_ok is_err trim
trim_start trim_end split join replace starts_with ends_with lines chars bytes next enumerate skip take zip chain
flat_map flatten filter_map position count sort sort_by sort_by_key dedup
change_context attach_printable report into_report
key to_account_info to_accounts to_account_infos to_account_metas load load_mut load_init reload try_borrow_data
try_borrow_mut_data lamports data data_len data_is_empty owner executable rent_epoch program_id signer signers
cpi_accounts cpi_program set_inner exit try_serialize try_deserialize try_deserialize_unchecked try_accounts
checked_add checked_sub checked_mul checked_div checked_rem saturating_add saturating_sub saturating_mul
saturating_div wrapping_add wrapping_sub wrapping_mul wrapping_div overflowing_add overflowing_sub overflowing_mul
to_bytes as_array find_program_address create_program_address to_le_bytes to_be_bytes from_le_bytes from_be_bytes
""".split()
# Function names that are macros or constructors.
NOISE_FUNCTIONS = """
Ok Some Err None vec format println eprintln print eprint panic todo unimplemented unreachable assert assert_eq
assert_ne debug_assert debug_assert_eq debug_assert_ne write writeln log cfg include include_str include_bytes env
option_env concat stringify file line column module_path Box Vec String Arc Rc Mutex RefCell
msg emit emit_cpi require require_eq require_neq require_keys_eq require_keys_neq require_gt require_gte require_lt
require_lte invoke invoke_signed system_program
""".split()
# Built-in names of the contract language.
SOL_BUILTINS = """
require assert revert emit keccak256 sha256 ripemd160 ecrecover addmod mulmod selfdestruct type abi block msg tx
gasleft blockhash address uint256 uint int bool bytes string if else for while do return delete new this super push
pop length
""".split()
#: Words of the language before a parenthesis.
KEYWORDS = "if while for match return fn in let loop else as move pub mut ref where break unsafe async await dyn impl yield".split()


def noise_table(spark: SparkSession) -> DataFrame:
    """call_kind, callee_name of calls to leave out."""
    rows = [(k, n) for k in ("free", "static") for n in NOISE_FUNCTIONS] + [("method", n) for n in NOISE_METHODS]
    return spark.createDataFrame(rows, "call_kind string, callee_name string")


def symbol_bodies(source_line: DataFrame, symbol: DataFrame, mask: bool = False) -> DataFrame:
    """symbol_id and content, the text of each symbol's lines.

    Lines and symbols meet by file, one row for each, and every symbol takes its
    slice of the file's lines, so the cost is that of the text and of the slices.
    mask: comments and the insides of literals are blanked, as the whole file reads.
    """
    numbered = source_line.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("n"))
    lines = F.transform("n", lambda x: x["line"])
    files = numbered.select("path", F.get("n.line_no", F.lit(0)).alias("first"), (F.split(masked(F.array_join(lines, "\n")), "\n") if mask else lines).alias("lines"))
    wanted = symbol.groupBy(F.col("path").alias("s_path")).agg(F.collect_list(F.struct("symbol_id", "start_line", "end_line")).alias("s"))
    each = by_key(files).join(by_key(wanted), F.col("path") == F.col("s_path")).select("first", "lines", "s")
    cut = F.transform("s", lambda s: F.struct(s["symbol_id"].alias("symbol_id"), F.array_join(F.slice("lines", s["start_line"] - F.col("first") + 1, F.greatest(s["end_line"] - s["start_line"] + 1, F.lit(0))), "\n").alias("content")))
    return by_key(each.select(F.explode(cut).alias("c")).select("c.symbol_id", "c.content"))


_NAME = r"[A-Za-z_]\w*+"
#: Type arguments before a call.
_OF = rf"(?:::<[^;\u0004]*?>(?={CALL}))?"


def _plain(group: Column) -> Column:
    """A bracket group with one form for what may be written in several: no blanks around dots, colons and before calls, no header of a function, and a break for ranges, waits and errors handed on."""
    for pattern, new in (
        (r"\.\.=?", " ; "),
        (r"\s*(\.|::)\s*", "$1"),
        (rf"\s+{CALL}", CALL),
        (r"\.await\b", "?"),
        (rf"\bfn\s+\w+(?:<[^;]*?>(?={CALL}))?{CALL}", ";"),
        (r"<[\w\s&:'<>]*?\sas\s+([\w:]+)(?:<[^<>]*>)?>::", "$1::"),
        (rf"::<[^;{CALL}\u0004]*?>(?=::)", ""),
    ):
        group = F.regexp_replace(group, pattern, new)
    return group


def _chain_calls(chain: Column) -> Column:
    """The method calls of a chain `base.member.method()...` as structs of callee_name and qualifier.

    The qualifier is the chain before the method, arguments left out; a base that is
    no path (a call, an index, an error handed on) is left out of it, and it is
    null where nothing is left.
    """
    parts = F.transform(F.split(chain, r"\."), lambda e: F.replace(F.regexp_replace(e, r"::<.*>", ""), F.lit(CALL), F.lit("()")))

    def calls(p: Column) -> Column:
        known = (F.get(p, F.lit(0)) != "") & ~F.get(p, F.lit(0)).endswith("()")
        first = F.when(known, 1).otherwise(2)
        spot = F.filter(F.transform(p, lambda e, k: F.struct(e.alias("e"), k.alias("k"))), lambda x: (x["k"] > 0) & x["e"].endswith("()"))
        before = lambda x: F.array_join(F.slice(p, first, F.greatest(x["k"] + 1 - first, F.lit(0))), ".")
        return F.transform(spot, lambda x: F.struct(F.regexp_replace(x["e"], r"\(\)$", "").alias("callee_name"), F.when(before(x) != "", before(x)).alias("qualifier")))

    return let(parts, calls)


def call_sites(source_line: DataFrame, symbol: DataFrame, noise: DataFrame, in_macros: bool = True) -> DataFrame:
    """Free f(, static T::f( and method recv.f( calls of each function, without noise and repeats; the function's own header is no call.

    Brackets of a body are taken apart first, so a chain is read whole whatever
    its arguments and line ends are: `self.vault\\n.load(a)?.transfer(b)` calls load of
    self.vault, and transfer of a value without a name (qualifier null). in_macros:
    whether calls in the arguments of macros count.
    """
    text = symbol_bodies(source_line, symbol.where("item = 'function'") if "item" in symbol.columns else symbol, mask=True)
    code = F.col("content") if in_macros else F.regexp_replace("content", rf"\b\w+!\s*+{BRACKETS}", " ; ")
    groups = text.select("symbol_id", F.explode(bracket_groups(code)).alias("g")).where(F.contains("g", F.lit(CALL))).select("symbol_id", _plain(F.col("g")).alias("g"))
    path = rf"(?<![\w.:!])((?:{_NAME}::)*{_NAME}){_OF}{CALL}"
    chain = rf"(?:(?<![\w:.])(?:{_NAME}::)*{_NAME}{_OF}{CALL}?)?(?:\.\w++{_OF}{CALL}?)++"
    parts = lambda p: F.split(p, "::")
    named = F.transform(F.regexp_extract_all("g", F.lit(path), F.lit(1)), lambda p: F.struct(F.when(F.contains(p, F.lit("::")), "static").otherwise("free").alias("call_kind"), F.element_at(parts(p), -1).alias("callee_name"), F.when(F.contains(p, F.lit("::")), F.element_at(parts(p), -2)).alias("qualifier")))
    methods = F.transform(F.flatten(F.transform(F.filter(F.regexp_extract_all("g", F.lit(chain), F.lit(0)), lambda c: F.contains(c, F.lit(CALL))), _chain_calls)), lambda c: F.struct(F.lit("method").alias("call_kind"), c["callee_name"].alias("callee_name"), c["qualifier"].alias("qualifier")))
    found = groups.select("symbol_id", F.explode(F.concat(named, methods)).alias("c")).select("symbol_id", "c.*").where(~((F.col("call_kind") == "free") & F.col("callee_name").isin(KEYWORDS)))
    every = found.join(F.broadcast(noise), ["call_kind", "callee_name"], "left_anti")  # the noise words are a fixed list
    return by_key(every.distinct().select(F.col("symbol_id").alias("caller_id"), "call_kind", "callee_name", "qualifier"))


def call_names(source_line: DataFrame, symbol: DataFrame, noise: DataFrame) -> DataFrame:
    """The older form: calls by name only."""
    return call_sites(source_line, symbol, noise).select("caller_id", "callee_name").distinct()


def sol_call_sites(functions: DataFrame, id_col: str = "function_id", body: str = "body", builtins=None) -> DataFrame:
    """Distinct callees (`name`, or `object.method`) of each body by pattern, without built-ins; a method also counts by its own name."""
    words = list(builtins or SOL_BUILTINS)
    # words are tried from their first sign only, and not given back
    pair = r"(?<!\w)(\w++)\s*+\.\s*+(\w++)\s*+\("

    def callees(code: Column) -> Column:
        plain = F.filter(F.regexp_extract_all(code, F.lit(r"(?<!\w)(\w++)\s*+\("), F.lit(1)), lambda c: ~c.isin(words))
        both = F.arrays_zip(F.regexp_extract_all(code, F.lit(pair), F.lit(1)).alias("a"), F.regexp_extract_all(code, F.lit(pair), F.lit(2)).alias("b"))
        dotted = F.transform(F.filter(both, lambda z: ~z["a"].isin(words) & ~z["b"].isin(words)), lambda z: F.concat(z["a"], F.lit("."), z["b"]))
        return F.array_distinct(F.concat(plain, dotted))

    # a body is masked and read once
    return functions.select(id_col, F.explode(let(masked(F.col(body), "solidity"), callees)).alias("callee")).distinct()


def sol_calls(functions: DataFrame, id_col: str = "function_id", body: str = "body", builtins=None) -> DataFrame:
    """Distinct callees of each body by its structure: `name` for a call by name, `object.method` for a call on a name, both without built-ins.

    Events that are emitted and errors that are raised are no calls, nor is what stands in
    their arguments; a method of anything but a plain name (a call, an index, a member) is none either.
    """
    words = list(builtins or SOL_BUILTINS)
    code = F.regexp_replace(masked(F.col(body), "solidity"), rf"\b(?:emit|revert)\s+[\w.]+\s*+{BRACKETS}", ";")
    groups = functions.select(id_col, F.explode(bracket_groups(code)).alias("g")).where(F.contains("g", F.lit(CALL)))
    plain = F.regexp_replace(F.regexp_replace("g", r"\s*\.\s*", "."), rf"\s+{CALL}", CALL)
    found = groups.select(id_col, F.explode(F.regexp_extract_all(plain, F.lit(rf"(?<![\w.{CALL}\u0003])((?:{_NAME}\.)?{_NAME}){CALL}"), F.lit(1))).alias("callee"))
    return found.where(~F.substring_index("callee", ".", 1).isin(words)).distinct()


def import_scope(source_file: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(import, local_item) of each file.

    `use a::{b, c as d, e::*}` is opened from the outermost braces inwards, one
    level in each round, until no group is left.
    """
    text = F.regexp_replace(masked(F.col("content")), r"\s+", " ")
    now = source_file.select("path", F.explode(F.regexp_extract_all(text, F.lit(r"(?:^|[;}{ ])use ([^;]+);"), F.lit(1))).alias("u")).select("path", F.trim(F.regexp_replace("u", r"\s*(::|,|\{|\})\s*", "$1")).alias("u"))
    done = now.where(~F.contains("u", F.lit("{")))
    while not (grouped := durable(now.where(F.contains("u", F.lit("{"))))).isEmpty():
        head, inner = F.regexp_extract("u", r"^([^{]*)\{", 1), F.regexp_extract("u", r"^[^{]*\{(.*)\}$", 1)
        now = grouped.select("path", head.alias("h"), F.explode(split_top_level(inner)).alias("i")).select("path", F.concat("h", "i").alias("u"))
        done = done.unionByName(now.where(~F.contains("u", F.lit("{"))))
    target, alias = F.trim(F.regexp_extract("u", r"^(.*?)(?: as \w+)?$", 1)), F.regexp_extract("u", r" as (\w+)$", 1)
    bare = F.regexp_replace(target, r"::self$", "")
    glob = target.endswith("*")
    found = done.select("path", F.when(glob, "*").when(alias != "", alias).otherwise(F.element_at(F.split(bare, "::"), -1)).alias("short_name"), F.when(glob, F.regexp_replace(target, r"::\*$", "")).otherwise(bare).alias("full_path"), glob.alias("is_glob")).distinct()
    item = r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:fn|struct|enum|trait|mod|type|const|static|union)\s+(\w+)"
    local = source_file.select("path", F.explode(F.regexp_extract_all(masked(F.col("content")), F.lit(item), F.lit(1))).alias("name")).distinct()
    return found, local


def sol_imports(source_file: DataFrame) -> DataFrame:
    """Imports with symbols, aliases, the line of the word `import` and the file's pragma; statements may go over lines."""
    text = numbered_words(uncommented(F.col("content"), "solidity"), r"\bimport\b")
    quoted = r"""["']([^"'\n]+)["']"""
    rows = source_file.select("path", F.trim(F.regexp_extract(masked(F.col("content"), "solidity"), r"\bpragma\s+([^;]+);", 1)).alias("pragma"), F.explode(F.regexp_extract_all(text, F.lit("(?:^|[;}\\s])import(\u0001\\d+\u0002[^;]*);"), F.lit(1))).alias("s"))
    said = F.regexp_replace(unnumbered(F.col("s")), r"\s+", " ")
    found = rows.where(said.rlike(quoted)).select("path", "pragma", F.regexp_extract("s", "\u0001(\\d+)\u0002", 1).cast("int").alias("line"), said.alias("said"))
    at = found.select("path", "pragma", "line", F.regexp_extract("said", quoted, 1).alias("import_path"), F.regexp_extract("said", r"\{([^}]*)\}", 1).alias("group"), F.regexp_extract("said", r"(?:\*|" + quoted + r")\s*as\s+(\w+)", 2).alias("whole"))
    parts = at.withColumn("p", F.explode_outer(F.filter(F.transform(F.split("group", ","), lambda s: F.trim(s)), lambda s: s != "")))
    name, alias = F.regexp_extract("p", r"^(\w+)", 1), F.regexp_extract("p", r"\bas\s+(\w+)$", 1)
    return parts.select("path", "import_path", F.when(name != "", name).alias("symbol"), F.when(alias != "", alias).when(F.col("whole") != "", F.col("whole")).alias("alias"), "line", F.when(F.col("pragma") != "", F.col("pragma")).alias("pragma"))


def signature_params(symbol: DataFrame, source_line: DataFrame) -> DataFrame:
    """Signature (up to the arrow), body and parameters of each function, the receiver left out."""
    functions = symbol.where("item = 'function'") if "item" in symbol.columns else symbol
    text = symbol_bodies(source_line, functions)
    head = F.trim(F.regexp_replace(F.regexp_extract("content", r"(?s)^(.*?)\{", 1), r"\s+", " "))
    cut = text.select("symbol_id", F.trim(F.regexp_replace(head, r"\s*->.*$", "")).alias("signature"), F.regexp_extract("content", r"(?s)^.*?(\{.*\})", 1).alias("body"))
    inner = F.regexp_extract("signature", r"(?s)\w+\s*(?:<[^(]*>)?\s*\((.*)\)$", 1)
    # the fold over characters runs once for a text of the length of a header
    listed = cut.withColumn("items", F.filter(split_top_level(inner), lambda p: ~p.rlike(r"^(&\s*)?('\w+\s+)?(mut\s+)?self$") & F.contains(p, F.lit(":"))))
    out = listed.select("symbol_id", "signature", "body", F.posexplode_outer("items").alias("at", "p"))
    return out.select("symbol_id", "signature", "body", (F.col("at") + 1).alias("ord"), F.trim(F.regexp_extract("p", r"^(?:mut\s+)?(\w+)\s*:", 1)).alias("param_name"), F.trim(F.regexp_extract("p", r"^[^:]*:\s*(.*)$", 1)).alias("param_type"))


def type_parts(df: DataFrame, col: str) -> DataFrame:
    """df with wrapper, lifetime, inner, is_boxed and context_inner of a type's text."""
    bare = F.trim(F.regexp_replace(F.col(col), r"^(?:&\s*(?:'\w+\s+)?(?:mut\s+)?)+", ""))
    boxed = bare.rlike(r"^(?:\w+::)*Box\s*<")
    unboxed = F.when(boxed, F.trim(F.regexp_extract(bare, r"^(?:\w+::)*Box\s*<\s*(.*)>\s*$", 1))).otherwise(bare)
    wrapper = F.regexp_extract(unboxed, r"^(?:\w+::)*(\w+)", 1)
    args = F.regexp_extract(unboxed, r"<\s*(.*)>\s*$", 1)
    items = F.filter(split_top_level(args), lambda a: ~a.startswith("'"))
    inner = F.coalesce(F.get(items, F.lit(0)), wrapper)
    context = F.when((wrapper == "Context") & (F.size(items) > 0), F.regexp_extract(without_lifetimes(F.element_at(items, -1)), r"^(?:\w+::)*(\w+)", 1))
    return df.withColumns({"wrapper": wrapper, "lifetime": F.regexp_extract(unboxed, r"<\s*('\w+)", 1), "inner": inner, "is_boxed": boxed, "context_inner": context})
