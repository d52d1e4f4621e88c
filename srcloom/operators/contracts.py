"""Contracts: what files declare, who may call what, and what calls resolve to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom.functions.lexing import BRACES, PARENS, masked, numbered_words, unnumbered
from srcloom.functions.text import split_top_level
from srcloom.operators.containment import by_key
from srcloom.operators.graph import Seen
from srcloom.sources.shared import compact, durable

_KIND = {"contract": "Contract", "abstract contract": "Abstract", "interface": "Interface", "library": "Library"}


def _visibility(words: Column) -> Column:
    return F.when(words.rlike(r"\bpublic\b"), "Public").when(words.rlike(r"\bexternal\b"), "External").when(words.rlike(r"\bprivate\b"), "Private").otherwise("Internal")


#: Words that carry their line number through the patterns below, and where a body or a declaration ends.
_MARKED = r"\b(?:contract|interface|library|function|constructor|receive|fallback|modifier|event)\b|[};]"
_AT = "\u0001(\\d+)\u0002"
_BODY = rf"({BRACES}{_AT}|;{_AT})"


def _each(df: DataFrame, column: str, pattern: str, *names: str) -> DataFrame:
    """df with a row for each match of the pattern in the column and its groups under these names; a `_` names none."""
    groups = [F.regexp_extract_all(column, F.lit(pattern), F.lit(k)).alias(n) for k, n in enumerate(names, 1) if n != "_"]
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.explode(F.arrays_zip(*groups)).alias("__m")).select(*kept, "__m.*")


def _last_line(text: Column) -> Column:
    """The number that stands at the end of a numbered text."""
    return F.regexp_extract(text, f"{_AT}$", 1).cast("int")


def contract_extract(source_file: DataFrame) -> dict[str, DataFrame]:
    """The tables contract, contract_function, contract_modifier, storage_var and event_def of the files.

    Comments and the insides of literals are blanked, then braces are matched: a
    contract is its header and the braces behind it, and its members are the
    declarations directly in these. So functions, events and variables of the file
    itself belong to no contract, and what stands in the body of a function is none
    of its contract's members. Contracts, functions and modifiers have the lines
    of their first word and of their last brace (or semicolon); body is the text in braces, blanked, and null for declarations.
    Functions default to internal and non-payable. Ids are
    `path|contract|function(types)`; legacy_id leaves the types out, as overloads
    then share it. Files with braces that do not match give what can be read (see rejects).
    """
    text = numbered_words(masked(F.col("content"), "solidity"), _MARKED)
    header = rf"(\b(?:abstract\s+)?(?:contract|interface|library)){_AT}\s+(\w+)([^{{}};]*)({BRACES}{_AT})"
    found = _each(source_file.select("path", text.alias("t")), "t", header, "word", "start_line", "contract", "rest", "body")
    word = F.regexp_replace("word", r"\s+", " ")
    bases = F.filter(F.transform(split_top_level(F.regexp_extract(unnumbered(F.col("rest")), r"(?s)^\s*is\b(.*)$", 1)), lambda b: F.regexp_extract(b, r"([\w]+)\s*(?:\(|$)", 1)), lambda b: b != "")
    kind = F.create_map(*[F.lit(x) for kv in _KIND.items() for x in kv])[word]
    contract = found.select("path", "contract", kind.alias("contract_type"), bases.alias("bases"), F.contains("path", F.lit("/lib/")).alias("external"), F.col("start_line").cast("int").alias("start_line"), _last_line(F.col("body")).alias("end_line"), F.regexp_replace("body", f"^\\{{|\\}}{_AT}$", "").alias("body"))
    contract = durable(contract)  # the four kinds of members are read from it

    members = contract.select("path", "contract", "body")
    fn = rf"\b(function{_AT}\s+\w+|(?:constructor|receive|fallback){_AT})\s*({PARENS})([^{{}};]*){_BODY}"
    f = _each(members, "body", fn, "n", "_", "_", "p", "w", "body")
    listed = split_top_level(F.regexp_replace(F.regexp_replace(unnumbered(F.col("p")), r"^\(|\)$", ""), r"\s+", " "))
    params = F.transform(listed, lambda p: F.struct(F.regexp_extract(p, r"^.*[\s)\]](\w+)$", 1).alias("name"), F.regexp_extract(p, r"^((?:mapping|function)\s*\(.*\)|[\w.]+(?:\s*\[[^\]]*\])*)", 1).alias("type_name"), F.regexp_extract(p, r"\b(memory|calldata|storage)\b", 1).alias("storage_location")))
    name = F.regexp_extract(unnumbered(F.col("n")), r"(\w+)$", 1)
    words = F.regexp_replace(F.regexp_replace(unnumbered(F.col("w")), rf"\breturns\s*{PARENS}", ""), r"\s+", " ")
    mods = F.filter(F.regexp_extract_all(F.regexp_replace(words, PARENS, ""), F.lit(r"([\w.]+)"), F.lit(1)), lambda w: ~w.isin("public", "external", "internal", "private", "view", "pure", "payable", "virtual", "override"))
    mods = F.transform(mods, lambda w: F.substring_index(w, ".", -1))
    mutability = F.when(words.rlike(r"\bview\b"), "View").when(words.rlike(r"\bpure\b"), "Pure").when(words.rlike(r"\bpayable\b"), "Payable").otherwise("NonPayable")
    block = F.when(F.col("body").startswith("{"), unnumbered(F.col("body")))
    first = F.regexp_extract("n", _AT, 1).cast("int")
    function = f.select("path", "contract", name.alias("name"), params.alias("params"), _visibility(words).alias("visibility"), mutability.alias("mutability"), mods.alias("modifiers"), name.isin("constructor").alias("is_constructor"), first.alias("start_line"), _last_line(F.col("body")).alias("end_line"), block.alias("body"))
    types = F.array_join(F.transform("params", lambda p: p["type_name"]), ",")
    function = function.withColumns({"legacy_id": F.concat_ws("|", "path", "contract", "name"), "function_id": F.concat(F.concat_ws("|", "path", "contract", "name"), F.lit("("), types, F.lit(")"))})

    m = _each(members, "body", rf"\bmodifier{_AT}\s+(\w+)([^{{}};]*){_BODY}", "start_line", "name", "_", "body")
    modifier = m.select("path", "contract", "name", F.col("start_line").cast("int").alias("start_line"), _last_line(F.col("body")).alias("end_line"), F.when(F.col("body").startswith("{"), unnumbered(F.col("body"))).alias("body"))
    # what stands in braces is no declaration of the contract, nor is what leads to them
    outer = F.concat(F.lit(";"), F.regexp_replace(F.regexp_replace("body", rf"[^;{{}}=]*+{BRACES}", ";"), "\u0001\\d+\u0002", ""))
    plain = members.select("path", "contract", outer.alias("o"))
    event = _each(plain, "o", r"[;\s]event\s+(\w+)\s*\(", "name")
    var = rf"(?<=;)\s*(mapping\s*{PARENS}|[A-Za-z_][\w.]*(?:\s*\[[^\]]*\])*)\s+((?:(?:public|private|internal|constant|immutable|transient|override)\s+)*)(\w+)\s*(?:=[^;]*)?(?=;)"
    v = _each(plain, "o", var, "t", "w", "name").where(~F.col("t").isin("using", "event", "error", "modifier", "function", "struct", "enum", "return", "import", "pragma", "type"))
    storage = v.select("path", "contract", "name", F.col("t").alias("type_name"), _visibility(F.col("w")).alias("visibility"), F.col("w").rlike(r"\b(constant|immutable)\b").alias("is_constant"))
    return {"contract": contract.drop("body"), "contract_function": function, "contract_modifier": modifier, "storage_var": storage, "event_def": event}


def access_control(contract_function: DataFrame, id_col: str = "function_id") -> DataFrame:
    """(id, kind, arg) for each modifier that controls access; kind None for functions without one.

    modifiers is an array column. The role of a role check is not read and is
    always the default one.
    """
    m = F.col("m")
    kind = F.when(m.isin("onlyOwner"), "OnlyOwner").when(m.isin("onlyRole"), "RoleBased").when(m.startswith("only"), "CustomModifier")
    each = contract_function.select(id_col, F.explode_outer("modifiers").alias("m")).withColumn("kind", kind)
    some = each.where("kind is not null").select(id_col, "kind", F.when(F.col("kind") == "RoleBased", "DEFAULT_ADMIN_ROLE").when(F.col("kind") == "CustomModifier", m).alias("arg")).distinct()
    none = each.groupBy(id_col).agg(F.count("kind").alias("n")).where("n = 0").select(id_col, F.lit("None").alias("kind"), F.lit(None).cast("string").alias("arg"))
    return some.unionByName(none)


def overload_names(contract_function: DataFrame) -> DataFrame:
    """function_id with the entry's display name: `C.f`, or `C.f(types)` if the contract has several f. Columns contract, name, types."""
    n = F.count("*").over(Window.partitionBy("contract", "name"))
    plain = F.concat_ws(".", "contract", "name")
    return contract_function.select("function_id", F.when(n > 1, F.concat(plain, F.lit("("), "types", F.lit(")"))).otherwise(plain).alias("entry_name"))


def sol_entries(contract: DataFrame, contract_function: DataFrame) -> DataFrame:
    """Public and external functions of contracts that are our own and neither interface nor library, constructors left out, with their access control."""
    own = contract.where("not external and contract_type not in ('Interface', 'Library')").select("contract_id", F.col("name").alias("contract"))
    f = contract_function.where("visibility in ('Public', 'External') and name <> 'constructor'").join(by_key(own), "contract_id")
    control = access_control(f).groupBy("function_id").agg(F.array_sort(F.collect_set("kind")).alias("access_control"))
    return f.join(by_key(overload_names(f)), "function_id").join(by_key(control), "function_id").select("contract_id", "function_id", "entry_name", "visibility", "access_control")


def sol_resolve_calls(sites: DataFrame, contract_function: DataFrame, base: DataFrame, contract: DataFrame) -> DataFrame:
    """Calls of contract functions: super.x, C.x of a known contract C, x of the same contract, then of its direct bases in order.

    sites: function_id, contract_id, callee. Calls that nothing matches are left out.
    """
    known = contract.select("contract_id", F.col("name").alias("contract"))
    dotted = F.contains("callee", F.lit("."))
    s = sites.withColumns({"target": F.when(dotted, F.substring_index("callee", ".", 1)), "method": F.when(dotted, F.substring_index("callee", ".", -1)).otherwise(F.col("callee"))})
    up = s.where("target = 'super'").select("function_id", F.col("contract_id").alias("callee_contract"), "method", F.lit(False).alias("is_external"), F.lit(True).alias("is_super"))
    other = s.where("target <> 'super'").join(known.select(F.col("contract").alias("target"), F.col("contract_id").alias("callee_contract")), "target").select("function_id", "callee_contract", "method", F.lit(True).alias("is_external"), F.lit(False).alias("is_super"))
    has = contract_function.select(F.col("contract_id").alias("callee_contract"), F.col("name").alias("method")).distinct()
    plain = s.where("target is null").select("function_id", "contract_id", "method")
    tried = plain.withColumn("rank", F.lit(0)).withColumn("callee_contract", F.col("contract_id")).unionByName(plain.join(base.select("contract_id", F.col("ord").alias("rank"), F.col("base_id").alias("callee_contract")), "contract_id"))
    inner = tried.join(has, ["callee_contract", "method"], "left_semi").groupBy("function_id", "method").agg(F.min(F.struct("rank", "callee_contract"))["callee_contract"].alias("callee_contract"))
    return up.unionByName(other).unionByName(inner.select("function_id", "callee_contract", "method", F.lit(False).alias("is_external"), F.lit(False).alias("is_super")))


def nearest_definitions(base: DataFrame, definers: DataFrame, keep: int = 2) -> DataFrame:
    """(contract_id, name, rank, ancestor_id, dep_id): for each contract and name the `keep` definitions that come first in its inheritance chain.

    base: contract_id, ord, base_id; definers: contract_id, name, dep_id. The place of
    a definition is the shortest way up to it, of equally short ones the least by
    the bases' order, then dep_id. Such a way begins with one base and goes on as the base's own,
    so definitions are handed down one level in each round, and only those that are kept:
    the rows are contracts x names visible in them, not contracts x ancestors x names.
    """
    edges = durable(base.select(F.col("contract_id").alias("c"), F.col("base_id").alias("b"), F.col("ord").cast("int").alias("r")).where("c is not null and b is not null and c <> b").groupBy("c", "b").agg(F.min("r").alias("r")))
    key = ["contract_id", "name"]
    # overloads of a contract by dep_id; few names of a contract have more than `keep`
    ranked = definers.select(*key, "dep_id").withColumn("rank", F.dense_rank().over(Window.partitionBy(*key).orderBy("dep_id"))).where(F.col("rank") <= keep).distinct()
    new = compact(ranked.select(*key, F.col("contract_id").alias("ancestor_id"), "dep_id", F.array().cast("array<int>").alias("way"), "rank"))
    parts = [new]
    while not new.isEmpty():
        step = new.join(by_key(edges), F.col("contract_id") == F.col("b")).groupBy(F.col("c").alias("contract_id"), "name", "dep_id").agg(F.min(F.struct(F.concat(F.array("r"), "way").alias("way"), "ancestor_id")).alias("p"))
        had = _together(parts).groupBy(*key).agg(F.collect_list("dep_id").alias("had"))  # at most `keep` of each
        n = F.coalesce(F.size("had"), F.lit(0))
        fresh = step.join(by_key(had), key, "left").withColumn("n", F.when(F.col("had").isNull(), 0).otherwise(n)).where((F.col("n") < keep) & ~F.coalesce(F.array_contains("had", F.col("dep_id")), F.lit(False)))
        place = F.row_number().over(Window.partitionBy(*key).orderBy("p.way", "dep_id")) + F.col("n")
        new = compact(fresh.withColumn("rank", place.cast("int")).where(F.col("rank") <= keep).select(*key, "p.ancestor_id", "dep_id", "p.way", "rank"))
        parts.append(new)
        if len(parts) > Seen.PARTS:
            parts = [compact(_together(parts).repartition(*key))]
    return _together(parts).select(*key, "rank", "ancestor_id", "dep_id")


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sol_direct_deps(sites: DataFrame, contract_function: DataFrame, contract_modifier: DataFrame, base: DataFrame) -> DataFrame:
    """Direct dependencies of each function: its modifiers, then called functions, each from the nearest contract of the chain; a name counts once.

    contract_function: function_id, contract_id, name, modifiers; contract_modifier:
    contract_id, name; base: contract_id, ord, base_id of known contracts.
    """
    functions, modifiers = definitions(contract_function, contract_modifier, base)
    f = contract_function.select("function_id", "contract_id", F.col("contract_id").alias("in_contract"), "modifiers")
    return deps_in_contract(f, sites.select("function_id", "callee"), functions, modifiers).select("function_id", "dep_id", "dep_kind")


def definitions(contract_function: DataFrame, contract_modifier: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What names mean in each contract: (contract_id, name, first, second) of functions, and (contract_id, name, first) of modifiers, as dependency ids."""
    modifier_id = F.concat_ws("|", F.lit("modifier"), F.col("contract_id").cast("string"), F.col("name"))
    both = contract_function.select("contract_id", "name", F.col("function_id").cast("string").alias("dep_id"), F.lit("function").alias("kind")).unionByName(contract_modifier.select("contract_id", "name", modifier_id.alias("dep_id"), F.lit("modifier").alias("kind")))
    # one walk for both kinds: the kind is a part of the name
    found = compact(nearest_definitions(base, both.withColumn("name", F.concat_ws(" ", "kind", "name"))))
    of = lambda kind: found.where(F.col("name").startswith(kind + " ")).withColumn("name", F.substring_index("name", " ", -1))
    pick = lambda k: F.max(F.when(F.col("rank") == k, F.col("dep_id")))
    return of("function").groupBy("contract_id", "name").agg(pick(1).alias("first"), pick(2).alias("second")), of("modifier").where("rank = 1").select("contract_id", "name", F.col("dep_id").alias("first"))


def deps_in_contract(f: DataFrame, sites: DataFrame, functions: DataFrame, modifiers: DataFrame) -> DataFrame:
    """f: function_id, in_contract, modifiers; the dependencies of each function when names are looked up in in_contract: its columns and dep_id, dep_kind, name.

    functions and modifiers are those of definitions(). A function is no dependency of itself: of the two nearest one is another.
    """
    f = f.withColumn("caller", F.col("function_id").cast("string"))
    mods = f.select("function_id", "in_contract", F.explode(F.array_distinct("modifiers")).alias("name"))
    used = mods.join(by_key(modifiers.withColumnRenamed("contract_id", "in_contract")), ["in_contract", "name"]).select("function_id", "in_contract", F.col("first").alias("dep_id"), F.lit("modifier").alias("dep_kind"), "name")
    called = f.join(by_key(sites.where(~F.contains("callee", F.lit("."))).select("function_id", F.col("callee").alias("name")).distinct()), "function_id")
    # a call named like a modifier of its function counts as that, if there is such a modifier: only these rows have to look
    like = F.array_contains("modifiers", F.col("name"))
    kept = ["function_id", "in_contract", "caller", "name"]
    called = called.where(~F.coalesce(like, F.lit(False))).select(*kept).unionByName(called.where(like).join(by_key(used.select("function_id", "in_contract", "name")), ["function_id", "in_contract", "name"], "left_anti").select(*kept))
    dep = F.when(F.col("first") != F.col("caller"), F.col("first")).otherwise(F.col("second"))
    found = called.join(by_key(functions.withColumnRenamed("contract_id", "in_contract")), ["in_contract", "name"]).select("function_id", "in_contract", dep.alias("dep_id"), F.lit("function").alias("dep_kind"), "name").where("dep_id is not null")
    return used.unionByName(found)


def interface_impls(contract: DataFrame, base: DataFrame, contract_function: DataFrame) -> DataFrame:
    """Interfaces with the contracts that name them as a base, and their functions."""
    i = contract.where("contract_type = 'Interface'").select(F.col("contract_id").alias("interface_id"), F.col("name").alias("interface"))
    by = base.select(F.col("base_id").alias("interface_id"), "contract_id").join(contract.select("contract_id", "name"), "contract_id").groupBy("interface_id").agg(F.array_sort(F.collect_set("name")).alias("implemented_by"))
    fs = contract_function.groupBy(F.col("contract_id").alias("interface_id")).agg(F.array_sort(F.collect_set("name")).alias("functions"))
    none = F.array().cast("array<string>")
    return i.join(by, "interface_id", "left").join(fs, "interface_id", "left").select("interface", F.coalesce("implemented_by", none).alias("implemented_by"), F.coalesce("functions", none).alias("functions"))
