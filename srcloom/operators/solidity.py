"""From Solidity files to what each entry reaches: one job over files, imports, contracts, calls.

Names mean what they mean in their file: its own contracts, and those that its
imports bring in. So equal names in different files (or repositories) do not
meet, and a name that nothing or more than one contract answers to is a reject row, not a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom.functions.lexing import problems
from srcloom.operators import calls as C
from srcloom.operators import contracts as K
from srcloom.operators.containment import by_key
from srcloom.operators.graph import Seen
from srcloom.operators.resolve import resolve_import_path
from srcloom.sources.shared import durable

REJECT = ["path", "item", "name", "reason"]


def rejects(source_file: DataFrame, language: str | None = None) -> DataFrame:
    """(path, item, name, reason): files that can't be read to their end (open comment, open string, unbalanced brackets, too deep).

    The language of a file follows from its ending (.sol, else Rust) unless it is given.
    """
    rust, sol = problems(F.col("content"), "rust"), problems(F.col("content"), "solidity")
    why = F.when(F.col("path").endswith(".sol"), sol).otherwise(rust) if language is None else problems(F.col("content"), language)
    return _file_rejects(source_file, why)


def _file_rejects(files: DataFrame, why: Column) -> DataFrame:
    return files.select("path", F.lit("file").alias("item"), F.lit(None).cast("string").alias("name"), F.explode(why).alias("reason"))


def visible_contracts(contract: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, name, contract_id): the contracts that a name can mean in each file.

    contract: path, contract_id, name; imports: path, target, symbol, alias. A plain
    import, and one behind a module alias, brings in all that its target sees; a named one brings in
    the named contract, under its alias if it has one. Files may import each other in cycles. There are
    as many rounds as imports are deep.
    """
    edges = durable(imports.where("target is not null").select(F.col("path").alias("to"), F.col("target").alias("path"), "symbol", F.when(F.col("symbol").isNotNull(), F.col("alias")).alias("alias")).distinct())
    new = durable(contract.select("path", "name", "contract_id").distinct())
    seen = Seen(new, ["path", "name", "contract_id"])
    while not new.isEmpty():
        met = new.join(by_key(edges), "path").where("symbol is null or symbol = name")
        new = seen.add(met.select(F.col("to").alias("path"), F.coalesce("alias", "name").alias("name"), "contract_id").distinct())
    return seen.rows()


def resolve_bases(contract: DataFrame, visible: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contract_id, ord, base_id) of base names that mean one contract, and reject rows of the others.

    contract: path, contract_id, name, bases.
    """
    named = contract.select("path", "contract_id", F.posexplode("bases").alias("at", "base"))
    meant = visible.groupBy("path", F.col("name").alias("base")).agg(F.min("contract_id").alias("base_id"), F.count_distinct("contract_id").alias("n"))
    found = durable(named.join(by_key(meant), ["path", "base"], "left"))
    reason = F.when(F.col("n").isNull(), "unknown base").otherwise("ambiguous base")
    bad = found.where("n is null or n > 1").select("path", F.col("contract_id").alias("item"), F.col("base").alias("name"), reason.alias("reason"))
    return found.where("n = 1").select("contract_id", (F.col("at") + 1).alias("ord"), "base_id"), bad


def contract_corpus(source_file: DataFrame, remaps: DataFrame) -> dict[str, DataFrame]:
    """The tables of a corpus of Solidity files: contract, base, function, modifier, storage, event, import, site, reject; all ids by path and name.

    function: function_id, contract_id, contract, name, n_params, types, params, visibility, mutability,
    modifiers, path, start_line, end_line; site: function_id, contract_id, callee. A file that can't be read to its end
    gives reject rows and nothing else.
    """
    t, tables = _named(source_file, remaps)
    types = F.array_join(F.transform("params", lambda p: p["type_name"]), ",")
    function = durable(_with_id(tables["contract_function"]).withColumns({"types": types, "n_params": F.size("params")}))
    site = durable(C.sol_calls(function.where("body is not null").withColumn("both", F.struct("function_id", "contract_id")), "both").select("both.*", "callee"))
    return {
        **t,
        "function": function.drop("body"),
        "modifier": _with_id(tables["contract_modifier"]).drop("body"),
        "storage": _with_id(tables["storage_var"]),
        "event": _with_id(tables["event_def"]),
        "site": site,
    }


def contract_rejects(source_file: DataFrame, remaps: DataFrame) -> DataFrame:
    """The table reject of contract_corpus() alone: no function is read for it."""
    return _named(source_file, remaps)[0]["reject"]


def _with_id(df: DataFrame) -> DataFrame:
    return df.withColumn("contract_id", F.concat_ws("|", "path", "contract"))


def _named(source_file: DataFrame, remaps: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The tables of contract_corpus() that come from what files import and what their contracts are called; and those of contract_extract()."""
    # each file is judged once, by tasks that have equal shares of the text; all that follows reads these rows
    every = durable(source_file.select("path", "content").repartition("path").withColumn("why", problems(F.col("content"), "solidity")))
    source_file = every.where(F.size("why") == 0).select("path", "content")
    tables = K.contract_extract(source_file)
    contract = durable(_with_id(tables["contract"]).withColumn("name", F.col("contract")).drop("contract"))
    imports = durable(C.sol_imports(source_file))  # texts are read once for them and for their targets
    target = resolve_import_path(imports, source_file.select("path"), remaps)
    imports = durable(imports.join(by_key(target), ["path", "import_path"], "left"))
    visible = durable(visible_contracts(contract, imports))
    base, bad = resolve_bases(contract, visible)
    lost = imports.where("target is null").select("path", F.lit("import").alias("item"), F.col("import_path").alias("name"), F.lit("import without a file").alias("reason")).distinct()
    reject = bad.unionByName(lost).unionByName(_file_rejects(every, F.col("why")))
    return {"contract": contract, "base": durable(base), "import": imports, "reject": reject}, tables


def entry_tree(entries: DataFrame, function: DataFrame, site: DataFrame, functions: DataFrame, modifiers: DataFrame) -> DataFrame:
    """(root, node, depth, parent, name, dep_kind): what each entry uses, breadth first, with names looked up in the entry's own contract at every level.

    So a function that the entry's contract overrides is met in its overriding form, also where a base calls it. A
    node, and a name, is shown once in a tree, at its least depth, below the least of
    its callers; modifiers are leaves. entries: function_id, contract_id; function:
    function_id, name, modifiers; functions and modifiers: contracts.definitions().
    """
    known = durable(function.select("function_id", F.col("name").alias("fn_name"), "modifiers"))
    start = entries.select(F.col("function_id").alias("root"), F.col("contract_id").alias("in_contract"), F.col("function_id").alias("node")).distinct().join(by_key(known.select(F.col("function_id").alias("node"), F.col("fn_name").alias("name"))), "node")
    none = F.lit(None).cast("string")
    columns = ["root", "in_contract", "node", "depth", "parent", "name", "dep_kind"]
    new = durable(start.select("root", "in_contract", "node", F.lit(0).alias("depth"), none.alias("parent"), "name", F.lit("function").alias("dep_kind")))
    seen, depth = Seen(new, ["root", "dep_kind", "name"]), 0
    while not new.isEmpty():
        depth += 1
        callers = new.where("dep_kind = 'function'").select("root", "in_contract", F.col("node").alias("function_id"))
        # what a function uses in a contract is looked up once, however many roots of that contract reach it
        pairs = callers.select("in_contract", "function_id").distinct().join(by_key(known.select("function_id", "modifiers")), "function_id")
        used = K.deps_in_contract(pairs, site, functions, modifiers)
        step = callers.join(by_key(used), ["in_contract", "function_id"])
        met = step.groupBy("root", "in_contract", "dep_kind", "name").agg(F.min(F.struct(F.col("dep_id").alias("node"), F.col("function_id").alias("parent"))).alias("p"))
        new = seen.add(met.select("root", "in_contract", "p.node", F.lit(depth).alias("depth"), "p.parent", "name", "dep_kind").select(columns))
    return seen.rows().drop("in_contract")


def contract_entries(source_file: DataFrame, remaps: DataFrame, direct: bool = True, tree: bool = True) -> dict[str, DataFrame]:
    """From files to entries, with the tables they come from; direct and tree: whether with their direct dependencies, with their trees."""
    t = contract_corpus(source_file, remaps)
    entries = durable(K.sol_entries(t["contract"], t["function"].drop("contract")))
    functions, modifiers = K.definitions(t["function"], t["modifier"], t["base"])
    functions, modifiers = durable(functions), durable(modifiers)
    found, site = {"entry": entries}, t["site"].select("function_id", "callee")
    if direct:
        f = t["function"].select("function_id", "contract_id", F.col("contract_id").alias("in_contract"), "modifiers")
        found["direct"] = durable(K.deps_in_contract(f, site, functions, modifiers))
    if tree:
        found["tree"] = durable(entry_tree(entries, t["function"], site, functions, modifiers))
    return {**t, **found}


def entry_report(t: dict[str, DataFrame]) -> DataFrame:
    """(entry_name, path, section, ord, line) of each entry: access control, modifiers, contract and location, parameters, state variables, calls, events.

    ord counts within a section. The state variables and events are those of the entry's
    contract and of its bases, as the contract sees them.
    """
    f = t["function"].select("function_id", "path", "contract", "modifiers", "params", "start_line")
    e = durable(t["entry"].select("entry_name", "function_id", "contract_id", "access_control").join(by_key(f), "function_id"))
    row = lambda df, section, order, line: df.select("function_id", "entry_name", "path", F.lit(section).alias("section"), order.alias("o"), line.alias("line"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    zero = F.lit("")
    access = row(e, "access control", zero, text("- ", F.array_join("access_control", ", ")))
    mods = row(e, "modifiers", zero, text("- Modifiers: ", F.when(F.size("modifiers") > 0, F.array_join("modifiers", ", ")).otherwise("None")))
    where = row(e, "contract", zero, text("- ", F.col("contract"), " (", F.col("path"), ":", F.col("start_line").cast("string"), ")"))
    p = e.select("function_id", "entry_name", "path", F.posexplode("params").alias("k", "p"))
    params = row(p, "parameters", F.lpad(F.col("k").cast("string"), 6, "0"), text("- ", F.col("p.name"), ": ", F.col("p.type_name"), F.when(F.col("p.storage_location") != "", F.concat(F.lit(" "), "p.storage_location")).otherwise("")))
    # a contract sees its own variables and those of its bases; equal names of the nearest
    owned = lambda table: K.nearest_definitions(t["base"], t[table].select("contract_id", "name", F.concat_ws("|", "contract_id", "name").alias("dep_id")), keep=1)
    own = e.select("function_id", "entry_name", "path", "contract_id")
    state = row(own.join(by_key(owned("storage")), "contract_id"), "state", F.col("name"), text("- ", F.col("name")))
    events = row(own.join(by_key(owned("event")), "contract_id"), "events", F.col("name"), text("- ", F.col("name")))
    at = t["function"].select(F.col("function_id").alias("dep_id"), F.concat_ws(":", "path", F.col("start_line").cast("string")).alias("at"))
    used = e.select("function_id", "entry_name", "path").join(by_key(t["direct"].where("dep_kind = 'function'")), "function_id").join(by_key(at), "dep_id")
    calls = row(used, "calls", F.col("name"), text("- ", F.col("name"), " (", F.col("at"), ")"))
    rows = access.unionByName(mods).unionByName(where).unionByName(params).unionByName(state).unionByName(events).unionByName(calls)
    w = Window.partitionBy("function_id", "section").orderBy("o", "line")
    return rows.select("entry_name", "path", "section", F.row_number().over(w).alias("ord"), "line")
