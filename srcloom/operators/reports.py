"""Report rows: entry_name, section, ord, line. Markdown is made at the sink only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom.functions.text import stripped

from .analytics import token_flow_pairs
from .containment import by_key

ROW = ["entry_name", "section", "ord", "line"]


def _rows(df: DataFrame, section: str, order: list, line: Column) -> DataFrame:
    w = Window.partitionBy("entry_name").orderBy(*order)
    return df.select("entry_name", F.lit(section).alias("section"), F.row_number().over(w).cast("int").alias("ord"), line.alias("line"))


def report_state_changes(entry: DataFrame, account: DataFrame, fields: DataFrame) -> DataFrame:
    """Initialised, closed and updated program accounts (updates with the fields of the account struct), then token flows."""
    e = entry.select("struct_id", F.col("name").alias("entry_name"))
    a = account.where("account_type = 'ProgramStateAccount'").withColumn("op", F.when(F.col("is_init"), 0).when(F.col("is_close"), 1).when(F.col("is_mut"), 2)).where("op is not null")
    listed = fields.groupBy("struct_name").agg(F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("fields"))
    verb = F.element_at(F.array(F.lit("Initializes"), F.lit("Closes"), F.lit("Updates")), F.col("op") + 1)
    tail = F.when((F.col("op") == 2) & F.col("fields").isNotNull(), F.concat(F.lit(" ("), "fields", F.lit(")"))).otherwise("")
    accounts = a.join(listed, "struct_name", "left").select("struct_id", "op", F.col("ord").alias("k"), F.concat(F.lit("- "), verb, F.lit(" `"), "account_name", F.lit("`["), "struct_name", F.lit("]"), tail).alias("line"))
    flows = token_flow_pairs(account)
    kind = {"transfer": 3, "delegate": 4, "mint": 5, "burn": 6}
    rank = F.create_map(*[F.lit(x) for kv in kind.items() for x in kv])[F.col("op")]
    flow = flows.select("struct_id", rank.alias("op"), F.lit(0).alias("k"), F.concat(F.lit("- "), F.initcap("op"), F.lit(" `"), "from_account", F.lit("` to `"), F.coalesce("to_account", F.lit("?")), F.lit("`")).alias("line"))
    return _rows(accounts.unionByName(flow).join(e, "struct_id"), "state_changes", ["op", "k", "line"], F.col("line"))


def report_constraint_checklist(entry: DataFrame, account: DataFrame, source_line: DataFrame, commit_url: str = "") -> DataFrame:
    """Each validation as an unchecked item with the first line of its file that holds its text before @ (1 if none does).

    entry: name, struct_id, path; source_line has all lines of a file, numbered without gaps.
    """
    v = entry.select("struct_id", F.col("name").alias("entry_name"), "path").join(account.select("struct_id", F.col("ord").alias("a"), F.posexplode("validations").alias("k", "v")), "struct_id")
    v = v.withColumn("needle", F.trim(F.substring_index("v", "@", 1))).repartition("path")
    # rows of one text in one file are one row, which meets the file: all of this is dealt by the path alone, and validations are read once
    wanted = v.groupBy("path", "needle").agg(F.collect_list(F.struct("entry_name", "a", "k", "v")).alias("rows"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    files = source_line.join(entry.select("path").distinct(), "path", "left_semi").groupBy("path").agg(content.alias("content"), F.min("line_no").alias("first"))
    # each text is found in the file as a whole, not line by line
    met = by_key(wanted).join(by_key(files), "path", "left").withColumn("at", F.when(~F.contains("needle", F.lit("\n")), F.instr("content", F.col("needle"))))
    before = F.substring("content", F.lit(1), F.col("at"))
    breaks = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    spot = F.when(F.col("at") > 0, (F.col("first") + breaks).cast("int"))
    out = met.select("path", spot.alias("line_no"), F.explode("rows").alias("r")).select("path", "line_no", "r.*")
    link = F.concat(F.lit(commit_url), "path", F.lit("#L"), F.coalesce("line_no", F.lit(1)).cast("string"))
    return _rows(out, "constraints", ["a", "k"], F.concat(F.lit("- [ ] "), "v", F.lit(" "), link))


def report_signers(entry: DataFrame, account: DataFrame) -> DataFrame:
    """The signer accounts of each entry, or that it needs no permission."""
    s = account.where("account_type = 'Signer'").select("struct_id", F.col("ord").alias("k"), "account_name")
    out = entry.select("struct_id", F.col("name").alias("entry_name")).join(s, "struct_id", "left")
    return _rows(out, "signers", ["k"], F.coalesce(F.concat(F.lit("- "), "account_name", F.lit(": ")), F.lit("- No signers found: permissionless")))


def report_parameters(entry: DataFrame, closure: DataFrame, params: DataFrame, structs: DataFrame) -> DataFrame:
    """Parameters of the entry's function and of all it reaches, except contexts, with the struct they are of.

    entry: name, function_id; params: symbol_id, ord, param_name, param_type; structs: symbol_id, param_name, struct_id.
    """
    e = entry.select(F.col("name").alias("entry_name"), F.col("function_id").alias("root"))
    reached = e.select("entry_name", F.col("root").alias("symbol_id"), F.lit(0).alias("depth")).unionByName(e.join(closure, "root").where("node <> root").select("entry_name", F.col("node").alias("symbol_id"), "depth"))
    p = reached.join(params.where(~F.col("param_type").startswith("Context<")).select("symbol_id", F.col("ord").alias("k"), "param_name", "param_type"), "symbol_id").join(structs, ["symbol_id", "param_name"], "left")
    line = F.concat(F.lit("- "), "param_name", F.lit(": "), "param_type", F.coalesce(F.concat(F.lit(" = "), F.col("struct_id").cast("string")), F.lit("")))
    return _rows(p, "parameters", ["depth", "symbol_id", "k"], line)


def report_accounts(entry: DataFrame, account: DataFrame, kept_items: DataFrame, struct_text: DataFrame | None = None) -> DataFrame:
    """Account declarations without their validation items; of structs of reference-style accounts the whole text instead.

    kept_items: struct_id, ord, items; struct_text: struct_id, content, if the texts of the
    structs are at hand. A struct is of the reference style if its text has AccountView,
    or AccountInfo and no Account<.
    """
    named = entry.select("struct_id", F.col("name").alias("entry_name"))
    d = account.select("struct_id", "ord", "account_name", "struct_name").join(kept_items, ["struct_id", "ord"]).withColumnRenamed("ord", "k")
    head = F.when(F.size("items") > 0, F.concat(F.lit("#[account("), F.array_join("items", ", "), F.lit(")] "))).otherwise("")
    declared = d.select("struct_id", "k", F.concat(head, F.lit("pub "), "account_name", F.lit(": "), "struct_name").alias("text"))
    if struct_text is not None:
        has = lambda word: F.contains("content", F.lit(word))
        plain = struct_text.where(has("AccountView") | (has("AccountInfo") & ~has("Account<")))
        whole = plain.select("struct_id", F.posexplode(F.split("content", "\n")).alias("k", "text"))
        declared = declared.join(plain.select("struct_id"), "struct_id", "left_anti").unionByName(whole)
    return _rows(declared.join(named, "struct_id"), "accounts", ["k"], F.col("text"))


def report_validations(entry: DataFrame, account: DataFrame, closure: DataFrame, in_functions: DataFrame, symbol: DataFrame) -> DataFrame:
    """Validations of the entry's accounts, then those of the functions it reaches, under a header with their place.

    in_functions: symbol_id, start_line, line; entry: name, struct_id, function_id.
    """
    e = entry.select("struct_id", F.col("name").alias("entry_name"), F.col("function_id").alias("root"))
    own = e.join(account.select("struct_id", F.col("ord").alias("o"), F.posexplode("validations").alias("q", "v")), "struct_id").select("entry_name", F.lit(0).alias("part"), F.col("o").cast("long").alias("k"), F.col("q").cast("long").alias("q"), F.concat(F.lit("- "), "v").alias("line"))
    reached = e.select("entry_name", F.col("root").alias("node")).unionByName(e.join(closure.select("root", "node"), "root").where("node <> root").select("entry_name", "node")).join(symbol.select(F.col("symbol_id").alias("node"), "name", "path", "start_line"), "node")
    inner = reached.join(in_functions.select(F.col("symbol_id").alias("node"), F.col("start_line").alias("at"), "line"), "node")
    heads = reached.join(in_functions.select(F.col("symbol_id").alias("node")).distinct(), "node", "left_semi").select("entry_name", F.lit(1).alias("part"), F.col("node").cast("long").alias("k"), F.lit(0).cast("long").alias("q"), F.concat("name", F.lit(" — "), "path", F.lit(":"), F.col("start_line").cast("string")).alias("line"))
    body = inner.select("entry_name", F.lit(1).alias("part"), F.col("node").cast("long").alias("k"), F.col("at").cast("long").alias("q"), F.concat(F.lit("- "), stripped(F.col("line"))).alias("line"))
    return _rows(own.unionByName(heads).unionByName(body), "validations", ["part", "k", "q", "line"], F.col("line"))


def report_contract_entry(entries: DataFrame, deps: DataFrame, storage: DataFrame, events: DataFrame) -> DataFrame:
    """Access control, calls, state variables and events of each contract entry.

    entries: function_id, contract_id, entry_name, access_control; deps: function_id, dep_id; storage and events: contract_id, name.
    """
    base = entries.select("entry_name", "function_id", "contract_id")
    access = entries.select("entry_name", F.lit(0).alias("part"), F.concat(F.lit("access: "), F.array_join("access_control", ", ")).alias("line"))
    calls = base.join(deps.select("function_id", "dep_id").distinct(), "function_id").select("entry_name", F.lit(1).alias("part"), F.concat(F.lit("uses: "), "dep_id").alias("line"))
    state = base.join(storage, "contract_id").select("entry_name", F.lit(2).alias("part"), F.concat(F.lit("state: "), "name").alias("line"))
    event = base.join(events, "contract_id").select("entry_name", F.lit(3).alias("part"), F.concat(F.lit("event: "), "name").alias("line"))
    return _rows(access.unionByName(calls).unionByName(state).unionByName(event), "contract_entry", ["part", "line"], F.col("line"))


def report_summary(sections: DataFrame) -> DataFrame:
    """Finished documents whose notes still have lines that are not checked, without the checked ones. sections: entry_name, section, content."""
    notes = sections.where("section = 'Notes'").select("entry_name", F.filter(F.split("content", "\n"), lambda s: ~F.contains(s, F.lit("- [x]")) & (F.trim(s) != "")).alias("open")).where("size(open) > 0")
    return notes.select("entry_name", F.lit("summary").alias("section"), F.posexplode("open").alias("k", "line")).select("entry_name", "section", (F.col("k") + 1).alias("ord"), "line")


def entry_dependency_list(entry: DataFrame, closure: DataFrame, symbol: DataFrame) -> DataFrame:
    """`path:line` of all that each entry reaches, sorted; "No dependencies" if there is nothing."""
    named = closure.join(by_key(symbol.select(F.col("symbol_id").alias("node"), F.concat_ws(":", "path", F.col("start_line").cast("string")).alias("at"))), "node")
    listed = named.groupBy(F.col("root").alias("entry_id")).agg(F.array_join(F.array_sort(F.collect_list("at")), "\n").alias("dependencies"))
    return entry.join(by_key(listed), "entry_id", "left").select("entry_id", F.col("name").alias("entry_name"), F.coalesce("dependencies", F.lit("No dependencies")).alias("dependencies"))
