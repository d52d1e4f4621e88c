"""Roll-ups over accounts, entries and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listed(order: list, value: str) -> Column:
    """Values in the order of other columns, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"o{k}") for k, o in enumerate(order)], F.col(value).alias("v")))), lambda s: s["v"])


def constraint_index(entry: DataFrame, account: DataFrame) -> DataFrame:
    """(constraint, entry, n): constraints in normal form, the entries that have them and how often.

    Long rows, as a constraint may be in any number of entries. account:
    struct_id, ord, validations. The normal form lacks the error after @ and the
    accessors load, as_ref and key.
    """
    v = account.select("struct_id", F.explode("validations").alias("v")).where(F.col("v").rlike(r"constraint\s*=\s*"))
    clean = F.trim(F.regexp_replace("v", r"(@[\w:()]*)|(\.?(load|as_ref|key)\(?\)?\??)", ""))
    return entry.select("struct_id", F.col("name").alias("entry")).join(v, "struct_id").groupBy(clean.alias("constraint"), "entry").agg(F.count("*").alias("n"))


def constraint_status(index: DataFrame, flags: DataFrame) -> DataFrame:
    """How many constraints there are, are invariant, are not, and wait for review. flags: constraint, invariant, reviewed."""
    both = index.select("constraint").distinct().join(flags, "constraint", "left")
    seen = F.coalesce(F.col("reviewed"), F.lit(False))
    return both.agg(F.count("*").alias("n_total"), F.count_if(seen & F.col("invariant")).alias("n_invariant"), F.count_if(seen & ~F.col("invariant")).alias("n_non_invariant"), F.count_if(~seen).alias("n_to_review"))


def account_lifecycle(account: DataFrame) -> DataFrame:
    """For each struct its accounts as init, else close, else mut, apart for program state and others, and its program-state accounts."""
    state = F.col("account_type") == "ProgramStateAccount"
    bucket = F.when(F.col("is_init"), "init").when(F.col("is_close"), "close").when(F.col("is_mut"), "mut")
    rows = account.select("struct_id", "ord", "account_name", "struct_name", state.alias("state"), bucket.alias("bucket"))

    def pick(cond: Column, value: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", F.col(value).alias("v"))))), lambda s: s["v"])

    cols = {f"{b}_{w}": pick((F.col("bucket") == b) & (F.col("state") == s), "account_name") for b in ("init", "close", "mut") for w, s in (("program", True), ("other", False))}
    return rows.groupBy("struct_id").agg(*[c.alias(n) for n, c in cols.items()], pick(F.col("state"), "struct_name").alias("program_accounts"))


def entry_flow(entry: DataFrame, account: DataFrame) -> DataFrame:
    """Structs with program accounts in the order of a reading plan: initialisers first, then by number of program accounts.

    The rank is that of the group (initialiser or not, and size) plus places
    before it, which are summed over spans of ids and over blocks of spans; only
    structs of one span are numbered, so that no task sees all structs.
    """
    life = account_lifecycle(account).where("size(program_accounts) > 0").select("struct_id", "program_accounts", F.col("init_program").alias("init_accounts"), F.col("mut_program").alias("mut_accounts"), F.col("close_program").alias("close_accounts"))
    keyed = life.withColumns({"later": (F.size("init_accounts") == 0).cast("int"), "size": F.size("program_accounts")})
    group, span, block = ["later", "size"], F.floor(F.col("struct_id") / 1024), F.floor(F.col("span") / 1024)
    upto = lambda keys, order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    spans = keyed.groupBy(*group, span.alias("span")).agg(F.count("*").alias("n")).withColumn("block", block)
    blocks = spans.groupBy(*group, "block").agg(F.sum("n").alias("n"))
    groups = blocks.groupBy(*group).agg(F.sum("n").alias("n"))
    # places before a group, a block of its spans, a span: one row for each size, for each million and for each thousand of ids
    in_all = groups.withColumn("g", ahead(Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    in_group = blocks.withColumn("b", ahead(upto(group, ["block"]))).drop("n")
    in_block = spans.withColumn("s", ahead(upto([*group, "block"], ["span"]))).drop("n")
    before = in_block.join(in_group, [*group, "block"]).join(in_all, group).select(*group, "span", (F.col("g") + F.col("b") + F.col("s")).alias("before"))
    ranked = keyed.withColumn("span", span).withColumn("k", F.row_number().over(Window.partitionBy(*group, "span").orderBy("struct_id"))).join(before, [*group, "span"])
    out = ranked.withColumn("priority", F.col("before") + F.col("k") - 1)
    return out.join(entry.select("struct_id", F.col("name").alias("entry_name")), "struct_id").select("priority", "struct_id", "entry_name", "program_accounts", "init_accounts", "mut_accounts", "close_accounts")


def account_entries(entry: DataFrame, account: DataFrame) -> DataFrame:
    """(struct_name, op, entry): the entries that initialise, change (and do not close) or close each account struct, once each."""
    state = account.where("account_type = 'ProgramStateAccount'")
    ops = F.array_compact(F.array(F.when(F.col("is_init"), "init"), F.when(F.col("is_mut") & ~F.col("is_close"), "mut"), F.when(F.col("is_close"), "close")))
    each = state.select("struct_id", "struct_name", F.explode(ops).alias("op")).join(entry.select("struct_id", F.col("name").alias("entry")), "struct_id")
    return each.select("struct_name", "op", "entry").distinct()


def account_field_matrix(entries: DataFrame, fields: DataFrame) -> DataFrame:
    """Account by entry by field, for initialising and changing entries. fields: struct_name, field."""
    return entries.where("op in ('init', 'mut')").join(fields, "struct_name").select("struct_name", "entry", "op", "field")


def state_changes(matrix: DataFrame, values: DataFrame) -> DataFrame:
    """The matrix with values: every initialisation (an unknown value is empty), changes only with a value; a change of a field that nothing initialises is an orphan.

    values: struct_name, entry, op, field, value.
    """
    rows = matrix.join(values, ["struct_name", "entry", "op", "field"], "left").where("op = 'init' or value is not null").withColumn("value", F.coalesce("value", F.lit("")))
    begun = rows.where("op = 'init'").select("struct_name", "field", F.lit(True).alias("begun")).distinct()
    return rows.join(begun, ["struct_name", "field"], "left").select("struct_name", "field", "entry", "op", "value", ((F.col("op") == "mut") & F.col("begun").isNull()).alias("orphan"))


def state_change_map(changes: DataFrame) -> DataFrame:
    """One row for each account struct with field -> [(entry, value)], for export."""
    by_field = changes.groupBy("struct_name", "field").agg(F.array_sort(F.collect_list(F.struct("entry", "value"))).alias("c"))
    return by_field.groupBy("struct_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "c")))).alias("fields"))


def token_flow_pairs(account: DataFrame) -> DataFrame:
    """Transfers and delegations between all ordered pairs of changeable token accounts of a struct and to an open destination (null); mints and burns from each changeable mint.

    A struct's accounts are few (an entry's declared input), so pairs within it are the result itself.
    """
    t = account.where("is_mut and account_type = 'TokenAccount'").select("struct_id", F.col("ord").alias("o"), F.col("account_name").alias("a"))
    m = account.where("is_mut and account_type = 'Mint'").select("struct_id", F.col("account_name").alias("mint"))
    other = t.select("struct_id", F.col("o").alias("p"), F.col("a").alias("b"))
    pairs = t.join(other, "struct_id").where("o <> p").select("struct_id", F.col("a").alias("from_account"), F.col("b").alias("to_account"))
    moves = pairs.unionByName(t.select("struct_id", F.col("a").alias("from_account"), F.lit(None).cast("string").alias("to_account"))).withColumn("op", F.explode(F.array(F.lit("transfer"), F.lit("delegate"))))
    made = m.join(t, "struct_id").select("struct_id", F.col("mint").alias("from_account"), F.col("a").alias("to_account")).unionByName(m.select("struct_id", F.col("mint").alias("from_account"), F.lit(None).cast("string").alias("to_account"))).withColumn("op", F.explode(F.array(F.lit("mint"), F.lit("burn"))))
    return moves.unionByName(made).select("struct_id", "op", "from_account", "to_account")


def status_counts(review_doc: DataFrame, deprecated: str = "deprecated") -> DataFrame:
    """Documents by status, and their total without deprecated ones."""
    total = F.grouping("status") == 1
    n = F.when(total, F.count_if(F.coalesce(F.col("status") != deprecated, F.lit(False)))).otherwise(F.count(F.lit(1)))
    both = review_doc.groupingSets([[F.col("status")], []], "status").agg(F.when(total, "total").otherwise(F.col("status")).alias("name"), n.alias("n"))
    return both.select(F.col("name").alias("status"), "n")


def corpus_counts(symbol: DataFrame, contract: DataFrame, call_edge: DataFrame, contract_function: DataFrame | None = None, contract_modifier: DataFrame | None = None, parse_error: DataFrame | None = None) -> DataFrame:
    """(metric, n): symbols by kind, contracts by place, calls, and functions, modifiers and parse errors where those tables are given."""
    kinds = symbol.groupBy(F.concat(F.lit("symbol:"), "kind").alias("metric")).agg(F.count("*").alias("n"))
    places = contract.groupBy(F.concat(F.lit("contract:"), F.when(F.col("external"), "lib").otherwise("src")).alias("metric")).agg(F.count("*").alias("n"))
    out = kinds.unionByName(places)
    for name, rows in (("calls", call_edge), ("functions", contract_function), ("modifiers", contract_modifier), ("parse_errors", parse_error)):
        if rows is not None:
            out = out.unionByName(rows.agg(F.lit(name).alias("metric"), F.count("*").alias("n")))
    return out


def distinct_programs(symbol: DataFrame) -> DataFrame:
    return symbol.select("program").distinct().orderBy("program")


def group_by_file(symbol: DataFrame) -> DataFrame:
    """(path, ord, start_line, symbol_id, name): the symbols of each file, numbered in order."""
    order = Window.partitionBy("path").orderBy("start_line", "symbol_id")
    return symbol.select("path", F.row_number().over(order).alias("ord"), "start_line", "symbol_id", "name")


def first_occurrence(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return best.select(*keys, "r.*").select(*df.columns)


def sorted_unique(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The distinct values of each key, sorted."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(value))
