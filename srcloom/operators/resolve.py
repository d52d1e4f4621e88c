"""Resolution joins: members of implementations, callees of calls, names, imports, structs of entries.

Every rule of a multi-rule resolution is a join; the first rule that decides
wins by coalesce. Rows that no rule decides stay, with what became of them in
`resolution`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom.functions.text import path_fragment, plain_path
from srcloom.operators.containment import by_key, within
from srcloom.sources.shared import durable

EDGE = ["caller_id", "callee_name", "callee_id", "resolution", "rule"]


def impl_from_to(impl: DataFrame, name: str = "name") -> DataFrame:
    """impl_from and impl_to of `A for B`; an inherent implementation has no impl_from."""
    both = F.contains(name, F.lit(" for "))
    return impl.withColumns({"impl_from": F.when(both, F.trim(F.split_part(name, F.lit(" for "), F.lit(1)))).otherwise(""), "impl_to": F.when(both, F.trim(F.split_part(name, F.lit(" for "), F.lit(2)))).otherwise(F.trim(name))})


def impl_members(impl_block: DataFrame, symbol: DataFrame) -> DataFrame:
    """Functions strictly inside an implementation of the same file, with their signature `impl_to::name`."""
    i = impl_block.select("impl_id", "impl_to", F.col("path").alias("i_path"), F.col("start_line").alias("i_from"), F.col("end_line").alias("i_to"))
    inside = within(symbol, i, [("path", "i_path")], "start_line", F.col("i_from") + 1, F.col("i_to"), also=F.col("end_line") < F.col("i_to"))
    return inside.select("impl_id", "symbol_id", F.concat("impl_to", F.lit("::"), "name").alias("signature"))


def first_members(impl_block: DataFrame, symbol: DataFrame) -> DataFrame:
    """The rows of impl_members that can decide a call: of implementations of one type with equal lines of a file, those of the first.

    All of these hold the same functions under the same signatures, so the first member of a
    signature and the first type of a function are the same, but rows grow with the functions
    and not with their product with the implementations.
    """
    first = impl_block.groupBy("path", "impl_to", "start_line", "end_line").agg(F.min("impl_id").alias("impl_id"))
    return impl_members(first, symbol)


def external_trait(impl_block: DataFrame) -> DataFrame:
    """Whether an implementation's trait is defined nowhere in the corpus; false for definitions and inherent implementations."""
    defined = impl_block.where("trait_kind = 'Definition'").select(F.when(F.col("impl_from") == "", F.col("impl_to")).otherwise(F.col("impl_from")).alias("d")).distinct()
    out = impl_block.join(defined, F.col("impl_from") == F.col("d"), "left")
    return out.select("impl_id", ((F.col("trait_kind") != "Definition") & (F.col("impl_from") != "") & F.col("d").isNull()).alias("external_trait"))


def _unique(symbol: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: how many symbols have it, and the only one's id."""
    return symbol.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") == 1, F.min("symbol_id")).alias("only_id"))


def _edge(df: DataFrame, callee: Column, rule: Column, external: Column) -> DataFrame:
    resolution = F.when(callee.isNotNull(), "internal").when(external, "external").otherwise("unresolved")
    return df.select("caller_id", "callee_name", callee.alias("callee_id"), resolution.alias("resolution"), rule.alias("rule"))


def resolve_free_call(call_site: DataFrame, symbol: DataFrame, imports: DataFrame, callers: DataFrame) -> DataFrame:
    """Free calls: an only function of the name is the callee whatever is imported; of several the first import candidate decides.

    imports has path, name, full_path, rank (resolve_name); callers has caller_id, path.
    """
    calls = call_site.where("call_kind = 'free'").select("caller_id", "callee_name").join(by_key(_unique(symbol, "name").withColumnRenamed("name", "callee_name")), "callee_name", "left")
    some = calls.where("n > 1").select("caller_id", "callee_name").distinct().join(by_key(callers.select("caller_id", F.col("path").alias("c_path"))), "caller_id")
    tried = some.join(by_key(imports.select(F.col("path").alias("c_path"), F.col("name").alias("callee_name"), "full_path", "rank")), ["c_path", "callee_name"])
    # a path in the crate is a piece of the callee's path, one in the own file is that file
    tried = tried.withColumns({"own": F.col("full_path").startswith("self::"), "fragment": path_fragment(F.col("full_path"), F.col("callee_name"))})
    named = symbol.select(F.col("name").alias("callee_name"), "symbol_id", F.col("path").alias("s_path"))
    # of the functions of a name in a file the first is meant
    local = named.groupBy("callee_name", F.col("s_path").alias("c_path")).agg(F.min("symbol_id").alias("symbol_id"))
    here = tried.where("own").join(by_key(local), ["c_path", "callee_name"]).select("caller_id", "callee_name", "rank", "symbol_id")
    placed = _by_fragment(tried.where("not own and fragment is not null").select("callee_name", "fragment").distinct(), named)
    there = tried.where("not own").join(by_key(placed), ["callee_name", "fragment"]).select("caller_id", "callee_name", "rank", "symbol_id")
    picked = here.unionByName(there).groupBy("caller_id", "callee_name").agg(F.min(F.struct("rank", "symbol_id"))["symbol_id"].alias("by_import"))
    out = calls.join(by_key(picked), ["caller_id", "callee_name"], "left")
    rule = F.when(F.col("n").isNull(), "no such name").when(F.col("n") == 1, "only one").when(F.col("by_import").isNotNull(), "import").otherwise("ambiguous")
    return _edge(out, F.coalesce("only_id", "by_import"), rule, F.col("n").isNull())


#: Pairs of (fragment, path) of one name above which paths are found by their pieces; length of such a piece.
HOT_PAIRS, PIECE = 100_000, 6


def _by_fragment(wanted: DataFrame, named: DataFrame) -> DataFrame:
    """(callee_name, fragment, symbol_id): the first symbol of each name in a path that contains the fragment.

    Paths of a name count once each, with their first symbol. A name that many
    functions have and many files import does not meet all its paths: those are
    listed under their pieces of PIECE characters, and a fragment looks under its
    first piece. Shorter fragments are few, as they are distinct.
    """
    paths = durable(named.groupBy("callee_name", "s_path").agg(F.min("symbol_id").alias("symbol_id")).join(by_key(wanted.select("callee_name").distinct()), "callee_name", "left_semi"))
    pairs = wanted.groupBy("callee_name").agg(F.count("*").alias("f")).join(by_key(paths.groupBy("callee_name").agg(F.count("*").alias("p"))), "callee_name")
    hot = durable(pairs.where(F.col("f") * F.col("p") > HOT_PAIRS).select("callee_name"))
    long = F.length("fragment") >= PIECE
    plain = wanted.join(hot, "callee_name", "left_anti") if not (some := not hot.isEmpty()) else wanted.join(hot.withColumn("hot", F.lit(True)), "callee_name", "left").where(F.col("hot").isNull() | ~long).drop("hot")
    met = plain.join(by_key(paths), "callee_name").where(F.contains("s_path", F.col("fragment")))
    if some:
        pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("s_path") - (PIECE - 1), F.lit(1))), lambda i: F.substring("s_path", i, F.lit(PIECE))))
        listed = paths.join(hot, "callee_name", "left_semi").withColumn("piece", F.explode(pieces))
        looked = wanted.join(hot, "callee_name", "left_semi").where(long).withColumn("piece", F.substring("fragment", 1, PIECE))
        met = met.unionByName(looked.join(by_key(listed), ["callee_name", "piece"]).where(F.contains("s_path", F.col("fragment"))).select(*met.columns))
    return met.groupBy("callee_name", "fragment").agg(F.min("symbol_id").alias("symbol_id"))


def _member(impl_member: DataFrame) -> DataFrame:
    """The first member of each signature. A least struct is found by sorting, so implementations are reduced to a row each before."""
    each = impl_member.groupBy("signature", "impl_id").agg(F.min("symbol_id").alias("symbol_id"))
    return each.groupBy("signature").agg(F.min(F.struct("impl_id", "symbol_id"))["symbol_id"].alias("member_id"))


def resolve_static_call(call_site: DataFrame, symbol: DataFrame, impl_member: DataFrame) -> DataFrame:
    """T::f calls: the only f below a folder T, else the only f in a file T.rs, else the member T::f, else external."""
    calls = call_site.where("call_kind = 'static'").select("caller_id", "callee_name", "qualifier")
    # each symbol is listed under the folders and the file of its path, so that containment is an equality
    parts = F.split("path", "/")
    folders = symbol.select("symbol_id", "name", F.explode(F.array_distinct(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))))).alias("q"))
    files = symbol.select("symbol_id", "name", F.regexp_extract("path", r"/([^/]+)\.rs", 1).alias("q")).where("q <> ''")
    key = lambda df, n: _unique(df, "name", "q").select(F.col("name").alias("callee_name"), F.col("q").alias("qualifier"), F.col("n").alias(f"{n}_n"), F.col("only_id").alias(f"{n}_id"))
    out = calls.join(by_key(key(folders, "dir")), ["callee_name", "qualifier"], "left").join(by_key(key(files, "file")), ["callee_name", "qualifier"], "left")
    out = out.withColumn("signature", F.concat("qualifier", F.lit("::"), "callee_name")).join(by_key(_member(impl_member)), "signature", "left")
    by_file = F.when(F.col("dir_n").isNull(), F.col("file_id"))
    rule = F.when(F.col("dir_id").isNotNull(), "folder").when(by_file.isNotNull(), "file").when(F.col("member_id").isNotNull(), "member").otherwise("none")
    return _edge(out, F.coalesce(F.col("dir_id"), by_file, F.col("member_id")), rule, F.lit(True))


def resolve_method_call(call_site: DataFrame, params: DataFrame, impl_member: DataFrame, impl_block: DataFrame) -> DataFrame:
    """recv.f calls: self through the caller's own implementation, ctx.accounts and parameters through their types.

    params: symbol_id, param_name, type_name, context_inner. A known type
    without such a member is external; an unknown receiver is unresolved.
    """
    calls = call_site.where("call_kind = 'method'").select("caller_id", "callee_name", "qualifier")
    types = impl_block.groupBy("impl_id").agg(F.min("impl_to").alias("own_type"))
    own = impl_member.groupBy(F.col("symbol_id").alias("caller_id")).agg(F.min("impl_id").alias("impl_id")).join(by_key(types), "impl_id").drop("impl_id")
    p = params.groupBy(F.col("symbol_id").alias("caller_id"), F.col("param_name").alias("root")).agg(F.min(F.struct("type_name", "context_inner")).alias("t")).select("caller_id", "root", "t.*")
    out = calls.withColumns({"is_self": F.col("qualifier").rlike(r"^self(\.|$)"), "is_accounts": F.col("qualifier").rlike(r"^\w+\.accounts$"), "root": F.regexp_extract("qualifier", r"^(\w+)", 1)})
    out = out.join(by_key(own), "caller_id", "left").join(by_key(p), ["caller_id", "root"], "left")
    plain = F.col("qualifier") == F.col("root")
    kind = F.when(F.col("is_self"), F.col("own_type")).when(F.col("is_accounts"), F.col("context_inner")).when(plain, F.col("type_name"))
    out = out.withColumn("kind", kind).withColumn("signature", F.concat("kind", F.lit("::"), "callee_name")).join(by_key(_member(impl_member)), "signature", "left")
    rule = F.when(F.coalesce("is_self", F.lit(False)), "self").when(F.coalesce("is_accounts", F.lit(False)) & F.col("kind").isNotNull(), "accounts").when(F.col("kind").isNotNull(), "parameter").otherwise("none")
    return _edge(out, F.col("member_id"), rule, F.col("kind").isNotNull() & ~F.col("is_self"))


def call_edges(*resolved: DataFrame) -> DataFrame:
    """All resolved calls, without calls of a function by itself; one row for each callee."""
    every = resolved[0]
    for r in resolved[1:]:
        every = every.unionByName(r)
    every = every.where("callee_id is null or callee_id <> caller_id")
    key = F.coalesce(F.col("callee_id").cast("string"), F.concat(F.lit("name:"), "callee_name"))
    return every.withColumn("__k", key).groupBy("caller_id", "__k").agg(F.min(F.struct("resolution", "rule", "callee_name", "callee_id")).alias("r")).select("caller_id", "r.callee_id", "r.callee_name", "r.resolution", "r.rule")


def resolve_name(names: DataFrame, imports: DataFrame, local_item: DataFrame) -> DataFrame:
    """Candidates of (path, name) in order: an explicit import, else a local item as self::, else one for each glob.

    Of a path a::b only the first part is looked up, the rest is appended.
    """
    cut = names.withColumns({"head": F.substring_index("name", "::", 1), "tail": F.regexp_extract("name", r"^[^:]*(::.*)$", 1)})
    named = cut.join(by_key(imports.where("not is_glob").select("path", F.col("short_name").alias("head"), F.col("full_path").alias("f"))), ["path", "head"])
    by_import = named.select("path", "name", F.concat("f", "tail").alias("full_path"), F.lit(0).alias("rank")).distinct()
    rest = cut.join(by_key(by_import.select("path", "name")), ["path", "name"], "left_anti")
    here = rest.join(by_key(local_item.select("path", F.col("name").alias("head"))), ["path", "head"], "left_semi").select("path", "name", F.concat(F.lit("self::"), "name").alias("full_path"), F.lit(0).alias("rank"))
    rest = rest.join(by_key(here.select("path", "name")), ["path", "name"], "left_anti")
    globs = rest.join(by_key(imports.where("is_glob").select("path", F.col("full_path").alias("f"))), "path")
    order = Window.partitionBy("path", "name").orderBy("f")
    by_glob = globs.withColumn("rank", F.row_number().over(order) - 1).select("path", "name", F.concat("f", F.lit("::"), "name").alias("full_path"), "rank")
    return by_import.unionByName(here).unionByName(by_glob)


def resolve_import_path(sol_import: DataFrame, files: DataFrame, remaps: DataFrame) -> DataFrame:
    """The file an import means: by remapping (longest prefix first), relative, from the root, src, lib, node_modules; null if there is none.

    files has path; remaps has prefix, target and is a configuration-size table.
    """
    imports = sol_import.select("path", "import_path").distinct()
    folder = F.regexp_replace("path", r"[^/]*$", "")
    plain = imports.select("path", "import_path", F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.concat(b, F.col("import_path")).alias("candidate")) for k, b in ((2, folder), (3, F.lit("")), (4, F.lit("src/")), (5, F.lit("lib/")), (6, F.lit("node_modules/")))])).alias("c")).select("path", "import_path", "c.*")
    # each import is listed under its beginnings of the lengths that prefixes have, which are few
    lengths = sorted(r[0] for r in remaps.select(F.length("prefix")).where("prefix is not null").distinct().collect())
    begun = imports.withColumn("prefix", F.explode(F.array(*[F.when(F.length("import_path") >= n, F.substring("import_path", 1, n)) for n in lengths] or [F.lit(None).cast("string")])))
    mapped = begun.join(F.broadcast(remaps), "prefix").select("path", "import_path", F.lit(1).alias("rank"), (-F.length("prefix")).alias("longest"), F.concat("target", F.expr("substring(import_path, length(prefix) + 1)")).alias("candidate"))
    every = mapped.unionByName(plain.withColumn("longest", F.lit(0)))
    found = every.withColumn("candidate", plain_path(F.col("candidate"))).join(by_key(files.select(F.col("path").alias("candidate")).distinct()), "candidate", "left_semi")
    best = found.groupBy("path", "import_path").agg(F.min(F.struct("rank", "longest", "candidate"))["candidate"].alias("target"))
    return imports.join(by_key(best), ["path", "import_path"], "left")


def entry_struct(symbol: DataFrame, params: DataFrame) -> DataFrame:
    """Entries with the struct of their Context<T> parameter; struct_id is null when no or more than one struct fits. An empty program fits any."""
    entries = symbol.where("item = 'function' and sub_type = 'EntryPoint'").withColumn("same", F.count("*").over(Window.partitionBy("name", "program")))
    context = params.where("context_inner is not null").groupBy("symbol_id").agg(F.min(F.struct("ord", "context_inner"))["context_inner"].alias("struct_name"))
    structs = symbol.where("item = 'struct'").select(F.col("name").alias("struct_name"), F.col("program").alias("s_program"), F.col("symbol_id").alias("s_id"))
    joined = entries.join(context, "symbol_id", "left").join(structs, "struct_name", "left").withColumn("fits", (F.col("s_program") == F.col("program")) | (F.col("s_program") == "") | (F.col("program") == ""))
    found = joined.groupBy(F.col("symbol_id").alias("function_id"), "name", "program", "same", "struct_name").agg(F.count_if("fits").alias("n"), F.min(F.when(F.col("fits"), F.col("s_id"))).alias("s_id"))
    return found.select("name", "program", "function_id", "struct_name", F.when(F.col("n") == 1, F.col("s_id")).alias("struct_id"), (F.col("same") == 1).alias("unique_entry"))


def entry_struct_fallback(symbol: DataFrame, source_line: DataFrame) -> DataFrame:
    """For entries without Context<T>: the first context struct of the file, else the struct in `X::try_from(accounts` of the function."""
    entries = symbol.where("item = 'function' and sub_type = 'EntryPoint'").select(F.col("symbol_id").alias("function_id"), "name", "path", "start_line", "end_line")
    structs = symbol.where("item = 'struct' and sub_type = 'ContextAccounts'")
    same = structs.groupBy("path").agg(F.min(F.struct("start_line", "symbol_id"))["symbol_id"].alias("same_file"))
    lines = source_line.where(F.contains("line", F.lit("::try_from"))).select(F.col("path").alias("l_path"), "line_no", "line")
    used = within(lines, entries, [("l_path", "path")], "line_no", F.col("start_line"), F.col("end_line"))
    used = used.withColumn("x", F.regexp_extract("line", r"(\w+)::try_from\(\s*accounts", 1)).where("x <> ''").groupBy("function_id").agg(F.min(F.struct("line_no", "x"))["x"].alias("x"))
    named = used.join(symbol.where("item = 'struct'").groupBy(F.col("name").alias("x")).agg(F.min("symbol_id").alias("by_name")), "x", "left")
    out = entries.join(same, "path", "left").join(named, "function_id", "left")
    return out.select("function_id", "name", F.coalesce("same_file", "by_name").alias("struct_id"), F.when(F.col("same_file").isNotNull(), "same file").when(F.col("by_name").isNotNull(), "try_from").alias("rule"))


def entry_accounts(entry: DataFrame, account: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with their accounts, entries whose struct has none)."""
    return entry.join(account, "struct_id"), entry.join(account.select("struct_id").distinct(), "struct_id", "left_anti").select(*entry.columns)


def param_struct(params: DataFrame, symbol: DataFrame) -> DataFrame:
    """The struct (sub-type Other) of each parameter's type without its reference; null if there is none."""
    structs = symbol.where("item = 'struct' and sub_type = 'Other'").groupBy("name").agg(F.min("symbol_id").alias("struct_id"))
    t = params.withColumn("t", F.trim(F.regexp_replace("param_type", r"^&\s*('\w+\s+)?(mut\s+)?", "")))
    return t.join(structs, F.col("t") == F.col("name"), "left").select("symbol_id", "param_name", "struct_id")


def account_struct_source(entry: DataFrame, account: DataFrame, symbol: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(init and mut program-state accounts with the only struct of their name, rejected ones with the reason)."""
    structs = symbol.where("item = 'struct'").groupBy(F.col("name").alias("struct_name")).agg(F.count("*").alias("n"), F.min("symbol_id").alias("struct_symbol_id"))
    op = F.when(F.col("is_init"), "init").when(F.col("is_mut"), "mut")
    found = entry.select("entry_id", "struct_id").join(account.where("account_type = 'ProgramStateAccount' and (is_init or is_mut)"), "struct_id").withColumn("op", op).join(structs, "struct_name", "left")
    good = found.where("n = 1").select("entry_id", "account_name", "op", "struct_symbol_id")
    return good, found.where("n is null or n > 1").select("entry_id", "account_name", "op", F.when(F.col("n").isNull(), "missing").otherwise("ambiguous").alias("reason"))
