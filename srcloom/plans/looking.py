"""Registered queries of sources, look-ups, names and review documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcloom.operators import blocks as B
from srcloom.operators import calls as C
from srcloom.operators import paths as P
from srcloom.operators import resolve as R
from srcloom.operators import review as V
from srcloom.sources import files as S
from srcloom.sources.shared import fresh_path
from srcloom.streaming import incremental as I

from .calling import _rust_imports
from .fixtures import view, with_sql

QUERIES, ORACLES = {}, {}
ARRAYS = {"e25_markdown_sections": ["fences", "items"], "e29_completeness_check": ["missing"]}


def register(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


def _symbol(spark, d):
    return view(spark, d, "fx_symbol")


W = with_sql("fx_symbol")
ROOTS = [("../programs/prog_1", "first"), ("../programs/prog_12", "twelve"), ("../programs/", "any")]


# --- sources


def export_files(spark, sources, folder, extension="rs"):
    """Each (name, content) row as a file of its own below folder/name=..."""
    sources.select("name", F.col("content").alias("value")).write.partitionBy("name").option("lineSep", "\n").mode("append").text(folder)


def _exported(spark, d, folder):
    export_files(spark, view(spark, d, "fx_source").select(F.regexp_replace(F.regexp_replace("path", r"^.*/(prog_\d+)/src/", "$1-"), r"\.rs$", "").alias("name"), "content"), folder)
    return folder


@register("s1_corpus_scan", with_sql("fx_source") + "SELECT replace(replace(split_part(path, 'programs/', 2), '/src/', '-'), '.rs', '') AS name, length(content) AS n_chars, len(string_split(content, chr(10))) AS n_lines FROM fx_source")
def s1_corpus_scan(spark, d):
    found = S.corpus_scan(spark, _exported(spark, d, fresh_path(spark, "corpus")), "*.txt")
    content = F.regexp_replace("content", "\n$", "")
    return found.select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("name"), F.length(content).cast("long").alias("n_chars"), F.size(F.split(content, "\n")).cast("long").alias("n_lines"))


@register("s2_scan_excluding", W + "SELECT symbol_id, path FROM (SELECT symbol_id, CASE symbol_id % 4 WHEN 0 THEN replace(path, '/src/', '/tests/') WHEN 1 THEN replace(path, '/src/', '/mock/') ELSE path END AS path FROM fx_symbol) WHERE symbol_id % 4 > 1")
def s2_scan_excluding(spark, d):
    p = F.when(F.col("symbol_id") % 4 == 0, F.replace("path", F.lit("/src/"), F.lit("/tests/"))).when(F.col("symbol_id") % 4 == 1, F.replace("path", F.lit("/src/"), F.lit("/mock/"))).otherwise(F.col("path"))
    return _symbol(spark, d).select("symbol_id", p.alias("path")).where(~S.excluded(F.col("path")))


@register("s3_multi_root_scan", W + "SELECT symbol_id, CASE WHEN contains(path, 'prog_12/') THEN 'twelve' WHEN contains(path, 'prog_1') THEN 'ones' ELSE '' END AS program, contains(path, 'prog_1') AND NOT contains(path, 'prog_12/') AS external FROM fx_symbol")
def s3_multi_root_scan(spark, d):
    return S.tag_roots(_symbol(spark, d).select("symbol_id", "path"), [("prog_1", "ones", True), ("prog_12/", "twelve", False)]).select("symbol_id", "program", "external")


@register("s4_file_listing", W + "SELECT DISTINCT path FROM fx_symbol WHERE path NOT LIKE '%/m3.rs' AND (path LIKE '%2.rs' OR path LIKE '%3.rs' OR path LIKE '%4.rs')")
def s4_file_listing(spark, d):
    return S.filter_listing(_symbol(spark, d).select("path").distinct(), exclude=["m3.rs"], include=["2.rs", "3.rs", "4.rs"], sort=True)


def _by_folder(spark, d):
    """fx_source as files: those of m0 under tests, of m1 under mock, the others under src. Returns the folder that holds the three."""
    root = fresh_path(spark, "roots")
    files = view(spark, d, "fx_source")
    place = F.when(F.col("path").endswith("/m0.rs"), "tests").when(F.col("path").endswith("/m1.rs"), "mock").otherwise("src")
    for folder in ("tests", "mock", "src"):
        export_files(spark, files.where(place == folder).select(F.regexp_replace(F.regexp_replace("path", r"^.*/(prog_\d+)/src/", "$1-"), r"\.rs$", "").alias("name"), "content"), f"{root}/{folder}")
    return root


FILE = "SELECT replace(replace(split_part(path, 'programs/', 2), '/src/', '-'), '.rs', '') AS name, length(content) AS n_chars, CASE WHEN path LIKE '%/m0.rs' THEN 'tests' WHEN path LIKE '%/m1.rs' THEN 'mock' ELSE 'src' END AS folder FROM fx_source"


def _named(found):
    return found.withColumns({"name": F.regexp_extract("path", "name=([^/]+)/", 1), "n_chars": F.length(F.regexp_replace("content", "\n$", "")).cast("long")})


@register("s2_corpus_scan_excluding", with_sql("fx_source") + f"SELECT name, n_chars FROM ({FILE}) WHERE folder = 'src'")
def s2_corpus_scan_excluding(spark, d):
    return _named(S.corpus_scan(spark, _by_folder(spark, d), "*.txt", S.EXCLUDED)).select("name", "n_chars")


@register("s3_scan_roots", with_sql("fx_source") + f"SELECT name, n_chars, CASE folder WHEN 'src' THEN 'own' ELSE folder END AS program, folder = 'mock' AS external FROM ({FILE})")
def s3_scan_roots(spark, d):
    root = _by_folder(spark, d)
    found = S.scan_roots(spark, [(f"{root}/src", "own", False), (f"{root}/tests", "tests", False), (f"{root}/mock", "mock", True)], "*.txt")
    return _named(found).select("name", "n_chars", "program", "external")


@register("s4_list_files", with_sql("fx_source") + f"SELECT name, folder, octet_length(encode(content)) + 1 AS length FROM ({FILE.replace('length(content) AS n_chars', 'content')})")
def s4_list_files(spark, d):
    """Names and sizes of files; the listing of the same folder under another suffix is empty."""
    root = _by_folder(spark, d)
    found = S.list_files(spark, root, include=[".txt"]).unionByName(S.list_files(spark, root, include=[".rs"]))
    return found.select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("name"), F.regexp_extract("path", "/([a-z]+)/name=", 1).alias("folder"), "length")


@register("s5_read_metadata", W + """SELECT symbol_id, name, coalesce(start, 0) AS start_line, '' AS doc, k FROM (SELECT symbol_id, name, CASE WHEN symbol_id % 3 > 0 THEN start_line END AS start, unnest(CASE WHEN symbol_id % 2 = 0 THEN ['functions', 'structs'] ELSE ['functions'] END) AS k FROM fx_symbol)""")
def s5_read_metadata(spark, d):
    """A JSON document for each hundred symbols, with fields and a collection that are not always there."""
    whole = F.struct("symbol_id", "name", F.when(F.col("symbol_id") % 3 > 0, F.col("start_line")).alias("start_line"))
    doc = F.to_json(F.struct(F.collect_list(whole).alias("functions"), F.collect_list(F.when(F.col("symbol_id") % 2 == 0, whole)).alias("structs"))).alias("content")
    folder = fresh_path(spark, "metadata")
    export_files(spark, _symbol(spark, d).groupBy(F.floor(F.col("symbol_id") / 100).alias("name")).agg(doc), folder)
    fields = T.StructType().add("symbol_id", "long").add("name", "string").add("start_line", "integer").add("doc", "string")
    tables = S.read_metadata(spark, [folder], {"functions": fields, "structs": fields, "enums": fields})
    return tables["functions"].withColumn("k", F.lit("functions")).unionByName(tables["structs"].withColumn("k", F.lit("structs"))).unionByName(tables["enums"].withColumn("k", F.lit("enums")))


@register("s6_write_metadata", with_sql("fx_symbol", "fx_impl") + "SELECT 'symbol' AS t, symbol_id AS id, name, program FROM fx_symbol UNION ALL SELECT 'impl', impl_id, impl_to, NULL FROM fx_impl")
def s6_write_metadata(spark, d):
    """Two tables written and read back; what another project would write over them is refused."""
    folder = fresh_path(spark, "written")
    tables = {"symbol": _symbol(spark, d).select("symbol_id", "name", "program"), "impl": view(spark, d, "fx_impl").select("impl_id", "impl_to")}
    S.write_metadata(tables, folder, "audit", "audit")
    try:
        S.write_metadata({n: t.where("false") for n, t in tables.items()}, folder, "other", "audit")
    except ValueError:
        pass
    symbol, impl = S.metadata_table(spark, folder, "symbol"), S.metadata_table(spark, folder, "impl")
    return symbol.select(F.lit("symbol").alias("t"), F.col("symbol_id").alias("id"), "name", "program").unionByName(impl.select(F.lit("impl").alias("t"), F.col("impl_id").alias("id"), F.col("impl_to").alias("name"), F.lit(None).cast("string").alias("program")))


@register("s8_write_reports", """SELECT 'r' || s_suppkey AS entry, '# a:' || chr(10) || chr(10) || 'one ' || s_name || chr(10) || 'two' || chr(10) || chr(10) || '# b:' || chr(10) || chr(10) || s_nationkey AS value FROM supplier""")
def s8_write_reports(spark, d):
    """A written document for each supplier, read back as files."""
    row = lambda section, ord, line: F.struct(F.lit(section).alias("section"), F.lit(ord).alias("ord"), line.alias("line"))
    parts = F.array(row("b", 1, F.col("s_nationkey").cast("string")), row("a", 2, F.lit("two")), row("a", 1, F.concat(F.lit("one "), "s_name")))
    rows = view(spark, d, "supplier").select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("entry_name"), F.explode(parts).alias("p")).select("entry_name", "p.*")
    folder = fresh_path(spark, "reports")
    S.write_reports(rows, folder)
    return spark.read.text(folder, wholetext=True).select("entry", F.regexp_replace("value", "\n$", "").alias("value"))


@register("s5_metadata_read", """SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INT), 0) AS k, coalesce(json_extract_string(props, '$.absent'), '') AS absent FROM events""")
def s5_metadata_read(spark, d):
    parsed = view(spark, d, "events").select("event_id", F.from_json("props", "k int, absent string").alias("p")).select("event_id", "p.*")
    return S.defaulted(parsed)


@register("s6_metadata_write", W + "SELECT '{\"symbol_id\":' || symbol_id || ',\"name\":\"' || name || '\"}' AS value FROM fx_symbol")
def s6_metadata_write(spark, d):
    return S.export_json(_symbol(spark, d).select("symbol_id", "name"))


@register("s7_metadata_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -1 - o_orderkey, 'N' FROM orders WHERE o_orderkey % 7 = 0")
def s7_metadata_upsert(spark, d):
    base = view(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    changed = base.where("o_orderkey % 7 = 0")
    delta = changed.withColumn("o_orderstatus", F.lit("X")).unionByName(changed.select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus")))
    return S.upsert(base, delta, ["o_orderkey"])


@register("s9_remapping_read", """SELECT 'f' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.txt' ELSE '.toml' END AS file, prefix, target FROM supplier, LATERAL (VALUES ('@a/', 'lib/a' || s_suppkey || '/'), ('b/', 'lib/b/src/')) AS v(prefix, target)""")
def s9_remapping_read(spark, d):
    n = F.col("s_suppkey").cast("string")
    text = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("# kept=out\n\n@a/=lib/a"), n, F.lit("/\nb/=lib/b/src/\n"))).otherwise(F.concat(F.lit("src = 'x'\nremappings = [\n  '@a/=lib/a"), n, F.lit("/',\n  'b/=lib/b/src/'\n]\nlibs = ['c=d']\n")))
    lines = view(spark, d, "supplier").select(F.concat(F.lit("f"), n, F.when(F.col("s_suppkey") % 2 == 0, ".txt").otherwise(".toml")).alias("file"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return S.read_remappings(lines)


# --- look-ups

@register("p1_program_of_path", W + "SELECT symbol_id, CASE WHEN starts_with(path, '../programs/prog_12') THEN 'twelve' WHEN starts_with(path, '../programs/prog_1') THEN 'first' ELSE 'any' END AS program FROM fx_symbol")
def p1_program_of_path(spark, d):
    return P.program_of_path(_symbol(spark, d), ROOTS).select("symbol_id", "program")


@register("p2_pretty_path", W + "SELECT symbol_id, substr(path, 4) AS pretty_path FROM fx_symbol")
def p2_pretty_path(spark, d):
    return P.pretty_path(_symbol(spark, d)).select("symbol_id", "pretty_path")


@register("p3_external_flag", with_sql("fx_contract") + "SELECT contract_id, external FROM fx_contract")
def p3_external_flag(spark, d):
    c = view(spark, d, "fx_contract").select("contract_id", F.when(F.col("external"), "a/lib/C.sol").otherwise("a/src/lib.sol").alias("path"))
    return P.external_flag(c).select("contract_id", "external")


@register("p4_symbol_filter", W + "SELECT symbol_id FROM fx_symbol WHERE kind = 'EntryPoint' AND (program = 'prog_3' OR symbol_id % 10 = 0)")
def p4_symbol_filter(spark, d):
    s = _symbol(spark, d).select("symbol_id", "name", F.col("kind").alias("sub_type"), F.when(F.col("symbol_id") % 10 == 0, "").otherwise(F.col("program")).alias("program"))
    return P.symbol_filter(s, sub_type="EntryPoint", program="prog_3").select("symbol_id")


@register("p5_lookup_by_id", with_sql("fx_symbol", "fx_impl", "fx_entry") + """SELECT i.id, t.kind, t.name FROM (SELECT DISTINCT o_custkey AS id FROM orders) i LEFT JOIN (SELECT symbol_id AS id, 'symbol' AS kind, name FROM fx_symbol
UNION ALL SELECT impl_id, 'impl', impl_to FROM fx_impl UNION ALL SELECT entry_id, 'entry', name FROM fx_entry) t USING (id)""")
def p5_lookup_by_id(spark, d):
    tables = {
        "symbol": _symbol(spark, d).select(F.col("symbol_id").alias("id"), "name", "path"),
        "impl": view(spark, d, "fx_impl").select(F.col("impl_id").alias("id"), F.col("impl_to").alias("name"), "path"),
        "entry": view(spark, d, "fx_entry").select(F.col("entry_id").alias("id"), "name", "program"),
    }
    return P.lookup_by_id(tables, view(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct()).drop("payload")


@register("p6_find_first", W + "SELECT name, symbol_id FROM (SELECT name, min(symbol_id) AS symbol_id FROM fx_symbol GROUP BY name) UNION ALL SELECT DISTINCT 'fn_' || ((o_orderkey * 31) % 120), NULL FROM orders WHERE 'fn_' || ((o_orderkey * 31) % 120) NOT IN (SELECT name FROM fx_symbol)")
def p6_find_first(spark, d):
    s = _symbol(spark, d).select("name", "symbol_id")
    wanted = view(spark, d, "fx_call").select(F.col("callee_name").alias("name")).distinct()
    return P.find_first(s, ["name"], ["symbol_id"]).unionByName(P.missing(s, wanted, ["name"]).withColumn("symbol_id", F.lit(None).cast("long")))


@register("p7_slice_source", with_sql("fx_layout", "fx_block") + "SELECT l.symbol_id, substr(block, position(chr(10) IN block) + 1) AS content FROM fx_layout l JOIN fx_block b USING (symbol_id)")
def p7_slice_source(spark, d):
    lay = _layout(spark, d)
    return P.slice_source(view(spark, d, "fx_source"), lay.select("symbol_id", "path", (F.col("k") * 11 - 9).alias("start_line"), (F.col("k") * 11 - 1).alias("end_line")))


def _layout(spark, d):
    from pyspark.sql import Window

    return _symbol(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("start_line", "symbol_id")))


#: Every line of fx_source, from its layout: o is the place in the block.
LINES = """lines AS (SELECT path, CAST(11*(k-1)+o AS INT) AS line_no, o, line FROM (SELECT *, max(k) OVER (PARTITION BY path) AS n FROM fx_layout), LATERAL (VALUES (1, '/// doc of ' || name),
(2, CASE WHEN kind = 'EntryPoint' THEN 'pub ' ELSE '' END || 'fn ' || name || '(ctx: Context<Acc_' || (symbol_id % 9) || '>, amount: u64) -> Result<()> {'), (3, '    require!(amount > ' || (symbol_id % 5) || ');'), (4, '    if amount == 0 {'),
(5, '        assert!(flag);'), (6, '    }'), (7, '    fn_' || ((symbol_id * 31) % 120) || '(amount)?;'), (8, '    Type_' || (symbol_id % 17) || '::fn_' || ((symbol_id * 7) % 97) || '(amount)?; // call'), (9, '    Ok(())'), (10, '}'), (11, '')) AS v(o, line) WHERE o < 11 OR k < n)"""


@register("p8_strip_comments", with_sql("fx_layout", more=LINES) + "SELECT path, line_no, CASE WHEN o IN (1, 5) THEN '' ELSE replace(line, ' // call', '') END AS line FROM lines")
def p8_strip_comments(spark, d):
    return P.strip_comments(B.source_lines(view(spark, d, "fx_source")), ("assert!",))


@register("p9_dedent", with_sql("fx_layout", more=LINES) + "SELECT path, line_no, CASE WHEN o BETWEEN 3 AND 9 THEN substr(line, 5) ELSE line END AS line FROM lines")
def p9_dedent(spark, d):
    """The body of each function as one group, every other line as its own."""
    at = (F.col("line_no") - 1) % 11
    lines = B.source_lines(view(spark, d, "fx_source")).withColumns({"block": F.floor((F.col("line_no") - 1) / 11), "part": F.when(at.between(2, 8), -1).otherwise(at)})
    return P.dedent(lines, ["path", "block", "part"]).select("path", "line_no", "line")


@register("p10_symbol_label", W + "SELECT symbol_id, name || ': ' || substr(path, 4) || ':' || start_line AS label FROM fx_symbol")
def p10_symbol_label(spark, d):
    return P.symbol_label(_symbol(spark, d))


@register("p11_permalink", W + "SELECT symbol_id, CASE WHEN symbol_id % 2 = 0 THEN 'https://host.example/o/r/blob/abc123/' || substr(path, 4) || '#L' || start_line ELSE '' END AS url FROM fx_symbol")
def p11_permalink(spark, d):
    url = F.when(F.col("symbol_id") % 2 == 0, "https://host.example/o/r/commit/abc123").otherwise("https://host.example/o")
    return P.permalink(_symbol(spark, d), url)


# --- names and structs

@register("j11_resolve_name", """SELECT 'src/i' || c_custkey || '.rs' AS path, name, full_path FROM customer, LATERAL (VALUES ('c_' || c_custkey, 'crate::m' || c_custkey || '::b'), ('d::x', 'crate::m' || c_custkey || '::inner::d::x'), ('Local_' || c_custkey, 'self::Local_' || c_custkey),
('other', 'crate::m' || c_custkey || '::inner::e::other'), ('other', 'super::g_' || c_custkey || '::other')) AS v(name, full_path)""")
def j11_resolve_name(spark, d):
    files = _rust_imports(spark, d)
    imports, local = C.import_scope(files)
    n = F.regexp_extract("path", r"i(\d+)\.rs", 1)
    names = files.select("path", F.explode(F.array(F.concat(F.lit("c_"), n), F.lit("d::x"), F.concat(F.lit("Local_"), n), F.lit("other"))).alias("name"))
    return R.resolve_name(names, imports, local).select("path", "name", "full_path")


@register("j12_resolve_import_path", """SELECT 'src/a/C' || s_suppkey || '.sol' AS path, import_path, target FROM supplier, LATERAL (VALUES ('./B.sol', 'src/a/B.sol'), ('../X.sol', 'src/X.sol'), ('@oz/t/T.sol', 'lib/oz/t/T.sol'), ('y/Y.sol', 'lib/y/Y.sol'), ('none/' || s_suppkey || '.sol', CAST(NULL AS VARCHAR))) AS v(import_path, target)""")
def j12_resolve_import_path(spark, d):
    n = F.col("s_suppkey").cast("string")
    sup = view(spark, d, "supplier")
    imports = sup.select(F.concat(F.lit("src/a/C"), n, F.lit(".sol")).alias("path"), F.explode(F.array(F.lit("./B.sol"), F.lit("../X.sol"), F.lit("@oz/t/T.sol"), F.lit("y/Y.sol"), F.concat(F.lit("none/"), n, F.lit(".sol")))).alias("import_path"))
    files = sup.select(F.explode(F.array(*[F.lit(p) for p in ("src/a/B.sol", "src/X.sol", "lib/oz/t/T.sol", "lib/t/T.sol", "lib/y/Y.sol", "node_modules/y/Y.sol")])).alias("path")).distinct()
    remaps = spark.createDataFrame([("@oz/", "lib/oz/"), ("@", "lib/")], "prefix string, target string")
    return R.resolve_import_path(imports, files, remaps)


def _structs(spark, d):
    """Functions of fx_symbol, and a struct of each symbol: of nine in a row seven have a name of their own, two share one."""
    f = _symbol(spark, d).select("symbol_id", F.lit("function").alias("item"), F.col("kind").alias("sub_type"), F.concat("name", F.lit("_"), F.col("symbol_id").cast("string")).alias("name"), F.lit("p").alias("program"), "path", "start_line", "end_line")
    n = F.when(F.col("symbol_id") % 9 == 8, F.col("symbol_id") - 1).otherwise(F.col("symbol_id"))
    s = _symbol(spark, d).select((-1 - F.col("symbol_id")).alias("symbol_id"), F.lit("struct").alias("item"), F.lit("ContextAccounts").alias("sub_type"), F.concat(F.lit("Acc_"), n.cast("string")).alias("name"), F.when(F.col("symbol_id") % 2 == 0, "p").otherwise("").alias("program"), "path", "start_line", "end_line")
    return f.unionByName(s)


@register("j4_entry_struct", W + """SELECT name || '_' || symbol_id AS name, symbol_id AS function_id, CASE WHEN symbol_id % 9 < 7 OR (symbol_id % 9 = 7 AND NOT EXISTS (SELECT 1 FROM fx_symbol x WHERE x.symbol_id = s.symbol_id + 1)) THEN -1 - symbol_id END AS struct_id FROM fx_symbol s WHERE kind = 'EntryPoint'""")
def j4_entry_struct(spark, d):
    s = _structs(spark, d)
    params = _symbol(spark, d).select("symbol_id", F.lit(1).alias("ord"), F.concat(F.lit("Acc_"), F.col("symbol_id").cast("string")).alias("context_inner"))
    return R.entry_struct(s, params).select("name", "function_id", "struct_id")


@register("j5_entry_struct_fallback", with_sql("fx_layout") + """SELECT symbol_id AS function_id, CASE WHEN h IS NOT NULL THEN h WHEN symbol_id % 3 = 0 THEN -100 END AS struct_id, CASE WHEN h IS NOT NULL THEN 'same file' WHEN symbol_id % 3 = 0 THEN 'try_from' END AS rule
FROM (SELECT *, (SELECT min(-1000 - x.symbol_id) FROM fx_layout x WHERE x.path = fx_layout.path AND x.path NOT LIKE '%/m5.rs') AS h FROM fx_layout WHERE kind = 'EntryPoint')""")
def j5_entry_struct_fallback(spark, d):
    """Each symbol has a context struct in its file, which is of another kind in files m5; each entry has a line, of which a third convert."""
    lay = _layout(spark, d)
    f = lay.select("symbol_id", F.lit("function").alias("item"), F.col("kind").alias("sub_type"), "name", "path", (F.col("k") * 11).alias("start_line"), (F.col("k") * 11 + 5).alias("end_line"))
    s = lay.select((-1000 - F.col("symbol_id")).alias("symbol_id"), F.lit("struct").alias("item"), F.when(F.col("path").endswith("/m5.rs"), "Other").otherwise("ContextAccounts").alias("sub_type"), F.lit("In").alias("name"), "path", F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    x = spark.createDataFrame([(-100, "struct", "Other", "Named", "elsewhere", 1, 2)], s.schema)
    lines = lay.select("path", (F.col("k") * 11 + 1).alias("line_no"), F.when(F.col("symbol_id") % 3 == 0, "    let x = Named::try_from(accounts)?;").otherwise("    let x = Named::new(accounts)?;").alias("line"))
    return R.entry_struct_fallback(f.unionByName(s).unionByName(x), lines).select("function_id", "struct_id", "rule")


@register("j15_param_struct", W + "SELECT s.symbol_id, param_name, x.symbol_id AS struct_id FROM fx_symbol s LEFT JOIN fx_symbol x ON x.symbol_id = 2 * s.symbol_id, (VALUES ('a'), ('b')) AS v(param_name)")
def j15_param_struct(spark, d):
    """A struct of each symbol; each symbol has parameters of the struct of twice its number, which only half of them find."""
    s = _symbol(spark, d)
    structs = s.select("symbol_id", F.lit("struct").alias("item"), F.lit("Other").alias("sub_type"), F.concat(F.lit("T"), F.col("symbol_id").cast("string")).alias("name"))
    t = F.concat(F.lit("T"), (F.col("symbol_id") * 2).cast("string"))
    params = s.select("symbol_id", F.lit("a").alias("param_name"), t.alias("param_type")).unionByName(s.select("symbol_id", F.lit("b").alias("param_name"), F.concat(F.lit("&'a mut "), t).alias("param_type")))
    return R.param_struct(params, structs)


# --- review documents

@register("j18_review_reconcile", """WITH e AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 5 > 0), r AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 3 > 0)
SELECT 'ep_' || coalesce(e.k, r.k) AS name, CASE WHEN r.k IS NULL THEN 'new' WHEN e.k IS NULL THEN 'deprecated' ELSE 'kept' END AS status_change FROM e FULL JOIN r ON e.k = r.k""")
def j18_review_reconcile(spark, d):
    e = view(spark, d, "orders").where("o_orderkey % 5 > 0").select(F.concat(F.lit("ep_"), "o_orderkey").alias("name"))
    r = view(spark, d, "lineitem").select(F.concat(F.lit("ep_"), "l_orderkey").alias("name"), F.when(F.col("l_orderkey") % 3 > 0, "finished").otherwise("deprecated").alias("status"))
    return V.review_reconcile(e, r)


def review_docs(spark, d):
    """A review document for each conversation turn, with its text as notes."""
    c = view(spark, d, "conversations")
    name = F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    text = F.regexp_replace("text", r"\s+", " ")
    body = F.concat(F.lit("intro\n# State changes:\n\n- a: starts\n- b: ends\n\n# Unknown:\nx\n# Notes:\n\n- [x] done\n"), text, F.lit("\n```rust\nlet x = 1;\n```\n"))
    return c.select(name.alias("entry_name"), body.alias("body"), text.alias("t"))


DOCS = "docs AS (SELECT 'c-' || conv_id || '-' || turn AS entry_name, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM conversations)"


@register("e25_markdown_sections", f"""WITH {DOCS} SELECT entry_name, section, CASE WHEN section = 'Notes' THEN '- [x] done' || chr(10) || t || chr(10) || '```rust' || chr(10) || 'let x = 1;' || chr(10) || '```' ELSE content END AS content, fences, items FROM docs,
LATERAL (VALUES ('State changes', '- a: starts' || chr(10) || '- b: ends' || chr(10) || chr(10) || '# Unknown:' || chr(10) || 'x', CAST([] AS VARCHAR[]), ['a: starts', 'b: ends']), ('Notes', '', ['let x = 1;'], [])) AS v(section, content, fences, items)""")
def e25_markdown_sections(spark, d):
    return V.markdown_sections(review_docs(spark, d).drop("t"))


@register("e28_finding_severity", """SELECT CASE WHEN s = 'odd' THEN n ELSE r || '-' || regexp_replace(n, '^1-', '') END AS name, CASE WHEN s <> 'odd' THEN CAST(r AS INT) END AS rank, CASE WHEN s = 'odd' THEN 'unknown severity: odd' END AS error FROM (
SELECT CASE WHEN doc_id % 2 = 0 THEN '1-f' ELSE 'f' END || doc_id AS n, CASE doc_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'informational' ELSE 'odd' END AS s, doc_id % 5 + 1 AS r FROM labels)""")
def e28_finding_severity(spark, d):
    word = F.element_at(F.array(*[F.lit(w) for w in ("High", "Medium", "Low", "Informational", "Odd")]), (F.col("doc_id") % 5 + 1).cast("int"))
    docs = view(spark, d, "labels").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "1-f").otherwise("f"), F.col("doc_id").cast("string")).alias("entry_name"), F.concat(F.lit("# Title\n\n**Severity:** "), word, F.lit("\n\ntext")).alias("body"))
    return V.finding_severity(docs)


@register("e29_completeness_check", """SELECT doc_id AS entry_name, [x FOR x IN ['the ', 'zzz_none', 'é'] IF contains(coalesce(text, ''), x)] AS missing, NOT (contains(coalesce(text, ''), 'the ') OR contains(coalesce(text, ''), 'é')) AS complete FROM documents""")
def e29_completeness_check(spark, d):
    docs = view(spark, d, "documents").select(F.col("doc_id").alias("entry_name"), F.coalesce("text", F.lit("")).alias("body"))
    return V.completeness_check(docs, ["the ", "zzz_none", "é"])


# --- streaming

@register("st1_incremental_symbols", with_sql("fx_layout") + """SELECT replace(replace(split_part(path, 'programs/', 2), '/src/', '-'), '.rs', '') AS file, name, CAST(11*(k-1)+2 AS INT) AS start_line, CAST(11*(k-1)+10 AS INT) AS end_line FROM fx_layout WHERE path NOT LIKE '%/m3.rs'
UNION ALL SELECT DISTINCT replace(replace(split_part(path, 'programs/', 2), '/src/', '-'), '.rs', ''), 'changed', 1, 3 FROM fx_layout WHERE path LIKE '%/m3.rs' AND path NOT LIKE '%prog_1/%'""")
def st1_incremental_symbols(spark, d):
    """Two revisions arrive one after the other: in the second the m3 files have one function, or none in prog_1."""
    folder, target = fresh_path(spark, "arriving"), fresh_path(spark, "symbols")
    _exported(spark, d, f"{folder}/rev=1")
    I.incremental_symbols(spark, folder, target).awaitTermination()
    second = view(spark, d, "fx_source").where(F.col("path").endswith("/m3.rs")).select(F.regexp_replace(F.regexp_replace("path", r"^.*/(prog_\d+)/src/", "$1-"), r"\.rs$", "").alias("name"), F.when(F.contains("path", F.lit("prog_1/")), "// empty").otherwise("fn changed() {\n    x();\n}").alias("content"))
    export_files(spark, second, f"{folder}/rev=2")
    I.incremental_symbols(spark, folder, target).awaitTermination()
    return I.latest_symbols(spark, target).select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("file"), "name", "start_line", "end_line")


@register("st1_compacted_symbols", with_sql("fx_layout") + """SELECT replace(replace(split_part(path, 'programs/', 2), '/src/', '-'), '.rs', '') AS file, name, CAST(11*(k-1)+2 AS INT) AS start_line FROM fx_layout WHERE path NOT LIKE '%/m3.rs' AND path NOT LIKE '%/m4.rs'
UNION ALL SELECT DISTINCT replace(replace(split_part(path, 'programs/', 2), '/src/', '-'), '.rs', ''), 'changed', 1 FROM fx_layout WHERE path LIKE '%/m3.rs'""")
def st1_compacted_symbols(spark, d):
    """The log is folded, then a revision arrives that changes the m3 files and empties the m4 files, and it is folded again."""
    folder, target = fresh_path(spark, "arriving"), fresh_path(spark, "symbols")
    _exported(spark, d, f"{folder}/rev=1")
    I.incremental_symbols(spark, folder, target).awaitTermination()
    I.compact(spark, target)
    second = view(spark, d, "fx_source").where(F.col("path").endswith("/m3.rs") | F.col("path").endswith("/m4.rs")).select(F.regexp_replace(F.regexp_replace("path", r"^.*/(prog_\d+)/src/", "$1-"), r"\.rs$", "").alias("name"), F.when(F.col("path").endswith("/m4.rs"), "// empty").otherwise("fn changed() {\n    x();\n}").alias("content"))
    export_files(spark, second, f"{folder}/rev=2")
    I.incremental_symbols(spark, folder, target).awaitTermination()
    before = I.latest_symbols(spark, target).count()
    I.compact(spark, target)
    now = I.latest_symbols(spark, target)
    if now.count() != before:
        raise RuntimeError("folding the log changed the state")
    return now.select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("file"), "name", "start_line")
