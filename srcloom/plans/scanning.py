"""Registered queries of the block and symbol operators over fx_source."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom.operators import blocks as B

from .fixtures import spread, view, with_sql

QUERIES, ORACLES = {}, {}


def _files(spark, d):
    return view(spark, d, "fx_source")


def _lines(spark, d):
    return B.source_lines(_files(spark, d))


def _functions(spark, d):
    return B.symbol_extract(_files(spark, d))


def register(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


W = with_sql("fx_layout")
NAMED = ", split_part(path, '/', 3) AS prog"


@register("e1_block_scan", W + """SELECT path, kind, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line FROM (
SELECT path, 'Function' AS kind, 11*(k-1)+2 AS start_line, 11*(k-1)+10 AS end_line FROM fx_layout
UNION ALL SELECT path, 'If', 11*(k-1)+4, 11*(k-1)+6 FROM fx_layout UNION ALL SELECT path, 'IfValidation', 11*(k-1)+4, 11*(k-1)+6 FROM fx_layout
UNION ALL SELECT path, 'Validation', 11*(k-1)+3, 11*(k-1)+3 FROM fx_layout UNION ALL SELECT path, 'Validation', 11*(k-1)+5, 11*(k-1)+5 FROM fx_layout)""")
def e1_block_scan(spark, d):
    return B.block_scan(_lines(spark, d), kinds=["Function", "If", "IfValidation", "Validation", "Struct", "Enum", "Trait", "TraitImpl", "Module"]).select("path", "kind", "start_line", "end_line")


@register("e2_block_in_range", W + """SELECT path, name, CAST(f AS INT) AS start_line, kind, CAST(s AS INT) AS block_start, CAST(e AS INT) AS block_end FROM (
SELECT path, name, 11*(k-1)+2 AS f, 'If' AS kind, 11*(k-1)+4 AS s, 11*(k-1)+6 AS e FROM fx_layout
UNION ALL SELECT path, name, 11*(k-1)+2, 'Validation', 11*(k-1)+3, 11*(k-1)+3 FROM fx_layout
UNION ALL SELECT path, name, 11*(k-1)+2, 'Validation', 11*(k-1)+5, 11*(k-1)+5 FROM fx_layout)""")
def e2_block_in_range(spark, d):
    s = _functions(spark, d)
    found = B.block_in_range(_lines(spark, d), s, kinds=["If", "Validation"]).withColumnsRenamed({"start_line": "block_start", "end_line": "block_end"})
    return found.join(s.select("symbol_id", "path", "name", "start_line"), "symbol_id").select("path", "name", "start_line", "kind", "block_start", "block_end")


@register("e3_block_name_visibility", W + "SELECT path, CAST(11*(k-1)+2 AS INT) AS start_line, name, kind = 'EntryPoint' AS is_public FROM fx_layout")
def e3_block_name_visibility(spark, d):
    lines = _lines(spark, d)
    return B.block_name_visibility(B.block_scan(lines, kinds=["Function"]), lines).select("path", "start_line", "name", "is_public")


@register("e4_symbol_extract", W + "SELECT path, 'function' AS item, name, CAST(11*(k-1)+2 AS INT) AS start_line, CAST(11*(k-1)+10 AS INT) AS end_line FROM fx_layout")
def e4_symbol_extract(spark, d):
    return _functions(spark, d).select("path", "item", "name", "start_line", "end_line")


@register("e5_symbol_classify", W + "SELECT path, name, CAST(11*(k-1)+2 AS INT) AS start_line, 'Other' AS sub_type FROM fx_layout")
def e5_symbol_classify(spark, d):
    return B.symbol_classify(_functions(spark, d), _lines(spark, d)).select("path", "name", "start_line", "sub_type")


def kinds_files(spark, d):
    """A file for each part with one item of every kind: a program module, context accounts, a state account, plain items, a marker."""
    n = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("#[program]\npub mod prog_"), n, F.lit(" {\n    pub fn act_"), n, F.lit("(a: u8) -> u8 {\n        a\n    }\n}\n#[derive(Accounts)]\npub struct In_"), n,
        F.lit("<'info> {\n    #[account(mut)]\n    pub payer: Signer<'info>,\n    pub state: Account<'info, State>,\n}\n#[account]\npub struct State_"), n, F.lit(" {\n    pub size: u64,\n}\n// from here\npub enum Kind_"), n, F.lit(" {\n    A,\n}\npub trait Do_"), n,
        F.lit(" {\n}\nimpl Do_"), n, F.lit(" for State_"), n, F.lit(" {\n    fn go_"), n, F.lit("(b: u8) {\n    }\n}\nstruct View_"), n, F.lit("<'a> {\n}\nimpl<'a> TryFrom<&'a [AccountView]> for View_"), n, F.lit("<'a> {\n}\npub fn process(accounts: &[AccountView]) {\n}\n"),
    )
    return spread(view(spark, d, "part").select(F.concat(F.lit("src/k"), n, F.lit(".rs")).alias("path"), text.alias("content")))


def kind_rows(values: str, cols: str) -> str:
    return f"SELECT 'src/k' || p_partkey || '.rs' AS path, {cols} FROM part, LATERAL (VALUES {values}) AS v"


@register("e5_symbol_classify_kinds", kind_rows("""(3, 'function', 'act_' || p_partkey, 'EntryPoint'), (8, 'struct', 'In_' || p_partkey, 'ContextAccounts'), (14, 'struct', 'State_' || p_partkey, 'SolanaAccount'), (18, 'enum', 'Kind_' || p_partkey, 'Enum'), (21, 'trait', 'Do_' || p_partkey, 'Definition'),
(23, 'trait', 'Do_' || p_partkey || ' for State_' || p_partkey, 'Implementation'), (24, 'function', 'go_' || p_partkey, 'Other'), (27, 'struct', 'View_' || p_partkey, 'ContextAccounts'), (29, 'trait', 'TryFrom<&''a [AccountView]> for View_' || p_partkey || '<''a>', 'Implementation'), (31, 'function', 'process', 'EntryPoint')""", "v.col0 AS start_line, v.col1 AS item, v.col2 AS name, v.col3 AS sub_type"))
def e5_symbol_classify_kinds(spark, d):
    files = kinds_files(spark, d)
    return B.symbol_classify(B.symbol_extract(files), B.source_lines(files)).select("path", "start_line", "item", "name", "sub_type")


@register("e1a_every_kind", kind_rows("""('Module', 2, 6), ('Function', 3, 5), ('ContextAccountsNoValidation', 3, 3), ('Struct', 8, 12), ('ContextAccountsNoValidation', 9, 10), ('ContextAccountsNoValidation', 10, 10), ('ContextAccountsNoValidation', 11, 11), ('Struct', 14, 16), ('Enum', 18, 20), ('Trait', 21, 22),
('TraitImpl', 23, 26), ('Function', 24, 25), ('Struct', 27, 28), ('TraitImpl', 29, 30), ('Function', 31, 32), ('ContextAccountsNoValidation', 31, 31)""", "v.col0 AS kind, v.col1 AS start_line, v.col2 AS end_line"))
def e1a_every_kind(spark, d):
    return B.block_scan(B.source_lines(kinds_files(spark, d))).select("path", "kind", "start_line", "end_line")


@register("e2_block_after_marker", kind_rows("('Enum', 18, 20), ('Trait', 21, 22), ('TraitImpl', 23, 26), ('Function', 24, 25), ('Struct', 27, 28), ('ContextAccountsNoValidation', 31, 31)", "v.col0 AS kind, v.col1 AS start_line, v.col2 AS end_line"))
def e2_block_after_marker(spark, d):
    return B.block_after_marker(B.source_lines(kinds_files(spark, d)), "from here").select("path", "kind", "start_line", "end_line")


@register("e4_symbol_extract_full", """SELECT 'src/h' || s_suppkey || '.rs' AS path, v.col0 AS item, v.col1 AS name, v.col2 AS is_public, v.col3 AS start_line, v.col4 AS end_line FROM supplier, LATERAL (VALUES ('function', 'a_' || s_suppkey, true, 1, 2), ('function', 'b', true, 3, 4), ('function', 'c', false, 5, 6), ('function', 'd', false, 7, 8), ('struct', 'S', true, 9, 11), ('trait', 'T', true, 12, 13), ('trait', 'T for S', false, 14, 15)) AS v""")
def e4_symbol_extract_full(spark, d):
    """Headers that the plain rules do not know: qualified functions, restricted visibility, unsafe implementations."""
    n = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("pub async fn a_"), n, F.lit("(x: u8) {\n}\npub(super) const unsafe fn b(y: u8) {\n}\nunsafe fn c() {\n}\nextern \"C\" fn d() {\n}\npub(crate) struct S {\n    x: u8,\n}\npub unsafe trait T {\n}\nunsafe impl T for S {\n}\nfnord e() {\n}\n"))
    files = view(spark, d, "supplier").select(F.concat(F.lit("src/h"), n, F.lit(".rs")).alias("path"), text.alias("content"))
    return B.symbol_extract(files, B.FULL_RULES).select("path", "item", "name", "is_public", "start_line", "end_line")


@register("e6_entry_rename", with_sql("fx_symbol") + """SELECT symbol_id, kind AS sub_type, CASE WHEN kind = 'EntryPoint' AND symbol_id % 10 = 0 THEN 'm' || (symbol_id % 7) WHEN symbol_id % 10 = 0 THEN 'process' ELSE name END AS name FROM fx_symbol""")
def e6_entry_rename(spark, d):
    s = view(spark, d, "fx_symbol").select("symbol_id", F.when(F.col("symbol_id") % 10 == 0, "process").otherwise(F.col("name")).alias("name"), F.col("kind").alias("sub_type"), "path")
    return B.entry_rename(s).select("symbol_id", "sub_type", "name")


@register("e13_brace_blocks", W + "SELECT path, CAST(11*(k-1)+2 AS INT) AS start_line, CAST(11*(k-1)+10 AS INT) AS end_line FROM fx_layout")
def e13_brace_blocks(spark, d):
    return B.brace_blocks(_lines(spark, d), _functions(spark, d).select("path", "start_line"))


@register("e21_struct_fields", """SELECT path, name, field, type, CAST(ord AS INT) AS ord FROM (
SELECT 'src/p' || p_size || '.rs' AS path, 'S_' || p_partkey AS name, 'size' AS field, 'u' || p_size AS type, 1 AS ord FROM part
UNION ALL SELECT 'src/p' || p_size || '.rs', 'S_' || p_partkey, 'brand', p_brand, 2 FROM part)""")
def e21_struct_fields(spark, d):
    p = view(spark, d, "part").select("p_partkey", "p_size", F.concat(F.lit("pub struct S_"), "p_partkey", F.lit(" {\n    pub size: u"), "p_size", F.lit(",\n    pub brand: "), "p_brand", F.lit(", // kept\n    hidden: u8,\n}\n")).alias("text"))
    files = p.groupBy(F.concat(F.lit("src/p"), "p_size", F.lit(".rs")).alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "text"))), lambda s: s["text"]), "\n").alias("content"))
    s = B.symbol_extract(files)
    return B.struct_fields(s, B.source_lines(files)).join(s.select("symbol_id", "path", "name"), "symbol_id").select("path", "name", "field", "type", "ord")


@register("e22_validations_in_functions", W + """SELECT path, name, origin, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line FROM (
SELECT path, name, 'IfValidation' AS origin, 11*(k-1)+4 AS s, 11*(k-1)+6 AS e FROM fx_layout UNION ALL SELECT path, name, 'Validation', 11*(k-1)+3, 11*(k-1)+3 FROM fx_layout)""")
def e22_validations_in_functions(spark, d):
    s = _functions(spark, d)
    return B.validations_in_functions(_lines(spark, d), s).join(s.select("symbol_id", "path", "name"), "symbol_id").select("path", "name", "origin", "start_line", "end_line")


@register("e24_doc_start", W + "SELECT path, name, CAST(11*(k-1)+2 AS INT) AS start_line, CAST(11*(k-1)+1 AS INT) AS doc_line FROM fx_layout")
def e24_doc_start(spark, d):
    s = _functions(spark, d)
    return B.doc_start(_lines(spark, d), s).join(s.select("symbol_id", "path", "name", "start_line"), "symbol_id").select("path", "name", "start_line", "doc_line")
