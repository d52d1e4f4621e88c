"""Registered queries of the call, import and signature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom.operators import blocks as B
from srcloom.operators import calls as C

from .fixtures import view, with_sql

QUERIES, ORACLES = {}, {}


def register(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@register("e7_call_sites", with_sql("fx_layout") + """SELECT path, name, CAST(11*(k-1)+2 AS INT) AS start_line, 'free' AS call_kind, 'fn_' || ((symbol_id*31) % 120) AS callee_name, CAST(NULL AS VARCHAR) AS qualifier FROM fx_layout
UNION ALL SELECT path, name, CAST(11*(k-1)+2 AS INT), 'static', 'fn_' || ((symbol_id*7) % 97), 'Type_' || (symbol_id % 17) FROM fx_layout""")
def e7_call_sites(spark, d):
    lines = B.source_lines(view(spark, d, "fx_source"))
    s = B.symbol_extract(view(spark, d, "fx_source"))
    found = C.call_sites(lines, s, C.noise_table(spark))
    return found.join(s.select(F.col("symbol_id").alias("caller_id"), "path", "name", "start_line"), "caller_id").select("path", "name", "start_line", "call_kind", "callee_name", "qualifier")


@register("e7_call_names", with_sql("fx_layout") + """SELECT DISTINCT path, name, CAST(11*(k-1)+2 AS INT) AS start_line, callee_name FROM (
SELECT *, 'fn_' || ((symbol_id*31) % 120) AS callee_name FROM fx_layout UNION ALL SELECT *, 'fn_' || ((symbol_id*7) % 97) FROM fx_layout)""")
def e7_call_names(spark, d):
    lines = B.source_lines(view(spark, d, "fx_source"))
    s = B.symbol_extract(view(spark, d, "fx_source"))
    found = C.call_names(lines, s, C.noise_table(spark))
    return found.join(s.select(F.col("symbol_id").alias("caller_id"), "path", "name", "start_line"), "caller_id").select("path", "name", "start_line", "callee_name")


FN_KEY = "concat(CAST(contract_id AS STRING), '.', name, '/', CAST(n_params AS STRING), visibility, modifier)"


def contract_bodies(spark, d, functions=None):
    """fx_contract_fn (or these rows of it) with an id and a body that calls a neighbour, a member of another contract and built-ins."""
    f = (view(spark, d, "fx_contract_fn") if functions is None else functions).withColumn("function_id", F.expr(FN_KEY))
    return f.withColumn("body", _text("{ require(ok); f_", (F.col("contract_id") % 9).cast("string"), "(a); C", (F.col("contract_id") / 2).cast("long").cast("string"), ".f_", F.col("n_params").cast("string"), "(b); super.f_", (F.col("n_params") + 1).cast("string"), "(); keccak256(x); items.push(y); }"))


@register("e8_sol_call_sites", with_sql("fx_contract_fn") + f"""SELECT DISTINCT {FN_KEY} AS function_id, callee FROM fx_contract_fn, LATERAL (VALUES ('f_' || (contract_id % 9)), ('f_' || n_params), ('f_' || (n_params+1)),
('C' || (contract_id // 2) || '.f_' || n_params)) AS v(callee)""")
def e8_sol_call_sites(spark, d):
    return C.sol_call_sites(contract_bodies(spark, d))


def _rust_imports(spark, d):
    n = F.col("c_custkey").cast("string")
    return view(spark, d, "customer").select(
        _text("src/i", n, ".rs").alias("path"),
        _text("use crate::m", n, "::{a_", n, ", b as c_", n, ", inner::{d, e::*}};\nuse std::fmt;\nuse super::g_", n, "::*;\npub struct Local_", n, ";\nfn here_", n, "() {\n}\n").alias("content"),
    )


@register("e9_import_scope", """SELECT 'src/i' || c_custkey || '.rs' AS path, short_name, full_path, is_glob FROM customer, LATERAL (VALUES
('a_' || c_custkey, 'crate::m' || c_custkey || '::a_' || c_custkey, false), ('c_' || c_custkey, 'crate::m' || c_custkey || '::b', false), ('d', 'crate::m' || c_custkey || '::inner::d', false),
('*', 'crate::m' || c_custkey || '::inner::e', true), ('fmt', 'std::fmt', false), ('*', 'super::g_' || c_custkey, true), ('Local_' || c_custkey, CAST(NULL AS VARCHAR), NULL), ('here_' || c_custkey, NULL, NULL)) AS v(short_name, full_path, is_glob)""")
def e9_import_scope(spark, d):
    imports, local = C.import_scope(_rust_imports(spark, d))
    return imports.unionByName(local.select("path", F.col("name").alias("short_name"), F.lit(None).cast("string").alias("full_path"), F.lit(None).cast("boolean").alias("is_glob")))


@register("e10_sol_imports", """SELECT 'src/C' || s_suppkey || '.sol' AS path, import_path, symbol, alias, CAST(line AS INT) AS line, '^0.8.' || (s_suppkey % 20) AS pragma FROM supplier, LATERAL (VALUES
('./B' || s_suppkey || '.sol', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 2), ('@lib/T.sol', 'A', CAST(NULL AS VARCHAR), 3), ('@lib/T.sol', 'D', 'E', 3), ('../X.sol', NULL, 'X' || s_suppkey, 4)) AS v(import_path, symbol, alias, line)""")
def e10_sol_imports(spark, d):
    n = F.col("s_suppkey").cast("string")
    files = view(spark, d, "supplier").select(
        _text("src/C", n, ".sol").alias("path"),
        _text("pragma solidity ^0.8.", (F.col("s_suppkey") % 20).cast("string"), ";\nimport \"./B", n, ".sol\";\nimport {A, D as E} from \"@lib/T.sol\";\nimport * as X", n, " from '../X.sol';\ncontract C {}\n").alias("content"),
    )
    return C.sol_imports(files).withColumn("pragma", F.regexp_replace("pragma", "^solidity ", ""))


@register("e12_signature_params", with_sql("fx_layout") + """SELECT path, CAST(11*(k-1)+2 AS INT) AS start_line, CASE WHEN kind = 'EntryPoint' THEN 'pub fn ' ELSE 'fn ' END || name || '(ctx: Context<Acc_' || (symbol_id % 9) || '>, amount: u64)' AS signature,
CAST(ord AS INT) AS ord, param_name, param_type FROM fx_layout, LATERAL (VALUES (1, 'ctx', 'Context<Acc_' || (symbol_id % 9) || '>'), (2, 'amount', 'u64')) AS v(ord, param_name, param_type)""")
def e12_signature_params(spark, d):
    s = B.symbol_extract(view(spark, d, "fx_source"))
    found = C.signature_params(s, B.source_lines(view(spark, d, "fx_source")))
    return found.join(s.select("symbol_id", "path", "start_line"), "symbol_id").select("path", "start_line", "signature", "ord", "param_name", "param_type")


@register("e18_type_parts", with_sql("fx_account") + """SELECT struct_id, CAST(ord AS INT) AS ord, CASE WHEN wrapper = 'Signer' THEN 'Signer' WHEN ord % 3 = 0 THEN 'Context' ELSE wrapper END AS wrapper, CASE WHEN ord % 3 = 0 AND wrapper <> 'Signer' THEN '''a' ELSE '''info' END AS lifetime,
CASE WHEN wrapper = 'Signer' THEN 'Signer' ELSE struct_name END AS inner, wrapper <> 'Signer' AND ord % 2 = 0 AND ord % 3 <> 0 AS is_boxed, CASE WHEN wrapper <> 'Signer' AND ord % 3 = 0 THEN struct_name END AS context_inner FROM fx_account""")
def e18_type_parts(spark, d):
    a = view(spark, d, "fx_account")
    plain = _text(F.col("wrapper"), "<'info, ", F.col("struct_name"), ">")
    kind = F.when(F.col("wrapper") == "Signer", "Signer<'info>").when(F.col("ord") % 3 == 0, _text("Context<'a, ", F.col("struct_name"), ">")).when(F.col("ord") % 2 == 0, _text("Box<", plain, ">")).otherwise(_text("&'info mut ", plain))
    return C.type_parts(a.select("struct_id", "ord", kind.alias("t")), "t").drop("t")
