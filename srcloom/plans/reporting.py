"""Registered queries of the report rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom.operators import accounts as A
from srcloom.operators import contracts as K
from srcloom.operators import graph as G
from srcloom.operators import reports as Q
from srcloom.operators import review as V
from srcloom.sources import files as S

from .analysing import FULL, STATE, TOKENS, full_accounts
from .contracting import FN, KIND, NAMES, SITES, _functions, _sites
from .fixtures import view, with_sql
from .looking import DOCS, review_docs
from .resolving import FULL as REACH

QUERIES, ORACLES = {}, {}


def register(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


def _entry(spark, d):
    return view(spark, d, "fx_entry")


def numbered(section, order, inner):
    return f"SELECT entry_name, '{section}' AS section, CAST(row_number() OVER (PARTITION BY entry_name ORDER BY {order}) AS INT) AS ord, line FROM ({inner})"


FIELDS = "fields AS (SELECT struct_name, string_agg(field, ', ' ORDER BY field) AS f FROM (SELECT DISTINCT 'State_' || (p_partkey % 20) AS struct_name, 'field_' || (p_partkey % 3) AS field FROM part WHERE p_partkey % 20 <> 5) GROUP BY 1)"
CHANGES = numbered("state_changes", "op, k, line", f"""SELECT e.name AS entry_name, op, k, line FROM fx_entry e JOIN (
SELECT struct_id, op, a.ord AS k, '- ' || ['Initializes', 'Closes', 'Updates'][op + 1] || ' `' || account_name || '`[' || a.struct_name || ']' || CASE WHEN op = 2 AND f IS NOT NULL THEN ' (' || f || ')' ELSE '' END AS line
FROM (SELECT *, CASE WHEN is_init THEN 0 WHEN is_close THEN 1 WHEN is_mut THEN 2 END AS op FROM acc WHERE {STATE}) a LEFT JOIN fields USING (struct_name) WHERE op IS NOT NULL
UNION ALL SELECT struct_id, o, 0, '- ' || w || ' `' || f || '` to `' || coalesce(g, '?') || '`' FROM (SELECT x.struct_id, x.a AS f, y.a AS g FROM t x JOIN t y ON x.struct_id = y.struct_id AND x.ord <> y.ord UNION ALL SELECT struct_id, a, NULL FROM t), (VALUES (3, 'Transfer'), (4, 'Delegate')) v(o, w)
UNION ALL SELECT struct_id, o, 0, '- ' || w || ' `' || f || '` to `' || coalesce(g, '?') || '`' FROM (SELECT m.struct_id, m.a AS f, t.a AS g FROM mint m JOIN t USING (struct_id) UNION ALL SELECT struct_id, a, NULL FROM mint), (VALUES (5, 'Mint'), (6, 'Burn')) v(o, w)) x USING (struct_id)""")


def _changes(spark, d):
    fields = view(spark, d, "part").where("p_partkey % 20 <> 5").select(F.concat(F.lit("State_"), (F.col("p_partkey") % 20).cast("string")).alias("struct_name"), F.concat(F.lit("field_"), (F.col("p_partkey") % 3).cast("string")).alias("field"))
    return Q.report_state_changes(_entry(spark, d), full_accounts(spark, d), fields)


@register("r1_report_state_changes", with_sql("fx_decl", "fx_entry", more=f"{FULL}, {TOKENS}, {FIELDS}") + CHANGES)
def r1_report_state_changes(spark, d):
    return _changes(spark, d)


def _files_of_entries(spark, d):
    """Each entry's file holds its first constraint on line 3 for every other entry."""
    e = _entry(spark, d).withColumn("path", F.concat(F.lit("src/"), "name", F.lit(".rs")))
    lines = e.where("entry_id % 2 = 0").select("path", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("line_no")).withColumn("line", F.when(F.col("line_no") >= 3, "  constraint = st.load()?.x == k1.key() @Err").otherwise("  other"))
    return e, lines


@register("r2_report_constraint_checklist", with_sql("fx_decl", "fx_entry") + numbered("constraints", "o, k", """SELECT e.name AS entry_name, a.ord AS o, k, '- [ ] ' || v || ' src/' || e.name || '.rs#L' || CASE WHEN k = 1 AND contains(v, 'k1.') AND e.entry_id % 2 = 0 THEN 3 ELSE 1 END AS line FROM fx_entry e JOIN fx_decl a USING (struct_id),
LATERAL (VALUES (0, 'has_one' || regexp_extract(attr, 'has_one([^,]*)', 1)), (1, 'constraint' || regexp_extract(attr, 'constraint(.*)$', 1))) AS w(k, v)"""))
def r2_report_constraint_checklist(spark, d):
    e, lines = _files_of_entries(spark, d)
    return Q.report_constraint_checklist(e, A.account_attrs_regex(view(spark, d, "fx_decl")), lines)


@register("r3_report_signers", with_sql("fx_decl", "fx_entry") + numbered("signers", "k", """SELECT e.name AS entry_name, a.ord AS k, coalesce('- ' || account_name || ': ', '- No signers found: permissionless') AS line FROM fx_entry e LEFT JOIN (SELECT * FROM fx_decl WHERE wrapper = 'Signer') a USING (struct_id)"""))
def r3_report_signers(spark, d):
    return Q.report_signers(_entry(spark, d), full_accounts(spark, d))


PARAMS = "params AS (SELECT symbol_id, 1 AS k, 'ctx' AS p, 'Context<A>' AS t FROM fx_symbol UNION ALL SELECT symbol_id, 2, 'amount', 'T' || (symbol_id % 40) FROM fx_symbol)"
DEPTH = "near AS (SELECT root, node FROM reach WHERE node <> root)"


def _walk(spark, d):
    s = view(spark, d, "fx_symbol")
    roots = s.where("kind = 'EntryPoint'").select(F.col("symbol_id").alias("root"))
    return s, G.dependency_closure(view(spark, d, "fx_edge"), roots)


@register("r4_report_parameters", with_sql("fx_symbol", "fx_edge", more=f"{REACH}, {DEPTH}, {PARAMS}") + """SELECT 'ep_' || s.symbol_id AS entry_name, 'parameters' AS section, n.node AS node_id, '- amount: T' || (n.node % 40) || CASE WHEN n.node % 40 < 30 THEN ' = ' || (n.node % 40) ELSE '' END AS line
FROM fx_symbol s JOIN (SELECT root, node FROM near UNION ALL SELECT root, root FROM roots) n ON n.root = s.symbol_id JOIN fx_symbol x ON x.symbol_id = n.node""")
def r4_report_parameters(spark, d):
    s, reach = _walk(spark, d)
    t = (F.col("symbol_id") % 40).cast("string")
    params = s.select("symbol_id", F.lit(1).alias("ord"), F.lit("ctx").alias("param_name"), F.lit("Context<A>").alias("param_type")).unionByName(s.select("symbol_id", F.lit(2).alias("ord"), F.concat(F.lit("amount")).alias("param_name"), F.concat(F.lit("T"), t).alias("param_type")))
    structs = s.where("symbol_id % 40 < 30").select("symbol_id", F.lit("amount").alias("param_name"), (F.col("symbol_id") % 40).alias("struct_id"))
    e = s.where("kind = 'EntryPoint'").select(F.concat(F.lit("ep_"), F.col("symbol_id").cast("string")).alias("name"), F.col("symbol_id").alias("function_id"))
    out = Q.report_parameters(e, reach, params, structs)
    # rows of equal text belong to different functions: their place in the report shows them apart
    nodes = e.select(F.col("name").alias("entry_name"), F.col("function_id").alias("root")).join(reach.where("node <> root").select("root", "node", "depth").unionByName(e.select(F.col("function_id").alias("root"), F.col("function_id").alias("node"), F.lit(0).alias("depth"))), "root").join(s.select(F.col("symbol_id").alias("node")), "node")
    from pyspark.sql import Window

    ranked = nodes.withColumn("ord", F.row_number().over(Window.partitionBy("entry_name").orderBy("depth", "node"))).select("entry_name", "ord", F.col("node").alias("node_id"))
    return out.join(ranked, ["entry_name", "ord"]).select("entry_name", "section", "node_id", "line")


@register("r5_report_accounts", with_sql("fx_decl", "fx_entry") + numbered("accounts", "k", """SELECT e.name AS entry_name, a.ord AS k, '#[account(' || regexp_extract(attr, '^(.*), has_one', 1) || ')] pub ' || account_name || ': ' || struct_name AS line FROM fx_entry e JOIN fx_decl a USING (struct_id)"""))
def r5_report_accounts(spark, d):
    a = view(spark, d, "fx_decl")
    return Q.report_accounts(_entry(spark, d), a, A.accounts_without_validation(a))


@register("r6_report_validations", with_sql("fx_symbol", "fx_edge", "fx_decl", more=f"{REACH}, {DEPTH}") + numbered("validations", "part, k, q, line", """SELECT 'ep_' || r.root AS entry_name, part, k, q, line FROM (
SELECT root, 0 AS part, a.ord AS k, w.q, '- ' || v AS line FROM roots JOIN fx_decl a ON a.struct_id = root, LATERAL (VALUES (0, 'has_one' || regexp_extract(attr, 'has_one([^,]*)', 1)), (1, 'constraint' || regexp_extract(attr, 'constraint(.*)$', 1))) AS w(q, v)
UNION ALL SELECT n.root, 1, n.node, w.q, w.v FROM (SELECT root, node FROM near UNION ALL SELECT root, root FROM roots) n JOIN fx_symbol s ON s.symbol_id = n.node, LATERAL (VALUES (0, s.name || ' — ' || s.path || ':' || s.start_line), (s.start_line + 1, '- require!(amount > ' || (s.symbol_id % 5) || ');')) AS w(q, v)) r"""))
def r6_report_validations(spark, d):
    s, reach = _walk(spark, d)
    found = s.select("symbol_id", (F.col("start_line") + 1).alias("start_line"), F.concat(F.lit("    require!(amount > "), (F.col("symbol_id") % 5).cast("string"), F.lit(");")).alias("line"))
    e = s.where("kind = 'EntryPoint'").select(F.concat(F.lit("ep_"), F.col("symbol_id").cast("string")).alias("name"), F.col("symbol_id").alias("struct_id"), F.col("symbol_id").alias("function_id"))
    return Q.report_validations(e, A.account_attrs_regex(view(spark, d, "fx_decl")), reach, found, s)


@register("r7_report_contract_entry", with_sql("fx_contract", "fx_contract_fn", more=f"{FN}, {NAMES}, {SITES}, ent AS (SELECT contract_id, function_id, contract || '.' || function_id AS entry_name, {KIND} AS kind FROM cf JOIN own USING (contract_id) WHERE visibility IN ('Public', 'External'))") + numbered("contract_entry", "part, line", """SELECT entry_name, 0 AS part, 'access: ' || kind AS line FROM ent
UNION ALL SELECT entry_name, 1, 'uses: ' || callee FROM ent JOIN sites USING (function_id, contract_id) UNION ALL SELECT entry_name, 2, 'state: var_' || (contract_id % 3) FROM ent UNION ALL SELECT entry_name, 3, 'event: Moved' FROM ent"""))
def r7_report_contract_entry(spark, d):
    c = view(spark, d, "fx_contract")
    entries = K.sol_entries(c, _functions(spark, d)).join(c.select("contract_id", F.col("name").alias("c")), "contract_id").withColumn("entry_name", F.concat_ws(".", "c", "function_id"))
    storage = c.select("contract_id", F.concat(F.lit("var_"), (F.col("contract_id") % 3).cast("string")).alias("name"))
    return Q.report_contract_entry(entries, _sites(spark, d).select("function_id", F.col("callee").alias("dep_id")), storage, c.select("contract_id", F.lit("Moved").alias("name")))


@register("r8_report_summary", f"""WITH {DOCS} SELECT entry_name, 'summary' AS section, CAST(ord AS INT) AS ord, line FROM docs, LATERAL (VALUES (1, t), (2, '```rust'), (3, 'let x = 1;'), (4, '```')) AS v(ord, line)""")
def r8_report_summary(spark, d):
    return Q.report_summary(V.markdown_sections(review_docs(spark, d).drop("t")))


@register("s8_report_sink", with_sql("fx_decl", "fx_entry", more=f"{FULL}, {TOKENS}, {FIELDS}, rows AS ({CHANGES})") + "SELECT entry_name AS entry, '# state_changes:' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY ord) AS value FROM rows GROUP BY entry_name")
def s8_report_sink(spark, d):
    return S.documents(_changes(spark, d))
