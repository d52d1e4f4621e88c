"""Registered queries of the roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom.operators import accounts as A
from srcloom.operators import analytics as N
from srcloom.operators import resolve as R

from .accounting import TYPE_SQL, typed_accounts
from .fixtures import view, with_sql

QUERIES, ORACLES = {}, {}


def register(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


def full_accounts(spark, d):
    """fx_decl with type and flags."""
    flags = A.account_attrs_regex(view(spark, d, "fx_decl")).select("struct_id", "ord", "is_mut", "is_init", "is_close", "validations")
    return typed_accounts(spark, d).join(flags, ["struct_id", "ord"])


def _entry(spark, d):
    return view(spark, d, "fx_entry")


FULL = f"""acc AS (SELECT struct_id, ord, account_name, struct_name, {TYPE_SQL} AS account_type, contains(attr, 'mut, ') AS is_mut, starts_with(attr, 'init, ') AS is_init, contains(attr, 'close = ') AS is_close,
'constraint = st.x == k' || regexp_extract(attr, '== k([0-9])', 1) AS con FROM fx_decl)"""
W = with_sql("fx_decl", "fx_entry", more=FULL)
STATE = "account_type = 'ProgramStateAccount'"


@register("a1_constraint_index", W + """SELECT con AS constraint, name AS entry, count(*) AS n FROM acc JOIN fx_entry USING (struct_id) GROUP BY con, name""")
def a1_constraint_index(spark, d):
    return N.constraint_index(_entry(spark, d), A.account_attrs_regex(view(spark, d, "fx_decl")))


@register("a2_constraint_status", W + """SELECT count(*) AS n_total, count(*) FILTER (WHERE k % 2 = 0 AND k < 3) AS n_invariant, count(*) FILTER (WHERE k % 2 = 1 AND k < 3) AS n_non_invariant, count(*) FILTER (WHERE k >= 3) AS n_to_review
FROM (SELECT DISTINCT CAST(right(con, 1) AS INT) AS k FROM acc JOIN fx_entry USING (struct_id))""")
def a2_constraint_status(spark, d):
    index = N.constraint_index(_entry(spark, d), A.account_attrs_regex(view(spark, d, "fx_decl")))
    k = F.regexp_extract("constraint", "k([0-9])$", 1).cast("int")
    return N.constraint_status(index, index.select("constraint").distinct().select("constraint", (k % 2 == 0).alias("invariant"), (k < 3).alias("reviewed")))


LIFE = "life AS (SELECT struct_id, " + ", ".join(f"coalesce(list(account_name ORDER BY ord) FILTER (WHERE {c} AND {'' if w == 'program' else 'NOT '}{STATE}), []) AS {b}_{w}" for b, c in (("init", "is_init"), ("close", "is_close AND NOT is_init"), ("mut", "is_mut AND NOT is_init AND NOT is_close")) for w in ("program", "other")).replace("NOT account_type =", "account_type <>") + f", coalesce(list(struct_name ORDER BY ord) FILTER (WHERE {STATE}), []) AS program_accounts FROM acc GROUP BY struct_id)"
WL = with_sql("fx_decl", "fx_entry", more=f"{FULL}, {LIFE}")


@register("a3_entry_flow", WL + """SELECT p AS priority, struct_id, name AS entry_name, program_accounts, init_program AS init_accounts, mut_program AS mut_accounts, close_program AS close_accounts FROM (
SELECT *, row_number() OVER (ORDER BY len(init_program) = 0, len(program_accounts), struct_id) - 1 AS p FROM life WHERE len(program_accounts) > 0) JOIN fx_entry USING (struct_id)""")
def a3_entry_flow(spark, d):
    return N.entry_flow(_entry(spark, d), full_accounts(spark, d))


@register("a4_account_lifecycle", WL + "SELECT * FROM life")
def a4_account_lifecycle(spark, d):
    return N.account_lifecycle(full_accounts(spark, d))


OPS = f"""ops AS (SELECT DISTINCT struct_name, op, name AS entry FROM acc JOIN fx_entry USING (struct_id), LATERAL (VALUES ('init', is_init), ('mut', is_mut AND NOT is_close), ('close', is_close)) AS v(op, has) WHERE has AND {STATE}),
fields AS (SELECT DISTINCT 'State_' || (p_partkey % 20) AS struct_name, 'field_' || (p_partkey % 3) AS field FROM part)"""
WO = with_sql("fx_decl", "fx_entry", more=f"{FULL}, {OPS}")


@register("j16_account_entries", WO + "SELECT struct_name, op, entry FROM ops")
def j16_account_entries(spark, d):
    return N.account_entries(_entry(spark, d), full_accounts(spark, d))


def _matrix(spark, d):
    fields = view(spark, d, "part").select(F.concat(F.lit("State_"), (F.col("p_partkey") % 20).cast("string")).alias("struct_name"), F.concat(F.lit("field_"), (F.col("p_partkey") % 3).cast("string")).alias("field")).distinct()
    return N.account_field_matrix(N.account_entries(_entry(spark, d), full_accounts(spark, d)), fields)


@register("a6_account_field_matrix", WO + "SELECT struct_name, entry, op, field FROM ops JOIN fields USING (struct_name) WHERE op IN ('init', 'mut')")
def a6_account_field_matrix(spark, d):
    return _matrix(spark, d)


VALUES = "length(entry) % 2 = 0"


@register("a5_state_changes", with_sql("fx_decl", "fx_entry", more=f"{FULL}, {OPS}, m AS (SELECT struct_name, entry, op, field, CASE WHEN {VALUES} THEN entry || '.' || field END AS value FROM ops JOIN fields USING (struct_name) WHERE op IN ('init', 'mut') AND NOT (op = 'init' AND field = 'field_2'))") + """SELECT struct_name, field, entry, op, coalesce(value, '') AS value,
op = 'mut' AND NOT EXISTS (SELECT 1 FROM m i WHERE i.op = 'init' AND i.struct_name = m.struct_name AND i.field = m.field) AS orphan FROM m WHERE op = 'init' OR value IS NOT NULL""")
def a5_state_changes(spark, d):
    m = _matrix(spark, d).where("not (op = 'init' and field = 'field_2')")
    return N.state_changes(m, m.where(VALUES).withColumn("value", F.concat_ws(".", "entry", "field")))


TOKENS = "t AS (SELECT struct_id, ord, account_name AS a FROM acc WHERE is_mut AND account_type = 'TokenAccount'), mint AS (SELECT struct_id, account_name AS a FROM acc WHERE is_mut AND account_type = 'Mint')"


@register("j17_token_flow_pairs", with_sql("fx_decl", more=f"{FULL}, {TOKENS}") + """SELECT struct_id, op, f AS from_account, g AS to_account FROM (SELECT x.struct_id, x.a AS f, y.a AS g FROM t x JOIN t y ON x.struct_id = y.struct_id AND x.ord <> y.ord UNION ALL SELECT struct_id, a, NULL FROM t), (VALUES ('transfer'), ('delegate')) v(op)
UNION ALL SELECT struct_id, op, f, g FROM (SELECT m.struct_id, m.a AS f, t.a AS g FROM mint m JOIN t USING (struct_id) UNION ALL SELECT struct_id, a, NULL FROM mint), (VALUES ('mint'), ('burn')) v(op)""")
def j17_token_flow_pairs(spark, d):
    return N.token_flow_pairs(full_accounts(spark, d))


@register("j6_entry_accounts", with_sql("fx_decl", "fx_entry") + "SELECT entry_id, ord, account_name FROM fx_entry JOIN fx_decl USING (struct_id) UNION ALL SELECT entry_id, NULL, NULL FROM fx_entry e WHERE NOT EXISTS (SELECT 1 FROM fx_decl a WHERE a.struct_id = e.struct_id)")
def j6_entry_accounts(spark, d):
    found, missing = R.entry_accounts(_entry(spark, d), view(spark, d, "fx_decl"))
    return found.select("entry_id", "ord", "account_name").unionByName(missing.select("entry_id", F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("account_name")))


#: A struct of each part: names below State_10 are of one part at most, the others of many, State_9 of none.
STRUCT_NAME = "CASE WHEN p_partkey < 20 THEN 'State_' || p_partkey WHEN p_partkey % 2 = 0 THEN 'State_1' || (p_partkey % 10) ELSE 'Part_' || p_partkey END"
STRUCTS = f"structs AS (SELECT name, count(*) AS n, min(p_partkey) AS id FROM (SELECT p_partkey, {STRUCT_NAME} AS name FROM part) WHERE name <> 'State_9' GROUP BY name)"


@register("j20_account_struct_source", with_sql("fx_decl", "fx_entry", more=f"{FULL}, {STRUCTS}") + f"""SELECT entry_id, account_name, CASE WHEN is_init THEN 'init' ELSE 'mut' END AS op, CASE WHEN n = 1 THEN id END AS struct_symbol_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' END AS reason
FROM fx_entry JOIN acc USING (struct_id) LEFT JOIN structs ON structs.name = struct_name WHERE {STATE} AND (is_init OR is_mut)""")
def j20_account_struct_source(spark, d):
    structs = view(spark, d, "part").select(F.expr(STRUCT_NAME).alias("name"), F.col("p_partkey").alias("symbol_id"), F.lit("struct").alias("item")).where("name <> 'State_9'")
    good, bad = R.account_struct_source(_entry(spark, d), full_accounts(spark, d), structs)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.withColumn("struct_symbol_id", F.lit(None).cast("long")))


@register("a7_status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM orders WHERE o_orderstatus <> 'P'")
def a7_status_counts(spark, d):
    return N.status_counts(view(spark, d, "orders").select(F.col("o_orderstatus").alias("status")), "P")


@register("a8_corpus_counts", with_sql("fx_symbol", "fx_contract", "fx_call", "fx_contract_fn") + """SELECT 'symbol:' || kind AS metric, count(*) AS n FROM fx_symbol GROUP BY 1 UNION ALL SELECT CASE WHEN external THEN 'contract:lib' ELSE 'contract:src' END, count(*) FROM fx_contract GROUP BY 1 UNION ALL SELECT 'calls', count(*) FROM fx_call
UNION ALL SELECT 'functions', count(*) FROM fx_contract_fn UNION ALL SELECT 'modifiers', count(*) FROM (SELECT DISTINCT contract_id, modifier FROM fx_contract_fn) UNION ALL SELECT 'parse_errors', count(*) FROM events WHERE event_type = 'error'""")
def a8_corpus_counts(spark, d):
    f = view(spark, d, "fx_contract_fn")
    errors = view(spark, d, "events").where("event_type = 'error'")
    return N.corpus_counts(view(spark, d, "fx_symbol"), view(spark, d, "fx_contract"), view(spark, d, "fx_call"), f, f.select("contract_id", "modifier").distinct(), errors)


@register("a12_distinct_programs", with_sql("fx_symbol") + "SELECT DISTINCT program FROM fx_symbol")
def a12_distinct_programs(spark, d):
    return N.distinct_programs(view(spark, d, "fx_symbol"))


@register("a13_group_by_file", with_sql("fx_symbol") + "SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY start_line, symbol_id) AS INT) AS ord, start_line, symbol_id, name FROM fx_symbol")
def a13_group_by_file(spark, d):
    return N.group_by_file(view(spark, d, "fx_symbol"))


@register("a14_first_occurrence", with_sql("fx_call") + "SELECT caller_id, callee_name, min(call_id) AS call_id, arg_min(call_kind, call_id) AS call_kind, arg_min(qualifier, call_id) AS qualifier FROM fx_call GROUP BY caller_id, callee_name")
def a14_first_occurrence(spark, d):
    return N.first_occurrence(view(spark, d, "fx_call"), ["caller_id", "callee_name"], ["call_id"])


@register("a14_sorted_unique", with_sql("fx_call") + "SELECT caller_id, list(DISTINCT callee_name ORDER BY callee_name) AS callee_name FROM fx_call GROUP BY caller_id")
def a14_sorted_unique(spark, d):
    return N.sorted_unique(view(spark, d, "fx_call"), ["caller_id"], "callee_name")

