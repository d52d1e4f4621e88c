"""Registered queries of the account operators over fx_decl."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom.operators import accounts as A
from srcloom.operators import blocks as B

from .fixtures import VIEWS, view, with_sql

QUERIES, ORACLES = {}, {}


def register(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


#: The pieces that fx_account's attributes are made of, so that the SQL need not read the text.
RAW = f"""fx_line AS ({VIEWS['fx_line']}), raw AS (SELECT l_orderkey AS struct_id, rn AS ord, l_returnflag = 'A' AS i, l_linestatus = 'O' AS m, l_returnflag = 'R' AS c,
CAST(l_suppkey % 5 AS VARCHAR) AS sd, 'auth_' || (l_suppkey % 3) AS auth, 'Err::E' || (l_suppkey % 7) AS err, 'st.load()?.x == k' || (l_partkey % 4) || '.key() @Err::C' AS con FROM fx_line)"""
ITEMS = """items AS (SELECT struct_id, ord, k, v FROM raw, LATERAL (VALUES
(1, CASE WHEN i THEN 'init' END), (2, CASE WHEN i THEN 'payer = payer_1' END), (3, CASE WHEN m THEN 'mut' END), (4, CASE WHEN c THEN 'close = dest_2' END),
(5, 'seeds = [b"s", f(a, ' || sd || ')]'), (6, 'has_one = ' || auth || ' @ ' || err), (7, 'constraint = ' || con)) AS t(k, v) WHERE v IS NOT NULL)"""


def _accounts(spark, d):
    return view(spark, d, "fx_decl")


@register("e14_split_top_level", f"WITH {RAW}, {ITEMS} SELECT struct_id, ord, list(v ORDER BY k) AS items FROM items GROUP BY struct_id, ord")
def e14_split_top_level(spark, d):
    return A.attribute_items(_accounts(spark, d)).select("struct_id", "ord", "items")


@register("e15_account_attrs", f"""WITH {RAW}, {ITEMS} SELECT struct_id, ord, CASE WHEN k IN (1, 3) THEN v ELSE split_part(v, ' = ', 1) END AS key,
CASE k WHEN 2 THEN 'payer_1' WHEN 4 THEN 'dest_2' WHEN 5 THEN substr(v, 9) WHEN 6 THEN split_part(split_part(v, ' = ', 2), ' @ ', 1) WHEN 7 THEN substr(v, 14) END AS value,
CASE WHEN k = 6 THEN split_part(v, ' @ ', 2) END AS error FROM items""")
def e15_account_attrs(spark, d):
    return A.account_attrs(_accounts(spark, d)).select("struct_id", "ord", "key", "value", "error")


@register("e15_account_flags", f"""WITH {RAW} SELECT struct_id, ord, m AS is_mut, i AS is_init, c AS is_close, ['b"s"', 'f(a, ' || sd || ')'] AS seeds,
CASE WHEN i THEN 'payer_1' WHEN c THEN 'dest_2' ELSE '' END AS rent_account, true AS is_pda FROM raw""")
def e15_account_flags(spark, d):
    return A.account_flags(A.account_attrs(_accounts(spark, d))).select("struct_id", "ord", "is_mut", "is_init", "is_close", "seeds", "rent_account", "is_pda")


@register("e16_account_attrs_regex", f"""WITH {RAW} SELECT struct_id, ord, m AS is_mut, i AS is_init, c AS is_close, CASE WHEN i THEN 'payer_1' WHEN c THEN 'dest_2' ELSE '' END AS rent_account,
['b"s"', 'f(a, ' || sd || ')'] AS seeds, ['has_one = ' || auth || ' @ ' || err, 'constraint = ' || con] AS validations FROM raw""")
def e16_account_attrs_regex(spark, d):
    return A.account_attrs_regex(_accounts(spark, d))


@register("e17_account_validations", f"""WITH {RAW} SELECT struct_id, ord, ['has_one = ' || auth || ' @ ' || err, 'constraint = ' || con] AS validations,
CASE WHEN i THEN 'payer_1' WHEN c THEN 'dest_2' ELSE '' END AS rent_account, CAST(NULL AS VARCHAR) AS token_mint FROM raw""")
def e17_account_validations(spark, d):
    return A.account_validations(A.account_attrs(_accounts(spark, d)))


#: Account structs that count as program state, for E19 and what follows from it.
STATE = "SELECT DISTINCT concat('State_', CAST(p_partkey % 20 AS STRING)) AS name, 'SolanaAccount' AS sub_type FROM part WHERE p_partkey % 20 < 12"
TYPE_SQL = """CASE WHEN wrapper = 'Signer' THEN 'Signer' WHEN wrapper = 'UncheckedAccount' THEN 'UncheckedAccount' WHEN struct_name = 'TokenAccount' THEN 'TokenAccount' WHEN struct_name = 'Mint' THEN 'Mint'
WHEN CAST(substr(struct_name, 7) AS INT) < 12 THEN 'ProgramStateAccount' ELSE 'Other' END"""


def typed_accounts(spark, d):
    view(spark, d, "part").createOrReplaceTempView("part")
    return A.account_type(_accounts(spark, d), spark.sql(STATE))


@register("e19_account_type", with_sql("fx_decl") + f"SELECT struct_id, CAST(ord AS INT) AS ord, wrapper, struct_name, {TYPE_SQL} AS account_type FROM fx_decl")
def e19_account_type(spark, d):
    return typed_accounts(spark, d).select("struct_id", "ord", "wrapper", "struct_name", "account_type")


@register("e23_accounts_without_validation", f"WITH {RAW}, {ITEMS} SELECT struct_id, ord, list(v ORDER BY k) AS items FROM items WHERE k NOT IN (6, 7) GROUP BY struct_id, ord")
def e23_accounts_without_validation(spark, d):
    return A.accounts_without_validation(_accounts(spark, d))


def _views(spark, d):
    n = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit("pub struct In_"), n, F.lit(" { }\nimpl<'a> TryFrom<&'a [AccountView]> for In_"), n, F.lit(" {\n  fn try_from(accounts: &'a [AccountView]) -> Result<Self> {\n    SignerAccount::check(payer)?;\n    ProgramAccount::check(state, id)?;\n    MintInterface::check_all(tp, &[mint_a, mint_"), n, F.lit("])?;\n    if !vault.is_writable() { return Err(e); };\n    Ok(x)\n  }\n}\n"))
    return view(spark, d, "supplier").select(F.concat(F.lit("src/v"), n, F.lit(".rs")).alias("path"), body.alias("content"))


@register("e20_inferred_checks", """SELECT 'src/v' || s_suppkey || '.rs' AS path, 'In_' || s_suppkey AS struct_name, field, check_name, semantic FROM supplier, LATERAL (VALUES ('payer', 'SignerAccount::check', 'Signer'), ('state', 'ProgramAccount::check', 'ProgramOwned'),
('tp', 'MintInterface::check_all', 'Mint'), ('mint_a', 'MintInterface::check_all', 'Mint'), ('mint_' || s_suppkey, 'MintInterface::check_all', 'Mint'), ('vault', 'is_writable', 'Writable')) AS t(field, check_name, semantic)""")
def e20_inferred_checks(spark, d):
    return A.inferred_checks(_views(spark, d)).select("path", "struct_name", "field", "check_name", "semantic")


@register("e26_signer_comments", """SELECT s_suppkey AS struct_id, account_name, description FROM supplier, LATERAL (VALUES ('owner_' || s_suppkey, 'Pays for it. Signs as well'), ('other', '')) AS t(account_name, description)""")
def e26_signer_comments(spark, d):
    n = F.col("s_suppkey").cast("string")
    files = view(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("src/s"), n, F.lit(".rs")).alias("path"), F.concat(F.lit("pub struct A {\n    /// Pays for it\n    // Signs as well\n    pub owner_"), n, F.lit(": Signer,\n    pub other: Signer,\n}")).alias("content"))
    lines = B.source_lines(files)
    fields = lines.where(F.contains("line", F.lit(": Signer"))).join(files.select("path", F.col("s_suppkey").alias("struct_id")), "path").select("struct_id", F.regexp_extract("line", r"pub (\w+)", 1).alias("account_name"), "path", "line_no")
    return A.signer_comments(lines, fields)
