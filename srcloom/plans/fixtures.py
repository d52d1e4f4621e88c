"""Derived code-corpus views over the driver tables.

Each view is one SQL text that runs unchanged in Spark and DuckDB (fx_source
apart, whose list aggregate differs). `view` gives a DataFrame, `with_sql` the
common table expressions that an oracle needs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "fx_symbol": """
SELECT c_custkey AS symbol_id, concat('fn_', CAST(c_custkey % 97 AS STRING)) AS name,
  CASE WHEN c_custkey % 5 = 0 THEN 'EntryPoint' ELSE 'Other' END AS kind,
  concat('prog_', CAST(c_nationkey AS STRING)) AS program,
  concat('../programs/prog_', CAST(c_nationkey AS STRING), '/src/m', CAST(c_custkey % 7 AS STRING), '.rs') AS path,
  (c_custkey % 50) * 20 + 1 AS start_line, (c_custkey % 50) * 20 + 6 + c_custkey % 10 AS end_line
FROM customer""",
    "fx_impl": """
SELECT s_suppkey AS impl_id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('Trait_', CAST(s_suppkey % 11 AS STRING)) END AS impl_from,
  concat('Type_', CAST(s_suppkey % 13 AS STRING)) AS impl_to,
  CASE WHEN s_suppkey % 4 = 0 THEN 'Definition' ELSE 'Implementation' END AS trait_kind,
  concat('../programs/prog_', CAST(s_nationkey AS STRING), '/src/m', CAST(s_suppkey % 7 AS STRING), '.rs') AS path,
  (s_suppkey % 4) * 250 AS start_line, (s_suppkey % 4) * 250 + 249 AS end_line
FROM supplier""",
    "fx_call": """
SELECT o_orderkey AS call_id, o_custkey AS caller_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'static' ELSE 'method' END AS call_kind,
  concat('fn_', CAST((o_orderkey * 31) % 120 AS STRING)) AS callee_name,
  concat('Type_', CAST(o_orderkey % 17 AS STRING)) AS qualifier
FROM orders""",
    "fx_edge": """
SELECT DISTINCT o_custkey AS src, CASE WHEN o_orderkey % 500 = 0 THEN greatest(o_custkey - 20, 0) ELSE o_custkey - o_custkey % 40 + least(39, o_custkey % 40 + 1 + o_orderkey % 3) END AS dst
FROM orders""",
    "fx_deep_edge": """
SELECT c_custkey AS src, c_custkey + 1 AS dst FROM customer WHERE (c_custkey + 1) % 2000 <> 0
UNION ALL SELECT c_custkey, -1 - CAST(floor(c_custkey / 2000.0) AS BIGINT) FROM customer WHERE c_custkey % 50 = 0""",
    "fx_contract": """
SELECT p_partkey AS contract_id, concat('C', CAST(p_partkey AS STRING)) AS name,
  CASE p_partkey % 4 WHEN 0 THEN 'Interface' WHEN 1 THEN 'Abstract' WHEN 2 THEN 'Contract' ELSE 'Library' END AS contract_type,
  p_size % 5 = 0 AS external FROM part""",
    "fx_base": """
SELECT p_partkey AS contract_id, 1 AS ord, CAST(floor(p_partkey / 2.0) AS BIGINT) AS base_id FROM part WHERE p_partkey > 0
UNION ALL SELECT p_partkey, 2, CAST(floor(p_partkey / 3.0) AS BIGINT) FROM part WHERE p_partkey > 3 AND p_partkey % 2 = 1""",
    "fx_contract_fn": """
SELECT DISTINCT l_partkey AS contract_id, concat('f_', CAST(l_suppkey % 9 AS STRING)) AS name, l_linenumber % 3 AS n_params,
  CASE l_returnflag WHEN 'A' THEN 'External' WHEN 'R' THEN 'Public' ELSE 'Internal' END AS visibility,
  CASE l_suppkey % 4 WHEN 0 THEN 'onlyOwner' WHEN 1 THEN 'onlyRole' WHEN 2 THEN 'onlyKeeper' ELSE 'nonReentrant' END AS modifier
FROM lineitem""",
    "fx_entry": """
SELECT o_orderkey AS entry_id, concat('ep_', CAST(o_orderkey AS STRING)) AS name, o_orderkey AS struct_id,
  concat('prog_', CAST(o_custkey % 25 AS STRING)) AS program FROM orders""",
    "fx_account": """
SELECT l_orderkey AS struct_id, l_linenumber AS ord, concat('acc_', CAST(l_linenumber AS STRING)) AS account_name,
  CASE l_suppkey % 4 WHEN 0 THEN 'Signer' WHEN 1 THEN 'Account' WHEN 2 THEN 'UncheckedAccount' ELSE 'InterfaceAccount' END AS wrapper,
  CASE l_partkey % 6 WHEN 0 THEN 'TokenAccount' WHEN 1 THEN 'Mint' ELSE concat('State_', CAST(l_partkey % 20 AS STRING)) END AS struct_name,
  concat(CASE WHEN l_returnflag = 'A' THEN 'init, payer = payer_1, ' ELSE '' END, CASE WHEN l_linestatus = 'O' THEN 'mut, ' ELSE '' END,
    CASE WHEN l_returnflag = 'R' THEN 'close = dest_2, ' ELSE '' END, 'seeds = [b"s", f(a, ', CAST(l_suppkey % 5 AS STRING), ')], has_one = auth_', CAST(l_suppkey % 3 AS STRING),
    ' @ Err::E', CAST(l_suppkey % 7 AS STRING), ', constraint = st.load()?.x == k', CAST(l_partkey % 4 AS STRING), '.key() @Err::C') AS attr
FROM lineitem""",
    "fx_line": """
SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_returnflag, l_linestatus) AS INT) AS rn FROM lineitem""",
    "fx_block": """
SELECT symbol_id, name, path, start_line, concat('/// doc of ', name, '\n', CASE WHEN kind = 'EntryPoint' THEN 'pub fn ' ELSE 'fn ' END, name,
  '(ctx: Context<Acc_', CAST(symbol_id % 9 AS STRING), '>, amount: u64) -> Result<()> {\n    require!(amount > ', CAST(symbol_id % 5 AS STRING),
  ');\n    if amount == 0 {\n        assert!(flag);\n    }\n    fn_', CAST((symbol_id * 31) % 120 AS STRING), '(amount)?;\n    Type_', CAST(symbol_id % 17 AS STRING), '::fn_', CAST((symbol_id * 7) % 97 AS STRING), '(amount)?; // call\n    Ok(())\n}') AS block FROM fx_symbol""",
    "fx_source": """
SELECT path, listagg(block, '\n\n') WITHIN GROUP (ORDER BY start_line, symbol_id) AS content FROM fx_block GROUP BY path""",
}

#: fx_account with an ord that is unique in its struct, as an account list has it (l_linenumber repeats).
VIEWS["fx_decl"] = VIEWS["fx_account"].replace("l_linenumber AS ord", "rn AS ord").replace("CAST(l_linenumber AS STRING)", "CAST(rn AS STRING)").replace("FROM lineitem", "FROM fx_line")

#: Where in fx_source each symbol's block lies, from its layout: k blocks of 11 lines.
LAYOUT = """
SELECT symbol_id, name, kind, program, path, row_number() OVER (PARTITION BY path ORDER BY start_line, symbol_id) AS k FROM fx_symbol"""

DUCK = {"fx_source": "\nSELECT path, string_agg(block, '\n\n' ORDER BY start_line, symbol_id) AS content FROM fx_block GROUP BY path", "fx_layout": LAYOUT}


def _needs(sql: str) -> list[str]:
    return [x for x in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+(\w+)", sql)) if x in VIEWS or x in TABLES]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or derived view as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    for needed in _needs(sql):
        view(spark, sf_dir, needed).createOrReplaceTempView(needed)
    return spark.sql(sql)


#: Derived files of one task.
FILES_OF_TASK = 16_384


def spread(files: DataFrame) -> DataFrame:
    """Derived files dealt over tasks: the table that they are made from is one small file, which few tasks read.

    The number of tasks grows with the files and is given, as Spark joins shuffled partitions by their
    compressed size, far below that of the lines which these texts become.
    """
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, files.count() // FILES_OF_TASK + 1)
    return files.repartition(tasks, "path")


def with_sql(*names: str, more: str = "") -> str:
    """WITH clause that defines views (and what they need) for DuckDB; more: further expressions, comma-separated."""
    seen: dict[str, str] = {}

    def add(name: str) -> None:
        sql = DUCK.get(name) or VIEWS[name]
        for needed in _needs(sql):
            if needed in VIEWS and needed not in seen:
                add(needed)
        seen.setdefault(name, sql)

    for n in names:
        add(n)
    parts = [f"{n} AS ({s})" for n, s in seen.items()] + ([more] if more else [])
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
