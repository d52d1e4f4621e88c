"""Registered queries of the contract operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom.operators import calls as C
from srcloom.operators import contracts as K
from srcloom.operators import graph as G

from srcloom.sources.shared import compact

from .calling import FN_KEY, contract_bodies
from .fixtures import spread, view, with_sql
from .resolving import PATHS

QUERIES, ORACLES = {}, {}


def register(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


FN = f"cf AS (SELECT *, {FN_KEY} AS function_id FROM fx_contract_fn)"
KIND = "CASE modifier WHEN 'onlyOwner' THEN 'OnlyOwner' WHEN 'onlyRole' THEN 'RoleBased' WHEN 'onlyKeeper' THEN 'CustomModifier' ELSE 'None' END"


def _functions(spark, d, functions=None):
    f = contract_bodies(spark, d, functions)
    return f.withColumns({"modifiers": F.array("modifier"), "types": F.array_join(F.array_repeat(F.lit("uint256"), F.col("n_params")), ",")})


@register("e27_access_control", with_sql("fx_contract_fn", more=FN) + f"SELECT function_id, {KIND} AS kind, CASE modifier WHEN 'onlyRole' THEN 'DEFAULT_ADMIN_ROLE' WHEN 'onlyKeeper' THEN 'onlyKeeper' END AS arg FROM cf")
def e27_access_control(spark, d):
    return K.access_control(_functions(spark, d))


NAMES = """own AS (SELECT contract_id, name AS contract FROM fx_contract WHERE NOT external AND contract_type NOT IN ('Interface', 'Library')),
types(n_params, types) AS (VALUES (0, ''), (1, 'uint256'), (2, 'uint256,uint256'))"""


@register("a9_overload_names", with_sql("fx_contract", "fx_contract_fn", more=f"{FN}, {NAMES}") + """SELECT function_id, CASE WHEN count(*) OVER (PARTITION BY cf.contract_id, cf.name) > 1 THEN c.name || '.' || cf.name || '(' || types || ')' ELSE c.name || '.' || cf.name END AS entry_name
FROM cf JOIN fx_contract c ON c.contract_id = cf.contract_id JOIN types USING (n_params)""")
def a9_overload_names(spark, d):
    return K.overload_names(_functions(spark, d).join(view(spark, d, "fx_contract").select("contract_id", F.col("name").alias("contract")), "contract_id"))


@register("a10_sol_entries", with_sql("fx_contract", "fx_contract_fn", more=f"{FN}, {NAMES}") + f"""SELECT contract_id, function_id, CASE WHEN count(*) OVER (PARTITION BY contract_id, name) > 1 THEN contract || '.' || name || '(' || types || ')' ELSE contract || '.' || name END AS entry_name,
visibility, [{KIND}] AS access_control FROM cf JOIN own USING (contract_id) JOIN types USING (n_params) WHERE visibility IN ('Public', 'External')""")
def a10_sol_entries(spark, d):
    return K.sol_entries(view(spark, d, "fx_contract"), _functions(spark, d))


SITES = "sites AS (SELECT DISTINCT function_id, contract_id, callee FROM cf, LATERAL (VALUES ('f_' || (contract_id % 9)), ('f_' || n_params), ('f_' || (n_params+1)), ('C' || (contract_id // 2) || '.f_' || n_params)) AS v(callee))"


def sites_of(f):
    """Call sites with the contract of their function."""
    return C.sol_call_sites(f.withColumn("both", F.struct("function_id", "contract_id")), "both").select("both.function_id", "both.contract_id", "callee")


def _sites(spark, d):
    return sites_of(_functions(spark, d))


@register("j13_sol_resolve_calls", with_sql("fx_contract", "fx_contract_fn", "fx_base", more=f"{FN}, {SITES}") + """SELECT function_id, c.contract_id AS callee_contract, split_part(callee, '.', 2) AS method, true AS is_external, false AS is_super FROM sites JOIN fx_contract c ON c.name = split_part(callee, '.', 1) WHERE contains(callee, '.')
UNION ALL SELECT function_id, arg_min(t, rank) AS callee_contract, callee, false, false FROM (SELECT function_id, callee, contract_id AS t, 0 AS rank FROM sites WHERE NOT contains(callee, '.') UNION ALL SELECT function_id, callee, base_id, ord FROM sites JOIN fx_base USING (contract_id) WHERE NOT contains(callee, '.')) x
WHERE EXISTS (SELECT 1 FROM fx_contract_fn f WHERE f.contract_id = x.t AND f.name = x.callee) GROUP BY function_id, callee""")
def j13_sol_resolve_calls(spark, d):
    return K.sol_resolve_calls(_sites(spark, d), view(spark, d, "fx_contract_fn"), view(spark, d, "fx_base"), view(spark, d, "fx_contract"))


CHAIN = """chain AS (SELECT c AS contract_id, CAST(row_number() OVER (PARTITION BY c ORDER BY len(path), path) AS INT) AS position, a AS ancestor_id FROM (
SELECT c, a, arg_min(opath, (len(opath), opath)) AS path FROM up GROUP BY c, a UNION ALL SELECT contract_id, contract_id, CAST([] AS INT[]) FROM fx_contract)),
cm AS (SELECT contract_id, name FROM fx_contract, LATERAL (VALUES (0, 'onlyOwner'), (1, 'onlyRole'), (2, 'onlyKeeper'), (3, 'nonReentrant')) AS v(i, name) WHERE (contract_id + i) % 5 = 0)"""


@register("j14_sol_direct_deps", with_sql("fx_contract", "fx_contract_fn", "fx_base", more=f"{FN}, {SITES}, {PATHS}, {CHAIN}".replace("name FROM fx_contract, LATERAL (VALUES (0", "v.name FROM fx_contract, LATERAL (VALUES (0")) + """SELECT function_id, 'modifier|' || arg_min(ancestor_id, position) || '|' || modifier AS dep_id, 'modifier' AS dep_kind FROM cf JOIN chain USING (contract_id) JOIN cm ON cm.contract_id = ancestor_id AND cm.name = modifier GROUP BY function_id, modifier
UNION ALL SELECT s.function_id, arg_min(f.function_id, (position, f.function_id)), 'function' FROM sites s JOIN chain USING (contract_id) JOIN cf f ON f.contract_id = ancestor_id AND f.name = s.callee WHERE f.function_id <> s.function_id GROUP BY s.function_id, s.callee""")
def j14_sol_direct_deps(spark, d):
    c = view(spark, d, "fx_contract")
    mods = c.select("contract_id", F.posexplode(F.array(*[F.lit(m) for m in ("onlyOwner", "onlyRole", "onlyKeeper", "nonReentrant")])).alias("i", "name")).where("(contract_id + i) % 5 = 0").drop("i")
    # functions are told apart once; their ids and bodies, which are far larger, are put together where they are read
    f = _functions(spark, d, compact(view(spark, d, "fx_contract_fn")))
    return K.sol_direct_deps(sites_of(f), f, mods, view(spark, d, "fx_base"))


@register("j19_interface_impls", with_sql("fx_contract", "fx_contract_fn", "fx_base") + """SELECT i.name AS interface, coalesce((SELECT list(DISTINCT c.name ORDER BY c.name) FROM fx_base b JOIN fx_contract c USING (contract_id) WHERE b.base_id = i.contract_id), []) AS implemented_by,
coalesce((SELECT list(DISTINCT f.name ORDER BY f.name) FROM fx_contract_fn f WHERE f.contract_id = i.contract_id), []) AS functions FROM fx_contract i WHERE contract_type = 'Interface'""")
def j19_interface_impls(spark, d):
    return K.interface_impls(view(spark, d, "fx_contract"), view(spark, d, "fx_base"), view(spark, d, "fx_contract_fn"))


def contract_files(spark, d):
    """A file for each part: an interface, and a contract with state, an event, a modifier and three functions."""
    n = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("pragma solidity ^0.8.0;\n/* a { comment */\ninterface I"), n, F.lit(" {\n    function ping(uint256 a) external;\n}\nabstract contract C"), n, F.lit(" is I"), n, F.lit(", Base(1) {\n    uint256 public total; // kept\n    mapping(address => uint256) private balances;\n    address constant OWNER = address(0);\n    event Moved(address who);\n    modifier onlyKeeper() {\n        require(ok);\n        _;\n    }\n    constructor(address a) {\n        total = 1;\n    }\n    function f_"),
        n, F.lit("(uint256 a, bytes memory b) external payable onlyKeeper returns (uint256) {\n        if (a > 0) { total = a; }\n        return a;\n    }\n    function g() view internal {}\n}\n"),
    )
    return spread(view(spark, d, "part").select(F.concat(F.when(F.col("p_partkey") % 5 == 0, "src/lib/").otherwise("src/"), F.lit("C"), n, F.lit(".sol")).alias("path"), text.alias("content")))


SRC = "SELECT (CASE WHEN p_partkey % 5 = 0 THEN 'src/lib/' ELSE 'src/' END) || 'C' || p_partkey || '.sol' AS path, CAST(p_partkey AS VARCHAR) AS n FROM part"


@register("e11_contracts", f"SELECT path, 'I' || n AS contract, 'Interface' AS contract_type, CAST([] AS VARCHAR[]) AS bases, contains(path, '/lib/') AS external FROM ({SRC}) UNION ALL SELECT path, 'C' || n, 'Abstract', ['I' || n, 'Base'], contains(path, '/lib/') FROM ({SRC})")
def e11_contracts(spark, d):
    return K.contract_extract(contract_files(spark, d))["contract"].drop("start_line", "end_line")


@register("e11_contract_functions", f"""SELECT path, contract, name, function_id, visibility, mutability, modifiers FROM (SELECT path, 'I' || n AS contract, 'ping' AS name, path || '|I' || n || '|ping(uint256)' AS function_id, 'External' AS visibility, 'NonPayable' AS mutability, CAST([] AS VARCHAR[]) AS modifiers FROM ({SRC})
UNION ALL SELECT path, 'C' || n, 'constructor', path || '|C' || n || '|constructor(address)', 'Internal', 'NonPayable', [] FROM ({SRC}) UNION ALL SELECT path, 'C' || n, 'f_' || n, path || '|C' || n || '|f_' || n || '(uint256,bytes)', 'External', 'Payable', ['onlyKeeper'] FROM ({SRC})
UNION ALL SELECT path, 'C' || n, 'g', path || '|C' || n || '|g()', 'Internal', 'View', [] FROM ({SRC}))""")
def e11_contract_functions(spark, d):
    return K.contract_extract(contract_files(spark, d))["contract_function"].select("path", "contract", "name", "function_id", "visibility", "mutability", "modifiers")


@register("e11_contract_members", f"""SELECT path, 'C' || n AS contract, kind, name, type_name FROM ({SRC}), LATERAL (VALUES ('modifier', 'onlyKeeper', CAST(NULL AS VARCHAR)), ('event', 'Moved', NULL), ('storage', 'total', 'uint256'), ('storage', 'balances', 'mapping(address => uint256)'), ('storage', 'OWNER', 'address')) AS v(kind, name, type_name)""")
def e11_contract_members(spark, d):
    t = K.contract_extract(contract_files(spark, d))
    plain = lambda k, n: t[n].select("path", "contract", F.lit(k).alias("kind"), "name", F.lit(None).cast("string").alias("type_name"))
    return plain("modifier", "contract_modifier").unionByName(plain("event", "event_def")).unionByName(t["storage_var"].select("path", "contract", F.lit("storage").alias("kind"), "name", "type_name"))
