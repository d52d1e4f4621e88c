"""Registered queries of the resolution joins and graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom.operators import blocks as B
from srcloom.operators import calls as C
from srcloom.operators import graph as G
from srcloom.operators import resolve as R
from srcloom.operators.containment import by_key
from srcloom.operators.reports import entry_dependency_list
from srcloom.sources.shared import durable

from .fixtures import spread, view, with_sql

QUERIES, ORACLES = {}, {}


def register(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


def _symbol(spark, d):
    return view(spark, d, "fx_symbol")


def _impl(spark, d):
    return view(spark, d, "fx_impl")


MEMBER = "member AS (SELECT i.impl_id, s.symbol_id, i.impl_to || '::' || s.name AS signature, i.impl_to FROM fx_impl i JOIN fx_symbol s ON s.path = i.path AND s.start_line > i.start_line AND s.end_line < i.end_line)"


@register("j1_impl_members", with_sql("fx_symbol", "fx_impl", more=MEMBER) + "SELECT impl_id, symbol_id, signature FROM member")
def j1_impl_members(spark, d):
    return R.impl_members(_impl(spark, d), _symbol(spark, d))


@register("j2_external_trait", with_sql("fx_impl") + """SELECT impl_id, trait_kind <> 'Definition' AND impl_from <> '' AND NOT EXISTS (SELECT 1 FROM fx_impl x WHERE x.trait_kind = 'Definition'
AND CASE WHEN x.impl_from = '' THEN x.impl_to ELSE x.impl_from END = i.impl_from) AS external_trait FROM fx_impl i""")
def j2_external_trait(spark, d):
    return R.external_trait(_impl(spark, d))


@register("j3_impl_from_to", with_sql("fx_impl") + "SELECT impl_id, impl_from, impl_to FROM fx_impl")
def j3_impl_from_to(spark, d):
    named = _impl(spark, d).select("impl_id", F.when(F.col("impl_from") == "", F.col("impl_to")).otherwise(F.concat("impl_from", F.lit(" for "), "impl_to")).alias("name"))
    return R.impl_from_to(named).select("impl_id", "impl_from", "impl_to")


def _imports(spark, d):
    k = F.col("k").cast("string")
    names = _symbol(spark, d).select("path").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39))))
    full = F.when(F.col("k") % 2 == 0, F.concat(F.lit("crate::src::m"), (F.col("k") % 7).cast("string"), F.lit("::fn_"), k)).otherwise(F.concat(F.lit("self::fn_"), k))
    return names.select("path", F.concat(F.lit("fn_"), k).alias("name"), full.alias("full_path"), F.lit(0).alias("rank"))


FREE = """n AS (SELECT name, count(*) AS n, min(symbol_id) AS only_id FROM fx_symbol GROUP BY name),
free AS (SELECT c.call_id, c.caller_id, c.callee_name, n.n, CASE WHEN n.n = 1 THEN only_id ELSE (SELECT min(s.symbol_id) FROM fx_symbol s WHERE s.name = c.callee_name AND CAST(substr(c.callee_name, 4) AS INT) < 40
  AND CASE WHEN CAST(substr(c.callee_name, 4) AS INT) % 2 = 1 THEN s.path = p.path ELSE contains(s.path, 'src/m' || (CAST(substr(c.callee_name, 4) AS INT) % 7)) END) END AS callee_id
  FROM fx_call c LEFT JOIN n ON n.name = c.callee_name LEFT JOIN fx_symbol p ON p.symbol_id = c.caller_id WHERE call_kind = 'free')"""
FREE_ROWS = """SELECT caller_id, callee_name, callee_id, CASE WHEN callee_id IS NOT NULL THEN 'internal' WHEN n IS NULL THEN 'external' ELSE 'unresolved' END AS resolution,
CASE WHEN n IS NULL THEN 'no such name' WHEN n = 1 THEN 'only one' WHEN callee_id IS NOT NULL THEN 'import' ELSE 'ambiguous' END AS rule FROM free"""


def free_calls(spark, d):
    return R.resolve_free_call(view(spark, d, "fx_call"), _symbol(spark, d), _imports(spark, d), _symbol(spark, d).select(F.col("symbol_id").alias("caller_id"), "path"))


@register("j7_resolve_free_call", with_sql("fx_symbol", "fx_call", more=FREE) + FREE_ROWS)
def j7_resolve_free_call(spark, d):
    return free_calls(spark, d)


def _static_calls(spark, d):
    """fx_call, of which some have a folder or a file of the corpus as qualifier."""
    q = F.when(F.col("call_id") % 5 == 0, F.concat(F.lit("prog_"), (F.col("call_id") % 25).cast("string"))).when(F.col("call_id") % 5 == 1, F.concat(F.lit("m"), (F.col("call_id") % 7).cast("string"))).otherwise(F.col("qualifier"))
    return view(spark, d, "fx_call").withColumn("qualifier", q)


STATIC = MEMBER + """, first_member AS (SELECT signature, arg_min(symbol_id, (impl_id, symbol_id)) AS member_id FROM member GROUP BY signature),
sc AS (SELECT call_id, caller_id, callee_name, CASE call_id % 5 WHEN 0 THEN 'prog_' || (call_id % 25) WHEN 1 THEN 'm' || (call_id % 7) ELSE qualifier END AS q FROM fx_call WHERE call_kind = 'static'),
dirs AS (SELECT name, program AS q, count(*) AS n, min(symbol_id) AS id FROM fx_symbol GROUP BY ALL),
files AS (SELECT name, regexp_extract(path, '(m[0-9]+)[.]rs', 1) AS q, count(*) AS n, min(symbol_id) AS id FROM fx_symbol GROUP BY ALL),
st AS (SELECT sc.*, CASE WHEN dirs.n = 1 THEN dirs.id END AS by_dir, CASE WHEN dirs.n IS NULL AND files.n = 1 THEN files.id END AS by_file, m.member_id FROM sc
LEFT JOIN dirs ON dirs.name = callee_name AND dirs.q = sc.q LEFT JOIN files ON files.name = callee_name AND files.q = sc.q LEFT JOIN first_member m ON m.signature = sc.q || '::' || callee_name)"""
STATIC_ROWS = """SELECT caller_id, callee_name, coalesce(by_dir, by_file, member_id) AS callee_id, CASE WHEN coalesce(by_dir, by_file, member_id) IS NULL THEN 'external' ELSE 'internal' END AS resolution,
CASE WHEN by_dir IS NOT NULL THEN 'folder' WHEN by_file IS NOT NULL THEN 'file' WHEN member_id IS NOT NULL THEN 'member' ELSE 'none' END AS rule FROM st"""


def static_calls(spark, d):
    return R.resolve_static_call(_static_calls(spark, d), _symbol(spark, d), R.first_members(_impl(spark, d), _symbol(spark, d)))


@register("j8_resolve_static_call", with_sql("fx_symbol", "fx_impl", "fx_call", more=STATIC) + STATIC_ROWS)
def j8_resolve_static_call(spark, d):
    return static_calls(spark, d)


def method_calls(spark, d):
    q = F.when(F.col("call_id") % 4 == 0, "self").when(F.col("call_id") % 4 == 1, "ctx.accounts").when(F.col("call_id") % 4 == 2, "x").otherwise("other.y")
    calls = view(spark, d, "fx_call").withColumn("qualifier", q)
    s = _symbol(spark, d)
    params = s.select("symbol_id", F.lit("ctx").alias("param_name"), F.lit("Context").alias("type_name"), F.concat(F.lit("Type_"), (F.col("symbol_id") % 13).cast("string")).alias("context_inner")).unionByName(s.select("symbol_id", F.lit("x").alias("param_name"), F.concat(F.lit("Type_"), (F.col("symbol_id") % 11).cast("string")).alias("type_name"), F.lit(None).cast("string").alias("context_inner")))
    return R.resolve_method_call(calls, params, R.first_members(_impl(spark, d), s), _impl(spark, d))


METHOD = """own AS (SELECT symbol_id, arg_min(impl_to, (impl_id, impl_to)) AS t FROM member GROUP BY symbol_id),
mc AS (SELECT c.caller_id, c.callee_name, c.call_id % 4 AS f, CASE c.call_id % 4 WHEN 0 THEN own.t WHEN 1 THEN 'Type_' || (s.symbol_id % 13) WHEN 2 THEN 'Type_' || (s.symbol_id % 11) END AS t
FROM fx_call c LEFT JOIN fx_symbol s ON s.symbol_id = c.caller_id LEFT JOIN own ON own.symbol_id = c.caller_id WHERE call_kind = 'method'),
mm AS (SELECT mc.*, m.member_id FROM mc LEFT JOIN first_member m ON m.signature = mc.t || '::' || callee_name)"""
METHOD_ROWS = """SELECT caller_id, callee_name, member_id AS callee_id, CASE WHEN member_id IS NOT NULL THEN 'internal' WHEN t IS NOT NULL AND f <> 0 THEN 'external' ELSE 'unresolved' END AS resolution,
CASE WHEN f = 0 THEN 'self' WHEN t IS NULL THEN 'none' WHEN f = 1 THEN 'accounts' WHEN f = 2 THEN 'parameter' ELSE 'none' END AS rule FROM mm"""


@register("j9_resolve_method_call", with_sql("fx_symbol", "fx_impl", "fx_call", more=STATIC + ", " + METHOD) + METHOD_ROWS)
def j9_resolve_method_call(spark, d):
    return method_calls(spark, d)


@register("j10_call_edges", with_sql("fx_symbol", "fx_impl", "fx_call", more=f"{STATIC}, {METHOD}, {FREE}, every AS ({FREE_ROWS} UNION ALL {STATIC_ROWS} UNION ALL {METHOD_ROWS})") + """SELECT caller_id, r.callee_id AS callee_id, r.callee_name AS callee_name, r.resolution AS resolution, r.rule AS rule FROM (
SELECT caller_id, min(struct_pack(resolution := resolution, rule := rule, callee_name := callee_name, callee_id := callee_id)) AS r FROM every WHERE callee_id IS NULL OR callee_id <> caller_id
GROUP BY caller_id, coalesce(CAST(callee_id AS VARCHAR), 'name:' || callee_name))""")
def j10_call_edges(spark, d):
    return R.call_edges(free_calls(spark, d), static_calls(spark, d), method_calls(spark, d)).select("caller_id", "callee_id", "callee_name", "resolution", "rule")


# --- graph


def _edges(spark, d):
    return view(spark, d, "fx_edge")


def _roots(spark, d):
    return _symbol(spark, d).where("kind = 'EntryPoint'").select(F.col("symbol_id").alias("root"))


#: All that is reachable with the fewest edges: a pair is entered once, in the first round that finds it.
REACH = """roots AS (SELECT symbol_id AS root FROM fx_symbol WHERE kind = 'EntryPoint'),
reach(root, node, depth) USING KEY (root, node) AS (SELECT root, dst, 1 FROM roots JOIN fx_edge ON src = root UNION SELECT w.root, e.dst, w.depth + 1 FROM reach w JOIN fx_edge e ON e.src = w.node
  WHERE NOT EXISTS (SELECT 1 FROM recurring.reach r WHERE r.root = w.root AND r.node = e.dst))"""
#: All that is reachable, without depths: the recursion ends by itself.
FULL = """roots AS (SELECT symbol_id AS root FROM fx_symbol WHERE kind = 'EntryPoint'),
reach AS (SELECT root, dst AS node FROM roots JOIN fx_edge ON src = root UNION SELECT r.root, e.dst FROM reach r JOIN fx_edge e ON e.src = r.node)"""


@register("g1_dependency_closure", with_sql("fx_symbol", "fx_edge", more=FULL) + "SELECT root, node FROM reach")
def g1_dependency_closure(spark, d):
    return G.dependency_closure(_edges(spark, d), _roots(spark, d)).select("root", "node")


@register("g1_closure_depth", with_sql("fx_symbol", "fx_edge", more=REACH) + "SELECT root, node, CAST(depth AS INT) AS depth FROM reach")
def g1_closure_depth(spark, d):
    return G.dependency_closure(_edges(spark, d), _roots(spark, d))


@register("g1m_closure_multiplicity", with_sql("fx_symbol", "fx_edge", more=FULL) + """SELECT a.root, e.dst AS node, count(*) AS n_callers FROM (SELECT root, node AS src FROM reach UNION SELECT root, root FROM roots) a JOIN fx_edge e ON e.src = a.src GROUP BY a.root, e.dst""")
def g1m_closure_multiplicity(spark, d):
    return G.dependency_closure(_edges(spark, d), _roots(spark, d), multiplicity=True).select("root", "node", "n_callers")


@register("g1_deep_closure", with_sql("fx_deep_edge", more="""ends AS (SELECT max(c_custkey) + 1 AS last FROM customer), r AS (SELECT c_custkey AS root, least((c_custkey // 2000) * 2000 + 1999, last) AS top FROM customer, ends WHERE c_custkey % 500 = 0)""") + """SELECT root, node, CAST(node - root AS INT) AS depth FROM r, LATERAL (SELECT unnest(range(root + 1, top + 1)) AS node) UNION ALL SELECT root, -1 - root // 2000, 1 FROM r""")
def g1_deep_closure(spark, d):
    """Chains of up to 2,000 nodes, of which every fiftieth also calls the hub of its chain."""
    roots = view(spark, d, "customer").where("c_custkey % 500 = 0").select(F.col("c_custkey").alias("root"))
    return G.dependency_closure(view(spark, d, "fx_deep_edge"), roots)


@register("g2_bfs_tree", with_sql("fx_symbol", "fx_edge", more="""roots AS (SELECT symbol_id AS root FROM fx_symbol WHERE symbol_id % 100 = 0),
walk AS (SELECT root, root AS node, 0 AS depth FROM roots UNION SELECT w.root, e.dst, w.depth + 1 FROM walk w JOIN fx_edge e ON e.src = w.node WHERE w.depth < 400 AND e.src <> e.dst),
best AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY root, node)""") + """SELECT b.root, b.node, CAST(b.depth AS INT) AS depth, (SELECT min(p.node) FROM best p JOIN fx_edge e ON e.src = p.node AND e.dst = b.node WHERE p.root = b.root AND p.depth = b.depth - 1) AS parent FROM best b""")
def g2_bfs_tree(spark, d):
    roots = _symbol(spark, d).where("symbol_id % 100 = 0").select(F.col("symbol_id").alias("root"))
    return G.bfs_tree(_edges(spark, d), roots)


@register("g2_bfs_tree_names", with_sql("fx_symbol", "fx_edge", more="""shown(root, name, node, depth, parent) USING KEY (root, name) AS (SELECT symbol_id, symbol_id % 7, symbol_id, 0, CAST(NULL AS BIGINT) FROM fx_symbol WHERE kind = 'EntryPoint'
UNION SELECT root, name, node, depth, parent FROM (SELECT w.root, e.dst % 7 AS name, e.dst AS node, w.depth + 1 AS depth, min(e.src) AS parent, row_number() OVER (PARTITION BY w.root, e.dst % 7 ORDER BY e.dst) AS k
  FROM shown w JOIN fx_edge e ON e.src = w.node AND e.src <> e.dst JOIN fx_symbol s ON s.symbol_id = e.dst WHERE NOT EXISTS (SELECT 1 FROM recurring.shown r WHERE r.root = w.root AND r.name = e.dst % 7) GROUP BY w.root, e.dst, w.depth) WHERE k = 1)""") + "SELECT root, node, CAST(depth AS INT) AS depth, parent FROM shown")
def g2_bfs_tree_names(spark, d):
    """The variant that shows each name once: seven names for all nodes."""
    names = _symbol(spark, d).select(F.col("symbol_id").alias("node"), (F.col("symbol_id") % 7).alias("name"))
    return G.bfs_tree(_edges(spark, d), _roots(spark, d), names)


PATHS = """ranked AS (SELECT contract_id, base_id, ord, CAST(row_number() OVER (PARTITION BY contract_id ORDER BY ord DESC) AS INT) AS r FROM fx_base WHERE contract_id <> base_id),
up AS (SELECT contract_id AS c, base_id AS a, [r] AS path, [ord] AS opath FROM ranked UNION ALL SELECT u.c, b.base_id, list_append(u.path, b.r), list_append(u.opath, b.ord) FROM up u JOIN ranked b ON b.contract_id = u.a),
own AS (SELECT contract_id AS c FROM fx_base UNION SELECT base_id FROM fx_base),
lin AS (SELECT c AS contract_id, CAST(row_number() OVER (PARTITION BY c ORDER BY list_append(path, 1073741824)) AS INT) AS position, a AS ancestor_id FROM (
SELECT c, a, min(path) AS path FROM up GROUP BY c, a UNION ALL SELECT c, c, CAST([] AS INT[]) FROM own))"""


@register("g3_linearize", with_sql("fx_base", more=PATHS) + "SELECT * FROM lin")
def g3_linearize(spark, d):
    return G.linearize(view(spark, d, "fx_base"))


@register("g4_inheritance_chain", with_sql("fx_base", "fx_contract", more=PATHS) + """SELECT c AS contract_id, CAST(row_number() OVER (PARTITION BY c ORDER BY len(path), path) AS INT) AS position, a AS ancestor_id FROM (
SELECT c, a, arg_min(opath, (len(opath), opath)) AS path FROM up GROUP BY c, a UNION ALL SELECT contract_id, contract_id, CAST([] AS INT[]) FROM fx_contract)""")
def g4_inheritance_chain(spark, d):
    return G.inheritance_chain(view(spark, d, "fx_base"), view(spark, d, "fx_contract"))


@register("g5_effective_functions", with_sql("fx_base", "fx_contract_fn", more=PATHS) + """SELECT contract_id, arg_max(ancestor_id, position) AS defined_in, name, n_params FROM lin JOIN (SELECT DISTINCT contract_id AS ancestor_id, name, n_params FROM fx_contract_fn) USING (ancestor_id) GROUP BY contract_id, name, n_params""")
def g5_effective_functions(spark, d):
    return G.effective_functions(G.linearize(view(spark, d, "fx_base")), view(spark, d, "fx_contract_fn"))


@register("g6_inherits_from", with_sql("fx_base", more=PATHS) + """SELECT q.contract_id, q.base_id, q.contract_id <> q.base_id AND EXISTS (SELECT 1 FROM up WHERE up.c = q.contract_id AND up.a = q.base_id) AS inherits
FROM (SELECT p_partkey AS contract_id, p_partkey // 6 + p_partkey % 2 AS base_id FROM part) q""")
def g6_inherits_from(spark, d):
    pairs = view(spark, d, "part").select(F.col("p_partkey").alias("contract_id"), (F.floor(F.col("p_partkey") / 6) + F.col("p_partkey") % 2).alias("base_id"))
    return G.inherits_from(view(spark, d, "fx_base"), pairs)


@register("g7_fan_in_out", with_sql("fx_symbol", "fx_edge") + """SELECT symbol_id, (SELECT count(DISTINCT src) FROM fx_edge WHERE dst = symbol_id) AS fan_in, (SELECT count(DISTINCT dst) FROM fx_edge WHERE src = symbol_id) AS fan_out,
NOT EXISTS (SELECT 1 FROM fx_edge WHERE dst = symbol_id) AS uncalled FROM fx_symbol""")
def g7_fan_in_out(spark, d):
    return G.fan_in_out(_edges(spark, d), _symbol(spark, d))


@register("a11_entry_dependency_list", with_sql("fx_symbol", "fx_edge", more=FULL) + """SELECT e.symbol_id AS entry_id, e.name AS entry_name, coalesce((SELECT string_agg(s.path || ':' || s.start_line, chr(10) ORDER BY s.path || ':' || s.start_line) FROM reach r JOIN fx_symbol s ON s.symbol_id = r.node WHERE r.root = e.symbol_id), 'No dependencies') AS dependencies
FROM fx_symbol e WHERE e.kind = 'EntryPoint'""")
def a11_entry_dependency_list(spark, d):
    s = _symbol(spark, d)
    return entry_dependency_list(s.where("kind = 'EntryPoint'").select(F.col("symbol_id").alias("entry_id"), "name"), G.dependency_closure(_edges(spark, d), _roots(spark, d)), s)


def corpus_entry_dependencies(spark, d):
    """From source text to what each entry reaches: lines, blocks, symbols, calls, resolution, closure, list."""
    files = view(spark, d, "fx_source")
    lines = B.source_lines(files)
    symbol = B.symbol_extract(files)
    sites = C.call_sites(lines, symbol, C.noise_table(spark))
    names = sites.where("call_kind = 'free'").join(symbol.select(F.col("symbol_id").alias("caller_id"), "path"), "caller_id").select("path", F.col("callee_name").alias("name")).distinct()
    imports, local = C.import_scope(files)
    candidates = R.resolve_name(names, imports, local)
    free = R.resolve_free_call(sites, symbol, candidates, symbol.select(F.col("symbol_id").alias("caller_id"), "path"))
    edges = R.call_edges(free).where("resolution = 'internal'").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"))
    entries = symbol.where("is_public").select(F.col("symbol_id").alias("entry_id"), F.concat_ws(":", "path", F.col("start_line").cast("string"), "name").alias("name"))
    found = G.dependency_closure(edges, entries.select(F.col("entry_id").alias("root")))
    return entry_dependency_list(entries, found, symbol).select("entry_name", "dependencies")


#: From the layout: a free call reaches the only function of its name, or the first in its own file.
QUERIES["corpus_entry_dependencies"] = corpus_entry_dependencies
ORACLES["corpus_entry_dependencies"] = with_sql("fx_layout", more="""sym AS (SELECT *, 11*(k-1)+2 AS line, 'fn_' || ((symbol_id*31) % 120) AS callee FROM fx_layout),
cnt AS (SELECT name, count(*) AS n FROM sym GROUP BY name),
hit AS (SELECT s.symbol_id AS src, min(sha256('symbol|' || t.path || '|Function|' || t.line)) AS h FROM sym s JOIN cnt ON cnt.name = s.callee JOIN sym t ON t.name = s.callee AND (cnt.n = 1 OR t.path = s.path) GROUP BY s.symbol_id),
ids AS (SELECT symbol_id, sha256('symbol|' || path || '|Function|' || line) AS h FROM sym),
e AS (SELECT hit.src, ids.symbol_id AS dst FROM hit JOIN ids USING (h) WHERE hit.src <> ids.symbol_id),
reach AS (SELECT s.symbol_id AS root, e.dst AS node FROM sym s JOIN e ON e.src = s.symbol_id WHERE s.kind = 'EntryPoint' UNION SELECT r.root, e.dst FROM reach r JOIN e ON e.src = r.node)""") + """SELECT s.path || ':' || s.line || ':' || s.name AS entry_name, coalesce((SELECT string_agg(t.path || ':' || t.line, chr(10) ORDER BY t.path || ':' || t.line) FROM reach r JOIN sym t ON t.symbol_id = r.node WHERE r.root = s.symbol_id), 'No dependencies') AS dependencies
FROM sym s WHERE s.kind = 'EntryPoint'"""


def program_files(spark, d):
    """A file for each symbol: an entry in a program module that calls a function by name, one by its type (of the next file) and one of its parameter, which calls one of its own type."""
    n, t = F.col("symbol_id").cast("string"), (F.col("symbol_id") + 1).cast("string")
    text = F.concat(
        F.lit("#[program]\npub mod entry_"), n, F.lit(" {\n    pub fn act_"), n, F.lit("(ctx: Context<Acc>, x: Kind_"), n, F.lit(") -> Result<()> {\n        helper_"), n, F.lit("(x)?;\n        Store_"), t, F.lit("::open_"), t, F.lit("(x)?;\n        x.touch_"), n,
        F.lit("();\n    }\n}\nfn helper_"), n, F.lit("(x: u64) {\n    none_"), n, F.lit("(1);\n}\npub struct Kind_"), n, F.lit(" {\n    pub v: u64,\n}\nimpl Kind_"), n, F.lit(" {\n    fn touch_"), n, F.lit("(&self) {\n        self.deep_"), n, F.lit("();\n    }\n    fn deep_"), n,
        F.lit("(&self) {\n    }\n}\nimpl Store_"), n, F.lit(" {\n    fn open_"), n, F.lit("(a: u64) {\n        helper_"), n, F.lit("(a)?;\n    }\n}\n"),
    )
    return spread(_symbol(spark, d).select(F.concat(F.lit("../programs/"), "program", F.lit("/src/e"), n, F.lit(".rs")).alias("path"), text.alias("content")))


def entry_call_graph(spark, files):
    """From files to (entries, symbols, call edges): entries by classification, calls by name, by type and by receiver."""
    lines = B.source_lines(files)
    symbol = durable(B.entry_rename(B.symbol_classify(B.symbol_extract(files), lines)))
    functions = symbol.where("item = 'function'")
    sites = durable(C.call_sites(lines, symbol, C.noise_table(spark)))
    callers = functions.select(F.col("symbol_id").alias("caller_id"), "path")
    imports, local = C.import_scope(files)
    names = sites.where("call_kind = 'free'").join(by_key(callers), "caller_id").select("path", F.col("callee_name").alias("name")).distinct()
    impl = R.impl_from_to(symbol.where("item = 'trait'").select(F.col("symbol_id").alias("impl_id"), "name", "path", "start_line", "end_line"))
    member = durable(R.first_members(impl, functions))
    typed = C.type_parts(C.signature_params(functions, lines).where("param_name is not null"), "param_type")
    params = typed.select("symbol_id", "param_name", F.col("inner").alias("type_name"), "context_inner")
    edges = R.call_edges(
        R.resolve_free_call(sites, functions, R.resolve_name(names, imports, local), callers),
        R.resolve_static_call(sites, functions, member),
        R.resolve_method_call(sites, params, member, impl),
    )
    return functions.where("sub_type = 'EntryPoint'"), symbol, edges


def corpus_entry_call_graph(spark, d):
    """From source text to what each entry reaches, over calls of all three kinds."""
    entries, symbol, edges = entry_call_graph(spark, program_files(spark, d))
    found = G.dependency_closure(edges.where("resolution = 'internal'").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")), entries.select(F.col("symbol_id").alias("root")))
    return entry_dependency_list(entries.select(F.col("symbol_id").alias("entry_id"), "name"), found, symbol).select("entry_name", "dependencies")


QUERIES["corpus_entry_call_graph"] = corpus_entry_call_graph
ORACLES["corpus_entry_call_graph"] = with_sql("fx_symbol", more="""f AS (SELECT symbol_id AS s, '../programs/' || program || '/src/e' || symbol_id || '.rs:' AS place FROM fx_symbol),
dep AS (SELECT s, s AS of, unnest([9, 16, 19]) AS line FROM f UNION ALL SELECT s, s + 1, unnest([9, 23]) FROM f)""") + """SELECT 'act_' || dep.s AS entry_name, string_agg(place || line, chr(10) ORDER BY place || line) AS dependencies FROM dep JOIN f ON f.s = dep.of GROUP BY dep.s"""


@register("e7_call_sites_of_all_kinds", with_sql("fx_symbol") + """SELECT 'e' || symbol_id || '.rs' AS file, v.col0 AS caller, v.col1 AS call_kind, v.col2 AS callee_name, v.col3 AS qualifier FROM (SELECT symbol_id, CAST(symbol_id AS VARCHAR) AS n, CAST(symbol_id + 1 AS VARCHAR) AS t FROM fx_symbol), LATERAL (VALUES
('act_' || n, 'free', 'helper_' || n, CAST(NULL AS VARCHAR)), ('act_' || n, 'static', 'open_' || t, 'Store_' || t), ('act_' || n, 'method', 'touch_' || n, 'x'), ('helper_' || n, 'free', 'none_' || n, NULL), ('touch_' || n, 'method', 'deep_' || n, 'self'), ('open_' || n, 'free', 'helper_' || n, NULL)) AS v""")
def e7_call_sites_of_all_kinds(spark, d):
    files = program_files(spark, d)
    symbol = B.symbol_extract(files)
    found = C.call_sites(B.source_lines(files), symbol, C.noise_table(spark))
    named = symbol.select(F.col("symbol_id").alias("caller_id"), F.col("name").alias("caller"), F.regexp_extract("path", r"(e\d+\.rs)$", 1).alias("file"))
    return found.join(named, "caller_id").select("file", "caller", "call_kind", "callee_name", "qualifier")
