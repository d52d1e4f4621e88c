"""Registered queries from Solidity text to entries: a corpus of files that is derived from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom.operators import solidity as S
from srcloom.operators.containment import by_key

from .fixtures import spread, view

QUERIES, ORACLES = {}, {}


def register(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


#: A vault for each part; @N its number, @B the number of its base (ten vaults share one), @S a function that only even vaults have.
VAULT = """// vault { of @N
pragma solidity ^0.8.0;
import {
    Base@B,
    Util as U@N // not Token
} from "./base/B@B.sol";
import "@tok/T@B.sol";
/* import "./gone.sol"; */
event Loose(address who);
function loose(uint256 x) pure returns (uint256) { return seal(x); }
abstract contract Mid is Base@B { function step(uint256 a) internal virtual { note(a); } }
contract Vault@N
    is Mid, Token@B
{
    uint256 public total; mapping(address => uint256) private held;
    event Moved(address who, string why);
    constructor(address a) { note(1); }
    function move(uint256 a,
        address[] calldata to) external onlyOwner {
        require(a > 0, "no seal(a) { // here");
        step(a);
        U@N.mix(a);
        to
            .push(data(a)); // check();
    }
    function peek() public view returns (uint256) { return total; }
    function peek(uint256 a) public { step(a); }
@S}
contract Odd@N is Missing, Mid { }
"""
BASE = """pragma solidity ^0.8.0;
import * as Tok from "@tok/T@B.sol";
contract Base@B {
    address owner;
    modifier onlyOwner() {
        check();
        _;
    }
    function note(uint256 a) internal { seal(a); }
    function seal(uint256 a) internal virtual { }
    function check() internal view { }
}
library Util { function mix(uint256 a) internal pure returns (uint256) { return a; } }
"""
TOKEN = """pragma solidity ^0.8.0;
contract Token@B {
    event Sent(uint256 a);
    function data(uint256 a) internal returns (bytes memory) { emit Sent(a); }
    function open() external { }
}
"""
SEAL = "    function seal(uint256 a) internal override { last(a); }\n    function last(uint256 a) private { }\n"


def _filled(template: str, n, b):
    text = F.lit(template)
    for sign, value in (("@N", n), ("@B", b)):
        text = F.replace(text, F.lit(sign), value)
    return text


def vault_files(spark, d):
    """path, content: a vault file for each part, and a base and a token file for each ten of them."""
    part = view(spark, d, "part")
    n, b = F.col("p_partkey").cast("string"), F.floor(F.col("p_partkey") / 10).cast("string")
    seal = F.when(F.col("p_partkey") % 2 == 0, SEAL).otherwise("")
    vaults = part.select(F.concat(F.lit("src/V"), n, F.lit(".sol")).alias("path"), F.replace(_filled(VAULT, n, b), F.lit("@S"), seal).alias("content"))
    tens = part.select(b.alias("b")).distinct()
    bases = tens.select(F.concat(F.lit("src/base/B"), "b", F.lit(".sol")).alias("path"), _filled(BASE, F.lit(""), F.col("b")).alias("content"))
    tokens = tens.select(F.concat(F.lit("src/lib/token/T"), "b", F.lit(".sol")).alias("path"), _filled(TOKEN, F.lit(""), F.col("b")).alias("content"))
    return spread(vaults.unionByName(bases).unionByName(tokens))


def _remaps(spark):
    return spark.createDataFrame([("@tok/", "src/lib/token/")], "prefix string, target string")


def _tables(spark, d, **wanted):
    return S.contract_entries(vault_files(spark, d), _remaps(spark), **wanted)


PARTS = "WITH v AS (SELECT CAST(p_partkey AS VARCHAR) AS n, CAST(p_partkey // 10 AS VARCHAR) AS b, p_partkey % 2 = 0 AS even FROM part)\n"


@register("e11_contract_spans", PARTS + """SELECT 'src/V' || n || '.sol' AS path, contract, item, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line FROM (
SELECT n, even, 'Vault' || n AS contract, item, s AS start_line, e AS end_line FROM v, LATERAL (VALUES ('constructor', 17, 17), ('move', 18, 25), ('peek', 26, 26), ('peek', 27, 27)) AS w(item, s, e)
UNION ALL SELECT n, even, 'Vault' || n, item, s, e FROM v, LATERAL (VALUES ('seal', 28, 28), ('last', 29, 29)) AS w(item, s, e) WHERE even
UNION ALL SELECT n, even, 'Mid', item, 11, 11 FROM v, LATERAL (VALUES ('step'), (CAST(NULL AS VARCHAR))) AS w(item)
UNION ALL SELECT n, even, 'Vault' || n, NULL, 12, CASE WHEN even THEN 30 ELSE 28 END FROM v UNION ALL SELECT n, even, 'Odd' || n, NULL, CASE WHEN even THEN 31 ELSE 29 END, CASE WHEN even THEN 31 ELSE 29 END FROM v)""")
def e11_contract_spans(spark, d):
    """Where contracts and functions of the vault files begin and end; item is null for a contract."""
    from srcloom.operators.contracts import contract_extract

    t = contract_extract(vault_files(spark, d).where("path like 'src/V%'"))
    f = t["contract_function"].select("path", "contract", F.col("name").alias("item"), "start_line", "end_line")
    return f.unionByName(t["contract"].select("path", "contract", F.lit(None).cast("string").alias("item"), "start_line", "end_line"))


@register("corpus_contract_entries", PARTS + """SELECT entry_name, 'src/V' || n || '.sol' AS path, dep_kind, dep_id FROM (
SELECT n, 'Vault' || n || '.move' AS entry_name, 'modifier' AS dep_kind, 'modifier|src/base/B' || b || '.sol|Base' || b || '|onlyOwner' AS dep_id FROM v
UNION ALL SELECT n, 'Vault' || n || '.move', 'function', 'src/V' || n || '.sol|Mid|step(uint256)' FROM v
UNION ALL SELECT n, 'Vault' || n || '.move', 'function', 'src/lib/token/T' || b || '.sol|Token' || b || '|data(uint256)' FROM v
UNION ALL SELECT n, 'Vault' || n || '.peek(uint256)', 'function', 'src/V' || n || '.sol|Mid|step(uint256)' FROM v
UNION ALL SELECT n, 'Vault' || n || '.peek()', NULL, NULL FROM v)""")
def corpus_contract_entries(spark, d):
    """From Solidity text to the entries and what they use directly; an entry that uses nothing has one row."""
    t = _tables(spark, d, tree=False)
    e = t["entry"].join(by_key(t["function"].select("function_id", "path")), "function_id").where("path like 'src/V%'")
    return e.join(by_key(t["direct"]), "function_id", "left").select("entry_name", "path", "dep_kind", "dep_id")


@register("g2_contract_entry_tree", PARTS + """, f AS (SELECT n, 'src/V' || n || '.sol|' AS me, 'src/base/B' || b || '.sol|Base' || b || '|' AS base, 'src/lib/token/T' || b || '.sol|Token' || b || '|' AS tok, even FROM v),
up AS (SELECT n, me, base, even, root, d FROM f, LATERAL (VALUES ('move(uint256,address[])', 1), ('peek(uint256)', 1)) AS w(root, d))
SELECT me || 'Vault' || n || '|' || root AS root, node, CAST(depth AS INT) AS depth, parent FROM (
SELECT n, me, root, me || 'Vault' || n || '|' || root AS node, 0 AS depth, NULL AS parent FROM up UNION ALL SELECT n, me, 'peek()', me || 'Vault' || n || '|peek()', 0, NULL FROM f
UNION ALL SELECT n, me, root, 'modifier|' || base || 'onlyOwner', 1, me || 'Vault' || n || '|' || root FROM up WHERE root LIKE 'move%'
UNION ALL SELECT n, me, 'move(uint256,address[])', tok || 'data(uint256)', 1, me || 'Vault' || n || '|move(uint256,address[])' FROM f
UNION ALL SELECT n, me, root, me || 'Mid|step(uint256)', d, me || 'Vault' || n || '|' || root FROM up
UNION ALL SELECT n, me, root, base || 'note(uint256)', d + 1, me || 'Mid|step(uint256)' FROM up
UNION ALL SELECT n, me, root, CASE WHEN even THEN me || 'Vault' || n || '|' ELSE base END || 'seal(uint256)', d + 2, base || 'note(uint256)' FROM up
UNION ALL SELECT n, me, root, me || 'Vault' || n || '|last(uint256)', d + 3, me || 'Vault' || n || '|seal(uint256)' FROM up WHERE even)""")
def g2_contract_entry_tree(spark, d):
    """The trees of the vaults' entries: Base.note calls seal, which even vaults override, so their trees go on where those of odd ones end."""
    return _tables(spark, d, direct=False)["tree"].where("root like 'src/V%'").select("root", "node", "depth", "parent")


@register("r7_contract_entry_report", PARTS + """SELECT entry_name, path, section, CAST(ord AS INT) AS ord, line FROM (
SELECT *, 'src/V' || n || '.sol' AS path FROM (SELECT n, 'Vault' || n || '.' || x AS entry_name, section, ord, CASE WHEN x LIKE 'peek%' AND section = 'access control' THEN '- None' ELSE line END AS line FROM (
SELECT n, x, section, ord, line FROM v, LATERAL (VALUES ('move'), ('peek()'), ('peek(uint256)')) AS e(x), LATERAL (VALUES ('access control', 1, '- OnlyOwner'), ('state', 1, '- held'), ('state', 2, '- owner'), ('state', 3, '- total'), ('events', 1, '- Moved'), ('events', 2, '- Sent')) AS w(section, ord, line)
UNION ALL SELECT n, x, 'modifiers', 1, m FROM v, LATERAL (VALUES ('move', '- Modifiers: onlyOwner'), ('peek()', '- Modifiers: None'), ('peek(uint256)', '- Modifiers: None')) AS e(x, m)
UNION ALL SELECT n, x, 'contract', 1, '- Vault' || n || ' (src/V' || n || '.sol:' || l || ')' FROM v, LATERAL (VALUES ('move', 18), ('peek()', 26), ('peek(uint256)', 27)) AS e(x, l)
UNION ALL SELECT n, 'move', 'parameters', k, p FROM v, LATERAL (VALUES (1, '- a: uint256'), (2, '- to: address[] calldata')) AS w(k, p)
UNION ALL SELECT n, 'peek(uint256)', 'parameters', 1, '- a: uint256' FROM v
UNION ALL SELECT n, x, 'calls', k, '- step (src/V' || n || '.sol:11)' FROM v, LATERAL (VALUES ('move', 2), ('peek(uint256)', 1)) AS e(x, k)
UNION ALL SELECT n, 'move', 'calls', 1, '- data (src/lib/token/T' || b || '.sol:4)' FROM v)))""")
def r7_contract_entry_report(spark, d):
    """All sections of the report of each entry, from text."""
    return S.entry_report(_tables(spark, d, tree=False)).where("path like 'src/V%'")


@register("a8_contract_rejects", PARTS + """SELECT 'src/V' || n || '.sol' AS path, 'src/V' || n || '.sol|Odd' || n AS item, 'Missing' AS name, 'unknown base' AS reason FROM v""")
def a8_contract_rejects(spark, d):
    """What of the vault files could not be read or resolved."""
    return S.contract_rejects(vault_files(spark, d), _remaps(spark))


def damaged_files(spark, d):
    """The vault files, of which some end in a comment that is never closed and some in an open brace."""
    key = F.regexp_extract("path", r"src/V(\d+)\.sol", 1).try_cast("long") % 7
    return vault_files(spark, d).withColumn("content", F.concat("content", F.when(key == 0, "/* never closed").when(key == 3, "{").otherwise("")))


@register("a8_counts_from_text", PARTS + """, t AS (SELECT DISTINCT b FROM v), n AS (SELECT count(*) AS n FROM customer),
good AS (SELECT * FROM v WHERE CAST(n AS BIGINT) % 7 NOT IN (0, 3)),
c AS (SELECT (SELECT count(*) FROM good) AS g, (SELECT count(*) FROM good WHERE even) AS e, (SELECT count(*) FROM t) AS t, (SELECT count(*) FROM v) AS v, (SELECT n FROM n) AS n)
SELECT metric, k AS n FROM c, LATERAL (VALUES ('symbol:function', 5*n), ('symbol:struct', n), ('symbol:trait', 2*n), ('contract:src', 3*g + 2*t), ('contract:lib', t), ('functions', 5*g + 2*e + 6*t), ('modifiers', t), ('calls', 7*g + e + t), ('parse_errors', v - g)) AS w(metric, k)""")
def a8_counts_from_text(spark, d):
    """All counts of a corpus from its text; parse errors are the files that could not be read to their end."""
    from srcloom.operators.analytics import corpus_counts
    from srcloom.operators.blocks import symbol_extract

    from .resolving import program_files

    t = S.contract_corpus(damaged_files(spark, d), _remaps(spark))
    symbol = symbol_extract(program_files(spark, d)).withColumn("kind", F.col("item"))
    return corpus_counts(symbol, t["contract"], t["site"], t["function"], t["modifier"], t["reject"].where("item = 'file'"))


@register("e7_wrapped_calls", """SELECT 'w' || s_suppkey || '.rs' AS path, call_kind, callee_name, qualifier FROM (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS n FROM supplier), LATERAL (VALUES
('method', 'move_' || n, 'self.vault'), ('method', 'check_' || n, 'ctx.accounts.pool'), ('method', 'close_' || n, CAST(NULL AS VARCHAR)), ('free', 'price_' || n, NULL), ('static', 'open_' || n, 'Store'), ('method', 'then_' || n, 'self.vault.move_' || n || '()')) AS v(call_kind, callee_name, qualifier)""")
def e7_wrapped_calls(spark, d):
    """Calls in formatted code: chains and arguments over lines, comments between them, and calls in comments and strings that are none."""
    from srcloom.operators import blocks as B
    from srcloom.operators import calls as C

    text = """fn run(a: u64) -> Result<()> {
    self.vault
        .move_@N(
            price_@N(a), // old_@N(a)
        )
        .then_@N();
    /* gone_@N(a);
       /* nested_@N(a); */ still_@N(a);
    */
    let note = "said_@N(a) // {";
    let raw = r#"raw_@N("x") } "#;
    ctx.accounts
        .pool
        .check_@N()?
        .close_@N();
    Store::
        open_@N(a);
}
"""
    n = F.col("s_suppkey").cast("string")
    files = view(spark, d, "supplier").select(F.concat(F.lit("w"), n, F.lit(".rs")).alias("path"), F.replace(F.lit(text), F.lit("@N"), n).alias("content"))
    symbol = B.symbol_extract(files)
    found = C.call_sites(B.source_lines(files), symbol, C.noise_table(spark))
    return found.join(symbol.select(F.col("symbol_id").alias("caller_id"), "path"), "caller_id").select("path", "call_kind", "callee_name", "qualifier")


@register("e10_wrapped_imports", PARTS + """SELECT 'src/V' || n || '.sol' AS path, import_path, symbol, alias, CAST(line AS INT) AS line FROM v, LATERAL (VALUES ('./base/B' || b || '.sol', 'Base' || b, CAST(NULL AS VARCHAR), 3), ('./base/B' || b || '.sol', 'Util', 'U' || n, 3), ('@tok/T' || b || '.sol', NULL, NULL, 7)) AS w(import_path, symbol, alias, line)""")
def e10_wrapped_imports(spark, d):
    """Import groups over several lines, with comments between their names."""
    from srcloom.operators.calls import sol_imports

    return sol_imports(vault_files(spark, d).where("path like 'src/V%'")).select("path", "import_path", "symbol", "alias", "line")


@register("e1_masked_lines", """SELECT 'm' || s_suppkey || '.rs' AS path, CAST(line_no AS INT) AS line_no, line FROM supplier, LATERAL (VALUES (1, 'fn a() { let s = "' || repeat(' ', 13 + length(CAST(s_suppkey AS VARCHAR))) || '"; }'), (2, repeat(' ', 11)), (3, repeat(' ', 16) || 'b('), (4, '  "  "); ' || repeat(' ', 6))) AS v(line_no, line)""")
def e1_masked_lines(spark, d):
    """Lines with comments and the insides of literals blanked, over line ends."""
    from srcloom.operators.blocks import masked_lines

    n = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit('fn a() { let s = "} // { no_'), n, F.lit('() "; }\n/* one { /*\n two */ } */    b(\n  \'\\n\'); // end'))
    files = view(spark, d, "supplier").select(F.concat(F.lit("m"), n, F.lit(".rs")).alias("path"), text.alias("content"))
    return masked_lines(files).select("path", "line_no", "line")
