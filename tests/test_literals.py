"""Operators on small texts and tables written by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from srcloom.functions.text import path_fragment, spaced, split_top_level, without_lifetimes
from srcloom.operators import accounts as A
from srcloom.operators import analytics as N
from srcloom.operators import blocks as B
from srcloom.operators import calls as C
from srcloom.operators import contracts as K
from srcloom.operators import graph as G
from srcloom.operators import reports as Q
from srcloom.operators import resolve as R
from srcloom.operators import review as V
from srcloom.operators import solidity as Y
from srcloom.operators.containment import within
from srcloom.sources import files as S

BLOCKS = """pub mod program {
    pub fn outer(a: u8) -> u8 {
        fn inner(b: u8) {
            if b > 1 {
                require!(b < 9);
            } else {
                other();
            }
        }
        if a == 0 {
            plain();
        }
        assert_eq!(a, 1);
    }
    fn declared(a: u8);
    fn open_end(a: u8) {
}

#[derive(Accounts)]
pub struct In<'info> {
    #[account(mut)]
    pub payer: Signer<'info>,
}
pub struct Unit;
#[account]
#[derive(Default)]
pub struct State {
    pub size: u64, // bytes
    pub owner: Pubkey,
}
enum Kind {
    A,
}
impl Do for State {
    fn go(&self, mut n: u32, m: Map<A, B>) {
        self.n();
    }
}
fnord(x) {
}
"""


@pytest.fixture(scope="module")
def file(spark):
    return spark.createDataFrame([("src/a.rs", BLOCKS, "p")], "path string, content string, program string")


@pytest.fixture(scope="module")
def lines(file):
    return B.source_lines(file).cache()


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first().x


def test_blocks(lines):
    found = got(B.block_scan(lines, kinds=["Function", "If", "IfValidation", "Module", "Struct", "Enum", "TraitImpl"]), "kind", "start_line", "end_line")
    assert found == sorted(
        [("Module", 1, 17), ("Function", 2, 14), ("Function", 3, 9), ("If", 4, 8), ("IfValidation", 4, 8), ("If", 10, 12), ("Function", 16, 37), ("Struct", 20, 23), ("Struct", 24, 24), ("Struct", 27, 30), ("Enum", 31, 33), ("TraitImpl", 34, 38), ("Function", 35, 37)],
        key=str,
    )
    # a header without a word boundary opens only in the older form
    assert ("Function", 39, 40) in got(B.block_scan(lines, kinds=["Function"], legacy=True), "kind", "start_line", "end_line")


def test_blocks_edges(spark):
    odd = spark.createDataFrame([("t", "\tfn a() {\n\t}"), ("e", ""), ("c", "fn a() {\r\n}\r\n")], "path string, content string")
    found = B.source_lines(odd)
    assert got(B.block_scan(found), "path", "start_line", "end_line") == [("c", 1, 2), ("t", 1, 2)]
    assert got(B.block_scan(found, strict_spaces=True), "path") == [("c",)]
    assert B.block_scan(found.where("false")).count() == 0


def test_symbols(file, lines):
    s = B.symbol_classify(B.symbol_extract(file), lines)
    assert got(s, "item", "name", "sub_type") == sorted(
        [("function", "outer", "Other"), ("function", "inner", "Other"), ("function", "open_end", "Other"), ("struct", "In", "ContextAccounts"), ("struct", "Unit", "Other"), ("struct", "State", "SolanaAccount"), ("enum", "Kind", "Enum"), ("trait", "Do for State", "Implementation"), ("function", "go", "Other")],
        key=str,
    )
    assert got(B.struct_fields(s.where("name = 'State'"), lines), "ord", "field", "type") == [(1, "size", "u64"), (2, "owner", "Pubkey")]
    p = C.signature_params(s.where("name = 'go'"), lines)
    assert got(p, "ord", "param_name", "param_type") == [(1, "n", "u32"), (2, "m", "Map<A, B>")]
    assert got(B.symbol_extract(file), "symbol_id") == got(B.symbol_extract(file), "symbol_id")


def test_program_module_makes_entries(spark):
    text = "#[program]\npub mod p {\n    pub fn act(a: u8) {\n    }\n}\nfn free(a: u8) {\n}\npub fn process(accounts: &[AccountView]) {\n}"
    f = spark.createDataFrame([("src/swap.rs", text, "p")], "path string, content string, program string")
    s = B.entry_rename(B.symbol_classify(B.symbol_extract(f), B.source_lines(f)))
    assert got(s, "name", "sub_type") == [("act", "EntryPoint"), ("free", "Other"), ("swap", "EntryPoint")]


def test_braces(spark):
    text = "fn a() { if x { y(); } else {\n} }\nfn b()\n{\n}\nfn c() {"
    f = spark.createDataFrame([("x", text)], "path string, content string")
    starts = spark.createDataFrame([("x", 1), ("x", 3), ("x", 6)], "path string, start_line int")
    assert got(B.brace_blocks(B.source_lines(f), starts), "start_line", "end_line") == [(1, 2), (3, 5), (6, 6)]


def test_calls(spark):
    text = "fn f(a: u8) {\n    free(a)?; // not(this)\n    Type::make::<u8>(inner(b));\n    a::b::c(x);\n    self.state.total(y).unwrap();\n    ctx.accounts.check(z);\n    v.iter().map(|q| hidden(q)).weigh();\n    msg!(\"text(call)\"); require!(ok(a));\n    free(b);\n    Ok(())\n}"
    f = spark.createDataFrame([("x", text)], "path string, content string")
    found = C.call_sites(B.source_lines(f), B.symbol_extract(f), C.noise_table(spark))
    assert got(found, "call_kind", "qualifier", "callee_name") == sorted(
        [("free", None, "free"), ("static", "Type", "make"), ("free", None, "inner"), ("static", "b", "c"), ("method", "self.state", "total"), ("method", "ctx.accounts", "check"), ("free", None, "hidden"), ("method", "v.iter().map()", "weigh"), ("free", None, "ok")],
        key=str,
    )


WRAPPED = """fn f(a: u8) {
    self.vault
        .transfer(
            a, // old(b)
        )?;
    /* gone(1); /* nested(2); */ x.gone(); */
    let s = "in(text) // not a comment";
    let r = r#"raw("x")"#; after(r);
    ctx.accounts
        .pool
        .load(x.y(1), [z(2)])
        .close(|q| {
            q.inner(3);
        });
    self.list[0].first(a).second()?.third.fourth();
    <T as Shape>::area(&s);
    Vec::<u8>::filled(3);
    a.parse::<Vec<u8>>().used();
    build(1).run(); b.wait().await.done();
    for k in 0..limit(a) { match k { _ => {} } }
    assert!(deep(1) == 2);
    crate::m::
        go(1);
}"""


def test_calls_over_lines_comments_and_strings(spark):
    f = spark.createDataFrame([("x", WRAPPED)], "path string, content string")
    at = lambda how: got(C.call_sites(B.source_lines(f), B.symbol_extract(f), C.noise_table(spark), **how), "call_kind", "qualifier", "callee_name")
    want = [
        ("method", "self.vault", "transfer"), ("free", None, "after"), ("method", "x", "y"), ("free", None, "z"), ("method", "ctx.accounts.pool.load()", "close"), ("method", "q", "inner"),
        ("method", None, "first"), ("method", "first()", "second"), ("method", "third", "fourth"), ("static", "Shape", "area"), ("static", "Vec", "filled"), ("method", "a", "parse"), ("method", "a.parse()", "used"),
        ("free", None, "build"), ("method", None, "run"), ("method", "b", "wait"), ("method", None, "done"), ("free", None, "limit"), ("static", "m", "go"),
    ]
    assert at({"in_macros": False}) == sorted(want, key=str)
    assert at({}) == sorted([*want, ("free", None, "deep")], key=str)


def test_calls_by_the_structure_of_a_body(spark):
    body = "{ a(b(1)); c.d\n  (2); IERC20(t).transfer(x); e.f.g(y); emit Moved(h(1)); revert Bad(i(2)); super.j(); keccak256(k(3)); msg.sender.call{value: l(4)}(\"m(5)\"); // n(6)\n if (o(7)) { return p(8); } /* q(9) */ }"
    f = spark.createDataFrame([(1, body)], "function_id int, body string")
    assert got(C.sol_calls(f), "callee") == [(x,) for x in ("IERC20", "a", "b", "c.d", "k", "l", "o", "p")]


def test_imports_over_lines(spark):
    text = """// import "./no.sol";
pragma solidity
    ^0.8.0;
import "./a.sol"; import './b.sol' as B;
import {
    One,
    Two as Second, // Three
    /* Four, */
    Five
} from
    "../c.sol";
import * as All from "./d.sol";
contract X { string s = "import './e.sol';"; }
"""
    found = C.sol_imports(spark.createDataFrame([("x.sol", text)], "path string, content string"))
    assert got(found, "import_path", "symbol", "alias", "line") == sorted(
        [("./a.sol", None, None, 4), ("./b.sol", None, "B", 4), ("../c.sol", "One", None, 5), ("../c.sol", "Two", "Second", 5), ("../c.sol", "Five", None, 5), ("./d.sol", None, "All", 12)], key=str
    )
    assert {r.pragma for r in found.collect()} == {"solidity\n    ^0.8.0"}


def test_imports_and_names(spark):
    text = "use a::{self, b as c,\n    d::{e, // x::y\n f::*}};\n/* use z::y; */ use g::*;\npub(crate) fn here() {}\nlet s = \"\nfn no() {}\n\";\n"
    f = spark.createDataFrame([("x", text)], "path string, content string")
    imports, local = C.import_scope(f)
    assert got(imports, "short_name", "full_path", "is_glob") == sorted([("a", "a", False), ("c", "a::b", False), ("e", "a::d::e", False), ("*", "a::d::f", True), ("*", "g", True)], key=str)
    names = spark.createDataFrame([("x", n) for n in ("c", "e::z", "here", "other")], "path string, name string")
    assert got(R.resolve_name(names, imports, local), "name", "full_path", "rank") == [("c", "a::b", 0), ("e::z", "a::d::e::z", 0), ("here", "self::here", 0), ("other", "a::d::f::other", 0), ("other", "g::other", 1)]


ATTRS = {
    "signer": ("mut", {"is_mut": True}),
    "seeds": ('seeds = [b"v", f(a, b).as_ref()], bump', {"is_pda": True, "seeds": ['b"v"', "f(a, b).as_ref()"], "bump": ""}),
    "init": ("init, payer = user, space = 8 + Acc::LEN", {"is_init": True, "rent_account": "user", "space": "8 + Acc::LEN"}),
    "close": ("mut, close = dest", {"is_close": True, "rent_account": "dest"}),
    "mint": ("token::mint = m, token :: authority = a", {"token_mint": "m"}),
    "assoc": ("associated_token::mint = am", {"token_mint": "am"}),
    "realloc": ("realloc = n, realloc::payer = p, realloc::zero = true", {"realloc": "n", "rent_account": "p", "zero": True}),
    "rent": ("rent_exempt = enforce", {"rent_exempt": True}),
    "owner": ("owner = crate::ID", {"owner": "crate::ID"}),
    "none": ("", {}),
}


def test_account_attributes(spark):
    df = spark.createDataFrame([(1, k, name, attr) for k, (name, (attr, _)) in enumerate(ATTRS.items())], "struct_id int, ord int, account_name string, attr string")
    flags = {r.ord: r.asDict() for r in A.account_flags(A.account_attrs(df)).collect()}
    for k, (_, want) in enumerate(ATTRS.values()):
        assert {n: flags.get(k, {}).get(n) for n in want} == want
    rows = spark.createDataFrame([(1, 1, "has_one = a @ E::X, has_one = b, constraint = x.y() == z, constraint = p >= q, address = K @ E::Y, custom = 1, zero, owner = o")], "struct_id int, ord int, attr string")
    v = A.account_validations(A.account_attrs(rows)).first()
    assert v.validations == ["has_one = a @ E::X", "has_one = b", "address = K @ E::Y", "zero", "owner = o", "constraint = x.y() == z", "constraint = p >= q", "constraint = custom = 1"]


def test_types(spark):
    texts = ["Signer<'info>", "Box<Account<'info, State>>", "&'a mut Vault", "anchor::Context<'_, '_, Make<'info>>", "u64", "Map<A, B<C, D>>"]
    df = C.type_parts(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert [tuple(df.where(F.col("t") == t).first())[1:] for t in texts] == [("Signer", "'info", "Signer", False, None), ("Account", "'info", "State", True, None), ("Vault", "", "Vault", False, None), ("Context", "'_", "Make<'info>", False, "Make"), ("u64", "", "u64", False, None), ("Map", "", "A", False, None)]


def test_expressions(spark):
    assert one(spark, split_top_level(F.col("a")), a="x, f(a, {b, c}), g<A, B> ,, a -> b, [1, 2]") == ["x", "f(a, {b, c})", "g<A, B>", "a -> b", "[1, 2]"]
    assert one(spark, path_fragment(F.col("a"), F.lit("f")), a="crate::utils::math::f") == "utils/math"
    assert one(spark, path_fragment(F.col("a"), F.lit("f")), a="crate::f") is None
    assert one(spark, without_lifetimes(F.col("a")), a="Context<'info, Make<'info>>") == "Context<Make>"
    assert one(spark, spaced(F.col("a")), a="SignerAccount :: check ( payer ) ?") == "SignerAccount::check(payer)?"


def test_checked_accounts(spark):
    text = "impl<'a> TryFrom<&'a [AccountView]> for In<'a> {\n fn try_from(v: &'a [AccountView]) -> R {\n  SignerAccount::check(payer)?;\n  ProgramAccount::check(state)?;\n  TokenAccountInterface::check(state)?;\n  Custom::verify(odd)?;\n if !vault.is_writable() {}; vault.owned_by(x);\n }\n}"
    checks = A.inferred_checks(spark.createDataFrame([("x", text)], "path string, content string"))
    fields = spark.createDataFrame([("In", f) for f in ("payer", "state", "odd", "vault", "free")], "struct_name string, field string")
    assert got(A.checked_accounts(fields, checks), "field", "wrapper", "account_struct", "is_mut") == [("free", "AccountView", "AccountView", False), ("odd", "AccountView", "AccountView", False), ("payer", "Signer", "Signer", False), ("state", "TokenAccount", "TokenAccount", False), ("vault", "Account", "ProgramAccount", True)]


def test_unique_name_wins_over_imports(spark):
    calls = spark.createDataFrame([(1, "free", "only", None), (1, "free", "two", None), (1, "free", "none", None), (9, "free", "two", None)], "caller_id int, call_kind string, callee_name string, qualifier string")
    symbol = spark.createDataFrame([(5, "only", "p/src/a.rs"), (6, "two", "p/src/a.rs"), (7, "two", "p/src/math/b.rs")], "symbol_id int, name string, path string")
    imports = spark.createDataFrame([("m.rs", "only", "crate::elsewhere::only", 0), ("m.rs", "two", "crate::math::two", 0)], "path string, name string, full_path string, rank int")
    callers = spark.createDataFrame([(1, "m.rs"), (9, "n.rs")], "caller_id int, path string")
    found = R.resolve_free_call(calls, symbol, imports, callers)
    assert got(found, "caller_id", "callee_name", "callee_id", "resolution") == sorted([(1, "only", 5, "internal"), (1, "two", 7, "internal"), (1, "none", None, "external"), (9, "two", None, "unresolved")], key=str)


def test_closure_of_cycles(spark):
    edge = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (None, 1), (1, 2)], "src int, dst int")
    roots = spark.createDataFrame([(1,), (4,), (9,)], "root int")
    found = G.dependency_closure(edge, roots, multiplicity=True)
    assert got(found, "root", "node", "depth", "n_callers") == [(1, 1, 3, 1), (1, 2, 1, 1), (1, 3, 2, 1), (4, 4, 1, 1)]
    tree = G.bfs_tree(edge, spark.createDataFrame([(2,), (1,)], "root int"), across_roots=True)
    assert {r.root for r in tree.collect()} == {1}
    assert G.dependency_closure(edge.where("false"), roots).count() == 0


def test_linearization(spark):
    """Post-order with bases from right to left; the nearest definition is the last one."""
    base = spark.createDataFrame([(4, 1, 2), (4, 2, 3), (2, 1, 1), (3, 1, 1)], "contract_id int, ord int, base_id int")
    order = {}
    for r in G.linearize(base).orderBy("contract_id", "position").collect():
        order.setdefault(r.contract_id, []).append(r.ancestor_id)
    assert order == {1: [1], 2: [1, 2], 3: [1, 3], 4: [1, 3, 2, 4]}
    f = spark.createDataFrame([(1, "a", 0), (3, "a", 0), (1, "b", 1), (2, "b", 1)], "contract_id int, name string, n_params int")
    assert (4, 3, "a") in got(G.effective_functions(G.linearize(base), f), "contract_id", "defined_in", "name")


def test_lifecycle_buckets_exclude(spark):
    a = spark.createDataFrame([(1, 1, "a", "S", "ProgramStateAccount", True, True, True), (1, 2, "b", "S", "ProgramStateAccount", False, True, True), (1, 3, "c", "T", "Other", False, False, True)], "struct_id int, ord int, account_name string, struct_name string, account_type string, is_init boolean, is_close boolean, is_mut boolean")
    r = N.account_lifecycle(a).first()
    assert (r.init_program, r.close_program, r.mut_program, r.mut_other, r.program_accounts) == (["a"], ["b"], [], ["c"], ["S", "S"])


def test_orphan_changes(spark):
    m = spark.createDataFrame([("S", "e1", "init", "f"), ("S", "e2", "mut", "f"), ("S", "e2", "mut", "g"), ("S", "e3", "mut", "f")], "struct_name string, entry string, op string, field string")
    v = spark.createDataFrame([("S", "e2", "mut", "f", "1"), ("S", "e2", "mut", "g", "2")], "struct_name string, entry string, op string, field string, value string")
    changes = N.state_changes(m, v)
    assert got(changes, "entry", "field", "value", "orphan") == [("e1", "f", "", False), ("e2", "f", "1", False), ("e2", "g", "2", True)]
    assert set(N.state_change_map(changes).first().fields) == {"f", "g"}


def test_chains_are_followed_to_the_end(spark):
    n = 230
    base = spark.createDataFrame([(k, 1, k + 1) for k in range(n)], "contract_id int, ord int, base_id int")
    contract = spark.range(n + 1).select(F.col("id").cast("int").alias("contract_id")).where("contract_id > 222 or contract_id % 50 = 0 or contract_id < 10")
    chain = G.inheritance_chain(base.where("contract_id > 222"), contract).where("contract_id = 223").orderBy("position").collect()
    assert [r.ancestor_id for r in chain] == list(range(223, n + 1))
    cycle = spark.createDataFrame([(1, 1, 2), (2, 1, 1)], "contract_id int, ord int, base_id int")
    assert got(G.inheritance_chain(cycle, cycle.select("contract_id")), "contract_id", "position", "ancestor_id") == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1)]


def test_closures_keep_few_parts(spark, monkeypatch):
    monkeypatch.setattr(G.Seen, "PARTS", 2)
    edge = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(12, 0)], "src int, dst int")
    found = G.dependency_closure(edge, spark.createDataFrame([(0,)], "root int"))
    assert got(found, "node", "depth") == sorted([(k, k) for k in range(1, 13)] + [(0, 13)], key=str)


def test_names_are_shown_once(spark):
    edge = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 5), (4, 6)], "src int, dst int")
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "d"), (6, "a")], "node int, name string")
    tree = G.bfs_tree(edge, spark.createDataFrame([(1,)], "root int"), names)
    assert got(tree, "node", "depth", "parent") == [(1, 0, None), (2, 1, 1), (4, 2, 2)]  # 3 bears the name of 2, so 5 is not reached; 6 that of 1


def test_deep_groups_braces_and_paths(spark):
    use = "use a::" + "".join(f"{{x{k}, p{k}::" for k in range(9)) + "last" + "}" * 9 + ";"
    imports, _ = C.import_scope(spark.createDataFrame([("f", use)], "path string, content string"))
    assert ("last", "a::" + "::".join(f"p{k}" for k in range(9)) + "::last") in got(imports, "short_name", "full_path")
    body = "contract C {\n  uint256 a;\n  function f() public { " + "if (x) { uint256 inner; " * 7 + "} " * 7 + "}\n  struct S { uint256 s; }\n  address b = address(0);\n}\n"
    storage = K.contract_extract(spark.createDataFrame([("c.sol", body)], "path string, content string"))["storage_var"]
    assert got(storage, "name", "type_name") == [("a", "uint256"), ("b", "address")]
    deep = "/".join(f"d{k}" for k in range(12))
    imports = spark.createDataFrame([(f"{deep}/f.sol", "../" * 11 + "x.sol"), ("f.sol", "./a/./b/../c.sol"), ("f.sol", "../up.sol"), ("f.sol", "@p/q.sol")], "path string, import_path string")
    files = spark.createDataFrame([("d0/x.sol",), ("a/c.sol",), ("../up.sol",), ("lib/q.sol",)], "path string")
    remaps = spark.createDataFrame([("@p/", "lib/"), ("@p/q.sol.very.long", "no/")], "prefix string, target string")
    assert got(R.resolve_import_path(imports, files, remaps), "target") == sorted([("d0/x.sol",), ("a/c.sol",), ("../up.sol",), ("lib/q.sol",)], key=str)
    assert R.resolve_import_path(imports, files, remaps.where("false")).where("target is not null").count() == 3


@pytest.mark.parametrize("hot", [0, 100_000])
def test_hot_names_are_resolved_by_pieces(spark, monkeypatch, hot):
    """Names that very many functions have: the callee is the first whose path contains the import's path, as for any other name."""
    monkeypatch.setattr(R, "HOT_PAIRS", hot)
    symbol = spark.createDataFrame([(k, "new", f"p/src/m{k}/lib.rs") for k in range(30)] + [(99, "new", "x/a.rs"), (98, "old", "x/a.rs"), (97, "old", "p/src/m2.rs")], "symbol_id int, name string, path string")
    calls = spark.createDataFrame([(c, "free", n, None) for c in (1, 2, 3, 4) for n in ("new", "old")], "caller_id int, call_kind string, callee_name string, qualifier string")
    callers = spark.createDataFrame([(1, "f1"), (2, "f2"), (3, "x/a.rs"), (4, "f4")], "caller_id int, path string")
    imports = spark.createDataFrame([("f1", "new", "crate::src::m2::new", 0), ("f1", "old", "crate::src::m2::old", 0), ("f2", "new", "crate::m17::new", 1), ("f2", "new", "crate::absent::module::new", 0), ("x/a.rs", "new", "self::new", 0), ("f4", "new", "crate::m1::new", 0)], "path string, name string, full_path string, rank int")
    found = R.resolve_free_call(calls, symbol, imports, callers)
    assert got(found.where("callee_id is not null"), "caller_id", "callee_name", "callee_id") == sorted([(1, "new", 2), (1, "old", 97), (2, "new", 17), (3, "new", 99), (4, "new", 1)], key=str)


def test_headers_of_every_form(spark):
    text = "pub async fn a() {\n}\npub(super) unsafe fn b(x: u8) {\n}\npub(crate) enum E {\n}\nfn plain() {\n}\n"
    f = spark.createDataFrame([("x", text)], "path string, content string")
    assert got(B.symbol_extract(f, B.FULL_RULES), "name", "is_public") == [("E", True), ("a", True), ("b", True), ("plain", False)]
    assert got(B.symbol_extract(f), "name") == [("plain",)]


def test_access_control_of_contracts(spark):
    f = spark.createDataFrame([("a", []), ("b", ["nonReentrant"]), ("c", ["onlyOwner", "onlyKeeper"]), ("d", ["onlyRole"])], "function_id string, modifiers array<string>")
    assert got(K.access_control(f), "function_id", "kind", "arg") == sorted([("a", "None", None), ("b", "None", None), ("c", "OnlyOwner", None), ("c", "CustomModifier", "onlyKeeper"), ("d", "RoleBased", "DEFAULT_ADMIN_ROLE")], key=str)


def test_reconciliation(spark):
    e = spark.createDataFrame([("a",), ("b",)], "name string")
    d = spark.createDataFrame([("b", "finished"), ("c", "to-review"), ("x", "deprecated")], "name string, status string")
    assert got(V.review_reconcile(e, d), "name", "status_change") == [("a", "new"), ("b", "kept"), ("c", "deprecated")]


def test_upsert_with_empty_program(spark):
    base = spark.createDataFrame([("f", "", 1), ("g", "p", 2), ("h", "q", 3)], "name string, program string, v int")
    delta = spark.createDataFrame([("f", "p", 9), ("g", "q", 8), ("h", "", 7)], "name string, program string, v int")
    assert got(S.upsert(base, delta, ["name", "program"], lenient="program"), "name", "program", "v") == [("f", "p", 9), ("g", "p", 2), ("g", "q", 8), ("h", "", 7)]


def test_metadata_round_trip(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "m.json").write_text('{"functions": [{"name": "f"}, {"name": "g", "line": 3}],\n "program": "x"}')
    schema = {"functions": T.StructType().add("name", "string").add("line", "integer"), "structs": T.StructType().add("name", "string").add("tags", T.ArrayType(T.StringType()))}
    tables = S.read_metadata(spark, [str(tmp_path / "m.json")], schema)
    assert got(tables["functions"], "name", "line") == [("f", 0), ("g", 3)] and tables["structs"].count() == 0
    S.write_metadata(tables, str(tmp_path / "out"), "x", "x")
    assert S.metadata_table(spark, str(tmp_path / "out"), "functions").count() == 2
    fewer = {"functions": tables["functions"].limit(1), "structs": tables["structs"].withColumn("name", F.raise_error(F.lit("lost")).cast("string")).unionByName(tables["functions"].select("name", F.lit(None).cast("array<string>").alias("tags")).withColumn("name", F.raise_error(F.lit("lost")).cast("string")))}
    with pytest.raises(Exception, match="lost"):
        S.write_metadata(fewer, str(tmp_path / "out"), "x", "x")
    assert S.metadata_table(spark, str(tmp_path / "out"), "functions").count() == 2  # a version that is not complete is not read
    S.write_metadata({"functions": tables["functions"].limit(1)}, str(tmp_path / "out"), "x", "x")
    assert S.metadata_table(spark, str(tmp_path / "out"), "functions").count() == 1
    with pytest.raises(ValueError):
        S.write_metadata(tables, str(tmp_path / "out"), "y", "x")


def test_scans_and_reports(spark, tmp_path):
    for name in ("a/src/x.rs", "a/tests/y.rs", "b/z.rs", "b/n.txt", "b/.gitkeep"):
        p = tmp_path / "c" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("fn f() {\n}\n")
    root = str(tmp_path / "c")
    assert S.corpus_scan(spark, root).count() == 3
    assert S.corpus_scan(spark, root, exclude=S.EXCLUDED).count() == 2
    tagged = S.scan_roots(spark, [(f"{root}/a", "A", False), (f"{root}/b", "B", True)], "*.rs")
    assert got(tagged.groupBy("program", "external").count(), "program", "external", "count") == [("A", False, 2), ("B", True, 1)]
    assert S.list_files(spark, root, exclude=["n.txt"], sort=True).count() == 3
    rows = spark.createDataFrame([("e", "s", 2, "two"), ("e", "s", 1, "one"), ("e", "t", 1, "x")], "entry_name string, section string, ord int, line string")
    S.write_reports(rows, str(tmp_path / "r"))
    assert next((tmp_path / "r" / "entry=e").glob("part-*")).read_text() == "# s:\n\none\ntwo\n\n# t:\n\nx\n"


CONTRACTS = """// SPDX {
pragma solidity ^0.8.0;
event Top(address a);
function free(uint256 x) pure returns (uint256) { return helper(x); }
struct S { uint a; }
abstract contract A is Base(1, "x}"), lib.Other {
    using X for uint256;
    mapping(address => mapping(uint => bool)) public seen;
    uint256[] private list; // function no() {}
    S public s = S({a: 1});
    event Moved(address who, uint v);
    error Bad(uint a);
    modifier only(uint r) virtual {
        require(r > 0, "}{");
        _;
    }
    constructor(address a) Base(2) {
        if (a > b) { x(); }
    }
    function f(uint256 a, bytes memory b, mapping(address => uint) storage m, function (uint) external cb)
        external
        payable
        only(1) access.auth
        returns (uint256, bytes memory)
    {
        for (uint i; i < 3; i++) { assembly { function y() -> z { } } }
    }
    function g() view internal virtual;
    receive() external payable {} function h(uint8[2] calldata z) public override(A, B) {}
}
function late() {}
event Last(uint a);
interface I { function ping(uint256) external; event P(); }
contract Open { function lost() {
"""


def test_contract_spans_and_bodies(spark):
    t = K.contract_extract(spark.createDataFrame([("a.sol", CONTRACTS), ("e.sol", ""), ("n.sol", None)], "path string, content string"))
    assert got(t["contract"], "contract", "contract_type", "bases", "start_line", "end_line") == [("A", "Abstract", ["Base", "Other"], 6, 30), ("I", "Interface", [], 33, 33)]
    f = t["contract_function"]
    assert got(f, "contract", "function_id", "start_line", "end_line") == sorted(
        [
            ("A", "a.sol|A|constructor(address)", 17, 19), ("A", "a.sol|A|f(uint256,bytes,mapping(address => uint),function (uint))", 20, 27), ("A", "a.sol|A|g()", 28, 28),
            ("A", "a.sol|A|receive()", 29, 29), ("A", "a.sol|A|h(uint8[2])", 29, 29), ("I", "a.sol|I|ping(uint256)", 33, 33),
        ],
        key=str,
    )
    assert got(f.where("name = 'f'"), "visibility", "mutability", "modifiers") == [("External", "Payable", ["only", "auth"])]
    assert [r.body is None for r in f.orderBy("name").collect()] == [False, False, True, False, True, False]
    assert got(t["contract_modifier"], "contract", "name", "start_line", "end_line") == [("A", "only", 13, 16)]
    assert got(t["event_def"], "contract", "name") == [("A", "Moved"), ("I", "P")]
    assert got(t["storage_var"], "name", "type_name", "visibility") == [("list", "uint256[]", "Private"), ("s", "S", "Public"), ("seen", "mapping(address => mapping(uint => bool))", "Public")]


def test_nearest_definitions(spark):
    base = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 4), (3, 1, 5), (4, 1, 6), (6, 1, 2)], "contract_id int, ord int, base_id int")
    names = spark.createDataFrame([(4, "f", "f4"), (3, "f", "f3"), (5, "g", "g5"), (1, "h", "h1"), (1, "h", "h1b"), (2, "h", "h2"), (6, "k", "k6")], "contract_id int, name string, dep_id string")
    found = K.nearest_definitions(base, names)
    assert got(found.where("contract_id in (1, 6)"), "contract_id", "name", "rank", "dep_id") == sorted([(1, "f", 1, "f3"), (1, "f", 2, "f4"), (1, "g", 1, "g5"), (1, "h", 1, "h1"), (1, "h", 2, "h1b"), (1, "k", 1, "k6"), (6, "k", 1, "k6"), (6, "h", 1, "h2"), (6, "f", 1, "f4")], key=str)


def test_containment_of_large_files(spark):
    n = 20_000
    lines = spark.range(1, 10 * n + 1).select(F.lit("f").alias("path"), F.col("id").cast("int").alias("line_no"))
    spans = spark.range(n).select(F.lit("f").alias("s_path"), F.col("id").alias("s"), (F.col("id") * 10 + 2).cast("int").alias("low"), (F.col("id") * 10 + 9).cast("int").alias("high")).unionByName(spark.createDataFrame([("f", -1, 1, 10 * n), ("g", -2, 1, 5), ("f", -3, 7, 3)], "s_path string, s long, low int, high int"))
    met = within(lines, spans, [("path", "s_path")], "line_no", F.col("low"), F.col("high"))
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()
    assert got(met.groupBy(F.col("s") >= 0).count(), "count") == [(8 * n,), (10 * n,)]
    assert got(met.where("s >= 0 and line_no not between s * 10 + 2 and s * 10 + 9"), "s") == []
    assert within(lines, spans, [("path", "s_path")], "line_no", F.col("low"), F.col("high"), "left_anti", F.col("s") >= 0).count() == 2 * n


def test_status_totals_in_one_pass(spark):
    docs = spark.createDataFrame([("a",), ("a",), ("deprecated",), (None,)], "status string")
    assert got(N.status_counts(docs), "status", "n") == sorted([("a", 2), ("deprecated", 1), (None, 1), ("total", 2)], key=str)


def test_reference_style_accounts_show_their_text(spark):
    entry = spark.createDataFrame([(1, "e1"), (2, "e2"), (3, "e3")], "struct_id int, name string")
    account = spark.createDataFrame([(1, 1, "a", "State"), (2, 1, "b", "View"), (3, 1, "c", "Info")], "struct_id int, ord int, account_name string, struct_name string")
    items = spark.createDataFrame([(k, 1, ["mut"]) for k in (1, 2, 3)], "struct_id int, ord int, items array<string>")
    text = spark.createDataFrame([(1, "pub struct A {\n  a: Account<State>, b: AccountInfo\n}"), (2, "pub struct B {\n  b: &'a AccountView,\n}"), (3, "struct C { c: AccountInfo }")], "struct_id int, content string")
    found = Q.report_accounts(entry, account, items, text)
    assert got(found, "entry_name", "ord", "line") == sorted([("e1", 1, "#[account(mut)] pub a: State"), ("e2", 1, "pub struct B {"), ("e2", 2, "  b: &'a AccountView,"), ("e2", 3, "}"), ("e3", 1, "struct C { c: AccountInfo }")], key=str)


def test_rejects_and_names_by_file(spark):
    files = {
        "a/x.sol": 'import "./y.sol"; import {B as Q} from "../b/x.sol"; contract C is B, Q, None_ { function f() external { g(); } }',
        "a/y.sol": 'import "./x.sol"; contract B { function g() internal {} }',
        "b/x.sol": "contract B { function h() internal {} } contract D is B { }",
        "b/z.sol": 'import "../a/y.sol"; import "./x.sol"; contract E is B { }',
        "c/open.sol": "contract F { /* never closed",
        "c/wide.sol": "contract G { function g() public { } ",
    }
    t = Y.contract_entries(spark.createDataFrame(list(files.items()), "path string, content string"), spark.createDataFrame([], "prefix string, target string"))
    assert got(t["base"], "contract_id", "ord", "base_id") == [("a/x.sol|C", 1, "a/y.sol|B"), ("a/x.sol|C", 2, "b/x.sol|B"), ("b/x.sol|D", 1, "b/x.sol|B")]
    assert got(t["reject"], "path", "name", "reason") == sorted([("a/x.sol", "None_", "unknown base"), ("b/z.sol", "B", "ambiguous base"), ("c/open.sol", None, "open comment"), ("c/wide.sol", None, "unbalanced brackets")], key=str)
    assert got(t["contract"], "contract_id") == [(x,) for x in ("a/x.sol|C", "a/y.sol|B", "b/x.sol|B", "b/x.sol|D", "b/z.sol|E")]
    assert got(t["tree"], "node", "depth") == [("a/x.sol|C|f()", 0), ("a/y.sol|B|g()", 1)]


def test_linearization_of_cycles_and_of_deep_chains(spark):
    """Post-order walks with a visited rule, as a plain walk does them."""
    rng = random.Random(2)
    edges = [(k, 1, k + 1) for k in range(90)] + [(200, 1, 201), (201, 1, 202), (201, 2, 204), (202, 1, 200), (202, 2, 203), (205, 1, 201), (205, 2, 10)]
    edges += [(300 + k, o, 300 + rng.randrange(12)) for k in range(12) for o in (1, 2, 3)]
    bases = {}
    for c, o, b in edges:
        bases.setdefault(c, []).append((o, b))

    def walk(c, out, visited):
        if c not in visited:
            visited.add(c)
            for _, b in sorted(bases.get(c, []), reverse=True):
                walk(b, out, visited)
            out.append(c)
        return out

    found = {}
    for r in G.linearize(spark.createDataFrame(edges, "contract_id int, ord int, base_id int"), max_iter=20).orderBy("contract_id", "position").collect():
        found.setdefault(r.contract_id, []).append(r.ancestor_id)
    assert found == {c: walk(c, [], set()) for c in {x for c, _, b in edges for x in (c, b)}}


def test_deep_closures_take_few_rounds(spark):
    n = 5_000
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(n)] + [(10_000 + rng.randrange(60), 10_000 + rng.randrange(60)) for _ in range(70)] + [(n, n - 3), (20_000, 20_001)]
    edge, roots = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,), (4_000,), (10_001,), (10_002,), (20_000,), (99,)], "root long")
    rounds = []
    plain = G.durable
    try:
        G.durable = lambda df: rounds.append(1) or plain(df)
        found = got(G.dependency_closure(edge, roots, plain_rounds=6), "root", "node", "depth")
    finally:
        G.durable = plain
    below = {}
    for a, b in edges:
        below.setdefault(a, set()).add(b)
    want = []
    for (root,) in [(0,), (4_000,), (10_001,), (10_002,), (20_000,), (99,)]:
        depth, level, met = 0, {root}, set()
        while level:
            depth += 1
            level = {b for a in level for b in below.get(a, ())} - met
            met |= level
            want += [(root, b, depth) for b in level]
    assert found == sorted(want, key=str) and len(rounds) < 16
