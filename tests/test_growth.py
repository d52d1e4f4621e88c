"""Joins over rows that are made of texts: nothing but fixed word lists goes through the driver."""

from __future__ import annotations

from pathlib import Path

import pytest

from srcloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")

#: Queries over text, and the fixed tables that they broadcast: the noise words.
WORDS = {
    "e2_block_in_range": 0, "e4_symbol_extract": 0, "e5_symbol_classify": 0, "e5_symbol_classify_kinds": 0, "e12_signature_params": 0, "e13_brace_blocks": 0,
    "e22_validations_in_functions": 0, "e24_doc_start": 0, "e7_call_sites": 1, "e7_call_names": 1, "e7_call_sites_of_all_kinds": 1,
}


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.mark.parametrize("name", sorted(WORDS))
def test_texts_are_not_broadcast(spark, name):
    """Spark's estimate of lines and symbols is that of the scanned columns, so it took them for small at any size."""
    assert broadcasts(registry.QUERIES[name](spark, SF)) == WORDS[name]


def test_symbols_know_their_heads_without_a_join(spark):
    from srcloom.operators.blocks import symbol_extract

    files = spark.createDataFrame([("a.rs", "pub fn one() {\n}\nimpl A for B {\n}\n")], "path string, content string")
    found = symbol_extract(files)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.name, r.is_public, r.start_line, r.end_line) for r in found.collect()) == [("A for B", False, 3, 4), ("one", True, 1, 2)]


def test_contract_files_are_judged_and_cut_once(spark):
    """Each table of the corpus read the text again, from one task, and looked for problems in it again."""
    from srcloom.operators.contracts import contract_extract
    from srcloom.operators.solidity import contract_corpus
    from srcloom.plans.solidity import damaged_files

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    files = damaged_files(spark, SF)
    assert all("parquet" not in plan(t).lower() for k, t in contract_extract(files).items() if k != "contract")
    t = contract_corpus(files, spark.createDataFrame([], "prefix string, target string"))
    assert "regexp_extract_all" not in plan(t["reject"]) and "parquet" not in plan(t["reject"]).lower()
    why = {(r.path, r.reason) for r in t["reject"].where("item = 'file'").collect()}
    assert ("src/V0.sol", "open comment") in why and ("src/V3.sol", "unbalanced brackets") in why and not any(p == "src/V1.sol" for p, _ in why)


def test_calls_meet_the_first_of_equal_implementations_only(spark):
    """Functions met every implementation around them: their product, which was then sorted."""
    from srcloom.operators import resolve as R

    impl = spark.createDataFrame([(i, f"T{i % 2}", "a.rs", 0, 900) for i in range(40, 0, -1)], "impl_id int, impl_to string, path string, start_line int, end_line int")
    symbol = spark.createDataFrame([(100 + i, f"f{i % 5}", "a.rs", 10 * i + 1, 10 * i + 5) for i in range(30)], "symbol_id int, name string, path string, start_line int, end_line int")
    every, some = R.impl_members(impl, symbol), R.first_members(impl, symbol)
    assert (every.count(), some.count()) == (1200, 60)
    static = spark.createDataFrame([(1, "static", f"f{i}", f"T{i % 3}") for i in range(6)], "caller_id int, call_kind string, callee_name string, qualifier string")
    method = spark.createDataFrame([(100 + i, "method", f"f{i % 7}", "self") for i in range(35)], "caller_id int, call_kind string, callee_name string, qualifier string")
    params = spark.createDataFrame([], "symbol_id int, param_name string, type_name string, context_inner string")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(R.resolve_static_call(static, symbol, some)) == rows(R.resolve_static_call(static, symbol, every))
    found = R.resolve_method_call(method, params, some, impl)
    assert rows(found) == rows(R.resolve_method_call(method, params, every, impl))
    assert {(r.caller_id, r.callee_id) for r in found.collect() if r.caller_id == 107} == {(107, 100)}  # f0 of T1, the type of implementation 1


def test_local_imports_meet_one_function_of_a_name(spark):
    """A call met all functions of its name in its file."""
    from srcloom.operators import resolve as R

    symbol = spark.createDataFrame([(i, "f", "a.rs") for i in range(9, 0, -1)] + [(10, "f", "b.rs")], "symbol_id int, name string, path string")
    calls = spark.createDataFrame([(50, "free", "f")], "caller_id int, call_kind string, callee_name string")
    imports = spark.createDataFrame([("a.rs", "f", "self::f", 0)], "path string, name string, full_path string, rank int")
    found = R.resolve_free_call(calls, symbol, imports, spark.createDataFrame([(50, "a.rs")], "caller_id int, path string"))
    assert [(r.callee_id, r.rule) for r in found.collect()] == [(1, "import")]
    keys = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [callee_name" in x and "c_path" in x]
    assert keys


def test_ancestries_are_arrays_made_once(spark):
    """Every pair of contract and ancestor had a path, and all of them were written again in each round."""
    import random

    from srcloom.operators import graph as G

    rng = random.Random(5)
    rows = [(k, o, rng.randrange(k)) for k in range(1, 40) for o in (1, 2, 3) if o == 1 or rng.random() < 0.5] + [(50, 1, 51), (51, 1, 50), (52, 1, 51), (52, 2, 7), (60, 1, 60)]
    base = spark.createDataFrame(rows, "contract_id long, ord int, base_id long")
    bases = {}
    for c, o, b in rows:
        bases.setdefault(c, []).append((o, b))

    def nearest(c):
        seen, level = [c], [c]
        while level:
            level = list(dict.fromkeys(b for a in level for _, b in sorted(bases.get(a, [])) if b not in seen))
            seen += level
        return seen

    found = {}
    for r in G.inheritance_chain(base, base.select("contract_id").union(base.select("base_id"))).orderBy("contract_id", "position").collect():
        found.setdefault(r.contract_id, []).append(r.ancestor_id)
    assert found == {c: nearest(c) for c in {x for r in rows for x in (r[0], r[2])}}
    pairs = spark.createDataFrame([(c, b) for c in found for b in found], "contract_id long, base_id long")
    assert {(r.contract_id, r.base_id) for r in G.inherits_from(base, pairs).collect() if r.inherits} == {(c, b) for c in found for b in found[c][1:]}
    plan = G.linearize(base.where("contract_id < 50"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("SortMergeJoin") <= 1  # places are those in the arrays


#: What the query gave before, by the patterns alone.
READ = [(0, 'mut', None, None), (1, 'constraint', 'x = 1', None), (3, 'constraint', 'k==2 = 3', None), (4, 'owner', 'q', None), (5, 'address', 'p', 'E'), (6, 'bump', None, None), (8, 'has_one', 'z', None)]


def test_attributes_are_read_once(spark):
    """Patterns ran once for the filter and again for each column, and all texts were folded piece by piece."""
    from pyspark.sql import functions as F

    from srcloom.functions.text import split_top_level
    from srcloom.operators.accounts import account_attrs

    def plain(text):
        done, now, depth = [], "", 0
        for c in text:
            if c == "," and depth == 0:
                done, now = done + [now], ""
                continue
            depth += 1 if c in "([{<" else -1 if c in ")]}>" and depth else 0
            now += c
        return [s.strip(" ") for s in done + [now] if s.strip(" ")]

    texts = ["", ",", "a,b", "a(b,c),d", "x -> y, z", "a>b,c<d,e", "((((((((a,b)))))))),c", "f(a, [b, {c, <d, e>}]), g", "a],b(", "a(b]c,d", " , ,a ,", "a\n,b(\n,),c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_top_level(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == {t: plain(t) for t in texts}
    attr = "mut, x = 1, a != b, k == 2 = 3, owner=q, address = p @ E, bump, bump =, has_one = z\n, payer = \np, close <= d"
    found = account_attrs(spark.createDataFrame([(1, 1, attr)], "struct_id int, ord int, attr string"))
    assert sorted((r.pos, r.key, r.value, r.error) for r in found.collect()) == READ
    filters = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert not any("regexp" in x.lower() or "rlike" in x.lower() for x in filters)


def test_files_are_cut_into_lines_once(spark):
    """Each symbol met the text of its file and cut all of it into lines."""
    from srcloom.operators.paths import slice_source

    files = spark.createDataFrame([("a", "1\n2\n3"), ("b", None)], "path string, content string")
    symbol = spark.createDataFrame([(1, "a", 2, 3), (2, "a", 0, 1), (3, "a", 3, 9), (4, "a", 3, 2), (5, "a", None, 2), (6, "b", 1, 1), (7, "c", 1, 1)], "symbol_id int, path string, start_line int, end_line int")
    found = slice_source(files, symbol)
    assert {(r.symbol_id, r.content) for r in found.collect()} == {(1, "2\n3"), (2, "1"), (3, "3"), (4, ""), (5, "1\n2"), (6, None)}
    plan = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    join = next(k for k, x in enumerate(plan) if "Join" in x)
    assert not any("split(" in x for x in plan[:join]) and any("split(" in x for x in plan[join:])


def test_lines_are_judged_once_and_only_marks_are_sorted(spark):
    """Blocks with validations in ifs were scanned three times, and all lines were sorted with their text."""
    from srcloom.operators import blocks as B

    text = "fn a() {\n    if x {\n        let y = 1;\n        require!(x);\n    }\n    if z {\n    }\n    assert!(z);\n}"
    lines = B.source_lines(spark.createDataFrame([("a.rs", text)], "path string, content string"))
    found = B.block_scan(lines)
    assert {(r.kind, r.start_line, r.end_line) for r in found.collect()} == {("Function", 1, 9), ("If", 2, 5), ("IfValidation", 2, 5), ("If", 6, 7), ("Validation", 4, 4), ("Validation", 8, 8)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("posexplode") == 1
    first = [x for x in plan.splitlines() if "Window" in x][-1]
    assert "line#" not in first.replace("line_no#", "")
    twice = B.block_scan(lines, (*B.RULES, B.BlockRule("If", ("let",), ("=",), ("}",))), ["If"])
    assert sorted((r.start_line, r.end_line) for r in twice.collect()) == [(2, 5), (6, 7)]


def test_files_of_a_task_are_bounded(spark, monkeypatch):
    """Derived files were dealt over as many tasks as their compressed texts needed: one for each core."""
    from srcloom.plans import fixtures

    monkeypatch.setattr(fixtures, "FILES_OF_TASK", 10)
    files = spark.range(95).selectExpr("cast(id as string) as path", "'x' as content")
    assert fixtures.spread(files).rdd.getNumPartitions() == 10


def test_bodies_are_read_once(spark):
    """Calls by name and calls on names were two reads of the bodies."""
    from srcloom.operators.calls import sol_call_sites

    f = spark.createDataFrame([(1, "{ a(b.c(1)); require(x); abi.encode(d()); // e()\n b . c (2); }"), (1, "{ a(); }"), (2, None)], "function_id int, body string")
    found = sol_call_sites(f)
    assert sorted((r.function_id, r.callee) for r in found.collect()) == [(1, "a"), (1, "b.c"), (1, "c"), (1, "d"), (1, "encode")]
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_written_by_more_than_one_task(spark, tmp_path):
    """The few bytes of the documents were one partition to Spark, so one task made every file."""
    from srcloom.sources.files import write_reports

    rows = spark.createDataFrame([(f"e{i}", "a", 1, f"line {i}") for i in range(64)], "entry_name string, section string, ord int, line string")
    write_reports(rows, str(tmp_path / "out"))
    files = [p.name for p in (tmp_path / "out").glob("entry=*/part-*.txt")]
    assert len(files) == 64 and len({f[:10] for f in files}) > 1
    assert (tmp_path / "out" / "entry=e7").is_dir() and (tmp_path / "out" / "_SUCCESS").exists()


def test_edges_do_not_go_through_the_driver_in_each_round(spark, monkeypatch):
    """Edges below Spark's limit for broadcasts were gathered at the driver again in every round of a closure or tree."""
    from srcloom.operators import graph as G

    plans, keep = [], G.durable
    monkeypatch.setattr(G, "durable", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), keep(df))[1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "src int, dst int")
    roots = spark.createDataFrame([(0,), (3,)], "root int")
    assert {(r.root, r.node, r.depth) for r in G.dependency_closure(edges, roots).collect()} == {(0, n, n) for n in range(1, 7)} | {(3, n, n - 3) for n in range(4, 7)}
    assert {(r.root, r.node, r.parent) for r in G.bfs_tree(edges, roots).where("depth > 0").collect()} == {(0, n, n - 1) for n in range(1, 7)} | {(3, n, n - 1) for n in range(4, 7)}
    rounds = [p for p in plans if "src" in p and "Join Inner" in p]
    assert len(rounds) > 8 and all("rightHint=(strategy=merge)" in p for p in rounds)


def test_checklists_read_the_validations_once(spark):
    """The texts to look for and the rows that ask for them were derived from the accounts one after the other."""
    from srcloom.operators.reports import report_constraint_checklist

    plan = registry.QUERIES["r2_report_constraint_checklist"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in x and "l_orderkey" in x for x in plan.splitlines()) == 1
    entry = spark.createDataFrame([(f"e{i}", i % 2, p) for i, p in enumerate(("a.rs", "a.rs", "a.rs", "gone.rs"))], "name string, struct_id int, path string")
    account = spark.createDataFrame([(0, 1, ["x == 1 @ E", "no"]), (1, 1, ["y\nz", "x == 1"])], "struct_id int, ord int, validations array<string>")
    lines = spark.createDataFrame([("a.rs", k, t) for k, t in ((5, "é first"), (6, "y"), (7, "if x == 1 {"), (8, "z"), (9, "x == 1"))], "path string, line_no int, line string")
    got = {(r.entry_name, r.ord): r.line for r in report_constraint_checklist(entry, account, lines, "u/").collect()}
    first = {"e0": ("x == 1 @ E u/a.rs#L7", "no u/a.rs#L1"), "e1": ("y\nz u/a.rs#L1", "x == 1 u/a.rs#L7"), "e3": ("y\nz u/gone.rs#L1", "x == 1 u/gone.rs#L1")}
    first["e2"] = first["e0"]
    assert got == {(e, k): f"- [ ] {t}" for e, ts in first.items() for k, t in enumerate(ts, 1)}


#: Queries over contract files; the remappings, a table of the size of a configuration, are all that they broadcast.
CONTRACTS = ["a8_contract_rejects", "a8_counts_from_text", "corpus_contract_entries", "g2_contract_entry_tree", "r7_contract_entry_report"]


def plans_of(monkeypatch, run) -> list[str]:
    """The plans of what is kept on the way to a result, and that of the result."""
    from srcloom.operators import contracts, graph, resolve, solidity
    from srcloom.plans import resolving

    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (contracts, graph, resolve, solidity, resolving):
        monkeypatch.setattr(module, "durable", lambda df, keep=module.durable: (plans.append(plan(df)), keep(df))[1])
    plans.append(plan(run()))
    return plans


@pytest.mark.parametrize("name", CONTRACTS)
def test_contracts_are_not_broadcast(spark, monkeypatch, name):
    """Ids are long and much alike, so what Spark took for 10 MB were 230 MB at the driver, many times."""
    plans = plans_of(monkeypatch, lambda: registry.QUERIES[name](spark, SF))
    assert [p.count("BroadcastExchange") for p in plans if "BroadcastExchange" in p] == [1]
    assert sum("SortMergeJoin" in p for p in plans) > 2


def test_rejects_need_no_functions(spark, monkeypatch):
    """All trees and dependencies were made for them."""
    plans = plans_of(monkeypatch, lambda: registry.QUERIES["a8_contract_rejects"](spark, SF))
    assert not any("modifiers" in p or "function_id" in p for p in plans)


def test_call_graphs_are_not_broadcast(spark, monkeypatch):
    """Names, members, parameters and edges of calls, and the ids of the list, went through the driver where Spark took them for small."""
    plans = plans_of(monkeypatch, lambda: registry.QUERIES["corpus_entry_call_graph"](spark, SF))
    # the noise words are a fixed list
    assert [p.count("BroadcastExchange") for p in plans if "BroadcastExchange" in p] == [1]


def test_functions_of_ancestors_are_listed_where_contracts_meet(spark):
    """Each contract met each function of each ancestor by the ancestor, and all these rows were dealt and sorted again by contract."""
    from srcloom.operators import graph as G

    base = spark.createDataFrame([(3, 1, 1), (3, 2, 2), (4, 1, 3), (1, 1, 9), (2, 1, 9)], "contract_id long, ord int, base_id long")
    f = spark.createDataFrame([(9, "a", 0), (9, "b", 1), (1, "a", 0), (2, "a", 0), (2, "a", 0), (2, "a", 1), (4, "c", 0), (8, "a", 0)], "contract_id long, name string, n_params int")
    lin = G.linearize(base)
    found = G.effective_functions(lin, f)
    last, own = {}, {}
    for c, name, n in f.collect():
        own.setdefault(c, set()).add((name, n))
    for r in lin.orderBy("contract_id", "position").collect():
        last.update({(r.contract_id, *k): r.ancestor_id for k in own.get(r.ancestor_id, ())})
    assert sorted((r.contract_id, r.name, r.n_params, r.defined_in) for r in found.collect()) == sorted((*k, a) for k, a in last.items())
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    explode, dealt = (next(k for k, x in enumerate(plan) if w in x) for w in ("explode(fs", "RepartitionByExpression"))
    assert explode < dealt and not any("Window" in x for x in plan)


def test_functions_are_kept_without_their_texts(spark, monkeypatch):
    """Ids and bodies of all functions were kept whole, and so were the definitions of each contract."""
    from srcloom.operators import contracts
    from srcloom.plans import contracting

    kept = []
    for module in (contracts, contracting):
        monkeypatch.setattr(module, "compact", lambda df, keep=module.compact: kept.append(keep(df)) or kept[-1])
    found = registry.QUERIES["j14_sol_direct_deps"](spark, SF)
    assert kept[0].columns == ["contract_id", "name", "n_params", "visibility", "modifier"] and kept[-1].count() > 0
    assert all("parquet" in df._jdf.queryExecution().optimizedPlan().toString().lower() for df in kept)
    assert broadcasts(found) == 0
