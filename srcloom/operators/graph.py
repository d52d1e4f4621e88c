"""Graph operators over edge tables, as loops of joins.

Each round joins the newest rows with the edges, takes what was not seen before
by an anti join, and keeps it in the checkpoint folder, so that plans stay short
and a lost executor costs nothing but its tasks. The only thing that reaches the
driver is whether a round found anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom.operators.components import components
from srcloom.operators.containment import by_key
from srcloom.sources.shared import durable


#: Rounds after which deep parts of a graph are walked in tasks; edges of a component that may be; roots of one such task.
PLAIN_ROUNDS, SMALL, ROOTS = 24, 200_000, 32


def dependency_closure(edge: DataFrame, roots: DataFrame, max_iter: int | None = None, multiplicity: bool = False, plain_rounds: int = PLAIN_ROUNDS) -> DataFrame:
    """(root, node, depth): every node reachable from a root over at least one edge, with the fewest edges.

    A root on a cycle reaches itself. multiplicity adds n_callers, how many
    reachable nodes (the root included) call the node. What is deeper than plain_rounds is
    not followed edge by edge over the cluster: connected parts of the graph with up
    to SMALL edges (a program, a repository) are walked to their end in one task for some roots
    each, so a chain of n nodes takes plain_rounds and some log n rounds. Larger parts
    go on in rounds.
    """
    edges = durable(edge.select("src", "dst").where("src is not null and dst is not null").distinct())
    start = roots.select("root").distinct()
    new = durable(start.join(by_key(edges), F.col("root") == F.col("src")).select("root", F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(1)))
    seen, depth = Seen(new, ["root", "node"]), 1
    deep = None
    while (max_iter is None or depth < max_iter) and not new.isEmpty():
        if depth == plain_rounds and deep is None and max_iter is None:
            walked, new = _deep_walks(edges, new)
            deep = (walked, walked.select("root").distinct())
            if new.isEmpty():
                break
        depth += 1
        step = _next(new, edges).select("root", F.col("dst").alias("node")).distinct()
        new = seen.add(step.withColumn("depth", F.lit(depth)))
    found = seen.rows()
    if deep is not None:
        found = durable(found.join(deep[1], "root", "left_anti").unionByName(deep[0]))
    if not multiplicity:
        return found
    callers = found.select("root", F.col("node").alias("src")).unionByName(start.select("root", F.col("root").alias("src"))).distinct()
    counts = callers.join(edges, "src").groupBy("root", F.col("dst").alias("node")).agg(F.count("*").alias("n_callers"))
    return found.join(counts, ["root", "node"])


def _next(new: DataFrame, edges: DataFrame) -> DataFrame:
    """new with the edges of its nodes. They meet by key: edges that Spark takes for small would go through the driver in every round."""
    return new.join(by_key(edges), F.col("node") == F.col("src"))


def _deep_walks(edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, node, depth) of all roots of new that lie in a small connected part, walked whole; and the rows of new of the other roots."""
    part = durable(components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))))
    of = part.select(F.col("node").alias("src"), F.col("root").alias("part"))
    sized = durable(edges.join(of, "src").groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") <= SMALL))
    mine = new.select("root").distinct().join(of.withColumnRenamed("src", "root"), "root").join(sized, "part", "left_semi")
    groups = durable(mine.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("root"))).withColumn("k", F.floor(F.col("k") / ROOTS)))
    wanted = groups.select("part", "k").distinct()
    inside = edges.join(of, "src").join(wanted, "part").select(F.col("part").alias("of_part"), F.col("k").alias("of_k"), "src", "dst")
    kind = edges.schema["src"].dataType.simpleString()

    def walk(key, roots, links):
        import pandas as pd

        below: dict = {}
        for a, b in zip(links["src"].tolist(), links["dst"].tolist(), strict=True):
            below.setdefault(a, []).append(b)
        out: list[tuple] = []
        for root in roots["root"].tolist():
            depth, level, met = 0, [root], set()
            while level:
                depth += 1
                level = list(dict.fromkeys(b for a in level for b in below.get(a, ()) if b not in met))
                met.update(level)
                out += [(root, b, depth) for b in level]
        return pd.DataFrame(out, columns=["root", "node", "depth"])

    walked = groups.groupBy("part", "k").cogroup(inside.groupBy("of_part", "of_k")).applyInPandas(walk, f"root {kind}, node {kind}, depth int")
    return durable(walked), durable(new.join(groups.select("root"), "root", "left_anti"))


class Seen:
    """Rows found so far, by key.

    Each round's new rows are kept in parts; whenever there are more than PARTS
    they are written as one, dealt by the key. So a round reads few parts, and a
    row is written again once in PARTS rounds at most.
    """

    PARTS = 8

    def __init__(self, rows: DataFrame, keys: list[str]):
        self.keys, self.parts = keys, [rows]

    def rows(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out

    def new(self, rows: DataFrame) -> DataFrame:
        """Those rows whose key was not seen."""
        return rows.join(by_key(self.rows().select(*self.keys)), self.keys, "left_anti").select(*rows.columns)

    def add(self, rows: DataFrame) -> DataFrame:
        """The rows whose key was not seen, which are now."""
        found = durable(self.new(rows))
        self.add_new(found)
        return found

    def add_new(self, found: DataFrame) -> None:
        """Rows that are kept already and whose keys are known to be new."""
        self.parts.append(found)
        if len(self.parts) > self.PARTS:
            self.parts = [durable(self.rows().repartition(*self.keys))]


def bfs_tree(edge: DataFrame, roots: DataFrame, names: DataFrame | None = None, across_roots: bool = False) -> DataFrame:
    """(root, node, depth, parent): breadth-first levels, each node below the least of its possible parents.

    names (node, name), if given, also drops a node whose name was shown at a
    lesser depth, or by a lesser node of the same depth. across_roots shows each
    node once, below the least root that reaches it.
    """
    edges = durable(edge.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    new = durable(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast(roots.schema["root"].dataType).alias("parent")).distinct())
    seen, depth = Seen(new, ["root", "node"]), 0
    shown = Seen(durable(new.join(names, "node").select("root", "name").distinct()), ["root", "name"]) if names is not None else None
    while not new.isEmpty():
        depth += 1
        step = _next(new, edges).groupBy("root", "dst").agg(F.min("src").alias("parent")).withColumnRenamed("dst", "node")
        step = step.select("root", "node", F.lit(depth).alias("depth"), "parent")
        if shown is not None:
            # of nodes of one name the least stays, and only if the name was not shown before
            named = seen.new(step).join(names, "node").withColumn("k", F.row_number().over(Window.partitionBy("root", "name").orderBy("node"))).where("k = 1").drop("k")
            named = durable(shown.new(named))
            shown.add(named.select("root", "name"))
            step = named.select("root", "node", "depth", "parent")
        new = seen.add(step)
    found = seen.rows()
    if across_roots:
        first = found.groupBy("node").agg(F.min("root").alias("root"))
        found = found.join(first, ["root", "node"], "left_semi")
    return found


def _ancestries(edges: DataFrame, top: Callable[[Column], Column], made: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(c, row) for each node of edges whose ancestry has no cycle, and the nodes (c) of the others. edges: c, b, r (rank of base b of c).

    row is an array over the node's ancestry. top makes it for a node without bases, made for one with bases from
    the node and the array of structs (r, row) of its bases, in order of ranks. A row is made once, in the round
    in which the last of its bases has one, from rows of that and earlier rounds: nothing that was found is written
    again, and what is kept is one array for each node. There is one round for each level.
    """
    edges = edges.select("c", F.col("b").cast(edges.schema["c"].dataType).alias("b"), "r")
    total = edges.groupBy("c").agg(F.count("*").alias("n"))
    links = durable(edges.join(by_key(total), "c"))
    tops = edges.select(F.col("b").alias("c")).distinct().join(by_key(total), "c", "left_anti")
    new = durable(tops.select("c", top(F.col("c")).alias("row")))
    found, waiting = Seen(new, ["c"]), None
    while not new.isEmpty():
        step = by_key(links).join(by_key(new.withColumnRenamed("c", "x")), F.col("b") == F.col("x")).select(links["c"], "n", "r", "row")
        step = step if waiting is None else waiting.unionByName(step)
        met = by_key(step).groupBy("c").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("r", "row"))).alias("got"))
        whole = F.size("got") == F.col("n")
        state = durable(met.select("c", "n", F.when(whole, made(F.col("c"), F.col("got"))).alias("row"), F.when(~whole, F.col("got")).alias("got")))
        new = state.where("row is not null").select("c", "row")
        waiting = state.where("row is null").select("c", "n", F.explode("got").alias("g")).select("c", "n", "g.*")
        found.add_new(new)
    rows = found.rows()
    return rows, durable(total.select("c").join(by_key(rows.select("c")), "c", "left_anti"))


def _post_order(c: Column, got: Column) -> Column:
    """The order in which a walk is done with a node's ancestry: the rows of the bases one after the other, each without what was met; then the node.

    What was met is closed upwards, so leaving it out of a base's own order gives the order of the walk.
    """
    return F.concat(F.array_distinct(F.flatten(F.transform(got, lambda g: g["row"]))), F.array(c))


def _by_distance(c: Column, got: Column) -> Column:
    """The ancestry in breadth-first order, an array for each distance: what the bases have one step nearer, in their order, without what is nearer to the node."""
    none = F.slice(F.array(c), 1, 0)
    start = F.struct(F.array(F.array(c)).alias("done"), none.alias("seen"))

    def step(acc: Column, d: Column) -> Column:
        level = F.array_except(F.flatten(F.transform(got, lambda g: F.coalesce(F.get(g["row"], d), none))), acc["seen"])
        return F.struct(F.concat(acc["done"], F.array(level)).alias("done"), F.concat(acc["seen"], level).alias("seen"))

    last = F.array_max(F.transform(got, lambda g: F.size(g["row"]))) - 1
    return F.filter(F.aggregate(F.sequence(F.lit(0), last), start, step, lambda acc: acc["done"]), lambda level: F.size(level) > 0)


def _walks(edges: DataFrame, roots: DataFrame, reach: DataFrame) -> DataFrame:
    """(contract_id, position, ancestor_id): the post-order of a walk from each root that visits nothing twice.

    For contracts above a cycle, where ways have no least one; a root and the edges that it reaches are one group.
    """
    mine = roots.select(F.col("c").alias("root"), F.col("c").alias("node")).unionByName(roots.join(reach, F.col("c") == F.col("root")).select("root", "node")).distinct()
    rows = mine.join(edges, F.col("node") == F.col("c")).select("root", "c", "b", "r")
    kind = edges.schema["c"].dataType.simpleString()

    def walk(key, frame):
        import pandas as pd

        below: dict = {}
        for c, b in frame.sort_values("r")[["c", "b"]].itertuples(index=False):
            below.setdefault(c, []).append(b)
        out, visited = [], {key[0]}
        stack = [(key[0], iter(below.get(key[0], [])))]
        while stack:
            node, rest = stack[-1]
            child = next((b for b in rest if b not in visited), None)
            if child is None:
                out.append(node)
                stack.pop()
            else:
                visited.add(child)
                stack.append((child, iter(below.get(child, []))))
        return pd.DataFrame({"contract_id": key[0], "position": range(1, len(out) + 1), "ancestor_id": out})

    return rows.groupBy("root").applyInPandas(walk, f"contract_id {kind}, position int, ancestor_id {kind}")


def _ranked(base: DataFrame) -> DataFrame:
    """(c, b, r): the bases of each contract with ranks from the right."""
    right = base.withColumn("r", F.row_number().over(Window.partitionBy("contract_id").orderBy(F.desc("ord"))))
    return durable(right.select(F.col("contract_id").alias("c"), F.col("base_id").alias("b"), "r").where("c is not null and b is not null and c <> b"))


def linearize(base: DataFrame, contracts: DataFrame | None = None, max_iter: int | None = None) -> DataFrame:
    """(contract_id, position, ancestor_id): post-order of the ancestry with bases from right to left; the contract itself last.

    A contract's order is made from those of its bases (_ancestries), one array for each contract, in one
    round for each level. Contracts above a cycle, whose bases never have an order, are walked one by one,
    visiting nothing twice. max_iter, after how many rounds cycles were looked for, has no effect any more.
    """
    edges = _ranked(base)
    own = (contracts if contracts is not None else base.select("contract_id").unionByName(base.select(F.col("base_id").alias("contract_id")))).select("contract_id").distinct()
    rows, above = _ancestries(edges, F.array, _post_order)
    placed = rows.select(F.col("c").alias("contract_id"), F.posexplode("row").alias("position", "ancestor_id"))
    if contracts is not None:  # others have a place among ancestors only
        asked = own.withColumn("own", F.lit(True))
        placed = placed.join(by_key(asked), "contract_id", "left").where(F.col("own") | (F.col("contract_id") != F.col("ancestor_id"))).drop("own")
    found = placed.select("contract_id", (F.col("position") + 1).alias("position"), "ancestor_id")
    itself = own.join(by_key(rows.select(F.col("c").alias("contract_id"))), "contract_id", "left_anti")
    if not above.isEmpty():
        reach = dependency_closure(edges.select(F.col("c").alias("src"), F.col("b").alias("dst")), above.select(F.col("c").alias("root")))
        found = found.unionByName(durable(_walks(edges, above, reach)))
        itself = itself.join(above.withColumnRenamed("c", "contract_id"), "contract_id", "left_anti")
    return found.unionByName(itself.select("contract_id", F.lit(1).alias("position"), F.col("contract_id").alias("ancestor_id")))


def inheritance_chain(base: DataFrame, contract: DataFrame) -> DataFrame:
    """(contract_id, position, ancestor_id): breadth-first order over known contracts, bases in order; as deep as they go."""
    known = contract.select("contract_id").distinct()
    usable = base.join(by_key(known.select(F.col("contract_id").alias("base_id"))), "base_id", "left_semi").join(by_key(known), "contract_id", "left_semi").where("contract_id <> base_id")
    ranked = usable.withColumn("r", F.row_number().over(Window.partitionBy("contract_id").orderBy("ord", "base_id")))
    edges = durable(ranked.select(F.col("contract_id").alias("c"), F.col("base_id").alias("b"), "r"))
    rows, above = _ancestries(edges, lambda c: F.array(F.array(c)), _by_distance)
    found = rows.select(F.col("c").alias("contract_id"), F.posexplode(F.flatten("row")).alias("position", "ancestor_id")).withColumn("position", F.col("position") + 1)
    itself = known.join(by_key(rows.select(F.col("c").alias("contract_id"))), "contract_id", "left_anti")
    if not above.isEmpty():  # above cycles pairs are followed, each once
        itself = itself.join(above.withColumnRenamed("c", "contract_id"), "contract_id", "left_anti")
        found = found.unionByName(_chains_above_cycles(edges, above))
    return found.unionByName(itself.select("contract_id", F.lit(1).alias("position"), F.col("contract_id").alias("ancestor_id")))


def _chains_above_cycles(edges: DataFrame, above: DataFrame) -> DataFrame:
    new = durable(above.select("c", F.col("c").alias("a"), F.array().cast("array<int>").alias("path")))
    seen = Seen(new, ["c", "a"])
    links = edges.select(F.col("c").alias("x"), "b", "r")
    while not new.isEmpty():  # ends, as each round has pairs that were not seen before
        step = new.join(by_key(links), F.col("a") == F.col("x")).groupBy("c", F.col("b").alias("a")).agg(F.min(F.concat("path", F.array("r"))).alias("path"))
        new = seen.add(step)
    w = Window.partitionBy("c").orderBy(F.size("path"), "path")
    return seen.rows().select(F.col("c").alias("contract_id"), F.row_number().over(w).alias("position"), F.col("a").alias("ancestor_id"))


def effective_functions(linearized: DataFrame, contract_function: DataFrame) -> DataFrame:
    """Functions visible in a contract: of each name and number of parameters that of the most derived contract.

    The functions of an ancestor go to its contracts as one array, and are listed only where all ancestors of a contract
    have met: no row for each contract, ancestor and function is dealt or sorted.
    """
    f = contract_function.groupBy(F.col("contract_id").alias("ancestor_id")).agg(F.collect_set(F.struct("name", "n_params")).alias("fs"))
    met = linearized.join(by_key(f), "ancestor_id").repartition("contract_id")
    listed = met.select("contract_id", "position", "ancestor_id", F.explode("fs").alias("f")).select("contract_id", "position", "ancestor_id", "f.*")
    return listed.groupBy("contract_id", "name", "n_params").agg(F.max_by("ancestor_id", "position").alias("defined_in")).select("contract_id", "defined_in", "name", "n_params")


def inherits_from(base: DataFrame, pairs: DataFrame, max_iter: int | None = None) -> DataFrame:
    """Whether contract_id has base_id among its ancestors; never of itself. max_iter: at most so many levels up."""
    edges = base.select(F.col("contract_id").alias("c"), F.col("base_id").alias("b")).where("c is not null and b is not null and c <> b").distinct()
    if max_iter is not None:
        return _marked(pairs, _reached(edges, pairs.select(F.col("contract_id").alias("root")), max_iter))
    edges = durable(edges.withColumn("r", F.lit(1)))
    rows, above = _ancestries(edges, F.array, _post_order)
    ancestry = rows.select(F.col("c").alias("contract_id"), "row")
    asked = pairs.select("contract_id", "base_id").distinct()
    hits = by_key(asked).join(by_key(ancestry), "contract_id").where(F.array_contains("row", F.col("base_id"))).select("contract_id", "base_id")
    if not above.isEmpty():
        roots = asked.select(F.col("contract_id").alias("root")).join(above.withColumnRenamed("c", "root"), "root", "left_semi")
        hits = hits.unionByName(_reached(edges, roots, None))
    return _marked(pairs, hits)


def _reached(edges: DataFrame, roots: DataFrame, max_iter: int | None) -> DataFrame:
    """(contract_id, base_id) for all that roots reach."""
    reach = dependency_closure(edges.select(F.col("c").alias("src"), F.col("b").alias("dst")), roots, max_iter)
    return reach.select(F.col("root").alias("contract_id"), F.col("node").alias("base_id"))


def _marked(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    known = by_key(hits.withColumn("hit", F.lit(True)))
    return pairs.join(known, ["contract_id", "base_id"], "left").select("contract_id", "base_id", (F.coalesce("hit", F.lit(False)) & (F.col("contract_id") != F.col("base_id"))).alias("inherits"))


def fan_in_out(edge: DataFrame, symbol: DataFrame) -> DataFrame:
    """(symbol_id, fan_in, fan_out, uncalled) of every symbol."""
    out = edge.groupBy(F.col("src").alias("symbol_id")).agg(F.count_distinct("dst").alias("fan_out"))
    into = edge.groupBy(F.col("dst").alias("symbol_id")).agg(F.count_distinct("src").alias("fan_in"))
    every = symbol.select("symbol_id").join(into, "symbol_id", "left").join(out, "symbol_id", "left").fillna(0, ["fan_in", "fan_out"])
    return every.select("symbol_id", "fan_in", "fan_out", (F.col("fan_in") == 0).alias("uncalled"))
