"""Dependency graphs: metrics, filters, strongly connected components, clusters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import patterns, text
from evidentia.sources.written import written


#: Edges of a graph that one task can finish: a few MB.
FINISH = 1 << 18
#: Rounds of `clusters` that contract one hop only, which is all that most graphs need.
HOPS = 2


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def metrics(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """node, fan_in, fan_out (distinct neighbours), instability: out / (in + out), two decimals. tasks: how many to deal the edges' ends over, where their number is known."""
    both = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("way")).union(edges.select("src", "dst", F.lit("out")))
    dealt = both.repartition(tasks, "node", "other") if tasks else both
    counts = dealt.distinct().groupBy("node").agg(F.count(F.when(F.col("way") == "in", 1)).alias("fan_in"), F.count(F.when(F.col("way") == "out", 1)).alias("fan_out"))
    total = F.col("fan_in") + F.col("fan_out")
    return counts.withColumn("instability", F.floor(100 * F.col("fan_out") / total + 0.5) / 100)


def coupled(edges: DataFrame, least: int = 15, high: int = 30, tasks: int | None = None) -> DataFrame:
    total = F.col("fan_in") + F.col("fan_out")
    return metrics(edges, tasks).where(total >= least).withColumn("confidence", F.when(total >= high, "high").otherwise("medium"))


def without(edges: DataFrame, paths: DataFrame, exclude: list[str]) -> DataFrame:
    """Edges between nodes (node, path) whose paths are not excluded."""
    kept = paths.where(~patterns.any_excluded(F.col("path"), exclude)).select("node")
    return edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "deferred")


def orphans(paths: DataFrame, edges: DataFrame, entries: list[str], barrels: list[str]) -> DataFrame:
    """Nodes that nothing imports, no entry point by their base name, no barrel."""
    name = text.basename(F.col("path"))
    out = paths.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    for e in entries:
        out = out.where(~name.contains(e))
    return out.where(~name.isin(*barrels))


def single_use(edges: DataFrame, sizes: DataFrame, least: int = 20, most: int = 300) -> DataFrame:
    """Nodes of 20 to 300 lines with exactly one importer."""
    one = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("importers"), F.min("src").alias("importer")).where("importers = 1")
    return one.join(sizes, "node").where((F.col("loc") >= least) & (F.col("loc") <= most)).select("node", "importer", "loc")


def across_packages(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges whose ends lie in different directories."""
    at = lambda side: paths.select(F.col("node").alias(side), F.col("path").alias(f"{side}_path"))
    out = edges.join(at("src"), "src").join(at("dst"), "dst")
    return out.where(text.parent(F.col("src_path")) != text.parent(F.col("dst_path")))


def layer_violations(edges: DataFrame, paths: DataFrame, low: str, high: str) -> DataFrame:
    """Edges from files under `low` to files under `high`."""
    out = across_packages(edges, paths)
    return out.where(F.col("src_path").startswith(low) & F.col("dst_path").startswith(high))


def tool_coupling(edges: DataFrame, paths: DataFrame, shared: str, tools: str) -> DataFrame:
    """(src, dst, direction, source_tool, target_tool, violating) of the distinct edges that count as coupling between packages: from shared files to shared ones or to tools, which
    violates; and between files of tools, where the importer lies in a tool's folder, which violates unless both lie in the same one. Prefixes end in a slash."""
    at = lambda side: paths.select(F.col("node").alias(side), text.slashes(F.col("path")).alias(f"{side}_path"))
    e = edges.select("src", "dst").distinct().join(at("src"), "src").join(at("dst"), "dst")
    tool = lambda side: F.when(F.col(f"{side}_path").startswith(tools), F.split_part(F.substring(f"{side}_path", len(tools) + 1, 1 << 30), F.lit("/"), F.lit(1)))
    e = e.withColumns({"from_tool": tool("src"), "to_tool": tool("dst")})
    from_shared, to_shared = F.col("src_path").startswith(shared), F.col("dst_path").startswith(shared)
    inside = F.contains(F.substring("src_path", len(tools) + 1, 1 << 30), F.lit("/")) & F.col("from_tool").isNotNull()
    direction = F.when(from_shared & (to_shared | F.col("to_tool").isNotNull()), "shared").when(inside & F.col("to_tool").isNotNull(), "tools")
    violating = F.when(direction == "shared", F.col("to_tool").isNotNull()).otherwise(F.col("from_tool") != F.col("to_tool"))
    return e.select("src", "dst", direction.alias("direction"), F.when(direction == "tools", F.col("from_tool")).alias("source_tool"), F.col("to_tool").alias("target_tool"), violating.alias("violating")).where("direction is not null")


def strong_components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """(node, component, size) of the strongly connected components with more than one node; component is the least node.

    The graph is made small first, again and again. A sparse part of it, the outermost ways of each node, has components that lie inside those of the whole: each of them becomes one
    node. Chains of nodes with one way in and one way out become one edge, by pointer doubling, and nodes
    without a way in or out are trimmed. A chain's nodes are in the component of its ends if that is one component, else in none. Of what is
    left, each round spreads, forward and then backward inside equal forward labels, the first label (that of the node with the most ways) that reaches a node; a node whose label is its root's
    and that reaches the root back is in the root's component, which is taken out. Every step is a join and a partial minimum. A rest of at most `finish` edges, as counted, and weakly connected classes of
    at most so many, are small enough for one task, which saves the rounds that they would take.
    """
    e = written(edges.select("src", "dst").where("src <> dst").distinct())
    found: list[DataFrame] = []  # (node, comp) of components that are done
    steps: list[tuple[str, DataFrame]] = []  # what became smaller, in order: chains (node, first, last) and merged nodes (node, component)
    size = e.count()
    while size > finish:
        before = size
        sparse = written(_outermost(e))
        if 2 * sparse.count() <= size:
            merged = written(strong_components(sparse, finish).select("node", "component"))
            if not merged.isEmpty():
                steps.append(("merged", merged))
                e = written(_contracted(e, merged))
                size = e.count()
        if 2 * size <= before:
            continue
        e, chain, cycles = _without_chains(e)
        if chain is not None:
            found.append(cycles)
            steps.append(("chain", chain))
        for _ in range(3):
            e = written(_trimmed(e))
            wider, size = size, e.count()
            if 10 * size > 9 * wider:
                break
        if size and 4 * size > 3 * before:
            small, e = _by_classes(e, finish)
            found.append(small)
            size = e.count()
        if size and 4 * size > 3 * before:
            members = _taken_out(e)
            found.append(members)
            gone = members.select("node")
            e = written(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
            size = e.count()
    if size:
        found.append(_finished(e.withColumn("part", F.lit(0))))
    if not found and not steps:
        return e.select(F.col("src").alias("node"), F.col("src").alias("component"), F.lit(1).cast("long").alias("size"))
    comps = reduce(DataFrame.union, found) if found else e.select(F.col("src").alias("node"), F.col("src").alias("comp"))
    for kind, step in reversed(steps):
        if kind == "merged":  # a merged node's members are where it is; nodes in no larger component stand for themselves
            placed = step.join(comps.select(F.col("node").alias("component"), "comp"), "component", "left").select("node", F.coalesce("comp", "component").alias("comp"))
            comps = written(comps.union(placed).distinct())
        elif not step.isEmpty():  # ends that are in no larger component stand for themselves
            end = lambda side: comps.select(F.col("node").alias(side), F.col("comp").alias(f"comp_{side}"))  # noqa: B023, E731
            placed = step.join(end("first"), "first", "left").join(end("last"), "last", "left").select("node", "first", F.coalesce("comp_first", "first").alias("comp"), F.coalesce("comp_last", "last").alias("other")).where("comp = other")
            own = placed.select(F.col("first").alias("node"), "comp").distinct()
            comps = written(comps.union(placed.select("node", "comp")).union(own).distinct())
    names = comps.groupBy("comp").agg(F.min("node").alias("component"), F.count("*").alias("size")).where("size > 1")
    return comps.join(names, "comp").select("node", "component", "size")


def _outermost(e: DataFrame) -> DataFrame:
    """Of each node the ways to and from its least and its greatest neighbour: at most four edges a node, which go far both up and down."""
    ends = lambda node, other: e.groupBy(F.col(node).alias("node")).agg(F.min(other).alias("low"), F.max(other).alias("high")).select("node", F.explode(F.array_distinct(F.array("low", "high"))).alias("other"))
    return ends("src", "dst").select(F.col("node").alias("src"), F.col("other").alias("dst")).union(ends("dst", "src").select("other", "node")).distinct()


def _contracted(e: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges with each node of merged (node, component) as its component."""
    at = lambda side: merged.select(F.col("node").alias(side), F.col("component").alias(f"in_{side}"))
    moved = e.join(at("src"), "src", "left").join(at("dst"), "dst", "left").select(F.coalesce("in_src", "src").alias("src"), F.coalesce("in_dst", "dst").alias("dst"))
    return moved.where("src <> dst").distinct()


def _finished(e: DataFrame) -> DataFrame:
    """(node, comp) of edges (src, dst, part): parts without edges between them and of bounded size, each finished in one task."""
    kind = e.schema["src"].dataType.simpleString()
    return written(e.groupBy("part").applyInPandas(_local_components, f"node {kind}, comp {kind}"))


def _by_classes(e: DataFrame, finish: int) -> tuple[DataFrame, DataFrame]:
    """(node, comp) of the weakly connected classes of at most `finish` edges, which fill tasks of about that many; the edges of larger classes."""
    classes = clusters(e.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("node", "src")
    placed = written(e.join(classes, "src"))
    fit = written(placed.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") <= finish))
    edges = fit.agg(F.sum("n")).first()[0] or 0
    part = F.pmod(F.xxhash64("cluster"), F.lit(max(1, -(-2 * edges // max(finish, 1)))))
    return _finished(placed.join(fit, "cluster").select("src", "dst", part.alias("part"))), written(placed.join(fit, "cluster", "left_anti").select("src", "dst"))


def _local_components(edges: pd.DataFrame) -> pd.DataFrame:
    """(node, comp) of a small graph: a first search orders the nodes by when it leaves them, a second one goes back along edges in that order."""
    names, ends = np.unique(edges[["src", "dst"]].to_numpy().reshape(-1), return_inverse=True)
    src, dst = ends.reshape(-1, 2).T
    ways = []
    for a, b in ((src, dst), (dst, src)):
        order = np.argsort(a, kind="stable")
        ways.append((np.searchsorted(a[order], np.arange(len(names) + 1)).tolist(), b[order].tolist()))

    def search(start: int, way: tuple[list[int], list[int]], seen: list[bool]) -> list[int]:
        """The nodes that it reaches anew, in the order in which it leaves them."""
        first, to = way
        seen[start], left, path = True, [], [(start, first[start])]
        while path:
            node, at = path.pop()
            while at < first[node + 1] and seen[to[at]]:
                at += 1
            if at == first[node + 1]:
                left.append(node)
            else:
                path += [(node, at + 1), (to[at], first[to[at]])]
                seen[to[at]] = True
        return left

    seen, order = [False] * len(names), []
    for node in range(len(names)):
        if not seen[node]:
            order += search(node, ways[0], seen)
    seen, comp = [False] * len(names), np.zeros(len(names), np.int64)
    for node in reversed(order):
        if not seen[node]:
            comp[search(node, ways[1], seen)] = node
    return pd.DataFrame({"node": names, "comp": names[comp]})


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges from nodes with a way in to nodes with a way out."""
    return e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def _without_chains(e: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Edges with each chain as one edge; (node, first, last) of the chains' nodes and the ends; (node, comp) of cycles that are nothing but a chain. Without chains the edges stay, and there is no more."""
    ins = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.min("src").alias("first"))
    outs = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.min("dst").alias("last"))
    inner = written(ins.where("n_in = 1").join(outs.where("n_out = 1"), "node").select("node", "first", "last", F.col("node").alias("low")))
    names = inner.select("node")
    steps, left = 1, inner.count()
    if not left:
        return e, None, None
    state = inner
    while left and steps < 2 * left:  # after `steps` steps each way; a cycle has been round by then
        pending = reduce(DataFrame.union, [state.join(names.withColumnRenamed("node", side), side, "left_semi").select("node") for side in ("first", "last")])
        if pending.isEmpty():
            break
        # each way jumps over the inner node that it points to
        back, ahead = state.select(F.col("node").alias("first"), F.col("first").alias("first2"), F.col("low").alias("low2")), state.select(F.col("node").alias("last"), F.col("last").alias("last2"))
        jumped = state.join(back, "first", "left").join(ahead, "last", "left")
        state = written(jumped.select("node", F.coalesce("first2", "first").alias("first"), F.coalesce("last2", "last").alias("last"), F.least("low", "low2").alias("low")))
        steps *= 2
    ended = state.join(names.withColumnRenamed("node", "first"), "first", "left_anti").select("node", "first", "last")
    cycles = state.join(names.withColumnRenamed("node", "first"), "first", "left_semi").select("node", F.col("low").alias("comp"))
    outer = e.join(names.withColumnRenamed("node", "src"), "src", "left_anti").join(names.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    short = ended.select(F.col("first").alias("src"), F.col("last").alias("dst")).where("src <> dst")
    return written(outer.union(short).distinct()), ended, cycles


def _taken_out(e: DataFrame) -> DataFrame:
    """(node, comp) of the roots' components: of each label that has spread, the nodes that reach its root back."""
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    start = ends.select("node", F.struct((-F.least("o", "i")).alias("ways"), F.xxhash64("node").alias("h"), F.col("node").alias("root")).alias("label"))
    ahead = _first_reaching(e, start)
    inside = e.join(ahead.withColumnRenamed("node", "src"), "src").join(ahead.select(F.col("node").alias("dst"), F.col("label").alias("label_dst")), "dst").where("label = label_dst")
    back = written(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct())
    return _reach(back, ahead.where("node = label.root").select("node", F.col("label.root").alias("comp")))


def _first_reaching(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The first label that reaches each node along edges; a round goes on only from nodes whose label has changed."""
    labels = written(labels.withColumn("changed", F.lit(True)))
    while True:
        moved = edges.join(labels.where("changed").select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("new"))
        better = F.coalesce(F.col("new") < F.col("label"), F.lit(False))
        labels = written(labels.join(moved, "node", "left").select("node", F.when(better, F.col("new")).otherwise(F.col("label")).alias("label"), better.alias("changed")))
        if labels.where("changed").isEmpty():
            return labels.select("node", "label")


def _reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, comp): what the roots reach along edges; the last hop's new nodes go on."""
    seen = new = written(roots)
    while not new.isEmpty():
        new = written(edges.join(new.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "comp").distinct().join(seen, ["node", "comp"], "left_anti"))
        seen = seen.union(new)
    return seen


def clusters(pairs: DataFrame, written: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """(node, cluster): connected components of pairs (a, b): every node hooks to its least neighbour, and what hooks is contracted, one hop in the first
    rounds and then whole trees. Self loops and repeated pairs do no harm; no pairs, no rows. The least node of a component names it.
    `written` writes the steps' tables.
    """
    e = written(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots, rounds = None, 0
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("up")))
        rounds += 1
        while rounds > HOPS:  # what is still there has long chains of hooks: pointer doubling
            higher = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = written(hooks.join(higher, "up").select("node", F.col("top").alias("up"), (F.col("top") < F.col("up")).alias("moved")))
            hooks = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        if roots is None:
            roots = hooks.select("node", F.col("up").alias("cluster"))
        else:
            roots = written(roots.join(hooks.select(F.col("node").alias("cluster"), "up"), "cluster", "left").select("node", F.coalesce("up", "cluster").alias("cluster")))
        moved = e.join(hooks.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(hooks.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b").where("ua <> ub")
        e = written(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    return roots if roots is not None else e.select(F.col("a").alias("node"), F.col("b").alias("cluster"))


def exact_duplicates(functions: DataFrame, least_lines: int = 15) -> DataFrame:
    """(a, b): functions (name, body, loc) with the same normalised body, each with the first of its group."""
    own = functions.where(F.col("loc") >= least_lines).withColumn("hash", text.body_hash(F.col("body")))
    first = own.groupBy("hash").agg(F.min("name").alias("a"), F.count("*").alias("n")).where("n > 1").select("hash", "a")
    return own.join(first, "hash").select("a", F.col("name").alias("b")).where("a <> b")
