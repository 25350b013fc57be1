"""Closures and other operators over edge tables (src, dst).

Fixpoints run as frontier joins, several steps in one job. Each job's new nodes are written to the
shared folder, which cuts the lineage and survives lost executors; only their number comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.tables import Rounds


#: Steps of a fixpoint in one job: fewer jobs against a longer plan.
STEPS = 4
#: Frontiers that lie apart before they are drawn together in one table.
APART = 8


def closure(edges: DataFrame, seeds: DataFrame, max_rounds: int = 10_000, include_seeds: bool = True, steps: int = STEPS) -> DataFrame:
    """(node, distance): what `seeds` (node) reach along edges, by the fewest steps; cycles are fine.

    A job takes `steps` steps from the nodes that are farthest so far. What it meets and was seen before
    has a shorter way already; what is new has its shortest way from that frontier. A chain of n nodes
    takes n / steps jobs, up to `max_rounds`.
    """
    rounds = Rounds(edges.sparkSession, "closure")
    hop = rounds.put(edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct())
    near = rounds.put(seeds.select("node").where("node IS NOT NULL").distinct().withColumn("distance", F.lit(0)))
    seen, far = near, near.select("node")
    for r in range(max_rounds):
        found = far.withColumn("distance", F.lit(r * steps))
        for k in range(r * steps, (r + 1) * steps):
            # each step reads the one before once, so a job's plan grows with its steps
            found = _sent(found, hop, "distance", F.lit(k + 1), F.col("distance") == k)
        new = found.join(seen.select("node"), "node", "left_anti")
        table, n = rounds.counted(new)
        if not n:
            break
        far = table.where(F.col("distance") == (r + 1) * steps).select("node")
        seen = seen.unionByName(table) if (r + 1) % APART else rounds.put(seen.unionByName(table))
    else:
        raise RuntimeError(f"the closure did not end in {max_rounds} rounds")
    return seen if include_seeds else seen.where("distance > 0")


def _sent(rows: DataFrame, hop: DataFrame, value: str, sent: Column, which: Column | None = None) -> DataFrame:
    """(node, value): the least of a node's own value and of what comes to it along edges from rows (for which
    `which` holds)."""
    on = F.col("node") == F.col("src")
    met = rows.join(hop, on if which is None else on & which, "left")
    both = F.array(F.struct("node", F.col(value)), F.struct(F.col("dst").alias("node"), sent.alias(value)))
    return met.select(F.explode(both).alias("x")).where("x.node IS NOT NULL").groupBy("x.node").agg(F.min(f"x.{value}").alias(value))


def closure_from(edges: DataFrame, seeds: DataFrame, max_rounds: int = 10_000, steps: int = STEPS) -> DataFrame:
    """(seed, node, distance): `closure` of each seed (node) apart. Rows are pairs, so seeds should be few."""
    hop = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    rounds = Rounds(edges.sparkSession, "closure_from")
    hop = rounds.put(hop)
    seen = rounds.put(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("distance", F.lit(0)))
    far = seen.select("seed", "node")
    for r in range(max_rounds):
        level, found = far, None
        for k in range(1, steps + 1):
            level = level.join(hop, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
            part = level.withColumn("distance", F.lit(r * steps + k))
            found = part if found is None else found.unionByName(part)
        new = found.groupBy("seed", "node").agg(F.min("distance").alias("distance")).join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        table, n = rounds.counted(new)
        if not n:
            return seen
        far = table.where(F.col("distance") == (r + 1) * steps).select("seed", "node")
        seen = seen.unionByName(table) if (r + 1) % APART else rounds.put(seen.unionByName(table))
    raise RuntimeError(f"the closure did not end in {max_rounds} rounds")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def impact(dependencies: DataFrame, direct: DataFrame) -> DataFrame:
    """(node, relation): `direct` owners of a change and the dependents of them, in reverse of
    dependencies (src depends on dst)."""
    reached = closure(reverse(dependencies), direct)
    return reached.select("node", F.when(F.col("distance") == 0, "direct").otherwise("dependent").alias("relation"))


def selection(dependencies: DataFrame, primary: DataFrame, dependents: bool = True) -> DataFrame:
    """(node, role): `primary` nodes and, if wanted, all that depend on them are selected; what those
    need beside is support."""
    chosen = closure(reverse(dependencies), primary).select("node") if dependents else primary.select("node").distinct()
    whole = closure(dependencies, chosen)
    return whole.select("node", F.when(F.col("distance") == 0, "selected").otherwise("support").alias("role"))


def reachability(nodes: DataFrame, edges: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """(node, reachable) for all nodes."""
    hit = closure(edges, entrypoints).select(F.col("node").alias("__n"))
    return nodes.select("node").distinct().join(hit, F.col("node") == F.col("__n"), "left").select("node", F.col("__n").isNotNull().alias("reachable"))


def paths(edges: DataFrame, seeds: DataFrame, max_rounds: int = 1_000) -> DataFrame:
    """(node, path): an array of the nodes of a shortest path from a seed, the least of equally short ones."""
    rounds = Rounds(edges.sparkSession, "paths")
    hop = rounds.put(edges.select("src", "dst").distinct())
    frontier = rounds.put(seeds.select("node").distinct().withColumn("path", F.array("node")))
    seen = frontier
    for d in range(max_rounds):
        found = frontier.join(hop, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        new = found.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        frontier = rounds.put(new)
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier) if d % 16 else rounds.put(seen.unionByName(frontier))
    raise RuntimeError(f"the paths did not end in {max_rounds} rounds")


def follow(aliases: DataFrame) -> DataFrame:
    """(node, target): where alias chains (node, target) end, by pointer doubling.

    As many doublings as log2 of the number of aliases walk any chain to its end. What can still go on
    after them has run into a cycle and ends at the cycle's least node.
    """
    rounds = Rounds(aliases.sparkSession, "aliases")
    first = aliases.where("node IS NOT NULL AND target IS NOT NULL AND node != target").groupBy("node").agg(F.min("target").alias("target"))
    now = rounds.put(first.withColumn("least", F.least("node", "target")))
    for _ in range(now.count().bit_length() + 1):
        step = now.select(F.col("node").alias("__n"), F.col("target").alias("__t"), F.col("least").alias("__l"))
        met = now.join(step, F.col("target") == F.col("__n"), "left")
        now = rounds.put(met.select("node", F.coalesce("__t", "target").alias("target"), F.least("least", "__l").alias("least")))
    step = now.select(F.col("node").alias("__n"), F.col("least").alias("__l"))
    return now.join(step, F.col("target") == F.col("__n"), "left").select("node", F.coalesce("__l", "target").alias("target"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, inbound, outbound), 0 where a node has none; one shuffle, as each edge counts at both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("inbound"), F.sum("e.o").alias("outbound"))


def dedupe_edges(edges: DataFrame, keys: list[str], occurrence: str) -> DataFrame:
    """One row for each edge, with its distinct occurrences in order and their number."""
    seen = F.array_sort(F.collect_set(occurrence))
    return edges.groupBy(*keys).agg(seen.alias("occurrences")).withColumn("n", F.size("occurrences").cast("long"))


def topology(edges: DataFrame, keys: list[str], declaration: str, weight: str) -> DataFrame:
    """Merged edges: distinct declarations and the sum of weights."""
    return edges.groupBy(*keys).agg(F.count_distinct(declaration).alias("declarations"), F.sum(weight).alias("weight"))


def rolled_up(edges: DataFrame, families: DataFrame, weight: str) -> DataFrame:
    """(src, dst, kind, external, weight): edges (src, dst, kind, weight) summed, with ends outside, those of
    families (node, family), replaced by their family."""
    own = families.select(F.col("node").alias("__n"), "family")
    met = edges.join(own, F.col("dst") == F.col("__n"), "left")
    return met.groupBy("src", F.coalesce("family", "dst").alias("dst"), "kind", F.col("family").isNotNull().alias("external")).agg(F.sum(weight).alias(weight))


def _labels(edges: DataFrame, rounds: Rounds, max_rounds: int, steps: int) -> DataFrame:
    """(node, label): the least node that leads to each node, itself included."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    now = rounds.put(ends.withColumn("label", F.col("node")).withColumn("moved", F.lit(True)))
    for _ in range(max_rounds):
        step = now.select("node", "label")
        for _ in range(steps):
            step = _sent(step, edges, "label", F.col("label"))
        old = now.select(F.col("node").alias("__n"), F.col("label").alias("__old"))
        now, moved = rounds.counted(step.join(old, F.col("node") == F.col("__n")).select("node", "label", (F.col("label") != F.col("__old")).alias("moved")), F.col("moved"))
        if not moved:
            return now.select("node", "label")
    raise RuntimeError(f"the labels did not settle in {max_rounds} rounds")


def _led(edges: DataFrame, end: str, other: str) -> DataFrame:
    """Edges whose `end` is the `other` end of an edge."""
    both = F.array(F.struct(F.col(end).alias("node"), "src", "dst"), F.struct(F.col(other).alias("node"), F.lit(None).alias("src"), F.lit(None).alias("dst")))
    met = edges.select(F.explode(both).alias("x")).select("x.*").withColumn("led", F.max(F.col("src").isNull()).over(Window.partitionBy("node")))
    return met.where("src IS NOT NULL AND led").select("src", "dst")


def cycles(edges: DataFrame, max_rounds: int = 10_000, steps: int = STEPS) -> DataFrame:
    """(node, cycle): nodes that reach themselves, by the least node of their strong component. Ours.

    Nodes without a way in or out are trimmed. Every other node takes the least node that leads to it as
    its label; a node that is its own label, and what leads to it among nodes of that label, are one
    component, since the label leads to them. These go, and the rest is done again. Tables hold one row
    for a node or an edge, never one for a pair of nodes.
    """
    rounds = Rounds(edges.sparkSession, "cycles")
    core, n = rounds.counted(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    found = rounds.put(core.select(F.col("src").alias("node"), F.col("src").alias("cycle"), F.lit(True).alias("own")).limit(0))
    for _ in range(max_rounds):
        while n:
            trimmed = core
            for _ in range(steps):
                trimmed = _led(_led(trimmed, "src", "dst"), "dst", "src")
            core, m = rounds.counted(trimmed)
            few, n = m > 0.98 * n, m
            if few:  # long ways that shed few nodes a round are left to the labels
                break
        if not n:
            out = found.groupBy("cycle").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("n > 1 OR own").select(F.col("cycle").alias("__c"))
            return found.join(out, F.col("cycle") == F.col("__c"), "left_semi").select("node", "cycle")
        labels = _labels(core, rounds, max_rounds, steps)
        of = lambda end: labels.select(F.col("node").alias(f"__{end}"), F.col("label").alias(f"__l{end}"))
        within = rounds.put(core.join(of("src"), F.col("src") == F.col("__src")).join(of("dst"), F.col("dst") == F.col("__dst")).where("__lsrc = __ldst").select("src", "dst"))
        roots = labels.where("node = label").select("node")
        back = closure(reverse(within), roots, max_rounds, steps=steps).select(F.col("node").alias("__n"))
        loops = core.where("src = dst").select(F.col("src").alias("__loop"))
        part = labels.join(back, F.col("node") == F.col("__n"), "left_semi").join(loops, F.col("node") == F.col("__loop"), "left")
        part = rounds.put(part.select("node", F.col("label").alias("cycle"), F.col("__loop").isNotNull().alias("own")))
        found = rounds.put(found.unionByName(part))
        gone = part.select(F.col("node").alias("__g"))
        core, n = rounds.counted(core.join(gone, F.col("src") == F.col("__g"), "left_anti").join(gone, F.col("dst") == F.col("__g"), "left_anti"))
    raise RuntimeError(f"the cycles did not end in {max_rounds} rounds")
