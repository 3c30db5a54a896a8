"""Graph operators over edge tables: closures, cycles, bounded searches and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.lineage import cut


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth) of every node that a root reaches, at its least depth. Cycles end, as no pair is met twice.

    A round goes on from the pairs of the greatest depth by what their nodes reach within some steps, which is known where
    these are roots too. So rounds grow with the logarithm of the depth, and what is known is not looked through again for
    each step. Where many ways lead to the same nodes, or few nodes are roots, rounds are of fewer steps, down to one.
    """
    edges = cut(edges.select("src", "dst").distinct())
    asked = cut(roots.select("node").distinct())
    more = cut(edges.select(F.col("dst").alias("node")).distinct().join(asked, "node", "left_anti"))
    n, extra = asked.count(), more.count()
    known = extra <= n  # else only the roots' own pairs are looked for, step by step
    reached = front = cut((asked.unionByName(more) if known else asked).select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")))
    rows, depth = (n + extra if known else n), 0
    while True:
        steps = most_steps(reached, front, depth, 2 * rows) if known and depth > 1 else 1
        hops = edges.select("src", "dst", F.lit(1).alias("length")) if steps == 1 else reached.filter(F.col("depth").between(1, steps)).select(F.col("root").alias("src"), F.col("node").alias("dst"), F.col("depth").alias("length"))
        met = front.join(hops, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg((F.min("length") + F.lit(depth)).cast("int").alias("depth"))
        new = cut(met.join(reached.select("root", "node"), ["root", "node"], "left_anti"))
        found, depth = new.count(), depth + steps
        rows += found
        front = new.filter(F.col("depth") == depth)
        if found:
            reached = reached.unionByName(new)
        if not found or front.isEmpty():
            return reached.join(more.withColumnRenamed("node", "root"), "root", "left_anti") if known and extra else reached


def most_steps(reached: DataFrame, front: DataFrame, depth: int, limit: int) -> int:
    """The greatest power of two, up to the depth, of steps that make at most ``limit`` rows of the front; 1 if none does."""
    sizes = [1 << i for i in range(1, depth.bit_length())]
    names = [f"_{s}" for s in sizes]
    held = reached.filter("depth > 0").groupBy(F.col("root").alias("node")).agg(*[F.count_if(F.col("depth") <= s).alias(c) for s, c in zip(sizes, names)])
    made = front.join(held, "node").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    return max((s for s, c in zip(sizes, names) if made[c] <= limit), default=1)


def strong_components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of all nodes that lie on a cycle with others.

    Each round takes off nodes without a way in or out, gives every node the least node that it reaches, and takes as
    components what such a node reaches within its own nodes. What is left goes to the next round.
    """
    found = None
    left = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    n = left.count()
    while n:
        while True:
            left = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            left, before = cut(left), n
            n = left.count()
            if n == before or not n:
                break
        if not n:
            break
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        least = first_labels(left, nodes.withColumn("label", F.col("node")))
        same = left.join(least.select(F.col("node").alias("src"), F.col("label").alias("_s")), "src").join(least.select(F.col("node").alias("dst"), F.col("label").alias("_d")), "dst")
        same = cut(same.filter("_s = _d").select("src", "dst"))
        own = reached_nodes(same, least.filter("node = label").select("node")).join(least, "node").select("node", F.col("label").alias("component"))
        own = cut(own.join(own.groupBy("component").count().filter("count > 1").select("component"), "component", "left_semi").select("node", "component"))
        found = own if found is None else found.unionByName(own)
        done = least.filter("node = label").select("node").unionByName(own.select("node")).distinct()
        left = cut(left.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti"))
        n = left.count()
    empty = edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    return empty if found is None else found


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves, with the length of their shortest cycle. Only strong components are closed."""
    loops = edges.filter("src = dst").select(F.col("src").alias("node"), F.lit(1).alias("length")).distinct()
    of = strong_components(edges)
    inner = edges.filter("src <> dst").join(of.select(F.col("node").alias("src"), F.col("component").alias("_s")), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("_d")), "dst")
    inner = cut(inner.filter("_s = _d").select("src", "dst").distinct())
    reach = closure(inner, of.select("node")).select("root", "node", "depth").filter("root <> node")
    back = reach.join(inner, (F.col("node") == F.col("src")) & (F.col("root") == F.col("dst"))).groupBy(F.col("root").alias("node")).agg((F.min("depth") + 1).cast("int").alias("length"))
    return loops.unionByName(back).groupBy("node").agg(F.min("length").alias("length"))


def conflicts_inside(reached: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Conflicting pairs (a, b) of which one root reaches both."""
    a = reached.select("root", F.col("node").alias("a"))
    # Only what is the second of some conflict meets the first ones.
    b = reached.select("root", F.col("node").alias("b")).join(conflicts.select("b").distinct(), "b", "left_semi")
    return a.join(conflicts, "a").join(b, ["root", "b"]).select("root", "a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node and the least node of its component, by passing least labels with shortcuts."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = cut(both)
    label = cut(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("label")))
    while True:
        near = both.join(label.select(F.col("node").alias("dst"), F.col("label").alias("l")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("l").alias("l"))
        new = label.join(near, "node").select("node", F.least("label", "l").alias("label"))
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = new.join(jump, "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"))
        new = cut(new)
        changed = not new.join(label.select("node", F.col("label").alias("old")), "node").filter("label <> old").isEmpty()
        label = new
        if not changed:
            break
    return label


def reached_nodes(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The nodes that any of the seeds reaches, themselves included: node sets only, never pairs."""
    edges = cut(edges.select("src", "dst").distinct())
    reached = front = cut(seeds.select("node").distinct())
    while not front.isEmpty():
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(reached, "node", "left_anti"))
        reached = reached.unionByName(front)
    return reached


def first_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node and the least of its own labels and those of all nodes that it reaches by (src, dst) edges.

    labels: node, label. Labels go from each edge's end to its start, and only those that got smaller go on.
    """
    edges = cut(edges.select("src", "dst").distinct())
    held = front = cut(labels.groupBy("node").agg(F.min("label").alias("label")))
    while not front.isEmpty():
        step = front.join(edges, F.col("node") == F.col("dst")).groupBy(F.col("src").alias("node")).agg(F.min("label").alias("new"))
        joined = step.join(held, "node", "left").filter(F.col("label").isNull() | (F.col("new") < F.col("label")))
        front = cut(joined.select("node", F.col("new").alias("label")))
        held = cut(held.join(front.select("node"), "node", "left_anti").unionByName(front))
    return held


def cycle_paths(references: DataFrame, items: DataFrame) -> DataFrame:
    """For each item from which references lead into a cycle: the ids on the first such way, up to the one met again.

    references: src, place, dst; a search from the item follows references by place and turns back where it ends. An item
    leads into a cycle exactly if it is left when those without references to others left are taken off, round after
    round; the search then always takes the first reference to an item that is left. So each item has one successor, and
    ways are put together from ways of half their length. No round broadcasts its nodes: they would all pass the driver each time.
    """
    known = items.select("node").distinct().hint("merge")
    left = references.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    left = cut(left.select("src", "place", "dst"))
    n = left.count()
    while n:
        left = cut(left.join(left.select(F.col("src").alias("dst")).distinct().hint("merge"), "dst", "left_semi"))
        now = left.count()
        if now == n:
            break
        n = now
    ways = cut(left.groupBy("src").agg(F.min_by("dst", "place").alias("dst")).select(F.col("src").alias("node"), F.array("src", "dst").alias("way")))
    met = F.size(F.array_distinct("way")) < F.size("way")
    while not ways.filter(~met).isEmpty():
        on = ways.select(F.col("node").alias("_end"), F.slice("way", 2, 1_000_000_000).alias("_on"))
        ways = cut(ways.join(on.hint("merge"), F.element_at("way", -1) == F.col("_end")).select("node", F.when(met, F.col("way")).otherwise(F.concat("way", "_on")).alias("way")))
    first = F.filter(F.sequence(F.lit(1), F.size("way")), lambda i: F.array_position("way", F.element_at("way", i.cast("int"))) < i)[0]
    return ways.select("node", F.slice("way", F.lit(1), first).alias("path"))
