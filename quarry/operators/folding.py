"""Folding records that are judged duplicates, unless that would hide a conflict between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import components
from quarry.operators.lineage import cut


def renamed(df: DataFrame, moves: DataFrame, *columns: str) -> DataFrame:
    """The columns' records under the heads that they were moved to, owner by owner."""
    for c in columns:
        to = moves.select("owner", F.col("head").alias(c), F.col("to").alias("_to"))
        df = df.join(to, ["owner", c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return df


def fold_groups(relations: DataFrame) -> DataFrame:
    """Each record's head and the group of heads whose conflicts hang together, by owner.

    relations: owner, position, kind, a, b, preferred. A LINK_DUPLICATE moves the heads of both records to that of the
    preferred one, in the order of positions, unless a MARK_CONFLICT lies within the heads that it would join. A link
    waits only for earlier ones that share a head with it, so each round settles every link that is the first at all of
    its heads. The rounds are as many as the longest chain of links that wait for each other, and carry open links only.
    """
    order = F.struct("position", "a", "b", "preferred")
    links = cut(relations.filter("kind = 'LINK_DUPLICATE'").select("owner", order.alias("turn"), "a", "b", "preferred").distinct())
    marks = cut(relations.filter("kind = 'MARK_CONFLICT'").select("owner", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct())
    heads = cut(relations.select("owner", F.explode(F.array("a", "b")).alias("member")).distinct().withColumn("head", F.col("member")))
    while not links.isEmpty():
        at = links.select("owner", "turn", F.explode(F.array_distinct(F.array("a", "b", "preferred"))).alias("head"))
        first = at.groupBy("owner", "head").agg(F.min("turn").alias("turn"), F.lit(1).alias("n"))
        firsts = first.groupBy("owner", "turn").agg(F.sum("n").alias("n"))  # a link is first at so many of its heads
        ready = F.coalesce(F.col("n") == F.size(F.array_distinct(F.array("a", "b", "preferred"))), F.lit(False))
        links = cut(links.join(firsts, ["owner", "turn"], "left").withColumn("ready", ready).drop("n"))
        now, later = links.filter("ready").drop("ready"), links.filter("not ready").drop("ready")
        within: list[Column] = [F.struct(F.col(c).alias("x"), F.col(c).alias("y")) for c in ("a", "b")]
        within.append(F.struct(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")))
        barred = now.select("owner", "turn", F.inline(F.array(*within))).join(marks, ["owner", "x", "y"], "left_semi").select("owner", "turn").distinct()
        moves = now.join(barred, ["owner", "turn"], "left_anti").select("owner", F.explode(F.array("a", "b")).alias("head"), F.col("preferred").alias("to"))
        moves = cut(moves.filter("head <> to").distinct())
        links = cut(renamed(later, moves, "a", "b", "preferred"))
        sides = renamed(marks, moves, "x", "y")
        marks = cut(sides.select("owner", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        heads = cut(renamed(heads, moves, "head"))
    node = lambda c: F.struct("owner", F.col(c).alias("id"))
    groups = components(marks.filter("x <> y").select(node("x").alias("src"), node("y").alias("dst")))
    named = groups.groupBy("label").agg(F.sort_array(F.collect_set("node.id")).alias("ids")).join(groups, "label")
    named = named.select("node.owner", F.col("node.id").alias("head"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("conflict"))
    return heads.join(named, ["owner", "head"], "left").select("owner", "member", "head", "conflict")
