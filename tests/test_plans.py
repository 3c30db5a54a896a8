"""How queries go about their work: joins, shuffles and broadcasts of their plans."""

from quarry.operators import context, graph, latest
from quarry.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def nodes(df, name):
    """How many operators of a kind the physical plan of ``df`` has."""
    return df._jdf.queryExecution().sparkPlan().toString().count(name)


def test_insert_conflicts_joins_once(spark):
    assert nodes(QUERIES["insert_conflicts"](spark, SF), "Join") == 1


def test_insert_outcomes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (6, "x"), (6, "y")], "k int, d string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d"), (4, None), (5, "e"), (5, "e"), (6, "x"), (None, "n")], "k int, d string")
    got = sorted(latest.insert_outcomes(old, new, "k", "d").collect(), key=repr)
    assert sorted(map(tuple, got), key=repr) == sorted([(2, "c", "conflict"), (4, None, "insert"), (5, "e", "insert"), (5, "e", "insert"), (6, "x", "conflict"), (None, "n", "insert")], key=repr)
    fresh, conflicts = latest.insert_only(old, new, "k", "d")
    assert fresh.columns == conflicts.columns == ["k", "d"] and (fresh.count(), conflicts.count()) == (4, 2)


def test_skills_are_not_broadcast(spark):
    assert nodes(QUERIES["relation_applicability"](spark, SF), "SortMergeJoin") >= 4


def test_rows_without_key_are_spread(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else f"k{i % 3}") for i in range(40)], "i int, k string")
    other = spark.createDataFrame([("k0", 1), ("k1", 2), (None, 3)], "k string, v int")
    got = context.joined(rows, other, "k", "i")
    assert sorted(map(tuple, got.select("i", "k", "v").collect()), key=repr) == sorted(map(tuple, rows.join(other, "k", "left").select("i", "k", "v").collect()), key=repr)
    dealt = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(k" in line]
    assert dealt and all("_spread" in line for line in dealt)


def test_rounds_of_cycle_paths_broadcast_nothing(spark, monkeypatch):
    seen, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: seen.append(nodes(df, "Broadcast")) or cut(df))
    QUERIES["circular_references"](spark, SF)
    assert len(seen) > 3 and not any(seen)
