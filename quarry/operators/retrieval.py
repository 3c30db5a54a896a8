"""Ranking and layered retrieval of memory items under limits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.lineage import cut

#: Parts in which the rows of a group are ranked before its best ones meet.
PARTS = 64
DEAD = ("rejected", "outdated")
#: Sections of a context pack and their limits.
SECTIONS = {"always_loaded": 5, "project_core": 5, "retrieved": 3, "session_memory": 3, "evidence_memory": 3}


def live(items: DataFrame) -> DataFrame:
    return items.filter(~F.col("status").isin(*DEAD))


def normalized_limit(limit: float | None) -> int:
    return min(50, int(limit)) if limit is not None and limit >= 1 else 5


def task_terms(task: str) -> list[str]:
    """Terms of a task, repeated ones kept."""
    return [t for t in re.split("[^a-z0-9]+", task.lower()) if len(t) >= 3]


def rank_score(task: str) -> Column:
    """3 for each term found, 2 if verified, 1 for a session, and the confidence."""
    text = F.lower(F.concat_ws(" ", "id", "kind", "scope", "content", F.concat_ws(" ", "tags")))
    found = sum((F.when(text.contains(t), 3).otherwise(0) for t in task_terms(task)), F.lit(0))
    return found + F.when(F.col("status") == "verified", 2).otherwise(0) + F.when(F.col("kind") == "session", 1).otherwise(0) + F.col("confidence")


def by_rank(task: str) -> list[Column]:
    return [rank_score(task).desc(), F.col("updated_at").desc(), F.col("id")]


def by_stability() -> list[Column]:
    return [F.col("confidence").desc(), F.col("updated_at").desc(), F.col("id")]


def top(items: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows with their rank. The limit keeps the rank window to a few rows."""
    few = items.orderBy(*order).limit(limit)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def rank_memory(items: DataFrame, task: str, limit: int) -> DataFrame:
    return top(live(items), by_rank(task), limit).select("rank", "id", "kind", F.round(rank_score(task), 6).alias("score"))


def eligible(items: DataFrame, kind: str, scope: str | None = None) -> DataFrame:
    """Rows a query by kind may see: any live session, else verified ones; a project's scope contains the given one."""
    rows = live(items).filter(F.col("kind") == kind)
    if kind != "session":
        rows = rows.filter("status = 'verified'")
    return rows.filter(F.col("scope").contains(scope)) if kind == "project" and scope else rows


def query_memory(items: DataFrame, kind: str, limit: int | None = None, scope: str | None = None) -> DataFrame:
    return top(eligible(items, kind, scope), by_stability(), normalized_limit(limit))


def context_pack(items: DataFrame, task: str, scope: str) -> DataFrame:
    """Five sections, each with its own order and limit; an item may be in several.

    One scan: an item names its sections, and of each section every task passes on no more rows than the limit.
    """
    scoped = live(items).filter(F.col("scope").contains(scope) | ((F.col("kind") == "personal") & (F.col("status") == "verified")))
    scoped = scoped.withColumn("_score", rank_score(task))
    kind, verified = F.col("kind"), F.col("status") == "verified"
    stable, ranked = F.col("confidence").cast("double"), F.col("_score").cast("double")
    parts = {
        "always_loaded": ((kind == "personal") & verified, stable),
        "project_core": ((kind == "project") & verified & F.col("scope").contains(scope), stable),
        "retrieved": (kind.isin("project", "evidence"), ranked),
        "session_memory": (kind == "session", ranked),
        "evidence_memory": (kind == "evidence", ranked),
    }
    named = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(name).alias("section"), order.alias("o"), F.lit(SECTIONS[name]).alias("most"))) for name, (c, order) in parts.items()]))
    rows = scoped.select("id", "kind", "scope", "status", "confidence", "updated_at", F.explode(named).alias("s"))
    w = Window.partitionBy("s.section").orderBy(F.col("s.o").desc(), F.col("updated_at").desc(), F.col("id"))
    best = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(SECTIONS.values()))
    return best.filter(F.col("rank") <= F.col("s.most")).select("s.section", "rank", "id", "kind", "scope", "status", "confidence")


def budgeted(rows: DataFrame, group: str, order: list[str], cost: str, budget: int, separator: int = 1) -> DataFrame:
    """Rows taken in order while they fit; one that doesn't fit is skipped and later ones may still be taken.

    ``order`` names columns by which an array of structs sorts (the last one is the id). A row that does not fit once never fits
    later, so each round looks at the rows that still fit by themselves, and of these at no more in a group than its smallest
    costs leave room for: a group's fold is bounded by the budget, and its rows are ranked in parts first, so that a large group
    is in no single task.
    """
    narrow = cut(rows.select(group, *order, F.col(cost).cast("long").alias("_cost"), F.lit(0).alias("_round")).filter(F.col("_cost") <= budget))
    state = cut(rows.select(group).distinct().select(group, F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n")))
    taken = None
    by = [F.col(c) for c in order]
    while True:
        need = F.col("_cost") + F.when(F.col("n") > 0, separator).otherwise(0)
        fits = narrow.join(state, group).filter(F.col("used") + need <= budget)
        if taken is not None:
            fits = fits.join(taken.select(group, F.col(order[-1])), [group, order[-1]], "left_anti")
        room = fits.groupBy(group).agg(F.floor((budget - F.first("used")) / F.greatest(F.min("_cost") + separator, F.lit(1))).alias("room"))
        most = room.agg(F.max("room")).first()[0]
        if most is None:
            break
        parts = Window.partitionBy(group, F.pmod(F.xxhash64(order[-1]), F.lit(PARTS))).orderBy(*by)
        near = fits.withColumn("_r", F.row_number().over(parts)).filter(F.col("_r") <= most + 2)
        near = near.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*by))).filter(F.col("_r") <= most + 2)
        listed = near.groupBy(group).agg(F.first("used").alias("used"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct(*order, "_cost"))).alias("all"))
        kind = listed.schema["all"].dataType.elementType[order[-1]].dataType.simpleString()
        start = F.struct("used", "n", F.array().cast(f"array<{kind}>").alias("ids"))

        def take(held: Column, row: Column) -> Column:
            more = held["used"] + row["_cost"] + F.when(held["n"] > 0, separator).otherwise(0)
            return F.when(more <= budget, F.struct(more.alias("used"), (held["n"] + 1).alias("n"), F.array_append(held["ids"], row[order[-1]]).alias("ids"))).otherwise(held)

        step = cut(listed.select(group, F.aggregate("all", start, take).alias("s"), "all"))
        new = step.select(group, F.explode(F.filter("all", lambda x: F.array_contains(F.col("s.ids"), x[order[-1]]))).alias("x")).select(group, "x.*").drop("_cost")
        taken = cut(new if taken is None else taken.unionByName(new))
        moved = step.select(group, F.col("s.used").alias("_used"), F.col("s.n").alias("_n"))
        state = cut(state.join(moved, group, "left").select(group, F.coalesce("_used", "used").alias("used"), F.coalesce("_n", "n").alias("n")))
    if taken is None:
        return state.select(group, "used", F.col("n").alias("kept"), F.lit("").alias("ids"))
    ids = taken.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("all"))
    joined = state.join(ids, group, "left")
    return joined.select(group, "used", F.col("n").alias("kept"), F.coalesce(F.array_join(F.transform("all", lambda x: x[order[-1]].cast("string")), ","), F.lit("")).alias("ids"))
