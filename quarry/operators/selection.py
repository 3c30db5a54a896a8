"""Selections that depend on what is already selected: sequential within one task's candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



class Library:
    """One task's candidates with what they need, and the relations that may speak for them.

    skills: dicts of skill_id, base and closure, a list of dicts (skill_id, chars, conflicts) with the skill itself.
    relations: dicts of from, to, kind, value, background (skill_ids) and supported.
    """

    def __init__(self, skills: list[dict], relations: list[dict], weight: float):
        self.base = {s["skill_id"]: s["base"] for s in skills}
        self.needs = {s["skill_id"]: [x["skill_id"] for x in s["closure"]] for s in skills}
        self.chars = {x["skill_id"]: x["chars"] for s in skills for x in s["closure"]}
        self.against = {x["skill_id"]: set(x["conflicts"] or ()) for s in skills for x in s["closure"]}
        self.weight = weight
        #: Per candidate: the skill that has to be held, the background that has to be there, and the value.
        self.support: dict[str, list[tuple[str, frozenset[str], float]]] = {}
        for r in relations:
            usable = r["kind"] in ("co_used", "measured_effect") and r["supported"] and r["value"] is not None and math.isfinite(r["value"])
            if usable:
                ends = {(r["from"], r["to"])} | ({(r["to"], r["from"])} if r["kind"] == "co_used" else set())
                for skill, other in ends:
                    self.support.setdefault(skill, []).append((other, frozenset(r["background"] or ()), r["value"]))

    def score(self, skill: str, held: set[str]) -> float:
        there = held.union(self.needs[skill])
        return self.base[skill] + self.weight * sum(v for other, background, v in self.support.get(skill, ()) if other in held and background <= there)

    def clashes(self, skills: set[str]) -> bool:
        return any(self.against.get(s, set()) & skills for s in skills)

    def length(self, skills: set[str]) -> int:
        """Characters of the skills' texts with one between each two."""
        return sum(self.chars[s] for s in skills) + max(0, len(skills) - 1)

    def choose(self, most: int, budget: int) -> Iterator[tuple[str, float, str]]:
        """Skill, score and verdict (root, declared_conflict, budget, root_limit), in the order in which they are looked at.

        A skill that came in with another one's closure is neither a root nor left out.
        """
        held: set[str] = set()
        open_, roots = set(self.base), 0
        while open_ and roots < most:
            minus, skill = min((-self.score(s, held), s) for s in open_)
            open_.remove(skill)
            if skill in held:
                continue
            whole = held.union(self.needs[skill])
            verdict = "declared_conflict" if self.clashes(whole) else "budget" if self.length(whole) > budget else "root"
            if verdict == "root":
                held, roots = whole, roots + 1
            yield skill, -minus, verdict
        for skill in sorted(open_ - held):
            yield skill, self.score(skill, held), "root_limit"


def select_roots(candidates: DataFrame, relations: DataFrame, weight: float, max_roots: int, budget: int) -> DataFrame:
    """task_id, place, skill_id, score and verdict of each task's candidates; the roots are those with the verdict root.

    candidates: task_id, skill_id, base, closure array<struct<skill_id, chars, conflicts>>. relations: task_id, from, to, kind, value,
    background, supported: those that apply to the task. Each choice depends on those before, so a task is one group; its
    candidates are the skills of one library.
    """
    def one(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(Library(left.to_pylist(), right.to_pylist(), weight).choose(max_roots, budget))
        columns = zip(*found, strict=True) if found else ((), (), ())
        skill, score, verdict = columns
        return pa.table({
            "task_id": pa.array([left.column("task_id")[0].as_py()] * len(found) if found else [], pa.string()), "place": pa.array(range(1, len(found) + 1), pa.int32()),
            "skill_id": pa.array(skill, pa.string()), "score": pa.array(score, pa.float64()), "verdict": pa.array(verdict, pa.string()),
        })

    schema = "task_id string, place int, skill_id string, score double, verdict string"
    other = relations.toDF(*relations.columns)  # both may come from one table
    return candidates.groupBy("task_id").cogroup(other.groupBy("task_id")).applyInArrow(one, schema)


def call_ledger(starts: DataFrame, returns: DataFrame) -> DataFrame:
    """Each call that was started: returned once, more than once, or open; an open call is never repeated silently."""
    n = returns.groupBy("request_id").agg(F.count("*").alias("returns"))
    j = starts.join(n, "request_id", "left").withColumn("returns", F.coalesce("returns", F.lit(0)))
    return j.withColumn("state", F.when(F.col("returns") == 0, "open").when(F.col("returns") == 1, "returned").otherwise("conflict"))
