"""Packets with a bound of characters: what is taken, what is only named, and how texts are cut to pieces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.events import selection_units
from quarry.operators.lineage import cut
from quarry.operators.records import open_pairs

#: Characters counted for a fragment's and a locator's own fields, besides the text.
FRAGMENT_CHARS, LOCATOR_CHARS = 350, 450
#: Rows that one round of ``fitting`` settles at most.
ROUND_ROWS = 20_000


def piece_starts(length: Column, anchor: Column, width: int, extra: int) -> Column:
    """Starts of a text's pieces in order: about the anchor (null: none), the first, the last, then ``extra`` windows."""
    near = F.greatest(anchor - width // 4, F.lit(0))
    last = F.greatest(length - width, F.lit(0))
    most = F.least(F.lit(extra + 1), F.ceil(length / width)).cast("int")
    further = F.when(most > 1, F.transform(F.sequence(F.lit(1), most - 1), lambda i: i * width)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(F.array_compact(F.array(near.cast("int"), F.lit(0), last.cast("int"))), further))


def pieces(rows: DataFrame, text: str, anchor: Column, width: int, extra: int) -> DataFrame:
    """Each row's pieces of at most ``width`` characters, with the bytes that they span in the whole text."""
    cut = F.transform(piece_starts(F.length(text), anchor, width, extra), lambda s, i: F.struct(
        i.alias("place"), F.octet_length(F.substring(F.col(text), F.lit(1), s)).cast("long").alias("start_byte"), F.substring(F.col(text), s + 1, F.lit(width)).alias("piece")))
    out = rows.filter(F.col(text).isNotNull()).select("*", F.inline(cut)).drop(text)
    return out.withColumn("end_byte", F.col("start_byte") + F.octet_length("piece"))


def evidence_packet(events: DataFrame, focus: DataFrame, max_chars: int, max_catalog: int, width: int) -> DataFrame:
    """The events of a bounded packet: given as fragments, named as locators of what can be read on demand, or left out.

    Units (calls or single events) come in the order of ``selection_units``. A unit whose fragments fit is given whole; of a call
    that does not fit, the action is given and its results are named; a quarter of the characters is kept back for names, and
    calls left out get a second chance with it. The number of units that can fit follows from the bounds, so the choice is made
    over one short array. events: episode_id, event_id, position, call_id, kind, failed, text.
    """
    cap = max(1, max_chars // FRAGMENT_CHARS + max_catalog)
    reserve = min(max_chars // 4, max_catalog * LOCATOR_CHARS)
    units = selection_units(events, focus).orderBy("priority", "turn", "episode_id", "unit").limit(cap)
    unit = F.coalesce(F.concat(F.lit("c"), F.col("call_id")), F.concat(F.lit("e"), F.col("event_id")))
    rows = events.withColumn("unit", unit).join(F.broadcast(units.select("priority", "turn", "episode_id", "unit")), ["episode_id", "unit"])
    cost = F.least(F.length("text"), F.lit(width)) + FRAGMENT_CHARS
    action, result = F.col("kind") == "action", F.col("kind").isin("result", "observation")
    sums = rows.groupBy("priority", "turn", "episode_id", "unit").agg(
        F.sum(cost).alias("whole"), F.sum(F.when(result, 0).otherwise(cost)).alias("part"), F.count_if(action).alias("actions"), F.count_if(result).alias("results"))
    ordered = sums.agg(F.array_sort(F.collect_list(F.struct("priority", "turn", "episode_id", "unit", "whole", "part", "actions", "results"))).alias("units"))

    def step(kept_back: int, again: bool):
        def one(s: Column, u: Column) -> Column:
            named = u["part"] + u["results"] * LOCATOR_CHARS
            fits = F.lit(False) if again else s["used"] + u["whole"] <= max_chars - kept_back
            paired = (u["actions"] > 0) & (u["results"] > 0) & (s["named"] + u["results"] <= max_catalog) & (s["used"] + named <= max_chars - kept_back)
            state = F.when(fits, "given").when(paired, "named").otherwise("omitted")
            state = F.when(u["state"] != "omitted", u["state"]).otherwise(state) if again else state
            fresh = F.lit(True) if not again else u["state"] == "omitted"
            used = F.when(fresh & (state == "given"), u["whole"]).when(fresh & (state == "named"), named).otherwise(0)
            more = F.when(fresh & (state == "named"), u["results"]).otherwise(0)
            row = F.struct(u["episode_id"].alias("episode_id"), u["unit"].alias("unit"), u["whole"].alias("whole"), u["part"].alias("part"), u["actions"].alias("actions"), u["results"].alias("results"), state.alias("state"))
            return F.struct((s["used"] + used).alias("used"), (s["named"] + more).alias("named"), F.array_append(s["rows"], row).alias("rows"))
        return one

    kind = events.schema["episode_id"].dataType.simpleString()
    empty = F.array().cast(f"array<struct<episode_id:{kind},unit:string,whole:bigint,part:bigint,actions:bigint,results:bigint,state:string>>")
    zero = F.lit(0).cast("long")
    first = F.aggregate("units", F.struct(zero.alias("used"), zero.alias("named"), empty.alias("rows")), step(reserve, False))
    done = ordered.select(first.alias("s")).select(F.aggregate("s.rows", F.struct(F.col("s.used").alias("used"), F.col("s.named").alias("named"), empty.alias("rows")), step(0, True)).alias("s"))
    states = done.select(F.inline("s.rows")).select("episode_id", "unit", "state")
    part = F.when((F.col("state") == "named") & result, "locator").when(F.col("state") == "omitted", "omitted").otherwise("fragment")
    out = rows.join(F.broadcast(states), ["episode_id", "unit"])
    return out.select("episode_id", "unit", "event_id", part.alias("part"), F.when(part == "fragment", F.substring("text", 1, width)).alias("text"))


def visible_links(rows: DataFrame) -> DataFrame:
    """Links between a packet's events (turn, episode_id, event_id, resource, version_ref, parent_event_id) on one resource.

    Versions match, differ, or cannot be told (null). Between episodes only matching versions link, and coverage is partial.
    """
    names = ("turn", "episode_id", "event_id", "version_ref", "parent_event_id")
    side = lambda s: rows.filter("resource is not null").select("resource", *[F.col(c).alias(f"{c}_{s}") for c in names])
    j = side("a").join(side("b"), "resource").filter(F.struct("turn_a", "episode_id_a", "event_id_a") < F.struct("turn_b", "episode_id_b", "event_id_b"))
    same, version = F.col("episode_id_a") == F.col("episode_id_b"), F.col("version_ref_a") == F.col("version_ref_b")
    parent = F.coalesce(F.col("parent_event_id_b") == F.col("event_id_a"), F.lit(False)) | F.coalesce(F.col("parent_event_id_a") == F.col("event_id_b"), F.lit(False))
    return j.filter(same | F.coalesce(version, F.lit(False))).select(
        F.col("event_id_a").alias("first_id"), F.col("event_id_b").alias("second_id"), "resource", version.alias("version_match"),
        F.when(same & parent, "declared_parent").otherwise("same_resource_candidate").alias("relation"), F.when(same, "complete").otherwise("partial").alias("coverage"))


def fitting(rows: DataFrame, key: str, order: list[Column], sizes: dict[str, int]) -> DataFrame:
    """Keys taken in order, each if all its sizes (column: capacity) still fit with those taken before; later, smaller ones may.

    What does not fit once never fits later, as the capacities only shrink. So in each round only rows that fit by themselves are
    left, and of these no more than the capacities have room for, by the smallest sizes, can matter: they are few, their number
    is bounded by the capacities, and one pass over them settles them. Rows without any size are all taken. Keys are distinct.
    """
    spark, names = rows.sparkSession, [f"_s{i}" for i in range(len(sizes))]
    narrow = cut(rows.select(F.col(key).alias("_key"), *[F.col(c).cast("long").alias(n) for n, c in zip(names, sizes)], *[o.alias(f"_o{i}") for i, o in enumerate(order)]))
    left = list(sizes.values())
    weightless = reduce(lambda a, b: a & b, [F.col(n) == 0 for n in names])
    kind = narrow.schema["_key"].dataType.simpleString()
    taken: list = []
    while True:
        fits = reduce(lambda a, b: a & b, [F.col(n) <= most for n, most in zip(names, left)])
        open_ = narrow.filter(fits & ~weightless)
        if taken:
            open_ = open_.join(F.broadcast(spark.createDataFrame([(k,) for k in taken], f"_key {kind}")), "_key", "left_anti")
        n, *least = open_.agg(F.count("*"), *[F.min(c) for c in names]).first()
        if not n:
            break
        room = min([most // small for most, small in zip(left, least) if small] or [ROUND_ROWS]) + 1
        first = open_.orderBy(*[f"_o{i}" for i in range(len(order))], "_key").limit(min(room, ROUND_ROWS))
        for row in first.select("_key", *names).collect():
            if all(need <= most for need, most in zip(row[1:], left)):
                left = [most - need for need, most in zip(row[1:], left)]
                taken.append(row[0])
    chosen = narrow.filter(weightless).select(F.col("_key").alias(key))
    return chosen.unionByName(spark.createDataFrame([(k,) for k in taken], f"`{key}` {kind}")) if taken else chosen


def maintenance_inputs(records: DataFrame, known: DataFrame, max_chars: int, max_pairs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records (record_id, seq, n_chars) within half of the characters, the pairs of them still to compare, and what is left out.

    A record counts once, with its first row, and its characters with a separator; a list has two brackets.
    """
    once = records.groupBy("record_id").agg(F.min("seq").alias("seq"), (F.min_by("n_chars", "seq") + 1).alias("size"))
    chosen = fitting(once, "record_id", [F.col("seq")], {"size": max_chars // 2 - 1})
    return chosen, open_pairs(chosen, known, max_pairs), once.select("record_id").join(chosen, "record_id", "left_anti")


def related_groups(experiences: DataFrame, query: list[str], limit: int, max_chars: int) -> DataFrame:
    """Experiences (record_id, head, terms, signature_score, has_evidence, n_chars) that share terms or failures with a query.

    Those of one conflict group (head; null: alone) enter together at the place of the best of them, or not at all, as long as their
    number and characters fit.
    """
    lexical = F.size(F.array_intersect("terms", F.array(*map(F.lit, query)).cast("array<string>")))
    scored = experiences.withColumn("score", (lexical + F.col("signature_score")).cast("long")).withColumn("head", F.coalesce("head", "record_id"))
    place = F.struct((-F.col("score")).alias("s"), (~F.col("has_evidence")).alias("e"), "record_id")
    groups = scored.groupBy("head").agg(F.min(F.when(F.col("score") > 0, place)).alias("place"), F.count("*").alias("n"), F.sum(F.col("n_chars") + 1).alias("size")).filter("place is not null")
    chosen = fitting(groups, "head", [F.col("place.s"), F.col("place.e"), F.col("place.record_id")], {"n": limit, "size": max_chars - 1})
    return scored.join(F.broadcast(chosen), "head", "left_semi").select("record_id", "head", "score")
