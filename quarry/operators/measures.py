"""Measurements and decisions: usage as supplied, stage times, gates, bounded signatures, bindings and a report's figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN_FIELDS = ("input_tokens", "output_tokens", "total_tokens")


def normalized_usage(supplied: Column) -> Column:
    """Usage (JSON text) with what is malformed set to null, and a diagnostic (path, reason) for each field so lost."""
    return F.transform(F.array(F.try_parse_json(supplied)), lambda v: usage_of(supplied, v))[0]  # parsed once


def usage_of(supplied: Column, v: Column) -> Column:
    kind = lambda path: F.schema_of_variant(F.variant_get(v, path, "variant"))
    is_object = lambda k: k.startswith("OBJECT")
    absent = lambda k: k.isNull() | (k == "VOID")
    top = kind("$")
    diagnosis = lambda bad, path, reason: F.when(bad, F.struct(F.lit(path).alias("path"), F.lit(reason).alias("reason")))
    fields, found = [], [
        diagnosis(supplied.isNotNull() & ~F.coalesce(is_object(top) | (top == "VOID"), F.lit(False)), "usage", "expected object"),
        diagnosis(~absent(kind("$.tokens")) & ~is_object(kind("$.tokens")), "usage.tokens", "expected object or null"),
    ]
    for name in TOKEN_FIELDS:
        k, n = kind(f"$.tokens.{name}"), F.try_variant_get(v, f"$.tokens.{name}", "long")
        good = k.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$") & (n >= 0)
        fields.append(F.when(good, n).alias(name))
        found.append(diagnosis(~absent(k) & ~F.coalesce(good, F.lit(False)), f"usage.tokens.{name}", "expected nonnegative integer or null"))
    k, cost = kind("$.monetary_cost"), F.try_variant_get(v, "$.monetary_cost", "double")
    good = k.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (cost >= 0) & (cost < float("inf"))
    found.append(diagnosis(~absent(k) & ~F.coalesce(good, F.lit(False)), "usage.monetary_cost", "expected finite nonnegative number or null"))
    fields.append(F.when(good, cost).alias("monetary_cost"))
    k, currency = kind("$.currency"), F.try_variant_get(v, "$.currency", "string")
    good = (k == "STRING") & (F.trim(currency) != "")
    found.append(diagnosis(~absent(k) & ~F.coalesce(good, F.lit(False)), "usage.currency", "expected nonempty string or null"))
    return F.struct(*fields, F.when(good, currency).alias("currency"), F.array_compact(F.array(*found)).alias("diagnostics"))


def stage_totals(measurements: DataFrame) -> DataFrame:
    """Times, errors and prices of each stage (measurement_id, stage, local_seconds, monetary_cost, currency, status).

    A measurement counts once; the complete cost is given only where every measurement has one, all in one currency.
    """
    once = measurements.dropDuplicates(["measurement_id"])
    priced = F.col("monetary_cost").isNotNull() & F.col("currency").isNotNull()
    known = F.sum(F.when(priced, F.col("monetary_cost")))
    return once.groupBy("stage").agg(
        F.count("*").alias("measurements"), F.round(F.coalesce(F.sum("local_seconds"), F.lit(0.0)), 3).alias("local_seconds"),
        F.count_if(F.col("local_seconds").isNull()).alias("missing_time"), F.count_if(~priced).alias("unpriced"), F.count_if(F.col("status") == "error").alias("errors"),
        F.round(known, 2).alias("known_cost"), F.when((F.count_if(~priced) == 0) & (F.count_distinct("currency") == 1), F.round(known, 2)).alias("complete_cost"),
    )


def local_times(stages: DataFrame, delegated: DataFrame, rate: float) -> DataFrame:
    """Own time and cost of each stage (stage_id, start, stop) without that of the calls it waited for (stage_id, start, stop).

    These run one after the other, so their times add up; more of it than the stage took makes its own time unknown.
    """
    waited = delegated.groupBy("stage_id").agg(F.sum(F.col("stop") - F.col("start")).alias("delegated"))
    j = stages.join(waited, "stage_id", "left").fillna(0, ["delegated"])
    elapsed = F.col("stop") - F.col("start")
    own = F.when(F.col("delegated") <= elapsed, elapsed - F.col("delegated"))
    return j.select("stage_id", elapsed.alias("elapsed"), "delegated", own.alias("own"), F.round(own * rate, 6).alias("cost"))


def decision_gates(cases: DataFrame, plans: DataFrame, criteria: dict[str, float], required: tuple[str, ...]) -> DataFrame:
    """The gates of each comparison (plan_id, planned_calls, unchanged, cost, verified) and its status; what can't be told is null.

    cases: plan_id, split, gain, spread (null: not known). A plan with an unknown gain, or a gate that can't be told, is unknown
    as a whole; else all gates must hold. ``verified`` is not null only where a verification was planned: 'pass' or another.
    """
    gain = lambda s: F.when(F.col("split") == s, F.col("gain"))
    n = lambda s: F.count_if(F.col("split") == s)
    c = cases.groupBy("plan_id").agg(
        F.count_if(F.col("gain").isNull()).alias("open"), n("target").alias("targets"), n("regression").alias("regressions"), n("transfer").alias("transfers"),
        F.avg(gain("target")).alias("target"), F.min(gain("regression")).alias("regression"), F.avg(gain("transfer")).alias("transfer"),
        F.min(gain("transfer")).alias("transfer_low"), F.max("spread").alias("spread"), F.count_if(F.col("spread").isNull()).alias("unranged"),
    )
    j = plans.join(c, "plan_id", "left").fillna(0, ["targets", "regressions", "transfers"])
    whole = F.coalesce(F.col("open") == 0, F.lit(False))
    told = lambda test, also=F.lit(True): F.when(whole & also, test)
    gates = {
        "complete_results": whole,
        "target_gain": told(F.col("target") > criteria["target_mean_gain_must_exceed"]),
        "regression_non_decrease": told(F.coalesce(F.col("regression") >= -criteria["maximum_per_case_regression"], F.lit(True))),
        "call_budget": F.col("planned_calls") <= criteria["maximum_evaluation_calls"],
        "scope_bound": (F.col("targets") > 0) & (F.col("regressions") > 0) & ((F.col("transfers") > 0) | F.lit(not criteria["transfer_claim"])),
        "versions_unchanged": F.col("unchanged"),
        "transfer_gain": told(F.col("transfer") > criteria["transfer_mean_gain_must_exceed"], F.col("transfers") > 0),
        "transfer_non_decrease": told(F.col("transfer_low") >= -criteria["maximum_per_case_transfer_regression"], F.col("transfers") > 0),
        "stability": told(F.col("spread") <= criteria["maximum_score_range"], F.col("unranged") == 0),
        "cost": F.col("cost") <= criteria["maximum_monetary_cost"],
    }
    rows = [F.struct(F.lit(g).alias("gate"), gates[g].alias("passed")) for g in required]
    rows.append(F.when(F.col("verified").isNotNull(), F.struct(F.lit("verification_complete").alias("gate"), F.when(F.col("verified") != "unknown", F.col("verified") == "pass").alias("passed"))))
    j = j.select("plan_id", whole.alias("_whole"), F.array_compact(F.array(*rows)).alias("gates"))
    unknown = ~F.col("_whole") | F.exists("gates", lambda g: g["passed"].isNull())
    status = F.when(unknown, "unknown").when(F.forall("gates", lambda g: F.coalesce(g["passed"], F.lit(False))), "accepted").otherwise("rejected")
    return j.select("plan_id", status.alias("status"), F.inline("gates"))


def bounded_signature(features: DataFrame, by: str, max_chars: int, base: int) -> DataFrame:
    """Features (by, seq, field, value) of each group that fit within its characters, in order, and how many occurrences do not.

    A value takes its characters, two quotes and, unless it is its field's first, a comma; ``base`` is what an empty signature and its
    counters take. A later, shorter value may fit where a longer one did not. Occurrences are counted as often as they are met
    without being kept. One group's distinct values are folded in one row.
    """
    once = features.groupBy(by, "field", "value").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    lists = once.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("seq", "field", "value", "n"))).alias("f"))
    kept = F.array().cast("array<struct<field:string,value:string>>")
    zero = F.lit(0).cast("long")

    def step(s: Column, x: Column) -> Column:
        cost = F.length(x["value"]) + 2 + F.when(F.exists(s["kept"], lambda k: k["field"] == x["field"]), 1).otherwise(0)
        fits = s["size"] + cost <= max_chars
        evidence = x["field"] == "evidence_refs"
        return F.struct(
            (s["size"] + F.when(fits, cost).otherwise(0)).cast("long").alias("size"),
            F.when(fits, F.array_append(s["kept"], F.struct(x["field"].alias("field"), x["value"].alias("value")))).otherwise(s["kept"]).alias("kept"),
            (s["features"] + F.when(fits | evidence, 0).otherwise(x["n"])).alias("features"), (s["evidence"] + F.when(fits | ~evidence, 0).otherwise(x["n"])).alias("evidence"))

    first = F.struct(F.lit(base).cast("long").alias("size"), kept.alias("kept"), zero.alias("features"), zero.alias("evidence"))
    s = lists.select(by, F.aggregate("f", first, step).alias("s"))
    values = lambda field: F.array_sort(F.transform(F.filter("s.kept", lambda k: k["field"] == field), lambda k: k["value"])).alias(field)
    fields = ("criterion_ids", "error_codes", "resource_kinds", "symptom_terms", "evidence_refs")
    return s.select(by, *[values(f) for f in fields], F.col("s.features").alias("omitted_features"), F.col("s.evidence").alias("omitted_evidence"), ((F.col("s.features") == 0) & (F.col("s.evidence") == 0)).alias("complete"))


def known_criterion(bound: Column, status: Column, outcome: Column, score: Column, n_evidence: Column) -> Column:
    """Whether a criterion's result counts: bound, evaluated, passed or failed, with a score in 0 to 1 and with evidence."""
    return F.coalesce(bound & (status == "ok") & outcome.isin("pass", "fail") & score.between(0, 1) & (n_evidence > 0), F.lit(False))


def slot_states(slots: DataFrame, runs: DataFrame, bindings: list[str]) -> DataFrame:
    """Planned slots (run_id, group_id, ...) with their run: missing, contradictory if a binding differs, or bound with its end."""
    r = runs.select("run_id", "execution_status", F.struct("group_id", *bindings).alias("_r"), F.lit(True).alias("_seen"))
    j = slots.join(r, "run_id", "left")
    same = F.coalesce(F.col("_r") == F.struct("group_id", *bindings), F.lit(False))
    state = F.when(F.col("_seen").isNull(), "missing").when(~same, "contradictory").otherwise("bound")
    return j.select("group_id", "run_id", state.alias("state"), F.when(state == "bound", F.col("execution_status")).otherwise("unknown").alias("execution_status"))


def binding_errors(plans: DataFrame, validations: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each validation of a plan with the names of the columns in which the two differ."""
    p = plans.select(key, F.struct(*columns).alias("_p"))
    wrong = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_p.{c}")), F.lit(c)) for c in columns]))
    return validations.join(p, key).select(key, "validation_id", "status", wrong.alias("errors"))


def reference_violations(*checks: tuple[str, DataFrame, str, str, DataFrame, str]) -> DataFrame:
    """References without a target, of all checks (name, rows, id, reference, targets, target's key), as one table."""
    found = [rows.filter(F.col(ref).isNotNull()).select(F.lit(name).alias("check"), F.col(key).cast("string").alias("id"), F.col(ref).cast("string").alias("reference")).join(
        targets.select(F.col(target).cast("string").alias("reference")).distinct(), "reference", "left_anti").select("check", "id", "reference") for name, rows, key, ref, targets, target in checks]
    return reduce(DataFrame.unionByName, found)


def import_problems(rows: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """Why a batch of records cannot be imported: rows without an id, ids with several contents, or other contents than stored.

    The batch goes in whole if there is no problem, and not at all otherwise; what is stored already with the same content is no
    problem.
    """
    nameless = rows.filter(F.col(key).isNull()).groupBy().agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(None).cast("string").alias("id"), F.lit("missing_id").alias("problem"))
    named = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("id")).agg(F.count_distinct(digest).alias("versions"), F.min(digest).alias("_d"))
    old = stored.select(F.col(key).cast("string").alias("id"), F.col(digest).alias("_stored"))
    problem = F.when(F.col("versions") > 1, "several_contents").when(F.col("_stored") != F.col("_d"), "conflicts_with_stored")
    return named.join(old, "id", "left").select("id", problem.alias("problem")).filter("problem is not null").unionByName(nameless)


def update_batches(tasks: DataFrame, by: str, order: str, mode: str, width: int = 1, purpose: str = "learning") -> DataFrame:
    """The batch of each task and how learning goes on after it: one task a batch behind a barrier, ``width`` tasks, or not at all."""
    if purpose not in ("learning", "validation", "final") or mode not in ("task_barrier", "frozen_microbatch", "none"):
        raise ValueError("an explicit purpose and update mode are needed")
    if purpose != "learning" and mode != "none":
        raise ValueError("validation and final sampling cannot learn")
    if width < 1:
        raise ValueError("a batch holds at least one task")
    at = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    size = width if mode == "frozen_microbatch" else 1
    return tasks.withColumn("batch", F.floor(at / size).cast("long")).withColumn("update_mode", F.lit(mode)).withColumn("learns", F.lit(mode != "none"))


def report(**figures: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """Figures of several tables as rows (section, metric, value): one aggregation for each table, a null value is unknown."""
    def rows(section: str, table: DataFrame, metrics: dict[str, Column]) -> DataFrame:
        one = table.agg(*[c.cast("double").alias(n) for n, c in metrics.items()])
        return one.select(F.inline(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(n).alias("metric"), F.round(F.col(n), 6).alias("value")) for n in metrics])))

    return reduce(DataFrame.unionByName, [rows(s, t, m) for s, (t, m) in figures.items()])
