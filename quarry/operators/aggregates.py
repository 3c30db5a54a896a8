"""Aggregations in which the unknown is not zero: bounds, coverage, tri-state answers and complete totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rubric(proxies: DataFrame, by: str) -> DataFrame:
    """Mean score of the proxies and the recommendation by group."""
    out = proxies.groupBy(by).agg(F.avg("score").alias("mean"), F.count("*").alias("proxies"), F.sum("n_evidence").alias("evidence"))
    decision = F.when(F.col("mean") >= 4, "accept").when(F.col("evidence") > 0, "needs review").otherwise("needs evidence")
    return out.select(by, F.round("mean", 6).alias("mean"), "proxies", decision.alias("recommendation"))


def macro_score(proxies: DataFrame, by: str) -> DataFrame:
    """The mean of the criteria's means, which differs from the mean of all proxies."""
    return proxies.groupBy(by).agg(F.avg("score").alias("m")).agg(F.round(F.sum("m") / F.greatest(F.count("*"), F.lit(1)), 6).alias("overall"), F.count("*").alias("criteria"))


def any_state(passed: Column, unknown: Column) -> Column:
    return F.when(passed > 0, True).when(unknown > 0, F.lit(None).cast("boolean")).otherwise(False)


def all_state(failed: Column, unknown: Column, n: Column) -> Column:
    return F.when(failed > 0, False).when((unknown > 0) | (n == 0), F.lit(None).cast("boolean")).otherwise(True)


def quality(results: DataFrame, *by: str) -> DataFrame:
    """Outcome counts, rate over the known, coverage, bounds, and whether any and all passed."""
    c = results.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col("outcome") == "pass").alias("passed"), F.count_if(F.col("outcome") == "fail").alias("failed"),
    ).withColumn("unknown", F.col("n") - F.col("passed") - F.col("failed"))
    known = F.col("passed") + F.col("failed")
    return c.select(
        *by, "n", "passed", "failed", "unknown",
        F.round(F.try_divide(F.col("passed"), known), 6).alias("success_rate"), F.round(F.try_divide(known, F.col("n")), 6).alias("coverage"),
        F.round(F.try_divide(F.col("passed"), F.col("n")), 6).alias("lower"), F.round(F.try_divide(F.col("passed") + F.col("unknown"), F.col("n")), 6).alias("upper"),
        any_state(F.col("passed"), F.col("unknown")).alias("any_passed"), all_state(F.col("failed"), F.col("unknown"), F.col("n")).alias("all_passed"),
    )


def mode_groups(results: DataFrame, group: str, mode: str) -> DataFrame:
    """Groups first, then modes: how many groups had any and all passes, or could not tell."""
    g = quality(results, mode, group)
    states = lambda c: [F.count_if(F.col(c)).alias(f"{c}_true"), F.count_if(~F.col(c)).alias(f"{c}_false"), F.count_if(F.col(c).isNull()).alias(f"{c}_unknown")]
    return g.groupBy(mode).agg(F.count("*").alias("groups"), *states("any_passed"), *states("all_passed"))


def criterion_scores(items: DataFrame, by: str, threshold: float) -> DataFrame:
    """Weighted sum of criteria (by, weight, score or null) with bounds; missing weights stay in the denominator."""
    known = F.col("score").isNotNull()
    w = items.groupBy(by).agg(
        F.sum("weight").alias("w"), F.sum(F.when(known, F.col("weight") * F.col("score")).otherwise(0.0)).alias("s"),
        F.sum(F.when(known, 0.0).otherwise(F.col("weight"))).alias("m"), F.count("*").alias("expected"), F.count_if(known).alias("known"),
    )
    whole = F.col("known") == F.col("expected")
    score = F.when(whole, F.try_divide(F.col("s"), F.col("w")))
    return w.select(
        by, "expected", "known", F.round(F.try_divide("known", F.col("expected")), 6).alias("coverage"), F.round(score, 6).alias("score"),
        F.when(score >= threshold, "pass").when(score < threshold, "fail").otherwise("unknown").alias("outcome"),
        F.round(F.try_divide(F.col("s"), F.col("w")), 6).alias("lower"), F.round(F.try_divide(F.col("s") + F.col("m"), F.col("w")), 6).alias("upper"),
    )


def binary_all(items: DataFrame, by: str) -> DataFrame:
    """Any known failure fails, even with criteria missing; all known and none failed passes; else unknown."""
    c = items.groupBy(by).agg(F.count_if(F.col("outcome") == "fail").alias("f"), F.count_if(F.col("outcome").isNull()).alias("u"))
    out = F.when(F.col("f") > 0, "fail").when(F.col("u") == 0, "pass").otherwise("unknown")
    return c.select(by, out.alias("outcome"), F.when(out == "fail", 0.0).when(out == "pass", 1.0).alias("score"), F.when(out == "pass", 1.0).otherwise(0.0).alias("lower"), F.when(out == "fail", 0.0).otherwise(1.0).alias("upper"))


def usage_totals(usage: DataFrame, by: str) -> DataFrame:
    """Known and complete totals by group; a row without cost or currency makes the complete total unknown."""
    one = usage.dropDuplicates(["usage_id"])
    priced = F.col("monetary_cost").isNotNull() & F.col("currency").isNotNull()
    c = one.groupBy(by).agg(
        F.count("*").alias("calls"), F.count_if(~priced).alias("missing_cost"), F.sum(F.when(priced, F.col("monetary_cost"))).alias("s"),
        F.count_distinct(F.when(priced, F.col("currency"))).alias("currencies"),
        F.sum("input_tokens").alias("known_tokens"), F.count_if(F.col("input_tokens").isNull()).alias("missing_tokens"),
    )
    return c.select(
        by, "calls", "missing_cost", "currencies", F.round("s", 2).alias("known_cost"),
        F.when((F.col("missing_cost") == 0) & (F.col("currencies") == 1), F.round("s", 2)).alias("complete_cost"),
        "known_tokens", "missing_tokens", F.when(F.col("missing_tokens") == 0, F.col("known_tokens")).alias("complete_tokens"),
    )


def usage_conflicts(usage: DataFrame) -> DataFrame:
    """Usage ids that come with different contents, which is an error of the ledger."""
    rest = [c for c in usage.columns if c != "usage_id"]
    return usage.groupBy("usage_id").agg(F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in rest])).alias("versions")).filter("versions > 1")


def paired_outcomes(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Planned requests with their results: observed, missing or mismatched by binding."""
    r = results.select("request_id", F.col("binding").alias("_b"), "outcome", "score", "terminal_status", "monetary_cost", F.lit(True).alias("_seen"))
    j = requests.join(r, "request_id", "left")
    state = F.when(F.col("_seen").isNull(), "missing").when(F.col("_b") != F.col("binding"), "mismatched").otherwise("observed")
    j = j.withColumn("state", state)
    return j.select("request_id", "case_id", "split", "arm", "state", *[F.when(F.col("state") == "observed", F.col(c)).alias(c) for c in ("outcome", "score", "terminal_status", "monetary_cost")])


def arm_summaries(paired: DataFrame, repeats: int) -> DataFrame:
    """Mean and range of each case and arm where the planned repeats all have scores, and the gain of the candidate."""
    enough = (F.count("*") == F.lit(repeats)) & (F.count("score") == F.lit(repeats))
    g = paired.groupBy("split", "case_id", "arm").agg(F.when(enough, F.avg("score")).alias("mean"), F.when(enough, F.max("score") - F.min("score")).alias("spread"))
    p = g.groupBy("split", "case_id").agg(*[F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{a}_{c}") for a in ("baseline", "candidate") for c in ("mean", "spread")])
    return p.withColumn("gain", F.col("candidate_mean") - F.col("baseline_mean"))


def gates(summaries: DataFrame, min_gain: float, max_loss: float, max_spread: float) -> DataFrame:
    """Gates of a comparison and its decision: a gate that can't be told makes the whole unknown."""
    gain = lambda s: F.col("split") == s
    known = summaries.agg(
        F.count_if(F.col("gain").isNull()).alias("incomplete"),
        F.avg(F.when(gain("target"), F.col("gain"))).alias("target_gain"),
        F.min(F.when(gain("regression"), F.col("gain"))).alias("regression_low"),
        F.min(F.when(gain("transfer"), F.col("gain"))).alias("transfer_low"),
        F.max(F.greatest("baseline_spread", "candidate_spread")).alias("spread"),
    )
    ok = {"target": F.col("target_gain") > min_gain, "regression": F.col("regression_low") >= -max_loss, "transfer": F.col("transfer_low") >= -max_loss, "stability": F.col("spread") <= max_spread}
    unknown = F.col("incomplete") > 0
    for c in ok.values():
        unknown = unknown | c.isNull()
    every = F.lit(True)
    for c in ok.values():
        every = every & c
    return known.select("incomplete", F.round("target_gain", 6).alias("target_gain"), *[c.alias(f"{n}_gate") for n, c in ok.items()], F.when(unknown, "unknown").when(every, "accepted").otherwise("rejected").alias("decision"))


def rank_candidates(rows: DataFrame, key: str) -> DataFrame:
    """Order: mean gain falling, unknown cost last, cost rising, then the key.

    Rows are sorted over all partitions; a row's rank is its place in its own plus the rows of those before.
    """
    from pyspark.sql import Window

    from quarry.operators.lineage import cut

    placed = rows.orderBy(F.col("gain").desc(), F.col("cost").isNull(), F.col("cost"), F.col(key))
    placed = cut(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))  # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return placed.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn("rank", (own + F.col("_before")).cast("int")).drop("_part", "_at", "_before")


def extra_calls(attempts: DataFrame, key: str) -> DataFrame:
    """Planned calls and attempts beyond the first of each request."""
    return attempts.groupBy(key).count().agg(F.count("*").alias("planned"), F.sum(F.greatest(F.col("count") - 1, F.lit(0))).alias("extra"))


def requirement_status(cases: DataFrame, by: str) -> DataFrame:
    """fail if any case failed, else unknown if any is unknown or there are none, else pass."""
    c = cases.groupBy(by).agg(F.count_if(F.col("outcome") == "fail").alias("f"), F.count_if(F.col("outcome").isNull()).alias("u"))
    return c.select(by, F.when(F.col("f") > 0, "fail").when(F.col("u") > 0, "unknown").otherwise("pass").alias("status"))
