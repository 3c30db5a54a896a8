"""Mixing documents to target weights of domains with soft membership, in DataFrame and SQL functions only.

The domains are the classes of the labelled table. A naive Bayes classifier over binned text statistics and the words
that mark toxic rows gives each document a posterior over the domains. With n tokens in document i and posterior p(i, d),
nonnegative rates r(i) are sought for which the expected tokens sum_i n(i) p(i, d) r(i) meet the targets: projected
gradient steps on the squared relative misses plus a small pull towards rate 1. A step needs only the domains' sums, so
each one is a single aggregation of a few numbers; the rates themselves are folded from the list of past misses, and
nothing but that list (domains times steps) reaches the driver. Where these steps stall or end short of the tolerance, Newton
steps
on the dual of the same problem, a number for each domain, go on until the tolerance or the minimum is reached, or for
a number of steps; each goes downhill, so the last point is the best. At the minimum targets can be missed, as soft posteriors need not allow them; the misses are
returned by ``mix_with_misses`` and ``mix`` warns of them.

The classifier is fitted to at most ``sample_rows`` labelled rows, taken in the order of a hash of doc_id; token totals,
posteriors and rates cover all documents.

Defined results: a null text counts as empty, and so has no tokens and the rate of its posterior; labels with nulls are
left out and repeated labels of a doc_id count by their largest values; a domain without labelled rows has posterior 0
and its target weight is shared among the others; without any labels every rate is 1; repeated rows are rows of their
own; very long texts count whole; ties of words or rows go by word or hash of doc_id; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize

#: (quality, toxic) of each domain.
DOMAINS = {"low": (0, 0), "low_toxic": (0, 1), "good": (1, 0), "good_toxic": (1, 1)}
SAMPLE_ROWS = 20_000
BINS = 8
#: Words that mark toxic rows, at most so many, each in at least so many labelled rows.
MARK_WORDS, MARK_ROWS = 64, 5
STEPS, TOLERANCE, PULL = 40, 1e-4, 1e-3
#: Steps over which the largest miss must fall to this share, or the Newton steps take over.
STALL, STALL_SHARE = 4, 0.7
#: Newton steps at most, and the slope of the dual below which a point is its minimum.
NEWTON_STEPS, FLAT = 200, 1e-9
#: The features are not independent; their joint evidence counts by this share.
EVIDENCE = 0.5


#: The statistics by name, over the columns of ``base``.
STATISTICS = {
    "log_chars": lambda: F.log1p("_chars"),
    "word_length": lambda: F.col("_chars") / F.col("_words"),
    "distinct_words": lambda: F.size("_kinds") / F.sqrt("_words"),
    "distinct_share": lambda: F.size("_kinds") / F.col("_words"),
    "lower_share": lambda: F.col("_lower") / F.greatest("_chars", F.lit(1.0)),
    "stops_per_word": lambda: F.col("_stops") / F.col("_words"),
    "bangs_per_word": lambda: F.col("_bangs") / F.col("_words"),
    "signs_per_word": lambda: F.col("_signs") / F.col("_words"),
}


def base(docs: DataFrame) -> DataFrame:
    """Counts of each whole text; one array of lower-case words serves the counts and the marking words."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("double")  # noqa: E731  characters that remain
    words = F.split(F.trim(F.lower(F.regexp_replace(t, r"[\s.,;:!?]+", " "))), " ")
    return docs.withColumns({
        "_chars": F.length(t).cast("double"),
        "_words": F.size(words).cast("double"),
        "_kinds": F.array_distinct(words),
        "_lower": left(r"[^\p{Ll}]+"),
        "_stops": left("[^.,;:?]+"),
        "_bangs": left("[^!]+"),
        "_signs": left(r"[^#$%&*+/<=>@\\^_`{|}~]+"),
        "_blank": F.length(F.trim(t)) == 0,
    })


def prepared(docs: DataFrame, marks: list[str] | None = None) -> DataFrame:
    """doc_id, n_tokens and the statistics of each whole text, with the number of different marking words in it."""
    n = F.when(F.col("_blank"), F.lit(0)).otherwise(F.col("_words")).cast("long")
    cols = [n.alias("n_tokens"), *[make().alias(f"_s_{k}") for k, make in STATISTICS.items()]]
    if marks is None:
        cols.append(F.col("_kinds").alias("_w"))
    else:
        found = F.size(F.array_intersect("_kinds", F.array(*[F.lit(m) for m in marks]))) if marks else F.lit(0)
        cols.append(F.least(found, F.lit(3)).alias("_m"))
    return base(docs).select("doc_id", *[c for c in docs.columns if c.startswith("_d")], *cols)


def labelled(labels: DataFrame, sample_rows: int) -> DataFrame:
    """doc_id and domain of a bounded number of labelled rows."""
    rows = labels.filter("quality is not null and toxic is not null and doc_id is not null")
    one = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    domain = F.lit(None).cast("string")
    for name, (quality, toxic) in DOMAINS.items():
        domain = F.when((F.col("quality") == quality) & (F.col("toxic") == toxic), name).otherwise(domain)
    return one.select("doc_id", domain.alias("_d")).filter("_d is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)


class DomainModel:
    """Naive Bayes over binned statistics: cuts and log likelihoods by domain."""

    def __init__(self, marks: list[str], cuts: dict[str, list[float]], priors: dict[str, float], table: dict[tuple[str, str], list[float]]):
        self.marks, self.cuts, self.priors, self.table = marks, cuts, priors, table

    def posteriors(self, df: DataFrame) -> DataFrame:
        """Adds p_<domain> to rows of ``prepared``."""
        if not self.priors:
            return df.withColumns({f"p_{d}": F.lit(1.0 / len(DOMAINS)) for d in DOMAINS})
        bins = {f"_b_{f}": bin_of(F.col(f"_s_{f}"), cuts) for f, cuts in self.cuts.items()} | {"_b_marks": F.col("_m")}
        df = df.withColumns(bins)
        logs = {}
        for d, prior in self.priors.items():
            total = F.lit(math.log(prior))
            for f in [*self.cuts, "marks"]:
                total = total + F.element_at(F.array(*[F.lit(x) for x in self.table[d, f]]), F.col(f"_b_{f}") + 1) * (1.0 if f == "marks" else EVIDENCE)
            logs[f"_l_{d}"] = total
        df = df.withColumns(logs)
        most = F.greatest(*logs) if len(logs) > 1 else F.col(next(iter(logs)))
        df = df.withColumn("_most", most).withColumns({f"_e_{d}": F.exp(F.col(f"_l_{d}") - F.col("_most")) for d in self.priors})
        total = sum((F.col(f"_e_{d}") for d in self.priors), F.lit(0.0))
        return df.withColumns({f"p_{d}": F.col(f"_e_{d}") / total if d in self.priors else F.lit(0.0) for d in DOMAINS})


def bin_of(value: Column, cuts: list[float]) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(value > c, 1).otherwise(0)
    return out


def fit_domains(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DomainModel:
    """Only the bounded sample's statistics are gathered: cuts, counts of bins and the marking words."""
    sample = F.broadcast(labelled(labels, sample_rows))  # at most sample_rows ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")
    seen = materialize(prepared(rows), "labelled-rows")
    toxic = F.col("_d").endswith("toxic")
    sizes = {r[0]: r[1] for r in seen.groupBy("_d").count().collect()}
    total = sum(sizes.values())
    if not total:
        return DomainModel([], {}, {}, {})
    n_toxic = sum(n for d, n in sizes.items() if d.endswith("toxic"))
    n_clean = total - n_toxic
    words = seen.select(toxic.alias("t"), F.explode("_w").alias("w")).filter("length(w) > 1")
    odds = words.groupBy("w").agg(F.count_if("t").alias("a"), F.count_if(~F.col("t")).alias("b")).filter(F.col("a") >= MARK_ROWS)
    odds = odds.withColumn("x", F.log((F.col("a") + 0.5) / (n_toxic + 1)) - F.log((F.col("b") + 0.5) / (n_clean + 1))).filter("x > 1.5")
    marks = [r[0] for r in odds.orderBy((F.col("x") * F.log1p("a")).desc(), "w").limit(MARK_WORDS).collect()] if n_toxic and n_clean else []
    found = F.size(F.array_intersect("_w", F.array(*[F.lit(m) for m in marks]))) if marks else F.lit(0)
    seen = seen.withColumn("_m", F.least(found, F.lit(3)))
    at = [i / BINS for i in range(1, BINS)]
    quantiles = seen.agg(*[F.percentile_approx(f"_s_{f}", at, 10_000).alias(f) for f in STATISTICS]).first()
    cuts = {f: sorted({float(x) for x in quantiles[f]}) for f in STATISTICS}
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), bin_of(F.col(f"_s_{f}"), cuts[f]).alias("b")) for f in STATISTICS], F.struct(F.lit("marks").alias("f"), F.col("_m").alias("b"))))
    counts = {(r[0], r[1], r[2]): r[3] for r in seen.select("_d", pairs.alias("x")).groupBy("_d", "x.f", "x.b").count().collect()}
    table = {}
    for d, n in sizes.items():
        for f in [*STATISTICS, "marks"]:
            size = 4 if f == "marks" else len(cuts[f]) + 1
            table[d, f] = [math.log((counts.get((d, f, b), 0) + 0.5) / (n + 0.5 * size)) for b in range(size)]
    return DomainModel(marks, cuts, {d: n / total for d, n in sizes.items()}, table)


def step_rates(misses: list[dict[str, float]], names: list[str]) -> Column:
    """The rate of a row after the steps that the given misses led to."""
    if not misses:
        return F.lit(1.0)
    past = F.array(*[F.struct(*[F.lit(m[d]).alias(f"m_{d}") for d in names]) for m in misses])

    def step(rate: Column, m: Column) -> Column:
        slope = sum((F.col(f"p_{d}") * m[f"m_{d}"] for d in names), F.lit(0.0)) + (rate - 1.0) * PULL
        return F.greatest(F.lit(0.0), rate - slope / (1 + PULL))

    return F.aggregate(past, F.lit(1.0), step)


def dual_rate(dual: np.ndarray, names: list[str]) -> Column:
    """The rate of a row that minimizes its share of the Lagrangian."""
    return F.greatest(F.lit(0.0), sum((F.col(f"p_{d}") * float(-x) for d, x in zip(names, dual, strict=True)), F.lit(1.0)))


def fit_dual(members: DataFrame, names: list[str], total: float, target: dict[str, float], shares: dict[str, float]) -> tuple[np.ndarray, list[dict[str, float]]]:
    """The dual values at which the rates meet the targets or the squared misses and the pull are least, and all misses.

    The dual is convex and piecewise quadratic, and the pull makes it strictly so: damped Newton steps end at its minimum.
    A trial is one aggregation of the domains' sums, of their products over rows with a rate above 0, and of one square.
    """
    k = len(names)
    goal, pull = np.array([target[d] for d in names]), PULL * np.array([shares[d] for d in names])
    p, n = [F.col(f"p_{d}") for d in names], F.col("n_tokens") / total

    def at(dual: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        live = F.when(F.col("_r") > 0, n).otherwise(0.0)
        sums = [F.sum(n * F.col("_r") * F.col("_r")), *[F.sum(n * x * F.col("_r")) for x in p], *[F.sum(live * p[i] * p[j]) for i in range(k) for j in range(i, k)]]
        got = list(members.withColumn("_r", dual_rate(dual, names)).agg(*sums).first())
        curve = np.zeros((k, k))
        curve[np.triu_indices(k)] = got[1 + k :]
        curve = curve + np.triu(curve, 1).T + np.diag(pull)
        return got[0] / 2 + dual @ goal + pull @ dual**2 / 2, np.array(got[1 : 1 + k]) - goal, curve

    dual = np.zeros(k)
    value, miss, curve = at(dual)
    history = [dict(zip(names, map(float, miss), strict=True))]
    step, scale = None, 1.0
    for _ in range(NEWTON_STEPS):
        fall = miss - pull * dual
        if np.abs(miss).max() < TOLERANCE or np.abs(fall).max() < FLAT:
            return dual, history
        step = np.linalg.solve(curve, fall)
        near = at(dual + scale * step)
        if near[0] > value - 1e-4 * scale * (step @ fall) and np.abs(near[1] - pull * (dual + scale * step)).max() >= FLAT:
            scale /= 2
            continue
        dual, (value, miss, curve), scale = dual + scale * step, near, min(1.0, 2 * scale)
        history.append(dict(zip(names, map(float, miss), strict=True)))
    return dual, history  # every step taken was downhill, so this is the best point found; its misses are the last ones


def fit_rates(members: DataFrame, weights: dict[str, float]) -> tuple[DataFrame, list[dict[str, float]]]:
    """Rates for rows with n_tokens and p_<domain>, and the misses of every step, the last being those of the rates."""
    sums = members.agg(F.sum("n_tokens").cast("double").alias("n"), *[F.sum(F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in DOMAINS]).first()
    total = sums["n"] or 0.0
    shares = {d: (sums[d] or 0.0) / total for d in DOMAINS} if total else {}
    names = [d for d in DOMAINS if shares.get(d, 0.0) > 0]
    whole = sum(weights.get(d, 0.0) for d in names)
    if not names or whole <= 0:
        return members.withColumn("rate", F.lit(1.0)), []
    target = {d: weights.get(d, 0.0) / whole for d in names}
    misses: list[dict[str, float]] = []
    history: list[dict[str, float]] = []
    for _ in range(STEPS):
        rate = step_rates(misses, names)
        got = members.withColumn("_r", rate).agg(*[F.sum(F.col("n_tokens") * F.col(f"p_{d}") * F.col("_r")).alias(d) for d in names]).first()
        miss = {d: got[d] / total - target[d] for d in names}
        history.append(miss)
        worst = [max(abs(x) for x in m.values()) for m in history]
        if worst[-1] < TOLERANCE:
            return members.withColumn("rate", F.round(rate, 6)), history
        if len(worst) > STALL and worst[-1] > STALL_SHARE * worst[-1 - STALL]:
            break
        # Relative to the domain's own share, so that small domains are met as fast as large ones.
        misses.append({d: miss[d] / shares[d] for d in names})
    dual, more = fit_dual(members, names, total, target, shares)
    return members.withColumn("rate", F.round(dual_rate(dual, names), 6)), history + more


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], sample_rows: int = SAMPLE_ROWS, key: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, p_<domain> and rate of every document; warns where targets are missed. ``key`` replaces doc_id."""
    rows, misses = mix_with_misses(docs, labels, weights, sample_rows, key)
    if any(abs(x) >= TOLERANCE for x in misses.values()):
        warnings.warn(f"The posteriors do not allow the targets; shares of all tokens off by {misses}", stacklevel=2)
    return rows


def mix_with_misses(docs: DataFrame, labels: DataFrame, weights: dict[str, float], sample_rows: int = SAMPLE_ROWS, key: Column | None = None) -> tuple[DataFrame, dict[str, float]]:
    """The rows of ``mix``, and by how much of all tokens each domain's expected tokens are off its target."""
    model = fit_domains(docs, labels, sample_rows)
    rows = docs.select((F.col("doc_id") if key is None else key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = model.posteriors(prepared(rows, model.marks)).select("doc_id", "n_tokens", *[f"p_{d}" for d in DOMAINS])
    rows, history = fit_rates(materialize(members, "members"), weights)
    return rows, history[-1] if history else {}


def copies(rate: Column, doc_id: Column) -> Column:
    """Whole copies of a document at a rate: its floor, and one more with the odds of the rest, by a hash of the id."""
    unit = F.pmod(F.xxhash64(doc_id, F.lit("mix")), F.lit(1_000_003)) / 1_000_003.0
    return F.floor(rate + unit).cast("int")
