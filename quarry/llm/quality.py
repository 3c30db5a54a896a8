"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of a text are Column expressions. A bounded sample of labelled rows is scored with them; small boosted trees
are fitted to it, every path from a root becomes a conjunctive rule, and a lasso logistic regression leaves few of the
rules. These are compiled back into one Column expression, so scoring stays inside code generation and runs over whole
texts at the speed of a scan.

Labels are learnt only from rows outside the held-out fifth (crc32 of doc_id as text mod 5 is not 0), and of these from
at most ``sample_rows``, taken in the order of a hash of doc_id. Labels, language, source and doc_id are no inputs.

Defined results: a null text counts as empty and is scored as such; null labels are left out and repeated labels of a
doc_id are averaged; without labels of both classes every score is the share of ones (1 if there are none at all);
repeated rows are scored each by itself; very long texts are scored whole, in the memory of one task; a score equal to the
threshold is predicted 1; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bound of the sample that the classifier is fitted to.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, LEARNING_RATE = 24, 3, 32, 0.3
PENALTY = 2e-3
STEPS = 250
MIN_LEAF = 10


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def base_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts that the statistics are made of, from one pass over each whole text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("double")  # noqa: E731  characters that remain
    words = F.split(F.regexp_replace(t, "\n", " "), " ")
    return df.withColumns({
        "_chars": F.length(t).cast("double"),
        "_words": F.size(words).cast("double"),
        "_kinds": F.size(F.array_distinct(words)).cast("double"),
        "_lower": left(r"[^\p{Ll}]+"),
        "_upper": left(r"[^\p{Lu}]+"),
        "_digits": left("[^0-9]+"),
        "_stops": left("[^.,;:?]+"),
        "_bangs": left("[^!]+"),
        "_signs": left(r"[^#$%&*+/<=>@\\^_`{|}~]+"),
        "_lines": F.size(F.split(t, "\n")).cast("double"),
        "_line_kinds": F.size(F.array_distinct(F.split(t, "\n"))).cast("double"),
    })


#: The statistics by name, over the columns of ``base_columns``.
STATISTICS = {
    "log_chars": lambda: F.log1p("_chars"),
    "word_length": lambda: F.col("_chars") / F.col("_words"),
    "distinct_words": lambda: F.col("_kinds") / F.sqrt("_words"),
    "distinct_share": lambda: F.col("_kinds") / F.col("_words"),
    "lower_share": lambda: F.col("_lower") / F.greatest("_chars", F.lit(1.0)),
    "upper_share": lambda: F.col("_upper") / F.greatest("_chars", F.lit(1.0)),
    "digit_share": lambda: F.col("_digits") / F.greatest("_chars", F.lit(1.0)),
    "stops_per_word": lambda: F.col("_stops") / F.col("_words"),
    "bangs_per_word": lambda: F.col("_bangs") / F.col("_words"),
    "signs_per_word": lambda: F.col("_signs") / F.col("_words"),
    "words_per_line": lambda: F.col("_words") / F.col("_lines"),
    "distinct_lines": lambda: F.col("_line_kinds") / F.col("_lines"),
}
NAMES = list(STATISTICS)


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float


Rule = tuple[Condition, ...]


@dataclass
class RuleEnsemble:
    """An intercept and weighted conjunctions of conditions."""

    intercept: float
    rules: list[tuple[Rule, float]]

    def matrix(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * rule_values(rule, x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score as a Column over the columns of STATISTICS."""
        z = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            met = F.lit(True)
            for c in rule:
                col = F.col(f"_s_{NAMES[c.feature]}")
                met = met & ((col > c.threshold) if c.above else (col <= c.threshold))
            z = z + F.when(met, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def rule_values(rule: Rule, x: np.ndarray) -> np.ndarray:
    met = np.ones(len(x), bool)
    for c in rule:
        met &= (x[:, c.feature] > c.threshold) if c.above else (x[:, c.feature] <= c.threshold)
    return met


def grow(binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """One tree of the given depth: the rule of every node below the root, and the step of each row."""
    rules: list[Rule] = []
    step = np.zeros(len(gradient))
    todo: list[tuple[np.ndarray, Rule]] = [(np.arange(len(gradient)), ())]
    while todo:
        rows, rule = todo.pop()
        g, h = gradient[rows], hessian[rows]
        best = (1e-6, -1, -1)
        if len(rule) < DEPTH and len(rows) >= 2 * MIN_LEAF:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                b = binned[rows, f]
                gs = np.cumsum(np.bincount(b, g, len(cut) + 1))[:-1]
                hs = np.cumsum(np.bincount(b, h, len(cut) + 1))[:-1]
                ns = np.cumsum(np.bincount(b, minlength=len(cut) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                gain[(ns < MIN_LEAF) | (len(rows) - ns < MIN_LEAF)] = 0
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), f, i)
        if best[1] < 0:
            step[rows] = LEARNING_RATE * g.sum() / (h.sum() + 1)
            continue
        f, i = best[1:]
        below = binned[rows, f] <= i
        for above, part in ((False, rows[below]), (True, rows[~below])):
            longer = (*rule, Condition(f, above, float(cuts[f][i])))
            rules.append(longer)
            todo.append((part, longer))
    return rules, step


def lasso(values: np.ndarray, y: np.ndarray, penalty: float, start: float) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps."""
    n, m = values.shape
    w, b = np.zeros(m), start
    v, c, t = w.copy(), b, 1.0
    # The largest eigenvalue of the small product, rather than singular values of a copy of all rows.
    size = 0.25 * (float(np.linalg.eigvalsh(values.T @ values)[-1]) / n + 1)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(values @ v + c)))
        d = (p - y) / n
        new = v - values.T @ d / size
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / size, 0)
        new_b = c - d.sum() / size
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return b, w


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> RuleEnsemble:
    """Rules from boosted trees, weighted by the lasso. One class alone gives a constant."""
    if not len(y):
        return RuleEnsemble(20.0, [])
    share = float(np.clip(y.mean(), 1e-9, 1 - 1e-9))
    base = math.log(share / (1 - share))
    if y.min() == y.max():
        return RuleEnsemble(base, [])
    cuts = []
    for f in range(x.shape[1]):
        distinct = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        # Thin tails matter here: junk is rare, so the last hundredths get cuts of their own.
        tails = np.unique(np.quantile(x[:, f], [0.002, 0.005, 0.01, 0.02, 0.98, 0.99, 0.995, 0.998]))
        cuts.append(np.unique(np.concatenate((distinct, tails))))
    binned = np.stack([np.searchsorted(cut, x[:, f], side="left") for f, cut in enumerate(cuts)], axis=1)
    z, rules = np.full(len(y), base), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        found, step = grow(binned, cuts, y - p, p * (1 - p))
        z = z + step
        rules |= dict.fromkeys(found)
    names = list(rules)
    if not names:
        return RuleEnsemble(base, [])
    values = np.empty((len(x), len(names)))
    for i, rule in enumerate(names):
        values[:, i] = rule_values(rule, x)
    b, w = lasso(values, y, penalty, base)
    return RuleEnsemble(float(b), [(r, float(c)) for r, c in zip(names, w, strict=True) if abs(c) > 1e-6])


def with_statistics(docs: DataFrame) -> DataFrame:
    df = base_columns(docs)
    return df.withColumns({f"_s_{n}": make() for n, make in STATISTICS.items()})


def labelled_sample(labels: DataFrame, sample_rows: int) -> DataFrame:
    """doc_id and label of at most ``sample_rows`` rows outside the held-out fifth, in the order of a hash."""
    rows = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id")))
    one = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("_y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    sample = labelled_sample(labels, sample_rows)  # bounded, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    seen = with_statistics(rows).select("doc_id", "_y", *[f"_s_{n}" for n in NAMES])
    # Repeated doc_ids in the documents must not lift the bound.
    got = seen.orderBy(F.xxhash64("doc_id"), "doc_id", *[f"_s_{n}" for n in NAMES]).limit(sample_rows).drop("doc_id").toArrow()
    data = np.column_stack([c.to_numpy() for c in got.columns]).astype(np.float64)
    return fit(data[:, 1:], data[:, 0])


def score(docs: DataFrame, model: RuleEnsemble, name: str = "score") -> DataFrame:
    """The columns of ``docs``, whatever their names, and the score of each whole text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return with_statistics(docs.select(row, "text")).select("_row.*", model.column().alias(name))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = train(docs, labels, sample_rows)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
