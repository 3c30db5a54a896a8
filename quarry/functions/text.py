"""Text functions of the memory vault as Column expressions. Lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words, patterns and labels that the functions below are defined by.
FAILURE_TERM = r"\b[A-Z][A-Z0-9_]{2,}(?:ERROR|FAIL|MISMATCH|MISSING)[A-Z0-9_]*\b|\b[A-Z][A-Za-z]+Error\b"
FAILURE_HINT = r"(?:(?i:\b(?:error|fail(?:ed|ure)?|traceback)\b|\bexception\s*[:(])|\b[A-Za-z][A-Za-z0-9]*(?:Error|Exception)\b|错误|失败|丢失|不通过)"
NO_ERROR = r"(?i)(?![\"\s]*:\s*(?:null|false|0\b|\"\"|\[\]|\{\}))"
RECOVERY_HINT = "(?i)recovery|retry|修复|恢复|重试|另一运行"
COUNTER_HINT = "(?i)counterexample|反例|妨碍"
SESSION_LABELS = {
    "decision": "decisions", "decisions": "decisions", "todo": "todos", "todos": "todos", "task": "todos", "evidence": "evidence", "source": "evidence",
    "open question": "open_questions", "question": "open_questions", "note": "notes", "notes": "notes",
}
TERMINAL_STATUSES = ("completed", "timeout", "cancelled", "budget_exhausted", "adapter_error")
STOP_WORDS = ("a", "an", "and", "be", "for", "in", "is", "must", "of", "or", "the", "to", "with")


def infer_kind(text: Column) -> Column:
    """Kind of a captured text by its first matching keyword."""
    t = F.lower(text)
    has = lambda *words: F.greatest(*[t.contains(w) for w in words], F.lit(False))
    return F.when(has("preference", "prefrence", "user"), "personal").when(has("evidence", "test", "citation"), "evidence").when(has("session", "scratchpad"), "session").otherwise("project")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def excerpt(text: Column, size: int = 500) -> Column:
    return F.substring(collapsed(text), 1, size)


def keyword_excerpt(text: Column, word: str) -> Column:
    """From 80 characters before the first match to 160 after it; without a match the first 240."""
    at = F.locate(word.lower(), F.lower(text)) - 1
    start = F.greatest(at - 80, F.lit(0))
    return F.when(at < 0, F.substring(text, 1, 240)).otherwise(F.substring(text, start + 1, at + len(word) + 160 - start))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title(page: Column, name: Column) -> Column:
    """The first level-one heading, or the file's name."""
    found = F.regexp_extract(page, r"(?m)^#\s+(.+)$", 1)
    return F.when(found != "", F.trim(found)).otherwise(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.md$", ""))


def token_set(text: Column) -> Column:
    """Distinct lower-case tokens of letters and digits of at least four characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: F.length(x) >= 4))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def day_delta(as_of: Column, ts: Column) -> Column:
    """Whole days from ts to as_of, null if ts is."""
    return F.floor((F.unix_millis(as_of) - F.unix_millis(ts)) / 86_400_000).cast("long")


def claim_polarity(text: Column) -> Column:
    """Polarity and key of a must/should claim; null if there is none. The negative form wins."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " "), " +", " "))
    no = F.regexp_extract(t, r"\b(?:must|should) not (.+)$", 1)
    yes = F.regexp_extract(t, r"\b(?:must|should) (.+)$", 1)
    pair = lambda p, key: F.struct(F.lit(p).alias("polarity"), F.trim(key).alias("key"))
    return F.when(no != "", pair("negative", no)).when(yes != "", pair("positive", yes))


def terms(text: Column) -> Column:
    """Distinct terms: words of letters, digits and underscores without stop words, and bigrams of Han runs, sorted."""
    words = F.array_except(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), F.array(*map(F.lit, STOP_WORDS)))
    runs = F.regexp_extract_all(text, F.lit("[一-鿿]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_sort(F.array_distinct(F.concat(words, pairs)))


def failure_terms(text: Column) -> Column:
    """Distinct words that name a failure, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(FAILURE_TERM), F.lit(0))))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 3).cast("long")


def text_windows(text: Column, width: int) -> Column:
    """A text in pieces of fixed width."""
    n = F.greatest(F.ceil(F.length(text) / width).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * width + 1, F.lit(width)))


def proposal_id(kind: Column, target: Column) -> Column:
    """The kind and the first 32 digits of the target in URL-safe base64, which its first 24 bytes give."""
    digits = F.translate(F.base64(F.substring(F.encode(target, "UTF-8"), 1, 24)), "+/=", "-_")
    return F.concat(F.lit("proposal:"), kind, F.lit(":"), digits)


def proposal_target(entry: Column) -> Column:
    """What comes after the last colon."""
    return F.element_at(F.split(entry, ":"), -1)


def budget_key(path: Column) -> Column:
    """The first part of a path below the root; a file without one counts for the root."""
    first = F.element_at(F.split(path, "/"), 1)
    return F.when(first == "", "root").otherwise(first)


def learning_role(namespace: Column, kind: Column, role: Column) -> Column:
    """What a record is chosen as; the observed metadata stay as they are."""
    return (
        F.when((namespace == "feedback") | (kind == "feedback"), "feedback").when((namespace == "requirement") | (role == "user"), "user")
        .when(kind == "action", "action").when((role == "agent") & kind.isin("note", "instruction"), "note")
        .when(kind.isin("result", "observation"), "result").otherwise("unknown")
    )


def middle_depth(position: Column, length: Column) -> Column:
    """The round in which halving picks a position (from 0) of a sequence: both ends first, then middles of middles."""
    start = F.struct(F.lit(1).cast("long").alias("lo"), (length - 2).cast("long").alias("hi"), F.lit(2).alias("depth"), F.lit(False).alias("met"))

    def halve(x: Column, _: Column) -> Column:
        middle = F.floor((x["lo"] + x["hi"]) / 2)
        met = x["met"] | (middle == position)
        return F.struct(
            F.when(~met & (position > middle), middle + 1).otherwise(x["lo"]).alias("lo"), F.when(~met & (position < middle), middle - 1).otherwise(x["hi"]).alias("hi"),
            F.when(met, x["depth"]).otherwise(x["depth"] + 1).alias("depth"), met.alias("met"),
        )

    inner = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(length, F.lit(2)))).cast("int") + 1), start, halve)
    return F.when(position == 0, 0).when(position == length - 1, 1).otherwise(inner["depth"])


def signature_score(criteria: Column, other_criteria: Column, errors: Column, other_errors: Column, symptoms: Column, other_symptoms: Column, same_operation: Column) -> Column:
    common = lambda a, b: F.size(F.array_intersect(a, b))
    return (4 * common(criteria, other_criteria) + 3 * common(errors, other_errors) + common(symptoms, other_symptoms) + same_operation.cast("int")).cast("long")


def failure_position(text: Column) -> Column:
    """Where the first failure hint begins (from 0) that no serialized absence of an error follows; null if none."""
    at = F.regexp_instr(text, F.lit(FAILURE_HINT + NO_ERROR))
    return F.when(at > 0, at - 1)


def event_role(kind: Column, text: Column) -> Column:
    return (
        F.when(kind == "instruction", "task").when(kind == "feedback", "feedback").when(text.rlike(COUNTER_HINT), "counterexample")
        .when(text.rlike(RECOVERY_HINT), "recovery").when(kind == "action", "action").otherwise("observation")
    )


def session_lines(text: Column) -> Column:
    """Labelled lines of a transcript, as (section, value)."""
    line = r"(?i)^(decisions?|todos?|task|evidence|source|open question|question|notes?)\s*:\s*(.+)$"
    section = F.create_map(*[F.lit(x) for pair in SESSION_LABELS.items() for x in pair])
    lines = F.transform(F.split(text, "\\r?\\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    found = F.filter(lines, lambda x: x.rlike(line))
    return F.transform(found, lambda x: F.struct(F.element_at(section, F.lower(F.regexp_extract(x, line, 1))).alias("section"), F.regexp_extract(x, line, 2).alias("value")))


def verification(kind: Column, n_evidence: Column) -> Column:
    """Sessions are rejected; personal items need two pieces of evidence, others one."""
    return F.when(kind == "session", "rejected").when((kind == "personal") & (n_evidence < 2), "needs_more_evidence").when(n_evidence > 0, "verified").otherwise("needs_more_evidence")


def promotion_refusal(kind: Column, scope: Column, status: Column, source_hash: Column) -> Column:
    """Why an item cannot become durable; null if it can."""
    return F.when(F.trim(scope) == "", "no scope").when(status != "verified", "not verified").when(kind == "session", "session").when((kind == "evidence") & source_hash.isNull(), "no source")


def execution_status(status: Column, has_artifact: Column, error: Column, policy: str) -> Column:
    """(execution_status, eligible): how an execution ended, and whether it may be evaluated."""
    given = F.coalesce(status, F.lit("completed"))
    failed = F.when(error.isin("cancelled", "timeout", "budget_exhausted"), error).otherwise("adapter_error")
    end = F.when(error.isNotNull(), failed).when(~given.isin(*TERMINAL_STATUSES), "adapter_error").when(~has_artifact & (given == "completed"), "adapter_error").otherwise(given)
    eligible = error.isNull() & has_artifact & (end != "adapter_error") & ((end == "completed") | F.lit(policy == "available_artifact"))
    return F.struct(end.alias("execution_status"), eligible.alias("eligible"))


def fact_score(kind: Column, is_global: Column, tasks: Column, words: Column, content_terms: Column, task: str, query: list[str]) -> Column:
    """(score, reason) of a fact for a task; a null score excludes it. Without declared tasks and words it is legacy."""
    asked = F.array(*map(F.lit, query)).cast("array<string>")
    overlap = F.size(F.array_intersect(content_terms, asked)).cast("double")
    result = lambda score, reason: F.struct(score.alias("score"), F.lit(reason).alias("reason"))
    out = F.lit(None).cast("double")
    declared = (F.size(tasks) > 0) | (F.size(words) > 0)
    missed = ((F.size(tasks) > 0) & ~F.array_contains(tasks, task)) | ((F.size(words) > 0) & ~F.arrays_overlap(words, asked))
    return (
        F.when(is_global, result(F.lit(1.0), "declared_global")).when(declared & missed, result(out, "task_relevance"))
        .when(declared, result(overlap + 1, "declared_applicability")).when(kind == "user", result(overlap + 1, "legacy_user_unspecified_applicability"))
        .when(overlap > 0, result(overlap, "lexical_task_overlap")).otherwise(result(out, "task_relevance"))
    )


def scope_phrases(text: Column, phrases: Column) -> Column:
    """The phrases that a text contains once white space and case are levelled, sorted."""
    level = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return F.array_sort(F.filter(phrases, lambda p: level(text).contains(level(p))))


def asset_decision(kind: Column, available: Column, compiled: Column, interrupted: Column, has_test: Column, returncode: Column, output_matches: Column) -> Column:
    return (
        F.when(~F.coalesce(available, F.lit(False)), "unknown").when(kind == "compile", F.when(compiled.isNull(), "unknown").when(compiled, "pass").otherwise("fail"))
        .when(F.coalesce(interrupted, F.lit(False)) | ~has_test | returncode.isNull(), "unknown").when((returncode == 0) & output_matches, "pass").otherwise("fail")
    )
