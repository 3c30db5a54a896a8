"""Command line: ``python -m quarry COMMAND ...``; results are JSON lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from quarry import tools
from quarry.sources import vault
from quarry.streaming.schedule import FORMATS, schedule


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("quarry", description="Queries over stored knowledge and logs")
    sub = top.add_subparsers(dest="command", required=True)

    def command(verb: str, /, *words: str, **options: str | None) -> None:
        c = sub.add_parser(verb)
        for w in words:
            c.add_argument(w)
        for o, default in options.items():
            c.add_argument(f"--{o.replace('_', '-')}", default=default)

    command("queries")
    command("run", "name", "folder")
    command("explain", "name", "folder")
    command("items", "vault")
    command("unreadable", "vault")
    command("search", "vault", "words", limit="5")
    command("read", "vault", "page")
    command("legacy", "vault", "project")
    command("context", "vault", "task", scope="")
    command("clean", "vault", "scope", "as_of")
    command("capture", "text", "source", "as_of", session="default", project="default")
    command("classify", "text")
    command("verify", "kind", "evidence")
    command("schedule", "job", name="quarry", time="09:00", format="cron")
    return top


def answer(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.command in ("run", "explain"):
        from quarry.plans.catalog import QUERIES
        return QUERIES[a.name](spark, a.folder)
    return {
        "items": lambda: vault.parse_items(vault.markdown_files(spark, a.vault)),
        "unreadable": lambda: vault.unreadable(vault.markdown_files(spark, a.vault)),
        "search": lambda: vault.search_files(vault.markdown_files(spark, a.vault), a.words, int(a.limit)),
        "read": lambda: vault.read_page(spark, a.vault, a.page),
        "legacy": lambda: vault.legacy_facts(vault.markdown_files(spark, a.vault), a.project)[0],
        "context": lambda: tools.build_context_pack(spark, a.vault, a.task, a.scope),
        "clean": lambda: tools.clean_memory(spark, a.vault, a.scope, a.as_of),
        "capture": lambda: tools.capture_candidate(spark, a.text, a.source, a.session, a.project, a.as_of),
        "classify": lambda: tools.classify_candidate(spark, a.text),
        "verify": lambda: tools.verify_candidate(spark, a.kind, [e for e in a.evidence.split(",") if e]),
    }[a.command]()


def main(arguments: list[str], spark: SparkSession | None = None) -> list[str]:
    """The lines that a command prints."""
    a = parser().parse_args(arguments)
    if a.command == "schedule":
        return [f"{k}: {v}" for k, v in schedule(a.job.split(), a.name, a.time, a.format if a.format in FORMATS else "cron").items()]
    if a.command == "queries":
        from quarry.plans.catalog import QUERIES
        return sorted(QUERIES)
    spark = spark or SparkSession.builder.getOrCreate()
    rows = answer(spark, a)
    if a.command == "explain":
        return rows._jdf.queryExecution().toString().splitlines()
    return [r[0] for r in rows.selectExpr("to_json(struct(*)) AS line").toLocalIterator()]


if __name__ == "__main__":
    print("\n".join(main(sys.argv[1:])))
