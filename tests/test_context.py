"""Operators without a query of their own, and cases that the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from quarry import tools
from quarry.__main__ import main
from quarry.operators import callbacks, context, measures, packets
from quarry.sources import vault
from quarry.streaming.schedule import schedule


def test_fitting_takes_later_smaller_rows(spark):
    rows = spark.createDataFrame([(1, 5, 1), (2, 6, 1), (3, 4, 1), (4, 1, 1), (5, 99, 1)], "k long, size long, n long")
    got = packets.fitting(rows, "k", [F.col("k")], {"size": 10, "n": 9})
    assert [r.k for r in got.orderBy("k").collect()] == [1, 3, 4]
    assert packets.fitting(rows.limit(0), "k", [F.col("k")], {"size": 10}).count() == 0


def test_fitting_against_a_plain_loop(spark):
    sizes = [(i, i * 7919 % 97 + 1) for i in range(3000)]
    left, expected = 2500, []
    for i, s in sizes:
        if s <= left:
            left -= s
            expected.append(i)
    got = packets.fitting(spark.createDataFrame(sizes, "k long, size long").repartition(7), "k", [F.col("k")], {"size": 2500})
    assert sorted(r.k for r in got.collect()) == expected


def test_dependency_levels(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("a", "gone")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcxyzl"], "node string")
    got = {r.node: (r.level, r.stored) for r in context.dependency_levels(edges, nodes).collect()}
    assert got == {"c": (0, True), "gone": (0, False), "l": (0, True), "b": (1, True), "a": (2, True), "x": (None, True), "y": (None, True), "z": (None, True)}


def test_pieces_are_cut_at_characters(spark):
    rows = spark.createDataFrame([(1, "äöü" * 10, 20), (2, "", None), (3, None, None), (4, "ab", None)], "id long, t string, at int")
    got = [tuple(r) for r in packets.pieces(rows, "t", F.col("at"), 8, 1).select("id", "place", "start_byte", "end_byte", "piece").orderBy("id", "place").collect()]
    text = "äöü" * 10
    assert got == [(1, i, 2 * s, 2 * s + 16, text[s:s + 8]) for i, s in enumerate((18, 0, 22, 8))] + [(2, 0, 0, 0, ""), (4, 0, 0, 2, "ab")]


def test_update_batches_refuse_what_cannot_be(spark):
    t = spark.createDataFrame([("p", 1)], "p string, t long")
    for mode, purpose, width in (("odd", "learning", 1), ("task_barrier", "final", 1), ("frozen_microbatch", "learning", 0)):
        with pytest.raises(ValueError):
            measures.update_batches(t, "p", "t", mode, width, purpose)


def test_read_ranges_across_chunks(spark):
    body = "".join(chr(97 + i % 26) for i in range(3000)) + "é"
    rows = spark.createDataFrame([(1, body), (2, "")], "id long, t string")
    chunks = vault.chunked(rows, "id", "t")
    assert [(r.id, r.n) for r in chunks.groupBy("id").agg(F.count("*").alias("n")).orderBy("id").collect()] == [(1, 3), (2, 1)]
    reads = spark.createDataFrame([(1, 1, 1000, 2100), (2, 1, 2990, 3002), (3, 1, 3500, 3600), (4, 9, 0, 5)], "read_id long, id long, start long, stop long")
    got = {r.read_id: (bytes(r.body), r.intact) for r in vault.read_ranges(chunks, reads, "id").collect()}
    raw = body.encode()
    assert got == {1: (raw[1000:2100], True), 2: (raw[2990:3002], True), 3: (b"", False), 4: (b"", False)}


def test_replaced_text_and_pages(spark, tmp_path):
    path = str(tmp_path / "wiki" / "a.md")
    vault.replace_text(spark, path, "one")
    vault.replace_text(spark, path, "twö")
    assert (tmp_path / "wiki" / "a.md").read_text("utf-8") == "twö"
    assert [p.name for p in (tmp_path / "wiki").iterdir() if not p.name.startswith(".")] == ["a.md"]
    root = str(tmp_path / "wiki")
    assert [tuple(r) for r in vault.read_page(spark, root, "x/../a.md").collect()] == [("a.md", "twö")]
    for page in ("../a.md", "x/../../a.md", "/a.md", ""):
        with pytest.raises(ValueError):
            vault.read_page(spark, root, page)


def test_configuration(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "c.json").write_text('{"vaultRoot": "v", "knowledgeBases": [{"name": "p"}]}')
    near = vault.nearest_config(str(tmp_path / "a" / "b"), "c.json")
    assert near["projectConfigPath"] == str((tmp_path / "c.json").resolve())
    both = vault.resolved_config({"vaultRoot": "g", "defaultProject": "d", "knowledgeBases": [{"name": "g"}]}, near)
    assert (both["vaultRoot"], both["defaultProject"], [k["name"] for k in both["knowledgeBases"]]) == ("v", "d", ["g", "p"])
    assert vault.nearest_config(str(tmp_path), "none-of-this-name.json") == {}


def test_callbacks_and_counters(spark):
    def work(row):
        if row["id"] == 2:
            raise KeyError("x")
        return row["t"].upper()

    rows = spark.createDataFrame([(1, "ab c"), (2, "d"), (3, "é")], "id long, t string")
    got = {r.call_ref: (r.status, r.output, r.error) for r in callbacks.run_callback(rows, "id", work).collect()}
    assert got == {"1": ("returned", "AB C", None), "2": ("error", None, "KeyError: 'x'"), "3": ("returned", "É", None)}
    more = rows.union(spark.createDataFrame([(4, None)], "id long, t string"))
    counts = lambda c: [r.tokens for r in callbacks.counted(more, "t", c).orderBy("id").collect()]
    assert counts(None) == [2, 1, 1, 0]
    assert counts(lambda t: len(t.split())) == [2, 1, 1, 0]
    assert counts(F.length("t")) == [4, 1, 1, 0]


def test_schedules():
    job = ["python", "-m", "quarry", "run", "it's"]
    assert schedule(job, "s", "07:05")["cron"] == "5 7 * * * python -m quarry run 'it'\"'\"'s' # s"
    assert "OnCalendar=*-*-* 07:05:00" in schedule(job, "s", "7:05", "systemd")["timer"]
    assert "Type=oneshot\nExecStart=python -m quarry" in schedule(job, "s", "7:05", "systemd")["service"]
    for name, time in (("a b", "07:05"), ("s", "24:00"), ("s", "x")):
        with pytest.raises(ValueError):
            schedule(job, name, time)


def test_tools_and_command_line(spark, tmp_path):
    folder = tmp_path / "v" / "projects"
    folder.mkdir(parents=True)
    (folder / "a.md").write_text('---\n{"id":"a","kind":"project","scope":"shop","status":"verified","content":"c","confidence":0.9,"created_at":"2024-01-01T00:00:00Z","updated_at":"2024-01-01T00:00:00Z","retrieval_count":0,"references":[]}\n---\n\n# a\n\n## Claim\n\nfix the import\n')
    (folder / "b.md").write_text("no front matter")
    root = str(tmp_path / "v")
    assert [r.path for r in vault.unreadable(vault.markdown_files(spark, root)).collect()] == ["projects/b.md"]
    assert '"content":"fix the import"' in main(["items", root], spark)[0]
    assert len(main(["search", root, "IMPORT"], spark)) == 1
    assert '"memory_id":"a"' in main(["legacy", root, "shop"], spark)[0]
    assert "call_states" in main(["queries"], spark)
    assert main(["verify", "personal", "one,two"], spark) == ['{"decision":"verified"}']
    assert main(["schedule", "job x", "--time", "01:02"], spark)[1].startswith("cron: 2 1 * * * job x")
    assert tools.build_context_pack(spark, root, "fix the import", "shop").count() > 0
    assert tools.clean_memory(spark, root, "shop", "2024-02-01").count() == 1
    assert tools.capture_candidate(spark, "user likes tea", "cli", "s", "p", "2024-02-01").first().kind == "personal"
    assert tools.promote_item(spark, "session", "s", "verified", None).first().refusal == "session"
    assert tools.evaluate_rubric(spark, [("c", 5.0, 1)]).first().recommendation == "accept"
