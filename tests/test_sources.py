"""Sources, sinks, streaming and sequential selections on small files."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import folding, latest, selection
from quarry.schemas import CONTROLLER_FEEDBACK
from quarry.sources import vault
from quarry.streaming import trace_index


@pytest.fixture
def root(tmp_path):
    d = tmp_path / "vault"
    for name, text in {
        "projects/a.md": '---\n{"id":"a","kind":"project","scope":"x/y","content":"old","confidence":0.5}\n---\n# A\n\n## Claim\n\nnew claim\n\n## Other\nz\n',
        "notes/b.md": '---\n{"id":"b","kind":"evidence","scope":"z","content":"kept"}\n---\n',
        "notes/bad.md": "no front matter",
        "agent/c.md": '---\n{"id":"c","kind":"evidence"}\n---\n',
    }.items():
        (d / name).parent.mkdir(parents=True, exist_ok=True)
        (d / name).write_text(text)
    return str(d)


def test_vault(spark, root):
    files = vault.markdown_files(spark, root)
    assert {r.path for r in files.collect()} == {"projects/a.md", "notes/b.md", "notes/bad.md"}
    items = vault.parse_items(files)
    assert {(r.id, r.content) for r in items.collect()} == {("a", "new claim"), ("b", "kept")}
    assert [r.path for r in vault.unreadable(files).collect()] == ["notes/bad.md"]
    assert [r.id for r in vault.scope_files(items, "x").collect()] == ["a"]
    assert [r.path for r in vault.search_files(files, "NEW Claim", 5).collect()] == ["projects/a.md"]
    assert vault.content_hashes(spark, root).count() == 4
    again = vault.parse_items(vault.serialized(items))
    assert {(r.id, r.content, r.confidence) for r in again.collect()} == {("a", "new claim", 0.5), ("b", "kept", None)}


def test_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    assert vault.json_lines(spark, path, CONTROLLER_FEEDBACK).count() == 0
    row = spark.createDataFrame([(None, "manual", "dry", 0.5, 5.0, 3, None)], CONTROLLER_FEEDBACK)
    vault.append_json(row, path)
    vault.append_json(row, path)
    assert vault.json_lines(spark, path, CONTROLLER_FEEDBACK).count() == 2
    (tmp_path / "log" / "part-bad.json").write_text("{not json\n")
    with pytest.raises(Exception):
        vault.json_lines(spark, path, CONTROLLER_FEEDBACK).collect()


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,x,2.5\n,,\n")
    got = vault.typed_csv(spark, str(tmp_path / "t.csv"), {"a": "long", "b": "string", "c": "double"}).collect()
    assert [tuple(r) for r in got] == [(1, "x", 2.5), (None, "", None)]


def test_touching_adds_events(spark):
    items = spark.createDataFrame([("a", 1, None, None), ("b", None, None, None)], "id string, retrieval_count int, last_retrieved_at timestamp, updated_at timestamp")
    events = spark.sql("select 'a' as id, timestamp'2024-01-02' as at union all select 'a', timestamp'2024-01-02' union all select 'a', timestamp'2024-01-03'")
    got = {r.id: (r.retrieval_count, str(r.last_retrieved_at)) for r in vault.touched(events, items).collect()}
    assert got == {"a": (3, "2024-01-03 00:00:00"), "b": (0, "None")}


def test_incremental_index_equals_batch(spark, tmp_path):
    src, out, ck = tmp_path / "traces", str(tmp_path / "index"), str(tmp_path / "ck")
    src.mkdir()
    for i in range(3):
        (src / f"t{i}.jsonl").write_text("".join(json.dumps({"event_id": f"{i}-{j}", "episode_id": str(i), "kind": "é"}, ensure_ascii=False) + "\n" for j in range(4)) + "broken\n")
    assert trace_index.index_step(spark, str(src), out, ck) == 3
    (src / "t9.jsonl").write_text('{"event_id":"9"}\n')
    assert trace_index.index_step(spark, str(src), out, ck) == 1
    batch = trace_index.index_rows(trace_index.read_lines(spark, str(src)))
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)
    assert batch.filter("not readable").count() == 3


def test_byte_steps(spark):
    sizes = spark.createDataFrame([("t", i, b) for i, b in enumerate([5, 5, 50, 5])], "trace string, position int, bytes int")
    take = lambda start, n, b: [r.position for r in trace_index.byte_step(sizes, start, n, b).orderBy("position").collect()]
    assert take(0, 10, 20) == [0, 1] and take(0, 1, 20) == [0] and take(2, 10, 20) == [] and take(2, 10, 60) == [2, 3]


def test_roots_follow_relations(spark):
    need = lambda **chars: [(k, v, ["a"] if k == "b" else []) for k, v in chars.items()]
    rows = [
        ("t", "a", 3.0, need(a=4, d=2)), ("t", "b", 2.0, need(b=3)), ("t", "c", 1.0, need(c=3, d=2)), ("t", "e", 1.5, need(e=1)), ("t", "d", 0.5, need(d=2)), ("t", "f", 0.1, need(f=90)), ("t", "g", -1.0, need(g=1)),
        ("u", "a", 0.0, need(a=1)), ("u", "h", 0.0, need(h=1)),
    ]
    relations = [
        ("t", "c", "a", "measured_effect", 4.0, [], True),  # speaks for c once a is held
        ("t", "a", "e", "measured_effect", 9.0, [], True),  # not for e: it goes from a
        ("t", "a", "g", "co_used", 8.0, ["e"], True),  # either way, but only with e there
        ("t", "f", "a", "observed", 50.0, [], True), ("t", "e", "c", "co_used", -1.0, [], True), ("t", "b", "c", "co_used", 7.0, [], False), ("t", "e", "a", "co_used", float("nan"), [], True),
    ]
    df = spark.createDataFrame(rows, "task_id string, skill_id string, base double, closure array<struct<skill_id:string,chars:long,conflicts:array<string>>>")
    rel = spark.createDataFrame(relations, "task_id string, `from` string, `to` string, kind string, value double, background array<string>, supported boolean")
    got = lambda n, b: [tuple(r)[2:] for r in selection.select_roots(df, rel, 0.5, n, b).filter("task_id = 't'").orderBy("place").collect()]
    # Texts a, d and c with separators take 11 characters, e two more.
    assert got(9, 40) == [("a", 3.0, "root"), ("c", 3.0, "root"), ("b", 2.0, "declared_conflict"), ("e", 1.0, "root"), ("g", 3.0, "root"), ("f", 0.1, "budget")]
    assert got(9, 11) == [("a", 3.0, "root"), ("c", 3.0, "root"), ("b", 2.0, "declared_conflict"), ("e", 1.0, "budget"), ("f", 0.1, "budget"), ("g", -1.0, "budget")]
    assert got(1, 40) == [("a", 3.0, "root"), ("b", 2.0, "root_limit"), ("c", 3.0, "root_limit"), ("e", 1.5, "root_limit"), ("f", 0.1, "root_limit"), ("g", -1.0, "root_limit")]
    assert [tuple(r) for r in selection.select_roots(df, rel, 0.5, 1, 40).filter("task_id = 'u' and verdict = 'root'").collect()] == [("u", 1, "a", 0.0, "root")]


def test_folding_respects_conflicts(spark):
    link, mark = "LINK_DUPLICATE", "MARK_CONFLICT"
    rows = [("o", 1, mark, "a", "c", None), ("o", 2, link, "a", "b", "b"), ("o", 3, link, "b", "c", "b"), ("o", 4, link, "c", "d", "d"), ("o", 5, link, "e", "f", "e"), ("p", 1, link, "x", "y", "y"), ("p", 2, link, "y", "z", "x")]
    df = spark.createDataFrame(rows, "owner string, position int, kind string, a string, b string, preferred string")
    got = {(r.owner, r.member): (r["head"], r.conflict) for r in folding.fold_groups(df).collect()}
    both = "b,d"  # what a and c are folded into
    assert got == {
        ("o", "a"): ("b", both), ("o", "b"): ("b", both), ("o", "c"): ("d", both), ("o", "d"): ("d", both), ("o", "e"): ("e", None), ("o", "f"): ("e", None),
        ("p", "x"): ("y", None), ("p", "y"): ("y", None), ("p", "z"): ("y", None),
    }


def test_ledger_and_swap(spark):
    starts = spark.createDataFrame([(1,), (2,), (3,)], "request_id int")
    returns = spark.createDataFrame([(1,), (3,), (3,)], "request_id int")
    assert {r.request_id: r.state for r in selection.call_ledger(starts, returns).collect()} == {1: "returned", 2: "open", 3: "conflict"}
    log = spark.createDataFrame([(1, "x"), (2, "y")], "generation int, digest string")
    assert latest.compare_and_swap(log, "y", 2) and not latest.compare_and_swap(log, "x", 1)
    reviews = spark.createDataFrame([("r1", 1, "a", "LINK"), ("r1", 2, "b", "REVOKE"), ("r2", 1, "c", "LINK")], "relation string, at int, review_id string, op string")
    assert [r.relation for r in latest.active_relations(reviews).collect()] == ["r2"]
    records = spark.createDataFrame([("p",), ("q",)], "payload string").withColumn("digest", F.when(F.col("payload") == "p", F.sha2("payload", 256)).otherwise("no"))
    assert {r.payload: r.intact for r in vault.verified_records(records).collect()} == {"p": True, "q": False}


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_settings_of_folders_sort_no_texts(spark):
    """The nearest config counts, also a broken one; folders that come twice stay; the texts of a folder's configs are not sorted by folder."""
    folders = spark.createDataFrame([("w/1/2",), ("w/1/2",), ("w/3/4",), ("w/5",), ("v/1",)], "folder string")
    configs = spark.createDataFrame([("w", '{"p":"root"}'), ("w/1", '{"p":"one","knowledgeBases":["b"]}'), ("w/1/2/3", '{"p":"below"}'), ("w/3/4", "{broken")], "folder string, text string")
    found = vault.resolved_settings(folders, configs, {"p": "general"}, ["g"])
    rows = sorted((r.folder, r.config_folder or "", r.settings["p"], tuple(r.bases)) for r in found.collect())
    assert rows == [("v/1", "", "general", ("g",)), ("w/1/2", "w/1", "one", ("g", "b")), ("w/1/2", "w/1", "one", ("g", "b")), ("w/3/4", "w/3/4", "general", ("g",)), ("w/5", "w", "root", ("g",))]
    assert "max_by" not in found._jdf.queryExecution().executedPlan().toString()
