"""Item files, the log that writers share, and search over HTTP."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quarry.operators import callbacks
from quarry.plans import commits as plans
from quarry.sources import commits, items, knowledge, vault


def files_below(root):
    return {str(p.relative_to(root)): p.read_text("utf-8") for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_items_are_read_by_tasks(spark, tmp_path):
    """Folders are listed by tasks, so the plan that the driver holds names no file; hidden names are left out."""
    want = {f"n{i % 3}/d/{i}.md": f"text {i} é" * (i + 1) for i in range(40)} | {"top.md": "", "n0/note.txt": "other"}
    for path, text in (want | {"_hid/a.md": "no", ".x.md": "no", "n1/_b.md": "no"}).items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text, "utf-8")
    rows = items.read_items(spark, str(tmp_path)).collect()
    assert len(rows) == len(want) and {r.path: r.content.decode() for r in rows} == want and all(r.bytes == len(r.content) for r in rows)
    assert items.read_items(spark, str(tmp_path / "_hid")).count() == 1
    (tmp_path / "none").mkdir()
    assert items.read_items(spark, str(tmp_path / "none")).count() == 0
    out = plans.written_items(spark, "/root/testdata/sf0.001")
    assert not [f for f in out.inputFiles() if f.endswith(".md")] and out.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_items_are_written_as_files(spark, tmp_path):
    root = tmp_path / "vault"
    df = spark.createDataFrame([(f"notes/{i}.md", f"text {i} é") for i in range(50)] + [("deep/er/x.md", None)], "path string, content string").repartition(4)
    items.write_items(df, str(root))
    assert files_below(root) == {f"notes/{i}.md": f"text {i} é" for i in range(50)} | {"deep/er/x.md": ""}
    with pytest.raises(Exception, match="x.md"):
        items.write_items(spark.createDataFrame([("deep/er/x.md", "new"), ("notes/new.md", "n")], df.schema), str(root))
    assert files_below(root)["deep/er/x.md"] == "" and not (root / "notes" / "new.md").exists()
    items.write_items(spark.createDataFrame([("deep/er/x.md", "new")], df.schema), str(root), replace=True)
    assert files_below(root)["deep/er/x.md"] == "new"


@pytest.mark.parametrize("rows", [[("a.md", "1"), ("a.md", "2")], [("a.md", "1"), ("../b.md", "2")], [("a.md", "1"), ("/b.md", "2")], [("a.md", "1"), ("", "2")]])
def test_a_failed_write_leaves_nothing(spark, tmp_path, rows):
    root = tmp_path / "vault"
    with pytest.raises(Exception):
        items.write_items(spark.createDataFrame(rows, "path string, content string").repartition(2), str(root))
    assert not root.exists() or files_below(root) == {}


def test_many_small_files_are_few_tasks(spark, tmp_path):
    root = tmp_path / "vault"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        items.write_items(spark.range(200).selectExpr("concat('n/', id, '.md') AS path", "concat('é', id) AS content"), str(root))
        read = vault.markdown_files(spark, str(root))
        assert read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert {(r.path, r.content, r.bytes) for r in read.collect()} == {(f"n/{i}.md", f"é{i}", 2 + len(str(i))) for i in range(200)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [p.name for p in root.iterdir()] == ["n"]  # nothing staged is left


def test_one_of_two_writers_wins(spark, tmp_path):
    folder = str(tmp_path / "log")
    for generation in range(3):
        won, lost = [], []
        held = commits.read_entry(spark, folder, generation) if generation else {"digest": None}

        def write(name, at=generation, digest=held["digest"]):
            try:
                won.append((name, commits.swap(spark, folder, at, digest, f"d{at}-{name}", {"release": name}, name)))
            except commits.Conflict:
                lost.append(name)

        threads = [threading.Thread(target=write, args=(f"w{i}",)) for i in range(6)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(won) == 1 and len(lost) == 5 and won[0][1] == generation + 1
        assert commits.read_entry(spark, folder, generation + 1)["writer"] == won[0][0]
    assert commits.newest(spark, folder) == 3
    assert [p.name for p in (tmp_path / "log").iterdir() if "tmp" in p.name] == []
    with pytest.raises(commits.Conflict):
        commits.swap(spark, folder, 3, "another digest", "d", {"release": "x"}, "x")
    with pytest.raises(commits.Conflict):
        commits.swap(spark, folder, 9, None, "d", {"release": "x"}, "x")


def test_commits_of_other_keys_go_in_behind(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert commits.newest(spark, folder) == 0
    assert commits.commit(spark, folder, 0, "1", {"a": "1"}, "x") == 1
    assert commits.commit(spark, folder, 0, "2", {"b": "2"}, "y") == 2
    assert commits.commit(spark, folder, 0, "3", {"c": "3"}, "z") == 3
    with pytest.raises(commits.Conflict):
        commits.commit(spark, folder, 1, "4", {"b": "4", "d": "4"}, "x")
    assert commits.commit(spark, folder, 3, "4", {"b": "4"}, "x") == 4
    assert {r.key: (r.value, r.generation) for r in commits.state(spark, folder).collect()} == {"a": ("1", 1), "b": ("4", 4), "c": ("3", 3)}
    assert [r.writer for r in commits.entries(spark, folder).orderBy("generation").collect()] == ["x", "y", "z", "x"]


class Service(BaseHTTPRequestHandler):
    """Answers by the kind of service that its port stands for."""

    def reply(self, status, body):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body if isinstance(body, bytes) else json.dumps(body).encode())

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        kind = self.server.kind
        if kind == "project" and asked["query"] != "nothing":
            return self.reply(200, {"tokenHits": [{"path": "a/one.md", "title": "One", "snippet": "s1"}], "vectorHits": [{"file": "two.md", "content": "s2"}, {"title": "no path"}], "results": [{"path": "three.md", "excerpt": "s3"}]})
        return self.reply(200, {"tokenHits": []}) if kind == "project" else self.reply(404, {})

    def do_GET(self):
        kind = self.server.kind
        if kind == "plain" or kind == "project":
            return self.reply(200, [{"path": f"p{i}.md", "excerpt": self.path} for i in range(9)] if "many" in self.path else {"results": []})
        return self.reply(500, {}) if kind == "broken" else self.reply(200, b"not json")

    def log_message(self, *_):
        pass


@pytest.fixture
def services():
    made = {}
    for kind in ("project", "plain", "broken", "text"):
        made[kind] = HTTPServer(("127.0.0.1", 0), Service)
        made[kind].kind = kind
        threading.Thread(target=made[kind].serve_forever, daemon=True).start()
    yield {k: f"http://127.0.0.1:{s.server_port}" for k, s in made.items()}
    for s in made.values():
        s.shutdown()


def test_search_falls_back_from_service_to_files(spark, services, tmp_path):
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "x.md").write_text("# Title x\n\nwith MANY words")
    (tmp_path / "kb" / "y.md").write_text("many more")
    root = str(tmp_path / "kb")
    bases = [{"name": k, "api": a, "root": root} for k, a in services.items()] + [{"name": "files", "root": root}, {"name": "gone", "api": "http://127.0.0.1:9"}]
    rows = knowledge.search(spark, bases, ["many words", "nothing"], 2, timeout=5).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault((r.base, r["query"]), []).append((r["rank"], r.path, r.title, r.excerpt, r.source))
    assert got.pop(("project", "many words")) == [(1, "a/one.md", "One", "s1", "project"), (2, "two.md", "two.md", "s2", "project")]
    assert [x[:2] for x in got.pop(("plain", "many words"))] == [(1, "p0.md"), (2, "p1.md")]
    for base in ("broken", "text", "files"):
        assert [(x[1], x[2], x[4]) for x in got.pop((base, "many words"))] == [("x.md", "Title x", "files")]
    assert got == {}  # an empty answer of a service is an answer, and no file holds the other word


def test_lines_go_to_their_files_in_order(spark, tmp_path):
    rows = spark.range(400).selectExpr("concat('d', id % 3, '/t', id % 20) AS path", "-id AS place", "CASE WHEN id > 20 THEN concat('zeile ä', id) END AS line").repartition(7)
    items.write_lines(rows, str(tmp_path / "traces"), "place")
    found = {str(p.relative_to(tmp_path / "traces")): p.read_text() for p in (tmp_path / "traces").rglob("t*")}
    assert found == {f"d{i % 3}/t{i % 20}": "".join(f"zeile ä{j}\n" if j > 20 else "\n" for j in range(399, -1, -1) if j % 60 == i) for i in range(60)}
    with pytest.raises(FileExistsError):
        items.write_lines(rows, str(tmp_path / "traces"), "place")
    assert not list((tmp_path / "traces").glob("_staging*"))
    items.write_lines(rows.limit(0), str(tmp_path / "none"), "place")


def test_legacy_files_are_told_in_one_pass(spark):
    head = json.dumps({"id": "a", "kind": "personal", "scope": "x", "status": "verified", "content": "c"})
    texts = {
        "plain": f"---\n{head}\n---\n\nbody", "claim": f"---\n{head}\n---\n\n## Claim\n\n ä 1 \n## Metadata\nrest", "empty claim": f"---\n{head}\n---\n\n## Claim\n\n \n",
        "no front": "---\n\n---\n\nbody", "open": f"---\n{head}\n---\nbody", "late": f" ---\n{head}\n---\n\nbody", "other": f"---\n{head.replace('personal', 'session')}\n---\n\nbody", "null": None, "not json": "---\nx\n---\n\ny",
    }
    told = vault.legacy_files(spark.createDataFrame(list(texts.items()), "path string, content string").coalesce(1), "x")
    assert told._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert {r.legacy_path: r.content for r in told.collect() if r.state == "fact"} == {"plain": "c", "claim": "ä 1"}
    assert {r.legacy_path for r in told.collect() if r.state != "fact"} == {"empty claim", "no front", "open", "late", "null", "not json"}


def test_a_callers_counter_gets_texts_one_by_one(spark):
    def made_by_pandas(text: str) -> int:
        import traceback

        return sum("/pandas/core/" in f.filename for f in traceback.extract_stack())

    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "ä😀")], "id long, text string")
    assert [r.tokens for r in callbacks.counted(rows, "text", made_by_pandas).orderBy("id").collect()] == [0, 0, 0]
    assert [r.tokens for r in callbacks.counted(rows, "text", len).orderBy("id").collect()] == [3, 0, 2]
