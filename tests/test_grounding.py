"""Folding, cycles, admission, citations and metadata against plain computations."""

import hashlib
import random

from pyspark.sql import functions as F

from quarry.operators import admission, citations, events, folding, governance, graph, lineage


def plain_fold(rows):
    """One relation after the other over sets of records."""
    head = {x: x for r in rows for x in (r[3], r[4])}
    for _, _, kind, a, b, preferred in sorted(rows, key=lambda r: (r[1], r[3], r[4], r[5] or 0)):
        if kind == "LINK_DUPLICATE":
            both = {head[a], head[b]}
            if not any(k == "MARK_CONFLICT" and {head[x], head[y]} <= both for _, _, k, x, y, _ in rows):
                to = head[preferred]
                head = {x: to if h in both else h for x, h in head.items()}
    groups = {h: {h} for h in head.values()}
    for _, _, kind, a, b, _ in rows:
        if kind == "MARK_CONFLICT":
            whole = groups[head[a]] | groups[head[b]]
            for h in whole:
                groups[h] = whole
    return {x: (h, ",".join(map(str, sorted(groups[h]))) if len(groups[h]) > 1 else None) for x, h in head.items()}


def test_folding_as_one_after_the_other(spark):
    random.seed(11)
    rows = []
    for owner in ("o", "p", "q"):
        for position in range(30):
            a, b = random.sample(range(18), 2)
            kind = random.choice(["LINK_DUPLICATE"] * 3 + ["MARK_CONFLICT"])
            rows.append((owner, position, kind, a, b, random.choice([a, b]) if kind == "LINK_DUPLICATE" else None))
    got = {}
    for r in folding.fold_groups(spark.createDataFrame(rows, "owner string, position int, kind string, a long, b long, preferred long")).collect():
        got.setdefault(r.owner, {})[r.member] = (r["head"], r.conflict)
    assert got == {o: plain_fold([r for r in rows if r[0] == o]) for o in ("o", "p", "q")}


def plain_ways(edges, items):
    refs = {}
    for s, place, d in sorted(edges, key=lambda e: e[:2]):
        refs.setdefault(s, []).append(d)
    out = {}
    for start in items:
        stack = []

        def visit(x):
            if x in stack:
                out[start] = [*stack, x]
                return True
            if x not in items:
                return False
            stack.append(x)
            if any(visit(d) for d in refs.get(x, [])):
                return True
            stack.pop()
            return False

        visit(start)
    return out


def test_ways_into_cycles(spark):
    random.seed(12)
    for n, m in ((12, 16), (30, 36), (8, 8)):
        edges = [(s, place, random.randrange(n + 2)) for place, s in enumerate(random.choices(range(n), k=m))]
        items = set(range(n)) - {3}
        got = graph.cycle_paths(spark.createDataFrame(edges, "src long, place int, dst long"), spark.createDataFrame([(i,) for i in items], "node long"))
        assert {r.node: r.path for r in got.collect()} == plain_ways(edges, items)


def test_strong_components_and_labels(spark):
    random.seed(13)
    edges = [(random.randrange(40), random.randrange(40)) for _ in range(55)] + [(1, 1)]
    df = spark.createDataFrame(edges, "src long, dst long")
    reach = {i: {i} for i in range(40)}
    for _ in range(40):
        for s, d in edges:
            reach[s] |= reach[d]
    same = {i: {j for j in reach[i] if i in reach[j]} for i in reach}
    assert {r.node: r.component for r in graph.strong_components(df).collect()} == {i: min(s) for i, s in same.items() if len(s) > 1}
    assert graph.strong_components(df.limit(0)).count() == 0
    seeds = spark.createDataFrame([(2,), (7,)], "node long")
    assert {r.node for r in graph.reached_nodes(df, seeds).collect()} == reach[2] | reach[7]
    labels = spark.createDataFrame([(5, 3), (9, 1), (9, 2), (50, 7)], "node long, label int")
    expected = {i: min(x for n, x in ((5, 3), (9, 1)) if n in reach[i]) for i in range(40) if {5, 9} & reach[i]} | {50: 7}
    assert {r.node: r.label for r in graph.first_labels(df, labels).collect()} == expected


def test_reasons_are_handed_on(spark):
    reasons = spark.createDataFrame([("a", "group_not_closed"), ("a", "no_group_plan"), ("b", "not_authorized"), ("z", "batch_unknown")], "episode_id string, reason string")
    parents = spark.createDataFrame([("c", "a"), ("d", "c"), ("a", "d"), ("d", "b"), ("e", "gone"), ("f", "f")], "episode_id string, parent_id string")
    got = {r.episode_id: (r.reason, r.inherited) for r in admission.rejections(reasons, parents).collect()}
    assert got == {x: ("not_authorized", True) for x in "acd"} | {"b": ("not_authorized", False), "z": ("batch_unknown", False)}


def test_citations(spark):
    drafts = [
        (1, '{"evidence_refs":["a","b",3,null],"x":[{"boundary_refs":["c"]},[{"supporting_refs":[]},{"counterevidence_refs":"b"}]],"read_requests":[{"ref_id":"r"},{"ref_id":"q"},{},"odd"]}'),
        (2, '{"evidence_refs":{"evidence_refs":["z"]},"read_requests":{"read_requests":[{"ref_id":"r"}]}}'),
        (3, '{"evidence_refs":[{"evidence_refs":["nested"]}]}'), (4, "[[{\"evidence_refs\":[\"a\"]}]]"), (5, "{"), (6, None), (7, '"text"'), (8, "{}"),
    ]
    provided = spark.createDataFrame([(1, "a"), (1, "q"), (1, "a")], "draft_id long, ref_id string")
    readable = spark.createDataFrame([(1, "q"), (1, "r"), (2, "s")], "draft_id long, ref_id string")
    got = {(r.draft_id, r.path, r.ref_id) for r in citations.citation_errors(spark.createDataFrame(drafts, "draft_id long, draft string"), provided, readable).collect()}
    assert got == {
        (1, "$.evidence_refs[1]", "b"), (1, "$.evidence_refs[2]", "3"), (1, "$.evidence_refs[3]", None), (1, "$.x[0].boundary_refs[0]", "c"),
        (1, "$.read_requests[1]", "q"), (1, "$.read_requests[2]", None), (1, "$.read_requests[3]", None),
        (2, "$.evidence_refs.evidence_refs[0]", "z"), (2, "$.read_requests.read_requests[0]", "r"), (3, "$.evidence_refs[0]", '{"evidence_refs":["nested"]}'),
        (4, "$[0][0].evidence_refs[0]", "a"), (5, "$", None),
    }


def test_choice_of_metadata_stays_within_its_limit(spark):
    rows = [("t", f"e{i}", i, f"c{i // 3}" if i % 4 else None, i in (5, 17)) for i in range(20)] + [("one", "x0", 0, None, False)]
    df = spark.createDataFrame(rows, "trace string, event_id string, position int, call_id string, marked boolean")
    focus = spark.createDataFrame([("e9",), ("e2",), ("none",)], "event_id string")

    def chosen(limit):
        got = events.select_metadata(df, focus, limit).orderBy("trace", "place").collect()
        return [r.event_id for r in got if r.trace == "t"], [r.event_id for r in got if r.trace == "one"]

    # Ends and middles: 0, 19, 9, 4, ...; e5 and its call (e3 to e5), then what stands there.
    assert chosen(1) == (["e2"], ["x0"])
    assert chosen(3) == (["e2", "e9", "e5"], ["x0"])
    assert chosen(7) == (["e2", "e9", "e5", "e3", "e0", "e19", "e18"], ["x0"])
    assert all(len(chosen(n)[0]) == n for n in (2, 5, 12))
    assert df.filter(F.lit(False)).transform(lambda x: events.select_metadata(x, focus, 3)).count() == 0


def test_near_copies_travel_once(spark):
    """Near copies of 300 long words: all pairs are there, and token sets do not travel once for each pair."""
    words = [hashlib.sha256(b"%d" % i).hexdigest()[:24] for i in range(300)]
    whole, r = " ".join(words), random.Random(1)
    rows = [(i, "x", " ".join([w for w in words if r.random() > 0.06] + [f"own{i:05d}"])) for i in range(240)] + [(1000, "x", "alone here"), (1001, "y", whole), (1002, "y", whole), (1003, None, whole), (1004, "x", None)]
    docs = spark.createDataFrame(rows, "id long, b string, content string").repartition(4)

    def written() -> int:
        held = spark._jsc.sc().statusStore().executorList(False)
        return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))

    before, limit = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        found = {(r.a_id, r.b_id): r.similarity for r in governance.near_duplicates(docs, "b", 0.72).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    sets = {i: (b, set(t.split())) for i, b, t in rows if b and t}
    alike = {(i, j): round(len(x & y) / len(x | y), 3) for i, (b, x) in sets.items() for j, (c, y) in sets.items() if i < j and b == c and len(x & y) / len(x | y) >= 0.72}
    assert found == alike and len(alike) > 28_000
    assert written() - before < 20_000_000


def test_near_copies_meet_once_and_in_cells(spark, monkeypatch):
    """Candidates are one row where they first meet, and the sets of a group travel a few times; parts and cells of few sets change nothing."""
    words, r = [hashlib.sha256(b"%d" % i).hexdigest()[:24] for i in range(300)], random.Random(3)
    rows = [(f"c{i}", "x", " ".join([w for w in words if r.random() > 0.07])) for i in range(300)]
    rows += [(f"d{i}", "xy"[i % 2], " ".join(words[:7] + [f"tail{i % 9}", f"more{i % 5}"])) for i in range(60)] + [("e", "x", "alone here"), (None, "x", rows[0][2])]
    docs = spark.createDataFrame(rows, "id string, b string, content string").repartition(4)

    def written() -> int:
        held = spark._jsc.sc().statusStore().executorList(False)
        return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))

    def found() -> dict:
        got = governance.near_duplicates(docs, "b", 0.72).collect()
        out = {(r.a_id, r.b_id): r.similarity for r in got}
        assert len(out) == len(got)
        return out

    before, limit = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        whole = found()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert written() - before < 6_000_000
    sets = {i: (b, set(t.split())) for i, b, t in rows if i}
    assert whole == {(i, j): round(len(x & y) / len(x | y), 3) for i, (b, x) in sets.items() for j, (c, y) in sets.items() if i < j and b == c and len(x & y) / len(x | y) >= 0.72}
    monkeypatch.setattr(governance, "SIDE", 20)
    monkeypatch.setattr(governance, "NUMBERS", 70)
    assert found() == whole


def test_targets_of_pairs_are_not_shuffled(spark):
    """The list has no repeats, whatever the ids, and its pairs are not dealt out again to find any."""
    from quarry.plans import vault as plans

    text = "some words that all these items have in common"
    ids = ["a", "b<->c", "a<->b", "c", "a", "semantic_conflict:k"]
    none = ["cast(null as array<string>) AS tags", "'' AS claim", "'s' AS scope", "'k' AS kind"]

    def listed(ids: list[str]) -> tuple[list[str], str]:
        items = spark.createDataFrame([(i, text) for i in ids], "id string, content string").selectExpr("id", "content", *none)
        out = plans.consolidation(items)
        return sorted(r.target for r in out.collect()), out._jdf.queryExecution().optimizedPlan().toString()

    pairs = {"<->".join((x, y)) for x in ids for y in ids if x < y}
    assert listed(ids)[0] == sorted(pairs)  # "a<->b<->c" in two ways, and those of the repeated id
    found, plan = listed([f"n{i}" for i in range(40)])
    assert found == sorted(f"n{i}<->n{j}" for i in range(40) for j in range(40) if f"n{i}" < f"n{j}")
    assert plan.splitlines()[0].startswith("Union")  # no aggregate over all pairs


def test_health_reads_contents_for_pairs_only(spark):
    from quarry.plans import vault as plans

    out = plans.vault_health(spark, "/root/testdata/sf0.001")
    assert not [f for f in out.inputFiles() if "documents.parquet" in f]  # states come from the table without contents


def plain_closure(edges, roots):
    out = {}
    for r in roots:
        out[r, r], front = 0, [r]
        while front:
            front = [(d, out[r, s] + 1) for s in front for a, d in edges if a == s]
            front = [d for d, n in front if (r, d) not in out and not out.update({(r, d): n})]
    return out


def test_closure_goes_by_what_is_known(spark, monkeypatch):
    random.seed(5)
    ring = [(i, i + 1) for i in range(41)] + [(41, 3), (50, 50)]
    cases = [(ring, list(range(1, 42)) + [50])]
    cases += [([(random.randrange(25), random.randrange(25)) for _ in range(m)], random.sample(range(25), k)) for m, k in ((60, 20), (40, 3))]
    steps = []
    monkeypatch.setattr(graph, "cut", lambda df, real=graph.cut: steps.append(1) or real(df))
    for at, (edges, roots) in enumerate(cases):
        steps.clear()
        got = graph.closure(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(r,) for r in roots], "node long")).collect()
        assert len(got) == len({(r.root, r.node) for r in got})
        assert {(r.root, r.node): r.depth for r in got} == plain_closure(set(edges), roots)
        assert at or len(steps) < 15  # ways of 41 steps, from all nodes


def test_drafts_are_walked_once_and_read_as_spark_reads_them(spark, monkeypatch):
    refs = ['"a\\u00e9\\n"', "1", "1.50", "-0", "1e3", "0.1e-7", "12345678901234567890", "123456789012345678901234567890123456789012", "true", "null", '{"b": 1.0, "a": ["x", null]}', "[1, 2.50]", '""']
    odd = [f'{{"x": {{"evidence_refs": [{r}], "read_requests": [{{"ref_id": {r}}}, {r}]}}}}' for r in refs]
    odd += [" \n" + odd[0] + " and more", '{"evidence_refs": ["p"], "evidence_refs": ["q"]}', '{"evidence_refs": [NaN]}', '{"evidence_refs": ["tab\there"]}', '{"evidence_refs": [01]}', "", "[", '{"a": 1 2}', '{"a":1}x', "7", '{"evidence_refs": ["' + "x" * 70_000 + '"]}']
    df = spark.createDataFrame(list(enumerate(odd)), "draft_id long, draft string")
    get = lambda at: f"try_variant_get(try_parse_json(draft), '$.{at}', 'string')"
    held = df.selectExpr("draft_id", "try_parse_json(draft) IS NULL AS bad", *[f"{get(at)} AS c{i}" for i, at in enumerate(("x.evidence_refs[0]", "x.read_requests[0].ref_id", "evidence_refs[0]"))]).collect()

    def refuse(*_):
        raise AssertionError("a step is written")

    monkeypatch.setattr(lineage, "new_folder", refuse)
    got = {(r.draft_id, r.path): (r.kind, r.ref_id) for r in citations.cited(df).collect()}
    for r in held:
        assert ((r.draft_id, "$") in got) == r.bad, odd[r.draft_id]
        if r.draft_id <= len(refs):
            assert got[r.draft_id, "$.x.evidence_refs[0]"] == ("citation", r.c0), odd[r.draft_id]
            assert got[r.draft_id, "$.x.read_requests[0]"] == ("request", r.c1), odd[r.draft_id]
    assert got[len(odd) - 1, "$.evidence_refs[0]"][1] == held[-1].c2 == "x" * 70_000
