"""The pipeline's stages on planted documents."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    random.seed(8)
    words = [a + b for a in ("tre", "riv", "sto", "clou", "ligh", "hou", "gard", "wint") for b in ("e", "er", "ne", "d", "t", "se", "en", "ing", "ed", "s")]
    text = lambda n: " ".join(random.choice(words) for _ in range(n)) + "."
    passage = text(120)
    rows, labels = [], []
    for i in range(150):
        good, toxic = i % 6 != 0, i % 11 == 0
        t = text(random.randint(60, 120)) if good else " ".join(w.upper() + "!!" for w in text(80).split())
        if toxic:
            t = "scum idiot " + t
        rows.append((i, t))
        labels.append((i, int(good), int(toxic)))
    rows += [(500, rows[1][1]), (501, rows[2][1] + " more"), (502, text(70) + passage), (503, passage + text(70))]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), dict(rows), {i: (q, t) for i, q, t in labels}, passage


def test_stages_take_effect(spark, tables):
    d, rows, labels, passage = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        new = corpus_pipeline.materialize(stage(spark, docs, d), name)
        if name != "encoding":
            assert new.columns == docs.columns
        seen.append({r.doc_id: r for r in new.collect()})
        docs = new
    kept, single, cut, mixed, encoded = seen
    assert all((i in kept) == (labels[i][0] == 1) for i in labels)
    assert 500 not in single and 501 not in single and 1 in single and 2 in single
    assert passage not in cut[502].text and cut[502].n_chars == len(cut[502].text) < len(rows[502])
    clean = [i for i in single if labels.get(i, (1, 0)) == (1, 0)]
    assert sum(i in mixed for i in clean) >= 0.97 * len(clean)
    toxic = [i for i in single if labels.get(i, (1, 0)) == (1, 1)]
    assert sum(i in mixed for i in toxic) <= 0.3 * len(toxic)
    assert set(encoded) == set(mixed) and all(r.n_tokens * 4 == len(r.ids) for r in encoded.values())


def test_mixing_keeps_clean_and_drops_toxic(spark, tables, monkeypatch):
    # Posteriors that overlap, as the classes of real documents do.
    d, rows, labels, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    p = {i: (0.05 + 0.3 * (i % 7) / 7, 0.9 - 0.3 * (i % 7) / 7) for i in rows}  # toxic posterior of clean and of toxic ones
    toxic = {i: labels.get(i, (1, 0))[1] == 1 for i in rows}
    members = [(i, len(t.split()), 0.1 * (1 - x), 0.1 * x, 0.9 * (1 - x), 0.9 * x) for i, t in rows.items() for x in [p[i][toxic[i]]]]
    keys = {r[0]: r[1] for r in docs.selectExpr("doc_id", "xxhash64(doc_id, text)").collect()}
    members = spark.createDataFrame([(keys[i], *x) for i, *x in members], "doc_id long, n_tokens long, p_low double, p_low_toxic double, p_good double, p_good_toxic double")
    monkeypatch.setattr(corpus_pipeline.mixing, "mix", lambda docs, labels, weights, key: corpus_pipeline.mixing.fit_rates(members, weights)[0])
    left = {r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, d).collect()}
    assert left == {i for i in rows if not toxic[i]}


def test_mixing_of_planted_documents(spark, tables):
    d, rows, labels, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, d).collect()}
    assert not [i for i, (_, t) in labels.items() if t and i in left]
    assert not [i for i, (_, t) in labels.items() if not t and i not in left]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_strings", "mixing", "encoding"]


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _score int, _words string, _copies int, id long, h long, places_0 int, kept string"


def run_stages(spark, docs, d):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, d), name)
        out.append(docs)
    return out


def test_nulls_repeated_rows_and_clashing_names(spark, tables):
    d, rows, _, _ = tables
    make = lambda i, t, n: (i, t, None, None, None if t is None else len(t), n, "w", 7, 8, 9, 5, "k")
    a, b, c, e = (rows[i] for i in (1, 2, 3, 4))
    table = [make(1, a, 1), make(1, a, 1), make(1, b, 2), make(2, b, 3), make(None, c, 4), make(5, c, 5), make(None, e, 6), make(9, None, 7), make(10, "", 8), make(None, None, 9)]
    docs = spark.createDataFrame(table, CLASHING)
    _, single, cut, mixed, encoded = run_stages(spark, docs, d)
    single2 = corpus_pipeline.drop_near_duplicates(spark, docs, d)
    assert single.columns == cut.columns == mixed.columns == docs.columns
    # Of each group one row: the smallest id's; blank rows are linked with nothing.
    assert sorted((tuple(r) for r in single2.collect()), key=repr) == sorted([table[0], table[2], table[5], table[6], table[7], table[8], table[9]], key=repr)
    unchanged = sorted((tuple(r) for r in corpus_pipeline.drop_repeated_strings(spark, single2, d).collect()), key=repr)
    assert unchanged == sorted((tuple(r) for r in single2.collect()), key=repr)
    assert encoded.count() == mixed.count()


def test_empty_table(spark, tables):
    d = tables[0]
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    assert [x.count() for x in run_stages(spark, docs, d)] == [0] * 5


def test_passages_of_over_50_words_go(spark, tables):
    # The shortest ones: words of four letters.
    random.seed(12)
    word = lambda: "".join(random.choice("abcdefghijklmnop") for _ in range(4))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(51)
    rows = [(i, text(200) + (" " + passage + " " if i % 3 == 0 else " ") + text(200)) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.drop_repeated_strings(spark, docs, tables[0]).collect()}
    for i, t in rows:
        assert got[i].n_chars == len(got[i].text)
        if i % 3:
            assert got[i].text == t
        else:  # a letter beside it may be the same in two texts
            assert passage[:30] not in got[i].text and passage[-30:] not in got[i].text and 0 <= len(t) - len(passage) - len(got[i].text) <= 8


def test_very_long_text(spark, tables):
    random.seed(13)
    long = " ".join("".join(random.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(60_000))
    docs = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, long[:-3000], "en", "s", 1), (3, "unlike them", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, tables[0]).collect()) == [1, 3]
    assert [r.n_chars for r in corpus_pipeline.drop_repeated_strings(spark, docs.filter("doc_id <> 2"), tables[0]).orderBy("doc_id").collect()] == [len(long), 1]
