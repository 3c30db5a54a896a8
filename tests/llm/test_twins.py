"""Operators that SQL cannot express, against slow and plain computations of the same results."""

import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest

from quarry.llm import html_text, mixing, quality


def letters(text, *kinds):
    return sum(unicodedata.category(c) in kinds for c in text)


def plain_statistics(text):
    """The statistics of quality.STATISTICS, counted letter by letter."""
    t = text or ""
    n = len(t)
    words = t.replace("\n", " ").split(" ")
    lines = t.split("\n")
    count = lambda chars: sum(c in chars for c in t)
    return [
        math.log1p(n), n / len(words), len(set(words)) / math.sqrt(len(words)), len(set(words)) / len(words),
        letters(t, "Ll") / max(n, 1), letters(t, "Lu") / max(n, 1), sum(c in "0123456789" for c in t) / max(n, 1),
        count(".,;:?") / len(words), count("!") / len(words), count("#$%&*+/<=>@\\^_`{|}~") / len(words), len(words) / len(lines), len(set(lines)) / len(lines),
    ]


def texts():
    random.seed(21)
    good = lambda: ". ".join(" ".join(random.choice(["the", "house", "élan", "Über", "is", "9", "of"]) for _ in range(random.randint(3, 12))) for _ in range(random.randint(1, 9)))
    junk = lambda: "\n".join(" ".join(["BUY!!", "$$$", "now"] * random.randint(1, 4)) for _ in range(random.randint(1, 5)))
    rows = [(i, good() if i % 3 else junk()) for i in range(240)]
    # Nulls, blanks, ties, repeated rows and a very long text.
    return [*rows, (300, None), (301, ""), (302, " "), (303, "\n\n"), (5, rows[5][1]), (304, "word " * 60_000), (None, "a text without an id")]


def test_quality_scores(spark, documents):
    rows = texts()
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(240)] + [(None, 1, 0), (7, None, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    model = quality.train(docs, labels)
    assert model.rules
    got = sorted(((r.doc_id, r.held_out, r.score, r.predicted) for r in quality.classify(docs, labels).collect()), key=repr)
    score = model.matrix(np.array([plain_statistics(t) for _, t in rows]))
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows]
    expected = sorted(((i, h, pytest.approx(float(s), abs=1e-9), int(s >= 0.3)) for (i, _), h, s in zip(rows, held, score)), key=lambda r: repr((r[0], r[1], r[2].expected, r[3])))
    assert got == expected
    seen = [(h, p == int(i % 3 != 0)) for i, h, _, p in got if i is not None and i < 240]
    assert sum(ok for h, ok in seen if h) >= 0.9 * sum(h for h, _ in seen)
    empty = documents([(1, "a")]).limit(0)
    assert quality.classify(empty, labels).count() == 0 and {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {1 / (1 + math.exp(-20.0))}


def plain_posterior(model, text):
    t = text or ""
    words = re.sub(r"[ \t\n\x0b\f\r.,;:!?]+", " ", t).lower().strip(" ").split(" ")
    n, count = len(t), lambda chars: sum(c in chars for c in t)
    kinds = set(words)
    stats = {
        "log_chars": math.log1p(n), "word_length": n / len(words), "distinct_words": len(kinds) / math.sqrt(len(words)), "distinct_share": len(kinds) / len(words),
        "lower_share": letters(t, "Ll") / max(n, 1), "stops_per_word": count(".,;:?") / len(words), "bangs_per_word": count("!") / len(words), "signs_per_word": count("#$%&*+/<=>@\\^_`{|}~") / len(words),
    }
    logs = {}
    for d, prior in model.priors.items():
        logs[d] = math.log(prior) + model.table[d, "marks"][min(3, len(kinds & set(model.marks)))]
        logs[d] += mixing.EVIDENCE * sum(model.table[d, f][sum(stats[f] > c for c in model.cuts[f])] for f in model.cuts)
    odds = {d: math.exp(x - max(logs.values())) for d, x in logs.items()}
    tokens = 0 if not t.strip(" ") else len(words)
    return tokens, {d: odds.get(d, 0.0) / sum(odds.values()) for d in mixing.DOMAINS}


def test_domain_posteriors(spark, documents):
    rows = [(i, t if i is None or i % 7 or t is None else f"scum and vermin, {t}") for i, t in texts()]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 7 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    model = mixing.fit_domains(docs, labels)
    assert {"scum", "vermin"} <= set(model.marks)
    found = mixing.mix(docs, labels, {"good": 0.7, "good_toxic": 0.1, "low": 0.15, "low_toxic": 0.05}).collect()
    got = sorted((repr(r.doc_id), r.n_tokens, [r[f"p_{d}"] for d in mixing.DOMAINS]) for r in found)
    expected = sorted((repr(i), n, [p[d] for d in mixing.DOMAINS]) for i, t in rows for n, p in [plain_posterior(model, t)])
    for a, b in zip(got, expected, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9)
    assert all(r.rate >= 0 for r in found)


def page(rng):
    """A page whose main text is known: paragraphs, headings and lists of an article among all that goes around one."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    sentence = lambda n: f"{words(n)}, {words(n)}."
    blocks, html = [], []
    for i in range(rng.randint(3, 9)):
        kind = rng.choice(["p", "p", "p", "h2", "ul", "blockquote"]) if i else "h1"
        if kind in ("h1", "h2"):
            t = words(rng.randint(2, 6))
            blocks.append(t)
            html.append(f"<{kind}>{t}</{kind}>")
        elif kind == "ul":
            items = [sentence(4) for _ in range(3)]
            blocks += items
            html.append("<ul>" + "".join(f"<li>{x}</li>\n" for x in items) + "</ul>")
        else:
            a, b = sentence(rng.randint(6, 20)), sentence(rng.randint(6, 20))
            blocks.append(f"{a} & {b} “x”")
            inner = f"{a}\n  &amp; <em>{b}</em> &#8220;x&#x201D;"
            html.append(f"<p>{inner}</p>" if kind == "p" else f"<blockquote><p>{inner}</p></blockquote>")
    links = "".join(f"<li><a href=/{word()}>{word()}</a></li>" for _ in range(8))
    around = [
        f"<nav><ul>{links}</ul></nav>", f"<header><a href=/>{words(3)}</a></header>", f"<script>var x = '{words(9)}';</script>", f"<style>.a{{color:red}} /* {words(5)} */</style>",
        f"<form><label>{words(2)}</label><input><button>{word()}</button></form>", f"<!-- {sentence(9)} -->",
    ]
    after = [f"<aside><h3>{word()}</h3><p>{sentence(8)}</p></aside>", f"<section class=comments><div class=comment><p>{sentence(15)}</p></div></section>", f"<div class=ad><p>{words(6)}</p></div>", f"<footer><p>{sentence(6)}</p></footer>"]
    rng.shuffle(around)
    rng.shuffle(after)
    shell = rng.choice([("<main><article>", "</article></main>"), ("<article>", "</article>"), ("<div class=wrap><article><div class=body>", "</div></article></div>")])
    return f"<!doctype html><html><head><title>{words(4)}</title></head><body>{''.join(around)}{shell[0]}{''.join(html)}{shell[1]}{''.join(after)}</body></html>", " ".join(blocks)


def test_main_text_of_generated_pages(spark):
    rng = random.Random(31)
    pages = [page(rng) for _ in range(300)]
    rows = [(i, f"http://x/{i}", h) for i, (h, _) in enumerate(pages)] + [(0, "again", pages[0][0]), (None, None, None)]
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wrong = [i for i, (_, t) in enumerate(pages) if got[i, f"http://x/{i}"] != (t, len(t))]
    assert not wrong, (len(wrong), pages[wrong[0]][1], got[wrong[0], f"http://x/{wrong[0]}"][0])
    assert got[0, "again"] == got[0, "http://x/0"] and got[None, None] == ("", 0)
