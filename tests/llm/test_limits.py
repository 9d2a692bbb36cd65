"""Inputs that once were lost, crashed or took too long."""

import time

from pyspark.sql import functions as F

from tesselar.llm import decontamination, html_text, line_dedup, ngram_join, toxicity, url_filters


def test_short_and_unspaced_items(spark):
    han = "".join(chr(0x4E00 + 37 * i) for i in range(25))
    docs = spark.createDataFrame([(1, "he said: alpha beta gamma delta five, then left"), (2, "前言" + han[:12] + "改" + han[13:] + "后记"), (None, "alpha beta gamma delta six")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "Alpha beta gamma delta five"), (8, han), (None, "gamma delta six"), (9, " -- "), (10, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontamination.find_leaks(docs, items).collect()}
    assert got == {(1, 7, 0), (2, 8, 1), (None, None, 0)}
    assert decontamination.drop_leaks(docs, items).count() == 0


def test_html_limits():
    assert html_text.text_of(f"<table><tr><td colspan={'9' * 5000}>a<td>b</table>").split() == ["a", "b"]
    wide = "<table>" + f"<tr><td>{'w' * 1000}<td>x" + "<tr><td>a<td>b" * 5000 + "</table>"
    text = html_text.text_of(wide)
    assert len(text) < 30 * len(wide) and text.split()[:4] == ["w" * 1000, "x", "a", "b"]
    began = time.time()
    html_text.text_of("<style>" + "a" * 100_000 + "</style>shown")
    assert time.time() - began < 5
    assert html_text.text_of("<style>@import 'x'; .no{display:none}</style><p class=no>hidden<p>shown") == "shown"


def test_long_host(spark):
    url = "http://" + "a." * 20_000 + "Example.com/en/7?q"
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, action string")
    began = time.time()
    row = url_filters.filter_urls(spark.createDataFrame([(1, url), (2, "x://com/en/"), (3, None)], "page_id long, url string"), rules).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in row] == [("example.com/en/7", "allow"), ("com/en/", "block"), (None, "allow")]
    assert time.time() - began < 30


def test_lexicon_is_whole_and_stable(spark):
    bad = [f"{a}{b}{c}xyz" for a in "abcd" for b in "efgh" for c in "ijkl"]
    docs = [(i, " ".join(bad) + f" text{i}" if i % 2 else f"clean words only {i}") for i in range(300)]
    labels = [(i, i % 2) for i in range(300)] + [(i, 0) for i in range(1, 300, 2)]
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(d, toxicity.labelled_sample(l))
    assert {w for w in bad if any(w.startswith(s) for s in lexicon)} == set(bad)
    assert lexicon == toxicity.learn_lexicon(d.orderBy(F.desc("doc_id")), toxicity.labelled_sample(l))


def test_line_sites_brute(spark):
    """Lines of any number of sites around the threshold: none is lost, none is taken for more."""
    rows = [(f"line {n} {k} of words", f"site{s * 31 + k}") for n in range(1, 14) for k in range(60) for s in range(n)]
    docs = spark.createDataFrame([(i, line, site) for i, (line, site) in enumerate(rows)], "doc_id long, text string, source string")
    found = line_dedup.boilerplate(line_dedup.lines_of(docs, "source", 3), line_dedup.SITES)
    assert found.count() == 60 * (14 - line_dedup.SITES)


def test_large_near_copy_group(spark):
    """A group of near copies with repeated rows and null ids, beside copies that are not near enough."""
    base = [f"w{i}" for i in range(120)]
    near = [(i, " ".join(base[: 10 + i] + [f"x{i}"] + base[11 + i :])) for i in range(80)]
    far = [(100 + i, " ".join(w if j % 9 else f"y{i}{j}" for j, w in enumerate(base))) for i in range(30)]
    rows = [*near, *near[:20], (None, near[0][1]), (None, "single words of another kind here"), *far]
    got = ngram_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r.group for r in got if r.doc_id is not None and r.doc_id < 100} == {next(r.group for r in got if r.doc_id == 0)}
    assert all(r.component_id == r.doc_id for r in got if r.doc_id and r.doc_id >= 100)
