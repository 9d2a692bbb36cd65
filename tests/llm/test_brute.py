"""Operators that SQL can't express against slow plain versions, planted evidence and a whole run of the pipeline."""

import math
import random
import re
from collections import Counter

import corpus_pipeline
from tesselar.llm import language_id, quality_rules, toxicity


def brute_counts(text):
    """word_chars, n_symbols, n_dup_lines, n_repeat_words and n_words of a text."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), len(words)


def test_quality_counts_brute(spark):
    r = random.Random(8)
    texts = [None, "", " \n\x0b\n", "é x y # $", "a b " * 9, "\n".join(["same line"] * 4 + ["same line "])]
    for _ in range(150):
        pick = [f"v{r.randrange(r.choice([3, 40]))}" + r.choice(["", "", "#", "!", "<é>"]) for _ in range(r.randrange(80))]
        texts.append("".join(w + r.choice([" ", "  ", "\n", "\t", "\r\n"]) for w in pick) * r.choice([1, 1, 2]))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = quality_rules.judge(docs, spark.createDataFrame([], "doc_id long, quality int"))
    rows = got.select("doc_id", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words", "base_failed", "kept").collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = brute_counts(texts[row[0]])
        failed = want[4] < 20 or 100 * want[3] > 30 * want[4]
        assert tuple(row)[1:] == (*want, failed, not failed)


def test_binomial_tail(spark):
    pairs = [(0, 1), (0, 217), (1, 40), (3, 300), (9, 500), (40, 41), (7, 7)]
    tail = quality_rules.binomial_tail
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(pairs, "x long, n long").select("x", "n", tail(F.col("x"), F.col("n"), 0.02).alias("p")).collect()
    for x, n, p in rows:
        want = sum(math.comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(x + 1))
        assert abs(p - want) < 1e-9


def test_false_rejection_bound(spark):
    """Labels without any signal: over many strata, hardly any chosen rule loses more than ALPHA of good texts."""
    r = random.Random(5)
    rows, labels = [], []
    for s in range(20):
        for _ in range(400):
            text = " ".join(f"w{r.randrange(9000)}" for _ in range(30)) + " " + "#" * r.choice([0, 0, 1, 4, 9, 20])
            rows.append((len(rows), text, f"l{s}"))
            labels.append((len(labels), int(r.random() < 0.9)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality_rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).select("doc_id", "kept").collect()
    lost, good = Counter(), Counter()
    for doc, kept in got:
        if labels[doc][1]:
            good[rows[doc][2]] += 1
            lost[rows[doc][2]] += not kept
    assert sum(lost[s] > 0.02 * good[s] for s in good) <= 1


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lexicon_automaton_brute():
    r = random.Random(6)
    terms = sorted({"".join(r.choice("abcd") for _ in range(r.randrange(4, 13))) for _ in range(25)})
    automaton = toxicity.LexiconAutomaton(terms)
    for _ in range(3000):
        word = list(r.choice(terms) if r.random() < 0.7 else "".join(r.choice("abcd") for _ in range(r.randrange(0, 14))))
        for _ in range(r.randrange(4)):
            at = r.randrange(len(word) + 1)
            word[at : at + r.randrange(2)] = r.choice(["", "a", "e", "dd"])
        word = "".join(word)
        near = any(levenshtein(word, t) <= toxicity.edits_allowed(t) for t in terms)
        assert automaton.match(word) == (2 if any(word.startswith(t) for t in terms) else int(near))


def test_language_held_out(spark, sf_dir):
    """Learned on nine tenths of the documents, the model names the language of the rest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null and text is not null")
    model = language_id.learn_text_model(docs.where("doc_id % 10 <> 0"))
    rest = docs.where("doc_id % 10 = 0")
    found = language_id.identify(language_id.rows_of(rest, None), model).select("doc_id", "lang").join(rest.select("doc_id", rest.lang.alias("want")), "doc_id").collect()
    assert found and sum(lang == want for _, lang, want in found) >= 0.95 * len(found)


def test_language_planted_evidence(spark):
    """Texts that say nothing follow their host, then the suffix; declared markup and clear texts overrule a weak prior."""
    words = {"xx": "alfa bravo canto delta", "yy": "zulu yonder weekly quux"}
    docs = spark.createDataFrame([(i, " ".join([words[k]] * 8), k) for i in range(6) for k in words], "doc_id long, text string, lang string")
    model = language_id.learn_text_model(docs)
    page = lambda host, text, tag="": (f"http://{host}/p", f"<html{tag}><body>{text}</body></html>")
    pages = []
    for i in range(40):
        pages += [page("one.aa", words["xx"]), page("two.bb", words["yy"]), page("three.bb", words["yy"])]
    asked = {
        page("one.aa", "123 456"): "xx",  # host
        page("two.bb", "123 456"): "yy",
        page("new.bb", "77"): "yy",  # suffix
        page("one.aa", " ".join([words["yy"]] * 12)): "yy",  # clear text against the host
    }
    pages += [page("tags.cc", words["xx"], ' lang="xx"') for _ in range(40)] + [page("tags.cc", words["yy"], ' lang="yy"') for _ in range(40)]
    asked[page("tags.cc", "5 6", ' lang="yy"')] = "yy"  # declared, where the host leans to neither
    asked[page("tags.cc", "5 6", ' lang="xx"')] = "xx"
    rows = [(i, *p) for i, p in enumerate(pages + list(asked))]
    got = {x["page_id"]: x for x in language_id.identify(language_id.rows_of(None, spark.createDataFrame(rows, "page_id long, url string, html string")), model).collect()}
    assert len(got) == len(rows)
    assert [got[len(pages) + i]["lang"] for i in range(len(asked))] == list(asked.values())
    assert any(x["lang"] != x["text_lang"] for x in got.values())


def test_pipeline_whole(spark, tmp_path):
    """Every stage on a small corpus with null ids and texts, junk, boilerplate, copies and a leak."""
    r = random.Random(9)
    prose = lambda n, tag: " ".join(f"{tag}{r.randrange(10**6)}" for _ in range(n))
    item = prose(30, "item")
    boiler = prose(9, "menu")
    rows = [(i, prose(60, "clean"), "en", f"s{i % 12}") for i in range(40)]
    rows += [(100 + i, prose(50, "site") + "\n" + boiler, "en", f"s{i}") for i in range(12)]  # one line on twelve sites
    base = prose(80, "copy")
    rows += [(200, base, "en", "a"), (201, base + " end", "en", "b"), (202, base, "en", "c"), (None, base + " other", "en", "d")]
    rows += [(300, "too short", "en", "a"), (None, None, "en", "a"), (301, "", None, "a")]
    rows += [(400, prose(40, "lead") + " " + item + " " + prose(20, "tail"), "en", "a")]
    columns = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, columns)
    for name, df in {
        "documents": docs,
        "labels": spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item), (None, None)], "item_id long, text string"),
    }.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    kept, seen = docs, {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, kept, str(tmp_path))
        assert set(out.columns) == set(docs.columns), name
        seen[name] = out = out.select(*docs.columns).collect()
        kept = spark.createDataFrame(out, columns)
    ids = lambda name: Counter(x["doc_id"] for x in seen[name])
    all_ids = Counter(x[0] for x in rows)
    passed = all_ids - Counter({300: 1, 301: 1, None: 1})
    assert ids("quality rules") == ids("line dedup") == passed
    assert sum(boiler in (x["text"] or "") for x in seen["line dedup"]) <= 1
    assert ids("n-gram Jaccard join") in [passed - Counter({200: 1, 201: 1, 202: 1, None: 1}) + Counter({k: 1}) for k in (200, 201, 202, None)]
    assert ids("benchmark decontamination") == ids("n-gram Jaccard join") - Counter({400: 1})
    packed = {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert packed == set(ids("benchmark decontamination"))
