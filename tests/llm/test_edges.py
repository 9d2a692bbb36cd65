"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for each operator."""

import random

import pytest
from pyspark.sql import functions as F

from tesselar.llm import decontamination, html_text, language_id, line_dedup, ngram_join, packing, quality_rules, substring_dedup, toxicity, url_filters

CLASH = ["doc", "twin", "anchor", "context", "token", "class", "block", "n", "t", "words", "site", "line", "row", "host", "__doc", "__twin", "__Cut", "__lines", "__stratum", "__doc_"]
PROSE = " ".join(f"word{i % 97} other{i}" for i in range(60))
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(40_000))
DOCS = [
    (1, PROSE, "en", "a"),
    (1, PROSE, "en", "a"),
    (2, PROSE + " more", "en", None),
    (3, None, None, None),
    (None, "short text", None, "b"),
    (None, PROSE, "en", "b"),
    (4, "", "de", "c"),
    (5, " \n\t\x0b ", "de", "c"),
    (6, LONG, "fr", "d"),
    (7, "einwort", "de", "d"),
]


def table(spark, rows=DOCS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"x{c}") for c in CLASH})


LABELS = "doc_id long, quality int, toxic int"


def operators(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (None, 1, 1), (6, None, None)], LABELS)
    items = spark.createDataFrame([(1, " ".join(PROSE.split()[:30])), (None, "x"), (2, None), (3, "")], "item_id long, text string")
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, action string")
    pages = lambda d: d.select("doc_id", *CLASH, F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))
    return {
        "decontamination": lambda d: decontamination.drop_leaks(d, items),
        "leaks": lambda d: decontamination.find_leaks(d, items),
        "urls": lambda d: url_filters.filter_urls(pages(d), rules),
        "packing": lambda d: packing.pack(d),
        "substring": lambda d: substring_dedup.remove_repeats(d),
        "quality": lambda d: quality_rules.judge(d, labels),
        "toxicity": lambda d: toxicity.score_toxicity(d, labels),
        "html": lambda d: html_text.extract_text(pages(d)),
        "ngram": lambda d: ngram_join.near_groups(d),
        "language": lambda d: language_id.identify(language_id.rows_of(d, None), language_id.learn_text_model(d)),
        "lines": lambda d: line_dedup.dedup_lines(d),
    }


NAMES = ["decontamination", "leaks", "urls", "packing", "substring", "quality", "toxicity", "html", "ngram", "language", "lines"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    docs = table(spark)
    out = operators(spark)[name](docs).collect()
    if name not in ("leaks", "packing", "decontamination"):
        assert len(out) == len(DOCS)
    if name == "decontamination":
        assert sorted(str(r["doc_id"]) for r in out) == sorted(["3", "None", "4", "5", "6", "7"])
    assert operators(spark)[name](docs.limit(0)).count() == 0


def brute_substring(docs, length=20):
    seen, out = set(), []
    for doc, text in docs:
        words = (text or "").split()
        cut = set()
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                cut.update(range(i, i + length))
            seen.add(window)
        out.append((doc, len(words), len(cut), " ".join(w for i, w in enumerate(words) if i not in cut)))
    return out


def random_docs(seed, n=120):
    r = random.Random(seed)
    passages = [" ".join(f"p{r.randrange(9)}" for _ in range(r.randrange(18, 60))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(f"q{r.randrange(40)}" for _ in range(r.randrange(1, 50))) for _ in range(r.randrange(0, 5))]
        docs.append((i, r.choice([" ", "\n", "\t "]).join(parts)))
    return docs


@pytest.mark.parametrize("hot", [64, 1])
def test_substring_brute(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    docs = random_docs(hot)
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", "kept")
    assert sorted(map(tuple, got.collect())) == brute_substring(docs)


def brute_groups(docs):
    sets = []
    for _, text in docs:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    return [(docs[i][0], len(sets[i]), docs[root[i]][0]) for i in range(len(docs))]


def test_groups_brute(spark):
    r = random.Random(5)
    docs = []
    for base in range(12):
        words = [f"v{r.randrange(400)}" for _ in range(r.randrange(3, 120))]
        for _ in range(r.randrange(1, 14)):
            near = list(words)
            for _ in range(r.randrange(0, 6)):
                near[r.randrange(len(near))] = f"Z{r.randrange(50)}"
            docs.append((len(docs), " ".join(near)))
    docs.append((len(docs), None))
    got = ngram_join.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == brute_groups(docs)


@pytest.mark.parametrize("seed", range(3))
def test_candidates_brute(spark, seed):
    """Groups of several classes whose shared shingles have different main groups."""
    r = random.Random(seed)
    roots = {c: c - c % 4 for c in range(12)}
    lists = {t: r.sample(sorted(roots), r.randrange(2, 7)) for t in range(30)}
    lists |= {100: [0, 1, 4], 101: [0, 4, 5], 102: [0, 4]}
    matches = {c: r.randrange(2, 5) for c in roots}
    matches[0] = matches[4] = 2
    rows = [(t, c, 10 << 36 | matches[c]) for t, cs in lists.items() for c in cs]
    groups = spark.createDataFrame([(c, root) for c, root in roots.items() if c != root], "node long, root long")
    mixed = ngram_join.mixed_rows(spark.createDataFrame(rows, "token long, class long, info long"), groups)
    got = ngram_join.candidates(mixed, 80).collect()
    want = {(a, b) for a in roots for b in roots if a < b and roots[a] != roots[b] and sum(a in cs and b in cs for cs in lists.values()) > min(matches[a], matches[b])}  # one more, by sizes
    assert (0, 4) in want and len(got) == len(want)
    assert {tuple(sorted(x)) for x in got} == want


def test_bits_rank_and_select():
    import numpy as np

    ones = np.random.default_rng(4).random(1000) < np.repeat([0.0, 1.0, 0.02, 0.5], 250)
    row, at = substring_dedup.Bits(ones), np.flatnonzero(ones)
    assert row.select(np.arange(len(at))).tolist() == at.tolist()
    assert row.rank(np.arange(1001)).tolist() == [int(ones[:i].sum()) for i in range(1001)]


def test_index_keeps_no_array_of_its_text():
    """What stays of an index is bits: less than two bytes a word for a text of 4096 words of 64 kinds."""
    import numpy as np

    text = np.random.default_rng(5).integers(1, 64, 4096)
    text[63::64] = 0
    index = substring_dedup.FmIndex(text, 5)
    rows = [index.bounds] + [row for _, row, _ in index.levels]
    assert sum(row.words.nbytes + row.before.nbytes for row in rows) + index.base.nbytes < 2 * len(text)
    assert set(vars(index)) == {"n", "bounds", "levels", "base"}


@pytest.mark.parametrize("heavy", [2, 1000])
def test_heavy_keys_join_in_parts(spark, monkeypatch, heavy):
    """Keys of any weight, that of a third of the rows and null ones included, give what a plain join gives."""
    monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(300)] + [(None, 900)], "key long, row long")
    keyed = rows.where("key <> 5").groupBy("key").count().withColumnRenamed("count", "n").withColumn("x", F.col("key") * 2)
    got = substring_dedup.spread_join(rows, keyed, ["key"], ["row"]).select("key", "row", "x")
    want = rows.join(keyed.drop("n"), "key").select("key", "row", "x")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    none = keyed.where("key > 99")
    assert substring_dedup.spread_join(rows, none, ["key"], ["row"]).count() == 0


def test_fm_index_counts():
    import numpy as np

    text = np.array([1, 2, 1, 3, 1, 2, 1, 0, 2, 1, 2, 1, 0])
    index = substring_dedup.FmIndex(text, 3)
    for pattern in ([1, 2, 1], [2, 1], [3], [1, 1]):
        lo, hi = np.array([0]), np.array([len(text)])
        for c in reversed(pattern):
            lo, hi = index.extend(lo, hi, np.array([c]))
        assert max(0, hi[0] - lo[0]) == sum(list(text[i : i + len(pattern)]) == pattern for i in range(len(text)))


def test_quality_cutoffs_of_small_strata(spark):
    """A stratum of a few hundred good documents gets a rule, a smaller one none, and good ones stay within the bound."""
    r = random.Random(3)
    rows, labels = [], []
    for lang, good, bad in [("en", 400, 60), ("de", 220, 30), ("es", 100, 30)]:
        for i in range(good + bad):
            lines = [" ".join(f"{lang}{r.randrange(5000)}" for _ in range(12)) for _ in range(4)]
            if i >= good:
                lines[0] += " " + "#" * r.choice([30, 60, 90])
            elif i % 5 == 0:
                lines.append(lines[0][:20])  # many good documents repeat a line, as does one of junk
                lines.append(lines[0][:20])
            rows.append((len(rows), "\n".join(lines + [lines[1][:20]] * 2 * (i == good)), lang))
            labels.append((len(labels), int(i < good), 0))
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS)).collect()
    kept = {}
    for x in got:
        key = rows[x["doc_id"]][2], labels[x["doc_id"]][1]
        kept[key] = kept.get(key, 0) + x["kept"]
    assert kept == {("en", 1): 400, ("en", 0): 0, ("de", 1): 220, ("de", 0): 0, ("es", 1): 100, ("es", 0): 30}


def edits(a, b):
    """Least word edits of a against any passage of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_leaks_brute(spark):
    r = random.Random(2)
    items = [(i, " ".join(f"k{r.randrange(30)}" for _ in range(r.randrange(6, 40)))) for i in range(10)]
    docs = []
    for d in range(40):
        words = items[r.randrange(10)][1].split()
        for _ in range(r.randrange(0, 9)):
            words[r.randrange(len(words))] = f"z{r.randrange(9)}"
        docs.append((d, " ".join([f"a{r.randrange(50)}" for _ in range(r.randrange(20))] + words + ["end"])))
    got = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {(d, i, n) for d, text in docs for i, item in items if (n := edits(item.split(), text.split())) <= int(0.2 * len(item.split()))}
    assert {(x["doc_id"], x["item_id"], x["distance"]) for x in got.collect()} == want


def test_packing_round_trip(spark, sf_dir):
    import zlib
    from array import array

    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6, None), (10**6 + 1, "a  BÉ\n\n'it's <|endoftext|> 12.5")], "doc_id long, text string"))
    pieces = packing.pack(docs).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
        by_doc.setdefault(p["doc_id"], []).append((p["start"], bytes(p["ids"])))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for d in docs.collect():
        ids = array("I", b"".join(x for _, x in sorted(by_doc[d["doc_id"]])))
        assert list(ids) == tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [1]
    used = padded = 0
    for parts in by_sequence.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        total = sum(n for _, n in parts)
        assert total <= 2048
        used, padded = used + total, padded + (total if total & (total - 1) == 0 else 2048)
    assert used >= 0.99 * padded
    steps = {}
    for p in pieces:
        steps.setdefault(p["step_group"] >> 36, {}).setdefault(p["step_group"], []).append(p["length"])
    for groups in steps.values():
        *whole, last = [sum(groups[g]) for g in sorted(groups)]
        assert set(whole) <= {packing.STEP_TOKENS} and 0 < last <= packing.STEP_TOKENS



def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.query(spark, sf).where("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    good, bad = [r[0] for r in rows if not r[1]], [r[0] for r in rows if r[1]]
    assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) >= 0.85 * len(good) * len(bad)
