"""Toxicity scores from a learned lexicon, matched with Levenshtein automata.

A lexicon of word stems is learned from a bounded sample of labelled documents (no
held-out row is looked at): stems that are far more frequent in toxic texts, counted
over different texts. Its trie is intersected with the Levenshtein automaton of each
word by a deterministic automaton that is built as words ask for it: a state
is the set of trie nodes that some prefix of the word reaches with few enough
edits. A stem met without edits is a hit with any ending, a word within the edits that
its term allows is a misspelled hit. Every hit is scored by its context window:
inside quotation marks or after a reporting word it counts as quoted, near other hits as
abuse. A logistic regression over these counts gives the score.

Edge cases: null and empty texts have no hits and get the score of a text without
any; long texts are scored whole; an empty table gives no rows; a null doc_id counts as held out, as no label names it;
repeated rows are scored one by one; a label that is given twice, and a text that several labels mark, count as toxic if either
is; without labels, or without toxic ones, every score is the base rate or 0; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, stage, table

#: At most so many labelled rows are learned from (the first by hash); the lexicon is as long as they make it.
TRAIN_ROWS = 30_000
#: Stems have so many letters; a longer term is found by its first MAX_STEM ones.
MIN_STEM, MAX_STEM = 4, 16
MIN_TEXTS, MIN_RATIO = 5, 20.0
CONTEXT = 12
CACHE_WORDS = 300_000
MAX_STATES = 50_000
BATCH_ROWS = 300
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‚‘’‹›…–—¿¡"
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset("said says wrote writes called quote quoted quotes sagte schrieb nannte zitat dit écrit appelé cite dijo escribió llamó cita".split())
FEATURES = ["abuse", "misspelled", "quoted", "density", "crowd", "length"]


def labelled_sample(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and toxic of at most `rows` labelled documents that are not held out."""
    return (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .where(~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn_lexicon(docs: DataFrame, sample: DataFrame) -> list[str]:
    """Stems that mark toxic texts, each the longest that is as frequent as its prefixes."""
    texts = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .where("text is not null")
        .select("toxic", F.xxhash64("text").alias("h"), F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("words"))
        .groupBy("h")
        .agg(F.max("toxic").alias("toxic"), F.first("words").alias("words"))
    )
    words = texts.select(F.explode("words").alias("word"), "toxic").groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    stems = (
        words.where(F.length("word") >= MIN_STEM)
        .select("bad", "good", F.explode(F.transform(F.sequence(F.lit(MIN_STEM), F.least(F.length("word"), F.lit(MAX_STEM))), lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("stem"))
        .groupBy("stem")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )
    n = texts.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    if not n["bad"]:
        return []
    ratio = ((F.col("bad") + 0.5) / (n["bad"] + 1)) / ((F.col("good") + 0.5) / ((n["good"] or 0) + 1))
    found = stems.where((F.col("bad") >= max(MIN_TEXTS, n["bad"] // 60)) & (ratio >= MIN_RATIO)).withColumn("ratio", ratio).orderBy(F.desc("ratio"), "stem").collect()
    begins: dict[str, list] = {}
    for row in found:
        for n in range(MIN_STEM, len(row["stem"]) + 1):
            begins.setdefault(row["stem"][:n], []).append(row)
    chosen, prefixes = set(), set()
    for row in found:
        stem = row["stem"]
        if stem in prefixes or any(stem[:n] in chosen for n in range(MIN_STEM, len(stem) + 1)):
            continue
        longest = max((x["stem"] for x in begins[stem] if x["bad"] >= 0.9 * row["bad"]), key=lambda s: (len(s), s))
        chosen.add(longest)
        prefixes.update(longest[:n] for n in range(MIN_STEM, len(longest) + 1))
    return sorted(chosen)


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """The trie of the lexicon intersected with the Levenshtein automata of words, made deterministic on demand."""

    def __init__(self, lexicon: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.allowed, self.term = [0], [-1]  # most edits of any term below a node; edits of the term that ends there
        for term in lexicon:
            at, k = 0, edits_allowed(term)
            self.allowed[0] = max(self.allowed[0], k)
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                    self.term.append(-1)
                at = self.children[at][c]
                self.allowed[at] = max(self.allowed[at], k)
            self.term[at] = k
        self.reset()

    def reset(self) -> None:
        self.moves: list[dict[str, int]] = []
        self.sets: list[tuple] = []
        self.exact: list[bool] = []
        self.near: list[bool] = []
        self.number: dict[tuple, int] = {}
        self.start = self.state({0: 0})

    def state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes.items())
        while todo:  # leaving out letters of a term
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.allowed[child] and e + 1 < nodes.get(child, 99):
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(nodes.items()))
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.exact.append(any(e == 0 and self.term[n] >= 0 for n, e in key))
            self.near.append(any(e <= self.term[n] for n, e in key))
        return self.number[key]

    def move(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e < self.allowed[node]:
                nodes[node] = min(nodes.get(node, 99), e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.allowed[child]:
                    nodes[child] = min(nodes.get(child, 99), cost)
        to = self.state(nodes)
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> int:
        """2 if a term begins the word, 1 if the word is within a term's edits, else 0."""
        if len(self.sets) > MAX_STATES:
            self.reset()
        at = self.start
        for c in word:
            to = self.moves[at].get(c)
            at = self.move(at, c) if to is None else to
            if self.exact[at]:
                return 2
            if not self.sets[at]:
                return 0
        return int(self.near[at])


def context_counts(words: list[str], codes: list[int]) -> tuple[float, ...]:
    """FEATURES of a text from its words and their match codes."""
    hits = [i for i, c in enumerate(codes) if c]
    if not hits:
        return 0.0, 0.0, 0.0, 0.0, 0.0, math.log1p(len(words))
    abuse = misspelled = quoted = crowd = 0
    low = 0
    for k, i in enumerate(hits):
        a, b = max(0, i - CONTEXT), min(len(words), i + CONTEXT + 1)
        opened = any(w[:1] and w[0] in QUOTES for w in words[a : i + 1]) and not any(w.rstrip(".,;:!?")[-1:] and w.rstrip(".,;:!?")[-1] in QUOTES for w in words[a:i])
        closed = any(w.rstrip(".,;:!?")[-1:] and w.rstrip(".,;:!?")[-1] in QUOTES for w in words[i:b])
        if (opened and closed) or any(w.strip(EDGES) in REPORTING for w in words[a:i]):
            quoted += 1
        elif codes[i] == 2:
            abuse += 1
        else:
            misspelled += 1
        while hits[low] < i - CONTEXT:
            low += 1
        crowd = max(crowd, k - low + 1)
    return math.log1p(abuse), math.log1p(misspelled), math.log1p(quoted), 100.0 * abuse / len(words), float(min(crowd, 10)), math.log1p(len(words))


def count_hits(docs: DataFrame, lexicon: list[str]) -> DataFrame:
    """doc_id and FEATURES of each row's whole text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, known = LexiconAutomaton(lexicon), {}
        for pdf in batches(frames, BATCH_ROWS):
            rows = []
            for text in pdf["text"]:
                words = text.lower().split() if isinstance(text, str) else []
                new = set(words).difference(known)
                if len(known) + len(new) > CACHE_WORDS:
                    known, new = {}, set(words)
                for w in new:
                    known[w] = automaton.match(w.strip(EDGES))
                rows.append(context_counts(words, list(map(known.__getitem__, words))))
            out = pd.DataFrame(rows, columns=FEATURES, dtype=float)
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInPandas(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    sample = stage(labelled_sample(labels, rows), "toxicity-labels")
    counts = stage(count_hits(docs, learn_lexicon(docs, sample)), "toxicity-counts")
    train = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(counts.join(F.broadcast(sample), "doc_id"))
    kinds = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(kinds) < 2:
        z = F.lit(float("inf") if kinds.get(1) else -30.0)
    else:
        model = LogisticRegression(featuresCol="x", labelCol="toxic", regParam=1e-3, maxIter=60).fit(train.select("x", "toxic"))
        z = F.lit(float(model.intercept))
        for name, weight in zip(FEATURES, model.coefficients, strict=True):
            z = z + F.col(name) * float(weight)
    return counts.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), (1 / (1 + F.exp(-z))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
