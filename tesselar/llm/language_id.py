"""Language ID by Bayesian fusion of text, markup, address and host evidence.

Text likelihoods come from letter trigrams learned on a bounded sample of labelled documents. A row's
posterior multiplies: the text's likelihood (tempered to at most EFFECTIVE trigrams, as
neighbours are not independent), the likelihood of the declared markup language under each language
(a confusion table counted over all rows), and a prior of its host. Host priors are
smoothed hierarchically: all rows, then the address suffix, then the host, each with SMOOTH
pseudo-rows of the level above; the row's own contribution is left out of its host's counts.

Edge cases: null or empty text is decided by the other evidence; long texts count whole, with the weight of
EFFECTIVE trigrams; of equally likely languages the first by name is taken; a null id stays null; a null or malformed
URL has an empty host; repeated rows are judged one by one; an empty table gives no rows;
without any labelled document there are no languages to choose from and lang is null;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .html_text import text_of
from .packing import pieces_of
from .url_filters import url_parts

#: About so many labelled documents are learned from (chosen by hash), which bounds the model.
TRAIN_ROWS = 20_000
EFFECTIVE = 60
SMOOTH = 5.0
CACHE_WORDS = 300_000
DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})"
ROW = "doc_id long, page_id long, host string, suffix string, declared string"


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


def learn_text_model(docs: DataFrame, rows: int = TRAIN_ROWS) -> dict[str, dict[str, float]]:
    """Log probability of each trigram of the sample for each language; "" is that of an unseen one."""
    labelled = docs.where("lang is not null and text is not null")
    n = max(1, labelled.count())
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / n)) + 1).select("lang", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        for pdf in frames:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                words.setdefault(lang, Counter()).update(re.findall(r"[^\W\d_]+", text.lower()))
        for lang, seen in words.items():
            total: Counter = Counter()
            for word, k in seen.items():
                for g in grams(word):
                    total[g] += k
            yield pd.DataFrame({"lang": lang, "gram": list(total), "n": list(total.values())})

    counted = stage(sample.mapInPandas(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    seen: dict[str, dict[str, int]] = {}
    for lang, gram, k in counted.collect():  # as many as the sample has
        seen.setdefault(lang, {})[gram] = k
    model = {}
    for lang in sorted(seen):
        total = sum(seen[lang].values()) + len(seen[lang]) + 1
        model[lang] = {gram: math.log((k + 1) / total) for gram, k in sorted(seen[lang].items())} | {"": math.log(1 / total)}
    return model


class TextModel:
    def __init__(self, model: dict[str, dict[str, float]]):
        self.unseen = np.array([m[""] for m in model.values()])
        self.table = {}
        for k, m in enumerate(model.values()):
            for g, p in m.items():
                self.table.setdefault(g, self.unseen.copy())[k] = p
        self.known: dict[str, tuple] = {}

    def word(self, word: str) -> tuple:
        """Sum of log likelihoods of a word's trigrams for each language, and their number."""
        total, n = np.zeros(len(self.unseen)), 0
        for run in re.findall(r"[^\W\d_]+", word.lower()):
            for g in grams(run):
                total += self.table.get(g, self.unseen)
                n += 1
        return (*total.tolist(), n)

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Tempered log likelihoods, one row a text."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        flat = lists.flatten().dictionary_encode()
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        words = flat.dictionary.to_pylist()
        for w in words:
            if w not in self.known:
                self.known[w] = self.word(w)
        width = len(self.unseen) + 1
        rows = np.array([self.known[w] for w in words], float).reshape(-1, width)
        sums = np.vstack([np.zeros((1, width)), np.cumsum(rows[flat.indices.to_numpy()], axis=0).reshape(-1, width)])
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        total = sums[cuts[1:]] - sums[cuts[:-1]]
        n = total[:, -1:]
        return total[:, :-1] * (np.minimum(n, EFFECTIVE) / np.maximum(n, 1))


def text_evidence(rows: DataFrame, model: dict[str, dict[str, float]]) -> DataFrame:
    """ROW and ll (log likelihoods of the languages) from ROW, text and is_html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = TextModel(model)
        for batch in (piece for whole in batches for piece in pieces_of(whole)):
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            texts = pa.array([text_of(t) if h and t is not None else t for t, h in zip(at["text"].to_pylist(), at["is_html"].to_pylist())], pa.string()) if pc.any(at["is_html"]).as_py() else at["text"]
            ll = scorer.texts(texts)
            out = {name: at[name] for name in ("doc_id", "page_id", "host", "suffix", "declared")}
            yield pa.RecordBatch.from_pydict(out | {"ll": pa.array(list(ll), pa.list_(pa.float64()))})

    return rows.select("is_html", "text", "doc_id", "page_id", "host", "suffix", "declared").mapInArrow(run, ROW + ", ll array<double>")


def fuse(evidence: DataFrame, langs: list[str]) -> DataFrame:
    """lang and confidence for each row of evidence, with all its columns but ll."""
    n = len(langs)
    parts = [F.col("p")[k] for k in range(n)]
    rows = evidence.withColumn("top", F.array_max("ll")).withColumn("w", F.transform("ll", lambda x: F.exp(x - F.col("top"))))
    rows = stage(rows.withColumn("p", F.transform("w", lambda w: w / F.aggregate("w", F.lit(0.0), lambda a, x: a + x))).drop("w", "top"), "language-text")
    sums = [F.sum(c).alias(f"s{k}") for k, c in enumerate(parts)]
    again = [F.sum(f"s{k}").alias(f"t{k}") for k in range(n)]
    hosts = stage(rows.groupBy("host", "suffix").agg(F.count("*").alias("rows"), *sums), "language-hosts")
    total = hosts.agg(F.sum("rows").alias("rows"), *again).first()
    whole = [((total[f"t{k}"] or 0.0) + 1.0) / ((total["rows"] or 0) + n) for k in range(n)]
    suffixes = hosts.groupBy("suffix").agg(F.sum("rows").alias("of"), *again)
    level = [((F.col(f"t{k}") + SMOOTH * whole[k]) / (F.col("of") + SMOOTH)).alias(f"t{k}") for k in range(n)]
    priors = stage(hosts.join(suffixes.select("suffix", *level), "suffix").select("host", "suffix", "rows", F.array(*[f"s{k}" for k in range(n)]).alias("s"), F.array(*[f"t{k}" for k in range(n)]).alias("above")), "language-priors")
    # How often rows whose text speaks for a language declare each language.
    seen = {r["declared"]: r for r in rows.where(F.col("declared").isin(langs)).groupBy("declared").agg(*sums).collect()}
    of = [sum(r[f"s{k}"] for r in seen.values()) for k in range(n)]
    said = F.create_map(*[x for d in langs for x in (F.lit(d), F.array(*[F.lit(math.log(((seen[d][f"s{k}"] if d in seen else 0.0) + (4.0 if langs[k] == d else 1.0) ) / (of[k] + n + 3.0))) for k in range(n)]))])
    joined = rows.join(priors, ["host", "suffix"])
    prior = lambda k: F.log((F.greatest(F.col("s")[k] - F.col("p")[k], F.lit(0.0)) + SMOOTH * F.col("above")[k]) / (F.col("rows") - 1 + SMOOTH))
    logs = F.array(*[F.col("ll")[k] + prior(k) + F.coalesce(said[F.col("declared")][k], F.lit(0.0)) for k in range(n)])
    names = F.array(*map(F.lit, langs))
    scored = joined.withColumn("logs", logs)
    scored = scored.withColumn("best", F.array_max("logs"))
    return scored.select(
        "doc_id",
        "page_id",
        names[F.array_position("logs", F.col("best")).cast("int") - 1].alias("lang"),
        (1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))).alias("confidence"),
        names[F.array_position("p", F.array_max("p")).cast("int") - 1].alias("text_lang"),
        "declared",
        "host",
    )


def rows_of(docs: DataFrame | None, pages: DataFrame | None) -> DataFrame:
    """Rows for text_evidence: documents (their source is the host) and pages."""
    found = []
    if docs is not None:
        none = F.lit(None)
        found.append(docs.select(F.col("doc_id").cast("long"), none.cast("long").alias("page_id"), F.coalesce("source", F.lit("")).alias("host"), F.lit("").alias("suffix"), none.cast("string").alias("declared"), F.col("text"), F.lit(False).alias("is_html")))
    if pages is not None:
        host = url_parts(F.col("url"))[0]
        found.append(
            pages.select(
                F.lit(None).cast("long").alias("doc_id"),
                F.col("page_id").cast("long"),
                host.alias("host"),
                F.substring_index(host, ".", -1).alias("suffix"),
                F.nullif(F.lower(F.regexp_extract("html", DECLARED, 1)), F.lit("")).alias("declared"),
                F.col("html").alias("text"),
                F.lit(True).alias("is_html"),
            )
        )
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def identify(rows: DataFrame, model: dict[str, dict[str, float]]) -> DataFrame:
    if not model:
        return rows.select("doc_id", "page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    return fuse(text_evidence(rows, model), list(model))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(rows_of(docs, table(spark, sf_dir, "pages")), learn_text_model(docs))
