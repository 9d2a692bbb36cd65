"""From raw documents to packed training sequences: quality, lines, near copies, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm.common import stage, table, unstage, unused, words_of
from tesselar.llm.decontamination import drop_leaks
from tesselar.llm.line_dedup import dedup_lines
from tesselar.llm.ngram_join import near_groups
from tesselar.llm.packing import pack
from tesselar.llm.quality_rules import judge


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with all their columns; each row is judged by its own text and language, whatever ids it shares. An empty table stays empty."""
    bad = judge(docs, table(spark, sf_dir, "labels"), keys=True).where(~F.col("kept"))
    doc, stratum, twin = unused(docs, "__doc", "__stratum", "__twin")
    bad = bad.select(F.col("doc_id").alias(doc), F.col("stratum").alias(stratum), F.col("twin").alias(twin)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(twin)) & (F.coalesce("lang", F.lit("")) == F.col(stratum))
    return docs.join(bad, same, "left_anti")


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeats of boilerplate lines; null texts stay null, a text may become empty; an empty table stays empty."""
    return dedup_lines(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, that with the smallest id, then hash of text; texts without words stay, of equal rows one; an empty table stays empty."""
    near = stage(near_groups(docs), "near-groups")
    repeated = near.groupBy("doc_id", "twin").count().where("count > 1").limit(1).count()
    first = near.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "twin")).alias("first"))
    doc, twin = unused(docs, "__doc", "__twin")
    first = first.select(F.col("first.doc_id").alias(doc), F.col("first.twin").alias(twin))
    worded = F.size(words_of(F.col("text"))) > 0
    kept = docs.where(worded).join(first, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(twin)), "left_semi")
    bare = docs.where(~worded)
    if repeated:
        kept = kept.withColumn(twin, F.xxhash64("text")).dropDuplicates(["doc_id", twin]).drop(twin)
        bare = bare.dropDuplicates()
    return kept.unionAll(bare)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no test item; null and empty texts stay, repeated rows are judged one by one; an empty table stays empty."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; a null text is packed as an empty one, an empty table gives no rows."""
    return pack(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", cut_lines),
    ("n-gram Jaccard join", keep_one),
    ("benchmark decontamination", drop_benchmark),
    ("packing", pack_sequences),
]

#: Edit distances and the tokenizer can't be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES[:-1]):
        done = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            unstage(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
