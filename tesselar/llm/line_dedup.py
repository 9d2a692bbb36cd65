"""Line dedup by spread over sites: boilerplate lines of many sites are kept once.

Each line is named by two 64-bit hashes. A small HyperLogLog sketch of the sites per line
merges in the shuffle. A line in fewer places than SITES can't be on as many sites; one whose estimate is beyond what
SITES - 1 sites can give is boilerplate for sure; all lines between get an exact distinct count, so that none is lost. A line on at least SITES sites is boilerplate: its first occurrence
(smallest doc_id, then position) stays, every other one is removed from its text.

Lines of fewer than MIN_WORDS words are never removed; white space at a line's
ends does not count; long texts and lines count whole. Edge cases: null text stays null; a null site is no site; a null doc_id
sorts before all others; a repeated row is treated as its twin, so a line's first
occurrence stays in both; an empty table gives no rows; all columns of the input are kept,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE_SPACE, hinted, stage, table, unstage, unused

SITES = 6
MIN_WORDS = 3
#: Relative error that gives sketches of 16 registers.
RSD, REGISTERS = 0.39, 16


def lines_of(docs: DataFrame, site: str, min_words: int) -> DataFrame:
    """h1, h2, site, doc, twin (hash of the text), pos of each line that is long enough."""
    return (
        docs.where("text is not null")
        .select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("twin"), F.col(site).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .withColumn("line", F.btrim("line", F.lit(WHITE_SPACE)))
        .where(F.size(F.split("line", r"[\x20\x09-\x0D]+")) >= min_words)
        .select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "site", "doc", "twin", "pos")
    )


def sure_from(sites: int) -> float:
    """Estimates from here on come from at least `sites` sites: fewer leave so many registers empty that they can't reach it."""
    empty = REGISTERS - (sites - 1)
    return 0.673 * REGISTERS**2 / empty + 1 if empty > 0 else float("inf")


def boilerplate(lines: DataFrame, sites: int) -> DataFrame:
    """h1, h2 and the first occurrence of each line that is on at least `sites` sites."""
    spread = stage(
        lines.groupBy("h1", "h2")
        .agg(F.approx_count_distinct("site", RSD).alias("about"), F.count("site").alias("places"), F.min(F.struct("doc", "pos")).alias("first"))
        .where(F.col("places") >= sites),
        "line-spread",
    )
    near = spread.where(F.col("about") < sure_from(sites))
    exact = (
        lines.where("site is not null")
        .join(hinted(near.select("h1", "h2")), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= sites)
    )
    sure = spread.where(F.col("about") >= sure_from(sites))
    return sure.select("h1", "h2", "first").unionAll(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first"))


def dedup_lines(docs: DataFrame, sites: int = SITES, min_words: int = MIN_WORDS, site: str = "source", counts: bool = False) -> DataFrame:
    """docs with the repeats of boilerplate lines cut from text; with counts also n_lines and n_removed."""
    lines = stage(lines_of(docs, site, min_words), "line-hashes")
    marked = stage(boilerplate(lines, sites), "line-boilerplate")
    removed = (
        lines.drop("site")
        .join(hinted(marked), ["h1", "h2"])
        .where(~F.struct("doc", "pos").eqNullSafe(F.col("first")))
        .groupBy("doc", "twin")
        .agg(F.collect_set("pos").alias("cut_lines"))
    )
    removed = stage(removed, "line-removed")
    unstage(lines)
    doc, twin, cut, split = unused(docs, "__doc", "__twin", "__cut", "__lines")
    removed = removed.select(F.coalesce("doc", F.lit(-(2**63))).alias(doc), F.col("twin").alias(twin), F.col("cut_lines").alias(cut))
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), twin: F.xxhash64("text")})
    joined = keyed.join(removed, [doc, twin], "left").withColumn(split, F.split("text", "\n"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(cut)), lambda i: F.get(split, i))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    out = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        out += [F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"), F.coalesce(F.size(cut), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=True).select("doc_id", "n_lines", "n_removed", "text")


SQL = f"""
WITH cut AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, source, pos, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM cut),
b AS (SELECT line, arg_min(doc_id, (doc_id, pos)) AS d, arg_min(pos, (doc_id, pos)) AS p FROM l
  WHERE len(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+')) >= {MIN_WORDS} GROUP BY line HAVING count(DISTINCT source) >= {SITES}),
k AS (SELECT c.doc_id, c.pos, c.raw, b.line IS NULL OR (b.d = l.doc_id AND b.p = l.pos) AS kept
  FROM cut c JOIN l USING (doc_id, pos) LEFT JOIN b ON l.line = b.line)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT kept)::BIGINT AS n_removed,
  coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (kept), '') AS text FROM k GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
