"""URL filters: host-suffix and path-prefix expressions against hashed rules.

Each URL is expanded into every (host suffix, path prefix) expression that a
rule could have. Expressions are equi-joined with the rules on a short prefix
of their SHA-256 digests; the full digest then confirms a hit, and the longest
rule wins (on equal length the longer host; on the same expression block beats allow).
The rules may be any size: Spark broadcasts them only below its own size limit.

Edge cases: a long URL is expanded only as far as some rule's host and path go; an empty pages table gives no rows;
a null URL or one without "://" has empty host and path, fits no rule
and gets the default verdict. Repeated rows are judged one by one; extra columns
of the input are ignored; an empty rule table leaves every row to the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (host, path, action) of the production rules.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
PREFIX_HEX = 8  # 4 bytes of the digest


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL as columns; both empty without "://"."""
    found = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.substring(url, F.locate("://", url) + F.lit(3), F.length(url))
    host = F.when(found, _lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise("")
    path = F.when(found, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: key, host, path, rule (host + path of the rule that won), verdict."""
    rules = (
        rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("action").alias("r_action"))
        .where("r_host is not null and r_path is not null and r_action is not null")
        .withColumn("r_digest", F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256))
        .groupBy("r_digest", "r_host", "r_path")
        .agg(F.max("r_action").alias("r_action"))  # block beats allow on the same expression
        .withColumn("short", F.substring("r_digest", 1, PREFIX_HEX))
    )
    # Only path lengths and numbers of labels that some rule has can be a rule's: one row, two sets of small integers.
    dots = lambda host: F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    n_paths, n_dots = rules.agg(F.array_sort(F.collect_set(F.length("r_path"))), F.array_sort(F.collect_set(dots(F.col("r_host"))))).first()
    lengths = F.array(*map(F.lit, n_paths)).cast("array<int>")
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(key).alias("k"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    suffixes = F.array_compact(F.array(*[F.when(dots(F.col("host")) >= n, F.substring_index("host", ".", -n - 1)) for n in n_dots]).cast("array<string>"))
    wide = rows.withColumn("prefixes", F.filter(lengths, lambda n: n <= F.length("path")))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform("prefixes", lambda n: F.sha2(F.concat_ws("\n", h, F.substring(F.col("path"), F.lit(1), n)), 256))))
    tried = wide.select("row", "k", "host", "path", F.explode_outer(F.when(F.col("host") != "", keys)).alias("digest"))
    hit = tried.withColumn("short", F.substring("digest", 1, PREFIX_HEX)).join(rules, "short", "left")
    confirmed = F.when(
        F.col("digest") == F.col("r_digest"),
        F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.concat("r_host", "r_path").alias("rule"), F.col("r_action").alias("action")),
    )
    best = hit.groupBy("row").agg(F.first("k").alias(key), F.first("host").alias("host"), F.first("path").alias("path"), F.max(confirmed).alias("best"))
    return best.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


SQL = """
WITH rules(r_host, r_path, r_action) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
cut AS (
  SELECT page_id, row_number() OVER () AS rid,
    CASE WHEN coalesce(instr(url, '://'), 0) > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, rid,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
fits AS (
  SELECT p.*, r_host || r_path AS r, r_action,
    row_number() OVER (PARTITION BY rid ORDER BY length(r_host || r_path) DESC NULLS LAST) AS nth
  FROM parts p LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, r AS rule, coalesce(r_action, 'allow') AS verdict FROM fits WHERE nth = 1
"""
