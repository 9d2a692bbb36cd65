"""Queries on a tree over all components of a vector, and decisions by arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import wide_hierarchy as wide
from .catalog import _energies
from .decisions import DEEP, RULES, deep_sql
from .registry import SQL, registered

#: Three roots, each class with three children: 64 classes in four levels.
CLASSES = 64
PARENT = tuple(None if i < 3 else i // 3 - 1 for i in range(CLASSES))
WIDE_SQL = f"""WITH RECURSIVE n AS (SELECT i AS idx, CASE WHEN i >= 3 THEN i // 3 - 1 END AS parent FROM range({CLASSES}) t(i)),
up AS (SELECT idx, idx AS a, parent AS next FROM n UNION ALL SELECT up.idx, n.idx, n.parent FROM up JOIN n ON n.idx = up.next),
e AS MATERIALIZED (SELECT vec_id, idx, parent, embedding[idx + 1]::DOUBLE AS e FROM embeddings, n WHERE len(embedding) = {CLASSES}),
c AS MATERIALIZED (SELECT vec_id, idx, e - ln(sum(exp(e)) OVER (PARTITION BY vec_id, parent)) AS cond FROM e)"""


def _long(rows: DataFrame, column: str) -> DataFrame:
    return rows.select("vec_id", F.posexplode(column).alias("idx", "v")).select("vec_id", "idx", F.round("v", 6).alias("logp"))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _energies(spark, sf_dir).where(F.size("embedding") == CLASSES)


@registered("wide_source_log_softmax", WIDE_SQL + " SELECT vec_id, up.idx::INT AS idx, round(sum(cond), 6) AS logp FROM up JOIN c ON c.idx = up.a GROUP BY ALL")
def wide_source_log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_whole(spark, sf_dir).select("vec_id", wide.source_log_softmax(F.col("embedding"), PARENT).alias("v")), "v")


@registered("wide_sink_log_softmax", WIDE_SQL + """, lf AS (SELECT vec_id, idx, e - ln(sum(exp(e)) OVER (PARTITION BY vec_id)) AS logp FROM e WHERE idx NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL))
SELECT vec_id, a::INT AS idx, round(ln(sum(exp(logp))), 6) AS logp FROM up JOIN lf ON lf.idx = up.idx GROUP BY ALL""")
def wide_sink_log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_whole(spark, sf_dir).select("vec_id", wide.sink_log_softmax(F.col("embedding"), PARENT).alias("v")), "v")


@registered("wide_cross_entropy", WIDE_SQL + " SELECT label, count(*) AS n, round(avg(loss), 6) AS loss FROM (SELECT vec_id, -sum(cond) AS loss FROM (SELECT vec_id, label FROM embeddings WHERE label IS NOT NULL) l JOIN c USING (vec_id) JOIN up ON up.idx = label + 50 AND up.a = c.idx GROUP BY 1) JOIN embeddings USING (vec_id) GROUP BY label")
def wide_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as leaves of the tree."""
    loss = wide.cross_entropy(F.col("embedding"), F.col("label") + 50, PARENT)
    return _whole(spark, sf_dir).where("label is not null").select("label", loss.alias("loss")).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("loss"))


def _decided(spark: SparkSession, sf_dir: str, criterion: str, thresh: float, **rules) -> DataFrame:
    p = wide.softmax(F.transform(F.slice("embedding", 1, len(DEEP.parent)), lambda v: 8 * v.cast("double")), DEEP.parent)
    rows = _energies(spark, sf_dir).select("vec_id", p.alias("p")).select("vec_id", wide.decision(F.col("p"), DEEP.parent, thresh, criterion, **rules).alias("d"))
    return rows.select("vec_id", "d.node", F.round("d.conf", 6).alias("conf"))


@registered("wide_decision_gini", deep_sql("gini", 0.02))
def wide_decision_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, "gini", 0.02, **RULES)


@registered("wide_decision_prob", SQL["decision_deep_prob"])
def wide_decision_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, "prob", 0.1)
