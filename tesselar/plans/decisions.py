"""Registered queries: decisions on a tree of three levels, losses and their reductions, areas without annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, overlap
from ..sources.annotations import PRELUDE, derived
from .catalog import BOXES_SQL, LONG, SOURCE_SQL, TREE, _energies
from .registry import registered

#: 9 holds 5 and 6, 6 holds 0 to 2, 5 holds 3 and 4; 7 and 8 are roots without children. Energies are taken times 8.
DEEP = hierarchy.Tree((6, 6, 6, 5, 5, 9, 9, None, None, None))
DEEP_SQL = """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: exp(8 * v::DOUBLE)) AS e FROM embeddings),
r AS (SELECT vec_id, e, e[8] / (e[8] + e[9] + e[10]) AS p7, e[9] / (e[8] + e[9] + e[10]) AS p8, e[10] / (e[8] + e[9] + e[10]) AS p9 FROM x),
s AS (SELECT *, p9 * e[6] / (e[6] + e[7]) AS p5, p9 * e[7] / (e[6] + e[7]) AS p6 FROM r),
p AS (SELECT *, p6 * e[1] / (e[1] + e[2] + e[3]) AS p0, p6 * e[2] / (e[1] + e[2] + e[3]) AS p1, p6 * e[3] / (e[1] + e[2] + e[3]) AS p2, p5 * e[4] / (e[4] + e[5]) AS p3, p5 * e[5] / (e[4] + e[5]) AS p4 FROM s)"""
CONF_SQL = "round(CASE node WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 WHEN 4 THEN p4 WHEN 5 THEN p5 WHEN 6 THEN p6 WHEN 7 THEN p7 WHEN 8 THEN p8 ELSE p9 END, 6) AS conf"


def terms_sql(criterion: str, *parts: str) -> str:
    return "(1 - " + " - ".join(f"({x}) * ({x})" for x in parts) + ")" if criterion == "gini" else "(" + " ".join(f"- ({x}) * log2({x})" for x in parts) + ")"


def deep_sql(criterion: str, thresh: float) -> str:
    """Ignored: 1 and 7; always refined: 6."""
    h = lambda *parts: terms_sql(criterion, *parts)
    gain = lambda whole, worst: f"1 - {whole} / ({worst} + 1e-30) > {thresh}"
    return DEEP_SQL + f""",
d AS (SELECT *, CASE WHEN p8 >= p9 THEN 8 WHEN NOT ({gain(h('p8', 'p5', 'p6'), h('p8', 'p9 / 2', 'p9 / 2'))}) THEN 9
  WHEN p6 > p5 THEN CASE WHEN p0 >= p2 THEN 0 ELSE 2 END
  WHEN {gain(h('p6', 'p3', 'p4'), h('p6', 'p5 / 2', 'p5 / 2'))} THEN CASE WHEN p3 >= p4 THEN 3 ELSE 4 END ELSE 5 END AS node FROM p)
SELECT vec_id, node, {CONF_SQL} FROM d"""


def _deep(spark: SparkSession, sf_dir: str, criterion: str, thresh: float, **rules) -> DataFrame:
    rows = _energies(spark, sf_dir).select("vec_id", F.array(*hierarchy.softmax(F.transform("embedding", lambda v: 8 * v.cast("double")), DEEP)).alias("p"))
    p = [F.col("p")[i] for i in range(len(DEEP.parent))]
    return rows.select("vec_id", hierarchy.decision(p, DEEP, thresh, criterion, **rules).alias("d")).select("vec_id", "d.node", F.round("d.conf", 6).alias("conf"))


RULES = {"ignore": frozenset({1, 7}), "always": frozenset({6})}


@registered("decision_deep_gini", deep_sql("gini", 0.02))
def decision_deep_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deep(spark, sf_dir, "gini", 0.02, **RULES)


@registered("decision_deep_entropy", deep_sql("entropy", 0.02))
def decision_deep_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deep(spark, sf_dir, "entropy", 0.02, **RULES)


@registered("decision_deep_prob", DEEP_SQL + f""",
b AS (SELECT *, CASE WHEN p7 >= p8 AND p7 >= p9 THEN 7 WHEN p8 >= p9 THEN 8 ELSE 9 END AS top, CASE WHEN p5 >= p6 THEN 5 ELSE 6 END AS mid, greatest(p5, p6) AS pm,
  CASE WHEN p5 >= p6 THEN CASE WHEN p3 >= p4 THEN 3 ELSE 4 END WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS low FROM p),
l AS (SELECT *, CASE low WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 ELSE p4 END AS pl FROM b),
d AS (SELECT *, CASE WHEN top < 9 OR p9 <= 0.1 OR pm <= 0.1 THEN top WHEN pl <= 0.1 THEN mid ELSE low END AS node FROM l)
SELECT vec_id, node, {CONF_SQL} FROM d""")
def decision_deep_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deep(spark, sf_dir, "prob", 0.1)


@registered("hier_softmax", SOURCE_SQL + " SELECT vec_id, idx, round(exp(logp), 6) AS logp FROM lp")
def hier_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _energies(spark, sf_dir).select("vec_id", LONG(hierarchy.softmax(F.col("embedding"), TREE)))


@registered("loss_sum", SOURCE_SQL + " SELECT round(sum(-logp), 3) AS total, round(avg(-logp), 6) AS average FROM lp WHERE idx = label")
def loss_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = hierarchy.cross_entropy(F.col("embedding"), F.col("label"), TREE)
    rows = _energies(spark, sf_dir).select(hierarchy.reduced(loss, "none").alias("loss"))
    return rows.agg(*[F.round(hierarchy.reduced(F.col("loss"), how), n).alias(name) for how, n, name in (("sum", 3, "total"), ("mean", 6, "average"))])


@registered("uncovered_area", PRELUDE + BOXES_SQL + """,
c AS (SELECT i.id, i.width::DOUBLE AS w, i.height::DOUBLE AS h, greatest(ax1, 0) AS u1, greatest(ay1, 0) AS v1, least(ax2, i.width) AS u2, least(ay2, i.height) AS v2 FROM b JOIN images i ON b.image_id = i.id),
k AS (SELECT DISTINCT * FROM c WHERE u1 < u2 AND v1 < v2),
ex AS (SELECT id, e, lead(e) OVER (PARTITION BY id ORDER BY e) AS f FROM (SELECT id, u1 AS e FROM k UNION SELECT id, u2 FROM k)),
ey AS (SELECT id, e, lead(e) OVER (PARTITION BY id ORDER BY e) AS f FROM (SELECT id, v1 AS e FROM k UNION SELECT id, v2 FROM k)),
un AS (SELECT id, sum((xf - xe) * (yf - ye)) AS u FROM (SELECT DISTINCT k.id, ex.e AS xe, ex.f AS xf, ey.e AS ye, ey.f AS yf FROM k
  JOIN ex ON ex.id = k.id AND u1 <= ex.e AND u2 >= ex.f JOIN ey ON ey.id = k.id AND v1 <= ey.e AND v2 >= ey.f) GROUP BY id)
SELECT i.id, coalesce(u, 0)::DOUBLE AS covered, (width * height - coalesce(u, 0))::DOUBLE AS uncovered FROM images i LEFT JOIN un ON un.id = i.id""")
def uncovered_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir)
    return overlap.uncovered_area(d.images, d.annots)
