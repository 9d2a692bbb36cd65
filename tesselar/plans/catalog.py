"""Registered queries of the annotation operators, each with SQL for another engine to check it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import grid, hierarchy, overlap, sampling
from ..sources.annotations import PRELUDE, derived
from .registry import QUERIES, SQL, registered

TREE = hierarchy.Tree((None, 8, 8, 8, 9, 9, 9, None, None, None))
#: Fixed query windows of the overlap queries.
WINDOWS = ((0, 0, 200, 200), (100, 50, 400, 250), (250, 150, 500, 500))


def _windows(data) -> DataFrame:
    boxes = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(w, ("x1", "y1", "x2", "y2"))]) for w in WINDOWS])
    return data.images.select(F.col("id").alias("image_id"), F.inline(boxes))


WINDOW_SQL = ",\nwin AS (SELECT id AS image_id, x1, y1, x2, y2 FROM images, (VALUES " + ", ".join("(" + ", ".join(f"{float(v)}::DOUBLE" for v in w) + ")" for w in WINDOWS) + ") AS v(x1, y1, x2, y2))"
BOXES_SQL = ",\nb AS (SELECT id AS aid, image_id, category_id, x AS ax1, y AS ay1, x + w AS ax2, y + h AS ay2, w * h AS a_area FROM annots WHERE x IS NOT NULL)"
MET = "w.image_id = b.image_id AND ax2 >= x1 AND ax1 <= x2 AND ay2 >= y1 AND ay1 <= y2"
SHARED = "(greatest(least(ax2, x2) - greatest(ax1, x1), 0) * greatest(least(ay2, y2) - greatest(ay1, y1), 0))"


@registered("dataset_stats", PRELUDE + """ SELECT (SELECT count(*) FROM images) AS n_images, (SELECT count(*) FROM annots) AS n_annots,
  (SELECT count(*) FROM categories) AS n_categories, (SELECT count(*) FROM annots WHERE x IS NULL) AS n_boxless""")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir)
    counts = d.annots.agg(F.count("*").alias("n_annots"), F.count_if(F.col("x").isNull()).alias("n_boxless"))
    return d.images.agg(F.count("*").alias("n_images")).join(counts).join(d.categories.agg(F.count("*").alias("n_categories")))


@registered("tabular_targets", PRELUDE + """ SELECT a.id AS aid, image_id AS gid, category_id, (x + w / 2)::FLOAT AS cx, (y + h / 2)::FLOAT AS cy,
  w::FLOAT AS width, h::FLOAT AS height, i.width AS img_width, i.height AS img_height FROM annots a JOIN images i ON a.image_id = i.id WHERE x IS NOT NULL""")
def tabular_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.targets(derived(spark, sf_dir))


def hash_sql(key: str, seed: int) -> str:
    return f"((({key} + {seed * 7919}) * 48271 % 2147483647 + {seed * 7919}) * 48271 % 2147483647)"


@registered("neg_anchors", PRELUDE + f""" SELECT a.id AS aid, w / least(i.width, i.height) AS w, h / least(i.width, i.height) AS h
  FROM annots a JOIN images i ON a.image_id = i.id WHERE x IS NOT NULL ORDER BY {hash_sql('a.id', 0)}, a.id LIMIT 1000""")
def neg_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.negative_anchors(sampling.targets(derived(spark, sf_dir)))


@registered("load_annotations", PRELUDE + " SELECT image_id, id, category_id, x, y, w, h FROM annots WHERE image_id IN (SELECT id FROM images)")
def load_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir)
    return overlap.annotations_of(d.images, d.annots).select("image_id", "id", "category_id", "x", "y", "w", "h")


@registered("overlap_join", PRELUDE + WINDOW_SQL + BOXES_SQL + f" SELECT w.image_id, x1, y1, x2, y2, aid FROM win w JOIN b ON {MET}")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir)
    return overlap.overlaps(_windows(d), d.annots).select("image_id", "x1", "y1", "x2", "y2", "aid")


@registered("overlap_visible", PRELUDE + WINDOW_SQL + BOXES_SQL + f" SELECT w.image_id, x1, y1, aid FROM win w JOIN b ON {MET} AND {SHARED} / (a_area + 1e-6) > 0.5")
def overlap_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir)
    return overlap.overlaps(_windows(d), d.annots, visible=0.5).select("image_id", "x1", "y1", "aid")


@registered("overlap_iou", PRELUDE + WINDOW_SQL + BOXES_SQL + f" SELECT w.image_id, x1, y1, aid, round({SHARED} / (a_area + (x2 - x1) * (y2 - y1) - {SHARED}), 6) AS iou FROM win w JOIN b ON {MET}")
def overlap_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir)
    return overlap.overlaps(_windows(d), d.annots).select("image_id", "x1", "y1", "aid", F.round("iou", 6).alias("iou"))


@registered("overlap_iou_cells", SQL["overlap_iou"])
def overlap_iou_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, joined by cells of the images."""
    d = derived(spark, sf_dir)
    return overlap.overlaps_by_cell(_windows(d), d.annots, cell=100).select("image_id", "x1", "y1", "aid", F.round("iou", 6).alias("iou"))


@registered("overlap_iooa", PRELUDE + WINDOW_SQL + BOXES_SQL + f" SELECT w.image_id, x1, y1, aid, round({SHARED} / (a_area + 1e-6), 6) AS iooa FROM win w JOIN b ON {MET}")
def overlap_iooa(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir)
    return overlap.overlaps(_windows(d), d.annots).select("image_id", "x1", "y1", "aid", F.round("iooa", 6).alias("iooa"))


def starts_sql(size: str, window: int, stride: int) -> str:
    return f"list_distinct(list_concat(range(0, greatest({size} - {window}, 0) + 1, {stride}), [greatest({size} - {window}, 0)::BIGINT]))"


def grid_sql(window: tuple[int, int] | None, stride: tuple[int, int] | None, counted: str) -> str:
    if window is None:
        win = "SELECT id AS image_id, 0::DOUBLE AS x1, 0::DOUBLE AS y1, width::DOUBLE AS x2, height::DOUBLE AS y2 FROM images"
    else:
        (h, w), (sy, sx) = window, stride
        win = f"""SELECT image_id, x0::DOUBLE AS x1, y0::DOUBLE AS y1, (x0 + {w})::DOUBLE AS x2, (y0 + {h})::DOUBLE AS y2
          FROM (SELECT image_id, y0, unnest({starts_sql('width', w, sx)}) AS x0 FROM (SELECT id AS image_id, width, unnest({starts_sql('height', h, sy)}) AS y0 FROM images))"""
    return PRELUDE + BOXES_SQL + f""",
win AS ({win}),
m AS (SELECT w.*, b.*, c.name, {SHARED} AS s FROM (SELECT image_id, x1, y1, x2, y2 FROM win) w LEFT JOIN b ON {MET} LEFT JOIN categories c ON c.id = b.category_id),
gr AS (SELECT image_id, x1, y1, x2, y2, count(aid) FILTER ({counted}) AS n_counted, count(aid) AS n_aids, coalesce(sum(aid), 0)::BIGINT AS sum_aids,
  coalesce(sum(a_area) FILTER (name = 'ignore'), 0) AS isum, coalesce(max(s) FILTER (name = 'ignore'), 0) AS imax, count(*) FILTER (name = 'ignore') AS icount FROM m GROUP BY ALL),
ib AS (SELECT g.image_id, x1, y1, greatest(ax1, x1) AS u1, greatest(ay1, y1) AS v1, least(ax2, x2) AS u2, least(ay2, y2) AS v2 FROM gr g JOIN b ON g.image_id = b.image_id AND ax2 >= x1 AND ax1 <= x2 AND ay2 >= y1 AND ay1 <= y2
  WHERE b.category_id = 7 AND icount > 1),
ex AS (SELECT image_id, x1, y1, e, lead(e) OVER (PARTITION BY image_id, x1, y1 ORDER BY e) AS f FROM (SELECT image_id, x1, y1, u1 AS e FROM ib UNION SELECT image_id, x1, y1, u2 FROM ib)),
ey AS (SELECT image_id, x1, y1, e, lead(e) OVER (PARTITION BY image_id, x1, y1 ORDER BY e) AS f FROM (SELECT image_id, x1, y1, v1 AS e FROM ib UNION SELECT image_id, x1, y1, v2 FROM ib)),
un AS (SELECT image_id, x1, y1, sum((cf - ce) * (df - de)) AS u FROM (SELECT DISTINCT i.image_id, i.x1, i.y1, ex.e AS ce, ex.f AS cf, ey.e AS de, ey.f AS df FROM ib i
  JOIN ex ON ex.image_id = i.image_id AND ex.x1 = i.x1 AND ex.y1 = i.y1 AND u1 <= ex.e AND u2 >= ex.f
  JOIN ey ON ey.image_id = i.image_id AND ey.x1 = i.x1 AND ey.y1 = i.y1 AND v1 <= ey.e AND v2 >= ey.f) GROUP BY ALL)
SELECT image_id, x1, y1, x2, y2, n_aids, sum_aids, n_counted, n_counted > 0 AS is_positive FROM gr LEFT JOIN un USING (image_id, x1, y1)
WHERE NOT (isum / ((x2 - x1) * (y2 - y1)) > 0.6 AND (imax / ((x2 - x1) * (y2 - y1)) > 0.6 OR coalesce(u, 0) / ((x2 - x1) * (y2 - y1)) > 0.6))"""


ALL_CLASSES = "name NOT IN ('ignore', 'background')"


def _summed(df: DataFrame) -> DataFrame:
    total = F.aggregate("aids", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumns({"n_aids": F.size("aids").cast("long"), "sum_aids": total}).drop("aids")


@registered("image_grid", grid_sql((224, 224), (224, 224), ALL_CLASSES))
def image_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(grid.image_grid(derived(spark, sf_dir), (224, 224)))


@registered("image_grid_overlap50", grid_sql((224, 224), (112, 112), ALL_CLASSES))
def image_grid_overlap50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(grid.image_grid(derived(spark, sf_dir), (224, 224), 0.5))


@registered("image_grid_class_filter", grid_sql((128, 160), (128, 160), "name IN ('large', 'promo')"))
def image_grid_class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(grid.image_grid(derived(spark, sf_dir), (128, 160), interest=("Large", "promo")))


@registered("image_grid_full", grid_sql(None, None, ALL_CLASSES))
def image_grid_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(grid.image_grid(derived(spark, sf_dir), None))


@registered("video_frame_order", PRELUDE + " SELECT id AS image_id, video_id, (row_number() OVER (PARTITION BY video_id ORDER BY frame_index, id) - 1)::INT AS place, vid_scale FROM images")
def video_frame_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.ordered_frames(derived(spark, sf_dir).images)


@registered("video_grid", PRELUDE + BOXES_SQL + f""",
f AS (SELECT id AS image_id, video_id, frame_index AS place, vid_scale AS s FROM images),
v AS (SELECT v.id AS video_id, v.width, v.height, n FROM videos v JOIN (SELECT video_id, count(*) AS n FROM f GROUP BY 1) l ON l.video_id = v.id),
w1 AS (SELECT video_id, width, height, unnest({starts_sql('n', 2, 2)}) AS t0 FROM v),
w2 AS (SELECT video_id, t0, width, unnest({starts_sql('height', 224, 224)}) AS y0 FROM w1),
w3 AS (SELECT video_id, t0, y0, unnest({starts_sql('width', 224, 224)}) AS x0 FROM w2),
p AS (SELECT w3.*, image_id, x0 / s AS x1, y0 / s AS y1, (x0 + 224) / s AS x2, (y0 + 224) / s AS y2 FROM w3 JOIN f ON f.video_id = w3.video_id AND place >= t0 AND place < t0 + 2)
SELECT w.video_id, t0::INT AS t0, x0::INT AS x0, y0::INT AS y0, count(DISTINCT aid) AS n_aids, count(aid) > 0 AS is_positive FROM p w LEFT JOIN b ON {MET} GROUP BY ALL""")
def video_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.video_grid(derived(spark, sf_dir), (2, 224, 224)).select("video_id", "t0", "x0", "y0", F.size("aids").cast("long").alias("n_aids"), "is_positive")


@registered("random_negatives_abs", PRELUDE + BOXES_SQL + f""",
c AS (SELECT id * 2 + t AS cand, id AS image_id, width, height FROM images, (VALUES (0), (1)) AS v(t) WHERE width >= 50 AND height >= 50),
w AS (SELECT cand, image_id, ({hash_sql('cand', 1)} % (width - 49))::DOUBLE AS x1, ({hash_sql('cand', 2)} % (height - 49))::DOUBLE AS y1 FROM c),
e AS (SELECT *, x1 + 50 AS x2, y1 + 50 AS y2 FROM w)
SELECT * FROM e w WHERE NOT EXISTS (SELECT 1 FROM b WHERE {MET}) ORDER BY {hash_sql('cand', 3)}, cand LIMIT 500""")
def random_negatives_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_negatives(derived(spark, sf_dir), (50, 50), 500)


LONG = lambda cols: F.inline(F.array(*[F.struct(F.lit(i).alias("idx"), F.round(c, 6).alias("logp")) for i, c in enumerate(cols)]))
NODES_SQL = "n AS (SELECT * FROM (VALUES (0, NULL), (1, 8), (2, 8), (3, 8), (4, 9), (5, 9), (6, 9), (7, NULL), (8, NULL), (9, NULL)) AS t(idx, parent)),\ne AS (SELECT vec_id, label, idx, parent, embedding[idx + 1]::DOUBLE AS e FROM embeddings, n)"
COND_SQL = "c AS (SELECT *, e - (max(e) OVER w + ln(sum(exp(e)) OVER w / exp(max(e) OVER w))) AS cond FROM e WINDOW w AS (PARTITION BY vec_id, coalesce(parent, -1)))"
SOURCE_SQL = f"WITH {NODES_SQL},\n{COND_SQL},\nlp AS (SELECT c.vec_id, c.label, c.idx, c.parent, c.cond + coalesce(p.cond, 0) AS logp FROM c LEFT JOIN c p ON p.vec_id = c.vec_id AND p.idx = c.parent)"


def _energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")


@registered("cond_log_softmax", f"WITH {NODES_SQL},\n{COND_SQL} SELECT vec_id, idx, round(cond, 6) AS logp FROM c")
def cond_log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _energies(spark, sf_dir).select("vec_id", LONG(hierarchy.conditional_log_softmax(F.col("embedding"), TREE)))


@registered("source_log_softmax", SOURCE_SQL + " SELECT vec_id, idx, round(logp, 6) AS logp FROM lp")
def source_log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _energies(spark, sf_dir).select("vec_id", LONG(hierarchy.source_log_softmax(F.col("embedding"), TREE)))


@registered("sink_log_softmax", f"""WITH {NODES_SQL}, l AS (SELECT vec_id, idx, parent, e - ln(sum(exp(e)) OVER (PARTITION BY vec_id)) AS logp FROM e WHERE idx NOT IN (8, 9))
SELECT vec_id, idx, round(logp, 6) AS logp FROM l UNION ALL SELECT vec_id, parent, round(ln(sum(exp(logp))), 6) FROM l WHERE parent IS NOT NULL GROUP BY vec_id, parent""")
def sink_log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _energies(spark, sf_dir).select("vec_id", LONG(hierarchy.sink_log_softmax(F.col("embedding"), TREE)))


@registered("hier_cross_entropy", SOURCE_SQL + " SELECT label, count(*) AS n, round(avg(-logp), 6) AS loss FROM lp WHERE idx = label GROUP BY label")
def hier_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = hierarchy.nll(hierarchy.source_log_softmax(F.col("embedding"), TREE), F.col("label"))
    return _energies(spark, sf_dir).select("label", loss.alias("loss")).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("loss"))


def _probs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    rows = _energies(spark, sf_dir).select("vec_id", F.array(*[F.exp(c) for c in hierarchy.source_log_softmax(F.col("embedding"), TREE)]).alias("p"))
    return rows, [F.col("p")[i] for i in range(len(TREE.parent))]


@registered("gini_entropy", SOURCE_SQL + " SELECT vec_id, round(1 - sum(exp(logp) * exp(logp)), 6) AS gini, round(-sum(exp(logp) * log2(exp(logp))), 6) AS entropy FROM lp WHERE parent IS NULL GROUP BY vec_id")
def gini_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, p = _probs(spark, sf_dir)
    roots = [p[i] for i in TREE.roots]
    return rows.select("vec_id", F.round(hierarchy.gini(roots), 6).alias("gini"), F.round(hierarchy.entropy(roots), 6).alias("entropy"))


LEVELS_SQL = """,
r AS (SELECT vec_id, arg_max(idx, (logp, -idx)) AS k, exp(max(logp)) AS pk FROM lp WHERE parent IS NULL GROUP BY vec_id),
ch AS (SELECT r.vec_id, arg_max(idx, (logp, -idx)) AS ck, exp(max(logp)) AS pc FROM r JOIN lp ON lp.vec_id = r.vec_id AND lp.parent = k GROUP BY r.vec_id)"""


@registered("prob_decision", SOURCE_SQL + LEVELS_SQL + " SELECT r.vec_id, CASE WHEN pk > 0.25 AND pc > 0.25 THEN ck ELSE k END AS node, round(CASE WHEN pk > 0.25 AND pc > 0.25 THEN pc ELSE pk END, 6) AS conf FROM r LEFT JOIN ch USING (vec_id)")
def prob_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, p = _probs(spark, sf_dir)
    return rows.select("vec_id", hierarchy.prob_decision(p, TREE, 0.25).alias("d")).select("vec_id", "d.node", F.round("d.conf", 6).alias("conf"))


def decision_sql(term: str, total: str, thresh: float) -> str:
    return SOURCE_SQL + LEVELS_SQL + f""",
o AS (SELECT r.vec_id, sum({term.format('exp(logp)')}) AS s FROM r JOIN lp ON lp.vec_id = r.vec_id AND lp.parent IS NULL AND idx <> k GROUP BY 1),
f AS (SELECT r.vec_id, sum({term.format('exp(logp)')}) AS s, sum({term.format('(pk / 3)')}) AS w FROM r JOIN lp ON lp.vec_id = r.vec_id AND lp.parent = k GROUP BY 1),
q AS (SELECT r.*, ck, pc, 1 - {total.format('(o.s + f.s)')} / ({total.format('(o.s + f.w)')} + 1e-30) > {thresh} AS go FROM r JOIN o USING (vec_id) LEFT JOIN f USING (vec_id) LEFT JOIN ch USING (vec_id))
SELECT vec_id, CASE WHEN go THEN ck ELSE k END AS node, round(CASE WHEN go THEN pc ELSE pk END, 6) AS conf FROM q"""


@registered("decision_gini", decision_sql("{0} * {0}", "(1 - {0})", 0.05))
def decision_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, p = _probs(spark, sf_dir)
    return rows.select("vec_id", hierarchy.decision(p, TREE, 0.05).alias("d")).select("vec_id", "d.node", F.round("d.conf", 6).alias("conf"))


@registered("decision_entropy", decision_sql("{0} * log2({0})", "(-{0})", 0.05))
def decision_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, p = _probs(spark, sf_dir)
    return rows.select("vec_id", hierarchy.decision(p, TREE, 0.05, hierarchy.entropy).alias("d")).select("vec_id", "d.node", F.round("d.conf", 6).alias("conf"))


@registered("class_histogram", PRELUDE + " SELECT image_id, category_id, count(*) AS n FROM annots GROUP BY ALL")
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).annots.groupBy("image_id", "category_id").agg(F.count("*").alias("n"))


@registered("catfreq_pivot", PRELUDE + """ SELECT name, count(*) FILTER (image_id % 3 = 0) AS train, count(*) FILTER (image_id % 3 = 1) AS vali, count(*) FILTER (image_id % 3 = 2) AS test, count(*) AS total
  FROM annots a JOIN categories c ON a.category_id = c.id GROUP BY name""")
def catfreq_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir)
    split = F.element_at(F.array(*map(F.lit, ("train", "vali", "test"))), (F.col("image_id") % 3 + 1).cast("int"))
    named = d.annots.join(d.categories.select(F.col("id").alias("category_id"), "name"), "category_id")
    wide = named.withColumn("split", split).groupBy("name").pivot("split", ["train", "vali", "test"]).agg(F.count(F.lit(1))).na.fill(0)
    return wide.withColumn("total", F.col("train") + F.col("vali") + F.col("test"))


@registered("tree_roots_leaves", PRELUDE + " SELECT id, parent_id IS NULL AS is_root, id NOT IN (SELECT parent_id FROM categories WHERE parent_id IS NOT NULL) AS is_leaf FROM categories")
def tree_roots_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    cats = derived(spark, sf_dir).categories
    parents = cats.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct().withColumn("has", F.lit(True))
    return cats.join(parents, "id", "left").select("id", F.col("parent_id").isNull().alias("is_root"), F.col("has").isNull().alias("is_leaf"))


@registered("embed_slice", PRELUDE + """ SELECT id, least(greatest(0, x - 20), 400) AS lo,
  greatest(least(greatest(0, x - 20), 400), greatest(least(400, x + w + 20), 0)) AS hi, greatest(0, 20 - x) AS pad_lo, greatest(0, x + w + 20 - 400) AS pad_hi FROM annots WHERE x IS NOT NULL""")
def embed_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = g.embed(F.col("x") - 20, F.col("x") + F.col("w") + 20, F.lit(400.0))
    return derived(spark, sf_dir).annots.where("x is not null").select("id", *[c.cast("double").alias(n) for c, n in zip(parts, ("lo", "hi", "pad_lo", "pad_hi"))])


@registered("infer_target_center", PRELUDE + """ SELECT id, m, floor(x + w / 2 - ew / 2)::BIGINT AS x0, (floor(x + w / 2 - ew / 2) + ew)::BIGINT AS x1, floor(y + h / 2 - eh / 2)::BIGINT AS y0, (floor(y + h / 2 - eh / 2) + eh)::BIGINT AS y1
  FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 'extent' ELSE 'square' END AS m, CASE WHEN id % 2 = 0 THEN ceil(w) ELSE greatest(ceil(w), ceil(h)) END AS ew, CASE WHEN id % 2 = 0 THEN ceil(h) ELSE greatest(ceil(w), ceil(h)) END AS eh FROM annots WHERE x IS NOT NULL)""")
def infer_target_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir).annots.where("x is not null").withColumn("m", F.when(F.col("id") % 2 == 0, "extent").otherwise("square"))
    eh, ew = g.window_extent(F.col("m"), F.col("w"), F.col("h"))
    (x0, x1), (y0, y1) = g.centred_slice(F.col("x") + F.col("w") / 2, ew), g.centred_slice(F.col("y") + F.col("h") / 2, eh)
    return rows.select("id", "m", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))


from . import decisions, pixels, rasters, samples, selection, stored, wide  # noqa: E402,F401  they register their own queries
from . import files, requests  # noqa: E402,F401  isort: skip
