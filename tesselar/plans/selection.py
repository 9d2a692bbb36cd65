"""Queries on pools, negatives, spread positives, folds and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, samples, sampling, selection, targets
from ..sources.annotations import PRELUDE, derived
from ..sources.staging import staged
from .catalog import BOXES_SQL, MET, SHARED, hash_sql
from .registry import SQL, registered

TARGETS_SQL = """,
tg AS (SELECT a.id AS aid, image_id AS gid, category_id, (x + w / 2)::FLOAT AS cx, (y + h / 2)::FLOAT AS cy, w::FLOAT AS width, h::FLOAT AS height FROM annots a JOIN images i ON a.image_id = i.id WHERE x IS NOT NULL)"""


def relative_sql(num: int, thresh: float) -> str:
    hits = f"{SHARED} / (a_area + 1e-6) >= {thresh}" if thresh else "TRUE"
    return BOXES_SQL + f""",
an AS (SELECT w / least(i.width, i.height) AS aw, h / least(i.width, i.height) AS ah, row_number() OVER (ORDER BY {hash_sql('a.id', 0)}, a.id) - 1 AS at_ FROM annots a JOIN images i ON a.image_id = i.id WHERE x IS NOT NULL QUALIFY at_ < 1000),
cd AS (SELECT id * 10 + t AS cand, id AS image_id, width, height FROM images, (VALUES (0), (1)) AS v(t)),
sz AS (SELECT cand, image_id, width, height, least(greatest(floor(aw * least(width, height)), 1), width)::BIGINT AS bw, least(greatest(floor(ah * least(width, height)), 1), height)::BIGINT AS bh FROM cd JOIN an ON at_ = {hash_sql('cand', 4)} % (SELECT count(*) FROM an)),
wd AS (SELECT cand, image_id, ({hash_sql('cand', 1)} % (width - bw + 1))::DOUBLE AS x1, ({hash_sql('cand', 2)} % (height - bh + 1))::DOUBLE AS y1, bw, bh FROM sz),
we AS (SELECT cand, image_id, x1, y1, x1 + bw AS x2, y1 + bh AS y2 FROM wd),
ng AS (SELECT * FROM we w WHERE NOT EXISTS (SELECT 1 FROM b WHERE {MET} AND {hits}) ORDER BY {hash_sql('cand', 3)}, cand LIMIT {num})"""


def _negatives(d, num: int, thresh: float) -> DataFrame:
    return selection.relative_negatives(d, sampling.negative_anchors(sampling.targets(d)), num, thresh)


@registered("random_negatives_rel", PRELUDE + relative_sql(400, 0.3) + " SELECT * FROM ng")
def random_negatives_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _negatives(derived(spark, sf_dir), 400, 0.3)


POOL_SQL = PRELUDE + relative_sql(300, 0.3) + TARGETS_SQL + """,
pool AS (SELECT row_number() OVER (ORDER BY aid) - 1 AS ordinal, TRUE AS is_positive, * FROM tg UNION ALL
  SELECT (SELECT count(*) FROM tg) + row_number() OVER (ORDER BY cand) - 1, FALSE, -1, image_id, 0, ((x1 + x2) / 2)::FLOAT, ((y1 + y2) / 2)::FLOAT, (x2 - x1)::FLOAT, (y2 - y1)::FLOAT FROM ng)"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir)
    return selection.item_pool(sampling.targets(d), _negatives(d, 300, 0.3))


@registered("preselect_pool", POOL_SQL + " SELECT * FROM pool")
def preselect_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir)


@registered("item_by_index", POOL_SQL + " SELECT ordinal, is_positive, aid, gid, cx, cy FROM pool WHERE ordinal % 97 = 0")
def item_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = staged(_pool(spark, sf_dir), "pool")
    wanted = spark.range(0, pool.count(), 97).withColumnRenamed("id", "ordinal")
    return selection.items_at(pool, wanted).select("ordinal", "is_positive", "aid", "gid", "cx", "cy")


@registered("nms_positives", PRELUDE.replace("WITH ", "WITH RECURSIVE ", 1) + TARGETS_SQL + f""",
sc AS (SELECT aid, gid, cx::DOUBLE AS x, cy::DOUBLE AS y, row_number() OVER (PARTITION BY gid ORDER BY {hash_sql('aid', 5)}, aid) AS nth FROM tg),
gr AS (SELECT gid, nth, [{{'aid': aid, 'x': x, 'y': y}}] AS kept FROM sc WHERE nth = 1 UNION ALL
  SELECT s.gid, s.nth, CASE WHEN len(list_filter(kept, lambda q: greatest(96 - abs(q.x - s.x), 0) * greatest(64 - abs(q.y - s.y), 0) / (12288 - greatest(96 - abs(q.x - s.x), 0) * greatest(64 - abs(q.y - s.y), 0)) > 0.1)) > 0
    THEN kept ELSE list_append(kept, {{'aid': s.aid, 'x': s.x, 'y': s.y}}) END FROM gr JOIN sc s ON s.gid = gr.gid AND s.nth = gr.nth + 1)
SELECT unnest(kept).aid AS aid, gid FROM gr WHERE (gid, nth) IN (SELECT gid, max(nth) FROM sc GROUP BY gid)""")
def nms_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.spread_positives(sampling.targets(derived(spark, sf_dir)), (64, 96), 0.1)


@registered("nms_positives_rounds", SQL["nms_positives"])
def nms_positives_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every image taken as a crowded one."""
    return selection.spread_positives(sampling.targets(derived(spark, sf_dir)), (64, 96), 0.1, crowded=0)


#: Classes that the derived annotations can have.
CLASSES = 7


def folds_sql(name: str, annots: str, k: int, seed: int) -> str:
    """CTEs that end in `name` (image_id, fold): a round for each class, the rarest one first."""
    n = lambda x: f"{name}_{x}"
    parts = [
        f"{n('pair')} AS (SELECT DISTINCT image_id, category_id FROM {annots} WHERE category_id IS NOT NULL)",
        f"{n('freq')} AS (SELECT category_id, row_number() OVER (ORDER BY count(*), category_id) - 1 AS r FROM {n('pair')} GROUP BY 1)",
        f"{n('has')} AS MATERIALIZED (SELECT image_id, r FROM {n('pair')} JOIN {n('freq')} USING (category_id))",
        f"{n('pl')} AS MATERIALIZED (SELECT image_id, key, row_number() OVER (PARTITION BY key ORDER BY {hash_sql('image_id', seed + 6)}, image_id) AS place FROM (SELECT image_id, min(r) AS key FROM {n('has')} GROUP BY 1))",
        f"{n('to')} AS (SELECT NULL::BIGINT AS image_id, NULL::INT AS fold WHERE FALSE)",
    ]
    for r in range(CLASSES):
        last = n("to") if r == 0 else n(f"d{r - 1}")
        parts.append(f"""{n(f'have{r}')} AS (SELECT f, count(h.image_id) AS a FROM (SELECT unnest(range({k})) AS f) LEFT JOIN {last} d ON d.fold = f LEFT JOIN {n('has')} h ON h.image_id = d.image_id AND h.r = {r} GROUP BY f),
{n(f'slot{r}')} AS (SELECT f, row_number() OVER (ORDER BY a + j, f) AS place FROM (SELECT f, a, unnest(range((SELECT count(*) FROM {n('pl')} WHERE key = {r}))) AS j FROM {n(f'have{r}')})),
{name if r == CLASSES - 1 else n(f'd{r}')} AS MATERIALIZED (SELECT * FROM {last} UNION ALL SELECT image_id, f::INT FROM {n('pl')} JOIN {n(f'slot{r}')} USING (place) WHERE key = {r})""")
    return ",\n" + ",\n".join(parts)


@registered("stratified_group_kfold", PRELUDE + folds_sql("fo", "annots", 3, 0) + " SELECT * FROM fo")
def stratified_group_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds as they are dealt, before any image changes its fold."""
    return folds.stratified_folds(derived(spark, sf_dir).annots, swing=0)


@registered("balanced_group_kfold")
def balanced_group_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.stratified_folds(derived(spark, sf_dir).annots, 5)


@registered("greedy_group_kfold", PRELUDE.replace("WITH ", "WITH RECURSIVE ", 1) + """,
an AS (SELECT i.video_id, a.image_id, a.category_id FROM annots a JOIN images i ON i.id = a.image_id WHERE a.category_id IS NOT NULL),
cs AS (SELECT video_id, list(category_id ORDER BY category_id) AS classes FROM (SELECT DISTINCT video_id, category_id FROM an) GROUP BY 1),
cn AS (SELECT video_id, image_id, category_id, count(*)::DOUBLE AS n FROM an GROUP BY ALL),
vc AS (SELECT g.video_id, g.image_id, size, list(coalesce(cn.n, 0) ORDER BY c) AS v FROM (SELECT video_id, image_id, sum(n) AS size FROM cn GROUP BY ALL) g JOIN (SELECT video_id, unnest(classes) AS c FROM cs) u ON u.video_id = g.video_id
  LEFT JOIN cn ON cn.video_id = g.video_id AND cn.image_id = g.image_id AND cn.category_id = c GROUP BY ALL),
od AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY size DESC, image_id DESC) AS nth FROM vc),
tg AS MATERIALIZED (SELECT video_id, list(n / t ORDER BY category_id) AS target, list(0::DOUBLE ORDER BY category_id) AS zero FROM (SELECT video_id, category_id, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY video_id) AS t FROM cn GROUP BY 1, 2) GROUP BY 1),
gr AS (SELECT video_id, 0::BIGINT AS nth, NULL::BIGINT AS image_id, NULL::INT AS fold, [zero, zero, zero] AS freq, list_transform([1, 2, 3], lambda f: list_sum(list_transform(target, lambda t: t * t))) AS far FROM tg UNION ALL
  SELECT video_id, nth, image_id, fold, list_transform([1, 2, 3], lambda f: CASE WHEN f = fold + 1 THEN cand[f] ELSE freq[f] END), list_transform([1, 2, 3], lambda f: CASE WHEN f = fold + 1 THEN cfar[f] ELSE far[f] END) FROM (
    SELECT *, list_position(losses, list_min(losses)) - 1 AS fold FROM (
      SELECT *, list_transform([1, 2, 3], lambda f: round(list_sum(far) - far[f] + cfar[f] + CASE WHEN list_sum(flatten(freq)) > 0 THEN list_sum(freq[f]) / list_sum(flatten(freq)) ELSE 0 END, 10)) AS losses FROM (
        SELECT *, list_transform(cand, lambda c: list_sum(list_transform(list_zip(c, target), lambda p: (p[1] / list_sum(c) - p[2]) * (p[1] / list_sum(c) - p[2])))) AS cfar FROM (
          SELECT o.video_id, o.nth, o.image_id, target, freq, far, list_transform(freq, lambda f: list_transform(list_zip(f, o.v), lambda p: p[1] + p[2])) AS cand
          FROM gr JOIN od o ON o.video_id = gr.video_id AND o.nth = gr.nth + 1 JOIN tg ON tg.video_id = o.video_id)))))
SELECT video_id, image_id, fold::INT AS fold FROM gr WHERE nth > 0""")
def greedy_group_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each video's frames in folds of their own."""
    d = derived(spark, sf_dir)
    rows = d.annots.join(d.images.select(F.col("id").alias("image_id"), "video_id"), "image_id")
    return folds.greedy_folds(rows, 3, scope="video_id")


SPLIT_SQL = PRELUDE + folds_sql("f1", "annots", 3, 0) + """,
rest AS (SELECT * FROM annots WHERE image_id IN (SELECT image_id FROM f1 WHERE fold > 0))""" + folds_sql("f2", "rest", 3, 1) + """,
sp AS (SELECT image_id, 'test' AS split FROM f1 WHERE fold = 0 UNION ALL SELECT image_id, CASE WHEN fold = 0 THEN 'vali' ELSE 'train' END FROM f2)"""


@registered("train_vali_test_split", SPLIT_SQL + " SELECT * FROM sp")
def train_vali_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.split_images(derived(spark, sf_dir).annots, swing=0)


@registered("split_disjoint", SPLIT_SQL + " SELECT split, count(*) AS n_images, count(DISTINCT image_id) AS n_distinct, count(*) FILTER (image_id IN (SELECT o.image_id FROM sp o GROUP BY 1 HAVING count(DISTINCT o.split) > 1)) AS n_shared FROM sp GROUP BY split")
def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folds.split_images(derived(spark, sf_dir).annots, swing=0)
    shared = rows.groupBy("image_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1")
    return rows.join(shared, "image_id", "left").groupBy("split").agg(F.count("*").alias("n_images"), F.count_distinct("image_id").alias("n_distinct"), F.count("splits").alias("n_shared"))


@registered("split_no_test", SPLIT_SQL + " SELECT s.image_id, s.split = 'test' AS was_test, count(a.id) AS n_annots FROM sp s LEFT JOIN annots a ON a.image_id = s.image_id WHERE s.split <> 'vali' GROUP BY ALL")
def split_no_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir)
    rows = folds.split_images(d.annots, swing=0)
    train = rows.where("split = 'train'").unionAll(rows.where("split = 'test'"))
    part = d.subset(train.select(F.col("image_id").alias("id")))
    counts = part.annots.groupBy("image_id").agg(F.count("*").alias("n_annots"))
    return train.join(counts, "image_id", "left").select("image_id", (F.col("split") == "test").alias("was_test"), F.coalesce("n_annots", F.lit(0).cast("long")).alias("n_annots"))


@registered("class_ratio", PRELUDE + " SELECT category_id, count(*) AS n, round(count(*) / (SELECT count(*) FROM annots), 9) AS ratio FROM annots GROUP BY 1")
def class_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    annots = derived(spark, sf_dir).annots
    counts = annots.groupBy("category_id").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("category_id", "n", F.round(F.col("n") / F.col("total"), 9).alias("ratio"))


@registered("toy_samples", f"""WITH i AS (SELECT i AS index, unnest(range({hash_sql('i', 0)} % 4 + 1)) AS k FROM (SELECT o_orderkey AS i FROM orders)),
r AS (SELECT index, k, index * 4 + k AS q FROM i),
s AS (SELECT index, k, {hash_sql('q', 1)} % 3 + 1 AS category_id, {hash_sql('q', 2)} % 208 + 8 AS w, {hash_sql('q', 3)} % 208 + 8 AS h, {hash_sql('q', 4)} AS rx, {hash_sql('q', 5)} AS ry FROM r)
SELECT index, k, category_id, rx % (416 - w) AS x, ry % (416 - h) AS y, w, h FROM s""")
def toy_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up stand-in for every image of the dataset."""
    return selection.toy_samples(derived(spark, sf_dir).images.select(F.col("id").alias("index")))


ITEMS_SQL = POOL_SQL + """,
ct AS MATERIALIZED (SELECT count(*) AS n, count(*) FILTER (is_positive) AS n_pos FROM pool),
wn AS (SELECT k AS target_id, k * 89 - 1000 AS k FROM range(((SELECT n FROM ct) * 2 // 89)::BIGINT) t(k)),
it AS (SELECT target_id, is_positive, aid, gid, CASE WHEN target_id % 3 = 0 THEN 5 ELSE category_id END::BIGINT AS category_id, CASE WHEN target_id % 4 = 0 THEN 100.5 ELSE cx::DOUBLE END AS cx, cy::DOUBLE AS cy,
  CASE WHEN target_id % 2 = 0 THEN 60 ELSE ceil(width::DOUBLE) END AS ww, CASE WHEN target_id % 2 = 0 THEN 40 ELSE ceil(height::DOUBLE) END AS wh, CASE WHEN target_id % 5 = 0 THEN 7 ELSE 0 END AS pad
  FROM wn JOIN pool ON ordinal = ((k % (SELECT n FROM ct)) + (SELECT n FROM ct)) % (SELECT n FROM ct)),
sl AS (SELECT *, floor(cx - ww / 2) AS x0, floor(cy - wh / 2) AS y0 FROM it),
hits AS (SELECT target_id, count(*) AS n FROM sl s JOIN annots a ON a.image_id = s.gid AND x IS NOT NULL AND x + w >= x0 - pad AND x <= x0 + ww + pad AND y + h >= y0 - pad AND y <= y0 + wh + pad GROUP BY 1)
SELECT s.target_id, aid, gid, category_id, x0::BIGINT AS x0, (x0 + ww)::BIGINT AS x1, y0::BIGINT AS y0, (y0 + wh)::BIGINT AS y1, pad AS pad_x, coalesce(n, 0)::INT AS n_annots FROM sl s LEFT JOIN hits h ON h.target_id = s.target_id"""


@registered("load_items", ITEMS_SQL)
def load_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a pool by ordinals that go round it, with windows, centres, classes and padding of one's own for some."""
    d, pool = derived(spark, sf_dir), staged(_pool(spark, sf_dir), "pool")
    t = F.col("target_id")
    wanted = spark.range(pool.count() * 2 // 89).select(F.col("id").alias("target_id"), (F.col("id") * 89 - 1000).alias("ordinal"))
    wanted = wanted.withColumns({"category_id": F.when(t % 3 == 0, 5), "cx": F.when(t % 4 == 0, 100.5), "window": F.when(t % 2 == 0, "40,60"), "pad_x": F.when(t % 5 == 0, 7), "pad_y": F.when(t % 5 == 0, 7)})
    rows = samples.load_samples(targets.resolve(selection.item_targets(pool, wanted), d), d)
    return rows.select("target_id", F.coalesce("aid", F.lit(-1)).alias("aid"), "gid", "category_id", "x0", "x1", "y0", "y1", "pad_x", F.coalesce(F.size("annots"), F.lit(0)).alias("n_annots"))


@registered("preselect_ratio", PRELUDE + relative_sql(125, 0.3) + TARGETS_SQL + f""",
ps AS (SELECT * FROM tg ORDER BY {hash_sql('aid', 7)}, aid LIMIT 250)
SELECT row_number() OVER (ORDER BY aid) - 1 AS ordinal, TRUE AS is_positive, aid, gid FROM ps UNION ALL SELECT 250 + row_number() OVER (ORDER BY cand) - 1, FALSE, -1, image_id FROM ng""")
def preselect_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of 250 positives and half as many negatives."""
    d = derived(spark, sf_dir)
    pool = selection.preselect(sampling.targets(d), lambda n: _negatives(d, n, 0.3), n_pos=250, ratio=0.5)
    return pool.select("ordinal", "is_positive", "aid", "gid")


@registered("free_corners", PRELUDE + BOXES_SQL + """,
big AS (SELECT id AS image_id, width - 120 AS mx, height - 90 AS my FROM images WHERE width >= 120 AND height >= 90),
xs AS (SELECT image_id, 0 AS x FROM big UNION SELECT image_id, floor(ax2)::BIGINT + 1 FROM b), ys AS (SELECT image_id, 0 AS y FROM big UNION SELECT image_id, floor(ay2)::BIGINT + 1 FROM b)
SELECT image_id, x::DOUBLE AS x1, min(y)::DOUBLE AS y1 FROM big JOIN xs USING (image_id) JOIN ys USING (image_id) WHERE x <= mx AND y <= my
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.image_id = big.image_id AND ax2 >= x AND ax1 <= x + 120 AND ay2 >= y AND ay1 <= y + 90) GROUP BY image_id, x""")
def free_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.free_corners(derived(spark, sf_dir), (120, 90))
