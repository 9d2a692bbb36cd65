import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tesselar.functions import geometry as g
from tesselar.operators import hierarchy, overlap
from tesselar.plans import catalog
from tesselar.sources.annotations import load_json


def _rounded(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "part", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = catalog.QUERIES[name](spark, sf_dir)
    names = sorted(found.columns)
    got = [tuple(r) for r in found.select(*names).collect()]
    assert _rounded(got) == _rounded(con.sql(catalog.SQL[name]).select(*[duckdb.ColumnExpression(n) for n in names]).fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).columns[0] == "image_id"


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_centred_slices(spark):
    for centre, extent, want in ((2, 6, (-1, 5)), (5, 6, (2, 8)), (2, 64, (-30, 34)), (500.5, 100, (450, 550)), (974.9999999999999, 100, (924, 1024))):
        assert one(spark, *g.centred_slice(F.lit(float(centre)), F.lit(extent))) == want


def test_slices(spark):
    assert one(spark, *g.embed(F.lit(-10), F.lit(700), F.lit(600))) == (0, 600, 10, 100)
    assert one(spark, *g.rectify(F.lit(None).cast("int"), F.lit(-5), F.lit(100))) == (0, 95)


def test_windows(spark):
    assert one(spark, g.window_starts(F.lit(500), 224, 0.0), g.window_starts(F.lit(100), 224, 0.0)) == ([0, 224, 276], [0])


def test_windows_around_a_place(spark):
    for size in (1, 2, 3, 7, 10):
        for window, overlap in ((2, 0.0), (3, 0.5), (4, 0.75), (5, 0.0)):
            starts = one(spark, g.window_starts(F.lit(size), window, overlap))[0]
            for place in range(size):
                assert sorted(one(spark, g.starts_around(F.lit(place), F.lit(size), window, overlap))[0]) == [s for s in starts if s <= place < s + window]


def test_union_area(spark):
    r = random.Random(4)
    lists = [[(0, 0, 4, 4), (2, 2, 6, 6)], [(0, 0, 1, 1), (5, 5, 6, 7)], [], [(1, 1, 1, 5)]]
    for _ in range(60):
        corners = [(r.randrange(9), r.randrange(9)) for _ in range(r.randrange(1, 12))]
        lists.append([(x, y, x + r.randrange(5), y + r.randrange(5)) for x, y in corners])
    rows = [(i, [tuple(map(float, b)) for b in boxes]) for i, boxes in enumerate(lists)]
    df = spark.createDataFrame(rows, "k int, boxes array<struct<x1: double, y1: double, x2: double, y2: double>>")
    want = [len({(x, y) for a, b, c, d in boxes for x in range(a, c) for y in range(b, d)}) for boxes in lists]
    assert [row[1] for row in df.select("k", overlap.union_area(F.col("boxes"))).orderBy("k").collect()] == want


def test_tree_facts(spark):
    tree = hierarchy.Tree((None, None, 1, 1, 2, 2, None))
    row = spark.range(1).select(F.array(*[F.lit(float(v)) for v in (0.3, -1, 2, 0.5, 1, 1, 0)]).alias("e"))
    for f in (hierarchy.source_log_softmax, hierarchy.sink_log_softmax):
        p = [math.exp(v) for v in row.select(*f(F.col("e"), tree)).first()]
        assert math.isclose(p[1], p[2] + p[3]) and math.isclose(p[2], p[4] + p[5]) and math.isclose(p[0] + p[1] + p[6], 1)
    with pytest.raises(ValueError):
        hierarchy.Tree((1, 0))
    with pytest.raises(ValueError):
        hierarchy.decision([F.lit(1.0)], hierarchy.Tree((None,)), ignore=frozenset({0}))


def test_load_json(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"images": [{"id": 1, "file_name": "a", "width": 9, "height": 8}], "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 2, "name": "x"}]}))
    d = load_json(spark, str(path))
    assert tuple(d.annots.first()) == (5, 1, 2, 1.0, 2.0, 3.0, 4.0) and d.videos.count() == 0
