"""Stages of the pipeline on rows with null and repeated ids."""

import corpus_pipeline as c

CLEAN = " ".join(f"word{i}" for i in range(60))
OTHER = " ".join(f"other{i}" for i in range(60))
COLUMNS = "doc_id long, text string, lang string, source string"


def test_keep_quality_judges_rows(spark, sf_dir):
    rows = [(None, "junk", "en", "a"), (None, CLEAN, "en", "a"), (-7, "junk", "en", "a"), (-7, OTHER, "en", "a"), (-7, OTHER, None, "b"), (-8, None, "en", "a")]
    got = c.keep_quality(spark, spark.createDataFrame(rows, COLUMNS), sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == sorted([r for r in rows if r[1] in (CLEAN, OTHER)], key=str)


def test_keep_one_of_each_group(spark, sf_dir):
    near = [CLEAN + " more", CLEAN + " other end", CLEAN]
    rows = [(None, near[0], "en", "a"), (None, near[1], "en", "b"), (3, near[2], "en", "c")]  # one group, null ids
    rows += [(4, OTHER, "en", "a"), (4, OTHER, "en", "b"), (4, OTHER + " more", "en", "c"), (5, OTHER, "de", "a")]  # one group, one id
    apart = [(4, "quite different words here", "en", "a"), (9, "", "en", "a"), (9, "", "en", "b"), (9, None, "en", "b"), (None, None, "en", "b")]
    got = sorted(map(tuple, c.keep_one(spark, spark.createDataFrame(rows + apart + apart, COLUMNS), sf_dir).collect()), key=str)
    assert [r for r in got if r in apart] == sorted(apart, key=str)
    rest = [r for r in got if r not in apart]
    assert len(rest) == 2 and {r[0] for r in rest} == {None, 4}


def test_clashing_columns_are_kept(spark, sf_dir):
    """Extra columns of any name come through each stage as they are; an empty table stays empty."""
    extra = ["__doc", "__twin", "__CUT", "__lines", "__stratum", "twin", "doc", "first", "group"]
    lines = "\n".join([CLEAN, "one boilerplate line here", OTHER])
    rows = [(i, f"site{i} " + lines, "en", f"s{i}", *[f"{c}{i}" for c in extra]) for i in range(8)]
    docs = spark.createDataFrame(rows, COLUMNS + "".join(f", `{c}` string" for c in extra))
    for name, step in c.STAGES[:-1]:
        got = step(spark, docs, sf_dir)
        assert got.columns == docs.columns and step(spark, docs.limit(0), sf_dir).count() == 0
        for r in got.collect():
            assert r[4:] == rows[r["doc_id"]][4:], name
    assert {r["text"].count("boilerplate") for r in c.cut_lines(spark, docs, sf_dir).where("doc_id > 0").collect()} == {0}
