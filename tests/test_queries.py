"""Every registered query of the core against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from tarnloom.functions.spread import ranked, salted_join
from tarnloom.plans import samples
from tests.conftest import DATA


@pytest.fixture(scope="module")
def con():
    own = duckdb.connect()
    for f in os.listdir(DATA):
        own.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return own


@pytest.mark.parametrize("name", list(samples.SQL))
def test_query_equals_sql(spark, con, name):
    df = samples.QUERIES[name](spark, DATA)
    tidy = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    got = Counter(tidy(r) for r in df.collect())
    cursor = con.execute(samples.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tidy(r[columns.index(c)] for c in df.columns) for r in cursor.fetchall())
    assert got == want


def test_every_integrity_check_comes_out(spark, monkeypatch):
    from tarnloom.plans import checks
    from tests.world import world

    own = world(spark)
    own.tables["images"] = own.tables["images"].selectExpr("id", "if(id = 7, 99, image_batch_id) AS image_batch_id", "file_name", "height", "width", "blake3_hash", "license_id", "date_captured")
    own.tables["cls_annotations"] = own.tables["cls_annotations"].selectExpr("id", "annotation_batch_id", "image_id", "if(id = 1, 5, category_id) AS category_id", "score", "annotator_id")
    own.tables["image_lineage"] = own.tables["image_lineage"].union(spark.createDataFrame([(6, 1)], "a long, b long"))
    monkeypatch.setattr(samples, "catalog", lambda *_: own)
    got = dict(map(tuple, samples.QUERIES["integrity_checks_all"](spark, "").collect()))
    assert sorted(got) == list(range(1, 13)) and got == {r["seq"]: r["violations"] for r in checks.source_checks(own).collect()}
    assert got[4] == 1 and got[6] == 1 and got[12] > 0


def test_the_whole_pipeline_reads_every_image_batch(con):
    read = {(s["original_set"], s["image_batch"]) for s in samples.PIPELINE_ALL.steps if s.op == "source"}
    assert read == set(con.execute("SELECT DISTINCT original_set_name, version FROM batches WHERE batch_kind = 'image'").fetchall())


def test_salted_join_and_ranks_lose_nothing(spark):
    left = spark.range(5).withColumnRenamed("id", "k")
    right = spark.range(100).selectExpr("if(id < 60, 1, id % 5) AS k", "id AS v")
    hot = right.groupBy("k").count().withColumnRenamed("count", "n")
    for block in (7, 1000):
        got = sorted(map(tuple, salted_join(left, right, ["k"], hot, block).collect()))
        assert got == sorted(map(tuple, left.join(right, "k").collect()))
    # tables of cuts go when they are released
    from tarnloom.functions import spread

    known = dict(spread._made)
    spread._made.clear()
    path = spread.cut(left, "gone").inputFiles()[0].removeprefix("file://")
    spread.release()
    assert not os.path.exists(path)
    spread._made.update(known)
    for few in (True, False):
        original, spread.small = spread.small, (spread.small if few else lambda df, *_: df)
        assert sorted((r["k"], r["v"]) for r in spread.lookup(left.where("k > 0"), right, ["k"], 7).collect()) == sorted((r["k"], r["v"]) for r in right.where("k > 0").collect())
        spread.small = original
    # hot on both sides
    many = right.selectExpr("k", "v AS w")
    both = right.groupBy("k").count().selectExpr("k", "count AS n", "count AS m")
    want = sorted(map(tuple, many.join(right, "k").collect()))
    assert sorted(map(tuple, salted_join(many, right, ["k"], both, 9).collect())) == want
    place = {}
    for r in ranked(right, "k", ["v"], "place").orderBy("k", "v").collect():
        assert r["place"] == place.get(r["k"], 0)
        place[r["k"]] = r["place"] + 1
