import pytest
from pyspark.sql import functions as F

from snaptable.errors import BadRequest
from snaptable.operators import diff

REFS = "collection string, id string, hash string"


def refs(spark, *rows):
    return spark.createDataFrame([r.split("/") for r in rows], REFS) if rows else spark.createDataFrame([], REFS)


def seen(changes):
    return [(r.collection, r.id, r.change) for r in diff.listed(changes).collect()]


def test_added_removed_modified(spark):
    old, new = refs(spark, "c/a/h-a", "c/b/h-b", "c/c/h-c"), refs(spark, "c/a/h-a", "c/b/h-b-new", "c/d/h-d")
    assert seen(diff.diff(old, new)) == [("c", "d", "added"), ("c", "b", "modified"), ("c", "c", "removed")]


def test_identical_is_empty(spark):
    own = refs(spark, "c/a/h")
    assert diff.is_empty(diff.diff(own, own)) and diff.summary(diff.diff(own, own)).count() == 0


def test_one_side_only(spark):
    changes = diff.diff(refs(spark, "old/a/h"), refs(spark, "new/a/h"))
    assert [tuple(r) for r in diff.summary(changes).collect()] == [("new", 1, 0, 0), ("old", 0, 0, 1)]


def test_many_refs(spark):
    from pyspark.sql import functions as F

    ids = spark.range(15_000).select(F.lit("c").alias("collection"), F.format_string("id%06d", "id").alias("id"), F.lit("h").alias("hash"), F.col("id").alias("i"))
    new = ids.filter("i % 7 <> 0").withColumn("hash", F.when(F.col("i") % 5 == 0, "x").otherwise("h"))
    changes = diff.diff(ids, new)
    want = (0, sum(i % 7 > 0 and i % 5 == 0 for i in range(15_000)), sum(i % 7 == 0 for i in range(15_000)))
    assert tuple(diff.summary(changes).first())[1:] == want
    assert diff.page(changes, "c", "removed", 0, 0).count() == 500
    assert diff.page_total(changes, "c", "removed").first().total == want[2]
    page = diff.page(changes, "c", "removed", -4, 501)
    assert page.first().id == "id000000" and page.count() == 500
    assert diff.page(changes, "c", "removed", 10**6, 10).count() == 0
    with pytest.raises(BadRequest):
        diff.page(changes, "c", "renamed")


def test_constant_names_that_differ_keep_a_key_to_join_by(spark):
    old, new = (spark.range(3).select(F.lit(c).alias("collection"), F.concat(F.lit("k"), "id").alias("id"), F.lit("h").alias("hash")) for c in ("old", "new"))
    changes = diff.diff(old, new)
    assert "NestedLoop" not in changes._jdf.queryExecution().executedPlan().toString()
    assert sorted(seen(changes)) == [("new", f"k{i}", "added") for i in range(3)] + [("old", f"k{i}", "removed") for i in range(3)]
