import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaptable.functions.canon import canonical, decoded, encoded, id_key, relaxed
from snaptable.functions.columns import mask_credentials, tag_append


def texts(df, key=("_id",)):
    return {r["id"]: (r["hash"], r["canonical"]) for r in encoded(df, list(key)).collect()}


def test_text_is_stable_and_typed(spark):
    df = spark.createDataFrame([(1, "widget", 3)], "_id int, name string, qty bigint")
    text = '{"_id":{"$numberInt":"1"},"name":"widget","qty":{"$numberLong":"3"}}'
    assert df.select(canonical(df)).first()[0] == text
    assert texts(df) == texts(df)


def test_content_order_and_type_change_the_hash(spark):
    base = spark.createDataFrame([(1, "a")], "_id int, name string")
    others = [spark.createDataFrame([(1, "b")], "_id int, name string"), base.select("name", "_id"), base.withColumn("_id", F.col("_id").cast("long"))]
    own = encoded(base, ["_id"]).first()["hash"]
    assert all(encoded(o, ["_id"]).first()["hash"] != own for o in others)


def test_keys(spark):
    oid = spark.createDataFrame([(("65f0c0ffee",),)], "_id struct<`$oid`:string>")
    assert oid.select(id_key(oid, ["_id"])).first()[0] == "oid:65f0c0ffee"
    for kind, text in (("int", '{"_id":{"$numberInt":"1"}}'), ("bigint", '{"_id":{"$numberLong":"1"}}'), ("string", '{"_id":"1"}')):
        df = spark.sql(f"select cast(1 as {kind}) as _id")
        assert df.select(id_key(df, ["_id"])).first()[0] == text
    df = spark.createDataFrame([(None, 1)], "_id int, x int")
    with pytest.raises(Exception, match="no key"):
        df.select(id_key(df, ["_id"])).collect()
    with pytest.raises(Exception, match="no such key"):
        id_key(df, ["gone"])


def test_round_trip_of_every_type(spark):
    schema = T.StructType.fromDDL("i smallint, l bigint, d double, f float, n decimal(20,4), t timestamp, u timestamp_ntz, day date, b binary, s string, ok boolean, st struct<a:int,b:string>, ar array<double>, m map<string,int>, deep array<struct<x:timestamp,y:array<string>>>")
    now = dt.datetime(2024, 5, 6, 7, 8, 9, 123456)
    rows = [
        (1, 2**60, 1e300, 1.5, Decimal("12.3400"), now, now, now.date(), b"\0\xff", 'q"\n\\é😀<>&/', True, (1, None), [1.0, None, float("inf")], {"b": 1, "a": 2}, [(now, ["x", None]), (None, [])]),
        (None,) * 15,
        (0, 0, -0.0, 0.0, Decimal("0"), now, now, now.date(), b"", "", False, (None, None), [], {}, []),
    ]
    df = spark.createDataFrame(rows, schema)
    back = decoded(df.select(canonical(df).alias("canonical")), schema)
    assert back.schema.simpleString() == schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    nan = spark.createDataFrame([(float("nan"),)], "x double")
    assert str(decoded(nan.select(canonical(nan).alias("canonical")), nan.schema).first().x) == "nan"
    text = df.select(canonical(df)).first()[0]
    assert text.index('"a":{"$numberInt":"2"}') < text.index('"b":{"$numberInt":"1"}')


def test_relaxed_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert '"b" : null' in df.select(relaxed(df)).first()[0]


def test_mask_and_tags(spark):
    rows = [("a://u:secret@h/x", "a://u:****@h/x"), ("a://u@h", "a://u@h"), ("plain", "plain"), ("a://h/?q=b:c@d", "a://h/?q=b:c@d")]
    df = spark.createDataFrame(rows, "url string, want string")
    assert df.filter(~mask_credentials(F.col("url")).eqNullSafe(F.col("want"))).count() == 0
    tags = spark.createDataFrame([(["a"],), (None,), (["t"],)], "tags array<string>").select(tag_append(F.col("tags"), F.lit("t")).alias("tags"))
    assert sorted(r.tags for r in tags.collect()) == [["a", "t"], ["t"], ["t"]]


def test_zone_less_timestamps_do_not_follow_the_session(spark):
    """Hours that a zone skips or repeats, times before 1970 and micros; hashes and values are the same in every zone."""
    texts = ["2024-03-31 02:30:00.000001", "2024-10-27 02:30:00", "1969-12-31 23:59:59.999999", "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"]
    own = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    found, was = [], spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            coded = encoded(own, ["k"])
            found.append([(r.hash, r.canonical) for r in coded.orderBy("id").collect()])
            assert own.exceptAll(decoded(coded, own.schema)).isEmpty()
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert found[0] == found[1] == found[2]
    assert '"-1"' in found[0][2][1] and f'"{1711852200 * 10**6 + 1}"' in found[0][0][1]
