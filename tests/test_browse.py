import json
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from snaptable.errors import BadRequest
from snaptable.operators import browse
from snaptable.operators.pages import Pages

ROWS = [(1, "a", 5.0, ("x",)), (2, "b", None, ("y",)), (3, None, 7.0, None)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "k int, s string, d double, n struct<t:string>")


@pytest.mark.parametrize(
    ("document", "want"),
    [
        ("", [1, 2, 3]), ("{}", [1, 2, 3]), ('{"s": "a"}', [1]), ('{"s": null}', [3]), ('{"s": {"$ne": "a"}}', [2, 3]), ('{"d": {"$gt": 5, "$lte": 7}}', [3]), ('{"d": {"$gte": 5}}', [1, 3]),
        ('{"k": {"$lt": 2}}', [1]), ('{"s": {"$in": ["a", null]}}', [1, 3]), ('{"s": {"$in": []}}', []), ('{"s": {"$nin": ["a"]}}', [2, 3]), ('{"d": {"$exists": false}}', [2]), ('{"n.t": "y"}', [2]),
        ('{"$or": [{"k": 1}, {"s": "b"}]}', [1, 2]), ('{"$and": [{"k": 1}, {"s": "b"}]}', []), ('{"$nor": [{"s": "a"}]}', [2, 3]), ('{"s": {"$not": {"$eq": "a"}}}', [2, 3]), ('{"s": {"$regex": "^[ab]"}}', [1, 2]), ('{"k": {"$gt": 1}, "s": "b"}', [2]),
    ],
)
def test_filters(df, document, want):
    assert sorted(r.k for r in df.filter(browse.where(df.schema, document)).collect()) == want


@pytest.mark.parametrize("document", ["{", "[1]", '{"gone": 1}', '{"k": {"$near": 1}}', '{"$xor": []}', '{"$or": []}', '{"k": {"$in": 1}}'])
def test_bad_filters(df, document):
    with pytest.raises(BadRequest):
        browse.where(df.schema, document)


def test_paging(spark, df):
    for limit, want in ((0, 50), (1, 1), (50, 50), (200, 200), (201, 50), (-3, 50)):
        assert browse.clamp(-1, limit) == (0, want)
    many = spark.range(300).selectExpr("cast(id as int) as k", "cast(id % 3 as int) as g")
    page = browse.find(many, ["k"], sort='{"g": -1}', skip=10, limit=5)
    assert [tuple(r) for r in page.collect()] == [(32 + 3 * i, 2) for i in range(5)]
    assert browse.find(many, ["k"], skip=1000).count() == 0
    assert browse.total(many, {"g": 1}).first().total == 100
    whole = browse.page(many, ["k"], {"g": 1}, '{"g": -1, "k": -1}', 2, 3).collect()
    assert [tuple(r) for r in whole] == [(298 - 3 * i, 1, 100) for i in range(2, 5)]
    assert [tuple(r) for r in browse.page(many, ["k"], skip=1000).collect()] == [(None, None, 300)] and browse.page(many.withColumnRenamed("g", "Total"), ["k"]).columns == ["k", "Total", "total_"]
    assert '"k" : 0' in browse.documents(many, ["k"], limit=1).first().document
    with pytest.raises(BadRequest):
        browse.sorting(df.schema, '{"k": 2}', ["k"])


TYPED = "k int, at timestamp_ntz, zoned timestamp, day date, dec decimal(9,2), f float, raw binary, b boolean, list array<int>, subs array<struct<a:int,b:string>>, s struct<a:int,b:string>, m map<string,bigint>, oid struct<`$oid`:string>"
AT = datetime(2024, 1, 2, 3, 4, 5, 678000)
OID = "5f" * 12


@pytest.fixture
def typed(spark):
    rows = [
        (1, AT, AT, date(2024, 1, 2), Decimal("1.50"), 0.5, b"\x00\xff", True, [1, 2], [(1, "x"), (2, None)], (1, "x"), {"a": 1}, (OID,)),
        (2, AT + timedelta(1), AT + timedelta(1), date(2024, 1, 3), Decimal("2.50"), float("nan"), b"a", False, [], [], (1, None), {"a": 2, "b": None}, ("00" * 12,)),
        (3, *[None] * 12),
    ]
    return spark.createDataFrame(rows, TYPED)


@pytest.mark.parametrize(
    ("document", "want"),
    [
        ({"at": {"$date": "2024-01-02T03:04:05.678Z"}}, [1]), ({"at": {"$gt": {"$date": {"$numberLong": "1704164645678"}}}}, [2]), ({"zoned": {"$lte": {"$date": 1704164645678}}}, [1]), ({"zoned": {"$date": "1704164645678000"}}, [1]), ({"day": {"$day": "2024-01-02"}}, [1]),
        ({"day": {"$date": "2024-01-03T00:00:00Z"}}, [2]), ({"day": {"$lt": {"$date": "2024-01-02T12:00:00Z"}}}, [1]), ({"dec": {"$numberDecimal": "1.5"}}, [1]), ({"dec": {"$gt": 1.5}}, [2]), ({"dec": {"$in": [{"$numberDecimal": "2.500"}, 7]}}, [2]), ({"f": {"$numberDouble": "NaN"}}, [2]),
        ({"f": {"$numberDouble": "0.5"}}, [1]), ({"raw": {"$binary": "AP8="}}, [1]), ({"raw": {"$binary": {"base64": "YQ==", "subType": "00"}}}, [2]), ({"b": True}, [1]), ({"b": {"$ne": True}}, [2, 3]), ({"k": {"$numberLong": "2"}}, [2]), ({"k": {"$lt": {"$numberLong": "5000000000"}}}, [1, 2, 3]),
        ({"k": "1"}, []), ({"k": {"$ne": "1"}}, [1, 2, 3]), ({"k": {"$gt": "0"}}, []), ({"k": True}, []), ({"at": "2024"}, []), ({"k": {"$in": ["1", 2]}}, [2]), ({"k": {"$nin": ["1", 2]}}, [1, 3]), ({"k": 10**30}, []), ({"k": {"$lt": 10**30}}, [1, 2, 3]),
        ({"list": 2}, [1]), ({"list": [1, 2]}, [1]), ({"list": [2, 1]}, []), ({"list": []}, [2]), ({"list": {"$gt": 1}}, [1]), ({"list": {"$ne": 2}}, [2, 3]), ({"list": {"$in": [2, 9]}}, [1]), ({"list": {"$nin": [2]}}, [2, 3]), ({"list": None}, [3]), ({"subs.a": 2}, [1]), ({"subs.b": None}, [1, 3]),
        ({"subs": {"a": 1, "b": "x"}}, [1]), ({"subs.b": {"$regex": "^X", "$options": "i"}}, [1]), ({"s": {"a": 1, "b": "x"}}, [1]), ({"s": {"b": "x", "a": 1}}, []), ({"s": {"a": 1}}, [2]), ({"s": {"a": 1, "b": None}}, [2]), ({"s": {"a": 1, "c": 2}}, []), ({"s": {"$ne": {"a": 1}}}, [1, 3]), ({"s": None}, [3]),
        ({"m.a": {"$gte": 2}}, [2]), ({"m": {"a": 1}}, [1]), ({"m": {"a": 2, "b": None}}, [2]), ({"oid": {"$oid": OID}}, [1]), ({"oid": {"$in": [{"$oid": OID}, None]}}, [1, 3]), ({"k": {"$gte": None}}, []), ({"f": {"$lte": None}}, [3]), ({"s.a": {"$not": {"$gt": 0}}}, [3]), ({"k": {"$regex": "1"}}, []),
    ],
)
def test_typed_values(typed, document, want):
    assert sorted(r.k for r in typed.filter(browse.where(typed.schema, json.dumps(document))).collect()) == want


@pytest.mark.parametrize(
    "document",
    [
        {"at": {"$date": "yesterday"}}, {"at": {"$gt": {"$date": None}}}, {"k": {"$numberLong": "x"}}, {"k": {"$numberInt": "2147483648"}}, {"dec": {"$numberDecimal": "a"}}, {"raw": {"$binary": "?"}}, {"oid": {"$in": [{"$oid": "xyz"}]}}, {"k": {"$numberLong": True}},
        {"s.b": {"$regex": "("}}, {"s.b": {"$regex": 5}}, {"s.b": {"$regex": "a", "$options": "q"}}, {"s": {"$gt": 1, "a": 1}}, {"k": {"$not": {"$near": 1}}}, {"s.z": 1}, {"list.a": 1}, {"at": {"$date": 10**18}},
    ],
)
def test_bad_values(typed, document):
    with pytest.raises(BadRequest):
        browse.where(typed.schema, json.dumps(document))


def test_typed_values_are_pushed_down(spark, typed, tmp_path):
    typed.write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    found = df.filter(browse.where(df.schema, {"at": {"$gte": {"$date": "2024-01-02T00:00:00Z"}}, "dec": {"$numberDecimal": "1.50"}, "k": {"$lt": {"$numberLong": "9"}}}))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = found._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = text[text.index("PushedFilters: [") :].split("]")[0]
    assert all(x in pushed for x in ("GreaterThanOrEqual(at", "EqualTo(dec,1.50)", "LessThan(k,9)")) and found.count() == 1


def test_pages_at_any_depth(spark, tmp_path):
    rows = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), F.format_string("%05d", F.pmod(F.col("id") * 7919, F.lit(10_000))).alias("x"), F.col("id").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a few rows would make one file
    try:
        pages = Pages.lay_out(rows.repartition(5), f"{tmp_path}/p", ["g"], ["x"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {g: [r.x for r in rows.filter(F.col("g") == g).orderBy("x").collect()] for g in "ab"}
    for g in "ab":
        assert pages.total(g) == len(want[g])
        for offset, limit in ((0, 7), (1234, 500), (len(want[g]) - 3, 10), (0, 10_000), (len(want[g]), 5)):
            got = pages.page(g, offset=offset, limit=limit)
            assert [r.x for r in got.collect()] == want[g][offset : offset + limit] and {r.total for r in got.collect()} <= {len(want[g])}
    assert {(r.g, r.total) for r in pages.totals().collect()} == {(g, len(x)) for g, x in want.items()} and pages.total("z") == 0 and pages.page("z").isEmpty()
    files_read = pages.page("b", offset=3000, limit=20).inputFiles()
    assert 1 <= len(files_read) <= 2 < len(rows.sparkSession.read.parquet(f"{tmp_path}/p/rows").inputFiles())


def test_pages_after_a_row(spark):
    df = spark.createDataFrame([(n, None if n % 7 == 0 else n % 5) for n in range(60)], "k int, g int")
    for sort in ({"g": 1}, {"g": -1}, {}):
        whole = [r.asDict() for r in browse.find(df, ["k"], sort=sort, limit=200).collect()]
        for at in (0, 8, 30, 58):
            assert [r.asDict() for r in browse.find_after(df, ["k"], whole[at], sort=sort, limit=9).collect()] == whole[at + 1 : at + 10]
    with pytest.raises(BadRequest):
        browse.find_after(df, ["k"], {"g": 1}, sort={"g": 1})
