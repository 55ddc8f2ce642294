import json

import pytest
from pyspark.sql import functions as F

from snaptable.functions.json_text import canonical_document, document_key, encoded_documents, plain_document


def texts(spark, documents, f=canonical_document):
    return [r[0] for r in spark.createDataFrame([(d,) for d in documents], "d string").select(f(F.col("d"))).collect()]


def test_canonical_documents(spark):
    pairs = [
        ('{"_id": 5, "a" : "x  y", "b": [1, 2.50, -3e5, true, null ], "c": {}}', '{"_id":{"$numberInt":"5"},"a":"x  y","b":[{"$numberInt":"1"},{"$numberDouble":"2.50"},{"$numberDouble":"-3e5"},true,null],"c":{}}'),
        ('{"q":"a\\"b\\\\ : 1, {2}","n":5000000000,"m":-2147483649,"k":-2147483648}', '{"q":"a\\"b\\\\ : 1, {2}","n":{"$numberLong":"5000000000"},"m":{"$numberLong":"-2147483649"},"k":{"$numberInt":"-2147483648"}}'),
        ('{"u":"\\u0041\\u00e9\\/"}', '{"u":"Aé/"}'),
        ('{"n":99999999999999999999}', '{"n":{"$numberDouble":"99999999999999999999"}}'),
        ("{ }", "{}"),
    ]
    assert texts(spark, [a for a, _ in pairs]) == [b for _, b in pairs]
    long = '{"a": "' + "x\\n" * 100_000 + '", "b": [' + "1, " * 50_000 + "2]}"
    assert json.loads(texts(spark, [long])[0])["a"] == "x\n" * 100_000
    for bad in ('{"a":1', "[1]", "5", '{"a":1} x', '{"a":1}{"b":2}', "{'a':1}", '{"a":01}', '{"a":1,"a":2}', '"text"', '{"a":NaN}', "{}{}"):
        with pytest.raises(Exception, match="not a JSON document"):
            texts(spark, [bad])


def test_plain_documents(spark):
    lines = [
        '{"a":1,"b":[2147483647,2147483648,-2147483648,-2147483649,0,9223372036854775807,9223372036854775808]}',
        '{"a":1.5,"b":-2e9,"c":0.0,"d":"{\\"$numberInt\\":\\"5\\"}","e":{"$oid":"ab"},"f":null}',
        '{"a":{"$numberLong":"5"},"b":{"$numberDouble":"5"},"c":{"$numberDouble":"NaN"},"d":{"$numberInt":"-0"},"e":{"$numberInt":"2147483648"},"f":{"$numberLong":"9223372036854775808"}}',
        '{"a{":"$numberInt","b":"}"}',
    ]
    canonical = texts(spark, lines)
    assert texts(spark, canonical, plain_document) == lines and texts(spark, lines) == canonical
    assert texts(spark, ['{"a":{"$numberInt":"5"},"b":{"$numberLong":"5000000000"}}'], lambda c: plain_document(canonical_document(c))) == ['{"a":5,"b":5000000000}']


def test_document_keys(spark):
    rows = [('{"_id":5}', '{"_id":{"$numberInt":"5"}}'), ('{"_id":"5"}', '{"_id":"5"}'), ('{"x":1,"_id":{"$oid":"0aF"}}', "oid:0aF"), ('{"_id":{"b":1,"a":[2]}}', '{"_id":{"b":{"$numberInt":"1"},"a":[{"$numberInt":"2"}]}}')]
    found = encoded_documents(spark.createDataFrame([(d, 1) for d, _ in rows], "document string, other int"), ["_id"])
    assert [r.id for r in found.collect()] == [k for _, k in rows] and found.columns == ["id", "hash", "canonical", "other"]
    composite = encoded_documents(spark.createDataFrame([('{"a":{"b":"x"},"c":2}',)], "document string"), ["a.b", "c"]).first()
    assert composite.id == '{"_id":{"a.b":"x","c":{"$numberInt":"2"}}}'
    for line in ('{"a":1}', '{"_id":null}'):
        with pytest.raises(Exception, match="has no key"):
            encoded_documents(spark.createDataFrame([(line,)], "document string"), ["_id"]).collect()
    assert document_key(F.lit("{}"), ["a"]) is not None
