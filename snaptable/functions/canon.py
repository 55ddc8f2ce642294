"""Canonical text of rows: typed JSON with the fields in schema order, and back without loss.

Scalars are wrapped with their type, so 1 as int, as long and as text are different, and a row whose
fields are reordered is different. Everything is Column expressions built by walking the schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadRequest, KeyProblem

_TAGS: list[tuple[tuple[type, ...], str]] = [
    ((T.ByteType, T.ShortType, T.IntegerType), "$numberInt"),
    ((T.LongType,), "$numberLong"),
    ((T.FloatType, T.DoubleType), "$numberDouble"),
    ((T.DecimalType,), "$numberDecimal"),
    ((T.TimestampType, T.TimestampNTZType), "$date"),
    ((T.DateType,), "$day"),
    ((T.BinaryType,), "$binary"),
    ((T.DayTimeIntervalType, T.YearMonthIntervalType), "$interval"),
]
_PLAIN = (T.StringType, T.BooleanType, T.NullType)


def _tag(kind: T.DataType) -> str | None:
    if isinstance(kind, _PLAIN):
        return None
    for kinds, tag in _TAGS:
        if isinstance(kind, kinds):
            return tag
    raise BadRequest(f"no canonical form for {kind.simpleString()}")


def _text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(kind, T.TimestampNTZType):
        # By its fields, which no session zone moves.
        day, second = F.unix_date(c.cast("date")).cast("long"), (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
        return (((day * 24 + F.hour(c)) * 60 + F.minute(c)) * 60_000_000 + second).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    return c.cast("string")


def wrapped(kind: T.DataType) -> T.DataType:
    """The type of the JSON that encoded values of a type have."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, wrapped(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(wrapped(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(T.StringType(), wrapped(kind.valueType))
    tag = _tag(kind)
    return T.StructType([T.StructField(tag, T.StringType())]) if tag else kind


def encode(c: Column, kind: T.DataType) -> Column:
    """A value as a structure that to_json writes canonically. Maps get sorted keys; null stays null."""
    if isinstance(kind, T.StructType):
        own = F.struct(*[encode(c.getField(f.name), f.dataType).alias(f.name) for f in kind]) if len(kind) else F.struct()
        return F.when(c.isNotNull(), own)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: encode(x, kind.elementType))
    if isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise BadRequest("map keys must be strings")
        entries = F.array_sort(F.map_entries(c), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), encode(e["value"], kind.valueType).alias("value"))))
    tag = _tag(kind)
    return F.when(c.isNotNull(), F.struct(_text(c, kind).alias(tag))) if tag else c


def decode(c: Column, kind: T.DataType) -> Column:
    """The value of type `kind` back from its parsed canonical JSON."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[decode(c.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: decode(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: decode(v, kind.valueType))
    tag = _tag(kind)
    if not tag:
        return c
    text = c.getField(tag)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(text.cast("long"))
    if isinstance(kind, T.TimestampNTZType):
        micros, day = text.cast("long"), 86_400_000_000
        seconds = F.pmod(micros, F.lit(day)).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)")
        zero = F.lit(0)
        return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.round((micros - F.pmod(micros, F.lit(day))) / day).cast("int"), zero, zero, seconds.cast("decimal(18,6)"))
    if isinstance(kind, T.BinaryType):
        return F.unbase64(text)
    return text.cast(kind)


JSON = {"ignoreNullFields": "false"}


def canonical(df: DataFrame) -> Column:
    """The row's canonical text."""
    if not df.columns:
        raise BadRequest("a row needs columns")
    return F.to_json(F.struct(*[encode(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]), JSON)


def id_key(df: DataFrame, key: Sequence[str]) -> Column:
    """The row's key text, {"_id": value}; of several columns, {"_id": {column: value, ...}}. A null fails.

    A key {"$oid": hex} of a JSON source has the text oid:hex.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    if not key or (unknown := [k for k in key if k not in kinds]):
        raise KeyProblem(f"no such key column: {', '.join(unknown) if key else '(none given)'}")
    none = F.raise_error(F.lit(f"a row has no key ({', '.join(key)})")).cast("string")
    missing = F.lit(False)
    for k in key:
        missing = missing | F.col(f"`{k}`").isNull()
    if len(key) == 1:
        kind = kinds[key[0]]
        if isinstance(kind, T.StructType) and kind.names == ["$oid"]:
            return F.when(missing, none).otherwise(F.concat(F.lit("oid:"), F.col(f"`{key[0]}`").getField("$oid")))
        value = encode(F.col(f"`{key[0]}`"), kind)
    else:
        value = F.struct(*[encode(F.col(f"`{k}`"), kinds[k]).alias(k) for k in key])
    return F.when(missing, none).otherwise(F.to_json(F.struct(value.alias("_id")), JSON))


def content_hash(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text's UTF-8 bytes."""
    return F.sha2(text, 256)


def encoded(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """id, hash and canonical text of every row."""
    own = df.select(id_key(df, key).alias("id"), canonical(df).alias("canonical"))
    return own.select("id", content_hash(F.col("canonical")).alias("hash"), "canonical")


def decoded(texts: DataFrame, schema: T.StructType, column: str = "canonical") -> DataFrame:
    """Typed rows from canonical texts."""
    parsed = texts.select(F.from_json(column, wrapped(schema)).alias("row"))
    return parsed.select(*[decode(F.col("row").getField(f.name), f.dataType).alias(f.name) for f in schema])


def relaxed(df: DataFrame, pretty: bool = True) -> Column:
    """Plain JSON of the row for people, indented unless told otherwise."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {**JSON, "pretty": str(pretty).lower()})
