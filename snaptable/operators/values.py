"""Values of filter documents: plain JSON and Extended JSON, as literals of the type that a field has."""

from __future__ import annotations

import base64
import math
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadRequest

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


@dataclass(frozen=True)
class Value:
    """kind: null, bool, number, string, instant (microseconds since 1970, UTC), day, binary, oid, document or list."""

    kind: str
    value: Any


def value(raw: Any) -> Value:
    """A JSON value, of which documents with one field $date, $day, $numberInt, $numberLong, $numberDouble,
    $numberDecimal, $oid or $binary are typed scalars."""
    if raw is None:
        return Value("null", None)
    if isinstance(raw, bool):
        return Value("bool", raw)
    if isinstance(raw, int | float | Decimal):
        return Value("number", raw)
    if isinstance(raw, str):
        return Value("string", raw)
    if isinstance(raw, datetime):
        return Value("instant", _micros(raw))
    if isinstance(raw, date):
        return Value("day", raw)
    if isinstance(raw, bytes | bytearray):
        return Value("binary", bytes(raw))
    if isinstance(raw, Mapping):
        if len(raw) == 1 and (tag := next(iter(raw))) in _TYPED:
            try:
                return _TYPED[tag](raw[tag])
            except (ValueError, TypeError, KeyError, InvalidOperation, OverflowError) as e:
                raise BadRequest(f"not a value of {tag}: {raw[tag]!r}") from e
        return Value("document", raw)
    if isinstance(raw, list | tuple):
        return Value("list", list(raw))
    raise BadRequest(f"not a JSON value: {raw!r}")


def _micros(t: datetime) -> int:
    return (t.replace(tzinfo=t.tzinfo or UTC) - _EPOCH) // timedelta(microseconds=1)


def _whole(bits: int):
    def read(text: Any) -> Value:
        n = int(text) if isinstance(text, str | int) and not isinstance(text, bool) else int("")
        if not -(1 << bits - 1) <= n < 1 << bits - 1:
            raise ValueError(text)
        return Value("number", n)

    return read


def _double(text: Any) -> Value:
    return Value("number", {"Infinity": math.inf, "-Infinity": -math.inf, "NaN": math.nan}.get(text) if text in ("Infinity", "-Infinity", "NaN") else float(text))


def _decimal(text: Any) -> Value:
    n = Decimal(text)
    if not n.is_finite():
        return _double(text)
    return Value("number", n)


def _date(text: Any) -> Value:
    """ISO text, or milliseconds as a number or {"$numberLong": text}; digits alone in a text are the canonical form's microseconds."""
    if isinstance(text, Mapping) and set(text) == {"$numberLong"}:
        text = int(text["$numberLong"])
    if isinstance(text, str):
        return Value("instant", int(text) if text.lstrip("-").isdigit() else _micros(datetime.fromisoformat(text)))
    if isinstance(text, bool) or not isinstance(text, int):
        raise ValueError(text)
    return Value("instant", text * 1000)


def _binary(text: Any) -> Value:
    return Value("binary", base64.b64decode(text["base64"] if isinstance(text, Mapping) else text, validate=True))


def _oid(text: Any) -> Value:
    if len(bytes.fromhex(text)) != 12:
        raise ValueError(text)
    return Value("oid", text.lower())


_TYPED = {
    "$date": _date, "$day": lambda x: Value("day", date.fromisoformat(x)), "$numberInt": _whole(32), "$numberLong": _whole(64),
    "$numberDouble": _double, "$numberDecimal": _decimal, "$oid": _oid, "$binary": _binary,
}


def literal(v: Value, kind: T.DataType) -> Column | None:
    """v as a value that a field of that type can be compared with; None if no value of the field is like v."""
    match v.kind:
        case "number" if isinstance(kind, _NUMBERS):
            if isinstance(v.value, Decimal) and isinstance(kind, T.FloatType | T.DoubleType):
                return F.lit(float(v.value))
            if isinstance(v.value, int) and not -(1 << 63) <= v.value < 1 << 63:
                return F.lit(float(v.value))
            if isinstance(v.value, Decimal) and len(v.value.as_tuple().digits) > 38:
                return F.lit(float(v.value))
            return F.lit(v.value)
        case "string" if isinstance(kind, T.StringType):
            return F.lit(v.value)
        case "oid" if isinstance(kind, T.StringType):
            return F.lit(v.value)
        case "bool" if isinstance(kind, T.BooleanType):
            return F.lit(v.value)
        case "binary" if isinstance(kind, T.BinaryType):
            return F.unhex(F.lit(v.value.hex()))
        case "instant" if isinstance(kind, T.TimestampType):
            return F.timestamp_micros(F.lit(v.value).cast("long"))
        case "instant" if isinstance(kind, T.TimestampNTZType | T.DateType):
            at = _calendar(v.value)
            # A day is its first instant.
            return F.lit(at.isoformat(" ")).cast("timestamp_ntz") if isinstance(kind, T.TimestampNTZType) or at.time() != datetime.min.time() else F.lit(at.date())
        case "day" if isinstance(kind, T.DateType):
            return F.lit(v.value)
    return None


def _calendar(micros: int) -> datetime:
    try:
        return (_EPOCH + timedelta(microseconds=micros)).replace(tzinfo=None)
    except OverflowError as e:
        raise BadRequest(f"no such date: {micros} microseconds") from e
