"""Filtered, sorted, paged reads: a filter document becomes one Column that Catalyst pushes to the scan."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce
from operator import ge, gt, le, lt, or_
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadRequest
from ..functions.canon import relaxed
from .pages import after
from .values import literal, value

LIMIT, MOST = 50, 200


def _parsed(document: str | Mapping[str, Any] | None, what: str) -> Mapping[str, Any]:
    if isinstance(document, str):
        try:
            document = json.loads(document) if document.strip() else {}
        except ValueError as e:
            raise BadRequest(f"{what} is not JSON: {e}") from e
    if not isinstance(document or {}, Mapping):
        raise BadRequest(f"{what} must be an object")
    return document or {}


def _field(schema: T.StructType, path: str) -> tuple[Column, T.DataType]:
    """A dotted path and its type: through subdocuments, maps, and lists of subdocuments (the list of their fields)."""
    kind, c = schema, None
    for name in path.split("."):
        element = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            c, kind = c.getItem(name), kind.valueType
            continue
        if not isinstance(element, T.StructType) or name not in element.names or isinstance(kind, T.ArrayType) and isinstance(element[name].dataType, T.ArrayType):
            raise BadRequest(f"unknown field {path!r}")
        c = F.col(f"`{name}`") if c is None else c.getField(name)
        kind = T.ArrayType(element[name].dataType) if isinstance(kind, T.ArrayType) else element[name].dataType
    return c, kind


def _any(c: Column, kind: T.DataType, test: Callable[[Column, T.DataType], Column]) -> Column:
    """test of a scalar, or of some element of a list."""
    return F.exists(c, lambda x: F.coalesce(test(x, kind.elementType), F.lit(False))) if isinstance(kind, T.ArrayType) else test(c, kind)


def _equals(c: Column, kind: T.DataType, raw: Any) -> Column:
    """A value of another type than the field's equals nothing. Documents and lists are equal as a whole, fields in their
    order, those not named null; what is no list equals a list that holds it."""
    v = value(raw)
    if v.kind == "null":
        return c.isNull() | F.exists(c, lambda x: x.isNull()) if isinstance(kind, T.ArrayType) else c.isNull()
    if isinstance(kind, T.ArrayType):
        some = F.exists(c, lambda x: F.coalesce(_equals(x, kind.elementType, raw), F.lit(False)))
        if v.kind != "list":
            return some
        whole = F.size(c) == len(v.value)
        for i, x in enumerate(v.value):
            whole = whole & F.coalesce(_equals(F.get(c, i), kind.elementType, x), F.lit(False))
        return whole | some if isinstance(kind.elementType, T.ArrayType) else whole
    if isinstance(kind, T.StructType):
        if not isinstance(raw, Mapping) or list(raw) != [n for n in kind.names if n in raw]:
            return F.lit(False)
        out = c.isNotNull()
        for f in kind:
            out = out & F.coalesce(_equals(c.getField(f.name), f.dataType, raw.get(f.name)), F.lit(False))
        return out
    if isinstance(kind, T.MapType) and isinstance(raw, Mapping):
        out = F.size(c) == len(raw)
        for name, x in raw.items():
            out = out & F.map_contains_key(c, name) & F.coalesce(_equals(c.getItem(name), kind.valueType, x), F.lit(False))
        return out
    own = literal(v, kind)
    return F.lit(False) if own is None else c == own


def _differs(c: Column, kind: T.DataType, raw: Any) -> Column:
    own = None if isinstance(kind, T.ArrayType | T.StructType | T.MapType) else literal(value(raw), kind)
    return ~c.eqNullSafe(own) if own is not None else ~F.coalesce(_equals(c, kind, raw), F.lit(False))


def _among(c: Column, kind: T.DataType, values: Any) -> Column:
    if not isinstance(values, list):
        raise BadRequest("$in and $nin take a list")
    if isinstance(kind, T.ArrayType | T.StructType | T.MapType):
        tests = [F.coalesce(_equals(c, kind, v), F.lit(False)) for v in values]
        return reduce(or_, tests, F.lit(False))
    found = [x for x in (literal(value(v), kind) for v in values) if x is not None]
    own = c.isin(*found) if found else F.lit(False)
    return F.coalesce(own, F.lit(False)) | c.isNull() if None in values else own


_ORDERED = {"$gt": gt, "$gte": ge, "$lt": lt, "$lte": le}


def _ordered(c: Column, kind: T.DataType, op: str, raw: Any) -> Column:
    """Only values of the field's type are ordered with it; null is at most and at least null."""
    v = value(raw)
    if v.kind == "null":
        return c.isNull() if op in ("$gte", "$lte") else F.lit(False)

    def test(x: Column, own_kind: T.DataType) -> Column:
        own = literal(v, own_kind)
        return F.lit(False) if own is None else _ORDERED[op](x, own)

    return _any(c, kind, test)


def _matches(c: Column, kind: T.DataType, pattern: Any, options: Any) -> Column:
    if not isinstance(pattern, str) or not isinstance(options, str) or set(options) - set("imsx"):
        raise BadRequest("$regex takes a pattern, and $options some of i, m, s, x")
    pattern = f"(?{''.join(sorted(set(options)))})" * bool(options) + pattern
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except (PySparkException, Py4JJavaError) as e:
        raise BadRequest(f"not a pattern: {pattern!r}") from e
    return _any(c, kind, lambda x, own: x.rlike(pattern) if isinstance(own, T.StringType) else F.lit(False))


def _condition(c: Column, kind: T.DataType, test: Any) -> Column:
    operators = isinstance(test, Mapping) and [k for k in test if k.startswith("$")]
    if not operators or value(test).kind != "document" or isinstance(kind, T.StructType) and set(test) <= set(kind.names):
        return _equals(c, kind, test)
    if len(operators) < len(test):
        raise BadRequest("operators and fields in one document")
    out = None
    for op, raw in test.items():
        match op:
            case "$eq":
                own = _equals(c, kind, raw)
            case "$ne":
                own = _differs(c, kind, raw)
            case "$gt" | "$gte" | "$lt" | "$lte":
                own = _ordered(c, kind, op, raw)
            case "$in":
                own = _among(c, kind, raw)
            case "$nin":
                own = ~F.coalesce(_among(c, kind, raw), F.lit(False))
            case "$exists":
                own = c.isNotNull() if raw else c.isNull()
            case "$regex":
                own = _matches(c, kind, raw, test.get("$options", ""))
            case "$options" if "$regex" in test:
                continue
            case "$not":
                own = ~F.coalesce(_condition(c, kind, raw), F.lit(False))
            case _:
                raise BadRequest(f"unknown operator {op!r}")
        out = own if out is None else out & own
    return out


def where(schema: T.StructType, document: str | Mapping[str, Any] | None) -> Column:
    """A filter document as a Column: fields (dotted paths), $and, $or, $nor and the operators above.

    Values are plain or Extended JSON, read by the field's type. Null and absent are one thing under a fixed schema:
    {"f": null} is f IS NULL, $ne and $nin hold for null. What cannot be a filter is a BadRequest.
    """
    tests = []
    for name, test in _parsed(document, "filter").items():
        if name in ("$and", "$or", "$nor"):
            if not isinstance(test, list) or not test:
                raise BadRequest(f"{name} takes a list")
            parts = [where(schema, t) for t in test]
            own = parts[0]
            for p in parts[1:]:
                own = own & p if name == "$and" else own | p
            tests.append(~F.coalesce(own, F.lit(False)) if name == "$nor" else own)
        elif name.startswith("$"):
            raise BadRequest(f"unknown operator {name!r}")
        else:
            tests.append(_condition(*_field(schema, name), test))
    out = tests[0] if tests else F.lit(True)
    for t in tests[1:]:
        out = out & t
    return out


def sorting(schema: T.StructType, document: str | Mapping[str, int] | None, key: list[str]) -> list[Column]:
    """A sort document ({"field": 1 or -1}) as order expressions, then the key so that pages are stable."""
    given = _parsed(document, "sort")
    if any(d not in (1, -1) for d in given.values()):
        raise BadRequest("a sort direction is 1 or -1")
    out = [_field(schema, f)[0].asc() if d == 1 else _field(schema, f)[0].desc() for f, d in given.items()]
    return out + [F.col(f"`{k}`").asc() for k in key if k not in given]


def clamp(skip: int, limit: int) -> tuple[int, int]:
    return max(0, skip), limit if 0 < limit <= MOST else LIMIT


def find(df: DataFrame, key: list[str], filter=None, sort=None, skip: int = 0, limit: int = LIMIT) -> DataFrame:
    """One page of rows. Limits outside 1..200 become 50, a negative skip 0."""
    skip, limit = clamp(skip, limit)
    return df.filter(where(df.schema, filter)).orderBy(*sorting(df.schema, sort, key)).offset(skip).limit(limit)


def find_after(df: DataFrame, key: list[str], last: Mapping[str, Any], filter=None, sort=None, limit: int = LIMIT) -> DataFrame:
    """The page after a row, of which `last` has the sort fields and the key: what find() gives at the offset after it, without an
    offset. Every scan can skip what lies before."""
    given = _parsed(sort, "sort")
    names = [(f, d == 1) for f, d in given.items()] + [(k, True) for k in key if k not in given]
    if missing := [f for f, _ in names if f not in last]:
        raise BadRequest(f"the last row lacks {', '.join(missing)}")
    beyond = after([(_field(df.schema, f)[0], ascending, last[f]) for f, ascending in names])
    return df.filter(where(df.schema, filter)).filter(beyond).orderBy(*sorting(df.schema, sort, key)).limit(clamp(0, limit)[1])


def total(df: DataFrame, filter=None) -> DataFrame:
    return df.filter(where(df.schema, filter)).agg(F.count(F.lit(1)).alias("total"))


def page(df: DataFrame, key: list[str], filter=None, sort=None, skip: int = 0, limit: int = LIMIT) -> DataFrame:
    """find() and total() in one result: the page's rows with a column total (total_, ... where df has one); a page past the
    end has one row of nulls with the total."""
    found = find(df, key, filter, sort, skip, limit)
    name = "total"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    counted = total(df, filter).withColumnRenamed("total", name)
    ordered = sorting(df.schema, sort, key)
    return counted.join(found, F.lit(True), "left").select(*[F.col(f"`{c}`") for c in df.columns], F.col(name)).orderBy(*ordered)


def documents(df: DataFrame, key: list[str], pretty: bool = True, **page) -> DataFrame:
    """One page as JSON texts, indented unless told otherwise."""
    found = find(df, key, **page)
    return found.select(relaxed(found, pretty).alias("document"))
