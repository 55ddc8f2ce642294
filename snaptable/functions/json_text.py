"""Canonical text of JSON documents of any shape: a document at a time, without a schema.

A document is its own tokens in their order. White space between tokens goes, numbers are typed by their form
(32-bit and 64-bit integers, others as they are written), and strings with escapes are written in one way. A
field that is absent and one that is null are different, and so are documents with fields in another order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import KeyProblem
from .canon import content_hash

#: A string, a punctuation mark, or whatever else stands between those and white space.
TOKEN = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]:,]|[^\s{}\[\]:,"]+)'


def tokens(document: Column) -> Column:
    return F.regexp_extract_all(document, F.lit(TOKEN), F.lit(1))


def _wrapped(tag: str, text: Column) -> Column:
    return F.concat(F.lit(f'{{"{tag}":"'), text, F.lit('"}'))


def _typed(token: Column) -> Column:
    """A token as it stands in canonical text."""
    one = F.to_json(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"))
    whole = token.rlike("^-?[0-9]+$")
    out = F.when(token.startswith('"'), F.when(token.contains("\\"), F.substring(one, F.lit(2), F.length(one) - 2)).otherwise(token))
    out = out.when(whole & token.try_cast("int").isNotNull(), _wrapped("$numberInt", token.try_cast("int").cast("string")))
    out = out.when(whole & token.try_cast("long").isNotNull(), _wrapped("$numberLong", token.try_cast("long").cast("string")))
    return out.when(token.rlike("^-?[0-9]"), _wrapped("$numberDouble", token)).otherwise(token)


def _is_object(document: Column, found: Column) -> Column:
    """Whether the text is one valid JSON object with nothing after it."""
    depth = F.aggregate(
        found,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed")),
        lambda a, t: F.struct(
            (a["depth"] + F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)).alias("depth"),
            (a["closed"] + F.when(t.isin("}", "]") & (a["depth"] == 1), 1).when(~t.isin("{", "[", "}", "]") & (a["depth"] == 0), 1).otherwise(0)).alias("closed"),
        ),
    )
    return F.try_parse_json(document).isNotNull() & (F.get(found, 0) == "{") & (depth["closed"] == 1)


def canonical_document(document: Column) -> Column:
    """The canonical text; a text that is not one JSON object, or repeats a field's name, fails."""
    found = tokens(document)
    bad = F.raise_error(F.concat(F.lit("not a JSON document: "), F.substring(document, 1, 80))).cast("string")
    return F.when(_is_object(document, found), F.array_join(F.transform(found, _typed), "")).otherwise(bad)


def _over(limit: str) -> str:
    """A pattern of whole numbers above limit."""
    same = [f"{limit[:i]}[{int(d) + 1}-9][0-9]{{{len(limit) - i - 1}}}" for i, d in enumerate(limit) if d != "9"]
    return "|".join([f"[1-9][0-9]{{{len(limit)},}}", *same])


_INT = rf'(?:{_over("2147483647")}|-(?:{_over("2147483648")}))'
_LONG = rf'(?:{_over("9223372036854775807")}|-(?:{_over("9223372036854775808")}))'
#: Wrapped numbers whose plain form would be wrapped as they are.
_PLAIN = (
    rf'\{{"\$numberInt":"(?!{_INT}")(0|-?[1-9][0-9]*)"\}}',
    rf'\{{"\$numberLong":"(?!{_LONG}")({_INT})"\}}',
    rf'\{{"\$numberDouble":"(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+(?:[eE][+-]?[0-9]+)?|[eE][+-]?[0-9]+)|{_LONG})"\}}',
)


def plain_document(canonical: Column) -> Column:
    """The JSON document of a canonical text; its own canonical text is that again."""
    # In a string every quotation mark is escaped, so no pattern begins inside one.
    for pattern in _PLAIN:
        canonical = F.regexp_replace(canonical, pattern, "$1")
    return canonical


def value_at(canonical: Column, path: str) -> Column:
    """Canonical text of the value at a dotted path; null where there is none, or null."""
    steps = "".join(f"['{name}']" for name in path.split("."))
    return F.get_json_object(F.concat(F.lit("["), canonical, F.lit("]")), f"$[*]{steps}")


def document_key(canonical: Column, key: Sequence[str]) -> Column:
    """Key text of a canonical document, as canon.id_key() gives it for rows; of several paths, by their names."""
    if not key:
        raise KeyProblem("no such key column: (none given)")
    values = [value_at(canonical, k) for k in key]
    none = F.raise_error(F.concat(F.lit(f"a document has no key ({', '.join(key)}): "), F.substring(canonical, 1, 80))).cast("string")
    missing = values[0].isNull()
    for v in values[1:]:
        missing = missing | v.isNull()
    if len(key) == 1:
        oid = F.regexp_extract(values[0], r'^\{"\$oid":"([0-9a-fA-F]*)"\}$', 1)
        return F.when(missing, none).when(oid != "", F.concat(F.lit("oid:"), oid)).otherwise(F.concat(F.lit('{"_id":'), values[0], F.lit("}")))
    parts = [x for k, v in zip(key, values, strict=True) for x in (F.lit(f',"{k}":'), v)][1:]
    return F.when(missing, none).otherwise(F.concat(F.lit(f'{{"_id":{{"{key[0]}":'), *parts, F.lit("}}")))


def encoded_documents(df: DataFrame, key: Sequence[str], column: str = "document") -> DataFrame:
    """id, hash and canonical text of every document, and df's other columns."""
    others = [c for c in df.columns if c != column]
    own = df.select(canonical_document(F.col(column)).alias("canonical"), *others)
    return own.select(document_key(F.col("canonical"), key).alias("id"), content_hash(F.col("canonical")).alias("hash"), "canonical", *others)
