"""Checks of keys, uniqueness and completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import KeyProblem, MissingObjects


def rows_without_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    missing = F.lit(False)
    for k in key:
        missing = missing | F.col(f"`{k}`").isNull()
    return df.filter(missing)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that several rows have, with how many."""
    return df.groupBy(*[F.col(f"`{k}`") for k in key]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unique_violations(df: DataFrame, columns: Sequence[str], sparse: bool = False) -> DataFrame:
    """Values that a unique index would refuse. Nulls count as equal; sparse leaves rows out that are null in all columns."""
    if sparse:
        present = F.lit(False)
        for c in columns:
            present = present | F.col(f"`{c}`").isNotNull()
        df = df.filter(present)
    return duplicate_keys(df, columns)


def missing_objects(refs: DataFrame, objects: DataFrame) -> DataFrame:
    return refs.join(objects.select("hash"), "hash", "left_anti")


def require_unique(df: DataFrame, key: Sequence[str], what: str) -> None:
    found = duplicate_keys(df, key).limit(3).collect()
    if found:
        raise KeyProblem(f"{what} has repeated keys, among them {', '.join(str(r.asDict()) for r in found)}")


def require_complete(refs: DataFrame, objects: DataFrame) -> None:
    found = missing_objects(refs, objects).limit(3).collect()
    if found:
        raise MissingObjects(f"rows are not stored, among them {', '.join(r['id'] for r in found)}")
