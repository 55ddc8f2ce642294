"""Batches of inserts, replacements and deletions by key; each gives the table's next state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import KeyProblem
from ..functions.json_text import encoded_documents
from .checks import require_unique, rows_without_key


def _checked(changes: DataFrame, key: Sequence[str]) -> None:
    if not rows_without_key(changes, key).limit(1).isEmpty():
        raise KeyProblem("a change has no key")
    require_unique(changes, key, "the batch")


def _matched_all(table: DataFrame, changes: DataFrame, key: Sequence[str]) -> None:
    lost = changes.select(*key).join(table.select(*key), list(key), "left_anti").limit(3).collect()
    if lost:
        raise KeyProblem(f"no such rows: {', '.join(str(r.asDict()) for r in lost)}")


def insert(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """table and rows; a key that is there already fails."""
    _checked(rows, key)
    there = rows.join(table.select(*key), list(key), "left_semi").select(*key).limit(3).collect()
    if there:
        raise KeyProblem(f"already there: {', '.join(str(r.asDict()) for r in there)}")
    return table.unionByName(rows)


def replace(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """table with whole rows replaced; a key that matches none fails."""
    _checked(rows, key)
    _matched_all(table, rows, key)
    return upsert(table, rows, key)


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """table with rows replaced where the key is there and added where not."""
    return table.join(rows.select(*key), list(key), "left_anti").select(*table.columns).unionByName(rows)


def delete(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """table without those keys; a key that matches none fails."""
    _checked(keys, key)
    _matched_all(table, keys, key)
    return table.join(keys.select(*key), list(key), "left_anti").select(*table.columns)


def keyed_documents(documents: DataFrame, key: Sequence[str]) -> DataFrame:
    """document and id, its key text: JSON documents as the functions above take them, with the key ["id"]."""
    found = encoded_documents(documents.select("document", F.col("document").alias("line")), key)
    return found.select(F.col("line").alias("document"), "id")
