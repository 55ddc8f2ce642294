"""Differences between two lists of refs(collection, id, hash)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadRequest
from .pages import Pages

CHANGES = ("added", "modified", "removed")
PAGE = 500


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """collection, id, change, from_hash, to_hash of what differs: one full outer join on (collection, id). Refs in
    buckets (which have their range r) are joined by their own columns, so equal buckets need no exchange."""
    # Two constant names would be compared once and for all; where they differ no key is left, and every row meets every other.
    name = F.col("collection") if "r" in old.columns and "r" in new.columns else F.concat("collection", F.coalesce(F.substring("id", 1, 0), F.lit("")))
    a = old.select(name.alias("collection"), "id", F.col("hash").alias("from_hash"))
    b = new.select(name.alias("collection"), "id", F.col("hash").alias("to_hash"))
    both = a.join(b, ["collection", "id"], "full_outer").filter(~F.col("from_hash").eqNullSafe(F.col("to_hash")))
    change = F.when(F.col("from_hash").isNull(), "added").when(F.col("to_hash").isNull(), "removed").otherwise("modified")
    return both.select("collection", "id", change.alias("change"), "from_hash", "to_hash")


def summary(changes: DataFrame) -> DataFrame:
    """added, modified, removed of each collection that changed, by name."""
    counts = [F.count_if(F.col("change") == c).alias(c) for c in CHANGES]
    return changes.groupBy("collection").agg(*counts).orderBy("collection")


def is_empty(changes: DataFrame) -> bool:
    return changes.limit(1).isEmpty()


def listed(changes: DataFrame) -> DataFrame:
    """By collection, then added, modified, removed, then key."""
    rank = F.when(F.col("change") == "added", 0).when(F.col("change") == "modified", 1).otherwise(2)
    return changes.orderBy("collection", rank, "id")


def of_change(changes: DataFrame, change: str) -> DataFrame:
    if change not in CHANGES:
        raise BadRequest(f"unknown change {change!r}")
    return changes.filter(F.col("change") == change)


def page(changes: DataFrame, collection: str, change: str, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """One page of changed keys in key order. Limits outside 1..500 become 500."""
    found = of_change(changes, change).filter(F.col("collection") == collection).select("id")
    limit = limit if 0 < limit <= PAGE else PAGE
    return found.orderBy("id").offset(max(0, offset)).limit(limit)


def page_total(changes: DataFrame, collection: str, change: str) -> DataFrame:
    """total of the keys that page() goes through; summary() has all of them at once."""
    return of_change(changes, change).filter(F.col("collection") == collection).agg(F.count(F.lit(1)).alias("total"))


def paged(changes: DataFrame, path: str) -> Pages:
    """Changes laid out under path in pages of (collection, change), keys in order: for going through many, or far."""
    return Pages.lay_out(changes.select("collection", "change", "id"), path, ["collection", "change"], ["id"])


def content(changes: DataFrame, objects: DataFrame) -> DataFrame:
    """changes with the texts before and after."""
    before = objects.select(F.col("hash").alias("from_hash"), F.col("canonical").alias("before"))
    after = objects.select(F.col("hash").alias("to_hash"), F.col("canonical").alias("after"))
    out = changes.join(before, "from_hash", "left").join(after, "to_hash", "left")
    return out.select("collection", "id", "change", "before", "after")
