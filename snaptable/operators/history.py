"""Orders, lookups, retention and marking over a history of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..errors import BadRequest, NotFound
from ..functions.columns import is_tagged

KEEP = 10


def ordered(snapshots: DataFrame, order: str = "desc") -> DataFrame:
    if order not in ("asc", "desc"):
        raise BadRequest(f"unknown order {order!r}")
    by = F.asc if order == "asc" else F.desc
    return snapshots.orderBy(by("created_at"), by("seq"))


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot; of those at one time, the first."""
    return snapshots.orderBy(F.desc("created_at"), F.asc("seq")).limit(1)


def with_parents(snapshots: DataFrame, scope: str = "database") -> DataFrame:
    """parent_id of each snapshot in a history nothing was pruned from."""
    own = Window.partitionBy(scope).orderBy("created_at", "seq")
    return snapshots.withColumn("parent_id", F.lag("snapshot_id").over(own))


def matching(snapshots: DataFrame, text: str) -> DataFrame:
    """The snapshot of exactly that id, else those whose id begins with it, two at most."""
    exact = F.col("snapshot_id") == text
    found = snapshots.filter(F.col("snapshot_id").startswith(text)).orderBy(exact.desc(), "snapshot_id")
    first = found.withColumn("exact_", exact).limit(2)
    return first.withColumn("any_", F.max("exact_").over(Window.partitionBy())).filter("exact_ or not any_").drop("exact_", "any_")


def find(snapshots: DataFrame, text: str, resolve_tags: bool = False) -> Row:
    """By id, else unique prefix, else (if asked for) the one snapshot with that tag."""
    found = matching(snapshots, text).collect()
    if len(found) != 1 and resolve_tags:
        found = snapshots.filter(F.array_contains("tags", text)).limit(2).collect()
    if len(found) != 1:
        raise NotFound(f"{'several snapshots match' if found else 'no snapshot matches'} {text!r}")
    return found[0]


def kept(snapshots: DataFrame, keep_last: int = KEEP, scope: str | None = None) -> DataFrame:
    """Tagged snapshots and the newest keep_last of each scope, or of all."""
    newest = [F.desc("created_at"), F.desc("seq")]
    if keep_last <= 0:
        return snapshots.filter(is_tagged(F.col("tags")))
    if scope is None:
        last = snapshots.orderBy(*newest).limit(keep_last).select("snapshot_id").withColumn("last_", F.lit(True))
        both = snapshots.join(last, "snapshot_id", "left")
        return both.filter(is_tagged(F.col("tags")) | F.coalesce("last_", F.lit(False))).select(*snapshots.columns)
    ranked = snapshots.withColumn("rank_", F.row_number().over(Window.partitionBy(scope).orderBy(*newest)))
    return ranked.filter(is_tagged(F.col("tags")) | (F.col("rank_") <= keep_last)).drop("rank_")


def pruned(snapshots: DataFrame, keep: DataFrame) -> DataFrame:
    return snapshots.join(keep.select("snapshot_id"), "snapshot_id", "left_anti")


def referenced(refs: DataFrame, keep: DataFrame) -> DataFrame:
    """Distinct hashes that kept snapshots refer to."""
    return refs.join(keep.select("snapshot_id"), "snapshot_id", "left_semi").select("hash").distinct()


def unreferenced(objects: DataFrame, hashes: DataFrame) -> DataFrame:
    return objects.join(hashes, "hash", "left_anti")
