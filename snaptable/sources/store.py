"""A store: the objects, refs and snapshots of one database, as Parquet tables, and the commits that name the live ones.

    <root>/<database>-<h8>/commits/<n>.json          what is live: snapshots, batches of objects, tables of dead ones
                          /snapshots/<name>          a row a snapshot; written anew at each commit that changes them
                          /objects/b=<batch>         hash, canonical; a batch a snapshot that brought new ones
                          /dead/<name>               hash, b: objects of live batches that were deleted
                          /docrefs/snapshot_id=<id>  r, collection, id, hash, f; bucketed by key; r is a range of its
                                                     hash, f the number of the file that the row was read from
                          /digests/snapshot_id=<id>  for each r, the number of refs and two sums of their hashes
                          /files/snapshot_id=<id>    for each f, where the file was, its size and time, rows and checksum

Data is written first and the next commit last, by a rename that fails if that number is taken: of writers that started from one
state, one commits, and the others meet Conflict and start again from the new state. What a crash leaves is data nothing
refers to. Data that is no longer live stays for a while, so frames that read it go on working; expire() removes it.

Deleted objects are written down as dead and left out when objects are read. A batch is written again only when
a given share of it is dead; small batches become one when there are many.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime, timedelta
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict, MissingObjects
from . import files

OBJECTS, DEAD = "hash string, canonical string, b string", "hash string, b string"
#: How long data stays after it was written, if it is not live.
KEPT = timedelta(days=1)
#: Share of a batch that is dead when it is written again; batches and tables of dead objects at most; tries to commit.
SHARE, BATCHES, DEAD_TABLES, TRIES = 0.3, 24, 8, 20
#: Refs of a bucket, about; ranges of keys with a digest in each bucket; buckets at most.
ROWS, RANGES, BUCKETS = 125_000, 16, 16_384
REFS = "id string, hash string, snapshot_id string, collection string"
FILES = "collection string, f int, path string, bytes long, changed long, rows long, checksum string"
INDEX = "struct<name:string,columns:array<string>,options:map<string,string>>"
SNAPSHOTS = (
    "snapshot_id string, seq long, database string, message string, tags array<string>, created_at timestamp, parent_id string, "
    f"doc_count long, new_objects long, consistent boolean, collections map<string,struct<doc_count:bigint,schema_json:string,key:array<string>,indexes:array<{INDEX}>>>"
)
T = TypeVar("T")


def directory(root: str, database: str) -> str:
    safe = re.sub(r"[^A-Za-z0-9_.-]+", "_", database)
    return f"{root.rstrip('/')}/{safe}-{hashlib.sha256(database.encode()).hexdigest()[:8]}"


@dataclass(frozen=True)
class State:
    """What is live: the snapshots table, rows written to each batch, and dead objects by table and batch."""

    number: int = 0
    snapshots: str | None = None
    objects: Mapping[str, int] = field(default_factory=dict)
    dead: Mapping[str, Mapping[str, int]] = field(default_factory=dict)

    def lost(self, batch: str) -> int:
        return sum(x.get(batch, 0) for x in self.dead.values())


class Store:
    def __init__(self, spark: SparkSession, root: str, database: str):
        self.spark, self.database, self.path = spark, database, directory(root, database)

    # --- commits

    def state(self) -> State:
        """The last commit."""
        numbers = [int(name.removesuffix(".json")) for name, *_ in files.listing(self.spark, f"{self.path}/commits")]
        return State(**json.loads(files.read_text(self.spark, f"{self.path}/commits/{max(numbers):012d}.json"))) if numbers else State()

    def commit(self, base: State, snapshots: DataFrame | None = None, objects: Mapping[str, int] | None = None, dead: Mapping[str, Mapping[str, int]] | None = None) -> State:
        """The state after base, with a new list of snapshots, other objects, or both. Conflict if there is one already."""
        name = base.snapshots
        if snapshots is not None:
            name = f"{base.number + 1:012d}-{uuid.uuid4().hex[:8]}"
            snapshots.coalesce(1).write.parquet(f"{self.path}/snapshots/{name}")
        new = State(base.number + 1, name, base.objects if objects is None else objects, base.dead if dead is None else dead)
        if not files.create_text(self.spark, f"{self.path}/commits/{new.number:012d}.json", json.dumps(asdict(new))):
            raise Conflict(f"another writer has changed {self.path}")
        return new

    def retried(self, step: Callable[[State], T]) -> T:
        """step(state), which commits; again from the then current state when another writer came first."""
        for _ in range(TRIES - 1):
            try:
                return step(self.state())
            except Conflict:
                continue
        return step(self.state())

    def expire(self, older: timedelta = KEPT, at: datetime | None = None) -> int:
        """Remove data that is not live and was written longer ago; how many tables."""
        now, limit, gone = self.state(), ((at or datetime.now(UTC)) - older).timestamp() * 1000, 0
        live = {"snapshots": {now.snapshots}, "objects": {f"b={b}" for b in now.objects}, "dead": set(now.dead)}
        for folder, names in live.items():
            for entry, _, _, changed in files.listing(self.spark, f"{self.path}/{folder}"):
                if entry not in names and changed < limit:
                    files.delete(self.spark, f"{self.path}/{folder}/{entry}")
                    gone += 1
        for entry, _, _, changed in files.listing(self.spark, f"{self.path}/commits")[:-1]:
            if changed < limit:
                files.delete(self.spark, f"{self.path}/commits/{entry}")
        return gone

    # --- objects

    def _read(self, schema: str, folder: str, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        base = f"{self.path}/{folder}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{n}" for n in names])

    def _objects(self, state: State, only: list[str] | None = None) -> DataFrame:
        """hash, canonical, b of the live objects, of some batches."""
        batches = sorted(state.objects) if only is None else only
        own = self._read(OBJECTS, "objects", [f"b={b}" for b in batches])
        tables = [name for name, lost in state.dead.items() if not lost.keys().isdisjoint(batches)]
        if not tables:
            return own
        # By hash alone, so that a join by hash that follows needs no other exchange.
        dead = self._read(DEAD, "dead", tables).groupBy("hash").agg(F.collect_set("b").alias("batches"))
        return own.alias("o").join(dead.alias("d"), (F.col("o.hash") == F.col("d.hash")) & F.array_contains("d.batches", F.col("o.b")), "left_anti")

    def objects(self, state: State | None = None) -> DataFrame:
        return self._objects(state or self.state()).select("hash", "canonical")

    def hashes(self, state: State | None = None) -> DataFrame:
        return self.objects(state).select("hash")

    def stage(self, objects: DataFrame, batch: str) -> dict[str, int]:
        """Write distinct objects as a batch, which is not live until a commit names it: its name and rows. None if
        there are no rows."""
        name = f"{batch}-{uuid.uuid4().hex[:8]}"  # a name met before may hold live objects
        objects.select("hash", "canonical").write.option("compression", "zstd").parquet(f"{self.path}/objects/b={name}")
        n = self._read("hash string", "objects", [f"b={name}"]).count()
        if not n:
            files.delete(self.spark, f"{self.path}/objects/b={name}")
        return {name: n} if n else {}

    def unstage(self, batch: Mapping[str, int]) -> None:
        for name in batch:
            files.delete(self.spark, f"{self.path}/objects/b={name}")

    def put(self, encoded: DataFrame, batch: str) -> int:
        """Store the objects that are not there yet, once each; how many those were."""

        def step(base: State) -> int:
            own = self.stage(new_objects(encoded, self.hashes(base)), batch)
            try:
                if own:
                    self.commit(base, **self.tidied(base, {**base.objects, **own}, base.dead))
            except Conflict:
                self.unstage(own)
                raise
            return sum(own.values())

        return self.retried(step)

    def get(self, hashes: DataFrame) -> DataFrame:
        """hash, canonical of the given hashes; one that is not stored is an error."""
        state = self.state()
        missing = hashes.join(self.hashes(state), "hash", "left_anti").select("hash").limit(3).collect()
        if missing:
            raise MissingObjects(f"not stored: {', '.join(r.hash for r in missing)}")
        return hashes.select("hash").distinct().join(self.objects(state), "hash")

    def have(self, hashes: DataFrame) -> DataFrame:
        """hashes with a column stored."""
        return hashes.join(self.hashes().distinct().withColumn("stored", F.lit(True)), "hash", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))

    def bury(self, base: State, hashes: DataFrame, others: bool = False) -> tuple[dict[str, Mapping], int]:
        """Write down objects with these hashes (or with any others) as dead: what commit() needs to know of it, and how
        many they are. Old tables of dead objects become one with the new when there are many."""
        name = uuid.uuid4().hex[:12]
        lost = self._objects(base).select("hash", "b").join(hashes.select("hash").distinct(), "hash", "left_anti" if others else "left_semi")
        lost.write.parquet(f"{self.path}/dead/{name}")
        counts = {r["b"]: r["n"] for r in self._read(DEAD, "dead", [name]).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not counts:
            files.delete(self.spark, f"{self.path}/dead/{name}")
            return {"objects": base.objects, "dead": base.dead}, 0
        dead = {**base.dead, name: counts}
        if len(dead) > DEAD_TABLES:
            whole = uuid.uuid4().hex[:12]
            self._read(DEAD, "dead", list(dead)).write.parquet(f"{self.path}/dead/{whole}")
            dead = {whole: {b: sum(x.get(b, 0) for x in dead.values()) for b in {b for x in dead.values() for b in x}}}
        return self.tidied(base, base.objects, dead), sum(counts.values())

    def tidied(self, base: State, objects: Mapping[str, int], dead: Mapping[str, Mapping[str, int]]) -> dict[str, Mapping]:
        """objects and dead as commit() takes them, after batches that lost too much, or are too many and small, were
        written again as one batch. Batches that lost all go without."""
        new = State(base.number, None, objects, dead)
        again = [b for b, n in objects.items() if SHARE * n <= new.lost(b) < n]
        if len(objects) > BATCHES:
            again += sorted(set(objects) - set(again), key=lambda b: (objects[b] - new.lost(b), b))[: BATCHES // 2]
        gone = {b for b, n in objects.items() if new.lost(b) >= n}
        again = [b for b in again if b not in gone]
        left = {b: n for b, n in objects.items() if b not in gone and b not in again}
        if again:
            left |= self.stage(self._objects(new, again), "merged")
        dead = {name: {b: n for b, n in lost.items() if b in left} for name, lost in dead.items()}
        return {"objects": left, "dead": {name: lost for name, lost in dead.items() if lost}}

    def delete_objects(self, hashes: DataFrame) -> None:
        """Forget these objects; those not stored do not matter."""

        def step(base: State) -> None:
            changed, n = self.bury(base, hashes)
            if n:
                self.commit(base, **changed)

        self.retried(step)

    # --- refs

    def write_refs(self, snapshot_id: str, refs: DataFrame, like: str | None = None) -> None:
        """collection, id, hash (and f) of a snapshot: bucketed by key, in order of ranges of the keys' hashes, and the ranges'
        digests. Ranges and buckets are those of the snapshot `like`, as long as they are of a fair size."""
        n, path, other = refs.count(), f"{self.path}/docrefs/snapshot_id={snapshot_id}", self._digests(like) if like else None
        buckets = min(BUCKETS, 1 << (n // ROWS).bit_length())
        if other and other[0] // 4 <= buckets <= 4 * other[0]:
            buckets = other[0]
        files.delete(self.spark, path)
        r = F.pmod(F.hash("collection", "id"), F.lit(buckets * RANGES))  # of this hash, buckets are the remainder by their number
        f = F.col("f") if "f" in refs.columns else F.lit(None).cast("int").alias("f")
        rows = refs.select(r.alias("r"), "collection", "id", "hash", f).repartition(buckets, "collection", "id").sortWithinPartitions("r", "collection", "id")
        name = f"refs_{uuid.uuid4().hex}"
        rows.write.bucketBy(buckets, "collection", "id").sortBy("r", "collection", "id").option("path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # its files stay
        one, two = F.xxhash64("collection", "id", "hash"), F.xxhash64("hash", "id", "collection")
        digests = self._bucketed(snapshot_id, buckets).groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.sum(one.cast("decimal(20,0)")).alias("one"), F.bit_xor(two).alias("two"))
        files.delete(self.spark, f"{self.path}/digests/snapshot_id={snapshot_id}")
        digests.coalesce(1).write.parquet(f"{self.path}/digests/snapshot_id={snapshot_id}/buckets={buckets}")

    def refs(self, *snapshot_ids: str) -> DataFrame:
        """collection, id, hash (and snapshot_id) of some or all snapshots; of an unknown one, none."""
        there = [name for name, *_ in files.listing(self.spark, f"{self.path}/docrefs")]
        return self._read(REFS, "docrefs", [n for n in there if not snapshot_ids or n.removeprefix("snapshot_id=") in snapshot_ids])

    def bucketed_refs(self, snapshot_id: str) -> DataFrame:
        """r, collection, id, hash, f of a snapshot; grouped by key they need no exchange."""
        return self._bucketed(snapshot_id, self._digests(snapshot_id)[0])

    def _bucketed(self, snapshot_id: str, buckets: int) -> DataFrame:
        """r, collection, id, hash, f of a snapshot; a join by key of two with equally many buckets needs no exchange."""
        name, path = f"refs_{uuid.uuid4().hex}", f"{self.path}/docrefs/snapshot_id={snapshot_id}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} (r INT, collection STRING, id STRING, hash STRING, f INT) USING parquet CLUSTERED BY (collection, id) SORTED BY (r, collection, id) INTO {buckets} BUCKETS LOCATION '{path}'")
        try:
            return self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def _digests(self, snapshot_id: str) -> tuple[int, DataFrame] | None:
        path = f"{self.path}/digests/snapshot_id={snapshot_id}"
        found = [name for name, *_ in files.listing(self.spark, path)]
        if not found:
            return None
        return int(found[0].removeprefix("buckets=")), self.spark.read.schema("r int, n long, one decimal(30,0), two long").parquet(f"{path}/{found[0]}")

    def differing(self, old: str, new: str) -> tuple[DataFrame, DataFrame]:
        """Refs of two snapshots without the ranges of keys whose digests are equal."""
        a, b = self._digests(old), self._digests(new)
        if a is None or b is None or a[0] != b[0]:
            return self.refs(old), self.refs(new)
        both = a[1].alias("a").join(b[1].alias("b"), "r", "full_outer")
        same = F.struct("a.n", "a.one", "a.two").eqNullSafe(F.struct("b.n", "b.one", "b.two"))
        ranges = [r["r"] for r in both.filter(~same).select("r").collect()]  # buckets * RANGES numbers at most
        if not ranges:
            none = self.spark.createDataFrame([], REFS)
            return none, none
        left, right = (self._bucketed(x, a[0]) for x in (old, new))
        if len(ranges) > min(1000, a[0] * RANGES - 1):
            return left, right
        return left.filter(F.col("r").isin(ranges)), right.filter(F.col("r").isin(ranges))

    def write_files(self, snapshot_id: str, read: list[tuple[str, int, str, int, int]]) -> None:
        """Of the files (collection, f, path, bytes, time) that a snapshot's refs were read from, also the rows and a sum
        of their hashes."""
        one = F.xxhash64("collection", "id", "hash").cast("decimal(20,0)")
        sums = self.bucketed_refs(snapshot_id).groupBy("f").agg(F.count(F.lit(1)).alias("rows"), F.sum(one).cast("string").alias("checksum"))
        listed = self.spark.createDataFrame(read, "collection string, f int, path string, bytes long, changed long").join(sums, "f", "left")
        files.delete(self.spark, f"{self.path}/files/snapshot_id={snapshot_id}")
        listed.select("collection", "f", "path", "bytes", "changed", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("checksum", F.lit("0")).alias("checksum")).coalesce(1).write.parquet(f"{self.path}/files/snapshot_id={snapshot_id}")

    def files(self, snapshot_id: str) -> DataFrame:
        """The files that a snapshot was read from; none if that is not known."""
        name = f"snapshot_id={snapshot_id}"
        there = files.exists(self.spark, f"{self.path}/files/{name}")
        return self._read(FILES, "files", [name] if there else [])

    def delete_refs(self, snapshot_id: str) -> None:
        for folder in ("docrefs", "digests", "files"):
            files.delete(self.spark, f"{self.path}/{folder}/snapshot_id={snapshot_id}")

    # --- snapshots

    def snapshots(self, state: State | None = None) -> DataFrame:
        name = (state or self.state()).snapshots
        return self._read(SNAPSHOTS, "snapshots", [name] if name else [])


def new_objects(encoded: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct objects of encoded(hash, canonical) that stored(hash) lacks. Both sides meet on hash once."""
    return encoded.select("hash", "canonical").dropDuplicates(["hash"]).join(stored.select("hash"), "hash", "left_anti")
