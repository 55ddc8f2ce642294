"""A repository: snapshots of a database, with history, diff, restore and garbage collection."""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadRequest, MissingObjects, NotFound
from ..functions.canon import decoded
from ..functions.json_text import document_key, plain_document
from ..operators import checks, diff, history, mutate
from ..sources import files
from ..sources.database import UNREADABLE, Database, write
from ..sources.store import SNAPSHOTS, State, Store

ROWS = "collection string, id string, hash string, canonical string, file string"
REFS = "collection string, id string, hash string, file string"
Pinned = Mapping[str, list[tuple[str, int, int]]]
#: Reads of a database whose files change meanwhile, before a snapshot of it is flagged or fails.
READS = 3


@dataclass
class Read:
    """What a snapshot is taken from: the pinned files, how each collection is read, the number of each file, and of
    which files the refs are those of the parent."""

    pinned: Pinned
    schemas: dict[str, str]
    keys: dict[str, list[str]]
    numbers: dict[tuple[str, str], int] = field(default_factory=dict)
    same: set[int] = field(default_factory=set)
    consistent: bool = False

    def new(self) -> dict[str, list[str]]:
        """Files to read, by collection; a collection without files is read for nothing."""
        own = {c: [p for p, *_ in listed if self.numbers[c, p] not in self.same] for c, listed in self.pinned.items()}
        return {c: paths for c, paths in own.items() if paths}

    def listed(self) -> list[tuple[str, int, str, int, int]]:
        return [(c, self.numbers[c, p], p, size, changed) for c, own in self.pinned.items() for p, size, changed in own]


def scanned(db: Database, only: Mapping[str, Sequence[str] | None] | None = None, schemas: Mapping[str, str] | None = None) -> DataFrame:
    """collection, id, hash, canonical, file of every row of every table, or of some files by collection: one frame, one
    job."""
    out = db.spark.createDataFrame([], ROWS)
    for name, paths in (only if only is not None else dict.fromkeys(db.names())).items():
        own = db.encoded(name, paths, (schemas or {}).get(name))
        out = out.unionByName(own.select(F.lit(name).alias("collection"), "id", "hash", "canonical", "file"))
    return out


def _distinct(texts: DataFrame, schemas: Mapping[str, str]) -> DataFrame:
    """One row a hash of texts(collection, hash, ...) in which no key of a collection repeats. A text holds its key, so only
    collections that may hold equal texts meet: those with the same fields, and with documents all."""
    fields = {c: tuple(f["name"] for f in json.loads(s)["fields"]) if s else None for c, s in schemas.items()}
    found = list(fields.values())
    alike = [c for c, own in fields.items() if len(found) > 1 and (None in found or found.count(own) > 1)]
    if not alike:
        return texts
    own = F.col("collection").isin(alike)
    return texts.filter(~own).unionByName(texts.filter(own).dropDuplicates(["hash"]))


def live_refs(db: Database) -> DataFrame:
    """Refs of the database as it is, lazily; nothing is stored and canonical texts are not kept."""
    return scanned(db).select("collection", "id", "hash")


class Repository:
    """The snapshots of one database in the store under root."""

    def __init__(self, spark: SparkSession, root: str, database: str):
        self.spark, self.root, self.store = spark, root, Store(spark, root, database)

    # --- create

    def create(self, db: Database, message: str = "", *, now: datetime | None = None, snapshot_id: str | None = None, indexes: Mapping[str, Sequence[Mapping]] | None = None, full: bool = False) -> Row:
        """Take a snapshot of the files that are there now. Indexes default to the declared ones.

        A file that the parent was read from, and that has the same size and time since (its table the same schema and
        key), is not read again: its refs are the parent's. With full, all files are read. Of the hashes of the rest that are not
        stored, one row each is chosen, and only the files that hold such rows are read again for their texts.

        Files that vanish or change while they are read are read again as they then are; if they go on changing, the
        snapshot is flagged as not consistent. What other writers store or delete until this snapshot is committed is
        taken into account.
        """
        now, snapshot_id = now or datetime.now(UTC).replace(tzinfo=None), snapshot_id or uuid.uuid4().hex
        start = self.store.state()
        self._require_new(snapshot_id, start)
        latest = history.latest(self.store.snapshots(start)).collect()
        parent = latest[0] if latest and not full else None
        staging, staged = f"{self.store.path}/_staging-{uuid.uuid4().hex[:12]}", {}
        try:
            read, rows = self._read(db, parent, staging)
            of_file = self.spark.createDataFrame([(c, files.uri(self.spark, p), f) for (c, p), f in read.numbers.items()], "collection string, file string, f int")
            of_file = F.broadcast(of_file)  # a row a file; by an exchange all rows of a file would go to one task
            refs = rows.join(of_file, ["collection", "file"], "left").select("collection", "id", "hash", "f")
            self.store.write_refs(snapshot_id, refs.unionByName(self._same_refs(parent, read)) if read.same else refs, latest[0]["snapshot_id"] if latest else None)
            own = self.store.bucketed_refs(snapshot_id)
            checks.require_unique(own, ["collection", "id"], "the database")
            counted = {r["collection"]: r["n"] for r in own.groupBy("collection").agg(F.count(F.lit(1)).alias("n")).collect()}
            self.store.write_files(snapshot_id, read.listed())
            declared, collections = db.declared(), {}
            for name in read.pinned:
                given = (indexes or {}).get(name, declared.get(name, {}).get("indexes", []))
                about = [(i["name"], list(i["columns"]), i.get("options") or None) for i in given]
                collections[name] = (counted.get(name, 0), read.schemas[name], read.keys[name], about)

            def step(base: State) -> None:
                self._require_new(snapshot_id, base)
                old = self.store.snapshots(base)
                if staged.get("for") != (base.objects, base.dead):
                    self.store.unstage(staged.get("batch", {}))
                    # The parent's objects are there as long as the parent is.
                    safe = not read.same or not old.filter(F.col("snapshot_id") == parent["snapshot_id"]).isEmpty()
                    asked = rows if safe else own.join(of_file, ["collection", "f"])
                    staged.update({"batch": self._new_batch(db, read, asked, base, f"{staging}/new-{base.number}", snapshot_id), "for": (base.objects, base.dead)})
                last = history.latest(old).collect()
                seq = (old.agg(F.max("seq")).first()[0] or 0) + 1
                row = (snapshot_id, seq, self.store.database, message, [], now, last[0]["snapshot_id"] if last else None, sum(counted.values()), sum(staged["batch"].values()), read.consistent, collections)
                objects = self.store.tidied(base, {**base.objects, **staged["batch"]}, base.dead)
                self.store.commit(base, old.unionByName(self.spark.createDataFrame([row], SNAPSHOTS)), **objects)

            self.store.retried(step)
        except Exception:
            self.store.unstage(staged.get("batch", {}))
            if self.store.snapshots().filter(F.col("snapshot_id") == snapshot_id).isEmpty():
                self.store.delete_refs(snapshot_id)
            raise
        finally:
            files.delete(self.spark, staging)
        return self.get(snapshot_id)

    def _require_new(self, snapshot_id: str, base: State) -> None:
        if not self.store.snapshots(base).filter(F.col("snapshot_id") == snapshot_id).isEmpty():
            raise BadRequest(f"snapshot {snapshot_id} is there already")

    def _read(self, db: Database, parent: Row | None, staging: str) -> tuple[Read, DataFrame]:
        """Pin the database's files and write down collection, id, hash and file of the rows of those that are new."""
        for attempt in range(READS):
            read, path = self._planned(db, parent), f"{staging}/refs-{attempt}"
            try:
                scanned(db, read.new(), read.schemas).select("collection", "id", "hash", "file").write.parquet(path)
            except UNREADABLE:
                if attempt == READS - 1 or db.pin() == read.pinned:
                    raise
                continue
            read.consistent = db.pin() == read.pinned
            if read.consistent:
                break
        return read, self.spark.read.schema(REFS).parquet(path)

    def _planned(self, db: Database, parent: Row | None) -> Read:
        pinned = db.pin()
        keys = {c: db.key(c) for c in pinned}
        read = Read(pinned, {c: db.schema_json(c, [p for p, *_ in own] or None) for c, own in pinned.items()}, keys)
        before = parent["collections"] if parent else {}
        known = {(r["collection"], r["path"]): r for r in self.store.files(parent["snapshot_id"]).collect()} if parent else {}  # a row a file
        unused = itertools.count(max((r["f"] for r in known.values()), default=-1) + 1)
        for c, own in pinned.items():
            alike = c in before and before[c]["schema_json"] == read.schemas[c] and list(before[c]["key"]) == keys[c]
            for path, size, changed in own:
                r = known.get((c, path))
                same = alike and r is not None and (r["bytes"], r["changed"]) == (size, changed)
                read.numbers[c, path] = r["f"] if same else next(unused)
                read.same |= {r["f"]} if same else set()
        return read

    def _same_refs(self, parent: Row, read: Read) -> DataFrame:
        """The parent's refs from files that are the same."""
        own = self.store.bucketed_refs(parent["snapshot_id"]).select("collection", "id", "hash", "f")
        gone = {r["f"] for r in self.store.files(parent["snapshot_id"]).select("f").collect()} - read.same
        if len(gone) <= 1000:
            return own.filter(~F.col("f").isin(*gone)) if gone else own
        return own.join(self.spark.createDataFrame([(f,) for f in sorted(read.same)], "f int"), "f", "left_semi").select("collection", "id", "hash", "f")

    def _new_batch(self, db: Database, read: Read, rows: DataFrame, base: State, staging: str, snapshot_id: str) -> dict[str, int]:
        """Stage the objects of rows(collection, id, hash, file) that are not stored."""
        if not base.objects and not read.same:
            texts = scanned(db, read.new(), read.schemas)
            batch = self.store.stage(_distinct(texts, read.schemas), snapshot_id)
            if db.pin() == read.pinned:
                return batch
            self.store.unstage(batch)  # files have changed, in which keys may repeat
            return self.store.stage(texts.dropDuplicates(["hash"]), snapshot_id)
        new = rows.join(self.store.hashes(base), "hash", "left_anti").groupBy("hash").agg(F.min(F.struct("collection", "file")).alias("at"))
        new.select("hash", "at.collection", "at.file").write.parquet(staging)
        new = self.spark.read.schema("hash string, collection string, file string").parquet(staging)
        only: dict[str, list[str]] = {}
        paths = {(c, files.uri(self.spark, p)): p for c, p in read.numbers}
        for r in new.select("collection", "file").distinct().collect():  # files, which are pinned
            only.setdefault(r["collection"], []).append(paths.get((r["collection"], r["file"]), r["file"]))
        if not only:
            return {}
        texts = scanned(db, {c: sorted(own) for c, own in only.items()}, read.schemas).join(new, "hash", "left_semi")  # by hash alone, as duplicates are dropped by it
        return self.store.stage(texts.dropDuplicates(["hash"]), snapshot_id)

    def files(self, text: str, live: Database | None = None) -> DataFrame:
        """collection, path, bytes, rows and checksum (of keys and hashes) of the files that a snapshot was read from; with live,
        also state: same, changed or gone, by size and time."""
        own = self.store.files(self.get(text)["snapshot_id"])
        if live is None:
            return own.select("collection", "path", "bytes", "rows", "checksum")
        there = self.spark.createDataFrame([(c, *x) for c, listed in live.pin().items() for x in listed], "collection string, path string, bytes_ long, changed_ long")
        state = F.when(F.col("bytes_").isNull(), "gone").when((F.col("bytes_") == F.col("bytes")) & (F.col("changed_") == F.col("changed")), "same").otherwise("changed")
        return own.join(there, ["collection", "path"], "left").select("collection", "path", "bytes", "rows", "checksum", state.alias("state"))

    # --- history

    def log(self, order: str = "desc") -> DataFrame:
        return history.ordered(self.store.snapshots(), order)

    def get(self, text: str, resolve_tags: bool = False) -> Row:
        return history.find(self.store.snapshots(), text, resolve_tags)

    def tag(self, text: str, tag: str) -> Row:
        from ..functions.columns import tag_append

        if not tag:
            raise BadRequest("a tag cannot be empty")
        own = self.get(text)["snapshot_id"]
        changed = F.when(F.col("snapshot_id") == own, tag_append(F.col("tags"), F.lit(tag))).otherwise(F.col("tags"))
        self.store.retried(lambda base: self.store.commit(base, self.store.snapshots(base).withColumn("tags", changed)))
        return self.get(own)

    # --- diff

    def diff(self, old: str, new: str | None = None, live: Database | None = None) -> DataFrame:
        """Changes from one snapshot to another, or to the database as it is. Of two snapshots, only ranges of keys
        whose digests differ are read."""
        if (new is None) == (live is None):
            raise BadRequest("compare with a snapshot or with a live database")
        a = self.get(old)["snapshot_id"]
        if live is not None:
            return diff.diff(self.store.refs(a), live_refs(live))
        return diff.diff(*self.store.differing(a, self.get(new)["snapshot_id"]))

    def diff_content(self, old: str, new: str) -> DataFrame:
        return diff.content(self.diff(old, new), self.store.objects())

    # --- restore

    def rows(self, text: str, collection: str) -> DataFrame:
        """A collection as it was: typed rows, or the column document."""
        snapshot = self.get(text)
        if collection not in snapshot["collections"]:
            raise NotFound(f"no collection {collection} in snapshot {snapshot['snapshot_id']}")
        refs = self.store.refs(snapshot["snapshot_id"]).filter(F.col("collection") == collection)
        return typed(refs.select("hash").join(self.store.objects(), "hash"), snapshot["collections"][collection]["schema_json"])

    def restore(self, text: str, target: Database, collection: str | None = None, mode: str = "insert", safety: Repository | None = None, now: datetime | None = None) -> DataFrame:
        """Write a snapshot's collections, or one, into target; collection, docs written.

        insert: a key that is there is an error. upsert: overwritten by key. drop: the collection is replaced,
        after a safety snapshot of what is to be replaced (in `safety`, a repository of target; default: one
        beside this), by the keys that target or else the snapshot knows. Everything is written and checked
        before the first collection is put in place; target then knows the keys and indexes too.
        """
        if mode not in ("insert", "upsert", "drop"):
            raise BadRequest(f"unknown mode {mode!r}")
        snapshot = self.get(text)
        names = [collection] if collection else sorted(snapshot["collections"])
        if collection and collection not in snapshot["collections"]:
            raise NotFound(f"no collection {collection} in snapshot {snapshot['snapshot_id']}")
        there, there_at = target.names(), target.entries()
        staging = f"{target.path}/_restore-{uuid.uuid4().hex[:8]}"
        try:
            texts = self._texts(snapshot, names, f"{staging}/texts")
            if mode == "drop" and there:
                replaced = [n for n in names if n in there]
                keys = {n: list(snapshot["collections"][n]["key"]) for n in replaced} | {n: d["key"] for n, d in target.declared().items()} | target.keys
                own = Database(self.spark, target.path, {n: k for n, k in keys.items() if n in replaced and (target.is_json(n) or set(k) <= set(target.read(n).columns))}, replaced)
                (safety or Repository(self.spark, self.root, target.path)).create(own, f"before restore of {snapshot['snapshot_id']}", now=now)
            for name in names:
                about = snapshot["collections"][name]
                schema, key = about["schema_json"], list(about["key"])
                own = typed(texts.filter(F.col("collection") == name), schema)
                if mode != "drop" and name in there:
                    if target.is_json(name) != (schema == ""):
                        raise BadRequest(f"{name} is of JSON documents on one side only")
                    merge = mutate.insert if mode == "insert" else mutate.upsert
                    if schema == "":
                        # Keys of canonical texts, as documents that come from them would only give the same again.
                        keyed = texts.filter(F.col("collection") == name).select(plain_document(F.col("canonical")).alias("document"), document_key(F.col("canonical"), key).alias("id"))
                        own = merge(mutate.keyed_documents(target.documents(name), key), keyed, ["id"]).select("document")
                    else:
                        own = merge(target.read(name), own, key)
                write(own, f"{staging}/tables/{name}", schema)
                for index in about["indexes"] or []:
                    options = index["options"] or {}
                    if options.get("unique") == "true" and schema:
                        written = self.spark.read.schema(own.schema).parquet(f"{staging}/tables/{name}")
                        if not checks.unique_violations(written, index["columns"], options.get("sparse") == "true").limit(1).isEmpty():
                            raise BadRequest(f"unique index {index['name']} of {name} would be violated")
            docs = texts.groupBy("collection").agg(F.count(F.lit(1)).alias("docs"))
            docs = self.spark.createDataFrame([(n,) for n in names], "collection string").join(docs, "collection", "left")
            docs = [tuple(r) for r in docs.select("collection", F.coalesce("docs", F.lit(0))).collect()]
            for name in names:
                about = snapshot["collections"][name]
                target.put(name, f"{staging}/tables/{name}", there_at.get(name), about["schema_json"])
                target.declare(name, about["key"], [{"name": i["name"], "columns": list(i["columns"]), "options": i["options"]} for i in about["indexes"] or []])
        finally:
            files.delete(self.spark, staging)
        return self.spark.createDataFrame(docs, "collection string, docs long")

    def _texts(self, snapshot: Row, names: Sequence[str], path: str) -> DataFrame:
        """collection, canonical of the snapshot's rows in these collections, written by collection: one join of its refs
        with the objects, however many collections there are. Rows that are not stored are an error."""
        refs, objects = self.store.refs(snapshot["snapshot_id"]).filter(F.col("collection").isin(*names)), self.store.objects()
        found = refs.select("collection", "hash").join(objects, "hash", "left").select("collection", "canonical")
        if len(names) == 1:  # nothing to sort by
            found.select("canonical").write.parquet(path)
            texts = self.spark.read.schema("canonical string").parquet(path).withColumn("collection", F.lit(names[0]))
        else:
            found.write.partitionBy("collection").parquet(path)
            texts = self.spark.read.schema("canonical string, collection string").parquet(path)
        if not texts.filter("canonical is null").isEmpty():
            checks.require_complete(refs, objects)
            raise MissingObjects(f"rows of {snapshot['snapshot_id']} were not stored while they were read")
        return texts

    # --- garbage collection

    def gc(self, keep_last: int = history.KEEP) -> DataFrame:
        """Prune snapshots neither tagged nor among the last; delete objects that only those referred to. One row of
        counts. Refs go after the commit, and data that has not been live for a while."""

        def step(base: State) -> tuple[list[str], int]:
            snapshots = self.store.snapshots(base)
            kept = history.kept(snapshots, keep_last)
            ids = [r["snapshot_id"] for r in kept.select("snapshot_id").collect()]
            gone = [r["snapshot_id"] for r in history.pruned(snapshots, kept).select("snapshot_id").collect()]
            changed, swept = self.store.bury(base, self.store.refs(*ids) if ids else self.spark.createDataFrame([], "hash string"), others=True)
            if gone or swept:
                self.store.commit(base, kept if gone else None, **changed)
            return gone, swept

        gone, swept = self.store.retried(step)
        for snapshot_id in gone:
            self.store.delete_refs(snapshot_id)
        self.store.expire()
        return self.spark.createDataFrame([(len(gone), swept)], "snapshots_deleted long, objects_deleted long")


def typed(texts: DataFrame, schema_json: str) -> DataFrame:
    """Rows of a schema, or documents, from texts(canonical)."""
    if not schema_json:
        return texts.select(plain_document(F.col("canonical")).alias("document"))
    return decoded(texts, T.StructType.fromJson(json.loads(schema_json)))
