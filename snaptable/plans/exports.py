"""Full copies of a database, with a catalog.

A copy describes itself: its _manifest.json holds, for each collection, the schema, key and indexes, and for each
file the bytes, rows and a sum of the rows' hashes. JSON copies are canonical texts, which keep every type.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadRequest, Damaged, NotFound
from ..functions.canon import canonical
from ..functions.json_text import canonical_document
from ..operators import mutate
from ..sources import files
from ..sources.database import UNREADABLE, Database, write
from .repository import typed

CATALOG = "name string, database string, format string, collections array<string>, doc_count long, bytes long, created_at timestamp"


def _summed(text: str = "text") -> list:
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(text).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("checksum")]


class Exports:
    """Copies under root, one directory each, and the table `catalog`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def catalog(self) -> DataFrame:
        path = f"{self.root}/catalog.parquet"
        # Between the two renames of a swap, the old catalog stands aside; putting it back is for writers.
        there = next((p for p in (path, files.aside(path)) if files.exists(self.spark, p)), None)
        return self.spark.read.schema(CATALOG).parquet(there) if there else self.spark.createDataFrame([], CATALOG)

    def _save(self, catalog: DataFrame) -> None:
        staged = f"{self.root}/_catalog"
        files.delete(self.spark, staged)
        catalog.coalesce(1).write.parquet(staged)
        files.swap_in(self.spark, staged, f"{self.root}/catalog.parquet")

    def _path(self, name: str) -> str:
        return f"{self.root}/exports/{name}"

    # --- write

    def create(self, db: Database, name: str, format: str = "parquet", now: datetime | None = None) -> None:
        """Copy every table as Parquet or gzip JSON lines, with a manifest, and add a row to the catalog. JSON documents
        are copied as such in both formats."""
        if format not in ("parquet", "json"):
            raise BadRequest(f"unknown format {format!r}")
        if not self.catalog().filter(F.col("name") == name).isEmpty():
            raise BadRequest(f"export {name} is there already")
        path, collections, declared = self._path(name), {}, db.declared()
        files.delete(self.spark, path)
        for c in db.names():
            schema, df = db.schema_json(c), db.rows(c)
            form = "json" if format == "json" or not schema else "parquet"
            if form == "json":
                texts = df.select(canonical_document(F.col("document")) if not schema else canonical(df))
                texts.write.option("compression", "gzip").text(f"{path}/{c}.json")
            else:
                df.write.parquet(f"{path}/{c}.parquet")
            collections[c] = {"form": form, "schema": schema, "key": db.key(c), "indexes": declared.get(c, {}).get("indexes", [])}
        self._count(path, collections)
        manifest = {"database": db.name, "format": format, "collections": collections}
        files.swap_text(self.spark, f"{path}/_manifest.json", json.dumps(manifest))
        size = sum(f["bytes"] for about in collections.values() for f in about["files"].values())
        row = (name, db.name, format, list(collections), sum(about["rows"] for about in collections.values()), size, now or datetime.now(UTC).replace(tzinfo=None))
        self._save(self.catalog().unionByName(self.spark.createDataFrame([row], CATALOG)))

    def _texts(self, path: str, collection: str, about: dict) -> DataFrame:
        """text and file of a copied collection's rows."""
        at = f"{path}/{collection}.{about['form']}"
        if about["form"] == "json":
            return self.spark.read.text(at).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"))
        df = self.spark.read.schema(T.StructType.fromJson(json.loads(about["schema"]))).parquet(at)
        name = F.element_at(F.split(F.input_file_name(), "/"), -1) if "_metadata" in df.columns else F.col("_metadata.file_name")
        return df.select(canonical(df).alias("text"), name.alias("file"))

    def _count(self, path: str, collections: dict[str, dict]) -> None:
        """Add files, rows and checksum to what is known of collections: one job reads back what was written."""
        found: dict[str, dict] = {c: {} for c in collections}
        parts = [self._texts(path, c, about).select(F.lit(c).alias("collection"), "file", "text") for c, about in collections.items()]
        if parts:
            every = parts[0]
            for p in parts[1:]:
                every = every.unionByName(p)
            for r in every.groupBy("collection", "file").agg(*_summed()).collect():  # a row a file
                found[r["collection"]][r["file"]] = r
        for c, about in collections.items():
            sizes = self._sizes(path, c, about)
            rows = {f: found[c][f] if f in found[c] else {"rows": 0, "checksum": "0"} for f in sizes}
            about["files"] = {f: {"bytes": n, "rows": rows[f]["rows"], "checksum": rows[f]["checksum"]} for f, n in sizes.items()}
            about["rows"], about["checksum"] = sum(r["rows"] for r in rows.values()), str(sum(int(r["checksum"]) for r in rows.values()))

    def _sizes(self, path: str, collection: str, about: dict) -> dict[str, int]:
        return {p.rsplit("/", 1)[-1]: n for p, n, _ in files.data_files(self.spark, f"{path}/{collection}.{about['form']}")}

    # --- read

    def get(self, name: str):
        row = self.catalog().filter(F.col("name") == name).first()
        if row is None:
            raise NotFound(f"no export {name}")
        return row

    def manifest(self, name: str) -> dict:
        self.get(name)
        text = files.read_text(self.spark, f"{self._path(name)}/_manifest.json")
        if text is None:
            raise Damaged(f"export {name} has no manifest")
        return json.loads(text)

    def rows(self, name: str, collection: str) -> DataFrame:
        """A copied collection: typed rows, or the column document."""
        about = self.manifest(name)["collections"].get(collection)
        if about is None:
            raise NotFound(f"no collection {collection} in export {name}")
        return self._rows(name, collection, about)

    def _rows(self, name: str, collection: str, about: dict) -> DataFrame:
        if about["form"] == "json":
            return typed(self._texts(self._path(name), collection, about).select(F.col("text").alias("canonical")), about["schema"])
        return self.spark.read.schema(T.StructType.fromJson(json.loads(about["schema"]))).parquet(f"{self._path(name)}/{collection}.parquet")

    def verify(self, name: str, collections: list[str] | None = None) -> DataFrame:
        """collection, file, problem of what is not as the manifest says: missing, extra, bytes, unreadable, or content."""
        path, problems = self._path(name), []
        for c, about in self.manifest(name)["collections"].items():
            if collections is not None and c not in collections:
                continue
            wanted, sizes = about["files"], self._sizes(path, c, about)
            problems += [(c, f, "missing") for f in wanted.keys() - sizes] + [(c, f, "extra") for f in sizes.keys() - wanted]
            problems += [(c, f, "bytes") for f in wanted.keys() & sizes if sizes[f] != wanted[f]["bytes"]]
            there = self._texts(path, c, about) if sizes else None
            for f in self._differing(there, wanted.keys() & sizes, wanted) if there is not None else []:
                if (c, f, "bytes") not in problems:
                    problems.append((c, f, "content"))
        return self.spark.createDataFrame(sorted(problems), "collection string, file string, problem string")

    def _differing(self, texts: DataFrame, names: set[str], wanted: dict) -> list[str]:
        """Of these files, those whose rows are not what was written; if the job fails, those that fail alone."""
        try:
            found = {r["file"]: (r["rows"], r["checksum"]) for r in texts.filter(F.col("file").isin(*names)).groupBy("file").agg(*_summed()).collect()} if names else {}
        except UNREADABLE:
            return list(names) if len(names) == 1 else [f for n in names for f in self._differing(texts, {n}, wanted)]
        return [f for f in names if found.get(f, (0, "0")) != (wanted[f]["rows"], wanted[f]["checksum"])]

    def restore(self, name: str, target: Database, drop: bool = False) -> None:
        """Write an export's tables into target, with keys and indexes; without drop, keys that are there are an error.

        Every table is staged and what was staged is compared with the manifest; only when all are whole does the first
        take its place. Otherwise it is an error that names the damaged files, and target stays as it was.
        """
        manifest, path, there = self.manifest(name), self._path(name), target.entries()
        staging = f"{target.path}/_import-{uuid.uuid4().hex[:8]}"
        try:
            for c, about in manifest["collections"].items():
                if self._sizes(path, c, about) != {f: x["bytes"] for f, x in about["files"].items()} or not self._staged_whole(name, c, about, f"{staging}/{c}"):
                    found = [f"{r['file']} of {r['collection']} ({r['problem']})" for r in self.verify(name, [c]).limit(5).collect()]
                    raise Damaged(f"export {name} is damaged: {', '.join(found) or c}")
            for c, about in manifest["collections"].items():
                if drop or c not in there:
                    continue
                own, key = self._staged(f"{staging}/{c}", about["schema"]), target.keys.get(c) or about["key"]
                if target.is_json(c) != (about["schema"] == ""):
                    raise BadRequest(f"{c} is of JSON documents on one side only")
                if about["schema"]:
                    merged = mutate.insert(target.read(c), own, key)
                else:
                    merged = mutate.insert(*[mutate.keyed_documents(d, key) for d in (target.documents(c), own)], ["id"]).select("document")
                write(merged, f"{staging}/_merged/{c}", about["schema"])
            for c, about in manifest["collections"].items():
                target.put(c, f"{staging}/{c}" if drop or c not in there else f"{staging}/_merged/{c}", there.get(c), about["schema"])
                target.declare(c, about["key"], about["indexes"])
        finally:
            files.delete(self.spark, staging)

    def _staged(self, path: str, schema: str) -> DataFrame:
        if not schema:
            return self.spark.read.text(path).select(F.col("value").alias("document"))
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(path)

    def _staged_whole(self, name: str, collection: str, about: dict, path: str) -> bool:
        """Write a copied collection's rows to path; whether these are the rows that were copied."""
        try:
            write(self._rows(name, collection, about), path, about["schema"])
            own = self._staged(path, about["schema"])
            found = own.select((canonical(own) if about["schema"] else canonical_document(F.col("document"))).alias("text")).agg(*_summed()).first()
        except UNREADABLE:
            return False
        return (found["rows"], found["checksum"]) == (about["rows"], about["checksum"])

    def delete(self, name: str) -> None:
        """Remove the copy, which may be gone, and its row."""
        self.get(name)
        self._save(self.catalog().filter(F.col("name") != name))
        files.delete(self.spark, self._path(name))
