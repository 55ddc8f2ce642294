"""A database: a directory with one table a collection, of Parquet or of JSON lines.

Keys and indexes may be declared in the file _declared.json beside the tables; restores write it. JSON
documents have no schema: snapshots, restores and exports take them line by line, whatever their fields.
read() gives them as a typed table for queries.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotFound
from ..functions.canon import canonical, content_hash, id_key
from ..functions.json_text import encoded_documents
from . import files

_SUFFIXES = (".parquet", ".json", ".jsonl")
#: What a damaged footer or file raises, by whether Spark wraps it.
UNREADABLE = (PySparkException, Py4JJavaError)


class Database:
    """Reads the tables under a directory. keys names each table's key columns, or paths in documents; default: the
    declared ones, else the first column, or _id."""

    def __init__(self, spark: SparkSession, path: str, keys: Mapping[str, Sequence[str]] | None = None, only: Sequence[str] | None = None):
        self.spark, self.path, self.keys, self.only = spark, path.rstrip("/"), dict(keys or {}), only

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    def entries(self) -> dict[str, str]:
        """Collection -> path, sorted."""
        found = {}
        for entry, *_ in files.listing(self.spark, self.path):
            stem = next((entry.removesuffix(s) for s in _SUFFIXES if entry.endswith(s)), entry)
            if self.only is None or stem in self.only:
                found[stem] = f"{self.path}/{entry}"
        return found

    def names(self) -> list[str]:
        return list(self.entries())

    def location(self, collection: str) -> str:
        found = self.entries().get(collection)
        if found is None:
            raise NotFound(f"no collection {collection} in {self.path}")
        return found

    def is_json(self, collection: str) -> bool:
        return self.location(collection).endswith((".json", ".jsonl"))

    def read(self, collection: str, pinned: Sequence[str] | None = None, schema_json: str | None = None) -> DataFrame:
        """The whole table, or exactly the pinned files of it; by a schema, or that of its files."""
        path, reader = self.location(collection), self.spark.read
        if schema_json:
            reader = reader.schema(T.StructType.fromJson(json.loads(schema_json)))
        if path.endswith((".json", ".jsonl")):
            return reader.json(list(pinned or [path]))
        return reader.parquet(*pinned or [path])

    def documents(self, collection: str, pinned: Sequence[str] | None = None) -> DataFrame:
        """The column document: each JSON document's line as it stands."""
        lines = self.spark.read.text(list(pinned) if pinned else self.location(collection))
        return lines.select(F.col("value").alias("document")).filter(F.trim("document") != "")

    def rows(self, collection: str, pinned: Sequence[str] | None = None, schema_json: str | None = None) -> DataFrame:
        """What is counted and copied: documents of JSON, rows of Parquet."""
        return self.documents(collection, pinned) if self.is_json(collection) else self.read(collection, pinned, schema_json)

    def encoded(self, collection: str, pinned: Sequence[str] | None = None, schema_json: str | None = None) -> DataFrame:
        """id, hash, canonical and file (where it lies) of every row or document."""
        own = self.rows(collection, pinned, schema_json)
        if self.is_json(collection):
            return encoded_documents(own.select("document", F.col("_metadata.file_path").alias("file")), self.key(collection))
        # A table may have a column of its own that is called _metadata.
        file = F.input_file_name() if "_metadata" in own.columns else F.col("_metadata.file_path")
        own = own.select(id_key(own, self.key(collection, own)).alias("id"), canonical(own).alias("canonical"), file.alias("file"))
        return own.select("id", content_hash(F.col("canonical")).alias("hash"), "canonical", "file")

    def schema_json(self, collection: str, pinned: Sequence[str] | None = None) -> str:
        """Of a table; empty for JSON documents."""
        return "" if self.is_json(collection) else self.read(collection, pinned).schema.json()

    def key(self, collection: str, df: DataFrame | None = None) -> list[str]:
        own = self.keys.get(collection) or self.declared().get(collection, {}).get("key")
        if not own:
            own = ["_id"] if self.is_json(collection) else [(df if df is not None else self.read(collection)).columns[0]]
        return list(own)

    def declared(self) -> dict[str, dict]:
        """Collection -> {"key": columns, "indexes": [{"name", "columns", "options"}]}."""
        return json.loads(files.read_text(self.spark, f"{self.path}/_declared.json") or "{}")

    def declare(self, collection: str, key: Sequence[str], indexes: Sequence[Mapping] = ()) -> None:
        known = self.declared() | {collection: {"key": list(key), "indexes": [dict(i) for i in indexes]}}
        files.swap_text(self.spark, f"{self.path}/_declared.json", json.dumps(known))

    def pin(self) -> dict[str, list[tuple[str, int, int]]]:
        """Every collection's files, with size and time: what a point-in-time read reads, and whether it held."""
        return {c: files.data_files(self.spark, p) for c, p in self.entries().items()}

    def stats(self) -> DataFrame:
        """collection, doc_count, storage_size, sorted; a table of which any file cannot be read counts none."""
        tables, sizes = {}, {}
        for c, p in self.entries().items():
            try:
                tables[c] = self.rows(c)
                sizes[c] = sum(size for _, size, _ in files.data_files(self.spark, p))
            except UNREADABLE:  # no schema can be read; that must not hide the others
                sizes[c] = 0
        return self.spark.createDataFrame([(c, n, sizes[c]) for c, n in self._counted(tables).items()] + [(c, 0, 0) for c in sizes if c not in tables], "collection string, doc_count long, storage_size long").orderBy("collection")

    def _counted(self, tables: Mapping[str, DataFrame]) -> dict[str, int]:
        """Rows of each table, in one job; if that fails, a job a table, and 0 for those that fail."""
        if not tables:
            return {}
        try:
            return {r["collection"]: r["doc_count"] for r in counts(tables).collect()}
        except UNREADABLE:
            if len(tables) == 1:
                return dict.fromkeys(tables, 0)
            return {c: n for t in tables for c, n in self._counted({t: tables[t]}).items()}

    def create(self, collection: str, schema: T.StructType | str) -> None:
        """An empty table of that schema."""
        if collection in self.entries():
            raise ValueError(f"collection {collection} is there already")
        self.spark.createDataFrame([], schema).write.parquet(f"{self.path}/{collection}.parquet")

    def drop(self, collection: str) -> None:
        files.delete(self.spark, self.location(collection))

    def replace(self, collection: str, df: DataFrame, schema_json: str | None = None) -> None:
        """df becomes the table: written beside, then put in place, so df may read the table itself. With an empty
        schema_json, df(document) is lines of JSON."""
        old = self.entries().get(collection)
        staged = f"{self.path}/_staged-{collection}"
        files.delete(self.spark, staged)
        write(df, staged, schema_json)
        self.put(collection, staged, old, schema_json)

    def put(self, collection: str, staged: str, old: str | None = None, schema_json: str | None = None) -> None:
        """A written table becomes the collection's, in place of old."""
        path = f"{self.path}/{collection}{'.json' if schema_json == '' else '.parquet'}"
        files.swap_in(self.spark, staged, path)
        if old and old != path:  # it had another suffix
            files.delete(self.spark, old)


def write(df: DataFrame, path: str, schema_json: str | None = None) -> None:
    """As Parquet; with an empty schema_json, df(document) as lines of text."""
    if schema_json == "":
        df.select("document").write.text(path)
    else:
        df.write.parquet(path)


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """collection, doc_count of several tables, zero for empty ones, in one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("doc_count")).select(F.lit(c).alias("collection"), "doc_count") for c, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
