"""Registered queries over the given tables, each with the SQL that it must equal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.canon import content_hash, encoded
from .functions.columns import mask_credentials, tag_append
from .operators import browse, checks, diff, history, mutate
from .plans.exports import Exports
from .plans.repository import Repository
from .sources import files
from .sources.database import Database, counts
from .sources.store import Store, new_objects
from .streaming.periodic import periodic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = datetime(2024, 1, 1)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints; where none are set, a temporary one, in local sessions only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-store-')}"
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex[:12]}"


# --- two states of a table: from lacks keys that leave 1 modulo 7; to lacks multiples of 7 and differs at multiples of 5


def states(df: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    k = F.col(key)
    changed = F.when(k % 5 == 0, F.concat(F.col(column), F.lit("*"))).otherwise(F.col(column))
    return df.filter(k % 7 != 1), df.filter(k % 7 != 0).withColumn(column, changed)


def refs(df: DataFrame, key: str, collection: str) -> DataFrame:
    return encoded(df, [key]).select(F.lit(collection).alias("collection"), "id", "hash")


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = states(read(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority")
    return diff.diff(refs(old, "o_orderkey", "orders"), refs(new, "o_orderkey", "orders"))


ID = """'{{"_id":{{"$numberLong":"' || {0} || '"}}}}'"""
ORDER_ID = ID.format("o_orderkey")
CHANGE = "CASE WHEN {0} % 7 = 1 THEN 'added' WHEN {0} % 7 = 0 THEN 'removed' ELSE 'modified' END"
CHANGED = "{0} % 7 IN (0, 1) OR {0} % 5 = 0"
ORDER_CHANGES = f"SELECT 'orders' AS collection, {ORDER_ID} AS id, {CHANGE.format('o_orderkey')} AS change FROM orders WHERE {CHANGED.format('o_orderkey')}"


# --- canonical texts and hashes


@query(
    """SELECT '{"_id":{"$numberLong":"' || o_orderkey || '"}}' AS id, sha256(to_json({'o_orderkey': {'$numberLong': o_orderkey::VARCHAR}, 'o_custkey': {'$numberLong': o_custkey::VARCHAR},
 'o_orderstatus': o_orderstatus, 'o_totalprice': {'$numberDecimal': o_totalprice::DECIMAL(18,4)::VARCHAR}, 'o_orderdate': {'$date': epoch_us(o_orderdate)::VARCHAR}, 'o_orderpriority': o_orderpriority})::VARCHAR) AS hash FROM orders"""
)
def canonical_hash_orders(spark, sf_dir):
    df = read(spark, sf_dir, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,4)"))
    return encoded(df, ["o_orderkey"]).select("id", "hash")


@query(
    """SELECT '{"_id":{"$numberLong":"' || doc_id || '"}}' AS id, sha256(to_json({'doc_id': {'$numberLong': doc_id::VARCHAR}, 'text': text, 'lang': lang, 'source': source, 'n_chars': {'$numberLong': n_chars::VARCHAR}})::VARCHAR) AS hash FROM documents"""
)
def canonical_hash_documents(spark, sf_dir):
    return encoded(read(spark, sf_dir, "documents"), ["doc_id"]).select("id", "hash")


@query("""SELECT '{"_id":{"conv_id":{"$numberLong":"' || conv_id || '"},"turn":{"$numberLong":"' || turn || '"}}}' AS id FROM conversations""")
def composite_keys(spark, sf_dir):
    return encoded(read(spark, sf_dir, "conversations"), ["conv_id", "turn"]).select("id")


# --- differences


@query(ORDER_CHANGES)
def diff_changes(spark, sf_dir):
    return diff.listed(order_changes(spark, sf_dir)).select("collection", "id", "change")


@query(f"SELECT collection, CAST(count(*) FILTER (change = 'added') AS BIGINT) AS added, CAST(count(*) FILTER (change = 'modified') AS BIGINT) AS modified, CAST(count(*) FILTER (change = 'removed') AS BIGINT) AS removed FROM ({ORDER_CHANGES}) GROUP BY collection")
def diff_summary(spark, sf_dir):
    return diff.summary(order_changes(spark, sf_dir))


@query(f"SELECT 'customer' AS collection, {ID.format('c_custkey')} AS id, 'removed' AS change FROM customer UNION ALL SELECT 'part', {ID.format('p_partkey')}, 'added' FROM part")
def diff_one_sided(spark, sf_dir):
    old, new = refs(read(spark, sf_dir, "customer"), "c_custkey", "customer"), refs(read(spark, sf_dir, "part"), "p_partkey", "part")
    return diff.diff(old, new).select("collection", "id", "change")


@query("SELECT '' AS collection, '' AS id, '' AS change WHERE false")
def diff_identical(spark, sf_dir):
    own = refs(read(spark, sf_dir, "documents"), "doc_id", "documents")
    return diff.diff(own, own).select("collection", "id", "change")


@query(f"SELECT id FROM ({ORDER_CHANGES}) WHERE change = 'modified' ORDER BY id LIMIT 50 OFFSET 100")
def diff_page_modified(spark, sf_dir):
    return diff.page(order_changes(spark, sf_dir), "orders", "modified", 100, 50)


@query(f"WITH c AS (SELECT * FROM ({ORDER_CHANGES}) WHERE change = 'modified') SELECT id, (SELECT count(*) FROM c) AS total FROM c ORDER BY id LIMIT 500 OFFSET (SELECT count(*) // 2 FROM c)")
def diff_page_deep(spark, sf_dir):
    """A page from the middle of all changes, with their total, read from the files that hold it."""
    pages = diff.paged(order_changes(spark, sf_dir), f"{scratch(spark)}/pages")
    return pages.page("orders", "modified", offset=pages.total("orders", "modified") // 2, limit=500).select("id", "total")


@query("SELECT '' AS id WHERE false")
def diff_page_past_end(spark, sf_dir):
    return diff.page(order_changes(spark, sf_dir), "orders", "added", 10**8, 50)


DOC_JSON = "to_json({'doc_id': {'$numberLong': doc_id::VARCHAR}, 'text': text, 'lang': {0}, 'source': source, 'n_chars': {'$numberLong': n_chars::VARCHAR}})::VARCHAR"


@query(
    f"""WITH t AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN lang || '*' ELSE lang END AS lang2 FROM documents)
SELECT 'documents' AS collection, {ID.format('doc_id')} AS id, {CHANGE.format('doc_id')} AS change,
 CASE WHEN doc_id % 7 <> 1 THEN {DOC_JSON.replace('{0}', 'lang')} END AS before, CASE WHEN doc_id % 7 <> 0 THEN {DOC_JSON.replace('{0}', 'lang2')} END AS after
FROM t WHERE {CHANGED.format('doc_id')}"""
)
def diff_content(spark, sf_dir):
    old, new = (encoded(s, ["doc_id"]).withColumn("collection", F.lit("documents")) for s in states(read(spark, sf_dir, "documents"), "doc_id", "lang"))
    objects = old.unionByName(new).select("hash", "canonical").dropDuplicates(["hash"])
    return diff.content(diff.diff(old, new), objects)


@query(f"SELECT 'orders' AS collection, {ORDER_ID} AS id, 'added' AS change FROM orders WHERE o_orderkey % 7 = 1")
def diff_live(spark, sf_dir):
    root = scratch(spark)
    states(read(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority")[0].write.parquet(f"{root}/db/orders.parquet")
    repository = Repository(spark, f"{root}/store", "db")
    repository.create(Database(spark, f"{root}/db"), now=NOW, snapshot_id="before")
    return repository.diff("before", live=Database(spark, sf_dir, only=["orders"])).select("collection", "id", "change")


# --- objects


@query("SELECT sha256(text) AS hash, text AS canonical FROM (SELECT DISTINCT text FROM documents WHERE doc_id % 3 <> 0) WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)")
def dedup_new_objects(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("hash"), F.col("text").alias("canonical"))
    return new_objects(docs.filter("doc_id % 3 <> 0"), docs.filter("doc_id % 3 = 0"))


@query("SELECT CAST(count(*) AS BIGINT) AS put, CAST(count(DISTINCT text) AS BIGINT) AS new FROM documents")
def dedup_in_batch(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(content_hash(F.col("text")).alias("hash"), F.col("text").alias("canonical"))
    new = new_objects(docs, docs.limit(0))
    return docs.agg(F.count(F.lit(1)).alias("put")).join(new.agg(F.count(F.lit(1)).alias("new")))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@query(" UNION ALL ".join(f"SELECT '{t}' AS collection, CAST(count(*) AS BIGINT) AS doc_count FROM {t}" for t in TABLES) + " UNION ALL SELECT 'none', CAST(0 AS BIGINT)")
def collection_counts(spark, sf_dir):
    tables = {t: read(spark, sf_dir, t) for t in TABLES}
    return counts({**tables, "none": tables["documents"].filter("doc_id < 0")})


ALL_TABLES = (*TABLES, "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS collection, CAST(count(*) AS BIGINT) AS doc_count, true AS has_bytes FROM {t}" for t in ALL_TABLES))
def collection_stats(spark, sf_dir):
    return Database(spark, sf_dir).stats().select("collection", "doc_count", (F.col("storage_size") > 0).alias("has_bytes"))


# --- histories: every order is a snapshot of its customer's database, tagged with its priority when finished


def order_history(spark, sf_dir) -> DataFrame:
    tags = F.when(F.col("o_orderstatus") == "F", F.array("o_orderpriority")).otherwise(F.array().cast("array<string>"))
    return read(spark, sf_dir, "orders").select(
        F.md5(F.col("o_orderkey").cast("string")).alias("snapshot_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("c"), "o_custkey").alias("database"), tags.alias("tags"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 9).alias("docs")
    )


HISTORY = "(SELECT md5(o_orderkey::VARCHAR) AS snapshot_id, o_orderkey AS seq, 'c' || o_custkey AS database, o_orderstatus = 'F' AS tagged, o_orderpriority, o_orderdate AS created_at, o_orderkey % 9 AS docs FROM orders)"


@query(f"SELECT snapshot_id, seq, created_at FROM {HISTORY} ORDER BY created_at DESC, seq DESC LIMIT 100")
def history_log(spark, sf_dir):
    return history.ordered(order_history(spark, sf_dir)).select("snapshot_id", "seq", "created_at").limit(100)


@query(f"SELECT snapshot_id, seq, created_at FROM {HISTORY} ORDER BY created_at DESC, seq LIMIT 1")
def latest_snapshot(spark, sf_dir):
    return history.latest(order_history(spark, sf_dir)).select("snapshot_id", "seq", "created_at")


@query(f"SELECT snapshot_id, lag(snapshot_id) OVER (PARTITION BY database ORDER BY created_at, seq) AS parent_id FROM {HISTORY}")
def parent_chain(spark, sf_dir):
    return history.with_parents(order_history(spark, sf_dir)).select("snapshot_id", "parent_id")


@query(f"SELECT database, CAST(sum(docs) AS BIGINT) AS docs, CAST(count(*) AS BIGINT) AS snapshots FROM {HISTORY} GROUP BY database")
def snapshot_totals(spark, sf_dir):
    return order_history(spark, sf_dir).groupBy("database").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("snapshots"))


@query(f"SELECT snapshot_id, seq FROM {HISTORY} WHERE snapshot_id LIKE 'c4ca4238a0%'")
def find_prefix(spark, sf_dir):
    return history.matching(order_history(spark, sf_dir), "c4ca4238a0").select("snapshot_id", "seq")


@query(f"SELECT snapshot_id, seq FROM {HISTORY} WHERE snapshot_id LIKE 'c%' ORDER BY snapshot_id LIMIT 2")
def find_prefix_ambiguous(spark, sf_dir):
    return history.matching(order_history(spark, sf_dir), "c").select("snapshot_id", "seq")


@query(f"SELECT snapshot_id, CASE WHEN tagged AND o_orderpriority = '1-URGENT' THEN '1-URGENT' WHEN tagged THEN o_orderpriority || ',1-URGENT' ELSE '1-URGENT' END AS tags FROM {HISTORY}")
def tag_appended(spark, sf_dir):
    return order_history(spark, sf_dir).select("snapshot_id", F.array_join(tag_append(F.col("tags"), F.lit("1-URGENT")), ",").alias("tags"))


RANKED = f"(SELECT *, row_number() OVER (PARTITION BY database ORDER BY created_at DESC, seq DESC) AS rn FROM {HISTORY})"


@query(f"SELECT snapshot_id, database FROM {RANKED} WHERE tagged OR rn <= 3")
def retention_keep(spark, sf_dir):
    return history.kept(order_history(spark, sf_dir), 3, "database").select("snapshot_id", "database")


def _marks(spark, sf_dir):
    """Each order as a snapshot that refers to its customer and to the lines' parts; customers and parts are the objects."""
    snapshots = order_history(spark, sf_dir)
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    name = F.md5(F.col("o_orderkey").cast("string")).alias("snapshot_id")
    own = orders.select(name, F.sha2(F.concat(F.lit("c"), "o_custkey"), 256).alias("hash"))
    own = own.unionByName(lines.select(F.md5(F.col("l_orderkey").cast("string")).alias("snapshot_id"), F.sha2(F.concat(F.lit("p"), "l_partkey"), 256).alias("hash")))
    objects = read(spark, sf_dir, "customer").select(F.sha2(F.concat(F.lit("c"), "c_custkey"), 256).alias("hash"))
    objects = objects.unionByName(read(spark, sf_dir, "part").select(F.sha2(F.concat(F.lit("p"), "p_partkey"), 256).alias("hash")))
    return snapshots, own, objects, history.kept(snapshots, 100)


MARKS = f"""kept AS (SELECT snapshot_id FROM {HISTORY} WHERE tagged OR snapshot_id IN (SELECT snapshot_id FROM {HISTORY} ORDER BY created_at DESC, seq DESC LIMIT 100)),
refs AS (SELECT md5(o_orderkey::VARCHAR) AS snapshot_id, sha256('c' || o_custkey) AS hash FROM orders UNION ALL SELECT md5(l_orderkey::VARCHAR), sha256('p' || l_partkey) FROM lineitem),
objects AS (SELECT sha256('c' || c_custkey) AS hash FROM customer UNION ALL SELECT sha256('p' || p_partkey) FROM part),
swept AS (SELECT hash FROM objects WHERE hash NOT IN (SELECT hash FROM refs WHERE snapshot_id IN (SELECT snapshot_id FROM kept)))"""


@query(f"WITH {MARKS} SELECT hash FROM swept")
def gc_sweep(spark, sf_dir):
    _, own, objects, keep = _marks(spark, sf_dir)
    return history.unreferenced(objects, history.referenced(own, keep))


@query(f"WITH {MARKS} SELECT (SELECT count(*) FROM orders) - (SELECT count(*) FROM kept) AS snapshots_deleted, (SELECT count(*) FROM swept) AS objects_deleted")
def gc_counters(spark, sf_dir):
    snapshots, own, objects, keep = _marks(spark, sf_dir)
    gone = history.pruned(snapshots, keep).agg(F.count(F.lit(1)).alias("snapshots_deleted"))
    return gone.join(history.unreferenced(objects, history.referenced(own, keep)).agg(F.count(F.lit(1)).alias("objects_deleted")))


# --- snapshots and restores through a store


def _snapshot(spark, sf_dir, *names: str) -> tuple[Repository, str]:
    root = scratch(spark)
    repository = Repository(spark, f"{root}/store", "db")
    repository.create(Database(spark, sf_dir, only=names), now=NOW, snapshot_id="s1")
    return repository, root


@query("SELECT * FROM documents")
def restore_roundtrip(spark, sf_dir):
    repository, root = _snapshot(spark, sf_dir, "documents", "customer", "events")
    target = Database(spark, f"{root}/restored")
    repository.restore("s1", target)
    return target.read("documents")


@query("SELECT * FROM events")
def restore_one_collection(spark, sf_dir):
    repository, root = _snapshot(spark, sf_dir, "nation", "events")
    target = Database(spark, f"{root}/restored")
    repository.restore("s", target, "events")
    return target.read("events")


@query("SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'kept' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -c_custkey, 'extra' FROM customer WHERE c_custkey % 13 = 0")
def restore_upsert(spark, sf_dir):
    root, customers = scratch(spark), read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    customers.filter("c_custkey % 11 <> 0").write.parquet(f"{root}/db/customer.parquet")
    repository = Repository(spark, f"{root}/store", "db")
    repository.create(Database(spark, f"{root}/db"), now=NOW, snapshot_id="s1")
    extra = customers.filter("c_custkey % 13 = 0").select((-F.col("c_custkey")).alias("c_custkey"), F.lit("extra").alias("c_mktsegment"))
    customers.withColumn("c_mktsegment", F.lit("kept")).unionByName(extra).write.parquet(f"{root}/target/customer.parquet")
    target = Database(spark, f"{root}/target")
    repository.restore("s1", target, mode="upsert")
    return target.read("customer")


@query("SELECT 's2' AS snapshot_id, 's1' AS parent_id, CAST((SELECT count(*) FROM orders WHERE o_orderkey % 7 <> 0) AS BIGINT) AS doc_count, CAST((SELECT count(*) FROM orders WHERE o_orderkey % 7 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 1)) AS BIGINT) AS new_objects UNION ALL SELECT 's1', NULL, CAST((SELECT count(*) FROM orders WHERE o_orderkey % 7 <> 1) AS BIGINT), CAST((SELECT count(*) FROM orders WHERE o_orderkey % 7 <> 1) AS BIGINT)")
def snapshot_log(spark, sf_dir):
    repository, _ = _two_snapshots(spark, sf_dir)
    return repository.log().select("snapshot_id", "parent_id", "doc_count", "new_objects")


def _two_snapshots(spark, sf_dir) -> tuple[Repository, str]:
    """s1 and s2: the two states of orders."""
    root = scratch(spark)
    repository = Repository(spark, f"{root}/store", "db")
    for n, state in enumerate(states(read(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority"), 1):
        state.write.parquet(f"{root}/db{n}/orders.parquet")
        repository.create(Database(spark, f"{root}/db{n}"), now=NOW, snapshot_id=f"s{n}")
    return repository, root


@query(ORDER_CHANGES)
def diff_two_snapshots(spark, sf_dir):
    return _two_snapshots(spark, sf_dir)[0].diff("s1", "s2").select("collection", "id", "change")


@query("SELECT 's1' AS snapshot_id, 'keep,again' AS tags, (SELECT count(*) FROM orders WHERE o_orderkey % 7 <> 1) AS doc_count UNION ALL SELECT 's2', '', (SELECT count(*) FROM orders WHERE o_orderkey % 7 <> 0)")
def tag_snapshot(spark, sf_dir):
    repository, _ = _two_snapshots(spark, sf_dir)
    for tag in ("keep", "again", "keep"):
        repository.tag("s1", tag)
    return repository.log().select("snapshot_id", F.array_join("tags", ",").alias("tags"), "doc_count")


@query(
    """SELECT CAST(1 AS BIGINT) AS snapshots_deleted, (SELECT count(*) FROM orders WHERE o_orderkey % 7 <> 1 AND (o_orderkey % 7 = 0 OR o_orderkey % 5 = 0)) AS objects_deleted,
 (SELECT count(*) FROM orders WHERE o_orderkey % 7 <> 0) AS objects_left, (SELECT count(*) FROM orders WHERE o_orderkey % 7 <> 0) AS refs_left"""
)
def gc_through_store(spark, sf_dir):
    repository, _ = _two_snapshots(spark, sf_dir)
    done = repository.gc(1)
    left = repository.store.hashes().select(F.lit(1).alias("o"), F.lit(0).alias("r")).unionByName(repository.store.refs().select(F.lit(0).alias("o"), F.lit(1).alias("r")))
    return done.join(left.agg(F.sum("o").alias("objects_left"), F.sum("r").alias("refs_left")))


@query("SELECT 'restored' AS state, c_custkey, c_mktsegment FROM customer UNION ALL SELECT 'safety', c_custkey, 'own' FROM customer WHERE c_custkey % 3 = 0")
def restore_drop_safety(spark, sf_dir):
    root, customers = scratch(spark), read(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    customers.write.parquet(f"{root}/db/customer.parquet")
    repository = Repository(spark, f"{root}/store", "db")
    repository.create(Database(spark, f"{root}/db", {"customer": ["c_custkey"]}), now=NOW, snapshot_id="s1")
    customers.filter("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("own")).write.parquet(f"{root}/target/customer.parquet")
    target, safety = Database(spark, f"{root}/target"), Repository(spark, f"{root}/safety", "target")
    repository.restore("s1", target, mode="drop", safety=safety, now=NOW)
    before = safety.rows(safety.log().first()["snapshot_id"], "customer")
    both = target.read("customer").withColumn("state", F.lit("restored")).unionByName(before.withColumn("state", F.lit("safety")))
    return both.select("state", "c_custkey", "c_mktsegment")


@query("SELECT 'customer' AS collection, (SELECT count(*) FROM customer) AS docs UNION ALL SELECT 'nation', (SELECT count(*) FROM nation)")
def restored_counts(spark, sf_dir):
    repository, root = _snapshot(spark, sf_dir, "nation", "customer")
    return repository.restore("s1", Database(spark, f"{root}/restored"))


@query("SELECT 'orders' AS collection, true AS consistent, 'same' AS states, CAST(count(*) AS BIGINT) AS rows FROM orders UNION ALL SELECT 'documents', true, 'same', CAST(count(*) AS BIGINT) FROM documents")
def snapshot_files(spark, sf_dir):
    """The files of a snapshot: whether all were read at one point in time, whether they are as they were, and their rows."""
    repository, _ = _snapshot(spark, sf_dir, "orders", "documents")
    found = repository.files("s1", Database(spark, sf_dir, only=["orders", "documents"])).groupBy("collection").agg(F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states"), F.sum("rows").alias("rows"))
    return found.join(repository.log().select("consistent")).select("collection", "consistent", "states", "rows")


@query("SELECT 'auto-00000000' AS snapshot_id, NULL AS parent_id, (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) AS doc_count, (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) AS new_objects UNION ALL SELECT 'auto-00000001', 'auto-00000000', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0)")
def periodic_snapshots(spark, sf_dir):
    """A stream takes a snapshot for each batch of new files; the second one reads the second batch's files alone."""
    root, orders = scratch(spark), read(spark, sf_dir, "orders")
    repository, db = Repository(spark, f"{root}/store", "db"), Database(spark, f"{root}/db")
    for part in (orders.filter("o_orderkey % 3 <> 0"), orders.filter("o_orderkey % 3 = 0")):
        part.write.mode("append").parquet(f"{root}/db/orders.parquet")
        periodic(repository, db, "orders", f"{root}/progress", now=NOW).awaitTermination()
    return repository.log().select("snapshot_id", "parent_id", "doc_count", "new_objects")


@query("SELECT 'empty' AS collection, CAST(0 AS BIGINT) AS doc_count UNION ALL SELECT 'nation', CAST(count(*) AS BIGINT) FROM nation")
def collections_created_and_dropped(spark, sf_dir):
    root, nations = scratch(spark), read(spark, sf_dir, "nation")
    db = Database(spark, f"{root}/db")
    for name in ("empty", "nation", "gone"):
        db.create(name, nations.schema)
    for name in ("nation", "gone"):
        db.replace(name, nations)
    db.drop("gone")
    return db.stats().select("collection", "doc_count")


@query("SELECT 'customer' AS collection, 'c_custkey' AS key, 'by_name' AS index, 'c_name' AS columns, 'true' AS sparse, CAST(count(*) AS BIGINT) AS docs FROM customer UNION ALL SELECT 'conversations', 'conv_id,turn', NULL, NULL, NULL, CAST(count(*) AS BIGINT) FROM conversations")
def captured_indexes(spark, sf_dir):
    """Keys and indexes through a snapshot and a restore, as the restored database declares them."""
    root = scratch(spark)
    repository, names = Repository(spark, f"{root}/store", "db"), ("customer", "conversations")
    index = [{"name": "by_name", "columns": ["c_name"], "options": {"sparse": "true"}}]
    repository.create(Database(spark, sf_dir, {"conversations": ["conv_id", "turn"]}, names), now=NOW, snapshot_id="s1", indexes={"customer": index})
    target = Database(spark, f"{root}/restored")
    docs = repository.restore("s1", target)
    about = [(c, ",".join(d["key"]), i["name"], ",".join(i["columns"]), i["options"]["sparse"]) for c, d in target.declared().items() for i in d["indexes"] or [{"name": None, "columns": [], "options": {"sparse": None}}]]
    own = spark.createDataFrame(about, "collection string, key string, index string, columns string, sparse string")
    return own.join(docs, "collection").withColumn("columns", F.when(F.col("columns") != "", F.col("columns")))


TEXTS = "SELECT DISTINCT sha256(text) AS hash, text AS canonical, doc_id % 2 = 0 AS even FROM documents"


def _texts(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("hash"), F.col("text").alias("canonical"))


@query(f"WITH t AS ({TEXTS}) SELECT DISTINCT hash, canonical FROM t WHERE even AND hash IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def objects_get(spark, sf_dir):
    store, texts = Store(spark, scratch(spark), "db"), _texts(spark, sf_dir)
    store.put(texts.filter("doc_id % 2 = 0"), "even")
    asked = texts.filter("doc_id % 3 = 0").join(store.hashes(), "hash", "left_semi")
    return store.get(asked.select("hash"))


@query("SELECT doc_id, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) AS stored FROM documents WHERE text IS NOT NULL")
def objects_have(spark, sf_dir):
    store, texts = Store(spark, scratch(spark), "db"), _texts(spark, sf_dir).filter("canonical is not null")
    store.put(texts.filter("doc_id % 2 = 0"), "even")
    return store.have(texts.select("doc_id", "hash")).select("doc_id", "stored")


@query("SELECT DISTINCT sha256(text) AS hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def objects_deleted(spark, sf_dir):
    store, texts = Store(spark, scratch(spark), "db"), _texts(spark, sf_dir)
    store.put(texts, "all")
    store.delete_objects(texts.filter("doc_id % 3 = 0").select("hash"))
    return store.hashes()


@query("SELECT 's2' AS snapshot_id, count(*) AS refs FROM orders WHERE o_orderkey % 7 <> 0")
def refs_deleted(spark, sf_dir):
    repository, _ = _two_snapshots(spark, sf_dir)
    repository.store.delete_refs("s1")
    return repository.store.refs().groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("refs"))


# --- JSON documents, of which some have a field more, or null, and the rest are written with other white space

LINE = "to_json({'_id': doc_id, 'text': text, 'lang': lang, 'n': {'chars': n_chars, 'half': n_chars / 2}})::VARCHAR"
JSON_ID = """'{"_id":{"$numberInt":"' || doc_id || '"}}'"""


def _document_lines(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two states of documents as JSON lines."""
    docs = read(spark, sf_dir, "documents")
    line = F.to_json(F.struct(F.col("doc_id").alias("_id"), "text", "lang", F.struct(F.col("n_chars").alias("chars"), (F.col("n_chars") / 2).alias("half")).alias("n")), {"ignoreNullFields": "false"})
    spaced = F.concat(F.lit("{ "), F.substring(line, F.lit(2), F.length(line)), F.lit(" "))
    more = F.when(F.col("doc_id") % 10 == 0, ',"new":{"list":[1,true]}}').when(F.col("doc_id") % 10 == 5, ',"new":null}')
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat(F.substring(line, F.lit(1), F.length(line) - 1), more)).otherwise(spaced)
    return docs.filter("doc_id % 7 <> 1").select(line.alias("value")), docs.filter("doc_id % 7 <> 0").select(changed.alias("value"))


def _json_snapshots(spark, sf_dir) -> tuple[Repository, str]:
    root = scratch(spark)
    repository = Repository(spark, f"{root}/store", "db")
    for n, state in enumerate(_document_lines(spark, sf_dir), 1):
        state.write.option("compression", "gzip").text(f"{root}/db{n}/documents.json")
        repository.create(Database(spark, f"{root}/db{n}"), now=NOW, snapshot_id=f"s{n}")
    return repository, root


@query(f"SELECT 'documents' AS collection, {JSON_ID} AS id, {CHANGE.format('doc_id')} AS change FROM documents WHERE {CHANGED.format('doc_id')}")
def json_documents_diff(spark, sf_dir):
    return _json_snapshots(spark, sf_dir)[0].diff("s1", "s2").select("collection", "id", "change")


@query(f"SELECT {LINE} AS document FROM documents WHERE doc_id % 7 <> 1")
def json_documents_restored(spark, sf_dir):
    repository, root = _json_snapshots(spark, sf_dir)
    target = Database(spark, f"{root}/restored")
    repository.restore("s1", target)
    return target.documents("documents")


@query("SELECT 's1' AS snapshot_id, true AS same, CAST(count(*) FILTER (doc_id % 7 <> 1) AS BIGINT) AS doc_count FROM documents UNION ALL SELECT 's2', false, CAST(count(*) FILTER (doc_id % 7 <> 0) AS BIGINT) FROM documents")
def json_upsert_makes_same(spark, sf_dir):
    """s1 restored over s2's documents after those that s1 lacks were deleted: which snapshot the target then equals."""
    repository, root = _json_snapshots(spark, sf_dir)
    target = Database(spark, f"{root}/target")
    repository.restore("s2", target)
    keyed = mutate.keyed_documents(target.documents("documents"), ["_id"])
    extra = repository.diff("s1", "s2").filter("change = 'added'").select("id")
    target.replace("documents", mutate.delete(keyed, extra, ["id"]).select("document"), "")
    repository.restore("s1", target, mode="upsert")
    same = [(name, diff.is_empty(repository.diff(name, live=target))) for name in ("s1", "s2")]
    return spark.createDataFrame(same, "snapshot_id string, same boolean").join(repository.log().select("snapshot_id", "doc_count"), "snapshot_id")


# --- browsing and editing


@query("SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20")
def find_page(spark, sf_dir):
    return browse.find(read(spark, sf_dir, "orders"), ["o_orderkey"], '{"o_orderstatus": "O", "o_totalprice": {"$gte": 1000}}', '{"o_totalprice": -1}', 20, 500)


@query("SELECT CAST(count(*) AS BIGINT) AS total FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey < 100")
def find_count(spark, sf_dir):
    return browse.total(read(spark, sf_dir, "orders"), {"$or": [{"o_orderstatus": {"$ne": "F"}}, {"o_orderkey": {"$lt": 100}}]})


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9, 13) AND NOT (p_brand = 'Brand#11' OR p_partkey > 100000) AND p_partkey NOT IN (3, 4) AND regexp_matches(p_type, 'S') AND p_name IS NOT NULL AND NOT (p_size > 12)")
def find_filter_ops(spark, sf_dir):
    document = {"p_size": {"$in": [1, 5, 9, 13], "$not": {"$gt": 12}}, "$nor": [{"p_brand": "Brand#11"}, {"p_partkey": {"$gt": 100000}}], "$and": [{"p_partkey": {"$nin": [3, 4]}}, {"p_type": {"$regex": "S"}}], "p_name": {"$exists": True}}
    df = read(spark, sf_dir, "part")
    return df.filter(browse.where(df.schema, document)).select("p_partkey")


@query(
    """SELECT event_id, ts, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10 12:00:00' AND ts < make_timestamp(1705900000000000) AND user_id IN (3, 5, 7, 11, 13, 17, 19, 23, 29, 31) AND value <= 99.5
 AND value <> 50 AND NOT (user_id = 13 AND value > 20) AND regexp_matches(event_type, '(?i)^[A-M]')"""
)
def find_typed_values(spark, sf_dir):
    """Extended JSON values, typed by the fields they are compared with."""
    events, users = read(spark, sf_dir, "events"), [{"$numberLong": str(n)} for n in (3, 5, 7, 11, 13, 17, 19, 23, 29)]
    document = {
        "ts": {"$gte": {"$date": "2024-01-10T13:00:00+01:00"}, "$lt": {"$date": {"$numberLong": "1705900000000"}}}, "user_id": {"$in": [*users, 31, "5", None]},
        "value": {"$lte": {"$numberDecimal": "99.5"}, "$ne": {"$numberDouble": "50"}}, "$nor": [{"user_id": {"$numberInt": "13"}, "value": {"$gt": 20}}], "event_type": {"$regex": "^[a-m]", "$options": "i"},
    }
    return events.filter(browse.where(events.schema, document)).select("event_id", "ts", "user_id", "value")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR (o_orderkey % 5 IN (2, 4) AND o_custkey % 3 = 1)")
def find_subdocuments(spark, sf_dir):
    """Whole subdocuments, and lists that hold a value."""
    orders, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    own = orders.select("o_orderkey", F.struct("o_orderstatus", "o_orderpriority").alias("s"), F.array(key % 5, F.lit(None).cast("long")).alias("list"), F.create_map(F.lit("rest"), F.array(F.struct((F.col("o_custkey") % 3).alias("n")))).alias("m"))
    document = {"$or": [{"s": {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}}, {"list": {"$in": [2, {"$numberLong": "4"}]}, "m.rest.n": 1}, {"s": {"o_orderpriority": "1-URGENT", "o_orderstatus": "F"}}]}
    return own.filter(browse.where(own.schema, document)).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 150")
def find_after_row(spark, sf_dir):
    """Page by page from the last row of the one before, no offset but the first."""
    orders, wanted, by = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), {"o_orderstatus": "O"}, {"o_totalprice": -1}
    last = browse.find(orders, ["o_orderkey"], wanted, by, 149, 1).collect()
    return browse.find_after(orders, ["o_orderkey"], last[0].asDict() if last else {"o_totalprice": None, "o_orderkey": None}, wanted, by, 100).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part UNION ALL SELECT -p_partkey - 1, p_name FROM part WHERE p_partkey % 4 = 0")
def batch_insert(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return mutate.insert(part, part.filter("p_partkey % 4 = 0").withColumn("p_partkey", -F.col("p_partkey") - 1), ["p_partkey"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE p_name END AS p_name FROM part")
def batch_replace(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return mutate.replace(part, part.filter("p_partkey % 4 = 0").withColumn("p_name", F.lit("new")), ["p_partkey"])


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 4 <> 0")
def batch_delete(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return mutate.delete(part, part.filter("p_partkey % 4 = 0"), ["p_partkey"])


@query("SELECT to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey})::VARCHAR AS document, (SELECT count(*) FROM nation WHERE n_regionkey < 3) AS total FROM nation WHERE n_regionkey < 3 ORDER BY n_name DESC, n_nationkey LIMIT 50 OFFSET 2")
def document_page_json(spark, sf_dir):
    nations, wanted = read(spark, sf_dir, "nation"), {"n_regionkey": {"$lt": 3}}
    page = browse.documents(nations, ["n_nationkey"], pretty=False, filter=wanted, sort={"n_name": -1}, skip=2)
    return page.join(browse.total(nations, wanted))


@query("SELECT p_partkey, p_size FROM part WHERE p_size % 5 = 0 OR p_brand LIKE '%3'")
def missing_key(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    own = part.withColumn("k1", F.when(F.col("p_size") % 5 != 0, F.col("p_size"))).withColumn("k2", F.when(~F.col("p_brand").endswith("3"), F.col("p_brand")))
    return checks.rows_without_key(own, ["k1", "k2"]).select("p_partkey", "p_size")


@query(f"SELECT false AS empty, count(*) AS changes FROM ({ORDER_CHANGES})")
def diff_emptiness(spark, sf_dir):
    changes = order_changes(spark, sf_dir)
    return changes.agg(F.lit(diff.is_empty(changes)).alias("empty"), F.count(F.lit(1)).alias("changes"))


# --- exports


@query("SELECT 'full' AS name, 'parquet' AS format, 'customer,nation' AS collections, CAST((SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS BIGINT) AS doc_count, true AS has_bytes")
def export_catalog(spark, sf_dir):
    exports = Exports(spark, scratch(spark))
    exports.create(Database(spark, sf_dir, only=["customer", "nation"]), "full", now=NOW)
    return exports.catalog().select("name", "format", F.array_join("collections", ",").alias("collections"), "doc_count", (F.col("bytes") > 0).alias("has_bytes"))


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def export_roundtrip(spark, sf_dir):
    root = scratch(spark)
    exports, target = Exports(spark, root), Database(spark, f"{root}/target")
    exports.create(Database(spark, sf_dir, only=["documents"]), "json", format="json", now=NOW)
    exports.restore("json", target)
    return target.read("documents")


@query("SELECT * FROM events UNION ALL BY NAME SELECT * FROM orders UNION ALL BY NAME SELECT * FROM embeddings")
def export_roundtrip_types(spark, sf_dir):
    """Timestamps, doubles and arrays of floats through JSON."""
    root = scratch(spark)
    exports, target, names = Exports(spark, root), Database(spark, f"{root}/target"), ("events", "orders", "embeddings")
    exports.create(Database(spark, sf_dir, only=names), "json", format="json", now=NOW)
    exports.restore("json", target)
    first, second, third = (target.read(name) for name in names)
    return first.unionByName(second, allowMissingColumns=True).unionByName(third, allowMissingColumns=True)


@query("SELECT 'parquet' AS format, t.* FROM (SELECT 'events' AS collection, 'event_id' AS key, CAST(count(*) AS BIGINT) AS docs, 0 AS problems FROM events UNION ALL SELECT 'conversations', 'conv_id,turn', CAST(count(*) AS BIGINT), 0 FROM conversations) t UNION ALL SELECT 'json', t.* FROM (SELECT 'events' AS collection, 'event_id' AS key, CAST(count(*) AS BIGINT), 0 FROM events UNION ALL SELECT 'conversations', 'conv_id,turn', CAST(count(*) AS BIGINT), 0 FROM conversations) t")
def export_manifests(spark, sf_dir):
    """What two copies say of themselves, and how many of their files are not as they say."""
    exports, rows = Exports(spark, scratch(spark)), []
    for format in ("parquet", "json"):
        exports.create(Database(spark, sf_dir, {"conversations": ["conv_id", "turn"]}, ["events", "conversations"]), format, format=format, now=NOW)
        problems = exports.verify(format).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
        bad = {r["collection"]: r["n"] for r in problems.collect()}
        rows += [(format, c, ",".join(about["key"]), about["rows"], bad.get(c, 0)) for c, about in exports.manifest(format)["collections"].items()]
    return spark.createDataFrame(rows, "format string, collection string, key string, docs long, problems int")


@query("SELECT 'kept' AS name, CAST((SELECT count(*) FROM nation) AS BIGINT) AS doc_count, false AS still_there")
def export_delete(spark, sf_dir):
    exports, source = Exports(spark, scratch(spark)), Database(spark, sf_dir, only=["nation"])
    for name in ("kept", "gone"):
        exports.create(source, name, now=NOW)
    exports.delete("gone")
    return exports.catalog().select("name", "doc_count", F.lit(files.exists(spark, f"{exports.root}/exports/gone")).alias("still_there"))


# --- checks


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return checks.duplicate_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT text, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return checks.unique_violations(read(spark, sf_dir, "documents"), ["text"], sparse=True)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, sha256(o_custkey::VARCHAR) AS hash FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def missing_objects(spark, sf_dir):
    own = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), content_hash(F.col("o_custkey").cast("string")).alias("hash"))
    objects = read(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(content_hash(F.col("c_custkey").cast("string")).alias("hash"))
    return checks.missing_objects(own, objects).select("id", "hash")


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '://', '://user:pw' || page_id || '@'), '(://[^:/?#@]*):[^/?#]*@', '\1:****@') AS url FROM pages")
def masked_credentials(spark, sf_dir):
    url = F.regexp_replace("url", F.lit("://"), F.concat(F.lit("://user:pw"), F.col("page_id").cast("string"), F.lit("@")))
    return read(spark, sf_dir, "pages").select("page_id", mask_credentials(url).alias("url"))
