import gzip
from datetime import UTC, date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from snaptable.errors import BadRequest, Conflict, Damaged, KeyProblem, MissingObjects, NotFound
from snaptable.operators import checks, diff, history, mutate
from snaptable.plans.exports import Exports
from snaptable.plans.repository import Repository
from snaptable.sources import files
from snaptable.sources.database import Database
from snaptable.sources.store import Store, new_objects
from snaptable.streaming.periodic import periodic

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def write(spark, path, **tables):
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return Database(spark, str(path))


AB = ([(1, "x"), (2, "y")], "k int, v string")


@pytest.fixture
def repo(spark, tmp_path):
    return Repository(spark, f"{tmp_path}/store", "shop/db")


def test_create_log_tag_diff(spark, tmp_path, repo):
    db = write(spark, tmp_path / "db", a=AB, b=([(1, "x")], "k int, v string"), none=([], "k int"))
    one = repo.create(db, "first", now=T0, snapshot_id="abc1")
    assert (one.doc_count, one.new_objects, one.parent_id, one.consistent) == (3, 2, None, True)  # a and b share a row
    assert one.collections["none"].doc_count == 0
    write(spark, tmp_path / "db", a=([(1, "x"), (3, "z")], "k int, v string"))
    two = repo.create(db, "second", now=T0, snapshot_id="abd2")
    assert (two.parent_id, two.new_objects, two.seq) == ("abc1", 1, 2)
    assert [r.snapshot_id for r in repo.log().collect()] == ["abd2", "abc1"]
    assert [r.snapshot_id for r in repo.log("asc").collect()] == ["abc1", "abd2"]
    assert sorted((r.collection, r.change) for r in repo.diff("abc1", "abd").collect()) == [("a", "added"), ("a", "removed")]
    assert repo.diff("abd2", live=db).count() == 0
    content = {r.change: r for r in repo.diff_content("abc1", "abd2").collect()}
    assert '"y"' in content["removed"].before and content["removed"].after is None
    assert repo.tag("abc1", "keep").tags == ["keep"] and repo.tag("abc1", "keep").tags == ["keep"]
    assert repo.get("keep", resolve_tags=True).snapshot_id == "abc1"
    for text in ("ab", "zzz", "", "keep"):
        with pytest.raises(NotFound):
            repo.get(text)
    with pytest.raises(BadRequest):
        repo.tag("abc1", "")
    with pytest.raises(BadRequest):
        repo.create(db, now=T0, snapshot_id="abc1")


def test_keys_are_required_and_unique(spark, tmp_path, repo):
    with pytest.raises(KeyProblem):
        repo.create(write(spark, tmp_path / "dup", a=([(1, "x"), (1, "y")], "k int, v string")))
    with pytest.raises(Exception, match="no key"):
        repo.create(write(spark, tmp_path / "nul", a=([(None, "x")], "k int, v string")))
    assert repo.log().count() == 0


def test_gc(spark, tmp_path, repo):
    for n in range(5):
        db = write(spark, tmp_path / "db", a=([(1, f"v{n}"), (2, "same")], "k int, v string"))
        repo.create(db, now=T0 + timedelta(hours=n), snapshot_id=f"s{n}")
    repo.tag("s1", "keep")
    assert rows(repo.gc(10)) == [(0, 0)]
    assert rows(repo.gc(2)) == [(2, 2)]
    assert [r.snapshot_id for r in repo.log("asc").collect()] == ["s1", "s3", "s4"]
    assert rows(repo.rows("s1", "a")) == [(1, "v1"), (2, "same")]
    assert repo.store.refs("s0").count() == 0
    assert rows(repo.gc(0)) == [(2, 2)]
    assert [r.snapshot_id for r in repo.log().collect()] == ["s1"] and repo.store.objects().count() == 2


def test_restore_modes(spark, tmp_path, repo):
    db = write(spark, tmp_path / "db", a=AB, b=([(7, 1.5)], "k int, x double"))
    repo.create(db, now=T0, snapshot_id="s1")
    target = write(spark, tmp_path / "target", a=([(2, "other"), (3, "own")], "k int, v string"), extra=([(1,)], "k int"))
    with pytest.raises(KeyProblem):
        repo.restore("s1", target)
    assert target.names() == ["a", "extra"]
    assert rows(repo.restore("s1", target, mode="upsert")) == [("a", 2), ("b", 1)]
    assert rows(target.read("a")) == [(1, "x"), (2, "y"), (3, "own")] and "extra" in target.names()
    repo.restore("s1", target, "a", mode="drop", now=T0)
    assert rows(target.read("a")) == [(1, "x"), (2, "y")]
    safety = Repository(spark, repo.root, target.path)
    assert safety.log().count() == 1 and rows(safety.rows(safety.log().first().snapshot_id, "a"))[-1] == (3, "own")
    with pytest.raises(NotFound):
        repo.restore("s1", target, "gone")
    with pytest.raises(BadRequest):
        repo.restore("s1", target, mode="merge")


def test_restore_checks_unique_indexes_and_objects(spark, tmp_path, repo):
    db = write(spark, tmp_path / "db", a=([(1, "x"), (2, "x")], "k int, v string"))
    repo.create(db, now=T0, snapshot_id="s1", indexes={"a": [{"name": "v1", "columns": ["v"], "options": {"unique": "true"}}]})
    with pytest.raises(BadRequest, match="unique"):
        repo.restore("s1", Database(spark, f"{tmp_path}/t"))
    repo.store.delete_objects(repo.store.hashes().limit(1))
    with pytest.raises(MissingObjects):
        repo.restore("s1", Database(spark, f"{tmp_path}/t"))


def test_objects(spark, tmp_path):
    store = Store(spark, str(tmp_path), "d")
    own = spark.createDataFrame([("a1", "doc-1"), ("b2", "doc-2"), ("a1", "doc-1")], "hash string, canonical string")
    assert store.put(own, "one") == 2 and store.put(own, "two") == 0 and store.hashes().count() == 2
    assert new_objects(own, store.hashes()).count() == 0
    some = spark.createDataFrame([("a1",), ("a9",)], "hash string")
    assert rows(store.have(some)) == [("a1", True), ("a9", False)]
    with pytest.raises(MissingObjects):
        store.get(some)
    held = store.objects()
    store.delete_objects(some)
    assert rows(store.objects()) == [("b2", "doc-2")] and held.count() == 2
    assert store.put(own, "one") == 1 and rows(store.objects()) == [("a1", "doc-1"), ("b2", "doc-2")]
    assert store.expire() == 0 and store.expire(timedelta(0), datetime.now(UTC) + timedelta(hours=1)) == 2  # the first batch, and who was dead in it
    assert rows(store.objects()) == [("a1", "doc-1"), ("b2", "doc-2")]
    store.delete_objects(store.hashes())
    assert store.objects().count() == 0 and not store.state().objects
    many = spark.range(10_007).select(F.lit("c").alias("collection"), F.format_string("id%06d", "id").alias("id"), F.lit("h").alias("hash"))
    store.write_refs("123", many)
    assert store.refs("123").count() == 10_007 and store.refs("123").schema["snapshot_id"].dataType.simpleString() == "string"
    store.delete_refs("123")
    assert store.refs("123").count() == 0 and Store(spark, str(tmp_path), "d/").path != Store(spark, str(tmp_path), "d_").path


def hashed(spark, start, end):
    return spark.range(start, end).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.col("id").cast("string").alias("canonical"))


def test_sweeps_write_dead_objects_down(spark, tmp_path):
    """A small sweep rewrites no file; a batch of which a large share is dead is written again, another one is not."""
    store = Store(spark, str(tmp_path), "d")
    store.put(hashed(spark, 0, 1000), "a")
    store.put(hashed(spark, 1000, 1100), "b")
    before = {path for path, *_ in files.data_files(spark, f"{store.path}/objects")}
    store.delete_objects(hashed(spark, 0, 20).unionByName(hashed(spark, 1000, 1010)))
    state = store.state()
    assert {path for path, *_ in files.data_files(spark, f"{store.path}/objects")} == before
    assert sum(sum(x.values()) for x in state.dead.values()) == 30 and store.hashes().count() == 1070
    assert store.put(hashed(spark, 10, 30), "c") == 10 and store.hashes().distinct().count() == store.hashes().count() == 1080  # dead ones come back alone
    store.delete_objects(hashed(spark, 1000, 1040))
    batches = store.state().objects
    assert {b.split("-")[0]: n for b, n in batches.items()} == {"a": 1000, "c": 10, "merged": 60}
    assert store.hashes().count() == 1050 and {r.hash for r in store.hashes().collect()} == {r.hash for r in hashed(spark, 20, 1000).unionByName(hashed(spark, 10, 20)).unionByName(hashed(spark, 1040, 1100)).collect()}
    for n in range(10):
        store.delete_objects(hashed(spark, 100 + n, 101 + n))
    assert len(store.state().dead) <= 8 and store.hashes().count() == 1040
    assert before - {path for path, *_ in files.data_files(spark, f"{store.path}/objects")} == set()  # held frames go on reading


def test_many_small_batches_become_one(spark, tmp_path, monkeypatch):
    from snaptable.sources import store as module

    monkeypatch.setattr(module, "BATCHES", 4)
    store = Store(spark, str(tmp_path), "d")
    store.put(hashed(spark, 0, 500), "large")
    for n in range(6):
        store.put(hashed(spark, 500 + n, 501 + n), "small")
    assert len(store.state().objects) <= 4 and store.hashes().count() == 506 and any(b.startswith("large") for b in store.state().objects)


def test_writers_that_cross(spark, tmp_path, repo, monkeypatch):
    """A create within another, and a sweep within a create: no snapshot is lost, none lacks an object, none is stored twice."""
    db = write(spark, tmp_path / "db", a=([(n, f"v{n}") for n in range(10)], "k int, v string"))
    other = Repository(spark, repo.root, "shop/db")
    stage, crossed = repo.store.stage, []

    def crossing(run):
        def staged(objects, batch):
            own = stage(objects, batch)
            if not crossed:
                crossed.append(True)
                run()
            return own

        return staged

    monkeypatch.setattr(repo.store, "stage", crossing(lambda: other.create(db, now=T0, snapshot_id="inner")))
    repo.create(db, now=T0 + timedelta(hours=1), snapshot_id="outer")
    assert [(r.snapshot_id, r.parent_id, r.new_objects) for r in repo.log("asc").collect()] == [("inner", None, 10), ("outer", "inner", 0)]
    assert repo.store.hashes().count() == 10
    # The sweep takes what only `inner` and `outer` refer to, while a new snapshot is about to rely on it.
    write(spark, tmp_path / "db", a=([(1, "other")], "k int, v string"))
    repo.create(db, now=T0 + timedelta(hours=2), snapshot_id="small")
    write(spark, tmp_path / "db", a=([(n, f"v{n}") for n in range(12)], "k int, v string"))
    crossed.clear()
    monkeypatch.setattr(repo.store, "stage", crossing(lambda: other.gc(1)))
    assert repo.create(db, now=T0 + timedelta(hours=3), snapshot_id="after").new_objects == 12
    assert rows(repo.rows("after", "a")) == rows(db.read("a")) and [r.snapshot_id for r in repo.log("asc").collect()] == ["small", "after"]
    base = repo.store.state()
    repo.tag("after", "x")
    with pytest.raises(Conflict):
        repo.store.commit(base, repo.store.snapshots(base))
    with pytest.raises(BadRequest):
        repo.create(db, snapshot_id="after")


def test_only_files_with_new_rows_are_read_again(spark, tmp_path, repo, monkeypatch):
    db = write(spark, tmp_path / "db", a=([(n, "x" * n) for n in range(50)], "k int, v string"), b=([(1, 2)], "k int, n int"))
    repo.create(db, now=T0, snapshot_id="s1")
    spark.createDataFrame([(100, "new"), (101, "x" * 7)], "k int, v string").coalesce(1).write.mode("append").parquet(f"{db.path}/a.parquet")
    read, encoded_ = [], db.encoded
    monkeypatch.setattr(db, "encoded", lambda c, pinned=None, schema_json=None: (read.append((c, len(pinned or []))), encoded_(c, pinned, schema_json))[1])
    assert repo.create(db, now=T0, snapshot_id="s2").new_objects == 2
    assert read == [("a", 1), ("a", 1)]  # the new file for keys and hashes, and for texts
    assert rows(repo.rows("s2", "a")) == rows(db.read("a"))
    read.clear()
    assert repo.create(db, now=T0, snapshot_id="s3", full=True).new_objects == 0
    assert [c for c, _ in read] == ["a", "b"] and read[0][1] > 1 and repo.diff("s2", "s3").isEmpty()


def test_snapshots_from_the_parents_refs_equal_full_ones(spark, tmp_path, repo):
    """Files that are added, changed, taken away, or of a table with another schema or key; against full snapshots."""
    db = write(spark, tmp_path / "db", a=([(n, f"v{n}") for n in range(40)], "k int, v string"), b=AB, c=AB)
    repo.create(db, now=T0, snapshot_id="s0")
    parts = sorted((tmp_path / "db/a.parquet").glob("part-*"))

    def added():
        spark.createDataFrame([(100, "new")], "k int, v string").write.mode("append").parquet(f"{db.path}/a.parquet")

    def gone():
        parts[0].unlink()

    def changed():
        at = Database(spark, str(tmp_path / "other"))
        at.replace("x", spark.createDataFrame([(n, "changed") for n in range(500, 505)], "k int, v string").coalesce(1))
        (part,) = (tmp_path / "other/x.parquet").glob("part-*.parquet")
        parts[1].write_bytes(part.read_bytes())
        parts[1].with_name(f".{parts[1].name}.crc").unlink(missing_ok=True)

    def schema():
        write(spark, tmp_path / "db", b=([(1, "x", None), (2, "y", 1)], "k int, v string, more int"))

    def key():
        db.keys["c"] = ["v"]

    def dropped():
        db.drop("b")

    for n, change in enumerate((added, gone, changed, schema, key, dropped, lambda: None), 1):
        change()
        row = repo.create(db, now=T0 + timedelta(hours=n), snapshot_id=f"s{n}")
        whole = Repository(spark, f"{tmp_path}/full-{n}", "db")
        whole.create(db, now=T0, snapshot_id="w")
        assert rows(repo.store.refs(f"s{n}").select("collection", "id", "hash")) == rows(whole.store.refs("w").select("collection", "id", "hash")) and row.consistent
        assert {c: (x.doc_count, x.schema_json, x.key) for c, x in row.collections.items()} == {c: (x.doc_count, x.schema_json, x.key) for c, x in whole.get("w").collections.items()}
        files_ = ["collection", "path", "rows", "checksum"]
        assert rows(repo.files(f"s{n}").select(files_)) == rows(whole.files("w").select(files_))
        for c in db.names():
            assert rows(repo.rows(f"s{n}", c)) == rows(db.read(c))
    assert {(r.collection, r.state) for r in repo.files("s0", db).collect()} == {("a", "same"), ("a", "changed"), ("a", "gone"), ("b", "gone"), ("c", "same")}


def test_files_that_change_while_they_are_read(spark, tmp_path, repo, monkeypatch):
    db = write(spark, tmp_path / "db", a=([(n, f"v{n}") for n in range(20)], "k int, v string"))
    parts, planned, changes = sorted((tmp_path / "db/a.parquet").glob("part-*")), repo._planned, []

    def vanishing(own, parent):
        read = planned(own, parent)
        if changes:
            changes.pop()()
        return read

    monkeypatch.setattr(repo, "_planned", vanishing)
    changes.append(lambda: parts[0].unlink())
    row = repo.create(db, now=T0, snapshot_id="s1")
    assert row.consistent and row.doc_count == db.read("a").count() < 20
    changes.append(lambda: spark.createDataFrame([(50, "n")], "k int, v string").write.mode("append").parquet(f"{db.path}/a.parquet"))
    row = repo.create(db, now=T0, snapshot_id="s2")
    assert row.consistent and rows(repo.rows("s2", "a")) == rows(db.read("a"))
    grow = lambda: (changes.append(grow), spark.createDataFrame([(60 + len(rows(db.read("a"))), "n")], "k int, v string").write.mode("append").parquet(f"{db.path}/a.parquet"))
    changes.append(grow)
    assert not repo.create(db, now=T0, snapshot_id="s3").consistent
    changes.clear()
    parts[-1].write_bytes(b"no table")
    parts[-1].with_name(f".{parts[-1].name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="(?i)parquet|footer|read"):
        repo.create(db, now=T0, snapshot_id="s4")
    assert [r.snapshot_id for r in repo.log("asc").collect()] == ["s1", "s2", "s3"] and repo.store.refs("s4").count() == 0


def test_a_sweep_of_the_parent_while_its_refs_are_taken_over(spark, tmp_path, repo, monkeypatch):
    db = write(spark, tmp_path / "db", a=([(n, f"v{n}") for n in range(10)], "k int, v string"))
    repo.create(db, now=T0, snapshot_id="s1")
    other, write_files = Repository(spark, repo.root, "shop/db"), repo.store.write_files

    def crossing(*args):
        write_files(*args)
        other.create(write(spark, tmp_path / "small", a=([(1, "z")], "k int, v string")), now=T0 + timedelta(hours=1), snapshot_id="small")
        other.gc(1)

    monkeypatch.setattr(repo.store, "write_files", crossing)
    assert repo.create(db, now=T0 + timedelta(hours=2), snapshot_id="s2").new_objects == 10
    assert rows(repo.rows("s2", "a")) == rows(db.read("a")) and [r.snapshot_id for r in repo.log("asc").collect()] == ["small", "s2"]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_differences_by_ranges(spark, tmp_path, monkeypatch):
    from snaptable.sources import store as module

    monkeypatch.setattr(module, "ROWS", 100)
    repo = Repository(spark, f"{tmp_path}/it's", "d")
    own = spark.range(1000).select(F.lit("c").alias("collection"), F.format_string("id%06d", "id").alias("id"), F.lit("h").alias("hash"), F.col("id").alias("n"))
    changed = own.filter("n <> 5").withColumn("hash", F.when(F.col("n") % 400 == 7, "other").otherwise(F.col("hash"))).unionByName(own.filter("n = 9").withColumn("id", F.lit("new")))
    for name, refs in (("a", own), ("b", changed), ("same", own), ("large", own.unionByName(own.withColumn("id", F.concat("id", F.lit("x"))))), ("none", own.limit(0))):
        repo.store.write_refs(name, refs)
    left, right = repo.store.differing("a", "b")
    assert left.count() < 100 and right.count() < 100
    found = diff.diff(left, right)
    assert rows(found.select("id", "change")) == [("id000005", "removed"), ("id000007", "modified"), ("id000407", "modified"), ("id000807", "modified"), ("new", "added")]
    assert "Exchange" not in plan(found).split("== Physical Plan ==")[1]
    assert diff.diff(*repo.store.differing("a", "same")).isEmpty() and "FileScan" not in plan(repo.store.differing("a", "same")[0])
    assert rows(diff.summary(diff.diff(*repo.store.differing("a", "large")))) == [("c", 1000, 0, 0)]  # other ranges: all are read
    assert rows(diff.summary(diff.diff(*repo.store.differing("a", "none")))) == [("c", 0, 0, 1000)]
    repo.store.write_refs("near", own.unionByName(own.withColumn("id", F.concat("id", F.lit("y")))), "a")  # twice as many, laid out alike
    assert "Exchange" not in plan(diff.diff(*repo.store.differing("a", "near"))).split("== Physical Plan ==")[1]
    repo.store.write_refs("far", own.limit(3), "a")
    assert rows(diff.summary(diff.diff(*repo.store.differing("a", "far")))) == [("c", 0, 0, 997)]
    assert spark.catalog.listTables() == []


def test_restore_reads_the_store_once(spark, tmp_path, repo, monkeypatch):
    db = write(spark, tmp_path / "db", **{f"t{n}": ([(n, "x")], "k int, v string") for n in range(5)})
    repo.create(db, now=T0, snapshot_id="s1")
    scans, objects = [], repo.store.objects
    monkeypatch.setattr(repo.store, "objects", lambda *a: (scans.append(1), objects(*a))[1])
    target = Database(spark, f"{tmp_path}/t")
    repo.restore("s1", target)
    assert len(scans) == 1 and target.names() == db.names() and all(rows(target.read(c)) == rows(db.read(c)) for c in db.names())


LINES = ['{"_id": 1, "a": [1, 2.5], "b": null}', '{"_id":"1","c":{"x":"y z"}}', '{"_id":{"$oid":"5f"},"n":12345678901}', "", '{"_id":4}']


def test_json_documents(spark, tmp_path, repo):
    (tmp_path / "db").mkdir()
    (tmp_path / "db/docs.json").write_text("\n".join(LINES) + "\n")
    db = Database(spark, f"{tmp_path}/db")
    one = repo.create(db, now=T0, snapshot_id="s1")
    assert (one.doc_count, one.collections["docs"].schema_json, one.collections["docs"].key) == (4, "", ["_id"])
    more = [LINES[0].replace(" ", "  "), LINES[1], LINES[2].replace("{", "{ "), '{"_id":4,"a":null}', '{"_id":5,"new":[{"field":true}]}']
    (tmp_path / "db/docs.json").write_text("\n".join(more))
    assert repo.create(db, now=T0, snapshot_id="s2").new_objects == 2
    assert rows(repo.diff("s1", "s2").select("id", "change")) == [('{"_id":{"$numberInt":"4"}}', "modified"), ('{"_id":{"$numberInt":"5"}}', "added")]
    target = Database(spark, f"{tmp_path}/t")
    repo.restore("s1", target)
    assert rows(target.documents("docs")) == sorted((x.replace(": ", ":").replace(", ", ","),) for x in LINES if x) and target.is_json("docs")
    with pytest.raises(KeyProblem):
        repo.restore("s2", target)
    repo.restore("s2", target, mode="upsert")
    assert target.documents("docs").count() == 5 and repo.diff("s2", live=target).isEmpty()
    repo.restore("s1", target, mode="drop", now=T0)
    assert repo.diff("s1", live=target).isEmpty() and [(r.collection, r.doc_count) for r in target.stats().collect()] == [("docs", 4)]
    with pytest.raises(BadRequest):
        repo.restore("s1", write(spark, tmp_path / "typed", docs=AB), mode="upsert")
    (tmp_path / "db/docs.json").write_text('{"a":1}')
    with pytest.raises(Exception, match="no key"):
        repo.create(db)


def test_held_frames_outlive_commits(spark, tmp_path, repo):
    for n in range(2):
        repo.create(write(spark, tmp_path / "db", a=([(1, f"v{n}")], "k int, v string")), now=T0 + timedelta(hours=n), snapshot_id=f"s{n}")
    log, content, old = repo.log(), repo.diff_content("s0", "s1"), repo.rows("s0", "a")
    repo.tag("s1", "x")
    assert [tuple(r.tags) for r in log.collect()] == [(), ()] and [tuple(r.tags) for r in repo.log().collect()] == [("x",), ()]
    store = repo.store.objects()
    assert rows(repo.gc(1)) == [(1, 1)] and store.count() == 2 and repo.store.objects().count() == 1


def test_swaps_survive_a_crash(spark, tmp_path):
    """Between the two renames of a swap nothing stands at the place; the old table comes back, the new one is written again."""
    db = write(spark, tmp_path / "db", a=AB)
    files.rename(spark, f"{db.path}/a.parquet", f"{db.path}/_aside-a.parquet")
    assert db.names() == []
    files.put_back(spark, f"{db.path}/a.parquet")
    assert rows(db.read("a")) == [(1, "x"), (2, "y")]
    files.rename(spark, f"{db.path}/a.parquet", f"{db.path}/_aside-a.parquet")
    db.replace("a", spark.createDataFrame([(3, "z")], AB[1]))
    assert rows(db.read("a")) == [(3, "z")] and db.names() == ["a"]


def test_restored_keys_and_indexes(spark, tmp_path, repo):
    index = [{"name": "v1", "columns": ["v"], "options": {"sparse": "true"}}]
    db = write(spark, tmp_path / "db", a=([("x", 1), ("x", 2)], "v string, k int"))
    db.keys["a"] = ["v", "k"]
    repo.create(db, now=T0, snapshot_id="s1", indexes={"a": index})
    target = write(spark, tmp_path / "t", a=([("y", 1), ("y", 2)], "v string, k int"), other=([(1,), (1,)], "n int"))
    repo.restore("s1", target, mode="drop", now=T0)  # by v alone neither state has a key, and `other` is left alone
    assert target.key("a") == ["v", "k"]
    safety = Repository(spark, repo.root, target.path)
    assert rows(safety.rows(safety.log().first().snapshot_id, "a")) == [("y", 1), ("y", 2)]
    again = Repository(spark, f"{tmp_path}/again", "t")
    row = again.create(Database(spark, target.path, only=["a"]), now=T0)
    assert row.collections["a"].key == ["v", "k"] and [i.asDict() for i in row.collections["a"].indexes] == index


def test_unchanged_rows_are_not_stored_again(spark, tmp_path, repo):
    db = write(spark, tmp_path / "db", a=AB)
    repo.create(db, now=T0, snapshot_id="s1")
    assert repo.create(db, now=T0, snapshot_id="s2").new_objects == 0
    assert repo.store.objects().count() == 2 and repo.diff("s1", "s2").isEmpty()


def test_history(spark):
    own = spark.createDataFrame([(f"s{i}", i, "d", ["t"] if i == 1 else [], T0 + timedelta(hours=9 - i if i == 3 else i)) for i in (2, 3, 1)], "snapshot_id string, seq long, database string, tags array<string>, created_at timestamp")
    assert history.latest(own).first().snapshot_id == "s3"
    assert [r.snapshot_id for r in history.ordered(own, "asc").collect()] == ["s1", "s2", "s3"]
    for n, want in ((0, 1), (1, 2), (2, 3), (10, 3)):
        assert history.kept(own, n).count() == want == history.kept(own, n, "database").count()


def test_batches(spark):
    table = spark.createDataFrame(*AB)
    more = spark.createDataFrame([(2, "n")], "k int, v string")
    assert rows(mutate.replace(table, more, ["k"])) == [(1, "x"), (2, "n")]
    assert rows(mutate.delete(table, more, ["k"])) == [(1, "x")]
    other = spark.createDataFrame([(9, "n")], "k int, v string")
    assert mutate.insert(table, other, ["k"]).count() == 3
    for f, change in ((mutate.insert, more), (mutate.replace, other), (mutate.delete, other), (mutate.insert, other.union(other))):
        with pytest.raises(KeyProblem):
            f(table, change, ["k"])


def test_checks(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "k int, v string")
    assert rows(checks.unique_violations(df, ["v"])) == [("a", 2), (None, 2)]
    assert rows(checks.unique_violations(df, ["v"], sparse=True)) == [("a", 2)]
    assert checks.rows_without_key(df, ["v"]).count() == 2


def test_exports(spark, tmp_path):
    db, exports = write(spark, tmp_path / "db", a=AB), Exports(spark, f"{tmp_path}/e")
    exports.create(db, "p", now=T0)
    exports.create(db, "j", format="json", now=T0)
    assert [(r.name, r.doc_count, r.bytes > 0) for r in exports.catalog().orderBy("name").collect()] == [("j", 2, True), ("p", 2, True)]
    target = Database(spark, f"{tmp_path}/t")
    exports.restore("p", target)
    with pytest.raises(KeyProblem):
        exports.restore("p", target)
    exports.restore("p", target, drop=True)
    assert rows(target.read("a")) == rows(db.read("a"))
    exports.delete("p")
    with pytest.raises(NotFound):
        exports.rows("p", "a")
    assert exports.catalog().count() == 1


TYPED = "z_id int, amount decimal(9,2), at timestamp_ntz, zoned timestamp, day date, raw binary, x double, f float, small smallint, flag boolean, items array<struct<a:int,b:string>>, m map<string,bigint>, s struct<t:timestamp_ntz>"


def test_exports_keep_types_keys_and_documents(spark, tmp_path):
    values = (7, Decimal("12.30"), datetime(2024, 1, 2, 3, 4, 5, 678901), datetime(1969, 12, 31, 23, 59, 59, 1), date(1600, 2, 29), b"\x00\xff", float("nan"), 0.1, -3, True, [(1, None), None], {"b": 1, "a": None}, (T0,))
    db = write(spark, tmp_path / "db", types=([values, (8, *[None] * 12)], TYPED), empty=([], "k int, v array<float>"))
    (tmp_path / "db/docs.json").write_text("\n".join(LINES))
    db.declare("types", ["z_id"], [{"name": "i", "columns": ["day"], "options": {"sparse": "true"}}])
    db.declare("docs", ["_id"])
    exports = Exports(spark, f"{tmp_path}/e")
    for format in ("json", "parquet"):
        exports.create(db, format, format=format, now=T0)
        target = Database(spark, f"{tmp_path}/{format}")
        exports.restore(format, target)
        assert target.read("types").schema == db.read("types").schema and target.read("empty").schema == db.read("empty").schema
        assert repr(rows(target.read("types"))) == repr(rows(db.read("types"))) and target.declared() == db.declared() | {"empty": {"key": ["k"], "indexes": []}}
        assert {x["id"] for x in target.encoded("docs").collect()} == {x["id"] for x in db.encoded("docs").collect()} and repr(rows(exports.rows(format, "types"))) == repr(rows(db.read("types")))
        with pytest.raises(KeyProblem):
            exports.restore(format, target)
        exports.restore(format, target, drop=True)
        assert exports.verify(format).isEmpty() and target.documents("docs").count() == 4


@pytest.mark.parametrize("format", ["json", "parquet"])
def test_damaged_exports_replace_nothing(spark, tmp_path, format):
    db = write(spark, tmp_path / "db", a=([(n, f"v{n}" * 50) for n in range(300)], "k int, v string"), b=AB)
    exports, target = Exports(spark, f"{tmp_path}/e"), write(spark, tmp_path / "t", a=([(1, "own")], "k int, v string"))
    exports.create(db, "x", format=format, now=T0)
    parts = sorted(p for p in (tmp_path / f"e/exports/x/b.{format}").glob("part-*"))
    kept = {p: p.read_bytes() for p in parts}
    other = gzip.compress(gzip.decompress(kept[parts[0]]).replace(b"x", b"q")) if format == "json" else kept[parts[0]][: len(kept[parts[0]]) // 2]
    for damage in (lambda: parts[0].unlink(), lambda: parts[0].write_bytes(other), lambda: parts[0].write_bytes(kept[parts[0]][:-9]), lambda: (tmp_path / f"e/exports/x/b.{format}/part-extra").write_bytes(b"")):
        damage()
        with pytest.raises(Damaged, match="of b"):
            exports.restore("x", target, drop=True)
        assert target.names() == ["a"] and rows(target.read("a")) == [(1, "own")] and not exports.verify("x").isEmpty()
        for p, data in kept.items():
            p.write_bytes(data)
            p.with_name(f".{p.name}.crc").unlink(missing_ok=True)
    (tmp_path / f"e/exports/x/b.{format}/part-extra").unlink()
    exports.restore("x", target, drop=True)
    assert target.names() == ["a", "b"] and target.read("a").count() == 300
    (tmp_path / "e/exports/x/_manifest.json").unlink()
    with pytest.raises(Damaged, match="no manifest"):
        exports.restore("x", target, drop=True)


def test_collections(spark, tmp_path):
    db = write(spark, tmp_path / "db", a=AB)
    db.create("b", "k int, v string")
    stats = {r.collection: (r.doc_count, r.storage_size > 0) for r in db.stats().collect()}
    assert stats == {"a": (2, True), "b": (0, True)}
    (tmp_path / "db/broken.parquet").write_text("no table")
    assert [(r.collection, r.doc_count, r.storage_size > 0) for r in db.stats().collect()] == [("a", 2, True), ("b", 0, True), ("broken", 0, False)]
    (tmp_path / "db/broken.parquet").unlink()
    spark.range(5).write.parquet(f"{tmp_path}/db/half.parquet")  # its schema can be read, one of its files not
    sorted((tmp_path / "db/half.parquet").glob("part-*"))[-1].write_bytes(b"PAR1 cut off")
    assert [tuple(r)[:2] for r in db.stats().collect()] == [("a", 2), ("b", 0), ("half", 0)]
    db.drop("half")
    assert Database(spark, f"{tmp_path}/nothing").stats().count() == 0
    db.drop("a")
    assert db.names() == ["b"]
    with pytest.raises(NotFound):
        db.read("a")


def test_periodic(spark, tmp_path, repo, monkeypatch):
    db = write(spark, tmp_path / "db", a=AB)
    read, encoded_ = [], db.encoded
    monkeypatch.setattr(db, "encoded", lambda c, pinned=None, schema_json=None: (read.append(len(pinned or [])), encoded_(c, pinned, schema_json))[1])
    for _ in range(2):
        periodic(repo, db, "a", f"{tmp_path}/ck", now=T0).awaitTermination()
        assert [r.snapshot_id for r in repo.log().collect()] == ["auto-00000000"]
    spark.createDataFrame([(5, "n")], AB[1]).write.mode("append").parquet(f"{tmp_path}/db/a.parquet")
    read.clear()
    periodic(repo, db, "a", f"{tmp_path}/ck", now=T0).awaitTermination()
    assert [r.doc_count for r in repo.log("asc").collect()] == [2, 3]
    new = [p for p, *_ in db.pin()["a"] if p not in {r.path for r in repo.files("auto-00000000").collect()}]
    assert read and max(read) <= len(new) < len(db.pin()["a"])


def test_rows_of_a_file_do_not_go_to_one_task(spark, tmp_path, repo, monkeypatch):
    write(spark, tmp_path / "db", a=AB)
    plans, write_refs = [], Store.write_refs
    monkeypatch.setattr(Store, "write_refs", lambda self, name, refs, *a: (plans.append(plan(refs).split("== Physical Plan ==")[1]), write_refs(self, name, refs, *a)))
    repo.create(Database(spark, f"{tmp_path}/db"), snapshot_id="s1")
    assert "hashpartitioning" not in plans[0]


def test_texts_of_a_first_snapshot_are_not_exchanged(spark, tmp_path, repo, monkeypatch):
    plans, stage = [], Store.stage
    monkeypatch.setattr(Store, "stage", lambda self, objects, batch: (plans.append(plan(objects).split("== Physical Plan ==")[1]), stage(self, objects, batch))[1])
    one = write(spark, tmp_path / "one", a=AB, b=([(1, 2)], "k int, n int"))
    assert repo.create(one, snapshot_id="s1").new_objects == 3 and "Exchange" not in plans[-1]
    # Tables with the same fields, and documents, may share rows.
    two, texts = write(spark, tmp_path / "two", a=AB, b=AB, c=([(1,)], "n int")), f"{tmp_path}/two/d.json"
    other = Repository(spark, f"{tmp_path}/store2", "d")
    assert other.create(two, snapshot_id="s1").new_objects == 3 and "Exchange" in plans[-1]
    spark.createDataFrame([('{"_id": 1}',), ('{"n": 1, "_id": 2}',)], "value string").write.text(texts)
    two = Database(spark, two.path)
    both = Repository(spark, f"{tmp_path}/store3", "d")
    assert both.create(two, snapshot_id="s1").new_objects == 5
    assert both.store.objects().count() == 5 == both.store.hashes().distinct().count()
    target = Database(spark, f"{tmp_path}/target")
    both.restore("s1", target)
    assert all(rows(target.read(c)) == rows(two.read(c)) for c in "abc")
    single = Database(spark, f"{tmp_path}/single")
    both.restore("s1", single, "b")
    assert rows(single.read("b")) == rows(two.read("b"))


def test_restored_documents_are_not_parsed_again_for_their_keys(spark, tmp_path, repo, monkeypatch):
    for name, lines in (("db", ['{"_id": 1, "n": 2.5}', '{"_id": {"$oid": "5f"}}']), ("target", ['{"_id":1}', '{"_id":3}'])):
        spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{tmp_path}/{name}/d.json")
    repo.create(Database(spark, f"{tmp_path}/db"), snapshot_id="s1")
    parsed, keyed = [], mutate.keyed_documents
    monkeypatch.setattr(mutate, "keyed_documents", lambda *a: (parsed.append(a), keyed(*a))[1])
    target = Database(spark, f"{tmp_path}/target")
    repo.restore("s1", target, mode="upsert")
    assert len(parsed) == 1 and rows(target.documents("d")) == [('{"_id":1,"n":2.5}',), ('{"_id":3}',), ('{"_id":{"$oid":"5f"}}',)]
