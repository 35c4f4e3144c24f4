"""The partitioned store writes what a change touches, and nothing else."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memloom.operators.partitions import Change, PartStore
from memloom.operators.reconcile import reconcile
from memloom.operators.store import merge_items
from memloom.plans.ingest import write_changes, write_items
from memloom.schemas import ITEM
from memloom.session import scratch_path

def now():
    return F.lit(datetime(2024, 5, 1)).cast("timestamp")


def items_of(spark, n, tenants=1, start=0):
    ids = spark.range(start, start + n)
    return ids.select(
        F.format_string("i%07d", "id").alias("item_id"), F.format_string("t%d", F.col("id") % tenants).alias("tenant"), F.lit("u").alias("user_id"),
        F.lit("p").alias("project"), F.lit("fact").alias("type"), F.format_string("content %d", "id").alias("content"),
        F.format_string("h%d", "id").alias("content_hash"), F.lit("s").alias("source"), F.lit(0.5).cast("float").alias("confidence"),
        now().alias("created_at"), now().alias("updated_at"), F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("string").alias("conversation_id"),
        F.lit("m").alias("embedding_model"), F.array(F.lit(1.0).cast("float")).alias("embedding"))


def files(root):
    """Path below root to size of all data files."""
    return {os.path.relpath(os.path.join(d, f), root): os.path.getsize(os.path.join(d, f))
            for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def data(root):
    return {p: n for p, n in files(root).items() if not p.startswith("versions")}


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def root(spark):
    return scratch_path(spark, "store")


def test_untouched_partitions_are_not_written(spark, root):
    store = PartStore(spark, root, parts=100, spread=100)
    store.commit({"items": Change(items_of(spark, 20_000))})
    before = data(root)
    assert len({p.split("/")[2] for p in before}) == 100
    # Three rows change, one comes, one goes.
    changed = items_of(spark, 20_000).where("item_id in ('i0000007', 'i0000100', 'i0012345')").withColumn("type", F.lit("note"))
    new, gone = items_of(spark, 1, start=30_000), items_of(spark, 20_000).where("item_id = 'i0000009'")
    written = store.commit({"items": Change(changed.unionByName(new), gone)})
    assert len(written.touched["items"]) <= 5
    after = data(root)
    assert {p: after[p] for p in before} == before
    fresh = {p: n for p, n in after.items() if p not in before}
    assert {int(p.split("/")[2].split("=")[1]) for p in fresh} == set(written.touched["items"])
    assert sum(fresh.values()) < 0.1 * sum(before.values())
    want = items_of(spark, 20_000).where("item_id not in ('i0000007', 'i0000100', 'i0012345', 'i0000009')").unionByName(changed).unionByName(new)
    assert rows_of(store.read("items").select("item_id", "type")) == rows_of(want.select("item_id", "type"))


def test_a_replay_replaces_only_itself(spark, root):
    store = PartStore(spark, root, parts=8, spread=4)
    store.commit({"items": Change(items_of(spark, 200, 3))}, 0)
    one, two = (items_of(spark, 20, 3).withColumn("type", F.lit(t)) for t in ("note", "decision"))
    store.commit({"items": Change(one)}, 1)
    whole, kept = rows_of(store.read("items")), data(root)
    # Played again after a crash before its version was named, and after it was.
    os.remove(f"{root}/versions/v-{1:012d}/_SUCCESS")
    assert rows_of(store.read("items").where("type = 'note'")) == []
    for _ in range(2):
        store.commit({"items": Change(one)}, 1)
        assert rows_of(store.read("items")) == whole
        assert {p.rsplit("/", 1)[0] for p in data(root)} == {p.rsplit("/", 1)[0] for p in kept}
    store.commit({"items": Change(two)}, 2)
    assert store.read("items").where("type = 'decision'").count() == 20
    assert rows_of(store.read("items", before=2)) == whole


def test_emptied_partitions_and_layout(spark, root):
    store = PartStore(spark, root, parts=4, spread=2)
    store.commit({"items": Change(items_of(spark, 10))})
    store.commit({"items": Change(items_of(spark, 0), items_of(spark, 10))})
    assert store.read("items").count() == 0 and store.pointers() == {}
    store.commit({"items": Change(items_of(spark, 3))})
    assert store.read("items").count() == 3
    assert store.commit({"items": Change(items_of(spark, 0))}).touched == {"items": []}
    with pytest.raises(ValueError, match="parts=4"):
        PartStore(spark, root, parts=8, spread=2).read("items")


def test_tenants_are_read_from_their_partitions(spark, root):
    store = PartStore(spark, root, parts=64, spread=4)
    store.commit({"items": Change(items_of(spark, 3000, 40))})
    asked = spark.createDataFrame([("t7",)], "tenant string")
    part = store.read_tenants("items", asked)
    assert part.where("tenant = 't7'").count() == 75 and part.count() < 1500
    assert len(part.inputFiles()) < len(store.read("items").inputFiles())


def test_retention_keeps_what_the_kept_versions_name(spark, root):
    store = PartStore(spark, root, parts=16, spread=16)
    for n in range(6):
        store.commit({"items": Change(items_of(spark, 400 if n == 0 else 3).withColumn("type", F.lit(f"n{n}")))})
    whole = [rows_of(store.read("items", before=b)) for b in (5, 6)]
    dropped = store.retain(2)
    assert store.versions() == [4, 5] and dropped
    assert [rows_of(store.read("items", before=b)) for b in (5, 6)] == whole
    assert store.retain(2) == []
    store.commit({"items": Change(items_of(spark, 3))}, 5)
    assert store.read("items").where("type = 'fact'").count() == 3


def test_upsert_equals_the_whole_merge(spark, root):
    store = PartStore(spark, root, parts=32, spread=32)
    held = items_of(spark, 300)
    batch = items_of(spark, 40, start=290).withColumns({"source": F.lit("again"), "confidence": F.lit(0.9).cast("float")}).withColumn("seq", F.monotonically_increasing_id())
    store.commit({"items": Change(held)})
    store.upsert_items(batch, now())
    columns = held.columns
    assert rows_of(store.read("items").select(*columns)) == rows_of(merge_items(held, batch, now()).select(*columns))


def test_replace_writes_differences(spark, root):
    store = PartStore(spark, root, parts=32, spread=32)
    held = items_of(spark, 500)
    store.commit({"items": Change(held)})
    after = held.where("item_id <> 'i0000003'").withColumn("superseded_by", F.when(F.col("item_id") == "i0000004", "i0000005"))
    written = store.replace("items", after)
    assert 1 <= len(written.touched["items"]) <= 2
    assert rows_of(store.read("items").select(*after.columns)) == rows_of(after)
    assert store.replace("items", after).touched["items"] == []


def test_changes_of_a_write_equal_the_whole_write(spark, root):
    schema = ("seq long, tenant string, user_id string, project string, type string, content string, source string, confidence double, "
              "entities array<struct<name:string,kind:string>>")
    entity = lambda *names: [(n, "tool") for n in names]
    first = [(0, "t", "u", "p", "fact", "Parquet files are columnar and compress well", "s", 0.9, entity("Parquet", "Columns")),
             (1, "t", "u", "p", "note", "Tea is better than coffee in the early morning", "s", 0.8, entity("Tea")),
             (2, "x", "u", "p", "note", "Another tenant keeps this to itself", "s", 0.8, entity("Tea", "Parquet"))]
    second = [(0, "t", "u", "p", "fact", "Parquet files are columnar and compress well", "later", 0.95, entity("Parquet", "Columns", "Files")),
              (1, "t", "u", "p", "note", "Tea is better than coffee in the early morning!", "s", 0.8, entity("Tea", "Coffee")),
              (2, "t", "u", "p", "note", " ", "s", 0.8, entity("Nobody"))]
    store = PartStore(spark, root, parts=64, spread=16)
    tables = {"items": spark.createDataFrame([], ITEM), **{n: store.read(n) for n in ("entities", "links", "relations")}}
    for number, rows in enumerate((first, second)):
        writes = spark.createDataFrame(rows, schema)
        outcomes, changes = write_changes(writes, store, now(), number=number)
        store.commit(changes, number)
        told, tables = write_items(writes, tables, now())
        assert rows_of(outcomes) == rows_of(told)
        for name, whole in tables.items():
            assert rows_of(store.read(name).select(*whole.columns)) == rows_of(whole), name
    assert store.read("items").count() == 3
