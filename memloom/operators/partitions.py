"""Stored tables in fixed hash partitions, of which a change writes only those it touches.

Every row has a partition: a tenant owns `spread` of the `parts` partitions, and a row's key chooses one of
them; tables without a tenant are dealt over all. A change of some rows reads the partitions they lie in,
replaces the rows, and writes these partitions into a folder that carries the change's number. A small
version table then names the folder of each partition. It is written last and at once for all tables,
so readers see the whole change or nothing of it, and a change that is played again starts from the
version before it and replaces only its own folders.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.store import merge_items
from memloom.schemas import ITEM, SCOPE
from memloom.session import broadcast_if_small, cut_lineage

#: The tables that a write extends: schema, key columns, and whether rows belong to a tenant.
TABLES = {
    "items": (ITEM, ["item_id"], True),
    "entities": ("tenant string, user_id string, project string, entity_id string, name_norm string, name string, kind string", ["entity_id"], True),
    "links": ("item_id string, entity_id string", ["item_id", "entity_id"], False),
    "relations": ("rel_id string, from_entity string, to_entity string, type string, weight double, evidence_item string", ["rel_id"], False),
}
_POINTERS = "name string, part int, version long, parts int, spread int"
_PART = "_part"


@dataclass
class Change:
    """Rows of a table as they are from now on, and keys that are gone."""

    rows: DataFrame
    gone: DataFrame | None = None


@dataclass
class Written:
    """What a commit did: its number and the partitions it wrote of each table."""

    number: int
    touched: dict[str, list[int]] = field(default_factory=dict)


def _files(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the folders that hold a match of pattern (folder/file), oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().getParent().getName() for s in found or [])


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class PartStore:
    """The tables below `root`. `parts` and `spread` are fixed when the first change is written."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 256, spread: int = 16, tables: dict | None = None) -> None:
        if parts < 1 or spread < 1 or parts % spread:
            raise ValueError("parts must be a multiple of spread")
        self.spark, self.root, self.parts, self.spread = spark, root, parts, spread
        self.tables = tables or TABLES

    # --- where a row lies -------------------------------------------------------------------

    def part_of(self, name: str) -> Column:
        """The partition of a row, from its tenant and the first key column."""
        _, keys, owned = self.tables[name]
        key = F.xxhash64(keys[0])
        if not owned:
            return F.pmod(key, F.lit(self.parts)).cast("int")
        home = F.pmod(F.xxhash64(F.lit("tenant"), "tenant"), F.lit(self.parts // self.spread)) * self.spread
        return (home + F.pmod(key, F.lit(self.spread))).cast("int")

    def parts_of_keys(self, name: str, rows: DataFrame) -> list[int]:
        """The partitions of rows(keys[, tenant]): at most `parts` numbers."""
        return sorted(r[0] for r in rows.select(self.part_of(name).alias(_PART)).distinct().collect())

    def parts_of_tenants(self, rows: DataFrame) -> list[int]:
        """All partitions of the tenants that occur in rows(tenant)."""
        home = F.pmod(F.xxhash64(F.lit("tenant"), "tenant"), F.lit(self.parts // self.spread)).cast("int")
        homes = [r[0] for r in rows.select(home.alias("home")).distinct().collect()]
        return sorted(h * self.spread + i for h in homes for i in range(self.spread))

    # --- versions ---------------------------------------------------------------------------

    def versions(self) -> list[int]:
        """Numbers of the complete versions, oldest first."""
        return [int(v.removeprefix("v-")) for v in _files(self.spark, f"{self.root}/versions/v-*/_SUCCESS")]

    def pointers(self, before: int | None = None) -> dict[tuple[str, int], int]:
        """(table, partition) to the number of the folder that holds it, as of the newest version (before a number)."""
        held = [v for v in self.versions() if before is None or v < before]
        if not held:
            return {}
        # One row per table and partition, whatever the tables hold.
        rows = self.spark.read.schema(_POINTERS).parquet(f"{self.root}/versions/v-{held[-1]:012d}").collect()
        if any((r["parts"], r["spread"]) != (self.parts, self.spread) for r in rows):
            raise ValueError(f"the store was written with parts={rows[0]['parts']}, spread={rows[0]['spread']}")
        return {(r["name"], r["part"]): r["version"] for r in rows}

    def _folder(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v-{version:012d}"

    # --- reading ----------------------------------------------------------------------------

    def read(self, name: str, parts: list[int] | None = None, before: int | None = None) -> DataFrame:
        """A table, or some partitions of it; empty before the first version."""
        schema = self.tables[name][0]
        wanted = None if parts is None else set(parts)
        paths = [f"{self._folder(name, version)}/{_PART}={part}" for (table, part), version in sorted(self.pointers(before).items())
                 if table == name and (wanted is None or part in wanted)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read_tenants(self, name: str, rows: DataFrame, before: int | None = None) -> DataFrame:
        """The partitions of the tenants in rows(tenant); other tenants may share them."""
        return self.read(name, self.parts_of_tenants(rows), before)

    def read_keys(self, name: str, rows: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of a table with the keys(keys[, tenant]) of rows, from the partitions where they can lie."""
        keys = self.tables[name][1]
        return self.read(name, self.parts_of_keys(name, rows), before).join(rows.select(*keys).distinct(), keys, "left_semi")

    # --- writing ----------------------------------------------------------------------------

    def commit(self, changes: dict[str, Change], number: int | None = None) -> Written:
        """Write a new version, by default the next number, from the one before it.

        Rows replace the stored rows of their keys; a change without rows writes no partition. Keys of
        `gone` need the tenant where the table has one. Rows must be unique by key.
        """
        if number is None:
            number = (self.versions() or [-1])[-1] + 1
        pointers, written = self.pointers(before=number), Written(number)
        for name, change in changes.items():
            _, keys, owned = self.tables[name]
            where = ["tenant", *keys] if owned else keys
            rows = cut_lineage(change.rows, f"change-{name}")
            lost = rows.select(*where)
            if change.gone is not None:
                lost = cut_lineage(lost.unionByName(change.gone.select(*where)).distinct(), f"change-{name}")
            touched = self.parts_of_keys(name, lost)
            written.touched[name] = touched
            if not touched:
                continue
            kept = self.read(name, touched, number).join(self._small(lost.select(*keys)), keys, "left_anti")
            columns = kept.columns
            after = kept.unionByName(rows.select(*columns)).withColumn(_PART, self.part_of(name))
            # Rebalanced, so that a large partition is written by several tasks and small ones share one.
            folder = self._folder(name, number)
            after.hint("rebalance", _PART).write.mode("overwrite").partitionBy(_PART).parquet(folder)
            left = {int(p.split("=")[1]) for p in _files(self.spark, f"{folder}/{_PART}=*/*.parquet")}
            for part in touched:
                pointers.pop((name, part), None)
                if part in left:
                    pointers[name, part] = number
        table = [(n, p, v, self.parts, self.spread) for (n, p), v in sorted(pointers.items())]
        self.spark.createDataFrame(table, _POINTERS).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/versions/v-{number:012d}")
        return written

    def _small(self, keys: DataFrame) -> DataFrame:
        return broadcast_if_small(keys, keys.count(), 128)

    def replace(self, name: str, after: DataFrame, number: int | None = None) -> Written:
        """Make `after` the table: rows that differ, come or go are found by key, and only their partitions written."""
        _, keys, owned = self.tables[name]
        where = ["tenant", *keys] if owned else keys
        before = self.read(name, before=number)
        # Hashing skips nulls, so it is told where they are.
        digest = lambda df: F.xxhash64(*[F.col(c) for c in before.columns], *[F.isnull(c) for c in before.columns])
        old = before.select(*where, digest(before).alias("_old"))
        both = after.select(*before.columns).withColumn("_new", digest(after)).join(old, where, "left")
        rows = both.where(F.col("_old").isNull() | (F.col("_old") != F.col("_new"))).select(*before.columns)
        gone = old.select(*where).join(after.select(*keys), keys, "left_anti")
        return self.commit({name: Change(rows, gone)}, number)

    def upsert_items(self, batch: DataFrame, now: Column, number: int | None = None) -> Written:
        """Insert-or-touch a batch of items (with `seq`) by scope and content hash: see merge_items."""
        batch = cut_lineage(batch, "upsert")
        wanted = batch.select(*SCOPE, "content_hash").distinct()
        held = self.read_tenants("items", wanted, number).join(wanted, [*SCOPE, "content_hash"], "left_semi")
        return self.commit({"items": Change(merge_items(held, batch, now))}, number)

    # --- retention --------------------------------------------------------------------------

    def retain(self, keep: int = 2) -> list[str]:
        """Drop all versions but the newest `keep`, and the partition folders that only they name; returns the folders.

        Two at least stay, so that the newest change can be played again. Readers of older versions lose them.
        """
        versions = self.versions()
        cut = max(2, keep)
        if len(versions) <= cut:
            return []
        old, kept = versions[:-cut], versions[-cut:]
        used = {(n, p, v) for number in kept for (n, p), v in self.pointers(before=number + 1).items()}
        dropped = []
        # The version table goes first: no complete version ever names a folder that is gone.
        for number in old:
            _remove(self.spark, f"{self.root}/versions/v-{number:012d}")
        for name in self.tables:
            for number in {int(v.removeprefix("v-")) for v in _files(self.spark, f"{self.root}/{name}/v-*/_SUCCESS")}:
                if number > old[-1]:
                    continue
                folder = self._folder(name, number)
                parts = sorted({int(p.split("=")[1]) for p in _files(self.spark, f"{folder}/{_PART}=*/*.parquet")})
                unused = [p for p in parts if (name, p, number) not in used]
                if len(unused) == len(parts):
                    dropped.append(folder)
                    _remove(self.spark, folder)
                else:
                    for part in unused:
                        dropped.append(f"{folder}/{_PART}={part}")
                        _remove(self.spark, dropped[-1])
        return dropped
