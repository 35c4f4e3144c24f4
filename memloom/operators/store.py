"""Item table maintenance: upsert, patch, cascading deletes, chains and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.ids import hash_of_content
from memloom.functions.redact import redact
from memloom.operators.embed import HASH_MODEL, Embedder, hash_embedder
from memloom.operators.items import scope_join
from memloom.schemas import SCOPE
from memloom.session import broadcast_if_small, cut_lineage

#: Room for an id in a broadcast.
ID_BYTES = 48


def merge_items(store: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Insert-or-touch by (scope, content_hash).

    A repeat refreshes updated_at, takes the newer source and the greater confidence; type,
    content and embedding stay. batch has the store's columns plus `seq`.
    """
    columns = store.columns
    rest = [c for c in columns if c not in (*SCOPE, "content_hash")]
    tagged = store.withColumn("seq", F.lit(-1).cast("long")).unionByName(
        batch.withColumn("seq", F.col("seq").cast("long")).select(*columns, "seq")
    )
    folded = tagged.groupBy(*SCOPE, "content_hash").agg(
        F.min_by(F.struct(*rest), "seq").alias("old"),
        F.max("confidence").alias("confidence"),
        F.max_by("source", "seq").alias("source"),
        F.max("seq").alias("last"),
    )
    changed = {"confidence": F.col("confidence"), "source": F.col("source"),
               "updated_at": F.when(F.col("last") >= 0, now).otherwise(F.col("old.updated_at"))}
    return folded.select(*[
        F.col(c) if c in (*SCOPE, "content_hash") else changed.get(c, F.col(f"old.{c}")).alias(c)
        for c in columns
    ])


def update_items(store: DataFrame, patches: DataFrame, now: Column, embedder: Embedder | None = None, model: str = HASH_MODEL) -> DataFrame:
    """Patch content, type or confidence of items in scope; new content is redacted, re-hashed and re-embedded.

    patches(item_id, scope, new_content, new_type, new_confidence), nulls leave a field alone.
    """
    embed = embedder or hash_embedder("new_content", output="new_embedding")
    clean = redact(patches, "new_content").withColumn("new_content", F.col("redacted"))
    ready = embed(clean.where(~F.coalesce("rejected", F.lit(False)))).select(
        "item_id", *SCOPE, "new_content", "new_type", "new_confidence", "new_embedding"
    )
    joined = store.join(ready, ["item_id", *SCOPE], "left").withColumn(
        "_hit", F.col("new_content").isNotNull() | F.col("new_type").isNotNull() | F.col("new_confidence").isNotNull()
    )
    fresh = F.col("new_content").isNotNull()
    return joined.withColumns({
        "content": F.coalesce("new_content", "content"),
        "content_hash": F.when(fresh, hash_of_content(F.col("new_content"))).otherwise(F.col("content_hash")),
        "type": F.coalesce("new_type", "type"),
        "confidence": F.coalesce(F.col("new_confidence").cast("float"), "confidence"),
        "embedding": F.when(fresh, F.col("new_embedding")).otherwise(F.col("embedding")),
        "embedding_model": F.when(fresh, F.lit(model)).otherwise(F.col("embedding_model")),
        "updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at")),
    }).select(*store.columns)


def delete_items(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Remove items(item_id) with their links; pointers to them become null, so an older version is live again."""
    ids = gone.select("item_id").distinct()
    if "relations" in tables:
        # The relations are many: they stay where they lie as long as the ids fit a broadcast.
        ids = broadcast_if_small(ids, ids.count(), ID_BYTES)
    dead = ids.withColumn("_dead", F.lit(True))

    def nulled(df: DataFrame, column: str) -> DataFrame:
        # Most rows point nowhere: they stay out of the join, where they would all share the null key.
        marked = df.where(F.col(column).isNotNull()).join(dead.withColumnRenamed("item_id", column), column, "left")
        told = marked.withColumn(column, F.when(F.col("_dead").isNull(), F.col(column))).select(*df.columns)
        return df.where(F.col(column).isNull()).unionByName(told)

    out = dict(tables)
    out["items"] = nulled(tables["items"].join(ids, "item_id", "left_anti"), "superseded_by")
    if "links" in tables:
        out["links"] = tables["links"].join(ids, "item_id", "left_anti")
    if "relations" in tables:
        out["relations"] = nulled(tables["relations"], "evidence_item")
    return out


def undo_conversation(tables: dict[str, DataFrame], requests: DataFrame) -> dict[str, DataFrame]:
    """Delete everything that the requested conversations(scope, conversation_id) wrote."""
    wanted = requests.select(*SCOPE, "conversation_id").distinct()
    gone = scope_join(wanted, tables["items"].select(*SCOPE, "conversation_id", "item_id"), on=("conversation_id",))
    return delete_items(tables, gone)


def delete_scope(tables: dict[str, DataFrame], scopes: DataFrame) -> dict[str, DataFrame]:
    """Drop all items and entities of the given scopes, with the same cascades."""
    keys = scopes.select(*SCOPE).distinct()
    out = delete_items(tables, tables["items"].join(keys, SCOPE, "left_semi"))
    if "entities" in tables:
        lost = tables["entities"].join(keys, SCOPE, "left_semi").select("entity_id")
        out["entities"] = tables["entities"].join(keys, SCOPE, "left_anti")
        if "links" in out:
            out["links"] = out["links"].join(lost, "entity_id", "left_anti")
        if "relations" in out:
            n = lost.count()
            for end in ("from_entity", "to_entity"):
                out["relations"] = out["relations"].join(broadcast_if_small(lost.withColumnRenamed("entity_id", end), n, ID_BYTES), end, "left_anti")
    return out


def supersede_chain(items: DataFrame) -> DataFrame:
    """(item_id, current_id, hops) by pointer doubling: the number of rounds is the log of the longest chain.

    Items on a cycle have no current version and get a null current_id.
    """
    pointer = items.select("item_id", F.coalesce("superseded_by", "item_id").alias("to"),
                           F.col("superseded_by").isNotNull().cast("long").alias("hops"))
    known = items.select(F.col("item_id").alias("to")).distinct()
    state = cut_lineage(pointer.join(known, "to", "left_semi").select("item_id", "to", "hops"))
    total = state.count()
    for _ in range(max(1, total.bit_length() + 1)):
        jump = state.select(F.col("item_id").alias("to"), F.col("to").alias("beyond"), F.col("hops").alias("more"))
        stepped = state.join(jump, "to").select(
            "item_id", F.col("beyond").alias("to"), (F.col("hops") + F.col("more")).alias("hops")
        )
        stepped = cut_lineage(stepped)
        moved = stepped.join(state, ["item_id", "to"], "left_anti").isEmpty()
        state = stepped
        if moved:
            break
    rests = items.where(F.col("superseded_by").isNull()).select(F.col("item_id").alias("to"), F.lit(True).alias("_end"))
    ended = state.join(rests, "to", "left")
    return ended.select(
        "item_id", F.when(F.col("_end"), F.col("to")).alias("current_id"),
        F.when(F.col("_end"), F.col("hops")).alias("hops"),
    )


def _versions(spark: SparkSession, root: str) -> list[str]:
    """Complete versions below root in order: those whose writer left its success mark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v-*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().getParent().getName() for s in found or [])


def write_snapshot(df: DataFrame, root: str, number: int | None = None, partition_by: str | None = "tenant") -> str:
    """Write a new version, by default the next number; the newest complete version is the table.

    Nothing is moved or deleted, so a reader sees the old or the new one whatever fails in between, and
    writing the same number again replaces only itself.
    """
    spark = df.sparkSession
    if number is None:
        number = int(([f"v-{-1:012d}", *_versions(spark, root)][-1]).removeprefix("v-")) + 1
    version = f"v-{number:012d}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{root}/{version}")
    return version


def read_snapshot(spark: SparkSession, root: str, schema=None, before: int | None = None) -> DataFrame | None:
    """The newest complete version (older than number `before`, where one is given), or None before the first."""
    versions = [v for v in _versions(spark, root) if before is None or int(v.removeprefix("v-")) < before]
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{root}/{versions[-1]}") if versions else None
