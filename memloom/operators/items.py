"""Scope joins, filters, lookups and listings over items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import render
from memloom.functions.scope import scope_key
from memloom.schemas import MEMORY_TYPES, SCOPE


def scope_join(requests: DataFrame, rows: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows visible to each request; a null project sees all of the user's projects.

    One equi-join on tenant and user (and `on`), with the project as a condition inside the
    join, so the rows are read once. The project in the result is the row's own.
    """
    wanted = requests.withColumnRenamed("project", "_wanted")
    met = wanted.join(rows, ["tenant", "user_id", *on])
    return met.where(F.col("_wanted").isNull() | (F.col("_wanted") == F.col("project"))).drop("_wanted")


def live_filter(items: DataFrame, include_superseded: bool = False) -> DataFrame:
    return items if include_superseded else items.where(F.col("superseded_by").isNull())


def type_filter(items: DataFrame, types: list[str] | None = None) -> DataFrame:
    return items.where(F.col("type").isin(types)) if types else items


def type_allowed(types: Column, type_: Column) -> Column:
    """Per-request type list; absent or empty means every type."""
    return types.isNull() | (F.size(types) == 0) | F.array_contains(types, type_)


def embedded_filter(items: DataFrame) -> DataFrame:
    return items.where(F.col("embedding").isNotNull())


def contains_filter(items: DataFrame, text: str) -> DataFrame:
    return items.where(F.col("content").ilike(f"%{text}%"))


def confidence_floor(candidates: DataFrame, floor: float = 0.6) -> DataFrame:
    """Add the reason a candidate is dropped for low confidence, or null."""
    low = F.col("confidence") < F.lit(floor)
    reason = F.format_string(f"confidence %.2f below threshold {floor}", F.col("confidence"))
    return candidates.withColumn("reason", F.when(low, reason))


def validate_write(writes: DataFrame) -> DataFrame:
    """Add reject_reason; null means the write is accepted."""
    return writes.withColumn(
        "reject_reason", render.write_error(F.col("type"), F.col("content"), F.col("source"))
    )


def get_items(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """Items by (scope, item_id); a wanted row with a null project spans projects."""
    pinned = wanted.where(F.col("project").isNotNull()).select(*SCOPE, "item_id")
    spanning = wanted.where(F.col("project").isNull()).select("tenant", "user_id", "item_id")
    by_pin = items.join(pinned, [*SCOPE, "item_id"], "left_semi")
    by_span = items.join(spanning, ["tenant", "user_id", "item_id"], "left_semi")
    return by_pin.unionByName(by_span).dropDuplicates(["item_id"])


def get_item(items: DataFrame, tenant: str, user_id: str, project: str | None, item_id: str) -> DataFrame:
    where = (F.col("item_id") == item_id) & (F.col("tenant") == tenant) & (F.col("user_id") == user_id)
    return items.where(where if project is None else where & (F.col("project") == project))


def count_items(items: DataFrame) -> DataFrame:
    return items.groupBy(*SCOPE).agg(F.count("*").alias("n"))


def count_visible(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Items visible to each request: counted per scope first, then summed over scopes."""
    visible = scope_join(requests.select("query_id", *SCOPE), count_items(items))
    totals = visible.groupBy("query_id").agg(F.sum("n").alias("n"))
    return requests.select("query_id").join(totals, "query_id", "left").fillna(0, ["n"])


def list_items(
    requests: DataFrame,
    items: DataFrame,
    limit: int = 50,
    offset: int = 0,
    types: list[str] | None = None,
    contains: str | None = None,
    include_superseded: bool = False,
) -> DataFrame:
    """A page per request, newest confirmed first, with the unpaged total."""
    kept = type_filter(live_filter(items, include_superseded), types)
    if contains:
        kept = contains_filter(kept, contains)
    # No page reaches deeper into a scope than its end, so each scope keeps only its newest rows before it is joined.
    scope = Window.partitionBy(*SCOPE).orderBy(F.desc("updated_at"), "item_id")
    slim = kept.select(*SCOPE, "item_id", "updated_at").withColumn("_n", F.row_number().over(scope)).where(F.col("_n") <= limit + offset).drop("_n")
    order = Window.partitionBy("query_id").orderBy(F.desc("updated_at"), "item_id")
    page = (
        scope_join(requests.select("query_id", *SCOPE), slim)
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= limit + offset)
        .where(F.col("position") > offset)
    )
    totals = count_visible(requests, kept).withColumnRenamed("n", "total")
    return page.join(totals, "query_id")


def project_item(items: DataFrame) -> DataFrame:
    """Transport shape: nested scope and ISO timestamps."""
    return items.select(
        F.col("item_id").alias("id"),
        F.struct(F.col("tenant"), F.col("user_id").alias("user"), F.col("project")).alias("scope"),
        "type", "content", "source", "confidence",
        render.iso(F.col("created_at")).alias("created_at"),
        render.iso(F.col("updated_at")).alias("updated_at"),
        "superseded_by", "conversation_id",
    )


def project_entity(entities: DataFrame) -> DataFrame:
    return entities.select(
        F.col("entity_id").alias("id"),
        F.struct(F.col("tenant"), F.col("user_id").alias("user"), F.col("project")).alias("scope"),
        "name", "kind",
    )


def project_relation(relations: DataFrame) -> DataFrame:
    return relations.select(
        F.col("rel_id").alias("id"), "from_entity", "to_entity", "type",
        F.col("weight").cast("double").alias("weight"), "evidence_item",
    )


def exact_dedupe(items: DataFrame, order: str = "created_at") -> DataFrame:
    """First row per (scope, content_hash): a min per key, so copies combine before the shuffle."""
    first = items.groupBy(*SCOPE, "content_hash").agg(F.min(F.struct(order, "item_id")).alias("_f"))
    keep = first.select(F.col("_f.item_id").alias("item_id"))
    return items.join(keep, "item_id", "left_semi")


def tally_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def tally_wide(df: DataFrame, by: list[str], column: str = "type") -> DataFrame:
    return df.groupBy(*by).pivot(column, MEMORY_TYPES).agg(F.count(F.lit(1))).fillna(0)


def numbered(df: DataFrame, key: str, order: str, out: str = "position", bits: int = 16) -> DataFrame:
    """Row numbers per key in order of a unique long column, without sorting a whole key in one task.

    Each window covers one range of 2^bits order values; counts of the earlier ranges are added.
    """
    ranged = df.withColumn("_range", F.shiftright(F.col(order), bits))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy(order))
    return ranged.withColumn("_inside", inside).join(offsets, [key, "_range"]).withColumn(
        out, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def with_scope_key(df: DataFrame) -> DataFrame:
    return df.withColumn("scope_key", scope_key(*[F.col(c) for c in SCOPE]))
