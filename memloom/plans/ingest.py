"""Repository ingest, write-back and configuration comparison as whole plans."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators import evaluation as ev
from memloom.operators import graph
from memloom.operators.partitions import Change, PartStore
from memloom.operators.reconcile import ReconcileConfig, reconcile, reconcile_changes
from memloom.plans import search as plans
from memloom.schemas import SCOPE
from memloom.session import cut_lineage


def write_items(
    writes: DataFrame, tables: dict[str, DataFrame], now: Column, config: ReconcileConfig = ReconcileConfig()
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Reconcile writes(.., entities) into the item table, then extend entities, links and edges."""
    outcomes, items = reconcile(writes.drop("entities"), tables["items"], now, config)
    outcomes = cut_lineage(outcomes)
    out = {**tables, "items": items}
    if "entities" not in writes.columns:
        return outcomes, out
    stored = outcomes.where(F.col("outcome") != "rejected").select("seq", "item_id")
    mentions = cut_lineage(graph.named_entities(writes.select("seq", *SCOPE, "entities").join(stored, "seq")))
    known = tables["entities"].select(
        *SCOPE, "entity_id", "name_norm", "name", "kind", F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("pos"))
    every = known.unionByName(mentions.select(*known.columns))
    out["entities"] = graph.entity_merge(every)
    out["links"] = tables["links"].unionByName(graph.dedupe_links(graph.item_links(mentions), tables["links"]))
    out["relations"] = graph.merge_edges(tables["relations"], graph.edge_weight(graph.cooccurrence_pairs(mentions)))
    return outcomes, out


def write_changes(
    writes: DataFrame, store: PartStore, now: Column, config: ReconcileConfig = ReconcileConfig(), number: int | None = None
) -> tuple[DataFrame, dict[str, Change]]:
    """As write_items, against the version of a partitioned store before `number`: outcomes and the rows that change.

    Only the partitions of the writes' tenants (items) and of the named entities, links and edges are read.
    """
    outcomes, items = reconcile_changes(writes.drop("entities"), store.read_tenants("items", writes, number), now, config)
    outcomes, changes = cut_lineage(outcomes), {"items": Change(items)}
    if "entities" not in writes.columns:
        return outcomes, changes
    stored = outcomes.where(F.col("outcome") != "rejected").select("seq", "item_id")
    mentions = cut_lineage(graph.named_entities(writes.select("seq", *SCOPE, "entities").join(stored, "seq")))
    known = store.read_keys("entities", mentions, number)
    earlier = known.select(*SCOPE, "entity_id", "name_norm", "name", "kind", F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("pos"))
    merged = graph.entity_merge(earlier.unionByName(mentions.select(*earlier.columns)))
    changes["entities"] = Change(merged.join(known, merged.columns, "left_anti"))
    links = graph.item_links(mentions)
    changes["links"] = Change(graph.dedupe_links(links, store.read_keys("links", links, number)))
    edges = cut_lineage(graph.edge_weight(graph.cooccurrence_pairs(mentions)))
    changes["relations"] = Change(graph.merge_edges(store.read_keys("relations", edges, number), edges))
    return outcomes, changes


def evaluate(
    queries: DataFrame, store: plans.Store, relevant: DataFrame, now: Column, config: plans.SearchConfig, label: str
) -> DataFrame:
    """Report row of one configuration. queries may carry latency_ms measured elsewhere."""
    final = plans.ranked_results(queries, store, config, now)["final"]
    retrieved = final.select("query_id", "item_id", F.col("position").alias("rank"))
    asked = queries if "latency_ms" in queries.columns else queries.withColumn("latency_ms", F.lit(0.0))
    metrics = ev.query_metrics(ev.judged(asked.select("query_id", "latency_ms"), relevant, retrieved))
    return ev.eval_report(metrics).withColumn("config", F.lit(label))


def compare(
    queries: DataFrame, store: plans.Store, relevant: DataFrame, now: Column, base: plans.SearchConfig = plans.SearchConfig()
) -> DataFrame:
    """The four standard configurations side by side, one row each."""
    rows = [evaluate(queries, store, relevant, now, config, label)
            for label, config in plans.compare_configs(replace(base)).items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
