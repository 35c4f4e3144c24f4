"""Entities, co-occurrence edges and bounded undirected expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.ids import entity_id, relation_id
from memloom.functions.render import js_trim
from memloom.functions.scope import scope_key
from memloom.functions.scoring import hop_score
from memloom.functions.text import normalize_text
from memloom.operators.items import live_filter, scope_join
from memloom.operators.knn import topk_per_query
from memloom.schemas import SCOPE
from memloom.session import BROADCAST_BYTES, cut_lineage

# Bounds of linking and expansion.
MAX_SEEDS = 8
MAX_DEPTH = 3
MAX_NODES = 200
EDGE_FIRST = 1.0
EDGE_STEP = 0.25
EDGE_CAP = 5.0

#: Places of an item's entity list in one block of pairs.
PAIR_BLOCK = 256
#: Characters of a name that have to be met as a whole before it is looked for.
_GRAM = 6
#: Rows that a step may reach without bounds, and neighbours of an entity that give those.
FEW_ROWS, FIRST_FEW = 1 << 22, 4
#: Room for a probe's ids, scope and gram.
PROBE_BYTES = 128


def named_entities(items: DataFrame, most: int | None = None) -> DataFrame:
    """One row per usable entity mention of items(item_id, seq, scope, entities array<struct<name,kind>>).

    All entities of an item count unless `most` keeps only its first ones.
    """
    given = F.col("entities") if most is None else F.slice("entities", 1, most)
    mentions = items.select(*SCOPE, "item_id", "seq", F.posexplode(given).alias("pos", "e"))
    named = mentions.select(
        *SCOPE, "item_id", "seq", "pos",
        js_trim(F.col("e.name")).alias("name"),
        F.coalesce(F.col("e.kind"), F.lit("concept")).alias("kind"),
    ).withColumn("name_norm", normalize_text(F.col("name")))
    key = scope_key(*[F.col(c) for c in SCOPE])
    return named.where(F.col("name_norm") != "").withColumn("entity_id", entity_id(key, F.col("name_norm")))


def entity_merge(mentions: DataFrame) -> DataFrame:
    """First spelling wins; the kind is the first one more specific than concept."""
    order = F.struct("seq", "pos")
    specific = F.min(F.when(F.col("kind") != "concept", F.struct("seq", "pos", "kind")))
    return mentions.groupBy(*SCOPE, "entity_id", "name_norm").agg(
        F.min_by("name", order).alias("name"),
        F.coalesce(specific["kind"], F.lit("concept")).alias("kind"),
    )


def item_links(mentions: DataFrame) -> DataFrame:
    return mentions.select("item_id", "entity_id").distinct()


def dedupe_links(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Links not stored yet."""
    return new.dropDuplicates(["item_id", "entity_id"]).join(stored, ["item_id", "entity_id"], "left_anti")


def cooccurrence_pairs(mentions: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """Ordered pairs of an item's distinct entities, as many as its own list gives.

    An item's entities are cut into blocks of `block` places. Pairs inside a block come from its row; items of
    several blocks also join each block with the later ones, so no row is wider than a block.
    """
    firsts = mentions.groupBy("item_id", "seq", "entity_id").agg(F.min("pos").alias("pos"))
    blocks = firsts.groupBy("item_id", "seq", F.floor(F.col("pos") / block).alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity_id"))), lambda e: e["entity_id"]).alias("ids")
    )
    inside = blocks.where(F.size("ids") > 1).select("item_id", "seq", F.posexplode("ids").alias("i", "from_entity"), "ids").select(
        "item_id", "seq", "from_entity", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("to_entity"))
    later = blocks.where(F.col("block") > 0).select("item_id", "seq", F.col("block").alias("other"), F.col("ids").alias("others"))
    across = blocks.join(later, ["item_id", "seq"]).where(F.col("block") < F.col("other")).select(
        "item_id", "seq", F.explode("ids").alias("from_entity"), "others").select(
        "item_id", "seq", "from_entity", F.explode("others").alias("to_entity"))
    return inside.unionByName(across)


def edge_weight(pairs: DataFrame, type_: str = "RELATES_TO") -> DataFrame:
    """Fold repeats of a pair: weight grows to a cap, the latest evidence wins."""
    seen = pairs.groupBy("from_entity", "to_entity").agg(
        F.count("*").alias("seen"),
        F.max_by("item_id", F.struct("seq", "item_id")).alias("evidence_item"),
    )
    weight = F.least(F.lit(EDGE_FIRST) + F.lit(EDGE_STEP) * (F.col("seen") - 1), F.lit(EDGE_CAP))
    return seen.select(
        relation_id(F.col("from_entity"), F.col("to_entity"), F.lit(type_)).alias("rel_id"),
        "from_entity", "to_entity", F.lit(type_).alias("type"),
        weight.cast("double").alias("weight"), "evidence_item", "seen",
    )


def merge_edges(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored relations plus a batch of weighted ones, each repeat adding a step."""
    both = (
        stored.select("rel_id", "from_entity", "to_entity", "type", "weight", "evidence_item")
        .withColumns({"base": F.col("weight"), "seen": F.lit(0).cast("long")})
        .unionByName(
            batch.select("rel_id", "from_entity", "to_entity", "type", "weight", "evidence_item", "seen")
            .withColumn("base", F.lit(None).cast("double"))
        )
    )
    folded = both.groupBy("rel_id", "from_entity", "to_entity", "type").agg(
        F.max("base").alias("base"),
        F.sum("seen").alias("seen"),
        F.max_by("evidence_item", F.when(F.col("evidence_item").isNotNull(), F.col("seen"))).alias("evidence_item"),
    )
    fresh = F.lit(EDGE_FIRST) + F.lit(EDGE_STEP) * (F.col("seen") - 1)
    grown = F.coalesce(F.col("base") + F.lit(EDGE_STEP) * F.col("seen"), fresh)
    return folded.select(
        "rel_id", "from_entity", "to_entity", "type",
        F.least(grown, F.greatest(F.lit(EDGE_CAP), F.col("base"))).alias("weight"), "evidence_item",
    )


def dedupe_edges(relations: DataFrame) -> DataFrame:
    return relations.dropDuplicates(["rel_id"])


def find_entity(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """requests(query_id, scope, name) to the entity of that normalised name."""
    wanted = requests.withColumn("name_norm", normalize_text(F.col("name"))).drop("name")
    found = scope_join(wanted, entities, on=("name_norm",))
    return topk_per_query(found, 1, ("entity_id",)).drop("rank")


def link_entities(queries: DataFrame, entities: DataFrame, limit: int = MAX_SEEDS) -> DataFrame:
    """Entities whose name lies inside the normalised query, longest first.

    A contained name shares its first six characters with some window of the query, so the
    join is on scope and that gram; containment is checked after it. Shorter names join on
    their whole text against the query's windows of the same length.
    """
    normal = queries.withColumn("q", normalize_text(F.col("query"))).where(F.col("q") != "")
    windows = lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("q") - (n - 1))),
        lambda i: F.substring(F.col("q"), i, F.lit(n)),
    )
    grams = F.array_distinct(F.flatten(F.array(*[windows(n) for n in range(1, _GRAM + 1)])))
    # A text gives six probes a letter, which the planner does not foresee: they are counted before one is broadcast,
    # and meet their text again only where a gram was found.
    letters = normal.agg(F.sum(F.length("q"))).first()[0] or 0
    probes = normal.select("query_id", *SCOPE, F.explode(grams).alias("gram"))
    probes = F.broadcast(probes) if letters * _GRAM * PROBE_BYTES <= BROADCAST_BYTES else probes.hint("merge")
    named = entities.select(*SCOPE, "entity_id", "name", "name_norm", F.substring("name_norm", 1, _GRAM).alias("gram"))
    hits = scope_join(probes, named, on=("gram",)).join(normal.select("query_id", "q"), "query_id").where(F.position(F.col("name_norm"), F.col("q")) > 0)
    found = hits.select("query_id", *SCOPE, "entity_id", "name", F.length("name_norm").alias("len"))
    return topk_per_query(found, limit, ("-len", "name", "entity_id"))


def both_ways(relations: DataFrame) -> DataFrame:
    """Edges seen from either end, so expansion is an equi-join."""
    forward = relations.select(F.col("from_entity").alias("entity_id"), F.col("to_entity").alias("other"))
    backward = relations.select(F.col("to_entity").alias("entity_id"), F.col("from_entity").alias("other"))
    return forward.unionByName(backward)


def linked_neighbours(links: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, other): entities that share an item with one of the given ones.

    These are the ends of the co-occurrence edges of the same links, without the pairs of entities that nobody asks for.
    """
    near = links.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")
    others = links.select("item_id", F.col("entity_id").alias("other"))
    return near.join(others, "item_id").where(F.col("entity_id") != F.col("other")).select("entity_id", "other")


def adjacency(relations: DataFrame | None, entities: DataFrame, most: int | None = None, links: DataFrame | None = None) -> DataFrame:
    """(entity_id, other) of the given entities: all their neighbours, or the `most` with the lowest ids.

    Without stored relations the neighbours are those that the links give.
    """
    if relations is None:
        near = linked_neighbours(links, entities).distinct()
    else:
        near = both_ways(relations).join(entities.select("entity_id").distinct(), "entity_id", "left_semi").distinct()
    if most is None:
        return near
    lowest = Window.partitionBy("entity_id").orderBy("other")
    return near.withColumn("_n", F.row_number().over(lowest)).where(F.col("_n") <= most).drop("_n")


def _neighbours(frontier: DataFrame, relations: DataFrame | None, most: int | None = None, links: DataFrame | None = None) -> DataFrame:
    reached = frontier.select("query_id", "entity_id").join(adjacency(relations, frontier, most, links), "entity_id")
    return reached.select("query_id", F.col("other").alias("entity_id"))


def expand_frontier(frontier: DataFrame, relations: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct neighbours of each query's frontier(query_id, entity_id), at most `most` of one entity where it is given."""
    return _neighbours(frontier, relations, most).distinct()


def neighbour_lists(relations: DataFrame | None, entities: DataFrame, most: int | None = None, links: DataFrame | None = None) -> DataFrame:
    """(entity_id, others): the same as adjacency, in one sorted list of each entity."""
    near = adjacency(relations, entities, most, links)
    return near.groupBy("entity_id").agg(F.array_sort(F.collect_list("other")).alias("others"))


def unseen_neighbours(frontier: DataFrame, relations: DataFrame | None, visited: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Distinct neighbours of each query's frontier that it has not visited.

    A query meets its neighbours and what it has visited as lists, which are much smaller than rows, and only then row by row.
    """
    lists = frontier.select("query_id", "entity_id").join(neighbour_lists(relations, frontier, links=links), "entity_id")
    seen = visited.groupBy("query_id").agg(F.collect_set("entity_id").alias("seen"))
    met = lists.select("query_id", "others").hint("merge").join(seen, "query_id", "left")
    fresh = F.when(F.col("seen").isNull(), F.col("others")).otherwise(F.array_except("others", "seen"))
    return met.select("query_id", F.explode(fresh).alias("entity_id")).distinct()


def expand_unseen(neighbours: DataFrame, visited: DataFrame) -> DataFrame:
    return neighbours.join(visited.select("query_id", "entity_id"), ["query_id", "entity_id"], "left_anti")


def graph_expand(
    seeds: DataFrame, relations: DataFrame | None, depth: int = 1, max_nodes: int = MAX_NODES, links: DataFrame | None = None
) -> DataFrame:
    """(query_id, entity_id, hop, truncated) by undirected breadth-first steps over relations, or over links where those are None.

    Each round is one union and min-hop aggregate (which also drops entities already seen),
    then a per-query cap in order of hop and id, so a hub cannot feed the next round more
    than max_nodes entities. An entity hands each query at most its 2 * max_nodes + 1 lowest
    neighbours: of those no more than max_nodes were seen before, so the cap and the mark of a cut are
    exact. Where the frontier is large, its entities first hand out their lowest few, and then only what lies within the
    bound that those give. A round's state, at most max_nodes rows a query, is written once.
    """
    best = Window.partitionBy("query_id").orderBy("hop", "entity_id")
    whole = Window.partitionBy("query_id")
    state = cut_lineage(seeds.groupBy("query_id", "entity_id").agg(F.lit(0).alias("hop")).withColumn("over", F.lit(False)), "expanded")
    for hop in range(1, min(max(depth, 0), MAX_DEPTH) + 1):
        # A query that is already cut keeps its nodes: further steps could not add any.
        frontier = state.where((F.col("hop") == hop - 1) & ~F.col("over"))

        def ranked_with(reached: DataFrame) -> DataFrame:
            new = reached.select("query_id", "entity_id", F.lit(hop).alias("hop"), F.lit(False).alias("over"))
            merged = state.unionByName(new).groupBy("query_id", "entity_id").agg(F.min("hop").alias("hop"), F.max("over").alias("over"))
            # One row past the cap is enough to know that something was cut.
            return merged.withColumn("n", F.row_number().over(best)).where(F.col("n") <= max_nodes + 1)

        if frontier.count() * max_nodes <= FEW_ROWS:
            ranked = ranked_with(_neighbours(frontier, relations, 2 * max_nodes + 1, links))
        else:
            # The lowest few neighbours of each entity bound the ids that can lie within a query's cap.
            lists = cut_lineage(neighbour_lists(relations, frontier, 2 * max_nodes + 1, links), "lists")
            few = frontier.join(lists, "entity_id").select("query_id", F.explode(F.slice("others", 1, FIRST_FEW)).alias("entity_id"))
            bounds = ranked_with(few).where(F.col("n") == max_nodes + 1).select("query_id", F.when(F.col("hop") == hop, F.col("entity_id")).alias("bound"))
            within = F.filter("others", lambda x: F.col("bound").isNull() | (x <= F.col("bound")))
            bounded = frontier.join(bounds, "query_id", "left").join(lists, "entity_id")
            ranked = ranked_with(bounded.select("query_id", F.explode(within).alias("entity_id")))
        flagged = ranked.withColumn("over", F.max(F.col("over") | (F.col("n") > max_nodes)).over(whole))
        state = cut_lineage(flagged.where(F.col("n") <= max_nodes).select("query_id", "entity_id", "hop", "over"), "expanded")
    return state.withColumnRenamed("over", "truncated")


def scope_recheck(reached: DataFrame, queries: DataFrame, entities: DataFrame) -> DataFrame:
    """Keep reached entities that lie in the query's own scope: edges carry no scope."""
    placed = reached.join(queries.select("query_id", *SCOPE), "query_id")
    owned = scope_join(placed, entities.select(*SCOPE, "entity_id"), on=("entity_id",))
    return owned.select(*reached.columns)


def coded(df: DataFrame, column: str, code: str) -> DataFrame:
    """(column, code): the distinct values of a column with a number each, written once."""
    return cut_lineage(df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(code, F.monotonically_increasing_id()), code)


def edge_hits(reached: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits(q, rel), queries(query_id, q), edges(rel, columns of a relation)): relations whose two ends a query reached.

    A query meets every edge that starts at one of its entities, so these rows are numbers, without the edges' columns.
    """
    entities, asked = coded(reached, "entity_id", "e"), coded(reached, "query_id", "q")
    ends = cut_lineage(reached.select("query_id", "entity_id").join(entities, "entity_id").join(asked, "query_id").select("q", "e").distinct(), "ends")
    edges = dedupe_edges(relations)
    for end, code in (("from_entity", "f"), ("to_entity", "t")):
        edges = edges.join(entities.select(F.col("entity_id").alias(end), F.col("e").alias(code)), end)
    edges = cut_lineage(edges.withColumn("rel", F.monotonically_increasing_id()), "edges")
    starts = edges.select("rel", "t", F.col("f").alias("e")).join(ends, "e").select("q", "rel", F.col("t").alias("e"))
    return starts.join(ends, ["q", "e"], "left_semi").select("q", "rel"), asked, edges.drop("f", "t")


def edges_within(reached: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations whose two ends were both reached by the query, each once."""
    hits, asked, edges = edge_hits(reached, relations)
    return hits.join(edges, "rel").join(asked, "q").drop("rel", "q")


def items_for_entities(reached: DataFrame, queries: DataFrame, links: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """Live items attached to each query's entities, newest first, cut at limit links.

    A query takes at most `limit` links of one entity, so only each entity's newest ones are
    joined to the queries: an entity that half of all items mention stays cheap.
    """
    slim = live_filter(items).select(*SCOPE, "item_id", "updated_at")
    wanted = reached.select("entity_id").distinct()
    held = links.join(wanted, "entity_id", "left_semi").join(slim, "item_id")
    newest = Window.partitionBy("entity_id", *SCOPE).orderBy(F.desc("updated_at"), "item_id")
    top = held.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit).drop("_n")
    asked = reached.join(queries.select("query_id", *SCOPE), "query_id")
    seen = scope_join(asked, top, on=("entity_id",))
    return topk_per_query(seen, limit, ("-updated_at", "item_id", "entity_id"))


def entities_for_items(links: DataFrame, entities: DataFrame) -> DataFrame:
    """item_id to its sorted entity names."""
    named = links.join(entities.select("entity_id", "name"), "entity_id")
    return named.groupBy("item_id").agg(F.array_sort(F.collect_list("name")).alias("names"))


def graph_best_score(pairs: DataFrame) -> DataFrame:
    """Nearest entity decides: the best 1/(1+hop) over an item's links."""
    return pairs.groupBy("query_id", "item_id").agg(F.max(hop_score(F.col("hop"))).alias("score"))


def graph_branch(queries: DataFrame, items: DataFrame, entities: DataFrame, relations: DataFrame | None, links: DataFrame, k: int, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Ranked hits and one status row per query (seeds found, truncated)."""
    seeds = link_entities(queries, entities)
    reached = graph_expand(seeds, relations, depth, links=links)
    status = (
        queries.select("query_id")
        .join(reached.groupBy("query_id").agg(F.max("truncated").alias("truncated")), "query_id", "left")
        .select("query_id", F.col("truncated").isNotNull().alias("linked"),
                F.coalesce("truncated", F.lit(False)).alias("truncated"))
    )
    owned = scope_recheck(reached, queries, entities)
    pairs = items_for_entities(owned, queries, links, items, k * 3)
    hits = topk_per_query(graph_best_score(pairs), k)
    return hits.select("query_id", "item_id", "score", "rank"), status


def distinct_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one request of each scope and name, members(query_id, same) of all): the same question has one answer."""
    key = [*SCOPE, "name"]
    asked = cut_lineage(requests.groupBy(*key).agg(F.min("query_id").alias("query_id")), "asked")
    same = asked.select(F.col("query_id").alias("same"), *[F.col(c).alias("_" + c) for c in key])
    met = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col("_" + c)) for c in key])
    return asked, requests.select("query_id", *key).join(same, met).select("query_id", "same")


def graph_explore(requests: DataFrame, items: DataFrame, entities: DataFrame, relations: DataFrame, links: DataFrame, depth: int = 1, limit: int = 100) -> dict[str, DataFrame]:
    """Root, entities, relations and attached items for requests(query_id, scope, name).

    `hits` counts the relations of each query and `lines`(query_id, a, type, b) names their ends, without the other columns.
    """
    root = find_entity(requests, entities)
    reached = cut_lineage(scope_recheck(graph_expand(root, relations, depth), requests, entities), "reached")
    attached = items_for_entities(reached, requests, links, items, limit)
    hits, asked, edges = edge_hits(reached, relations)
    named = edges.select("rel", "type", "from_entity", "to_entity")
    for end, name in (("from_entity", "a"), ("to_entity", "b")):
        named = named.join(entities.select(F.col("entity_id").alias(end), F.col("name").alias(name)), end)
    return {
        "root": root,
        "entities": reached.join(entities.select("entity_id", "name", "kind"), "entity_id"),
        "relations": hits.join(edges, "rel").join(asked, "q").drop("rel", "q"),
        "hits": hits.groupBy("q").agg(F.count("*").alias("relations")).join(asked, "q").drop("q"),
        "lines": hits.join(named.select("rel", "a", "type", "b"), "rel").join(asked, "q").drop("rel", "q"),
        "items": attached.select("query_id", "item_id").distinct(),
    }


def dedupe_by_query(relations: DataFrame) -> DataFrame:
    return relations.dropDuplicates(["query_id", "rel_id"])
