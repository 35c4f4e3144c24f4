"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key over its quality weight; smaller keys come first. A source takes
whole epochs while its target allows, then a prefix of its documents in key order whose words fill the
rest. The prefix is found from totals of key buckets and an exact running sum inside the one bucket in
which the budget ends, so a source with a third of all rows needs no sort of its own; rows then compare
themselves with their source's cut. Buckets are even on the scale of the key's logarithm, where no quality
crowds them. Everything follows from hashes of doc_id and text, so reruns agree. Rows alike in both share a key;
where the budget ends among them, as many as it holds are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.columns import set_aside
from memloom.llm.flat import LETTERS, NON_SPACE, flatten, pieces, word_bounds
from memloom.session import broadcast_if_small, cut_lineage

#: Buckets of sampling keys per doubling: a bucket holds at most a thousandth of its source's rows, ties apart.
BUCKETS = 256
#: Rows of one key that are numbered together.
TIED_ROWS = 1 << 16
MOST_EPOCHS = 3
WEIGHTS = [1, 2, 3]


def with_sizes(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with _size (words between white space; null text: 0), _quality and _mark, a hash of the text.

    Quality is 0.1 plus 0.9 of the share of letters among the bytes that are no white space.
    """
    kept = (docs.select(*keep) if "text" in keep else docs.select(*keep, "text")).withColumn("_mark", F.xxhash64("text"))
    out_schema = kept.select(*keep, "_mark").schema.add("_size", "long").add("_quality", "double")
    at = [kept.columns.index(c) for c in (*keep, "_mark")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                data, offsets = flatten(piece.column(piece.schema.get_field_index("text")))
                _, _, words = word_bounds(data, offsets, NON_SPACE)
                letters, solid = (np.diff(np.concatenate(([0], np.cumsum(t[data])))[offsets]) for t in (LETTERS, NON_SPACE))
                quality = np.where(solid > 0, 0.1 + 0.9 * letters / np.maximum(solid, 1), 1.0)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(i) for i in at), pa.array(words, pa.int64()), pa.array(quality, pa.float64())],
                    [*keep, "_mark", "_size", "_quality"])

    return kept.mapInArrow(run, out_schema)


def _source(column: str) -> Column:
    """A source as a key that is never null and sorts null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(column)), F.lit("1"))


def with_keys(sized: DataFrame, source: str = "source", seed: int = 0) -> DataFrame:
    """Adds _source, the sampling order `_order` and the bucket of its key."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "_mark"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    key = F.greatest(-F.log(u) / F.col("_quality"), F.lit(1e-300))
    return sized.withColumns({"_source": _source(source), "_key": key}).withColumns({
        "_bucket": F.floor(F.log2("_key") * BUCKETS).cast("int"),
        "_order": F.struct("_key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col("_size").alias("size"),
                           F.col("_mark").alias("mark"))}).drop("_key", "_mark")


def targets(sources: DataFrame) -> DataFrame:
    """(_source, source_size) with target: weights 1, 2, 3 in source order share all words.

    The level is the one at which the targets, each at most MOST_EPOCHS times its source's size, come to
    the total; it is what resharing the excess by weight until none is above leads to. One row per source.
    """
    names = Window.orderBy("_source")
    weighed = sources.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(names) - 1) % len(WEIGHTS) + 1))
    weighed = weighed.withColumn("_most", F.col("source_size") * float(MOST_EPOCHS)).withColumn("_at", F.col("_most") / F.col("_w"))
    rising = Window.orderBy("_at", "_source")
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    stepped = weighed.withColumn("_level", level)
    fits = F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", "_source", "_level"))).over(whole)
    chosen = stepped.withColumn("_level", fits["_level"])
    return chosen.select("_source", "source_size", F.least(F.col("_most"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_most"))).alias("target"))


def mixing_plan(keyed: DataFrame) -> DataFrame:
    """One row per source: source_size, target, epochs, and `cut`, the last order that the fraction takes.

    Of `tied` rows of that order it takes `some`.
    """
    buckets = cut_lineage(keyed.groupBy("_source", "_bucket").agg(F.sum("_size").alias("n")), "mix-buckets")
    sources = targets(buckets.groupBy("_source").agg(F.sum("n").alias("source_size")))
    size, target = F.col("source_size"), F.col("target")
    epochs = F.when(size > 0, F.least(F.floor(target / size), F.lit(MOST_EPOCHS))).otherwise(0).cast("long")
    sources = sources.withColumn("epochs", epochs).withColumn(
        "rest", F.when(F.col("epochs") < MOST_EPOCHS, target - F.col("epochs") * size).otherwise(0.0))
    upto = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begun = buckets.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(sources, "_source")
    # The last bucket that begins within the budget holds the cut.
    last = begun.where(F.col("before") < F.col("rest")).groupBy("_source").agg(
        F.max(F.struct("_bucket", "before", "rest")).alias("b")).select("_source", "b.*")
    inside = keyed.select("_source", "_bucket", "_order", "_size").join(last, ["_source", "_bucket"])
    alike = inside.groupBy("_source", "_order").agg(
        F.count("*").alias("tied"), F.first("_size").alias("_size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    run = Window.partitionBy("_source").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("_begins", F.col("before") + F.coalesce(F.sum(F.col("_size") * F.col("tied")).over(run), F.lit(0)))
    begins = F.col("_begins")
    some = F.when(F.col("_size") == 0, F.col("tied")).otherwise(
        F.least(F.col("tied"), F.floor((F.col("rest") - begins) / F.col("_size") + 0.5).cast("long")))
    cuts = alike.withColumn("some", some).where((F.col("some") > 0) & (begins + F.col("_size") / 2 <= F.col("rest"))).groupBy("_source").agg(
        F.max(F.struct("_order", "tied", "some")).alias("c")).select("_source", F.col("c._order").alias("cut"), "c.tied", "c.some")
    return cut_lineage(sources.drop("rest").join(last.select("_source", F.col("_bucket").alias("cut_bucket")), "_source", "left")
                       .join(cuts, "_source", "left"), "mix-plan")


def _numbered(ties: DataFrame) -> DataFrame:
    """Adds _n, the number of a row in its source, in order of _place; no window holds more than TIED_ROWS places."""
    ranged = ties.withColumn("_range", F.floor(F.col("_place") / TIED_ROWS))
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("_source", "_range").agg(F.count("*").alias("_held"))
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0))).drop("_held")
    inside = F.row_number().over(Window.partitionBy("_source", "_range").orderBy("_place"))
    return ranged.withColumn("_n", inside).join(ranges, ["_source", "_range"]).withColumn(
        "_n", F.col("_n") + F.col("_before")).drop("_range", "_before", "_place")


def with_copies(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and copies: the times that the mix takes the row, 0 to MOST_EPOCHS."""
    rows = plan.count()
    joined = keyed.join(broadcast_if_small(plan, rows, 256), "_source")
    split = F.coalesce((F.col("_order") == F.col("cut")) & (F.col("some") < F.col("tied")), F.lit(False))
    taken = F.when(F.col("_bucket") < F.col("cut_bucket"), 1).when(F.col("_order") <= F.col("cut"), 1).otherwise(0)
    copies = lambda more: (F.col("epochs") + more).cast("long")
    if plan.where("some < tied").isEmpty():
        return joined.withColumn("copies", copies(taken)).drop("tied", "some")
    # Rows that cannot be told apart: written once with a place of their own, then numbered.
    ties = cut_lineage(joined.where(split).withColumn("_place", F.monotonically_increasing_id()), "mix-ties")
    return joined.where(~split).withColumn("copies", copies(taken)).drop("tied", "some").unionByName(
        _numbered(ties).withColumn("copies", copies(F.when(F.col("_n") <= F.col("some"), 1).otherwise(0))).drop("tied", "some", "_n"))


def mix(docs: DataFrame, source: str = "source", seed: int = 0) -> DataFrame:
    """Each row of `docs` as often as the mix takes it; all columns stay.

    A source without words takes nothing, and a row of no words goes with its place in the order. Of rows
    alike in doc_id and text any may be the ones taken. An empty table stays empty.
    """
    docs, names = set_aside(docs, ["doc_id", "text", source])
    plan = mixing_plan(cut_lineage(with_keys(with_sizes(docs, ["doc_id", source]), source, seed), "mix-sizes"))
    keyed = with_keys(with_sizes(docs, docs.columns), source, seed)
    chosen = with_copies(keyed, plan).where(F.col("copies") > 0)
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")
    return chosen.select(*docs.columns, again).drop("_copy").toDF(*names)


def mix_report(docs: DataFrame, source: str = "source", seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken: words that the mix takes of each row, repeats counted."""
    keyed = cut_lineage(with_keys(with_sizes(docs, ["doc_id", source]), source, seed), "mix-sizes")
    return with_copies(keyed, mixing_plan(keyed)).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"))
