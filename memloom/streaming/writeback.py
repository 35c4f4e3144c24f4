"""The write-back queue as a stream: each micro-batch is extracted, reconciled and stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memloom.operators.conversations import recent_tail
from memloom.operators.items import confidence_floor
from memloom.operators.partitions import Change, PartStore
from memloom.operators.reconcile import ReconcileConfig
from memloom.plans import writeback as wb
from memloom.plans.ingest import write_changes
from memloom.schemas import SCOPE
from memloom.session import cut_lineage
from memloom.sources.tables import read_turns

# Tries per job and jobs (files) per drain.
MAX_ATTEMPTS = 3
DRAIN = 5

JOB = (
    "job_id string, conversation_id string, tenant string, user_id string, project string, status string, "
    "attempts int, payload string, error string, created_at timestamp, updated_at timestamp"
)


STATS = "batch long, processed long, stored long, duplicates long, rejected long, failed long"
#: Versions of the store that stay: the newest can be played again, and readers of the last few are left alone.
VERSIONS_KEPT = 10


def current(spark: SparkSession, root: str, name: str = "items", parts: int = 256, spread: int = 16) -> DataFrame:
    """The newest version of a table, or an empty one before the first."""
    return PartStore(spark, root, parts, spread).read(name)


def drain(
    jobs: DataFrame, store: PartStore, now: Column, extractor: wb.Extractor, config: ReconcileConfig, floor: float, number: int
) -> tuple[DataFrame, dict[str, Change], DataFrame]:
    """(outcomes, changes, finished jobs): extraction, floor and the whole write path of a batch of jobs."""
    scoped = jobs.select("job_id", "conversation_id", *SCOPE, "created_at")
    said = read_turns(jobs.withColumn("conversation_id", F.col("job_id"))).select(
        "conversation_id", "turn", "role", F.col("content").alias("text"))
    raw = cut_lineage(wb.extract(recent_tail(said), extractor).select(F.col("conversation_id").alias("job_id"), "raw"))
    facts, errors = wb.parse_facts(raw)
    kept = confidence_floor(facts, floor).where(F.col("reason").isNull()).drop("reason")
    placed = kept.join(scoped, "job_id").orderBy("created_at", "job_id", "fact_pos")
    writes = cut_lineage(placed.select(
        F.monotonically_increasing_id().alias("seq"), "job_id", *SCOPE, "type", "content",
        F.concat(F.lit("conversation:"), "conversation_id").alias("source"), "confidence", "conversation_id", "entities",
    ))
    outcomes, changes = write_changes(writes.drop("job_id"), store, now, config, number)
    told = outcomes.select("seq", "item_id", "outcome", "reason").join(writes.select("seq", "job_id"), "seq")
    failed = errors.select("job_id", F.col("error").alias("new_error"))
    done = jobs.join(failed, "job_id", "left").withColumns({
        "attempts": F.col("attempts") + 1,
        "status": F.when(F.col("new_error").isNull(), "done").when(F.col("attempts") + 1 >= MAX_ATTEMPTS, "failed").otherwise("pending"),
        "error": F.col("new_error"), "updated_at": now,
    }).drop("new_error")
    return told, changes, done


def _count(*names: str) -> Column:
    return F.count_if(F.col("outcome").isin(*names))


def write_batch(told: DataFrame, done: DataFrame, root: str, jobs_path: str, batch_id: int) -> dict[str, int]:
    """Store what a drain did, each in a folder of its own number; the counts are observed while the rows are written."""
    outcomes, jobs = Observation(), Observation()
    told.observe(
        outcomes, _count("inserted", "superseded").alias("stored"), _count("duplicate", "updated").alias("duplicates"),
        _count("rejected").alias("rejected"),
    ).write.mode("overwrite").parquet(f"{root}/outcomes/batch={batch_id}")
    done.observe(
        jobs, F.count("*").alias("processed"), F.count("error").alias("failed"),
        F.count_if(F.col("status") == "pending").alias("again"),
    ).where(F.col("status") != "pending").write.mode("overwrite").parquet(f"{root}/jobs/batch={batch_id}")
    counts = {**outcomes.get, **jobs.get}
    if counts.pop("again"):
        done.where(F.col("status") == "pending").write.mode("overwrite").parquet(f"{jobs_path}/again-{batch_id}")
    return counts


def stream_writeback(
    spark: SparkSession, jobs_path: str, root: str, checkpoint: str,
    extractor: wb.Extractor = wb.sentence_extractor, now: Column | None = None,
    config: ReconcileConfig = ReconcileConfig(), floor: float = wb.MIN_CONFIDENCE,
    parts: int = 256, spread: int = 16, keep: int = VERSIONS_KEPT,
) -> StreamingQuery:
    """Drain pending jobs into the partitioned store below root; the checkpoint replaces row locks.

    A job whose answer cannot be read is appended to the queue again, and after the last try to
    root/jobs with status failed. A micro-batch writes only the partitions that hold rows it changes. All
    that it writes lies in folders that carry its number and replaces only itself, and it starts from the
    version before that number: a batch that is played again after a crash, wherever it stopped, leaves the
    same tables. Versions before the newest `keep` are dropped. Each batch leaves one row of root/stats; the
    stream itself observes `queue` (jobs read, jobs pending), which listeners see in its progress.
    """
    at = F.current_timestamp() if now is None else now
    queued = spark.readStream.schema(JOB).option("recursiveFileLookup", True).option("maxFilesPerTrigger", DRAIN).parquet(jobs_path)
    seen = queued.observe("queue", F.count("*").alias("jobs"), F.count_if(F.col("status") == "pending").alias("pending"))

    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        jobs = cut_lineage(batch.where(F.col("status") == "pending"))
        store = PartStore(session, root, parts, spread)
        told, changes, done = drain(jobs, store, at, extractor, config, floor, batch_id)
        counts = write_batch(told, cut_lineage(done), root, jobs_path, batch_id)
        row = [(batch_id, *(counts[c] for c in ("processed", "stored", "duplicates", "rejected", "failed")))]
        session.createDataFrame(row, STATS).coalesce(1).write.mode("overwrite").parquet(f"{root}/stats/of={batch_id}")
        store.commit(changes, batch_id)
        store.retain(keep)

    return seen.writeStream.option("checkpointLocation", checkpoint).foreachBatch(process).trigger(availableNow=True).start()


def drain_stats(spark: SparkSession, root: str) -> DataFrame:
    """One row per micro-batch: jobs processed and failed, facts stored, repeated and rejected."""
    return spark.read.schema(STATS).parquet(f"{root}/stats/*")
