"""Markdown trees and commit logs as candidate items."""

from __future__ import annotations

import re
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions.render import argues, js_trim, promote_decision, slug, strip_trailers
from memloom.sources import markdown

# Limits of a repository scan.
MIN_CHARS = 120
MAX_ITEMS = 500

# Directories that hold generated or vendored files.
SKIP_DIRS = [
    ".git", "node_modules", "dist", "build", "out", "target", "vendor",
    ".next", ".nuxt", ".venv", "venv", "__pycache__", "coverage", ".turbo",
    ".cache", "tmp", ".idea", ".vscode",
]
DOT_DIRS = [".claude", ".cursor", ".github"]

# Fixed patterns: which paths are worth reading, first match wins (pattern, type, kind).
PATH_RULES = [
    (r"(^|/)(docs?/)?(adrs?|decisions?|rfcs?)/", "decision", "adr"),
    (r"(^|/)(adr|rfc)[-_]?\d+.*\.mdx?$", "decision", "adr"),
    (r"(^|/)(contributing|conventions?|style[-_]?guide)\.mdx?$", "procedure", "conventions"),
    (r"(^|/)(claude|agents?|cursor)\.mdx?$", "preference", "agent-instructions"),
    (r"(^|/)\.(claude|cursor)/.*\.mdx?$", "preference", "agent-instructions"),
    (r"(^|/)(architecture|design|overview|rationale)\.mdx?$", "decision", "architecture"),
    (r"(^|/)docs?/.*\.mdx?$", "artifact", "docs"),
    (r"(^|/)readme[^/]*\.mdx?$", "artifact", "readme"),
]

_DOCS_CONFIDENCE = 0.9
_COMMIT_CONFIDENCE = 0.85


def keep_doc_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """files(path relative to the root, length, ...): authored markdown only."""
    parts = F.split("path", "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    skipped = F.exists(dirs, lambda d: F.lower(d).isin(SKIP_DIRS))
    hidden = F.exists(parts, lambda d: d.startswith(".") & ~F.lower(d).isin(DOT_DIRS))
    markdown = F.lower(F.col("path")).rlike(r"\.mdx?$")
    kept = files.where(markdown & ~skipped & ~hidden)
    return kept if max_bytes is None else kept.where(F.col("length") <= max_bytes)


def _dot_paths(spark: SparkSession, root: str, depth: int | None) -> list[str]:
    """The wanted dot-directories below root: Spark's own listing leaves out every hidden name."""
    fs_api = spark._jvm.org.apache.hadoop.fs

    def listed(*parts: str) -> list:
        path = fs_api.Path("/".join([root.rstrip("/"), *parts]))
        return [s for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or [] if s.isDirectory()]

    found, level = [], 0
    while depth is None or level < depth:
        found += [s.getPath().toString() for s in listed(*["*"] * level, "{" + ",".join(DOT_DIRS) + "}")]
        level += 1
        if not listed(*["*"] * level):
            break
    return found


def read_docs(spark: SparkSession, root: str, max_bytes: int | None = None, dot_depth: int | None = None) -> DataFrame:
    """(path, content, length) of the markdown files below root; size and path are checked before content is decoded.

    Dot-directories are looked for at every level, or down to dot_depth levels.
    """
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{md,mdx,MD,MDX,Md,Mdx}")
        .load([root, *_dot_paths(spark, root, dot_depth)])
    )
    base = re.escape("/" + root.split("://")[-1].strip("/").removeprefix("file:").lstrip("/") + "/")
    relative = F.regexp_replace(F.col("path"), f"^.*?{base}", "")
    kept = keep_doc_files(raw.select(relative.alias("path"), "length", "content"), max_bytes)
    return kept.select("path", F.decode("content", "UTF-8").alias("content"), "length")


def path_classify(path: Column) -> Column:
    """struct(type, kind), or null for a path not worth reading."""
    low = F.lower(path)
    rule = F.lit(None).cast("struct<type:string,kind:string>")
    for pattern, type_, kind in reversed(PATH_RULES):
        rule = F.when(low.rlike(pattern), F.struct(F.lit(type_).alias("type"), F.lit(kind).alias("kind"))).otherwise(rule)
    return rule


def md_sections(docs: DataFrame, range_chars: int = markdown.RANGE_CHARS) -> DataFrame:
    """(path, pos, breadcrumb, body): one row per non-empty section.

    Files of up to `range_chars` characters are split where they are read; longer ones are cut into ranges of
    lines that many tasks scan.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                kept = [s for s in markdown.split_whole(content or "") if s[1]]
                rows += [(path, i, crumb, body) for i, (crumb, body) in enumerate(kept)]
            yield pd.DataFrame(rows, columns=["path", "pos", "breadcrumb", "body"])

    files = docs.select("path", "content")
    large = F.coalesce(F.length("content"), F.lit(0)) > range_chars
    small = files.where(~large).mapInPandas(split, "path string, pos int, breadcrumb string, body string")
    return small.unionByName(markdown.sections_of_ranges(markdown.ranges_of_texts(files.where(large), range_chars)))


def section_quality_filter(sections: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Long enough, and still at least half of that once fenced code is taken out."""
    prose = js_trim(F.regexp_replace("body", r"(?s)```.*?```", ""))
    return sections.where((F.length("body") >= min_chars) & (F.length(prose) >= min_chars / 2))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def entities_of(body: Column, path: Column, breadcrumb: Column, most: int | None = None) -> Column:
    """array<struct<name, kind>>: backticked identifiers, the file's name, the last heading."""
    ticked = F.regexp_extract_all(body, F.lit(r"`([A-Za-z][A-Za-z0-9_./-]{2,40})(?:\(\))?`"), F.lit(1))
    names = F.array_distinct(F.filter(ticked, lambda n: F.size(F.split(n, "/")) <= 2))
    stem = F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")
    leaf = F.element_at(F.split(breadcrumb, " > "), -1)
    has_stem = (F.length(stem) > 2) & ~F.lower(stem).isin("readme", "index")
    has_leaf = (F.length(leaf) > 2) & (F.length(leaf) < 60)
    entity = lambda name, kind: F.struct(name.alias("name"), kind.alias("kind"))
    # A later sighting of a name changes its kind and not its place.
    kind_of = lambda n: F.when(has_leaf & (n == leaf), "topic").when(has_stem & (n == stem), "document").otherwise("identifier")
    extra = F.array_compact(F.array(F.when(has_stem, stem), F.when(has_leaf, leaf)))
    every = F.array_distinct(F.concat(names, extra))
    named = F.transform(every, lambda n: entity(n, kind_of(n)))
    return named if most is None else F.slice(named, 1, most)


def docs_to_items(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Candidate items from files(path, content): one per section that carries reasoning."""
    rule = path_classify(F.col("path"))
    wanted = docs.withColumn("_rule", rule).where(F.col("_rule").isNotNull())
    sections = md_sections(wanted)
    typed = section_quality_filter(sections, min_chars).withColumn("_rule", path_classify(F.col("path")))
    heading = F.when(F.col("breadcrumb") != "", F.col("breadcrumb")).otherwise(file_name(F.col("path")))
    return typed.select(
        promote_decision(F.col("_rule.type"), F.col("body")).alias("type"),
        F.concat(heading, F.lit("\n\n"), F.col("body")).alias("content"),
        F.concat(F.lit("repo:"), "path", F.lit("#"), slug(heading)).alias("source"),
        F.lit(_DOCS_CONFIDENCE).alias("confidence"),
        entities_of(F.col("body"), F.col("path"), F.col("breadcrumb")).alias("entities"),
        F.concat("path", F.lit(" — "), heading).alias("origin"),
        F.col("path").alias("order_key"), F.col("pos").alias("order_pos"),
    )


RECORD, FIELD = "\x1e", "\x1f"


def read_commits(spark: SparkSession, path: str, since: str | None = None, max_commits: int | None = None) -> DataFrame:
    """(sha, subject, body, date) of exported logs, newest first when capped."""
    fields = F.split(js_trim(F.col("value")), FIELD)
    at = lambda i: F.try_element_at(fields, F.lit(i))
    records = spark.read.option("lineSep", RECORD).text(path).select(
        at(1).alias("sha"), at(2).alias("subject"), F.coalesce(at(3), F.lit("")).alias("body"), at(4).alias("date")
    )
    commits = records.where((F.coalesce("sha", F.lit("")) != "") & (F.coalesce("subject", F.lit("")) != ""))
    if since:
        commits = commits.where(F.to_timestamp("date") >= F.to_timestamp(F.lit(since)))
    return commits if max_commits is None else commits.orderBy(F.desc("date"), "sha").limit(max_commits)


def commits_to_items(commits: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Candidate items from commits whose message argues for something."""
    told = commits.withColumn("_m", strip_trailers(F.col("body"))).where(F.length("_m") >= min_chars)
    return told.select(
        F.when(argues(F.col("_m")), "decision").otherwise("note").alias("type"),
        F.concat("subject", F.lit("\n\n"), "_m").alias("content"),
        F.concat(F.lit("git:"), F.left("sha", F.lit(12))).alias("source"),
        F.lit(_COMMIT_CONFIDENCE).alias("confidence"),
        entities_of(F.col("_m"), F.lit("commit"), F.lit("")).alias("entities"),
        F.concat(F.left("sha", F.lit(8)), F.lit(" "), F.left("subject", F.lit(60))).alias("origin"),
        F.col("sha").alias("order_key"), F.lit(0).alias("order_pos"),
    )


def union_docs_commits(docs: DataFrame, commits: DataFrame) -> DataFrame:
    """Both candidate sets in one, documents first."""
    return docs.withColumn("priority", F.lit(0)).unionByName(commits.withColumn("priority", F.lit(1)))


def max_items_cap(candidates: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """The scan's hard ceiling: documents before commits."""
    return candidates.orderBy("priority", "order_key", "order_pos").limit(max_items)


def ingest_preview(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a scan would write: counts by type and the listing; nothing is stored."""
    counts = candidates.groupBy("type").agg(F.count("*").alias("n"))
    return counts, candidates.select("type", "origin", "source")
