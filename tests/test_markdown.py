"""Sections of markdown by ranges of lines equal those of the whole file."""

import random

import pytest

from memloom.session import scratch_path
from memloom.sources import docs, markdown

LINES = ["# One", "## Two ##", "### Three", "#### ", "plain text", "", "  ", "```", "~~~", "````py", "  ~~~~", "#not a heading", "# # x", "text # no", "## Zwei\tB",
         "###### deep", "a\r", " nbsp ", "\ttab"]


def text_of(rng, lines):
    return "".join(rng.choice(LINES) + rng.choice(["\n", "\n", "\r\n"]) for _ in range(lines)) + rng.choice(["", "end", "# last"])


def whole(text):
    kept = [s for s in markdown.split_whole(text) if s[1]]
    return [(i, crumb, body) for i, (crumb, body) in enumerate(kept)]


def test_summaries_compose():
    rng = random.Random(3)
    for _ in range(60):
        lines = [rng.choice(LINES).removesuffix("\r") for _ in range(40)]
        both = markdown.summary("\n".join(lines))
        cut = rng.randint(1, 39)
        first, second = markdown.summary("\n".join(lines[:cut])), markdown.summary("\n".join(lines[cut:]))
        for told, (fence, count, least, stack) in zip(both, first):
            end, more, lower, pushed = second[markdown.FENCES.index(fence)]
            assert told == (end, count + more, min(least, lower), [e for e in stack if e[0] < lower] + pushed)


@pytest.mark.parametrize("size", [1, 7, 60, 10_000])
def test_files_cut_anywhere(spark, size):
    rng = random.Random(size)
    files = [(f"docs/f{n}.md", text_of(rng, 120)) for n in range(12)] + [("docs/e.md", ""), ("docs/n.md", None), ("docs/f1.md", "# same path\nbody")]
    df = spark.createDataFrame(files, "path string, content string").repartition(3)
    got = sorted((r["path"], r["pos"], r["breadcrumb"], r["body"]) for r in docs.md_sections(df, size).collect())
    assert got == sorted((path, *s) for path, text in files for s in whole(text or ""))


def test_a_large_file_read_as_lines(spark):
    rng = random.Random(9)
    text = text_of(rng, 60_000).replace("\r\r\n", "\r\n")
    root = scratch_path(spark, "tree")
    import os

    os.makedirs(f"{root}/docs")
    with open(f"{root}/docs/big.md", "w", newline="") as file:
        file.write(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        ranges = markdown.read_ranges(spark, root, 3000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert ranges.count() > 100
    got = [(r["pos"], r["breadcrumb"], r["body"]) for r in markdown.sections_of_ranges(ranges).orderBy("pos").collect()]
    assert got == whole(text)


def test_heading_stack(spark):
    text = "intro\n# A\n## B\n```\n# no\n```\n### C\n# D\nend"
    df = spark.createDataFrame([("x.md", text)], "path string, content string")
    for size in (1, 1000):
        got = markdown.heading_stack(markdown.ranges_of_texts(df, size)).orderBy("section").collect()
        assert [r["breadcrumb"] for r in got] == ["A", "A > B", "A > B > C", "D"]
