"""Table functions of sections against the scan of whole texts, on generated Markdown with fences, anchors and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import chunking, outline

LINES = ["# One", "## Two {#two}", "### Three {{< beta >}}", "###### Six", "#no heading", "# ", "## {#only}", "```", "```yaml", "~~~", "  ```", "text", "", "- item", "\t# indented", "####### seven", "# Twice {#a} {{< x >}}", "``` # odd"]


def texts(seed, n=60):
    r = random.Random(seed)
    return [(i, "\n".join(r.choice(LINES) for _ in range(r.randrange(0, 40)))) for i in range(n)] + [(900, ""), (901, None), (902, "# x"), (903, "```\n# never closed"), (904, "\n\n")]


@pytest.mark.parametrize("seed", [1, 2])
def test_lateral_sections(spark, seed):
    rows = texts(seed)
    got = sorted(map(tuple, outline.sections_of(spark.createDataFrame([(i, t, f"t{i}") for i, t in rows], "id int, text string, title string"), "text", "title").select("id", "section", "heading_path", "body").collect()))
    assert got == sorted((i, n, p, b) for i, t in rows if t is not None for n, (p, b) in enumerate(chunking.sections(t, f"t{i}")))


@pytest.mark.parametrize("seed", [3, 4])
def test_lines_in_order_give_the_same_sections(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "id int, text string")
    lines = outline.lines_of(df, "id").orderBy(F.rand(seed)).repartition(5)
    got = {(r.key, r.section): (r.heading_path, r.body) for r in outline.gathered(outline.outlined(lines, F.col("id"), F.col("line"), F.col("text"))).collect()}
    want = {}
    for i, t in rows:
        found = list(chunking.sections(t, None)) if t is not None else []
        for n, (path, body) in enumerate(found):  # without the line ends that belong to headings
            body = body[1:] if n else body
            body = body[:-1] if n + 1 < len(found) else body
            if n or len(found) == 1 or found[0][1]:  # nothing lies before a heading in the first line
                want[str(i), n] = (path, body)
    assert got == want


def test_odd_lines(spark):
    lines = spark.createDataFrame([(None, 1, "# a"), (None, 2, None), ("k", 2, "b"), ("k", 2, "# c"), ("k", None, "~~~")], "k string, n int, text string")
    got = {tuple(r)[:2] + (r.text, r.fenced) for r in outline.outlined(lines, F.col("k"), F.col("n"), F.col("text")).collect()}
    assert got == {(None, 1, "# a", False), (None, 2, None, False), ("k", None, "~~~", True), ("k", 2, "# c", True), ("k", 2, "b", True)}
    assert outline.outlined(lines.limit(0), F.col("k"), F.col("n"), F.col("text")).count() == 0
