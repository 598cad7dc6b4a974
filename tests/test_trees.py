"""Trees by version: only the asked version's files are opened, what can't be read is counted, new versions stream in once."""

import pytest

from palimpsest.sources import trees


@pytest.fixture
def root(tmp_path):
    for v, names in {24: ["a.md", "docs/b.md", "docs/deep/c.md", "skip.txt"], 25: ["a.md"], 26: []}.items():
        for n in names:
            f = tmp_path / "t" / f"version={v}" / n
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_text(f"# {v} {n} é", encoding="utf-8")
        (tmp_path / "t" / f"version={v}").mkdir(parents=True, exist_ok=True)
    (tmp_path / "t/version=24/bad.md").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "t/notes").mkdir()
    return tmp_path / "t"


def test_rows_and_what_was_skipped(spark, root):
    rows = trees.read(spark, str(root)).collect()
    assert {(r.version, r.doc_path, r.problem) for r in rows} == {(24, "a.md", None), (24, "docs/b.md", None), (24, "docs/deep/c.md", None), (24, "bad.md", trees.UNDECODABLE), (25, "a.md", None)}
    assert next(r.raw for r in rows if r.doc_path == "docs/b.md") == "# 24 docs/b.md é"
    asked = trees.read(spark, f"file://{root}", [24, 26, 99])
    assert {tuple(r) for r in trees.skipped(asked).collect()} == {(24, trees.UNDECODABLE, 1), (99, trees.MISSING, 1)}


def test_a_version_opens_no_other_files(spark, root):
    reader = trees.TreeReader({"path": str(root), "versions": "24"})
    assert {p.version for p in reader.partitions()} == {24} and all("version=24" in e for p in reader.partitions() for e in p.entries)
    assert trees.skipped(trees.read(spark, str(root), [24])).filter("version = 25").count() == 0


def test_filters_on_the_version_choose_folders(spark, root):
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df = trees.read(spark, str(root)).filter("version = 25 and doc_path like 'a%'")
        assert [(r.version, r.doc_path) for r in df.collect()] == [(25, "a.md")]
        many = trees.read(spark, str(root)).filter("version in (24, 25)")
        assert many.count() == 5
        assert df.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_a_file_that_vanished_is_a_row(root):
    part = trees.Part(24, f"{root}/version=24", (f"{root}/version=24/a.md", f"{root}/version=24/gone.md"))
    assert [(n, p) for _, n, _, p in trees.rows_of(str(root), part, ".md")] == [("a.md", None), ("gone.md", trees.UNREADABLE)]


def test_many_entries_are_several_tasks(root, monkeypatch):
    monkeypatch.setattr(trees, "ENTRIES", 2)
    parts = trees.TreeReader({"path": str(root), "versions": "24"}).partitions()
    assert len(parts) == 2
    assert sorted(n for p in parts for _, n, _, _ in trees.rows_of(str(root), p, ".md")) == ["a.md", "bad.md", "docs/b.md", "docs/deep/c.md"]


def test_versions_stream_in_once(spark, root, tmp_path):
    def run():
        q = trees.stream(spark, str(root)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r.version, r.doc_path) for r in spark.read.schema(trees.SCHEMA).parquet(str(tmp_path / "out")).collect())

    assert len(run()) == 5
    late = root / "version=7"
    late.mkdir()
    (late / "late.md").write_text("late")
    assert [x for x in run() if x[0] == 7] == [(7, "late.md")] and len(run()) == 6
