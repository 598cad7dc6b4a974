"""From a tree of two releases to splits, mined negatives and an evaluation."""

from palimpsest import __main__ as cli
from palimpsest.config import Settings
from palimpsest.operators import metrics, workflow
from palimpsest.sources import files

GUIDE = """# Guide

### v1.31

#### Flow {#flow}

The **flow.example/v1beta1** API version of Flow is no longer served as of v1.31. Use **flow.example/v1** API version, available since v1.29. %s
"""


def test_from_tree_to_results(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("PALIMPSEST_VERSION_LOW", "30")
    monkeypatch.setenv("PALIMPSEST_VERSION_HIGH", "31")
    for v in (30, 31):
        where = tmp_path / f"tree/version={v}"
        where.mkdir(parents=True)
        (where / "deprecation-guide.md").write_text(GUIDE % ("More words about the change of flows. " * 8))
        for i in range(30):
            changed = f"In release {v} the setting number {i} is called option{i}at{v}. " if i % 2 else f"The setting number {i} is steady. "
            (where / f"page{i}.md").write_text(f"# Page {i}\n\n## Setting {i}\n\n{changed}" + f"Words on subject{i} go on. " * 12)
    out = str(tmp_path / "out")
    cli.ingest(spark, str(tmp_path / "tree"), out)
    stats = {r.source: r.examples for r in workflow.build(spark, out, Settings(version_low=30, version_high=31)).collect()}
    assert stats["changed-section"] == 30 and 0 < stats["unanswerable"] <= 60
    whole = files.read_examples(spark, f"{out}/examples").count()
    sizes = {s: files.read_examples(spark, f"{out}/splits/{s}").count() for s in workflow.SPLITS}
    assert sum(sizes.values()) == whole and all(sizes.values())
    asked = {r.question: r for r in workflow.questions(spark, out, "train").filter("not unanswerable").collect()}
    seen = workflow.mine(spark, out, "train").first()
    mined = spark.read.json(f"{out}/mined/train").collect()
    assert {r.question for r in mined} == set(asked) and seen.negatives == sum(len(r.negatives) for r in mined) > 0
    family = {r.chunk_id: r.family_id for r in spark.read.parquet(f"{out}/chunks").collect()}
    assert all(family[n] != family[r.positive_id] for r in mined for n in r.negatives)
    got = {(r.config, r.metric): r.value for r in workflow.evaluate(spark, out, "train").filter("source = 'all'").collect()}
    assert set(got) == {(c, m) for c in ("bm25", "bm25-filtered") for m in metrics.NAMES}
    assert got["bm25-filtered", "version_correct_at_1"] == 1.0 and got["bm25-filtered", "recall_at_5"] >= got["bm25", "recall_at_5"] - 0.2
