"""Splits of examples without a family, alerts and aborts, overrides, refusals, headings with anchors before shortcodes, skipped files."""

import pytest
from pyspark.sql import functions as F

from palimpsest import __main__ as cli
from palimpsest.operators import answer, chunking, datasets, dense, facts, resolve


def test_examples_without_a_family_are_split_on_their_own(spark):
    rows = [(f"q{i}", f"f{i // 4}") for i in range(400)] + [(f"u{i}", (None, "")[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "question string, family string")
    out = datasets.split_examples(df)
    assert out.columns == ["question", "family", "split"] and out.count() == len(rows)
    sizes = {(r.attached, r.split): r.n for r in out.groupBy((F.coalesce("family", F.lit("")) != "").alias("attached"), "split").agg(F.count_distinct(F.when(F.coalesce("family", F.lit("")) != "", F.col("family")).otherwise(F.col("question"))).alias("n")).collect()}
    assert sizes == {(True, "dev"): 10, (True, "test"): 15, (True, "train"): 75, (False, "dev"): 6, (False, "test"): 9, (False, "train"): 45}
    assert datasets.leaks(out.filter("family <> ''"), "family").isEmpty()


def test_too_many_missing_texts_are_an_error(spark):
    pairs = spark.createDataFrame([(1, i, i % 2) for i in range(10)], "query_id long, id long, label int")
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id long, text string")
    assert datasets.with_texts(pairs, texts).count() == 5
    with pytest.raises(ValueError, match="6 of 10"):
        datasets.with_texts(pairs, texts.filter("id < 4"))
    assert datasets.with_texts(pairs.limit(0), texts).count() == 0


def test_mined_shares_compare_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, doc_path string")
    mined = spark.createDataFrame([(9, 2, 1), (9, 3, 2), (9, 4, 3), (9, 2, 4)], "query_id long, id long, place int")
    assert tuple(datasets.mined_shares(mined, spark.createDataFrame([(9, 1)], "query_id long, positive_id long"), docs).first()) == (4, 2, 0.5)


def test_low_coverage_alerts(spark):
    rows = spark.createDataFrame([(10, 8, 0.8), (10, 9, 0.9), (0, 0, 0.0)], "blocks long, facts long, coverage double")
    assert [r.alert for r in facts.alerted(rows).collect()] == [True, False, False]


def test_overrides_are_parsed_strictly(spark):
    none = spark.createDataFrame([], "api string, removed int, seq int")
    ask = lambda p: resolve.resolved(spark.createDataFrame([(1, "what about 1.30?", p)], "query_id long, query string, param string"), none, 24, 35, param="param").first()
    assert (ask("1.28").version, ask("1.28").evidence) == (28, "parameter") and ask(None).version == 30
    with pytest.raises(Exception, match="not a version: soon"):
        ask("soon")


def test_refusals_of_the_model(spark):
    decided = spark.createDataFrame([(1, "answered"), (2, "answered"), (3, "low_confidence")], "query_id long, decision string")
    said = spark.createDataFrame([(1, "refusal"), (1, "refusal"), (2, "end_turn"), (3, "refusal")], "query_id long, stop_reason string")
    assert {r.query_id: r.decision for r in answer.outcome(decided, said, "query_id").collect()} == {1: "model_declined", 2: "answered", 3: "low_confidence"}


def test_vectors_of_two_lengths_are_an_error(spark):
    v = lambda *xs: spark.createDataFrame([(list(x),) if x else (None,) for x in xs], "embedding array<double>")
    assert dense.same_length(v((1.0, 2.0), None), v((3.0, 4.0))) == 2 and dense.same_length(v(None), v(None)) is None
    with pytest.raises(ValueError):
        dense.same_length(v((1.0, 2.0)), v((3.0,)))


@pytest.mark.parametrize("heading", ["Pods {#pods} {{< beta >}}", "{{< beta >}} Pods {#pods}", "Pods {#pods}", "Pods", "Pods {{% x %}} {#pods}  "])
def test_headings_lose_shortcodes_before_anchors(heading):
    assert [b for b, _ in chunking.sections(f"## {heading}\ntext\n", "T")][-1] == ["T", "Pods"]


def test_ingest_says_what_it_skipped(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("PALIMPSEST_VERSION_LOW", "30")
    monkeypatch.setenv("PALIMPSEST_VERSION_HIGH", "32")
    for v in (30, 31):
        (tmp_path / f"tree/version={v}").mkdir(parents=True)
        (tmp_path / f"tree/version={v}/a.md").write_text("# A\n\n" + "some words " * 60)
    (tmp_path / "tree/version=31/b.md").write_bytes(b"\xff")
    cli.ingest(spark, str(tmp_path / "tree"), str(tmp_path / "out"))
    assert capsys.readouterr().err.splitlines() == ["1.31: not UTF-8 (1)", "1.32: missing version (1)"]
    got = spark.read.parquet(str(tmp_path / "out/chunks")).collect()
    assert [(r.version_low, r.version_high) for r in got] == [(30, 31)]
