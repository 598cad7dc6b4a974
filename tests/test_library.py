"""Sources, streaming and properties that SQL doesn't show."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as fn
from palimpsest.functions import versions as vs
from palimpsest.operators import bm25, chunking, datasets, dense, metrics, ranges, retrieval
from palimpsest.plans import catalog, retrieval as _queries  # noqa: F401
from palimpsest.sources import files


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a.md", ["T", "Ü"], 0, "x\ny", "1.30", "1.31"), ("b.md", [], None, "z", "1.9", "1.10")], files.CHUNK)
    assert files.write_jsonl(rows, f"{tmp_path}/c") == 2
    back = {r.doc_path: r for r in files.read_chunks(spark, f"{tmp_path}/c").collect()}
    assert (back["a.md"].version_low, back["a.md"].version_high, back["b.md"].part) == (30, 31, 0)
    assert len(back["a.md"].chunk_id) == 16 and back["a.md"].chunk_id != back["b.md"].chunk_id


def test_jsonl_malformed_line_fails(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"text": "ok"}\n\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "bad.json"), files.CHUNK).collect()


def test_examples_get_defaults(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"question": "q", "target_version": "1.30"}) + "\n")
    row = files.read_examples(spark, str(tmp_path / "e.json")).first()
    assert row.hard_negative_ids == [] and row.source == "generated" and row.unanswerable is False


def test_tree_skips_what_is_not_text(spark, tmp_path):
    for v, name, body in ((30, "a.md", b"# A"), (31, "sub/b.md", "ü".encode()), (31, "bad.md", b"\xff\xfe"), (31, "c.txt", b"no")):
        p = tmp_path / f"version={v}" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    assert {(r.version, r.doc_path) for r in files.read_tree(spark, str(tmp_path)).collect()} == {(30, "a.md"), (31, "sub/b.md")}


def test_branch_names(spark):
    got = files.versions_present(spark, ["main", "release-1.9", "release-1.31", "release-x", "dev-1.2"]).collect()
    assert {(r.major, r.minor) for r in got} == {(1, 9), (1, 31)}


def test_gold_needs_question_and_version(spark, tmp_path):
    good = tmp_path / "g.yaml"
    good.write_text("questions:\n  - question: Why?\n    version: 1.31\n    expect_doc: a\n")
    assert files.read_gold(spark, str(good)).first().version == "1.31"
    bad = tmp_path / "b.yaml"
    bad.write_text("questions:\n  - question: Why?\n")
    with pytest.raises(ValueError):
        files.read_gold(spark, str(bad))


def test_collection_is_rebuilt_when_its_manifest_differs(spark, tmp_path):
    c = files.Collection(spark, str(tmp_path), "Org/Small-Model", 2)
    assert c.name == "chunks__org_small_model__v2" and not c.ready() and not c.valid({"n": 2})
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([("a/x", 1, 3), ("b/y", 2, 5)], "doc_path string, version_low int, version_high int")

    assert c.get_or_build({"n": 2}, build).count() == 2 and c.ready()
    c.get_or_build({"n": 2}, build)
    c.get_or_build({"n": 3}, build)
    c.get_or_build({"n": 3}, build, force=True)
    assert len(built) == 3
    assert [r.doc_path for r in c.search(4).collect()] == ["b/y"] and c.search(3, "a/").count() == 1


def test_embedding_requests_out_of_bounds_fail(spark):
    ok = spark.createDataFrame([("t", "query")], "text string, kind string")
    assert files.validated_batches(ok).count() == 1
    with pytest.raises(Exception, match="out of bounds"):
        files.validated_batches(spark.createDataFrame([("", "query")], "text string, kind string")).collect()


def test_strict_version_parse_fails(spark):
    with pytest.raises(Exception, match="not a version"):
        spark.createDataFrame([("banana",)], "v string").select(vs.parse(F.col("v"))).collect()


def test_first_minor_has_none_before(spark):
    with pytest.raises(Exception, match="no version before"):
        spark.range(1).select(vs.preceding(F.col("id").cast("int"))).collect()


def test_islands_of_a_family_are_disjoint(spark, data):
    snaps = catalog.snapshots(spark, data)
    assert ranges.overlap_count(snaps, "family").filter("overlaps > 0").count() == 0
    assert snaps.groupBy("chunk_id").count().filter("count > 1").count() == 0


def test_filter_acts_before_the_cut(spark):
    passages = spark.createDataFrame([(i, [1.0, 0.0], 1, 1) for i in range(5)] + [(9, [0.0, 1.0], 7, 7)], "vec_id long, embedding array<float>, version_low int, version_high int")
    queries = spark.createDataFrame([(0, [1.0, 0.0], 7), (1, [1.0, 0.0], 30)], "query_id long, embedding array<float>, version int")
    got = dense.top_k(queries, passages, 2, True).collect()
    assert [(r.query_id, r.vec_id, r.rank) for r in got] == [(0, 9, 1)]


def test_single_query_equals_batch(spark, data):
    q = catalog.vector_queries(spark, data)
    v = catalog.vectors(spark, data)
    one = dense.top_k(q.filter("query_id = 50"), v, 5, True).collect()
    assert {tuple(r) for r in one} == {tuple(r) for r in dense.top_k(q, v, 5, True).filter("query_id = 50").collect()}


def test_bm25_fills_up_with_zeros(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i == 7 else f"word{i}") for i in range(10)], "doc_id long, text string")
    asks = spark.createDataFrame([(1, "alpha"), (2, "")], "item_id long, text string")
    t = fn.terms(F.col("text"))
    s = bm25.scores(asks, docs, "item_id", t, "doc_id", t)
    got = bm25.top_k(s, asks, docs, "item_id", "doc_id", 3).orderBy("item_id", "rank").collect()
    assert [(r.item_id, r.doc_id) for r in got] == [(1, 7), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]


def test_queries_without_hits_count_as_zero(spark):
    q = spark.createDataFrame([(1, 10, "a", 3), (2, 11, "", 3)], "query_id long, positive_id long, source string, version int")
    h = spark.createDataFrame([(1, 10, 1, 1, 5)], "query_id long, id long, rank int, version_low int, version_high int")
    got = {r.source: r for r in metrics.summarised(metrics.per_query(q, h)).collect()}
    assert set(got) == {"all", "a"} and got["all"].mrr_at_10 == 0.5 and got["all"].n == 2


def test_table_marks_the_best_of_several():
    rows = [{"config": "a", "m": 0.5}, {"config": "b", "m": 0.25}]
    assert "**0.500**" in metrics.markdown(rows, ["m"]) and "**" not in metrics.markdown(rows[:1], ["m"])


def test_ladder_changes_one_thing_a_row():
    by = {c.name: c for c in retrieval.LADDER}
    flags = lambda c: (*(s in dict(c.steps) for s in ("dense", "lexical", "rerank")), c.covering, c.encoder)
    for a, b in (("dense", "dense_filtered"), ("dense_filtered", "tuned_filtered"), ("tuned_filtered", "reranked"), ("reranked", "hybrid_reranked")):
        assert sum(x != y for x, y in zip(flags(by[a]), flags(by[b]))) == 1
    with pytest.raises(ValueError):
        retrieval.selected(["dense", "none"])


def test_pipeline_needs_its_parts(spark):
    with pytest.raises(ValueError):
        retrieval.Pipeline(retrieval.Config("x")).hits()


def test_splits_lose_no_family(spark):
    fams = spark.range(200).select(F.col("id").alias("family"))
    got = {r.split: r["count"] for r in datasets.split_by_family(fams, "family").groupBy("split").count().collect()}
    assert got == {"dev": 20, "test": 30, "train": 150}


def test_random_negatives_are_of_other_families(spark, data):
    fam = {r.vec_id: r.family for r in catalog.vectors(spark, data).collect()}
    rows = catalog.QUERIES["random_negatives"](spark, data).collect()
    assert rows and all(fam[r.id] != fam[r.query_id] for r in rows)
    assert max(r.place for r in rows) <= 2


def test_random_negatives_fill_and_reach_every_passage(spark):
    few = spark.createDataFrame([(i, 1) for i in range(300)] + [(1000, 2), (1001, 3)], "id long, family int")
    asks = spark.createDataFrame([(i, 1) for i in range(40)] + [(50, 2), (60, 9)], "query_id long, family int")
    rows = datasets.random_negatives(asks, few).collect()
    of = {q: sorted(r.id for r in rows if r.query_id == q) for q in [*range(40), 50, 60]}
    assert all(of[q] == [1000, 1001] for q in range(40)) and all(len(set(of[q])) == 2 for q in of) and 1000 not in of[50]
    assert {(r.query_id, r.place) for r in rows} == {(q, p) for q in of for p in (1, 2)}
    many = spark.createDataFrame([(i, i % 7) for i in range(2000)], "id long, family int")
    drawn = datasets.random_negatives(spark.createDataFrame([(i, i % 7) for i in range(10000)], "query_id long, family int"), many).collect()
    assert len(drawn) == 20000 and all(r.id % 7 != r.query_id % 7 for r in drawn) and len({r.id for r in drawn}) > 1990
    only = spark.createDataFrame([(1, 1), (2, 2)], "id long, family int")
    assert [tuple(r) for r in datasets.random_negatives(asks.filter("query_id = 0"), only).collect()] == [(0, 2, 1)]
    assert datasets.random_negatives(asks, only.limit(0)).count() == 0


def test_pairs_have_random_negatives(spark):
    ask = spark.createDataFrame([(1, 10)], "query_id long, positive_id long")
    rows = spark.createDataFrame([(1, 20 + i, i) for i in range(1, 9)], "query_id long, id long, place int")
    got = datasets.pairs(ask, rows, rows, random=rows)
    assert {r.kind: r["count"] for r in got.groupBy("kind").count().collect()} == {"positive": 1, "family": 4, "retriever": 6, "random": 2}
    assert datasets.pair_weights(got).first().pos_weight == 12.0


def test_pieces_keep_blocks_whole():
    long = "\n\n".join(["para " * 9 + "para"] * 4 + ["~~~\n" + "x\n\n" * 50 + "~~~", "tail"])
    got = chunking.pieces(long, chunking.Sizes(110, 100, 1))
    assert "\n\n".join(got) == long and sum(p.count("~~~") for p in got) == 2 and any(p.count("~~~") == 2 for p in got)
    assert got[0].count("para") == 20 and max(len(p) for p in got if "~~~" not in p) <= 110
    assert chunking.pieces("", chunking.Sizes()) == [""]


def test_sections_skip_headings_in_blocks():
    body = "start\n# A #x\none\n```sh\n# no heading\n~~~\n### nor here\n```\n### C {#c}\nthree\n# {#empty}\nstill three\n## B\n~~~\n## open block\n"
    got = [(crumbs, text.split()[0]) for crumbs, text in chunking.sections(body, "T") if text.strip()]
    assert got == [(["T"], "start"), (["T", "A #x"], "one"), (["T", "A #x", "C"], "three"), (["T", "A #x", "B"], "~~~")]


def test_normalized_text(spark):
    raw = "  a \r\n\r\n\r\n\r\nb<!-- c\nd --> {{< note >}}e{{< /note >}}\t\n\n\nf  "
    assert spark.createDataFrame([(raw,)], "r string").select(fn.normalized(F.col("r"))).first()[0] == "a\n\nb e\n\nf"


def test_removal_examples_have_questions_and_negatives(spark):
    from palimpsest.operators import examples

    facts = spark.createDataFrame([("f", "g/v1b", ["Flow"], 31), ("n", "h/v1", ["Other"], 31)], "fact_id string, api string, resources array<string>, removed int")
    rows = [("a", 0, "F1", "g/v1b of Flow is gone", 31, 33), ("b", 1, "F2", "Flow has g/v2", 31, 33), ("c", 2, "F1", "old text", 29, 30), ("d", 3, "F3", "h/v1 of Other", 31, 33)]
    passages = spark.createDataFrame(rows, "chunk_id string, seq int, family string, text string, version_low int, version_high int")
    versions = spark.createDataFrame([(v,) for v in range(29, 34)], "version int")
    every, edge = examples.removals(facts, passages, passages, versions)
    got = {r.version: r for r in every.collect()}
    assert set(got) == {31, 32, 33} and all(r.positive_id == "a" and r.negatives == ["c", "b"] and "g/v1b" in r.question for r in got.values())
    assert [(r.version, r.negatives, r.source) for r in edge.collect()] == [(31, ["b"], "deprecation-boundary")]
    both = examples.assembled([every, edge, every])
    assert both.count() == 4 and {r.source: r.examples for r in examples.build_stats([every, edge, every]).collect()} == {"deprecation": 6, "deprecation-boundary": 1}


def test_results_are_written_and_read_again(spark, tmp_path):
    rows = spark.createDataFrame([(c, s, m, v) for c, v in (("x", 0.5), ("y", 0.75)) for s in ("all", "a") for m in ("p", "q")], "config string, source string, metric string, value double")
    files.write_results(rows, str(tmp_path), "test")
    files.write_results(rows.filter("config = 'x'"), str(tmp_path), "dev")
    assert files.read_results(spark, str(tmp_path)).count() == 12
    text = files.results_document(spark, str(tmp_path), ["p", "q"])
    assert "## test" in text and "| y | **0.750** | **0.750** |" in text and "### x" in text


def test_passages_survive_a_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("b.md", ["T"], 0, "x", 30, 31), ("a.md", ["T"], 1, "y", 29, 29)], "doc_path string, heading_path array<string>, part int, text string, version_low int, version_high int").withColumn("chunk_id", F.lit("c"))
    assert files.write_chunks(rows, f"{tmp_path}/c") == 2
    assert {(r.doc_path, r.part, r.version_low, r.version_high) for r in files.read_chunks(spark, f"{tmp_path}/c").collect()} == {("b.md", 0, 30, 31), ("a.md", 1, 29, 29)}


def test_degraded_runs_fail_the_gate(spark):
    from palimpsest.operators import gate

    base = spark.createDataFrame([("a", "m", 0.5)], "config string, metric string, value double")
    run = spark.createDataFrame([("a", "m", 0.5, False), ("b", "m", 0.9, True)], "config string, metric string, value double, degraded boolean")
    assert [(r.config, r.reason) for r in gate.regressions(base, run).collect()] == [("b", "degraded")]
    assert gate.regressions(base, run, allow_degraded=True).isEmpty() and [r.config for r in gate.first_baseline(run).collect()] == ["a"]
    assert retrieval.resolved_model("tuned", {"base": "x"}, "x") == ("x", True) and retrieval.resolved_model("base", {"base": "x"}, "x") == ("x", False)


def test_unanswerable_questions_do_not_count(spark):
    q = spark.createDataFrame([(1, 10, False), (2, 11, False), (3, 10, True), (4, None, None)], "query_id long, positive_id long, unanswerable boolean")
    p = spark.createDataFrame([(10,)], "id long")
    assert [r.query_id for r in metrics.evaluable(q, p, "id").collect()] == [1]
    assert tuple(metrics.skipped(q, p, "id").first()) == (4, 1, 2)


def test_dense_search_skips_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 1, 9), (2, None, 1, 9), (3, [1.0], 1, 9), (4, [1.0, None], 1, 9), (5, [1.0, 0.0], 1, 9), (6, [0.5, 0.0], 3, 4)], "vec_id long, embedding array<double>, version_low int, version_high int")
    q = spark.createDataFrame([(1, [1.0, 0.0], 3), (2, [2.0], None), (3, None, 3)], "query_id long, embedding array<double>, version int")
    assert {tuple(r) for r in dense.top_k(q, v, 2, True).collect()} == {(1, 1, 1.0, 1), (1, 5, 1.0, 2)}
    assert {tuple(r) for r in dense.top_k(q, v, 3, False).collect()} == {(1, 1, 1.0, 1), (1, 5, 1.0, 2), (1, 6, 0.5, 3), (2, 3, 2.0, 1)}
    assert dense.top_k(q.limit(0), v, 2, True).count() == 0


def test_facts_that_share_names_multiply_no_passages(spark, monkeypatch):
    """40 facts of two APIs and 20 resources over 300 passages: what the search hands on, and the results of a plain search."""
    from palimpsest.operators import datasets

    facts = [(f"f{i}", f"api{i % 2}", [f"res{i % 20:02d}", f"res{(i + 7) % 20:02d}"], 30 + i % 3) for i in range(40)]
    passages = [(1000 + i, i, None if i % 19 == 0 else i % 4, f"api{i % 3} of res{i % 20:02d} and res{i % 9:02d}", 29 + i % 3, 31 + i % 4) for i in range(300)]
    fd = spark.createDataFrame(facts, "fact_id string, api string, resources array<string>, removed int")
    pd = spark.createDataFrame(passages, "chunk_id long, seq int, family int, text string, version_low int, version_high int")
    plain, handed = datasets.contains_join, []
    monkeypatch.setattr(datasets, "contains_join", lambda *a: handed.append(plain(*a)) or handed[-1])
    at = datasets.removal_examples(fd, pd, spark.createDataFrame([(v,) for v in range(29, 35)], "version int"))
    examples, siblings = {}, {}
    for f, api, names, removed in facts:
        for v in range(removed, 35):
            own = [p for p in passages if api in p[3] and any(n in p[3] for n in names) and p[4] <= v <= p[5]]
            if own:
                examples[f, v] = (own[0][0], v == removed)
                fits = [p[0] for p in passages if any(n in p[3] for n in names) and api not in p[3] and None not in (p[2], own[0][2]) and p[2] != own[0][2]]
                siblings |= {(f, v, c): n for n, c in enumerate(fits[:6], 1)}
    assert {(r.fact_id, r.version): (r.positive, r.boundary) for r in at.collect()} == examples
    assert {(r.fact_id, r.version, r.negative): r.place for r in datasets.sibling_negatives(at, fd, pd).collect()} == siblings
    assert max(h.count() for h in handed) <= 2 * len(passages)


@pytest.mark.parametrize("filtered", [False, True])
def test_the_nearest_ids_are_those_of_all_pairs_and_no_pairs_are_made(spark, filtered, monkeypatch):
    """Ids lie so far apart that rounded scores tie, some repeat, one is null; a family has twenty queries that no longer meet all of it."""
    import random

    from pyspark.sql.window import Window

    plan, draw = _queries, random.Random(5)
    ids = [None, *(draw.choice([draw.randrange(2_000) * 1_000, draw.randrange(-5_000_000, 5_000_000) * 400, draw.randrange(200)]) for _ in range(500))]
    v = spark.createDataFrame([(i, [], f, low, low + 2) for i in [*ids, *ids[:40]] for f, low in [(draw.randrange(3), draw.randrange(4))]], "vec_id long, embedding array<float>, family long, version_low int, version_high int")
    v = spark.createDataFrame(v.collect(), v.schema)
    q = v.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "family", F.lit(3).alias("version"))
    monkeypatch.setattr(plan, "vectors", lambda *_: v)
    monkeypatch.setattr(plan, "vector_queries", lambda *_: q)
    pairs = ranges.range_join(q, v, ["family"]) if filtered else q.join(v, "family")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    scored = pairs.withColumn("score", F.round(1.0 / (1 + F.abs(F.col("query_id") - F.col("vec_id"))), 6)).withColumn("rank", F.row_number().over(w))
    for k in (6,):
        want = sorted(map(tuple, scored.filter(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank").collect()), key=repr)
        assert sorted(map(tuple, plan._stub_lexical(spark, "", k, filtered).collect()), key=repr) == want
    dense_ids = spark.range(2_000).select(F.col("id").alias("vec_id"), F.lit(1).alias("family"))
    met = retrieval.nearest(dense_ids.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), dense_ids, ["family"], "query_id", "vec_id", 5, plan._alike)
    assert met.count() <= 20 * 3 * 5


@pytest.mark.parametrize("filtered", [False, True])
def test_bm25_search_ranks_in_tasks_as_the_join_does_and_shuffles_no_pairs(spark, filtered, monkeypatch):
    """Equal to the join of postings: null and empty texts, zeros, ties, a query without a version; few documents come out of a task for a query."""
    from palimpsest.operators.ranges import expanded

    words = [f"w{i % 23}" for i in range(400)] + ["a/bcd", "x.y-z"]
    docs = [(i, None if i % 50 == 3 else " ".join(words[(i * j * j) % 402] for j in range(i % 9)), i % 4, i % 4 + i % 3) for i in range(600)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, version_low int, version_high int")
    asks = spark.createDataFrame([(1, "w1 w2 w2", 2), (2, "", 3), (3, None, 1), (4, "w5 nowhere a/bcd", None), (5, "w7", 9), (6, "nowhere", 0)], "item_id long, text string, version int")
    t = fn.terms(F.col("text"))
    pool = expanded(docs.select("doc_id", "version_low", "version_high")) if filtered else docs
    want = bm25.top_k(bm25.scores(asks, docs, "item_id", t, "doc_id", t), asks, pool, "item_id", "doc_id", 7, "version" if filtered else None)
    want = sorted(map(tuple, want.collect()))
    left = []
    inner = bm25._searched
    monkeypatch.setattr(bm25, "_searched", lambda *a: left.append(inner(*a)) or left[-1])
    got = bm25.search(asks, docs.repartition(3), "item_id", t, "doc_id", t, 7, filtered)
    assert sorted(map(tuple, got.collect())) == want and left[0].count() <= 3 * 7 * 6
    monkeypatch.setattr(bm25, "MOST_TERMS", 1)
    assert sorted(map(tuple, bm25.search(asks, docs, "item_id", t, "doc_id", t, 7, filtered).collect())) == want and len(left) == 1
