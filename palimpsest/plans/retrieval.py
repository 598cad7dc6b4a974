"""Queries on rankings, metrics, gates and derived training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import answer, bm25, datasets, dense, examples, gate, grid, metrics, ranges, retrieval
from .catalog import SNAP, VEC, VQ, literal, query, snapshots, table, vector_queries, vectors

K = 20
_DOT = "round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 6)"


def _ranked(name: str, where: str, k: int = K, dot: str = _DOT) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
FROM (SELECT q.query_id, v.vec_id, {dot} AS score FROM vq q JOIN vec v ON {where})) WHERE rank <= {k})"""


COVERS = "q.version BETWEEN v.version_low AND v.version_high"
ALL, FILTERED = _ranked("hits", "true"), _ranked("fhits", COVERS)


def _dense(spark: SparkSession, d: str, filtered: bool, k: int = K, dims: int | None = None) -> DataFrame:
    """Of whole vectors, or of their first ``dims`` numbers, which stand for another encoder."""
    cut = (lambda df: df.withColumn("embedding", F.slice("embedding", 1, dims))) if dims else (lambda df: df)
    return dense.top_k(cut(vector_queries(spark, d)), cut(vectors(spark, d)), k, filtered)


@query(f"WITH {VQ}, {ALL} SELECT * FROM hits")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, False)


@query(f"WITH {VQ}, {FILTERED} SELECT * FROM fhits")
def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, True)


@query(f"WITH {VEC}, vq AS (SELECT vec_id AS query_id, embedding, version_low AS version FROM vec), {_ranked('hits', COVERS, 6)} SELECT * FROM hits")
def dense_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every vector's six nearest among those that cover its first version, itself included: the queries are a whole table, so they meet on a grid."""
    v = vectors(spark, d)
    return grid.top_k(v.select(F.col("vec_id").alias("query_id"), "embedding", F.col("version_low").alias("version")), v, 6, True)


# BM25: every benchmark text asks, all documents answer.


_PARTS = "flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+(?:[./-][a-z0-9]+)*'), lambda t: CASE WHEN length(t) > 3 AND regexp_matches(t, '[./-]') THEN list_concat([t], list_filter(string_split_regex(t, '[./-]'), lambda p: length(p) > 2)) ELSE [t] END))"
_BM25 = f"""dt AS (SELECT doc_id, {_PARTS.format('text')} AS t FROM documents), dl AS (SELECT doc_id, len(t) AS dl FROM dt),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM dt) GROUP BY 1, 2),
st AS (SELECT count(*) AS n, avg(dl) AS al FROM dl), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, st), idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_PARTS.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT qt.item_id, p.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al))) AS s FROM qt JOIN post p USING (term) JOIN idf USING (term) JOIN dl ON dl.doc_id = p.doc_id, st GROUP BY 1, 2)"""
_ALL_SCORES = "al AS (SELECT b.item_id, d.doc_id, coalesce(round(s, 4), 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN sc ON sc.item_id = b.item_id AND sc.doc_id = d.doc_id{})"
_TOP = "SELECT * FROM (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM al) WHERE rank <= 20"
_WINDOW = " WHERE (b.item_id % 12) BETWEEN d.doc_id % 6 AND d.doc_id % 6 + 4"


@query(f"WITH {_BM25}, {_ALL_SCORES.format('')} {_TOP}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    t = fn.terms(F.col("text"))
    return bm25.search(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", t, "doc_id", t, K)


@query(f"WITH {_BM25}, {_ALL_SCORES.format(_WINDOW)} {_TOP}")
def bm25_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Documents valid for minors id % 6 to id % 6 + 4; an item asks about id % 12."""
    t, low = fn.terms(F.col("text")), (F.col("doc_id") % 6).cast("int")
    docs = table(spark, d, "documents").select("doc_id", "text", low.alias("version_low"), (low + 4).alias("version_high"))
    asks = table(spark, d, "benchmark").select("item_id", "text", (F.col("item_id") % 12).cast("int").alias("version"))
    return bm25.search(asks, docs, "item_id", t, "doc_id", t, K, True)


def _lexical_sql(name: str, where: str = "true", k: int = K) -> str:
    return f"{name} AS (SELECT * FROM (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (SELECT q.query_id, v.vec_id, round(1.0 / (1 + abs(q.query_id - v.vec_id)), 6) AS score FROM vq q JOIN vec v ON q.family = v.family AND {where})) WHERE rank <= {k})"


_LEX = _lexical_sql("lex")


def _union_sql(name: str, first: str, second: str) -> str:
    return f"""{name} AS (SELECT query_id, vec_id, score, stage, CAST(row_number() OVER (PARTITION BY query_id ORDER BY stage = 'bm25', rank) AS INTEGER) AS rank FROM (
SELECT *, 'dense' AS stage FROM {first} UNION ALL SELECT *, 'bm25' FROM {second} l WHERE NOT EXISTS (SELECT 1 FROM {first} h WHERE h.query_id = l.query_id AND h.vec_id = l.vec_id)))"""


_UNION = _union_sql("un", "hits", "lex")


def _nearness(distance: Column) -> Column:
    return F.round(1.0 / (1 + distance), 6)


def _alike(distance: Column) -> Column:
    """The largest distance of the same nearness: near the one at which 1 / (1 + distance) rounds down; none at nearness 0."""
    steps = F.round(_nearness(distance) * 1_000_000).cast("long")
    about = F.floor(1_000_000 / F.greatest(steps - 0.5, F.lit(0.5))).cast("long")
    near = F.sequence(F.greatest(about - 3, distance), F.greatest(about + 3, distance))
    return F.when(steps > 0, F.array_max(F.filter(near, lambda x: _nearness(x) == _nearness(distance))))


def _stub_lexical(spark: SparkSession, d: str, k: int = K, filtered: bool = False) -> DataFrame:
    """A second ranking of the same passages: those of the query's family (that cover its version), nearest id first."""
    from pyspark.sql.window import Window

    keys, rows = ["family"], vectors(spark, d).select("vec_id", "family", "version_low", "version_high")
    if filtered:
        keys, rows = ["family", "version"], ranges.expanded(rows)
    met = retrieval.nearest(vector_queries(spark, d).select("query_id", *keys), rows, keys, "query_id", "vec_id", k, _alike)
    pairs = met.withColumn("score", _nearness(F.abs(F.col("query_id") - F.col("vec_id"))))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


@query(f"WITH {VQ}, {ALL}, {_LEX}, {_UNION} SELECT query_id, vec_id, score, stage, rank FROM un")
def hybrid_union(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.union(_dense(spark, d, False), _stub_lexical(spark, d), "query_id", "vec_id")


def _reranked_sql(name: str, hits: str, k: int | None = None) -> str:
    rows = f"SELECT query_id, vec_id, s AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS INTEGER) AS rank FROM (SELECT *, CAST((vec_id * 7919 + query_id) % 97 AS DOUBLE) AS s FROM {hits})"
    return f"{name} AS ({rows})" if k is None else f"{name} AS (SELECT * FROM ({rows}) WHERE rank <= {k})"


_RERANKED = _reranked_sql("rr", "un")


def _stub_scorer(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "vec_id", ((F.col("vec_id") * 7919 + F.col("query_id")) % 97).cast("double").alias("rerank_score"))


@query(f"WITH {VQ}, {ALL}, {_LEX}, {_UNION}, {_RERANKED} SELECT * FROM rr WHERE rank <= 10")
def rerank_replace(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.union(_dense(spark, d, False), _stub_lexical(spark, d), "query_id", "vec_id")
    return retrieval.reranked(hits, _stub_scorer(hits), "query_id", "vec_id", 10)


# Metrics: a query's positive is the first passage of its family that covers its version, if any.

_POS = """pos AS (SELECT q.query_id, CASE WHEN q.query_id % 100 = 0 THEN 'even' ELSE 'odd' END AS source, q.version,
(SELECT min(v.vec_id) FROM vec v WHERE v.family = q.family AND q.version BETWEEN v.version_low AND v.version_high) AS positive_id FROM vq q)"""
_JUDGED = "j{0} AS (SELECT p.*, h.rank, h.vec_id = p.positive_id AS m, coalesce(p.version BETWEEN v.version_low AND v.version_high, false) AS ok FROM pos p LEFT JOIN {0} h USING (query_id) LEFT JOIN vec v ON v.vec_id = h.vec_id WHERE p.positive_id IS NOT NULL)"
_PER = """per{0} AS (SELECT query_id, source, """ + ", ".join(f"max(CASE WHEN m AND rank <= {k} THEN CAST(1 AS DOUBLE) ELSE 0 END) AS recall_at_{k}" for k in metrics.CUTS) + """,
coalesce(CAST(1 AS DOUBLE) / min(CASE WHEN m AND rank <= 10 THEN rank END), 0) AS mrr_at_10, sum(CASE WHEN m AND rank <= 10 THEN 1 / log2(rank + CAST(1 AS DOUBLE)) ELSE 0 END) AS ndcg_at_10,
coalesce(avg(CASE WHEN rank <= 1 THEN CAST(ok AS DOUBLE) END), 0) AS version_correct_at_1, coalesce(avg(CASE WHEN rank <= 5 THEN CAST(ok AS DOUBLE) END), 0) AS version_correct_at_5 FROM j{0} GROUP BY query_id, source)"""
_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in metrics.NAMES)


def _metrics_sql(hits: str) -> str:
    return f"{_JUDGED.format(hits)}, {_PER.format(hits)}"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    q = vector_queries(spark, d).select("query_id", "family", "version", F.when(F.col("query_id") % 100 == 0, "even").otherwise("odd").alias("source"))
    first = ranges.expanded(vectors(spark, d).select("vec_id", "family", "version_low", "version_high")).groupBy("family", "version").agg(F.min("vec_id").alias("positive_id"))
    return q.join(first, ["family", "version"], "left").select(*q.columns, "positive_id")


def _judgeable(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    return hits.join(vectors(spark, d).select("vec_id", "version_low", "version_high"), "vec_id").withColumnRenamed("vec_id", "id")


def _evaluable(spark: SparkSession, d: str) -> DataFrame:
    return metrics.evaluable(_questions(spark, d), vectors(spark, d), "vec_id")


def _per_query(spark: SparkSession, d: str, filtered: bool) -> DataFrame:
    return metrics.per_query(_evaluable(spark, d), _judgeable(spark, d, _dense(spark, d, filtered)))


@query(f"WITH {VQ}, {_POS} SELECT count(*) AS questions, CAST(0 AS BIGINT) AS unanswerable, count(*) FILTER (positive_id IS NULL) AS without_positive FROM pos")
def skipped_questions(spark: SparkSession, d: str) -> DataFrame:
    return metrics.skipped(_questions(spark, d), vectors(spark, d), "vec_id")


def _one(names: list[str]) -> str:
    return f"WITH {VQ}, {FILTERED}, {_POS}, {_metrics_sql('fhits')} SELECT query_id, {', '.join(f'round({n}, 6) AS {n}' for n in names)} FROM perfhits"


@query(_one(["recall_at_1", "recall_at_5", "recall_at_10", "recall_at_20"]))
def hit_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _per_query(spark, d, True).select("query_id", *(F.round(f"recall_at_{k}", 6).alias(f"recall_at_{k}") for k in metrics.CUTS))


@query(_one(["mrr_at_10"]))
def mrr_at_10(spark: SparkSession, d: str) -> DataFrame:
    return _per_query(spark, d, True).select("query_id", F.round("mrr_at_10", 6).alias("mrr_at_10"))


@query(_one(["ndcg_at_10"]))
def ndcg_at_10(spark: SparkSession, d: str) -> DataFrame:
    return _per_query(spark, d, True).select("query_id", F.round("ndcg_at_10", 6).alias("ndcg_at_10"))


@query(f"WITH {VQ}, {ALL}, {_POS}, {_metrics_sql('hits')} SELECT query_id, round(version_correct_at_1, 6) AS version_correct_at_1, round(version_correct_at_5, 6) AS version_correct_at_5 FROM perhits")
def version_correct(spark: SparkSession, d: str) -> DataFrame:
    return _per_query(spark, d, False).select("query_id", *(F.round(m, 6).alias(m) for m in ("version_correct_at_1", "version_correct_at_5")))


@query(f"WITH {VQ}, {FILTERED}, {_POS}, {_metrics_sql('fhits')} SELECT coalesce(source, 'all') AS source, count(*) AS n, {_MEANS} FROM perfhits GROUP BY GROUPING SETS ((source), ())")
def metrics_by_source(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summarised(_per_query(spark, d, True))


# The ladder: family and id stand for BM25, the first eight numbers of a vector for a tuned encoder, a remainder for a reranker.

TUNED = 8
_DOT8 = _DOT.replace("q.embedding", f"q.embedding[1:{TUNED}]").replace("v.embedding", f"v.embedding[1:{TUNED}]")
_LADDER = {
    "bm25": [_lexical_sql("hits_bm25")],
    "dense": [_ranked("hits_dense", "true")],
    "dense_filtered": [_ranked("hits_dense_filtered", COVERS)],
    "tuned_filtered": [_ranked("t50", COVERS, 50, _DOT8), f"hits_tuned_filtered AS (SELECT * FROM t50 WHERE rank <= {K})"],
    "reranked": [_reranked_sql("hits_reranked", "t50", K)],
    "hybrid_reranked": [_lexical_sql("fl50", COVERS, 50), _union_sql("un50", "t50", "fl50"), _reranked_sql("hits_hybrid_reranked", "un50", K)],
}


def _runs_sql(names: list[str]) -> str:
    steps = ", ".join(x for n in names for x in _LADDER[n])
    per = ", ".join(_metrics_sql(f"hits_{n}") for n in names)
    runs = " UNION ALL ".join(f"SELECT '{n}' AS config, * FROM perhits_{n}" for n in names)
    return f"{VQ}, {steps}, {_POS}, {per}, runs AS ({runs}), sums AS (SELECT config, {_MEANS} FROM runs GROUP BY config), flat AS (UNPIVOT sums ON {', '.join(metrics.NAMES)} INTO NAME metric VALUE value)"


_RUNS, _TWO = _runs_sql(list(_LADDER)), _runs_sql(["dense", "dense_filtered"])


def _pipeline(spark: SparkSession, d: str, config: retrieval.Config) -> retrieval.Pipeline:
    dims, fell_back = retrieval.resolved_model(config.encoder, {"base": "", "tuned": str(TUNED)}, "")
    return retrieval.Pipeline(config, lambda k, f: _dense(spark, d, f, k, int(dims or 0) or None), lambda k, f: _stub_lexical(spark, d, k, f), _stub_scorer, [config.encoder] if fell_back else [])


def _runs(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    questions, out = _evaluable(spark, d), None
    for config in retrieval.selected(names):
        made = _pipeline(spark, d, config)
        per = metrics.per_query(questions, _judgeable(spark, d, made.hits(K)))
        rows = made.labelled(metrics.long(metrics.summarised(per).filter("source = 'all'"), config.name).select("config", "metric", "value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {_RUNS} SELECT config, metric, value, value >= max(value) OVER (PARTITION BY metric) - 1e-9 AS best FROM flat")
def ablation_table(spark: SparkSession, d: str) -> DataFrame:
    return metrics.best(_runs(spark, d, list(_LADDER)).drop("degraded"), ["metric"])


_EXPECTED = [("dense", "recall_at_10", 0.0), ("dense", "ndcg_at_10", 0.9), ("dense", "precision", 0.5), ("dense_filtered", "version_correct_at_1", 0.2), ("dense_filtered", "recall_at_20", 1.5), ("nowhere", "recall_at_10", 0.5), ("nowhere", "ndcg_at_10", 0.5)]
_VALUES = ", ".join(f"('{c}', '{m}', CAST({v} AS DOUBLE))" for c, m, v in _EXPECTED)


@query(f"""WITH {_TWO}, base(config, metric, expected) AS (VALUES {_VALUES}), r AS (SELECT b.*, f.value AS actual, EXISTS (SELECT 1 FROM flat g WHERE g.config = b.config) AS run FROM base b LEFT JOIN flat f USING (config, metric))
SELECT config, metric, expected, actual, CASE WHEN actual IS NULL THEN 'missing metric' ELSE 'regression' END AS reason FROM r WHERE run AND (actual IS NULL OR actual < expected - 0.01)
UNION ALL SELECT DISTINCT config, '*', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'missing config' FROM r WHERE NOT run""")
def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    return gate.regressions(literal(spark, _EXPECTED, "config string, metric string, value double"), _runs(spark, d, ["dense", "dense_filtered"]))


@query(f"WITH {_TWO}, m AS (SELECT max(CASE WHEN config = 'dense' THEN value END) AS incumbent, max(CASE WHEN config = 'dense_filtered' THEN value END) AS candidate FROM flat WHERE metric = 'ndcg_at_10') SELECT incumbent, candidate, candidate >= incumbent - 0.005 AS promote FROM m")
def migration_verdict(spark: SparkSession, d: str) -> DataFrame:
    return gate.migration(_runs(spark, d, ["dense", "dense_filtered"]), "dense", "dense_filtered")


_FHITS30 = _ranked("fhits30", COVERS, 30)
_MINED = "mined AS (SELECT * FROM (SELECT h.query_id, h.vec_id AS id, CAST(row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) AS INTEGER) AS place FROM fhits30 h JOIN vec v USING (vec_id) JOIN pos p USING (query_id) JOIN vec o ON o.vec_id = p.positive_id WHERE v.family <> o.family) WHERE place <= 8)"


def _families(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select(F.col("vec_id").alias("id"), "family")


def _mined(spark: SparkSession, d: str) -> DataFrame:
    hits = _dense(spark, d, True, datasets.MINED_FROM).withColumnRenamed("vec_id", "id")
    return datasets.mined(hits, _questions(spark, d).filter("positive_id is not null").select("query_id", "positive_id"), _families(spark, d))


@query(f"WITH {VQ}, {_FHITS30}, {_POS}, {_MINED} SELECT * FROM mined")
def mine_negatives(spark: SparkSession, d: str) -> DataFrame:
    return _mined(spark, d)


@query(f"WITH {VQ}, {_FHITS30}, {_POS}, {_MINED} SELECT count(*) AS negatives, count(*) FILTER (v.version_low = o.version_low) AS same_range, round(CAST(count(*) FILTER (v.version_low = o.version_low) AS DOUBLE) / count(*), 6) AS share FROM mined m JOIN vec v ON v.vec_id = m.id JOIN pos p USING (query_id) JOIN vec o ON o.vec_id = p.positive_id")
def mined_share(spark: SparkSession, d: str) -> DataFrame:
    low = vectors(spark, d).select("vec_id", "version_low")
    rows = _mined(spark, d).join(low.select(F.col("vec_id").alias("id"), F.col("version_low").alias("a")), "id").join(_questions(spark, d), "query_id")
    rows = rows.join(low.select(F.col("vec_id").alias("positive_id"), F.col("version_low").alias("b")), "positive_id")
    return rows.agg(F.count("*").alias("negatives"), F.count_if(F.col("a") == F.col("b")).alias("same_range")).withColumn("share", F.round(F.try_divide("same_range", "negatives"), 6))


_DRAW = "substr(sha256('{}|' || {}), 1, 16)"
_SPLIT = f"""fam AS (SELECT DISTINCT user_id AS family FROM events), ord AS (SELECT family, row_number() OVER (ORDER BY {_DRAW.format(datasets.SEED, 'family')}, family) AS r, count(*) OVER () AS n FROM fam),
split AS (SELECT family, CASE WHEN r <= floor(n * CAST(0.10 AS DOUBLE)) THEN 'dev' WHEN r <= floor(n * CAST(0.10 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM ord)"""


@query(f"WITH {_SPLIT} SELECT family, split FROM split")
def split_by_family(spark: SparkSession, d: str) -> DataFrame:
    return datasets.split_by_family(table(spark, d, "events").select(F.col("user_id").alias("family")), "family")


@query(f"WITH {_SPLIT}, ev AS (SELECT DISTINCT user_id AS family, event_type, s.split FROM events JOIN split s ON s.family = user_id), l AS (SELECT family, CASE WHEN event_type = 'error' AND family % 3 = 0 THEN 'test' ELSE split END AS split FROM ev) SELECT family, count(DISTINCT split) AS splits FROM l GROUP BY family HAVING count(DISTINCT split) > 1")
def leakage_check(spark: SparkSession, d: str) -> DataFrame:
    """Leaks are planted: of every third family, what has an error is moved to the test split."""
    split = datasets.split_by_family(table(spark, d, "events").select(F.col("user_id").alias("family")), "family")
    rows = table(spark, d, "events").select(F.col("user_id").alias("family"), "event_type").distinct().join(split, "family")
    moved = F.when((F.col("event_type") == "error") & (F.col("family") % 3 == 0), "test").otherwise(F.col("split"))
    return datasets.leaks(rows.withColumn("split", moved), "family")


_CHANGED = f"""{SNAP}, many AS (SELECT *, count(*) OVER (PARTITION BY family) AS n FROM snap), few AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {_DRAW.format(datasets.SEED, 'chunk_id')}, chunk_id) AS k FROM many WHERE n > 1),
ch AS (SELECT chunk_id, family, CAST(version_low + CAST('0x' || substr({_DRAW.format(datasets.SEED + 1, 'chunk_id')}, 1, 8) AS BIGINT) % (version_high - version_low + 1) AS INTEGER) AS version FROM few WHERE k <= 3)"""


@query(f"WITH {_CHANGED} SELECT * FROM ch")
def changed_sections(spark: SparkSession, d: str) -> DataFrame:
    return datasets.changed_sections(snapshots(spark, d))


@query(f"WITH {_CHANGED} SELECT * FROM (SELECT c.chunk_id, c.version, s.chunk_id AS negative, CAST(row_number() OVER (PARTITION BY c.chunk_id, c.version ORDER BY s.version_low, s.chunk_id) AS INTEGER) AS place FROM ch c JOIN snap s ON s.family = c.family AND s.chunk_id <> c.chunk_id AND NOT (c.version BETWEEN s.version_low AND s.version_high)) WHERE place <= 6")
def changed_section_negatives(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    return datasets.family_negatives(datasets.changed_sections(s), s)


def _pick_sql(templates: tuple[str, ...], key: str) -> str:
    listed = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in templates) + "]"
    return f"{listed}[CAST('0x' || substr(sha256({key}), 1, 8) AS BIGINT) % {len(templates)} + 1]"


_OPEN = [(1, "How does {version} schedule by moonlight?"), (2, "Which flag of {version} turns time back?"), (3, "How does {version} schedule by moonlight? ")]
_OPEN_SQL = ", ".join(f"({i}, '{t}')" for i, t in _OPEN)
_EXAMPLES = f"""{_CHANGED}, neg AS (SELECT chunk_id, version, string_agg(negative, ',' ORDER BY place) AS negatives FROM (SELECT c.chunk_id, c.version, s.chunk_id AS negative, row_number() OVER (PARTITION BY c.chunk_id, c.version ORDER BY s.version_low, s.chunk_id) AS place FROM ch c JOIN snap s ON s.family = c.family AND s.chunk_id <> c.chunk_id AND NOT (c.version BETWEEN s.version_low AND s.version_high)) WHERE place <= 6 GROUP BY 1, 2),
ex AS (SELECT 0 AS part, replace(replace({_pick_sql(examples.SECTION, f"chunk_id || chr(31) || '{datasets.SEED}'")}, '{{topic}}', 'user ' || family), '{{version}}', '1.' || version) AS question, version, chunk_id AS positive_id, negatives, 'changed-section' AS source FROM ch JOIN neg USING (chunk_id, version)
UNION ALL SELECT 1, question, version, '', '', 'unanswerable' FROM (SELECT template_id, version, replace(template, '{{version}}', '1.' || version) AS question FROM (VALUES {_OPEN_SQL}) t(template_id, template), (SELECT CAST(unnest(generate_series(24, 33)) AS INTEGER) AS version) ORDER BY substr(sha256('{datasets.SEED}|' || template_id || '|' || version), 1, 16), 1, 2 LIMIT 25)),
one AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(question)) ORDER BY part, positive_id, version, question) AS n FROM ex)"""


def _examples(spark: SparkSession, d: str) -> list[DataFrame]:
    passages = snapshots(spark, d).withColumn("topic", F.concat(F.lit("user "), F.col("family").cast("string")))
    versions = spark.range(24, 34).select(F.col("id").cast("int").alias("version"))
    return [examples.changed(passages), examples.unanswerable(literal(spark, _OPEN, "template_id int, template string"), versions, 25)]


@query(f"WITH {_EXAMPLES} SELECT question, version, positive_id, negatives, source FROM one WHERE n = 1")
def assemble_examples(spark: SparkSession, d: str) -> DataFrame:
    rows = examples.assembled(_examples(spark, d))
    return rows.select("question", "version", "positive_id", F.array_join("negatives", ",").alias("negatives"), "source")


@query(f"WITH {_EXAMPLES} SELECT source, count(*) AS examples FROM ex GROUP BY source")
def example_stats(spark: SparkSession, d: str) -> DataFrame:
    return examples.build_stats(_examples(spark, d))


_SPECS = [(1, "q1", 2, "src1", "the", False), (2, "q2", 4, None, "de la", False), (3, "q3", 5, "src", "", False), (4, "q4", 3, "nowhere", "", False), (5, "q5", 3, None, None, True)]
_SPECS_SQL = "s(spec_id, question, want_version, want_doc, want_text, unanswerable) AS (VALUES (1, 'q1', 2, 'src1', 'the', false), (2, 'q2', 4, '', 'de la', false), (3, 'q3', 5, 'src', '', false), (4, 'q4', 3, 'nowhere', '', false), (5, 'q5', 3, '', '', true)), d AS (SELECT doc_id, text, source, doc_id % 50 AS family, doc_id % 6 AS lo FROM documents)"
_BOUND_SQL = "bound AS (SELECT * FROM (SELECT s.*, doc_id, family, row_number() OVER (PARTITION BY spec_id ORDER BY length(text), doc_id) AS n FROM s JOIN d ON NOT unanswerable AND want_version BETWEEN lo AND lo + 2 AND contains(source, want_doc) AND contains(text, want_text)) WHERE n = 1)"


def _gold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    low = F.col("doc_id") % 6
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_path"), "text", (F.col("doc_id") % 50).alias("family"), low.alias("version_low"), (low + 2).alias("version_high"))
    return literal(spark, _SPECS, "spec_id int, question string, want_version int, want_doc string, want_text string, unanswerable boolean"), docs


@query(f"""WITH {_SPECS_SQL}, {_BOUND_SQL}, neg AS (SELECT spec_id, id, 0 AS kind, row_number() OVER (PARTITION BY spec_id ORDER BY id) AS place FROM (SELECT b.spec_id, d.doc_id AS id FROM bound b JOIN d ON d.family = b.family AND d.doc_id <> b.doc_id AND NOT (want_version BETWEEN lo AND lo + 2))
UNION ALL SELECT * FROM (SELECT spec_id, id, 1 AS kind, row_number() OVER (PARTITION BY spec_id ORDER BY id) AS place FROM (SELECT b.spec_id, d.doc_id AS id FROM bound b JOIN d ON want_doc <> '' AND contains(d.source, want_doc) AND d.family <> b.family)) WHERE place <= 6),
few AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY kind, place) AS n FROM neg), lists AS (SELECT spec_id, string_agg(id, ',' ORDER BY n) AS negatives FROM few WHERE n <= 8 GROUP BY spec_id)
SELECT question, want_version AS version, doc_id AS positive_id, coalesce(negatives, '') AS negatives, 'gold' AS source FROM bound LEFT JOIN lists USING (spec_id) UNION ALL SELECT question, want_version, NULL, '', 'gold-unanswerable' FROM s WHERE unanswerable""")
def gold_resolve(spark: SparkSession, d: str) -> DataFrame:
    return examples.gold(*_gold(spark, d)).select("question", "version", "positive_id", F.array_join(F.col("negatives").cast("array<string>"), ",").alias("negatives"), "source")


@query(f"WITH {_SPECS_SQL}, {_BOUND_SQL} SELECT spec_id, 'nothing covers 1.' || want_version || ' with doc ' || chr(39) || want_doc || chr(39) || ' and text ' || chr(39) || want_text || chr(39) AS problem FROM s WHERE NOT unanswerable AND spec_id NOT IN (SELECT spec_id FROM bound)")
def gold_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return examples.unresolved(*_gold(spark, d))


@query("""WITH s(spec_id, want_version, want_doc, want_text) AS (VALUES (1, 2, 'src1', 'the'), (2, 4, '', 'de la'), (3, 5, 'src', ''), (4, 3, 'nowhere', '')), d AS (SELECT doc_id, text, source, lang, doc_id % 6 AS lo FROM documents)
SELECT spec_id, doc_id AS chunk_id, lang AS family FROM (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY length(text), doc_id) AS n FROM s JOIN d ON want_version BETWEEN lo AND lo + 2 AND contains(source, want_doc) AND contains(text, want_text)) WHERE n = 1""")
def gold_binding(spark: SparkSession, d: str) -> DataFrame:
    specs = literal(spark, [(1, 2, "src1", "the"), (2, 4, None, "de la"), (3, 5, "src", ""), (4, 3, "nowhere", "")], "spec_id int, want_version int, want_doc string, want_text string")
    low = F.col("doc_id") % 6
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_path"), "text", F.col("lang").alias("family"), low.alias("version_low"), (low + 2).alias("version_high"))
    return datasets.bound_gold(specs, docs)


_LABEL = "'v' || vec_id || ' of ' || family"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select(F.col("vec_id").alias("id"), F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(" of "), F.col("family").cast("string")).alias("text"))


@query(f"WITH {VQ}, {_FHITS30}, {_POS}, {_MINED}, txt AS (SELECT vec_id, {_LABEL} AS t FROM vec) SELECT m.query_id, a.t AS positive_text, b.t AS negative_text FROM mined m JOIN pos p USING (query_id) JOIN txt a ON a.vec_id = p.positive_id JOIN txt b ON b.vec_id = m.id")
def training_triplets(spark: SparkSession, d: str) -> DataFrame:
    return datasets.triplets(_questions(spark, d).select("query_id", "positive_id"), _mined(spark, d), _texts(spark, d))


@query(f"WITH {VQ}, {_FHITS30}, {_POS}, {_MINED} SELECT positive_id AS id FROM pos WHERE positive_id IS NOT NULL UNION SELECT id FROM mined")
def evaluation_documents(spark: SparkSession, d: str) -> DataFrame:
    return datasets.evaluation_documents(_questions(spark, d).filter("positive_id is not null"), _mined(spark, d))


_D = datasets.SEED


def _far(i: int) -> str:
    return f"CAST('0x' || substr({_DRAW.format(_D + 2 + i, 'query_id')}, 1, 15) AS BIGINT)"


_PLACES = " UNION ALL ".join(f"SELECT query_id, st, size, {i} AS i, rest * {i} // 2 AS lo, rest * {i + 1} // 2 AS hi, {_far(i)} AS far FROM own" for i in range(2))
_RANDOM = f"""fams AS (SELECT family, count(*) AS size, substr({_DRAW.format(_D, 'family')}, 1, 3) AS b FROM vec GROUP BY family), starts AS (SELECT family, size, CAST(sum(size) OVER (ORDER BY b, family) - size AS BIGINT) AS st FROM fams),
numbered AS (SELECT vec_id AS id, s.st + row_number() OVER (PARTITION BY family ORDER BY {_DRAW.format(_D + 1, 'vec_id')}, vec_id) - 1 AS spot FROM vec JOIN starts s USING (family)),
own AS (SELECT query_id, st, size, (SELECT count(*) FROM vec) - size AS rest FROM vq JOIN starts USING (family)), parts AS ({_PLACES}),
drawn AS (SELECT query_id, i, lo + far % (hi - lo) + CASE WHEN lo + far % (hi - lo) >= st THEN size ELSE 0 END AS spot FROM parts WHERE hi > lo),
rnd AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i) AS INTEGER) AS place FROM drawn JOIN numbered USING (spot))"""


@query(f"WITH {VQ}, {_RANDOM} SELECT * FROM rnd")
def random_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Hash-drawn passages of other families."""
    return datasets.random_negatives(vector_queries(spark, d).select("query_id", "family"), _families(spark, d))


_FAMNEG = f"""fneg AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_DRAW.format(_D + 9, "query_id || '|' || id")}, id) AS INTEGER) AS place FROM (
SELECT p.query_id, v.vec_id AS id, row_number() OVER (PARTITION BY p.query_id ORDER BY v.version_low, v.vec_id) AS place FROM pos p JOIN vec o ON o.vec_id = p.positive_id JOIN vec v ON v.family = o.family AND v.vec_id <> o.vec_id AND NOT (p.version BETWEEN v.version_low AND v.version_high)) WHERE place <= 6)"""
_PAIRS = "prs AS (SELECT query_id, positive_id AS id, 1 AS label, 'positive' AS kind FROM pos WHERE positive_id IS NOT NULL UNION ALL SELECT query_id, id, 0, 'family' FROM fneg WHERE place <= 4 UNION ALL SELECT query_id, id, 0, 'retriever' FROM mined WHERE place <= 6 UNION ALL SELECT r.query_id, r.id, 0, 'random' FROM rnd r JOIN pos p USING (query_id) WHERE p.positive_id IS NOT NULL AND place <= 2)"
_ALL_PAIRS = f"{VQ}, {_FHITS30}, {_POS}, {_MINED}, {_FAMNEG}, {_RANDOM}, {_PAIRS}"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    q = _evaluable(spark, d)
    v = vectors(spark, d).withColumnRenamed("vec_id", "chunk_id")
    asks = q.select(F.col("positive_id").alias("chunk_id"), "family", "version").distinct()
    own = datasets.family_negatives(asks, v).join(q.select("query_id", F.col("positive_id").alias("chunk_id"), "version"), ["chunk_id", "version"])
    family = datasets.shuffled(own.select("query_id", F.col("negative").alias("id")))
    return datasets.pairs(q, family, _mined(spark, d), random=datasets.random_negatives(q.select("query_id", "family"), _families(spark, d)))


@query(f"WITH {_ALL_PAIRS} SELECT * FROM prs")
def training_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


@query(f"WITH {_ALL_PAIRS}, c AS (SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM prs) SELECT *, greatest(CAST(1 AS DOUBLE), CAST(negatives AS DOUBLE) / positives) AS pos_weight FROM c")
def pair_weights(spark: SparkSession, d: str) -> DataFrame:
    return datasets.pair_weights(_pairs(spark, d))


@query(f"WITH {VQ}, {FILTERED}, b AS (SELECT q.query_id, max(score) AS best FROM vq q LEFT JOIN fhits h USING (query_id) GROUP BY 1) SELECT query_id, best, CASE WHEN best IS NULL THEN 'no_results' WHEN best < 0.9999 THEN 'low_confidence' ELSE 'answered' END AS decision FROM b")
def refusal_decision(spark: SparkSession, d: str) -> DataFrame:
    return answer.decision(vector_queries(spark, d), _dense(spark, d, True), "query_id", 0.9999)


@query(f"WITH {VQ}, {FILTERED} SELECT query_id, string_agg('[' || rank || '] ' || family || chr(10) || 'passage ' || vec_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM fhits JOIN vec USING (vec_id) WHERE rank <= 5 GROUP BY query_id")
def context_block(spark: SparkSession, d: str) -> DataFrame:
    hits = _dense(spark, d, True, 5).join(vectors(spark, d).select("vec_id", "family"), "vec_id")
    return answer.context(hits, "query_id", F.col("family").cast("string"), F.concat(F.lit("passage "), F.col("vec_id").cast("string")))


@query(f"WITH {VEC} SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm FROM vec")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return v.select(F.col("vec_id").alias("id"), F.round(F.sqrt(dense.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"))


@query(f"WITH {VQ}, {FILTERED}, {_lexical_sql('fl', COVERS)}, {_union_sql('un', 'fhits', 'fl')}, {_RERANKED} SELECT query_id, vec_id, score, rank, 'rerank' AS stage FROM rr WHERE rank <= 20")
def pipeline_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The last row of the ladder with stand-ins for learned parts."""
    config = retrieval.Config("hybrid_reranked", (("dense", K), ("lexical", K), ("rerank", retrieval.SHOWN)), True)
    return _pipeline(spark, d, config).hits()
