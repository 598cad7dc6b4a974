"""Queries on versions, ranges, corpus statistics and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions import versions as vs
from ..operators import corpus, ranges
from ..sources import files
from .catalog import OBS, OBS1, SNAP, VEC, observations, query, settled, snapshots, table, vectors


@query(f"WITH {VEC} SELECT vec_id, family, version_low, version_high FROM vec WHERE version_low <= 7 AND 7 <= version_high")
def version_covers_filter(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).filter(vs.covers(F.col("version_low"), F.col("version_high"), F.lit(7))).select("vec_id", "family", "version_low", "version_high")


@query(f"WITH {SNAP} SELECT a.chunk_id AS a_chunk_id, b.chunk_id AS b_chunk_id FROM snap a JOIN snap b ON a.family = b.family AND a.chunk_id <> b.chunk_id AND a.version_low <= b.version_high + 1 AND b.version_low <= a.version_high + 1")
def range_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of a family that touch or overlap: each is drawn out by a version at its end."""
    s = snapshots(spark, d)
    longer = s.withColumn("version_high", F.col("version_high") + 1)
    return ranges.overlap_join(longer, longer, "chunk_id", ["family"]).filter("a_chunk_id <> b_chunk_id")


@query("SELECT event_type AS endpoint, user_id % 3 AS status, bound, count(*) FILTER (bound IS NULL OR (event_id % 1000) / 100.0 <= bound) AS requests FROM events, (SELECT unnest([0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, NULL])::DOUBLE AS bound) GROUP BY 1, 2, 3")
def request_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("endpoint"), (F.col("user_id") % 3).alias("status"), ((F.col("event_id") % 1000) / 100.0).alias("seconds"))
    return files.request_histogram(rows)


@query("SELECT doc_id, round(n_chars / 7.0, 4) AS score, substr(text, 1, 240) AS text FROM documents")
def hit_preview(spark: SparkSession, d: str) -> DataFrame:
    return files.previewed(table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 7.0).alias("score"), "text"))


@query(f"WITH {OBS}, g AS (SELECT *, version - row_number() OVER (PARTITION BY family, content ORDER BY version) AS g FROM obs) SELECT family, content, min(version) AS version_low, max(version) AS version_high FROM g GROUP BY family, content, g")
def version_islands(spark: SparkSession, d: str) -> DataFrame:
    return ranges.islands(observations(spark, d), ["family", "content"])


@query(f"WITH {OBS1}, p AS (SELECT family, content, version, 'day ' || version AS seen, version - row_number() OVER (PARTITION BY family, content ORDER BY version) AS g FROM obs1) SELECT family, content, min(version) AS version_low, max(version) AS version_high, arg_min(seen, version) AS seen FROM p GROUP BY family, content, g")
def coalesce_observations(spark: SparkSession, d: str) -> DataFrame:
    seen = settled(spark, d).withColumn("seen", F.concat(F.lit("day "), F.col("version").cast("string")))
    return ranges.coalesced(seen, ["family", "content"], ["seen"])


@query(f"""WITH {OBS}, g AS (SELECT *, version - row_number() OVER (PARTITION BY family, content ORDER BY version) AS g FROM obs),
r AS (SELECT family, content, min(version) AS lo, max(version) AS hi FROM g GROUP BY family, content, g),
l AS (SELECT family, CASE WHEN lag(hi) OVER (PARTITION BY family ORDER BY lo, hi) >= lo THEN 1 ELSE 0 END AS late FROM r)
SELECT family, CAST(sum(late) AS BIGINT) AS overlaps FROM l GROUP BY family""")
def range_overlap_count(spark: SparkSession, d: str) -> DataFrame:
    return ranges.overlap_count(ranges.islands(observations(spark, d), ["family", "content"]), "family")


@query(f"WITH {SNAP} SELECT family, string_agg(chunk_id, ',' ORDER BY version_low, chunk_id) AS members FROM snap GROUP BY family")
def family_members(spark: SparkSession, d: str) -> DataFrame:
    return corpus.members(snapshots(spark, d), "family", "chunk_id")


@query(f"WITH {SNAP}, p AS (SELECT DISTINCT user_id AS family, CAST(day(ts) AS INTEGER) AS version FROM events) SELECT p.family, p.version, s.chunk_id FROM p JOIN snap s ON s.family = p.family AND p.version BETWEEN s.version_low AND s.version_high")
def covering_lookup(spark: SparkSession, d: str) -> DataFrame:
    return ranges.covering(observations(spark, d).select("family", "version").distinct(), snapshots(spark, d), "family").select("family", "version", "chunk_id")


@query(f"WITH {SNAP} SELECT a.chunk_id, a.version_low AS version, b.chunk_id AS other FROM snap a JOIN snap b ON a.family = b.family AND a.chunk_id <> b.chunk_id AND NOT (a.version_low BETWEEN b.version_low AND b.version_high)")
def same_family_negatives(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    return ranges.same_family_outside(s.withColumn("version", F.col("version_low")), s, "family", "chunk_id")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM events")
def asof_release(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("mark", F.col("event_type") == "signup")
    return ranges.as_of(e, ["user_id"], ["ts", "event_id"], "mark", "event_id", "since").select("event_id", "since")


@query(f"WITH {SNAP}, {OBS.replace('obs AS', 'o AS')} SELECT o.family, o.version, o.content AS seen, s.chunk_id FROM o JOIN snap s ON o.family = s.family AND s.version_low <= o.version AND o.version <= s.version_high")
def range_expand_join(spark: SparkSession, d: str) -> DataFrame:
    points = observations(spark, d).withColumnRenamed("content", "seen")
    return ranges.range_join(points, snapshots(spark, d), ["family"]).select("family", "version", "seen", "chunk_id")


@query("""SELECT doc_id, substr(sha256(source || chr(31) || lang || ' > ' || source || chr(31) || '0'), 1, 16) AS family_id, substr(sha256(text), 1, 16) AS content_hash,
substr(sha256(substr(sha256(source || chr(31) || lang || ' > ' || source || chr(31) || '0'), 1, 16) || chr(31) || substr(sha256(text), 1, 16) || chr(31) || '1.' || (doc_id % 12)), 1, 16) AS chunk_id FROM documents""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumns({"family_id": fn.family_id(F.col("source"), F.array("lang", "source"), F.lit(0)), "content_hash": fn.content_hash(F.col("text"))})
    low = F.concat(F.lit("1."), (F.col("doc_id") % 12).cast("string"))
    return rows.select("doc_id", "family_id", "content_hash", fn.chunk_id(F.col("family_id"), F.col("content_hash"), low).alias("chunk_id"))


@query("SELECT doc_id, CAST(CAST(('0x' || substr(sha256(text), 1, 16)) AS UBIGINT) % 9223372036854775808 AS DECIMAL(20,0)) AS point_id FROM documents")
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fn.point_id(fn.content_hash(F.col("text"))).cast("decimal(20,0)").alias("point_id"))


@query("SELECT doc_id, 'Version 1.' || (doc_id % 12) || chr(10) || CASE WHEN doc_id % 3 > 0 THEN lang || ' > ' || source ELSE source END || chr(10) || chr(10) || text AS passage FROM documents")
def passage_text(spark: SparkSession, d: str) -> DataFrame:
    crumbs = F.when(F.col("doc_id") % 3 > 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    name = fn.title(crumbs, F.concat(F.lit("docs/"), F.col("source"), F.lit(".md")))
    return table(spark, d, "documents").select("doc_id", fn.passage(F.concat(F.lit("1."), (F.col("doc_id") % 12).cast("string")), crumbs, name, F.col("text")).alias("passage"))


@query(f"WITH {SNAP} SELECT chunk_id, CASE WHEN version_low = version_high THEN CAST(version_low AS VARCHAR) ELSE version_low || '-' || version_high END AS label, 'https://docs.example.org/release-1.' || version_high || '/' || content AS citation, version_low + 1 AS following, least(greatest(version_high, 5), 25) AS clamped FROM snap")
def version_label(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    return s.select(
        "chunk_id",
        vs.range_label(F.col("version_low"), F.col("version_high")).alias("label"),
        fn.citation(F.col("content"), vs.branch(F.lit(1), F.col("version_high"))).alias("citation"),
        vs.following(F.col("version_low")).alias("following"),
        vs.clamp(F.col("version_high"), F.lit(5), F.lit(25)).alias("clamped"),
    )


@query(r"""WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' v1.' || doc_id % 40 || ' ' WHEN 1 THEN '1.' || doc_id % 40 || '.7' WHEN 2 THEN '1.' || doc_id % 40 WHEN 3 THEN lang ELSE '' END AS raw FROM documents)
SELECT doc_id, TRY_CAST(regexp_extract(trim(raw), '^v?(\d+)\.(\d+)(?:\.\d+)?$', 1) AS INTEGER) AS major, TRY_CAST(regexp_extract(trim(raw), '^v?(\d+)\.(\d+)(?:\.\d+)?$', 2) AS INTEGER) AS minor FROM p""")
def version_parse(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("doc_id") % 5, (F.col("doc_id") % 40).cast("string")
    raw = F.when(k == 0, F.concat(F.lit(" v1."), n, F.lit(" "))).when(k == 1, F.concat(F.lit("1."), n, F.lit(".7"))).when(k == 2, F.concat(F.lit("1."), n)).when(k == 3, F.col("lang")).otherwise("")
    v = vs.try_parse(raw)
    return table(spark, d, "documents").select("doc_id", v["major"].alias("major"), v["minor"].alias("minor"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
'<!--.*?-->', '', 'gs'), '\{\{[<%]\s*/?\s*.*?\s*[>%]\}\}', '', 'gs'), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') AS body FROM pages""")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", fn.normalized(F.col("html")).alias("body"))


@query("""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[./-][a-z0-9]+)*')) AS t FROM documents),
b AS (SELECT t, count(*) AS n FROM t GROUP BY t), p AS (SELECT unnest(string_split_regex(t, '[./-]')) AS t, n FROM b WHERE length(t) > 3 AND regexp_matches(t, '[./-]')),
u AS (SELECT t, n FROM b UNION ALL SELECT t, n FROM p WHERE length(t) > 2) SELECT t AS term, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY t""")
def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(fn.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || ' — ' || source WHEN 1 THEN lang WHEN 2 THEN 'Overview' ELSE 'this topic' END AS topic FROM documents")
def topic_phrase(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    none = F.array().cast("array<string>")
    path = F.when(k == 0, F.array(F.lit("Guide"), F.col("lang"), F.col("source"))).when(k == 1, F.array(F.col("lang"), F.lit("Overview"))).when(k == 2, F.array(F.lit("Overview"))).otherwise(none)
    return table(spark, d, "documents").select("doc_id", fn.topic(path).alias("topic"))


@query("SELECT doc_id, 'chunks__' || trim(regexp_replace(lower('Org/' || source || '-' || lang || '.v2!'), '[^a-z0-9]+', '_', 'g'), '_') || '__v' || (doc_id % 3) AS name FROM documents")
def slug_name(spark: SparkSession, d: str) -> DataFrame:
    model = F.concat(F.lit("Org/"), F.col("source"), F.lit("-"), F.col("lang"), F.lit(".v2!"))
    return table(spark, d, "documents").select("doc_id", fn.slug(model, F.col("doc_id") % 3).alias("name"))


@query(f"WITH {SNAP}, f AS (SELECT family, count(*) AS n FROM snap GROUP BY family) SELECT CAST(sum(n) AS BIGINT) AS chunks, count(*) AS families, CAST(count(*) FILTER (n > 1) AS BIGINT) AS changed_families, (SELECT count(DISTINCT content) FROM snap) AS docs, round(CAST(count(*) FILTER (n > 1) AS DOUBLE) / count(*), 6) AS changed_share FROM f")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.stats(snapshots(spark, d), "family", "content")


@query("WITH l AS (SELECT list_sort(list(length(text))) AS x, count(*) AS n FROM documents) SELECT CAST(x[n // 2 + 1] AS INTEGER) AS p50, CAST(x[CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT) + 1] AS INTEGER) AS p90, CAST(x[n] AS INTEGER) AS most FROM l")
def length_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return corpus.positional(table(spark, d, "documents").select(F.length("text").alias("n_text")), "n_text")


@query(f"WITH {SNAP} SELECT version_high - version_low + 1 AS span, count(*) AS n FROM snap GROUP BY 1")
def span_histogram(spark: SparkSession, d: str) -> DataFrame:
    return corpus.span_histogram(snapshots(spark, d))


@query(f"WITH {SNAP} SELECT (SELECT count(*) FROM obs1) AS observations, (SELECT count(*) FROM snap) AS chunks, (SELECT count(*) FROM (SELECT family FROM snap GROUP BY family HAVING count(*) > 1)) AS changed_families, round((SELECT count(*) FROM obs1) / CAST((SELECT count(*) FROM snap) AS DOUBLE), 6) AS ratio")
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    return corpus.ingest_summary(settled(spark, d), snapshots(spark, d), "family")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return corpus.first_wins(table(spark, d, "documents"), F.sha2(F.lower(F.trim("text")), 256), ["doc_id"]).select("doc_id", "lang")


@query("SELECT doc_id, 'new' AS origin, quality AS value FROM labels UNION ALL SELECT doc_id, 'old', CAST(n_chars AS INTEGER) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "documents").select("doc_id", F.lit("old").alias("origin"), F.col("n_chars").cast("int").alias("value"))
    new = table(spark, d, "labels").select("doc_id", F.lit("new").alias("origin"), F.col("quality").cast("int").alias("value"))
    return corpus.upserted(old, new, "doc_id")


@query("""WITH h AS (SELECT sha256(CAST(vec_id AS VARCHAR)) AS h FROM embeddings), s AS (SELECT count(*) AS n, sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) AS d0, sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT)) AS d1, sum(CAST('0x' || substr(h, 31, 15) AS HUGEINT)) AS d2, sum(CAST('0x' || substr(h, 46, 15) AS HUGEINT)) AS d3 FROM h)
SELECT n, sha256(d0 || '-' || d1 || '-' || d2 || '-' || d3) AS digest FROM s""")
def cache_digest(spark: SparkSession, d: str) -> DataFrame:
    return corpus.digest(table(spark, d, "embeddings"), "vec_id")


@query(f"WITH {OBS}, r AS (SELECT unnest(generate_series(1, 35)) AS v) SELECT CAST(v AS INTEGER) AS version FROM r WHERE v NOT IN (SELECT version FROM obs)")
def versions_missing(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.range(1, 36).select(F.col("id").cast("int").alias("version"))
    return corpus.missing(asked, observations(spark, d).select("version").distinct(), "version")
