"""Queries on small literal inputs: state machines and patterns that SQL can't express, held to rows written out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions import versions as vs
from ..operators import answer, chunking, corpus, datasets, facts, metrics, resolve
from ..operators.ranges import coalesced
from .catalog import literal, query


def _values(columns: str, rows: list[tuple]) -> str:
    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + str(v).replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    names, types = zip(*(c.split() for c in columns.split(", ")))
    body = ", ".join("(" + ", ".join(f"CAST({one(v)} AS {t})" for v, t in zip(r, types)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) v({', '.join(names)})"


_PROSE = [(1, "Moving from 1.24 to v1.31.2, then 1.24 again."), (2, "Chart 2.5 and tool 3.11 only."), (3, "Build 11.245.3 and 1.999 are no versions; 1.7 is."), (4, ""), (5, None)]


@query(_values("id INTEGER, minors VARCHAR", [(1, "24,31"), (2, ""), (3, "7"), (4, ""), (5, None)]))
def extract_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = literal(spark, _PROSE, "id int, body string")
    return rows.select("id", F.array_join(vs.mentioned(F.col("body")), ",").alias("minors"))


_GUIDE = """# Guide
#### Orphan
The **x/v1** API version of Orphan is no longer served as of v1.9.
### v1.32
#### Flow things {#flow-v132}
The **flow.example/v1beta3** API version of FlowSchema and `LevelConfig` is no longer
served as of v1.32.
* Migrate to use the **flow.example/v1** API version, available since v1.29.
#### Unclear
Nothing is stated here.
### v1.25
#### PodPolicy
PodPolicy in the **policy/v1beta1** API version is no longer served as of v1.25.
#### Again
PodPolicy in the **policy/v1beta1** API version is no longer served as of v1.25.
#### Moved
Alpha, Beta and Gamma in the **old.example/v2** API version are no longer served as of v1.26. Use the **new.example/v1** API version, available since v1.22."""


def _guides(spark: SparkSession) -> DataFrame:
    return literal(spark, [("guide.md", 31, "### v1.31\n#### Old\nold"), ("guide.md", 35, _GUIDE)], "doc_path string, version int, markdown string")


@query(_values("removed_in VARCHAR, heading VARCHAR, api VARCHAR, resources VARCHAR, replacement VARCHAR, replacement_since VARCHAR", [("1.32", "Flow things", "flow.example/v1beta3", "FlowSchema,LevelConfig", "flow.example/v1", "1.29"), ("1.25", "PodPolicy", "policy/v1beta1", "PodPolicy", None, None), ("1.26", "Moved", "old.example/v2", "Alpha,Beta,Gamma", "new.example/v1", "1.22")]))
def parse_guide(spark: SparkSession, d: str) -> DataFrame:
    out = facts.facts(facts.newest(_guides(spark)))
    return out.select("removed_in", "heading", "api", F.array_join("resources", ",").alias("resources"), "replacement", "replacement_since")


@query("SELECT CAST(5 AS BIGINT) AS blocks, CAST(3 AS BIGINT) AS facts, CAST(0.6 AS DOUBLE) AS coverage")
def parse_coverage(spark: SparkSession, d: str) -> DataFrame:
    return facts.coverage(facts.newest(_guides(spark)))


@query(_values("heading VARCHAR, skipped VARCHAR", [("Unclear", "no removal sentence")]))
def parse_skipped(spark: SparkSession, d: str) -> DataFrame:
    return facts.parsed(facts.newest(_guides(spark))).filter("skipped is not null").select("heading", "skipped")


_FACTS = [("flow.example/v1beta3", 32, 1), ("policy/v1beta1", 25, 2), ("Policy/V1beta1", 27, 3), ("gone.example/v1", 20, 4)]
_QUERIES = [
    (1, "Does our cluster on v1.28 still serve this?"),
    (2, "We are running 1.26.3 in production"),
    (3, "Still using policy/v1beta1 here"),
    (4, "flow.example/v1beta3 next to POLICY/v1beta1"),
    (5, "Anything about gone.example/v1"),
    (6, "What is a node?"),
    (7, "upgrading to 1.99 soon"),
    (8, "chart version 2.5 or so"),
    (9, "the 1.31 docs"),
    (10, ""),
]


@query(_values("query_id INTEGER, version INTEGER, source VARCHAR, evidence VARCHAR", [(1, 28, "explicit", "1.28"), (2, 26, "explicit", "1.26"), (3, 24, "inferred", "policy/v1beta1"), (4, 24, "inferred", "policy/v1beta1"), (5, 35, "defaulted", ""), (6, 35, "defaulted", ""), (7, 35, "explicit", "1.99"), (8, 35, "defaulted", ""), (9, 31, "explicit", "1.31"), (10, 35, "defaulted", "")]))
def resolve_version(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolved(literal(spark, _QUERIES, "query_id int, query string"), literal(spark, _FACTS, "api string, removed int, seq int"), 24, 35)


@query(_values("query_id INTEGER, bound INTEGER, api VARCHAR", [(3, 24, "policy/v1beta1"), (4, 24, "policy/v1beta1")]))
def infer_version(spark: SparkSession, d: str) -> DataFrame:
    return resolve.inferred(literal(spark, _QUERIES, "query_id int, query string"), literal(spark, _FACTS, "api string, removed int, seq int"), 24, "query_id", "query")


@query(_values("id INTEGER, sentence VARCHAR", [(1, "For version 1.28."), (2, "For version 1.24, inferred from policy/v1beta1."), (3, "For version 1.35, the newest indexed, as none was given.")]))
def disclosure_sentence(spark: SparkSession, d: str) -> DataFrame:
    rows = literal(spark, [(1, "explicit", "1.28", "1.28"), (2, "inferred", "1.24", "policy/v1beta1"), (3, "defaulted", "1.35", "")], "id int, source string, version string, evidence string")
    return rows.select("id", fn.disclosure(F.col("source"), F.col("version"), F.col("evidence")).alias("sentence"))


_FENCE = "```"
_MARKDOWN = f"""---
title: "Storage"
---
Opening words of the page that are long enough to be kept as a passage.

# Volumes {{{{< note >}}}}
Text on volumes that is long enough to be kept, with <!-- a hidden
remark --> nothing hidden.

### Deep part
{_FENCE}bash
# not a heading
{_FENCE}
Words after the fence that make the section long enough to keep.
## Next {{#next-v1}}
tiny
## Deep part
Another section that has words enough to be kept in the collection.
## Deep part
Another section that has words enough to be kept in the collection twice."""
_LONG = "\n\n".join(f"Paragraph {i} " + "word " * 12 for i in range(6)) + f"\n\n{_FENCE}\n" + "line\n\n" * 20 + _FENCE
_SMALL = chunking.Sizes(target=200, most=300, least=40)


def _markdown(spark: SparkSession) -> DataFrame:
    rows = [("docs/storage.md", 30, _MARKDOWN), ("docs/storage.md", 31, _MARKDOWN), ("docs/storage.md", 33, _MARKDOWN), ("docs/v1beta1-api_notes.md", 30, _LONG)]
    return literal(spark, rows, "doc_path string, version int, raw string")


@query(_values("ord INTEGER, crumbs VARCHAR, part INTEGER, body VARCHAR", [
    (0, "Storage", 0, "Opening words of the page that are long enough to be kept as a passage."),
    (1, "Storage > Volumes", 0, "Text on volumes that is long enough to be kept, with  nothing hidden."),
    (2, "Storage > Volumes > Deep part", 0, f"{_FENCE}bash\n# not a heading\n{_FENCE}\nWords after the fence that make the section long enough to keep."),
    (3, "Storage > Volumes > Deep part", 1, "Another section that has words enough to be kept in the collection."),
    (4, "Storage > Volumes > Deep part", 2, "Another section that has words enough to be kept in the collection twice."),
]))
def section_split(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.chunked(_markdown(spark).filter("version = 30 and doc_path = 'docs/storage.md'"), _SMALL)
    return out.select("ord", F.array_join("heading_path", " > ").alias("crumbs"), "part", F.col("text").alias("body"))


@query(_values("ord INTEGER, crumbs VARCHAR, n INTEGER, fences INTEGER", [(0, "V1Beta1 Api Notes", 144, 0), (1, "V1Beta1 Api Notes", 144, 0), (2, "V1Beta1 Api Notes", 144, 0), (3, "V1Beta1 Api Notes", 127, 2)]))
def chunk_document(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.chunked(_markdown(spark).filter("doc_path <> 'docs/storage.md'"), _SMALL)
    return out.select("ord", F.array_join("heading_path", " > ").alias("crumbs"), F.length("text").alias("n"), F.regexp_count("text", F.lit(_FENCE)).alias("fences"))


@query(_values("version_low INTEGER, version_high INTEGER, n BIGINT", [(30, 31, 5), (33, 33, 5), (30, 30, 4)]))
def coalesce_corpus(spark: SparkSession, d: str) -> DataFrame:
    return chunking.corpus(_markdown(spark), _SMALL).groupBy("version_low", "version_high").agg(F.count("*").alias("n"))


@query(_values("id INTEGER, title VARCHAR", [(1, "V1Beta1 Api"), (2, "What'S New"), (3, "Émile"), (4, "Readme")]))
def title_from_path(spark: SparkSession, d: str) -> DataFrame:
    rows = literal(spark, [(1, "a/b/v1beta1-API.md"), (2, "what's_new.md"), (3, "x/émile.md"), (4, "README")], "id int, p string")
    return rows.select("id", fn.title_from_path(F.col("p")).alias("title"))


@query(_values("id INTEGER, title VARCHAR, body VARCHAR", [(1, "A b", "text\n---\n"), (2, "C", "x"), (3, None, "---\nopen"), (4, None, "y")]))
def front_matter(spark: SparkSession, d: str) -> DataFrame:
    rows = literal(spark, [(1, "---\ntitle:  'A b' \n---\ntext\n---\n"), (2, '---\r\nx: 1\r\ntitle: "C"\r\n---\r\nx'), (3, "---\nopen"), (4, "---\nother: 1\n---\ny")], "id int, raw string")
    return rows.select("id", fn.front_matter(F.col("raw")).alias("f")).select("id", "f.title", "f.body")


@query(_values("id INTEGER, heading VARCHAR", [(1, "Flow"), (2, "Use glossary of it"), (3, "")]))
def clean_heading(spark: SparkSession, d: str) -> DataFrame:
    rows = literal(spark, [(1, "Flow {#flow-v132} "), (2, 'Use {{< term "x" >}}glossary{{< /term >}} of it'), (3, "{#only}")], "id int, raw string")
    return rows.select("id", fn.clean_heading(F.col("raw")).alias("heading"))


@query(_values("id INTEGER, resources VARCHAR", [(1, "FlowSchema,Level"), (2, "A,B,C"), (3, ""), (4, "Pod")]))
def resource_list(spark: SparkSession, d: str) -> DataFrame:
    rows = literal(spark, [(1, "**FlowSchema** and `Level`."), (2, "A, B, and C"), (3, "all of the things"), (4, "Pod and other kinds")], "id int, raw string")
    return rows.select("id", F.array_join(fn.resources(F.col("raw")), ",").alias("resources"))


@query(_values("id INTEGER, cited VARCHAR, invalid VARCHAR", [(1, "1", ""), (2, "1", "7"), (3, "", "0"), (4, "", ""), (5, "1,2,3", "")]))
def citation_markers(spark: SparkSession, d: str) -> DataFrame:
    rows = literal(spark, [(1, "Yes [1].", 3), (2, "So [7] and [1] and [1].", 3), (3, "Hm [0]", 3), (4, "No mark [x].", 3), (5, "[3][1][2]", 3)], "id int, body string, blocks int")
    out = rows.select("id", fn.citations(F.col("body"), F.col("blocks")).alias("c"))
    return out.select("id", F.array_join("c.cited", ",").alias("cited"), F.array_join("c.invalid", ",").alias("invalid"))


@query(_values("suspicious BOOLEAN, kind VARCHAR", [(False, "cosine"), (True, "logit")]))
def scale_detector(spark: SparkSession, d: str) -> DataFrame:
    cosine = answer.scale_warning(literal(spark, [(1, 0.5), (2, 0.8)], "query_id int, best double"))
    logit = answer.scale_warning(literal(spark, [(1, -9.0), (2, 6.0)], "query_id int, best double"))
    return cosine.select("suspicious", F.lit("cosine").alias("kind")).unionByName(logit.select("suspicious", F.lit("logit").alias("kind")))


@query(_values("id INTEGER", [(2,), (3,)]))
def request_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = literal(spark, [(1, "hm", 5), (2, "why?", 5), (3, "x" * 2000, 20), (4, "x" * 2001, 5), (5, "why?", 21), (6, "why?", 0), (7, None, 5)], "id int, question string, top_k int")
    return answer.accepted_requests(rows).select("id")


_GUIDE_ROWS = [("a", "f1", 1, 24, 31, "api/v1beta1 of Widget is going"), ("b", "f1", 2, 32, 35, "api/v1beta1 of Widget is gone"), ("c", "f2", 3, 24, 35, "api/v1 of Widget stays"), ("d", "f3", 4, 24, 35, "Nothing here")]


def _guide_rows(spark: SparkSession) -> DataFrame:
    return literal(spark, _GUIDE_ROWS, "chunk_id string, family string, seq int, version_low int, version_high int, text string")


def _removals(spark: SparkSession) -> DataFrame:
    return literal(spark, [("r1", "api/v1beta1", ["Widget"], 31), ("r2", "none/v1", ["Widget"], 25)], "fact_id string, api string, resources array<string>, removed int")


def _window(spark: SparkSession) -> DataFrame:
    return spark.range(24, 34).select(F.col("id").cast("int").alias("version"))


@query(_values("fact_id VARCHAR, version INTEGER, positive VARCHAR, boundary BOOLEAN", [("r1", 31, "a", True), ("r1", 32, "b", False), ("r1", 33, "b", False)]))
def removal_examples(spark: SparkSession, d: str) -> DataFrame:
    return datasets.removal_examples(_removals(spark), _guide_rows(spark), _window(spark))


@query(_values("fact_id VARCHAR, version INTEGER, negative VARCHAR, place INTEGER", [("r1", 31, "c", 1), ("r1", 32, "c", 1), ("r1", 33, "c", 1)]))
def removal_siblings(spark: SparkSession, d: str) -> DataFrame:
    rows = datasets.removal_examples(_removals(spark), _guide_rows(spark), _window(spark))
    return datasets.sibling_negatives(rows, _removals(spark), _guide_rows(spark))


_TEMPLATES = [(1, "How does {version} handle it?"), (2, "Is it in {version}?"), (3, "What came after {version}?")]


@query("""WITH t(template_id, template) AS (VALUES (1, 'How does {version} handle it?'), (2, 'Is it in {version}?'), (3, 'What came after {version}?')), v AS (SELECT CAST(unnest(generate_series(24, 33)) AS INTEGER) AS version)
SELECT template_id, version, replace(template, '{version}', '1.' || version) AS question FROM t, v ORDER BY substr(sha256('20260805|' || template_id || '|' || version), 1, 16), 1, 2 LIMIT 12""")
def unanswerable_examples(spark: SparkSession, d: str) -> DataFrame:
    return datasets.unanswerable(literal(spark, _TEMPLATES, "template_id int, template string"), _window(spark), 12)


@query(_values("query_id INTEGER, recall DOUBLE", [(1, 0.5), (2, 1.0), (3, 0.0)]))
def recall_general(spark: SparkSession, d: str) -> DataFrame:
    rows = literal(spark, [(1, 1, True, 2), (1, 2, False, 2), (1, 9, True, 2), (2, 5, True, 1), (3, None, False, 3)], "query_id int, rank int, match boolean, relevant int")
    return rows.groupBy("query_id").agg(metrics.recall_at(5).alias("recall"))


@query(_values("id VARCHAR, low INTEGER, high INTEGER", [("a", 24, 26), ("b", 24, 25), ("b", 28, 28)]))
def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = [("a", 26), ("a", 24), ("a", 25), ("a", 25), ("b", 28), ("b", 25), ("b", 24)]
    out = coalesced(literal(spark, rows, "id string, version int"), ["id"], ["version"])
    return out.select("id", F.col("version_low").alias("low"), F.col("version_high").alias("high"))


@query(_values("id INTEGER, seq INTEGER", [(1, 1), (2, 3)]))
def question_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = literal(spark, [(1, 1, " Why? "), (9, 2, "why?"), (2, 3, "How?")], "id int, seq int, question string")
    return corpus.first_wins(rows, F.lower(fn.stripped(F.col("question"))), ["seq"]).select("id", "seq")
