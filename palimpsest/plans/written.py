"""Queries that write text from the tables' rows and read it again; their SQL states what was written, from the columns alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions import versions as vs
from ..operators import answer, chunking, datasets, facts, outline, resolve
from .catalog import query, table

#: Sizes that keep every section whole.
_WHOLE = chunking.Sizes(target=10**6, most=10**6, least=1)


def _text(*parts: object) -> F.Column:
    return F.concat(*(p.cast("string") if isinstance(p, F.Column) else F.lit(p) for p in parts))


@query("SELECT event_id, CASE WHEN day(ts) % 2 = 0 THEN day(ts) || ',' || (day(ts) + 40) ELSE CAST(day(ts) AS VARCHAR) END AS minors FROM events")
def versions_in_events(spark: SparkSession, d: str) -> DataFrame:
    """Versions read out of a sentence about each event; 2.x, long numbers and repeats are no news."""
    day = F.dayofmonth("ts")
    body = F.when(day % 2 == 0, _text("Moving from 1.", day, " to v1.", day + 40, ".2, then 1.", day, " again; tool 2.", day)).otherwise(_text("Chart 1.", day, " only, build 11.", day, ".3."))
    return table(spark, d, "events").select("event_id", F.array_join(vs.mentioned(body), ",").alias("minors"))


@query("""SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN day(ts) WHEN event_id % 3 = 1 AND user_id % 3 <> 2 THEN 5 + user_id % 3 ELSE 35 END AS INTEGER) AS version,
CASE WHEN event_id % 3 = 0 THEN 'explicit' WHEN event_id % 3 = 1 AND user_id % 3 <> 2 THEN 'inferred' ELSE 'defaulted' END AS source,
CASE WHEN event_id % 3 = 0 THEN '1.' || day(ts) WHEN event_id % 3 = 1 AND user_id % 3 <> 2 THEN 'kind' || user_id % 3 || '.example/v1' ELSE '' END AS evidence FROM events""")
def resolved_events(spark: SparkSession, d: str) -> DataFrame:
    """The version that a question about each event is about: stated, inferred from a removed API that it names, or the newest."""
    e = table(spark, d, "events")
    kind = F.col("user_id") % 3
    asked = F.when(F.col("event_id") % 3 == 0, _text("We are running v1.", F.dayofmonth("ts"), " here")).when(F.col("event_id") % 3 == 1, _text("Is Kind", kind, ".example/V1 still served?")).otherwise(F.lit("What is a node?"))
    gone = e.select((F.col("user_id") % 3).alias("k")).distinct().select(_text("kind", F.col("k"), ".example/v1").alias("api"), F.when(F.col("k") == 2, 1).otherwise(F.col("k") + 6).cast("int").alias("removed"), F.col("k").cast("int").alias("seq"))
    return resolve.resolved(e.select("event_id", asked.alias("query")), gone, 1, 35, "event_id").select("event_id", "version", "source", "evidence")


_ANSWERED = "CASE event_id % 3 WHEN 0 THEN 'For version 1.' || day(ts) || '.' WHEN 1 THEN 'For version 1.' || day(ts) || ', inferred from ' || event_type || '.' ELSE 'For version 1.' || day(ts) || ', the newest indexed, as none was given.' END"


@query(f"SELECT event_id, {_ANSWERED} AS sentence FROM events")
def disclosed_events(spark: SparkSession, d: str) -> DataFrame:
    """How the version was chosen, as a sentence for each event."""
    source = F.element_at(F.array(F.lit("explicit"), F.lit("inferred"), F.lit("defaulted")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", fn.disclosure(source, _text("1.", F.dayofmonth("ts")), F.col("event_type")).alias("sentence"))


@query("SELECT n_nationkey, array_to_string(list_transform(string_split(replace(n_name, '_', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title FROM nation")
def nation_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles made of the paths of documents named after nations."""
    path = F.concat(F.lit("docs/places/"), F.translate(F.lower("n_name"), " ", "_"), F.lit(".md"))
    return table(spark, d, "nation").select("n_nationkey", fn.title_from_path(path).alias("title"))


@query("SELECT s_suppkey, trim(s_name) AS heading FROM supplier")
def supplier_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings without shortcodes and anchors, whichever comes first."""
    name, anchor, code = F.col("s_name"), _text(" {#s-", F.col("s_suppkey"), "}"), F.lit("{{< beta >}}")
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.concat(name, anchor, F.lit(" "), code)).when(F.col("s_suppkey") % 3 == 1, F.concat(code, F.lit(" "), name, anchor)).otherwise(name)
    return table(spark, d, "supplier").select("s_suppkey", fn.clean_heading(raw).alias("heading"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 <> 3 THEN c_name END AS title, CASE WHEN c_custkey % 4 = 3 THEN c_mktsegment ELSE 'Segment ' || c_mktsegment END AS body FROM customer")
def customer_pages(spark: SparkSession, d: str) -> DataFrame:
    """Title and body of pages with front matter, quoted one way or another or not there."""
    quote = F.element_at(F.array(F.lit('"'), F.lit("'"), F.lit("")), (F.col("c_custkey") % 4 + 1).cast("int"))
    raw = F.when(F.col("c_custkey") % 4 == 3, F.col("c_mktsegment")).otherwise(F.concat(F.lit("---\nweight: 3\ntitle: "), quote, F.col("c_name"), quote, F.lit("\n---\nSegment "), F.col("c_mktsegment")))
    customer = table(spark, d, "customer").withColumn("c_custkey", F.col("c_custkey").cast("long"))
    return customer.withColumn("quoted", quote).select("c_custkey", fn.front_matter(raw).alias("f")).select("c_custkey", "f.title", "f.body")


@query("SELECT conv_id, turn, array_to_string(list_filter([turn + 1, turn + 2], lambda n: n <= 3), ',') AS cited, array_to_string(list_filter([turn + 1, turn + 2], lambda n: n > 3), ',') AS invalid FROM conversations")
def cited_turns(spark: SparkSession, d: str) -> DataFrame:
    """Marks of the blocks that an answer cites, of three that it was given; each once, in order."""
    n = F.col("turn")
    said = _text("So [", n + 2, "] and [", n + 1, "], again [", n + 2, "], not [x].")
    c = fn.citations(said, F.lit(3))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(c["cited"], ",").alias("cited"), F.array_join(c["invalid"], ",").alias("invalid"))


@query("SELECT conv_id, turn FROM conversations WHERE length(text) BETWEEN 3 AND 2000 AND turn + 1 BETWEEN 1 AND 20")
def accepted_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns that may be asked as questions, with as many hits as their place."""
    return answer.accepted_requests(table(spark, d, "conversations").withColumn("top_k", F.col("turn") + 1), "text").select("conv_id", "turn")


@query("""SELECT 'discount' AS score, max(l_discount) > 1 OR min(l_discount) < -1 AS suspicious FROM lineitem UNION ALL SELECT 'quantity' AS score, max(l_quantity) > 1 OR min(l_quantity) < -1 AS suspicious FROM lineitem""")
def score_scales(spark: SparkSession, d: str) -> DataFrame:
    """Whether two columns, taken as best scores, look as if they were on another scale than the floor."""
    rows = table(spark, d, "lineitem")
    one = lambda c: answer.scale_warning(rows.select(F.col(f"l_{c}").cast("double").alias("best"))).select(F.lit(c).alias("score"), "suspicious")
    return one("discount").unionByName(one("quantity"))


@query("""WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS part FROM conversations)
SELECT conv_id, CAST(ord AS INTEGER) AS ord, 'Talk ' || conv_id || ' > ' || role AS crumbs, CAST(part AS INTEGER) AS part FROM t""")
def conversation_sections(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as a document with a section a turn, cut at its headings: place, breadcrumb, number among equal breadcrumbs."""
    section = F.concat(F.lit("## "), F.col("role"), F.lit(" {#turn}\n\n"), F.col("text"), F.lit("\n```\n# no heading\n```\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", section.alias("s")))), lambda x: x["s"]), "\n")
    docs = table(spark, d, "conversations").groupBy("conv_id").agg(body.alias("body"))  # a conversation's turns
    raw = F.concat(F.lit('---\ntitle: "Talk '), F.col("conv_id").cast("string"), F.lit('"\n---\n'), F.col("body"))
    out = chunking.chunked(docs.select(F.col("conv_id").cast("string").alias("doc_path"), F.lit(1).alias("version"), raw.alias("raw")), _WHOLE)
    return out.select(F.col("doc_path").cast("long").alias("conv_id"), "ord", F.array_join("heading_path", " > ").alias("crumbs"), "part")


@query("""SELECT DISTINCT '1.' || (24 + p_size % 12) AS removed_in, 'maker' || right(trim(p_brand), 1) || '.example/v1beta' || p_size % 5 AS api, string_split(p_type, ' ')[1] || ',' || string_split(p_type, ' ')[-1] AS resources,
CASE WHEN p_size % 2 = 0 THEN '1.20' END AS replacement_since FROM part""")
def removed_parts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of guides written from parts, one guide a brand and a block a part; equal facts count once."""
    api = F.concat(F.lit("maker"), F.right(F.trim("p_brand"), F.lit(1)), F.lit(".example/v1beta"), (F.col("p_size") % 5).cast("string"))
    first, last = F.element_at(F.split("p_type", " "), 1), F.element_at(F.split("p_type", " "), -1)
    version = F.concat(F.lit("1."), (F.col("p_size") % 12 + 24).cast("string"))
    since = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\n* Use the **"), api, F.lit("** API version, available since v1.20."))).otherwise(F.lit(""))
    block = F.concat(F.lit("### v"), version, F.lit("\n#### "), F.col("p_name"), F.lit("\nThe **"), api, F.lit("** API version of "), first, F.lit(" and `"), last, F.lit("` is no\nlonger served as of v"), version, F.lit("."), since)
    rows = table(spark, d, "part").select("p_brand", "p_partkey", block.alias("b"))
    guides = rows.groupBy(F.col("p_brand").alias("doc_path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "b"))), lambda x: x["b"]), "\n").alias("markdown"))
    out = facts.facts(guides)
    return out.select("removed_in", "api", F.array_join("resources", ",").alias("resources"), "replacement_since").distinct()


_REMOVED = """f AS (SELECT p_brand || '|' || p_type AS fact_id, p_brand AS api, p_type AS resource, CAST(min(p_size % 12 + 24) AS INTEGER) AS removed FROM part GROUP BY p_brand, p_type),
p AS (SELECT p_partkey AS chunk_id, p_size % 7 AS family, 'About ' || p_brand || ' of ' || p_type AS body, p_size % 6 + 24 AS lo, p_size % 6 + 24 + p_partkey % 8 AS hi FROM part),
m AS (SELECT fact_id, CAST(v AS INTEGER) AS version, chunk_id AS positive, v = removed AS boundary, row_number() OVER (PARTITION BY fact_id, v ORDER BY chunk_id) AS n FROM f JOIN p ON contains(body, api) AND contains(body, resource) JOIN range(24, 36) AS r(v) ON v >= removed AND v BETWEEN lo AND hi)"""


def _removed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, passages and versions: a brand counts as an API, a part's type as its resource, and every part is a passage."""
    part = table(spark, d, "part")
    known = part.groupBy("p_brand", "p_type").agg(F.min(F.col("p_size") % 12 + 24).cast("int").alias("removed"))
    known = known.select(F.concat("p_brand", F.lit("|"), "p_type").alias("fact_id"), F.col("p_brand").alias("api"), F.array("p_type").alias("resources"), "removed")
    low = (F.col("p_size") % 6 + 24).cast("int")
    body = F.concat(F.lit("About "), "p_brand", F.lit(" of "), "p_type")
    passages = part.select(F.col("p_partkey").alias("chunk_id"), F.col("p_partkey").alias("seq"), (F.col("p_size") % 7).alias("family"), body.alias("text"), low.alias("version_low"), (low + (F.col("p_partkey") % 8).cast("int")).alias("version_high"))
    return known, passages, spark.range(24, 36).select(F.col("id").cast("int").alias("version"))


@query(f"WITH {_REMOVED} SELECT fact_id, version, positive, boundary FROM m WHERE n = 1")
def part_removals(spark: SparkSession, d: str) -> DataFrame:
    """For every fact and version from its removal on, the first passage that names it and covers the version."""
    return datasets.removal_examples(*_removed(spark, d))


@query(f"""WITH {_REMOVED}, s AS (SELECT m.fact_id, m.version, p.chunk_id AS negative, CAST(row_number() OVER (PARTITION BY m.fact_id, m.version ORDER BY p.chunk_id) AS INTEGER) AS place
FROM m JOIN f ON f.fact_id = m.fact_id JOIN p AS o ON o.chunk_id = m.positive JOIN p ON contains(p.body, f.resource) AND NOT contains(p.body, f.api) AND p.family <> o.family WHERE m.n = 1)
SELECT fact_id, version, negative, place FROM s WHERE place <= 6""")
def part_siblings(spark: SparkSession, d: str) -> DataFrame:
    """Passages of other families that name a fact's resource but not its API, the first six of each example."""
    known, passages, versions = _removed(spark, d)
    return datasets.sibling_negatives(datasets.removal_examples(known, passages, versions), known, passages)


# Conversations as outlines: a turn is a heading, its depth the role's, and its text follows; every fifth turn quotes it in a fence, behind a false heading.

_DEPTHS = {"system": 1, "user": 2, "assistant": 3}
_TURNS = f"""t AS (SELECT conv_id, turn, coalesce(text, '') AS text, role || ' ' || turn AS h, CASE role {' '.join(f"WHEN '{r}' THEN {n}" for r, n in _DEPTHS.items())} ELSE 4 END AS d, turn % 5 = 4 AS quoted FROM conversations),
tw AS (SELECT *, {', '.join(f"max(CASE WHEN d = {n} THEN turn END) OVER w AS l{n}, max(CASE WHEN d < {n} THEN turn END) OVER w AS a{n}" for n in (1, 2, 3, 4))}, row_number() OVER w AS section FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT tw.conv_id, tw.section, tw.quoted, tw.text, {', '.join(f"(SELECT u.h FROM t u WHERE u.conv_id = tw.conv_id AND u.turn = tw.l{n} AND coalesce(tw.l{n} > tw.a{n}, true)) AS h{n}" for n in (1, 2, 3, 4))} FROM tw),
q AS (SELECT conv_id, section, quoted, text, array_to_string(list_filter([h1, h2, h3, h4], lambda h: h IS NOT NULL), ' > ') AS heading_path FROM p)"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, turn, part): each turn's Markdown."""
    depth = F.lit(4)
    for role, n in _DEPTHS.items():
        depth = F.when(F.col("role") == role, n).otherwise(depth)
    text = F.coalesce("text", F.lit(""))
    body = F.when(F.col("turn") % 5 == 4, _text("~~~\n# quoted\n```\n", text, "\n~~~")).otherwise(text)
    return table(spark, d, "conversations").select("conv_id", "turn", _text(F.repeat(F.lit("#"), depth.cast("int")), " ", F.col("role"), " ", F.col("turn"), "\n", body).alias("part"))


@query(f"WITH {_TURNS} SELECT conv_id, CAST(section AS INTEGER) AS section, heading_path, CASE WHEN quoted THEN '~~~' || chr(10) || '# quoted' || chr(10) || '```' || chr(10) || text || chr(10) || '~~~' ELSE text END AS body FROM q")
def conversation_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of conversations, each a text of Markdown, by a lateral table function; the empty one before the first heading is left out."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "part")))
    texts = _turns(spark, d).groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n").alias("text"))
    found = outline.sections_of(texts, "text").filter("section > 0")
    return found.select("conv_id", "section", F.array_join("heading_path", " > ").alias("heading_path"), F.regexp_replace("body", "^\n|\n$", "").alias("body"))


@query(f"""WITH {_TURNS} SELECT conv_id, CAST(section AS INTEGER) AS section, heading_path, CAST(1 + len(text) - len(replace(text, chr(10), '')) + CASE WHEN quoted THEN 4 ELSE 0 END AS BIGINT) AS lines,
CAST(CASE WHEN quoted THEN 5 + len(text) - len(replace(text, chr(10), '')) ELSE 0 END AS BIGINT) AS fenced FROM q""")
def conversation_outline(spark: SparkSession, d: str) -> DataFrame:
    """Lines and fenced lines under each heading, by a table function over the lines in order."""
    lines = outline.lines_of(_turns(spark, d), "conv_id", "turn", text="part")
    rows = outline.outlined(lines, F.col("conv_id"), F.col("turn") * (1 << 32) + F.col("line"), F.col("text"))
    path = F.array_join(F.max("heading_path"), " > ").alias("heading_path")
    return rows.groupBy("key", "section").agg(path, F.count_if(~F.col("heading")).alias("lines"), F.count_if("fenced").alias("fenced")).select(F.col("key").cast("long").alias("conv_id"), "section", "heading_path", "lines", "fenced")
