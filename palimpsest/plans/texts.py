"""Queries of needles in texts and of models in batches over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inference, substrings
from .catalog import query, table


@query("SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)")
def benchmark_in_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document and benchmark passage that stands in it as it is."""
    return substrings.contains_join(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")


@query("""WITH n AS (SELECT word, row_number() OVER (ORDER BY word) AS word_id FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark) WHERE length(word) >= 8)
SELECT page_id, word FROM pages JOIN n ON contains(pages.html, n.word)""")
def benchmark_words_in_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page and every long word of the benchmark that its markup holds, inside words too."""
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).filter(F.length("word") >= 8).distinct()
    return substrings.contains_join(table(spark, d, "pages"), words.withColumn("needle", F.col("word")), "page_id", "html", "word", "needle")


def shared_words():
    """A stand-in for a cross-encoder: distinct words that both sides have."""
    return lambda pairs: [float(len(set(a.split()) & set(b.split()))) for a, b in pairs]


def letter_counts():
    """A stand-in for an encoder: words, and how many of the letters a, e and o a text has."""
    return lambda texts: [[float(len(t.split())), *(float(t.count(c)) for c in "aeo")] for t in texts]


_WORDS = r"list_filter(string_split_regex({0}, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"


@query(f"""WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM conversations)
SELECT conv_id, turn, CAST(len(list_intersect(list_distinct({_WORDS.format('text')}), list_distinct({_WORDS.format('following')}))) AS DOUBLE) AS rerank_score FROM t WHERE following IS NOT NULL""")
def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each turn and the next as a pair, scored in packs; equal pairs once."""
    from pyspark.sql.window import Window

    rows = table(spark, d, "conversations").withColumn("following", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("following is not null")
    return inference.reranked_pairs(rows, "text", "following", "shared_words", shared_words).select("conv_id", "turn", "rerank_score")


@query(f"""WITH t AS (SELECT item_id, 'query: ' || text AS text FROM benchmark)
SELECT item_id, CAST(len({_WORDS.format('text')}) AS DOUBLE) AS words, CAST(length(text) - length(replace(text, 'a', '')) AS DOUBLE) AS a, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS e, CAST(length(text) - length(replace(text, 'o', '')) AS DOUBLE) AS o FROM t""")
def encoded_queries(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as queries, with their prefix, encoded in packs."""
    rows = inference.encoded(table(spark, d, "benchmark"), "text", "letter_counts", letter_counts, prefix="query: ")
    return rows.select("item_id", *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("words", "a", "e", "o"))))
