"""Reading and writing collections: JSON lines, trees of Markdown by version, gold questions, collections with a manifest."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fn
from ..functions import versions as vs

CHUNK = T.StructType().add("doc_path", "string").add("heading_path", T.ArrayType(T.StringType())).add("part", "integer").add("text", "string").add("version_low", "string").add("version_high", "string")
EXAMPLE = T.StructType().add("question", "string").add("target_version", "string").add("positive_chunk_id", "string").add("hard_negative_ids", T.ArrayType(T.StringType())).add("retriever_negative_ids", T.ArrayType(T.StringType())).add("family_id", "string").add("source", "string").add("unanswerable", "boolean").add("notes", "string")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a malformed line ends the query, unlisted fields are ignored."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> int:
    """Writes JSON lines and returns their number, counted on the way."""
    from pyspark.sql import Observation

    seen = Observation("rows")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return int(seen.get["n"])


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Passages with versions as numbers and ids made anew; a missing part is 0."""
    low, high = vs.parse(F.col("version_low")), vs.parse(F.col("version_high"))
    df = read_jsonl(spark, path, CHUNK).withColumn("part", F.coalesce("part", F.lit(0)))
    df = df.withColumns({"version_major": low["major"], "family_id": fn.family_id(F.col("doc_path"), F.col("heading_path"), F.col("part")), "content_hash": fn.content_hash(F.col("text"))})
    df = df.withColumn("chunk_id", fn.chunk_id(F.col("family_id"), F.col("content_hash"), F.col("version_low")))
    return df.withColumns({"version_low": low["minor"], "version_high": high["minor"]})


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples with defaults for missing lists, source and flags."""
    none = F.array().cast("array<string>")
    df = read_jsonl(spark, path, EXAMPLE)
    return df.withColumns({"hard_negative_ids": F.coalesce("hard_negative_ids", none), "retriever_negative_ids": F.coalesce("retriever_negative_ids", none), "source": F.coalesce("source", F.lit("generated")), "unanswerable": F.coalesce("unanswerable", F.lit(False))})


def write_chunks(passages: DataFrame, path: str) -> int:
    """Passages in corpus order as JSON lines that read_chunks() reads; returns their number."""
    from ..operators.chunking import ordered

    label = lambda c: F.concat(F.coalesce(F.col("version_major").cast("string"), F.lit("1")), F.lit("."), F.col(c).cast("string")).alias(c)
    rows = passages if "version_major" in passages.columns else passages.withColumn("version_major", F.lit(1))
    return write_jsonl(ordered(rows).select("doc_path", "heading_path", "part", "text", label("version_low"), label("version_high")), path)


def write_examples(examples: DataFrame, path: str) -> int:
    """Examples (question, version, positive_id, negatives, family, source, unanswerable, notes) as lines that read_examples() reads."""
    rows = examples.select("question", F.concat(F.lit("1."), F.col("version").cast("string")).alias("target_version"), F.col("positive_id").alias("positive_chunk_id"), F.col("negatives").alias("hard_negative_ids"), F.array().cast("array<string>").alias("retriever_negative_ids"), F.col("family").alias("family_id"), "source", "unanswerable", "notes")
    return write_jsonl(rows, path)


RESULT = "config string, source string, metric string, value double, degraded boolean"


def write_results(results: DataFrame, folder: str, split: str) -> None:
    """A run's metrics (config, source, metric, value, degraded) as one JSON-lines file a split, next to those of other splits."""
    names = [f.split()[0] for f in RESULT.split(", ")]
    rows = results if "degraded" in results.columns else results.withColumn("degraded", F.lit(False))
    rows.select(*names).coalesce(1).write.mode("overwrite").json(f"{folder}/split={split}")  # a few rows a configuration


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """What write_results() wrote, of all splits, with ``split``."""
    return spark.read.schema(RESULT + ", split string").json(folder)


def results_document(spark: SparkSession, folder: str, names: list[str]) -> str:
    """Markdown: a table of all configurations for each split, and each configuration by source; made anew from the files."""
    from ..operators import metrics

    wide = read_results(spark, folder).groupBy("split", "source", "config").pivot("metric", names).agg(F.first("value")).orderBy("split", "source", "config").toPandas()  # as few rows as a report has
    parts = []
    for split, rows in wide.groupby("split"):
        whole = rows[rows["source"] == "all"].to_dict("records")
        parts.append(f"## {split}\n\n" + metrics.markdown(whole, names))
        for config, own in rows[rows["source"] != "all"].groupby("config"):
            parts.append(f"### {config}\n\n" + metrics.markdown([{**r, "config": r["source"]} for r in own.to_dict("records")], names))
    return "\n\n".join(parts) + "\n"


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(doc_path, version, raw) of the Markdown files under ``root``/version=<minor>/..., files that aren't UTF-8 left out.

    The version comes from the folder's name, so a filter on it prunes folders. Checking out each release is done before.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(root)
    files = files.filter(F.is_valid_utf8(F.col("content").cast("string")))
    path = F.regexp_extract("path", r"/version=(\d+)/(.+)$", 2)
    return files.select(path.alias("doc_path"), F.regexp_extract("path", r"/version=(\d+)/", 1).try_cast("int").alias("version"), F.col("content").cast("string").alias("raw")).filter("version is not null")


def versions_present(spark: SparkSession, names: list[str]) -> DataFrame:
    """(major, minor) of the branch names that are releases; other names are ignored."""
    df = spark.createDataFrame([(n,) for n in names], "name string")
    return df.select(vs.try_parse(F.regexp_extract("name", r"release-(.+)$", 1)).alias("v")).filter("v is not null").select("v.*").distinct()


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions from YAML; question and version are required."""
    import yaml

    rows = yaml.safe_load(Path(path).read_text(encoding="utf-8"))["questions"]
    for i, r in enumerate(rows):
        if not r.get("question") or r.get("version") is None:
            raise ValueError(f"question {i}: question and version are required")
    schema = "spec_id int, question string, version string, want_doc string, want_text string, unanswerable boolean, rationale string"
    return spark.createDataFrame([(i, r["question"], str(r["version"]), r.get("expect_doc") or "", r.get("expect_text") or "", bool(r.get("unanswerable", False)), r.get("rationale") or "") for i, r in enumerate(rows)], schema)


class Collection:
    """A table of passages and vectors in a folder of its own, with a manifest that says what it was made from."""

    def __init__(self, spark: SparkSession, root: str, model: str, revision: int):
        low = "".join(c if c.isascii() and c.isalnum() else "_" for c in model.lower())
        self.spark, self.name = spark, "chunks__" + "_".join(p for p in low.split("_") if p) + f"__v{revision}"
        self.path, self.manifest = f"{root}/{self.name}/rows", f"{root}/{self.name}/manifest"

    def replace(self, rows: DataFrame, facts: dict) -> None:
        """Rows sorted by version within files, so that a version filter skips row groups."""
        rows.sortWithinPartitions("version_low").write.mode("overwrite").parquet(self.path)
        self.spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(self.manifest)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def valid(self, facts: dict) -> bool:
        """Whether the manifest exists and says the same; a missing or broken one means no."""
        from pyspark.errors import AnalysisException

        try:
            got = self.spark.read.text(self.manifest).collect()
            return len(got) == 1 and json.loads(got[0][0]) == facts
        except (AnalysisException, ValueError):
            return False

    def get_or_build(self, facts: dict, build, force: bool = False) -> DataFrame:
        if force or not self.valid(facts):
            self.replace(build(), facts)
        return self.rows()

    def ready(self) -> bool:
        from pyspark.errors import AnalysisException

        try:
            return not self.rows().isEmpty()
        except AnalysisException:
            return False

    def nearest(self, queries: DataFrame, limit: int, filtered: bool = True) -> DataFrame:
        """(query_id, vec_id, score, rank): the ``limit`` nearest rows (with vec_id and embedding) to each query."""
        from ..operators import dense

        return dense.top_k(queries, self.rows(), limit, filtered)

    def search(self, version: int | None = None, doc_prefix: str | None = None, major: int = 1) -> DataFrame:
        """Rows that cover a version, of documents with a path prefix; all bounds reach the scan. Rows without a major are of major 1."""
        rows = self.rows()
        if "version_major" in rows.columns:
            rows = rows.filter(F.col("version_major") == major)
        elif major != 1:
            rows = rows.filter(F.lit(False))
        if version is not None:
            rows = rows.filter((F.col("version_low") <= version) & (F.col("version_high") >= version))
        return rows.filter(F.col("doc_path").startswith(doc_prefix)) if doc_prefix else rows


def validated_batches(requests: DataFrame, most_chars: int = 20_000, most_texts: int = 256) -> DataFrame:
    """Texts to embed (request_id, kind, text); an empty or over-long text, an unknown kind or a request of too many texts ends the query."""
    good = F.length("text").between(1, most_chars) & F.col("kind").isin("query", "passage")
    if "request_id" in requests.columns:
        sizes = requests.groupBy("request_id").agg(F.count("*").alias("_texts"))  # tasks count first, so a large request is a row a task
        requests = requests.join(sizes, "request_id")
        good = good & (F.col("_texts") <= most_texts)
    checked = F.when(good, F.col("text")).otherwise(F.raise_error(F.lit("text, kind or number of texts out of bounds")).cast("string"))
    return requests.withColumn("text", checked).drop("_texts")


def previewed(hits: DataFrame, chars: int = 240) -> DataFrame:
    """Hits as they are shown: scores at four digits, the first ``chars`` code points of the text."""
    return hits.withColumns({"score": F.round("score", 4), "text": F.substring("text", 1, chars)})


BOUNDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def request_histogram(requests: DataFrame) -> DataFrame:
    """(endpoint, status, bound, requests): how many requests (endpoint, status, seconds) took at most each bound; a null bound counts all."""
    bounds = F.array(*(F.lit(float(b)) for b in BOUNDS), F.lit(None).cast("double"))
    rows = requests.select("endpoint", "status", "seconds").withColumn("bound", F.explode(bounds))
    return rows.groupBy("endpoint", "status", "bound").agg(F.count_if(F.col("bound").isNull() | (F.col("seconds") <= F.col("bound"))).alias("requests"))
