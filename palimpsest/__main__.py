"""spark-submit entry: python -m palimpsest VERB ...

ingest TREE OUT     passages and facts of a tree of Markdown by version (version=<minor>/...)
stats OUT           statistics of ingested passages
query NAME FOLDER   a registered query over a folder of tables
gate BASELINE RUN   regressions of RUN against BASELINE (tables of config, metric, value, degraded); exit code 1 if any; a BASELINE
                    that isn't there yet is written from RUN
dataset OUT         questions of all kinds about ingested passages, as OUT/examples and OUT/splits/<train, dev, test>
mine-negatives OUT SPLIT
                    hard negatives of other families for a split's questions, as OUT/mined/<split>
eval OUT SPLIT      lexical retrieval on a split, with and without the version filter, as OUT/results
gold SPECS OUT      questions of a YAML file bound to ingested passages, as OUT/gold; exit code 1 if any can't be bound
report FOLDER       Markdown of the results under FOLDER
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import from_environment
from .functions import text as fn
from .functions import versions as vs
from .operators import chunking, corpus, examples, facts, gate, metrics, workflow
from .sources import files, trees


def ingest(spark: SparkSession, tree: str, out: str) -> None:
    """Writes OUT/chunks and OUT/facts; facts come from the newest version's files that have any."""
    s = from_environment()
    rows = trees.read(spark, tree, s.versions).persist()
    for r in trees.skipped(rows).orderBy("version", "problem").collect():  # a row a version and problem
        print(f"1.{r['version']}: {r['problem']} ({r['n']})", file=sys.stderr)
    found = rows.filter("raw is not null").select("doc_path", "version", "raw")
    chunking.corpus(found, chunking.Sizes(s.target_chars, s.most_chars, s.least_chars)).write.mode("overwrite").parquet(f"{out}/chunks")
    guides = facts.newest(found.filter(F.col("raw").rlike("(?m)^####\\s") & F.col("raw").contains("no longer")).withColumnRenamed("raw", "markdown"))
    facts.facts(guides).write.mode("overwrite").parquet(f"{out}/facts")
    covered = facts.alerted(facts.coverage(guides)).first()
    if covered["alert"]:
        print(f"only {covered['facts']} of {covered['blocks']} blocks became facts", file=sys.stderr)
    rows.unpersist()


def stats(spark: SparkSession, out: str) -> DataFrame:
    return corpus.stats(spark.read.parquet(f"{out}/chunks"), "family_id", "doc_path")


def gold(spark: SparkSession, specs: str, out: str) -> DataFrame:
    """Writes OUT/gold and returns what couldn't be bound."""
    asked = files.read_gold(spark, specs).withColumn("want_version", vs.parse(F.col("version"))["minor"]).drop("version")
    passages = spark.read.parquet(f"{out}/chunks").withColumnRenamed("family_id", "family")
    bound = examples.gold(asked, passages).withColumn("notes", F.lit(None).cast("string"))
    files.write_examples(bound, f"{out}/gold")
    return examples.unresolved(asked, passages)


def compared(spark: SparkSession, baseline: str, run: str) -> DataFrame | None:
    """What fails, or None where there was no baseline and the run became it."""
    from pyspark.errors import AnalysisException

    current = _table(spark, run)
    try:
        recorded = _table(spark, baseline)
    except AnalysisException:
        gate.first_baseline(current).coalesce(1).write.json(baseline)
        return None
    return gate.regressions(recorded.select("config", "metric", "value"), current, from_environment().tolerance)


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("config string, metric string, value double, degraded boolean").json(path) if path.endswith(".json") else spark.read.parquet(path)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="palimpsest", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, names in {"ingest": ("tree", "out"), "stats": ("out",), "query": ("name", "folder"), "gate": ("baseline", "run"), "dataset": ("out",), "mine-negatives": ("out", "split"), "eval": ("out", "split"), "gold": ("specs", "out"), "report": ("results",)}.items():
        sub = verbs.add_parser(verb)
        for n in names:
            sub.add_argument(n)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    if a.verb == "ingest":
        ingest(spark, a.tree, a.out)
    elif a.verb == "stats":
        stats(spark, a.out).show(truncate=False)
    elif a.verb == "query":
        from .plans import catalog, evolving, fixtures, relational, retrieval, texts, written  # noqa: F401

        catalog.QUERIES[a.name](spark, a.folder).show(100, truncate=80)
    elif a.verb == "dataset":
        workflow.build(spark, a.out, from_environment()).show(truncate=False)
    elif a.verb in ("mine-negatives", "eval"):
        (workflow.mine if a.verb == "mine-negatives" else workflow.evaluate)(spark, a.out, a.split).show(1000, truncate=False)
    elif a.verb == "report":
        print(files.results_document(spark, a.results, metrics.NAMES))
    else:
        found = gold(spark, a.specs, a.out) if a.verb == "gold" else compared(spark, a.baseline, a.run)
        if found is not None:
            found.show(1000, truncate=False)
            return int(not found.isEmpty())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
