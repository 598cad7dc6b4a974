"""A data source of text files by version: a partition is a part of one version's folder, and what can't be read comes back as rows.

Below the root, each version has a folder ``version=<minor>``. Rows are (version, doc_path, raw, problem): ``raw`` is the text, or null with the
``problem`` ("not UTF-8", "unreadable", and for versions asked for that have no folder "missing version").

    spark.dataSource.register(VersionedTree)
    spark.read.format("versioned_tree").option("versions", "24,25").load(root)
    spark.readStream.format("versioned_tree").load(root)        new versions as they appear

Versions come from the option, or from filters on ``version`` where the session pushes filters to Python sources (see PUSHDOWN;
read() hands its value on); other versions' folders are then never opened. The driver lists one level of each version's folder,
tasks walk the rest. The root may be any that Arrow's file systems know: a path, file://, hdfs://, s3://.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

SCHEMA = "version int, doc_path string, raw string, problem string"
UNDECODABLE, UNREADABLE, MISSING = "not UTF-8", "unreadable", "missing version"
#: The session's setting, which the option "pushdown" repeats, as a source can't see it.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Entries of a version's folder that one task walks.
ENTRIES = 200


def opened(root: str):
    """The file system and path of a root."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def versions_under(root: str) -> dict[int, str]:
    """version -> folder, of folders whose name is one; other entries are ignored."""
    from pyarrow import fs

    files, path = opened(root)
    named = {i.base_name: i for i in files.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.Directory}
    return {int(n[8:]): i.path for n, i in sorted(named.items()) if n.startswith("version=") and n[8:].isdecimal()}


@dataclass
class Part(InputPartition):
    """Entries of one version's folder; none for a version that isn't there."""

    version: int
    folder: str | None
    entries: tuple[str, ...] = ()


def parts_of(root: str, versions: list[int], present: dict[int, str]) -> list[Part]:
    from pyarrow import fs

    files, _ = opened(root)
    out = []
    for v in versions:
        if v not in present:
            out.append(Part(v, None))
            continue
        found = sorted(i.path for i in files.get_file_info(fs.FileSelector(present[v])))
        out += [Part(v, present[v], tuple(found[i : i + ENTRIES])) for i in range(0, len(found), ENTRIES)]
    return out


def rows_of(root: str, part: Part, suffix: str) -> Iterator[tuple]:
    from pyarrow import fs

    if part.folder is None:
        yield part.version, None, None, MISSING
        return
    files, _ = opened(root)

    def below(paths: tuple[str, ...]) -> Iterator[str]:
        for i in files.get_file_info(list(paths)):
            if i.type == fs.FileType.Directory:
                yield from sorted(x.path for x in files.get_file_info(fs.FileSelector(i.path, recursive=True)) if x.type != fs.FileType.Directory)
            else:
                yield i.path

    for path in below(part.entries):
        if not path.endswith(suffix):
            continue
        name = path[len(part.folder) :].lstrip("/")
        try:
            with files.open_input_stream(path) as f:
                yield part.version, name, f.read().decode("utf-8"), None
        except UnicodeDecodeError:
            yield part.version, name, None, UNDECODABLE
        except OSError:
            yield part.version, name, None, UNREADABLE


def _asked(options: dict) -> list[int] | None:
    given = options.get("versions", "").strip()
    return sorted({int(v) for v in given.split(",")}) if given else None


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.suffix, self.asked = options["path"], options.get("suffix", ".md"), _asked(options)

    def partitions(self) -> list[Part]:
        present = versions_under(self.root)
        return parts_of(self.root, sorted(present) if self.asked is None else self.asked, present)

    def read(self, partition: Part) -> Iterator[tuple]:
        return rows_of(self.root, partition, self.suffix)


class PushingTreeReader(TreeReader):
    """Where the session pushes filters; Spark refuses such a reader where it doesn't."""

    def pushFilters(self, filters: list) -> Iterator:
        """Equality with versions is taken; everything else is Spark's."""
        for f in filters:
            wanted = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute != ("version",):
                yield f
                continue
            named = versions_under(self.root) if self.asked is None else self.asked
            self.asked = sorted(set(named) & set(wanted))


class TreeStreamReader(DataSourceStreamReader):
    """An offset is the versions seen so far, so a version that comes late is still new."""

    def __init__(self, options: dict):
        self.root, self.suffix, self.asked = options["path"], options.get("suffix", ".md"), _asked(options)

    def initialOffset(self) -> dict:
        return {"versions": ""}

    def latestOffset(self) -> dict:
        found = [v for v in versions_under(self.root) if self.asked is None or v in self.asked]
        return {"versions": ",".join(map(str, found))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        seen, now = (set(filter(None, o["versions"].split(","))) for o in (start, end))
        return parts_of(self.root, sorted(map(int, now - seen)), versions_under(self.root))

    def read(self, partition: Part) -> Iterator[tuple]:
        return rows_of(self.root, partition, self.suffix)


class VersionedTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "versioned_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return (PushingTreeReader if self.options.get("pushdown") == "true" else TreeReader)(self.options)

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader(self.options)


def read(spark: SparkSession, root: str, versions: list[int] | None = None, suffix: str = ".md") -> DataFrame:
    """Rows (version, doc_path, raw, problem) of the versions asked for, or of all."""
    spark.dataSource.register(VersionedTree)
    reader = spark.read.format("versioned_tree").option("suffix", suffix).option("pushdown", spark.conf.get(PUSHDOWN, "false"))
    return (reader if versions is None else reader.option("versions", ",".join(map(str, versions)))).load(root)


def stream(spark: SparkSession, root: str, suffix: str = ".md") -> DataFrame:
    """The same rows as a stream: a version's files come once, when its folder is first seen."""
    spark.dataSource.register(VersionedTree)
    return spark.readStream.format("versioned_tree").option("suffix", suffix).load(root)


def skipped(rows: DataFrame) -> DataFrame:
    """(version, problem, n): what wasn't read."""
    return rows.filter("problem is not null").groupBy("version", "problem").agg(F.count("*").alias("n"))
