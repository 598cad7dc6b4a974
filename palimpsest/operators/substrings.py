"""Which of many needles stand in which texts: Aho-Corasick automata, one pass over the texts for a part of the needles.

contains_join(texts, needles) gives the pairs that ``contains(text, needle)`` gives, without a nested loop. Needles are dealt in
parts of about PART characters, counted first. One part is sent to all tasks, which scan their texts where they lie. With more, texts
and needles meet by (part, salt), needles first, so a task holds one automaton and streams the texts past it. Needles that occur in no text cost
their place in the automaton only; a text's hits are made distinct before they leave it.

Null texts and null or empty needles give no pair. Equal needles under several ids each give theirs; repeated rows give repeated pairs.
Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the needles of an automaton, about; texts of a task that meets them, about.
PART, TEXTS = 1_000_000, 50_000


def _automaton(needles: list[tuple]):
    import ahocorasick

    found: dict[str, list] = {}
    for key, needle in needles:
        found.setdefault(needle, []).append(key)
    a = ahocorasick.Automaton()
    for needle, keys in found.items():
        a.add_word(needle, keys)
    a.make_automaton()
    return a


def _hits(automaton, text: str) -> list:
    """Keys of the needles in a text, each needle's once."""
    lists = {id(keys): keys for _, keys in automaton.iter(text)} if len(automaton) else {}
    return [k for keys in lists.values() for k in keys]


def contains_join(texts: DataFrame, needles: DataFrame, text_id: str, text: str, needle_id: str, needle: str) -> DataFrame:
    """(text_id, needle_id) of every text and needle that is a part of it, code points counting as they are."""
    own = needles.filter(F.length(needle) > 0).select(F.col(needle_id).alias("_k"), F.col(needle).alias("_n"))
    size = own.agg(F.sum(F.length("_n")).alias("n")).first()["n"] or 0
    schema = f"{text_id} {texts.schema[text_id].dataType.simpleString()}, {needle_id} {needles.schema[needle_id].dataType.simpleString()}"
    names = [text_id, needle_id]

    def batch_of(batch, found: list[list], schema):
        import pyarrow as pa

        where = [i for i, keys in enumerate(found) for _ in keys]
        keys = pa.array([k for some in found for k in some], schema)
        return pa.RecordBatch.from_arrays([batch.column("_t").take(pa.array(where, pa.int64())), keys], names=names)

    asked = texts.filter(F.col(text).isNotNull()).select(F.col(text_id).alias("_t"), F.col(text).alias("_x"))
    if size <= PART:
        held = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in own.collect()])  # counted: PART characters at most

        def scan(batches: Iterator) -> Iterator:
            from pyspark.sql.pandas.types import to_arrow_type

            kind, a = to_arrow_type(key_type), _automaton(held.value)
            for batch in batches:
                yield batch_of(batch, [_hits(a, x) for x in batch.column("_x").to_pylist()], kind)

        key_type = needles.schema[needle_id].dataType
        return asked.mapInArrow(scan, schema)
    parts = 1 + size // PART
    salts = 1 + asked.count() // TEXTS
    key_type = needles.schema[needle_id].dataType
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    left = own.select(F.pmod(F.xxhash64("_n"), F.lit(parts)).cast("int").alias("part"), each(salts).alias("salt"), F.lit(False).alias("late"), none(asked, "_t").alias("_t"), "_k", F.col("_n").alias("_x"))
    right = asked.select("*", F.pmod(F.xxhash64("_t", "_x"), F.lit(salts)).cast("int").alias("salt")).select(each(parts).alias("part"), "salt", F.lit(True).alias("late"), "_t", none(own, "_k").alias("_k"), "_x")

    def meet(batches: Iterator) -> Iterator:
        from pyspark.sql.pandas.types import to_arrow_type

        kind, now, gathered, a = to_arrow_type(key_type), None, [], None
        for batch in batches:
            found = []
            for part, salt, late, key, x in zip(*(batch.column(c).to_pylist() for c in ("part", "salt", "late", "_k", "_x"))):
                if (part, salt) != now:
                    now, gathered, a = (part, salt), [], None
                if not late:
                    gathered.append((key, x))
                    found.append([])
                    continue
                a = a or _automaton(gathered)
                found.append(_hits(a, x))
            yield batch_of(batch, found, kind)

    return left.unionByName(right).repartition("part", "salt").sortWithinPartitions("part", "salt", "late").mapInArrow(meet, schema)
