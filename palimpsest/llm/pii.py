"""Personal data: fixed rules, and spans that bootstrapped contexts add.

Rules find email addresses, IPv4 addresses, card numbers (12-19 digits, Luhn) and international phone numbers. Their finds are
seeds. The words to the left and to the right of an instance are lexical patterns. In each round the graph of patterns and tokens is
scored anew: a pattern's confidence for a kind is the number of times it stands beside an accepted instance of that kind, over all
times it occurs in the corpus (so "the" never gets far); patterns with ``SUPPORT`` distinct instances and a confidence of at least
``CONFIDENT`` count. An identifier-like token (with a digit or @, not inside a rule's find) is accepted for a kind whose
shape it has once the counting patterns beside it, anywhere, leave little doubt (noisy or over distinct patterns). Accepted tokens
are instances of the next round and so make and raise patterns. Both sets only grow; rounds end when no token is added. An
accepted token is a span wherever a counting pattern of its kind stands beside it. Nothing caps patterns, tokens or rounds.

Everything is DataFrame functions. Text is split at a rule's matches: pieces and matches give positions in code points by running
sums. Patterns are written with possessive loops, so that neither deep recursion nor repeated scans of a long run occur; texts
without the sign a rule needs are skipped. Null texts count as empty; rows with equal ids stay separate; repeated rows get equal spans.
Of the kinds that fit a token, the first as listed is its span's. Other columns are ignored, whatever their names (``redacted`` hands
them on and sets ``n_chars`` anew where a text changes). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

KINDS = ("email", "ip", "card", "phone")
#: The rules. ``\\G`` lets a match begin where the last one ended, as leftmost matching without the look-behind would.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TOKEN = r"(?<![^\x20\x09-\x0D])(?=[^0-9@\x20\x09-\x0D]*+[0-9@])[^\x20\x09-\x0D]++"
SHAPES = {"email": r"^[^@]+@[^@]*[a-z]", "ip": r"^[0-9a-f]+([.:][0-9a-f]+){3}", "card": r"^([^0-9]*[0-9]){12,19}[^0-9]*$", "phone": r"^[+(]?([^0-9]*[0-9]){7,15}[^0-9]*$"}
SUPPORT, CONFIDENT, SURE = 3, 0.5, 0.6
#: Parts in which the tokens beside one word, and the places of one token, are joined.
SALTS = 16
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Longer words stand for themselves as a digest.
LONG = 48


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    small = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    return F.when(kind == "email", True).when(kind == "ip", small).when(kind == "card", n.between(12, 19) & _luhn(F.when(n.between(12, 19), digits).otherwise(""))).when(kind == "phone", n.between(9, 15)).otherwise(True)


def _cut(kind: str, rule: str, need: str) -> Column:
    """Struct of the kind and, for each match in text, the piece before it and the match."""
    text = F.col("text")
    pairs = F.arrays_zip(F.split(text, rule, -1).alias("piece"), F.regexp_extract_all(text, F.lit(rule), F.lit(0)).alias("hit"))
    return F.struct(F.lit(kind).alias("kind"), F.when(text.rlike(need), pairs).alias("cuts"))


def _word(word: Column) -> Column:
    """What a pattern's word is known by; null for the empty word."""
    low = F.lower(word)
    return F.when(F.length(word) > LONG, F.concat(F.lit(" "), F.sha2(low.cast("binary"), 256))).when(word != "", low)


def _hits(docs: DataFrame, cuts: list[Column]) -> DataFrame:
    """(rid, kind, start, end, hit, left, right): matches with positions and the whole words beside them, lower-cased, as patterns."""
    rows = docs.select("rid", F.monotonically_increasing_id().alias("row"), F.explode(F.array(*cuts)).alias("c")).filter("c.cuts is not null").select("rid", "row", "c.kind", F.posexplode("c.cuts").alias("i", "cut"))
    piece, hit = F.col("cut.piece"), F.col("cut.hit")
    size = F.coalesce(F.length(hit), F.lit(0)).cast("long")
    before = _word(F.regexp_extract(piece, rf"(?<!{WORD})({WORD}++){SPACE}++\z", 1))
    head = rf"\A[^A-Za-z0-9\x20\x09-\x0D]*+{SPACE}++({WORD}++)"  # signs may end the match's own word
    after = _word(F.when(size > 0, F.regexp_extract(piece, rf"{head}(?={SPACE})", 1)).otherwise(F.regexp_extract(piece, head, 1)))
    rows = rows.select("rid", "row", "kind", "i", hit.alias("hit"), F.length(piece).cast("long").alias("gap"), size.alias("n"), F.concat(F.lit("<"), before).alias("left"), F.concat(F.lit(">"), after).alias("_after"))
    order = Window.partitionBy("rid", "row", "kind").orderBy("i")
    along = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.withColumns({"end": F.sum(F.col("gap") + F.col("n")).over(along), "right": F.lead("_after").over(order)})
    return ends.filter("n > 0").select("rid", "kind", (F.col("end") - F.col("n")).alias("start"), "end", "hit", "left", "right").distinct()


def ruled(docs: DataFrame) -> DataFrame:
    """The valid finds of the rules in docs (rid, text)."""
    return _hits(docs, [_cut(k, RULES[k], NEEDS[k]) for k in KINDS]).filter(_valid(F.col("kind"), F.col("hit")))


def tokens(docs: DataFrame) -> DataFrame:
    """Identifier-like tokens of docs: those with a digit or an @."""
    return _hits(docs, [_cut("token", TOKEN, "[0-9@]")]).drop("kind")


def occurrences(docs: DataFrame) -> DataFrame:
    """(word, total): how often each word occurs in docs. Tasks count before the shuffle, so a hot word is a row a task."""
    words = docs.filter("text is not null").select(F.explode(F.split("text", f"{SPACE}+")).alias("w"))
    return words.select(_word(F.col("w")).alias("word")).filter("word is not null").groupBy("word").agg(F.count("*").alias("total"))


def _beside() -> Column:
    """A row for each pattern beside a match."""
    return F.explode(F.filter(F.array("left", "right"), lambda c: c.isNotNull())).alias("context")


def _salted(few: DataFrame) -> DataFrame:
    return few.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))


def bootstrapped(docs: DataFrame, found: DataFrame, corpus: DataFrame) -> DataFrame:
    """Spans (rid, kind, start, end) that contexts add to the rules' finds ``found`` in docs; words are counted over ``corpus``."""
    shaped = F.array(*(F.when(F.lower("hit").rlike(SHAPES[k]), F.lit(k)) for k in KINDS))
    spans = found.select("rid", F.col("start").alias("_from"), F.col("end").alias("_to"))
    loose = tokens(docs)
    over = (loose["rid"] == spans["rid"]) & (spans["_from"] < loose["end"]) & (spans["_to"] > loose["start"])
    loose = loose.join(spans, over, "left_anti").select("rid", "start", "end", F.lower("hit").alias("hit"), "left", "right", F.explode(F.filter(shaped, lambda k: k.isNotNull())).alias("kind"))
    loose = written(loose, "pii-loose")
    edges = loose.select("kind", "hit", _beside()).groupBy("context", "kind", "hit").agg(F.count("*").alias("times"))
    seeds = found.select("kind", "hit", _beside()).groupBy("context", "kind", "hit").agg(F.count("*").alias("hits"))
    # Patterns whose seeds and shaped tokens together can't reach the support never do.
    both = seeds.select("context", "kind", "hits", F.lit(1).alias("seed")).unionByName(edges.select("context", "kind", F.lit(0).cast("long").alias("hits"), F.lit(0).alias("seed")))
    ways = both.groupBy("context", "kind").agg(F.sum("hits").alias("hits"), F.sum("seed").alias("distinct_hits"), F.count("*").alias("most")).filter(F.col("most") >= SUPPORT)
    ways = ways.withColumn("word", F.substring("context", 2, 1 << 30)).join(occurrences(corpus), "word")
    ways = written(ways.select("context", "kind", "hits", "distinct_hits", "total"), "pii-patterns")
    edges = edges.join(ways.select("context", "kind"), ["context", "kind"], "left_semi")
    edges = written(edges.withColumn("salt", F.pmod(F.xxhash64("hit"), F.lit(SALTS)).cast("int")), "pii-edges")
    accepted, n = edges.select("kind", "hit").limit(0), 0
    while True:
        more = edges.join(accepted, ["kind", "hit"]).groupBy("context", "kind").agg(F.sum("times").alias("more"), F.count("*").alias("others"))
        sums = [(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("hits", "more"), ("distinct_hits", "others"))]
        scored = ways.join(more, ["context", "kind"], "left").select("context", "kind", *sums, "total").withColumn("p", F.least(F.lit(0.999), F.col("hits") / F.col("total")))
        sure = written(scored.filter((F.col("distinct_hits") >= SUPPORT) & (F.col("p") >= CONFIDENT)).select("context", "kind", "p"), "pii-sure")
        doubt = edges.join(_salted(sure), ["context", "kind", "salt"]).groupBy("kind", "hit").agg(F.sum(F.log1p(-F.col("p"))).alias("doubt"))
        accepted = written(doubt.filter(F.exp("doubt") <= 1 - SURE).select("kind", "hit"), "pii-accepted")
        before, n = n, accepted.count()
        if n == before:  # both sets only grow
            break
    salt = F.pmod(F.xxhash64("rid", "start"), F.lit(SALTS)).cast("int")
    near = loose.select("rid", "start", "end", "kind", "hit", salt.alias("salt"), _beside())
    added = near.join(_salted(sure), ["context", "kind", "salt"], "left_semi").join(_salted(accepted), ["kind", "hit", "salt"], "left_semi")
    names = F.array(*(F.lit(k) for k in KINDS))
    first = added.groupBy("rid", "start", "end").agg(F.min(F.array_position(names, F.col("kind"))).alias("place"))
    return first.select("rid", F.element_at(names, F.col("place").cast("int")).alias("kind"), "start", "end")


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(F.array(*(F.lit(k) for k in KINDS)), s["kind"]).alias("k"), s["end"].alias("b"))))
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["k"].cast("int")), s["a"].cast("string"), s["b"].cast("string"))), ",")


def spans_of(docs: DataFrame, corpus: DataFrame) -> DataFrame:
    """(rid, base, spans): each document's spans, for documents (rid, text) that have any. ``corpus`` holds docs and all texts without a digit or an @."""
    found = written(ruled(docs), "pii-ruled")
    added = bootstrapped(docs, found, corpus)
    both = found.select("rid", "kind", "start", "end", F.lit(True).alias("base")).unionByName(added.withColumn("base", F.lit(False)))
    span = F.struct("kind", "start", "end")
    return both.groupBy("rid").agg(F.collect_list(F.when(F.col("base"), span)).alias("base"), F.collect_list(span).alias("spans"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with ``rid``, the same on every read: the id and a hash of the text. Rows that share it have equal spans."""
    return docs.withColumn("rid", F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")))


def found_in(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the rules' finds, and all spans, of every row of docs."""
    docs = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = docs.select("doc_id", "rid").join(spans_of(docs, docs), "rid", "left")
    base = F.coalesce("base", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))
    of_kind = lambda k: F.filter(base, lambda s: s["kind"] == k)
    count = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *count, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), F.coalesce(_joined(F.col("spans")), F.lit("")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of ``text`` replaced by its kind in brackets; overlapping spans are replaced once, by the first's kind.

    Texts without a digit or an @ can hold no span and skip the join; their words still count in the patterns' totals.
    """
    names = docs.columns
    may = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    some = numbered(docs.filter(may).select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("_row"), F.col("doc_id"), F.col("text")))
    per = spans_of(some.select("rid", "text"), docs.select("text")).select("rid", F.explode("spans").alias("s")).select("rid", "s.*")
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    before = Window.partitionBy("rid").orderBy("start", rank).rowsBetween(Window.unboundedPreceding, -1)
    apart = per.withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0))).filter(F.col("end") > F.col("seen"))
    apart = apart.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(F.greatest("start", "seen").alias("a"), "seen", "end", "kind"))).alias("cuts"))
    text = F.col("text")
    sub = lambda a, n: F.substring(text, (a + 1).cast("int"), n.cast("int"))
    pieces = F.transform("cuts", lambda c: F.concat(sub(c["seen"], c["a"] - c["seen"]), F.lit("["), F.upper(c["kind"]), F.lit("]")))
    last = F.element_at("cuts", -1)["end"]
    new = F.when(F.col("cuts").isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), sub(last, F.length(text) - last)))
    done = some.join(apart, "rid", "left").select("_row", new.alias("_text"), F.col("cuts").isNotNull().alias("_changed"))
    own = {n: F.col("_row").getField(n) for n in names} | {"text": F.col("_text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("_changed"), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    done = done.select(*(c.alias(n) for n, c in own.items()))
    return docs.filter(~may).unionByName(done)
