"""Scalar text functions: identities, labels, Markdown clean-up, terms, answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headings too general to name a topic.
GENERIC_HEADINGS = ("overview", "example", "examples", "notes", "summary", "introduction", "what's next", "whats next", "before you begin", "see also", "next steps", "feedback")
TERM = r"[a-z0-9]+(?:[./-][a-z0-9]+)*"
#: Template signs and heading anchors of a documentation site.
SHORTCODE, ANCHOR = r"\{\{[<%](?s:.*?)[>%]\}\}", r"\s*\{#[^}]*\}\s*$"


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts joined by U+001F; nulls count as empty."""
    joined = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.substring(F.sha2(joined, 256), 1, 16)


def family_id(doc_path: Column, heading_path: Column, part: Column) -> Column:
    return stable_id(doc_path, F.array_join(heading_path, " > "), part)


def content_hash(text: Column) -> Column:
    return stable_id(text)


def chunk_id(family: Column, content: Column, version_low: Column) -> Column:
    return stable_id(family, content, version_low)


def fact_id(removed: Column, api: Column, resources: Column) -> Column:
    return stable_id(removed, api, F.array_join(resources, ","))


def point_id(hex_id: Column) -> Column:
    """The low 63 bits of a 16-digit hex id as a decimal."""
    return F.pmod(F.conv(hex_id, 16, 10).cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))


def title(heading_path: Column, doc_path: Column) -> Column:
    """The last heading, else the file's name without its extension."""
    return F.coalesce(F.try_element_at(heading_path, F.lit(-1)), F.regexp_extract(doc_path, r"([^/]+?)(?:\.[^./]*)?$", 1))


def citation(doc_path: Column, branch: Column, base: str = "https://docs.example.org") -> Column:
    return F.concat_ws("/", F.lit(base), branch, doc_path)


def passage(version_label: Column, heading_path: Column, title_: Column, text: Column) -> Column:
    """What is indexed: a version line, the breadcrumb (or title), a blank line, the text."""
    crumbs = F.when(F.size(heading_path) > 0, F.array_join(heading_path, " > ")).otherwise(title_)
    return F.concat(F.lit("Version "), version_label, F.lit("\n"), crumbs, F.lit("\n\n"), text)


def front_matter(text: Column) -> Column:
    """Struct(body, title) of a text that may start with a block between --- lines; quotes around the title go."""
    block = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n"
    has = text.rlike(block)
    line = F.regexp_extract(F.regexp_extract(text, block, 1), r"(?m)^title:\s*(.+?)\s*$", 1)
    named = F.regexp_replace(line, "^[\"']+|[\"']+$", "")
    return F.struct(F.when(has, F.regexp_replace(text, block, "")).otherwise(text).alias("body"), F.when(has & (line != ""), named).alias("title"))


def stripped(text: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\A\s+", ""), r"(?U)\s+\z", "")


def normalized(text: Column) -> Column:
    """Line ends to \\n; without HTML comments, shortcode delimiters, blanks at line ends, runs of blank lines and outer white space."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", ""), SHORTCODE, "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?md)[ \t]+$", ""), "\n{3,}", "\n\n")
    return stripped(t)


def clean_heading(raw: Column) -> Column:
    """Without shortcode delimiters and a {#anchor} at the end."""
    return stripped(F.regexp_replace(F.regexp_replace(raw, SHORTCODE, ""), ANCHOR, ""))


def title_from_path(doc_path: Column) -> Column:
    """The file's name with dashes as spaces, each run of letters capitalised (also after a digit)."""
    stem = F.regexp_replace(F.regexp_extract(doc_path, r"([^/]+?)(?:\.[^./]*)?$", 1), "[-_]", " ")
    runs = F.regexp_extract_all(stem, F.lit(r"(?U)\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def topic(heading_path: Column) -> Column:
    """The last two headings that aren't too general, joined by a dash."""
    general = F.array(*(F.lit(h) for h in GENERIC_HEADINGS))
    good = F.filter(heading_path, lambda h: (h != "") & ~F.array_contains(general, F.lower(h)))
    some = F.when(F.size(good) > 0, good).otherwise(heading_path)
    return F.when(F.size(some) > 0, F.array_join(F.slice(some, F.greatest(F.size(some) - 1, F.lit(1)), F.lit(2)), " — ")).otherwise(F.lit("this topic"))


def terms(text: Column) -> Column:
    """Lower-cased terms in order, duplicates kept; a compound of more than three characters is followed by its parts of more than two."""
    low = F.lower(text)
    found = F.regexp_extract_all(low, F.lit(TERM), F.lit(0))
    compound = lambda t: (F.length(t) > 3) & (F.contains(t, F.lit(".")) | F.contains(t, F.lit("/")) | F.contains(t, F.lit("-")))
    parts = lambda t: F.when(compound(t), F.filter(F.split(t, "[./-]"), lambda p: F.length(p) > 2)).otherwise(F.array().cast("array<string>"))
    return F.when(low.rlike("[a-z0-9][./-][a-z0-9]"), F.flatten(F.transform(found, lambda t: F.concat(F.array(t), parts(t))))).otherwise(found)


def resources(raw: Column) -> Column:
    """Identifiers of an "A, B and C" list, markup and dots stripped."""
    pieces = F.transform(F.split(raw, r"(?i),\s*(?:and\s+)?|\s+and\s+"), lambda p: F.regexp_replace(stripped(F.regexp_replace(p, "[*`_]", "")), r"^\.+|\.+$", ""))
    return F.filter(pieces, lambda p: p.rlike("^[A-Za-z][A-Za-z0-9]*$"))


def mentions_any(haystack: Column, needles: Column) -> Column:
    """Whether any needle is a part of the haystack, case counting."""
    return F.exists(needles, lambda n: F.contains(haystack, n))


def slug(model: Column, revision: Column) -> Column:
    """Name of a collection: lower-case letters and digits of a model's name joined by _, with a revision."""
    low = F.regexp_replace(F.regexp_replace(F.lower(model), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("chunks__"), low, F.lit("__v"), revision.cast("string"))


def disclosure(source: Column, version: Column, evidence: Column) -> Column:
    """A sentence saying how a version was chosen."""
    return (
        F.when(source == "explicit", F.concat(F.lit("For version "), version, F.lit(".")))
        .when(source == "inferred", F.concat(F.lit("For version "), version, F.lit(", inferred from "), evidence, F.lit(".")))
        .otherwise(F.concat(F.lit("For version "), version, F.lit(", the newest indexed, as none was given.")))
    )


def citations(answer: Column, blocks: Column) -> Column:
    """Struct(cited, invalid): numbers in [n] marks, each once, ascending; those outside 1..blocks are invalid."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda d: d.try_cast("int"))))
    return F.struct(F.filter(found, lambda n: n.between(1, blocks)).alias("cited"), F.filter(found, lambda n: ~n.between(1, blocks)).alias("invalid"))


def picked(choices: list[str], *key: Column) -> Column:
    """One of the choices by a portable hash of the key, so that reruns and partitions agree."""
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *(k.cast("string") for k in key)), 256), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*(F.lit(c) for c in choices)), (digest % len(choices) + 1).cast("int"))
